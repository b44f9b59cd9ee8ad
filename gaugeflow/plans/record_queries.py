"""Registered queries of dictionaries, JSON Schemas, one-pass results, model comparators, and of documents that come again in a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import json_rules
from ..functions.scalars import Exact, Numeric, Scored
from ..operators import evaluation, flat, memo, metrics
from ..sources.stored import shared_folder
from .catalogue import GUESS, LONG, ORDER, SUMS, _order_pairs, query, r6, table
from .spec import FieldSpec, ModelSpec

# ---------------------------------------------------------------- dictionaries

TALLY = ModelSpec("Tally", [FieldSpec("kinds", "map:int", Numeric(relative_tolerance=0.2), 0.6, optional=True)])
#: Events of a user by type: all that count in the truth, and those that were found.
TALLY_SQL = """t AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value >= 12 GROUP BY ALL), p AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 5 <> 0 AND value >= 11 GROUP BY ALL),
  k AS (SELECT coalesce(t.user_id, p.user_id) AS u, coalesce(t.event_type, p.event_type) AS kind, t.n AS a, p.n AS b FROM t FULL JOIN p ON t.user_id = p.user_id AND t.event_type = p.event_type),
  o AS (SELECT *, CASE WHEN a IS NULL THEN 'fa' WHEN b IS NULL THEN 'fn' WHEN abs(a - b) <= a * 0.2 THEN 'tp' ELSE 'fd' END AS outcome FROM k)"""


def _tallies(spark, d):
    e = table(spark, d, "events")

    def side(keep: str, name: str):
        each = e.where(keep).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
        return each.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias(name))

    users = e.select("user_id").distinct()
    both = users.join(side("value >= 12", "a"), "user_id", "left").join(side("event_id % 5 <> 0 AND value >= 11", "b"), "user_id", "left")
    return both.select(F.col("user_id").alias("doc_id"), F.struct(F.col("a").alias("kinds")).alias("gt"), F.struct(F.col("b").alias("kinds")).alias("pred"))


@query(f"""WITH {TALLY_SQL}, s AS (SELECT u, count(a) AS n, count(b) AS m, avg(CASE WHEN outcome = 'tp' THEN 1.0 ELSE 0.0 END) AS score FROM o GROUP BY u),
  r AS (SELECT user_id AS doc_id, coalesce(n, 0) AS n, coalesce(m, 0) AS m, score FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN s ON u = user_id)
  SELECT doc_id, CASE WHEN n = 0 AND m = 0 THEN 'tn' WHEN n = 0 THEN 'fa' WHEN m = 0 THEN 'fn' WHEN score >= 0.6 THEN 'tp' ELSE 'fd' END AS outcome, CASE WHEN n = 0 AND m = 0 THEN 1.0 WHEN n = 0 OR m = 0 THEN 0.0 ELSE round(score, 6) END AS raw FROM r""")
def map_fields(spark, d):
    """Users' events by type as dictionaries whose sides have different keys, one score for each user."""
    return r6(flat.compare_flat(_tallies(spark, d), TALLY).select("doc_id", "outcome", "raw"))


@query(f"WITH {TALLY_SQL} SELECT 'kinds.' || kind AS path, " + ", ".join(f"CAST(sum(CASE WHEN outcome {t} THEN 1 ELSE 0 END) AS BIGINT) AS {c}" for c, t in {"tp": "= 'tp'", "fa": "= 'fa'", "fd": "= 'fd'", "fp": "IN ('fa', 'fd')", "tn": "= 'tn'", "fn": "= 'fn'"}.items()) + " FROM o GROUP BY kind")
def map_keys(spark, d):
    """Confusion counts of every key of the same dictionaries."""
    return metrics.bulk(flat.compare_keys(_tallies(spark, d), TALLY))


# ---------------------------------------------------------------- documents that come again

SEEN = ModelSpec("Seen", [FieldSpec("kind", "str", Exact(), 1.0), FieldSpec("amount", "float", Numeric(absolute_tolerance=0.5), 1.0, optional=True)])
SEEN_RULES = {"kind": "CASE WHEN event_id % 3 = 0 THEN 'view' ELSE event_type END", "amount": "CASE WHEN event_id % 4 = 0 THEN value + 1 WHEN event_id % 7 <> 0 THEN value END"}
SEEN_KINDS = {"kind": f"CASE WHEN event_type = ({SEEN_RULES['kind']}) THEN 'tp' ELSE 'fd' END", "amount": "CASE WHEN event_id % 4 = 0 THEN 'fd' WHEN event_id % 7 <> 0 THEN 'tp' ELSE 'fn' END"}
SEEN_LONG = " UNION ALL ".join(f"SELECT '{p}' AS path, {k} AS kind FROM e" for p, k in SEEN_KINDS.items())
SEEN_COUNTS = ", ".join(f"CASE WHEN kind {t} THEN 1 ELSE 0 END AS {c}" for c, t in {"tp": "= 'tp'", "fa": "= 'fa'", "fd": "= 'fd'", "fp": "= 'fd'", "tn": "= 'tn'", "fn": "= 'fn'"}.items())


@query(f"""WITH e AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 40 ORDER BY event_id DESC) = 1), l AS (SELECT path, {SEEN_COUNTS} FROM ({SEEN_LONG}))
  SELECT path, (SELECT count(*) FROM e) AS documents, {SUMS} FROM (SELECT * FROM l UNION ALL SELECT '', * EXCLUDE path FROM l) GROUP BY path""")
def stream_documents(spark, d):
    """The events as a stream of documents that are corrected again and again, each event being a version: totals of the newest ones."""
    from ..streaming import documents

    folder = f"{shared_folder(spark)}/documents_{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    found = F.struct(*[F.expr(rule).alias(name) for name, rule in SEEN_RULES.items()])
    pairs = events.select(F.concat_ws("-", "user_id", F.col("event_id") % 40).alias("doc_id"), F.col("event_id").alias("version"), F.struct(F.col("event_type").alias("kind"), F.col("value").alias("amount")).alias("expected"), found.alias("predicted"))
    documents.start(documents.arrivals(pairs, SEEN, "version"), f"{folder}/totals", f"{folder}/checkpoint").awaitTermination()
    return documents.saved(spark, f"{folder}/totals")


# ---------------------------------------------------------------- JSON Schema

EVENT_SCHEMA = {
    "$defs": {"small": {"type": "integer", "minimum": 10, "exclusiveMaximum": 90}},
    "type": "object",
    "required": ["kind", "user"],
    "additionalProperties": False,
    "properties": {
        "kind": {"enum": ["click", "view", "purchase"]},
        "user": {"type": "string", "pattern": "^u[0-9]*[02468]$", "maxLength": 3},
        "value": {"oneOf": [{"type": "number", "maximum": 20}, {"type": "number", "exclusiveMinimum": 15}]},
        "props": {"type": "object", "minProperties": 1, "properties": {"k": {"$ref": "#/$defs/small"}}},
        "parts": {"type": "array", "items": {"anyOf": [{"type": "string"}, {"$ref": "#/$defs/small"}]}, "minItems": 2},
    },
    "if": {"properties": {"kind": {"const": "view"}}},
    "then": {"required": ["value"]},
}
EVENT_FACTS = "SELECT event_id, event_type, user_id, value, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events"
EVENT_RULES = [
    ("$.kind", "enum", "event_type NOT IN ('click', 'view', 'purchase')"),
    ("$.user", "pattern", "event_id % 10 <> 0 AND user_id % 2 = 1"),
    ("$.user", "maxLength", "event_id % 10 <> 0 AND user_id > 99"),
    ("$.user", "required", "event_id % 10 = 0"),
    ("$.value", "oneOf", "event_id % 4 <> 0 AND value > 15 AND value <= 20"),
    ("$.value", "required", "event_id % 4 = 0 AND event_type = 'view'"),
    ("$.props.k", "minimum", "k < 10"),
    ("$.props.k", "exclusiveMaximum", "k >= 90"),
    ("$.parts", "minItems", "event_id % 3 = 0"),
    ("$.parts[0]", "anyOf", "k < 10 OR k >= 90"),
    ("$.note", "additionalProperties", "event_id % 6 = 0"),
]


@query(f"WITH e AS ({EVENT_FACTS}) " + " UNION ALL ".join(f"SELECT event_id, '{path}' AS path, '{rule}' AS rule FROM e WHERE {test}" for path, rule, test in EVENT_RULES))
def schema_violations(spark, d):
    """Events as JSON with their properties inside, held against a JSON Schema compiled to columns."""
    e = table(spark, d, "events")
    props = F.from_json("props", "k long")
    # Null fields are left out of the text.
    text = F.to_json(F.struct(
        F.col("event_type").alias("kind"),
        F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("user"),
        F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"),
        props.alias("props"),
        F.when(F.col("event_id") % 3 == 0, F.array(props["k"])).otherwise(F.array(props["k"], F.lit(50).cast("long"))).alias("parts"),
        F.when(F.col("event_id") % 6 == 0, "odd").alias("note"),
    ))
    return json_rules.check(e.select("event_id", text.alias("t")), "t", EVENT_SCHEMA, ("event_id",))


# ---------------------------------------------------------------- one evaluation

@query(f"WITH {LONG} SELECT CAST(doc_id AS VARCHAR) AS doc_id, path AS field_path, CASE kind WHEN 'fa' THEN 'false_alarm' WHEN 'fn' THEN 'false_negative' ELSE 'false_discovery' END AS type, CASE WHEN kind = 'fd' THEN round(raw, 6) END AS similarity, (SELECT count(*) FROM orders) AS documents, (SELECT CAST(sum(tp) AS BIGINT) FROM l) AS all_tp FROM l WHERE kind IN ('fa', 'fn', 'fd')")
def one_pass_results(spark, d):
    """Non-matches out of the one written evaluation of the orders, with the counts observed while it was written."""
    pairs = _order_pairs(spark, d).select("doc_id", F.col("gt").alias("expected"), F.col("pred").alias("predicted"))
    found = evaluation.evaluate(pairs, ORDER, f"{shared_folder(spark)}/evaluation-{uuid.uuid4().hex}")
    rows = r6(found.non_matches().select("doc_id", "field_path", "type", "similarity"))
    return rows.withColumns({"documents": F.lit(found.counted["documents"]), "all_tp": F.lit(found.counted["tp"])})


# ---------------------------------------------------------------- comparators that ask a model

def length_share(a: str, b: str) -> float:
    """Stands for a model: the shorter length as a share of the longer."""
    return min(len(a), len(b)) / max(len(a), len(b))


ASKED = ModelSpec("Asked", [FieldSpec("priority", "str", Scored(function=length_share), 0.9, optional=True), FieldSpec("status", "str", Exact(), 1.0)])
BARE = "regexp_replace({x}, '[[:punct:][:space:]]', '', 'g')"
PRIORITY_SCORE = "CASE WHEN a IS NULL OR a = '' OR b IS NULL OR b = '' THEN CASE WHEN (a IS NULL OR a = '') AND (b IS NULL OR b = '') THEN 1.0 ELSE 0.0 END WHEN a = b THEN 1.0 ELSE least(length({x}), length({y})) / greatest(length({x}), length({y}))::DOUBLE END".format(x=BARE.format(x="a"), y=BARE.format(x="b"))


@query(f"WITH s AS (SELECT o_orderkey, {PRIORITY_SCORE} AS raw FROM (SELECT o_orderkey, o_orderpriority AS a, {GUESS['priority']} AS b FROM orders)) SELECT o_orderkey AS doc_id, round(raw, 6) AS raw, CASE WHEN raw >= 0.9 THEN round(raw, 6) ELSE 0.0 END AS applied FROM s")
def model_comparator(spark, d):
    """A field that a model compares: it is asked once about each distinct pair of values, in batches, and remembered."""
    known = memo.Memo(spark, f"{shared_folder(spark)}/memo-{uuid.uuid4().hex}")
    o = table(spark, d, "orders")
    side = lambda v: F.struct(v.alias("priority"), F.col("o_orderstatus").alias("status"))
    pairs = o.select(F.col("o_orderkey").alias("doc_id"), side(F.col("o_orderpriority")).alias("expected"), side(F.expr(GUESS["priority"])).alias("predicted"))
    return r6(memo.compare_records(pairs, ASKED, known).where("path = 'priority'").select("doc_id", "raw", "applied"))
