"""Registered queries of what surrounds a comparison: predicates, alignment, results, state, confidence, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.scalars import Exact, Fuzzy
from ..operators import anls, compare, flat, metrics, trees
from ..sources import records
from .catalogue import CUSTOMER, CUSTOMER_LONG, GUESS, LONG, ORDER, ROLLED_UP, SUMS, _order_long, _order_pairs, anls_sql, query, r6, table
from .spec import FieldSpec, ModelSpec

COUNTS = metrics.COUNTS

# ---------------------------------------------------------------- predicates and numbers

ODD = "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN 'x' ELSE ' y ' END"


@query("SELECT o_orderkey, o_orderkey % 5 < 2 AS missing, o_orderkey % 5 < 3 AS blank, CASE o_orderkey % 5 WHEN 3 THEN 'x' WHEN 4 THEN 'y' WHEN 0 THEN NULL ELSE '' END AS squeezed FROM orders")
def null_predicates(spark, d):
    """What counts as missing in a record, and what in a matched list element."""
    x = F.expr(ODD)
    return table(spark, d, "orders").select("o_orderkey", C.is_empty_value(x).alias("missing"), C.is_blank(x).alias("blank"), C.squeeze(x).alias("squeezed"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 6 IN (0, 2, 4) THEN 1 ELSE 0 END AS DOUBLE) AS score FROM orders")
def cmp_numeric_digits(spark, d):
    """Numbers that differ beyond ten decimals, or have more digits than a decimal holds, and other ways to write one."""
    k = F.col("o_orderkey").cast("string")
    long = F.concat(F.lit("123456789012345678901234567890"), k)
    pair = {0: (long, F.concat(F.lit("$"), long, F.lit(".00"))), 1: (long, F.concat(long, F.lit("1"))), 2: (F.concat(k, F.lit(".50")), F.concat(F.lit("00"), k, F.lit(".5"))), 3: (F.concat(k, F.lit(".00000000001")), F.concat(k, F.lit(".00000000002"))), 4: (F.concat(F.lit("("), k, F.lit(")")), F.concat(F.lit("-"), k)), 5: (F.lit("no number"), F.lit("no number"))}
    side = lambda n: F.coalesce(*[F.when(F.col("o_orderkey") % 6 == r, p[n]) for r, p in pair.items()])
    return table(spark, d, "orders").select("o_orderkey", C.numeric(side(0), side(1)).alias("score"))


@query("SELECT c_custkey, CASE WHEN abs(c_acctbal - round(c_acctbal / 10) * 10) <= 2 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM customer")
def cmp_numeric_tolerance(spark, d):
    """Text amounts against their rounded tens, with an absolute tolerance."""
    a = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    b = (F.round(F.col("c_acctbal") / 10) * 10).cast("decimal(18,2)").cast("string")
    return table(spark, d, "customer").select("c_custkey", C.numeric(a, b, absolute=2.0).alias("score"))


@query("SELECT CAST(sum(CASE WHEN o_orderkey % 10 / 10.0 >= 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS reached, count(*) AS n FROM orders")
def threshold_epsilon(spark, d):
    """Scores that reach a threshold but for rounding: tenths, added up one by one, against 0.3."""
    steps = F.aggregate(F.sequence(F.lit(0), (F.col("o_orderkey") % 10).cast("int")), F.lit(-0.1), lambda s, _: s + F.lit(0.1))
    o = table(spark, d, "orders").select(C.reaches(steps, 0.3).alias("ok"))
    return o.agg(F.sum(F.col("ok").cast("long")).alias("reached"), F.count("*").alias("n"))


# ---------------------------------------------------------------- alignment and documents

@query("SELECT CAST(k AS VARCHAR) AS doc_id, k % 3 <> 0 AS has_gt, k % 4 <> 0 AS has_pred FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 3 <> 0 OR k % 4 <> 0")
def align_documents(spark, d):
    """Two tables of records joined by key; either side may lack one."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.struct("o_orderstatus").alias("record"))
    both = compare.align(o.where("doc_id % 3 <> 0"), o.where("doc_id % 4 <> 0"))
    return both.select("doc_id", F.col("expected").isNotNull().alias("has_gt"), F.col("predicted").isNotNull().alias("has_pred"))


WHOLE = f"{LONG}, w AS (SELECT doc_id, {SUMS}, round(sum(applied * weight) / sum(weight), 6) AS score FROM l GROUP BY doc_id)"


@query(f"WITH {WHOLE} SELECT CAST(doc_id AS VARCHAR) AS doc_id, {', '.join(COUNTS)}, score FROM w")
def compare_documents_native(spark, d):
    """Counts and score of each document, from the one entry point."""
    pairs = _order_pairs(spark, d).select("doc_id", F.col("gt").alias("expected"), F.col("pred").alias("predicted"))
    rows = compare.compare_with(pairs, ORDER, derived=False)["fields"].where("path = ''")
    return r6(rows.select("doc_id", *COUNTS, F.col("applied").alias("score")))


@query(f"WITH {WHOLE} SELECT CAST(doc_id AS VARCHAR) AS doc_id, round(coalesce(tp / nullif(tp + fa + fd, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce((tp + tn) / nullif(tp + tn + fa + fd + fn, 0), 0), 6) AS accuracy, score AS anls_score FROM w")
def evaluator_documents(spark, d):
    """The document rows of the evaluator layout."""
    pairs = _order_pairs(spark, d).select("doc_id", F.col("gt").alias("expected"), F.col("pred").alias("predicted"))
    rows = compare.compare_with(pairs, ORDER, evaluator_format=True, derived=False)["evaluator"]
    return r6(rows.where("path = ''").select("doc_id", "precision", "recall", "accuracy", "anls_score"))


@query(f"WITH {CUSTOMER_LONG} SELECT CAST(doc_id AS VARCHAR) AS doc_id, path, {', '.join(COUNTS)} FROM o")
def nested_documents(spark, d):
    """Customers with a nested nation as whole documents; the same rows as the native comparison."""
    pairs = _customer_pairs(spark, d)
    rows = compare.compare_documents(pairs, CUSTOMER).where("path <> ''")
    return rows.select("doc_id", "path", *COUNTS)


def _customer_pairs(spark, d):
    from .catalogue import customer_pairs

    return customer_pairs(spark, d).select("doc_id", F.col("gt").alias("expected"), F.col("pred").alias("predicted"))


@query(ROLLED_UP)
def document_rollup(spark, d):
    """Roll-up of whole documents, records missing on a side included."""
    rows = compare.compare_documents(_customer_pairs(spark, d), CUSTOMER)
    return metrics.bulk(metrics.roll_up(rows))


@query(f"WITH {CUSTOMER_LONG}, t AS (SELECT doc_id, {SUMS} FROM o WHERE leaf GROUP BY doc_id) SELECT doc_id, {', '.join(f'{c} AS aggregate_{c}' for c in COUNTS)}, round(coalesce(tp / nullif(tp + fa + fd, 0), 0), 6) AS aggregate_precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS aggregate_recall FROM t")
def leaf_aggregates(spark, d):
    """Sums over the leaves of each customer."""
    from .catalogue import _customer_long

    out = metrics.leaf_aggregates(_customer_long(spark, d))
    return r6(out.select("doc_id", *[f"aggregate_{c}" for c in COUNTS], "aggregate_precision", "aggregate_recall"))


@query(f"WITH {CUSTOMER_LONG} SELECT path, {SUMS} FROM o WHERE depth = 2 GROUP BY path")
def immediate_children(spark, d):
    """Fields directly below the nation."""
    from .catalogue import _customer_long

    return metrics.bulk(metrics.children(_customer_long(spark, d), "nation"))


@query(f"WITH {LONG} SELECT path, {SUMS} FROM l WHERE path LIKE 'pri%' GROUP BY path ORDER BY path")
def field_filter(spark, d):
    """Fields that a regular expression picks."""
    return metrics.bulk(_order_long(spark, d)).where(F.col("path").rlike("^pri")).orderBy("path")


@query(f"WITH {LONG} SELECT CAST(doc_id AS VARCHAR) AS doc_id, path AS field_path FROM l WHERE kind = 'fd'")
def non_matches_of_type(spark, d):
    """Non-matches of one type."""
    from .catalogue import non_matches

    return metrics.filter_non_matches(non_matches(spark, d), "false_discovery").select("doc_id", "field_path")


# ---------------------------------------------------------------- results and state

@query(f"WITH {LONG} SELECT path, {SUMS} FROM l GROUP BY path")
def results_round_trip(spark, d):
    """Results written as JSON lines, read again and summed."""
    rows = _order_long(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "path", "depth", "is_leaf", *COUNTS, "raw", "applied", "weight", F.lit(None).cast("string").alias("error"))
    path = f"{_shared(spark)}/results-{uuid.uuid4().hex}"
    records.write_results(rows, path)
    return metrics.bulk(records.read_results(spark, path).where("error is null"))


@query(f"WITH {LONG} SELECT path, {SUMS} FROM l GROUP BY path")
def state_round_trip(spark, d):
    """Partial sums saved after a half of the documents and taken up again."""
    rows = _order_long(spark, d)
    path = f"{_shared(spark)}/state-{uuid.uuid4().hex}"
    records.save_state(metrics.bulk(rows.where("doc_id % 2 = 0")), path)
    return metrics.merge_states(records.load_state(spark, path), metrics.bulk(rows.where("doc_id % 2 = 1")))


def _shared(spark) -> str:
    from .catalogue import shared_folder

    return shared_folder(spark)


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'JSONDecodeError' ELSE 'ValueError' END AS error_type, count(*) AS n FROM orders WHERE o_orderkey % 3 < 2 GROUP BY 1")
def errors_by_type(spark, d):
    """Documents that can't be read, by what went wrong."""
    text = F.expr("CASE o_orderkey % 3 WHEN 0 THEN '{broken' WHEN 1 THEN '[1]' ELSE '{}' END")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("expected"), F.lit("{}").alias("predicted"))
    return metrics.error_counts(compare.compare_documents(o, ModelSpec("Empty", [FieldSpec("x", "str", optional=True)])))


@query("SELECT CAST(sum(CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 1 END) AS BIGINT) AS rows_read, CAST(count(*) AS BIGINT) AS contents FROM (SELECT DISTINCT o_orderkey FROM orders)")
def pairs_without_ids(spark, d):
    """Pairs without an id column; rows of equal content are documents of their own."""
    o = table(spark, d, "orders").select(F.to_json(F.struct("o_orderkey")).alias("expected"), F.lit("{}").alias("predicted"), F.when(F.col("o_orderkey") % 7 == 0, 3).otherwise(1).alias("n"))
    found = records.json_pairs(o.select("expected", "predicted", F.explode(F.sequence(F.lit(1), F.col("n")))))
    return found.agg(F.countDistinct("doc_id").alias("rows_read"), F.countDistinct("expected").alias("contents"))


@query("SELECT CAST(sum(CASE WHEN event_id % 3 = 0 THEN 3 WHEN event_id % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fa, count(*) AS documents FROM events")
def undeclared_keys(spark, d):
    """Undeclared keys of predictions, nested ones too, as false alarms of their documents, native."""
    inner = ModelSpec("Inner", [FieldSpec("y", "str", Exact(), 1.0, optional=True)])
    model = ModelSpec("Event", [FieldSpec("x", "str", Exact(), 1.0), FieldSpec("in", "struct", model=inner, optional=True)])
    text = F.expr("""CASE event_id % 3 WHEN 0 THEN '{"x": "a", "k": 1, "in": {"y": "b", "z": {}, "w": null}}' WHEN 1 THEN '{"x": "a", "k": []}' ELSE '{"x": "a"}' END""")
    e = records.parse(table(spark, d, "events").select(F.col("event_id").alias("doc_id"), text.alias("t")), model, "t", "pred")
    gt = F.struct(F.lit("a").alias("x"), F.when(F.col("doc_id") % 3 == 0, F.struct(F.lit("b").alias("y"))).alias("in"))
    rows = flat.compare_flat(e.withColumn("gt", gt), model, documents=True, extras="n_extras").where("path = ''")
    return rows.agg(F.sum("fa").alias("fa"), F.count("*").alias("documents"))


# ---------------------------------------------------------------- confidence

SURE = ModelSpec("Sure", [FieldSpec("status", "str", Exact(), 1.0), FieldSpec("priority", "str", Exact(), 1.0)])
SURE_SQL = "c AS (SELECT o_orderkey AS k, o_orderstatus = (CASE WHEN o_orderkey % 4 = 0 THEN 'Z' ELSE o_orderstatus END) AS a, o_orderkey % 100 / 100.0 AS ca, o_orderkey % 5 <> 0 AS b, o_orderkey % 37 / 37.0 AS cb FROM orders)"


def _sure(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    with_sure = lambda v, c: F.struct(v.alias("value"), c.alias("confidence"))
    pred = F.struct(with_sure(F.when(k % 4 == 0, "Z").otherwise(F.col("o_orderstatus")), k % 100 / 100.0).alias("status"), with_sure(F.when(k % 5 == 0, "none").otherwise(F.col("o_orderpriority")), k % 37 / 37.0).alias("priority"))
    gt = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return o.select(k.cast("string").alias("doc_id"), F.to_json(gt).alias("expected"), F.to_json(pred).alias("predicted"))


@query(f"WITH {SURE_SQL} SELECT CAST(k AS VARCHAR) AS doc_id, 'status' AS path, round(ca, 6) AS confidence, a AS match FROM c UNION ALL SELECT CAST(k AS VARCHAR), 'priority', round(cb, 6), b FROM c")
def confidence_matches(spark, d):
    """Comparisons joined with the confidence of the predicted value."""
    return r6(compare.confidence_matches(_sure(spark, d), SURE).select("doc_id", "path", "confidence", "match"))


@query(f"WITH {SURE_SQL}, r AS (SELECT 'status' AS path, a AS hit, ca AS c FROM c UNION ALL SELECT 'priority', b, cb FROM c), g AS (SELECT path, c, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS p, sum(CASE WHEN hit THEN 0 ELSE 1 END) AS n FROM r GROUP BY ALL), w AS (SELECT path, p, n, p * (coalesce(sum(n) OVER (PARTITION BY path ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2.0) AS won FROM g) SELECT path, round(sum(won) / (sum(p) * sum(n)), 6) AS auroc FROM w GROUP BY path")
def auroc_by_field(spark, d):
    rows = compare.confidence_matches(_sure(spark, d), SURE)
    return r6(metrics.auroc(rows, keys=("path",)))


# ---------------------------------------------------------------- ANLS by key

@query(f"SELECT doc_id, path, round(score, 6) AS score FROM (SELECT o_orderkey AS doc_id, 'priority' AS path, {anls_sql('o_orderpriority', 'b')} AS score FROM (SELECT *, {GUESS['priority']} AS b FROM orders) UNION ALL SELECT o_orderkey, 'status', CASE WHEN lower(o_orderstatus) = lower(s) THEN 1.0 ELSE 0.0 END FROM (SELECT *, CASE WHEN o_orderkey % 17 = 0 THEN 'Z' ELSE o_orderstatus END AS s FROM orders))")
def anls_key_scores(spark, d):
    """Score of every key of every document, without a schema."""
    gt = F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")))
    pred = F.to_json(F.struct(F.expr(GUESS["priority"]).alias("priority"), F.expr("CASE WHEN o_orderkey % 17 = 0 THEN 'Z' ELSE o_orderstatus END").alias("status")))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), anls.anls_json(gt, pred).alias("r"))
    return r6(o.select("doc_id", F.explode("r.keys").alias("k")).select("doc_id", F.array_join("k.path", ".").alias("path"), "k.score"))


# ---------------------------------------------------------------- fuzzy leaves of native records

@query("SELECT 'name' AS path, CAST(count(*) AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fd FROM part UNION ALL SELECT 'brand', CAST(sum(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT), CAST(sum(CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END) AS BIGINT) FROM part")
def fuzzy_fields(spark, d):
    """Records with fuzzy fields stay native: only these leaves go through Arrow."""
    model = ModelSpec("Part", [FieldSpec("name", "str", Fuzzy(method="token_sort_ratio"), 1.0), FieldSpec("brand", "str", Exact(), 1.0)])
    flipped = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    gt = F.struct(F.col("p_name").alias("name"), F.lit("b").alias("brand"))
    pred = F.struct(F.upper(flipped).alias("name"), F.when(F.col("p_partkey") % 2 == 0, "b").otherwise("c").alias("brand"))
    rows = flat.compare_flat(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), gt.alias("gt"), pred.alias("pred")), model)
    return metrics.bulk(rows).select("path", "tp", "fd")


# ---------------------------------------------------------------- streams

@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, event_type AS path, CAST(sum(CASE WHEN value >= 20 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN value < 20 THEN 1 ELSE 0 END) AS BIGINT) AS fd FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """The events as a stream: counts of every path in hourly windows of event time."""
    from ..streaming import bulk as streams

    name = "windows_" + uuid.uuid4().hex
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    hit = (F.col("value") >= 20).cast("long")
    long = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path"), hit.alias("tp"), (1 - hit).alias("fd"), (1 - hit).alias("fp"), *[F.lit(0).cast("long").alias(c) for c in ("fa", "tn", "fn")])
    found = streams.windowed_totals(long, "ts", "1 hour").select(F.col("window.start").alias("start"), "path", "tp", "fd")
    streams.start(found, name, f"{_shared(spark)}/{name}").awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "path", "tp", "fd")


# ---------------------------------------------------------------- trees

TREE = f"""t AS (SELECT o_orderkey AS k, o_custkey % 3 = 0 AS flat, o_orderkey % 5 = 0 AS note, {anls_sql('o_orderpriority', 'b')} AS priority, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE 1.0 END AS status,
  CASE WHEN o_custkey % 3 = 0 THEN 0.0 ELSE {anls_sql('c_name', 'n')} END AS name, CASE WHEN o_custkey % 3 = 0 THEN 0.0 ELSE 1.0 END AS nation
  FROM (SELECT *, {GUESS['priority']} AS b, CASE WHEN c_custkey % 4 = 0 THEN reverse(c_name) ELSE c_name END AS n FROM orders JOIN customer ON o_custkey = c_custkey))"""


def _trees(spark, d):
    """Orders with their customers as JSON; a prediction may lack a key, have one more, or a text in an object's place."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    name = F.when(F.col("c_custkey") % 4 == 0, F.reverse("c_name")).otherwise(F.col("c_name"))
    inner = lambda n: F.struct(n.alias("name"), F.struct(F.col("c_nationkey").alias("key")).alias("nation"))
    gt = F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), inner(F.col("c_name")).alias("customer")))
    known = [F.expr(GUESS["priority"]).alias("priority"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 5 == 0, "seen").alias("note")]
    # Null fields are left out of the text.
    pred = F.when(F.col("o_custkey") % 3 == 0, F.to_json(F.struct(*known, F.lit("gone").alias("customer")))).otherwise(F.to_json(F.struct(*known, inner(name).alias("customer"))))
    return trees.compare_trees(o.select(F.col("o_orderkey").alias("doc_id"), gt.alias("expected"), pred.alias("predicted")))


@query(f"WITH {TREE} SELECT CAST(k AS VARCHAR) AS doc_id, round((priority + status + name + nation) / (4 + CASE WHEN note THEN 1 ELSE 0 END), 6) AS score FROM t")
def anls_trees(spark, d):
    """Scores of nested JSON without a schema, level by level."""
    return r6(_trees(spark, d).scores)


@query(f"""WITH {TREE}, s AS (SELECT 'priority' AS path, priority AS s FROM t UNION ALL SELECT 'status', status FROM t UNION ALL SELECT 'note', 0.0 FROM t WHERE note UNION ALL SELECT 'customer', (name + nation) / 2 FROM t UNION ALL SELECT 'customer.name', name FROM t WHERE NOT flat
UNION ALL SELECT 'customer.nation', nation FROM t WHERE NOT flat UNION ALL SELECT 'customer.nation.key', nation FROM t WHERE NOT flat) SELECT path, round(avg(s), 6) AS score, count(*) AS n FROM s GROUP BY path""")
def anls_tree_keys(spark, d):
    """Mean score of every key of either side."""
    return r6(_trees(spark, d).keys.groupBy("path").agg(F.avg("score").alias("score"), F.count("*").alias("n")))
