"""The registered queries of the evaluation engine and their SQL equivalents.

Truth and prediction come from the given tables: a prediction is its row with
values changed by rules on the key, so every run sees the same errors. The
rules are SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.scalars import Exact, Levenshtein, Numeric
from ..operators import anls, compare, flat, flatten, lists, metrics, nested, packet
from ..sources import records
from ..sources.stored import shared_folder
from .spec import FieldSpec, ModelSpec

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracle: dict[str, str] = {}
COUNTS = metrics.COUNTS
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTS)


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        _queries[f.__name__] = f
        if sql:
            _oracle[f.__name__] = sql
        return f

    return add


def _all() -> None:
    """The further modules register their queries when they are imported."""
    from . import matching_queries, record_queries, surface_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_oracle)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, for comparison across engines."""
    return df.select(*[F.round(f"`{c}`", 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


# ---------------------------------------------------------------- comparators

NORM = "lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


def lev_sql(a: str, b: str) -> str:
    x, y = NORM.format(x=f"coalesce({a}, '')"), NORM.format(x=f"coalesce({b}, '')")
    return f"(CASE WHEN greatest(length({x}), length({y})) = 0 THEN 1.0 ELSE 1.0 - levenshtein({x}, {y})::DOUBLE / greatest(length({x}), length({y})) END)"


def exact_sql(a: str, b: str, lower: bool = True) -> str:
    strip = lambda v: (f"lower({v})" if lower else v).join(("regexp_replace(", ", '[[:punct:][:space:]]', '', 'g')"))
    return f"(CASE WHEN {a} IS NULL AND {b} IS NULL THEN 1.0 WHEN {a} IS NULL OR {b} IS NULL THEN 0.0 WHEN {strip(a)} = {strip(b)} THEN 1.0 ELSE 0.0 END)"


def numeric_sql(a: str, b: str, rel: float = 0.0, absolute: float = 0.0) -> str:
    return f"(CASE WHEN {a} IS NULL AND {b} IS NULL THEN 1.0 WHEN {a} IS NULL OR {b} IS NULL THEN 0.0 WHEN {a} = {b} OR ({absolute} > 0 AND abs({a} - {b}) <= {absolute} AND NOT ({rel} > 0 AND {a} = 0)) OR ({rel} > 0 AND abs({a} - {b}) <= CASE WHEN {a} = 0 THEN {rel} ELSE abs({a}) * {rel} END) THEN 1.0 ELSE 0.0 END)"


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"), F.col("p_retailprice").alias("other_price"))
    return part.select("p_partkey", "p_name", "p_retailprice").join(after, "p_partkey")


NEIGHBOURS = "SELECT a.p_partkey, a.p_name, b.p_name AS other, a.p_retailprice, b.p_retailprice AS other_price FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


@query(f"SELECT p_partkey, round({lev_sql('p_name', 'other')}, 6) AS score FROM ({NEIGHBOURS})")
def cmp_levenshtein(spark, d):
    return r6(_neighbours(spark, d).select("p_partkey", C.levenshtein(F.col("p_name"), F.col("other")).alias("score")))


@query(f"SELECT o_orderkey, {exact_sql('o_orderpriority', 'b')} AS score FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN upper(replace(o_orderpriority, '-', ' ')) WHEN o_orderkey % 3 = 1 THEN o_orderpriority || 'x' ELSE lower(o_orderpriority) END AS b FROM orders)")
def cmp_exact(spark, d):
    b = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN upper(replace(o_orderpriority, '-', ' ')) WHEN o_orderkey % 3 = 1 THEN o_orderpriority || 'x' ELSE lower(o_orderpriority) END")
    return table(spark, d, "orders").select("o_orderkey", C.exact(F.col("o_orderpriority"), b).alias("score"))


@query(f"SELECT o_orderkey, {exact_sql('o_orderpriority', 'b', lower=False)} AS score FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) ELSE replace(o_orderpriority, '-', '--') END AS b FROM orders)")
def cmp_exact_cs(spark, d):
    b = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) ELSE replace(o_orderpriority, '-', '--') END")
    return table(spark, d, "orders").select("o_orderkey", C.exact(F.col("o_orderpriority"), b, case_sensitive=True).alias("score"))


@query(f"SELECT p_partkey, {numeric_sql('p_retailprice', 'other_price', absolute=0.15)} AS score FROM ({NEIGHBOURS})")
def cmp_numeric_abs(spark, d):
    return _neighbours(spark, d).select("p_partkey", C.numeric(F.col("p_retailprice"), F.col("other_price"), absolute=0.15, kind="float").alias("score"))


@query(f"SELECT c_custkey, {numeric_sql('c_acctbal', 'b', rel=0.03)} AS score FROM (SELECT c_custkey, c_acctbal, c_acctbal * CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.02 ELSE 1.05 END AS b FROM (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer) UNION ALL SELECT -c_custkey, 0, (c_custkey % 7 - 3) / 100.0 FROM customer)")
def cmp_numeric_rel(spark, d):
    """Balances that are off by some percent; where the truth is zero the tolerance bounds the prediction itself."""
    own = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 50 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    c = own.withColumn("b", F.expr("c_acctbal * CASE c_custkey % 3 WHEN 0 THEN 1.0D WHEN 1 THEN 1.02D ELSE 1.05D END"))
    c = c.unionByName(own.select((-F.col("c_custkey")).alias("c_custkey"), F.lit(0.0).alias("c_acctbal"), ((F.col("c_custkey") % 7 - 3) / 100.0).alias("b")))
    return c.select("c_custkey", C.numeric(F.col("c_acctbal"), F.col("b"), relative=0.03, kind="float").alias("score"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 0.0 ELSE 1.0 END AS score FROM orders")
def cmp_numeric_parse(spark, d):
    """Amounts written with currency signs, separators and accounting brackets, against plain ones."""
    plain = F.expr("cast(cast(o_totalprice AS decimal(18, 2)) AS string)")
    shown = F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat('$', format_number(cast(o_totalprice AS decimal(18, 2)), 2)) WHEN 1 THEN concat(cast(cast(o_totalprice AS decimal(18, 2)) AS string), ' USD') WHEN 2 THEN concat('(', cast(cast(o_totalprice AS decimal(18, 2)) AS string), ')') ELSE 'none' END")
    truth = F.when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("-"), plain)).otherwise(plain)
    return table(spark, d, "orders").select("o_orderkey", C.numeric(truth, shown).alias("score"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cmp_cosine(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return r6(e.join(after, "vec_id").select("vec_id", C.cosine(F.col("embedding"), F.col("b")).alias("score")))


@query(f"SELECT CAST(sum(CASE WHEN s >= 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN s >= 0.7 THEN 0 ELSE 1 END) AS BIGINT) AS fp FROM (SELECT {lev_sql('p_name', 'other')} AS s FROM ({NEIGHBOURS}))")
def binary_compare(spark, d):
    hit = _neighbours(spark, d).select(C.binary(C.levenshtein(F.col("p_name"), F.col("other")), 0.7).alias("b"))
    return hit.agg(F.sum("b.tp").cast("long").alias("tp"), F.sum("b.fp").cast("long").alias("fp"))


# ---------------------------------------------------------------- flat records

ORDER = ModelSpec("Order", [
    FieldSpec("status", "str", Exact(), threshold=1.0, weight=2.0),
    FieldSpec("priority", "str", Levenshtein(), threshold=0.8),
    FieldSpec("price", "float", Numeric(relative_tolerance=0.01), threshold=0.95),
])
TRUTH = {"status": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END", "priority": "o_orderpriority", "price": "o_totalprice"}
GUESS = {
    "status": "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'Z' ELSE lower(o_orderstatus) END",
    "priority": "CASE WHEN o_orderkey % 7 = 0 THEN concat('x', substring(o_orderpriority, 2)) WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderpriority END",
    "price": "CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 1.05 ELSE o_totalprice END",
}
SCORES = {"status": exact_sql("a_status", "b_status"), "priority": lev_sql("a_priority", "b_priority"), "price": numeric_sql("a_price", "b_price", rel=0.01)}


def _long_sql() -> str:
    base = ", ".join(f"{TRUTH[k]} AS a_{k}, {GUESS[k]} AS b_{k}" for k in TRUTH)
    each = []
    for f in ORDER.fields:
        no = lambda s: f"({s}_{f.name} IS NULL OR CAST({s}_{f.name} AS VARCHAR) = '')"  # noqa: B023, E731
        each.append(f"SELECT doc_id, '{f.name}' AS path, CASE WHEN {no('a')} AND {no('b')} THEN 'tn' WHEN {no('a')} THEN 'fa' WHEN {no('b')} THEN 'fn' WHEN {SCORES[f.name]} >= {f.threshold} THEN 'tp' ELSE 'fd' END AS kind, {SCORES[f.name]} AS s, {f.threshold} AS t, {f.weight} AS weight FROM p")
    one = ", ".join(f"CASE WHEN kind = '{c}' THEN 1 ELSE 0 END AS {c}" for c in COUNTS if c != "fp")
    return f"p AS (SELECT o_orderkey AS doc_id, {base} FROM orders), k AS ({' UNION ALL '.join(each)}), l AS (SELECT doc_id, path, kind, weight, t, {one}, CASE WHEN kind IN ('fa', 'fd') THEN 1 ELSE 0 END AS fp, CASE kind WHEN 'tn' THEN 1.0 WHEN 'fa' THEN 0.0 WHEN 'fn' THEN 0.0 ELSE s END AS raw, CASE kind WHEN 'tn' THEN 1.0 WHEN 'tp' THEN s ELSE 0.0 END AS applied FROM k)"


LONG = _long_sql()
DERIVED = "round(coalesce(tp / nullif(tp + fa + fd, 0), 0), 6) AS precision, round(coalesce(tp / nullif({recall}, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2.0 * tp + fa + fd + {recall} - tp, 0), 0), 6) AS f1, round(coalesce((tp + tn) / nullif(tp + tn + fa + fd + fn, 0), 0), 6) AS accuracy"
BY_PATH = f"t AS (SELECT path, {SUMS} FROM l GROUP BY path)"


def _order_pairs(spark: SparkSession, d: str) -> DataFrame:
    side = lambda rules: F.struct(*[F.expr(x.replace("1.05", "1.05D")).alias(k) for k, x in rules.items()])
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), side(TRUTH).alias("gt"), side(GUESS).alias("pred"))


def _order_long(spark: SparkSession, d: str) -> DataFrame:
    return flat.compare_flat(_order_pairs(spark, d), ORDER)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_confusion(spark, sf_dir)


@query(f"WITH {LONG}, {BY_PATH} SELECT path, tp, fa, fd, fp, tn, fn, {DERIVED.format(recall='(tp + fn)')} FROM t")
def flat_confusion(spark, d):
    """Counts and derived metrics of every field over all orders."""
    return r6(metrics.derived(metrics.bulk(_order_long(spark, d))).select("path", *COUNTS, "precision", "recall", "f1", "accuracy"))


@query(f"WITH {LONG}, {BY_PATH} SELECT path, {DERIVED.format(recall='(tp + fn + fd)')} FROM t")
def recall_with_fd(spark, d):
    return r6(metrics.derived(metrics.bulk(_order_long(spark, d)), recall_with_fd=True).select("path", "precision", "recall", "f1", "accuracy"))


@query(f"WITH {LONG} SELECT path, {SUMS} FROM (SELECT path, {', '.join(COUNTS)} FROM l UNION ALL SELECT '', {', '.join(COUNTS)} FROM l) GROUP BY path")
def bulk_field_metrics(spark, d):
    """Corpus sums of every path and of whole documents, in one aggregate."""
    rows = _order_long(spark, d)
    both = rows.select(F.explode(F.array(F.col("path"), F.lit(""))).alias("path"), *COUNTS)
    return metrics.bulk(both)


@query(f"WITH {LONG}, t AS (SELECT {SUMS} FROM l) SELECT {DERIVED.format(recall='(tp + fn)')} FROM t")
def derived_metrics(spark, d):
    total = _order_long(spark, d).agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])
    return r6(metrics.derived(total).select("precision", "recall", "f1", "accuracy"))


@query(f"WITH {LONG} SELECT doc_id, round(sum(applied * weight) / sum(weight), 6) AS overall_score, CAST(min(CASE WHEN raw >= t THEN 1 ELSE 0 END) AS BOOLEAN) AS all_fields_matched FROM l GROUP BY doc_id")
def overall_score(spark, d):
    return r6(flat.document_scores(_order_long(spark, d)).select("doc_id", "overall_score", "all_fields_matched"))


@query(f"WITH {LONG}, a AS (SELECT doc_id, min(CASE WHEN raw >= t THEN 1 ELSE 0 END) AS m FROM l GROUP BY doc_id) SELECT CAST(sum(m) AS BIGINT) AS matched, count(*) AS documents FROM a")
def all_fields_matched(spark, d):
    each = flat.document_scores(_order_long(spark, d))
    return each.agg(F.sum(F.col("all_fields_matched").cast("long")).alias("matched"), F.count("*").alias("documents"))


@query(f"WITH {LONG} SELECT path, round(avg(raw), 6) AS mean_raw, round(avg(applied), 6) AS mean_applied FROM l GROUP BY path")
def clip_vs_raw(spark, d):
    return r6(_order_long(spark, d).groupBy("path").agg(F.avg("raw").alias("mean_raw"), F.avg("applied").alias("mean_applied")))


@query(f"WITH {LONG} SELECT path, {SUMS} FROM l GROUP BY path")
def merge_state(spark, d):
    """Four partial states of a quarter of the documents each, merged."""
    rows = _order_long(spark, d)
    return metrics.merge_states(*[metrics.bulk(rows.where(F.col("doc_id") % 4 == k)) for k in range(4)])


@query(f"WITH {LONG} SELECT CAST(doc_id AS VARCHAR) AS doc_id, path AS field_path, CASE kind WHEN 'fa' THEN 'false_alarm' WHEN 'fn' THEN 'false_negative' ELSE 'false_discovery' END AS type, CASE WHEN kind = 'fd' THEN round(raw, 6) END AS similarity FROM l WHERE kind IN ('fa', 'fn', 'fd')")
def non_matches(spark, d):
    """Every non-match of the orders, native."""
    names = F.create_map(*[F.lit(x) for x in ("fa", "false_alarm", "fn", "false_negative", "fd", "false_discovery")])
    rows = _order_long(spark, d).where(F.col("outcome").isin("fa", "fn", "fd"))
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("path").alias("field_path"), names[F.col("outcome")].alias("type"), F.when(F.col("outcome") == "fd", F.round("raw", 6)).alias("similarity"))


@query(f"WITH {LONG} SELECT CASE kind WHEN 'fa' THEN 'false_alarm' WHEN 'fn' THEN 'false_negative' ELSE 'false_discovery' END AS type, count(*) AS n FROM l WHERE kind IN ('fa', 'fn', 'fd') GROUP BY 1")
def non_match_summary(spark, d):
    return metrics.non_match_summary(non_matches(spark, d))


@query(f"WITH {LONG} SELECT doc_id, path AS expected_key, CAST(CASE WHEN (kind = 'fa' OR kind = 'fn') THEN 0 WHEN raw >= t THEN 1 ELSE 0 END AS BOOLEAN) AS match, round(raw, 6) AS score, round(applied * weight, 6) AS weighted_score FROM l")
def field_comparisons(spark, d):
    """One row for each leaf comparison of the orders."""
    rows = _order_long(spark, d)
    return rows.select("doc_id", F.col("path").alias("expected_key"), (F.col("raw") >= F.col("threshold")).alias("match"), F.round("raw", 6).alias("score"), F.round(F.col("applied") * F.col("weight"), 6).alias("weighted_score"))


@query(f"WITH {LONG}, f AS (SELECT doc_id, path, applied AS s FROM l), m AS (SELECT doc_id, path, s, CASE WHEN s >= 0.5 THEN s ELSE 0 END AS tp, CASE WHEN s >= 0.5 THEN 1 - s ELSE s END AS fp, CASE WHEN s >= 0.5 THEN 0 ELSE 1 - s END AS fn FROM f) SELECT CAST(doc_id AS VARCHAR) AS doc_id, path, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(s, 6) AS anls_score FROM m")
def evaluator_format(spark, d):
    """Field rows of the evaluator layout."""
    rows = _order_long(spark, d).withColumn("doc_id", F.col("doc_id").cast("string"))
    return r6(flatten.evaluator_rows(rows).where("path <> ''").select("doc_id", "path", "precision", "recall", "anls_score"))


# ---------------------------------------------------------------- nested structs

ADDRESS = ModelSpec("Nation", [FieldSpec("name", "str", Exact(), 1.0), FieldSpec("region", "str", Exact(), 1.0)])
CUSTOMER = ModelSpec("Customer", [
    FieldSpec("name", "str", Levenshtein(), 0.9),
    FieldSpec("segment", "str", Exact(), 1.0),
    FieldSpec("nation", "struct", threshold=0.7, model=ADDRESS, weight=2.0),
])
CUSTOMER_SQL = "c AS (SELECT c_custkey AS doc_id, c_name AS a_name, CASE WHEN c_custkey % 6 = 0 THEN c_name || ' Ltd' ELSE c_name END AS b_name, c_mktsegment AS a_segment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS b_segment, n_name AS a_nation, CASE WHEN c_custkey % 5 = 0 THEN 'ELSEWHERE' ELSE n_name END AS b_nation, r_name AS a_region, CASE WHEN c_custkey % 10 = 0 THEN 'NOWHERE' ELSE r_name END AS b_region, c_custkey % 8 = 0 AS gone, c_custkey % 9 = 4 AS lost FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
CUSTOMER_LONG = CUSTOMER_SQL + f""", s AS (SELECT *, {lev_sql('a_name', 'b_name')} AS name_s, {exact_sql('a_nation', 'b_nation')} AS nation_s, {exact_sql('a_region', 'b_region')} AS region_s FROM c),
l AS (SELECT doc_id, 'name' AS path, true AS leaf, 1 AS depth, CASE WHEN name_s >= 0.9 THEN 'tp' ELSE 'fd' END AS kind FROM s
UNION ALL SELECT doc_id, 'segment', true, 1, CASE WHEN b_segment IS NULL THEN 'fn' ELSE 'tp' END FROM s
UNION ALL SELECT doc_id, 'nation', gone OR lost, 1, CASE WHEN gone AND lost THEN 'tn' WHEN lost THEN 'fa' WHEN gone THEN 'fn' WHEN (nation_s + region_s) / 2 >= 0.7 THEN 'tp' ELSE 'fd' END FROM s
UNION ALL SELECT doc_id, 'nation.name', true, 2, CASE WHEN nation_s >= 1 THEN 'tp' ELSE 'fd' END FROM s WHERE NOT gone AND NOT lost
UNION ALL SELECT doc_id, 'nation.region', true, 2, CASE WHEN region_s >= 1 THEN 'tp' ELSE 'fd' END FROM s WHERE NOT gone AND NOT lost),
o AS (SELECT doc_id, path, leaf, depth, {', '.join(f"CASE WHEN kind = '{c}' THEN 1 ELSE 0 END AS {c}" for c in COUNTS if c != 'fp')}, CASE WHEN kind IN ('fa', 'fd') THEN 1 ELSE 0 END AS fp FROM l)"""


def customer_pairs(spark, d):
    """(doc_id, gt, pred) of customers; either side, or both, may lack the nation."""
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    gt = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.when(k % 9 != 4, F.struct(F.col("n_name").alias("name"), F.col("r_name").alias("region"))).alias("nation"))
    there = F.struct(F.when(k % 5 == 0, "ELSEWHERE").otherwise(F.col("n_name")).alias("name"), F.when(k % 10 == 0, "NOWHERE").otherwise(F.col("r_name")).alias("region"))
    pred = F.struct(F.when(k % 6 == 0, F.concat("c_name", F.lit(" Ltd"))).otherwise(F.col("c_name")).alias("name"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 8 != 0, there).alias("nation"))
    return c.select(k.alias("doc_id"), gt.alias("gt"), pred.alias("pred"))


def _customer_long(spark, d):
    return flat.compare_flat(customer_pairs(spark, d), CUSTOMER)


@query(f"WITH {CUSTOMER_LONG} SELECT path, {SUMS} FROM o GROUP BY path")
def nested_struct(spark, d):
    """Counts of customers with a nested nation; details only where both sides have one."""
    return metrics.bulk(_customer_long(spark, d))


ROLLED_UP = f"WITH {CUSTOMER_LONG}, up AS (SELECT path, {', '.join(COUNTS)} FROM o WHERE leaf UNION ALL SELECT 'nation', {', '.join(COUNTS)} FROM o WHERE path LIKE 'nation.%' UNION ALL SELECT '', {', '.join(COUNTS)} FROM o WHERE leaf) SELECT path, {SUMS} FROM up GROUP BY path"


@query(ROLLED_UP)
def aggregate_rollup(spark, d):
    """Leaf counts rolled up to every node and summed over documents; a record missing on a side counts itself."""
    return metrics.bulk(metrics.roll_up(_customer_long(spark, d)))


@query("SELECT '' AS path, CAST(sum(CASE WHEN props LIKE '%\"k\":%' THEN 1 ELSE 0 END) AS BIGINT) AS fa, CAST(sum(CASE WHEN props LIKE '%\"k\":%' THEN 1 ELSE 0 END) AS BIGINT) AS fp FROM events")
def hallucinated_fa(spark, d):
    """Undeclared keys of JSON predictions are false alarms of their documents."""
    model = ModelSpec("Event", [FieldSpec("page", "str", optional=True)])
    e = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.lit("{}").alias("expected"), F.col("props").alias("predicted"))
    return metrics.bulk(compare.compare_documents(e, model)).where("path = ''").select("path", "fa", "fp")


# ---------------------------------------------------------------- lists

def _flags(spark, d):
    """Each order's return flags, and a prediction that loses some and changes others."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("a"), F.expr("CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN 'Q' ELSE lower(l_returnflag) END").alias("b"))
    return items.groupBy("doc_id").agg(F.struct(F.collect_list("a").alias("flags")).alias("gt"), F.struct(F.collect_list("b").alias("flags")).alias("pred"))


FLAGS = ModelSpec("Flags", [FieldSpec("flags", "list:str", Exact(), 1.0)])
FLAGS_SQL = """i AS (SELECT l_orderkey AS doc_id, l_returnflag AS a, CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN 'Q' ELSE l_returnflag END AS b FROM lineitem),
k AS (SELECT doc_id, v, sum(x) AS x, sum(y) AS y FROM (SELECT doc_id, a AS v, 1 AS x, 0 AS y FROM i UNION ALL SELECT doc_id, b, 0, 1 FROM i WHERE b IS NOT NULL) GROUP BY doc_id, v),
c AS (SELECT doc_id, sum(least(x, y)) AS common, sum(x) AS n, sum(y) AS m FROM k GROUP BY doc_id),
r AS (SELECT *, CASE WHEN n = 1 AND m = 1 AND common = 0 THEN 0 ELSE least(n, m) END AS pairs FROM c)"""


@query(f"WITH {FLAGS_SQL} SELECT doc_id, CAST(common AS BIGINT) AS tp, CAST(pairs - common AS BIGINT) AS fd, CAST(m - pairs AS BIGINT) AS fa, CAST(n - pairs AS BIGINT) AS fn, round(CASE WHEN m = 0 THEN 0 ELSE common / greatest(n, m) END, 6) AS score FROM r")
def list_exact_match(spark, d):
    """Optimal matching of lists under equality, in closed form."""
    return r6(flat.compare_flat(_flags(spark, d), FLAGS).select("doc_id", "tp", "fd", "fa", "fn", F.col("raw").alias("score")))


@query(f"WITH {FLAGS_SQL} SELECT CAST(n - m AS BIGINT) AS missing, count(*) AS documents, round(avg(CASE WHEN m = 0 THEN 0 ELSE common / greatest(n, m) END), 6) AS mean_score FROM r GROUP BY 1")
def list_score_coverage(spark, d):
    rows = flat.compare_flat(_flags(spark, d), FLAGS)
    n, m = F.col("tp") + F.col("fd") + F.col("fn"), F.col("tp") + F.col("fd") + F.col("fa")
    return r6(rows.groupBy((n - m).alias("missing")).agg(F.count("*").alias("documents"), F.avg("raw").alias("mean_score")))


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'tn' WHEN 1 THEN 'fa' WHEN 2 THEN 'fn' ELSE 'tp' END AS outcome, CAST(CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 2 END AS BIGINT) AS n FROM orders")
def list_null_cases(spark, d):
    """Lists that are null or empty on either side."""
    k = F.col("o_orderkey") % 4
    full, none, empty = F.array(F.lit("a"), F.lit("b")), F.lit(None).cast("array<string>"), F.array().cast("array<string>")
    pairs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.struct(F.when(k == 0, none).when(k == 1, empty).otherwise(full).alias("flags")).alias("gt"), F.struct(F.when(k == 0, empty).when(k == 2, none).otherwise(full).alias("flags")).alias("pred"))
    rows = flat.compare_flat(pairs, FLAGS)
    kind = F.when(F.col("tn") > 0, "tn").when(F.col("fa") > 0, "fa").when(F.col("fn") > 0, "fn").otherwise("tp")
    return rows.select("doc_id", kind.alias("outcome"), F.greatest("tn", "fa", "fn", "tp").alias("n"))


def _item_lists(spark, d):
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), F.concat_ws(" ", F.lit("part"), "l_partkey").alias("name"))
    changed = F.struct(F.col("l_linenumber").alias("line"), F.when(F.col("l_partkey") % 5 == 0, "Q").otherwise(F.col("l_returnflag")).alias("flag"), F.when(F.col("l_partkey") % 7 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("quantity"), F.concat_ws(" ", F.lit("Part"), "l_partkey").alias("name"))
    each = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), item.alias("a"), F.when(F.col("l_linenumber") % 5 != 0, changed).alias("b"))
    return each.groupBy("doc_id").agg(F.sort_array(F.collect_list("a")).alias("gt"), F.sort_array(F.collect_list("b"), asc=False).alias("pred"))


ITEM_FIELDS = [("flag", C.exact, 1.0), ("quantity", C.equal_numbers("float"), 1.0), ("name", C.levenshtein, 2.0)]


ITEM = ModelSpec("Item", [FieldSpec("flag", "str", Exact(), 1.0), FieldSpec("quantity", "float", Numeric(), 1.0), FieldSpec("name", "str", Levenshtein(), 0.9, weight=2.0)], match_threshold=0.8)
PURCHASE = ModelSpec("Purchase", [FieldSpec("key", "int", Exact(), 1.0), FieldSpec("items", "list", model=ITEM, weight=2.0)], match_threshold=0.7)
BUYER = ModelSpec("Buyer", [FieldSpec("segment", "str", Exact(), 1.0), FieldSpec("orders", "list", model=PURCHASE)])


@query("SELECT '' AS path, CAST(0 AS BIGINT) AS tp, CAST(sum(CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM orders")
def error_counts(spark, d):
    """Documents that can't be read add one false negative each to the totals."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 19 == 0, "{broken").otherwise("{}").alias("expected"), F.lit("{}").alias("predicted"))
    long = compare.compare_documents(o, ModelSpec("Empty", [FieldSpec("x", "str", optional=True)]))
    totals = metrics.bulk(long.where("error is null"))
    return metrics.count_errors(totals, long).where("path = ''").select("path", "tp", "fn")


# ---------------------------------------------------------------- ANLS

def anls_sql(a: str, b: str) -> str:
    s = lev_sql(a, b)
    return f"(CASE WHEN {a} IS NULL THEN CASE WHEN {b} IS NULL OR {b} = '' THEN 1.0 ELSE 0.0 END WHEN {b} IS NULL THEN 0.0 WHEN {s} < 0.5 THEN 0.0 ELSE {s} END)"


@query(f"SELECT o_orderkey AS doc_id, round(({anls_sql('a', 'b')} + {anls_sql('o_orderstatus', 's')}) / 2, 6) AS score FROM (SELECT *, o_orderpriority AS a, {GUESS['priority']} AS b, {GUESS['status']} AS s FROM orders)")
def anls_flat(spark, d):
    o = table(spark, d, "orders")
    return r6(o.select(F.col("o_orderkey").alias("doc_id"), anls.anls_flat([(F.col("o_orderpriority"), F.expr(GUESS["priority"])), (F.col("o_orderstatus"), F.expr(GUESS["status"]))]).alias("score")))


@query(f"SELECT p_partkey, round(greatest({anls_sql('p_name', 'other')}, {anls_sql('p_type', 'other')}), 6) AS score FROM (SELECT a.p_partkey, a.p_name, a.p_type, b.p_name AS other FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)")
def anls_options(spark, d):
    """The best of two accepted answers."""
    part = table(spark, d, "part")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return r6(part.join(after, "p_partkey").select("p_partkey", anls.anls_options(F.array("p_name", "p_type"), F.col("other")).alias("score")))


def _anls_orders(spark, d):
    both = _item_lists(spark, d).select("doc_id", F.to_json(F.struct(F.col("gt").alias("items"))).alias("a"), F.to_json(F.struct(F.col("pred").alias("items"))).alias("b"))
    return both.select("doc_id", anls.anls_json_score(F.col("a"), F.col("b")).alias("score"))


@query(f"SELECT 'priority' AS path, round(avg({anls_sql('o_orderpriority', 'b')}), 6) AS score, count(*) AS n FROM (SELECT *, {GUESS['priority']} AS b FROM orders)")
def key_score_mean(spark, d):
    o = table(spark, d, "orders").select(F.to_json(F.struct(F.col("o_orderpriority").alias("priority"))).alias("a"), F.to_json(F.struct(F.expr(GUESS["priority"]).alias("priority"))).alias("b"))
    return r6(anls.key_score_means(o.select(anls.anls_json(F.col("a"), F.col("b")).alias("r")).select("r.keys")))


# ---------------------------------------------------------------- packets

TURNS = "SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'other' ELSE role END AS guess, turn // 2 AS g, CASE WHEN conv_id % 3 = 0 THEN turn // 3 ELSE turn // 2 END AS h, CASE WHEN conv_id % 4 = 0 THEN 100 - turn WHEN conv_id % 4 = 1 THEN turn // 2 ELSE turn END AS q FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)"


def _turns(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", "role").distinct()
    return t.select(
        F.col("conv_id").alias("packet_id"), F.col("turn").alias("page"), F.concat_ws("-", "conv_id", "turn", "role").alias("row_id"),
        F.col("role").alias("class_label"), F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, "other").otherwise(F.col("role")).alias("class_label_predicted"),
        F.expr("cast(turn div 2 as string)").alias("group_id"), F.expr("cast(case when conv_id % 3 = 0 then turn div 3 else turn div 2 end as string)").alias("group_id_predicted"),
        F.col("turn").alias("page_number"), F.expr("case when conv_id % 4 = 0 then 100 - turn when conv_id % 4 = 1 then turn div 2 else turn end").alias("page_number_predicted"))


def _sections(spark, d):
    t = _turns(spark, d)

    def side(group: str, label: str) -> DataFrame:
        each = t.groupBy("packet_id", group).agg(F.array_sort(F.collect_list(F.col("page").cast("int"))).alias("page_indices"), F.min(label).alias("document_class"))
        return each.select("packet_id", F.col(group).cast("int").alias("ord"), F.col(group).alias("section_id"), "document_class", F.when((F.col("packet_id") % 5 == 0) & F.lit(label != "class_label"), F.reverse("page_indices")).otherwise(F.col("page_indices")).alias("page_indices"))

    return packet.sections(side("group_id", "class_label"), "gt"), packet.sections(side("group_id_predicted", "class_label_predicted"), "pred")


SECTIONS = f"t AS ({TURNS}), a AS (SELECT conv_id, g AS ord, list(turn ORDER BY turn) AS pages, min(role) AS cls FROM t GROUP BY ALL), b AS (SELECT conv_id, h AS ord, CASE WHEN conv_id % 5 = 0 THEN list_reverse(list(turn ORDER BY turn)) ELSE list(turn ORDER BY turn) END AS pages, min(guess) AS cls FROM t GROUP BY conv_id, h)"


@query(f"WITH {SECTIONS}, pa AS (SELECT conv_id, p, arg_max(cls, ord) AS x FROM (SELECT conv_id, ord, cls, unnest(pages) AS p FROM a) GROUP BY ALL), pb AS (SELECT conv_id, p, arg_max(cls, ord) AS y FROM (SELECT conv_id, ord, cls, unnest(pages) AS p FROM b) GROUP BY ALL) SELECT conv_id AS packet_id, round(avg(CASE WHEN coalesce(x, 'Missing') = coalesce(y, 'Missing') THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS total_pages FROM pa FULL OUTER JOIN pb USING (conv_id, p) GROUP BY conv_id")
def page_accuracy(spark, d):
    return r6(packet.page_accuracy(*_sections(spark, d)).select("packet_id", "accuracy", "total_pages"))


@query(f"WITH {SECTIONS} SELECT conv_id AS packet_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.conv_id = a.conv_id AND b.cls = a.cls AND list_sort(list_distinct(b.pages)) = list_sort(list_distinct(a.pages))) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM a GROUP BY conv_id")
def split_accuracy_unordered(spark, d):
    return r6(packet.split_accuracy(*_sections(spark, d)).select("packet_id", "accuracy"))


@query(f"WITH {SECTIONS} SELECT conv_id AS packet_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.conv_id = a.conv_id AND b.cls = a.cls AND b.pages = a.pages) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM a GROUP BY conv_id")
def split_accuracy_ordered(spark, d):
    return r6(packet.split_accuracy(*_sections(spark, d), ordered=True).select("packet_id", "accuracy"))


def _cluster_sql(guess: str) -> str:
    return f"""t AS ({TURNS}), u AS (SELECT *, {guess} AS k FROM t), n AS (SELECT conv_id, g, k, count(*)::DOUBLE AS n FROM u GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, g) AS a, sum(n) OVER (PARTITION BY conv_id, k) AS b, sum(n) OVER (PARTITION BY conv_id) AS t FROM n),
e AS (SELECT conv_id, -sum(n / t * ln(a / t)) AS hc, -sum(n / t * ln(b / t)) AS hk, -sum(n / t * ln(n / b)) AS hck, -sum(n / t * ln(n / a)) AS hkc, sum(n * (n - 1) / 2) AS pn, sum(n / a * a * (a - 1) / 2) AS pa, sum(n / b * b * (b - 1) / 2) AS pb, max(t) AS t FROM w GROUP BY conv_id),
s AS (SELECT *, CASE WHEN abs(hc) < 1e-12 THEN 1.0 ELSE 1 - hck / hc END AS ho, CASE WHEN abs(hk) < 1e-12 THEN 1.0 ELSE 1 - hkc / hk END AS co FROM e),
m AS (SELECT conv_id, CASE WHEN ho + co <= 1e-12 THEN 0.0 ELSE 2 * ho * co / (ho + co) END AS v, CASE WHEN t < 2 THEN 1.0 ELSE (t * (t - 1) / 2 + 2 * pn - pa - pb) / (t * (t - 1) / 2) END AS r FROM s)"""


@query(f"WITH {_cluster_sql('h')} SELECT conv_id AS packet_id, round(v, 6) AS v_measure FROM m")
def packet_v_measure(spark, d):
    return r6(packet.clustering(_turns(spark, d)).select("packet_id", "v_measure"))


@query(f"WITH {_cluster_sql('h')} SELECT conv_id AS packet_id, round(r, 6) AS rand_index FROM m")
def packet_rand_index(spark, d):
    return r6(packet.clustering(_turns(spark, d)).select("packet_id", "rand_index"))


STRICT = "CASE WHEN role <> guess THEN 'ERROR_ROW_' || conv_id || '-' || turn || '-' || role ELSE CAST(h AS VARCHAR) END"


@query(f"WITH {_cluster_sql(STRICT)} SELECT conv_id AS packet_id, round(v, 6) AS v_measure, round(r, 6) AS rand_index, round(0.5 * v + 0.5 * r, 6) AS clustering_score FROM m")
def packet_strict(spark, d):
    """Clustering with each misclassified page in a group of its own."""
    return r6(packet.clustering(packet.strict_groups(_turns(spark, d))))


TAU = "p AS (SELECT x.conv_id, x.g, count(*) AS n0, sum(sign(x.turn - y.turn) * sign(x.q - y.q)) AS s, sum(CASE WHEN x.turn = y.turn THEN 1 ELSE 0 END) AS tx, sum(CASE WHEN x.q = y.q THEN 1 ELSE 0 END) AS ty FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn, role) AS id FROM t) x JOIN (SELECT *, row_number() OVER (ORDER BY conv_id, turn, role) AS id FROM t) y ON x.conv_id = y.conv_id AND x.g = y.g AND x.id < y.id GROUP BY ALL), tau AS (SELECT gr.conv_id, gr.g, CASE WHEN gr.c <= 1 THEN 1.0 ELSE coalesce(s / nullif(sqrt((n0 - tx) * (n0 - ty)), 0), 0) END AS k FROM (SELECT conv_id, g, count(*) AS c FROM t GROUP BY ALL) gr LEFT JOIN p USING (conv_id, g))"


@query(f"WITH t AS ({TURNS}), {TAU} SELECT conv_id AS packet_id, CAST(g AS VARCHAR) AS group_id, round(k, 6) AS kendall_tau FROM tau")
def packet_kendall(spark, d):
    return r6(packet.ordering(_turns(spark, d)))


@query(f"WITH {_cluster_sql(STRICT)}, {TAU}, o AS (SELECT conv_id, avg(k) AS o FROM tau GROUP BY conv_id) SELECT conv_id AS packet_id, round(0.5 * v + 0.5 * r, 6) AS clustering_score, round(o, 6) AS ordering_score, round(0.5 * (0.5 * v + 0.5 * r) + 0.5 * o, 6) AS final_score FROM m JOIN o USING (conv_id)")
def packet_score(spark, d):
    return r6(packet.evaluate_packets(_turns(spark, d)).select("packet_id", "clustering_score", "ordering_score", "final_score"))


# ---------------------------------------------------------------- confidence, streams

@query("WITH r AS (SELECT quality = 1 AS hit, doc_id * 37 % 101 + quality * 20 AS c FROM labels), g AS (SELECT c, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS p, sum(CASE WHEN hit THEN 0 ELSE 1 END) AS n FROM r GROUP BY c), w AS (SELECT p, n, p * (coalesce(sum(n) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2.0) AS won FROM g) SELECT round(sum(won) / (sum(p) * sum(n)), 6) AS auroc FROM w")
def auroc(spark, d):
    """Confidence against match; the confidence is a rule on the document's id."""
    rows = table(spark, d, "labels").select((F.col("quality") == 1).alias("match"), F.expr("cast(doc_id * 37 % 101 + quality * 20 as int)").alias("confidence"))
    return r6(metrics.auroc(rows))


@query("SELECT event_type AS path, CAST(sum(CASE WHEN value >= 20 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN value < 20 THEN 1 ELSE 0 END) AS BIGINT) AS fd FROM events GROUP BY 1")
def stream_bulk_metrics(spark, d):
    """The events as a stream: counts of every path, kept up to date in complete mode."""
    import uuid

    from ..streaming import bulk as streams

    name = "bulk_" + uuid.uuid4().hex
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    hit = (F.col("value") >= 20).cast("long")
    long = events.select(F.col("event_type").alias("path"), hit.alias("tp"), (1 - hit).alias("fd"), (1 - hit).alias("fp"), *[F.lit(0).cast("long").alias(c) for c in ("fa", "tn", "fn")])
    stream = streams.start(streams.running_totals(long), name, f"{shared_folder(spark)}/{name}")
    stream.awaitTermination()
    return spark.table(name).select("path", "tp", "fd")
