"""Metrics over long relations: roll-up, corpus sums, derived metrics, merging, errors.

Everything is an aggregate of the relation ``doc_id, path, is_leaf, counts``;
sums are partial before the shuffle, which moves one row for each path and
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("tp", "fa", "fd", "fp", "tn", "fn")
#: Ranges of confidence that are ordered by themselves.
RANGES = 200


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def derived(df: DataFrame, recall_with_fd: bool = False) -> DataFrame:
    """``df`` with precision, recall, f1 and accuracy of its counts; a zero denominator gives 0."""
    tp, fa, fd, tn, fn = (F.col(c) for c in ("tp", "fa", "fd", "tn", "fn"))
    wrong = fa + fd
    out = df.withColumns({
        "precision": _ratio(tp, tp + wrong),
        "recall": _ratio(tp, tp + fn + fd if recall_with_fd else tp + fn),
        "accuracy": _ratio(tp + tn, tp + tn + wrong + fn),
    })
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def bulk(long: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts of every path summed over documents; the empty path holds the documents' own totals."""
    return long.groupBy(*(keys or []), "path").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])


def roll_up(long: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Aggregate counts of every node: sums over the leaves below it, itself if a leaf.

    A node whose leaves have no counts at all takes the sum of its children's
    own counts. Undeclared keys are in no leaf and so in no aggregate.
    """
    below = long.where("path <> ''").withColumn("parts", F.split("path", r"\."))
    up = below.select(*keys, "is_leaf", *COUNTS, F.size("parts").alias("depth"), F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("n"), "parts")
    up = up.withColumn("ancestor", F.array_join(F.slice("parts", F.lit(1), F.col("n")), "."))
    leaf = [F.sum(F.when(F.col("is_leaf"), F.col(c)).otherwise(0)).alias(c) for c in COUNTS]
    child = [F.sum(F.when(F.col("depth") == F.col("n") + 1, F.col(c)).otherwise(0)).alias(f"c_{c}") for c in COUNTS]
    out = up.groupBy(*keys, "ancestor").agg(*leaf, *child)
    empty = sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0])) == 0
    return out.select(*keys, F.col("ancestor").alias("path"), *[F.when(empty, F.col(f"c_{c}")).otherwise(F.col(c)).cast("long").alias(c) for c in COUNTS])


def leaf_aggregates(long: DataFrame, keys: tuple[str, ...] = ("doc_id",), recall_with_fd: bool = False) -> DataFrame:
    """Sums over all leaves of each document as ``aggregate_tp`` and so on, with the metrics derived from them."""
    sums = long.where("is_leaf and path <> ''").groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])
    names = ("precision", "recall", "f1", "accuracy")
    return derived(sums, recall_with_fd).select(*keys, *[F.col(c).alias(f"aggregate_{c}") for c in COUNTS], *[F.col(c).alias(f"aggregate_{c}") for c in names])


def children(long: DataFrame, parent: str = "") -> DataFrame:
    """The rows of fields directly below ``parent``; those of the record itself for the empty path."""
    path, start = F.col("path"), parent + "." if parent else ""
    rest = F.substring(path, F.lit(len(start) + 1), F.length(path))
    return long.where((path != "") & path.startswith(start) & (rest != "") & ~rest.contains("."))


def merge_states(*states: DataFrame) -> DataFrame:
    """Sum of saved partial results of ``bulk``; the order does not matter."""
    out = states[0].select("path", *COUNTS)
    for more in states[1:]:
        out = out.unionByName(more.select("path", *COUNTS))
    return bulk(out)


def error_counts(long: DataFrame) -> DataFrame:
    """How many documents failed with each type of error."""
    kind = F.regexp_extract("error", "^([^:]*)", 1)
    return long.where("error is not null").groupBy(kind.alias("error_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type")


def count_errors(totals: DataFrame, long: DataFrame, elide_errors: bool = False) -> DataFrame:
    """``totals`` with one false negative for each failed document on the empty path, unless elided."""
    if elide_errors:
        return totals
    failed = long.where("error is not null").agg(F.count("*").alias("fn")).select(F.lit("").alias("path"), *[F.col("fn") if c == "fn" else F.lit(0).cast("long").alias(c) for c in COUNTS])
    return merge_states(totals, failed)


def score_metrics(score: Column, threshold: float = 0.5) -> list[Column]:
    """A score as soft counts: itself right and the rest wrong above the threshold, the other way below."""
    good = score >= F.lit(threshold)
    tp = F.when(good, score).otherwise(F.lit(0.0))
    fp = F.when(good, 1 - score).otherwise(score)
    fn = F.when(good, F.lit(0.0)).otherwise(1 - score)
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"), _ratio(tp, tp + fp + fn).alias("accuracy")]


def non_match_summary(rows: DataFrame, by: str = "type") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def filter_non_matches(rows: DataFrame, *types: str) -> DataFrame:
    return rows.where(F.col("type").isin(*types))


def auroc(rows: DataFrame, confidence: str = "confidence", match: str = "match", keys: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve of confidence against match; 0.5 without both outcomes or without confidences.

    Equal confidences are counted first, so what is ordered is one row for
    each distinct value; wins of each are the misses below it and half of
    those beside it. The values are dealt over ranges between ``RANGES``
    quantiles, which are ordered by themselves, and each range adds the misses
    of the ranges before it, so no task orders all values.
    """
    from pyspark.sql import Window

    held = rows.where(F.col(confidence).isNotNull())
    steps = held.groupBy(*keys, confidence).agg(F.sum(F.col(match).cast("long")).alias("hit"), F.count("*").alias("all"))
    steps = steps.withColumn("miss", F.col("all") - F.col("hit"))
    bounds = held.agg(F.percentile_approx(confidence, [k / RANGES for k in range(1, RANGES)])).first()[0] or []
    steps = steps.withColumn("range", F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b < F.col(confidence))) if bounds else F.lit(0))
    earlier = Window.partitionBy(*keys or [F.lit(0)]).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # At most RANGES rows for each key.
    ranges = steps.groupBy(*keys, "range").agg(F.sum("miss").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(earlier), F.lit(0))).drop("m")
    before = Window.partitionBy(*keys, "range").orderBy(confidence).rowsBetween(Window.unboundedPreceding, -1)
    inside = steps.withColumn("below", F.coalesce(F.sum("miss").over(before), F.lit(0))).join(ranges, [*keys, "range"])
    won = F.col("hit") * (F.col("base") + F.col("below") + F.col("miss") / 2)
    total = inside.withColumn("won", won).groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("hit").alias("hit"), F.sum("miss").alias("miss"))
    return total.select(*keys, F.coalesce(F.try_divide(F.col("won"), (F.col("hit") * F.col("miss")).cast("double")), F.lit(0.5)).alias("auroc"))
