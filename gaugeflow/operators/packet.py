"""Document-packet splitting metrics: sections and page groups, keyed by packet.

All of it is joins, windows inside a packet and aggregates. ``keys`` are the
packet's columns; a packet is one document scan, so its groups are small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..functions.ranks import agreement

MISSING = "Missing"
KEYS = ("packet_id",)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# ---------------------------------------------------------------- sections

def sections(df: DataFrame, side: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Sections with ord, section_id, document_class and page_indices, from flat or nested columns.

    ``df`` has an ``ord`` column for the order of sections. The class may be
    a text or a struct with ``type``; pages may be ``page_indices`` or
    ``split_document.page_indices``; missing ids become ``<side>_<ord>``.
    """
    kinds = dict(df.dtypes)
    own = F.col("document_class.type") if kinds["document_class"].startswith("struct") else F.col("document_class")
    pages = [F.col(c) for c in ("page_indices",) if c in kinds] + [F.col("split_document.page_indices") for _ in [0] if "split_document" in kinds]
    found = F.coalesce(*pages, F.array()).cast("array<int>")
    name = F.col("section_id") if "section_id" in kinds else F.lit(None)
    return df.select(*keys, "ord", F.coalesce(name.cast("string"), F.concat(F.lit(f"{side}_"), F.col("ord"))).alias("section_id"), own.alias("document_class"), found.alias("page_indices"))


def page_details(gt: DataFrame, pred: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row for each page of either side; of sections that share a page, the last one's class counts."""

    def classes(df: DataFrame, name: str) -> DataFrame:
        each = df.select(*keys, "ord", "document_class", F.explode("page_indices").alias("page_index"))
        return each.groupBy(*keys, "page_index").agg(F.max_by("document_class", "ord").alias(name))

    both = classes(gt, "ground_truth_class").join(classes(pred, "predicted_class"), [*keys, "page_index"], "full_outer")
    both = both.withColumns({c: F.coalesce(c, F.lit(MISSING)) for c in ("ground_truth_class", "predicted_class")})
    return both.withColumn("correct", F.col("ground_truth_class") == F.col("predicted_class"))


def page_accuracy(gt: DataFrame, pred: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    pages = page_details(gt, pred, keys)
    return pages.groupBy(*keys).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count("*").alias("total_pages"), F.sum(F.col("correct").cast("long")).alias("correct_pages"))


def _page_set(x: Column) -> Column:
    return F.array_sort(F.array_distinct(x))


def split_details(gt: DataFrame, pred: DataFrame, ordered: bool = False, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """For each true section, whether a predicted one has its class and pages; in order too, if ``ordered``.

    ``matched_id``: the first exact match, else with ``ordered`` the last one
    with the same pages in another order.
    """
    a = gt.select(*keys, "ord", "section_id", "document_class", "page_indices", _page_set(F.col("page_indices")).alias("pages"))
    b = pred.select(*keys, F.col("ord").alias("p_ord"), F.col("section_id").alias("p_id"), "document_class", F.col("page_indices").alias("p_pages"), _page_set(F.col("page_indices")).alias("pages"))
    met = a.join(b, [*keys, "document_class", "pages"], "left")
    same = F.col("p_pages") == F.col("page_indices")
    found = met.groupBy(*keys, "ord", "section_id", "document_class").agg(
        F.count("p_ord").alias("n_sets"),
        F.count(F.when(same, True)).alias("n_exact"),
        F.min_by("p_id", F.when(same, F.col("p_ord"))).alias("exact_id"),
        F.min_by("p_id", "p_ord").alias("first_id"),
        F.max_by("p_id", "p_ord").alias("last_id"),
    )
    if not ordered:
        return found.select(*keys, "ord", "section_id", "document_class", (F.col("n_sets") > 0).alias("matched"), F.col("first_id").alias("matched_id"))
    return found.select(*keys, "ord", "section_id", "document_class", (F.col("n_exact") > 0).alias("matched"), F.when(F.col("n_exact") > 0, F.col("exact_id")).otherwise(F.col("last_id")).alias("matched_id"), F.when(F.col("n_sets") > 0, F.col("n_exact") > 0).alias("order_matched"))


def split_accuracy(gt: DataFrame, pred: DataFrame, ordered: bool = False, keys: tuple[str, ...] = KEYS) -> DataFrame:
    each = split_details(gt, pred, ordered, keys)
    return each.groupBy(*keys).agg(F.avg(F.col("matched").cast("double")).alias("accuracy"), F.count("*").alias("total_sections"), F.sum(F.col("matched").cast("long")).alias("correct_sections"))


def unmatched_predictions(gt: DataFrame, pred: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Predicted sections that no true section has in class and pages."""
    a = gt.select(*keys, "document_class", _page_set(F.col("page_indices")).alias("pages")).distinct()
    b = pred.withColumn("pages", _page_set(F.col("page_indices")))
    return b.join(a, [*keys, "document_class", "pages"], "left_anti").drop("pages")


# ---------------------------------------------------------------- page groups

def strict_groups(pages: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Pages with a wrong class get a predicted group of their own."""
    wrong = ~F.col("class_label").eqNullSafe(F.col("class_label_predicted"))
    return pages.withColumn("group_id_predicted", F.when(wrong, F.concat(F.lit("ERROR_ROW_"), F.col(row_id))).otherwise(F.col("group_id_predicted")))


def clustering(pages: DataFrame, weight: float = 0.5, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """V-measure, Rand index and their weighted mean for each packet."""
    if not 0 <= weight <= 1:
        raise ValueError(f"weight {weight} is not in [0, 1]")
    cell = pages.groupBy(*keys, "group_id", "group_id_predicted").agg(F.count("*").cast("double").alias("n"))
    a, b, p = (Window.partitionBy(*keys, *c) for c in (("group_id",), ("group_id_predicted",), ()))
    cell = cell.withColumns({"a": F.sum("n").over(a), "b": F.sum("n").over(b), "t": F.sum("n").over(p)})
    pairs = lambda x: x * (x - 1) / 2
    n, ra, cb, t = F.col("n"), F.col("a"), F.col("b"), F.col("t")
    # A row or column sum is spread over its cells, so that one pass over cells sums rows too.
    out = cell.groupBy(*keys).agg(
        (-F.sum(n / t * F.ln(ra / t))).alias("hc"),
        (-F.sum(n / t * F.ln(cb / t))).alias("hk"),
        (-F.sum(n / t * F.ln(n / cb))).alias("hck"),
        (-F.sum(n / t * F.ln(n / ra))).alias("hkc"),
        F.sum(pairs(n)).alias("pn"),
        F.sum(n / ra * pairs(ra)).alias("pa"),
        F.sum(n / cb * pairs(cb)).alias("pb"),
        F.max("t").alias("t"),
    )
    tiny = 1e-12
    hom = F.when(F.abs(F.col("hc")) < tiny, 1.0).otherwise(1 - F.try_divide("hck", "hc"))
    com = F.when(F.abs(F.col("hk")) < tiny, 1.0).otherwise(1 - F.try_divide("hkc", "hk"))
    out = out.withColumns({"homogeneity": hom, "completeness": com})
    v = F.when(F.col("homogeneity") + F.col("completeness") <= tiny, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / (F.col("homogeneity") + F.col("completeness")))
    total = pairs(t)
    rand = F.when(t < 2, 1.0).otherwise(F.try_divide(total + 2 * F.col("pn") - F.col("pa") - F.col("pb"), total))
    out = out.withColumns({"v_measure": v, "rand_index": rand})
    return out.select(*keys, "v_measure", "rand_index", (F.lit(weight) * F.col("v_measure") + F.lit(1 - weight) * F.col("rand_index")).alias("clustering_score"))


@F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("s", "tx", "ty")]))
def _agreement(points: pa.Array) -> pa.Array:
    """Sums over the pairs of each list of points (x, y); null where a point lacks a coordinate."""
    offsets, held = points.offsets.to_numpy().astype(np.int64), points.values
    x, y = (held.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    absent = np.concatenate([[0], np.cumsum(np.isnan(x) | np.isnan(y))])
    whole = (absent[offsets[1:]] == absent[offsets[:-1]])
    inside = slice(offsets[0], offsets[-1])
    sums = agreement(offsets - offsets[0], np.nan_to_num(x[inside]), np.nan_to_num(y[inside]))
    return pa.StructArray.from_arrays([pa.array(v, pa.float64(), mask=~whole) for v in sums], names=["s", "tx", "ty"])


def ordering(pages: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Kendall's tau-b of page numbers in each true group; 1 for a single page, 0 where it is undefined or a number is missing.

    Disagreeing pairs are counted as inversions, in O(n log^2 n) for a group
    of n pages.
    """
    point = F.struct(F.col("page_number").cast("double").alias("x"), F.col("page_number_predicted").cast("double").alias("y"))
    listed = pages.groupBy(*keys, "group_id").agg(F.collect_list(point).alias("l"))
    tau = listed.withColumn("n", F.size("l").cast("double")).withColumn("sums", _agreement("l"))
    n0 = F.col("n") * (F.col("n") - 1) / 2
    value = F.try_divide(F.col("sums.s"), F.sqrt((n0 - F.col("sums.tx")) * (n0 - F.col("sums.ty"))))
    return tau.select(*keys, "group_id", F.when(F.col("n") <= 1, 1.0).otherwise(F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))).alias("kendall_tau"))


def evaluate_packets(pages: DataFrame, keys: tuple[str, ...] = KEYS, strict: bool = True, weight: float = 0.5, alpha: float = 0.5, beta: float = 0.5, row_id: str = "row_id") -> DataFrame:
    """Final, clustering and ordering scores of each packet."""
    grouped = strict_groups(pages, row_id) if strict else pages
    order = ordering(pages, keys).groupBy(*keys).agg(F.avg("kendall_tau").alias("ordering_score"))
    both = clustering(grouped, weight, keys).join(order, list(keys), "left").withColumn("ordering_score", F.coalesce("ordering_score", F.lit(0.0)))
    return both.withColumn("final_score", F.lit(alpha) * F.col("clustering_score") + F.lit(beta) * F.col("ordering_score"))


def rating(accuracy: float) -> str:
    for least, name in ((0.9, "excellent"), (0.7, "good"), (0.5, "fair")):
        if accuracy >= least:
            return name
    return "poor"


def packet_report(page: float, unordered: float, ordered: float) -> str:
    """Markdown of the three accuracies with 20-character bars."""
    lines = ["# Document split report", "", "| metric | accuracy | | rating |", "|---|---|---|---|"]
    for name, value in (("pages", page), ("sections, any order", unordered), ("sections, in order", ordered)):
        full = round(value * 20)
        lines.append(f"| {name} | {value:.2%} | {'█' * full}{'░' * (20 - full)} | {rating(value)} |")
    return "\n".join(lines)
