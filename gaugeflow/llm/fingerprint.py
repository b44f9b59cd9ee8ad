"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ``k`` smallest distinct hashes of a text's shingles, in
ascending order. The sketch of a whole is the merge of its parts' sketches,
and two sketches estimate resemblance, containment and the number of
distinct shingles. All of it is Spark SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

K = 256
SHINGLE = 5


def words_of(text: Column) -> Column:
    """Lower-cased words between ASCII white space; empty for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch_of_words(words: Column, n: int = SHINGLE, k: int = K) -> Column:
    """Sketch of an array of words; fewer than ``n`` words are one shingle, none have an empty sketch."""
    size = F.size(words)
    rolled = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, n)))
    return F.when(size >= n, bottom(rolled, k)).when(size > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness; exact while the union has at most ``k`` shingles; two empty sketches are alike."""
    both = merge(a, b, k)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(common.cast("double"), F.size(both)), F.lit(0.0)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    top = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.try_divide(F.lit(float(k - 1)), top))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; 0 for an empty ``a``."""
    r = resemblance(a, b, k)
    na, nb = distinct_count(a, k), distinct_count(b, k)
    return F.coalesce(F.least(F.lit(1.0), F.try_divide(r * (na + nb), (1 + r) * na)), F.lit(0.0))


def merge_groups(df: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group: the ``k`` smallest distinct hashes of its parts' sketches.

    The parts are merged in two steps, over 64 salted groups first, so that
    no task gathers the sketches of a very large group.
    """
    step = df.select(*keys, F.explode(column).alias("h"), F.pmod(F.xxhash64(column), F.lit(64)).alias("salt"))
    for own in ([*keys, "salt"], keys):
        few = step.select(*own, "h").distinct().withColumn("r", F.row_number().over(Window.partitionBy(*own).orderBy("h"))).where(F.col("r") <= k)
        step = few.drop("r")
    return step.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(column))


def to_text(sketch: Column) -> Column:
    """A sketch as text: sixteen hexadecimal digits for each hash, in ascending order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def from_text(text: Column) -> Column:
    """The sketch that ``to_text`` wrote."""
    whole = F.regexp_extract_all(text, F.lit("[0-9a-f]{16}"), F.lit(0))
    high = lambda h: F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")
    low = lambda h: F.conv(F.substring(h, 9, 8), 16, 10).cast("bigint")
    return F.transform(whole, lambda h: F.shiftleft(high(h), 32).bitwiseOR(low(h)))


def with_sketch(docs: DataFrame, column: str = "sketch", n: int = SHINGLE, k: int = K) -> DataFrame:
    """``docs`` with the sketch of each whole text; null text has an empty one."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c != column]
    wide = docs.select(F.struct(*keep).alias("row"), words_of(F.col("text").cast("string")).alias("w"))
    return wide.select("row.*", sketch_of_words(F.col("w"), n, k).alias(column))


def range_starts(docs: DataFrame) -> list[int]:
    """The first id of each of a number of ranges of about equal size; few, whatever the number of documents.

    They are the smallest id and approximate quantiles, from one aggregate
    whose state has a bounded size.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col("doc_id").cast("long")
    least, marks = docs.agg(F.min(key), F.percentile_approx(key, [k / ranges for k in range(1, ranges)], max(10_000, 10 * ranges))).first()
    return [] if least is None else sorted({least, *marks})


def range_of(key: Column, starts: list[int]) -> Column:
    """Index of the range that holds ``key``, by binary search in the sorted starts."""
    bounds = F.lit(starts)
    steps = [1 << b for b in range(len(starts).bit_length() - 1, -1, -1)]

    def narrow(at: Column, step: Column) -> Column:
        beyond = at + step
        return F.when((beyond < len(starts)) & (F.get(bounds, beyond) <= key), beyond).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), narrow)


def compare_with_edits(docs: DataFrame, n: int = SHINGLE, k: int = K) -> DataFrame:
    """Each document's sketch against those of its edited text and of the next document.

    Returns doc_id, n_chars, edited, sketch, edited_sketch, near_edited,
    near_next, next_id. In the edited text the last half of the code points
    (rounded down) is replaced by as many of the next document's first ones,
    or all it has. Next is by ascending doc_id, then text where ids repeat,
    and the first follows the last. Null text is empty. A row without doc_id
    has no next document: its edited text keeps the first half only, and it
    is compared with an empty sketch. An empty table gives an empty table.

    Texts are shuffled once, dealt by ranges of ids. The first document of
    each range goes to the range before as well, as its last one's next, so
    nothing but the ranges' first ids is broadcast.
    """
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<bigint>")
    lone = held.where("doc_id is null").select("doc_id", "text", words_of(F.col("text")).alias("w")).select("doc_id", "text", sketch_of_words(F.col("w"), n, k).alias("sketch"), F.struct(F.lit(None).cast("long").alias("id"), F.lit("").alias("text"), none.alias("sketch")).alias("next"))
    starts = range_starts(docs)
    joined = lone
    if starts:
        known = held.where("doc_id is not null").withColumn("at", range_of(F.col("doc_id"), starts))
        before = F.pmod(F.col("at") - 1, F.lit(len(starts))).cast("int")
        places = F.when(F.get(F.lit(starts), F.col("at")) == F.col("doc_id"), F.array(F.struct(F.col("at").alias("bucket"), F.lit(False).alias("guest")), F.struct(before.alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("at").alias("bucket"), F.lit(False).alias("guest"))))
        dealt = known.select("doc_id", "text", F.explode(places).alias("p")).select("p.bucket", "p.guest", "doc_id", "text").repartition("bucket").withColumn("w", words_of(F.col("text")))
        own = dealt.select("bucket", "guest", "doc_id", "text", sketch_of_words(F.col("w"), n, k).alias("sketch"))
        order = Window.partitionBy("bucket").orderBy("guest", "doc_id", "text")
        after = own.withColumn("next", F.lead(F.struct(F.col("doc_id").alias("id"), "text", "sketch")).over(order))
        joined = after.where("not guest").select("doc_id", "text", "sketch", "next").unionByName(lone)
    half = F.floor(F.col("n") / 2).cast("int")
    out = joined.withColumn("n", F.length("text")).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - half), F.substring("next.text", F.lit(1), half)))
    out = out.select("doc_id", F.col("n").cast("long").alias("n_chars"), "edited", words_of(F.col("edited")).alias("ew"), "sketch", F.col("next.id").alias("next_id"), F.col("next.sketch").alias("next_sketch"))
    out = out.select("doc_id", "n_chars", "edited", "sketch", sketch_of_words(F.col("ew"), n, k).alias("edited_sketch"), "next_id", "next_sketch")
    return out.select("doc_id", "n_chars", "edited", "sketch", "edited_sketch", resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"), "next_id")
