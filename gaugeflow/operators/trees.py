"""ANLS* of JSON documents as relations: values as VARIANT, compared level by level without a schema.

Two objects become a row for each key of either side; what is no pair of
objects is settled where it stands. Where an object or a list faces something
else, its leaves are counted by following it down alone. Documents in which
two lists face each other need a matching; their ids come apart, for
``anls.anls_json``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.stored import stored
from .anls import LEAST

MAP, LIST = "map<string, variant>", "array<variant>"


class Trees(NamedTuple):
    """``scores``: doc_id, score; ``keys``: doc_id, path, score of every key; ``others``: ids of documents that need a matching, or can't be read."""

    scores: DataFrame
    keys: DataFrame
    others: DataFrame


def _kind(v: Column, name: Column) -> Column:
    """object, list, null or scalar, from a value and the name of its type."""
    return F.when(v.isNull() | (name == "VOID"), "null").when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "list").otherwise("scalar")


def _text(v: Column, name: Column) -> Column:
    """A scalar's text as the row evaluator has it, in lower case with single spaces."""
    # Whole numbers are BIGINT, or decimals where they are too long for one; other decimals are what JSON wrote with a point.
    whole = name.endswith(",0)") & (F.regexp_extract(name, r"(\d+),", 1).try_cast("int") > 18)
    number = name.isin("DOUBLE", "FLOAT") | (name.startswith("DECIMAL") & ~whole)
    text = F.when(number, C.py_str(F.try_variant_get(v, "$", "double"), "double")).otherwise(F.try_variant_get(v, "$", "string"))
    return F.lower(C.squeeze(text))


def _described(level: DataFrame) -> DataFrame:
    """``level`` with the kinds of its values (ka, kb), the texts of scalars (ta, tb), and whether the prediction is missing: null, "", [] or {}."""
    named = level.withColumns({"na": F.schema_of_variant("a"), "nb": F.schema_of_variant("b")})
    named = named.withColumns({"ka": _kind(F.col("a"), F.col("na")), "kb": _kind(F.col("b"), F.col("nb"))})
    text = lambda v, k, n: F.when(F.col(k) == "scalar", _text(F.col(v), F.col(n)))
    empty = F.when(F.col("kb") == "null", True).when(F.col("kb") == "object", F.col("nb") == "OBJECT<>").when(F.col("kb") == "list", F.size(F.try_variant_get("b", "$", LIST)) == 0).otherwise((F.col("nb") == "STRING") & (F.try_variant_get("b", "$", "string") == ""))
    return named.withColumns({"ta": text("a", "ka", "na"), "tb": text("b", "kb", "nb"), "missing": F.coalesce(empty, F.lit(False))}).drop("na", "nb")


def _leaf(a: Column, b: Column) -> Column:
    score = C.levenshtein(a, b, normalize=False)
    return F.when(score < LEAST, 0.0).otherwise(score)


def compare_trees(pairs: DataFrame, gt: str = "expected", pred: str = "predicted") -> Trees:
    """ANLS* of two JSON texts of each document without lists that face each other.

    ``pairs`` has doc_id and the texts. Scores are those of ``anls.anls_json``:
    a key that one side lacks counts as null there; what scores nothing
    counts with its leaves. A null text is a null value. Rows that repeat an id
    add up, so give each document one of its own. Every level is one pass over what the level
    above left open; there are as many as the deepest document has.
    """
    unread = pairs.where(F.greatest(*[(F.col(c).isNotNull() & F.try_parse_json(F.col(c)).isNull()) for c in (gt, pred)])).select(F.col("doc_id").cast("string").alias("doc_id"))
    side = lambda c: F.try_parse_json(F.col(c))
    level = pairs.select(F.col("doc_id").cast("string").alias("doc_id"), F.array().cast("array<string>").alias("path"), side(gt).alias("a"), side(pred).alias("b"), F.lit(True).alias("known"))
    settled, weights, others = [], [], [unread]
    while True:
        level = stored(_described(level), "level")
        both = (F.col("ka") == "object") & (F.col("kb") == "object")
        # At the top a list beside a text holds alternatives.
        listed = (F.col("ka") == "list") & ((F.col("kb") == "list") | ((F.col("kb") == "scalar") & (F.size("path") == 0)))
        others.append(level.where(listed).select("doc_id"))
        here = level.where(~both)
        score = (
            # A null-like key that the truth lacks scores nothing.
            F.when(F.col("ka") == "null", F.when(F.col("known"), F.col("missing").cast("double")).otherwise(0.0))
            .when((F.col("ka") == "scalar") & (F.col("kb") == "scalar"), _leaf(F.col("ta"), F.col("tb")))
            .otherwise(0.0)
        )
        keyed = F.col("known") | ~F.col("missing")
        settled.append(here.select("doc_id", "path", score.alias("score"), keyed.alias("keyed")))
        # Two objects are a key too, of no weight of their own.
        settled.append(level.where(both).select("doc_id", "path", F.lit(0.0).alias("score"), F.lit(True).alias("keyed")))
        # Of two unlike values the one with more leaves counts; a scalar or null has one.
        weights.append(_leaves(here))
        if level.where(both).isEmpty():
            break
        x, y = (F.try_variant_get(c, "$", MAP) for c in ("a", "b"))
        wide = level.where(both).select("doc_id", "path", x.alias("x"), y.alias("y"))
        # Keys of both sides; the truth's own are marked.
        each = F.map_zip_with("x", "y", lambda k, v, w: F.struct(v.alias("a"), w.alias("b"), F.map_contains_key("x", k).alias("known")))
        level = wide.select("doc_id", "path", F.explode(each).alias("key", "v")).select("doc_id", F.concat("path", F.array("key")).alias("path"), "v.a", "v.b", "v.known")
    rows = _all(settled).join(_all(weights), ["doc_id", "path"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    rows = stored(rows, "terminals")
    needs = stored(_all(others).distinct(), "others")
    sound = rows.join(needs, "doc_id", "left_anti")
    mean = F.coalesce(F.try_divide(F.sum("score"), F.sum("size")), F.lit(1.0)).alias("score")
    scores = sound.groupBy("doc_id").agg(mean)
    # A key's score is over all that lies below it; what is no key itself counts for those above.
    last = F.size("path") - F.when(F.col("keyed"), 0).otherwise(1)
    above = F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda n: F.slice("path", F.lit(1), n)))
    keys = sound.select("doc_id", "score", "size", F.explode(above).alias("p")).groupBy("doc_id", F.array_join("p", ".").alias("path")).agg(mean)
    return Trees(scores, keys, needs)


def _leaves(here: DataFrame) -> DataFrame:
    """(doc_id, path, size): how much each settled value counts in the divisor."""
    single = F.col("ka").isin("scalar", "null") | F.col("kb").isin("scalar", "null")
    own = here.where(single).select("doc_id", "path", F.lit("").alias("side"), F.lit(1).cast("long").alias("n"))
    parts = [own]
    deep = None
    for v, kind, side in (("a", "ka", "a"), ("b", "kb", "b")):
        held = here.where(F.col(kind).isin("object", "list")).select("doc_id", "path", F.lit(side).alias("side"), F.col(v).alias("v"), F.col(kind).alias("k"))
        deep = held if deep is None else deep.unionByName(held)
    while not deep.isEmpty():
        inner = F.when(F.col("k") == "object", F.map_values(F.try_variant_get("v", "$", MAP))).otherwise(F.try_variant_get("v", "$", LIST))
        below = deep.select("doc_id", "path", "side", F.explode(inner).alias("v"))
        below = below.withColumn("name", F.schema_of_variant("v"))
        below = stored(below.withColumn("k", _kind(F.col("v"), F.col("name"))).drop("name"), "below")
        parts.append(below.where(F.col("k").isin("scalar", "null")).select("doc_id", "path", "side", F.lit(1).cast("long").alias("n")))
        deep = below.where(F.col("k").isin("object", "list"))
    sums = _all(parts).groupBy("doc_id", "path", "side").agg(F.sum("n").alias("n"))
    return sums.groupBy("doc_id", "path").agg(F.max("n").alias("size"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
