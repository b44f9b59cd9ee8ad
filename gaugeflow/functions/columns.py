"""Comparators and null predicates as Catalyst expressions.

Each comparator is a function of two columns that gives a similarity from 0
to 1 and never null. They run inside whole-stage code generation; only the
fuzzy ratios, which Spark lacks, start a Python worker.
"""

from __future__ import annotations

import string
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import Fuzzy, batch_scores

# ASCII punctuation and white space, which the exact comparator ignores.
IGNORED = string.punctuation + string.whitespace


# ------------------------------------------------------------ null predicates

def is_empty_value(x: Column) -> Column:
    """Null or the empty string: what a scalar field counts as missing."""
    return x.isNull() | (x.cast("string") == "")


def is_empty_list(x: Column) -> Column:
    """Null or an empty array: what a list field counts as missing."""
    return x.isNull() | (F.size(x) == 0)


def is_blank(x: Column) -> Column:
    """Null or only white space: what a scalar inside a matched list element counts as missing."""
    # Ends at the first other character.
    return x.isNull() | ~x.cast("string").rlike(r"(?U)[^\s\x1C-\x1F]")


# ------------------------------------------------------------ text

def py_str(x: Column, kind: str) -> Column:
    """Text of a value as Python's ``str`` gives it, for a column of Spark type ``kind``."""
    if kind in ("double", "float"):
        return _py_float(x.cast("double"))
    if kind == "boolean":
        return F.when(x, "True").when(~x, "False")
    return x.cast("string")


def _py_float(x: Column) -> Column:
    """Shortest text of a double: plain from 1e-4 up to 1e16, with exponent outside."""
    own = x.cast("string")
    size = F.abs(x)
    plain = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    digits = F.regexp_replace(F.regexp_extract(own, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(own, r"E(-?[0-9]+)$", 1).try_cast("int")
    signed = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return (
        F.when(F.isnan(x), "nan")
        .when(x == float("inf"), "inf")
        .when(x == float("-inf"), "-inf")
        .when(x == 0, F.when(own.startswith("-"), "-0.0").otherwise("0.0"))
        # The smallest double, which the JVM writes with two digits.
        .when(size == 5e-324, F.when(x < 0, "-5e-324").otherwise("5e-324"))
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(digits, F.lit("e"), F.when(F.abs(power) > 99, F.concat(F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string"))).otherwise(signed)))
    )


def squeeze(x: Column) -> Column:
    """Trimmed, with each run of Unicode white space, or of the four ASCII separators, as one space."""
    return F.trim(F.regexp_replace(x, r"(?U)[\s\x1C-\x1F]+", " "))


def lowercase(x: Column) -> Column:
    return F.lower(x)


def strip_punctuation_space(x: Column) -> Column:
    return F.translate(x, IGNORED, "")


# ------------------------------------------------------------ comparators

def _nulls(a: Column, b: Column, score: Column) -> Column:
    """1 if both are null, 0 if one is."""
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(score)


def levenshtein(a: Column, b: Column, normalize: bool = True) -> Column:
    """``1 - distance / longer length``; null is the empty text; two empty texts are equal."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    if normalize:
        a, b = F.lower(squeeze(a)), F.lower(squeeze(b))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def exact(a: Column, b: Column, case_sensitive: bool = False) -> Column:
    """Equality without ASCII punctuation and white space."""
    x, y = strip_punctuation_space(a), strip_punctuation_space(b)
    if not case_sensitive:
        x, y = F.lower(x), F.lower(y)
    return _nulls(a, b, (x == y).cast("double"))


def _digits(x: Column) -> Column:
    """A text without what is no part of a number: (n) is negative, other characters than digits, dot and minus go."""
    t = F.trim(x)
    bracketed = t.startswith("(") & t.endswith(")")
    t = F.when(bracketed, F.concat(F.lit("-"), F.regexp_replace(t, r"^\(|\)$", ""))).otherwise(t)
    return F.regexp_replace(t, r"[^0-9.\-]", "")


def number(x: Column) -> Column:
    """The decimal in a text, as far as 28 whole digits and 10 decimals hold it; null if none."""
    return _digits(x).try_cast("decimal(38,10)")


def _exact(value: Column, near: Column) -> Column:
    """A number with 28 whole digits and ten decimals; null if it has more, or is so small that they lose it all."""
    return F.when((near == 0) | (F.abs(near) >= 1e-10), value.try_cast("decimal(38,10)"))


#: A value's number: the same ``key`` for equal numbers of any length, and its size for tolerances.
NUMBER = "struct<key: string, exact: decimal(38,10), whole: decimal(38,0), near: double>"


def decimal_of(x: Column, kind: str = "str") -> Column:
    """The number that a value of a declared type stands for, as ``NUMBER``; null if it stands for none."""
    if kind == "int":
        return F.when(x.isNotNull(), F.struct(x.cast("string").alias("key"), x.try_cast("decimal(38,10)").alias("exact"), x.try_cast("decimal(38,0)").alias("whole"), x.cast("double").alias("near")))
    if kind == "float":
        # Equal doubles have equal shortest texts; the zeros are one number.
        d = x.cast("double")
        return F.when(d.isNotNull(), F.struct(F.when(d == 0, F.lit("0.0")).otherwise(d.cast("string")).alias("key"), _exact(d, d).alias("exact"), F.lit(None).cast("decimal(38,0)").alias("whole"), d.alias("near")))
    t = _digits(x)
    sign = F.when(t.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    whole = F.regexp_replace(F.regexp_extract(t, r"^-?([0-9]*)", 1), "^0+", "")
    rest = F.regexp_replace(F.regexp_extract(t, r"\.([0-9]*)$", 1), "0+$", "")
    plain = F.concat(whole, F.lit("."), rest)
    key = F.when(plain == ".", F.lit(".")).otherwise(F.concat(sign, plain))
    sound = t.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$")
    return F.when(sound, F.struct(key.alias("key"), _exact(t, t.try_cast("double")).alias("exact"), F.when(rest == "", t.try_cast("decimal(38,0)")).alias("whole"), t.try_cast("double").alias("near")))


def close(x: Column, y: Column, relative: float = 0.0, absolute: float = 0.0) -> Column:
    """1 if two numbers agree within a tolerance, else 0; null agrees with nothing.

    Without a tolerance all digits count. The relative tolerance is of ``x``;
    where ``x`` is zero it bounds ``y`` itself and the absolute one is not
    consulted. Tolerances are of decimals where both numbers fit, else of
    doubles.
    """
    near = x["key"] == y["key"]
    if absolute > 0 or relative > 0:
        both = {k: x[k].isNotNull() & y[k].isNotNull() for k in ("exact", "whole")}

        def by_kind(test) -> Column:
            """The test on decimals that hold both numbers, else on doubles."""
            return F.when(both["exact"], test(x["exact"], y["exact"])).when(both["whole"], test(x["whole"], y["whole"])).otherwise(test(x["near"], y["near"]))

        equal = near
        if absolute > 0:
            near = near | by_kind(lambda a, b: F.abs(a - b) <= F.lit(absolute))
        if relative > 0:
            part = by_kind(lambda a, b: F.abs(a - b) <= F.abs(a) * F.lit(relative))
            near = F.when((x["near"] == 0) & ~equal, by_kind(lambda a, b: F.abs(b) <= F.lit(relative))).otherwise(near | part)
    return F.coalesce(near.cast("double"), F.lit(0.0))


def numeric(a: Column, b: Column, relative: float = 0.0, absolute: float = 0.0, kind: str = "str") -> Column:
    """Agreement of two numbers, or of texts that hold numbers."""
    return _nulls(a, b, close(decimal_of(a, kind), decimal_of(b, kind), relative, absolute))


def fuzzy(a: Column, b: Column, method: str = "ratio", normalize: bool = True) -> Column:
    """A fuzzy ratio of two texts, in Arrow batches; each distinct pair of a batch is compared once."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(batch_scores(Fuzzy(method=method, normalize=normalize), x, y))

    return score(a, b)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 if one is null, empty or zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def binary(score: Column, threshold: float) -> Column:
    """(tp, fp): (1, 0) if the score reaches the threshold."""
    hit = score >= F.lit(threshold)
    return F.struct(F.when(hit, 1).otherwise(0).alias("tp"), F.when(hit, 0).otherwise(1).alias("fp"))


# ------------------------------------------------------------ comparators in two parts

def _keyed(x: Column, key: Column) -> Column:
    return F.struct(x.isNull().alias("none"), key.alias("key"))


def _same_key(x: Column, y: Column) -> Column:
    return F.when(x["none"] & y["none"], 1.0).when(x["none"] | y["none"], 0.0).otherwise(F.coalesce((x["key"] == y["key"]).cast("double"), F.lit(0.0)))


def equal_numbers(kind: str = "str") -> Callable[[Column, Column], Column]:
    """``numeric`` without a tolerance, for values of one declared type."""

    def compare(a: Column, b: Column) -> Column:
        return numeric(a, b, kind=kind)

    compare.parts = (lambda x: _keyed(x, decimal_of(x, kind)["key"]), _same_key)
    return compare


#: What depends on one value, made once for each element of a list, and the comparison of two such values.
levenshtein.parts = (lambda x: F.lower(squeeze(F.coalesce(x, F.lit("")))), lambda x, y: levenshtein(x, y, normalize=False))
exact.parts = (lambda x: _keyed(x, F.lower(strip_punctuation_space(x))), _same_key)


def parts_of(compare: Callable[[Column, Column], Column]) -> tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]:
    """A comparator's two parts; of one that has none the values themselves and the comparator."""
    return getattr(compare, "parts", (lambda x: x, compare))


# ------------------------------------------------------------ thresholds

def reaches(score: Column, threshold: float | Column) -> Column:
    """Threshold predicate with a tolerance of 1e-10 for rounding."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (score >= t) | (F.abs(score - t) < 1e-10)


def clipped(score: Column, threshold: float, clip: bool) -> Column:
    return F.when(score >= F.lit(float(threshold)), score).otherwise(F.lit(0.0) if clip else score)


def reason(score: Column, threshold: float) -> Column:
    """Why two values match or do not."""
    near_one = F.abs(score - 1.0) <= 1e-9 * F.greatest(F.abs(score), F.lit(1.0))
    t = str(float(threshold)) if not isinstance(threshold, int) else str(threshold)
    return (
        F.when((score >= F.lit(float(threshold))) & near_one, "exact match")
        .when(score >= F.lit(float(threshold)), F.concat(F.lit("above threshold ("), F.format_string("%.3f", score), F.lit(f" >= {t})")))
        .otherwise(F.concat(F.lit("below threshold ("), F.format_string("%.3f", score), F.lit(f" < {t})")))
    )
