"""Secret scanning by a trigram inverted index.

From each rule's regular expression follows a Boolean query: which runs of
three characters a text must hold if the rule is to match, as alternatives of
sets. Texts are indexed by the trigrams that some rule asks for, in lower
case; a rule's candidates are the texts that the intersected postings of one
of its sets leave, and only there does its expression run. Rules without a
mandatory trigram run on every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut


class Rule(NamedTuple):
    """Matches of ``pattern`` of which ``group`` has ``least`` characters or more; shorter ones are dropped once found."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# The rules whose counts are reported one by one.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    # Runs of 24 or more: the same as all runs without the shorter ones, as a match takes a run whole.
    Rule("hex", r"[0-9a-f]{24,}", 24),
]

# Public formats of further credentials.
FURTHER = [
    Rule("pem", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"[a-z]{2,10}://[A-Za-z0-9._~-]+:[^/@\s\"']{3,}@[A-Za-z0-9.-]+"),
]
RULES = [*BASE, *FURTHER]

Query = frozenset[frozenset[str]]

#: The query that every text answers: no mandatory trigram.
ANY: Query = frozenset({frozenset()})
#: Alternatives of a query, strings known of an expression's part, and trigrams of one set; beyond them a query asks for less.
MOST_SETS, MOST_STRINGS, MOST_TERMS = 64, 16, 62


# ---------------------------------------------------------------- queries

class _Known(NamedTuple):
    """What is known of the texts that a part of an expression matches.

    ``exact``: all of them, if few; else each starts with one of ``prefix``,
    ends with one of ``suffix`` and answers ``query``.
    """

    exact: frozenset[str] | None
    prefix: frozenset[str]
    suffix: frozenset[str]
    query: Query


def _least(sets: Iterable[frozenset[str]]) -> Query:
    """Alternatives without those that another one implies."""
    found = sorted(set(sets), key=len)
    return frozenset(s for i, s in enumerate(found) if not any(t <= s for t in found[:i]))


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_SETS:
        return min(a, b, key=len)
    return _least(x | y for x in a for y in b)


def _either(a: Query, b: Query) -> Query:
    found = _least([*a, *b])
    return found if len(found) <= MOST_SETS else ANY


def _holding(strings: Iterable[str]) -> Query:
    """Texts that hold one of the strings."""
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


NOTHING = frozenset({""})
_ONE_OF_MANY = _Known(None, NOTHING, NOTHING, ANY)


def _exactly(strings: Iterable[str]) -> _Known:
    found = frozenset(strings)
    return _Known(found, found, found, ANY)


def _loose(k: _Known) -> _Known:
    """The same without the list of all texts, with the query that the list gives."""
    query = _both(k.query, _both(_holding(k.prefix), _holding(k.suffix)))
    ends = [frozenset(cut(s) for s in own) for own, cut in ((k.prefix, lambda s: s[:2]), (k.suffix, lambda s: s[-2:]))]
    return _Known(None, *[e if len(e) <= MOST_STRINGS else NOTHING for e in ends], query)


def _after(a: _Known, b: _Known) -> _Known:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return _exactly(x + y for x in a.exact for y in b.exact)
    across = _holding(x + y for x in a.suffix for y in b.prefix) if len(a.suffix) * len(b.prefix) <= MOST_STRINGS**2 else ANY
    left, right = _loose(a), _loose(b)
    prefix = frozenset(x + y for x in a.exact for y in right.prefix) if a.exact is not None else left.prefix
    suffix = frozenset(x + y for x in left.suffix for y in b.exact) if b.exact is not None else right.suffix
    return _loose(_Known(None, prefix, suffix, _both(across, _both(left.query, right.query))))


def _or(a: _Known, b: _Known) -> _Known:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST_STRINGS:
        return _exactly(a.exact | b.exact)
    a, b = _loose(a), _loose(b)
    return _Known(None, a.prefix | b.prefix, a.suffix | b.suffix, _either(a.query, b.query))


def _characters(items: list) -> list[str] | None:
    """The characters of a class in lower case, if they are few and plain."""
    found: set[int] = set()
    for kind, value in items:
        if str(kind) == "LITERAL":
            found.add(value)
        elif str(kind) == "RANGE" and value[1] - value[0] < 64:
            found.update(range(value[0], value[1] + 1))
        else:
            return None
    lower = sorted({chr(c).lower() for c in found})
    return lower if len(lower) <= MOST_STRINGS // 2 and all(c < 128 for c in found) else None


def _known(parts) -> _Known:
    out = _exactly([""])
    for kind, value in parts:
        name = str(kind)
        if name == "LITERAL":
            here = _exactly([chr(value).lower()]) if value < 128 else _ONE_OF_MANY
        elif name == "IN":
            few = _characters(value)
            here = _exactly(few) if few else _ONE_OF_MANY
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            here = _exactly([""])
        elif name in ("SUBPATTERN", "ATOMIC_GROUP"):
            here = _known(value[-1] if name == "SUBPATTERN" else value)
        elif name == "BRANCH":
            own = [_known(p) for p in value[1]]
            here = own[0]
            for more in own[1:]:
                here = _or(here, more)
        elif name.endswith("_REPEAT"):
            low, high, inner = value
            one = _known(inner)
            here = _exactly([""])
            for _ in range(min(low, 4)):
                here = _after(here, one)
            if (low, high) == (0, 1):
                here = _or(here, one)
            elif high > min(low, 4):
                # More of the same may lie between the first ones and the end.
                first = _loose(here)
                here = first._replace(suffix=_loose(one).suffix if low else NOTHING, prefix=first.prefix if low else NOTHING)
        else:
            here = _ONE_OF_MANY
        out = _after(out, here)
    return out


def trigram_query(pattern: str) -> Query:
    """Sets of trigrams in lower case: whatever ``pattern`` matches holds all of one set; the empty set asks for nothing."""
    found = _loose(_known(re._parser.parse(pattern))).query
    return _least(frozenset(sorted(s)[:MOST_TERMS]) for s in found)


# ---------------------------------------------------------------- index

def vocabulary(rules: list[Rule]) -> list[str]:
    """The trigrams that the rules ask for."""
    return sorted({t for r in rules for s in trigram_query(r.pattern) for t in s})


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``k``, which names a row by its id and text, and its text without null.

    Rows that share a key share postings, which adds candidates and loses none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(F.col("doc_id"), text, F.length(text)).alias("k"))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, k) for each of the ``trigrams`` that a row of ``keyed`` documents holds in lower case."""
    low = docs.select("k", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams])) if trigrams else F.array().cast("array<string>")
    return low.select("k", F.explode(held).alias("trigram")).select("trigram", "k")


def candidates(spark: SparkSession, posts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(k, rules): the numbers of the rules whose query a document's postings answer.

    The postings of a set are intersected by a bit for each of its trigrams,
    combined before the shuffle. Its side is one row for each term of the
    rules, broadcast while there are at most ``BROADCAST_ROWS``.
    """
    rows = [(no, c, t, 1 << b, (1 << len(s)) - 1) for no, r in enumerate(rules) for c, s in enumerate(sorted(trigram_query(r.pattern), key=sorted)) for b, t in enumerate(sorted(s))]
    terms = spark.createDataFrame(rows, "rule int, part int, trigram string, bit long, need long")
    met = posts.join(F.broadcast(terms) if len(rows) <= BROADCAST_ROWS else terms, "trigram")
    whole = met.groupBy("k", "rule", "part", "need").agg(F.bit_or("bit").alias("have")).where("have = need")
    return whole.groupBy("k").agg(F.collect_set("rule").alias("rules"))


# ---------------------------------------------------------------- matches

def running_sums(x: Column) -> Column:
    """Sums of an array's values up to each; in blocks of about the root of its size, as appending copies."""
    size = F.size(x)
    block = F.ceil(F.sqrt(size)).cast("int")
    start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("a"))
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(size / block).cast("int") - 1), lambda b: F.slice(x, b * block + 1, block))
    within = F.transform(blocks, lambda own: F.aggregate(own, start, lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.concat(acc["a"], F.array(acc["s"] + v)).alias("a"))))
    shifted = F.aggregate(within, F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<array<bigint>>").alias("a")), lambda acc, own: F.struct((acc["s"] + own["s"]).alias("s"), F.concat(acc["a"], F.array(F.transform(own["a"], lambda v: v + acc["s"]))).alias("a")))
    return F.when(size == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(shifted["a"]))


def _long_enough(no: int, least: int) -> Column:
    """The spans of a rule's matches whose group is long enough."""
    placed = F.zip_with(f"~e{no}", f"~w{no}", lambda e, w: F.struct((e - F.length(w)).alias("start"), F.lit(no).alias("rule"), e.alias("end")))
    return F.array_compact(F.zip_with(placed, f"~v{no}", lambda s, n: F.when(n >= least, s)))


def scan_secrets(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id and spans, the matches of all rules: array<struct<start, rule, end>>, by start, then by the rule's place in the list.

    Matches of a rule are leftmost and do not overlap; those whose ``group``
    is shorter than ``least`` are dropped, but what they cover is not looked
    at again. Positions are code points, ``end`` exclusive. Whole texts are
    searched; null is empty. Patterns are those that Python and the JVM read
    alike. Each row has its own result, repeated ones and null ids too; an
    empty table gives an empty one.

    What is shuffled are postings (a few bits for each document and set) and,
    once, the texts, which meet their candidates there; Spark splits a
    partition that repeated rows make large.
    """
    spark = docs.sparkSession
    own = keyed(docs)
    queries = [trigram_query(r.pattern) for r in rules]
    index = cut(postings(own, vocabulary(rules)), "postings")
    met = own.join(candidates(spark, index, rules), "k", "left")
    found = met.select("doc_id", "text", "rules")
    stage: dict[str, Column] = {}
    for no, r in enumerate(rules):
        asked = F.lit(True) if queries[no] == ANY else F.coalesce(F.array_contains("rules", no), F.lit(False))
        every = lambda group, r=r: F.regexp_extract_all("text", F.lit(r.pattern), F.lit(group))
        none = F.array().cast("array<string>")
        stage |= {f"~w{no}": F.when(asked, every(0)).otherwise(none), f"~v{no}": F.when(asked, F.transform(every(r.group), lambda v: F.length(v))).otherwise(F.array().cast("array<int>")), f"~g{no}": F.when(asked, F.split("text", r.pattern, -1)).otherwise(none)}
    found = found.withColumns(stage)
    # Each gap with the match after it; the last gap has none.
    steps = {f"~s{no}": F.transform(F.arrays_zip(F.slice(f"~g{no}", 1, F.size(f"~w{no}")).alias("g"), F.col(f"~w{no}").alias("w")), lambda z: (F.length(z["g"]) + F.length(z["w"])).cast("long")) for no in range(len(rules))}
    found = found.withColumns(steps).withColumns({f"~e{no}": running_sums(F.col(f"~s{no}")) for no in range(len(rules))})
    spans = [_long_enough(no, r.least) for no, r in enumerate(rules)]
    return found.select("doc_id", F.array_sort(F.concat(*spans)).alias("spans"))


def span_text(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rule"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
