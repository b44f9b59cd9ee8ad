"""License scanning by diagonal voting.

Every rolling gram of three words is hashed and joined with the grams of all
license templates, which range from phrases to whole license texts. A hit is
verified on the words and votes for the diagonal ``position - template
position``; votes on neighbouring diagonals, where words were added or lost,
are merged into bands whose whole width is bounded, and the words that a
band's hits cover make up its score.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import BROADCAST_ROWS
from .license_texts import TEXTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose every place counts, and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Further templates, which may be matched in part.
FURTHER = [
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("apache license version 2 0", "apache-2.0"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("eclipse public license version 2 0", "epl-2.0"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under cc by nd", "cc-by-nd"),
    ("boost software license version 1 0", "bsl-1.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-grant"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    *TEXTS,
]

#: A further template counts where at least this part of its words is covered.
COVER = 0.85
#: Words of a rolling gram; phrases of two words are met as pairs.
GRAM = 3
#: Diagonals of one match lie within a word for each so many of the template: that many words may be added or lost in all.
DRIFT_WORDS = 16

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; empty for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), "")


def template_words(text: str) -> list[str]:
    """The words of a template, as those of a document."""
    return _WORD.findall(text.translate(str.maketrans(UPPER, LOWER)))


def _templates(spark: SparkSession, phrases: list[list[str]]) -> DataFrame:
    """(h, template, tpos, wa, wb, wc, words, grams, width), with one row that every document's mark joins.

    It has one row for each gram of a fixed list, and is broadcast while it
    has at most ``BROADCAST_ROWS``.
    """
    rows = [(-1, 0, "", "", None, 1, 1, 0)]
    for t, w in enumerate(phrases):
        if len(w) < 2:
            raise ValueError(f"a template has two words or more: {w}")
        g = min(GRAM, len(w))
        n = len(w) - g + 1
        rows += [(t, k, w[k], w[k + 1], w[k + 2] if g == GRAM else None, len(w), n, len(w) // DRIFT_WORDS) for k in range(n)]
    found = spark.createDataFrame(rows, "template int, tpos int, wa string, wb string, wc string, words int, grams int, width int")
    found = found.withColumn("h", F.xxhash64("wa", "wb", "wc"))
    return F.broadcast(found) if len(rows) <= BROADCAST_ROWS else found


def _sorted_labels(index: Column, labels: list[str]) -> Column:
    named = F.transform(index, lambda t: F.element_at(F.array(*[F.lit(x) for x in labels]), t + 1))
    return F.array_join(F.array_sort(F.array_distinct(named)), ",")


def _covered(places: Column, gram: Column) -> Column:
    """How many words the grams at the sorted distinct ``places`` cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + gram - 1)))))


def scan_licenses(docs: DataFrame, base=BASE, further=FURTHER) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``base`` and ``further`` hold (text, label), from two words to whole
    licenses. ``n_base`` counts all places of base phrases, ``first_word``
    and ``last_word`` are their smallest and largest start (null without
    any). A match of a further template lies on diagonals within a
    ``DRIFT_WORDS``-th of its length, so its words are in order but for that
    much; of all such bands the one with the most votes counts, the lowest
    where they are even. ``labels`` adds those of templates of which that band
    covers ``COVER`` of the words. ``score`` is the largest covered part of
    any template, 1 for a base phrase. Null text is empty: no words, no
    labels, score 0. Rows that repeat are scanned together and returned
    each; null doc_id is kept. An empty table gives an empty table.

    Every word's grams are met with the templates within one stage; only hits
    and one mark for each document are shuffled.
    """
    labels = [x for _, x in [*base, *further]]
    phrases = [template_words(t) for t, _ in [*base, *further]]
    pair_heads = sorted({w[0] for w in phrases if len(w) == 2})
    templates = _templates(docs.sparkSession, phrases)
    w, at = F.col("w"), F.col("at")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = docs.select("doc_id", F.xxhash64(text, F.length(text)).alias("th"), words_of(F.col("text").cast("string")).alias("w"))
    placed = held.select("doc_id", "th", "w", F.posexplode_outer("w").alias("at", "word"))
    mark = F.xxhash64(F.lit(""), F.lit(""), F.lit(None).cast("string"))
    second, third = F.get(w, at + 1), F.get(w, at + 2)
    triple, pair = F.when(third.isNotNull(), F.xxhash64("word", second, third)), F.when(second.isNotNull(), F.xxhash64("word", second))
    keys = F.when(F.coalesce(at, F.lit(0)) == 0, F.array(mark, triple, pair)).when(F.col("word").isin(pair_heads), F.array(triple, pair)).otherwise(F.array(triple))
    # A row takes its own three words along, not the document's, so that it stays short where templates are too many to broadcast.
    rolled = placed.select("doc_id", "th", F.size("w").alias("n_words"), "at", "word", second.alias("second"), third.alias("third"), F.explode(keys).alias("h")).where("h is not null")
    same = (F.col("word") == F.col("wa")) & (F.col("second") == F.col("wb")) & (F.col("wc").isNull() | (F.col("third") == F.col("wc")))
    hits = rolled.join(templates, "h").where((F.col("template") < 0) | same)
    hits = hits.select("doc_id", "th", "n_words", "template", "words", "grams", "width", F.when(F.col("template") < 0, F.lit(0)).otherwise(at - F.col("tpos")).alias("diagonal"), "tpos")

    own = ["doc_id", "th", "template"]
    votes = hits.repartition("doc_id", "th").groupBy(*own, "n_words", "words", "grams", "width", "diagonal").agg(F.collect_set("tpos").alias("places"), F.count("*").alias("copies"))
    # A band is as wide as its template allows: diagonals are stretched so that one width fits all.
    stretched = F.col("diagonal") * F.when(F.col("width") > 0, F.floor(F.lit(100_000) / F.col("width"))).otherwise(200_000)
    band = Window.partitionBy(*own).orderBy(stretched).rangeBetween(0, 100_000)
    votes = votes.withColumn("votes", F.sum(F.size("places")).over(band))
    exact = (F.col("template") >= 0) & (F.col("template") < len(base)) & (F.size("places") == F.col("grams"))
    one = votes.groupBy(*own, "words", "grams", "width").agg(
        F.max("n_words").alias("n_words"),
        F.max_by("diagonal", F.struct("votes", -F.col("diagonal"))).alias("start"),
        F.collect_list(F.struct("diagonal", "places")).alias("on"),
        F.sum(exact.cast("long")).alias("places"),
        F.min(F.when(exact, F.col("diagonal"))).alias("first"),
        F.max(F.when(exact, F.col("diagonal"))).alias("last"),
        F.max(F.when(F.col("template") < 0, F.col("copies"))).alias("copies"),
    )
    inside = F.filter("on", lambda x: (x["diagonal"] >= F.col("start")) & (x["diagonal"] <= F.col("start") + F.col("width")))
    merged = one.withColumn("covered", F.when(F.col("template") >= 0, _covered(F.flatten(F.transform(inside, lambda x: x["places"])), F.col("words") - F.col("grams") + 1) / F.col("words")))
    whole = (F.col("template") >= len(base)) & (F.col("covered") >= COVER)
    found = merged.groupBy("doc_id", "th").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum("places").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("places") > 0, F.col("template"))).alias("b"),
        F.collect_set(F.when((F.col("places") > 0) | whole, F.col("template"))).alias("l"),
        F.coalesce(F.max("covered"), F.lit(0.0)).alias("score"),
        F.max("copies").cast("int").alias("copies"),
    )
    out = found.select("doc_id", F.greatest("n_words", F.lit(0)).alias("n_words"), "n_base", "first_word", "last_word", _sorted_labels(F.col("b"), labels).alias("base_labels"), _sorted_labels(F.col("l"), labels).alias("labels"), "score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.drop("copy")
