"""The corpus pipeline: documents in, packed training sequences out.

Four stages in order; each is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm.common import cut
from gaugeflow.llm.near_dup import deduplicate
from gaugeflow.llm.packing import pack_documents
from gaugeflow.llm.quality import fit_quality, held_out, score_quality
from gaugeflow.llm.queries import table, tokenizer_file
from gaugeflow.llm.substring_dedup import remove_repeats

#: Documents that score below go. Junk scores near 0, clean prose near 1.
REJECT_BELOW = 0.5
#: A passage is repeated if this many consecutive words stand in an earlier document.
PASSAGE_WORDS = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; all columns.

    Null and empty texts have the score of the labelled sample as a whole;
    without any label every document stays. Rows that repeat are scored
    alike; rows without doc_id are scored like any other. An empty table
    stays empty.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~held_out())
    voters = fit_quality(docs.select("doc_id", "text"), labels)
    score = "score"
    while score in docs.columns:
        score += "_"
    return score_quality(docs, voters, score).where(F.col(score) >= REJECT_BELOW).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more; all columns.

    Of a group the smallest doc_id stays. Rows that repeat a doc_id are one
    document and stay or go together. Texts without words and rows without
    doc_id are nobody's copies and stay. An empty table stays empty.
    """
    return deduplicate(docs, n=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; all columns, with n_chars of the new text.

    A text that loses nothing stays as it is, white space and null included;
    one that loses words is its other words, joined by single spaces, and may
    be empty. Rows that repeat a doc_id, and rows without one, lose nothing to
    one another. An empty table stays empty.
    """
    out = remove_repeats(docs, width=PASSAGE_WORDS, with_text=True)
    cut_text = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    own = [(F.when(cut_text, new[c]).otherwise(F.col("row").getField(c)) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return out.select(*own)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every id of every remaining document in exactly one sequence of at most 4096.

    Null and empty texts are their final id alone; rows that repeat, or have
    no doc_id, are packed each. An empty table gives no pieces.
    """
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: The stages hash, vote and tokenize, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
