"""Evaluator layout of results: derived metrics of documents and fields, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import derived, score_metrics


def evaluator_rows(long: DataFrame, recall_with_fd: bool = False) -> DataFrame:
    """doc_id, path, precision, recall, f1, accuracy, anls_score.

    The document's row is derived from its counts; a field's from its score,
    taken as a soft count.
    """
    rows = derived(long.where("path = '' or depth = 1"), recall_with_fd)
    whole, soft = F.col("path") == "", score_metrics(F.col("applied"))
    names = ("precision", "recall", "f1", "accuracy")
    # One pass: a union of the two kinds would have everything beneath compared twice.
    return rows.select("doc_id", "path", *[F.when(whole, F.col(n)).otherwise(s).alias(n) for n, s in zip(names, soft)], F.col("applied").alias("anls_score"))


def list_item_rows(matched: DataFrame, list_field: str, threshold: float = 0.5) -> DataFrame:
    """One row for each matched pair of a list field's elements: indices, and its score taken as a soft count.

    ``matched`` comes from ``lists.match_structs`` or ``lists.match_lists``.
    """
    each = matched.select("doc_id", F.explode_outer("pairs").alias("p")).where("p is not null")
    path = F.format_string(f"{list_field}[%d]", F.col("p.i"))
    return each.select("doc_id", path.alias("path"), "p.i", "p.j", *score_metrics(F.col("p.score"), threshold), F.col("p.score").alias("anls_score"))
