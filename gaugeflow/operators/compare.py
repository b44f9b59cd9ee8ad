"""Comparison of a relation of document pairs, as long relations.

``pairs`` has doc_id and the ground truth and prediction as JSON text
(``expected``, ``predicted``) or as structs, which are turned into JSON.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import ModelSpec
from ..sources import records
from ..sources.stored import shared_folder
from . import evaluation, flat, metrics, nested
from .flatten import evaluator_rows
from .document import COUNTS, Evaluator, as_text, comparisons, long_rows, non_matches

LONG = "doc_id string, path string, depth int, is_leaf boolean, " + ", ".join(f"{c} long" for c in COUNTS) + ", raw double, applied double, weight double, error string"
NON_MATCH = "doc_id string, field_path string, type string, gt string, pred string, similarity double, reason string"
COMPARISON = "doc_id string, expected_key string, expected_value string, actual_key string, actual_value string, match boolean, score double, weighted_score double, reason string"


def as_json(column: Column, kind: str) -> Column:
    return column if kind == "string" else F.to_json(column, {"ignoreNullFields": "false"})


def align(gt: DataFrame, pred: DataFrame, key: str = "doc_id", value: str = "record") -> DataFrame:
    """Pairs of two tables of records by key; a record without partner has null on the other side."""
    kinds = dict(gt.dtypes)[value], dict(pred.dtypes)[value]
    left = gt.select(F.col(key).cast("string").alias("doc_id"), as_json(F.col(value), kinds[0]).alias("expected"))
    right = pred.select(F.col(key).cast("string").alias("doc_id"), as_json(F.col(value), kinds[1]).alias("predicted"))
    return left.join(right, "doc_id", "full_outer")


def _evaluate(model: ModelSpec, rows: Callable[[Evaluator, dict, dict, Any], list[tuple]], failed: Callable[[str], list[tuple]], columns: list[str], count_list_extras: bool):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ev = Evaluator(model, count_list_extras)
        for frame in frames:
            out = []
            for doc, expected, predicted in zip(frame["doc_id"], frame["expected"], frame["predicted"]):
                try:
                    gt, pred = (model.from_json(records.unwrapped(json.loads(x))) if x is not None else dict.fromkeys(f.name for f in model.fields) for x in (expected, predicted))
                    found = rows(ev, gt, pred, ev.document(gt, pred))
                except Exception as e:
                    # A bad document is a row with its error, not the end of the job.
                    found = failed(f"{type(e).__name__}: {e}")
                out += [(doc, *r) for r in found]
            yield pd.DataFrame(out, columns=columns)

    return work


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _held(pairs: DataFrame) -> DataFrame:
    kinds = dict(pairs.dtypes)
    return pairs.select(F.col("doc_id").cast("string").alias("doc_id"), as_json(F.col("expected"), kinds["expected"]).alias("expected"), as_json(F.col("predicted"), kinds["predicted"]).alias("predicted"))


def compare_documents(pairs: DataFrame, model: ModelSpec, count_list_extras: bool = False) -> DataFrame:
    """One row for each document (empty path) and each of its fields, with counts and scores.

    A document that can't be read has one row, with ``error`` and no counts.
    A null side is a record without values. A ``{value, confidence}`` object
    stands for its value.
    """
    work = _evaluate(model, lambda ev, a, b, r: [(*x, None) for x in long_rows(r)], lambda e: [("", 0, False, *[0] * 6, None, None, None, e)], _names(LONG), count_list_extras)
    return _held(pairs).mapInPandas(work, LONG)


def document_non_matches(pairs: DataFrame, model: ModelSpec) -> DataFrame:
    """Every non-match of every readable document: doc_id, field_path, type, gt, pred, similarity, reason."""
    work = _evaluate(model, lambda ev, a, b, r: [(p, t, as_text(x), as_text(y), s, why) for p, t, x, y, s, why in non_matches(ev, model, a, b, r.fields)], lambda e: [], _names(NON_MATCH), False)
    return _held(pairs).mapInPandas(work, NON_MATCH)


def document_comparisons(pairs: DataFrame, model: ModelSpec) -> DataFrame:
    """Every leaf comparison of every readable document."""
    work = _evaluate(model, lambda ev, a, b, r: [(k, as_text(x), l, as_text(y), m, s, w, why) for k, x, l, y, m, s, w, why in comparisons(ev, model, a, b, r.fields)], lambda e: [], _names(COMPARISON), False)
    return _held(pairs).mapInPandas(work, COMPARISON)


def is_native(pairs: DataFrame, model: ModelSpec) -> bool:
    """Whether both sides are structs of a model whose records have a native form."""
    kinds = dict(pairs.dtypes)
    return all(kinds[c].startswith("struct") for c in ("expected", "predicted")) and nested.supports(model)


def _native_rows(pairs: DataFrame, model: ModelSpec, extras: str | None) -> DataFrame:
    held = pairs.withColumn("doc_id", F.col("doc_id").cast("string"))
    if nested.matched_fields(model):
        rows = nested.compare_nested(held, model, "expected", "predicted", extras)
    else:
        rows = flat.compare_flat(held, model, "expected", "predicted", documents=True, extras=extras)
    return rows.withColumn("error", F.lit(None).cast("string")).select(*_names(LONG))


def compare_with(pairs: DataFrame, model: ModelSpec, non_matches: bool = False, comparisons: bool = False, evaluator_format: bool = False, recall_with_fd: bool = False, derived: bool = True, extras: str | None = None) -> dict[str, DataFrame]:
    """Everything that a comparison of documents can give, as relations by name.

    ``pairs`` has doc_id, expected and predicted. ``fields``: one row for each
    document and field, natively where the model and its columns allow it,
    else by the document evaluator, with the roll-up of counts under
    ``aggregate``; ``scores``: overall_score of each document. On request:
    ``non_matches``, ``comparisons``, ``evaluator`` and, by default,
    ``metrics`` (corpus counts of every path with derived metrics). With
    non-matches or comparisons the pairs are evaluated at once, in one job
    whose result is kept in the shared folder and gives all relations
    (``evaluation``). The
    column ``extras`` counts undeclared keys where the sides are structs,
    which have no others.
    """
    if non_matches or comparisons:
        whole = evaluation.evaluate(pairs, model, f"{shared_folder(pairs.sparkSession)}/evaluation-{uuid.uuid4().hex}", extras)
        rows = whole.fields()
    else:
        rows = _native_rows(pairs, model, extras) if is_native(pairs, model) else compare_documents(pairs, model)
    sound = rows.where("error is null")
    out = {"fields": rows, "scores": sound.where("path = ''").select("doc_id", F.col("applied").alias("overall_score")), "aggregate": metrics.roll_up(sound, ("doc_id",))}
    if derived:
        out["metrics"] = metrics.derived(metrics.bulk(sound), recall_with_fd)
    if evaluator_format:
        out["evaluator"] = evaluator_rows(sound, recall_with_fd)
    if non_matches:
        out["non_matches"] = whole.non_matches()
    if comparisons:
        out["comparisons"] = whole.comparisons()
    return out


def confidence_matches(pairs: DataFrame, model: ModelSpec) -> DataFrame:
    """(doc_id, path, confidence, match, score): the comparisons whose predicted value came with a confidence."""
    held = _held(pairs)
    rows = document_comparisons(pairs, model).select("doc_id", F.col("actual_key").alias("path"), "match", "score")
    return rows.join(records.confidences(held), ["doc_id", "path"]).select("doc_id", "path", "confidence", "match", "score")
