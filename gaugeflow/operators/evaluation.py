"""One evaluation of a table of pairs for everything that is asked of it.

Pairs are compared once. Each document becomes one row with its field rows,
non-matches, comparisons and error as arrays, which is written as it is made:
the sink of results. Counts of documents, errors and outcomes are observed on
the way, so they need no job of their own. Relations are read from single
columns of the written table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.spec import ModelSpec
from ..sources import records
from . import flat
from .document import COUNTS, FA_REASON, FN_REASON, Evaluator, as_text, comparisons, long_rows, non_matches

FIELD = "path: string, depth: int, is_leaf: boolean, " + ", ".join(f"{c}: long" for c in COUNTS) + ", raw: double, applied: double, weight: double"
NON_MATCH = "field_path: string, type: string, gt: string, pred: string, similarity: double, reason: string"
COMPARISON = "expected_key: string, expected_value: string, actual_key: string, actual_value: string, match: boolean, score: double, weighted_score: double, reason: string"
DOCUMENT = f"doc_id string, fields array<struct<{FIELD}>>, non_matches array<struct<{NON_MATCH}>>, comparisons array<struct<{COMPARISON}>>, error string"
NAMES = {k: [x.split(":")[0] for x in v.split(", ")] for k, v in (("fields", FIELD), ("non_matches", NON_MATCH), ("comparisons", COMPARISON))}
TYPES = {"fa": ("false_alarm", "unmatched prediction"), "fn": ("false_negative", "unmatched ground truth"), "fd": ("false_discovery", None)}


class Evaluation(NamedTuple):
    """``table``: one row for each document; ``counted``: documents, errors and the six counts of readable documents, as observed."""

    table: DataFrame
    counted: dict[str, int]

    def fields(self) -> DataFrame:
        """The long relation; a document that can't be read has one row with its error and no scores."""
        sound = self.table.where("error is null").select("doc_id", F.inline("fields")).withColumn("error", F.lit(None).cast("string"))
        zero = [F.lit(0).cast("long").alias(c) for c in COUNTS]
        none = [F.lit(None).cast("double").alias(c) for c in ("raw", "applied", "weight")]
        failed = self.table.where("error is not null").select("doc_id", F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit(False).alias("is_leaf"), *zero, *none, "error")
        return sound.unionByName(failed)

    def non_matches(self) -> DataFrame:
        return self.table.select("doc_id", F.inline("non_matches"))

    def comparisons(self) -> DataFrame:
        return self.table.select("doc_id", F.inline("comparisons"))

    def errors(self) -> DataFrame:
        """(doc_id, error) of the documents that can't be read."""
        return self.table.where("error is not null").select("doc_id", "error")


def collects_natively(model: ModelSpec) -> bool:
    """Whether records have only scalars and nested records, so that non-matches and comparisons need no matching."""
    return flat.supports(model) and not any(f.is_list or f.is_map or (f.kind == "struct" and not collects_natively(f.model)) for f in model.fields)


def by_document(pairs: DataFrame, model: ModelSpec, extras: str | None = None) -> DataFrame:
    """One row for each document: doc_id, fields, non_matches, comparisons, error.

    Structs of records without lists and dictionaries are compared natively,
    others, and JSON text, by the document evaluator. Rows that repeat an id
    stay rows of their own. Texts of nested records are JSON.
    """
    kinds = dict(pairs.dtypes)
    if all(kinds[c].startswith("struct") for c in ("expected", "predicted")) and collects_natively(model):
        return _native(pairs, model, extras)
    as_json = lambda c: F.col(c) if kinds[c] == "string" else F.to_json(c, {"ignoreNullFields": "false"})
    held = pairs.select(F.col("doc_id").cast("string").alias("doc_id"), as_json("expected").alias("expected"), as_json("predicted").alias("predicted"))

    def one(ev: Evaluator, expected: str | None, predicted: str | None) -> tuple:
        gt, pred = (model.from_json(records.unwrapped(json.loads(x))) if x is not None else dict.fromkeys(f.name for f in model.fields) for x in (expected, predicted))
        result = ev.document(gt, pred)
        named = lambda name, rows: [dict(zip(NAMES[name], r)) for r in rows]
        wrong = [(p, t, as_text(x), as_text(y), s, why) for p, t, x, y, s, why in non_matches(ev, model, gt, pred, result.fields)]
        leaves = [(k, as_text(x), l, as_text(y), bool(m), s, w, why) for k, x, l, y, m, s, w, why in comparisons(ev, model, gt, pred, result.fields)]
        return named("fields", long_rows(result)), named("non_matches", wrong), named("comparisons", leaves), None

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ev = Evaluator(model)
        for frame in frames:
            out = []
            for doc, expected, predicted in zip(frame["doc_id"], frame["expected"], frame["predicted"]):
                try:
                    found = one(ev, expected, predicted)
                except Exception as e:
                    # A bad document is a row with its error, not the end of the job.
                    found = ([], [], [], f"{type(e).__name__}: {e}")
                out.append((doc, *found))
            yield pd.DataFrame(out, columns=["doc_id", *NAMES, "error"])

    return held.mapInPandas(work, DOCUMENT)


def _value_text(v: Column, kind: str) -> Column:
    """A value as the collectors show it: texts as they are, others as JSON has them."""
    if kind == "struct":
        return F.when(v.isNotNull(), F.to_json(v, {"ignoreNullFields": "false"}))
    if kind == "bool":
        return v.cast("string")
    return C.py_str(F.base64(v) if kind == "bytes" else v, {"float": "double"}.get(kind, "string"))


def _values(model: ModelSpec, a: Column, b: Column, prefix: str = "") -> list[Column]:
    """(path, (texts of both values, threshold's text)) of every field."""
    out = []
    for f in model.fields:
        x, y = a.getField(f.name), b.getField(f.name)
        out.append(F.struct(F.lit(prefix + f.name).alias("key"), F.struct(_value_text(x, f.kind).alias("a"), _value_text(y, f.kind).alias("b"), F.lit(str(f.threshold)).alias("t")).alias("value")))
        if f.kind == "struct":
            out += _values(f.model, x, y, f"{prefix}{f.name}.")
    return out


def _why(raw: Column, threshold: Column, text: Column) -> Column:
    near_one = F.abs(raw - 1.0) <= 1e-9 * F.greatest(F.abs(raw), F.lit(1.0))
    shown = F.format_string("%.3f", raw)
    above = F.when(near_one, "exact match").otherwise(F.concat(F.lit("above threshold ("), shown, F.lit(" >= "), text, F.lit(")")))
    return F.when(raw >= threshold, above).otherwise(F.concat(F.lit("below threshold ("), shown, F.lit(" < "), text, F.lit(")")))


def _native(pairs: DataFrame, model: ModelSpec, extras: str | None) -> DataFrame:
    held = pairs.withColumn("doc_id", F.col("doc_id").cast("string"))
    built = flat.compare_documents_wide(held, model, "expected", "predicted", extras, also={"~values": F.map_from_entries(F.array(*_values(model, F.col("expected"), F.col("predicted"))))})
    leaves = F.filter("~rows", lambda r: r["is_leaf"] & (r["depth"] > 0))
    text = lambda r: F.col("~values")[r["path"]]

    def compared(r: Column) -> Column:
        v = text(r)
        one_sided = v["a"].isNull() != v["b"].isNull()
        zero = lambda x: F.when(one_sided, 0.0).otherwise(x)
        why = F.when(one_sided & v["b"].isNull(), FN_REASON).when(one_sided, FA_REASON).otherwise(_why(r["raw"], r["threshold"], v["t"]))
        values = [r["path"], v["a"], r["path"], v["b"], ~one_sided & (r["raw"] >= r["threshold"]), zero(r["raw"]), zero(r["applied"] * r["weight"]), why]
        return F.struct(*[x.alias(n) for n, x in zip(NAMES["comparisons"], values)])

    def wrong(r: Column) -> Column:
        v, fd = text(r), r["outcome"] == "fd"
        kind, why = F.lit(None).cast("string"), _why(r["raw"], r["threshold"], v["t"])
        for outcome, (name, reason) in TYPES.items():
            kind = F.when(r["outcome"] == outcome, name).otherwise(kind)
            why = why if reason is None else F.when(r["outcome"] == outcome, reason).otherwise(why)
        values = [r["path"], kind, v["a"], v["b"], F.when(fd, r["raw"]), why]
        return F.struct(*[x.alias(n) for n, x in zip(NAMES["non_matches"], values)])

    return built.select(
        "doc_id",
        F.transform("~rows", lambda r: F.struct(*[r[c].alias(c) for c in NAMES["fields"]])).alias("fields"),
        F.transform(F.filter(leaves, lambda r: r["outcome"].isin(*TYPES)), wrong).alias("non_matches"),
        F.transform(leaves, compared).alias("comparisons"),
        F.lit(None).cast("string").alias("error"),
    )


def evaluate(pairs: DataFrame, model: ModelSpec, folder: str, extras: str | None = None) -> Evaluation:
    """Compare ``pairs`` (doc_id, expected, predicted) once, writing one row for each document to ``folder`` as Parquet.

    The counts come from the same job. A folder that is there already is an
    error. An empty table gives zeros.
    """
    watch = Observation()
    whole = F.element_at(F.filter("fields", lambda r: r["path"] == ""), 1)
    sums = [F.coalesce(F.sum(F.when(F.col("error").isNull(), whole[c])), F.lit(0)).cast("long").alias(c) for c in COUNTS]
    rows = by_document(pairs, model, extras).observe(watch, F.count(F.lit(1)).alias("documents"), F.count("error").alias("errors"), *sums)
    rows.write.parquet(folder)
    return Evaluation(read(pairs.sparkSession, folder), dict(watch.get))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' rows that ``evaluate`` wrote."""
    return spark.read.schema(DOCUMENT).parquet(folder)
