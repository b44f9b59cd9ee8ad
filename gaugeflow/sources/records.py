"""Reading record pairs, packets and results; writing results and state."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import ModelSpec


def json_pairs(df: DataFrame, expected: str = "expected", predicted: str = "predicted", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, expected, predicted) JSON texts; rows without readable objects on both sides are skipped.

    Without an id column a row is named after its content and, where rows
    repeat, its number among them, which does not depend on how the table is
    partitioned. Repeated rows are counted before they are numbered, so they
    are not gathered in one task.
    """
    if doc_id in df.columns:
        held = df.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(expected).alias("expected"), F.col(predicted).alias("predicted"))
    else:
        each = df.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
        named = F.concat(F.lit("row_"), F.hex(F.xxhash64("expected", "predicted")))
        held = each.select(named.alias("name"), "expected", "predicted", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
        held = held.select(F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat_ws("_", "name", "k")).alias("doc_id"), "expected", "predicted")
    sound = lambda c: F.coalesce(F.json_object_keys(c).isNotNull(), F.lit(False))
    return held.where(sound("expected") & sound("predicted"))


def _undeclared(column: Column, model: ModelSpec) -> Column:
    """How many keys of a JSON object and of the nested objects that the model declares are not declared."""
    names = F.array(*[F.lit(f.name) for f in model.fields]) if model.fields else F.array().cast("array<string>")
    total = F.coalesce(F.size(F.array_except(F.json_object_keys(column), names)), F.lit(0))
    for f in model.fields:
        if f.kind == "struct":
            total = total + _undeclared(F.get_json_object(column, f"$['{f.name}']"), f.model)
    return total


def parse(df: DataFrame, model: ModelSpec, column: str, to: str = "record") -> DataFrame:
    """``df`` with the model's struct from JSON text, the undeclared top-level keys, and ``n_extras``, which counts nested ones too."""
    declared = F.array(*[F.lit(f.name) for f in model.fields])
    keys = F.array_except(F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")), declared)
    return df.withColumns({to: F.from_json(column, model.schema()), "extra_keys": keys, "n_extras": _undeclared(F.col(column), model)})


def packet_pages(spark: SparkSession, data) -> DataFrame:
    """Page rows from a CSV path, a list of dictionaries or a DataFrame."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, str):
        return spark.read.csv(data, header=True, inferSchema=True)
    if isinstance(data, list) and all(isinstance(x, dict) for x in data):
        return spark.createDataFrame(data)
    raise TypeError("a CSV path, a list of dictionaries or a DataFrame is needed")


def confidences(df: DataFrame, column: str = "predicted") -> DataFrame:
    """(doc_id, path, confidence) of every ``{value, confidence}`` in JSON text, whole paths as in ``a.b[0].c``."""
    schema = "doc_id string, path string, confidence double"

    def walk(value, path: str):
        if isinstance(value, dict):
            if "value" in value and "confidence" in value:
                yield path, value["confidence"]
                yield from walk(value["value"], path)
            else:
                for k, v in value.items():
                    yield from walk(v, f"{path}.{k}" if path else k)
        elif isinstance(value, list):
            for k, v in enumerate(value):
                yield from walk(v, f"{path}[{k}]")

    def work(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["v"]):
                try:
                    rows += [(doc, p, float(c)) for p, c in walk(json.loads(text), "")]
                except (TypeError, ValueError):
                    # Text that is no JSON has no confidences.
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "path", "confidence"])

    return df.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(column).alias("v")).mapInPandas(work, schema)


def unwrapped(value):
    """A JSON value with each ``{value, confidence}`` replaced by its value."""
    if isinstance(value, dict):
        if "value" in value and "confidence" in value:
            return unwrapped(value["value"])
        return {k: unwrapped(v) for k, v in value.items()}
    return [unwrapped(v) for v in value] if isinstance(value, list) else value


def write_results(long: DataFrame, path: str) -> None:
    """Per-document results as JSON lines, appended."""
    rows = long.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in long.columns if c != "doc_id"])).alias("comparison_result"))
    rows.write.mode("append").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The long relation of ``write_results``."""
    from ..operators.compare import LONG

    fields = T.StructType.fromDDL(LONG)
    inner = T.StructType([f for f in fields if f.name != "doc_id"])
    held = T.StructType([fields["doc_id"], T.StructField("comparison_result", T.ArrayType(inner))])
    return spark.read.schema(held).json(path).select("doc_id", F.inline("comparison_result"))


def save_state(totals: DataFrame, path: str) -> None:
    """Partial sums that ``load_state`` and ``merge_states`` take up again."""
    totals.write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_non_matches(rows: DataFrame, path: str) -> None:
    """Non-matches as JSON lines in one folder for each type."""
    rows.write.mode("overwrite").partitionBy("type").json(path)
