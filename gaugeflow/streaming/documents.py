"""Corpus totals of a stream in which documents come again, repeated or corrected.

State is kept by document: its newest arrival, with the counts of its paths.
An arrival that is older, or the same again, changes nothing. So a document
counts once, whatever the order and however often it is sent. The state is a
streaming aggregate, without Python; each batch sums it up whole and writes
the totals under its id: a batch that runs again after a failure writes its
own folder again and adds nothing twice. A batch's work so grows with the
documents there are, by an addition for each path of each, as well as with
its own arrivals.

Newer is the larger ``version``, then the larger hash of the content, so two
different arrivals of one version are settled alike in any order. A null
version is older than any other; a null id is a document of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import flat
from ..operators.metrics import COUNTS
from ..plans.spec import ModelSpec

OLDEST = -(2**63)
TOTALS = "path string, documents long, " + ", ".join(f"{c} long" for c in COUNTS)


def arrivals(pairs: DataFrame, model: ModelSpec, version: str, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """The long relation of pairs as they arrive: doc_id, version, content (a hash of both sides), path, six counts, ``all``.

    ``pairs`` may be a stream; its sides are structs of a model without lists
    that need a matching. A document's own row has the empty path, and alone
    has ``all``: path and counts of each of the arrival's rows.
    """
    if not flat.supports(model):
        raise ValueError(f"{model.name}: only records without matched lists are compared in a stream")
    text = F.concat_ws("\x1f", *[F.coalesce(F.to_json(c, {"ignoreNullFields": "false"}), F.lit("")) for c in (expected, predicted)])
    held = pairs.withColumn("doc_id", F.col("doc_id").cast("string"))
    mark = {"version": F.coalesce(F.col(version).cast("long"), F.lit(OLDEST)), "content": F.xxhash64(text)}
    rows = flat.compare_documents_wide(held, model, expected, predicted, also=mark)
    one = lambda r: [r[c].alias(c) for c in ("path", *COUNTS)]
    rows = rows.withColumn("~all", F.transform("~rows", lambda r: F.struct(*one(r))))
    each = F.transform("~rows", lambda r: F.struct(*one(r), F.when(r["path"] == "", F.col("~all")).alias("all")))
    return rows.select("doc_id", "version", "content", F.inline(each))


def newest(rows: Iterator[pd.DataFrame]) -> tuple[tuple[int, int], dict[str, list[int]]] | None:
    """((version, content), counts by path) of the newest of a document's arrivals; a repeated one counts once. The rule in plain Python."""
    best, counts = None, {}
    for frame in rows:
        for version, content, path, *own in frame[["version", "content", "path", *COUNTS]].itertuples(index=False, name=None):
            mark = (int(version), int(content))
            if best is None or mark > best:
                best, counts = mark, {}
            if mark == best:
                counts[path] = [int(c) for c in own]
    return None if best is None else (best, counts)


def current(rows: DataFrame) -> DataFrame:
    """The newest arrival of each document of a stream of ``arrivals``: doc_id, and version, content, all as ``newest``.

    Arrivals of a task are settled before the shuffle, which deals documents
    by id; a task holds the state of those of its own partition.
    """
    return rows.where(F.col("all").isNotNull()).groupBy("doc_id").agg(F.max(F.struct("version", "content", "all")).alias("newest"))


def _totals(held: DataFrame) -> DataFrame:
    """path, documents that have it, and sums of its counts."""
    each = held.select(F.inline("newest.all"))
    return each.groupBy("path").agg(F.count("*").alias("documents"), *[F.sum(c).cast("long").alias(c) for c in COUNTS])


def start(rows: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the totals of a stream of ``arrivals`` under ``folder``; ``saved`` reads them.

    Each batch writes the totals up to it under its id. Start again with the
    same two folders to go on.
    """

    def write(batch: DataFrame, number: int) -> None:
        # One small file, so that a folder is there whole or not at all.
        _totals(batch).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = current(rows).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def saved(spark: SparkSession, folder: str) -> DataFrame:
    """The totals as of the last finished batch: path, documents, six counts; paths that no document has any more are left out."""
    held = spark.read.schema(f"{TOTALS}, batch long").option("basePath", folder).parquet(folder)
    last = held.agg(F.max("batch")).first()[0]
    return spark.createDataFrame([], TOTALS) if last is None else held.where(F.col("batch") == last).drop("batch")
