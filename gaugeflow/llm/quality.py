"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled texts is turned into hashed byte n-gram and
repetition features, reduced by a truncated singular value decomposition,
and broadcast. Every document is projected into the same space, its cosine
with every labelled vector is computed exactly, block by block, and the
nearest labels vote with their similarity as weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Words, chunks

HASHED = 1024
REPEATS = 16
WIDTH = HASHED + REPEATS


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of square-rooted feature shares for each text; texts without bytes have a zero row."""
    texts = len(offsets) - 1
    out = np.zeros((texts, WIDTH), dtype=np.float32)
    sizes = np.diff(offsets)
    if len(data) >= 3:
        wide = data.astype(np.uint32)
        code = ((wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(22)
        owner = np.repeat(np.arange(texts), sizes)
        inside = owner[:-2] == owner[2:]
        counts = np.bincount(owner[:-2][inside] * HASHED + code[inside], minlength=texts * HASHED).reshape(texts, HASHED)
        out[:, :HASHED] = np.sqrt(counts / np.maximum(sizes - 2, 1)[:, None])
    words = Words(data, offsets)
    hashed = words.hashes()
    for k in range(texts):
        own = hashed[words.first[k] : words.first[k + 1]]
        n = len(own)
        if not n:
            continue
        same = float((own[1:] == own[:-1]).sum()) / (n + 20)
        distinct = len(np.unique(own)) / n
        long = float((words.ends[words.first[k] : words.first[k + 1]] - words.starts[words.first[k] : words.first[k + 1]]).mean())
        values = [np.sqrt(same), (1 - distinct) * n / (n + 100), min(long / 20, 1.0)]
        out[k, HASHED : HASHED + 3] = np.array(values) * (0.8, 0.3, 0.2)
    return out


@dataclass
class Voters:
    """What is broadcast: feature weights, projection, labelled vectors and their labels."""

    mean: np.ndarray
    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; zero rows stay zero."""
        full = rows.any(axis=1)
        out = ((rows - self.mean) * self.weight) @ self.axes
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        out[~full] = 0
        return out.astype(np.float32)

    def vote(self, rows: np.ndarray, block: int = 256) -> np.ndarray:
        out = np.full(len(rows), self.prior)
        if not len(self.vectors):
            return out
        k = min(self.neighbours, len(self.vectors))
        for a in range(0, len(rows), block):
            part = rows[a : a + block]
            near = part @ self.vectors.T
            at = np.argpartition(near, -k, axis=1)[:, -k:]
            w = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(np.float64) ** 4
            total = w.sum(axis=1)
            share = (w * self.labels[at]).sum(axis=1) / np.maximum(total, 1e-12)
            out[a : a + block] = np.where(total > 1e-9, share, self.prior)
        return out


def fit(rows: np.ndarray, labels: np.ndarray, rank: int = 48, neighbours: int = 15) -> Voters:
    """Voters from labelled feature rows; without rows every score is 0.5."""
    if not len(rows):
        zero = np.zeros(WIDTH, dtype=np.float32)
        return Voters(zero, zero, np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5, neighbours)
    # No more neighbours than the rarer label has, or it could never win a vote.
    neighbours = max(1, min(neighbours, int(min((labels == 0).sum(), (labels == 1).sum()))))
    mean = rows.mean(axis=0)
    spread = rows.std(axis=0)
    weight = np.where(spread > 0, 1 / np.sqrt(spread + 1e-4), 0).astype(np.float32)
    weight[HASHED:] = 1 / np.sqrt(1e-4) / 4
    centred = (rows - mean) * weight
    values, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, np.argsort(-values)[: min(rank, len(rows))]].astype(np.float32)
    found = Voters(mean, weight, axes, np.zeros((0, 1), np.float32), labels.astype(np.float64), float(labels.mean()), neighbours)
    found.vectors = found.place(rows)
    return found


def _rows(batches):
    for batch in batches:
        for row, past, data, offsets in chunks(batch, "text", most=512):
            found = features(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, past - row), batch.column("label").slice(row, past - row), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "label", "row"])


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 2500, neighbours: int = 15, rank: int = 48) -> Voters:
    """Voters from at most ``sample`` labelled documents.

    ``labels`` has doc_id and label (0 or 1); rows with a null in either are
    ignored; of repeated ids the larger label stays and the smallest text. The sample is the labelled
    documents with the smallest hash of their id, so it does not depend on
    partitioning. It is the only thing collected, and its size is bounded by
    ``sample`` whatever the input.
    """
    own = labels.where("doc_id is not null and label is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("label").cast("int")).alias("label"))
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # The sample is bounded; within the limit it is small enough to be sent to every task.
    held = texts.join(F.broadcast(picked) if sample <= BROADCAST_ROWS else picked, "doc_id")
    held = held.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("x")).select("doc_id", "x.*")
    table = held.select("doc_id", "label", "text").mapInArrow(_rows, "doc_id long, label int, row binary").toArrow()
    y = table.column("label").to_numpy()
    x = np.frombuffer(b"".join(table.column("row").to_pylist()), dtype=np.float32).reshape(-1, WIDTH)
    # One order, whatever task a row came from, so that equally near neighbours are chosen alike.
    order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
    return fit(x[order], y[order], rank, neighbours)


def _scorer(shared):
    schema_tail = ["score"]

    def work(batches):
        voters = shared.value
        for batch in batches:
            for row, past, data, offsets in chunks(batch, "text", most=512):
                score = voters.vote(voters.place(features(data, offsets)))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(row, past - row), pa.array(np.clip(score, 0, 1))], names=["row", *schema_tail])

    return work


def score_quality(docs: DataFrame, voters: Voters, column: str = "score") -> DataFrame:
    """``docs``, all columns, with the quality score of each whole text.

    The score, 0 to 1, is the share of label 1 among the nearest labelled
    vectors, weighted by similarity; only the text has a part in it. Null
    and empty texts, and texts like no labelled one, get the share of label
    1 in the sample. A column that already has the name ``column`` is
    replaced. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    keep = [c for c in docs.columns if c != column]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").cast("string").alias("text"))
    out = held.mapInArrow(_scorer(shared), f"row {held.schema['row'].dataType.simpleString()}, score double")
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], F.col("score").alias(column))


def held_out(column: str = "doc_id"):
    """True for the quarter of ids that learning never sees."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))
