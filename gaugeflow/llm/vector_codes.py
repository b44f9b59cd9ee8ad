"""Vector code compression: product codes by weighted Lloyd over distinct parts.

Components become integers and vectors are cut into parts. Equal parts of one
position are combined into one row with a weight, so that a round of Lloyd's
method costs one distance for each *distinct* part and codebook entry. The
rounds run over that written table; what a round brings to the driver are the
sums of each entry. Codes and errors are joined back to the vectors at the
end.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_share

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integers beyond this size count as it; up to here doubles hold each of them.
LARGEST = 1 << 52
LONG_MAX = (1 << 63) - 1
#: Cells of a block of distances.
CELLS = 1 << 20


class Compressed(NamedTuple):
    """``codes``: vec_id, label, codes, error, size; ``books``: for each vector size, the entries of each part position."""

    codes: DataFrame
    books: dict[int, list[np.ndarray]]


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row of integers, the lowest index of equally near ones.

    Distances are exact: in doubles where those hold every sum, else in
    Python's whole numbers. Distances past a long count as the largest one.
    """
    n, size = x.shape
    index, far = np.zeros(n, np.int64), np.zeros(n, np.int64)
    most = int(np.abs(book).max(initial=0))
    own = (book.astype(float) ** 2).sum(axis=1)
    for a in range(0, n, step := max(1, CELLS // max(1, len(book)))):
        rows = x[a : a + step]
        if size * (most + int(np.abs(rows).max(initial=0))) ** 2 < 1 << 53:
            d = (rows.astype(float) ** 2).sum(axis=1)[:, None] + own - 2 * (rows.astype(float) @ book.T.astype(float))
            index[a : a + step] = best = d.argmin(axis=1)
            far[a : a + step] = d[np.arange(len(rows)), best]
            continue
        large = book.astype(object)
        for i, row in enumerate(rows.astype(object), a):
            d = ((large - row) ** 2).sum(axis=1)
            index[i] = min(range(len(d)), key=d.__getitem__)
            far[i] = min(d[index[i]], LONG_MAX)
    return index, far


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _sums(books: list[np.ndarray]):
    """Sums and weights of the parts nearest to each entry, one row for each entry that a task met."""

    def work(batches):
        total = [np.zeros(b.shape, object) for b in books]
        weight = [np.zeros(len(b), object) for b in books]
        for batch in batches:
            pos, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for p in np.unique(pos):
                mine = np.flatnonzero(pos == p)
                x = _matrix(batch.column(1).take(pa.array(mine)))
                w = n[mine].astype(np.int64)
                index, _ = nearest_entries(x, books[p])
                # Sums of a batch fit a long unless numbers or weights are huge.
                kind = np.int64 if (int(np.abs(x).max(initial=0)) + 1) * int(w.sum()) < 1 << 62 else object
                held, much = np.zeros(books[p].shape, kind), np.zeros(len(books[p]), np.int64)
                np.add.at(held, index, x.astype(kind) * w.astype(kind)[:, None])
                np.add.at(much, index, w)
                total[p] += held.astype(object)
                weight[p] += much.astype(object)
        met = [(p, e) for p, w in enumerate(weight) for e in range(len(w)) if w[e]]
        yield pa.RecordBatch.from_arrays([
            pa.array([p for p, _ in met], pa.int32()),
            pa.array([e for _, e in met], pa.int32()),
            pa.array([weight[p][e] for p, e in met], pa.int64()),
            pa.array([[Decimal(int(v)) for v in total[p][e]] for p, e in met], pa.list_(pa.decimal128(38, 0))),
        ], names=["pos", "entry", "n", "s"])

    return work


def _codes(books: list[np.ndarray]):
    def work(batches):
        for batch in batches:
            pos = batch.column(0).to_numpy()
            index, far = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
            for p in np.unique(pos):
                mine = np.flatnonzero(pos == p)
                index[mine], far[mine] = nearest_entries(_matrix(batch.column(1).take(pa.array(mine))), books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index, pa.int32()), pa.array(far, pa.int64())], names=["pos", "part", "n", "code", "error"])

    return work


def learn(distinct: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after ``rounds`` of weighted Lloyd over ``distinct`` (pos, part, n).

    A round collects one row for each entry, whatever the number of parts.
    The mean of an entry's parts is rounded down; an entry that no part is
    nearest to stays.
    """
    for _ in range(rounds):
        size = {b.shape[1] for b in books}
        part = distinct.mapInArrow(_sums(books), "pos int, entry int, n long, s array<decimal(38,0)>")
        widest = F.array(*[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(max(size))]) if max(size) else F.array()
        met = part.groupBy("pos", "entry").agg(F.sum("n").alias("n"), widest.alias("s")).collect()
        books = [b.copy() for b in books]
        for r in met:
            wide = books[r["pos"]].shape[1]
            books[r["pos"]][r["entry"]] = [int(v) // r["n"] for v in r["s"][:wide]]
    return books


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components, by part, entry and position, as decimal text with commas between."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def integers(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """(vec_id, label, size, parts) of the vectors that are whole: floor(scale * x) of each component, cut into consecutive parts."""
    held = vectors.select(F.col(vec_id).alias("vec_id"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x * scale))))
    size = F.size("v")
    at = lambda p: (p * size / parts).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("w", at(p) + 1, at(p + 1) - at(p)))
    return held.where(sound).withColumn("w", whole).select("vec_id", "label", size.alias("size"), pieces.alias("parts"))


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, parts: int = PARTS, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> Compressed:
    """Product codes of all vectors: vec_id, label, size, codes (an entry's index for each part) and error.

    Rows whose vector is null or holds null, NaN or infinite components are
    dropped. A part position's codebook starts as that part of the
    ``entries`` vectors with the smallest ids, all of them if there are
    fewer; a null id comes after all others, and equal ids go by their
    vectors. Vectors of different sizes have codebooks of their own, learned
    one after the other; a size that ``parts`` doesn't divide is cut as
    evenly as whole components allow, and an empty vector has codes 0 and
    error 0. Components past ``LARGEST / scale`` count as that, errors past
    a long as the largest. Rows that repeat are all kept. An empty table
    gives an empty one, with no codebooks.

    Distances are counted for distinct parts only. What a round sends to the
    driver, and the driver to the tasks, are ``entries * size`` numbers. A
    part that a thousandth of all vectors have is joined by broadcast, so no
    key of the shuffled join is hot.
    """
    held = integers(vectors, scale, parts, vec_id, vector, label)
    # Written, so that a row keeps its number if a task runs again.
    held = cut(held.withColumn("row", F.monotonically_increasing_id()), "whole")
    each = held.select("row", "vec_id", "label", "size", F.posexplode("parts").alias("pos", "part"))
    distinct = cut(each.groupBy("size", "pos", "part").agg(F.count("*").alias("n")), "parts")
    coded, books = [], {}
    for size in sorted(r["size"] for r in held.select("size").distinct().collect()):
        first = held.where(F.col("size") == size).orderBy(F.asc_nulls_last("vec_id"), "parts").select("parts").limit(entries).collect()
        start = [np.array([r["parts"][p] for r in first], np.int64).reshape(len(first), -1) for p in range(parts)]
        own = distinct.where(F.col("size") == size).select("pos", "part", "n")
        books[size] = learn(own, start, rounds)
        coded.append(own.mapInArrow(_codes(books[size]), "pos int, part array<bigint>, n long, code int, error long").withColumn("size", F.lit(size)))
    if not coded:
        return Compressed(held.select("vec_id", "label", "size", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), books)
    table = coded[0]
    for more in coded[1:]:
        table = table.unionByName(more)
    met = join_by_share(each, cut(table, "codes"), ["size", "pos", "part"], "n")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    out = met.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("codes"), _long(total).alias("error"))
    return Compressed(out.select("vec_id", "label", "size", F.transform("codes", lambda c: c["code"]).alias("codes"), "error"), books)


def _long(total: Column) -> Column:
    return F.least(total, F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the error summed over rows of one label, the null ones together."""
    coded = cut(coded, "coded")
    sums = coded.groupBy("label").agg(_long(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"), F.count("*").alias("n"))
    return join_by_share(coded, cut(sums, "labels"), ["label"], "n")


def code_text(codes: Column) -> Column:
    """Two hexadecimal digits for each code."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def digests(books: dict[int, list[np.ndarray]], size: Column) -> Column:
    """The digest of the codebooks of a vector's size."""
    out = F.lit(None).cast("string")
    for d, own in books.items():
        out = F.when(size == d, books_digest(own)).otherwise(out)
    return out
