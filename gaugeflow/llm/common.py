"""Shared pieces: cutting lineage, and byte-level word and n-gram hashing.

Texts are handled as UTF-8 bytes in numpy, a few megabytes at a time, so a
batch of very long texts never makes a large temporary.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20


# ---------------------------------------------------------------- storage

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what ``spark.checkpoint.dir`` names.

    Only where that is unset on one machine, as in tests, a temporary folder
    of this machine is chosen and set; a cluster without the setting is
    refused, as its executors would write where no other can read.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="gaugeflow-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    The result depends on files that survive the loss of any executor, and
    later steps can prune its columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote and that no later result reads."""
    for table in tables:
        if table is not None:
            delete(table.sparkSession, table._cut_path)


#: What a broadcast side may hold, by its rows and by the bytes that their values take.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 64 << 20


def attach(df: DataFrame, side: DataFrame, on: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` left-joined with ``side``, which is written first and broadcast only if it is small in rows and bytes.

    Bytes are those of the values as JSON, an upper estimate of numbers. An
    empty side costs no join: its columns are null.
    """
    side = cut(side, "side")
    rows, size = side.agg(F.count("*"), F.sum(F.length(F.to_json(F.struct(*side.columns))))).first()
    if not rows:
        return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in side.schema if f.name not in on})
    return df.join(F.broadcast(side) if rows <= limit and size <= BROADCAST_BYTES else side, on, "left")


#: Keys with this part of all rows are hot; there are at most as many of them.
HOT_KEYS = 1000


def join_by_share(df: DataFrame, side: DataFrame, on: list[str], weight: str) -> DataFrame:
    """``df`` left-joined with ``side``, which has one row for each key and says in ``weight`` how many rows of ``df`` have it.

    Nulls are equal. Keys that hold a ``HOT_KEYS``-th of the rows or more are
    broadcast, of which there are at most ``HOT_KEYS``; the rest is shuffled,
    where no key is hot. ``side`` is read three times: write it first.
    """
    total = side.agg(F.sum(weight)).first()[0] or 0
    named = side.select(*[F.col(c).alias(f"~{c}") for c in on], *[c for c in side.columns if c not in [*on, weight]], F.lit(True).alias("~hot"), (F.col(weight).cast("double") * HOT_KEYS >= total).alias("~much"))
    hot, cold = F.broadcast(named.where("`~much`").drop("~much")), named.where("not `~much`").drop("~much")
    same = [F.col(c).eqNullSafe(F.col(f"`~{c}`")) for c in on]
    extra = [f"~{c}" for c in on] + ["~hot"]
    first = df.join(hot, same, "left").where("`~hot`").drop(*extra)
    rest = df.join(hot.drop(*[c for c in hot.columns if c not in extra]), same, "left_anti").join(cold, same, "left").drop(*extra)
    return first.unionByName(rest)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that have been cut off.

    Spark forgets a shuffle when its plan is garbage, first here and then in
    the JVM; the second round takes what the first has let go. Nothing
    depends on it but how long shuffle files stay on disk; with
    ``spark.gaugeflow.release`` set to false it is left to Spark's own cleaner.
    """
    import gc
    import time

    if spark.conf.get("spark.gaugeflow.release", "true") == "false":
        return
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


# ---------------------------------------------------------------- hashing

_U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_R_INV = pow(_R, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * _U(pow(base, filled, 1 << 64))
        filled += take
    return out


class _Tables:
    """Powers of the rolling base, grown on demand, and the byte table."""

    def __init__(self) -> None:
        self.bytes = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
        self.up = _powers(_R, 1 << 16)
        self.down = _powers(_R_INV, 1 << 16)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(_R, size), _powers(_R_INV, size)


_tables: _Tables | None = None


def tables() -> _Tables:
    global _tables
    if _tables is None:
        _tables = _Tables()
    return _tables


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of a run of texts.

    ``data``: bytes; ``starts``/``ends``: of each word in data; ``first``:
    index of each text's first word, with one more entry at the end.
    """

    __slots__ = ("data", "ends", "first", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE):
        self.data = data
        n = len(data)
        inside = ~breaks[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = offsets[:-1]
        at = at[at < n]
        begins[at] = inside[at]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        before = offsets[1:] - 1
        before = before[(before >= 0) & (before < n)]
        stops[before] |= inside[before]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        t = tables()
        n = len(self.data)
        t.grow(n + 1)
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(t.bytes[self.data] * t.up[:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * t.down[self.starts] + (self.ends - self.starts).astype(np.uint64))


def ngrams(words: np.ndarray, n: int, salt: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes, ignoring text borders."""
    size = len(words) - n + 1
    if size <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = words[:size].copy()
    for k in range(1, n):
        acc *= _U(salt | 1)
        acc += words[k : k + size]
    return mix(acc)


# ---------------------------------------------------------------- batches

def give_back() -> None:
    """Return freed memory to the system; a worker lives on between tasks, beside others and the executor itself."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, lower: bool = False, limit: int = CHUNK_BYTES, most: int = 4096):
    """(first row, past last row, bytes, offsets) for runs of up to ``most`` rows of about ``limit`` bytes.

    A single longer text is a run of its own; texts are never cut.
    """
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    row, rows = 0, batch.num_rows
    while row < rows:
        past = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        past = min(max(past, row + 1), row + most, rows)
        part = data[offsets[row] : offsets[past]]
        yield row, past, (_LOWER[part] if lower else part), offsets[row : past + 1] - offsets[row]
        row = past
    give_back()


def binary_column(blobs: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from its bytes and offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(blobs))])


def ids(batch: pa.RecordBatch, name: str = "doc_id") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.int64())
