"""Removal of repeated passages with a log-structured fingerprint index.

``FingerprintLog`` is a folder of sorted, immutable runs in shared storage: for
every hash partition, the fingerprints of all word windows of a batch in
ascending order, each with its earliest owner. A new batch becomes a run of
its own, is merge-joined with the runs of history partition by partition,
and joins them; runs of similar size are compacted into one, so there are
never more than a logarithmic number. What the merge marks as a repeat is
verified on the words of the earlier text before anything is removed.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, attach, chunks, cut, delete, discard, give_back, ids, ngrams, release, shared_dir

#: Bytes of text for each hash partition: its fingerprints take about as much.
PARTITION_BYTES = 8 << 20
#: Bytes of text whose equal windows a task combines before they are shuffled.
COMBINE_BYTES = 3 << 20
#: Stated runs of one source text that are verified in one place.
ASKED = 2000
#: A table is fed to its log in batches by ascending id; these are where they end, as parts of all rows.
BATCH_ENDS = (0.25, 0.5)


def windows_of(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, text, first word) of every window that lies in one text."""
    prints = ngrams(words.hashes(), width)
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    size = len(prints)
    inside = np.flatnonzero(owner[:size] == owner[width - 1 : width - 1 + size]) if size else np.empty(0, int)
    return prints[inside], owner[inside], inside


# ---------------------------------------------------------------- columns of numbers as bytes

def to_bytes(values: np.ndarray) -> bytes:
    """64-bit values, byte plane after byte plane, without leading planes of zeros."""
    flat = np.ascontiguousarray(values).view(np.uint64)
    used = (int(flat.max()).bit_length() + 7) // 8 if len(flat) else 0
    return flat.view(np.uint8).reshape(-1, 8)[:, :used].T.tobytes()


def from_bytes(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    if n and len(blob):
        planes = np.frombuffer(blob, dtype=np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.reshape(-1).view(np.uint64)


def sorted_bytes(values: np.ndarray) -> bytes:
    """Ascending values as the bytes of their first value and its differences."""
    return to_bytes(np.diff(values, prepend=np.uint64(0)))


def from_sorted(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(from_bytes(blob, n), dtype=np.uint64)


def earliest(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, where each distinct key begins in it, its smallest owner); a stable sort merges what is sorted in runs."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.empty(0, int)
    return order, first, np.minimum.reduceat(owner[order], first) if len(first) else np.empty(0, np.int64)


# ---------------------------------------------------------------- runs

#: ``owners``: of an index entry, its owner; of a repeat, the earlier document.
ENTRY = "kind string, part int, doc_id long, n int, prints binary, owners binary"
_ENTRY = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("prints", pa.binary()), ("owners", pa.binary())])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(v, f.type) for v, f in zip(zip(*rows), _ENTRY)], schema=_ENTRY) if rows else _ENTRY.empty_table()


def _repeats(part: int, doc: np.ndarray, prints: np.ndarray, sources: np.ndarray):
    """One row for each document: its repeated windows, by fingerprint, and an earlier document for each."""
    order = np.lexsort((prints, doc))
    doc, prints, sources = doc[order], prints[order], sources[order]
    once = np.concatenate([[True], (doc[1:] != doc[:-1]) | (prints[1:] != prints[:-1])]) if len(doc) else np.empty(0, bool)
    doc, prints, sources = doc[once], prints[once], sources[once]
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else []
    for a, b in zip(edges, [*edges[1:], len(doc)]):
        yield "found", part, int(doc[a]), b - a, sorted_bytes(prints[a:b]), to_bytes(sources[a:b])


#: Entries of a run in one row, and rows in one batch.
ROW_ENTRIES = 1 << 16
BATCH_ROWS = 64


def _run_rows(part: int, keys: np.ndarray, owner: np.ndarray):
    """Rows of a run: sorted distinct fingerprints and their owners."""
    for a in range(0, len(keys), ROW_ENTRIES):
        k, o = keys[a : a + ROW_ENTRIES], owner[a : a + ROW_ENTRIES]
        yield "run", part, None, len(k), sorted_bytes(k), to_bytes(o)


def _runs(width: int, parts: int):
    """Texts combined as far as ``COMBINE_BYTES`` go: one sorted run for every hash partition that they touch.

    Of a window that several of them have, only its earliest owner is in the
    run; for the others that owner is an earlier document already.
    """

    def flush(held):
        prints = np.concatenate([x[0] for x in held])
        owner = np.concatenate([x[1] for x in held])
        held.clear()
        order, first, least = earliest(prints, owner)
        ranked, owner = prints[order], owner[order]
        source = np.repeat(least, np.diff(np.append(first, len(ranked))))
        keys = ranked[first]
        home = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        edges = np.searchsorted(home, np.arange(parts + 1))
        rows = [x for p in np.flatnonzero(np.diff(edges)).tolist() for x in _run_rows(p, keys[edges[p] : edges[p + 1]], least[edges[p] : edges[p + 1]])]
        late = source < owner
        if late.any():
            # These pass the merge untouched, spread over all partitions by document.
            rows.extend((kind, doc % parts, doc, *rest) for kind, _, doc, *rest in _repeats(0, owner[late], ranked[late], source[late]))
        return _table(rows).to_batches(max_chunksize=BATCH_ROWS)

    def deal(batches):
        held, size = [], 0
        for batch in batches:
            key = ids(batch)
            for row, past, data, offsets in chunks(batch, "text"):
                prints, owner, _ = windows_of(Words(data, offsets), width)
                if len(prints):
                    held.append((prints, key.slice(row, past - row).to_numpy(zero_copy_only=False)[owner]))
                size += len(data)
                if size >= COMBINE_BYTES and held:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return deal


def _load(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, owner, whether new) of all index entries, run after run."""
    n = table.column("n").to_pylist()
    new = np.repeat(np.array([k == "run" for k in table.column("kind").to_pylist()], dtype=bool), n)
    keys = [from_sorted(x.as_py(), k) for x, k in zip(table.column("prints"), n)]
    owner = [from_bytes(x.as_py(), k) for x, k in zip(table.column("owners"), n)]
    return (np.concatenate(keys), np.concatenate(owner).view(np.int64), new) if n else (np.empty(0, np.uint64), np.empty(0, np.int64), new)


def _merge(keep: bool):
    """One hash partition: the new entries, merged with those of history; what repeats, and the batch's own run."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        found = pa.array([k == "found" for k in table.column("kind").to_pylist()], pa.bool_())
        passed = table.filter(found).select(_ENTRY.names).cast(_ENTRY)
        keys, owner, new = _load(table.filter(pc.invert(found)))
        order, first, least = earliest(keys, owner)
        ranked, own, fresh = keys[order], owner[order], new[order]
        del keys, owner, new, order
        source = np.repeat(least, np.diff(np.append(first, len(ranked))))
        late = fresh & (source < own)
        rows = list(_repeats(part, own[late], ranked[late], source[late]))
        del source, late
        if keep and fresh.any():
            own_keys, own_owner = ranked[fresh], own[fresh]
            _, first, least = earliest(own_keys, own_owner)
            rows.extend(_run_rows(part, own_keys[first], least))
        made = pa.concat_tables([passed, _table(rows)])
        del rows, ranked, own, fresh, first, least
        give_back()
        return made

    return work


def _compact(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One hash partition of several runs, as one run."""
    keys, owner, _ = _load(table)
    order, first, least = earliest(keys, owner)
    return _table(list(_run_rows(key[0].as_py(), keys[order][first], least)))


class FingerprintLog:
    """Sorted runs of window fingerprints under one folder that driver and executors share.

    ``add`` marks what a batch repeats and appends its run; ``compact`` merges
    runs of similar size. The list of runs is a small table of its own, to
    which every change appends a version, so a log can be opened again by
    another session, and a change that failed half-way left nothing visible.
    """

    def __init__(self, spark: SparkSession, path: str, width: int, parts: int, runs: list[tuple[str, int]], version: int = 0):
        self.spark, self.path, self.width, self.parts, self.runs, self.version = spark, path.rstrip("/"), width, parts, runs, version

    @classmethod
    def create(cls, spark: SparkSession, path: str, width: int, parts: int) -> "FingerprintLog":
        return cls(spark, path, width, parts, [])

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "FingerprintLog":
        """The log that was written under ``path``, at its last version."""
        listed = spark.read.parquet(f"{path.rstrip('/')}/manifest")
        last = listed.agg(F.max("version")).first()[0]
        rows = sorted(listed.where(F.col("version") == last).collect(), key=lambda r: r["place"])
        return cls(spark, path, rows[0]["width"], rows[0]["parts"], [(r["name"], r["entries"]) for r in rows if r["name"]], last)

    def _commit(self, runs: list[tuple[str, int]]) -> None:
        """The new list, then the end of the runs that are no longer in it."""
        old = {name for name, _ in self.runs} - {name for name, _ in runs}
        self.version += 1
        rows = [(self.version, k, name, n, self.width, self.parts) for k, (name, n) in enumerate(runs)] or [(self.version, 0, None, 0, self.width, self.parts)]
        self.spark.createDataFrame(rows, "version int, place int, name string, entries long, width int, parts int").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.runs = runs
        for name in old:
            delete(self.spark, f"{self.path}/{name}")

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(*[f"{self.path}/{name}/kind=run" for name in names]).withColumn("kind", F.lit("history"))

    def _by_part(self, rows: DataFrame):
        return rows.repartition(self.parts, "part").groupBy("part")

    def add(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """(doc_id, n, prints, owners): the windows of ``docs`` that a smaller doc_id of the log or of ``docs`` has.

        ``docs`` needs doc_id and text; rows without doc_id are left out. The
        batch's run joins the log unless ``keep`` is false, as for the last
        batch of a log that is not used again.
        """
        held = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        rows = held.mapInArrow(_runs(self.width, self.parts), ENTRY)
        if self.runs:
            rows = rows.unionByName(self._read([name for name, _ in self.runs]))
        name = f"run-{uuid.uuid4().hex}"
        self._by_part(rows).applyInArrow(_merge(keep), ENTRY).write.partitionBy("kind").parquet(f"{self.path}/{name}")
        written = self.spark.read.schema(ENTRY).parquet(f"{self.path}/{name}")
        found = written.where("kind = 'found'").select("doc_id", "n", "prints", "owners")
        if keep:
            entries = written.where("kind = 'run'").agg(F.sum("n")).first()[0]
            found = cut(found, "found")
            if entries:
                self._commit([*self.runs, (name, entries)])
                self.compact()
            else:
                delete(self.spark, f"{self.path}/{name}")
        return found

    def compact(self, all_runs: bool = False) -> None:
        """Merge the last runs while the one before is less than twice as long; or all of them."""
        while len(self.runs) > 1 and (all_runs or self.runs[-2][1] < 2 * self.runs[-1][1]):
            last = self.runs[-2:]
            name = f"run-{uuid.uuid4().hex}"
            self._by_part(self._read([n for n, _ in last])).applyInArrow(_compact, ENTRY).write.partitionBy("kind").parquet(f"{self.path}/{name}")
            entries = self.spark.read.schema(ENTRY).parquet(f"{self.path}/{name}").agg(F.sum("n")).first()[0]
            self._commit([*self.runs[:-2], (name, entries)])

    def drop(self) -> None:
        delete(self.spark, self.path)


# ---------------------------------------------------------------- removal

OWN = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, runs array<struct<src: long, at: int, len: int, print: long, digest: binary>>"


def _remove(width: int, with_text: bool):
    """Removes the words under marked windows, and states each run of them for verification.

    ``split``: stretches of windows to be stated one by one; ``bad``: windows
    that verification has refuted.
    """
    run = pa.list_(pa.struct([("src", pa.int64()), ("at", pa.int32()), ("len", pa.int32()), ("print", pa.int64()), ("digest", pa.binary())]))

    def work(batches):
        for batch in batches:
            key = ids(batch)
            column = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
            for row, past, data, offsets in chunks(batch, "text"):
                words = Words(data, offsets)
                marked, split, bad = (column[c].slice(row, past - row).to_pylist() for c in ("found", "split", "bad"))
                if any(marked):
                    prints, owner, first = windows_of(words, width)
                    edges = np.searchsorted(owner, np.arange(past - row + 1))
                raw = data.tobytes()
                rows: list[list] = [[] for _ in range(5)]
                for k in range(past - row):
                    a, b = int(words.first[k]), int(words.first[k + 1])
                    runs: list[tuple] = []
                    gone = np.zeros(b - a, dtype=bool)
                    if marked[k]:
                        lo, hi = edges[k], edges[k + 1]
                        source, known = _sources(prints[lo:hi], marked[k])
                        alone = np.zeros(hi - lo, dtype=bool)
                        for x in bad[k] or ():
                            known[x["at"] : x["at"] + x["len"]] = False
                        for x in split[k] or ():
                            alone[x["at"] : x["at"] + x["len"]] = True
                        runs = list(_cover(source, known, alone, prints[lo:hi], words, first[lo:hi], width, raw, gone, a))
                    if gone.any():
                        keep = np.flatnonzero(~gone) + a
                        s, e = words.starts[keep], words.ends[keep]
                    else:
                        s, e = words.starts[a:b], words.ends[a:b]
                    text = b" ".join([raw[x:y] for x, y in zip(s.tolist(), e.tolist())])
                    values = b - a, int(gone.sum()), hashlib.sha256(text).hexdigest(), text.decode() if with_text and gone.any() else None, runs
                    for to, value in zip(rows, values):
                        to.append(value)
                arrays = [column["row"].slice(row, past - row), key.slice(row, past - row), *(pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int64(), pa.string(), pa.string(), run)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "runs"])

    return work


def _sources(own: np.ndarray, marked: list) -> tuple[np.ndarray, np.ndarray]:
    """(earlier document, whether there is one) of each window of a text, found by its fingerprint."""
    keys = np.concatenate([from_sorted(x["prints"], x["n"]) for x in marked])
    owners = np.concatenate([from_bytes(x["owners"], x["n"]) for x in marked]).view(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, owners = keys[order], owners[order]
    at = np.searchsorted(keys, own)
    at[at == len(keys)] = 0
    return owners[at], keys[at] == own


def _cover(source, known, alone, prints, words, first, width, raw, gone, base):
    """Marks the covered words; one (source, first window, windows, fingerprint, digest) for each run."""
    step = np.flatnonzero(np.concatenate([[True], (source[1:] != source[:-1]) | (known[1:] != known[:-1]) | alone[1:] | alone[:-1]])) if len(source) else []
    for s, e in zip(step, np.append(step[1:], len(source)) if len(source) else []):
        if not known[s]:
            continue
        a, b = int(first[s]), int(first[e - 1]) + width
        gone[a - base : b - base] = True
        text = b" ".join([raw[x:y] for x, y in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist())])
        yield int(source[s]), int(s), int(e - s), int(prints[s : s + 1].view(np.int64)[0]), hashlib.blake2b(text, digest_size=16).digest()


WRONG = "src long, print long, len int, digest binary"


def _confirm(width: int):
    """Of the runs said to stand in a source text, those that this text does not hold."""
    schema = pa.schema([("src", pa.int64()), ("print", pa.int64()), ("len", pa.int32()), ("digest", pa.binary())])

    def work(batches):
        for batch in batches:
            key = ids(batch)
            asked = batch.column(batch.schema.get_field_index("asked"))
            for row, past, data, offsets in chunks(batch, "text"):
                words = Words(data, offsets)
                prints = ngrams(words.hashes(), width)
                raw = data.tobytes()
                out = []
                for k in range(past - row):
                    a, b = int(words.first[k]), int(words.first[k + 1])
                    own = prints[a : max(a, b - width + 1)].view(np.int64)
                    order = np.argsort(own)
                    ranked = own[order]
                    wanted = asked[row + k].as_py()
                    lo = np.searchsorted(ranked, [x["print"] for x in wanted])
                    hi = np.searchsorted(ranked, [x["print"] for x in wanted], side="right")
                    for x, p, q in zip(wanted, lo, hi):
                        if not _stands(x, order[p:q] + a, b, words, raw, width):
                            out.append((key[row + k].as_py(), x["print"], x["len"], x["digest"]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    return work


def _stands(x, places, end, words, raw, width) -> bool:
    for at in places:
        past = int(at) + x["len"] - 1 + width
        if past <= end:
            text = b" ".join([raw[s:e] for s, e in zip(words.starts[at:past].tolist(), words.ends[at:past].tolist())])
            if hashlib.blake2b(text, digest_size=16).digest() == x["digest"]:
                return True
    return False


def _refuted(texts: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """The stated runs (src, print, len, digest) that stand in no text of ``src``, as a written table.

    A source with more than ``ASKED`` runs is asked in several places, its
    text being sent to each; such sources are few, as each stands for so many
    runs.
    """
    what = F.struct("print", "len", "digest")
    asked = cut(runs.select("src", "print", "len", "digest").distinct(), "asked")
    own = texts.select(F.col("doc_id").alias("src"), "text")
    busy = cut(asked.groupBy("src").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("salts")).where("salts > 1"), "busy")
    if busy.isEmpty():
        posed = own.join(asked.groupBy("src").agg(F.collect_list(what).alias("asked")), "src")
    else:
        salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("print", "len", "digest"), F.col("salts")).cast("int")).otherwise(0)
        grouped = attach(asked, busy, ["src"]).withColumn("salt", salt).groupBy("src", "salt").agg(F.max("salts").alias("salts"), F.collect_list(what).alias("asked"))
        dealt = attach(own, busy, ["src"]).where("salts is not null").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        posed = own.join(grouped.where("salts is null").select("src", "asked"), "src").unionByName(dealt.join(grouped.where("salts is not null").select("src", "salt", "asked"), ["src", "salt"]).drop("salt"))
    wrong = posed.select(F.col("src").alias("doc_id"), "text", "asked").mapInArrow(_confirm(width), WRONG)
    wrong = cut(wrong.groupBy("src", "print", "len", "digest").agg(F.count("*").alias("times")), "wrong")
    discard(asked)
    if wrong.isEmpty():
        return wrong.drop("times")
    # An id may have several rows: a run is refuted if none of them holds it.
    rows = texts.join(wrong.select(F.col("src").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("src")).agg(F.count("*").alias("rows"))
    return cut(wrong.join(rows, "src").where("times = rows").select("src", "print", "len", "digest"), "refuted")


def partitions_for(docs: DataFrame) -> int:
    """How many hash partitions the index of ``docs`` needs, from the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(64, -(-total // PARTITION_BYTES))


def _batches(docs: DataFrame, ends: tuple[float, ...]) -> list[DataFrame]:
    """``docs`` in batches by ascending doc_id; one batch where the ids leave no room for more."""
    marks = sorted(set(docs.agg(F.percentile_approx("doc_id", list(ends))).first()[0] or []))
    edges = [None, *marks, None]
    out = []
    for lo, hi in zip(edges, edges[1:]):
        part = docs if lo is None else docs.where(F.col("doc_id") > lo)
        out.append(part if hi is None else part.where(F.col("doc_id") <= hi))
    return out


def remove_repeats(docs: DataFrame, width: int = 13, with_text: bool = False, log: FingerprintLog | None = None, earlier: DataFrame | None = None, parts: int | None = None, ends: tuple[float, ...] = BATCH_ENDS) -> DataFrame:
    """Remove each word under a window of ``width`` words that an earlier document also has.

    Returns one row per row of ``docs``: ``row`` (all its columns, as a
    struct), doc_id, n_words, n_removed, kept_sha256, kept_text (the kept
    words joined by one space, if ``with_text`` and if any word went, else
    null). Words are runs of bytes other than ASCII white space; windows are
    judged on the input. Earlier means a smaller doc_id.

    Without ``log`` the table is fed in batches by ascending id to a log of
    its own, which is deleted at the end. With one, ``docs`` is the next
    batch of that log and joins it; ``earlier`` (doc_id, text) holds the texts
    of its documents, on which matches with history are verified.

    Null text is empty. A row without doc_id is kept whole and is nobody's
    source. Rows that repeat a doc_id, with one text or several, are one
    document: neither removes the other's words, each is a source, and each
    loses what a smaller doc_id has. Texts shorter than the window lose
    nothing. An empty table gives an empty table.

    A window that many documents have costs one entry for each
    ``COMBINE_BYTES`` of text, as equal windows are combined before the
    shuffle, and a source that very many runs name is asked in several places.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = plain.where("doc_id is not null")
    if log is None:
        own = FingerprintLog.create(spark, f"{shared_dir(spark)}/log-{uuid.uuid4().hex}", width, parts or partitions_for(docs))
        fed = _batches(texts, ends)
        found = []
        for k, batch in enumerate(fed):
            found.append(own.add(batch, keep=k < len(fed) - 1))
            release(spark)
        marked = found[0]
        for more in found[1:]:
            marked = marked.unionByName(more)
    else:
        if log.width != width or (earlier is None and log.runs):
            raise ValueError("a log has one width, and its documents' texts must be given")
        own, found = None, []
        known = earlier
        marked = log.add(texts)
        if known is not None:
            texts = texts.unionByName(known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    marks = marked.groupBy("doc_id").agg(F.collect_list(F.struct("n", "prints", "owners")).alias("found"))
    kind = "array<struct<at: int, len: int>>"
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if with_text or c == "doc_id"]).alias("row")
    held = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = f"row {held.schema['row'].dataType.simpleString()}, {OWN}"
    work = _remove(width, with_text)
    out = cut(held.join(marks, "doc_id", "left").withColumns({"split": F.lit(None).cast(kind), "bad": F.lit(None).cast(kind)}).mapInArrow(work, schema), "kept")
    release(spark)
    stated = out.select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.*")
    wrong = _refuted(texts, stated, width)
    settled = wrong.isEmpty()
    if not settled:
        # A run may be made of windows that stand apart in the source: those are asked for one by one.
        split = stated.join(wrong, ["src", "print", "len", "digest"]).groupBy("doc_id").agg(F.collect_set(F.struct("at", "len")).alias("split"))
        again = held.join(split, "doc_id").join(marks, "doc_id")
        single = again.withColumn("bad", F.lit(None).cast(kind)).mapInArrow(work, schema).select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.*").where("len = 1")
        single = cut(single, "single")
        false = _refuted(texts, single, width)
        settled = false.isEmpty()
        if not settled:
            bad = single.join(false, ["src", "print", "len", "digest"]).groupBy("doc_id").agg(F.collect_set(F.struct("at", "len")).alias("bad"))
            fixed = held.join(bad, "doc_id").join(marks, "doc_id").withColumn("split", F.lit(None).cast(kind)).mapInArrow(work, schema)
            out = out.join(bad, "doc_id", "left_anti").unionByName(fixed)
    if settled and own is not None:
        discard(*[x for x in found if hasattr(x, "_cut_path")])
        own.drop()
    release(spark)
    return out.drop("runs")
