"""Near-duplicate documents by circulant MinHash.

Every text becomes the set of its distinct word shingles. A signature takes
two permutations only: the first places a shingle on a ring, the second,
rotated by one step for each coordinate, ranks the places; a coordinate is
the least rank. Because neighbouring coordinates read neighbouring cells of
the rotated permutation, a shingle's part in all coordinates is one slice of
memory. Signatures are cut into bands; texts that share a band are compared
on their full sets, and linked texts form components.
"""

from __future__ import annotations

import hashlib
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, Words, chunks, cut, discard, ids, mix, ngrams, release, text_buffers
from .graph import connected_components

RING = 1 << 20
COORDINATES = 180
#: Members that are checked against their leader in one place.
GROUP = 64
#: Classes of one bucket, on either side, that are compared in a task.
BLOCK = 512


def bands_for(threshold: float, coordinates: int = COORDINATES, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): the longest bands that lose a pair at the threshold with probability under ``miss``."""
    rows = 1
    while (1 - threshold ** (rows + 1)) ** (coordinates // (rows + 1)) <= miss:
        rows += 1
    return coordinates // rows, rows


class Circulant:
    """The two permutations: ``place`` by hashing, ``rank`` as a table that is read in rotation."""

    _cache: dict[int, "Circulant"] = {}

    def __init__(self, coordinates: int):
        rank = np.random.default_rng(7919).permutation(RING).astype(np.uint32)
        ring = np.concatenate([rank, rank[:coordinates]])
        self.turns = np.lib.stride_tricks.sliding_window_view(ring, coordinates)
        self.coordinates = coordinates

    @classmethod
    def of(cls, coordinates: int) -> "Circulant":
        if coordinates not in cls._cache:
            cls._cache[coordinates] = cls(coordinates)
        return cls._cache[coordinates]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        place = (shingles >> np.uint64(44)).astype(np.int64)
        out = np.full(self.coordinates, RING, dtype=np.uint32)
        for k in range(0, len(place), 8192):
            np.minimum(out, self.turns[place[k : k + 8192]].min(axis=0), out=out)
        return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int):
    """For each text: (number of words, sorted distinct shingle hashes).

    A text with fewer than ``n`` words has its whole sequence as its only
    shingle; one without words has none.
    """
    words = Words(data, offsets)
    hashed = words.hashes()
    grams = ngrams(hashed, n)
    for k in range(len(offsets) - 1):
        a, b = words.first[k], words.first[k + 1]
        if b - a >= n:
            yield b - a, np.unique(grams[a : b - n + 1])
        elif b > a:
            yield b - a, ngrams(hashed[a:b], int(b - a), salt=0x5851F42D4C957F2D)
        else:
            yield 0, np.empty(0, dtype=np.uint64)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def _signer(n: int, coordinates: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])
    power = np.random.default_rng(104729).integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
    tag = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def sign(batches):
        circulant = Circulant.of(coordinates)
        for batch in batches:
            key = ids(batch)
            for row, past, data, offsets in chunks(batch, "text", lower=True):
                sizes, keys, sigs, filled = [], [], [], []
                for k, (_, shingles) in enumerate(shingle_sets(data, offsets, n)):
                    sizes.append(len(shingles))
                    if len(shingles):
                        keys.append(set_key(shingles))
                        sigs.append(circulant.signature(shingles))
                        filled.append(k)
                    else:
                        # No set: a key of its own, spread over all partitions.
                        keys.append(b"none" + str(key[row + k].as_py()).encode())
                count = past - row
                ends = np.zeros(count + 1, dtype=np.int32)
                if sigs:
                    sig = np.stack(sigs)
                    joined = mix((sig[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64) * power).sum(axis=2, dtype=np.uint64) + tag)
                    ends[np.array(filled) + 1] = bands
                    flat = joined.reshape(-1).view(np.int64)
                else:
                    flat = np.empty(0, dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([key.slice(row, count), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists], schema=schema)

    return sign


def _verify(n: int, percent: int):
    """Checks the members of one group against its leader on full sets."""

    def check(key: tuple[Any, ...], left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = set()
        if len(left) and len(right):
            leads = [own for own in (_set_of(text, n) for text in left["text"].drop_duplicates()) if len(own)]
            for start in range(0, len(right), 64):
                part = right.iloc[start : start + 64]
                data, offsets = text_buffers(pa.array(part["text"], pa.string(), from_pandas=True))
                for doc, (_, own) in zip(part["doc_id"], shingle_sets(_LOWER[data], offsets, n)):
                    if any(_linked(lead, own, percent) for lead in leads):
                        out.add((key[0], doc))
        return pd.DataFrame(sorted(out), columns=["leader", "member"]).astype("int64")

    return check


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(b):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    common = int((a[at] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _set_of(text: str | None, n: int) -> np.ndarray:
    data, offsets = text_buffers(pa.array([text], pa.string()))
    return next(iter(shingle_sets(_LOWER[data], offsets, n)))[1]


def verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (leader, member) whose full sets reach the threshold.

    Pairs are grouped by leader. A leader with many members has several
    groups of about ``GROUP`` members, so no group grows with the data.
    """
    counts = pairs.groupBy("leader").agg(F.count("*").alias("cnt"))
    dealt = pairs.join(counts, "leader").select("leader", "member", F.pmod(F.xxhash64("member"), F.ceil(F.col("cnt") / GROUP)).alias("part"))
    dealt = cut(dealt, "dealt")
    wanted = dealt.select(F.col("member").alias("doc_id"), "leader", "part", F.lit(False).alias("leads")).unionByName(dealt.select(F.col("leader").alias("doc_id"), "leader", "part", F.lit(True).alias("leads")).distinct())
    texts = wanted.hint("merge").join(docs.select("doc_id", "text"), "doc_id")
    left = texts.where("leads").select(F.col("leader").alias("l"), F.col("part").alias("p"), F.col("text").alias("text")).groupBy("l", "p")
    right = texts.where("not leads").select("leader", "part", "doc_id", "text").groupBy("leader", "part")
    links = cut(left.cogroup(right).applyInPandas(_verify(n, percent), "leader long, member long"), "links")
    discard(dealt)
    return links


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's ``n`` smallest elements include one of every set that it can be linked with.

    Linked sets have ``percent`` of ``n`` elements in common, whichever set's
    ``n`` is taken. If the two prefixes of this size had none in common, the
    one that ends first would have all of its own left out of the overlap,
    which would then be too small. So no link is lost.
    """
    return n - -(-percent * n // 100) + 1


def _rest(n: int, percent: int):
    """The links across components between a block of a bucket's classes and a block of its minor ones.

    Minor are all but those of the bucket's largest component, so that its
    classes are not compared with one another. A pair is looked at in the
    first bucket that it shares, if its sizes leave a link possible and the
    prefixes of the sorted sets meet, and then compared on full sets.
    """

    def compare(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        bucket = key[0]
        rows = rows.sort_values(["asks", "rep"]).reset_index(drop=True)
        asks, rep, size, own = (rows[c].to_numpy() for c in ("asks", "rep", "n", "component"))
        first = int(asks.argmax()) if asks.any() else len(rows)
        out: list[tuple[int, int]] = []
        if not 0 < first < len(rows):
            return pd.DataFrame(out, columns=["leader", "member"]).astype("int64")
        data, offsets = text_buffers(pa.array(rows["text"], pa.string(), from_pandas=True))
        sets = [x for _, x in shingle_sets(_LOWER[data], offsets, n)]
        mine = [set_key(x) == k for x, k in zip(sets, rows["set_key"])]
        if not all(mine):
            # An id with several texts has met each of its sets with each of them.
            return compare(key, rows[mine])
        short = prefix_size(size, percent)
        bands = np.stack(rows["bands"].to_numpy())
        band = int(np.flatnonzero(bands[0] == bucket)[0])
        minor = rows["minor"].to_numpy()
        held = np.concatenate([x[:k] for x, k in zip(sets[:first], short)])
        holder = np.repeat(np.arange(first), short[:first])
        order = np.argsort(held, kind="stable")
        held, holder = held[order], holder[order]
        group = {c: c for c in rows["component"]}

        def root(c):
            while group[c] != c:
                group[c] = group[group[c]]
                c = group[c]
            return c

        for k in range(first, len(rows)):
            mine = sets[k][: short[k]]
            lo, hi = np.searchsorted(held, mine), np.searchsorted(held, mine, side="right")
            met = [holder[x:y] for x, y in zip(lo.tolist(), hi.tolist()) if y > x]
            if not met:
                continue
            at = np.unique(np.concatenate(met))
            # Of two minor classes each would meet the other; one direction will do.
            at = at[(own[at] != own[k]) & (~minor[at] | (rep[at] < rep[k])) & (100 * np.minimum(size[k], size[at]) >= percent * np.maximum(size[k], size[at]))]
            if len(at):
                at = at[(bands[at] == bands[k]).argmax(axis=1) == band]
            at = [j for j in at.tolist() if root(own[j]) != root(own[k])]
            for start in range(0, len(at), 256):
                part = at[start : start + 256]
                flat = np.concatenate([sets[j] for j in part])
                place = np.searchsorted(sets[k], flat)
                place[place == len(sets[k])] = 0
                edges = np.cumsum([0, *(len(sets[j]) for j in part)])[:-1]
                common = np.add.reduceat((sets[k][place] == flat).astype(np.int64), edges)
                for j, c in zip(part, common.tolist()):
                    if 100 * c >= percent * (len(sets[k]) + len(sets[j]) - c):
                        out.append((rep[k], rep[j]))
                        group[root(own[j])] = root(own[k])
        return pd.DataFrame(out, columns=["leader", "member"]).astype("int64")

    return compare


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, coordinates: int = COORDINATES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``docs`` needs doc_id and text; other columns are not read. Two texts are
    linked when ``100 * common >= percent * union`` over their distinct
    ``n``-word shingles (A-Z lower-cased, words between white space).

    1. Texts with equal sets are one class, found by a 128-bit digest.
    2. In every band bucket of more than one class, the class with the most
       company over all its buckets leads, and each other class is compared
       with it: one pair for each membership, never all pairs of a bucket.
    3. Buckets whose classes still lie in different components are looked at
       again, in blocks: classes outside the bucket's largest component meet
       all others whose sets can be linked with theirs, and are compared on
       full sets too.

    Joins that carry texts or bands are always shuffled, so the plan is the
    same at every size.

    Null and empty texts have no shingles and are linked with nothing. Rows
    without doc_id take no part: component_id is null and kept is true. Rows
    that repeat a doc_id, with one text or several, are one document: it is
    linked with what any of its texts is linked with, its rows share one
    class, and n_shingles is each row's own. An empty table gives an empty
    table.
    """
    bands, rows = bands_for(percent / 100, coordinates)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(texts.mapInArrow(_signer(n, coordinates, bands, rows), SIGNED), "signed")
    reps = cut(signed.where("doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("s")).select("set_key", "s.*"), "reps")
    member = reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(member.hint("merge").join(sizes, "bucket"), "shared")
    company = shared.groupBy("rep").agg(F.sum("size").alias("mass"))
    ranked = shared.join(company, "rep").select("bucket", "rep", "n", F.struct(-F.col("mass"), F.col("rep"), F.col("n")).alias("rank"))
    leaders = ranked.groupBy("bucket").agg(F.min("rank").alias("lead")).select("bucket", F.col("lead.rep").alias("leader"), F.col("lead.n").alias("ln"))
    pairs = (
        shared.join(leaders, "bucket")
        .where(f"rep <> leader and 100 * least(n, ln) >= {percent} * greatest(n, ln)")
        .select("leader", F.col("rep").alias("member"))
        .distinct()
    )
    pairs = cut(pairs, "pairs")
    links = verified(texts, pairs, n, percent)
    discard(pairs)
    release(docs.sparkSession)
    part = connected_components(links, "leader", "member")
    label = reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "set_key", "bands").join(part.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    label = cut(label, "label")
    release(docs.sparkSession)

    inside = shared.select("bucket", "rep").join(label.select("rep", "component"), "rep").groupBy("bucket", "component").agg(F.count("*").alias("own"))
    split = inside.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("own").alias("size"), F.max(F.struct("own", "component")).alias("large")).where("parts > 1 and size > 2")
    many = lambda c: F.ceil(c / BLOCK).cast("int")
    split = split.select("bucket", F.col("large.component").alias("large"), many(F.col("size")).alias("blocks"), many(F.col("size") - F.col("large.own")).alias("minors"))
    left_over = cut(shared.select("bucket", "rep").join(split, "bucket"), "open")
    held = more = None
    if not left_over.isEmpty():
        held = cut(left_over.select("rep").distinct().join(label, "rep").hint("merge").join(texts.select(F.col("doc_id").alias("rep"), "text").distinct(), "rep"), "held")
        dealt = left_over.join(label.select("rep", "component"), "rep").withColumn("minor", F.col("component") != F.col("large"))
        block = lambda of: F.pmod(F.xxhash64("rep"), F.col(of)).cast("int")
        all_of = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        every = dealt.select("bucket", "rep", "minor", F.lit(False).alias("asks"), block("blocks").alias("x"), all_of("minors").alias("y"))
        asking = dealt.where("minor").select("bucket", "rep", "minor", F.lit(True).alias("asks"), all_of("blocks").alias("x"), block("minors").alias("y"))
        more = every.unionByName(asking).join(held, "rep").groupBy("bucket", "x", "y").applyInPandas(_rest(n, percent), "leader long, member long").distinct()
        more = cut(more, "more")
        if not more.isEmpty():
            part = connected_components(links.unionByName(more), "leader", "member")

    named = reps.select("set_key", "doc_id").join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("set_key", F.coalesce("component", "doc_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    # The classes are few bytes a document; what led to them goes.
    out = cut(out, "classes")
    discard(signed, reps, shared, links, label, left_over, held, more)
    release(docs.sparkSession)
    return out


def deduplicate(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without those that near-duplicate an earlier doc_id.

    One document of each component stays, the one with the smallest doc_id;
    rows without doc_id stay.
    """
    drop = near_duplicates(docs, n, percent).where("not kept").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti")
