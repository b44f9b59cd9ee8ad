"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are split into bands of nearly one length, so that within a band the
largest inner product is the smallest angle. Fast pseudo-rotations (three
rounds of random signs and a Hadamard transform) turn their directions; the
signed axis nearest to each of several rotations, taken together, is a
vector's bucket in a table. A query probes the buckets that its rotations
miss least, in every table and band, and meets all vectors of bands too small
to be worth hashing; what it meets is ranked by exact inner products.

How many axes make a bucket follows from the number of vectors, and how many
buckets a query probes from the recall of a bounded sample of queries, which
are compared with every vector.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import attach, cut

TABLES = 20
#: Recall that the sample must reach, how many queries it has, and the most buckets probed in a table.
RECALL = 0.95
SAMPLE = 64
#: A neighbour as near as a query's last one must have been found this often in the sample; else the query is compared with all vectors.
FOUND_EACH = 0.7
MOST_PROBES = 512
#: Longest to shortest vector of a band, and from how many vectors on a band is hashed.
RATIO = 1.1
HASHED_FROM = 256
#: How many different vector sizes are hashed, the commonest first; vectors of others are compared whole.
MOST_SIZES = 16
#: Vectors, and queries, of one bucket that meet in one task.
BLOCK = 4096
ASKING = 1024
#: Candidates that a block keeps for a query beyond those asked for, against rounding.
SPARE = 12


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, of a power-of-two length, scaled to keep lengths."""
    n, d = rows.shape
    step = 1
    while step < d:
        pairs = rows.reshape(n, d // (2 * step), 2, step)
        rows = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, d)
        step *= 2
    return rows / np.sqrt(d)


class Rotations:
    """The pseudo-rotations of all tables; the same for the same size and seed."""

    def __init__(self, dim: int, tables: int, axes: int, seed: int = 97):
        self.size = 1 << (dim - 1).bit_length()
        self.axes = axes
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), size=(tables, axes, 3, self.size))

    def directions(self, rows: np.ndarray) -> np.ndarray:
        """The rows at length one, filled with zeros; scaled first, so that no square is out of range."""
        out = np.zeros((len(rows), self.size))
        rows = rows / np.abs(rows).max(axis=1, keepdims=True)
        out[:, : rows.shape[1]] = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        return out

    def turned(self, rows: np.ndarray, table: int, axis: int) -> np.ndarray:
        """Products with all signed axes: the positive ones, then the negative ones."""
        for signs in self.signs[table, axis]:
            rows = hadamard(rows * signs)
        return np.concatenate([rows, -rows], axis=1)

    def bucket(self, rows: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(rows), dtype=np.int64)
        for axis in range(self.axes):
            out = out * (2 * self.size) + self.turned(rows, table, axis).argmax(axis=1)
        return out

    def probes(self, rows: np.ndarray, table: int, count: int) -> np.ndarray:
        """The ``count`` buckets of least loss (or all there are), nearest first: the squares by which each axis falls short, summed."""
        loss, code = np.zeros((len(rows), 1)), np.zeros((len(rows), 1), dtype=np.int64)
        for axis in range(self.axes):
            near = self.turned(rows, table, axis)
            own = (near.max(axis=1, keepdims=True) - near) ** 2
            few = min(count, own.shape[1])
            at = np.argsort(own, axis=1, kind="stable")[:, :few]
            own = np.take_along_axis(own, at, axis=1)
            both = (loss[:, :, None] + own[:, None, :]).reshape(len(rows), -1)
            name = (code[:, :, None] * (2 * self.size) + at[:, None, :]).reshape(len(rows), -1)
            few = min(count, both.shape[1])
            best = np.argpartition(both, few - 1, axis=1)[:, :few]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(both, best, axis=1), axis=1, kind="stable"), axis=1)
            loss, code = np.take_along_axis(both, best, axis=1), np.take_along_axis(name, best, axis=1)
        return code


def _placer(dim: int, tables: int, axes: int):
    """(cell, fine, band, rep, v): a cell is a table and all axes of a bucket but the last, which is ``fine``."""

    def work(frames):
        turn = Rotations(dim, tables, axes)
        for frame in frames:
            for a in range(0, len(frame), 2048):
                part = frame.iloc[a : a + 2048]
                if not len(part):
                    continue
                rows = turn.directions(np.stack(part["v"].to_numpy()).astype(float))
                for t in range(tables):
                    code = turn.bucket(rows, t)
                    yield pd.DataFrame({"cell": code // (2 * turn.size) * tables + t, "fine": (code % (2 * turn.size)).astype(np.int32), "band": part["band"].to_numpy(), "rep": part["rep"].to_numpy(), "v": part["v"].to_numpy()})

    return work


def _prober(dim: int, tables: int, axes: int, probes: int):
    """(cell, q, qv, fines): a query goes once to each cell that it probes, with the last axes it wants there."""

    def work(frames):
        turn = Rotations(dim, tables, axes)
        for frame in frames:
            for a in range(0, len(frame), 64):
                part = frame.iloc[a : a + 64]
                if not len(part):
                    continue
                rows = turn.directions(np.stack(part["v"].to_numpy()).astype(float))
                for t in range(tables):
                    code = np.sort(turn.probes(rows, t, probes), axis=1)
                    coarse, fine = code // (2 * turn.size), (code % (2 * turn.size)).astype(np.int32)
                    cells, q, fines = [], [], []
                    for k in range(len(part)):
                        edge = np.flatnonzero(np.diff(coarse[k], prepend=-1))
                        cells.append(coarse[k][edge] * tables + t)
                        q.append(np.full(len(edge), k))
                        fines.extend(np.split(fine[k], edge[1:]))
                    q = np.concatenate(q)
                    yield pd.DataFrame({"cell": np.concatenate(cells), "q": part["rep"].to_numpy()[q], "qv": part["v"].to_numpy()[q], "fines": fines})

    return work


def _best_of(score: np.ndarray, rep: np.ndarray, k: int) -> np.ndarray:
    """Where the ``k`` largest scores are, ties to the smaller ``rep``."""
    if len(rep) <= k:
        return np.arange(len(rep))
    at = np.argpartition(-score, k - 1)[:k]
    if (score >= score[at].min()).sum() > k:
        at = np.lexsort((rep, -score))[:k]
    return at


def _meet(keep: int):
    """The best ``keep`` vectors of a block for each of its queries, among those with a last axis that the query wants."""

    def work(key: tuple[Any, ...], queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(block):
            block = block.sort_values(["fine", "rep"])
            c, rep, fine = np.stack(block["v"].to_numpy()).astype(float), block["rep"].to_numpy(), block["fine"].to_numpy()
            for a in range(0, len(queries), 512):
                part = queries.iloc[a : a + 512]
                rows = np.stack(part["qv"].to_numpy()).astype(float)
                if part["fines"].iloc[0] is None:
                    for q, s in zip(part["q"], rows @ c.T):
                        b = _best_of(s, rep, keep)
                        out.append((q, rep[b], s[b]))
                    continue
                for q, row, wanted in zip(part["q"], rows, part["fines"]):
                    lo, hi = np.searchsorted(fine, wanted), np.searchsorted(fine, wanted, side="right")
                    if (hi > lo).any():
                        at = np.concatenate([np.arange(x, y) for x, y in zip(lo, hi) if y > x])
                        s = c[at] @ row
                        b = _best_of(s, rep[at], keep)
                        out.append((q, rep[at][b], s[b]))
        return pd.DataFrame(out, columns=["q", "reps", "scores"])

    return work


def _best(keep: int):
    """The best ``keep`` distinct vectors of each query over all its blocks."""

    def work(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["reps"].map(len).to_numpy()
        flat = pd.DataFrame({"q": np.repeat(rows["q"].to_numpy(), sizes), "rep": np.concatenate(rows["reps"].to_list()), "s": np.concatenate(rows["scores"].to_list())})
        flat = flat.sort_values(["q", "rep", "s"]).drop_duplicates(["q", "rep"], keep="last").sort_values(["q", "s", "rep"], ascending=[True, False, True])
        return flat.groupby("q", sort=False).head(keep)[["q", "rep"]]

    return work


def _usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    v = F.col("v")
    kind = "array<float>" if vectors.schema[column].dataType.simpleString() == "array<float>" else "array<double>"
    held = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast(kind).alias("v")).where("id is not null and v is not null")
    sound = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return held.where(sound).distinct()


def _smallest_ids(held: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors with their ``keep`` smallest ids; equal vectors are equally near, so more are never needed."""
    step = held.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["v", "salt"], ["v"]):
        step = step.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("r") <= keep).drop("r")
    return step.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("rep"), "v", "ids", F.size("v").alias("d"))


def _exact_top(queries: list, k: int):
    """The best ``k`` vectors of each part of the index for each of a few queries."""

    def work(frames):
        asked = np.array([r["v"] for r in queries], dtype=float)
        for frame in frames:
            if len(frame):
                rep = frame["rep"].to_numpy()
                for r, s in zip(queries, asked @ np.stack(frame["v"].to_numpy()).astype(float).T):
                    b = _best_of(np.where(rep == r["rep"], -np.inf, s), rep, k)
                    yield pd.DataFrame({"q": r["rep"], "rep": rep[b], "s": s[b]})

    return work


def tune(index: DataFrame, queries: DataFrame, dim: int, n: int, k: int, tables: int, recall: float) -> tuple[int, int]:
    """(axes of a bucket, buckets probed in a table) by which a sample of queries finds ``recall`` of its nearest.

    The sample is ``SAMPLE`` queries, those with the smallest hash of their
    id; they are compared with all ``n`` vectors. As many axes are taken as
    give every vector a bucket of its own, on average; one less, if
    ``MOST_PROBES`` buckets do not reach the recall, and so on. With one axis
    all buckets can be probed.
    """
    return _tuned(index, queries, dim, n, k, tables, recall)[:2]


def _trusted(cosines: np.ndarray, found: np.ndarray) -> float:
    """The least cosine down to which neighbours of the sample were found ``FOUND_EACH`` of the time, in twenty steps of equally many.

    Below all cosines that the sample has seen nothing is known, so nothing is trusted.
    """
    order = np.argsort(cosines)
    steps = [s for s in np.array_split(order, 20) if len(s)]
    bad = [k for k, s in enumerate(steps) if found[s].mean() < FOUND_EACH]
    return float(cosines[steps[bad[-1]]].max()) + 1e-9 if bad else float(cosines.min()) - 0.02


def _tuned(index: DataFrame, queries: DataFrame, dim: int, n: int, k: int, tables: int, recall: float) -> tuple[int, int, float]:
    """Axes, probes and the least cosine at which neighbours are surely found."""
    picked = queries.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("rep", "v").collect()
    size = 2 << (dim - 1).bit_length()
    axes = max(1, math.ceil(math.log(n) / math.log(size)))
    if not picked:
        return axes, 1, -2.0
    near = index.select("rep", "v").mapInPandas(_exact_top(picked, k), "q long, rep long, s double")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "rep"))).where(F.col("r") <= k)
    # At most SAMPLE * k rows.
    pairs = index.select("rep", "v").join(F.broadcast(near.select("q", "rep")), "rep").select("q", "v").collect()
    place = {r["rep"]: i for i, r in enumerate(picked)}
    own = np.array([place[r["q"]] for r in pairs], dtype=int)
    unit = lambda rows: (x := np.array([r["v"] for r in rows], dtype=float).reshape(len(rows), dim)) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    cosines = (unit(picked)[own] * unit(pairs)).sum(axis=1)
    for axes in range(axes, 0, -1):
        turn = Rotations(dim, tables, axes)
        most = min(MOST_PROBES, size**axes) if axes > 1 else size
        asked = turn.directions(np.array([r["v"] for r in picked], dtype=float))
        held = turn.directions(np.array([r["v"] for r in pairs], dtype=float).reshape(len(pairs), dim))
        rank = np.full(len(pairs), most)
        for t in range(tables):
            order, code = turn.probes(asked, t, most), turn.bucket(held, t)
            same = order[own] == code[:, None]
            rank = np.minimum(rank, np.where(same.any(axis=1), same.argmax(axis=1), most))
        for probes in sorted({*(2**x for x in range(20) if 2**x < most), *(3 * 2**x for x in range(20) if 3 * 2**x < most), most}):
            if (rank < probes).mean() >= recall:
                return axes, probes, _trusted(cosines, rank < probes)
    return 1, size, -2.0


def nearest(vectors: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", column: str = "embedding", tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``k`` nearest found, by largest inner product.

    ``is_query``: a condition on the id column, as a Column of ``vec_id``.
    Scores are inner products of the original vectors in double precision;
    ties go to the smaller id; a row is never its own neighbour. Vectors
    that are null, zero, or hold null or non-finite components take no part,
    nor do those without an id. Vectors of different sizes are not compared:
    each size is searched by itself. A query that meets fewer than ``k``
    others in its buckets, or whose last neighbour is so far that the sample
    missed many like it, is compared with all vectors of its size, block by
    block, so it gets ``k`` or all there are, and a rare vector its own. An id that repeats with one
    vector counts once; with several, its nearest counts. An empty table
    gives an empty table.

    Vectors are hashed in bands of lengths within ``RATIO`` of one another,
    and each band is probed, so long vectors do not hide shorter ones. Bands
    with fewer than ``HASHED_FROM`` vectors, such as a few outliers, are
    compared with all queries, as are sizes beyond the ``MOST_SIZES``
    commonest.

    Equal vectors are indexed once. A vector is sent to one cell of each
    table, a query to the cells that it probes. A cell with many vectors or
    queries is dealt over blocks of both, and every two blocks meet, so no
    candidate is capped and no task holds a whole hot cell.
    """
    spark = vectors.sparkSession
    index = cut(_smallest_ids(cut(_usable(vectors, id_column, column), "vectors"), k + 1), "index")
    sound = _usable(vectors, id_column, column).select(F.col("id").alias("vec_id"), "v").where(is_query)
    asked = cut(sound.join(index.select(F.col("rep").alias("q"), "v"), "v").select("vec_id", "q"), "asked")
    wanted = cut(index.join(asked.select(F.col("q").alias("rep")).distinct(), "rep", "left_semi").select("rep", "v", "d"), "wanted")
    if wanted.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    met, hashed, trusted = [], [], F.lit(-2.0)
    common = index.groupBy("d").count().where(F.col("count") >= HASHED_FROM).orderBy(F.desc("count"), "d").limit(MOST_SIZES).collect()
    for dim, n in common:
        mine = wanted.where(F.col("d") == dim)
        found, floor = _met_by_hash(index.where(F.col("d") == dim), mine, dim, n, k, tables, recall)
        if found:
            met.extend(found)
            hashed.append(dim)
            trusted = F.when(F.col("d") == dim, floor).otherwise(trusted)
    left = [x.where(~F.col("d").isin(hashed)) for x in (wanted, index)] if hashed else [wanted, index]
    if not left[0].isEmpty():
        met.append(_met_all(*left, k))
    together = met[0]
    for more in met[1:]:
        together = together.unionByName(more)
    found = cut(_top(together, wanted, k), "found")

    reach = found.join(index.select("rep", "v", F.size("ids").alias("n")), "rep").join(wanted.select(F.col("rep").alias("q"), F.col("v").alias("qv"), "d"), "q")
    # At most k + 1 + SPARE for each query; its own vector is one of them.
    reach = reach.groupBy("q", "d").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(_cosine("v", "qv")), asc=False).alias("c"))
    last = F.get("c", F.least(F.size("c"), F.lit(k + 1)) - 1)
    sure = reach.where((F.col("n") > k) & ~F.isnan(last) & (last >= trusted))
    short = cut(wanted.join(sure.select(F.col("q").alias("rep")), "rep", "left_anti"), "short")
    if not short.isEmpty():
        whole = cut(_top(_met_all(short, index, k), short, k), "whole")
        found = found.join(short.select(F.col("rep").alias("q")), "q", "left_anti").unionByName(whole)

    exact = F.aggregate(F.zip_with("qv", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    scored = found.join(index.select("rep", "v", "ids"), "rep").join(wanted.select(F.col("rep").alias("q"), F.col("v").alias("qv")), "q").select("q", exact.alias("score"), F.explode("ids").alias("near"))
    scored = scored.groupBy("q", "near").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "near")
    ranked = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = ranked.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "near", "score"))).alias("l"))
    each = asked.select(F.col("vec_id").alias("query_id"), "q").join(lists, "q")
    each = each.withColumn("l", F.slice(F.filter("l", lambda x: x["near"] != F.col("query_id")), 1, k))
    # An id with several vectors keeps the nearest of what each of them found.
    flat = each.select("query_id", F.explode("l").alias("x")).groupBy("query_id", F.col("x.near").alias("vec_id")).agg(F.max("x.score").alias("score"))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return flat.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cosine(a: str, b: str) -> Column:
    """Cosine of two vectors; null or not finite where a square is out of range."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, p: t + p)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _banded(index: DataFrame) -> DataFrame:
    """(rep, v, band): the band of each vector's length, counted down from the longest's."""
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    # The logarithm, of components scaled by the largest, is in range for all vectors.
    length = F.log("most") + F.log(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most")))) / 2
    sized = index.select("rep", "v", most.alias("most")).select("rep", "v", length.alias("length"))
    longest = sized.agg(F.max("length")).first()[0] + 1e-12
    return sized.select("rep", "v", F.floor((F.lit(longest) - F.col("length")) / float(np.log(RATIO))).cast("int").alias("band"))


def _met_by_hash(index: DataFrame, queries: DataFrame, dim: int, n: int, k: int, tables: int, recall: float) -> tuple[list[DataFrame], float]:
    """What queries of one vector size meet in their buckets and in sparse bands, nothing if no band is worth hashing; and the cosine down to which that is trusted."""
    banded = cut(_banded(index), "banded")
    sizes = banded.groupBy("band").count()
    dense = sorted(r["band"] for r in sizes.where(F.col("count") >= HASHED_FROM).collect())
    if not dense:
        return [], -2.0
    full = banded.where(F.col("band").isin(dense))
    axes, probes, floor = _tuned(full, queries, dim, n, k, tables, recall)
    placed = cut(full.select("rep", "v", "band").mapInPandas(_placer(dim, tables, axes), f"cell long, fine int, band int, rep long, v {index.schema['v'].dataType.simpleString()}"), "placed")
    probe = queries.select("rep", "v").mapInPandas(_prober(dim, tables, axes, probes), f"cell long, q long, qv {index.schema['v'].dataType.simpleString()}, fines array<int>")
    probe = cut(probe.withColumn("band", F.explode(F.array(*map(F.lit, dense)))), "probe")
    cell = ["band", "cell"]
    many = placed.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    busy = probe.groupBy(*cell).agg(F.ceil(F.count("*") / ASKING).cast("int").alias("parts")).where("parts > 1")
    met = [_met(*(_dealt(x, many, busy, cell, own, other) for x, own, other in ((probe, ("q", "parts", "part"), ("blocks", "block")), (placed, ("rep", "blocks", "block"), ("parts", "part")))), k)]
    if not (loose := banded.where(~F.col("band").isin(dense))).isEmpty():
        met.append(_met_all(queries, loose.withColumn("d", F.lit(dim)), k))
    return met, floor


def _dealt(rows: DataFrame, many: DataFrame, busy: DataFrame, cell: list[str], own: tuple, other: tuple) -> DataFrame:
    """The rows with the block that each is dealt to and, one row for each, the blocks of the other side."""
    key, count, name = own
    rows = attach(attach(rows, many, cell), busy, cell)
    dealt = rows.withColumn(name, F.coalesce(F.pmod(F.xxhash64(key), F.col(count)), F.lit(0)).cast("int"))
    return dealt.withColumn(other[1], F.explode(F.sequence(F.lit(0), F.coalesce(other[0], F.lit(1)) - 1))).drop("blocks", "parts")


def _met_all(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """What all ``queries`` meet among all ``vectors`` of their size; both are dealt over blocks, and every two blocks meet."""
    blocks, parts = (max(1, -(-x.count() // y)) for x, y in ((vectors, BLOCK), (queries, ASKING)))
    block = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    all_of = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    size = F.col("d").alias("band"), F.lit(-1).cast("long").alias("cell")
    asking = queries.select(*size, F.col("rep").alias("q"), F.col("v").alias("qv"), F.lit(None).cast("array<int>").alias("fines"), block("rep", parts).alias("part"), all_of(blocks).alias("block"))
    every = vectors.select(*size, F.lit(0).alias("fine"), "rep", "v", block("rep", blocks).alias("block"), all_of(parts).alias("part"))
    return _met(asking, every, k)


def _met(probe: DataFrame, dealt: DataFrame, k: int) -> DataFrame:
    key = ["band", "cell", "part", "block"]
    right = dealt.select(*[F.col(c).alias(f"{c}_") for c in key], "fine", "rep", "v").groupBy(*[f"{c}_" for c in key])
    return probe.select(*key, "q", "qv", "fines").groupBy(*key).cogroup(right).applyInPandas(_meet(k + 1 + SPARE), "q long, reps array<long>, scores array<double>")


def _top(met: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """A task takes about a thousand queries, each with a few rows for every block that it met."""
    groups = F.pmod(F.xxhash64("q"), F.lit(max(1, -(-queries.count() // 1000))))
    return met.withColumn("g", groups).groupBy("g").applyInPandas(_best(k + 1 + SPARE), "q long, rep long")
