"""Inversions and rank agreement against all pairs, and a long section."""

import time

import numpy as np
from pyspark.sql import functions as F

from gaugeflow.functions.ranks import agreement, inversions
from gaugeflow.operators import packet


def test_inversions_against_all_pairs():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 8, 9, 50):
        v = rnd.integers(-3, 9, n)
        assert list(inversions(v)) == [sum(v[:k] > v[k]) for k in range(n)]


def test_agreement_against_all_pairs():
    rnd = np.random.default_rng(2)
    sizes = [0, 1, 2, 5, 0, 12, 30]
    offsets = np.cumsum([0, *sizes])
    x, y = rnd.integers(0, 6, offsets[-1]).astype(float), rnd.integers(0, 6, offsets[-1]).astype(float)
    got = agreement(offsets, x, y)
    for g, n in enumerate(sizes):
        a, b = x[offsets[g] : offsets[g + 1]], y[offsets[g] : offsets[g + 1]]
        pairs = [(i, j) for i in range(n) for j in range(i)]
        want = sum(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i, j in pairs), sum(a[i] == a[j] for i, j in pairs), sum(b[i] == b[j] for i, j in pairs)
        assert tuple(v[g] for v in got) == want


def test_a_long_section_and_missing_numbers(spark):
    n = 100_000
    pages = spark.range(n).select(F.lit(1).alias("packet_id"), F.lit("a").alias("group_id"), F.col("id").alias("page_number"), (F.lit(n) - F.col("id")).alias("page_number_predicted"))
    odd = spark.createDataFrame([(2, "a", 1, 1), (2, "a", None, 2), (2, "b", None, None), (2, "c", 1, 5), (2, "c", 2, 5), (2, "d", 1, 7), (2, "d", 2, 9)], "packet_id int, group_id string, page_number long, page_number_predicted long")
    start = time.time()
    got = {(r.packet_id, r.group_id): r.kendall_tau for r in packet.ordering(pages.unionByName(odd)).collect()}
    assert got == {(1, "a"): -1.0, (2, "a"): 0.0, (2, "b"): 1.0, (2, "c"): 0.0, (2, "d"): 1.0}
    assert time.time() - start < 30
