"""Nearest neighbours of a mixture: most vectors around centres, a few alone, whose neighbours are far."""

import numpy as np
from pyspark.sql import functions as F

from gaugeflow.llm import ann


def test_lone_vectors_find_their_neighbours(spark):
    rnd = np.random.default_rng(9)
    n = 4000
    x = rnd.normal(size=(40, 32))[rnd.integers(0, 40, n)] + 0.3 * rnd.normal(size=(n, 32))
    alone = rnd.random(n) < 0.05
    x[alone] = rnd.normal(size=(alone.sum(), 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = {}
    for i in range(0, n, 20):
        s = x @ x[i]
        s[i] = -9
        recall[i] = len(got[i] & set(np.argsort(-s)[:20].tolist())) / 20
    assert np.mean(list(recall.values())) >= 0.95 and min(recall.values()) >= 0.5
    assert min(recall[i] for i in recall if alone[i]) >= 0.5 and any(alone[i] for i in recall)


def test_what_is_trusted():
    near, far = np.linspace(0.8, 0.9, 900), np.linspace(0.2, 0.3, 100)
    cosines = np.concatenate([near, far])
    assert 0.3 < ann._trusted(cosines, cosines > 0.5) <= 0.8
    assert ann._trusted(near, near > 0) < 0.8
