"""Native ANLS* of JSON documents against the row evaluator."""

import json
import random

from pyspark.sql import functions as F

from gaugeflow.operators import anls, trees

SCALARS = ["a", "Alpha  beta", "", "alphabet", 1, 10, 2.5, 1.0, -0.25, 1e20, 123456789012345678901, True, False, None]


def value(rnd, depth):
    if depth and rnd.random() < 0.45:
        return {k: value(rnd, depth - 1) for k in rnd.sample("abcd", rnd.randint(0, 3))}
    return rnd.choice(SCALARS)


def changed(x, rnd):
    if isinstance(x, dict):
        out = {k: changed(v, rnd) for k, v in x.items() if rnd.random() < 0.85}
        if rnd.random() < 0.3:
            out[rnd.choice("efg")] = value(rnd, 1)
        return out
    return x if rnd.random() < 0.7 else rnd.choice([*SCALARS, [1, "x"], [], {"z": [1, {"y": 2}]}])


def test_trees_as_the_row_evaluator(spark):
    rnd = random.Random(17)
    rows = []
    for k in range(150):
        gt = value(rnd, 3)
        rows.append((k, json.dumps(gt), json.dumps(changed(gt, rnd))))
    rows += [(900, None, None), (901, None, '"x"'), (902, "{}", "{}"), (903, "{}", "[]"), (904, '{"a": {}}', '{"a": {}, "b": null}'), (905, '{"a.b": {"c": 1}}', '{"a.b": {"c": 1.0}}')]
    lists = [(950, "[1]", "[1]"), (951, '["a", "b"]', '"a"'), (952, '{"x": [1]}', '{"x": [2]}'), (953, "{broken", "{}")]
    df = spark.createDataFrame(rows + lists, "doc_id long, expected string, predicted string").repartition(3)
    found = trees.compare_trees(df)
    want = df.where("doc_id < 950").select(F.col("doc_id").cast("string").alias("doc_id"), anls.anls_json(F.col("expected"), F.col("predicted")).alias("r")).collect()
    scores = {r.doc_id: round(r.score, 9) for r in found.scores.collect()}
    assert scores == {r.doc_id: round(r.r.score, 9) for r in want}
    keys = {(r.doc_id, r.path): round(r.score, 9) for r in found.keys.collect()}
    assert keys == {(r.doc_id, ".".join(k.path)): round(k.score, 9) for r in want for k in r.r["keys"]}
    assert {r.doc_id for r in found.others.collect()} == {"950", "951", "952", "953"}
    assert "Python" not in found.scores._jdf.queryExecution().toString()
