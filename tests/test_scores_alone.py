import json
import random

import pandas as pd

from gaugeflow.functions import assignment
from gaugeflow.operators import anls

TEXTS = [None, "", "a", "ab", "abc", "x y", "X  y", 1, 1.0, -0.0, 0, True, False, [], {}, "hello world", "hello wurld"]


def value(rnd, depth):
    kind = rnd.random()
    if not depth or kind < 0.5:
        return rnd.choice(TEXTS)
    if kind < 0.75:
        return {n: value(rnd, depth - 1) for n in rnd.sample("abcd", rnd.randint(0, 3))}
    return [value(rnd, depth - 1) for _ in range(rnd.randint(0, 4))]


def changed(rnd, v):
    if rnd.random() < 0.15:
        return value(rnd, 1)
    if isinstance(v, dict):
        return {k: changed(rnd, x) for k, x in v.items() if rnd.random() < 0.9}
    if isinstance(v, list):
        out = [changed(rnd, x) for x in v if rnd.random() < 0.9]
        rnd.shuffle(out)
        return out
    return v


def test_scores_alone_are_those_of_the_whole_evaluation():
    rnd = random.Random(2)
    pairs = [(a, changed(rnd, a) if rnd.random() < 0.7 else value(rnd, 3)) for a in (value(rnd, 3) for _ in range(2000))]
    for a, b in pairs:
        scores, size, nearest, _ = anls.evaluate(a, b)
        assert anls.scored(a, b) == (scores, size, nearest == b)
    texts = [pd.Series([json.dumps(p[k]) for p in pairs] + ["{broken", None, '["a", "b"]']) for k in (0, 1)]
    texts[1].iloc[-1] = '"b"'
    assert anls._anls_json_score(*texts).tolist() == anls._anls_json(*texts)["score"].tolist()


def test_only_paired_elements_are_gone_into(monkeypatch):
    whole = []
    evaluate = anls.evaluate
    monkeypatch.setattr(anls, "evaluate", lambda *a: whole.append(a) or evaluate(*a))
    items = [{"k": f"text {n}"} for n in range(6)]
    anls.evaluate(items, items[::-1])
    # The list, six pairs and their keys; every two elements would be 36.
    assert len(whole) == 1 + 6 + 6


def test_single_matrices_are_settled_as_stacks_are():
    rnd = random.Random(4)
    for _ in range(500):
        n, m = rnd.randint(1, 5), rnd.randint(1, 5)
        matrix = [[rnd.randint(0, 6) / 6 for _ in range(m)] for _ in range(n)]
        match = assignment._solve_open(assignment.np.array([matrix]))[0]
        assert assignment.assign(matrix) == [(i, int(j)) for i, j in enumerate(match) if j < m] or n == m == 1
