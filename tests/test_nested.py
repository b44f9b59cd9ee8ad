"""Records with lists at any depth: the relational comparison against the row evaluator, and the solver against all assignments."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions import assignment
from gaugeflow.functions.scalars import Exact, Levenshtein, Numeric
from gaugeflow.operators import compare, nested
from gaugeflow.plans.spec import FieldSpec, ModelSpec

COUNTS = nested.COUNTS


# ---------------------------------------------------------------- solver

def least_of_best(s):
    """By trying all: the lexicographically least of the assignments whose total is the largest."""
    n, m = s.shape
    ways = itertools.permutations([*range(m), *[m] * max(0, n - m)], n) if n <= 7 else ()
    best = None
    for w in set(ways):
        key = (-round(sum(s[i, j] for i, j in enumerate(w) if j < m), 9), w)
        best = key if best is None or key < best else best
    return best[1]


@pytest.mark.parametrize("large", [False, True])
def test_ties_go_to_the_least_assignment(large):
    rnd = np.random.default_rng(5)
    for k in range(250):
        n, m = (int(x) for x in rnd.integers(1, 6, 2))
        s = rnd.integers(0, 3, (n, m)) / 2 if k % 2 else rnd.random((n, m)).round(1)
        match = assignment._solve_large(s) if large else assignment.solve_stack(s[None])[0]
        assert tuple(match) == least_of_best(s), s


def test_long_lists_are_optimal():
    rnd = np.random.default_rng(6)
    for shape in ((400, 400), (150, 400), (400, 150)):
        for s in (rnd.random(shape), rnd.integers(0, 4, shape) / 3, np.zeros(shape)):
            cost = -s if shape[0] <= shape[1] else -s.T
            _, u, v = assignment._shortest_paths(np.ascontiguousarray(cost))
            # No assignment is better than feasible duals allow.
            assert (cost - u[:, None] - v).min() > -1e-9 and v.max() < 1e-9
            match = assignment._solve_large(s)
            rows = np.flatnonzero(match < shape[1])
            assert len(rows) == min(shape) == len(set(match[rows])) and s[rows, match[rows]].sum() == pytest.approx(-u.sum() - v.sum())
    assert (assignment._solve_large(np.zeros((300, 300))) == np.arange(300)).all()


def test_many_matrices_at_once():
    rnd = np.random.default_rng(7)
    shapes = [tuple(int(x) for x in rnd.integers(0, 5, 2)) for _ in range(200)] + [(1, 1), (9, 9), (0, 3)]
    made = [rnd.integers(0, 4, s) / 3 for s in shapes]
    rows = np.cumsum([0, *[len(s) for s in made]])
    cells = np.cumsum([0, *[m for n, m in shapes for _ in range(n)]])
    offsets, i, j, score = assignment.solve_ragged(rows, cells, np.concatenate([s.ravel() for s in made]))
    for k, s in enumerate(made):
        found = list(zip(i[offsets[k] : offsets[k + 1]], j[offsets[k] : offsets[k + 1]], score[offsets[k] : offsets[k + 1]]))
        want = [] if s.shape == (1, 1) and not s[0, 0] else [(a, b, s[a, b]) for a, b in assignment.assign(s.tolist())]
        assert found == want


# ---------------------------------------------------------------- records

LEAF = ModelSpec("Leaf", [FieldSpec("t", "str", Levenshtein(), 0.7), FieldSpec("x", "float", Numeric(), 0.9, weight=2.0), FieldSpec("any", "Any", Exact(), 0.8)], match_threshold=0.6)
BOX = ModelSpec("Box", [FieldSpec("t", "str", Levenshtein(), 0.6, clip=False), FieldSpec("n", "int", Exact(), 1.0)])
TAGGED = ModelSpec("Tagged", [FieldSpec("t", "str", Exact(), 1.0), FieldSpec("tags", "list:str", Exact(), 1.0), FieldSpec("box", "struct", model=BOX, threshold=0.5), FieldSpec("maybe", "struct", model=BOX, optional=True, threshold=0.5)], match_threshold=0.5)


def wrap(name: str, inner: ModelSpec, more: list | None = None) -> ModelSpec:
    return ModelSpec(name, [FieldSpec("t", "str", Levenshtein(), 0.8), *(more or []), FieldSpec("items", "list", model=inner, weight=3.0)], match_threshold=0.55)


WORDS = [FieldSpec("words", "list:str", Levenshtein(), 0.6)]
MODELS = {
    "depth1": wrap("A", LEAF, WORDS),
    "depth1_structs": wrap("A", TAGGED),
    "depth2": wrap("A", wrap("B", LEAF, WORDS)),
    "depth3": wrap("A", wrap("B", wrap("C", LEAF), [FieldSpec("box", "struct", model=BOX)])),
    "depth4": wrap("A", wrap("B", wrap("C", wrap("D", LEAF)))),
    "lists_in_structs": ModelSpec("S", [FieldSpec("in", "struct", model=wrap("A", TAGGED), threshold=0.5), FieldSpec("numbers", "list:int", Numeric(absolute_tolerance=1), 0.9)]),
    "lists_in_optional_structs": wrap("A", ModelSpec("O", [FieldSpec("maybe", "struct", model=wrap("P", LEAF), optional=True, threshold=0.5), FieldSpec("t", "str")], match_threshold=0.4)),
}
TEXT = ["alpha", "Alpha ", "alpine", "beta", "", " ", None, "b\x1ceta", "gamma ray"]


def value_of(f: FieldSpec, rnd):
    if f.kind == "struct":
        return None if rnd.random() < 0.2 else record_of(f.model, rnd)
    if f.kind == "list":
        return None if rnd.random() < 0.1 else [record_of(f.model, rnd) for _ in range(rnd.randint(0, 3))]
    if f.is_list:
        return None if rnd.random() < 0.2 else [value_of(FieldSpec("e", f.kind[5:]), rnd) for _ in range(rnd.randint(0, 3))]
    return rnd.choice({"int": [1, 2, 3, None], "float": [0.0, 1.5, 1e-7, 2.0, None], "Any": ["x", "y", None]}.get(f.kind, TEXT))


def record_of(model, rnd):
    return {f.name: value_of(f, rnd) for f in model.fields}


def changed(model, record, rnd):
    """A record with some values drawn anew and lists shortened, in another order."""
    out = {}
    for f in model.fields:
        v = record[f.name]
        if rnd.random() < 0.15:
            v = value_of(f, rnd)
        elif f.model and isinstance(v, dict):
            v = changed(f.model, v, rnd)
        elif f.kind == "list" and v:
            v = [changed(f.model, e, rnd) for e in v if rnd.random() < 0.85]
            rnd.shuffle(v)
        out[f.name] = v
    return out


def rows_of(df):
    def near(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(near(r[c]) for c in ("doc_id", "path", "depth", "is_leaf", *COUNTS, "raw", "applied", "weight")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", MODELS)
def test_relations_as_the_row_evaluator(spark, name):
    model, rnd = MODELS[name], random.Random(name)
    rows = []
    for k in range(40):
        gt = record_of(model, rnd)
        rows.append((k // 2, gt, changed(model, gt, rnd) if k % 5 else record_of(model, rnd)))
    schema = T.StructType([T.StructField("doc_id", T.IntegerType()), T.StructField("expected", model.schema()), T.StructField("predicted", model.schema())])
    pairs = spark.createDataFrame(rows, schema).repartition(3)
    optional = optional_everywhere(model)
    want = compare.compare_documents(pairs, optional)
    assert want.where("error is not null").count() == 0
    assert rows_of(nested.compare_nested(pairs, optional, "expected", "predicted")) == rows_of(want)


def optional_everywhere(model):
    """A copy whose scalars may be missing; structs keep what they are."""
    fields = []
    for f in model.fields:
        own = {**f.__dict__, "optional": f.optional or f.kind != "struct"}
        if f.model:
            own["model"] = optional_everywhere(f.model)
        if f.kind == "struct" and not f.optional:
            own["default"] = None
        fields.append(FieldSpec(**own))
    return ModelSpec(model.name, fields, model.match_threshold)


def test_long_lists_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(nested, "HEAVY", 2)
    test_relations_as_the_row_evaluator(spark, "depth2")


def test_compare_with_takes_the_relations(spark):
    model = optional_everywhere(MODELS["depth2"])
    rnd = random.Random(3)
    rows = [(k, record_of(model, rnd), record_of(model, rnd)) for k in range(5)]
    schema = T.StructType([T.StructField("doc_id", T.IntegerType()), T.StructField("expected", model.schema()), T.StructField("predicted", model.schema())])
    out = compare.compare_with(spark.createDataFrame(rows, schema), model)
    plan = out["fields"]._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan
    assert rows_of(out["fields"].where(F.col("error").isNull())) == rows_of(compare.compare_documents(spark.createDataFrame(rows, schema), model))
