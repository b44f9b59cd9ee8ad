import json
import random

from pyspark.sql import functions as F

from gaugeflow.functions.scalars import Exact, Levenshtein, Numeric
from gaugeflow.operators import compare, flat, metrics, nested
from gaugeflow.plans import spec
from gaugeflow.plans.spec import FieldSpec, ModelSpec

INNER = ModelSpec("Inner", [FieldSpec("tags", "map:str", Exact(), 0.75, optional=True)])
MODEL = ModelSpec("Priced", [
    FieldSpec("id", "str", Exact(), 1.0),
    FieldSpec("prices", "map:float", Numeric(relative_tolerance=0.1), 0.6, weight=2.0, optional=True),
    FieldSpec("names", "map:str", Levenshtein(), 0.7, clip=False, optional=True),
    FieldSpec("in", "struct", model=INNER, threshold=0.7, optional=True),
])


def random_record(rnd):
    words = ["", None, "red", "Red ", "reed", "blue"]
    some = lambda values: rnd.choice([None, {}, *[{k: rnd.choice(values) for k in rnd.sample("abcd", rnd.randint(1, 4))} for _ in range(4)]])
    return {"id": rnd.choice("xy"), "prices": some([None, 0.0, 10.0, 10.5, 12.0]), "names": some(words), "in": rnd.choice([None, {"tags": some(words)}, {"tags": some(words)}])}


def test_dictionaries_natively_and_by_row(spark):
    rnd = random.Random(11)
    docs = [(str(k), random_record(rnd), random_record(rnd)) for k in range(400)]
    kind = MODEL.schema()
    text = spark.createDataFrame([(k, json.dumps(a), json.dumps(b)) for k, a, b in docs], "doc_id string, expected string, predicted string")
    pairs = text.select("doc_id", F.from_json("expected", kind).alias("expected"), F.from_json("predicted", kind).alias("predicted"))
    assert compare.is_native(pairs, MODEL)
    key = lambda df: sorted((r.doc_id, r.path, r.is_leaf, r.tp, r.fa, r.fd, r.fp, r.tn, r.fn, round(r.raw, 9), round(r.applied, 9)) for r in df.collect())
    native = compare.compare_with(pairs, MODEL)["fields"]
    assert key(native) == key(compare.compare_documents(text, MODEL))
    assert native.where("path = 'prices'").agg(F.sum("tp"), F.sum("fd"), F.sum("fa"), F.sum("fn"), F.sum("tn")).first() > (0, 0, 0, 0, 0)

    # Every key of both sides, once more.
    want = {}
    for doc, a, b in docs:
        for path, f, x, y in [("prices", MODEL["prices"], a["prices"], b["prices"]), ("names", MODEL["names"], a["names"], b["names"]), ("in.tags", INNER["tags"], (a["in"] or {}).get("tags"), (b["in"] or {}).get("tags"))]:
            x, y = x or {}, y or {}
            for k in {*x, *(k for k in y if k in x or y[k] not in (None, ""))}:
                no_x, no_y = x.get(k) in (None, ""), y.get(k) in (None, "")
                outcome = "tn" if no_x and no_y else "fa" if no_x else "fn" if no_y else "tp" if f.comparator.compare(x[k], y[k]) >= f.threshold else "fd"
                want[doc, f"{path}.{k}"] = outcome
    rows = flat.compare_keys(pairs.withColumnsRenamed({"expected": "gt", "predicted": "pred"}), MODEL)
    assert {(r.doc_id, r.path): r.outcome for r in rows.collect()} == want
    sums = {r.path: r.tp for r in metrics.bulk(rows).collect()}
    assert sums["prices.a"] == sum(v == "tp" for (_, p), v in want.items() if p == "prices.a")


def test_dictionaries_inside_lists_go_to_the_row_evaluator(spark):
    outer = ModelSpec("Outer", [FieldSpec("items", "list", model=MODEL)])
    assert not nested.supports(outer) and nested.supports(MODEL)
    one = {"items": [{"id": "x", "prices": {"a": 1.0}, "names": {}, "in": None}]}
    pairs = spark.createDataFrame([("1", json.dumps(one), json.dumps(one))], "doc_id string, expected string, predicted string")
    got = {r.path: r.tp for r in compare.compare_documents(pairs, outer).collect()}
    assert got["items"] == 1 and got["items.prices"] == 1


def test_dictionaries_empty_table(spark):
    none = spark.createDataFrame([], "doc_id string").select("doc_id", F.lit(None).cast(MODEL.schema()).alias("gt"), F.lit(None).cast(MODEL.schema()).alias("pred"))
    assert flat.compare_keys(none, MODEL).count() == 0 and flat.compare_flat(none, MODEL).count() == 0


def test_dictionary_types():
    assert spec.resolve_type("Dict[str, float]") == ("map:float", False)
    assert spec.resolve_type("Optional[Dict[str, int]]") == ("map:int", True)
    assert spec.resolve_type("Dict[int, str]")[0] == "Any" and spec.resolve_type("dict")[0] == "Any" and spec.resolve_type("Dict[str, List[int]]")[0] == "Any"
    for back in (spec.model_from_config(spec.to_config(MODEL)), spec.model_from_json_schema(spec.to_json_schema(MODEL))):
        assert [(f.kind, f.comparator, f.threshold) for f in back.fields if f.is_map] == [(f.kind, f.comparator, f.threshold) for f in MODEL.fields if f.is_map]
    assert spec.comparison_schema(MODEL)["properties"]["prices"]["additionalProperties"] == {"type": "number"}
    assert MODEL.from_json({"id": "x", "prices": {"a": "1.5", "b": None}})["prices"] == {"a": 1.5, "b": None}
