import json
import random

from pyspark.sql import functions as F

from gaugeflow.functions.scalars import Exact, Levenshtein, Numeric
from gaugeflow.operators import compare, evaluation, metrics
from gaugeflow.plans.spec import FieldSpec, ModelSpec

INNER = ModelSpec("Inner", [FieldSpec("y", "str", Levenshtein(), 0.7, optional=True), FieldSpec("flag", "bool", Exact(), 1, optional=True)])
MODEL = ModelSpec("Doc", [
    FieldSpec("name", "str", Levenshtein(), 0.7, weight=2.0, optional=True),
    FieldSpec("amount", "float", Numeric(), 0.5, optional=True),
    FieldSpec("n", "int", Numeric(), 1, clip=False, optional=True),
    FieldSpec("in", "struct", model=INNER, threshold=0.7, optional=True),
])
LISTED = ModelSpec("Listed", [FieldSpec("name", "str", Levenshtein(), 0.7), FieldSpec("items", "list", model=INNER)])


def record(rnd):
    inner = rnd.choice([None, {"y": rnd.choice(["abc", "abd", "", None]), "flag": rnd.choice([True, False, None])}])
    return {"name": rnd.choice(["some name", "some mane", "other", "", None]), "amount": rnd.choice([1.0, 1e-7, 2.5, None]), "n": rnd.choice([1, 2, None]), "in": inner}


def texts(spark, docs):
    return spark.createDataFrame([(k, a if isinstance(a, str) else json.dumps(a), json.dumps(b)) for k, a, b in docs], "doc_id string, expected string, predicted string")


def plain(df):
    def same(v):
        if isinstance(v, float):
            return round(v, 9)
        return json.dumps(json.loads(v), sort_keys=True) if isinstance(v, str) and v.startswith("{") else v

    return sorted((tuple(same(v) for v in r) for r in df.collect()), key=repr)


def test_native_collectors_equal_the_row_evaluator(spark, tmp_path):
    rnd = random.Random(4)
    df = texts(spark, [(str(k), record(rnd), record(rnd)) for k in range(300)])
    structs = df.select("doc_id", *[F.from_json(c, MODEL.schema()).alias(c) for c in ("expected", "predicted")])
    assert evaluation.collects_natively(MODEL)
    plan = evaluation.by_document(structs, MODEL)._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "Python" not in plan
    one, two = evaluation.evaluate(structs, MODEL, str(tmp_path / "a")), evaluation.evaluate(df, MODEL, str(tmp_path / "b"))
    assert one.counted == two.counted and one.counted["documents"] == 300 and one.counted["errors"] == 0
    for get in (evaluation.Evaluation.fields, evaluation.Evaluation.non_matches, evaluation.Evaluation.comparisons):
        assert plain(get(one)) == plain(get(two))
    # What the collectors of one kind give, and the totals of a pass of their own.
    assert plain(two.non_matches()) == plain(compare.document_non_matches(df, MODEL))
    assert plain(two.comparisons()) == plain(compare.document_comparisons(df, MODEL))
    totals = metrics.bulk(compare.compare_documents(df, MODEL)).where("path = ''").first()
    assert {c: one.counted[c] for c in metrics.COUNTS} == {c: totals[c] for c in metrics.COUNTS}


def test_lists_errors_and_nothing(spark, tmp_path):
    rnd = random.Random(9)
    some = lambda: {"name": rnd.choice(["a", "b"]), "items": [{"y": rnd.choice(["abc", "xyz"]), "flag": True} for _ in range(rnd.randint(0, 3))]}
    df = texts(spark, [*[(str(k), some(), some()) for k in range(60)], ("bad", "{broken", {}), ("worse", "[1]", {})])
    found = evaluation.evaluate(df, LISTED, str(tmp_path / "a"))
    assert found.counted["documents"] == 62 and found.counted["errors"] == 2
    assert {r.doc_id: r.error.split(":")[0] for r in found.errors().collect()} == {"bad": "JSONDecodeError", "worse": "ValueError"}
    assert plain(found.fields()) == plain(compare.compare_documents(df, LISTED))
    assert plain(found.non_matches()) == plain(compare.document_non_matches(df, LISTED))
    assert plain(found.comparisons()) == plain(compare.document_comparisons(df, LISTED))
    none = evaluation.evaluate(df.limit(0), LISTED, str(tmp_path / "b"))
    assert set(none.counted.values()) == {0} and none.fields().count() == 0


def test_compare_with_evaluates_once(spark):
    df = texts(spark, [(str(k), record(random.Random(k)), record(random.Random(k + 1))) for k in range(20)])
    seen = spark.sparkContext.accumulator(0)

    class Counted(Exact):
        def compare(self, a, b):
            seen.add(1)
            return super().compare(a, b)

    model = ModelSpec("One", [FieldSpec("n", "int", Counted(), 1, optional=True)])
    compare.compare_documents(df, model).count()
    once = seen.value
    out = compare.compare_with(df, model, non_matches=True, comparisons=True)
    total = {name: rel.count() for name, rel in out.items()}
    assert seen.value == 2 * once and total["comparisons"] == 20
    assert {r.doc_id for r in out["non_matches"].collect()} <= {str(k) for k in range(20)}
