import json

import pytest
from pyspark.sql import functions as F

from gaugeflow.functions.scalars import Exact, Levenshtein, Numeric
from gaugeflow.operators import compare, flat, flatten, lists, metrics
from gaugeflow.operators.document import Evaluator, comparisons, long_rows, non_matches
from gaugeflow.plans.spec import FieldSpec, ModelSpec
from gaugeflow.sources import records

PRODUCT = ModelSpec("Product", [FieldSpec("product_id", "str", Exact(), 1.0, 3.0), FieldSpec("name", "str", Levenshtein(), 0.7, 2.0), FieldSpec("price", "float", Levenshtein(), 0.9, 1.0)], 0.8)
ORDER = ModelSpec("Order", [FieldSpec("order_id", "str", Exact(), 1.0, 2.0), FieldSpec("products", "list", model=PRODUCT, weight=3.0)])


def products(*rows):
    return [dict(zip(("product_id", "name", "price"), r)) for r in rows]


GT = {"order_id": "1", "products": products(("PROD-001", "Laptop", 999.99), ("PROD-002", "Mouse", 29.99), ("PROD-003", "Cable", 14.99))}
PRED = {"order_id": "1", "products": products(("PROD-001", "Laptop", 999.99), ("PROD-002", "Different Product", 99.99), ("PROD-004", "New Product", 19.99))}


def counts(node):
    return {k: v for k, v in node.overall.items() if v}


def test_threshold_gating():
    r = Evaluator(ORDER).document(GT, PRED)
    assert counts(r.fields["products"]) == {"tp": 1, "fd": 2, "fp": 2}
    assert counts(r.fields["products"].fields["name"]) == {"tp": 1}


def test_documented_similarity_matrix():
    item = ModelSpec("Transaction", [FieldSpec("transaction_id", "str", Exact(), 1.0, 3.0), FieldSpec("description", "str", Levenshtein(), 0.7, 2.0), FieldSpec("amount", "float", Levenshtein(), 0.9, 1.0)], 0.8)
    names = ("transaction_id", "description", "amount")
    gt = [dict(zip(names, r)) for r in (("TXN-001", "Coffee shop payment", 4.95), ("TXN-002", "Grocery store", 127.43), ("TXN-003", "Gas station", 45.67))]
    pred = [dict(zip(names, r)) for r in (("TXN-001", "Coffee shop", 4.95), ("TXN-002", "Online purchase", 89.99), ("TXN-004", "Restaurant", 23.45))]
    ev = Evaluator(item)
    found = [[round(ev.raw(item, a, b), 3) for b in pred] for a in gt]
    assert found == [[0.860, 0.137, 0.154], [0.130, 0.572, 0.135], [0.097, 0.056, 0.124]]


@pytest.mark.parametrize("a,b,expected", [
    (["M", "T", "W"], ["M"], {"tp": 1, "fn": 2}), (["M"], ["M", "T", "W"], {"tp": 1, "fa": 2, "fp": 2}), (["X", "Y"], ["A", "B"], None), ([], [], {"tn": 1}), (None, ["a"], {"fa": 1, "fp": 1}), (["a"], None, {"fn": 1}),
])
def test_lists_in_list_elements(a, b, expected):
    tagged = ModelSpec("Tagged", [FieldSpec("tags", "list:str", Levenshtein(), 0.7)], 0.3)
    box = ModelSpec("Box", [FieldSpec("items", "list", model=tagged)])
    r = Evaluator(box).document({"items": [{"tags": a}]}, {"items": [{"tags": b}]})
    if expected is None:
        assert counts(r.fields["items"]) == {"fn": 1, "fa": 1, "fp": 1}
    elif a and b:
        assert counts(r.fields["items"].fields["tags"]) == expected
    direct = Evaluator(tagged).document({"tags": a}, {"tags": b}).fields["tags"]
    if expected is not None:
        assert counts(direct) == expected


def test_position_invariance():
    item = ModelSpec("Item", [FieldSpec("name", "str", Levenshtein(), 0.7), FieldSpec("value", "int", Exact(), 1.0)], 0.7)
    fields = [FieldSpec("items", "list", model=item), FieldSpec("words", "list:str", Levenshtein(), 0.7)]
    root = ModelSpec("Root", fields)
    deep = ModelSpec("Deep", [FieldSpec("inner", "struct", model=root, threshold=0.7)])
    cases = [([("a", 1), ("b", 2)], [("a", 1), ("x", 9)], ["p", "q"], ["p"]), ([], [], [], []), ([("a", 1)], [], ["z"], ["z", "y"]), ([("abc", 1)] * 2, [("abd", 1)] * 3, [], ["k"])]
    for a, b, u, v in cases:
        gt, pred = ({"items": [{"name": n, "value": k} for n, k in x], "words": w} for x, w in ((a, u), (b, v)))
        flat_, nested = Evaluator(root).document(gt, pred), Evaluator(deep).document({"inner": gt}, {"inner": pred})
        for name in ("items", "words"):
            assert flat_.fields[name].overall == nested.fields["inner"].fields[name].overall


def test_extras_and_outcomes():
    m = ModelSpec("Contract", [FieldSpec("date", "str", Exact(), 1.0), FieldSpec("company", "str", Levenshtein(), 0.8, 2.0)])
    r = Evaluator(m).document({"date": "1", "company": ""}, {"date": None, "company": None, "x": 1, "y": 2, "z": 3})
    assert counts(r) == {"fn": 1, "tn": 1, "fa": 3, "fp": 3}
    assert r.score == pytest.approx(2 / 3) and not r.all_matched


def test_rows_of_comparisons_and_non_matches():
    ev = Evaluator(ORDER)
    r = ev.document(GT, PRED)
    rows = comparisons(ev, ORDER, GT, PRED, r.fields)
    assert ("products[0].name", "products[0].name", True) in [(x[0], x[2], x[4]) for x in rows]
    bad = non_matches(ev, ORDER, GT, PRED, r.fields)
    assert {x[0] for x in bad} >= {"products[1].name", "products[2].product_id"}
    assert all(x[1] == "false_discovery" for x in bad)
    empty = {"order_id": "1", "products": []}
    r = ev.document(GT, empty)
    assert [x[1] for x in non_matches(ev, ORDER, GT, empty, r.fields)] == ["false_negative"] * 3


def test_bulk_equals_sum_of_documents(spark):
    docs = [(str(k), GT, PRED if k % 2 else GT) for k in range(6)] + [("bad", None, None)]
    df = spark.createDataFrame([(k, json.dumps(a) if a else "{oops", json.dumps(b)) for k, a, b in docs], "doc_id string, expected string, predicted string")
    long = compare.compare_documents(df, ORDER).cache()
    totals = {r.path: r.asDict() for r in metrics.bulk(long.where("error is null")).collect()}
    expected = {}
    for _, a, b in docs[:-1]:
        for row in long_rows(Evaluator(ORDER).document(a, b)):
            own = expected.setdefault(row[0], [0] * 6)
            expected[row[0]] = [x + y for x, y in zip(own, row[3:9])]
    assert {p: [t[c] for c in ("tp", "fa", "fd", "fp", "tn", "fn")] for p, t in totals.items()} == expected
    assert metrics.error_counts(long).collect()[0].n == 1
    whole = {r.path: r for r in metrics.count_errors(metrics.bulk(long.where("error is null")), long).collect()}
    assert whole[""].fn == totals[""]["fn"] + 1
    halves = [metrics.bulk(long.where((F.col("error").isNull()) & (F.hash("doc_id") % 2 == k))) for k in (-1, 0, 1)]
    assert {r.path: r.tp for r in metrics.merge_states(*halves).collect()} == {p: t["tp"] for p, t in totals.items()}
    rolled = {r.path: r for r in metrics.bulk(metrics.roll_up(long.where("error is null"))).collect()}
    assert rolled["products"].tp == sum(totals[f"products.{c}"]["tp"] for c in ("product_id", "name", "price"))
    assert flatten.evaluator_rows(long.where("error is null")).where("path = ''").count() == 6
    assert compare.document_non_matches(df, ORDER).count() > 0 and compare.document_comparisons(df, ORDER).count() > 0


def test_native_equals_document_evaluator(spark):
    inner = ModelSpec("In", [FieldSpec("x", "str", Exact(), 1.0), FieldSpec("y", "float", Numeric(relative_tolerance=0.1), 0.9, 2.0)])
    m = ModelSpec("M", [FieldSpec("s", "str", Levenshtein(), 0.8, 2.0), FieldSpec("n", "float", Levenshtein(), 0.9), FieldSpec("flag", "bool", Exact(), 1.0), FieldSpec("in_", "struct", model=inner, threshold=0.7), FieldSpec("tags", "list:str", Exact(), 1.0)])
    pool = [
        {"s": "hello", "n": 10000000.0, "flag": True, "in_": {"x": "a", "y": 1.0}, "tags": ["a", "b", "b"]},
        {"s": "Hallo", "n": 0.0001, "flag": False, "in_": {"x": "b", "y": 1.05}, "tags": ["B", "c"]},
        {"s": "", "n": None, "flag": None, "in_": None, "tags": []},
        {"s": None, "n": 1e-05, "flag": True, "in_": {"x": None, "y": None}, "tags": None},
        {"s": "x", "n": 5.0, "flag": True, "in_": {"x": "A.", "y": 0.0}, "tags": ["z"]},
    ]
    pairs = [(f"{i}-{j}", a, b) for i, a in enumerate(pool) for j, b in enumerate(pool)]
    schema = f"doc_id string, gt {m.schema().simpleString()}, pred {m.schema().simpleString()}"
    rows = flat.compare_flat(spark.createDataFrame(pairs, schema), m)
    found = {(r.doc_id, r.path): (r.tp, r.fa, r.fd, r.fp, r.tn, r.fn, round(r.raw, 9), round(r.applied, 9)) for r in rows.collect()}
    expected = {}
    for doc, a, b in pairs:
        for r in long_rows(Evaluator(m).document(a, b)):
            if r[0]:
                expected[doc, r[0]] = (*r[3:9], round(r[9], 9), round(r[10], 9))
    assert found == expected
    scores = {r.doc_id: round(r.overall_score, 9) for r in flat.document_scores(rows).collect()}
    assert scores == {doc: round(Evaluator(m).document(a, b).score, 9) for doc, a, b in pairs}


def test_list_columns(spark):
    df = spark.createDataFrame([("1", ["a b", "c"], ["C", "A  B", "z"]), ("2", ["q"], ["zzz"]), ("3", None, []), ("4", ["x"], None)], "doc_id string, a array<string>, b array<string>")
    got = {r.doc_id: (r.tp, r.fd, r.fa, r.fn, r.tn) for r in lists.match_lists(df, "a", "b", threshold=0.9).collect()}
    assert got == {"1": (2, 0, 1, 0, 0), "2": (0, 0, 1, 1, 0), "3": (0, 0, 0, 0, 1), "4": (0, 0, 0, 1, 0)}
    items = flatten.list_item_rows(lists.match_lists(df, "a", "b"), "a").collect()
    assert {(r.path, r.j, r.f1) for r in items} == {("a[0]", 1, 1.0), ("a[1]", 0, 1.0)}


def test_auroc(spark):
    frame = lambda rows: spark.createDataFrame(rows, "confidence double, match boolean")
    value = lambda rows: metrics.auroc(frame(rows)).first()[0]
    assert value([(0.9, True), (0.8, True), (0.2, False)]) == 1.0
    assert value([(0.1, True), (0.8, False)]) == 0.0
    assert value([(0.5, True), (0.5, False), (0.5, True)]) == 0.5
    assert value([(0.5, True)]) == 0.5 and value([(None, True), (None, False)]) == 0.5


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("1", '{"a": 1}', '{"a": 2, "x": 3}'), ("2", "oops", "{}"), ("3", None, "{}")], "doc_id string, expected string, predicted string")
    assert [r.doc_id for r in records.json_pairs(df).collect()] == ["1"]
    m = ModelSpec("A", [FieldSpec("a", "int", Exact(), 1.0)])
    r = records.parse(df.where("doc_id = '1'"), m, "predicted").first()
    assert r.record.a == 2 and r.extra_keys == ["x"]
    wrapped = json.dumps({"p": {"value": "x", "confidence": 0.5}, "l": [{"q": {"value": 1, "confidence": 1}}]})
    c = records.confidences(spark.createDataFrame([("1", wrapped), ("2", "no")], "doc_id string, predicted string"))
    assert sorted((r.path, r.confidence) for r in c.collect()) == [("l[0].q", 1.0), ("p", 0.5)]
    assert records.unwrapped(json.loads(wrapped)) == {"p": "x", "l": [{"q": 1}]}
    long = compare.compare_documents(records.json_pairs(df), m)
    records.write_results(long, str(tmp_path / "r"))
    assert records.read_results(spark, str(tmp_path / "r")).count() == long.count()
    records.save_state(metrics.bulk(long), str(tmp_path / "s"))
    assert records.load_state(spark, str(tmp_path / "s")).count() == metrics.bulk(long).count()
    with pytest.raises(TypeError):
        records.packet_pages(spark, 5)
    aligned = compare.align(df.select("doc_id", F.col("expected").alias("record")), df.where("doc_id <> '2'").select("doc_id", F.col("predicted").alias("record")))
    assert {(r.doc_id, r.predicted is None) for r in aligned.collect()} == {("1", False), ("2", True), ("3", False)}
