"""Comparators, list helpers, the entry of comparison and result tables against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import assignment, columns, scalars
from gaugeflow.operators import compare, flat, lists, metrics
from gaugeflow.plans.spec import FieldSpec, ModelSpec
from gaugeflow.sources import records

ADDRESS = ModelSpec("Address", [FieldSpec("city", "str", scalars.Exact(), 1.0), FieldSpec("zip", "int", scalars.Numeric(), 1.0)])
PERSON = ModelSpec("Person", [FieldSpec("name", "str", scalars.Levenshtein(), 0.8, weight=2.0), FieldSpec("nick", "str", scalars.Fuzzy(method="partial_ratio"), 0.9, clip=False), FieldSpec("home", "struct", threshold=0.6, model=ADDRESS)])


def test_partial_ratio_is_symmetric():
    rnd = random.Random(1)
    assert scalars.partial_ratio("bcxxx", "aabcy") == scalars.partial_ratio("aabcy", "bcxxx") == pytest.approx(4 / 7)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6))) for _ in range(2))
        assert scalars.partial_ratio(a, b) == scalars.partial_ratio(b, a)


def test_structured_comparator():
    strict, own = scalars.Structured(strict_types=True), scalars.Structured(model=ADDRESS)
    with pytest.raises(TypeError):
        strict.compare("a", "b")
    assert strict.compare(None, None) == 1.0 and strict.compare(None, {"a": 1}) == 0.0 and strict.compare({"a": 1}, {"a": 1}) == 1.0
    assert own.compare({"city": "x", "zip": 1}, {"city": "X", "zip": 2}) == 0.5
    assert isinstance(scalars.create("StructuredModelComparator", {"threshold": 0.5}), scalars.Structured)


def test_embeddings_are_asked_once_and_again():
    calls = []

    def embed(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise OSError("busy")
        return [[float(len(t))] for t in texts]

    found = scalars.embedded(["a  b", "a b", "", "ccc"], embed, wait=0.001)
    assert found == {"a  b": [3.0], "a b": [3.0], "": [], "ccc": [3.0]} and calls == [["a b", "ccc"]] * 3
    with pytest.raises(OSError):
        scalars.embedded(["x"], lambda t: (_ for _ in ()).throw(OSError()), attempts=2, wait=0.001)


def test_model_calls_are_not_repeated():
    asked = []
    judge = scalars.Judged(judge=lambda p: asked.append(p) or "TRUE")
    assert scalars.batch_scores(judge, ["a", "a", None], ["b", "b", None]) == [1.0, 1.0, 1.0] and len(asked) == 1


def test_lists_from_text_and_matching_info():
    exact = lambda x, y: float(x == y)
    assert assignment.as_list("['a', 2]") == ["a", 2] and assignment.as_list("[a") == ["[a"] and assignment.as_list("[a]") == ["[a]"] and assignment.as_list(5) == [5]
    assert assignment.binary_compare("['a', 'b', 'c']", ["C", "x"], exact) == (1, 1)
    assert assignment.binary_compare("a", "b", exact) == (0, 1) and assignment.binary_compare("a", "A ", exact) == (1, 0)
    info = assignment.matching_info(["a", "b", "c"], ["c", "a"], exact)
    assert info["assignments"] == [(0, 1), (2, 0)] and info["unmatched_gt_indices"] == [1] and info["unmatched_pred_indices"] == [] and info["matched_gt_indices"] == {0, 2}
    assert assignment.matching_info(None, ["x"], exact)["unmatched_pred_indices"] == [0]


def test_list_columns_equal_the_row_form(spark):
    rnd = random.Random(5)
    rows = [(k, [rnd.choice(["ab", "abc", "xy", "xyz", "q"]) for _ in range(rnd.randint(0, 4))], [rnd.choice(["ab", "abd", "xy", "z"]) for _ in range(rnd.randint(0, 4))]) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, a array<string>, b array<string>")
    out = lists.list_scores(lists.matching_info(lists.match_lists(df, "a", "b", threshold=0.6), "a", "b"), "a", "b", 0.6)
    compare_ = scalars.Levenshtein().compare
    for r in out.collect():
        want = assignment.list_metrics(r.a, r.b, compare_, 0.6)
        assert (r.m_tp, r.m_fp, r.m_fn) == (want["tp"], want["fp"], want["fn"])
        assert (r.m_precision, r.m_recall, r.m_f1) == pytest.approx((want["precision"], want["recall"], want["f1"]))
        assert sorted([*r.matched_gt, *r.unmatched_gt]) == list(range(len(r.a))) and sorted([*r.matched_pred, *r.unmatched_pred]) == list(range(len(r.b)))


def test_numbers_in_columns_equal_the_row_form(spark):
    pairs = [("1.00000000001", "1.00000000002"), ("1" * 30, "1" * 30 + ".0"), ("1" * 30, "1" * 29 + "2"), ("$1,000.50", "1000.5"), ("(5)", "-5"), ("", "0"), ("-", "-"), ("1.2.3", "1.2.3"), (".5", "0.50"), ("-0", "0"), ("5.", "5"), ("1e3", "13"), (None, None), (None, "1"), ("abc", "abc"), ("0", "0.004"), ("100", "101"), ("10", "10.5")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for settings in ({}, {"relative_tolerance": 0.01}, {"absolute_tolerance": 0.5}, {"relative_tolerance": 0.01, "absolute_tolerance": 0.5}):
        own = scalars.Numeric(**settings)
        got = df.select(columns.numeric(F.col("a"), F.col("b"), settings.get("relative_tolerance", 0.0), settings.get("absolute_tolerance", 0.0)).alias("s")).collect()
        assert [r.s for r in got] == [own.compare(a, b) for a, b in pairs], settings


def people(n=60):
    rnd = random.Random(9)

    def home():
        return {"city": rnd.choice(["Rome", "rome", "Oslo", ""]), "zip": rnd.choice([1, 2, None])} if rnd.random() < 0.7 else None

    def person():
        return {"name": rnd.choice(["Ann Lee", "Ann Leigh", "", None, "Bob"]), "nick": rnd.choice(["annie", "ann", None, "bobby"]), "home": home()}

    return [(str(k), person(), person()) for k in range(n)]


def test_native_and_document_comparison_agree(spark):
    """Every row, the document's own too, with records missing on either side, and their roll-ups."""
    kind = PERSON.schema().simpleString()
    docs = people()
    as_struct = spark.createDataFrame(docs, f"doc_id string, expected {kind}, predicted {kind}")
    as_text = spark.createDataFrame([(k, json.dumps(a), json.dumps(b)) for k, a, b in docs], "doc_id string, expected string, predicted string")
    assert compare.is_native(as_struct, PERSON) and not compare.is_native(as_text, PERSON)
    one, two = (compare.compare_with(x, PERSON, evaluator_format=True) for x in (as_struct, as_text))
    for name in ("fields", "scores", "aggregate", "metrics", "evaluator"):
        rows = [sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x[name].select(*one[name].columns).collect()), key=str) for x in (one, two)]
        assert rows[0] == rows[1], name


def test_extras_of_json_records_are_counted_natively(spark):
    texts = [(str(k), json.dumps({"name": "a", "nick": "b", "home": {"city": "x", "zip": 1, **({"more": 1} if k % 2 else {})}, **({"odd": None, "odder": [1]} if k % 3 else {})})) for k in range(12)]
    df = spark.createDataFrame(texts, "doc_id string, t string")
    pairs = records.parse(records.parse(df, PERSON, "t", "expected").drop("extra_keys", "n_extras"), PERSON, "t", "predicted")
    native = {r.doc_id: r.fa for r in compare.compare_with(pairs, PERSON, extras="n_extras")["fields"].where("path = ''").collect()}
    plain = {r.doc_id: r.fa for r in compare.compare_documents(df.select("doc_id", F.col("t").alias("expected"), F.col("t").alias("predicted")), PERSON).where("path = ''").collect()}
    assert native == plain and set(plain.values()) == {0, 1, 2, 3}


def test_rows_of_equal_content_are_documents_of_their_own(spark):
    rows = [("{}", "{}")] * 5 + [('{"a": 1}', "{}"), ("broken", "{}"), (None, "{}")]
    got = [r.doc_id for r in records.json_pairs(spark.createDataFrame(rows, "expected string, predicted string")).collect()]
    assert len(got) == len(set(got)) == 6
    again = records.json_pairs(spark.createDataFrame(rows[::-1], "expected string, predicted string").repartition(3)).collect()
    assert sorted(got) == sorted(r.doc_id for r in again)


def test_results_keep_all_columns(spark, tmp_path):
    docs = spark.createDataFrame([("1", "{}", "{}"), ("2", "{bad", "{}")], "doc_id string, expected string, predicted string")
    model = ModelSpec("Empty", [FieldSpec("x", "str", optional=True)])
    long = compare.compare_documents(docs, model)
    for name, rows in (("all", long), ("sound", long.where("error is null"))):
        records.write_results(rows, str(tmp_path / name))
        back = records.read_results(spark, str(tmp_path / name))
        assert back.columns == long.columns and back.dtypes == long.dtypes
        assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert [(r.error_type, r.n) for r in metrics.error_counts(records.read_results(spark, str(tmp_path / "all"))).collect()] == [("JSONDecodeError", 1)]


def test_flat_supports():
    items = ModelSpec("Items", [FieldSpec("items", "list", model=ADDRESS)])
    assert flat.supports(PERSON) and not flat.supports(items)
    assert not flat.supports(ModelSpec("Judged", [FieldSpec("a", "str", scalars.Judged())]))


def test_schema_with_comparisons():
    from gaugeflow.plans import spec

    found = spec.comparison_schema(PERSON)
    assert found["properties"]["nick"]["x-comparison"] == {"comparator_type": "FuzzyComparator", "comparator_name": "FuzzyComparator", "comparator_config": {"method": "partial_ratio"}, "threshold": 0.9, "weight": 1.0, "clip_under_threshold": False, "aggregate": False}
    assert found["properties"]["home"]["properties"]["zip"]["type"] == "integer" and found["properties"]["home"]["x-comparison"]["comparator_type"] == "StructuredModelComparator"
    schema = {"type": "object", "properties": {"a": {"type": "string", "x-mine-threshold": 0.9, "x-other-threshold": 0.1}}}
    assert spec.model_from_json_schema(schema, "mine").fields[0].threshold == 0.9 and spec.model_from_json_schema(schema, "other").fields[0].threshold == 0.1
    assert spec.model_from_json_schema(schema, "third").fields[0].threshold == 0.5


def test_page_with_all_sections():
    from gaugeflow.report import page
    from gaugeflow.report.tables import COUNTS, METRICS, CorpusResult

    scores = dict.fromkeys(COUNTS, 1) | dict.fromkeys(METRICS, 0.85)
    result = CorpusResult(2, scores, {"a<b": scores | {"f1": 0.1}}, {"ValueError": 1}, non_matches=[{"doc_id": "d1", "field_path": "a", "type": "fd", "gt": "<x>", "pred": None}])
    found = page.render(result, page.ReportConfig(images={"d1": "p/1.png", "d2": "p/2.png"}))
    for part in ("<svg", 'class="heat"', '<option value="d2">', 'src="p/1.png"', 'data-doc="d1"', "a&lt;b", "&lt;x&gt;", "#c62828", "#2e7d32"):
        assert part in found
    assert page.gauge(0.0, "x").count("<path") == 1 and "100%" in page.gauge(2.0, "x")
    assert page.render(CorpusResult(0, dict.fromkeys((*COUNTS, *METRICS), 0), {}, {}, non_matches=[]))
