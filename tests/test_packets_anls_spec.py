import json

import pytest
from pyspark.sql import functions as F

from gaugeflow.functions.scalars import Exact, Numeric
from gaugeflow.operators import anls, packet
from gaugeflow.plans import spec

# (class, group, page, predicted group, predicted class, predicted page) and the published final and clustering scores.
BASE = [("invoice", "inv-01", 1), ("invoice", "inv-01", 2), ("invoice", "inv-01", 3), ("form", "form-01", 4), ("form", "form-01", 5)]
PACKETS = {
    "perfect": (["invoice"] * 3 + ["form"] * 2, ["inv-01"] * 3 + ["form-01"] * 2, [1, 2, 3, 4, 5], 1.0, 1.0),
    "misclassified": (["form"] * 3 + ["invoice"] * 2, ["inv-01"] * 3 + ["form-01"] * 2, [1, 2, 3, 4, 5], 0.7974, 0.5949),
    "swapped groups": (["invoice"] * 3 + ["form"] * 2, ["form-01"] * 3 + ["inv-01"] * 2, [1, 2, 3, 4, 5], 1.0, 1.0),
    "wrong order": (["invoice"] * 3 + ["form"] * 2, ["inv-01"] * 3 + ["form-01"] * 2, [3, 1, 2, 5, 4], 0.1667, 1.0),
    "split": (["invoice"] * 3 + ["form"] * 2, ["inv-01", "inv-02", "inv-01", "form-01", "form-02"], [1, 2, 3, 4, 5], 0.8428, 0.6856),
    "merged": (["invoice"] * 3 + ["form"] * 2, ["mixed-01"] * 5, [1, 2, 3, 4, 5], 0.6, 0.2),
    "one wrong": (["invoice", "form", "invoice", "form", "form"], ["inv-01"] * 3 + ["form-01"] * 2, [1, 2, 3, 4, 5], 0.8947, 0.7895),
    "many": (["form", "form", "invoice", "invoice", "invoice"], ["form-01", "form-01", "inv-02", "inv-01", "inv-01"], [3, 1, 2, 5, 4], -0.0359, 0.5949),
    "same page": (["invoice"] * 3 + ["form"] * 2, ["inv-01"] * 3 + ["form-01"] * 2, [1, 1, 3, 4, 5], 0.9541, 1.0),
    "reversed": (["invoice"] * 3 + ["form"] * 2, ["inv-01"] * 3 + ["form-01"] * 2, [3, 2, 1, 5, 4], 0.0, 1.0),
}


def test_published_packets(spark):
    rows = [(name, f"{name}{k}", c, g, p, pc, pg, pp) for name, (cs, gs, ps, *_) in PACKETS.items() for k, ((c, g, p), pc, pg, pp) in enumerate(zip(BASE, cs, gs, ps))]
    pages = spark.createDataFrame(rows, "packet_id string, row_id string, class_label string, group_id string, page_number int, class_label_predicted string, group_id_predicted string, page_number_predicted int")
    found = {r.packet_id: r for r in packet.evaluate_packets(pages).collect()}
    for name, (*_, final, cluster) in PACKETS.items():
        assert found[name].final_score == pytest.approx(final, abs=1e-4), name
        assert found[name].clustering_score == pytest.approx(cluster, abs=1e-4), name
    with pytest.raises(ValueError):
        packet.clustering(pages, weight=2)
    assert "excellent" in packet.packet_report(1.0, 0.6, 0.2)


def test_sections(spark):
    schema = "packet_id int, ord int, section_id string, document_class string, page_indices array<int>"
    gt = packet.sections(spark.createDataFrame([(1, 0, "s1", "invoice", [0, 1, 2]), (1, 1, None, "form", [3, 4])], schema), "gt")
    pred = packet.sections(spark.createDataFrame([(1, 0, "p1", "invoice", [2, 1, 0]), (1, 1, "p2", "form", [3]), (1, 2, "p3", "form", None)], schema), "pred")
    assert packet.page_accuracy(gt, pred).first().accuracy == pytest.approx(0.8)
    assert packet.split_accuracy(gt, pred).first().accuracy == 0.5
    assert packet.split_accuracy(gt, pred, ordered=True).first().accuracy == 0.0
    detail = {r.section_id: r for r in packet.split_details(gt, pred, True).collect()}
    assert detail["s1"].order_matched is False and detail["s1"].matched_id == "p1" and "gt_1" in detail
    assert sorted(r.section_id for r in packet.unmatched_predictions(gt, pred).collect()) == ["p2", "p3"]
    nested = spark.createDataFrame([(1, 0, {"type": "invoice"}, {"page_indices": [1]})], "packet_id int, ord int, document_class struct<type: string>, split_document struct<page_indices: array<int>>")
    assert packet.sections(nested, "gt").first().page_indices == [1]


def test_anls(spark):
    assert anls.anls("hello", "hello") == 1.0 and anls.anls("hello", "zzzzz") == 0.0
    assert anls.key_scores({"a": 1, "b": 2}, {"a": 1, "b": 3}) == {("a",): 1.0, ("b",): 0.0}
    assert anls.anls({"a": 1}, {"a": 1, "b": 2}) == 0.5
    assert anls.anls({"a": 1}, {"a": 1, "b": None}) == 0.5
    assert anls.anls(["x", "y"], ["y", "x"]) == 1.0 and anls.anls(["x", "y"], ["x"]) == 0.5
    assert anls.anls(None, {}) == 1.0 and anls.anls(None, "a") == 0.0 and anls.anls([], []) == 1.0
    assert anls.anls(["cat", "dog"], "dog") == 1.0
    assert anls.closest(("cat", "dog"), "dogs") == "dog"
    assert anls.anls({"a": [{"b": 1}, {"b": 2}]}, {"a": [{"b": 2}, {"b": 1}]}) == 1.0
    with pytest.raises(ValueError):
        anls.anls("a", ("a",))
    with pytest.raises(ValueError):
        anls.Options([])
    assert "error" in anls.compare_json("a", ("b",))
    df = spark.createDataFrame([('{"a": "x"}', '{"a": "x"}'), ("{", "{}"), (None, "null")], "a string, b string")
    got = df.select(anls.anls_json(F.col("a"), F.col("b")).alias("r")).select("r.*").collect()
    assert [r.score for r in got] == [1.0, 0.0, 1.0] and got[1].error
    texts = spark.createDataFrame([(["cat", "dog"], "dog", "a", "a"), (["x"], None, None, "")], "o array<string>, p string, q string, r string")
    flat = texts.select(anls.anls_options(F.col("o"), F.col("p")), anls.anls_text(F.col("q"), F.col("r"))).collect()
    assert [tuple(r) for r in flat] == [(1.0, 1.0), (0.0, 1.0)]


CONFIG = {"model_name": "Invoice", "match_threshold": 0.8, "fields": {
    "number": {"type": "str", "comparator": "ExactComparator", "comparator_config": {"case_sensitive": True}, "threshold": 1.0, "weight": 2.0},
    "total": {"type": "float", "comparator": "NumericComparator", "comparator_config": {"relative_tolerance": 0.1}, "required": False},
    "tags": {"type": "List[str]", "comparator": "LevenshteinComparator"},
    "vendor": {"type": "structured_model", "fields": {"name": {"type": "str", "comparator": "LevenshteinComparator"}}},
    "items": {"type": "list_structured_model", "match_threshold": 0.6, "fields": {"sku": {"type": "Optional[int]", "comparator": "ExactComparator"}}},
}}


def test_specification_round_trips():
    m = spec.model_from_config(CONFIG)
    assert m["number"].comparator == Exact(case_sensitive=True) and m["total"].comparator == Numeric(relative_tolerance=0.1)
    assert (m["vendor"].threshold, m["items"].model.match_threshold, m["items"].model["sku"].optional) == (0.7, 0.6, True)
    assert m.paths() == ["number", "total", "tags", "vendor", "vendor.name", "items", "items.sku"]
    again = spec.model_from_config(json.loads(json.dumps(spec.to_config(m))))
    assert again == m
    schema = json.loads(json.dumps(spec.to_json_schema(m)))
    back = spec.model_from_json_schema(schema)
    assert back.paths() == m.paths() and back["number"].comparator == m["number"].comparator and back.match_threshold == 0.8
    assert spec.validate_instance(schema, {"number": 1}) and m.schema()["items"].dataType.elementType["sku"]


@pytest.mark.parametrize("config", [
    {}, {"fields": {}}, {"fields": {"a": {}}}, {"fields": {"a": {"type": "wat"}}}, {"fields": {"a": {"type": "str", "threshold": 2}}}, {"fields": {"a": {"type": "str", "weight": -1}}},
    {"model_name": "1x", "fields": {"a": {"type": "str"}}}, {"fields": {"a": {"type": "structured_model"}}}, {"fields": {"a": {"type": "str", "fields": {}}}},
    {"fields": {"a": {"type": "structured_model", "comparator": "ExactComparator", "fields": {"b": {"type": "str"}}}}}, {"fields": {"a": {"type": "str", "clip_under_threshold": 1}}},
])
def test_bad_configurations(config):
    with pytest.raises(ValueError):
        spec.model_from_config(config)


def test_json_schema_references_and_errors():
    schema = {"type": "object", "$defs": {"A": {"type": "object", "properties": {"x": {"type": "integer"}}}}, "properties": {"a": {"$ref": "#/$defs/A"}, "l": {"type": "array", "items": {"$ref": "#/$defs/A"}}, "f": {"type": "boolean"}}}
    m = spec.model_from_json_schema(schema)
    assert m.paths() == ["a", "a.x", "l", "l.x", "f"] and isinstance(m["f"].comparator, Exact) and m["f"].threshold == 0.5
    for bad in ({"type": "array"}, {"type": "object"}, {"type": "object", "properties": {"a": {"type": "null"}}}, {"type": "object", "properties": {"a": {"$ref": "#/x/y"}}}, {"type": "object", "properties": {"a": {"type": "string", "x-any-vendor-weight": 0}}}):
        with pytest.raises(ValueError):
            spec.model_from_json_schema(bad)


def test_types_and_records():
    assert spec.resolve_type("Optional[List[str]]") == ("list:str", True)
    assert spec.resolve_type("Union[int, None]") == ("int", True)
    assert spec.split_arguments("Dict[str, int], List[str]") == ["Dict[str, int]", "List[str]"]
    m = spec.model_from_config(CONFIG)
    r = m.from_json({"number": "1", "tags": ["a"], "vendor": {"name": "n"}, "items": [{"sku": "3"}], "odd": 1})
    assert r["items"][0]["sku"] == 3 and r["total"] is None and r["odd"] == 1
    with pytest.raises(ValueError):
        m.from_json({"tags": []})
