import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import json_rules

SCHEMA = {
    "$defs": {"label": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^[a-c]"}},
    "type": "object",
    "required": ["id", "kind"],
    "dependentRequired": {"price": ["unit"]},
    "minProperties": 2,
    "properties": {
        "id": {"type": "integer", "minimum": 1, "exclusiveMaximum": 5},
        "kind": {"enum": ["a", 1, None, {"x": [1]}]},
        "price": {"type": ["number", "null"], "multipleOf": 0.5, "exclusiveMinimum": 0, "maximum": 3},
        "unit": {"$ref": "#/$defs/label"},
        "tags": {"type": "array", "items": {"allOf": [{"$ref": "#/$defs/label"}, {"not": {"const": "cc"}}]}, "minItems": 1, "maxItems": 3, "uniqueItems": True, "contains": {"pattern": "a"}},
        "more": {"type": "object", "patternProperties": {"^n": {"type": "number"}}, "additionalProperties": {"type": "string"}, "propertyNames": {"maxLength": 2}, "maxProperties": 2},
        "one": {"oneOf": [{"type": "number", "minimum": 2}, {"type": "integer"}]},
        "any": {"anyOf": [{"type": "string"}, {"minimum": 2}]},
        "on": {"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"type": "boolean"}},
    },
    "additionalProperties": False,
}


def same(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return type(a) is type(b) and a == b


def brute(s, v, at="$", root=SCHEMA):
    """(path, rule) of each violation, value by value."""
    if s is True:
        return []
    if s is False:
        return [(at, "false")]
    out = []
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    types = {"string": isinstance(v, str), "number": number, "integer": number and v == math.floor(v), "boolean": isinstance(v, bool), "null": v is None, "object": isinstance(v, dict), "array": isinstance(v, list)}
    bad = lambda rule, wrong: out.append((at, rule)) if wrong else None
    for rule, x in s.items():
        if rule == "type":
            bad(rule, not any(types[k] for k in (x if isinstance(x, list) else [x])))
        elif rule == "enum":
            bad(rule, not any(same(v, e) for e in x))
        elif rule == "const":
            bad(rule, not same(v, x))
        elif rule == "$ref":
            out += brute(root["$defs"][x.rsplit("/", 1)[1]], v, at)
        elif rule == "allOf":
            for t in x:
                out += brute(t, v, at)
        elif rule == "anyOf":
            bad(rule, all(brute(t, v, at) for t in x))
        elif rule == "oneOf":
            bad(rule, sum(not brute(t, v, at) for t in x) != 1)
        elif rule == "not":
            bad(rule, not brute(x, v, at))
        elif rule == "if":
            out += brute(s.get("else" if brute(x, v, at) else "then", True), v, at)
        elif number:
            bad(rule, {"minimum": lambda: v < x, "maximum": lambda: v > x, "exclusiveMinimum": lambda: v <= x, "exclusiveMaximum": lambda: v >= x, "multipleOf": lambda: v / x != round(v / x)}.get(rule, lambda: False)())
        elif isinstance(v, str):
            bad(rule, {"minLength": lambda: len(v) < x, "maxLength": lambda: len(v) > x, "pattern": lambda: not re.search(x, v)}.get(rule, lambda: False)())
        elif isinstance(v, list):
            if rule == "items":
                for k, e in enumerate(v):
                    out += brute(x, e, f"{at}[{k}]")
            bad(rule, {"minItems": lambda: len(v) < x, "maxItems": lambda: len(v) > x, "uniqueItems": lambda: any(same(a, b) for i, a in enumerate(v) for b in v[:i]), "contains": lambda: all(brute(x, e) for e in v)}.get(rule, lambda: False)())
        elif isinstance(v, dict):
            if rule == "required":
                out += [(f"{at}.{k}", rule) for k in x if k not in v]
            elif rule == "dependentRequired":
                out += [(f"{at}.{o}", rule) for k, others in x.items() if k in v for o in others if o not in v]
            elif rule == "properties":
                for k, t in x.items():
                    out += brute(t, v[k], f"{at}.{k}") if k in v else []
            elif rule == "patternProperties":
                for p, t in x.items():
                    for k in v:
                        out += brute(t, v[k], f"{at}.{k}") if re.search(p, k) else []
            elif rule == "additionalProperties":
                for k in v:
                    if k not in s.get("properties", {}) and not any(re.search(p, k) for p in s.get("patternProperties", {})):
                        out += [(f"{at}.{k}", rule)] if x is False else brute(x, v[k], f"{at}.{k}")
            elif rule == "propertyNames":
                for k in v:
                    out += [(f"{at}.{k}", rule) for _ in brute(x, k)]
            bad(rule, {"minProperties": lambda: len(v) < x, "maxProperties": lambda: len(v) > x}.get(rule, lambda: False)())
    return out


def any_value(rnd, deep=2):
    flat = [None, True, False, 0, 1, 2, 1.0, 2.5, 0.5, 1.25, -1, 7, "", "a", "ab", "cc", "abcde", "zé", "b\U0001F600"]
    if deep and rnd.random() < 0.3:
        return [any_value(rnd, deep - 1) for _ in range(rnd.randint(0, 4))]
    if deep and rnd.random() < 0.3:
        return {rnd.choice(["n", "nx", "x", "long"]): any_value(rnd, deep - 1) for _ in range(rnd.randint(0, 3))}
    return rnd.choice(flat)


def test_random_values_against_brute_force(spark):
    rnd = random.Random(8)
    values = [any_value(rnd) for _ in range(60)] + [{"x": [1.0]}]
    names = [*SCHEMA["properties"], "other"]
    for _ in range(600):
        doc = {k: any_value(rnd) for k in names if rnd.random() < 0.6}
        if rnd.random() < 0.4:
            doc["tags"] = [rnd.choice(["ab", "cc", "bb", "a", 1]) for _ in range(rnd.randint(0, 4))]
        if rnd.random() < 0.3:
            doc["kind"] = rnd.choice(["a", 1.0, None, {"x": [1]}, {"x": [2]}])
        values.append(doc)
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "doc_id long, t string")
    got: dict = {}
    for r in json_rules.check(rows, "t", SCHEMA).collect():
        got.setdefault(r.doc_id, []).append((r.path, r.rule))
    for k, v in enumerate(values):
        assert sorted(got.get(k, [])) == sorted(brute(SCHEMA, v)), v
    seen = {rule for found in got.values() for _, rule in found}
    assert seen >= set("type enum minimum exclusiveMaximum multipleOf minLength pattern required dependentRequired additionalProperties propertyNames minItems uniqueItems contains anyOf oneOf not maxProperties".split())


def test_texts_that_are_no_json(spark):
    rows = spark.createDataFrame([(1, None), (2, "{"), (3, ""), (4, "null"), (5, "{}")], "doc_id long, t string")
    got = [tuple(r) for r in json_rules.check(rows, "t", {"type": "object"}).orderBy("doc_id").collect()]
    assert got == [(2, "$", "json"), (3, "$", "json"), (4, "$", "type")]
    assert json_rules.check(rows, "t", True).where("rule <> 'json'").count() == 0
    assert [r.doc_id for r in json_rules.check(rows, "t", False).where("rule = 'false'").collect()] == [4, 5]
    assert "Python" not in json_rules.check(rows, "t", SCHEMA)._jdf.queryExecution().toString()


def test_what_is_not_compiled_is_an_error(spark):
    for schema in ({"type": "text"}, {"unknown": 1}, {"$ref": "other.json"}, {"$ref": "#/$defs/none"}, {"$ref": "#"}, {"minimum": "1"}, {"items": [{}]}, {"properties": {"a": 3}}):
        with pytest.raises(ValueError):
            json_rules.violations(F.lit("1"), schema)
    assert json_rules.violations(F.lit("1"), {"x-any": 1, "title": "t", "format": "date"}) is not None
