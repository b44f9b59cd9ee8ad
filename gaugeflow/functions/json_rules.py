"""JSON Schemas as Catalyst expressions: what in a JSON value is against its schema.

A schema is compiled once, on the driver, into one expression over a VARIANT
that gives an array of (path, rule). Elements of arrays and values of open
objects are gone through by ``transform``, so no row is exploded and no Python
runs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "array<struct<path: string, rule: string>>"
MAP, LIST = "map<string, variant>", "array<variant>"

# Keywords that say nothing about a value, and those that are compiled.
SILENT = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "definitions", "$defs", "format", "readOnly", "writeOnly", "deprecated", "contentEncoding", "contentMediaType"}
KNOWN = {
    "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "required", "properties", "patternProperties",
    "additionalProperties", "propertyNames", "minProperties", "maxProperties", "items", "minItems", "maxItems", "uniqueItems", "contains", "allOf", "anyOf", "oneOf", "not", "if", "then", "else", "dependentRequired", "$ref",
}


class Value:
    """A JSON value in an expression, with what the keywords ask of it."""

    def __init__(self, v: Column, path: Column):
        self.v, self.path = v, path
        self.name = F.schema_of_variant(v)
        self.there = v.isNotNull()
        self.string = self.name == "STRING"
        self.boolean = self.name == "BOOLEAN"
        self.null = self.name == "VOID"
        self.object = self.name.startswith("OBJECT")
        self.array = self.name.startswith("ARRAY")
        self.numeric = self.name.isin("BIGINT", "DOUBLE", "FLOAT") | self.name.startswith("DECIMAL")

    def as_(self, kind: str) -> Column:
        return F.try_variant_get(self.v, "$", kind)

    @property
    def number(self) -> Column:
        return self.as_("double")

    def is_(self, kind: str) -> Column:
        if kind == "integer":
            # As JSON Schema has it: 2.0 is an integer.
            return self.numeric & ((self.name == "BIGINT") | (self.number == F.floor(self.number).cast("double")))
        named = {"string": self.string, "number": self.numeric, "boolean": self.boolean, "null": self.null, "object": self.object, "array": self.array}
        return named[kind]


def _text(v: Column) -> Column:
    """The same text for equal values; a number's is its double's."""
    name = F.schema_of_variant(v)
    numeric = name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL")
    return F.when(numeric, F.concat(F.lit("n"), (F.try_variant_get(v, "$", "double") + F.lit(0.0)).cast("string"))).otherwise(F.to_json(v))


def _literal(value: Any) -> Column:
    return F.parse_json(F.lit(json.dumps(value)))


def _none() -> Column:
    return F.array().cast(FOUND)


class Compiler:
    """One schema with its shared definitions."""

    def __init__(self, schema: Any):
        self.root = schema
        self.open: list[str] = []

    def resolved(self, ref: Any) -> Any:
        """What a reference inside the schema points to (``#`` and a path of names and numbers)."""
        if not isinstance(ref, str) or not re.match(r"#(/|$)", ref):
            raise ValueError(f"unsupported reference {ref!r}")
        here = self.root
        for part in ref[2:].split("/") if len(ref) > 1 else []:
            part = part.replace("~1", "/").replace("~0", "~")
            try:
                here = here[int(part)] if isinstance(here, list) else here[part]
            except (KeyError, IndexError, ValueError, TypeError):
                raise ValueError(f"reference {ref!r} leads nowhere") from None
        return here

    def violations(self, schema: Any, x: Value) -> Column:
        """The array of (path, rule) of a value that is there; what is not there violates nothing."""
        if schema is True or schema == {}:
            return _none()
        if schema is False:
            return F.when(x.there, self._one(x, "false")).otherwise(_none())
        if not isinstance(schema, dict):
            raise ValueError(f"a schema must be an object, true or false, not {schema!r}")
        unknown = [k for k in schema if k not in KNOWN and k not in SILENT and not k.startswith("x-")]
        if unknown:
            raise ValueError(f"unsupported keywords: {', '.join(sorted(unknown))}")
        parts = [*self._own(schema, x), *self._inner(schema, x), *self._combined(schema, x)]
        if not parts:
            return _none()
        return F.when(x.there, F.concat(*parts) if len(parts) > 1 else parts[0]).otherwise(_none())

    def _one(self, x: Value, rule: str) -> Column:
        return F.array(F.struct(x.path.alias("path"), F.lit(rule).alias("rule"))).cast(FOUND)

    def _unless(self, x: Value, rule: str, good: Column) -> Column:
        return F.when(F.coalesce(good, F.lit(False)), _none()).otherwise(self._one(x, rule))

    def _own(self, schema: dict[str, Any], x: Value) -> list[Column]:
        """Keywords about the value itself. Those of one type let values of others pass."""
        out = []
        add = lambda rule, applies, good: out.append(self._unless(x, rule, ~applies | good))
        if "type" in schema:
            kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            fits = F.lit(False)
            for k in kinds:
                if k not in ("string", "number", "integer", "boolean", "null", "object", "array"):
                    raise ValueError(f"unknown type {k!r}")
                fits = fits | x.is_(k)
            out.append(self._unless(x, "type", fits))
        for rule in ("enum", "const"):
            if rule in schema:
                values = schema["enum"] if rule == "enum" else [schema["const"]]
                if not isinstance(values, list):
                    raise ValueError("enum must be a list")
                out.append(self._unless(x, rule, _text(x.v).isin([]) if not values else F.array_contains(F.array(*[_text(_literal(v)) for v in values]), _text(x.v))))
        n = x.number
        bounds: dict[str, Callable[[Column, Column], Column]] = {"minimum": lambda a, b: a >= b, "maximum": lambda a, b: a <= b, "exclusiveMinimum": lambda a, b: a > b, "exclusiveMaximum": lambda a, b: a < b}
        for rule, test in bounds.items():
            if rule in schema:
                add(rule, x.numeric, test(n, F.lit(float(_number(rule, schema[rule])))))
        if "multipleOf" in schema:
            step = float(_number("multipleOf", schema["multipleOf"]))
            if step <= 0:
                raise ValueError("multipleOf must be positive")
            share = n / F.lit(step)
            # Decimal steps such as 0.1 have no exact double.
            add("multipleOf", x.numeric, F.abs(share - F.rint(share)) <= F.greatest(F.abs(share), F.lit(1.0)) * 1e-12)
        size = {"Length": (x.string, F.length(x.as_("string"))), "Items": (x.array, F.size(x.as_(LIST))), "Properties": (x.object, F.size(x.as_(MAP)))}
        for what, (applies, found) in size.items():
            if f"min{what}" in schema:
                add(f"min{what}", applies, found >= F.lit(int(_number(what, schema[f"min{what}"]))))
            if f"max{what}" in schema:
                add(f"max{what}", applies, found <= F.lit(int(_number(what, schema[f"max{what}"]))))
        if "pattern" in schema:
            add("pattern", x.string, x.as_("string").rlike(schema["pattern"]))
        if schema.get("uniqueItems"):
            texts = F.transform(x.as_(LIST), _text)
            add("uniqueItems", x.array, F.size(F.array_distinct(texts)) == F.size(texts))
        return out

    def _inner(self, schema: dict[str, Any], x: Value) -> list[Column]:
        """Keywords about what is inside an object or an array."""
        out = []
        held = x.as_(MAP)
        lacks = lambda name: self._named(x, name, "required")
        for name in schema.get("required", []):
            out.append(F.when(x.object & ~F.map_contains_key(held, F.lit(name)), lacks(name)).otherwise(_none()))
        for name, others in schema.get("dependentRequired", {}).items():
            for other in others:
                out.append(F.when(x.object & F.map_contains_key(held, F.lit(name)) & ~F.map_contains_key(held, F.lit(other)), self._named(x, other, "dependentRequired")).otherwise(_none()))
        declared = schema.get("properties", {})
        for name, own in declared.items():
            child = Value(F.element_at(held, F.lit(name)), F.concat(x.path, F.lit("." + name)))
            out.append(F.when(x.object, self.violations(own, child)).otherwise(_none()))
        keys = F.map_entries(held)
        below = lambda e: Value(e["value"], F.concat(x.path, F.lit("."), e["key"]))
        patterns = schema.get("patternProperties", {})
        for pattern, own in patterns.items():
            named = _by_pattern(pattern)
            out.append(self._each(x.object, F.filter(keys, named), self._under(own, below)))
        if schema.get("additionalProperties", True) not in (True, {}):
            rest = F.filter(keys, lambda e: ~e["key"].isin(list(declared)) if declared else F.lit(True))
            for pattern in patterns:
                rest = F.filter(rest, _by_pattern(pattern, False))
            own = schema["additionalProperties"]
            if own is False:
                found = lambda e: F.array(F.struct(F.concat(x.path, F.lit("."), e["key"]).alias("path"), F.lit("additionalProperties").alias("rule"))).cast(FOUND)
            else:
                found = lambda e: self.violations(own, below(e))
            out.append(self._each(x.object, rest, found))
        if "propertyNames" in schema:
            # A name is a text of its own; quoted as JSON it is read again.
            name = lambda e: Value(F.to_variant_object(F.array(e["key"])), F.concat(x.path, F.lit("."), e["key"]))
            first = lambda e: Value(F.try_variant_get(name(e).v, "$[0]", "variant"), name(e).path)
            out.append(self._each(x.object, keys, lambda e: F.transform(self.violations(schema["propertyNames"], first(e)), lambda r: F.struct(r["path"].alias("path"), F.lit("propertyNames").alias("rule")))))
        if "items" in schema:
            if isinstance(schema["items"], list):
                raise ValueError("unsupported keywords: items by position")
            items = F.transform(x.as_(LIST), lambda v, k: F.struct(v.alias("value"), F.concat(F.lit("["), k.cast("string"), F.lit("]")).alias("key")))
            out.append(self._each(x.array, items, lambda e: self.violations(schema["items"], Value(e["value"], F.concat(x.path, e["key"])))))
        if "contains" in schema:
            hit = F.exists(x.as_(LIST), lambda v: F.size(self.violations(schema["contains"], Value(v, x.path))) == 0)
            out.append(self._unless(x, "contains", ~x.array | hit))
        return out

    def _named(self, x: Value, name: str, rule: str) -> Column:
        return F.array(F.struct(F.concat(x.path, F.lit("." + name)).alias("path"), F.lit(rule).alias("rule"))).cast(FOUND)

    def _under(self, schema: Any, below: Callable[[Column], Value]) -> Callable[[Column], Column]:
        return lambda e: self.violations(schema, below(e))

    def _each(self, applies: Column, entries: Column, found: Callable[[Column], Column]) -> Column:
        return F.when(applies, F.flatten(F.transform(entries, found))).otherwise(_none())

    def _combined(self, schema: dict[str, Any], x: Value) -> list[Column]:
        """Keywords that combine schemas. allOf and references give their own violations, the others one of their own name."""
        out = [self.violations(s, x) for s in schema.get("allOf", [])]
        holds = lambda s: F.size(self.violations(s, x)) == 0
        if "$ref" in schema:
            ref = schema["$ref"]
            if ref in self.open:
                raise ValueError(f"reference {ref!r} leads back to itself; an expression has no recursion")
            self.open.append(ref)
            out.append(self.violations(self.resolved(ref), x))
            self.open.pop()
        for rule in ("anyOf", "oneOf"):
            if rule in schema:
                fitting = F.lit(0)
                for s in schema[rule]:
                    fitting = fitting + holds(s).cast("int")
                out.append(self._unless(x, rule, fitting >= 1 if rule == "anyOf" else fitting == 1))
        if "not" in schema:
            out.append(self._unless(x, "not", ~holds(schema["not"])))
        if "if" in schema:
            then, other = (self.violations(schema.get(k, True), x) for k in ("then", "else"))
            out.append(F.when(holds(schema["if"]), then).otherwise(other))
        return out


def _by_pattern(pattern: str, fits: bool = True) -> Callable[[Column], Column]:
    """Whether an entry's key has the pattern, or has not."""
    return lambda e: e["key"].rlike(pattern) == F.lit(fits)


def _number(rule: str, value: Any) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{rule} must be a number")
    return value


def violations(column: Column | str, schema: Any) -> Column:
    """What in JSON text is against a JSON Schema: an array of (path, rule), empty if nothing.

    Paths start with ``$``. A null text has no violations, one that is no JSON
    has the rule ``json``. Bounds compare doubles, lengths count code points,
    patterns are searched for anywhere in a text. Keywords that are not
    compiled, and references that lead back to themselves, are errors when the
    expression is made; annotations and ``format`` say nothing.
    """
    text = F.col(column) if isinstance(column, str) else column
    parsed = F.try_parse_json(text)
    found = Compiler(schema).violations(schema, Value(parsed, F.lit("$")))
    broken = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule"))).cast(FOUND)
    return F.when(text.isNull(), _none()).when(parsed.isNull(), broken).otherwise(found)


def check(df: DataFrame, column: str, schema: Any, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each violation in a column of JSON text: keys, path, rule. Rows without violations have none."""
    return df.select(*keys, F.inline(violations(column, schema)))
