"""Model specifications: which fields a record has and how each is compared.

A specification is built in Python, from a JSON configuration or from a JSON
Schema with extension keys, and gives a Spark schema and both exports.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from ..functions.scalars import Comparator, Exact, Levenshtein, Numeric, create

# Names of scalar types and their Spark types.
SCALARS: dict[str, T.DataType] = {
    "str": T.StringType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "bytes": T.BinaryType(),
    "Any": T.StringType(),
}

# Settings that extension keys of a JSON Schema carry, as ``x-<any vendor>-<setting>``.
SETTINGS = ("comparator-config", "comparator", "match-threshold", "model-name", "threshold", "weight", "clip-under-threshold", "aggregate")
EXTENSION = "x-gaugeflow-"
_SETTING = re.compile(rf"^x-(?:[a-z0-9]+-)+?({'|'.join(SETTINGS)})$")
SCHEMA_TYPES = {"string": "str", "number": "float", "integer": "int", "boolean": "bool"}


@dataclass
class FieldSpec:
    """One field. ``kind``: a scalar name, ``list:<scalar>``, ``map:<scalar>`` (a dictionary with text keys), ``struct`` or ``list``; the last two have a model."""

    name: str
    kind: str = "str"
    comparator: Comparator = field(default_factory=Levenshtein)
    threshold: float = 0.5
    weight: float = 1.0
    clip: bool = True
    optional: bool = False
    default: Any = None
    model: "ModelSpec | None" = None
    aggregate: bool = False
    alias: str | None = None
    description: str | None = None
    examples: list[Any] | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.threshold <= 1:
            raise ValueError(f"{self.name}: threshold {self.threshold} is not in [0, 1]")
        if self.weight < 0:
            raise ValueError(f"{self.name}: weight {self.weight} is negative")
        if (self.kind in ("struct", "list")) != (self.model is not None):
            raise ValueError(f"{self.name}: kind {self.kind!r} and a model go together")
        if self.kind == "list" and (self.threshold != 0.5 or not isinstance(self.comparator, Levenshtein)):
            raise ValueError(f"{self.name}: a list of records takes threshold and comparator from its element model")

    @property
    def is_list(self) -> bool:
        return self.kind == "list" or self.kind.startswith("list:")

    @property
    def is_map(self) -> bool:
        return self.kind.startswith("map:")

    def spark_type(self) -> T.DataType:
        if self.kind == "struct":
            return self.model.schema()
        if self.kind == "list":
            return T.ArrayType(self.model.schema())
        if self.kind.startswith("list:"):
            return T.ArrayType(SCALARS[self.kind[5:]])
        if self.is_map:
            return T.MapType(T.StringType(), SCALARS[self.kind[4:]])
        return SCALARS[self.kind]


@dataclass
class ModelSpec:
    name: str
    fields: list[FieldSpec]
    match_threshold: float = 0.7

    def __post_init__(self) -> None:
        if not self.name.isidentifier():
            raise ValueError(f"{self.name!r} is no identifier")
        if not 0 <= self.match_threshold <= 1:
            raise ValueError(f"{self.name}: match_threshold {self.match_threshold} is not in [0, 1]")
        if not self.fields:
            raise ValueError(f"{self.name}: no fields")
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise ValueError(f"{self.name}: repeated field names")

    def __getitem__(self, name: str) -> FieldSpec:
        return next(f for f in self.fields if f.name == name)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type()) for f in self.fields])

    def paths(self, prefix: str = "") -> list[str]:
        """Dotted paths of all fields, parents first."""
        out = []
        for f in self.fields:
            out.append(prefix + f.name)
            if f.model:
                out += f.model.paths(f"{prefix}{f.name}.")
        return out

    def from_json(self, record: Any) -> dict[str, Any]:
        """A record with declared fields filled by their defaults, nested ones too; other keys stay as they are."""
        if not isinstance(record, dict):
            raise ValueError(f"{self.name}: an object is needed, not {type(record).__name__}")
        out = dict(record)
        for f in self.fields:
            key = f.alias if f.alias and f.alias in record else f.name
            if key != f.name:
                out.pop(key)
            value = record.get(key, f.default)
            if f.kind == "struct" and isinstance(value, dict):
                value = f.model.from_json(value)
            elif f.kind == "list" and isinstance(value, list):
                value = [f.model.from_json(x) if isinstance(x, dict) else x for x in value]
            elif value is not None:
                value = coerce(f, value)
            if value is None and key not in record and not f.optional and f.default is None and not f.is_list:
                raise ValueError(f"{self.name}.{f.name}: required")
            out[f.name] = value
        return out


def coerce(f: FieldSpec, value: Any) -> Any:
    """The value in its declared scalar type; text that reads as a number is taken as one."""
    kind = f.kind.removeprefix("list:")
    if f.kind.startswith("list:"):
        if not isinstance(value, list):
            raise ValueError(f"{f.name}: a list is needed")
        return [None if x is None else _scalar(f.name, kind, x) for x in value]
    if f.is_map:
        if not isinstance(value, dict):
            raise ValueError(f"{f.name}: an object is needed")
        return {k: None if x is None else _scalar(f"{f.name}.{k}", f.kind[4:], x) for k, x in value.items()}
    return _scalar(f.name, kind, value)


def _scalar(name: str, kind: str, value: Any) -> Any:
    try:
        if kind == "int":
            if isinstance(value, float) and value != int(value):
                raise ValueError
            return int(value)
        if kind == "float":
            return float(value)
        if kind == "bool" and not isinstance(value, bool):
            known = {"true": True, "false": False, "1": True, "0": False, "yes": True, "no": False}
            return known[str(value).lower()]
        if kind == "str" and not isinstance(value, str):
            raise ValueError
    except (ValueError, TypeError, KeyError):
        raise ValueError(f"{name}: {value!r} is no {kind}") from None
    return value


def plain(name: str, kind: str, model: ModelSpec | None = None, match_threshold: float = 0.7, **more: Any) -> FieldSpec:
    """A field without comparison settings: records have threshold 0.9, scalars the class's match threshold."""
    return FieldSpec(name, kind, model=model, threshold=0.5 if kind == "list" else 0.9 if kind == "struct" else match_threshold, **more)


# ---------------------------------------------------------------- type names

_GENERIC = re.compile(r"^(Optional|List|Dict|Tuple|Set|Union|list|dict|tuple|set)\[(.*)\]$")
_custom_types: dict[str, str] = {}


def register_type(name: str, kind: str) -> None:
    _custom_types[name] = kind


def resolve_type(text: str) -> tuple[str, bool]:
    """(kind, optional) of a type name such as ``Optional[List[str]]``."""
    text = text.strip()
    if text in _custom_types:
        return _custom_types[text], False
    if text in SCALARS:
        return text, False
    short = {"structured_model": ("struct", False), "list_structured_model": ("list", False), "optional_structured_model": ("struct", True), "list": ("list:str", False), "dict": ("Any", False), "tuple": ("Any", False), "set": ("Any", False)}
    if text in short:
        return short[text]
    m = _GENERIC.match(text)
    if not m:
        raise ValueError(f"unknown type {text!r}")
    outer, inner = m[1].lower(), m[2]
    if outer == "optional":
        return resolve_type(inner)[0], True
    if outer == "union":
        parts = [p for p in split_arguments(inner) if p not in ("None", "NoneType")]
        optional = len(parts) < len(split_arguments(inner))
        return (resolve_type(parts[0])[0] if len(parts) == 1 else "Any"), optional
    if outer == "list":
        kind, _ = resolve_type(inner)
        return ("list:" + kind if kind in SCALARS else "list:Any"), False
    if outer == "dict":
        key, *rest = split_arguments(inner)
        value = resolve_type(rest[0])[0] if len(rest) == 1 else None
        return (f"map:{value}" if key == "str" and value in SCALARS else "Any"), False
    return "Any", False


def split_arguments(text: str) -> list[str]:
    """Comma-separated arguments, not split inside brackets."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "[") - (c == "]")
        if c == "," and depth == 0:
            out.append(text[start:k].strip())
            start = k + 1
    return [*out, text[start:].strip()]


# ---------------------------------------------------------------- JSON configuration

def model_from_config(config: dict[str, Any]) -> ModelSpec:
    """A specification from ``{model_name, match_threshold, fields: {name: {type, comparator, ...}}}``."""
    fields = config.get("fields")
    if not isinstance(fields, dict) or not fields:
        raise ValueError("a configuration needs a non-empty object of fields")
    made = []
    for name, own in fields.items():
        try:
            made.append(_configured(name, own))
        except (ValueError, KeyError) as e:
            raise ValueError(f"field {name!r}: {e.args[0] if e.args else e}") from e
    return ModelSpec(config.get("model_name", "DynamicModel"), made, config.get("match_threshold", 0.7))


def _configured(name: str, own: dict[str, Any]) -> FieldSpec:
    if "type" not in own:
        raise ValueError("no type")
    kind, optional = resolve_type(own["type"])
    for key in ("clip_under_threshold", "aggregate", "required"):
        if key in own and not isinstance(own[key], bool):
            raise ValueError(f"{key} must be true or false")
    optional = optional or not own.get("required", own.get("default") is None)
    common = dict(name=name, kind=kind, optional=optional, default=own.get("default"), weight=own.get("weight", 1.0), clip=own.get("clip_under_threshold", True), aggregate=own.get("aggregate", False), alias=own.get("alias"), description=own.get("description"), examples=own.get("examples"))
    if kind in ("struct", "list"):
        if "fields" not in own:
            raise ValueError("a nested record needs fields")
        if "comparator" in own:
            raise ValueError("a nested record has no comparator")
        model = model_from_config({"model_name": own.get("model_name", f"{name.title()}Model"), "match_threshold": own.get("match_threshold", 0.7), "fields": own["fields"]})
        return FieldSpec(**common, model=model, threshold=0.5 if kind == "list" else own.get("threshold", 0.7))
    if "fields" in own:
        raise ValueError("only nested records have fields")
    comparator = create(own.get("comparator", "LevenshteinComparator"), own.get("comparator_config"))
    return FieldSpec(**common, comparator=comparator, threshold=own.get("threshold", 0.5))


def to_config(model: ModelSpec) -> dict[str, Any]:
    """The JSON configuration that makes an equal specification."""
    fields = {}
    for f in model.fields:
        own: dict[str, Any] = {"weight": f.weight, "clip_under_threshold": f.clip, "required": not f.optional and f.default is None}
        if f.kind == "struct":
            own |= {"type": "structured_model", "threshold": f.threshold, **{k: v for k, v in to_config(f.model).items()}}
        elif f.kind == "list":
            own |= {"type": "list_structured_model", **to_config(f.model)}
        else:
            own |= {"type": f"List[{f.kind[5:]}]" if f.is_list else f"Dict[str, {f.kind[4:]}]" if f.is_map else f.kind, "comparator": f.comparator.name, "threshold": f.threshold}
            if f.comparator.config():
                own["comparator_config"] = f.comparator.config()
        own |= {k: v for k, v in (("default", f.default), ("alias", f.alias), ("description", f.description), ("examples", f.examples)) if v is not None}
        fields[f.name] = own
    return {"model_name": model.name, "match_threshold": model.match_threshold, "fields": fields}


# ---------------------------------------------------------------- JSON Schema

def check_schema(schema: Any, where: str = "schema") -> None:
    """Structural check of the parts of JSON Schema that specifications use."""
    if not isinstance(schema, dict):
        raise ValueError(f"{where}: an object is needed")
    kind = schema.get("type")
    known = {"string", "number", "integer", "boolean", "object", "array", "null"}
    for k in kind if isinstance(kind, list) else [kind] if kind is not None else []:
        if k not in known:
            raise ValueError(f"{where}: unknown type {k!r}")
    if not isinstance(schema.get("properties", {}), dict):
        raise ValueError(f"{where}: properties must be an object")
    required = schema.get("required", [])
    if not isinstance(required, list) or not all(isinstance(x, str) for x in required):
        raise ValueError(f"{where}: required must be a list of names")
    for name, own in schema.get("properties", {}).items():
        check_schema(own, f"{where}.{name}")
    if "items" in schema:
        check_schema(schema["items"], f"{where}[]")


def model_from_json_schema(schema: dict[str, Any], vendor: str | None = None) -> ModelSpec:
    """A specification from a JSON Schema of an object, with the extension keys ``x-<vendor>-...``; without ``vendor``, of any."""
    check_schema(schema)
    if schema.get("type", "object") != "object" or not schema.get("properties"):
        raise ValueError("a JSON Schema of an object with properties is needed")
    return _from_object(schema, schema.get("title", "DynamicModel"), {**schema.get("definitions", {}), **schema.get("$defs", {})}, vendor)


def extensions(own: dict[str, Any], vendor: str | None = None) -> dict[str, Any]:
    """The settings among a schema's extension keys of one vendor, or whatever their vendor part."""
    return {m[1]: v for k, v in own.items() if (m := _SETTING.match(k)) and (vendor is None or k == f"x-{vendor}-{m[1]}")}


def _from_object(schema: dict[str, Any], name: str, shared: dict[str, Any], vendor: str | None) -> ModelSpec:
    required = set(schema.get("required", []))
    fields = [_from_property(k, own, k in required, shared, vendor) for k, own in schema.get("properties", {}).items()]
    ext = extensions(schema, vendor)
    return ModelSpec(re.sub(r"\W+", "", ext.get("model-name", name)) or "DynamicModel", fields, ext.get("match-threshold", 0.7))


def _resolved(own: dict[str, Any], shared: dict[str, Any]) -> dict[str, Any]:
    ref = own.get("$ref")
    if ref is None:
        return own
    if not re.match(r"#/(definitions|\$defs)/[^/]+$", ref):
        raise ValueError(f"unsupported reference {ref!r}")
    target = ref.rsplit("/", 1)[1]
    if target not in shared:
        raise ValueError(f"reference {ref!r} leads nowhere")
    return {**shared[target], **{k: v for k, v in own.items() if k != "$ref"}}


def _from_property(name: str, own: dict[str, Any], required: bool, shared: dict[str, Any], vendor: str | None) -> FieldSpec:
    own = _resolved(own, shared)
    ext = extensions(own, vendor)
    weight = ext.get("weight", 1.0)
    if isinstance(weight, bool) or not isinstance(weight, (int, float)) or weight <= 0:
        raise ValueError(f"{name}: weight must be a positive number")
    threshold = ext.get("threshold", 0.5)
    if isinstance(threshold, bool) or not isinstance(threshold, (int, float)) or not 0 <= threshold <= 1:
        raise ValueError(f"{name}: threshold must be a number from 0 to 1")
    common = dict(name=name, weight=weight, clip=ext.get("clip-under-threshold", True), aggregate=ext.get("aggregate", False), optional=not required, default=own.get("default"), description=own.get("description"), examples=own.get("examples"))
    kind = own.get("type")
    if isinstance(kind, list):
        kinds = [k for k in kind if k != "null"]
        common["optional"] = common["optional"] or len(kinds) < len(kind)
        kind = kinds[0] if len(kinds) == 1 else None
    if kind in SCHEMA_TYPES:
        return FieldSpec(**common, kind=SCHEMA_TYPES[kind], threshold=threshold, comparator=_extension_comparator(kind, ext))
    more = own.get("additionalProperties")
    if kind == "object" and not own.get("properties") and isinstance(more, dict) and _resolved(more, shared).get("type") in SCHEMA_TYPES:
        value = _resolved(more, shared)["type"]
        return FieldSpec(**common, kind="map:" + SCHEMA_TYPES[value], threshold=threshold, comparator=_extension_comparator(value, ext))
    if kind == "object":
        return FieldSpec(**common, kind="struct", threshold=0.7, model=_from_object(own, own.get("title", f"{name.title()}Model"), shared, vendor))
    if kind == "array":
        item = _resolved(own.get("items", {"type": "string"}), shared)
        if item.get("type") == "object":
            return FieldSpec(**common, kind="list", model=_from_object(item, item.get("title", f"{name.title()}Model"), shared, vendor))
        if item.get("type") in SCHEMA_TYPES:
            return FieldSpec(**common, kind="list:" + SCHEMA_TYPES[item["type"]], threshold=threshold, comparator=_extension_comparator(item["type"], ext))
        raise ValueError(f"{name}: unsupported items")
    raise ValueError(f"{name}: unsupported type {kind!r}")


def _extension_comparator(kind: str, ext: dict[str, Any]) -> Comparator:
    if "comparator" in ext:
        return create(ext["comparator"], ext.get("comparator-config"))
    return {"string": Levenshtein, "boolean": Exact}.get(kind, Numeric)()


def _plain_schema(f: FieldSpec) -> dict[str, Any]:
    """The JSON Schema of a scalar field, a list of scalars or a dictionary."""
    one = {"type": {v: k for k, v in SCHEMA_TYPES.items()}.get(f.kind.removeprefix("list:").removeprefix("map:"), "string")}
    return {"type": "array", "items": one} if f.is_list else {"type": "object", "additionalProperties": one} if f.is_map else one


def to_json_schema(model: ModelSpec) -> dict[str, Any]:
    """The JSON Schema, with extension keys, that makes an equal specification."""
    properties = {}
    for f in model.fields:
        ext = {"weight": f.weight, "clip-under-threshold": f.clip}
        if f.kind == "struct":
            own = to_json_schema(f.model)
        elif f.kind == "list":
            own = {"type": "array", "items": to_json_schema(f.model)}
        else:
            own = _plain_schema(f)
            ext |= {"comparator": f.comparator.name, "threshold": f.threshold}
            if f.comparator.config():
                ext["comparator-config"] = f.comparator.config()
        own |= {EXTENSION + k: v for k, v in ext.items()}
        own |= {k: v for k, v in (("default", f.default), ("description", f.description), ("examples", f.examples)) if v is not None}
        properties[f.name] = own
    return {"type": "object", "title": model.name, EXTENSION + "model-name": model.name, EXTENSION + "match-threshold": model.match_threshold, "properties": properties, "required": [f.name for f in model.fields if not f.optional]}


def comparison_schema(model: ModelSpec) -> dict[str, Any]:
    """The plain JSON Schema of a model's records, each property with how it is compared under ``x-comparison``."""
    properties = {}
    for f in model.fields:
        if f.kind == "struct":
            own = comparison_schema(f.model)
        elif f.kind == "list":
            own = {"type": "array", "items": comparison_schema(f.model)}
        else:
            own = _plain_schema(f)
        own |= {k: v for k, v in (("default", f.default), ("description", f.description), ("examples", f.examples)) if v is not None}
        named = "StructuredModelComparator" if f.model else f.comparator.name
        own["x-comparison"] = {"comparator_type": named, "comparator_name": named, "comparator_config": {} if f.model else f.comparator.config(), "threshold": f.threshold, "weight": f.weight, "clip_under_threshold": f.clip, "aggregate": f.aggregate}
        properties[f.name] = own
    return {"type": "object", "title": model.name, "properties": properties, "required": [f.name for f in model.fields if not f.optional and f.default is None]}


def validate_instance(schema: dict[str, Any], value: Any, where: str = "$") -> list[str]:
    """What in a value is against its JSON Schema: types, required names, items."""
    kinds = schema.get("type")
    kinds = kinds if isinstance(kinds, list) else [kinds] if kinds else []
    fits = {"string": lambda v: isinstance(v, str), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool), "boolean": lambda v: isinstance(v, bool), "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "null": lambda v: v is None}
    if kinds and not any(fits[k](value) for k in kinds):
        return [f"{where}: {json.dumps(value, default=str)} is no {' or '.join(kinds)}"]
    out = []
    if isinstance(value, dict):
        out += [f"{where}: {name!r} is required" for name in schema.get("required", []) if name not in value]
        for name, own in schema.get("properties", {}).items():
            if name in value:
                out += validate_instance(own, value[name], f"{where}.{name}")
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            out += validate_instance(schema["items"], x, f"{where}[{k}]")
    return out
