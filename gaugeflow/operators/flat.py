"""Native comparison of records: scalars, nested structs and lists matched by equality.

The specification is compiled into one projection of Catalyst expressions;
each field becomes a struct of counts and scores, and the long relation is an
explode of those structs. No Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import scalars as S
from ..plans.spec import FieldSpec, ModelSpec

COUNTS = ("tp", "fa", "fd", "fp", "tn", "fn")
#: Pairs of records count towards a list's score from here on.
ANY_LIKENESS = 0.01
PAIR_TYPE = "array<struct<i: int, j: int, raw: double, applied: double>>"


def counts(**own: Column) -> dict[str, Column]:
    one = {c: own.get(c, F.lit(0)).cast("long") for c in COUNTS}
    one["fp"] = one["fa"] + one["fd"]
    return one


def prepared(f: FieldSpec, value: Column) -> Column:
    """What the comparator of a scalar field looks at, made once for each value; null for null."""
    c, kind = f.comparator, {"float": "double", "bool": "boolean"}.get(f.kind, "string")
    if f.kind == "bytes":
        # As JSON has it.
        value = F.base64(value)
    if isinstance(c, S.Numeric):
        number = C.decimal_of(value, f.kind)
        # Without a tolerance numbers are equal or not.
        return number if c.relative_tolerance > 0 or c.absolute_tolerance > 0 else F.struct(number["key"].alias("key"))
    text = C.py_str(value, kind)
    if isinstance(c, S.Levenshtein):
        return F.lower(C.squeeze(text)) if c.normalize else text
    if isinstance(c, S.Fuzzy):
        return text
    if isinstance(c, S.Exact):
        return C.strip_punctuation_space(text if c.case_sensitive else F.lower(text))
    raise ValueError(f"{f.name}: {c.name} has no native form; use compare_documents")


def similarity(f: FieldSpec, x: Column, y: Column) -> Column:
    """Raw score of two prepared values of a scalar field, neither of which need be there."""
    c = f.comparator
    if isinstance(c, S.Numeric):
        return C.close(x, y, c.relative_tolerance, c.absolute_tolerance)
    if isinstance(c, S.Levenshtein):
        return C.levenshtein(x, y, normalize=False)
    if isinstance(c, S.Fuzzy):
        return C.fuzzy(x, y, c.method, c.normalize)
    return F.coalesce((x == y).cast("double"), F.lit(0.0))


def keyed(f: FieldSpec, a: Column, b: Column) -> Column:
    """The keys that a dictionary field's two sides have together, with prepared values: key, x, y, no_x, no_y.

    A key that only the prediction has, without a value, is left out.
    """
    one = replace(f, kind=f.kind[4:])
    x, y = (F.coalesce(v, F.map_from_entries(F.array().cast(f"array<struct<key: string, value: {f.spark_type().valueType.simpleString()}>>"))) for v in (a, b))
    met = F.map_zip_with(x, y, lambda k, v, w: F.struct(v.alias("a"), w.alias("b"), F.map_contains_key(x, k).alias("known")))
    counted = F.filter(F.map_entries(met), lambda e: e["value"]["known"] | ~C.is_empty_value(e["value"]["b"]))
    value = lambda e, s: e["value"][s]
    return F.transform(counted, lambda e: F.struct(e["key"].alias("key"), prepared(one, value(e, "a")).alias("x"), prepared(one, value(e, "b")).alias("y"), C.is_empty_value(value(e, "a")).alias("no_x"), C.is_empty_value(value(e, "b")).alias("no_y")))


def key_score(f: FieldSpec, e: Column) -> Column:
    """Score of a key of ``keyed``: 1 without a value on both sides, 0 without one on a side."""
    return F.when(e["no_x"] & e["no_y"], 1.0).when(e["no_x"] | e["no_y"], 0.0).otherwise(similarity(f, e["x"], e["y"]))


def closed_form(f: FieldSpec) -> bool:
    """Whether the optimal matching of a list field is a count of equal elements."""
    return f.kind.startswith("list:") and isinstance(f.comparator, S.Exact) and 0 < f.threshold <= 1


class Compiled:
    """A specification as successive projections.

    Each step names what the next ones use more than once: prepared values,
    then scores of leaves, then outcomes and scores of records from the
    innermost out. So no expression is written out twice in generated code.

    A list that needs an assignment has its pairs (i, j, raw, applied) in the
    column ``<path>~pairs``, where ``operators.nested`` puts them.
    """

    def __init__(self, model: ModelSpec, gt: str, pred: str, prefix: str = "", depth: int = 1, given: dict[str, str] | None = None):
        # Columns that hold scores of scalar fields already, by path.
        self.given = given or {}
        self.steps: list[dict[str, Column]] = [{}, {}]
        self.rows: list[dict[str, Column]] = []
        #: The rows of the record's own fields, and those fields.
        self.top: list[tuple[FieldSpec, dict[str, Column]]] = []
        self.root = depth
        self.missing: list[tuple[str, str]] = []
        self._record(model, F.col(gt), F.col(pred), prefix, depth)

    def on(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns of all steps."""
        for step in self.steps:
            df = df.withColumns(step) if step else df
        return df

    def _put(self, step: int, name: str, value: Column) -> Column:
        while len(self.steps) <= step:
            self.steps.append({})
        self.steps[step][name] = value
        return F.col(f"`{name}`")

    def _record(self, model: ModelSpec, gt: Column, pred: Column, prefix: str, depth: int) -> tuple[int, Column, Column]:
        """(step, unclipped score, score) of a record, both usable from that step on."""
        bare, applied, last = [], [], 1
        for f in model.fields:
            step, b, a = self._field(f, gt.getField(f.name), pred.getField(f.name), prefix + f.name, depth)
            bare.append(b * F.lit(float(f.weight)))
            applied.append(a * F.lit(float(f.weight)))
            last = max(last, step)
        total = F.lit(float(sum(f.weight for f in model.fields)) or 1.0)
        raw = self._put(last + 1, f"{prefix}~raw", sum(bare[1:], bare[0]) / total)
        own = self._put(last + 1, f"{prefix}~applied", sum(applied[1:], applied[0]) / total)
        return last + 1, raw, own

    def _scalar(self, f: FieldSpec, a: Column, b: Column, path: str) -> Column:
        """Raw score of a leaf, from prepared values."""
        if path in self.given:
            return self._put(1, f"{path}~s", F.coalesce(F.col(f"`{self.given[path]}`"), F.lit(0.0)))
        if f.is_map:
            met = self._put(0, f"{path}~keys", keyed(f, a, b))
            scores = F.transform(met, lambda e: key_score(f, e))
            return self._put(1, f"{path}~s", F.when(F.size(met) == 0, 1.0).otherwise(F.aggregate(scores, F.lit(0.0), lambda s, v: s + v) / F.size(met)))
        x, y = (self._put(0, f"{path}~{k}", prepared(f, v)) for k, v in (("a", a), ("b", b)))
        return self._put(1, f"{path}~s", similarity(f, x, y))

    def _field(self, f: FieldSpec, a: Column, b: Column, path: str, depth: int) -> tuple[int, Column, Column]:
        """Adds the field's row; (step, score without thresholds, score) as its record uses them."""
        if closed_form(f):
            return self._list(f, a, b, path, depth)
        if f.is_list:
            return self._matched(f, a, b, path, depth)
        below = f.kind == "struct"
        if below:
            step, raw, inner = self._record(f.model, a, b, f"{path}.", depth + 1)
            no_a, no_b, bare = a.isNull(), b.isNull(), inner
        else:
            step, raw = 1, self._scalar(f, a, b, path)
            missing = C.is_empty_list if f.is_map else C.is_empty_value
            no_a, no_b, bare = missing(a), missing(b), raw
        kind = self._put(step + 1, f"{path}~kind", F.when(no_a & no_b, "tn").when(no_a, "fa").when(no_b, "fn").when(raw >= F.lit(float(f.threshold)), "tp").otherwise("fd"))
        bare = self._put(step + 1, f"{path}~bare", C._nulls(a, b, bare))
        score = F.when(kind == "tn", 1.0).when(kind.isin("fa", "fn"), 0.0).otherwise(raw)
        applied = self._put(step + 2, f"{path}~applied", F.when(kind == "fd", F.lit(0.0) if f.clip else raw).otherwise(score))
        # A record that is missing on a side has nothing below it and is a leaf itself.
        leaf = kind.isin("tn", "fa", "fn") if below else F.lit(True)
        self._row(f, path, depth, leaf, kind, None, score, applied)
        if below:
            self.missing.append((path, f"{path}~kind"))
        return step + 2, bare, applied

    def _list(self, f: FieldSpec, a: Column, b: Column, path: str, depth: int) -> tuple[int, Column, Column]:
        x, y = (self._put(0, f"{path}~{k}", F.transform(F.coalesce(v, F.array().cast("array<string>")), lambda e: _exact_key(e))) for k, v in (("a", a), ("b", b)))
        common = self._put(1, f"{path}~common", F.aggregate(F.array_distinct(x), F.lit(0), lambda s, k: s + F.least(_count(x, k), _count(y, k))))
        n, m = F.size(x), F.size(y)
        pairs = self._put(2, f"{path}~pairs", F.when((n == 1) & (m == 1) & (common == 0), 0).otherwise(F.least(n, m)))
        score = self._put(2, f"{path}~s", F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(common.cast("double") / F.greatest(n, m)))
        bare = self._put(3, f"{path}~bare", F.when(a.isNull() & b.isNull(), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(score))
        own = counts(tp=common, fd=pairs - common, fa=m - pairs, fn=n - pairs, tn=((n == 0) & (m == 0)).cast("int"))
        self._row(f, path, depth, F.lit(True), F.lit(None).cast("string"), own, score, score)
        return 3, bare, score

    def _matched(self, f: FieldSpec, a: Column, b: Column, path: str, depth: int) -> tuple[int, Column, Column]:
        """A list whose pairs are known; the score is their mean, without those below a likeness, scaled by how much is paired."""
        pairs, records = F.col(f"`{path}~pairs`"), f.kind == "list"
        n, m = (self._put(0, f"{path}~{k}", F.coalesce(F.size(v), F.lit(0))) for k, v in (("n", a), ("m", b)))
        paired = self._put(0, f"{path}~paired", F.coalesce(F.size(pairs), F.lit(0)))
        limit = ANY_LIKENESS if records else f.threshold
        sums = lambda t: F.aggregate(F.coalesce(pairs, F.array().cast(PAIR_TYPE)), F.lit(0.0), lambda s, p: s + F.when(C.reaches(p["applied"], t), p["applied"]).otherwise(0.0))
        reached = (lambda p: p["raw"] >= F.lit(float(f.model.match_threshold))) if records else (lambda p: C.reaches(p["raw"], f.threshold))
        good = self._put(1, f"{path}~good", F.coalesce(F.size(F.filter(pairs, reached)), F.lit(0)))
        none = (n == 0) | (m == 0)
        score = self._put(1, f"{path}~s", F.when((n == 0) & (m == 0), 1.0).when(none, 0.0).otherwise(sums(limit) / F.greatest(n, m)))
        bare = self._put(2, f"{path}~bare", F.when(a.isNull() & b.isNull(), 1.0).when(none, 0.0).otherwise(score if records else sums(0.0) / F.greatest(n, m)))
        own = counts(tp=good, fd=paired - good, fa=m - paired, fn=n - paired, tn=((n == 0) & (m == 0)).cast("int"))
        leaf = none | ((good == 0) & (n == paired) & (m == paired)) if records else F.lit(True)
        self._row(f, path, depth, leaf, F.lit(None).cast("string"), own, score, score)
        return 2, bare, score

    def _row(self, f: FieldSpec, path: str, depth: int, leaf: Column, kind: Column, own: dict[str, Column] | None, raw: Column, applied: Column) -> None:
        """Adds a row of ``ROW``, with its own counts or with those of its outcome."""
        if own is None:
            own = {c: (kind.isin("fa", "fd") if c == "fp" else kind == c).cast("long") for c in COUNTS}
        row = {"path": F.lit(path), "depth": F.lit(depth), "is_leaf": leaf, **own, "raw": raw, "applied": applied, "weight": F.lit(float(f.weight)), "threshold": F.lit(float(f.threshold)), "outcome": kind}
        self.rows.append(row)
        if depth == self.root:
            self.top.append((f, row))

    def whole(self, extras: Column) -> dict[str, Column]:
        """The document's own row: sums over its direct fields and undeclared keys, and its weighted score.

        Written out for each field: sums over the finished array would be
        interpreted, and would have it made again for each of them.
        """
        sums = {c: sum((row[c] for _, row in self.top), F.lit(0).cast("long")) for c in COUNTS}
        for c in ("fa", "fp"):
            sums[c] = sums[c] + extras.cast("long")
        total = sum(float(f.weight) for f, _ in self.top)
        score = sum((row["applied"] * row["weight"] for _, row in self.top), F.lit(0.0)) / F.lit(total) if total else F.lit(0.0)
        none = F.lit(None).cast("double")
        return {"path": F.lit(""), "depth": F.lit(0), "is_leaf": F.lit(False), **sums, "raw": score, "applied": score, "weight": none, "threshold": none, "outcome": F.lit(None).cast("string")}

    def outcomes(self, extras: Column | None = None) -> Column:
        """All rows, without those below a record that is missing on a side; with ``extras`` the document's own is the first.

        To explode them, explode this expression. Of a column that holds
        it Spark infers that it is not empty, and makes all that
        lies beneath a second time, written out as one filter of the scan.
        """
        rows = F.array(*[F.struct(*[row[c].alias(c) for c in ROW]) for row in ([self.whole(extras)] if extras is not None else []) + self.rows])
        if not self.missing:
            return rows
        absent = F.array(*[F.when(F.col(f"`{kind}`").isin("tn", "fa", "fn"), path + ".") for path, kind in self.missing])
        return F.filter(rows, lambda r: ~F.exists(absent, lambda p: F.coalesce(r["path"].startswith(p), F.lit(False))))


def _exact_key(e: Column) -> Column:
    return F.lower(C.strip_punctuation_space(F.coalesce(e.cast("string"), F.lit(""))))


def _count(array: Column, key: Column) -> Column:
    return F.size(F.filter(array, lambda e: e == key))


ROW = ["path", "depth", "is_leaf", *COUNTS, "raw", "applied", "weight", "threshold", "outcome"]


def compare_flat(pairs: DataFrame, model: ModelSpec, gt: str = "gt", pred: str = "pred", keys: tuple[str, ...] = ("doc_id",), documents: bool = False, extras: str | None = None, given: dict[str, str] | None = None) -> DataFrame:
    """Long relation of native outcomes: keys, path, depth, is_leaf, six counts, raw, applied, weight, threshold, outcome.

    ``gt`` and ``pred`` are structs with the model's fields. A nested struct
    that is missing on one side has no rows for what is below it and is a
    leaf. With ``documents`` each pair has a row of its own, with the empty
    path; the column ``extras`` then holds the number of undeclared keys of
    its prediction (``sources.records.parse`` counts them), which are false
    alarms of the document. ``given`` names columns with scores of scalar
    fields by path, which are taken instead of the comparator's; null is 0.
    """
    built = Compiled(model, gt, pred, given=given)
    wide = pairs.select(*keys, gt, pred, *[f"`{c}`" for c in (given or {}).values()], *([F.col(extras).alias("~extras")] if extras else []))
    rows = built.outcomes(_undeclared(extras) if documents else None)
    return built.on(wide).select(*keys, F.explode(rows).alias("r")).select(*keys, *[f"r.{c}" for c in ROW])


def _undeclared(extras: str | None) -> Column:
    return F.coalesce(F.col("~extras"), F.lit(0)) if extras else F.lit(0)


def compare_documents_wide(pairs: DataFrame, model: ModelSpec, gt: str, pred: str, extras: str | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """One row for each pair: doc_id, the columns ``also``, and ``~rows``, an array of the rows of ``compare_flat``, the document's own first."""
    built = Compiled(model, gt, pred)
    more = also or {}
    wide = pairs.select("doc_id", gt, pred, *[c.alias(n) for n, c in more.items()], *([F.col(extras).alias("~extras")] if extras else []))
    return built.on(wide).select("doc_id", *[f"`{n}`" for n in more], built.outcomes(_undeclared(extras)).alias("~rows"))


def map_fields(model: ModelSpec, prefix: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], FieldSpec]]:
    """The dictionary fields of a record, also within its nested structs: (names from the top, field)."""
    out = []
    for f in model.fields:
        if f.is_map:
            out.append(((*prefix, f.name), f))
        elif f.kind == "struct":
            out += map_fields(f.model, (*prefix, f.name))
    return out


def compare_keys(pairs: DataFrame, model: ModelSpec, gt: str = "gt", pred: str = "pred", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each key of either side of every dictionary field: keys, path, key, outcome, score, six counts.

    ``pairs`` has the sides as structs. A null or empty dictionary has no keys.
    A key without a value (null or empty text) on one side is a false alarm or
    false negative, on both a true negative; one that only the prediction has,
    without a value, has no row. Else the field's threshold decides. Sums by
    path and key need no more than ``metrics.bulk``, as ``path`` holds the key
    too, behind a dot. Dictionaries in list elements are not gone into.
    """
    parts = []
    for names, f in map_fields(model):
        a, b = F.col(gt), F.col(pred)
        for n in names:
            a, b = a.getField(n), b.getField(n)
        own = pairs.select(*keys, F.explode(keyed(f, a, b)).alias("e")).withColumn("score", key_score(f, F.col("e")))
        none_a, none_b = F.col("e.no_x"), F.col("e.no_y")
        kind = F.when(none_a & none_b, "tn").when(none_a, "fa").when(none_b, "fn").when(F.col("score") >= F.lit(float(f.threshold)), "tp").otherwise("fd")
        parts.append(own.select(*keys, F.concat(F.lit(".".join(names) + "."), F.col("e.key")).alias("path"), F.col("e.key").alias("key"), kind.alias("outcome"), "score"))
    if not parts:
        raise ValueError(f"{model.name}: no dictionary field")
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    own = {c: (F.col("outcome") == c).cast("long") for c in COUNTS} | {"fp": F.col("outcome").isin("fa", "fd").cast("long")}
    return rows.select("*", *[own[c].alias(c) for c in COUNTS])


def supports(model: ModelSpec) -> bool:
    """Whether records of a model have a native form."""
    for f in model.fields:
        if f.kind == "struct":
            if not supports(f.model):
                return False
        elif f.kind.startswith("list:"):
            if not closed_form(f):
                return False
        elif f.is_list or not isinstance(f.comparator, (S.Exact, S.Levenshtein, S.Numeric, S.Fuzzy)) or (f.is_map and isinstance(f.comparator, S.Fuzzy)):
            return False
    return True


def document_scores(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: overall score, whether all fields matched, and counts over its direct fields."""
    top = rows.where("depth = 1")
    return top.groupBy(*keys).agg(
        (F.sum(F.col("applied") * F.col("weight")) / F.sum("weight")).alias("overall_score"),
        F.min(F.col("raw") >= F.col("threshold")).alias("all_fields_matched"),
        *[F.sum(c).cast("long").alias(c) for c in COUNTS],
    )
