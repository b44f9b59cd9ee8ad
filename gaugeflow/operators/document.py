"""Whole-document comparison: nested records and lists of records to any depth.

One recursive evaluator over a specification gives scores, counts, pairings
and reasons in a single pass. Matching of list elements and raw similarities
are remembered while a document lasts, so no pair is compared twice. In
Spark it runs in ``mapInPandas`` batches and yields long relations; records
without lists of records are better served by ``operators.flat``, which
stays in the JVM.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from typing import Any

from ..functions.assignment import match_lists, normalised
from ..plans.spec import FieldSpec, ModelSpec

COUNTS = ("tp", "fa", "fd", "fp", "tn", "fn")
#: Pairs of list elements count towards a list's score from here on.
ANY_LIKENESS = 0.01
EPSILON = 1e-10


def zero() -> dict[str, int]:
    return dict.fromkeys(COUNTS, 0)


def counts(**own: int) -> dict[str, int]:
    out = zero() | own
    out["fp"] = out["fa"] + out["fd"]
    return out


def add(to: dict[str, int], more: dict[str, int]) -> None:
    for c in COUNTS:
        to[c] += more[c]


@dataclass
class Node:
    """Result of one field: its own counts, scores, and the results of fields below it."""

    overall: dict[str, int]
    raw: float | None = None
    applied: float | None = None
    weight: float | None = None
    fields: dict[str, "Node"] = field(default_factory=dict)

    @property
    def scored(self) -> bool:
        return self.raw is not None


@dataclass
class Result:
    """Result of one document."""

    overall: dict[str, int]
    score: float
    all_matched: bool
    fields: dict[str, Node]


class Evaluator:
    """Compares records (dictionaries) of one specification."""

    def __init__(self, model: ModelSpec, count_list_extras: bool = False):
        self.model = model
        self.count_list_extras = count_list_extras
        self.seen: dict[tuple, Any] = {}

    def document(self, gt: dict[str, Any], pred: dict[str, Any]) -> Result:
        self.seen.clear()
        return self.record(self.model, gt, pred)

    # -- scores

    def raw(self, model: ModelSpec, gt: dict, pred: dict) -> float:
        """Weighted mean of unclipped field similarities: what pairs list elements."""
        key = ("raw", id(gt), id(pred))
        if key not in self.seen:
            total = sum(f.weight for f in model.fields)
            self.seen[key] = sum(f.weight * self.raw_field(f, gt.get(f.name), pred.get(f.name)) for f in model.fields) / total if total else 0.0
        return self.seen[key]

    def raw_field(self, f: FieldSpec, a: Any, b: Any) -> float:
        if a is None or b is None:
            return float(a is None and b is None)
        if isinstance(a, list) and isinstance(b, list):
            return self.list_counts(f, a, b, 0.0)[1]
        if f.kind == "struct" and isinstance(a, dict) and isinstance(b, dict):
            return self.applied(f.model, a, b)
        return keyed_score(f, a, b) if f.is_map and isinstance(a, dict) and isinstance(b, dict) else f.comparator.compare(a, b)

    def applied(self, model: ModelSpec, gt: dict, pred: dict) -> float:
        """Score with thresholds and clipping in force."""
        return self.record(model, gt, pred).score

    # -- lists

    def pairs(self, f: FieldSpec, a: list, b: list) -> list[tuple[int, int, float]]:
        key = ("pairs", id(a), id(b), f.name)
        if key not in self.seen:
            if f.model and isinstance(a[0], dict):
                compare = lambda x, y: self.raw(f.model, x, y) if isinstance(x, dict) and isinstance(y, dict) else float(x == y)
                self.seen[key] = match_lists(a, b, compare)
            else:
                self.seen[key] = match_lists([normalised(x) for x in a], [normalised(x) for x in b], f.comparator.compare)
        return self.seen[key]

    def list_counts(self, f: FieldSpec, a: list, b: list, threshold: float) -> tuple[dict[str, int], float]:
        """(counts, score) of an unordered list: mean thresholded similarity, scaled by how much is paired."""
        if not a or not b:
            return counts(fn=len(a), fa=len(b)), 0.0
        pairs = self.pairs(f, a, b)
        if f.model and isinstance(a[0], dict):
            pairs = [(i, j, self.applied(f.model, a[i], b[j])) for i, j, _ in pairs]
            threshold = ANY_LIKENESS
        good = [s for _, _, s in pairs if s >= threshold or abs(s - threshold) < EPSILON]
        score = sum(good) / len(pairs) * (len(pairs) / max(len(a), len(b))) if pairs else 0.0
        return counts(tp=len(good), fd=len(pairs) - len(good), fa=len(b) - len(pairs), fn=len(a) - len(pairs)), score

    # -- fields

    def field(self, f: FieldSpec, a: Any, b: Any) -> Node:
        """Which of the five outcomes a field has, and its scores."""
        if f.is_list:
            no_a, no_b = a is None or a == [], b is None or b == []
            if no_a and no_b:
                return self._settled(f, counts(tn=1), 1.0)
            if no_a:
                return self._settled(f, counts(fa=len(b) if isinstance(b, list) else 1), 0.0)
            if no_b:
                return self._settled(f, counts(fn=len(a) if isinstance(a, list) else 1), 0.0)
        else:
            no_a, no_b = a is None or a == "" or (f.is_map and a == {}), b is None or b == "" or (f.is_map and b == {})
            if no_a and no_b:
                return self._settled(f, counts(tn=1), 1.0)
            if no_a or no_b:
                return self._settled(f, counts(fa=1) if no_a else counts(fn=1), 0.0)
        if f.is_map and isinstance(a, dict) and isinstance(b, dict):
            return self._judged(f, keyed_score(f, a, b))
        if isinstance(a, (str, int, float)) and isinstance(b, (str, int, float)):
            return self._judged(f, f.comparator.compare(a, b))
        if isinstance(a, list) and isinstance(b, list):
            return self._records(f, a, b) if f.model and isinstance(a[0], dict) else self._settled(f, *self.list_counts(f, a, b, f.threshold))
        if f.kind == "struct" and isinstance(a, dict) and isinstance(b, dict):
            node = self._judged(f, self.raw(f.model, a, b))
            node.fields = self.record(f.model, a, b).fields
            return node
        return self._settled(f, counts(fd=1), 0.0)

    def _settled(self, f: FieldSpec, own: dict[str, int], score: float) -> Node:
        return Node(own, score, score, f.weight)

    def _judged(self, f: FieldSpec, raw: float) -> Node:
        good = raw >= f.threshold
        return Node(counts(tp=1) if good else counts(fd=1), raw, raw if good or not f.clip else 0.0, f.weight)

    def _records(self, f: FieldSpec, a: list, b: list) -> Node:
        pairs = self.pairs(f, a, b)
        limit = f.model.match_threshold
        good = [(i, j) for i, j, s in pairs if s >= limit]
        rest_a = [x for i, x in enumerate(a) if i not in {p[0] for p in pairs}]
        rest_b = [x for j, x in enumerate(b) if j not in {p[1] for p in pairs}]
        own = counts(tp=len(good), fd=len(pairs) - len(good), fa=len(rest_b), fn=len(rest_a))
        _, score = self.list_counts(f, a, b, ANY_LIKENESS)
        node = Node(own, score, score, f.weight)
        if good or rest_a or rest_b:
            for sub in f.model.fields:
                node.fields[sub.name] = self._below(sub, a, b, good, rest_a, rest_b)
        return node

    def _below(self, sub: FieldSpec, a: list, b: list, good, rest_a: list, rest_b: list) -> Node:
        """A field of list elements, summed over the good pairs; what is unmatched adds only at leaves."""
        if sub.kind == "list" or sub.is_list or (sub.kind == "struct" and not sub.optional):
            found = [self.field(sub, a[i].get(sub.name), b[j].get(sub.name)) for i, j in good]
            node = merged(found)
            if sub.is_list and sub.kind != "list":
                for x in rest_a:
                    node.overall["fn"] += _size(x.get(sub.name))
                for x in rest_b:
                    n = _size(x.get(sub.name))
                    node.overall["fa"] += n
                    node.overall["fp"] += n
            return node
        own = zero()
        for i, j in good:
            add(own, self.classify(sub, a[i].get(sub.name), b[j].get(sub.name)))
        missing = sum(x.get(sub.name) is not None for x in rest_a)
        extra = sum(x.get(sub.name) is not None for x in rest_b)
        add(own, counts(fn=missing, fa=extra))
        return Node(own)

    def classify(self, f: FieldSpec, a: Any, b: Any) -> dict[str, int]:
        """Outcome of a leaf inside a matched pair; blank text counts as missing here."""
        no_a, no_b = _blank(a), _blank(b)
        if no_a or no_b:
            return counts(tn=1) if no_a and no_b else counts(fa=1) if no_a else counts(fn=1)
        if f.model and isinstance(a, dict) and isinstance(b, dict):
            alike = self.applied(f.model, a, b)
        elif f.is_map and isinstance(a, dict) and isinstance(b, dict):
            alike = keyed_score(f, a, b)
        else:
            alike = f.comparator.compare(a, b)
        return counts(tp=1) if alike >= f.threshold else counts(fd=1)

    # -- records

    def record(self, model: ModelSpec, gt: dict, pred: dict) -> Result:
        key = ("record", id(gt), id(pred))
        if key in self.seen:
            return self.seen[key]
        overall, fields, matched = zero(), {}, 0
        score = weight = 0.0
        for f in model.fields:
            node = fields[f.name] = self.field(f, gt.get(f.name), pred.get(f.name))
            add(overall, node.overall)
            score += node.applied * node.weight
            weight += node.weight
            matched += node.raw >= f.threshold
        extras = self.extras(model, pred)
        overall["fa"] += extras
        overall["fp"] += extras
        out = self.seen[key] = Result(overall, score / weight if weight else 0.0, matched == len(model.fields), fields)
        return out

    def extras(self, model: ModelSpec, pred: dict) -> int:
        """Undeclared keys of a prediction, in nested records too; in list elements only if asked for."""
        names = {f.name for f in model.fields}
        total = sum(k not in names for k in pred)
        for f in model.fields:
            value = pred.get(f.name)
            if f.kind == "struct" and isinstance(value, dict):
                total += self.extras(f.model, value)
            elif f.kind == "list" and isinstance(value, list) and self.count_list_extras:
                total += sum(self.extras(f.model, x) for x in value if isinstance(x, dict))
        return total


def keyed_score(f: FieldSpec, a: dict[str, Any], b: dict[str, Any]) -> float:
    """Mean score of the keys of two dictionaries, but those that only the prediction has, without a value."""
    missing = lambda v: v is None or v == ""
    names = [*a, *(k for k, v in b.items() if k not in a and not missing(v))]
    scores = []
    for k in names:
        x, y = a.get(k), b.get(k)
        scores.append(float(missing(x) and missing(y)) if missing(x) or missing(y) else f.comparator.compare(x, y))
    return sum(scores) / len(scores) if scores else 1.0


def _blank(value: Any) -> bool:
    return value is None or (isinstance(value, str) and not value.strip()) or (isinstance(value, (list, dict)) and not value)


def _size(value: Any) -> int:
    return len(value) if isinstance(value, list) and value else int(value is not None)


def merged(nodes: list[Node]) -> Node:
    """Sum of results of one field over pairs; the scores are the first pair's."""
    out = Node(zero())
    if nodes:
        out.raw, out.applied, out.weight = nodes[0].raw, nodes[0].applied, nodes[0].weight
    for node in nodes:
        add(out.overall, node.overall)
    for name in dict.fromkeys(n for node in nodes for n in node.fields):
        out.fields[name] = merged([node.fields[name] for node in nodes if name in node.fields])
        out.fields[name].raw = out.fields[name].applied = out.fields[name].weight = None
    return out


# ---------------------------------------------------------------- long relations

def long_rows(result: Result) -> list[tuple]:
    """(path, depth, is_leaf, six counts, raw, applied, weight) of the document ('' path) and each field."""
    rows = [("", 0, False, *(result.overall[c] for c in COUNTS), result.score, result.score, None)]

    def walk(prefix: str, fields: dict[str, Node], depth: int) -> None:
        for name, node in fields.items():
            rows.append((prefix + name, depth, not node.fields, *(node.overall[c] for c in COUNTS), node.raw, node.applied, node.weight))
            walk(f"{prefix}{name}.", node.fields, depth + 1)

    walk("", result.fields, 1)
    return rows


def _why(score: float, threshold: float, good: bool) -> str:
    if good:
        return "exact match" if math.isclose(score, 1.0) else f"above threshold ({score:.3f} >= {threshold})"
    return f"below threshold ({score:.3f} < {threshold})"


FN_REASON, FA_REASON = "false negative (unmatched ground truth)", "false alarm (unmatched prediction)"


def comparisons(ev: Evaluator, model: ModelSpec, gt: dict, pred: dict, fields: dict[str, Node]) -> list[tuple]:
    """(expected_key, expected, actual_key, actual, match, score, weighted, reason), one for each leaf comparison."""
    rows: list[tuple] = []
    for f in model.fields:
        a, b, node = gt.get(f.name), pred.get(f.name), fields[f.name]
        if a == [] or b == [] or (isinstance(a, list) and isinstance(b, list)):
            rows += _list_comparisons(ev, f, a or [], b or [])
        elif f.kind == "struct" and isinstance(a, dict) and isinstance(b, dict) and node.fields:
            rows += [(f"{f.name}.{r[0]}", r[1], f"{f.name}.{r[2]}", *r[3:]) for r in comparisons(ev, f.model, a, b, node.fields)]
        else:
            good = node.raw >= f.threshold
            score, weighted, why = node.raw, node.applied * node.weight, _why(node.raw, f.threshold, good)
            if (a is None) != (b is None):
                good, score, weighted, why = False, 0.0, 0.0, FN_REASON if b is None else FA_REASON
            rows.append((f.name, a, f.name, b, good, score, weighted, why))
    return rows


def _list_comparisons(ev: Evaluator, f: FieldSpec, a: list, b: list) -> list[tuple]:
    rows = []
    pairs = _document_pairs(ev, f, a, b)
    for i, j, s in pairs:
        if isinstance(a[i], dict) and isinstance(b[j], dict) and f.model:
            inner = ev.record(f.model, a[i], b[j]).fields
            for sub in f.model.fields:
                x, y, score = a[i].get(sub.name), b[j].get(sub.name), inner[sub.name].applied
                good = score >= sub.threshold
                why = _why(score, sub.threshold, good)
                if (x is None) != (y is None):
                    good, score, why = False, 0.0, FN_REASON if y is None else FA_REASON
                rows.append((f"{f.name}[{i}].{sub.name}", x, f"{f.name}[{j}].{sub.name}", y, good, score, score * sub.weight, why))
        else:
            limit = f.model.match_threshold if f.model else 0.7
            rows.append((f"{f.name}[{i}]", a[i], f"{f.name}[{j}]", b[j], s >= limit, s, s, _why(s, limit, s >= limit)))
    used_a, used_b = {p[0] for p in pairs}, {p[1] for p in pairs}
    rows += [(f"{f.name}[{i}]", x, None, None, False, 0.0, 0.0, FN_REASON) for i, x in enumerate(a) if i not in used_a]
    rows += [(f"{f.name}[]", None, f"{f.name}[{j}]", y, False, 0.0, 0.0, FA_REASON) for j, y in enumerate(b) if j not in used_b]
    return rows


def _document_pairs(ev: Evaluator, f: FieldSpec, a: list, b: list) -> list[tuple[int, int, float]]:
    """Pairs as documentation rows have them: lists of scalars pair by equality of their normalised values."""
    if not a or not b:
        return []
    if f.model and isinstance(a[0], dict):
        return ev.pairs(f, a, b)
    return match_lists([normalised(x) for x in a], [normalised(x) for x in b], lambda x, y: float(x == y))


def non_matches(ev: Evaluator, model: ModelSpec, gt: dict, pred: dict, fields: dict[str, Node]) -> list[tuple]:
    """(field_path, type, gt, pred, similarity, reason) of every false alarm, false negative and false discovery."""
    rows: list[tuple] = []
    for f in model.fields:
        a, b, node = gt.get(f.name), pred.get(f.name), fields[f.name]
        lists = isinstance(a, list) or isinstance(b, list)
        if lists and (not a or not b):
            rows += [(f"{f.name}[{i}]", "false_negative", x, None, None, "unmatched ground truth") for i, x in enumerate(a or [])]
            rows += [(f"{f.name}[{j}]", "false_alarm", None, y, None, "unmatched prediction") for j, y in enumerate(b or [])]
        elif isinstance(a, list) and isinstance(b, list):
            rows += _list_non_matches(ev, f, a, b)
        elif f.kind == "struct" and isinstance(a, dict) and isinstance(b, dict) and node.fields:
            rows += [(f"{f.name}.{r[0]}", *r[1:]) for r in non_matches(ev, f.model, a, b, node.fields)]
        elif node.overall["fa"]:
            rows.append((f.name, "false_alarm", a, b, None, "unmatched prediction"))
        elif node.overall["fn"]:
            rows.append((f.name, "false_negative", a, b, None, "unmatched ground truth"))
        elif node.overall["fd"]:
            rows.append((f.name, "false_discovery", a, b, node.raw, _why(node.raw, f.threshold, False)))
    return rows


def _list_non_matches(ev: Evaluator, f: FieldSpec, a: list, b: list) -> list[tuple]:
    rows = []
    pairs = _document_pairs(ev, f, a, b)
    limit = f.model.match_threshold if f.model else 0.7
    for i, j, s in pairs:
        if s >= limit:
            continue
        if f.model and isinstance(a[i], dict) and isinstance(b[j], dict):
            inner = non_matches(ev, f.model, a[i], b[j], ev.record(f.model, a[i], b[j]).fields)
            rows += [(f"{f.name}[{i}].{r[0]}", *r[1:]) for r in inner]
        else:
            rows.append((f"{f.name}[{i}]", "false_discovery", a[i], b[j], s, _why(s, limit, False)))
    used_a, used_b = {p[0] for p in pairs}, {p[1] for p in pairs}
    rows += [(f"{f.name}[{i}]", "false_negative", x, None, None, "unmatched ground truth") for i, x in enumerate(a) if i not in used_a]
    rows += [(f"{f.name}[{j}]", "false_alarm", None, y, None, "unmatched prediction") for j, y in enumerate(b) if j not in used_b]
    return rows


def as_text(value: Any) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, default=str, sort_keys=True)
