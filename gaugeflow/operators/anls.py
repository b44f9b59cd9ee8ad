"""ANLS* scores of nested values without a schema.

Values are JSON: null, scalars, lists (matched optimally), objects, and lists
of alternatives for a text. Nested values are scored in Arrow batches; flat
texts and alternatives have native expressions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.assignment import assign
from ..functions.scalars import edit_distance, folded

#: A text less alike than this scores nothing.
LEAST = 0.5


@dataclass
class Options:
    """Alternatives of a ground truth; the best one counts."""

    values: list[Any] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.values:
            raise ValueError("no alternatives")


def _missing(x: Any) -> bool:
    return x is None or x == "" or x == [] or x == {}


def leaf(a: Any, b: Any) -> float:
    return _alike(str(a), str(b))


@lru_cache(maxsize=1 << 16)
def _alike(a: str, b: str) -> float:
    x, y = folded(a), folded(b)
    longer = max(len(x), len(y))
    # Remembered here already.
    score = 1.0 - edit_distance.__wrapped__(x, y) / longer if longer else 1.0
    return score if score >= LEAST else 0.0


def evaluate(gt: Any, pred: Any, key: tuple[str, ...] = ()) -> tuple[list[float], int, Any, list[tuple[tuple[str, ...], float]]]:
    """(leaf scores, divisor, ground truth closest to the prediction, scores by key)."""
    if isinstance(pred, (Options, tuple)):
        raise ValueError("a prediction has no alternatives")
    if isinstance(gt, (Options, tuple)):
        options = gt.values if isinstance(gt, Options) else list(gt)
        if not options:
            raise ValueError("no alternatives")
        found = [evaluate(x, pred, key) for x in options]
        return max(zip(found, options), key=lambda f: (_average(f[0]), f[1] == pred))[0]
    if gt is None:
        alike = _missing(pred)
        return [float(alike)], max(1, _leaves(pred)), pred if alike else None, []
    if isinstance(gt, dict) and isinstance(pred, dict):
        return _objects(gt, pred, key)
    if isinstance(gt, list) and isinstance(pred, list):
        return _lists(gt, pred, key)
    if isinstance(gt, (dict, list)) or isinstance(pred, (dict, list)) or pred is None:
        return [0.0], max(_leaves(gt), _leaves(pred)), gt, []
    return [leaf(gt, pred)], 1, gt, []


def _leaves(x: Any) -> int:
    """Leaves of a value; a null is one."""
    if isinstance(x, dict):
        return sum(map(_leaves, x.values()))
    if isinstance(x, (list, tuple)):
        return sum(map(_leaves, x))
    return 1


def _average(found: tuple) -> float:
    scores, size = found[0], found[1]
    return sum(scores) / size if size else 1.0


def _objects(gt: dict, pred: dict, key: tuple[str, ...]):
    """Keys of both sides; a null-like key that the truth lacks scores nothing but counts in the divisor."""
    scores: list[float] = []
    size, nearest, keyed = 0, {}, []
    for name in [*gt, *(k for k in pred if k not in gt)]:
        found = evaluate(gt.get(name), pred.get(name), (*key, str(name)))
        size += found[1]
        if name not in gt and _missing(pred[name]):
            continue
        scores += found[0]
        if name in pred or not _missing(found[2]):
            nearest[name] = found[2]
        keyed += [*found[3], ((*key, str(name)), _average(found))]
    return scores, size, nearest, keyed


def _lists(gt: list, pred: list, key: tuple[str, ...]):
    """The best pairing of elements; what is left over counts in the divisor only."""
    pairs = sorted(_paired(gt, pred)[0], key=lambda p: p[1])
    # Only what is paired is gone into.
    found = {(i, j): evaluate(gt[i], pred[j], key) for i, j in sorted(pairs)}
    scores, size, keyed = [], 0, []
    for f in found.values():
        scores += f[0]
        size += f[1]
    for p in pairs:
        keyed += found[p][3]
    used_i, used_j = {i for i, _ in pairs}, {j for _, j in pairs}
    rest = [x for i, x in enumerate(gt) if i not in used_i]
    size += sum(map(_leaves, rest)) + sum(_leaves(y) for j, y in enumerate(pred) if j not in used_j)
    return scores, size, [found[p][2] for p in pairs] + rest, keyed


# ---------------------------------------------------------------- scores alone

def _paired(gt: list, pred: list) -> tuple[list[tuple[int, int]], list[list[tuple[list[float], int, bool]]]]:
    """(pairs of the best pairing, in order of the truth, and ``scored`` of every two elements)."""
    table = [[scored(x, y) for y in pred] for x in gt]
    # An element that is exactly the other's closest truth is preferred.
    return assign([[1 + 1e-10 if f[2] else _average(f) for f in row] for row in table]), table


def scored(gt: Any, pred: Any) -> tuple[list[float], int, bool]:
    """(leaf scores, divisor, whether the closest ground truth is the prediction): of ``evaluate``, without making the rest."""
    if isinstance(gt, dict) and isinstance(pred, dict):
        return _scored_objects(gt, pred)
    if isinstance(gt, list) and isinstance(pred, list):
        return _scored_lists(gt, pred)
    if isinstance(gt, (str, int, float)) and isinstance(pred, (str, int, float)):
        return [leaf(gt, pred)], 1, gt == pred
    found = evaluate(gt, pred)
    return found[0], found[1], found[2] == pred


#: Most of what is compared; seen to without a call.
SCALARS = {str, int, float, bool}


def _scored_objects(gt: dict, pred: dict) -> tuple[list[float], int, bool]:
    scores: list[float] = []
    size, same = 0, True
    for name, x in gt.items():
        y = pred.get(name)
        if type(x) in SCALARS and type(y) in SCALARS:
            scores.append(_alike(x if type(x) is str else str(x), y if type(y) is str else str(y)))
            size += 1
            same = same and x == y
            continue
        if name not in pred:
            found = evaluate(x, None)
            # The closest truth has what the prediction lacks.
            same = same and _missing(found[2])
        else:
            found = scored(x, y)
            same = same and found[2]
        scores += found[0]
        size += found[1]
    for name, y in pred.items():
        if name not in gt:
            found = evaluate(None, y)
            size += found[1]
            same = False
            if not _missing(y):
                scores += found[0]
    return scores, size, same


def _scored_lists(gt: list, pred: list) -> tuple[list[float], int, bool]:
    pairs, table = _paired(gt, pred)
    scores: list[float] = []
    size = 0
    for i, j in pairs:
        scores += table[i][j][0]
        size += table[i][j][1]
    used_i, used_j = {i for i, _ in pairs}, {j for _, j in pairs}
    size += sum(_leaves(x) for i, x in enumerate(gt) if i not in used_i) + sum(_leaves(y) for j, y in enumerate(pred) if j not in used_j)
    return scores, size, len(gt) == len(pred) and all(table[i][j][2] for i, j in pairs)


def anls(gt: Any, pred: Any) -> float:
    """Score of a prediction; a list of texts against one text is a list of alternatives."""
    if isinstance(gt, list) and isinstance(pred, str) and gt and all(isinstance(x, str) for x in gt):
        gt = Options(gt)
    return _average(evaluate(gt, pred))


def closest(gt: Any, pred: Any) -> Any:
    return evaluate(gt, pred)[2]


def key_scores(gt: Any, pred: Any) -> dict[tuple[str, ...], float]:
    """Mean score of each key path; of a repeated path the last counts."""
    return dict(evaluate(gt, pred)[3])


def compare_json(gt: Any, pred: Any) -> dict[str, Any]:
    """Score of two values, or what went wrong."""
    try:
        score = anls(gt, pred)
        return {"overall_score": score, "all_fields_matched": score == 1.0}
    except Exception as e:
        return {"error": str(e), "overall_score": 0.0, "field_scores": {}, "all_fields_matched": False}


KEY_SCORE = T.StructType([T.StructField("path", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType())])
RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("closest", T.StringType()), T.StructField("keys", T.ArrayType(KEY_SCORE)), T.StructField("error", T.StringType())])


def anls_json(gt: Column, pred: Column) -> Column:
    """Score, closest ground truth and key scores of two JSON texts, as a struct."""
    return F.pandas_udf(_anls_json, RESULT)(gt, pred)


def _anls_json(gt: pd.Series, pred: pd.Series) -> pd.DataFrame:
    out = []
    for a, b in zip(gt, pred):
        try:
            x, y = (json.loads(v) if v is not None else None for v in (a, b))
            if isinstance(x, list) and isinstance(y, str) and x and all(isinstance(v, str) for v in x):
                x = Options(x)
            found = evaluate(x, y)
            out.append((_average(found), json.dumps(found[2], sort_keys=True, default=str), [{"path": list(k), "score": s} for k, s in dict(found[3]).items()], None))
        except Exception as e:
            out.append((0.0, None, [], f"{type(e).__name__}: {e}"))
    return pd.DataFrame(out, columns=["score", "closest", "keys", "error"])


def anls_json_score(gt: Column, pred: Column) -> Column:
    """The score of ``anls_json`` alone, which costs a part of the whole; text that can't be read scores 0."""
    return F.pandas_udf(_anls_json_score, "double")(gt, pred)


def _anls_json_score(gt: pd.Series, pred: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(gt, pred):
        try:
            x, y = (json.loads(v) if v is not None else None for v in (a, b))
            if isinstance(x, list) and isinstance(y, str) and x and all(isinstance(v, str) for v in x):
                x = Options(x)
            out.append(_average(scored(x, y)))
        except Exception:
            # As a document with an error scores.
            out.append(0.0)
    return pd.Series(out, dtype="float64")


def anls_text(gt: Column, pred: Column) -> Column:
    """Native score of two texts."""

    def cut_off(score: Column) -> Column:
        return F.when(score < LEAST, 0.0).otherwise(score)

    # The score is bound to a name of its own, so that the distance is computed once.
    score = F.element_at(F.transform(F.array(C.levenshtein(gt, pred)), cut_off), 1)
    return F.when(gt.isNull(), (pred.isNull() | (pred == "")).cast("double")).when(pred.isNull(), 0.0).otherwise(score)


def anls_options(options: Column, pred: Column) -> Column:
    """Native score of the best alternative."""
    return F.array_max(F.transform(options, lambda x: anls_text(x, pred)))


def anls_flat(fields: list[tuple[Column, Column]]) -> Column:
    """Native score of flat objects given as (truth, prediction) of each key."""
    return sum((anls_text(a, b) for a, b in fields), F.lit(0.0)) / F.lit(float(len(fields)))


def key_score_means(df: DataFrame, keys: str = "keys") -> DataFrame:
    """Mean score of each key path over documents."""
    each = df.select(F.explode(keys).alias("k")).select(F.array_join("k.path", ".").alias("path"), "k.score")
    return each.groupBy("path").agg(F.avg("score").alias("score"), F.count("*").alias("n"))
