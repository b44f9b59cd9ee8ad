"""Row-level comparators, for values inside nested documents.

The same comparators as Catalyst expressions in ``columns``; these run inside
Arrow batches, where a nested list makes the number of comparisons depend on
the document. Fuzzy ratios exist here only.
"""

from __future__ import annotations

import math
import re
import string
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from functools import lru_cache
from typing import Any

IGNORED = str.maketrans("", "", string.punctuation + string.whitespace)


def squeeze(text: str) -> str:
    return " ".join(text.split())


@lru_cache(maxsize=1 << 16)
def folded(text: str) -> str:
    """Lower case, with single spaces."""
    return squeeze(text.lower())


@lru_cache(maxsize=1 << 16)
def bare(text: str, case_sensitive: bool) -> str:
    """Without ASCII punctuation and white space."""
    return (text if case_sensitive else text.lower()).translate(IGNORED)


@lru_cache(maxsize=1 << 16)
def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and substitutions between two texts.

    Columns of the distance table are held as two bit vectors, of rises and
    of falls, so a column costs a few operations on integers.
    """
    if a == b:
        return 0
    # What both begin or end with needs no edits.
    start, least = 0, min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    end = 0
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    whole, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rise, fall, distance = whole, 0, len(a)
    for c in b:
        hit = places.get(c, 0)
        free = hit | fall
        level = (((hit & rise) + rise) ^ rise) | hit
        up = fall | ~(level | rise) & whole
        down = level & rise
        distance += (up & top != 0) - (down & top != 0)
        up = (up << 1 | 1) & whole
        down = down << 1 & whole
        rise = down | ~(free | up) & whole
        fall = up & free
    return distance


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit for each character of ``a``."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    whole = (1 << len(a)) - 1
    state = whole
    for c in b:
        hit = state & places.get(c, 0)
        state = ((state + hit) | (state - hit)) & whole
    return len(a) - bin(state).count("1")


def indel_ratio(a: str, b: str) -> float:
    """``1 - (insertions + deletions) / total length``."""
    total = len(a) + len(b)
    return 2 * common_length(a, b) / total if total else 1.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer one; windows may run off its ends.

    Of two texts of one length either may be the shorter, and the better way
    counts.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    best = _best_window(a, b)
    return max(best, _best_window(b, a)) if len(a) == len(b) and best < 1.0 else best


def _best_window(a: str, b: str) -> float:
    n, best = len(a), 0.0
    for end in range(1, len(b) + n):
        window = b[max(0, end - n) : end]
        if window and 2 * min(n, len(window)) / (n + len(window)) > best:
            best = max(best, indel_ratio(a, window))
            if best == 1.0:
                break
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among common tokens and common tokens with either rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, only_a, only_b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if common and (not only_a or not only_b):
        return 1.0
    with_a, with_b = f"{common} {only_a}".strip(), f"{common} {only_b}".strip()
    best = indel_ratio(with_a, with_b)
    if common:
        best = max(best, indel_ratio(common, with_a), indel_ratio(common, with_b))
    return best


RATIOS: dict[str, Callable[[str, str], float]] = {"ratio": indel_ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio}


@dataclass
class Comparator:
    """A named similarity of two values with a match threshold of its own."""

    threshold: float = 0.7
    name = "Comparator"

    def compare(self, a: Any, b: Any) -> float:
        raise NotImplementedError

    def __call__(self, a: Any, b: Any) -> float:
        return self.compare(a, b)

    def binary_compare(self, a: Any, b: Any) -> tuple[int, int]:
        return (1, 0) if self.compare(a, b) >= self.threshold else (0, 1)

    def config(self) -> dict[str, Any]:
        """What makes an equal comparator; all of it survives export and import."""
        base = type(self)().__dict__
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_") and v != base.get(k)}


@dataclass
class Levenshtein(Comparator):
    normalize: bool = True
    name = "LevenshteinComparator"

    def compare(self, a: Any, b: Any) -> float:
        if isinstance(a, dict) or isinstance(b, dict):
            raise TypeError("a dictionary has no edit distance; use a nested model")
        a, b = "" if a is None else str(a), "" if b is None else str(b)
        if self.normalize:
            a, b = folded(a), folded(b)
        longer = max(len(a), len(b))
        return 1.0 - edit_distance(a, b) / longer if longer else 1.0


@dataclass
class Exact(Comparator):
    threshold: float = 1.0
    case_sensitive: bool = False
    name = "ExactComparator"

    def compare(self, a: Any, b: Any) -> float:
        if a is None or b is None:
            return float(a is None and b is None)
        a, b = str(a), str(b)
        if a == b:
            return 1.0
        return float(bare(a, self.case_sensitive) == bare(b, self.case_sensitive))


def as_decimal(value: Any) -> Decimal | None:
    """The number that a value stands for; null if it stands for none."""
    return _as_decimal(type(value), value) if isinstance(value, (int, float, str)) else None


@lru_cache(maxsize=1 << 16)
def _as_decimal(kind: type, value: Any) -> Decimal | None:
    if isinstance(value, (int, float)):
        return Decimal(str(value))
    if not isinstance(value, str):
        return None
    text = value.strip()
    if text.startswith("(") and text.endswith(")"):
        text = "-" + text[1:-1]
    try:
        return Decimal(re.sub(r"[^0-9.\-]", "", text))
    except InvalidOperation:
        return None


@dataclass
class Numeric(Comparator):
    threshold: float = 1.0
    relative_tolerance: float = 0.0
    absolute_tolerance: float = 0.0
    tolerance: float | None = None
    name = "NumericComparator"

    def __post_init__(self) -> None:
        if self.tolerance is not None:
            if self.absolute_tolerance:
                raise ValueError("give tolerance or absolute_tolerance, not both")
            self.absolute_tolerance, self.tolerance = self.tolerance, None

    def compare(self, a: Any, b: Any) -> float:
        if a is None or b is None:
            return float(a is None and b is None)
        x, y = as_decimal(a), as_decimal(b)
        if x is None or y is None:
            return 0.0
        if x == y:
            return 1.0
        gap = abs(x - y)
        if self.relative_tolerance > 0:
            rel = Decimal(str(self.relative_tolerance))
            if x == 0:
                return float(abs(y) <= rel)
            if gap <= abs(x) * rel:
                return 1.0
        return float(self.absolute_tolerance > 0 and gap <= Decimal(str(self.absolute_tolerance)))


@dataclass
class Fuzzy(Comparator):
    method: str = "ratio"
    normalize: bool = True
    name = "FuzzyComparator"

    def compare(self, a: Any, b: Any) -> float:
        if a is None or b is None:
            return float(a is None and b is None)
        a, b = str(a), str(b)
        if self.normalize:
            a, b = a.strip().lower(), b.strip().lower()
        if not a and not b:
            return 1.0
        return RATIOS.get(self.method, indel_ratio)(a, b)


@dataclass
class Structured(Comparator):
    """Records by the score of their model; without one, equality. Two texts are an error if types are strict."""

    strict_types: bool = False
    model: Any = None
    name = "StructuredModelComparator"

    def compare(self, a: Any, b: Any) -> float:
        if self.strict_types and isinstance(a, str) and isinstance(b, str):
            raise TypeError("only records are compared here, not texts")
        if a is None or b is None:
            return float(a is None and b is None)
        if self.model is not None and isinstance(a, dict) and isinstance(b, dict):
            from ..operators.document import Evaluator

            return Evaluator(self.model).document(a, b).score
        return float(a == b)


def embedded(texts: Sequence[str], embed: Callable[[list[str]], list[list[float]]], attempts: int = 3, wait: float = 0.5) -> dict[str, list[float]]:
    """The embedding of each distinct text, all in one call; a call that fails is tried again after longer and longer waits.

    Texts are sent with single spaces; one without words has no embedding
    and is not sent.
    """
    wanted = {t: squeeze(t) for t in texts}
    asked = sorted({x for x in wanted.values() if x})
    found: dict[str, list[float]] = {"": []}
    for attempt in range(attempts):
        try:
            if asked:
                found.update(zip(asked, embed(asked), strict=True))
            break
        except Exception:
            if attempt + 1 == attempts:
                raise
            time.sleep(wait * 2**attempt)
    return {t: found[x] for t, x in wanted.items()}


def batch_scores(comparator: Comparator, a: Sequence[Any], b: Sequence[Any]) -> list[float]:
    """Scores of paired values; each distinct pair is compared once, so a model is asked once."""
    seen: dict[tuple, float] = {}
    out = []
    for x, y in zip(a, b):
        pair = (None if _is_null(x) else x, None if _is_null(y) else y)
        if pair not in seen:
            seen[pair] = float(comparator.compare(*pair))
        out.append(seen[pair])
    return out


def _is_null(x: Any) -> bool:
    return x is None or (isinstance(x, float) and math.isnan(x))


@dataclass
class Semantic(Comparator):
    """Cosine of two embeddings from a pluggable function of one text; without one, equality."""

    embedding_function: Callable[[str], list[float]] | None = None
    name = "SemanticComparator"
    _seen: dict = field(default_factory=dict, repr=False)

    def compare(self, a: Any, b: Any) -> float:
        if a is None or b is None:
            return 0.0
        try:
            x, y = (self._seen.setdefault(t, self.embedding_function(squeeze(str(t)))) if t not in self._seen else self._seen[t] for t in (a, b))
            norm = math.sqrt(sum(v * v for v in x)) * math.sqrt(sum(v * v for v in y))
            return sum(p * q for p, q in zip(x, y, strict=True)) / norm
        except Exception:
            # As documented: what can't be embedded is compared for equality.
            return float(a == b)


@dataclass
class Scored(Comparator):
    """A similarity from a pluggable function of two texts, for models that run elsewhere."""

    function: Callable[[str, str], float] | None = None
    name = "BERTComparator"

    def compare(self, a: Any, b: Any) -> float:
        if a is None or b is None:
            return 0.0
        a, b = str(a).translate(IGNORED), str(b).translate(IGNORED)
        if not a or not b:
            return float(a == b)
        return self.function(a, b) if self.function else float(a == b)


@dataclass
class Judged(Comparator):
    """1 if a pluggable judge's answer to a prompt contains "true"; its errors are the caller's."""

    judge: Callable[[str], str] | None = None
    guidelines: str | None = None
    name = "LLMComparator"

    def prompt(self, a: Any, b: Any) -> str:
        from html import escape

        more = f"\nGuidelines: {escape(self.guidelines)}" if self.guidelines else ""
        return f"Do these two values mean the same? Answer TRUE or FALSE.\nFirst: {escape(str(a))}\nSecond: {escape(str(b))}{more}"

    def compare(self, a: Any, b: Any) -> float:
        if a is None or b is None:
            return float(a is None and b is None)
        if self.judge is None:
            raise ValueError("a judge function is needed")
        return float("true" in self.judge(self.prompt(a, b)).lower())

    def details(self, a: Any, b: Any) -> dict[str, Any]:
        score = self.compare(a, b)
        return {"score": score, "match": score >= self.threshold, "prompt": self.prompt(a, b)}


_registry: dict[str, type[Comparator]] = {
    "LevenshteinComparator": Levenshtein,
    "ExactComparator": Exact,
    "NumericComparator": Numeric,
    "NumericExactC": Numeric,
    "FuzzyComparator": Fuzzy,
    "Fuzz": Fuzzy,
    "StructuredModelComparator": Structured,
    "SemanticComparator": Semantic,
    "BERTComparator": Scored,
    "LLMComparator": Judged,
}


def register(name: str, kind: type[Comparator]) -> None:
    if not (isinstance(kind, type) and issubclass(kind, Comparator)):
        raise TypeError(f"{name}: a Comparator subclass is needed")
    _registry[name] = kind


def registered() -> list[str]:
    return sorted(_registry)


def create(name: str, config: dict[str, Any] | None = None) -> Comparator:
    """A comparator by its registered name; a class that takes no such settings is made without them."""
    if name not in _registry:
        raise KeyError(f"unknown comparator {name!r}; known: {', '.join(registered())}")
    try:
        return _registry[name](**(config or {}))
    except TypeError:
        return _registry[name]()
