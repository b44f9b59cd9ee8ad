"""Corpus results as text, Markdown and JSON, from aggregates that are already small.

Everything here takes rows of ``bulk`` or summaries, one for each path or
type, never per-document data.
"""

from __future__ import annotations

import argparse
import json
import re
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..operators.metrics import COUNTS, derived

METRICS = ("precision", "recall", "f1", "accuracy")


@dataclass
class CorpusResult:
    """Totals of a corpus, of each field, and the errors by type."""

    document_count: int
    metrics: dict[str, float]
    field_metrics: dict[str, dict[str, float]]
    errors: dict[str, int] = field(default_factory=dict)
    total_time: float | None = None
    non_matches: list[dict[str, Any]] = field(default_factory=list)

    def to_markdown(self) -> str:
        lines = [f"# Evaluation of {self.document_count} documents", "", markdown_table(["", *COUNTS, *METRICS], [["overall", *_cells(self.metrics)]])]
        if self.field_metrics:
            lines += ["", "## Fields", "", markdown_table(["field", *COUNTS, *METRICS], [[k, *_cells(v)] for k, v in self.field_metrics.items()])]
        if self.errors:
            lines += ["", "## Errors", "", markdown_table(["type", "n"], [[k, v] for k, v in self.errors.items()])]
        return "\n".join(lines)

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=2, default=str)


def _cells(row: dict[str, float]) -> list[Any]:
    return [int(row[c]) for c in COUNTS] + [f"{row[m]:.4f}" for m in METRICS]


def collect(totals: DataFrame, documents: int, errors: DataFrame | None = None, recall_with_fd: bool = False, non_matches: DataFrame | None = None, most: int = 1000) -> CorpusResult:
    """A result from ``bulk`` totals; at most ``most`` non-matches are shown, as the report's own limit."""
    rows = {r["path"]: r.asDict() for r in derived(totals, recall_with_fd).collect()}
    zero = dict.fromkeys((*COUNTS, *METRICS), 0)
    whole = rows.pop("", zero)
    found = {r["error_type"]: r["n"] for r in errors.collect()} if errors is not None else {}
    shown = [r.asDict() for r in non_matches.limit(most).collect()] if non_matches is not None else []
    return CorpusResult(documents, whole, dict(sorted(rows.items())), found, non_matches=shown)


def markdown_table(head: list[str], rows: list[list[Any]]) -> str:
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, rows)])


def bar(share: float, width: int = 20) -> str:
    full = round(max(0.0, min(1.0, share)) * width)
    return "█" * full + "░" * (width - full)


def text_report(result: CorpusResult, only: str | None = None, sort_by: str = "name") -> str:
    """Plain text; ``only`` is a pattern of field names, ``sort_by`` a name or metric."""
    m = result.metrics
    out = [f"Documents  {result.document_count}", f"Errors     {sum(result.errors.values())}", "", f"{'':8}predicted  missing", f"{'true':8}{int(m['tp']):9}  {int(m['fn']):7}", f"{'false':8}{int(m['fa'] + m['fd']):9}  {int(m['tn']):7}", ""]
    out += [f"{name:10}{bar(m[name])} {m[name]:.2%}" for name in METRICS] + [""]
    fields = [(k, v) for k, v in result.field_metrics.items() if not only or re.search(only, k)]
    fields.sort(key=(lambda x: x[0]) if sort_by == "name" else (lambda x: (-x[1][sort_by], x[0])))
    wide = max([len(k) for k, _ in fields], default=5)
    for k, v in fields:
        name = "  " * k.count(".") + k.rsplit(".", 1)[-1]
        out.append(f"{name:{wide + 4}} f1 {v['f1']:.3f}  p {v['precision']:.3f}  r {v['recall']:.3f}  tp {int(v['tp'])} fa {int(v['fa'])} fd {int(v['fd'])} fn {int(v['fn'])} tn {int(v['tn'])}")
    for r in result.non_matches:
        out.append(f"{r.get('type')}: {r.get('field_path')}: {r.get('gt')!r} / {r.get('pred')!r} {r.get('reason') or ''}".rstrip())
    return "\n".join(out)


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    """Command-line arguments of an evaluation run."""
    p = argparse.ArgumentParser(description="Evaluate structured predictions against ground truth.")
    p.add_argument("--input_csv", required=True, help="table with a truth and a prediction column of JSON texts")
    p.add_argument("--attributes_file", help="JSON configuration of the model")
    p.add_argument("--model_class", help="name of the model")
    p.add_argument("--truncate", type=int, help="evaluate this many rows only")
    p.add_argument("--true_column", default="expected")
    p.add_argument("--predicted_column", default="predicted")
    p.add_argument("--output_dir", default=".")
    p.add_argument("--verbose", action="store_true")
    return p.parse_args(given)
