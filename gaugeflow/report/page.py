"""A self-contained HTML report of a corpus result."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from html import escape

from .tables import COUNTS, METRICS, CorpusResult

STYLE = "body{font:15px system-ui;margin:2em auto;max-width:70em;color:#222}table{border-collapse:collapse;margin:1em 0}td,th{padding:.3em .7em;border-bottom:1px solid #ddd;text-align:right}td:first-child,th:first-child{text-align:left}.bar{display:inline-block;width:8em;height:.7em;background:#eee}.bar i{display:block;height:100%}.heat td{color:#fff}.heat td:first-child{color:#222}.pics img{max-width:14em;max-height:14em;margin:.4em;border:1px solid #ddd}"
#: One filter by text and one by document, over everything that belongs to a document.
SCRIPT = "const q=document.getElementById('q'),d=document.getElementById('d');function f(){document.querySelectorAll('[data-doc]').forEach(r=>{const t=r.dataset.t||'';r.hidden=(d&&d.value&&r.dataset.doc!==d.value)||(q&&q.value&&r.hasAttribute('data-t')&&!t.includes(q.value.toLowerCase()))})}[q,d].forEach(e=>e&&(e.oninput=f));"


@dataclass
class ReportConfig:
    title: str = "Evaluation report"
    sections: tuple[str, ...] = ("summary", "fields", "heat_map", "confusion", "errors", "documents", "gallery", "non_matches")
    most_non_matches: int = 1000
    #: Image address or path of each document, for the gallery.
    images: dict[str, str] = field(default_factory=dict)


def colour(value: float) -> str:
    """Green to red, by where a score stands."""
    for least, name in ((0.8, "#2e7d32"), (0.6, "#f9a825"), (0.4, "#ef6c00")):
        if value >= least:
            return name
    return "#c62828"


def _bar(value: float) -> str:
    return f'<span class="bar"><i style="width:{value:.0%};background:{colour(value)}"></i></span> {value:.1%}'


def _table(head, rows, name: str = "") -> str:
    body = "".join(f"<tr{extra}>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>" for extra, cells in rows)
    return f'<table id="{name}"><tr>' + "".join(f"<th>{escape(h)}</th>" for h in head) + f"</tr>{body}</table>"


def gauge(value: float, name: str) -> str:
    """A half circle that is filled as far as a score goes."""
    share = max(0.0, min(1.0, value))
    x, y = 60 - 50 * math.cos(math.pi * share), 60 - 50 * math.sin(math.pi * share)
    arc = lambda x, y, c: f'<path d="M10 60A50 50 0 0 1 {x:.1f} {y:.1f}" fill="none" stroke="{c}" stroke-width="12"/>'
    return f'<svg width="120" height="82" role="img" aria-label="{escape(name)} {share:.1%}">{arc(110, 60, "#eee")}{arc(x, y, colour(share)) if share else ""}<text x="60" y="58" text-anchor="middle">{share:.0%}</text><text x="60" y="78" text-anchor="middle" font-size="12">{escape(name)}</text></svg>'


def _summary(r: CorpusResult, c: ReportConfig) -> str:
    return f"<h2>Summary</h2><p>{r.document_count} documents, {sum(r.errors.values())} errors</p><p>" + "".join(gauge(r.metrics[m], m) for m in METRICS) + "</p>" + _table(["metric", "value"], [("", (m, _bar(r.metrics[m]))) for m in METRICS])


def _heat_map(r: CorpusResult, c: ReportConfig) -> str:
    if not r.field_metrics:
        return ""
    cell = lambda v: f'<td style="background:{colour(v)}">{v:.2f}</td>'
    rows = "".join(f"<tr><td>{escape(k)}</td>" + "".join(cell(v[m]) for m in METRICS) + "</tr>" for k, v in r.field_metrics.items())
    return '<h2>Scores by field</h2><table class="heat"><tr><th>field</th>' + "".join(f"<th>{m}</th>" for m in METRICS) + f"</tr>{rows}</table>"


def _documents(r: CorpusResult, c: ReportConfig) -> str:
    names = sorted({str(x.get("doc_id")) for x in r.non_matches[: c.most_non_matches]} | set(c.images))
    if not names:
        return ""
    return '<h2>Document</h2><select id="d"><option value="">all</option>' + "".join(f'<option value="{escape(n)}">{escape(n)}</option>' for n in names) + "</select>"


def _gallery(r: CorpusResult, c: ReportConfig) -> str:
    if not c.images:
        return ""
    return '<h2>Images</h2><div class="pics">' + "".join(f'<figure data-doc="{escape(k)}" style="display:inline-block"><img src="{escape(v)}" alt="{escape(k)}" loading="lazy"><figcaption>{escape(k)}</figcaption></figure>' for k, v in sorted(c.images.items())) + "</div>"


def _fields(r: CorpusResult, c: ReportConfig) -> str:
    return "<h2>Fields</h2>" + _table(["field", *METRICS, *COUNTS], [("", (escape(k), *(_bar(v[m]) for m in METRICS), *(int(v[x]) for x in COUNTS))) for k, v in r.field_metrics.items()])


def _confusion(r: CorpusResult, c: ReportConfig) -> str:
    return "<h2>Confusion matrix</h2>" + _table(["outcome", "n"], [("", (x, int(r.metrics[x]))) for x in COUNTS])


def _errors(r: CorpusResult, c: ReportConfig) -> str:
    return "<h2>Errors</h2>" + _table(["type", "n"], [("", (escape(k), v)) for k, v in r.errors.items()]) if r.errors else ""


def _non_matches(r: CorpusResult, c: ReportConfig) -> str:
    if not r.non_matches:
        return ""
    rows = []
    for x in r.non_matches[: c.most_non_matches]:
        cells = [escape(str(x.get(k) if x.get(k) is not None else "")) for k in ("doc_id", "field_path", "type", "gt", "pred", "reason")]
        rows.append((f' data-doc="{cells[0]}" data-t="{" ".join(cells).lower()}"', cells))
    return '<h2>Non-matches</h2><input id="q" placeholder="filter">' + _table(["document", "field", "type", "truth", "prediction", "reason"], rows, "nm")


PARTS = {"summary": _summary, "fields": _fields, "heat_map": _heat_map, "documents": _documents, "gallery": _gallery, "confusion": _confusion, "errors": _errors, "non_matches": _non_matches}


def render(result: CorpusResult, config: ReportConfig | None = None) -> str:
    config = config or ReportConfig()
    data = json.dumps({"metrics": result.metrics, "fields": result.field_metrics}, default=str).replace("</", "<\\/")
    body = "".join(PARTS[s](result, config) for s in config.sections)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(config.title)}</title><style>{STYLE}</style></head><body><h1>{escape(config.title)}</h1>{body}<script type="application/json" id="data">{data}</script><script>{SCRIPT}</script></body></html>'


def write(result: CorpusResult, path: str, config: ReportConfig | None = None) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(render(result, config))
