"""Results as text: pretty, plain, json, jsonl, paths, csv."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame

FORMATS = ("pretty", "plain", "json", "jsonl", "paths", "csv")


def _unmarked(snippet: str | None, bold: tuple[str, str]) -> str:
    out = (snippet or "").replace("<b>", bold[0]).replace("</b>", bold[1])
    for entity, plain in (("&quot;", '"'), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = out.replace(entity, plain)
    return out


def render(page: DataFrame, form: str = "pretty", context: bool = True, scores: bool = True) -> str:
    """A page of hits (bounded by its limit) as one text."""
    rows = [r.asDict() for r in page.collect()]
    for r in rows:
        if not context:
            r.pop("snippet", None)
        if not scores:
            for k in [k for k in r if k.startswith("score")]:
                del r[k]
    if form == "paths":
        return "\n".join(r["path"] for r in rows)
    if form == "json":
        return json.dumps(rows, ensure_ascii=False)
    if form == "jsonl":
        return "\n".join(json.dumps(r, ensure_ascii=False) for r in rows)
    if form == "csv":
        out = io.StringIO()
        w = csv.DictWriter(out, list(rows[0]) if rows else ["path"], lineterminator="\n")
        w.writeheader()
        w.writerows(rows)
        return out.getvalue()
    if form not in ("pretty", "plain"):
        raise ValueError(f"unknown format: {form}")
    bold = ("\x1b[1m", "\x1b[0m") if form == "pretty" else ("", "")
    lines = []
    for r in rows:
        score = f" [{r['score']:.3f}]" if "score" in r else ""
        lines.append(f"{r['rank']}.{score} {r['path']}")
        if r.get("snippet"):
            lines.append("   " + _unmarked(r["snippet"], bold).replace("\n", " "))
    return "\n".join(lines)
