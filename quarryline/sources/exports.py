"""Texts from at most a dozen selected notes: instructions for assistants, a report, a page, JSON."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame

from ..operators.retrieval import export_selection

FORMATS = ("agents_md", "claude_md", "cursor_rules", "copilot_instructions", "report", "html", "json")
_TITLES = {"agents_md": "AGENTS", "claude_md": "CLAUDE", "copilot_instructions": "Copilot instructions"}


def _refs(note: dict) -> list[str]:
    return list(note["evidence_refs"] or [])[:3]


def _listed(notes: list[dict]) -> str:
    return "\n".join(f"- {n['text']}" + (f" ({', '.join(_refs(n))})" if _refs(n) else "") for n in notes)


def render(notes: list[dict], form: str, built: str) -> str:
    """One of FORMATS; text in pages is escaped."""
    if form == "json":
        return json.dumps({"summary": f"{len(notes)} note(s)", "notes": [{"text": n["text"], "refs": _refs(n), "confidence": n["confidence"]} for n in notes]})
    if form == "html":
        parts = "".join(f"<article><h2>{html.escape(n['confidence'])}</h2><p>{html.escape(n['text'])}</p><small>{html.escape(', '.join(_refs(n)))}</small></article>" for n in notes)
        return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Notes</title></head><body><p>{html.escape(built)}</p>{parts}</body></html>"
    if form == "report":
        return "\n\n".join([f"<!-- Generated by quarryline on {built} -->", *(f"## [{n['confidence']}]\n\n{n['text']}" + (f"\n\nEvidence: {', '.join(_refs(n))}" if _refs(n) else "") for n in notes)]) + "\n"
    if form == "cursor_rules":
        return f"---\ndescription: Notes of {built}\nglobs:\nalwaysApply: true\n---\n\n{_listed(notes)}\n"
    return f"<!-- Generated by quarryline on {built} -->\n\n# {_TITLES[form]}\n\n{_listed(notes)}\n"


def export(notes: DataFrame, forms: list[str], built: str) -> dict[str, str]:
    """Texts by format; unknown formats are left out. Only the selected notes, twelve at most, reach the driver."""
    rows = [r.asDict() for r in export_selection(notes).collect()]
    return {f: render(rows, f, built) for f in forms if f in FORMATS}
