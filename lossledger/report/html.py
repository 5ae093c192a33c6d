"""A self-contained page of one report."""

from __future__ import annotations

from html import escape

_COLOURS = {"FAIL": "#b3261e", "WARN": "#8a6100", "NOT-CHECKED": "#1f5fa8", "PASS": "#1a7f37"}


def to_html(report: dict) -> str:
    verdict = str(report.get("verdict", "UNKNOWN"))
    items = "".join(
        f"<li><strong style='color:{_COLOURS.get(f.get('level'), '#444')}'>[{escape(str(f.get('level', 'INFO')))}] {escape(str(f.get('id', '')))}</strong> {escape(str(f.get('message', '')))}"
        + (f"<br><small>Evidence: {escape(str(f['evidence']))}</small>" if f.get("evidence") else "")
        + "</li>"
        for f in report.get("findings", [])
    )
    title = escape(str(report.get("file") or "Report"))
    return f"<!doctype html><meta charset='utf-8'><title>{title}</title><body style='font:16px sans-serif;max-width:60em;margin:2em auto'><h1>{title}</h1><p style='font-size:2em;color:{_COLOURS.get(verdict, '#444')}'>{escape(verdict)}</p><ul>{items}</ul>"
