"""Plain ASCII output."""

from __future__ import annotations

import os

_HEAD = {"PASS": "All checks passed.", "WARN": "Some checks gave warnings:", "NOT-CHECKED": "No check could be run:", "FAIL": "Checks failed:"}


def _lines(findings: list[dict], indent: str = "  ") -> list[str]:
    out = []
    for f in findings:
        out.append(f"{indent}[{f.get('level', 'INFO')}] " + (f"{f['id']}: " if f.get("id") else "") + f.get("message", ""))
        if f.get("evidence"):
            out.append(f"{indent}    Evidence: {f['evidence']}")
    return out


def verdict_text(verdict: str, findings: list[dict]) -> str:
    return "\n".join(["-" * 40, f"[{verdict}] {_HEAD.get(verdict, '')}".rstrip(), *_lines(findings), "-" * 40]).encode("ascii", "replace").decode()


def print_verdict(verdict: str, findings: list[dict]) -> None:
    print(verdict_text(verdict, findings))


def autopsy_text(r: dict) -> str:
    """A run in full, with its findings against a baseline apart."""
    single, against = ([f for f in r["findings"] if (f.get("source") == "compare") == c] for c in (False, True))
    n = {k: sum(f.get("level") == k for f in single) for k in "PASS WARN FAIL NOT-CHECKED".split()}
    lines = [f"FILE   : {r['file']}", f"FORMAT : {r.get('fmt')}", f"RECORDS: {r.get('num_records')} (steps {r.get('step_range')})", f"VERDICT: {r['verdict']}", *_lines(single, ""), "Findings: " + ", ".join(f"{v} {k}" for k, v in n.items())]
    if r.get("mapping") and r.get("fmt") in ("csv", "jsonl"):
        lines.append("COLUMNS: " + ", ".join(f"{k}<-'{v}'" for k, v in r["mapping"].items()))
    if against:
        lines += ["--- VS BASELINE ---", *_lines(against, "")]
    return "\n".join(lines).encode("ascii", "replace").decode() + "\n"


FOOTER = "A pass means that none of these mechanical failures shows in the log. It doesn't mean that the model learns the right thing: compare with a good baseline for that.\n"


def compare_table(rows: list[dict]) -> str:
    if not rows:
        return ""
    width = max(3, *(len(r["name"]) for r in rows))
    num = lambda x, form: "N/A" if x is None else format(x, form)
    out = [f"{'RUN':<{width}} | {'START':>8} | {'FLOOR':>8} | {'END':>8} | {'IMP %':>7} | VERDICT vs BASE"]
    out.append("-" * len(out[0]))
    for r in rows:
        imp = None if r["improvement"] is None else r["improvement"] * 100
        out.append(f"{r['name']:<{width}} | {num(r['start_med'], '.3f'):>8} | {num(r['floor'], '.3f'):>8} | {num(r['end_med'], '.3f'):>8} | {num(imp, '.1f'):>7} | {r['verdict']}")
    return "\n".join(out)


def labels(paths: list[str]) -> dict[str, str]:
    """Each path's shortest suffix at the depth that tells all paths apart."""
    parts = {p: os.path.abspath(p).split(os.sep) for p in paths}
    distinct = len({tuple(x) for x in parts.values()})
    for depth in range(1, max(map(len, parts.values())) + 1):
        out = {p: "/".join(x[-depth:]) for p, x in parts.items()}
        if len(set(out.values())) == distinct:
            break
    return out
