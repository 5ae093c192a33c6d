"""Reports as JSON-ready dictionaries and their envelope. Reports are few (a row for each run) and small."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame

from ..schema import SEVERITY, UNJUDGED_IDS

SCHEMA_VERSION = 3
VERSION = "0.1.0"


def to_dicts(reports: DataFrame, extra: tuple[str, ...] = ()) -> list[dict[str, Any]]:
    cols = [c for c in ("run_id", "verdict", "findings", "ran", "skipped", *extra) if c in reports.columns]
    out = []
    for row in reports.select(*cols).collect():
        r = row.asDict(recursive=True)
        d = {"verdict": r["verdict"], "findings": r["findings"], "file": r["run_id"]}
        if "ran" in r:
            d["checks"] = {"ran": r["ran"], "skipped": r["skipped"]}
        out.append(d | {k: r[k] for k in extra if k in r})
    return out


def normal(verdict: str | None) -> str:
    return verdict if verdict in SEVERITY else "NOT-CHECKED"


def worst(reports: list[dict]) -> str:
    return min((normal(r.get("verdict")) for r in reports), key=SEVERITY.get, default="PASS")


def exit_code(reports: list[dict]) -> int:
    """1 if a run failed, 2 if one could not be judged, else 0. No report at all could not be judged either."""
    verdicts = {normal(r.get("verdict")) for r in reports}
    ids = {f.get("id") for r in reports for f in r.get("findings", [])}
    if "FAIL" in verdicts:
        return 1
    return 2 if not reports or "NOT-CHECKED" in verdicts or ids & set(UNJUDGED_IDS) else 0


def envelope(reports: list[dict], error: str | None = None) -> dict:
    return {"schema_version": SCHEMA_VERSION, "tool_version": VERSION, "reports": reports, "worst_verdict": None if error else worst(reports), "error": error}


def dumps(reports: list[dict], error: str | None = None) -> str:
    return json.dumps(envelope(reports, error), indent=2, default=str)


def tag_source(findings: list[dict], source: str) -> list[dict]:
    return [{**f, "source": source} for f in findings]
