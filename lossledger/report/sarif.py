"""SARIF 2.1.0: findings as code-scanning results, each anchored to line 1 of its log."""

from __future__ import annotations

from .envelope import VERSION

_LEVEL = dict.fromkeys(("WARN", "NOT-CHECKED"), "warning") | {"FAIL": "error"}


def to_sarif(reports: list[dict]) -> dict:
    rules: dict[str, dict] = {}
    results = []
    for report in reports:
        uri = str(next((report[k] for k in ("file", "path") if report.get(k)), "training-run")).replace("\\", "/")
        for f in report.get("findings", []):
            if not f.get("id"):
                continue
            level = _LEVEL.get(f.get("level"), "note")
            rules.setdefault(f["id"], {"id": f["id"], "shortDescription": {"text": f.get("message") or f["id"]}, "defaultConfiguration": {"level": level}})
            text = f.get("message", "") + (f" Evidence: {f['evidence']}" if f.get("evidence") else "") + (" (vs. baseline)" if f.get("source") == "compare" else "")
            place = {"artifactLocation": {"uri": uri}, "region": {"startLine": 1}}
            results.append({"ruleId": f["id"], "ruleIndex": list(rules).index(f["id"]), "level": level, "locations": [{"physicalLocation": place}], "message": {"text": text}})
    driver = {"name": "lossledger", "version": VERSION, "rules": list(rules.values())}
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"results": results, "tool": {"driver": driver}}], "version": "2.1.0"}
