"""Command line: data, tokenizer, epoch, doctor, compare, watch, preflight, env. Exit code 0 passed, 1 failed, 2 could not judge."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from pathlib import Path

from . import thresholds as T
from .report import console, envelope, html, sarif


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lossledger").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parse_map(items: list[str] | None) -> dict[str, str]:
    return {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in items or ()) if v}


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lossledger", description="Verdicts on training runs, at fleet scale.")
    p.add_argument("--version", version=envelope.VERSION, action="version")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str, **kw) -> argparse.ArgumentParser:
        c = sub.add_parser(name, **kw)
        if "json" in flags:
            c.add_argument("--json", action="store_true")
        if "sarif" in flags:
            c.add_argument("--sarif", metavar="PATH")
        if "log" in flags:
            c.add_argument("--format", choices="auto hf coqui jsonl csv tfevents".split(), default="auto")
            c.add_argument("--map", action="append", metavar="CANON=COLUMN")
        return c

    command("data", "json").add_argument("input")
    c = command("tokenizer", "json")
    c.add_argument("model")
    c.add_argument("transcripts")
    c = command("epoch", "json", "sarif", "log")
    c.add_argument("logfile")
    c.add_argument("--html", nargs="?", const="report.html", metavar="PATH")
    c = command("doctor", "json", "sarif", "log", aliases=["diagnose"])
    c.add_argument("path", nargs="?", default=".")
    c.add_argument("--baseline")
    c.add_argument("--newest", type=int)
    c = command("compare", "json", "sarif", "log")
    c.add_argument("baseline")
    c.add_argument("runs", nargs="+")
    c = command("watch", "log")
    c.add_argument("logfile")
    c.add_argument("--interval", type=float, default=T.WATCH_INTERVAL_SEC)
    c.add_argument("--until-fail", dest="until_fail", action="store_true")
    c.add_argument("--stall-timeout", type=float, default=T.STALL_SEC)
    c = command("preflight", "json", "sarif")
    c.add_argument("dataset")
    c.add_argument("--tokenizer")
    c.add_argument("--max-len", type=int)
    c.add_argument("--text-field")
    c = command("env", "json")
    for name in ("module", "python", "cwd", "checkpoint", "output-dir"):
        c.add_argument(f"--{name}")
    for name in ("required-gb", "checkpoint-gb"):
        c.add_argument(f"--{name}", type=float)
    c.add_argument("--keep", default=1, type=int)
    return p


class CannotJudge(Exception):
    """Nothing could be judged: exit 2, no verdict."""


def _epoch(a) -> list[dict]:
    from .api import judge_logs

    if not os.path.exists(a.logfile):
        raise CannotJudge(f"could not read log {a.logfile}")
    reports = envelope.to_dicts(judge_logs(_session(), a.logfile, a.format, parse_map(a.map)))
    if not reports or any(f["id"] == "TP-NO-RECORDS" for r in reports for f in r["findings"]):
        raise CannotJudge(f"no readable log records in {a.logfile}")
    return reports


def _doctor(a) -> list[dict]:
    from .api import doctor

    if not os.path.exists(a.path):
        raise CannotJudge(f"path not found: {a.path}")
    reports, files = doctor(_session(), a.path, a.baseline, parse_map(a.map), a.newest)
    out = envelope.to_dicts(reports, ("fmt", "num_records", "step_range", "mapping"))
    if not out:
        raise CannotJudge(f"no readable training logs found in {a.path}")
    left = [r["name"] for r in files.where("not judged").select("name").collect()]
    if left and not a.json:
        print(f"Note: {len(left)} log(s) were NOT judged: " + ", ".join(left) + "\n")
    return out


def _compare(a) -> tuple[list[dict], list[dict]]:
    from .api import compare_logs

    for path in (a.baseline, *a.runs):
        if not os.path.exists(path):
            raise CannotJudge(f"could not compare against {a.baseline}: no file {path}")
    reports, table = compare_logs(_session(), a.baseline, a.runs, a.format, parse_map(a.map))
    out = envelope.to_dicts(reports)
    names = console.labels([os.path.abspath(p) for p in (a.baseline, *a.runs)])
    rows = [r.asDict() for r in table.collect()]
    for r in rows:
        r["name"] = names.get(r["run_id"], r["run_id"]) + (" (BASE)" if r["verdict"] == "BASELINE" else "")
    return out, rows


def poll(path: str, fmt: str, overrides: dict[str, str], previous: str | None = None) -> tuple:
    """(verdict or None while warming up, whether it changed, records, findings)."""
    from .api import judge_logs

    rows = judge_logs(_session(), path, fmt, overrides).collect() if os.path.exists(path) else []
    if not rows or rows[0]["n_loss"] < T.WATCH_MIN_POINTS:
        return None, False, rows[0]["n_rec"] if rows else 0, []
    r = rows[0].asDict(recursive=True)
    return r["verdict"], r["verdict"] != previous, r["n_rec"], r["findings"]


def _watch(a) -> int:
    from .streaming.watch import StallClock, stall_finding

    last, clock = None, StallClock(a.stall_timeout)
    try:
        while True:
            size = os.path.getsize(a.logfile) if os.path.exists(a.logfile) else -1
            if clock.tick(size, time.monotonic()):
                console.print_verdict("WARN", [stall_finding(a.stall_timeout)])
            verdict, changed, n, findings = poll(a.logfile, a.format, parse_map(a.map), last)
            print(f"records={n} " + (f"verdict={verdict} findings={len(findings)}" if verdict else "warming up"))
            if changed:
                console.print_verdict(verdict, findings)
            last = verdict or last
            if a.until_fail and verdict == "FAIL":
                return 1
            time.sleep(a.interval)
    except KeyboardInterrupt:
        print(f"Stopped. Final verdict: {last}")
        return int(last == "FAIL")


def _single(a) -> list[dict]:
    if a.command == "data":
        from .operators.speech import check_data

        return [check_data(_session(), a.input)]
    if a.command == "tokenizer":
        from .operators.tokenizer import check_tokenizer

        r = check_tokenizer(_session(), a.model, a.transcripts)
        if r["verdict"] is None:
            raise CannotJudge(r["findings"][0]["message"] + " " + r["findings"][0]["evidence"])
        return [r]
    if a.command == "preflight":
        from .operators.preflight import preflight

        tok = None
        if a.tokenizer:
            try:
                from transformers import AutoTokenizer
            except ImportError:
                raise CannotJudge("transformers is required to load a tokenizer") from None
            tok = AutoTokenizer.from_pretrained(a.tokenizer)
        r = preflight(_session(), a.dataset, tok, a.max_len, a.text_field)
        return [{"verdict": r.verdict, "findings": r.findings}]
    from .operators.environment import check_env

    return [check_env(a.module, a.checkpoint, a.required_gb, a.output_dir, a.checkpoint_gb, a.keep, a.python, a.cwd)]


def run(argv: list[str] | None = None) -> int:
    a = build_parser().parse_args(argv)
    as_json = getattr(a, "json", False)
    try:
        table = None
        if a.command == "watch":
            return _watch(a)
        if a.command == "epoch":
            reports = _epoch(a)
        elif a.command in ("doctor", "diagnose"):
            reports = _doctor(a)
        elif a.command == "compare":
            reports, table = _compare(a)
        else:
            reports = [{**r, "findings": envelope.tag_source(r["findings"], "single_run")} for r in _single(a)]
    except Exception as e:  # whatever went wrong, no verdict was reached
        message = str(e) if isinstance(e, CannotJudge) else f"internal error: {e}"
        print(envelope.dumps([], message) if as_json else f"lossledger: {message}", file=sys.stdout if as_json else sys.stderr)
        return 2
    if getattr(a, "sarif", None):
        Path(a.sarif).write_text(json.dumps(sarif.to_sarif(reports), indent=2), encoding="utf-8")
    if as_json:
        print(envelope.dumps(reports))
    elif a.command in ("doctor", "diagnose"):
        if len(reports) > 1:
            print("\n".join(f"{r['verdict']:<11} | {r['file']}" for r in reports) + "\n")
        for r in reports:
            print(console.autopsy_text(r))
        print(console.FOOTER)
    else:
        if table is not None:
            print(console.compare_table(table))
        for r in reports if table is None or len(reports) == 1 else ():
            console.print_verdict(r["verdict"], r["findings"])
    if getattr(a, "html", None):
        Path(a.html).write_text(html.to_html(reports[0]), encoding="utf-8")
    return envelope.exit_code(reports)


def main() -> None:
    sys.exit(run())
