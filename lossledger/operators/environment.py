"""Can this machine start this run? Import probe, checkpoint archive, memory and disk.

These look at the machine that asks. Checkpoints are many in a fleet: inspect_checkpoints() reads them on the executors.
"""

from __future__ import annotations

import io
import os
import shutil
import subprocess
import sys
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import thresholds as T

GB = 1 << 30


def _f(id_: str, level: str, message: str, evidence: str = "") -> dict[str, str]:
    return {"id": f"TP-ENV-{id_}", "level": level, "message": message, "evidence": evidence}


def memory_gb():
    """(total, available); None where it can't be told, which isn't zero."""
    try:
        rows = dict(x.split(":", 1) for x in Path("/proc/meminfo").read_text().splitlines() if ":" in x)
        kb = lambda k: int(rows[k].split()[0]) / (1 << 20)
        return kb("MemTotal"), kb("MemAvailable" if "MemAvailable" in rows else "MemFree")
    except (OSError, KeyError, ValueError, IndexError):
        return None


def check_memory(required_gb: float | None = None, memory: tuple[float, float] | None = None) -> list[dict[str, str]]:
    memory = memory or memory_gb()
    if memory is None:
        return [_f("MEM-UNKNOWN", "NOT-CHECKED", "The memory of this machine can't be determined.", f"platform={sys.platform}")]
    total, free = memory
    if required_gb is None:
        return [_f("MEM-INFO", "INFO", "System memory measured.", f"{free:.1f} GB available of {total:.1f} GB; nothing is required of it")]
    told = f"available {free:.1f} GB, required {required_gb:.1f} GB"
    if free < required_gb:
        return [_f("MEM-INSUFFICIENT", "FAIL", "Less memory is available than the run needs.", told)]
    if free - required_gb < T.RAM_MARGIN_GB:
        return [_f("MEM-TIGHT", "WARN", "Memory headroom is thin.", f"{told}, margin below {T.RAM_MARGIN_GB} GB")]
    return [_f("MEM-OK", "PASS", "Memory headroom is sufficient.", told)]


_PROBE = """
import importlib, sys, traceback
try:
    importlib.import_module(sys.argv[1])
except BaseException as e:
    last = (traceback.extract_tb(e.__traceback__) or [None])[-1]
    print(type(e).__name__, str(e).replace("|", "/").replace("\\n", " "), last.filename if last else "", last.lineno if last else "", sep="|", file=sys.stderr)
    sys.exit(1)
"""


def check_import(module: str, timeout: float = T.IMPORT_TIMEOUT_SEC, python: str | None = None, cwd: str | None = None) -> list[dict[str, str]]:
    """Imports the module in another process, which may crash or hang without harm."""
    if cwd and not os.path.isdir(cwd):
        return [_f("CWD-MISSING", "NOT-CHECKED", "There is no such working directory to probe from.", cwd)]
    exe = python if python else sys.executable
    try:
        got = subprocess.run([exe, "-c", _PROBE, module], cwd=cwd, timeout=timeout, text=True, capture_output=True)
    except subprocess.TimeoutExpired:
        return [_f("IMPORT-TIMEOUT", "FAIL", f"Importing '{module}' did not finish.", f"nothing after {timeout:.0f}s")]
    except OSError as e:
        return [_f("PYTHON-UNUSABLE", "NOT-CHECKED", "The interpreter could not be run.", f"{exe}: {e}")]
    if got.returncode == 0:
        return [_f("IMPORT-OK", "PASS", f"'{module}' imports cleanly.", f"interpreter {exe}")]
    told = got.stderr.strip().splitlines()
    parts = told[-1].split("|", 3) if told else []
    if len(parts) < 4 or not parts[0]:
        return [_f("IMPORT-CRASH", "FAIL", f"Importing '{module}' crashed the interpreter.", f"exit code {got.returncode} and no exception: a native crash")]
    return [_f("IMPORT-FAIL", "FAIL", f"'{module}' can't be imported.", f"{parts[0]}: {parts[1]}" + (f" (at {parts[2]}:{parts[3]})" if parts[2] else ""))]


def inspect_archive(name: str, data: bytes | None, size: int | None = None) -> dict[str, str]:
    """A checkpoint from its bytes (None: no such file), by the archive's directory and checksums; nothing is unpickled."""
    if data is None:
        return _f("CKPT-MISSING", "FAIL", "Checkpoint does not exist.", name)
    about = f"{name} ({len(data) / GB:.2f} GB)"
    if not data:
        return _f("CKPT-EMPTY", "FAIL", "Checkpoint is a zero-byte file.", name)
    if not zipfile.is_zipfile(io.BytesIO(data)):
        if data.startswith(b"PK\x03\x04"):
            return _f("CKPT-TRUNCATED", "FAIL", "The save of this checkpoint never finished.", f"{about}: an archive's start without its directory")
        if data[:1] == b"\x80":
            return _f("CKPT-LEGACY", "NOT-CHECKED", "Checkpoint is a bare pickle, which only loading could judge.", about)
        return _f("CKPT-UNREADABLE", "FAIL", "Checkpoint is neither an archive nor a pickle.", f"{about}, starts with {data[:4]!r}")
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            bad, names = z.testzip(), z.namelist()
    except zipfile.BadZipFile as e:
        return _f("CKPT-TRUNCATED", "FAIL", "The save of this checkpoint never finished.", f"{about}: {e}")
    if bad is not None:
        return _f("CKPT-CORRUPT", "FAIL", "Checkpoint archive fails its own checksums.", f"first bad entry: {bad}")
    if "data.pkl" not in {os.path.basename(n) for n in names}:
        return _f("CKPT-UNREADABLE", "FAIL", "Archive without a data.pkl: no checkpoint.", f"{name}: {len(names)} entries")
    return _f("CKPT-OK", "PASS", "Checkpoint is a complete archive.", f"{about}, {sum('/data/' in n for n in names)} tensor storages, checksums intact")


def check_checkpoint(path: str | Path) -> list[dict[str, str]]:
    p = Path(path)
    return [inspect_archive(str(p), p.read_bytes() if p.exists() else None)]


def inspect_checkpoints(files: DataFrame) -> DataFrame:
    """files as of the binaryFile format -> path, id, level, message, evidence; one file in memory at a time on each executor core.

    A scan doesn't deliver zero-byte files: check_checkpoint() finds those.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame([{"path": path, **inspect_archive(path, data)}])

    return files.select("path", F.col("content")).mapInPandas(run, "path string, id string, level string, message string, evidence string")


def check_disk(where: str | Path, checkpoint_gb: float | None = None, keep: int = 1) -> list[dict[str, str]]:
    p = Path(where)
    at = p if p.exists() else p.parent
    if not at.exists():
        return [_f("DISK-UNKNOWN", "NOT-CHECKED", "Neither the output directory nor its parent exists.", str(p))]
    free = shutil.disk_usage(at).free / GB
    if checkpoint_gb is None:
        return [_f("DISK-INFO", "INFO", "Free disk space measured.", f"{free:.1f} GB free at {at}; nothing is required of it")]
    need = checkpoint_gb * max(keep, 1)
    told = f"{free:.1f} GB free, {need:.1f} GB needed"
    return [_f("DISK-INSUFFICIENT", "FAIL", "The checkpoints of this run don't fit on the disk.", told)] if free < need else [_f("DISK-OK", "PASS", "Disk space is sufficient.", told)]


def roll_up(findings: list[dict[str, str]]) -> str:
    levels = {f["level"] for f in findings}
    return "FAIL" if "FAIL" in levels else "WARN" if "WARN" in levels else "NOT-CHECKED" if levels <= {"NOT-CHECKED", "INFO"} else "PASS"


def check_env(module=None, checkpoint=None, required_gb=None, output_dir=None, checkpoint_gb=None, keep=1, python=None, cwd=None) -> dict:
    """One report of all checks that were asked for."""
    parts = {
        "import": (module, lambda: check_import(module, python=python, cwd=cwd), "no --module given"),
        "checkpoint": (checkpoint, lambda: check_checkpoint(checkpoint), "no --checkpoint given"),
        "memory": (True, lambda: check_memory(required_gb), ""),
        "disk": (output_dir, lambda: check_disk(output_dir, checkpoint_gb, keep), "no --output-dir given"),
    }
    findings = [f for asked, run, _ in parts.values() if asked for f in run()]
    return {"findings": findings, "verdict": roll_up(findings), "checks": {"ran": sorted(k for k, p in parts.items() if p[0]), "skipped": {k: p[2] for k, p in parts.items() if not p[0]}}}
