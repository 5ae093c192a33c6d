"""What a user calls: one Spark job judges any number of logs."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import thresholds as T
from .operators import compare as C
from .operators import objective
from .operators.rollup import severity
from .operators.single_run import check_records, check_runs
from .report.envelope import to_dicts
from .schema import METRICS, RECORDS_DDL
from .sources.logs import discover, read_logs, used_mapping


def judge_logs(spark: SparkSession, paths: str | list[str], fmt: str = "auto", overrides: dict[str, str] | None = None) -> DataFrame:
    """A report for each log under the paths; logs without records get TP-NO-RECORDS."""
    records, files = read_logs(spark, paths, fmt, overrides)
    return check_runs(records, files.select("run_id"))


def doctor(spark: SparkSession, directory: str, baseline: str | None = None, overrides: dict[str, str] | None = None, newest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports, files): every log of a directory, worst first, merged with a comparison if a baseline is given.

    Reports also have fmt, num_records, step_range and the column mapping. files tells which logs were not judged.
    """
    records, files = discover(spark, directory, overrides, newest, T.DISCOVERY_MIN_RECORDS)
    reports = check_records(records)
    if baseline:
        base = C.metrics(judge_logs(spark, baseline, overrides=overrides))
        reports = C.merge_into(reports, C.compare(C.metrics(reports), base))
    step = F.coalesce("step", F.col("rec_idx").cast("double"))
    span = records.groupBy("run_id").agg(F.concat(F.min_by(step, "rec_idx").cast("string"), F.lit(".."), F.max_by(step, "rec_idx").cast("string")).alias("step_range"))
    info = files.select("run_id", "fmt", "num_records", "mtime").join(span, "run_id").join(used_mapping(records), "run_id", "left")
    return reports.join(info, "run_id").orderBy(severity(F.col("verdict")), F.desc("mtime"), "run_id"), files


def compare_logs(spark: SparkSession, baseline: str, runs: list[str], fmt: str = "auto", overrides: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports, table) of runs against one baseline log; all logs are read and judged once."""
    reports = judge_logs(spark, [baseline, *runs], fmt, overrides)
    m = C.metrics(reports).withColumn("n", F.lit(1))
    import os

    base_id = os.path.abspath(baseline)
    base = m.where(F.col("run_id") == base_id).drop("n")
    wanted = [os.path.abspath(r) for r in runs]
    compared = C.compare(m.where(F.col("run_id").isin(*wanted)).drop("n"), base)
    return compared, C.ranking(compared, base)


def merge_telemetry(records: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Records with the columns of telemetry (run_id, step, ..) of their run and step; what telemetry doesn't have stays. One row for each run and step there."""
    extra = [c for c in telemetry.columns if c not in ("run_id", "step")]
    t = telemetry.select(F.col("run_id").alias("t_run"), F.col("step").cast("double").alias("t_step"), *[F.col(c).alias(f"t_{c}") for c in extra])
    both = records.join(t, (records["run_id"] == t["t_run"]) & (F.coalesce(records["step"], F.lit(-1.0)) == t["t_step"]), "left")
    kept = [F.coalesce(f"t_{c}", c).alias(c) if c in extra else F.col(c) for c in records.columns]
    return both.select(*kept, *[F.col(f"t_{c}").alias(c) for c in extra if c not in records.columns])


def records_of(spark: SparkSession, history: Iterable[dict[str, Any]], run_id: str = "live", telemetry: dict[int, dict[str, float]] | None = None) -> DataFrame:
    """Records of a trainer's in-memory log history: entries with a loss or an eval loss, telemetry merged by step."""
    keys = {"loss": "loss", "eval_loss": "eval_loss", "grad_norm": "grad_norm", "step": "step", "learning_rate": "lr"}
    rows = []
    for entry in history:
        if "train_runtime" in entry:
            continue
        r = {}
        for k, canon in keys.items():
            try:
                r[canon] = float(entry[k])
            except (KeyError, TypeError, ValueError):
                continue
        if "loss" in r or "eval_loss" in r:
            r |= (telemetry or {}).get(int(r.get("step", -1)), {})
            rows.append((run_id, len(rows), *(r.get(m) for m in METRICS)))
    return spark.createDataFrame(rows, RECORDS_DDL)


class LiveJudge:
    """For a trainer's callback: call begin() before training and on_log() at every log event; it judges every `check_every` steps once there are enough records."""

    def __init__(self, spark: SparkSession, check_every: int = T.CALLBACK_CHECK_EVERY, min_points: int = T.CALLBACK_MIN_POINTS, stop_on_fail: bool = False) -> None:
        self.spark, self.check_every, self.min_points, self.stop_on_fail = spark, check_every, min_points, stop_on_fail
        self.telemetry: dict[int, dict[str, float]] = {}
        self.report: dict | None = None
        self.announced = self.should_stop = False
        self._checked: int | None = None
        self._last: tuple[int, float] | None = None

    def begin(self, model: Any, batches: Iterable[Any] | None = None, num_classes: int | None = None, ignore_index: int | None = None) -> list[dict[str, str]]:
        """Findings on the objective before the first step: the width of the output layer against the ignored index and the labels of the first batches.

        A failure sets announced, and should_stop where failures stop. What can't be told is in `skipped`, with the reason. Give a fresh iterable: batches
        are taken from it.
        """
        n, ignored = objective.infer_objective(model)
        n, ignored = n if num_classes is None else num_classes, ignored if ignore_index is None else ignore_index
        self.skipped: list[str] = []
        if not n:
            self.skipped.append("objective: the width of the output layer is not known")
            return []
        found = objective.check_ignore_index(n, ignored)
        if batches is not None:
            seen = objective.TargetCoverage(n, ignored)
            try:
                for batch in islice(batches, T.CALLBACK_TARGET_BATCHES):
                    targets = objective.labels_of(batch)
                    if targets is not None:
                        seen.observe(targets)
            except Exception as e:  # a loader of any kind: what it raises says why nothing is known
                self.skipped.append(f"objective coverage: the batches can't be read ({type(e).__name__}: {e})")
            else:
                found += seen.result() if seen.n_targets else []
        if any(f["level"] == "FAIL" for f in found):
            self.announced, self.should_stop = True, self.stop_on_fail
        return found

    def on_log(self, history: list[dict], step: int, now: float | None = None) -> dict | None:
        """The report, if this call judged."""
        if now is not None:
            if self._last and step > self._last[0]:
                self.telemetry[step] = {"step_time": (now - self._last[1]) / (step - self._last[0])}
            self._last = (step, now)
        if self._checked is not None and step - self._checked < self.check_every:
            return None
        records = records_of(self.spark, history, telemetry=self.telemetry)
        if records.count() < self.min_points:
            return None
        self._checked = step
        self.report = to_dicts(check_records(records))[0]
        if self.report["verdict"] == "FAIL":
            self.announced, self.should_stop = True, self.stop_on_fail
        return self.report
