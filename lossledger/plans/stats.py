"""Ordered statistics: any number of runs in one pass, a row for each run.

One exchange on run_id and one sort by rec_idx serve all positions (running counts of the finite values); everything else is one aggregation
with filters. The expressions of STATS are also valid in other SQL engines, where the oracle queries use them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import thresholds as T
from ..functions.columns import finite


def _median(x: str, where: str = "") -> str:
    """The upper median: element n // 2 of the ascending values."""
    return f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x} DESC)" + (f" FILTER (WHERE {where})" if where else "")


#: Over the columns of positions(): f, e, g, st, lf, gu are finite losses, evals, gradient norms, step times, loader shares and utilisations;
#: rf, re, rs their ranks by record and nf, ne, ns their numbers.
STATS: dict[str, str] = {
    "n_rec": "count(*)",
    "n_loss": "count(loss)",
    "n_bad": "count_if(loss IS NOT NULL AND f IS NULL)",
    "n_f": "count(f)",
    "f_zero": "bool_and(f = 0)",
    "f_mean": "avg(f)",
    "f_sd": "stddev_pop(f)",
    "floor": "min(f)",
    "floor_nz": "min(f) FILTER (WHERE f <> 0)",
    "first_nz": "min_by(f, rec_idx) FILTER (WHERE f <> 0)",
    "last_f": "max_by(f, rec_idx) FILTER (WHERE f IS NOT NULL)",
    "start_med": _median("f", f"rf <= {T.IMPROVEMENT_WINDOW}"),
    "end_med": _median("f", f"rf > nf - {T.IMPROVEMENT_WINDOW}"),
    "n_g": "count(g)",
    "g_zero": "bool_and(g = 0)",
    "g_med": _median("g"),
    "g_max": "max(g)",
    "n_lr": "count(lr)",
    "n_lr0": "count_if(lr <= 0 AND NOT isnan(lr))",
    "n_t": "count(time)",
    "t0": "min_by(time, rec_idx) FILTER (WHERE time IS NOT NULL)",
    "t1": "max_by(time, rec_idx) FILTER (WHERE time IS NOT NULL)",
    "s0": "min_by(step, rec_idx) FILTER (WHERE time IS NOT NULL)",
    "s1": "max_by(step, rec_idx) FILTER (WHERE time IS NOT NULL)",
    "n_e": "count(e)",
    "e_min": "min(e)",
    "e_at": "min(re) FILTER (WHERE e = e_low)",
    "e_step": "max(e_low_step)",
    "e_med3": _median("e", f"re > ne - {T.OVERFIT_LAST}"),
    "loss_at": "min_by(loss, rec_idx) FILTER (WHERE loss IS NOT NULL AND step >= e_low_step)",
    "last_loss": "max_by(loss, rec_idx) FILTER (WHERE loss IS NOT NULL)",
    "n_st": "count(st)",
    "st_early": _median("st", "rs <= greatest(1, floor(ns / 2))"),
    "st_late": _median("st", f"rs > ns - greatest(1, floor(ns * {T.STEP_TAIL_SHARE}))"),
    "n_lf": "count(lf)",
    "lf_med": _median("lf"),
    "n_gu": "count(gu)",
    "gu_med": _median("gu"),
}


def series(records: DataFrame) -> DataFrame:
    """The finite values of each series; a missing step is the record's index."""
    share = F.when((F.col("step_time") > 0) & ~F.isnan("step_time") & F.col("loader_time").isNotNull(), F.col("loader_time") / F.col("step_time"))
    return records.select(
        "run_id", "rec_idx", F.coalesce("step", F.col("rec_idx").cast("double")).alias("step"), "loss", "lr", "time",
        finite(F.col("loss")).alias("f"), finite(F.col("eval_loss")).alias("e"), finite(F.col("grad_norm")).alias("g"),
        finite(F.col("step_time")).alias("st"), finite(share).alias("lf"), finite(F.col("gpu_util")).alias("gu"),
    )


def positions(s: DataFrame) -> DataFrame:
    """Ranks of losses, evals and step times within their run, and the record of the least eval."""
    run = Window.partitionBy("run_id")
    upto = run.orderBy("rec_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = s.select(
        "*",
        *[F.count(c).over(upto).alias("r" + c[0]) for c in ("f", "e", "st")],
        *[F.count(c).over(run).alias("n" + c[0]) for c in ("f", "e", "st")],
        F.min("e").over(run).alias("e_low"),
    )
    at = F.min(F.when(F.col("e") == F.col("e_low"), F.col("rec_idx"))).over(run)
    return ranked.withColumn("e_low_rec", at).withColumn("e_low_step", F.max(F.when(F.col("rec_idx") == F.col("e_low_rec"), F.col("step"))).over(run)).drop("e_low_rec")


def run_stats(records: DataFrame) -> DataFrame:
    """records (run_id, rec_idx and any canonical columns) -> one row for each run."""
    have = set(records.columns)
    full = records.select("run_id", "rec_idx", *[(F.col(m).cast("double") if m in have else F.lit(None).cast("double")).alias(m) for m in ("step", "loss", "eval_loss", "lr", "grad_norm", "time", "step_time", "loader_time", "gpu_util")])
    p = positions(series(full))
    bad = F.slice(F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull() & F.col("f").isNull() & (F.col("bad_rank") <= T.EVIDENCE_STEPS), F.struct("rec_idx", "step")))), 1, T.EVIDENCE_STEPS)
    upto = Window.partitionBy("run_id").orderBy("rec_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = p.withColumn("bad_rank", F.count(F.when(F.col("loss").isNotNull() & F.col("f").isNull(), 1)).over(upto))
    return p.groupBy("run_id").agg(*[F.expr(x).alias(k) for k, x in STATS.items()], F.transform(bad, lambda x: x["step"]).alias("bad_steps"))
