"""Comparison of runs with a baseline: one join of two rows of statistics, then a ladder of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import thresholds as T

#: Metrics of a run, null unless it has enough finite losses.
METRICS: dict[str, str] = {
    "enough": f"n_f >= {T.COMPARE_MIN_POINTS}",
    "degenerate": f"CASE WHEN n_f >= {T.COMPARE_MIN_POINTS} THEN CASE WHEN f_zero THEN 'every logged loss is exactly 0.0' WHEN start_med <= 0 THEN 'starting loss is not positive - relative improvement is undefined' END END",
    "improvement": f"CASE WHEN n_f >= {T.COMPARE_MIN_POINTS} AND NOT f_zero AND start_med > 0 THEN 1.0 - end_med / start_med END",
    "gn_median": f"CASE WHEN n_g >= {T.GRAD_MIN_POINTS} THEN g_med END",
}


def metrics(reports: DataFrame) -> DataFrame:
    """run_id, verdict, floor, start_med, end_med and METRICS of judged runs."""
    return reports.select("run_id", "verdict", "floor", "start_med", "end_med", *[F.expr(x).alias(k) for k, x in METRICS.items()])


#: Conditions over r_* (run) and b_* (baseline), as SQL that other engines accept, too.
UNJUDGED = "(r_verdict = 'NOT-CHECKED' OR b_verdict = 'NOT-CHECKED')"
SHORT = f"(NOT {UNJUDGED} AND NOT (r_enough AND b_enough))"
DEGENERATE = f"(NOT {UNJUDGED} AND r_enough AND b_enough AND (r_degenerate IS NOT NULL OR b_degenerate IS NOT NULL))"
COMPARABLE = f"(NOT {UNJUDGED} AND r_enough AND b_enough AND r_degenerate IS NULL AND b_degenerate IS NULL)"
CONDITIONS: dict[str, str] = {
    "TP-BAD-BASELINE": f"b_verdict = 'FAIL' AND NOT {SHORT}",
    "TP-FLOOR-RATIO": f"{COMPARABLE} AND r_floor > b_floor * {T.FLOOR_RATIO}",
    "TP-END-RATIO": f"{COMPARABLE} AND b_end_med > 0 AND r_end_med > b_end_med * {T.END_RATIO}",
    "TP-NEG-IMPROVE": f"{COMPARABLE} AND r_improvement < 0",
    "TP-IMPROVE-DEFICIT": f"{COMPARABLE} AND r_improvement >= 0 AND b_improvement > 0 AND r_improvement < b_improvement * {T.IMPROVEMENT_FRACTION}",
    "TP-GRADNORM-RATIO": f"{COMPARABLE} AND b_gn_median > 0 AND r_gn_median > b_gn_median * {T.GRADNORM_RATIO}",
}
_FAILS = ("TP-FLOOR-RATIO", "TP-END-RATIO", "TP-NEG-IMPROVE", "TP-IMPROVE-DEFICIT")
FAILED = "(" + " OR ".join(f"coalesce({CONDITIONS[k]}, false)" for k in _FAILS) + ")"
WARNED = "(" + " OR ".join(f"coalesce({CONDITIONS[k]}, false)" for k in ("TP-BAD-BASELINE", "TP-GRADNORM-RATIO")) + ")"
#: A baseline floor of zero has no ratio: the comparison is an error, not a verdict.
ERROR = f"CASE WHEN {COMPARABLE} AND b_floor = 0 AND NOT (r_floor IS NULL) THEN 'zero baseline floor' END"
VERDICT = f"CASE WHEN NOT {COMPARABLE} OR {FAILED} THEN 'FAIL' WHEN {WARNED} THEN 'WARN' ELSE 'PASS' END"


def join_baseline(runs: DataFrame, baselines: DataFrame) -> DataFrame:
    """runs and baselines as of metrics(). With a column baseline_id in runs an equi-join on it; else every run with the one baseline row (none: no pairs)."""
    r = runs.select(*[F.col(c).alias(f"r_{c}") for c in runs.columns])
    b = baselines.select(*[F.col(c).alias(f"b_{c}") for c in baselines.columns])
    if "baseline_id" in runs.columns:
        return r.join(b, r["r_baseline_id"] == b["b_run_id"])
    if len(baselines.head(2)) > 1:
        raise ValueError("more than one baseline: give runs a column baseline_id")
    return r.crossJoin(F.broadcast(b))


def compare(runs: DataFrame, baselines: DataFrame) -> DataFrame:
    """Reports of the pairs: run_id, baseline_id, verdict, error, findings, and the metrics of both sides."""
    f = lambda id_, level, message, evidence: f"struct('{id_}' as id, '{level}' as level, {message} as message, {evidence} as evidence, 'compare' as source)"
    when = lambda c, x: f"CASE WHEN {c} THEN {x} END"
    ratio = lambda a, b: f"{a} / nullif({b}, 0)"
    found = [when(CONDITIONS["TP-BAD-BASELINE"], f("TP-BAD-BASELINE", "WARN", "'the baseline itself fails single-run checks, so the comparison may mean nothing'", "cast(b_run_id as string)"))]
    for side, name in (("r", "run"), ("b", "baseline")):
        found.append(when(f"{side}_verdict = 'NOT-CHECKED'", f("TP-CMP-UNCOMPARABLE", "FAIL", f"'Cannot compare: the {name} has no usable loss scale.'", f"concat('{name} ', {side}_run_id, ' is NOT-CHECKED (0 groups executed).')")))
    found.append(when(SHORT, f("TP-NO-LOSS", "FAIL", f"concat(if(r_enough, 'Baseline', 'Run'), ' log has fewer than {T.COMPARE_MIN_POINTS} valid loss points.')", "cast(if(r_enough, b_run_id, r_run_id) as string)")))
    for side, name in (("r", "run"), ("b", "baseline")):
        found.append(when(f"{DEGENERATE} AND {side}_degenerate IS NOT NULL", f("TP-CMP-UNCOMPARABLE", "FAIL", f"'Cannot compare: the {name} has no usable loss scale.'", f"format_string('{name} %s: %s (floor %.3f)', {side}_run_id, {side}_degenerate, {side}_floor)")))
    found += [
        when(CONDITIONS["TP-FLOOR-RATIO"], f("TP-FLOOR-RATIO", "FAIL", "'loss floor ratio exceeded limit'", f"format_string('Run floor %.3f vs Baseline floor %.3f (ratio %.1fx > {T.FLOOR_RATIO})', r_floor, b_floor, {ratio('r_floor', 'b_floor')})")),
        when(CONDITIONS["TP-END-RATIO"], f("TP-END-RATIO", "FAIL", "'end loss ratio exceeded limit'", f"format_string('Run end %.3f vs Baseline end %.3f (ratio %.1fx > {T.END_RATIO})', r_end_med, b_end_med, {ratio('r_end_med', 'b_end_med')})")),
        when(CONDITIONS["TP-NEG-IMPROVE"], f("TP-NEG-IMPROVE", "FAIL", "'negative improvement'", "format_string('Run improvement is %.1f%% vs Baseline %.1f%%', r_improvement * 100, b_improvement * 100)")),
        when(CONDITIONS["TP-IMPROVE-DEFICIT"], f("TP-IMPROVE-DEFICIT", "FAIL", "'improvement deficit'", f"format_string('Run improvement %.1f%% vs Baseline %.1f%% (ratio %.2fx < {T.IMPROVEMENT_FRACTION})', r_improvement * 100, b_improvement * 100, {ratio('r_improvement', 'b_improvement')})")),
        when(CONDITIONS["TP-GRADNORM-RATIO"], f("TP-GRADNORM-RATIO", "WARN", "'gradient norm median is far above that of the baseline'", f"format_string('Run gn median %.2f vs Baseline gn median %.2f (ratio %.1fx > {T.GRADNORM_RATIO})', r_gn_median, b_gn_median, {ratio('r_gn_median', 'b_gn_median')})")),
        when("verdict = 'PASS' AND error IS NULL", f("TP-CMP-PASS", "PASS", "'Run compares favorably to baseline.'", f"format_string('Floor ratio %.2fx, Improvement %.1f%% vs %.1f%%', {ratio('r_floor', 'b_floor')}, r_improvement * 100, b_improvement * 100)")),
        when("error IS NOT NULL", f("TP-CMP-ERROR", "WARN", "'The comparison with the baseline could not be run: the run is judged on its own.'", "concat(b_run_id, ': ', error)")),
    ]
    pairs = join_baseline(runs, baselines).withColumn("error", F.expr(ERROR)).withColumn("verdict", F.expr(f"CASE WHEN error IS NOT NULL THEN 'WARN' ELSE {VERDICT} END"))
    out = pairs.withColumn("findings", F.expr(f"filter(array({', '.join(found)}), x -> x is not null)"))
    return out.select(F.col("r_run_id").alias("run_id"), F.col("b_run_id").alias("baseline_id"), "verdict", "error", "findings", *[c for c in pairs.columns if c.startswith(("r_", "b_"))])


def ranking(compared: DataFrame, baselines: DataFrame) -> DataFrame:
    """The table of an n-way comparison: name, start, floor, end, improvement, verdict; the baseline first, runs with too few losses left out."""
    base = baselines.where("enough").select("run_id", "start_med", "floor", "end_med", "improvement", F.lit("BASELINE").alias("verdict"))
    runs = compared.where("r_enough").select("run_id", F.col("r_start_med").alias("start_med"), F.col("r_floor").alias("floor"), F.col("r_end_med").alias("end_med"), F.col("r_improvement").alias("improvement"), "verdict")
    return base.unionByName(runs)


def merge_into(reports: DataFrame, compared: DataFrame) -> DataFrame:
    """Single-run reports with the findings of their comparison appended: a failed comparison fails the run, a warning lifts a pass only."""
    c = compared.select(F.col("run_id").alias("c_run"), F.col("verdict").alias("c_verdict"), F.col("findings").alias("c_findings"))
    both = reports.join(c, reports["run_id"] == c["c_run"], "left")
    verdict = F.when(F.col("c_verdict") == "FAIL", "FAIL").when((F.col("c_verdict") == "WARN") & (F.col("verdict") == "PASS"), "WARN").otherwise(F.col("verdict"))
    return both.withColumn("findings", F.concat("findings", F.coalesce("c_findings", F.expr("filter(findings, x -> false)")))).withColumn("verdict", verdict).drop("c_run", "c_verdict", "c_findings")
