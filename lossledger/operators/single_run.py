"""Single-run rules: pure column expressions over the statistics of a run.

GUARDS says for each check group why it can't run (null: it ran), RULES when a rule fires. A guard that isn't decidable counts as a reason, never as a
pass. Both are SQL texts that other engines accept, too.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import thresholds as T
from ..plans.stats import run_stats
from ..schema import GROUPS

_ALL_BAD = "every logged loss is NaN or Inf"
_BETTER = 1 - T.MIN_IMPROVEMENT

GUARDS: dict[str, str] = {
    "zero-loss": f"CASE WHEN n_f < {T.DEGENERATE_MIN_POINTS} THEN 'fewer than {T.DEGENERATE_MIN_POINTS} finite loss points' END",
    "flat-loss": f"CASE WHEN n_f = 0 THEN '{_ALL_BAD}' WHEN NOT coalesce(f_mean > 0, false) THEN 'mean loss is not positive - relative variation is undefined' END",
    "divergence": f"CASE WHEN n_f = 0 THEN '{_ALL_BAD}' WHEN NOT coalesce(floor_nz > 0, false) THEN 'no positive loss to measure a floor against' END",
    "dead-run": f"CASE WHEN n_f = 0 THEN '{_ALL_BAD}' WHEN n_f < {T.IMPROVEMENT_MIN_POINTS} THEN 'fewer than {T.IMPROVEMENT_MIN_POINTS} finite loss points' WHEN NOT coalesce(start_med > 0, false) THEN 'starting loss is not positive - relative improvement is undefined' END",
    "zero-grad": f"CASE WHEN n_g = 0 THEN 'no finite gradient norms in the log' WHEN n_g < {T.DEGENERATE_MIN_POINTS} THEN 'fewer than {T.DEGENERATE_MIN_POINTS} finite gradient norms' WHEN g_zero AND coalesce(floor_nz < first_nz * {_BETTER}, false) THEN 'gradient norms are all 0.0 but the loss improved: the log has an aggregate, not the norm' END",
    "grad-spike": f"CASE WHEN n_g = 0 THEN 'no finite gradient norms in the log' WHEN n_g < {T.GRAD_MIN_POINTS} THEN 'fewer than {T.GRAD_MIN_POINTS} finite gradient norms' WHEN NOT coalesce(g_med > 0, false) THEN 'median gradient norm is zero - no scale to measure a spike against' END",
    "lr": "CASE WHEN n_lr = 0 THEN 'no learning-rate column in the log' END",
    "overfit": f"CASE WHEN n_e = 0 THEN 'no eval_loss in the log: nothing is known of generalisation' WHEN n_e < {T.OVERFIT_MIN_EVALS} THEN 'fewer than {T.OVERFIT_MIN_EVALS} eval points' END",
    "step-time": f"CASE WHEN n_st = 0 THEN 'no step_time column in the log' WHEN n_st < {T.STEP_MIN_POINTS} THEN 'fewer than {T.STEP_MIN_POINTS} step_time points' WHEN NOT coalesce(st_early > 0, false) THEN 'median early step_time is zero - no baseline to compare against' END",
    "loader": "CASE WHEN n_lf = 0 THEN 'no loader_time/step_time pair in the log' END",
}
assert list(GUARDS) == GROUPS


class Rule(NamedTuple):
    id: str
    level: str
    group: str | None
    fires: str
    message: str
    evidence: str  # a Spark SQL expression


_AT = "coalesce(loss_at, last_loss)"

#: In the order in which findings are listed.
RULES: list[Rule] = [
    Rule("TP-NAN", "FAIL", None, "n_bad > 0", "NaN or Inf detected in loss.", "concat('Steps: [', array_join(transform(bad_steps, x -> cast(x as string)), ', '), ']...')"),
    Rule("TP-ZERO-LOSS", "FAIL", "zero-loss", "f_zero", "Every logged loss is exactly zero: nothing was learned.", "format_string('all %d finite losses are exactly 0.0; look at label masking and truncation', n_f)"),
    Rule("TP-FLAT", "FAIL", "flat-loss", f"f_sd / nullif(f_mean, 0) < {T.FLAT_VARIATION}", "Loss curve is completely flat (dead run).", f"format_string('Variation %.5f < {T.FLAT_VARIATION}', f_sd / nullif(f_mean, 0))"),
    Rule("TP-DIVERGE", "FAIL", "divergence", f"last_f > floor_nz * {T.DIVERGE_RATIO}", "Loss curve is diverging.", "format_string('End loss %.3f vs Min loss %.3f', last_f, floor_nz)"),
    Rule("TP-DEAD-RUN", "FAIL", "dead-run", f"end_med >= start_med * {_BETTER}", "Loss never improved over the run (dead run).", f"format_string('median of first {T.IMPROVEMENT_WINDOW} losses %.3f vs last {T.IMPROVEMENT_WINDOW} %.3f (needs >={T.MIN_IMPROVEMENT * 100:.0f}%% improvement)', start_med, end_med)"),
    Rule("TP-ZERO-GRAD", "FAIL", "zero-grad", "g_zero", "Every logged gradient norm is exactly zero: no gradient reached the weights.", "format_string('all %d finite gradient norms are exactly 0.0; the graph is cut or all parameters are frozen', n_g)"),
    Rule("TP-GRAD-SPIKE", "WARN", "grad-spike", f"g_max > g_med * {T.GRAD_SPIKE_RATIO}", "Gradient norm spikes detected.", f"format_string('Max gn %.2f > {T.GRAD_SPIKE_RATIO}x median (%.2f)', g_max, g_med)"),
    Rule("TP-ZERO-LR", "FAIL", "lr", f"n_lr0 >= {T.LR_FAIL_SHARE} * n_lr", "Learning rate is zero all along: the optimizer never steps.", "format_string('%.1f%% of steps have lr=0', 1e2 * n_lr0 / nullif(n_lr, 0))"),
    Rule("TP-ZERO-LR-PARTIAL", "WARN", "lr", f"n_lr0 > {T.LR_WARN_SHARE} * n_lr AND n_lr0 < {T.LR_FAIL_SHARE} * n_lr", "Learning rate is zero for a large part of the run.", "format_string('%.1f%% of steps have lr=0', 1e2 * n_lr0 / nullif(n_lr, 0))"),
    Rule("TP-THROUGHPUT", "INFO", None, "n_t >= 2 AND t1 > t0 AND NOT isnan(t1) AND s1 > s0", "Throughput measured from log timestamps.", "format_string('%.2f steps/sec over %.0fs observed.', (s1 - s0) / nullif(t1 - t0, 0), t1 - t0)"),
    Rule("TP-OVERFIT", "WARN", "overfit", f"n_e - e_at >= {T.OVERFIT_LAST} AND e_med3 > e_min * {T.OVERFIT_RATIO} AND NOT isnan({_AT}) AND last_f < {_AT}", "Eval loss got much worse while train loss went on falling.", f"format_string('eval_loss min %.2f @step%d rose to %.2f (%.1fx > {T.OVERFIT_RATIO}) over the last {T.OVERFIT_LAST} evals; train_loss fell to %.2f', e_min, cast(e_step as bigint), e_med3, e_med3 / nullif(e_min, 0), last_f)"),
    Rule("TP-STEP-CLIFF", "WARN", "step-time", f"st_late > {T.STEP_CLIFF_RATIO} * st_early", "Step time cliff: recent steps are much slower.", f"format_string('median recent step_time %.2fs > {T.STEP_CLIFF_RATIO}x median early step_time (%.2fs)', st_late, st_early)"),
    Rule("TP-LOADER-BOUND", "WARN", "loader", f"lf_med > {T.LOADER_SHARE}", "Dataloader stall: too much of a step is loading data.", f"format_string('median loader_time/step_time %.1f%% > {T.LOADER_SHARE * 100:.1f}%%', lf_med * 100)"),
    Rule("TP-GPU-UTIL", "INFO", None, "n_gu > 0", "GPU utilization context.", "format_string('median gpu_util %.1f%% observed.', gu_med)"),
]

_NOTHING = "CASE WHEN n_rec = 0 THEN 'no records parsed' WHEN n_loss = 0 THEN 'no loss column in the log' END"


def guard(group: str) -> str:
    return f"coalesce({_NOTHING}, {GUARDS[group]})"


def fires(rule: Rule) -> str:
    """Boolean, never null: judged at all, its group ran, and the condition holds."""
    ran = f" AND {GUARDS[rule.group]} IS NULL" if rule.group else ""
    return f"coalesce(n_loss > 0{ran} AND {rule.fires}, false)"


def any_level(level: str) -> str:
    return "(" + " OR ".join(fires(r) for r in RULES if r.level == level) + ")"


N_RAN = "(" + " + ".join(f"CASE WHEN {guard(g)} IS NULL THEN 1 ELSE 0 END" for g in GROUPS) + ")"
VERDICT = f"CASE WHEN n_loss = 0 OR {any_level('FAIL')} THEN 'FAIL' WHEN {any_level('WARN')} THEN 'WARN' WHEN {N_RAN} = 0 THEN 'NOT-CHECKED' ELSE 'PASS' END"


def _finding(id_: str, level: str, message: str, evidence: str) -> str:
    return f"struct('{id_}' as id, '{level}' as level, {message} as message, {evidence} as evidence, 'single_run' as source)"


def judge(stats: DataFrame) -> DataFrame:
    """Statistics -> reports: run_id, verdict, findings, ran, skipped, and the statistics themselves."""
    quote = lambda s: "'" + s.replace("'", "\\'") + "'"
    when = lambda cond, f: f"CASE WHEN {cond} THEN {f} END"
    found = [
        when("n_rec = 0", _finding("TP-NO-RECORDS", "FAIL", "'No valid log records found.'", "cast(run_id as string)")),
        when("n_rec > 0 AND n_loss = 0", _finding("TP-NO-LOSS", "FAIL", "'Could not find loss metric in logs.'", "''")),
        *[when(fires(r), _finding(r.id, r.level, quote(r.message), f"coalesce({r.evidence}, '')")) for r in RULES],
    ]
    judged = stats.withColumn("verdict", F.expr(VERDICT))
    judged = judged.withColumn("skipped", F.expr("map_filter(map(" + ", ".join(f"'{g}', {guard(g)}" for g in sorted(GROUPS)) + "), (k, v) -> v is not null)"))
    judged = judged.withColumn("ran", F.expr("filter(array(" + ", ".join(f"'{g}'" for g in sorted(GROUPS)) + "), g -> not map_contains_key(skipped, g))"))
    skips = "array_join(transform(map_entries(skipped), x -> concat(x.key, ' (', x.value, ')')), '; ')"
    closing = (
        when("verdict = 'NOT-CHECKED'", _finding("TP-NOT-CHECKED", "NOT-CHECKED", f"'{len(GROUPS)} check groups considered, 0 executed.'", f"concat('Skipped: ', {skips})")),
        when("verdict = 'PASS'", _finding("TP-PASS", "PASS", f"concat('No mechanical failures detected. Ran: ', array_join(ran, ', '), '.', if(size(skipped) > 0, concat(' Skipped: ', {skips}, '.'), ''))", "format_string('%d steps analyzed.', n_f)")),
    )
    return judged.withColumn("findings", F.expr(f"filter(array({', '.join([*found, *closing])}), x -> x is not null)"))


def check_records(records: DataFrame) -> DataFrame:
    """Log records of any number of runs -> a report for each run."""
    return judge(run_stats(records))


def check_runs(records: DataFrame, runs: DataFrame) -> DataFrame:
    """As check_records, with a TP-NO-RECORDS report for each run_id of runs that has no record."""
    stats = run_stats(records)
    zero = {f.name: 0 for f in stats.schema if f.dataType.typeName() == "long"}
    return judge(runs.select("run_id").distinct().join(stats, "run_id", "left").fillna(zero))


def findings(reports: DataFrame) -> DataFrame:
    """Exploded: run_id, ord, id, level, message, evidence, source."""
    return reports.select("run_id", F.posexplode("findings").alias("ord", "f")).select("run_id", "ord", "f.*")


def checks(reports: DataFrame) -> DataFrame:
    """A row for each run and check group: ran, or the reason why not."""
    grp = F.explode(F.array(*[F.lit(g) for g in GROUPS])).alias("grp")
    return reports.select("run_id", "skipped", grp).select("run_id", "grp", (~F.map_contains_key("skipped", F.col("grp"))).alias("ran"), F.try_element_at("skipped", F.col("grp")).alias("reason"))
