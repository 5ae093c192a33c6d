"""The rules once more, written out by hand for another SQL engine: over lists of each run's values, with the numbers as literals.

Nothing is imported from the engine, so that a wrong threshold, comparator, median or order there shows as a difference here.
"""

from __future__ import annotations


def _um(x: str) -> str:
    """Element n // 2, from 0, of the sorted list."""
    return f"list_sort({x})[len({x}) // 2 + 1]"


def _tail(x: str, n: str) -> str:
    return f"{x}[greatest(1, len({x}) - ({n}) + 1):]"


_SERIES = """series AS (
  SELECT run_id, count(*) AS n_rec,
    coalesce(list(loss ORDER BY rec_idx) FILTER (loss IS NOT NULL), []) AS losses,
    coalesce(list(coalesce(step, rec_idx::DOUBLE) ORDER BY rec_idx) FILTER (loss IS NOT NULL), []) AS loss_steps,
    coalesce(list(loss ORDER BY rec_idx) FILTER (isfinite(loss)), []) AS f,
    coalesce(list(grad_norm ORDER BY rec_idx) FILTER (isfinite(grad_norm)), []) AS g,
    coalesce(list(lr ORDER BY rec_idx) FILTER (lr IS NOT NULL), []) AS lrs,
    coalesce(list(eval_loss ORDER BY rec_idx) FILTER (isfinite(eval_loss)), []) AS e,
    coalesce(list(coalesce(step, rec_idx::DOUBLE) ORDER BY rec_idx) FILTER (isfinite(eval_loss)), []) AS e_steps,
    coalesce(list(step_time ORDER BY rec_idx) FILTER (isfinite(step_time)), []) AS st,
    coalesce(list(loader_time / step_time ORDER BY rec_idx) FILTER (step_time > 0 AND NOT isnan(step_time) AND isfinite(loader_time / step_time)), []) AS lf,
    coalesce(list(gpu_util ORDER BY rec_idx) FILTER (isfinite(gpu_util)), []) AS gu,
    coalesce(list(time ORDER BY rec_idx) FILTER (time IS NOT NULL), []) AS times,
    coalesce(list(coalesce(step, rec_idx::DOUBLE) ORDER BY rec_idx) FILTER (time IS NOT NULL), []) AS time_steps
  FROM records GROUP BY run_id)"""

_SIMPLE = f"""simple AS (
  SELECT *, len(f) AS n_f, len(g) AS n_g, len(e) AS n_e, len(st) AS n_st,
    list_filter(f, lambda x: x <> 0) AS nz,
    {_um("f[1:5]")} AS start_med, {_um(_tail("f", "5"))} AS end_med,
    list_min(f) AS floor, list_avg(f) AS mean, {_um("g")} AS g_med, list_min(e) AS e_min,
    len(list_filter(lrs, lambda x: x <= 0 AND NOT isnan(x))) AS zero_lrs
  FROM series),
places AS (
  SELECT *, list_min(nz) AS floor_nz, list_position(e, e_min) AS e_at, e_steps[list_position(e, e_min)] AS e_step,
    {_um("st[1:greatest(1, len(st) // 2)]")} AS early, {_um(_tail("st", "greatest(1, floor(len(st) * 0.2)::BIGINT)"))} AS late,
    CASE WHEN n_f > 0 THEN sqrt(list_avg(list_transform(f, lambda x: (x - mean) * (x - mean)))) END AS sd,
    coalesce(len(f) > 0 AND list_bool_and(list_transform(f, lambda x: x = 0.0)), false) AS f_zero,
    coalesce(len(g) > 0 AND list_bool_and(list_transform(g, lambda x: x = 0.0)), false) AS g_zero
  FROM simple),
then_ AS (
  SELECT *, coalesce(list_filter(list_transform(range(1, len(losses) + 1), lambda i: CASE WHEN loss_steps[i] >= e_step THEN losses[i] END), lambda x: x IS NOT NULL)[1], losses[-1]) AS train_then
  FROM places)"""

#: Why a check group did not run, null if it did.
_GUARDS = {
    "zero-loss": "CASE WHEN n_f < 5 THEN 'fewer than 5 finite loss points' END",
    "flat-loss": "CASE WHEN n_f = 0 THEN 'every logged loss is NaN or Inf' WHEN NOT mean > 0 THEN 'mean loss is not positive - relative variation is undefined' END",
    "divergence": "CASE WHEN n_f = 0 THEN 'every logged loss is NaN or Inf' WHEN floor_nz IS NULL OR floor_nz <= 0 THEN 'no positive loss to measure a floor against' END",
    "dead-run": "CASE WHEN n_f = 0 THEN 'every logged loss is NaN or Inf' WHEN n_f < 10 THEN 'fewer than 10 finite loss points' WHEN start_med <= 0 THEN 'starting loss is not positive - relative improvement is undefined' END",
    "zero-grad": "CASE WHEN n_g = 0 THEN 'no finite gradient norms in the log' WHEN n_g < 5 THEN 'fewer than 5 finite gradient norms' WHEN g_zero AND len(nz) > 0 AND floor_nz < nz[1] * 0.95 THEN 'gradient norms are all 0.0 but the loss improved: the log has an aggregate, not the norm' END",
    "grad-spike": "CASE WHEN n_g = 0 THEN 'no finite gradient norms in the log' WHEN n_g < 6 THEN 'fewer than 6 finite gradient norms' WHEN NOT g_med > 0 THEN 'median gradient norm is zero - no scale to measure a spike against' END",
    "lr": "CASE WHEN len(lrs) = 0 THEN 'no learning-rate column in the log' END",
    "overfit": "CASE WHEN n_e = 0 THEN 'no eval_loss in the log: nothing is known of generalisation' WHEN n_e < 4 THEN 'fewer than 4 eval points' END",
    "step-time": "CASE WHEN n_st = 0 THEN 'no step_time column in the log' WHEN n_st < 10 THEN 'fewer than 10 step_time points' WHEN NOT early > 0 THEN 'median early step_time is zero - no baseline to compare against' END",
    "loader": "CASE WHEN len(lf) = 0 THEN 'no loader_time/step_time pair in the log' END",
}

#: In the order of findings: id, level, group, condition.
_RULES = [
    ("TP-NAN", "FAIL", None, "len(losses) > n_f"),
    ("TP-ZERO-LOSS", "FAIL", "zero-loss", "f_zero"),
    ("TP-FLAT", "FAIL", "flat-loss", "sd / mean < 0.001"),
    ("TP-DIVERGE", "FAIL", "divergence", "f[-1] > 1.5 * floor_nz"),
    ("TP-DEAD-RUN", "FAIL", "dead-run", "end_med >= start_med * 0.95"),
    ("TP-ZERO-GRAD", "FAIL", "zero-grad", "g_zero"),
    ("TP-GRAD-SPIKE", "WARN", "grad-spike", "len(list_filter(g, lambda x: x > 10.0 * g_med)) > 0"),
    ("TP-ZERO-LR", "FAIL", "lr", "zero_lrs / len(lrs) >= 0.99"),
    ("TP-ZERO-LR-PARTIAL", "WARN", "lr", "zero_lrs / len(lrs) > 0.1 AND zero_lrs / len(lrs) < 0.99"),
    ("TP-THROUGHPUT", "INFO", None, "len(times) >= 2 AND times[-1] > times[1] AND NOT isnan(times[-1]) AND time_steps[-1] > time_steps[1]"),
    ("TP-OVERFIT", "WARN", "overfit", f"n_e - e_at >= 3 AND {_um(_tail('e', '3'))} > 1.2 * e_min AND NOT isnan(train_then) AND f[-1] < train_then"),
    ("TP-STEP-CLIFF", "WARN", "step-time", "late > 3.0 * early"),
    ("TP-LOADER-BOUND", "WARN", "loader", f"{_um('lf')} > 0.5"),
    ("TP-GPU-UTIL", "INFO", None, "len(gu) > 0"),
]

_COL = lambda x: x.lower().replace("-", "_")
_NO_LOSS = "CASE WHEN n_rec = 0 THEN 'no records parsed' WHEN len(losses) = 0 THEN 'no loss column in the log' END"
_LEVEL = lambda level: " OR ".join(_COL(r[0]) for r in _RULES if r[1] == level)


def judged(records: str) -> str:
    """CTEs up to `judged`: for each run its values, skip_<group>, a boolean for each rule, and the verdict."""
    skips = ", ".join(f"coalesce({_NO_LOSS}, {g}) AS skip_{_COL(k)}" for k, g in _GUARDS.items())
    fires = ", ".join(f"coalesce(len(losses) > 0 AND {'' if not grp else f'skip_{_COL(grp)} IS NULL AND '}({cond}), false) AS {_COL(k)}" for k, _, grp, cond in _RULES)
    ran = " AND ".join(f"skip_{_COL(k)} IS NOT NULL" for k in _GUARDS)
    return f"""WITH records AS ({records}),
{_SERIES},
{_SIMPLE},
guarded AS (SELECT *, {skips} FROM then_),
fired AS (SELECT *, {fires} FROM guarded),
judged AS (SELECT *, CASE WHEN len(losses) = 0 OR {_LEVEL("FAIL")} THEN 'FAIL' WHEN {_LEVEL("WARN")} THEN 'WARN' WHEN {ran} THEN 'NOT-CHECKED' ELSE 'PASS' END AS verdict FROM fired)
"""


_IDS = "list_filter([CASE WHEN len(losses) = 0 THEN 'TP-NO-LOSS' END, " + ", ".join(f"CASE WHEN {_COL(r[0])} THEN '{r[0]}' END" for r in _RULES) + ", CASE verdict WHEN 'PASS' THEN 'TP-PASS' WHEN 'NOT-CHECKED' THEN 'TP-NOT-CHECKED' END], lambda x: x IS NOT NULL)"
_ORDER = "CASE verdict WHEN 'FAIL' THEN 0 WHEN 'WARN' THEN 1 WHEN 'NOT-CHECKED' THEN 2 ELSE 3 END"


def verdicts(records: str) -> str:
    return judged(records) + f"SELECT run_id, verdict, array_to_string({_IDS}, ',') AS ids FROM judged"


def rule(records: str, id_: str) -> str:
    grp = next(r[2] for r in _RULES if r[0] == id_)
    return judged(records) + f"SELECT run_id, {_COL(id_)} AS fires, {f"coalesce(skip_{_COL(grp)}, '')" if grp else "''"} AS skipped FROM judged"


def checks(records: str) -> str:
    return judged(records) + " UNION ALL ".join(f"SELECT run_id, '{g}' AS grp, skip_{_COL(g)} IS NULL AS ran, coalesce(skip_{_COL(g)}, '') AS reason FROM judged" for g in _GUARDS)


def worst(records: str) -> str:
    return judged(records) + f"SELECT arg_min(verdict, {_ORDER}) AS worst_verdict FROM judged"


def exit_code(records: str) -> str:
    return judged(records) + "SELECT CASE WHEN count_if(verdict = 'FAIL') > 0 THEN 1 WHEN count_if(verdict = 'NOT-CHECKED') > 0 THEN 2 ELSE 0 END AS exit_code FROM judged"


def triage(records: str) -> str:
    return judged(records) + f"SELECT row_number() OVER (ORDER BY {_ORDER}, run_id) - 1 AS place, run_id, verdict FROM judged"


def rate(records: str) -> str:
    return judged(records) + "SELECT run_id, round((time_steps[-1] - time_steps[1]) / (times[-1] - times[1]), 9) AS rate FROM judged WHERE len(times) >= 2 AND times[-1] > times[1] AND time_steps[-1] > time_steps[1]"


def bad_steps(records: str) -> str:
    return judged(records) + "SELECT run_id, array_to_string(list_transform(list_filter(range(1, len(losses) + 1), lambda i: NOT isfinite(losses[i]))[1:5], lambda i: loss_steps[i]::BIGINT), ',') AS steps FROM judged WHERE len(losses) > n_f"


def stats(records: str) -> str:
    r = lambda x, name: f"round(({x})::DOUBLE, 6) AS {name}"
    cols = [
        "n_rec", "len(losses) AS n_loss", "len(losses) - n_f AS n_bad", "n_f", r("mean", "f_mean"), r("sd", "f_sd"), r("floor", "floor"), r("floor_nz", "floor_nz"), r("nz[1]", "first_nz"), r("f[-1]", "last_f"), r("start_med", "start_med"), r("end_med", "end_med"),
        "n_g", r("g_med", "g_med"), r("list_max(g)", "g_max"), "len(lrs) AS n_lr", "zero_lrs AS n_lr0", "len(times) AS n_t", r("times[1]", "t0"), r("times[-1]", "t1"), r("time_steps[1]", "s0"), r("time_steps[-1]", "s1"),
        "n_e", r("e_min", "e_min"), r("e_at", "e_at"), r("e_step", "e_step"), r(_um(_tail("e", "3")), "e_med3"), r("list_filter(list_transform(range(1, len(losses) + 1), lambda i: CASE WHEN loss_steps[i] >= e_step THEN losses[i] END), lambda x: x IS NOT NULL)[1]", "loss_at"), r("losses[-1]", "last_loss"),
        "n_st", r("early", "st_early"), r("late", "st_late"), "len(lf) AS n_lf", r(_um("lf"), "lf_med"), "len(gu) AS n_gu", r(_um("gu"), "gu_med"),
    ]
    return judged(records) + f"SELECT run_id, {', '.join(cols)} FROM judged"


# -- comparison with a baseline

_METRICS = """m AS (SELECT run_id, verdict, n_f >= 10 AS enough, floor, start_med, end_med, CASE WHEN n_g >= 6 THEN g_med END AS gn_median,
  CASE WHEN n_f < 10 THEN NULL WHEN f_zero THEN 'every logged loss is exactly 0.0' WHEN start_med <= 0 THEN 'starting loss is not positive - relative improvement is undefined' END AS degenerate,
  CASE WHEN n_f >= 10 AND NOT f_zero AND start_med > 0 THEN 1.0 - end_med / start_med END AS improvement FROM judged)"""
#: The first run whose number ends in 3 is the baseline.
_ONE = "pairs AS (SELECT m AS r, base AS b FROM m, (SELECT * FROM m WHERE run_id % 10 = 3 ORDER BY run_id LIMIT 1) base)"
#: Each run against the first run of the same last digit.
_OWN = "pairs AS (SELECT m AS r, b FROM m JOIN m b ON b.run_id = (SELECT min(x.run_id) FROM m x WHERE x.run_id % 10 = m.run_id % 10))"
_LADDER = """step1 AS (SELECT r, b, r.verdict = 'NOT-CHECKED' OR b.verdict = 'NOT-CHECKED' AS unjudged FROM pairs),
step2 AS (SELECT *, NOT unjudged AND NOT (r.enough AND b.enough) AS short FROM step1),
step3 AS (SELECT *, NOT unjudged AND NOT short AND (r.degenerate IS NOT NULL OR b.degenerate IS NOT NULL) AS odd FROM step2),
step4 AS (SELECT *, NOT unjudged AND NOT short AND NOT odd AS fit FROM step3),
step5 AS (SELECT *, CASE WHEN fit AND b.floor = 0 AND r.floor IS NOT NULL THEN 'zero baseline floor' END AS error,
  b.verdict = 'FAIL' AND NOT short AS bad_base,
  coalesce(fit AND r.floor > 2.0 * b.floor, false) AS floor_ratio,
  coalesce(fit AND b.end_med > 0 AND r.end_med > 2.0 * b.end_med, false) AS end_ratio,
  coalesce(fit AND r.improvement < 0, false) AS worse,
  coalesce(fit AND NOT r.improvement < 0 AND b.improvement > 0 AND r.improvement < 0.25 * b.improvement, false) AS deficit,
  coalesce(fit AND b.gn_median > 0 AND r.gn_median > 5.0 * b.gn_median, false) AS gn_ratio FROM step4),
step6 AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'WARN' WHEN NOT fit OR floor_ratio OR end_ratio OR worse OR deficit THEN 'FAIL' WHEN bad_base OR gn_ratio THEN 'WARN' ELSE 'PASS' END AS verdict FROM step5),
compared AS (SELECT r, b, verdict, error, list_sort(list_filter([
  CASE WHEN bad_base THEN 'TP-BAD-BASELINE' END, CASE WHEN r.verdict = 'NOT-CHECKED' THEN 'TP-CMP-UNCOMPARABLE' END, CASE WHEN b.verdict = 'NOT-CHECKED' THEN 'TP-CMP-UNCOMPARABLE' END,
  CASE WHEN short THEN 'TP-NO-LOSS' END, CASE WHEN odd AND r.degenerate IS NOT NULL THEN 'TP-CMP-UNCOMPARABLE' END, CASE WHEN odd AND b.degenerate IS NOT NULL THEN 'TP-CMP-UNCOMPARABLE' END,
  CASE WHEN floor_ratio THEN 'TP-FLOOR-RATIO' END, CASE WHEN end_ratio THEN 'TP-END-RATIO' END, CASE WHEN worse THEN 'TP-NEG-IMPROVE' END, CASE WHEN deficit THEN 'TP-IMPROVE-DEFICIT' END,
  CASE WHEN gn_ratio THEN 'TP-GRADNORM-RATIO' END, CASE WHEN verdict = 'PASS' THEN 'TP-CMP-PASS' END, CASE WHEN error IS NOT NULL THEN 'TP-CMP-ERROR' END], lambda x: x IS NOT NULL)) AS ids FROM step6)
"""


def compared(records: str, own: bool = False) -> str:
    return judged(records) + f", {_METRICS}, {_OWN if own else _ONE}, {_LADDER}"


def compare_metrics(records: str) -> str:
    return judged(records) + f", {_METRICS} SELECT run_id, verdict, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("floor", "start_med", "end_med", "improvement", "gn_median")) + ", enough, coalesce(degenerate, '') AS degenerate FROM m"


def compare_fleet(records: str) -> str:
    return compared(records) + "SELECT r.run_id AS run_id, b.run_id AS baseline_id, verdict, coalesce(error, '') AS error, array_to_string(ids, ',') AS ids FROM compared"


def compare_own(records: str) -> str:
    return compared(records, own=True) + "SELECT r.run_id AS run_id, b.run_id AS baseline_id, verdict, array_to_string(ids, ',') AS ids FROM compared"


def compare_ranking(records: str) -> str:
    return compared(records) + "SELECT r.run_id AS run_id, round(r.start_med, 6) AS start_med, round(r.floor, 6) AS floor, round(r.end_med, 6) AS end_med, round(r.improvement, 6) AS improvement, CASE WHEN r.run_id = b.run_id THEN 'BASELINE' ELSE verdict END AS verdict FROM compared WHERE r.enough"


def doctor(records: str) -> str:
    return compared(records) + f", own AS (SELECT run_id, verdict AS o, len({_IDS}) AS n FROM judged) SELECT own.run_id, CASE WHEN verdict = 'FAIL' THEN 'FAIL' WHEN verdict = 'WARN' AND o = 'PASS' THEN 'WARN' ELSE o END AS verdict, (n + len(ids))::BIGINT AS n_findings FROM own JOIN compared ON r.run_id = own.run_id"


def fleet(records: str) -> str:
    counts = ", ".join(f"count_if(verdict = '{v}')::BIGINT AS {_COL(v)}" for v in ("FAIL", "WARN", "NOT-CHECKED", "PASS"))
    return judged(records) + f", j AS (SELECT verdict, run_id % 3 AS seed, trim(n_name) AS nation FROM judged JOIN nation ON n_nationkey = run_id % 25) SELECT coalesce(nation, '*') AS nation, coalesce(seed, -1) AS seed, count(*) AS runs, {counts} FROM j GROUP BY ROLLUP (nation, seed)"
