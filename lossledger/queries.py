"""Queries over the standard tables that stand in for logs, and the same in SQL for another engine.

`events` are training logs: a run for each user, records in order of time. Raw values are noise, so that variants with a decaying loss, zero
losses, NaNs, dead gradients and slow tails exercise both sides of every rule.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from . import thresholds as T
from .api import merge_telemetry
from .functions.columns import as_float, canonical, normal_tag
from .operators import compare as C
from .operators import objective, preflight, rollup, single_run, speech
from .plans.stats import STATS, run_stats
from .schema import alias_map
from .sources import logs, tfevents

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- events as logs

_DIALECT = {
    "spark": {"us": "unix_micros(cast(ts as timestamp))", "k": "cast(get_json_object(props, '$.k') as double)", "nan": "double('NaN')", "table": "events"},
    "duck": {"us": "epoch_us(ts)", "k": "CAST(props->>'$.k' AS DOUBLE)", "nan": "'NaN'::DOUBLE", "table": "events"},
}

#: Variants: what loss, gradient norm, learning rate and step time are; {..} by dialect.
_VARIANTS = {
    "raw": {},
    "healthy": {"loss": "100 / (1 + rec_idx) + value / 1000"},
    "mixed": {
        "loss": "CASE WHEN run % 10 = 0 THEN 0e0 WHEN run % 10 = 1 THEN 5e0 WHEN run % 10 = 2 AND k >= 98 THEN {nan} WHEN run % 10 < 6 THEN 100 / (1 + rec_idx) + value / 1000 ELSE value END",
        "grad_norm": "CASE WHEN run % 7 = 0 THEN 0e0 WHEN run % 7 = 1 THEN 1 + value / 100 + CASE WHEN rec_idx = 20 THEN 900 ELSE 0 END ELSE 1 + value / 500 END",
        "lr": "CASE WHEN run % 5 = 0 THEN 0e0 WHEN run % 5 = 1 AND k < 30 THEN 0e0 ELSE (1 + k) * 1e-6 END",
        "eval_loss": "CASE WHEN rec_idx % 10 = 0 AND run % 3 > 0 THEN CASE WHEN run % 3 = 1 THEN 1 + abs(rec_idx - 30) / 1e1 ELSE 100 / (1 + rec_idx) END END",
        "step_time": "1 + k / 1e3 + CASE WHEN run % 6 = 0 AND rec_idx >= 36 THEN 5 ELSE 0 END",
        "loader_time": "CASE WHEN run % 4 = 0 THEN 0.7e0 WHEN run % 4 = 1 THEN 0.2e0 END",
    },
    "no_loss": {"loss": "CAST(NULL AS DOUBLE)"},
    "steps_missing": {"step": "CASE WHEN rec_idx % 3 = 0 THEN CAST(rec_idx AS DOUBLE) END", "loss": "100 / (1 + rec_idx) + value / 1000", "eval_loss": "CASE WHEN rec_idx % 10 = 0 THEN CASE WHEN run % 3 = 1 THEN 1 + abs(rec_idx - 30) / 1e1 ELSE 100 / (1 + rec_idx) END END"},
    "short": {"loss": "CASE WHEN rec_idx < 4 THEN 0e0 END", "eval_loss": "CAST(NULL AS DOUBLE)", "grad_norm": "CAST(NULL AS DOUBLE)", "lr": "CAST(NULL AS DOUBLE)", "step_time": "CAST(NULL AS DOUBLE)", "loader_time": "CAST(NULL AS DOUBLE)", "gpu_util": "CAST(NULL AS DOUBLE)"},
}


def _records_sql(dialect: str, variant: str) -> str:
    d = _DIALECT[dialect]
    base = {
        "step": "CAST(rec_idx AS DOUBLE)",
        "loss": "value",
        "eval_loss": "CASE WHEN event_type = 'purchase' THEN value END",
        "grad_norm": "CASE WHEN event_type = 'click' THEN value END",
        "lr": "k * 1e-6",
        "time": "us / 1e6",
        "step_time": "(us - before) / 1e6",
        "loader_time": "(us - before) / 1e6 * k / 100",
        "gpu_util": "k",
    } | _VARIANTS[variant]
    cols = ", ".join(f"{v.format(nan=d['nan'])} AS {k}" for k, v in base.items())
    order = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
    return (
        f"SELECT run AS run_id, rec_idx, {cols} FROM (SELECT user_id AS run, CAST(row_number() {order} - 1 AS BIGINT) AS rec_idx, "
        f"value, event_type, {d['us']} AS us, {d['k']} AS k, lag({d['us']}) {order} AS before FROM {d['table']}) e"
    )


def log_records(spark: SparkSession, sf_dir: str, variant: str = "raw") -> DataFrame:
    """Canonical records from events."""
    return spark.sql(_records_sql("spark", variant).replace("FROM events", "FROM {e}"), e=_table(spark, sf_dir, "events"))


def reports(spark: SparkSession, sf_dir: str, variant: str = "mixed") -> DataFrame:
    return single_run.check_records(log_records(spark, sf_dir, variant))


def _ids(findings: str = "findings"):
    return F.array_join(F.transform(findings, lambda f: f["id"]), ",")


def _rounded(c: str) -> str:
    return f"round(CAST({c} AS DOUBLE), 6) AS {c}"


_STAT_COLS = [k for k in STATS if k not in ("f_zero", "g_zero")]
_INT_STATS = {k for k in STATS if k.startswith("n_")}


def series_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stats(log_records(spark, sf_dir, "mixed")).selectExpr("run_id", *[f"CAST({k} AS BIGINT) AS {k}" if k in _INT_STATS else _rounded(k) for k in _STAT_COLS])


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("run_id", "verdict", _ids().alias("ids"))


def verdicts_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir, "short").select("run_id", "verdict", _ids().alias("ids"))


def verdicts_healthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir, "healthy").select("run_id", "verdict", _ids().alias("ids"))


def _verdicts_of(variant: str) -> Query:
    return lambda spark, sf_dir: reports(spark, sf_dir, variant).select("run_id", "verdict", _ids().alias("ids"))


def checks_no_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single_run.checks(reports(spark, sf_dir, "no_loss")).select("run_id", "grp", "ran", F.coalesce("reason", F.lit("")).alias("reason"))


def verdicts_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules on a larger table: a run for each supplier."""
    return single_run.check_records(lineitem_records(spark, sf_dir)).select("run_id", "verdict", _ids().alias("ids"))


_LINEITEM = """SELECT l_suppkey AS run_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS rec_idx,
l_extendedprice / 1000 AS loss, l_discount AS lr, l_quantity AS grad_norm, CAST(NULL AS DOUBLE) AS eval_loss, CAST(NULL AS DOUBLE) AS time, 1 + l_tax AS step_time, l_discount AS loader_time, CAST(NULL AS DOUBLE) AS gpu_util FROM lineitem"""


def lineitem_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LINEITEM.replace("FROM lineitem", "FROM {l}"), l=_table(spark, sf_dir, "lineitem"))


def checks_ran_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single_run.checks(reports(spark, sf_dir)).select("run_id", "grp", "ran", F.coalesce("reason", F.lit("")).alias("reason"))


def worst_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.worst_verdict(reports(spark, sf_dir))


def _exit_code(variant: str) -> Query:
    return lambda spark, sf_dir: rollup.exit_code(reports(spark, sf_dir, variant))


#: All passed or warned; some failed; some could not be judged.
_EXITS = {"": "healthy", "_failed": "mixed", "_unjudged": "short"}


def triage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each run, worst first."""
    ordered = rollup.triage(reports(spark, sf_dir).select("run_id", "verdict"))
    return ordered.select(rollup.place(F.col("verdict"), "run_id").alias("place"), "run_id", "verdict")


def bad_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first steps with a loss that is no number."""
    stats = run_stats(log_records(spark, sf_dir, "mixed")).where("n_bad > 0")
    return stats.select("run_id", F.array_join(F.transform("bad_steps", lambda x: x.cast("long").cast("string")), ",").alias("steps"))


def _rule_query(rule: single_run.Rule) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        stats = run_stats(log_records(spark, sf_dir, "mixed"))
        return stats.select("run_id", F.expr(single_run.fires(rule)).alias("fires"), F.expr(f"coalesce({single_run.guard(rule.group)}, '')" if rule.group else "''").alias("skipped"))

    return query


def throughput_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stats(log_records(spark, sf_dir)).where("n_t >= 2 and t1 > t0 and s1 > s0").select("run_id", F.round((F.col("s1") - F.col("s0")) / (F.col("t1") - F.col("t0")), 9).alias("rate"))


# -- comparisons


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.metrics(reports(spark, sf_dir))


def compare_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    return m.select("run_id", "verdict", *[F.round(c, 6).alias(c) for c in ("floor", "start_med", "end_med", "improvement", "gn_median")], "enough", F.coalesce("degenerate", F.lit("")).alias("degenerate"))


def _base_of(m: DataFrame) -> DataFrame:
    """The baseline: the first run whose number ends in 3."""
    return m.where("run_id % 10 = 3").orderBy("run_id").limit(1)


def compare_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    return C.compare(m, _base_of(m)).select("run_id", "baseline_id", "verdict", F.coalesce("error", F.lit("")).alias("error"), F.array_join(F.array_sort(F.transform("findings", lambda f: f["id"])), ",").alias("ids"))


def compare_own_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run against the run of the same residue among the first ten: an equi-join."""
    m = _metrics(spark, sf_dir)
    first = m.groupBy((F.col("run_id") % 10).alias("r")).agg(F.min("run_id").alias("baseline_id"))
    runs = m.join(first, F.col("run_id") % 10 == F.col("r")).drop("r")
    return C.compare(runs, m).select("run_id", "baseline_id", "verdict", F.array_join(F.array_sort(F.transform("findings", lambda f: f["id"])), ",").alias("ids"))


def compare_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    base = _base_of(m)
    return C.ranking(C.compare(m.join(base.select(F.col("run_id").alias("b")), F.col("run_id") == F.col("b"), "left_anti"), base), base).select("run_id", *[F.round(c, 6).alias(c) for c in ("start_med", "floor", "end_med", "improvement")], "verdict")


def doctor_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    m = C.metrics(r)
    return C.merge_into(r, C.compare(m, _base_of(m))).select("run_id", "verdict", F.size("findings").cast("long").alias("n_findings"))


# -- columns, tags, gaps and islands


def json_column_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from the JSON texts of events with a column override."""
    pairs = F.map_entries(F.from_json("props", "map<string,string>"))
    e = _table(spark, sf_dir, "events").select("event_id", F.explode(pairs).alias("p"))
    return e.select("event_id", canonical(F.col("p.key"), {"loss": "K"}).alias("canon"), as_float(F.col("p.value")).alias("v")).where("canon is not null and v is not null")


def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of event types and aliases, resolved."""
    names = sorted(alias_map())
    e = _table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*[F.lit(n.upper()) for n in names]), (F.col("event_id") % len(names) + 1).cast("int")).alias("name"))
    return e.groupBy("name").agg(F.count("*").alias("n")).select("name", "n", canonical(F.col("name")).alias("canon"))


_TAGS = ["train/loss", "val/loss", "TrainIterStats/loss", "EvalStats/avg_loss", "lr-AdamW/pg1", "grad_norm", "TrainEpochStats/avg_loss", "test/loss", "other/loss", "learning_rate"]


def tag_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.element_at(F.array(*[F.lit(t) for t in _TAGS]), (F.col("event_id") % len(_TAGS) + 1).cast("int")).alias("tag"))
    return e.groupBy("tag").agg(F.count("*").alias("n")).select("tag", "n", normal_tag(F.col("tag")).alias("name"), canonical(normal_tag(F.col("tag"))).alias("canon"))


def _scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    tag = F.element_at(F.array(*[F.lit(t) for t in _TAGS]), (F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(len(_TAGS))) + 1).cast("int"))
    return e.select(F.col("user_id").alias("run_id"), tag.alias("tag"), (F.col("event_id") % 50).alias("step"), "value", F.expr("unix_micros(cast(ts as timestamp)) / 1e6").alias("wall_time"), F.lit("f").alias("file"), F.col("event_id").alias("seq"))


_SCALARS_SQL = f"scalars AS (SELECT user_id AS run_id, ({_TAGS!r})[(event_id * 7 + user_id) % {len(_TAGS)} + 1] AS tag, event_id % 50 AS step, value, epoch_us(ts) / 1e6 AS wall_time, event_id AS seq FROM events)"
_CANON_OF = {"train/loss": "loss", "val/loss": "eval_loss", "TrainIterStats/loss": "loss", "EvalStats/avg_loss": "eval_loss", "lr-AdamW/pg1": "lr", "grad_norm": "grad_norm", "TrainEpochStats/avg_loss": "loss", "test/loss": "eval_loss", "learning_rate": "lr"}
_WINNERS_SQL = f"""WITH {_SCALARS_SQL},
names AS (SELECT unnest({list(_CANON_OF)!r}) AS tag, unnest({list(_CANON_OF.values())!r}) AS canon),
counts AS (SELECT run_id, tag, canon, count(*) AS n FROM scalars JOIN names USING (tag) GROUP BY ALL),
winners AS (SELECT run_id, canon, tag FROM counts QUALIFY row_number() OVER (PARTITION BY run_id, canon ORDER BY n DESC, tag) = 1)
"""


def claim_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfevents.claim_winners(_scalars(spark, sf_dir))


def fold_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scalars(spark, sf_dir)
    return tfevents.fold(s, tfevents.claim_winners(s)).select("run_id", "rec_idx", "step", "loss", "eval_loss", "lr", "grad_norm", F.round("time", 3).alias("time"))


# -- datasets, objectives, texts


def preflight_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank texts after words with vowels are taken out, which leaves some blank."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.regexp_replace("text", r"^[^.]*\.\s*", "").alias("text"))
    return preflight.empty_rows(d).select("n", F.array_join("first", ",").alias("first"))


def preflight_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preflight.duplicates(_table(spark, sf_dir, "documents").select("text"))


def preflight_duplicates_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preflight.duplicates(_table(spark, sf_dir, "conversations").select("text"))


def preflight_context_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("text")
    return preflight.context_overflow(d, F.size(F.split("text", r"\s+")), 512)


def preflight_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    fields = F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("content"), F.col("text"), F.lit("response"), F.lit("no"))).otherwise(F.create_map(F.lit("other"), F.col("text")))
    return c.select("conv_id", "turn", F.length(preflight.extract_text(fields)).cast("long").alias("chars"))


def _objective(classes: int, ignore: int | None, table: str, col: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cov = objective.judge_coverage(objective.coverage(_table(spark, sf_dir, table), classes, ignore, col), classes)
        return cov.select("n_targets", "out_of_range", "n_seen", F.array_join("missing", ",").alias("missing"), "ids")

    return query


def _objective_sql(classes: int, ignore: int | None, table: str, col: str) -> str:
    keep = "TRUE" if ignore is None else f"{col} <> {ignore}"
    return f"""WITH t AS (SELECT {col}::BIGINT AS t FROM {table} WHERE {keep}),
a AS (SELECT count(*) AS n_targets, count_if(t < 0 OR t >= {classes}) AS out_of_range, count(DISTINCT t) FILTER (t >= 0 AND t < {classes}) AS n_seen FROM t),
m AS (SELECT c FROM range({classes}) r(c) WHERE c NOT IN (SELECT t FROM t)),
b AS (SELECT count(*) AS k, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c), '') AS missing FROM m)
SELECT n_targets, out_of_range::BIGINT AS out_of_range, n_seen, missing, concat_ws(',', CASE WHEN out_of_range > 0 THEN 'TP-OBJ-TARGET-OUT-OF-RANGE' END,
CASE WHEN n_seen < {T.DEAD_CLASS_MIN_COVERAGE} * {classes} THEN 'TP-OBJ-COVERAGE-INSUFFICIENT' WHEN k BETWEEN 1 AND {T.DEAD_CLASS_MAX_LISTED} THEN 'TP-OBJ-DEAD-CLASS' WHEN k = 0 THEN 'TP-OBJ-DEAD-CLASS-OK' END) AS ids FROM a, b"""


_OBJECTIVES = {
    "objective_coverage": (10, None, "embeddings", "label"),
    "objective_dead_class": (11, None, "embeddings", "label"),
    "objective_out_of_range": (8, None, "embeddings", "label"),
    "objective_ignore_index": (8, 7, "lineitem", "l_linenumber"),
    "objective_sparse": (64, None, "embeddings", "label"),
}


def objective_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objective.missing_classes(_table(spark, sf_dir, "lineitem"), 12, None, "l_linenumber")


def mixed_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third text gets a Cyrillic, every fifth a Greek letter."""
    d = _table(spark, sf_dir, "documents")
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "ж").otherwise(""), F.when(F.col("doc_id") % 5 == 0, "λ").otherwise(""))
    return d.select("doc_id", speech.mixed_scripts(text).alias("mixed"))


def unnormalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", speech.unnormalized(F.col("text")).alias("raw"))


def text_rate_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as transcripts of audio that is as long as the document's number makes it."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("chars"), (1 + F.col("doc_id") % 600).alias("seconds"))
    return speech.rate_outliers(d).select("n", F.round("median", 6).alias("median"), "outliers", F.col("worst.key").alias("worst_key"))


def preflight_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole preflight of a chat dataset without a tokenizer: its findings."""
    c = _table(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 7 == 0, " ").otherwise(F.col("text")).alias("content"))
    result = preflight.preflight(spark, c)
    return spark.createDataFrame([(result.verdict, f["id"], f["level"], re.sub(r" \(indices.*", "", f["evidence"])) for f in result.findings], "verdict string, id string, level string, evidence string")


# -- fleet


def choose_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files, line items as their records: which logs of a scan are judged, the newest 20 of those with records enough."""
    name = F.concat(F.col("o_orderkey").cast("string"), F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (F.col("o_orderkey") % len(_NAMES) + 1).cast("int")))
    files = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), name.alias("name"), F.col("o_orderdate").alias("mtime"))
    counts = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").alias("num_records"))
    return logs.choose_logs(files, counts, newest=20).select("run_id", "num_records", "judged")


_NAMES = [".jsonl", ".csv", ".log", ".txt", ".py", "tfevents.1", ".md", "-state.json"]


# -- sources: events written as logs of each format, read by the parsers


def _files(spark: SparkSession, sf_dir: str, line: Column, name: str, head: str = "", foot: str = "") -> DataFrame:
    """A text of one line for each event of a user, as a file."""
    e = _table(spark, sf_dir, "events").withColumn("k", F.expr("get_json_object(props, '$.k')"))
    rows = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", line.alias("line")))).alias("l"))
    text = F.concat(F.lit(head), F.array_join("l.line", ",\n" if name.endswith(".json") else "\n"), F.lit(foot))
    files = rows.select(F.col("user_id").alias("run_id"), F.lit(name).alias("name"), text.alias("text"))
    return files.withColumn("fmt", logs.detect_format(F.col("name"), F.col("text")))


def _parsed(files: DataFrame, *cols: str, **overrides: str) -> DataFrame:
    return logs.parse_text(files, overrides or None).select("run_id", "rec_idx", *cols)


def source_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with aliases and fields of no use, lines that are no object, objects without any known column."""
    good = F.concat(F.lit('{"Training_Loss": '), F.col("value").cast("string"), F.lit(', "iter": '), (F.col("event_id") % 100).cast("string"), F.lit(', "current_lr": "'), F.col("k"), F.lit('", "note": "x"}'))
    line = F.when(F.col("event_type") == "signup", "plain words").when(F.col("event_type") == "error", '{"epoch": 3}').when(F.col("event_id") % 11 == 0, "[1, 2]").otherwise(good)
    files = _files(spark, sf_dir, line, "a.jsonl").withColumn("fmt", F.lit("jsonl"))  # named by the user: a first line that is no object looks like CSV
    return _parsed(files, "step", "loss", "lr")


def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted cells, short rows, cells that are no number, a column named by the user."""
    row = F.concat((F.col("event_id") % 100).cast("string"), F.lit(',"'), F.col("value").cast("string"), F.lit('","a, b",'), F.col("k"))
    line = F.when(F.col("event_type") == "signup", F.concat((F.col("event_id") % 100).cast("string"), F.lit(",n/a"))).otherwise(row)
    return _parsed(_files(spark, sf_dir, line, "a.csv", head="Global_Step,Val_Loss,comment,mine\n"), "step", "eval_loss", "grad_norm", grad_norm="mine")


def source_hf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trainer's state: losses, evals, entries with neither, and the closing summary."""
    num = lambda key, c: F.concat(F.lit(f'"{key}": '), c.cast("string"))
    inner = F.when(F.col("event_type") == "purchase", num("eval_loss", F.col("value"))).when(F.col("event_type") == "signup", num("learning_rate", F.col("k"))).otherwise(num("loss", F.col("value")))
    line = F.concat(F.lit("{"), inner, F.lit(", "), num("step", F.col("event_id") % 100), F.lit("}"))
    return _parsed(_files(spark, sf_dir, line, "trainer_state.json", head='{"max_steps": 9, "log_history": [', foot=', {"train_runtime": 5.0, "loss": 1.0}]}'), "step", "loss", "eval_loss", "lr")


def source_coqui(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Console text with colours: a header and its lines for each event, some without a loss."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    loss = F.when(F.col("event_type") == "signup", "avg nothing").otherwise(F.concat(F.lit("\x1b[1m     | > loss: "), F.col("value").cast("string"), F.lit("  (0.5)\x1b[0m")))
    line = F.concat(F.lit("\x1b[4m   --> TIME: "), stamp, F.lit(" -- STEP: 1/9 -- GLOBAL_STEP: "), (F.col("event_id") % 100).cast("string"), F.lit("\x1b[0m\n"), loss, F.lit("\n     | > grad_norm: "), F.col("k"))
    return _parsed(_files(spark, sf_dir, line, "console.log", head=" > Start\n"), "step", "time", "loss", "grad_norm")


def source_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of documents under names and with texts of each kind."""
    pick = lambda xs, c: F.element_at(F.array(*[F.lit(x) for x in xs]), (c % len(xs) + 1).cast("int"))
    d = _table(spark, sf_dir, "documents").select("doc_id", pick(_DETECT_NAMES, F.col("doc_id")).alias("name"), F.concat(pick(_DETECT_TEXTS, F.expr("doc_id div 8")), F.col("text")).alias("text"))
    return d.select("doc_id", logs.detect_format(F.col("name"), F.col("text")).alias("fmt"))


_DETECT_NAMES = ["trainer_state.json", "x.json", "events.out.tfevents.7", "tfevents.py", "a.csv", "b.jsonl", "c.log", "d"]
_DETECT_TEXTS = ['{"log_history": [] ', "{", " > -- GLOBAL_STEP: 4 ", "a,b"]


def fleet_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by nation and seed, with subtotals."""
    r = reports(spark, sf_dir).select("run_id", "verdict", (F.col("run_id") % 3).alias("seed"), (F.col("run_id") % 25).alias("k"))
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), F.trim("n_name").alias("nation"))
    out = rollup.fleet_summary(r.join(n, F.col("k") == F.col("nk")), "nation", "seed")
    return out.select(F.coalesce("nation", F.lit("*")).alias("nation"), F.coalesce("seed", F.lit(-1)).alias("seed"), "runs", "fail", "warn", "not_checked", "pass")


def telemetry_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step times from the stream of one event type merged by step into the records of all."""
    r = log_records(spark, sf_dir).select("run_id", "rec_idx", "step", "loss", "gpu_util")
    t = log_records(spark, sf_dir).where("eval_loss is not null").select("run_id", "step", F.round("step_time", 6).alias("step_time"), F.lit(1.0).alias("gpu_util"))
    return merge_telemetry(r, t)


_RULE_NAMES = {r.id: "rule_" + r.id[3:].lower().replace("-", "_") for r in single_run.RULES}

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        series_stats, verdicts, verdicts_short, verdicts_healthy, verdicts_lineitem, checks_ran_skipped, worst_verdict, triage_order, bad_steps, checks_no_loss, throughput_rate,
        compare_metrics, compare_fleet, compare_own_baseline, compare_ranking, doctor_merge, json_column_resolution, alias_resolution, tag_normalise, claim_winner, fold_by_step,
        preflight_report, preflight_empty, preflight_duplicates, preflight_duplicates_conversations, preflight_context_overflow, preflight_extract_text, objective_missing, mixed_scripts, unnormalized_text,
        text_rate_outlier, choose_newest, source_jsonl, source_csv, source_hf, source_coqui, source_detect, fleet_rollup, telemetry_join,
    )
} | {f"exit_code{x}": _exit_code(v) for x, v in _EXITS.items()} | {f"verdicts_{v}": _verdicts_of(v) for v in ("no_loss", "steps_missing")} | {k: _objective(*v) for k, v in _OBJECTIVES.items()} | {_RULE_NAMES[r.id]: _rule_query(r) for r in single_run.RULES}

def _events(where: str, cols: str) -> str:
    """Records of the events that a parser keeps, numbered in each run."""
    return f"SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rec_idx, {cols} FROM (SELECT *, CAST(props->>'$.k' AS DOUBLE) AS k FROM events) WHERE {where}"


_R = {v: _records_sql("duck", v) for v in _VARIANTS}
_L = f"SELECT *, rec_idx::DOUBLE AS step FROM ({_LINEITEM})"

SQL: dict[str, str] = {
    "series_stats": oracle.stats(_R["mixed"]),
    "bad_steps": oracle.bad_steps(_R["mixed"]),
    **{f"verdicts_{v}" if v != "mixed" else "verdicts": oracle.verdicts(_R[v]) for v in ("mixed", "short", "healthy", "no_loss", "steps_missing")},
    "verdicts_lineitem": oracle.verdicts(_L),
    "checks_ran_skipped": oracle.checks(_R["mixed"]),
    "checks_no_loss": oracle.checks(_R["no_loss"]),
    "worst_verdict": oracle.worst(_R["mixed"]),
    **{f"exit_code{x}": oracle.exit_code(_R[v]) for x, v in _EXITS.items()},
    "triage_order": oracle.triage(_R["mixed"]),
    "throughput_rate": oracle.rate(_R["raw"]),
    "compare_metrics": oracle.compare_metrics(_R["mixed"]),
    "compare_fleet": oracle.compare_fleet(_R["mixed"]),
    "compare_own_baseline": oracle.compare_own(_R["mixed"]),
    "compare_ranking": oracle.compare_ranking(_R["mixed"]),
    "doctor_merge": oracle.doctor(_R["mixed"]),
    "fleet_rollup": oracle.fleet(_R["mixed"]),
    "json_column_resolution": "SELECT event_id, 'loss' AS canon, CAST(props->>'$.k' AS DOUBLE) AS v FROM events WHERE props->>'$.k' IS NOT NULL",
    "alias_resolution": f"WITH a AS (SELECT unnest({sorted(alias_map())!r}) AS name, unnest({[alias_map()[n] for n in sorted(alias_map())]!r}) AS canon), e AS (SELECT ({sorted(alias_map())!r})[event_id % {len(alias_map())} + 1] AS name FROM events) SELECT upper(name) AS name, count(*) AS n, canon FROM e JOIN a USING (name) GROUP BY ALL",
    "tag_normalise": f"WITH a AS (SELECT unnest({_TAGS!r}) AS tag, unnest(['loss', 'val_loss', 'loss', 'val_loss', 'lr', 'grad_norm', 'loss', 'val_loss', 'other_loss', 'lr']) AS name, unnest(['loss', 'eval_loss', 'loss', 'eval_loss', 'lr', 'grad_norm', 'loss', 'eval_loss', NULL, 'lr']) AS canon), e AS (SELECT ({_TAGS!r})[event_id % {len(_TAGS)} + 1] AS tag FROM events) SELECT tag, count(*) AS n, name, canon FROM e JOIN a USING (tag) GROUP BY ALL",
    "claim_winner": _WINNERS_SQL + "SELECT * FROM winners",
    "fold_by_step": _WINNERS_SQL
    + """, c AS (SELECT s.*, canon, min(seq) OVER (PARTITION BY s.run_id, canon) AS claim FROM scalars s JOIN winners USING (run_id, tag))
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 AS rec_idx, step::DOUBLE AS step, """
    + ", ".join(f"arg_max(value, seq) FILTER (canon = '{m}') AS {m}" for m in ("loss", "eval_loss", "lr", "grad_norm"))
    + ", round(arg_min(wall_time, (claim, seq)), 3) AS time FROM c GROUP BY run_id, step",
    "preflight_empty": "WITH d AS (SELECT doc_id, regexp_replace(text, '^[^.]*\\.\\s*', '') AS t FROM documents), b AS (SELECT doc_id FROM d WHERE trim(regexp_replace(t, '\\s+', ' ', 'g')) = '') SELECT (SELECT count(*) FROM b) AS n, coalesce((SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM b ORDER BY doc_id LIMIT 3)), '') AS first",
    "preflight_duplicates": "SELECT coalesce(sum(c - 1), 0)::BIGINT AS n, count(*) AS texts FROM (SELECT count(*) AS c FROM documents GROUP BY text HAVING count(*) > 1)",
    "preflight_duplicates_conversations": "SELECT coalesce(sum(c - 1), 0)::BIGINT AS n, count(*) AS texts FROM (SELECT count(*) AS c FROM conversations GROUP BY text HAVING count(*) > 1)",
    "preflight_context_overflow": "WITH t AS (SELECT len(regexp_split_to_array(text, '\\s+')) AS t FROM documents) SELECT count_if(t > 512)::BIGINT AS n, max(t)::BIGINT AS most FROM t",
    "preflight_extract_text": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN length(text) ELSE 0 END AS chars FROM conversations",
    "objective_missing": "SELECT c AS class FROM range(12) r(c) WHERE c NOT IN (SELECT l_linenumber FROM lineitem)",
    "mixed_scripts": "SELECT doc_id, (regexp_matches(text, '[a-zA-Z]')::INT + (doc_id % 3 = 0)::INT + (doc_id % 5 = 0)::INT) > 1 AS mixed FROM documents",
    "unnormalized_text": "SELECT doc_id, regexp_matches(text, '[0-9]') OR regexp_matches(text, '(^|[^\\p{L}])([A-Z]\\.){2,}') OR regexp_matches(text, '(^|[^\\p{L}])[A-Z]{2,5}($|[^\\p{L}])') AS raw FROM documents",
    "text_rate_outlier": f"WITH r AS (SELECT doc_id, n_chars / (1 + doc_id % 600)::DOUBLE AS rate FROM documents WHERE n_chars > 0), m AS (SELECT count(*) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY rate DESC) AS median FROM r), o AS (SELECT * FROM r, m WHERE (rate > median * {T.CHAR_RATE_RATIO} OR rate < median / {T.CHAR_RATE_RATIO}) AND n >= {T.CHAR_RATE_MIN_PAIRS} AND median > 0) SELECT m.n, round(m.median, 6) AS median, (SELECT count(*) FROM o) AS outliers, (SELECT doc_id FROM o ORDER BY abs(rate - median) DESC, doc_id DESC LIMIT 1) AS worst_key FROM m",
    "preflight_report": "WITH c AS (SELECT CASE WHEN turn % 7 = 0 THEN ' ' ELSE text END AS t FROM conversations), b AS (SELECT count(*) AS n FROM c WHERE trim(t) = ''), d AS (SELECT sum(k - 1)::BIGINT AS n, count(*) AS texts FROM (SELECT count(*) AS k FROM c GROUP BY t HAVING count(*) > 1)) SELECT CASE WHEN b.n > 0 THEN 'FAIL' WHEN d.n > 0 THEN 'WARN' ELSE 'PASS' END AS verdict, unnest(['TP-PRE-EMPTY-TEXT', 'TP-PRE-DUPLICATE-TEXT']) AS id, unnest(['FAIL', 'WARN']) AS level, unnest([b.n || ' records', d.n || ' duplicate records of ' || d.texts || ' distinct texts']) AS evidence FROM b, d",
    "choose_newest": f"WITH f AS (SELECT o_orderkey AS run_id, o_orderkey || ({_NAMES!r})[o_orderkey % 8 + 1] AS name, o_orderdate AS mtime FROM orders), n AS (SELECT run_id, mtime, (SELECT count(*) FROM lineitem WHERE l_orderkey = run_id) AS num_records FROM f WHERE regexp_matches(name, '(\\.(jsonl|csv|log|txt)$)|tfevents')), t AS (SELECT run_id FROM n WHERE num_records >= 3 ORDER BY mtime DESC, run_id LIMIT 20) SELECT run_id, num_records, run_id IN (SELECT run_id FROM t) AS judged FROM n",
    "source_jsonl": _events("event_type NOT IN ('signup', 'error') AND event_id % 11 <> 0", "(event_id % 100)::DOUBLE AS step, value AS loss, k AS lr"),
    "source_csv": _events("true", "(event_id % 100)::DOUBLE AS step, CASE WHEN event_type <> 'signup' THEN value END AS eval_loss, CASE WHEN event_type <> 'signup' THEN k END AS grad_norm"),
    "source_hf": _events("event_type <> 'signup'", "(event_id % 100)::DOUBLE AS step, CASE WHEN event_type <> 'purchase' THEN value END AS loss, CASE WHEN event_type = 'purchase' THEN value END AS eval_loss, NULL::DOUBLE AS lr"),
    "source_coqui": _events("event_type <> 'signup'", "(event_id % 100)::DOUBLE AS step, floor(epoch(ts))::DOUBLE AS time, value AS loss, k AS grad_norm"),
    "source_detect": f"""WITH d AS (SELECT doc_id, ({_DETECT_NAMES!r})[doc_id % 8 + 1] AS name, [{", ".join("'" + x + "'" for x in _DETECT_TEXTS)}][doc_id // 8 % 4 + 1] || text AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN name = 'events.out.tfevents.7' THEN 'tfevents' WHEN name = 'trainer_state.json' OR (name = 'x.json' AND contains(t, '"log_history"')) THEN 'hf' WHEN contains(t, '-- GLOBAL_STEP:') THEN 'coqui' WHEN name = 'a.csv' OR t[1] <> '{{' THEN 'csv' ELSE 'jsonl' END AS fmt FROM d""",
    "telemetry_join": f"WITH r AS ({_records_sql('duck', 'raw')}) SELECT run_id, rec_idx, step, loss, CASE WHEN eval_loss IS NOT NULL THEN 1.0 ELSE gpu_util END AS gpu_util, CASE WHEN eval_loss IS NOT NULL THEN round(step_time, 6) END AS step_time FROM r",
} | {k: _objective_sql(*v) for k, v in _OBJECTIVES.items()} | {n: oracle.rule(_R["mixed"], r) for r, n in _RULE_NAMES.items()}
