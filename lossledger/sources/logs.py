"""Training logs of any text format, any number of files in one job, as canonical records.

Files are read whole (a log is small beside a split; the order of its lines matters), each row is a file until its lines are exploded, and
formats are told apart by name and content. Nothing is shuffled but the records, which are numbered in their file.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import ANSI_RE, LINE_RE, OTHER_BREAKS, as_float, canonical
from ..schema import METRICS, RUN_META

FORMATS = ("auto", "hf", "coqui", "csv", "jsonl", "tfevents")
_NOT_EVENTS_RE = r"(?i)\.(py|md|txt|jsonl?|csv|ya?ml|log|rst|toml)$"


def path_column() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")


def is_event_file(name: Column) -> Column:
    return name.contains("tfevents") & ~name.rlike(_NOT_EVENTS_RE)


def is_log_name(name: Column) -> Column:
    """Names that a directory scan takes for logs."""
    return (name == "trainer_state.json") | name.contains("tfevents") | name.rlike(r"\.(jsonl|csv|log|txt)$")


def read_files(spark: SparkSession, paths: str | list[str], fmt: str = "auto") -> DataFrame:
    """(run_id, name, mtime, size, fmt, text) of text files; directories are walked."""
    raw = spark.read.option("recursiveFileLookup", "true").text([paths] if isinstance(paths, str) else paths, wholetext=True)
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    files = raw.select(path_column().alias("run_id"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"), text.alias("text"))
    return files.withColumn("fmt", F.lit(fmt) if fmt != "auto" else detect_format(F.col("name"), F.col("text")))


def detect_format(name: Column, text: Column) -> Column:
    return (
        F.when(is_event_file(name), "tfevents")
        .when((name == "trainer_state.json") | (name.endswith(".json") & text.contains('"log_history"')), "hf")
        .when(text.contains("-- GLOBAL_STEP:"), "coqui")
        .when(name.endswith(".csv") | ((text != "") & ~text.startswith("{")), "csv")
        .otherwise("jsonl")
    )


def _plain_json(text: Column) -> Column:
    """Booleans as the numbers that they convert to."""
    for word, number in (("true", "1.0"), ("false", "0.0")):
        text = F.regexp_replace(text, rf"(?<=:)\s*{word}(?=\s*[,}}])", number)
    return text


#: A number, quoted or not, that needs no more than its quotes taken off.
_SIMPLE_RE = r'^"?[+-]?\d+(\.\d+)?"?\z'


def _number(x: Column, bare: Callable[[Column], Column] = lambda x: x) -> Column:
    """float() of a text without its quotes (as `bare` leaves them); most numbers take one look."""
    return F.when(x.rlike(_SIMPLE_RE), F.replace(x, F.lit('"'), F.lit("")).try_cast("double")).otherwise(as_float(F.regexp_replace(bare(x), '^"|"$', "")))


def _entry(key: Column, v: Column, overrides: dict[str, str] | None) -> Column:
    """(canon, v, col) of a key and a number, null where the key doesn't resolve; the number isn't looked at then."""
    canon = canonical(key, overrides)
    return F.when(canon.isNotNull(), F.struct(canon.alias("canon"), v.alias("v"), key.alias("col")))


def _entries(pairs: Column, overrides: dict[str, str] | None) -> Column:
    """Array of (key, value) texts -> array of (canon, v, col), only what resolves and converts, in order."""
    return _converted(F.transform(pairs, lambda e: _entry(F.trim(e["key"]), _number(e["value"]), overrides)))


def _converted(entries: Column) -> Column:
    return F.filter(entries, lambda e: e["v"].isNotNull())


def _hf(m: Column, overrides: dict[str, str] | None) -> Column:
    """An entry of a trainer state's log_history; the closing summary is none."""
    return F.when(~F.map_contains_key(m, "train_runtime"), _entries(F.map_entries(m), overrides))


def run_meta(files: DataFrame) -> DataFrame:
    """What a trainer-state file declares at its top level."""
    ddl = "struct<" + ",".join(f"{k}:string" for k in RUN_META) + ">"
    return files.where("fmt = 'hf'").select("run_id", F.from_json("text", ddl).alias("run_meta"))


def _jsonl(line: Column, overrides: dict[str, str] | None) -> Column:
    """JSON objects, one a line; lines that aren't objects are skipped."""
    return F.when(line.rlike(r"(?s)^\{.*\}$"), _entries(F.map_entries(F.from_json(_plain_json(line), "map<string,string>")), overrides))


def _cells(line: Column) -> Column:
    return F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')


def _bare_cell(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r'^\s*"|"\s*$', ""), '""', '"')


def _csv_head(line: Column, overrides: dict[str, str] | None) -> Column:
    """Array of (canon, col), one for each column."""
    return F.transform(F.transform(_cells(line), lambda x: F.trim(_bare_cell(x))), lambda x: F.struct(canonical(x, overrides).alias("canon"), x.alias("col")))


def _csv(head: Column, line: Column) -> Column:
    """Comma-separated with a header; short rows miss values, surplus values are ignored."""
    entry = lambda h, x: F.when(h["canon"].isNotNull(), F.struct(h["canon"].alias("canon"), _number(x, _bare_cell).alias("v"), h["col"].alias("col")))
    return _converted(F.zip_with(head, _cells(line), entry))


def _sections(text: Column) -> Column:
    """Console text before the first header and from each header to the next; a header is a line with time and step."""
    return F.split(F.concat(F.lit("\n"), text), r"(?d)\n(?=[ \t]*--> TIME:.*-- GLOBAL_STEP:)")


def _coqui(header: Column, section: Column, overrides: dict[str, str] | None) -> Column:
    """A record of a console log: its header has time and step, lines `| > key: value` the rest."""
    stamp = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(F.regexp_extract(header, r"TIME:\s*(\d[\d-]*\s+\d[\d:]*)", 1), r"\s", " "), F.lit("yyyy-MM-dd HH:mm:ss"))).cast("double")
    step = F.regexp_extract(header, r"GLOBAL_STEP:\s*(\d+)", 1).try_cast("double")
    fields = F.regexp_extract_all(section, F.lit(r"(?dm)^[ \t]*\| > (.*)"), F.lit(1))
    pairs = F.transform(fields, lambda x: F.struct(F.substring_index(x, ":", 1).alias("key"), F.regexp_extract(x, r"^[^:]*:\s*([^:\s]*)", 1).alias("value")))
    return F.concat(_converted(F.array(_entry(F.lit("time"), stamp, overrides), _entry(F.lit("step"), step, overrides))), _entries(pairs, overrides))


def parse_text(files: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Records of text logs of all formats: run_id, rec_idx, the metrics, and cols (which column gave which metric).

    One pass for all formats: a file is read and told apart once, and its lines (sections, entries of a history) are rows from there on. What is
    used more than once is a column of its own, so that it's evaluated once. Rows without a record leave after they are numbered: a filter
    before would be pushed below and evaluate the entries again.
    """
    of = lambda name: F.col("fmt") == name
    none = lambda kind: F.array().cast(f"array<{kind}>")
    clean = F.when(of("coqui"), F.regexp_replace("text", ANSI_RE, "")).otherwise(F.col("text"))
    read = files.select("run_id", "fmt", "text", clean.alias("clean"))
    rare = reduce(or_, [F.col("clean").contains(c) for c in OTHER_BREAKS])  # much cheaper than to look for all breaks by pattern
    lined = F.when(rare, F.regexp_replace("clean", LINE_RE, "\n")).otherwise(F.col("clean"))
    read = read.select("run_id", "fmt", "text", lined.alias("lined"))
    texts = F.when(of("csv"), F.array_remove(F.split("lined", "\n"), "")).when(of("jsonl"), F.split("lined", "\n")).when(of("coqui"), _sections(F.col("lined"))).otherwise(none("string"))
    history = F.from_json(_plain_json(F.col("text")), "log_history array<map<string,string>>")["log_history"]
    maps = F.when(of("hf"), history).otherwise(none("map<string,string>"))
    split = read.select("run_id", "fmt", texts.alias("texts"), maps.alias("maps"))
    rest = F.when(of("csv"), F.slice("texts", F.lit(2), F.size("texts"))).otherwise(F.col("texts"))
    head = F.when(of("csv"), _csv_head(F.get("texts", F.lit(0)), overrides))
    items = split.select("run_id", "fmt", head.alias("head"), F.arrays_zip(rest.alias("text"), F.col("maps").alias("m")).alias("items"))
    rows = items.select("run_id", "fmt", "head", F.posexplode_outer("items").alias("pos", "item"))  # outer, or a filter on the size is inferred and splits the text again
    text = F.when(of("jsonl"), F.regexp_replace("item.text", r"^\s+|\s+$", "")).otherwise(F.col("item.text"))
    header = F.when(of("coqui"), F.regexp_extract("item.text", r"(?d)^[ \t]*(--> TIME:.*-- GLOBAL_STEP:.*)", 1))
    rows = rows.select("run_id", "fmt", "head", "pos", text.alias("text"), "item.m", header.alias("header"))
    t, m = F.col("text"), F.col("m")
    entries = F.when(of("csv"), _csv(F.col("head"), t)).when(of("jsonl"), _jsonl(t, overrides)).when(of("coqui"), _coqui(F.col("header"), t, overrides)).when(of("hf"), _hf(m, overrides))
    last = lambda name: F.try_element_at(F.filter("entries", lambda e: e["canon"] == name), F.lit(-1))["v"].alias(name)
    made = rows.select("run_id", "fmt", "pos", entries.alias("entries")).select("run_id", "fmt", "pos", "entries", *[last(name) for name in METRICS])
    keep = F.when(of("hf") | of("coqui"), F.col("loss").isNotNull() | F.col("eval_loss").isNotNull()).otherwise(F.size("entries") > 0)
    cols = F.transform("entries", lambda e: F.struct(e["canon"].alias("canon"), e["col"].alias("col"))).alias("cols")
    upto = Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = made.select("run_id", "pos", F.coalesce(keep, F.lit(False)).alias("keep"), *METRICS, cols).withColumn("rank", F.count_if("keep").over(upto))
    return ranked.where("keep").select("run_id", (F.col("rank") - 1).alias("rec_idx"), *METRICS, "cols")


def used_mapping(records: DataFrame) -> DataFrame:
    """(run_id, mapping): for each metric the column that last gave it."""
    c = records.select("run_id", "rec_idx", F.posexplode("cols").alias("i", "c"))
    last = c.groupBy("run_id", "c.canon").agg(F.max_by("c.col", F.struct("rec_idx", "i")).alias("col"))
    return last.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("canon", "col")))).alias("mapping"))


def read_logs(spark: SparkSession, paths: str | list[str], fmt: str = "auto", overrides: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, files): canonical records of every log under the paths, and the files with format, size and time.

    Files of no format, empty and broken files have no records; they stay in `files`, so that nobody takes them for judged.
    """
    if fmt not in FORMATS:
        raise ValueError(f"Unknown format: {fmt}")
    files = read_files(spark, paths, fmt)
    records = parse_text(files, overrides)
    if fmt in ("auto", "tfevents"):
        from .tfevents import read_event_records

        events = read_event_records(spark, paths, overrides, named=fmt == "auto")
        records = records.unionByName(events)
    return records, files


def choose_logs(files: DataFrame, counts: DataFrame, newest: int | None = None, least: int = 3) -> DataFrame:
    """files (run_id, name, mtime, ..) of log names with num_records from counts, and judged: at least `least` records, the newest ones if a number is given."""
    files = files.where(is_log_name(F.col("name"))).join(counts, "run_id", "left").fillna(0, ["num_records"])
    ok = F.col("num_records") >= least
    if newest is None:
        return files.withColumn("judged", ok)
    top = files.where(ok).orderBy(F.desc("mtime"), "run_id").limit(newest).select("run_id", F.lit(True).alias("judged"))  # a top-k, merged from each partition's
    return files.join(F.broadcast(top), "run_id", "left").fillna(False, ["judged"])


def discover(spark: SparkSession, directory: str, overrides: dict[str, str] | None = None, newest: int | None = None, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Logs under a directory: (records, files) of those with at least `least` records, the newest ones if a number is given.

    files has a column `judged`; files with fewer records are in it with judged = false.
    """
    records, files = read_logs(spark, directory, "auto", overrides)
    files = choose_logs(files.drop("text"), records.groupBy("run_id").agg(F.count("*").alias("num_records")), newest, least)
    return records.join(files.where("judged").select("run_id"), "run_id", "left_semi"), files
