"""Checks of a fine-tuning dataset, declared on columns: one aggregation for all counts, one for duplicates."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import thresholds as T
from ..sources.datasets import read_jsonl

TEXT_FIELDS = "text output content response completion".split()
BLANK_RE = r"^[\s\x1c-\x1f\x{85}\p{Z}]*$"


def extract_text(fields: Column, text_field: str | None = None) -> Column:
    """The text of a record from its map of fields: the named field, or the first known one that is there; else empty."""
    names = (text_field,) if text_field else TEXT_FIELDS
    out = None
    for n in names:
        has = F.map_contains_key(fields, n)
        out = F.when(has, F.try_element_at(fields, F.lit(n))) if out is None else out.when(has, F.try_element_at(fields, F.lit(n)))
    return F.coalesce(out, F.lit(""))


def empty_rows(texts: DataFrame) -> DataFrame:
    """texts (idx, text) -> one row: n and the first indices of blank texts."""
    blank = texts.where(F.coalesce(F.col("text").rlike(BLANK_RE), F.lit(True)))
    first = blank.orderBy("idx").limit(T.EVIDENCE_ROWS).agg(F.array_sort(F.collect_list("idx")).alias("first"))
    return blank.agg(F.count("*").alias("n")).crossJoin(first)


def duplicates(texts: DataFrame) -> DataFrame:
    """One row: records that repeat an earlier text exactly, and the distinct texts that are repeated."""
    groups = texts.groupBy(F.xxhash64("text").alias("h"), F.md5("text").alias("m")).agg(F.count("*").alias("c")).where("c > 1")
    return groups.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"), F.count("*").alias("texts"))


def context_overflow(texts: DataFrame, n_tokens: Column, max_len: int) -> DataFrame:
    """One row: texts of more than max_len tokens, and the most tokens of any."""
    return texts.select(n_tokens.alias("t")).agg(F.count_if(F.col("t") > max_len).alias("n"), F.coalesce(F.max("t"), F.lit(0)).cast("long").alias("most"))


def _f(id_: str, level: str, message: str, evidence: str = "") -> dict[str, str]:
    return {"id": id_, "level": level, "message": message, "evidence": evidence}


def check_special_tokens(tokenizer: Any) -> list[dict[str, str]]:
    """End, padding and start tokens of a tokenizer-like object."""
    get = lambda name: getattr(tokenizer, name, None)
    out = []
    eos, pad, bos = get("eos_token"), get("pad_token"), get("bos_token")
    if eos is None:
        out.append(_f("TP-PRE-MISSING-EOS-TOKEN", "FAIL", "no eos_token: training has no stop signal"))
    if pad is None:
        out.append(_f("TP-PRE-MISSING-PAD-TOKEN", "WARN", "no pad_token"))
    if eos is not None and pad is not None and get("eos_token_id") is not None and get("eos_token_id") == get("pad_token_id"):
        out.append(_f("TP-PRE-PAD-EQUALS-EOS", "WARN", "pad_token_id equals eos_token_id", f"Shared ID: {get('eos_token_id')}"))
    out.append(_f("TP-PRE-BOS-TOKEN-INFO", "INFO", "bos_token is present" if bos is not None else "no bos_token, as in many model families", "" if bos is None else str(bos)))
    return out


def dense_index(rows: DataFrame) -> DataFrame:
    """id of monotonically_increasing_id() as a dense idx: the place in the partition after the rows of the partitions before. No row is moved."""
    at = F.shiftright("id", 33)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    parts = rows.groupBy(at.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(F.broadcast(parts), at == F.col("part")).select((F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")).alias("idx"), *[c for c in rows.columns if c != "id"])


class PreflightResult:
    def __init__(self, verdict: str, findings: list[dict[str, str]]) -> None:
        self.verdict, self.findings = verdict, findings

    def raise_on_fail(self) -> None:
        if self.verdict == "FAIL":
            raise RuntimeError("Preflight FAIL. Findings: " + "; ".join(f["message"] for f in self.findings if f["level"] == "FAIL"))

    def print(self) -> None:
        from ..report.console import print_verdict

        print_verdict(self.verdict, self.findings)


def token_counter(tokenizer: Any) -> Callable[[Column], Column]:
    """Arrow-batched token counts of a tokenizer with encode(), or of a callable that returns input_ids."""
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        n = (lambda t: len(tokenizer.encode(t))) if hasattr(tokenizer, "encode") else (lambda t: len(tokenizer(t).get("input_ids", [])))
        return texts.fillna("").map(n)

    return count


def preflight(spark: SparkSession, source: str | Path | DataFrame, tokenizer: Any = None, max_len: int | None = None, text_field: str | None = None) -> PreflightResult:
    """source: a JSONL path, or a DataFrame with the record's columns."""
    found = []
    if isinstance(source, DataFrame):
        cols = [c for c in source.columns if c in ((text_field,) if text_field else TEXT_FIELDS)]
        text = F.coalesce(F.col(cols[0]).cast("string"), F.lit("None")) if text_field and cols else (F.coalesce(*[F.col(c).cast("string") for c in TEXT_FIELDS if c in cols], F.lit("None")) if cols else F.lit(""))
        texts = source.select(F.monotonically_increasing_id().alias("id"), text.alias("text"))
        texts = dense_index(texts)
    else:
        lines = read_jsonl(spark, str(source))
        bad = lines.where("malformed").agg(F.count("*").alias("n"), F.min("line_no").alias("first")).first()
        if bad["n"]:
            found.append(_f("TP-PRE-MALFORMED-JSONL", "FAIL", "JSONL parsing failed.", f"{bad['n']} broken lines. First bad line number: {bad['first']}"))
        texts = lines.where("not malformed").select("idx", extract_text(F.col("fields"), text_field).alias("text"))
    empty = empty_rows(texts).first()
    if empty["n"]:
        found.append(_f("TP-PRE-EMPTY-TEXT", "FAIL", "Empty or whitespace-only text found.", f"{empty['n']} records (indices {empty['first']}...)"))
    dup = duplicates(texts).first()
    if dup["n"]:
        found.append(_f("TP-PRE-DUPLICATE-TEXT", "WARN", "Exact duplicate text found.", f"{dup['n']} duplicate records of {dup['texts']} distinct texts"))
    if tokenizer is not None:
        found += check_special_tokens(tokenizer)
        if max_len is None:
            found.append(_f("TP-PRE-CONTEXT-CHECK-SKIPPED", "INFO", "give a maximal length to check contexts"))
        else:
            over = context_overflow(texts, token_counter(tokenizer)(F.col("text")), max_len).first()
            if over["n"]:
                found.append(_f("TP-PRE-CONTEXT-OVERFLOW", "WARN", f"Records exceed max context length of {max_len}", f"{over['n']} records overflow. Largest token count: {over['most']}"))
    levels = {f["level"] for f in found}
    verdict = "FAIL" if "FAIL" in levels else "WARN" if "WARN" in levels else "PASS"
    if verdict == "PASS":
        found.append(_f("TP-PRE-OK", "PASS", "Pre-flight checks passed."))
    return PreflightResult(verdict, found)
