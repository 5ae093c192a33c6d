"""Checks of a tokenizer on transcripts: unknown pieces, tokens a second of audio, and numbers that fall apart."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import thresholds as T

NUMBER_RE = r"\b\d+\b"


def numbers(text: Column) -> Column:
    """Digit runs that stand as words."""
    return F.regexp_extract_all(text, F.lit(rf"({NUMBER_RE})"), 1)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(text, duration) of each line: the fields of a JSON object, or the line itself; blank lines have null text."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", r"[\r\n]+$", ""), r"\r\n|\n|\r")).alias("line"))
    m = F.when(F.col("line").startswith("{"), F.from_json("line", "map<string,string>"))
    get = lambda k: F.try_element_at(m, F.lit(k))
    own = F.when(m.isNotNull() & F.try_parse_json("line").isNotNull(), F.coalesce(F.nullif(get("text"), F.lit("")), get("transcript"), F.lit(""))).otherwise(F.col("line"))
    return lines.select(F.when(F.trim("line") != "", own).alias("text"), F.coalesce(F.when(F.trim("line") != "", get("duration").try_cast("double")), F.lit(0.0)).alias("duration"))


def count_pieces(texts: DataFrame, model_path: str) -> DataFrame:
    """texts (text, duration) -> pieces, unknown, splits, duration; the model is read once by each worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                pieces = sp.encode_as_pieces(text)
                known = [sp.is_unknown(i) for i in sp.encode(text)]
                bad = sum(len(sp.encode_as_pieces(n)) > len(n) / 2 + 1 for n in re.findall(NUMBER_RE, text))
                rows.append((len(pieces), sum(known), bad))
            out = pd.DataFrame(rows, columns=["pieces", "unknown", "splits"])
            yield out.assign(duration=pdf["duration"].to_numpy())

    return texts.mapInPandas(run, "pieces long, unknown long, splits long, duration double")


def judge(pieces: int, unknown: int, splits: int, duration: float, lines: int) -> dict:
    f = lambda id_, level, message, evidence: {"id": f"TP-TOK-{id_}", "level": level, "message": message, "evidence": evidence}
    rate, found = unknown / max(1, pieces), []
    if rate > T.MAX_OOV:
        found.append(f("HIGH-OOV", "FAIL", "Many pieces are out of vocabulary.", f"{rate * 100:.3f}% > {T.MAX_OOV * 100:.3f}%"))
    if 1 - rate < T.MIN_COVERAGE:
        found.append(f("LOW-COVERAGE", "WARN", "Vocabulary coverage is low.", f"{(1 - rate) * 100:.3f}% < {T.MIN_COVERAGE * 100:.3f}%"))
    if duration > 0 and pieces / duration > T.MAX_TOKENS_PER_SEC:
        found.append(f("HIGH-TPS", "WARN", "Many tokens a second of audio.", f"{pieces / duration:.1f} tokens/sec > {T.MAX_TOKENS_PER_SEC}"))
    if splits > lines * T.MAX_SPLIT_SHARE:
        found.append(f("SUSPICIOUS-SPLIT", "WARN", "Numbers fall into many pieces.", f"{splits} instances."))
    verdict = "FAIL" if any(x["level"] == "FAIL" for x in found) else "WARN" if found else "PASS"
    if verdict == "PASS":
        found.append(f("PASS", "PASS", "Vocabulary coverage and splits look healthy.", f"{pieces} tokens evaluated."))
    return {"verdict": verdict, "findings": found}


def check_tokenizer(spark: SparkSession, model_path: str, transcripts: str) -> dict:
    """Report; verdict None where nothing could be judged (a missing library, model or file)."""
    fail = lambda id_, message, evidence: {"verdict": None, "findings": [{"id": f"TP-TOK-{id_}", "level": "FAIL", "message": message, "evidence": evidence}]}
    try:
        import sentencepiece
    except ImportError:
        return fail("SPM-MISSING", "The sentencepiece library is missing.", "")
    try:
        sentencepiece.SentencePieceProcessor(model_file=model_path)
    except Exception as e:  # any failure to load is the finding
        return fail("LOAD-FAIL", "The model can't be loaded.", f"{model_path}: {e}")
    if not os.path.exists(transcripts):
        return fail("NO-TRANSCRIPTS", "Transcripts file not found.", transcripts)
    lines = read_transcripts(spark, transcripts)
    n = lines.count()
    sums = count_pieces(lines.where("text is not null"), model_path).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pieces", "unknown", "splits", "duration")]).first()
    return judge(sums["pieces"], sums["unknown"], sums["splits"], sums["duration"], n)
