"""Checks of a speech corpus: transcripts by column expressions, audio in Arrow batches (PCM by the standard library)."""

from __future__ import annotations

import io
import os
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import thresholds as T

AUDIO_DDL = "path string, digest string, rate int, channels int, duration double, peak double, silence double, error string"


def mixed_scripts(text: Column) -> Column:
    """More than one of Latin, Cyrillic and Greek letters."""
    return (text.rlike(r"[a-zA-Z]").cast("int") + text.rlike(r"[Ѐ-ӿ]").cast("int") + text.rlike(r"[Ͱ-Ͽ]").cast("int")) > 1


def unnormalized(text: Column) -> Column:
    """What a reader would say in other words: digits (with them dates and times) and dotted or all-capital abbreviations."""
    return text.rlike(r"[0-9]") | text.rlike(r"(^|[^\p{L}])([A-Z]\.){2,}") | text.rlike(r"(^|[^\p{L}])[A-Z]{2,5}($|[^\p{L}])")


def longest_silence(x: np.ndarray) -> int:
    """Samples in the longest run of quiet ones."""
    loud = np.flatnonzero(np.abs(x) > T.SILENCE_AMPLITUDE)
    return int(np.diff(np.concatenate(([-1], loud, [len(x)]))).max() - 1) if len(x) else 0


def decode_wave(data: bytes) -> tuple[int, int, np.ndarray]:
    """(sample rate, channels, mono samples in -1..1) of PCM."""
    with wave.open(io.BytesIO(data)) as w:
        n, width, rate = w.getnchannels(), w.getsampwidth(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / (1 << (8 * width - 1))
    return rate, n, x.reshape(-1, n).mean(axis=1) if len(x) else x


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Path and content of the files that are there, one at a time, read where the task runs; paths are local ones or URIs."""
    from pyarrow import fs

    for pdf in batches:
        for path in pdf["path"]:
            try:
                where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))
                if where.get_file_info(name).type == fs.FileType.File:
                    with where.open_input_stream(name) as f:
                        yield pd.DataFrame({"path": [path], "content": [f.read()]})
            except (OSError, ValueError):  # no such file, or no such file system: missing
                continue


def analyse_audio(files: DataFrame) -> DataFrame:
    """files as of binaryFile -> AUDIO_DDL; files that can't be decoded have an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                row = {"path": path, "digest": hashlib.md5(data).hexdigest(), "rate": None, "channels": None, "duration": None, "peak": None, "silence": None, "error": None}
                try:
                    rate, n, x = decode_wave(data)
                    row |= {"rate": rate, "channels": n, "duration": len(x) / rate, "peak": float(np.abs(x).max()) if len(x) else 0.0, "silence": longest_silence(x) / rate}
                except Exception as e:  # whatever a broken file raises is the result
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=["path", "digest", "rate", "channels", "duration", "peak", "silence", "error"]).astype({"rate": "Int32", "channels": "Int32"})

    return files.select("path", "content").mapInPandas(run, AUDIO_DDL)


def rate_outliers(pairs: DataFrame) -> DataFrame:
    """pairs (key, chars, seconds) -> one row: n pairs, upper median of chars a second, outliers, worst key and its rate."""
    rates = pairs.where("seconds > 0 and chars > 0").select("key", (F.col("chars") / F.col("seconds")).alias("rate"))
    med = rates.agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY rate DESC)").alias("median"))
    out = (F.col("rate") > F.col("median") * T.CHAR_RATE_RATIO) | (F.col("rate") < F.col("median") / T.CHAR_RATE_RATIO)
    found = rates.crossJoin(F.broadcast(med)).where(out & (F.col("n") >= T.CHAR_RATE_MIN_PAIRS) & (F.col("median") > 0))  # one row
    worst = found.agg(F.count("*").alias("outliers"), F.max_by(F.struct("key", "rate"), F.struct(F.abs(F.col("rate") - F.col("median")), "key")).alias("worst"))
    return med.crossJoin(worst)


def read_corpus(spark: SparkSession, path: str) -> DataFrame | None:
    """(idx, audio, text) of a manifest or of a directory of .wav files with .txt beside them; None for anything else."""
    if path.endswith(".jsonl"):
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\n|\r")).alias("idx", "raw")).where("trim(raw) <> ''")
        m = F.from_json("raw", "map<string,string>", {"mode": "FAILFAST"})
        get = lambda a, b: F.coalesce(F.try_element_at(m, F.lit(a)), F.try_element_at(m, F.lit(b)), F.lit(""))
        return lines.select("idx", get("audio_filepath", "audio").alias("audio"), get("text", "transcript").alias("text"))
    if os.path.isdir(path):
        name = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
        files = lambda ext: spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").option("recursiveFileLookup", "true").load(path)
        wav = files("wav").select(name.alias("audio"))
        txt = files("txt").select(F.regexp_replace(name, "txt$", "wav").alias("w"), F.trim(F.decode("content", "UTF-8")).alias("text"))
        return wav.join(txt, wav["audio"] == txt["w"], "left").select(F.monotonically_increasing_id().alias("idx"), "audio", F.coalesce("text", F.lit("")).alias("text"))
    return None


def check_data(spark: SparkSession, path: str) -> dict:
    """Report of a corpus."""
    f = lambda id_, level, message, evidence="": {"id": f"TP-DATA-{id_}", "level": level, "message": message, "evidence": evidence}
    corpus = read_corpus(spark, path)
    if corpus is None:
        return {"verdict": "FAIL", "findings": [f("INVALID-INPUT", "FAIL", "Input is neither a .jsonl manifest nor a directory.", path)]}
    text = corpus.agg(
        F.count("*").alias("n"), F.count_if(F.col("text") == "").alias("empty"),
        F.count_if((F.col("text") != "") & unnormalized(F.col("text"))).alias("raw"), F.count_if(mixed_scripts(F.col("text"))).alias("mixed"),
        F.count_if(F.col("audio") != "").alias("audio"),
    ).first()
    if not text["n"]:
        return {"verdict": "FAIL", "findings": [f("NO-DATA", "FAIL", "No records found.", path)]}
    found = []
    if text["audio"]:
        named = corpus.where("audio <> ''").select("idx", "audio", F.length("text").alias("chars"))
        have = analyse_audio(named.select(F.col("audio").alias("path")).distinct().mapInPandas(_contents, "path string, content binary"))
        joined = named.withColumn("p", F.col("audio")).join(have, F.col("p") == have["path"], "left").cache()
        a = joined.agg(
            F.count_if(F.col("path").isNull()).alias("missing"), F.count_if(F.col("error").isNotNull()).alias("broken"),
            F.array_sort(F.collect_set("rate")).alias("rates"), F.array_sort(F.collect_set("channels")).alias("channels"),
            F.count_if(F.col("duration") > T.MAX_AUDIO_SEC).alias("long"), F.count_if(F.col("duration") < T.MIN_AUDIO_SEC).alias("short"),
            F.min("duration").alias("lo"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY duration DESC)").alias("mid"), F.max("duration").alias("hi"),
            (F.count("digest") - F.count_distinct("digest")).alias("dup"), F.count_if(F.col("peak") >= T.CLIP_PEAK).alias("clip"), F.count_if(F.col("silence") > T.MAX_SILENCE_SEC).alias("quiet"),
        ).first()
        out = rate_outliers(joined.select(F.col("audio").alias("key"), "chars", F.col("duration").alias("seconds"))).first()
        spread = "" if a["lo"] is None else f"min {a['lo']:.2f}s / median {a['mid']:.2f}s / max {a['hi']:.2f}s"
        found += [f("INCONSISTENT-SR", "FAIL", "Inconsistent sample rates found.", f"Rates: {a['rates']}")] * (len(a["rates"]) > 1)
        found += [f("INCONSISTENT-CHANNELS", "FAIL", "Inconsistent channel counts found.", f"Channels: {a['channels']}")] * (len(a["channels"]) > 1)
        found += [f("MISSING-AUDIO", "FAIL", "The manifest names audio files that don't exist.", f"{a['missing']} of {text['n']} records.")] * bool(a["missing"])
        found += [f("UNREADABLE-AUDIO", "WARN", "Audio files that can't be decoded.", f"{a['broken']} files.")] * bool(a["broken"])
    found += [f("EMPTY-TRANSCRIPT", "WARN", "Empty transcripts.", f"{text['empty']} of {text['n']} records.")] * bool(text["empty"])
    if text["audio"]:
        found += [f("DURATION-LONG", "WARN", "Very long audio files.", f"{a['long']} files > {T.MAX_AUDIO_SEC}s ({spread})")] * bool(a["long"])
        found += [f("DURATION-SHORT", "WARN", "Very short audio files.", f"{a['short']} files < {T.MIN_AUDIO_SEC}s ({spread})")] * bool(a["short"])
        found += [f("CHAR-RATE-OUTLIER", "WARN", "Transcripts whose length doesn't fit their audio.", f"{out['outliers']} records deviate >{T.CHAR_RATE_RATIO}x from median {out['median'] or 0:.1f} chars/sec")] * bool(out["outliers"])
        found += [f("DUPLICATES", "WARN", "Duplicate audio content detected.", f"{a['dup']} files have identical hashes.")] * bool(a["dup"])
        found += [f("CLIPPING", "WARN", "Audio clipping detected.", f"{a['clip']} files peak at {T.CLIP_PEAK} or more.")] * bool(a["clip"])
        found += [f("SILENCE", "WARN", "Excessive silence detected.", f"{a['quiet']} files are silent for over {T.MAX_SILENCE_SEC}s.")] * bool(a["quiet"])
    found += [f("UNNORMALIZED", "WARN", "Transcripts that aren't written as they are spoken.", f"{text['raw']} transcripts.")] * bool(text["raw"])
    found += [f("MIXED-SCRIPTS", "WARN", "Mixed character scripts in transcripts.", f"{text['mixed']} transcripts.")] * bool(text["mixed"])
    verdict = "FAIL" if any(x["level"] == "FAIL" for x in found) else "WARN" if found else "PASS"
    if verdict == "PASS":
        found.append(f("PASS", "PASS", "The corpus passed all checks.", f"Processed {text['n']} records."))
    return {"verdict": verdict, "findings": found}
