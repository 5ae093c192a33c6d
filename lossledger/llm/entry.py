"""Queries of this subpackage over the standard tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, katz, linededup, minhash, mixing, packing, quality, simple8b, syncmers, toxicity
from ._tables import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.encode_documents(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "epoch", "block_rank")


def op7_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp = syncmers.fingerprints(table(spark, sf_dir, "documents"))
    return fp.select("doc_id", F.array_join("positions", ",").alias("positions"), F.array_join("hashes", ",").alias("hashes"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"))


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_simple8b, op3_toxicity, op4_katz, op5_line_dedup, op6_mixing, op7_minhash_forest, op8_syncmers, op9_token_counts, op10_repetition)
}

SQL: dict[str, str] = {
    "op1_best_fit_packing": packing.SQL,
    "op4_katz": katz.SQL,
    "op5_line_dedup": linededup.SQL,
    "op6_mixing": mixing.SQL,
    "op8_syncmers": syncmers.SQL,
    "op10_repetition": quality.SQL,
}
