"""A training corpus from raw documents: five stages, each written as Parquet and read again for the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents, whatever
further ones there are. An empty table goes through all stages as an empty one. Rows with a null in any column, with empty or very long texts and
rows that repeat others are kept unless a stage's docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.llm import linededup, minhash, mixing, packing, toxicity
from lossledger.llm._tables import discard, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the induced lexicon doesn't reject.

    Null, empty and wordless texts are never rejected; a score equal to the threshold is; repeated rows go together; without a toxic label all stay.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line passages cut from all but their first place; documents that were nothing else go; n_chars follows the text.

    Null and empty texts and those of fewer than three lines stay as they are; rows of one id and text are cut alike.
    """
    return linededup.drop_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of the least id, with all rows of that id.

    Null ids and texts without words are groups of their own.
    """
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the tempered mixture of the sources takes them: once for each epoch.

    Null sources are a source; texts without tokens cost nothing and go with their block; rows that repeat others are taken together.
    """
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences.

    Long texts are cut into pieces; texts without tokens get a row of length 0 without a bin; rows that repeat an id are packed each on their own.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Lexicon induction, the LSH forest and best-fit packing have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, before, sf_dir))
        if k:
            discard(before)
        before = docs
    return docs
