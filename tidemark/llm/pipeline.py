"""The stages of the corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, BPE ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, near_dedup, substring_dedup, toxicity
from .common import shared_dir

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, with all columns as they are.

    Null and empty texts have no evidence against them and stay, unless toxic
    labels are the rule. Repeated rows share their fate; rows without an id are
    judged by their text as well.
    """
    return toxicity.reject_toxic(docs, _table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates, with all columns as they are.

    Texts that are null or have no words are nobody's copy. Of rows that repeat
    both id and text one stays; rows without an id all stay.
    """
    return near_dedup.keep_representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; texts with repeated passages keep their other words, joined by one space.

    ``n_chars``, if there is such a column, follows where the text changed. All
    else, null and shorter texts included, stays as it is. Repeated rows are copies
    of each other.
    """
    column = "__repeats"
    found = substring_dedup.remove_repeats(docs, column=column)
    changed = F.col(f"{column}.n_removed") > 0
    new = {"text": F.when(changed, F.col(f"{column}.kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(f"{column}.kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(new).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs, with all columns as they are.

    Null and empty texts have no windows and stay; repeated rows share their fate.
    """
    return decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the number and digests of its ids and of their decoded text.

    Null texts are encoded as empty ones. Columns named n_tokens, ids_sha256 or
    decoded_sha256 are replaced.
    """
    return bpe.round_trip(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: SQL can express neither the learned models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each to what the one before wrote.

    An empty table goes through all stages; extra columns reach the end.
    """
    docs = _table(spark, sf_dir, "documents")
    folder = shared_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
