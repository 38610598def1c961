"""Token counts with a digest cache."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import encoder

CACHE = "digest binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Names a version of a tokenizer: SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an empty table is written where there is none yet."""
    spark.createDataFrame([], CACHE).write.mode("append").parquet(path)
    return spark.read.schema(CACHE).parquet(path)


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """Tokens of every whole text of ``docs(doc_id, text)``.

    A text's digest (SHA-256 of its UTF-8 bytes) and the tokenizer's are looked
    up in the cache. Distinct texts without a stored count are encoded, once
    each, and appended to it; then every row gets its count from the cache. The
    texts move once, dealt by digest: copies are merged before and after that,
    so that a text held by a third of all rows is one row of each task.

    Returns doc_id, n_bytes, n_tokens, over_limit. Null and empty texts have no
    bytes and no tokens. Repeated rows and null ids are kept as they are; other
    columns of ``docs`` play no part. A cache row that two runs wrote at the same
    time counts once.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
    known = open_cache(spark, cache_path).filter(F.col("tokenizer") == version)
    texts = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text")).filter("text <> ''")
    # Spark merges equal digests in each task before it deals them out.
    misses = texts.dropDuplicates(["digest"]).join(known.select("digest").hint("shuffle_merge"), "digest", "left_anti")

    def encode(batches):
        count = encoder(tokenizer_path)
        width = np.dtype(count.dtype).itemsize
        for batch in batches:
            yield pd.DataFrame({"digest": batch["digest"], "tokenizer": version, "n_tokens": [len(count.encode(t)) // width for t in batch["text"]]})

    misses.mapInPandas(encode, CACHE).write.mode("append").parquet(cache_path)
    spark.catalog.refreshByPath(cache_path)
    counts = open_cache(spark, cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    found = rows.join(counts, "digest", "left")
    n_tokens = F.when(F.col("n_bytes") == 0, F.lit(0).cast("long")).otherwise(F.col("n_tokens"))
    return found.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
