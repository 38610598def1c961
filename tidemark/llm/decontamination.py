"""Benchmark decontamination with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, row_key, split_words

#: What lies between words: ASCII characters that are neither letters nor digits.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A window table of up to so many bytes is sent to every task.
BROADCAST_BYTES = 64 << 20


def normal_words(text: Column) -> Column:
    """Words of a text with A-Z in lower case, cut at ``GAPS``."""
    return split_words(lower_ascii(text), GAPS)


def windows(words: Column, length: int) -> Column:
    """All windows of ``length`` consecutive words, each joined by spaces."""
    starts = F.sequence(F.lit(1), F.size(words) - (length - 1))
    every = F.transform(starts, lambda i: F.array_join(F.slice(words, i, length), " "))
    return F.when(F.size(words) >= length, every).otherwise(F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, length: int = 10) -> DataFrame:
    """(window, span, item_id): the distinct windows of each item.

    An item of fewer words, but not none, is a single window of its own length.
    """
    items = benchmark.select("item_id", normal_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    whole = F.array(F.array_join("words", " "))
    cut = F.when(F.size("words") < length, whole).otherwise(windows(F.col("words"), length))
    return items.select("item_id", F.least(F.size("words"), F.lit(length)).alias("span"), F.explode(cut).alias("window")).distinct()


def window_hashes(hashes: Column, length: int) -> Column:
    """(start, span, h) for all windows of ``length`` consecutive words, from the words' hashes."""
    starts = F.sequence(F.lit(1), F.size(hashes) - (length - 1))
    every = F.transform(starts, lambda i: F.struct((i - 1).alias("start"), F.lit(length).alias("span"), F.xxhash64(F.slice(hashes, i, length)).alias("h")))
    return F.when(F.size(hashes) >= length, every).otherwise(F.array().cast("array<struct<start: int, span: int, h: bigint>>"))


def find_hits(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """(k1, k2, start, span, item_id) for every place where an item's window occurs.

    Documents are read once, whatever lengths the items have: words are hashed once, and the windows
    of their hashes are looked up in a hash set of all items' windows. Where one is
    found, its words are compared with the item's, so a hash that two windows share
    does no harm. The set is broadcast if it measures less than ``BROADCAST_BYTES``, and
    else dealt out with the documents' windows.
    """
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    wanted = item_windows(benchmark, length).withColumn("h", F.xxhash64(hashed(F.split("window", " "))))
    measured = wanted.groupBy("span").agg(F.sum(F.octet_length("window") + 48).alias("size")).collect()  # a row for each span, ten at most
    if sum(r["size"] for r in measured) <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    rows = docs.select(*row_key(F.col("doc_id"), F.col("text")), normal_words(F.col("text")).alias("words"))
    rows = rows.withColumn("hashes", hashed(F.col("words")))
    spans = sorted(r["span"] for r in measured) or [length]
    places = rows.select("k1", "k2", "words", F.explode(F.concat(*(window_hashes(F.col("hashes"), span) for span in spans))).alias("x")).select("k1", "k2", "words", "x.*")
    same = F.array_join(F.slice("words", F.col("start") + 1, F.col("span")), " ") == F.col("window")
    return places.join(wanted, ["span", "h"]).filter(same).select("k1", "k2", "start", "span", "item_id")


def covered(hits: Column) -> Column:
    """The distinct word positions inside an array of (start, span)."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["span"] - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """For each document what it shares with the benchmark.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the
    positions of the words that were hit, ``hit`` (from 0). Null texts, empty
    ones and an empty benchmark give no hits; repeated rows each get their
    result; items without words, and null items, never occur; an item whose id is
    null counts for its words but not as an item. Only doc_id, text and item_id
    are read, whatever other columns there are.
    """
    marks = (
        find_hits(docs, benchmark, length).groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("start", "span")).alias("hits"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
        .select("k1", "k2", F.sort_array(covered(F.col("hits"))).alias("hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"))
    )
    rows = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), F.size(normal_words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce(F.size("hit").cast("long"), F.lit(0).cast("long"))
    return rows.join(marks, ["k1", "k2"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("hit", F.array().cast("array<int>")).alias("hit"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """``docs`` without the documents in which a window of the benchmark occurs.

    Null and empty texts have no windows and stay; repeated rows share their fate, rows
    without an id are told apart by their texts. Columns stay as they are.
    """
    bad = find_hits(docs, benchmark, length).select("k1", "k2").distinct()
    keys = ["__k1", "__k2"]
    named = docs.withColumns(dict(zip(keys, row_key(F.col("doc_id"), F.col("text")), strict=True)))
    return named.join(bad.toDF(*keys), keys, "left_anti").drop(*keys)


def remove_spans(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """``docs`` with the words that were hit taken out of their texts.

    A text with hits becomes its other normalised words, joined by one space; a
    text without hits, null and empty ones included, is left as it is. Repeated rows
    are treated alike.
    """
    hits = find_hits(docs, benchmark, length).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "span")).alias("hits"))
    keys = ["__k1", "__k2"]
    marks = hits.select(F.col("k1").alias(keys[0]), F.col("k2").alias(keys[1]), covered(F.col("hits")).alias("__hit"))
    words = normal_words(F.col("text"))
    left = F.transform(F.array_except(F.transform(words, lambda w, i: i), F.col("__hit")), lambda i: F.element_at(words, i + 1))
    named = docs.withColumns(dict(zip(keys, row_key(F.col("doc_id"), F.col("text")), strict=True)))
    text = F.when(F.col("__hit").isNull(), F.col("text")).otherwise(F.array_join(left, " "))
    return named.join(marks, keys, "left").withColumn("text", text).drop(*keys, "__hit")
