"""Helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space between words: space, and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Tables of up to so many bytes are sent to every task.
BROADCAST_BYTES = 64 << 20


def lower_ascii(col: Column) -> Column:
    """``col`` with A-Z in lower case, other letters unchanged."""
    return F.translate(col, UPPER, LOWER)


def split_words(col: Column, gaps: str = SPACES) -> Column:
    """The words of a text between ``gaps``; a null text has none."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), gaps), lambda w: w != "")


def word_hashes(col: Column) -> Column:
    """One 64-bit hash for each word of a text, in order."""
    return F.transform(split_words(col), lambda w: F.xxhash64(w))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two longs that rows share only if they have the same id and text.

    What an operator finds out about a text is joined back on these, so that
    repeated rows and rows without an id each get their result.
    """
    return [F.coalesce(doc_id.cast("long"), F.lit(0)).alias("k1"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("k2")]


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % by


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that all executors can reach, below ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder stands in in a local session; any other raises.
    """
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, set for ``DataFrame.checkpoint`` too."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors reach")
        base = tempfile.mkdtemp(prefix="spark-")
    if not known.isDefined():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def gather(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df``, a table of a few longs, settled and read in as few parts as have about ``rows`` rows each.

    A small one is a single part, in which Spark joins and groups without a
    shuffle; one of ``BROADCAST_BYTES`` at most is marked for broadcast.
    """
    settled = settle(df)
    n = settled.count()
    parts = settled.coalesce(n // rows + 1)
    return F.broadcast(parts) if n * 8 * len(df.columns) <= BROADCAST_BYTES else parts


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets at most ``rows`` texts go to Python at a time, unless the session says otherwise.

    Spark bounds a batch by 64 MB too, but ten thousand texts of a few kB, with their
    words and hashes beside them in each of an executor's workers, were beyond its memory
    (measured: 3,133 MB with two cores). The setting stays, since results are lazy and
    it has to hold when they are read.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) in (None, "10000"):  # Spark's default is made for short rows
        spark.conf.set(name, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows of ``counts`` with the highest counts, ``most`` at most.

    A histogram with eight bins to a doubling tells from which bin on they are few
    enough, so that no task and no driver sorts what is left out; rows of the last
    bin that would be too many all stay out.
    """
    place = F.floor(F.log2(F.col(n).cast("double")) * 8).cast("int")
    bins = counts.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("bin")).collect()  # a few hundred rows
    total, lowest = 0, None
    for b in bins:
        total += b["rows"]
        if total > most:
            break
        lowest = b["bin"]
    return counts.filter(place >= lowest) if lowest is not None else counts.filter(F.lit(False))


def narrow(df: DataFrame) -> DataFrame:
    """``df``, a table of a few longs, marked for broadcast if it measures little enough."""
    return F.broadcast(df) if df.count() * 8 * len(df.columns) <= BROADCAST_BYTES else df
