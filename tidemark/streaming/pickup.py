"""Picking up response files that have landed since the last run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import KEYED, RESULT_SUFFIX, bad_results, file_key, good_results


def stream_results(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, DataFrame, int], None], files_a_batch: int = 10_000, keyed: bool = False, packed: bool = False) -> StreamingQuery:
    """Hands new files to ``sink(good, bad, batch id)`` and stops when all are done.

    The checkpoint remembers which files were seen, so that each run takes only new
    ones; ``sink`` gets a batch again if a run broke off inside it, under the same
    id. The source repeats the rows of files with brackets in their names; one row
    a file is kept, or each row of a pack once. Keys are read as by ``read_results``. With
    ``packed``, what is seen or new is a pack (``pack_responses``), so listings and
    checkpoint grow with the packs, not with the responses.
    """
    place = ["path", "row"] if packed else ["path"]

    def each(batch: DataFrame, number: int) -> None:
        files = batch.dropDuplicates(place).drop(*place)
        sink(good_results(files), bad_results(files), number)

    source = spark.readStream.schema(KEYED if keyed or packed else "value string").option("maxFilesPerTrigger", files_a_batch)
    path = F.col("_metadata.file_path").alias("path")
    if packed:
        files = source.parquet(f"{folder}/").select(path, F.col("_metadata.row_index").alias("row"), "file_key", "value")
    else:
        key = F.col("file_key") if keyed else file_key(RESULT_SUFFIX)
        files = source.option("wholetext", True).text(f"{folder}/").select(path, key.alias("file_key"), F.rtrim("value", F.lit("\n")).alias("value"))
    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What is written of good and bad files.
GOOD, BAD = "file_key string, annotation map<string, string>", "file_key string, value string, reason string"


def pick_up(spark: SparkSession, folder: str, checkpoint: str, out: str, keyed: bool = False, packed: bool = False) -> None:
    """Writes new good results to ``out/good`` and new bad ones to ``out/bad``, and waits. Without new files both are there, empty."""

    def write(good: DataFrame, bad: DataFrame, number: int) -> None:
        # A batch that comes again overwrites what it wrote before.
        good.write.mode("overwrite").parquet(f"{out}/good/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}/bad/batch={number}")

    for kind, schema in (("good", GOOD), ("bad", BAD)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/{kind}/batch=-1")
    stream_results(spark, folder, checkpoint, write, keyed=keyed, packed=packed).awaitTermination()


def read_picked_up(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) results of all runs that picked up into ``out``, each with its batch."""
    return tuple(spark.read.schema(f"{schema}, batch long").parquet(f"{out}/{kind}") for kind, schema in (("good", GOOD), ("bad", BAD)))
