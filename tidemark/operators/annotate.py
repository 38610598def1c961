"""Annotation: finding work, rendering prompts, running a model, reading responses."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_list, strip
from ..schemas import SOUND_ONLY, Profile

#: Calls that a task has under way at once.
CALLS = 16


def pending(metadata: DataFrame, results: DataFrame, key: str = "file_key") -> DataFrame:
    """A1: metadata without a result yet."""
    return metadata.join(results.select(key).distinct(), key, "left_anti")


def eligible(metadata: DataFrame, media: DataFrame, key: str = "file_key") -> DataFrame:
    """A2: metadata with the column ``reason``, null if the post can be annotated.

    Else it says why not: no extension, sound only, or no media file under the key
    and extension in ``media(key, ext)``.
    """
    files = media.select(key, "ext", F.lit(True).alias("__there")).distinct()
    reason = F.when(F.col("ext").isNull(), "no extension").when(F.col("ext").isin(*SOUND_ONLY), "sound only").when(F.col("__there").isNull(), "no media file")
    return metadata.join(files, [key, "ext"], "left").withColumn("reason", reason).drop("__there")


def render_prompt(df: DataFrame, template: str, defaults: Mapping[str, str] | None = None) -> DataFrame:
    """A3: adds ``prompt``, the template with each ``{column}`` filled in.

    Absent and null fields get their default, or blank.
    """
    defaults = defaults or {}
    parts = re.split(r"\{(\w+)\}", template)
    filled = [F.lit(p) if i % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit(defaults.get(p, ""))) if p in df.columns else F.lit(defaults.get(p, "")) for i, p in enumerate(parts)]
    return df.withColumn("prompt", F.concat(*filled))


def _ask(infer: Callable[[str], str], prompt: str, max_attempts: int, pause: float) -> tuple[str | None, int, str | None]:
    """(response, attempts, error) of one prompt, with pauses that double between attempts."""
    error = None
    for attempt in range(1, max_attempts + 1):
        try:
            text = infer(prompt).replace("```json", "").replace("```", "").strip()
            json.loads(text)
            return text, attempt, None
        except Exception as e:  # any failure of the model is the row's, not the job's
            error = f"{type(e).__name__}: {e}"
        if pause and attempt < max_attempts:
            time.sleep(pause * 2 ** (attempt - 1))
    return None, max_attempts, error


def annotate(df: DataFrame, infer: Callable[[str], str], max_attempts: int = 3, tasks: int | None = None, key: str = "file_key", calls: int = CALLS, pause: float = 0.0) -> DataFrame:
    """A4: (key, response, attempts, error) for each ``prompt``.

    ``infer`` runs on the executors, in up to ``calls`` threads of each task at once; a
    response counts if it is JSON once cleaned. Between attempts a row waits
    ``pause`` seconds, then twice as long. A row whose attempts all fail keeps the last
    error and a null response. Rows are dealt evenly over ``tasks``, since each call
    takes long; of these a task holds the ones under way only. Written results are
    kept by ``annotate_new``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "response", "attempts", "error"]
        with ThreadPoolExecutor(calls) as pool:
            for batch in batches:
                waiting, rows, done = {}, zip(batch[key], batch["prompt"], strict=True), []
                while True:
                    for k, prompt in islice(rows, calls - len(waiting)):
                        waiting[pool.submit(_ask, infer, prompt, max_attempts, pause)] = k
                    if not waiting:
                        break
                    for f in wait(waiting, return_when=FIRST_COMPLETED).done:
                        done.append((waiting.pop(f), *f.result()))
                if done:
                    yield pd.DataFrame(done, columns=names)

    rows = df.select(F.col(key).cast("string").alias(key), F.coalesce("prompt", F.lit("")).alias("prompt"))
    rows = rows.repartition(tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapInPandas(run, f"{key} string, response string, attempts int, error string")


def annotate_new(df: DataFrame, infer: Callable[[str], str], store: str, waves: int = 8, key: str = "file_key", **more) -> DataFrame:
    """A1, A4: annotates what ``store`` has no answer for yet, and returns all its rows (key, response, attempts, error).

    Keys are dealt over ``waves`` by hash. The answers of a wave are written together
    before the next begins, so a run that breaks off repeats no call of a finished
    wave, and a lost task those of its rows in one wave; more waves, fewer calls to
    repeat. Rows that failed stay in the store with their error and aren't asked again;
    delete them to have them asked. Of rows that share a key one is asked, the one
    whose prompt is least; rows without a key are not asked. ``more`` goes to ``annotate``.
    """
    spark = df.sparkSession
    schema = f"{key} string, response string, attempts int, error string"
    asked = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias(key)).agg(F.min(F.coalesce("prompt", F.lit(""))).alias("prompt"))
    spark.createDataFrame([], schema).write.mode("append").parquet(store)
    for wave in range(waves):
        mine = asked.filter(F.pmod(F.xxhash64(key), F.lit(waves)) == wave)
        annotate(pending(mine, spark.read.schema(schema).parquet(store), key), infer, key=key, **more).write.mode("append").parquet(store)
    return spark.read.schema(schema).parquet(store)


def clean_response(col: Column) -> Column:
    """A5: a response without code fences and outer white space; null unless it is JSON."""
    text = strip(F.replace(F.replace(col, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    return F.when(F.try_parse_json(text).isNotNull(), text)


def project_annotation(df: DataFrame, profile: Profile, col: str = "response") -> DataFrame:
    """Adds the profile's keys as typed columns.

    Lists are taken as JSON arrays or as text (``parse_list``); flags as booleans
    or as the texts true and false; ratings as whole numbers or their text.
    """
    value = F.try_parse_json(F.col(col))
    text = lambda k: F.try_variant_get(value, f"$.{k}", "string")
    columns = {k: F.coalesce(F.try_variant_get(value, f"$.{k}", "array<string>"), F.when(text(k).isNotNull(), parse_list(text(k)))) for k in profile.lists}
    columns |= {("AI_description" if k == "description" else k): text(k) for k in profile.texts}
    columns |= {k: text(k).try_cast("double").try_cast("int") for k in profile.ratings}
    columns |= {k: F.lower(text(k)).try_cast("boolean") for k in (profile.flag, *profile.flags)}
    return df.withColumns(columns)
