"""Posts: joining annotations with metadata, screening and de-duplication."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import CODING_SENTINELS, drop_sentinels, split_terms
from ..schemas import METADATA, PLATFORMS, Profile

#: Shorter titles are too general to tell a copy by.
TITLE_LENGTH = 15


def join_results(results: DataFrame, metadata: DataFrame, key: str = "file_key") -> DataFrame:
    """Annotations with the metadata of their files.

    ``results(key, annotation)`` holds a map from annotation keys to texts,
    ``metadata`` the columns of ``METADATA`` besides the key. Files without
    metadata keep nulls. The annotation's description becomes AI_description; any
    other annotation key that metadata has too overrides it, with null as well.
    Sentiment is lower-cased. Keys that are no column stay in the map ``other``.
    Rows are in order of upload_date, nulls last.
    """
    own, said = [f.name for f in METADATA.fields], F.col("annotation")
    joined = results.join(metadata.select(key, *own), key, "left")
    columns = [
        (F.when(F.map_contains_key(said, name), said[name].try_cast(METADATA[name].dataType)).otherwise(F.col(name)) if name != "description" else F.col(name)).alias(name)
        for name in own
    ]
    rest = F.map_filter(said, lambda k, _: ~k.isin(*own, "sentiment"))
    named = joined.select(key, *columns, F.try_element_at(said, F.lit("description")).alias("AI_description"), F.lower(F.try_element_at(said, F.lit("sentiment"))).alias("sentiment"), rest.alias("other"))
    return named.orderBy(F.col("upload_date").asc_nulls_last(), key)


def normalize_sentiment(df: DataFrame, col: str = "sentiment") -> DataFrame:
    """The sentiment in lower case, if there is such a column; other types give null."""
    if col not in df.columns:
        return df
    text = dict(df.dtypes)[col] == "string"
    return df.withColumn(col, F.lower(col) if text else F.lit(None).cast("string"))


def pick_results(base: DataFrame, alternative: DataFrame) -> DataFrame:
    """The alternative set of results if it has any, else the base set.

    One row is looked for, and the choice is between whole sets.
    """
    return base if alternative.isEmpty() else alternative


def run_profiles(df: DataFrame, profiles: Iterable[Profile], folder: str, mode: str = "strict") -> dict[str, int]:
    """Writes each profile's posts to ``folder/profile=<name>`` and returns their numbers.

    A post goes to every profile whose flag it bears (a profile whose flag the table lacks has none), without copies
    where the profile says so. All profiles are written by one job, which counts on
    the way; one without posts has no folder and no number. A null flag is no flag.
    """
    used = [p for p in profiles if p.flag in df.columns]
    if not used:
        return {}
    marks = F.array(*(F.when(is_flagged(df, p.flag, mode), F.lit(p.name)) for p in used))
    marked = df.withColumn("profile", F.explode(F.filter(marks, lambda x: x.isNotNull())))
    once = [p.name for p in used if p.dedup]
    found = dedup_posts(marked.filter(F.col("profile").isin(*once)), ("profile",)).unionByName(marked.filter(~F.col("profile").isin(*once))) if once else marked
    seen = Observation()
    counts = [F.count_if(F.col("profile") == p.name).alias(p.name) for p in used]
    found.observe(seen, *counts).write.partitionBy("profile").mode("overwrite").parquet(folder)
    return {name: n for name, n in seen.get.items() if n}


def union_ragged(parts: Sequence[DataFrame]) -> DataFrame:
    """Tables one below another; columns that one lacks are null there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def screen_platform(df: DataFrame, allowed: Sequence[str] = PLATFORMS) -> DataFrame:
    """posts of the listed platforms, their names in lower case."""
    return df.withColumn("extractor", F.lower("extractor")).filter(F.col("extractor").isin(*allowed))


def is_flagged(df: DataFrame, flag: str, mode: str = "strict") -> Column:
    """Whether a post is on topic.

    Strict: the flag is boolean true or the number 1, never a text. Text: it reads
    ``true`` in any case.
    """
    kind = dict(df.dtypes)[flag]
    if mode == "text":
        return F.coalesce(F.lower(F.col(flag).cast("string")) == "true", F.lit(False))
    if kind == "boolean":
        return F.coalesce(F.col(flag), F.lit(False))
    if kind == "string":
        return F.lit(False)
    return F.coalesce(F.col(flag) == 1, F.lit(False))


def screen_flag(df: DataFrame, flag: str, mode: str = "strict") -> DataFrame:
    """posts on topic. In mode ``text`` a table without the flag passes whole."""
    if mode == "text" and flag not in df.columns:
        return df
    return df.filter(is_flagged(df, flag, mode))


def copy_key(df: DataFrame) -> tuple[Column, Column]:
    """What copies of a post share: the title, trimmed and in lower case, and the duration, rounded half to even.

    The title is null where it is too short to tell a copy by; a null duration equals another.
    """
    title = F.btrim(F.lower(F.coalesce("title", F.lit(""))))
    return F.when(F.length(title) >= TITLE_LENGTH, title), F.bround(F.col("duration")) if "duration" in df.columns else F.lit(0)


def first_of_copies() -> Column:
    """By what the first of copies is told: the most viewed, nulls last, then the least id."""
    return F.struct(F.col("view_count").isNull(), -F.col("view_count"), F.col("id"))


def dedup_posts(df: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """posts without copies of another post, of which the first (``first_of_copies``) stays.

    Only posts with the same values of ``within`` are copies. The least of a group is
    found by an aggregate that tasks start before rows move, so a title that many posts
    share is a row a task, never a group of rows. Short titles don't move.
    """
    title, duration = copy_key(df)
    keyed = df.withColumns({"__title": title, "__duration": duration})
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    first = keyed.filter("__title IS NOT NULL").groupBy("__title", "__duration", *within).agg(F.min_by(row, first_of_copies()).alias("__row"))
    return first.select("__row.*").unionByName(keyed.filter("__title IS NULL").select(*(F.col(f"`{c}`") for c in df.columns)))


def dedup_stats(df: DataFrame) -> DataFrame:
    """one row with the numbers of posts, of those that stay and of copies; only keys and counts move."""
    title, duration = copy_key(df)
    groups = df.groupBy(title.alias("title"), duration.alias("duration")).agg(F.count(F.lit(1)).alias("n"))
    kept = F.coalesce(F.sum(F.when(F.col("title").isNull(), F.col("n")).otherwise(1)), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return groups.agg(total.alias("n_posts"), kept.alias("n_kept"), (total - kept).alias("n_removed"))


def named_terms(col: str = "supplements") -> Column:
    """The terms of a post that aren't sentinels."""
    return drop_sentinels(split_terms(F.col(col)), CODING_SENTINELS)


def screen_has_terms(df: DataFrame, col: str = "supplements", has: bool = True) -> DataFrame:
    """posts that name a term, or with ``has=False`` those that don't."""
    found = F.size(named_terms(col)) > 0
    return df.filter(found if has else ~found)
