"""Link tables: parsing, merging, auditing and describing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..schemas import LINK_SOURCES


def parse_cards(df: DataFrame, text_col: str = "text") -> DataFrame:
    """L2: adds duration, title, source and author from a result card's text.

    The text has a line each for duration, title and ``source · … · author``.
    Cards with fewer lines, or without a source, are dropped.
    """
    lines = F.split(F.col(text_col), "\n")
    info = strip(F.element_at(lines, 3))
    parts = F.split(info, " · ")
    cards = df.filter(F.size(lines) >= 3)
    named = cards.withColumns({"duration": F.element_at(lines, 1), "title": F.element_at(lines, 2), "source": F.element_at(parts, 1), "author": F.element_at(parts, -1)})
    return named.filter(strip(F.col("source")) != "")


def dedup_links(df: DataFrame, order: Sequence[Column | str], key: str = "link") -> DataFrame:
    """L3: the first row of each link in ``order``; all null links count as one."""
    place = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(place)).filter("__place = 1").drop("__place")


def merge_links(new: DataFrame, old: DataFrame, order: Sequence[str] = ("title",)) -> DataFrame:
    """L4: new and old links, one row a link, new rows first."""
    both = new.withColumn("__age", F.lit(0)).unionByName(old.withColumn("__age", F.lit(1)))
    return dedup_links(both, ["__age", *order]).drop("__age")


def allow_sources(df: DataFrame, names: Sequence[str] = LINK_SOURCES) -> DataFrame:
    """Rows whose source is on the list, in that very spelling."""
    return df.filter(F.col("source").isin(*names))


def new_links(current: DataFrame, old: DataFrame) -> DataFrame:
    """Rows whose link the old table doesn't have; null equals null."""
    known = old.select(F.col("link").alias("__link")).distinct()
    return current.join(known, current["link"].eqNullSafe(known["__link"]), "left_anti")


def merge_summary(current: DataFrame, old: DataFrame) -> DataFrame:
    """One row with the numbers of new links and of all links."""
    known = old.select(F.col("link").alias("__link"), F.lit(True).alias("__old")).distinct()
    marked = current.join(known, current["link"].eqNullSafe(known["__link"]), "left")
    return marked.agg(F.count_if(F.col("__old").isNull()).alias("new_links"), F.count(F.lit(1)).alias("total_links"))


def source_breakdown(df: DataFrame, col: str = "source") -> DataFrame:
    """How often each value occurs, most frequent first; nulls don't count."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


value_counts = source_breakdown


def duplicate_groups(df: DataFrame, keys: Sequence[str] = ("duration", "title")) -> DataFrame:
    """All rows of groups that have more than one.

    Only keys with more than one row are joined back, so that rows of a large
    group needn't meet in one task.
    """
    often = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(*(F.col(k).alias(f"__{k}") for k in keys))
    same = None
    for k in keys:
        one = df[k].eqNullSafe(often[f"__{k}"])
        same = one if same is None else same & one
    return df.join(often, same, "left_semi")


def set_overlap(a: DataFrame, b: DataFrame, key: str = "link") -> DataFrame:
    """One row with the numbers of distinct keys in a only, in both and in b only."""
    both = a.select(F.col(key).alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(F.col(key).alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    sides = both.groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return sides.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("left_only"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("right_only"))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows of both tables."""
    return a.unionByName(b).distinct()


#: Values are looked for in so many ranges of about equal numbers.
RANGES = 1000


def quantiles(df: DataFrame, col: str, points: Sequence[float], ranges: int = RANGES) -> list[float | None]:
    """The exact quantiles of a column at ``points`` (interpolated), each null if it has no values.

    A bounded sketch cuts the values into ``ranges``; counting the ranges tells in
    which ones the ranks lie that are asked for, and only the values of those are ranked, each value once with
    its number. So no task and no driver holds all distinct values: a task has those of one
    range. Two passes over the column, and one over the ranges that were met.
    """
    value = F.col(f"`{col}`")
    known = df.select(value.alias("v")).filter("v IS NOT NULL")
    points_ = ", ".join(f"{i / ranges}D" for i in range(1, ranges))
    cuts = known.agg(F.percentile_approx("v", F.expr(f"array({points_})"), 10 * ranges).alias("c")).first()["c"] or []
    cuts = sorted({float(c) for c in cuts if c == c and abs(c) != float("inf")})
    ranges_ = Bucketizer(splits=[-math.inf, *(cuts or [0.0]), math.inf], inputCol="d", outputCol="r", handleInvalid="keep")  # what is no number comes last
    ranged = ranges_.transform(known.withColumn("d", F.col("v").cast("double"))).withColumn("r", F.col("r").cast("int"))
    sizes = sorted(ranged.groupBy("r").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a range
    n = sum(s["n"] for s in sizes)
    if not n:
        return [None for _ in points]
    places = [p * (n - 1) for p in points]
    before, wanted = {}, {}
    total = 0
    for s in sizes:
        before[s["r"]] = total
        inside = {r for x in places for r in (math.floor(x), math.ceil(x)) if total <= r < total + s["n"]}
        if inside:
            wanted[s["r"]] = inside
        total += s["n"]
    counts = ranged.filter(F.col("r").isin(*wanted)).groupBy("r", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("r").orderBy("v"))
    ranks = F.create_map(*(F.lit(x) for r, inside in wanted.items() for x in (r, F.array(*(F.lit(i - before[r]) for i in sorted(inside))))))
    hit = F.filter(F.element_at(ranks, F.col("r")), lambda i: (i < F.col("upto")) & (i >= F.col("upto") - F.col("n")))
    rows = counts.withColumn("upto", upto).select("r", "v", F.explode(hit).alias("i")).collect()  # two ranks a point at most
    values = {before[x["r"]] + x["i"]: float(x["v"]) for x in rows}
    # The same sum as the built-in percentile's.
    mean = lambda x, low, high: values[low] if low == high or values[low] == values[high] else (high - x) * values[low] + (x - low) * values[high]
    return [mean(x, math.floor(x), math.ceil(x)) for x in places]


def describe_stats(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, deviation (sample), least, quartiles (interpolated), greatest.

    The quartiles are found by ``quantiles``, before this returns; without values all but the count are null.
    """
    found = df.agg(F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"))
    quarters = quantiles(df, col, (0.25, 0.5, 0.75))
    return found.select("count", "mean", "std", "min", *(F.lit(q).cast("double").alias(name) for q, name in zip(quarters, ("p25", "p50", "p75"), strict=True)), "max")


def total_seconds(df: DataFrame, col: str = "seconds") -> DataFrame:
    """The sum of durations; 0 if there are none."""
    return df.agg(F.coalesce(F.sum(col), F.lit(0)).alias("total_seconds"))


def sort_by(df: DataFrame, col: str) -> DataFrame:
    """Rows in order of a column, nulls last."""
    return df.orderBy(F.col(col).asc_nulls_last())


def extension_counts(paths: DataFrame, col: str = "path") -> DataFrame:
    """How many paths end in each extension; those without one count as blank."""
    return paths.select(F.regexp_extract(col, r"\.([^./\\]+)$", 1).alias("extension")).groupBy("extension").agg(F.count(F.lit(1)).alias("n"))


def flatten_struct(df: DataFrame) -> DataFrame:
    """A column for each leaf of nested structs, named by its path."""

    def leaves(kind: T.StructType, path: tuple[str, ...]):
        for f in kind.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here)
            else:
                yield here

    return df.select(*(F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(df.schema, ())))


def shape_counts(df: DataFrame, names: Sequence[str] = LINK_SOURCES) -> DataFrame:
    """One row with the numbers of rows before and after the allow-list."""
    return df.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(F.col("source").isin(*names)).alias("rows_after"))
