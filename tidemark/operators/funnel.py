"""The funnel from links to categories: counts, edges and shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import PLATFORMS
from .coding import code_posts, primary_category, primary_counts
from .posts import copy_key, first_of_copies, is_flagged, named_terms, screen_platform

STAGES = ("links", "processed", "topic", "unique", "has_terms")


def platform_links(links: DataFrame) -> DataFrame:
    """Links of each source in lower case, most first; nulls don't count."""
    lower = links.select(F.lower("source").alias("platform")).filter(F.col("platform").isNotNull())
    return lower.groupBy("platform").agg(F.count(F.lit(1)).alias("n_links")).orderBy(F.desc("n_links"), "platform")


def platform_processed(links: DataFrame, posts: DataFrame, allowed: Sequence[str] = PLATFORMS) -> DataFrame:
    """Links and processed posts of each platform with links."""
    done = screen_platform(posts, allowed).groupBy(F.col("extractor").alias("platform")).agg(F.count(F.lit(1)).alias("n"))
    return platform_links(links).join(done, "platform", "left").select("platform", "n_links", F.coalesce("n", F.lit(0)).alias("n_processed"))


def _screened(posts: DataFrame, flag: str, allowed: Sequence[str], *more: Column) -> DataFrame:
    """Posts by what they share with their copies: (platforms, n, topic, has_terms and what ``more`` adds of the first).

    Posts off topic are one group; so are those with short titles that have the same id
    and terms, all of which stay. ``n_first`` says how many of a group stay, ``platforms``
    counts its posts on each of ``allowed``. Groups are merged before they move, so
    a popular title is no task's.
    """
    inside = screen_platform(posts, allowed).withColumn("__topic", is_flagged(posts, flag))
    title, duration = copy_key(inside)
    lone = F.when(F.col("__topic") & title.isNull(), F.struct("id", "supplements"))
    keyed = inside.withColumns({"__title": F.when(F.col("__topic"), title), "__duration": F.when(F.col("__topic"), duration), "__lone": lone})
    first = F.struct((F.size(named_terms()) > 0).alias("has_terms"), *more)
    platforms = F.array(*(F.count_if(F.col("extractor") == p) for p in allowed))
    groups = keyed.groupBy("__topic", "__title", "__duration", "__lone").agg(F.count(F.lit(1)).alias("n"), platforms.alias("platforms"), F.min_by(first, first_of_copies()).alias("first"))
    stay = F.when(~F.col("__topic"), 0).when(F.col("__title").isNull(), F.col("n")).otherwise(1)
    return groups.select(F.col("__topic").alias("topic"), "n", stay.alias("n_first"), "platforms", "first.*")


def _tallies(screened: DataFrame, n_platforms: int) -> DataFrame:
    """One row: how many posts pass and fail each screen, and how many each platform has."""
    sums = lambda c: F.coalesce(F.sum(c), F.lit(0))
    topic, first = F.when(F.col("topic"), F.col("n")), F.col("n_first")
    return screened.agg(
        sums("n").alias("processed"), sums(topic).alias("topic"), sums(first).alias("unique"), sums(F.when(F.col("has_terms"), first)).alias("has_terms"),
        F.array(*(sums(F.col("platforms")[i]) for i in range(n_platforms))).alias("platforms"),
    )


def _stage_rows(one: DataFrame) -> DataFrame:
    """(stage, n) of a row with the numbers of all stages; what a screen removes is ``not_<stage>``."""
    removed = [F.struct(F.lit(f"not_{s}").alias("stage"), (F.col(before) - F.col(s)).alias("n")) for before, s in pairwise(STAGES)]
    return one.select(F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("n")) for s in STAGES), *removed)).alias("x")).select("x.stage", "x.n")


def funnel_counts(links: DataFrame, posts: DataFrame, flag: str, allowed: Sequence[str] = PLATFORMS) -> DataFrame:
    """(stage, n), what passes each screen; what it removes is ``not_<stage>``. One pass over the posts."""
    total = links.filter("source IS NOT NULL").agg(F.count(F.lit(1)).alias("links"))
    return _stage_rows(total.crossJoin(_tallies(_screened(posts, flag, allowed), len(allowed))))  # one row each


def funnel_cube(links: DataFrame, posts: DataFrame, rules: DataFrame, flag: str, folder: str, allowed: Sequence[str] = PLATFORMS) -> DataFrame:
    """The numbers that the whole funnel is made of, as a few rows: (part, name, n, m).

    Parts: ``links`` of each platform (n) and its processed posts (m), ``stage`` for
    what passes each screen, ``category`` of the posts that pass them all.

    Posts are read once: what copies share becomes one row of a table in
    ``folder``, with the terms of the first, and all that follows reads that table.
    """
    terms = F.when(F.size(named_terms()) > 0, F.struct("id", F.col("supplements")))
    _screened(posts, flag, allowed, terms.alias("named")).write.mode("overwrite").parquet(f"{folder}/screened")
    screened = posts.sparkSession.read.parquet(f"{folder}/screened")
    named = screened.filter("n_first > 0 AND has_terms").select("named.*")
    counted = primary_counts(primary_category(code_posts(named, rules)))
    tallies = _tallies(screened, len(allowed))
    linked = platform_links(links)
    done = tallies.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, allowed)), "platforms")).alias("platform", "done"))
    row = lambda part, name, n, m: [F.lit(part).alias("part"), name.alias("name"), n.cast("long").alias("n"), m.cast("long").alias("m")]
    nothing = F.lit(None)
    by_platform = linked.join(done, "platform", "left").select(*row("links", F.col("platform"), F.col("n_links"), F.coalesce("done", F.lit(0))))
    stages = F.explode(F.map_from_arrays(F.array(*map(F.lit, STAGES[1:])), F.array(*STAGES[1:]))).alias("stage", "n")
    screens = tallies.select(stages).select(*row("stage", F.col("stage"), F.col("n"), nothing))
    by_category = counted.select(*row("category", F.col("primary_category"), F.col("n"), nothing))
    return by_platform.unionByName(screens).unionByName(by_category)


def funnel_edges(cube: DataFrame) -> DataFrame:
    """(src, dst, n, kind): links by platform to processed or failed, screens to kept or removed, posts to categories.

    Links and posts are two tables, so that what failed can be negative.
    """
    edge = lambda src, dst, n, kind: F.struct(src.alias("src"), dst.alias("dst"), n.alias("n"), F.lit(kind).alias("kind"))
    name, n, m = F.col("name"), F.col("n"), F.col("m")
    before = F.lag("n").over(Window.partitionBy("part").orderBy(_place("name")))  # four rows of the part that counts
    source = F.element_at(F.create_map(*(F.lit(x) for a, b in pairwise(STAGES[1:]) for x in (b, a))), name)
    edges = (
        F.when(F.col("part") == "links", F.array(edge(name, F.lit("processed"), m, "kept"), edge(name, F.lit("not_processed"), n - m, "removed")))
        .when((F.col("part") == "stage") & (name != "processed"), F.array(edge(source, name, n, "kept"), edge(source, F.concat(F.lit("not_"), name), F.col("before") - n, "removed")))
        .when(F.col("part") == "category", F.array(edge(F.lit("has_terms"), name, n, "kept")))
    )
    return cube.withColumn("before", before).select(F.explode(edges).alias("x")).select("x.*")


def _place(name: str) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for i, s in enumerate(STAGES) for x in (s, i))), F.col(name))


def funnel_shares(edges: DataFrame, total: DataFrame) -> DataFrame:
    """P5: edges with their percent of the source and the destination's percent of all links.

    A node's size is what flows into it, or out of it if nothing does. ``total`` is
    one row with ``n``. Shares of an empty node are null. Each edge tells both its
    nodes what flows, so that sizes are windows over the edges, which are few.
    """
    edges = edges.withColumn("__edge", F.monotonically_increasing_id())
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit("out").alias("way")), F.struct(F.col("dst").alias("node"), F.lit("in").alias("way")))).alias("end")
    told = edges.select("*", ends).select("__edge", "src", "dst", "n", "kind", "end.*")
    flow = lambda way: F.sum(F.when(F.col("way") == way, F.col("n"))).over(Window.partitionBy("node"))
    sized = told.withColumn("size", F.coalesce(flow("in"), flow("out")))
    size = lambda way: F.max(F.when(F.col("way") == way, F.col("size")))
    named = sized.groupBy("__edge", "src", "dst", "n", "kind").agg(size("out").alias("src_size"), size("in").alias("dst_size"))
    percent = lambda a, b: F.try_divide(100.0 * a, b.cast("double"))
    return named.crossJoin(F.broadcast(total.select(F.col("n").alias("__all")))).select("src", "dst", "n", "kind", percent(F.col("n"), F.col("src_size")).alias("percent_of_src"), percent(F.col("dst_size"), F.col("__all")).alias("dst_percent_of_links"))


def funnel_stages(counts: DataFrame) -> DataFrame:
    """(stage, n_in, kept, removed) for each screen, in order."""
    main = counts.filter(F.col("stage").isin(*STAGES)).withColumn("place", _place("stage"))
    steps = main.withColumn("n_in", F.lag("n").over(Window.orderBy("place")))  # five rows
    return steps.filter("place > 0").select("place", "stage", "n_in", F.col("n").alias("kept"), (F.col("n_in") - F.col("n")).alias("removed"))


def relabel(df: DataFrame, mapping: Mapping[str, str] | DataFrame, col: str) -> DataFrame:
    """``col`` by its display label, or itself where there is none.

    ``mapping`` is a dict, or a table (name, label) of any size.
    """
    if isinstance(mapping, Mapping):
        if not mapping:
            return df
        table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
        return df.withColumn(col, F.coalesce(F.try_element_at(table, F.col(col)), F.col(col)))
    labels = mapping.select(F.col("name").alias(col), F.col("label").alias("__label")).dropDuplicates([col])
    return df.join(labels, col, "left").withColumn(col, F.coalesce("__label", col)).drop("__label")
