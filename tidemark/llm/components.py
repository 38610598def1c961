"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gather


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of ``edges(u, v)``: the least id it can reach.

    Alternates two rounds until nothing changes: each node hands the least of its
    neighbours to its larger neighbours, then to its smaller ones and itself. The
    number of rounds grows with the logarithm of a component's size. Sums and
    joins by node are all there is, so that a node with a third of all edges is
    merged before the shuffle and its join can be split. Loops and repeated edges
    do no harm; nulls are left out.
    """
    links = edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    links = gather(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = links.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("u <> m").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = gather(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        # Done when every node hangs on one root that hangs on nothing.
        end = lambda name, up, v: F.struct(F.col(name).alias("id"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"), v.alias("v"))
        ends = links.select(F.inline(F.array(end("u", 1, F.col("v")), end("v", 0, F.lit(0).cast("long")))))
        nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"), F.sum(F.col("v").cast("decimal(38,0)")).alias("sum"))
        now = nodes.agg(F.coalesce(F.max("up"), F.lit(0)), F.sum(F.when((F.col("up") > 0) & (F.col("down") > 0), 1).otherwise(0)), F.sum("sum")).first()
        if (now[0] <= 1 and not now[1]) or now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("id")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
