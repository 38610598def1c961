"""Exact top-k inner-product search by sequential reads of sorted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, partitions

#: Vectors of a block of candidates, of queries that move together, and of queries that read a block's lists together.
BLOCK, ASKED_BLOCK, QUERY_BLOCK = 4096, 1024, 128
#: A block of wide vectors is full with so many components, which bounds what its lists take.
COMPONENTS = 1 << 20
#: The lists are read to these parts of their lengths; after each but the last bounds are looked at.
DEPTHS, PARTS = (0, 4, 8, 12, 14, 16), 16

BLOCKS = "ids binary, vectors binary, width int"


def integer_vectors(vectors: Column, scale: int = 256) -> Column:
    """floor(scale * x) for each component x as double; null if any is null or not finite."""
    whole = F.transform(vectors, lambda x: F.floor(scale * x.cast("double")).cast("double"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.when(~F.coalesce(F.exists(vectors, odd), F.lit(False)), whole)


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Packs ``rows(id, vector)`` into blocks of at most ``size`` vectors of one width, fewer of wide ones.

    Each task packs what it reads, so no row moves.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}

        def block(width: int) -> pd.DataFrame:
            ids, vectors = held.pop(width)
            return pd.DataFrame({"ids": [np.array(ids, np.int64).tobytes()], "vectors": [np.array(vectors, np.float64).tobytes()], "width": [width]})

        for batch in batches:
            for i, v in zip(batch["id"], batch["vector"], strict=True):
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == size or len(ids) * len(v) >= COMPONENTS:
                    yield block(len(v))
        for width in list(held):
            yield block(width)

    return rows.mapInPandas(pack, BLOCKS)


class SortedLists:
    """A block's list of (value, vector) for each component, in order of value.

    The lists are read from both ends and only onward, all equally deep, once for
    all queries that meet the block: what was read is kept.
    """

    def __init__(self, vectors: np.ndarray) -> None:
        vectors = vectors.astype(np.int64)
        self.n, self.width = vectors.shape
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, self.order, axis=0)
        self.low, self.high = self.values[0], self.values[-1]
        self.depths = [self.n * part // PARTS for part in DEPTHS]
        self.kept: dict[tuple[int, type], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def read(self, step: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries of a step, which are open after it, and the places reached.

        Columns are the components from the top, then those from the bottom; values
        are differences from the list's other end.
        """
        if (step, kind) not in self.kept:
            start, depth = self.depths[step : step + 2]
            top, bottom, j = slice(self.n - depth, self.n - start), slice(start, depth), np.arange(self.width)
            entries = np.zeros((self.n, 2 * self.width), kind)
            entries[self.order[top], j] = self.values[top] - self.low
            entries[self.order[bottom], self.width + j] = self.values[bottom] - self.high
            open_ = self.read(step - 1, kind)[1].copy() if step else np.ones(entries.shape, kind)
            open_[self.order[top], j] = 0
            open_[self.order[bottom], self.width + j] = 0
            reached = np.concatenate([self.values[min(self.n - depth, self.n - 1)] - self.low, self.values[max(depth - 1, 0)] - self.high]).astype(kind)
            self.kept[step, kind] = entries, open_, reached
        return self.kept[step, kind]


def no_random_access(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray | SortedLists, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k best of a block for each query: (query id, vector id, score).

    Each component has a list of the block's vectors, (value, vector) in order of
    value. A query reads every list from the end that its own component's sign
    makes the best, all lists equally deep and only onward. What is read of a vector
    is added to its lower bound, which counts the worst end of the lists for
    components not read yet; the upper bound counts the places just reached instead.
    A vector whose upper bound is under the k-th best lower bound, also one that no
    list has shown yet, is out, and entries of vectors that are out for all queries
    are passed over. The others are read on to the ends of the lists, where both
    bounds are the score. Ties go to the smaller id.
    """
    lists = vectors if isinstance(vectors, SortedLists) else SortedLists(vectors)
    queries = queries.astype(np.int64)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)  # what reads from the top, and from the bottom
    most = float((np.abs(queries) @ np.maximum(np.abs(lists.low), np.abs(lists.high)).astype(np.float64)).max(initial=0))
    kind = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64  # sums of floats are faster, and exact up to there
    least = np.iinfo(kind).min if kind is np.int64 else -np.inf
    weights = np.concatenate([up, down], axis=1).astype(kind)
    rows = np.arange(lists.n)
    alive = query_ids[:, None] != ids[None, :]
    lower = np.where(alive, (up @ lists.low + down @ lists.high).astype(kind)[:, None], least)
    for step in range(len(DEPTHS) - 1):
        entries, open_, reached = lists.read(step, kind)
        lower += weights @ entries[rows].T
        if step + 2 == len(DEPTHS) or not lists.depths[step + 1] or len(rows) <= k:
            continue
        bounds = np.partition(lower, len(rows) - k, axis=1)[:, len(rows) - k]  # what is out stays under them
        alive &= lower + (weights * reached) @ open_[rows].T >= bounds[:, None]
        live = np.flatnonzero(alive.any(axis=0))
        rows, alive, lower = rows[live], alive.take(live, axis=1), lower.take(live, axis=1)
    query, place = np.nonzero(alive)
    found, scores = ids[rows[place]], lower[query, place].astype(np.int64)
    order = np.lexsort((found, -scores, query))
    query, found, scores = query[order], found[order], scores[order]
    first = np.arange(len(query)) - np.searchsorted(query, query) < k
    return list(zip(query_ids[query[first]].tolist(), found[first].tolist(), scores[first].tolist(), strict=True))


def meetings(stored: DataFrame, asked: DataFrame, asked_bytes: int, rows: int) -> DataFrame:
    """Each block of candidates beside each block of queries of its width.

    Candidates are dealt over the session's shuffle partitions, fewer where their
    ``rows`` don't make a quarter of a block for each, and queries sent to all of
    them, ``asked_bytes`` at most. Where that is over ``BROADCAST_BYTES``,
    blocks meet in a grid instead: so many groups of queries that a task holds one,
    times so many tables of candidates. No size that Spark guesses decides: it
    takes copied blocks for single ones.
    """
    tables, groups = partitions(stored.sparkSession), -(-asked_bytes // BROADCAST_BYTES)
    if groups <= 1:
        return stored.repartition(min(tables, 4 * rows // BLOCK + 1)).join(F.broadcast(asked), "width")
    tables = max(1, tables // groups)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda ids, n: F.pmod(F.xxhash64(ids), F.lit(n)).cast("int")
    asked = asked.select("*", upto(tables).alias("table"), deal("query_ids", groups).alias("group"))
    stored = stored.select("*", deal("ids", tables).alias("table"), upto(groups).alias("group"))
    return stored.join(asked.hint("merge"), ["table", "group", "width"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """The ``k`` best others for each row of ``vectors(vec_id, embedding)`` that ``is_query``.

    Scores are inner products of floor(scale * x). Candidates are packed into
    blocks where they are read, queries into blocks of their own; each block of
    queries meets each block of candidates once, in a task that holds the two.
    Only the k best of a block move on, and a window keeps the k best of all.
    The queries' size is measured first.

    Returns query_id, rank, vec_id, score. Vectors that are null or empty, or
    hold a null or non-finite component, take no part, nor do rows without an id;
    vectors of another width than the query's aren't compared with it. Rows that
    share an id are one row's copies: all but the query's own id are candidates,
    each copy by itself, and a query is asked once per distinct vector. Scores are
    sums of 64-bit integers.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), integer_vectors(F.col("embedding"), scale).alias("vector"), is_query.alias("asks")).filter("id IS NOT NULL AND size(vector) > 0")
    size = 8 + 8 * F.greatest(F.size("embedding"), F.lit(0)).cast("long")
    n, asked_bytes = vectors.agg(F.count(F.lit(1)), F.sum(F.when(is_query, size))).first()
    asked = blocks(rows.filter("asks").select("id", "vector").distinct(), ASKED_BLOCK).select("width", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    stored = blocks(rows.select("id", "vector"), BLOCK)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, lists = None, None
        for batch in batches:
            for x in batch.itertuples(index=False):
                if block != (x.ids, x.vectors):
                    block, lists = (x.ids, x.vectors), SortedLists(np.frombuffer(x.vectors).reshape(-1, x.width))
                ids, query_ids, queries = np.frombuffer(x.ids, np.int64), np.frombuffer(x.query_ids, np.int64), np.frombuffer(x.queries).reshape(-1, x.width)
                for at in range(0, len(query_ids), QUERY_BLOCK):
                    part = slice(at, at + QUERY_BLOCK)
                    yield pd.DataFrame(no_random_access(queries[part], query_ids[part], lists, ids, k), columns=["query_id", "vec_id", "score"])

    found = meetings(stored, asked, asked_bytes or 0, n).mapInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
