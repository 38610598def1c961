"""Short codes of vectors: a codebook for each part, and nearest entries by memoised grid cells."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, shared_dir
from .topk import integer_vectors

#: Components beyond this have squared distances that a long can't hold; they count as not finite.
LIMIT = 1 << 28
#: The edge of a grid cell, and how many cells of a codebook a task remembers.
CELL, REMEMBERED = 128, 50_000


class Cells:
    """Nearest entries of one codebook, by what is known of the grid cells.

    Space is cut into boxes with edges of ``cell``. For each entry a box has a least
    and a greatest squared distance; an entry whose least is above the least of all
    greatest ones is dominated across the box. The others are kept under the box's
    coordinates, and only they are evaluated exactly for a point in it. At
    ``REMEMBERED`` boxes the memory starts anew; that changes speed, never results.
    """

    def __init__(self, codebook: np.ndarray, cell: int = CELL):
        self.codebook, self.cell = codebook, cell
        self.known: dict[bytes, int] = {}
        self.masks = np.zeros((1024, len(codebook)), bool)
        self.evaluated = self.asked = 0

    def undominated(self, boxes: np.ndarray) -> np.ndarray:
        """Which entries could be nearest to a point of each box."""
        low = boxes[:, None, :] * self.cell
        high = low + (self.cell - 1)
        entries = self.codebook[None, :, :]
        near = np.maximum(np.maximum(low - entries, entries - high), 0)
        far = np.maximum(np.abs(entries - low), np.abs(entries - high))
        return (near * near).sum(axis=2) <= (far * far).sum(axis=2).min(axis=1)[:, None]

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """Which entries have to be evaluated for each point."""
        boxes = np.ascontiguousarray(points // self.cell)
        keys = boxes.view(np.dtype((np.void, boxes.shape[1] * boxes.itemsize))).ravel()
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) + len(first) > REMEMBERED:
            self.known.clear()
        names = [keys[i].tobytes() for i in first]
        places = np.array([self.known.get(n, -1) for n in names])
        new = np.flatnonzero(places < 0)
        places[new] = len(self.known) + np.arange(len(new))
        for start in range(0, len(new), 4096):
            some = new[start : start + 4096]
            while places[some[-1]] >= len(self.masks):
                self.masks = np.concatenate([self.masks, np.zeros_like(self.masks)])
            self.masks[places[some]] = self.undominated(boxes[first[some]])
        self.known.update(zip((names[i] for i in new), places[new].tolist(), strict=True))
        return self.masks[places[inverse]]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry; of equal ones the first."""
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, entry = np.nonzero(self.candidates(points))
        self.evaluated, self.asked = self.evaluated + len(row), self.asked + len(points) * len(self.codebook)
        distance = ((points[row] - self.codebook[entry]) ** 2).sum(axis=1)
        starts = np.searchsorted(row, np.arange(len(points)))
        best = np.minimum.reduceat(distance, starts)
        hits = np.flatnonzero(distance == best[row])
        return entry[hits[np.searchsorted(row[hits], np.arange(len(points)))]], best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _parts(matrix: np.ndarray, books: list[np.ndarray]) -> Iterator[np.ndarray]:
    return iter(np.split(matrix, len(books), axis=1))


def refine(rows: DataFrame, books: list[np.ndarray], cell: int) -> list[np.ndarray]:
    """One round: every part goes to its nearest entry, and each entry becomes the floor of the mean of its parts.

    Tasks add up what they read; sums of (part, entry, position) are all that moves,
    and all that reaches the driver, however many rows there are.
    """
    shape = len(books), len(books[0]), books[0].shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n, total = [Cells(b, cell) for b in books], np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            for p, points in enumerate(_parts(_matrix(batch.column("vector"), shape[0] * shape[2]), books)):
                nearest, _ = cells[p].nearest(points)
                n[p] += np.bincount(nearest, minlength=shape[1])
                np.add.at(total[p], nearest, points)
        slots = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.repeat(n.ravel(), shape[2])), pa.array(total.ravel())], names=["slot", "n", "total"])

    sums = rows.select("vector").mapInArrow(add, "slot long, n long, total long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter("n > 0")
    new = np.stack(books)
    flat = new.reshape(-1)
    for slot, n, total in sums.collect():  # parts x entries x positions rows at most
        flat[slot] = total // n
    return list(new)


def codebook_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, cell: int = CELL) -> DataFrame:
    """Codes of the vectors of ``vectors(vec_id, embedding, label)``.

    Components become floor(scale * x), vectors are cut into ``parts`` equal parts. The
    codebook of each part starts as that part of the ``entries`` vectors with the
    least ids (at equal ids the lesser vector; rows without id last), and is refined
    ``rounds`` times.

    Returns vec_id, code (two hex digits of the nearest entry's index for each part),
    error (squared distance to what the code stands for), label_error (the sum of
    errors over the rows with the same label, null labels together) and
    codebooks_sha256 (of all entries' components).

    Vectors that are null or empty, or hold a component that is null, not finite or
    beyond ``LIMIT`` once scaled, are left out, as are those of another width than the
    vector with the least id. Repeated rows each count and each return. With fewer rows
    than entries the codebooks are shorter; an empty table gives no rows. Labels of any
    number and any skew: they are added up before they meet the rows again, by broadcast
    where the sums measure little, else by a join that Spark splits. A width that isn't a
    multiple of ``parts`` raises.
    """
    spark, names = vectors.sparkSession, dict(vectors.dtypes)
    schema = f"vec_id {names['vec_id']}, label {names['label']}, code string, error long"
    whole = integer_vectors(F.col("embedding"), scale)
    rows = vectors.select("vec_id", "label", whole.alias("vector")).filter((F.size("vector") > 0) & ~F.exists("vector", lambda x: F.abs(x) > LIMIT))
    rows = rows.withColumn("vector", F.col("vector").cast("array<int>"))
    folder = shared_dir(spark, "vectors")
    rows.write.parquet(f"{folder}/whole")
    rows = spark.read.parquet(f"{folder}/whole")
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    least = rows.orderBy(*order).first()
    width = len(least["vector"]) if least else 0
    if width % parts:
        raise ValueError(f"{width} components can't be cut into {parts} equal parts")
    rows = rows.filter(F.size("vector") == width)
    first = [r["vector"] for r in rows.orderBy(*order).limit(entries).collect()]  # so many rows
    books = [np.ascontiguousarray(b) for b in np.split(np.array(first, np.int64), parts, axis=1)] if first else []
    for _ in range(rounds if first else 0):
        books = refine(rows, books, cell)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b, cell) for b in books]
        for batch in batches:
            found = [c.nearest(p) for c, p in zip(cells, _parts(_matrix(batch.column("vector"), width), books), strict=True)]
            digits = np.stack([i for i, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(sum(d for _, d in found))], names=["vec_id", "label", "code", "error"])

    (rows.mapInArrow(code, schema) if first else spark.createDataFrame([], schema)).write.parquet(f"{folder}/codes")
    coded = spark.read.parquet(f"{folder}/codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    size = totals.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col("of").cast("string")), F.lit(0)) + 24), F.lit(0))).first()[0]
    totals = F.broadcast(totals) if size <= BROADCAST_BYTES else totals
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
