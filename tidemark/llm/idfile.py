"""Token-id output: concatenated ids with Elias-Fano encoded document boundaries."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import narrow, partitions
from .tokens import encoder

MAGIC = b"IDSEF2\0\0"
#: Magic, bytes of an id, low bits of the boundaries and of the document ids, documents, those without an id, the
#: least document id, ids, words of the high parts of both.
HEADER = struct.Struct("<8sBBBxxxxxQQqQQQ")
EVERY = 64  # a select sample for every so many documents

SHARDS = "part int, seq int, n_docs long, n_ids long, payload binary"


class Boundaries:
    """A non-decreasing sequence of ends in Elias-Fano form.

    The low bits of each end are packed side by side; the high parts are written
    in unary, end i setting bit (high + i). ``samples`` holds the bit position of
    every 64th set bit, from which ``select`` counts on word by word.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, ends: np.ndarray, total: int) -> Boundaries:
        n = len(ends)
        low_bits = max(0, (total // max(n, 1)).bit_length() - 1)
        ends = ends.astype(np.uint64)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((ends[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (ends >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(places[-1]) // 64 + 1) * 64 if n else 0, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        return cls(n, low_bits, low, high, places[::EVERY].astype("<u4"))

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        raw = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return raw >> first % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """End i."""
        place = int(self.samples[i // EVERY])
        left, word = i % EVERY, place // 64
        bits = int(self.high[word]) >> place % 64 << place % 64
        while (here := bits.bit_count()) <= left:
            left, word = left - here, word + 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        place = word * 64 + (bits & -bits).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)


def pack(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One shard: header, boundaries, document ids, then all ids. Documents come in ascending order, those without an id first."""
    ends = np.cumsum([len(x) // width for x in ids])
    total = int(ends[-1]) if len(ends) else 0
    named = [d for d in doc_ids if d is not None]
    least = named[0] if named else 0
    b = Boundaries.of(ends, total)
    d = Boundaries.of(np.array([x - least for x in named], np.uint64), named[-1] - least if named else 0)
    head = HEADER.pack(MAGIC, width, b.low_bits, d.low_bits, b.n, b.n - d.n, least, total, len(b.high), len(d.high))
    return b"".join([head, *(x.tobytes() for part in (b, d) for x in (part.high, part.samples, part.low)), *ids])


class Shard:
    """A packed shard, read in place."""

    def __init__(self, payload: bytes):
        magic, width, low_bits, doc_bits, n, unnamed, least, total, words, doc_words = HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a shard of ids")
        at = HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        def boundaries(n: int, bits: int, words: int) -> Boundaries:
            high, samples = take("<u8", words), take("<u4", -(-n // EVERY))
            return Boundaries(n, bits, take("u1", (n * bits + 7) // 8), high, samples)

        self.unnamed, self.least = unnamed, least
        self.ends, self.named = boundaries(n, low_bits, words), boundaries(n - unnamed, doc_bits, doc_words)
        self.ids = take(f"<u{width}", total)

    def doc_id(self, i: int) -> int | None:
        """The id of document i."""
        return None if i < self.unnamed else self.least + self.named.select(i - self.unnamed)

    def __len__(self) -> int:
        return self.ends.n

    def document(self, i: int) -> np.ndarray:
        """The ids of document i, found by select."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, most: int = 1 << 20) -> None:
    """Writes the ids of ``docs(doc_id, text)``, in ascending doc_id order, to ``path``.

    Each document's ids are followed by ``end_id``. Texts are dealt by range of
    doc_id (equal ids by their text as well, nulls first) and sorted; each task
    writes shards of about ``most`` ids, one document at least, so that a reader
    holds one shard at a time. Shards are binary rows of a Parquet folder, in
    order of (part, seq), since Parquet is what any store that Spark reaches can
    hold. Null and empty texts are a lone ``end_id``.
    """
    schema = SHARDS

    def build(batches):
        encode, part, seq = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        width = encode.dtype.itemsize
        end, doc_ids, ids, total = np.array([end_id], encode.dtype).tobytes(), [], [], 0

        def shard():
            return pd.DataFrame({"part": [part], "seq": [seq], "n_docs": [len(doc_ids)], "n_ids": [total], "payload": [pack(doc_ids, ids, width)]})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                ids.append(encode.encode(text) + end)
                total += len(ids[-1]) // width
                if total >= most:
                    yield shard()
                    seq, doc_ids, ids, total = seq + 1, [], [], 0
        if doc_ids:
            yield shard()

    sorted_docs = (
        docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("same"))
        .repartitionByRange(partitions(docs.sparkSession), "doc_id", "same")
        .sortWithinPartitions("doc_id", "same")
        .select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    )
    sorted_docs.mapInPandas(build, schema).write.option("compression", "zstd").parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, base): the ids of all shards before each.

    Only the counts are read. Tasks' totals, one row a task, are summed in one
    window; within a task's shards the sum runs by itself.
    """
    counts = spark.read.schema(SHARDS).parquet(path).select("part", "seq", "n_ids")
    totals = counts.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inner = counts.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("own"))
    return inner.join(bases, "part").select("part", "seq", (F.col("part_base") + F.col("own")).alias("base"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a folder of shards: doc_id, start, n_tokens, ids (bytes), width.

    A document's place in its shard is found by ``select``. Documents without an id
    have a null one; texts that were null or empty are a lone end; repeated rows are
    documents each; a folder of no shards gives no rows.
    """
    shards = spark.read.schema(SHARDS).parquet(path).select("part", "seq", "payload")

    def documents(batches):
        for batch in batches:
            for base, payload in zip(batch["base"], batch["payload"], strict=True):
                shard = Shard(payload)
                for at in range(0, len(shard), 1024):
                    some = range(at, min(at + 1024, len(shard)))
                    ends = np.array([shard.ends.select(i) for i in some])
                    starts = np.append(shard.ends.select(at - 1) if at else 0, ends[:-1])
                    yield pd.DataFrame({
                        "doc_id": pd.array([shard.doc_id(i) for i in some], "Int64"), "start": base + starts, "n_tokens": ends - starts,
                        "ids": [shard.ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], "width": shard.ids.itemsize,
                    })

    return shards.join(narrow(shard_starts(spark, path)), ["part", "seq"]).mapInPandas(documents, "doc_id long, start long, n_tokens long, ids binary, width int")


def id_digests(documents: DataFrame) -> DataFrame:
    """``read_ids`` with the ids replaced by their CRC-32 as 32-bit integers; one row for each document, whatever its id."""

    def digest(batches):
        import zlib

        for batch in batches:
            wide = [np.frombuffer(x, f"<u{w}").astype("<u4") for x, w in zip(batch["ids"], batch["width"], strict=True)]
            yield batch[["doc_id", "start", "n_tokens"]].assign(ids_crc32=[zlib.crc32(x.tobytes()) for x in wide])

    return documents.mapInPandas(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
