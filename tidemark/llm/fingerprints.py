"""Fingerprints of documents: a randomised edit embedding, sampled bits, bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, shared_dir
from .tokens import by_size

#: Coins repeat after so many steps, and characters share them by class.
PERIOD, CLASSES = 64, 64
#: Bits of a fingerprint, and bits of a band.
BITS, BAND_BITS = 512, 32
#: A bit tells of a character and those just before it.
GRAM = 3
#: Texts are walked abreast while there are so many, then one by one.
ABREAST = 64
#: Characters of the texts that a task walks at a time, one text at least.
SLICE = 3_000_000
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # odd constants of a 64-bit mixing function

FOUND = "doc_id {key}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited int"


class Walks:
    """The shared coins of the embedding, as waiting times, and the sampled steps."""

    def __init__(self) -> None:
        toss = lambda *x: hashlib.sha256(":".join(map(str, x)).encode()).digest()
        coins = np.unpackbits(np.frombuffer(b"".join(toss("coins", j) for j in range(PERIOD)), np.uint8)).reshape(PERIOD, -1)[:, :CLASSES]
        self.waits = np.zeros((PERIOD, CLASSES), np.int64)
        for ahead in range(PERIOD - 1, -1, -1):
            self.waits[np.roll(coins, -ahead, axis=0) == 1] = ahead + 1
        # The same as nested lists: the state after a character is one look-up away; the last item names the state.
        self.states: list[list] = [[] for _ in range(PERIOD)]
        for p, state in enumerate(self.states):
            state.extend([self.states[(p + w) % PERIOD] for w in self.waits[p].tolist()] + [p])
        records = []
        for slot in range(BITS):
            steps = [0]
            while steps[-1] < 1 << 44:
                u = (int.from_bytes(toss("slot", slot, len(steps))[:7], "big") + 1) / (1 << 56)
                steps.append(int((steps[-1] + 1) / u))
            records.append(steps)
        longest = max(map(len, records))
        self.records = np.array([r + [1 << 62] * (longest - len(r)) for r in records])
        self.seeds = np.frombuffer(b"".join(toss("bit", slot)[:8] for slot in range(BITS)), np.uint64)

    def walk(self, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, steps: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Writes into ``steps`` the step at which each character is come to; returns the steps after the last.

        Text t is classes[starts[t] : starts[t] + lengths[t]] and is begun at step
        begin[t]. At each step a coin of (step, character) tells whether the walk moves on
        to the next character, so a character takes the steps up to its first head.
        """
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, now = starts[order], lengths[order], begin[order].copy()
        flat, active, k = self.waits.ravel(), int((lengths > 0).sum()), 0
        while active >= ABREAST:
            at = starts[:active] + k
            steps[at] = now[:active]
            now[:active] += flat[((now[:active] % PERIOD) * CLASSES) + classes[at]]
            k += 1
            while active and lengths[active - 1] <= k:
                active -= 1
        for t in range(active):
            part = slice(starts[t] + k, starts[t] + lengths[t])
            names = np.fromiter(map(itemgetter(CLASSES), accumulate(classes[part].tobytes(), getitem, initial=self.states[now[t] % PERIOD])), np.int64, lengths[t] - k + 1)
            # A character takes 1 to PERIOD steps, so the states tell how many.
            took = (np.diff(names) - 1) % PERIOD + 1
            ends = now[t] + np.cumsum(took)
            steps[part] = np.concatenate([now[t : t + 1], ends[:-1]])
            now[t] = ends[-1]
        out = np.empty_like(now)
        out[order] = now
        return out

    def sample(self, chars: np.ndarray, steps: np.ndarray, end: int) -> bytes:
        """The fingerprint of one text, from its characters and the steps at which they are come to.

        Each bit looks at one step of the walk: of all steps up to the end the one with
        the least number in a shared random order, so that texts of nearly the same
        length look at the same steps. It is a bit of a hash of what is read there, which is
        the character and those before it. Without a character all bits are 0.
        """
        if not len(chars):
            return bytes(BITS // 8)
        looked = np.take_along_axis(self.records, (self.records < end).sum(axis=1, keepdims=True) - 1, axis=1).ravel()
        at = np.searchsorted(steps, looked, side="right") - 1
        read = np.zeros(BITS, np.uint64)
        for back in range(GRAM):
            before = np.where(at >= back, chars[np.maximum(at - back, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
            read = (read ^ before) * np.uint64(MIX[0])
            read ^= read >> np.uint64(29)
        read = (read ^ self.seeds) * np.uint64(MIX[1])
        read = (read ^ (read >> np.uint64(31))) * np.uint64(MIX[2])
        return np.packbits((read >> np.uint64(63)).astype(np.uint8)).tobytes()


@cache
def walks() -> Walks:
    return Walks()


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _classes(chars: np.ndarray) -> np.ndarray:
    return ((chars * np.uint32(2654435761)) >> np.uint32(26)).astype(np.uint8)  # the top six bits of a mixed code point


def edited(text: str, following: str) -> tuple[str, int]:
    """(``text`` with its last third replaced by the beginning of ``following``, the characters kept)."""
    cut = len(text) // 3
    kept = len(text) - cut
    return text[:kept] + following[:cut], kept


def fingerprints(texts: list[str], edits: list[tuple[str, int]] | None = None) -> tuple[list[bytes], list[bytes]]:
    """Fingerprints of texts, and of edited forms of the first ones: (edited text, how much of its beginning is the text's).

    The walk over an edited text goes on from where the two part.
    """
    w = walks()
    chars = [_chars(t) for t in texts]
    lengths = np.array([len(c) for c in chars], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    all_ = np.concatenate(chars) if chars else np.zeros(0, np.uint32)
    steps = np.empty(len(all_), np.int64)
    ends = w.walk(_classes(all_), starts, lengths, steps, np.zeros(len(texts), np.int64))
    mine = [steps[s : s + n] for s, n in zip(starts, lengths, strict=True)]
    own = [w.sample(c, m, e) for c, m, e in zip(chars, mine, ends, strict=True)]
    if edits is None:
        return own, []
    tails = [_chars(t[kept:]) for t, kept in edits]
    begin = np.array([m[kept] if kept < len(m) else e for m, e, (_, kept) in zip(mine, ends, edits, strict=False)], np.int64)
    tail_lengths = np.array([len(t) for t in tails], np.int64)
    tail_starts = np.concatenate([[0], np.cumsum(tail_lengths)[:-1]]) if len(tails) else tail_lengths
    tail_all = np.concatenate(tails) if tails else np.zeros(0, np.uint32)
    tail_steps = np.empty(len(tail_all), np.int64)
    tail_ends = w.walk(_classes(tail_all), tail_starts, tail_lengths, tail_steps, begin)
    out = []
    for c, m, t, s, n, e, (_, kept) in zip(chars, mine, tails, tail_starts, tail_lengths, tail_ends, edits, strict=False):
        out.append(w.sample(np.concatenate([c[:kept], t]), np.concatenate([m[:kept], tail_steps[s : s + n]]), int(e)))
    return own, out


def likeness(a: bytes, b: bytes) -> float:
    """How alike two fingerprints are: 1 if they are equal, 0 if no more bits agree than by chance."""
    differ = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return max(0.0, 1.0 - 2.0 * differ / BITS)


def bands(fingerprint: bytes) -> list[bytes]:
    """The bands of a fingerprint, each with its number in front: texts that share one are candidates."""
    size = BAND_BITS // 8
    return [i.to_bytes(2, "big") + fingerprint[i : i + size] for i in range(0, BITS // 8, size)]


def _rows(ids: list, texts: list[str], after: list[str] | None = None) -> list[tuple]:
    """The rows of ``ids``: each text with the one after it, in ``after`` or else in ``texts``, which then holds one more."""
    following = after or texts[1:]
    edits = [edited(t, f) for t, f in zip(texts, following, strict=False)]
    own, other = fingerprints(texts, edits)
    next_prints = fingerprints(after)[0] if after else own[1:]
    out = []
    for i, t, (e, _), p, q, f in zip(ids, texts, edits, own, other, next_prints, strict=False):
        shared = sum(a == b for a, b in zip(bands(p), bands(q), strict=True))
        out.append((i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), p.hex(), q.hex(), likeness(p, q), likeness(p, f), shared))
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _schema(key: pa.DataType, *more: tuple[str, pa.DataType]) -> pa.Schema:
    text, real = pa.string(), pa.float64()
    return pa.schema([("doc_id", key), ("n_chars", pa.int64()), ("edited_sha256", text), ("fingerprint", text), ("edited_fingerprint", text), ("near_edited", real), ("near_next", real), ("bands_edited", pa.int32()), *more])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of the texts of ``docs(doc_id, text)`` and of an edited form of each, with their likeness.

    A text's walk reads its characters with shared random coins, which maps edits to
    few changed steps; a fingerprint holds a bit of each of ``BITS`` sampled steps. The
    edited form has the last third of the characters (rounded down) replaced by as many
    from the beginning of the next document in descending order of ids, or all of it if it is
    shorter; after the last comes the first.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next (the fingerprint's likeness to the edited one and the next document's,
    0 to 1) and bands_edited (bands that text and edited form share).

    Null texts are empty ones, and all empty texts are alike. Rows without id come last, rows of one id in order
    of a hash of their text, and rows that repeat both follow each other. A lone row is its own
    next. An empty table gives no rows. Texts of any length are read whole; other columns are passed over.

    Texts move once, into ranges of ids, and stream by in order. Only the first and
    last text of each range are written with what is found, and meet by a join.
    """
    spark, key = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mix", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("mix")]
    ranged = whole.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    more = [("part", pa.int32()), ("head", pa.string()), ("tail", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, head, schema = TaskContext.get().partitionId(), [], None, None
        for batch in batches:
            schema = schema or _schema(batch.schema.field("doc_id").type, *more)
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for s in by_size(texts, SLICE):
                rows = held + list(zip(ids[s], texts[s], strict=True))
                held = rows[-1:]
                if len(rows) > 1:
                    own = [t for _, t in rows]
                    done = [(*r, part, None, None) for r in _rows([i for i, _ in rows[:-1]], own)]
                    if head is None:
                        head = own[0]
                        done[0] = (*done[0][:-2], head, None)
                    yield _batch(done, schema)
        if held:
            i, text = held[0]
            print_ = fingerprints([text])[0][0].hex()
            yield _batch([(i, len(text), None, print_, None, None, None, None, part, text if head is None else None, text)], schema)

    folder = shared_dir(spark, "fingerprints")
    ranged.mapInArrow(run, FOUND.format(key=key) + ", part int, head string, tail string").write.parquet(f"{folder}/ranges")
    found = spark.read.parquet(f"{folder}/ranges")
    parts = sorted(r["part"] for r in found.filter("tail IS NOT NULL").select("part").collect())  # one row a partition
    names = [f.split()[0] for f in FOUND.split(", ")]
    closed = found.filter("tail IS NULL").select(*names)
    if not parts:
        return closed
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, after int")
    last = found.filter("tail IS NOT NULL").select("part", "doc_id", F.col("tail").alias("text")).join(F.broadcast(after), "part")
    first = found.filter("head IS NOT NULL").select(F.col("part").alias("after"), F.col("head").alias("following"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, following = (batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))
            for s in by_size(texts):
                yield _batch(_rows(ids[s], texts[s], following[s]), _schema(batch.schema.field("doc_id").type))

    open_ = last.join(first, "after").select("doc_id", "text", "following").mapInArrow(close, FOUND.format(key=key))
    return closed.unionByName(open_)


def hex_likeness(a: Column, b: Column) -> Column:
    """``likeness`` of two fingerprints as they are returned."""
    differ = sum((F.bit_count(F.conv(F.substr(a, F.lit(i), F.lit(8)), 16, 10).cast("long").bitwiseXOR(F.conv(F.substr(b, F.lit(i), F.lit(8)), 16, 10).cast("long"))) for i in range(1, BITS // 4, 8)), F.lit(0))
    return F.greatest(F.lit(0.0), 1 - 2 * differ / BITS)


def near_copies(found: DataFrame, least: float = 0.75) -> DataFrame:
    """(doc_id, of, likeness): links from texts to the star of a band, the least id under its key.

    ``found`` has doc_id and fingerprint. Equal fingerprints are one class, linked to its
    least id. Representatives meet the star of each of their bands, are compared
    whole, and are linked at a likeness of ``least`` or more. One link for each text and band at
    most: a group of copies of any size is a star, never all its pairs, and bands are added up before they
    move. Two texts of a band that are both unlike its star aren't compared. Rows without id or
    fingerprint have no links.
    """
    known = found.filter("doc_id IS NOT NULL AND fingerprint IS NOT NULL").select("doc_id", "fingerprint")
    classes = known.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    size = BAND_BITS // 4
    keyed = classes.select("doc_id", "fingerprint", F.explode(F.array(*(F.concat(F.lit(f"{i}:"), F.substr("fingerprint", F.lit(i + 1), F.lit(size))) for i in range(0, BITS // 4, size)))).alias("band"))
    stars = keyed.groupBy("band").agg(F.min(F.struct("doc_id", "fingerprint")).alias("star"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = keyed.join(stars, "band").filter(F.col("doc_id") != F.col("star.doc_id")).select("doc_id", "fingerprint", F.col("star.doc_id").alias("of"), F.col("star.fingerprint").alias("other")).distinct()
    alike = met.select("doc_id", "of", hex_likeness(F.col("fingerprint"), F.col("other")).alias("likeness")).filter(F.col("likeness") >= least)
    same = known.join(classes.withColumnRenamed("doc_id", "of"), "fingerprint").filter(F.col("doc_id") != F.col("of")).select("doc_id", "of", F.lit(1.0).alias("likeness"))
    return alike.unionByName(same.distinct())
