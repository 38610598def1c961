"""Language-model scores: context-tree weighting over bytes, and a unigram base."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, most_frequent, remainder, row_key, settle, shared_dir
from .near_dedup import mix

#: Stands before and after every text; UTF-8 never holds it.
MARK = 255
#: Bytes of the deepest contexts.
DEPTH = 5
#: Bytes of text that ask for their grams' values together; a longer text is a block of its own.
BLOCK = 5 << 20
#: Distinct grams, and bytes of text whose grams are looked up, for each bucket of the model.
BUCKET_GRAMS, BUCKET_BYTES = 50_000, 32 << 20
#: Grams looked up at a time: a place among them fits beside a gram into 64 bits.
PIECE = 1 << 16
FREQUENT = 200_000
#: White space between words, besides the blank.
WHITE = "\t\n\x0b\x0c\r"


# --- the model: a context tree over bytes, each byte read as eight bits


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x of at least 0.5, by Stirling's series after eight steps."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


#: ln gamma of n + 1/2 and of n + 1 for small n.
HALVES, WHOLES = (log_gamma(np.arange(1 << 16) + add) for add in (0.5, 1.0))


def log_gamma_at(n: np.ndarray, table: np.ndarray, add: float) -> np.ndarray:
    """ln gamma of n + add, from the table as far as it goes."""
    large = n >= len(table)
    out = table[np.where(large, 0, n)]
    out[large] = log_gamma(n[large] + add)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones; 0 for none."""
    found = log_gamma_at(zeros, HALVES, 0.5) + log_gamma_at(ones, HALVES, 0.5) - log_gamma_at(zeros + ones, WHOLES, 1.0) - np.log(np.pi)
    return np.where(zeros + ones > 0, found, 0.0)


def bit_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each of the 255 inner nodes of the tree over a byte's bits.

    ``counts`` has a row of 256 byte counts for each context. Node 1 splits on the
    highest bit; node n has the children 2n and 2n+1.
    """
    nodes = np.zeros((len(counts), 512), np.int64)
    nodes[:, 256:] = counts
    for n in range(7, -1, -1):
        level = nodes[:, 2 << n : 4 << n]
        nodes[:, 1 << n : 2 << n] = level[:, 0::2] + level[:, 1::2]
    return nodes[:, 2:512:2], nodes[:, 3:512:2]  # of nodes 1 to 255


def mixture(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of a node's weighted probability, and the weight of its own estimate.

    The node halves its belief between its own KT estimate (``own``) and the
    product of the deeper contexts' weighted probabilities (``below``); after the
    training data, the belief in its own is own / (own + below).
    """
    top = np.maximum(own, below)
    both = top + np.log(np.exp(own - top) + np.exp(below - top))
    return both - np.log(2), np.exp(own - both)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The KT probability of a one."""
    return (ones + 0.5) / (zeros + ones + 1)


def suffix(grams: np.ndarray, depth: int) -> np.ndarray:
    """Grams cut to a byte and the ``depth`` bytes before it."""
    return grams & np.uint64((1 << 8 * (depth + 1)) - 1)


class Nodes:
    """One bit's nodes in all contexts of one depth: a node is a context and the byte's bits before that one."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, bit: int):
        prefix = grams >> np.uint64(8 - bit)
        new = np.append(True, prefix[1:] != prefix[:-1])
        self.of, self.first = np.cumsum(new) - 1, np.flatnonzero(new)
        self.ones = np.add.reduceat(np.where(grams >> np.uint64(7 - bit) & np.uint64(1), counts, 0), self.first)
        self.zeros = np.add.reduceat(counts, self.first) - self.ones
        #: The node's place among the 255 of a byte.
        self.place = (np.uint64(1 << bit) | (grams[self.first] & np.uint64(255)) >> np.uint64(8 - bit)).astype(int) - 1


class Tree:
    """The contexts from two bytes on that end in the same two bytes, for some grams of full depth."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int):
        """Distinct grams in order and how often each stands in the training texts, 0 included."""
        self.depth, self.grams, self.counts, self.into = depth, {depth: grams}, {depth: counts}, {}
        for d in range(depth - 1, 1, -1):
            self.grams[d], self.into[d + 1] = np.unique(suffix(self.grams[d + 1], d), return_inverse=True)
            self.counts[d] = np.bincount(self.into[d + 1], self.counts[d + 1]).astype(np.int64)

    def weigh(self, bit: int) -> dict[int, Nodes]:
        """The bit's nodes at each depth, their weights set from the deepest on."""
        out: dict[int, Nodes] = {}
        for d in range(self.depth, 1, -1):
            out[d] = here = Nodes(self.grams[d], self.counts[d], bit)
            here.weighted = log_kt(here.zeros, here.ones)
            if d < self.depth:
                below = out[d + 1]
                below.parent = here.of[self.into[d + 1][below.first]]
                here.weighted, here.weight = mixture(here.weighted, np.bincount(below.parent, below.weighted, len(here.first)))
        return out

    def top(self) -> tuple[int, np.ndarray, np.ndarray]:
        """The newer byte of the two, the counts of the bytes after both, and the weighted logarithms of their 255 nodes."""
        counts, weighted = np.zeros(256, np.int64), np.zeros(255)
        counts[(self.grams[2] & np.uint64(255)).astype(int)] = self.counts[2]
        for bit in range(8):
            nodes = self.weigh(bit)[2]
            weighted[nodes.place] = nodes.weighted
        return int(self.grams[2][0] >> np.uint64(8) & np.uint64(255)), counts, weighted

    def logs(self, crown: Crown) -> np.ndarray:
        """log10 of each gram's last byte after its context.

        A bit's probability mixes the estimates of the contexts on its path by
        their weights. The path ends at the deepest context that has met the bits
        before it; that one's estimate takes all the weight that is left.
        """
        grams = self.grams[self.depth]
        newest, out = int(grams[0] >> np.uint64(8) & np.uint64(255)), np.zeros(len(grams))
        for bit in range(8):
            nodes = self.weigh(bit)
            base, share, mixed = (x[newest][nodes[2].place] for x in (crown.base, crown.share, crown.mixed))
            for d in range(2, self.depth + 1):
                here = nodes[d]
                if d > 2:
                    base, share, mixed = base[here.parent], share[here.parent], mixed[here.parent]
                kt = estimate(here.zeros, here.ones)
                mixed = np.where(here.zeros + here.ones > 0, base + share * kt, mixed)
                if d < self.depth:
                    base, share = base + share * here.weight * kt, share * (1 - here.weight)
            one = np.clip(mixed, 1e-12, 1 - 1e-12)[nodes[self.depth].of]
            out += np.log10(np.where(grams >> np.uint64(7 - bit) & np.uint64(1), one, 1 - one))
        return out


class Crown:
    """Depths 0 and 1 of the tree, in dense tables."""

    def __init__(self, newest: np.ndarray, counts: np.ndarray, weighted: np.ndarray):
        """For each two-byte context, or sum of those with the same newer byte: that byte, the byte counts, the weighted logarithms."""
        near, below = np.zeros((256, 256), np.int64), np.zeros((256, 255))
        np.add.at(near, newest, counts)
        np.add.at(below, newest, weighted)
        zeros, ones = bit_counts(near)
        seen, near_kt, (near_log, near_own) = zeros + ones > 0, estimate(zeros, ones), mixture(log_kt(zeros, ones), below)
        zeros, ones = bit_counts(near.sum(axis=0, keepdims=True))
        root_kt, (_, root_own) = estimate(zeros, ones), mixture(log_kt(zeros, ones), near_log.sum(axis=0, keepdims=True))
        # A one's probability is base + share * (what the deeper contexts say), or mixed if there are none.
        base, share = root_own * root_kt, 1 - root_own
        self.mixed = np.where(seen, base + share * near_kt, root_kt)
        self.base, self.share = base + share * near_own * near_kt, share * (1 - near_own)


def grams_of(text: bytes, depth: int = DEPTH) -> np.ndarray:
    """The gram of each byte of a text and of its end: the byte after the ``depth`` before it."""
    b = np.frombuffer(bytes([MARK]) * depth + text + bytes([MARK]), np.uint8).astype(np.uint64)
    n = len(b) - depth
    out = b[:n].copy()
    for i in range(1, depth + 1):
        out = out << np.uint64(8) | b[i : i + n]
    return out


def count_grams(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, n): how often each gram of all texts stands in those not held out. Each task adds up its own first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        raw: dict[bool, list[np.ndarray]] = {True: [], False: []}
        size = 0

        def fold() -> None:
            for out, arrays in raw.items():
                if arrays:
                    keys, n = np.unique(np.concatenate(arrays), return_counts=True)
                    held.append((keys, n * (not out)))
                    arrays.clear()
            if len(held) > 1:
                keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
                held[:] = [(keys, np.bincount(where, np.concatenate([n for _, n in held])))]

        def rows_() -> pd.DataFrame:
            keys, n = held.pop() if held else (np.empty(0, np.uint64), np.empty(0))
            return pd.DataFrame({"gram": keys.astype(np.int64), "n": n.astype(np.int64)})

        for batch in batches:
            for text, out in zip(batch["text"], batch["held_out"], strict=True):
                raw[bool(out)].append(grams_of(text.encode(), depth))
                size += len(text) + 1
                if size > 2_000_000:
                    size = 0
                    fold()
                    if len(held[0][0]) > 4_000_000:
                        yield rows_()
        fold()
        yield rows_()

    return rows.select("text", "held_out").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def tree_of(unit: pd.DataFrame, depth: int) -> Tree:
    rows = unit.sort_values("gram")
    return Tree(rows["gram"].to_numpy().astype(np.uint64), rows["n"].to_numpy(np.int64), depth)


def fit_tree(grams: DataFrame, buckets: int, depth: int = DEPTH) -> DataFrame:
    """(gram, value, bucket): log10 of the last byte's probability for each gram of all texts.

    KT estimates depend on counts alone, which Spark adds up. The grams of each
    two-byte context are weighed by themselves; of those contexts the sums by
    their newer byte, 256 rows at most, make the crown. Its weights go back to
    the contexts, which give each gram its value.
    """
    units = grams.withColumn("unit", F.col("gram").bitwiseAND(0xFFFF00))

    def top(unit: pd.DataFrame) -> pd.DataFrame:
        newest, counts, weighted = tree_of(unit, depth).top()
        return pd.DataFrame({"newest": [newest], "counts": [counts.tobytes()], "weighted": [weighted.tobytes()]})

    def add(tops: pd.DataFrame) -> pd.DataFrame:
        counts, weighted = (np.frombuffer(b"".join(tops[c]), t).reshape(len(tops), -1).sum(axis=0) for c, t in (("counts", np.int64), ("weighted", float)))
        return pd.DataFrame({"newest": tops["newest"].iloc[:1], "counts": [counts.tobytes()], "weighted": [weighted.tobytes()]})

    packed = "newest int, counts binary, weighted binary"
    tops = units.groupBy("unit").applyInPandas(top, packed).groupBy("newest").applyInPandas(add, packed).toPandas()
    shaped = lambda c, n, t: np.frombuffer(b"".join(tops[c]), t).reshape(-1, n)
    crown = Crown(tops["newest"].to_numpy(int), shaped("counts", 256, np.int64), shaped("weighted", 255, float))
    sent = grams.sparkSession.sparkContext.broadcast(crown)

    def fill(unit: pd.DataFrame) -> pd.DataFrame:
        tree = tree_of(unit, depth)
        keys = tree.grams[depth]
        return pd.DataFrame({"gram": keys.astype(np.int64), "value": tree.logs(sent.value).astype(np.float32), "bucket": bucket_of(keys, buckets)})

    return units.groupBy("unit").applyInPandas(fill, "gram long, value float, bucket int")


# --- blocks of texts meet the model bucket by bucket


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(grams) % np.uint64(buckets)).astype(np.int32)


def by_bucket(bucket: np.ndarray) -> np.ndarray:
    """The order of grams by bucket, as they are within one. Two bytes at a time are dealt out, not compared."""
    order = np.argsort((bucket & 0xFFFF).astype(np.uint16), kind="stable")
    high = bucket[order] >> 16
    return order[np.argsort(high.astype(np.uint16), kind="stable")] if high.any() else order


def pack(grams: np.ndarray, depth: int = DEPTH) -> bytes:
    """Grams in order, compressed: their highest bytes first, then the next."""
    planes = grams.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 7 - depth :].T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(raw: bytes, depth: int = DEPTH) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(depth + 1, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 7 - depth :] = planes.T
    return out.view(">u8").ravel().astype(np.uint64)


def pack_rows(rows: pd.DataFrame) -> bytes:
    """Rows as one compressed Arrow stream."""
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_rows(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_pandas()


def distinct(grams: np.ndarray) -> np.ndarray:
    """The distinct grams, in order."""
    ordered = np.sort(grams)  # several times as fast as np.unique
    return ordered[np.append(True, ordered[1:] != ordered[:-1])]


def joined_grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all texts one after another, and where each text's begin."""
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    out = np.empty(starts[-1], np.uint64)
    for text, start, end in zip(texts, starts, starts[1:]):
        out[start:end] = grams_of(text, depth)
    return out, starts[:-1]


BLOCKS = "block long, bucket int, packed binary"


def write_blocks(rows: DataFrame, path: str, buckets: int, depth: int = DEPTH) -> None:
    """Writes the texts in blocks of about ``BLOCK`` bytes, and what each block asks of each bucket.

    A block's texts are one row without a bucket; what it asks of a bucket is one more.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def emit() -> Iterator[pd.DataFrame]:
            texts = pd.concat(held, ignore_index=True)
            grams = distinct(joined_grams([t.encode() for t in texts["text"]], depth)[0])
            bucket = bucket_of(grams, buckets)
            order = by_bucket(bucket)
            ends = np.flatnonzero(np.diff(bucket[order])) + 1
            asked = [(block, int(bucket[g[0]]), pack(grams[g], depth)) for g in np.split(order, ends)]
            out = pd.DataFrame([(block, None, pack_rows(texts)), *asked], columns=["block", "bucket", "packed"])
            yield out.astype({"bucket": "Int32"})

        for batch in batches:
            sizes = batch["text"].str.len().to_numpy()
            start = 0
            for i, n in enumerate(sizes.tolist()):
                size += n
                if size >= BLOCK:
                    held.append(batch.iloc[start : i + 1])
                    yield from emit()
                    block, held, size, start = block + 1, [], 0, i + 1
            if start < len(batch):
                held.append(batch.iloc[start:])
        if held:
            yield from emit()

    rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(cut, BLOCKS).write.parquet(path)


def answer(model: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The values of the grams that blocks ask of one bucket, in their order."""
    order = np.argsort(model["gram"].to_numpy())
    keys, values = model["gram"].to_numpy()[order].astype(np.uint64), model["value"].to_numpy(np.float32)[order]
    found = [values[np.searchsorted(keys, unpack(g))].tobytes() for g in asked["packed"]]
    return pd.DataFrame({"block": asked["block"], "bucket": asked["bucket"], "found": found})


def score_block(texts: list[bytes], answers: pd.DataFrame, buckets: int) -> np.ndarray:
    """The sum of each text's grams, from the answers to its block."""
    grams, starts = joined_grams(texts)
    keys = distinct(grams)
    values = np.empty(len(keys), np.float32)
    values[by_bucket(bucket_of(keys, buckets))] = np.frombuffer(b"".join(answers.sort_values("bucket")["found"]), np.float32)
    out = np.empty(len(grams), np.float32)
    places = np.arange(PIECE, dtype=np.uint64)
    for i in range(0, len(grams), PIECE):
        # Sorted with their places: equal grams stand together and are looked up once.
        some = grams[i : i + PIECE] << np.uint64(16) | places[: len(grams) - i]
        some.sort()
        gram = some >> np.uint64(16)
        new = np.append(True, gram[1:] != gram[:-1])
        out[i : i + PIECE][(some & np.uint64(0xFFFF)).astype(np.intp)] = values[np.searchsorted(keys, gram[new])][np.cumsum(new) - 1]
    return np.add.reduceat(out, starts, dtype=float)


# --- the scores


def score_documents(docs: DataFrame, folds: int = 10, frequent: int = FREQUENT) -> DataFrame:
    """Scores every whole text, learning from those whose fold isn't 0.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score
    and bits_per_byte (the code length by the tree). The base's tokens are words
    with A-Z in lower case and one end; their counts over all training texts are
    kept by a 64-bit hash. The counts of the most common words, ``frequent`` at
    most, go to every task; a text's other words are dealt out to meet theirs, one row for
    each word of a text. Null and empty texts are an end alone; repeated rows
    each get their scores; without training texts the base counts nothing and the
    tree expects every bit alike. The tree gives every gram of all
    texts its value by Spark; texts lie in blocks, which ask for the values of
    their distinct grams bucket by bucket, so that no task and no driver holds the
    model. Null ids count as the empty text in the fold.
    """
    held_out = remainder(F.col("doc_id"), folds) == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text"))[1], held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    train = rows.filter(~F.col("held_out"))
    # A-Z and white space are replaced together; a single blank is split at without a pattern.
    plain = F.translate("text", UPPER + WHITE, LOWER + " " * len(WHITE))
    words = train.select(F.explode(F.split(plain, " ")).alias("word")).filter("word <> ''")
    counts = settle(words.select(F.xxhash64("word").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")))
    n_train = train.count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n + n_train, v + (n_train > 0)
    top = most_frequent(counts, frequent, "c").toPandas()
    context = docs.sparkSession.sparkContext
    known = context.broadcast((top["h"].to_numpy(), top["c"].to_numpy()))
    grams = settle(count_grams(rows))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(grams.count() // BUCKET_GRAMS, size // BUCKET_BYTES) + 1
    path = shared_dir(docs.sparkSession, "lm-blocks")
    write_blocks(rows, path, buckets)
    written = docs.sparkSession.read.schema(BLOCKS).parquet(path)
    asked = written.filter("bucket IS NOT NULL")
    answers = fit_tree(grams, buckets).groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(answer, "block long, bucket int, found binary")
    total = n + 0.1 * (v + 1)
    end = log10((n_train + 0.1) / total)

    def score(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        texts = unpack_rows(block["packed"].iloc[0])
        hashes, seen = known.value
        common = dict(zip(hashes.tolist(), seen.tolist(), strict=True))
        logs: dict[bytes, float] = {}  # of frequent words
        others: dict[bytes, int] = {}  # hashes of other words
        out, raws = [], [t.encode() for t in texts["text"]]
        scores = score_block(raws, answers, buckets)
        for raw, by_tree in zip(raws, scores.tolist(), strict=True):
            found = Counter(raw.lower().split())
            words, times = list(found), list(found.values())
            for word in words:
                if word not in logs and word not in others:
                    h = xxhash.xxh64_intdigest(word, seed=42)
                    h = h - (1 << 64) if h >> 63 else h
                    if h in common:
                        logs[word] = log10((common[h] + 0.1) / total)
                    else:
                        others[word] = h
            values = list(map(logs.get, words))
            rare = [(others[w], t) for w, t, x in zip(words, times, values, strict=True) if x is None]
            base = end + sum(x * t for x, t in zip(values, times, strict=True) if x is not None)
            n = sum(times)
            out.append((n + 1, int(n_train > 0) + n - sum(t for _, t in rare), base, by_tree, len(raw), [h for h, _ in rare], [t for _, t in rare]))
        return pd.concat([texts[["doc_id", "k2", "held_out"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_tokens", "n_known", "base", "score", "n_bytes", "rare", "times"])], axis=1)

    schema = "doc_id string, k2 long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, rare array<long>, times array<int>"
    texts = written.filter("bucket IS NULL").select("block", "packed")
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
    # Each text's rare words become rows; the first of them carries the rest of the text's row.
    whole = F.struct("held_out", "n_tokens", "n_known", "base", "score", "n_bytes")
    rare = scored.select("doc_id", "k2", whole.alias("whole"), F.posexplode_outer(F.arrays_zip("rare", "times")).alias("pos", "w"))
    rare = rare.select("doc_id", "k2", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("whole")).alias("whole"), F.col("w.rare").alias("h"), F.col("w.times").alias("tf"))
    met = rare.join(counts, "h", "left")
    c = F.coalesce("c", F.lit(0))
    parts = met.groupBy("doc_id", "k2").agg(
        F.count("whole").alias("copies"), F.max("whole").alias("whole"),
        F.sum(F.coalesce("tf", F.lit(0)) * F.log10((c + 0.1) / total)).alias("base"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("known"),
    )
    # Rows that share id and text have added up: each gets its share.
    one = parts.select("doc_id", F.explode(F.array_repeat("whole", F.col("copies").cast("int"))).alias("whole"), (F.coalesce("base", F.lit(0.0)) / F.col("copies")).alias("base"), (F.coalesce("known", F.lit(0)) / F.col("copies")).cast("long").alias("known"))
    score_of = F.col("whole.score")
    return one.select(
        "doc_id", "whole.held_out", "whole.n_tokens", (F.col("whole.n_known") + F.col("known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("whole.base") + F.col("base")).alias("base_score"), score_of.alias("score"),
        (-score_of / F.log10(F.lit(2.0)) / F.greatest("whole.n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
