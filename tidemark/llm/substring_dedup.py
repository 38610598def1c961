"""Removal of repeated passages with suffix automata of reference shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, gather, narrow, row_key, settle, small_batches, word_hashes
from .near_dedup import mix

LENGTH = 35
#: Words of the short run by which windows find each other.
GRAM = 5
#: About so many words go into one reference shard.
SHARD_WORDS = 100_000
#: An anchor with more distinct fragments has its windows added up one by one.
CROWDED = 1_000

MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


class Hashes:
    """Hashes of runs of a sequence of words, by differences of sums of powers."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * np.cumprod(np.full(n, MULTIPLIER, np.uint64)), out=self.sums[1:])
        self.back = np.cumprod(np.full(n, INVERSE, np.uint64))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def fragments(words: np.ndarray, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Cuts the windows of documents into fragments: (document, start, windows, anchor, content).

    ``words`` are those of several documents, one after another, ``sizes`` their
    numbers. Each window picks the least of its hashed runs of ``gram`` words, the
    first of equal ones. Successive windows that pick the same place form a
    fragment. Equal windows pick equal runs at the same place, wherever they
    stand, so only fragments with the same anchor can have a window in common, and
    each window is in one fragment. ``content`` hashes a fragment's words.
    """
    n = len(words)
    if n < length:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    runs = np.zeros(n - gram + 1, np.uint64)
    for i in range(gram):
        runs = mix(runs * np.uint64(MULTIPLIER) + words[i : i + len(runs)])
    picked = np.lib.stride_tricks.sliding_window_view(runs, length - gram + 1).argmin(axis=1) + np.arange(n - length + 1)
    firsts = np.cumsum(sizes) - sizes
    document = np.repeat(np.arange(len(sizes)), sizes)[: len(picked)]
    inside = np.arange(len(picked)) + length <= (firsts + sizes)[document]
    start = np.flatnonzero((np.diff(picked, prepend=-1) != 0) | (np.diff(document, prepend=-1) != 0))
    end = np.append(start[1:], len(picked))
    ends_inside = np.concatenate([[0], np.cumsum(inside)])
    count = ends_inside[end] - ends_inside[start]  # windows that run past their document come last
    start, count = start[count > 0], count[count > 0]
    content = Hashes(words).of(start, start + count + length - 1)
    of = document[start]
    return of, start - firsts[of], count, runs[picked[start]].view(np.int64), content.view(np.int64)


class SuffixAutomaton:
    """All runs of words of a reference shard, each with its number of occurrences.

    A state stands for the runs that end at the same places. ``add`` takes a
    sequence that occurs ``weight`` times.
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A copy of q that stands for its shorter runs, reached from p."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _step(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        here, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = here
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[here] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return here

    def add(self, words: list[int], weight: int) -> None:
        last = 0
        for word in words:
            last = self._step(last, word)
            self.count[last] += weight

    def close(self) -> None:
        """Adds the occurrences of longer runs to those of their suffixes."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def occurrences(self, words: list[int], length: int) -> list[int]:
        """For each window of ``length`` words of a stream how often the shard has it.

        Follows the longest suffix that the shard holds, shortened to ``length``.
        """
        out, state, matched = [], 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while self.length[self.link[state]] >= length:
                state = self.link[state]
            matched = min(matched, length)
            if i >= length - 1:
                out.append(self.count[state] if matched == length else 0)
        return out


def _ranges(flags: list[bool]) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.array([0, *flags, 0], np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _documents(batch: pa.RecordBatch, most: int = 250_000) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of a batch's documents with about ``most`` words: (slice, words, sizes)."""
    column = batch.column("words")
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most)))
        stop = min(stop, len(column))
        yield slice(at, stop), values[ends[at] : ends[stop]], np.diff(ends[at : stop + 1]).astype(np.int64)
        at = stop


def _table(columns: dict[str, np.ndarray | list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) for name, kind in types.items()], names=list(types))


def find_repeats(docs: DataFrame, length: int = LENGTH, shard_words: int = SHARD_WORDS, crowded: int = CROWDED) -> DataFrame:
    """(k1, k2, spans): where windows stand that start anywhere else as well.

    1. Every document is cut into fragments (see above), whose anchors are
       counted. Windows under an anchor that stands once can't repeat.
    2. The distinct fragments under the other anchors, with their numbers of
       occurrences, are the reference. Where an anchor has one fragment only, its
       number is that of all its windows. The others are dealt to shards by their
       anchor.
    3. In each shard a suffix automaton is built over its fragments; those that
       stand once are streamed through it, and windows with two occurrences or
       more are marked. All windows of a fragment that stands twice have as many.
    4. The windows of a crowded anchor's fragments, however many, are added up by
       their hashes instead, and no task holds them together.
    5. The marks go back to all places of each fragment.
    Spans are (start, end) in words.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*row_key(F.col("doc_id"), F.col("text")), "text")
    hashed = rows.select("k1", "k2", word_hashes(F.col("text")).alias("words"))
    long, small = pa.int64(), pa.int32()
    places_of = {"k1": long, "k2": long, "start": small, "windows": small, "anchor": long, "content": long}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in ("k1", "k2")]
            for part, words, sizes in _documents(batch):
                of, *found = fragments(words, sizes, length)
                yield _table(dict(zip(places_of, [keys[0][part][of], keys[1][part][of], *found], strict=True)), places_of)

    places = hashed.mapInArrow(cut, "k1 long, k2 long, start int, windows int, anchor long, content long")
    shared = gather(places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
    places = settle(places.join(shared, "anchor"))
    distinct = places.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k1", "k2", "start", "windows")).alias("at"))
    distinct = settle(distinct.select("anchor", "content", "times", "at.*"))
    per_anchor = gather(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).select("anchor", (F.col("n") > crowded).alias("crowded"), (F.col("n") == 1).alias("alone")))
    distinct = distinct.join(per_anchor, "anchor")
    several = distinct.filter("NOT alone AND NOT crowded")
    n_words = several.agg(F.sum(F.col("windows") + (length - 1))).first()[0] or 0
    n_shards = int(n_words // shard_words + 1)
    fields = ("anchor", "content", "times", "start", "windows")
    pieces_of = {"anchor": long, "content": long, "times": long, "words": pa.binary()}
    windows_of = {"k1": long, "k2": long, "start": long, "anchor": long, "window": long, "times": long}

    def texts_of(asked: DataFrame, small: bool = False) -> DataFrame:
        """Each text that represents fragments once, however often its row stands, with those fragments."""
        wanted = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct(*fields)).alias("wanted"))
        met = rows.join(F.broadcast(wanted) if small else wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
        return met.select("k1", "k2", word_hashes(F.col("text")).alias("words"), *(F.col(f"wanted.{f}").alias(f) for f in fields))

    def asked_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """Some documents' words, and of their fragments the document's row, the place among the words and the fields."""
        asked = {f: batch.column(f) for f in fields}
        ends = asked["anchor"].offsets.to_numpy()
        asked = {f: c.values.to_numpy(zero_copy_only=False) for f, c in asked.items()}
        for part, words, sizes in _documents(batch):
            mine, per_text = slice(ends[part.start], ends[part.stop]), np.diff(ends[part.start : part.stop + 1])
            base = np.repeat(np.cumsum(sizes) - sizes, per_text)
            yield words, np.repeat(np.arange(part.start, part.stop), per_text), base + asked["start"][mine], *(asked[f][mine] for f in fields)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of the fragments that represent their content."""
        for batch in batches:
            for words, _, first, anchor, content, times, _, windows in asked_of(batch):
                last = first + windows + length - 1
                raw = memoryview(np.ascontiguousarray(words)).cast("B")
                cuts = [raw[a:b].tobytes() for a, b in zip((first * 8).tolist(), (last * 8).tolist(), strict=True)]
                yield _table({"anchor": anchor, "content": content, "times": times, "words": cuts}, pieces_of)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of the fragments that represent their content, by hash."""
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in ("k1", "k2"))
            for words, of, first, anchor, _, times, start, windows in asked_of(batch):
                row = np.repeat(np.arange(len(anchor)), windows)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
                at = first[row] + offset
                found = (k1[of[row]], k2[of[row]], start[row] + offset, anchor[row], Hashes(words).of(at, at + length).view(np.int64), times[row])
                yield _table(dict(zip(windows_of, found, strict=True)), windows_of)

    pieces = texts_of(several).mapInArrow(fetch, "anchor long, content long, times long, words binary")
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(n_shards)))

    def match(shard: pd.DataFrame) -> pd.DataFrame:
        automaton, streams = SuffixAutomaton(), [np.frombuffer(w, np.int64).tolist() for w in shard["words"]]
        for words, times in zip(streams, shard["times"].tolist(), strict=True):
            automaton.add(words, times)
        automaton.close()
        out = []
        for words, times, anchor, content in zip(streams, *(shard[c].tolist() for c in ("times", "anchor", "content")), strict=True):
            if times > 1:
                continue
            for a, b in _ranges([n > 1 for n in automaton.occurrences(words, length)]):
                out.append((anchor, content, a, b - 1 + length))
        return pd.DataFrame(out, columns=["anchor", "content", "a", "b"])

    marks = sharded.groupBy("shard").applyInPandas(match, "anchor long, content long, a int, b int")
    whole = distinct.filter("times > 1").select("anchor", "content", F.lit(0).alias("a"), (F.col("windows") + (length - 1)).alias("b"))
    spans = places.select("k1", "k2", "anchor", "content", "start").join(marks.unionByName(whole), ["anchor", "content"])
    spans = spans.select("k1", "k2", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))
    dealt = distinct.filter("crowded")
    n_dealt = dealt.count()
    if n_dealt:
        windows = settle(texts_of(dealt, n_dealt * 64 <= BROADCAST_BYTES).mapInArrow(single, "k1 long, k2 long, start long, anchor long, window long, times long"))
        often = settle(windows.groupBy("anchor", "window").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor", "window"))
        # A fragment that stands once has one place, where it was read.
        met = windows.filter("times = 1").join(narrow(often), ["anchor", "window"])
        spans = spans.unionByName(met.select("k1", "k2", F.col("start").cast("int").alias("a"), (F.col("start") + length).cast("int").alias("b")))
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


_REPEATS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


@F.pandas_udf(_REPEATS)
def _remove(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for t, s in zip(text, spans, strict=True):
        words = (t or "").encode().split()
        gone = np.zeros(len(words) + 1, np.int32)
        for x in s if s is not None else []:
            gone[x["a"]] += 1
            gone[x["b"]] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        out.append((len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, column: str = "repeats") -> DataFrame:
    """``docs`` with a column ``repeats`` (n_words, n_removed, kept), or one of another name.

    A word goes if some window of ``length`` words that covers it starts anywhere
    else as well, in the same document or another; ``kept`` joins the others by
    one space. Null, empty and shorter texts lose nothing. Rows with the same id
    and text repeat each other like any copies. Other columns stay as they are.
    """
    keys = ["__k1", "__k2"]
    spans = find_repeats(docs, length).toDF(*keys, "__spans")
    named = docs.withColumns(dict(zip(keys, row_key(F.col("doc_id"), F.col("text")), strict=True)))
    return named.join(spans, keys, "left").withColumn(column, _remove(F.col("text"), F.col("__spans"))).drop(*keys, "__spans")


def kept_digest(repeats: Column) -> list[Column]:
    return [repeats["n_words"].alias("n_words"), repeats["n_removed"].alias("n_removed"), F.sha2(repeats["kept"], 256).alias("kept_sha256")]
