"""BPE encoding and decoding with a transducer lexicon of frequent words."""

from __future__ import annotations

import hashlib
import mmap
import os
import struct
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import most_frequent, settle, small_batches
from .tokens import BYTE_LEVEL_SPLIT, UNUSUAL, by_size, encoder, encoders

LEXICON_WORDS = 65_536
#: Words counted at a time in one task.
COUNTED = 200_000

DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


# --- the lexicon: a minimal acyclic transducer over bytes


def build_transducer(words: dict[bytes, list[int]]) -> bytes:
    """Compiles words with id outputs.

    Words are added in order; whenever one leaves a branch for good, the branch's
    states are merged with equal ones, so that common endings are stored once and
    the automaton is minimal. An arc's output is the number of words that come
    before those behind it; along a word's path outputs add up to its rank, which
    points into the table of ids. Layout (little-endian): counts; arcs in order of
    state and label, with outputs and targets; per word the end of its ids; all
    ids; which states are final.
    """
    states: list[tuple[dict[int, int], bool]] = []
    register: dict[tuple, int] = {}
    behind: list[int] = []  # words that a state accepts

    def fold(arcs: dict[int, int], final: bool) -> int:
        key = (final, *sorted(arcs.items()))
        if key not in register:
            register[key] = len(states)
            states.append((arcs, final))
            behind.append(final + sum(behind[t] for t in arcs.values()))
        return register[key]

    path: list[list] = [[{}, False]]
    before = b""
    ordered = sorted(words)
    for word in ordered:
        common = len(os.path.commonprefix([word, before]))
        for depth in range(len(before), common, -1):
            arcs, final = path.pop()
            path[-1][0][before[depth - 1]] = fold(arcs, final)
        path.extend([{}, False] for _ in range(len(word) - common))
        path[-1][1] = True
        before = word
    for depth in range(len(before), 0, -1):
        arcs, final = path.pop()
        path[-1][0][before[depth - 1]] = fold(arcs, final)
    root = fold(*path[0])

    arcs_of, outputs, targets = [], [], []
    for state, (arcs, final) in enumerate(states):
        rank = int(final)
        for label, target in sorted(arcs.items()):
            arcs_of.append(state << 8 | label)
            outputs.append(rank)
            targets.append(target)
            rank += behind[target]
    ids = [i for w in ordered for i in words[w]]
    ends = np.cumsum([len(words[w]) for w in ordered]) if ordered else []
    kinds = (("<i8", arcs_of), ("<u4", outputs), ("<u4", targets), ("<u4", ends), ("<u4", ids), ("u1", [f for _, f in states]))
    head = struct.pack("<5Q", len(states), len(arcs_of), len(ordered), len(ids), root)
    return head + b"".join(np.array(x, kind).tobytes() for kind, x in kinds)


class Transducer:
    """A compiled lexicon, read in place from a buffer such as a mapped file."""

    def __init__(self, data):
        n_states, n_arcs, n_words, n_ids, self.root = struct.unpack_from("<5Q", data)
        at, out = 40, []
        for kind, n in (("<i8", n_arcs), ("<u4", n_arcs), ("<u4", n_arcs), ("<u4", n_words), ("<u4", n_ids), ("u1", n_states)):
            out.append(np.frombuffer(data, kind, n, at))
            at += out[-1].nbytes
        self.arcs, self.outputs, self.targets, self.ends, self.ids, self.finals = out

    def look_up(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None if it isn't in the lexicon."""
        return self.look_up_all([word])[0]

    def look_up_all(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of many words, which walk the automaton side by side."""
        lengths = np.array([len(w) for w in words])
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = np.cumsum(lengths) - lengths
        state, rank, alive = np.full(len(words), self.root), np.zeros(len(words), np.int64), np.arange(len(words))
        for depth in range(lengths.max(initial=0)):
            alive = alive[lengths[alive] > depth]
            wanted = state[alive] << 8 | text[start[alive] + depth]
            arc = np.searchsorted(self.arcs, wanted)
            found = self.arcs[np.minimum(arc, len(self.arcs) - 1)] == wanted if len(self.arcs) else np.zeros(len(arc), bool)
            state[alive[~found]] = -1
            lengths[alive[~found]] = 0
            alive, arc = alive[found], arc[found]
            rank[alive] += self.outputs[arc]
            state[alive] = self.targets[arc]
        known = (state >= 0) & (self.finals[np.maximum(state, 0)] > 0)
        return [self.ids[self.ends[r - 1] if r else 0 : self.ends[r]].tolist() if k else None for r, k in zip(rank.tolist(), known.tolist(), strict=True)]


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """About the ``most`` most frequent words of letters only, over all documents.

    Each task keeps the counts of ``COUNTED`` words at most, dropping the rarest
    when it holds twice as many, and hands on its ``most`` first; Spark adds them
    up. Which words get into the lexicon decides about speed, never about ids.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                total.update((text or "").split(" "))
                if len(total) > 2 * COUNTED:
                    total = Counter(dict(total.most_common(COUNTED)))
        rows = [(w, n) for w, n in total.most_common(most) if w.isalpha()]
        yield pd.DataFrame(rows, columns=["word", "n"])

    counts = docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in most_frequent(settle(counts), most).collect()]


class Codec:
    """Encodes texts word by word and decodes ids.

    Words are what the pre-tokenizer's split gives. A word is taken from the
    lexicon, or else merged exactly, and remembered: two generations of up to
    ``keep`` words. Texts with unusual characters (see ``tokens``), and files whose
    ids don't tell the order of merges, go to the tokenizers library.
    """

    def __init__(self, path: str, lexicon: Transducer | None = None, keep: int = 50_000):
        self.encoder = encoder(path)
        self.lexicon, self.keep = lexicon, keep
        self.split = regex.compile(BYTE_LEVEL_SPLIT)
        vocabulary = self.encoder.vocabulary
        self.bytes_of = [vocabulary.bytes_of.get(i, b"") for i in range(vocabulary.size)]
        self.fixed = {mark: array(self.encoder.code, [i]).tobytes() for mark, i in vocabulary.special.items()}
        self.new: dict[str, bytes] = dict(self.fixed)
        self.old: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if self.encoder.marks is None:
            return self.split.findall(text)
        out = []
        for i, part in enumerate(self.encoder.marks.split(text)):
            out.extend(self.split.findall(part) if i % 2 == 0 else [part])
        return out

    def _learn(self, words: set[str]) -> None:
        again = {w: self.old[w] for w in words if w in self.old}
        self.new.update(again)
        unseen = list(words.difference(again))
        ids = self.lexicon.look_up_all([w.encode() for w in unseen]) if self.lexicon and unseen else [None] * len(unseen)
        for w, found in zip(unseen, ids, strict=True):
            self.new[w] = array(self.encoder.code, self.encoder.quick.encode_ordinary(w) if found is None else found).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text; a null text is empty."""
        plain = [bool(t) and self.encoder.quick is not None and not UNUSUAL.search(t) for t in texts]
        cut = [self.words(t) if p else None for t, p in zip(texts, plain, strict=True)]
        unseen: set[str] = set()
        for words in cut:
            unseen.update(words or ())
        if len(self.new) > self.keep:
            self.old, self.new = self.new, dict(self.fixed)
        self._learn(unseen.difference(self.new))
        return [self.encoder.encode(t) if words is None else b"".join(map(self.new.__getitem__, words)) for t, words in zip(texts, cut, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


#: What this driver has handed out: (application, name of the file).
_published: set[tuple[str, str]] = set()


def publish(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> str:
    """Compiles the lexicon of ``docs`` and hands it to all executors as a file.

    Returns the file's name. The lexicon is bounded by ``most`` words.
    """
    encode = encoder(path)
    code = encode.dtype
    words = [" " + w for w in frequent_words(docs, most)]
    data = build_transducer({w.encode(): np.frombuffer(encode.encode(w), code).tolist() for w in words})
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    context = docs.sparkSession.sparkContext
    if (context.applicationId, name) not in _published:
        local = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
        with open(local, "wb") as f:
            f.write(data)
        context.addFile(local)
        _published.add((context.applicationId, name))
    return name


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, name: str) -> Codec:
    """This process's codec, its lexicon mapped into memory."""
    if (path, name) not in _codecs:
        with open(SparkFiles.get(name), "rb") as f:
            mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        _codecs.clear()
        _codecs[path, name] = Codec(path, Transducer(mapped))
    return _codecs[path, name]


def release() -> None:
    """Lets go of this process's codecs and encoders."""
    _codecs.clear()
    encoders.clear()


def encode_documents(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> DataFrame:
    """``docs`` with the columns ids (packed integers of ``id_bytes`` bytes) and id_bytes.

    Ids are those of the tokenizers library without added special tokens. Null
    and empty texts have none; all rows and other columns are kept, but a column
    named ids or id_bytes is replaced.
    """
    name = publish(docs, path, most)

    @F.pandas_udf(T.BinaryType())
    def encode(texts: pd.Series) -> pd.Series:
        use, out = codec(path, name), []
        values = texts.tolist()
        for cut in by_size(values):
            out.extend(use.encode(values[cut]))
        return pd.Series(out)

    return docs.withColumn("ids", encode("text")).withColumn("id_bytes", F.lit(encoder(path).dtype.itemsize))


def decode_documents(encoded: DataFrame, path: str, column: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in a column of its own.

    Null ids stay null, no ids are the empty text. All rows and other columns are
    kept, but for a column of that name, which is replaced. The ids must be those
    of the same tokenizer file.
    """

    @F.pandas_udf(T.StringType())
    def decode(ids: pd.Series) -> pd.Series:
        plain = next((c for (known, _), c in _codecs.items() if known == path), None) or _codecs.setdefault((path, ""), Codec(path))
        return pd.Series([None if x is None else plain.decode(np.frombuffer(x, plain.encoder.dtype)) for x in ids])

    return encoded.withColumn(column, decode("ids"))


def round_trip(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> DataFrame:
    """``docs`` with the digests of its ids and of their decoded text, without keeping either.

    Adds n_tokens, ids_sha256 (of the ids as 32-bit integers) and decoded_sha256;
    columns of these names are replaced. Null texts count as empty, which have no
    ids; repeated rows and rows without an id are kept like all others.
    """
    small_batches(docs.sparkSession)
    name = publish(docs, path, most)

    @F.pandas_udf(DIGESTS)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            use, out, values = codec(path, name), [], texts.tolist()
            for cut in by_size(values):
                for packed in use.encode(values[cut]):
                    ids = np.frombuffer(packed, use.encoder.dtype)
                    out.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(use.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(out, columns=DIGESTS.names)
        release()  # the worker may go on to other work

    return docs.withColumn("__digest", digest("text")).select(*(docs[c] for c in docs.columns if c not in DIGESTS.names), "__digest.*")
