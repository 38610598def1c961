"""Encoding whole texts with a public tokenizer file, exactly as its library does."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters on which every Unicode version of the last ten years agrees
#: whether they are letters, digits or white space; a text with any other goes
#: through the tokenizers library itself.
UNUSUAL = re.compile("[^\u0000-ԯ -⁯₠-₽℀-↊←-⏺─-⮹　-〿ぁ-ゖ゙-ヿ一-鿕가-힣！-￮]")
#: Fixed: the split that a ByteLevel pre-tokenizer with use_regex makes.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, inverted.

    Printable Latin-1 characters stand for themselves, the others, in order, for
    the code points from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """What a byte-level BPE file holds: the bytes of each id, and special tokens.

    ``ranks`` maps bytes to ids, or is None if the order of the merges isn't that
    of the ids, so that an id doesn't tell when its merge is due.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.ranks: dict[bytes, int] | None = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.ranks.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"].get(a + b, -1) for a, b in pairs]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": spec["pre_tokenizer"].get("trim_offsets"), "use_regex": True}
        flags = ("single_word", "lstrip", "rstrip")
        plain = plain and not any(t[f] for t in spec["added_tokens"] for f in flags) and not model.get("ignore_merges")
        if not plain or made != sorted(made) or any(len(self.bytes_of[i]) > 1 for i in set(self.ranks.values()) - set(made)):
            self.ranks = None
        self.size = 1 + max(self.bytes_of)


class Encoder:
    """Ids of texts as packed integers, two bytes each if they fit and else four.

    Where ids tell the order of merges, texts in common scripts go through a
    second implementation of the same merges, about four times as fast; special
    tokens inside a text become their ids, as is the library's default. Every
    other text, and every other vocabulary, goes through the library.
    """

    def __init__(self, path: str):
        self.path = path
        self.vocabulary = Vocabulary(path)
        self.code = "H" if self.vocabulary.size <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        self.quick = None
        if self.vocabulary.ranks is not None:
            import tiktoken

            self.quick = tiktoken.Encoding("merges", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=self.vocabulary.ranks, special_tokens={})
            marks = sorted(self.vocabulary.special, key=len, reverse=True)
            self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None

    @cached_property
    def library(self):
        """The tokenizers library's own encoder, loaded when a text needs it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def encode(self, text: str | None) -> bytes:
        """The packed ids of one text; a null text has none."""
        if not text:
            return b""
        if self.quick is None or UNUSUAL.search(text):
            return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if self.marks is None or not self.marks.search(text):
            return array(self.code, self.quick.encode_ordinary(text)).tobytes()
        parts = self.marks.split(text)
        ids = [self.quick.encode_ordinary(p) if i % 2 == 0 else [self.vocabulary.special[p]] for i, p in enumerate(parts)]
        return array(self.code, [i for part in ids for i in part]).tobytes()


encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a file."""
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


def by_size(texts: Iterable[str | bytes | None], most: int = 1_000_000) -> Iterator[slice]:
    """Slices of ``texts`` of about ``most`` characters, one text at least."""
    start, total, i = 0, 0, -1
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= most:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start <= i:
        yield slice(start, i + 1)
