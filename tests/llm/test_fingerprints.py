"""Fingerprints against a plain walk and a plain order of documents."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import fingerprints as fp

ROWS = "doc_id long, text string, part int, head string, tail string, mix long, fingerprint string"


def plain(text):
    """The fingerprint by one step after the other."""
    w, step, steps = fp.walks(), 0, []
    chars = fp._chars(text)
    for c in fp._classes(chars):
        steps.append(step)
        step += int(w.waits[step % fp.PERIOD][c])
    return w.sample(chars, np.array(steps, np.int64), step)


def words(r, n):
    return " ".join(r.choice(["alpha", "beta", "Gamma,", "delta.", "épée", "日本", "of"]) + str(r.randrange(50)) for _ in range(n))


def some_texts():
    r = random.Random(13)
    out = [words(r, r.randrange(1, 200)) for _ in range(90)]
    return [*out, "", "a", "ab", "abc", "🎉🎉🎉🎉", out[0], words(r, 20_000), "x" * 5000, "\x00\n"]


def test_waits_are_those_of_the_coins():
    w = fp.walks()
    assert w.waits.min() >= 1 and 1.8 < w.waits.mean() < 2.2
    # From one step to the next the wait is one less, unless it was the head itself.
    later = np.roll(w.waits, -1, axis=0)
    assert (later[w.waits > 1] == w.waits[w.waits > 1] - 1).all()


@pytest.mark.parametrize("abreast", [1, 8, 10_000])
def test_walks_abreast_and_alone(monkeypatch, abreast):
    monkeypatch.setattr(fp, "ABREAST", abreast)
    texts = some_texts()
    edits = [fp.edited(t, f) for t, f in zip(texts, texts[1:], strict=False)]
    own, other = fp.fingerprints(texts, edits)
    assert own == [plain(t) for t in texts]
    assert other == [plain(e) for e, _ in edits]


def in_order(rows):
    key = lambda x: (x[0] is None, -(x[0] or 0), np.int64(np.uint64(xxhash.xxh64_intdigest((x[1] or "").encode(), seed=42))), x[1] or "")
    return sorted(rows, key=key)


def expected(rows):
    ordered, out = in_order(rows), []
    for k, (i, t) in enumerate(ordered):
        t, f = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        e = t[: len(t) - len(t) // 3] + f[: len(t) // 3]
        p, q = plain(t), plain(e)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), p.hex(), q.hex(), fp.likeness(p, q), fp.likeness(p, plain(f))))
    return sorted(map(str, out))


@pytest.mark.parametrize("n", [0, 1, 2, 40, 99])
def test_fingerprints(spark, n):
    """Nulls, empties, repeats, rows of one id, one row, none, over several ranges."""
    rows = list(enumerate(some_texts()))[::-1][:n]
    if n > 2:
        rows += [(None, "nobody's"), (None, None), (5, "another of this id"), (5, None), rows[3], rows[3]]
    df = spark.createDataFrame([(i, t, 1, "h", "t", 2, "f") for i, t in rows], ROWS).repartition(3)
    got = fp.fingerprint_documents(df).collect()
    assert sorted(str(tuple(r)[:7]) for r in got) == expected(rows)


def test_likeness_tells_edits_from_others():
    """Scattered edits and a new end leave texts alike; other texts are not."""
    r = random.Random(1)
    texts = [words(r, 150) for _ in range(60)]
    own = fp.fingerprints(texts)[0]
    few = []
    for t in texts:
        s = list(t)
        for _ in range(4):
            k = r.randrange(len(s))
            s[k : k + r.randrange(2)] = [r.choice("xyz")] * r.randrange(2)
        few.append("".join(s))
    edited = fp.fingerprints(few)[0]
    ends = fp.fingerprints(texts, [fp.edited(t, f) for t, f in zip(texts, texts[1:] + texts[:1], strict=True)])[1]
    near = [fp.likeness(a, b) for a, b in zip(own, edited, strict=True)]
    third = [fp.likeness(a, b) for a, b in zip(own, ends, strict=True)]
    other = [fp.likeness(a, b) for a, b in zip(own, own[1:], strict=False)]
    assert np.mean(near) > 0.6 and min(third) > 0.45 and max(other) < 0.25
    assert fp.likeness(own[0], own[0]) == 1


def test_column_of_likeness(spark):
    own = fp.fingerprints(some_texts())[0]
    rows = [(a.hex(), b.hex()) for a, b in zip(own, own[1:], strict=False)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(fp.hex_likeness(df["a"], df["b"])).collect()]
    assert got == pytest.approx([fp.likeness(a, b) for a, b in zip(own, own[1:], strict=False)])


def test_bands_find_near_copies(spark):
    """Copies of one text and of its edits are linked to a star; others aren't; links grow with the texts only."""
    r = random.Random(4)
    base = words(r, 400)
    rows = [(i, words(r, 100)) for i in range(50)]
    rows += [(100 + i, base[: 1500 + i] + "!" + base[1500 + i :]) for i in range(40)] + [(200 + i, base) for i in range(40)] + [(None, base), (300, None), (301, "")]
    found = fp.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    links = fp.near_copies(found).collect()
    assert all(x["of"] < x["doc_id"] for x in links)
    linked = {x["doc_id"] for x in links}
    assert linked >= set(range(201, 240)) and len(linked & set(range(101, 140))) > 35 and not linked & set(range(50)) and linked >= {301}
    assert len(links) < 90 * fp.BITS // fp.BAND_BITS
