"""Vector codes against plain rounds over whole vectors."""

import hashlib
import math

import numpy as np
import pytest

from tidemark.llm import vector_codes as vc

ROWS = "vec_id long, embedding array<float>, label int, vector string, error long, of int"


def plain(rows, parts, entries, rounds):
    """vec_id, code, error, label_error and the digest, by Python integers."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    size = len(order[0][1]) // parts
    kept = [x for x in kept if len(x[1]) == size * parts]
    part = lambda v, p: v[p * size : (p + 1) * size]
    books = [[part(v, p) for _, v, _ in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(part(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            mine = [(near(v, p)[1], part(v, p)) for _, v, _ in kept]
            groups = [[v for k, v in mine if k == e] for e in range(len(books[p]))]
            new.append([[sum(c) // len(g) for c in zip(*g, strict=True)] if g else old for g, old in zip(groups, books[p], strict=True)])
        books = new
    found = [(i, label, [near(v, p) for p in range(parts)]) for i, v, label in kept]
    totals = {}
    for _, label, n in found:
        totals[label] = totals.get(label, 0) + sum(d for d, _ in n)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), totals[label], sha) for i, label, n in found)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "v", 1, 2) for i, v, label in rows], ROWS)


def some_vectors(n, width, seed=5):
    r = np.random.default_rng(seed)
    rows = [(i * 3, [float(x) for x in r.normal(0, 0.2, width).astype(np.float32)], int(i % 4) if i % 9 else None) for i in range(n)]
    rows += [(7, rows[0][1], 1), (7, rows[1][1], 1), (0, rows[0][1], None)]  # repeats and ties
    odd = [(1, None, 1), (2, [], 1), (4, [None] * width, 2), (5, [float("nan")] * width, 2), (8, [float("inf")] + [0.0] * (width - 1), 3), (None, rows[3][1], 3)]
    return [*odd, *rows]


@pytest.mark.parametrize("n,width,parts,entries,rounds", [(90, 16, 8, 16, 6), (40, 6, 2, 5, 3), (5, 16, 8, 16, 6), (60, 8, 8, 4, 2)])
def test_codes(spark, n, width, parts, entries, rounds):
    rows = some_vectors(n, width)
    got = vc.encode_vectors(frame(spark, rows), parts, entries, rounds).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain(rows, parts, entries, rounds)


def test_edges_of_the_table(spark):
    df = frame(spark, [(1, [0.5] * 8, 1)])
    assert vc.encode_vectors(df.limit(0)).collect() == []
    assert vc.encode_vectors(frame(spark, [(1, None, 1)])).count() == 0
    assert [tuple(r)[:4] for r in vc.encode_vectors(df).collect()] == [(1, "00" * 8, 0, 0)]
    # Other widths and components beyond the limit take no part.
    mixed = frame(spark, [(1, [0.5] * 8, 1), (2, [0.5] * 16, 1), (3, [1e30] + [0.0] * 7, 1)])
    assert [r["vec_id"] for r in vc.encode_vectors(mixed).collect()] == [1]
    with pytest.raises(ValueError, match="equal parts"):
        vc.encode_vectors(frame(spark, [(1, [0.5] * 9, 1)]))


@pytest.mark.parametrize("cell", [1, 16, 128, 5000])
def test_cells_keep_the_nearest(cell):
    """Whatever the grid, the entries kept for a box hold every point's nearest, ties included."""
    r = np.random.default_rng(cell)
    book = r.integers(-600, 600, (16, 8))
    book[5], book[9] = book[2], book[3]
    points = np.concatenate([r.integers(-900, 900, (3000, 8)), book, np.floor_divide(book + np.roll(book, 1, axis=0), 2)])
    cells = vc.Cells(book, cell)
    for part in np.array_split(points, 4):
        index, distance = cells.nearest(part)
        full = ((part[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (index == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_boxes_are_remembered_and_let_go(monkeypatch):
    monkeypatch.setattr(vc, "REMEMBERED", 50)
    r = np.random.default_rng(0)
    book, cells = r.integers(-300, 300, (8, 2)), None
    cells = vc.Cells(book, 64)
    for _ in range(30):
        points = r.integers(-400, 400, (40, 2))
        assert (cells.nearest(points)[0] == ((points[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
        assert len(cells.known) <= 50
    assert cells.evaluated < 0.5 * cells.asked  # boxes that are small beside the entries' distances leave most out
