"""Each operator against brute force on small tables with nulls, empties, repeats and odd columns."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from tidemark.llm import bpe, components, decontamination, html_text, idfile, lm_score, near_dedup, substring_dedup, token_counts, tokens, topk, toxicity
from tidemark.llm.common import checkpoint_dir, most_frequent, shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, words string, start int, score string, ids string, c int"


def some_words(r, n):
    return " ".join(r.choice(["alpha", "beta", "Gamma,", "delta.", "épée", "x1", "the", "of"]) + str(r.randrange(40)) for _ in range(n))


def texts():
    r = random.Random(1)
    long = some_words(r, 3000)
    passage = some_words(r, 60)
    base = some_words(r, 80)
    near = base.split()
    near[10] = "changed"
    out = [None, "", "  \n\t ", "one", "one two three", "a\x00b  c", "<|endoftext|> in <|endoftext|>text", "日本語 のテスト 🎉", long, base, " ".join(near), base.upper(), passage + " " + some_words(r, 20), some_words(r, 20) + " " + passage + " " + some_words(r, 5), "same word " * 60, "Ünïcode's it's  'll  twice"]
    return out + [some_words(r, r.randrange(1, 120)) for _ in range(20)]


@pytest.fixture(scope="module")
def rows():
    found = list(enumerate(texts()))
    return [*found, found[9], found[9], (None, "nobody's text"), (None, None)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "k", "w", 1, "s", "i", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def as_bytes(t):
    return (t or "").encode()


# --- 1


def brute_top(rows, k):
    clean = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in clean if i % 3 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in clean if i != q and len(b) == len(a))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_top_k(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(200)]
    rows += [(200 + i, rows[0][1]) for i in range(9)]  # ties
    rows += [(300, None), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (306, [float("nan")] * 6), (309, [float("inf")] * 6), (312, []), (None, [1.0] * 6), (315, [0.0] * 6), (318, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, id int, vector int")
    found = topk.top_k(df, F.col("vec_id") % 3 == 0).collect()
    assert {tuple(x) for x in found} == brute_top(rows, 5) and len(found) == len(set(found))
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "vec_id long, embedding array<double>")
    assert {tuple(x) for x in topk.top_k(df, F.col("vec_id") == 0).collect()} == {(0, 1, 2, 768 * 256), (0, 2, 1, 512 * 256)}


def ran(plan):
    """The operators of a plan that was run."""
    if plan.nodeName().endswith("QueryStage"):
        return ran(plan.plan())
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        return ran(plan.executedPlan())
    below = plan.children()
    return [plan, *(node for i in range(below.size()) for node in ran(below.apply(i)))]


def test_top_k_sends_each_query_once(spark):
    """What is sent to all tasks doesn't grow with the number of tables."""
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(400)], "vec_id long, embedding array<double>").repartition(2)
    tables = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        found = topk.top_k(df, F.col("vec_id") % 2 == 0)
        assert len(found.collect()) == 200 * 5
        sent = [node.metrics().apply("numOutputRows").value() for node in ran(found._jdf.queryExecution().executedPlan()) if node.nodeName() == "BroadcastExchange"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tables)
    assert 0 < sum(sent) < 50


@pytest.mark.parametrize("groups", [3, 9])
def test_top_k_beyond_a_broadcast(spark, monkeypatch, groups):
    """Blocks of queries and of candidates meet in a grid, each pair once, with the same result."""
    r = random.Random(groups)
    rows = [(i, [float(r.randrange(-9, 9)) for _ in range(3 + i % 2)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3, "vec_id")
    size = sum(8 + 8 * len(v) for i, v in rows if i % 3 == 0)
    monkeypatch.setattr(topk, "BROADCAST_BYTES", -(-size // groups))
    monkeypatch.setattr(topk, "ASKED_BLOCK", 7)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "BLOCK", 16)
    found = topk.top_k(df, F.col("vec_id") % 3 == 0)
    got = found.collect()
    assert {tuple(x) for x in got} == brute_top(rows, 5) and len(got) == len(set(got))
    names = {node.nodeName() for node in ran(found._jdf.queryExecution().executedPlan())}
    assert "SortMergeJoin" in names and "BroadcastExchange" not in names


@pytest.mark.parametrize("dims,n", [(64, 700), (1, 50), (3, 4), (16, 5000)])
def test_list_reads_give_the_scores(dims, n):
    """Components of the same weight, ties, and large integers, against plain sums."""
    r = np.random.default_rng(dims)
    vectors = np.floor(r.normal(0, 40, (n, dims)))
    vectors[n // 2 :: 7] = vectors[0]
    if dims == 3:
        vectors *= 1 << 22
    ids = r.permutation(n) + 10
    queries, query_ids = vectors[:9], ids[:9]
    found = topk.no_random_access(queries, query_ids, vectors, ids, 5)
    expected = []
    for q, own in zip(queries, query_ids, strict=True):
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(q, v, strict=True)), int(i)) for v, i in zip(vectors, ids, strict=True) if i != own)
        expected += [(int(own), i, -s) for s, i in scores[:5]]
    assert sorted(found) == sorted(expected)


def test_lists_are_left_early():
    """Clear winners are found before the lists end, with the same result."""
    r = np.random.default_rng(0)
    vectors = np.floor(r.normal(0, 3, (2000, 8)))
    vectors[:5] += 400
    queries = np.abs(np.floor(r.normal(0, 50, (3, 8)))) + 1
    found = topk.no_random_access(queries, np.arange(5000, 5003), vectors, np.arange(2000), 5)
    scores = vectors @ queries.T
    expected = [(5000 + q, int(i), int(scores[i, q])) for q in range(3) for i in np.lexsort((np.arange(2000), -scores[:, q]))[:5]]
    assert found == expected


# --- 2


def brute_near(rows):
    rows = sorted({(i, t) for i, t in rows if i is not None})
    sets = {}
    for i, t in rows:
        w = as_bytes(t).lower().split()
        sets[i] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, docs, rows, none):
    r = random.Random(5)
    chain = some_words(r, 70).split()
    more = list(rows)
    for i in range(12):  # each differs from the one before by a word, so that the ends aren't alike
        chain[i * 5] = f"new{i}"
        more.append((500 - i, " ".join(chain)))
    group = some_words(r, 60).split()
    for i in range(60):
        copy = list(group)
        copy[r.randrange(60)] = f"v{i}"
        more.append((1000 + i, " ".join(copy)))
    found = near_dedup.near_duplicates(table(spark, more)).collect()
    assert len(found) == len(more)
    expected = brute_near(more)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found if x["doc_id"] is not None} == expected
    assert all(x["kept"] == (x["doc_id"] is None or x["doc_id"] == x["component_id"]) for x in found)
    kept = near_dedup.keep_representatives(table(spark, more))
    assert kept.columns == docs.columns
    assert sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None) == sorted(i for i, (_, c) in expected.items() if i == c)
    assert near_dedup.near_duplicates(none).count() == 0


def templated(r, n, own):
    """Texts of words of their own, words that all share, and one of ten endings."""
    common, ends = [f"c{i}" for i in range(104)], [[f"e{k}-{i}" for i in range(12)] for k in range(10)]
    return [(d, " ".join([f"w{r.random()}" for _ in range(own)] + common + ends[d % 10])) for d in range(n)]


@pytest.mark.parametrize("own", [24, 19, 18])
def test_boilerplate_with_variants_makes_few_pairs(spark, monkeypatch, own):
    """Nothing is linked, or all that share an ending; either way what is joined and compared grows with the texts."""
    made = []
    plain = near_dedup.undecided
    monkeypatch.setattr(near_dedup, "undecided", lambda *a: (lambda df: made.append(df.count()) or df)(plain(*a)))
    searched = []
    settled = near_dedup.settle
    monkeypatch.setattr(near_dedup, "settle", lambda df: (lambda out: (searched.append(out.count()) if "s" in df.columns else None) or out)(settled(df)))
    for n in (60, 240):
        rows = templated(random.Random(n), n, own)
        found = near_dedup.near_duplicates(table(spark, rows)).collect()
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found} == brute_near(rows)
    assert max(made) <= 240 and searched[1] <= 5 * searched[0] + 240


def test_near_duplicates_of_edited_copies(spark):
    """Copies that lie far from each other, cut copies, and copies of edited copies."""
    r = random.Random(8)
    base, rows = some_words(r, 90).split(), []
    edited = lambda words, n, k: [f"e{k}x{i}" if i in at else w for at in [set(r.sample(range(len(words)), n))] for i, w in enumerate(words)]
    for k in range(120):
        words = edited(base, r.choice((1, 1, 2, 3, 4, 6)), k)
        rows.append((k, " ".join(words[: r.choice((90, 90, 90, 80, 60))])))
        if k % 20 == 0:
            rows += [(200 + 10 * k + j, " ".join(edited(words, r.choice((1, 2)), 1000 + 10 * k + j))) for j in range(6)]
    found = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found} == brute_near(rows)
    assert len({c for _, c in brute_near(rows).values()}) > 10


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(40), r.randrange(40)) for _ in range(25)] + [(7, 7), (None, 3), (1000, 900), (900, 1000)] + [(2000 + i, 1999) for i in range(50)]
    found = {x["id"]: x["component"] for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b), near[b].add(a)
    for start in near:
        seen, todo = set(), [start]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo.extend(near[x])
        assert found[start] == min(seen)
    assert set(found) == set(near)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_band_keys_meet():
    """Sets at the threshold nearly always share a key of each collection."""
    r, met = np.random.default_rng(1), 0
    made = near_dedup.seeds()
    for _ in range(200):
        common, own = r.integers(0, 1 << 63, 60, np.uint64), r.integers(0, 1 << 63, 20, np.uint64)
        a, b = (near_dedup.band_keys(np.unique(np.concatenate([common, x])), np.array([70]), made)[0] for x in (own[:10], own[10:]))
        met += (a[: near_dedup.KEYS] == b[: near_dedup.KEYS]).any() and (a[near_dedup.KEYS :] == b[near_dedup.KEYS :]).any()
    assert met >= 199


# --- 3

PAGES = [
    ("<html><head><title>x</title><style>p{}</style><script>var t='</p>';if(a<b){}</script></head><body><nav><ul><li><a href=/a>a</a><li><a href=/b>b</a></ul></nav><div class='ad'>Buy, buy, buy, this is an advert of some length.</div><article><h1>T &amp; U</h1><p><b>First   paragraph\nis here, with commas, and more text.<br><p>Second&nbsp;one.</p></article><footer>&copy; me</footer></body></html>", "T & U\nFirst paragraph is here, with commas, and more text.\nSecond one."),
    ("<body><div id=header><h1>Site</h1></div><div class=wrap><div class='main-content'><h2>Head</h2><p>Hello world, this is a long paragraph, with commas.</p><ul><li>one item here</li><li>two</li></ul>tail <i>text</i></div><div class=sidebar><p>Nope nope nope nope nope nope nope, nope.</p></div><div id='comments'><p>I think, that this is a great comment, really.</p></div></div></body>", "Head\nHello world, this is a long paragraph, with commas.\none item here\ntwo\ntail text"),
    ("<body><main><article><section><h2>A</h2><p>First para is here, long enough to count as text.</p></section><section><p>Second para is here, long enough to count as text, too.</p><aside>pull</aside></section><section class=comments><p>Comment, longer than twenty five chars, yes</p></section></article></main><div role=alert>We use cookies here</div><form>f</form></body>", "A\nFirst para is here, long enough to count as text.\nSecond para is here, long enough to count as text, too."),
    ("", ""), (None, ""), ("just text", "just text"), ("<p", "<p"), ("<div><div><div>", ""), ("<!-- only --><script>x", ""), ("<body><article>short</article></body>", "short"),
    ("<body><div hidden><p>Hidden, hidden, hidden, hidden, hidden.</p></div><p>Shown.</p></body>", "Shown."),
]


def test_html(spark):
    rows = [(i, f"u{i}", h, "t", 1) for i, (h, _) in enumerate(PAGES)]
    df = spark.createDataFrame([*rows, rows[0], (None, None, PAGES[0][0], "t", 1)], "page_id long, url string, html string, text string, n_chars int")
    found = html_text.extract(df)
    assert found.columns == ["page_id", "url", "text", "n_chars"] and dict(found.dtypes)["page_id"] == "bigint"
    got = found.collect()
    assert len(got) == len(rows) + 2
    for x in got:
        if x["page_id"] is not None:
            assert x["text"] == PAGES[x["page_id"]][1], x["page_id"]
        assert x["n_chars"] == len(x["text"])
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_of_depth_and_length():
    deep = "<div>" * 5000 + "<p>" + "word, " * 20000 + "</p>"
    assert html_text.main_text(deep).startswith("word, word,")
    assert html_text.main_text('<a href="' * 3000) is not None


@pytest.mark.parametrize("page", ["<a " * 300_000, "<div>" * 200_000, "</section>" * 100_000 + "<div>" * 100_000 + "</p>" * 100_000, "<a '" * 200_000 + ">", "<![CDATA[" * 100_000, "<ul>" * 100_000, '<a ">" ' * 60_000, "<td><table>" + "<center>" * 600 + "<td></td>" * 30_000, "<!--" * 200_000])
def test_time_grows_with_a_broken_page(page):
    """Each of these takes minutes or more if a tag is looked for from every place."""
    import time

    start = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - start < 20


# --- 4, 5, 8


def test_encoder(library):
    use = tokens.Encoder(PATH)
    for t in [*texts(), "a  b", "a ", " a", "\n\n a", "  ", "ll's've", "x　y", "Ꙁ", "ა", "a<|endoftext|>"]:
        assert np.frombuffer(use.encode(t), use.dtype).tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_token_counts(spark, docs, rows, none, library, tmp_path):
    cache = str(tmp_path / "cache")
    expected = sorted(((i, len(as_bytes(t)), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 50) for i, t in rows), key=str)
    for _ in range(2):
        assert sorted(map(tuple, token_counts.count_tokens(docs, cache, PATH, 50).collect()), key=str) == expected
        stored = spark.read.parquet(cache).count()
        assert stored == len({t for _, t in rows if t})  # each distinct text once, also after a second run
    assert token_counts.count_tokens(none, cache, PATH).count() == 0
    token_counts.count_tokens(table(spark, [(1, "brand new")]), cache, PATH).collect()
    assert spark.read.parquet(cache).count() == stored + 1


def test_transducer():
    words = {w.encode(): [i, i + 1][: 1 + i % 2] for i, w in enumerate(["", "a", "ab", "abc", "b", "bc", "walking", "talking", "stalking", "é"])}
    lexicon = bpe.Transducer(bpe.build_transducer(words))
    for w, ids in words.items():
        assert lexicon.look_up(w) == ids
    assert lexicon.look_up_all([b"x", b"abcd", b"walkin", b"\xc3"]) == [None] * 4
    assert len(lexicon.finals) < sum(map(len, words))  # endings are shared
    assert bpe.Transducer(bpe.build_transducer({})).look_up_all([b"a", b""]) == [None, None]


def merged(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min((r for a, b in pairwise(parts) if (r := ranks.get(a + b)) is not None), default=None)
        if best is None:
            break
        i = 0
        while i < len(parts) - 1:
            if ranks.get(parts[i] + parts[i + 1]) == best:
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            i += 1
    return [ranks[p] for p in parts]


def test_unseen_words_merge_exactly():
    codec = bpe.Codec(PATH)
    ranks = codec.encoder.vocabulary.ranks
    for w in [" alpha", " Zusammenhang", "qwertzuiop", "épée", "0123456", "!!!???"]:
        assert np.frombuffer(codec.encode([w])[0], codec.encoder.dtype).tolist() == merged(w.encode(), ranks)


def test_round_trip(spark, docs, rows, none, library):
    got = bpe.round_trip(docs, PATH)
    assert [c for c in docs.columns if c in got.columns] == docs.columns
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    found = [tuple(x) for x in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert bpe.round_trip(none, PATH).count() == 0
    both = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()
    assert all(x["decoded"] == (x["text"] or "") for x in both)


def test_id_files(spark, docs, rows, none, library):
    path = shared_dir(spark, "ids")
    idfile.write_ids(docs, path, PATH, most=2000)
    found = [tuple(x) for x in idfile.id_digests(idfile.read_ids(spark, path)).collect()]
    by_id = defaultdict(list)
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        by_id[i].append((len(ids), zlib.crc32(ids.tobytes())))
    assert len(found) == len(rows)
    start = 0
    for i, at, n, crc in sorted(found, key=lambda x: x[1]):
        assert at == start and (n, crc) in by_id[i]
        start += n
    order = [x[0] for x in sorted(found, key=lambda x: x[1])]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    assert spark.read.parquet(path).count() > 3
    empty = shared_dir(spark, "ids")
    idfile.write_ids(none, empty, PATH)
    assert idfile.read_ids(spark, empty).count() == 0


@pytest.mark.parametrize("sizes", [[1], [0, 0, 5], [3] * 200, [0] * 70, [1, 100000, 2, 0, 7] * 30])
def test_boundaries(sizes):
    ends = np.cumsum(sizes)
    b = idfile.Boundaries.of(ends, int(ends[-1]))
    assert ends.tolist() == [b.select(i) for i in range(len(ends))]
    shard = idfile.Shard(idfile.pack(list(range(len(sizes))), [np.full(n, i, "<u2").tobytes() for i, n in enumerate(sizes)], 2))
    assert [shard.document(i).tolist() for i in range(len(sizes))] == [[i] * n for i, n in enumerate(sizes)]


@pytest.mark.parametrize("ids", [[], [None], [None, None, 5], [-(1 << 63), -3, -3, 0, 7, (1 << 63) - 1], list(range(10, 500, 7)), [None, *range(300), 1 << 40], [9] * 130])
def test_document_ids_of_a_shard(ids):
    shard = idfile.Shard(idfile.pack(ids, [b"\0\0"] * len(ids), 2))
    assert [shard.doc_id(i) for i in range(len(shard))] == ids


# --- 6


def test_toxicity(spark, none):
    r = random.Random(4)
    rows = []
    for i in range(1500):
        words = some_words(r, r.randrange(20, 60)).split()
        if i % 7 == 0:
            words[r.randrange(len(words))] = r.choice(["villain", "rascal"])
            words.append("Rascal!")
        rows.append((i, " ".join(words)))
    docs_ = table(spark, [*rows, (5000, None), (5001, ""), (None, "rascal rascal"), rows[0], rows[0]])
    labels = spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i, _ in rows] + [(3, 1, None), (None, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs_, labels)
    assert [c for c in got.columns if c in docs_.columns and c != "score"] == [c for c in docs_.columns if c != "score"]
    found = got.collect()
    assert len(found) == len(rows) + 5
    held = [x for x in found if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 1500]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in found if x["doc_id"] is not None)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in found)
    right = sum(x["predicted"] == int(x["doc_id"] % 7 == 0) for x in held)
    assert right >= 0.98 * len(held)
    assert {x["predicted"] for x in found if x["doc_id"] in (5000, 5001)} == {0}
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert {x["score"] for x in toxicity.score_toxicity(docs_, labels.limit(0)).collect()} == {0.5}
    assert toxicity.reject_toxic(docs_, labels).columns == docs_.columns


def test_calibration_rows_beyond_the_sample_teach(spark, monkeypatch):
    """Every labelled row outside the held-out fold either calibrates or teaches."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    rows = [(i, f"ordinary words {'rogue' if fold(i) == 1 and i % 2 else 'row'}") for i in range(1000)]
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 1)) for i, _ in rows], "doc_id long, quality int, toxic int")
    count, taught = toxicity.class_counts, []
    monkeypatch.setattr(toxicity, "SAMPLE", 50)
    monkeypatch.setattr(toxicity, "class_counts", lambda df: taught.extend(x["doc_id"] for x in df.collect()) or count(df))
    toxicity.score_toxicity(table(spark, rows), labels).count()
    assert len(taught) == len(set(taught)) and all(fold(i) for i in taught)
    inside = sum(fold(i) == 1 for i, _ in rows)
    assert set(taught) >= {i for i, _ in rows if fold(i) > 1}
    assert inside - 100 <= sum(fold(i) == 1 for i in taught) < inside


def brute_ratios(rows, toxic, sample, spread):
    """log P(text | toxic) - log P(text | ordinary) by number of expressions, by plain counting."""
    words = lambda t: {w for w in (x.strip(toxicity.EDGES) for x in (t or "").encode().lower().split()) if w}
    counts, texts = defaultdict(lambda: [0, 0]), {(t, toxic[i]) for i, t in rows if i in toxic and sample(i)}
    for t, c in texts:
        for w in words(t):
            counts[w][c] += 1
    total = [sum(n[c] for n in counts.values()) for c in (0, 1)]
    kept = {}
    for w, n in counts.items():
        expected = [sum(n) * total[c] / sum(total) for c in (0, 1)]
        kept[w] = [max(0, n[c] - 1.5 * expected[c] - spread * expected[c] ** 0.5 - 1) for c in (0, 1)]
    left = [1 - sum(k[c] for k in kept.values()) / total[c] for c in (0, 1)]
    backoff = {w: sum(n) / sum(total) for w, n in counts.items()}
    p = {w: [kept[w][c] / total[c] + left[c] * backoff[w] for c in (0, 1)] for w in counts}
    assert all(abs(sum(x[c] for x in p.values()) - 1) < 1e-9 for c in (0, 1))  # distributions
    ratio = lambda w: np.log(p[w][1] / p[w][0]) if w in p else np.log(left[1] / left[0])
    return [sum(map(ratio, words(t))) / len(words(t)) if words(t) else np.log(left[1] / left[0]) for _, t in rows]


@pytest.mark.parametrize("broadcast", [True, False])
def test_toxicity_scores_rise_with_the_ratio_of_both_likelihoods(spark, monkeypatch, broadcast):
    r, rows = random.Random(6), []
    for i in range(600):
        words = some_words(r, r.randrange(5, 40)).split()
        rows.append((i, " ".join(words + (["Rascal!", "villain"][: r.randrange(1, 3)] if i % 5 == 0 else []))))
    rows += [(700 + i, rows[5 * i][1]) for i in range(9)] + [(800, None), (801, "?!"), (802, "rascal " * 50_000)]
    toxic = {i: int(i % 5 == 0) for i in range(600)} | {700 + i: 1 for i in range(9)}
    labels = spark.createDataFrame([(i, c) for i, c in toxic.items()], "doc_id long, toxic int")
    if not broadcast:
        monkeypatch.setattr(toxicity, "BROADCAST_BYTES", 0)
    found = {x["doc_id"]: x for x in toxicity.score_toxicity(table(spark, rows), labels).collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    all_ = [brute_ratios(rows, toxic, lambda i: fold(i) > 1, s) for s in toxicity.SPREADS]
    assert any(np.allclose([found[i]["log_ratio"] for i, _ in rows], x) for x in all_)
    by_ratio = [found[i]["score"] for i in sorted(found, key=lambda i: found[i]["log_ratio"])]
    assert by_ratio == sorted(by_ratio) and by_ratio[0] < 0.2 and by_ratio[-1] > 0.8


def test_rejecting_keeps_columns_by_value(spark):
    rows = [(i, f"{'rascal' if i % 4 == 0 else 'fine'} words {i}", "mine", i) for i in range(800)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)], "doc_id long, toxic int")
    kept = toxicity.reject_toxic(docs_, labels)
    assert kept.columns == docs_.columns
    assert sorted(map(tuple, kept.collect())) == [x for x in rows if x[0] % 4]


# --- 7


def brute_repeats(rows, n=35):
    words = [as_bytes(t).split() for _, t in rows]
    seen = Counter(tuple(w[a : a + n]) for w in words for a in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {p for a in range(len(w) - n + 1) if seen[tuple(w[a : a + n])] > 1 for p in range(a, a + n)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(out, key=str)


def repeated(docs_, **options):
    return sorted((tuple(x) for x in substring_dedup.remove_repeats(docs_, **options).select("doc_id", *substring_dedup.kept_digest(F.col("repeats"))).collect()), key=str)


def test_repeats(spark, docs, rows, none):
    assert repeated(docs) == brute_repeats(rows)
    assert repeated(none) == []
    got = substring_dedup.remove_repeats(docs)
    assert got.columns == [*docs.columns, "repeats"]


def test_repeats_with_a_crowded_anchor(spark, monkeypatch):
    """One run of words in a hundred different places, dealt window by window."""
    r = random.Random(8)
    line = "aa bb cc dd ee ff gg hh"
    rows = [(i, f"{some_words(r, 40)} {line} {some_words(r, 40)}") for i in range(100)]
    rows += [(200 + i, f"{rows[i][1].split(line)[0]}{line} {some_words(r, 30)}") for i in range(20)]
    found = substring_dedup.find_repeats
    monkeypatch.setattr(substring_dedup, "find_repeats", lambda d, n: found(d, n, shard_words=500, crowded=3))
    assert repeated(table(spark, rows)) == brute_repeats(rows)


def test_a_passage_in_many_documents_is_no_group(spark, monkeypatch):
    """The passage's edges differ everywhere, its inner windows are the same; no shard holds them all."""
    r = random.Random(9)
    passage = some_words(r, 80)
    rows = [(i, f"{some_words(r, 40)} {passage} {some_words(r, 40)}") for i in range(200)]
    rows += [(1000, f"{some_words(r, 40)} {passage} {some_words(r, 40)}")] * 200
    found, apply, groups = substring_dedup.find_repeats, GroupedData.applyInPandas, []
    monkeypatch.setattr(substring_dedup, "find_repeats", lambda d, n: found(d, n, shard_words=500, crowded=3))
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, *a: groups.append(self._df) or apply(self, *a))
    assert repeated(table(spark, rows)) == brute_repeats(rows)
    words = [x["n"] for g in groups for x in g.groupBy("shard").agg((F.sum(F.length("words")) / 8).alias("n")).collect()]
    assert max(words, default=0) < 2000


def test_automaton():
    r = random.Random(6)
    streams = [[r.randrange(3) for _ in range(r.randrange(1, 30))] for _ in range(40)]
    a = substring_dedup.SuffixAutomaton()
    for k, s in enumerate(streams):
        a.add(s, 1 + k % 2)
    a.close()
    for n in (1, 3, 6):
        count = Counter()
        for k, s in enumerate(streams):
            for i in range(len(s) - n + 1):
                count[tuple(s[i : i + n])] += 1 + k % 2
        for s in [*streams, [r.randrange(4) for _ in range(50)]]:
            assert a.occurrences(s, n) == [count[tuple(s[i : i + n])] for i in range(len(s) - n + 1)]


# --- 9


def brute_leaks(rows, items, n=10):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]
    wins = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for a in range(max(1, len(w) - n + 1)) if w else ():
            wins[tuple(w[a : a + n])].add(i)
    out = []
    for i, t in rows:
        w, hit, found = cut(t), set(), set()
        for win, names in wins.items():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    found |= names
        found.discard(None)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_leaks(spark, docs, rows, none):
    all_texts = texts()
    item = " ".join(all_texts[8].split()[100:130])
    items = [(1, item), (2, item.upper()), (3, "one two"), (4, None), (5, ""), (6, "..."), (10, "same word same word same word same word same word same"), (7, "never there at all in any of these texts of ours"), (None, "twice")]
    benchmark = spark.createDataFrame([(i, t, 1, "w") for i, t in items], "item_id long, text string, span int, window string")
    got = decontamination.contamination(docs, benchmark)
    assert sorted((tuple(x) for x in got.drop("hit").collect()), key=str) == brute_leaks(rows, items)
    assert decontamination.contamination(none, benchmark).count() == 0
    assert {x["contaminated"] for x in decontamination.contamination(docs, benchmark.limit(0)).collect()} == {False}
    clean = decontamination.decontaminate(docs, benchmark)
    bad = {x[0] for x in brute_leaks(rows, items) if x[5]}
    assert clean.columns == docs.columns and {x["doc_id"] for x in clean.filter("doc_id IS NOT NULL").collect()} == {i for i, _ in rows if i is not None} - bad
    spans = {x["doc_id"]: x["text"] for x in decontamination.remove_spans(docs, benchmark).collect()}
    assert spans[4] == "three" and spans[9] == all_texts[9]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_leaks_beyond_the_broadcast(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    items = [(1, " ".join(texts()[8].split()[5:40])), (2, "one two")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(x) for x in decontamination.contamination(docs, benchmark).drop("hit").collect()), key=str) == brute_leaks(rows, items)


# --- 10


def test_lm_score(spark, docs, rows, none):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [as_bytes(t).lower().split() for i, t in rows if not held(i)]
    counts = Counter(w for t in train for w in t)
    total, kinds = sum(counts.values()) + len(train), len(counts) + 1
    logs = lambda c: math.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
    expected = sorted(((i, held(i), len(w := as_bytes(t).lower().split()) + 1, sum(counts[x] > 0 for x in w) + 1, total, round(sum(logs(counts[x]) for x in w) + logs(len(train)), 6)) for i, t in rows), key=str)
    for frequent in (5, 200_000):
        got = lm_score.score_documents(docs, frequent=frequent).collect()
        assert sorted(((*x[:5], round(x["base_score"], 6)) for x in got), key=str) == expected
    assert all(x["score"] < 0 and x["bits_per_byte"] > 0 for x in got)
    assert lm_score.score_documents(none).count() == 0


def test_most_frequent(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [2] * 10 + [100, 200, 300])], "w int, n long")
    assert sorted(x["n"] for x in most_frequent(df, 20).collect()) == [2] * 10 + [100, 200, 300]
    assert most_frequent(df, 2).count() == 2 and most_frequent(df, 1000).count() == 63 and most_frequent(df.limit(0), 5).count() == 0
    assert checkpoint_dir(spark)


def gram_logs(train, grams, depth):
    """The operator's value of each gram, from a tree of the training texts."""
    known, counts = np.unique(np.concatenate([lm_score.grams_of(t, depth) for t in train]), return_counts=True)
    every = np.union1d(known, grams)
    n = np.zeros(len(every), np.int64)
    n[np.searchsorted(every, known)] = counts
    units = every & np.uint64(0xFFFF00)
    trees = [lm_score.Tree(every[units == u], n[units == u], depth) for u in np.unique(units)]
    crown = lm_score.Crown(*(np.array(x) for x in zip(*(t.top() for t in trees), strict=True)))
    values = {int(g): v for t in trees for g, v in zip(t.grams[depth], t.logs(crown), strict=True)}
    return [values[int(g)] for g in grams]


def brute_tree(train, depth):
    """log10 of a byte after its context, node by node as context-tree weighting defines it."""
    count, longer = defaultdict(Counter), defaultdict(set)
    for t in train:
        raw = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(raw)):
            for d in range(depth + 1):
                count[raw[i - d : i]][raw[i]] += 1
                if d:
                    longer[raw[i - d + 1 : i]].add(raw[i - d : i])

    def bits(context, node):
        level, out = node.bit_length() - 1, [0, 0]
        for byte, n in count[context].items() if context in count else ():
            if (byte | 256) >> (8 - level) == node:
                out[byte >> (7 - level) & 1] += n
        return out

    @functools.cache
    def weighted(context, node):
        """ln of the weighted probability and the weight of the context's own estimate."""
        zeros, ones = bits(context, node)
        own = math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)
        if len(context) == depth:
            return own, 1.0
        deeper = sum(weighted(c, node)[0] for c in longer[context] if sum(bits(c, node)))
        top = max(own, deeper)
        both = top + math.log(math.exp(own - top) + math.exp(deeper - top))
        return both - math.log(2), math.exp(own - both)

    @functools.cache
    def one(context, node):
        p, share = 0.5, 1.0  # nothing known
        done = 0.0
        for d in range(depth + 1):
            c = context[depth - d :]
            zeros, ones = bits(c, node)
            if not zeros + ones:
                break
            kt = (ones + 0.5) / (zeros + ones + 1)
            p = done + share * kt
            weight = weighted(c, node)[1]
            done, share = done + share * weight * kt, share * (1 - weight)
        return p

    def log(context, byte):
        nodes = [((byte | 256) >> (8 - i), byte >> (7 - i) & 1) for i in range(8)]
        return sum(math.log10(one(context, n) if bit else 1 - one(context, n)) for n, bit in nodes)

    return log


@pytest.mark.parametrize("before", ["", "a", "th", "the", "qz", "hez", "éà"])
def test_tree_is_a_distribution(before):
    train = [t.encode() for t in ["the cat sat", "the hat", "a that theme", "", "été à"] * 3]
    context = (b"\xff" * 3 + before.encode())[-3:]
    logs = gram_logs(train, np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64), 3)
    assert abs(sum(10**x for x in logs) - 1) < 1e-6
    log = brute_tree(train, 3)
    assert all(abs(x - log(context, b)) < 1e-6 for b, x in enumerate(logs))


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 300, "BUCKET_GRAMS": 200, "PIECE": 50}])
def test_lm_score_by_brute_force(spark, rows, monkeypatch, limits):
    """Every text's whole score, whatever the sizes of blocks and buckets."""
    for name, value in limits.items():
        monkeypatch.setattr(lm_score, name, value)
    some = [(i, t) for i, t in rows if len(t or "") < 700]
    train = [as_bytes(t) for i, t in some if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    log = brute_tree(train, lm_score.DEPTH)
    pad = b"\xff" * lm_score.DEPTH
    score = functools.cache(lambda t: sum(log(raw[i - lm_score.DEPTH : i], raw[i]) for raw in [pad + t + b"\xff"] for i in range(lm_score.DEPTH, len(raw))))
    found = lm_score.score_documents(spark.createDataFrame(some, "doc_id long, text string")).collect()
    assert np.allclose(sorted(x["score"] for x in found), sorted(score(as_bytes(t)) for _, t in some), atol=1e-3)


def test_packed_grams():
    grams = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 1000, dtype=np.uint64))
    assert (lm_score.unpack(lm_score.pack(grams)) == grams).all() and len(lm_score.pack(grams)) < 6.1 * len(grams)


# --- very long texts, cut references


def test_references_end_with_their_piece_of_text():
    page = "<html><body><article><p>" + "A long paragraph, with commas, and words. " * 5 + "cut &am<i>p;</i> and &lt<b>;</b> and &amp;amp; and AT&amp;T</p></article></body></html>"
    assert html_text.main_text(page).endswith("cut &amp; and <; and &amp; and AT&T")


def test_very_long_texts_are_counted_and_written_whole(spark, library):
    r = random.Random(9)
    rows = [(2, some_words(r, 320_000)), (1, "é" * 300_000), (3, "short")]
    sizes = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}
    assert len(rows[0][1]) > 2_000_000
    found = token_counts.count_tokens(table(spark, rows), shared_dir(spark, "cache"), PATH).collect()
    assert {x["doc_id"]: x["n_tokens"] for x in found} == sizes
    path = shared_dir(spark, "ids")
    idfile.write_ids(table(spark, rows), path, PATH)
    written = idfile.id_digests(idfile.read_ids(spark, path)).collect()
    assert {x["doc_id"]: (x["start"], x["n_tokens"]) for x in written} == {1: (0, sizes[1] + 1), 2: (sizes[1] + 1, sizes[2] + 1), 3: (sizes[1] + sizes[2] + 2, sizes[3] + 1)}
