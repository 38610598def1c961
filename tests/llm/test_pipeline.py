"""The pipeline against its stages' brute-force versions, on tables of its own."""

import hashlib
import random

import corpus_pipeline
import numpy as np
from test_llm_operators import brute_leaks, brute_near, brute_repeats, some_words


def test_pipeline(spark, library, tmp_path):
    r = random.Random(11)
    rows = []
    for i in range(400):
        words = some_words(r, r.randrange(30, 60)).split()
        if i % 6 == 0:
            words += ["Rascal", "villain", "rascal!"]
        rows.append((i, " ".join(words)))
    passage = some_words(r, 50)
    copy = rows[1][1].split()
    copy[3] = "other"
    item = some_words(r, 12)
    rows += [(1000, rows[1][1]), (1001, " ".join(copy)), (1002, f"{some_words(r, 9)} {passage}"), (1003, f"{passage} {some_words(r, 9)}"), (1004, f"{some_words(r, 20)} {item} {some_words(r, 20)}"), (1005, None), (1006, "")]
    toxic = {i for i in range(0, 400, 6)}
    save = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save("documents", [(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    save("labels", [(i, 1, int(i in toxic)) for i in range(400)], "doc_id long, quality int, toxic int")
    save("benchmark", [(1, item)], "item_id long, text string")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append({x["doc_id"]: x for x in docs.collect()})
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(seen[0]) == {i for i, _ in rows} - toxic
    left = [(i, x["text"]) for i, x in seen[0].items()]
    assert set(seen[1]) == {i for i, (_, c) in brute_near(left).items() if i == c} and not {1000, 1001} & set(seen[1])
    left = [(i, x["text"]) for i, x in seen[1].items()]
    repeats = {i: (gone, digest) for i, _, gone, digest in brute_repeats(left)}
    assert set(seen[2]) == set(seen[1]) and repeats[1002][0] == 50
    for i, x in seen[2].items():
        assert hashlib.sha256(x["text"].encode()).hexdigest() == repeats[i][1] if repeats[i][0] else x["text"] == seen[1][i]["text"]
    left = [(i, x["text"]) for i, x in seen[2].items()]
    assert set(seen[3]) == {x[0] for x in brute_leaks(left, [(1, item)]) if not x[5]} and 1004 not in seen[3]
    assert set(seen[4]) == set(seen[3])
    for i, x in seen[4].items():
        ids = library.encode(seen[3][i]["text"] or "", add_special_tokens=False).ids
        assert x["n_tokens"] == len(ids) and x["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert sorted(x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(seen[4])


def test_stages_handle_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, a text of 5 MB, and columns that clash with what the operators make."""
    r = random.Random(12)
    plain = [(i, some_words(r, 40)) for i in range(60)]
    long = " ".join(f"w{i}" for i in range(700_000))
    odd = [(100, None), (101, ""), (None, plain[0][1]), (None, None), plain[1], plain[1], (102, long)]
    names = ["score", "predicted", "repeats", "component_id", "kept", "n_hit", "ids", "__c"]
    made = [(i, t, *(f"{name} {k}" for name in names)) for k, (i, t) in enumerate(plain + odd)]
    schema = "doc_id long, text string, " + ", ".join(f"{name} string" for name in names)
    save = lambda name, data, kind: spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    save("labels", [(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    save("benchmark", [(1, "never in here"), (2, None)], "item_id long, text string")
    stages = dict(corpus_pipeline.STAGES)

    def run(name, data):
        out = f"{tmp_path}/{name}-{len(data)}"
        stages[name](spark, spark.createDataFrame(data, schema), str(tmp_path)).write.parquet(out)
        return spark.read.parquet(out)

    for name in ("toxicity", "near_dedup", "substring_dedup", "decontamination"):
        found, columns = run(name, made), ["doc_id", "text", *names]
        assert found.columns == columns and run(name, []).columns == columns
        rows = sorted(map(tuple, found.collect()), key=str)
        if name == "near_dedup":  # of three rows that repeat id and text one stays
            assert len(rows) == len(made) - 2 and set(rows) < set(made)
        elif name == "substring_dedup":  # what stands twice goes, from each of its rows
            gone = {plain[0][1], plain[1][1]}
            assert [x[2:] for x in rows] == [x[2:] for x in sorted(((x[0], "" if x[1] in gone else x[1], *x[2:]) for x in made), key=str)]
            assert all(x[1] == ("" if m[1] in gone else m[1]) for x, m in zip(sorted(rows, key=lambda x: x[2]), sorted(made, key=lambda x: x[2]), strict=True))
        else:
            assert rows == sorted(made, key=str)
    last = run("bpe", made)
    assert last.count() == len(made) and [c for c in last.columns if c in names] == names
    assert run("bpe", []).count() == 0
