"""What holds at any size: plans without hot groups, and operators that work beyond a broadcast."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import text
from tidemark.operators import annotate, coding, funnel, links, posts, stats
from tidemark.plans import queries as plain
from tidemark.plans import views
from tidemark.sources import files
from tidemark.streaming.pickup import pick_up, read_picked_up

SF = "/root/testdata/sf0.001"
POST = "id string, title string, duration double, view_count long"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    """Exchanges of the plan that was run, each once."""
    df.collect()
    final = planned(df).split("== Initial Plan ==")[0]
    return len(re.findall(r"(?<!Reused)Exchange (?:hash|range|Single|Round)", final))


# --- quantiles


def columns():
    r = random.Random(3)
    yield "distinct", "double", [r.uniform(-5, 5) for _ in range(3000)]
    yield "one heavy value", "long", [7] * 2000 + [r.randrange(1 << 60) for _ in range(999)]
    yield "nulls and few", "int", [None, 3, None, 1, 2]
    yield "one", "double", [4.5]
    yield "none", "double", [None, None]
    yield "not numbers", "double", [1.0, float("nan"), float("inf"), float("-inf"), 2.0]
    yield "decimals", "decimal(10,2)", [__import__("decimal").Decimal(k) / 4 for k in range(50)]


@pytest.mark.parametrize("name,kind,values", list(columns()), ids=lambda x: x if isinstance(x, str) else "")
@pytest.mark.parametrize("ranges", [2, 16, 1000])
def test_quantiles_are_exact(spark, name, kind, values, ranges):
    df = spark.createDataFrame([(x,) for x in values], f"x {kind}").repartition(3)
    points = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = links.quantiles(df, "x", points, ranges)
    want = df.agg(F.percentile("x", F.array(*map(F.lit, points)))).first()[0] or [None] * len(points)
    assert [str(g) if g != g else g for g in got] == pytest.approx([str(w) if w is not None and w != w else w for w in want])


def test_describe_has_no_aggregate_of_all_values(spark):
    df = spark.range(10_000).select((F.col("id") * 7 % 9973).alias("x"))
    assert "percentile(" not in planned(links.describe_stats(df, "x"))
    row = links.describe_stats(df, "x").first()
    assert row["p50"] == df.agg(F.percentile("x", 0.5)).first()[0]


# --- annotation


def test_calls_of_a_task_overlap(spark, tmp_path):
    def slow(prompt):
        (tmp_path / f"start-{prompt}").write_text(str(time.time()))
        time.sleep(0.5)
        (tmp_path / f"end-{prompt}").write_text(str(time.time()))
        return "{}"

    def most_at_once():
        starts, ends = ([float(f.read_text()) for f in tmp_path.glob(f"{k}-*")] for k in ("start", "end"))
        return max(sum(s <= t for s in starts) - sum(e <= t for e in ends) for t in starts)

    df = spark.createDataFrame([(str(i), str(i)) for i in range(12)], "file_key string, prompt string")
    assert annotate.annotate(df, slow, tasks=1, calls=6).count() == 12
    assert 3 <= most_at_once() <= 6


def test_pauses_between_attempts(spark):
    def fails(prompt):
        raise ValueError("no")

    df = spark.createDataFrame([("1", None)], "file_key string, prompt string")
    began = time.time()
    row = annotate.annotate(df, fails, tasks=1, pause=0.4).first()
    assert row["attempts"] == 3 and row["error"] == "ValueError: no" and time.time() - began >= 1.2
    assert annotate.annotate(df.limit(0), fails).count() == 0


def test_what_was_answered_is_not_asked_again(spark, tmp_path):
    """A run that breaks off in its second wave; the next one asks for the rest only."""
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()

    def infer(prompt):
        with open(calls / prompt, "a") as f:
            f.write("x")
        return json.dumps({"said": prompt})

    df = spark.createDataFrame([(str(i), f"p{i}") for i in range(40)] + [("0", "p00"), (None, "p")], "file_key string, prompt string")
    first = [r[0] for r in df.filter(F.pmod(F.xxhash64("file_key"), F.lit(4)) == 0).collect()]
    broken = df.withColumn("prompt", F.when(F.pmod(F.xxhash64("file_key"), F.lit(4)) == 0, F.col("prompt")).otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        annotate.annotate_new(broken, infer, store, waves=4)
    assert {f.name for f in calls.iterdir()} == {f"p{i}" for i in first if i is not None}
    rows = annotate.annotate_new(df, infer, store, waves=4).collect()
    assert sorted(r["file_key"] for r in rows) == sorted(str(i) for i in range(40))
    assert all(f.read_text() == "x" for f in calls.iterdir()) and len(list(calls.iterdir())) == 40


# --- rules


def many_rules():
    r = random.Random(8)
    letters = lambda n: "".join(r.choice("abcd é'") for _ in range(n))
    rows = [("canonical", i, "regex", letters(2).replace("'", "") + ".?" + r.choice("abc"), f"C{i}") for i in range(12)]
    rows += [("status", i, "exact", letters(r.randrange(2, 6)), f"S{i}") for i in range(40)] + [("status", 50 + i, "regex", f"^{letters(2)}", f"R{i}") for i in range(9)]
    rows += [("target", i, "contains", letters(r.randrange(2, 7)), f"T{i % 7}") for i in range(60)]
    return rows, [(letters(r.randrange(0, 14)),) for _ in range(300)] + [(None,), ("",)]


def test_rules_beyond_the_broadcast(spark, monkeypatch):
    rows, terms = many_rules()
    rules, df = spark.createDataFrame(rows, schemas.RULES), spark.createDataFrame(terms, "term string")
    want = {tuple(r) for r in coding.code_terms(df, rules).collect()}
    shadowed = {tuple(r) for r in coding.shadowed_rules(rules).collect()}
    monkeypatch.setattr(coding, "BROADCAST_BYTES", 400)
    found = coding.code_terms(df, rules)
    assert {tuple(r) for r in found.collect()} == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = planned(coding.code_terms(df, rules))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert not re.search(r"Join \\[layer#\\d+\\],", plan)
    # Shadowed ones by hand.
    target = [(p, pattern, label) for layer, p, _, pattern, label in rows if layer == "target"]
    by_hand = {}
    for p, pattern, label in target:
        inside = [(q, other) for q, other, wins in target if q < p and len(other) > 3 and other in pattern and wins != label]
        if inside:
            by_hand[p, pattern, label] = min(inside)[1]
    assert {r[:3]: r[3] for r in shadowed} == by_hand


# --- copies


def test_a_popular_title_is_merged_before_it_moves(spark):
    df = spark.range(30_000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "one very popular title").otherwise(F.concat(F.lit("title of its own, "), F.col("id").cast("string"))).alias("title"), F.lit(1.0).alias("duration"), (F.col("id") % 1000).alias("view_count"), F.map_from_arrays(F.array(F.lit("k")), F.array("id")).alias("other"))
    kept = posts.dedup_posts(df)
    assert "Window" not in planned(kept) and "partial_min_by" in planned(kept)
    assert kept.count() == 20_001 and kept.columns == df.columns
    best = kept.filter("title = 'one very popular title'").first()
    assert best["view_count"] == 999 and best["id"] == str(min((i for i in range(0, 30_000, 3) if i % 1000 == 999), key=str)) and best["other"] == {"k": int(best["id"])}
    assert posts.dedup_stats(df).first()[:] == (30_000, 20_001, 9_999)
    assert "Window" not in planned(posts.dedup_stats(df))
    assert posts.dedup_stats(df.limit(0)).first()[:] == (0, 0, 0)


def test_copies_within(spark):
    df = spark.createDataFrame([("1", "a title of some length", 1.0, 5, "x"), ("2", "a title of some length", 1.0, 9, "y"), ("3", "a title of some length", 1.0, 1, "y")], POST + ", p string")
    assert sorted(r["id"] for r in posts.dedup_posts(df, ("p",)).collect()) == ["1", "2"]


def test_funnel_with_repeats_and_nulls(spark):
    """Short titles, copies on several platforms, repeated ids and no ids, against a plain count."""
    long = "a title of some length"
    kind = POST + ", extractor string, topic boolean, supplements string"
    rows = [
        ("1", long, 1.0, 5, "A", True, "[zinc]"), ("2", long, 1.0, 9, "b", True, None), ("3", "short", 1.0, 1, "a", True, "[zinc]"), ("3", "short", 1.0, 1, "a", True, "[zinc]"),
        (None, None, None, None, "b", True, "[iron]"), (None, None, None, None, "b", True, None), ("6", long, 1.0, 50, "a", False, "[zinc]"), ("7", long, 1.0, 99, "c", True, "[zinc]"), ("8", long, 2.0, None, "a", None, None),
    ]
    df = spark.createDataFrame(rows, kind)
    linked = spark.createDataFrame([("x", "A")] * 9 + [("y", "B"), ("z", None)], "link string, source string")
    counts = {r["stage"]: r["n"] for r in funnel.funnel_counts(linked, df, "topic", ("a", "b")).collect()}
    assert counts == {"links": 10, "processed": 8, "topic": 6, "unique": 5, "has_terms": 3, "not_processed": 2, "not_topic": 2, "not_unique": 1, "not_has_terms": 2}
    empty = {r["stage"]: r["n"] for r in funnel.funnel_counts(linked.limit(0), df.limit(0), "topic", ("a", "b")).collect()}
    assert set(empty.values()) == {0}
    stages = {r["stage"]: (r["n_in"], r["kept"], r["removed"]) for r in funnel.funnel_stages(funnel.funnel_counts(linked, df, "topic", ("a", "b"))).collect()}
    assert stages == {"processed": (10, 8, 2), "topic": (8, 6, 2), "unique": (6, 5, 1), "has_terms": (5, 3, 2)}


def test_plans_stay_small(spark):
    """The funnel and the findings as planned, and as run."""
    shares = plain.Q["funnel_shares"](spark, SF)
    assert planned(shares).count("Exchange") < 30
    assert planned(shares).count("lineitem.parquet") == 0  # read once, before, into the funnel's table
    assert planned(plain.Q["funnel_counts"](spark, SF)).count("lineitem.parquet") == 1
    assert exchanges(plain.Q["findings"](spark, SF)) <= 40


def test_findings_of_nothing(spark, tmp_path):
    table = views.dated(views.posts(spark, SF))
    found = stats.findings(table.limit(0), views.rules(spark), views.FLAG, str(tmp_path / "f"), views.PLATFORMS)
    assert found.count() == 0
    off = stats.findings(table.withColumn(views.FLAG, F.lit(False)), views.rules(spark), views.FLAG, str(tmp_path / "g"), views.PLATFORMS)
    assert {(r["section"], r["rank"], r["key"], r["metric"], r["value"]) for r in off.collect()} == {("inclusion", 1, "all", m, v) for m, v in (("loaded", 1500.0), ("after_platform_filter", 1500.0), ("included", 0.0))}


def test_report_trend_takes_lists_apart_once(spark):
    """No join is moved below the counts, so posts are made once and only counted parts get names."""
    assert planned(plain.Q["report_trend"](spark, SF)).count("lineitem.parquet") == 1
    made = spark.range(1).select(text.parse_list(F.concat(F.lit("['a', '"), F.col("id"), F.lit("']"))).alias("parts"))
    assert made._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    rows = [("2024-01-05", "['Zinc', 'zinc ']"), ("2024-01-09", "iron"), ("2024-02-01", "['iron', 'b', 'HRT']"), (None, "['b', 'b', 'b']"), ("2024-03-01", "c"), (None, None)]
    df = spark.createDataFrame(rows, "date string, supplements string").select(F.col("date").cast("date"), "supplements")
    got = sorted((str(r[0]), r[1], r[2]) for r in stats.report_trend(df, 3).collect())
    assert got == [("2024-01-31", "B", 0), ("2024-01-31", "Iron", 1), ("2024-01-31", "Zinc", 2), ("2024-02-29", "B", 1), ("2024-02-29", "Iron", 1), ("2024-02-29", "Zinc", 0)]
    assert stats.report_trend(df.limit(0)).count() == 0


def test_findings_read_posts_no_more_once_written(spark):
    """All sections are made from written sums, those of the posts that name the top terms too."""
    assert planned(plain.Q["findings"](spark, SF)).count("lineitem.parquet") == 0


def test_coding_is_written_from_terms_taken_apart_once(spark, monkeypatch):
    """The posts are read by the job that writes their terms; codes and tables are made from what it wrote."""
    plans = []
    write = files.write_coding
    monkeypatch.setattr(files, "write_coding", lambda tables, folder: plans.extend(planned(df) for df in tables.values()) or write(tables, folder))
    plain.Q["coding_written_and_read"](spark, SF)
    assert sum(plan.count("lineitem.parquet") for plan in plans) == 1
    rows = [("1", 1, "A", 5, 7), ("1", 2, "A", 6, 8), (None, 1, "A", 1, 1), ("2", 1, "B", None, None)]
    coded = spark.createDataFrame(rows, "id string, pos int, status_category string, like_count long, view_count long")
    summary = coding.group_summary(coded, "status_category")
    assert [tuple(r) for r in summary.collect()] == [("A", 1, 6, 8), ("B", 1, 0, 0)] and "count(distinct" not in planned(summary)


# --- files


def test_conform_types_by_name(spark):
    schema = schemas.posts(schemas.SUPPLEMENTS)
    rows = [("True", "5.0", "12", "x", "7", "e"), ("false", "many", " 8 ", None, "2.5", "e"), ("1", "", None, "y", None, "e"), ("yes", "9007199254740993", "1e3", "z", "0", "e")]
    df = spark.createDataFrame(rows, "menopause string, view_count string, like_count string, id string, misleading string, extra string")
    found = files.conform(df, schema)
    assert set(schema.fieldNames()) <= set(found.columns) and found.columns[-2:] == ["extra", "broken"]
    got = [(r["menopause"], r["view_count"], r["like_count"], r["id"], r["misleading"], r["duration"], r["broken"]) for r in found.collect()]
    assert got == [
        (True, 5, 12, "x", 7, None, {}), (False, None, 8, None, None, None, {"view_count": "many", "misleading": "2.5"}),
        (True, None, None, "y", None, None, {}), (None, 9007199254740993, 1000, "z", 0, None, {"menopause": "yes"}),
    ]


def test_csv_and_parquet_give_the_same_posts(spark, tmp_path):
    long = 'a "quoted" title,\\nof two lines'
    df = spark.createDataFrame([("1", long, 9, True), ("2", long, 100, True), ("3", "short", 5, False), ("4", None, None, None)], "id string, title string, view_count long, menopause boolean")
    df.coalesce(1).write.csv(str(tmp_path / "p.csv"), header=True, quote='"', escape='"')
    df.write.parquet(str(tmp_path / "p.parquet"))
    kept = []
    for name in ("p.csv", "p.parquet"):
        table = files.read_posts(spark, str(tmp_path / name))
        kept.append([r["id"] for r in posts.dedup_posts(posts.screen_flag(table, "menopause")).collect()])
    assert kept == [["2"], ["2"]]


def test_responses_under_any_key(spark, tmp_path):
    keys = ["a b [1]", "c/d", "é=ü?", "100%", "x+y", "{z}", "12", "012"]
    df = spark.createDataFrame([(k, json.dumps({"n": k})) for k in keys] + [(None, "{}"), ("gone", None)], "file_key string, value string")
    files.write_responses(df, str(tmp_path / "in"))
    good, bad = files.read_results(spark, str(tmp_path / "in"), keyed=True)
    assert {r["file_key"]: r["annotation"]["n"] for r in good.collect()} == {k: k for k in keys} and bad.count() == 0


def test_packed_responses_come_back_as_they_were(spark, tmp_path):
    told = {"a b [1]": '{"n": "x\\ny"}\n\n', "c/d": " {broken\n", "": "[1]", "012": '{"n": null}'}
    df = spark.createDataFrame([*told.items(), (None, "{}"), ("gone", None)], "file_key string, value string")
    files.pack_responses(df, str(tmp_path / "in"))
    good, bad = files.read_results(spark, str(tmp_path / "in"), packed=True)
    assert {r["file_key"]: r["annotation"]["n"] for r in good.collect()} == {"a b [1]": "x\ny", "012": None}
    assert {(r["file_key"], r["value"], r["reason"]) for r in bad.collect()} == {("c/d", told["c/d"], "no JSON"), ("", "[1]", "no object")}
    meta = files.read_metadata(spark, str(tmp_path / "in"), packed=True)
    assert {r["file_key"] for r in meta.collect()} == set(told) and meta.columns[0] == "file_key"


def test_packs_are_picked_up_once(spark, tmp_path):
    """Three runs, packs with brackets in their names and equal rows among them."""
    folder, picked = tmp_path / "in", []
    for run, numbers in enumerate(((1, 2, 2), (3,), ())):
        if numbers:
            files.pack_responses(spark.createDataFrame([(str(n), '{"n": 1}' if n % 2 else "[]") for n in numbers], "file_key string, value string").coalesce(1), str(folder))
            pack = max(folder.glob("part-*.parquet"), key=lambda f: f.stat().st_mtime_ns)
            (folder / f"pack [{run}].parquet").write_bytes(pack.read_bytes())
        pick_up(spark, str(folder), str(tmp_path / "checkpoint"), str(tmp_path / f"out{run}"), packed=True)
        good, bad = read_picked_up(spark, str(tmp_path / f"out{run}"))
        picked.append((sorted(r["file_key"] for r in good.collect()), sorted(r["file_key"] for r in bad.collect())))
    assert picked == [(["1"] * 2, ["2"] * 4), (["3"] * 2, []), ([], [])]


@pytest.mark.parametrize("name,folder", [("read_results", "responses"), ("read_metadata", "metadata"), ("stream_results", "stream")])
def test_files_of_responses_do_not_grow_with_them(spark, monkeypatch, tmp_path, name, folder):
    monkeypatch.setattr(files, "shared_folder", lambda spark, name: str(tmp_path / name))
    labels = spark.read.parquet(f"{SF}/labels.parquet").count()
    assert plain.Q[name](spark, SF).count() == labels
    assert len(list((tmp_path / folder / ("in" if name == "stream_results" else "")).rglob("part-*"))) <= 4 < labels
