"""Operators on small tables: nulls, ties, empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import annotate, coding, funnel, links, posts, stats
from tidemark.plans.views import rules
from tidemark.sources import files
from tidemark.streaming.pickup import pick_up

LINK = "link string, duration string, title string, source string, author string"
POST = "id string, title string, duration double, view_count long"


def test_merge_prefers_new_and_keeps_one_null(spark):
    old = spark.createDataFrame([("a", "1:00", "old", "TikTok", "x"), (None, "1", "n", "TikTok", "x")], LINK)
    new = spark.createDataFrame([("a", "1:00", "new", "TikTok", "x"), (None, "2", "n", "TikTok", "x"), ("b", "2", "b", "Vimeo", "x")], LINK)
    merged = links.merge_links(new, old)
    assert {(r["link"], r["title"]) for r in merged.collect()} == {("a", "new"), (None, "n"), ("b", "b")}
    assert merged.count() == links.merge_links(merged, merged).count()
    assert [r["link"] for r in links.new_links(merged, old).collect()] == ["b"]
    assert links.merge_summary(merged, old).first()[:] == (1, 3)
    assert links.set_overlap(new, old).first()[:] == (1, 2, 0)
    assert links.allow_sources(merged).count() == 2


def test_parse_cards(spark):
    cards = spark.createDataFrame([("1:05\nT\nTikTok · 3 days · Ann",), ("1\nT",), ("1\nT\n ",), ("1\nT\nX",), (None,), ("1\nT\n · b",)], "text string")
    found = {(r["source"], r["author"]) for r in links.parse_cards(cards).collect()}
    assert found == {("TikTok", "Ann"), ("X", "X"), ("· b", "· b")}


def test_describe_empty(spark):
    row = links.describe_stats(spark.createDataFrame([], "x double"), "x").first()
    assert row["count"] == 0 and row["p50"] is None
    assert links.total_seconds(spark.createDataFrame([], "seconds long")).first()[0] == 0


def test_flatten(spark):
    df = spark.createDataFrame([(1, (2, (3,)))], "a int, b struct<c: int, d: struct<e: int>>")
    assert links.flatten_struct(df).columns == ["a", "b.c", "b.d.e"]


def test_dedup_posts(spark):
    long = "a title that is long enough"
    rows = [
        ("1", long, 61.5, 5), ("2", f" {long.upper()} ", 62.5, 9), ("3", long, 62.4, None), ("4", long, None, 1), ("5", long, None, 1),
        ("6", "14 characters!", 1.0, 1), ("7", "14 characters!", 1.0, 1), ("8", "15 characters!!", 1.0, 1), ("9", "15 characters!!", 1.0, 1), ("a", None, None, None),
    ]
    df = spark.createDataFrame(rows, POST)
    # 61.5, 62.5 and 62.4 all round to 62; null durations are equal.
    assert {r["id"] for r in posts.dedup_posts(df).collect()} == {"2", "4", "6", "7", "8", "a"}
    assert posts.dedup_stats(df).first()[:] == (10, 6, 4)
    assert posts.dedup_posts(posts.dedup_posts(df)).count() == 6


def test_flags(spark):
    typed = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    said = spark.createDataFrame([("True",), ("true",), ("yes",), ("1",), (None,)], "f string")
    assert posts.screen_flag(typed, "f").count() == 1
    assert posts.screen_flag(said, "f").count() == 0
    assert posts.screen_flag(said, "f", "text").count() == 2
    assert posts.screen_flag(said, "g", "text").count() == 5
    assert posts.screen_flag(spark.createDataFrame([(1,), (2,)], "f int"), "f").count() == 1


def test_sentiment_types(spark):
    assert [r[0] for r in posts.normalize_sentiment(spark.createDataFrame([("MiXed",)], "sentiment string")).collect()] == ["mixed"]
    assert [r[0] for r in posts.normalize_sentiment(spark.createDataFrame([(3,)], "sentiment int")).collect()] == [None]
    assert posts.normalize_sentiment(spark.createDataFrame([(3,)], "x int")).columns == ["x"]


def test_union_ragged(spark):
    out = posts.union_ragged([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")])
    assert sorted(map(tuple, out.collect()), key=str) == [(1, None), (None, 2)]


def test_coding(spark):
    terms = spark.createDataFrame([("Small Bolt.",), ("old gear",), ("a rod",), ("thing",), ("hot ring",)], "term string")
    pack = rules(spark)
    assert {r[0]: r[1] for r in coding.canonicalize(terms, pack).collect()}["thing"] == "Thing"
    status = {r[0]: r[1] for r in coding.status_category(terms, pack).collect()}
    assert status == {"Small Bolt.": "Fasteners", "old gear": coding.UNMATCHED, "a rod": "Stock", "thing": coding.UNMATCHED, "hot ring": "Treated parts"}
    target = {r[0]: r[1] for r in coding.target_group(terms, pack).collect()}
    assert target["old gear"] == "Mechanics" and target["a rod"] == coding.GENERAL
    assert [r["pattern"] for r in coding.shadowed_rules(pack).collect()] == ["old gear"]


def test_primary_category_ties(spark):
    rows = [("1", 0, coding.UNMATCHED), ("1", 1, "B"), ("2", 0, "B"), ("2", 1, "A"), ("3", 0, coding.UNMATCHED), ("3", 1, coding.UNMATCHED), ("3", 2, "A")]
    found = coding.primary_category(spark.createDataFrame(rows, "id string, pos int, status_category string"))
    assert {r[0]: r[1] for r in found.collect()} == {"1": "B", "2": "B", "3": coding.UNMATCHED}


def test_platform_summary_nulls(spark):
    df = spark.createDataFrame([("a", "x", None), ("b", "x", None), (None, "x", "3"), ("c", None, "1")], "id string, extractor string, view_count string")
    strict = stats.platform_summary(df.select("id", "extractor", F.col("view_count").cast("long"), F.lit(None).cast("long").alias("like_count"), F.lit(1).alias("comment_count")))
    assert strict.collect()[0][:] == ("x", 2, 0, 3, 3)
    assert stats.platform_summary(df, coerce=True).collect()[0][:] == ("x", 3, 0.0, 3.0, 0.0)


def test_shares_of_nothing(spark):
    edges = spark.createDataFrame([("a", "b", 0, "kept")], "src string, dst string, n long, kind string")
    row = funnel.funnel_shares(edges, spark.createDataFrame([(0,)], "n long")).first()
    assert row["percent_of_src"] is None and row["dst_percent_of_links"] is None


def test_relabel_by_table(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    labels = spark.createDataFrame([("a", "A")], "name string, label string")
    assert {r[0] for r in funnel.relabel(df, labels, "c").collect()} == {"A", "b", None}


def test_annotate_retries(spark, tmp_path):
    def infer(prompt):
        if prompt == "bad":
            return "not json"
        if prompt == "fails":
            raise RuntimeError("down")
        return '```json\n{"a": 1}\n```'

    df = spark.createDataFrame([("1", "ok"), ("2", "bad"), ("3", "fails")], "file_key string, prompt string")
    found = {r["file_key"]: r for r in annotate.annotate(df, infer).collect()}
    assert found["1"]["response"] == '{"a": 1}' and found["1"]["attempts"] == 1
    assert found["2"]["attempts"] == 3 and "JSON" in found["2"]["error"]
    assert found["3"]["error"] == "RuntimeError: down"


def test_project_annotation(spark):
    said = {"supplements": ["a", "b"], "symptoms": "['x', 'y']", "sentiment": "Positive", "misleading": "7", "usefulness": 3, "menopause": "True", "description": "d"}
    df = spark.createDataFrame([(json.dumps(said),), (None,), ("[1]",)], "response string")
    row = annotate.project_annotation(df, schemas.SUPPLEMENTS).collect()[0]
    assert row["supplements"] == ["a", "b"] and row["symptoms"] == ["x", "y"] and row["misleading"] == 7 and row["usefulness"] == 3 and row["menopause"] is True and row["AI_description"] == "d"


@pytest.fixture
def folders(tmp_path):
    results, meta = tmp_path / "results", tmp_path / "meta"
    results.mkdir(), meta.mkdir()
    for name, value in {"a b [1]": {"description": "AI", "sentiment": "GOOD", "view_count": None, "mood": "x"}, "c": {"sentiment": "bad"}, "broken": None, "list": [1]}.items():
        (results / f"{name}.result.json").write_text("{oops" if value is None else json.dumps(value))
    (meta / "a b [1].info.json").write_text(json.dumps({"id": "1", "title": "T", "description": "meta", "view_count": 5, "upload_date": "20240101", "unknown": 1, "ext": "mp4"}))
    return str(results), str(meta)


def test_read_and_join(spark, folders):
    good, bad = files.read_results(spark, folders[0])
    assert {r["reason"] for r in bad.collect()} == {"no JSON", "no object"} and good.count() == 2
    joined = posts.join_results(good, files.read_metadata(spark, folders[1])).collect()
    one = next(r for r in joined if r["id"] == "1")
    assert one["description"] == "meta" and one["AI_description"] == "AI" and one["view_count"] is None and one["sentiment"] == "good"
    assert joined[-1]["id"] is None  # nulls last
    shown = good.select(files.shown_key(F.col("file_key"))).collect()
    assert "a b [1]" in {r[0] for r in shown}


def test_stream_takes_each_file_once(spark, folders, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    pick_up(spark, folders[0], checkpoint, out)
    assert spark.read.parquet(f"{out}/good").count() == 2
    (tmp_path / "results" / "new.result.json").write_text('{"sentiment": "x"}')
    pick_up(spark, folders[0], checkpoint, out)
    pick_up(spark, folders[0], checkpoint, out)
    assert spark.read.parquet(f"{out}/good").count() == 3


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", "1:0", 'say "hi"\nthere', "TikTok", "x"), ("a", "1:0", "t", "TikTok", "y"), ("a", "2:0", "t", "TikTok", "y")], LINK)
    files.write_links(df, str(tmp_path / "links"))
    assert sorted(r["title"] for r in files.read_links(spark, str(tmp_path / "links")).collect()) == ['say "hi"\nthere', "t", "t"]
    files.write_link_list(df, str(tmp_path / "list"))
    assert files.read_terms(spark, str(tmp_path / "list")).count() == 2
    files.write_coding({"a": df, "b": df}, str(tmp_path / "coding"))
    assert spark.read.parquet(str(tmp_path / "coding" / "b")).count() == 3
    assert files.write_posts(df, str(tmp_path / "posts.parquet")) and not files.write_posts(df.limit(0), str(tmp_path / "none"))
    assert files.read_posts(spark, str(tmp_path / "posts.parquet")).count() == 3
    with pytest.raises(ValueError):
        files.read_posts(spark, "x.xlsx")


def test_pick_results(spark):
    base, none = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([], "a int")
    assert posts.pick_results(base, none) is base and posts.pick_results(none, base) is base


def test_a_sentiment_that_is_no_text_is_none(spark):
    said = [("a", '{"sentiment": 5, "n": 5}'), ("b", '{"sentiment": "Good"}'), ("c", '{"n": 1}'), ("d", '{"sentiment": null}')]
    found = {r["file_key"]: r["annotation"] for r in files.good_results(spark.createDataFrame(said, "file_key string, value string")).collect()}
    assert found == {"a": {"sentiment": None, "n": "5"}, "b": {"sentiment": "Good"}, "c": {"n": "1"}, "d": {"sentiment": None}}


def test_listed_terms_go_before_patterns(spark):
    made = spark.createDataFrame([("status", 1, "regex", "zinc", "Pattern"), ("status", 2, "exact", "zinc", "Listed")], schemas.RULES)
    found = coding.status_category(spark.createDataFrame([("Zinc",), ("zinc oxide",), ("iron",), (None,)], "term string"), made).collect()
    assert {(r["term"], r["status_category"]) for r in found} == {("Zinc", "Listed"), ("zinc oxide", "Pattern"), ("iron", coding.UNMATCHED), (None, coding.UNMATCHED)}


def test_profiles_without_posts_are_left_out(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a title of some length", 1.0, 5, True, False), ("2", "A title of some length", 1.0, 9, True, None)], POST + ", one boolean, two boolean")
    made = [schemas.Profile("x", "one", (), (), (), dedup=True), schemas.Profile("y", "two", (), (), ()), schemas.Profile("z", "one", (), (), ()), schemas.Profile("w", "absent", (), (), ())]
    assert posts.run_profiles(rows, made, str(tmp_path / "p")) == {"x": 1, "z": 2}
    assert {(r["profile"], r["id"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("x", "2"), ("z", "1"), ("z", "2")}
    assert not (tmp_path / "p" / "profile=y").exists()
    assert posts.run_profiles(rows, made[3:], str(tmp_path / "q")) == {} and posts.run_profiles(rows.limit(0), made, str(tmp_path / "r")) == {}
