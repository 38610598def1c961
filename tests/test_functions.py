"""Scalars, row by row."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, text


def values(spark, rows, what):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(what(F.col("c"))).collect()]


LISTS = ["[a, b]", "['a', 'b']", '["a","b"]', "['Lion's Mane', 'Zinc']", "a, b", "[]", "", None, "None", " [a]", "a (b, c)", "a,,b"]


def test_split_terms(spark):
    assert values(spark, LISTS, text.split_terms) == [["a", "b"], ["a", "b"], ["a", "b"], ["Lion's Mane", "Zinc"], ["a", "b"], [""], [""], [], ["None"], ["[a"], ["a (b", "c)"], ["a", "", "b"]]


def test_parse_list(spark):
    assert values(spark, LISTS, text.parse_list) == [["a", "b"], ["a", "b"], ["a", "b"], ["Lion", ","], ["a", "b"], [], [], [], [], ["a"], ["a (b", "c)"], ["a", "b"]]


def test_parse_list_reads_json_first(spark):
    assert values(spark, ['["Lion\'s Mane", "Zinc"]', "['a']"], lambda c: text.parse_list(c, "json")) == [["Lion's Mane", "Zinc"], ["a"]]


def test_title_case(spark):
    samples = ["st john's wort", "5-htp", "omega-3s", "VITAMIN D", "", None, "élan vital", "a.b c"]
    assert values(spark, samples, text.title_case) == [s if s is None else s.title() for s in samples]


def test_strip_takes_all_white_space(spark):
    assert values(spark, ["  a ", "a b", None], text.strip) == ["a", "a b", None]


def test_aliases_and_keys(spark):
    assert values(spark, ["hrt", " Omega-3 ", "vitamin d", "zinc oxide"], text.alias_title) == ["HRT", "Omega-3", "Vitamin D", "Zinc Oxide"]
    assert values(spark, [" Zinc.. ", "B.6", None], text.term_key) == ["zinc", "b.6", None]


def test_symptoms(spark):
    found = values(spark, ["anxiety, hot flushes, menopause, , STRESS"], lambda c: text.normalize_symptoms(text.split_terms(c)))
    assert found == [["Mood Changes", "Hot Flushes", "", "Mood Changes"]]


@pytest.mark.parametrize(("url", "left"), [("http://a/?ref=1&b=2", "http://a/?b=2"), ("http://a/?b=2&ref=1", "http://a/?b=2"), ("http://a/?ref=1", "http://a/"), ("http://a/?", "http://a/?"), (None, None)])
def test_strip_url_param(spark, url, left):
    assert values(spark, [url], lambda c: text.strip_url_param(c, "ref")) == [left]


def test_clock(spark):
    assert values(spark, ["1:05", "1:02:03", "x", "", None, "7", "1:x"], text.clock_to_seconds) == [65, 3723, None, None, None, None, None]


def test_dates(spark):
    d = datetime.date
    rows = ["20240229", "20240230", "20150127.0", "2024-01-05", "2024010", None, "1e30", "soon"]
    assert values(spark, rows, dates.parse_ymd) == [d(2024, 2, 29), None, None, None, None, None, None, None]
    assert values(spark, rows, dates.parse_date_loose) == [d(2024, 2, 29), None, d(2015, 1, 27), d(2024, 1, 5), None, None, None, None]


def test_loose_bool(spark):
    assert values(spark, ["True", "1", "yes", None, "false"], text.loose_bool) == [True, True, False, False, False]
