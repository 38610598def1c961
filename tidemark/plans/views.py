"""The views that the queries read, derived by Spark from the tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_ymd, with_periods
from ..schemas import RULES

FLAG = "topic"
PLATFORMS = ("1-urgent", "2-high", "3-medium", "4-not specified")
SOURCES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")

#: A small rule pack of our own for the terms in these tables: names of parts.
RULE_ROWS = [
    ("canonical", 1, "regex", r"\b(ring|gear)s?\b", "Round parts"),
    ("canonical", 2, "regex", r"^(red|blue) ", "Painted parts"),
    ("canonical", 3, "regex", r"anvil|plate", "Flat parts"),
    ("status", 1, "exact", "small bolt", "Fasteners"),
    ("status", 2, "exact", "large bolt", "Fasteners"),
    ("status", 3, "exact", "new gizmo", "Gadgets"),
    ("status", 4, "regex", r"widget|gizmo", "Gadgets"),
    ("status", 5, "regex", r"^(hot|cold)\b", "Treated parts"),
    ("status", 6, "regex", r"\brod\b", "Stock"),
    ("target", 1, "contains", "ring", "Jewellers"),
    ("target", 2, "contains", "gear", "Mechanics"),
    ("target", 3, "contains", "old gear", "Collectors"),
    ("target", 4, "contains", "rod", "Nobody by inclusion"),
    ("target", 5, "contains", "hot plate", "Cooks"),
    ("target", 6, "contains", "large", "Builders"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULE_ROWS, RULES)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as posts, the names and types of their parts as term lists."""
    read = lambda name: table(spark, sf_dir, name)
    parts = read("part").select("p_partkey", "p_name", "p_type")
    items = read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    listed = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name", "p_type"))).alias("x"))
    as_text = lambda c: F.concat(F.lit("['"), F.array_join(F.col(f"x.{c}"), "', '"), F.lit("']"))
    terms = listed.select("l_orderkey", as_text("p_name").alias("supplements"), as_text("p_type").alias("symptoms"))
    orders = read("orders").join(read("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.join(terms, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    views = F.floor("o_totalprice").cast("long")
    return rows.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("c_name").alias("title"), (F.col("o_totalprice") / 100000).alias("duration"), F.lower("o_orderpriority").alias("extractor"),
        F.when(F.col("o_orderstatus") == "F", "negative").when(F.col("o_orderstatus") == "O", "neutral").otherwise("positive").alias("sentiment"),
        (F.col("o_custkey") % 4 != 0).alias(FLAG), F.date_format("o_orderdate", "yyyyMMdd").alias("upload_date"), views.alias("view_count"), (views % 1000).alias("like_count"),
        (F.col("o_custkey") % 50).alias("comment_count"), F.concat(F.lit("https://posts.example/"), F.col("o_orderkey").cast("string")).alias("webpage_url"), "supplements", "symptoms",
        (1 + F.col("o_orderkey") % 10).cast("string").alias("misleading"), F.when(F.col("o_orderkey") % 3 == 0, "true").when(F.col("o_orderkey") % 3 == 1, "no").alias("marketing"),
    )


def dated(df: DataFrame) -> DataFrame:
    return with_periods(df.withColumn("date", parse_ymd(F.col("upload_date"))))


def docs_as_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("n_chars").cast("double").alias("duration"), F.col("doc_id").alias("view_count"), F.col("lang").alias("extractor"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as links: the host is the source."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", F.col("url").alias("link"), F.concat((F.col("page_id") % 60).cast("string"), F.lit(":0"), (F.col("page_id") % 10).cast("string")).alias("duration"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("source"), F.lit("someone").alias("author"),
    )


def links_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as they were linked before: every third by an address that has changed since."""
    old = F.when(F.col("page_id") % 3 == 0, F.concat("link", F.lit("&old"))).otherwise(F.col("link"))
    return links(spark, sf_dir).withColumn("link", old)


def links_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as links of today."""
    return links(spark, sf_dir)


def order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as links, for the funnel."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("link"), F.col("o_orderpriority").alias("source"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as result cards: the third line's commas stand for its dots."""
    lines = F.split("text", "\n")
    third = F.when(F.size(lines) >= 3, F.replace(F.element_at(lines, 3), F.lit(", "), F.lit(" · ")))
    text = F.when(F.size(lines) >= 3, F.concat_ws("\n", F.element_at(lines, 1), F.element_at(lines, 2), third)).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as metadata; the language is the extension, English without one."""
    docs = table(spark, sf_dir, "documents")
    nothing = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    return docs.select(
        F.col("doc_id").cast("string").alias("file_key"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("extractor"), F.col("source").alias("channel"), *nothing("string", "channel_id", "uploader", "uploader_id"),
        F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("text").alias("description"), *nothing("long", "timestamp"), F.col("n_chars").alias("view_count"), (F.col("n_chars") % 7).alias("like_count"), *nothing("long", "comment_count"),
        F.col("n_chars").cast("double").alias("duration"), F.lit("20240101").alias("upload_date"), F.lit("u").alias("webpage_url"), F.when(F.col("lang") == "de", "mp3").when(F.col("lang") != "en", F.col("lang")).alias("ext"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as annotations of documents. A toxic one overrides the view count with null."""
    labels = table(spark, sf_dir, "labels")
    said = F.create_map(F.lit("description"), F.concat(F.lit("quality "), F.col("quality").cast("string")), F.lit("sentiment"), F.when(F.col("quality") == 1, "Positive").otherwise("NEGATIVE"), F.lit("mood"), F.col("toxic").cast("string"))
    more = F.when(F.col("toxic") == 1, F.create_map(F.lit("view_count"), F.lit(None).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    return labels.select(F.col("doc_id").cast("string").alias("file_key"), F.map_concat(said, more).alias("annotation"))


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as responses in code fences, with a list (in two forms), a text and a flag (in two forms); every fifth is broken."""
    event, n = table(spark, sf_dir, "events"), F.col("event_id")
    tags = F.when(n % 3 == 0, F.format_string('["%s", "x y"]', "event_type")).when(n % 3 == 1, F.format_string("\"['%s', 'x y']\"", "event_type")).otherwise(F.lit("null"))
    flag = F.when(n % 4 == 0, "true").when(n % 4 == 1, '"False"').when(n % 4 == 2, '"maybe"').otherwise("null")
    whole = F.concat(F.rtrim("props", F.lit("} ")), F.format_string(', "tags": %s, "note": "%s", "flag": %s}', tags, "event_type", flag))
    text = F.concat(F.lit("```json\n"), F.when(n % 5 == 0, F.lit("{broken")).otherwise(whole), F.lit("\n``` "))
    return event.select("event_id", "event_type", F.col("props"), text.alias("response"))


def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' minutes and seconds as clock texts."""
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "m:ss").alias("clock"))


Query = Callable[[SparkSession, str], DataFrame]


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
