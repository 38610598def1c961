"""Statistics of posts: platforms, sentiment, popularity, terms, symptoms and findings."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_end
from ..functions.text import REPORT_ALIASES, TOP_SENTINELS, alias_key, alias_name, alias_title, drop_sentinels, loose_bool, parse_list, split_terms, symptom_keys, title_case
from ..schemas import PLATFORMS
from .coding import canonicalize
from .links import value_counts
from .posts import dedup_posts, is_flagged, screen_flag, screen_platform

METRICS = ("like_count", "view_count", "comment_count")
SENTIMENTS = ("negative", "neutral", "positive")


def platform_summary(df: DataFrame, coerce: bool = False) -> DataFrame:
    """Posts with an id and sums of the metrics for each platform, most posts first.

    With ``coerce`` texts are read as numbers (bad ones as 0) and absent metrics are
    0; platforms are counted, whatever the id.
    """
    known = df.filter(F.col("extractor").isNotNull())
    metric = lambda m: (F.coalesce(F.col(m).try_cast("double"), F.lit(0.0)) if m in df.columns else F.lit(0.0)) if coerce else F.col(m)
    sums = [F.coalesce(F.sum(metric(m)), F.lit(0)).alias(m) for m in METRICS]
    return known.groupBy("extractor").agg(F.count("extractor" if coerce else "id").alias("n_posts"), *sums).orderBy(F.desc("n_posts"), "extractor")


def sentiment_by_month(df: DataFrame) -> DataFrame:
    """Posts of each sentiment by month, 0 where there are none.

    Other sentiments have no column, but their month keeps its row.
    """
    rows = df.filter(F.col("year_month").isNotNull() & F.col("sentiment").isNotNull()).withColumn("sentiment", F.lower("sentiment"))
    return rows.groupBy("year_month").pivot("sentiment", list(SENTIMENTS)).agg(F.count(F.lit(1))).na.fill(0)


def sentiment_share(df: DataFrame) -> DataFrame:
    """G3 as shares of a month's three classes; null for a month without any."""
    counts = sentiment_by_month(df)
    total = sum((F.col(s) for s in SENTIMENTS[1:]), F.col(SENTIMENTS[0]))
    return counts.select("year_month", *(F.try_divide(F.col(s).cast("double"), total.cast("double")).alias(s) for s in SENTIMENTS))


def popularity_by_month(df: DataFrame) -> DataFrame:
    """Posts, likes and views by month."""
    sums = [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in ("like_count", "view_count")]
    return df.filter(F.col("year_month").isNotNull()).groupBy("year_month").agg(F.count("id").alias("n_posts"), *sums)


def posts_per_month(df: DataFrame) -> DataFrame:
    """Posts by month."""
    return df.filter(F.col("year_month").isNotNull()).groupBy("year_month").agg(F.count(F.lit(1)).alias("n_posts"))


def sentiment_distribution(df: DataFrame) -> DataFrame:
    """Posts of each sentiment."""
    return value_counts(df, "sentiment")


def _top(terms: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent terms; of equals the first by name."""
    return terms.groupBy(col).agg(F.count(F.lit(1)).alias("mentions")).orderBy(F.desc("mentions"), col).limit(k)


def _mentions(df: DataFrame, rules: DataFrame, *carry: str) -> DataFrame:
    """A row for each mention of a term that isn't a sentinel, under its canonical name."""
    terms = drop_sentinels(F.transform(split_terms(F.col("supplements")), F.lower), TOP_SENTINELS)
    rows = df.select(*carry, F.explode(terms).alias("term"))
    return rows.join(canonicalize(rows.select("term").distinct(), rules), "term")


def top_terms(df: DataFrame, rules: DataFrame, k: int = 10) -> DataFrame:
    """The k canonical terms with most mentions."""
    return _top(_mentions(df, rules), "canonical", k)


def top_terms_by_month(df: DataFrame, rules: DataFrame, k: int = 3) -> DataFrame:
    """Mentions of the k top terms in every month that has posts, 0 where there are none."""
    mentions = _mentions(df, rules, "year_month")
    top = F.broadcast(_top(mentions, "canonical", k).select("canonical"))
    months = df.select("year_month").filter(F.col("year_month").isNotNull()).distinct()
    counts = mentions.join(top, "canonical", "left_semi").groupBy("year_month", "canonical").agg(F.count(F.lit(1)).alias("n"))
    every = months.crossJoin(top)  # months times k
    return every.join(counts, ["year_month", "canonical"], "left").select("year_month", "canonical", F.coalesce("n", F.lit(0)).alias("mentions"))


def _naming(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row for each name that a post's raw list contains."""
    name = F.explode(F.filter(F.array(*(F.lit(n) for n in names)), lambda n: F.contains(F.col("supplements"), n)))
    return df.filter(F.col("supplements").isNotNull()).select(name.alias("name"), "sentiment", "symptoms")


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n_posts"), *(F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS))


def _common_symptoms(rows: DataFrame) -> DataFrame:
    """(name, symptoms, n, rank): each name's most common symptom fields."""
    return _first_fields(rows.filter(F.col("symptoms").isNotNull()).groupBy("name", "symptoms").agg(F.count(F.lit(1)).alias("n")))


def _first_fields(fields: DataFrame, k: int = 3) -> DataFrame:
    """The k symptom fields of each name that most posts have, with their rank."""
    first = Window.partitionBy("name").orderBy(F.desc("n"), "symptoms")
    return fields.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def content_profile(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """For each name, posts whose raw list contains it: their number, by sentiment, and their three most common symptom fields."""
    rows = _naming(df, names)
    listed = _common_symptoms(rows).groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "symptoms"))), lambda x: x["symptoms"]), " / ").alias("common_symptoms"))
    return _counted(rows).join(listed, "name", "left")


def report_terms(col: str = "supplements") -> Column:
    """A field's terms as the report names them."""
    return F.transform(parse_list(F.col(col)), lambda x: alias_title(x, REPORT_ALIASES))


def content_profile_member(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """For each name, posts that list it: number, by sentiment, percent marketing (cut off) and median misleading."""
    listed = df.withColumn("__terms", F.array_distinct(report_terms()))
    rows = listed.select(F.explode(F.array_intersect("__terms", F.array(*(F.lit(n) for n in names)))).alias("name"), "sentiment", "marketing", "misleading")
    percent = F.floor(100 * F.avg(loose_bool(F.col("marketing")).cast("int"))).cast("int")
    return rows.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_posts"), *(F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS),
        percent.alias("marketing_percent"), F.percentile(F.col("misleading").try_cast("double"), 0.5).alias("median_misleading"),
    )


def _named(keys: DataFrame, name: str, shown: Callable[[Column], Column], *by: str) -> DataFrame:
    """(name, *by, n): how often each name occurs; names are made of the distinct values of ``key``."""
    counts = keys.groupBy("key", *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn(name, shown(F.col("key"))).groupBy(name, *by).agg(F.sum("n").alias("n"))


def _first(counts: DataFrame, name: str, k: int) -> DataFrame:
    """The k names with most mentions; of equals the first."""
    return counts.select(name, F.col("n").alias("mentions")).orderBy(F.desc("mentions"), name).limit(k)


def report_keys(col: str = "supplements") -> Column:
    """A field's terms, by the key of the name that the report gives them."""
    return F.transform(parse_list(F.col(col)), lambda x: alias_key(x, REPORT_ALIASES))


def _said_symptoms() -> Column:
    """The keys of a post's symptoms; null for a post that says none."""
    return F.when(F.col("symptoms").isNotNull() & (F.lower("symptoms") != "none"), symptom_keys(split_terms(F.col("symptoms"))))


def top_symptoms(df: DataFrame, k: int = 10) -> DataFrame:
    """The k symptoms with most mentions; an empty item of a list counts too."""
    return _first(_named(df.select(F.explode(_said_symptoms()).alias("key")), "symptom", title_case), "symptom", k)


def report_top_terms(df: DataFrame, k: int = 10) -> DataFrame:
    """The k terms with most mentions, as the report names them."""
    return _first(_named(df.select(F.explode(report_keys()).alias("key")), "term", alias_name), "term", k)


def report_top_symptoms(df: DataFrame, k: int = 10) -> DataFrame:
    """The k symptoms with most mentions, in title case."""
    return _first(_named(df.select(F.explode(F.transform(parse_list(F.col("symptoms")), F.lower)).alias("key")), "symptom", title_case), "symptom", k)


def report_trend(df: DataFrame, k: int = 3) -> DataFrame:
    """Mentions of the report's k top terms by end of month, long form, for months that have any.

    A term is 0 in a month in which only others were named.
    """
    # Parts of the lists are counted as they are; keys and names are made of the distinct ones.
    parts = df.select(month_end(F.col("date")).alias("month_end"), F.explode(parse_list(F.col("supplements"))).alias("key"))
    counts = _named(parts, "term", lambda part: alias_name(alias_key(part, REPORT_ALIASES)), "month_end")
    # Each term keeps its months beside it. A join of the counts with the top would be moved below the sums, onto the mentions, and name each of them.
    monthly = F.map_from_entries(F.collect_list(F.when(F.col("month_end").isNotNull(), F.struct("month_end", "n"))))
    terms = counts.groupBy("term").agg(F.sum("n").alias("mentions"), monthly.alias("monthly"))
    top = terms.orderBy(F.desc("mentions"), "term").limit(k).agg(F.collect_list(F.struct("term", "monthly")).alias("top"))  # months times k
    months = F.array_distinct(F.flatten(F.transform("top", lambda t: F.map_keys(t["monthly"]))))
    every = top.select("top", F.explode(months).alias("month_end")).select("month_end", F.explode("top").alias("t"))
    return every.select("month_end", "t.term", F.coalesce(F.try_element_at("t.monthly", F.col("month_end")), F.lit(0)).alias("mentions"))


def inclusion_counts(df: DataFrame, flag: str) -> DataFrame:
    """One row: posts loaded, after the platform filter (none is applied here) and included."""
    inside = is_flagged(df, flag, "text") if flag in df.columns else F.lit(True)
    return df.agg(F.count(F.lit(1)).alias("loaded"), F.count(F.lit(1)).alias("after_platform_filter"), F.count_if(inside).alias("included"))


#: What a post adds to a fact it bears.
FACTS = ("n", "ids", "like_count", "view_count", "comment_count", *SENTIMENTS, "told", "marketed")


def _facts(df: DataFrame, names: Mapping[str, Column], at: Mapping[str, Column], sums: Sequence[tuple[Sequence[str], Mapping[str, Column]]]) -> DataFrame:
    """A row for each name that a post bears: what ``kind``, of which ``name``, when, and what it adds.

    ``names`` are a post's lists by kind; ``at`` and ``sums`` say, by kind and for some kinds, what a fact holds
    besides, and one for each fact. All of that is worked out once a post, before
    the lists are taken apart, and dealt out to its facts by plain comparisons of their kind.
    """
    lists = [F.coalesce(listed, F.array().cast("array<string>")).alias(f"__{kind}") for kind, listed in names.items()]
    held = {f"__at_{kind}": c.cast("string") for kind, c in at.items()} | {f"__{i}_{c}": x.cast("double") for i, (_, row) in enumerate(sums) for c, x in row.items()}
    facts = lambda kind: F.transform(f"__{kind}", lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name")))
    told = df.select(*lists, *(c.alias(name) for name, c in held.items()))
    rows = told.select(*held, F.explode(F.concat(*map(facts, names))).alias("x")).select("x.*", *held).filter("name IS NOT NULL")
    place = F.coalesce(*(F.when(F.col("kind") == kind, F.col(f"__at_{kind}")) for kind in at))
    value = lambda c: F.coalesce(*(F.when(F.col("kind").isin(*kinds), F.col(f"__{i}_{c}")) for i, (kinds, row) in enumerate(sums) if c in row), F.lit(1.0 if c == "n" else 0.0))
    return rows.select("kind", "name", place.alias("at"), *(value(c).alias(c) for c in FACTS))


def _number(df: DataFrame, metric: str) -> Column:
    """A metric as a number; texts that are none, nulls and absent ones are 0."""
    return F.coalesce(F.col(metric).try_cast("double"), F.lit(0.0)) if metric in df.columns else F.lit(0.0)


def analysis_facts(scope: DataFrame) -> DataFrame:
    """What the posts of the analysis add to its sections: by platform, month, sentiment, term and symptom."""
    said = {s: (F.lower("sentiment") == s).cast("int") for s in SENTIMENTS}
    sums = {m: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in METRICS} | said
    sums |= {"ids": F.col("id").isNotNull().cast("int"), "told": F.col("sentiment").isNotNull().cast("int")}
    names = {kind: F.array(F.col(c).cast("string")) for kind, c in (("platforms", "extractor"), ("months", "year_month"), ("sentiment", "sentiment"))}
    one = [(tuple(names), sums)]
    names["terms"] = drop_sentinels(F.transform(split_terms(F.col("supplements")), F.lower), TOP_SENTINELS)
    names["top_symptoms"] = _said_symptoms()
    return _facts(scope, names, {"terms": F.col("year_month")}, one)


def report_facts(df: DataFrame, flag: str) -> DataFrame:
    """What posts add to the report's sections: whether they are included, and by platform, term, member and symptom if so."""
    inside = is_flagged(df, flag, "text") if flag in df.columns else F.lit(True)
    said = {s: F.coalesce((F.col("sentiment") == s).cast("int"), F.lit(0)) for s in SENTIMENTS}
    once = df.withColumns({"__inside": inside, "__keys": F.when(inside, report_keys())})  # read twice
    names = {
        "inclusion": F.array(F.lit("all")), "report_platforms": F.when(F.col("__inside"), F.array(F.col("extractor").cast("string"))), "report_top_terms": F.col("__keys"), "members": F.array_distinct("__keys"),
        "report_top_symptoms": F.when(F.col("__inside"), F.transform(parse_list(F.col("symptoms")), F.lower)),
    }
    at = {"report_top_terms": month_end(F.col("date")), "members": F.col("misleading").try_cast("double")}
    sums = [(("inclusion",), {"ids": F.col("__inside").cast("int")}), (("report_platforms",), {m: _number(df, m) for m in METRICS}), (("members",), {"marketed": loose_bool(F.col("marketing")).cast("int"), **said})]
    return _facts(once, names, at, sums)


def _long(df: DataFrame, section: str, metrics: Mapping[str, Column], key: str = "name", rank: Column | None = None) -> DataFrame:
    """(section, rank, key, metric, value) rows of a summary that has ``rank``, or is ranked by ``rank`` over its few rows."""
    place = F.col("rank") if rank is None else F.row_number().over(Window.orderBy(rank, key))
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in metrics.items()))
    ranked = df.select(place.cast("int").alias("rank"), F.col(key).cast("string").alias("key"), pairs.alias("m"))
    return ranked.select(F.lit(section).alias("section"), "rank", "key", F.explode("m").alias("m")).select("section", "rank", "key", "m.metric", "m.value")


def _densely(months: DataFrame, top: DataFrame, counts: DataFrame, section: str) -> DataFrame:
    """Mentions of each top term in every month, 0 where there are none; the rank is the month's."""
    every = months.withColumn("rank", F.row_number().over(Window.orderBy("at"))).crossJoin(F.broadcast(top.select("name")))  # months times a few
    met = every.join(counts, ["at", "name"], "left")
    return met.select(F.lit(section).alias("section"), "rank", F.col("at").alias("key"), F.col("name").alias("metric"), F.coalesce("n", F.lit(0.0)).alias("value"))


def findings(posts: DataFrame, rules: DataFrame, flag: str, folder: str, allowed: Sequence[str] = PLATFORMS, k: int = 10, tracked: int = 3) -> DataFrame:
    """All results of a profile as one long table: (section, rank, key, metric, value).

    ``posts`` have dates and periods. The analysis is of posts on topic of the allowed
    platforms without copies, the report of those whose flag reads true. Sections of
    the analysis: platforms, sentiment_by_month, sentiment_share, popularity_by_month,
    posts_per_month, sentiment, top_terms, top_terms_by_month, content_profile, content_symptoms and
    top_symptoms; of the report: inclusion, report_platforms, report_top_terms, report_trend,
    report_profile and report_top_symptoms. A rank counts from 1 in a section, by number or month; of a
    term's symptoms within the term. Months without a date and shares of nothing are left out
    or null.

    Every post is turned into the facts it bears, in one pass a scope, and these are
    added up before they move, to a row for each term and month; names are made of distinct terms only. Those sums are written
    to ``folder``; all sections are made from them, but for the posts that name the
    terms found on top, whose few names a second pass looks for and writes, added up too.
    """
    spark = posts.sparkSession
    scope = dedup_posts(screen_flag(screen_platform(posts, allowed), flag))
    facts = analysis_facts(scope).unionByName(report_facts(posts, flag)).groupBy("kind", "name", "at").agg(*(F.sum(c).alias(c) for c in FACTS))
    facts.write.mode("overwrite").parquet(f"{folder}/facts")
    facts = spark.read.parquet(f"{folder}/facts")
    of = lambda *kinds: facts.filter(F.col("kind").isin(*kinds))
    raw = of("terms").select(F.col("name").alias("term"), "at", "n")
    named = raw.join(canonicalize(raw.select("term"), rules), "term").select(F.lit("top_terms").alias("kind"), F.col("canonical").alias("name"), "at", "n")
    shown = F.when(F.col("kind") == "report_top_terms", alias_name(F.col("name"))).otherwise(title_case(F.col("name")))
    others = of("report_top_terms", "top_symptoms", "report_top_symptoms").select("kind", shown.alias("name"), "at", "n")
    mentions = named.unionByName(others).groupBy("kind", "name", "at").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("kind").orderBy(F.desc("mentions"), "name")
    top = mentions.groupBy("kind", "name").agg(F.sum("n").alias("mentions")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    top.write.mode("overwrite").parquet(f"{folder}/top")
    top = spark.read.parquet(f"{folder}/top")  # k rows a kind
    first = {kind: top.filter((F.col("kind") == kind) & (F.col("rank") <= tracked)).select("name", "rank") for kind in ("top_terms", "report_top_terms")}
    followed = {kind: mentions.filter((F.col("kind") == kind) & F.col("at").isNotNull()).join(F.broadcast(first[kind]), "name").select("at", "name", "n") for kind in first}
    months = of("months")
    ranked = lambda n: -F.col(n)
    same = lambda *names: {n: F.col(n) for n in names}
    told = months.filter("told > 0")
    classes = sum((F.col(s) for s in SENTIMENTS[1:]), F.col(SENTIMENTS[0]))
    members = of("members").withColumn("name", alias_name(F.col("name"))).join(F.broadcast(first["report_top_terms"]), "name")
    median = F.percentile(F.col("at").cast("double"), 0.5, F.col("n").cast("long"))
    profiles = members.groupBy("name", "rank").agg(*(F.sum(c).alias(c) for c in ("n", *SENTIMENTS, "marketed")), median.alias("median_misleading"))
    parts = [
        _long(of("inclusion"), "inclusion", {"loaded": F.col("n"), "after_platform_filter": F.col("n"), "included": F.col("ids")}, rank=F.lit(1)),
        _long(of("platforms"), "platforms", {"n_posts": F.col("ids"), **same(*METRICS)}, rank=ranked("ids")),
        _long(told, "sentiment_by_month", same(*SENTIMENTS), rank=F.lit(1)),
        _long(told, "sentiment_share", {s: F.try_divide(F.col(s), classes) for s in SENTIMENTS}, rank=F.lit(1)),
        _long(months, "popularity_by_month", {"n_posts": F.col("ids"), **same("like_count", "view_count")}, rank=F.lit(1)),
        _long(months, "posts_per_month", {"n_posts": F.col("n")}, rank=F.lit(1)),
        _long(of("sentiment"), "sentiment", same("n"), rank=ranked("n")),
        *(_long(top.filter(F.col("kind") == kind), kind, same("mentions")) for kind in ("top_terms", "top_symptoms", "report_top_terms", "report_top_symptoms")),
        _densely(months.select(F.col("name").alias("at")), first["top_terms"], followed["top_terms"], "top_terms_by_month"),
        _long(of("report_platforms"), "report_platforms", {"n_posts": F.col("n"), **same(*METRICS)}, rank=ranked("n")),
        _densely(followed["report_top_terms"].select("at").distinct(), first["report_top_terms"], followed["report_top_terms"], "report_trend"),
        _long(profiles, "report_profile", {"n_posts": F.col("n"), **same(*SENTIMENTS), "marketing_percent": F.floor(100 * (F.col("marketed") / F.col("n"))), **same("median_misleading")}),
    ]
    names = [r["name"] for r in first["top_terms"].orderBy("rank").collect()]  # a few
    if names:
        said = (F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS)
        _naming(scope, names).groupBy("name", "symptoms").agg(F.count(F.lit(1)).alias("n_posts"), *said).write.mode("overwrite").parquet(f"{folder}/named")
        named = spark.read.parquet(f"{folder}/named")
        counted = named.groupBy("name").agg(*(F.sum(c).alias(c) for c in ("n_posts", *SENTIMENTS)))
        fields = _first_fields(named.filter(F.col("symptoms").isNotNull()).select("name", "symptoms", F.col("n_posts").alias("n")))
        place = F.element_at(F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i + 1))), F.col("name"))
        parts.append(_long(counted.withColumn("rank", place), "content_profile", same("n_posts", *SENTIMENTS)))
        parts.append(fields.select(F.lit("content_symptoms").alias("section"), F.col("rank").cast("int").alias("rank"), F.col("name").alias("key"), F.col("symptoms").alias("metric"), F.col("n").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)
