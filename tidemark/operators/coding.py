"""Coding of free terms into controlled vocabularies by ordered rules.

Rules are rows of ``schemas.RULES``; a layer's rules are tried in order of
priority and the first that fits gives the label. Kinds: ``exact`` (equal),
``contains`` (equal, or longer than three characters and part of the term) and
``regex`` (found anywhere). Every layer codes the distinct terms, however often
they occur, and the codes are joined back to the mentions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import term_key, title_case
from .posts import named_terms

UNMATCHED = "Manual review"
GENERAL = "General or unclear"
#: Rules of up to so many bytes are sent to every task.
BROADCAST_BYTES = 64 << 20

POST_COLUMNS = ("id", "extractor", "title", "webpage_url", "like_count", "view_count")


#: Of each layer the name of its code, what its patterns are compared with, and the code without a rule.
LAYERS = {
    "canonical": ("canonical", lambda term: F.lower(F.trim(term)), lambda term: title_case(F.trim(term))),
    "status": ("status_category", term_key, lambda term: F.lit(UNMATCHED)),
    "target": ("target_group", term_key, lambda term: F.lit(GENERAL)),
}


def _grams(col: Column) -> Column:
    """All runs of three letters of a text, each once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(col) - 2, F.lit(1))), lambda i: F.substr(col, i, F.lit(3))))


def containing(keyed: DataFrame, patterns: DataFrame, col: str) -> DataFrame:
    """(col, layer, found) of every row of ``keyed(col, layer, key)`` and of ``patterns(layer, pattern, found)`` that lies in its key.

    A pattern goes under the run of three of its letters that the fewest keys have, a
    key under all of its own; they meet by equality, and the test follows. For patterns of more than
    three letters.
    """
    runs = keyed.select(F.col(col).alias("__term"), "layer", "key", F.explode(_grams(F.col("key"))).alias("gram"))
    often = runs.groupBy("layer", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = patterns.withColumn("gram", F.explode(_grams(F.col("pattern")))).join(often, ["layer", "gram"]).groupBy("layer", "pattern", "found").agg(F.min(F.struct("n", "gram")).alias("rarest"))
    under = rarest.select("layer", F.col("rarest.gram").alias("gram"), "pattern", "found")
    return runs.join(under, ["layer", "gram"]).filter(F.contains("key", "pattern")).select(F.col("__term").alias(col), "layer", "found")


def matching(keyed: DataFrame, patterns: DataFrame, col: str, blocks: int, parts: int) -> DataFrame:
    """As ``containing``, for patterns to be matched, which have no fixed letters to meet by.

    A grid: patterns are dealt into ``blocks`` and keys into ``parts`` by hash, and each
    cell of the two is a key of the join, so no task has all keys or all patterns.
    """
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    dealt = keyed.select(F.col(col).alias("__term"), "layer", "key", F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), F.explode(upto(blocks)).alias("block"))
    rules = patterns.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(blocks))).withColumn("part", F.explode(upto(parts)))
    return dealt.join(rules, ["layer", "block", "part"]).filter(F.regexp_like("key", F.col("pattern"))).select(F.col("__term").alias(col), "layer", "found")


def code_terms(terms: DataFrame, rules: DataFrame, layers: tuple[str, ...] = tuple(LAYERS), col: str = "term") -> DataFrame:
    """(col, a code of each layer) for the distinct terms, all layers in one pass over them.

    Exact rules meet their terms by an equality join; the searching ones are tried
    on the distinct terms of their layer. Rules that measure little enough are
    broadcast; beyond that, patterns to be contained meet terms by runs of letters
    (``containing``) and those to be matched in a grid (``matching``). Null
    terms are terms without a rule.
    """
    used = rules.filter(F.col("layer").isin(*layers))
    bytes_ = F.octet_length("pattern") + F.octet_length("label") + 40
    size, matched = used.agg(F.coalesce(F.sum(bytes_), F.lit(0)), F.coalesce(F.sum(F.when(F.col("kind") == "regex", bytes_)), F.lit(0))).first()
    code = F.struct("priority", "label")
    exact = used.filter("kind <> 'regex'").groupBy("layer", F.col("pattern").alias("key")).agg(F.min(code).alias("listed"))
    search = used.filter("kind <> 'exact'").select(F.col("layer").alias("of"), "kind", "pattern", code.alias("found"))
    keys = F.array(*(F.struct(F.lit(x).alias("layer"), LAYERS[x][1](F.col(col)).alias("key")) for x in layers))
    keyed = terms.select(col).distinct().select(col, F.explode(keys).alias("x")).select(col, "x.*")
    if size <= BROADCAST_BYTES:
        inside = ((F.col("kind") == "contains") & (F.length("pattern") > 3) & F.contains("key", "pattern")) | ((F.col("kind") == "regex") & F.regexp_like("key", F.col("pattern")))
        met = keyed.join(F.broadcast(exact), ["layer", "key"], "left").join(F.broadcast(search), (F.col("layer") == F.col("of")) & inside, "left")
    else:
        patterns = search.withColumnRenamed("of", "layer")
        regex = patterns.filter("kind = 'regex'").drop("kind")
        blocks, parts = int(matched // max(1, BROADCAST_BYTES)) + 1, int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hits = containing(keyed, patterns.filter((F.col("kind") == "contains") & (F.length("pattern") > 3)).drop("kind"), col).unionByName(matching(keyed, regex, col, blocks, parts))
        listed = keyed.join(exact, ["layer", "key"], "left").select(col, "layer", "listed")
        met = listed.unionByName(hits, allowMissingColumns=True)
    mine = lambda x, c: F.min(F.when(F.col("layer") == x, F.col(c))).alias(f"{x}_{c}")
    best = met.groupBy(col).agg(*(mine(x, c) for x in layers for c in ("listed", "found")))
    codes = []
    for x in layers:
        name, _, default = LAYERS[x]
        listed, found = F.col(f"{x}_listed"), F.col(f"{x}_found")
        first = F.lit(True) if x == "status" else listed.priority <= F.coalesce(found.priority, listed.priority)
        codes.append(F.coalesce(F.when(listed.isNotNull() & first, listed.label), found.label, listed.label, default(F.col(col))).alias(name))
    return best.select(col, *codes)


def canonicalize(terms: DataFrame, rules: DataFrame, col: str = "term") -> DataFrame:
    """(col, canonical) for distinct terms; without a rule, the term in title case."""
    return code_terms(terms, rules, ("canonical",), col)


def status_category(terms: DataFrame, rules: DataFrame, col: str = "term") -> DataFrame:
    """(col, status_category); listed terms first, then patterns, else for review."""
    return code_terms(terms, rules, ("status",), col)


def target_group(terms: DataFrame, rules: DataFrame, col: str = "term") -> DataFrame:
    """(col, target_group): the first group with an item equal to the term or in it."""
    return code_terms(terms, rules, ("target",), col)


def name_terms(posts: DataFrame, col: str = "supplements") -> DataFrame:
    """A row for each term of each post, with its position."""
    return posts.select(*(c for c in POST_COLUMNS if c in posts.columns), F.posexplode(named_terms(col)).alias("pos", "raw_term"))


def code_mentions(mentions: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of ``name_terms`` with all three codes. They are read twice: for the distinct terms, and to be coded."""
    return mentions.join(code_terms(mentions, rules, col="raw_term"), "raw_term")


def code_posts(posts: DataFrame, rules: DataFrame, col: str = "supplements") -> DataFrame:
    """C4: a row for each term of each post, with its position and all three codes."""
    return code_mentions(name_terms(posts, col), rules)


def coding_coverage(coded: DataFrame) -> DataFrame:
    """One row with the numbers of mentions, terms, canonical names and terms to review."""
    review = F.when(F.col("status_category") == UNMATCHED, F.col("raw_term"))
    return coded.agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("raw_term").alias("raw_terms"), F.count_distinct("canonical").alias("canonical_names"), F.count_distinct(review).alias("unmatched_terms"))


def group_summary(coded: DataFrame, group: str) -> DataFrame:
    """Posts, likes and views of each group, a post counted once in a group."""
    once = coded.groupBy("id", group).agg(F.min_by("like_count", "pos").alias("likes"), F.min_by("view_count", "pos").alias("views"))
    sums = once.groupBy(group).agg(F.count("id").alias("post_count"), F.coalesce(F.sum("likes"), F.lit(0)).alias("total_likes"), F.coalesce(F.sum("views"), F.lit(0)).alias("total_views"))
    return sums.orderBy(F.desc("post_count"), group)


def posts_by(coded: DataFrame, group: str) -> DataFrame:
    """Mentions in order of group and canonical name."""
    return coded.orderBy(group, "canonical", "id", "pos")


def term_mapping(coded: DataFrame) -> DataFrame:
    """How often each term got its codes, most frequent first."""
    return coded.groupBy("raw_term", "canonical", "status_category", "target_group").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "raw_term")


#: The tables of a coding, with the columns that tell their rows.
TABLES = {
    "category_counts": ("status_category", "post_count", "total_likes", "total_views"), "target_counts": ("target_group", "post_count", "total_likes", "total_views"),
    "posts_by_category": ("status_category", "canonical", "id", "pos"), "posts_by_target": ("target_group", "canonical", "id", "pos"),
    "term_mapping": ("raw_term", "canonical", "status_category", "target_group", "count"),
}


def coding_tables(coded: DataFrame) -> dict[str, DataFrame]:
    """The five tables that a coding leaves, by name: C6 and C7 of both groups, and C8."""
    return {
        "category_counts": group_summary(coded, "status_category"), "target_counts": group_summary(coded, "target_group"),
        "posts_by_category": posts_by(coded, "status_category"), "posts_by_target": posts_by(coded, "target_group"), "term_mapping": term_mapping(coded),
    }


def primary_category(coded: DataFrame) -> DataFrame:
    """(id, primary_category): the category most of a post's terms have.

    Of equally frequent ones a matched category goes before review, then the first
    seen.
    """
    counts = coded.groupBy("id", "status_category").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    order = F.struct((-F.col("n")).alias("n"), (F.col("status_category") == UNMATCHED).alias("review"), "first")
    return counts.groupBy("id").agg(F.min_by("status_category", order).alias("primary_category"))


def primary_counts(primary: DataFrame) -> DataFrame:
    """Posts of each primary category, most first."""
    return primary.groupBy("primary_category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "primary_category")


def shadowed_rules(rules: DataFrame) -> DataFrame:
    """``contains`` rules of the target layer that can never win: an earlier item lies inside them."""
    layer = rules.filter("layer = 'target' AND kind = 'contains'").select("priority", "pattern", "label")
    keyed = layer.select("pattern", F.lit("target").alias("layer"), F.col("pattern").alias("key")).distinct()
    items = layer.filter(F.length("pattern") > 3).select(F.lit("target").alias("layer"), "pattern", F.struct(F.col("priority").alias("before"), F.col("pattern").alias("by"), F.col("label").alias("wins")).alias("found"))
    met = layer.join(containing(keyed, items, "pattern").select("pattern", "found.*"), "pattern")
    earlier = met.filter((F.col("before") < F.col("priority")) & (F.col("wins") != F.col("label")))
    return earlier.groupBy("priority", "pattern", "label").agg(F.min_by("by", "before").alias("shadowed_by"))
