"""The queries' results in SQL, for comparison in another engine."""

from __future__ import annotations

from ..functions.text import CODING_SENTINELS, MOOD_LABEL, MOOD_WORDS, REPORT_ALIASES, REPORT_SENTINELS, SYMPTOM_EXCLUSIONS, TOP_SENTINELS
from .views import PLATFORMS, RULE_ROWS, SOURCES


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(map(_q, values)) + ")"


def title(s: str) -> str:
    """Title case of ASCII text."""
    return f"array_to_string(list_transform(range(1, CAST(length({s}) AS BIGINT) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(substr({s}, i - 1, 1), '[A-Za-z]') THEN lower(substr({s}, i, 1)) ELSE upper(substr({s}, i, 1)) END), '')"


def split(c: str) -> str:
    return f"list_transform(string_split(trim({c}, '[]'), ','), lambda x: trim(trim(x), '''\"'))"


def parse(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR lower(trim({c})) IN {_in(REPORT_SENTINELS)} THEN [] ELSE list_filter(list_transform(regexp_extract_all(trim({c}), '[''\"]([^\\n]*?)[''\"]', 1), lambda x: trim(x)), lambda x: x <> '') END"


def canonical(t: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({t}, {_q(p)}) THEN {_q(label)}" for layer, _, _, p, label in RULE_ROWS if layer == "canonical")
    return f"CASE {whens} ELSE {title(t)} END"


def status(t: str) -> str:
    test = {"exact": "{t} = {p}", "regex": "regexp_matches({t}, {p})"}
    whens = " ".join(f"WHEN {test[k].format(t=t, p=_q(p))} THEN {_q(label)}" for layer, _, k, p, label in RULE_ROWS if layer == "status")
    return f"CASE {whens} ELSE 'Manual review' END"


def target(t: str) -> str:
    whens = " ".join(f"WHEN {t} = {_q(p)} OR ({len(p)} > 3 AND contains({t}, {_q(p)})) THEN {_q(label)}" for layer, _, _, p, label in RULE_ROWS if layer == "target")
    return f"CASE {whens} ELSE 'General or unclear' END"


POSTS = """posts AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS id, c_name AS title, o_totalprice / 100000 AS duration, lower(o_orderpriority) AS extractor,
        CASE o_orderstatus WHEN 'F' THEN 'negative' WHEN 'O' THEN 'neutral' ELSE 'positive' END AS sentiment, o_custkey % 4 <> 0 AS topic,
        CAST(o_orderdate AS DATE) AS date, strftime(o_orderdate, '%Y-%m') AS year_month, CAST(floor(o_totalprice) AS BIGINT) AS view_count,
        CAST(floor(o_totalprice) AS BIGINT) % 1000 AS like_count, o_custkey % 50 AS comment_count, supplements, symptoms,
        1 + o_orderkey % 10 AS misleading, o_orderkey % 3 = 0 AS marketing
    FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (
        SELECT l_orderkey, '[''' || string_agg(p_name, ''', ''' ORDER BY l_linenumber, l_partkey) || ''']' AS supplements, '[''' || string_agg(p_type, ''', ''' ORDER BY l_linenumber, l_partkey) || ''']' AS symptoms
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""
COPIES = "CASE WHEN length(trim(lower(title))) >= 15 THEN row_number() OVER (PARTITION BY trim(lower(title)), round_even(duration, 0) ORDER BY view_count DESC NULLS LAST, id) ELSE 1 END AS copy"
INSIDE = f"inside AS (SELECT * FROM posts WHERE extractor IN {_in(PLATFORMS)})"
SCOPE = f"{POSTS}, {INSIDE}, marked AS (SELECT *, CASE WHEN length(title) >= 15 THEN row_number() OVER (PARTITION BY trim(lower(title)), round_even(duration, 0) ORDER BY view_count DESC NULLS LAST, id) ELSE 1 END AS copy FROM inside WHERE topic), scope AS (SELECT * FROM marked WHERE copy = 1)"
LENIENT = f"{POSTS}, lenient AS (SELECT * FROM posts WHERE topic)"
NAMED = f"list_filter({split('supplements')}, lambda x: lower(x) NOT IN {_in(CODING_SENTINELS)})"
TOP = f"list_filter(list_transform({split('supplements')}, lambda x: lower(x)), lambda x: x NOT IN {_in(TOP_SENTINELS)})"
MENTIONS = f"mentions AS (SELECT year_month, {canonical('term')} AS canonical FROM (SELECT year_month, unnest({TOP}) AS term FROM scope))"
CODED = f"""{POSTS}, raw AS (SELECT id, view_count, like_count, unnest({NAMED}) AS raw_term, unnest(range(0, len({NAMED}))) AS pos FROM posts WHERE topic AND supplements IS NOT NULL),
coded AS (SELECT id, view_count, like_count, CAST(pos AS INTEGER) AS pos, raw_term, {canonical('lower(raw_term)')} AS canonical, {status('lower(raw_term)')} AS status_category, {target('lower(raw_term)')} AS target_group FROM raw)"""
TERMS = f"{POSTS}, terms AS (SELECT DISTINCT unnest({NAMED}) AS term FROM posts WHERE supplements IS NOT NULL)"
PRIMARY = """ranked AS (SELECT id, status_category, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, status_category = 'Manual review', min(pos)) AS r FROM coded GROUP BY id, status_category),
prim AS (SELECT id, status_category AS primary_category FROM ranked WHERE r = 1)"""
ALIASED = "CASE lower(x) " + " ".join(f"WHEN {_q(k)} THEN {_q(n)}" for k, n in REPORT_ALIASES.items()) + f" ELSE {title('x')} END"
REPORT = f"said AS (SELECT id, date, sentiment, marketing, misleading, {ALIASED} AS term FROM (SELECT *, unnest({parse('supplements')}) AS x FROM lenient))"
_SYMPTOM = f"CASE WHEN lower(x) IN {_in(MOOD_WORDS)} THEN {_q(MOOD_LABEL)} ELSE lower(x) END"
_SHOWN = f"list_transform(list_transform(list_filter({{}}, lambda x: lower(x) NOT IN {_in(SYMPTOM_EXCLUSIONS)}), lambda x: {_SYMPTOM}), lambda y: CASE WHEN y = {_q(MOOD_LABEL)} THEN 'Mood Changes' ELSE upper(y[1]) || substr(y, 2) END)"
LINKS = "links AS (SELECT page_id, url AS link, CAST(page_id % 60 AS VARCHAR) || ':0' || CAST(page_id % 10 AS VARCHAR) AS duration, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/?#]*)', 1) AS source, 'someone' AS author FROM pages), old AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN link || '&old' ELSE link END AS link, duration, title, source, author FROM links), now AS (SELECT * FROM links)"
MERGED = "merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY age, page_id) AS r FROM (SELECT *, 0 AS age FROM now UNION ALL SELECT *, 1 AS age FROM old)) WHERE r = 1)"
META = "meta AS (SELECT CAST(doc_id AS VARCHAR) AS file_key, source AS extractor, string_split(text, chr(10))[1] AS title, text AS description, n_chars AS view_count, n_chars % 7 AS like_count, CASE WHEN lang = 'de' THEN 'mp3' WHEN lang <> 'en' THEN lang END AS ext FROM documents)"
SECONDS = "secs AS (SELECT event_id, CAST(minute(ts) AS VARCHAR) || ':' || lpad(CAST(second(ts) AS VARCHAR), 2, '0') AS clock, minute(ts) * 60 + second(ts) AS seconds FROM events)"
DOCS = f"docs AS (SELECT *, {COPIES} FROM (SELECT CAST(doc_id AS VARCHAR) AS id, string_split(text, chr(10))[1] AS title, CAST(n_chars AS DOUBLE) AS duration, doc_id AS view_count, lang AS extractor FROM documents))"
RAW_DATES = "raw AS (SELECT o_orderkey, o_orderkey % 5 AS k, CAST(o_orderdate AS DATE) AS day FROM orders)"
PROCESSED = f"""{SCOPE}, plinks AS (SELECT lower(o_orderpriority) AS platform, count(*) AS n_links FROM orders GROUP BY 1),
proc AS (SELECT platform, n_links, coalesce(n, 0) AS n_processed FROM plinks LEFT JOIN (SELECT extractor, count(*) AS n FROM inside GROUP BY 1) ON extractor = platform)"""
COUNTS = f"""{PROCESSED}, with_terms AS (SELECT * FROM scope WHERE supplements IS NOT NULL AND len({NAMED}) > 0),
c AS (SELECT (SELECT count(*) FROM orders) AS links, (SELECT count(*) FROM inside) AS processed, (SELECT count(*) FROM marked) AS topic, (SELECT count(*) FROM scope) AS uniq, (SELECT count(*) FROM with_terms) AS terms),
counts AS (
    SELECT 'links' AS stage, links AS n FROM c UNION ALL SELECT 'processed', processed FROM c UNION ALL SELECT 'topic', topic FROM c UNION ALL SELECT 'unique', uniq FROM c UNION ALL SELECT 'has_terms', terms FROM c
    UNION ALL SELECT 'not_processed', links - processed FROM c UNION ALL SELECT 'not_topic', processed - topic FROM c UNION ALL SELECT 'not_unique', topic - uniq FROM c UNION ALL SELECT 'not_has_terms', uniq - terms FROM c)"""
EDGES = f"""{COUNTS}, craw AS (SELECT id, unnest({NAMED}) AS raw_term, unnest(range(0, len({NAMED}))) AS pos FROM with_terms),
coded AS (SELECT id, pos, {status('lower(raw_term)')} AS status_category FROM craw), {PRIMARY},
edges AS (
    SELECT platform AS src, 'processed' AS dst, n_processed AS n, 'kept' AS kind FROM proc UNION ALL SELECT platform, 'not_processed', n_links - n_processed, 'removed' FROM proc
    UNION ALL SELECT CASE WHEN stage LIKE '%topic' THEN 'processed' WHEN stage LIKE '%unique' THEN 'topic' ELSE 'unique' END, stage, n, CASE WHEN stage LIKE 'not%' THEN 'removed' ELSE 'kept' END FROM counts WHERE stage NOT IN ('links', 'processed', 'not_processed')
    UNION ALL SELECT 'has_terms', primary_category, count(*), 'kept' FROM prim GROUP BY primary_category)"""
_MONTHLY = "SELECT year_month, count(*) FILTER (WHERE sentiment = 'negative') AS negative, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral, count(*) FILTER (WHERE sentiment = 'positive') AS positive FROM scope GROUP BY year_month"
_SUMMARY = "SELECT extractor, count(id) AS n_posts, coalesce(sum(like_count), 0)::BIGINT AS like_count, coalesce(sum(view_count), 0)::BIGINT AS view_count, coalesce(sum(comment_count), 0)::BIGINT AS comment_count FROM scope GROUP BY extractor"
_SENT = ", ".join(f"count(*) FILTER (WHERE sentiment = '{s}') AS {s}" for s in ("negative", "neutral", "positive"))


def _top(source: str, col: str, k: int, name: str = "mentions") -> str:
    return f"SELECT {col}, count(*) AS {name} FROM {source} GROUP BY {col} ORDER BY count(*) DESC, {col} LIMIT {k}"


def _long(section: str, source: str, key: str, metrics: list[str], order: str) -> str:
    """Rows of a section, ranked by ``order``."""
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank, CAST({key} AS VARCHAR) AS key, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM ({source})" for m in metrics
    )


def _dense(section: str, months: str, top: str, source: str, at: str, term: str) -> str:
    """Mentions of the terms of ``top`` in each month of ``months``."""
    return f"SELECT '{section}', CAST(dense_rank() OVER (ORDER BY m.m) AS INTEGER), CAST(m.m AS VARCHAR), t.{term}, CAST((SELECT count(*) FROM {source} x WHERE x.{at} = m.m AND x.{term} = t.{term}) AS DOUBLE) FROM ({months}) m CROSS JOIN ({top}) t"


_STRESSED = "replace(symptoms, 'ECONOMY', 'Stress')"
_SYMPTOMS = f"syms AS (SELECT unnest({_SHOWN.format(split('symptoms'))}) AS symptom FROM scope WHERE symptoms IS NOT NULL AND lower(symptoms) <> 'none')"

_ASKED = "asked AS (SELECT file_key, view_count, length('From ' || coalesce(extractor, '') || ' by nobody: ' || coalesce(title, '') || chr(10) || coalesce(description, 'nothing')) AS n FROM meta)"
_ANSWER = "CASE WHEN n % 9 <> 0 THEN '{\"length\": ' || n || '}' END AS response"
_ATTEMPTS = "CAST(CASE WHEN n % 9 <> 0 THEN 1 ELSE 3 END AS INTEGER) AS attempts"
_FAILED = "CASE WHEN n % 9 = 0 THEN 'JSONDecodeError: Expecting value: line 1 column 1 (char 0)' END AS error"
_RESPONSES = """responses AS (
    SELECT 'a post+ [' || doc_id || ']' AS file_key, CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 THEN 'quality ' || quality END AS description,
        CASE WHEN doc_id % 7 = 0 THEN '{broken' WHEN doc_id % 11 = 0 THEN '[1, 2]' END AS value, CASE WHEN doc_id % 7 = 0 THEN 'no JSON' WHEN doc_id % 11 = 0 THEN 'no object' END AS reason, doc_id FROM labels)"""
_WHOLE = """rtrim(props, '} ') || ', "tags": ' || CASE event_id % 3 WHEN 0 THEN '["' || event_type || '", "x y"]' WHEN 1 THEN '"[''' || event_type || ''', ''x y'']"' ELSE 'null' END
    || ', "note": "' || event_type || '", "flag": ' || CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN '"False"' WHEN 2 THEN '"maybe"' ELSE 'null' END || '}'"""

SQL: dict[str, str] = {
    "annotate": f"WITH {META}, {_ASKED} SELECT file_key, {_ANSWER}, {_ATTEMPTS}, {_FAILED} FROM asked",
    "annotate_new": f"WITH {META}, {_ASKED} SELECT file_key, CASE WHEN view_count % 3 = 0 THEN '{{\"before\": true}}' ELSE response END AS response, CAST(CASE WHEN view_count % 3 = 0 THEN 1 ELSE attempts END AS INTEGER) AS attempts, CASE WHEN view_count % 3 <> 0 THEN error END AS error FROM (SELECT *, {_ANSWER}, {_ATTEMPTS}, {_FAILED} FROM asked)",
    "read_results": f"WITH {_RESPONSES} SELECT file_key, description, value, reason FROM responses",
    "stream_results": f"WITH {_RESPONSES} SELECT file_key, description, value, reason, CAST(doc_id % 2 AS INTEGER) AS run FROM responses",
    "read_metadata": f"WITH {META} SELECT file_key, file_key AS id, extractor, title, view_count, like_count, CAST(NULL AS BIGINT) AS comment_count, CAST(view_count AS DOUBLE) AS duration, ext FROM meta WHERE file_key IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)",
    "run_profiles": f"WITH {POSTS}, copies AS (SELECT *, {COPIES} FROM posts WHERE marketing), p AS (SELECT 'supplements' AS profile, id FROM copies WHERE copy = 1 UNION ALL SELECT 'parenting', id FROM posts WHERE topic) SELECT profile, id, count(*) OVER (PARTITION BY profile) AS n_posts FROM p",
    "posts_from_csv": f"WITH {SCOPE} {_SUMMARY}",
    "posts_from_broken_csv": f"WITH {POSTS}, o AS (SELECT *, CAST(id AS BIGINT) AS k FROM posts) SELECT id, CASE WHEN k % 7 <> 0 THEN like_count END AS like_count, view_count, CASE WHEN k % 5 <> 0 THEN topic END AS topic, CASE WHEN k % 7 = 0 THEN 'many' END AS like_count_was, CASE WHEN k % 5 = 0 THEN 'maybe' END AS topic_was, CAST((k % 7 = 0)::INTEGER + (k % 5 = 0)::INTEGER AS INTEGER) AS n_broken FROM o",
    "union_ragged": "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey AS customer, NULL AS lang FROM orders UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, lang FROM documents",
    "links_written_and_read": f"WITH {LINKS} SELECT link, duration, nullif(trim(title), '') AS title, source, author FROM links",
    "link_list_written_and_read": f"WITH {LINKS} SELECT DISTINCT link AS term FROM links",
    "posts_written_and_read": f"WITH {POSTS} SELECT id, title, extractor, sentiment, view_count, supplements FROM posts",
    "coding_written_and_read": f"WITH {CODED} " + " UNION ALL ".join([
        *(f"SELECT '{name}' AS name, concat_ws('|', {c}, count(*), sum(like_count)::BIGINT, sum(view_count)::BIGINT) AS row FROM (SELECT DISTINCT id, {c}, like_count, view_count FROM coded) GROUP BY {c}" for name, c in (("category_counts", "status_category"), ("target_counts", "target_group"))),
        *(f"SELECT '{name}', concat_ws('|', {c}, canonical, id, pos) FROM coded" for name, c in (("posts_by_category", "status_category"), ("posts_by_target", "target_group"))),
        "SELECT 'term_mapping', concat_ws('|', raw_term, canonical, status_category, target_group, count(*)) FROM coded GROUP BY raw_term, canonical, status_category, target_group"]),
    "top_terms": f"WITH {SCOPE}, {MENTIONS} {_top('mentions', 'canonical', 10)}",
    "platform_summary": f"WITH {SCOPE} {_SUMMARY}",
    "platform_summary_coerced": f"WITH {LENIENT} SELECT extractor, count(*) AS n_posts, CAST(sum(CASE WHEN like_count % 7 = 0 THEN 0 ELSE like_count END) AS DOUBLE) AS like_count, CAST(sum(view_count) AS DOUBLE) AS view_count, CAST(0 AS DOUBLE) AS comment_count FROM lenient GROUP BY extractor",
    "sentiment_by_month": f"WITH {SCOPE} {_MONTHLY}",
    "sentiment_share": f"WITH {SCOPE}, m AS ({_MONTHLY}) SELECT year_month, round(negative / (negative + neutral + positive), 6) AS negative, round(neutral / (negative + neutral + positive), 6) AS neutral, round(positive / (negative + neutral + positive), 6) AS positive FROM m",
    "popularity_by_month": f"WITH {SCOPE} SELECT year_month, count(id) AS n_posts, sum(like_count)::BIGINT AS like_count, sum(view_count)::BIGINT AS view_count FROM scope GROUP BY year_month",
    "posts_per_month": f"WITH {SCOPE} SELECT year_month, count(*) AS n_posts FROM scope GROUP BY year_month",
    "sentiment_distribution": f"WITH {SCOPE} SELECT sentiment, count(*) AS n FROM scope GROUP BY sentiment",
    "top_terms_by_month": f"WITH {SCOPE}, {MENTIONS}, top AS ({_top('mentions', 'canonical', 3)}), months AS (SELECT DISTINCT year_month FROM scope) SELECT m.year_month, t.canonical, (SELECT count(*) FROM mentions x WHERE x.year_month = m.year_month AND x.canonical = t.canonical) AS mentions FROM months m CROSS JOIN top t",
    "report_trend": f"WITH {LENIENT}, {REPORT}, top AS ({_top('said', 'term', 3)}), n AS (SELECT last_day(date) AS month_end, term, count(*) AS n FROM said WHERE term IN (SELECT term FROM top) GROUP BY 1, 2), months AS (SELECT DISTINCT month_end FROM n) SELECT CAST(months.month_end AS VARCHAR) AS month_end, top.term, coalesce(n.n, 0) AS mentions FROM months CROSS JOIN top LEFT JOIN n ON n.month_end = months.month_end AND n.term = top.term",
    "content_profile_substring": f"""WITH {SCOPE}, names AS (SELECT unnest(['ring', 'bolt', 'hot']) AS name), hits AS (SELECT name, sentiment, symptoms FROM scope JOIN names ON contains(supplements, name)),
        f AS (SELECT name, symptoms, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, symptoms) AS r FROM hits WHERE symptoms IS NOT NULL GROUP BY name, symptoms)
        SELECT h.*, common_symptoms FROM (SELECT name, count(*) AS n_posts, {_SENT} FROM hits GROUP BY name) h LEFT JOIN (SELECT name, string_agg(symptoms, ' / ' ORDER BY r) AS common_symptoms FROM f WHERE r <= 3 GROUP BY name) USING (name)""",
    "content_profile_member": f"WITH {LENIENT}, {REPORT}, one AS (SELECT DISTINCT id, sentiment, marketing, misleading, term AS name FROM said WHERE term IN ('Hot Bolt', 'Red Ring', 'Nothing')) SELECT name, count(*) AS n_posts, {_SENT}, CAST(floor(100 * avg(CAST(marketing AS INTEGER))) AS INTEGER) AS marketing_percent, CAST(median(misleading) AS DOUBLE) AS median_misleading FROM one GROUP BY name",
    "top_symptoms": f"WITH {SCOPE}, {_SYMPTOMS} {_top('syms', 'symptom', 10)}",
    "report_top_terms": f"WITH {LENIENT}, {REPORT} {_top('said', 'term', 10)}",
    "report_top_symptoms": f"WITH {LENIENT}, syms AS (SELECT {title('x')} AS symptom FROM (SELECT unnest({parse('symptoms')}) AS x FROM lenient)) {_top('syms', 'symptom', 10)}",
    "inclusion_counts": f"WITH {POSTS} SELECT count(*) AS loaded, count(*) AS after_platform_filter, count(*) FILTER (WHERE topic) AS included FROM posts",
    "findings": f"""WITH {SCOPE}, lenient AS (SELECT * FROM posts WHERE topic), {MENTIONS}, {_SYMPTOMS}, {REPORT}, rsyms AS (SELECT {title('x')} AS symptom FROM (SELECT unnest({parse('symptoms')}) AS x FROM lenient)),
        trend AS (SELECT last_day(date) AS m, term FROM said), rtop AS ({_top('said', 'term', 3)}), ctop AS ({_top('mentions', 'canonical', 3)}),
        members AS (SELECT DISTINCT id, sentiment, marketing, misleading, term FROM said WHERE term IN (SELECT term FROM rtop)),
        placed AS (SELECT canonical, row_number() OVER (ORDER BY mentions DESC, canonical) AS r FROM ctop), hits AS (SELECT canonical, r, sentiment, symptoms FROM scope JOIN placed ON contains(supplements, canonical)),
        fields AS (SELECT canonical, symptoms, count(*) AS n, row_number() OVER (PARTITION BY canonical ORDER BY count(*) DESC, symptoms) AS r FROM hits WHERE symptoms IS NOT NULL GROUP BY canonical, symptoms) """ + " UNION ALL ".join([
        _long("inclusion", "SELECT 'all' AS k, count(*) AS loaded, count(*) AS after_platform_filter, count(*) FILTER (WHERE topic) AS included FROM posts", "k", ["loaded", "after_platform_filter", "included"], "k"),
        _long("platforms", _SUMMARY, "extractor", ["n_posts", "like_count", "view_count", "comment_count"], "n_posts DESC, extractor"),
        _long("sentiment_by_month", _MONTHLY, "year_month", ["negative", "neutral", "positive"], "year_month"),
        _long("sentiment_share", f"SELECT year_month, round(negative / (negative + neutral + positive), 9) AS negative, round(neutral / (negative + neutral + positive), 9) AS neutral, round(positive / (negative + neutral + positive), 9) AS positive FROM ({_MONTHLY})", "year_month", ["negative", "neutral", "positive"], "year_month"),
        _long("popularity_by_month", "SELECT year_month, count(id) AS n_posts, sum(like_count) AS like_count, sum(view_count) AS view_count FROM scope GROUP BY year_month", "year_month", ["n_posts", "like_count", "view_count"], "year_month"),
        _long("posts_per_month", "SELECT year_month, count(*) AS n_posts FROM scope GROUP BY year_month", "year_month", ["n_posts"], "year_month"),
        _long("sentiment", "SELECT sentiment, count(*) AS n FROM scope GROUP BY sentiment", "sentiment", ["n"], "n DESC, sentiment"),
        _long("top_terms", _top("mentions", "canonical", 10), "canonical", ["mentions"], "mentions DESC, canonical"),
        _long("top_symptoms", _top("syms", "symptom", 10), "symptom", ["mentions"], "mentions DESC, symptom"),
        _long("report_top_terms", _top("said", "term", 10), "term", ["mentions"], "mentions DESC, term"),
        _long("report_top_symptoms", _top("rsyms", "symptom", 10), "symptom", ["mentions"], "mentions DESC, symptom"),
        _dense("top_terms_by_month", "SELECT DISTINCT year_month AS m FROM scope", "SELECT canonical FROM ctop", "mentions", "year_month", "canonical"),
        _long("report_platforms", "SELECT extractor, count(*) AS n_posts, sum(like_count) AS like_count, sum(view_count) AS view_count, sum(comment_count) AS comment_count FROM lenient GROUP BY extractor", "extractor", ["n_posts", "like_count", "view_count", "comment_count"], "n_posts DESC, extractor"),
        _dense("report_trend", "SELECT DISTINCT m FROM trend WHERE term IN (SELECT term FROM rtop)", "SELECT term FROM rtop", "trend", "m", "term"),
        _long("report_profile", f"SELECT term, count(*) AS n_posts, {_SENT}, floor(100 * avg(CAST(marketing AS INTEGER))) AS marketing_percent, median(misleading) AS median_misleading, (SELECT mentions FROM rtop WHERE rtop.term = members.term) AS m FROM members GROUP BY term", "term", ["n_posts", "negative", "neutral", "positive", "marketing_percent", "median_misleading"], "m DESC, term"),
        *(f"SELECT 'content_profile', CAST(r AS INTEGER), canonical, '{m}', CAST({x} AS DOUBLE) FROM hits GROUP BY canonical, r" for m, x in (("n_posts", "count(*)"), *((s, f"count(*) FILTER (WHERE sentiment = '{s}')") for s in ("negative", "neutral", "positive")))),
        "SELECT 'content_symptoms', CAST(r AS INTEGER), canonical, symptoms, CAST(n AS DOUBLE) FROM fields WHERE r <= 3"]),
    "canonical_terms": f"WITH {TERMS} SELECT term, {canonical('lower(term)')} AS canonical FROM terms",
    "status_category": f"WITH {TERMS} SELECT term, {status('lower(term)')} AS status_category FROM terms",
    "target_group": f"WITH {TERMS} SELECT term, {target('lower(term)')} AS target_group FROM terms",
    "coded_posts": f"WITH {CODED} SELECT id, pos, raw_term, canonical, status_category, target_group, view_count FROM coded",
    "coding_coverage": f"WITH {CODED} SELECT count(*) AS mentions, count(DISTINCT raw_term) AS raw_terms, count(DISTINCT canonical) AS canonical_names, count(DISTINCT CASE WHEN status_category = 'Manual review' THEN raw_term END) AS unmatched_terms FROM coded",
    **{f"group_summary_{n}": f"WITH {CODED}, once AS (SELECT DISTINCT id, {c}, like_count, view_count FROM coded) SELECT {c}, count(DISTINCT id) AS post_count, sum(like_count)::BIGINT AS total_likes, sum(view_count)::BIGINT AS total_views FROM once GROUP BY {c}" for n, c in (("status", "status_category"), ("target", "target_group"))},
    **{f"posts_by_{n}": f"WITH {CODED} SELECT {c}, canonical, id, pos FROM coded" for n, c in (("status", "status_category"), ("target", "target_group"))},
    "term_mapping": f"WITH {CODED} SELECT raw_term, canonical, status_category, target_group, count(*) AS count FROM coded GROUP BY ALL",
    "primary_category": f"WITH {CODED}, {PRIMARY} SELECT id, primary_category FROM prim",
    "primary_counts": f"WITH {CODED}, {PRIMARY} SELECT primary_category, count(*) AS n FROM prim GROUP BY 1",
    "dedup_posts": f"WITH {DOCS} SELECT id, title, duration, view_count, extractor FROM docs WHERE copy = 1",
    "dedup_stats": f"WITH {DOCS} SELECT count(*) AS n_posts, count(*) FILTER (WHERE copy = 1) AS n_kept, count(*) FILTER (WHERE copy > 1) AS n_removed FROM docs",
    "screen_flag_strict": f"WITH {POSTS} SELECT id, extractor FROM posts WHERE topic",
    "screen_flag_text": f"WITH {POSTS} SELECT id, extractor FROM posts WHERE topic",
    "screen_platform": f"WITH {POSTS}, {INSIDE} SELECT id, extractor FROM inside",
    "screen_has_terms": f"WITH {POSTS} SELECT id FROM posts WHERE supplements IS NOT NULL AND len({NAMED}) > 0",
    "screen_without_terms": f"WITH {POSTS} SELECT id FROM posts WHERE supplements IS NULL OR len({NAMED}) = 0",
    "strip_url_param": r"WITH a AS (SELECT page_id, CASE WHEN contains(url, 'ref=') THEN rtrim(regexp_replace(url, '([?&])ref=[^&]*&?', '\1', 'g'), '?&') ELSE url END AS u FROM pages) SELECT page_id, CASE WHEN contains(u, 'utm_source=') THEN rtrim(regexp_replace(u, '([?&])utm_source=[^&]*&?', '\1', 'g'), '?&') ELSE u END AS link FROM a",
    "parse_cards": """WITH c AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations), d AS (SELECT conv_id, turn, l[1] AS duration, l[2] AS title, string_split(trim(replace(l[3], ', ', ' · ')), ' · ') AS p FROM c WHERE len(l) >= 3)
        SELECT conv_id, turn, duration, title, p[1] AS source, p[-1] AS author FROM d WHERE trim(p[1]) <> ''""",
    "dedup_links": f"WITH {LINKS} SELECT link, max(page_id) AS page_id FROM links GROUP BY link",
    "merge_links": f"WITH {LINKS}, {MERGED} SELECT page_id, link, duration, title, source, author FROM merged",
    "allow_sources": "SELECT CAST(o_orderkey AS VARCHAR) AS link, o_orderpriority AS source FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "new_links": f"WITH {LINKS} SELECT page_id, link FROM now WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.link IS NOT DISTINCT FROM now.link)",
    "merge_summary": f"WITH {LINKS}, {MERGED} SELECT count(*) FILTER (WHERE link NOT IN (SELECT link FROM old)) AS new_links, count(*) AS total_links FROM merged",
    "source_breakdown": f"WITH {LINKS} SELECT source, count(*) AS n FROM links GROUP BY source",
    "duplicate_groups": f"WITH {LINKS} SELECT page_id, duration, source FROM (SELECT *, count(*) OVER (PARTITION BY duration, source) AS n FROM links) WHERE n > 1",
    "set_overlap": f"WITH {LINKS}, a AS (SELECT DISTINCT link FROM now), b AS (SELECT DISTINCT link FROM old) SELECT (SELECT count(*) FROM a WHERE link NOT IN (SELECT link FROM b)) AS left_only, (SELECT count(*) FROM a WHERE link IN (SELECT link FROM b)) AS both, (SELECT count(*) FROM b WHERE link NOT IN (SELECT link FROM a)) AS right_only",
    "union_distinct": f"WITH {LINKS} SELECT link, source FROM now UNION SELECT link, source FROM old",
    "sort_by": f"WITH {LINKS} SELECT page_id, title FROM links ORDER BY title NULLS LAST",
    "shape_counts": f"SELECT count(*) AS rows_before, count(*) FILTER (WHERE o_orderpriority IN {_in(SOURCES)}) AS rows_after FROM orders",
    "clock_to_seconds": f"WITH {SECONDS} SELECT event_id, clock, seconds FROM secs",
    "describe_stats": f"WITH {SECONDS} SELECT count(seconds) AS count, round(avg(seconds), 6) AS mean, round(stddev_samp(seconds), 6) AS std, min(seconds) AS min, quantile_cont(seconds, 0.25) AS p25, quantile_cont(seconds, 0.5) AS p50, quantile_cont(seconds, 0.75) AS p75, max(seconds) AS max FROM secs",
    "total_seconds": f"WITH {SECONDS} SELECT CAST(sum(seconds) AS BIGINT) AS total_seconds FROM secs",
    "extension_counts": r"SELECT regexp_extract(url, '\.([^./\\]+)$', 1) AS extension, count(*) AS n FROM pages GROUP BY 1",
    "flatten_struct": "SELECT o_orderkey, o_orderstatus AS info_status, o_orderpriority AS info_priority_name FROM orders",
    "platform_links": "SELECT lower(o_orderpriority) AS platform, count(*) AS n_links FROM orders GROUP BY 1",
    "platform_processed": f"WITH {PROCESSED} SELECT * FROM proc",
    "funnel_counts": f"WITH {COUNTS} SELECT stage, n FROM counts",
    "funnel_edges": f"WITH {EDGES} SELECT src, dst, n, kind FROM edges",
    "funnel_shares": f"""WITH {EDGES}, i AS (SELECT dst AS node, sum(n) AS n_in FROM edges GROUP BY 1), o AS (SELECT src AS node, sum(n) AS n_out FROM edges GROUP BY 1),
        size AS (SELECT coalesce(i.node, o.node) AS node, coalesce(n_in, n_out) AS size FROM i FULL JOIN o ON i.node = o.node)
        SELECT src, dst, n, kind, round(100.0 * n / a.size, 6)::DOUBLE AS percent_of_src, round(100.0 * b.size / (SELECT links FROM c), 6)::DOUBLE AS dst_percent_of_links FROM edges JOIN size a ON a.node = src JOIN size b ON b.node = dst""",
    "funnel_stages": f"WITH {COUNTS} SELECT place, stage, n_in, kept, n_in - kept AS removed FROM (SELECT 1 AS place, 'processed' AS stage, links AS n_in, processed AS kept FROM c UNION ALL SELECT 2, 'topic', processed, topic FROM c UNION ALL SELECT 3, 'unique', topic, uniq FROM c UNION ALL SELECT 4, 'has_terms', uniq, terms FROM c)",
    "relabel": "SELECT CASE lower(o_orderpriority) WHEN '1-urgent' THEN 'Urgent' WHEN '2-high' THEN 'High' ELSE lower(o_orderpriority) END AS platform, count(*) AS n_links FROM orders GROUP BY 1",
    "join_results": f"WITH {META} SELECT CAST(l.doc_id AS VARCHAR) AS file_key, extractor, title, CASE WHEN toxic = 1 THEN NULL ELSE view_count END AS view_count, 'quality ' || CAST(quality AS VARCHAR) AS \"AI_description\", CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS sentiment, CAST(toxic AS VARCHAR) AS mood FROM labels l LEFT JOIN meta ON file_key = CAST(l.doc_id AS VARCHAR)",
    "pick_results": "SELECT 'none' AS alternative, CAST(doc_id AS VARCHAR) AS file_key, CAST(toxic AS VARCHAR) AS mood FROM labels UNION ALL SELECT 'some', 'think-' || doc_id, lang FROM documents",
    "normalize_sentiment": "SELECT CAST(doc_id AS VARCHAR) AS file_key, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS sentiment FROM labels",
    "pending": f"WITH {META} SELECT file_key FROM meta WHERE file_key NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)",
    "eligible": f"WITH {META} SELECT file_key, ext, CASE WHEN ext IS NULL THEN 'no extension' WHEN ext IN ('mp3', 'm4a') THEN 'sound only' WHEN view_count % 2 <> 0 THEN 'no media file' END AS reason FROM meta",
    "render_prompt": f"WITH {META} SELECT file_key, 'From ' || extractor || ' by nobody: ' || coalesce(description, 'nothing') || '. ' || CAST(like_count AS VARCHAR) || ' likes, no comments.' AS prompt FROM meta",
    "clean_response": f"SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN {_WHOLE} END AS clean FROM events",
    "project_annotation": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) END AS k, CASE WHEN event_id % 5 <> 0 AND event_id % 3 <> 2 THEN event_type || '|x y' END AS tags, CASE WHEN event_id % 5 <> 0 THEN event_type END AS note, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 4 = 0 THEN true WHEN event_id % 4 = 1 THEN false END AS flag FROM events",
    "parse_ymd": f"WITH {RAW_DATES} SELECT o_orderkey, CASE WHEN k = 0 THEN CAST(day AS VARCHAR) END AS date FROM raw",
    "parse_date_loose": f"WITH {RAW_DATES} SELECT o_orderkey, CASE WHEN k < 3 THEN CAST(day AS VARCHAR) END AS date FROM raw",
    "month_end": f"WITH {POSTS} SELECT id, CAST(last_day(date) AS VARCHAR) AS month_end FROM posts",
    "with_periods": f"WITH {POSTS} SELECT id, CAST(year(date) AS INTEGER) AS year, CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS month, year_month FROM posts",
    "title_case": f"WITH t AS (SELECT p_partkey, p_name || ' 5x''s ' || p_brand AS s FROM part) SELECT p_partkey, {title('s')} AS title FROM t",
    "split_terms": f"WITH {POSTS} SELECT id, coalesce(array_to_string({split('supplements')}, '|'), '') AS terms FROM posts",
    "parse_list": f"WITH {POSTS} SELECT id, array_to_string({parse('supplements')}, '|') AS terms FROM posts",
    "drop_sentinels": f"WITH {POSTS} SELECT id, coalesce(array_to_string(list_filter({split('supplements')}, lambda x: lower(x) NOT IN ('red ring', 'hot bolt')), '|'), '') AS terms FROM posts",
    "alias_title": f"SELECT p_partkey, CASE p_name WHEN 'red ring' THEN 'RR' WHEN 'hot bolt' THEN 'HB' ELSE {title('p_name')} END AS name FROM part",
    "term_key": "SELECT p_partkey, lower(p_name) AS key FROM part",
    "normalize_symptoms": f"WITH {POSTS} SELECT id, coalesce(array_to_string({_SHOWN.format(split(_STRESSED))}, '|'), '') AS symptoms FROM posts",
}
