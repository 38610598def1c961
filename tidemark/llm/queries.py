"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, decontamination, fingerprints, html_text, idfile, lm_score, near_dedup, pipeline, substring_dedup, token_counts, topk, toxicity, vector_codes
from .common import shared_dir

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, shared_dir(spark, "token-cache"), public_tokenizers.path(TOKENIZER))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path(TOKENIZER)).drop("text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, _table(spark, sf_dir, "labels")).drop("text")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring_dedup.remove_repeats(docs)
    return found.select("doc_id", *substring_dedup.kept_digest(F.col("repeats")))


def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "ids")
    idfile.write_ids(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return idfile.id_digests(idfile.read_ids(spark, path))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("hit")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(_table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(damaged, F.col("dropped"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode_vectors(_table(spark, sf_dir, "embeddings"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_near_dedup": op2_near_dedup,
    "op3_html_text": op3_html_text,
    "op4_token_counts": op4_token_counts,
    "op5_bpe": op5_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_id_files": op8_id_files,
    "op9_decontamination": op9_decontamination,
    "op10_lm_score": op10_lm_score,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_vector_codes": op12_vector_codes,
    "op13_fingerprints": op13_fingerprints,
    "pipeline": pipeline.run,
}

#: A-Z to lower case, and the words of the benchmark rules, as DuckDB has them.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NORMAL = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: crc32 of an ASCII text, a byte at a time, with the table that its polynomial makes.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"

_REPAIR = f"""
    WITH RECURSIVE keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    d AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS kind FROM keyed, {_CRC_TABLE}),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM d),
    rows AS (
        SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
    faulty AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(right(body, 1), '[.!?]') THEN 'truncated' ELSE '' END AS fault FROM rows),
    moves(st, tgt, ins, name) AS (VALUES (0, 1, '', 's'), (0, 2, '', 'user'), (1, 2, '', 'user'), (3, 2, '', 'user'), (2, 2, 'I', 'user'), (2, 3, '', 'assistant'), (0, 3, 'I', 'assistant'), (1, 3, 'I', 'assistant'), (3, 3, 'I', 'assistant'), (0, 0, 'D', ''), (1, 1, 'D', ''), (2, 2, 'D', ''), (3, 3, 'D', '')),
    steps AS (
        SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, 0 AS st, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM conversations
        UNION ALL
        SELECT conv_id, n, st, cost, audit, said FROM (SELECT s.conv_id, r.n, m.tgt AS st, s.cost + CASE WHEN m.ins = 'D' THEN 4 ELSE 3 * length(m.ins) + CASE WHEN left(r.role, 1) = left(m.name, 1) THEN 0 ELSE 3 END + CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END END AS cost,
            s.audit || m.ins || CASE WHEN m.ins = 'D' THEN '' WHEN left(r.role, 1) = left(m.name, 1) THEN 'K' ELSE 'R' END AS audit,
            CASE WHEN m.ins = 'D' THEN s.said ELSE list_concat(s.said, CASE WHEN m.ins = '' THEN CAST([] AS VARCHAR[]) WHEN m.tgt = 2 THEN ['assistant:'] ELSE ['user:'] END, [CASE WHEN left(r.role, 1) = left(m.name, 1) THEN r.role ELSE m.name END || ':' || r.text]) END AS said
        FROM steps s JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.n = s.n + 1 JOIN moves m ON m.st = s.st
            AND (m.ins = 'D' OR r.fault NOT IN ('blank', 'duplicate')) AND (m.name <> 's' OR left(r.role, 1) = 's')) ways
        QUALIFY row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) = 1),
    last AS (SELECT conv_id, max(n) AS n FROM steps GROUP BY conv_id),
    ends(st, more, added) AS (VALUES (0, '', CAST([] AS VARCHAR[])), (1, 'II', ['user:', 'assistant:']), (2, 'I', ['assistant:']), (3, '', CAST([] AS VARCHAR[]))),
    best AS (
        SELECT s.conv_id, s.cost + 3 * length(more) AS cost, s.audit || more AS audit, list_concat(said, added) AS said FROM steps s JOIN last l ON l.conv_id IS NOT DISTINCT FROM s.conv_id AND l.n = s.n JOIN ends USING (st)
        QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY s.cost + 3 * length(more), s.audit || more) = 1),
    pairs AS (SELECT conv_id, turn, fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair FROM faulty),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
            count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id)
    SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        CAST(cost AS BIGINT) AS cost, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256
    FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id"""


def _codes(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """The codes of vectors: a round after the other."""
    near = lambda k: f"""
    near{k} AS MATERIALIZED (
        SELECT id, p, v, arg_min(e, (distance, e)) AS e, min(distance) AS distance FROM (
            SELECT x.id, x.p, x.v, b.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.c[i]) * (x.v[i] - b.c[i]))) AS distance FROM parts x JOIN book{k} b USING (p)) GROUP BY id, p, v)"""  # noqa: E731
    out = f"""
    WITH whole AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT id, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM whole, (SELECT unnest(range({parts})) AS p)),
    book0 AS MATERIALIZED (SELECT p, id - 1 AS e, v AS c FROM parts WHERE id <= {entries})"""
    for k in range(rounds):
        out += f""", {near(k)},
    sums{k} AS (SELECT p, e, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM near{k}) GROUP BY p, e, i),
    book{k + 1} AS MATERIALIZED (
        SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN (SELECT p, e, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS c FROM sums{k} GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"""
    return out + f""", {near(rounds)},
    coded AS (SELECT id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(distance) AS BIGINT) AS error FROM near{rounds} GROUP BY id)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
    FROM coded JOIN whole USING (id)"""


SQL: dict[str, str] = {
    "op11_conversation_repair": _REPAIR,
    "op12_vector_codes": _codes(),
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5""",
    "op2_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
            FROM d WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT u, v FROM pairs JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v
            WHERE 100 * common >= 75 * (a.n + b.n - common)),
        reach AS (
            SELECT doc_id, doc_id AS root FROM d
            UNION
            SELECT v, root FROM reach JOIN links ON u = doc_id WHERE root < v),
        least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op7_substring_dedup": """
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
        wins AS (
            SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: array_to_string(w[i:i + 34], ' '))) AS win
            FROM d WHERE len(w) >= 35),
        often AS (SELECT win FROM wins GROUP BY win HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM wins JOIN often USING (win)),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
        kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
            FROM words LEFT JOIN gone USING (doc_id, p) WHERE gone.doc_id IS NULL GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) AS BIGINT) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op9_decontamination": f"""
        WITH d AS (SELECT doc_id, {_NORMAL} AS w FROM documents),
        b AS (SELECT item_id, {_NORMAL} AS w FROM benchmark),
        items AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS span, unnest(CASE WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) END) AS win
            FROM b WHERE len(w) > 0),
        spans AS (SELECT DISTINCT span FROM items),
        places AS (
            SELECT doc_id, span, unnest(range(1, len(w) - span + 2)) AS i, unnest(list_transform(range(1, len(w) - span + 2), lambda i: array_to_string(w[i:i + span - 1], ' '))) AS win
            FROM d, spans WHERE len(w) >= span),
        hits AS (SELECT doc_id, i, span, item_id FROM places JOIN items USING (span, win)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + span)) AS p FROM hits) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)""",
}
