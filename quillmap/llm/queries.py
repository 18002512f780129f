"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.llm import bytebpe, conversations, fingerprint, fmindex, language, lexical, mixing, ngram_join, quality, revisits, suffix_dedup, templates, wordpiece
from quillmap.llm.common import documents
from quillmap.plans.registry import Query

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
PIECE_FILE = "piece_bpe_32k.model"


def op1_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure_quality(documents(spark, sf_dir))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(documents(spark, sf_dir))


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    found = revisits.resolve_revisits(revisits.capture_history(pages))
    names = ("cache-control", "content-length", "content-type", "date", "etag", "last-modified")
    fields = [found["headers"][n].alias(n.replace("-", "_")) for n in names]
    return found.select("record_id", "url_key", "outcome", "response_id", "digest", *fields)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify_language(docs, language.train_language_model(docs))


def op5_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = wordpiece.read_pieces(public_tokenizers.path(PIECE_FILE))
    return wordpiece.count_tokens(documents(spark, sf_dir), pieces)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bytebpe.read_ranks(public_tokenizers.path(RANK_FILE))
    return bytebpe.encode_documents(documents(spark, sf_dir), tokens, public_tokenizers.PATTERN, ids=False)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).drop("copies")


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.drop_recurring_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "row.doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256"),
    )


def op11_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = fmindex.contamination_spans(fmindex.find_contamination(documents(spark, sf_dir), items))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    return conversations.repair_conversations(conversations.damage(turns), turns)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return lexical.search(documents(spark, sf_dir), items)


QUERIES: dict[str, Query] = {
    "op1_quality_bands": op1_quality_bands,
    "op2_ngram_join": op2_ngram_join,
    "op3_revisits": op3_revisits,
    "op4_language_id": op4_language_id,
    "op5_edit_fingerprints": op5_edit_fingerprints,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_source_mix": op9_source_mix,
    "op10_line_templates": op10_line_templates,
    "op11_fm_decontamination": op11_fm_decontamination,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE: dict[str, str] = {
    "op2_ngram_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
        placed AS (
            SELECT doc_id, w, len(w) AS n, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0),
        shingles AS (
            SELECT DISTINCT doc_id, CASE WHEN n < 3 THEN array_to_string(w, ' ')
                ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
            FROM placed),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (
            SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * common >= 90 * (x.n + y.n - common)),
        reach AS (
            SELECT a AS doc_id, a AS seen FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.seen)
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(min(r.seen), d.doc_id) AS component_id
        FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.doc_id = d.doc_id
        GROUP BY d.doc_id, s.n""",
    "op3_revisits": r"""
        WITH rests AS (
            SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^([a-zA-Z][a-zA-Z0-9+.-]*:)?//', '') AS rest
            FROM pages),
        parts AS (
            SELECT page_id, html, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.|:(80|443)$', '') AS host,
                regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
                list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
                    lambda x: x <> '' AND NOT regexp_matches(x, '^(?i)(utm_[^=]*|gclid|fbclid|ref)='))) AS params
            FROM rests),
        keyed AS (
            SELECT page_id, html, page_id * 600 AS moment,
                host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key,
                '"' || substr(md5(html), 1, 16) || '"' AS tag, 'version ' || (page_id % 3) AS changed
            FROM parts),
        revisits AS (
            SELECT page_id * 3 + 1 AS record_id, url_key, moment + 259200 AS moment, 'no-cache' AS cache_control,
                CASE WHEN page_id % 5 = 0 THEN '"changed"' ELSE 'W/' || tag END AS etag, NULL AS last_modified
            FROM keyed
            UNION ALL
            SELECT page_id * 3 + 2, url_key, moment + (page_id % 11 - 2) * 86400, NULL, NULL,
                CASE WHEN page_id % 4 = 0 THEN 'version x' ELSE changed END
            FROM keyed),
        pairs AS (
            SELECT r.record_id, k.page_id, row_number() OVER (PARTITION BY r.record_id ORDER BY k.moment DESC, k.page_id DESC) AS place
            FROM revisits r JOIN keyed k ON r.url_key = k.url_key
                AND (k.moment < r.moment OR (k.moment = r.moment AND k.page_id * 3 < r.record_id))),
        judged AS (
            SELECT r.*, k.page_id, k.html, k.tag, k.changed,
                CASE WHEN k.page_id IS NULL THEN 'no_response'
                    WHEN r.etag IS NOT NULL AND replace(r.etag, 'W/', '') = k.tag THEN 'resolved'
                    WHEN r.etag IS NULL AND r.last_modified = k.changed THEN 'resolved'
                    ELSE 'mismatch' END AS outcome
            FROM revisits r LEFT JOIN pairs p ON p.record_id = r.record_id AND p.place = 1 LEFT JOIN keyed k ON k.page_id = p.page_id)
        SELECT record_id, url_key, outcome, page_id * 3 AS response_id,
            CASE WHEN outcome = 'resolved' THEN sha256(html) END AS digest,
            CASE WHEN outcome = 'resolved' THEN coalesce(cache_control, 'max-age=' || (page_id % 7 * 60)) END AS cache_control,
            CASE WHEN outcome = 'resolved' THEN CAST(octet_length(encode(html)) AS VARCHAR) END AS content_length,
            CASE WHEN outcome = 'resolved' THEN 'text/html' END AS content_type,
            CASE WHEN outcome = 'resolved' THEN CAST(moment AS VARCHAR) END AS date,
            CASE WHEN outcome = 'resolved' THEN coalesce(etag, tag) END AS etag,
            CASE WHEN outcome = 'resolved' THEN coalesce(last_modified, changed) END AS last_modified
        FROM judged""",
    "op9_source_mix": r"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS hash
            FROM documents),
        sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight
            FROM sized GROUP BY source),
        ranked AS (
            SELECT *, 3.0 * source_size / weight AS full_at,
                sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0) AS words,
                sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weights
            FROM sources
            WINDOW w AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        level AS (
            SELECT words, weights FROM ranked WHERE words <= full_at * weights ORDER BY full_at, source LIMIT 1),
        plan AS (
            SELECT s.source, s.source_size,
                CASE WHEN s.weight * l.words > s.source_size * 3 * l.weights THEN CAST(s.source_size * 3 AS DOUBLE)
                    ELSE CAST(l.words AS DOUBLE) * s.weight / l.weights END AS target
            FROM sources s, level l),
        parts AS (
            SELECT source, source_size, target,
                CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies
            FROM plan),
        groups AS (
            SELECT source, hash, sum(size) AS words FROM sized GROUP BY source, hash),
        placed AS (
            SELECT source, hash, words, coalesce(sum(words) OVER (PARTITION BY source ORDER BY hash
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM groups)
        SELECT d.doc_id, d.size, p.source_size, p.target,
            CAST(d.size * (p.copies + CASE WHEN 2 * g.before + g.words < 2 * (p.target - p.copies * p.source_size)
                THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM sized d
        JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
        JOIN placed g ON d.source IS NOT DISTINCT FROM g.source AND d.hash = g.hash""",
    "op10_line_templates": r"""
        WITH texts AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
        lines AS (SELECT t, unnest(list_distinct(string_split(t, chr(10)))) AS line FROM texts),
        digests AS (SELECT t, list_sort(list(md5(line))) AS digest FROM lines GROUP BY t),
        words AS (SELECT t, line, regexp_extract_all(line, '[^\x20\x09\x0B-\x0D]+') AS w FROM lines),
        masked AS (
            SELECT t, line, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9@]|://') THEN '<*>' ELSE x END) AS m
            FROM words WHERE len(w) >= 1),
        leaves AS (SELECT t, line, m, len(m) || ' ' || array_to_string(m[1:3], ' ') AS leaf FROM masked),
        often AS (SELECT leaf FROM leaves GROUP BY leaf HAVING count(DISTINCT t) >= 10),
        held AS (SELECT l.t, l.line, l.m, l.leaf FROM leaves l JOIN often o ON l.leaf = o.leaf),
        places AS (SELECT t, line, leaf, unnest(m) AS token, unnest(range(1, len(m) + 1)) AS place FROM held),
        constants AS (
            SELECT leaf, place, token FROM places WHERE token <> '<*>' GROUP BY leaf, place, token HAVING count(*) >= 10),
        shown AS (
            SELECT p.t, p.line, string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY p.place) AS template,
                count(c.token) AS constants, count(*) AS length
            FROM places p LEFT JOIN constants c ON p.leaf = c.leaf AND p.place = c.place AND p.token = c.token
            GROUP BY p.t, p.line),
        shares AS (
            SELECT l.t, 6 * (count(*) - count(o.leaf)) >= count(*) AS alone
            FROM leaves l LEFT JOIN often o ON l.leaf = o.leaf GROUP BY l.t),
        told AS (
            SELECT s.t, s.line, s.template, a.alone, CASE WHEN d.digest[1] = md5(s.line) THEN d.digest[2] ELSE d.digest[1] END AS rest
            FROM shown s JOIN digests d ON s.t = d.t JOIN shares a ON s.t = a.t WHERE 2 * s.constants >= s.length),
        recurring AS (
            SELECT template FROM told GROUP BY template
            HAVING count(DISTINCT t) FILTER (alone) >= 10
                OR count(DISTINCT rest) >= 10 AND 3 * count(DISTINCT rest) >= count(DISTINCT t)),
        gone AS (
            SELECT o.t, list(o.line) AS gone FROM told o JOIN recurring r ON o.template = r.template GROUP BY o.t),
        kept AS (
            SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS had,
                list_filter(string_split(d.text, chr(10)), lambda x: g.gone IS NULL OR NOT list_contains(g.gone, x)) AS has
            FROM documents d LEFT JOIN gone g ON coalesce(d.text, '') = g.t)
        SELECT doc_id, coalesce(len(had), 0) AS n_lines, coalesce(len(had) - len(has), 0) AS n_dropped,
            sha256(coalesce(array_to_string(has, chr(10)), '')) AS kept_sha256
        FROM kept""",
    "op11_fm_decontamination": r"""
        WITH words AS (
            SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
            FROM documents),
        items AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark WHERE text IS NOT NULL),
        windows AS (
            SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT n FROM windows),
        grams AS (
            SELECT row, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
            FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)),
        found AS (SELECT DISTINCT g.row, g.i, g.n, w.item FROM grams g JOIN windows w ON g.win = w.win AND g.n = w.n),
        hits AS (
            SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS place FROM found) GROUP BY row),
        met AS (
            SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM found) GROUP BY row)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hits USING (row) LEFT JOIN met USING (row)""",
    "op13_lexical_search": r"""
        WITH words AS (
            SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents WHERE text IS NOT NULL),
        whole AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM words WHERE len(w) > 0),
        item_terms AS (
            SELECT DISTINCT item, item_id, term FROM (
                SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(
                    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM benchmark)),
        wanted AS (SELECT DISTINCT term FROM item_terms),
        counts AS (
            SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM words) JOIN wanted USING (term) GROUP BY row, term),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight
            FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), whole),
        sizes AS (SELECT row, doc_id, 100 - 90 + (90 * len(w) * docs) // total AS m FROM words, whole WHERE len(w) > 0),
        gains AS (
            SELECT row, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS gain
            FROM counts JOIN weights USING (term) JOIN sizes USING (row)),
        scores AS (
            SELECT item, item_id, row, doc_id, CAST(sum(gain) AS BIGINT) AS score
            FROM item_terms JOIN gains USING (term) GROUP BY item, item_id, row, doc_id),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
