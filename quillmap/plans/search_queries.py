"""Question and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.functions import matching as m
from quillmap.functions import questions as qf
from quillmap.operators import indexed_search, match, names, questions, search
from quillmap.plans import oracle as o
from quillmap.plans import tables as t
from quillmap.plans.oracle import FILE, FOLDER, KEY, using
from quillmap.plans.registry import ORACLE, query
from quillmap.session import materialise, new_shared_path
from quillmap.sources import search_index

KEY_COLUMNS = KEY.split(", ")
FOLDER_COLUMNS = FOLDER.split(", ")

# ------------------------------------------------------------------- questions


@query(
    "latest_message",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN coalesce(text, '') ELSE '' END AS text
       FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1""",
)
def latest_message(spark, sf_dir):
    return questions.latest_message(t.spark_sql(spark, sf_dir, "SELECT * FROM {conversations}"))


# Turns as messages of every shape: a text, lists that end in a text, a record or a number, and none of them.
SHAPES = """SELECT conv_id, turn, role, text, CAST(turn % 6 AS INTEGER) AS shape FROM {conversations}"""


@query(
    "message_text",
    f"""SELECT conv_id, turn, shape, CASE WHEN shape < 3 THEN coalesce(text, '') WHEN shape = 3 THEN '["' || role || '",' || turn || ']'
        ELSE '' END AS text FROM ({t.oracle_text(SHAPES)})""",
)
def message_text(spark, sf_dir):
    turns = t.spark_sql(spark, sf_dir, SHAPES)
    as_json = lambda *parts: F.to_json(F.to_variant_object(F.array(*parts)))
    shapes = (
        F.when(F.col("shape") == 0, F.get(F.expr("regexp_extract_all(to_json(array(text)), '(?s)^.(.*).$', 1)"), F.lit(0)))
        .when(F.col("shape") == 1, as_json("role", "text"))
        .when(F.col("shape") == 2, as_json(F.struct("role", F.col("text").alias("content"))))
        .when(F.col("shape") == 3, F.concat(F.lit('["'), "role", F.lit('",'), F.col("turn").cast("string"), F.lit("]")))
        .when(F.col("shape") == 4, "[]")
        .otherwise(F.col("turn").cast("string"))
    )
    return turns.select("conv_id", "turn", "shape", qf.message_text(shapes).alias("text"))


# Every turn as it is, and once more as a message of another kind.
MESSAGES = """SELECT conv_id, turn, 'own' AS form, text FROM {conversations} UNION ALL
    SELECT conv_id, turn, 'command' AS form, CASE turn % 8 WHEN 0 THEN ' ' || 'HELP ' WHEN 1 THEN 'Sources'
    WHEN 2 THEN 'info' WHEN 3 THEN 'cache' WHEN 4 THEN 'reset cache' WHEN 5 THEN '  '
    WHEN 6 THEN 'list ' || role ELSE '?' END AS text FROM {conversations}"""


@query(
    "message_kind",
    f"""SELECT conv_id, turn, form, CASE WHEN word = '' THEN 'empty' WHEN word IN ('help', 'h', '?') THEN 'help'
        WHEN word IN ('list', 'show all', 'list all', 'sources') THEN 'list'
        WHEN word IN ('stats', 'statistics', 'info') THEN 'stats'
        WHEN word IN ('cache stats', 'cache', 'cachestats') THEN 'cache_stats'
        WHEN word IN ('clear cache', 'clearcache', 'reset cache') THEN 'clear_cache'
        ELSE 'search' END AS kind
        FROM (SELECT conv_id, turn, form, {o.strip('lower(text)')} AS word FROM ({t.oracle_text(MESSAGES)}))""",
)
def message_kind(spark, sf_dir):
    messages = t.spark_sql(spark, sf_dir, MESSAGES)
    return messages.select("conv_id", "turn", "form", qf.message_kind(F.col("text")).alias("kind"))


def _register_parser(name):
    @query(f"parse_{name}", using("parsed") + f"SELECT question_id, {name} FROM parsed")
    def run(spark, sf_dir):
        return t.questions(spark, sf_dir).select("question_id", qf.PARSERS[name](F.col("text")).alias(name))


for _name in qf.FILTERS:
    _register_parser(_name)


@query("parse_questions", using("parsed") + f"SELECT question_id, {o.FILTERS} FROM parsed")
def parse_questions(spark, sf_dir):
    return questions.parse_questions(questions.search_questions(t.questions(spark, sf_dir)))


# Vendor filters as a caller may pass them: names joined by "or" and "and".
VENDOR_FILTERS = """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name
    WHEN 1 THEN s_name || ' or ' || n_name ELSE s_name || ' AND ' || n_name || '  or r' END AS vendor
    FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""


@query(
    "split_vendors",
    f"""SELECT s_suppkey, vendor, array_to_string(list_transform(string_split_regex(lower(vendor),
        '\\s+or\\s+|\\s+and\\s+'), lambda v: trim(v)), '|') AS vendors FROM ({t.oracle_text(VENDOR_FILTERS)})""",
)
def split_vendors(spark, sf_dir):
    filters = t.spark_sql(spark, sf_dir, VENDOR_FILTERS)
    return filters.select(
        "s_suppkey", "vendor", F.concat_ws("|", qf.split_vendors(F.col("vendor"))).alias("vendors")
    )


# -------------------------------------------------------------------- matching

# Pairs of names: each part's name in eight spellings against its own name, its
# own with the other separator, and the name of the next part (of the first after the last).
NAME_PAIRS = """
SELECT p.p_partkey AS pair_id, CAST(k AS BIGINT) AS spelling,
       CASE k WHEN 0 THEN p.p_name WHEN 1 THEN replace(p.p_name, ' ', '_')
              WHEN 2 THEN split_part(p.p_name, ' ', 2) || ' ' || split_part(p.p_name, ' ', 1)
              WHEN 3 THEN split_part(p.p_name, ' ', 1) WHEN 4 THEN p.p_name || '_id'
              WHEN 5 THEN substr(p.p_name, 2) WHEN 6 THEN replace(p.p_name, 'l', 't')
              ELSE upper(p.p_name) || ' code_no' END AS query,
       CASE WHEN k < 6 THEN p.p_name ELSE n.p_name END AS target
FROM {part} AS p JOIN {part} AS n ON n.p_partkey = CASE WHEN p.p_partkey = (SELECT max(p_partkey) FROM {part})
         THEN (SELECT min(p_partkey) FROM {part}) ELSE p.p_partkey + 1 END
     CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4
                 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) AS spellings
"""


def _name_pairs(spark, sf_dir):
    """The spellings are exploded here, one row per part and spelling."""
    part = t.spark_sql(spark, sf_dir, "SELECT p_partkey, p_name FROM {part}")
    first_key, last_key = (part.agg(f("p_partkey")).scalar() for f in (F.min, F.max))
    before = F.when(F.col("p_partkey") == first_key, last_key).otherwise(F.col("p_partkey") - 1)
    following = part.select(before.alias("p_partkey"), F.col("p_name").alias("next_name"))
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    spellings = [
        F.col("p_name"), F.replace("p_name", F.lit(" "), F.lit("_")), F.concat(second, F.lit(" "), first), first,
        F.concat("p_name", F.lit("_id")), F.substr("p_name", F.lit(2)),
        F.replace("p_name", F.lit("l"), F.lit("t")), F.concat(F.upper("p_name"), F.lit(" code_no")),
    ]
    pairs = part.join(following, "p_partkey").select(
        F.col("p_partkey").alias("pair_id"), "p_name", "next_name",
        F.posexplode(F.array(*spellings)).alias("spelling", "query"),
    )
    target = F.when(F.col("spelling") < 6, F.col("p_name")).otherwise(F.col("next_name"))
    return pairs.select(
        "pair_id", F.col("spelling").cast("bigint").alias("spelling"),
        m.normalise_name(F.col("query")).alias("query"), m.normalise_name(target).alias("target"),
    )


PAIRS = f"(SELECT pair_id, spelling, trim(lower(query)) AS query, trim(lower(target)) AS target FROM ({t.oracle_text(NAME_PAIRS)}))"


@query(
    "field_match_score",
    f"""SELECT *, {o.field_case('query', 'target', o.SCORES)} AS score,
        {o.field_case('query', 'target', o.TYPES)} AS match_type FROM {PAIRS}""",
)
def field_match_score(spark, sf_dir):
    pairs = _name_pairs(spark, sf_dir)
    return pairs.withColumn("m", m.field_match(F.col("query"), F.col("target"))).select(
        *pairs.columns, "m.score", "m.match_type"
    )


@query("word_jaccard", f"SELECT *, round({o.jaccard('query', 'target')}, 9) AS jaccard FROM {PAIRS}")
def word_jaccard(spark, sf_dir):
    return _name_pairs(spark, sf_dir).withColumn(
        "jaccard", F.round(m.word_jaccard(F.col("query"), F.col("target")), 9)
    )


@query("edit_distance", f"SELECT *, CAST(levenshtein(query, target) AS BIGINT) AS distance FROM {PAIRS}")
def edit_distance(spark, sf_dir):
    return _name_pairs(spark, sf_dir).withColumn("distance", F.levenshtein("query", "target").cast("bigint"))


@query(
    "operator_from_filename",
    using("cells")
    + f"""SELECT source_name, vendor, file_stem, {o.operator_name('file_stem', 'source_name', 'vendor')} AS operator
          FROM (SELECT DISTINCT source_name, vendor, file_stem FROM cells)""",
)
def operator_from_filename(spark, sf_dir):
    files = t.cells(spark, sf_dir).select("source_name", "vendor", "file_stem").distinct()
    return search.with_operator(files)


BRAND_PAIRS = """SELECT p.p_partkey, CASE p.p_partkey % 4 WHEN 0 THEN replace(p.p_brand, '#', '')
    WHEN 1 THEN 'x ' || p.p_brand WHEN 2 THEN 'BRAND' ELSE '' END AS wanted, n.p_brand AS operator
    FROM {part} AS p JOIN {part} AS n ON n.p_partkey = CASE WHEN p.p_partkey % 4 = 1 THEN p.p_partkey
        WHEN p.p_partkey = (SELECT max(p_partkey) FROM {part}) THEN (SELECT min(p_partkey) FROM {part})
        ELSE p.p_partkey + 1 END"""


@query(
    "operator_matches",
    f"SELECT p_partkey, {o.operator_match('wanted', 'operator')} AS matched FROM ({t.oracle_text(BRAND_PAIRS)})",
)
def operator_matches(spark, sf_dir):
    pairs = t.spark_sql(spark, sf_dir, BRAND_PAIRS)
    return pairs.select("p_partkey", m.operator_matches(F.col("wanted"), F.col("operator")).alias("matched"))


# ---------------------------------------------------------------------- search


def _filters(spark, sf_dir):
    return questions.distinct_filters(questions.parse_questions(t.questions(spark, sf_dir)))


def _some_filters(spark, sf_dir, *attrs):
    return materialise(_filters(spark, sf_dir).select(F.concat_ws("|", *[
        F.coalesce(a, F.lit("")) for a in attrs]).alias("filter_key"), *attrs).distinct())


def _some_filters_sql(*attrs):
    key = ", ".join(f"coalesce({a}, '')" for a in attrs)
    return f"(SELECT DISTINCT concat_ws('|', {key}) AS filter_key, {', '.join(attrs)} FROM filters)"


@query(
    "filter_folders",
    using("filters", "cells")
    + f"""SELECT f.filter_key, {FOLDER.replace('source', 'e.source', 1).replace(' module', ' e.module')
        .replace(' source_name', ' e.source_name').replace(' vendor', ' e.vendor')}
        FROM {_some_filters_sql('source', 'module', 'source_name')} f
        JOIN (SELECT DISTINCT {FOLDER} FROM cells) e ON {o.passes('source', 'module', 'source_name')}""",
)
def filter_folders(spark, sf_dir):
    attrs = ("source", "module", "source_name")
    folders = materialise(t.cells(spark, sf_dir).select(*FOLDER_COLUMNS).distinct())
    return match.match_things(_some_filters(spark, sf_dir, *attrs), folders, attrs)


@query(
    "filter_vendor_any",
    f"""SELECT f.vendor AS filter_key, e.s_name AS vendor FROM (SELECT DISTINCT vendor FROM
        ({t.oracle_text(VENDOR_FILTERS)})) f JOIN (SELECT DISTINCT s_name FROM supplier) e ON len(list_filter(
        string_split_regex(lower(f.vendor), '\\s+or\\s+|\\s+and\\s+'), lambda v: contains(lower(e.s_name), trim(v)))) > 0""",
)
def filter_vendor_any(spark, sf_dir):
    filters = t.spark_sql(spark, sf_dir, VENDOR_FILTERS).select(F.col("vendor").alias("filter_key"), "vendor")
    vendors = t.spark_sql(spark, sf_dir, "SELECT DISTINCT s_name AS vendor FROM {supplier}")
    return match.match_things(filters.distinct(), vendors, ("vendor",))


@query(
    "filter_dimension",
    using("filters", "rules")
    + f"""SELECT f.filter_key, e.dimension, e.field
        FROM {_some_filters_sql('dimension')} f
        JOIN (SELECT DISTINCT dimension, field FROM rules) e ON {o.passes('dimension')}""",
)
def filter_dimension(spark, sf_dir):
    keys = materialise(t.rules(spark, sf_dir).select("dimension", "field").distinct())
    return match.match_things(_some_filters(spark, sf_dir, "dimension"), keys, ("dimension",))


@query("filter_field_score", using("pairs") + "SELECT query, target, score, match_type FROM pairs")
def filter_field_score(spark, sf_dir):
    wanted = _filters(spark, sf_dir).where(F.col("field").isNotNull())
    found = search.valid_expressions(t.rules(spark, sf_dir))
    return names.similar_pairs(
        materialise(wanted.select(m.normalise_name(F.col("field")).alias("query")).distinct()),
        materialise(found.select(m.normalise_name(F.col("field")).alias("target")).distinct()),
    )


@query("valid_expressions", using("valid") + f"SELECT {FILE}, row_no, dimension, field, expression FROM valid")
def valid_expressions(spark, sf_dir):
    return search.valid_expressions(t.rules(spark, sf_dir))


@query(
    "confidence",
    using("expressions")
    + f"""SELECT DISTINCT {KEY}, valid_count, CAST(1 AS DOUBLE) * CAST(0.7 AS DOUBLE)
          + least(valid_count / 5, CAST(1 AS DOUBLE)) * CAST(0.3 AS DOUBLE) AS confidence_score FROM expressions""",
)
def confidence(spark, sf_dir):
    keys = search.valid_expressions(t.rules(spark, sf_dir)).groupBy(*KEY_COLUMNS).agg(F.count("*").alias("valid_count"))
    return keys.withColumn("confidence_score", m.confidence(F.lit(1.0), F.col("valid_count")))


RESULT_SQL = f"filter_key, {', '.join(search.RESULT)}, row_no"


def _search(spark, sf_dir, entries=False):
    rules = materialise(search.with_operator(t.rules(spark, sf_dir)))
    return search.search(questions.parse_questions(t.questions(spark, sf_dir)), rules, entries), rules


@query("search_catalogue", using("found") + f"SELECT {RESULT_SQL} FROM found")
def search_catalogue(spark, sf_dir):
    return search.results(*_search(spark, sf_dir, entries=True))


@query("rank_results", using("found") + f"SELECT {RESULT_SQL} FROM found ORDER BY filter_key, {o.RANK_ORDER}")
def rank_results(spark, sf_dir):
    return search.rank_results(search.results(*_search(spark, sf_dir, entries=True)))


@query(
    "top_results",
    using("ranked", "keyed")
    + f"""SELECT question_id, rank, {', '.join(search.RESULT)}, row_no
          FROM (SELECT question_id, filter_key FROM keyed) JOIN ranked USING (filter_key) WHERE rank <= 50""",
)
def top_results(spark, sf_dir):
    matches, rules = _search(spark, sf_dir)
    asked = questions.with_filter_key(questions.parse_questions(t.questions(spark, sf_dir)))
    top = search.top_results(matches, rules).withColumn("rank", F.col("rank").cast("bigint"))
    return asked.select("question_id", "filter_key").join(top, "filter_key").drop("filter_key")


@query(
    "number_results",
    using("ranked") + "SELECT filter_key, rank, filename, row_no FROM ranked WHERE rank <= 50",
)
def number_results(spark, sf_dir):
    top = search.top_results(*_search(spark, sf_dir))
    return top.select("filter_key", F.col("rank").cast("bigint").alias("rank"), "filename", "row_no")


@query(
    "result_summary",
    using("ranked", "keyed")
    + """SELECT question_id, coalesce(total, 0) AS total, coalesce(shown, 0) AS shown, mean_confidence,
         coalesce(high_confidence, 0) AS high_confidence
         FROM keyed LEFT JOIN (SELECT filter_key, count(*) AS total, count(*) FILTER (rank <= 50) AS shown,
             round(avg(confidence_score) FILTER (rank <= 50), 6) AS mean_confidence,
             count(*) FILTER (rank <= 50 AND confidence_score >= CAST(0.7 AS DOUBLE)) AS high_confidence
             FROM ranked GROUP BY filter_key) USING (filter_key)""",
)
def result_summary(spark, sf_dir):
    matches, _ = _search(spark, sf_dir)
    asked = questions.with_filter_key(questions.parse_questions(t.questions(spark, sf_dir)))
    summary = search.result_summary(questions.distinct_filters(asked), matches)
    return asked.select("question_id", "filter_key").join(summary, "filter_key").select(
        "question_id", "total", "shown", F.round("mean_confidence", 6).alias("mean_confidence"), "high_confidence"
    )


# ------------------------------------------------ the same from a stored index


def _indexed(spark, sf_dir):
    index = search_index.build_index(t.rules(spark, sf_dir), new_shared_path(spark, "index"))
    return questions.parse_questions(t.questions(spark, sf_dir)), index


@query("indexed_search", ORACLE["search_catalogue"])
def indexed_results(spark, sf_dir):
    asked, index = _indexed(spark, sf_dir)
    return indexed_search.indexed_results(indexed_search.indexed_matches(asked, index), index)


@query("indexed_top_results", ORACLE["top_results"])
def indexed_top_results(spark, sf_dir):
    asked, index = _indexed(spark, sf_dir)
    top = indexed_search.indexed_top(asked, index).withColumn("rank", F.col("rank").cast("bigint"))
    return questions.with_filter_key(asked).select("question_id", "filter_key").join(top, "filter_key").drop("filter_key")


@query("indexed_summary", ORACLE["result_summary"])
def indexed_summary(spark, sf_dir):
    asked, index = _indexed(spark, sf_dir)
    summary = indexed_search.indexed_summary(asked, index)
    return questions.with_filter_key(asked).select("question_id", "filter_key").join(summary, "filter_key").select(
        "question_id", "total", "shown", F.round("mean_confidence", 6).alias("mean_confidence"), "high_confidence"
    )


RESULT_KEY = f"filter_key, {KEY}, operator, filename, row_no"
RESULT_KEY_COLUMNS = RESULT_KEY.split(", ")


@query(
    "confidence_band",
    using("found")
    + f"""SELECT {RESULT_KEY}, CASE WHEN confidence_score >= CAST(0.8 AS DOUBLE) THEN 'HIGH'
         WHEN confidence_score >= CAST(0.6 AS DOUBLE) THEN 'MED' ELSE 'LOW' END AS band FROM found""",
)
def confidence_band(spark, sf_dir):
    found = search.results(*_search(spark, sf_dir, entries=True))
    return found.select(*RESULT_KEY_COLUMNS, m.confidence_band(F.col("confidence_score")).alias("band"))


LABELS = " ".join(
    f"WHEN {name} THEN '{label}'" for name, label in zip(
        [*o.TYPES, "'no_filter'"],
        ["Exact", "Underscore Space Variation", "Prefix", "Contains", "Word Similarity", "Partial Word Similarity",
         "Levenshtein Close", "Levenshtein Partial", "No Match", "No Filter"],
    )
)


@query(
    "display_columns",
    using("found")
    + f"""SELECT {RESULT_KEY}, format('{{:.1f}}%', confidence_score * 100) AS confidence,
         CASE field_match_type {LABELS} END AS match_label,
         format('{{:.1f}}%', field_match_score * 100) AS field_match FROM found""",
)
def display_columns(spark, sf_dir):
    return search.results(*_search(spark, sf_dir, entries=True)).select(
        *RESULT_KEY_COLUMNS,
        m.percent(F.col("confidence_score")).alias("confidence"),
        m.match_label(F.col("field_match_type")).alias("match_label"),
        m.percent(F.col("field_match_score")).alias("field_match"),
    )
