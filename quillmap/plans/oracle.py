"""Shared parts of the oracle SQL."""

from __future__ import annotations

from quillmap.plans.tables import CELLS, HEADER_ROWS, KNOWN, MANIFEST, QUESTIONS, ROW_ORDER, WORKBOOKS, oracle_text

# Fixed values, stated anew: what the SQL expects must not follow the code it checks.
ERROR_TEXTS = ("#ref!", "#n/a", "#value!", "#name?", "#null!", "#div/0!")
NOT_OPERATORS = (
    "ldrules", "ld", "rules", "mapping", "mappings", "template",
    "v1", "v2", "v3", "final", "new", "old", "copy",
)

FOLDER = "source, module, source_name, vendor"
FILE = f"{FOLDER}, file_stem"
KEY = f"{FOLDER}, dimension, field"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def has_error(text: str) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{e}')" for e in ERROR_TEXTS) + ")"


STEPS = {
    "cells": oracle_text(CELLS),
    "grid": f"""SELECT {FILE}, {HEADER_ROWS} + row_number() OVER (
        PARTITION BY {FILE} ORDER BY l_orderkey, {", ".join(ROW_ORDER)}) AS row_no, a, b, c, d,
        CASE WHEN d IS NULL THEN [a, b, c] ELSE [a, b, c, d] END AS cells FROM cells""",
    "picked": f"""SELECT {FILE}, row_no, cells[2] AS dimension, cells[3] AS field, cells[4] AS expression
        FROM grid WHERE row_no > {HEADER_ROWS} AND len(cells) >= 4""",
    "normal": f"""SELECT {FILE}, row_no, {", ".join(f"coalesce({strip(p)}, '') AS {p}" for p in
        ("dimension", "field", "expression"))} FROM picked""",
    "filled": "SELECT * FROM normal WHERE dimension <> '' AND field <> '' AND expression <> ''",
    "placed": "SELECT * FROM filled WHERE expression NOT IN ('-', 'NA', 'N/A')",
    "rules": f"SELECT * FROM placed WHERE NOT {has_error('expression')}",
    "questions": oracle_text(QUESTIONS),
    "workbooks": oracle_text(WORKBOOKS),
    "manifest": oracle_text(MANIFEST),
}
NEEDS = {
    "grid": ["cells"], "picked": ["grid"], "normal": ["picked"], "filled": ["normal"],
    "placed": ["filled"], "rules": ["placed"],
}


def step(name: str, text: str, *needs: str) -> None:
    STEPS[name] = text
    NEEDS[name] = list(needs)


def using(*names: str) -> str:
    """WITH clause that defines the named steps and all they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({STEPS[n]})" for n in order) + "\n"


# --- question parsing: what the questions were made from, not what the patterns find

FILTER_NAMES = ("field", "dimension", "source", "module", "source_name", "vendor", "operator")
FILTERS = ", ".join(FILTER_NAMES)
FILTER_KEY = "md5(CAST(to_json(struct_pack(" + ", ".join(f"{f} := {f}" for f in FILTER_NAMES) + ")) AS VARCHAR))"
step("parsed", oracle_text(KNOWN))
step("keyed", f"SELECT *, {FILTER_KEY} AS filter_key FROM parsed", "parsed")
step("filters", f"SELECT DISTINCT filter_key, {FILTERS} FROM keyed", "keyed")

# --- matching

WORDS = r"list_distinct(string_split_regex({}, '[_\s]+'))"


def jaccard(a: str, b: str) -> str:
    x, y = WORDS.format(a), WORDS.format(b)
    return f"(len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))))"


def field_case(a: str, b: str, values: list[str]) -> str:
    """CASE over the ten outcomes of a field match, best rule first."""
    likeness = f"(1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})))"
    long_enough = f"length({a}) >= 3 AND length({b}) >= 3"
    tests = [
        f"{a} = {b}",
        f"{a} = replace({b}, '_', ' ') OR {a} = replace({b}, ' ', '_')"
        f" OR replace({a}, '_', ' ') = {b} OR replace({a}, ' ', '_') = {b}",
        f"(starts_with({b}, {a}) AND length({b}) <= length({a}) + 3)"
        f" OR (starts_with({a}, {b}) AND length({a}) <= length({b}) + 3)",
        f"(contains({b}, {a}) AND length({a}) >= 4) OR (contains({a}, {b}) AND length({b}) >= 4)",
        f"{jaccard(a, b)} > 0.7",
        f"{jaccard(a, b)} > 0.5",
        f"{long_enough} AND {likeness} > CAST(0.8 AS DOUBLE)",
        f"{long_enough} AND {likeness} > CAST(0.6 AS DOUBLE)",
    ]
    cases = " ".join(f"WHEN {t} THEN {v}" for t, v in zip(tests, values))
    return f"CASE {cases} ELSE {values[-1]} END"


SCORES = [f"CAST({s} AS DOUBLE)" for s in ("1.0", "0.95", "0.85", "0.7", "0.6", "0.4", "0.5", "0.3", "0.0")]
TYPES = [
    f"'{t}'" for t in (
        "exact", "underscore_space_variation", "prefix", "contains", "word_similarity",
        "partial_word_similarity", "levenshtein_close", "levenshtein_partial", "no_match",
    )
]


def operator_name(stem: str, source_name: str, vendor: str) -> str:
    rest = rf"regexp_replace({stem}, '(?i)^LdRules[_\-\s ]*', '_', 'g')"
    rest = rf"regexp_replace({rest}, '(?i)[_\-\s ]*LdRules$', '_', 'g')"
    rest = rf"regexp_replace({rest}, '(?i)[_\-\s ]*LdRules[_\-\s ]*', '_', 'g')"
    never = ", ".join(f"'{w}'" for w in NOT_OPERATORS)
    keep = " AND ".join(
        f"NOT contains(lower(w), lower({known})) AND NOT contains(lower({known}), lower(w))"
        for known in (source_name, vendor)
    )
    parts = (
        rf"list_filter(string_split_regex({rest}, '[_\-\s ]+'), lambda w: w <> '' AND {keep}"
        rf" AND NOT regexp_full_match(w, '\d+') AND lower(w) NOT IN ({never}))"
    )
    return f"coalesce(nullif(array_to_string({parts}, '_'), ''), 'Unknown')"


def operator_match(wanted: str, found: str) -> str:
    w, f = f"trim(lower({wanted}))", f"trim(lower({found}))"
    return f"({wanted} <> '' AND {found} <> '' AND (contains({w}, {f}) OR contains({f}, {w})))"


step(
    "valid",
    f"""SELECT {FILE}, row_no, dimension, field, {strip('expression')} AS expression FROM rules
        WHERE NOT {has_error('expression')} AND lower({strip('expression')}) NOT IN ('', '-', 'n/a')""",
    "rules",
)
step(
    "expressions",
    f"""SELECT *, file_stem AS filename, {operator_name('file_stem', 'source_name', 'vendor')} AS operator,
        count(*) OVER (PARTITION BY {KEY}) AS valid_count FROM valid""",
    "valid",
)
step(
    "pairs",
    f"""SELECT * FROM (SELECT query, target, {field_case('query', 'target', SCORES)} AS score,
            {field_case('query', 'target', TYPES)} AS match_type
        FROM (SELECT DISTINCT trim(lower(field)) AS query FROM filters WHERE field IS NOT NULL),
             (SELECT DISTINCT trim(lower(field)) AS target FROM expressions)) WHERE score >= 0.4""",
    "filters", "expressions",
)


def passes(*attrs: str) -> str:
    """Predicates of filter f on row e."""
    tests = {
        **{a: f"contains(lower(e.{a}), lower(f.{a}))" for a in ("dimension", "source", "module", "source_name")},
        "vendor": "len(list_filter(string_split_regex(lower(f.vendor), '\\s+or\\s+|\\s+and\\s+'),"
                  " lambda v: contains(lower(e.vendor), trim(v)))) > 0",
        "operator": operator_match("f.operator", "e.operator"),
    }
    return " AND ".join(f"(f.{a} IS NULL OR f.{a} = '' OR {tests[a]})" for a in attrs)


REST = passes("dimension", "source", "module", "source_name", "vendor", "operator")
COLUMNS = "e.source, e.module, e.source_name, e.vendor, e.dimension, e.field, e.expression, e.filename, e.operator"
CONFIDENCE = (
    "(score * CAST(0.7 AS DOUBLE) + least(e.valid_count / 5, CAST(1 AS DOUBLE)) * CAST(0.3 AS DOUBLE))"
)
step(
    "found",
    f"""SELECT f.filter_key, {COLUMNS}, e.row_no, {CONFIDENCE} AS confidence_score,
            score AS field_match_score, match_type AS field_match_type
        FROM filters f JOIN pairs ON trim(lower(f.field)) = query
             JOIN expressions e ON trim(lower(e.field)) = target WHERE {REST}
        UNION ALL
        SELECT f.filter_key, {COLUMNS}, e.row_no, {CONFIDENCE}, score, 'no_filter'
        FROM (SELECT *, CAST(1 AS DOUBLE) AS score FROM filters WHERE field IS NULL) f
             JOIN expressions e ON {REST}""",
    "filters", "expressions", "pairs",
)
RANK_ORDER = f"confidence_score DESC, operator, filename, {KEY}, row_no, expression"
step(
    "ranked",
    f"SELECT *, row_number() OVER (PARTITION BY filter_key ORDER BY {RANK_ORDER}) AS rank FROM found",
    "found",
)
