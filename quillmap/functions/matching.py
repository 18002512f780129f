"""Column functions that compare field names and operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmap.functions.cells import strip

# Score and name of every way two field names can match.
EXACT = (1.0, "exact")
SEPARATOR_VARIANT = (0.95, "underscore_space_variation")
PREFIX = (0.85, "prefix")
CONTAINS = (0.7, "contains")
SAME_WORDS = (0.6, "word_similarity")
MOST_WORDS = (0.4, "partial_word_similarity")
CLOSE_SPELLING = (0.5, "levenshtein_close")
NEAR_SPELLING = (0.3, "levenshtein_partial")
NO_MATCH = (0.0, "no_match")
NO_FILTER = (1.0, "no_filter")
KEEP_SCORE = 0.4
FIELD_WEIGHT = 0.7
QUALITY_WEIGHT = 0.3
FULL_QUALITY_COUNT = 5
HIGH_BAND = 0.8
MEDIUM_BAND = 0.6
UNKNOWN = "Unknown"

# File name parts that never name an operator.
NOT_OPERATORS = (
    "ldrules", "ld", "rules", "mapping", "mappings", "template",
    "v1", "v2", "v3", "final", "new", "old", "copy",
)
# Where the folder word stands in a file name, tried in this order.
FOLDER_WORD_PATTERNS = (
    r"(?U)(?i)^LdRules[_\-\s]*",
    r"(?U)(?i)[_\-\s]*LdRules$",
    r"(?U)(?i)[_\-\s]*LdRules[_\-\s]*",
)


def normalise_name(name: Column) -> Column:
    return strip(F.lower(name))


def name_words(name: Column) -> Column:
    """Distinct words of a normalised name; a leading or trailing separator adds the empty word."""
    return F.array_distinct(F.split(name, r"(?U)[_\s]+"))


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = name_words(a), name_words(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def _labelled(rule: tuple[float, str]) -> Column:
    return F.struct(F.lit(rule[0]).alias("score"), F.lit(rule[1]).alias("match_type"))


def field_match(query: Column, target: Column) -> Column:
    """STRUCT<score, match_type> for two names that went through `normalise_name`.

    The cheap tests stand first and CASE stops at the first that holds, so the
    edit distance is computed only for names of similar length that share little else.
    """
    len_q, len_t = F.length(query), F.length(target)
    longer = F.greatest(len_q, len_t)
    blanks = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    lines = lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    variant = (
        (query == blanks(target)) | (query == lines(target))
        | (blanks(query) == target) | (lines(query) == target)
    )
    prefix = (target.startswith(query) & (len_t <= len_q + 3)) | (
        query.startswith(target) & (len_q <= len_t + 3)
    )
    inside = (target.contains(query) & (len_q >= 4)) | (query.contains(target) & (len_t >= 4))
    jaccard = word_jaccard(query, target)
    likeness = F.lit(1.0) - F.levenshtein(query, target) / longer
    # the length gap is a lower bound of the distance
    hopeless = (len_q < 3) | (len_t < 3) | (F.lit(1.0) - F.abs(len_q - len_t) / longer <= 0.6)
    return (
        F.when(query == target, _labelled(EXACT))
        .when(variant, _labelled(SEPARATOR_VARIANT))
        .when(prefix, _labelled(PREFIX))
        .when(inside, _labelled(CONTAINS))
        .when(jaccard > 0.7, _labelled(SAME_WORDS))
        .when(jaccard > 0.5, _labelled(MOST_WORDS))
        .when(hopeless, _labelled(NO_MATCH))
        .when(likeness > 0.8, _labelled(CLOSE_SPELLING))
        .when(likeness > 0.6, _labelled(NEAR_SPELLING))
        .otherwise(_labelled(NO_MATCH))
    )


def operator_from_filename(stem: Column, source_name: Column, vendor: Column) -> Column:
    """What a file name says beyond the folder word, the source name, the vendor and numbers."""
    rest = reduce(lambda text, p: F.regexp_replace(text, p, "_"), FOLDER_WORD_PATTERNS, stem)
    known = [F.lower(source_name), F.lower(vendor)]

    def names_operator(part: Column) -> Column:
        word = F.lower(part)
        keep = (word != "") & ~word.rlike(r"^\p{Nd}+$") & ~word.isin(*NOT_OPERATORS)
        for name in known:
            keep = keep & ~word.contains(name) & ~name.contains(word)
        return keep

    operator = F.concat_ws("_", F.filter(F.split(rest, r"(?U)[_\-\s]+"), names_operator))
    return F.when(operator == "", F.lit(UNKNOWN)).otherwise(F.coalesce(operator, F.lit(UNKNOWN)))


def operator_matches(wanted: Column, operator: Column) -> Column:
    w, o = normalise_name(wanted), normalise_name(operator)
    named = (F.coalesce(wanted, F.lit("")) != "") & (F.coalesce(operator, F.lit("")) != "")
    return F.coalesce(named & (w.contains(o) | o.contains(w)), F.lit(False))


def confidence(field_score: Column, valid_count: Column) -> Column:
    quality = F.least(valid_count / FULL_QUALITY_COUNT, F.lit(1.0))
    return field_score * FIELD_WEIGHT + quality * QUALITY_WEIGHT


def confidence_band(score: Column) -> Column:
    return F.when(score >= HIGH_BAND, "HIGH").when(score >= MEDIUM_BAND, "MED").otherwise("LOW")


def percent(score: Column) -> Column:
    return F.format_string("%.1f%%", score * 100)


def match_label(match_type: Column) -> Column:
    return F.initcap(F.replace(match_type, F.lit("_"), F.lit(" ")))
