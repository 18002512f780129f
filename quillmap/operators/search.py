"""Search: which expressions answer which filters, how well, and in what order.

Results are keyed by `filter_key`. Questions that ask for the same thing share
one, so the same answer is neither computed nor stored once per question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmap.functions.cells import is_valid_expression, strip
from quillmap.functions.matching import confidence, operator_from_filename
from quillmap.functions.questions import FILTERS
from quillmap.operators.match import match_things
from quillmap.operators.questions import distinct_filters
from quillmap.schemas import FOLDER, KEY
from quillmap.session import materialise

SHOWN = 50  # fixed value: results shown per question
HIGH_CONFIDENCE = 0.7  # fixed value: shown results from here on count as sure
#: A group of more expressions does not carry them through the search.
HELD = 64
GROUP = (*KEY, "operator")
RESULT = (
    *FOLDER, "dimension", "field", "expression", "filename", "operator",
    "confidence_score", "field_match_score", "field_match_type",
)


def rank_order() -> list[Column]:
    """By confidence, operator and file; the rest makes the order total."""
    return [F.desc("confidence_score"), *map(F.col, ("operator", "filename", *KEY, "row_no", "expression"))]


def valid_expressions(rules: DataFrame) -> DataFrame:
    return rules.where(is_valid_expression(F.col("expression"))).withColumn(
        "expression", strip(F.col("expression"))
    )


def with_operator(rows: DataFrame) -> DataFrame:
    """Rules of the store know their operator; others get it from the file name."""
    if "operator" in rows.columns:
        return rows
    operator = operator_from_filename(F.col("file_stem"), F.col("source_name"), F.col("vendor"))
    return rows.withColumn("operator", operator)


def key_groups(rules: DataFrame) -> DataFrame:
    """What the search needs to know of all valid expressions of a key and operator.

    expressions: how many; valid_count: how many the whole key has; first: the
    (filename, row_no) that stands first. Rows are combined before they are
    shuffled, so that a key of any size arrives as one row per task and operator.
    """
    groups = (
        with_operator(valid_expressions(rules))
        .groupBy(*GROUP)
        .agg(
            F.count("*").alias("expressions"),
            F.min(F.struct(F.col("file_stem").alias("filename"), "row_no")).alias("first"),
        )
    )
    of_key = Window.partitionBy(*KEY)
    # a fixed number of partitions: matching is more work than the size of the groups tells
    partitions = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = groups.repartition(partitions, *KEY)
    return spread.withColumn("valid_count", F.sum("expressions").over(of_key))


def match_groups(filters: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups that answer a filter, with score and confidence."""
    matched = match_things(filters, groups, FILTERS)
    return matched.select(
        "filter_key",
        *groups.columns,
        F.col("match.score").alias("field_match_score"),
        F.col("match.match_type").alias("field_match_type"),
        confidence(F.col("match.score"), F.col("valid_count")).alias("confidence_score"),
    )


def with_entries(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """Add `entries`, the expressions of a group that has at most HELD of them."""
    small = groups.where(F.col("expressions") <= HELD).select(*GROUP)
    entry = F.struct(F.col("file_stem").alias("filename"), "row_no", "expression").alias("entry")
    rows = with_operator(valid_expressions(rules)).select(*GROUP, entry)
    held = rows.join(small, list(GROUP), "left_semi").groupBy(*GROUP).agg(F.collect_list("entry").alias("entries"))
    return groups.join(held, list(GROUP), "left")


def search(questions: DataFrame, rules: DataFrame, entries: bool = False) -> DataFrame:
    """Matched groups for a table of parsed questions; see `results`, `top_results`, `result_summary`.

    With `entries` the groups carry theirs, so that `results` need not join matches with rules.
    """
    groups = materialise(key_groups(rules))
    if entries:
        groups = materialise(with_entries(groups, rules))
    return match_groups(materialise(distinct_filters(questions)), groups)


def results(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """All results, one row per filter and expression."""
    columns = ("filter_key", *GROUP, "confidence_score", "field_match_score", "field_match_type")
    rows = with_operator(valid_expressions(rules)).withColumnRenamed("file_stem", "filename")
    rows = rows.select(*GROUP, "filename", "row_no", "expression")
    if "entries" not in matches.columns:
        return matches.select(*columns).join(rows, list(GROUP)).select("filter_key", *RESULT, "row_no")
    carried = matches.where(F.col("expressions") <= HELD).select(*columns, F.inline("entries"))
    # each match of a group that is not carried is more than HELD results
    large = matches.where(F.col("expressions") > HELD).select(*columns).join(rows, list(GROUP))
    return carried.select("filter_key", *RESULT, "row_no").unionByName(large.select("filter_key", *RESULT, "row_no"))


def rank_results(found: DataFrame) -> DataFrame:
    """All results in order. The sort is by ranges, so one filter may span many tasks."""
    return found.orderBy("filter_key", *rank_order())


def top_results(matches: DataFrame, rules: DataFrame, n: int = SHOWN) -> DataFrame:
    """The first n results of every filter, numbered from 1.

    A group of which not even the first row is among the first n first rows of a
    filter cannot contribute, and neither can any but its first n rows. Both limits
    are applied before expressions are joined, and before rows are shuffled.
    """
    by_first = Window.partitionBy("filter_key").orderBy(
        F.desc("confidence_score"), "operator", "first.filename", *KEY, "first.row_no"
    )
    leading = materialise(
        matches.withColumn("place", F.row_number().over(by_first))
        .where(F.col("place") <= n)
        .select("filter_key", *GROUP, "confidence_score", "field_match_score", "field_match_type")
    )
    in_group = Window.partitionBy(*GROUP).orderBy("filename", "row_no")
    rows = with_operator(valid_expressions(rules)).withColumnRenamed("file_stem", "filename")
    heads = (
        rows.join(leading.select(*GROUP).distinct(), list(GROUP), "left_semi")
        .select(*GROUP, "filename", "row_no", "expression")
        .withColumn("place", F.row_number().over(in_group))
        .where(F.col("place") <= n)
        .drop("place")
    )
    by_rank = Window.partitionBy("filter_key").orderBy(*rank_order())
    ranked = leading.join(heads, list(GROUP)).withColumn("rank", F.row_number().over(by_rank))
    return ranked.where(F.col("rank") <= n).select("filter_key", "rank", *RESULT, "row_no")


def result_summary(filters: DataFrame, matches: DataFrame, n: int = SHOWN) -> DataFrame:
    """Per filter: hits, how many are shown, their mean confidence, how many of them are sure.

    A confidence is one of seven scores combined with one of five shares, so a
    filter has at most 40 different ones: the window sees counts, not results.
    """
    counts = matches.groupBy("filter_key", "confidence_score").agg(F.sum("expressions").alias("hits"))
    return summary_of_counts(filters, counts, n)


def summary_of_counts(filters: DataFrame, counts: DataFrame, n: int = SHOWN) -> DataFrame:
    """The same from filter_key, confidence_score and hits, one row for each confidence."""
    better = (
        Window.partitionBy("filter_key")
        .orderBy(F.desc("confidence_score"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    room = F.greatest(F.lit(0), F.lit(n) - F.coalesce(F.sum("hits").over(better), F.lit(0)))
    shown = counts.withColumn("shown", F.least("hits", room))
    sure = F.when(F.col("confidence_score") >= HIGH_CONFIDENCE, F.col("shown")).otherwise(0)
    summary = shown.groupBy("filter_key").agg(
        F.sum("hits").alias("total"),
        F.sum("shown").alias("shown"),
        (F.sum(F.col("confidence_score") * F.col("shown")) / F.sum("shown")).alias("mean_confidence"),
        F.sum(sure).alias("high_confidence"),
    )
    return (
        filters.select("filter_key")
        .join(summary, "filter_key", "left")
        .fillna(0, ["total", "shown", "high_confidence"])
    )
