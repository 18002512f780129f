"""Questions to filters, as column jobs over a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.functions.questions import FILTERS, PARSERS, message_kind


def latest_message(conversations: DataFrame) -> DataFrame:
    """The last turn of every conversation as its question; empty unless the user said it."""
    last = F.max(F.struct("turn", "role", "text")).alias("last")
    text = F.when(F.col("last.role") == "user", F.col("last.text")).otherwise("")
    return (
        conversations.groupBy("conv_id")
        .agg(last)
        .select("conv_id", F.col("last.turn").alias("turn"), F.coalesce(text, F.lit("")).alias("text"))
    )


def search_questions(questions: DataFrame) -> DataFrame:
    """Only messages that are neither empty nor commands are parsed."""
    return questions.where(message_kind(F.col("text")) == "search")


def parse_questions(questions: DataFrame) -> DataFrame:
    filters = [PARSERS[name](F.col("text")).alias(name) for name in FILTERS]
    return questions.select("question_id", *filters)


def with_filter_key(filters: DataFrame) -> DataFrame:
    """Questions that ask for the same share one key, and are searched once."""
    values = F.to_json(F.struct(*FILTERS), {"ignoreNullFields": "false"})
    return filters.withColumn("filter_key", F.md5(values))


def distinct_filters(filters: DataFrame) -> DataFrame:
    keyed = filters if "filter_key" in filters.columns else with_filter_key(filters)
    return keyed.select("filter_key", *FILTERS).distinct()
