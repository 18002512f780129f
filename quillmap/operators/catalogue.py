"""The catalogue and its reports.

Lists that the catalogue holds per key have no size limit, so they are kept as
rows in (file_stem, row_no) order or as blocks of bounded length, never as one
value per key. Every aggregate combines before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.schemas import FOLDER, KEY

BLOCK_ROWS = 1_024


def expressions_by_key(rules: DataFrame) -> DataFrame:
    """Expressions of a key in file, then row order, duplicates kept.

    One row per key, file and block of BLOCK_ROWS row numbers, hence at most
    BLOCK_ROWS entries each; (file_stem, block) orders the blocks of a key.
    """
    block = F.floor(F.col("row_no") / BLOCK_ROWS).alias("block")
    entries = F.sort_array(F.collect_list(F.struct("row_no", "expression")))
    return rules.groupBy(*KEY, "file_stem", block).agg(entries.alias("entries"))


def filenames_by_key(rules: DataFrame) -> DataFrame:
    """Unique file names of a key, one per row, with the row they are first seen in."""
    return rules.groupBy(*KEY, "file_stem").agg(F.min("row_no").alias("first_row_no"))


def expression_filenames(rules: DataFrame) -> DataFrame:
    """The file name of every expression; it travels with the row it was read from."""
    return rules.select(*KEY, "file_stem", "row_no", "expression")


def explode_expressions(catalogue: DataFrame) -> DataFrame:
    """Blocks of `expressions_by_key` back to one row per expression."""
    kept = [c for c in catalogue.columns if c != "entries"]
    return catalogue.select(*kept, F.inline("entries"))


def _expressions(rules: DataFrame) -> Column:
    """Of rules, or of their counts per key and file, as the store keeps them."""
    return (F.sum("expressions") if "expressions" in rules.columns else F.count("*")).alias("expressions")


def file_mapping_count(rules: DataFrame, workbooks: DataFrame) -> DataFrame:
    """Distinct keys of every file, 0 for files without any. `rules` may be `store.read_key_counts`."""
    file = [*FOLDER, "file_stem"]
    keys = rules.groupBy(*file, "dimension", "field").agg(_expressions(rules))
    counts = keys.groupBy(*file).agg(
        F.count("*").alias("mapping_count"), F.sum("expressions").alias("expression_count")
    )
    return _filled(workbooks.select(*file).distinct().join(counts, file, "left"))


def folder_mapping_count(rules: DataFrame, folders: DataFrame) -> DataFrame:
    """Distinct keys of every folder, 0 for folders without any. `rules` may be `store.read_key_counts`."""
    keys = rules.groupBy(*KEY).agg(_expressions(rules))
    counts = keys.groupBy(*FOLDER).agg(
        F.count("*").alias("mapping_count"), F.sum("expressions").alias("expression_count")
    )
    return _filled(folders.select(*FOLDER).distinct().join(counts, list(FOLDER), "left"))


def _filled(counts: DataFrame) -> DataFrame:
    return counts.fillna(0, ["mapping_count", "expression_count"])


def catalogue_totals(folder_counts: DataFrame) -> DataFrame:
    return folder_counts.agg(
        F.count("*").alias("folder_count"),
        F.coalesce(F.sum("mapping_count"), F.lit(0)).alias("mapping_count"),
        F.coalesce(F.sum("expression_count"), F.lit(0)).alias("expression_count"),
    )


def top_folders(folder_counts: DataFrame, n: int = 10) -> DataFrame:
    return folder_counts.orderBy(F.desc("mapping_count"), *FOLDER).limit(n)


def sources_listing(folder_counts: DataFrame) -> DataFrame:
    return folder_counts.select(*FOLDER, "mapping_count").orderBy(*FOLDER)


def load_report(rules: DataFrame, workbooks: DataFrame, statuses: DataFrame) -> DataFrame:
    """Files seen, files not read and why, unique keys and folders: one row."""
    folder_counts = folder_mapping_count(rules, workbooks)
    files = workbooks.join(statuses, "path", "left").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("status") == "skipped").alias("files_skipped"),
        F.count_if(F.col("status") == "error").alias("files_failed"),
    )
    # both sides are global aggregates: one row each, every table is read once
    one = F.lit(1).alias("_one")
    totals = catalogue_totals(folder_counts)
    return files.select("*", one).join(totals.select("*", one), "_one").drop("_one")
