"""Sheet rows to rules: skip headers, pick three columns, clean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.functions.cells import (
    cell_at,
    column_index,
    has_error_text,
    is_blank,
    is_placeholder,
    normalise_cell,
)

PARTS = ("dimension", "field", "expression")


def skip_header_rows(grid: DataFrame, header_rows: int = 2) -> DataFrame:
    return grid.where(F.col("row_no") > header_rows)


def pick_columns(
    grid: DataFrame, left: str | int = "B", field: str | int = "C", value: str | int = "D"
) -> DataFrame:
    """The three wanted cells; rows too short to hold them all are dropped."""
    wanted = [column_index(c) for c in (left, field, value)]
    cells = [cell_at(F.col("cells"), i).alias(part) for i, part in zip(wanted, PARTS)]
    kept = [c for c in grid.columns if c != "cells"]
    return grid.where(F.size("cells") >= max(wanted)).select(*kept, *cells)


def normalise_parts(rows: DataFrame) -> DataFrame:
    kept = [c for c in rows.columns if c not in PARTS]
    parts = F.struct(*[normalise_cell(F.col(part)).alias(part) for part in PARTS])
    # a list of one: normalised once, not again in every filter that reads them
    return rows.select(*kept, F.inline(F.array(parts)))


def drop_blank_rows(rows: DataFrame) -> DataFrame:
    return rows.where(~(is_blank(F.col("dimension")) | is_blank(F.col("field")) | is_blank(F.col("expression"))))


def drop_placeholders(rows: DataFrame) -> DataFrame:
    return rows.where(~is_placeholder(F.col("expression")))


def drop_error_cells(rows: DataFrame) -> DataFrame:
    return rows.where(~has_error_text(F.col("expression")))


def extract_rules(
    grid: DataFrame,
    left: str | int = "B",
    field: str | int = "C",
    value: str | int = "D",
    header_rows: int = 2,
) -> DataFrame:
    rows = normalise_parts(pick_columns(skip_header_rows(grid, header_rows), left, field, value))
    return drop_error_cells(drop_placeholders(drop_blank_rows(rows)))
