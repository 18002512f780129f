"""Workbook trees: listing the files and decoding them into sheet rows.

Tree: root/<source>/<module>/<source_name>/<vendor>/LdRules/<file>.xlsx
"""

from __future__ import annotations

import re
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.functions.cells import file_stem
from quillmap.schemas import DECODED, FOLDER, WORKBOOK_FILE
from quillmap.sources.xlsx import SheetNotFound, sheet_rows

RULE_FOLDER = "LdRules"  # fixed value: name of the folder that holds the workbooks
WORKBOOK_GLOB = "*.[xX][lL][sS][xX]"
LOCK_PREFIX = "~$"
ROWS_PER_BATCH = 10_000


def read_workbook_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of every rule folder as (path, modificationTime, length, content).

    `content` is read only by plans that use it. A missing root is an error, a
    root without rule folders an empty table.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", WORKBOOK_GLOB)
    try:
        return reader.load(f"{root.rstrip('/')}/*/*/*/*/{RULE_FOLDER}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        reader.load(root)  # raises when the root itself is missing
        return spark.createDataFrame([], WORKBOOK_FILE)


def read_file(path: str) -> bytes:
    """The bytes of a listed file, opened where the task runs."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or "/" in scheme:
        system, place = fs.LocalFileSystem(), re.sub("^/+", "/", rest or path)
    else:
        system, place = fs.FileSystem.from_uri(urllib.parse.quote(path, safe="/:@"))
    with system.open_input_file(place) as opened:
        return opened.read()


def with_folder_levels(files: DataFrame) -> DataFrame:
    """Add the four level names and the file name, all parts of the path."""
    parts = F.split("path", "/")
    levels = [F.element_at(parts, -6 + i).alias(name) for i, name in enumerate(FOLDER)]
    name = F.element_at(parts, -1)
    in_rule_folder = F.element_at(parts, -2) == RULE_FOLDER
    return files.where(in_rule_folder & (F.size(parts) > 6)).select(
        *levels, name.alias("file_name"), file_stem(name).alias("file_stem"), *files.columns
    )


def keep_workbooks(files: DataFrame) -> DataFrame:
    """Drop what is not a workbook, and the lock files of open ones."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.lower(name).endswith(".xlsx") & ~name.startswith(LOCK_PREFIX))


def rule_folders(files: DataFrame) -> DataFrame:
    """One row per rule folder that holds at least one file."""
    folder = F.regexp_replace("path", r"/[^/]*$", "").alias("folder_path")
    return with_folder_levels(files).groupBy(*FOLDER, folder).agg(F.count("*").alias("files"))


def decode_workbooks(files: DataFrame, sheet: int | str = 0, width: int = 4) -> DataFrame:
    """Sheet rows of every workbook, and one row without row_no per workbook for its status.

    status is ok, skipped (no such sheet) or error. A workbook is decoded in full
    before any of its rows leaves the task, so a broken one adds no rows. Its size
    is bounded by the format: 1,048,576 rows, of which `width` cells are kept. The
    entry_key of a file, if it has one, goes with its rows. Without a column `content`
    the files are opened in the tasks; one that cannot be opened is an error of its own.
    """
    cell_type = pa.list_(pa.string())
    schema = pa.schema(
        [("path", pa.string()), ("status", pa.string()), ("error", pa.string()),
         ("row_no", pa.int64()), ("cells", cell_type), ("entry_key", pa.string())]
    )

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(values, type=field.type) for values, field in zip(zip(*rows), schema)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for records in batches:
            names = zip(records.column("path").to_pylist(), records.column("entry_key").to_pylist())
            for i, (path, key) in enumerate(names):
                rows, status, error = [], "ok", None
                try:
                    content = records.column("content")[i].as_py() if given else read_file(path)
                    rows = list(sheet_rows(content, sheet, width))
                except SheetNotFound as e:
                    status, error = "skipped", str(e)
                except Exception as e:  # any defect of the file makes it a reported one
                    status, error = "error", f"{type(e).__name__}: {e}"
                waiting.append((path, status, error, None, None, key))
                for row_no, cells in rows:
                    waiting.append((path, None, None, row_no, cells, key))
                    if len(waiting) >= ROWS_PER_BATCH:
                        yield batch(waiting)
                        waiting = []
        if waiting:
            yield batch(waiting)

    given = "content" in files.columns
    if "entry_key" not in files.columns:
        files = files.withColumn("entry_key", F.lit(None).cast("string"))
    return files.select("path", "entry_key", *["content"] * given).mapInArrow(decode, DECODED)


def sheet_grid(decoded: DataFrame) -> DataFrame:
    rows = decoded.where(F.col("row_no").isNotNull()).select("path", "row_no", "cells", "entry_key")
    return with_folder_levels(rows).select(*FOLDER, "file_stem", *rows.columns)


def file_statuses(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("row_no").isNull()).select("path", "status", "error", "entry_key")
