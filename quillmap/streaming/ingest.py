"""Incremental ingest of newly arrived workbooks as a stream."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmap.schemas import WORKBOOK_FILE
from quillmap.session import materialise
from quillmap.sources.store import Extraction, keyed_workbooks, store_workbooks
from quillmap.sources.workbooks import RULE_FOLDER, WORKBOOK_GLOB, decode_workbooks


def workbook_stream(spark: SparkSession, root: str) -> DataFrame:
    """Workbooks below `root` as they arrive. The source remembers paths, so a
    workbook that changes in place is found by `manifest_validity`, not here."""
    return (
        spark.readStream.format("binaryFile")
        .schema(WORKBOOK_FILE)
        .option("pathGlobFilter", WORKBOOK_GLOB)
        .load(f"{root.rstrip('/')}/*/*/*/*/{RULE_FOLDER}")
    )


def stream_new_workbooks(
    files: DataFrame,
    store: str,
    checkpoint: str,
    extraction: Extraction = Extraction(),
    stream: str = "stream",
    clock: Callable[[], float] = time.time,
) -> StreamingQuery:
    """Bring all workbooks that arrived since the last run into the store, then stop.

    Every batch is one load of the store, named by `stream` and its number: rules, manifest
    entries and the status of every workbook, the broken ones included. A batch that is
    repeated after a failure replaces what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        keyed = keyed_workbooks(batch, extraction)
        listing = materialise(keyed.select("path", "entry_key", F.col("mtime")))
        decoded = decode_workbooks(keyed.select("path", "entry_key", "content"), extraction.sheet, extraction.width())
        store_workbooks(listing, decoded, extraction, store, clock(), f"{stream}-{number}")

    return (
        files.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
