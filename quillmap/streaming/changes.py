"""Incremental ingest of workbooks that change in place.

Spark's file source remembers paths, so that a path passes once. Here a listing of the
whole tree is the stream, and keyed state holds what was last seen of each path. A checkpoint
whose state has a row a path cannot be continued: start with a new one, which lists all anew.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmap.session import materialise
from quillmap.sources.store import Extraction, keyed_workbooks, store_workbooks
from quillmap.sources.workbooks import decode_workbooks

_SEEN = "micros bigint, length bigint"
#: Paths are dealt to so many groups; a group's state is one row, and one call compares all its paths.
GROUPS = 4_096
_STATE = "paths array<string>, micros array<bigint>, lengths array<bigint>"


def changed_files(listing: DataFrame) -> DataFrame:
    """(path, modificationTime, length) of the files that are new or differ from when they were last listed.

    listing: a stream of path, modificationTime, length. The state is one time and length a
    path, kept in lists by group of paths; a file differs if either does, also if it became older. Of several rows of a
    path in one batch the one of the latest time counts, of these the longest. Rows without
    a path pass nothing; a missing time or length is a value like others.
    """

    def newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple[int, int]] = {}
        for frame in frames:
            for path, *found in zip(frame["path"].tolist(), frame["micros"].tolist(), frame["length"].tolist()):
                best[path] = max(best.get(path, (-2, -2)), tuple(found))
        paths, *values = state.get if state.exists else ([], [], [])
        seen = dict(zip(paths, zip(*values)))
        changed = {path: found for path, found in best.items() if seen.get(path) != found}
        if changed:
            seen |= changed
            state.update((list(seen), [m for m, _ in seen.values()], [n for _, n in seen.values()]))
            yield pd.DataFrame({"path": list(changed), "micros": [m for m, _ in changed.values()], "length": [n for _, n in changed.values()]})

    # -1 stands for a time or length that is missing
    rows = listing.where("path IS NOT NULL").select(
        "path",
        F.coalesce(F.unix_micros("modificationTime"), F.lit(-1)).alias("micros"),
        F.coalesce("length", F.lit(-1)).cast("bigint").alias("length"),
    )
    grouped = rows.withColumn("group", F.pmod(F.xxhash64("path"), F.lit(GROUPS)).cast("int"))
    passed = grouped.groupBy("group").applyInPandasWithState(
        newest, f"path string, {_SEEN}", _STATE, "append", GroupStateTimeout.NoTimeout
    )
    return passed.select(
        "path",
        F.when(F.col("micros") != -1, F.timestamp_micros("micros")).alias("modificationTime"),
        F.when(F.col("length") != -1, F.col("length")).alias("length"),
    )


def stream_changed_workbooks(
    files: DataFrame,
    store: str,
    checkpoint: str,
    extraction: Extraction = Extraction(),
    stream: str = "changes",
    clock: Callable[[], float] = time.time,
) -> StreamingQuery:
    """Bring all workbooks that came or changed since the last run into the store, then stop.

    files: a stream of listings, such as `tree_files(tree_stream(spark, root))`. Tasks open the
    files that changed and no others. Every batch is one load of the store, named by `stream`
    and its number, and replaces itself when it is repeated. A workbook that could not be read
    has a status and is read again once it changes.
    """

    def write(batch: DataFrame, number: int) -> None:
        listing = materialise(keyed_workbooks(batch, extraction).select("path", "entry_key", "mtime"))
        partitions = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        todo = listing.select("path", "entry_key").repartition(partitions, "path")
        decoded = decode_workbooks(todo, extraction.sheet, extraction.width())
        store_workbooks(listing, decoded, extraction, store, clock(), f"{stream}-{number}")

    return (
        changed_files(files)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
