"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.operators.numbering import total_before
from quillmap.session import materialise

#: A word is a run of anything but these bytes; `bytes.split()` splits at just these.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of texts in an Arrow batch: its buffers exist twice on either side of the pipe.
ROWS_AT_ONCE = 1_000
#: Bytes of text that a task works on at once; longer texts come alone.
TEXT_AT_ONCE = 4_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text, as two longs; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("key_a"), F.xxhash64(F.lit(1), text).alias("key_b")]


KEY = ["key_a", "key_b"]


def portions(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that their texts hold about TEXT_AT_ONCE bytes, or one row."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch[text]), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > TEXT_AT_ONCE:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if len(sizes) > start:
            yield batch.slice(start)


def small_batches(df: DataFrame) -> DataFrame:
    """Have the session pass rows to Python in batches that fit texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))
    return df


def map_portions(
    df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, text: str = "text"
) -> DataFrame:
    """`work()` is called once a task and gives the function from portion to output batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for portion in portions(batches, text):
            yield each(portion)

    return small_batches(df).mapInArrow(run, schema)


def bounded_blocks(rows: DataFrame, bound: int) -> list[DataFrame]:
    """`rows` (item, bytes, ...) cut by items into parts that hold at most `bound` bytes and one item.

    Parts are small enough to be collected and sent to tasks.
    """
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()["bytes"]
    if total <= bound:
        return [rows]
    sizes = total_before(rows.groupBy("item").agg(F.sum("bytes").alias("bytes")), ["item"], "bytes", "before")
    placed = materialise(rows.join(sizes.select("item", F.floor(F.col("before") / bound).alias("block")), "item"))
    used = sorted(r["block"] for r in placed.select("block").distinct().collect())
    return [placed.where(F.col("block") == b) for b in used]
