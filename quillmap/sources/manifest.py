"""Manifest entries kept as one JSON text per file, `<entry_key>.meta`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.schemas import META

META_FILES = "*.meta"


def read_meta_files(spark: SparkSession, folder: str) -> DataFrame:
    texts = spark.read.option("pathGlobFilter", META_FILES).text(folder, wholetext=True)
    return texts.select(F.col("_metadata.file_name").alias("file_name"), "value", F.col("_metadata.file_size").alias("length"))


def parse_meta(texts: DataFrame) -> DataFrame:
    """file_name, value -> entry_key, the entry's fields and whether it could be read.

    An unreadable entry keeps its key and has no fields, so that it can be reported.
    With a column `length`, the bytes that are stored of an entry, the result has
    `entry_bytes` and `load_id` (none) and feeds `manifest_validity`.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    entry = F.from_json("value", META + ", _corrupt string", options)
    key = F.regexp_replace("file_name", r"\.meta$", "")
    readable = F.col("entry").isNotNull() & F.col("entry._corrupt").isNull() & F.col("entry.timestamp").isNotNull()
    names = [part.split()[0] for part in META.split(", ")]
    sized = "length" in texts.columns
    parsed = texts.select(key.alias("entry_key"), entry.alias("entry"), *["length"] * sized)
    stored = [F.when(readable, F.col("length")).alias("entry_bytes"), F.lit(None).cast("string").alias("load_id")]
    return parsed.select(
        *stored * sized,
        "entry_key",
        *[F.when(readable, F.col(f"entry.{n}")).alias(n) for n in names],
        readable.alias("readable"),
    )
