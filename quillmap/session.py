"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "16g",
        "spark.sql.adaptive.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("quillmap")
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only in local mode without a setting."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="quillmap-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def new_shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a result once to the shared folder and go on from there.

    For results that several branches of a plan read: they are computed once, and
    a lost executor costs a re-read, not a re-computation.
    """
    return materialise_at(df, new_shared_path(df.sparkSession, "table"))


def materialise_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """`df` for a join that broadcasts neither side, whatever size Spark expects.

    Spark takes exploded rows to be as large as what they come from, and a stored table to be as
    large as its compressed file; a table of names then fits a broadcast whose grams do not.
    """
    return df.hint("merge")


def remove_shared(spark: SparkSession, path: str) -> None:
    """Delete a table that `materialise_at` wrote, once nothing reads it any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
