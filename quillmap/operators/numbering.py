"""Row numbers and running totals that no single task has to compute for a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmap.session import materialise


#: Groups are counted by so many buckets, and numbered in one task each while a bucket has at most TOGETHER rows.
BUCKETS = 1 << 16
TOGETHER = 1 << 18


def number_rows(
    df: DataFrame, keys: Sequence[str], lead: str, ties: Sequence[str], width: int, name: str, together: int = TOGETHER
) -> DataFrame:
    """1-based row number within `keys`, ordered by `lead`, then `ties`; rows without a key or a lead are left out.

    A group that may have more than `together` rows is cut into ranges of `width` values
    of the integer column `lead`; each range is numbered by itself and starts after the
    rows of the ranges before it, so that a group of any size spreads over many tasks.
    Which groups may is told by counts of buckets of keys, which hardly shuffle anything.
    """
    known = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, lead)))
    # a number leads the sort, so that few rows are told apart by texts
    known = known.withColumn("_group", F.xxhash64(*keys))
    bucket = F.pmod("_group", F.lit(BUCKETS))
    counts = known.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_rows"))
    large = [r["_bucket"] for r in counts.where(F.col("_rows") > together).select("_bucket").collect()]
    if not large:
        within = Window.partitionBy("_group", *keys).orderBy(lead, *ties)
        return known.withColumn(name, F.row_number().over(within).cast("bigint")).drop("_group")
    in_large = bucket.isin(large)
    cut = known.withColumn("_range", F.when(in_large, F.floor(F.col(lead) / width)).otherwise(0))
    sizes = cut.where(in_large).groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_range", F.sum("_rows").over(earlier).alias("_start")).where("_start > 0")
    within = Window.partitionBy(*keys, "_range").orderBy(lead, *ties)
    # numbered first: the rows are then already sorted for the join
    return (
        cut.withColumn("_place", F.row_number().over(within))
        .join(starts, [*keys, "_range"], "left")
        .withColumn(name, F.col("_place") + F.coalesce("_start", F.lit(0)).cast("bigint"))
        .drop("_group", "_range", "_start", "_place")
    )


def total_before(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of `value` over all rows that precede a row in the total order `order`.

    Rows are range-partitioned into slices; only one sum per slice meets in one
    task. The slices are written out, since range bounds are sampled anew whenever
    a plan runs again.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialise(
        df.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id())
    )
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy("_slice")
        .agg(F.sum(value).alias("_sum"))
        .select("_slice", F.sum("_sum").over(earlier).alias("_start"))
    )
    within = (
        Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    before: Column = F.coalesce("_start", F.lit(0)) + F.coalesce(
        F.sum(value).over(within), F.lit(0)
    )
    # one row per slice: the number of slices bounds what is broadcast
    return cut.join(F.broadcast(starts), "_slice").withColumn(name, before).drop("_slice", "_start")
