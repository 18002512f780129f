"""What must be read again and what may be dropped: plans over manifest entries.

`now` is always given by the caller, so a plan can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.operators.numbering import total_before

# Defaults and limits of the extraction store.
TTL_HOURS = 24
STORE_VERSION = 2
FIRST_VERSION = 1
BUDGET_MB = 500
KEEP_SHARE = 0.8
MEGABYTE = 1024 * 1024
EXTRACTION_DEFAULTS = {
    "left_col": "B", "field_col": "C", "value_col": "D", "sheet": 0, "header_rows_to_skip": 2,
}


def extraction_key(path: Column, length: Column, params: dict | None = None) -> Column:
    """Fingerprint of a file and the way it is read; a file that is gone counts as 0 bytes."""
    chosen = {**EXTRACTION_DEFAULTS, **(params or {})}
    settings = F.struct(*[F.lit(chosen[name]).alias(name) for name in sorted(chosen)])
    parts = F.struct(
        path.alias("file_path"),
        F.coalesce(length, F.lit(0)).cast("bigint").alias("file_size"),
        settings.alias("params"),
    )
    return F.md5(F.to_json(parts, {"ignoreNullFields": "false"}))


def latest_entries(manifest: DataFrame) -> DataFrame:
    """The newest entry of every key: a file read twice leaves two."""
    others = [c for c in manifest.columns if c not in ("entry_key", "timestamp")]
    newest = F.max(F.struct("timestamp", *others)).alias("entry")
    return manifest.groupBy("entry_key").agg(newest).select("entry_key", "entry.*")


def manifest_validity(
    workbooks: DataFrame, manifest: DataFrame, now: float, ttl_hours: float = TTL_HOURS
) -> DataFrame:
    """`reason` per workbook: missing, expired, modified, old_version or valid.

    workbooks: entry_key, path, mtime (epoch seconds). An entry without its data
    or its times is as good as missing.
    """
    entries = latest_entries(manifest).select(
        "entry_key", "timestamp", "file_mtime", "cache_version", "entry_bytes", "load_id"
    )
    age_hours = (F.lit(float(now)) - F.col("timestamp")) / 3600
    unusable = F.col("timestamp").isNull() | F.col("file_mtime").isNull() | F.col("entry_bytes").isNull()
    reason = (
        F.when(unusable, "missing")
        .when(age_hours > ttl_hours, "expired")
        .when(F.coalesce(F.col("mtime") > F.col("file_mtime"), F.lit(False)), "modified")
        .when(F.coalesce("cache_version", F.lit(FIRST_VERSION)) < STORE_VERSION, "old_version")
        .otherwise("valid")
    )
    joined = workbooks.join(entries, "entry_key", "left")
    return joined.select(*workbooks.columns, "load_id", reason.alias("reason"))


def files_to_extract(workbooks: DataFrame, validity: DataFrame) -> DataFrame:
    valid = validity.where(F.col("reason") == "valid").select("entry_key")
    return workbooks.join(valid, "entry_key", "left_anti")


def expired_entries(manifest: DataFrame, now: float, ttl_hours: float = TTL_HOURS) -> DataFrame:
    age_seconds = F.lit(float(now)) - F.col("timestamp")
    return manifest.where(age_seconds > ttl_hours * 3600)


def store_size(stored: DataFrame) -> DataFrame:
    """Bytes of all stored files; `length` as listed by the binaryFile source."""
    return stored.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("store_bytes"))


def retention_plan(
    manifest: DataFrame, stored: DataFrame, budget_mb: float = BUDGET_MB, start: float = 1.0
) -> DataFrame:
    """Entries with `dropped`: the oldest go until the store fits 80 % of the budget.

    Nothing goes while the store fits `start` of the budget.

    Only entries that still have their data can go; files without an entry count
    towards the size and stay.
    """
    budget = budget_mb * MEGABYTE
    total = store_size(stored).scalar()
    entries = manifest.where(F.col("entry_bytes").isNotNull())
    ranked = total_before(entries, ["timestamp", "entry_key"], "entry_bytes", "older_bytes")
    over = F.col("store_bytes") > F.lit(float(budget) * start)
    still_over = F.col("store_bytes") - F.col("older_bytes") > F.lit(budget * KEEP_SHARE)
    return ranked.withColumn("store_bytes", total).withColumn("dropped", over & still_over)


def ingest_stats(validity: DataFrame, statuses: DataFrame, stored: DataFrame) -> DataFrame:
    """Hits, misses, files read, errors, hit rate in percent and store size: one row."""
    hits = F.count_if(F.col("reason") == "valid")
    rate = F.coalesce(F.round(100 * hits / F.nullif(F.count("*"), F.lit(0)), 2), F.lit(0.0))
    outcome = statuses.agg(
        F.count_if(F.col("status") == "ok").alias("files_processed"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )
    size = store_size(stored).select(F.round(F.col("store_bytes") / MEGABYTE, 2).alias("store_mb"))
    found = validity.agg(
        hits.alias("hits"),
        F.count_if(F.col("reason") != "valid").alias("misses"),
        rate.alias("hit_rate_percent"),
    )
    # global aggregates: one row each, every table is read once
    one = F.lit(1).alias("_one")
    joined = found.select("*", one).join(outcome.select("*", one), "_one").join(size.select("*", one), "_one")
    return joined.drop("_one")
