"""Compaction of the extraction store: dropped entries free their bytes.

Entries of a load share its files, so that leaving one out frees nothing as long as others
of its load are used. The surviving entries of partly dead loads are packed into new loads,
oldest first and about `pack_bytes` in each, and the old loads are removed. Later plans
drop the oldest entries first, which then lie together.

New loads are written before old ones go, rules before entries; old entries go before their
rules. An interruption leaves entries twice, with the same rows, or rules that nothing
reads; both go the next time. A packed entry keeps its times, so that it expires as before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.operators.manifest import BUDGET_MB, KEEP_SHARE, MEGABYTE, latest_entries, retention_plan, store_size
from quillmap.operators.numbering import total_before
from quillmap.schemas import MANIFEST, RULES
from quillmap.session import materialise, remove_shared
from quillmap.sources.store import last_statuses, read_key_counts, read_manifest_table, stored_files, write_load

PACK_BYTES = 128 * MEGABYTE
ENTRIES = MANIFEST.replace("entry_bytes", "text_bytes")


def entry_fates(manifest: DataFrame, dropped: DataFrame) -> DataFrame:
    """The entries with `lives`: the newest of their key, and not of the dropped entry_keys.

    An older entry of a dropped key dies too: it must not come back as the newest.
    """
    newest = latest_entries(manifest).select("entry_key", "load_id", F.lit(True).alias("newest"))
    gone = dropped.select("entry_key", F.lit(True).alias("gone")).distinct()
    told = manifest.join(newest, ["entry_key", "load_id"], "left").join(gone, "entry_key", "left")
    return told.withColumn("lives", F.col("newest").isNotNull() & F.col("gone").isNull()).drop("newest", "gone")


def load_fates(fates: DataFrame) -> DataFrame:
    """load_id, entries, living, fate: `keep` (all live), `remove` (none does) or `pack`."""
    counts = fates.groupBy("load_id").agg(F.count("*").alias("entries"), F.count_if("lives").alias("living"))
    fate = F.when(F.col("living") == F.col("entries"), "keep").when(F.col("living") == 0, "remove").otherwise("pack")
    return counts.withColumn("fate", fate)


def packing_plan(fates: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """entry_key, load_id, pack: the living entries of loads to pack, numbered by new load.

    fates: `entry_fates` of entries with entry_bytes. A new load holds entries of about
    pack_bytes, in the order of their times; an entry is never split.
    """
    partly = load_fates(fates).where("fate = 'pack'").select("load_id")
    moving = fates.where("lives").join(partly, "load_id").withColumn("moved", F.coalesce("entry_bytes", F.lit(0)))
    placed = total_before(moving.select("entry_key", "load_id", "timestamp", "moved"), ["timestamp", "entry_key"], "moved", "before")
    return placed.select("entry_key", "load_id", F.floor(F.col("before") / pack_bytes).alias("pack"))


def compact(spark: SparkSession, store: str, dropped: DataFrame | None = None, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Rewrite partly dead loads and remove dead ones; returns load_id, entries, living, fate.

    dropped: entry_keys to leave out, none by default. Loads whose last status of some path
    is the newest keep their statuses.
    """
    root = store.rstrip("/")
    none = spark.createDataFrame([], "entry_key string")
    manifest = materialise(read_manifest_table(spark, store))
    fates = materialise(entry_fates(manifest, none if dropped is None else dropped))
    loads = materialise(load_fates(fates))
    name = uuid.uuid4().hex
    plan = materialise(packing_plan(fates, pack_bytes).withColumn("new_load", F.format_string(f"{name}-%06d", F.col("pack"))).drop("pack"))
    if not plan.isEmpty():
        moved = plan.select("load_id", "entry_key", "new_load")
        rules = spark.read.schema(RULES).parquet(f"{root}/rules").join(moved, ["load_id", "entry_key"])
        rules = rules.drop("load_id").withColumnRenamed("new_load", "load_id")
        write_load(rules.hint("rebalance", "load_id", "source", "module"), f"{root}/rules", "source", "module")
        keys = read_key_counts(spark, store).join(moved, ["load_id", "entry_key"])
        write_load(keys.drop("load_id").withColumnRenamed("new_load", "load_id").hint("rebalance", "load_id"), f"{root}/keys")
        entries = spark.read.schema(ENTRIES).parquet(f"{root}/manifest").join(moved, ["load_id", "entry_key"])
        columns = [part.split()[0] for part in ENTRIES.split(", ")]
        write_load(entries.drop("load_id").withColumnRenamed("new_load", "load_id").select(*columns), f"{root}/manifest")
    _remove_loads(spark, store, loads.where("fate <> 'keep'"))
    return loads


def _remove_loads(spark: SparkSession, store: str, loads: DataFrame) -> None:
    """Delete the loads' entries, then their rules, and statuses that newer ones replaced."""
    root = store.rstrip("/")
    spoken = last_statuses(spark, store).select("load_id").distinct().withColumn("spoken", F.lit(True))
    gone = loads.select("load_id").join(spoken, "load_id", "left").collect()  # one row a load, as in a listing of folders
    for table in ("manifest", "keys", "rules"):
        for row in gone:
            remove_shared(spark, f"{root}/{table}/load_id={row['load_id']}")
    for row in gone:
        if row["spoken"] is None:
            remove_shared(spark, f"{root}/statuses/load_id={row['load_id']}")


def enforce_budget(spark: SparkSession, store: str, budget_mb: float = BUDGET_MB, pack_bytes: int = PACK_BYTES) -> list[DataFrame]:
    """Bring a store that exceeds its budget to KEEP_SHARE of it, dropping the oldest entries.

    Returns the fates of the loads of each pass. Entries that were read again go first; if
    that suffices, nothing else is dropped. Sizes of entries are shares of their files, and
    small files hold less in the same bytes: where a pass leaves more than KEEP_SHARE, the
    next one drops further entries. A store within its budget stays.
    """
    passes, start = [], 1.0
    if store_size(stored_files(spark, store)).first()["store_bytes"] > budget_mb * MEGABYTE:
        passes.append(compact(spark, store, pack_bytes=pack_bytes))
    while True:
        stored = materialise(stored_files(spark, store))
        if store_size(stored).first()["store_bytes"] <= budget_mb * MEGABYTE * start:
            return passes
        entries = materialise(read_manifest_table(spark, store))
        plan = retention_plan(entries, stored, budget_mb, start)
        dropped = materialise(plan.where("dropped").select("entry_key"))
        if dropped.isEmpty():
            return passes  # what is left has no entries
        passes.append(compact(spark, store, dropped, pack_bytes))
        start = KEEP_SHARE
