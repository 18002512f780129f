"""The extraction store: four parquet tables, `rules`, `keys`, `manifest` and `statuses`.

`keys` has what each file holds of each key, so that counts need not read rules.

All are partitioned by load, and writing a load replaces what it wrote before: a load
that is repeated counts once. Rules are written first and their manifest entries second;
rules count only with an entry of the same key and load, so a load that fails in
between leaves rows that nothing reads. A load all of whose entries were read again
by later ones is superseded and can go as a whole.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.functions.cells import column_index
from quillmap.functions.matching import UNKNOWN
from quillmap.operators.extraction import extract_rules
from quillmap.operators.manifest import (
    STORE_VERSION,
    TTL_HOURS,
    extraction_key,
    files_to_extract,
    latest_entries,
    manifest_validity,
)
from quillmap.operators.search import with_operator
from quillmap.schemas import KEY, KEY_COUNTS, MANIFEST, RULES, STATUSES
from quillmap.session import materialise
from quillmap.sources.workbooks import (
    decode_workbooks,
    file_statuses,
    keep_workbooks,
    read_workbook_files,
    sheet_grid,
    with_folder_levels,
)


def _path(store: str, table: str) -> str:
    return f"{store.rstrip('/')}/{table}"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the store; empty before the first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stored_files(spark: SparkSession, store: str) -> DataFrame:
    """path, length, kind (the table) and load_id of every file of the store; for store_size."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(store).drop("content")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, length bigint, kind string, load_id string")
    place = r"/(rules|keys|manifest|statuses)/load_id=([^/]*)/"
    return files.select(
        "path",
        "length",
        F.regexp_extract("path", place, 1).alias("kind"),
        F.regexp_extract("path", place, 2).alias("load_id"),
    )


def read_manifest_table(spark: SparkSession, store: str) -> DataFrame:
    """Entries with `entry_bytes`: the entry's share of the files of its load.

    The rules' files are shared out by text, the manifest's by entry. NULL says that the
    entry has rules but its load has no files of rules any more.
    """
    entries = _read(spark, _path(store, "manifest"), MANIFEST.replace("entry_bytes", "text_bytes"))
    is_rules, is_manifest = F.col("kind").isin("rules", "keys"), F.col("kind") == "manifest"
    loads = (
        stored_files(spark, store)
        .groupBy("load_id")
        .agg(F.sum(F.when(is_rules, F.col("length"))).alias("rules"), F.sum(F.when(is_manifest, F.col("length"))).alias("entries"))
    )
    sums = entries.groupBy("load_id").agg(F.sum("text_bytes").alias("all_text"), F.count("*").alias("all_entries"))
    of_rules = F.when(F.col("text_bytes") > 0, F.col("rules") * F.col("text_bytes") / F.col("all_text")).otherwise(0)
    size = F.floor(of_rules + F.col("entries") / F.col("all_entries")).alias("entry_bytes")
    columns = [part.split()[0] for part in MANIFEST.split(", ")]
    # one row a load: the entries of a load need not meet in one task
    return entries.join(F.broadcast(sums.join(loads, "load_id", "left")), "load_id").select(*entries.columns, size).select(*columns)


def last_statuses(spark: SparkSession, store: str) -> DataFrame:
    """The newest status of every path; one without a time is older than any other."""
    rows = read_statuses(spark, store)
    others = [c for c in rows.columns if c not in ("path", "read_at")]
    return rows.groupBy("path").agg(F.max(F.struct("read_at", *others)).alias("last")).select("path", "last.*")


def superseded_loads(spark: SparkSession, store: str) -> DataFrame:
    """load_id, files, bytes of loads whose entries and statuses were all replaced by later ones.

    A load in which every file failed has no entry, but stays while its errors are the last
    that is known of its files.
    """
    entries = _read(spark, _path(store, "manifest"), MANIFEST.replace("entry_bytes", "text_bytes"))
    used = latest_entries(entries).select("load_id").unionByName(last_statuses(spark, store).select("load_id")).distinct()
    loads = stored_files(spark, store).groupBy("load_id").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return loads.where("load_id <> ''").join(used, "load_id", "left_anti")


def write_load(rows: DataFrame, path: str, *within: str) -> None:
    """Replace the partitions of the load that `rows` belong to, and no others."""
    writer = rows.write.partitionBy("load_id", *within).option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite").parquet(path)


def write_extractions(rules: DataFrame, files: DataFrame, store: str, now: float, load_id: str | None = None) -> str:
    """Write rules and one manifest entry per file as one load; returns its load_id.

    rules: folder key, file_stem, row_no, dimension, field, expression, entry_key.
    files: entry_key, file_path, file_mtime; a file without rules gets its entry too.
    """
    load = load_id or uuid.uuid4().hex
    # rebalance splits what is large and joins what is small within each partition value
    rows = with_operator(rules).withColumn("load_id", F.lit(load)).hint("rebalance", "source", "module")
    write_load(rows, _path(store, "rules"), "source", "module")

    text = F.sum(F.octet_length("expression") + F.octet_length("dimension") + F.octet_length("field"))
    keys = materialise(_key_counts(rules, text.alias("bytes")))
    # written tables are read in parts of a good size: no need to deal the rows anew
    write_load(keys.drop("bytes").withColumn("load_id", F.lit(load)), _path(store, "keys"))
    counts = keys.groupBy("entry_key").agg(
        F.count("*").alias("data_size"), F.sum("bytes").alias("text_bytes")
    )
    entries = (
        files.join(counts, "entry_key", "left")
        .fillna(0, ["data_size", "text_bytes"])
        .withColumns(
            {
                "timestamp": F.lit(float(now)),
                "cache_version": F.lit(STORE_VERSION).cast("bigint"),
                "load_id": F.lit(load),
            }
        )
    )
    columns = [part.split()[0] for part in MANIFEST.replace("entry_bytes", "text_bytes").split(", ")]
    write_load(entries.select(*columns), _path(store, "manifest"))
    return load


def _key_counts(rules: DataFrame, *more: Column) -> DataFrame:
    return rules.groupBy(*KEY, "file_stem", "entry_key").agg(F.count("*").alias("expressions"), *more)


def read_key_counts(spark: SparkSession, store: str, valid_keys: DataFrame | None = None) -> DataFrame:
    """What the current entries (or the given ones only) hold of each key, per file.

    `catalogue.file_mapping_count` and `folder_mapping_count` take this table instead of
    rules. It merges what the loads wrote; an entry that was read again counts as the last
    load has it. Rules are read of loads only that are older than the table.
    """
    manifest = _read(spark, _path(store, "manifest"), MANIFEST.replace("entry_bytes", "text_bytes"))
    entries = latest_entries(manifest).select("entry_key", "load_id", "data_size")
    if valid_keys is not None:
        entries = entries.join(valid_keys.select("entry_key").distinct(), "entry_key", "left_semi")
    loads = stored_files(spark, store).where("kind = 'keys'").select("load_id").distinct()
    counted = _read(spark, _path(store, "keys"), KEY_COUNTS).join(entries, ["entry_key", "load_id"], "left_semi")
    older = materialise(entries.where("data_size > 0").join(loads, "load_id", "left_anti"))
    if older.isEmpty():
        return counted
    rules = _read(spark, _path(store, "rules"), RULES).join(older.select("entry_key", "load_id"), ["entry_key", "load_id"])
    again = _key_counts(rules, F.first("load_id").alias("load_id"))
    return counted.unionByName(again.select(*counted.columns))


def write_statuses(statuses: DataFrame, store: str, load_id: str, now: float | None = None) -> None:
    """path, status, error and time of every workbook of a load."""
    rows = statuses.select("path", "status", "error", F.lit(now).cast("double").alias("read_at"), F.lit(load_id).alias("load_id"))
    write_load(rows, _path(store, "statuses"))


def read_statuses(spark: SparkSession, store: str) -> DataFrame:
    return _read(spark, _path(store, "statuses"), STATUSES)


def read_saved_extractions(spark: SparkSession, store: str, valid_keys: DataFrame | None = None) -> DataFrame:
    """Rules of the newest load of every entry, or of the given entries only."""
    manifest = _read(spark, _path(store, "manifest"), MANIFEST.replace("entry_bytes", "text_bytes"))
    entries = latest_entries(manifest).select("entry_key", "load_id")
    if valid_keys is not None:
        entries = entries.join(valid_keys.select("entry_key").distinct(), "entry_key", "left_semi")
    return _read(spark, _path(store, "rules"), RULES).join(entries, ["entry_key", "load_id"], "left_semi")


def entries_of_paths(spark: SparkSession, store: str) -> DataFrame:
    """entry_key of the newest entry of every path: an older size of a changed workbook is left out."""
    manifest = _read(spark, _path(store, "manifest"), MANIFEST.replace("entry_bytes", "text_bytes"))
    newest = F.max(F.struct("timestamp", "file_mtime", "load_id", "entry_key")).alias("newest")
    return manifest.groupBy("file_path").agg(newest).select("newest.entry_key")


def upgrade_old_extractions(old: DataFrame, saved: DataFrame) -> DataFrame:
    """Older rows do not say which file an expression came from; they join with that left open."""
    return saved.unionByName(old, allowMissingColumns=True)


def fill_filenames(rules: DataFrame) -> DataFrame:
    """Where the file is open: the first known file of the key, else "Unknown"."""
    known = rules.where(F.col("file_stem").isNotNull())
    first = known.groupBy(*KEY).agg(F.min("file_stem").alias("file_stem"))
    unnamed = rules.where(F.col("file_stem").isNull()).drop("file_stem").join(first, list(KEY), "left")
    return known.unionByName(unnamed.fillna(UNKNOWN, ["file_stem"]))


@dataclass(frozen=True)
class Extraction:
    """What to read from every workbook."""

    left: str | int = "B"
    field: str | int = "C"
    value: str | int = "D"
    sheet: str | int = 0
    header_rows: int = 2

    def params(self) -> dict:
        return {
            "left_col": self.left, "field_col": self.field, "value_col": self.value,
            "sheet": self.sheet, "header_rows_to_skip": self.header_rows,
        }

    def width(self) -> int:
        return max(map(column_index, (self.left, self.field, self.value)))

    def rules(self, grid: DataFrame) -> DataFrame:
        return extract_rules(grid, self.left, self.field, self.value, self.header_rows)


def keyed_workbooks(files: DataFrame, extraction: Extraction) -> DataFrame:
    key = extraction_key(F.col("path"), F.col("length"), extraction.params())
    mtime = F.col("modificationTime").cast("double")
    return with_folder_levels(keep_workbooks(files)).withColumns({"entry_key": key, "mtime": mtime})


def ingest(
    spark: SparkSession,
    root: str,
    store: str,
    now: float,
    extraction: Extraction = Extraction(),
    ttl_hours: float = TTL_HOURS,
    files: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Read what is new or changed below `root` into the store.

    Returns the tables `validity` (what was found of every workbook), `statuses`
    (how the reading went) and `rules` (all current rules, saved and new).

    Only the listing is compared with the manifest. Paths stay a table: tasks open the
    files that need it and no others, in one job for any number of files. A file that is
    gone or unreadable by then is reported in `statuses` and read again the next time.
    `files` may give the listing, such as that of `tree.read_tree`, which outlives folders that
    cannot be listed.
    """
    found = read_workbook_files(spark, root).drop("content") if files is None else files
    listing = materialise(keyed_workbooks(found, extraction))
    validity = materialise(manifest_validity(listing, read_manifest_table(spark, store), now, ttl_hours))
    todo = materialise(files_to_extract(listing, validity))
    return {
        "validity": validity,
        "statuses": _load(todo, extraction, store, now),
        "rules": read_saved_extractions(spark, store, listing.select("entry_key")),
    }


def _load(files: DataFrame, extraction: Extraction, store: str, now: float) -> DataFrame:
    """Read the listed workbooks into the store; returns their statuses."""
    partitions = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    decoded = decode_workbooks(files.select("path", "entry_key").repartition(partitions, "path"), extraction.sheet, extraction.width())
    return store_workbooks(files, decoded, extraction, store, now, uuid.uuid4().hex)


def store_workbooks(
    files: DataFrame, decoded: DataFrame, extraction: Extraction, store: str, now: float, load_id: str
) -> DataFrame:
    """Write decoded workbooks as one load, statuses first; returns the statuses.

    files: path, entry_key, mtime. A workbook that was not read has a status and no entry.
    """
    decoded = materialise(decoded)
    statuses = file_statuses(decoded).drop("entry_key")
    read = statuses.where(F.col("status") == "ok").select("path")
    if not statuses.isEmpty():
        write_statuses(statuses, store, load_id, now)
    if not read.isEmpty():
        rules = with_operator(extraction.rules(sheet_grid(decoded)).drop("path"))
        kept = files.join(read, "path", "left_semi")
        entries = kept.select("entry_key", F.col("path").alias("file_path"), F.col("mtime").alias("file_mtime"))
        write_extractions(rules, entries, store, now, load_id)
    return statuses
