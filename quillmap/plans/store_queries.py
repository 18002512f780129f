"""Workbook, store and manifest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.operators import extraction as ex
from quillmap.operators import manifest as mf
from quillmap.plans import tables as t
from quillmap.plans.extraction_queries import FILE_COLUMNS, KEY_COLUMNS
from quillmap.plans.oracle import FILE, FOLDER, KEY, NEEDS, STEPS, step, using
from quillmap.plans.registry import query
from quillmap.plans.workbook_tables import BROKEN, FIRST_ROW, HEADERS, ROWS_PER_WORKBOOK, TWO_SHEETS, workbook_files
from quillmap.schemas import LISTING as LISTING_SCHEMA
from quillmap.session import materialise, new_shared_path
from quillmap.sources import manifest as meta
from quillmap.sources import compaction, store
from quillmap.sources import workbooks as wb
from quillmap.streaming.changes import changed_files
from quillmap.streaming.ingest import stream_new_workbooks as start_stream

FOLDER_COLUMNS = FOLDER.split(", ")

# A tree listing: one file per file of the grid, some of them of other kinds or elsewhere.
_LISTED = """SELECT '/data/rules/' || source || '/' || module || '/' || source_name || '/' || vendor
    || CASE WHEN file_stem LIKE '%Brand11!_%' ESCAPE '!' THEN '/Other/'
            WHEN file_stem LIKE '%Brand12!_%' ESCAPE '!' THEN '/LdRules/deeper/' ELSE '/LdRules/' END
    || CASE WHEN file_stem LIKE '%Brand3!_%' ESCAPE '!' THEN '~$' ELSE '' END || file_stem
    || CASE WHEN file_stem LIKE '%Brand5!_%' ESCAPE '!' THEN '.XLSX'
            WHEN file_stem LIKE '%Brand8!_%' ESCAPE '!' THEN '.csv' ELSE '.xlsx' END AS path,
    CAST(1000 + length(file_stem) AS BIGINT) AS length
    FROM """
LISTING = f"{_LISTED}(SELECT DISTINCT {FILE} FROM ({t.CELLS}))"
step("listing", t.oracle_text(LISTING))
step(
    "levels",
    """SELECT p[len(p) - 5] AS source, p[len(p) - 4] AS module, p[len(p) - 3] AS source_name,
           p[len(p) - 2] AS vendor, p[len(p)] AS file_name, path, length
       FROM (SELECT *, string_split(path, '/') AS p FROM listing) WHERE p[len(p) - 1] = 'LdRules'""",
    "listing",
)


def _listing(spark, sf_dir):
    return spark.sql(_LISTED + "{files}", files=t.files(spark, sf_dir))


@query("scan_rule_folders", using("levels") + f"SELECT {FOLDER}, count(*) AS files FROM levels GROUP BY ALL")
def scan_rule_folders(spark, sf_dir):
    return wb.rule_folders(_listing(spark, sf_dir)).drop("folder_path")


@query(
    "filter_workbook_files",
    using("levels")
    + f"""SELECT {FOLDER}, file_name, regexp_replace(file_name, '\\.[^.]*$', '') AS file_stem, length
          FROM levels WHERE lower(file_name) LIKE '%.xlsx' AND NOT starts_with(file_name, '~$')""",
)
def filter_workbook_files(spark, sf_dir):
    # written once: paths would else be made again, before files are told apart, in every test of them
    files = wb.with_folder_levels(wb.keep_workbooks(materialise(_listing(spark, sf_dir))))
    return files.drop("path")


# Rows as the workbooks hold them: headers, numbering within the workbook, broken files gone.
step(
    "books",
    f"""SELECT {FOLDER}, file_stem || '_' || part AS file_stem,
            (row_no - {FIRST_ROW}) % {ROWS_PER_WORKBOOK} + {FIRST_ROW} AS row_no, a, b, c, d
        FROM (SELECT *, (row_no - {FIRST_ROW}) // {ROWS_PER_WORKBOOK} AS part FROM grid)""",
    "grid",
)
HEADER_ROWS = " UNION ALL ".join(
    f"SELECT {FILE}, CAST({i} AS BIGINT) AS row_no, '{a}' AS a, '{b}' AS b, '{c}' AS c, '{d}' AS d"
    f" FROM (SELECT DISTINCT {FILE} FROM books)"
    for i, (a, b, c, d) in enumerate(HEADERS, start=1)
)
step("sheets", f"SELECT {FILE}, row_no, a, b, c, d FROM books UNION ALL {HEADER_ROWS}", "books")
READABLE = f"file_stem NOT LIKE '%{BROKEN.replace('_', '!_')}%' ESCAPE '!'"
TWICE = f"file_stem LIKE '%{TWO_SHEETS.replace('_', '!_')}%' ESCAPE '!'"


def _book_rules(where):
    """The extraction steps over the workbooks' rows instead of the grid's."""
    cells = f"(SELECT *, CASE WHEN d IS NULL THEN [a, b, c] ELSE [a, b, c, d] END AS cells FROM books WHERE {where})"
    parts = [f"picked AS ({STEPS['picked'].replace('FROM grid', f'FROM {cells}')})"]
    parts += [f"{n} AS ({STEPS[n]})" for n in ("normal", "filled", "placed", "rules")]
    assert NEEDS["picked"] == ["grid"]
    return using("books").rstrip() + ",\n" + ",\n".join(parts) + "\n"


@query("read_workbook_rows", using("sheets") + f"SELECT {FILE}, row_no, a, b, c, d FROM sheets WHERE {READABLE}")
def read_workbook_rows(spark, sf_dir):
    grid = wb.sheet_grid(wb.decode_workbooks(workbook_files(spark, sf_dir)))
    cells = {n: F.get("cells", F.lit(i)) for i, n in enumerate("abcd")}
    return grid.withColumns(cells).select(*FILE_COLUMNS, "row_no", *"abcd")


@query(
    "select_sheet",
    using("sheets")
    + f"""SELECT {FILE}, CASE WHEN NOT ({READABLE}) THEN 'error' WHEN {TWICE} THEN 'ok' ELSE 'skipped' END AS status,
          CASE WHEN {TWICE} THEN count(*) ELSE 0 END AS rows_read
          FROM sheets GROUP BY {FILE}""",
)
def select_sheet(spark, sf_dir):
    decoded = materialise(wb.decode_workbooks(workbook_files(spark, sf_dir), sheet="Extra"))
    statuses = wb.with_folder_levels(wb.file_statuses(decoded))
    rows = decoded.where(F.col("row_no").isNotNull()).groupBy("path").agg(F.count("*").alias("rows_read"))
    return statuses.join(rows, "path", "left").fillna(0, ["rows_read"]).select(*FILE_COLUMNS, "status", "rows_read")


@query(
    "isolate_bad_files",
    _book_rules(READABLE)
    + f"""SELECT {FILE}, CASE WHEN {READABLE} THEN 'ok' ELSE 'error' END AS status, coalesce(kept, 0) AS kept
          FROM (SELECT DISTINCT {FILE} FROM books)
          LEFT JOIN (SELECT {FILE}, count(*) AS kept FROM rules GROUP BY {FILE}) USING ({FILE})""",
)
def isolate_bad_files(spark, sf_dir):
    decoded = materialise(wb.decode_workbooks(workbook_files(spark, sf_dir)))
    statuses = wb.with_folder_levels(wb.file_statuses(decoded))
    kept = ex.extract_rules(wb.sheet_grid(decoded)).groupBy("path").agg(F.count("*").alias("kept"))
    return statuses.join(kept, "path", "left").fillna(0, ["kept"]).select(*FILE_COLUMNS, "status", "kept")


def _stored(spark, sf_dir):
    """The rules of all files written to a new store; returns its path and the entries."""
    path = F.concat_ws("/", *FILE_COLUMNS)
    key = mf.extraction_key(path, F.lit(0))
    rules = t.rules(spark, sf_dir).withColumn("entry_key", key)
    files = t.files(spark, sf_dir).select(
        key.alias("entry_key"), path.alias("file_path"), F.lit(float(t.NOW - 3600)).alias("file_mtime")
    )
    rules, files = materialise(rules), materialise(files)
    folder = new_shared_path(spark, "store")
    store.write_extractions(rules, files, folder, t.NOW)
    return folder, files


@query(
    "write_extractions",
    using("rules")
    + f"""SELECT {FILE.replace(', ', " || '/' || ")} AS file_path, coalesce(n, 0) AS data_size,
          CAST(2 AS BIGINT) AS cache_version, CAST({t.NOW} AS DOUBLE) AS timestamp
          FROM (SELECT DISTINCT {FILE} FROM cells) LEFT JOIN (SELECT {FILE}, count(DISTINCT (dimension, field)) AS n
          FROM rules GROUP BY {FILE}) USING ({FILE})""",
)
def write_extractions(spark, sf_dir):
    folder, _ = _stored(spark, sf_dir)
    return store.read_manifest_table(spark, folder).select("file_path", "data_size", "cache_version", "timestamp")


@query(
    "read_saved_extractions",
    using("rules") + f"SELECT {KEY}, file_stem, row_no, expression FROM rules WHERE file_stem LIKE '%Brand1%'",
)
def read_saved_extractions(spark, sf_dir):
    folder, files = _stored(spark, sf_dir)
    valid = files.where(F.col("file_path").contains("Brand1"))
    saved = store.read_saved_extractions(spark, folder, valid)
    return saved.select(*KEY_COLUMNS, "file_stem", "row_no", "expression")


@query(
    "union_files",
    using("rules") + f"SELECT {KEY}, file_stem, row_no, expression FROM rules",
)
def union_files(spark, sf_dir):
    """Rules of some files from the store, those of the others read anew, as one bag."""
    rules = materialise(t.rules(spark, sf_dir).withColumn("entry_key", mf.extraction_key(F.concat_ws("/", *FILE_COLUMNS), F.lit(0))))
    saved = F.xxhash64("entry_key") % 2 == 0
    files = rules.where(saved).select(
        "entry_key", F.concat_ws("/", *FILE_COLUMNS).alias("file_path"), F.lit(float(t.NOW - 3600)).alias("file_mtime")
    )
    folder = new_shared_path(spark, "store")
    store.write_extractions(rules.where(saved), files.distinct(), folder, t.NOW)
    columns = [*KEY_COLUMNS, "file_stem", "row_no", "expression"]
    return store.read_saved_extractions(spark, folder).select(*columns).unionByName(rules.where(~saved).select(*columns))


@query(
    "upgrade_old_extractions",
    using("rules")
    + f"""SELECT {KEY}, row_no, expression, CASE WHEN row_no % 2 = 0 THEN file_stem ELSE coalesce(
          min(file_stem) FILTER (row_no % 2 = 0) OVER (PARTITION BY {KEY}), 'Unknown') END AS file_stem FROM rules""",
)
def upgrade_old_extractions(spark, sf_dir):
    """Rows of odd number stand for an older store that did not keep the file of a row."""
    rules = materialise(t.rules(spark, sf_dir))
    odd = F.col("row_no") % 2 == 1
    upgraded = store.upgrade_old_extractions(rules.where(odd).drop("file_stem"), rules.where(~odd))
    return store.fill_filenames(upgraded).select(*KEY_COLUMNS, "row_no", "expression", "file_stem")


@query(
    "stream_new_workbooks",
    _book_rules(READABLE)
    + f"""SELECT {KEY}, file_stem, row_no, expression, NULL AS status FROM rules UNION ALL
          SELECT {FOLDER}, NULL, NULL, file_stem, NULL, NULL, CASE WHEN {READABLE} THEN 'ok' ELSE 'error' END
          FROM (SELECT DISTINCT {FILE} FROM books)""",
)
def stream_new_workbooks(spark, sf_dir):
    """Two arrivals of workbooks, each followed by a run of the stream: its rules, and every workbook's status."""
    books = materialise(workbook_files(spark, sf_dir))
    arrived, folder, checkpoint = (new_shared_path(spark, n) for n in ("arrived", "store", "offsets"))
    first = F.xxhash64("path") % 2 == 0
    for part in (books.where(first), books.where(~first)):
        part.write.mode("append").parquet(arrived)
        files = spark.readStream.schema(books.schema).parquet(arrived)
        start_stream(files, folder, checkpoint).awaitTermination()
    columns = [*KEY_COLUMNS, "file_stem", "row_no", "expression"]
    rules = store.read_saved_extractions(spark, folder).select(*columns, F.lit(None).cast("string").alias("status"))
    statuses = wb.with_folder_levels(store.read_statuses(spark, folder))
    nothing = {c: F.lit(None).cast(rules.schema[c].dataType) for c in rules.columns}
    told = {c: F.col(c) for c in (*FOLDER_COLUMNS, "file_stem", "status")}
    return rules.unionByName(statuses.select(*[x.alias(c) for c, x in (nothing | told).items()]))


CHANGED = "length(path) % 3 = 0"


@query(
    "stream_changed_workbooks",
    using("listing")
    + f"""SELECT path, length, CAST(CASE WHEN {CHANGED} THEN 2 ELSE 1 END AS BIGINT) AS passed,
          CAST(CASE WHEN {CHANGED} THEN 2000 ELSE 1000 END AS BIGINT) AS last_time FROM listing""",
)
def stream_changed_workbooks(spark, sf_dir):
    """Two listings of the same tree, between which a third of the files changed: how often each passed."""
    files = materialise(_listing(spark, sf_dir))
    arrived, passed, checkpoint = (new_shared_path(spark, n) for n in ("arrived", "passed", "offsets"))
    for later in (F.lit(1000), F.when(F.expr(CHANGED), 2000).otherwise(1000)):
        files.select("path", F.timestamp_seconds(later).alias("modificationTime"), "length").write.mode("append").parquet(arrived)
        stream = changed_files(spark.readStream.schema(LISTING_SCHEMA).parquet(arrived)).writeStream.format("parquet")
        stream = stream.option("path", passed).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        stream.start().awaitTermination()
    last = F.max(F.unix_seconds("modificationTime")).alias("last_time")
    return spark.read.schema(LISTING_SCHEMA).parquet(passed).groupBy("path", "length").agg(F.count("*").alias("passed"), last)


# -------------------------------------------------------------------- manifest

PARAMS = '{"field_col":"C","header_rows_to_skip":2,"left_col":"B","sheet":0,"value_col":"D"}'
ENTRY_KEY = (
    "md5('{\"file_path\":\"' || path || '\",\"file_size\":' || length || ',\"params\":" + PARAMS + "}')"
)
step("files", f"SELECT *, {ENTRY_KEY} AS entry_key FROM workbooks", "workbooks")
step("entries", "SELECT m.*, f.entry_key, f.path AS file_path FROM manifest m JOIN files f USING (o_orderkey)", "manifest", "files")
AGE = f"({t.NOW} - timestamp)"
step(
    "validity",
    f"""SELECT f.entry_key, f.path, CASE WHEN timestamp IS NULL THEN 'missing'
        WHEN {AGE} / 3600 > {t.TTL_HOURS} THEN 'expired' WHEN mtime > file_mtime THEN 'modified'
        WHEN cache_version < 2 THEN 'old_version' ELSE 'valid' END AS reason
        FROM files f LEFT JOIN entries e USING (entry_key)""",
    "files", "entries",
)


def _workbooks(spark, sf_dir):
    files = t.spark_sql(spark, sf_dir, t.WORKBOOKS)
    return files.withColumn("entry_key", mf.extraction_key(F.col("path"), F.col("length")))


def _manifest(spark, sf_dir):
    paths = _workbooks(spark, sf_dir).select("o_orderkey", "entry_key", F.col("path").alias("file_path"))
    return (
        t.spark_sql(spark, sf_dir, t.MANIFEST)
        .join(paths, "o_orderkey")
        .withColumn("load_id", F.lit("first"))
        .drop("o_orderkey")
    )


def _validity(spark, sf_dir):
    files = _workbooks(spark, sf_dir).select("entry_key", "path", "mtime", "length")
    return mf.manifest_validity(files, _manifest(spark, sf_dir), t.NOW, t.TTL_HOURS)


def _stored_files(spark, sf_dir):
    """Files of the store: those of the entries, and some whose entry is gone."""
    return _manifest(spark, sf_dir).select(F.col("entry_bytes").alias("length")).unionByName(
        _workbooks(spark, sf_dir).where(F.col("o_orderkey") % 10 == 0).select("length")
    )


STORED = "(SELECT entry_bytes AS length FROM entries UNION ALL SELECT length FROM files WHERE o_orderkey % 10 = 0)"


@query("extraction_key", using("files") + "SELECT path, entry_key FROM files")
def extraction_key(spark, sf_dir):
    return _workbooks(spark, sf_dir).select("path", "entry_key")


META_LINES = """SELECT o_orderkey, '{{"timestamp": ' || CAST({epoch} AS VARCHAR(20)) || '.5, "file_mtime": '
    || CAST({epoch} - 3600 AS VARCHAR(20)) || '.25, "file_path": "/data/file_' || CAST(o_orderkey AS VARCHAR(20))
    || '.xlsx", "data_size": ' || CAST(o_custkey % 150 AS VARCHAR(20))
    || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ', "cache_version": 2' END
    || CASE WHEN o_orderkey % 50 = 7 THEN '' ELSE '}}' END AS value FROM {orders}"""


@query(
    "read_manifest",
    f"""SELECT entry_key, readable, CASE WHEN readable THEN CAST(j->>'$.timestamp' AS DOUBLE) END AS timestamp,
        CASE WHEN readable THEN CAST(j->>'$.file_mtime' AS DOUBLE) END AS file_mtime,
        CASE WHEN readable THEN j->>'$.file_path' END AS file_path,
        CASE WHEN readable THEN CAST(j->>'$.data_size' AS BIGINT) END AS data_size,
        CASE WHEN readable THEN CAST(j->>'$.cache_version' AS BIGINT) END AS cache_version
        FROM (SELECT 'key' || o_orderkey AS entry_key, json_valid(value) AS readable,
              CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS j FROM ({t.oracle_text(META_LINES)}))""",
)
def read_manifest(spark, sf_dir):
    lines = t.spark_sql(spark, sf_dir, META_LINES)
    return meta.parse_meta(
        lines.select(F.concat(F.lit("key"), "o_orderkey", F.lit(".meta")).alias("file_name"), "value")
    )


@query("manifest_validity", using("validity") + "SELECT entry_key, path, reason FROM validity")
def manifest_validity(spark, sf_dir):
    return _validity(spark, sf_dir).select("entry_key", "path", "reason")


@query("files_to_extract", using("validity") + "SELECT entry_key, path FROM validity WHERE reason <> 'valid'")
def files_to_extract(spark, sf_dir):
    files = _workbooks(spark, sf_dir).select("entry_key", "path")
    return mf.files_to_extract(files, _validity(spark, sf_dir))


@query(
    "expired_entries",
    using("entries") + f"SELECT entry_key, timestamp FROM entries WHERE {AGE} > {t.TTL_HOURS} * 3600",
)
def expired_entries(spark, sf_dir):
    return mf.expired_entries(_manifest(spark, sf_dir), t.NOW, t.TTL_HOURS).select("entry_key", "timestamp")


@query("store_size", using("entries") + f"SELECT CAST(sum(length) AS BIGINT) AS store_bytes FROM {STORED}")
def store_size(spark, sf_dir):
    return mf.store_size(_stored_files(spark, sf_dir))


@query(
    "retention_plan",
    using("entries")
    + f"""SELECT entry_key, timestamp, entry_bytes, store_bytes > {t.BUDGET_MB} * 1048576
          AND store_bytes - older > {t.BUDGET_MB} * 1048576 * 0.8 AS dropped
          FROM (SELECT *, coalesce(sum(entry_bytes) OVER (ORDER BY timestamp, entry_key
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS older FROM entries),
               (SELECT sum(length) AS store_bytes FROM {STORED})""",
)
def retention_plan(spark, sf_dir):
    plan = mf.retention_plan(_manifest(spark, sf_dir), _stored_files(spark, sf_dir), t.BUDGET_MB)
    return plan.select("entry_key", "timestamp", "entry_bytes", "dropped")


# Entries by loads of 30 days; some files were read again 100 days later.
LOADED = """SELECT entry_key, timestamp, entry_bytes, 'L' || CAST(CAST(floor(timestamp / 2592000) AS BIGINT) AS VARCHAR(20)) AS load_id
    FROM (SELECT entry_key, timestamp, entry_bytes FROM {entries} UNION ALL
          SELECT entry_key, timestamp + 8640000 AS timestamp, entry_bytes FROM {entries} WHERE data_size % 7 = 0) AS e"""
PACK_BYTES = 100_000


@query(
    "compaction_plan",
    using("entries")
    + f""", loaded AS ({LOADED.format(entries="entries")}),
        newest AS (SELECT *, row_number() OVER (PARTITION BY entry_key ORDER BY timestamp DESC) = 1
            AND max(timestamp) OVER (PARTITION BY entry_key) >= {t.NOW} - {t.TTL_HOURS} * 3600 AS lives FROM loaded),
        fates AS (SELECT *, CASE WHEN bool_and(lives) OVER w THEN 'keep' WHEN bool_or(lives) OVER w THEN 'pack' ELSE 'remove' END AS fate
            FROM newest WINDOW w AS (PARTITION BY load_id)),
        packs AS (SELECT entry_key, load_id, CAST(floor(coalesce(sum(entry_bytes) OVER (ORDER BY timestamp, entry_key
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {PACK_BYTES}) AS BIGINT) AS pack
            FROM fates WHERE lives AND fate = 'pack')
        SELECT entry_key, load_id, lives, fate, pack FROM fates LEFT JOIN packs USING (entry_key, load_id)""",
)
def compaction_plan(spark, sf_dir):
    entries = _manifest(spark, sf_dir).select("entry_key", "timestamp", "entry_bytes", "data_size")
    manifest = materialise(spark.sql(LOADED.format(entries="{entries}"), entries=entries))
    expired = mf.expired_entries(mf.latest_entries(manifest), t.NOW, t.TTL_HOURS)
    fates = materialise(compaction.entry_fates(manifest, expired))
    loads, packs = compaction.load_fates(fates), compaction.packing_plan(fates, PACK_BYTES)
    told = fates.join(loads.select("load_id", "fate"), "load_id").join(packs, ["entry_key", "load_id"], "left")
    return told.select("entry_key", "load_id", "lives", "fate", "pack")


@query(
    "ingest_stats",
    using("validity")
    + f"""SELECT hits, misses, hit_rate_percent, files_processed, errors, round(store_bytes / 1048576, 2) AS store_mb
    FROM (SELECT count(*) FILTER (reason = 'valid') AS hits, count(*) FILTER (reason <> 'valid') AS misses,
              round(100.0 * count(*) FILTER (reason = 'valid') / count(*), 2) AS hit_rate_percent FROM validity),
         (SELECT count(*) FILTER (NOT path LIKE '%7.xlsx') AS files_processed,
              count(*) FILTER (path LIKE '%7.xlsx') AS errors FROM validity WHERE reason <> 'valid'),
         (SELECT sum(length) AS store_bytes FROM {STORED})""",
)
def ingest_stats(spark, sf_dir):
    validity = materialise(_validity(spark, sf_dir))
    read = validity.where(F.col("reason") != "valid")
    statuses = read.select("path", F.when(F.col("path").endswith("7.xlsx"), "error").otherwise("ok").alias("status"))
    return mf.ingest_stats(validity, statuses, _stored_files(spark, sf_dir))
