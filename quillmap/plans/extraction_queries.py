"""Cleaning and catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.functions import cells as c
from quillmap.operators import catalogue as cat
from quillmap.operators import extraction as ex
from quillmap.plans import tables as t
from quillmap.plans.oracle import FILE, FOLDER, KEY, has_error, strip, using
from quillmap.plans.registry import query
from quillmap.session import materialise

KEY_COLUMNS = KEY.split(", ")
FILE_COLUMNS = FILE.split(", ")


def _cells(rows):
    return rows.withColumns({n: F.get("cells", F.lit(i)) for i, n in enumerate("abcd")})


@query(
    "column_index",
    """SELECT p_partkey, word, list_reduce(list_transform(string_split(upper(word), ''),
           lambda c: CAST(ascii(c) - 64 AS BIGINT)), lambda x, y: x * 26 + y) AS word_index,
           CASE WHEN regexp_full_match(p_name, '[A-Za-z]+') THEN 1 END AS name_index
       FROM (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS word FROM part)""",
)
def column_index(spark, sf_dir):
    part = t.spark_sql(spark, sf_dir, "SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS word FROM {part}")
    return part.select(
        "p_partkey", "word", c.column_index_of(F.col("word")).alias("word_index"),
        c.column_index_of(F.col("p_name")).alias("name_index"),
    )


@query("skip_header_rows", using("grid") + f"SELECT {FILE}, row_no, a, b, c, d FROM grid WHERE row_no > 4")
def skip_header_rows(spark, sf_dir):
    rows = ex.skip_header_rows(t.grid(spark, sf_dir), header_rows=4)
    return _cells(rows).select(*FILE_COLUMNS, "row_no", *"abcd")


@query("pick_columns", using("picked") + f"SELECT {FILE}, row_no, dimension, field, expression FROM picked")
def pick_columns(spark, sf_dir):
    return ex.pick_columns(t.grid(spark, sf_dir), "b", 3, "D")


@query(
    "normalise_cell",
    using("cells") + f"SELECT l_orderkey, l_linenumber, {', '.join(f'''coalesce({strip(x)}, '') AS {x}''' for x in 'bcd')} FROM cells",
)
def normalise_cell(spark, sf_dir):
    rows = t.cells(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", *[c.normalise_cell(F.col(x)).alias(x) for x in "bcd"])


@query("drop_blank_rows", using("filled") + f"SELECT {FILE}, row_no, dimension, field, expression FROM filled")
def drop_blank_rows(spark, sf_dir):
    return ex.drop_blank_rows(ex.normalise_parts(ex.pick_columns(t.grid(spark, sf_dir))))


def _cell_parts(spark, sf_dir):
    rows = t.cells(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", F.col("d").alias("expression"))


@query(
    "drop_placeholders",
    using("cells") + "SELECT l_orderkey, l_linenumber, d AS expression FROM cells WHERE d NOT IN ('-', 'NA', 'N/A')",
)
def drop_placeholders(spark, sf_dir):
    return ex.drop_placeholders(_cell_parts(spark, sf_dir))


@query(
    "drop_error_cells",
    using("cells") + f"SELECT l_orderkey, l_linenumber, d AS expression FROM cells WHERE NOT {has_error('d')}",
)
def drop_error_cells(spark, sf_dir):
    return ex.drop_error_cells(_cell_parts(spark, sf_dir))


@query(
    "tag_filename",
    using("cells") + "SELECT l_orderkey, l_linenumber, file_stem FROM cells",
)
def tag_filename(spark, sf_dir):
    rows = t.cells(spark, sf_dir).withColumn("file_name", F.concat("file_stem", F.lit(".xlsx")))
    return rows.select("l_orderkey", "l_linenumber", c.file_stem(F.col("file_name")).alias("file_stem"))


# ------------------------------------------------------------------ catalogue


@query(
    "expressions_by_key",
    using("rules")
    + f"""SELECT {KEY}, file_stem, row_no // 1024 AS block, count(*) AS expression_count,
          string_agg(expression, ' | ' ORDER BY row_no) AS expressions FROM rules GROUP BY ALL""",
)
def expressions_by_key(spark, sf_dir):
    blocks = cat.expressions_by_key(t.rules(spark, sf_dir))
    return blocks.select(
        *KEY_COLUMNS, "file_stem", "block", F.size("entries").cast("bigint").alias("expression_count"),
        F.concat_ws(" | ", "entries.expression").alias("expressions"),
    )


@query(
    "filenames_by_key",
    using("rules") + f"SELECT {KEY}, file_stem, min(row_no) AS first_row_no FROM rules GROUP BY ALL",
)
def filenames_by_key(spark, sf_dir):
    return cat.filenames_by_key(t.rules(spark, sf_dir))


@query("expression_filenames", using("rules") + f"SELECT {KEY}, file_stem, row_no, expression FROM rules")
def expression_filenames(spark, sf_dir):
    return cat.expression_filenames(t.rules(spark, sf_dir))


@query("explode_expressions", using("rules") + f"SELECT {KEY}, file_stem, row_no, expression FROM rules")
def explode_expressions(spark, sf_dir):
    blocks = cat.expressions_by_key(t.rules(spark, sf_dir))
    return cat.explode_expressions(blocks).drop("block")


FILE_COUNTS = f"""SELECT {FILE}, coalesce(mapping_count, 0) AS mapping_count,
    coalesce(expression_count, 0) AS expression_count
    FROM (SELECT DISTINCT {FILE} FROM cells) LEFT JOIN (
        SELECT {FILE}, count(DISTINCT (dimension, field)) AS mapping_count, count(*) AS expression_count
        FROM rules GROUP BY ALL) USING ({FILE})"""
FOLDER_COUNTS = f"""SELECT {FOLDER}, coalesce(mapping_count, 0) AS mapping_count,
    coalesce(expression_count, 0) AS expression_count
    FROM (SELECT DISTINCT {FOLDER} FROM cells) LEFT JOIN (
        SELECT {FOLDER}, count(DISTINCT (dimension, field)) AS mapping_count, count(*) AS expression_count
        FROM rules GROUP BY ALL) USING ({FOLDER})"""


@query("file_mapping_count", using("rules") + FILE_COUNTS)
def file_mapping_count(spark, sf_dir):
    return cat.file_mapping_count(t.rules(spark, sf_dir), t.cells(spark, sf_dir))


def _folder_counts(spark, sf_dir):
    return cat.folder_mapping_count(t.rules(spark, sf_dir), t.cells(spark, sf_dir))


@query("folder_mapping_count", using("rules") + FOLDER_COUNTS)
def folder_mapping_count(spark, sf_dir):
    return _folder_counts(spark, sf_dir)


@query(
    "catalogue_totals",
    using("rules")
    + f"""SELECT count(*) AS folder_count, CAST(sum(mapping_count) AS BIGINT) AS mapping_count,
          CAST(sum(expression_count) AS BIGINT) AS expression_count FROM ({FOLDER_COUNTS})""",
)
def catalogue_totals(spark, sf_dir):
    return cat.catalogue_totals(_folder_counts(spark, sf_dir))


@query("top_folders", using("rules") + f"{FOLDER_COUNTS} ORDER BY mapping_count DESC, {FOLDER} LIMIT 10")
def top_folders(spark, sf_dir):
    return cat.top_folders(_folder_counts(spark, sf_dir))


@query(
    "sources_listing",
    using("rules") + f"SELECT {FOLDER}, mapping_count FROM ({FOLDER_COUNTS}) ORDER BY {FOLDER}",
)
def sources_listing(spark, sf_dir):
    return cat.sources_listing(_folder_counts(spark, sf_dir))


FILE_STATUS = """CASE WHEN file_stem LIKE '%Brand7\\_%' ESCAPE '\\' THEN 'error'
    WHEN file_stem LIKE '%Brand9\\_%' ESCAPE '\\' THEN 'skipped' ELSE 'ok' END"""


@query(
    "load_report",
    using("rules")
    + f"""SELECT f.files, f.files_skipped, f.files_failed, c.folder_count, c.mapping_count, c.expression_count
    FROM (SELECT count(*) AS files, count(*) FILTER (status = 'skipped') AS files_skipped,
                 count(*) FILTER (status = 'error') AS files_failed
          FROM (SELECT {FILE_STATUS} AS status FROM (SELECT DISTINCT {FILE} FROM cells))) f,
         (SELECT count(*) AS folder_count, CAST(sum(mapping_count) AS BIGINT) AS mapping_count,
                 CAST(sum(expression_count) AS BIGINT) AS expression_count FROM ({FOLDER_COUNTS})) c""",
)
def load_report(spark, sf_dir):
    files = t.files(spark, sf_dir)
    workbooks = materialise(files.withColumn("path", F.concat_ws("/", *FILE_COLUMNS)))
    statuses = workbooks.select(
        "path", F.when(F.col("file_stem").contains("Brand7_"), "error")
        .when(F.col("file_stem").contains("Brand9_"), "skipped").otherwise("ok").alias("status"),
    )
    return cat.load_report(t.rules(spark, sf_dir), workbooks, statuses)


@query("union_filenames", using("rules") + f"SELECT DISTINCT {KEY}, file_stem FROM rules")
def union_filenames(spark, sf_dir):
    return cat.filenames_by_key(t.rules(spark, sf_dir)).drop("first_row_no")
