"""Rule tables derived from the test tables.

The same SQL text serves Spark and the oracle: `{lineitem}` and the like stand
for the table, and SPARK / ORACLE for the few spellings that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.operators.extraction import extract_rules
from quillmap.operators.numbering import number_rows
from quillmap.schemas import FOLDER

TABLES = ("region", "nation", "supplier", "part", "lineitem", "orders", "conversations")
HEADER_ROWS = 2
NUMBERED_AT_ONCE = 1 << 20  # order keys per numbered range
NOW = 996_710_400  # 2001-08-02, just after the last order
TTL_HOURS = 24 * 365
BUDGET_MB = 20

SPARK = {"array": "array({})", "epoch": "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})"}
ORACLE = {"array": "[{}]", "epoch": "CAST(epoch({}) AS BIGINT)"}

# One row per line item, as a sheet row: A is the line number, B to D are the cells that count.
_FILE = """r_name AS source, n_name AS module, p_type AS source_name, s_name AS vendor,
       CASE WHEN p_partkey % 2 = 0 THEN 'LdRules_' ELSE 'LdRules\u00a0' END
           || replace(p_brand, '#', '') || '_' || p_type || '_' || s_name AS file_stem"""
_SHOWN = f"""{_FILE},
       l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity,
       CAST(l_linenumber AS VARCHAR(11)) AS a,
       CASE l_returnflag WHEN 'A' THEN ' Dim. ' WHEN 'N' THEN 'Meas.' ELSE '' END AS b,
       CASE WHEN l_linenumber % 2 = 0 THEN replace(p_name, ' ', '_') ELSE p_name END AS c,
       CASE WHEN l_quantity < 2 THEN NULL
            WHEN l_linenumber = 5 THEN CASE l_partkey % 3 WHEN 0 THEN '-' WHEN 1 THEN 'NA' ELSE 'N/A' END
            WHEN l_linenumber = 6 THEN CASE l_partkey % 6 WHEN 0 THEN '#REF!+1' WHEN 1 THEN '#N/A' WHEN 2 THEN 'x #Value!'
                 WHEN 3 THEN '#DIV/0!' WHEN 4 THEN 'sum(#NAME?)' ELSE '#NULL!' END
            WHEN l_linenumber = 7 THEN 'n/a'
            ELSE 'src.' || p_name END AS d
"""
_SOURCES = """
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
     JOIN {supplier} ON l_suppkey = s_suppkey
     JOIN {nation} ON s_nationkey = n_nationkey
     JOIN {region} ON n_regionkey = r_regionkey
"""
CELLS = f"\nSELECT {_SHOWN}{_SOURCES[1:]}"
ROW_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
# What a file's columns are made of, equal where these are: shorter, and `_FILE` reads them as it reads part.
_PARTS = """r_name, n_name, p_type, s_name,
       CASE WHEN p_type IS NOT NULL AND s_name IS NOT NULL THEN replace(p_brand, '#', '') END AS p_brand,
       CASE WHEN p_type IS NOT NULL AND s_name IS NOT NULL AND p_brand IS NOT NULL THEN p_partkey & 1 END AS p_partkey"""
FILE_PARTS = ("r_name", "n_name", "p_type", "s_name", "p_brand", "p_partkey")
FILES = f"SELECT DISTINCT {_PARTS} {_SOURCES}"
LINES = f"SELECT {_PARTS}, p_name, l_orderkey, {', '.join(ROW_ORDER)} {_SOURCES}"

# One question per part; every eleventh name or so is misspelt.
_TEXT = """
SELECT p_partkey AS question_id,
       CASE p_partkey % 6
       WHEN 0 THEN 'Give me the mapping for field ''' || asked || ''''
       WHEN 1 THEN 'Show mapping for ' || replace(asked, ' ', '_') || ' from source ' || r_name
       WHEN 2 THEN 'What is the mapping for ''' || asked || ''' vendor ' || s_name
       WHEN 3 THEN 'Find all mappings in module ' || n_name
       WHEN 4 THEN 'Show dimension ' || CASE WHEN p_partkey % 4 = 0 THEN 'Dim' ELSE 'Meas' END
                   || ' field ' || replace(asked, ' ', '_')
       ELSE 'get me logics for ''' || asked || ''' where source is ' || r_name || ', module is ' || n_name
            || ', source name is ' || p_type || ', vendor is ' || s_name
            || ' and operator is ' || replace(p_brand, '#', '') END AS text
"""
ASKED = """
FROM (SELECT part.*, CASE p_partkey % 11 WHEN 4 THEN substr(p_name, 2) WHEN 7 THEN p_name || 'es'
                                         ELSE p_name END AS asked,
             p_partkey % (SELECT max(s_suppkey) + 1 FROM {supplier}) AS suppkey
      FROM {part} AS part) AS p
     JOIN {supplier} ON suppkey = s_suppkey
     JOIN {nation} ON s_nationkey = n_nationkey
     JOIN {region} ON n_regionkey = r_regionkey
"""

QUESTIONS = _TEXT + ASKED
# What each question asks for, by the columns it was made from. Values end at a blank unless they are quoted.
KNOWN = (
    """
SELECT p_partkey AS question_id,
       lower(CASE p_partkey % 6 WHEN 3 THEN NULL WHEN 1 THEN replace(asked, ' ', '_') WHEN 4 THEN replace(asked, ' ', '_')
             ELSE asked END) AS field,
       CASE WHEN p_partkey % 6 = 4 THEN CASE WHEN p_partkey % 4 = 0 THEN 'dim' ELSE 'meas' END END AS dimension,
       CASE WHEN p_partkey % 6 IN (1, 5) THEN split_part(lower(r_name), ' ', 1) END AS source,
       CASE WHEN p_partkey % 6 IN (3, 5) THEN split_part(lower(n_name), ' ', 1) END AS module,
       CASE WHEN p_partkey % 6 = 5 THEN split_part(lower(p_type), ' ', 1) END AS source_name,
       CASE WHEN p_partkey % 6 IN (2, 5) THEN lower(s_name) END AS vendor,
       CASE WHEN p_partkey % 6 = 5 THEN replace(lower(p_brand), '#', '') END AS operator
"""
    + ASKED
)

# One workbook per order; every tenth was never read.
WORKBOOKS = """
SELECT o_orderkey, '/data/rules/S' || CAST(o_custkey % 5 AS VARCHAR(20)) || '/M/N/V/LdRules/file_'
                   || CAST(o_orderkey AS VARCHAR(20)) || '.xlsx' AS path,
       1000 + o_orderkey % 5000 AS length,
       CAST({epoch} AS DOUBLE) - 3600 + CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 0 END AS mtime
FROM {orders}
"""
MANIFEST = """
SELECT o_orderkey, CAST({epoch} AS DOUBLE) AS timestamp, CAST({epoch} AS DOUBLE) - 3600 AS file_mtime,
       o_custkey % 150 AS data_size,
       CAST(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END AS BIGINT) AS cache_version,
       1000 + o_orderkey % 5000 AS entry_bytes
FROM {orders} WHERE o_orderkey % 10 <> 0
"""


def _epoch(dialect: dict[str, str]) -> str:
    return dialect["epoch"].format("o_orderdate")


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    names = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(text.format(epoch=_epoch(SPARK), **names))


def oracle_text(text: str) -> str:
    return text.format(epoch=_epoch(ORACLE), **{t: t for t in TABLES})


def _with_cells(rows: DataFrame, *columns: str) -> DataFrame:
    """A trailing empty cell is absent, as in a real sheet."""
    full, short = F.array("a", "b", "c", "d"), F.array("a", "b", "c")
    # exploded from a list of one: made once, not again in every filter that reads them
    return rows.select(*columns, F.explode(F.array(F.when(F.col("d").isNull(), short).otherwise(full))).alias("cells"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet rows without their numbers."""
    return spark_sql(spark, sf_dir, CELLS)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the sheet rows, each once."""
    return spark.sql(f"SELECT {_FILE} FROM {{parts}}", parts=spark_sql(spark, sf_dir, FILES))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet rows with their numbers, which the parts of files and cells are given: these are made after."""
    numbered = number_rows(
        spark_sql(spark, sf_dir, LINES), FILE_PARTS, "l_orderkey", ROW_ORDER, NUMBERED_AT_ONCE, "position"
    )
    rows = spark.sql(f"SELECT position + {HEADER_ROWS} AS row_no, {_SHOWN} FROM {{lines}}", lines=numbered)
    return _with_cells(rows, *FOLDER, "file_stem", "row_no")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_rules(grid(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, QUESTIONS)
