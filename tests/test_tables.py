import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmap.plans import tables as t
from quillmap.plans.store_queries import LISTING, _listing
from quillmap.sources import store

FILE = ["source", "module", "source_name", "vendor", "file_stem"]


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Vendors of one name, names that meet, missing parts of names, negative keys, equal rows."""
    folder = str(tmp_path_factory.mktemp("odd"))
    tables = {
        "region": ([(0, "R0"), (1, None)], "r_regionkey int, r_name string"),
        "nation": ([(0, "N0", 0), (1, "N1", 1), (2, None, 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(-1, "S", 0), (0, "S", 0), (1, None, 0), (2, "T", 1), (3, "T", 2), (4, "S_T", 0)],
                     "s_suppkey bigint, s_name string, s_nationkey int"),
        "part": ([(k, f"p {abs(k) % 3}", b, ty) for k, (b, ty) in enumerate(
            [("Brand#1", "A"), ("Brand1", "A"), ("Brand#1", "A"), (None, "A"), (None, "A"), ("Brand#2", None), ("#", "A_S")], -3)],
            "p_partkey bigint, p_name string, p_brand string, p_type string"),
    }
    lines = [(o % 3, p, s, 1 + (o + p) % 7, float(o % 4), "ANR"[o % 3]) for o in range(4) for p in range(-3, 4) for s in range(-1, 5)]
    tables["lineitem"] = (lines + lines[:40] + [(None, 0, 0, 1, 5.0, "A")],
                          "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string")
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_grid_is_that_of_the_whole_rows(spark, odd_tables):
    rows = t.spark_sql(spark, odd_tables, t.CELLS).na.drop(subset=[*FILE, "l_orderkey"])
    place = F.row_number().over(Window.partitionBy(*FILE).orderBy("l_orderkey", *t.ROW_ORDER)) + t.HEADER_ROWS
    cells = F.when(F.col("d").isNull(), F.array("a", "b", "c")).otherwise(F.array(*"abcd"))
    expected = rows.select(*FILE, place.cast("bigint").alias("row_no"), cells.alias("cells"))
    grid = t.grid(spark, odd_tables)
    assert grid.columns == expected.columns and grid.count() == expected.count() > 50
    assert grid.exceptAll(expected).isEmpty()


def test_files_are_those_of_the_whole_rows(spark, odd_tables):
    expected = t.spark_sql(spark, odd_tables, t.CELLS).select(*FILE).distinct()
    files = t.files(spark, odd_tables)
    assert files.count() == expected.count() and files.exceptAll(expected).isEmpty()
    listed = t.spark_sql(spark, odd_tables, LISTING)
    assert _listing(spark, odd_tables).exceptAll(listed).isEmpty()


def test_cells_are_normalised_once(spark, odd_tables):
    plan = t.rules(spark, odd_tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("btrim") + plan.count("trim(") <= 2 * 3 * 2


def test_entries_of_a_load_do_not_meet_in_one_task(spark, tmp_path):
    rules = spark.createDataFrame(
        [("S", "M", "T", "V", f"LdRules_{i}", 3, "Dim", "f", "e", f"k{i}") for i in range(20)],
        "source string, module string, source_name string, vendor string, file_stem string, row_no bigint,"
        " dimension string, field string, expression string, entry_key string",
    )
    files = rules.selectExpr("entry_key", "file_stem AS file_path", "1.0D AS file_mtime")
    store.write_extractions(rules, files, str(tmp_path), 5.0, "one")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entries = store.read_manifest_table(spark, str(tmp_path))
        plan = entries._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 1
        assert entries.count() == 20 and entries.where("data_size = 1 AND entry_bytes > 0").count() == 20
        assert store.read_key_counts(spark, str(tmp_path)).count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
