import pytest
from pyspark.sql import functions as F

from quillmap.functions import cells
from quillmap.operators.extraction import extract_rules


def test_column_index():
    assert [cells.column_index(c) for c in ("A", "b", "Z", "AA", "xfd", 4)] == [1, 2, 26, 27, 16384, 4]


@pytest.mark.parametrize("label", ["", "A1", "é", 0, -1, 2.0, True, None])
def test_column_index_rejects(label):
    with pytest.raises(ValueError):
        cells.column_index(label)


VALUES = [
    # cell, kept at ingest, valid at query time
    ("\t a \n", "a", True),
    ("\u00a0\u3000a\x1c", "a", True),
    ("-", None, None),
    ("NA", None, None),
    ("N/A", None, None),
    ("   ", None, None),
    (None, None, None),
    ("n/a", "n/a", False),
    ("n/a or 1", "n/a or 1", True),
    ("IF(#REF!,1)", None, None),
    ("x #n/a", None, None),
    ("#Div/0!", None, None),
    ("na", "na", True),
]


def test_cleaning(spark):
    rows = [("s", "m", "n", "v", "f", i + 3, [None, " Dim. ", "name", cell]) for i, (cell, _, _) in enumerate(VALUES)]
    rows += [("s", "m", "n", "v", "f", 2, ["", "h", "h", "h"]), ("s", "m", "n", "v", "f", 99, ["", "d", "short"])]
    grid = spark.createDataFrame(
        rows, "source string, module string, source_name string, vendor string, file_stem string, row_no bigint, cells array<string>"
    )
    kept = {
        r.row_no - 3: (r.expression, r.valid)
        for r in extract_rules(grid).withColumn("valid", cells.is_valid_expression(F.col("expression"))).collect()
    }
    assert kept == {i: (text, valid) for i, (_, text, valid) in enumerate(VALUES) if text is not None}


def test_columns_by_number_and_letter(spark):
    grid = spark.createDataFrame([("f", 1, ["w", "x", "y", "z"])], "file_stem string, row_no bigint, cells array<string>")
    row = extract_rules(grid, left=4, field="a", value="B", header_rows=0).first()
    assert (row.dimension, row.field, row.expression) == ("z", "w", "x")


def test_file_stem(spark):
    names = spark.createDataFrame([("a.b.xlsx",), (".xlsx",), ("plain",), ("X - Copy.XLSX",)], "n string")
    stems = [r[0] for r in names.select(cells.file_stem(F.col("n"))).collect()]
    assert stems == ["a.b", ".xlsx", "plain", "X - Copy"]
