import os

import pytest

from quillmap.plans.workbook_tables import workbook_bytes
from quillmap.session import new_shared_path
from quillmap.sources import store, tree
from quillmap.sources import workbooks as wb
from quillmap.streaming.changes import changed_files, stream_changed_workbooks
from tests.test_workbooks import FOLDER, ROWS, _tree

EMPTY = "RA/UC/IN ADJ/Huawei/LdRules"


def book(text):
    return workbook_bytes({"S": [*ROWS[:2], (3, ["", "Dim.", "f", text])]})


def test_listing_is_that_of_the_file_source(spark, tmp_path):
    files = {f"{FOLDER}/a [1].xlsx": b"x", f"{FOLDER}/deeper/d.xlsx": b"xx", "RA/UC/IN ADJ/Nokia/Other/e.xlsx": b"x", "RA/f.xlsx": b"x", "S/M/N/V/LdRules/b.xlsx": b"yyy"}
    _tree(tmp_path, files)
    (tmp_path / EMPTY).mkdir(parents=True)
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        found = tree.read_tree(spark, root)
        ours = {(r.path, r.length, r.modificationTime) for r in tree.tree_files(found).collect()}
        listed = wb.read_workbook_files(spark, str(tmp_path)).select("path", "length", "modificationTime").collect()
        milli = lambda t: t.replace(microsecond=t.microsecond // 1000 * 1000)
        assert {(p, n, milli(t)) for p, n, t in ours} == {(r.path, r.length, milli(r.modificationTime)) for r in listed} and len(ours) == 2
        folders = tree.with_levels(tree.folder_statuses(found), root).collect()
        assert sorted((r.source, r.vendor, r.status, r.files) for r in folders) == [("RA", "Huawei", "ok", 0), ("RA", "Nokia", "ok", 1), ("S", "V", "ok", 1)]


def test_a_folder_that_cannot_be_listed_is_a_row(tmp_path, monkeypatch):
    for source in "AB":
        for vendor in "VW":
            _tree(tmp_path, {f"{source}/M/N/{vendor}/LdRules/x.xlsx": b"x"})
    listed = tree.Tree.children

    def children(self, place):
        if place.path.endswith(bad):
            raise PermissionError(13, "Permission denied")
        return listed(self, place)

    monkeypatch.setattr(tree.Tree, "children", children)
    for bad, left in (("A", 2), ("A/M", 2), ("A/M/N", 2), ("A/M/N/V", 3), ("A/M/N/V/LdRules", 3)):
        reader = tree.TreeReader(str(tmp_path))
        rows = [row for part in reader.partitions() for row in reader.read(part)]
        errors = [r for r in rows if r[4] == "error"]
        assert [r[1] for r in errors] == [f"file:{tmp_path}/{bad}"] and "Permission denied" in errors[0][5]
        assert len([r for r in rows if r[0] == "file"]) == left
    bad = str(tmp_path)
    with pytest.raises(PermissionError):
        tree.TreeReader(str(tmp_path)).partitions()


def test_empty_and_missing_roots(spark, tmp_path):
    assert tree.read_tree(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        tree.read_tree(spark, str(tmp_path / "nowhere")).count()


def test_ingest_of_a_walked_tree(spark, tmp_path):
    _tree(tmp_path, {f"{FOLDER}/a.xlsx": book("one"), f"{FOLDER}/~$a.xlsx": b"", "S/M/N/V/LdRules/b.xlsx": book("two")})
    folder = new_shared_path(spark, "store")
    walked = lambda: tree.tree_files(tree.read_tree(spark, str(tmp_path)))
    found = store.ingest(spark, str(tmp_path), folder, 4e9, files=walked())
    assert sorted(r.expression for r in found["rules"].collect()) == ["one", "two"]
    again = store.ingest(spark, str(tmp_path), folder, 4e9 + 1)  # listed by Spark: the same keys
    assert {r.reason for r in again["validity"].collect()} == {"valid"}


def test_stream_reads_what_changes(spark, tmp_path):
    root, folder, checkpoint = tmp_path / "root", new_shared_path(spark, "store"), new_shared_path(spark, "offsets")
    times = iter(range(1, 100))

    def run():
        before = {r.load_id for r in store.read_statuses(spark, folder).collect()}
        files = tree.tree_files(tree.tree_stream(spark, str(root)))
        stream_changed_workbooks(files, folder, checkpoint, clock=lambda: float(next(times))).awaitTermination()
        read = [r.path.rsplit("/", 1)[1] for r in store.read_statuses(spark, folder).collect() if r.load_id not in before]
        current = store.entries_of_paths(spark, folder)
        return sorted(read), sorted(r.expression for r in store.read_saved_extractions(spark, folder, current).collect())

    _tree(root, {f"{FOLDER}/a.xlsx": book("one"), f"{FOLDER}/b.xlsx": book("two"), f"{FOLDER}/bad.xlsx": b"zzz"})
    assert run() == (["a.xlsx", "b.xlsx", "bad.xlsx"], ["one", "two"])
    assert run() == ([], ["one", "two"])
    _tree(root, {f"{FOLDER}/a.xlsx": book("one and longer"), "S/M/N/V/LdRules/c.xlsx": book("three")})
    os.utime(root / FOLDER / "bad.xlsx", (5, 5))
    assert run() == (["a.xlsx", "bad.xlsx", "c.xlsx"], ["one and longer", "three", "two"])
    same = book("one and LONGER")
    _tree(root, {f"{FOLDER}/a.xlsx": same})
    os.utime(root / FOLDER / "a.xlsx", (9, 9))
    assert run() == (["a.xlsx"], ["one and LONGER", "three", "two"])
    assert run() == ([], ["one and LONGER", "three", "two"])


def test_changes_within_a_batch_and_of_missing_values(spark):
    arrived, out, checkpoint = (new_shared_path(spark, n) for n in ("arrived", "out", "offsets"))
    schema = "path string, modificationTime timestamp, length bigint, other string"

    def run(*rows):
        rows = [(p, t, n, "x") for p, t, n in rows]
        frame = spark.createDataFrame(rows, "path string, t bigint, length bigint, other string")
        frame.selectExpr("path", "timestamp_seconds(t) AS modificationTime", "length", "other").coalesce(1).write.mode("append").parquet(arrived)
        stream = changed_files(spark.readStream.schema(schema).parquet(arrived))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted((tuple(r) for r in spark.read.parquet(out).selectExpr("path", "unix_seconds(modificationTime)", "length").collect()), key=str)

    assert run(("a", 1, 5), ("a", 2, 4), ("a", 2, 6), ("n", None, None), (None, 1, 1)) == [("a", 2, 6), ("n", None, None)]
    assert run(("a", 2, 6), ("n", None, None)) == [("a", 2, 6), ("n", None, None)]
    assert run(("a", 1, 6), ("n", None, 3)) == [("a", 1, 6), ("a", 2, 6), ("n", None, 3), ("n", None, None)]
