import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmap.operators.manifest import MEGABYTE, retention_plan, store_size
from quillmap.plans.workbook_tables import NAMESPACE, workbook_bytes
from quillmap.session import new_shared_path
from quillmap.sources import store, xlsx
from quillmap.sources import workbooks as wb
from quillmap.sources.xlsx import SheetNotFound, sheet_rows
from quillmap.streaming.ingest import stream_new_workbooks, workbook_stream

ROWS = [(1, ["", "h", "h", "h"]), (2, ["", "h", "h", "h"]), (3, ["1", "Dim.", "f1", "a+b"]), (5, ["2", "Meas.", "f 2", "n/a"])]


def _with_sheet(cells, styles=""):
    """A one-row sheet given as XML."""
    out = io.BytesIO(workbook_bytes({"S": []}))
    with zipfile.ZipFile(out, "a") as book:
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{NAMESPACE}"><sheetData>{cells}</sheetData></worksheet>')
        if styles:
            book.writestr("xl/styles.xml", f'<styleSheet xmlns="{NAMESPACE}">{styles}</styleSheet>')
    content = out.getvalue()
    return content


def test_round_trip():
    assert [(n, c) for n, c in sheet_rows(workbook_bytes({"S": ROWS}), 0, 4)] == [
        (1, ["", "h", "h", "h"]), (2, ["", "h", "h", "h"]), (3, ["1", "Dim.", "f1", "a+b"]), (5, ["2", "Meas.", "f 2", "n/a"]),
    ]


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_cell_kinds():
    styles = (
        '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd &quot;d&quot;"/><numFmt numFmtId="165" formatCode="[Red]0.0"/>'
        '<numFmt numFmtId="166" formatCode="[h]:mm"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/><xf numFmtId="20"/></cellXfs>'
    )
    cells = "".join(
        f"<c {c}</c>" for c in (
            "><v>5</v>", "><v>2.50</v>", "><v>1E-3</v>", 't="b"><v>1</v>', 't="e"><v>#REF!</v>', 't="str"><v>x</v>',
            's="1"><v>45293</v>', 's="2"><v>45293.5</v>', 's="3"><v>7</v>', 's="4"><v>1.25</v>', 's="5"><v>0.25</v>',
            't="inlineStr"><is><r><t>ri</t></r><r><t>ch</t></r></is>', "><f>A1</f>", 's="1"><v>1</v>',
        )
    )
    (row,) = sheet_rows(_with_sheet(f'<row>{cells}</row>', styles), 0, 20)
    assert row == (1, [
        "5", "2.5", "0.001", "True", "#REF!", "x", "2024-01-02 00:00:00", "2024-01-02 12:00:00", "7",
        "1 day, 6:00:00", "06:00:00", "rich", None, "1900-01-01 00:00:00",
    ])


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_gaps_are_padded():
    rows = list(sheet_rows(_with_sheet('<row r="2"><c r="B2"><v>1</v></c><c r="D2"><v>2</v></c></row><row><c r="A3"><v>3</v></c></row>'), 0, 3))
    assert rows == [(2, [None, "1", None]), (3, ["3"])]


def test_sheets():
    book = workbook_bytes({"One": ROWS[:1], "Two": ROWS[2:3]})
    assert [n for n, _ in sheet_rows(book, 1, 4)] == [3] == [n for n, _ in sheet_rows(book, "Two", 4)]
    for missing in (2, -1, "Three", "two"):
        with pytest.raises(SheetNotFound):
            list(sheet_rows(book, missing, 4))


def _tree(root, files):
    for path, content in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)


FOLDER = "RA/UC/IN ADJ/Nokia/LdRules"


def test_tree(spark, tmp_path):
    good = workbook_bytes({"S": ROWS})
    _tree(tmp_path, {
        f"{FOLDER}/LdRules_DU [1].xlsx": good, f"{FOLDER}/B.XLSX": good, f"{FOLDER}/~$B.xlsx": good,
        f"{FOLDER}/c.xls": good, f"{FOLDER}/deeper/d.xlsx": good, "RA/UC/IN ADJ/Nokia/Other/e.xlsx": good,
        "RA/f.xlsx": good, "RA/UC/IN ADJ/Huawei/LdRules/broken.xlsx": good[:200], "RA/UC/IN ADJ/Huawei/LdRules/text.xlsx": b"x",
    })
    files = wb.read_workbook_files(spark, str(tmp_path))
    listing = wb.with_folder_levels(wb.keep_workbooks(files)).select("vendor", "source_name", "file_stem")
    assert {tuple(r) for r in listing.collect()} == {
        ("Nokia", "IN ADJ", "LdRules_DU [1]"), ("Nokia", "IN ADJ", "B"), ("Huawei", "IN ADJ", "broken"), ("Huawei", "IN ADJ", "text"),
    }
    assert {(r.vendor, r.files) for r in wb.rule_folders(files).collect()} == {("Nokia", 3), ("Huawei", 2)}
    decoded = wb.decode_workbooks(wb.keep_workbooks(files))
    assert sorted(r.status for r in wb.file_statuses(decoded).collect()) == ["error", "error", "ok", "ok"]
    assert wb.sheet_grid(decoded).groupBy("file_stem").count().orderBy("file_stem").collect() == [("B", 4), ("LdRules_DU [1]", 4)]
    plan = files.select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_no_rule_folders(spark, tmp_path):
    assert wb.read_workbook_files(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        wb.read_workbook_files(spark, str(tmp_path / "nowhere"))


def test_incremental_ingest(spark, tmp_path):
    root, folder = tmp_path / "root", new_shared_path(spark, "store")
    book = lambda text: workbook_bytes({"S": [*ROWS[:2], (3, ["", "Dim.", "f", text])]})
    _tree(root, {f"{FOLDER}/a[1].xlsx": book("one"), f"{FOLDER}/b.xlsx": book("two"), f"{FOLDER}/empty.xlsx": workbook_bytes({"S": ROWS[:2]})})

    def run(now, **options):
        found = store.ingest(spark, str(root), folder, now, **options)
        reasons = {r.file_stem: r.reason for r in found["validity"].collect()}
        expressions = sorted(r.expression for r in found["rules"].collect())
        return reasons, found["statuses"].count(), expressions

    import time
    now = time.time()
    assert run(now) == ({"a[1]": "missing", "b": "missing", "empty": "missing"}, 3, ["one", "two"])
    assert run(now + 60) == ({"a[1]": "valid", "b": "valid", "empty": "valid"}, 0, ["one", "two"])
    _tree(root, {f"{FOLDER}/a[1].xlsx": book("one, changed"), "FMS/M/N/V/LdRules/new.xlsx": book("three")})
    reasons, read, rules = run(now + 120)
    assert (reasons["b"], reasons["empty"], reasons["new"], read) == ("valid", "valid", "missing", 2)
    assert rules == ["one, changed", "three", "two"]
    manifest = store.read_manifest_table(spark, folder)
    assert {r.file_path.rsplit("/", 1)[1]: r.data_size for r in manifest.collect()}["empty.xlsx"] == 0
    assert run(now + 120 + 25 * 3600)[1] == 4
    assert run(now + 120 + 25 * 3600 + 1)[1:] == (0, ["one, changed", "three", "two"])


def test_file_that_is_gone_when_it_is_opened(spark, tmp_path, monkeypatch):
    root, folder = tmp_path / "root", new_shared_path(spark, "store")
    _tree(root, {f"{FOLDER}/{name}": workbook_bytes({"S": ROWS}) for name in ("a b%20#1.xlsx", "gone.xlsx", "bad.xlsx")})
    (root / FOLDER / "bad.xlsx").write_bytes(b"zzz")
    planned = store.files_to_extract

    def delete_first(listing, validity):
        (root / FOLDER / "gone.xlsx").unlink(missing_ok=True)
        return planned(listing, validity)

    monkeypatch.setattr(store, "files_to_extract", delete_first)
    found = store.ingest(spark, str(root), folder, 1_000.0)
    statuses = {r.path.rsplit("/", 1)[1]: (r.status, r.error) for r in found["statuses"].collect()}
    assert {name: s for name, (s, _) in statuses.items()} == {"a b%20#1.xlsx": "ok", "gone.xlsx": "error", "bad.xlsx": "error"}
    assert "FileNotFound" in statuses["gone.xlsx"][1]
    assert {r.file_stem for r in found["rules"].collect()} == {"a b%20#1"}


def test_rules_without_manifest_entry_do_not_count(spark):
    folder = new_shared_path(spark, "store")
    rule = ("s", "m", "n", "v", "f", 3, "d", "x", "e", "key")
    rules = spark.createDataFrame([rule], "source string, module string, source_name string, vendor string, file_stem string, row_no bigint, dimension string, field string, expression string, entry_key string")
    rules.withColumn("load_id", F.lit("failed")).write.partitionBy("load_id", "source", "module").parquet(f"{folder}/rules")
    assert store.read_saved_extractions(spark, folder).count() == 0
    files = spark.createDataFrame([("key", "/f", 1.0)], "entry_key string, file_path string, file_mtime double")
    store.write_extractions(rules, files, folder, 5.0)
    store.write_extractions(rules, files, folder, 6.0)
    assert store.read_saved_extractions(spark, folder).count() == 1


def test_old_rows_get_a_filename(spark):
    schema = "source string, module string, source_name string, vendor string, dimension string, field string, expression string"
    old = spark.createDataFrame([("s", "m", "n", "v", "d", "x", "e1"), ("s", "m", "n", "v", "d", "y", "e2")], schema)
    new = spark.createDataFrame([("s", "m", "n", "v", "d", "x", "e3", "file")], schema + ", file_stem string")
    filled = store.fill_filenames(store.upgrade_old_extractions(old, new))
    assert {(r.expression, r.file_stem) for r in filled.collect()} == {("e1", "file"), ("e2", "Unknown"), ("e3", "file")}


def test_stream_reads_every_file_once(spark, tmp_path):
    root, folder, offsets = tmp_path / "root", new_shared_path(spark, "store"), new_shared_path(spark, "offsets")
    book = lambda text: workbook_bytes({"S": [*ROWS[:2], (3, ["", "Dim.", "f", text])]})

    def run():
        stream_new_workbooks(workbook_stream(spark, str(root)), folder, offsets, clock=lambda: 7.0).awaitTermination()
        statuses = {r.path.rsplit("/", 1)[1]: r.status for r in store.read_statuses(spark, folder).collect()}
        return sorted(r.expression for r in store.read_saved_extractions(spark, folder).collect()), statuses

    _tree(root, {f"{FOLDER}/a.xlsx": book("one"), f"{FOLDER}/bad.xlsx": b"zzz"})
    assert run() == (["one"], {"a.xlsx": "ok", "bad.xlsx": "error"})
    _tree(root, {f"{FOLDER}/b.xlsx": book("two")})
    assert run() == (["one", "two"], {"a.xlsx": "ok", "bad.xlsx": "error", "b.xlsx": "ok"})
    assert run()[0] == ["one", "two"]
    assert {r.load_id for r in store.read_manifest_table(spark, folder).collect()} == {"stream-0", "stream-1"}


def test_a_repeated_load_counts_once(spark):
    folder = new_shared_path(spark, "store")
    rule = ("s", "m", "n", "v", "f", 3, "d", "x", "e", "key")
    rules = spark.createDataFrame([rule], "source string, module string, source_name string, vendor string, file_stem string, row_no bigint, dimension string, field string, expression string, entry_key string")
    files = spark.createDataFrame([("key", "/f", 1.0)], "entry_key string, file_path string, file_mtime double")
    for _ in range(2):
        store.write_extractions(rules, files, folder, 5.0, "load-1")
    assert store.read_saved_extractions(spark, folder).count() == 1
    assert store.read_manifest_table(spark, folder).count() == 1
    assert store.superseded_loads(spark, folder).count() == 0
    store.write_extractions(rules, files, folder, 6.0, "load-2")
    assert [r.load_id for r in store.superseded_loads(spark, folder).collect()] == ["load-1"]


def test_retention_counts_what_is_stored(spark):
    folder = new_shared_path(spark, "store")
    schema = "source string, module string, source_name string, vendor string, file_stem string, row_no bigint, dimension string, field string, expression string, entry_key string"
    for load in range(4):
        keys = [f"{load}-{i}" for i in range(30)]
        rules = spark.createDataFrame([("s", "m", "n", "v", "f", j, "d", f"x{j}", k * 9, k) for k in keys for j in range(40)], schema)
        files = spark.createDataFrame([(k, f"/{k}", 1.0) for k in keys], "entry_key string, file_path string, file_mtime double")
        store.write_extractions(rules, files, folder, float(load))
    entries, stored = store.read_manifest_table(spark, folder), store.stored_files(spark, folder)
    size = store_size(stored).first()[0]
    assert 0.97 * size <= entries.agg(F.sum("entry_bytes")).first()[0] <= size
    plan = retention_plan(entries, stored, 0.9 * size / MEGABYTE).collect()
    gone = [r for r in plan if r.dropped]
    left = size - sum(r.entry_bytes for r in gone)
    assert left <= 0.8 * 0.9 * size < left + max(r.entry_bytes for r in gone)
    assert max(r.timestamp for r in gone) <= min(r.timestamp for r in plan if not r.dropped)


def test_executors_need_not_have_the_package(tmp_path):
    """The package is known to the driver alone, as under spark-submit without --py-files."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    script = tmp_path / "job.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "from quillmap.session import local_session\n"
        "from quillmap.plans.workbook_tables import workbook_bytes\n"
        "from quillmap.sources.workbooks import decode_workbooks\n"
        "book = workbook_bytes({'S': [(1, ['1', 'a', 'b', 'c'])]})\n"
        "spark = local_session(1)\n"
        "files = spark.createDataFrame([('/x.xlsx', bytearray(book))], 'path string, content binary')\n"
        "print('rows', decode_workbooks(files).where('row_no = 1').count())\n"
    )
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "rows 1" in done.stdout, done.stderr[-2000:]


def test_short_sheets_are_parsed_at_once_to_the_same_rows(monkeypatch):
    from quillmap.sources import xlsx

    book = workbook_bytes({"S": [*ROWS, (40, ["7", None, "", "x"])]})
    spaced = _with_sheet('<row r="2"><c r="b2"><v>1</v></c><c r="AB2"><v>2</v></c></row><row/><row r="9"><c r="A9"/></row>')
    whole = [list(sheet_rows(b, 0, 4)) for b in (book, spaced)]
    with monkeypatch.context() as m:
        m.setattr(xlsx, "STREAMED_FROM", 0)
        assert [list(sheet_rows(b, 0, 4)) for b in (book, spaced)] == whole
    monkeypatch.delattr(xlsx.ElementTree, "iterparse")
    assert [list(sheet_rows(b, 0, 4)) for b in (book, spaced)] == whole


def _parts(content):
    try:
        with xlsx._Archive(content) as book:
            return [(name, book.read(name), book.size(name)) for name in book.namelist()]
    except Exception as e:
        return type(e).__name__, str(e)


def test_plain_archives_need_no_zipfile_and_others_read_as_it_reads_them(monkeypatch):
    plain = workbook_bytes({"S": ROWS, "T": ROWS[:1]})
    assert zipfile.ZipFile(io.BytesIO(plain)).testzip() is None
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as book:
        book.comment = b"a comment"
        book.writestr("bé", b"x" * 3_000)
        book.writestr(zipfile.ZipInfo("stored"), b"as it is")
    stored = io.BytesIO()
    with zipfile.ZipFile(stored, "w") as book:
        book.writestr("stored", b"as it is")
        book.writestr("twice", b"1")
    rng, cases = random.Random(4), [plain, made.getvalue(), stored.getvalue(), b"", b"PK", b"head" + plain, plain + b"tail", plain[:-30]]
    for content in cases[:3] * 200:
        damaged = bytearray(content)
        for _ in range(rng.choice((1, 2, 5))):
            damaged[rng.randrange(len(damaged))] = rng.randrange(256)
        cases.append(bytes(damaged))
    got = [_parts(c) for c in cases]
    expected = [(n, c) for n, c in sheet_rows(plain, 0, 4)]
    with monkeypatch.context() as m:
        m.setattr(xlsx._Archive, "_plain_members", lambda self: None)
        assert got == [_parts(c) for c in cases]
        assert [(n, c) for n, c in sheet_rows(plain, 0, 4)] == expected
    monkeypatch.setattr(zipfile, "ZipFile", None)
    assert [(n, c) for n, c in sheet_rows(plain, 0, 4)] == expected
