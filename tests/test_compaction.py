"""Compaction on real stores: bytes are freed, nothing valid is lost."""

import pytest
from pyspark.sql import functions as F

from quillmap.operators import catalogue
from quillmap.operators.manifest import MEGABYTE, store_size
from quillmap.session import new_shared_path, remove_shared
from quillmap.sources import compaction, search_index, store

COLUMNS = "source string, module string, source_name string, vendor string, file_stem string, row_no bigint, dimension string, field string, expression string, entry_key string"


def write(spark, folder, keys, now, load, text="x", rows=40):
    rules = [("s", "m" + k[-1], "n", "v", "f" + k, j, "d", f"field{j}", f"{text}{k}-{j * 7919}", k) for k in keys for j in range(rows)]
    files = spark.createDataFrame([(k, f"/{k}.xlsx", 1.0) for k in keys], "entry_key string, file_path string, file_mtime double")
    store.write_extractions(spark.createDataFrame(rules, COLUMNS), files, folder, now, load)
    statuses = spark.createDataFrame([(f"/{k}.xlsx", "ok", None) for k in keys], "path string, status string, error string")
    store.write_statuses(statuses, folder, load, now)


def saved(spark, folder):
    return sorted(tuple(r[c] for c in ("entry_key", "row_no", "expression", "operator")) for r in store.read_saved_extractions(spark, folder).collect())


def size_of(spark, folder):
    return store_size(store.stored_files(spark, folder)).first()[0]


@pytest.mark.parametrize("pack_bytes", [3_000, compaction.PACK_BYTES])
def test_budget_frees_bytes_and_keeps_the_newest(spark, pack_bytes):
    folder = new_shared_path(spark, "store")
    for load in range(3):
        write(spark, folder, [f"{load}-{i:02d}" for i in range(30)], float(load), f"load{load}", rows=150)
    before, times = saved(spark, folder), {r.entry_key: r.timestamp for r in store.read_manifest_table(spark, folder).collect()}
    size = size_of(spark, folder)
    budget = 0.6 * size / MEGABYTE
    passes = compaction.enforce_budget(spark, folder, budget, pack_bytes)
    assert passes and size_of(spark, folder) <= 0.8 * budget * MEGABYTE
    left = store.read_manifest_table(spark, folder).collect()
    kept = {r.entry_key for r in left}
    assert kept and {r.entry_key: r.timestamp for r in left} == {k: t for k, t in times.items() if k in kept}
    # the oldest went, and of what stayed not a row is missing
    assert max((times[k], k) for k in times if k not in kept) < min((times[k], k) for k in kept)
    assert saved(spark, folder) == [r for r in before if r[0] in kept]
    assert compaction.enforce_budget(spark, folder, budget, pack_bytes) == []
    packed = {r.load_id for r in left if not r.load_id.startswith("load")}
    assert packed and (len(packed) == 1 or pack_bytes < compaction.PACK_BYTES)


def test_compaction_without_drops_removes_what_was_replaced(spark, tmp_path):
    folder = new_shared_path(spark, "store")
    write(spark, folder, ["a", "b"], 1.0, "one")
    write(spark, folder, ["c"], 2.0, "two")
    write(spark, folder, ["b"], 3.0, "three", text="new")
    write(spark, folder, ["c"], 4.0, "four", text="new")
    index = search_index.update_index(spark, folder, str(tmp_path / "index"))
    before, size = saved(spark, folder), size_of(spark, folder)
    fates = {r.load_id: (r.entries, r.living, r.fate) for r in compaction.compact(spark, folder).collect()}
    assert fates == {"one": (2, 1, "pack"), "two": (1, 0, "remove"), "three": (1, 1, "keep"), "four": (1, 1, "keep")}
    assert saved(spark, folder) == before and size_of(spark, folder) < size
    loads = {r.load_id for r in store.stored_files(spark, folder).where("kind = 'rules'").collect()}
    assert "one" not in loads and "two" not in loads and {"three", "four"} < loads and len(loads) == 3
    # the status of a.xlsx is known from load one alone
    assert {r.load_id for r in store.read_statuses(spark, folder).collect()} == {"one", "three", "four"}
    index = search_index.update_index(spark, folder, str(tmp_path / "index"))
    assert index.entries().where(F.col("segment") == max(index.segments)).count() > 0  # moved entries are followed


def test_entries_read_again_go_before_any_other(spark):
    folder = new_shared_path(spark, "store")
    keys = [f"{i:02d}" for i in range(20)]
    write(spark, folder, keys, 1.0, "one", rows=100)
    write(spark, folder, keys, 2.0, "two", text="new", rows=100)
    before, size = saved(spark, folder), size_of(spark, folder)
    compaction.enforce_budget(spark, folder, 0.7 * size / MEGABYTE)
    assert saved(spark, folder) == before and size_of(spark, folder) <= 0.7 * size


def test_counts_by_load_equal_a_full_recount(spark):
    folder = new_shared_path(spark, "store")

    def same():
        rules = store.read_saved_extractions(spark, folder)
        counts = store.read_key_counts(spark, folder)
        assert "/rules" not in counts._jdf.queryExecution().optimizedPlan().toString() + str(counts.inputFiles())
        for count in (catalogue.file_mapping_count, catalogue.folder_mapping_count):
            one, other = (sorted(map(tuple, count(r, rules).collect())) for r in (rules, counts))
            assert one == other and one

    write(spark, folder, ["a1", "b2"], 1.0, "one", rows=3)
    same()
    write(spark, folder, ["b2", "c1"], 2.0, "two", rows=5)  # b2 read again, with more fields
    same()
    compaction.compact(spark, folder)
    same()
    remove_shared(spark, f"{folder}/keys/load_id=two")  # a load from before the table
    rules = store.read_saved_extractions(spark, folder)
    one, other = (sorted(map(tuple, catalogue.folder_mapping_count(r, rules).collect())) for r in (rules, store.read_key_counts(spark, folder)))
    assert one == other


def test_a_dropped_key_does_not_come_back(spark):
    folder = new_shared_path(spark, "store")
    write(spark, folder, ["a", "b"], 1.0, "one", text="old")
    write(spark, folder, ["a", "c"], 2.0, "two")
    compaction.compact(spark, folder, spark.createDataFrame([("a",)], "entry_key string"))
    assert {r[0] for r in saved(spark, folder)} == {"b", "c"}
    assert {r.entry_key for r in store.read_manifest_table(spark, folder).collect()} == {"b", "c"}


def test_an_interrupted_compaction_loses_nothing(spark, monkeypatch):
    folder = new_shared_path(spark, "store")
    write(spark, folder, ["a", "b"], 1.0, "one")
    write(spark, folder, ["b"], 2.0, "two", text="new")
    before = saved(spark, folder)

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(compaction, "_remove_loads", fail)
        with pytest.raises(RuntimeError):
            compaction.compact(spark, folder)
    assert saved(spark, folder) == before
    compaction.compact(spark, folder)
    assert saved(spark, folder) == before
    assert "one" not in {r.load_id for r in store.stored_files(spark, folder).where("kind <> 'statuses'").collect()}


def test_the_last_errors_stay(spark):
    folder = new_shared_path(spark, "store")
    write(spark, folder, ["a"], 1.0, "one")
    failed = spark.createDataFrame([("/a.xlsx", "error", "broken"), ("/z.xlsx", "error", "broken")], "path string, status string, error string")
    store.write_statuses(failed, folder, "failed", 2.0)
    assert store.superseded_loads(spark, folder).count() == 0
    store.write_statuses(failed, folder, "failed again", 3.0)
    assert [r.load_id for r in store.superseded_loads(spark, folder).collect()] == ["failed"]


def test_empty_store(spark):
    folder = new_shared_path(spark, "store")
    assert compaction.compact(spark, folder).collect() == [] and compaction.enforce_budget(spark, folder) == []
