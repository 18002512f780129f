import pytest
from pyspark.sql import functions as F

from quillmap.operators import manifest as mf
from quillmap.schemas import MANIFEST
from quillmap.sources.manifest import parse_meta, read_meta_files

NOW = 1_000_000.0
HOUR = 3600.0


def _entries(spark, *rows):
    """(key, timestamp, file_mtime, version, bytes)"""
    full = [(k, f"/{k}", mtime, ts, 1, version, size, "l") for k, ts, mtime, version, size in rows]
    return spark.createDataFrame(full, MANIFEST)


def test_validity(spark):
    manifest = _entries(
        spark,
        ("edge", NOW - 24 * HOUR, 10.0, 2, 5), ("old", NOW - 24 * HOUR - 1, 10.0, 2, 5),
        ("same", NOW, 10.0, 2, 5), ("newer", NOW, 9.0, 2, 5), ("v1", NOW, 10.0, 1, 5),
        ("none", NOW, 10.0, None, 5), ("lost", NOW, 10.0, 2, None), ("broken", None, 10.0, 2, 5),
        ("twice", NOW - 30 * HOUR, 10.0, 2, 5), ("twice", NOW, 10.0, 2, 5),
    )
    keys = ["edge", "old", "same", "newer", "v1", "none", "lost", "broken", "twice", "unseen"]
    files = spark.createDataFrame([(k, f"/{k}", 10.0) for k in keys], "entry_key string, path string, mtime double")
    validity = mf.manifest_validity(files, manifest, NOW)
    assert {r.entry_key: r.reason for r in validity.collect()} == {
        "edge": "valid", "old": "expired", "same": "valid", "newer": "modified", "v1": "old_version",
        "none": "old_version", "lost": "missing", "broken": "missing", "twice": "valid", "unseen": "missing",
    }
    todo = {r.entry_key for r in mf.files_to_extract(files, validity).collect()}
    assert todo == set(keys) - {"edge", "same", "twice"}
    stats = mf.ingest_stats(
        validity, spark.createDataFrame([("a", "ok"), ("b", "error")], "path string, status string"),
        spark.createDataFrame([(1_500_000,)], "length bigint"),
    ).first()
    assert stats.asDict() == {
        "hits": 3, "misses": 7, "hit_rate_percent": 30.0, "files_processed": 1, "errors": 1, "store_mb": 1.43,
    }


def test_stats_without_requests(spark):
    empty = spark.createDataFrame([], "path string, status string, reason string")
    stats = mf.ingest_stats(empty, empty, spark.createDataFrame([], "length bigint")).first()
    assert (stats.hits, stats.hit_rate_percent, stats.store_mb) == (0, 0.0, 0.0)


def test_expired(spark):
    manifest = _entries(spark, ("edge", NOW - 24 * HOUR, 1.0, 2, 5), ("old", NOW - 24 * HOUR - 1, 1.0, 2, 5))
    assert [r.entry_key for r in mf.expired_entries(manifest, NOW).collect()] == ["old"]


@pytest.mark.parametrize(
    "budget, orphans, dropped",
    [(10, [], {"a", "b"}), (15, [], set()), (14, [], {"a"}), (10, [100], {"a", "b", "c"}), (20, [5], set())],
)
def test_retention(spark, budget, orphans, dropped):
    """Budgets and sizes in megabytes; a budget of 10 leaves 8."""
    mb = mf.MEGABYTE
    entries = [("c", 3.0, 1.0, 2, 5 * mb), ("a", 1.0, 1.0, 2, 5 * mb), ("b", 2.0, 1.0, 2, 5 * mb)]
    manifest = _entries(spark, *entries, ("gone", 0.0, 1.0, 2, None))
    stored = spark.createDataFrame([(5 * mb,)] * 3 + [(o * mb,) for o in orphans], "length bigint")
    plan = mf.retention_plan(manifest, stored, budget)
    assert {r.entry_key for r in plan.where("dropped").collect()} == dropped


def test_extraction_key(spark):
    files = spark.createDataFrame([("/a", 1), ("/a", 2), ("/b", 1), ("/a", None), ("/a", 0)], "p string, n bigint")
    key = lambda **params: [r[0] for r in files.select(mf.extraction_key(F.col("p"), F.col("n"), params)).collect()]
    first, other = key(), key(sheet="Extra")
    assert len(set(first)) == 4 and first[3] == first[4] and first == key()
    assert not set(first) & set(other)


def test_meta_files(spark, tmp_path):
    good = '{"timestamp": 1.5, "file_mtime": 2.5, "file_path": "C:\\\\x", "data_size": 3, "cache_version": 2}'
    (tmp_path / "k1.meta").write_text(good)
    (tmp_path / "k2.meta").write_text('{"timestamp": 1.5, "file_')
    (tmp_path / "k3.meta").write_text('{"timestamp": 4, "file_mtime": 1, "file_path": "p", "data_size": 0}')
    (tmp_path / "k1.cache").write_text("not an entry")
    got = {r.entry_key: r for r in parse_meta(read_meta_files(spark, str(tmp_path))).collect()}
    assert {k: r.readable for k, r in got.items()} == {"k1": True, "k2": False, "k3": True}
    assert (got["k1"].timestamp, got["k1"].file_path, got["k1"].cache_version) == (1.5, "C:\\x", 2)
    assert got["k3"].cache_version is None and got["k2"].timestamp is None
