"""Operators that look at other rows of an order or a sum: mixing, revisits, fingerprints."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillmap.llm import fingerprint, mixing, revisits
from tests.llm.conftest import prose

# mixing


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, at_limit = {}, set()
    while True:
        left = sum(sizes.values()) - 3 * sum(sizes[s] for s in at_limit)
        rest = sum(weight[s] for s in order if s not in at_limit)
        target = {s: 3 * sizes[s] if s in at_limit else left * weight[s] / rest for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s]} - at_limit
        if not over:
            return target
        at_limit |= over


def mixed(docs):
    return mixing.mix_sources(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()


def check_mix(rows):
    sizes, taken, largest = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    expected = targets_by_hand(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - expected[r.source]) < 1e-6
        assert r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= largest[s] / 2 + 1e-6


def test_mix_hot_and_small_sources(spark):
    rng = random.Random(2)
    names = ["big"] * 300 + ["small"] * 6 + [None] * 40 + ["Z"] * 80 + ["é"] * 9 + ["none"]
    rows = [(i, "" if n == "none" else prose(rng, rng.randrange(1, 60)), n) for i, n in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixed(docs)
    assert len(got) == len(rows)
    check_mix(got)
    again = mixed(docs.repartition(2))
    assert sorted(map(str, got)) == sorted(map(str, again))
    by_id = {r.doc_id: r for r in got}
    out = mixing.take_mix(docs).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, r in by_id.items() if r["size"] for _ in range(r.taken // r["size"]))


def test_mix_awkward(awkward, empty):
    rows = mixing.mix_sources(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert set(mixing.take_mix(awkward).columns) == set(awkward.columns)
    assert mixing.mix_sources(empty).count() == 0 and mixing.take_mix(empty).count() == 0


def test_mix_ties_go_together(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 9 + [(2, "d e", "t")] * 4, "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == 13 and len({(r.doc_id, r.taken) for r in rows}) == 2


# revisits


def record(i, url, at, kind, headers, digest=None):
    return (i, url, at, kind, headers, digest)


RECORD = "record_id long, url string, captured_at long, kind string, headers map<string,string>, digest string"


@pytest.mark.parametrize(
    "one, other",
    [
        ("http://www.Example.org:80/a/", "https://example.org/a#top"),
        ("https://example.org/a?b=2&a=1&utm_source=x", "http://example.org/a?a=1&b=2"),
        ("https://example.org/a?ref=y", "//example.org/a/?gclid=4"),
    ],
)
def test_canonical_url(spark, one, other):
    keys = spark.createDataFrame([(one,), (other,)], "url string").select(revisits.canonical_url(F.col("url"))).collect()
    assert keys[0][0] == keys[1][0]


def test_revisits_by_hand(spark):
    own = {"ETag": '"a"', "Last-Modified": "m", "Content-Type": "text/html", "Content-Length": "9", "X": "1"}
    rows = [
        record(1, "http://a.org/p", 100, "response", own, "d1"),
        record(2, "http://a.org/p", 200, "response", {**own, "ETag": '"b"'}, "d2"),
        record(3, "https://www.a.org/p/", 9_000, "revisit", {"etag": 'W/"b"', "content-length": "0", "x": "2", "Date": "t"}),
        record(4, "http://a.org/p", 150, "revisit", {"etag": '"b"'}),
        record(5, "http://a.org/p", 50, "revisit", {"etag": '"a"'}),
        record(6, "http://a.org/p", 210, "revisit", {"last-modified": "m"}),
        record(7, "http://a.org/p", 220, "revisit", {}),
        record(8, None, 220, "revisit", None),
        record(9, "http://a.org/p", None, "revisit", {"etag": '"a"'}),
        record(6, "http://a.org/p", 210, "revisit", {"last-modified": "m"}),
        record(None, "http://b.org", 1, "response", None, None),
        record(10, "http://b.org", 2, "revisit", {"etag": "q"}),
    ]
    got = {r.record_id: r for r in revisits.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()}
    outcome = {i: r.outcome for i, r in got.items()}
    assert outcome == {3: "resolved", 4: "mismatch", 5: "no_response", 6: "resolved", 7: "unchecked", 8: "no_response", 9: "no_response", 10: "unchecked"}
    assert got[3].headers == {"etag": 'W/"b"', "last-modified": "m", "content-type": "text/html", "content-length": "9", "x": "2", "date": "t"}
    assert (got[3].response_id, got[3].digest, got[4].response_id, got[4].digest) == (2, "d2", 1, None)
    assert revisits.resolve_revisits(spark.createDataFrame(rows, RECORD)).count() == 9
    assert revisits.resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0


@pytest.mark.parametrize("slice_seconds", [1, 7, 10_000])
def test_revisits_brute_force(spark, slice_seconds):
    rng = random.Random(8)
    urls = ["http://hot.org/"] * 6 + [f"http://u{i}.org/" for i in range(5)]
    rows = [
        record(i, rng.choice(urls), rng.randrange(60), rng.choice(["response", "revisit"]), {"etag": rng.choice("ab")}, f"d{i}")
        for i in range(400)
    ]
    expected = {}
    for i, url, at, kind, headers, _ in rows:
        if kind == "revisit":
            before = [r for r in rows if r[3] == "response" and r[1] == url and (r[2], r[0]) < (at, i)]
            last = max(before, key=lambda r: (r[2], r[0]), default=None)
            expected[i] = (last and last[0], "no_response" if last is None else "resolved" if last[4] == headers else "mismatch")
    found = revisits.resolve_revisits(spark.createDataFrame(rows, RECORD), slice_seconds).collect()
    assert {r.record_id: (r.response_id, r.outcome) for r in found} == expected


# fingerprints


def walk_by_hand(text):
    bits, classes, out, at = fingerprint.walk_bits(), fingerprint.character_classes(text).tolist() + [255], [], 0
    stride = fingerprint.stride_of(len(text))
    for j in range(2 * len(text)):
        if j % stride == 0:
            out.append("0123456789abcdef"[classes[at] & 15])
        at += int(bits[j % fingerprint.PERIOD][classes[at]])
    return f"{stride}:{''.join(out)}"


def test_walk():
    rng = random.Random(4)
    texts = ["", "a", "é🙂", "ab" * 40, prose(rng, 5), prose(rng, 90), prose(rng, 700), "x" * 3_000]
    assert fingerprint.fingerprints(texts, fingerprint.walk_bits()) == [walk_by_hand(t) for t in texts]


def by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for i, (doc_id, text, *_) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        changed = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        own, other, after = (walk_by_hand(t) for t in (text, changed, following))
        sha = hashlib.sha256(changed.encode()).hexdigest()
        out.append((doc_id, len(text), sha, own, other, fingerprint.likeness(own, other), fingerprint.likeness(own, after)))
    return out


@pytest.mark.parametrize("slices", [1, 4])
def test_fingerprints_of_documents(spark, awkward, empty, slices, monkeypatch):
    monkeypatch.setattr(fingerprint, "SLICES", slices)
    monkeypatch.setattr(fingerprint, "AT_ONCE", 20_000)
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 4000")
    for docs in (awkward, small, small.limit(1)):
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        got = [tuple(r) for r in fingerprint.fingerprint_documents(docs).collect()]
        assert sorted(map(str, got)) == sorted(map(str, by_hand(docs.collect())))
    assert fingerprint.fingerprint_documents(empty).count() == 0


def test_likeness_follows_edits(spark):
    rng = random.Random(6)
    texts = [prose(rng, 200) for _ in range(40)]
    slight = [t[:500] + "zz" + t[503:] for t in texts]
    bits = fingerprint.walk_bits()
    a, b = fingerprint.fingerprints(texts, bits), fingerprint.fingerprints(slight, bits)
    near = sorted(fingerprint.likeness(x, y) for x, y in zip(a, b))
    far = [fingerprint.likeness(x, y) for x, y in zip(a, a[1:])]
    assert near[4] > 0.8 and max(far) < 0.45


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_within():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in "ab")
        true = edit_distance(a, b)
        for limit in (0, 2, 5, 9):
            assert fingerprint.edit_distance_within(a, b, limit) == (true if true <= limit else None)


def test_near_edit_links(make_docs, empty):
    rng = random.Random(9)
    originals = [prose(rng, 150) for _ in range(20)]
    copies = [t[:700] + "QQ" + t[701:] for t in originals]
    docs = make_docs(originals + copies + originals[:5] + [None, "", ""])
    links = fingerprint.near_edit_links(docs).collect()
    assert 18 <= len(links) <= 20 and all(r.distance == 2 for r in links)
    assert fingerprint.near_edit_links(empty).count() == 0
