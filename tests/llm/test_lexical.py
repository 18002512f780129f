"""Ranked lexical search against counting every term of every document."""

import math
import random
import re

import duckdb

from quillmap.llm import lexical
from quillmap.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import awkward_rows

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_counting(docs, items, best=10):
    """(item_id, rank, doc_id, score) from (doc_id, text) and (item_id, text)."""
    held = [(d, plain_terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    number, total = len(held), sum(len(t) for _, t in held)
    out = []
    for item, text in items:
        scores = []
        for doc, words in held:
            m = 100 - 90 + 90 * len(words) * number // total
            score = 0
            for term in set(plain_terms(text)):
                df = sum(term in w for _, w in held)
                weight = math.floor(1000 * math.log((2 * number + 2) / (2 * df + 1)))
                score += weight * (1_000_000_000 * words.count(term) // (1000 * words.count(term) + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        scores.sort()
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(scores[:best])]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [(1, "alpha1 BETA2, gamma3"), (2, None), (3, ""), (4, "beta2"), (4, "beta2"), (5, "Ünïcödé 漢字 the the"), (6, "nowhere_at-all"), (None, "two words"), (7, "a_aa aa")]


def test_against_counting(spark, awkward):
    items = spark.createDataFrame([(i, t, "clash", 1) for i, t in ITEMS], "item_id long, text string, doc_id string, score int")
    docs = [(r[0], r[1]) for r in awkward_rows()]
    want = sorted(by_counting(docs, ITEMS), key=str)
    assert want and rows(lexical.search(awkward, items)) == want
    # items in several blocks
    assert rows(lexical.search(awkward, items, block_bytes=100)) == want
    assert rows(lexical.search(awkward, items, best=2)) == sorted(by_counting(docs, ITEMS, 2), key=str)


def test_ties_and_touching_terms(spark):
    texts = [(d, "same text here") for d in (9, 3, 7, None, 3)] + [(1, "aa aa aa"), (2, "aaa a aa"), (4, "aa\x00aa\x7faa"), (5, "aa_aa`aa{aa@aa")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    items = [(1, "text same"), (2, "aa"), (3, "aaa aa a")]
    got = rows(lexical.search(docs, spark.createDataFrame(items, "item_id long, text string")))
    assert got == sorted(by_counting(texts, items), key=str)


def test_many_random_documents(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(rng.choices(words, weights=range(1, 61), k=rng.randrange(40)))) for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    got = rows(lexical.search(docs, spark.createDataFrame(items, "item_id long, text string")))
    assert got == sorted(by_counting(texts, items), key=str)


def test_empty_tables(spark, empty, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "alpha1")], "item_id long, text string")
    for docs, items in ((empty, some), (awkward, none), (empty, none)):
        found = lexical.search(docs, items)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and not found.collect()


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two")], "doc_id string, text string")
    items = spark.createDataFrame([("x", "one three")], "item_id string, text string")
    assert [r[:3] for r in rows(lexical.search(docs, items))] == [("x", 1, "a"), ("x", 2, "b")]


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = db.execute(f"SELECT item_id, rank, doc_id, score FROM ({ORACLE['op13_lexical_search']})").fetchall()
    assert want and rows(QUERIES["op13_lexical_search"](spark, folder)) == sorted(want, key=str)
