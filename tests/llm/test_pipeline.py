"""The pipeline and the registration of all operators."""

import hashlib

import public_tokenizers
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from quillmap.llm import bytebpe, templates
from quillmap.llm.queries import ORACLE, QUERIES, RANK_FILE
from tests.llm.test_joins import join_by_hand, templates_by_hand
from tests.llm.test_narrow import base_rules, in_bands

SF_DIR = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    numbers = [int(name[2:].split("_")[0]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 14)) and set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql()) and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "source_mix", "byte_bpe"]


def stages_by_hand(rows):
    """(doc_id, text) before the mix."""
    good = [(i, t) for i, t in rows if not base_rules(t)[-1] and in_bands(t)]
    lines = [(i, t) for i, t, _, _ in templates_by_hand(good, templates.MIN_DOCS)]
    least = {i: c for i, _, c in join_by_hand(lines, 80, 5)}
    return sorted((i, t) for i, t in lines if least[i] == i)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    expected = dict(stages_by_hand(rows))
    step = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        step = stage(spark, step, SF_DIR)
        assert step.columns == docs.columns
    step = step.cache()
    assert {r.doc_id: r.text for r in step.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in step.collect())
    mix = corpus_pipeline.STAGES[3][1](spark, step, SF_DIR)
    assert mix.columns == docs.columns and {r.doc_id for r in mix.collect()} <= set(expected)
    ranks = {t: i for i, t in enumerate(bytebpe.read_ranks(public_tokenizers.path(RANK_FILE)))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in mix.collect())
    for r in out:
        assert r.token_ids == encoding.encode_ordinary(expected[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(expected[r.doc_id].encode()).hexdigest()


def test_pipeline_drops_short_lines(spark, make_docs):
    texts = [f"own{i} words{i}x of text{i} number {i}\nLes.\n版权所有不得转载\nnext{i} line{i}x of it" for i in range(30)]
    docs = make_docs(texts).selectExpr("doc_id", "text", "lang", "source", "length(text) AS n_chars")
    for r in corpus_pipeline.line_dedup(spark, docs, SF_DIR).collect():
        assert "Les." not in r.text and "版权" not in r.text and f"own{r.doc_id} " in r.text


def test_pipeline_awkward(spark, awkward, empty):
    for docs in (awkward, empty):
        step = docs
        for name, stage in corpus_pipeline.STAGES:
            step = stage(spark, step, SF_DIR)
            assert name == "byte_bpe" or step.columns == docs.columns
        assert step.count() or docs is empty
