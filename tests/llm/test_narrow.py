"""Operators that judge each row by itself: quality, token counts, byte-level BPE, language."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmap.llm import bytebpe, language, quality, wordpiece
from quillmap.llm.queries import PIECE_FILE, QUERIES, RANK_FILE
from tests.llm.conftest import awkward_rows

SF_DIR = "/root/testdata/sf0.001"


def texts_of(rows):
    return [r[1] for r in rows]


def read_docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


# quality


def base_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def in_bands(text):
    def good(data):
        low, high = [b[1:] for b in quality.BANDS if b[0] <= len(data)][-1]
        return low <= len(zstandard.ZstdCompressor(level=3).compress(data)) / len(data) <= high

    data = (text or "").encode()
    chunks = [data[i : i + quality.CHUNK] for i in range(0, len(data), quality.CHUNK)]
    bad = sum(len(c) for c in chunks if not good(c))
    return bool(data) and good(data) and bad < quality.BAD_CHUNKS * len(data)


@pytest.mark.parametrize("awkward_case", [True, False])
def test_quality(spark, awkward, awkward_case):
    docs = awkward if awkward_case else read_docs(spark)
    expected = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        base = base_rules(text)
        expected.append((doc_id, *base, not base[-1] and in_bands(text)))
    got = [tuple(r)[:8] for r in quality.measure_quality(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_keep_good(awkward, empty):
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns
    assert all(not base_rules(r.text)[-1] for r in kept.collect()) and kept.count()
    assert quality.keep_good(empty).count() == 0 and quality.measure_quality(empty).count() == 0


def test_bands_reject_noise_and_repeats():
    rng = random.Random(1)
    noise = base64.b85encode(rng.randbytes(6_000)).decode()
    noise = " ".join(noise[i : i + 9] for i in range(0, len(noise), 9))
    compressor = zstandard.ZstdCompressor(level=3)
    verdict = lambda t: quality.measure(t, compressor)[6]
    assert not verdict(noise)
    cycle = " ".join(f"w{i % 7}{i % 11}{i % 13}" for i in range(900))
    assert not verdict(cycle) and not quality.measure(cycle, compressor)[5]  # passes the base rules, compresses too well


def other_script(text, first):
    return "".join(chr(first + ord(c) - 65) if c.isascii() and c.isalpha() else c for c in text)


def ideographs(text):
    at = {w: i * 7_919 % 300_000 for i, w in enumerate(dict.fromkeys(text.split()))}
    return " ".join(chr(0x4E00 + at[w] // 600) + chr(0x4E00 + at[w] % 600 + 500) for w in text.split())


@pytest.mark.parametrize("write", [str, lambda t: other_script(t, 0x410), lambda t: other_script(t, 0x10A0), ideographs])
def test_bands_hold_for_any_script(spark, write):
    compressor = zstandard.ZstdCompressor(level=3)
    verdict = lambda t: quality.measure(t, compressor)[6]
    clean = [r.text for r in read_docs(spark).collect() if r.text and len(r.text) > 1_500 and verdict(r.text)]
    assert len(clean) > 20 and all(verdict(write(t)) for t in clean)
    thrice = [write(" ".join(t.split()[:200] * 3)) for t in clean]
    for ratio, _ in (quality.ratios(t, compressor) for t in thrice):
        assert not quality.band_verdict(ratio, 2_048, quality.BANDS)


# byte-level BPE


@pytest.fixture(scope="module")
def tokens():
    return bytebpe.read_ranks(public_tokenizers.path(RANK_FILE))


@pytest.fixture(scope="module")
def reference(tokens):
    ranks = {t: i for i, t in enumerate(tokens)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe(tokens):
    return bytebpe.ByteBpe(tokens, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_merges(bpe, reference, text):
    (ids,) = bpe.encode([text])
    assert ids == ",".join(map(str, reference.encode_ordinary(text)))
    assert bpe.decode(ids) == text.encode()


def test_bpe_pieces_cover_all_bytes(tokens):
    assert {bytes([b]) for b in range(256)} <= set(tokens)
    assert len(set(bytebpe.byte_characters())) == 256


@pytest.mark.parametrize("awkward_case", [True, False])
def test_bpe_documents(spark, awkward, awkward_case, tokens, reference):
    docs = awkward if awkward_case else read_docs(spark)
    expected = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = reference.encode_ordinary(text or "")
        shas = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (text or "").encode())]
        expected.append((doc_id, len(ids), *shas, ids))
    got = [tuple(r) for r in bytebpe.encode_documents(docs, tokens, public_tokenizers.PATTERN).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_bpe_query(spark, empty, tokens):
    assert bytebpe.encode_documents(empty, tokens, public_tokenizers.PATTERN).count() == 0
    assert QUERIES["op8_byte_bpe"](spark, SF_DIR).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_ranks_need_every_number(tmp_path):
    path = tmp_path / "gap.tiktoken"
    path.write_text(f"{base64.b64encode(b'a').decode()} 0\n{base64.b64encode(b'b').decode()} 2\n")
    with pytest.raises(ValueError, match="gap"):
        bytebpe.read_ranks(str(path))


# token counts


def greedy(word, pieces):
    text, at, count = "▁" + word, 0, 0
    while at < len(text):
        end = next((e for e in range(len(text), at, -1) if text[at:e] in pieces), None)
        if end is None:
            return 0
        at, count = end, count + 1
    return count


@settings(max_examples=400, deadline=None)
@given(st.sets(st.text("ab▁c", min_size=1, max_size=5), max_size=14), st.text("abcd▁", max_size=12))
def test_automaton_equals_greedy(pieces, word):
    assert wordpiece.LongestMatch(sorted(pieces)).count(word) == greedy(word, pieces)


def test_token_counts(spark, awkward, empty):
    pieces = wordpiece.read_pieces(public_tokenizers.path(PIECE_FILE))
    known, memo = set(pieces), {}
    for docs in (awkward, read_docs(spark).limit(60)):
        rows = docs.select("doc_id", "text").collect()
        expected = []
        for doc_id, text in rows:
            words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
            for w in words:
                if w not in memo:
                    memo[w] = greedy(w, known) if len(w) < 500 else wordpiece.LongestMatch(pieces).count(w)
            counts = [memo[w] for w in words]
            expected.append((doc_id, len(words), sum(counts) + counts.count(0), counts.count(0)))
        again = spark.createDataFrame(rows, "doc_id long, text string")
        got = [tuple(r) for r in wordpiece.count_tokens(again, pieces).collect()]
        assert sorted(map(str, got)) == sorted(map(str, expected))
    assert wordpiece.count_tokens(empty, pieces).count() == 0


# language


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 40")
    model = language.train_language_model(docs)
    truth = dict(docs.select("doc_id", "lang").collect())
    rows = language.identify_language(docs, model).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) > 0.97 * len(held) > 0


def test_language_tables_equal_network(spark):
    import numpy as np

    model = language.ByteCnn(["a", "b"])
    x = np.random.default_rng(3).integers(0, 256, (7, language.WINDOW)).astype(np.uint8)
    assert np.allclose(model.forward(x)[2], model.predict(x, model.pair_tables()), atol=1e-4)


def test_language_awkward(awkward, empty):
    model = language.train_language_model(awkward)
    rows = language.identify_language(awkward, model).collect()
    assert len(rows) == len(awkward_rows())
    letters = {t: bool(t) and bool(regex.search(r"\p{L}", t)) for t in texts_of(awkward_rows())}
    by_text = dict(zip([r[1] for r in awkward.select("doc_id", "text").collect()], rows))
    assert all((by_text[t].lang_pred != "und") == has for t, has in letters.items())
    assert language.train_language_model(empty) is None
    assert language.identify_language(empty, None).count() == 0
    assert {r.lang_pred for r in language.identify_language(awkward, None).collect()} == {"und"}
