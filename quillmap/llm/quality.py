"""Quality rules: compression bands over whole documents and fixed chunks."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillmap.llm.common import map_portions

#: (characters from which it holds, lowest and highest compressed size / size). Short texts
#: compress badly whatever they say, so that the band moves down and narrows with length.
#: From 512 on the floors are what prose that is said twice reaches.
BANDS: tuple[tuple[int, float, float], ...] = (
    (0, 0.0, 9.0),
    (128, 0.36, 1.02),
    (256, 0.42, 0.90),
    (512, 0.38, 0.82),
    (1_024, 0.33, 0.77),
    (2_048, 0.285, 0.74),
    (4_096, 0.255, 0.72),
    (8_192, 0.24, 0.70),
    (16_384, 0.225, 0.70),
)
#: What short texts of an alphabet compress to at most when their characters are shuffled.
SHUFFLED = 0.7
CHUNK = 2_048
#: Share of a document's characters in rejected chunks from which the document is rejected.
BAD_CHUNKS = 0.4
LEVEL = 3
MIN_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20

MEASURES = {
    "n_words": T.LongType(),
    "word_chars": T.LongType(),
    "n_symbols": T.LongType(),
    "n_dup_lines": T.LongType(),
    "n_repeat_words": T.LongType(),
    "base_failed": T.BooleanType(),
    "kept": T.BooleanType(),
    "zstd_ratio": T.DoubleType(),
    "bad_chunk_share": T.DoubleType(),
}
_SYMBOL = re.compile(r"[#*$%&|<>]")


def repeated_words(words: Sequence[bytes], width: int = REPEAT_WINDOW) -> int:
    """Words that stand in a window of `width` words found twice or more in the text."""
    if len(words) < width:
        return 0
    windows = list(zip(*(islice(words, i, None) for i in range(width))))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    covered = reach = 0
    for i, window in enumerate(windows):
        if found[window] > 1:
            covered += i + width - max(i, reach)
            reach = i + width
    return covered


def band_verdict(ratio: float, size: int, bands: Sequence[tuple[int, float, float]]) -> bool:
    """Whether a ratio lies in the band for texts of this size."""
    _, low, high = bands[bisect.bisect_right([b[0] for b in bands], size) - 1]
    return low <= ratio <= high


def in_bytes(text: str) -> bytes | None:
    """A byte for each character, ASCII as it is, so that alphabets compress alike; null beyond 256 characters."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        found = set(text)
    if len(found) > 256:
        return None
    free = (i for i in (*range(128, 256), *range(128)) if i > 127 or chr(i) not in found)
    return text.translate({ord(c): next(free) for c in sorted(found) if c > "\x7f"}).encode("latin-1")


def ratios(text: str, compressor: zstandard.ZstdCompressor, chunk: int = CHUNK) -> tuple[float, list[tuple[float, int]]]:
    """The ratio of a text, and those of its chunks of `chunk` characters with their sizes.

    Scripts of more than 256 characters are held against their own characters, shuffled.
    """
    data = in_bytes(text)
    if data is not None:
        ratio = lambda piece: len(compressor.compress(piece)) / len(piece)
    else:
        data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

        def ratio(piece: np.ndarray) -> float:
            sizes = []
            for points in (piece, np.random.default_rng(0).permutation(piece)):
                said = points.tobytes().decode("utf-32-le", "surrogatepass")
                sizes.append(len(compressor.compress(said.encode("utf-8", "surrogatepass"))))
            return SHUFFLED * sizes[0] / sizes[1]

    pieces = [data[i : i + chunk] for i in range(0, len(data), chunk)]
    return ratio(data) if len(data) else 0.0, [(ratio(p), len(p)) for p in pieces]


def measure(text: str | None, compressor: zstandard.ZstdCompressor, bands=BANDS, chunk: int = CHUNK) -> tuple:
    """The values of MEASURES for one text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n_words = len(words)
    word_bytes = b"".join(words)
    seen: set[str] = set()
    dup_lines = lines = 0
    for line in text.split("\n"):
        if line.encode("utf-8", "surrogatepass").split():
            seen.add(line)
            lines += 1
    dup_lines = lines - len(seen)
    repeat = repeated_words(words)
    failed = n_words < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * n_words
    size = len(text)
    ratio, chunks = ratios(text, compressor, chunk)
    bad = sum(n for r, n in chunks if not band_verdict(r, n, bands))
    share = bad / size if size else 0.0
    kept = not failed and band_verdict(ratio, size, bands) and share < BAD_CHUNKS
    return (
        n_words,
        len(word_bytes.decode("utf-8", "surrogatepass")),
        len(_SYMBOL.findall(text)),
        dup_lines,
        repeat,
        failed,
        kept,
        ratio,
        share,
    )


def measure_quality(docs: DataFrame, bands=BANDS, chunk: int = CHUNK) -> DataFrame:
    """doc_id and MEASURES of every document: base rules, then compression bands.

    A text whose zstandard ratio lies under its length's band is repetitive, above it
    incompressible; the same bands judge fixed chunks of `chunk` characters, so that a long
    document cannot hide bad stretches. Ratios are of characters coded as in `ratios`, not of
    UTF-8, so that a script of two bytes a letter is judged as one of one byte. Null and empty texts have no words and fail the
    base rules. Rows are judged by themselves: repeated rows get equal verdicts, an empty
    table an empty result. Other columns are not read.
    """

    def work():
        compressor = zstandard.ZstdCompressor(level=LEVEL)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [measure(text, compressor, bands, chunk) for text in batch["text"].to_pylist()]
            columns = list(zip(*rows)) or [[] for _ in MEASURES]
            kinds = [{"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[k.simpleString()] for k in MEASURES.values()]
            return pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *MEASURES]
            )

        return each

    narrow = docs.select("doc_id", "text")
    schema = T.StructType([narrow.schema["doc_id"], *(T.StructField(n, k) for n, k in MEASURES.items())])
    return map_portions(narrow, work, schema)


def keep_good(docs: DataFrame, bands=BANDS, chunk: int = CHUNK) -> DataFrame:
    """The rows of `docs` that pass the rules, with all their columns, in one narrow pass."""

    def work():
        compressor = zstandard.ZstdCompressor(level=LEVEL)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            verdict = list(MEASURES).index("kept")
            kept = [measure(text, compressor, bands, chunk)[verdict] for text in batch["text"].to_pylist()]
            return batch.filter(pa.array(kept, pa.bool_()))

        return each

    return map_portions(docs, work, docs.schema)
