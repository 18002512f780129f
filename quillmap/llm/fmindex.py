"""Benchmark decontamination: an FM-index of each shard of documents, asked for all windows.

1. Items become windows of WIDTH consecutive words, a shorter item one window.
2. A task joins its documents to shards of about SHARD_BYTES. A shard's words, numbered by
   the items' vocabulary, are sorted by suffixes; the Burrows-Wheeler transform goes into a
   wavelet tree, every SAMPLE-th suffix position is kept.
3. Backward search narrows the rows of all windows at once, a word at a time, by ranks in
   the tree. Rows found walk back to a sampled suffix, which tells their position.
4. Overlapping occurrences are merged into the spans to remove.

The windows are sent to all tasks. Items are cut into blocks of at most BLOCK_BYTES of
text for that; documents pass all blocks, one after the other. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmap.llm.common import bounded_blocks, portions, small_batches
from quillmap.session import materialise

WIDTH = 10
SHARD_BYTES = 8_000_000
BLOCK_BYTES = 4_000_000
#: Suffix positions kept: those that are multiples of this, and the starts of documents.
SAMPLE = 16
#: Symbols of a shard besides the items' words: the end of a document, any other words.
END, OTHER, FIRST_WORD = 0, 1, 2
#: A-Z to lower case; ASCII characters that are no digit or letter part words.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


class WaveletTree:
    """Ranks of symbols in a sequence, level by level from their highest bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for level in range(bits - 1, -1, -1):
            ones = (symbols >> level & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + (-len(packed)) % 8, np.uint8)]).view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((packed, before, len(ones) - int(before[-1])))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        every = np.arange(1 << bits)
        self.first = self._down(every, np.zeros(1 << bits, np.int64))

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, (packed, before, zeros) in enumerate(self.levels):
            ones = self._ones(packed, before, at)
            at = np.where(symbols >> (self.bits - 1 - i) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        return self._down(symbols, at) - self.first[symbols]

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the positions, and their ranks there."""
        symbols = np.zeros(len(at), np.int64)
        for packed, before, zeros in self.levels:
            bit = (packed[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._ones(packed, before, at)
            at = np.where(bit, zeros + ones, at - ones)
            symbols = symbols << 1 | bit
        return symbols, at - self.first[symbols]


def suffix_array(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Starts of the suffixes in order, an end before anything; by doubling what is told apart."""
    n, step = len(symbols), max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(step):
        key <<= bits
        if i < n:
            key[: n - i] |= symbols[i:]
    step = min(step, n)
    order = np.argsort(key)
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    rank = np.zeros(n + 1, np.int64)  # of the empty suffix too: 0
    slots = np.arange(n)
    while True:
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))] + 1
        settled = new & np.append(new[1:], True)
        slots = slots[~settled]
        if not len(slots):
            return order
        here = order[slots]
        behind = here + step  # beyond the end the shorter suffix comes first
        key = rank[here] * (2 * n + 2) + np.where(behind <= n, rank[np.minimum(behind, n)], n - behind) + n
        again = np.argsort(key)
        order[slots], key = here[again], key[again]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        step = min(2 * step, n)


class FMIndex:
    """Counts and positions of word sequences in a shard; `symbols` ends each document with END."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.size = len(symbols)
        order = suffix_array(symbols, bits)
        self.tree = WaveletTree(symbols[order - 1], bits)  # the one before position 0 is an END
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << bits))])[:-1]
        kept = (order % SAMPLE == 0) | (symbols[order - 1] == END)
        self.sampled, self.positions = kept, order[kept]
        self.sampled_before = np.concatenate([[0], np.cumsum(kept)])

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and the row after the last of each window; rows of `windows` end in padding."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.size, np.int64)
        live = np.arange(len(windows))
        for back in range(1, windows.shape[1] + 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])]
            if not len(live):
                break
            symbols = windows[live, lengths[live] - back]
            low[live] = self.smaller[symbols] + self.tree.rank(symbols, low[live])
            high[live] = self.smaller[symbols] + self.tree.rank(symbols, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the shard of rows, by walking back to a sampled one."""
        found, live, walked = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(live):
            known = self.sampled[rows]
            found[live[known]] = self.positions[self.sampled_before[rows[known]]] + walked
            live, rows = live[~known], rows[~known]
            symbols, ranks = self.tree.read(rows)
            rows, walked = self.smaller[symbols] + ranks, walked + 1
        return found


class Windows:
    """The distinct windows of a block of items: their words as symbols, and the items that have them."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.symbol: dict[bytes, int] = {}
        self.ids = sorted({i for i, _ in items})
        place, rows, owners = {i: k for k, i in enumerate(self.ids)}, [], []
        for item, text in items:
            symbols = [self.symbol.setdefault(w, FIRST_WORD + len(self.symbol)) for w in words_of(text)]
            for start in range(max(1, len(symbols) - width + 1) if symbols else 0):
                rows.append(symbols[start : start + width])
                owners.append(place[item])
        padded = np.full((len(rows), width), -1, np.int32)
        for i, row in enumerate(rows):
            padded[i, : len(row)] = row
        self.windows, which = np.unique(padded, axis=0, return_inverse=True) if rows else (padded, np.zeros(0, np.int64))
        self.lengths = (self.windows >= 0).sum(axis=1)
        pairs = np.unique(np.stack([which.ravel(), np.array(owners, np.int64)], axis=1), axis=0) if rows else np.zeros((0, 2), np.int64)
        self.owners, self.starts = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.bits = max(2, int(FIRST_WORD + len(self.symbol) - 1).bit_length())

    def occurrences(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, number of words, window) of every occurrence in a shard."""
        none = np.zeros(0, np.int64)
        if not len(self.windows) or not any(texts):
            return none, none, none, none
        get, parts, places = self.symbol.get, [], []
        for words in texts:
            codes = np.fromiter((get(w, OTHER) for w in words), np.int64, len(words))
            # of words that no item has, a run counts as one
            kept = np.flatnonzero((codes != OTHER) | np.append(True, codes[:-1] != OTHER)) if len(codes) else none
            parts.append(np.append(codes[kept], END))
            places.append(np.append(kept, len(words)))
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        index = FMIndex(np.concatenate(parts), self.bits)
        low, high = index.search(self.windows, self.lengths)
        times = high - low
        window = np.repeat(np.arange(len(times)), times)
        ends = np.cumsum(times)
        rows = np.arange(ends[-1]) + np.repeat(low - ends + times, times)
        at = index.locate(rows)
        return np.searchsorted(starts, at, "right") - 1, np.concatenate(places)[at], self.lengths[window], window


def _shards(batches: Iterator[pa.RecordBatch], bound: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in portions(batches):
        held.append(part)
        size += pa.compute.sum(pa.compute.binary_length(part["text"])).as_py() or 0
        if size >= bound:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


_RUN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _runs(covered: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _pass(docs: DataFrame, block: Windows) -> DataFrame:
    """`docs` (doc_id, text, runs, items) with the occurrences of the block's windows added.

    `runs` are first and last word, the latter not included, of what is hit.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    shard_bytes = SHARD_BYTES
    sent, schema = docs.sparkSession.sparkContext.broadcast(block), to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sent.value
        for shard in _shards(batches, shard_bytes):
            own: dict[str | None, int] = {}  # copies in a shard are indexed once
            which = [own.setdefault(t, len(own)) for t in shard["text"].to_pylist()]
            words = [words_of(t) for t in own]
            doc, start, length, window = windows.occurrences(words)
            base = np.concatenate([[0], np.cumsum([len(w) for w in words])])
            change = np.zeros(base[-1] + 1, np.int64)
            np.add.at(change, base[doc] + start, 1)
            np.add.at(change, base[doc] + start + length, -1)
            covered = np.cumsum(change)[:-1] > 0
            pairs = np.unique(np.stack([doc, window], axis=1), axis=0)
            seen = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))
            runs, items = [], []
            for i, old_runs, old_items in zip(which, shard["runs"].to_pylist(), shard["items"].to_pylist()):
                mine = covered[base[i] : base[i + 1]].copy()
                for r in old_runs:
                    mine[r["start"] : r["end"]] = True
                found = {windows.ids[k] for w in pairs[seen[i] : seen[i + 1], 1] for k in windows.owners[windows.starts[w] : windows.starts[w + 1]]}
                runs.append([{"start": a, "end": b} for a, b in _runs(mine)] if mine.any() else [])
                items.append(sorted(found.union(old_items)))
            columns = [*(shard[c] for c in ("doc_id", "text")), pa.array(runs, schema.field("runs").type), pa.array(items, schema.field("items").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return small_batches(docs).mapInArrow(run, docs.schema)


def find_contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, runs, items: the word runs of each document that windows of items cover.

    Words are runs of digits, letters and characters beyond ASCII; A-Z lose their case. A
    window is `width` consecutive words of an item, or all words of a shorter one. `runs`
    are [first, behind the last) word numbers from 0, merged and in order; `items` the
    sorted distinct item_ids, as strings (null: empty), with a window in the document. Null
    and empty texts have no words, items without words no window. Each row is a document of
    its own, also repeated ones. Other columns are not read. A document is indexed whole.
    """
    ids = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")
    numbered = materialise(items.where(F.col("text").isNotNull()).select(F.monotonically_increasing_id().alias("item"), ids, "text"))
    found = docs.select("doc_id", "text", F.array().cast(_RUN).alias("runs"), F.array().cast("array<string>").alias("items"))
    blocks = bounded_blocks(numbered.withColumn("bytes", F.octet_length("text")), block_bytes)
    for rows in blocks:
        found = _pass(found, Windows([(r["item_id"], r["text"]) for r in rows.collect()], width))  # at most block_bytes and one item
        if len(blocks) > 1:
            found = materialise(found)
    return found


def contamination_spans(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans, kept_text from `find_contamination`.

    `spans` are offsets in code points, from a run's first word to behind its last one;
    `kept_text` is the text without them (null for null).
    """
    schema = T.StructType(
        [
            found.schema["doc_id"],
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            found.schema["items"],
            T.StructField("spans", _RUN),
            T.StructField("kept_text", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for part in portions(batches):
            counts, hits, spans, kept = [], [], [], []
            for text, runs in zip(part["text"].to_pylist(), part["runs"].to_pylist()):
                counts.append(len(words_of(text)))
                hits.append(sum(r["end"] - r["start"] for r in runs))
                own = []
                if runs:
                    words = [m.span() for m in _WORD.finditer(text)]
                    own = [{"start": words[r["start"]][0], "end": words[r["end"] - 1][1]} for r in runs]
                spans.append(own)
                ends = [0, *(s["end"] for s in own)]
                kept.append(text if not own else "".join(text[a:b] for a, b in zip(ends, [*(s["start"] for s in own), len(text)])))
            values = [part["doc_id"], pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), part["items"], pa.array(spans, arrow.field("spans").type), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(values, schema=arrow)

    return small_batches(found).mapInArrow(run, schema)
