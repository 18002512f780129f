"""Ranked lexical search: an Aho-Corasick automaton of all item terms reads the documents.

1. The items' terms, each between two boundary characters, make an automaton. A text is
   reduced to its terms with one boundary around each, so that every report of the
   automaton is a whole term; reports are counted, no index of the documents is made.
2. One pass over the texts counts documents, terms and the documents of each item term.
3. A second pass scores: the automaton's reports lead to the items of a term. A task keeps
   the best documents of each item; only these are shuffled.

The automaton and its weights are sent to all tasks. Their size is bounded: items are cut
into blocks of at most BLOCK_BYTES of terms, each block has its own automaton and passes.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmap.llm.common import bounded_blocks, portions, small_batches
from quillmap.session import materialise

BEST = 10
#: Bytes of the terms of the items of one automaton, 16 more counted for each.
BLOCK_BYTES = 16_000_000
#: Letters A-Z to lower case; every other ASCII character that is no digit or letter ends a term.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def guarded(words: list[bytes]) -> str:
    """The terms with one boundary around each; a byte is a character."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def automaton(words: list[bytes]) -> ahocorasick.Automaton:
    """Reports the number of each of `words` that it meets between boundaries."""
    out = ahocorasick.Automaton()
    for i, word in enumerate(words):
        out.add_word(guarded([word]), i)
    out.make_automaton()
    return out


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term): the distinct terms of each row of `items`; `item` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions([batch]):
                found = [sorted(set(terms(t))) for t in part["text"].to_pylist()]
                place = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part[c].take(place) for c in ("item", "item_id")), pa.array([w for f in found for w in f], pa.binary())],
                    ["item", "item_id", "term"],
                )

    kind = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind), T.StructField("term", T.BinaryType())])
    # written once: row numbers must not change when a task runs again
    numbered = materialise(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    return small_batches(numbered).mapInArrow(run, schema)


class Terms:
    """The terms of a block of items, and the items of each term."""

    def __init__(self, rows: list):
        self.words = sorted({bytes(r["term"]) for r in rows})
        number = {w: i for i, w in enumerate(self.words)}
        items = sorted({r["item"] for r in rows})
        self.ids = dict.fromkeys(items)
        for r in rows:
            self.ids[r["item"]] = r["item_id"]
        self.ids = list(self.ids.values())
        at = {item: i for i, item in enumerate(items)}
        pairs = sorted((number[bytes(r["term"])], at[r["item"]]) for r in rows)
        self.items = np.array([p[1] for p in pairs], np.int64)
        self.starts = np.searchsorted(np.array([p[0] for p in pairs], np.int64), np.arange(len(self.words) + 1))


def corpus_counts(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """(term, n, total): documents that hold word `term`; term -1 counts documents with terms, and all their terms."""

    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reads = automaton(sent.value)
        held, documents, total = np.zeros(len(sent.value), np.int64), 0, 0
        for part in portions(batches):
            for text in part["text"].to_pylist():
                found = terms(text)
                documents += bool(found)
                total += len(found)
                if found and sent.value:
                    for i in {i for _, i in reads.iter(guarded(found))}:
                        held[i] += 1
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(used, -1), pa.int64()),
                pa.array(np.append(held[used], documents), pa.int64()),
                pa.array(np.append(np.zeros(len(used), np.int64), total), pa.int64()),
            ],
            ["term", "n", "total"],
        )

    parts = small_batches(docs.select("text")).mapInArrow(run, "term long, n long, total long")
    return parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _place(doc_id) -> tuple:
    return (doc_id is None, 0 if doc_id is None else doc_id)


def _best(docs: DataFrame, block: Terms, weights: np.ndarray, documents: int, total: int, best: int) -> DataFrame:
    """(place, doc_id, score): for each item of the block, a task's best documents."""
    sent = docs.sparkSession.sparkContext.broadcast((block.words, block.items, block.starts, weights))
    count = len(block.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, items, starts, weight = sent.value
        reads = automaton(words)
        kept: list[list] = [[] for _ in range(count)]
        least = np.zeros(count, np.int64)  # the score to reach, once an item has its documents
        for part in portions(batches):
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                found = terms(text)
                if not found:
                    continue
                times = Counter(i for _, i in reads.iter(guarded(found)))
                if not times:
                    continue
                met = np.fromiter(times.keys(), np.int64, len(times))
                tf = np.fromiter(times.values(), np.int64, len(times))
                m = 10 + (90 * len(found) * documents) // total
                gain = weight[met] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                spans = starts[met + 1] - starts[met]
                ends = np.cumsum(spans)
                hit = items[np.arange(ends[-1]) + np.repeat(starts[met] - ends + spans, spans)]
                scores = np.zeros(count, np.int64)
                np.add.at(scores, hit, np.repeat(gain, spans))
                for i in np.flatnonzero((scores > 0) & (scores >= least)).tolist():
                    score = int(scores[i])
                    insort(kept[i], (-score, _place(doc_id)))
                    if len(kept[i]) > best:
                        kept[i].pop()
                    if len(kept[i]) == best:
                        least[i] = -kept[i][-1][0]
        rows = [(i, None if at[0] else at[1], -score) for i in range(count) for score, at in kept[i]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.int64())],
            ["place", "doc_id", "score"],
        )

    kind = docs.schema["doc_id"]
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("doc_id", kind.dataType), T.StructField("score", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind.dataType)
    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `best` documents of each item, highest score first.

    Terms are maximal runs of digits, letters and characters beyond ASCII; A-Z lose their
    case. With N documents that have a term, L terms in all, n terms in the document, df
    documents that hold a term and tf times it stands in this one, the score sums over the
    item's distinct terms floor(1000 ln((2N+2)/(2df+1))) * (10^9 tf div (1000 tf + 8 m)),
    where m is 10 + 90 n N div L. Scores of 0 are left out; equal ones follow by doc_id,
    null last. Null and empty texts have no terms and are not counted. Each row is a
    document or an item of its own, also repeated ones. Other columns are not read. Scores
    are 64-bit integers. Results of a bounded number of items are cut to `best` rows in
    each task, so that shuffles do not grow with the documents.
    """
    found = materialise(item_terms(items))
    spark, parts = docs.sparkSession, []
    for rows in bounded_blocks(found.withColumn("bytes", F.length("term") + 16), block_bytes):
        block = Terms(rows.collect())  # at most block_bytes and one item
        if not block.words:
            continue
        counts = {r["term"]: r for r in corpus_counts(docs, block.words).collect()}  # one row a term
        documents, total = counts[-1]["n"] if -1 in counts else 0, counts[-1]["total"] if -1 in counts else 0
        if not total:
            continue
        held = [counts[i]["n"] if i in counts else 0 for i in range(len(block.words))]
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in held], np.int64)
        ids = spark.createDataFrame(list(enumerate(block.ids)), T.StructType([T.StructField("place", T.LongType()), items.schema["item_id"]]))
        top = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = _best(docs, block, weights, documents, total, best).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= best)
        parts.append(ranked.join(ids, "place").select("item_id", "rank", "doc_id", "score"))
    out = parts[0] if parts else docs.join(items.select("item_id"), F.lit(False)).select(
        "item_id", F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score")
    )
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
