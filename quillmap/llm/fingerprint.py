"""Document fingerprints by a randomised edit embedding.

A shared random walk copies a text: at step j it writes the character it stands on and
moves on or stays, as a random bit for j and that character says. Texts at a small edit
distance fall back into step after an edit, so that edit distance becomes Hamming
distance. A fingerprint keeps the characters (hashed to four bits) at every 2^k-th step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmap.llm.common import small_batches, text_key

#: A fingerprint keeps more than half of SAMPLES steps and SAMPLES at most.
SAMPLES = 128
PERIOD = 4_093  # steps after which the random bits repeat
SEED = 29
#: Characters that a task embeds at once.
AT_ONCE = 12_000_000
#: Slices of the id order for each shuffle partition.
SLICES = 4
#: Digits of a band, and the part of a text that may differ in a pair.
BAND = 8
MAX_DIFFERENCE = 0.1

_END = 255  # class of the end of a text, on which the walk stays


def walk_bits(seed: int = SEED) -> np.ndarray:
    bits = np.random.default_rng(seed).integers(0, 2, (PERIOD, 256)).astype(np.int64)
    bits[:, _END] = 0
    return bits


def character_classes(text: str) -> np.ndarray:
    """A class below 255 for every code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return (((points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(255)).astype(np.uint8)


def stride_of(n_chars: int) -> int:
    """The power of two at which a walk of 2 * n_chars steps is sampled."""
    stride = 1
    while 2 * n_chars > SAMPLES * stride:
        stride *= 2
    return stride


def fingerprints(texts: list[str], bits: np.ndarray) -> list[str]:
    """For each text: its stride, a colon, and a hexadecimal digit for every sampled step."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    steps = 2 * lengths
    strides = np.array([stride_of(n) for n in lengths.tolist()], np.int64)
    counts = -(-steps // strides)
    base = np.cumsum(counts) - counts
    digits = np.zeros(int(counts.sum()), np.uint8)
    ends = np.array([_END], np.uint8)
    classes = np.concatenate([part for i in order for part in (character_classes(texts[i]), ends)] or [ends])
    place = np.cumsum(lengths + 1) - lengths - 1
    longest = int(steps[0]) if len(order) else 0
    # rows are sorted by length: those still walking come first, those of small stride last
    walking = np.searchsorted(-steps, -np.arange(longest), side="left")
    powers = {1 << k: int(np.searchsorted(-strides, -(1 << k), side="left")) for k in range(40)}
    largest = int(strides[0]) if len(order) else 1
    for j in range(longest):
        active = walking[j]
        at = place[:active]
        now = classes[at]
        first = powers[min(j & -j, largest) if j else largest]
        if first < active:
            digits[base[first:active] + j // strides[first:active]] = now[first:] & 15
        at += bits[j % PERIOD][now]
    shown = np.frombuffer(b"0123456789abcdef", np.uint8)[digits].tobytes().decode()
    out = [""] * len(texts)
    for row, i in enumerate(order):
        out[i] = f"{strides[row]}:{shown[base[row] : base[row] + counts[row]]}"
    return out


def likeness(one: str, other: str) -> float:
    """Share of steps, among those that the coarser fingerprint samples, with equal digits."""
    (s, a), (t, b) = ((int(x), y) for x, y in (f.split(":") for f in (one, other)))
    a, b = (a[:: t // s], b) if s < t else (a, b[:: s // t])
    if not a and not b:
        return 1.0
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    short = min(len(x), len(y))
    return float((x[:short] == y[:short]).sum() / max(len(x), len(y)))


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much of the beginning of the next."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


_COLUMNS = (
    ("n_chars", T.LongType()),
    ("edited_sha256", T.StringType()),
    ("fingerprint", T.StringType()),
    ("edited_fingerprint", T.StringType()),
    ("near_edited", T.DoubleType()),
    ("near_next", T.DoubleType()),
)


def with_following(docs: DataFrame) -> DataFrame:
    """(doc_id, text, slice, guest), each slice of the id order sorted in one partition.

    A slice ends with a guest: the first document of the next slice, of the first slice
    after the last. Nulls come first, equal ids in order of their texts.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / (SLICES * partitions) for i in range(1, SLICES * partitions)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = np.unique(np.array(rows.agg(F.percentile_approx("doc_id", shares, 100_000)).first()[0] or [], np.int64))

    def slices(ids: pd.Series) -> np.ndarray:
        out = np.zeros(len(ids), np.int32)
        known = ids.notna().to_numpy()
        out[known] = np.searchsorted(bounds, ids[known].to_numpy(np.int64), side="right")
        return out

    @F.pandas_udf("int")
    def slice_of(ids: pd.Series) -> pd.Series:
        return pd.Series(slices(ids))

    sliced = rows.withColumn("slice", slice_of("doc_id"))
    # a row a slice
    firsts = sorted(
        sliced.groupBy("slice").agg(F.min("doc_id").alias("id"), F.bool_or(F.col("doc_id").isNull()).alias("null")).collect(),
        key=lambda r: r["slice"],
    )
    first_id = {r["slice"]: None if r["null"] else r["id"] for r in firsts}
    before = {r["slice"]: firsts[i - 1]["slice"] for i, r in enumerate(firsts)}
    places = T.ArrayType(T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("guest", T.BooleanType())]))

    @F.pandas_udf(places)
    def places_of(ids: pd.Series) -> pd.Series:
        out = []
        for s, i, there in zip(slices(ids).tolist(), ids.tolist(), ids.notna().tolist()):
            here = [{"slice": s, "guest": False}]
            if first_id[s] == (int(i) if there else None):
                here.append({"slice": before[s], "guest": True})
            out.append(here)
        return pd.Series(out)

    return (
        rows.select("doc_id", "text", F.explode(places_of("doc_id")).alias("place"))
        .select("doc_id", "text", "place.*")
        .repartition(partitions, "slice")
        .sortWithinPartitions("slice", "guest", F.asc_nulls_first("doc_id"), "text")
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next are.

    The next document is the one that follows in order of doc_id (nulls first, equal ids by
    text); the first follows the last. Null texts count as empty, whose fingerprint is
    `1:`. Equal texts have equal fingerprints. One document is its own next. Other columns
    are not read. Texts are shuffled once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = walk_bits()

        def finish(rows: list[tuple]) -> pa.RecordBatch:
            """Rows but the last, which may be next to the one before it."""
            subjects = [i for i in range(len(rows) - 1) if not rows[i][3]]
            changed = [edited(rows[i][1], rows[i + 1][1]) for i in subjects]
            prints = fingerprints([r[1] for r in rows] + changed, bits)
            own, of_changed = prints[: len(rows)], prints[len(rows) :]
            values = [
                (
                    rows[i][0],
                    len(rows[i][1]),
                    hashlib.sha256(e.encode()).hexdigest(),
                    own[i],
                    p,
                    likeness(own[i], p),
                    likeness(own[i], own[i + 1]),
                )
                for i, e, p in zip(subjects, changed, of_changed)
            ]
            kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = list(zip(*values)) or [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)

        held, size, id_type = [], 0, pa.int64()
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for row in zip(*(batch[n].to_pylist() for n in ("doc_id", "text", "slice", "guest"))):
                held.append(row)
                size += len(row[1])
                if size > AT_ONCE and len(held) > 1:
                    yield finish(held)
                    held, size = [row], len(row[1])
        if held:
            yield finish(held)

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, k) for n, k in _COLUMNS)])
    return small_batches(with_following(docs)).mapInArrow(run, schema)


def edit_distance_within(a: str, b: str, limit: int) -> int | None:
    """The edit distance if it is at most `limit`: furthest reach by diagonal, edit by edit."""
    if abs(len(a) - len(b)) > limit:
        return None

    def slide(i: int, d: int) -> int:
        while i < len(a) and i + d < len(b) and a[i] == b[i + d]:
            i += 1
        return i

    goal = len(b) - len(a)
    reach = {0: slide(0, 0)}
    for edits in range(limit + 1):
        if reach.get(goal, -1) >= len(a):
            return edits
        further = {}
        for d in range(-edits - 1, edits + 2):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            i = min(i, len(a), len(b) - d)
            if i >= 0 and i + d >= 0:
                further[d] = slide(i, d)
        reach = further
    return None


def near_edit_links(docs: DataFrame, difference: float = MAX_DIFFERENCE) -> DataFrame:
    """(key_a, key_b, hub_a, hub_b, distance): texts linked to the first text of a band they share.

    Bit-sampled banding over distinct texts: runs of BAND digits at the same steps and stride
    are bands. In a band every text is compared with the text of lowest key, so that pairs
    grow with the rows and not with their square; edit distance verifies them.
    """
    keyed = docs.select(*text_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    texts = keyed.groupBy("key_a", "key_b").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = walk_bits()
        for batch in batches:
            rows = []
            prints = fingerprints(batch["text"].to_pylist(), bits)
            for a, b, text in zip(batch["key_a"].to_pylist(), batch["key_b"].to_pylist(), prints):
                stride, digits = text.split(":")
                for s, part in ((int(stride), digits), (2 * int(stride), digits[::2])):  # neighbours in length may be coarser
                    rows += [(f"{s}:{i}:{part[i : i + BAND]}", a, b) for i in range(0, max(1, len(part) - BAND + 1), BAND)]
            columns = list(zip(*rows)) or [[], [], []]
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["band", "key_a", "key_b"])

    bands = texts.mapInArrow(run, "band string, key_a long, key_b long")
    hubs = bands.groupBy("band").agg(F.min(F.struct("key_a", "key_b")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    pairs = (
        bands.join(hubs, "band")
        .select("key_a", "key_b", F.col("hub.key_a").alias("hub_a"), F.col("hub.key_b").alias("hub_b"))
        .where("key_a != hub_a OR key_b != hub_b")
        .distinct()
    )
    hub_texts = texts.select(F.col("key_a").alias("hub_a"), F.col("key_b").alias("hub_b"), F.col("text").alias("hub_text"))
    joined = pairs.join(texts, ["key_a", "key_b"]).join(hub_texts, ["hub_a", "hub_b"])

    @F.pandas_udf("int")
    def distance(one: pd.Series, other: pd.Series) -> pd.Series:
        found = [
            edit_distance_within(a, b, int(difference * max(len(a), len(b)))) if a and b else None
            for a, b in zip(one, other)
        ]
        return pd.Series(found, dtype="Int32")

    return (
        joined.select("key_a", "key_b", "hub_a", "hub_b", distance("text", "hub_text").alias("distance"))
        .where("distance IS NOT NULL")
    )
