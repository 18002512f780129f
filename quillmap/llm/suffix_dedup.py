"""Suffix-array dedup: bytes of strings of LENGTH bytes that start anywhere else.

1. Of every run of LENGTH bytes, the least hash of its GRAM-byte pieces marks an anchor:
   equal strings have their anchors at the same place. What a string with that anchor can
   reach is the anchor's context.
2. Contexts that occur twice are repeated as a whole. Of an anchor's remaining, different
   contexts one of each is compared with the others.
3. Their suffixes are sorted by a merge sort whose comparisons find common extensions
   from prefix polynomial hashes by binary search; neighbours in that order give a
   suffix's longest common extension, which the bytes verify.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.common import KEY, map_portions, text_key
from quillmap.session import materialise

LENGTH = 400
GRAM = 128
#: Different contexts of one anchor that are sorted in one task; more are compared by the
#: hashes of all their strings, which Spark groups.
CONTEXTS = 4_096
#: Contexts that a task sorts at once.
AT_ONCE = 4_096

_BASES = [np.uint64(x | 1) for x in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, count: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(count, base)]), dtype=np.uint64)


class PrefixHashes:
    """Polynomial hashes, modulo 2^64, of any stretch of one text."""

    def __init__(self, data: np.ndarray, base: np.uint64 = _BASES[0]):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.power = _powers(base, len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(inverse, len(data))[:-1], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.power[start]


def least_of_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values, in time independent of the width."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes of their grams, hashes of their contexts."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    hashes = PrefixHashes(data)
    at = np.arange(len(data) - gram + 1)
    value = _mixed(hashes.of(at, at + gram))
    low = np.uint64(0xFFFFFFFF)
    least = least_of_windows((value & ~low) | (low - at.astype(np.uint64)), length - gram + 1)
    place = (low - (least & low)).astype(np.int64)
    place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    start, end = context(place, len(data), length, gram)
    sides = ((place - start) * 65_536 + (end - place)).astype(np.uint64)
    return place, value[place], _mixed(hashes.of(start, end) + _mixed(sides))


def context(place, size: int, length: int = LENGTH, gram: int = GRAM):
    """From where to where strings reach that hold the gram at `place`."""
    return np.maximum(place - (length - gram), 0), np.minimum(place + length, size)


class Contexts:
    """Contexts in rows, their anchors in one column; equal columns hold comparable bytes."""

    def __init__(self, group: np.ndarray, before: np.ndarray, texts: list[bytes], length: int, gram: int):
        self.length, self.left = length, length - gram
        self.group, self.before = group, before
        sizes = np.array([len(t) for t in texts], np.int64)
        self.after = sizes - before
        self.bytes = np.zeros((len(texts), self.left + length), np.uint8)
        for row, (text, b) in enumerate(zip(texts, before.tolist())):
            self.bytes[row, self.left - b : self.left - b + len(text)] = np.frombuffer(text, np.uint8)
        self.hashed(0)

    def hashed(self, attempt: int) -> None:
        self.attempt = attempt
        weight = _powers(_BASES[attempt], self.bytes.shape[1])[:-1]
        self.prefix = np.zeros((len(self.bytes), self.bytes.shape[1] + 1), np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * weight, axis=1, out=self.prefix[:, 1:])

    def extension(self, one: np.ndarray, other: np.ndarray, column: int, back: bool = False) -> np.ndarray:
        """Common bytes of two rows from `column` on, or before it: binary search over prefix hashes."""
        low = np.zeros(len(one), np.int64)
        if back:
            high = np.minimum(self.before[one], self.before[other]) + column - self.left
        else:
            high = np.minimum(self.after[one], self.after[other]) + self.left - column
        from_one, from_other = self.prefix[one, column], self.prefix[other, column]
        while (low < high).any():
            middle = (low + high + 1) >> 1
            at = column - middle if back else column + middle
            same = self.prefix[one, at] - from_one == self.prefix[other, at] - from_other
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def less(self, one: np.ndarray, other: np.ndarray, column: int) -> np.ndarray:
        """Whether a suffix comes before another; one that begins the other comes first."""
        common = self.extension(one, other, column)
        end_one, end_other = (self.after[x] + self.left - column for x in (one, other))
        at = np.minimum(column + common, self.bytes.shape[1] - 1)
        differ = (common < end_one) & (common < end_other)
        return np.where(differ, self.bytes[one, at] < self.bytes[other, at], end_one < end_other)

    def sort(self, rows: np.ndarray, column: int) -> np.ndarray:
        """`rows`, which come by group, with each group's suffixes from `column` in order: merges of runs."""
        order = rows.copy()
        group = self.group[rows]
        first = np.searchsorted(group, group, side="left")
        size = np.searchsorted(group, group, side="right") - first
        inside = np.arange(len(rows)) - first
        width = 1
        while width < size.max(initial=1):
            mine = inside // width
            partner = np.minimum((mine ^ 1) * width, size)
            low, high = first + partner, first + np.minimum(partner + width, size)
            begin = low.copy()
            right = (mine & 1).astype(bool)  # of equal suffixes those of the left run come first
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) >> 1
                own, met = order[open_], order[middle]
                from_right = right[open_]
                one, other = np.where(from_right, own, met), np.where(from_right, met, own)
                below = self.less(one, other, column) ^ from_right
                low[open_] = np.where(below, middle + 1, low[open_])
                high[open_] = np.where(below, high[open_], middle)
            target = first + (mine >> 1) * 2 * width + inside % width + (low - begin)
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            width *= 2
        return order

    def verified(self, one: np.ndarray, other: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> bool:
        """Whether the bytes around the anchor agree as far as the hashes said."""
        place = np.arange(self.bytes.shape[1])
        inside = (place >= (self.left - behind)[:, None]) & (place < (self.left + ahead)[:, None])
        return not ((self.bytes[one] != self.bytes[other]) & inside).any()

    def repeated(self) -> np.ndarray:
        """For each row and start from the leftmost one to the anchor: whether its string repeats.

        A group's suffixes are sorted once, from the anchor on. Those that also agree from
        some start to the anchor keep their order among themselves, and a row's neighbour
        there agrees with it further than any other that holds this start. So do all
        starts back to where the two begin to agree. Rows that share a start with no other
        share none further left, and leave.
        """
        rows = self.sort(np.arange(len(self.group)), self.left)
        repeated = np.zeros((len(rows), self.left + 1), bool)
        lowest = self.left - self.before
        # the last start of a row about which nothing is known
        unknown = np.minimum(self.left, self.left + self.after - self.length)
        while True:
            column = np.full(self.group.max(initial=0) + 1, -1, np.int64)
            np.maximum.at(column, self.group[rows], np.where(unknown[rows] >= lowest[rows], unknown[rows], -1))
            column = column[self.group[rows]]
            stay = column >= np.maximum(lowest[rows], 0)
            rows, column = rows[stay], column[stay]
            if not len(rows):
                return repeated
            shared = self.prefix[rows, self.left] - self.prefix[rows, column]
            by = np.lexsort((np.arange(len(rows)), shared, self.group[rows]))
            rows, column, shared = rows[by], column[by], shared[by]
            next_ = np.flatnonzero((self.group[rows[1:]] == self.group[rows[:-1]]) & (shared[1:] == shared[:-1]))
            one, other = rows[next_], rows[next_ + 1]
            ahead = self.extension(one, other, self.left)
            behind = self.extension(one, other, self.left, back=True)
            if not self.verified(one, other, ahead, behind):
                self.hashed(self.attempt + 1)  # two stretches with one hash: start again with another base
                return self.repeated()
            width = self.bytes.shape[1] + 1
            best = np.full(len(self.group), -1, np.int64)
            np.maximum.at(best, one, ahead * width + behind)
            np.maximum.at(best, other, ahead * width + behind)
            met = best[rows] >= 0
            rows, column = rows[met], column[met]
            now = (unknown[rows] == column) & (unknown[rows] >= lowest[rows])
            ahead, behind = np.divmod(best[rows[now]], width)
            last = np.minimum(column[now], self.left + ahead - self.length)
            since = self.left - behind
            for row, a, b in zip(rows[now].tolist(), since.tolist(), last.tolist()):
                if a <= b:
                    repeated[row, a : b + 1] = True
            unknown[rows[now]] = np.minimum(since - 1, self.left + ahead - self.length)
            # `rows` are in order of their suffixes again for the next start
            rows = rows[np.lexsort((by[met], self.group[rows]))]


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, contexts: int = CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Every byte of a string of `length` bytes that also starts elsewhere, in the same
    document or another, is removed; strings are those of the input. Matches do not cross
    documents. Null texts count as empty; texts shorter than `length` are kept, texts that
    occur twice (repeated rows too) are removed as a whole. Contexts are told apart by 128 bits, what is
    sorted is verified by its bytes. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = materialise(
        docs.select(
            "doc_id", *text_key(F.col("text")), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("sha")
        )
    )
    suspects = _suspects(docs, length, gram, contexts)
    results = _judge(suspects, _found(suspects, length, gram), length, gram)
    copies = rows.groupBy(*KEY).agg(F.count("*").alias("copies"))
    judged = materialise(copies.join(results, KEY, "left"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.join(judged, KEY).select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, nothing).otherwise(F.lower(F.hex(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
    )


def _anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """gram, ctx, key_a, key_b, doc_id, places: a row for each different context of a text."""

    def work():
        seen: set[tuple[int, int]] = set()  # copies in a task count once: they are removed whole

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            grams, ctxs, places, source, lists = [], [], [], [], [0]
            texts = batch["text"].cast(pa.binary()).to_pylist()
            names = list(zip(batch["key_a"].to_pylist(), batch["key_b"].to_pylist()))
            for i, (data, name) in enumerate(zip(texts, names)):
                if data is None or len(data) < length or name in seen:
                    continue
                seen.add(name)
                place, value, ctx = anchors(np.frombuffer(data, np.uint8), length, gram)
                order = np.lexsort((place, value, ctx))
                place, value, ctx = place[order], value[order], ctx[order]
                first = np.concatenate([[True], (ctx[1:] != ctx[:-1]) | (value[1:] != value[:-1])])
                begins = np.flatnonzero(first)
                grams.append(value[begins])
                ctxs.append(ctx[begins])
                places.append(place)
                lists += (np.append(begins[1:], len(place)) + lists[-1]).tolist()
                source += [i] * len(begins)
            join = lambda parts, kind: np.concatenate(parts).view(kind) if parts else np.zeros(0, kind)
            source = pa.array(source, pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(join(grams, np.int64)),
                    pa.array(join(ctxs, np.int64)),
                    *(batch[c].take(source) for c in (*KEY, "doc_id")),
                    pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(join(places, np.int64), pa.int32())),
                ],
                ["gram", "ctx", *KEY, "doc_id", "places"],
            )

        return each

    narrow = docs.select("doc_id", "text", *text_key(F.col("text")))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return map_portions(narrow, work, f"gram long, ctx long, key_a long, key_b long, doc_id {kind}, places array<int>")


def _suspects(docs: DataFrame, length: int, gram: int, contexts: int) -> DataFrame:
    """key_a, key_b, text, members: texts with an anchor that occurs twice, once each.

    A member is a context: gram, places, covered (it occurs twice as a whole), compare
    (it stands for its like among an anchor's different contexts), many (of these).
    """
    anchored = _anchored(docs, length, gram)
    alike = anchored.groupBy("gram", "ctx").agg(
        F.sum(F.size("places")).alias("times"),
        F.min(F.struct(*KEY)).alias("first"),
    )
    by_gram = alike.groupBy("gram").agg(F.sum("times").alias("all"), F.count("*").alias("kinds")).where("all > 1")
    marks = materialise(alike.join(by_gram.select("gram", "kinds"), "gram"))
    members = (
        anchored.join(marks, ["gram", "ctx"])
        .withColumn(
            "member",
            F.struct(
                "gram",
                "places",
                (F.col("times") > 1).alias("covered"),
                ((F.col("kinds") > 1) & (F.struct(*KEY) == F.col("first"))).alias("compare"),
                (F.col("kinds") > contexts).alias("many"),
            ),
        )
        .groupBy(*KEY)
        .agg(F.min("doc_id").alias("doc_id"), F.collect_set("member").alias("members"))
    )
    texts = docs.select(F.col("doc_id").alias("_id"), "text", *[c.alias(f"_{k}") for c, k in zip(text_key(F.col("text")), KEY)])
    fetched = members.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key_a") == F.col("_key_a")) & (F.col("key_b") == F.col("_key_b")))
    return materialise(fetched.select(*KEY, "text", "members"))


def _found(suspects: DataFrame, length: int, gram: int) -> DataFrame:
    """key_a, key_b, start, end: stretches that are repeated among an anchor's different contexts."""
    pieces = (
        suspects.select(*KEY, "text", F.explode("members").alias("m"))
        .where("m.compare")
        .select(*KEY, F.col("text").cast("binary").alias("text"), "m.gram", "m.many", F.get("m.places", F.lit(0)).cast("long").alias("place"))
    )
    left = length - gram
    pieces = pieces.select(
        *KEY,
        "gram",
        "many",
        "place",
        F.least("place", F.lit(left)).cast("long").alias("before"),
        F.substring("text", F.greatest(F.col("place") - left, F.lit(0)).cast("int") + 1, F.least("place", F.lit(left)).cast("int") + length).alias("bytes"),
    )
    pieces = materialise(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(held: list[tuple]) -> pa.RecordBatch:
            held = list(dict.fromkeys(held))  # repeated rows of one document
            grams, group = np.unique(np.array([h[0] for h in held], np.int64), return_inverse=True)
            order = np.argsort(group, kind="stable")
            held = [held[i] for i in order]
            table = Contexts(group[order], np.array([h[2] for h in held], np.int64), [h[3] for h in held], length, gram)
            out = []
            for row, starts in enumerate(table.repeated()):
                for a, b in runs(starts):  # starts count from the left end of a full context
                    base = held[row][1] - left
                    out.append((*held[row][4:], base + a, base + b - 1 + length))
            columns = list(zip(*out)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [*KEY, "start", "end"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("gram", "place", "before", "bytes", *KEY))):
                if len(held) >= AT_ONCE and row[0] != held[-1][0]:
                    yield finish(held)
                    held = []
                held.append(row)
        if held:
            yield finish(held)

    schema = "key_a long, key_b long, start long, end long"
    partitions = int(suspects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = pieces.where("NOT many").repartition(partitions, "gram").sortWithinPartitions("gram").mapInArrow(run, schema)

    def strings():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], []]
            for i, (data, before) in enumerate(zip(batch["bytes"].to_pylist(), batch["before"].to_pylist())):
                start = np.arange(max(0, len(data) - length + 1))
                # as in the sort, only strings with the anchor at one place are alike
                side = (start + left - before).astype(np.uint64)
                string = PrefixHashes(np.frombuffer(data, np.uint8)).of(start, start + length)
                out[0].append(_mixed(string + _mixed(side)).view(np.int64))
                out[1].append(start)
                out[2].append(np.full(len(start), i))
            string, start, row = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
            taken = [batch[c].take(pa.array(row, pa.int64())) for c in ("gram", *KEY)]
            first = pa.compute.subtract(batch["place"], batch["before"]).take(pa.array(row, pa.int64()))
            return pa.RecordBatch.from_arrays(
                [*taken, pa.array(string), pa.compute.add(first, pa.array(start, pa.int64()))], ["gram", *KEY, "string", "start"]
            )

        return each

    hashed = map_portions(
        pieces.where("many").dropDuplicates(["gram", "place", *KEY]), strings, "gram long, key_a long, key_b long, string long, start long", "bytes"
    )
    twice = hashed.groupBy("gram", "string").agg(F.count("*").alias("times")).where("times > 1").drop("times")
    grouped = hashed.join(twice, ["gram", "string"]).select(*KEY, "start", (F.col("start") + length).alias("end"))
    return materialise(sorted_.unionByName(grouped))


def _judge(suspects: DataFrame, found: DataFrame, length: int, gram: int) -> DataFrame:
    """key_a, key_b, n_removed, n_spans, kept_sha of texts with anchors that occur twice."""

    def work():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for data, members, spans in zip(
                batch["text"].cast(pa.binary()).to_pylist(), batch["covered"].to_pylist(), batch["spans"].to_pylist()
            ):
                edge = np.zeros(len(data) + 1, np.int64)
                if members:
                    place = np.array(members, np.int64)
                    start, end = context(place, len(data), length, gram)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, end, -1)
                for span in spans or []:
                    edge[span["start"]] += 1
                    edge[span["end"]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((int(gone.sum()), len(runs(gone)), hashlib.sha256(kept).digest()))
            columns = list(zip(*out)) or [[]] * 3
            kinds = (pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [*(batch[k] for k in KEY), *(pa.array(c, k) for c, k in zip(columns, kinds))], [*KEY, "n_removed", "n_spans", "kept_sha"]
            )

        return each

    spans = found.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    covered = F.flatten(F.transform(F.filter("members", lambda m: m["covered"]), lambda m: m["places"]))
    joined = suspects.select(*KEY, "text", covered.alias("covered")).join(spans, KEY, "left")
    judged = map_portions(joined, work, "key_a long, key_b long, n_removed long, n_spans long, kept_sha binary")
    return judged.dropDuplicates(KEY)  # repeated rows of one document
