"""N-gram Jaccard join: R-trees over count vectors, verified on the shingle sets.

1. Every text becomes the set of its hashed word shingles; equal sets are one class.
2. Keys bring classes together that may pass. From PREFIXED percent on, sets that pass
   differ in at most D elements: hashes are cut into more than D ranges, so that one range
   holds the same elements in both, and its content is a key. Below, keys are the first
   elements of a set, as many as two sets that pass cannot both have for themselves.
3. Elements are hashed into groups, the counts by group are points of an R-tree. The sum
   of the smaller coordinates bounds the overlap with a point, with a box's upper corner
   that with all points in it. Classes of a key whose points may pass form clusters.
4. In a cluster what survives the bound is verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmap.llm.common import KEY, map_portions, small_batches, text_key
from quillmap.llm.components import components
from quillmap.operators.numbering import number_rows
from quillmap.session import materialise, materialise_at, new_shared_path, remove_shared

WIDTH = 3
PERCENT = 90
#: Limits below this take the first elements of a set as keys.
PREFIXED = 85
#: Growth of the size bands; above 100 / PERCENT, so that a pair spans two bands at most.
BAND_GROWTH = 1.5
#: Coordinates of a point, sums of them that boxes have, children of a box.
GROUPS = 256
COARSE = 64
FANOUT = 12
#: Classes of a tile of a key's R-tree.
TILE_CLASSES = 1_000
#: Classes and shingles of one block of a cluster; larger clusters are linked block by block.
BLOCK_CLASSES = 2_000
BLOCK_SHINGLES = 2_500_000

_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a shorter text is one as a whole."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # lowers A-Z only, splits at bytes
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < width:
        odd = np.array([_ODD[i % 5] for i in range(len(words))])
        return _mixed((hashes * odd).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(words)))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        total += np.roll(hashes, -i)[: len(total)] * _ODD[i % 5] + np.uint64(i)
    return np.unique(_mixed(total))


def class_of(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


def _band(size: int) -> tuple[int, int, int]:
    """(number, least size, least size of the next) of the band that holds `size`."""
    low, number = 1, 0
    while True:
        high = max(low + 1, int(low * BAND_GROWTH))
        if size < high:
            return number, low, high
        low, number = high, number + 1


def range_keys(elements: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of which two sets over the limit share one, unless they are equal.

    Of sets a, b whose larger one is in a band, the symmetric difference has at most
    (100 - p) / (100 + p) * (|a| + |b|) elements. Of more ranges than that one agrees.
    It may be empty in both only if either fills no more ranges than may differ; such
    sets emit their empty ranges too.
    """
    size = len(elements)
    number, _, high = _band(size)
    schemes = [(number, high)]
    if 100 * size >= percent * high:  # may link to a set of the next band
        schemes.append((number + 1, max(high + 1, int(high * BAND_GROWTH))))
    out = []
    for number, top in schemes:
        differ = 2 * (top - 1) * (100 - percent) // (100 + percent)
        if differ:  # else only equal sets pass
            ranges = differ + differ // 10 + 2
            content, full = _contents(elements, ranges)
            keys = content + np.arange(ranges, dtype=np.uint64) * _ODD[3]
            out.append(_mixed((keys if full.sum() <= differ else keys[full]) + np.uint64(number)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _contents(elements: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of what each range of the hashes holds, and whether it holds anything."""
    place = (((elements >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
    filled, start = np.unique(place, return_index=True)
    content, full = np.zeros(ranges, np.uint64), np.zeros(ranges, bool)
    content[filled], full[filled] = np.add.reduceat(_mixed(elements + _ODD[2]), start), True
    return content, full


def prefix_keys(elements: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(p n) + 1 of n elements, in the order of their hashes.

    Two sets over the limit have ceil(p n) elements or more in common, so that the first
    common one has at most n - ceil(p n) others before it, in either set.
    """
    return elements[: len(elements) + percent * len(elements) // -100 + 1]


def keys_of(elements: np.ndarray, percent: int) -> np.ndarray:
    return prefix_keys(elements, percent) if percent < PREFIXED else range_keys(elements, percent)


class CountTree:
    """An R-tree, packed from leaves of points that are near each other in size and counts.

    Boxes, and points at first, are held against COARSE sums of coordinates, which bound the
    overlap less closely, but soon.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.coarse = _coarse(points)
        self.order = np.lexsort((*(points[:, g] for g in range(2)), sizes))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # upper corners, least and largest size
        high, least, most = self.coarse[self.order], sizes[self.order], sizes[self.order]
        while len(high) > FANOUT:
            starts = np.arange(0, len(high), FANOUT)
            high = np.maximum.reduceat(high, starts)
            least, most = np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)
            self.levels.append((high, least, most))

    def search(self, point: np.ndarray, size: int, percent: int, among: np.ndarray | None = None) -> np.ndarray:
        """Points that may pass: their overlap bound reaches what the limit asks for.

        among: which points are of interest, all by default.
        """
        coarse = _coarse(point[None, :])[0]
        nodes = np.arange(len(self.levels[-1][0]) if self.levels else len(self.order))
        for i in range(len(self.levels) - 1, -1, -1):
            high, least, most = self.levels[i]
            nodes = nodes[self._may(high[nodes], least[nodes], most[nodes], coarse, size, percent)]
            nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            nodes = nodes[nodes < (len(self.levels[i - 1][0]) if i else len(self.order))]
        rows = self.order[nodes]
        if among is not None:
            rows = rows[among[rows]]
        for counts, own in ((self.coarse, coarse), (self.points, point)):
            s = self.sizes[rows]
            rows = rows[self._may(counts[rows], s, s, own, size, percent)]
        return rows

    @staticmethod
    def _may(high, least, most, point, size, percent) -> np.ndarray:
        overlap = np.minimum(high, point).sum(axis=1, dtype=np.int64)
        return (
            ((100 + percent) * overlap >= percent * (least + size))
            & (100 * size >= percent * least)
            & (100 * most >= percent * size)
        )


def _coarse(points: np.ndarray) -> np.ndarray:
    width = points.shape[1]
    sums = points.reshape(len(points), min(COARSE, width), -1).sum(axis=2, dtype=np.int64)
    return sums.astype(np.int16 if sums.size and sums.max() < 1 << 15 else np.int32 if sums.size and sums.max() < 1 << 31 else np.int64)


def fine_groups(size: int) -> int:
    """More groups for larger sets: some eight elements to a group tell sets apart."""
    return max(GROUPS, 1 << max(0, (size // 8 - 1).bit_length()))


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Counts by fewer groups; groups are the lowest bits of a hash."""
    return counts.reshape(-1, groups).sum(axis=0)


def finely_near(fine: list[np.ndarray], sizes: np.ndarray, i: int, near: np.ndarray, percent: int) -> np.ndarray:
    """Those of `near` whose overlap with i may reach the limit by the finest groups that both have."""
    keep = []
    for j in near.tolist():
        groups = min(len(fine[i]), len(fine[j]))
        overlap = groups == GROUPS or (100 + percent) * int(np.minimum(folded(fine[i], groups), folded(fine[j], groups)).sum()) >= percent * int(sizes[i] + sizes[j])
        keep.append(bool(overlap))
    return near[np.array(keep, bool)]


def counts_by_group(elements: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((elements & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int64)


def packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest one needs, two to a byte if all are below 16."""
    most = int(counts.max(initial=0))
    if most < 16:
        return (counts[0::2] << 4 | counts[1::2]).astype("u1").tobytes()
    return counts.astype(np.min_scalar_type(most).newbyteorder("<")).tobytes()


def unpacked(point: bytes, size: int) -> np.ndarray:
    """The counts of a set of `size` elements from `packed` ones of any width."""
    groups = fine_groups(size)
    if len(point) < groups:
        both = np.frombuffer(point, "u1")
        return np.stack([both >> 4, both & 15], axis=1).ravel().astype(np.int32)
    return np.frombuffer(point, f"<u{len(point) // groups}").astype(np.int32)


def similar(one: np.ndarray, other: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(other) - both)


def link_block(names: list[bytes], labels: list[bytes], sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Links that join all classes of a block that hang together; `labels` already do."""
    known = {label: i for i, label in enumerate(dict.fromkeys(labels))}
    part = np.array([known[label] for label in labels])
    sizes = np.array([len(s) for s in sets], np.int64)
    fine = [counts_by_group(s, fine_groups(len(s))).astype(np.int32) for s in sets]
    points = np.stack([folded(f, GROUPS) for f in fine])
    tree = CountTree(points, sizes)
    links = []
    for i in range(len(sets)):
        near = finely_near(fine, sizes, i, tree.search(points[i], sizes[i], percent, part != part[i]), percent)
        while len(near):
            j = near[0]
            if similar(sets[i], sets[j], percent):
                links.append((names[i], names[j]))
                part[part == part[j]] = part[i]
            near = near[1:]
            near = near[part[near] != part[i]]
    return links


def _links(rows: DataFrame, percent: int, width: int) -> DataFrame:
    """(one, other) from (cluster, block, class, label, text); a block's rows meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(held: dict[bytes, tuple[bytes, np.ndarray]]) -> list[tuple[bytes, bytes]]:
            names = sorted(held)
            return link_block(names, [held[n][0] for n in names], [held[n][1] for n in names], percent)

        now, held = None, {}
        for batch in batches:
            out = []
            columns = (batch[c].to_pylist() for c in ("cluster", "block", "class", "label", "text"))
            for cluster, block, name, label, text in zip(*columns):
                if (cluster, block) != now:
                    if len(held) > 1:
                        out += finish(held)
                    now, held = (cluster, block), {}
                if name not in held:
                    held[name] = (label, shingles(text, width))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)] or [pa.array([], pa.binary())] * 2, ["one", "other"])
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary()) for c in zip(*finish(held))] or [pa.array([], pa.binary())] * 2, ["one", "other"]
            )

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        small_batches(rows).select("cluster", "block", "class", "label", "text")
        .repartition(partitions, "cluster", "block")
        .sortWithinPartitions("cluster", "block")
        .mapInArrow(run, "one binary, other binary")
    )


def classes(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """A row for each document, from one pass over the texts.

    doc_id, key_a, key_b (of the text), class (128 bits of its shingle set; null when
    empty), number (64 bits of the class), n_shingles, and once a task for each class its
    keys and its point. Two classes of one number, should there be any, are candidates of
    each other; nothing is lost by it.
    """

    def work():
        seen: set[bytes] = set()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch["text"].to_pylist():
                elements = shingles(text, width)
                name = class_of(elements) if len(elements) else None
                keys = point = None
                if name is not None and name not in seen:
                    seen.add(name)
                    keys = keys_of(elements, percent).view(np.int64)
                    point = packed(counts_by_group(elements, fine_groups(len(elements))))
                number = None if name is None else int.from_bytes(name[:8], "big", signed=True)
                rows.append((name, number, len(elements), keys, point))
            columns = list(zip(*rows)) or [[]] * len(_OF_CLASS)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("doc_id", *KEY)), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *KEY, *_OF_CLASS]
            )

        return each

    narrow = docs.select("doc_id", *text_key(F.col("text")), "text")
    kinds = (T.BinaryType(), T.LongType(), T.LongType(), T.ArrayType(T.LongType()), T.BinaryType())
    schema = T.StructType(
        [*(narrow.schema[c] for c in ("doc_id", *KEY)), *(T.StructField(c, k) for c, k in zip(_OF_CLASS, kinds))]
    )
    return map_portions(narrow, work, schema)


_OF_CLASS = ("class", "number", "n_shingles", "keys", "point")


def candidate_links(rows: DataFrame, percent: int) -> DataFrame:
    """(one, other): numbers of classes that share a key and whose points may pass, enough to connect all such.

    A passage that many documents share would chain them all. Each key has an R-tree of its
    own, of the points of its classes; that of a key with more than TILE_CLASSES is cut into
    tiles by the sizes of the sets. Tiles meet in pairs, unless their sizes are too far apart.
    """
    keys = rows.where("keys IS NOT NULL").select(F.explode("keys").alias("key"), "number")
    points = rows.where("point IS NOT NULL").groupBy("class").agg(
        F.first("number").alias("number"), F.first("n_shingles").alias("size"), F.first("point").alias("point")
    )
    # near copies share many keys: one of those that hold the same classes stands for all
    shared = materialise(_shared_keys(keys).select("set_a", "set_b", "n", "number").distinct())
    small = shared.where(F.col("n") <= TILE_CLASSES).select(*_SET, F.lit(0).alias("tile"), F.lit(0).alias("with"), "number")
    large = shared.where(F.col("n") > TILE_CLASSES)
    met = small if large.isEmpty() else small.unionByName(_tile_pairs(large, points.select("number", "size"), percent))
    met = met.join(points, "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(batch[c].to_pylist() for c in columns)):
                if held and row[:4] != held[0][:4]:
                    out += link_points(held, percent)
                    held = []
                held.append(row)
            yield _link_batch(out)
        yield _link_batch(link_points(held, percent))

    columns = [*_SET, "tile", "with", "number", "size", "point"]
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = small_batches(met).select(*columns).repartition(partitions, *columns[:4]).sortWithinPartitions(*columns[:4])
    return ordered.mapInArrow(run, "one long, other long").distinct()


_SET = ("set_a", "set_b")


def _tile_pairs(large: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(set_a, set_b, tile, with, number): the classes of each two tiles of a set that may have links."""
    placed = number_rows(large.join(sizes.distinct(), "number"), _SET, "size", ["number"], TILE_CLASSES, "place")
    tiled = materialise(placed.select(*_SET, ((F.col("place") - 1) / TILE_CLASSES).cast("int").alias("tile"), "number", "size"))
    boxes = tiled.groupBy(*_SET, "tile").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    others = boxes.select(*_SET, F.col("tile").alias("with"), F.col("low").alias("other_low"))
    near = (F.col("tile") <= F.col("with")) & (100 * F.col("high") >= percent * F.col("other_low"))
    pairs = boxes.join(others, list(_SET)).where(near).select(*_SET, "tile", "with")
    sides = pairs.select(*_SET, "tile", "with", F.explode(F.array_distinct(F.array("tile", "with"))).alias("own"))
    return sides.join(tiled.withColumnRenamed("tile", "own"), [*_SET, "own"]).select(*_SET, "tile", "with", "number")


def link_points(held: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links that connect the classes (.., number, size, point) of one key whose points may pass."""
    if len(held) < 2:
        return []
    fine = [unpacked(h[-1], h[-2]) for h in held]
    points = np.stack([folded(f, GROUPS) for f in fine]).astype(np.int32)
    sizes = np.array([h[-2] for h in held], np.int64)
    order = np.lexsort((points[:, 0], sizes))
    points, sizes, names, fine = points[order], sizes[order], [held[i][-3] for i in order], [fine[i] for i in order]
    # neighbours first: near copies are one part by then, and no search is needed
    passes = CountTree._may(points[1:], sizes[1:], sizes[1:], points[:-1], sizes[:-1], percent)
    for i in np.flatnonzero(passes).tolist():
        passes[i] = len(finely_near(fine, sizes, i, np.array([i + 1]), percent)) > 0
    links = [(names[i], names[i + 1]) for i in np.flatnonzero(passes)]
    part = np.concatenate([[0], np.cumsum(~passes)])
    if not part[-1]:
        return links
    tree = CountTree(points, sizes)
    for i in range(len(names)):
        near = finely_near(fine, sizes, i, tree.search(points[i], sizes[i], percent, part != part[i]), percent)
        while len(near):
            links.append((names[i], names[near[0]]))
            part[part == part[near[0]]] = part[i]
            near = near[part[near] != part[i]]
    return links


def _shared_keys(keys: DataFrame) -> DataFrame:
    """(number, n, set_a, set_b): the classes of each key that several have.

    `n` counts a key's classes, (set_a, set_b) stands for all of them. A key's rows are
    spilled, never held.
    """
    of_key = Window.partitionBy("key")
    met = keys.repartition("key").distinct().select(
        "number",
        F.count("*").over(of_key).alias("n"),
        F.bit_xor(F.xxhash64("number")).over(of_key).alias("set_a"),
        F.bit_xor(F.xxhash64(F.lit(1), "number")).over(of_key).alias("set_b"),
    )
    # a pair of classes or a whole set is met under many keys
    return met.where("n > 1").distinct()


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = list(zip(*links)) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["one", "other"])


def join_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Documents link when 100 * |intersection| >= percent * |union| of their shingle sets.
    component_id is the least doc_id reachable by links, the document's own included (null
    ids do not count unless all are null). Null, empty and wordless texts have no shingles
    and link with nothing. Equal texts and repeated rows share a class. Shingles are told
    apart by 64 bits. Other columns are not read.
    """
    return _joined(docs, percent, width).drop(*KEY)


def _joined(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, key_a, key_b, n_shingles, component_id."""
    spark = docs.sparkSession
    path = new_shared_path(spark, "classes")
    whole = materialise_at(classes(docs, percent, width), path)
    clusters = components(candidate_links(whole, percent))
    # keys and points are most of that table and done with
    rows = materialise(whole.drop("keys", "point"))
    remove_shared(spark, path)
    sizes = (
        clusters.join(rows.where("class IS NOT NULL").groupBy("class").agg(
            F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("number").alias("number")), F.col("node") == F.col("number"))
        .select(F.col("root").alias("cluster"), "class", "doc_id", "n")
    )
    sizes = materialise(sizes)
    blocks = sizes.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks")
    )
    wanted = sizes.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    texts = docs.select(F.col("doc_id").alias("_id"), "text")
    # an id that is not unique brings other texts along; their classes tell. Candidates grow
    # with the documents: they are met by a shuffle at any size
    fetched = materialise(
        _of_class(wanted.hint("merge").join(texts, F.col("doc_id").eqNullSafe(F.col("_id"))).select("cluster", "blocks", "block", "class", "text"), width)
    )
    fetched = fetched.withColumn("label", F.col("class"))
    links = materialise(_links(fetched, percent, width))
    large = fetched.where("blocks > 1")
    if not large.isEmpty():
        links = _across_blocks(large, links, percent, width)
    roots = components(links)
    grouped = rows.join(roots, F.col("class") == F.col("node"), "left").select(
        "doc_id", *KEY, "n_shingles", F.coalesce("root", "class").alias("set")
    )
    grouped = materialise(grouped)
    least = grouped.where("set IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(least, "set", "left").select(
        "doc_id", *KEY, "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _of_class(rows: DataFrame, width: int) -> DataFrame:
    """The rows whose text has the class that was asked for."""

    def work():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            right = [class_of(shingles(t, width)) == c for t, c in zip(batch["text"].to_pylist(), batch["class"].to_pylist())]
            return batch.filter(pa.array(right, pa.bool_()))

        return each

    return map_portions(rows, work, rows.schema)


def _across_blocks(large: DataFrame, links: DataFrame, percent: int, width: int) -> DataFrame:
    """Links between the blocks of clusters that have several.

    First one class for each part of a block is linked with those of the other blocks.
    Then all pairs of blocks of what still falls into several parts are compared; classes
    of one part are not compared again.
    """

    def labelled(found: DataFrame) -> DataFrame:
        roots = components(found)
        return large.drop("label").join(roots, F.col("class") == F.col("node"), "left").select(
            "cluster", "blocks", "block", "class", F.coalesce("root", "class").alias("label"), "text"
        )

    def several(rows: DataFrame) -> DataFrame:
        parts = rows.groupBy("cluster").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        return rows.join(parts.where("low <> high").select("cluster"), "cluster", "left_semi")

    heads = several(labelled(links)).where(F.col("class") == F.col("label"))
    counts = heads.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK_CLASSES).alias("head_blocks"))
    heads = heads.join(counts, "cluster").withColumn("block", F.pmod(F.xxhash64("class"), F.col("head_blocks")).cast("int"))
    links = materialise(links.unionByName(_links(heads, percent, width)))
    rest = materialise(several(labelled(links)))
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks").cast("int") - 1),
        lambda k: (F.least(k, F.col("block")) * F.col("blocks") + F.greatest(k, F.col("block"))).cast("long"),
    )
    pairs = rest.withColumn("block", F.explode(others))
    return materialise(links.unionByName(_links(pairs, percent, width)))


def keep_one(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The document of least id of each component, with all its columns; repeated rows count once.

    Of documents that share the least id, but not the text, all stay.
    """
    found = _joined(docs, percent, width)
    dropped = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", *KEY).distinct()
    rows = docs.select("doc_id", *text_key(F.col("text")), F.struct("*").alias("row"), F.lit(False).alias("gone"))
    marks = materialise(dropped).select("doc_id", *KEY, F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.lit(True).alias("gone"))
    # repeated rows and what is dropped meet in one shuffle of the texts
    told = rows.unionByName(marks).groupBy("doc_id", *KEY).agg(F.first("row", ignorenulls=True).alias("row"), F.max("gone").alias("gone"))
    return told.where("NOT gone").select("row.*")
