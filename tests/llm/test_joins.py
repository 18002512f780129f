"""Operators that bring like texts together: n-gram join, suffix dedup, line templates, components."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillmap.llm import ngram_join, suffix_dedup, templates
from quillmap.llm.components import components
from quillmap.session import shared_dir
from tests.llm.conftest import WORDS, prose

# components


def least_reachable(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(110)],
        "path": [(i, i + 1) for i in range(40)],
        "star": [(99, i) for i in range(60)],
        "none": [],
    }[shape]
    got = components(spark.createDataFrame(edges, "one long, other long")).collect()
    assert {r.node: r.root for r in got} == least_reachable([e for e in edges if e[0] != e[1]])
    assert len(got) == len({r.node for r in got})


# n-gram join


def shingles_by_hand(text, width):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def join_by_hand(rows, percent, width):
    sets = [shingles_by_hand(t, width) for _, t in rows]
    names = [(i, r[0]) for i, r in enumerate(rows)]
    edges = [(a, a) for a in range(len(rows))]
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                edges.append((a, b))
    root = least_reachable(edges)
    out = []
    for i, doc_id in names:
        ids = [d for j, d in names if root[j] == root[i] and d is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids and sets[i] else doc_id))
    return sorted(out, key=str)


def edited_copies(rng):
    texts = [prose(rng, rng.choice([1, 2, 3, 8, 9, 10, 11, 14, 30, 60, 150])) for _ in range(60)]
    for _ in range(160):
        words = rng.choice(texts).split()
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randrange(2)] = rng.choices("pqrs", k=rng.randrange(2))
        texts.append(" ".join(words))
    return texts + ["x y", "X  y", "", None, "   "]


@pytest.mark.parametrize("percent, width, block", [(90, 3, 2_000), (80, 5, 2_000), (90, 3, 7), (80, 5, 3)])
def test_ngram_join(make_docs, percent, width, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    docs = make_docs(edited_copies(random.Random(percent + block)))
    rows = docs.select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in ngram_join.join_components(docs, percent, width).collect()), key=str)
    assert got == join_by_hand([tuple(r) for r in rows], percent, width)


@pytest.mark.parametrize("tile", [4, 7, 1_000])
def test_keys_of_any_size_connect_what_may_pass(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE_CLASSES", tile)
    rng = np.random.default_rng(tile)
    base = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (12, 20, 60)]
    sets = [np.unique(np.concatenate([base[rng.integers(0, 3)], rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(40)]
    points = [ngram_join.counts_by_group(s) for s in sets]
    rows = [
        (bytes([i]), i, len(s), [1, 2] if i % 2 else [1], p.astype("<u4").tobytes()) for i, (s, p) in enumerate(zip(sets, points))
    ]
    rows += [(bytes([i]), i, len(s), None, None) for i, s in enumerate(sets)]
    of_class = spark.createDataFrame(rows, "class binary, number long, n_shingles long, keys array<long>, point binary").repartition(3)
    links = [(r.one, r.other) for r in ngram_join.candidate_links(of_class, 80).collect()]
    may = may_pass(sets, points)
    own = [(i, i) for i in range(40)]
    assert set(map(tuple, map(sorted, links))) <= set(map(tuple, map(sorted, may)))
    assert least_reachable(links + own) == least_reachable(may + own)


def may_pass(sets, points):
    return [
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if 180 * np.minimum(points[a], points[b]).sum() >= 80 * (len(sets[a]) + len(sets[b]))
        and 100 * min(len(sets[a]), len(sets[b])) >= 80 * max(len(sets[a]), len(sets[b]))
    ]


def test_keys_of_equal_classes_are_one(spark):
    rows = [(k, i) for k in range(40) for i in range(3)] + [(99, 7)]
    found = ngram_join._shared_keys(spark.createDataFrame(rows, "key long, number long")).collect()
    assert len(found) == 3 and {r.n for r in found} == {3} and len({(r.set_a, r.set_b) for r in found}) == 1


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("common", [60, 100, 150])
def test_a_shared_passage_links_no_unrelated_texts(percent, common):
    """Texts of 200 shingles of which `common` are a passage: none passes the limit, few points may."""
    rng = np.random.default_rng(common)
    passage = rng.integers(0, 2**63, common).astype(np.uint64)
    held = []
    for i in range(400):
        elements = np.unique(np.concatenate([passage, rng.integers(0, 2**63, 200 - common).astype(np.uint64)]))
        held.append((0, 0, i, len(elements), ngram_join.counts_by_group(elements).astype("<u4").tobytes()))
    assert len(ngram_join.link_points(held, percent)) <= 4


def test_long_texts_have_finer_points():
    rng = np.random.default_rng(7)
    passage, held = rng.integers(0, 2**63, 600).astype(np.uint64), []
    for i in range(40):
        elements = np.unique(np.concatenate([passage, rng.integers(0, 2**63, 20_000).astype(np.uint64)]))
        held.append((0, 0, i, len(elements), ngram_join.counts_by_group(elements, ngram_join.fine_groups(len(elements))).astype("<u4").tobytes()))
    near = np.unique(np.concatenate([elements[500:], rng.integers(0, 2**63, 300).astype(np.uint64)]))  # like the last one
    held.append((0, 0, 40, len(near), ngram_join.counts_by_group(near, ngram_join.fine_groups(len(near))).astype("<u4").tobytes()))
    assert [tuple(sorted(link)) for link in ngram_join.link_points(held, 80)] == [(39, 40)]


def test_points_of_one_key_are_connected_if_they_may_pass():
    rng = np.random.default_rng(4)
    for _ in range(40):
        base = [rng.integers(0, 2**63, rng.integers(3, 60)).astype(np.uint64) for _ in range(4)]
        sets = [np.unique(np.concatenate([base[rng.integers(0, 4)], rng.integers(0, 2**63, rng.integers(0, 5)).astype(np.uint64)])) for _ in range(30)]
        held = [(0, 0, i, len(s), ngram_join.counts_by_group(s).astype("<u4").tobytes()) for i, s in enumerate(sets)]
        points = [ngram_join.counts_by_group(s) for s in sets]
        may = may_pass(sets, points)
        own = [(i, i) for i in range(30)]
        assert least_reachable(ngram_join.link_points(held, 80) + own) == least_reachable(may + own)


@pytest.mark.parametrize("size, most", [(0, 0), (200, 15), (200, 16), (5_000, 15), (5_000, 300), (5_000, 70_000)])
def test_points_are_packed(size, most):
    counts = np.random.default_rng(most).integers(0, 3, ngram_join.fine_groups(size))
    counts[5] = most
    point = ngram_join.packed(counts)
    assert ngram_join.unpacked(point, size).tolist() == counts.tolist()
    assert ngram_join.unpacked(counts.astype("<u4").tobytes(), size).tolist() == counts.tolist()
    assert len(point) == len(counts) * next(w for w, top in ((0.5, 16), (1, 1 << 8), (2, 1 << 16), (4, 1 << 32)) if most < top)


def test_points_of_prose_are_small(make_docs):
    texts = [prose(random.Random(i), 150) for i in range(20)]
    assert all(len(r.point) <= ngram_join.GROUPS / 2 for r in ngram_join.classes(make_docs(texts)).where("point IS NOT NULL").collect())


def test_texts_are_shuffled_once_to_keep_one(spark, make_docs):
    texts = edited_copies(random.Random(2))
    docs = make_docs(texts + texts[:5])
    plan = ngram_join.keep_one(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_keys_do_not_stay_on_disk(spark, make_docs):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    ngram_join.join_components(make_docs(edited_copies(random.Random(3)))).collect()
    tables = [next(t.glob("*.parquet")) for t in set(folder.iterdir()) - before]
    assert tables and not any({"keys", "point"} & set(pq.read_schema(t).names) for t in tables)


def test_ngram_join_awkward(awkward, empty):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in ngram_join.join_components(awkward).collect()), key=str)
    assert got == join_by_hand(rows, 90, 3)
    kept = ngram_join.keep_one(awkward)
    assert kept.columns == awkward.columns
    stay = {tuple(r) for r in rows if r[0] in (0, 1, 2, 3, 4, 5, 9, 10, 11, 12, 13, 14) or "used id" in (r[1] or "") or r == (None, None)}
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(str(Row(doc_id=i, text=t)) for i, t in stay)
    assert ngram_join.join_components(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_sets_over_the_limit_share_a_range(percent):
    rng = np.random.default_rng(percent)
    for _ in range(1_500):
        common = rng.integers(0, 2**63, rng.integers(4, 120)).astype(np.uint64)
        extra = [rng.integers(0, 2**63, rng.integers(0, 1 + len(common) // 7)).astype(np.uint64) for _ in "ab"]
        a, b = (np.unique(np.concatenate([common, e])) for e in extra)
        if ngram_join.similar(a, b, percent) and not np.array_equal(a, b):
            assert set(ngram_join.keys_of(a, percent).tolist()) & set(ngram_join.keys_of(b, percent).tolist())


def test_tree_finds_all_that_may_pass():
    rng = np.random.default_rng(2)
    points = rng.poisson(2, (700, 8))
    points[300:] = points[rng.integers(0, 300, 400)] + (rng.random((400, 8)) < 0.1)
    sizes = points.sum(axis=1)
    tree = ngram_join.CountTree(points, sizes)
    for i in range(0, 700, 13):
        overlap = np.minimum(points, points[i]).sum(axis=1)
        need = (190 * overlap >= 90 * (sizes + sizes[i])) & (100 * sizes[i] >= 90 * sizes) & (100 * sizes >= 90 * sizes[i])
        assert set(tree.search(points[i], sizes[i], 90).tolist()) == set(np.flatnonzero(need).tolist())


# suffix dedup


def repeats_by_hand(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    times = {}
    for _, d in data:
        for i in range(len(d) - length + 1):
            times[d[i : i + length]] = times.get(d[i : i + length], 0) + 1
    out = []
    for doc_id, d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)]), prepend=0).clip(0).sum())
        out.append((doc_id, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(rng):
    shared = [prose(rng, n) for n in (9, 14, 30, 70)]
    texts = []
    for _ in range(70):
        parts = [rng.choice(shared)[rng.randrange(20) :] if rng.random() < 0.4 else prose(rng, rng.randrange(1, 15)) for _ in range(rng.randrange(1, 6))]
        texts.append(" é".join(parts))
    texts += ["of " * 300, "the " * 150 + shared[0], "abc" * 60 + shared[1] + "abc" * 50, None, "", texts[0], texts[1], texts[1]]
    return texts


@pytest.mark.parametrize("length, gram, contexts", [(64, 24, 4_096), (64, 24, 3), (64, 24, 0), (100, 60, 4_096), (40, 12, 4_096)])
def test_suffix_dedup(make_docs, length, gram, contexts):
    docs = make_docs(passages(random.Random(length + contexts)))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs, length, gram, contexts).collect()), key=str)
    assert got == repeats_by_hand(rows, length)


def test_suffix_dedup_awkward(awkward, empty):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(awkward).collect()), key=str)
    assert got == repeats_by_hand(rows, suffix_dedup.LENGTH)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def _table(texts, before, group, length, gram):
    return suffix_dedup.Contexts(np.array(group), np.array(before), texts, length, gram)


def test_suffix_sort_is_lexicographic():
    rng = random.Random(4)
    length, gram = 20, 6
    for _ in range(60):
        count = rng.randrange(1, 40)
        texts = [bytes(rng.choice(b"ab") for _ in range(length - gram + rng.randrange(gram, length + 1))) for _ in range(count)]
        group = sorted(rng.randrange(3) for _ in range(count))
        group = np.unique(group, return_inverse=True)[1].tolist()
        table = _table(texts, [length - gram] * count, group, length, gram)
        for column in (0, 5, length - gram):
            order = table.sort(np.arange(count), column)
            assert [(group[i], texts[i][column:]) for i in order] == sorted((g, t[column:]) for g, t in zip(group, texts))


def test_colliding_hashes_are_found(monkeypatch):
    """With a base of 1 every permutation collides; the bytes tell and another base is taken."""
    monkeypatch.setattr(suffix_dedup, "_BASES", [np.uint64(1), *suffix_dedup._BASES])
    texts = [b"abcdefghijklmnopqrst", b"abdcefghijklmnopqrst", b"abcdefghijklmnopqrst"]
    table = _table(texts, [8] * 3, [0] * 3, 12, 4)
    assert table.repeated().all(axis=1).tolist() == [True, False, True] and table.attempt == 1


# line templates


def templates_by_hand(rows, min_docs):
    field = re.compile(r"[0-9@]|://")
    split = {t: list(dict.fromkeys(t.split("\n"))) for t in {t or "" for _, t in rows}}
    words = lambda line: ["<*>" if field.search(w) else w for w in re.findall(r"[^\x20\x09\x0B-\x0D]+", line)]
    leaf = lambda line: (len(words(line)), *words(line)[: templates.DEPTH])
    held = [(t, line) for t, lines in split.items() for line in lines if words(line)]
    count = {}
    for key in {(leaf(line), t) for t, line in held}:
        count[key[0]] = count.get(key[0], 0) + 1
    own = {t: [count[leaf(x)] < min_docs for x in lines if words(x)] for t, lines in split.items()}
    alone = {t for t, marks in own.items() if templates.OWN * sum(marks) >= len(marks)}
    held = [(t, line) for t, line in held if count[leaf(line)] >= min_docs]
    times = {}
    for _, line in held:
        for i, w in enumerate(words(line)):
            times[leaf(line), i, w] = times.get((leaf(line), i, w), 0) + 1
    groups = {}
    for t, line in held:
        shown = [w if w != "<*>" and times[leaf(line), i, w] >= min_docs else "<*>" for i, w in enumerate(words(line))]
        if 2 * sum(w != "<*>" for w in shown) >= len(shown):
            digests = sorted(hashlib.md5(x.encode()).hexdigest() for x in split[t])
            own = hashlib.md5(line.encode()).hexdigest()
            rest = digests[0] if digests[0] != own else digests[1] if len(digests) > 1 else None
            groups.setdefault(" ".join(shown), []).append((t, line, rest))
    gone = set()
    for members in groups.values():
        apart = len({r for _, _, r in members} - {None})
        texts = {t for t, _, _ in members}
        if len(texts & alone) >= min_docs or apart >= min_docs and templates.APART * apart >= len(texts):
            gone |= {(t, line) for t, line, _ in members}
    out = []
    for doc_id, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if ((t or ""), x) not in gone]
        out.append((doc_id, None if t is None else "\n".join(kept), 0 if t is None else len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def forum(rng):
    prose = lambda rng, n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    texts = []
    for i in range(60):
        lines = [prose(rng, rng.randrange(4, 20)) for _ in range(rng.randrange(1, 6))]
        lines.insert(rng.randrange(len(lines)), f"Posted to the forum by {rng.choice('ABCDEFGHIJKLMNOP')}xy on day {i} of May")
        if i % 2:
            lines.append("All rights reserved here.")
        if i % 7 == 0:
            lines.append("ok")
        texts.append("\n".join(lines))
    whole = "\n".join(prose(rng, 9) for _ in range(6))
    texts += [whole.replace("a", "a", 1) + f" {i}" + "tail" * (i % 3) for i in range(25)]  # copies of one document
    return texts + [texts[0]] * 5 + [None, "", "\n\n", "a b c"]


@pytest.mark.parametrize("min_docs", [5, 12])
def test_line_templates(make_docs, min_docs):
    docs = make_docs(forum(random.Random(min_docs)))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = templates.drop_recurring_lines(docs, min_docs).select("row.doc_id", "row.text", "n_lines", "n_dropped")
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == templates_by_hand(rows, min_docs)
    text = dict(r[:2] for r in got)
    assert "Posted to" not in text[3] and "rights reserved" not in text[1] and text[3]


@pytest.mark.parametrize("shared, own", [(5, 1), (10, 3), (20, 5), (20, 10)])
def test_lines_that_independent_texts_share(make_docs, shared, own):
    block = [f"common {w} {w}ly that all of them say" for w in (a + b for a in WORDS for b in WORDS)][:shared]
    texts = ["\n".join(block + [f"{WORDS[i % 20]}{WORDS[i // 20]} own {WORDS[j]} of it" for j in range(own)]) for i in range(120)]
    left = [r.text for r in templates.drop_recurring_lines(make_docs(texts)).select("row.text").collect()]
    assert sum(t.count("common") for t in left) == 0 and all(t.count("\n") == own - 1 for t in left)


def test_near_copies_keep_their_lines(make_docs):
    lines = [f"{a}{b} is what line {a} of {b} says" for a in WORDS for b in WORDS][:20]
    texts = ["\n".join(f"first{'x' * i} {x}" if j == i % 20 else x for j, x in enumerate(lines)) for i in range(30)]
    assert not any(r.n_dropped for r in templates.drop_recurring_lines(make_docs(texts)).collect())


def test_line_templates_awkward(awkward, empty):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    found = templates.drop_recurring_lines(awkward, 2)
    got = sorted((tuple(r) for r in found.select("row.doc_id", "row.text", "n_lines", "n_dropped").collect()), key=str)
    assert got == templates_by_hand(rows, 2)
    assert found.select("row.*").columns == awkward.columns
    assert templates.drop_recurring_lines(empty).count() == 0


def test_line_templates_run_no_python(make_docs):
    docs = make_docs(["a b c\nd e f"] * 3)
    plan = templates.recurring_lines(docs, 2).join(docs, F.lit(True))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
