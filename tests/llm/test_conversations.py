"""Conversation repair against every possible repair."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from quillmap.llm import conversations
from quillmap.llm.queries import QUERIES

FULL = {"u": "user", "a": "assistant"}
SCHEMA = "conv_id long, turn long, role string, text string, cost long, audit string"


def faults(rows):
    """blank, duplicate, truncated or None for each (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        solid = re.sub(r"[ \t-\r]", "", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else None if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def least_repair(rows):
    """(cost, audit, repaired) by trying states of the grammar turn by turn, with whole audits."""
    kinds = faults(rows)
    best = {"": (0, "", ())}  # state: last initial put out

    def inserts(states):
        todo = list(states.items())
        while todo:
            state, (cost, audit, out) = todo.pop()
            put = "a" if state == "u" else "u"
            found = (cost + 3, audit + "I", (*out, f"{FULL[put]}:"))
            if put not in states or found[:2] < states[put][:2]:
                states[put] = found
                todo.append((put, found))
        return states

    def after(state, initial):
        return state == "" if initial == "s" else state in ("", "s", "a") if initial == "u" else state == "u" if initial == "a" else False

    for (role, text), kind in zip(rows, kinds):
        states, best = inserts(dict(best)), {}

        def offer(state, found):
            if state not in best or found[:2] < best[state][:2]:
                best[state] = found

        for state, (cost, audit, out) in states.items():
            offer(state, (cost + 4, audit + "D", out))
            if kind in ("blank", "duplicate"):
                continue
            more = 3 if kind == "truncated" else 0
            if after(state, role[:1]):
                offer(role[0], (cost + more, audit + "K", (*out, f"{role}:{text}")))
            put = "a" if state == "u" else "u"
            offer(put, (cost + more + 3, audit + "R", (*out, f"{FULL[put]}:{text}")))
    states = inserts(dict(best))
    return min((states[s] for s in ("", "a") if s in states), key=lambda f: f[:2])


def every_repair(rows):
    """(cost, audit) by trying all edits, with up to two turns put in at each place."""
    kinds, best = faults(rows), None
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(k in ("blank", "duplicate") and e != "D" for k, e in zip(kinds, edits)):
            continue
        for put in itertools.product(range(3), repeat=len(rows) + 1):
            audit, shape, cost = "", "", 0
            for i in range(len(rows) + 1):
                audit += "I" * put[i]
                shape += "?" * put[i]
                cost += 3 * put[i]
                if i < len(rows):
                    audit += edits[i]
                    cost += {"K": 0, "R": 3, "D": 4}[edits[i]] + (3 if edits[i] != "D" and kinds[i] == "truncated" else 0)
                    shape += {"K": rows[i][0][0], "R": "?", "D": ""}[edits[i]]
            start = 1 if shape[:1] == "s" else 0
            fits = not shape or (
                len(shape) > start and (len(shape) - start) % 2 == 0 and all(c in ("?", "ua"[j % 2]) for j, c in enumerate(shape[start:]))
            )
            if fits and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def some_turns(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool"]
    texts = ["Yes.", "No!", "open end", " ", "And?", "More. ", "half a"]
    return [(rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}" + rng.choice(["", "."])) for _ in range(n)]


def aligned(rows, size):
    """The operator's own steps without Spark: blocks of `size` turns, combined."""
    known, kinds = {conversations.EMPTY: (0, "")}, faults(rows)
    for start in range(0, len(rows), size):
        turns, gone = [], [0]
        for (role, _), kind in zip(rows[start : start + size], kinds[start : start + size]):
            if kind in ("blank", "duplicate"):
                gone[-1] += 1
            else:
                turns.append((role[:1], kind == "truncated"))
                gone.append(0)
        known = conversations.combine(known, conversations.align_block(turns, gone, len(rows) <= size))
    return min(known[s] for s in (conversations.EMPTY, conversations.AFTER_A) if s in known)


def test_alignment_equals_every_repair():
    rng = random.Random(1)
    for _ in range(60):
        rows = some_turns(rng, rng.randrange(5))
        assert least_repair(rows)[:2] == (every_repair(rows) if rows else (0, ""))
        assert aligned(rows, 100) == least_repair(rows)[:2]


def test_blocks_of_any_size_give_the_same_repair():
    rng = random.Random(2)
    for size in (1, 2, 3, 7, 100):
        for _ in range(60):
            rows = some_turns(rng, rng.randrange(14))
            assert aligned(rows, size) == least_repair(rows)[:2]


def expected(rows):
    """All columns for the turns of one conversation: (turn, role, text) in order."""
    kinds = faults([r[1:] for r in rows])
    cost, audit, out = least_repair([r[1:] for r in rows])
    turns = {r[0] for r in rows if r[0] is not None}
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{k: kinds.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))


@pytest.mark.parametrize("size", [2, 128])
def test_conversations_of_any_length_and_nulls(spark, monkeypatch, size):
    monkeypatch.setattr(conversations, "BLOCK_TURNS", size)
    rng = random.Random(3)
    groups = {c: [(rng.choice([None, *range(9)]), *t) for t in some_turns(rng, rng.randrange(1, 9))] for c in range(40)}
    groups[40] = [(i, *t) for i, t in enumerate(some_turns(rng, 500))]
    groups[41] = [(3, "user", "same.")] * 30 + [(4, "user", "same.")]
    groups[None] = [(None, "user", "a."), (1, "assistant", "b.")]
    rows = [(c, *t, 7, "x") for c, turns in groups.items() for t in turns]
    rows += [(50, 1, None, None, 1, "x"), (51, None, "", "word.", 1, "x")]
    groups |= {50: [(1, " ", " ")], 51: [(None, "", "word.")]}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    ids = spark.createDataFrame([(99,), (1,), (1,)], "conv_id long").unionByName(df.select("conv_id"))
    got = {r.conv_id: r.asDict() for r in conversations.repair_conversations(df, ids).collect()}
    assert len(got) == len(groups) + 1
    for name, turns in groups.items():
        want = expected(in_order(turns))
        assert {k: got[name][k] for k in want} == want, name
    assert got[99]["audit"] == "" and got[99]["cost"] == 0 and got[99]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()

    plans = conversations.repair_plans(df)
    turns = sorted(conversations.repaired_turns(df, plans).collect(), key=lambda r: (str(r.conv_id), r.place))
    joined = "\n".join(f"{r.role}:{r.text}" for r in turns if r.conv_id == 40)
    assert hashlib.sha256(joined.encode()).hexdigest() == got[40]["repaired_sha256"]


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.repair_conversations(none, none).collect() == []


def test_query_against_every_conversation(spark):
    folder = "/root/testdata/sf0.001"
    groups = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        turns, fault = groups.setdefault(r.conv_id, []), zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", r.text) if fault == 2 else r.text
        turns += [(r.turn, "user" if fault == 4 else r.role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    got = {r.conv_id: r.asDict() for r in QUERIES["op12_conversation_repair"](spark, folder).collect()}
    assert got == {c: {"conv_id": c, **expected(in_order(turns))} for c, turns in groups.items()}
