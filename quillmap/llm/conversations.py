"""Conversation structure repair: Wagner-Fischer alignment with the alternating grammar.

A conversation should read `(s?(ua)+)?` by the initials of its roles. Each turn is kept,
gets the role user or assistant, or is deleted; empty user or assistant turns may be put in.

1. Turns that may only go (blank, or seen earlier) are told by grouping, without Python.
2. The rest, cut into blocks of consecutive turns, is aligned with each feasible length of
   the alternating string: one Wagner-Fischer table, indexed by what is left of the string,
   holds all lengths, and only the cells within a band that the cost of a plain repair
   allows (Ukkonen). Lengths of least cost are traced and their audits compared.
3. A block is solved for every state of the grammar before and after it, so that the
   blocks of a conversation of any length are combined without its turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmap.llm.common import small_batches
from quillmap.session import materialise

#: Prices of the edits; an open (truncated) turn that stays costs OPEN more.
REROLE, DELETE, INSERT, OPEN = 3, 4, 3, 3
#: Turns of a block.
BLOCK_TURNS = 128
#: States of the grammar: nothing yet, after s, after u, after a. The end is EMPTY or AFTER_A.
EMPTY, AFTER_S, AFTER_U, AFTER_A = range(4)
FULL = {"u": "user", "a": "assistant"}
FAR = 1 << 40
NOT_BLANK = r"[^\x20\x09-\x0D]"

Solved = tuple[int, int, int, str]  # state before, state after, cost, audit


def _plain_repair(initials: list[str], need: str, end: str) -> int:
    """The price of keeping what fits, putting in what is missing and a new role for what never fits."""
    price = 0
    for initial in initials:
        if initial == need:
            need = "a" if need == "u" else "u"
        elif initial in FULL:
            price += INSERT
        else:
            price += REROLE
            need = "a" if need == "u" else "u"
    return price + (INSERT if need == end else 0)


def align_block(turns: list[tuple[str, bool]], gone: list[int], whole: bool) -> list[Solved]:
    """Least price and least audit for each state before and after the block.

    `turns` are (initial, open), `gone[i]` counts the turns that must be deleted before
    turn i, the last entry those after all. If the block is a whole conversation, only
    what starts and ends one is solved.
    """
    n = len(turns)
    initials = [t[0] for t in turns]
    # prices above what every repair pays: an open turn costs OPEN even if it is kept
    drop = [DELETE - OPEN if t[1] else DELETE for t in turns]
    paid = DELETE * sum(gone) + OPEN * sum(t[1] for t in turns)
    marks = ["D" * k for k in gone]
    drops = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        drops[i] = drops[i + 1] + drop[i]
    opened = sum(t[1] for t in turns)
    solved: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(before: int, after: int, price: int, audit: str) -> None:
        found = (price + paid, audit)
        if (before, after) not in solved or found < solved[before, after]:
            solved[before, after] = found

    def all_gone(i: int) -> str:
        return "".join("D" + marks[j + 1] for j in range(i, n))

    nothing = marks[0] + all_gone(0)
    for state in (EMPTY,) if whole else (EMPTY, AFTER_S, AFTER_U, AFTER_A):
        offer(state, state, drops[0], nothing)
    if not whole:  # nothing but s stays
        for i in range(n):
            if initials[i] == "s":
                audit = marks[0] + "".join("D" + marks[j + 1] for j in range(i)) + "K" + marks[i + 1] + all_gone(i + 1)
                offer(EMPTY, AFTER_S, drops[0] - drop[i], audit)

    for end, after in (("a", AFTER_A),) if whole else (("a", AFTER_A), ("u", AFTER_U)):
        other = "u" if end == "a" else "a"
        limit = max(_plain_repair(initials, "u", end), _plain_repair(initials, "a", end)) + 2 * INSERT
        most_in = limit // INSERT
        most_out = min(n, limit if limit <= opened else opened + (limit - opened) // DELETE)
        width = n + most_in + 2
        # left[i][t]: least price of turns i.. against the last t characters
        left = [[FAR] * width for _ in range(n + 1)]
        row = left[n]
        for t in range(min(most_in, width - 1) + 1):
            row[t] = t * INSERT
        for i in range(n - 1, -1, -1):
            below, row, initial, price = left[i + 1], left[i], initials[i], drop[i]
            low, high = max(0, n - i - most_out), n - i + most_in
            for t in range(low, high + 1):
                best = below[t] + price
                if t:
                    need = end if t % 2 else other
                    step = below[t - 1] + (0 if initial == need else REROLE)
                    if step < best:
                        best = step
                    if t > low and row[t - 1] + INSERT < best:
                        best = row[t - 1] + INSERT
                row[t] = best

        def trace(i: int, t: int) -> str:
            """The least audit of turns i.. against the last t characters."""
            out = []
            while i < n or t:
                here = left[i][t]
                if i < n and left[i + 1][t] + drop[i] == here:
                    out.append("D" + marks[i + 1])
                    i += 1
                elif t and left[i][t - 1] + INSERT == here:
                    out.append("I")
                    t -= 1
                else:
                    fits = initials[i] == (end if t % 2 else other)
                    out.append(("K" if fits else "R") + marks[i + 1])
                    i, t = i + 1, t - 1
            return "".join(out)

        for first, befores in (("u", (EMPTY,) if whole else (EMPTY, AFTER_S, AFTER_A)), ("a", () if whole else (AFTER_U,))):
            # the length's parity follows from its first and last character
            lengths = [t for t in range(1, width) if (t % 2 == 1) == (first == end) and left[0][t] < FAR]
            if lengths and befores:
                least = min(left[0][t] for t in lengths)
                audit = min(marks[0] + trace(0, t) for t in lengths if left[0][t] == least)
                for before in befores:
                    offer(before, after, least, audit)
        # s first: all before it goes, then the alternating string from u
        for i in range(n):
            if initials[i] == "s":
                lengths = [t for t in range(1, width) if (t % 2 == 1) == (end == "u") and left[i + 1][t] < FAR]
                if lengths:
                    least = min(left[i + 1][t] for t in lengths)
                    price = drops[0] - drops[i] + least
                    if (EMPTY, after) in solved and price + paid > solved[EMPTY, after][0]:
                        continue
                    start = marks[0] + "".join("D" + marks[j + 1] for j in range(i)) + "K" + marks[i + 1]
                    audit = min(start + trace(i + 1, t) for t in lengths if left[i + 1][t] == least)
                    offer(EMPTY, after, price, audit)
    return [(before, after, *found) for (before, after), found in sorted(solved.items())]


def combine(known: dict[int, tuple[int, str]], block: list[Solved]) -> dict[int, tuple[int, str]]:
    """The least price and audit by state after one more block."""
    out: dict[int, tuple[int, str]] = {}
    for before, after, price, audit in block:
        if before in known:
            found = (known[before][0] + price, known[before][1] + audit)
            if after not in out or found < out[after]:
                out[after] = found
    return out


def _turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn (long), role and text without nulls, and the text's digest."""
    plain = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    )
    return plain.withColumn("digest", F.unhex(F.md5("text")))


ORDER = ["conv_id", "turn", "role", "digest"]


def _kinds(turns: DataFrame) -> DataFrame:
    """One row for all equal turns: conv_id, turn, role, digest, n, blank, open, first."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    blank: Column = ~F.col("text").rlike(NOT_BLANK)
    narrow = turns.select(*ORDER, blank.alias("blank"), (~last.isin(".", "!", "?")).alias("open"))
    equal = materialise(narrow.groupBy(*ORDER).agg(F.count("*").alias("n"), F.max("blank").alias("blank"), F.max("open").alias("open")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # nulls first
    first = equal.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(
        F.min(place).alias("_first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    return equal.join(first, same).select(
        *ORDER, "n", "blank", "open", F.col("turn").eqNullSafe(F.col("_first.turn")).alias("first")
    )


_SOLVED = T.ArrayType(
    T.StructType(
        [T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]
    )
)
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def _block_schema(conv: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("conv_id", conv),
            T.StructField("part", T.IntegerType()),
            T.StructField("block", T.IntegerType()),
            *(T.StructField(c, T.LongType()) for c in (*_COUNTS, "first_turn", "last_turn")),
            T.StructField("first_role", T.StringType()),
            T.StructField("last_role", T.StringType()),
            T.StructField("solved", _SOLVED),
        ]
    )


def _legal(one: str, other: str) -> bool:
    return one + other in ("su", "ua", "au")


class _Block:
    """Consecutive turns of one conversation: counts, and what the alignment needs."""

    def __init__(self):
        self.rows, self.turns, self.gone = 0, [], [0]
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first_turn = self.last_turn = self.first_role = self.last_role = None

    def add(self, turn, role: str, n: int, blank: bool, is_open: bool, first: bool) -> None:
        initial = role[:1]
        if self.rows:
            self.counts["illegal"] += not _legal(self.last_role, initial)
        else:
            self.first_role = initial
        self.counts["illegal"] += 0 if _legal(initial, initial) else n - 1
        self.last_role = initial
        if turn is not None:
            self.counts["turns"] += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        stays = not blank and first
        self.counts["blank"] += n if blank else 0
        self.counts["duplicate"] += 0 if blank else n - first
        self.counts["truncated"] += stays and is_open
        if stays:
            self.turns.append((initial, is_open))
            self.gone.append(0)
        self.gone[-1] += n - stays
        self.rows += 1


def _solve_blocks(kinds: DataFrame) -> DataFrame:
    """A row for each block; ranges of the order spread a long conversation over tasks."""
    conv = kinds.schema["conv_id"].dataType
    schema = _block_schema(conv)
    size = BLOCK_TURNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, number, groups, out = None, None, 0, 0, []

        def flush(part: int, whole: bool) -> None:
            solved = [dict(zip(("before", "after", "cost", "audit"), s)) for s in align_block(block.turns, block.gone, whole)]
            b = block
            out.append((now[0], part, number, *(b.counts[c] for c in _COUNTS), b.first_turn, b.last_turn, b.first_role, b.last_role, solved))

        part = 0
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("conv_id", "part", "turn", "role", "n", "blank", "open", "first"))
            for name, part, *turn in zip(*columns):
                if now is None or name != now[0]:
                    if now is not None:  # a range may begin or end amid a conversation
                        flush(part, whole=groups > 1 and number == 0)
                    now, block, number, groups = (name,), _Block(), 0, groups + 1
                elif block.rows == size:
                    flush(part, whole=False)
                    block, number = _Block(), number + 1
                block.add(*turn)
            yield _rows(out, schema)
            out.clear()
        if now is not None:
            flush(part, whole=False)
        yield _rows(out, schema)

    slices = int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = kinds.repartitionByRange(slices, *ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id())
    return ordered.drop("digest").mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    fields = _arrow(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields)


def repair_plans(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation.

    `rows` has conv_id, turn, role, text; a null role or text reads as one space, null turns
    come first, a null conv_id is a conversation. Turns of one number follow by role, then
    by digest of the text; equal rows are duplicates of each other. The first fault of a
    turn counts: blank, duplicate (role and text seen earlier), truncated (its last
    character that is no white space is none of `.!?`). `audit` has the initial of each
    edit: Delete, Insert, Keep, Rerole; of equal costs the ASCII-least. Other columns are
    not read. Without rows there is no conversation. Texts do not enter the alignment; a
    conversation of any length is cut into blocks that different tasks solve.
    """
    kinds = materialise(_kinds(_turns(rows)))
    blocks = materialise(_solve_blocks(kinds))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType(
        [blocks.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in counts), T.StructField("audit", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, known, out = None, None, None, []

        def flush() -> None:
            cost, audit = min(known[s] for s in (EMPTY, AFTER_A) if s in known)
            low, high = total["first_turn"], total["last_turn"]
            gaps = 0 if low is None else high - low + 1 - total["turns"]
            out.append((now[0], gaps, *(total[c] for c in ("blank", "duplicate", "truncated", "illegal")), cost, audit))

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now[0]:
                    if now is not None:
                        flush()
                    now, total, known = (row["conv_id"],), row, combine({EMPTY: (0, "")}, _tuples(row))
                    continue
                total["illegal"] += not _legal(total["last_role"], row["first_role"])
                # a turn number may go on in the next block
                total["turns"] -= total["last_turn"] is not None and total["last_turn"] == row["first_turn"]
                for c in _COUNTS:
                    total[c] += row[c]
                total["last_role"] = row["last_role"]
                if row["first_turn"] is not None:
                    total["first_turn"] = row["first_turn"] if total["first_turn"] is None else total["first_turn"]
                    total["last_turn"] = row["last_turn"]
                known = combine(known, _tuples(row))
            yield _rows(out, schema)
            out.clear()
        if now is not None:
            flush()
        yield _rows(out, schema)

    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = blocks.repartition(slices, "conv_id").sortWithinPartitions("conv_id", "part", "block")
    return met.mapInArrow(run, schema)


def _tuples(row: dict) -> list[Solved]:
    return [(s["before"], s["after"], s["cost"], s["audit"]) for s in row["solved"]]


class _Repair:
    """Follows an audit over the turns of a conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.need, self.empty = audit, 0, "u", True

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._filled(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield edit, self._filled(), text
        elif edit == "K":
            if not (self.empty and role[0] == "s"):
                self._filled()
            self.empty = False
            yield edit, role, text

    def _filled(self) -> str:
        role, self.need, self.empty = FULL[self.need], "a" if self.need == "u" else "u", False
        return role


def _followed(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Turns in order behind the audit of their conversation; a task reads them as a stream."""
    turns = _turns(rows).select(F.lit(1).alias("kind"), *ORDER, "text", F.lit(None).cast("string").alias("audit"))
    null = F.lit(None)
    heads = plans.select(
        F.lit(0).alias("kind"), "conv_id", null.cast("long").alias("turn"), null.cast("string").alias("role"),
        null.cast("binary").alias("digest"), null.cast("string").alias("text"), "audit",
    )
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = small_batches(heads.unionByName(turns)).repartition(slices, "conv_id")
    return met.sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").select("kind", "conv_id", "turn", "role", "text", "audit")


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, place (from 1), edit, turn, role, text of the repaired conversations.

    `plans` are those of `repair_plans` for the same rows. Deleted turns are left out,
    inserted ones have no turn and an empty text.
    """
    schema = T.StructType(
        [
            T.StructField("conv_id", rows.schema["conv_id"].dataType),
            T.StructField("place", T.LongType()),
            T.StructField("edit", T.StringType()),
            T.StructField("turn", T.LongType()),
            T.StructField("role", T.StringType()),
            T.StructField("text", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, repair, place, out = None, None, 0, []

        def put(turns, turn=None) -> None:
            nonlocal place
            for edit, role, text in turns:
                place += 1
                out.append((now, place, edit, None if edit == "I" else turn, role, text))

        for batch in batches:
            for kind, name, turn, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if repair:
                        put(repair.inserted())
                    now, repair, place = name, _Repair(audit), 0
                else:
                    put(repair.turn(role, text), turn)
            yield _rows(out, schema)
            out.clear()
        if repair:
            put(repair.inserted())
        yield _rows(out, schema)

    return _followed(rows, plans).mapInArrow(run, schema)


def repaired_digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of the repaired `role:text`, joined by newlines.

    A hash runs over a conversation's bytes in order: one task reads them, a batch at a time.
    """
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, repair, digest, first, out = None, None, None, True, []

        def put(turns) -> None:
            nonlocal first
            for _, role, text in turns:
                digest.update((f"{role}:{text}" if first else f"\n{role}:{text}").encode("utf-8", "surrogatepass"))
                first = False

        def finish() -> None:
            if repair:
                put(repair.inserted())
                out.append((now, digest.hexdigest()))

        for batch in batches:
            for kind, name, _, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    finish()
                    now, repair, digest, first = name, _Repair(audit), hashlib.sha256(), True
                else:
                    put(repair.turn(role, text))
            yield _rows(out, schema)
            out.clear()
        finish()
        yield _rows(out, schema)

    return _followed(rows, plans).mapInArrow(run, schema)


def repair_conversations(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """`repair_plans` with repaired_sha256, for each conv_id of `conversations`, also without rows.

    A conversation without rows has zeros, an empty audit and the hash of the empty string.
    """
    plans = materialise(repair_plans(rows))
    digests = repaired_digests(rows, plans).withColumnRenamed("conv_id", "_conv")
    found = plans.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    if conversations is None:
        return found
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()
    all_ids = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zeros = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return all_ids.select(
        F.col("_id").alias("conv_id"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in zeros),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by crc32 of `conv_id:turn`, modulo 20.

    0 drops the turn, 1 empties its text, 2 takes out `.!?`, 3 repeats it, 4 makes it the
    user's. Nulls read as one space, also in the key; a null turn stays null.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    plain = rows.select(
        "conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key) % 20).alias("fault")
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return (
        plain.where("fault <> 0")
        .select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_"))
        .drop("_")
    )
