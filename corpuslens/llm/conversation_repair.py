"""Conversation structure repair: the cheapest edits that make a conversation alternate.

The roles of a repaired conversation are ``(s?(ua)+)?`` by initials: at most one leading system turn, then user
and assistant in turns.  Edits of a conversation's rows, in order: *Keep* (0), *Rerole* to user or assistant
(2), *Delete* (3), *Insert* an empty user or assistant turn anywhere (2).  Blank and duplicate rows must be
deleted; a truncated row that stays costs 1 more.  Of the cheapest sequences of edits the one whose initials are
least in ASCII order is taken.

The state between two edits is what the output ends with: nothing, system, user or assistant.  A dynamic program
runs backward over the rows with a vector of four costs to the end.  Vectors are stored only at checkpoints,
every square root of the rows; walking forward, the vectors of one block at a time are computed again from the
checkpoint at its end, and the least edit that loses no cost is emitted (``tight_edits``).

A conversation that holds a third of all rows lies in many tasks: rows are sorted by ranges of (conversation,
turn), each task cuts its conversations into blocks, and

1. the min-plus matrix of each block (costs from the state before it to the state after it) is computed in parallel;
2. per conversation, one narrow row per block runs backward: the vector at each block's end is its checkpoint;
3. each block is walked in parallel from all four states, which gives the state it ends in for each;
4. per conversation, again a narrow row per block, states are chained forward;
5. each block emits its edits and rows in parallel, and only the digest reads a conversation's rows in order, as a stream.

Conversations that lie within one block of one task, nearly all, go to step 5 directly.

Null roles and texts count as one space.  Rows of equal turn are ordered by a hash of role and text; repeated rows
are duplicates.  Null turns come first and make no gaps.  A null conv_id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpuslens.llm.common import written

BLOCK_ROWS = 1024
BLOCK_CHARS = 1 << 20
SPACES = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1  # costs
NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # states; the initials s, u, a of rows are numbered alike less one, others 3
NEXT = (USER, USER, ASSISTANT, USER)  # the state after an inserted or reroled turn
FAULTS = ("", "blank", "duplicate", "truncated")  # a row's code is its initial plus 4 times its fault
END = (0, 4, 2, 0)  # cost of the insertions that end a conversation in each state
INFINITE = 1 << 40


def _kept(state: int, initial: int) -> int | None:
    """The state after a kept row, if it may stay there."""
    allowed = {(NOTHING, 0): SYSTEM, (NOTHING, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
    return allowed.get((state, initial))


def _row_edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, state after it) of the edits that consume a row, in ASCII order."""
    initial, fault = code & 3, FAULTS[code >> 2]
    edits = [("D", DELETE, state)]
    if fault not in ("blank", "duplicate"):
        extra, kept = TRUNCATED * (fault == "truncated"), _kept(state, initial)
        if kept is not None:
            edits.append(("K", extra, kept))
        edits.append(("R", REROLE + extra, NEXT[state]))
    return edits


def _steps() -> list[list[list[int]]]:
    """Per code, costs from the state before a row to the state after it, with insertions before the row."""
    inserted = [[INFINITE] * 4 for _ in range(4)]
    for start in range(4):
        state, cost = start, 0
        while inserted[start][state] > cost:
            inserted[start][state] = cost
            state, cost = NEXT[state], cost + INSERT
    out = []
    for code in range(16):
        step = [[INFINITE] * 4 for _ in range(4)]
        for start in range(4):
            for between in range(4):
                for _, cost, after in _row_edits(code, between):
                    step[start][after] = min(step[start][after], inserted[start][between] + cost)
        out.append(step)
    return out


STEPS = _steps()
EDITS = [[_row_edits(code, state) for state in range(4)] for code in range(16)]


def _back(codes: bytes, vector: tuple, keep: Callable[[int], bool]) -> dict[int, tuple]:
    """Vectors before the rows whose numbers ``keep`` selects, from the vector after the last row."""
    v, held = vector, {len(codes): vector}
    for i in range(len(codes) - 1, -1, -1):
        v = tuple([min(r[0] + v[0], r[1] + v[1], r[2] + v[2], r[3] + v[3]) for r in STEPS[codes[i]]])
        if keep(i):
            held[i] = v
    return held


def tight_edits(codes: bytes, end: tuple, state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least cheapest edits of rows from a state, and the state they end in.

    ``end`` is the vector of costs after the rows; insertions after the last row belong to what follows,
    unless it is the conversation's ``last``.
    """
    stride = max(1, math.isqrt(len(codes)))
    checkpoints = _back(codes, end, lambda i: i % stride == 0)
    out = []
    for low in range(0, len(codes), stride):
        high = min(low + stride, len(codes))
        vectors = _back(codes[low:high], checkpoints[high], lambda i: True)
        for i in range(high - low):
            before, after = vectors[i], vectors[i + 1]
            while True:
                options = EDITS[codes[low + i]][state]
                if options[0][1] + after[state] == before[state]:
                    out.append("D")
                    break
                if INSERT + before[NEXT[state]] == before[state]:
                    out.append("I")
                    state = NEXT[state]
                    continue
                name, _, state = next(e for e in options[1:] if e[1] + after[e[2]] == before[state])
                out.append(name)
                break
    while last and END[state]:
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


def block_matrix(codes: bytes) -> np.ndarray:
    """Min-plus product of the rows' steps."""
    matrices = np.array(STEPS, np.int64)[np.frombuffer(codes, np.uint8)]
    while len(matrices) > 1:
        odd = matrices[len(matrices) & ~1 :]
        left, right = matrices[0 : len(matrices) & ~1 : 2], matrices[1::2]
        matrices = np.concatenate([(left[:, :, :, None] + right[:, None, :, :]).min(axis=2), odd])
    return np.minimum(matrices[0], INFINITE)


def applied(audit: str, roles: list[str], texts: list[str], state: int) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits."""
    out_roles: list[str] = []
    out_texts: list[str] = []
    at = 0
    for edit in audit:
        if edit in "IR":
            state = NEXT[state]
            out_roles.append("user" if state == USER else "assistant")
            out_texts.append("" if edit == "I" else texts[at])
        elif edit == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[roles[at][0]]
            out_roles.append(roles[at])
            out_texts.append(texts[at])
        at += edit != "I"
    return out_roles, out_texts


def _or_space(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def turns_with_codes(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, key, row, code): every row with its number in the table, its initial and first fault."""
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), _or_space(conversations["role"]).alias("role"), _or_space(conversations["text"]).alias("text"),
    )
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    rows = written(rows.withColumn("key", key).withColumn("row", F.monotonically_increasing_id()), "turns")
    first = rows.groupBy("conv_id", "key").agg(F.count("*").alias("n"), F.min(F.struct("turn", "row")).alias("first")).where("n > 1")
    first = first.select(F.col("conv_id").alias("own"), F.col("key").alias("own_key"), F.col("first.row").alias("first_row"))
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("key") == F.col("own_key")), "left")
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = (
        F.when(bare == "", 1).when(F.col("row") != F.col("first_row"), 2).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(3)
    )
    letter = F.substring("role", 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    return joined.select("conv_id", "turn", "role", "text", "key", "row", (initial + 4 * fault).cast("int").alias("code"))


def _mapped(rows: DataFrame, schema: str, make: Callable[[Iterator[dict]], Iterator[tuple]], at_once: int = 256) -> DataFrame:
    """An Arrow map written as a function from an iterator of rows to an iterator of tuples."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for batch in batches:
                for at in range(0, batch.num_rows, at_once):
                    yield from batch.slice(at, at_once).to_pylist()

        held: list[tuple] = []
        for row in make(each()):
            held.append(row)
            if len(held) >= at_once:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def cut_in_blocks(turns: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(conv_id, seq, alone, codes, roles, texts): runs of rows of a conversation, in order of ``seq``; a written table.

    ``alone``: it is certain within the task that the conversation has no other block.
    """

    def cut(rows: Iterator[dict]) -> Iterator[tuple]:
        seq = TaskContext.get().partitionId() << 40
        waiting: tuple | None = None  # the last full block: whether it is alone is known with the next row
        n_of_conversation, first_of_task = 0, True
        conv_id, codes, roles, texts, chars = None, bytearray(), [], [], 0
        started = False
        for row in rows:
            fresh = not started or row["conv_id"] != conv_id
            if fresh or len(codes) >= block_rows or chars >= block_chars:
                if codes:
                    alone = fresh and n_of_conversation == 0 and not first_of_task
                    yield (conv_id, seq, alone, bytes(codes), roles, texts)
                    seq, n_of_conversation = seq + 1, n_of_conversation + 1
                codes, roles, texts, chars = bytearray(), [], [], 0
                if fresh:
                    first_of_task, n_of_conversation = not started, 0
                started, conv_id = True, row["conv_id"]
            codes.append(row["code"])
            roles.append(row["role"])
            texts.append(row["text"])
            chars += len(row["text"])
        if codes:
            yield (conv_id, seq, False, bytes(codes), roles, texts)

    order = ["conv_id", "turn", "key", "row"]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", "code")
    return written(_mapped(dealt, "conv_id long, seq long, alone boolean, codes binary, roles array<string>, texts array<string>", cut), "blocks")


def _chained(rows: DataFrame, descending: bool, schema: str, make: Callable) -> DataFrame:
    """A fold over the blocks of each conversation, a narrow row each."""
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seq") if descending else F.asc("seq"))
    return _mapped(dealt, schema, make)


def checkpoints(blocks: DataFrame) -> DataFrame:
    """(seq, state, end, last) of blocks of conversations that have more: entry state and costs at the end."""

    def with_matrix(rows):
        for row in rows:
            yield (row["conv_id"], row["seq"], row["codes"], block_matrix(row["codes"]).ravel().tolist())

    def backward(rows):
        conv_id, vector, begun = None, np.array(END), False
        for row in rows:
            last = not begun or row["conv_id"] != conv_id
            if last:
                vector, begun, conv_id = np.array(END), True, row["conv_id"]
            yield (conv_id, row["seq"], row["codes"], vector.tolist(), last)
            vector = (np.array(row["matrix"]).reshape(4, 4) + vector).min(axis=1)

    def exits(rows):
        for row in rows:
            ends = [tight_edits(row["codes"], tuple(row["end"]), state, row["last"])[1] for state in range(4)]
            yield (row["conv_id"], row["seq"], row["end"], row["last"], ends)

    def forward(rows):
        conv_id, state, begun = None, NOTHING, False
        for row in rows:
            if not begun or row["conv_id"] != conv_id:
                conv_id, state, begun = row["conv_id"], NOTHING, True
            yield (row["seq"], state, row["end"], row["last"])
            state = row["exits"][state]

    matrices = _mapped(blocks.select("conv_id", "seq", "codes"), "conv_id long, seq long, codes binary, matrix array<long>", with_matrix)
    ends = written(_chained(matrices, True, "conv_id long, seq long, codes binary, end array<long>, last boolean", backward), "ends")
    walked = _mapped(ends, "conv_id long, seq long, end array<long>, last boolean, exits array<int>", exits)
    return _chained(walked, False, "seq long, state int, end array<long>, last boolean", forward)


def repaired_blocks(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per block: (conv_id, seq, alone, audit, cost, roles, texts, faults, illegal, first, last); roles and texts are the repaired ones.

    ``faults`` counts blank, duplicate and truncated rows, ``illegal`` neighbours within the block that may not
    follow each other, ``first`` and ``last`` are the initials at its ends; all before the repair.
    """
    blocks = cut_in_blocks(turns_with_codes(conversations), block_rows)

    def emit(rows):
        for row in rows:
            codes = row["codes"]
            audit, _ = tight_edits(codes, tuple(row["end"]), row["state"], row["last_block"])
            roles, texts = applied(audit, row["roles"], row["texts"], row["state"])
            faults, initials = [c >> 2 for c in codes], [c & 3 for c in codes]
            consumed = [e for e in audit if e != "I"]
            cost = INSERT * audit.count("I") + REROLE * audit.count("R") + DELETE * audit.count("D") + TRUNCATED * sum(f == 3 and e != "D" for f, e in zip(faults, consumed, strict=True))
            illegal = sum(not _legal(a, b) for a, b in zip(initials, initials[1:], strict=False))
            yield (row["conv_id"], row["seq"], row["alone"], audit, cost, roles, texts, [faults.count(1), faults.count(2), faults.count(3)], illegal, initials[0], initials[-1])

    alone = blocks.where("alone").withColumns({"state": F.lit(NOTHING), "end": F.array(*[F.lit(c).cast("long") for c in END]), "last_block": F.lit(True)})
    others = blocks.where("not alone")
    states = checkpoints(others).withColumnRenamed("last", "last_block")
    ready = alone.unionByName(others.join(states, "seq"))
    schema = "conv_id long, seq long, alone boolean, audit string, cost long, roles array<string>, texts array<string>, faults array<long>, illegal long, first int, last int"
    return _mapped(ready, schema, emit)


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the repaired conversations, turns numbered in order from 0.

    Conversations that lose all their rows have none.
    """
    from corpuslens.operators.running import running

    blocks = repaired_blocks(conversations).select("conv_id", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn"))
    rows = blocks.select("conv_id", "seq", "place", "turn.roles", "turn.texts").toDF("conv_id", "seq", "place", "role", "text")
    numbered = running(rows, ["conv_id"], ["seq", "place"], position="turn")
    return numbered.select("conv_id", (F.col("turn") - 1).alias("turn"), "role", "text")


def reports(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row per conversation.

    The digest of a conversation's repaired rows needs them in order: they pass as a stream through one
    task, a block at a time; everything else is summed up beside it.
    """

    def finish(rows):
        digest, total, audit, conv_id, last, begun, empty = None, [], [], None, 0, False, True
        for row in rows:
            if not begun or row["conv_id"] != conv_id:
                if begun:
                    yield (conv_id, *total, "".join(audit), digest.hexdigest())
                conv_id, begun, digest, total, audit, empty = row["conv_id"], True, hashlib.sha256(), [0] * 5, [], True
            elif not _legal(last, row["first"]):
                total[3] += 1
            total = [a + b for a, b in zip(total, [*row["faults"], row["illegal"], row["cost"]], strict=True)]
            audit.append(row["audit"])
            last = row["last"]
            for role, text in zip(row["roles"], row["texts"], strict=True):
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
        if begun:
            yield (conv_id, *total, "".join(audit), digest.hexdigest())

    schema = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    blocks = written(repaired_blocks(conversations, block_rows), "repaired")
    split = blocks.where("not alone").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    done = _mapped(blocks.where("alone"), schema, finish).unionByName(_mapped(split, schema, finish))
    turns = conversations.select(conversations["conv_id"].cast("long").alias("own_id"), conversations["turn"].cast("long").alias("turn"))
    span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    gaps = turns.groupBy("own_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    joined = gaps.join(done, F.col("own_id").eqNullSafe(F.col("conv_id")))
    return joined.select(F.col("own_id").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows dropped, emptied, stripped of marks, repeated or reroled by the checksum of conv_id and turn.

    Nulls in role and text become one space, and count as one in the checksum.
    """
    draw = F.crc32(F.concat(_or_space(conversations["conv_id"]), F.lit(":"), _or_space(conversations["turn"])).cast("binary")) % 20
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), _or_space(conversations["role"]).alias("role"),
        _or_space(conversations["text"]).alias("text"), draw.alias("draw"),
    ).where("draw != 0")
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """The reports of the damaged conversations, for every conv_id of ``conversations``; zeros where no rows are left."""
    found = reports(damaged(conversations)).withColumnRenamed("conv_id", "found_id")
    ids = conversations.select(conversations["conv_id"].cast("long").alias("conv_id")).distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
