"""Repair of the structure of conversations: the cheapest edits, of these the least audit.

A repaired conversation's roles start with the initials `(s?(ua)+)?`. Every row is kept (0, plus 5 if it
is truncated), given the role user or assistant (1, plus 5 if truncated) or deleted (2; blank and repeated
rows have to be), and a row without text may be inserted anywhere (5). The audit is the initials of the
edits in order (Keep, Rerole, Delete, Insert); among the cheapest edits the ASCII-least audit counts.

The nodes of a conversation are (row, state): nothing yet, a system row, a user row, an assistant row.
Costs to the end are found from the last row on (`costs`). Arcs on cheapest ways only then get ranks by
prefix doubling (`least_paths`): the rank of a node by the least 2k letters that lead on from it is that
of its own k letters and of those of the node where they end. The letters of a node's arcs differ, so
that least letters end at one node and one doubled pointer a node suffices. The arc with the least
letter and rank is taken, and the path is read off by doubled pointers.

A conversation of any length is cut in blocks of BLOCK rows. A block is a matrix of costs from state to
state; one pass from the last block on tells the costs to the end where each block ends, one from the
first on the state in which each starts. These passes see a few numbers a block. Rows are numbered by
`ranking`, repeats are found by the smallest number of each (conversation, role, text), so no task
holds a conversation, nor all repeats of a row. Only a digest of a whole conversation has to read it in
one task, row by row.

Defined results: a null role or text is one space; null turns come first; rows of equal turn are ordered
by the first 64 characters of role and text, then a digest of both; a null id is a conversation like others; any other role than one
that starts with s, u or a can only be deleted or given another; an empty table has no rows. Columns
other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm import ranking, shared

#: Rows of a block, and rows that a task works on at once.
BLOCK, ROWS = 4096, 1 << 16
RESERVED = 1 << 40  # more than any cost
BLANKS = " \t\n\x0b\x0c\r"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
KEEP, REROLE, DELETE, TRUNCATION, INSERT = 0, 1, 2, 5, 5
#: The state after a user or assistant row is added to each state (nothing, system, user, assistant),
#: and the cost to end in it.
AFTER = np.array([2, 2, 3, 2])
ENDS = np.array([0, 2 * INSERT, INSERT, 0])
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)  # in ASCII order


# Blocks in tasks


def costs(initial: np.ndarray, fault: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """[row, block, state]: the least cost from before each row to the blocks' ends, of which `ends` are
    the costs by state. Rows are [block, row]."""
    blocks, n = initial.shape
    best = np.empty((n + 1, blocks, 4), np.int64)
    best[n] = ends
    for p in range(n - 1, -1, -1):
        best[p] = _arcs(initial[:, p], fault[:, p], best[p + 1])[:, 1:].min(axis=1)
        b = best[p]
        user, assistant = b[:, 2].copy(), b[:, 3].copy()
        b[:, 2] = np.minimum(user, INSERT + assistant)
        b[:, 3] = np.minimum(assistant, INSERT + user)
        b[:, 0] = np.minimum(b[:, 0], INSERT + b[:, 2])
        b[:, 1] = np.minimum(b[:, 1], INSERT + b[:, 2])
    return best


def _arcs(initial: np.ndarray, fault: np.ndarray, after: np.ndarray) -> np.ndarray:
    """[block, letter, state]: costs of ways that start with Delete (1), Keep (3) or Rerole (4) of a row."""
    arcs = np.full((len(initial), 5, 4), RESERVED, np.int64)
    arcs[:, 1] = DELETE + after
    stays = (fault != BLANK) & (fault != DUPLICATE)
    more = np.where(fault == TRUNCATED, TRUNCATION, 0)
    added = after[:, AFTER]
    rerole = REROLE + more[:, None] + added
    arcs[:, 4] = np.where(stays[:, None], rerole, RESERVED)
    wanted = np.array([USER, USER, ASSISTANT, USER])
    fits = stays[:, None] & (initial[:, None] == wanted)
    arcs[:, 3] = np.where(fits, KEEP + more[:, None] + added, RESERVED)
    system = stays & (initial == SYSTEM)
    arcs[system, 3, 0] = KEEP + more[system] + after[system, 1]
    return np.minimum(arcs, RESERVED)


def least_paths(letters: np.ndarray, targets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a graph without circles the least path from each start: its letters, ended by 0, and its last node.

    `letters` and `targets` are [node, arc]; a missing arc has the letter 9. A last node has one arc, to
    itself, of letter 0. Letters of a node's arcs differ.
    """
    every = np.arange(len(letters))
    first = letters.argmin(axis=1)
    pointer, rank = targets[every, first], letters[every, first].astype(np.int64)
    while True:  # ranks by 1, 2, 4, ... letters, until all paths have ended
        onward = rank[pointer]
        if not onward.any():
            break
        # Least letters that have ended rank below all that go on, at 0 at the last nodes.
        _, rank = np.unique(rank * (len(rank) + 5) + onward, return_inverse=True)
        pointer = pointer[pointer]
    taken = (letters.astype(np.int64) * (len(rank) + 5) + rank[targets]).argmin(axis=1)
    pointer, letter = targets[every, taken], letters[every, taken]
    path = starts[:, None]
    while letter[path[:, -1]].any():
        path = np.concatenate((path, pointer[path]), axis=1)
        pointer = pointer[pointer]
    return letter[path], path[:, -1]


def _padded(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[block, row] of initials and faults, each block at the end of its row, and the blocks' lengths."""
    sizes = np.array([len(c) for c in codes])
    n = int(sizes.max())
    table = np.zeros((len(codes), n), np.uint8)
    table[np.arange(n) >= n - sizes[:, None]] = np.frombuffer(b"".join(codes), np.uint8)
    return table & 3, table >> 2, sizes


def solved(codes: list[bytes], ends: np.ndarray, entries: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The audit of each block that starts in a state, and the state in which it ends."""
    initial, fault, sizes = _padded(codes)
    blocks, n = initial.shape
    best = costs(initial, fault, ends)
    letters = np.full((blocks, n + 1, 4, 4), 9, np.uint8)
    targets = np.zeros((blocks, n + 1, 4, 4), np.int64)
    node = np.arange(blocks * (n + 1) * 4).reshape(blocks, n + 1, 4)
    for p in range(n):
        arcs = _arcs(initial[:, p], fault[:, p], best[p + 1])
        arcs[:, 2] = INSERT + best[p][:, AFTER]
        on = arcs[:, 1:] == best[p][:, None, :]
        letters[:, p] = np.where(on, np.arange(1, 5)[:, None], 9).transpose(0, 2, 1)
        row = node[:, p + 1]
        keeps = row[:, AFTER].copy()
        system = initial[:, p] == SYSTEM
        keeps[system, 0] = row[system, 1]
        targets[:, p] = np.stack((row, node[:, p][:, AFTER], keeps, row[:, AFTER]), axis=2)
    letters[:, n, :, 0] = 0
    targets[:, n] = node[:, n, :, None]
    starts = node[np.arange(blocks), n - sizes, entries]
    words, last = least_paths(letters.reshape(-1, 4), targets.reshape(-1, 4), starts)
    return [LETTERS[w[w > 0]].tobytes() for w in words], last % 4


def matrices(codes: list[bytes]) -> np.ndarray:
    """[block, from, to]: the least cost of each block from state to state."""
    initial, fault, sizes = _padded(codes)
    out = np.empty((len(codes), 4, 4), np.int64)
    for t in range(4):
        ends = np.full((len(codes), 4), RESERVED)
        ends[:, t] = 0
        best = costs(initial, fault, ends)
        out[:, :, t] = best[initial.shape[1] - sizes, np.arange(len(codes))]
    return out


def of_like_size(codes: list[bytes]) -> Iterator[list[int]]:
    """Places of blocks that are worked on together: no block is filled to more than twice its rows."""
    order: dict[int, list[int]] = {}
    for i, c in enumerate(codes):
        order.setdefault(len(c).bit_length(), []).append(i)
    for size, places in order.items():
        step = max(1, ROWS >> size)
        for i in range(0, len(places), step):
            yield places[i : i + step]


# Rows and blocks of a table


def rows_of(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, mark, total, block, at, initial, blank, ended): rows in order, numbered."""
    rows = conversations.select(
        F.col("conv_id").alias("conv"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("mark", F.unhex(mark))
    # Whole texts stay out of the bounds of ranges, which the driver sees.
    by = [F.col("turn").asc_nulls_first(), F.substring("role", 1, 64), F.substring("text", 1, 64), F.col("mark")]
    numbered = ranking.ranked_within(rows, "conv", by, "rank", "total")
    first = F.substring("role", 1, 1)
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    return numbered.select(
        "conv", "turn", "role", "text", "mark", "total", F.expr(f"rank div {BLOCK}").alias("block"),
        (F.col("rank") % BLOCK).cast("int").alias("at"),
        F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER).alias("initial"),
        (end == "").alias("blank"), F.substring(end, -1, 1).isin(".", "!", "?").alias("ended"),
    )


def _whole_groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Some rows at a time, with where each group starts and the end; the first `key` columns tell groups apart."""
    held: list[pa.RecordBatch] = []
    n = 0

    def starts_of(table: pa.Table) -> np.ndarray:
        change = np.zeros(len(table), bool)
        change[:1] = True
        for i in range(key):
            code = table.column(i).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            change[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = starts_of(table)
        if starts[-1] > 0:
            yield table.slice(0, starts[-1]), starts
        held = table.slice(starts[-1]).to_batches()
        n = sum(map(len, held))
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(starts_of(table), len(table))


def blocks_of(rows: DataFrame) -> DataFrame:
    """(conv, block, total, codes): of each block a byte a row, its role's initial and first fault."""
    firsts = rows.groupBy("conv", "mark").agg(F.min(F.struct("block", "at")).alias("first"))
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, block long, total long, codes binary"
    slim = rows.select(
        "conv", "block", "at", F.lit(1).alias("kind"), "total",
        (F.col("initial") + F.when(F.col("blank"), 4 * BLANK).when(F.col("ended"), 0).otherwise(4 * TRUNCATED)).alias("code"),
    )
    nothing = F.lit(None).cast("long").alias("total"), F.lit(None).cast("int").alias("code")
    heads = firsts.select("conv", "first.block", "first.at", F.lit(0).alias("kind"), *nothing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches, 2):
            kind = table.column("kind").to_numpy()
            code = table.column("code").combine_chunks().fill_null(0).to_numpy().astype(np.uint8)
            again = np.ones(len(kind), bool)  # no first of its like: the row before is not its head
            again[1:] = kind[:-1] == 1
            code = np.where(again & (code >> 2 != BLANK), code & 3 | 4 * DUPLICATE, code).astype(np.uint8)
            real = kind == 1
            sums = np.concatenate(([0], np.cumsum(real)))[starts]
            data = code[real].tobytes()
            first = np.flatnonzero(real)[sums[:-1]]
            own = table.take(pa.array(first))
            codes = pa.array([data[a:b] for a, b in zip(sums.tolist(), sums[1:].tolist())], pa.binary())
            columns = [own.column(c).combine_chunks() for c in ("conv", "block", "total")]
            yield pa.RecordBatch.from_arrays([*columns, codes], ["conv", "block", "total", "codes"])

    stream = slim.unionByName(heads).repartition("conv", "block").sortWithinPartitions("conv", "block", "at", "kind")
    return stream.mapInArrow(run, schema)


def _streamed(rows: DataFrame, step, more: str) -> DataFrame:
    """Adds to (conv, block, ...) what `step` makes of each row and of what it made of the one before in
    the conversation (None at its first); rows come in the order that they have."""
    n = len(rows.columns)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = [*rows.columns, *(m.split()[0] for m in more.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, begun = None, None, False
        for batch in batches:
            made = []
            for values in zip(*[batch.column(i).to_pylist() for i in range(n)]):
                state = step(values, state if begun and values[0] == conv else None)
                conv, begun = values[0], True
                made.append(state)
            columns = [pa.array([m[i] for m in made], kinds[i]) for i in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

    kinds = [{"long": pa.int64(), "array<long>": pa.list_(pa.int64())}[m.split()[1]] for m in more.split(", ")]
    return rows.mapInArrow(run, f"{fields}, {more}")


def _by_blocks(rows: DataFrame, make, more: str) -> DataFrame:
    """Adds what `make` returns for lists of the columns of blocks of like size."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = [*rows.columns, *(m.split()[0] for m in more.split(", "))]
    place = rows.columns.index("codes")
    types = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "string": pa.string()}
    kinds = [types[m.split()[1]] for m in more.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(place).to_pylist()
            for places in of_like_size(codes):
                part = batch.take(pa.array(places))
                columns = make(*[part.column(i).to_pylist() for i in range(part.num_columns)])
                columns = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names)

    return rows.mapInArrow(run, f"{fields}, {more}")


def _backward(values: tuple, later) -> tuple:
    """(after): the costs to the end of the conversation, by state, where this block ends; and where it starts."""
    after = ENDS if later is None else np.array(later[1])
    matrix = np.array(values[2]).reshape(4, 4)
    return after.tolist(), np.minimum(RESERVED, (matrix + after).min(axis=1)).tolist()


def _forward(values: tuple, earlier) -> tuple:
    """(entry, exit, border): the state in which this block starts and ends; whether its first role may not follow."""
    exits, first, last = values[2:5]
    entry = 0 if earlier is None else earlier[1]
    border = 0 if earlier is None else int(not legal(earlier[3], first))
    return entry, exits[entry], border, last


def legal(a, b):
    """Whether two roles may follow each other: system and user, user and assistant, assistant and user."""
    return (a == SYSTEM) & (b == USER) | (a == USER) & (b == ASSISTANT) | (a == ASSISTANT) & (b == USER)


def _entered(blocks: DataFrame) -> DataFrame:
    """(conv, block, codes, entry, after, border) of the blocks of conversations that have several."""

    def measured(conv, block, codes):
        return [matrices(codes).reshape(-1, 16).tolist()]

    def left(conv, block, codes, after):
        ends = np.array(after)
        exits = [solved(codes, ends, np.full(len(codes), s))[1] for s in range(4)]
        table = [np.frombuffer(c, np.uint8) & 3 for c in codes]
        return np.array(exits).T.tolist(), [int(t[0]) for t in table], [int(t[-1]) for t in table]

    blocks = blocks.select("conv", "block", "codes")
    costed = _by_blocks(blocks, measured, "matrix array<long>").select("conv", "block", "matrix")
    last_first = costed.repartition("conv").sortWithinPartitions("conv", F.col("block").desc())
    after = shared.cut(
        _streamed(last_first, _backward, "after array<long>, before array<long>").select("conv", "block", "after"), "after"
    )

    def beside(rows: DataFrame, more: DataFrame, *names: str) -> DataFrame:
        other = more.select(F.col("conv").alias("c"), F.col("block").alias("b"), *names)
        return rows.join(other, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")

    ended = beside(blocks, after, "after")
    ways = _by_blocks(ended, left, "exits array<long>, first long, last long").select("conv", "block", "exits", "first", "last")
    first_on = ways.repartition("conv").sortWithinPartitions("conv", "block")
    entries = _streamed(first_on, _forward, "entry long, exit long, border long, own long")
    return beside(ended, entries, "entry", "border").select("conv", "block", "codes", "entry", "after", "border")


def plans(blocks: DataFrame) -> DataFrame:
    """(conv, block, entry, audit, cost, blank, duplicate, truncated, illegal): the edits of each block."""
    none = F.lit(0).cast("long")
    single = blocks.where(F.col("total") <= BLOCK).select(
        "conv", "block", "codes", none.alias("entry"), F.array(*[F.lit(int(c)).cast("long") for c in ENDS]).alias("after"),
        none.alias("border"), F.lit(True).alias("whole"),
    )
    several = blocks.where(F.col("total") > BLOCK)
    ends = several.select("conv", "block", (F.expr(f"(total - 1) div {BLOCK}") == F.col("block")).alias("whole"))
    parts = _entered(several).join(
        ends.select(F.col("conv").alias("c"), F.col("block").alias("b"), "whole"),
        F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")),
    ).drop("c", "b")

    def make(conv, block, codes, entry, after, border, whole):
        audits, last = solved(codes, np.array(after), np.array(entry))
        cost, faults, illegal = [], [], []
        for i, c in enumerate(codes):
            table = np.frombuffer(c, np.uint8)
            if whole[i]:  # the conversation ends here
                audits[i] += b"I" * int(ENDS[last[i]] // INSERT)
            faults.append(np.bincount(table >> 2, minlength=4).tolist())
            role = table & 3
            illegal.append(int((~legal(role[:-1], role[1:])).sum()) + border[i])
            cost.append(_cost(audits[i], table))
        return [[a.decode() for a in audits], cost, *[[f[k] for f in faults] for k in (BLANK, DUPLICATE, TRUNCATED)], illegal]

    more = "audit string, cost long, blank long, duplicate long, truncated long, illegal long"
    return _by_blocks(single.unionByName(parts), make, more).drop("codes", "after", "border", "whole")


def _cost(audit: bytes, table: np.ndarray) -> int:
    """The cost of the edits of a block's rows."""
    edits = np.frombuffer(audit, np.uint8)
    rows = edits[edits != ord("I")]
    stays = (rows != ord("D")) & (table >> 2 == TRUNCATED)
    by = {"R": REROLE, "D": DELETE, "I": INSERT}
    return sum(int((edits == ord(e)).sum()) * c for e, c in by.items()) + TRUNCATION * int(stays.sum())


def edited(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, block, step, edit, turn, role, text): every edit in order, with the row that it leaves or deletes."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    own = rows.select("conv", "block", "at", "turn", "role", "text")
    heads = edits.select("conv", "block", F.lit(-1).alias("at"), "entry", "audit")
    schema = (f"conv {kinds['conv'].simpleString()}, block long, step int, edit string, "
              f"turn {kinds['turn'].simpleString()}, role string, text string")  # fmt: skip
    names = ["conv", "block", "step", "edit", "turn", "role", "text"]
    after = AFTER.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, step, state, of = "", 0, 0, (None, None)

        for batch in shared.sliced(batches):
            out = []

            def inserted() -> None:
                nonlocal step, state
                while step < len(audit) and audit[step] == "I":
                    state = after[state]
                    out.append((*of, step, "I", None, "user" if state == 2 else "assistant", ""))
                    step += 1

            kind = batch.column(3).type
            for conv, block, at, turn, role, text, entry, own_audit in zip(*[c.to_pylist() for c in batch.columns]):
                if at < 0:  # a block starts; what is left of the one before is inserted
                    inserted()
                    audit, step, state, of = own_audit, 0, entry, (conv, block)
                    continue
                inserted()
                edit = audit[step]
                if edit == "R":
                    state = after[state]
                    role = "user" if state == 2 else "assistant"
                elif edit == "K":
                    state = 1 if role[0] == "s" else after[state]
                out.append((conv, block, step, edit, turn, role, text))
                step += 1
            columns = list(zip(*out)) if out else [[]] * 7
            types = [batch.column(0).type, pa.int64(), pa.int32(), pa.string(), kind, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            last = types
        if audit[step:]:
            left = [(*of, step + i, "I", None, "", "") for i in range(len(audit) - step)]
            roles = []
            for _ in left:
                state = after[state]
                roles.append("user" if state == 2 else "assistant")
            columns = list(zip(*left))
            columns[5] = roles
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, last)], names)

    stream = own.unionByName(heads, allowMissingColumns=True).repartition("conv", "block")
    return stream.sortWithinPartitions("conv", "block", "at").mapInArrow(run, schema)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The numbered rows, the plans of their blocks (written) and the edits with their rows."""
    rows = rows_of(conversations)
    edits = shared.cut(plans(shared.cut(blocks_of(rows), "blocks")), "plans")
    return rows, edits, edited(rows, edits)


def gaps(conversations: DataFrame) -> DataFrame:
    """(conv, gaps): turns that are missing between the first and the last."""
    turns = conversations.select(F.col("conv_id").alias("conv"), "turn").groupBy("conv", "turn").agg(F.lit(1).alias("one"))
    found = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv").agg(F.coalesce(found, F.lit(0)).cast("long").alias("gaps"))


COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]


def report(original: DataFrame, damaged: DataFrame) -> DataFrame:
    """One row for each conversation of `original`: its faults after damage, and what repairs it."""
    _, edits, log = repair(damaged)
    conv = F.col("conv_id").alias("conv")
    line = F.concat("role", F.lit(":"), "text")
    lines = log.where("edit != 'D'").select("conv", "block", "step", line.alias("line"))
    heads = edits.select("conv", "block", F.lit(-1).alias("step"), "audit", *COUNTS)
    begun = F.lit(-1).cast("long").alias("block"), F.lit(-1).alias("step")
    known = original.select(conv).distinct().select("conv", *begun)
    stream = (
        lines.unionByName(heads, allowMissingColumns=True)
        .unionByName(known, allowMissingColumns=True)
        .unionByName(gaps(damaged).select("conv", *begun, "gaps"), allowMissingColumns=True)
        .select("conv", "block", "step", "line", "audit", *COUNTS, "gaps")
    )
    kind = original.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", *COUNTS, "audit", "repaired_sha256"]
    schema = ", ".join([f"conv_id {kind}", *[f"{c} long" for c in ("gaps", *COUNTS)], "audit string, repaired_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, first = False, None, True
        sums, audit, digest = [0] * 6, [], hashlib.sha256()
        for batch in shared.sliced(batches):
            done = []
            for conv, _, step, text, letters, *counts in zip(*[c.to_pylist() for c in batch.columns]):
                if not begun or conv != now:
                    if begun:
                        done.append((now, sums[5], *sums[:5], "".join(audit), digest.hexdigest()))
                    begun, now, first = True, conv, True
                    sums, audit, digest = [0] * 6, [], hashlib.sha256()
                if step < 0:
                    sums = [a + (b or 0) for a, b in zip(sums, counts)]
                    audit.append(letters or "")
                    continue
                digest.update(text.encode() if first else b"\n" + text.encode())
                first = False
            kind = batch.column(0).type
            yield _table(done, kind)
        if begun:
            yield _table([(now, sums[5], *sums[:5], "".join(audit), digest.hexdigest())], kind)

    def _table(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [[]] * 9
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return stream.repartition("conv").sortWithinPartitions("conv", "block", "step").mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after a repeatable damage: by a checksum of id and turn some are dropped, emptied, cut of
    their ends, repeated or given the role of the user; null roles and texts are one space."""
    space = F.lit(" ")

    def written(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), space)

    kind = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn")).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(written("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(written("text"), ".!?", "")).otherwise(written("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )
    return rows.where("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "time")


def oracle() -> str:
    """The report in SQL: of each conversation the least (cost, audit) to the end, row by row from the last."""
    from lakeprofile.llm.merkle import crc32_sql

    def step(cost: str, letter: str, line: str, rest: str) -> str:
        return f"{{'c': ({cost} + {rest}.c)::bigint, 'a': '{letter}' || {rest}.a, 't': {line} || {rest}.t}}"

    def least(*options: str) -> str:
        return f"list_sort(list_filter([{', '.join(options)}], lambda o: o is not null))[1]"

    def line(role: str) -> str:
        return f"chr(10) || {role} || ':' || r.text"

    def after_row(state: int, nxt: str, role: str, initials: str) -> str:
        keeps = [f"case when ok and i = '{i}' then {step('more', 'K', line('r.role'), to)} end"
                 for i, to in ((p[0], p[1:]) for p in initials.split())]
        reroled = f"case when ok then {step('1 + more', 'R', line(f"'{role}'"), nxt)} end"
        return least(step("2", "D", "''", f"w{state}"), *keeps, reroled)

    def inserted(own: str, role: str, rest: str) -> str:
        return least(own, step("5", "I", f"chr(10) || '{role}:'", rest))

    end = "{{'c': {}::bigint, 'a': '{}', 't': {}}}".format
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    return f"""
with recursive given as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
    {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 k from conversations),
damaged as (
  select conv_id, turn, case k when 4 then 'user' else role end as role,
    case k when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from given, unnest(case when k = 3 then [1, 2] else [1] end) where k <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) pos, left(role, 1) i,
    not regexp_matches(text, '[^\\x20\\x09-\\x0D]') blank,
    not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') open from damaged),
faults as (
  select *, not blank and row_number() over (partition by conv_id, role, text order by pos) > 1 again,
    lag(i) over (partition by conv_id order by pos) || i pair from placed),
r as (
  select *, not blank and not again ok, not blank and not again and open short,
    case when open then 5 else 0 end more from faults),
sizes as (
  select conv_id, count(*) n, count(*) filter (blank) blank, count(*) filter (again) duplicate,
    count(*) filter (short) truncated, count(*) filter (pair not in ('su', 'ua', 'au')) illegal,
    coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps
  from r group by conv_id),
w as (
  select conv_id, n pos, {end(0, "", "''")} w0, {end(10, "II", f"{user} || {assistant}")} w1,
    {end(5, "I", assistant)} w2, {end(0, "", "''")} w3 from sizes
  union all
  select conv_id, pos - 1, {inserted("b0", "user", "f2")}, {inserted("b1", "user", "f2")}, f2, f3
  from (select *, {inserted("b2", "assistant", "b3")} f2, {inserted("b3", "user", "b2")} f3
    from (select w.conv_id, w.pos, {after_row(0, "w2", "user", "sw1 uw2")} b0, {after_row(1, "w2", "user", "uw2")} b1,
        {after_row(2, "w3", "assistant", "aw3")} b2, {after_row(3, "w2", "user", "uw2")} b3
      from w join r on r.conv_id is not distinct from w.conv_id and r.pos = w.pos))),
every as (select distinct conv_id from conversations)
select e.conv_id, coalesce(s.gaps, 0) gaps, coalesce(s.blank, 0) blank, coalesce(s.duplicate, 0) duplicate,
  coalesce(s.truncated, 0) truncated, coalesce(s.illegal, 0) illegal, coalesce(w.w0.c, 0) as cost,
  coalesce(w.w0.a, '') audit, sha256(coalesce(substr(w.w0.t, 2), '')) repaired_sha256
from every e left join sizes s on s.conv_id is not distinct from e.conv_id
left join w on w.conv_id is not distinct from e.conv_id and w.pos = 0
"""
