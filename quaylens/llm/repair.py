"""Repair of conversations: faults of turns, and the cheapest edits that give a legal order of roles.

The rows of a conversation are taken by turn (nulls first), equal turns by role and then by a digest of role and text. A row's first
fault counts: blank (only white space), duplicate (role and text seen earlier in the conversation), truncated (its last character
that isn't white space is none of . ! ?). Legal is `(s?(ua)+)?` over the roles' first letters. Keep costs 0, Rerole (to user or assistant) 2,
Delete 3 (a must for blank and duplicate rows), Insert (an empty text of user or assistant) 2, a truncated row that stays 1. Among
the cheapest edits those count whose letters are least in ASCII.

How it goes: rows are range-partitioned and sorted by conversation and turn, so that one long conversation lies in many parts, and
packed into blocks of at most BLOCK_ROWS rows of one conversation. A block's costs from each of the four states of the grammar before it to each
after it are a 4 x 4 table; a pass over those tables alone, from a conversation's end, gives the costs still to come behind each block.
With them a block knows which arcs (edits) are optimal at each of its nodes (row, state). Its nodes are ranked by the least letters
that follow, for lengths 1, 2, 4, ... : the rank for 2L letters is that of the pair (rank for L, rank for L of the node that the
least L letters lead to), whose pointer is the pointer's pointer. A node's arcs have different letters, so one pointer holds whatever
continues least; each node takes its arc by letter and by the rank of what follows, and the paths from the four states are written out by doubling:
the pointers over L arcs, put to the first L nodes of a path, give the next L. A last pass goes through a conversation's blocks in order, takes each
block's path from the state that the one before ended in, and hashes the repaired rows as they pass.

A conversation of any length needs a block in memory, and its audit. Its last pass is one task's, as a hash over all
its rows in order must be; the work on rows and texts before that isn't.

Cases: a null role or text is one space; other roles than those that start with s, u or a fit nowhere and are reroled or
deleted. Rows with a null conv_id are a conversation of their own. Rows with a null turn come first and count in no gap;
repeated rows are duplicates. Turns are taken as longs. A conversation of `every` without rows has zeros, an empty audit and the hash of the empty
text. Empty tables give an empty one. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylens.llm.common import DROP_SHUFFLES, SPLIT_JOINS, materialise, scratch, session_settings

BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
#: Nodes over which costs and ranks are computed at once
NODES_AT_ONCE = 1 << 18
SPACES = " \t\n\x0b\f\r"
#: Flags of a row; the two lowest bits are its role: s, u, a, other
BLANK, TRUNCATED, REPEATED = 4, 8, 16
#: The grammar's states: nothing yet, after s, after u, after a. Where a kept role leads (-1: nowhere), and the one role that may be put in.
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
PUT = np.array([2, 2, 3, 2])
NAME_OF = {2: "user", 3: "assistant"}
#: What still has to be put in at the end of a conversation, by state
TAIL = ["", "II", "I", ""]
AT_END = np.array([0, 4, 2, 0])
LETTERS = np.frombuffer(b"DIKR", dtype=np.uint8)
FAR = 1 << 50
LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of damaged rows: crc32(`conv_id:turn`) % 20 drops (0), empties (1), unpunctuates (2), repeats (3) a row or makes it the user's (4)."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    changed = F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = turns.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), changed.alias("text"), fault.alias("fault")).where("fault <> 0")
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(times).alias("time")).drop("time")


def _flags(role: Column, text: Column) -> Column:
    body, first = F.rtrim(text, F.lit(SPACES)), F.substring(role, 1, 1)
    letter = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return letter + F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)


def blocks_of(turns: DataFrame, block_rows: int) -> DataFrame:
    """conv_id, block (ascending), turns, roles, texts, flags (a byte a row), heads (place and key of the first row of each role and text) of every block."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", F.expr("try_cast(turn AS long)").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("key", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
    # equal rows only need to be parted somehow, so that a range can end among them
    rows = rows.withColumn("serial", F.monotonically_increasing_id()).withColumn("flag", _flags(F.col("role"), F.col("text")).cast("int"))
    order = ["conv_id", "turn", "role", "key", "serial"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                part = batch.slice(i, 8192)
                cuts = _cuts(part, block_rows)
                yield _packed(part, cuts, block)
                block += len(cuts) - 1

    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.drop("serial").mapInArrow(run, f"conv_id {kind}, block long, turns array<long>, roles array<string>, texts array<string>, flags binary, heads array<struct<place:int,key:binary>>")


def _cuts(rows: pa.RecordBatch, block_rows: int) -> np.ndarray:
    """Where blocks start, and the number of rows."""
    ids = rows.column("conv_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    sizes = pc.binary_length(rows.column("text")).to_numpy(zero_copy_only=False)
    cuts, held = [0], 0
    for i in range(1, len(ids)):
        held += int(sizes[i - 1])
        if ids[i] != ids[i - 1] or i - cuts[-1] >= block_rows or held + sizes[i] > BLOCK_BYTES:
            cuts.append(i)
            held = 0
    return np.array([*cuts, len(ids)])


def _packed(rows: pa.RecordBatch, cuts: np.ndarray, first_block: int) -> pa.RecordBatch:
    flags = rows.column("flag").to_numpy().astype(np.uint8)
    keys = rows.column("key").dictionary_encode().indices.to_numpy()
    of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    _, first = np.unique(np.column_stack([of, keys]), axis=0, return_index=True)
    new = np.zeros(len(flags), dtype=bool)
    new[first] = True
    flags[~new & (flags & BLANK == 0)] |= REPEATED
    heads = np.flatnonzero(new & (flags & BLANK == 0))
    offsets = pa.array(cuts, pa.int32())
    inner = pa.StructArray.from_arrays([pa.array((heads - cuts[of[heads]]).astype(np.int32)), rows.column("key").take(pa.array(heads))], names=["place", "key"])
    lists = lambda name: pa.ListArray.from_arrays(offsets, rows.column(name))
    return pa.RecordBatch.from_arrays(
        [
            rows.column("conv_id").take(pa.array(cuts[:-1])),
            pa.array(first_block + np.arange(len(cuts) - 1), pa.int64()),
            lists("turn"),
            lists("role"),
            lists("text"),
            pa.array([flags[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(heads, cuts).astype(np.int32)), inner),
        ],
        names=["conv_id", "block", "turns", "roles", "texts", "flags", "heads"],
    )


def seen_in_earlier_blocks(blocks: DataFrame) -> DataFrame:
    """block, places: rows whose role and text occur in an earlier block of the conversation. Each block brings a key once."""
    heads = blocks.select("conv_id", "block", F.explode("heads").alias("head")).select("conv_id", "block", "head.place", "head.key")
    several = heads.groupBy("conv_id", "key").agg(F.min("block").alias("first"), F.count("*").alias("n")).where("n > 1")
    several = several.select(F.col("conv_id").alias("_conv"), F.col("key").alias("_key"), "first")
    later = heads.join(several, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key"))).where("block > first")
    return later.groupBy("block").agg(F.collect_list("place").alias("places"))


def costs_of(flags: np.ndarray, lengths: np.ndarray, end: np.ndarray) -> np.ndarray:
    """[row, block, state, ...] the least cost from before each row to the end, whose costs are `end` [block, state, ...]. Rows beyond a block's length do nothing."""
    out = np.empty((flags.shape[1] + 1, *end.shape), dtype=np.int64)
    out[-1] = end
    letter, may_stay, late = flags & 3, flags & (BLANK | REPEATED) == 0, (flags & TRUNCATED > 0).astype(np.int64)
    tail = (1,) * (end.ndim - 2)
    for i in range(flags.shape[1] - 1, -1, -1):
        after, now = out[i + 1], out[i]
        stays = np.where(may_stay[:, i], late[:, i], FAR).reshape(-1, *tail)
        for q in range(4):
            best = np.minimum(after[:, q] + 3, after[:, PUT[q]] + 2 + stays)
            to = KEPT[q][letter[:, i]]
            kept = after[np.arange(len(to)), np.maximum(to, 0)] + stays
            now[:, q] = np.minimum(best, np.where((to >= 0).reshape(-1, *tail), kept, FAR))
        user, assistant = now[:, 2].copy(), now[:, 3].copy()
        now[:, 2] = np.minimum(user, assistant + 2)
        now[:, 3] = np.minimum(assistant, user + 2)
        for q in (0, 1):
            now[:, q] = np.minimum(now[:, q], now[:, 2] + 2)
        gone = i >= lengths
        now[gone] = after[gone]
    return np.minimum(out, FAR)


def least_paths(flags: np.ndarray, lengths: np.ndarray, costs: np.ndarray) -> tuple[list[list[bytes]], np.ndarray]:
    """For each block and state before it: the letters of the cheapest edits, least in ASCII, and the state after them.

    Node (row, block, state) has number (row * blocks + block) * 4 + state; behind a block's last row paths stand still.
    """
    rows, n = flags.shape[1], len(flags)
    nodes = np.arange((rows + 1) * n * 4).reshape(rows + 1, n, 4)
    target = np.repeat(nodes[:, :, :, None], 4, axis=3)  # by letter: D, I, K, R
    price = np.full(target.shape, FAR, dtype=np.int64)
    letter, late = (flags & 3).T, (flags & TRUNCATED > 0).T.astype(np.int64)
    stays = np.where((flags & (BLANK | REPEATED) == 0).T, late, FAR)
    live = (np.arange(rows)[:, None] < lengths[None, :])[:, :, None]
    q = np.arange(4)[None, None, :]
    to = KEPT[q, letter[:, :, None]]
    target[:-1, :, :, 0], price[:-1, :, :, 0] = nodes[1:], 3
    target[:-1, :, :, 1], price[:-1, :, :, 1] = nodes[:-1][:, :, PUT], 2
    target[:-1, :, :, 2] = np.take_along_axis(nodes[1:], np.maximum(to, 0), axis=2)
    price[:-1, :, :, 2] = np.where(to >= 0, stays[:, :, None], FAR)
    target[:-1, :, :, 3], price[:-1, :, :, 3] = nodes[1:][:, :, PUT], 2 + stays[:, :, None]
    flat = costs.reshape(-1)
    best = (price + flat[target] == costs[..., None]) & (price < FAR)
    best[:-1] &= live[..., None]
    best[-1] = False
    target, best = target.reshape(-1, 4), best.reshape(-1, 4)
    still = ~best.any(axis=1)
    every = np.arange(len(still))
    # lengths 1, 2, 4, ...: rank 0 stands still, which sorts before any letter
    first = np.where(still, 0, best.argmax(axis=1))
    rank = np.where(still, 0, first + 1)
    jump = np.where(still, every, target[every, first])
    while not still[jump].all():
        _, rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)
        jump = jump[jump]
    # each node's arc: the least by letter and rank of what follows
    after = np.where(best, np.arange(4)[None, :] * (rank.max() + 1) + rank[target], np.iinfo(np.int64).max)
    arc = after.argmin(axis=1)
    jump = np.where(still, every, target[every, arc])
    paths = nodes[0].reshape(-1, 1)
    while not still[paths[:, -1]].all():
        paths = np.concatenate([paths, jump[paths]], axis=1)
        jump = jump[jump]
    audits = np.where(still[paths], 0, LETTERS[arc[paths]])
    found = [audits[i, : np.count_nonzero(audits[i])].astype(np.uint8).tobytes() for i in range(len(audits))]
    return [found[i : i + 4] for i in range(0, len(found), 4)], (paths[:, -1] % 4).reshape(-1, 4)


def _groups(flags: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of like length: their numbers, their flags as a table, their lengths."""
    lengths = np.array([len(f) for f in flags])
    order = np.argsort(lengths, kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * (lengths[order[j]] + 1) * 4 <= NODES_AT_ONCE:
            j += 1
        chosen = order[i:j]
        longest = int(lengths[chosen[-1]])
        table = np.frombuffer(b"".join(flags[k].ljust(longest, b"\0") for k in chosen), dtype=np.uint8).reshape(len(chosen), longest)
        yield chosen, table, lengths[chosen]
        i = j


def with_costs(blocks: DataFrame) -> DataFrame:
    """conv_id, block, flags (with rows seen in earlier blocks), costs (4 x 4, from each state before to each after)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = np.where(np.eye(4, dtype=bool), 0, FAR)
        for batch in batches:
            flags = [bytearray(f) for f in batch.column("flags").to_pylist()]
            for f, places in zip(flags, batch.column("places").to_pylist(), strict=True):
                for p in places or ():
                    f[p] |= REPEATED
            flags = [bytes(f) for f in flags]
            tables = np.empty((len(flags), 16), dtype=np.int64)
            for chosen, table, lengths in _groups(flags):
                tables[chosen] = costs_of(table, lengths, np.repeat(unit[None], len(chosen), axis=0))[0].reshape(-1, 16)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(flags, pa.binary()), pa.array(list(tables), pa.list_(pa.int64()))], names=["conv_id", "block", "flags", "costs"])

    kind = blocks.schema["conv_id"].dataType.simpleString()
    known = blocks.select("conv_id", "block", "flags").join(seen_in_earlier_blocks(blocks), "block", "left")
    return known.select("conv_id", "block", "flags", "places").mapInArrow(run, f"conv_id {kind}, block long, flags binary, costs array<long>")


def costs_behind(tables: DataFrame) -> DataFrame:
    """block, behind: the least costs from each state behind a block to its conversation's end. One short row for each block is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, behind = object(), AT_END
        for batch in batches:
            costs = np.array(batch.column("costs").to_pylist(), dtype=np.int64).reshape(-1, 4, 4)
            out = []
            for conv, table in zip(batch.column("conv_id").to_pylist(), costs, strict=True):
                if conv != of:
                    of, behind = conv, AT_END
                out.append(behind)
                behind = (table + behind[None, :]).min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.list_(pa.int64()))], names=["block", "behind"])

    last_first = tables.select("conv_id", "block", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    return last_first.mapInArrow(run, "block long, behind array<long>")


def block_paths(tables: DataFrame) -> DataFrame:
    """conv_id, block, flags, audits and ends (by state before the block: the letters of its edits, the state after them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = batch.column("flags").to_pylist()
            behind = np.array(batch.column("behind").to_pylist(), dtype=np.int64).reshape(-1, 4)
            audits: list[list[str]] = [[]] * len(flags)
            ends = np.empty((len(flags), 4), dtype=np.int64)
            for chosen, table, lengths in _groups(flags):
                found, ends[chosen] = least_paths(table, lengths, costs_of(table, lengths, behind[chosen]))
                for k, a in zip(chosen, found, strict=True):
                    audits[k] = [x.decode() for x in a]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), batch.column("flags"), pa.array(audits, pa.list_(pa.string())), pa.array(list(ends), pa.list_(pa.int64()))],
                names=["conv_id", "block", "flags", "audits", "ends"],
            )

    kind = tables.schema["conv_id"].dataType.simpleString()
    known = tables.select("conv_id", "block", "flags").join(costs_behind(tables), "block")
    return known.mapInArrow(run, f"conv_id {kind}, block long, flags binary, audits array<string>, ends array<long>")


class _Conversation:
    """What the last pass keeps of a conversation."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.state, self.audit, self.hash, self.any = conv_id, 0, [], hashlib.sha256(), False
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.before: int | None = None
        self.first_turn: int | None = None
        self.last_turn: int | None = None
        self.turns = 0

    def put(self, role: str, text: str) -> tuple[str, str]:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "replace"))
        self.any = True
        return role, text

    def insert(self) -> tuple[str, str]:
        self.state = int(PUT[self.state])
        self.counts["cost"] += 2
        return self.put(NAME_OF[self.state], "")

    def block(self, path: dict, turns: list, roles: list, texts: list) -> list[tuple[str, str]]:
        """Takes a block in, gives its repaired rows."""
        n, flags = self.counts, path["flags"]
        for f in flags:
            n["blank"] += f & BLANK > 0
            n["duplicate"] += f & REPEATED > 0
            n["truncated"] += f & (TRUNCATED | REPEATED) == TRUNCATED
            n["illegal"] += self.before is not None and (self.before, f & 3) not in LEGAL_PAIRS
            self.before = f & 3
        for t in turns:
            if t is not None and t != self.last_turn:
                self.first_turn = t if self.first_turn is None else self.first_turn
                self.last_turn = t
                self.turns += 1
        audit, out, row = path["audits"][self.state], [], 0
        for edit in audit:
            if edit == "I":
                out.append(self.insert())
                continue
            if edit == "D":
                n["cost"] += 3
            else:
                n["cost"] += flags[row] & TRUNCATED > 0
                if edit == "K":
                    self.state = int(KEPT[self.state, flags[row] & 3])
                    out.append(self.put(roles[row], texts[row]))
                else:
                    self.state = int(PUT[self.state])
                    n["cost"] += 2
                    out.append(self.put(NAME_OF[self.state], texts[row]))
            row += 1
        self.audit.append(audit)
        return out

    def end(self) -> list[tuple[str, str]]:
        tail = TAIL[self.state]
        self.audit.append(tail)
        return [self.insert() for _ in tail]

    def summary(self) -> dict:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.first_turn is not None and self.last_turn is not None else 0
        return {"conv_id": self.conv_id, "gaps": gaps} | self.counts | {"audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _prepared(turns: DataFrame, every: DataFrame | None, block_rows: int) -> DataFrame:
    """A conversation's rows in order: one of nothing, then for each block its path and, behind it, its texts."""
    spark = turns.sparkSession
    with session_settings(spark, SPLIT_JOINS | DROP_SHUFFLES):
        blocks = materialise(blocks_of(turns, block_rows), "conversation-blocks")
        with scratch(spark):
            tables = materialise(with_costs(blocks), "conversation-costs")
            paths = materialise(block_paths(tables), "conversation-paths", outlives=1)
    rows = paths.withColumn("step", F.lit(0)).unionByName(blocks.drop("flags", "heads").withColumn("step", F.lit(1)), allowMissingColumns=True)
    ids = (every if every is not None else turns).select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("block"), F.lit(-1).alias("step"))
    return rows.unionByName(ids, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "block", "step")


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, list[tuple[str, str]], bool]]:
    """Each conversation with the repaired rows of its next block; True at its end."""
    now, path = None, {}
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            if now is None or row["conv_id"] != now.conv_id:
                if now is not None:
                    yield now, now.end(), True
                now = _Conversation(row["conv_id"])
            if row["step"] == 0:
                path = row
            elif row["step"] == 1:
                yield now, now.block(path, row["turns"], row["roles"], row["texts"]), False
    if now is not None:
        yield now, now.end(), True


def repair(turns: DataFrame, every: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256 of every conversation of `every` (or of `turns`)."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    arrow = lambda batch: batch.schema.field("conv_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema: list[pa.DataType] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                schema[:] = [arrow(batch)]
                yield batch

        def packed(held: list[dict]) -> pa.RecordBatch:
            columns = [pa.array([r["conv_id"] for r in held], schema[0]), *[pa.array([r[c] for r in held], pa.int64()) for c in longs]]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([r[c] for r in held], pa.string()) for c in ("audit", "repaired_sha256")]], names=["conv_id", *longs, "audit", "repaired_sha256"])

        held: list[dict] = []
        letters = 0
        for conversation, _, ended in _passed(noted()):
            if ended:
                held.append(conversation.summary())
                letters += len(held[-1]["audit"])
                if len(held) >= 1024 or letters > BLOCK_BYTES:
                    yield packed(held)
                    held, letters = [], 0
        if held:
            yield packed(held)

    return _prepared(turns, every, block_rows).mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in longs)}, audit string, repaired_sha256 string")


def repaired_turns(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, place (from 0), role, text: the conversations after their edits."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: list[pa.DataType] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of[:] = [batch.schema.field("conv_id").type]
                yield batch

        place = 0
        for conversation, rows, ended in _passed(noted()):
            if rows:
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conversation.conv_id] * n, of[0]), pa.array(range(place, place + n), pa.int64()), pa.array([r for r, _ in rows]), pa.array([t for _, t in rows])],
                    names=["conv_id", "place", "role", "text"],
                )
            place = 0 if ended else place + len(rows)

    return _prepared(turns, None, block_rows).mapInArrow(run, f"conv_id {kind}, place long, role string, text string")
