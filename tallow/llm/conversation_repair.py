"""Cheapest repair of a conversation's structure, with its audit.

A repaired conversation has role initials ``(s?(ua)+)?``.  Its audit spells the
edits in order: K keep, R rerole, D delete, I insert.  Costs: rerole and insert
3, delete 4; a truncated message that stays costs 3 more; blank and repeated
messages must go.  Of the cheapest audits the least in ASCII is taken.

The dynamic program keeps, for each of four states, the best audit so far as a
node linked to its prefix.  Equal prefixes share nodes; a node knows its
ancestors at powers of two and a rolling hash of its string, so that a tie is
decided by a search for the longest common prefix in logarithmic time, which is
then verified by the nodes' identity.

Messages are sorted by range, so that a long conversation spans many tasks.  A
stretch of it folds to costs and ranks for all pairs of states; the stretches
are put together from these few numbers alone.  Audits of equal cost over the
same messages that end in the edit of a message are never prefixes of each
other, so ranks decide ties of whole audits too.  Only the digest of the
repaired text, which no one can compute in parts, runs through a conversation
in one task, message by message.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm import scratch

#: Messages that one map of states covers, and those of one sorted partition, about.
STRETCH = 4096
PARTITION_ROWS = 1 << 18
#: Code points by which messages of equal turn and role are ordered before their digest decides.
ORDER_CHARS = 256

SPACE = r"\x20\x09-\x0D"
SOUND, BLANK, DUPLICATE, TRUNCATED, NONE = range(5)

#: States: nothing yet, after a system message, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a message of that initial.
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state after a message whose role may be chosen.
FREE = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
#: States that insertions lead to, by their number; more would return to a state.
INSERTS = [[(0, START), (1, USER), (2, ASSISTANT)], [(0, SYSTEM), (1, USER), (2, ASSISTANT)], [(0, USER), (1, ASSISTANT)], [(0, ASSISTANT), (1, USER)]]
#: Insertions that end a conversation in this state.
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}

_PRIME, _BASE = (1 << 61) - 1, 1_315_423_911_877


class Prefixes:
    """Strings as linked nodes; equal strings are one node, 0 is the empty one."""

    def __init__(self, base: int = _BASE):
        self.base, self.char, self.depth, self.hash, self.up = base, [0], [0], [0], [()]
        self.known: dict[tuple[int, int], int] = {}

    def add(self, parent: int, char: int) -> int:
        node = self.known.get((parent, char))
        if node is None:
            node = self.known[parent, char] = len(self.char)
            up, k = [parent], 0
            while k < len(self.up[up[k]]):
                up.append(self.up[up[k]][k])
                k += 1
            self.char.append(char)
            self.depth.append(self.depth[parent] + 1)
            self.hash.append((self.hash[parent] * self.base + char + 1) % _PRIME)
            self.up.append(tuple(up))
        return node

    def lifted(self, node: int, depth: int) -> int:
        """The prefix of that length."""
        rest = self.depth[node] - depth
        while rest:
            k = rest.bit_length() - 1
            node = self.up[node][k]
            rest -= 1 << k
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether a's string comes before b's."""
        if a == b:
            return False
        n = min(self.depth[a], self.depth[b])
        x, y = self.lifted(a, n), self.lifted(b, n)
        if x == y:
            return self.depth[a] < self.depth[b]
        for k in range(n.bit_length() - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        while self.up[x][0] != self.up[y][0]:  # equal hashes of different strings: the first difference lies further up
            x, y = self.up[x][0], self.up[y][0]
        return self.char[x] < self.char[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(chr(self.char[node]))
            node = self.up[node][0]
        return "".join(reversed(out))


def fold(messages: list[tuple[str, int]], start: int) -> list[tuple[int, str] | None]:
    """By end state: the cheapest audit of (initial, kind) messages from a start state, without insertions after the last."""
    tree = Prefixes()
    best: list[tuple[int, int] | None] = [(0, 0) if s == start else None for s in range(4)]
    for initial, kind in messages:
        after: list[tuple[int, int] | None] = [None] * 4

        def offer(state: int, cost: int, node: int, edits: str) -> None:
            if after[state] is None or cost <= after[state][0]:  # noqa: B023
                for c in edits:
                    node = tree.add(node, ord(c))
                if after[state] is None or cost < after[state][0] or tree.less(node, after[state][1]):  # noqa: B023
                    after[state] = (cost, node)  # noqa: B023

        for state, found in enumerate(best):
            if found is None:
                continue
            cost, node = found
            offer(state, cost + 4, node, "D")
            if kind in (BLANK, DUPLICATE):
                continue
            stays = 3 if kind == TRUNCATED else 0
            for n, at in INSERTS[state]:  # an insertion before a deletion would read greater than one behind it
                to = KEEP.get(initial, {}).get(at)
                if to is not None:
                    offer(to, cost + 3 * n + stays, node, "I" * n + "K")
                if at in FREE:
                    offer(FREE[at], cost + 3 * n + 3 + stays, node, "I" * n + "R")
        best = after
    return [None if b is None else (b[0], tree.text(b[1])) for b in best]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow each other with equal leading columns."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != at:
                if rows:
                    yield at, rows
                at, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield at, rows


def _batches(rows: Iterator[tuple], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str)) + sum(len(y or "") for x in row if isinstance(x, list) for y in x if not isinstance(y, int))
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, stretch, place, initial, kind) in order to one row for each stretch."""

    def mapped(batches):
        for (key, stretch), rows in _runs(batches, 2):
            messages = [(initial, kind) for _, initial, kind in rows if kind != NONE]
            cost, rank, audits = [], [], []
            for start in range(4):
                ends = fold(messages, start)
                order = sorted(e[1] for e in ends if e is not None)
                cost += [-1 if e is None else e[0] for e in ends]
                rank += [-1 if e is None else order.index(e[1]) for e in ends]
                audits += [None if e is None else e[1] for e in ends]
            kinds = [kind for _, kind in messages]
            yield (key, stretch, rows[0][0], cost, rank, audits, kinds.count(BLANK), kinds.count(DUPLICATE), kinds.count(TRUNCATED))

    yield from _batches(mapped(batches), _MAP_TYPES, _MAP_NAMES)


_INTS = pa.list_(pa.int64())
_MAP_NAMES = ["key", "stretch", "place", "cost", "rank", "audits", "blank", "duplicate", "truncated"]
_MAP_TYPES = [pa.string(), pa.int64(), pa.int64(), _INTS, _INTS, pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64()]
_MAP = "key string, stretch long, place long, cost array<long>, rank array<long>, audits array<string>, blank long, duplicate long, truncated long"


def _route(stretches: list[tuple[int, list[int], list[int]]]) -> Iterator[tuple[int, int, int, int]]:
    """By stretch (number, costs, ranks) of a conversation, in order: its number, the states that the best audit enters and leaves it in, closing insertions, the whole cost at the first."""
    tree, paths = Prefixes(), [(0, 0, ())] + [None] * 3  # cost, node of ranks, linked list of states
    for _, cost, rank in stretches:
        after = [None] * 4
        for s, path in enumerate(paths):
            for e in range(4):
                if path is None or cost[4 * s + e] < 0:
                    continue
                total, node = path[0] + cost[4 * s + e], tree.add(path[1], rank[4 * s + e])
                if after[e] is None or total < after[e][0] or (total == after[e][0] and tree.less(node, after[e][1])):
                    after[e] = (total, node, (s, e, path[2]))
        paths = after
    best = None
    for s, path in enumerate(paths):
        if path is not None:
            total = path[0] + 3 * CLOSING[s]
            if best is None or total < best[0] or (total == best[0] and tree.less(path[1], best[1])):
                best = (total, path[1], path[2], CLOSING[s])
    steps, link = [], best[2]
    while link:
        steps.append(4 * link[0] + link[1])
        link = link[2]
    for k, ((number, _, _), step) in enumerate(zip(stretches, reversed(steps))):
        yield number, step, best[3] if k == len(stretches) - 1 else 0, best[0] if k == 0 else 0


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, stretch, cost, rank) in order to (key, stretch, step, closing, total)."""
    rows = ((key, *found) for (key,), stretches in _runs(batches, 1) for found in _route(stretches))
    yield from _batches(rows, [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()], ["key", "stretch", "step", "closing", "total"])


@dataclass
class _Conversation:
    """One conversation as its messages stream by."""

    conv_id: object
    gaps: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    cost: int = 0

    def __post_init__(self):
        self.parts, self.edits, self.state, self.out = [], iter(""), START, 0
        self.digest, self.first, self.last, self.turns, self.before = hashlib.sha256(), None, None, 0, None

    def emit(self, role: str, text: str, edit: str) -> tuple:
        self.digest.update((("\n" if self.out else "") + f"{role}:{text}").encode())
        self.out += 1
        return (self.conv_id, self.out - 1, role, text, edit)

    def turned(self, text: str, edit: str) -> tuple:
        """A message whose role follows from the state."""
        self.state = FREE[self.state]
        return self.emit("user" if self.state == USER else "assistant", text, edit)

    def part(self, audit: str, blank: int, duplicate: int, truncated: int, total: int) -> Iterator[tuple]:
        yield from self.close()
        self.parts.append(audit)
        self.edits = iter(audit)
        self.blank, self.duplicate, self.truncated, self.cost = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated, self.cost + total

    def message(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        if turn is not None and (self.last is None or turn != self.last):
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        for edit in self.edits:
            if edit == "I":
                yield self.turned("", "I")
                continue
            if edit == "R":
                yield self.turned(text, "R")
            elif edit == "K":
                self.state = KEEP[initial][self.state]
                yield self.emit(role, text, "K")
            return

    def close(self) -> Iterator[tuple]:
        for _ in self.edits:
            yield self.turned("", "I")

    def summary(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.parts), self.digest.hexdigest())


AUDIT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _applied(types: list[pa.DataType], summaries: bool):
    """Sorted messages with the audit of a stretch on its first one to summaries of conversations or to repaired messages."""
    names = ["conv_id", *(AUDIT if summaries else ["seq", "role", "text", "edit"])]

    def stream(batches):
        now, key = None, None
        for batch in batches:
            for k, _, conv, turn, role, text, kind, audit, *numbers in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or k != key:
                    if now is not None:
                        yield from _ended(now)
                    now, key = _Conversation(conv), k
                if audit is not None:
                    yield from _told(now.part(audit, *numbers))
                if kind != NONE:
                    yield from _told(now.message(turn, role, text))
        if now is not None:
            yield from _ended(now)

    def _told(rows):
        for r in rows:
            if not summaries:
                yield r

    def _ended(now):
        yield from _told(now.close())
        if summaries:
            yield now.summary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(stream(batches), types, names)

    return run


@dataclass(frozen=True)
class Repair:
    """audits: a row for each conversation; messages: the repaired ones, (conv_id, seq, role, text, edit)."""

    audits: DataFrame
    messages: DataFrame


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that crc32 of `conv_id:turn` modulo 20 deals out; null texts are one space.

    0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4
    makes its role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fault.alias("__fault")).where("__fault != 0")
    text = F.when(F.col("__fault") == 1, F.lit("")).when(F.col("__fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("__fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("conv_id", "turn", F.when(F.col("__fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("__copy"))
    return rows.drop("__copy")


def repair(messages: DataFrame, conversations: DataFrame | None = None) -> Repair:
    """The cheapest repair of each conversation.

    messages has conv_id, turn, role and text; other columns are left aside.
    Null roles and texts are one space, null conv_ids one conversation.  A
    conversation is read by turn, nulls first; messages of equal turn by role,
    then by text (its first 256 code points, then its SHA-256).  conversations
    has the conv_ids to report, messages or not; without messages a
    conversation has zeros, an empty audit and the digest of nothing.
    """
    spark, conv = messages.sparkSession, messages.schema["conv_id"].dataType
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), part("role"), part("text"), F.lit(False).alias("none"), F.monotonically_increasing_id().alias("salt"))
    if conversations is not None:
        ids = conversations.select(F.col("conv_id").cast(conv).alias("conv_id")).distinct()
        rows = rows.union(ids.select("conv_id", F.lit(None).cast("long"), F.lit(""), F.lit(""), F.lit(True), F.lit(-1).cast("long")))
    key = F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    rows = scratch.table(rows.withColumns({"key": key, "same": F.unhex(F.sha2("text", 256)), "head": F.substring("text", 1, ORDER_CHARS)}), "messages")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows.count() // PARTITION_ROWS)
    order = [F.col("key"), F.asc_nulls_first("turn"), F.col("role"), F.col("head"), F.col("same"), F.col("salt")]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("head", "salt").withColumn("place", F.monotonically_increasing_id())
    rows = scratch.table(placed, "placed")  # a place is only true of this one run

    told = F.col("text").rlike(f"[^{SPACE}]")
    whole = F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    first = rows.where(~F.col("none")).groupBy("key", "role", "same").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first"))
    kind = F.when(F.col("none"), NONE).when(~told, BLANK).when(F.col("is_first").isNull(), DUPLICATE).when(~whole, TRUNCATED).otherwise(SOUND)
    # The cuts between stretches follow places, so that a stretch stays within a sorted partition.
    marks = rows.join(first.hint("merge"), "place", "left").select("key", F.floor(F.col("place") / STRETCH).alias("stretch"), "place", F.substring("role", 1, 1).alias("initial"), kind.cast("int").alias("kind"))
    maps = marks.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "place").mapInArrow(_maps, _MAP)
    maps = scratch.table(maps, "maps")
    steps = maps.select("key", "stretch", "cost", "rank").repartition("key").sortWithinPartitions("key", "stretch").mapInArrow(_routes, "key string, stretch long, step int, closing int, total long")
    audit = F.concat(F.get("audits", F.col("step")), F.repeat(F.lit("I"), F.col("closing")))
    chosen = maps.join(steps.hint("merge"), ["key", "stretch"]).select("place", audit.alias("audit"), "blank", "duplicate", "truncated", "total")
    chosen = scratch.table(chosen, "chosen")
    kind = F.when(F.col("none"), NONE).otherwise(SOUND).alias("kind")
    edited = rows.join(chosen.hint("merge"), "place", "left").select("key", "place", "conv_id", "turn", "role", "text", kind, "audit", "blank", "duplicate", "truncated", "total")
    edited = edited.repartition("key").sortWithinPartitions("key", "place")
    arrow = edited.select("conv_id").limit(0).toArrow().schema.field(0).type
    name = conv.simpleString()
    whole = [arrow, *[pa.int64()] * 6, pa.string(), pa.string()]
    audits = edited.mapInArrow(_applied(whole, True), f"conv_id {name}, " + ", ".join(f"{c} long" for c in AUDIT[:6]) + ", audit string, repaired_sha256 string")
    repaired = edited.mapInArrow(_applied([arrow, pa.int64(), *[pa.string()] * 3], False), f"conv_id {name}, seq long, role string, text string, edit string")
    return Repair(audits, repaired)
