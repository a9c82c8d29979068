"""Conversation structure repair by dynamic programming over persistent audits (operator 12).

A conversation is repaired to turns whose role initials are ``(s?(ua)+)?``. The
edits of a row are Keep (0), Rerole to user or assistant (1) and Delete (2, and
the only one for blank and duplicate rows); Insert (5) puts an empty turn of
user or assistant anywhere; a truncated row that stays adds 5. Of the cheapest
audits (the edits' initials in order) the ASCII-least is taken.

Between two rows only the state of the pattern matters (nothing yet, after s,
after u, after a), so the program keeps one cheapest audit for each state.
Audits share their prefixes: an audit is a node linked to the one before it,
with binary-lifting ancestors and a rolling hash of its letters. Audits of one
cost are compared by searching the longest common prefix over the hashes, and
what the hashes say is verified letter by letter as far as nodes are not shared.

Rows of a conversation stream through one task in the order of their turns,
sorted by Spark. The part of the audits that all states share is final: it is
handed out and forgotten, so memory holds the rows over which the states still
differ: a few for most conversations, all of them only if two readings of the
roles, shifted by one turn, cost the same to the end. The hash of the repaired text is sequential by
nature, hence a conversation is not split over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams as g

#: white space and ends of sentences (fixed values)
WHITE = " \t\n\x0b\f\r"
STOPS = ".!?"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
#: nodes after which the shared part is handed out
HELD = 1 << 12
_PRIME, _BASE = (1 << 61) - 1, 0x2545F4914F6CDD1D


class Audits:
    """Linked audits; node 0 is the empty one."""

    def __init__(self) -> None:
        self.letter, self.note, self.depth, self.code = [""], [None], [0], [0]
        self.up: list[list[int]] = [[]]  # ancestors 1, 2, 4, ... steps before

    def __len__(self) -> int:
        return len(self.letter)

    def add(self, before: int, letter: str, note=None) -> int:
        up = [before]
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        self.letter.append(letter)
        self.note.append(note)
        self.depth.append(self.depth[before] + 1)
        self.code.append((self.code[before] * _BASE + ord(letter)) % _PRIME)
        self.up.append(up)
        return len(self.letter) - 1

    def ancestor(self, node: int, steps: int) -> int:
        while steps:
            bit = steps.bit_length() - 1
            node = self.up[node][bit]
            steps -= 1 << bit
        return node

    def path(self, node: int, top: int = 0) -> list[int]:
        """Nodes after ``top`` up to ``node``, in order."""
        out = []
        while node != top:
            out.append(node)
            node = self.up[node][0]
        return out[::-1]

    def _same(self, a: int, b: int) -> bool:
        """The letters up to two nodes of one depth, as far as they are not the same nodes."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """The audit of a comes before that of b in ASCII order."""
        if a == b:
            return False
        least = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, self.depth[a] - least), self.ancestor(b, self.depth[b] - least)
        if self.code[x] == self.code[y]:
            if self._same(x, y):
                return self.depth[a] < self.depth[b]
            return self._letters(a) < self._letters(b)
        for bit in range(len(self.up[x]) - 1, -1, -1):
            if bit < len(self.up[x]) and self.code[self.up[x][bit]] != self.code[self.up[y][bit]]:
                x, y = self.up[x][bit], self.up[y][bit]
        if self._same(self.up[x][0], self.up[y][0]):
            return self.letter[x] < self.letter[y]
        return self._letters(a) < self._letters(b)

    def _letters(self, node: int) -> str:
        return "".join(self.letter[n] for n in self.path(node))

    def shared(self, nodes: list[int]) -> int:
        """The last node that is on the way to all of ``nodes``."""
        common = nodes[0]
        for other in nodes[1:]:
            least = min(self.depth[common], self.depth[other])
            x, y = (self.ancestor(n, self.depth[n] - least) for n in (common, other))
            for bit in range(len(self.up[x]) - 1, -1, -1):
                if bit < len(self.up[x]) and self.up[x][bit] != self.up[y][bit]:
                    x, y = self.up[x][bit], self.up[y][bit]
            common = x if x == y else self.up[x][0]
        return common

    def after(self, top: int, nodes: list[int]) -> tuple["Audits", list[int]]:
        """A copy that holds only what lies between ``top``, the new empty audit, and ``nodes``."""
        out, moved = Audits(), {top: 0}
        for node in nodes:
            for n in self.path(node, top) if node != top else []:
                if n not in moved:
                    moved[n] = out.add(moved[self.up[n][0]], self.letter[n], self.note[n])
        return out, [moved[n] for n in nodes]


def _next_state(state: int, initial: str) -> int | None:
    """State after a turn with this role initial, where the pattern allows it."""
    if initial == "s":
        return AFTER_S if state == NOTHING else None
    if initial == "u":
        return AFTER_U if state != AFTER_U else None
    return AFTER_A if initial == "a" and state == AFTER_U else None


class Repair:
    """One conversation, row by row; ``done(letter, note)`` is called for each final edit.

    A note is (turn, role, text) as it is after the repair, None for a deleted row.
    """

    def __init__(self, done: Callable) -> None:
        self.done, self.audits, self.most = done, Audits(), HELD
        self.best: dict[int, tuple[int, int]] = {NOTHING: (0, 0)}  # state: cost, node

    def _offer(self, best: dict, state: int, cost: int, before: int, letter: str, note) -> bool:
        old = best.get(state)
        if old is not None and old[0] < cost:
            return False
        node = self.audits.add(before, letter, note)
        if old is None or cost < old[0] or self.audits.less(node, old[1]):
            best[state] = (cost, node)
            return True
        return False

    def _insert(self) -> None:
        again = True
        while again:
            again = False
            for state, (cost, node) in list(self.best.items()):
                role, to = ("assistant", AFTER_A) if state == AFTER_U else ("user", AFTER_U)
                again |= self._offer(self.best, to, cost + INSERT, node, "I", (None, role, ""))

    def row(self, turn, role: str, text: str, gone: bool, truncated: bool) -> None:
        self._insert()
        best: dict[int, tuple[int, int]] = {}
        stays = CUT_OFF if truncated else 0
        for state, (cost, node) in self.best.items():
            self._offer(best, state, cost + DELETE, node, "D", None)
            if gone:
                continue
            to = _next_state(state, role[:1])
            if to is not None:
                self._offer(best, to, cost + KEEP + stays, node, "K", (turn, role, text))
            other, to = ("assistant", AFTER_A) if state == AFTER_U else ("user", AFTER_U)
            self._offer(best, to, cost + REROLE + stays, node, "R", (turn, other, text))
        if AFTER_A in best:
            # from there on all is possible that is from the others, at no more than this
            for state, room in ((NOTHING, DELETE), (AFTER_S, 0)):
                if state in best and best[state][0] > best[AFTER_A][0] + room:
                    del best[state]
        self.best = best
        if len(self.audits) > self.most:
            self._hand_out()

    def _hand_out(self) -> None:
        states = list(self.best)
        nodes = [self.best[s][1] for s in states]
        top = self.audits.shared(nodes)
        self._emit(top)
        self.audits, nodes = self.audits.after(top, nodes)
        self.best = {s: (self.best[s][0], n) for s, n in zip(states, nodes)}
        self.most = max(HELD, 2 * len(self.audits))

    def _emit(self, node: int) -> None:
        for n in self.audits.path(node):
            self.done(self.audits.letter[n], self.audits.note[n])

    def end(self) -> int:
        """The cost of the repair."""
        self._insert()
        ends = [self.best[s] for s in (NOTHING, AFTER_A) if s in self.best]
        cost, node = ends[0]
        for c, n in ends[1:]:
            if c < cost or (c == cost and self.audits.less(n, node)):
                cost, node = c, n
        self._emit(node)
        return cost


class Summary:
    """What is told of a conversation."""

    def __init__(self, conv_id, edits: Callable | None) -> None:
        self.conv_id, self.edits = conv_id, edits
        self.low = self.high = self.turn = self.seen = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.audit = bytearray()
        self.sha, self.first = hashlib.sha256(), True
        self.repair = Repair(self._done)

    def _done(self, letter: str, note) -> None:
        self.audit += letter.encode()
        if note is not None:
            self.sha.update((("" if self.first else "\n") + f"{note[1]}:{note[2]}").encode("utf-8", "surrogatepass"))
            self.first = False
        if self.edits is not None:
            self.edits(self.conv_id, len(self.audit), letter, note)

    def row(self, turn, role: str, text: str, repeated: bool, blank: bool, truncated: bool) -> None:
        if turn is not None and (self.turns == 0 or turn != self.high):
            self.low = turn if self.turns == 0 else self.low
            self.high = turn
            self.turns += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        duplicate = not blank and (repeated or self.seen == (turn, role, text))
        self.seen = (turn, role, text)
        truncated = truncated and not blank and not duplicate
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.repair.row(turn, role, text, blank or duplicate, truncated)

    def end(self) -> tuple:
        cost = self.repair.end()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost,
                self.audit.decode(), self.sha.hexdigest())


_SUMMARY = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
            "audit string, repaired_sha256 string")
_EDITS = "conv_id long, step long, edit string, turn long, role string, text string"


def _code() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text"))))


def ordered_rows(conversations: DataFrame) -> DataFrame:
    """The rows of each conversation in one partition, by turn, with their faults.

    Before the rows of a turn come markers (null role) with the hashes of those
    of its rows that an earlier turn holds too; so a repeat is known without a
    list of all rows before it.
    """
    text = F.col("text")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    last = F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1)
    rows = rows.withColumns({"code": _code(), "blank": last == "", "truncated": ~last.isin(*STOPS)})
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("at")  # null turns come first
    held = rows.filter(~F.col("blank")).groupBy("conv_id", "code", at).agg(F.lit(1))
    first = held.groupBy("conv_id", "code").agg(F.min("at").alias("first"), F.count("*").alias("c")).filter("c > 1").select(
        F.col("conv_id").alias("f_conv"), F.col("code").alias("f_code"), "first")
    again = held.join(first, held.conv_id.eqNullSafe(first.f_conv) & (held.code == first.f_code)).filter("at > first")
    none = F.lit(None)
    markers = again.select("conv_id", "at.turn", none.cast("string").alias("role"), none.cast("string").alias("text"), "code",
                           F.lit(False).alias("blank"), F.lit(False).alias("truncated"))
    return rows.unionByName(markers).repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", F.col("role").isNotNull(), "role", "text")


def _stream(batches, edits: Callable | None) -> Iterator[tuple | None]:
    """Summaries of the conversations of a partition, and None after each batch."""
    now, marked = None, set()
    for batch in batches:
        for conv_id, turn, role, text, code, blank, truncated in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield now.end()
                now, marked, at = Summary(conv_id, edits), set(), turn
            if turn != at:
                marked, at = set(), turn
            if role is None:
                marked.add(code)
            else:
                now.row(turn, role, text, code in marked, blank, truncated)
        yield None
    if now is not None:
        yield now.end()


def _batches(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _schema(text: str) -> pa.Schema:
    return pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in text.split(", ")])


def repair(conversations: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of each conversation.

    Needs columns conv_id, turn, role and text; others are ignored. Gives
    conv_id, gaps (missing turns), blank, duplicate, truncated (rows by their
    first fault), illegal (neighbours whose role initials are not su, ua or au),
    cost, audit and repaired_sha256 (of the repaired ``role:text`` lines).

    A null role or text is one space, null turns come first, a null conv_id is
    a conversation of its own. Rows of one turn are taken by role and text;
    equal rows of one turn are duplicates of the first. An empty role has no
    initial and stays only by a Rerole. Texts may be of any length. No rows
    give no rows.
    """
    schema = _schema(_SUMMARY)

    def run(batches):
        lot = []
        for summary in _stream(batches, None):
            if summary is not None:
                lot.append(summary)
            if len(lot) >= 1000:
                yield _batches(lot, schema)
                lot = []
        if lot:
            yield _batches(lot, schema)

    return ordered_rows(conversations).mapInArrow(g.tidy(run), _SUMMARY)


def edits(conversations: DataFrame) -> DataFrame:
    """The repaired conversations as a table of edits: conv_id, step (from 1), edit, turn, role, text.

    Deleted rows have null turn, role and text, inserted ones a null turn; the
    other rows are the repaired conversation in order. Cases as in ``repair``.
    """
    schema = _schema(_EDITS)

    def run(batches):
        lot = []

        def add(conv_id, step, letter, note):
            lot.append((conv_id, step, letter, *(note or (None, None, None))))

        def batched():
            for batch in batches:
                yield from (batch.slice(i, 500) for i in range(0, batch.num_rows, 500))

        for _ in _stream(batched(), add):
            if len(lot) >= 1000:
                yield _batches(lot, schema)
                lot.clear()
        if lot:
            yield _batches(lot, schema)

    return ordered_rows(conversations).mapInArrow(g.tidy(run), _EDITS)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of ``conversations`` with known faults.

    crc32 of ``conv_id:turn`` (nulls: one space) modulo 20 says which: 0 drops
    the row, 1 empties its text, 2 takes its ends of sentences, 3 repeats it,
    4 makes it one of the user.
    """
    def told(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), fault.alias("fault"))
    rows = rows.filter("fault <> 0").withColumns({
        "role": F.when(F.col("fault") == 4, "user").otherwise(F.col("role")),
        "text": F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))})
    twice = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(twice).alias("copy")).drop("copy")


def repaired_damage(conversations: DataFrame) -> DataFrame:
    """``repair`` of ``damaged`` rows, for every conv_id of ``conversations``; zeros where no row is left."""
    found = repair(damaged(conversations)).withColumnRenamed("conv_id", "c")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(found, ids.conv_id.eqNullSafe(found.c), "left").select(
        "conv_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
