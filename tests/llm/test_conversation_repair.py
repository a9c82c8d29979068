"""Operator 12 against brute force."""

import hashlib
import heapq
import itertools
import random
import re

import pytest

from pageloom.llm import conversation_repair as m

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """rows: (turn, role, text) in order; first fault of each."""
    seen, out = set(), []
    for turn, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(rows):
    """All edit sequences in order of cost and audit, without any state of the pattern."""
    marks = faults(rows)
    most = 2 * len(rows) + 1
    heap, best = [(0, "", 0, "", ())], None
    while heap:
        cost, audit, i, initials, lines = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if i == len(rows) and PATTERN.fullmatch(initials):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
        if cost + 5 <= most:
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 5, audit + "I", i, initials + role[0], (*lines, f"{role}:")))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, initials, lines))
        if marks[i] in ("", "truncated"):
            stays = 5 * (marks[i] == "truncated")
            if role:
                heapq.heappush(heap, (cost + stays, audit + "K", i + 1, initials + role[0], (*lines, f"{role}:{text}")))
            for other in ("user", "assistant"):
                heapq.heappush(heap, (cost + stays + 1, audit + "R", i + 1, initials + other[0], (*lines, f"{other}:{text}")))
    return best


def brute(rows):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = {}
    for conv, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        own = sorted((r[1:] for r in own), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marks = faults(own)
        turns = {r[0] for r in own if r[0] is not None}
        cost, audit, lines = cheapest(own)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(k) for k in ("blank", "duplicate", "truncated")),
                     illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, n=60, length=6):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, length)):
            rows.append((conv, r.choice([turn, turn, turn, turn + 1, None]), r.choice(["user", "assistant", "system", "user", "tool", None]),
                         r.choice(["Yes.", "no", "Why?", "", " \t", "é!", "x. \n", None, "long " * 30 + "."])))
    return rows + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."), (99, None, "", "Empty role.")]


def collected(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_edit_sequences(spark, seed):
    rows = conversations(seed)
    assert collected(m.repair(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def direct(rows, held):
    """Rows of one conversation through the program, without Spark."""
    edits = []
    repair = m.Repair(lambda letter, note: edits.append((letter, note)))
    repair.most = held
    for (turn, role, text), fault in zip(rows, faults(rows)):
        repair.row(turn, role, text, fault in ("blank", "duplicate"), fault == "truncated")
        repair.most = min(repair.most, held)
    return repair.end(), "".join(e for e, _ in edits), tuple(f"{n[1]}:{n[2]}" for _, n in edits if n)


@pytest.mark.parametrize("held", [3, 1 << 12])
def test_handing_out_early_changes_nothing(held):
    r = random.Random(9)
    for _ in range(150):
        rows = [(t, r.choice("usat"), r.choice(["a.", "b", "c.", "d.", "", "e?"])) for t in range(r.randint(0, 7))]
        assert direct(rows, held) == cheapest(rows)


def test_ties_after_equal_hashes(monkeypatch):
    """With a hash that says nothing, the letters decide."""
    monkeypatch.setattr(m, "_BASE", 0)
    monkeypatch.setattr(m, "_PRIME", 1)
    test_handing_out_early_changes_nothing(1 << 12)


def test_a_long_conversation_is_held_in_part(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(30_000)]
    rows += [(1, t, "user", f"turn {t}.") for t in range(0, 30_000, 300)]
    got = collected(m.repair(spark.createDataFrame(rows, SCHEMA)))[1]
    assert got[2] == 100 and got[5] == 200 and len(got[6]) == 30_100 and got[6].count("D") == 100
    repair = m.Repair(lambda *_: None)
    for t in range(100_000):
        repair.row(t, "user" if t % 2 == 0 or t % 10 == 5 else "assistant", f"{t}.", False, False)
    assert len(repair.audits) <= 2 * m.HELD


def test_edits_are_the_repaired_rows(spark):
    rows = conversations(4)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    by = {}
    for r in sorted(m.edits(df).collect(), key=lambda r: r.step):
        by.setdefault(r.conv_id, []).append(r)
    assert {c: "".join(r.edit for r in e) for c, e in by.items()} == {c: w[6] for c, w in want.items() if w[6]}
    for c, e in by.items():
        lines = [f"{r.role}:{r.text}" for r in e if r.edit != "D"]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want[c][7]


def test_every_conversation_is_told(spark):
    """Also those of which damage leaves nothing; clashing names and repeated rows do no harm."""
    df = spark.createDataFrame([(c, t, "user", "A.") for c in [*range(60), None] for t in ((0,) if c else (0, 1, 1))], SCHEMA)
    for name in ("code", "at", "first", "fault", "copy", "c", "audit"):
        df = df.withColumn(name, df.role)
    got = collected(m.repaired_damage(df))
    assert set(got) == {*range(60), None}
    left = {r.conv_id for r in m.damaged(df).collect()}
    gone = [c for c in got if c not in left]
    assert gone and all(got[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone)
    assert m.repaired_damage(df.limit(0)).count() == 0 and m.edits(df.limit(0)).count() == 0
