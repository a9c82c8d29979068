"""Operators 1, 4, 5 and 6 against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import numpy as np

from pageloom.llm import grams, line_templates, ngram_jaccard, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    """Texts with copies, near copies and shared passages."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(1, 6))) for _ in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(5, 160))] for _ in range(n // 3)]
    out = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 3, 9])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        if r.random() < 0.3:
            words += base[0][:45]
        out.append((i, " ".join(words) + r.choice(["", "\n", " \t x"])))
    return out


def jaccard(rows, size, percent):
    sets = {}
    for i, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = WORD.findall(text)
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_jaccard_equals_all_pairs(make, size, percent):
    rows = corpus(3, 90)
    rows += [(100, "A b"), (101, "a B"), (102, "x"), (103, ""), (104, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard(make(rows), size, percent).collect()}
    assert got == jaccard(rows, size, percent)


def test_jaccard_large_group_of_near_copies(make, monkeypatch):
    """Members that link with some others only, both ways of verifying."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(words)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(60)] = f"v{r.random()}"
        rows.append((i, " ".join(w)))
    want = jaccard(rows, 4, 85)
    assert len({c for _, c in want.values()}) > 1
    for bound in (ngram_jaccard.SENT_ROWS, 0):
        monkeypatch.setattr(ngram_jaccard, "SENT_ROWS", bound)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_jaccard.ngram_jaccard(make(rows), 4, 85).collect()}
        assert got == want


def test_one_of_each_keeps_smallest(make):
    rows = [(9, "a b c d e f g h"), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (4, "x y z"), (5, None)]
    assert sorted(r.doc_id for r in ngram_jaccard.one_of_each(make(rows)).collect()) == [3, 4, 5]


def test_jaccard_odd_rows(odd, none):
    out = ngram_jaccard.ngram_jaccard(odd)
    assert out.count() == odd.count()
    assert ngram_jaccard.ngram_jaccard(none).count() == 0
    by = defaultdict(set)
    for r in out.collect():
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[None] == {(1, 5)}


def words_removed(rows, length):
    seen = Counter()
    lists = [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in lists:
        seen.update(tuple(w[j : j + length]) for j in range(len(w) - length + 1))
    out = []
    for i, w in lists:
        gone = set()
        for j in range(len(w) - length + 1):
            if seen[tuple(w[j : j + length])] > 1:
                gone.update(range(j, j + length))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,seed", [(35, 5), (12, 3), (4, 4)])
def test_substrings_equal_all_windows(make, length, seed):
    rows = corpus(7) + [(200, " ".join(["same"] * 90)), (201, None)]
    out = substring_dedup.substring_dedup(make(rows), length, seed).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in out], key=str) == words_removed(rows, length)
    assert all(sum(s.last - s.first + 1 for s in r.spans) == r.n_removed for r in out)


def test_substrings_odd_rows(odd, none):
    out = substring_dedup.substring_dedup(odd, 3, 2)
    want = words_removed([(r.doc_id, r.text) for r in odd.collect()], 3)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()], key=str) == want
    assert substring_dedup.substring_dedup(none).count() == 0


def bytes_removed(rows, length):
    first = {}
    rank = {i: (1 << 63) - 1 if i is None else i for i, _ in rows}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - length + 1):
            s = b[j : j + length]
            first[s] = min(first.get(s, 1 << 64), rank[i])
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < rank[i]:
                gone[j : j + length] = [True] * length
        out.append((i, len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,seed", [(50, 20), (20, 8)])
def test_suffixes_equal_all_strings(make, monkeypatch, length, seed):
    rows = corpus(11) + [(200, "ab" * 100), (201, "ab" * 90), (202, None), (203, "")]
    want = bytes_removed(rows, length)
    for lot in (suffix_dedup.LOT, 500):
        monkeypatch.setattr(suffix_dedup, "LOT", lot)
        out = suffix_dedup.suffix_dedup(make(rows), length, seed).collect()
        assert sorted([(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in out], key=str) == want


def test_suffixes_odd_rows(odd, none):
    rows = odd.filter("length(text) < 1000 OR text IS NULL")
    out = suffix_dedup.suffix_dedup(odd, 10, 8).filter("n_bytes < 1000")
    # the long text shares nothing with the others
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in out.collect()], key=str) == bytes_removed(
        [(r.doc_id, r.text) for r in rows.collect()], 10)
    assert suffix_dedup.suffix_dedup(none).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_suffixes_of_several_rows_without_id(spark, parts):
    """Two null doc_ids in one lot lose what a numbered row holds, wherever that row lies."""
    shared = "a passage that three of the texts hold, of more than fifty bytes"
    rows = [(None, "first " + shared), (None, "second one " + shared + "."), (7, shared + " and more"), (8, "nothing in common")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
    out = suffix_dedup.suffix_dedup(df, 50, 20).collect()
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in out], key=str)
    assert got == bytes_removed(rows, 50) and sum(r.n_removed for r in out) > 2 * 50


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text("ab", min_size=20, max_size=300), st.integers(9, 24))
def test_classes_are_equal_strings(text, length):
    body = np.frombuffer(text.encode() + b"\xff", np.uint8)
    number = suffix_dedup.classes(body, length)
    seen = {}
    for i in range(len(text) - length + 1):
        seen.setdefault(text[i : i + length], set()).add(int(number[i]))
    assert all(len(v) == 1 for v in seen.values())
    assert len({next(iter(v)) for v in seen.values()}) == len(seen)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab \n\té", max_size=12), max_size=6))
def test_words_of_texts(rows):
    import pyarrow as pa

    data, at = grams.texts(pa.array(rows, pa.string()))
    starts, ends, first = grams.word_spans(data, at)
    body = data.tobytes()
    for r, text in enumerate(rows):
        got = [body[a:b].decode() for a, b in zip(starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]])]
        assert got == WORD.findall(text)


def template_keys(line):
    w = ["<>" if re.search("[0-9]", x) else x for x in WORD.findall(line)]
    out = [(len(w), 0, tuple(w))] if len(w) >= 3 else []
    if len(w) >= 8:
        out += [(len(w), j + 1, tuple(w[:2]), tuple(x if i % 4 != j else None for i, x in enumerate(w))) for j in range(4)]
    return out


def lines_left(rows, least):
    held = defaultdict(dict)
    rank = lambda i: (1 << 63) - 1 if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            for k in template_keys(line):
                held[k][t] = min(held[k].get(t, 1 << 64), rank(i))
    first = {k: min(v.values()) for k, v in held.items() if len(v) >= least}
    out = []
    for i, t in rows:
        lines = [x for x in (t or "").split("\n") if not any(k in first and first[k] != rank(i) for k in template_keys(x))]
        out.append((i, None if t is None else "\n".join(lines), len((t or "").split("\n")) - len(lines)))
    return sorted(out, key=str)


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_lines_equal_brute_force(make, monkeypatch, sent):
    monkeypatch.setattr(line_templates, "SENT_TEMPLATES", sent)
    r = random.Random(2)
    rows = []
    for i in range(60):
        lines = [f"page {r.randint(1, 99)} of 7", "own words " + " ".join(str(r.random()) + "x" for _ in range(3)) + "é" * i]
        lines.append(f"dear {r.choice('abc')} we thank you for the visit of today")
        if i % 2:
            lines.append("short line")
        r.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(70, None), (71, ""), (72, "\n\n")]
    out = line_templates.line_dedup(make(rows), 10).collect()
    got = sorted([(x.doc_id, x.text, x.lines_removed) for x in out], key=str)
    assert got == lines_left(rows, 10)
    assert any(n for _, _, n in got)


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_short_lines_of_the_query(spark, tmp_path, monkeypatch, sent):
    """Lines of one and two tokens go by the same count of texts; their digits are no fields."""
    from pageloom.llm import queries

    monkeypatch.setattr(line_templates, "SENT_TEMPLATES", sent)
    rows = [(i, f"Les.\nRead more\n{i}\nown{'x' * i} line\n\n \nPage {i}") for i in range(12)]
    rows += [(20 + i, f"Few\nmine{'y' * i}") for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.lines_removed for r in queries.QUERIES["op6_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {i: 0 if i in (0, *range(20, 29)) else 2 for i, _ in rows}


def test_lines_odd_rows(odd, none):
    out = line_templates.line_dedup(odd, 2)
    assert set(out.columns) == {*odd.columns, "lines_removed"}
    want = lines_left([(r.doc_id, r.text) for r in odd.collect()], 2)
    assert sorted([(x.doc_id, x.text, x.lines_removed) for x in out.collect()], key=str) == want
    assert line_templates.line_dedup(none).count() == 0
