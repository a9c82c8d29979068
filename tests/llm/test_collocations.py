"""Operator 13 against brute force."""

import random
import re
from collections import Counter

import pytest

from pageloom.llm import collocations


def brute(rows, support, longest, first, percent):
    """rows: (text, lang)."""
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        longer = Counter()
        for q, b in cand.items():
            for i in range(len(q)):
                for j in range(i + 2, len(q) + 1):
                    if j - i < len(q):
                        longer[q[i:j]] = max(longer[q[i:j]], b)
        found = []
        for p, a in cand.items():
            score, _, left, right = min(
                (10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if 100 * longer.get(p, -1) < percent * a:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:first]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = ["a", "B", "c", "dé", "É", "f\x0bg", "h\x00", "x y"]
    rows = []
    for _ in range(n):
        words = [r.choice(vocabulary) + r.choice(["", "", "", ".", ", ", "\n", "!?"]) for _ in range(r.randint(0, 40))]
        rows.append((r.choice([" ", "  ", "\t"]).join(words), r.choice(["en", "en", "und", None, "ä"])))
    return rows + [(None, "en"), ("", None), (" .,", "only")]


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows, parts=5: spark.createDataFrame(rows, "text string, lang string").repartition(parts)


@pytest.mark.parametrize("shards,longest,percent", [(4, 3, 50), (1, 3, 50), (7, 4, 30)])
def test_equals_brute_force(table, shards, longest, percent):
    rows = corpus(shards)
    got = collocations.collocations(table(rows), 10, longest, 25, percent, shards)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10, longest, 25, percent)


def test_no_phrase_is_lost_over_many_tasks_and_lots(table, monkeypatch):
    """A phrase that every task holds once or twice only, and a map of few bits."""
    monkeypatch.setattr(collocations, "GATHERED", 50)
    monkeypatch.setattr(collocations, "HELD", 20)
    rows = [(f"left{i} new york right{i}", "en") for i in range(23)] + corpus(5, 40)
    df = table(rows, 16)
    got = collocations.collocations(df, 10, 3, 2000)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10, 3, 2000, 50)
    few = collocations.frequent_phrases(df, bits=1 << 16).filter("size > 1")
    assert ("new york", 23) in {(r.phrase, r.f) for r in few.collect()}


def test_scores_are_exact(spark):
    """Products far above 64 bits."""
    n = 900_000_000_000_000
    rows = [("en", "a b", 2, n - 1), ("en", "a", 1, n + 7), ("en", "b", 1, n + 13), ("en", "c d", 2, 3), ("en", "c", 1, 4), ("en", "d", 1, 3)]
    got = {r.phrase: r.score for r in collocations.scored(
        spark.createDataFrame(rows, "lang string, phrase string, size long, f long")).collect()}
    assert got == {"a b": 10**6 * (n - 1) ** 2 // ((n + 7) * (n + 13)), "c d": 10**6 * 9 // 12}


def test_odd_rows(odd, none):
    got = collocations.collocations(odd.drop("lang").withColumn("lang", odd["source"]), 2, 3, 2000)
    want = brute([(r.text, r.source) for r in odd.collect()], 2, 3, 2000, 50)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert collocations.collocations(none).count() == 0
