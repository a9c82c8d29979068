"""Operators 2, 3, 7, 8, 9 and 10 and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pageloom.llm import packing, piece_model, quality_rules, queries, secret_scan, toxicity, va_search

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["Hello  world", " leading", "trailing ", "a\nb\tc   d", "é ß \U0001f600 ▁ mark", "<s> </s> <unk> <0x41>", "x" * 700, "", None,
         "Ünïcödé — “quotes” İstanbul ŉ ﬁ", "it's 1234 i've <|endoftext|> it", "    ", "．。!?... end. Next! Why?"]


# ---- 2: pieces

def test_pieces_equal_sentencepiece(make):
    theirs = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = list(enumerate(TEXTS)) + [(100, " ".join(t or "" for t in TEXTS) * 3)]
    got = {r.doc_id: r for r in piece_model.encode(make(rows), PIECES).collect()}
    for i, text in rows:
        ids = theirs.encode(text or "")
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].n_ids == len(ids) and got[i].parity, text


def test_pieces_are_restored(make):
    rows = [(i, t) for i, t in enumerate(TEXTS) if t and "▁" not in t]
    back = piece_model.decode(piece_model.encode(make(rows), PIECES), PIECES)
    assert {r.doc_id: r.text for r in back.collect()} == dict(rows)
    assert all(r.restored for r in piece_model.round_trip(make(rows), PIECES).collect())


def test_decoder_equals_the_libraries():
    model = piece_model.read_model(PIECES)
    decoder, tokenizer = piece_model.Decoder(model), piece_model.build(model)
    theirs = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in TEXTS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert decoder.text(np.array(ids, np.int64)) == tokenizer.decode(ids) == theirs.decode(ids)


def test_unigram_models_are_rebuilt(tmp_path):
    """A small unigram model with byte fallback, written by its protobuf fields."""
    import struct

    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    def sized(number, body):
        return varint(number << 3 | 2) + varint(len(body)) + body

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
    pieces += [("▁", -3.0, 1), ("a", -2.5, 1), ("b", -2.6, 1), ("ab", -3.1, 1), ("▁ab", -4.0, 1), ("ba", -3.9, 1), ("▁a", -4.4, 1)]
    body = b"".join(sized(1, sized(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k))
                    for p, s, k in pieces)
    body += sized(2, varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1))
    body += sized(3, sized(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1))
    path = tmp_path / "small.model"
    path.write_bytes(body)
    theirs = sentencepiece.SentencePieceProcessor(model_file=str(path))
    ours = piece_model.build(piece_model.read_model(str(path)))
    for text in ("ab ba", "aabbab a", "xab é", "b  a"):
        assert ours.encode(text, add_special_tokens=False).ids == theirs.encode(text), text


def test_pieces_odd_rows(odd, none):
    assert piece_model.encode(odd, PIECES).count() == odd.count()
    assert piece_model.encode(none, PIECES).count() == 0


# ---- 3: packing

def check_packed(rows, pieces, window):
    tokenizer = Tokenizer.from_file(WORDS)
    want = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,) for _, t in rows)
    sequences, texts = Counter(), {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sequences[p.sequence_id] and 0 < p.length == len(p.ids) // 4
        sequences[p.sequence_id] += p.length
        if p.start == 0:
            texts.setdefault((p.sequence_id, p.offset), [])
    assert max(sequences.values(), default=0) <= window
    assert sum(sequences.values()) == sum(map(len, want))
    # pieces of a document follow each other in the order of sequences
    got, now = [], []
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.start == len(now)
        now += np.frombuffer(p.ids, "<u4").tolist()
        if len(now) == p.doc_tokens:
            got.append(tuple(now))
            now = []
    assert sorted(got) == want and not now
    return sequences


@pytest.mark.parametrize("window,horizon", [(64, 1 << 20), (64, 300), (2048, 1 << 20)])
def test_packing_is_whole(make, monkeypatch, window, horizon):
    monkeypatch.setattr(packing, "HORIZON", horizon)
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["the", "cat", "sat.", "on!", "mats", "thhaornt,"]) for _ in range(r.randint(0, 90)))) for i in range(80)]
    rows += [(200 + i, t) for i, t in enumerate(TEXTS)]
    pieces = packing.pack(make(rows, 3), WORDS, window).collect()
    sequences = check_packed(rows, pieces, window)
    assert sum(window - n for n in sequences.values()) < 0.1 * sum(sequences.values()) + 3 * window


def test_cuts_are_the_cheapest():
    r = random.Random(8)
    for _ in range(60):
        window = r.randint(4, 12)
        places = np.cumsum([r.randint(1, 4) for _ in range(r.randint(1, 14))])
        penalties = np.array([r.choice([0, 1, 3]) for _ in places])
        best = {0: 0}
        for j, p in enumerate(places.tolist()):
            best[p] = min(best[q] + window - (p - q) for q in best if p - q <= window) + int(penalties[j])
        cuts = [0, *packing.best_cuts(places, penalties, window, True)]
        cost = {int(p): int(c) for p, c in zip(places, penalties)}
        assert cuts[-1] == places[-1]
        assert sum(window - (b - a) + cost[b] for a, b in zip(cuts, cuts[1:])) == best[int(places[-1])]


def test_packing_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check_packed(rows, packing.pack(odd, WORDS).collect(), 2048)
    assert packing.pack(none, WORDS).count() == 0


# ---- 7: quality rules

def base(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit),
            len(w) < 10 or 100 * len(hit) > 20 * len(w))


def test_measures_equal_brute_force(make):
    r = random.Random(4)
    rows = [(i, "".join(r.choice(["a ", "b ", "cc\n", "d#", "\n", "é ", "|<> ", "x\ty\x0b"]) for _ in range(r.randint(0, 80)))) for i in range(80)]
    rows += [(100, "one two three four five " * 9), (101, None)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {x.doc_id: tuple(x[n] for n in names) for x in quality_rules.quality_rules(make(rows)).collect()}
    assert got == {i: base(t) for i, t in rows}


def test_clean_documents_stay_and_junk_goes(spark, make, monkeypatch):
    r = random.Random(9)
    word = lambda: "".join(r.choices("etaoinshr", k=r.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(r.randint(30, 200)))) for i in range(150)]
    rows += [(500 + i, " ".join(word() + r.choice(["###", "%%%", "&&&"]) for _ in range(60))) for i in range(5)]
    for groups in (quality_rules.SENT_GROUPS, 0):
        monkeypatch.setattr(quality_rules, "SENT_GROUPS", groups)
        got = {x.doc_id: x.kept for x in quality_rules.quality_rules(make(rows)).collect()}
        assert all(got[i] == (i < 500) for i, _ in rows)
    assert {x.doc_id for x in quality_rules.kept_documents(make(rows)).collect()} == {i for i, _ in rows if i < 500}


def test_quality_odd_rows(odd, none):
    rows = odd.withColumn("lang", F.when(F.col("doc_id") > 3, F.col("lang")))
    out = quality_rules.quality_rules(rows).collect()
    assert len(out) == odd.count() and all(r.kept is not None for r in out)
    assert quality_rules.kept_documents(odd).columns == odd.columns
    assert quality_rules.quality_rules(none).count() == 0


# ---- 8: search

@pytest.mark.parametrize("block,ahead", [(1024, 4), (3, 1)])
def test_search_equals_all_scores(spark, monkeypatch, block, ahead):
    monkeypatch.setattr(va_search, "BLOCK", block)
    monkeypatch.setattr(va_search, "AHEAD", ahead)
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).round(2).tolist()) for i in range(120)] + [(200 + i, [0.5] * 6) for i in range(30)]
    odd = [(300, None), (301, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, []), (305, [1.0, 2.0]),
           (None, [1.0] * 6), (306, [3e30, 1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    got = sorted(tuple(x) for x in va_search.top_k(df, df.filter("vec_id % 10 = 0"), 5).collect())
    whole = {i: [int(np.floor(256.0 * float(np.float32(x)))) for x in v] for i, v in rows + odd
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q, a in whole.items():
        if q % 10 == 0:
            scores = sorted((-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i)
                            for i, b in whole.items() if i != q and len(a) == len(b))
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])]
    assert got == sorted(want)
    assert va_search.top_k(df.limit(0), df.limit(0)).count() == 0


# ---- 9: toxicity

def test_toxicity_on_held_out_documents(spark, small_dir):
    docs = queries.documents(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = queries.QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.01")
    assert out.count() == docs.count()
    hit = out.join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert hit > 0.9
    for r in out.select("doc_id", "held_out").limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_marginals_equal_all_labellings():
    r = np.random.default_rng(2)
    begin, n = np.array([0, 4, 5]), 9
    score, links = r.normal(size=n), r.normal(size=(2, 2))
    forward, backward = toxicity.Chains(begin, n).marginals(score, links)
    odds = forward * backward
    for a, b in zip(begin, [4, 5, 9]):
        size, total = b - a, np.zeros((b - a, 2))
        for m in range(1 << size):
            y = [m >> i & 1 for i in range(size)]
            z = sum(score[a + i] * y[i] for i in range(size)) + sum(links[y[i], y[i + 1]] for i in range(size - 1))
            for i in range(size):
                total[i, y[i]] += np.exp(z)
        assert np.allclose(odds[a:b] / (1 + odds[a:b]), total[:, 1] / total.sum(axis=1))


def test_toxic_spans_and_odd_rows(make, spark, odd, none):
    r = random.Random(6)
    plain = ["the", "house", "was", "nice", "and", "blue", "we", "went", "home", "é"]
    texts = [" ".join(r.choice(plain) + r.choice(["", "", "."]) for _ in range(30)) for _ in range(120)]
    toxic = np.array([i % 3 == 0 for i in range(120)], int)
    for i in np.flatnonzero(toxic):
        texts[i] = texts[i].replace("home", "Grobbly" + r.choice(["x", "yz"]), 2)
    model = toxicity.train(texts, toxic)
    got = toxicity.score(make([(1, "é the Grobblyx house."), (2, "the house was nice")]), model).collect()
    by = {x.doc_id: x for x in got}
    assert by[1].score > 0.5 > by[2].score and not by[2].spans
    assert [("é the Grobblyx house."[s.first : s.end]) for s in by[1].spans] == ["Grobblyx"]
    out = toxicity.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= x.score <= 1 for x in out)
    assert toxicity.score(none, model).count() == 0
    nothing = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= x.score <= 1 for x in toxicity.score(odd, nothing).collect())


# ---- 10: secrets

def test_secrets_are_told_from_look_alikes(make):
    r = random.Random(5)
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    rows, want = [], set()
    for i in range(120):
        text = "some plain words about the weather and the sea "
        if i % 3 == 0:
            s = hexes(40)
            want.add((i, s))
            text += f'token = "{s}" and more words'
        elif i % 3 == 1:
            text += "".join(r.choices("0123456789", k=16)) + f" see https://example.com/files/{hexes(20)}/index.html there"
        rows.append((i, text))
    docs = make(rows)
    found = secret_scan.secret_scan(docs)
    got = found.collect()
    assert {(x.doc_id, x.candidate) for x in got if x.is_secret} == want
    assert sum(not x.is_secret for x in got) >= 80
    known = found.select("doc_id", "position", "nth", F.col("is_secret").cast("int").alias("label"))
    again = secret_scan.secret_scan(docs, known).collect()
    assert {(x.doc_id, x.candidate) for x in again if x.is_secret} == want
    out = {x.doc_id: x for x in secret_scan.redacted(docs, found).collect()}
    assert len(out) == 120 and all(s not in out[i].text and secret_scan.REDACTED in out[i].text for i, s in want)
    assert all(out[i].text == t for i, t in rows if i % 3) and all(x.n_chars == len(x.text) for x in out.values())


def test_nothing_is_left_of_a_secret_within_another(spark):
    """One secret is the head, the tail or the middle of another one, or of a run that is none."""
    a = "Zk3Jq8Lm2Xv7Tn5Rw"
    texts = [f"token={a} key={a}ZZ99 end", f"x {a}ZZ99 y", f"(00{a}) {a}. 00{a}11", f"path/{a} stays, {a} goes", "none", None,
             "regex =a+b/c_d-e=0123456789\\E$1 here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_secrets", F.lit("kept"))
    k = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"))
    secrets = [a, a + "ZZ99", "00" + a, "00" + a + "11", "=a+b/c_d-e=0123456789"]
    found = k.crossJoin(spark.createDataFrame([(s, True) for s in secrets], "candidate string, is_secret boolean"))
    out = {r.doc_id: r.text for r in secret_scan.redacted(docs, found).collect()}
    hidden = secret_scan.REDACTED
    assert out == {0: f"token={a} key={a}ZZ99 end", 1: f"x {hidden} y", 2: f"({hidden}) {hidden}. {hidden}",
                   3: f"path/{a} stays, {hidden} goes", 4: "none", 5: None, 6: f"regex {hidden}\\E$1 here"}
    assert secret_scan.redacted(docs, found).columns == docs.columns


def test_secrets_odd_rows(odd, none):
    found = secret_scan.secret_scan(odd)
    assert found.filter("is_secret").count() == 0
    assert secret_scan.redacted(odd, found).count() == odd.count()
    assert secret_scan.secret_scan(none).count() == 0


# ---- pipeline

def test_pipeline_stages(spark, small_dir):
    import corpus_pipeline
    from pageloom.session import materialize

    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    start = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, small_dir), "t")
        if name != "packing":
            assert out.columns == docs.columns
            kept[name] = {r.doc_id: r.text for r in out.collect()}
        docs = out
    assert set(kept["quality rules"]) < set(start)
    assert all(start[i] == t for i, t in kept["quality rules"].items())
    assert set(kept["n-gram Jaccard join"]) <= set(kept["line dedup"]) <= set(kept["quality rules"])
    last = kept["secret scans"]
    assert set(last) == set(kept["n-gram Jaccard join"])
    assert not any(re.search(r'token = "[0-9a-f]{40}"', t) for t in last.values())
    check_packed(list(last.items()), docs.collect(), 2048)


def test_pipeline_on_odd_rows(spark, odd):
    """Nulls, empty and very long texts, repeated rows and clashing names go through every stage."""
    import corpus_pipeline
    from pageloom.session import materialize

    docs = odd.withColumns({"lang": F.when(F.col("doc_id") > 4, F.col("lang")), "source": F.when(F.col("doc_id") < 6, F.col("source"))})
    plain = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    docs = docs.unionByName(docs.filter("doc_id = 7").withColumns({"doc_id": F.lit(9).cast("long"), "text": F.lit(plain)}))
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, ""), "odd")
        if name != "packing":
            assert out.columns == odd.columns
            assert out.filter("k <> 'clash'").isEmpty()
        docs = out
    # the others have fewer than ten words, or repeat most of them
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {9}


def test_pipeline_on_empty_tables(spark, none):
    import corpus_pipeline

    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLES])
def test_queries_equal_their_sql(spark, small_dir, name):
    from oracle_check import compare, duck

    problem, rows = compare(spark, duck(small_dir), queries.QUERIES[name], queries.ORACLES[name], small_dir)
    assert problem is None and rows, problem
