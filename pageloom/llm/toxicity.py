"""Toxic spans and document scores from a linear-chain CRF (operator 9).

Tokens are runs of letters and digits, chains are sentences, labels are 0 and 1
(toxic). A token's features are its lower-case form and its first bytes, hashed
into tables of weights; a 2 x 2 table weighs neighbouring labels. Forward and
backward passes give each token's marginal probability of being toxic. A
document's score is a logistic function of what its marginals add up to; tokens
above one half are its offending spans.

Training reads a bounded sample of labelled documents. Only documents are
labelled, so tokens take their labels from them: in a toxic document, tokens
with a form or beginning that many different toxic documents of the sample
hold and clean ones do not. Near copies within the sample count once, else
every word of a copied document would look toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams as g

#: first bytes of a token that are features besides its whole form
BEGINNINGS = (4, 5, 6)
BITS = 18
#: a form must be in so many toxic documents of the sample (at least so large a
#: share of them), and its share of their tokens so many times that of clean ones
SUPPORT = 4
SHARE = 0.02
ODDS = 12.0
STEPS = 40

WORDY = np.zeros(256, bool)
WORDY[48:58] = WORDY[65:91] = WORDY[97:123] = WORDY[128:] = True
STOP = np.zeros(256, bool)
STOP[[10, 33, 46, 63]] = True  # line end ! . ?


@dataclass
class Crf:
    weights: np.ndarray  # by kind of feature and bucket
    links: np.ndarray  # log weight of label j after label i
    doc: np.ndarray  # logistic weights of ``doc_terms``


def tokens(data: np.ndarray, at: np.ndarray):
    """First byte and end of tokens, tokens before each text, and where chains begin."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64), none
    word = WORDY[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    filled = at[:-1] < at[1:]
    before[at[:-1][filled]] = False
    after[at[1:][filled] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    first = np.searchsorted(starts, at)
    stops = np.concatenate([[0], np.cumsum(STOP[data])])
    new = np.ones(len(starts), bool)
    new[1:] = stops[starts[1:]] > stops[ends[:-1]]
    new[first[:-1][first[:-1] < len(starts)]] = True
    return starts, ends, first, np.flatnonzero(new)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit features of tokens: whole form, then beginnings (0 where a token is shorter)."""
    lower = g.LOWER[data]
    out = [g.word_codes(lower, starts, ends)]
    for n in BEGINNINGS:
        codes = g.word_codes(lower, starts, np.minimum(ends, starts + n))
        out.append(np.where(ends - starts > n, g.mix(codes + np.uint64(n)), np.uint64(0)))
    return np.array(out)


def buckets(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - BITS)).astype(np.int64)


def emissions(crf_weights: np.ndarray, found: np.ndarray) -> np.ndarray:
    where = buckets(found)
    return sum(np.where(found[k] != 0, crf_weights[k][where[k]], 0) for k in range(len(found)))


class Chains:
    """Chains by falling length, so that at each step the live ones are the first."""

    def __init__(self, begin: np.ndarray, n: int) -> None:
        length = np.diff(np.append(begin, n))
        order = np.argsort(-length, kind="stable")
        self.begin, self.length = begin[order], length[order]
        self.steps = int(self.length[0]) if len(length) else 0
        self.live = np.searchsorted(-self.length, -np.arange(self.steps), "left")

    def marginals(self, score: np.ndarray, links: np.ndarray):
        """log odds of label 1 before (forward) and after (backward) each token."""
        t = np.exp(np.clip(links, -30, 30))
        e = np.exp(np.clip(score, -30, 30))
        forward, backward = np.zeros(len(score)), np.ones(len(score))
        r = np.zeros(0)
        for step in range(self.steps):
            at = self.begin[: self.live[step]] + step
            if step == 0:
                r = e[at]
            else:
                r = r[: len(at)]
                r = e[at] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
            r = np.clip(r, 1e-30, 1e30)
            forward[at] = r
        b = np.zeros(0)
        for step in range(self.steps - 2, -1, -1):
            n = int(self.live[step + 1])
            at = self.begin[:n] + step
            later = np.ones(n)
            later[: len(b)] = b
            x = e[at + 1] * later
            b = np.clip((t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x), 1e-30, 1e30)
            backward[at] = b
        return forward, backward


def token_scores(crf: Crf, found: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Marginal probability of label 1 for each token."""
    if not found.shape[1]:
        return np.zeros(0)
    forward, backward = Chains(begin, found.shape[1]).marginals(emissions(crf.weights, found), crf.links)
    odds = forward * backward
    return odds / (1 + odds)


def doc_terms(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Constant, sum of marginals and their sum for 200 tokens (as logarithms), and the largest one."""
    rows = len(first) - 1
    text = np.repeat(np.arange(rows), np.diff(first))
    total = np.bincount(text, p, rows)
    most = np.zeros(rows)
    np.maximum.at(most, text, p)
    rate = 200 * total / np.maximum(np.diff(first), 20)
    return np.stack([np.ones(rows), np.log1p(total), np.log1p(rate), most], axis=1)


def _distinct_texts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Texts that are no near copy of an earlier one: no smallest hash of word windows in common."""
    keep, seen = np.ones(len(first) - 1, bool), [set() for _ in range(3)]
    win = g.windows(codes, 5)
    for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        w = win[a : max(a, b - 4)]
        if not len(w):
            continue
        least = [int(g.mix(w + np.uint64(s)).min()) for s in (11, 22, 33)]
        keep[r] = not any(x in s for x, s in zip(least, seen))
        for x, s in zip(least, seen):
            s.add(x)
    return keep


def train(texts: list[str], toxic: np.ndarray) -> Crf:
    """The model of a sample of texts with labels."""
    data, at = g.texts(pa.array(texts, pa.large_string()))
    starts, ends, first, begin = tokens(data, at)
    found = features(data, starts, ends)
    crf = Crf(np.zeros((len(BEGINNINGS) + 1, 1 << BITS)), np.zeros((2, 2)), np.array([-2.0, 0.0, 0.0, 0.0]))
    n = found.shape[1]
    if not n or toxic.min() == toxic.max():
        rate = (toxic.sum() + 0.5) / (len(toxic) + 1)
        crf.doc = np.array([np.log(rate / (1 - rate)), 0.0, 0.0, 0.0])
        return crf
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    once = _distinct_texts(found[0], first)
    rows = [int((once & (toxic == y)).sum()) for y in (0, 1)]
    label = np.zeros(n, bool)
    fine = once[text]
    sizes = [int((fine & (toxic[text] == y)).sum()) for y in (0, 1)]
    for row in found:
        forms, which = np.unique(row, return_inverse=True)
        bad = np.bincount(which, fine & (toxic[text] == 1), len(forms)) + 0.1
        good = np.bincount(which, fine & (toxic[text] == 0), len(forms)) + 0.1
        codes, owner = _pairs(which, text)
        held = np.bincount(codes, once[owner] & (toxic[owner] == 1), len(forms))
        odds = (bad / (sizes[1] + 1)) / (good / (sizes[0] + 1))
        marked = (held >= max(SUPPORT, SHARE * rows[1])) & (odds >= ODDS) & (forms != 0)
        label |= marked[which]
    label &= toxic[text] == 1
    _fit(crf, found, begin, label.astype(float))
    terms = doc_terms(token_scores(crf, found, begin), first)
    _logistic(crf, terms, toxic.astype(float))
    return crf


def _pairs(row: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, text)."""
    order = np.lexsort((row, text))
    row, text = row[order], text[order]
    keep = np.r_[True, (row[1:] != row[:-1]) | (text[1:] != text[:-1])]
    return row[keep], text[keep]


def _fit(crf: Crf, found: np.ndarray, begin: np.ndarray, label: np.ndarray) -> None:
    """Maximum likelihood by full passes with steps that shrink by feature (Adagrad)."""
    chains = Chains(begin, found.shape[1])
    where, there = buckets(found), found != 0
    inner = np.ones(found.shape[1], bool)
    inner[begin] = False
    second = np.flatnonzero(inner)
    pairs = (label[second - 1] * 2 + label[second]).astype(int)
    seen_links = np.bincount(pairs, minlength=4).reshape(2, 2).astype(float)
    sum_w, sum_l = np.full_like(crf.weights, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(STEPS):
        forward, backward = chains.marginals(emissions(crf.weights, found), crf.links)
        odds = forward * backward
        p = odds / (1 + odds)
        miss = label - p
        for k in range(len(found)):
            grad = np.bincount(where[k][there[k]], miss[there[k]], 1 << BITS) - 1e-3 * crf.weights[k]
            sum_w[k] += grad**2
            crf.weights[k] += 1.0 * grad / np.sqrt(sum_w[k])
        t = np.exp(crf.links)
        # joint of neighbours: forward odds, link, and what follows given the later label
        r, later = forward[second - 1], odds[second] / np.maximum(forward[second], 1e-300)
        e1 = forward[second] * (t[0, 0] + r * t[1, 0]) / (t[0, 1] + r * t[1, 1])
        joint = np.stack([t[0, 0] * np.ones_like(r), t[0, 1] * e1 * later, r * t[1, 0], r * t[1, 1] * e1 * later])
        joint = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        grad = seen_links - joint
        sum_l += grad**2
        crf.links += 0.3 * grad / np.sqrt(sum_l)


def _logistic(crf: Crf, terms: np.ndarray, label: np.ndarray) -> None:
    """Ridge logistic regression; a Newton step is halved until it helps."""

    def loss(w):
        z = terms @ w
        return np.logaddexp(0, z).sum() - label @ z + 0.05 * w @ w

    w = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(terms @ w, -30, 30)))
        h = (terms * (p * (1 - p))[:, None]).T @ terms + 0.1 * np.eye(4)
        step, size = np.linalg.solve(h, terms.T @ (label - p) - 0.1 * w), 1.0
        while loss(w + size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w + size * step
        if size * np.abs(step).max() < 1e-6:
            break
    crf.doc = w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample: int = 1000, longest: int = 20_000) -> Crf:
    """A model from at most ``sample`` documents of each label with at most ``longest`` characters.

    ``labels`` has doc_id and toxic (0 or 1); rows with nulls and documents
    held out (crc32 of doc_id modulo 5 is 0) are not used, nor are ids with
    both labels. The sample is the same on every run.
    """
    rows = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other")
    order = F.xxhash64("doc_id")
    ids = [rows.filter(F.col("toxic") == y).orderBy(order).limit(sample) for y in (0, 1)]
    # bounded: at most two times ``sample`` ids are sent to the tasks
    picked = F.broadcast(ids[0].union(ids[1]).select("doc_id", "toxic"))
    texts = documents.select("doc_id", "text").filter(F.length("text") <= longest).join(picked, "doc_id")
    texts = texts.dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").toPandas().sort_values("doc_id")
    return train(texts["text"].tolist(), texts["toxic"].to_numpy(np.int64))


def score(documents: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, score, n_tokens and spans (first character, end, marginal) of each row.

    A null or empty text has no tokens and gets the score of none. Repeated
    rows and null ids are scored like any other. No rows give no rows.
    """
    model = documents.sparkSession.sparkContext.broadcast(crf)

    def run(batches):
        crf = model.value
        for batch in batches:
            data, at = g.texts(batch.column("text"))
            for i, j in g.slices(at):
                body, first_byte = data[at[i] : at[j]], at[i : j + 1] - at[i]
                starts, ends, first, begin = tokens(body, first_byte)
                p = token_scores(crf, features(body, starts, ends), begin)
                z = doc_terms(p, first) @ crf.doc
                total = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                letters = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
                spans: list[list] = [[] for _ in range(j - i)]
                hot = np.flatnonzero(p >= 0.5)
                owner = np.searchsorted(first, hot, "right") - 1
                base = letters[first_byte[owner]]
                for r, a, b, x in zip(owner.tolist(), (letters[starts[hot]] - base).tolist(),
                                      (letters[ends[hot]] - base).tolist(), p[hot].tolist()):
                    spans[r].append({"first": a, "end": b, "marginal": x})
                kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(total), pa.array(np.diff(first)), pa.array(spans, kind)],
                    names=["doc_id", "score", "n_tokens", "spans"])

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, score double, n_tokens long, spans array<struct<first:long,end:long,marginal:double>>")
