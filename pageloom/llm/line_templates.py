"""Line dedup with a log-template tree of fixed depth (operator 6).

A line goes down the tree by its number of tokens and its first tokens, with
tokens that hold a digit generalised to a variable field; the leaf holds the
templates of such lines. A template is the line with its variable fields
generalised: tokens with digits always, and in lines of ``GENERAL`` tokens or
more, one further field: four templates leave out every fourth token, each from
another place on, so lines that differ in one field share exactly one of them,
the one that leaves its place out. Lines that differ at places that are not
equal modulo ``LEFT_OUT``, among the first ``DEPTH`` tokens, or in lines shorter
than ``GENERAL`` at a token without a digit, share none and stay: fields are not
found from the data as in a leaf of a full log-template tree.

Lines of fewer than ``SHORTEST`` tokens have their exact tokens as template,
digits too, where a caller asks for it (``shortest`` = 1, as op6 and the
pipeline do); lines without a token never have one.

A template that lines of ``min_docs`` different texts share recurs. Its lines
are dropped from all documents but the one with the smallest doc_id, so content
stays once. Paths of the tree are compared by 64-bit hashes; no two lines are
ever compared, and counts are combined in each task before they are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import grams as g
from .components import unused

#: leading tokens that choose a branch
DEPTH = 2
#: lines with fewer tokens have no variable fields
SHORTEST = 3
#: lines with fewer tokens generalise digits only
GENERAL = 8
LEFT_OUT = 4
#: templates that are sent to all tasks; more are joined by template
SENT_TEMPLATES = 1 << 20
#: a null doc_id comes after all others
LAST = (1 << 63) - 1

DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
FIELD = np.uint64(0xA5A5F00D12345677)


def line_keys(data: np.ndarray, at: np.ndarray, shortest: int = SHORTEST):
    """Templates of the lines of texts.

    Gives for each line its first byte, end and text, and for each (line,
    template) the line's number and the template's hash.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    new = np.zeros(len(data) + 1, bool)
    new[1:] = data == 10
    new[at[:-1]] = True
    new[len(data)] = False
    starts = np.flatnonzero(new)
    owner = np.searchsorted(at, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), at[owner + 1])
    last = np.append(owner[1:] != owner[:-1], True)
    ends = np.where(last, ends, ends - 1)  # without the line feed
    a, b, first = g.word_spans(data, np.append(starts, len(data)))
    codes = g.word_codes(data, a, b)
    digits = np.concatenate([[0], np.cumsum(DIGIT[data])])
    counts = np.diff(first)
    line = np.repeat(np.arange(len(starts)), counts)
    codes = np.where((digits[b] > digits[a]) & (counts[line] >= SHORTEST), FIELD, codes)
    place = np.arange(len(codes)) - first[:-1][line]
    # the branch: number of tokens and leading ones; the rest by place
    parts = g.mix(codes + (place.astype(np.uint64) + np.uint64(1)) * g.ROOT)
    branch = counts.astype(np.uint64) * FIELD
    lead = place < DEPTH
    np.add.at(branch, line[lead], g.mix(parts[lead]))
    keys, lines = [], []

    def template(kind: int, used: np.ndarray, chosen: np.ndarray) -> None:
        total = np.zeros(len(starts), np.uint64)
        np.add.at(total, line[used], parts[used])
        keys.append(g.mix(total[chosen] ^ g.mix(branch[chosen] + np.uint64(kind))))
        lines.append(chosen)

    template(0, np.ones(len(codes), bool), np.flatnonzero(counts >= shortest))
    long = np.flatnonzero(counts >= GENERAL)
    if len(long):
        for j in range(LEFT_OUT):
            # leading tokens chose the branch, so a template without them is still below it
            template(j + 1, place % LEFT_OUT != j, long)
    return starts, ends, owner, np.concatenate(lines), np.concatenate(keys)


def _counted(shortest: int):
    """(template, text, doc_id) of each line; once for each text of a slice."""

    def run(batches):
        for batch in batches:
            data, at = g.texts(batch.column("text"))
            ids = batch.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
            hashes = batch.column("h").to_numpy()
            for i, j in g.slices(at):
                _, _, owner, line, keys = line_keys(data[at[i] : at[j]], at[i : j + 1] - at[i], shortest)
                text = owner[line] + i
                keys = keys.view(np.int64)
                order = np.lexsort((ids[text], hashes[text], keys))
                keys, text = keys[order], text[order]
                if not len(keys):
                    continue
                once = np.r_[True, (keys[1:] != keys[:-1]) | (hashes[text][1:] != hashes[text][:-1])]
                keys, text = keys[once], text[once]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(hashes[text]), pa.array(ids[text])],
                                                 names=["template", "h", "doc_id"])

    return run


def templates(documents: DataFrame, min_docs: int = 10, shortest: int = SHORTEST) -> DataFrame:
    """(template, first, n_texts) of templates that recur; first: the smallest doc_id."""
    lines = documents.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(
        g.tidy(_counted(shortest)), "template long, h long, doc_id long")
    once = lines.groupBy("template", "h").agg(F.min("doc_id").alias("doc_id"))
    return once.groupBy("template").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_texts")).filter(
        F.col("n_texts") >= min_docs)


def _strip(sent, shortest: int, held: str = ""):
    """Documents without lines of templates of another document.

    ``sent``: broadcast (templates, first documents), or None where each row has its own.
    """

    def run(batches):
        for batch in batches:
            data, at = g.texts(batch.column("text"))
            ids = batch.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
            known, first = sent.value if sent is not None else (None, None)
            own = batch.column(held).to_pylist() if sent is None else None
            texts: list = batch.column("text").to_pylist()
            total, gone = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for i, j in g.slices(at):
                body = data[at[i] : at[j]]
                starts, ends, owner, line, keys = line_keys(body, at[i : j + 1] - at[i], shortest)
                total[i:j] = np.bincount(owner, minlength=j - i)
                if own is None:
                    where = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                    hit = np.zeros(len(keys), bool)
                    if len(known):
                        hit = (known[where] == keys) & (first[where] != ids[i:j][owner[line]])
                else:
                    sets = [set(x or ()) for x in own[i:j]]
                    hit = np.array([k in sets[r] for k, r in zip(keys.view(np.int64).tolist(), owner[line].tolist())], bool)
                drop = np.zeros(len(starts), bool)
                drop[line[hit]] = True
                flat = body.tobytes()
                for r in np.unique(owner[drop]).tolist():
                    mine = np.flatnonzero(owner == r)
                    left = [flat[a:b] for a, b, d in zip(starts[mine].tolist(), ends[mine].tolist(), drop[mine].tolist()) if not d]
                    texts[i + r] = b"\n".join(left).decode()
                    gone[i + r] = int(drop[mine].sum())
            new = {"text": pa.array(texts, pa.string()), "lines_total": pa.array(total), "lines_removed": pa.array(gone)}
            names = [n for n in batch.schema.names if n not in ("lines_total", "lines_removed", held)]
            names += ["lines_total", "lines_removed"]
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names=names)

    return run


def line_dedup(documents: DataFrame, min_docs: int = 10, shortest: int = SHORTEST) -> DataFrame:
    """``documents`` without recurring lines, plus lines_total and lines_removed.

    Needs columns doc_id and text; other columns pass, existing ones named
    lines_total or lines_removed are replaced. A null or empty text stays as it
    is. Exact copies of a text count as one text, but lose lines like others.
    Rows with a null doc_id come after all others; if all rows of a template
    have none, they all keep it. No rows give no rows. Lines of fewer than
    ``shortest`` tokens stay; 1 leaves none out but those without a token.
    """
    spark = documents.sparkSession
    found = materialize(templates(documents, min_docs, shortest), "templates")
    schema = T.StructType([f for f in documents.schema if f.name not in ("lines_total", "lines_removed")]
                          + [T.StructField("lines_total", T.LongType()), T.StructField("lines_removed", T.LongType())])
    if found.count() <= SENT_TEMPLATES:
        rows = found.toPandas()
        keys = rows["template"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        sent = spark.sparkContext.broadcast((keys[order], rows["first"].to_numpy(np.int64)[order]))
        return documents.mapInArrow(g.tidy(_strip(sent, shortest)), schema)
    # rows find their templates by a join; texts are dealt by row
    key, held = unused(documents, "key"), unused(documents, "templates")
    hashed = documents.withColumn(key, F.xxhash64("doc_id", "text"))

    def keyed(batches):
        for batch in batches:
            data, at = g.texts(batch.column("text"))
            ids = batch.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
            k = batch.column(key).to_numpy()
            for i, j in g.slices(at):
                _, _, owner, line, keys = line_keys(data[at[i] : at[j]], at[i : j + 1] - at[i], shortest)
                text = owner[line] + i
                yield pa.RecordBatch.from_arrays([pa.array(k[text]), pa.array(ids[text]), pa.array(keys.view(np.int64))],
                                                 names=["_k", "id", "template"])

    lines = hashed.select("doc_id", "text", key).mapInArrow(g.tidy(keyed), "_k long, id long, template long").distinct()
    own = lines.join(found, "template").filter("id <> first").groupBy(F.col("_k").alias(key)).agg(F.collect_set("template").alias(held))
    return hashed.join(own, key, "left").drop(key).mapInArrow(g.tidy(_strip(None, shortest, held)), schema)
