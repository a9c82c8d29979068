"""Glossary hints and conversation messages."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels
from ..schemas import GLOSSARY_ENTRY

# Fixed value: the frame of a hint.
HINT_HEAD = "\nHint for specific terms:\n"
#: a glossary up to this size is sent to all tasks; characters of a block of messages beyond it
SENT_BYTES = 16 << 20
BLOCK_BYTES = 8 << 20
#: rows that a task holds before it hands them out
OUT_ROWS = 20_000


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """JSON object files of term to entry; a missing or broken file gives no rows."""
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
        return spark.createDataFrame([], "term string, full_name string, translation string, remarks string")
    table = F.from_json("value", f"map<string,{GLOSSARY_ENTRY}>")
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(table).alias("term", "entry"))
        .select("term", "entry.*")
    )


def _terms(glossary: DataFrame) -> DataFrame:
    """Rows that have a term: an empty or missing one occurs nowhere."""
    return glossary.filter(F.col("term") != "")


class _Automaton:
    """All terms at once: a text is read once, whatever the number of terms."""

    def __init__(self, terms: list[str]) -> None:
        self.rows: dict[str, list[int]] = {}
        for i, term in enumerate(terms):
            self.rows.setdefault(term, []).append(i)
        self.found = ahocorasick.Automaton()
        for term in self.rows:
            self.found.add_word(term, term)
        self.found.make_automaton()

    def scan(self, text: str, whole_word: bool) -> list[int]:
        """Rows of the terms that occur in ``text``; both are in lower case already."""
        if not self.rows:
            return []
        met = set()
        for end, term in self.found.iter(text):
            if term not in met and not (whole_word and (_in_word(text, end + 1) or _in_word(text, end - len(term)))):
                met.add(term)
        return sorted(i for term in met for i in self.rows[term])


def _found(automaton: _Automaton, texts: pa.Array, whole_word: bool):
    """(numbers of texts, numbers of terms) of what occurs, some ``OUT_ROWS`` at a time.

    Texts are taken one by one, so neither they nor their terms are held as a whole.
    """
    message, row = [], []
    for i, low in enumerate(texts):
        hits = automaton.scan(low.as_py(), whole_word)
        message += [i] * len(hits)
        row += hits
        if len(row) >= OUT_ROWS:
            yield pa.array(message, pa.int64()), pa.array(row, pa.int64())
            message, row = [], []
    if row:
        yield pa.array(message, pa.int64()), pa.array(row, pa.int64())


def _in_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def matches(
    messages: DataFrame, glossary: DataFrame, key: list[str], text: str = "text", whole_word: bool = False,
    sent_bytes: int = SENT_BYTES,
) -> DataFrame:
    """(key, term, …) for every term that occurs in a message, ignoring case.

    The terms are one Aho-Corasick automaton, so neither a frequent gram nor a
    short term makes a hot key. A glossary of at most ``sent_bytes`` goes to
    the messages, which are not shuffled. A larger one is cut into parts, and
    every part meets every block of messages in a task of its own.
    """
    columns = [c for c in glossary.columns if c not in key]
    terms = _terms(glossary).withColumn("_low", F.lower("term"))
    size = terms.agg(F.sum(F.length(F.to_json(F.struct(*terms.columns))))).first()[0] or 0
    schema = T.StructType([messages.schema[k] for k in key] + [glossary.schema[c] for c in columns])
    said = messages.select(*key, F.lower(F.col(text)).alias("_low_text")).filter("_low_text IS NOT NULL")
    if size <= sent_bytes:
        sent = messages.sparkSession.sparkContext.broadcast(terms.select(*columns, "_low").toArrow())

        def run(batches):
            table = sent.value
            automaton, entries = _Automaton(table.column("_low").to_pylist()), table.select(columns)
            for batch in batches:
                keys = batch.select(key)  # a text is not copied for each of its terms
                for message, row in _found(automaton, batch.column("_low_text"), whole_word):
                    left, found = keys.take(message), entries.take(row).combine_chunks()
                    yield pa.RecordBatch.from_arrays(
                        [left.column(k) for k in key] + [found.column(c).combine_chunks() for c in columns], names=[*key, *columns])

        return said.mapInArrow(run, schema)
    parts = -(-size // sent_bytes)
    volume = said.agg(F.sum(F.length("_low_text"))).first()[0] or 0
    blocks = int(max(1, -(-volume // BLOCK_BYTES)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    left = said.select("*", F.pmod(F.xxhash64(*key, "_low_text"), F.lit(blocks)).cast("int").alias("_block"), every(parts).alias("_part"))
    right = terms.select(*columns, "_low", F.pmod(F.xxhash64("_low"), F.lit(int(parts))).cast("int").alias("_part"), every(blocks).alias("_block"))

    def cell(some: pa.Table, table: pa.Table) -> pa.Table:
        automaton = _Automaton(table.column("_low").to_pylist())
        keys, entries = some.select(key), table.select(columns)
        parts = [(keys.take(message), entries.take(row)) for message, row in _found(automaton, some.column("_low_text"), whole_word)]
        parts = parts or [(keys.slice(0, 0), entries.slice(0, 0))]
        said, terms = (pa.concat_tables(side) for side in zip(*parts))
        return pa.table([said.column(k) for k in key] + [terms.column(c) for c in columns], names=[*key, *columns])

    return left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(cell, schema)


def hints(matched: DataFrame, key: list[str]) -> DataFrame:
    """One hint text per message, terms in order; a message has few terms at most."""
    line = labels.glossary_line(F.col("term"), F.col("full_name"), F.col("translation"), F.col("remarks"))
    lines = matched.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("term", line.alias("line")))).alias("_lines")
    )
    text = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    return lines.select(*key, F.concat(F.lit(HINT_HEAD), text, F.lit("\n")).alias("hint"))


def last_message(messages: DataFrame, role: str) -> DataFrame:
    """The last message of a role per conversation; only turn numbers are grouped."""
    said = messages.filter(F.col("role") == role)
    last = said.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return said.join(last, ["conv_id", "turn"]).select("conv_id", "text")
