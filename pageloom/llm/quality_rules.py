"""Quality rules with thresholds that follow each language and source (operator 7).

Built-in column functions only. Every text is measured within its row; small
mergeable quantile sketches of the measures, for each language and source,
give the thresholds, and a join brings those back to the rows.

Measures for the rules: mean word length, symbols a word, share of upper-case
letters, exclamation marks a word, share of repeated lines, share of words in
repeated windows. A row is rejected if one of them lies beyond

    quartile -/+ REACH * max(quartile distance, floor) * (1 + sqrt(64 / words))

of its language and source, so short texts, whose measures scatter, get more
room. Groups of fewer than ``SMALL`` rows take the merged sketches of their
language, and languages of so few rows those of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import unused

#: white space between words (fixed values)
WHITE = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
REACH = 5.0
SMALL = 50
#: size of the sketches; exact below it, rank error about 0.1 % above
SKETCH = 2048
#: groups of thresholds that are sent to all tasks; more are joined by salted keys
SENT_GROUPS = 50_000
SALTS = 64

#: measure, smallest distance between quartiles that is assumed, whether low values are rejected too
RULES = (("mean_word", 0.2, True), ("symbol_rate", 0.02, False), ("upper_rate", 0.02, False),
         ("shout_rate", 0.02, False), ("dup_line_rate", 0.05, False), ("repeat_rate", 0.02, False))


def with_words(df: DataFrame, text: Column) -> DataFrame:
    """Adds _text (null: empty) and _words."""
    df = df.withColumn("_text", F.coalesce(text, F.lit("")))
    trimmed = F.btrim("_text", F.lit(WHITE))
    return df.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT)))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def row_key() -> Column:
    """A number for a row; rows that share it are judged alike."""
    return F.xxhash64("doc_id", "text", "lang", "source")


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, row_key and the measures of each row.

    n_repeat_words: words covered by a 5-word window that is found twice or
    more in the text. Windows are compared by 64-bit hashes; only texts that
    have equal ones sort them to find their places.
    """
    # repeated rows and clashing names do not matter: nothing is joined by id
    df = with_words(documents.select("doc_id", "lang", "source", "text", row_key().alias("row_key")), F.col("text"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("_w5", F.when(F.col("n_words") >= 5, F.transform(
        F.sequence(F.lit(0), F.size("_words") - 5),
        lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(5)]))))
    df = df.withColumn("_sorted", F.when(
        F.size("_w5") != F.size(F.array_distinct("_w5")),
        F.array_sort(F.transform("_w5", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("_again", F.array_sort(F.filter(F.transform("_sorted", lambda e, i: F.when(
        (e["h"] == F.coalesce(F.get("_sorted", i - 1)["h"], F.bitwise_not(e["h"])))
        | (e["h"] == F.coalesce(F.get("_sorted", i + 1)["h"], F.bitwise_not(e["h"]))), e["i"])), lambda i: i.isNotNull())))
    covered = F.aggregate(
        F.transform("_again", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("_again", i + 1) - p, F.lit(5))).cast("long")),
        F.lit(0).cast("long"), lambda a, b: a + b)
    df = df.withColumn("_lines", lines)
    return df.select(
        "doc_id", "lang", "source", "row_key", "n_words",
        F.length(without(F.col("_text"), WHITE)).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.length("_text") - F.length(without(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long").alias("n_upper"),
        (F.length("_text") - F.length(without(F.col("_text"), "!"))).cast("long").alias("n_shouts"))


def with_rates(df: DataFrame) -> DataFrame:
    def per(count: str, of: str) -> Column:
        return F.col(count) / F.greatest(F.col(of), F.lit(1))

    return df.withColumns({
        "mean_word": per("word_chars", "n_words"), "symbol_rate": per("n_symbols", "n_words"),
        "upper_rate": per("n_upper", "word_chars"), "shout_rate": per("n_shouts", "n_words"),
        "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words"),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))})


def thresholds(rows: DataFrame) -> DataFrame:
    """lang, source and low_/high_ bounds at quartiles, from merged sketches.

    Null languages and sources are groups of their own.
    """
    names = [r[0] for r in RULES]
    fine = rows.filter(~F.col("base_failed")).groupBy("lang", "source").agg(
        F.count("*").alias("rows"), *[F.kll_sketch_agg_double(n, SKETCH).alias(n) for n in names])
    fine = materialize(fine, "sketches")

    def merged(keys):
        return fine.groupBy(*keys).agg(F.sum("rows").alias("rows"), *[F.kll_merge_agg_double(n).alias(n) for n in names])

    by_lang = merged(["lang"]).select(F.col("lang").alias("l"), F.struct("rows", *names).alias("mid"))
    overall = merged([]).filter("rows > 0").select(F.struct("rows", *names).alias("top"))
    out = fine.join(by_lang, fine["lang"].eqNullSafe(by_lang["l"])).join(F.broadcast(overall))
    pick = F.when(F.col("rows") >= SMALL, F.struct("rows", *names)).when(
        F.col("mid.rows") >= SMALL, F.col("mid")).otherwise(F.col("top"))
    out = out.select("lang", "source", pick.alias("s"))
    return out.select("lang", "source", *[
        F.kll_sketch_get_quantile_double(f"s.{n}", F.lit(q)).alias(f"{n}_{p}") for n in names for p, q in (("q1", .25), ("q3", .75))])


def judged(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows with ``kept``; bounds are sent to all tasks while few, else joined with salted keys."""
    bounds = bounds.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = rows["lang"].eqNullSafe(bounds["_lang"]) & rows["source"].eqNullSafe(bounds["_source"])
    if bounds.count() <= SENT_GROUPS:
        out = rows.join(F.broadcast(bounds), same, "left")
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(SALTS)))
        bounds = bounds.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.join(bounds, rows["lang"].eqNullSafe(bounds["_lang"]) & rows["source"].eqNullSafe(bounds["_source"])
                        & (rows["_salt"] == bounds["_slice"]), "left").drop("_salt", "_slice")
    room = F.lit(REACH) * (1 + F.sqrt(64 / F.greatest("n_words", F.lit(1))))
    beyond = F.lit(False)
    for name, floor, low in RULES:
        width = F.greatest(F.col(f"{name}_q3") - F.col(f"{name}_q1"), F.lit(floor)) * room
        rule = F.col(name) > F.col(f"{name}_q3") + width
        if low:
            rule = rule | (F.col(name) < F.col(f"{name}_q1") - width)
        beyond = beyond | F.coalesce(rule, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~beyond).drop(
        "_lang", "_source", *[f"{n}_{p}" for n, _, _ in RULES for p in ("q1", "q3")])


def quality_rules(documents: DataFrame) -> DataFrame:
    """Measures, base_failed and kept of each row.

    Needs columns doc_id, text, lang and source; others are ignored. A null or
    empty text has no words and fails the base rule. Null languages and sources
    are groups of their own. Repeated rows are judged alike. No rows give no
    rows. Sketches are exact up to their size; beyond it their random choices
    may move a threshold by a fraction of a percent of ranks, so the measures
    and thresholds of a run are written once.
    """
    rows = materialize(with_rates(measured(documents)), "measures")
    return judged(rows, materialize(thresholds(rows), "thresholds"))


def kept_documents(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the rules keep, unchanged, with all their columns.

    Cases as in ``quality_rules``; repeated rows stay or go together, and no
    rows give no rows. The verdicts are narrow and written once. A filter on
    them is joined back: put above the measures it would be pushed below them
    and measure the text again for every place where a measure is used.
    """
    key = unused(documents, "row_key")
    kept = quality_rules(documents).filter("kept").select(F.col("row_key").alias(key)).distinct()
    keyed = documents.withColumn(key, row_key())
    return keyed.join(kept, key, "left_semi").select(*documents.columns)
