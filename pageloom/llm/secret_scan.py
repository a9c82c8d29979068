"""Secret scans: a random forest sorts findings from look-alikes (operator 10).

DataFrame and ML functions only. Candidates are long runs of characters of
keys with a digit in them. Each is described by

* its length and how it is made up (digits, upper case, hex, distinct characters),
* how likely its character transitions are in the words of the corpus,
* how much of it is words of the corpus,
* path signs in and around it,
* the words beside it (hashed) and whether they name or assign a secret.

A forest, trained on labelled findings, gives each candidate a score; below
``THRESHOLD`` it is a false positive. Corpus statistics cover all documents;
the training sample is bounded by ``sample`` rows of each label.

Where no labelled findings are given, candidates label themselves by the rule
of ``weak_labels``: a value assigned to a name of ``NAMES`` is a secret, a run
of digits alone, one in a path or address, or one between plain words is not.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import unused
from .quality_rules import with_words

#: a character of keys, and a run of them that may be one (fixed values)
RUN = r"[A-Za-z0-9+/=_\-]"
CANDIDATE = r"(?=[A-Za-z+/=_\-]*[0-9])[A-Za-z0-9+/=_\-]{16,}"
NAMES = r"(?i)(token|secret|passw|pwd|api.?key|apikey|credential|auth|private|access.?key|bearer)"
ASSIGNS = r"[=:]['\"]?$"
PATHS = r"(?i)(https?:|www\.|[/\\].*[/\\]|\.(html?|com|org|net|png|jpe?g|pdf)\b)"
THRESHOLD = 0.5
#: a word is in the dictionary if the corpus holds it so often
COMMON = 20
NEIGHBOURS = 64
REDACTED = "[secret]"

NUMBERS = ["length", "digits", "upper", "hex", "distinct", "transition", "dictionary", "path", "named", "assigned", "quoted"]


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, count) of lower-case runs of letters and digits of all texts."""
    words = documents.select(F.explode(F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}]+")).alias("word"))
    return words.filter("word <> ''").groupBy("word").agg(F.count("*").alias("count"))


def _plain(word: Column) -> Column:
    """Letters a-z and digits stay, all else is one sign: 37 characters, 1,369 pairs."""
    return F.regexp_replace(F.lower(word), "[^a-z0-9]", "~")


def _pairs(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.substr(word, i, F.lit(2)))


def transitions(words: DataFrame) -> DataFrame:
    """One row: map of a pair of characters to log2 of its probability after the first."""
    w = words.select(_plain(F.col("word")).alias("w"), "count").filter(F.length("w") >= 2)
    pair = w.select(F.explode(_pairs(F.col("w"))).alias("pair"), "count").groupBy("pair").agg(F.sum("count").alias("n"))
    first = pair.groupBy(F.substring("pair", 1, 1).alias("a")).agg(F.sum("n").alias("all"))
    logs = pair.join(F.broadcast(first), F.substring("pair", 1, 1) == F.col("a")).select(
        "pair", F.log2((F.col("n") + 1) / (F.col("all") + 37)).alias("p"))
    # at most 1,369 entries
    return logs.agg(F.map_from_entries(F.collect_list(F.struct("pair", "p"))).alias("log_p"))


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, position (of the word), nth (run in the word), candidate and its surroundings."""
    df = with_words(documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k")), F.col("text"))

    def found(word, i):
        near = [F.coalesce(F.get("_words", i + d), F.lit("")) for d in (-2, -1, 1)]
        return F.when((F.length(word) >= 16) & word.rlike(CANDIDATE), F.struct(
            i.cast("long").alias("position"), word.alias("word"), near[0].alias("before2"), near[1].alias("before1"),
            near[2].alias("after1")))

    hits = df.select("doc_id", "k", F.explode(F.filter(F.transform("_words", found), lambda h: h.isNotNull())).alias("h"))
    runs = hits.select("doc_id", "k", "h.*", F.posexplode(F.regexp_extract_all("h.word", F.lit(CANDIDATE), F.lit(0))).alias("nth", "candidate"))
    return runs.withColumn("nth", F.col("nth").cast("long"))


def _share(pattern: str) -> Column:
    c = F.col("candidate")
    return F.length(F.regexp_replace(c, pattern, "")) / F.length(c)


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the numbers of ``NUMBERS`` and hashed neighbours."""
    keys = ["k", "doc_id", "position", "nth", "candidate"]
    # runs of letters of a candidate, looked up among common words
    runs = found.select("candidate").distinct().select("candidate", F.explode(
        F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    common = words.filter(F.col("count") >= COMMON).select("word")
    covered = runs.join(common, "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("covered"))
    df = found.join(covered, "candidate", "left").crossJoin(F.broadcast(transitions(words)))
    c, plain = F.col("candidate"), _plain(F.col("candidate"))
    log_p = F.aggregate(_pairs(plain), F.lit(0.0), lambda a, p: a + F.coalesce(F.try_element_at("log_p", p), F.lit(-12.0)))
    inside = F.concat_ws(" ", "before1", "word")
    head = F.expr("substring_index(word, candidate, 1)")
    df = df.select(
        *keys, "word", "before1", "before2", "after1",
        F.length(c).cast("double").alias("length"),
        _share("[^0-9]").alias("digits"), _share("[^A-Z]").alias("upper"), _share("[^0-9a-fA-F]").alias("hex"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.length(c)).alias("distinct"),
        (log_p / F.greatest(F.length(c) - 1, F.lit(1))).alias("transition"),
        (F.coalesce("covered", F.lit(0)) / F.length(c)).alias("dictionary"),
        inside.rlike(PATHS).cast("double").alias("path"),
        F.concat_ws(" ", "before2", "before1", head).rlike(NAMES).cast("double").alias("named"),
        (F.col("before1").rlike(ASSIGNS) | head.rlike(ASSIGNS)).cast("double").alias("assigned"),
        F.col("word").rlike("^.*['\"].*$").cast("double").alias("quoted"))
    return df.withColumns({f"near_{n}": F.lower(F.regexp_replace(n, r"[^\p{L}=:]", "")) for n in ("before1", "before2", "after1")})


def weak_labels(df: DataFrame) -> DataFrame:
    """Labels of candidates by their surroundings alone; null where the rule does not say."""
    return df.withColumn("label", F.when((F.col("named") == 1) & (F.col("assigned") == 1), 1.0).when(
        (F.col("digits") == 1) | (F.col("path") == 1) | ((F.col("assigned") == 0) & (F.col("named") == 0)), 0.0))


def _vectors(df: DataFrame) -> DataFrame:
    near = [c for c in df.columns if c.startswith("near_")]
    df = FeatureHasher(inputCols=near, outputCol="hashed", numFeatures=NEIGHBOURS).transform(df)
    return VectorAssembler(inputCols=[*NUMBERS, "hashed"], outputCol="features").transform(df)


def train(labelled: DataFrame, sample: int = 20_000, trees: int = 20, depth: int = 6) -> RandomForestClassificationModel | None:
    """A forest from at most ``sample`` rows of each label; None where a label is missing."""
    rows = labelled.filter("label IS NOT NULL")
    order = F.xxhash64("doc_id", "position", "nth", "candidate")
    bounded = [rows.filter(F.col("label") == y).orderBy(order).limit(sample) for y in (0.0, 1.0)]
    rows = materialize(bounded[0].union(bounded[1]), "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt")
    return forest.fit(_vectors(rows))


def secret_scan(documents: DataFrame, findings: DataFrame | None = None, sample: int = 20_000) -> DataFrame:
    """Candidates with score (0 to 1) and is_secret.

    Needs columns doc_id and text; others are ignored. ``findings``: labelled
    findings (doc_id, position, nth, label 0/1), by default those of
    ``weak_labels``. Gives doc_id, position (number of the word), nth (run in
    that word), candidate, length, score, is_secret.

    A null or empty text has no candidates. Repeated rows are found each.
    Without examples of both labels there is no forest: the rule of
    ``weak_labels`` decides, and what it does not decide counts as a secret.
    """
    words = materialize(word_counts(documents), "words")
    df = materialize(described(candidates(documents), words), "candidates")
    if findings is None:
        labelled = weak_labels(df)
    else:
        known = findings.select("doc_id", "position", "nth", F.col("label").cast("double").alias("label")).dropDuplicates(
            ["doc_id", "position", "nth"])
        labelled = df.join(known, ["doc_id", "position", "nth"])
    model = train(labelled, sample)
    if model is None:
        scored = weak_labels(df).withColumn("score", F.coalesce("label", F.lit(1.0)))
    else:
        scored = model.transform(_vectors(df)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "k", "position", "nth", "candidate", F.col("length").cast("long").alias("length"),
                         "score", (F.col("score") >= THRESHOLD).alias("is_secret"))


def redacted(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``documents`` with secrets of ``found`` replaced; n_chars follows where it is a column.

    Rows are matched by a hash of id and text; texts without secrets, also null
    and empty ones, pass unchanged, repeated rows are treated alike, and other
    columns pass, whatever their names. A secret is replaced wherever it is a
    whole run of characters of keys, so nothing is left of a secret that holds
    another one, and longer runs that are none stay. No rows give no rows.
    """
    key, secrets = unused(documents, "key"), unused(documents, "secrets")
    held = found.filter("is_secret").groupBy(F.col("k").alias(key)).agg(F.array_sort(F.collect_set("candidate")).alias(secrets))
    keyed = documents.withColumn(key, F.xxhash64("doc_id", "text"))
    joined = keyed.join(held, key, "left")
    quoted = F.transform(secrets, lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E")))
    pattern = F.concat(F.lit(f"(?<!{RUN})(?:"), F.array_join(quoted, "|"), F.lit(f")(?!{RUN})"))
    out = joined.withColumn("text", F.when(F.col(secrets).isNull(), F.col("text")).otherwise(
        F.regexp_replace("text", pattern, F.lit(REDACTED))))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col(secrets).isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return out.select(*documents.columns)
