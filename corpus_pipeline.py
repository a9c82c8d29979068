"""A corpus pipeline: quality rules, line dedup, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
give the columns of documents. ``run`` writes each stage's result to the shared
folder and reads it as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import line_templates, ngram_jaccard, packing, quality_rules, secret_scan
from pageloom.session import materialize

#: not SQL: thresholds come from random sketches, secrets from a trained forest
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those of which no word is left go."""
    out = line_templates.line_dedup(docs, shortest=1)
    own = (F.col("lines_removed") == 0) | F.col("text").rlike(quality_rules.WORD)
    out = out.filter(own)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("lines_removed") == 0, F.col("n_chars")).otherwise(F.length("text")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that word 5-grams link at a similarity of 0.8."""
    return ngram_jaccard.one_of_each(docs, 5, 80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced."""
    return secret_scan.redacted(docs, materialize(secret_scan.secret_scan(docs), "secrets"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2,048 tokens, with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 1)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
