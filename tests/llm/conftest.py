import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, over two partitions."""

    def run(rows, parts=2):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts, "doc_id")

    return run


@pytest.fixture(scope="session")
def odd(make):
    """Rows that every operator must bear: nulls, empty and long texts, repeated rows, clashing names."""
    long_text = " ".join(f"w{i % 7919}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long_text), (5, "one two three"), (5, "one two three"), (None, "one two three"),
            (6, "häß   \U0001f600 x" * 3), (7, "a." * 50), (5, "another text under the same id")]
    df = make(rows)
    for name in ("k", "node", "n", "owner", "keys", "h", "lines_total", "_words", "score", "rank", "_k", "_r", "key",
                 "key_", "row_key", "_row_key", "secrets", "_secrets", "templates", "_templates", "times", "salt", "component"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
