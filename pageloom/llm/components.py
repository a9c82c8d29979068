"""Connected components of a table of links, in Spark, round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all ends of ``links`` (a, b); component: its smallest node.

    Large-star / small-star: every round ties the neighbours of a node to the
    smallest of them, until nothing changes. The number of rounds grows with
    the logarithm of the size of a component. Aggregates combine before the
    shuffle, so a node with very many links is no single task. Each round is
    written to the shared folder.
    """
    edges = materialize(links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        # large star: larger neighbours of a node go to its smallest neighbour
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        least = least.select("node", F.least("node", "m").alias("m"))
        large = both.join(least, both.a == least.node).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # small star: smaller neighbours and the node itself go to the smallest
        small = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        moved = large.join(small, large.a == small.node)
        edges = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(
            small.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()
        edges = materialize(edges, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def salted_join(many: DataFrame, one: DataFrame, key: str, by: str, salts: int) -> DataFrame:
    """Left join of ``many`` with the one row that ``one`` has for a key.

    ``many`` is dealt by key and ``salts`` parts of ``by`` and ``one`` is told
    to each of them, so a key of very many rows is no single task.
    """
    left = many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "salt"], "left").drop("salt")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
