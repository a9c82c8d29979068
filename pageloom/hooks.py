"""Where a user plugs in: cleaners, converters, models, scorers, callbacks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import html as h
from .operators.cleaning import STRATEGIES, Strategy


def add_strategy(strategy: Strategy, strategies=STRATEGIES) -> tuple[Strategy, ...]:
    """A custom cleaning strategy, tried after those given."""
    return (*strategies, strategy)


def convert_documents(
    df: DataFrame, converters: dict[str, Callable[[bytes], str]], out: str = "clean_content"
) -> DataFrame:
    """Fill ``out`` for strategies that need a converter from bytes to text.

    Expects ``strategy`` and ``bytes``. A converter that raises gives NULL and
    its message in ``convert_error``, so one bad file stops nothing.
    """

    @F.pandas_udf("struct<text:string,error:string>")
    def convert(strategy: pd.Series, payload: pd.Series) -> pd.DataFrame:
        rows = []
        for name, data in zip(strategy, payload):
            fn = converters.get(name)
            if fn is None or data is None:
                rows.append((None, None))
                continue
            try:
                rows.append((fn(bytes(data)), None))
            except Exception as e:  # noqa: BLE001 - any converter error becomes a row
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    wanted = F.col("strategy").isin(*converters)
    done = convert(F.col("strategy"), F.when(wanted, F.col("bytes")))
    return (
        df.withColumn("_converted", done)
        .withColumn(out, F.coalesce(F.col("_converted")["text"], F.col(out) if out in df.columns else F.lit(None)))
        .withColumn("convert_error", F.col("_converted")["error"])
        .drop("_converted")
    )


def for_each_page(df: DataFrame, callback: Callable[[str, str, dict], None]) -> None:
    """Call back once per crawled page, on the executors."""

    def run(rows: Iterator) -> None:
        for row in rows:
            callback(row["url"], row["content"], row["metadata"])

    df.select("url", "content", "metadata").foreachPartition(run)


def pair_scorer(score: Callable[[pd.Series, pd.Series], pd.Series]) -> Callable[[Column, Column], Column]:
    """A reranker over (query, text) batches as a column function."""

    @F.pandas_udf("double")
    def scorer(query: pd.Series, text: pd.Series) -> pd.Series:
        return score(query, text)

    return scorer


def process_tasks(df: DataFrame, processor: Callable[[dict], dict], result: str) -> DataFrame:
    """Run a task processor on each row; errors become rows with ``error``.

    ``result`` is the DDL of what the processor returns.
    """
    schema = T.StructType(
        [*df.schema.fields, T.StructField("result", T.StructType.fromDDL(result)), T.StructField("error", T.StringType())]
    )
    names = [f.name for f in T.StructType.fromDDL(result).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            results, errors = [], []
            for row in pdf.to_dict("records"):
                try:
                    got = processor(row)
                    results.append({n: got.get(n) for n in names})
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - any task error becomes a row
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(result=results, error=errors)

    return df.mapInPandas(run, schema)


def register_page_links(spark: SparkSession, name: str = "page_links") -> None:
    """``name(html)`` as a SQL table function: (pos, href) of a page.

    A SQL function is inlined into the query plan, so it runs in the JVM. Its
    body is the SQL text of ``html.hrefs``, so both give the same links.
    """
    # operators are printed like functions; their names need quotes then
    links = re.sub(r"(?<![\w`])(=|and|or|!)\(", r"`\1`(", h.hrefs(F.col("page"))._jc.node().sql())
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(page STRING)
        RETURNS TABLE (pos INT, href STRING)
        RETURN SELECT pos, href FROM (SELECT posexplode({links}) AS (pos, href)) t"""
    )
