"""Cleaning strategies: which one a page takes, and what it makes of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as h
from ..functions import text as tx
from ..functions import urls as u
from ..session import materialize

# Ids of the regions the page strategies look for.
MAIN_ID, CONTENT_ID = "main", "content"
DOCX, XLSX, PPTX = u.BINARY_TYPES[1], u.BINARY_TYPES[3], u.BINARY_TYPES[2]


@dataclass(frozen=True)
class Strategy:
    """``handles(url, mimetype, content)`` and ``clean(content)``, both on columns.

    ``function`` (text to text) is for cleaners that are no expression; it runs
    in Arrow batches.
    """

    name: str
    handles: Callable[[Column, Column, Column], Column]
    clean: Callable[[Column], Column] | None = None
    function: Callable[[str], str | None] | None = None


def _is(prefix: str):
    return lambda url, mime, content: mime.startswith(prefix)


def _common_page(url, mime, content):
    return mime.startswith("text/html") & u.path(url).contains("page/") & content.contains(f'id="{MAIN_ID}"')


def page_strategies(
    search_paths: tuple[str, ...] = (), content_drops: tuple[str, ...] = (), main_drops: tuple[str, ...] = ()
) -> tuple[Strategy, ...]:
    """The strategies of a site: paths of its search pages, and ids of elements to leave out.

    Order matters: the first strategy that handles a record takes it. Markdown
    and plain HTML ask for the same; both are here, Markdown wins.
    """

    def search_page(url, mime, content):
        return (
            mime.startswith("text/html")
            & u.any_of(u.path(url).contains(p) for p in search_paths)
            & content.contains(f'id="{CONTENT_ID}"')
        )

    def main_markdown(content: Column) -> Column:
        return h.page_markdown(h.main_region(content, (MAIN_ID,), main_drops))

    searches = [Strategy("search_page", search_page,
                         lambda c: h.page_markdown(h.main_region(c, (CONTENT_ID,), content_drops)))] if search_paths else []
    return (
        Strategy("pdf", _is("application/pdf")),
        Strategy("docx", _is(DOCX)),
        Strategy("office", lambda url, mime, content: mime.startswith(XLSX) | mime.startswith(PPTX)),
        *searches,
        Strategy("common_page", _common_page, main_markdown),
        Strategy("markdown", _is("text/html"), main_markdown),
        Strategy("html", _is("text/html"), h.page_text),
        Strategy("plain", _is("text/plain"), tx.clean_plain),
    )


STRATEGIES = page_strategies()
DISCARD_IMAGES = Strategy("image", _is("image/"), lambda c: F.lit(""))


def route(url: Column, mimetype: Column, content: Column, strategies=STRATEGIES) -> Column:
    chosen = F.lit(None).cast("string")
    for s in reversed(strategies):
        chosen = F.when(s.handles(url, mimetype, content), F.lit(s.name)).otherwise(chosen)
    return F.coalesce(chosen, F.lit("unchanged"))


@lru_cache(maxsize=16)
def _expressions(strategies: tuple[Strategy, ...], session_key: int) -> tuple[Column, Column]:
    """(strategy, cleaned content); built once per session, as each micro-batch needs them."""
    chosen = route(F.col("url"), F.col("mimetype"), F.col("content"), strategies)
    cleaned = F.when(F.col("strategy") == "unchanged", F.col("content"))
    names_by_cleaner: dict = {}
    for s in strategies:
        if s.clean is not None:
            names_by_cleaner.setdefault(s.clean, []).append(s.name)
    for cleaner, names in names_by_cleaner.items():
        cleaned = cleaned.when(F.col("strategy").isin(names), cleaner(F.col("content")))
    return chosen, cleaned


def clean(records: DataFrame, strategies=STRATEGIES, out: str = "clean_content") -> DataFrame:
    """Add the strategy taken and the cleaned content.

    Strategies without an expression (PDF, office files) give NULL here; they
    need a converter, see ``hooks.convert_documents``. Anything no strategy
    handles stays as it is.
    """
    chosen, cleaned = _expressions(tuple(strategies), id(records.sparkSession.sparkContext._jsc))
    return records.withColumn("strategy", chosen).withColumn(out, cleaned)


def _functions(records: DataFrame, strategies, out: str) -> DataFrame:
    """Records after the strategies that are functions, with the error of each record that one failed on."""
    functions = {s.name: s.function for s in strategies if s.function is not None}
    if not functions:
        return records.withColumn("clean_error", F.lit(None).cast("string"))

    @F.pandas_udf("text string, error string")
    def run(content: pd.Series, strategy: pd.Series) -> pd.DataFrame:
        rows = []
        for text, name in zip(content, strategy):
            try:
                rows.append((functions[name](text) if name in functions else None, None))
            except Exception as e:  # noqa: BLE001 - one record fails, not its batch
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    mine = F.col("strategy").isin(list(functions))
    done = records.withColumn("_done", run(F.when(mine, F.col("content")), "strategy"))
    return done.withColumns({
        out: F.when(mine, F.col("_done.text")).otherwise(F.col(out)), "clean_error": F.col("_done.error")}).drop("_done")


def clean_or_fail(
    records: DataFrame, strategies=STRATEGIES, key: str = "url", out: str = "clean_content",
    hold: Callable[[DataFrame, str], DataFrame] = materialize,
) -> tuple[DataFrame, DataFrame]:
    """(cleaned records, failed records with ``clean_error``): an error fails its record alone.

    Functions are guarded record by record. An expression that raises ends a
    whole job, so then the records are halved by a hash of ``key`` until those
    remain that fail by themselves: about ``2 log2(n)`` jobs for each, none
    while nothing fails. Records that do not differ in ``key`` fail together.
    ``hold`` writes each part under a name of its own and reads it back.
    """
    def attempt(rows: DataFrame, level: int, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
        try:
            done = hold(_functions(clean(rows, strategies, out), strategies, out), name)
            return [done.filter("clean_error IS NULL").drop("clean_error")], [
                done.filter("clean_error IS NOT NULL").select(*rows.columns, "clean_error")]
        except Exception as e:  # noqa: BLE001 - whatever a strategy raises
            if level == 48 or rows.limit(2).count() < 2:
                told = str(e).strip().split("\n")[0][:500]
                return [], [rows.withColumn("clean_error", F.lit(told))]
        parts: tuple[list, list] = [], []
        for half in (0, 1):
            fine, bad = attempt(rows.filter(F.pmod(F.shiftright(F.xxhash64(key), level), F.lit(2)) == half), level + 1, f"{name}{half}")
            parts[0].extend(fine)
            parts[1].extend(bad)
        return parts

    fine, bad = attempt(records, 0, "cleaned")
    if not fine:
        fine = [records.limit(0).withColumns({"strategy": F.lit(None).cast("string"), out: F.lit(None).cast("string")})]
    return reduce(DataFrame.unionByName, fine), reduce(DataFrame.unionByName, bad)
