"""Compare registered queries with their SQL on DuckDB: rows, columns, values.

    python tests/oracle_check.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 9) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if hasattr(value, "as_tuple"):
        return ("decimal", str(value))
    return value


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    data = sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)
    return names, data


def compare(spark, con, fn, sql, sf_dir):
    """None when both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    got = as_rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got[1] else "no rows", len(got[1])
    rel = con.sql(sql)
    want = as_rows(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1])
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}", len(got[1])
    for a, b in zip(got[1], want[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"values\n   spark {str(a)[:600]}\n   duck  {str(b)[:600]}", len(got[1])
    return None, len(got[1])


def main(argv):
    from pageloom.plans import catalog
    from pageloom.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    prefixes = tuple(argv[1:])
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            problem, n = compare(spark, con, fn, catalog.ORACLES.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1200]}", 0
        bad += problem is not None
        kind = "sql" if name in catalog.ORACLES else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:34s} {kind} {n:7d} rows {time.time() - t:6.2f}s"
              + (f"\n   {problem}" if problem else ""), flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
