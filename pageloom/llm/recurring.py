"""Which 64-bit keys of a table of rows occur more than once, told back to each row.

The keys of a corpus are far too many to be shuffled as rows of their own, so
they travel as sorted blocks of bytes. Each task first joins its own rows: a
key that several of its rows hold is known to recur and is told to those rows
at once; the rest of the corpus sees one entry of it. A key that a third of
all rows hold thus costs one entry a task. What remains is dealt by ranges of
the keys, and each range answers the rows whose key other tasks hold too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams as g

#: keys that a task gathers before it sends them on
GATHERED = 1 << 20

_SENT = "part long, owner long, keys binary, extras binary, count long, body binary"
ZSTD = pa.Codec("zstd", compression_level=1)
_ANSWER = "owner long, keys binary, extras binary"


def parts_for(df: DataFrame, per_part: int = 4 << 20) -> int:
    """Number of key ranges, in proportion to the size of the input."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(max(64, size // per_part), 1 << 20))


def squeeze(body: bytes) -> bytes:
    return ZSTD.compress(body, asbytes=True)


def expand(body: bytes, size: int) -> bytes:
    return ZSTD.decompress(body, size, asbytes=True)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 8-byte numbers, compressed byte plane by byte plane (leading zeros cost nothing)."""
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T) for x in arrays]
    return squeeze(np.concatenate(planes).tobytes())


def unpacked(body: bytes, count: int, arrays: int) -> list[np.ndarray]:
    flat = np.frombuffer(expand(body, arrays * 8 * count), np.uint8).reshape(arrays, 8, count)
    return [np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in flat]


def read_keys(body: bytes) -> np.ndarray:
    return np.frombuffer(body, np.uint64)


class _Rows:
    def __init__(self) -> None:
        self.columns: dict[str, list] = {n.split()[0]: [] for n in _SENT.split(", ")}

    def add(self, **values) -> None:
        for name, column in self.columns.items():
            column.append(values.get(name))

    def batch(self) -> pa.RecordBatch:
        kinds = {"part": pa.int64(), "owner": pa.int64(), "count": pa.int64()}
        return pa.RecordBatch.from_arrays(
            [pa.array(v, kinds.get(n, pa.binary())) for n, v in self.columns.items()], names=list(self.columns))


def _to_owners(owners, keys, extras) -> Iterator[tuple[int, bytes, bytes]]:
    order = np.argsort(owners, kind="stable")
    owners, keys, extras = owners[order], keys[order], extras[order]
    begin = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]]) if len(owners) else np.zeros(0, int)
    for i, j in zip(begin, np.append(begin[1:], len(owners))):
        yield int(owners[i]), keys[i:j].tobytes(), extras[i:j].tobytes()


def _send(keys, owners, extras, ranks, parts: int, distinct: bool) -> pa.RecordBatch:
    """One gathered lot: entries by key range, answers that are known already."""
    order = np.lexsort((ranks, keys))
    keys, owners, extras, ranks = keys[order], owners[order], extras[order], ranks[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    last = np.append(begin[1:], len(keys)) - 1
    if distinct:  # owners of one rank are all told: only the first of them is known to other lots
        many = (ranks[begin] != ranks[last]) | (np.minimum.reduceat(owners, begin) != np.maximum.reduceat(owners, begin))
    else:
        many = last > begin
    rows = _Rows()
    known = np.repeat(many, last - begin + 1)
    for owner, k, x in _to_owners(owners[known], keys[known], extras[known]):
        rows.add(part=owner % parts, owner=owner, keys=k, extras=x)
    sent = keys[begin]
    part = _part(sent, parts)
    cut = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(cut[1:] > cut[:-1]):
        i, j = cut[p], cut[p + 1]
        at = begin[i:j]
        rows.add(part=int(p), count=int(j - i), body=packed(
            np.diff(sent[i:j], prepend=np.uint64(0)), owners[at].view(np.uint64), extras[at], many[i:j].astype(np.uint64)))
    return rows.batch()


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _answer(then: Callable | None):
    def answer(table: pa.Table) -> pa.Table:
        known = table.filter(pa.compute.is_valid(table.column("owner"))).select(["owner", "keys", "extras"])
        told = table.filter(pa.compute.is_null(table.column("owner")))
        out_owner, out_keys, out_extras = [], [], []
        if told.num_rows:
            lots = [unpacked(b, n, 4) for b, n in zip(told.column("body").to_pylist(), told.column("count").to_pylist())]
            keys = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in lots])
            owners, extras, many = (np.concatenate([x[c] for x in lots]) for c in (1, 2, 3))
            owners, many = owners.view(np.int64), many.astype(bool)
            order = np.argsort(keys, kind="stable")
            keys, owners, extras, many = keys[order], owners[order], extras[order], many[order]
            same = keys[1:] == keys[:-1]
            again = np.r_[False, same] | np.r_[same, False]
            again &= ~many  # those were answered where they are
            for owner, k, x in _to_owners(owners[again], keys[again], extras[again]):
                out_owner.append(owner)
                out_keys.append(k)
                out_extras.append(x)
        out = pa.table({"owner": pa.array(out_owner, pa.int64()), "keys": pa.array(out_keys, pa.binary()),
                        "extras": pa.array(out_extras, pa.binary())})
        out = pa.concat_tables([known.cast(out.schema), out]) if known.num_rows else out
        return out if then is None else then(out)

    return answer


def recurring(df: DataFrame, keys_of: Callable, parts: int, *, distinct: bool = False,
              gathered: int = GATHERED, then: Callable | None = None, schema: str = _ANSWER) -> DataFrame:
    """Rows (owner, keys, extras) of the keys that recur; an owner may have several rows.

    ``keys_of(batch)`` yields (keys, owners, extras, ranks) arrays for slices of
    an Arrow batch: a 64-bit key, the number of the row that holds it, 64 bits
    that are handed back with it, and with ``distinct`` the 64-bit number that
    must differ for a key to count as recurring (without, any second occurrence
    counts); owners of one rank and copies that meet only across tasks count as recurring too,
    so ``distinct`` gives a superset for an exact step to come. ``then`` turns the answers of a range into rows of ``schema``. ``keys`` and ``extras`` of the result are arrays of 8-byte numbers.
    """

    def run(batches):
        lots, size = [], 0
        for batch in batches:
            for lot in keys_of(batch):
                if len(lot[0]):
                    lots.append(lot)
                    size += len(lot[0])
                if size >= gathered:
                    yield _send(*(np.concatenate(x) for x in zip(*lots)), parts, distinct)
                    lots, size = [], 0
        if lots:
            yield _send(*(np.concatenate(x) for x in zip(*lots)), parts, distinct)

    return df.mapInArrow(g.tidy(run), _SENT).groupBy("part").applyInArrow(_answer(then), schema)


def by_owner(answers: DataFrame) -> DataFrame:
    """One row (owner, keys, extras arrays of binary) for each owner that has recurring keys."""
    return answers.groupBy("owner").agg(F.collect_list("keys").alias("keys"), F.collect_list("extras").alias("extras"))
