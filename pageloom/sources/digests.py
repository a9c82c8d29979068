"""SHA-256 of files that are too large for one task.

SHA-256 is sequential, but its state is small. A task hashes one block of a
file and hands out the state; the task of the next block goes on from it.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: room for OpenSSL's SHA256_CTX, which has 112 bytes and no pointers
_STATE = 128
#: files whose plans are held at a time
_TOGETHER = 256
_FED = "path string, state binary, fed long, start long, size long"
_BOM = b"\xef\xbb\xbf"


@functools.cache
def _crypto():
    """OpenSSL as Python's hashlib loads it, or None; hashlib itself does not give its state away."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        lib.SHA256_Init.argtypes = (ctypes.c_void_p,)
        lib.SHA256_Update.argtypes = (ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t)
        lib.SHA256_Final.argtypes = (ctypes.c_char_p, ctypes.c_void_p)
    except (ImportError, AttributeError, OSError):
        return None
    state = _update(lib, _update(lib, _start(lib), b"a" * 70), b"b" * 70)
    return lib if _finish(lib, state) == hashlib.sha256(b"a" * 70 + b"b" * 70).hexdigest() else None


def _start(lib) -> bytes:
    state = ctypes.create_string_buffer(_STATE)
    lib.SHA256_Init(state)
    return state.raw


def _update(lib, state: bytes, *pieces: bytes) -> bytes:
    held = ctypes.create_string_buffer(state, _STATE)
    for piece in pieces:
        lib.SHA256_Update(held, piece, len(piece))
    return held.raw


def _finish(lib, state: bytes) -> str:
    out = ctypes.create_string_buffer(32)
    lib.SHA256_Final(out, ctypes.create_string_buffer(state, _STATE))
    return out.raw.hex()


def literal(path: str) -> str:
    """A path that readers do not take for a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def can_split(spark: SparkSession, path: str) -> bool:
    """Whether the file can be hashed by blocks: its state can be kept, and readers of lines do not decompress it."""
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    return _crypto() is not None and codecs.getCodec(spark._jvm.org.apache.hadoop.fs.Path(path)) is None


def _feed(path: str, state: bytes, fed: int) -> Callable[[Iterable], Iterator]:
    """One row: the state after the lines of a block, each with the line feed before it; -1 fed: the file's first line has none."""

    def run(batches):
        lib, now, n, places = _crypto(), state, fed, set()
        if lib is None:
            raise RuntimeError("the driver's Python has SHA256_Update of OpenSSL, this executor's has not")
        for b in batches:
            if b.num_rows:
                lines = b"\n" + b"\n".join(b.column(0).to_pylist())
                now = _update(lib, now, lines[1:] if n < 0 else lines)
                n += len(lines)
                places.update((start, b.column(2)[0].as_py()) for start in b.column(1).unique().to_pylist())
        if len(places) > 1:
            raise RuntimeError(f"{path}: a task got several blocks, {sorted(places)}")
        for start, size in places:
            yield pa.RecordBatch.from_pylist([{"path": path, "state": now, "fed": n, "start": start, "size": size}])

    return run


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The file's bytes cut at line feeds only, a partition for each block."""
    return spark.read.option("lineSep", "\n").text(literal(path)).select(
        F.col("value").cast("binary"), "_metadata.file_block_start", "_metadata.file_block_length")


def _hash_together(spark: SparkSession, files: list[tuple[str, int]]) -> dict[str, str]:
    lib, sc, hashes = _crypto(), spark.sparkContext, {}
    lines = {path: _lines(spark, path) for path, _ in files}
    blocks = {path: df.rdd.getNumPartitions() for path, df in lines.items()}
    length = dict(files)
    # block to read, state, bytes fed, bytes a byte order mark takes, which readers of lines leave out
    todo = {path: (0, _start(lib), -1, 0) for path in lines}
    while todo:
        rdds, parts, before = [], [], 0
        for path, (at, state, fed, _) in todo.items():
            rdds.append(lines[path].mapInArrow(_feed(path, state, fed), _FED).rdd)
            parts.append(before + at)
            before += blocks[path]
        got = {r.path: r for r in sc.runJob(sc.union(rdds), list, parts)}
        for path, (at, state, fed, mark) in list(todo.items()):
            after = at + 1
            if r := got.get(path):
                if r.start != at * r.size and after < blocks[path]:
                    raise RuntimeError(f"{path}: block {at} begins at byte {r.start}")
                state, fed = bytes(r.state), r.fed
                if after < blocks[path]:  # a block within one line holds the start of none
                    after = max(after, fed // r.size)
            if after < blocks[path]:
                todo[path] = (after, state, fed, mark)
                continue
            rest = length[path] - mark - fed
            if rest in (3, 4) and not mark:
                todo[path] = (0, _update(lib, _start(lib), _BOM), -1, len(_BOM))
            elif rest in (0, 1):
                hashes[path] = _finish(lib, _update(lib, state, b"\n" * rest))
                del todo[path]
            else:
                raise RuntimeError(f"{path}: {rest} of {length[path]} bytes were not met; did it change?")
    return hashes


def block_hashes(spark: SparkSession, files: list[tuple[str, int]]) -> list[tuple[str, int, str]]:
    """(path, length, SHA-256) of files of (path, length).

    One job a round, one task a file, one block a task: blocks are Spark's
    splits, so ``spark.sql.files.maxPartitionBytes`` bounds what a task reads,
    up to the end of its last line. Rounds: blocks of the largest file.
    """
    files = sorted(files, key=lambda x: -x[1])
    hashes = {}
    for k in range(0, len(files), _TOGETHER):
        hashes |= _hash_together(spark, files[k:k + _TOGETHER])
    return [(path, length, hashes[path]) for path, length in files]
