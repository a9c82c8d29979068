import hashlib
import random

import pytest

from pageloom.sources import digests, records


@pytest.fixture
def setting(spark):
    held = {}

    def put(key, value):
        held.setdefault(key, spark.conf.get(key))
        spark.conf.set(key, value)

    yield put
    for key, value in held.items():
        spark.conf.set(key, value)


def test_a_large_table_file_is_not_one_row(spark, setting, tmp_path):
    import __spark_entry__

    piece = random.Random(1).randbytes(1 << 20)
    (tmp_path / "large.parquet").write_bytes(piece * 65 + b"end")
    (tmp_path / "small.parquet").write_bytes(piece)
    setting("spark.sql.sources.binaryFile.maxLength", 64 << 20)
    setting("spark.sql.files.maxPartitionBytes", "16m")
    got = {r.file: r for r in __spark_entry__.queries()["s10_binary_files"](spark, str(tmp_path)).collect()}
    for name in ("large.parquet", "small.parquet"):
        data = (tmp_path / name).read_bytes()
        assert (got[name].length, got[name].content_hash) == (len(data), hashlib.sha256(data).hexdigest())
    assert len(got) == 2


def test_hash_by_blocks_equals_the_hash_of_the_whole(spark, setting, tmp_path):
    r = random.Random(2)
    data = r.randbytes(100_000)
    contents = {
        "plain.pdf": data,
        "ends with a line feed.pdf": data + b"\n",
        "[a]*{b,c}.pdf": data[::-1],
        "mark.docx": b"\xef\xbb\xbf" + data,
        "mark and line feed.docx": b"\xef\xbb\xbf" + data + b"\n",
        "one line.docx": data.replace(b"\n", b""),
        "line feeds.docx": b"\n" * 30_000,
        "returns.docx": b"\r\n\r" * 10_000,
        "long line.docx": data[:5000] + b"x" * 50_000 + data[5000:],
        "packed.gz": data,
        "edges.docx": (b"y" * 8191 + b"\n") * 5,
        "past edges.docx": (b"y" * 8192 + b"\n") * 5,
        "small.docx": b"z",
    }
    (tmp_path / "sub").mkdir()
    for name, content in contents.items():
        (tmp_path / "sub" / name).write_bytes(content)
    setting("spark.sql.files.maxPartitionBytes", 8192)
    got = {x.path.rsplit("/", 1)[1]: x for x in records.file_hashes(spark, str(tmp_path), whole=1000).collect()}
    assert {k: x.content_hash for k, x in got.items()} == {k: hashlib.sha256(c).hexdigest() for k, c in contents.items()}
    assert {k: x.length for k, x in got.items()} == {k: len(c) for k, c in contents.items()}
    assert (got["plain.pdf"].mimetype, got["plain.pdf"].kind) == ("application/pdf", "binary")


def test_files_beyond_those_held_together(spark, setting, tmp_path, monkeypatch):
    for k in range(5):
        (tmp_path / f"{k}.pdf").write_bytes(random.Random(k).randbytes(3000 + 5000 * k))
    monkeypatch.setattr(digests, "_TOGETHER", 2)
    setting("spark.sql.files.maxPartitionBytes", 4096)
    got = {x.path.rsplit("/", 1)[1]: x.content_hash for x in records.file_hashes(spark, str(tmp_path), whole=1000).collect()}
    assert got == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
