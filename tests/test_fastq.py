"""FASTQ files of all kinds read in ranges of every size, against the lines of the file."""

import gzip
import random
import struct
import zlib

import pytest

from sievelake.sources import fastq, readers


def blocks(data, size):
    """Gzip in blocks that state their size, with an empty one at the end."""
    out = []
    for part in [data[a : a + size] for a in range(0, len(data), size)] + [b""]:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = z.compress(part) + z.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(packed) + 25)
        out.append(head + packed + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def made(n, seed=1, feed="\n"):
    rng = random.Random(seed)
    rows = [(f"@r{k}/1 {'é' * (k % 3)}", "".join(rng.choice("ACGT") for _ in range(k % 17)), rng.choice(["+", f"+r{k}"]), "".join(rng.choice("@+I#") for _ in range(k % 17))) for k in range(n)]
    return rows, "".join(feed.join(r) + feed for r in rows).encode()


def read(path, size, step, known=True):
    """Straight through the readers of all ranges, as tasks would."""
    options = {"files": f'[["{path}", {size}]]', "step": str(step)}
    counts = []
    if known:
        r = fastq.FastqReader(options | {"counting": "true"})
        counts = [tuple(x.values()) for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]
        options["counts"] = str([list(c) for c in counts]).replace("'", '"')
    r = fastq.FastqReader(options)
    return [tuple(x.values())[1:] for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]


@pytest.mark.parametrize("known", [True, False])
@pytest.mark.parametrize("feed", ["\n", "\r\n"])
def test_every_cut_of_a_plain_file(tmp_path, known, feed):
    rows, data = made(40, feed=feed)
    path = tmp_path / "a.fastq"
    path.write_bytes(data)
    for step in [*range(1, 60), 200, 501, 5000]:
        got = read(path, len(data), step, known)
        assert [r[1:] for r in got] == rows, step
        if known:
            assert [r[0] for r in got] == list(range(40))


@pytest.mark.parametrize("known", [True, False])
def test_every_cut_of_blocks(tmp_path, known):
    rows, data = made(300)
    for size in (50, 700, 4000):
        packed = blocks(data, size)
        path = tmp_path / f"{size}.fastq.gz"
        path.write_bytes(packed)
        assert gzip.decompress(packed) == data and fastq.kind_of(packed) == "blocks"
        for step in (1 << 20, 5000, 1500, 333, 100):
            got = read(path, len(packed), step, known)
            assert [r[1:] for r in got] == rows, (size, step)
            assert not known or [r[0] for r in got] == list(range(300))


def test_streams_are_one_range(tmp_path):
    rows, data = made(200)
    path = tmp_path / "a.fastq"  # what it is, its name doesn't tell
    packed = gzip.compress(data[:1500]) + gzip.compress(data[1500:]) + bytes(7)
    path.write_bytes(packed)
    assert [r[1:] for r in read(path, len(packed), 100)] == rows == [r[1:] for r in read(path, len(packed), 100, False)]
    path.write_bytes(packed[:-20])
    with pytest.raises((ValueError, zlib.error)):
        read(path, len(packed) - 20, 100)


def test_lines_that_could_be_headers(tmp_path):
    """Records in which scores pass for headers are told by counting lines."""
    rows = [("@A", "+C", "+X", "@I")] * 50
    data = "".join("\n".join(r) + "\n" for r in rows).encode()
    path = tmp_path / "a.fastq"
    path.write_bytes(data)
    for step in (7, 13, 64, 300):
        assert [r[1:] for r in read(path, len(data), step, False)] == rows


def test_ends_of_files(tmp_path):
    path = tmp_path / "a.fastq"
    for data, want in [(b"@a\nAC\n+\nII\n\n\n", [("@a", "AC", "+", "II")]), (b"@a\nAC\n+\nII", [("@a", "AC", "+", "II")]), (b"@a\nAC\n+\nII\n@b\nA", [("@a", "AC", "+", "II"), ("@b", "A", None, None)]), (b"\n", []), (b"@a\n\n+\n\n", [("@a", "", "+", "")]), (b"@\xff\xc3a\nA\n+\nI\n", [("@a", "A", "+", "I")])]:
        path.write_bytes(data)
        for step in (1, 3, 5, 100):
            assert [r[1:] for r in read(path, len(data), step)] == want, (data, step)


def test_through_spark(spark, tmp_path, monkeypatch):
    """Several files in several ranges; places are exact; one scan; other settings while a plan waits change nothing."""
    rows, data = made(500)
    (tmp_path / "a.fastq").write_bytes(data)
    (tmp_path / "b.fastq.gz").write_bytes(blocks(data, 900))
    (tmp_path / "c.fastq.gz").write_bytes(data)
    (tmp_path / "d.fastq.gz").write_bytes(b"")
    monkeypatch.setattr(fastq, "STEP", 2000)
    df = readers.fastq(spark, str(tmp_path), ids_only=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Exchange" not in plan and df.rdd.getNumPartitions() > 12
    monkeypatch.setattr(fastq, "STEP", 700)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    got = sorted((r.path.split("/")[-1], *tuple(r)[1:]) for r in df.collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    assert readers.fastq(spark, str(tmp_path / "a.fastq")).rdd.getNumPartitions() > len(data) // 1100
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((f, k, *r) for f in ("a.fastq", "b.fastq.gz", "c.fastq.gz") for k, r in enumerate(rows))
    ids = readers.kept_ids(spark, str(tmp_path), "n1")
    assert ids.count() == 1500 and {r.read_id for r in ids.collect()} == {f"r{k}" for k in range(500)}
    with pytest.raises(Exception, match="isn't gzip"):
        readers.fastq(spark, str(tmp_path), strict=True).count()
    fastq.register(spark)
    assert spark.read.format(fastq.NAME).option("pathGlobFilter", "b*").load(str(tmp_path)).count() == 500


def test_stores_that_only_spark_reads(spark, tmp_path, monkeypatch):
    rows, data = made(60)
    (tmp_path / "a.fastq").write_bytes(data + b"\n")
    monkeypatch.setattr(fastq, "readable", lambda path: False)
    got = readers.fastq(spark, str(tmp_path), ids_only=False).orderBy("index").collect()
    assert [tuple(r)[1:] for r in got] == [(k, *r) for k, r in enumerate(rows)]
    assert readers.kept_ids(spark, str(tmp_path), "n1").count() == 60
