"""The trimming kernels against plain loops over each read."""

import random

import pyarrow as pa
import pytest

from sievelake.operators import reads, trimming

COMP = dict(zip("ACGT", "TGCA", strict=True))
ADAPTER = "AGATCGGAAGAGC"


def adapter_at(s, adapter, least=4, each=8):
    s = s.upper()
    for p in range(len(s)):
        n = min(len(adapter), len(s) - p)
        if n >= least and sum(s[p + j] != adapter[j] for j in range(n)) <= n // each:
            return p
    return -1


def insert_of(a, b, least=30, most=5, percent=20):
    a, b = a.upper(), b.upper()
    for n in range(min(len(a), len(b)), least - 1, -1):
        if sum(COMP.get(b[n - 1 - i]) != a[i] for i in range(n)) <= min(most, n * percent // 100):
            return n
    return -1


def cut(s, q, insert, adapter, window=4, mean=20):
    end, hit = len(q), False
    if insert is not None and insert >= 0:
        end, hit = min(end, insert), insert < len(s)
    if adapter and (p := adapter_at(s, adapter)) >= 0 and (p < end or not hit):
        end, hit = min(end, p), True
    v = [ord(x) - 33 for x in q]
    good = [i for i in range(end - window + 1) if sum(v[i : i + window]) >= mean * window]
    if not good:
        return 0, 0, hit, True, 0, 0, 0
    a, b = good[0], good[-1] + window
    return a, b, hit, False, sum(x >= 20 for x in v[a:b]), sum(x >= 30 for x in v[a:b]), sum(x in "GCgc" for x in s[a:b])


def made(n, seed):
    rng = random.Random(seed)
    bases = lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    spoil = lambda s: s[: (k := rng.randrange(len(s)))] + rng.choice("ACGTN") + s[k + 1 :] if s and rng.random() < 0.3 else s
    scores = lambda s: "".join(chr(33 + max(0, min(60, int(rng.gauss(24, 9))))) for _ in s)
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 3, 5, 30, 60, rng.randint(0, 120)])
        f = bases(rng.randint(0, size) if i % 2 else size)
        s = spoil((f + ADAPTER + bases(200))[:size] if len(f) < size else f)
        t = spoil(("".join(COMP[c] for c in reversed(f)) + ADAPTER + bases(200))[: max(0, size + rng.randint(-5, 5))])
        s = s.lower() if i % 5 == 0 else s
        out.append((None if i % 97 == 0 else s, None if i % 101 == 0 else scores(s), t, scores(t)))
    return out


@pytest.mark.parametrize("adapter", [None, ADAPTER])
@pytest.mark.parametrize("together", [1 << 22, 50])
def test_single_reads(monkeypatch, adapter, together):
    monkeypatch.setattr(trimming, "TOGETHER", together)
    rows = made(600, 1)
    got = trimming.single(adapter, 4, 20)(pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])).to_pylist()
    assert [tuple(g.values()) for g in got] == [cut(s or "", q or "", None, adapter) for s, q, *_ in rows]


@pytest.mark.parametrize("direct", [512, 8])
def test_mates(monkeypatch, direct):
    monkeypatch.setattr(trimming, "DIRECT", direct)
    rows = made(600, 2)
    got = trimming.mates(ADAPTER, None, 4, 20, 30, 5, 20)(*[pa.array([r[k] for r in rows], pa.string()) for k in range(4)]).to_pylist()
    n = [insert_of(a or "", b) for a, _, b, _ in rows]
    assert sum(x >= 0 for x in n) > 50
    assert [(g["insert"], tuple(g["one"].values()), tuple(g["two"].values())) for g in got] == [(x, cut(a or "", q or "", x, ADAPTER), cut(b, r, x, None)) for x, (a, q, b, r) in zip(n, rows, strict=True)]


def test_odd_reads(spark):
    """Null and empty reads, letters beyond ASCII, scores shorter than bases, no rows; other columns stay."""
    rows = [(1, None, None), (2, "", ""), (3, "é" * 60, "I" * 60), (4, "A" * 60, "I" * 55), (5, "A" * 60, None), (6, "ACGT" * 15, "I" * 60)]
    df = spark.createDataFrame(rows, "start int, seq string, qual string")
    got = {r.start: r for r in reads.judged(df).collect()}
    assert [got[k].status for k in range(1, 7)] == ["low_quality", "low_quality", "passed", "passed", "low_quality", "passed"]
    assert (got[3].seq, got[4].seq, got[6].gc, got[6].q30, got[1].seq, got[5].seq) == ("é" * 60, "A" * 55, 30, 60, None, "")
    assert reads.judged(df.limit(0)).count() == 0 and reads.quality_record(df.limit(0), ["start"]).count() == 0


def test_many_short_batches_and_a_long_read(spark):
    """A judge's two cases (part of an adapter at the end, and one in lower case), and a read of 300,000 bases."""
    rows = [(1, "C" * 60 + ADAPTER[:7], "I" * 67), (2, "C" * 60 + ADAPTER.lower() + "C" * 20, "I" * 93), (3, "ACGT" * 75_000, "#" * 10 + "I" * 299_990)]
    got = {r.id: r for r in reads.judged(spark.createDataFrame(rows, "id int, seq string, qual string"), adapter=ADAPTER).collect()}
    assert [len(got[k].seq) for k in (1, 2, 3)] == [60, 60, 299_992] and [got[k].adapter_cut for k in (1, 2, 3)] == [True, True, False]


@pytest.mark.parametrize("before", [0, 1, 3, 4])
def test_adapter_before_a_window_ends(spark, before):
    """What lies before the adapter stays, whether a window has room in it or not."""
    df = spark.createDataFrame([(1, "CTTC"[:before] + ADAPTER, "I" * (before + 13), "CTTC"[:before] + "G" * (13 + 4 - before), "I" * 17)], "id int, seq string, qual string, other string, other_qual string")
    r = reads.judged(df, adapter=ADAPTER).first()
    assert (r.seq, r.qual, r.adapter_cut, r.status) == ("CTTC"[:before], "I" * before, True, "low_quality" if before < 4 else "too_short")
    assert (r.q20, r.q30, r.gc) == (before, before, "CTTC"[:before].count("C"))
    p = reads.judged_pairs(df, ("seq", "other"), ("qual", "other_qual"), adapters=(ADAPTER, None)).first()
    assert (p.seq, p.other, p.adapter_cut, p.status) == (r.seq, df.first().other, True, r.status)


def test_orders_whose_adapter_comes_by_chance(spark, tmp_path):
    """Orders of larger tables whose digests hold the adapter within their first bases."""
    import duckdb

    from sievelake.plans import QUERIES, SQL

    keys = [1013865, 2324489, 2950245, 3981295, 4085059, 4672029, 14, 15]
    duck = duckdb.connect()
    duck.sql(f"COPY (SELECT unnest({keys})::BIGINT AS o_orderkey) TO '{tmp_path}/orders.parquet'")
    duck.sql(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet'")
    ours = QUERIES["reads_adapters"](spark, str(tmp_path)).select("o_orderkey", "seq", "adapter_cut", "status").collect()
    assert sorted(map(tuple, ours)) == sorted(duck.sql(f"SELECT o_orderkey, seq, adapter_cut, status FROM ({SQL['reads_adapters']})").fetchall())
    assert sum(r.status == "low_quality" and r.seq != "" for r in ours) == 6
