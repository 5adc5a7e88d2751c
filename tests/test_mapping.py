"""Seeds, the banded comparison and whole mappings against plain loops, and reads with known edits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.operators import confusion, mapping
from sievelake.operators.host_index import _mixed

FLIP = str.maketrans("ACGT", "TGCA")
RNG = random.Random(6)


def bases(n):
    return "".join(RNG.choice("ACGT") for _ in range(n))


def edited(s, n):
    s = list(s)
    for _ in range(n):
        k, what = RNG.randrange(len(s)), RNG.randrange(3)
        if what == 0:
            s[k] = RNG.choice("ACGT".replace(s[k], "") or "A") if s[k] in "ACGT" else "A"
        elif what == 1 and len(s) > 1:
            del s[k]
        else:
            s.insert(k, RNG.choice("ACGT"))
    return "".join(s)


def plain_seeds(s, length=15, span=10):
    number = lambda p: sum("ACGT".index(c) << 2 * (length - 1 - j) for j, c in enumerate(p))
    parts = []
    for i in range(len(s) - length + 1):
        p = s[i : i + length].upper()
        parts.append((number(p), number(p.translate(FLIP)[::-1])) if set(p) <= set("ACGT") else None)
    out = set()
    for i in range(len(parts) - span + 1):
        w = parts[i : i + span]
        if None not in w:
            keys = [int(_mixed(np.array([min(x)], np.uint64))[0]) for x in w]
            k = keys.index(min(keys))
            out.add((min(w[k]), i + k, w[k][1] < w[k][0]))
    return sorted(out)


def test_seeds():
    rows = [bases(60), "", "ACG", bases(30).lower(), bases(20) + "N" + bases(40), "A" * 40, bases(24)]
    data = "".join(rows).encode()
    at = np.cumsum([0, *map(len, rows)])
    row, value, place, strand = mapping.seeds(np.frombuffer(data, np.uint8), at)
    for k, s in enumerate(rows):
        mine = row == k
        assert sorted(zip(value[mine].tolist(), place[mine].tolist(), strand[mine].tolist(), strict=True)) == plain_seeds(s), k


def plain_distance(read, part, width):
    """By a table of all prefixes, within the band."""
    inf = 10**6
    now = {b: 0 for b in range(width + 1)}
    for i, c in enumerate(read):
        new = {}
        for b in range(width + 1):
            x = now[b] + (c != (part[i + b] if i + b < len(part) else ""))
            x = min(x, now.get(b + 1, inf) + 1, new.get(b - 1, inf) + 1)
            new[b] = x
        now = new
    return min(now.values())


def test_banded_distances():
    made = []
    for _ in range(200):
        part = bases(RNG.randint(30, 60))
        a = RNG.randint(0, 10)
        made.append((edited(part[a : a + RNG.randint(1, 25)], RNG.randint(0, 4)), part))
    n, width = max(len(r) for r, _ in made), 14
    reads, parts = np.ones((len(made), n), np.uint8), np.zeros((len(made), n + width + 1), np.uint8)
    for k, (r, p) in enumerate(made):
        reads[k, : len(r)] = np.frombuffer(r.encode(), np.uint8)
        p = p[: n + width + 1]
        parts[k, : len(p)] = np.frombuffer(p.encode(), np.uint8)
    got = mapping.distances(reads, np.array([len(r) for r, _ in made]), parts, width)
    assert got.tolist() == [plain_distance(r, p[: n + width + 1], width) for r, p in made]


@pytest.fixture(scope="module")
def contigs():
    return {"one": bases(13_000), "two": bases(500), "three": bases(4096 + 100), "short": "ACGT", "none": None}


def test_reads_with_known_edits(spark, contigs):
    """Reads from both strands, from ends of contigs and across tiles, with as many edits as are allowed, and with none in common."""
    rows, want = [], {}
    for k in range(400):
        contig = ("one", "two", "three")[k % 3]
        s = contigs[contig]
        n = RNG.choice([60, 100, 150])
        a = RNG.choice([0, len(s) - n, max(0, min(len(s) - n, 4096 - n // 2)), RNG.randrange(len(s) - n)])
        read = edited(s[a : a + n], e := RNG.randint(0, n // 30))
        if k % 2:
            read = read.translate(FLIP)[::-1]
        rows.append((k, read.lower() if k % 5 == 0 else read))
        want[k] = (contig, bool(k % 2), a, e)
    strangers = [(1000 + k, bases(100)) for k in range(60)] + [(2000, None), (2001, ""), (2002, "ACGT"), (2003, "N" * 80)]
    host = mapping.prepared(spark.createDataFrame(list(contigs.items()), "name string, seq string"), "name")
    reads = spark.createDataFrame(rows + strangers, "id long, seq string").repartition(6)
    got = {r.id: r for r in mapping.hits(reads, host, "id").collect()}
    assert set(got) <= set(range(400)) and len(got) >= 398  # a read may have an edit in each of its seeds
    for k, r in got.items():
        contig, reverse, a, e = want[k]
        assert (r.contig, r.reverse) == (contig, reverse) and abs(r.begin - a) <= 24 and r.edits <= e
    flagged = mapping.mapped(reads, host, "id")
    assert flagged.count() == len(rows) + len(strangers) and flagged.filter("mapped").count() == len(got)
    pairs = flagged.withColumn("pair", F.when(F.col("id") < 400, F.col("id")).otherwise(F.col("id") - 1000))
    kept = {r.pair for r in confusion.pairs_kept(pairs, ["pair"], "mapped").collect()}
    assert kept == {k for k in range(1100) if k not in got and (k < 400 or k in {i - 1000 for i, _ in strangers})} | {i - 1000 for i, _ in strangers if i - 1000 not in got and i - 1000 >= 0}
    with pytest.raises(Exception, match="doesn't fit"):
        mapping.hits(spark.createDataFrame([(1, "A" * 2000)], "id long, seq string"), host, "id").count()
    assert mapping.hits(reads.limit(0), host, "id").count() == 0


def test_exact_edits_against_all_places(spark):
    """The best hit has the least edits of any place in the host, where that is few."""
    host = bases(900)
    rows = [(k, edited(host[a : a + 70], k % 7)) for k in range(60) for a in [RNG.randrange(830)]]
    at = mapping.prepared(spark.createDataFrame([("h", host)], "name string, seq string"), "name", most=None)
    got = {r.id: r.edits for r in mapping.hits(spark.createDataFrame(rows, "id long, seq string"), at, "id").collect()}
    best = {k: plain_distance(s, host, len(host)) for k, s in rows}
    assert len(got) > 50 and all(best[k] == n for k, n in got.items())
    assert all(best[k] > 0 and k not in got or k in got for k, _ in rows)
