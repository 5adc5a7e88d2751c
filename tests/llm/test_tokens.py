"""Operators 11 to 13 against the tokenizer libraries and plain loops, on small tables with nulls, blanks, repeats and clashing names."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievelake.llm import alignment, bpe, prefix_bpe, queries, resampling

ODD = ["a", "b", "the", " ", " ", "  ", "\n", "\t", "é", "1", "23", "'s", "'", "<|endoftext|>", "<|end", "<s>", "日本", "😀", "　", "\x1c", "\x85", "ﬁ", "ing", "tion", " th", "\xa0", "​", "!", "--", "\x00", "▁", "Hello", "Ġ", "՘", "\U00010940", "�"]
KIND = "doc_id long, text string, block long, k int, chunk string, n long, a int, b int, ids string, score double, range int, words int, rank string"


def odd_texts(n, seed, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(1, longest))) for _ in range(n)]


ROWS = [(k, t) for k, t in enumerate([None, "", " ", "  ", "\n", " a", "a ", "a  b", "aaaa" * 300, "x" * 5000, "word " * 400, "the the the", "▁", "a▁b", *odd_texts(80, 2), *[x.replace("▁", "") for x in odd_texts(3, 3, 3000)]])]
ROWS += [(k, t) for k, t in ROWS if k % 20 == 0] + [(None, "no id at all"), (None, None), (-3, "minus three")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, 2, "c", 3, 4, 5, "i", 0.5, 7, 8, "r") for i, t in ROWS], KIND).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def as_rows(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.public_path(prefix_bpe.TOKENIZER))


def test_prefix_bpe_equals_the_library(docs, empty, library):
    want = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False))))
    assert as_rows(prefix_bpe.digests(docs).collect()) == as_rows(want)
    whole = {r.doc_id: r for r in prefix_bpe.encoded(docs).filter("doc_id IS NOT NULL").collect()}
    assert all(whole[i].decoded == (t or "") and list(whole[i].ids) == library.encode(t or "", add_special_tokens=False).ids for i, t in ROWS if i is not None)
    assert prefix_bpe.digests(empty).count() == 0 == prefix_bpe.encoded(empty).count()


def test_prefix_bpe_on_many_texts(library):
    e = prefix_bpe.encoder(bpe.public_path(prefix_bpe.TOKENIZER), bpe.public_pattern())
    rng = random.Random(7)
    texts = odd_texts(4000, 5) + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 24))) for _ in range(3000)] + [rng.choice("aeths ") * rng.randint(1, 80) + "ab" * rng.randint(0, 9) for _ in range(500)]
    for t, r in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = e.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == r.ids and e.decode(ids).decode() == library.decode(r.ids, skip_special_tokens=False)
    library.encode_special_tokens = True
    plain = library.encode("a<|endoftext|>b", add_special_tokens=False).ids
    library.encode_special_tokens = False
    assert np.frombuffer(e.encode("a<|endoftext|>b", special=False), "<u4").tolist() == plain


def test_only_listed_pairs_merge():
    """Tokens whose bytes together are a token's, but which aren't its pair, stay apart."""
    rng = random.Random(3)
    ids = {x.encode(): k for k, x in enumerate(["a", "b", "c", "ab", "bc", "abc", "ca", "bcab"])}
    pairs = [(b"a", b"b"), (b"b", b"c"), (b"a", b"bc"), (b"c", b"a"), (b"bc", b"ab")]
    v = prefix_bpe.Merges(ids, pairs)
    for _ in range(3000):
        piece = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14))).encode()
        assert bpe.PrefixEncoding(v, piece).ids() == v.merged(piece), piece
    with pytest.raises(ValueError):
        prefix_bpe.Merges(ids, [*pairs, (b"ab", b"c")])


def aligned(rows):
    a, b = Tokenizer.from_file(bpe.public_path(prefix_bpe.TOKENIZER)), sentencepiece.SentencePieceProcessor(model_file=bpe.public_path(alignment.PIECES))
    a.encode_special_tokens = True
    t = alignment.Two(bpe.public_path(prefix_bpe.TOKENIZER), bpe.public_path(alignment.PIECES))
    counts, out = Counter(), []
    for i, text in rows:
        x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        raw = (" " + (text or "")).encode()
        if not text or b"".join(t.a_bytes[k] for k in x) != raw or b"".join(t.b_bytes[k] for k in y) != raw:
            out.append((i, 0, 0, [], ""))
            continue
        ends = {int(e): k for k, e in enumerate(np.cumsum([len(t.b_bytes[k]) for k in y]))}
        links, groups, p, q = [], [], 0, 0
        for k, e in enumerate(np.cumsum([len(t.a_bytes[k]) for k in x]).tolist()):
            if e in ends:
                j = ends[e]
                links.append((x[k], y[j]))
                groups.append(",".join(map(str, x[p : k + 1])) + "|" + ",".join(map(str, y[q : j + 1])))
                p, q = k + 1, j + 1
        counts.update(links)
        out.append((i, len(x), len(y), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, k), n in counts.items():
        most[k] = max(most[k], n)
    return [(i, n, m, len(ls), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), g) for i, n, m, ls, g in out]


@pytest.mark.parametrize("bounds", [(96 << 20, 1 << 21, 4096), (200, 7, 2)])
def test_alignment_equals_plain_loops(docs, empty, monkeypatch, bounds):
    """Also with blocks of a few chunks, and chunks whose places fill several rows."""
    for name, value in zip(("BLOCK_BYTES", "BLOCK_KINDS", "PLACES"), bounds, strict=True):
        monkeypatch.setattr(alignment, name, value)
    want = aligned(ROWS)
    assert any(r[1] == 0 for r in want) and sum(r[1] for r in want) > 4000
    assert as_rows(alignment.aligned(docs).collect()) == as_rows(want)
    assert as_rows(alignment.digests(docs).collect()) == as_rows([(*r[:-1], sha(r[-1]) if r[-1] else "") for r in want])
    assert alignment.digests(empty).count() == 0


def test_chunks_are_encoded_alone_as_in_the_text():
    t = alignment.Two(bpe.public_path(prefix_bpe.TOKENIZER), bpe.public_path(alignment.PIECES))
    for text in odd_texts(4000, 11):
        whole = t.ids([text])[0]
        found = alignment.chunks(text)
        assert "".join(" " + c for c in found) == " " + text
        if t.exact(text):
            parts = t.ids(found)
            assert whole == ([k for p in parts for k in p[0]], [k for p in parts for k in p[1]]), text
        else:
            assert "▁" in text


def test_alignment_needs_no_exchange_of_tokens(spark):
    from sievelake.llm.common import bucketed

    rows = spark.createDataFrame([("ab", 0, [257, 514], [257, 514])], "chunk string, part int, a array<int>, b array<int>")
    units = bucketed(rows.repartition(4, "chunk"), 4, "chunk")
    with alignment._clustered_by_less(spark):
        plan = alignment.grouped(units, ["chunk", "part"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2 and plan.count("Generate posexplode") == 2
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return "".join(c if ord(c) > 127 or c in "0123456789abcdefghijklmnopqrstuvwxyz" else " " for c in low).split(" ")


def resampled(rows, target, least=20, percent=5, seed=42):
    def features(t):
        w = [x for x in words(t) if x]
        return len(w), [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]

    bucket = lambda f: crc32(f.encode()) % 10_000
    of = [(i, *features(t)) for i, t in rows]
    s, t = (Counter(bucket(f) for fs in x for f in fs) for x in ([fs for _, _, fs in of], [features(y)[1] for y in target]))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (ns + 10_000) / ((s[k] + 1) * (nt + 10_000))))
    out = []
    for i, n, fs in of:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in out if r[0] is not None and r[1] >= least), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100], 1):
        r[5] = k
    return out


@pytest.mark.parametrize("percent", [5, 37, 100])
def test_resampling_equals_plain_loops(spark, docs, empty, monkeypatch, percent):
    monkeypatch.setattr(resampling, "SORTED_EACH", 10)
    aim = ["the word Word a b", None, "", "é日本 the the"] + odd_texts(30, 8, 60)
    target = spark.createDataFrame([(t,) for t in aim], "text string")
    want = resampled(ROWS, aim, 5, percent)
    assert as_rows(resampling.resample(docs, target, least=5, percent=percent).collect()) == as_rows(want)
    assert sum(r[5] is not None for r in want) == percent * sum(r[1] >= 5 and r[0] is not None for r in want) // 100 >= percent // 10
    assert resampling.resample(empty, target).count() == 0
    assert as_rows(resampling.resample(docs, target.limit(0), least=5, percent=percent).collect()) == as_rows(resampled(ROWS, [], 5, percent))


def test_ties_go_to_the_smaller_id(spark):
    rows = [(k, 30, 1, 0, 5 - k // 10, ) for k in range(40)]
    scores = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(6)
    got = {r.doc_id: r["rank"] for r in resampling.drawn(scores, percent=50).collect()}
    assert got == {k: k + 1 if k < 20 else None for k in range(40)}


def test_crcs_of_runs():
    rng = random.Random(1)
    texts = [b"".join(rng.choice([b"a", b"bc", b"\xc3\xa9", b"1", b" "]) for _ in range(rng.randint(0, 40))).split() for _ in range(50)]
    counts = np.array(list(map(len, texts)))
    for longest in (1, 2, 3, 5):
        stream, sizes = resampling.buckets([w for t in texts for w in t], counts, longest, 997)
        want = [[crc32(b" ".join(t[e - n + 1 : e + 1])) % 997 for e in range(len(t)) for n in range(1, longest + 1) if n <= e + 1] for t in texts]
        assert stream.tolist() == [x for w in want for x in w] and sizes.tolist() == list(map(len, want))
    long = [b"x" * 3000, b"y" * 70_000]
    assert resampling.buckets(long, np.array([2]), 2, 10_000)[0].tolist() == [crc32(x) % 10_000 for x in (long[0], long[1], b" ".join(long))]


def test_registered_queries(spark, small):
    """The queries without SQL on the driver's smallest table."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert as_rows(queries.queries()["op11_alignment"](spark, small).collect()) == as_rows([(*r[:-1], sha(r[-1]) if r[-1] else "") for r in aligned(rows)])
    found = {r.doc_id: r for r in queries.queries()["op12_prefix_bpe"](spark, small).collect()}
    t = Tokenizer.from_file(bpe.public_path(prefix_bpe.TOKENIZER))
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert tuple(found[i])[1:] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False)))
    assert queries.queries()["op13_resampling"](spark, small).filter(F.col("rank").isNotNull()).count() > 0
