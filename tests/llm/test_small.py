"""The corpus operators against brute force, on small tables with nulls, blanks, ties, repeats and extra columns."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievelake.llm import bpe, common, exact_dedup, hamming_search, language, mixing, near_dedup, quality, substring_dedup, suffix_dedup, token_counts
from sievelake.llm.graph import components

RNG = random.Random(5)
WORDS = [f"w{k}" for k in range(400)] + ["Éa", "ß", "漢"]
KIND = "doc_id long, text string, lang string, source string, n_chars long, label double, part int, mark string, n long, k int, digest string, runs string, block long"


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def corpus():
    base = [prose(n) for n in (60, 80, 120, 300, 3000, 7)]
    texts = [None, "", " \t\n", "a", "A", " a ", "one two", *base, *base[:3]]
    for b in base[:4]:
        for _ in range(6):
            w = b.split()
            for _ in range(max(1, len(w) // 60)):
                w[RNG.randrange(len(w))] = RNG.choice(WORDS)
            texts.append(" ".join(w))
    passage = prose(70)
    texts += [prose(20) + "\n" + passage + "  " + prose(30) for _ in range(3)]
    texts += ["ab" * 300, "ab" * 300, "x" * 250, prose(5) + " " + "y " * 120]
    return [(100 - k, t) for k, t in enumerate(texts)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    """Other columns have the names that the operators use inside."""
    made = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s0"][i % 4] if i % 5 else "s1", len(t or ""), 1.0, 1, "m", 1, 1, "d", "r", 9) for i, t in ROWS]
    return spark.createDataFrame(made, KIND).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def raw(t):
    return (t or "").encode()


def test_exact_dedup(docs, empty):
    norm = {i: raw(t).translate(None, exact_dedup.IGNORED) for i, t in ROWS}
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[norm[i]].append((-len(t or ""), i))
    got = by_id(exact_dedup.dedup(docs))
    for i, _ in ROWS:
        g = sorted(groups[norm[i]])
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (g[0][1], len(g), g[0][1] == i)
        assert bytes(got[i].digest) == hashlib.sha256(norm[i]).digest()
    assert sorted(r.doc_id for r in exact_dedup.keep(docs).collect()) == sorted(min(g)[1] for g in groups.values())
    assert exact_dedup.dedup(empty).count() == 0


def test_exact_dedup_rows_without_ids_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "ab"), (None, "zz"), (None, "zz"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in exact_dedup.keep(df).collect()) == [(0, "zz"), (1, "a b"), (3, "")]


def test_cuckoo_index_inserts_deletes_and_resizes():
    rng, index, live = random.Random(1), exact_dedup.CuckooIndex(8), {}
    for k in range(30_000):
        d = hashlib.sha256(str(rng.randrange(4000)).encode()).digest()
        if rng.random() < 0.55:
            index.insert(d, k)
            live.setdefault(d, k)
        else:
            assert index.delete(d) == (live.pop(d, None) is not None)
    assert index.resizes and len(index) == len(live) and {e[0]: e[1] for e in index} == live
    assert all(index.find(d)[1] == v for d, v in live.items())


def test_index_after_adding_and_removing(spark, docs):
    rows = exact_dedup.digests(docs)
    a, b = rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1")
    whole = lambda df: sorted((bytes(r.digest), r.n_points, r.keep_id, r.group_size) for r in df.collect())
    assert whole(exact_dedup.add(exact_dedup.groups(a), b)) == whole(exact_dedup.groups(rows))
    gone = exact_dedup.remove(exact_dedup.groups(rows), b)
    assert {bytes(r.digest) for r in gone.collect()} == {bytes(r.digest) for r in a.collect()} - {bytes(r.digest) for r in b.collect()}


def test_near_dedup(spark, docs, empty, monkeypatch):
    def shingles(t):
        w = [x.lower() for x in raw(t).split()]
        return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())

    sets, over = {i: shingles(t) for i, t in ROWS}, {i: i for i, _ in ROWS}

    def root(x):
        while over[x] != x:
            x = over[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                over[max(a, b)] = min(a, b)
    for block in (128, 2):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = by_id(near_dedup.classes(docs))
        assert {i: (got[i].n_shingles, got[i].component_id) for i in sets} == {i: (len(sets[i]), root(i)) for i in sets}
    assert near_dedup.classes(empty).count() == 0
    assert near_dedup.keep(docs, width=4).count() == sum(root(i) == i for i in sets)


def test_sketches_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 3, 40, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        s = near_dedup.sketch(a)
        assert s.max() < np.iinfo(np.uint64).max and (near_dedup.sketch(a[::-1].copy()) == s).all()
    share = []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        share.append((near_dedup.sketch(x[:250]) == near_dedup.sketch(x[50:])).mean())
    assert abs(np.mean(share) - 200 / 300) < 0.03
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    got = near_dedup.between(sets[:12], sets[12:], 50)
    assert all(got[i, j] == near_dedup.alike(sets[i], sets[12 + j], 50) for i in range(12) for j in range(18))


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(1, 60)] + [(500 + rng.randrange(80), 500 + rng.randrange(80)) for _ in range(60)] + [(900, 900)]
    over = {}

    def root(x):
        while over.setdefault(x, x) != x:
            x = over[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        over[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert all(got.get(x, x) == root(x) for x in over)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_dedup(docs, empty, monkeypatch):
    first = {}
    words = {i: raw(t).split() for i, t in ROWS}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    for held, each, often in ((1_500_000, 64, 64), (40, 64, 64), (40, 1, 0), (1_500_000, 2, 1)):  # also with frequent anchors
        monkeypatch.setattr(substring_dedup, "HELD", held)
        monkeypatch.setattr(common, "SAMPLED", each)
        monkeypatch.setattr(common, "FREQUENT", often)
        got = by_id(substring_dedup.dedup(docs))
        for i, w in words.items():
            gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
            kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
            assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    assert any(r.n_removed for r in got.values())
    assert substring_dedup.dedup(empty).count() == 0


@pytest.mark.parametrize("width", [200, 30])
def test_suffix_dedup(docs, empty, monkeypatch, width):
    seen = Counter(raw(t)[k : k + width] for _, t in ROWS for k in range(len(raw(t)) - width + 1))
    plans = ((1 << 20, 1 << 23, 4, 1 << 16, 64, 64), (3000, 700, 1, 300, 64, 64), (300, 1 << 23, 2, 1 << 16, 64, 64), (3000, 700, 4, 300, 1, 0), (1 << 20, 1 << 23, 4, 1 << 16, 2, 1))
    for shard, longest, kinds, context, each, often in plans:  # also with anchors that are split from the start
        monkeypatch.setattr(common, "SAMPLED", each)
        monkeypatch.setattr(common, "FREQUENT", often)
        monkeypatch.setattr(suffix_dedup, "SHARD", shard)
        monkeypatch.setattr(suffix_dedup, "LONGEST", longest)
        monkeypatch.setattr(suffix_dedup, "KINDS", kinds)
        monkeypatch.setattr(suffix_dedup, "CONTEXT", context)
        got = by_id(suffix_dedup.dedup(docs, width=width))
        for i, t in ROWS:
            b = raw(t)
            gone = {j for k in range(len(b) - width + 1) if seen[b[k : k + width]] > 1 for j in range(k, k + width)}
            kept = bytes(x for k, x in enumerate(b) if k not in gone)
            spans = sum(k - 1 not in gone for k in gone)
            r = got[i]
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), len(gone), spans, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.dedup(empty).count() == 0


@pytest.mark.parametrize("collide", [False, True])
def test_suffix_arrays_compare_a_pair_of_each_repeated_context(monkeypatch, collide):
    """Copies are not settled by their hashes alone, in one task or in two; nor are texts whose hashes collide."""
    import numpy as np
    import pyarrow as pa

    rng, width, real = random.Random(4), 200, suffix_dedup.text_runs
    texts = {i: bytes(rng.randrange(256) for _ in range(200)) for i in range(2)} if collide else dict.fromkeys(range(5), bytes(rng.randrange(256) for _ in range(700)))
    if collide:
        monkeypatch.setattr(suffix_dedup, "text_runs", lambda t, w: (*real(t, w)[:3], *(np.zeros_like(x) for x in real(t, w)[3:])))
    for tasks in ([list(texts)], [[i] for i in texts]):
        dealt = [b for ids in tasks for b in suffix_dedup._dealt(width, 1, 1)(iter([pa.record_batch({"doc_id": pa.array(ids), "text": pa.array([texts[i] for i in ids])})]))]
        verdicts = [r for b in suffix_dedup._judged(1)(iter(dealt)) for r in b.to_pylist()]
        asked = [r for r in verdicts if r["shard"] is not None]
        assert set(Counter(r["start"] for r in asked).values()) == {2}
        assert len(verdicts) == len(texts) * len({r["start"] for r in asked})
        contexts = pa.record_batch({"shard": [r["shard"] for r in asked], "doc_id": [r["doc_id"] for r in asked], "start": [r["start"] for r in asked], "context": pa.array([texts[r["doc_id"]][r["start"] : r["start"] + r["n"] + width - 1] for r in asked])})
        found = Counter()
        for r in (r for b in suffix_dedup._compared(width)(iter([contexts])) for r in b.to_pylist()):
            found[r["doc_id"]] += r["n"]
        assert found == ({} if collide else dict.fromkeys({r["doc_id"] for r in asked}, 501))


def test_suffix_array_and_common_prefixes():
    rng = random.Random(8)
    contexts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 60))) for _ in range(40)] + [b"a" * 90, b""]
    s = suffix_dedup.Shard(contexts, 20)
    data = b"".join(contexts)
    keys = [data[k : k + 20] for k in s.order]
    assert keys == sorted(keys) and len(keys) == sum(max(0, len(c) - 19) for c in contexts)
    common = s.common().tolist()
    for k in range(1, len(keys)):
        n = next((x for x in range(20) if keys[k - 1][x] != keys[k][x]), 20)
        assert common[k] == n


def test_mixing(spark, docs, empty):
    got = mixing.Mix(docs, block=8).taken().collect()
    sizes = {i: len(raw(t).split()) for i, t in ROWS}
    assert {r.doc_id: r.size for r in got} == sizes and all(0 <= r.taken <= 2 * r.size for r in got)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        by[r.source][0] += r["size"]
        by[r.source][1] += r.taken
        by[r.source][2] = r.target
        assert r.source_size
    for size, taken, target in by.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 12
    assert abs(sum(x[2] for x in by.values()) - 1.5 * sum(sizes.values())) < 1e-6
    again = mixing.Mix(docs.repartition(3), block=8).taken()
    assert {r.doc_id: r.taken for r in again.collect()} == {r.doc_id: r.taken for r in got}
    assert mixing.Mix(empty).taken().count() == 0
    texts = mixing.texts(docs, block=8)
    assert texts.columns == docs.columns
    words = defaultdict(int)
    for r in texts.collect():
        words[r.doc_id] += len(raw(r.text).split())
        assert r.n_chars == len(r.text)
    assert dict(words) == {r.doc_id: r.taken for r in got if r.taken}


@pytest.mark.parametrize(("sizes", "share"), [((5, 40, 130, 300, 5000), 1.5), ((5,), 1.5), ((40,), 1.5), ((130,), 1.5), ((300,), 1.5), ((100,), 0.3)])
def test_mixing_takes_small_sources_near_their_targets(spark, sizes, share):
    """With the production block."""
    made = [(1000 * n + k, " ".join(f"w{j}" for j in range(k, min(n, k + 7))), f"s{n}") for n in sizes for k in range(0, n, 7)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    got = mixing.Mix(docs, share=share).taken().collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    for n in sizes:
        mine = [r for r in got if r.source == f"s{n}"]
        target, taken = mine[0].target, sum(r.taken for r in mine)
        assert sum(r["size"] for r in mine) == n
        assert taken == target if target == 2 * n else abs(taken - target) <= max(1, n // 32)
    words = sum(len(r.text.split()) for r in mixing.texts(docs.withColumn("n_chars", F.lit(0)), share=share).collect())
    assert words == sum(r.taken for r in got)


def test_block_counts():
    assert mixing.block_counts([0, 5, 130, 300, 100, 1 << 40], [0.0, 10.0, 260.0, 450.0, 30.0, 2.0**39]) == ([0, 1, 2, 34, 34, 1 << 33], [0, 2, 4, 51, 10, 1 << 32])


def test_targets_and_permutations():
    import numpy as np

    assert mixing.targets([100, 100, 100]) == [200.0, 250 / 3, 500 / 3]
    assert mixing.targets([]) == [] and mixing.targets([0, 10]) == [0.0, 15.0]
    for n in (1, 2, 7, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    drawn = mixing.draws([5000, 0, 9000])
    assert [sum(x[3] for x in drawn if x[1] == k) for k in range(3)] == [5000, 0, 9000]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    v = bpe.Vocabulary.read(bpe.public_path())
    return tiktoken.Encoding("own", pat_str=bpe.public_pattern(), mergeable_ranks=v.ranks, special_tokens={})


def test_bpe(docs, empty, tiktoken_encoding):
    got, whole = by_id(bpe.digests(docs)), by_id(bpe.with_ids(docs))
    for i, t in ROWS:
        ids = tiktoken_encoding.encode_ordinary(t or "")
        assert list(whole[i].ids) == ids and bytes(whole[i].decoded) == raw(t)
        assert got[i].n_tokens == len(ids) and got[i].decoded_sha256 == hashlib.sha256(raw(t)).hexdigest()
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
    assert bpe.digests(empty).count() == 0
    assert bpe.encoded(docs).filter("NOT exact").isEmpty()


def test_bpe_on_odd_texts(tiktoken_encoding):
    e, rng = bpe.encoder(bpe.public_path(), bpe.public_pattern()), random.Random(7)
    for _ in range(3000):
        s = "".join(rng.choice("aabbee  \t\n\r\x0b\x1c\x85\xa0'sdß漢🙂12!?#_=") for _ in range(rng.randrange(50)))
        ids = tiktoken_encoding.encode_ordinary(s)
        assert e.encode(s) == b"".join(x.to_bytes(4, "little") for x in ids), s


def test_prefixes_append_cut_and_edit():
    v, rng = bpe.encoder(bpe.public_path(), bpe.public_pattern()).vocabulary, random.Random(9)
    p = bpe.PrefixEncoding(v)
    for _ in range(60):
        k = rng.randrange(len(p.piece) + 1)
        p.edit(k, min(len(p.piece), k + rng.randrange(4)), bytes(rng.choice(b"thean gio") for _ in range(rng.randrange(6))))
        assert p.last == bpe.PrefixEncoding(v, p.piece).last
        before = list(p.last)
        p.append(b"ing")
        assert p.last[: len(before)] == before and p.ids() == bpe.PrefixEncoding(v, p.piece).ids() == v.merged(p.piece)


def test_edits_of_long_pieces_stop_where_tokens_agree():
    v, rng = bpe.encoder(bpe.public_path(), bpe.public_pattern()).vocabulary, random.Random(10)
    p = bpe.PrefixEncoding(v, bytes(rng.choice(b"theangio") for _ in range(5000)))
    encoded = 0
    for _ in range(20):
        k = rng.randrange(4000)
        encoded += p.edit(k, k + 2, b"xyz")
        assert p.last == bpe.PrefixEncoding(v, p.piece).last
        p.append(b"e")
    assert encoded < 20 * 500


def revised(text):
    """The edits of the registered query, in plain Python."""
    n = len(text)
    return [(n // 2, n // 2, " (revised) "), (0, 5, ""), (n + 6, n + 6, "\nEnd of document.")]


def after(text, edits):
    for a, b, by in edits:
        a = max(0, min(a, len(text)))
        b = max(a, min(b, len(text)))
        text = text[:a] + by + text[b:]
    return text


def test_token_counts(docs, empty, tiktoken_encoding):
    got = by_id(token_counts.counts(docs))
    for i, t in ROWS:
        text = t or ""
        assert got[i].n_tokens == len(tiktoken_encoding.encode_ordinary(text))
        text = after(text, revised(text))
        assert got[i].n_tokens_edited == len(tiktoken_encoding.encode_ordinary(text)) and got[i].n_chars_edited == len(text)
    assert token_counts.counts(empty).count() == 0


def test_trees_follow_a_table_of_edits(spark, docs, empty, tiktoken_encoding):
    """Only trees with edits change; edits go by their number; trees can be edited again."""
    rng, texts = random.Random(11), {i: t or "" for i, t in ROWS}
    index = token_counts.trees(docs).cache()
    for turn in range(2):
        rows = [(i, k, rng.randrange(-3, len(texts[i]) + 9), rng.randrange(-3, len(texts[i]) + 9), rng.choice(["", " x", "漢 b\n", None])) for i in rng.sample(sorted(texts), 12) for k in range(3)] + [(999, 0, 0, 1, "no such document")]
        edits = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, seq int, start long, end long, by string")
        new = token_counts.edited(token_counts.with_edits(index, edits)).cache()
        got = by_id(new)
        assert set(got) == {r[0] for r in rows} - {999}
        for i, r in got.items():
            before = texts[i]
            texts[i] = after(before, [(a, b, by or "") for j, _, a, b, by in rows if j == i])
            assert bytes(r.text).decode() == texts[i] and r.n_chars == len(texts[i])
            assert (r.n_tokens_before, r.n_tokens) == tuple(len(tiktoken_encoding.encode_ordinary(t)) for t in (before, texts[i]))
        index = index.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new.select(*index.columns))
        assert {r.doc_id: bytes(r.leaves) for r in index.collect()} == {r.doc_id: bytes(r.leaves) for r in token_counts.trees(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert token_counts.edited(token_counts.with_edits(token_counts.trees(empty), edits)).count() == 0


def test_token_tree_under_random_edits(tiktoken_encoding):
    e, rng = bpe.encoder(bpe.public_path(), bpe.public_pattern()), random.Random(3)
    for text in ("", "a", prose(900), "a b " * 2000, " " * 200, "x" * 3000, "don't 'l l" * 30):
        tree = token_counts.TokenTree(e, text)
        for _ in range(20):
            a = rng.randrange(len(text) + 2)
            b = a + rng.choice([0, 1, 3, 50, 700])
            by = "".join(rng.choice("abl  \n'sé!1") for _ in range(rng.choice([0, 1, 4, 60])))
            tree.edit(a, b, by)
            text = text[:a] + by + text[b:]
            assert tree.text == text and len(tree) == len(text) and tree.tokens == len(tiktoken_encoding.encode_ordinary(text))
            assert tree.leaves == e.sizes(text)


def test_edits_encode_only_touched_pre_tokens():
    """Also in long texts without spaces; a text that is one pre-token is encoded whole."""
    e, rng = bpe.encoder(bpe.public_path(), bpe.public_pattern()), random.Random(4)
    mixed = "".join(rng.choice("abc12,漢。") for _ in range(40_000))
    for text, most in ((mixed, 60), (prose(9000), 60), ("x" * 40_000, 40_000 + 11)):
        tree = token_counts.TokenTree(e, text)
        tree.edit(20_000, 20_000, " (revised) ")
        assert 11 <= tree.encoded <= most and tree.tokens == e.count(text[:20_000] + " (revised) " + text[20_000:])


def test_top_k_search(spark):
    rng = random.Random(6)
    near = [rng.getrandbits(63) for _ in range(4)]
    codes = [(k, near[k % 4] ^ (1 << rng.randrange(62)) if k % 3 else near[0]) for k in range(400)]
    df = spark.createDataFrame(codes, "id long, code long").repartition(6)
    got = hamming_search.top_k(df, df.filter("id % 20 = 0"), 10).collect()
    mine = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        mine[r.query_id].append((r.distance, r.neighbor_id))
    for q, c in codes:
        if q % 20 == 0:
            assert mine.pop(q) == sorted(((c ^ d).bit_count(), i) for i, d in codes if i != q)[:10]
    assert not mine
    none = df.filter("id < 0")
    assert hamming_search.top_k(none, none).count() == 0 and hamming_search.top_k(df, none).count() == 0


def test_sign_codes(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0, None, 2.0]), (2, None), (None, [1.0]), (3, []), (4, [float("nan"), 1.0] + [0.5] * 70)], "i long, v array<float>")
    got = {r.id: r.code & (1 << 64) - 1 for r in hamming_search.sign_codes(df, "i", "v").collect()}
    assert got == {1: 9, 3: 0, 4: (1 << 64) - 2}


def test_top_k_search_of_long_vectors(spark, tmp_path):
    """The registered query counts all components of vectors of more than 64."""
    from sievelake.llm import queries

    rng = random.Random(12)
    vectors = [(k, [1.0] * 64 + [rng.choice((-1.0, 1.0)) for _ in range(rng.choice((66, 80)))]) for k in range(80)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op2_topk_search(spark, str(tmp_path)).collect()
    code = {i: sum((x > 0) << b for b, x in enumerate(v)) for i, v in vectors}
    for q in range(0, 80, 20):
        mine = [(r.distance, r.neighbor_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        assert mine == sorted(((code[q] ^ c).bit_count(), i) for i, c in code.items() if i != q)[:10]
    assert len(got) == 40


def test_quality(spark, empty):
    rng = random.Random(2)
    good = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(30, 90))) + ".") for k in range(120)]
    junk = [(1000 + k, "BUY NOW!! " * rng.randrange(10, 40)) for k in range(60)]
    df = spark.createDataFrame([*good, *junk, (5000, None), (5001, "")], "doc_id long, text string").withColumn("label", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + junk if i % 4] + [(1, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(quality.sample(df, labels))
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert len(got) == 182 and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) == (i < 1000) for i, _ in good + junk if i % 4 == 0) >= 0.95 * len([1 for i, _ in good + junk if i % 4 == 0])
    assert quality.keep(df, model).columns == df.columns
    assert quality.score(empty, model).count() == 0
    untaught = quality.fit(quality.sample(df, labels.filter("false")))
    assert {r.score for r in quality.score(df, untaught).collect()} == {0.5}


def test_isotonic_is_monotone_and_pools():
    import numpy as np

    x, y = quality.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([0.0, 0.0, 1.0, 1.0]))
    assert y.tolist() == [0.0, 0.5, 1.0] and x.tolist() == [1.0, 2.5, 4.0]


def test_language(spark, empty):
    rng = random.Random(2)
    parts = {"xa": ["the", "ing", "her", "wo"], "yb": ["über", "sch", "keit", "ein"], "zc": ["ción", "llo", "ñe", "que"]}
    make = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(2)) for _ in range(rng.randrange(20, 60)))
    rows = [(k, make(lang := ["xa", "yb", "zc"][k % 3]), lang if k % 7 else None) for k in range(120)] + [(900, None, None), (901, " 12 !", "xa"), (902, "", None), (903, "a" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    model = language.train(df.filter("doc_id < 60"))
    got = by_id(language.identify(df, model))
    assert all(got[k].lang_pred == ["xa", "yb", "zc"][k % 3] for k in range(60, 120))
    assert [(got[k].lang_pred, got[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3 and got[903].lang_pred != "und"
    assert language.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language.identify(df, language.train(empty)).collect()} == {"und"}


class PlainPPM:
    """Method C with exclusion, byte by byte, from followers of every context."""

    def __init__(self, texts):
        self.followers = defaultdict(Counter)
        for t in texts:
            s = language.stream(t)
            for k in range(1, len(s)):
                for order in range(min(language.ORDER, k) + 1):
                    self.followers[s[k - order : k]][s[k]] += 1

    def bits(self, text):
        s, total = language.stream(text), 0.0
        for k in range(1, len(s)):
            out = set()
            for order in range(min(language.ORDER, k), -1, -1):
                f = {b: n for b, n in self.followers.get(s[k - order : k], {}).items() if b not in out}
                n = sum(f.values()) + len(f)
                if s[k] in f:
                    total -= math.log2(f[s[k]] / n)
                    break
                if f:
                    total -= math.log2(len(f) / n)
                    out |= set(f)
            else:
                total += math.log2(max(1, 256 - len(out)))
        return total


def test_language_equals_plain_ppm(spark, docs, monkeypatch):
    """Code lengths, predictions and scores, over whole texts, also when these are read in parts."""
    texts = [(i, t, "abc"[i % 3]) for i, t in ROWS if i % 5]
    plain = {x: PlainPPM([t or "" for _, t, lang in texts if lang == x]) for x in "abc"}
    asked = [t or "" for _, t in ROWS if len(t or "") < 2000] + ["漢字 ßé " * 9, "zzzz", "\n\n", "Ab", "".join(RNG.choice("qxz#é ") for _ in range(300))]
    for at_once in (1 << 18, 7):
        monkeypatch.setattr(language, "AT_ONCE", at_once)
        model = language.train(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
        got = model.texts(asked)
        for k, t in enumerate(asked):
            assert got[k].tolist() == pytest.approx([plain[x].bits(t) for x in "abc"], abs=1e-6)
    for r in language.identify(docs, model).collect():
        text = dict(ROWS)[r.doc_id] or ""
        if not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        bits = [plain[x].bits(text) for x in "abc"]
        assert r.lang_pred == "abc"[bits.index(min(bits))] and r.score == pytest.approx(1 / sum(2.0 ** max(-1000, min(bits) - b) for b in bits))


def test_code_lengths_are_of_a_distribution():
    import numpy as np

    model = language.Model({"a": dict(Counter(g for w in ("abracadabra", "abba", "cab") for g in language.grams(language.stream(w)).tolist())), "none": {}})
    for context in (b"", b"a", b"ab", b"brac", b"zz"):
        each = np.array([int.from_bytes(b"\1" + context + bytes([c])) for c in range(256)])
        assert np.exp2(-model.bits(each)).sum(axis=0) == pytest.approx([1, 1])
