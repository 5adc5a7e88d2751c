"""The corpus pipeline, its stages and their operators against plain versions, on tables with nulls, empty texts, ids
that several rows have, extra columns with clashing names, and no rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievelake.llm import bpe, exact_dedup, mixing, near_dedup, quality

from . import plain

KIND = "doc_id long, text string, lang string, source string, n_chars long, __id long, __pieces string, of_id int, pieces string, keep_id string, digest string, raw string, text_bytes string, `odd.name` string, mark int, label string"
RNG = random.Random(15)
WORDS = ["".join(RNG.choice("abcdeéilnorstuß漢") for _ in range(RNG.randrange(2, 9))) for _ in range(600)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n)) + "."


def near(t, share=40):
    w = t.split(" ")
    for _ in range(max(1, len(w) // share)):
        w[RNG.randrange(len(w))] = RNG.choice(WORDS)
    return " ".join(w)


def table():
    """(id, text, source) rows and labels by id."""
    good = [prose(RNG.randrange(30, 200)) for _ in range(110)] + [prose(4000)]
    junk = ["BUY NOW!! $$$ " * RNG.randrange(6, 40) + RNG.choice(WORDS) for _ in range(60)]
    texts = good + junk
    rows = [(k, t) for k, t in enumerate(texts)]
    labels = {k: int(k < len(good)) for k in range(len(texts)) if k % 3}
    n = 1000
    for k in range(0, 40):  # exact copies, some with other white space, and near ones
        rows.append((n + k, good[k % 9].replace(" ", "  ", k % 3) if k % 2 else near(good[k % 9 + 9])))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (None, good[0]), (None, good[20]), (None, None), (None, prose(30)), (None, prose(30))]
    twice = prose(60)
    rows += [(5, good[5]), (5, good[6] + " "), (5, twice), (5, twice), (7, near(good[7], 200)), (3000, twice + " x"), (3001, twice.replace(" ", "\n", 1)), (5, prose(25)), (2001, "x"), (2001, "x ")]
    source: dict = {}
    return [(i, t, source.setdefault((i, t), ["web", "books", None, "news"][j % 4] if j % 5 else "web")) for j, (i, t) in enumerate(rows)], labels


ROWS, LABELS = table()


@pytest.fixture(scope="module")
def docs(spark):
    made = [(i, t, "en", s, len(t or ""), 1, "p", 2, "q", "k", "d", "r", "b", "o", 3, "l") for i, t, s in ROWS]
    return spark.createDataFrame(made, KIND).repartition(5).cache()


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in LABELS.items()], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def plain_quality(spark, docs, labels, ask):
    """Scores of the texts asked for; which labelled rows calibrate is asked of Spark's hash."""
    ids = spark.createDataFrame([(i,) for i in labels], "i long").select("i", F.pmod(F.xxhash64("i", F.lit("calibrate")), F.lit(quality.CALIBRATION_SHARE)).alias("part"))
    part = {r.i: r.part for r in ids.collect()}
    known = [(i, t, labels[i]) for i, t, _ in docs if i in labels]
    return plain.quality([(t, y) for i, t, y in known if part[i]], [(t, y) for i, t, y in known if not part[i]], ask, quality.SEED, quality.FEATURES, quality.RIDGE)


def test_quality_equals_its_plain_version(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.score(docs, quality.fit(quality.sample(docs, labels)), columns=["doc_id", "text"]).collect()
    want = plain_quality(spark, ROWS, LABELS, [r.text for r in got])
    assert [r.score for r in got] == pytest.approx(want.tolist(), abs=1e-6)
    assert {round(s) for s in want} == {0, 1}


def test_labels_of_one_kind(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.fit(quality.sample(docs, labels))).collect()} == {1.0}


def test_exact_keep(docs, empty):
    got = exact_dedup.keep(docs)
    assert got.columns == docs.columns
    assert pairs(got) == Counter(g[0] for g in plain.exact_groups([r[:2] for r in ROWS]))
    assert exact_dedup.keep(empty).count() == 0


def test_exact_keep_of_one_id_with_several_texts(spark):
    rows = [(0, "b b  "), (1, "a"), (1, "b b"), (2, "x y"), (2, "xy")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pairs(exact_dedup.keep(df)) == Counter({(0, "b b  "): 1, (1, "a"): 1, (2, "x y"): 1})


@pytest.mark.parametrize("width", [4, 5])
def test_near_keep(docs, empty, width):
    groups = plain.near_groups([r[:2] for r in ROWS], width, 80)
    got = near_dedup.keep(docs, width=width)
    assert got.columns == docs.columns and pairs(got) == Counter(g[0] for g in groups)
    want = Counter((i, len(plain.shingles(t, width)), g[0][0]) for g in groups for i, t in g)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.classes(docs, width=width).collect()) == want
    assert near_dedup.keep(empty).count() == 0


def marks_of(spark, rows):
    texts = {t for _, t, _ in rows}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64(F.coalesce("t", F.lit("")).cast("binary")).alias("mark"))
    return {r.t: r.mark for r in got.collect()}


def test_mixing_equals_its_plain_version(spark, docs, empty):
    """Rows alike in id, source and text may stand for each other, so what is taken is compared as a whole."""
    want = plain.mix(ROWS, marks_of(spark, ROWS))
    got = Counter((r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.Mix(docs).taken().collect())
    assert got == Counter((i, s, len(plain.words(t)), n, round(target, 6), sum(times)) for (i, t, s), (n, target, times) in zip(ROWS, want, strict=True))
    out = mixing.texts(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.source, r.text) for r in out.collect()) == Counter((i, s, c) for (i, t, s), (_, _, times) in zip(ROWS, want, strict=True) for c in plain.copies(t, times))
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert mixing.texts(empty).count() == 0


def test_run_equals_the_plain_pipeline(spark, folder):
    import tiktoken

    rows = ROWS
    score = plain_quality(spark, rows, LABELS, [t for _, t, _ in rows])
    rows = [r for r, s in zip(rows, score, strict=True) if s >= 0.5]
    assert 20 < len(ROWS) - len(rows)

    def first_of(groups):
        """The rows of the (id, text) pairs that stay, each with its source, and how many there are."""
        left, of = Counter(g[0] for g in groups), defaultdict(list)
        for i, t, s in rows:
            of[i, t].append(s)
        assert all(len(set(of[x])) == 1 for x in left), "the fixture leaves open which source stays"
        return [(*x, of[x][0]) for x, n in left.items() for _ in range(n)]

    for groups in (plain.exact_groups, lambda rs: plain.near_groups(rs, 5, 80)):
        before = len(rows)
        rows = first_of(groups([r[:2] for r in rows]))
        assert len(rows) < before
    mixed = [(i, c) for (i, t, _), (_, _, times) in zip(rows, plain.mix(rows, marks_of(spark, rows)), strict=True) for c in plain.copies(t, times)]
    v = bpe.Vocabulary.read(bpe.public_path())
    encode = tiktoken.Encoding("own", pat_str=bpe.public_pattern(), mergeable_ranks=v.ranks, special_tokens={}).encode_ordinary
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(encode(t))) for i, t in mixed)
    assert all(r.exact and r.n_tokens == len(r.ids) for r in got) and len(got) > 50


def test_run_on_no_rows(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_staged_tables_can_be_discarded(spark):
    import os

    from sievelake.llm import common

    common.discard(spark)
    path = common.staged(spark.range(3)).inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and common.discard(spark) == 1 and not os.path.exists(path)
    kept = [common.staged(spark.range(n)) for n in (2, 3, 4)]
    assert common.discard(spark, since=1, last=1) == 1 and [df.count() for df in (kept[0], kept[2])] == [2, 4] and common.made(spark) == 2
    assert common.discard(spark) == 2


def test_run_leaves_its_last_tables_only(spark, folder):
    import os

    from sievelake.llm import common

    common.discard(spark)
    rows = corpus_pipeline.run(spark, folder)
    assert rows.count() > 50 and common.made(spark) <= 2
    common.discard(spark)


def test_edits_under_other_patterns_raise(spark):
    from sievelake.llm import token_counts

    with pytest.raises(ValueError, match="public pattern"):
        token_counts.counts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), pattern=r"\s*[\r\n]+|\S+|\s")
