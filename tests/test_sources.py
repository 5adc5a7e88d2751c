import gzip
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelake.operators import confusion, ecology, generate, host_index, performance, reads, route, select
from sievelake.sources import readers, sinks
from sievelake.streaming.windows import windowed

FASTQ = "".join(f"@{h}\nACGT\n+\nIIII\n" for h in ["r1#0/1 x", "r2/1", "r3", "r3", "r9/2"])


def test_fastq_by_content_and_scoring(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(FASTQ)
    (tmp_path / "plain.fastq.gz").write_text(FASTQ)
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(FASTQ.encode()))
    (tmp_path / "empty.fastq.gz").write_bytes(b"")
    ids = readers.kept_ids(spark, str(tmp_path), "n1", glob="*.fastq*")
    assert ids.groupBy("path").count().select("count").distinct().collect() == [(5,)]
    assert {r.read_id for r in ids.collect()} == {"r1", "r2", "r3", "r9"}
    assert {r.path.split("/")[-1] for r in ids.collect()} == {"a.fastq", "plain.fastq.gz", "b.fastq.gz"}
    whole = readers.fastq(spark, str(tmp_path / "b.fastq.gz"), ids_only=False).orderBy("index").collect()
    assert [r["index"] for r in whole] == [0, 1, 2, 3, 4] and whole[0].seq == "ACGT"
    (tmp_path / "labels.tsv").write_text("r1\thost\nr2\tmicrobe\nr3\tmicrobe\nr3\thost\nr4\tHost\nbad\nx\ty\tz\nr5\thost\n")
    t = readers.labels(spark, str(tmp_path / "labels.tsv"))
    assert t.count() == 6
    truth = confusion.last_label(t, ["read_id"]).select("read_id", (F.col("label") == "host").alias("is_host"), F.lit("d").alias("d"))
    got = confusion.confusion(truth, ids, ["read_id"], ["d"]).first()
    assert (got.tp, got.fn, got.tn, got.fp) == (1, 2, 1, 1)  # r9 isn't in the truth, repeats don't count
    flip = confusion.confusion(truth, ids, ["read_id"], ["d"], polarity="kept_positive").first()
    assert (flip.tp, flip.fp, flip.tn, flip.fn) == (got.tn, got.fn, got.tp, got.fp)


@pytest.fixture
def small_parts(spark):
    """Files are read in parts of a few bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "60", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_files_read_in_parts(spark, tmp_path, small_parts):
    """Lines have their numbers, records their lines and contigs their bases wherever a file is cut."""
    (tmp_path / "r.fastq").write_text("".join(f"@r{k} é\nAC{'G' * (k % 9)}\n+{k}\n@@{'I' * (k % 9)}\n" for k in range(120)))
    lines = readers.lines(spark, str(tmp_path / "r.fastq"))
    assert lines.rdd.getNumPartitions() > 10
    assert [r.line_no for r in lines.orderBy("line_no").collect()] == list(range(480))
    got = readers.fastq(spark, str(tmp_path / "r.fastq"), ids_only=False).orderBy("index").collect()
    assert [tuple(r)[1:] for r in got] == [(k, f"@r{k} é", "AC" + "G" * (k % 9), f"+{k}", "@@" + "I" * (k % 9)) for k in range(120)]
    assert [r.read_id for r in readers.kept_ids(spark, str(tmp_path / "r.fastq")).collect()].sort() == [f"r{k}" for k in range(120)].sort()
    (tmp_path / "t.tsv").write_text("".join(f"r{k % 7}\tl{k}\n" for k in range(200)))
    last = confusion.last_label(readers.labels(spark, str(tmp_path / "t.tsv")), ["read_id"])
    assert {r.read_id: r.label for r in last.collect()} == {f"r{k % 7}": f"l{k}" for k in range(200)}
    (tmp_path / "c.fa").write_text("".join(f">c{k} x\n" + "ACGT\n" * (k % 40) for k in range(90)))
    assert {r.contig_id: r.length for r in readers.fasta(spark, str(tmp_path / "c.fa")).collect()} == {f"c{k}": 4 * (k % 40) for k in range(90)}


def test_long_contigs_over_blocks_of_lines(spark, tmp_path):
    (tmp_path / "c.fa").write_text("stray\n>a\n" + "ACGTA\n" * 9000 + ">b\n" + "A\n" * 5000)
    assert {r.contig_id: r.length for r in readers.fasta(spark, str(tmp_path / "c.fa")).collect()} == {"a": 45000, "b": 5000}


@pytest.mark.parametrize("batch", [3, 10_000])
@pytest.mark.parametrize("size", [64, 1 << 20])
def test_contigs_are_summed_where_they_are_read(spark, tmp_path, monkeypatch, size, batch):
    """Files cut anywhere, with contigs of many parts, empty ones, names that repeat, and lines before the first header. No line is
    shuffled or sorted, nor read again for what comes out."""
    from pyspark.sql.readwriter import DataFrameWriter

    rng, want = random.Random(size + batch), []
    for f in range(4):
        out = ["stray", ""] if f % 2 else []
        for k in range(rng.choice([1, 40])):
            lines = [" " * rng.randrange(2) + "é" * rng.choice([0, 1, 9, 70]) for _ in range(rng.choice([0, 0, 1, 3, 60]))]
            out += [f" >c{k // 2} x" if k % 3 else f">c{k // 2}", *lines]
            want.append((f"{f}.fa", f"c{k // 2}", sum(len(x.strip()) for x in lines)))
        (tmp_path / f"{f}.fa").write_text("\n".join(out) + "\n" * (f % 2))
    (tmp_path / "none.fa").write_text("no header\n" * 9)
    (tmp_path / "empty.fa").write_text("")
    plans, write = [], DataFrameWriter.parquet
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: plans.append(plan(self._df)) or write(self, path))
    conf = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 1, "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = readers.fasta(spark, str(tmp_path))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r.path.rsplit("/")[-1], r.contig_id, r.length) for r in df.collect()) == sorted(want)
    assert "Scan text" not in plan(df) and len(plans) == 1 and not any(x in plans[0] for x in ("Exchange", "Sort", "Join"))


def test_readers_leave_the_session_alone(spark, tmp_path):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    (tmp_path / "a.fastq").write_text(FASTQ)
    readers.fastq(spark, str(tmp_path), ids_only=False).count()
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))


def test_minimizers_against_plain_strings(spark):
    rng = random.Random(3)
    flip = str.maketrans("ACGT", "TGCA")

    def plain(s, k=35, length=31):
        parts = [s[i : i + length].upper() for i in range(len(s) - length + 1)]
        form = [min(p, p.translate(flip)[::-1]) if set(p) <= set("ACGT") else None for p in parts]
        windows = [form[i : i + k - length + 1] for i in range(len(s) - k + 1)]
        return {min(w) for w in windows if None not in w}

    host = ["".join(rng.choice("ACGT") for _ in range(300)) for _ in range(3)]
    made = [(k, host[k % 3][k : k + 60] if k % 2 else host[k % 3][k : k + 60].translate(flip)[::-1]) for k in range(20)] + [(100 + k, "".join(rng.choice("ACGTNacgt") for _ in range(90))) for k in range(10)] + [(200, None), (201, "ACG"), (202, host[0][:36].lower()), (203, host[0][:35]), (204, host[0][:50] + "é" + host[1][:90])]
    for _, s in made:
        number = lambda p: sum("ACGT".index(c) << 2 * (30 - j) for j, c in enumerate(p))
        assert reads.minimizers(s or "").tolist() == sorted(map(number, plain(s or "")))
    known = set().union(*map(plain, host))

    def runs(s, k=35, length=31):
        """Runs of k-mers with one minimizer: how many the host has, their k-mers, and all k-mers."""
        parts = [s[i : i + length].upper() for i in range(len(s) - length + 1)]
        form = [min(p, p.translate(flip)[::-1]) if set(p) <= set("ACGT") else None for p in parts]
        windows = [form[i : i + k - length + 1] for i in range(len(s) - k + 1)]
        best = [None if None in w else min(w) for w in windows]
        heads = [x for i, x in enumerate(best) if x is not None and (i == 0 or best[i - 1] != x)]
        return sum(x in known for x in heads), sum(x in known for x in best), sum(x is not None for x in best)

    want = {i: runs(s or "") for i, s in made}
    df, refs = spark.createDataFrame(made, "id long, seq string"), spark.createDataFrame([(h,) for h in host], "seq string")
    index = host_index.build(refs)
    assert index.count == len(known)
    for least, share in ((2, 0.0), (1, 0.0), (2, 0.9), (3, 0.5)):
        right = {i: (h, n) for i, (h, n, t) in want.items() if h >= least and n >= share * t}
        assert len(right) > 10
        again = host_index.reopened(spark, index.path)
        assert {r.id: (r.hits, r.kmers) for r in host_index.classified(df, again, "id", least_groups=least, confidence=share).collect()} == right
    # Rows of one id count together; frequent minimizers are looked up another way; no rows give none.
    same = df.withColumn("id", F.lit(1))
    total = [sum(x) for x in zip(*want.values(), strict=True)]
    for often in (16, 0):
        host_index.HOT, old = (1 << 60, host_index.HOT) if often else (4096, host_index.HOT)
        assert [(r.hits, r.kmers) for r in host_index.classified(same.union(same), index, "id", confidence=0.01).collect()] == [(2 * total[0], 2 * total[1])]
        host_index.HOT = old
    assert host_index.classified(df.limit(0), index, "id").count() == 0
    assert host_index.classified(df, host_index.build(refs.limit(0)), "id").count() == 0


@pytest.mark.parametrize("sampled", [1, 256])
def test_groups_of_reads_are_made_once(spark, monkeypatch, sampled):
    """However many questions are asked, and whether minimizers are frequent or not: the plan looks at the reads once."""
    rng = random.Random(7)
    host = ["".join(rng.choice("ACGT") for _ in range(200)) for _ in range(2)]
    made = [(k % 40, host[k % 2][k % 90 : k % 90 + 60] + "".join(rng.choice("ACGT") for _ in range(k % 50))) for k in range(120)] + [(99, "A" * 80)] * 40
    df, refs = spark.createDataFrame(made, "id long, seq string"), spark.createDataFrame([(h,) for h in host], "seq string")
    known = {x for h in host for x in reads.minimizers(h).tolist()}
    want = {}
    for i, s in made:
        data = np.frombuffer(s.encode(), np.uint8)
        _, found, n = host_index.groups(data, np.array([0, len(data)]))
        met = np.array([x in known for x in found.tolist()])
        want[i] = [a + int(b) for a, b in zip(want.get(i, [0, 0, 0]), (met.sum(), n[met].sum(), n.sum()), strict=True)]
    monkeypatch.setattr(host_index, "SAMPLED", sampled)
    monkeypatch.setattr(host_index, "HOT", 1 << 60)
    monkeypatch.setattr(host_index, "CACHED", 500)
    index = host_index.build(refs)
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    once = host_index.classified(df, index, "id", confidence=0.4)
    assert plan(once) == 1 and {r.id: (r.hits, r.kmers) for r in once.collect()} == {i: (h, n) for i, (h, n, t) in want.items() if h >= 2 and n >= 0.4 * t}
    few = host_index.classified(df, index, "id", least_groups=0)
    assert plan(few) == 1 and {r.id: (r.hits, r.kmers) for r in few.collect()} == {i: (h, n) for i, (h, n, _) in want.items() if h}
    assert {r.id: [r.hits, r.kmers, r.total] for r in host_index.counted(df, index, "id").collect()} == want


def test_filter_drops_nothing_it_has():
    values = np.random.default_rng(1).integers(0, 1 << 62, 3000, np.uint64)
    for bits in (10, 16, 20):
        (b,) = host_index._filtered(bits)(iter([pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=["m"])]))
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[b.column("word").to_numpy()] = b.column("bits").to_numpy().view(np.uint64)
        assert host_index.held(words, values, bits).all()
    others = np.random.default_rng(2).integers(0, 1 << 62, 30000, np.uint64)
    assert host_index.held(words, others, 20).mean() < 0.01


def test_chunks_and_quartiles(spark):
    df = spark.range(0, 97, 1, 6).select(F.pmod(F.col("id") * 37, F.lit(97)).alias("k"), F.lit("x").alias("v"))
    got = select.chunked(df, "k", 10)
    assert got.columns == ["k", "v", "chunk"] and sorted((r.k, r.chunk) for r in got.collect()) == [(k, k // 10) for k in range(97)]
    assert select.chunked(df.filter("false"), "k").count() == 0
    q = performance.quartiles(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 10.0), ("b", 3.0), ("c", None)], "g string, v double"), ["g"], "v")
    assert {r.g: (r.q1, r.median, r.q3) for r in q.collect()} == {"a": (1.75, 2.0, 4.0), "b": (3.0, 3.0, 3.0)}


def test_performance_repair(spark, tmp_path):
    lines = ["tool,dataset,rep,runtime_seconds,max_memory_kb,timestamp", "a,d,2,1:46.30,2048,2026-01-01T00:00:00+08:00", "b,d,99.5,1024,2026-01-01T00:00:00+08:00", "c,d,1,12,4096,,2026-01-01T00:00:00+08:00", "e,d,1,FAILED,"]
    (tmp_path / "p.csv").write_text("\n".join(lines))
    got = {r.tool: r for r in readers.performance(spark, str(tmp_path / "p.csv")).collect()}
    assert (got["a"].rep, got["a"].runtime_seconds, got["a"].max_memory_kb) == (2, 106.3, 2048)
    assert (got["c"].runtime_seconds, got["c"].max_memory_kb) == (12.0, 4096)
    assert (got["e"].runtime_seconds, got["e"].status) == (None, "FAILED")
    assert (got["b"].runtime_seconds, got["b"].max_memory_kb) == (99.5, 1024) and got["b"].rep == 1


def test_logs_and_catalog(spark, tmp_path):
    (tmp_path / "run" / "rep_2").mkdir(parents=True)
    (tmp_path / "run" / "rep_2" / "t.log").write_text("\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:46.30\n\tMaximum resident set size (kbytes): 3500000\n")
    (tmp_path / "run" / "rep_2" / "tool.log").write_text('chosen_backend="a"\nx\n\x1b[3mchosen_backend\x1b[0m="b" host_pct="1.5"\n')
    t = readers.time_log(spark, str(tmp_path / "run/rep_2/t.log")).first()
    assert (t.runtime_seconds, t.max_memory_kb) == (106.3, 3_500_000)
    path = str(tmp_path / "run/rep_2/tool.log")
    assert readers.tool_log(spark, path, ["chosen_backend", "none"]).first()[1:] == ("b", None)
    assert readers.tool_log(spark, path, ["chosen_backend"], last=False).first()[1] == "a"
    files = readers.catalog(spark, str(tmp_path))
    assert {(r.name, r.rep) for r in files.collect()} >= {("t.log", 2), ("tool.log", 2)}
    assert readers.completed(files).count() == 0


def test_optional_tables_and_fasta(spark, tmp_path):
    assert readers.table(spark, str(tmp_path / "none.csv"), "a string", optional=True).count() == 0
    (tmp_path / "c.fa").write_text(">c1 x\nACGT\nAC\n>c2\nA\n")
    got = {r.contig_id: r.length for r in readers.fasta(spark, str(tmp_path / "c.fa")).collect()}
    assert got == {"c1": 6, "c2": 1}
    (tmp_path / "m.txt").write_text("# note\n\ns1 a_1.fq a_2.fq\ns2\tb.fq\n")
    assert [(r.sample, r.r2) for r in readers.manifest(spark, str(tmp_path / "m.txt")).orderBy("line_no").collect()] == [("s1", "a_2.fq"), ("s2", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5, None), ("b", 1 / 3, "x|y")], "k string, v double, n string")
    sinks.csv(df, str(tmp_path / "o"), ["k", "v"], ["v"])
    assert sorted(r.v for r in spark.read.option("header", True).csv(str(tmp_path / "o")).collect()) == ["0.333333", "0.500000"]
    assert "N/A" in sinks.markdown(df) and r"x\|y" in sinks.markdown(df)
    assert sinks.json_rows(df.filter("k = 'a'")).first()[0] == '{"k":"a","v":0.5,"n":null}'
    sinks.append(df, str(tmp_path / "t"))
    sinks.replace(df.filter("k = 'a'").withColumn("v", F.lit(9.0)), str(tmp_path / "t"), str(tmp_path / "u"), ["k"])
    assert {r.k: round(r.v, 2) for r in spark.read.parquet(str(tmp_path / "u")).collect()} == {"a": 9.0, "b": 0.33}


def test_markdown_leaves_nothing_out(spark, tmp_path):
    df = spark.range(1500).select("id", F.when(F.col("id") % 2 == 0, "a|b").alias("x|y")).repartition(3)
    want = ["| id | x\\|y |", "| --- | --- |", *[f"| {k} | {'N/A' if k % 2 else chr(97) + chr(92) + '|b'} |" for k in range(1500)]]
    assert sinks.markdown(df).splitlines() == want
    sinks.report([("One", df, ["id"]), ("None", df.limit(0), ["id"])], str(tmp_path / "r"))
    files = sorted((tmp_path / "r").glob("part-*"))
    assert "".join(f.read_text() for f in files).splitlines() == ["## One", "", *want, "## None", "", *want[:2]]


def test_rank_sum_known_values(spark):
    df = spark.createDataFrame([("g", "x", v) for v in (1.0, 2.0, 2.0, 5.0)] + [("g", "y", v) for v in (2.0, 3.0, 7.0)], "g string, s string, v double")
    got = performance.rank_sum(df, ["g"], "s", "x", "y", "v").withColumn("p", performance.two_sided("z")).first()
    assert got.rank_sum == 13.0 and abs(got.z + 1.06066017) < 1e-8 and abs(got.p - 0.28884437) < 1e-8


def test_std_kinds_and_lengths(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "k string, v double")
    one = {kind: performance.stats(df, ["k"], ["v"], kind=kind).filter("k = 'a'").first().v_std for kind in ("sample", "sample0", "population")}
    assert one == {"sample": None, "sample0": 0.0, "population": 0.0}
    c = spark.createDataFrame([("s", n) for n in (2, 3, 4, 5, 100)], "k string, n long")
    assert ecology.lengths(c, ["k"], "n").first().upper_median == 4
    assert ecology.n50(c, ["k"], "n").first().n50 == 100


def test_generate_and_survey(spark):
    genomes = spark.createDataFrame([(0, "host", "ACGT" * 100), (1, "microbe", "GGCC" * 100)], "g int, label string, seq string")
    df = generate.reads(spark.range(200), "id", genomes, 50)
    assert df.count() == 200 and df.select("label").distinct().count() == 2
    a = [r.read_id for r in route.survey(df, "read_id", 20).collect()]
    assert len(a) == 20 and sorted(a) == sorted(r.read_id for r in route.survey(df.repartition(7), "read_id", 20).collect())
    kept = reads.trimmed(df)
    assert kept.count() == 200
    q = reads.summary(df, ["label"]).filter("label = 'microbe'").first()
    assert q.q30 == 1.0 and q.gc == 1.0
    grid = generate.grid(spark.createDataFrame([("a:10:0.5:low:even:SE",), ("a:10:0.5:low:even:SE",), ("b:20:0:high:even:PE",)], "value string"))
    assert grid.count() == 2
    for kind in ("even", "skewed", "powerlaw", "lognormal"):
        got = generate.abundance(spark.range(1, 8).select(F.lit(1).alias("s"), "id"), ["s"], "id", kind)
        assert abs(got.agg(F.sum("fraction")).first()[0] - 1) < 1e-9


def test_stream_equals_batch(spark, tmp_path, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    q = windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), by=["event_type"]).writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").count() == windowed(events, by=["event_type"]).count()
