"""Sources and sinks: each query writes files made of a table to the shared folder, reads them back, and has the SQL of
what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import confusion, ecology, generate, integrate, performance, route, scan, select
from ..session import scratch
from ..sources import layout, readers, sinks
from .accuracy import rounded
from .registry import Tables, query


def text(df: DataFrame, value, **options: str) -> str:
    """Lines of text written as files of a new folder."""
    at = scratch(df.sparkSession)
    df.select(value.alias("value")).write.options(**options).text(at)
    return at


def files(df: DataFrame, value, *by: str) -> str:
    """A text for each row, in a folder of its own by the columns ``by``."""
    at = scratch(df.sparkSession)
    df.select(value.alias("value"), *by).write.partitionBy(*by).option("lineSep", "\x00").text(at)
    return at


def records(df: DataFrame, header, seq=None, qual=None):
    """FASTQ records as four lines each."""
    seq, qual = seq if seq is not None else F.lit("ACGT"), qual if qual is not None else F.lit("@III")
    return df.select(F.explode(F.array(header, seq, F.lit("+"), qual)).alias("value"))


def fastq_text(t: Tables) -> DataFrame:
    """A record an order; qualities begin as headers do."""
    i = F.col("o_orderkey").cast("string")
    return records(t.orders, F.concat(F.lit("@o"), i, F.lit("#0/1 run"), i), F.concat(F.lit("ACGT"), i), F.concat(F.lit("@+"), i))


def moved(spark, folder: str, suffix: str) -> str:
    """Data files of a folder under names that end otherwise; at the driver, name by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(path(folder)):
        name = s.getPath().getName()
        if name.startswith("part-"):
            fs.rename(s.getPath(), path(f"{folder}/{name.split('.')[0]}{suffix}"))
    return folder


_O = "SELECT 'o' || o_orderkey AS read_id FROM orders"


@query(_O)
def fastq_ids_gzip(t: Tables) -> DataFrame:
    at = moved(t.spark, text(fastq_text(t), F.col("value"), compression="gzip"), ".fastq.gz")
    return readers.kept_ids(t.spark, at, "n1").select("read_id")


@query(_O)
def fastq_ids_mislabelled(t: Tables) -> DataFrame:
    """Plain files that are named as packed ones, split or not."""
    return readers.kept_ids(t.spark, moved(t.spark, text(fastq_text(t), F.col("value")), ".fastq.gz"), "n3").select("read_id")


@query(_O)
def fastq_ids_strict(t: Tables) -> DataFrame:
    at = moved(t.spark, text(fastq_text(t), F.col("value"), compression="gzip"), ".fastq.gz")
    return readers.kept_ids(t.spark, at, "n1", strict=True).select("read_id")


@query("SELECT 'r' || n_nationkey AS read_id FROM nation")
def fastq_ids_bad_bytes(t: Tables) -> DataFrame:
    """Bytes that aren't UTF-8 are left out."""
    bad = F.concat(F.lit("@r").cast("binary"), F.unhex(F.lit("FFC3")), F.col("n_nationkey").cast("string").cast("binary")).cast("string")
    return readers.kept_ids(t.spark, text(records(t.nation, bad), F.col("value")), "n5").select("read_id")


@query("SELECT 's' || s_suppkey AS read_id, s_nationkey FROM supplier")
def fastq_ids_all_files(t: Tables) -> DataFrame:
    """All files of a tree that fit a pattern; empty ones are skipped."""
    at = scratch(t.spark)
    i = F.col("s_suppkey").cast("string")
    t.supplier.select(F.explode(F.array(F.concat(F.lit("@s"), i), F.lit("AC"), F.lit("+"), F.lit("II"))).alias("value"), F.col("s_nationkey").alias("run")).repartition("run").write.partitionBy("run").option("compression", "gzip").text(at)
    t.supplier.limit(0).select(F.lit("").alias("value")).write.text(f"{at}/run=empty")
    out = readers.kept_ids(t.spark, at, "n2", glob="*.gz")
    return out.select(F.regexp_replace("read_id", "^@", "").alias("read_id"), F.regexp_extract("path", r"run=(\d+)", 1).cast("int").alias("s_nationkey"))


@query("SELECT '@o' || o_orderkey || '#0/1 run' || o_orderkey AS header, 'ACGT' || o_orderkey AS seq, '+' AS plus, '@+' || o_orderkey AS qual, count(*) OVER () AS n FROM orders")
def fastq_records(t: Tables) -> DataFrame:
    """Whole records, of files that are split anywhere; a record's index is its place in its file."""
    out = readers.fastq(t.spark, text(fastq_text(t), F.col("value")), ids_only=False)
    n = out.groupBy("path").agg((F.max("index") + 1).alias("n")).agg(F.sum("n").alias("n"))
    return out.select("header", "seq", "plus", "qual").crossJoin(F.broadcast(n))


@query("SELECT 's' || s_suppkey AS read_id, CASE WHEN s_nationkey < 10 THEN 'host' ELSE 'microbe' END AS label FROM supplier")
def labels_of_headers(t: Tables) -> DataFrame:
    """Headers as label rows: the mark off, a class added."""
    parts = [("host", "s_nationkey < 10"), ("microbe", "s_nationkey >= 10")]
    made = {c: records(t.supplier.filter(f), F.concat(F.lit("@s"), F.col("s_suppkey").cast("string"), F.lit(" x"))) for c, f in parts}
    return integrate.tagged({c: readers.kept_ids(t.spark, text(df, F.col("value")), "n5").select("read_id") for c, df in made.items()}, "label")


_LABELS = "l.doc_id AS id, CASE WHEN quality = 0 THEN CASE doc_id % 4 WHEN 0 THEN 'Host' WHEN 1 THEN 'host_x' ELSE 'host' END ELSE 'microbe' END AS label FROM labels l"


def _label_lines(t: Tables) -> str:
    """Lines of two fields, and of one and three."""
    i = F.col("doc_id")
    name = F.when(F.col("quality") == 0, F.when(i % 4 == 0, "Host").when(i % 4 == 1, "host_x").otherwise("host")).otherwise("microbe")
    line = F.concat(F.lit("d"), i.cast("string"), F.lit("/1\t"), name)
    return text(t.labels, F.when(i % 10 == 3, F.concat(line, F.lit("\textra"))).when(i % 10 == 7, F.lit("lonely")).otherwise(line))


@query(f"SELECT 'd' || id AS read_id, label, label = 'host' AS is_host FROM (SELECT {_LABELS}) WHERE id % 10 NOT IN (3, 7)")
def labels_two_fields(t: Tables) -> DataFrame:
    return readers.labels(t.spark, _label_lines(t)).drop("line_no")


@query(f"SELECT 'd' || id AS read_id, label || CASE WHEN id % 10 = 3 THEN chr(9) || 'extra' ELSE '' END AS label, starts_with(lower(label), 'host') AS is_host FROM (SELECT {_LABELS}) WHERE id % 10 <> 7")
def labels_first_tab(t: Tables) -> DataFrame:
    return readers.labels(t.spark, _label_lines(t), label_rule="prefix", first_tab_only=True).drop("line_no")


@query(f"SELECT lower(label) = 'host' AS is_host, count(*) AS n FROM (SELECT {_LABELS}) WHERE id % 10 NOT IN (3, 7) GROUP BY ALL")
def labels_folded(t: Tables) -> DataFrame:
    return readers.labels(t.spark, _label_lines(t), label_rule="folded").groupBy("is_host").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'c' || conv_id AS read_id, arg_max(role, (turn, text, role)) AS label FROM conversations GROUP BY conv_id")
def labels_last_line(t: Tables) -> DataFrame:
    """The last line of a read decides, by its number in the file; all lines of a read are in one."""
    rows = t.conversations.select("conv_id", "turn", "text", "role").repartition("conv_id").sortWithinPartitions("turn", "text", "role")
    at = text(rows, F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("\t"), "role"))
    return confusion.last_label(readers.labels(t.spark, at), ["read_id"])


_CSV = "n_name string, n_nationkey int, n_regionkey int, share string"


def _csv(t: Tables, header: bool = True) -> str:
    at = scratch(t.spark)
    df = t.nation.withColumn("share", F.col("n_nationkey") / 7.0)
    if header:
        sinks.csv(df, at, ["n_name", "n_nationkey", "n_regionkey", "share"], ["share"])
    else:
        df.select("n_name", "n_nationkey", "n_regionkey", F.format_string("%.6f", "share")).write.csv(at)
    return at


_NATIONS = "SELECT n_name, n_nationkey, n_regionkey, printf('%.6f', n_nationkey / 7.0) AS share FROM nation"


@query(_NATIONS)
def csv_typed(t: Tables) -> DataFrame:
    return readers.table(t.spark, _csv(t), _CSV)


@query("SELECT n_name, n_nationkey::VARCHAR AS n_nationkey, n_regionkey::VARCHAR AS n_regionkey, printf('%.6f', n_nationkey / 7.0) AS share FROM nation")
def csv_strings(t: Tables) -> DataFrame:
    return readers.table(t.spark, _csv(t), "n_name string, n_nationkey string, n_regionkey string, share string")


@query(_NATIONS)
def csv_without_header(t: Tables) -> DataFrame:
    return readers.table(t.spark, _csv(t, header=False), _CSV, header=False)


@query(f"{_NATIONS} UNION ALL {_NATIONS}")
def csv_optional(t: Tables) -> DataFrame:
    """A table that isn't there is empty; of several the first with rows is read."""
    at = _csv(t)
    missing = readers.table(t.spark, f"{at}/none", _CSV, optional=True)
    return missing.unionByName(readers.table(t.spark, at, _CSV, optional=True)).unionByName(readers.first_table(t.spark, [f"{at}/none", at], _CSV))


@query("""
WITH g AS (SELECT o_orderstatus AS tool, round(avg(o_totalprice), 4) AS m, count(*) AS n FROM orders GROUP BY ALL)
SELECT tool, m AS runtime_mean, n::DOUBLE AS runtime_n, NULL::DOUBLE AS f1_mean FROM g""")
def csv_two_header_rows(t: Tables) -> DataFrame:
    """Values by metric and statistic; one that the table lacks is NULL."""
    from ..functions.scalars import metric, number

    g = rounded(t.orders.groupBy(F.col("o_orderstatus").alias("tool")).agg(F.avg("o_totalprice").alias("m"), F.count(F.lit(1)).alias("n")), 4)
    rows = g.select(F.lit(1).alias("k"), F.concat_ws(",", "tool", F.col("m").cast("decimal(20,4)"), "n").alias("value"))
    head = t.spark.createDataFrame([(0, "tool,runtime,\n,mean,n")], "k int, value string")
    flat = readers.two_row_header(t.spark, text(head.union(rows).coalesce(1).sortWithinPartitions("k"), F.col("value")))
    return flat.select("tool", *[number(metric(flat, m, s)).alias(f"{m}_{s}") for m, s in (("runtime", "mean"), ("runtime", "n"), ("f1", "mean"))])


@query("SELECT r_regionkey AS samples, r_regionkey * 1.5 AS wall_seconds, NULL::DOUBLE AS branch_accuracy FROM region")
def json_array(t: Tables) -> DataFrame:
    one = t.region.agg(F.to_json(F.collect_list(F.struct(F.col("r_regionkey").alias("samples"), (F.col("r_regionkey") * 1.5).alias("wall_seconds")))).alias("value"))
    return readers.metadata(t.spark, text(one, F.col("value")), "samples int, wall_seconds double, branch_accuracy double")


@query("SELECT r_regionkey, r_regionkey / 3.0 AS share, NULL::VARCHAR AS note FROM region")
def json_summary(t: Tables) -> DataFrame:
    at = scratch(t.spark)
    sinks.json(t.region.select("r_regionkey", (F.col("r_regionkey") / 3.0).alias("share"), F.lit(None).cast("string").alias("note")), at)
    return t.spark.read.schema("r_regionkey int, share double, note string").json(at)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN n_nationkey * 60 + 30.25 ELSE 3600 + n_nationkey * 60 + 5 END AS runtime_seconds, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey * 1000 END AS max_memory_kb FROM nation")
def time_logs(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    took = F.when(k % 3 == 1, F.concat(k.cast("string"), F.lit(":30.25"))).otherwise(F.concat(F.lit("1:"), F.lpad(k.cast("string"), 2, "0"), F.lit(":05")))
    log = F.concat(F.lit("\tCommand being timed: \"x\"\n\tElapsed (wall clock) time (h:mm:ss or m:ss): "), took, F.lit("\n\tMaximum resident set size (kbytes): "), (k * 1000).cast("string"), F.lit("\n"))
    at = files(t.nation, F.when(k % 3 == 0, "killed\n").otherwise(log), "n_nationkey")
    return readers.time_log(t.spark, f"{at}/*").select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), "runtime_seconds", "max_memory_kb")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' b' END AS last, CASE WHEN n_nationkey % 2 = 0 THEN 'first' END AS first FROM nation")
def tool_logs(t: Tables) -> DataFrame:
    """The last and the first of several values; only quoted ones."""
    line = lambda x: F.concat(F.lit("\x1b[2m10:00\x1b[0m \x1b[3mchosen_backend\x1b[0m=\""), x, F.lit("\"\n"))
    at = files(t.nation, F.when(F.col("n_nationkey") % 2 == 0, F.concat(line(F.lit("first")), line(F.concat("n_name", F.lit(" b"))))).otherwise("chosen_backend=none\n"), "n_nationkey")
    read = lambda last: readers.tool_log(t.spark, f"{at}/*", ["chosen_backend"], last).select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), F.col("chosen_backend").alias("last" if last else "first"))
    return read(True).join(read(False), "n_nationkey")


@query("SELECT n_name AS name, CASE WHEN n_nationkey > 3 THEN n_nationkey / 100.0 END AS fraction_total_reads FROM nation")
def abundance_table(t: Tables) -> DataFrame:
    """Of two files one has the columns needed."""
    at, other = scratch(t.spark), scratch(t.spark)
    share = F.when(F.col("n_nationkey") > 3, (F.col("n_nationkey") / 100.0).cast("string")).otherwise("bad")
    t.nation.select(F.col("n_name").alias("name"), F.lit("S").alias("level"), share.alias("fraction_total_reads")).write.option("header", True).option("sep", "\t").csv(at)
    t.nation.select("n_name").write.option("header", True).csv(other)
    return readers.profile(t.spark, at).unionByName(readers.profile(t.spark, other))


_CONTIGS = "SELECT 'c' || l_orderkey AS contig_id, sum(l_linenumber * 10)::BIGINT AS length FROM lineitem GROUP BY l_orderkey"


def _contigs(t: Tables) -> DataFrame:
    """A contig an order, a line of bases an order line."""
    numbers = F.collect_list(F.col("l_linenumber").cast("int"))
    bases = t.lineitem.groupBy("l_orderkey").agg(F.concat_ws("\n", F.transform(numbers, lambda n: F.repeat(F.lit("ACGTACGTAC"), n))).alias("b"))
    return readers.fasta(t.spark, text(bases, F.concat(F.lit(">c"), F.col("l_orderkey").cast("string"), F.lit(" flag=1\n"), "b")))


@query(_CONTIGS)
def fasta_lengths(t: Tables) -> DataFrame:
    return _contigs(t).drop("path")


@query(f"WITH c AS ({_CONTIGS}) SELECT count(*) AS contigs, sum(length)::BIGINT AS total, max(length) AS longest FROM c")
def fasta_total(t: Tables) -> DataFrame:
    return ecology.lengths(_contigs(t), [], "length").select("contigs", "total", "longest")


@query("SELECT 'g' || n_regionkey || '_' || n_nationkey AS contig_id, 4::BIGINT AS length FROM nation")
def fasta_merged(t: Tables) -> DataFrame:
    """References of several sources with a prefix each, packed, in one folder."""
    at = scratch(t.spark)
    for k in range(5):
        rows = t.nation.filter(F.col("n_regionkey") == k).select(F.explode(F.array(F.concat(F.lit(">"), F.col("n_nationkey").cast("string")), F.lit("ACGT"))).alias("value"))
        sinks.fasta(rows, f"g{k}_", f"{at}/{k}")
    return readers.fasta(t.spark, f"{at}/*").drop("path")


@query("SELECT row_number() OVER (ORDER BY n_nationkey)::BIGINT AS place, n_name AS sample, 'r1_' || n_nationkey AS r1, CASE WHEN n_nationkey % 2 = 0 THEN 'r2' END AS r2 FROM nation")
def manifest_lines(t: Tables) -> DataFrame:
    """Comments and blank lines are skipped; the order of files and lines stays."""
    k = F.col("n_nationkey").cast("string")
    line = F.concat(F.lit("# note\n\n  "), F.col("n_name"), F.lit("\t r1_"), k, F.when(F.col("n_nationkey") % 2 == 0, "  r2").otherwise(""))
    out = readers.manifest(t.spark, text(t.nation.repartitionByRange(3, "n_nationkey").sortWithinPartitions("n_nationkey"), line))
    return scan.numbered(out, [F.col("path"), F.col("line_no")]).select("place", "sample", "r1", "r2")


def _tree(t: Tables) -> DataFrame:
    """A catalog of files below ``tool=/rep_=`` folders: a line of each nation's name."""
    at = scratch(t.spark)
    rows = t.nation.select(F.col("n_name").alias("value"), F.concat(F.lit("t"), F.col("n_regionkey").cast("string")).alias("tool"), (F.col("n_nationkey") % 3).alias("rep_"))
    rows.repartition(1).write.partitionBy("tool", "rep_").text(at)
    files = readers.catalog(t.spark, at).filter("startswith(name, 'part-')")
    p = F.split("path", "/")
    return files.select(F.regexp_replace(F.element_at(p, -3), "^tool=", "").alias("tool"), F.regexp_extract(F.element_at(p, -2), r"rep_=(\d+)", 1).cast("int").alias("rep"), "size", "path", "name", F.element_at(p, -3).alias("parent"))


_TREE = "SELECT 't' || n_regionkey AS tool, (n_nationkey % 3)::INT AS rep, sum(length(n_name) + 1)::BIGINT AS bytes, 1::BIGINT AS files FROM nation GROUP BY ALL"


@query(_TREE)
def catalog_sizes(t: Tables) -> DataFrame:
    return readers.run_sizes(_tree(t), ["tool", "rep"])


@query(f"SELECT DISTINCT tool FROM ({_TREE})")
def catalog_tools(t: Tables) -> DataFrame:
    """Folders that stand for tools: hidden ones, metrics and logs don't."""
    found = _tree(t).select(F.col("tool").alias("parent"))
    extra = t.spark.createDataFrame([(".checkpoints",), ("metrics",), ("logs",)], "parent string")
    return readers.tools(found.union(extra)).select(F.col("parent").alias("tool"))


@query(f"SELECT tool, rep FROM ({_TREE}) WHERE tool IN (SELECT 't' || n_regionkey FROM nation GROUP BY n_regionkey HAVING min(n_nationkey) > 0)")
def catalog_completed(t: Tables) -> DataFrame:
    """Files of folders that have a flag."""
    all_ = _tree(t).select("parent", "name", "tool", "rep")
    done = t.nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k")).filter("k > 0")
    flags = done.select(F.concat(F.lit("tool=t"), F.col("n_regionkey").cast("string")).alias("parent"), F.lit("completed.flag").alias("name"), F.lit(None).cast("string").alias("tool"), F.lit(None).cast("int").alias("rep"))
    return readers.completed(all_.union(flags)).filter("tool IS NOT NULL").select("tool", "rep")


def _names(t: Tables) -> DataFrame:
    """Names of files, as a catalog has them."""
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "sample_R1.").when(k % 3 == 1, "sample_R2.").otherwise("Fig_"), k.cast("string"), F.when(k % 3 < 2, ".fastq.gz").when(k % 5 == 0, ".PNG").when(k % 5 == 1, ".pdf").otherwise(".txt"))
    return t.part.select("p_brand", k, name.alias("name"))


@query("SELECT p_brand AS parent, bool_or(p_partkey % 3 = 0) AND bool_or(p_partkey % 3 = 1) AS paired FROM part GROUP BY ALL")
def catalog_paired(t: Tables) -> DataFrame:
    names = _names(t).select(F.col("p_brand").alias("parent"), F.regexp_replace("name", r"^(sample_R\d)\.\d+", "$1").alias("name"))
    return readers.paired(names)


@query("SELECT 'Fig_' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '.PNG' ELSE '.pdf' END AS name FROM part WHERE p_partkey % 3 = 2 AND p_partkey % 5 < 2")
def artifact_list(t: Tables) -> DataFrame:
    return readers.artifacts(_names(t))


@query("""
WITH f AS (SELECT p_brand, CASE p_partkey % 4 WHEN 0 THEN 'work/' WHEN 1 THEN 'out/' ELSE '' END || CASE p_partkey % 3 WHEN 0 THEN 'Clean_' WHEN 1 THEN 'rmhost_' ELSE 'other_' END || p_name || '.fastq.gz' AS path, p_partkey FROM part)
SELECT p_brand, path FROM f WHERE p_partkey % 4 > 0 AND p_partkey % 3 < 2
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY (NOT contains(lower(path), 'clean'))::INT, length(path), path) = 1""")
def output_file(t: Tables) -> DataFrame:
    """Of a run's files, without those in between, one with ``clean`` in its name, else the shortest path."""
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 4 == 0, "work/").when(k % 4 == 1, "out/").otherwise(""), F.when(k % 3 == 0, "Clean_").when(k % 3 == 1, "rmhost_").otherwise("other_"), "p_name", F.lit(".fastq.gz"))
    found = t.part.select("p_brand", path.alias("path")).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return select.top(select.outputs(found, "path", "name").drop("name"), ["p_brand"], select.clean_first("path", mates=False))


@query("SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 4 = 0 THEN 'FAILED' ELSE 'OK' END AS status, CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal END AS runtime_seconds FROM supplier")
def appended_runs(t: Tables) -> DataFrame:
    """Records that several writers append, of failed runs too."""
    at = scratch(t.spark)
    runs = t.supplier.select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("runtime_seconds"), F.lit(1).cast("bigint").alias("max_memory_kb"), F.lit("OK").alias("status"))
    sinks.append(runs.filter("s_suppkey % 4 > 0"), at, ["s_nationkey"])
    sinks.append(sinks.failure(runs.filter("s_suppkey % 4 = 0")), at, ["s_nationkey"])
    return t.spark.read.parquet(at).select("s_suppkey", "s_nationkey", "status", "runtime_seconds")


@query("SELECT r_regionkey AS k, CASE WHEN r_regionkey % 2 = 0 THEN 'new' ELSE r_name END AS v FROM region")
def replaced_rows(t: Tables) -> DataFrame:
    at, to = scratch(t.spark), scratch(t.spark)
    old = t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v"))
    old.write.parquet(at)
    sinks.replace(old.filter("k % 2 = 0").withColumn("v", F.lit("new")), at, to, ["k"])
    return t.spark.read.parquet(to)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 50 > 0 OR o_orderkey % 100 = 0 UNION ALL SELECT -1, 'added', 1.5")
def replaced_orders(t: Tables) -> DataFrame:
    """Rows replaced in place, twice, and one added; then the table without those that a second list has as gone."""
    at = scratch(t.spark)
    o = t.orders.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    layout.keyed(o, at, ["o_orderkey"])
    new = o.filter("o_orderkey % 50 = 0").withColumn("o_orderstatus", F.lit("new")).unionByName(t.spark.createDataFrame([(-1, "added", 1.5)], "o_orderkey long, o_orderstatus string, o_totalprice double"))
    for _ in range(2):
        layout.replace_in_place(new, at, ["o_orderkey"])
    return layout.keyed_table(t.spark, at).filter("o_orderkey % 100 <> 50")


@query("""
WITH r AS (SELECT n_nationkey, '| ' || n_nationkey || ' | ' || replace(n_name, 'A', '\\|') || ' | N/A |' AS line FROM nation),
o AS (SELECT o_orderkey, '| ' || o_orderkey || ' | ' || o_orderstatus || ' |' AS line FROM orders),
l AS (SELECT 1 AS section, 1 AS place, '## Nations' AS line UNION ALL SELECT 1, 2, '' UNION ALL SELECT 1, 3, '| n_nationkey | name | note |' UNION ALL SELECT 1, 4, '| --- | --- | --- |'
  UNION ALL SELECT 1, 4 + row_number() OVER (ORDER BY n_nationkey), line FROM r
  UNION ALL SELECT 2, 1, '## Orders' UNION ALL SELECT 2, 2, '' UNION ALL SELECT 2, 3, '| o_orderkey | status |' UNION ALL SELECT 2, 4, '| --- | --- |'
  UNION ALL SELECT 2, 4 + row_number() OVER (ORDER BY o_orderkey), line FROM o
  UNION ALL SELECT 3, 1, '## Nothing' UNION ALL SELECT 3, 2, '' UNION ALL SELECT 3, 3, '| x |' UNION ALL SELECT 3, 4, '| --- |')
SELECT section::INT AS section, place::BIGINT AS place, line FROM l""")
def markdown_report(t: Tables) -> DataFrame:
    """A report of three tables, one long and one empty, written and read again."""
    nations = t.nation.select("n_nationkey", F.regexp_replace("n_name", "A", "|").alias("name"), F.lit(None).cast("string").alias("note"))
    orders = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    at = scratch(t.spark)
    sinks.report([("Nations", nations, ["n_nationkey"]), ("Orders", orders, ["o_orderkey"]), ("Nothing", t.region.filter("false").select(F.lit(1).alias("x")), ["x"])], at)
    lines = readers.lines(t.spark, at).withColumn("line", F.col("value").cast("string"))
    n = scan.numbered(lines, [F.col("path"), F.col("line_no")])
    heads = n.filter("startswith(line, '## ')").select("place", F.array_position(F.array(*map(F.lit, ("## Nations", "## Orders", "## Nothing"))), F.col("line")).cast("int").alias("section"))
    starts = sorted((r.place, r.section) for r in heads.collect())  # one a table
    pick = F
    for place, section in starts[::-1]:
        pick = pick.when(F.col("place") >= place, F.struct(F.lit(section).alias("section"), (F.col("place") - (place - 1)).alias("place")))
    return n.select(pick.alias("p"), "line").select("p.section", "p.place", "line")


@query("""
WITH r AS (SELECT '| ' || r_regionkey || ' | ' || replace(r_name, 'A', '\\|') || ' | N/A |' AS line FROM region)
SELECT '| r_regionkey | name | note |' AS line UNION ALL SELECT '| --- | --- | --- |' UNION ALL SELECT line FROM r""")
def markdown_table(t: Tables) -> DataFrame:
    df = t.region.select("r_regionkey", F.regexp_replace("r_name", "A", "|").alias("name"), F.lit(None).cast("string").alias("note"))
    return sinks.markdown_lines(df, ["r_regionkey"]).select("line")


@query("SELECT o_orderstatus, round(avg(d), 6) AS mean, round(greatest(0, avg(d) - coalesce(stddev_samp(d), 0)), 6) AS low, round(least(1, avg(d) + coalesce(stddev_samp(d), 0)), 6) AS high FROM (SELECT o_orderstatus, (o_orderkey % 100) / 99.0 AS d FROM orders) GROUP BY ALL")
def plot_bars(t: Tables) -> DataFrame:
    """What a chart of shares draws; bars stay within 0 and 1."""
    return rounded(sinks.plot_data(t.orders.select("o_orderstatus", ((F.col("o_orderkey") % 100) / 99.0).alias("d")), "o_orderstatus", "d", share=True))


@query("""
WITH r AS (SELECT 0 AS f, s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier WHERE s_nationkey < 12
  UNION ALL SELECT 1, s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 + (SELECT count(*) FROM supplier WHERE s_nationkey < 12) FROM supplier WHERE s_nationkey >= 12)
SELECT i::BIGINT AS index, '@s' || s_suppkey AS header, CASE WHEN f = 0 THEN 'microbe' ELSE 'host' END AS label FROM r""")
def concatenated_reads(t: Tables) -> DataFrame:
    """Two sets of files one after the other, labelled by place."""
    parts = [t.supplier.filter(f).repartitionByRange(3, "s_suppkey").sortWithinPartitions("s_suppkey") for f in ("s_nationkey < 12", "s_nationkey >= 12")]
    files = [readers.fastq(t.spark, text(records(p, F.concat(F.lit("@s"), F.col("s_suppkey").cast("string"))), F.col("value"))) for p in parts]
    read = [scan.numbered(f, [F.col("path"), F.col("index")]).select((F.col("place") - 1).alias("index"), "header") for f in files]
    return generate.positional_labels(generate.concatenated(read), "index", F.lit(parts[0].count()))


@query("""
SELECT tool, dataset, rep, v AS value FROM (SELECT 't' || s_nationkey AS tool, 'd' AS dataset, (s_suppkey % 3)::INT AS rep, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey * 1.5 END AS v FROM supplier)""")
def file_size_rows(t: Tables) -> DataFrame:
    """Rows without names, a header among them; values that aren't numbers are NULL."""
    at = scratch(t.spark)
    k = F.col("s_suppkey")
    rows = t.supplier.select(F.concat(F.lit("t"), F.col("s_nationkey").cast("string")), F.lit("d"), (k % 3).cast("string"), F.lit("output_size"), F.when(k % 5 > 0, (k * 1.5).cast("string")).otherwise("unknown"))
    rows.union(t.spark.createDataFrame([("tool", "dataset", "rep", "metric", "value")], "a string, b string, c string, d string, e string")).write.csv(at)
    return readers.file_sizes(t.spark, at).drop("metric")


@query("""
SELECT CASE WHEN k % 4 = 3 THEN 'FAILED' ELSE 'OK' END AS status, tool, CASE WHEN k % 4 = 1 THEN 1 ELSE rep END AS rep, CASE WHEN k % 4 < 3 THEN k + 0.5 END AS runtime_seconds, CASE WHEN k % 4 < 3 THEN k * 10 END AS max_memory_kb
FROM (SELECT s_suppkey AS k, 't' || s_nationkey AS tool, (s_suppkey % 3 + 1)::INT AS rep FROM supplier)""")
def performance_rows(t: Tables) -> DataFrame:
    """Rows of six fields, of five without a repetition, of seven with an empty one, and of failures."""
    k = F.col("s_suppkey")
    tool, rep, took, mem, ts = F.concat(F.lit("t"), F.col("s_nationkey").cast("string")), (k % 3 + 1).cast("string"), (k + 0.5).cast("string"), (k * 10).cast("string"), F.lit("2026-01-02T03:04:05")
    row = lambda *x: F.concat_ws(",", *x)
    line = F.when(k % 4 == 0, row(tool, F.lit("d"), rep, took, mem, ts)).when(k % 4 == 1, row(tool, F.lit("d"), took, mem, ts)).when(k % 4 == 2, row(tool, F.lit("d"), rep, took, mem, F.lit(""), ts)).otherwise(row(tool, F.lit("d"), rep, F.lit("FAILED")))
    return readers.performance(t.spark, text(t.supplier, line)).select("status", "tool", "rep", "runtime_seconds", "max_memory_kb")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 > 0")
def stale_checkpoints(t: Tables) -> DataFrame:
    runs = t.supplier.select("s_suppkey")
    return route.stale(runs, runs.filter("s_suppkey % 3 = 0"), ["s_suppkey"])


@query("SELECT l_returnflag AS tool, round(avg(l_quantity) / avg(l_extendedprice), 6) AS share, count(*) AS n FROM lineitem GROUP BY ALL")
def first_of_several(t: Tables) -> DataFrame:
    """Facts from the first folder that has any."""
    at = scratch(t.spark)
    g = performance.stats(t.lineitem, ["l_returnflag"], ["l_quantity", "l_extendedprice"], ("mean", "n"))
    rows = g.select(F.col("l_returnflag").alias("tool"), (F.col("l_quantity_mean") / F.col("l_extendedprice_mean")).alias("share"), F.col("l_quantity_n").alias("n"))
    sinks.csv(rows, at)
    return rounded(readers.first_table(t.spark, [f"{at}-corrected", at], "tool string, share double, n long"))
