"""Expressions and aggregates that no other query runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions.metrics import HOST
from ..operators import confusion, ecology, generate, integrate, mapping, performance as p, reads, route, scan, select
from .accuracy import rounded
from .registry import Tables, query

_RUNS = "SELECT o_custkey % 4 + 1 AS n_samples, o_orderstatus AS tool, o_totalprice / 100 AS s FROM orders"


def _runs(t: Tables) -> DataFrame:
    return t.orders.select((F.col("o_custkey") % 4 + 1).alias("n_samples"), F.col("o_orderstatus").alias("tool"), (F.col("o_totalprice") / 100).alias("s"))


@query(f"""
SELECT n_samples, round(avg(s), 4) AS s_mean, round(stddev_samp(s), 4) AS s_std, round(avg(n_samples / (s / 3600)), 6) AS sph_mean, round(stddev_samp(n_samples / (s / 3600)), 6) AS sph_std FROM ({_RUNS}) GROUP BY ALL""")
def throughput_by_samples(t: Tables) -> DataFrame:
    runs = _runs(t).withColumn("sph", s.per_hour(F.col("n_samples"), F.col("s")))
    out = p.stats(runs, ["n_samples"], ["s", "sph"])
    return out.select("n_samples", *[F.round(c, 4).alias(c) for c in ("s_mean", "s_std")], *[F.round(c, 6).alias(c) for c in ("sph_mean", "sph_std")])


@query(f"""
WITH r AS (SELECT tool, n_samples * 1000000 AS reads, s FROM ({_RUNS}))
SELECT tool, round(avg(reads / s), 4) AS per_second, round(avg(reads / s / 1000), 6) AS thousand_per_second, round(avg(reads / 1e6 / (s / 60)), 6) AS million_per_minute FROM r GROUP BY tool""")
def throughput_units(t: Tables) -> DataFrame:
    n, x = F.col("n_samples") * 1_000_000, F.col("s")
    g = _runs(t).groupBy("tool").agg(F.avg(s.per_second(n, x)).alias("per_second"), F.avg(s.per_second(n, x) / 1000).alias("thousand_per_second"), F.avg(s.million_per_minute(n, x)).alias("million_per_minute"))
    return g.select("tool", F.round("per_second", 4).alias("per_second"), F.round("thousand_per_second", 6).alias("thousand_per_second"), F.round("million_per_minute", 6).alias("million_per_minute"))


@query("""
WITH m AS (SELECT l_linestatus, l_returnflag, avg(l_extendedprice) AS mean FROM lineitem GROUP BY ALL), b AS (SELECT *, max(CASE WHEN l_returnflag = 'N' THEN mean END) OVER (PARTITION BY l_linestatus) AS base FROM m)
SELECT l_linestatus, l_returnflag, round(base / mean, 6) AS mem_ratio_base_over_tool, round(mean / base, 6) AS mem_ratio_tool_over_base FROM b""")
def memory_ratios(t: Tables) -> DataFrame:
    out = p.ratios(t.lineitem, ["l_linestatus"], "l_returnflag", "N", "l_extendedprice", "mem_ratio")
    return rounded(out.drop("mean", "base_mean"))


@query("""
WITH o AS (SELECT o_orderpriority AS k, avg(o_totalprice) / 60 AS old_min FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), n AS (SELECT o_orderpriority AS k, avg(o_totalprice) / 60 AS new_min FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
SELECT k, round(old_min, 4) AS old_min, round(new_min, 4) AS new_min, round(new_min / old_min, 6) AS slowdown FROM o JOIN n USING (k)""")
def slowdown_minutes(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderpriority").alias("k"), "o_orderstatus", "o_totalprice")
    out = p.slowdown(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), ["k"], "o_totalprice")
    return out.select("k", F.round("old_min", 4).alias("old_min"), F.round("new_min", 4).alias("new_min"), F.round("slowdown", 6).alias("slowdown"))


@query("""
WITH x AS (SELECT s_suppkey, (s_suppkey % 7) / 7.0 AS a, (s_suppkey % 5) / 5.0 + 0.001 * (s_suppkey % 3) AS b FROM supplier)
SELECT s_suppkey, CASE WHEN a > 0 AND b > 0 THEN round(abs(a - b), 6) END AS gap, CASE WHEN a > 0 AND b > 0 THEN CASE WHEN abs(a - b) < 0.01 THEN 'comparable' WHEN a > b THEN 'one' ELSE 'two' END END AS verdict FROM x""")
def accuracy_verdict(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    x = t.supplier.select("s_suppkey", ((k % 7) / 7.0).alias("a"), ((k % 5) / 5.0 + 0.001 * (k % 3)).alias("b"))
    v = s.verdict(F.col("a"), F.col("b"), ("one", "two"))
    return x.select("s_suppkey", F.round(v["gap"], 6).alias("gap"), v["verdict"].alias("verdict"))


_SPELLED = "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'FAILED' WHEN 1 THEN ' NA ' WHEN 2 THEN 'nan' WHEN 3 THEN '1:xx' WHEN 4 THEN (event_id % 50) || ':07' WHEN 5 THEN ' 12.5 ' WHEN 6 THEN '1e2' ELSE 'abc' END AS v FROM events"


@query(f"""
WITH e AS ({_SPELLED}) SELECT event_id, CASE event_id % 8 WHEN 4 THEN (event_id % 50) * 60 + 7.0 WHEN 5 THEN 12.5 WHEN 6 THEN 100.0 END AS seconds,
  CASE event_id % 8 WHEN 5 THEN 12.5 WHEN 6 THEN 100.0 END AS number, CASE event_id % 8 WHEN 4 THEN printf('%.2f', ((event_id % 50) * 60 + 7)::DOUBLE) WHEN 5 THEN '12.50' WHEN 6 THEN '100.00' END AS two FROM e""")
def missing_values(t: Tables) -> DataFrame:
    """What stands for a missing number, and what isn't one."""
    i = F.col("event_id")
    v = F.when(i % 8 == 0, "FAILED").when(i % 8 == 1, " NA ").when(i % 8 == 2, "nan").when(i % 8 == 3, "1:xx").when(i % 8 == 4, F.concat((i % 50).cast("string"), F.lit(":07"))).when(i % 8 == 5, " 12.5 ").when(i % 8 == 6, "1e2").otherwise("abc")
    return t.events.select("event_id", s.seconds(v).alias("seconds"), s.number(v).alias("number"), s.text2(s.seconds(v)).alias("two"))


@query("""
WITH b AS (SELECT l_returnflag AS mode, CASE l_linenumber % 5 WHEN 0 THEN NULL WHEN 1 THEN l_quantity > 25 WHEN 2 THEN NULL WHEN 3 THEN l_quantity > 10 ELSE false END AS ok FROM lineitem)
SELECT mode, count(*) AS n, count(ok) AS known, count(*) FILTER (WHERE ok) AS correct, round(avg(ok::INT), 6) AS share FROM b GROUP BY mode""")
def branch_correct_strings(t: Tables) -> DataFrame:
    """Choices that come as text, in any case, and some that aren't known: these count neither way."""
    k, q = F.col("l_linenumber") % 5, F.col("l_quantity")
    text = F.when(k == 0, "").when(k == 1, F.when(q > 25, " True").otherwise("False ")).when(k == 2, "unknown").when(k == 3, F.when(q > 10, "TRUE").otherwise("0")).otherwise("no")
    ok = s.truth(text)
    return rounded(t.lineitem.select(F.col("l_returnflag").alias("mode"), ok.alias("ok")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count("ok").alias("known"), F.count_if("ok").alias("correct"), F.avg(F.col("ok").cast("int")).alias("share")))


@query("SELECT event_id FROM events WHERE value IS NOT NULL AND event_id % 3 > 0")
def rows_without_nulls(t: Tables) -> DataFrame:
    return t.events.select("event_id", "value", F.when(F.col("event_id") % 3 > 0, 1).alias("k")).na.drop(subset=["value", "k"]).select("event_id")


@query("""
WITH d AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE 'panel_' || p_size || '_rep' || (p_partkey % 10) END AS n FROM part)
SELECT p_partkey, nullif(regexp_extract(n, '^(.+)_rep([0-9]+)$', 1), '') AS dataset, nullif(regexp_extract(n, '^(.+)_rep([0-9]+)$', 2), '')::INT AS rep, lower(trim('  ' || upper(n) || ' ')) AS key FROM d""")
def dataset_and_rep(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    d = t.part.select("p_partkey", F.when(k % 4 == 0, F.col("p_name")).otherwise(F.concat(F.lit("panel_"), F.col("p_size").cast("string"), F.lit("_rep"), (k % 10).cast("string"))).alias("n"))
    dataset, rep = s.dataset_and_rep(F.col("n"))
    return d.select("p_partkey", dataset.alias("dataset"), rep.alias("rep"), F.lower(F.trim(F.concat(F.lit("  "), F.upper("n"), F.lit(" ")))).alias("key"))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%.1fm', s / 60) ELSE printf('%.1fh', s / 3600) END AS took,
  coalesce(printf('%.4f', v), 'N/A') AS number, round(100.0 * share, 6) AS percent, round(greatest(0, least(1, share * 3 - 1)), 6) AS clipped
FROM (SELECT o_orderkey, o_orderstatus, (o_orderkey * 13 % 9001 + 0.27)::DOUBLE AS s, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS v, (o_orderkey % 100) / 99.0 AS share FROM orders)""")
def formats(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    share = (k % 100) / 99.0
    return t.orders.select(
        "o_orderkey", s.recode(F.col("o_orderstatus"), {"F": "failed", "O": "open"}).alias("status"), s.format_time((k * 13 % 9001) + F.lit(0.27)).alias("took"), s.format_number(F.when(k % 3 > 0, F.col("o_totalprice"))).alias("number"),
        F.round(s.percent(share), 6).alias("percent"), F.round(s.clipped(share * 3 - 1), 6).alias("clipped"),
    )


@query("SELECT k AS half, round_even(x, 2) AS two, round_even(x, 4) AS four FROM (SELECT s_suppkey AS k, (2 * s_suppkey + 1) / 8.0 AS x FROM supplier)")
def half_to_even(t: Tables) -> DataFrame:
    """Means of one row each, so that halves are exact."""
    x = t.supplier.select(F.col("s_suppkey").alias("half"), ((2 * F.col("s_suppkey") + 1) / 8.0).alias("x"))
    two, four = (p.stats(x, ["half"], ["x"], ("mean",), digits=d).withColumnRenamed("x_mean", n) for d, n in ((2, "two"), (4, "four")))
    return two.join(four, "half")


@query("""
SELECT p_partkey, CASE WHEN d >= 1e-6 THEN round(d, 9) END AS depth, CASE p_partkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 30 WHEN 2 THEN 100 ELSE 30 END AS species
FROM (SELECT p_partkey, 1000.0 * p_size * (p_partkey % 10) / 9 * 150 / 1e12 AS d FROM part)""")
def generation_sizes(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "low").when(k % 4 == 1, "medium").when(k % 4 == 2, "high").otherwise("odd")
    return t.part.select("p_partkey", F.round(s.coverage(1000.0 * F.col("p_size"), (k % 10) / F.lit(9), F.lit(150), F.lit(1e12)), 9).alias("depth"), s.species_count(kind).alias("species"))


@query("""
WITH g AS (SELECT DISTINCT p_size, p_partkey % 4 AS h, p_size * 1000000 AS reads, CASE p_partkey % 4 WHEN 0 THEN 'SE' ELSE 'PE' END AS mode FROM part)
SELECT (h * 25) || '%' AS host, count(*) AS datasets FROM g GROUP BY h""")
def dataset_grid(t: Tables) -> DataFrame:
    """Lines of a grid, many of them repeated, by their share of host."""
    h = F.col("p_partkey") % 4
    line = F.concat_ws(":", F.concat(F.lit("d"), F.col("p_size").cast("string")), (F.col("p_size") * 1_000_000).cast("string"), F.format_string("%.2f", h * 0.25), F.lit("high"), F.lit("lognormal"), F.when(h == 0, "SE").otherwise("PE"))
    return generate.by_host_share(generate.grid(t.part.select(line.alias("value"))))


@query("""
WITH u AS (SELECT p_brand, p_partkey, ('0x' || substr(md5('42:0:' || p_partkey), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u, ('0x' || substr(md5('42:1:' || p_partkey), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS v FROM part),
w AS (SELECT p_brand, p_partkey, exp(2.0::DOUBLE * sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - u)) * cos(2 * pi() * v)) AS w FROM u)
SELECT p_brand, p_partkey, round(w / sum(w) OVER (PARTITION BY p_brand), 9) AS fraction FROM w""")
def lognormal_profile(t: Tables) -> DataFrame:
    """Shares drawn by a seeded hash: the same however rows lie, and in other engines."""
    return rounded(generate.abundance(t.part.select("p_brand", "p_partkey"), ["p_brand"], "p_partkey"), 9)


@query("""
WITH h AS (SELECT o_orderkey AS id, ('0x' || substr(md5('42:0:' || o_orderkey), 1, 13))::BIGINT AS a, ('0x' || substr(md5('42:1:' || o_orderkey), 1, 13))::BIGINT AS b FROM orders)
SELECT 'r' || id AS read_id, 'i' || item_id AS label, substr(text, (b % greatest(length(text) - 99, 1) + 1)::INT, 100) AS seq, repeat('I', least(100, length(text))::INT) AS qual
FROM h JOIN benchmark ON item_id = a % (SELECT count(*) FROM benchmark)""")
def simulated_reads(t: Tables) -> DataFrame:
    """Reads cut out of references, one for each order, at places that a seeded hash of its key tells."""
    refs = t.benchmark.select(F.col("item_id").alias("g"), F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("label"), F.col("text").alias("seq"))
    return generate.reads(t.orders, "o_orderkey", refs, 100)


@query("""
WITH a AS (SELECT o_orderpriority AS k, avg(o_totalprice) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT o_orderpriority AS k, avg(o_totalprice) AS b FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '2-HIGH' GROUP BY ALL)
SELECT k, round(a, 4) AS a_mean, round(b, 4) AS b_mean FROM a JOIN b USING (k)""")
def two_index_join(t: Tables) -> DataFrame:
    """Aggregates of two sources by dataset; datasets that one of them lacks are left out."""
    one = lambda f, n: t.orders.filter(f).groupBy(F.col("o_orderpriority").alias("k")).agg(F.round(F.avg("o_totalprice"), 4).alias(n))
    return one("o_orderstatus = 'F'", "a_mean").join(one("o_orderstatus = 'P' AND o_orderpriority <> '2-HIGH'", "b_mean"), "k")


@query("SELECT n_regionkey, (row_number() OVER w - 1)::INT AS i, n_nationkey AS a, CASE WHEN row_number() OVER w <= 3 THEN n_name END AS b FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")
def zipped_lists(t: Tables) -> DataFrame:
    """Lists side by side by place; the shorter one ends earlier."""
    x = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    lists = t.nation.groupBy("n_regionkey").agg(x.alias("x")).select("n_regionkey", F.col("x.n_nationkey").alias("a"), F.slice("x.n_name", 1, 3).alias("b"))
    return generate.zipped(lists, "a", "b")


@query("""
WITH u AS (SELECT 'orders' AS source, o_orderstatus AS tool, o_totalprice AS v FROM orders UNION ALL SELECT 'lines', l_linestatus, l_extendedprice FROM lineitem)
SELECT source, tool, round(avg(v), 4) AS v_mean, round(stddev_samp(v), 4) AS v_std, count(*) AS v_n FROM u GROUP BY ALL""")
def integrated_stats(t: Tables) -> DataFrame:
    """Statistics over facts of two sources; groups count their rows."""
    u = integrate.tagged({"orders": t.orders.select(F.col("o_orderstatus").alias("tool"), F.col("o_totalprice").alias("v")), "lines": t.lineitem.select(F.col("l_linestatus").alias("tool"), F.col("l_extendedprice").alias("v"))})
    return rounded(p.stats(u, ["source", "tool"], ["v"], ("mean", "std", "n")), 4)


@query("SELECT l_returnflag, count(*) AS v_n, count(CASE WHEN l_linenumber > 1 THEN 1 END) AS with_value FROM lineitem GROUP BY ALL")
def rows_not_values(t: Tables) -> DataFrame:
    v = t.lineitem.withColumn("v", F.when(F.col("l_linenumber") > 1, F.col("l_quantity")))
    return p.stats(v, ["l_returnflag"], ["v"], ("n",)).join(v.groupBy("l_returnflag").agg(F.count("v").alias("with_value")), "l_returnflag")


@query("SELECT tool, round(avg(h), 6) AS shannon, round(avg(n), 6) AS richness FROM (SELECT s, tool, count(*) AS n, -sum(x / t * log2(x / t)) AS h FROM (SELECT s, tool, x, sum(x) OVER (PARTITION BY s, tool) AS t FROM (SELECT l_suppkey AS s, l_returnflag AS tool, l_linenumber AS k, sum(l_quantity)::DOUBLE AS x FROM lineitem GROUP BY ALL)) GROUP BY s, tool) GROUP BY tool")
def mean_diversity(t: Tables) -> DataFrame:
    d = ecology.diversity(t.lineitem, ["l_suppkey", "l_returnflag"], "l_linenumber", "l_quantity")
    return rounded(p.stats(d.withColumnRenamed("l_returnflag", "tool"), ["tool"], ["shannon", "richness"], ("mean",)).withColumnsRenamed({"shannon_mean": "shannon", "richness_mean": "richness"}))


@query("SELECT row_number() OVER (ORDER BY v, k)::BIGINT AS place, k FROM (SELECT DISTINCT p_brand AS k, min(p_size) AS v FROM part GROUP BY ALL)")
def sorted_distinct(t: Tables) -> DataFrame:
    """Distinct values in the order of a metric, numbered by ranges of it."""
    rows = t.part.groupBy(F.col("p_brand").alias("k")).agg(F.min("p_size").alias("v"))
    return scan.numbered(rows, [F.col("v"), F.col("k")]).select("place", "k")


@query("SELECT row_number() OVER (ORDER BY s, h)::BIGINT AS place, s, h FROM (SELECT DISTINCT p_size AS s, p_partkey % 10 AS h FROM part)")
def sorted_by_reads_and_host(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_size").alias("s"), (F.col("p_partkey") % 10).alias("h")).distinct()
    return scan.numbered(rows, [F.col("s"), F.col("h")]).select("place", "s", "h")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'forced' WHEN pct < 10 THEN 'align' WHEN pct > 30 AND reads > 20000000 THEN 'classify_recheck' ELSE 'align' END AS backend
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 40.0 ELSE o_orderkey % 60 END AS pct, o_custkey * 500000 AS reads FROM orders)""")
def routes_overridden(t: Tables) -> DataFrame:
    """A percentage given by the user takes the survey's place, and a forced backend that of the rule."""
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", route.route((k % 60).cast("double"), F.col("o_custkey") * 500_000, F.when(k % 3 == 0, 40.0), F.when(k % 5 == 0, "forced")).alias("backend"))


@query("""
WITH t AS (SELECT doc_id, quality = 0 AS host FROM labels WHERE quality IS NOT NULL), k AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars >= 1000)
SELECT count(*) FILTER (WHERE host AND NOT kept) AS tp, count(*) FILTER (WHERE NOT host AND NOT kept) AS fp, count(*) FILTER (WHERE NOT host AND kept) AS tn, count(*) FILTER (WHERE host AND kept) AS fn FROM (SELECT host, doc_id IN (SELECT doc_id FROM k) AS kept FROM t)""")
def kept_beyond_truth(t: Tables) -> DataFrame:
    """Kept ids that the truth lacks are ignored, and repeated ones count once."""
    kept = t.documents.filter("n_chars >= 1000").select("doc_id")
    strangers = kept.union(kept).union(kept.select(-F.col("doc_id") - 1))
    truth = t.labels.filter("quality IS NOT NULL").select("doc_id", (F.col("quality") == 0).alias("is_host"), F.lit(1).alias("one"))
    return confusion.confusion(truth, strangers, ["doc_id"], ["one"], HOST).drop("one")


def _reads(t: Tables) -> DataFrame:
    """Orders as reads of 64 bases: qualities from digits, low where the digits are letters, 8 or 9."""
    digits = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    qual = F.translate(F.concat(digits, digits), "abcdef89", "########")
    k = F.col("o_orderkey")
    qual = F.when(k % 4 == 0, F.repeat(F.lit("#"), 64)).when(k % 4 == 1, F.repeat(F.lit("I"), 64)).otherwise(qual)
    return t.orders.select("o_orderkey", F.col("o_orderstatus").alias("tool"), F.when(k % 8 == 5, F.concat(F.repeat(F.lit("ACGT"), 13), F.lit("AGATCGGAAGAG"))).otherwise(F.repeat(F.lit("ACGG"), 16)).alias("seq"), qual.alias("qual"))


_READS = """
WITH r AS (SELECT o_orderkey AS k, o_orderstatus AS tool, CASE WHEN o_orderkey % 8 = 5 THEN repeat('ACGT', 13) ELSE repeat('ACGG', 16) END AS seq, o_orderkey % 8 = 5 AS adapter,
  CASE o_orderkey % 4 WHEN 0 THEN repeat('#', 64) WHEN 1 THEN repeat('I', 64) ELSE translate(md5(o_orderkey::VARCHAR) || md5(o_orderkey::VARCHAR), 'abcdef89', '########') END AS q FROM orders),
w AS (SELECT *, list_filter(range(1, length(seq) - 2), lambda i: ord(substr(q, i, 1)) + ord(substr(q, i + 1, 1)) + ord(substr(q, i + 2, 1)) + ord(substr(q, i + 3, 1)) - 132 >= 80) AS good FROM r),
c AS (SELECT k, tool, adapter, CASE WHEN len(good) > 0 THEN substr(seq, list_min(good), list_max(good) + 4 - list_min(good)) ELSE '' END AS s, CASE WHEN len(good) > 0 THEN substr(q, list_min(good), list_max(good) + 4 - list_min(good)) ELSE '' END AS q, len(good) = 0 AS low FROM w)
"""


@query(_READS + "SELECT k AS o_orderkey, s AS seq, q AS qual FROM c WHERE length(s) >= 50")
def reads_trimmed(t: Tables) -> DataFrame:
    """Reads of all kinds: cut at both ends, too short after it, and without a good window."""
    return reads.trimmed(_reads(t), adapter="AGATCGGAAGAG").select("o_orderkey", "seq", "qual")


@query(_READS + """SELECT tool, count(*) AS reads_in, count(*) FILTER (WHERE length(s) >= 50) AS reads_out, count(*) FILTER (WHERE adapter) AS adapter, count(*) FILTER (WHERE NOT low AND length(s) < 50) AS too_short,
  count(*) FILTER (WHERE low) AS low_quality, sum(CASE WHEN length(s) >= 50 THEN length(s) END)::BIGINT AS bases,
  round(sum(len(list_filter(range(1, length(q) + 1), lambda i: ord(substr(q, i, 1)) >= 53))) FILTER (WHERE length(s) >= 50) / sum(length(s)) FILTER (WHERE length(s) >= 50), 6) AS q20,
  round(sum(len(list_filter(range(1, length(q) + 1), lambda i: ord(substr(q, i, 1)) >= 63))) FILTER (WHERE length(s) >= 50) / sum(length(s)) FILTER (WHERE length(s) >= 50), 6) AS q30,
  round(sum(length(s) - length(translate(s, 'GC', ''))) FILTER (WHERE length(s) >= 50) / sum(length(s)) FILTER (WHERE length(s) >= 50), 6) AS gc FROM c GROUP BY tool""")
def reads_quality_record(t: Tables) -> DataFrame:
    return rounded(reads.quality_record(_reads(t), ["tool"], adapter="AGATCGGAAGAG"))


#: Bases of an order: its key's digests, a base a digit.
_BASES = "translate(md5(k::VARCHAR) || md5('b' || k), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_ADAPTERS = ("AGATCGGAAGAGCACA", "AGATCGGAAGAGCGTC")


def _bases(k) -> Column:
    k = k.cast("string")
    return F.translate(F.concat(F.md5(k.cast("binary")), F.md5(F.concat(F.lit("b"), k).cast("binary"))), "0123456789abcdef", "ACGT" * 4)


@query(f"""
WITH i AS (SELECT o_orderkey AS k, {_BASES} AS b FROM (SELECT *, o_orderkey AS k FROM orders)),
r AS (SELECT k, CASE WHEN k % 3 = 0 THEN lower(s) ELSE s END AS s FROM (SELECT k, substr(substr(b, 1, (k % 60 + 5)::INT) || CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'AGATCGGATGAGCACA' ELSE 'AGATCGGAAGAGCACA' END || reverse(b), 1, 64) AS s FROM i)),
p AS (SELECT k, s, coalesce(list_min(list_filter(range(1, length(s) - 2), lambda p: hamming(substr(upper(s), p, least(16, length(s) - p + 1)::INT), substr('AGATCGGAAGAGCACA', 1, least(16, length(s) - p + 1)::INT)) <= least(16, length(s) - p + 1) // 8)) - 1, length(s)) AS n FROM r)
SELECT k AS o_orderkey, substr(s, 1, n::INT) AS seq, n < length(s) AS adapter_cut, CASE WHEN n < 4 THEN 'low_quality' WHEN n < 30 THEN 'too_short' ELSE 'passed' END AS status FROM p""")
def reads_adapters(t: Tables) -> DataFrame:
    """Whole adapters, ones with a mismatch, in either case of letters, and parts of them at the end of a read."""
    k, b = F.col("o_orderkey"), _bases(F.col("o_orderkey"))
    adapter = F.when(k % 5 == 0, "").when(k % 5 == 1, "AGATCGGATGAGCACA").otherwise(_ADAPTERS[0])
    seq = F.substring(F.concat(F.substring(b, F.lit(1), (k % 60 + 5).cast("int")), adapter, F.reverse(b)), 1, 64)
    r = t.orders.select("o_orderkey", F.when(k % 3 == 0, F.lower(seq)).otherwise(seq).alias("seq"))
    return reads.judged(r.withColumn("qual", F.repeat(F.lit("I"), F.length("seq"))), adapter=_ADAPTERS[0], least_length=30).select("o_orderkey", "seq", "adapter_cut", "status")


@query(f"""
WITH i AS (SELECT k, substr(b, 1, (20 + k % 60)::INT) AS f, reverse(b) AS after FROM (SELECT k, {_BASES} AS b FROM (SELECT o_orderkey AS k FROM orders))),
r AS (SELECT k, substr(f || '{_ADAPTERS[0]}' || after, 1, 60) AS s1, substr(CASE WHEN k % 4 = 1 THEN 'N' || substr(translate(reverse(f), 'ACGT', 'TGCA'), 2) ELSE translate(reverse(f), 'ACGT', 'TGCA') END || '{_ADAPTERS[1]}' || after, 1, (60 - k % 3)::INT) AS s2 FROM i),
l AS (SELECT *, list_max(list_filter(range(30, length(s2) + 1), lambda n: hamming(substr(s1, 1, n::INT), translate(reverse(substr(s2, 1, n::INT)), 'ACGT', 'TGCA')) <= least(5, n * 20 // 100))) AS insert FROM r),
c AS (SELECT *, substr(s1, 1, coalesce(insert, 60)::INT) AS c1, substr(s2, 1, coalesce(insert, 60)::INT) AS c2 FROM l)
SELECT k AS o_orderkey, insert::INT AS insert, c1 AS seq1, c2 AS seq2, coalesce(insert < 60, false) AS adapter_cut, CASE WHEN least(length(c1), length(c2)) < 50 THEN 'too_short' ELSE 'passed' END AS status FROM c""")
def pairs_trimmed(t: Tables) -> DataFrame:
    """Mates that read beyond their insert are cut where it ends, without knowledge of the adapters."""
    k, b = F.col("o_orderkey"), _bases(F.col("o_orderkey"))
    i = t.orders.select(k, F.substring(b, F.lit(1), (k % 60 + 20).cast("int")).alias("f"), F.reverse(b).alias("after"))
    back = F.translate(F.reverse("f"), "ACGT", "TGCA")
    back = F.when(k % 4 == 1, F.concat(F.lit("N"), F.substr(back, F.lit(2)))).otherwise(back)
    r = i.select(k, F.substring(F.concat("f", F.lit(_ADAPTERS[0]), "after"), 1, 60).alias("seq1"), F.substring(F.concat(back, F.lit(_ADAPTERS[1]), "after"), F.lit(1), (60 - k % 3).cast("int")).alias("seq2"))
    r = r.withColumns({"qual1": F.repeat(F.lit("I"), F.length("seq1")), "qual2": F.repeat(F.lit("I"), F.length("seq2"))})
    return reads.judged_pairs(r).select("o_orderkey", "insert", "seq1", "seq2", "adapter_cut", "status")


@query("SELECT p_brand, p_name, length(p_name)::INT AS path_length FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_name) = 1")
def first_by_name(t: Tables) -> DataFrame:
    """Of files without an order the first by path, and how long its path is."""
    return integrate.first_match(t.part.select("p_brand", "p_name", F.length("p_name").alias("path_length")), ["p_brand"], "p_name")


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus = 'F' GROUP BY ALL")
def panel_members(t: Tables) -> DataFrame:
    rows = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & (F.col("o_orderstatus") == "F"))
    return select.ordered(rows.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean")), "o_orderpriority", ["5-LOW", "1-URGENT"])


def _mates(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Contigs of 512 bases made of the digests of each item's id, and a read for each order, two of which are mates: cut out of a
    contig, with three substitutions and from the other strand, or with two letters lost; strangers; and reads with too many
    edits."""
    letters = lambda c: F.translate(c, "0123456789abcdef", "ACGT" * 4)
    digest = lambda x: F.md5(x.cast("string").cast("binary"))
    seq = letters(F.concat(*[digest(F.concat(F.lit(f"{j}:"), F.col("item_id").cast("string"))) for j in range(16)]))
    host = t.benchmark.select("item_id", F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("contig"), seq.alias("seq"))
    k = F.col("o_orderkey")
    own = t.orders.select(k, F.pmod(k, F.lit(host.count())).alias("item_id"), letters(F.concat(*[digest(F.concat(F.lit(f"s{j}:"), k.cast("string"))) for j in range(4)])).alias("stranger"))
    cut = own.join(host.select("item_id", "seq"), "item_id").withColumn("r", F.substring(F.col("seq"), (k % 412 + 1).cast("int"), F.lit(100)))
    other = lambda c: F.translate(c, "ACGT", "CGTA")
    at = lambda a, n: F.substring("r", a, n)
    swapped = F.concat(at(1, 19), other(at(20, 1)), at(21, 29), other(at(50, 1)), at(51, 29), other(at(80, 1)), at(81, 20))
    many = F.concat(*[F.concat(at(a, 5), other(at(a + 5, 1))) for a in range(1, 97, 6)])
    read = F.when(k % 4 == 3, F.substring("stranger", 1, 100)).when(k % 8 == 6, many).when(k % 4 == 1, F.translate(F.reverse(swapped), "ACGT", "TGCA")).when(k % 4 == 2, F.concat(at(1, 40), at(43, 58))).otherwise(F.lower("r"))
    return cut.select("o_orderkey", read.alias("seq")), host.select("contig", "seq")


@query("SELECT o_orderkey, NOT (o_orderkey % 4 = 3 OR o_orderkey % 8 = 6) AS mapped FROM orders")
def reads_mapped(t: Tables) -> DataFrame:
    """Reads with known edits from either strand, and strangers."""
    r, host = _mates(t)
    return mapping.mapped(r, mapping.prepared(host, "contig"), "o_orderkey").select("o_orderkey", "mapped")


@query("SELECT o_orderkey // 2 AS pair FROM orders GROUP BY pair HAVING NOT bool_or(NOT (o_orderkey % 4 = 3 OR o_orderkey % 8 = 6))")
def pairs_depleted(t: Tables) -> DataFrame:
    """Pairs of which neither mate aligns, by the mates' own bases."""
    r, host = _mates(t)
    flagged = mapping.mapped(r, mapping.prepared(host, "contig"), "o_orderkey").withColumn("pair", F.expr("o_orderkey DIV 2"))
    return confusion.pairs_kept(flagged, ["pair"], "mapped")


@query("""
WITH s AS (SELECT o_orderpriority AS library, o_orderkey AS k FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderkey), o_orderkey) <= 1000)
SELECT library, count(*) AS surveyed_reads, count(*) FILTER (WHERE NOT (k % 4 = 3 OR k % 8 = 6)) AS mapped_reads, round(100.0 * count(*) FILTER (WHERE NOT (k % 4 = 3 OR k % 8 = 6)) / count(*), 6) AS estimated_host_pct FROM s GROUP BY library""")
def survey_mapped(t: Tables) -> DataFrame:
    """A survey of each library, its reads held against the host."""
    r, host = _mates(t)
    drawn = route.survey(r.join(t.orders.select("o_orderkey", F.col("o_orderpriority").alias("library")), "o_orderkey"), "o_orderkey", 1000, by=["library"])
    return rounded(route.host_percent(mapping.mapped(drawn, mapping.prepared(host, "contig"), "o_orderkey"), ["library"], "mapped"))
