"""Integration, expression and generation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import generate, host_index, integrate, reads, route, sensor
from ..sources import sinks
from ..streaming.windows import windowed
from .accuracy import rounded
from .registry import Tables, query


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(t: Tables) -> DataFrame:
    return integrate.key_union([t.customer.select(F.col("c_nationkey").alias("nationkey")), t.supplier.select(F.col("s_nationkey").alias("nationkey"))], ["nationkey"])


@query("""
SELECT 'customer' AS source, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment, 1 AS rep FROM customer
UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL, 1 FROM supplier""")
def union_by_name_tagged(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return integrate.with_default(integrate.tagged({"customer": a, "supplier": b, "missing": None}), "rep", F.lit(1))


@query("""
WITH c AS (SELECT c_nationkey AS k, count(*) AS n, round(avg(c_acctbal), 4) AS bal FROM customer GROUP BY ALL),
s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY ALL), u AS (SELECT k FROM c UNION SELECT k FROM s)
SELECT u.k, c.n AS customer_n, c.bal AS customer_bal, s.n AS supplier_n FROM u LEFT JOIN c USING (k) LEFT JOIN s USING (k)""")
def full_outer_spine(t: Tables) -> DataFrame:
    c = rounded(t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("bal")), 4)
    return integrate.spine({"customer": c, "supplier": t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))}, ["k"])


@query("""
WITH o AS (SELECT c_nationkey AS k, count(*) AS n, round(avg(o_totalprice), 4) AS price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
f AS (SELECT c_nationkey AS k, arg_min(c_name, c_custkey) AS name FROM customer GROUP BY ALL)
SELECT n_nationkey AS k, n_name AS nation_name, o.n AS orders_n, o.price AS orders_price, f.name AS first_name FROM nation LEFT JOIN o ON n_nationkey = o.k LEFT JOIN f ON n_nationkey = f.k""")
def wide_multi_source(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("price"))
    f = integrate.first_match(t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"), "c_custkey"), ["k"], "c_custkey").drop("c_custkey")
    n = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return integrate.spine({"nation": n, "orders": rounded(o, 4), "first": f}, ["k"])


@query("SELECT c_custkey, c_nationkey, coalesce(n_name, 'other') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def lookup_default(t: Tables) -> DataFrame:
    dim = t.nation.filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return integrate.lookup(t.customer.select("c_custkey", "c_nationkey"), dim, "c_nationkey", "n_name", F.lit("other"))


@query("""
SELECT s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT s_suppkey, -1.0 FROM supplier WHERE s_suppkey % 3 = 0""")
def keyed_upsert(t: Tables) -> DataFrame:
    old = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return integrate.upsert(old, old.filter("k % 3 = 0").withColumn("v", F.lit(-1.0)), ["k"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def audit_matched(t: Tables) -> DataFrame:
    return integrate.audit(t.nation.select("n_nationkey", "n_name"), t.supplier.select(F.col("s_nationkey").alias("n_nationkey")), ["n_nationkey"])[0]


_NAME = "(p_size || 'M_' || (p_partkey % 101) || 'pct_' || lower(split_part(p_type, ' ', 1)) || '_' || CASE WHEN p_partkey % 3 = 0 THEN 'even' ELSE 'lognormal' END || '_' || CASE WHEN p_partkey % 2 = 0 THEN 'SE' ELSE 'PE' END)"


def _names(t: Tables) -> DataFrame:
    n = F.concat(F.col("p_size").cast("string"), F.lit("M_"), (F.col("p_partkey") % 101).cast("string"), F.lit("pct_"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit("_"), F.when(F.col("p_partkey") % 3 == 0, "even").otherwise("lognormal"), F.lit("_"), F.when(F.col("p_partkey") % 2 == 0, "SE").otherwise("PE"))
    return t.part.select("p_partkey", n.alias("name"))


@query(f"""
SELECT p_partkey, name, regexp_extract(name, '^(\\d+)M', 1)::INT AS reads_m, regexp_extract(name, '_(\\d+)pct_', 1)::INT AS host_pct, split_part(name, '_', 3) AS complexity, split_part(name, '_', 4) AS abundance, split_part(name, '_', 5) AS mode
FROM (SELECT p_partkey, {_NAME} AS name FROM part)""")
def name_parse(t: Tables) -> DataFrame:
    return _names(t).withColumns(s.parse_dataset(F.col("name")))


@query(f"""
WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE {_NAME} END AS name FROM part), x AS (SELECT *, nullif(regexp_extract(name, '(\\d+)pct', 1), '')::INT AS pct FROM n)
SELECT p_partkey, pct, round(pct / 100.0, 6)::DOUBLE AS fraction, coalesce(round(pct / 100.0, 6), 0.5)::DOUBLE AS fraction_or_half,
  coalesce(nullif(regexp_extract(name, '^(\\d+)M', 1), '')::BIGINT * 1000000, 0) AS reads, lower(split_part(name, '_', 1)) AS species FROM x""")
def host_pct_variants(t: Tables) -> DataFrame:
    n = _names(t).join(t.part.select("p_partkey", "p_name"), "p_partkey").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.col("p_name")).otherwise(F.col("name")).alias("name"))
    c = F.col("name")
    return n.select("p_partkey", s.host_percent(c).alias("pct"), F.round(s.host_fraction(c), 6).alias("fraction"), F.round(s.host_fraction(c, 0.5), 6).alias("fraction_or_half"), s.reads(c).alias("reads"), s.species(c).alias("species"))


@query("""
WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN (event_id % 7) || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') || ':05' WHEN 2 THEN (event_id % 59) || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') || '.50'
  WHEN 3 THEN (event_id % 500) || '.25' ELSE '' END AS v FROM events),
x AS (SELECT event_id, v, CASE WHEN v IN ('unknown', '') THEN NULL WHEN len(string_split(v, ':')) = 3 THEN split_part(v, ':', 1)::DOUBLE * 3600 + split_part(v, ':', 2)::DOUBLE * 60 + split_part(v, ':', 3)::DOUBLE
  WHEN len(string_split(v, ':')) = 2 THEN split_part(v, ':', 1)::DOUBLE * 60 + split_part(v, ':', 2)::DOUBLE ELSE v::DOUBLE END AS s FROM e)
SELECT event_id, v, s AS seconds, trunc(s)::BIGINT AS whole, coalesce(s, 0) AS or_zero, s / 60 AS minutes FROM x""")
def duration_parse(t: Tables) -> DataFrame:
    i = F.col("event_id")
    two = F.lpad((i % 60).cast("string"), 2, "0")
    v = F.when(i % 5 == 0, "unknown").when(i % 5 == 1, F.concat((i % 7).cast("string"), F.lit(":"), two, F.lit(":05"))).when(i % 5 == 2, F.concat((i % 59).cast("string"), F.lit(":"), two, F.lit(".50"))).when(i % 5 == 3, F.concat((i % 500).cast("string"), F.lit(".25"))).otherwise("")
    c = F.col("v")
    return t.events.select("event_id", v.alias("v")).select("event_id", "v", s.seconds(c).alias("seconds"), s.whole_seconds(c).alias("whole"), s.seconds(c, True).alias("or_zero"), s.minutes(s.seconds(c)).alias("minutes"))


@query("""
WITH x AS (SELECT event_id, (event_id * 37 % 9000) + 0.27 AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', s::DOUBLE) WHEN s < 3600 THEN printf('%d:%05.2f', floor(s / 60)::INT, (s % 60)::DOUBLE) ELSE printf('%d:%02d:%05.2f', floor(s / 3600)::INT, floor(s % 3600 / 60)::INT, (s % 60)::DOUBLE) END AS clock,
  CASE WHEN s < 1024 THEN printf('%.0f MB', s::DOUBLE) ELSE printf('%.1f GB', (s / 1024)::DOUBLE) END AS memory, printf('%.6f', s::DOUBLE) AS six FROM x""")
def duration_format(t: Tables) -> DataFrame:
    x = (F.col("event_id") * 37 % 9000) + F.lit(0.27)
    return t.events.select("event_id", s.format_seconds(x).alias("clock"), s.format_memory(x).alias("memory"), s.six(x).alias("six"))


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice / 1024 AS mb, l_extendedprice / 1048576 AS gb, l_extendedprice / 1e6 AS gb_decimal,
  CASE WHEN l_quantity >= 10 THEN 'high' WHEN l_quantity >= 5 THEN 'medium' ELSE 'low' END AS bucket, CASE WHEN l_discount < 0.001 THEN '***' WHEN l_discount < 0.01 THEN '**' WHEN l_discount < 0.05 THEN '*' ELSE 'ns' END AS stars,
  CASE WHEN l_quantity / 25 > 1 THEN 'faster' ELSE 'slower' END AS label FROM lineitem""")
def unit_and_buckets(t: Tables) -> DataFrame:
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", s.mb(p).alias("mb"), s.gb(p).alias("gb"), s.gb(p, True).alias("gb_decimal"), s.bucket(q).alias("bucket"), s.stars(F.col("l_discount")).alias("stars"), s.faster(q / 25).alias("label"))


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || ' x' WHEN 1 THEN event_type ELSE 'unknown' END AS backend,
  CASE event_id % 5 WHEN 0 THEN (event_id % 100)::VARCHAR WHEN 1 THEN event_type ELSE 'unknown' END AS pct FROM events""")
def ansi_and_kv_extract(t: Tables) -> DataFrame:
    """Quoted values, with blanks and colours; plain cells; unquoted values and empty cells, which are unknown."""
    i = F.col("event_id")
    quoted = F.concat(F.lit("\x1b[32mINFO\x1b[0m run \x1b[3mchosen_backend\x1b[0m=\""), F.col("event_type"), F.lit(" x\" estimated_host_pct = \""), (i % 100).cast("string"), F.lit("\""))
    log = F.when(i % 5 == 0, quoted).when(i % 5 == 1, F.concat(F.lit(" "), F.col("event_type"), F.lit(" "))).when(i % 5 == 2, F.lit("chosen_backend=1.5 estimated_host_pct=")).otherwise("")
    return t.events.select("event_id", s.field(log, "chosen_backend").alias("backend"), s.field(log, "estimated_host_pct").alias("pct"))


@query("SELECT event_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, count(*) AS n FROM events GROUP BY ALL")
def json_metadata(t: Tables) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return t.events.groupBy("event_type").agg(F.sum(k).alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, 'm' || (event_id % 3)) AS mode, coalesce('m' || (event_id % 3), event_type) AS chosen_mode FROM events")
def column_coalesce(t: Tables) -> DataFrame:
    i = F.col("event_id")
    return s.two_way(t.events.select("event_id", F.when(i % 2 == 0, F.col("event_type")).alias("mode"), F.concat(F.lit("m"), (i % 3).cast("string")).alias("chosen_mode")), "mode", "chosen_mode")


@query("""
WITH c AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
w AS (SELECT *, CASE WHEN n = 1 THEN 1.0 WHEN k = 1 THEN 0.5 ELSE 0.5 / (n - 1) END AS sk, k ** -1.5 AS pl FROM c)
SELECT p_partkey, round(1.0 / n, 6)::DOUBLE AS even, round(sk / sum(sk) OVER b, 6)::DOUBLE AS skewed, round(pl / sum(pl) OVER b, 6)::DOUBLE AS powerlaw FROM w WINDOW b AS (PARTITION BY p_brand)""")
def abundance_profiles(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    k = t.part.select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("k"))
    for kind in ("even", "skewed", "powerlaw"):
        k = generate.abundance(k, ["p_brand"], "k", kind).withColumnRenamed("fraction", kind)
    return rounded(k.select("p_partkey", "even", "skewed", "powerlaw"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_nationkey % 5 = r_regionkey")
def round_robin(t: Tables) -> DataFrame:
    return generate.round_robin(t.nation.select("n_nationkey", "n_name"), t.region.select(F.col("r_regionkey").alias("k"), "r_name"), "n_nationkey", "k")


@query("SELECT event_id, (event_id // 3)::BIGINT AS dataset, (event_id % 3 + 1)::BIGINT AS rep FROM events")
def task_grid(t: Tables) -> DataFrame:
    d, r = s.task(F.col("event_id"))
    return t.events.select("event_id", d.alias("dataset"), r.alias("rep"))


@query("""
SELECT p_partkey, (p_size * 1000000)::BIGINT AS total_reads, floor(p_size * 1000000 * ((p_partkey % 101) / 100.0)::DOUBLE + 1e-6)::BIGINT AS host_reads,
  (p_size * 1000000)::BIGINT - floor(p_size * 1000000 * ((p_partkey % 101) / 100.0)::DOUBLE + 1e-6)::BIGINT AS microbial_reads FROM part""")
def read_split(t: Tables) -> DataFrame:
    d = t.part.select("p_partkey", (F.col("p_size") * 1_000_000).cast("bigint").alias("total_reads"), ((F.col("p_partkey") % 101) / 100.0).alias("host_frac"))
    return generate.plan_reads(d).drop("host_frac")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber - 1 < 2 THEN 'microbe' ELSE 'host' END AS label FROM lineitem")
def positional_labels(t: Tables) -> DataFrame:
    return generate.positional_labels(t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).alias("i")), "i", F.lit(2)).drop("i")


#: Letters and blanks as bases; other characters are none.
_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz ", "ACGTACGTACGTACGTACGTACGTACT"
# Long stretches in pieces that overlap, as finding a place in a string costs its distance. A row for each k-mer, with its place.
_KMERS = """
  (SELECT {id}, x, a + i AS p, list_min(m[i + 1:i + 5]) AS z FROM (SELECT *, unnest(range(0, len(m) - 4)) AS i FROM (
    SELECT {id}, x, a, list_transform(range(1, length(r) - 29), lambda i: least(substr(r, i, 31), translate(reverse(substr(r, i, 31)), 'ACGT', 'TGCA'))) AS m
    FROM (SELECT {id}, x, a, substr(r, a + 1, 512 + 34) AS r FROM (SELECT {id}, x, r, unnest(range(0, length(r) - 34, 512)) AS a
      FROM (SELECT {id}, unnest(s) AS r, unnest(range(len(s))) AS x FROM (SELECT {id}, regexp_extract_all(translate(lower(text), '""" + f"{_LETTERS}', '{_BASES}" + """'), '[ACGT]{{35,}}') AS s FROM {table})))))))"""
_GROUPS = f"""
WITH k AS {_KMERS.format(id="doc_id", table="documents")}, h AS (SELECT DISTINCT z FROM {_KMERS.format(id="item_id", table="benchmark")}),
g AS (SELECT doc_id, z IN (SELECT z FROM h) AS known, (lag(z) OVER (PARTITION BY doc_id, x ORDER BY p)) IS DISTINCT FROM z AS first FROM k),
r AS (SELECT doc_id, count(*) FILTER (WHERE known AND first) AS hits, count(*) FILTER (WHERE known) AS kmers, count(*) AS total FROM g GROUP BY doc_id)"""


def _as_reads(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Documents and what may be in them, as bases."""
    bases = F.translate(F.lower("text"), _LETTERS, _BASES)
    return t.documents.select("doc_id", bases.alias("seq")), t.benchmark.select(bases.alias("seq"))


# Different k-mers of 31 letters with their numbers of two bits a letter, hashed as the sensor does; a 200th of them.
_SKETCH = """
  (SELECT *, (xor(x, x >> 31)::HUGEINT * 11400714819323198485) % 18446744073709551616 AS h FROM (
    SELECT {id}, n, list_reduce(list_transform(string_split(translate(z, 'ACGT', '0123'), ''), lambda c: c::UBIGINT), lambda a, b: a * 4 + b) AS x FROM (
      SELECT {id}, count(*) AS n, least(substr(r, i, 31), translate(reverse(substr(r, i, 31)), 'ACGT', 'TGCA')) AS z
      FROM (SELECT {id}, r, unnest(range(1, length(r) - 29)) AS i FROM (SELECT {id}, substr(r, a + 1, 512 + 30) AS r FROM (SELECT {id}, r, unnest(range(0, length(r) - 30, 512)) AS a
        FROM (SELECT {id}, unnest(regexp_extract_all(translate(lower(text), '""" + f"{_LETTERS}', '{_BASES}" + """'), '[ACGT]{{31,}}')) AS r FROM {table})))) GROUP BY ALL))
  WHERE h < 18446744073709551616 // 200)"""
_SENSED = f"""
WITH m AS {_SKETCH.format(id="source", table="documents")}, h AS (SELECT DISTINCT h FROM {_SKETCH.format(id="item_id", table="benchmark")}),
c AS (SELECT source, count(*) AS sketched, count(*) FILTER (WHERE h IN (SELECT h FROM h)) AS shared, coalesce(sum(n) FILTER (WHERE h IN (SELECT h FROM h)), 0) AS times FROM m GROUP BY source),
s AS (SELECT d.source, coalesce(sketched, 0) AS sketched, coalesce(shared, 0) AS shared, coalesce(shared, 0)::DOUBLE / (SELECT count(*) FROM h) AS containment, coalesce(times::DOUBLE / nullif(shared, 0), 0) AS depth
  FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN c ON c.source IS NOT DISTINCT FROM d.source)"""


def _as_samples(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Sources as samples, and what may be in them, as bases."""
    bases = F.translate(F.lower("text"), _LETTERS, _BASES)
    return t.documents.select("source", bases.alias("seq")), t.benchmark.select(bases.alias("seq"))


@query(f"{_SENSED} SELECT source, sketched, shared, round(containment, 6) AS containment, round(pow(containment, 1.0 / 31), 6) AS ani, round(depth, 6) AS depth, pow(containment, 1.0 / 31) >= 0.95 AS positive FROM s")
def sample_sensor(t: Tables) -> DataFrame:
    """What share of the host's sketch each sample has."""
    return rounded(sensor.sensed(*_as_samples(t), "source"))


@query(f"{_SENSED} SELECT d.source, count(*) AS n, pow(any_value(containment), 1.0 / 31) < 0.9 AS skipped FROM documents d JOIN s ON s.source IS NOT DISTINCT FROM d.source GROUP BY d.source")
def sensed_prefilter(t: Tables) -> DataFrame:
    """Samples in which the sensor finds no host skip its removal."""
    found = sensor.sensed(*_as_samples(t), "source", least_ani=0.9)
    sizes = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    need, skip = route.host_negative(sizes.filter("source IS NOT NULL"), found.filter("NOT positive"), ["source"])
    nameless = sizes.filter("source IS NULL").crossJoin(F.broadcast(found.filter("source IS NULL").select((~F.col("positive")).alias("skipped"))))
    return need.withColumn("skipped", F.lit(False)).unionByName(skip.withColumn("skipped", F.lit(True))).unionByName(nameless)


@query(f"{_GROUPS} SELECT doc_id, hits, kmers FROM r WHERE hits >= 2")
def kmer_classification(t: Tables) -> DataFrame:
    return reads.classified(*_as_reads(t), "doc_id")


@query(f"{_GROUPS} SELECT doc_id, hits, kmers, round(limits.c, 2) AS confidence FROM r, (VALUES (0.05::DOUBLE, 2), (0.25::DOUBLE, 5)) AS limits(c, n) WHERE hits >= n AND kmers >= c * total")
def kmer_confidence(t: Tables) -> DataFrame:
    """An index that is built once and opened again, and two questions asked of one count."""
    documents, host = _as_reads(t)
    counts = host_index.counted(documents, host_index.reopened(t.spark, host_index.build(host).path), "doc_id")
    asked = counts.withColumn("q", F.explode(F.array(*[F.struct(F.lit(c).alias("confidence"), F.lit(n).alias("groups")) for c, n in ((0.05, 2), (0.25, 5))])))
    return host_index.assigned(asked, F.col("q.groups"), F.col("q.confidence")).select("doc_id", "hits", "kmers", "q.confidence")


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS succeeded, count(*) FILTER (WHERE o_orderstatus <> 'F') AS failed FROM orders")
def success_totals(t: Tables) -> DataFrame:
    return route.totals(t.orders, "o_orderstatus", "F")


@query("SELECT s_suppkey, greatest(1, least(16, coalesce(floor((64 * 0.8) / nullif(s_suppkey % 20, 0)), 16)))::BIGINT AS workers FROM supplier")
def memory_workers(t: Tables) -> DataFrame:
    """A database of size 0 sets no limit."""
    return t.supplier.select("s_suppkey", route.workers(F.lit(16), (F.col("s_suppkey") % 20).cast("double"), F.lit(64.0)).cast("bigint").alias("workers"))


@query("""
SELECT l_linenumber, '{"l_linenumber":' || l_linenumber || ',"n":' || count(*) || ',"bad":null,"none":null}' AS json FROM lineitem GROUP BY l_linenumber""")
def key_numbers_json(t: Tables) -> DataFrame:
    """A number that isn't one becomes null, and nulls stay."""
    rows = t.lineitem.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n")).withColumns({"bad": F.lit(float("nan")), "none": F.lit(None).cast("string")})
    return sinks.json_rows(rows).select(F.get_json_object("json", "$.l_linenumber").cast("int").alias("l_linenumber"), "json")


@query("SELECT region, nations, lower(region) AS key FROM (SELECT r_name AS region, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL)")
def column_names_normalised(t: Tables) -> DataFrame:
    g = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias(" Region ")).agg(F.count(F.lit(1)).alias("N"))
    return s.lower_columns(g, {"n": "nations"}).withColumn("key", F.lower("region"))


@query("SELECT item_id, split_part(text, ' ', 1) || '[start]new \\ $1[end]' || text AS text FROM benchmark")
def marker_replacement(t: Tables) -> DataFrame:
    """What stands between the markers goes, over lines and to the first end; the rest stays."""
    rows = t.benchmark.select("item_id", F.concat(F.split_part("text", F.lit(" "), F.lit(1)), F.lit("[start]"), F.col("text"), F.lit("\nold[end]"), F.col("text")).alias("text"))
    return sinks.between(rows, "text", "[start]", "[end]", "new \\ $1")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(t: Tables) -> DataFrame:
    """An addition: the same windows as the streaming form."""
    return rounded(windowed(t.events, by=["event_type"]), 4)


@query("SELECT doc_id FROM documents WHERE contains(text, 'license') OR contains(text, 'Licensed') OR contains(text, 'Copyright')")
def path_predicates(t: Tables) -> DataFrame:
    return t.documents.filter(s.contains_any(F.col("text"), ["license", "Licensed", "Copyright"])).select("doc_id")


@query("""
WITH r AS (SELECT s_nationkey, s_name AS q, string_split(s_name, '') AS c FROM supplier)
SELECT s_nationkey, count(*) AS reads, sum(length(q))::BIGINT AS bases,
  round(sum(len(list_filter(c, lambda x: ord(x) - 33 >= 20)))::DOUBLE / sum(length(q)), 6) AS q20, round(sum(len(list_filter(c, lambda x: ord(x) - 33 >= 30)))::DOUBLE / sum(length(q)), 6) AS q30,
  round(sum(len(list_filter(c, lambda x: upper(x) IN ('G', 'C'))))::DOUBLE / sum(length(q)), 6) AS gc FROM r GROUP BY s_nationkey""")
def reads_qc(t: Tables) -> DataFrame:
    """Names stand for sequences and for their quality strings."""
    return rounded(reads.summary(t.supplier.select("s_nationkey", F.col("s_name").alias("seq"), F.col("s_name").alias("qual")), ["s_nationkey"]))


@query("""
WITH u AS (
  SELECT o_orderstatus AS tool, o_totalprice AS runtime, o_shippriority AS rep FROM (SELECT *, 1 AS o_shippriority FROM orders) WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 2 = 0
  UNION ALL SELECT o_orderstatus, o_totalprice, 1 FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 2 = 1)
SELECT tool, count(*) AS n, round(avg(runtime / 60), 6) AS minutes_mean, round(stddev_samp(runtime / 60), 6) AS minutes_std, min(rep) AS rep FROM u GROUP BY tool""")
def matched_panel(t: Tables) -> DataFrame:
    """Two halves of a panel from separate sources, one without repetitions, summarised together."""
    o = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", F.col("o_orderstatus").alias("tool"), F.col("o_totalprice").alias("runtime"))
    both = integrate.tagged({"a": o.filter("o_orderkey % 2 = 0").withColumn("rep", F.lit(1)), "b": o.filter("o_orderkey % 2 = 1")})
    both = integrate.with_default(both, "rep", F.lit(1)).withColumn("minutes", s.minutes(F.col("runtime")))
    return rounded(both.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.avg("minutes").alias("minutes_mean"), F.stddev_samp("minutes").alias("minutes_std"), F.min("rep").alias("rep")))


@query("""
WITH p AS (SELECT o_orderstatus AS tool, round(avg(o_totalprice), 4) AS runtime FROM orders GROUP BY ALL), a AS (SELECT l_linestatus AS tool, round(avg(1 - l_discount), 6) AS f1 FROM lineitem GROUP BY ALL)
SELECT tool, runtime, f1 FROM p LEFT JOIN a USING (tool)""")
def performance_with_accuracy(t: Tables) -> DataFrame:
    """Tables whose key columns differ in case."""
    p = rounded(t.orders.groupBy(F.col("o_orderstatus").alias("tool")).agg(F.avg("o_totalprice").alias("runtime")), 4)
    a = s.lower_columns(t.lineitem.groupBy(F.col("l_linestatus").alias(" Tool")).agg(F.round(F.avg(1 - F.col("l_discount")), 6).alias("F1_score")), {"f1_score": "f1"})
    return p.join(a, "tool", "left")
