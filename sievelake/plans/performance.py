"""Performance queries: order lines stand for timed runs, return flags for tools, line numbers for repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import ecology, performance as p, select
from .accuracy import rounded
from .registry import Tables, query


@query("""
SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS l_quantity_mean, round(stddev_samp(l_quantity), 4) AS l_quantity_std,
  round(avg(l_extendedprice), 4) AS l_extendedprice_mean, round(stddev_samp(l_extendedprice), 4) AS l_extendedprice_std
FROM lineitem GROUP BY ALL""")
def group_mean_std_round(t: Tables) -> DataFrame:
    return rounded(p.stats(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"]), 4)


@query("""
SELECT o_orderpriority, round(avg(o_totalprice), 4) AS o_totalprice_mean, round(stddev_samp(o_totalprice), 4) AS o_totalprice_std,
  min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max, count(*) AS o_totalprice_n
FROM orders GROUP BY ALL""")
def group_minmax_flat(t: Tables) -> DataFrame:
    return rounded(p.stats(t.orders, ["o_orderpriority"], ["o_totalprice"], ("mean", "std", "min", "max", "n")), 4)


def _mean_std(df: DataFrame) -> DataFrame:
    return df.withColumns({"o_totalprice_mean": F.round("o_totalprice_mean", 6), "o_totalprice_std": F.round("o_totalprice_std", 4)})


@query("SELECT o_custkey, round(avg(o_totalprice), 6) AS o_totalprice_mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS o_totalprice_std FROM orders GROUP BY ALL")
def std_n1_zero(t: Tables) -> DataFrame:
    return _mean_std(p.stats(t.orders, ["o_custkey"], ["o_totalprice"], kind="sample0"))


@query("SELECT o_custkey, round(avg(o_totalprice), 6) AS o_totalprice_mean, round(stddev_pop(o_totalprice), 4) AS o_totalprice_std FROM orders GROUP BY ALL")
def std_population(t: Tables) -> DataFrame:
    return _mean_std(p.stats(t.orders, ["o_custkey"], ["o_totalprice"], kind="population"))


@query("""
SELECT c_nationkey, o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, count(*) AS n, grouping(c_nationkey)::INT AS upper
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((o_orderstatus), (c_nationkey, o_orderstatus))""")
def hierarchy_two_level(t: Tables) -> DataFrame:
    both = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rounded(p.hierarchy(both, "c_nationkey", "o_orderstatus", "o_totalprice"), 4)


@query("""
WITH b AS (SELECT o_orderpriority AS mode, CASE WHEN o_totalprice > 100000 THEN 'F' ELSE 'O' END AS expected, o_orderstatus AS chosen FROM orders)
SELECT mode, count(*) AS n, count(*) FILTER (WHERE chosen = expected) AS correct, round(avg((chosen = expected)::INT), 6) AS share FROM b GROUP BY mode""")
def branch_correct(t: Tables) -> DataFrame:
    b = t.orders.select(F.col("o_orderpriority").alias("mode"), (F.when(F.col("o_totalprice") > 100000, "F").otherwise("O") == F.col("o_orderstatus")).alias("ok"))
    return rounded(b.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("correct"), F.avg(F.col("ok").cast("int")).alias("share")))


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL")
def distinct_count(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"))


@query("""
WITH m AS (SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY ALL)
SELECT o_orderpriority, max(v) FILTER (WHERE o_orderstatus = 'F') AS "F", max(v) FILTER (WHERE o_orderstatus = 'O') AS "O", max(v) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM m GROUP BY ALL""")
def pivot_status(t: Tables) -> DataFrame:
    means = rounded(t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("v")), 4)
    return p.pivoted(means, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], "v")


@query("""
WITH m AS (SELECT user_id, event_type, count(*) AS v FROM events GROUP BY ALL)
SELECT user_id, coalesce(max(v) FILTER (WHERE event_type = 'click')::VARCHAR, 'N/A') AS click, coalesce(max(v) FILTER (WHERE event_type = 'error')::VARCHAR, 'N/A') AS error,
  coalesce(max(v) FILTER (WHERE event_type = 'view')::VARCHAR, 'N/A') AS view FROM m GROUP BY ALL""")
def pivot_missing(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("v"))
    return p.pivoted(n, ["user_id"], "event_type", ["click", "error", "view"], "v", F.lit("N/A"))


@query("""
WITH m AS (SELECT l_linestatus, l_returnflag, avg(l_extendedprice) AS mean FROM lineitem GROUP BY ALL)
SELECT l_linestatus, l_returnflag, round(mean, 4) AS mean, round(max(CASE WHEN l_returnflag = 'N' THEN mean END) OVER w, 4) AS base_mean,
  round(max(CASE WHEN l_returnflag = 'N' THEN mean END) OVER w / mean, 4) AS speedup FROM m WINDOW w AS (PARTITION BY l_linestatus)""")
def speedup_per_group(t: Tables) -> DataFrame:
    return rounded(p.speedup(t.lineitem, ["l_linestatus"], "l_returnflag", "N", "l_extendedprice"), 4)


@query("""
WITH m AS (SELECT l_returnflag, avg(l_extendedprice) AS mean FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(mean, 4) AS mean, round(b, 4) AS base_mean, round(b / mean, 6) AS speedup FROM m, (SELECT mean AS b FROM m WHERE l_returnflag = 'N')""")
def speedup_overall(t: Tables) -> DataFrame:
    out = p.overall_speedup(t.lineitem, "l_returnflag", "N", "l_extendedprice")
    return out.withColumns({"mean": F.round("mean", 4), "base_mean": F.round("base_mean", 4), "speedup": F.round("speedup", 6)})


@query("SELECT l_orderkey, arg_min(l_extendedprice, (l_linenumber, l_partkey, l_extendedprice)) AS l_extendedprice FROM lineitem GROUP BY ALL")
def first_run_value(t: Tables) -> DataFrame:
    return p.first_run(t.lineitem, ["l_orderkey"], "l_extendedprice", ["l_linenumber", "l_partkey", "l_extendedprice"])


@query("SELECT l_orderkey, round(coalesce(avg(l_quantity) FILTER (WHERE l_linenumber > 1), avg(l_quantity)), 4) AS warm_mean FROM lineitem GROUP BY ALL")
def warm_mean(t: Tables) -> DataFrame:
    return rounded(t.lineitem.groupBy("l_orderkey").agg(p.warm("l_quantity", "l_linenumber").alias("warm_mean")), 4)


@query("""
WITH m AS (SELECT l_returnflag AS tool, 1 / avg(l_quantity) AS speed, 1 / avg(l_extendedprice) AS thrift, avg(1 - l_discount) AS score FROM lineitem GROUP BY ALL),
b AS (SELECT min(speed) s0, max(speed) s1, min(thrift) t0, max(thrift) t1, min(score) c0, max(score) c1 FROM m),
z AS (SELECT tool, CASE WHEN s1 = s0 THEN 1 ELSE (speed - s0) / (s1 - s0) END AS a, CASE WHEN t1 = t0 THEN 1 ELSE (thrift - t0) / (t1 - t0) END AS b, CASE WHEN c1 = c0 THEN 1 ELSE (score - c0) / (c1 - c0) END AS c FROM m, b)
SELECT tool, round(a, 4) AS speed_scaled, round(b, 4) AS thrift_scaled, round(c, 4) AS score_scaled, round((a + b + c) / 3, 4) AS composite FROM z""")
def minmax_composite(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy(F.col("l_returnflag").alias("tool")).agg(F.avg("l_quantity").alias("s"), F.avg("l_extendedprice").alias("m"), F.avg(1 - F.col("l_discount")).alias("f"))
    return rounded(p.composite(m, "tool", "s", "m", "f").drop("speed", "thrift", "score"), 4)


_RANKS = """
WITH v AS (SELECT user_id % 10 AS part, event_type, value FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL),
r AS (SELECT part, event_type, rank() OVER (PARTITION BY part ORDER BY value) + (count(*) OVER (PARTITION BY part, value) - 1) / 2.0 AS k FROM v),
s AS (SELECT part, count(*) FILTER (WHERE event_type = 'click') AS n1, count(*) FILTER (WHERE event_type = 'view') AS n2, sum(k) FILTER (WHERE event_type = 'click') AS w FROM r GROUP BY part)
SELECT part, n1, n2, w::DOUBLE AS rank_sum, round((w - n1 * (n1 + n2 + 1) / 2.0) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0), 6) AS z FROM s WHERE n1 >= 2 AND n2 >= 2
"""


def _ranked(t: Tables) -> DataFrame:
    return p.rank_sum(t.events.withColumn("part", F.col("user_id") % 10), ["part"], "event_type", "click", "view", "value")


@query(_RANKS)
def ranksum_z(t: Tables) -> DataFrame:
    return rounded(_ranked(t))


# The series of the error function; terms stay far below 1e300 for the deviates at hand.
_ERF = "2 / sqrt(pi()) * list_sum(list_transform(range(0, 150), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * n + 1) * ln(greatest(abs(z), 1e-300) / sqrt(2)) - lgamma(n + 1)) / (2 * n + 1)))"


@query(f"""
WITH t AS ({_RANKS.replace("round((w", "((w").replace("/ 12.0), 6)", "/ 12.0))")}), p AS (SELECT *, 1 - {_ERF} AS p FROM t)
SELECT part, n1, n2, rank_sum, round(z, 6) AS z, round(p, 6) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM p""")
def ranksum_p(t: Tables) -> DataFrame:
    """With p-values and stars."""
    return rounded(_ranked(t).withColumn("p", p.two_sided("z")).withColumn("stars", s.stars(F.col("p"))))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY ALL")
def ols_fit(t: Tables) -> DataFrame:
    f = p.fit("l_quantity", "l_extendedprice")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(f["slope"], 4).alias("slope"), F.round(f["intercept"], 3).alias("intercept"), F.round(f["r2"], 6).alias("r2"))


@query("SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY ALL")
def quartiles(t: Tables) -> DataFrame:
    return rounded(p.quartiles(t.events, ["event_type"], "value"))


@query("""
WITH c AS (SELECT p_brand, p_type, count(*)::DOUBLE AS x FROM part GROUP BY ALL), w AS (SELECT *, sum(x) OVER (PARTITION BY p_brand) AS t FROM c)
SELECT p_brand, count(*) AS richness, round(-sum(x / t * log2(x / t)), 6) AS shannon, round(1 - sum((x / t) * (x / t)), 6) AS simpson,
  round(CASE WHEN count(*) FILTER (WHERE x = 2) > 0 THEN count(*) + (count(*) FILTER (WHERE x = 1)) * ((count(*) FILTER (WHERE x = 1)) - 1) / (2.0 * ((count(*) FILTER (WHERE x = 2)) + 1)) ELSE count(*) END::DOUBLE, 6) AS chao1
FROM w GROUP BY p_brand""")
def diversity(t: Tables) -> DataFrame:
    return rounded(ecology.diversity(t.part.withColumn("one", F.lit(1)), ["p_brand"], "p_type", "one"))


@query("""
WITH c AS (SELECT l_returnflag AS s, l_partkey AS k, sum(l_quantity) AS x FROM lineitem GROUP BY ALL), t AS (SELECT s, sum(x) AS t FROM c GROUP BY s)
SELECT a.s AS a, b.s AS b, round(1 - 2 * coalesce((SELECT sum(least(p.x, q.x)) FROM c p JOIN c q USING (k) WHERE p.s = a.s AND q.s = b.s), 0) / (a.t + b.t), 6) AS bray_curtis
FROM t a JOIN t b ON a.s < b.s""")
def bray_curtis(t: Tables) -> DataFrame:
    return rounded(ecology.bray_curtis(t.lineitem, "l_returnflag", "l_partkey", "l_quantity"))


@query("""
WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, count(*) AS contigs, sum(n_chars)::BIGINT AS total, max(n_chars) AS longest, max(n_chars) FILTER (WHERE k = n // 2) AS upper_median FROM r GROUP BY lang""")
def length_stats(t: Tables) -> DataFrame:
    return ecology.lengths(t.documents, ["lang"], "n_chars")


@query("""
WITH r AS (SELECT lang, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS u, sum(n_chars) OVER (PARTITION BY lang) AS a FROM documents)
SELECT lang, max(n_chars) AS n50 FROM r WHERE 2 * u >= a GROUP BY lang""")
def n50(t: Tables) -> DataFrame:
    return ecology.n50(t.documents, ["lang"], "n_chars")


@query("""
WITH m AS (SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY ALL)
SELECT o_orderpriority, o_orderstatus, v FROM m QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY v DESC, o_orderstatus) = 1""")
def argmax_best(t: Tables) -> DataFrame:
    m = rounded(t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("v")), 4)
    return p.best(m, "o_orderstatus", "v", ["o_orderpriority"])


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1")
def top1_largest(t: Tables) -> DataFrame:
    return select.largest(t.documents.select("source", "doc_id", "n_chars"), ["source"], "n_chars", "doc_id")


@query("""
SELECT p_brand, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand
  ORDER BY (NOT contains(lower(p_name), 'clean'))::INT, (NOT regexp_matches(p_name, '_(R)?1[._]'))::INT, length(p_name), p_name) = 1""")
def top1_selector(t: Tables) -> DataFrame:
    return select.top(t.part.select("p_brand", "p_name"), ["p_brand"], select.clean_first("p_name"))


@query("""
WITH c AS (SELECT p_brand, p_name, CASE WHEN contains(lower(p_type), 'standard') OR contains(lower(p_type), 'promo') THEN 0 WHEN contains(lower(p_type), 'economy') THEN 2 ELSE 1 END AS k FROM part)
SELECT p_brand, p_name, k FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY k, length(p_name), p_name) = 1""")
def score_class_selector(t: Tables) -> DataFrame:
    k = select.score_class("p_type", ("standard", "promo"), ("economy",))
    return select.top(t.part.select("p_brand", "p_name", k.alias("k")), ["p_brand"], [F.col("k"), F.length("p_name"), F.col("p_name")])


@query("""
WITH r AS (SELECT source, doc_id, CASE WHEN lang = 'fr' THEN 0 WHEN lang = 'de' THEN 1 WHEN lang = 'en' THEN 2 END AS k FROM documents)
SELECT source, doc_id FROM r WHERE k IS NOT NULL QUALIFY k = min(k) OVER (PARTITION BY source)""")
def priority_selector(t: Tables) -> DataFrame:
    return select.by_pattern(t.documents.select("source", "doc_id", "lang"), ["source"], "lang", ["^fr$", "^de$", "^en$"]).drop("lang")


@query("""
SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 END AS ord, count(*) AS n
FROM orders GROUP BY ALL ORDER BY 2 NULLS LAST, 1""")
def ordered_categorical(t: Tables) -> DataFrame:
    order = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
    n = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).withColumn("ord", s.ordinal(F.col("o_orderpriority"), order))
    return select.ordered(n, "o_orderpriority", order, F.col("o_orderpriority")).select("o_orderpriority", "ord", "n")


@query("SELECT c_custkey, ((row_number() OVER (ORDER BY c_custkey) - 1) // 15)::BIGINT AS chunk FROM customer")
def manifest_chunks(t: Tables) -> DataFrame:
    return select.chunked(t.customer.select("c_custkey"), "c_custkey", 15)


@query("SELECT l_linestatus, l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY 1, 2, 3")
def multi_key_sort(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_linestatus", "l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).orderBy("l_linestatus", "l_returnflag", F.col("l_linenumber").cast("int"))


@query("SELECT min(v) AS least, max(v) AS most, count(*) AS n FROM (SELECT round(avg(o_totalprice), 4) AS v FROM orders GROUP BY o_orderpriority)")
def summary_extremes(t: Tables) -> DataFrame:
    m = rounded(t.orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("v")), 4)
    return m.agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, ts, value, round(value / first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS relative FROM events WHERE value > 0")
def relative_to_first(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.filter("value > 0").select("user_id", "ts", "value", F.round(F.col("value") / F.first("value").over(w), 6).alias("relative"))
