"""Accuracy queries: labelled documents stand for reads with known class, languages for datasets."""

from __future__ import annotations

from contextlib import suppress
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import norm_id
from ..functions.metrics import HOST, KEPT, with_polarity
from ..operators import confusion as c
from ..operators import integrate, route, stages
from ..session import scratch
from ..sources import layout
from .registry import Tables, query

KEPT_CHARS = 1000
TRUTH_SQL = """
WITH truth AS (
  SELECT l.doc_id, d.lang, l.quality = 0 AS host, d.n_chars >= 1000 AS kept
  FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL),
c AS (
  SELECT lang,
    count(*) FILTER (WHERE host AND NOT kept) AS hg, count(*) FILTER (WHERE host AND kept) AS hk,
    count(*) FILTER (WHERE NOT host AND kept) AS mk, count(*) FILTER (WHERE NOT host AND NOT kept) AS mg
  FROM truth GROUP BY lang),
"""


def truth(t: Tables) -> DataFrame:
    labels = t.labels.filter("quality IS NOT NULL").select("doc_id", (F.col("quality") == 0).alias("is_host"))
    return labels.join(t.documents.select("doc_id", "lang"), "doc_id")


def kept(t: Tables) -> DataFrame:
    return t.documents.filter(F.col("n_chars") >= KEPT_CHARS).select("doc_id")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n, k in df.dtypes if k == "double"})


def metric_sql(f1_one: bool = False, rates: str = "class", total: bool = True) -> str:
    share = lambda a, b: f"round(coalesce(({a})::DOUBLE / nullif({b}, 0), 0), 6)"
    f1 = share("2 * tp", "2 * tp + fp + fn")
    if f1_one:
        f1 = f"CASE WHEN tp + fp = 0 AND tp + fn = 0 THEN 1.0::DOUBLE ELSE {f1} END"
    t = "tp + fp + tn + fn"
    out = f"SELECT lang, tp, fp, tn, fn, {share('tp + tn', t)} AS accuracy, {share('tp', 'tp + fp')} AS precision, {share('tp', 'tp + fn')} AS recall, {f1} AS f1"
    if rates:
        out += f", {share('fn', t if rates == 'all' else 'tp + fn')} AS host_remaining_rate, {share('fp', t if rates == 'all' else 'tn + fp')} AS microbe_loss_rate"
    if total:
        out += f", {t} AS total_reads"
    return out + " FROM m"


@query(TRUTH_SQL + "m AS (SELECT lang, hg AS tp, mg AS fp, mk AS tn, hk AS fn FROM c) " + metric_sql())
def confusion_host_positive(t: Tables) -> DataFrame:
    return rounded(c.scored(truth(t), kept(t), ["doc_id"], ["lang"], HOST))


@query(TRUTH_SQL + "m AS (SELECT lang, mk AS tp, hk AS fp, hg AS tn, mg AS fn FROM c) " + metric_sql(True, "", False))
def confusion_kept_positive(t: Tables) -> DataFrame:
    return rounded(c.scored(truth(t), kept(t), ["doc_id"], ["lang"], KEPT))


@query(TRUTH_SQL + "m AS (SELECT lang, hk AS tp, mk AS fp, mg AS tn, hg AS fn FROM c) " + metric_sql())
def confusion_removed_input(t: Tables) -> DataFrame:
    return rounded(c.scored(truth(t), kept(t), ["doc_id"], ["lang"], HOST, removed=True))


@query(TRUTH_SQL + "m AS (SELECT lang, hk AS tp, mk AS fp, mg AS tn, hg AS fn FROM c) " + metric_sql(rates="all", total=False))
def error_rates_inverted(t: Tables) -> DataFrame:
    return rounded(c.inverted(truth(t), kept(t), ["doc_id"], ["lang"]))


@query(TRUTH_SQL + "m AS (SELECT lang, mk AS tp, hk AS fp, hg AS tn, mg AS fn FROM c) " + metric_sql(True, "", False))
def polarity_repair(t: Tables) -> DataFrame:
    """A table whose rows have either polarity, in one."""
    both = truth(t)
    a = c.confusion(both.filter("lang IN ('en', 'fr')"), kept(t), ["doc_id"], ["lang"], HOST).withColumn("polarity", F.lit(HOST))
    b = c.confusion(both.filter("NOT lang IN ('en', 'fr')"), kept(t), ["doc_id"], ["lang"], KEPT).withColumn("polarity", F.lit(KEPT))
    return rounded(with_polarity(a.unionByName(b), KEPT).drop("polarity"))


@query("SELECT doc_id, lang FROM documents WHERE n_chars >= 1000 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def kept_anti(t: Tables) -> DataFrame:
    return t.documents.filter(F.col("n_chars") >= KEPT_CHARS).select("doc_id", "lang").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE n_chars >= 1000 AND doc_id IN (SELECT doc_id FROM labels)")
def kept_semi(t: Tables) -> DataFrame:
    return t.documents.filter(F.col("n_chars") >= KEPT_CHARS).select("doc_id", "lang").join(t.labels.select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE n_chars >= 1000 INTERSECT SELECT doc_id FROM labels WHERE quality = 0")
def kept_intersect(t: Tables) -> DataFrame:
    return kept(t).intersect(t.labels.filter("quality = 0").select("doc_id"))


@query("SELECT doc_id FROM labels WHERE quality = 0 EXCEPT SELECT doc_id FROM documents WHERE n_chars >= 1000")
def kept_except(t: Tables) -> DataFrame:
    return t.labels.filter("quality = 0").select("doc_id").subtract(kept(t))


@query("SELECT conv_id, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def key_dedup_last(t: Tables) -> DataFrame:
    return c.last_label(t.conversations, ["conv_id"], "role", "turn")


@query("SELECT role = 'user' AS is_host, count(DISTINCT conv_id) AS keys FROM conversations GROUP BY 1")
def key_in_both_classes(t: Tables) -> DataFrame:
    sets = c.label_sets(t.conversations.select("conv_id", (F.col("role") == "user").alias("is_host")), ["conv_id"])
    return sets.groupBy("is_host").agg(F.count(F.lit(1)).alias("keys"))


@query("SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1 AND l.quality = 0)")
def runs_without_truth(t: Tables) -> DataFrame:
    toxic = t.documents.join(t.labels.filter("toxic = 1 AND quality = 0").select("doc_id"), "doc_id", "left_semi")
    return c.unpaired_runs(t.documents.select("doc_id", "source"), toxic, ["source"])


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING NOT bool_or(length(text) > 200)")
def pair_rule(t: Tables) -> DataFrame:
    return c.pairs_kept(t.conversations.select("conv_id", (F.length("text") > 200).alias("aligned")), ["conv_id"])


@query("""
SELECT d.doc_id FROM documents d
WHERE NOT d.n_chars < 500 AND d.doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars >= 500 AND lang = 'es')""")
def recheck_two_pass(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "n_chars", "lang")
    first = docs.filter("n_chars < 500")
    left = docs.join(first.select("doc_id"), "doc_id", "left_anti")
    return route.recheck(docs.select("doc_id"), first, left.filter("lang = 'es'"), ["doc_id"])


@query("""
SELECT lang, round(100.0 * (count(*) FILTER (WHERE n_chars < 300)) / count(*), 6) AS residual_pct, sum(n_chars)::BIGINT AS size,
  CASE WHEN sum(n_chars) >= 1 AND 100.0 * (count(*) FILTER (WHERE n_chars < 300)) / count(*) <= 5.0 THEN 'Promoted' ELSE 'Failed' END AS status
FROM documents GROUP BY lang""")
def validation_gate(t: Tables) -> DataFrame:
    out = t.documents.groupBy("lang").agg((100.0 * F.count_if(F.col("n_chars") < 300) / F.count(F.lit(1))).alias("residual_pct"), F.sum("n_chars").alias("size"))
    return rounded(route.validated(out, "size", "residual_pct"))


_IDS = "SELECT page_id, '@' || url || '#0/1 extra' AS h FROM pages"


@query(f"""
WITH i AS ({_IDS}), k AS (SELECT page_id, split_part(h, ' ', 1) AS t FROM i)
SELECT page_id, regexp_replace(split_part(substr(t, 2), '#', 1), '/[^/]*$', '') AS n1,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '#0/1$', ''), '#0/2$', ''), '/1$', ''), '/2$', '') AS n2,
  split_part(split_part(substr(t, 2), '/', 1), '#', 1) AS n3,
  regexp_replace(regexp_replace(t, '^@+', ''), '/[12]$', '') AS n4, substr(t, 2) AS n5 FROM k""")
def id_normalise(t: Tables) -> DataFrame:
    h = F.concat(F.lit("@"), F.col("url"), F.lit("#0/1 extra"))
    return t.pages.select("page_id", *[norm_id(h, r).alias(r) for r in ("n1", "n2", "n3", "n4", "n5")])


@query("""
WITH s AS (SELECT source, lang, n_chars < 500 AS mapped FROM documents),
e AS (SELECT source, count(*) AS surveyed_reads, count(*) FILTER (WHERE mapped) AS mapped_reads FROM s GROUP BY source)
SELECT source, surveyed_reads, mapped_reads, round(100.0 * mapped_reads / surveyed_reads, 6) AS estimated_host_pct,
  CASE WHEN 100.0 * mapped_reads / surveyed_reads < 10 THEN 'align'
       WHEN 100.0 * mapped_reads / surveyed_reads > 30 AND surveyed_reads * 1000000 > 20000000 THEN 'classify_recheck' ELSE 'align' END AS backend
FROM e""")
def survey_route(t: Tables) -> DataFrame:
    e = route.host_percent(t.documents.select("source", (F.col("n_chars") < 500).alias("mapped")), ["source"], "mapped")
    return rounded(e.withColumn("backend", route.route(F.col("estimated_host_pct"), F.col("surveyed_reads") * 1_000_000)))


@query("""
WITH r AS (SELECT l_returnflag AS library, (l_orderkey * 10 + l_linenumber) * 10 + k AS read_id, k = 0 AND l_quantity < 20 AS mapped FROM lineitem, range(8) AS t(k)),
s AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY library ORDER BY md5('42:' || read_id), read_id) <= 100000)
SELECT library, count(*) AS surveyed_reads, count(*) FILTER (WHERE mapped) AS mapped_reads, 100.0 * count(*) FILTER (WHERE mapped) / count(*) AS estimated_host_pct, sum(read_id)::BIGINT AS ids FROM s GROUP BY library""")
def survey_sample(t: Tables) -> DataFrame:
    """Of each library 100,000 reads by seeded hash, and the share of host among them."""
    line = t.lineitem.select(F.col("l_returnflag").alias("library"), "l_orderkey", "l_linenumber", "l_quantity", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    r = line.select("library", ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10 + F.col("k")).alias("read_id"), ((F.col("k") == 0) & (F.col("l_quantity") < 20)).alias("mapped"))
    drawn = route.survey(r, "read_id", by=["library"])
    return route.host_percent(drawn, ["library"], "mapped").join(drawn.groupBy("library").agg(F.sum("read_id").alias("ids")), "library")


@query("SELECT l_orderkey, l_quantity FROM (SELECT l_orderkey, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey) ORDER BY md5('42:' || l_orderkey), l_orderkey LIMIT 100000")
def survey_orders(t: Tables) -> DataFrame:
    """A fixed number of orders by seeded hash."""
    return route.survey(t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("l_quantity")), "l_orderkey")


@query("SELECT source, lang FROM (SELECT DISTINCT source FROM documents) CROSS JOIN (SELECT DISTINCT lang FROM documents) EXCEPT SELECT source, lang FROM documents WHERE n_chars > 10000")
def cross_plan_minus_done(t: Tables) -> DataFrame:
    d = t.documents
    return integrate.outstanding([d.select("source").distinct(), d.select("lang").distinct()], d.filter("n_chars > 10000"), ["source", "lang"])


@query("""
WITH h AS (SELECT lang FROM documents GROUP BY lang HAVING avg(n_chars) > 3000)
SELECT lang, count(*) AS n, lang IN (SELECT lang FROM h) AS skipped FROM documents GROUP BY lang""")
def sample_prefilter(t: Tables) -> DataFrame:
    sizes = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("a"))
    need, skip = route.host_negative(sizes, sizes.filter("a > 3000"), ["lang"])
    return need.withColumn("skipped", F.lit(False)).unionByName(skip.withColumn("skipped", F.lit(True))).drop("a")


@query("""
WITH p AS (SELECT lang, source, CASE WHEN count(*) > 3 THEN 3 ELSE 2 END AS stage, max(n_chars) AS size FROM documents GROUP BY ALL),
s AS (SELECT lang, source, CASE WHEN min(n_chars) > 50 THEN 3 ELSE 1 END AS stage, max(n_chars) FILTER (WHERE doc_id % 3 > 0) AS size FROM documents GROUP BY ALL)
SELECT p.lang, p.source, p.stage FROM p LEFT JOIN s USING (lang, source) WHERE s.stage IS NULL OR s.stage < p.stage OR s.size IS DISTINCT FROM p.size""")
def resume_plan(t: Tables) -> DataFrame:
    g = t.documents.groupBy("lang", "source")
    mark = route.fingerprint("source", "size", "lang")
    plan = g.agg(F.when(F.count(F.lit(1)) > 3, 3).otherwise(2).alias("stage"), F.max("n_chars").alias("size")).withColumn("fingerprint", mark).drop("size")
    seen = F.max(F.when(F.col("doc_id") % 3 > 0, F.col("n_chars")))
    state = g.agg(F.when(F.min("n_chars") > 50, 3).otherwise(1).alias("stage"), seen.alias("size")).withColumn("fingerprint", mark).drop("size")
    return route.resumable(plan, state, ["lang", "source"]).drop("fingerprint")


_TOOLS = {"long": "d.n_chars >= 1000", "mid": "d.n_chars >= 500", "even": "d.doc_id % 2 = 0", "none": "false"}


@query("WITH m AS (" + " UNION ALL ".join(f"""
SELECT '{name}' AS tool, d.lang, count(*) FILTER (WHERE l.quality = 0 AND NOT {rule}) AS tp, count(*) FILTER (WHERE l.quality <> 0 AND NOT {rule}) AS fp,
  count(*) FILTER (WHERE l.quality <> 0 AND {rule}) AS tn, count(*) FILTER (WHERE l.quality = 0 AND {rule}) AS fn FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL GROUP BY d.lang""" for name, rule in _TOOLS.items()) + ") " + metric_sql().replace("SELECT lang", "SELECT tool, lang"))
def scored_tools(t: Tables) -> DataFrame:
    """Four tools, one of which kept nothing, against one stored truth that each of them leaves where it is."""
    stored = layout.bucketed(truth(t), ["doc_id"])
    d = t.documents.alias("d")
    kept_by = [d.filter(rule).select("doc_id", F.lit(name).alias("tool")) for name, rule in _TOOLS.items()]
    return rounded(c.scored_runs(stored, reduce(DataFrame.unionByName, kept_by), ["doc_id"], ["lang"], "tool", list(_TOOLS), HOST))


@query("""
WITH s AS (SELECT o_orderpriority || o_orderstatus AS sample, count(*) AS reads, count(*) FILTER (WHERE o_totalprice > 150000) AS kept, sum(o_custkey)::BIGINT AS mark FROM orders GROUP BY ALL)
SELECT sample, CASE WHEN kept * 2 < reads THEN 'Failed' ELSE 'Completed' END AS status, CASE WHEN starts_with(sample, '2') THEN 6 ELSE 3 END AS runs,
  round((reads - kept)::DOUBLE / reads, 6) AS removed, reads::DOUBLE + CASE WHEN starts_with(sample, '2') THEN 1 ELSE 0 END AS reads FROM s""")
def stages_resumed(t: Tables) -> DataFrame:
    """Samples brought through three stages: the first run is cut off in the second stage, the second run does what is left, a third
    nothing, and a fourth all stages of samples whose input has changed."""
    g = t.orders.groupBy(F.concat("o_orderpriority", "o_orderstatus").alias("sample"))
    facts = g.agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("o_totalprice") > 150_000).alias("kept"), F.sum("o_custkey").alias("mark"))
    state = stages.State(t.spark, scratch(t.spark), "sample string")
    plan = facts.select("sample", route.fingerprint("sample", "reads", "mark").alias("fingerprint"))

    def step(metric: str, value, ok=F.lit(True)):
        return lambda left: left.join(facts, "sample").select("sample", ok.alias("ok"), F.create_map(F.lit(metric), value.cast("double")).alias("metrics"))

    def cut_off(left: DataFrame) -> DataFrame:
        raise InterruptedError

    removed = (F.col("reads") - F.col("kept")) / F.col("reads")
    steps = [("FastpComplete", step("reads", F.col("reads"))), ("DepletionComplete", step("removed", removed)), ("Completed", step("kept", F.col("kept"), F.col("kept") * 2 >= F.col("reads")))]
    with suppress(InterruptedError):
        stages.run(state, plan, [steps[0], ("DepletionComplete", cut_off)])
    stages.run(state, plan, steps)
    before = state.version()
    stages.run(state, plan, steps)
    if state.version() != before:
        raise AssertionError("a run with nothing to do wrote a version")
    changed = plan.withColumn("fingerprint", F.when(F.col("sample").startswith("2"), F.col("fingerprint") + 1).otherwise(F.col("fingerprint")))
    again = [("FastpComplete", step("reads", F.col("reads") + 1)), *steps[1:]]
    out = stages.run(state, changed, again)
    return out.select("sample", "status", "runs", F.round(F.col("metrics")["removed"], 6).alias("removed"), F.col("metrics")["reads"].alias("reads"))
