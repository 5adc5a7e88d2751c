import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelake.functions import scalars as s
from sievelake.functions.ids import is_host, norm_id
from sievelake.functions.metrics import HOST, KEPT, metrics, rates, swapped, with_polarity


def values(spark, items, *cols):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(items)], "k int, x string")
    return [tuple(r) for r in df.select("k", *cols).orderBy("k").drop("k").collect()]


def plain_id(x, rule):
    t = (re.match(r"[ \t\n\x0b\f\r]*([^ \t\n\x0b\f\r]*)", x)).group(1)
    if rule == "n2":
        for end in ("#0/1", "#0/2", "/1", "/2"):
            t = t.removesuffix(end)
        return t
    if rule == "n4":
        t = t.lstrip("@")
        return t[:-2] if t.endswith(("/1", "/2")) else t
    t = t[1:]
    if rule == "n1":
        t = t.split("#")[0]
        return t.rsplit("/", 1)[0] if "/" in t else t
    if rule == "n3":
        return t.split("/")[0].split("#")[0]
    return t


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab/#012 @", max_size=12), min_size=20, max_size=40))
def test_norm_id_equals_plain_python(spark, items):
    rules = ("n1", "n2", "n3", "n4", "n5")
    for x, got in zip(items, values(spark, items, *[norm_id(F.col("x"), r).alias(r) for r in rules]), strict=True):
        assert got == tuple(plain_id(x, r) for r in rules), x


def test_label_rules(spark):
    got = values(spark, ["host", "Host", "host_x", "microbe"], *[is_host(F.col("x"), r) for r in ("exact", "folded", "prefix")])
    assert got == [(True, True, True), (False, True, True), (False, False, True), (False, False, False)]


def test_seconds(spark):
    items = ["1:23:45", "1:46.30", "106.30", "unknown", "FAILED", "NA", "", " n/a ", "x:y", "1:2:3:4", None]
    assert [x for x, in values(spark, items, s.seconds(F.col("x")))] == [5025.0, 106.3, 106.3] + [None] * 8
    assert values(spark, items[2:4], s.whole_seconds(F.col("x")), s.seconds(F.col("x"), True)) == [(106, 106.3), (None, 0.0)]


def test_names(spark):
    got = values(spark, ["100M_90pct_high_lognormal_SE", "5M_1pct", "Mouse_10M"], *s.parse_dataset(F.col("x")).values(), s.host_percent(F.col("x")), s.reads(F.col("x")), s.host_fraction(F.col("x"), 0.5), s.species(F.col("x")))
    assert got[0] == (100, 90, "high", "lognormal", "SE", 90, 100_000_000, 0.9, "100m")
    assert got[1][:5] == (None,) * 5 and got[1][5:] == (1, 5_000_000, 0.5, "5m")
    assert got[2][5:] == (None, 0, 0.5, "mouse")


def test_logs(spark):
    text = '\x1b[32mINFO\x1b[0m \x1b[3mchosen_backend\x1b[0m="align" host_pct="1.5"'
    got = values(spark, [text, " align ", "other=1", "", "chosen_backend=1.5", 'chosen_backend = "a c"'], s.field(F.col("x"), "chosen_backend"))
    assert [x for x, in got] == ["align", "align", "unknown", "unknown", "unknown", "a c"]


def test_formats(spark):
    x = F.col("x").try_cast("double")
    got = values(spark, ["5.5", "125.25", "3725.5", None], s.format_seconds(x), s.format_time(x), s.format_memory(x), s.format_number(x, "%.1f"))
    assert got == [("5.5s", "5.5s", "6 MB", "5.5"), ("2:05.25", "2.1m", "125 MB", "125.3"), ("1:02:05.50", "1.0h", "3.6 GB", "3725.5"), ("N/A",) * 4]


def test_metrics_guards_and_swap(spark):
    df = spark.createDataFrame([(0, 0, 5, 0, HOST), (3, 1, 4, 2, HOST), (0, 0, 0, 0, HOST)], "tp long, fp long, tn long, fn long, polarity string")
    got = df.withColumns(metrics() | rates()).orderBy("tn").collect()
    assert (got[0].accuracy, got[0].f1) == (0.0, 0.0)
    assert got[1].precision == 0.75 and got[1].recall == 0.6 and abs(got[1].f1 - 2 / 3) < 1e-12 and got[1].host_remaining_rate == 0.4
    assert df.withColumns(metrics(empty_f1_is_one=True)).filter("tn = 5").first().f1 == 1.0
    assert [tuple(r) for r in swapped(swapped(df)).select(*df.columns).collect()] == [tuple(r) for r in df.collect()]
    assert with_polarity(df, KEPT).filter("polarity <> 'kept_positive'").isEmpty()


def test_split_counts_loses_no_read(spark):
    df = spark.createDataFrame([(60_000_000, 0.9)], "n long, h double")
    exact, cut = s.split_counts(F.col("n"), F.col("h")), s.split_counts(F.col("n"), F.col("h"), exact=False)
    assert tuple(df.select(*exact).first()) == (54_000_000, 6_000_000)
    assert tuple(df.select(*cut).first())[1] == 5_999_999
