"""Running sums and surveys over groups of any size."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sievelake.operators import ecology, performance, route
from sievelake.operators.scan import scanned


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_scanned(spark, partitions):
    """One group in most ranges, small ones, a null one; what is summed may be null or negative."""
    rng = random.Random(partitions)
    rows = [(g, h, k, None if k % 11 == 3 else rng.randint(-5, 20)) for g, h, n in (("a", 1, 900), ("b", 1, 3), ("b", 2, 1), (None, 1, 70), ("c", None, 5)) for k in range(n)]
    rng.shuffle(rows)
    got = {(r.g, r.h, r.k): (r.upto, r.whole) for r in scanned(spark.createDataFrame(rows, "g string, h int, k int, v long"), ["g", "h"], [F.col("k")], F.col("v"), partitions=partitions).collect()}
    want = {}
    for g, h in {r[:2] for r in rows}:
        total, mine = 0, sorted((k, v) for a, b, k, v in rows if (a, b) == (g, h))
        for k, v in mine:
            total += v or 0
            want[g, h, k] = total, sum(v or 0 for _, v in mine)
    assert got == want


def test_no_window_by_the_group_alone(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("s"))
    for made in (performance.quartiles(df, ["g"], "v"), performance.rank_sum(df, ["g"], "s", "x", "y", "v"), ecology.lengths(df, ["g"], "v"), ecology.n50(df, ["g"], "v")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window [") >= 1 and all("__range" in line for line in plan.split("\n") if "Window [" in line)


def drawn(rows, n, seed=42):
    out = set()
    for g in {g for g, _ in rows}:
        order = sorted((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i) for h, i in rows if h == g)
        out |= {(g, i) for _, i in order[:n]}
    return out


@pytest.mark.parametrize("n", [1, 40, 5000])
def test_survey_by_library(spark, n):
    rows = [(g, 1000 * k + j) for k, (g, size) in enumerate((("big", 3000), ("small", 30), (None, 400), ("one", 1))) for j in range(size)]
    df = spark.createDataFrame(rows, "library string, id long").repartition(7)
    got = [tuple(r) for r in route.survey(df, "id", n, by=["library"]).collect()]
    assert len(got) == len(set(got)) and set(got) == drawn(rows, n)
    alone = {r.id for r in route.survey(df.select("id"), "id", n).collect()}
    assert alone == {i for _, i in drawn([(0, i) for _, i in rows], n)}


def test_survey_moves_no_large_library(spark, monkeypatch):
    """What is written to be drawn from comes without a shuffle of the reads, but for small libraries beside very large ones."""
    from pyspark.sql.readwriter import DataFrameWriter

    rows = [(g, 1000 * k + j) for k, (g, size) in enumerate((("big", 900), (None, 800), ("mid", 90), ("small", 3))) for j in range(size)]
    df = spark.createDataFrame(rows, "library string, id long").repartition(5)
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or write(self, path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for large, moved in ((4096, 0), (10, 1)):
            monkeypatch.setattr(route, "LARGE", large, raising=False)
            plans.clear()
            assert {tuple(r) for r in route.survey(df, "id", 5, by=["library"]).collect()} == drawn(rows, 5)
            assert plans[-1].count("SortMergeJoin") == moved
        assert {r.id for r in route.survey(df.select("id"), "id", 5).collect()} == {i for _, i in drawn([(0, i) for _, i in rows], 5)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_survey_when_a_limit_lets_too_few_through(spark, monkeypatch):
    rows = [("a", k) for k in range(500)] + [("b", k) for k in range(20)] + [("c", k) for k in range(300)]
    df = spark.createDataFrame(rows, "library string, id long")
    monkeypatch.setattr(route.math, "sqrt", lambda n: -n / 6 - 3)  # the limit becomes nearly nothing
    assert {tuple(r) for r in route.survey(df, "id", 40, by=["library"]).collect()} == drawn(rows, 40)
    assert {r.id for r in route.survey(df.filter("library = 'a'").select("id"), "id", 40).collect()} == {i for _, i in drawn([(0, k) for k in range(500)], 40)}


def test_survey_edges(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None)], "library string, id long")
    assert route.survey(df, "id", 3, by=["library"]).count() == 3 and route.survey(df, "id", 2, by=["library"]).filter("id IS NULL").count() == 0
    assert route.survey(df.limit(0), "id", 3, by=["library"]).count() == 0 == route.survey(df.limit(0), "id", 3).count()
    plan = route.survey(df, "id", 2, by=["library"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan
