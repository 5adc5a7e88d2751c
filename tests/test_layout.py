"""Bucketed truth, replacement in place, state in versions, and the sensor, with nulls, repeats and cut-off writes."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sievelake.functions.metrics import HOST, KEPT
from sievelake.operators import confusion, sensor, stages
from sievelake.sources import layout


@pytest.mark.parametrize("polarity", [HOST, KEPT])
def test_runs_are_scored_without_moving_the_truth(spark, polarity):
    rows = [(k, k % 3 == 0, "ab"[k % 2]) for k in range(300)]
    truth = layout.bucketed(spark.createDataFrame(rows, "id long, is_host boolean, d string"), ["id"], 4)
    kept = spark.createDataFrame([(k, t) for t, step in (("x", 2), ("y", 5)) for k in range(0, 400, step)] + [(0, "x"), (None, "y"), (3, "other")], "id long, tool string")
    got = confusion.scored_runs(truth, kept, ["id"], ["d"], "tool", ["x", "y", "none"], polarity)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = confusion.scored_runs(truth, kept, ["id"], ["d"], "tool", ["x", "y", "none"], polarity)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.split("\n")
    (scan,) = [k for k, line in enumerate(lines) if "Bucketed: true" in line]
    (join,) = [k for k, line in enumerate(lines) if "SortMergeJoin" in line]
    assert join < scan and not any("Exchange" in line for line in lines[join + 1 : scan])  # the truth is the left side
    for tool in ("x", "y", "none"):
        one = confusion.scored(truth, kept.filter(F.col("tool") == tool).select("id"), ["id"], ["d"], polarity)
        names = one.columns
        assert sorted(map(tuple, one.collect())) == sorted(tuple(r[n] for n in names) for r in got.filter(F.col("tool") == tool).collect())


def files_of(path):
    return {p.relative_to(path): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(path).rglob("*.parquet")}


def test_replacement_in_place(spark, tmp_path):
    at = str(tmp_path / "t")
    layout.keyed(spark.createDataFrame([(k if k else None, "old", k) for k in range(200)], "k long, v string, n int"), at, ["k"], 16)
    before = files_of(at)
    new = spark.createDataFrame([(7, "new", 0), (7, "newer", 1), (None, "none", 2), (900, "more", 3)], "k long, v string, n int")
    layout.replace_in_place(new, at, ["k"], 16)
    after = files_of(at)
    same = {p for p in before if after.get(p) == before[p]}
    folders = lambda ps: {p.parts[0] for p in ps}
    assert len(folders(same)) >= 13 and not folders(same) & folders(set(after) - same)
    want = sorted([(k, "old", k) for k in range(1, 200) if k != 7] + [(7, "new", 0), (7, "newer", 1), (900, "more", 3)]) + [(None, "none", 2)]
    read = lambda: sorted(map(tuple, layout.keyed_table(spark, at).collect()), key=lambda r: (r[0] is None, r))
    assert read() == want
    layout.replace_in_place(new, at, ["k"], 16)
    layout.replace_in_place(new.limit(0), at, ["k"], 16)
    assert read() == want

    fail = F.udf(lambda k: 1 // (k - 900), "int")  # a write that breaks off leaves the table as it was
    with pytest.raises(Exception, match="ZeroDivision"):
        layout.replace_in_place(new.filter("k IS NOT NULL").withColumn("n", fail("k")), at, ["k"], 16)
    assert read() == want


@pytest.fixture
def state(spark, tmp_path):
    return stages.State(spark, str(tmp_path / "state"), "sample string")


def plan_of(spark, marks):
    return spark.createDataFrame(list(marks.items()), "sample string, fingerprint long")


def test_stages_resume(spark, state):
    calls = []

    def step(name, bad=(), broken=False):
        def do(left):
            calls.append((name, sorted(r.sample for r in left.collect())))
            if broken:
                raise InterruptedError
            return left.select("sample", (~F.col("sample").isin(list(bad))).alias("ok"), F.create_map(F.lit(name), F.lit(1.0)).alias("metrics"))

        return name, do

    plan, steps = plan_of(spark, {"a": 1, "b": 2, "c": 3}), [step("FastpComplete", ["c"]), step("DepletionComplete"), step("Completed")]
    with pytest.raises(InterruptedError):
        stages.run(state, plan, [steps[0], step("DepletionComplete", broken=True)])
    assert state.version() == 1
    out = {r.sample: r for r in stages.run(state, plan, steps).collect()}
    assert calls == [("FastpComplete", ["a", "b", "c"]), ("DepletionComplete", ["a", "b"]), ("DepletionComplete", ["a", "b"]), ("Completed", ["a", "b"])]
    assert (out["a"].status, out["a"].runs, sorted(out["a"].metrics)) == ("Completed", 3, ["Completed", "DepletionComplete", "FastpComplete"]) and out["c"].status == "Failed"
    calls.clear()
    stages.run(state, plan, steps)
    assert not calls and state.version() == 3
    out = {r.sample: r for r in stages.run(state, plan_of(spark, {"a": 1, "b": 20, "d": 4}), steps).collect()}
    assert calls == [("FastpComplete", ["b", "d"]), ("DepletionComplete", ["b", "d"]), ("Completed", ["b", "d"])]
    assert (out["b"].runs, out["a"].runs, out["d"].runs, out["c"].status) == (6, 3, 3, "Failed")
    calls.clear()  # a failed sample runs again once its input has changed
    assert {r.sample: r for r in stages.run(state, plan_of(spark, {"c": 5}), [step("FastpComplete"), *steps[1:]]).collect()}["c"].status == "Completed"


def test_a_version_is_written_once(spark, state):
    rows = lambda n: spark.createDataFrame([("a", n, 1, "x", {"m": 0.5}, 1)], state.schema)
    assert state.read().count() == 0 and state.promote(rows(1), 0) == 1
    with pytest.raises(stages.Moved):  # another writer that began from the same version
        state.promote(rows(2), 0)
    fail = F.udf(lambda s: 1 // 0, "int")
    with pytest.raises(Exception, match="ZeroDivision"):  # a write that is cut off
        state.promote(rows(3).withColumn("stage", fail("sample")), 1)
    assert state.version() == 1 and [r.stage for r in state.read().collect()] == [1]
    assert state.promote(rows(4), 1) == 2 and [r.stage for r in state.read(1).collect()] == [1]
    state.version = lambda: 1  # it looks once more, but the other one is faster
    with pytest.raises(stages.Moved):
        state.promote(rows(5), 1)
    assert sorted(p for p in os.listdir(state.path) if p[0] == "v") == ["v00000001", "v00000002"]


def test_sensor(spark):
    rng = random.Random(4)
    flip = str.maketrans("ACGT", "TGCA")
    bases = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    host = bases(40_000)
    rows = [("whole", host[a : a + 200]) for a in range(0, 40_000, 150)] + [("half", host[a : a + 120].translate(flip)[::-1].lower()) for a in range(0, 20_000, 60)] + [("other", bases(3000)), ("bare", "ACG"), ("bare", None), (None, host[:5000]), ("odd", "N" * 50 + host[:40] + "é" + host[40:80])]
    got = {r.s: r for r in sensor.sensed(spark.createDataFrame(rows, "s string, seq string").repartition(5), spark.createDataFrame([(host,)], "seq string"), "s", scale=20).collect()}

    def plain(s, k=31):
        out = set()
        for i in range(len(s) - k + 1):
            p = s[i : i + k].upper()
            if set(p) <= set("ACGT"):
                x = 0
                for c in min(p, p.translate(flip)[::-1]):
                    x = x * 4 + "ACGT".index(c)
                if (h := ((x ^ x >> 31) * 0x9E3779B97F4A7C15) % 2**64) < 2**64 // 20:
                    out.add(h)
        return out

    of_host = plain(host)
    for name in {n for n, _ in rows}:
        mine = set().union(*(plain(s or "") for n, s in rows if n == name))
        assert (got[name].sketched, got[name].shared) == (len(mine), len(mine & of_host)), name
        assert got[name].containment == pytest.approx(len(mine & of_host) / len(of_host))
    assert got["whole"].positive and got["whole"].containment == 1 and 0.4 < got["half"].containment < 0.6 and not got["other"].positive and not got["bare"].positive
    none = sensor.sensed(spark.createDataFrame(rows[:3], "s string, seq string"), spark.createDataFrame([("A",)], "seq string"), "s").first()
    assert (none.containment, none.positive) == (0.0, False)


def test_what_was_made_can_be_discarded(spark):
    from sievelake.operators import host_index
    from sievelake.session import discard, made

    before = made(spark)
    kept = layout.bucketed(spark.range(5), ["id"], 2)
    index = host_index.build(spark.createDataFrame([("ACGTTGCA" * 9,)], "seq string"))
    assert index.table(spark).count() == index.count > 0 and made(spark) == before + 2
    names = {t.name for t in spark.catalog.listTables() if t.name.startswith("sievelake_")}
    assert discard(spark, since=before + 1) == 1 and kept.count() == 5
    left = {t.name for t in spark.catalog.listTables() if t.name.startswith("sievelake_")}
    assert len(names - left) == 2 and not left - names  # the index's, written and opened
    assert discard(spark, since=before) == 1
