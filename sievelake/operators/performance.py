"""Group statistics, speedups, pivots, composites, rank sums and fits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.scalars import ratio
from .scan import scanned


def std(c: str, kind: str = "sample") -> Column:
    """``sample`` (NULL for one row), ``sample0`` (0 for one row) or ``population``."""
    if kind == "population":
        return F.stddev_pop(c)
    return F.stddev_samp(c) if kind == "sample" else F.when(F.count(c) > 0, F.coalesce(F.stddev_samp(c), F.lit(0.0)))


def stats(df: DataFrame, by: list[str], values: list[str], what: tuple[str, ...] = ("mean", "std"), kind: str = "sample", digits: int | None = None) -> DataFrame:
    """``value_what`` for each group; ``what`` of mean, std, min, max and n (rows of the group, with a value or
    not). ``digits`` rounds half to even."""
    make = {"mean": F.avg, "std": lambda c: std(c, kind), "min": F.min, "max": F.max, "n": lambda c: F.count(F.lit(1))}
    shape = (lambda x: x) if digits is None else (lambda x: F.bround(x, digits))
    aggs = [(make[w](v) if w == "n" else shape(make[w](v))).alias(f"{v}_{w}") for v in values for w in what]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def hierarchy(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Means by ``inner`` alone and by (``outer``, ``inner``), in one pass; ``outer`` is NULL on the upper level."""
    return df.groupingSets([[inner], [outer, inner]], outer, inner).agg(F.avg(value).alias("mean"), std(value).alias("std"), F.count(F.lit(1)).alias("n"), F.grouping(outer).cast("int").alias("upper"))


def speedup(df: DataFrame, by: list[str], tool: str, base: str, value: str) -> DataFrame:
    """The base tool's mean over each tool's, within each group; one aggregation and a window over its result."""
    means = df.groupBy(*by, tool).agg(F.avg(value).alias("mean"))
    of = F.max(F.when(F.col(tool) == base, F.col("mean"))).over(Window.partitionBy(*by))
    return means.withColumn("base_mean", of).withColumn("speedup", ratio(F.col("base_mean"), F.col("mean")))


def overall_speedup(df: DataFrame, tool: str, base: str, value: str) -> DataFrame:
    """Ratios of grand means."""
    means = df.groupBy(tool).agg(F.avg(value).alias("mean"))
    only = means.filter(F.col(tool) == base).select(F.col("mean").alias("base_mean"))
    return means.crossJoin(F.broadcast(only)).withColumn("speedup", ratio(F.col("base_mean"), F.col("mean")))


def ratios(df: DataFrame, by: list[str], tool: str, base: str, value: str, prefix: str) -> DataFrame:
    """Means of each tool against the base's in both directions, each under its name: ``prefix_base_over_tool`` and
    ``prefix_tool_over_base``."""
    means = df.groupBy(*by, tool).agg(F.avg(value).alias("mean"))
    of = F.max(F.when(F.col(tool) == base, F.col("mean"))).over(Window.partitionBy(*by))
    both = means.withColumn("base_mean", of)
    return both.withColumns({f"{prefix}_base_over_tool": ratio(F.col("base_mean"), F.col("mean")), f"{prefix}_tool_over_base": ratio(F.col("mean"), F.col("base_mean"))})


def slowdown(old: DataFrame, new: DataFrame, keys: list[str], runtime: str) -> DataFrame:
    """Mean minutes of two versions by key, and the new one's over the old one's; keys that either lacks are left out."""
    means = lambda df, name: df.groupBy(*keys).agg((F.avg(runtime) / 60).alias(name))
    return means(old, "old_min").join(means(new, "new_min"), keys).withColumn("slowdown", ratio(F.col("new_min"), F.col("old_min")))


def first_run(df: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """The value of each group's first row; ``order`` should leave no ties."""
    return df.groupBy(*by).agg(F.min_by(value, F.struct(*order)).alias(value))


def warm(value: str, rep: str) -> Column:
    """The mean without first runs; with them if there are no others."""
    return F.coalesce(F.avg(F.when(F.col(rep) > 1, F.col(value))), F.avg(value))


def pivoted(df: DataFrame, by: list[str], on: str, values: list, value: str, missing: Column | None = None) -> DataFrame:
    """A column for each of ``values``. Two rows of one place raise, as no one of them could be chosen."""
    one = F.when(F.count(value) <= 1, F.first(value, ignorenulls=True)).otherwise(F.raise_error(F.lit("more than one value of a place")))
    out = df.groupBy(*by).pivot(on, values).agg(one)
    return out if missing is None else out.select(*by, *[F.coalesce(F.col(f"`{v}`").cast("string"), missing).alias(str(v)) for v in values])


def composite(df: DataFrame, tool: str, seconds: str, memory: str, f1: str) -> DataFrame:
    """Each of speed, memory and f1 scaled to 0..1 over the tools (all equal: 1), and their mean. ``df`` has a row
    a tool, so the window without partitions is over a small table."""
    raw = df.select(tool, ratio(F.lit(1.0), F.col(seconds)).alias("speed"), ratio(F.lit(1.0), F.col(memory)).alias("thrift"), F.col(f1).alias("score"))
    all_ = Window.partitionBy()
    scaled = raw
    for c in ("speed", "thrift", "score"):
        low, high = F.min(c).over(all_), F.max(c).over(all_)
        scaled = scaled.withColumn(f"{c}_scaled", F.when(high == low, F.lit(1.0)).otherwise((F.col(c) - low) / (high - low)))
    return scaled.withColumn("composite", (F.col("speed_scaled") + F.col("thrift_scaled") + F.col("score_scaled")) / 3)


def rank_sum(df: DataFrame, by: list[str], sample: str, x: str, y: str, value: str) -> DataFrame:
    """Wilcoxon's rank sum of sample ``x`` against ``y`` by normal approximation: n1, n2, rank_sum, z. Ties share
    their mean rank; groups with fewer than two values of either are left out.

    Values are counted first, so that ranks come from running sums over different values; a group's may lie in many tasks."""
    vals = df.filter(F.col(sample).isin(x, y) & F.col(value).isNotNull())
    each = vals.groupBy(*by, value).agg(F.count_if(F.col(sample) == x).alias("nx"), F.count(F.lit(1)).alias("n"))
    ranked = scanned(each, by, [F.col(value)], F.col("n")).withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    out = ranked.groupBy(*by).agg(F.sum("nx").alias("n1"), F.sum(F.col("n") - F.col("nx")).alias("n2"), F.sum(F.col("rank") * F.col("nx")).alias("rank_sum")).filter("n1 >= 2 AND n2 >= 2")
    n1, n2 = F.col("n1"), F.col("n2")
    return out.withColumn("z", (F.col("rank_sum") - n1 * (n1 + n2 + 1) / 2.0) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0))


@F.pandas_udf(DoubleType())
def two_sided(z: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The p-value of a normal deviate; Spark has no erfc. One value a test, so few rows come here."""
    for s in z:
        yield s.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore").astype(float)


def fit(x: str, y: str) -> dict[str, Column]:
    return {"slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x), "r2": F.regr_r2(y, x)}


def quartiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """q1, median and q3 of each group, between values in proportion. Values are counted first, so that what is sorted
    is the different ones; a group's may lie in many tasks."""
    each = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = scanned(each, by, [F.col(value)], F.col("__n"), "__upto", "__all")
    out = {}
    for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        at = (F.col("__all") - 1) * F.lit(share)
        low, high = (F.min(F.when(F.col("__upto") > k, F.col(value))) for k in (F.floor(at), F.ceil(at)))
        out[name] = low + (high - low) * F.max(at - F.floor(at))
    return ranked.groupBy(*by).agg(*[c.alias(n) for n, c in out.items()])


def best(df: DataFrame, tool: str, value: str, by: list[str] | None = None) -> DataFrame:
    """The tool with the largest value; of equals the first by name."""
    return df.groupBy(*(by or [])).agg(F.min_by(F.struct(tool, value), F.struct((-F.col(value)).alias("v"), F.col(tool))).alias("b")).select(*(by or []), f"b.{tool}", f"b.{value}")
