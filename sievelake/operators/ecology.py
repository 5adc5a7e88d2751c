"""Diversity of abundance profiles, and lengths of contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import scanned


def diversity(df: DataFrame, by: list[str], species: str, amount: str) -> DataFrame:
    """richness (rows), shannon (base 2, zeros left out, shares renormalised), simpson (1 - sum of squared shares,
    0 if the total is 0) and chao1 (bias-corrected with doubletons, else the species seen). Chao1 needs counts;
    of fractions none is 1 or 2."""
    cells = df.groupBy(*by, species).agg(F.sum(amount).cast("double").alias("x"))
    total = F.sum("x").over(Window.partitionBy(*by))
    p = F.try_divide(F.col("x"), F.col("total"))
    out = cells.withColumn("total", total).groupBy(*by).agg(
        F.count(F.lit(1)).alias("richness"),
        F.coalesce(-F.sum(F.when(F.col("x") > 0, p * F.log2(p))), F.lit(0.0)).alias("shannon"),
        F.coalesce(1 - F.sum(p * p), F.lit(0.0)).alias("simpson"),
        F.count_if(F.col("x") > 0).alias("seen"), F.count_if(F.col("x") == 1).alias("f1"), F.count_if(F.col("x") == 2).alias("f2"),
    )
    more = F.col("f1") * (F.col("f1") - 1) / (2.0 * (F.col("f2") + 1))
    return out.withColumn("chao1", F.when(F.col("f2") > 0, F.col("seen") + more).otherwise(F.col("seen").cast("double"))).drop("seen", "f1", "f2")


def bray_curtis(df: DataFrame, sample: str, species: str, amount: str) -> DataFrame:
    """Dissimilarity of each two samples: 1 - 2 * shared / (sum of both). Samples are few; cells are summed first
    and join by species, never sample by sample."""
    cells = df.groupBy(sample, species).agg(F.sum(amount).cast("double").alias("x"))
    totals = cells.groupBy(sample).agg(F.sum("x").alias("t"))
    a = cells.select(F.col(sample).alias("a"), species, F.col("x").alias("xa"))
    b = cells.select(F.col(sample).alias("b"), species, F.col("x").alias("xb"))
    shared = a.join(b, species).filter("a < b").groupBy("a", "b").agg(F.sum(F.least("xa", "xb")).alias("shared"))
    ta, tb = totals.select(F.col(sample).alias("a"), F.col("t").alias("ta")), totals.select(F.col(sample).alias("b"), F.col("t").alias("tb"))
    pairs = ta.join(tb, F.col("a") < F.col("b")).join(shared, ["a", "b"], "left")
    return pairs.select("a", "b", (1 - 2 * F.coalesce("shared", F.lit(0.0)) / (F.col("ta") + F.col("tb"))).alias("bray_curtis"))


def lengths(df: DataFrame, by: list[str], length: str) -> DataFrame:
    """contigs, total, longest, and upper_median: the value at place n div 2 from 0 in ascending order, which some
    reports call N50. Lengths are counted first; a group's may lie in many tasks."""
    each = df.filter(F.col(length).isNotNull()).groupBy(*by, length).agg(F.count(F.lit(1)).alias("__n"))
    ranked = scanned(each, by, [F.col(length)], F.col("__n"), "upto", "all")
    return ranked.groupBy(*by).agg(
        F.sum("__n").alias("contigs"), F.sum(F.col(length) * F.col("__n")).alias("total"), F.max(length).alias("longest"),
        F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col(length))).alias("upper_median"),
    )


def n50(df: DataFrame, by: list[str], length: str) -> DataFrame:
    """The largest length such that contigs at least as long have half of all bases."""
    each = df.filter(F.col(length).isNotNull()).groupBy(*by, length).agg((F.count(F.lit(1)) * F.col(length)).alias("bases"))
    return scanned(each, by, [F.desc(length)], F.col("bases"), "upto", "all").filter("2 * upto >= all").groupBy(*by).agg(F.max(length).alias("n50"))
