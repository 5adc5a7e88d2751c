"""Synthetic panels: dataset grids, abundance profiles, labelled reads."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import split_counts


def grid(lines: DataFrame, value: str = "value") -> DataFrame:
    """``name:reads:host:complexity:abundance:mode`` lines as rows; repeated lines count once."""
    p = F.split(value, ":")
    return lines.select(
        p[0].alias("name"), p[1].cast("bigint").alias("total_reads"), p[2].cast("double").alias("host_frac"), p[3].alias("complexity"), p[4].alias("abundance"), p[5].alias("mode")
    ).distinct()


def digits(*of: Column | int) -> Column:
    """52 bits of the MD5 of values, which other engines can make too."""
    text = F.concat_ws(":", *[F.lit(x).cast("string") if isinstance(x, int) else x.cast("string") for x in of])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def weight(kind: str, k: Column, n: Column, seed: int = 42) -> Column:
    """The unnormalised share of species ``k`` (from 1) of ``n``: even, skewed (the first has half), powerlaw
    (exponent 1.5), or lognormal(0, 2), also for other names."""
    if kind == "even":
        return F.lit(1.0)
    if kind == "skewed":
        return F.when(n == 1, 1.0).when(k == 1, 0.5).otherwise(F.lit(0.5) / (n - 1))
    if kind == "powerlaw":
        return F.pow(k.cast("double"), F.lit(-1.5))
    # Two uniform numbers of the species' number and the seed make a normal one, wherever the row lies.
    u, v = (digits(seed, part, k).cast("double") / F.lit(float(1 << 52)) for part in (0, 1))
    return F.exp(F.lit(2.0) * F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v))


def abundance(species: DataFrame, by: list[str], k: str, kind: str = "lognormal", seed: int = 42) -> DataFrame:
    """``fraction``, which sums to 1 in each group."""
    w = Window.partitionBy(*by)
    raw = species.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__w", weight(kind, F.col(k), F.col("__n"), seed))
    return raw.withColumn("fraction", F.col("__w") / F.sum("__w").over(w)).drop("__n", "__w")


def plan_reads(datasets: DataFrame, total: str = "total_reads", host: str = "host_frac", exact: bool = True) -> DataFrame:
    h, m = split_counts(F.col(total), F.col(host), exact)
    return datasets.withColumn("host_reads", h).withColumn("microbial_reads", m)


def reads(items: DataFrame, id_col: str, genomes: DataFrame, length: int = 150, seed: int = 42) -> DataFrame:
    """A labelled read for each row of ``items``, cut out of one of the ``genomes`` (g: 0, 1, ...; label; seq): read_id, label,
    seq, qual. Which genome and what place follow from seeded hashes of the read's id, wherever its row lies; of a genome that
    is shorter than a read all is taken."""
    count = genomes.count()
    where = items.select(F.col(id_col).alias("id")).withColumn("g", F.pmod(digits(seed, 0, F.col("id")), F.lit(count)))
    at = F.pmod(digits(seed, 1, F.col("id")), F.greatest(F.length("seq") - length + 1, F.lit(1)))
    return (
        where.join(genomes.withColumn("g", F.col("g").cast("bigint")), "g").withColumn("seq", F.substring(F.col("seq"), (at + 1).cast("int"), F.lit(length)))
        .select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("read_id"), "label", "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"))
    )


def round_robin(items: DataFrame, pool: DataFrame, i: str, k: str) -> DataFrame:
    """Each item with the member ``i mod count`` of the pool (``k`` from 0)."""
    n = F.lit(pool.count())
    return items.withColumn("__k", F.pmod(F.col(i), n)).join(pool.withColumnRenamed(k, "__k"), "__k").drop("__k")


def positional_labels(reads: DataFrame, index: str, microbes: Column, microbes_first: bool = True) -> DataFrame:
    """Labels by place in the file: the first ``microbes`` records (index from 0), or those after the hosts."""
    first, second = ("microbe", "host") if microbes_first else ("host", "microbe")
    return reads.withColumn("label", F.when(F.col(index) < microbes, first).otherwise(second))


def concatenated(files: list[DataFrame], index: str = "index") -> DataFrame:
    """Records of several files one after the other, numbered anew from 0; each file's are numbered from 0 without gaps."""
    out, start = [], F.lit(0).cast("bigint")
    for df in files:
        out.append(df.withColumn(index, F.col(index) + start))
        start = start + F.lit(df.count())
    return reduce(DataFrame.unionByName, out)


def zipped(df: DataFrame, a: str, b: str, index: str = "i") -> DataFrame:
    """Two arrays of each row side by side, by place; of the longer one the rest has no partner."""
    rest = [c for c in df.columns if c not in (a, b)]
    pairs = df.select(*rest, F.posexplode(F.arrays_zip(a, b)).alias(index, "pair"))
    return pairs.select(*rest, index, F.col(f"pair.{a}").alias(a), F.col(f"pair.{b}").alias(b))


def by_host_share(datasets: DataFrame, host: str = "host_frac") -> DataFrame:
    """Datasets by their percent of host."""
    return datasets.groupBy(F.concat(F.format_string("%.0f", F.col(host) * 100), F.lit("%")).alias("host")).agg(F.count(F.lit(1)).alias("datasets"))
