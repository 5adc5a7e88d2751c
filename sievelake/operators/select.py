"""Choosing one file or row of several, orders and chunks."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest(df: DataFrame, by: list[str], size: str, name: str) -> DataFrame:
    """The row of greatest size; of equals the first by name."""
    cols = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*cols), F.struct((-F.col(size)).alias("s"), F.col(name).alias("n"))).alias("r")).select(*by, "r.*")


def top(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; a limit of n works before the shuffle already."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


#: Parts of paths that mark files in between, and of names that mark cleaned output.
SKIPPED = (".checkpoints", ".work", "work/", "trimmed_", "auto_survey_", "recheck_", "bowtie2.", "kraken2.", "minimap2.", "classified.", "unclassified.", "contam")
CLEANED = ("clean", "rmhost", "rm_host")


def has_any(c: Column, parts: tuple[str, ...]) -> Column:
    """Whether a text, in lower case, holds any of ``parts``; false for NULL."""
    return F.coalesce(F.exists(F.array(*map(F.lit, parts)), lambda x: F.lower(c).contains(x)), F.lit(False))


def outputs(df: DataFrame, path: str, name: str) -> DataFrame:
    """Files that may be a tool's output: ``path`` (below the run's folder) has nothing that marks files in between, and the
    name something that marks cleaned ones."""
    return df.filter(~has_any(F.col(path), SKIPPED) & has_any(F.col(name), CLEANED))


def clean_first(path: str, name: str | None = None, mates: bool = True) -> list[Column]:
    """Names with ``clean`` first in any case, then (``mates``) first mates, then shorter paths, then by path."""
    p, n = F.col(path), F.col(name or path)
    return [(~F.lower(n).contains("clean")).cast("int"), *([(~n.rlike(r"_(R)?1[._]")).cast("int")] if mates else []), F.length(p), p]


#: Parts of names of files in between.
BETWEEN = ("contam", "trimmed", "repeats")


def score_class(name: str, best: tuple[str, ...] = ("clean",), bad: tuple[str, ...] = BETWEEN) -> Column:
    """0 if the name, in lower case, has any of ``best``, else 2 if any of ``bad``, else 1."""
    return F.when(has_any(F.col(name), best), 0).when(has_any(F.col(name), bad), 2).otherwise(1)


def by_pattern(df: DataFrame, by: list[str], name: str, patterns: list[str]) -> DataFrame:
    """All rows that match the first pattern which any row of their group matches."""
    rank = F
    for k, p in enumerate(patterns):
        rank = rank.when(F.col(name).rlike(p), F.lit(k))
    ranked = df.withColumn("__p", rank).filter("__p IS NOT NULL")
    first = ranked.groupBy(*by).agg(F.min("__p").alias("__first"))
    return ranked.join(first, by).filter("__p = __first").drop("__p", "__first")


def ordered(df: DataFrame, column: str, order: list[str], *more: Column) -> DataFrame:
    """Rows by a fixed order of values; others last."""
    at = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(column)), F.lit(0))
    return df.orderBy(F.when(at == 0, F.lit(len(order) + 1)).otherwise(at), *more)


def chunked(df: DataFrame, order: str, size: int = 15) -> DataFrame:
    """Lists of ``size`` lines of a manifest, the last one shorter. Rows are dealt by ranges of ``order`` (without nulls or
    repeats), counted by range, and numbered within theirs, so that no task sorts the table. A row a range reaches the
    driver, and they are as many as shuffle partitions."""
    ranged = df.select(order).repartitionByRange(order).groupBy(F.spark_partition_id()).agg(F.min(order).alias("low"), F.count(F.lit(1)).alias("n"))
    ranges = sorted((r.low, r.n) for r in ranged.collect())
    if not ranges:
        return df.withColumn("chunk", F.lit(None).cast("bigint"))
    before = [0, *accumulate(n for _, n in ranges)]
    of = F.size(F.filter(F.array(*[F.lit(low) for low, _ in ranges]), lambda x: x <= F.col(order)))
    at = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in before]), F.col("__range")) + F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    return df.withColumn("__range", of).withColumn("chunk", F.floor(at / size).cast("bigint")).select(*df.columns, "chunk")
