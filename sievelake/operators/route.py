"""Survey, routing, recheck, validation and resuming."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

#: Percent of host below which reads are aligned, percent and reads above which they are classified.
ALIGN_BELOW, CLASSIFY_ABOVE, CLASSIFY_READS = 10.0, 30.0, 20_000_000
SURVEY_READS = 100_000
#: Libraries with more than such a share of all reads are large.
LARGE = 4096


def survey(reads: DataFrame, id_col: str, n: int = SURVEY_READS, seed: int = 42, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Exactly ``n`` reads (or all) of each library ``by``: those with the smallest MD5 of seed and id, ties by id; the same at
    any partitioning and in other engines. Rows that share an id are reads of their own.

    Libraries are counted, and a limit for the hash lets a little more than ``n`` reads of each through; only those are
    written, sorted and cut. Limits of libraries that are large are broadcast, ``LARGE`` rows at most, and the reads that they
    leave out are never shuffled; the others' limits are joined by library. Should a limit let fewer through, which of 10^9
    libraries one would do, all of that library's reads are looked at instead."""
    spark = reads.sparkSession
    by, hash_ = list(by), F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))
    keys = [F.col(c).alias(f"__{c}") for c in by] or [F.lit(0).alias("__all")]
    rows = reads.withColumn("__hash", hash_)
    names = [f"__{c}" for c in by] or ["__all"]
    at, of = scratch(spark), scratch(spark)
    sizes = reads.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    sizes.write.parquet(of)
    sizes = spark.read.schema(sizes.schema).parquet(of)
    share = (n + 6 * math.sqrt(n) + 20) / F.col("__size")
    # Hashes below the limit, by their first 13 digits; libraries that aren't larger have none, and null ids come last.
    limits = sizes.filter(share < 1).withColumn("__limit", F.lpad(F.lower(F.hex(F.floor(share * 16**13).cast("bigint"))), 13, "0"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.lit(True))
    large = F.col("__size") > (sizes.agg(F.sum("__size")).first()[0] or 0) // LARGE

    def below(df: DataFrame, limits: DataFrame) -> DataFrame:
        return df.join(limits, on, "left").filter(F.col("__limit").isNull() | (F.substring("__hash", 1, 13) < F.col("__limit"))).drop("__size", "__limit", *names)

    some = below(rows, F.broadcast(limits.filter(large)))
    if not limits.filter(~large).isEmpty():
        some = below(some, limits.filter(~large))
    some.write.parquet(at)
    some = spark.read.schema(some.schema).parquet(at)
    got = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("__got"))
    same = reduce(lambda a, b: a & b, [F.col(f"__{c}").eqNullSafe(F.col(f"__of_{c}")) for c in by], F.lit(True))
    short = sizes.join(got.select(*[F.col(x).alias(f"__of_{x[2:]}") for x in names], "__got"), same, "left").filter(F.coalesce("__got", F.lit(0)) < F.least("__size", F.lit(n))).select(*names)
    if not short.isEmpty():
        off = some.join(short, on, "left_anti") if by else some.limit(0)
        some = off.unionByName(rows.join(short, on, "left_semi"))
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last("__hash"), id_col)
    return some.withColumn("__place", F.row_number().over(w)).filter(F.col("__place") <= n).drop("__hash", "__place")


def host_percent(survey: DataFrame, by: list[str], mapped: str) -> DataFrame:
    out = survey.groupBy(*by).agg(F.count(F.lit(1)).alias("surveyed_reads"), F.count_if(F.col(mapped)).alias("mapped_reads"))
    return out.withColumn("estimated_host_pct", 100.0 * F.col("mapped_reads") / F.col("surveyed_reads"))


def route(host_pct: Column, reads: Column, user_pct: Column | None = None, forced: Column | None = None) -> Column:
    """``align`` or ``classify_recheck``. A percentage given by the user takes the survey's place, and a forced
    backend that of the rule. Limits themselves align."""
    pct = host_pct if user_pct is None else F.coalesce(user_pct, host_pct)
    rule = F.when(pct < ALIGN_BELOW, "align").when((pct > CLASSIFY_ABOVE) & (reads > CLASSIFY_READS), "classify_recheck").otherwise("align")
    return rule if forced is None else F.coalesce(forced, rule)


def recheck(reads: DataFrame, first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """Reads that neither pass calls host; the second pass looks only at what the first kept."""
    return reads.join(first.select(*on).distinct(), on, "left_anti").join(second.select(*on).distinct(), on, "left_anti")


def host_negative(samples: DataFrame, negative: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Samples that need removal, and those that skip it."""
    n = negative.select(*on).distinct()
    return samples.join(n, on, "left_anti"), samples.join(n, on, "left_semi")


def validated(outputs: DataFrame, size: str, residual_pct: str, least_size: int = 1, most_residual: float = 5.0) -> DataFrame:
    """``status``: ``Promoted``, or ``Failed`` for outputs too small or with too much host left; NULL fails."""
    good = (F.col(size) >= least_size) & (F.col(residual_pct) <= most_residual)
    return outputs.withColumn("status", F.when(F.coalesce(good, F.lit(False)), "Promoted").otherwise("Failed"))


def fingerprint(path: str, size: str, changed: str) -> Column:
    """Of a file's metadata; a change of any invalidates a stage."""
    return F.xxhash64(path, size, changed)


def resumable(plan: DataFrame, state: DataFrame, key: list[str], stage: str = "stage", mark: str = "fingerprint") -> DataFrame:
    """What is left to do: rows of ``plan`` whose stage isn't reached in ``state`` with the same fingerprint."""
    reached = state.select(*key, F.col(stage).alias("__s"), F.col(mark).alias("__f"))
    both = plan.join(reached, key, "left")
    return both.filter(F.col("__s").isNull() | (F.col("__s") < F.col(stage)) | (F.col("__f") != F.col(mark))).drop("__s", "__f")


def stale(checkpoints: DataFrame, outputs: DataFrame, key: list[str]) -> DataFrame:
    """Checkpoints of runs without a clean output."""
    return checkpoints.join(outputs.select(*key).distinct(), key, "left_anti")


def workers(wanted: Column, db_gb: Column, ram_gb: Column) -> Column:
    """Workers such that their copies of a database take at most 80 % of memory; one at least."""
    return F.greatest(F.lit(1), F.least(wanted, F.floor(F.try_divide(ram_gb * 0.8, db_gb))))


def totals(runs: DataFrame, status: str, ok: str = "OK") -> DataFrame:
    return runs.agg(F.count_if(F.col(status) == ok).alias("succeeded"), F.count_if(F.coalesce(F.col(status) != ok, F.lit(True))).alias("failed"))
