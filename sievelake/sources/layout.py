"""Tables laid out by key: in buckets, which joins by that key don't move, and in parts by a hash of the key, which can be
replaced in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch, table_name

PARTS = 64
#: The column that names a row's part.
PART = "key_part"


def bucketed(df: DataFrame, keys: list[str], buckets: int | None = None, path: str | None = None) -> DataFrame:
    """``df`` written in buckets by ``keys``, sorted by them, in the shared folder or under ``path``: what is joined with it
    by them is dealt out to its buckets, and it stays where it is."""
    spark, path = df.sparkSession, path or scratch(df.sparkSession)
    name, n = table_name(spark, path), buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(name)
    return spark.table(name)


def part_of(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def keyed(df: DataFrame, path: str, keys: list[str], parts: int = PARTS) -> None:
    """Write a table whose rows can be replaced in place: a folder for each part of the keys' hashes."""
    df.withColumn(PART, part_of(keys, parts)).repartition(PART).write.partitionBy(PART).parquet(path)


def replace_in_place(df: DataFrame, path: str, keys: list[str], parts: int = PARTS) -> None:
    """Rows of ``df`` take the place of all rows that have their keys in the table at ``path``, which :func:`keyed` wrote with as
    many parts. Only parts with such keys are read and written anew, all others keep their files; doing it again changes
    nothing. Keys may be null. The driver gets the numbers of the parts."""
    spark = df.sparkSession
    new = df.withColumn(PART, part_of(keys, parts))
    at = scratch(spark)
    new.write.parquet(at)
    new = spark.read.schema(new.schema).parquet(at)
    touched = [r[0] for r in new.select(PART).distinct().collect()]
    if not touched:
        return
    old = spark.read.schema(new.schema).parquet(path).filter(F.col(PART).isin(touched))
    mine = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    left = old.join(mine, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_anti")
    whole = scratch(spark)  # a part can't be read while it is overwritten
    left.unionByName(new).write.parquet(whole)
    spark.read.schema(new.schema).parquet(whole).repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def keyed_table(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)
