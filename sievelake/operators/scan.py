"""Running sums in groups of any size: a group may lie in many partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch


def scanned(df: DataFrame, by: list[str], order: list[Column], amount: Column, upto: str = "upto", whole: str = "whole", partitions: int | None = None) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows of the same group up to each one, and over all of the group.

    Rows are dealt out in ranges of group and order, and written once, as ranges must not change. Sums run within ranges;
    only groups that several ranges share need more: what their earlier ranges hold, two rows a range at most, is
    broadcast. ``order`` should leave no ties within a group. Groups may be null; a null amount is 0."""
    spark, at = df.sparkSession, scratch(df.sparkSession)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("__amount", F.coalesce(amount, F.lit(0)))
    ranged = rows.repartitionByRange(n, *[F.col(c) for c in by], *order).withColumn("__range", F.spark_partition_id())
    ranged.write.parquet(at)
    rows = spark.read.schema(ranged.schema).parquet(at)
    here = Window.partitionBy("__range", *by)
    local = rows.withColumns({upto: F.sum("__amount").over(here.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), whole: F.sum("__amount").over(here)})
    sums = rows.groupBy("__range", *by).agg(F.sum("__amount").alias("s"))
    shared = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("__range").alias("r"), "s"))).alias("p")).filter(F.size("p") > 1)
    add = lambda x: F.aggregate(x, F.col("p")[0]["s"] * 0, lambda a, b: a + b["s"])
    more = shared.select(*[F.col(c).alias(f"__{c}") for c in by], add(F.col("p")).alias("__whole"), F.explode(F.transform("p", lambda x, i: F.struct(x["r"].alias("r"), add(F.slice("p", F.lit(1), i)).alias("before")))).alias("p"))
    more = more.select(*[f"__{c}" for c in by], "__whole", F.col("p.r").alias("__r"), F.col("p.before").alias("__before"))
    on = F.col("__range") == F.col("__r")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = local.join(F.broadcast(more), on, "left")
    return out.withColumns({upto: F.col(upto) + F.coalesce("__before", F.col(upto) * 0), whole: F.coalesce("__whole", whole)}).drop("__amount", "__range", "__whole", "__r", "__before", *[f"__{c}" for c in by])


def numbered(df: DataFrame, order: list[Column], place: str = "place", by: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with each row's place from 1 in the order of all rows (or of its group's), which no one task sorts; ``order`` leaves
    no ties."""
    return scanned(df, by or [], order, F.lit(1).cast("bigint"), place, "__of", partitions).drop("__of")
