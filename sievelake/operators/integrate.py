"""Sources of different shapes in one table: tagged unions, spines, lookups and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tagged(sources: dict[str, DataFrame | None], tag: str = "source") -> DataFrame:
    """All rows by column name with the name of their source; columns that a source lacks are NULL, sources that
    are missing are left out."""
    frames = [df.withColumn(tag, F.lit(name)) for name, df in sources.items() if df is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_default(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The column filled up, or made."""
    return df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)


def key_union(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """The distinct keys of all."""
    return reduce(lambda a, b: a.union(b), [df.select(*keys) for df in frames]).distinct()


def spine(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row for each key that any source has; the others' columns, named ``source_column``, are NULL there. Each
    source has one row a key."""
    out = key_union(list(frames.values()), keys)
    for name, df in frames.items():
        out = out.join(df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in keys]), keys, "left")
    return out


def first_match(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the first by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default: Column | None = None) -> DataFrame:
    """``value`` from a dimension; Spark broadcasts the dimension if its size is known to be small."""
    out = df.join(dim.select(key, F.col(value).alias("__v")), key, "left")
    return out.withColumn(value, F.col("__v") if default is None else F.coalesce("__v", default)).drop("__v")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` in place of the rows of ``old`` with its keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def outstanding(axes: list[DataFrame], done: DataFrame, keys: list[str]) -> DataFrame:
    """The grid of all combinations of small axes without those done."""
    return reduce(lambda a, b: a.crossJoin(b), axes).select(*keys).join(done.select(*keys).distinct(), keys, "left_anti")


def audit(df: DataFrame, required: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is there, and those left out."""
    k = required.select(*keys).distinct()
    return df.join(k, keys, "left_semi"), df.join(k, keys, "left_anti")
