"""Connected components of a table of links, without collecting links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, staged

LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Links that a task joins at once.
FOREST = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars around the smallest id of what they connect: a link a node at most."""
    over: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := over.get(x, x)) != x:
            over[x] = over.get(y, y)
            x = y
        return x

    def stars() -> Iterator[pa.RecordBatch]:
        found = [(root(x), x) for x in over]
        found = [(a, b) for a, b in found if a != b]
        yield from arrow_rows({"a": [a for a, _ in found], "b": [b for _, b in found]}, LINKS)
        over.clear()

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            over.setdefault(a, a)
            over.setdefault(b, b)
            if x != y:
                over.setdefault(x, x)
                over.setdefault(y, y)
                over[max(x, y)] = min(x, y)
        if len(over) > FOREST:
            yield from stars()
    yield from stars()


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id that it is connected with) for each id in ``links`` (a, b: long).

    Each round hooks every node to the smallest of its neighbours and itself, follows the hooks to their ends,
    and goes on with the links between the trees that this leaves. The smallest neighbours are sums by partition
    first, and the joins are plain ones that Spark may split, so a node with most of the links is no task's own."""
    left = staged(links.filter("a <> b").select("a", "b").distinct().mapInArrow(_forest, "a long, b long").distinct())
    nodes = left.select(F.col("a").alias("id")).union(left.select(F.col("b").alias("id"))).distinct().withColumn("component", F.col("id"))
    first = True
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = staged(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("x"), F.least("a", "b").alias("to")))
        while True:
            ends = hook.select(F.col("x").alias("y"), F.col("to").alias("end"))
            after = staged(hook.join(ends, F.col("to") == F.col("y")).select("x", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")))
            hook = after.select("x", "to")
            if after.filter("moved").isEmpty():
                break
        if first:
            nodes, first = hook.select(F.col("x").alias("id"), F.col("to").alias("component")), False
        else:
            nodes = nodes.join(hook, F.col("component") == F.col("x"), "left").select("id", F.coalesce("to", "component").alias("component"))
        nodes = staged(nodes)
        a, b = hook.select(F.col("x").alias("a"), F.col("to").alias("ta")), hook.select(F.col("x").alias("b"), F.col("to").alias("tb"))
        left = staged(left.join(a, "a").join(b, "b").filter("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct())
    return nodes
