"""What the corpus operators share: the shared folder, staged tables, Arrow batches and hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import discard, made, scratch, shared_folder, table_name  # noqa: F401

#: Rows that go to Python at once; texts can be long, so few.
BATCH_ROWS = 512


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch holds, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def staged(df: DataFrame, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here, so a lost executor
    costs a read and not the work before it."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """As :func:`staged`, in ``n`` buckets by ``keys``: what is then grouped or joined by them needs no exchange. Each task
    writes a file for each bucket that it has rows of, so ``df`` should be dealt out by ``keys`` in as many partitions."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    name = table_name(spark, path)
    df.write.bucketBy(n, *keys).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: StructType) -> DataFrame:
    """``df.mapInArrow(run, kind)`` for columns of any names, also with dots."""
    given, places = df.columns, [f"c{k}" for k in range(len(kind))]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(x.rename_columns(given) for x in batches):
            yield b.rename_columns(places)

    out = df.toDF(*[f"c{k}" for k in range(len(given))]).mapInArrow(placed, StructType([StructField(p, f.dataType, True) for p, f in zip(places, kind, strict=True)]))
    return out.toDF(*kind.names)


def text_bytes(name: str) -> Column:
    """A text column as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for new columns that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of ``df``, by names that may hold any character."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Enough partitions that each has about ``rows_each`` rows, and the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def arrow_rows(columns: dict[str, list], schema: pa.Schema, rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``rows`` rows."""
    n = len(next(iter(columns.values())))
    for a in range(0, n, rows):
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name][a : a + rows], f.type) for f in schema], schema=schema)


#: One document of so many tells which keys are frequent: those of more than ``FREQUENT`` entries there, and a share of ``1 /
#: MOST_FREQUENT`` of all entries, so that they are ``MOST_FREQUENT`` at most.
SAMPLED, FREQUENT, MOST_FREQUENT = 64, 64, 1 << 18


def sampled(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that tell which keys are frequent, by a hash of their ids."""
    return rows.filter(F.pmod(F.xxhash64(id_col), F.lit(SAMPLED)) == 0)


def frequent(keys: DataFrame, count: Column) -> np.ndarray:
    """The frequent ones among ``key`` (numbers of 64 bits), sorted, by ``count`` over the sample. How keys are dealt may depend on
    them, results may not."""
    each = staged(keys.groupBy("key").agg(count.alias("n")))
    total = each.agg(F.sum("n")).first()[0] or 0
    return np.sort(np.array([r.key for r in each.filter(F.col("n") > max(FREQUENT, total // MOST_FREQUENT)).select("key").collect()], np.int64).view(np.uint64))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def aside(kind: int = 1, kinds: int = 1) -> int:
    """A negative number for rows that a task passes on as they are, beside the buckets of those that it deals: another one for
    each task, so that they don't meet. ``kind``: from 1 to ``kinds``, what they are."""
    task = TaskContext.get()
    return -kind - kinds * (task.partitionId() if task else 0)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of the result depends on all of ``x``."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class RollingHash:
    """Polynomial hashes modulo 2**64 of all windows of a sequence of 64-bit values, by prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        """The hash of each ``width`` consecutive values; none if there are fewer."""
        n = len(values)
        if n < width:
            return np.zeros(0, np.uint64)
        if len(self._up) < n + 1:
            size = max(n + 1, 2 * len(self._up), 1 << 12)
            self._up, self._down = powers(self.base, size), powers(self.inverse, size)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self._down[:n], out=sums[1:])
        return mixed((sums[width:] - sums[:-width]) * self._up[: n - width + 1])


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in ``[s, s + width)`` for some start ``s``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0
