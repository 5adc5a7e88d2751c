"""A stored index of a host's minimizers, and reads classified by it.

The index is a folder: the different minimizers as a table bucketed by value, the words of a Bloom filter, and last what
both were made with. It is built once. Reads are cut into hit groups (runs of k-mers that share a minimizer) by numpy
over whole batches; the filter drops most that the host doesn't have before anything is shuffled, and only the rest is
dealt out to the table's buckets, which aren't moved. The filter drops nothing that the host has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, table_name
from .trimming import TOGETHER, flat

#: Bits of the filter for each minimizer, and at most (as a power of two): what a worker holds. Places that a value sets.
BITS_EACH, MOST_BITS, PLACES = 10, 30, 4
#: One read of so many tells which minimizers are frequent; those of more than such a share are looked up in a broadcast
#: table of as many rows at most, all others by shuffle.
SAMPLED, HOT = 256, 4096
#: Letters of reads that are looked at together when they are counted: few enough that a processor's cache holds what is made
#: of them.
CACHED = 1 << 18

_CODE = np.full(256, 4, np.uint8)
for _k, _letters in enumerate(("Aa", "Cc", "Gg", "Tt")):
    _CODE[[ord(x) for x in _letters]] = _k


def joined(codes: np.ndarray, length: int, first_high: bool) -> np.ndarray:
    """Each ``length`` codes of two bits in a row as one number, the first one highest or lowest: numbers of 1, 2, 4, ... codes
    are made of each other, and those that add up to ``length`` are put together."""
    power, size, out, done = codes.astype(np.uint64), 1, None, 0
    n = max(0, len(codes) - length + 1)
    while True:
        if length & size:
            part = power[done : done + n]
            if out is None:
                out = part
            elif first_high:
                out = out << np.uint64(2 * size) | part
            else:
                out = part << np.uint64(2 * done) | out
            done += size
        if done == length:
            return out
        a, b = power[: len(power) - size], power[size:]
        power = a << np.uint64(2 * size) | b if first_high else b << np.uint64(2 * size) | a
        size *= 2


def groups(data: np.ndarray, at: np.ndarray, k: int = 35, length: int = 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hit groups of all sequences that lie in ``data`` one after another, in order: the sequence's row, the minimizer,
    and how many k-mers in a row share it. A k-mer's minimizer is the smallest of its parts of ``length`` letters (31 at
    most), each as a number in the smaller of its two strands' forms. A k-mer with another letter than A, C, G and T (in
    any case) has none, and ends a group."""
    n = len(data) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = _CODE[data]
    other = np.concatenate([[0], np.cumsum(codes == 4)])
    left = np.repeat(at[1:], np.diff(at))[:n] - np.arange(n)
    valid = (other[k:] == other[:-k]) & (left >= k)
    codes &= 3
    strands = np.minimum(joined(codes, length, True), joined(3 - codes, length, False))
    best = strands[:n].copy()
    for j in range(1, k - length + 1):
        np.minimum(best, strands[j : j + n], out=best)
    before = np.concatenate([[False], valid[:-1]])
    same = np.concatenate([[False], best[1:] == best[:-1]])
    starts = np.flatnonzero(valid & ~(before & same))
    upto = np.concatenate([[0], np.cumsum(valid)])
    sizes = np.diff(upto[starts], append=upto[-1])
    return np.searchsorted(at, starts, "right") - 1, best[starts], sizes


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(32))
    return x * np.uint64(0x94D049BB133111EB)


def places(values: np.ndarray, bits: int) -> np.ndarray:
    """The places of a filter of 2**bits bits that each value sets."""
    a, b = _mixed(values), _mixed(~values) | np.uint64(1)
    return np.stack([(a + np.uint64(j) * b) >> np.uint64(64 - bits) for j in range(PLACES)])


def held(words: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """Whether the filter may have each value."""
    out = np.ones(len(values), bool)
    for p in places(values, bits):
        out &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _sequences(b: pa.RecordBatch, together: int = TOGETHER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The first row, the bytes and the places of parts of a batch with at most ``together`` letters, or one row."""
    data, at = flat(b.column("seq"))
    a = 0
    while a < b.num_rows:
        e = max(a + 1, int(np.searchsorted(at, at[a] + together, "right")) - 1)
        yield a, data[at[a] : at[e]], at[a : e + 1] - at[a]
        a = e


def _distinct(k: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data, at in _sequences(b):
                found = np.unique(groups(data, at, k, length)[1])
                for x in range(0, len(found), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(found[x : x + (1 << 18)].view(np.int64))], names=["minimizer"])

    return run


def _filtered(bits: int):
    """A partition's filter, as its words that aren't zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << (bits - 6), np.uint64)
        for b in batches:
            for p in places(b.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        some = np.flatnonzero(words)
        for x in range(0, len(some), 1 << 18):
            at = some[x : x + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(words[at].view(np.int64))], names=["word", "bits"])

    return run


@dataclass(frozen=True)
class HostIndex:
    """Where an index lies, and what it was made with."""

    path: str
    k: int
    length: int
    buckets: int
    count: int
    bits: int

    def table(self, spark: SparkSession) -> DataFrame:
        """The minimizers, in their buckets."""
        name = table_name(spark, f"{self.path}/minimizers")
        spark.sql(f"CREATE TABLE {name} (minimizer BIGINT) USING parquet CLUSTERED BY (minimizer) INTO {self.buckets} BUCKETS LOCATION '{self.path}/minimizers'")
        return spark.table(name)

    def words(self, spark: SparkSession) -> np.ndarray:
        """The filter's words; 2**(MOST_BITS - 3) bytes at most."""
        rows = spark.read.parquet(f"{self.path}/bloom").toArrow()
        out = np.zeros(1 << (self.bits - 6), np.uint64)
        out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        return out


def build(host: DataFrame, seq: str = "seq", path: str | None = None, k: int = 35, length: int = 31, buckets: int | None = None) -> HostIndex:
    """Index the sequences of ``host`` in a new folder (in the shared one by default). Null and short sequences have no
    minimizers. Beyond 2**MOST_BITS / BITS_EACH minimizers the filter drops less; results stay the same."""
    spark = host.sparkSession
    path, buckets = path or scratch(spark), buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = host.select(F.col(seq).cast("string").alias("seq")).mapInArrow(_distinct(k, length), "minimizer long").distinct()
    name = table_name(spark, f"{path}/minimizers")
    rows.repartition(buckets, "minimizer").write.bucketBy(buckets, "minimizer").sortBy("minimizer").format("parquet").option("path", f"{path}/minimizers").saveAsTable(name)
    made = spark.table(name)
    count = made.count()
    bits = min(MOST_BITS, max(10, math.ceil(math.log2(max(1, count) * BITS_EACH))))
    made.mapInArrow(_filtered(bits), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).write.parquet(f"{path}/bloom")
    out = HostIndex(path, k, length, buckets, count, bits)
    spark.createDataFrame([(k, length, buckets, count, bits)], "k int, length int, buckets int, count long, bits int").coalesce(1).write.json(f"{path}/about")
    return out


def reopened(spark: SparkSession, path: str) -> HostIndex:
    """An index that was built before, in this application or another."""
    about = spark.read.schema("k int, length int, buckets int, count long, bits int").json(f"{path}/about").first()
    return HostIndex(path, *about)


def _listed(index: HostIndex, words, totals: bool, hot=None):
    """id, minimizer and k-mers of the hit groups that the filter may have, but for those of the minimizers ``hot`` (sorted, with
    whether the host has each): these are counted here, and a row for the read has their ``hits`` and k-mers. With ``totals``
    each read with k-mers has such a row, with their number as ``total``. Its minimizer is none of the read's, but deals it
    out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, often, known = words.value, *(hot.value if hot else (np.zeros(0, np.uint64), np.zeros(0, bool)))
        names, done = ["id", "minimizer", "n", "hits", "total"], 0
        for b in batches:
            ids = b.column("id")
            for first, data, at in _sequences(b, CACHED):
                row, minimizer, n = groups(data, at, index.k, index.length)
                size = len(at) - 1
                all_ = np.bincount(row, n, size).astype(np.int64) if totals else np.zeros(size, np.int64)
                keep = held(filter_, minimizer, index.bits)
                row, minimizer, n = row[keep], minimizer[keep], n[keep]
                met = own = np.zeros(len(row), bool)
                if len(often):
                    place = np.minimum(np.searchsorted(often, minimizer), len(often) - 1)
                    own = often[place] == minimizer
                    met = own & known[place]
                hits, kmers = np.bincount(row[met], minlength=size), np.bincount(row[met], n[met], size).astype(np.int64)
                some = np.flatnonzero((all_ > 0) | (hits > 0))
                if len(some):
                    dealt = _mixed(np.arange(done, done + len(some), dtype=np.uint64)).view(np.int64)
                    done += len(some)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(some + first)), pa.array(dealt), pa.array(kmers[some]), pa.array(hits[some]), pa.array(all_[some])], names=names)
                row, minimizer, n = row[~own] + first, minimizer[~own].view(np.int64), n[~own]
                for x in range(0, len(row), 1 << 18):
                    part = slice(x, x + (1 << 18))
                    none = pa.nulls(len(row[part]), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[part])), pa.array(minimizer[part]), pa.array(n[part], pa.int64()), none, none], names=names)

    return run


def counted(reads: DataFrame, index: HostIndex, id_col: str, seq: str = "seq", totals: bool = True) -> DataFrame:
    """``hits`` (hit groups whose minimizer the index has), ``kmers`` (the k-mers in them) and ``total`` (all k-mers without
    other letters) of each id that has k-mers; without ``totals`` of those that have hits, and without the total. Rows of one
    id, such as mates, count together. Groups are made once; those of frequent minimizers are counted where they are made, as
    ``HOT`` of these are broadcast at most."""
    spark = reads.sparkSession
    rows = reads.select(F.col(id_col).alias("id"), F.col(seq).cast("string").alias("seq"))
    words, table = spark.sparkContext.broadcast(index.words(spark)), index.table(spark)
    kind = rows.drop("seq").schema
    for c in ("minimizer", "n", "hits", "total"):
        kind = kind.add(c, "long")
    few = rows.sample(1 / SAMPLED, seed=42).mapInArrow(_listed(index, words, False), kind)
    often = few.groupBy("minimizer").agg(F.count(F.lit(1)).alias("n"))
    often.write.parquet(at := scratch(spark))
    often = spark.read.schema(often.schema).parquet(at)
    n = often.agg(F.sum("n")).first()[0] or 0
    often = often.filter(F.col("n") > max(16, n // HOT)).select("minimizer")  # HOT rows at most
    known = {r.minimizer for r in table.join(F.broadcast(often), "minimizer", "left_semi").collect()}
    often = sorted(r.minimizer & (2**64 - 1) for r in often.collect())
    hot = spark.sparkContext.broadcast((np.array(often, np.uint64), np.array([x - (x >> 63 << 64) in known for x in often], bool))) if often else None
    own = rows.mapInArrow(_listed(index, words, totals, hot), kind)
    # Whether a read's own row meets a minimizer is all one.
    met = own.join(table.withColumn("known", F.lit(True)), "minimizer", "left").filter("known OR total IS NOT NULL")
    return met.groupBy("id").agg(F.sum(F.coalesce("hits", F.lit(1))).alias("hits"), F.sum("n").alias("kmers"), F.sum("total").alias("total")).withColumnRenamed("id", id_col)


def assigned(counts: DataFrame, least_groups: int | Column = 2, confidence: float | Column = 0.0) -> DataFrame:
    """Of what :func:`counted` gives the ids that belong to the host: at least ``least_groups`` groups (one always), and a share
    of ``confidence`` of the k-mers. Both may be columns, where several questions are asked of each id."""
    least, share = (c if isinstance(c, Column) else F.lit(c) for c in (least_groups, confidence))
    return counts.filter((F.col("hits") >= F.greatest(F.lit(1), least)) & (F.col("kmers") >= share * F.coalesce("total", F.lit(0)))).drop("total")


def classified(reads: DataFrame, index: HostIndex, id_col: str, seq: str = "seq", least_groups: int = 2, confidence: float = 0.0) -> DataFrame:
    """Ids of reads that the index assigns to the host, with ``hits`` (hit groups whose minimizer it has) and ``kmers`` (the
    k-mers in them): at least ``least_groups`` groups, and a share of ``confidence`` of the read's k-mers without other
    letters. Rows of one id, such as mates, count together; null sequences have none. All others are the unassigned ones.
    Several questions are asked of one :func:`counted`."""
    return assigned(counted(reads, index, id_col, seq, confidence > 0), least_groups, confidence)
