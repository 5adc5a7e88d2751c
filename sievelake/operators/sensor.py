"""A sensor for host in whole samples: containment of scaled sketches.

A sketch is all k-mers whose hash lies below a threshold, so that sketches of parts of a sample, merged, are the sketch of the
whole, and the share of the host's sketch that a sample has estimates the share of the host's k-mers that it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .host_index import _CODE, _sequences, joined

#: One k-mer of so many is in a sketch; a host that a sample has to this identity is found.
SCALE, K, LEAST_ANI = 200, 31, 0.95
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def hashes(data: np.ndarray, at: np.ndarray, k: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows and hashes of the k-mers (31 letters at most) of all sequences in ``data`` that belong to a sketch. A k-mer is the
    smaller number of its two strands, two bits a letter; its hash is that number, mixed with its upper half, times a constant.
    K-mers with other letters than A, C, G and T (in any case) have none."""
    n = len(data) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    codes = _CODE[data]
    other = np.concatenate([[0], np.cumsum(codes == 4)])
    left = np.repeat(at[1:], np.diff(at))[:n] - np.arange(n)
    codes &= 3
    x = np.minimum(joined(codes, k, True), joined(3 - codes, k, False))
    h = (x ^ (x >> np.uint64(31))) * _FACTOR
    found = np.flatnonzero((other[k:] == other[:-k]) & (left >= k) & (h < np.uint64((1 << 64) // scale)))
    return np.searchsorted(at, found, "right") - 1, h[found]


def _sketched(k: int, scale: int):
    """A row for each sample and hash of a batch, with how often it occurs there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("sample").dictionary_encode()
            of = ids.indices.fill_null(len(ids.dictionary)).to_numpy()
            names = pa.concat_arrays([ids.dictionary, pa.nulls(1, ids.dictionary.type)])
            for first, data, at in _sequences(b):
                row, h = hashes(data, at, k, scale)
                both, n = np.unique(np.stack([of[row + first].astype(np.uint64), h]), axis=1, return_counts=True)
                for x in range(0, both.shape[1], 1 << 18):
                    part = both[:, x : x + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(part[0].astype(np.int64))), pa.array(part[1].view(np.int64)), pa.array(n[x : x + (1 << 18)], pa.int64())], names=["sample", "hash", "n"])

    return run


def sketch(reads: DataFrame, sample: str, seq: str = "seq", k: int = K, scale: int = SCALE) -> DataFrame:
    """sample, hash and n (its occurrences) of each sample's sketch; null sequences add nothing, a null sample is one of its own.
    Batches and partitions are merged before the shuffle."""
    rows = reads.select(F.col(sample).cast("string").alias("sample"), F.col(seq).cast("string").alias("seq"))
    return rows.mapInArrow(_sketched(k, scale), "sample string, hash long, n long").groupBy("sample", "hash").agg(F.sum("n").alias("n"))


def sensed(reads: DataFrame, host: DataFrame, sample: str, seq: str = "seq", k: int = K, scale: int = SCALE, least_ani: float = LEAST_ANI) -> DataFrame:
    """For each sample ``sketched`` (different hashes), ``shared`` (those that the host has), ``containment`` (their share of the
    host's sketch), ``ani`` (its k-th root: the identity to a host that is there), ``depth`` (mean occurrences of shared ones) and
    ``positive``: whether ani is ``least_ani`` at least. A sample with reads but no hashes has zeros; a host without hashes is in
    none. Samples are compared with the host by a join of hashes; neither side is gathered."""
    mine, theirs = sketch(reads, sample, seq, k, scale), sketch(host.select(F.lit("host").alias("of"), seq), "of", seq, k, scale)
    size = theirs.agg(F.count(F.lit(1)).alias("host_size"))
    both = mine.join(theirs.select("hash", F.lit(1).alias("known")), "hash", "left")
    found = both.groupBy("sample").agg(F.count(F.lit(1)).alias("sketched"), F.count("known").alias("shared"), F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).alias("times"))
    all_ = reads.select(F.col(sample).cast("string").alias("sample")).distinct()
    out = all_.withColumnRenamed("sample", "__s").join(found, F.col("__s").eqNullSafe(F.col("sample")), "left").crossJoin(F.broadcast(size))  # one row
    n = lambda c: F.coalesce(c, F.lit(0))
    share = F.coalesce(F.try_divide(n("shared").cast("double"), F.col("host_size")), F.lit(0.0))
    ani = F.pow(share, 1.0 / k)
    return out.select(F.col("__s").alias(sample), n("sketched").alias("sketched"), n("shared").alias("shared"), share.alias("containment"), ani.alias("ani"), F.coalesce(F.try_divide(F.col("times").cast("double"), F.col("shared")), F.lit(0.0)).alias("depth"), (ani >= least_ani).alias("positive"))
