"""Importance resampling towards a target distribution, on hashed n-grams.

A first pass writes, for each batch of documents, one packed stream of 16-bit bucket numbers (a number for each
n-gram, in order) with the documents' offsets in it. Counts are taken from the written streams alone: each stream is
sorted and run-length encoded, and runs are added up by bucket. A last pass gathers each bucket's gain along the same
streams and sums it between offsets. Texts are read once; what is written has two bytes for each n-gram.

The hash is CRC-32, which is linear: the CRC of two strings in a row follows from theirs and the second one's length.
So each word is hashed twice (alone, and after a space), and those of its n-grams are put together by table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, small_batches, staged, text_bytes

BUCKETS, LONGEST = 10_000, 3
#: Documents of fewer words are never drawn; of the others, so many hundredths are.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Scores that a partition is meant to sort.
SORTED_EACH = 500_000
#: A-Z become a-z; of the other ASCII characters only digits and a-z are in words.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_STREAMS = "ids array<long>, words array<int>, offsets array<long>, stream binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@lru_cache(maxsize=512)
def _shift(length: int) -> np.ndarray:
    """Four tables of 256: what each byte of a CRC adds to that of the string once ``length`` bytes follow."""
    zeros, none = bytes(length), crc32(bytes(length))
    base = np.array([crc32(zeros, 1 << k) ^ none for k in range(32)], np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for k in range(32):
        out[k // 8] ^= np.where(np.arange(256) >> (k % 8) & 1, base[k], 0).astype(np.uint32)
    return out


def _followed(crc: np.ndarray, by: np.ndarray, lengths: np.ndarray, kinds: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The CRCs of strings of which the CRCs of both parts are known; ``lengths`` are places in ``kinds``."""
    out = by.copy()
    for k in range(4):
        out ^= tables[lengths, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def buckets(words: list[bytes], counts: np.ndarray, longest: int = LONGEST, of: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of documents whose ``words`` stand one after another, ``counts`` of them each, and the
    number of each document's n-grams. They come document by document, in it by the last word, short ones first."""
    n, w = len(words), counts.astype(np.int64)
    sizes = sum(np.maximum(w - k, 0) for k in range(longest))
    if not n:
        return np.zeros(0, np.uint16), sizes
    now = np.fromiter(map(crc32, words), np.uint32, n)
    if longest == 1:
        return (now % np.uint32(of)).astype(np.uint16), sizes
    after = np.fromiter(map(crc32, [b" " + x for x in words]), np.uint32, n)
    kinds, at = np.unique(np.fromiter(map(len, words), np.int64, n) + 1, return_inverse=True)
    tables = np.stack([_shift(int(k)) for k in kinds])
    place = np.arange(n) - np.repeat(np.cumsum(w) - w, w)  # in its document
    out = np.zeros((n, longest), np.uint16)
    out[:, 0] = now % np.uint32(of)
    for k in range(1, longest):
        now = np.concatenate([now[:1], _followed(now[:-1], after[1:], at[1:], kinds, tables)])  # of the k + 1 words that end here
        out[:, k] = now % np.uint32(of)
    return out[place[:, None] >= np.arange(longest)], sizes


def streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written streams: a row for each batch of documents, with their ids, numbers of words, offsets and buckets."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(map(words_of, b.column("text").to_pylist()))
            counts = np.fromiter(map(len, found), np.int64, len(found))
            stream, sizes = buckets([x for f in found for x in f], counts)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            one = lambda x, t: pa.array([x], pa.list_(t))
            yield pa.RecordBatch.from_arrays([one(b.column("doc_id").to_pylist(), pa.int64()), one(counts, pa.int32()), one(offsets, pa.int64()), pa.array([stream.astype("<u2").tobytes()], pa.binary())], names=["ids", "words", "offsets", "stream"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))
    return staged(rows.mapInArrow(run, _STREAMS))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for raw in b.column("stream").to_pylist():
            values = np.sort(np.frombuffer(raw, "<u2"), kind="stable")
            starts = np.flatnonzero(np.diff(values, prepend=-1))
            total[values[starts]] += np.diff(starts, append=len(values))
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int32()), pa.array(total[total > 0], pa.int64())], names=["bucket", "n"])


def counts(written: DataFrame) -> np.ndarray:
    """The number of n-grams by bucket; the driver gets a row for each bucket."""
    small_batches(written.sparkSession, 8)
    out = np.zeros(BUCKETS, np.int64)
    for r in written.select("stream").mapInArrow(_runs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, thousandths of the logarithm of how much likelier it is in the target, both with one added."""
    s, t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(written: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document of the streams."""
    small_batches(written.sparkSession, 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, words, offsets, raw in zip(*(b.column(c).to_pylist() for c in ("ids", "words", "offsets", "stream")), strict=True):
                starts, sizes = np.array(offsets[:-1], np.int64), np.diff(offsets)
                total, some = np.zeros(len(ids), np.int64), sizes > 0
                if some.any():  # starts of documents without n-grams would repeat the next one's
                    total[some] = np.add.reduceat(gain[np.frombuffer(raw, "<u2")], starts[some])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(total, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return written.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """With score: weight and Gumbel noise from a hash of seed and id, in thousandths; null without an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return weighted.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))))


def drawn(scores: DataFrame, least: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """With rank: 1, 2, ... for the highest scores, ties to the smaller id, of floor(percent * N / 100) of the N rows that
    have an id and ``least`` words; null for all others. Rows are sorted by ranges, and ranks go on from range to range."""
    spark, scores = scores.sparkSession, staged(scores)
    may = F.coalesce((F.col("n_words") >= least) & F.col("doc_id").isNotNull(), F.lit(False))
    n = scores.filter(may).count()
    k, none = percent * n // 100, F.lit(None).cast("bigint")
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("n_words")]
    ranged = staged(scores.filter(may).repartitionByRange(partitions_for(spark, n, SORTED_EACH), *order).withColumn("range", F.spark_partition_id()))
    sizes = sorted((r.range, r["count"]) for r in ranged.groupBy("range").count().collect())  # a row for each range
    before, offsets = 0, []
    for at, size in sizes:
        if before < k:
            offsets.append((at, before))
        before += size
    rest = scores.filter(~may).withColumn("rank", none)
    if not offsets:
        return rest.unionByName(ranged.drop("range").withColumn("rank", none))
    last = offsets[-1][0]
    starts = spark.createDataFrame(offsets, "range int, before long")
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("before")
    top = ranged.filter(F.col("range") <= last).join(F.broadcast(starts), "range").withColumn("rank", F.when(place <= k, place.cast("bigint"))).drop("before")
    return rest.unionByName(top.drop("range")).unionByName(ranged.filter(F.col("range") > last).drop("range").withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) for each row of ``docs``.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. Features are all runs of one to three
    words, repeats counted. A null or empty text has none and weight 0. A row without an id has no score, isn't drawn and
    doesn't count among those drawn from; its text counts in the source. Repeated rows are rows of their own. Without
    documents there are no rows; without target texts each feature's gain follows from the source alone. Other columns
    are ignored; ids are integers."""
    written = streams(docs, id_col, text_col)
    aim = counts(streams(target.select(F.lit(None).cast("bigint").alias("none"), F.col(target_text).alias("aim")), "none", "aim"))
    return drawn(scored(weights(written, gains(counts(written), aim)), seed), least, percent)
