"""Exact top-k search over codes of 64 bits, or of several 64-bit words, by incremental multi-index hashing.

Codes are the signs of vectors, cut into segments of a few bits fewer than the number of codes has. The index is a table
of codes by segment and value. Queries look up, for growing radii, the values that differ from their own in exactly
so many bits, and whole distances of what is found are verified in the join. When all segments before j are done to
radius r and the others to r - 1, a code not yet met differs in more than r bits in j segments and in r bits or more
in the others, so its distance is at least ``s * r + j`` of s segments. A query is done as soon as its k-th verified
distance is below that, and asks a segment only while it isn't; what is farther than its k-th is dropped in the join.

Equal codes are one entry with its smallest ids, and equal queries are one query. Rows that are shuffled are codes by
segment, looked-up values, and for each query and segment the k nearest found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, staged

BITS = 64
#: Bits of a segment at least and at most, and how many fewer than the number of codes has: a value has 2^SPARE codes or
#: so, as checking a code costs less than looking up another value. Parts that the rows of one code are first cut to.
NARROWEST, WIDEST, SPARE, SALTS = 8, 30, 4, 16


def segments(codes: int, words: int) -> list[tuple[int, int, int]]:
    """(word, first bit, bits) of each segment of codes of so many ``words``, for a table of so many ``codes``."""
    n = -(-BITS // min(WIDEST, max(NARROWEST, (max(1, codes) - 1).bit_length() - SPARE)))
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(w, a, b - a) for w in range(words) for a, b in zip(cuts, cuts[1:], strict=False)]


def flips(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


def words_of(vectors: DataFrame, vector_col: str) -> int:
    """How many words the codes of the longest vector need."""
    return max(1, -(-(vectors.agg(F.max(F.size(vector_col))).first()[0] or 0) // BITS))


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str, words: int = 1) -> DataFrame:
    """id and code: bit b is set if component b is above 0. ``code`` is a long, or with several ``words`` an array
    of them; ``words_of`` tells how many lose nothing. Shorter vectors leave the rest unset, longer ones count to
    there; null components are unset; null vectors and ids are left out."""
    bits_of = BITS * words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("vector")
            sizes = np.minimum(np.array(v.value_lengths(), np.int64), bits_of)
            start = np.array(v.offsets)[:-1].astype(np.int64)
            flat = np.nan_to_num(np.array(v.values.to_numpy(zero_copy_only=False), np.float64)) > 0
            bits = np.zeros((len(sizes), bits_of), bool)
            inside = np.arange(bits_of) < sizes[:, None]
            bits[inside] = flat[(start[:, None] + np.arange(bits_of))[inside]]
            code = np.packbits(bits, axis=1, bitorder="little").view("<i8")
            code = pa.array(code.ravel(), pa.int64()) if words == 1 else pa.array(code.tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), code], names=["id", "code"])

    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "id long, code long" if words == 1 else "id long, code array<long>")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), neighbor_id and distance: the ``k`` rows nearest to each query by Hamming distance,
    ties by smaller id, the query's own id left out. ``rows`` and ``queries`` have id and code (long, or
    arrays of equally many). A query has fewer results only if there are fewer rows. Ids should be unique: rows that
    repeat an id and its code count once, an id with several codes counts for each of them."""
    spark = rows.sparkSession
    k1 = k + 1
    # First within a part of a code's rows, so that a code that most rows have is no task's own.
    salted = rows.select("id", "code", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).distinct()
    few = salted.withColumn("n", F.row_number().over(Window.partitionBy("code", "salt").orderBy("id"))).filter(F.col("n") <= k1)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("n") <= k1)
    codes = staged(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = staged(queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct())
    wide = rows.schema["code"].dataType.typeName() == "array"
    words = (codes.agg(F.max(F.size("code"))).first()[0] or 1) if wide else 1
    cut = segments(codes.count(), words)
    word = lambda c, w: F.col(c)[w] if wide else F.col(c)
    part = lambda c, w, a, n: F.shiftrightunsigned(word(c, w), a).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))
    far: Column = reduce(lambda x, y: x + y, [F.bit_count(word("code", w).bitwiseXOR(word("query", w))) for w in range(words)])

    def by_segment(c: str) -> Column:
        """A row for each segment of a code: its number, its bits, its value."""
        return F.inline(F.array(*[F.struct(F.lit(j).alias("segment"), F.lit(n).alias("bits"), part(c, w, a, n).alias("value")) for j, (w, a, n) in enumerate(cut)]))

    index = staged(codes.select("code", "ids", by_segment("code")).drop("bits"))
    open_ = asked.select("query").distinct().withColumn("kth", F.lit(BITS * words + 1))
    best = done = None
    for radius in range(max(n for *_, n in cut) + 1):
        probes = open_.select("query", "kth", by_segment("query")).filter(F.col("kth") >= len(cut) * radius + F.col("segment"))
        near = pa.table({"bits": np.concatenate([np.full(len(flips(n, radius)), n) for n in {n for *_, n in cut}]), "flip": np.concatenate([flips(n, radius) for n in {n for *_, n in cut}])})
        probes = probes.join(F.broadcast(spark.createDataFrame(near)), "bits").select("query", "kth", "segment", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
        met = index.join(probes, ["segment", "value"]).withColumn("distance", far).filter(F.col("distance") <= F.col("kth"))
        met = met.select("query", "segment", "distance", F.explode("ids").alias("id"))
        # A code is met once by a segment, so of these the k nearest are different rows.
        first = Window.partitionBy("query", "segment").orderBy("distance", "id")
        met = met.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k1).select("query", "distance", "id")
        met = (met if best is None else met.unionByName(best)).distinct()
        nearest = met.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).filter(F.col("n") <= k1)
        nearest = staged(nearest)
        # Queries without anything found yet stay open as well.
        reached = nearest.filter(F.col("n") == k1).select("query", F.col("distance").alias("reached"))
        open_ = staged(open_.select("query").join(reached, "query", "left").withColumn("kth", F.coalesce("reached", F.lit(BITS * words + 1))).select("query", "kth"))
        covered = len(cut) * (radius + 1)
        ended = nearest.join(open_.filter(F.col("kth") < covered), "query", "left_semi").drop("n")
        open_ = open_.filter(F.col("kth") >= covered)
        done = ended if done is None else done.unionByName(ended)
        best = nearest.join(open_, "query", "left_semi").drop("n")
        if open_.isEmpty():
            break
    done = done.unionByName(best)  # those with fewer rows than they ask for, after all radii
    all_of = asked.join(done, "query").filter("query_id <> id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return all_of.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("neighbor_id"), "distance")
