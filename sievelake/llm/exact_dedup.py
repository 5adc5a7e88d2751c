"""Exact dedup by a cuckoo-filter index over digests of normalised texts.

The index has two layers. A cuckoo filter keeps a 16-bit fingerprint of each live digest in one of two
buckets of four slots; a digest that no bucket holds is new, without a look at the content. A hit is only a
hint, so it is verified against the content, which keeps whole digests by their first bucket. A removed
digest gives its slot back. When no slot can be freed, the filter is doubled and filled again from the stored
keys.

On Spark, each task first indexes the rows of its own partition and passes on one row a digest, so that a
group of copies of any size reaches the second step as one row a task. There the digests are dealt by hash,
each partition merges its rows in an index of its own, and the groups join back to the rows by digest.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, columns_of, free, mapped, partitions_for, small_batches, staged, text_bytes

#: Characters that do not count: space, tab, line feed, vertical tab, form feed and carriage return.
IGNORED = b" \t\n\x0b\x0c\r"
#: Digests that one partition of the index is meant to hold.
KEYS_EACH = 300_000


class CuckooIndex:
    """Digests with a payload each: insert, find, delete; every answer is exact."""

    SLOTS = 4

    def __init__(self, capacity: int = 1024, most_kicks: int = 128):
        self.most_kicks, self.size, self.resizes = most_kicks, 0, 0
        self.content: dict[int, list[list]] = {}
        self._clear(max(1, 1 << (max(1, capacity // self.SLOTS) - 1).bit_length()))

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table = array("H", bytes(2 * self.SLOTS * buckets))
        self._turn = 1

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:8], "little") & self.mask
        return mark, first, first ^ (mark * 0x9E3779B1 & self.mask)

    def _has(self, mark: int, bucket: int) -> bool:
        at = bucket * self.SLOTS
        return mark in self.table[at : at + self.SLOTS]

    def _put(self, mark: int, bucket: int) -> bool:
        """Into the bucket or, by moving others on, anywhere; false if that takes too many moves."""
        table, slots = self.table, self.SLOTS
        for b in (bucket, bucket ^ (mark * 0x9E3779B1 & self.mask)):
            for k in range(b * slots, b * slots + slots):
                if not table[k]:
                    table[k] = mark
                    return True
        for _ in range(self.most_kicks):
            self._turn = (self._turn * 1103515245 + 12345) & 0x7FFFFFFF
            k = bucket * slots + (self._turn >> 8) % slots
            mark, table[k] = table[k], mark
            bucket ^= mark * 0x9E3779B1 & self.mask
            for k in range(bucket * slots, bucket * slots + slots):
                if not table[k]:
                    table[k] = mark
                    return True
        return False

    def _rebuild(self) -> None:
        """Double the filter until all stored keys fit."""
        entries, buckets = [e for es in self.content.values() for e in es], self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self._clear(buckets)
            self.content = {}
            for e in entries:
                mark, first, _ = self._places(e[0])
                self.content.setdefault(first, []).append(e)
                if not self._put(mark, first):
                    break
            else:
                return

    def find(self, digest: bytes) -> list | None:
        """The entry ``[digest, payload]``, or None."""
        mark, first, second = self._places(digest)
        if self._has(mark, first) or self._has(mark, second):
            for e in self.content.get(first, ()):
                if e[0] == digest:
                    return e
        return None

    def insert(self, digest: bytes, payload=None) -> list:
        """The entry of the digest; a new one gets the payload."""
        if (e := self.find(digest)) is not None:
            return e
        mark, first, _ = self._places(digest)
        self.content.setdefault(first, []).append(e := [digest, payload])
        self.size += 1
        if self.size > 0.95 * len(self.table) or not self._put(mark, first):
            self._rebuild()
        return e

    def delete(self, digest: bytes) -> bool:
        """Whether it was there."""
        if (e := self.find(digest)) is None:
            return False
        mark, first, second = self._places(digest)
        self.content[first].remove(e)
        if not self.content[first]:
            del self.content[first]
        for b in (first, second):
            for k in range(b * self.SLOTS, b * self.SLOTS + self.SLOTS):
                if self.table[k] == mark:
                    self.table[k] = 0
                    self.size -= 1
                    return True
        raise AssertionError("a stored digest has no mark")

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[list]:
        for es in self.content.values():
            yield from es


ROWS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_points", pa.int64())])
GROUPS = pa.schema([("digest", pa.binary()), ("n_points", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [hashlib.sha256(t.translate(None, IGNORED)).digest() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.binary()), b.column("n_points")], schema=ROWS)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, digest (SHA-256 of the text without ``IGNORED``), n_points
    (code points of the whole text). A null text counts as empty. Other columns are not looked at."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"), F.coalesce(F.char_length(F.col(text_col).cast("string")), F.lit(0)).cast("bigint").alias("n_points"))
    return rows.mapInArrow(_digest_rows, "doc_id long, digest binary, n_points long")


def _rank(n_points: int, doc_id: int | None) -> tuple:
    """Larger stays: most code points, then smallest id; a null id is last."""
    return n_points, doc_id is not None, -(doc_id or 0)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a digest of those of this partition."""
    index = CuckooIndex()
    for b in batches:
        for digest, n, i, count in zip(*(b.column(f.name).to_pylist() for f in GROUPS), strict=True):
            if (e := index.find(digest)) is None:
                index.insert(digest, [n, i, count])
                continue
            best = e[1]
            best[2] += count
            if _rank(n, i) > _rank(best[0], best[1]):
                best[:2] = n, i
    rows = [(d, *p) for d, p in index]
    yield from arrow_rows({f.name: [r[k] for r in rows] for k, f in enumerate(GROUPS)}, GROUPS)


KIND = "digest binary, n_points long, keep_id long, group_size long"


def groups(rows: DataFrame) -> DataFrame:
    """The index: a row for each digest of ``rows`` (as from :func:`digests`) with the row that stays
    (keep_id, n_points) and the number of rows (group_size). No rows give no rows; a row without an id stays only where
    no other has as many code points."""
    spark = rows.sparkSession
    local = rows.select("digest", "n_points", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size")).mapInArrow(_merged, KIND)
    return local.repartition(partitions_for(spark, rows.count(), KEYS_EACH), "digest").mapInArrow(_merged, KIND)


def _without(key, left: pa.Table, right: pa.Table) -> pa.Table:
    index = CuckooIndex(max(1, left.num_rows))
    for row in left.to_pylist():
        index.insert(row["digest"], row)
    for digest in right.column("digest").to_pylist():
        index.delete(digest)
    return pa.Table.from_pylist([{f.name: e[1][f.name] for f in GROUPS} for e in index], schema=GROUPS)


def add(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index after new rows (as from :func:`digests`) came: a digest that was there only grows, and the better row
    stays. Either may be empty; repeated rows count as often as they come."""
    both = index.select(*GROUPS.names).unionByName(groups(rows))
    return both.repartition(partitions_for(index.sparkSession, index.count(), KEYS_EACH), "digest").mapInArrow(_merged, KIND)


def remove(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the digests in ``gone`` (column digest): a digest goes with its whole group, whatever its size.
    Digests that the index lacks, and nulls, have no effect; one that comes again later is new."""
    n = partitions_for(index.sparkSession, index.count(), KEYS_EACH)
    part = lambda df: df.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(n)))
    left, right = part(index.select(*GROUPS.names)), part(gone.select("digest").filter("digest IS NOT NULL").distinct())
    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(_without, KIND)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Texts are equal if they are once ``IGNORED`` is deleted; a null text is empty, so null, empty and blank
    texts are equal. The one with the most code points stays, then the smallest id. ``group_size`` counts
    rows; rows that repeat the id that stays are all kept. No rows give no rows. Extra columns are ignored."""
    rows = staged(digests(docs, id_col, text_col))
    found = staged(groups(rows))
    return rows.join(found.drop("n_points"), "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def _with_digests(text: str, digest: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [hashlib.sha256(t.translate(None, IGNORED)).digest() for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.drop_columns([text]).columns, pa.array(found, pa.binary())], names=[*b.drop_columns([text]).schema.names, digest])

    return run


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns: the one with the most code points, then the smallest
    id; a row without an id only where no row with one has as many. Of rows with one id (or none) and as many code points
    the one with the smallest text stays; rows that agree in that too are alike, and one of them stays.

    Null, empty and blank texts are equal. No rows give no rows. Columns may have any names. Ids are integers."""
    rows = staged(digests(docs, id_col, text_col))
    found = staged(groups(rows))
    several = rows.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select("doc_id")
    stays = found.filter("keep_id IS NOT NULL").select("keep_id").distinct()
    odd = not several.isEmpty()
    if odd:  # rows that their ids don't tell apart
        several = staged(several)
        stays = stays.join(several, F.col("keep_id") == F.col("doc_id"), "left_anti")
    (key,) = free(docs, "keep_id")
    # The ids that stay grow with the rows, so they aren't broadcast at any size.
    out = docs.join(stays.withColumnRenamed("keep_id", key).hint("merge"), docs[id_col].cast("bigint") == F.col(key), "left_semi")
    if not odd:
        return out
    small_batches(docs.sparkSession)
    key, raw, points, digest, rank = free(docs, "of_id", "raw", "points", "digest", "rank")
    mine = docs.join(several.withColumnRenamed("doc_id", key), docs[id_col].cast("bigint").eqNullSafe(F.col(key)), "left_semi")
    mine = mine.withColumns({raw: text_bytes(text_col), points: F.coalesce(F.char_length(F.col(text_col).cast("string")), F.lit(0)).cast("bigint")})
    marked = mapped(mine, _with_digests(raw, digest), mine.drop(raw).schema.add(digest, "binary"))
    best = found.select(F.col("digest").alias("of_digest"), F.col("n_points").alias("of_points"), F.col("keep_id").alias("of_keep"))
    best = best.toDF(*free(marked, *best.columns))
    of_digest, of_points, of_keep = best.columns
    first = marked.join(best, (F.col(digest) == F.col(of_digest)) & (F.col(points) == F.col(of_points)) & marked[id_col].cast("bigint").eqNullSafe(F.col(of_keep)))
    (rank,) = free(first, rank)
    first = first.withColumn(rank, F.row_number().over(Window.partitionBy(digest).orderBy(text_bytes(text_col)))).filter(F.col(rank) == 1)
    return out.unionByName(first.select(*columns_of(docs)))
