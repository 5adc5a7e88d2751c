"""Whether reads align to a host: seeds by positioned minimizers, votes by diagonal, and a banded comparison.

The host is cut into tiles that overlap, and its seeds are a table bucketed by value. A read's seeds meet them in a join; each
tells a diagonal, where the read would begin. Diagonals are binned, and for each bin the read is held against that part of
the host, all candidates of a batch at once, a letter of the reads at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.layout import bucketed
from .host_index import _CODE, _mixed, _sequences, joined
from .trimming import _COMPLEMENT, _UPPER, flat, padded

#: Letters of a seed (an odd number, so that none is its own other strand), and of how many in a row the least is taken.
LENGTH, SPAN = 15, 10
#: Letters of a tile, and how far each goes on over the next: reads and their edits must fit in that.
TILE, REACH = 4096, 2048
#: Diagonals of a bin.
BIN = 8
#: Seeds that the host has more often are none.
MOST = 256


def seeds(data: np.ndarray, at: np.ndarray, length: int = LENGTH, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all sequences that lie in ``data`` one after another: the row, the number, the place and the strand (True: the other)
    of each seed. Of each ``span`` parts of ``length`` letters in a row the one whose number, mixed, is least is a seed, the
    first of equals; parts with another letter than A, C, G and T (in any case) are in none of them."""
    n = len(data) - length - span + 2
    if n < 1:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    codes = _CODE[data]
    other = np.concatenate([[0], np.cumsum(codes == 4)])
    codes &= 3
    one, two = joined(codes, length, True), joined(3 - codes, length, False)
    keys = _mixed(np.minimum(one, two))
    whole = length + span - 1
    valid = (other[whole:] == other[:-whole]) & (np.repeat(at[1:], np.diff(at))[:n] - np.arange(n) >= whole)
    best, off = keys[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span):
        less = keys[j : j + n] < best
        best[less], off[less] = keys[j : j + n][less], j
    place = np.unique((np.arange(n) + off)[valid])
    row = np.searchsorted(at, place, "right") - 1
    return row, np.minimum(one, two)[place].view(np.int64), place - at[row], two[place] < one[place]


def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns but for ``seq``, with value, place and strand of each seed, and the sequence's length."""
    for b in batches:
        rest = b.drop_columns(["seq"])
        for first, data, at in _sequences(b):
            row, value, place, strand = seeds(data, at)
            for x in range(0, len(row), 1 << 18):
                p = slice(x, x + (1 << 18))
                of = rest.take(pa.array(row[p] + first))
                yield pa.RecordBatch.from_arrays([*of.columns, pa.array(value[p]), pa.array(place[p], pa.int32()), pa.array(strand[p]), pa.array(np.diff(at)[row[p]], pa.int32())], names=[*rest.schema.names, "value", "place", "strand", "letters"])


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for contig, seq in zip(b.column("contig").to_pylist(), b.column("seq").to_pylist(), strict=True):
            n = len(seq or "")
            for a in range(0, n, 256 * TILE):
                starts = range(a, min(n, a + 256 * TILE), TILE)
                yield pa.RecordBatch.from_arrays([pa.array([contig] * len(starts), pa.string()), pa.array([s // TILE for s in starts], pa.int32()), pa.array([seq[s : s + TILE + REACH] for s in starts], pa.string())], names=["contig", "tile", "seq"])


@dataclass(frozen=True)
class Host:
    """Tables of a host's seeds (value, contig, at, strand), and of its tiles (contig, tile, seq)."""

    seeds: DataFrame
    tiles: DataFrame


def prepared(host: DataFrame, contig: str, seq: str = "seq", most: int | None = MOST) -> Host:
    """A host's tables, in buckets, for any number of sets of reads. Contigs have different names; null and short ones have no
    seeds. ``most``: seeds that are there more often are left out (None: none are)."""
    rows = host.select(F.col(contig).cast("string").alias("contig"), F.col(seq).cast("string").alias("seq"))
    tiles = bucketed(rows.mapInArrow(_tiled, "contig string, tile int, seq string"), ["contig", "tile"])
    found = tiles.mapInArrow(_seeded, "contig string, tile int, value long, place int, strand boolean, letters int")
    places = found.select("value", "contig", (F.col("tile").cast("bigint") * TILE + F.col("place")).alias("at"), "strand").distinct()
    if most is not None:
        often = places.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("value")
        places = places.join(often, "value", "left_anti")
    return Host(bucketed(places, ["value"]), tiles)


def distances(reads: np.ndarray, sizes: np.ndarray, parts: np.ndarray, width: int) -> np.ndarray:
    """The least number of edits between each read (a row, of so many letters) and a stretch of its part of the host, over all
    paths that begin and end within the first ``width`` + 1 diagonals of the part and stay there."""
    best = np.zeros((len(reads), width + 1), np.int32)
    out, steps = np.where(sizes == 0, 0, np.iinfo(np.int32).max), np.arange(width + 1, dtype=np.int32)
    for i in range(reads.shape[1]):
        wrong = parts[:, i : i + width + 1] != reads[:, i : i + 1]
        now = best + wrong
        np.minimum(now[:, :-1], best[:, 1:] + 1, out=now[:, :-1])  # a letter that only the read has
        best = np.minimum.accumulate(now - steps, axis=1) + steps  # letters that only the host has
        done = sizes == i + 1
        if done.any():
            out[done] = best[done].min(1)
    return out


def _compared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reads, at = flat(b.column("seq"))
            sizes = np.diff(at)
            most = sizes * percent // 100
            n, width = int(sizes.max(initial=0)), int(BIN + 2 * most.max(initial=0))
            found = np.zeros(len(sizes), np.int32)
            step = max(1, (1 << 23) // max(1, n + width))
            for r in range(0, len(sizes), step):
                part = slice(r, r + step)
                read = _UPPER[padded(reads, at[r : r + step + 1], n)]
                read[~np.isin(read, np.frombuffer(b"ACGT", np.uint8))] = 1
                back = b.column("reverse").slice(r, step).to_numpy(zero_copy_only=False)
                flipped = _COMPLEMENT[read]
                flipped[flipped == 0] = 1
                k = sizes[part][:, None] - 1 - np.arange(n)
                flipped = np.where(k >= 0, np.take_along_axis(flipped, np.maximum(k, 0), 1), 1)
                read = np.where(back[:, None], flipped, read)
                host, ends = flat(b.column("part").slice(r, step))
                # Parts begin where a read with the most edits could; ``lead`` letters before a contig aren't there.
                lead = b.column("lead").slice(r, step).to_numpy()
                rows = np.zeros((len(read), n + width + 1), np.uint8)
                own = np.minimum(np.diff(ends), n + width + 1 - lead)
                row = np.repeat(np.arange(len(read)), own)
                col = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
                rows[row, col + lead[row]] = _UPPER[host[ends[:-1][row] + col]]
                # A read of fewer edits has a narrower band: what lies outside of it can't be reached with as few.
                found[part] = distances(read, sizes[part], rows, width)
            keep = pa.array(found <= most)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("contig"), b.column("begin"), b.column("reverse"), pa.array(found)], names=["id", "contig", "begin", "reverse", "edits"]).filter(keep)

    return run


def hits(reads: DataFrame, host: Host, id_col: str, seq: str = "seq", percent: int = 10, least_votes: int = 1) -> DataFrame:
    """For each read that aligns its best hit: ``edits`` (``percent`` hundredths of its letters at most), contig, begin (of the bin of
    diagonals, about where it begins) and reverse. Only places count that share a seed with it (``least_votes`` of them). Ids
    are unique; reads beyond ``REACH`` letters with their edits raise; null and short ones have no seeds and no hit."""
    rows = reads.select(F.col(id_col).alias("id"), F.col(seq).cast("string").alias("seq"))
    fits = F.length("seq") * (100 + 2 * percent) / 100 + 2 * BIN <= REACH
    rows = rows.withColumn("seq", F.when(F.col("seq").isNull() | fits, F.col("seq")).otherwise(F.raise_error(F.lit(f"a read doesn't fit in {REACH} letters"))))
    own = rows.mapInArrow(_seeded, rows.drop("seq").schema.add("value", "long").add("place", "integer").add("strand", "boolean").add("letters", "integer"))
    met = own.join(host.seeds.withColumnRenamed("strand", "there"), "value")
    reverse = F.col("strand") != F.col("there")
    start = F.col("at") - F.when(reverse, F.col("letters") - LENGTH - F.col("place")).otherwise(F.col("place"))
    votes = met.select("id", "letters", "contig", reverse.alias("reverse"), F.floor(start / BIN).alias("bin")).groupBy("id", "letters", "contig", "reverse", "bin").agg(F.count(F.lit(1)).alias("votes")).filter(F.col("votes") >= least_votes)
    most = F.floor(F.col("letters") * percent / 100)
    begin = F.col("bin") * BIN
    placed = votes.withColumns({"begin": begin, "from": F.greatest(begin - most, F.lit(0)), "lead": F.greatest(most - begin, F.lit(0))}).withColumn("tile", F.floor(F.col("from") / TILE).cast("int"))
    there = placed.join(host.tiles.withColumnRenamed("seq", "tile_seq"), ["contig", "tile"])
    part = F.substring("tile_seq", (F.col("from") - F.col("tile").cast("bigint") * TILE + 1).cast("int"), (F.col("letters") + BIN + 2 * most + 1 - F.col("lead")).cast("int"))
    full = there.select("id", "contig", "begin", "reverse", "lead", part.alias("part")).join(rows, "id")
    kind = rows.drop("seq").schema.add("contig", "string").add("begin", "long").add("reverse", "boolean").add("edits", "integer")
    found = full.mapInArrow(_compared(percent), kind)
    best = found.groupBy("id").agg(F.min(F.struct("edits", "contig", "begin", "reverse")).alias("b"))
    return best.select(F.col("id").alias(id_col), "b.*")


def mapped(reads: DataFrame, host: Host, id_col: str, seq: str = "seq", name: str = "mapped", **options) -> DataFrame:
    """``reads`` with whether each aligns to the host."""
    found = hits(reads, host, id_col, seq, **options).select(F.col(id_col).alias("__id"), F.lit(True).alias(name))
    return reads.join(found, F.col(id_col) == F.col("__id"), "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("__id")
