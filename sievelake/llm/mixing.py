"""Mixing sources to target weights, in blocks of words of one length.

The words of each source are laid end to end and cut evenly into blocks of at most ``block`` words, whose lengths
differ by one at most. A source that isn't taken in whole passes has ``FEWEST`` blocks at least, or one for each
word. The mix takes a number of blocks of each source in proportion to its target, so that it misses the target by
about half a block at most. Output shards are filled one after the other: the sources' counts in a
shard are a multinomial draw by what each still has to give, so that the last shard meets the totals. A
source's blocks are numbered slots, and slot s is block ``P(s mod N)`` of its N blocks, where P is a keyed
Feistel permutation of the block numbers, another one for each pass over the source. Blocks then join the
documents that they cover by source and block number; nothing is shuffled but numbers.

Where a document starts in its source comes from prefix sums in two levels: documents are dealt to chunks of
about ``CHUNK`` rows by hash, chunks are summed over the source and documents within their chunk, so that a
source with a third of all rows is no task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import cycle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, columns_of, free, mapped, mixed, small_batches, spans, staged, text_bytes

BLOCK, SHARE, LIMIT, SEED = 128, 1.5, 2.0, 11
WEIGHTS = (3.0, 1.0, 2.0)
CHUNK = 512
#: Blocks of a source at least, so that a small one comes near its target too.
FEWEST = 32
#: Blocks of a shard at least, and shards at most; the driver draws the counts of each shard.
SHARD_BLOCKS, SHARDS = 4096, 4096


def targets(sizes: list[int], share: float = SHARE, limit: float = LIMIT, weights: tuple[float, ...] = WEIGHTS) -> list[float]:
    """``share`` of the sum of ``sizes``, by weight, none above ``limit`` times its size: what is above is dealt
    to the others by weight, again and again."""
    w = [x for _, x in zip(sizes, cycle(weights), strict=False)]
    out, free, left = [0.0] * len(sizes), [k for k, n in enumerate(sizes) if n > 0], share * sum(sizes)
    while free:
        each = left / sum(w[k] for k in free)
        if not (full := [k for k in free if w[k] * each > limit * sizes[k]]):
            for k in free:
                out[k] = w[k] * each
            break
        for k in full:
            out[k] = limit * sizes[k]
            left -= out[k]
            free.remove(k)
    return out


def block_counts(sizes: list[int], want: list[float], block: int = BLOCK) -> tuple[list[int], list[int]]:
    """The number of blocks that each source is cut to, and how many the mix takes for ``want`` words."""
    blocks, slots = [], []
    for n, t in zip(sizes, want, strict=True):
        passes = t / n if n else 0.0
        b = -(-n // (block if passes == round(passes) else max(1, min(block, n // FEWEST))))
        blocks.append(b)
        slots.append(round(passes * b))
    return blocks, slots


def permuted(slots: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed permutation of ``range(n)`` sends ``slots``: a Feistel network on the next even number of
    bits, applied again while it leaves the range."""
    half = np.uint64(max(1, -(-max(1, n - 1).bit_length() // 2)))
    low = np.uint64((1 << int(half)) - 1)
    x, out = slots.astype(np.uint64), np.zeros(len(slots), np.int64)
    at = np.arange(len(slots))
    while len(at):
        a, b = x >> half, x & low
        for r in range(4):
            a, b = b, a ^ (mixed(b + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 % 2**64)) & low)
        x = a << half | b
        done = x < n
        out[at[done]] = x[done]
        at, x = at[~done], x[~done]
    return out


def draws(totals: list[int], seed: int = SEED) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot, count): multinomial counts by what remains of each total, none above it."""
    rng = np.random.default_rng(seed)
    left, at, out, shard = np.array(totals, np.int64), np.zeros(len(totals), np.int64), [], 0
    each = max(SHARD_BLOCKS, -(-int(left.sum()) // SHARDS))
    while left.sum():
        take, need = np.zeros_like(left), min(each, int(left.sum()))
        while need:
            rest = left - take
            more = np.minimum(rng.multinomial(need, rest / rest.sum()), rest)
            take += more
            need -= int(more.sum())
        out += [(shard, k, int(at[k]), int(n)) for k, n in enumerate(take) if n]
        at, left, shard = at + take, left - take, shard + 1
    return out


SLOTS = pa.schema([("k", pa.int32()), ("block", pa.int64()), ("shard", pa.int32()), ("slot", pa.int64())])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("mark"), pa.array([len(t.split()) for t in b.column("text").to_pylist()], pa.int64())], names=["doc_id", "source", "mark", "size"])


class Mix:
    """The plan of a mix over ``docs``: sources (k, source, source_size, target, blocks, slots, words of a
    block, longer blocks), documents with their places (doc_id, k, size, start), and the slots of the shards.

    A null text has size 0, a null source is a source of its own, the last one. Documents of size 0 are never
    taken. Repeated rows are separate documents, and so are rows without an id. No rows, or none with words, give an empty
    mix. Ids are integers."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, share: float = SHARE, limit: float = LIMIT, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED):
        spark = docs.sparkSession
        small_batches(spark)
        rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_bytes(text_col)).alias("mark"), text_bytes(text_col).alias("text"))
        sized = staged(rows.mapInArrow(_sizes, "doc_id long, source string, mark long, size long"))
        by = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
        by.sort(key=lambda r: (r.source is None, r.source or ""))
        want = targets([r.n for r in by], share, limit, weights)
        blocks, slots = block_counts([r.n for r in by], want, block)
        self.sources = spark.createDataFrame(
            [(k, r.source, r.n, t, b, s, r.n // max(1, b), r.n % max(1, b), -(-r.rows // CHUNK)) for k, (r, t, b, s) in enumerate(zip(by, want, blocks, slots, strict=True))],
            "k int, source string, source_size long, target double, blocks long, slots long, words long, longer long, chunks long",
        )
        chunked = sized.join(self.sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
            "doc_id", "source", "mark", "k", "size", "source_size", "target", "words", "longer", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("chunks")).alias("chunk")
        )
        sums = chunked.groupBy("k", "chunk").agg(F.sum("size").alias("n"))
        before = sums.select("k", "chunk", (F.sum("n").over(Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
        within = Window.partitionBy("k", "chunk").orderBy("doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, 0)
        placed = chunked.withColumn("upto", F.sum("size").over(within)).join(before, ["k", "chunk"])
        self.places = staged(placed.select("doc_id", "source", "mark", "k", "size", "source_size", "target", "words", "longer", (F.col("before") + F.col("upto") - F.col("size")).alias("start")))
        drawn, of = draws(slots, seed), dict(enumerate(blocks))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    for a in range(r["slot"], r["slot"] + r["n"], 65_536):
                        s, n, k = np.arange(a, min(a + 65_536, r["slot"] + r["n"])), of[r["k"]], r["k"]
                        at = np.concatenate([permuted(s[s // n == e] % n, n, hash((seed, k, int(e))) & 0xFFFFFFFF) for e in range(s[0] // n, s[-1] // n + 1)])
                        yield from arrow_rows({"k": np.full(len(s), k, np.int32), "block": at, "shard": np.full(len(s), r["shard"], np.int32), "slot": s}, SLOTS)

        parts = max(1, min(len(drawn), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        self.slots = spark.createDataFrame(drawn, "shard int, k int, slot long, n long").repartition(parts).mapInArrow(run, "k int, block long, shard int, slot long")

    def times(self) -> DataFrame:
        """k, block, times: how often the mix takes each block that it takes."""
        return self.slots.groupBy("k", "block").agg(F.count(F.lit(1)).alias("times"))

    def pieces(self) -> DataFrame:
        """doc_id, mark (of the text), k, size, start, and for each block that a document has words in: block, first and last (words
        of the document in it, from 0, last excluded), times (0 if the mix doesn't take it)."""
        # The first ``longer`` blocks of a source have a word more than its others.
        n, long = F.col("words"), F.col("longer") * (F.col("words") + 1)
        of = lambda w: F.when(w < long, F.floor(w / (n + 1))).otherwise(F.col("longer") + F.floor((w - long) / n))
        at = lambda b: b * n + F.least(b, F.col("longer"))
        cut = self.places.filter("size > 0").withColumn("block", F.explode(F.sequence(of(F.col("start")), of(F.col("start") + F.col("size") - 1))))
        first = F.greatest(F.col("start"), at(F.col("block"))) - F.col("start")
        last = F.least(F.col("start") + F.col("size"), at(F.col("block") + 1)) - F.col("start")
        return cut.select("doc_id", "mark", "k", "size", "start", "block", first.alias("first"), last.alias("last")).join(self.times(), ["k", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))

    def taken(self) -> DataFrame:
        """doc_id, source, size, source_size, target and taken (words, repeats counted) for each document."""
        # A document with words has a place of its own in its source.
        of = self.pieces().filter("times > 0").groupBy("k", "start", "size").agg(F.sum((F.col("last") - F.col("first")) * F.col("times")).alias("taken"))
        return self.places.join(of, ["k", "start", "size"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def cut(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The words in ``ranges`` (first, last excluded; in order), with what stands between neighbours; ranges that
    don't touch are joined by a space."""
    starts, ends = spans(_IS_WORD[np.frombuffer(text, np.uint8)])
    joined: list[list[int]] = []
    for a, b in ranges:
        if joined and joined[-1][1] == a:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    return b" ".join(text if (a, b) == (0, len(starts)) else text[starts[a] : ends[b - 1]] for a, b in joined)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", **plan) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a document's first copy has the words whose blocks are
    taken, its second those taken twice, and so on; one of which nothing is taken goes. Blocks split texts at
    words; a copy of all words is the whole text. ``chars_col`` is counted anew. Rows that repeat an id, or have none,
    are documents of their own; those alike in id, source and text may stand for each other. Columns may have any names."""
    mix = Mix(docs, id_col, text_col, source_col, **plan)
    found = mix.pieces().filter("times > 0").groupBy("doc_id", "mark", "k", "start", "size").agg(F.sort_array(F.collect_list(F.struct("first", "last", "times"))).alias("pieces"))
    several = mix.places.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select("doc_id")
    key, pieces, of_source, of_mark, turn, of_turn, source, mark = free(docs, "of_id", "pieces", "of_source", "of_mark", "turn", "of_turn", "source_text", "mark")
    named = found.select(F.col("doc_id").alias(key), F.col("pieces").alias(pieces))
    odd = not several.isEmpty()
    if odd:
        several = staged(several)
        named = found.join(several, "doc_id", "left_anti").select(F.col("doc_id").alias(key), F.col("pieces").alias(pieces))
    rows = docs.join(named, docs[id_col].cast("bigint") == F.col(key)).select(*columns_of(docs), pieces)
    if odd:  # rows that their ids don't tell apart: by source and text too, and by turns where these are the same
        twin = Window.partitionBy("doc_id", "k", "mark").orderBy("start")
        places = mix.places.filter("size > 0").join(several.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
        places = places.withColumn("turn", F.row_number().over(twin)).select("source", "k", "start", "turn")
        theirs = found.join(places, ["k", "start"]).select(F.col("doc_id").alias(key), F.col("source").alias(of_source), F.col("mark").alias(of_mark), F.col("turn").alias(of_turn), F.col("pieces").alias(pieces))
        mine = docs.join(several.withColumnRenamed("doc_id", key), docs[id_col].cast("bigint").eqNullSafe(F.col(key)), "left_semi")
        mine = mine.withColumns({source: F.col(source_col).cast("string"), mark: F.xxhash64(text_bytes(text_col))})
        mine = mine.withColumn(turn, F.row_number().over(Window.partitionBy(mine[id_col].cast("bigint"), source, mark).orderBy(text_col)))
        same = mine[id_col].cast("bigint").eqNullSafe(F.col(key)) & F.col(source).eqNullSafe(F.col(of_source)) & (F.col(mark) == F.col(of_mark)) & (F.col(turn) == F.col(of_turn))
        both = mine.join(theirs, same)
        rows = rows.unionByName(both.select(*columns_of(docs), pieces))
    small_batches(docs.sparkSession)
    names = docs.columns
    at, of = names.index(text_col), names.index(chars_col) if chars_col in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(text_col).cast(pa.binary()).to_pylist()
            rows, out = [], []
            for k, found in enumerate(b.column(pieces).to_pylist()):
                for copy in range(max(p["times"] for p in found)):
                    rows.append(k)
                    out.append(cut(raw[k], [(p["first"], p["last"]) for p in found if p["times"] > copy]).decode("utf-8", "replace"))
            columns = b.drop_columns([pieces]).take(pa.array(rows, pa.int64())).columns
            columns[at] = pa.array(out, columns[at].type)
            if of >= 0:
                columns[of] = pa.array(list(map(len, out)), pa.int64()).cast(columns[of].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return mapped(rows, run, docs.schema)
