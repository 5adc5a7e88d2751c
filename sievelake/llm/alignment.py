"""Tokens of two tokenizers aligned by where they end, as relations.

Tokens are exploded with their places, a window sums their lengths to ends, and an equi-join on text and end finds the
offsets where tokens of both end: the cuts, each of which is a link of two tokens. Running counts of cuts number the
groups between them. How often an id pair is linked is a table with a row for each pair; of two tokens that end
together one is the end of the other, so pairs are bounded by the two vocabularies and that table may be broadcast.

Neither tokenizer has a token that crosses the place before a space that no space precedes and no white space follows,
and neither looks across it. So texts are cut there, and the relations are made once for each different chunk instead
of each place where it stands. Chunks are numbered within blocks of documents: what a chunk's tokens give goes back to
its blocks under those numbers, and a document is the sequence of its chunks.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import bucketed, small_batches, staged, text_bytes
from .prefix_bpe import TOKENIZER, byte_of

PIECES = "piece_bpe_32k.model"
#: Bytes of text, and different chunks, that a block is meant to have; places of a chunk that one row lists at most.
BLOCK_BYTES, BLOCK_KINDS, PLACES = 48 << 20, 3 << 18, 4096
_CUT = re.compile(r"(?<! ) (?=\S)")
_MARK = "▁"


def chunks(text: str) -> list[str]:
    """What follows the first space of each chunk of the text, which itself has a space put before it."""
    out = text.split(" ")
    if "" in out or bpe.SPACES.search(text) or text[:1].isspace():
        first, *out = _CUT.split(" " + text)
        if first:  # no cut before the added space
            out.insert(0, first[1:])
    return out


class Two:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        raw, of_a, of_b = byte_of(), self.a.get_vocab(), [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.a_bytes = [b""] * (max(of_a.values()) + 1)
        for t, k in of_a.items():
            self.a_bytes[k] = bytes(map(raw.__getitem__, t))
        self.b_bytes = [bytes([int(t[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", t) else t.replace(_MARK, " ").encode() for t in of_b]
        if any(_MARK in t.lstrip(_MARK) for t in of_b):
            raise ValueError(f"{b_path}: a token goes on over the beginning of a word")
        if max(map(len, self.a_bytes + self.b_bytes)) > 255:
            raise ValueError("tokens are longer than 255 bytes")
        self.lengths = [np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes)]
        self.plain: dict[str, bool] = {}

    def exact(self, text: str) -> bool:
        """Whether each character's tokens have its bytes, in both."""
        for c in set(text):
            if c not in self.plain:
                self.plain[c] = all(self._same(c, ids[0]) for ids in (self.ids([c]),))
            if not self.plain[c]:
                return False
        return True

    def ids(self, bodies: list[str]) -> list[tuple[list[int], list[int]]]:
        """The ids of a space and each of ``bodies``."""
        return list(zip([e.ids for e in self.a.encode_batch_fast([" " + x for x in bodies], add_special_tokens=False)], self.b.encode(bodies, num_threads=1), strict=True))

    def _same(self, body: str, ids: tuple[list[int], list[int]]) -> bool:
        raw = b" " + body.encode()
        return b"".join(map(self.a_bytes.__getitem__, ids[0])) == raw == b"".join(map(self.b_bytes.__getitem__, ids[1]))

    def tokens(self, bodies: list[str]) -> list[pa.Array]:
        """Of both tokenizers, a list for each of ``bodies``: ids times 256 plus lengths."""
        found = self.ids(bodies)
        if not all(map(self._same, bodies, found)):
            raise ValueError("a tokenizer changes the bytes of a text whose characters it keeps: it normalises sequences")
        out = []
        for side, lengths in enumerate(self.lengths):
            sizes = np.fromiter((len(x[side]) for x in found), np.int32, len(found))
            flat = np.fromiter((k for x in found for k in x[side]), np.int32, int(sizes.sum()))
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat << 8 | lengths[flat], pa.int32())))
        return out


@lru_cache(maxsize=2)
def two(a_path: str, b_path: str) -> Two:
    """One a worker process."""
    return Two(a_path, b_path)


class _Numbers(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _numbered(a_path: str, b_path: str):
    """Documents as sequences of numbers, and the numbered chunks of each block with how often they stand there."""
    kind = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("at", pa.binary()), ("k", pa.int32()), ("chunk", pa.string()), ("n", pa.int64())])

    def rows(block: int, columns: dict) -> pa.RecordBatch:
        n = max(map(len, columns.values()))
        return pa.RecordBatch.from_arrays([pa.array([block] * n, f.type) if f.name == "block" else columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in kind], schema=kind)

    def listed(block: int, numbers: _Numbers, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = list(numbers)
        for a in range(0, len(names), 1 << 16):
            some = names[a : a + (1 << 16)]
            yield rows(block, {"k": pa.array(np.arange(a, a + len(some)), pa.int32()), "chunk": pa.array(some, pa.string()), "n": pa.array(counts[a : a + len(some)], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, pack = two(a_path, b_path), zstandard.ZstdCompressor(level=1).compress
        block = TaskContext.get().partitionId() << 24
        numbers, counts = _Numbers(), np.zeros(1 << 16, np.int64)
        for b in batches:
            at, each = [], []
            for raw in b.column("text").to_pylist():
                text = raw.decode("utf-8", "replace")
                found = chunks(text) if text and tokenizers.exact(text) else []
                ks = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
                each.append(ks)
                at.append(pack(ks.tobytes()))
            if len(counts) < len(numbers):
                counts = np.concatenate([counts, np.zeros(2 * len(numbers) - len(counts), np.int64)])
            met = np.concatenate(each) if each else np.zeros(0, np.int32)
            if len(met):
                sums = np.bincount(met)
                counts[: len(sums)] += sums
            yield rows(block, {"doc_id": b.column("doc_id"), "at": pa.array(at, pa.binary())})
            if len(numbers) >= BLOCK_KINDS:
                yield from listed(block, numbers, counts)
                block, numbers, counts = block + 1, _Numbers(), np.zeros(1 << 16, np.int64)
        yield from listed(block, numbers, counts)
        numbers.clear()
        pa.default_memory_pool().release_unused()

    return run


def _units(a_path: str, b_path: str):
    """Rows come sorted by chunk: one for each chunk, or for each ``PLACES`` of its places, with both lists of tokens."""

    def made(chunk: pa.Array, place: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        size, runs = len(chunk), np.zeros(len(chunk), bool)
        runs[0], runs[1:] = True, pc.not_equal(chunk[1:], chunk[:-1]).to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(runs)
        within = np.arange(size) - np.repeat(heads, np.diff(heads, append=size))
        starts = np.flatnonzero(within % PLACES == 0)
        some = chunk.take(pa.array(starts))
        a, b = two(a_path, b_path).tokens(some.to_pylist())
        places = pa.ListArray.from_arrays(pa.array(np.append(starts, size), pa.int32()), place)
        return pa.RecordBatch.from_arrays([some, pa.array(within[starts] // PLACES, pa.int32()), pa.array(np.add.reduceat(n, starts)), places, a, b], names=["chunk", "part", "n", "places", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last chunk's rows so far
        for t in batches:
            if not t.num_rows:
                continue
            t = t if rest is None else pa.Table.from_batches([rest, t]).combine_chunks().to_batches()[0]
            chunk = t.column("chunk")
            last = pc.equal(chunk, chunk[-1]).to_numpy(zero_copy_only=False)
            cut = len(chunk) - int(last.sum())
            if cut:
                yield made(chunk[:cut], t.column("place")[:cut], t.column("n")[:cut].to_numpy())
            rest = t.slice(cut)
        if rest is not None:
            yield made(rest.column("chunk"), rest.column("place"), rest.column("n").to_numpy())

    return run


@contextmanager
def _clustered_by_less(spark: SparkSession):
    """Joins need no exchange where both sides are bucketed by one of their keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ends(units: DataFrame, key: list[str], tokens: str, prefix: str) -> DataFrame:
    """``key``, end, and the place and id of each token: lengths summed up in a window."""
    each = units.select(*key, F.posexplode(tokens).alias(f"{prefix}_pos", "token"))
    upto = F.sum(F.col("token").bitwiseAND(255)).over(Window.partitionBy(*key).orderBy(f"{prefix}_pos"))
    return each.select(*key, upto.alias("end"), f"{prefix}_pos", F.shiftright("token", 8).alias(prefix))


def cuts(units: DataFrame, key: list[str]) -> DataFrame:
    """A row for each offset where tokens of both end: ``key``, the linked ids ``a`` and ``b``, the number ``g`` of its
    group, and where the group's tokens begin and end in both lists. ``units`` has arrays ``a`` and ``b`` of ids times 256
    plus lengths; ``key`` tells its rows apart."""
    both = ends(units, key, "a", "a").hint("merge").join(ends(units, key, "b", "b").hint("merge"), [*key, "end"])
    w = Window.partitionBy(*key).orderBy("end")
    so_far = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = lambda pos: (F.coalesce(F.lag(pos).over(w), F.lit(-1)) + 1).cast("int")
    return both.select(*key, so_far.cast("int").alias("g"), "a", "b", first("a_pos").alias("a_from"), F.col("a_pos").alias("a_to"), first("b_pos").alias("b_from"), F.col("b_pos").alias("b_to"))


def grouped(units: DataFrame, key: list[str]) -> DataFrame:
    """``units`` without tokens, with n_a, n_b, links (in order) and groups (as text) of each row."""
    found = cuts(units, key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("g", "a", "b", "a_from", "a_to", "b_from", "b_to"))).alias("cuts"))
    ids = lambda tokens, a, b: F.array_join(F.transform(F.slice(tokens, a + 1, b - a + 1), lambda t: F.shiftright(t, 8).cast("string")), ",")
    text = F.transform("cuts", lambda c: F.concat(ids("a", c.a_from, c.a_to), F.lit("|"), ids("b", c.b_from, c.b_to)))
    links = F.transform("cuts", lambda c: F.struct(c.a.alias("a"), c.b.alias("b")))
    rest = [c for c in units.columns if c not in ("a", "b")]
    return units.hint("merge").join(found.hint("merge"), key).select(*rest, F.size("a").alias("n_a"), F.size("b").alias("n_b"), links.alias("links"), F.array_join(text, ";").alias("groups"))


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, how often they are linked, and whether no other a is linked with b more often; at most a row for each token
    of either vocabulary and each of its ends that the other one has."""
    n = staged(found.select(F.explode("links").alias("l"), "n").groupBy("l.a", "l.b").agg(F.sum("n").alias("count")))
    most = n.groupBy("b").agg(F.max("count").alias("most"))
    return staged(n.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("int").alias("best")))


_VALUES = ["n_a", "n_b", "n_groups", "n_best", "count_sum"]


def _lifted(digest: bool):
    """Rows come sorted by block, in it its chunks by number and then its documents. A block's groups stay one Arrow array,
    each with a semicolon behind it: those of a document are taken from it as one run of bytes."""

    def of(values: list[np.ndarray], groups: pa.Array, t: pa.RecordBatch) -> pa.RecordBatch:
        unpack, out = zstandard.ZstdDecompressor().decompress, []
        for packed in t.column("at").to_pylist():
            ks = np.frombuffer(unpack(packed), np.int32)
            text = memoryview(groups.take(pa.array(ks)).buffers()[2])[:-1] if len(ks) else b""
            out.append((*(int(v[ks].sum(dtype=np.int64)) for v in values), hashlib.sha256(text).hexdigest() if digest and len(ks) else bytes(text).decode()))
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([t.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], names=["doc_id", *_VALUES, "groups"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known, chunked = None, None, _Block()
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = np.flatnonzero(np.diff(blocks)) + 1
            for x, y in zip([0, *edges], [*edges, len(blocks)], strict=True):
                t = batch.slice(x, y - x)
                if not len(t):
                    continue
                if blocks[x] != block:
                    block, known, chunked = blocks[x], None, _Block()
                n = len(t) - t.column("k").null_count
                if n:
                    chunked.add(t.slice(0, n))
                if n < len(t):
                    if known is None:
                        known, chunked = chunked.whole(), _Block()
                    yield of(*known, t.slice(n))
        del known, chunked
        pa.default_memory_pool().release_unused()

    return run


class _Block:
    """What the tokens of a block's chunks give, copied out of batches as they come: no batch is held."""

    def __init__(self):
        self.values: list[list[np.ndarray]] = [[] for _ in _VALUES]
        self.sizes: list[np.ndarray] = []
        self.texts: list[bytes] = []

    def add(self, t: pa.RecordBatch) -> None:
        for to, name in zip(self.values, _VALUES, strict=True):
            to.append(t.column(name).to_numpy().copy())
        g = t.column("groups")
        at = np.frombuffer(g.buffers()[1], np.int32)[g.offset : g.offset + len(g) + 1]
        self.sizes.append(np.diff(at))
        self.texts.append(g.buffers()[2][int(at[0]) : int(at[-1])].to_pybytes())

    def whole(self) -> tuple[list[np.ndarray], pa.Array]:
        """All values by number of the chunk, and all groups."""
        values = [np.concatenate(v or [np.zeros(0, np.int64)]) for v in self.values]
        offsets = np.concatenate([[0], *self.sizes]).astype(np.int64).cumsum()
        return values, pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(b"".join(self.texts)))


def _aligned(docs: DataFrame, id_col: str, text_col: str, a_path: str | None, b_path: str | None, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    a_path, b_path = a_path or bpe.public_path(TOKENIZER), b_path or bpe.public_path(PIECES)
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES))
    rows = rows.coalesce(parts)
    numbered = staged(rows.mapInArrow(_numbered(a_path, b_path), "block long, doc_id long, at binary, k int, chunk string, n long"), compression="zstd")
    small_batches(spark, 1 << 14)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = numbered.filter("chunk IS NOT NULL").select("chunk", F.struct("block", "k").alias("place"), "n")
    units = listed.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(_units(a_path, b_path), "chunk string, part int, n long, places array<struct<block:long,k:int>>, a array<int>, b array<int>")
    units, key = bucketed(units, n, "chunk"), ["chunk", "part"]
    with _clustered_by_less(spark):
        found = bucketed(grouped(units, key), n, "chunk")
        pairs = pair_counts(found)
        linked = found.select(*key, F.explode("links").alias("l")).join(F.broadcast(pairs), (F.col("l.a") == F.col("a")) & (F.col("l.b") == F.col("b")))
        sums = linked.groupBy(*key).agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
        whole = found.hint("merge").join(sums.hint("merge"), key).select(F.explode("places").alias("p"), "n_a", "n_b", F.size("links").alias("n_groups"), "n_best", "count_sum", F.concat("groups", F.lit(";")).alias("groups"))
        kind = "block long, k int, doc_id long, at binary, n_a int, n_b int, n_groups int, n_best long, count_sum long, groups string"
        names = [x.split() for x in kind.split(", ")]
        back = whole.selectExpr("p.block", "p.k", *(f"CAST({c if c in whole.columns else 'NULL'} AS {t}) AS {c}" for c, t in names[2:]))
        own = numbered.filter("chunk IS NULL").selectExpr(*(f"CAST({c if c in ('block', 'doc_id', 'at') else 'NULL'} AS {t}) AS {c}" for c, t in names))
        # Blocks go to tasks by their own numbers, one to each: a task's first block to that of its number, a further one elsewhere.
        to = F.shiftright("block", 24) + F.col("block").bitwiseAND((1 << 24) - 1) * 7919
        joined = back.unionByName(own).repartitionById(parts, F.pmod(to, F.lit(parts)).cast("int")).sortWithinPartitions("block", F.asc_nulls_last("k"))
        out = joined.mapInArrow(_lifted(digest), "doc_id long, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups string")
        out = staged(out)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups")


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """For each row of ``docs`` its tokens of both tokenizers, a space put before the text, cut into groups: doc_id, n_a
    and n_b (tokens), n_groups, n_links (token pairs that end together: one ends each group), n_best (links of an id pair
    that is linked as often as any pair with its second id, in all of ``docs``), count_sum (how often the pairs are linked
    in all, added up over links) and groups (``a1,a2|b1;a3|b2,b3``, ids in order).

    A null or empty text, and one with a character that a tokenizer does not keep, has no tokens: zeros, and no groups;
    it counts nowhere. Names of special tokens are text like any other. Repeated rows are rows of their own, a null id
    stays null, no rows give no rows, other columns are ignored. A chunk without spaces is one row of the relations,
    however long. ``a_path`` (byte-level, JSON) and ``b_path`` (sentencepiece) must exist on every executor."""
    return _aligned(docs, id_col, text_col, a_path, b_path, False)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """As :func:`aligned`, with groups_sha256 in place of groups; '' without tokens."""
    return _aligned(docs, id_col, text_col, a_path, b_path, True).withColumnRenamed("groups", "groups_sha256")
