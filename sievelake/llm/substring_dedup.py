"""Substring dedup over windows of words, behind a count-min prefilter.

A window of ``width`` words is represented in the sketch by its anchor: the smallest hash of the ``GRAM``-word
grams in it. Equal windows have equal anchors, so the number of documents with an anchor is at least that of
each of its windows, and a sketch of anchors, a sixteenth of the windows, overestimates window counts too. Each
partition makes a count-min sketch of its documents' anchors, held as the counters that aren't zero; sketches
are merged block by block, and all that is kept of a counter is whether it reached two. Its size follows the
input up to ``MOST_BITS`` a row, so the broadcast has a fixed bound; beyond that more windows pass, and none is
lost at any size.

The second pass groups the windows estimated repeated, by 128-bit hashes, exactly. A task first groups its own,
so each different window leaves it once, with its smallest document. Windows are dealt by their anchor and where
it lies in them, ``PLACES`` places together: that keeps neighbours of a passage together, so that covered windows come
back to their documents as runs. Anchors that a sample of documents shows to be frequent have windows in a great many
documents, most of which differ: these are dealt by their own hashes, so that no task gathers an anchor's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, among, arrow_rows, aside, covered, frequent, mixed, sampled, small_batches, text_bytes

WIDTH = 50
#: Rows of the sketch, bits of a block, and the least and most bits of a row.
DEPTH, BLOCK_BITS, LEAST_BITS, MOST_BITS = 2, 20, 16, 29
#: Windows that one partition of the second pass is meant to group, and that a task holds before it groups them.
WINDOWS_EACH, HELD = 2_000_000, 1_500_000

#: Bits of the place of a gram among the words at hand.
_PLACE = np.uint64((1 << 32) - 1)
#: Windows of an anchor that isn't frequent are dealt by where it lies in them, so many places together.
PLACES = 8

_FIRST, _SECOND, _GRAMS = RollingHash(0x9E3779B97F4A7C15), RollingHash(0xD1342543DE82EF95), RollingHash(0xAF251AF3B0F025B5)


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each ``span`` consecutive values."""
    out, done = grams, 1
    while done < span:
        step = min(done, span - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


class Windows:
    """The windows of a batch of texts: for each its document's place in the batch, its first word, its anchor and where
    that lies in it, which is the same in equal windows."""

    def __init__(self, texts: list[bytes], width: int):
        words = [t.split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        self.values = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, n)
        self.width, gram = width, max(1, width * 2 // 5)
        self.doc = self.first = np.zeros(0, np.int64)
        self.at, self.anchor, self.offset = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n < width:
            return
        doc = np.repeat(np.arange(len(words)), sizes)[: n - width + 1]
        self.at = np.flatnonzero(np.arange(width, n + 1) <= ends[doc])
        self.doc = doc[self.at]
        self.first = self.at - (ends - sizes)[self.doc]
        grams = _GRAMS.windows(self.values, gram)
        # The smallest by its upper bits, the leftmost of equal ones: always one place.
        at = (anchors(grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64), width - gram + 1) & _PLACE).astype(np.int64)[self.at]
        self.anchor, self.offset = grams[at], at - self.at

    def hashes(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each of the windows kept."""
        at = self.at[keep]
        return _FIRST.windows(self.values, self.width)[at], _SECOND.windows(mixed(self.values + np.uint64(7)), self.width)[at]


def slots(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mixed(anchor ^ np.uint64(0x51ED270B7F4A7C15 * (row + 1) % 2**64)) >> np.uint64(64 - bits)


def _sketched(width: int, bits: int):
    """(row, block, counters): what a partition adds to each block; a counter is its place, with the top bit set
    if the partition alone brings it to two."""
    in_block = min(bits, BLOCK_BITS)

    def flush(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a = np.concatenate(found)
        for row in range(DEPTH):
            s, n = np.unique(slots(a, row, bits), return_counts=True)
            block = s >> np.uint64(in_block)
            code = (s & np.uint64((1 << in_block) - 1)).astype(np.uint32) | np.where(n > 1, np.uint32(1 << 31), np.uint32(0))
            cut = np.flatnonzero(np.diff(block)) + 1
            ids = block[np.concatenate([[0], cut])].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([(row << 32) + int(b) for b in ids], pa.int64()), pa.array([x.tobytes() for x in np.split(code, cut)], pa.binary())], names=["block", "counters"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for b in batches:
            w = Windows(b.column("text").to_pylist(), width)
            if len(w.at):
                new = np.concatenate([[True], (w.anchor[1:] != w.anchor[:-1]) | (w.doc[1:] != w.doc[:-1])])
                a, d = w.anchor[new], w.doc[new]
                order = np.lexsort((a, d))
                a, d = a[order], d[order]
                a = a[np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])])]  # once a document
                found.append(a)
                held += len(a)
            if held > HELD:
                yield from flush(found)
                found, held = [], 0
        if held:
            yield from flush(found)

    return run


def _merged(bits: int):
    size = 1 << min(bits, BLOCK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            for block, raw in zip(b.column("block").to_pylist(), b.column("counters").to_pylist(), strict=True):
                counts = blocks.setdefault(block, np.zeros(size, np.uint8))
                code = np.frombuffer(raw, np.uint32)
                at = code & np.uint32((1 << 31) - 1)  # no place comes twice in one row
                counts[at] = np.minimum(counts[at] + 1 + (code >> 31).astype(np.uint8), 2)
        for block, counts in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())], names=["block", "repeated"])

    return run


class Sketch:
    """For each row of the sketch one bit a counter: whether it reached two."""

    def __init__(self, bits: int, found: list[tuple[int, bytes]]):
        self.bits, in_block = bits, min(bits, BLOCK_BITS)
        self.rows = np.zeros((DEPTH, max(1, (1 << bits) // 8)), np.uint8)
        for block, raw in found:
            at = (block & 0xFFFFFFFF) << in_block >> 3
            self.rows[block >> 32, at : at + len(raw)] = np.frombuffer(raw, np.uint8)

    def repeated(self, anchor: np.ndarray) -> np.ndarray:
        """Whether each anchor's count is estimated at two or more."""
        out = np.ones(len(anchor), bool)
        for row in range(DEPTH):
            s = slots(anchor, row, self.bits)
            out &= (self.rows[row][(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def sketch(rows: DataFrame, width: int, bits: int) -> Sketch:
    """The merged sketch of all partitions of ``rows`` (text: binary)."""
    parts = rows.select("text").mapInArrow(_sketched(width, bits), "block long, counters binary")
    blocks = DEPTH * max(1, (1 << bits) >> BLOCK_BITS)
    got = parts.repartition(min(blocks, 512), "block").mapInArrow(_merged(bits), "block long, repeated binary").collect()
    return Sketch(bits, [(r.block, r.repeated) for r in got])


def runs(doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive places in a document: document, first place, number of places."""
    if not len(doc):
        return doc, first, first
    order = np.lexsort((first, doc))
    doc, first = doc[order], first[order]
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + 1)]))
    return doc[cut], first[cut], np.diff(np.concatenate([cut, [len(doc)]]))


#: Packed in ``keys``: anchor-dealt windows as two hashes, document and place; or with a negative bucket, covered runs.
PARTS = pa.schema([("bucket", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("doc", pa.binary()), ("place", pa.binary())])
RUNS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])


def _by_window(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal windows together, smallest document first, and for each in that order whether it
    has a smaller document before it."""
    order = np.lexsort((doc, b, a))
    a, b, doc = a[order], b[order], doc[order]
    start = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return order, doc > doc[np.maximum.accumulate(np.where(start, np.arange(len(doc)), 0))]


def _anchored(width: int):
    """The anchors of each document, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = Windows(b.column("text").to_pylist(), width)
            if len(w.at):
                both = np.unique(np.stack([w.doc.astype(np.uint64), w.anchor]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[1].view(np.int64))], names=["key"])

    return run


def _windows(width: int, sent, hot, buckets: int):
    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        a, b, doc, place, bucket = map(np.concatenate, zip(*held, strict=True))
        order, late = _by_window(a, b, doc)
        d, s, n = runs(doc[order][late], place[order][late])
        yield pa.RecordBatch.from_arrays([pa.array([aside()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (n, np.zeros(0), d, s))], schema=PARTS)
        order = order[~late]
        order = order[np.lexsort((place[order], doc[order], bucket[order]))]
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        if len(order):
            ids = bucket[order][np.concatenate([[0], cut])]
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), *(pa.array([y.tobytes() for y in np.split(x[order], cut)], pa.binary()) for x in (a, b, doc, place.astype(np.int32)))], schema=PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, often, held, n = sent.value, hot.value, [], 0
        for batch in batches:
            w = Windows(batch.column("text").to_pylist(), width)
            keep = np.flatnonzero(seen.repeated(w.anchor)) if len(w.at) else []
            if len(keep):
                ids = np.array(batch.column("doc_id"), np.int64)
                one, two = w.hashes(keep)
                key = np.where(among(w.anchor[keep], often), one, w.anchor[keep] + (w.offset[keep] // PLACES).astype(np.uint64))
                held.append((one, two, ids[w.doc[keep]], w.first[keep], (mixed(key) % np.uint64(buckets)).astype(np.int32)))
                n += len(keep)
            if n > HELD:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {f.name: [] for f in PARTS if f.name != "bucket"}
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] < 0:
                d, s, n = (np.frombuffer(r[c], np.int64) for c in ("doc", "place", "first"))
                yield from arrow_rows({"doc_id": d, "start": s, "n": n}, RUNS)
            else:
                for c, kind in (("first", np.uint64), ("second", np.uint64), ("doc", np.int64), ("place", np.int32)):
                    held[c].append(np.frombuffer(r[c], kind))
    if held["first"]:
        a, b, doc, place = (np.concatenate(held.pop(c)) for c in ("first", "second", "doc", "place"))
        order, late = _by_window(a, b, doc)
        d, s, n = runs(doc[order][late], place[order][late].astype(np.int64))
        yield from arrow_rows({"doc_id": d, "start": s, "n": n}, RUNS)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, start, n: runs of ``n`` windows that begin at consecutive words of a document from ``start`` on,
    each of which also begins in a document with a smaller id. Rows without an id take no part."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text")).filter("doc_id IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // 24).bit_length()))
    sent = spark.sparkContext.broadcast(sketch(rows, width, bits))
    hot = spark.sparkContext.broadcast(frequent(sampled(rows).select("text").mapInArrow(_anchored(width), "key long"), F.count(F.lit(1))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 6 // WINDOWS_EACH)
    return rows.mapInArrow(_windows(width, sent, hot, 4 * parts), "bucket int, first binary, second binary, doc binary, place binary").repartition(parts, "bucket").mapInArrow(_grouped, "doc_id long, start long, n long")


def _removed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, found in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                words, gone = text.split(), 0
                n = len(words)
                if found:
                    starts = np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in found])
                    mask = covered(starts, width, n)
                    gone = int(mask.sum())
                    words = [words[k] for k in np.flatnonzero(~mask)]
                rows.append((n, gone, b" ".join(words)))
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space, UTF-8) and kept_sha256 for each
    row of ``docs``: each word covered by a window of ``width`` words that also begins in a document with a
    smaller id is removed; windows are judged on the input.

    Words end at space, tab, line feed, vertical tab, form feed and carriage return. A null text has no words.
    Documents with fewer words than a window stay whole. Rows that repeat an id don't remove each other's words;
    rows without an id stay whole and remove nothing. Extra columns are ignored."""
    found = repeats(docs, id_col, text_col, width).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))
    return rows.join(found, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(_removed(width), "doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string")
