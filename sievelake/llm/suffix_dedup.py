"""Dedup of long byte strings by suffix arrays.

Strings of ``width`` bytes are dealt by their anchors: the smallest hash of the ``GRAM``-byte grams in a string. Equal
strings have equal anchors, so they meet. Neighbouring strings of a text mostly share an anchor; such a run of
strings is one piece of text, its context. A first pass deals a pair of hashes for each run. Where an anchor's
contexts are all alike by their hashes, two copies are compared; copies that lie side by side in two documents go
to one shard, as one long context. Where an anchor has different contexts, one copy at least of each is compared with the
others. An anchor with more than ``KINDS`` contexts, as a passage of many near copies has, is split: a second pass
deals its strings by their own hashes, so that no task gathers them, and of each string that occurs again two copies
are compared. Anchors that have a great many contexts in a sample of documents are split from the start, so no task
gathers their runs either. Suffix arrays find which strings are equal, byte by byte; only third and further copies of a context or
a string are covered by its hashes alone:

* the suffixes of a shard are sorted by Larsson-Sadakane refinement: by their first 5 bytes, then the groups still
  unsorted by the ranks 5, 10, 20, ... bytes on;
* Kasai's scan gives the common prefix of each suffix and the one before it, in step over all parts of contexts;
* where the contexts that are to be compared fill several shards, the suffixes of one find each other's by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RollingHash, among, arrow_rows, aside, frequent, mixed, sampled, small_batches, spans, staged, text_bytes
from .substring_dedup import RUNS, anchors, runs

WIDTH, GRAM = 200, 64
#: Contexts of an anchor that are compared whole; of more, strings are dealt one by one.
KINDS = 4
#: Bytes that are hashed at once, that a shard's suffix array has (about, and never near 2^21), and that a partition is
#: meant to have.
CHUNK, SHARD, PARTITION = 1 << 20, 1 << 19, 4 << 20
#: Runs that a task holds before it groups them, strings that are put together as one context (about, at most), and
#: those of them that are walked in one go.
HELD, CONTEXT, LANE = 1_000_000, 1 << 16, 256

#: Bits of the place of a gram in the bytes at hand, and so the longest piece of text hashed at once.
_PLACE = np.uint64((1 << 24) - 1)
LONGEST = 1 << 23

_BYTE = np.random.default_rng(200).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROLL, _OTHER = RollingHash(0x9E3779B97F4A7C15), RollingHash(0xD1342543DE82EF95)


def chunks(texts: list[bytes]) -> Iterator[list[int]]:
    """Places of texts, about ``CHUNK`` bytes at a time."""
    held, size = [], 0
    for k, t in enumerate(texts):
        held.append(k)
        size += len(t)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def text_runs(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """For each run of strings of one text that have their anchor at one place: the text's place, the first
    string's place, the number of strings, the anchor and a hash of the context. Two equal strings are never in
    one run, as their anchors lie at the same distance from their beginnings. For ``LONGEST`` bytes at most."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends, n = np.cumsum(sizes), len(data)
    if n < width:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    gram = min(GRAM, width)
    grams = _ROLL.windows(_BYTE[data], gram)
    # The smallest by its upper bits, the leftmost of equal ones: always one place.
    at = anchors(grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64), width - gram + 1) & _PLACE
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    inside = doc[: n - width + 1] == doc[width - 1 :]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (at[1:] != at[:-1]) | (doc[1 : n - width + 1] != doc[: n - width])
    first = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]])) + 1
    d = doc[first].astype(np.int64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(_BYTE)[data] * _ROLL._down[:n], out=sums[1:])
    last = stop - 1 + width
    context = mixed((sums[last] - sums[first]) * _ROLL._up[first] + (last - first).astype(np.uint64))
    return d, first - (ends - sizes)[d], stop - first, grams[at[first].astype(np.int64)], context


#: Runs dealt by key, at most two of a context from each task, or with an odd negative bucket, covered ones, or with an even
#: one, ones whose key is split: document, place, number, key and context (two hashes), shard.
PARTS = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("doc", "start", "n", "key", "context", "shard"))])
_TYPES = {"doc": np.int64, "start": np.int64, "n": np.int64, "key": np.uint64, "context": np.uint64, "shard": np.int64}
_PARTS = "bucket int, doc binary, start binary, n binary, key binary, context binary, shard binary"
#: shard: where the run's context is compared; -1 - shard: its strings are dealt one by one; null: the run is covered.
VERDICTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("shard", pa.int64())])
_VERDICTS = "doc_id long, start long, n long, shard long"


def _copy(new: np.ndarray) -> np.ndarray:
    """The number of each row in its group, from 0; ``new``: where groups begin."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _grouped(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows (as in ``_TYPES``) with equal ones together, by document and place, and where keys and contexts begin."""
    doc, start, _, key, context, _ = columns
    order = np.lexsort((start, doc, context, key))
    key, context = key[order], context[order]
    anew = np.concatenate([[True], key[1:] != key[:-1]])
    return [x[order] for x in columns], anew, anew | np.concatenate([[True], context[1:] != context[:-1]])


def _packed(held: list[tuple], buckets: int, hot: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The runs of a task by bucket; of each context the third and further copies as covered. ``hot``: keys that are split."""
    columns, _, new = _grouped([np.concatenate(x) for x in zip(*held, strict=True)])
    pair, none = _copy(new) < 2, np.zeros(0)
    doc, start, n, *_ = columns
    yield pa.RecordBatch.from_arrays([pa.array([aside(1, 2)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (doc[~pair], start[~pair], n[~pair], none, none, none))], schema=PARTS)
    columns = [x[pair] for x in columns]
    if hot is not None and (split := among(columns[3], hot)).any():
        doc, start, n, _, _, shard = (x[split] for x in columns)
        yield pa.RecordBatch.from_arrays([pa.array([aside(2, 2)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (doc, start, n, none, none, -1 - shard))], schema=PARTS)
        columns = [x[~split] for x in columns]
        if split.all():
            return
    bucket = (mixed(columns[3]) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    yield pa.RecordBatch.from_arrays([pa.array(bucket[np.concatenate([[0], cut])]), *(pa.array([y.tobytes() for y in np.split(x[order], cut)], pa.binary()) for x in columns)], schema=PARTS)


def _all_runs(whole: list[bytes], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """:func:`text_runs` of texts of any length, some of them at a time. Very long ones are taken in parts that overlap by all but
    one byte of a string."""
    cuts = [(k, a) for k, t in enumerate(whole) for a in range(0, max(1, len(t) - width + 1), LONGEST)]
    texts = [whole[k][a : a + LONGEST + width - 1] if len(whole[k]) > LONGEST else whole[k] for k, a in cuts]
    of, shift = np.array([k for k, _ in cuts], np.int64), np.array([a for _, a in cuts], np.int64)
    for places in chunks(texts):
        d, start, n, anchor, context = text_runs([texts[k] for k in places], width)
        if len(d):
            d = np.array(places)[d]
            yield of[d], start + shift[d], n, anchor, context


def _anchored(width: int):
    """Anchor and context of all runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *_, anchor, context in _all_runs(b.column("text").to_pylist(), width):
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64))], names=["key", "context"])

    return run


def _dealt(width: int, buckets: int, shards: int, hot=None):
    """All runs, by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            ids = np.array(b.column("doc_id"), np.int64)
            for d, start, n, anchor, context in _all_runs(b.column("text").to_pylist(), width):
                held.append((ids[d], start, n, anchor, context, (mixed(anchor ^ np.uint64(0x5DEECE66D)) % np.uint64(shards)).astype(np.int64)))
                size += len(d)
                if size > HELD:
                    yield from _packed(held, buckets, hot and hot.value)
                    held, size = [], 0
        if size:
            yield from _packed(held, buckets, hot and hot.value)

    return run


def _strings(width: int, buckets: int):
    """The strings of contexts, each a run of its own, by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i, start, shard, context in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "shard", "context")), strict=True):
                data = np.frombuffer(context, np.uint8)
                n = len(data) - width + 1
                held.append((np.full(n, i), np.arange(start, start + n), np.ones(n, np.int64), _ROLL.windows(_BYTE[data], width), _OTHER.windows(mixed(_BYTE)[data], width), np.full(n, -1 - shard)))
                size += n
                if size > HELD:
                    yield from _packed(held, buckets)
                    held, size = [], 0
        if size:
            yield from _packed(held, buckets)

    return run


def _judged(shards: int, most: int | None = None):
    """Which runs are covered as further copies, whose contexts must be compared, and with ``most`` whose strings are
    dealt one by one: those of a key with more contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            for r in batch.to_pylist():
                got = [np.frombuffer(r[c], t) for c, t in _TYPES.items()]
                if r["bucket"] < 0:
                    yield from arrow_rows({"doc_id": got[0], "start": got[1], "n": got[2], "shard": got[5] if r["bucket"] % 2 == 0 else [None] * len(got[0])}, VERDICTS)
                else:
                    held.append(got)
        if not held:
            return
        (doc, start, n, _, _, shard), anew, new = _grouped([np.concatenate(x) for x in zip(*held, strict=True)])
        of, group = np.cumsum(new) - 1, np.cumsum(anew) - 1
        many, copy = np.bincount(of) > 1, _copy(new)
        kinds = np.bincount(group[new])[group]
        hot = kinds > most if most else np.zeros(len(doc), bool)
        done, ask = copy > 1, (copy < 2) & (many[of] | (kinds > 1))
        # Copies that are only compared with each other: by their documents, and how far apart they lie in them.
        first = np.flatnonzero(new)[many & (kinds[new] == 1)]
        side = mixed(doc[first].astype(np.uint64) ^ mixed(doc[first + 1].astype(np.uint64) + np.uint64(1)) ^ mixed((start[first + 1] - start[first]).astype(np.uint64)))
        shard[first] = shard[first + 1] = (side % np.uint64(shards)).astype(np.int64)
        yield from arrow_rows({"doc_id": doc[done], "start": start[done], "n": n[done], "shard": [None] * int(done.sum())}, VERDICTS)
        yield from arrow_rows({"doc_id": doc[ask], "start": start[ask], "n": n[ask], "shard": np.where(hot, -1 - shard, shard)[ask]}, VERDICTS)

    return run


def _contexts(width: int):
    """The contexts asked for, out of a document (``base`` 0) or a part of one from byte ``base`` on. Runs next to each other
    that go to one shard are one context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, text, base, asked in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "base", "asked")), strict=True):
                runs_: list[list[int]] = []
                for shard, start, n in sorted((a["shard"], a["start"] - base, a["n"]) for a in asked):
                    if runs_ and runs_[-1][0] == shard and runs_[-1][1] + runs_[-1][2] == start and runs_[-1][2] < CONTEXT:
                        runs_[-1][2] += n
                    elif 0 <= start <= len(text) - width:
                        runs_.append([shard, start, n])
                out += [(shard, i, base + start, text[start : start + n + width - 1]) for shard, start, n in runs_]
            for a in range(0, len(out), 1024):
                part = out[a : a + 1024]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["shard", "doc_id", "start", "context"])

    return run


class Shard:
    """The suffix array of contexts laid end to end. Only suffixes that begin a string of ``width`` bytes within
    their context are listed."""

    def __init__(self, contexts: list[bytes], width: int):
        self.width, self.sizes = width, np.fromiter(map(len, contexts), np.int64, len(contexts))
        data = np.frombuffer(b"".join(contexts) + bytes(width + 8), np.uint8)
        self.n = n = len(data) - width - 8
        self.words = np.zeros(n + width, np.uint64)
        for k in range(8):
            self.words = self.words << np.uint64(8) | data[k : k + n + width]
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.counts = np.maximum(self.sizes - width + 1, 0)
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, self.begins, self.counts > 0)
        np.add.at(step, (self.begins + self.counts), -(self.counts > 0).astype(np.int64))
        self.valid = np.cumsum(step[:n]) > 0
        order = self.sorted()
        self.order = order[self.valid[order]]

    def sorted(self) -> np.ndarray:
        """All suffixes, by their first ``width`` bytes at least. Keys hold the place of their suffix, 21 bits of it, so
        that values are sorted and not places."""
        n, place = self.n, np.int64((1 << 21) - 1)
        if n > place:
            raise ValueError("a shard is too long")
        keys = np.sort((self.words[:n] >> np.uint64(24)).astype(np.int64) << 21 | np.arange(n))
        order, first = keys & place, keys >> 21
        start = np.concatenate([[True], first[1:] != first[:-1]])
        rank = np.zeros(n + self.width + 8, np.int64)  # of the group: its first place in the order, from 1
        rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0)) + 1
        depth = 5
        while depth < self.width:
            bound = np.concatenate([start, [True]])
            at = np.flatnonzero(~(bound[:-1] & bound[1:]))  # in groups of two or more
            if not len(at):
                break
            suffix = order[at]
            # The empty suffix ranks first.
            keys = np.sort(rank[suffix] << 42 | rank[np.minimum(suffix + depth, n)] << 21 | np.arange(len(at)))
            suffix, keys = suffix[keys & place], keys >> 21
            order[at] = suffix
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            start[at] = new
            rank[suffix] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] + 1
            depth *= 2
        return order

    def extended(self, a: np.ndarray, b: np.ndarray, known: np.ndarray, other: Shard | None = None) -> np.ndarray:
        """The common prefixes of suffixes ``a`` and ``b`` (of ``other``), at most ``width``; ``known`` of them are
        known to be common."""
        out, words, width = known.copy(), (other or self).words, self.width
        at = np.flatnonzero(out < width)
        while len(at):
            x = self.words[a[at] + out[at]] ^ words[b[at] + out[at]]
            same = x == 0
            rest = at[~same]
            x = x[~same]
            # Zero bytes at the top, by the exponent; with the bit after the first one off no number is rounded up.
            out[rest] += 64 - np.frexp((x & ~(x >> np.uint64(1))).astype(np.float64))[1].astype(np.int64) >> 3
            at = at[same]
            out[at] += 8
            at = at[out[at] < width]
        return np.minimum(out, width)

    def common(self) -> np.ndarray:
        """Kasai's scan: for each suffix listed the common prefix with the one listed before it. A text is walked
        from left to right, and what is common shrinks by one at most; all contexts go in step, ``LANE`` places of them
        at a time."""
        before = np.full(self.n + 1, -1, np.int64)
        before[self.order[1:]] = self.order[:-1]
        place = np.zeros(self.n + 1, np.int64)
        place[self.order] = np.arange(len(self.order))
        out = np.zeros(self.n + 1, np.int64)
        parts = -(-self.counts // LANE)
        skip = LANE * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
        begins, counts = np.repeat(self.begins, parts) + skip, np.minimum(np.repeat(self.counts, parts) - skip, LANE)
        lanes = np.argsort(-counts, kind="stable")
        begins, counts = begins[lanes], counts[lanes][::-1]
        known, last = np.zeros(len(lanes), np.int64), np.full(len(lanes), -1, np.int64)
        valid = np.concatenate([self.valid, [False]])
        for k in range(int(counts[-1]) if len(counts) else 0):
            m = len(counts) - int(np.searchsorted(counts, k, side="right"))
            i = begins[:m] + k
            j = before[i]
            # The suffix after the last one's neighbour bounds what is common, if it is listed and comes before this
            # one: suffixes that agree as far as they are sorted may stand either way.
            after = np.minimum(last[:m] + 1, self.n)
            l1 = np.where((last[:m] >= 0) & valid[after] & (place[after] < place[i]), np.maximum(known[:m] - 1, 0), 0)
            some = np.flatnonzero(j >= 0)
            l1[some] = self.extended(i[some], j[some], l1[some])
            if len(some) < m:
                l1[j < 0] = 0
            out[i], known[:m], last[:m] = l1, l1, j
        return out[self.order]

    def found(self, other: Shard, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each suffix listed here, and each listed in ``other``, has an equal string in the other shard, by
        binary search for each different string that occurs in the first ``upto`` bytes here."""
        mine, theirs = np.zeros(len(self.order), bool), np.zeros(len(other.order), bool)
        starts = np.flatnonzero(self.prefix < self.width)
        heads = starts[np.logical_or.reduceat(self.order < upto, starts)] if len(starts) else starts
        if not len(heads) or not len(other.order):
            return mine, theirs
        a = self.order[heads]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), len(other.order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            b = other.order[mid]
            same = self.extended(a[open_], b, np.zeros(len(open_), np.int64), other)
            less = np.zeros(len(open_), bool)
            diff = np.flatnonzero(same < self.width)
            less[diff] = other.words[b[diff] + same[diff]] >> np.uint64(56) < self.words[a[open_][diff] + same[diff]] >> np.uint64(56)
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        inside = np.flatnonzero(low < len(other.order))
        hit = inside[self.extended(a[inside], other.order[low[inside]], np.zeros(len(inside), np.int64), other) >= self.width]
        mine[heads[hit]] = True
        mine = mine[starts[np.cumsum(self.prefix < self.width) - 1]]
        theirs[low[hit]] = True  # the first of its group of equal strings
        group = np.cumsum(other.prefix < other.width) - 1
        return mine, np.bincount(group, weights=theirs, minlength=int(group[-1]) + 1).astype(bool)[group]

    def repeated(self) -> np.ndarray:
        """Whether each suffix listed has an equal one in this shard."""
        self.prefix = self.common()
        same = self.prefix >= self.width
        return same | np.concatenate([same[1:], [False]])


def _compared(width: int):
    """Runs of strings that have an equal one among the contexts. Contexts of one anchor have one number and lie next to
    each other, so only shards with a number in common are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, docs, starts, texts = [], [], [], []
        for b in batches:
            for held, c in ((of, "shard"), (docs, "doc_id"), (starts, "start"), (texts, "context")):
                held += b.column(c).to_pylist()
        number, doc, start = (np.array(x, np.int64) for x in (of, docs, starts))
        order = np.argsort(number, kind="stable")
        open_: list[list] = []  # first context, shard, flags: those that the next shard may have a number in common with

        def flushed() -> Iterator[pa.RecordBatch]:
            for contexts, shard, flag in open_:
                at = np.sort(shard.order[flag])
                lane = np.searchsorted(shard.begins, at, side="right") - 1
                d, first, n = runs(doc[contexts[lane]], start[contexts[lane]] + at - shard.begins[lane])
                yield from arrow_rows({"doc_id": d, "start": first, "n": n}, RUNS)
            open_.clear()

        a = size = 0
        for k, c in enumerate(order.tolist()):
            size += len(texts[c])
            if size < SHARD and k < len(order) - 1:
                continue
            contexts = order[a : k + 1]
            a, size = k + 1, 0
            if open_ and number[open_[-1][0][-1]] != number[contexts[0]]:
                yield from flushed()
            shard = Shard([texts[x] for x in contexts], width)
            flag = shard.repeated()
            shared = int(shard.sizes[number[contexts] == number[contexts[0]]].sum())
            for one in open_:
                mine, theirs = shard.found(one[1], shared)
                flag |= mine
                one[2] |= theirs
            if open_ and number[contexts[-1]] != number[contexts[0]]:
                yield from flushed()
            open_.append([contexts, shard, flag])
        yield from flushed()

    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, start, n: runs of ``n`` strings of ``width`` bytes from byte ``start`` on, each of which begins at
    another place too, in the same document or in another. Ids must be unique; rows without one take no part."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text")).filter("doc_id IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, shards = max(least, size // (32 << 20)), max(4 * least, size // (1 << 16))

    def contexts(of: DataFrame, texts: DataFrame, *on: str) -> DataFrame:
        asked = of.groupBy(*on).agg(F.collect_list(F.struct("shard", "start", "n")).alias("asked"))
        return texts.join(asked, list(on)).select("doc_id", "text", "base", "asked").mapInArrow(_contexts(width), "shard long, doc_id long, start long, context binary")

    # Different contexts: of copies alike by their hashes any number may meet.
    some = sampled(rows).select("text").mapInArrow(_anchored(width), "key long, context long").distinct()
    hot = spark.sparkContext.broadcast(frequent(some, F.count(F.lit(1))))
    dealt = rows.mapInArrow(_dealt(width, 4 * parts, shards, hot), _PARTS).repartition(parts, "bucket")
    verdicts = staged(dealt.mapInArrow(_judged(shards, KINDS), _VERDICTS))
    whole = staged(contexts(verdicts.filter("shard IS NOT NULL"), rows.withColumn("base", F.lit(0).cast("bigint")), "doc_id"))
    split = whole.filter("shard < 0")
    strings = split.mapInArrow(_strings(width, 4 * parts), _PARTS).repartition(parts, "bucket")
    single = staged(strings.mapInArrow(_judged(shards), _VERDICTS))
    # A string lies in the last part of its document that begins at it or before it.
    begin = split.select("doc_id", "start", F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("shard"), F.col("start").alias("base"))
    single_asked = single.filter("shard IS NOT NULL").select("doc_id", "start", "n", "shard", F.lit(None).cast("bigint").alias("base"))
    upto = Window.partitionBy("doc_id").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, 0)
    of_part = begin.unionByName(single_asked).withColumn("base", F.last("base", ignorenulls=True).over(upto)).filter("n > 0")
    again = contexts(of_part, split.select("doc_id", F.col("start").alias("base"), F.col("context").alias("text")), "doc_id", "base")
    compare = staged(whole.filter("shard >= 0").unionByName(again))
    volume = compare.agg(F.sum(F.octet_length("context"))).first()[0] or 0
    compared = compare.repartition(max(least, volume // PARTITION), "shard").mapInArrow(_compared(width), "doc_id long, start long, n long")
    covered = verdicts.unionByName(single).filter("shard IS NULL").drop("shard")
    return covered.unionByName(compared)


def _removed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, found in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                n, gone, parts = len(text), 0, 0
                if found:
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, np.array([r["start"] for r in found]), 1)
                    np.add.at(step, np.minimum([r["start"] + r["n"] + width - 1 for r in found], n), -1)
                    mask = np.cumsum(step[:n]) > 0
                    gone, parts = int(mask.sum()), len(spans(mask)[0])
                    text = np.frombuffer(text, np.uint8)[~mask].tobytes()
                rows.append((n, gone, parts, text, hashlib.sha256(text).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (removed runs of bytes), kept (the bytes that stay) and kept_sha256 for
    each row of ``docs``: each byte covered by a ``width``-byte string that also begins anywhere else is removed,
    all copies alike; strings are judged on the input and never cross texts.

    A null text is empty. Texts shorter than ``width`` stay whole. Rows that repeat an id repeat each other's
    strings, as other rows do; rows without an id stay whole and take no part. Extra columns are ignored."""
    found = repeats(docs, id_col, text_col, width).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))
    return rows.join(found, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(_removed(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
