"""Near-dedup by fast similarity sketching, banding and exact verification.

A sketch has ``COORDS`` coordinates. In round r each shingle falls into a random one of them with a random
value r + [0, 1), and a coordinate keeps its smallest value; rounds go on until every coordinate has one, and
the last ``COORDS`` rounds each fill one coordinate outright, so all are filled after twice as many rounds. As
shingles are placed like balls into bins, long texts need about one round, and the share of equal coordinates
of two sketches is concentrated at least as well as with independent MinHash values.

Sketches are cut into bands; documents that agree in a band are candidates, and only the exact similarity of
their full sets makes a link. Documents with the same set are one node from the start. Within a band's bucket
nodes are first held against the smallest one. What is then already connected needs no further test. All other
candidates are compared in blocks of bounded size, two blocks at a time, by a product of incidence matrices, so
that no candidate is lost and no row is made for a pair that isn't a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, free, mapped, mixed, partitions_for, small_batches, staged, text_bytes
from .graph import components

#: Bands of ``ROWS`` coordinates. At similarity 0.8 a pair has no band in common with probability 3e-6.
BANDS, ROWS = 24, 4
#: Documents of a block, of which two at a time are compared as a whole.
BLOCK = 128
#: Documents, as often as they are compared in blocks, that a partition is meant to have.
MET_EACH = 20_000
COORDS = BANDS * ROWS
_VALUE = np.uint64((1 << 40) - 1)
_SHINGLE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the ``width``-word shingles of a text, A-Z lower-cased; of the whole
    sequence if it is shorter; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    w = min(width, len(words))
    total = np.full(len(words) - w + 1, w, np.uint64)
    for k in range(w):
        total += mixed(h[k : len(h) - w + 1 + k] * _SHINGLE[k % 8] + np.uint64(k))
    return np.unique(mixed(total))


def sketch(items: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """The fast similarity sketch of a set of 64-bit hashes that isn't empty."""
    out = np.full(coords, np.iinfo(np.uint64).max, np.uint64)
    done, each = 0, max(1, 1024 // len(items))
    while done < coords:
        rounds = np.arange(done, min(coords, done + each), dtype=np.uint64)[:, None]
        h = mixed(items[None, :] ^ mixed(rounds + np.uint64(1)))
        np.minimum.at(out, (((h >> np.uint64(40)) * np.uint64(coords)) >> np.uint64(24)).ravel().astype(np.int64), (rounds << np.uint64(40) | h & _VALUE).ravel())
        done += len(rounds)
        if out.max() < np.iinfo(np.uint64).max:
            return out
    for c in np.flatnonzero(out == np.iinfo(np.uint64).max):
        r = np.uint64(coords + c)
        out[c] = r << np.uint64(40) | (mixed(items ^ mixed(np.array([r + np.uint64(1)]))) & _VALUE).min()
    return out


def bands(s: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band; bands have different keys for equal values."""
    s = s.reshape(-1, rows)
    key = np.arange(1, len(s) + 1, dtype=np.uint64)
    for k in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + s[:, k])
    return key.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least ``percent`` hundredths, exactly."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _mark(items: np.ndarray) -> bytes:
    """Of a whole set: equal sets have equal ones."""
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _sketched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, marks, keys = [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t, width)
                sizes.append(len(s))
                marks.append(_mark(s))
                keys.append(bands(sketch(s)) if len(s) else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "mark", "keys"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(list(map(_mark, found)), pa.binary())], names=["id", "items", "mark"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column("left").to_pylist(), b.column("right").to_pylist()
            keep = pa.array([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield b.select(["a", "b"]).filter(keep)

    return run


def between(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``left`` are alike which of ``right``, as a matrix: sizes of intersections as a product of incidence
    matrices over the items that both sides have, a range of them at a time."""
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    shared = np.intersect1d(*(items for items, _ in sides))
    both = np.zeros((len(left), len(right)), np.float32)
    at = []
    for items, of in sides:
        k = np.searchsorted(shared, items)
        k[k == len(shared)] = 0
        hit = shared[k] == items if len(shared) else np.zeros(len(items), bool)
        at.append((k[hit], of[hit]))
    for low in range(0, len(shared), 4096):
        m = []
        for (k, of), sets in zip(at, (left, right), strict=True):
            inside = (k >= low) & (k < low + 4096)
            x = np.zeros((len(sets), min(4096, len(shared) - low)), np.float32)
            x[of[inside], k[inside] - low] = 1
            m.append(x)
        both += m[0] @ m[1].T
    sizes = np.add.outer(np.array(list(map(len, left)), np.int64), np.array(list(map(len, right)), np.int64))
    n = both.astype(np.int64)
    return (n > 0) & (100 * n >= percent * (sizes - n))


def _blocks(percent: int):
    """Links between the two sides of each block pair; rows come sorted by pair. A pair of a block with itself has
    one side. Documents of one component aren't linked again."""

    def linked(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        one = [r for r in rows if not r[0]]
        two = [r for r in rows if r[0]] or one
        if not one or two is one and len(one) < 2:
            return
        sets = [[np.frombuffer(r[3], np.uint64) for r in side] for side in (one, two)]
        same = np.equal.outer(np.array([r[2] for r in one]), np.array([r[2] for r in two]))
        x, y = np.nonzero(between(*sets, percent) & ~same)
        if len(x):
            a, b = np.array([r[1] for r in one])[x], np.array([r[1] for r in two])[y]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("first", "i", "j", "right", "node", "component", "items")]
            for f, i, j, *row in zip(*cols, strict=True):
                if (f, i, j) != key:
                    yield from linked(rows)
                    key, rows = (f, i, j), []
                rows.append(row)
        yield from linked(rows)

    return run


def _classed(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """doc_id, mark (of the set), n_shingles, component_id, and the number of the component, for each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))
    slim = staged(rows.mapInArrow(_sketched(width), "doc_id long, n long, mark binary, keys array<long>"))
    linked = slim.filter("n > 0 AND doc_id IS NOT NULL")
    # A node for each set, with its smallest id as its number; where an id has several sets, all but one get numbers of
    # their own, below all ids. Components are named by ids in the end.
    same = staged(linked.groupBy("mark").agg(F.min(F.struct("doc_id", "n", "keys")).alias("one")).select("mark", F.col("one.doc_id").alias("least"), "one.n", "one.keys"))
    several = same.groupBy("least").count().filter("count > 1").select("least")
    odd = not several.isEmpty()
    same = same.withColumn("node", F.col("least"))
    if odd:
        lowest = same.agg(F.min("least")).first()[0]
        turn = F.row_number().over(Window.partitionBy("least").orderBy("mark"))
        spare = same.join(several, "least", "left_semi").select("mark", turn.alias("turn")).filter("turn > 1").select("mark", F.pmod(F.xxhash64("mark"), F.lit(64)).alias("part"))
        number = F.lit(lowest) - F.row_number().over(Window.partitionBy("part").orderBy("mark")) * 64 - F.col("part")
        same = staged(same.join(staged(spare.select("mark", number.alias("number"))), "mark", "left").withColumn("node", F.coalesce("number", "least")).drop("number"))
    nodes = same.select("node", "n", "keys")
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("of")).filter("of > 1").select("key", "first")
    members = staged(keyed.join(shared, "key").select("key", "node", "n", F.col("first.node").alias("first"), F.col("first.n").alias("first_n")))
    wanted = members.select("node").distinct()
    sets = _sets_of(rows, wanted, same, width, odd)
    near = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent  # noqa: E731  else too far apart in size

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b)."""
        one = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("right")), "b")
        two = one.join(sets.select(F.col("id").alias("a"), F.col("items").alias("left")), "a")
        return staged(two.select("a", "b", "left", "right").mapInArrow(_verified(percent), "a long, b long"))

    links = verified(members.filter("node <> first").filter(near(F.col("n"), F.col("first_n"))).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    found = components(links)

    # Buckets that are still of several components, by their smallest node: its bands mostly share the same members.
    now = members.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    rest = staged(now.join(several, "key").select("first", "node", "n", "component").distinct())
    if not rest.isEmpty():
        of_first = found.select(F.col("id").alias("first"), F.col("component").alias("first_component"))
        sided = rest.join(of_first, "first", "left").withColumn("inner", F.col("component") == F.coalesce("first_component", "first")).drop("first_component")
        blocks = sided.groupBy("first").agg(F.ceil(F.count_if("inner") / BLOCK).cast("int").alias("a"), F.ceil(F.count_if(~F.col("inner")) / BLOCK).cast("int").alias("b"))
        placed = sided.join(blocks.filter("b > 0"), "first").withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("inner"), F.col("a")).otherwise(F.col("b"))).cast("int"))
        # Inner blocks meet each outer one, outer ones also each other, each two once.
        outer = F.sequence(F.lit(0), F.col("b") - 1)
        with_inner = F.when(F.col("a") > 0, F.transform(F.sequence(F.lit(0), F.col("a") - 1), lambda i: F.struct((i - F.col("a")).alias("i"), F.col("block").alias("j"), F.lit(True).alias("right")))).otherwise(F.array().cast("array<struct<i:int,j:int,right:boolean>>"))
        with_outer = F.transform(outer, lambda i: F.struct(F.least(i, F.col("block")).alias("i"), F.greatest(i, F.col("block")).alias("j"), (i < F.col("block")).alias("right")))
        meets = F.when(F.col("inner"), F.transform(outer, lambda j: F.struct((F.col("block") - F.col("a")).alias("i"), j.alias("j"), F.lit(False).alias("right")))).otherwise(F.concat(with_inner, with_outer))
        met = staged(placed.withColumn("m", F.explode(meets)).select("first", "m.i", "m.j", "m.right", "node", "component"))
        filled = met.join(sets.withColumnRenamed("id", "node"), "node").select("first", "i", "j", "right", "node", "component", "items")
        sorted_ = filled.repartition(partitions_for(spark, met.count(), MET_EACH), "first", "i", "j").sortWithinPartitions("first", "i", "j")
        more = staged(sorted_.mapInArrow(_blocks(percent), "a long, b long"))
        if not more.isEmpty():
            found = components(links.union(more))
    final = same.join(found, F.col("node") == F.col("id"), "left").select("mark", "least", F.coalesce("component", "node").alias("component"))
    if odd:
        final = final.join(final.groupBy("component").agg(F.min("least").alias("smallest")), "component")
    final = final.select(F.col("mark").alias("of"), F.col("component").alias("number"), F.col("smallest" if odd else "component").alias("component_id"))
    known = linked.join(final, F.col("mark") == F.col("of")).select("doc_id", "mark", F.col("n").alias("n_shingles"), "component_id", "number")
    return known.unionByName(slim.filter("n = 0 OR doc_id IS NULL").select("doc_id", "mark", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("number")))


def _sets_of(rows: DataFrame, wanted: DataFrame, same: DataFrame, width: int, odd: bool) -> DataFrame:
    """id (of a node) and items for the nodes wanted; with ``odd`` an id doesn't tell a node's set."""
    if not odd:
        few = rows.join(wanted.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
        return staged(few.mapInArrow(_sets(width), "id long, items binary, mark binary").drop("mark").dropDuplicates(["id"]))
    of = same.join(wanted, "node", "left_semi").select("least", "node", F.col("mark").alias("of"))
    few = rows.join(of.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_sets(width), "id long, items binary, mark binary")
    return staged(few.join(of, (F.col("id") == F.col("least")) & (F.col("mark") == F.col("of"))).select(F.col("node").alias("id"), "items").dropDuplicates(["id"]))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs``.

    A document's set is its distinct ``width``-word shingles (words end at space, tab, line feed, vertical tab,
    form feed and carriage return; A-Z count as a-z); a text with fewer words is one shingle; one without words,
    or null, has an empty set and no links. Sets are held as 64-bit hashes. Two documents are linked if their
    similarity is at least ``percent`` hundredths, and component_id is the smallest id that a document reaches.
    Rows that repeat an id are documents of their own; rows without an id have no links. Ids are integers; no rows give
    no rows; extra columns are ignored."""
    return _classed(docs, id_col, text_col, width, percent).drop("mark", "number")


def _marked(text: str, mark: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_mark(shingles(t, width)) for t in b.column(text).to_pylist()]
            rest = b.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found, pa.binary())], names=[*rest.schema.names, mark])

    return run


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the row of the smallest id of each component of linked documents, all columns. Rows without
    words, and rows without an id, have no links and stay. Of rows of a component that share its smallest id the one with
    the smallest text stays; rows alike in that too are one. Columns may have any names; no rows give no rows."""
    found = staged(_classed(docs, id_col, text_col, width, percent))
    several = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    odd = not several.isEmpty()
    goes = found.filter("doc_id <> component_id").select("doc_id")
    if odd:  # rows that their ids don't tell apart
        several = staged(several)
        goes = goes.union(several)
    (key,) = free(docs, "of_id")
    # The ids that go grow with the rows, so they aren't broadcast at any size.
    out = docs.join(goes.distinct().withColumnRenamed("doc_id", key).hint("merge"), docs[id_col].cast("bigint") == F.col(key), "left_anti")
    if not odd:
        return out
    small_batches(docs.sparkSession)
    raw, mark, of_id, of_mark, component, number, size, rank = free(docs, "raw", "mark", "of_id", "of_mark", "component", "number", "size", "rank")
    mine = docs.join(several.withColumnRenamed("doc_id", key), docs[id_col].cast("bigint") == F.col(key), "left_semi").withColumn(raw, text_bytes(text_col))
    marked = mapped(mine, _marked(raw, mark, width), mine.drop(raw).schema.add(mark, "binary"))
    of = found.join(several, "doc_id", "left_semi").select("doc_id", "mark", "component_id", "number", "n_shingles").distinct().toDF(of_id, of_mark, component, number, size)
    both = marked.join(of, (marked[id_col].cast("bigint") == F.col(of_id)) & (F.col(mark) == F.col(of_mark)))
    first = Window.partitionBy(number).orderBy(text_bytes(text_col))
    stay = both.filter(f"`{size}` > 0 AND `{of_id}` = `{component}`").withColumn(rank, F.row_number().over(first)).filter(F.col(rank) == 1)
    wordless = both.filter(f"`{size}` = 0")
    return out.unionByName(stay.select(*columns_of(docs))).unionByName(wordless.select(*columns_of(docs)))
