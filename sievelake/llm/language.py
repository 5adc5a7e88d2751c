"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of orders 0 to ``ORDER`` with the counts of the bytes that followed
them. A byte is coded in the longest context that the tree has; if it never followed that context, an escape is
coded (method C: as likely as the number of different followers) and the next shorter context tries, without
the bytes that the longer one has already ruled out; the last resort is a uniform code over the rest. The
counts are frozen after training, so the code length of a text is a sum of exact lengths of its bytes. The
language with the shortest code wins.

A text is lower-cased and its white space made single spaces, one of them before it; contexts go over all of it.
A byte's length depends on at most ``ORDER`` bytes before it, so lengths in all languages are tabled for every
string of ``ORDER + 1`` bytes met in training and looked up for all bytes of a batch at once. Other strings are
coded from the trees, order by order, as arrays too.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, small_batches, text_bytes

ORDER = 4
#: About how many documents of a language the trees are trained on at most: those with the smallest id hashes.
MOST_DOCS = 500
#: Bytes that are looked up at once.
AT_ONCE = 1 << 18

LETTER = re.compile(rb"[A-Za-z]")


def stream(text: str) -> bytes:
    """The bytes that are coded, after one space that is not."""
    return b" ".join([b"", *text.lower().encode("utf-8", "replace").split()])


def tagged(value: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes of each value under a bit that tells their number."""
    return value & np.int64((1 << 8 * length) - 1) | np.int64(1 << 8 * length)


def grams(data: bytes) -> np.ndarray:
    """For each byte of a stream but the first: up to ``ORDER`` bytes before it and the byte, as one tagged number."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    value = x.copy()
    for k in range(1, ORDER + 1):
        value[k:] |= x[:-k] << 8 * k
    out = tagged(value, ORDER + 1)
    for k in range(1, min(ORDER, len(x))):
        out[k] = tagged(value[k : k + 1], k + 1)[0]
    return out[1:]


def length_of(gram: np.ndarray) -> np.ndarray:
    """How many bytes tagged numbers have."""
    return sum((gram >= np.int64(1 << 8 * k)).astype(np.int64) for k in range(1, ORDER + 2))


class Lookup:
    """Places of keys in an array of different ones, -1 if absent: a table of four slots a key at least, probed one
    after the other."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.slots = np.append(keys, -1), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._first(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several in one slot the last stays
            on = self.slots[at] != left
            left, at = left[on], at[on] + 1 & (1 << self.bits) - 1

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._first(keys)
        out = self.slots[at]
        left = np.flatnonzero((self.keys[out] != keys) & (out >= 0))
        while len(left):
            at[left] = at[left] + 1 & (1 << self.bits) - 1
            out[left] = self.slots[at[left]]
            left = left[(self.keys[out[left]] != keys[left]) & (out[left] >= 0)]
        return out


class Model:
    """The context trees of all languages, order by order: for each context of any of them, and each byte that follows it,
    a column of counts."""

    def __init__(self, counts: dict[str, dict[int, int]]):
        """``counts``: by language those of the numbers that :func:`grams` gives."""
        self.langs = sorted(counts)
        n = len(self.langs)
        gram = np.array([g for x in self.langs for g in counts[x]], np.int64)
        of = np.repeat(np.arange(n), [len(counts[x]) for x in self.langs])
        times = np.array([c for x in self.langs for c in counts[x].values()], np.float64)
        longest = length_of(gram)
        self.contexts, self.followers, self.orders = [], [], []
        above: tuple | None = None  # of the order above: followers, their contexts' places, whether there, and contexts
        for k in range(ORDER, -1, -1):
            has = longest > k
            keys, at = np.unique(tagged(gram[has], k + 1), return_inverse=True)
            count = np.zeros((len(keys), n))
            np.add.at(count, (at, of[has]), times[has])
            contexts, place = np.unique(tagged(keys >> 8, k), return_inverse=True)
            total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, place, count)
            np.add.at(kinds, place, count > 0)
            if above is not None:  # what contexts of the order above rule out here
                up, up_place, there, n_up = above
                ruled = np.zeros((n_up, n))
                np.add.at(ruled, up_place, count[np.searchsorted(keys, tagged(up, k + 1))] * there)
                self.orders[-1] += (ruled,)
            self.contexts.append(Lookup(contexts))
            self.followers.append(Lookup(keys))
            self.orders.append((count, total, kinds))
            above = keys, place, count > 0, len(contexts)
        self.orders[-1] += (np.zeros((1, n)),)
        known = np.unique(gram)
        self.known = Lookup(known)
        self.table = np.concatenate([self.bits(known[a : a + AT_ONCE]) for a in range(0, len(known), AT_ONCE)] + [np.zeros((1, n))])

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """The code length of the last byte of each gram after its others, in each language."""
        shape = len(gram), len(self.langs)
        out, open_, longest = np.zeros(shape), np.ones(shape, bool), length_of(gram)
        ruled_n, ruled_kinds = np.zeros(shape), np.zeros(shape)
        for k, contexts, followers, (count, total, kinds, ruled) in zip(range(ORDER, -1, -1), self.contexts, self.followers, self.orders, strict=True):
            has = np.flatnonzero(longest > k)
            place = contexts(tagged(gram[has] >> 8, k))
            has, place = has[place >= 0], place[place >= 0]
            if not len(has):
                continue
            there = kinds[place] > 0  # languages that have the context
            left_kinds, left = kinds[place] - ruled_kinds[has], total[place] - ruled_n[has]
            at = followers(tagged(gram[has], k + 1))
            seen = np.where((at >= 0)[:, None], count[at], 0)
            tries = open_[has] & there & (left_kinds > 0)
            found = tries & (seen > 0)
            of = np.where(found, seen, left_kinds)
            out[has] -= np.where(tries, np.log2(np.where(tries, of, 1) / np.where(tries, left + left_kinds, 1)), 0)
            open_[has] &= ~found
            ruled_kinds[has] = np.where(there, kinds[place], ruled_kinds[has])
            ruled_n[has] = np.where(there, ruled[place], 0)
        return out + np.where(open_, np.log2(np.maximum(1, 256 - ruled_kinds)), 0)

    def texts(self, texts: list[str]) -> np.ndarray:
        """The code length of each text in each language."""
        streams, total = list(map(stream, texts)), np.zeros((len(texts), len(self.langs)))
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def add() -> None:
            gram = np.concatenate([g for _, g in held])
            at = self.known(gram)
            rows = self.table[at]
            new = np.flatnonzero(at < 0)
            if len(new):
                keys, of = np.unique(gram[new], return_inverse=True)
                rows[new] = self.bits(keys)[of]
            starts = np.cumsum([0] + [len(g) for _, g in held[:-1]])
            np.add.at(total, [k for k, _ in held], np.add.reduceat(rows, starts))
            held.clear()

        for k, s in enumerate(streams):
            for a in range(1, len(s), AT_ONCE):
                begin = max(0, a - ORDER)
                g = grams(s[begin : a + AT_ONCE])[a - begin - 1 :] if begin else grams(s[: a + AT_ONCE])
                held.append((k, g))
                size += len(g)
                if size >= AT_ONCE:
                    add()
                    size = 0
        if held:
            add()
        return total

    def predict(self, raw: list[bytes]) -> list[tuple[str, float]]:
        """The language and its share of the likelihood; ``und`` and 0 for a text without a letter. Of languages equally
        likely the first by name."""
        texts = [t.decode("utf-8", "replace") for t in raw]
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.langs:
            return out
        ask = [k for k, t in enumerate(texts) if LETTER.search(raw[k]) or any(map(str.isalpha, t))]
        bits = self.texts([texts[k] for k in ask])
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1) if len(ask) else best
        for k, b, s in zip(ask, best.tolist(), share.tolist(), strict=True):
            out[k] = self.langs[b], s
        return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held = defaultdict(list)
        for lang, raw in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            held[lang].append(grams(stream(raw.decode("utf-8", "replace"))))
        for lang, found in held.items():
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_DOCS) -> Model:
    """Trees of about ``most`` documents of each language of ``docs``; rows without a language are left out, null texts
    are empty. What reaches the driver is the languages and the counts of the different byte strings of ``ORDER + 1``
    bytes in those documents. Ids may be of any kind."""
    small_batches(docs.sparkSession)
    known = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col).alias("hash"), text_bytes(text_col).alias("text"))
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Model({})
    limit = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1, most / n) * (1 << 30)))])
    few = known.filter(F.pmod("hash", F.lit(1 << 30)) < limit[F.col("lang")]).select("lang", "text")
    counts: dict[str, dict[int, int]] = {lang: {} for lang in sizes}
    got = few.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    for lang, gram, n in zip(*(got.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True):
        counts[lang][gram] = n
    return Model(counts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) for each row of ``docs``. A null text, and one without a letter, is
    ``und`` with score 0; so is every text under a model without languages. Texts are read whole, in parts of bounded
    size. Repeated rows get equal results; extra columns are ignored."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            found = m.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
