"""Byte-level BPE by prefix dynamic programming.

The encoding of a byte string under a BPE vocabulary has a local test: a sequence of tokens is the encoding
of its bytes if and only if each two neighbours are the encoding of theirs. So each prefix of a string has
exactly one token that its encoding ends with: the one that is a suffix of the prefix and goes together with
the last token of what comes before it. Storing that token for every prefix makes appending exact: what is
stored for a prefix never changes when bytes follow. An edit keeps what lies before it, and what follows is
computed again up to where the stored tokens agree once more. What tokens a prefix may end with, an automaton
tells that keeps, byte by byte, the longest beginning of a token that the prefix ends with.

Texts are split by a pattern first, and pieces never merge with each other. Equal pieces are encoded once a
worker: a bounded cache holds their ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Chunks, and pairs and steps, that a worker remembers at most, and the longest chunk that it remembers, in characters.
PIECES, PAIRS, LONG = 600_000, 500_000, 48
#: A space and white space after it.
SPACES = re.compile(r" \s")


def public_path(name: str = VOCABULARY) -> str:
    """Where the installed public vocabulary lies; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Vocabulary:
    """Tokens by rank, and whether two of them are the encoding of their bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, k in ranks.items():
            self.tokens[k] = t
        self.longest = max(map(len, ranks), default=0)
        #: Lengths by token; the last one is that of no token.
        self.lengths = [*map(len, self.tokens), 0]
        #: By token the longest other token that it ends with, or -1.
        self.shorter = [next((ranks[t[k:]] for k in range(1, len(t)) if t[k:] in ranks), -1) for t in self.tokens]
        self.pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        # The automaton: a state for each beginning of a token; where it falls back to, and the longest token in its end.
        begins = sorted({t[:k] for t in ranks for k in range(len(t) + 1)} | {b""}, key=len)
        of = {b: k for k, b in enumerate(begins)}
        self._below = {of[b[:-1]] << 8 | b[-1]: k for k, b in enumerate(begins) if b}
        self._back = [next((of[b[k:]] for k in range(1, len(b)) if b[k:] in of), 0) for b in begins]
        self.ending: list[int] = []
        for b, back in zip(begins, self._back, strict=True):
            self.ending.append(ranks[b] if b in ranks else self.ending[back] if b else -1)
        self.steps: dict[int, int] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From lines of a base64 token and its rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(k) for t, k in (line.split() for line in f if line.strip())})

    def merged(self, piece: bytes, below: int = 1 << 60) -> list[int]:
        """The encoding by its definition: join the neighbours of lowest rank, leftmost first, while any join.
        ``below``: only joins of a lower rank. Only single tokens come here, once each."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(parts[k] + parts[k + 1], below), k) for k in range(len(parts) - 1))
            if rank >= below:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose join makes it last; None for one byte, and for a token that joins never reach."""
        if token not in self._halves:
            two = self.merged(self.tokens[token], token)
            self._halves[token] = tuple(two) if len(two) == 2 else None
        return self._halves[token]

    def alone(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def step(self, at: int, byte: int) -> int:
        """The state after a byte more."""
        if len(self.steps) >= PAIRS:
            self.steps.clear()
        to = at
        while to and to << 8 | byte not in self._below:
            to = self._back[to]
        to = self.steps[at << 8 | byte] = self._below.get(to << 8 | byte, 0)
        return to

    def state(self, piece: bytes) -> int:
        """The state after all bytes."""
        at = 0
        for byte in piece[-self.longest :] if self.longest else b"":
            at = self.step(at, byte)
        return at

    def together(self, a: int, b: int) -> bool:
        """Whether the two tokens are the encoding of their bytes: as their joins are undone, the latest first,
        no tokens that meet at the seam may have had a join that comes before the one undone last. With -1 for
        ``a``: whether ``b`` is the encoding of its own."""
        try:
            return self.pairs[a << 32 | b]
        except KeyError:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self.alone(b) and (a < 0 or self.alone(a) and self._meet(a, b))
            return known

    def _meet(self, a: int, b: int) -> bool:
        # The seam's join is made only before what was undone: at equal ranks the left one is made first, so a
        # join at the seam precedes that of b at the same rank, but not that of a.
        tokens, ranks, undone, on_right = self.tokens, self.ranks, 1 << 60, False
        while True:
            seam = ranks.get(tokens[a] + tokens[b], 1 << 60)
            if seam < undone or seam == undone and on_right and seam < 1 << 60:
                return False
            left, right = self.halves(a), self.halves(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and a > b:
                undone, a, on_right = a, left[1], False
            else:
                undone, b, on_right = b, right[0], True


class PrefixEncoding:
    """The encoding of one piece: for each prefix its last token. Bytes can be appended, cut and replaced."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last, self._at = vocabulary, b"", [-1], 0
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Exact: no stored token changes."""
        v, last, at, end = self.vocabulary, self.last, self._at, len(self.piece)
        steps, ending, lengths, shorter, pairs = v.steps, v.ending, v.lengths, v.shorter, v.pairs
        try:
            for byte in more:
                end += 1
                try:
                    at = steps[at << 8 | byte]
                except KeyError:
                    at = v.step(at, byte)
                t = ending[at]
                while True:  # from the longest token on; the right one is unique
                    before = last[end - lengths[t]]
                    try:
                        fits = pairs[before << 32 | t]
                    except KeyError:
                        fits = v.together(before, t)
                    if fits:
                        break
                    t = shorter[t]
                last.append(t)
        except IndexError:  # no token is left
            self.cut(len(self.piece))
            raise ValueError("the vocabulary lacks a byte") from None
        self.piece, self._at = self.piece + more, at

    def cut(self, length: int) -> None:
        """Keep the first ``length`` bytes."""
        self.piece = self.piece[:length]
        del self.last[length + 1 :]
        self._at = self.vocabulary.state(self.piece)

    def edit(self, start: int, end: int, by: bytes) -> int:
        """Replace bytes ``start`` to ``end``; the number of bytes encoded for that. What is stored before the edit
        stays. Behind it, a prefix's last token follows from as many bytes and stored tokens before it as the longest
        token has bytes; where so many in a row are as they were, all that follow are."""
        rest, stored, longest = self.piece[end:], self.last[end:], self.vocabulary.longest
        self.cut(start)
        self.append(by)
        for a in range(0, len(rest), longest):
            self.append(rest[a : a + longest])
            upto = a + longest
            if upto < len(rest) and self.last[-longest:] == stored[a + 1 : upto + 1]:
                self.piece, self.last = self.piece + rest[upto:], self.last + stored[upto + 1 :]
                self._at = self.vocabulary.state(self.piece)
                return len(by) + upto
        return len(by) + len(rest)

    def ids(self) -> list[int]:
        """Read from the end, token by token."""
        out, end = [], len(self.piece)
        while end:
            out.append(self.last[end])
            end -= self.vocabulary.lengths[self.last[end]]
        return out[::-1]


class _Known(dict):
    """Remembers results by key in two generations: when the younger is full it becomes the older, and what is
    asked for again moves to the younger, so that frequent keys stay."""

    def __init__(self, most: int):
        super().__init__()
        self.half, self.older = most // 2, {}

    def __missing__(self, key: str) -> bytes:
        if (out := self.older.get(key)) is None:
            out = self.made(key)
        if len(key) <= LONG:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[key] = out
        return out


class _Pieces(_Known):
    """Ids of pieces that don't begin with a space, as little-endian 32-bit integers."""

    def __init__(self, encoder: Encoder):
        super().__init__(PIECES // 2)
        self.made = encoder.piece


class _Chunks(_Known):
    """Ids of a space and what follows it up to the next space that begins a piece. Letters alone are one piece."""

    def __init__(self, encoder: Encoder):
        super().__init__(PIECES)
        self.encoder = encoder

    def made(self, chunk: str) -> bytes:
        e, chunk_ = self.encoder, " " + chunk
        if chunk.isalpha() or len(found := e.split(chunk_)) == 1 and found[0] == chunk_:
            return e.piece(chunk_)
        return b"".join(map(e.ids_of, found))


class _Sizes(_Known):
    """Characters and tokens of the pieces of such a chunk."""

    def __init__(self, encoder: Encoder):
        super().__init__(PIECES)
        self.encoder = encoder

    def made(self, chunk: str) -> bytes:
        e, chunk_ = self.encoder, " " + chunk
        if chunk.isalpha():
            return pack("<2I", len(chunk_), len(e.piece(chunk_)) // 4)
        return e.piece_sizes(chunk_)


class Encoder:
    """Encodes texts. A space before anything but white space begins a piece whatever stands around it (the
    pattern lets a piece have white space inside only if all of it is), so texts are cut there first, by the
    much faster ``str.split``, and the pattern cuts each different chunk once."""

    def __init__(self, vocabulary: str | Vocabulary, pattern: str):
        compiled = regex.compile(pattern)
        self.vocabulary = Vocabulary.read(vocabulary) if isinstance(vocabulary, str) else vocabulary
        self.split, self.matches = compiled.findall, compiled.finditer
        self._pieces, self._chunks, self._sizes = _Pieces(self), _Chunks(self), _Sizes(self)

    def piece(self, piece: str) -> bytes:
        """The ids of one piece, as little-endian 32-bit integers."""
        raw = piece.encode("utf-8", "replace")
        if (whole := self.vocabulary.ranks.get(raw)) is not None:
            return pack("<I", whole)
        ids = PrefixEncoding(self.vocabulary, raw).ids()
        return pack(f"<{len(ids)}I", *ids)

    def ids_of(self, piece: str) -> bytes:
        """As :meth:`piece`, remembered."""
        return self._chunks[piece[1:]] if piece[0] == " " and len(piece) > 1 and not piece[1].isspace() else self._pieces[piece]

    def pieces(self, text: str) -> bytes:
        return b"".join(map(self.ids_of, self.split(text)))

    def chunked(self, text: str) -> tuple[str, list[str]]:
        """What stands before the first such space, and what follows each."""
        first, *rest = text.split(" ")
        if "" in rest or SPACES.search(text):
            kept = [[first]]
            for x in rest:
                if not x or x[0].isspace():
                    kept[-1].append(x)
                else:
                    kept.append([x])
            first, *rest = map(" ".join, kept)
        return first, rest

    def encode(self, text: str) -> bytes:
        first, rest = self.chunked(text)
        return self.pieces(first) + b"".join(map(self._chunks.__getitem__, rest))

    def sizes(self, text: str) -> bytes:
        """For each piece of a text its characters and its tokens, as pairs of little-endian 32-bit integers."""
        first, rest = self.chunked(text)
        return self.piece_sizes(first) + b"".join(map(self._sizes.__getitem__, rest))

    def piece_sizes(self, text: str) -> bytes:
        """As :meth:`sizes`, for a text that isn't remembered."""
        found = self.split(text)
        if sum(map(len, found)) != len(text):
            raise ValueError("the pattern leaves out characters")
        return b"".join([pack("<2I", len(p), self.piece_count(p)) for p in found])

    def piece_count(self, piece: str) -> int:
        """The number of tokens of one piece."""
        return len(self.ids_of(piece)) // 4

    def count(self, text: str) -> int:
        """The number of tokens of a text."""
        return len(self.encode(text)) // 4

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One a worker process; the files are read where the work is done."""
    return Encoder(path, pattern)


def with_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array of token ids) and decoded (bytes of the decoded ids) for each row of ``docs``. A null
    or empty text has no ids; repeated rows give repeated rows; extra columns are ignored. ``path`` must lead to
    the vocabulary on every executor."""
    return _encoded(docs, id_col, text_col, path, pattern, "doc_id long, ids array<int>, decoded binary", _whole)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """As :func:`with_ids`, with n_tokens, ids and exact (whether the ids decode to the text's bytes)."""
    path, pattern = path or public_path(), pattern or public_pattern()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            raw = b.column("text").to_pylist()
            ids = [e.encode(t.decode("utf-8", "replace")) for t in raw]
            sizes = np.fromiter((len(x) // 4 for x in ids), np.int32, len(ids))
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
            exact = pa.array([e.decode(x) == t for x, t in zip(ids, raw, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), lists, exact], names=["doc_id", "n_tokens", "ids", "exact"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, exact boolean")


def _whole(ids: bytes, decoded: bytes) -> tuple:
    return np.frombuffer(ids, "<i4").tolist(), decoded


def _digest(ids: bytes, decoded: bytes) -> tuple:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """As :func:`with_ids`, with n_tokens, ids_sha256 and decoded_sha256 in place of ids and bytes."""
    return _encoded(docs, id_col, text_col, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)


def _encoded(docs, id_col, text_col, path, pattern, kind, made) -> DataFrame:
    path, pattern = path or public_path(), pattern or public_pattern()
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in kind.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
    fields = [types[x.split()[1]] for x in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            rows = []
            for raw in b.column("text").to_pylist():
                ids = e.encode(raw.decode("utf-8", "replace"))
                rows.append(made(ids, e.decode(ids)))
            columns = [b.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(fields[1:]))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, kind)
