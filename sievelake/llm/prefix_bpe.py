"""BPE of a tokenizer file in JSON, by a table of last tokens over all prefixes.

An automaton reads the bytes of a piece and tells, at each, the tokens that end there. Of those exactly one is the last
token of the encoding of the prefix: the one that is the encoding of its bytes together with the last token of what
lies before it. That test needs only the two tokens; whether two may stand side by side follows from the merges that
made them. The stored token's length points back to the prefix before it, so the ids are read from the end.

The file lists merges as pairs, and only a listed pair joins: two tokens whose bytes together are a token's, but which
aren't its pair, stay apart. Special tokens are found in a text before anything else, the leftmost and longest first,
and each stretch between them is cut into pieces on its own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import small_batches, text_bytes

TOKENIZER = "byte_bpe_50k.json"
_NEVER = 1 << 60


def byte_of() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, all others,
    in order, for the characters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges(bpe.Vocabulary):
    """Tokens by id, and the pairs that join, in the order in which they do."""

    def __init__(self, ids: dict[bytes, int], pairs: list[tuple[bytes, bytes]]):
        super().__init__(ids)
        self.joins: dict[tuple[int, int], int] = {}
        self.order = [-1] * len(self.tokens)  # by token the place of the merge that makes it
        for k, (a, b) in enumerate(pairs):
            if self.order[ids[a + b]] >= 0:
                raise ValueError("two merges make one token")
            self.joins[ids[a], ids[b]], self.order[ids[a + b]] = k, k

    def merged(self, piece: bytes, below: int = -1) -> list[int]:
        """The encoding by its definition. ``below``: a token; only merges before its own."""
        before = _NEVER if below < 0 else self.order[below] if self.order[below] >= 0 else 0
        parts = [self.ranks[piece[k : k + 1]] for k in range(len(piece))]
        while len(parts) > 1:
            turn, k = min((self.joins.get((parts[k], parts[k + 1]), _NEVER), k) for k in range(len(parts) - 1))
            if turn >= before:
                break
            parts[k : k + 2] = [self.ranks[self.tokens[parts[k]] + self.tokens[parts[k + 1]]]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The pair whose join makes the token, if merging its own bytes leads there."""
        if token not in self._halves:
            two = self.merged(self.tokens[token], token) if self.order[token] >= 0 else []
            self._halves[token] = tuple(two) if len(two) == 2 and self.joins.get(tuple(two)) == self.order[token] else None
        return self._halves[token]

    def _meet(self, a: int, b: int) -> bool:
        # Undo joins, the latest first. A pair that meets at the seam may not have a merge that comes before the one
        # undone last; of one merge the left place comes first, so that the seam precedes a join in b but not one in a.
        undone, in_right = _NEVER, False
        while True:
            seam = self.joins.get((a, b), _NEVER)
            if seam < undone or seam == undone and in_right and seam < _NEVER:
                return False
            left, right = self.halves(a), self.halves(b)
            if left is None and right is None:
                return True
            in_right = left is None or right is not None and self.order[a] <= self.order[b]
            if in_right:
                undone, b = self.order[b], right[0]
            else:
                undone, a = self.order[a], left[1]


class _Chunks(bpe._Chunks):
    """As the base; only ASCII letters are known to be one piece."""

    def made(self, chunk: str) -> bytes:
        e, whole = self.encoder, " " + chunk
        if chunk.isascii() and chunk.isalpha() or len(found := e.split(whole)) == 1 and found[0] == whole:
            return e.piece(whole)
        return b"".join(map(e.ids_of, found))


class JsonEncoder(bpe.Encoder):
    """Encodes and decodes texts as the file says. A file with a normalizer, a byte-level step of another form, or
    special tokens that take white space with them isn't read."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, step, bytes_ = file["model"], file["pre_tokenizer"] or {}, byte_of()
        odd = [t for t in file["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if odd or file["normalizer"] or step.get("type") != "ByteLevel" or step["add_prefix_space"] or not step["use_regex"] or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        raw = lambda token: bytes(map(bytes_.__getitem__, token))
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        super().__init__(Merges({raw(t): k for t, k in model["vocab"].items() if t not in special}, [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]), pattern)
        # The library's classes of letters are of another Unicode version than those of ``regex``: beyond ASCII it cuts itself.
        cut, ascii_ = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str, self.split
        self.split = lambda text: ascii_(text) if text.isascii() else [text[a:b] for _, (a, b) in cut(text)]
        self._chunks = _Chunks(self)
        self.special = {t: pack("<I", k) for t, k in special.items()}
        self._find = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        tokens = self.vocabulary.tokens
        tokens.extend([b""] * (max(special.values(), default=-1) + 1 - len(tokens)))
        self.decoded = list(tokens)
        for t, k in special.items():
            self.decoded[k] = t.encode()

    def encode(self, text: str, special: bool = True) -> bytes:
        """Little-endian 32-bit ids. Without ``special`` the names of special tokens are text like any other."""
        if not special or self._find is None or not (found := list(self._find.finditer(text))):
            return super().encode(text)
        out, at = [], 0
        for m in found:
            out += [super().encode(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return b"".join([*out, super().encode(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8; what isn't UTF-8 is replaced."""
        return b"".join(map(self.decoded.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> JsonEncoder:
    """One a worker process; the file is read where the work is done."""
    return JsonEncoder(path, pattern)


def _run(docs: DataFrame, id_col: str, text_col: str, path: str | None, pattern: str | None, kind: str, types: list, made) -> DataFrame:
    path, pattern = path or bpe.public_path(TOKENIZER), pattern or bpe.public_pattern()
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            rows = [made(ids := e.encode(t.decode("utf-8", "replace")), e.decode(ids)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, kind)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array of token ids) and decoded (the text that they decode to) for each row of ``docs``.

    A null or empty text has no ids. Names of special tokens in a text become those tokens. Repeated rows give repeated
    rows, a null id stays null, extra columns are ignored, no rows give no rows; a text is encoded whole at any length.
    ``path`` must lead to the tokenizer on every executor."""
    return _run(docs, id_col, text_col, path, pattern, "doc_id long, ids array<int>, decoded string", [pa.list_(pa.int32()), pa.string()], lambda ids, text: (np.frombuffer(ids, "<i4").tolist(), text.decode()))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """As :func:`encoded`, with n_tokens, ids_sha256 (of little-endian 32-bit ids) and decoded_sha256 (of UTF-8)."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _run(docs, id_col, text_col, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()], lambda ids, text: (len(ids) // 4, sha(ids), sha(text)))
