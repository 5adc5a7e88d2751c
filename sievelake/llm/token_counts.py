"""Token counts that follow edits.

A text is kept as its pre-tokens, with the characters and tokens of each. They are the leaves of a segment tree,
whose lowest level is ``WIDTH`` wide: nodes keep the sums of what is below them. An edit descends to the pre-tokens
that it touches. A pre-token depends on its own characters and on the ``AHEAD`` ones after it, so pre-tokens
that end earlier than that before the edit stay; from there on pre-tokens are made anew up to the first place behind
the edit where a pre-token began before, since from an equal place on equal text is cut equally. Only those are
encoded, and the sums above them are brought up to date.

On Spark a tree is a row: the text and its leaves. Edits are a table; only trees that have edits are changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, encoder, public_path, public_pattern
from .common import small_batches, text_bytes

WIDTH = 64
#: Characters after its end that the public pattern looks at to end a pre-token.
AHEAD = 2


def checked(pattern: str | None) -> str:
    """The public pattern; others may look further ahead, or back, than edits are followed here, and raise."""
    if pattern not in (None, public_pattern()):
        raise ValueError("edits are followed exactly under the public pattern only")
    return public_pattern()


class TokenTree:
    """The token count of a text under edits; equal to encoding the whole text at any time. ``encoded``: the
    characters encoded for edits so far."""

    def __init__(self, encoder: Encoder, text: str = "", leaves: bytes | None = None):
        self.encoder, self.encoded = encoder, 0
        self._lay(text, encoder.sizes(text) if leaves is None else leaves)

    def _lay(self, text: str, leaves: bytes) -> None:
        each = np.frombuffer(leaves, "<u4").reshape(-1, 2).astype(np.int64)
        self.blocks: list[tuple[str, np.ndarray]] = self._cut(text, each)
        self._sum()

    def _cut(self, text: str, each: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """Pre-tokens in blocks of ``WIDTH``."""
        if len(each) <= WIDTH:
            return [(text, each)]
        cut = range(0, len(each), WIDTH)
        ends = np.cumsum(np.add.reduceat(each[:, 0], cut)).tolist()
        return [(text[a:b], each[k : k + WIDTH]) for k, a, b in zip(cut, [0, *ends], ends, strict=False)]

    def _sum(self) -> None:
        """All nodes, from the counts in the blocks."""
        n = len(self.blocks)
        self.half = 1 << (n - 1).bit_length()
        sums = np.zeros((2 * self.half, 2), np.int64)
        for k, (_, each) in enumerate(self.blocks):
            sums[self.half + k] = each.sum(axis=0)
        level = self.half
        while level > 1:
            sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level //= 2
        self.chars, self.counts = sums[:, 0].tolist(), sums[:, 1].tolist()

    def __len__(self) -> int:
        return self.chars[1]

    @property
    def tokens(self) -> int:
        return self.counts[1]

    @property
    def text(self) -> str:
        return "".join(t for t, _ in self.blocks)

    @property
    def leaves(self) -> bytes:
        return np.concatenate([each for _, each in self.blocks]).astype("<u4").tobytes()

    def _block(self, at: int) -> tuple[int, int]:
        """The block that holds character ``at`` (the last one for the end), and where it starts."""
        k, start = 1, 0
        at = max(0, min(at, len(self) - 1))
        while k < self.half:
            k *= 2
            if at - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.half, start

    def edit(self, start: int, end: int, by: str) -> int:
        """Replace characters ``start`` to ``end``; the token count afterwards. Places beyond the end are the end, and an
        end before the start is the start."""
        start = max(0, min(start, len(self)))
        end = max(start, min(end, len(self)))
        low, base = self._block(start - AHEAD)
        text, each = self.blocks[low]
        ends = base + np.cumsum(each[:, 0])
        stay = int(np.searchsorted(ends, start - AHEAD, side="right"))  # pre-tokens of the block
        begin = int(ends[stay - 1]) if stay else base
        high, known = low, base + len(text)
        shift = len(by) - (end - start)
        old, leaves, borders = [text], [each], set(ends[ends >= end].tolist())

        def more() -> None:
            nonlocal high, known
            high += 1
            t, e = self.blocks[high]
            old.append(t)
            leaves.append(e)
            borders.update((known + np.cumsum(e[:, 0])).tolist())
            known += len(t)

        while known < end:
            more()
        last = len(self.blocks) - 1
        made: list[str] = []
        at = 0  # in the new text from ``begin`` on, up to which pre-tokens are made
        while True:
            whole = "".join(old)
            new = whole[begin - base : start - base] + by + whole[end - base :]
            safe = len(new) if high == last else len(new) - AHEAD
            upto, agreed = at, False
            for m in self.encoder.matches(new, at):
                if m.end() > safe:
                    break
                made.append(m.group())
                at = upto = m.end()
                before = begin + at - shift
                if before >= end and before in borders:
                    agreed = True
                    break
            if agreed or high == last:
                break
            more()
        if upto != len(new) and not agreed:
            raise ValueError("the pattern leaves out characters")
        self.encoded += at
        rest = new[at:]
        all_ = leaves[0] if len(leaves) == 1 else np.concatenate(leaves)
        gone = int(np.searchsorted(base + np.cumsum(all_[:, 0]), begin + at - shift, side="right")) if rest else len(all_)
        fresh = np.array([(len(p), self.encoder.piece_count(p)) for p in made], np.int64).reshape(-1, 2)
        each = np.concatenate([all_[:stay], fresh, all_[gone:]])
        text = whole[: begin - base] + new
        if high == low and len(each) <= 2 * WIDTH:
            self.blocks[low] = text, each
            self._update(low, each)
        else:
            self.blocks[low : high + 1] = self._cut(text, each)
            self._sum()
        return self.tokens

    def _update(self, block: int, each: np.ndarray) -> None:
        """The sums from a block up."""
        chars, tokens = each.sum(axis=0).tolist()
        k = self.half + block
        chars, tokens = chars - self.chars[k], tokens - self.counts[k]
        while k:
            self.chars[k] += chars
            self.counts[k] += tokens
            k //= 2


def revision(text: Column) -> Column:
    """The edits of the registered query, each on the text that the one before leaves: a note goes in the middle,
    then the first five characters are deleted, and a closing line is appended."""
    n = F.coalesce(F.char_length(text), F.lit(0)).cast("bigint")
    note = " (revised) "
    m = n + len(note) - 5
    one = lambda seq, start, end, by: F.struct(F.lit(seq).alias("seq"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), F.lit(by).alias("by"))
    half = F.floor(n / 2)
    return F.array(one(0, half, half, note), one(1, F.lit(0), F.lit(5), ""), one(2, m, m, "\nEnd of document."))


TREES = "doc_id long, n_tokens long, text binary, leaves binary"
EDITS = "array<struct<seq:int,start:bigint,end:bigint,by:string>>"


def trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: Column | None = None, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, text and leaves (characters and tokens of each pre-token) for each row of ``docs``, and with
    ``edits``, an array made of the columns of ``docs``, a column of that name. A null text is empty and has no tokens;
    repeated rows give repeated rows; extra columns are ignored."""
    path, pattern = path or public_path(), checked(pattern)
    small_batches(docs.sparkSession)
    more = [] if edits is None else ["edits"]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"), *[edits.cast(EDITS).alias(c) for c in more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            texts = [raw.decode("utf-8", "replace") for raw in b.column("text").to_pylist()]
            leaves = [e.sizes(t) for t in texts]
            counts = [int(np.frombuffer(x, "<u4")[1::2].sum(dtype=np.int64)) for x in leaves]
            columns = [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array([t.encode() for t in texts], pa.binary()), pa.array(leaves, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [b.column(c) for c in more], names=["doc_id", "n_tokens", "text", "leaves", *more])

    return rows.mapInArrow(run, TREES + "".join(f", {c} {EDITS}" for c in more))


def with_edits(index: DataFrame, edits: DataFrame) -> DataFrame:
    """The trees that a table of edits (doc_id, seq, start, end, by) is about, each with its edits in the order of seq.
    Edits of a document that has no tree are left out."""
    by = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("seq").cast("int").alias("seq"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.coalesce("by", F.lit("")).alias("by")))).alias("edits"))
    return index.join(by, "doc_id")


def edited(index: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Trees after their ``edits``, each of which is on the text that the one before leaves: doc_id, n_tokens, text,
    leaves, n_tokens_before, n_chars, and n_chars_encoded, the characters encoded for that. No edits change nothing."""
    path, pattern = path or public_path(), checked(pattern)
    small_batches(index.sparkSession)
    names = ["doc_id", "n_tokens", "text", "leaves", "n_tokens_before", "n_chars", "n_chars_encoded"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            rows = []
            for raw, leaves, before, edits in zip(*(b.column(c).to_pylist() for c in ("text", "leaves", "n_tokens", "edits")), strict=True):
                tree = TokenTree(e, raw.decode("utf-8", "replace"), leaves)
                for x in edits or ():
                    tree.edit(x["start"], x["end"], x["by"] or "")
                rows.append((tree.tokens, tree.text.encode(), tree.leaves, before, len(tree), tree.encoded))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=names)

    return index.select("doc_id", "n_tokens", "text", "leaves", "edits").mapInArrow(run, f"{TREES}, n_tokens_before long, n_chars long, n_chars_encoded long")


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: Column | None = None, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens (of the whole text), n_tokens_edited (after ``edits``, by default :func:`revision`),
    n_chars_edited and n_chars_encoded (characters encoded anew for that) for each row of ``docs``. A null text is
    empty and has no tokens; repeated rows give repeated rows; extra columns are ignored."""
    index = trees(docs, id_col, text_col, revision(F.col(text_col)) if edits is None else edits, path, pattern)
    return edited(index, path, pattern).select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.col("n_chars").alias("n_chars_edited"), "n_chars_encoded")
