"""FASTQ as a data source of Spark's Python API: files are read in ranges of bytes, each by a task.

What a file is, its first bytes tell where it is read: plain text, gzip in blocks that each state their size (each range
takes the blocks that begin in it), or gzip as one stream (the first range takes all of it). A range has the lines that
begin behind its first byte and up to its end, reads on until its last record is whole, and skips what belongs to the
range before. Which of its lines are headers, the lines themselves tell; where they leave two answers, the lines
before are counted. Records are cut out of a buffer by the places of its line feeds, all at once.

This module is sent to workers by value, so it needs nothing else of the package.
"""

from __future__ import annotations

import fnmatch
import json
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

NAME = "fastq_ranges"
STEP = 64 << 20
#: Bytes that are read at once, and of a block's header.
CHUNK, HEADER = 8 << 20, 18
#: Lines that must tell headers from scores, before the lines before them are counted.
ENOUGH = 4096
KIND = "path string, index long, header string, seq string, plus string, qual string"
COUNTS = "path string, start long, n long"


def opened(path: str):
    """A file for random access, in any store that Arrow reads."""
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (FileSystem.from_uri("file:///")[0], path)
    return fs.open_input_file(at)


def readable(path: str) -> bool:
    """Whether Arrow has a way into the store of this path."""
    from pyarrow.fs import FileSystem

    try:
        FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else "file://" + path)
    except Exception:  # not a known scheme, or its library is missing
        return False
    return True


def listed(paths: list[str], glob: str | None = None) -> list[tuple[str, int]]:
    """Files of more than no bytes and their sizes, in whole folders too, but for hidden ones."""
    from pyarrow.fs import FileSelector, FileSystem, FileType

    out = []
    for path in paths:
        uri = path if "://" in path or path.startswith("file:/") else "file://" + path
        fs, at = FileSystem.from_uri(uri)
        head = uri[: len(uri) - len(at)] if uri.endswith(at) else uri.split("://")[0] + "://"
        info = fs.get_file_info(at)
        found = [info] if info.type == FileType.File else [f for f in fs.get_file_info(FileSelector(at, recursive=True)) if not any(x[:1] in "_." for x in f.path[len(at) :].split("/") if x)]
        out += [(head + f.path, f.size) for f in found if f.type == FileType.File and f.size and (not glob or fnmatch.fnmatch(f.base_name, glob))]
    return sorted(set(out))


def _block(raw: bytes, at: int) -> int:
    """The size of the block that begins at this place, 0 if none does."""
    if raw[at : at + 4] != b"\x1f\x8b\x08\x04" or len(raw) < at + HEADER:
        return 0
    k, end = at + 12, at + 12 + int.from_bytes(raw[at + 10 : at + 12], "little")
    while k + 4 <= min(end, len(raw)):
        size = int.from_bytes(raw[k + 2 : k + 4], "little")
        if raw[k : k + 2] == b"BC" and size == 2:
            return int.from_bytes(raw[k + 4 : k + 6], "little") + 1
        k += 4 + size
    return 0


def kind_of(raw: bytes) -> str:
    """``plain``, ``gzip`` or ``blocks``, by the first bytes of a file."""
    return "plain" if raw[:2] != b"\x1f\x8b" else "blocks" if _block(raw, 0) else "gzip"


class Source:
    """The bytes of a range, unpacked, and then those that follow. ``owned``: how many there are of the range itself,
    once that is known."""

    def __init__(self, file, kind: str, start: int, end: int):
        self.file, self.kind, self.start, self.end, self.owned = file, kind, start, end, None

    def __iter__(self) -> Iterator[bytes]:
        return {"plain": self._plain, "gzip": self._gzip, "blocks": self._blocks}[self.kind]()

    def _plain(self) -> Iterator[bytes]:
        self.file.seek(self.start)
        left = self.end - self.start
        while left > 0 and (data := self.file.read(min(CHUNK, left))):
            left -= len(data)
            yield data
        self.owned = self.end - self.start - left
        while data := self.file.read(1 << 16):
            yield data

    def _gzip(self) -> Iterator[bytes]:
        if self.start == 0:  # all members, one after the other
            self.file.seek(0)
            z, total = zlib.decompressobj(31), 0
            while data := self.file.read(1 << 20):
                while data:
                    if z.eof:
                        if not data.strip(b"\0"):  # padding
                            break
                        z = zlib.decompressobj(31)
                    out = z.decompress(data, CHUNK)
                    data = z.unconsumed_tail if not z.eof else z.unused_data
                    total += len(out)
                    yield out
            if not z.eof:
                raise ValueError("a gzip file ends early")
            self.owned = total
        else:
            self.owned = 0

    def _first_block(self) -> int | None:
        """Where the first block at or behind ``start`` begins: one that another block, or the file's end, follows."""
        if self.start == 0:
            return 0
        size, self_end = self.file.size(), self.end
        at = self.start
        while at < self_end:
            self.file.seek(at)
            raw = self.file.read(1 << 18)
            k = raw.find(b"\x1f\x8b\x08\x04")
            while 0 <= k < self_end - at:
                if n := _block(raw, k) if k + 1024 <= len(raw) or at + len(raw) == size else 0:
                    self.file.seek(at + k + n)
                    if at + k + n == size or _block(self.file.read(1024), 0):
                        return at + k
                elif k + 1024 > len(raw) and at + len(raw) < size:
                    break  # to be seen whole in the next look
                k = raw.find(b"\x1f\x8b\x08\x04", k + 1)
            at += max(1, len(raw) - 1024)
        return None

    def _blocks(self) -> Iterator[bytes]:
        at, total = self._first_block(), 0
        if at is None or at >= self.end:
            self.owned = 0
            return
        size = self.file.size()
        while at < size:
            if at >= self.end and self.owned is None:
                self.owned = total
            self.file.seek(at)
            raw = self.file.read(CHUNK if self.owned is None else 1 << 17)
            k, out = 0, []
            while n := _block(raw, k):
                if k + n > len(raw) or self.owned is None and at + k >= self.end:
                    break
                z = zlib.decompressobj(31)
                out.append(z.decompress(raw[k : k + n]))
                if not z.eof:
                    raise ValueError("a block of a gzip file ends early")
                k += n
            if not k and not (self.owned is None and at >= self.end):
                raise ValueError("a gzip file of blocks ends early")
            at += k
            data = b"".join(out)
            total += len(data)
            yield data
        if self.owned is None:
            self.owned = total


def _fits(lines: list[bytes], phase: int) -> bool:
    """Whether lines from this one on are records."""
    for k in range(phase, len(lines), 4):
        r = lines[k : k + 4]
        if r[0][:1] != b"@" or len(r) > 2 and r[2][:1] != b"+" or len(r) > 3 and len(r[1].rstrip(b"\r")) != len(r[3].rstrip(b"\r")):
            return False
    return all(x[:1] == b"+" for x in lines[phase - 2 : phase - 1] if phase >= 2)


def _lines_before(path: str, kind: str, start: int) -> int:
    """How many lines begin up to ``start``, by counting."""
    n = 1
    with opened(path) as f:
        source = Source(f, kind, 0, start)
        for data in source:
            if source.owned is not None:
                break
            n += data.count(b"\n")
    return n


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes from each start to its end as text; what isn't UTF-8 is left out."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    taken = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    if len(taken) and taken.max() > 127:
        raw = taken.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "ignore") for a, b in zip(offsets, offsets[1:], strict=False)], pa.string())
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken))


def _cut(buf: bytes, n: int | None, ids_only: bool) -> tuple[list[pa.Array], np.ndarray]:
    """The columns of the whole records of a buffer that begins with one, and where each record begins, with the end of the
    last. ``n``: at most so many."""
    data = np.frombuffer(buf, np.uint8)
    feeds = np.flatnonzero(data == 10)
    feeds = feeds[: len(feeds) // 4 * 4]
    starts = np.concatenate([[0], feeds + 1])
    if n is not None:
        feeds, starts = feeds[: 4 * n], starts[: 4 * n + 1]
    back = np.zeros(len(feeds), np.int64)
    some = feeds > starts[:-1]
    back[some] = data[feeds[some] - 1] == 13
    ends = feeds - back
    columns = [_strings(data, starts[c:-1:4], ends[c::4]) for c in range(1 if ids_only else 4)]
    return columns, starts[::4]


def records(path: str, kind: str, start: int, end: int, line: int | None, ids_only: bool) -> Iterator[pa.RecordBatch]:
    """The records of a range, in batches. ``line``: the number of its first line, if known; else places count from the
    range's first record where it isn't the file's first."""
    with opened(path) as f:
        source = Source(f, kind, start, end)
        buf, at, skip, synced, index = b"", 0, start > 0, start == 0, 0
        chunks = iter(source)

        def batch(columns: list[pa.Array], n: int) -> pa.RecordBatch:
            places = pa.array(np.arange(index, index + n)) if start == 0 or line is not None else pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), places, *columns], names=[x.split()[0] for x in KIND.split(", ")][: 2 + len(columns)])

        for data in chunks:
            buf += data
            if skip:
                k = buf.find(b"\n")
                if k < 0:
                    continue
                buf, at, skip = buf[k + 1 :], k + 1, False
            if source.owned is not None and at > source.owned:
                return
            if not synced:
                if line is not None:
                    phase = -line % 4
                else:
                    lines = buf.split(b"\n")[:-1]
                    fit = [p for p in range(min(4, len(lines))) if _fits(lines, p)]
                    if (len(fit) != 1 or len(lines) < 8) and len(lines) < ENOUGH and source.owned is None:
                        continue
                    phase = fit[0] if len(fit) == 1 and len(lines) >= 8 else -_lines_before(path, kind, start) % 4
                lines = buf.split(b"\n", phase)
                if len(lines) <= phase:
                    continue
                at += len(buf) - len(lines[-1])
                buf, synced = lines[-1], True
                if line is not None:
                    index = (line + phase) // 4
            columns, starts = _cut(buf, None, ids_only)
            n = len(starts) - 1
            if source.owned is not None:
                n = int(np.searchsorted(starts[:-1] + at, source.owned, "right"))
                if n < len(starts) - 1:
                    columns = [c.slice(0, n) for c in columns]
            if n:
                yield batch(columns, n)
                index += n
            buf, at = buf[starts[n] :], at + int(starts[n])
            if source.owned is not None and at > source.owned:
                return
        if skip or not synced and start > 0 and line is None and not buf.strip():
            return
        if not synced:  # a range of few lines at the end of a file
            phase = -(line if line is not None else _lines_before(path, kind, start)) % 4
            lines = buf.split(b"\n", phase)
            if len(lines) <= phase:
                return
            at += len(buf) - len(lines[-1])
            buf, index = lines[-1], index if line is None else (line + phase) // 4
        if at > source.owned or not buf.strip():  # blank lines at the end are no record
            return
        lines = [x.removesuffix(b"\r").decode("utf-8", "ignore") for x in buf.split(b"\n")]
        lines = lines[:-1] if lines[-1] == "" and len(lines) > 1 else lines
        width = 1 if ids_only else 4
        whole = [lines[k : k + 4] for k in range(0, len(lines), 4)]
        yield batch([pa.array([(r + [None] * 4)[c] for r in whole], pa.string()) for c in range(width)], len(whole))


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, line: int | None):
        self.path, self.start, self.end, self.line = path, start, end, line


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.counting, self.ids_only, self.strict = (options.get(k) == "true" for k in ("counting", "idsonly", "strict"))
        self.step = int(options.get("step", STEP))
        self.files = [tuple(x) for x in json.loads(options["files"])] if "files" in options else None
        self.paths, self.glob = json.loads(options.get("paths", "[]")) or [options.get("path", "")], options.get("pathglobfilter")
        self.counts = {(p, s): n for p, s, n in json.loads(options.get("counts", "[]"))}

    def partitions(self) -> list[Range]:
        out = []
        for path, size in self.files if self.files is not None else listed(self.paths, self.glob):
            line: int | None = 1
            for start in range(0, size, self.step):
                if not (self.counting and size <= self.step):
                    out.append(Range(path, start, min(size, start + self.step), (0 if start == 0 else line) if self.counts else None))
                line += self.counts.get((path, start), 0)
        return out or [Range("", 0, 0, None)]

    def read(self, p: Range) -> Iterator[pa.RecordBatch]:
        if not p.path:
            return
        with opened(p.path) as f:
            kind = kind_of(f.read(1024))
        if self.strict and kind == "plain" and p.path.endswith(".gz"):
            raise ValueError(f"{p.path} isn't gzip")
        if kind == "gzip" and p.start > 0:
            return
        if not self.counting:
            yield from records(p.path, kind, p.start, p.end, p.line, self.ids_only)
        elif kind != "gzip":
            n = 0
            with opened(p.path) as f:
                source = Source(f, kind, p.start, p.end)
                for data in source:
                    if source.owned is not None:
                        break
                    n += data.count(b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([p.path]), pa.array([p.start], pa.int64()), pa.array([n], pa.int64())], names=["path", "start", "n"])


class FastqSource(DataSource):
    """``spark.read.format("fastq_ranges").load(path)`` after :func:`register`; see :func:`readers.fastq`, which also counts
    lines so that ``index`` is known in files of several ranges (here it is NULL behind the first range)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COUNTS if self.options.get("counting") == "true" else ", ".join(KIND.split(", ")[: 3 if self.options.get("idsOnly") == "true" else 6])

    def reader(self, schema: StructType) -> FastqReader:
        return FastqReader(dict(self.options))


def register(spark) -> None:
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FastqSource)
