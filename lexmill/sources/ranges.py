"""A data source of text files by byte ranges: numbered lines, lines a range, and digests of files of any size.

Files are cut into ranges of about ``split`` bytes; a line belongs to the range that its first byte is in. A first read
returns how many lines each range has, a number a range; with the sums of those before it, every range of the second
read numbers its own lines. So no text is exchanged, and no table of ranges is joined to it. Compressed files (.gz) are one range.
Ranges are larger where ``split`` would make over ``MOST`` of them. With ``across`` the files of a folder, in the order of their names,
count as one: a folder that many tasks wrote, each a stretch of its order, has the numbers and the digest of one file.
Blocks are streamed: a digest holds one block, numbered lines hold one block and the line at hand.

Paths go through Arrow's file systems, which know local files and the common stores; ``listing`` returns None for others.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 8 << 20
SPLIT = 128 << 20
MOST = 256
BOM = b"\xef\xbb\xbf"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listing(paths: list[str]) -> list[tuple[str, int]] | None:
    """(path, bytes) of the files that the paths name or hold, hidden ones left out; None where a path is a pattern or its store is unknown."""
    out = []
    for path in paths:
        if any(c in path for c in "*?[{"):
            return None
        try:
            store, inner = opened(path)
        except (pa.ArrowInvalid, NotImplementedError, OSError):  # no such store, or its library is not installed
            return None
        head = path[: len(path) - len(inner)] if "://" in path and path.endswith(inner) else "file://"
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(inner, recursive=True)) if x.type == fs.FileType.File]
        named = [x for x in found if not any(n.startswith(("_", ".")) for n in x.path[len(inner) :].split("/"))]
        out += sorted((head + x.path, x.size) for x in named)
    return out


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    before: int = 0
    files: tuple[str, ...] = ()


def folder_of(path: str) -> str:
    return path.rpartition("/")[0]


def blocks(path: str, start: int = 0, end: int | None = None) -> Iterator[bytes]:
    """The bytes of a file from start, to end if given; compressed ones as they are read."""
    store, inner = opened(path)
    if path.endswith(".gz"):
        with store.open_input_stream(inner, compression="gzip") as f:
            while b := f.read(BLOCK):
                yield b
        return
    with store.open_input_file(inner) as f:
        f.seek(start)
        while (end is None or start < end) and (b := f.read(BLOCK if end is None else min(BLOCK, end - start))):
            start += len(b)
            yield b


def breaks(parts: Iterator[bytes]) -> tuple[int, bytes]:
    """Line ends among the bytes, line feeds and carriage returns that none follows; and the last byte."""
    n, last = 0, b""
    for b in parts:
        a = np.frombuffer(b, np.uint8)
        feeds, returns = a == 10, np.flatnonzero(a == 13)
        n += int(feeds.sum()) + len(returns)
        n -= int(feeds[returns[returns + 1 < len(a)] + 1].sum()) + (last == b"\r" and a[0] == 10)
        last = b[-1:]
    return n, last


def all_lines(parts: Iterator[bytes]) -> int:
    n, last = breaks(parts)
    return n + (last not in (b"", b"\n", b"\r"))


def first_lines(part: Range) -> int:
    """How many lines begin in a range, or are in a compressed file."""
    if part.path.endswith(".gz"):
        return all_lines(blocks(part.path))
    if part.start >= part.end:
        return 0
    first = max(0, part.start - 1)
    n = breaks(blocks(part.path, first, part.end - 1))[0] + (part.start == 0)
    if part.end - 1 > first:  # a return whose line feed is the range's last byte begins no line there
        last = b"".join(blocks(part.path, part.end - 2, part.end))
        n -= last == b"\r\n"
    return n


def range_lines(part: Range) -> Iterator[list[bytes]]:
    """The lines that begin in a range, a block's at a time."""
    at, rest, skip = max(0, part.start - 1), [], part.start > 0
    whole = part.path.endswith(".gz")
    head = part.start == 0

    def taken(data: bytes) -> tuple[list[bytes], bool]:
        nonlocal at, skip, head
        out, over = [], False
        for line in data.splitlines(keepends=True):
            if skip:
                skip = False
            elif not whole and at >= part.end:
                over = True
                break
            else:
                out.append(line.rstrip(b"\r\n").removeprefix(BOM if head else b""))
            head = False
            at += len(line)
        return out, over

    for b in blocks(part.path, at):
        limit = len(b) - b.endswith(b"\r")
        cut = max(b.rfind(b"\n", 0, limit), b.rfind(b"\r", 0, limit)) + 1
        if not cut:
            rest.append(b)
            if sum(map(len, rest)) > (1 << 31) - 1:
                raise ValueError(f"{part.path}: a line of over 2 GB at byte {at}")
            continue
        out, over = taken(b"".join([*rest, b[:cut]]))
        rest = [b[cut:]] if cut < len(b) else []
        if out:
            yield out
        if over or (not whole and at >= part.end and not skip):
            return
    if rest:
        out, _ = taken(b"".join(rest))
        if out:
            yield out


class TextRanges(DataSource):
    """Options: paths (JSON list of (path, bytes)), mode (counts, lines or digests), split, across, before (JSON: lines before each range, by path)."""

    @classmethod
    def name(cls) -> str:
        return "text_ranges"

    def schema(self) -> str:
        return {"counts": "path string, start long, n long", "lines": "path string, line_no long, value string", "digests": "path string, bytes long, sha256 string, records long"}[self.options["mode"]]

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(self.options)


class RangeReader(DataSourceReader):
    def __init__(self, options):
        self.mode, self.across = options["mode"], options.get("across") == "true"
        self.sizes = dict(map(tuple, json.loads(options["paths"])))
        self.before = json.loads(options.get("before", "{}"))
        self.split = max(int(options["split"]), min(SPLIT, -(-sum(self.sizes.values()) // MOST)))

    def partitions(self) -> list[Range]:
        out = []
        if self.mode == "digests":
            whole: dict[str, list[str]] = {}
            for path in sorted(self.sizes):
                whole.setdefault(folder_of(path) if self.across else path, []).append(path)
            out = [Range(path, 0, sum(map(self.sizes.get, files)), 0, tuple(files)) for path, files in whole.items()]
            return out or [Range("", 0, 0)]
        for path, size in self.sizes.items():
            step = size if path.endswith(".gz") else self.split
            starts = list(range(0, size, max(1, step)))
            if self.mode == "counts" and len(starts) < 2 and not self.across:
                continue  # nothing is before the only range
            out += [Range(path, s, min(size, s + max(1, step)), n) for s, n in zip(starts, self.before.get(path, [0] * len(starts)))]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        if self.mode == "counts":
            yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([part.start]), pa.array([first_lines(part)])], names=["path", "start", "n"])
        elif self.mode == "digests":
            digest = hashlib.sha256()

            def stored() -> Iterator[bytes]:
                for path in part.files:
                    store, inner = opened(path)
                    with store.open_input_stream(inner, compression=None) as f:
                        while b := f.read(BLOCK):
                            digest.update(b)
                            yield b

            if any(path.endswith(".gz") for path in part.files):
                deque(stored(), 0)
                n = all_lines(b for path in part.files for b in blocks(path))
            else:
                n = all_lines(stored())
            yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([part.end]), pa.array([digest.hexdigest()]), pa.array([n])], names=["path", "bytes", "sha256", "records"])
        else:
            n = part.before
            for lines in range_lines(part):
                for at in range(0, len(lines), 4096):
                    some = [x.decode("utf-8", "replace") for x in lines[at : at + 4096]]
                    yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(some)), pa.array(np.arange(n + 1, n + 1 + len(some))), pa.array(some, pa.string())], names=["path", "line_no", "value"])
                    n += len(some)


def _read(spark: SparkSession, files: list[tuple[str, int]], mode: str, split: int, across: bool, **more: str) -> DataFrame:
    spark.dataSource.register(TextRanges)
    return spark.read.format("text_ranges").options(paths=json.dumps(files), mode=mode, split=str(split), across=str(across).lower(), **more).load()


def numbered(spark: SparkSession, files: list[tuple[str, int]], split: int = SPLIT, across: bool = False) -> DataFrame:
    """Rows (path, line_no, value), numbers from 1 in each file; across: in each folder."""
    before: dict[str, list[int]] = {}
    so_far: dict[str, int] = {}
    for r in sorted(_read(spark, files, "counts", split, across).collect()):  # a number a range
        whole = folder_of(r.path) if across else r.path
        before.setdefault(r.path, []).append(so_far.get(whole, 0))
        so_far[whole] = so_far.get(whole, 0) + r.n
    return _read(spark, files, "lines", split, across, before=json.dumps(before))


def digests(spark: SparkSession, files: list[tuple[str, int]], across: bool = False) -> DataFrame:
    """Rows (path, bytes, sha256, records): each file, or folder of files, streamed by one task, block by block, whatever its size."""
    return _read(spark, files, "digests", SPLIT, across)
