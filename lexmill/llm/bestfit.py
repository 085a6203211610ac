"""Best-fit packing of documents into windows by bulk-synchronous sweeps.

A task encodes the texts that it reads. What is longer than a window is cut into full windows behind a shorter first
piece; a full piece is a sequence, and so is for now one of over half a window, since no two of those share one.
The rest waits. Then, for the sizes down to a half, a quarter, an eighth of the window and so on, a superstep:

1. Waiting documents of those sizes and gaps that may hold one are sorted together by size, largest first, into
   ranges. Each task sweeps its range: a document takes its successor, the smallest gap of the range that holds it;
   what is left of the gap can be taken again at once. Where several documents have one successor, the larger one
   wins, among equals the one of lower rank (a hash of its row), and the others go to the next gap.
2. Documents that found no gap in their range take one that a range of larger sizes has left, the nearest such range
   first: four numbers a range say how many each has over and how many each lacks, gaps and documents meet by their
   ranks, and the same sweep runs again. Only a document that no gap holds then opens a sequence.
3. The gaps are updated, and the next sizes follow.

Every state is a table of thin rows in the checkpoint folder, so lost executors repeat one step of one superstep. A
range holds about ``rows_per_task`` rows: equal sizes are told apart by their ranks, so no size is a hot key.

Defined cases: null text is empty (the end id alone); equal rows are packed one by one; a null id is an id like
others; an empty table gives no rows; columns beyond the id and the text take no part, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, cut, small_batches
from .packing import _byte_letters
from .spm import tokenizer_path

WINDOW = 2048
WAITS, GAP, PLACED = 0, 1, 2
# white space of Unicode, as the byte-level kind of vocabulary file splits by it (fixed values)
SPACE = "\\t-\\r \\x85\\xa0  -     　"
CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^ {LETTER}0-9]+")
IS_PLAIN = re.compile(f" ?[!-~{LETTER}]+").fullmatch


class Chunks:
    """Token ids of texts, as little-endian unsigned 32-bit bytes, for a byte-level vocabulary file.

    Its splitting never joins across the start of a word with the space before it, so texts are cut there and what was
    met before is remembered, at most about ``memory`` such chunks of at most ``longest`` characters. A new chunk of
    ASCII and Latin letters is cut on into runs of letters, digits and marks, which the library's model encodes once
    each; other chunks, and texts that spell a special token, go to the library whole."""

    def __init__(self, path: str, memory: int = 600_000, longest: int = 128):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.letters = self.tok.model, _byte_letters()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.known, self.parts = Memory(self._chunk, memory, longest), Memory(self._part, memory // 2, longest)

    def _part(self, part: str) -> bytes:
        shown = part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if IS_PLAIN(chunk) is None:
            return self._whole(chunk)
        parts = PARTS.findall(chunk)
        return self._part(chunk) if len(parts) == 1 else b"".join([self.parts[p] for p in parts])

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._whole(text)
        known = self.known
        return b"".join([known[c] for c in CHUNKS.findall(text)])

    def make_room(self) -> None:
        self.known.make_room()
        self.parts.make_room()


class Gaps:
    """Open sequences by the room they have; ``levels`` has a bit for each room that occurs."""

    def __init__(self, window: int):
        self.window, self.levels, self.at = window, 0, {}

    def add(self, room: int, sequence: int) -> None:
        if room:
            self.levels |= 1 << room
            self.at.setdefault(room, []).append(sequence)

    def take(self, size: int) -> tuple[int, int] | None:
        """The sequence of the smallest gap of at least size, and the offset there; the rest of the gap stays."""
        fits = self.levels >> size
        if not fits:
            return None
        room = size + (fits & -fits).bit_length() - 1
        same = self.at[room]
        sequence = same.pop()
        if not same:
            self.levels ^= 1 << room
        self.add(room - size, sequence)
        return sequence, self.window - room

    def left(self) -> Iterator[tuple[int, int]]:
        """Room and sequence of all gaps, largest first."""
        for room in sorted(self.at, reverse=True):
            for sequence in self.at[room]:
                yield room, sequence


def cut_sizes(n: int, window: int) -> list[tuple[int, int]]:
    """Start and length of each piece of n tokens: full windows behind a shorter first piece."""
    first = n % window
    return [(0, first)] * (first > 0) + [(s, window) for s in range(first, n, window)]


STATE = ["kind", "size", "tie", "id", "piece", "start", "crc", "sequence", "offset", "part", "rank"]
TYPES = [pa.int8(), pa.int32(), pa.int64(), None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]


def _ddl(id_kind: str) -> str:
    return f"kind tinyint, size int, tie long, id {id_kind}, piece int, start long, crc long, sequence long, offset int, part int, rank long"


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(STATE)
    return pa.RecordBatch.from_arrays([pa.array(c, t or kind) for c, t in zip(cols, TYPES)], names=STATE)


_CHUNKS: dict[str, Chunks] = {}


def pieces(df: DataFrame, vocabulary: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """The first state: pieces that have a sequence, the gaps of these sequences, and pieces that wait."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary if "/" in vocabulary else tokenizer_path(vocabulary)
        if path not in _CHUNKS:
            _CHUNKS[path] = Chunks(path)
        chunks, end = _CHUNKS[path], np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        number = part << 36
        for b in small_batches(batches, "text"):
            chunks.make_room()
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = chunks.encode(text or "") + end
                for i, (start, size) in enumerate(cut_sizes(len(ids) // 4, window)):
                    number += 1
                    alone = size * 2 > window
                    rows.append((PLACED if alone else WAITS, size, number, doc, i, start, zlib.crc32(ids[4 * start : 4 * (start + size)]), (1 << 61) + number if alone else None, 0 if alone else None, part, -1))
                    if alone and size < window:
                        rows.append((GAP, window - size, number, None, None, None, None, (1 << 61) + number, None, part, -1))
            yield _batch(rows, b.column(0).type)

    src = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    # a row's rank is a hash of its number: equal sizes come in no order of the input
    return src.mapInArrow(run, _ddl(dict(df.dtypes)[id_col])).withColumn("tie", F.xxhash64("tie"))


def _sweep(columns: dict[str, list[Any]], gaps: Gaps, opens: Iterator[int] | None) -> list[tuple]:
    """Rows of a batch that is sorted by size, gaps first among equals: documents take gaps or, with opens, a new sequence."""
    out = []
    for kind, size, tie, doc, piece, start, crc, sequence in zip(*[columns[c] for c in STATE[:8]]):
        if kind == GAP:
            gaps.add(size, sequence)
            continue
        found = gaps.take(size)
        if found is None and opens is not None:
            found = next(opens), 0
            gaps.add(gaps.window - size, found[0])
        out.append((PLACED if found else WAITS, size, tie, doc, piece, start, crc, *(found or (None, None))))
    return out


def in_ranges(rows: DataFrame, window: int, tasks: int) -> DataFrame:
    """Step 1: the state after each task has swept its range of sizes. Ranks number what a range has left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps, part, waiting, least, kind = Gaps(window), TaskContext.get().partitionId(), 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            kind, cols, out = b.schema.field("id").type, b.to_pydict(), []
            least = cols["size"][-1]
            for r in _sweep(cols, gaps, None):
                out.append((*r, part, waiting if r[0] == WAITS else -1))
                waiting += r[0] == WAITS
            yield _batch(out, kind)
        if kind is not None:
            # what is smaller than the range holds none of the documents behind it for sure
            left = [(GAP, room, 0, None, None, None, None, s, None, part, i if room >= least else -1) for i, (room, s) in enumerate(gaps.left())]
            yield _batch(left, kind)

    # ties keep equal sizes apart
    ranged = rows.repartitionByRange(tasks, F.desc("size"), F.asc("tie")).sortWithinPartitions(F.desc("size"), F.desc("kind"), F.asc("tie"))
    return ranged.mapInArrow(run, rows.schema)


def allot(ranges: list[tuple[int, int, int, int, int]], rows_per_task: int) -> tuple[dict[int, int], dict[int, list[tuple[int, int, int]]]]:
    """Which group a range's waiting documents go to, and which ranks of a range's gaps go to which group.

    ranges: number, waiting documents and their tokens, gaps and their room, in order of falling size. A document's
    nearest larger range is asked first, and there the smallest gaps; several documents may share one."""
    group_of: dict[int, int] = {}
    gaps_to: dict[int, list[tuple[int, int, int]]] = {}
    stack: list[list[float]] = []
    group, held = 0, 0
    for number, docs, tokens, gaps, room in ranges:
        if docs:
            if held and held + docs > rows_per_task:
                group, held = group + 1, 0
            group_of[number], held = group, held + docs
            while docs > 0 and stack:
                source, over, mean = stack[-1]
                each = max(1, int(mean * group_docs(docs, tokens)))
                n = int(min(over, -(-docs // each)))
                gaps_to.setdefault(int(source), []).append((int(over) - n, int(over), group))
                tokens -= tokens * min(1.0, n * each / docs)
                docs -= n * each
                stack[-1][1] -= n
                if not stack[-1][1]:
                    stack.pop()
        if gaps:
            stack.append([number, gaps, room / gaps])
    return group_of, gaps_to


def group_docs(docs: float, tokens: float) -> float:
    """Documents a token."""
    return docs / tokens if tokens else 1.0


def across_ranges(state: DataFrame, window: int, step: int, rows_per_task: int) -> tuple[DataFrame | None, DataFrame]:
    """Step 2: the state of the documents that wait and of the gaps allotted to them, and the gaps that aren't."""
    n, size = F.count_if, F.col("size")
    waits, carried = F.col("kind") == WAITS, (F.col("kind") == GAP) & (F.col("rank") >= 0)
    met = state.groupBy("part").agg(n(waits), F.sum(F.when(waits, size)), n(carried), F.sum(F.when(carried, size))).collect()  # four numbers a range
    group_of, gaps_to = allot(sorted((r[0], r[1], r[2] or 0, r[3], r[4] or 0) for r in met), rows_per_task)
    if not group_of:
        return None, state.where(F.col("kind") == GAP)
    spark = state.sparkSession
    plan = [(p, WAITS, 0, 1 << 62, g) for p, g in group_of.items()] + [(p, GAP, a, b, g) for p, spans in gaps_to.items() for a, b, g in spans]
    plan = F.broadcast(spark.createDataFrame(plan, "part int, kind tinyint, low long, high long, `group` int"))  # a few rows a range
    left = state.where(F.col("kind") != PLACED).join(plan.withColumnsRenamed({"part": "p", "kind": "k"}), (F.col("part") == F.col("p")) & (F.col("kind") == F.col("k")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")

    def run(table: pa.Table) -> pa.Table:
        group, kind = table.column("group")[0].as_py(), table.schema.field("id").type
        gaps = Gaps(window)
        opens = iter(range((step << 54) + (group << 32), (step << 54) + ((group + 1) << 32)))
        cols = table.sort_by([("size", "descending"), ("kind", "descending"), ("tie", "ascending")]).to_pydict()
        # gaps and documents of different ranges meet: every gap is there before the first document
        for k, s, sequence in zip(cols["kind"], cols["size"], cols["sequence"]):
            if k == GAP:
                gaps.add(s, sequence)
        docs = [i for i, k in enumerate(cols["kind"]) if k == WAITS]
        out = [(*r, group, -1) for r in _sweep({c: [cols[c][i] for i in docs] for c in STATE}, gaps, opens)]
        out += [(GAP, room, 0, None, None, None, None, s, None, group, -1) for room, s in gaps.left()]
        return pa.Table.from_batches([_batch(out, kind)])

    swept = left.where(F.col("group").isNotNull()).select(*STATE, "group").groupBy("group").applyInArrow(run, state.schema)
    kept = left.where((F.col("kind") == GAP) & F.col("group").isNull()).select(*STATE)
    return cut(swept), kept


def pack_best_fit(df: DataFrame, vocabulary: str, end_id: int = 0, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", rows_per_task: int = 1 << 14) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    first = cut(pieces(df, vocabulary, end_id, window, id_col, text_col))
    waiting, gaps, done = first.where(F.col("kind") == WAITS), first.where(F.col("kind") == GAP), [first.where(F.col("kind") == PLACED)]
    # superstep i has the sizes from window / 2^(i+1) down to window / 2^(i+2); the last one has all that is smaller
    last = max(1, window.bit_length() - 5)
    of_size = sum(((F.col("size") * (1 << k) <= window).cast("int") for k in range(1, last + 1)), F.lit(0))
    counted = dict(waiting.groupBy(of_size).count().collect())
    for step in sorted(counted):
        low = 0 if step == last else window >> (step + 1)
        docs = waiting.where(of_size == step)
        # a gap of low or less holds none of these documents
        rows = docs.unionByName(gaps.where(F.col("size") > low).withColumn("tie", F.xxhash64("sequence")))
        swept = cut(in_ranges(rows, window, max(1, -(-rows.count() // rows_per_task))))
        met, kept = across_ranges(swept, window, int(step), rows_per_task)
        done += [swept.where(F.col("kind") == PLACED)] + ([met.where(F.col("kind") == PLACED)] if met is not None else [])
        gaps = gaps.where(F.col("size") <= low).unionByName(kept)
        if met is not None:
            gaps = gaps.unionByName(met.where(F.col("kind") == GAP))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id").alias(id_col), "piece", "start", F.col("size").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
