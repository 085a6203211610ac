"""Packing documents into fixed windows by the sum-of-squares rule.

Each task packs the documents of its own input split as they come: no row is shuffled. A document is cut
at multiples of the window; the rest of it goes, whole, to the open fill level h (or to a new window) that
leaves the sum of squared counts of partially filled windows smallest, by a level array N: moving a window
from h to h+s changes that sum by 2(N[h+s]-N[h])+2, opening one at s by 2N[s]+1, filling one up by 1-2N[h].
Ties go to the fullest window. At the end of the split windows are closed: the emptiest ones' pieces are cut to
fill the fullest, so that one partial window is left at most, which is given out in stretches whose lengths
are powers of two. Open windows hold ids of their own split alone, at most four bytes a token of it.

Which documents share a sequence follows the order in which a task reads its rows: files give the same one
each time; sort or write a table first where rows come out of a shuffle and a task may run again.

Defined cases: null text is empty (the end id alone); equal rows are packed one by one; columns beyond the id
and the text take no part, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import Memory, small_batches
from .spm import tokenizer_path

WINDOW = 4096


# What the fast way needs of a vocabulary file: its normaliser and its splitting (fixed values of the CLIP kind of file).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = r"\t\r!-~À-ÖØ-öø-įĲ-ſ"  # composed Latin letters and ASCII: their categories and cases are beyond doubt
# letters and digits first: only contractions and marks share a first character
PARTS = re.compile(r"[a-zÀ-ÖØ-öø-ſ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-z0-9À-ÖØ-öø-ſ]+")
IS_PLAIN = re.compile(f"[{PLAIN}]*").fullmatch


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabets show printable Latin-1 characters as themselves and the other bytes from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    Words between white space are remembered. A new one is lower-cased and cut as the vocabulary file says, and each
    of its parts (a run of letters, a digit, a run of marks) is encoded by the library's model once and remembered
    as well: words differ mostly in capitals and marks. Words with characters outside ASCII and composed Latin, or
    like special tokens, go to the library whole, and so do whole texts where the file's normaliser or splitting is
    another. At most about ``memory`` words and half as many parts are remembered, none of more than ``longest``
    characters."""

    def __init__(self, path: str, memory: int = 700_000, longest: int = 128):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.letters = self.tok.model, _byte_letters()
        self.known, self.parts = Memory(self._word, memory, longest), Memory(self._part, memory // 2, longest)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        steps = [x.get("type") for x in (said.get("normalizer") or {}).get("normalizers", [])]
        cuts = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_words = (
            steps == ["NFC", "Replace", "Lowercase"] and len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": SPLIT} and cuts[0].get("invert") is True
            and cuts[1].get("type") == "ByteLevel" and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex")
        )
        self.special = {t["content"][:2] for t in said.get("added_tokens", [])}

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()) and IS_PLAIN(word) is None or any(map(word.__contains__, self.special)):
            return self._whole(word)
        low = word.lower()
        return self.parts[low] if low.isalpha() else b"".join([self.parts[p] for p in PARTS.findall(low)])

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        self.known.make_room()
        self.parts.make_room()
        known = self.known
        for text in texts:
            if self.by_words:
                yield b"".join([known[w] for w in text.replace("\n", " ").split(" ")])
            else:
                yield self._whole(text)

    def ids(self, text: str) -> bytes:
        return next(self.encode([text]))


class Packer:
    """Sum-of-squares packing of one split. A piece is (doc, start, ids as bytes, doc_tokens)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.done: list[list[tuple]] = []

    def add(self, doc, ids: bytes) -> None:
        n, c = len(ids) // 4, self.window
        at = 0
        while n - at >= c:
            self.done.append([(doc, at, ids[4 * at : 4 * (at + c)], n)])
            at += c
        if at < n:
            self.place((doc, at, ids[4 * at :], n))

    def place(self, piece: tuple) -> None:
        size, c, count = len(piece[2]) // 4, self.window, self.count
        # change of the sum of squares for each open level h with h+size <= window
        levels = np.flatnonzero(count[1 : c - size + 1]) + 1
        best, cost = 0, 2 * int(count[size]) + 1
        if len(levels):
            to = levels + size
            change = np.where(to == c, 1 - 2 * count[levels], 2 * (count[to] - count[levels]) + 2)
            i = len(levels) - 1 - int(np.argmin(change[::-1]))
            if change[i] <= cost:
                best = int(levels[i])
        pieces = []
        if best:
            pieces = self.open[best].pop()
            count[best] -= 1
        pieces.append(piece)
        if best + size == c:
            self.done.append(pieces)
        else:
            self.open.setdefault(best + size, []).append(pieces)
            count[best + size] += 1

    def close(self) -> None:
        """Fill the fullest open windows with pieces of the emptiest, cutting where needed; one partial window may stay open."""
        windows = [(level, w) for level in sorted(self.open) for w in self.open[level]]
        self.open, self.count[:] = {}, 0
        lo, hi = 0, len(windows) - 1
        while lo < hi:
            level, pieces = windows[hi]
            gap, source = self.window - level, windows[lo][1]
            while gap and source:
                doc, start, ids, n = source.pop()
                take = min(gap, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * take], n))
                if 4 * take < len(ids):
                    source.append((doc, start + take, ids[4 * take :], n))
                gap -= take
            windows[lo] = (sum(len(p[2]) // 4 for p in source), source)
            if gap:
                windows[hi] = (self.window - gap, pieces)
            else:
                self.done.append(pieces)
                hi -= 1
            if not source:
                lo += 1
        if lo == hi:
            level, pieces = windows[lo]
            if level == self.window:
                self.done.append(pieces)
            elif pieces:
                self.open[level], self.count[level] = [pieces], 1

    def end(self) -> None:
        self.close()
        for windows in self.open.values():
            for pieces in windows:
                left = sum(len(p[2]) // 4 for p in pieces)
                while left:
                    gap = 1 << (left.bit_length() - 1)
                    left -= gap
                    part = []
                    while gap:
                        doc, start, ids, n = pieces.pop(0)
                        take = min(gap, len(ids) // 4)
                        part.append((doc, start, ids[: 4 * take], n))
                        if 4 * take < len(ids):
                            pieces.insert(0, (doc, start + take, ids[4 * take :], n))
                        gap -= take
                    self.done.append(part)
        self.open = {}


_WORDS: dict[str, Words] = {}


def pack(df: DataFrame, vocabulary: str, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with with_ids the token ids."""
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary if "/" in vocabulary else tokenizer_path(vocabulary)
        if path not in _WORDS:
            _WORDS[path] = Words(path)
        words = _WORDS[path]
        end, packer = np.array([end_id], "<u4").tobytes(), Packer(window)
        kind = None
        seq = TaskContext.get().partitionId() << 40

        def flush() -> pa.RecordBatch:
            nonlocal seq
            rows, docs, raw = [], [], []
            for pieces in packer.done:
                offset = 0
                for doc, start, part, n in pieces:
                    docs.append(doc)
                    rows.append((start, len(part) // 4, zlib.crc32(part), n, seq, offset))
                    offset += len(part) // 4
                    if with_ids:
                        raw.append(np.frombuffer(part, "<u4").astype(np.int64))
                seq += 1
            packer.done = []
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6
            cols += [pa.array(raw, pa.list_(pa.int64()))] if with_ids else []
            return pa.RecordBatch.from_arrays([pa.array(docs, kind), *cols], names=["id", *names, *["ids"] * with_ids])

        for b in small_batches(batches, "text", 1 << 20):
            kind, docs = b.column(0).type, b.column(0).to_pylist()
            for doc, raw in zip(docs, words.encode([t or "" for t in b.column(1).to_pylist()])):
                packer.add(doc, raw + end)
            yield flush()
        if kind is not None:
            packer.end()
            yield flush()

    src = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    out = f"id {dict(df.dtypes)[id_col]}, " + ", ".join(f"{n} long" for n in names) + ", ids array<long>" * with_ids
    return src.mapInArrow(run, out).withColumnRenamed("id", id_col)
