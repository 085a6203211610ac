"""SentencePiece encoding and decoding with offsets, for models of the BPE kind.

The model file is read here: pieces with scores and kinds, and the normaliser's compiled character map, a
double-array trie over UTF-8 followed by zero-ended replacements. Normalisation takes the longest prefix
that the map (or a user-defined piece) has, else one character, and records for each normalised byte the
source byte it came from; pieces are projected to byte spans of the source through that record. Merging
joins the adjacent pair whose piece scores best, leftmost first.

Where no piece continues over the start of a word (a meta space after another character, or a line end) and
the map neither joins characters across a space nor changes one, stretches of a text are encoded apart, each
with its own record, and remembered: a stretch's ids and relative spans are shifted by its place in the source.
That gives what encoding whole texts gives; other texts and models are normalised whole. Decoding reads the ids.

Defined cases: null is empty; an empty text has no pieces but the end id; decoding drops the meta space
that encoding put in front and replaces byte pieces that aren't UTF-8 by U+FFFD; columns beyond the id and the
text take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memory, small_batches

SPACE = "▁"
STRETCH = re.compile(r"\n[^ \n]*| +[^ \n]*")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        elif key & 7 == 5:
            yield key >> 3, data[at : at + 4]
            at += 4
        else:
            yield key >> 3, data[at : at + 8]
            at += 8


class CharMap:
    """The compiled character map: longest prefix of UTF-8 bytes and its replacement."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.text = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.text = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest entry that data has at this place, and what replaces it."""
        units = self.units
        if not units:
            return None
        jump = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node, best = jump(units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= jump(unit)
            if unit >> 8 & 1:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.text[best[1] : self.text.index(b"\0", best[1])]


    def begins(self) -> set[int]:
        """The first bytes of the map's entries."""
        units = self.units
        root = (units[0] >> 10) << ((units[0] & 0x200) >> 6) if units else 0
        return {b for b in range(1, 256) if units and root ^ b < len(units) and units[root ^ b] & 0x800000FF == b}

    def holds_space(self) -> bool:
        """Whether an entry has a space in it."""
        units, todo, seen = self.units, [0] if self.units else [], set()
        while todo:
            at = todo.pop()
            base = at ^ ((units[at] >> 10) << ((units[at] & 0x200) >> 6)) if at else (units[0] >> 10) << ((units[0] & 0x200) >> 6)
            for b in range(1, 256):
                to = base ^ b
                if to < len(units) and to not in seen and units[to] & 0x800000FF == b:
                    if b == 32:
                        return True
                    seen.add(to)
                    todo.append(to)
        return False


class Model:
    def __init__(self, blob: bytes, memory: int = 600_000, longest: int = 128):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        norm, trainer = {}, {}
        for field, value in _fields(blob):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                norm = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only models of the BPE kind are read")
        self.map = CharMap(norm.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        self.fallback = bool(trainer.get(35, 0))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER, UNUSED)}
        self.rank = {p: -self.scores[i] for p, i in self.ids.items()}
        self.user = sorted((p for i, p in enumerate(self.pieces) if self.kinds[i] == USER), key=len, reverse=True)
        self.user_set, self.user_most = set(self.user), max(map(len, self.user), default=0)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unk = self.kinds.index(UNKNOWN)
        self.eos = self.pieces.index("</s>") if "</s>" in self.pieces else -1
        self.unk_surface = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.width = {p: len(p.encode()) for p in self.ids}
        self.mark = SPACE.encode() if self.escape else b" "
        # whether stretches can be encoded apart
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        begins = self.map.begins() | {p.encode()[0] for p in self.user if p}
        self.apart = self.by_word and self.fallback and SPACE in self.ids and self.dummy and self.escape and not self.squeeze and not self.user and 10 not in begins and not any("\n" in p for p in self.ids) and not self.map.holds_space()
        # whole characters that no entry begins with stand for themselves
        one, lead = bytes(b for b in range(128) if b not in begins | {32}), bytes(b for b in range(0xC2, 0xF5) if b not in begins)
        chars = [b"[" + re.escape(one) + b"]"] * bool(one) + [b"[" + re.escape(lead) + b"][\x80-\xbf]+"] * bool(lead)
        self.themselves = re.compile(b"(?:" + b"|".join(chars) + b")+").match if chars else lambda data, at: None
        shown = {BYTE: lambda i: bytes([self.byte_of[i]]), UNKNOWN: lambda i: self.unk_surface.encode(), CONTROL: lambda i: b""}
        self.surface = [shown[k](i) if k in shown else self.pieces[i].replace(SPACE, " ").encode() for i, k in enumerate(self.kinds)]
        self.decimals = [str(i) for i in range(len(self.pieces))]
        self.known = Memory(self._stretch, memory, longest)

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest prefix that is a user-defined piece, an entry of the map or else one character, and what it becomes."""
        for n in range(min(self.user_most * 4, len(data) - at), 0, -1) if self.user_most else ():
            if (piece := data[at : at + n]).decode(errors="replace") in self.user_set:
                return n, piece
        if (hit := self.map.longest(data, at)) is not None:
            return hit
        n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        return n, data[at : at + n]

    def normalize(self, text: str, dummy: bool | None = None) -> tuple[str, list[int]]:
        """The normalised text, and for each of its bytes (and the end) the source byte it stands for."""
        data, out, src, at = text.encode(), bytearray(), [], 0
        if self.squeeze:
            while at < len(data):
                n, piece = self._prefix(data, at)
                if piece.strip(b" "):
                    break
                at += n
        if (self.dummy if dummy is None else dummy) and at < len(data):
            out += self.mark
            src += [at] * len(self.mark)
        last_space = self.squeeze
        while at < len(data):
            if (same := self.themselves(data, at)) is not None:
                out += same[0]
                src += range(at, same.end())
                at, last_space = same.end(), False
                continue
            n, piece = self._prefix(data, at)
            if self.squeeze and last_space:
                piece = piece.lstrip(b" ")
            if piece:
                last_space = piece.endswith(b" ")
                piece = piece.replace(b" ", self.mark)
                out += piece
                src += [at] * len(piece)
            at += n
            if not self.squeeze:
                last_space = False
        end = len(data)
        if self.squeeze:
            while out.endswith(self.mark):
                end = src[-len(self.mark)]
                del out[-len(self.mark) :], src[-len(self.mark) :]
        src.append(end)
        return out.decode(errors="replace"), src

    def merge(self, word: str) -> list[str]:
        """Pieces of a normalised stretch of text."""
        parts, frozen, at = [], [], 0
        if not self.user:
            parts = list(word)
        while self.user and at < len(word):
            n = next((n for n in range(min(self.user_most, len(word) - at), 0, -1) if word[at : at + n] in self.user_set), 0)
            parts.append(word[at : at + max(1, n)])
            frozen.append(n > 0)
            at += max(1, n)
        if len(parts) > 256:
            return self._merge_long(parts, frozen)
        rank, never = self.rank, 1e18
        if any(frozen):
            return self._merge_long(parts, frozen)
        order = [rank.get(x + y, never) for x, y in zip(parts, parts[1:])]
        while order:
            best = min(order)
            if best == never:
                break
            i = order.index(best)
            joined = parts[i] = parts[i] + parts.pop(i + 1)
            del order[i]
            if i < len(order):
                order[i] = rank.get(joined + parts[i + 1], never)
            if i:
                order[i - 1] = rank.get(parts[i - 1] + joined, never)
        return parts

    def _merge_long(self, parts: list[str], frozen: list[bool]) -> list[str]:
        """The same with a heap, for stretches without a space."""
        import heapq

        n, ids, scores = len(parts), self.ids, self.scores
        nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and not (frozen and (frozen[i] or frozen[j])) and (k := ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-scores[k], i, j, parts[i] + parts[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if not parts[i] or not parts[j] or nxt[i] != j or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, ""
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            offer(prv[i], i)
            offer(i, nxt[i])
        return [p for p in parts if p]

    def _surface(self, ids: list[int]) -> str:
        out = bytearray()
        for i in ids:
            out += self.surface[i]
        return out.decode(errors="replace")

    def _stretches(self, normal: str) -> list[str]:
        """Cut before each meta space that follows another character."""
        if not self.by_word:
            return [normal]
        out, start = [], 0
        for i in range(1, len(normal)):
            if normal[i] == SPACE and normal[i - 1] != SPACE:
                out.append(normal[start:i])
                start = i
        return [*out, normal[start:]]

    def _spans(self, text: str, dummy: bool | None = None) -> array:
        """id, start and end of each piece of a text normalised whole; byte pieces share their character's span."""
        rows = array("q")
        if not text:
            return rows
        normal, src = self.normalize(text, dummy)
        ids, width, start = self.ids, self.width, 0
        for part in self._stretches(normal) if SPACE in normal[1:] else [normal]:
            for piece in self.merge(part):
                if (i := ids.get(piece)) is not None:
                    end = start + width[piece]
                    rows.extend((i, src[start], src[end]))
                else:
                    end = start + len(piece.encode())
                    if not self.fallback and rows and rows[-3] == self.unk:
                        rows[-1] = src[end]  # unknown ones in a row are one
                    else:
                        for i in [self.bytes[b] for b in piece.encode()] if self.fallback else [self.unk]:
                            rows.extend((i, src[start], src[end]))
                start = end
        return rows

    def _stretch(self, key: str) -> bytes:
        """A stretch's rows (id, start, end), places counted from the space before it; a line end has none."""
        return self._spans(key if key[:1] == "\n" else " " + key, False).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Rows (id, start, end) with byte spans of the source; no end id."""
        if not self.apart or not text or SPACE in text:
            return np.array(self._spans(text), np.int64).reshape(-1, 3)
        words = text.replace("\n", " \n").split(" ")
        if "" in words:  # more spaces than one belong to the stretch after them
            words = [w if w[0] == "\n" else w[1:] for w in STRETCH.findall(" " + text)]
        known = self.known
        found = [known[w] for w in words]
        rows = np.frombuffer(bytearray().join(found), np.int64).reshape(-1, 3)
        many = np.array(list(map(len, found))) // 24
        size = rows[np.cumsum(many) - 1, 2]
        # the space before the first stretch isn't in the source
        rows[:, 1:] += np.repeat(np.cumsum(size) - size - (words[0][:1] != "\n"), many)[:, None]
        return np.maximum(rows, 0, out=rows)

    def encode_spans(self, text: str) -> list[tuple[int, str, int, int]]:
        """(id, piece, start, end) of a text's pieces."""
        return [(i, self.pieces[i], a, b) for i, a, b in self.encode(text).tolist()]

    def decode(self, ids: list[int]) -> str:
        shown = self._surface(ids)
        return shown[1:] if self.dummy and shown.startswith(" ") else shown


_MODELS: dict[str, Model] = {}


def load(path: str) -> Model:
    if path not in _MODELS:
        with open(path, "rb") as f:
            _MODELS[path] = Model(f.read())
    return _MODELS[path]


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def sp_digest(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: n_tokens (the end id included), ids_sha256, decoded_sha256 of what the ids decode to, spans_sha256 of the pieces'
    byte spans (start and end as little-endian 64-bit numbers). One narrow stage; model is a file's name among the public ones or a path."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model if "/" in model else tokenizer_path(model))
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in small_batches(batches, "text"):
            m.known.make_room()
            out = []
            for text in b.column(1).to_pylist():
                rows = m.encode(text or "")
                ids = [*rows[:, 0].tolist(), m.eos]
                shown = " ".join(map(m.decimals.__getitem__, ids))
                out.append((len(ids), sha(shown.encode()), sha(m.decode(ids).encode()), sha(np.ascontiguousarray(rows[:, 1:], "<i8").tobytes())))
            cols = [pa.array(c, pa.string() if i else pa.int64()) for i, c in enumerate(zip(*out))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", *names])

    src = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return src.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, n_tokens long, " + ", ".join(f"{n} string" for n in names[1:])).withColumnRenamed("id", id_col)


def sp_encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text the arrays ids, starts and ends: byte spans of the source; no end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model if "/" in model else tokenizer_path(model))
        for b in small_batches(batches, "text", 1 << 20):
            m.known.make_room()
            got = [m.encode(x or "") for x in b.column(1).to_pylist()]
            ends, flat = np.cumsum([0, *map(len, got)]), np.concatenate(got)
            cols = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[:, k])) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "ids", "starts", "ends"])

    src = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return src.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, ids array<long>, starts array<long>, ends array<long>").withColumnRenamed("id", id_col)


def sp_decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row the text of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model if "/" in model else tokenizer_path(model))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    src = df.selectExpr(f"`{id_col}` AS id", f"`{ids_col}` AS ids")
    return src.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, text string").withColumnRenamed("id", id_col)
