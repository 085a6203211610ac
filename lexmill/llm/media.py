"""Media columns: AVI files of intra-only motion JPEG, their shots and timed clips.

Bytes are stored losslessly as the 8-bit samples of lossless-process JPEG frames (SOF3, predictor 1)
inside an AVI file with an ``idx1`` index. The writer's Huffman table gives difference category k a code
of 9-k bits, so that every sample takes nine bits and a whole frame is packed and unpacked with numpy.
The reader takes any Huffman table for SOF3 and baseline frames (SOF0) with 1x1 sampling; tables other
than the writer's are decoded bit by bit.

Shots: each frame has a 16-bin histogram of its samples; half the L1 distance to the frame before is its
difference. A frame starts a shot where the difference is over ``floor`` and over the mean of the
differences around it plus ``k`` standard deviations.

Defined cases: null or empty bytes give a file that holds the padding only; equal bytes give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

WIDTH, HEIGHT, RATE = 16, 16, 25
UNIT = 192
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else (i % 8))))


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """The nine-bit code of difference d at d+255, and the difference of each nine-bit code."""
    code, diff = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        prefix = (1 << (9 - k)) - 2  # 8-k ones and a zero
        c = prefix << k | (d if d >= 0 else d + (1 << k) - 1)
        code[d + 255], diff[c] = c, d
    return code, diff


CODE, DIFF = _code_tables()
DHT = b"\xff\xc4" + struct.pack(">HB", 19 + 9, 0) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))


def _marker(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body


def frame_head(width: int = WIDTH, height: int = HEIGHT) -> bytes:
    sof = struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([i, 0x11, 0]) for i in (1, 2, 3))
    sos = bytes([3, 1, 0, 2, 0, 3, 0, 1, 0, 0])
    return b"\xff\xd8" + _marker(0xC3, sof) + DHT + _marker(0xDA, sos)


HEAD = frame_head()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG frames of an array (frames, height, width, 3) of bytes; 8 divides a frame's samples."""
    n, h, w, _ = samples.shape
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    c = CODE[d.reshape(-1, 8) + 255]
    out = np.empty((len(c), 9), np.uint8)
    out[:, 0] = c[:, 0] >> 1
    for k in range(1, 8):
        out[:, k] = (c[:, k - 1] << (8 - k) | c[:, k] >> (k + 1)) & 0xFF
    out[:, 8] = c[:, 7] & 0xFF
    flat, size = out.reshape(-1), h * w * 3 * 9 // 8
    at = np.flatnonzero(flat == 0xFF)
    sizes = size + np.bincount(at // size, minlength=n)
    body = (np.insert(flat, at + 1, 0) if len(at) else flat).tobytes()
    ends = np.cumsum(sizes)
    head = HEAD if (w, h) == (WIDTH, HEIGHT) else frame_head(w, h)
    return [head + body[e - s : e] + b"\xff\xd9" for s, e in zip(sizes.tolist(), ends.tolist())]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes, width: int = WIDTH, height: int = HEIGHT, rate: int = RATE) -> bytes:
    """An AVI file whose frames' samples are the payload, padded with zeros to whole frames; its length is kept as a comment."""
    per = width * height * 3
    n = max(1, -(-len(payload) // per))
    samples = np.zeros(n * per, np.uint8)
    samples[: len(payload)] = np.frombuffer(payload, np.uint8)
    frames = encode_frames(samples.reshape(n, height, width, 3))
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, n, 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, rate, 0, n, most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", per, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    chunks = [_chunk(b"00dc", f) for f in frames]
    ends = np.cumsum([len(c) for c in chunks])
    idx = np.zeros((n, 4), "<u4")
    idx[:, 0], idx[:, 1] = int.from_bytes(b"00dc", "little"), 0x10
    idx[:, 2] = 4 + np.concatenate([[0], ends[:-1]])
    idx[:, 3] = [len(f) for f in frames]
    body = b"AVI " + hdrl + info + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", idx.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_avi(data: bytes) -> dict:
    """The header's fields, the comment, and the places (start, size) of the frames by the index, or by the chunks where there is none."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out = {"width": 0, "height": 0, "scale": 1, "rate": 25, "comment": "", "frames": []}
    movi, index, found = None, None, []

    def walk(at: int, end: int) -> None:
        nonlocal movi, index
        while at + 8 <= end:
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if kind == b"LIST":
                if data[body : body + 4] == b"movi":
                    movi = body
                walk(body + 4, min(end, body + size))
            elif kind == b"avih":
                out["width"], out["height"] = struct.unpack_from("<II", data, body + 32)
            elif kind == b"strh" and data[body : body + 4] == b"vids":
                out["scale"], out["rate"] = struct.unpack_from("<II", data, body + 20)
            elif kind == b"ICMT":
                out["comment"] = data[body : body + size].rstrip(b"\0").decode("latin-1")
            elif kind == b"idx1":
                index = np.frombuffer(data, "<u4", size // 16 * 4, body).reshape(-1, 4)
            elif kind[2:] in (b"dc", b"db") and movi is not None and index is None:
                found.append((body, size))
            at = body + size + (size & 1)

    walk(12, len(data))
    if index is not None and movi is not None:
        kinds = index[:, 0].astype("<u4").view("S4")
        video = index[np.char.endswith(kinds, b"dc") | np.char.endswith(kinds, b"db")].astype(np.int64)
        # offsets count from the list's type, or from the file's start
        base = movi if len(video) and data[movi + int(video[0, 2]) : movi + int(video[0, 2]) + 2].isdigit() else 0
        found = [(base + int(o) + 8, int(s)) for o, s in video[:, 2:]]
    out["frames"] = found
    return out


def _segments(data: bytes) -> tuple[dict, bytes]:
    """Tables and frame header of a JPEG image, and its entropy-coded bytes without stuffing."""
    at, info = 2, {"dht": {}, "dqt": {}, "restart": 0}
    while at + 4 <= len(data):
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if kind == 0xC4:
            while body:
                counts = list(body[1:17])
                info["dht"][body[0]] = (counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                info["dqt"][body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif kind == 0xDD:
            info["restart"] = struct.unpack(">H", body)[0]
        elif kind in (0xC0, 0xC1, 0xC3):
            info["process"] = kind
            info["precision"], info["height"], info["width"], n = struct.unpack_from(">BHHB", body)
            info["components"] = [(body[6 + 3 * i], body[7 + 3 * i], body[8 + 3 * i]) for i in range(n)]
        elif kind == 0xDA:
            n = body[0]
            info["scan"] = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(n)]
            info["predictor"] = body[1 + 2 * n]
            return info, data[at + 2 + size : data.rfind(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")
        at += 2 + size
    raise ValueError("no scan in this image")


class _Bits:
    def __init__(self, data: bytes, tables: dict):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist() + [1] * 64
        self.at = 0
        self.codes = {}
        for k, (counts, symbols) in tables.items():
            code, i, found = 0, 0, {}
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    found[length, code] = symbols[i]
                    code, i = code + 1, i + 1
                code <<= 1
            self.codes[k] = found

    def symbol(self, table: int) -> int:
        code, found = 0, self.codes[table]
        for length in range(1, 17):
            code = code << 1 | self.bits[self.at]
            self.at += 1
            if (length, code) in found:
                return found[length, code]
        raise ValueError("no such Huffman code")

    def value(self, size: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + size]:
            v = v << 1 | b
        self.at += size
        return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


def _undo_prediction(d: np.ndarray) -> np.ndarray:
    """Samples (frames, height, width, components) of differences from the left, the first column's from above."""
    d = d.astype(np.int32)
    d[:, :, 0] = np.cumsum(d[:, :, 0], 1) + 128
    return (np.cumsum(d, 2) & 0xFF).astype(np.uint8)


def decode_frame(data: bytes) -> np.ndarray:
    """Samples (height, width, components) of one intra frame, lossless (predictor 1) or baseline with 1x1 sampling."""
    info, body = _segments(data)
    if info["restart"] or any(c[1] != 0x11 for c in info["components"]):
        raise ValueError("restart intervals and subsampling aren't read")
    h, w, n = info["height"], info["width"], len(info["components"])
    bits = _Bits(body, info["dht"])
    if info["process"] == 0xC3:
        if info["predictor"] != 1 or info["precision"] != 8:
            raise ValueError("only predictor 1 of 8 bits is read")
        d = np.array([bits.value(bits.symbol(t >> 4)) for _ in range(h * w) for _, t in info["scan"]])
        return _undo_prediction(d.reshape(1, h, w, n))[0]
    c = np.arange(8)
    basis = np.cos((2 * c[None] + 1) * c[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    rows, cols = -(-h // 8), -(-w // 8)
    out, dc = np.zeros((rows * 8, cols * 8, n)), [0] * n
    for r in range(rows):
        for q in range(cols):
            for k, (_, t) in enumerate(info["scan"]):
                block = np.zeros(64)
                dc[k] += bits.value(bits.symbol(t >> 4))
                block[0], i = dc[k], 1
                while i < 64:
                    s = bits.symbol(0x10 | t & 15)
                    if s == 0:
                        break
                    i += s >> 4
                    if s & 15:
                        block[ZIGZAG[i]] = bits.value(s & 15)
                    i += 1
                natural = np.empty(64)
                natural[ZIGZAG] = info["dqt"][info["components"][k][2]]
                out[r * 8 : r * 8 + 8, q * 8 : q * 8 + 8, k] = basis.T @ (block * natural).reshape(8, 8) @ basis + 128
    return np.clip(np.rint(out[:h, :w]), 0, 255).astype(np.uint8)


def read_frames(data: bytes, avi: dict) -> np.ndarray:
    """Samples (frames, height, width, 3) of an AVI file's frames."""
    frames = avi["frames"]
    cut = len(HEAD)
    if (avi["width"], avi["height"]) == (WIDTH, HEIGHT) and frames and all(data[o : o + cut] == HEAD for o, _ in frames):
        body = np.frombuffer(b"".join([data[o + cut : o + s - 2] for o, s in frames]), np.uint8)
        stuffed = np.flatnonzero(body[:-1] == 0xFF) + 1
        if len(stuffed):
            body = np.delete(body, stuffed)
        b = body.reshape(-1, 9).astype(np.uint16)
        c = np.empty((len(b), 8), np.uint16)
        for j in range(8):
            c[:, j] = (b[:, j] << (j + 1) | b[:, j + 1] >> (7 - j)) & 0x1FF
        return _undo_prediction(DIFF[c].reshape(len(frames), HEIGHT, WIDTH, 3))
    return np.stack([decode_frame(data[o : o + s]) for o, s in frames])


def shots(frames: np.ndarray, k: float = 2.0, floor: float = 0.1, reach: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """First frames of the shots, and each frame's difference to the one before it (0 for the first)."""
    n, per = len(frames), frames[0].size
    cell = (frames.reshape(n, -1) >> 4).astype(np.int64) + 16 * np.arange(n)[:, None]
    hist = np.bincount(cell.ravel(), minlength=16 * n).reshape(n, 16) / per
    diff = np.concatenate([[0.0], np.abs(np.diff(hist, axis=0)).sum(1) / 2])
    at = np.arange(n)
    lo, hi = np.maximum(1, at - reach), np.minimum(n, at + reach + 1)
    s1, s2 = np.concatenate([[0], np.cumsum(diff)]), np.concatenate([[0], np.cumsum(diff**2)])
    m = np.maximum(1, hi - lo)
    mean = (s1[hi] - s1[lo]) / m
    std = np.sqrt(np.maximum(0, (s2[hi] - s2[lo]) / m - mean**2))
    return np.concatenate([[0], np.flatnonzero((at > 0) & (diff > floor) & (diff > mean + k * std))]), diff


def clips_of(data: bytes) -> list[dict]:
    """Timed clips of an AVI file: one a shot."""
    avi = parse_avi(data)
    frames = read_frames(data, avi)
    first, diff = shots(frames)
    ms = 1000.0 * avi["scale"] / avi["rate"]
    ends = [*first[1:].tolist(), len(frames)]
    return [
        {"clip": i, "first_frame": a, "n_frames": b - a, "start_ms": a * ms, "end_ms": b * ms, "change": float(diff[a]), "mean_level": float(frames[a:b].mean())}
        for i, (a, b) in enumerate(zip(first.tolist(), ends))
    ]


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return raw.ljust(size, b" "), len(raw)


def digest(text: str | None) -> tuple:
    """Store a text, read it back and describe it: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    payload, n = payload_of(text)
    media = write_avi(payload)
    avi = parse_avi(media)
    frames = read_frames(media, avi)
    back = frames.tobytes()[: int(avi["comment"].partition("=")[2])]
    first, diff = shots(frames)
    ms = 1000 * avi["scale"] // avi["rate"]
    clips = ",".join(f"{a * ms}-{b * ms}" for a, b in zip(first.tolist(), [*first[1:].tolist(), len(frames)]))
    feature = f"frames={len(frames)};shots={len(first)};mean={frames.mean():.3f};change={diff.max():.4f};clips_ms={clips}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def store_avi(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, media): each text as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            media = [write_avi(payload_of(x)[0]) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], names=[id_col, "media"])

    src = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    kind = dict(df.dtypes)[id_col]
    return src.mapInArrow(run, f"`{id_col}` {kind}, media binary")


def avi_clips(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a clip of each AVI file: id, clip, first_frame, n_frames, start_ms, end_ms, change, mean_level. Null media give no rows."""
    fields = "clip int, first_frame int, n_frames int, start_ms double, end_ms double, change double, mean_level double"
    names = [f.split()[0] for f in fields.split(", ")]
    types = [pa.int32()] * 3 + [pa.float64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                if not b.column(1)[i].is_valid:
                    continue
                rows = clips_of(b.column(1)[i].as_py())
                ids = pa.array([b.column(0)[i].as_py()] * len(rows), b.column(0).type)
                yield pa.RecordBatch.from_arrays([ids] + [pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=["id", *names])

    src = df.selectExpr(f"`{id_col}` AS id", f"`{media_col}` AS media")
    return src.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, {fields}").withColumnRenamed("id", id_col)


def avi_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text, read the stored file back and return its digests; one narrow stage, one text in memory at a time."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            cols = list(zip(*[digest(x) for x in b.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, t) for c, t in zip(cols, types)], names=["id", *names])

    src = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    out = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return src.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, {out}").withColumnRenamed("id", id_col)
