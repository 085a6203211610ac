"""Suffix-array removal of passages that repeat across documents.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.

1. Texts are dealt to groups of about ``group_bytes`` by a hash of id and text. Every window of ``length`` bytes
   has a key, the least hash of its ``GRAM``-byte strings: equal windows have equal keys, wherever they lie.
   Groups report their distinct keys with about how often they have them; those that two documents have are sent
   back, and whether a key is hot (about ``HOT`` times or more in all).
2. Windows with such a key go, as the short stretches of text that share it, to the key's bucket, each
   distinct stretch once a group with its smallest document. A hot key's windows (a frequent phrase in ever other
   surroundings) go one by one, to the bucket of a hash of all of their bytes. There the suffixes are ordered by bucket-pointer
   refinement: buckets of equal 8-byte strings, then sorting inside each bucket by the bucket pointers 8, 16
   and 18 bytes on, each pass reading the pointers that the passes before refined, until buckets are strings
   of ``length`` bytes. Each window's smallest document goes back to the groups that asked.
3. Groups mark what the windows with a smaller document cover.

Nothing is gathered but one group or one bucket at a time; a passage that many documents hold is one stretch a
group. Defined cases: null text is empty; documents shorter than the window lose nothing; rows with the same
id don't count as smaller; a null id counts as the largest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

LENGTH, GRAM = 50, 20
HOT = 4096
KEY_GROUPS = 16  # keys are small: a bucket of keys takes those of so many groups' text
LAST = np.iinfo(np.int64).max
MUL = 0x9E3779B97F4A7C15
STEP = 1 << 18  # windows at a time: their hashes take over 50 times as much
_rng = np.random.default_rng(50)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(MUL, n, 1 << 64))


def _keys(buf: np.ndarray) -> np.ndarray:
    """The key of the window at each place of a buffer (length - 49 of them)."""
    h = {1: BYTE[buf]}
    for n in (1, 2, 4, 8):
        h[2 * n] = h[n][: len(h[n]) - n] * _power(n) + h[n][n:]
        if n != 4:
            del h[n]
    g = h[16][: len(h[16]) - 4] * _power(4) + h[4][16 : 16 + len(h[16]) - 4]
    g ^= g >> np.uint64(32)
    g *= np.uint64(MUL)
    g ^= g >> np.uint64(29)
    span = LENGTH - GRAM + 1
    n = 1
    while 2 * n <= span:
        g = np.minimum(g[: len(g) - n], g[n:])
        n *= 2
    return np.minimum(g[: len(g) - (span - n)], g[span - n :]) if span > n else g


def _runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows with one key inside a document: (document, first window, windows, key)."""
    sizes = np.diff(offsets)
    out = []
    for a in range(0, max(1, len(buf) - LENGTH + 1), STEP):
        part = buf[a : a + STEP + LENGTH - 1]
        if len(part) < LENGTH:
            break
        key = _keys(part)
        n = len(key)
        # windows that reach over their document's end don't count
        bad = np.zeros(n + 1, np.int32)
        ends = offsets[1:][sizes > 0]
        near = ends[(ends > a) & (ends - LENGTH + 1 < a + n)]
        begin = offsets[:-1][sizes > 0][(ends > a) & (ends - LENGTH + 1 < a + n)]
        np.add.at(bad, np.clip(np.maximum(near - LENGTH + 1, begin) - a, 0, n), 1)
        np.add.at(bad, np.clip(near - a, 0, n), -1)
        ok = np.cumsum(bad[:-1]) == 0
        edge = np.empty(n, bool)
        edge[0] = True
        edge[1:] = (key[1:] != key[:-1]) | (ok[1:] != ok[:-1])
        first = np.flatnonzero(edge)
        count = np.diff(np.append(first, n))
        keep = ok[first]
        out.append((first[keep] + a, count[keep], key[first[keep]]))
    if not out:
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(np.uint64)
    first, count, key = (np.concatenate(x) for x in zip(*out))
    doc = np.searchsorted(offsets, first, "right") - 1
    return doc, first, count, key


def _group(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Buffer, offsets, comparable ids and places in the table of a group's documents, in an order that doesn't depend on how they came."""
    release()
    ids = t.column("id").to_pylist()
    texts = t.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (LAST if ids[i] is None else ids[i], texts[i]))
    offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in order])]).astype(np.int64)
    buf = np.frombuffer(b"".join([texts[i] for i in order]), np.uint8)
    return buf, offsets, np.array([LAST if ids[i] is None else ids[i] for i in order], np.int64), order


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _pack(text: bytes) -> bytes:
    """What is exchanged in blocks is worth compressing: stretches overlap, and their numbers repeat."""
    return len(text).to_bytes(8, "little") + pa.compress(text, "zstd", asbytes=True)


def _unpack(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _split(by: np.ndarray, *cols: np.ndarray) -> list[tuple]:
    """(value, columns' parts as bytes) for each value of by."""
    order = np.argsort(by, kind="stable")
    by = by[order]
    first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else []
    parts = [np.split(c[order], first[1:]) for c in cols] if len(by) else []
    return [(int(by[f]), *[p[i].tobytes() for p in parts]) for i, f in enumerate(first)]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


KEYS = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("key", pa.binary()), ("many", pa.binary())])
BACK = pa.schema([("grp", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
PARTS = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("seg", pa.binary()), ("size", pa.binary()), ("low", pa.binary()), ("text", pa.binary())])
DDL = {"KEYS": "bucket long, grp long, key binary, many binary", "BACK": "grp long, kind int, a binary, b binary, c binary, d binary", "PARTS": "bucket long, grp long, seg binary, size binary, low binary, text binary"}


def _report(t: pa.Table, buckets: int) -> pa.Table:
    """A group's distinct keys by bucket, with about how often (a power of two) and whether two of its documents have them."""
    grp = t.column("grp")[0].as_py()
    buf, offsets, ids, _ = _group(t)
    doc, _, _, key = _runs(buf, offsets)
    order = np.argsort(key, kind="stable")
    key, own = key[order], ids[doc[order]]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    many = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first) if len(key) else np.zeros(0, bool)
    times = np.log2(np.diff(np.append(first, len(key)))).astype(np.uint8)
    key = key[first]
    return _table([(b, grp, k, m) for b, k, m in _split(_bucket(key, buckets), key, times | many.astype(np.uint8) << 7)], KEYS)


def _shared(t: pa.Table, hot: int) -> pa.Table:
    """For each group its keys of this bucket that two documents have, and which are hot."""
    key = np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("key").to_pylist()])
    many = np.concatenate([np.frombuffer(x, np.uint8) for x in t.column("many").to_pylist()])
    grp = np.repeat(t.column("grp").to_numpy(), [len(x) // 8 for x in t.column("key").to_pylist()])
    order = np.argsort(key, kind="stable")
    key, many, grp = key[order], many[order], grp[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    keep = np.repeat((size > 1) | (np.maximum.reduceat(many, first) > 127), size)
    often = np.repeat(np.add.reduceat(1 << (many & 127).astype(np.int64), first) >= hot, size).astype(np.uint8)
    return _table([(g, 0, k, h, None, None) for g, k, h in _split(grp[keep], key[keep], often[keep])], BACK)


def _cut_long(buf: np.ndarray, doc: np.ndarray, first: np.ndarray, count: np.ndarray, key: np.ndarray, hot: np.ndarray) -> tuple:
    """Long runs of one key in pieces, those of hot keys in single windows. Long ones mostly repeat themselves: cut by their period, their pieces are equal stretches."""
    span = LENGTH - GRAM + 1
    step = np.full(len(count), span)
    step[hot] = 1
    for i in np.flatnonzero((count > span) & ~hot).tolist():
        text = buf[first[i] : first[i] + count[i] + LENGTH - 1]
        step[i] = next((p for p in range(1, span + 1) if np.array_equal(text[p:], text[:-p])), span)
    pieces = np.where((count > span) | hot, -(-count // step), 1)
    run = np.repeat(np.arange(len(count)), pieces)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    long = pieces[run] > 1
    size = np.where(long, np.minimum(step[run], count[run] - nth * step[run]), count[run])
    return doc[run], first[run] + nth * step[run], size, key[run], hot[run]


def _window_hash(buf: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of the window at each place."""
    h = np.zeros(len(first), np.uint64)
    for k in range(LENGTH):
        h = h * np.uint64(MUL) + BYTE[buf[first + k]]
    return h ^ h >> np.uint64(31)


def _stretches(buf: np.ndarray, offsets: np.ndarray, ids: np.ndarray, back: pa.Table) -> tuple:
    """Runs whose key is shared, the distinct stretches of text they are, and each run's stretch; a hot key gives way to its window's hash."""
    rows = [(x, h) for x, h, k in zip(*[back.column(c).to_pylist() for c in ("a", "b", "kind")]) if k == 0]
    known = np.concatenate([np.frombuffer(x, np.uint64) for x, _ in rows]) if rows else np.zeros(0, np.uint64)
    often = np.concatenate([np.frombuffer(h, np.uint8) for _, h in rows]) > 0 if rows else np.zeros(0, bool)
    by = np.argsort(known)
    known, often = known[by], often[by]
    doc, first, count, key = _runs(buf, offsets)
    at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
    ok = known[at] == key if len(known) else np.zeros(len(key), bool)
    hot = often[at[ok]] if len(known) else ok[ok]
    doc, first, count, key, hot = _cut_long(buf, doc[ok], first[ok], count[ok], key[ok], hot)
    key[hot] = _window_hash(buf, first[hot])
    raw = buf.tobytes()
    number: dict[bytes, int] = {}
    seg = np.array([number.setdefault(raw[a : a + n], len(number)) for a, n in zip(first.tolist(), (count + LENGTH - 1).tolist())], np.int64)
    low = np.full(len(number), LAST, np.int64)
    if len(seg):
        np.minimum.at(low, seg, ids[doc])
    return doc, first, count, key, seg, low, list(number)


def _send(t: pa.Table, back: pa.Table, buckets: int) -> pa.Table:
    """A group's distinct shared stretches by bucket."""
    if not t.num_rows or not back.num_rows:
        return _table([], PARTS)
    grp = t.column("grp")[0].as_py()
    buf, offsets, ids, _ = _group(t)
    _, _, count, key, seg, low, texts = _stretches(buf, offsets, ids, back)
    if not texts:
        return _table([], PARTS)
    where = np.zeros(len(texts), np.int64)
    where[seg] = _bucket(key, buckets)
    size = np.array([len(x) for x in texts], np.int32)
    order = np.argsort(where, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], where[order][1:] != where[order][:-1]]))
    rows = []
    for own in np.split(order, first[1:]):
        rows.append((int(where[own[0]]), grp, _pack(own.astype(np.int32).tobytes()), _pack(size[own].tobytes()), _pack(low[own].tobytes()), _pack(b"".join([texts[i] for i in own.tolist()]))))
    return _table(rows, PARTS)


def refine(pointer: np.ndarray, active: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """One pass of bucket-pointer refinement: sort the suffixes in buckets of more than one by the pointer of the suffix offset on.

    pointer is each suffix's bucket: the place of the bucket's first suffix in the suffix order. Returns it
    refined, and the suffixes that still share a bucket."""
    key = pointer[active].astype(np.uint64) << np.uint64(32) | pointer[active + offset].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key, active = key[order], active[order]
    old = key >> np.uint64(32)
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    bucket = np.concatenate([[True], old[1:] != old[:-1]])
    place = np.arange(len(key))
    head = np.maximum.accumulate(np.where(fresh, place, 0))
    base = np.maximum.accumulate(np.where(bucket, place, 0))
    pointer = pointer.copy()
    pointer[active] += (head - base).astype(pointer.dtype)
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(key)))
    return pointer, active[np.repeat(size > 1, size)]


def window_classes(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for the 50 bytes at each start, equal for equal strings; the buckets of the suffix order at depth 50."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    gram = np.zeros(n, np.uint64)
    for k in range(8):
        gram <<= np.uint64(8)
        gram |= padded[k : n + k]
    order = np.argsort(gram, kind="stable").astype(np.int32)
    gram = gram[order]
    fresh = np.concatenate([[True], gram[1:] != gram[:-1]])
    del gram
    pointer = np.empty(n, np.int32)
    pointer[order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), np.int32(0)))
    size = np.diff(np.append(np.flatnonzero(fresh), n))
    active = order[np.repeat(size > 1, size)]
    for depth, offset in ((8, 8), (16, 16), (32, LENGTH - 32)):
        if depth == 32:
            wanted = np.zeros(n, bool)
            wanted[starts] = True
            active = active[wanted[active]]
        active = active[active < n - offset]
        if not len(active):
            break
        pointer, active = refine(pointer, active, offset)
    return pointer[starts]


def _order(t: pa.Table) -> pa.Table:
    """For each group that sent stretches to this bucket: stretch, first window, windows, smallest document, where that is smaller than the group's own."""
    release()
    parts, where, owner, asked, lows = {}, [], [], [], []
    for grp, seg, size, low, text in zip(*[t.column(c).to_pylist() for c in ("grp", "seg", "size", "low", "text")]):
        at, (seg, size, low, text) = 0, map(_unpack, (seg, size, low, text))
        for n in np.frombuffer(size, np.int32).tolist():
            where.append(parts.setdefault(text[at : at + n], len(parts)))
            at += n
        seg = np.frombuffer(seg, np.int32)
        asked.append(seg)
        owner.append(np.full(len(seg), grp, np.int64))
        lows.append(np.frombuffer(low, np.int64))
    where, owner, asked, lows = np.array(where), np.concatenate(owner), np.concatenate(asked), np.concatenate(lows)
    part_low = np.full(len(parts), LAST, np.int64)
    np.minimum.at(part_low, where, lows)
    size = np.array([len(p) for p in parts], np.int64)
    windows = size - LENGTH + 1
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(parts)), windows)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    kind = window_classes(np.frombuffer(b"".join(parts), np.uint8), begin[of] + nth)
    _, kind = np.unique(kind, return_inverse=True)
    low = np.full(int(kind.max()) + 1, LAST, np.int64)
    np.minimum.at(low, kind, part_low[of])
    low = low[kind]
    edge = np.concatenate([[True], (low[1:] != low[:-1]) | (of[1:] != of[:-1])])
    first = np.flatnonzero(edge)
    count = np.diff(np.append(first, len(of)))
    # runs of each stretch, then of each group that asked for it
    run_of = of[first]
    runs = np.bincount(run_of, minlength=len(parts))
    run_start = np.cumsum(runs) - runs
    ask = np.repeat(np.arange(len(where)), runs[where])
    run = run_start[where[ask]] + np.arange(len(ask)) - np.repeat(np.cumsum(runs[where]) - runs[where], runs[where])
    less = low[first[run]] < lows[ask]
    ask, run = ask[less], run[less]
    rows = _split(owner[ask], asked[ask].astype(np.int32), nth[first[run]].astype(np.int32), count[run].astype(np.int32), low[first[run]])
    return _table([(g, 1, *map(_pack, x)) for g, *x in rows], BACK)


def _whole_characters(buf: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """What goes when a character stays unless all of its bytes go."""
    first = np.flatnonzero((buf & 0xC0) != 0x80)
    if not len(first):
        return gone
    return np.repeat(np.logical_and.reduceat(gone, first), np.diff(np.append(first, len(buf))))


def _finish(t: pa.Table, back: pa.Table, out: pa.Schema) -> pa.Table:
    buf, offsets, ids, order = _group(t)
    cover = np.zeros(len(buf) + 1, np.int64)
    if back.num_rows:
        doc, first, count, _, seg, low, _ = _stretches(buf, offsets, ids, back)
        own = low[seg] < ids[doc] if len(seg) else np.zeros(0, bool)
        np.add.at(cover, first[own], 1)
        np.add.at(cover, first[own] + count[own] + LENGTH - 1, -1)
        rows = [r for r in back.select(["kind", "a", "b", "c", "d"]).to_pylist() if r["kind"] == 1]
        if rows:
            a, b, c = (np.concatenate([np.frombuffer(_unpack(r[k]), np.int32) for r in rows]).astype(np.int64) for k in "abc")
            d = np.concatenate([np.frombuffer(_unpack(r["d"]), np.int64) for r in rows])
            by = np.argsort(a, kind="stable")
            a, b, c, d = a[by], b[by], c[by], d[by]
            lo, hi = np.searchsorted(a, seg, "left"), np.searchsorted(a, seg, "right")
            hit = np.repeat(np.arange(len(seg)), hi - lo)
            run = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(len(hit))
            ok = d[run] < ids[doc[hit]]
            hit, run = hit[ok], run[ok]
            np.add.at(cover, first[hit] + b[run], 1)
            np.add.at(cover, first[hit] + b[run] + c[run] + LENGTH - 1, -1)
    gone = np.cumsum(cover[:-1]) > 0
    given, rest, res = t.column("id"), t.column("rest") if "rest" in t.column_names else None, []
    for i, k in enumerate(order):
        text, g = buf[offsets[i] : offsets[i + 1]], gone[offsets[i] : offsets[i + 1]]
        if rest is not None:
            res.append((given[k].as_py(), text[~_whole_characters(text, g)].tobytes()))
            continue
        spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + (g[0] if len(g) else 0))
        res.append((given[k].as_py(), len(text), int(g.sum()), spans, hashlib.sha256(text[~g].tobytes()).hexdigest()))
    done = _table(res, out)
    if rest is None:
        return done
    rest = rest.combine_chunks().take(pa.array(order, pa.int64()))
    rest = rest.chunk(0) if isinstance(rest, pa.ChunkedArray) else rest
    # fields that can't be null come back as ones that can
    return done.append_column("rest", pa.StructArray.from_arrays(rest.flatten(), names=[f.name for f in rest.type]))


def _run(df: DataFrame, id_col: str, text_col: str, with_text: bool, group_bytes: int, hot: int) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups = buckets = max(16, total // group_bytes)
    key_buckets = max(16, groups // KEY_GROUPS)
    rest = [F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).dropFields(f"c{df.columns.index(text_col)}").alias("rest")] if with_text else []
    docs = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *rest)
    docs = docs.withColumn("grp", F.pmod(F.xxhash64("id", "text"), F.lit(groups)))
    keys = docs.groupBy("grp").applyInArrow(lambda t: _report(t, key_buckets), DDL["KEYS"])
    # used twice below: texts and keys are exchanged once, their exchanges are reused
    shared = keys.groupBy("bucket").applyInArrow(lambda t: _shared(t, hot), DDL["BACK"])
    sent = docs.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(lambda a, b: _send(a, b, buckets), DDL["PARTS"])
    less = sent.groupBy("bucket").applyInArrow(_order, DDL["BACK"])
    if with_text:
        out, ddl = pa.schema([("id", pa.int64()), ("kept", pa.binary())]), f"id long, kept binary, rest {dict(docs.dtypes)['rest']}"
    else:
        out = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
        ddl = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    back = shared.unionByName(less)
    return docs.groupBy("grp").cogroup(back.groupBy("grp")).applyInArrow(lambda a, b: _finish(a, b, out), ddl)


def removed_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = 2 << 20, hot: int = HOT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every document; bytes exactly as defined above."""
    return _run(df, id_col, text_col, False, group_bytes, hot).withColumnRenamed("id", id_col)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = 2 << 20, hot: int = HOT) -> DataFrame:
    """The input's columns, texts without their repeated passages; a character goes only if all of its bytes do."""
    out = _run(df, id_col, text_col, True, group_bytes, hot)
    return out.select(*[F.col("kept").cast("string").alias(c) if c == text_col else F.col(f"rest.c{i}").alias(c) for i, c in enumerate(df.columns)])
