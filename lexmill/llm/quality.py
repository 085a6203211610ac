"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, its character n-grams (3 and 4 characters that
hold no white space inside, so that a leading or trailing space marks the word's edge) and its pairs of equal
words in a row, which all share one vector; a softmax layer over that average gives the classes. Vectors and layer are learned by numpy stochastic gradient descent from a bounded
sample of labelled rows: the ``max_rows`` smallest hashes of the id, whole texts, and of these no text that would
take their sum beyond ``max_bytes``. As the layer is linear over an average, scoring needs one number per vector;
whole texts are scored, vectorised over blocks of text.

Defined cases: null, empty and blank texts have no features and get the share of label 1 among the learned
rows; equal texts get equal scores; without labelled rows every score is 0.5; a doc_id labelled twice counts
once with its smaller label; columns beyond the id, the text and those kept take no part, and kept ones may have
any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, free_name, id_crc_mod, small_batches

BUCKETS = 1 << 18
DIM = 16
THRESHOLD = 0.3
#: Bytes of text at a time: their features take over 100 times as much.
AT_ONCE = 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)
POWERS = np.cumprod(np.full(64, BASE, np.uint64), dtype=np.uint64)
BLANKS = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def _index(key: np.ndarray, salt: int) -> np.ndarray:
    """A bucket of the hash, from 1; bucket 0 is the pair of equal words."""
    h = (key + np.uint64(salt)) * MIX
    h ^= h >> np.uint64(29)
    h *= MIX
    return (h >> np.uint64(64 - 18)).astype(np.int64) % (BUCKETS - 1) + 1


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts given as UTF-8 bytes without gaps, and the places where texts begin and end."""
    points = np.frombuffer(data.tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    if at[-1] == len(points):
        return points, at
    # not UTF-8 throughout: one text at a time
    parts = [np.frombuffer(data[a:b].tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets, offsets[1:])]
    return np.concatenate([points[:0], *parts]), np.cumsum([0, *map(len, parts)])


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (documents' numbers, buckets) of the features of some texts."""
    n = len(offsets) - 1
    data, offsets = characters(data, offsets)
    sizes = np.diff(offsets)
    # a space after each text and one in front, so that no feature spans two texts
    buf = np.full(len(data) + n + 4, 32, np.uint32)
    doc = np.repeat(np.arange(n), sizes)
    buf[np.arange(len(data)) + doc + 1] = data
    owner = np.zeros(len(buf), np.int64)
    owner[np.arange(len(data)) + doc + 1] = doc
    # the space after a text belongs to it, the one in front of the first text to that one
    owner[offsets[1:] + np.arange(n) + 1] = np.arange(n)
    space = (buf <= 32) & np.isin(buf, BLANKS)
    b = np.where(space, np.uint32(32), buf).astype(np.uint64)
    m = len(buf) - 3
    three = b[:m] | b[1 : m + 1] << np.uint64(21) | b[2 : m + 2] << np.uint64(42)
    inner = space[1 : m + 1]
    at = np.flatnonzero(~inner & ~(space[:m] & space[2 : m + 2]))
    yield owner[at + 1], _index(three[at], 3)
    at = np.flatnonzero(~inner & ~space[2 : m + 2])
    yield owner[at + 1], _index(three[at] * BASE + b[at + 3], 4)
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if len(starts):
        place = np.arange(len(buf))
        since = place - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(buf)]])))
        # long words fold over: place in the word modulo 64
        word = np.add.reduceat(np.where(space, np.uint64(0), (b + np.uint64(1)) * POWERS[since & 63]), starts)
        of = owner[starts]
        yield of, _index(word, 7)
        again = np.flatnonzero((word[1:] == word[:-1]) & (of[1:] == of[:-1])) + 1
        yield of[again], np.zeros(len(again), np.int64)


def bag(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, share of the document's features) sorted by document."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    docs, idx = map(np.concatenate, zip(*features(np.frombuffer(b"".join(texts), np.uint8), offsets)))
    key, count = np.unique(docs * BUCKETS + idx, return_counts=True)
    docs, idx = key // BUCKETS, key % BUCKETS
    total = np.bincount(docs, count, len(texts))
    return docs, idx, (count / total[docs]).astype(np.float32)


def train(texts: list[bytes], labels: list[int], epochs: int = 8, least_steps: int = 16000, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, float]:
    """A number per bucket and a bias, whose sum is the log odds of label 1; and the score of texts without features in the last place."""
    y = np.asarray(labels)
    prior = float(y.mean()) if len(y) else 0.5
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), np.log((prior + 1e-3) / (1 - prior + 1e-3))
    rng = np.random.default_rng(seed)
    table = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    layer = np.zeros((DIM, 2), np.float32)
    bias = np.log(np.array([1 - prior, prior], np.float32))
    parts = [bag(texts[i : i + 256]) for i in range(0, len(texts), 256)]
    docs = np.concatenate([d + 256 * i for i, (d, _, _) in enumerate(parts)])
    idx, share = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    start = np.searchsorted(docs, np.arange(len(texts) + 1))
    rows = np.flatnonzero(np.diff(start))
    # small samples are gone over more often
    epochs = max(epochs, -(-least_steps // max(1, len(rows))))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(rows):
            ids, w = idx[start[i] : start[i + 1]], share[start[i] : start[i + 1]]
            own = table[ids]
            hidden = w @ own
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            step = rate * (1 - done / steps)
            table[ids] = own - (step * w)[:, None] * (layer @ p)  # a document's buckets are distinct
            layer -= step * np.outer(hidden, p)
            bias -= 0.05 * step * p
            done += 1
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def learn(documents: DataFrame, labels: DataFrame, max_rows: int = 2000, max_bytes: int = 24 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Fit on at most max_rows labelled rows, whose ids have the smallest hashes; the sample is all that reaches the driver."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    ids = marked.groupBy("id").agg(F.min("label").cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    size, out = 0, []
    # the sample's ids are at most max_rows; an id that many rows have gives its smallest text
    chosen = texts.where(F.octet_length("text") <= max_bytes).join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    for r in chosen.orderBy("id").toLocalIterator():
        if size + len(r.text) <= max_bytes:
            size += len(r.text)
            out.append((bytes(r.text), r.label))
    return train([t for t, _ in out], [y for _, y in out])


def score(documents: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: list[str] = (), out: str = "score") -> DataFrame:
    """Rows (id, *keep, score): probability of label 1 of each whole text; a narrow stage. out names the score where score is taken."""
    sc = documents.sparkSession.sparkContext
    table, bias = model
    sent = sc.broadcast(table)  # one number per bucket: 1 MB, whatever the input

    cols = [id_col, *[c for c in keep if c != id_col]]
    text_name = free_name("text", cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in small_batches(batches, text_name, AT_ONCE):
            data, offsets = as_bytes(b.column(b.schema.get_field_index(text_name)))
            total, count = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for docs, idx in features(data, offsets):
                total += np.bincount(docs, table[idx], b.num_rows)
                count += np.bincount(docs, minlength=b.num_rows)
            z = total / np.maximum(1, count) + bias
            rest = [c for c in range(b.num_columns) if b.schema.names[c] != text_name]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [pa.array(1 / (1 + np.exp(-z)))], names=[b.schema.names[c] for c in rest] + [out])

    src = documents.select(*[F.col(f"`{c}`") for c in cols], F.col(text_col).alias(text_name))
    kinds = dict(documents.dtypes)
    return src.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in cols) + f", `{out}` double")


def quality_scores(documents: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of the held-out fold (crc32 of the id modulo folds) aren't learned."""
    model = learn(documents, labels.where(id_crc_mod("doc_id", folds) != held_out))
    out = score(documents, model)
    return out.select("doc_id", (id_crc_mod("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
