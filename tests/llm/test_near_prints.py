"""The pipeline's near copies: links by fingerprints."""

import random

import numpy as np

import corpus_pipeline
from lexmill.llm import near, simhash


def test_fingerprints_link_near_copies(spark, monkeypatch):
    """Without a single shared MinHash key, copies within two bits are found by the fingerprints' index; far texts stay."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(12):
        words = [word() for _ in range(900)]
        texts += [" ".join(words), " ".join([*words, word()])]
    prints = [simhash.folded(near.shingles(t)) for t in texts]
    close = [i for i in range(0, 24, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= 2]
    assert len(close) > 6
    monkeypatch.setattr(near, "band_keys", lambda marks: np.array([int(np.bitwise_xor.reduce(marks)) >> 1], np.int64))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", near.F.lit("x"))
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert left == set(range(24)) - {i + 1 for i in close}
