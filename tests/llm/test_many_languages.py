"""Cross-parsing with more languages than any dense table of states could number."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import language

LANGUAGES, LETTERS = 50, [*"abcdefghijklmnopqrstuvwxyz", *"éßж日āőñçøыя"]


def text(k, size, seed):
    own, rnd = random.Random(k), random.Random(seed)
    parts = ["".join(own.choices(LETTERS, k=own.randrange(2, 4))) for _ in range(40)]
    words = ["".join(own.choices(parts, k=own.randrange(1, 4))) for _ in range(2000)]
    return " ".join(rnd.choice(words) for _ in range(size // 9))


def plain(sample, doc):
    edges, n, state = language.Automaton(sample).next, 0, 0
    for c in doc.tolist():
        if c in edges[state]:
            state = edges[state][c]
            continue
        n += state > 0
        state = edges[0].get(c, 0)
        n += state == 0
    return n + (state > 0)


@pytest.fixture(scope="module")
def parser():
    samples = {f"l{k:02d}": language.symbols(text(k, 80_000, 100 + k)).tobytes()[:65536] for k in range(LANGUAGES)}
    return language.Parser(samples, {}), samples


def test_full_samples_of_fifty_languages(parser):
    p, samples = parser
    docs = [language.symbols(text(k, 2500, 999 + k)) for k in range(LANGUAGES)]
    found = p.phrases(docs)
    assert found.argmin(1).tolist() == list(range(LANGUAGES))
    assert all(found[d, k] == plain(samples[p.langs[k]], docs[d]) for d, k in [(0, 0), (3, 49), (49, 48), (20, 49)])
    assert sum(x.nbytes for x in (p.base, p.check, p.next, p.fresh)) < 100 << 20 and p.check.min() >= -1 and p.next.min() >= 0


def test_one_huge_labelled_text_is_read_in_part_and_megabytes_are_parsed(spark):
    rows = [(1, text(1, 400_000, 5), "aa"), (2, text(2, 3000, 6), "bb"), (3, text(2, 2_000_000, 7), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs, max_bytes=4096, longest=60_000)
    assert len(model[0]["aa"]) <= 2 * 60_000 + 1
    got = {r.doc_id: r.lang_pred for r in language.predict(docs.where(F.col("doc_id") > 1), model).collect()}
    assert got == {2: "bb", 3: "bb"}


def test_states_share_slots_without_conflict():
    p = language.Parser({"a": b"abracadabra", "b": b"zz top z"}, {})
    sizes = [len(language.Automaton(s).next) for s in (b"abracadabra", b"zz top z")]
    edges = sum(len(e) for s in (b"abracadabra", b"zz top z") for e in language.Automaton(s).next[1:])
    assert len(p.base) == sum(sizes) and np.count_nonzero(p.check >= 0) == edges
