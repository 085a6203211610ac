"""What a worker gives back between stages."""

import numpy as np
import psutil
import pytest

from lexmill.llm import common


def test_a_worker_gives_back_what_is_free():
    if not hasattr(common.ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("another C library")
    held = [np.ones(9000) for _ in range(3000)]  # small blocks, with some that stay between them
    stay = held[::100]
    del held
    before = psutil.Process().memory_info().rss
    assert list(common.small_batches(iter([]), "text")) == []
    assert before - psutil.Process().memory_info().rss > 100e6 and len(stay) == 30


def test_scoring_takes_texts_in_small_blocks():
    import tracemalloc

    from lexmill.llm import quality

    row = "one sentence of some words, then the next one. "
    text = (row * (quality.AT_ONCE // len(row))).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64)
    tracemalloc.start()
    for _ in quality.features(data, offsets):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48e6  # a block of 1 MB took over 100 MB


def test_windows_are_hashed_in_small_steps():
    import tracemalloc

    from lexmill.llm import repeats

    data = np.random.default_rng(1).integers(97, 123, 3 << 20, dtype=np.uint8)
    offsets = np.arange(0, len(data) + 1, 1 << 12, dtype=np.int64)
    tracemalloc.start()
    doc, first, count, key = repeats._runs(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak - sum(x.nbytes for x in (doc, first, count, key)) < 32e6  # steps of 1 MB took 46 MB
    # each window once, whatever the steps
    assert count.sum() == len(offsets[1:]) * ((1 << 12) - repeats.LENGTH + 1)
    at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    assert len(np.unique(at)) == len(at) and (np.repeat(key, count) == repeats._keys(data)[at]).all()


def test_blocks_of_near_copies_are_compared_in_strips():
    import tracemalloc

    from lexmill.llm import near

    rng = np.random.default_rng(3)
    base = [rng.integers(0, 1 << 60, 200) for _ in range(64)]
    sets = []
    for i in range(2048):
        own = base[i % 64].copy()
        n = i // 64 % 16
        own[rng.permutation(200)[:n]] = rng.integers(0, 1 << 60, n)
        sets.append(np.unique(own))
    tracemalloc.start()
    label = near.close_parts(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6  # matrices of doubles took 130 MB
    assert (label == np.arange(2048) % 64).all()
