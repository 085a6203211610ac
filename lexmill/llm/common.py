"""What the operators share: Arrow access, staging and crc filters."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import cut, ensure_checkpoint_dir  # noqa: F401, used by the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(base: str, taken: list[str]) -> str:
    """base, with as many underscores behind it as no taken name has, whatever the case of letters."""
    low = {t.lower() for t in taken}
    while base.lower() in low:
        base += "_"
    return base


def id_crc_mod(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


class Memory(dict):
    """A function's values, remembered for keys of at most ``longest`` characters."""

    def __init__(self, of: Callable[[str], Any], most: int, longest: int):
        super().__init__()
        self.of, self.most, self.longest = of, most, longest

    def __missing__(self, key: str) -> Any:
        value = self.of(key)
        if len(key) <= self.longest:
            self[key] = value
        return value

    def make_room(self) -> None:
        """Above ``most`` the keys met last go: frequent ones were met first."""
        if len(self) > self.most:
            for key in list(islice(reversed(self), len(self) - self.most // 2)):
                del self[key]


def release() -> None:
    """Give freed memory back to the system: a worker serves stage after stage, and what their arrays leave behind adds up."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches that hold about max_bytes of text (one row at least); before and after them freed memory goes back."""
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(size, size[start] + max_bytes, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
    release()


def as_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes without gaps, and the n+1 offsets of its values; nulls are empty."""
    offsets = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8) if len(col.buffers()) > 2 and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    if col.null_count:
        sizes = np.diff(offsets)
        valid = np.asarray(col.is_valid())
        if sizes[~valid].any():  # a null over bytes: take the values one by one
            parts = [np.frombuffer(x or b"", np.uint8) for x in col.cast(pa.binary()).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            return (np.concatenate(parts) if parts else data[:0]), offsets
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
