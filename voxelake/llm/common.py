"""Shared helpers: Arrow batch slicing, integer mixing, bounded memos."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from voxelake.sources.shared import materialize, shared_dir

__all__ = ["Memo", "free_name", "in_turn", "materialize", "mix64", "shared_dir", "slices", "table"]

#: Text is handled in slices of about this many characters, so that one Arrow
#: batch never unfolds into more than a few tens of MB of Python objects.
SLICE_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows holding about ``most`` bytes of ``text``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.frombuffer(_lengths(col), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _lengths(col: pa.Array) -> bytes:
    return pc.fill_null(pc.cast(pc.binary_length(col), pa.int64()), 0).to_numpy(zero_copy_only=False).tobytes()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores after it as make it none of the table's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, xor-shift) on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Memo(dict):
    """A dict that a Python worker keeps between batches, in two generations of about ``most`` entries.

    ``missing`` brings what the older generation knows back into the younger one; what
    no batch of a whole generation asked for is forgotten.
    """

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most
        self.older: dict = {}

    def room(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()

    def missing(self, keys: Iterable) -> list:
        """Those of the distinct ``keys`` that nothing is known of."""
        new = [k for k in keys if k not in self]
        if self.older:
            known = [(k, self.older[k]) for k in new if k in self.older]
            self.update(known)
            if known:
                new = [k for k in new if k not in self]
        return new


_forget: dict[str, Callable[[], object]] = {}


def give_back() -> None:
    """Hand freed memory back to the system: a Python worker lives on through many stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def in_turn(name: str, forget: Callable[[], object]) -> None:
    """Called as an operator begins in a Python worker: what other operators keep there is forgotten, so that memos don't add up."""
    others = [o for o in _forget if o != name]
    for other in others:
        _forget.pop(other)()
    if others:
        give_back()
    _forget[name] = forget
