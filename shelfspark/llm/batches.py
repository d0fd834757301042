"""Arrow batches: slices of bounded size, columns added in tasks, words and hashes of whole batches.

Texts are worked on as the bytes of an Arrow buffer, many rows at a time. A slice
holds a few MB of text (one row if that row is longer), so memory follows the
longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text in one slice.
SLICE_BYTES = 2 << 20
#: Bytes hashed at a time; eight times as much is held for the sums.
_HASH_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def slices(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, each slice with about ``limit`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def other_columns(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of ``df`` without those that clash with ``names`` (in any letter case)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def add_columns(
    df: DataFrame,
    column: str,
    fields: StructType,
    compute: Callable[[pa.Array], list[pa.Array]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` of ``df`` (default: all) and ``fields``, computed from ``column`` slice by slice.

    A kept column that clashes with a new one is left out. ``column`` sets the size of
    slices; it may itself be replaced.
    """
    kept = [c for c in other_columns(df, fields.names) if keep is None or c in keep]
    source = df.select(*[quoted(c) for c in kept], *([] if column in kept else [quoted(column)]))
    schema = StructType([*[df.schema[c] for c in kept], *fields.fields])
    at = kept.index(column) if column in kept else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *compute(part.column(at))], names=schema.names)

    return source.mapInArrow(run, schema)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows joined, and the rows' bounds in them (nulls are empty)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    joined = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return joined[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words(NamedTuple):
    """Words of a slice: row, first byte, end byte, hash."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One random value for each byte value.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, modulo 2 to the 64."""
    if len(_POWERS.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[base][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for ordered, disjoint spans."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + _HASH_BYTES, "right")))
        first, last = int(start[lo]), int(end[hi - 1])
        n = last - first
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data[first:last]] * powers(_BASE, n), out=sums[1:])
        a, b = start[lo:hi] - first, end[lo:hi] - first
        spans = (sums[b] - sums[a]) * powers(_UNBASE, n + 1)[a]
        out[lo:hi] = mix(spans + (b - a).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        if n > _HASH_BYTES:
            _POWERS.clear()
        lo = hi
    return out


def words(texts: pa.Array, lower: bool = False) -> Words:
    """All words (runs of other bytes than the six ASCII blanks) of a slice, in order."""
    data, bounds = text_bytes(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64))
    if lower:
        data = _LOWER[data]
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds[:-1]] = True  # a row of no bytes marks the next one's first byte, which is a first byte anyway
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(bounds, start, "right") - 1
    return Words(row, start, end, span_hashes(data, start, end))


def run_hashes(row: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` values within one row, and the index of its first value."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total = total * np.uint64(_BASE) + hashes[at + k]
    return mix(total), at
