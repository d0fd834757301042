"""Byte-level BPE: encoding by reduction over a tree of halves, decoding by joining up the tree.

A text is cut by the vocabulary's pattern; each match is encoded for itself. A
match is halved down to short runs, which are merged directly. Two neighbours are
joined by encoding a window around their boundary anew. The window grows until
the tokens on both sides of it are certain to stay: a row of tokens is the
encoding of its bytes if and only if each two neighbours are the encoding of
their joined bytes, so it is enough that the window's first and last token go
with the tokens beside it. Joining is associative, so the order of the tree does
not matter.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from shelfspark.llm.batches import add_columns, other_columns, quoted

#: Bytes up to which a run is merged directly.
LEAF_BYTES = 24
#: Matches kept with their tokens, per Python worker, and the longest kept.
CACHED, CACHED_CHARS = 150_000, 40
#: Above every rank.
_NONE = 1 << 62
#: Tokens joined at once in decoding.
LEAF_TOKENS = 4096


class BytePairs:
    """Encoder and decoder for one vocabulary of ranks.

    Every token of the vocabulary must be the encoding of its own bytes, as in any
    vocabulary made by merging.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.token = {i: b for b, i in ranks.items()}
        self._pairs: tuple[np.ndarray, np.ndarray] | None = None
        self._stays: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        return cls(ranks, pattern)

    def merge(self, run: bytes) -> list[int]:
        """Merges the pair of lowest rank, the leftmost of equals, until none is left."""
        whole = self.ranks.get(run)
        if whole is not None:
            return [whole]
        return self._merge_short(run) if len(run) <= 64 else self._merge_long(run)

    def _merge_short(self, run: bytes) -> list[int]:
        rank = self.ranks.get
        parts = [run[i : i + 1] for i in range(len(run))]
        pairs = [rank(run[i : i + 2], _NONE) for i in range(len(run) - 1)]
        while pairs and (best := min(pairs)) != _NONE:
            i = pairs.index(best)
            whole = parts[i] + parts[i + 1]
            parts[i : i + 2] = [whole]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + whole, _NONE)
            if i < len(pairs):
                pairs[i] = rank(whole + parts[i + 1], _NONE)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, run: bytes) -> list[int]:
        """The same with a heap, for windows that a repetitive text makes long."""
        n, rank = len(run), self.ranks.get
        end, before, after = [i + 1 for i in range(n)], [i - 1 for i in range(n)], [i + 1 for i in range(n)]
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(run[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(run[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := rank(run[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        return [self.ranks[run[i : end[i]]] for i in range(n) if alive[i]]

    def _pair_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all pairs of tokens that merge, in order, and the merged tokens."""
        if self._pairs is None:
            rank = self.ranks.get
            pairs = sorted(
                (a << 32 | b, whole)
                for run, whole in self.ranks.items()
                for i in range(1, len(run))
                if (a := rank(run[:i])) is not None and (b := rank(run[i:])) is not None
            )
            self._pairs = np.array([k for k, _ in pairs], np.int64), np.array([v for _, v in pairs], np.int64)
        return self._pairs

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, wholes = self._pair_table()
        wanted = a << 32 | b
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted) & (a >= 0) & (b >= 0), wholes[at], _NONE)

    def merge_many(self, runs: list[bytes]) -> list[bytes]:
        """``merge`` of many runs of one length at once; 32-bit ids as bytes."""
        byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        n, size = len(runs), len(runs[0])
        ids = byte[np.frombuffer(b"".join(runs), np.uint8)].reshape(n, size)
        # One column more on the right, of no token, so that every pair has a neighbour.
        ids = np.concatenate([ids, np.full((n, 1), -1, np.int64)], axis=1)
        pairs = self._ranks_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, size)
        done_ids, left = ids.copy(), np.arange(n)
        while len(left):
            at = pairs.argmin(axis=1)
            rows = np.arange(len(left))
            best = pairs[rows, at]
            go = best != _NONE
            if not go.all():
                done_ids[left[~go], : ids.shape[1]] = ids[~go]
                done_ids[left[~go], ids.shape[1] :] = -1
                left, ids, pairs, at, best = left[go], ids[go], pairs[go], at[go], best[go]
                rows = np.arange(len(left))
                if not len(left):
                    break
            ids[rows, at] = best
            shift = np.arange(ids.shape[1] - 1)[None, :] > at[:, None]
            ids = np.where(shift, ids[:, 1:], ids[:, :-1])
            pairs = np.where(shift[:, :-1], pairs[:, 1:], pairs[:, :-1])
            pairs[rows, at.clip(max=pairs.shape[1] - 1)] = _NONE
            after = at < ids.shape[1] - 1
            pairs[rows[after], at[after]] = self._ranks_of(best[after], ids[rows[after], at[after] + 1])
            before = at > 0
            pairs[rows[before], at[before] - 1] = self._ranks_of(ids[rows[before], at[before] - 1], best[before])
        kept = done_ids >= 0
        ends = [0, *(4 * np.cumsum(kept.sum(axis=1))).tolist()]
        flat = done_ids[kept].astype(np.int32).tobytes()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def encode_runs(self, runs: list[bytes]) -> list[bytes]:
        """32-bit ids of many matches, as bytes: short ones by length, all at once, the others by halves."""
        out: list[bytes] = [b""] * len(runs)
        by_size: dict[int, list[int]] = {}
        for i, run in enumerate(runs):
            whole = self.ranks.get(run)
            if whole is not None:
                out[i] = np.int32(whole).tobytes()
            elif 1 < len(run) <= LEAF_BYTES:
                by_size.setdefault(len(run), []).append(i)
            else:
                out[i] = np.array(self.encode_run(run), np.int32).tobytes()
        for at in by_size.values():
            for i, got in zip(at, self.merge_many([runs[i] for i in at])):
                out[i] = got
        return out

    def encode_run(self, run: bytes) -> list[int]:
        """Tokens of one match, by halves."""
        if len(run) <= LEAF_BYTES or run in self.ranks:
            return self.merge(run) if run else []
        half = len(run) // 2
        return self.join(self.encode_run(run[:half]), self.encode_run(run[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the joined bytes of two encodings."""
        if not left or not right:
            return left or right
        reach = 1
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            window = self.merge(b"".join([self.token[t] for t in (*left[i:], *right[:j])]))
            if (i == 0 or self.stay(left[i - 1], window[0])) and (j == len(right) or self.stay(window[-1], right[j])):
                return left[:i] + window + right[j:]
            reach *= 2

    def stay(self, a: int, b: int) -> bool:
        """True if two neighbours are the encoding of their joined bytes."""
        known = self._stays.get((a, b))
        if known is None:
            if len(self._stays) >= CACHED:
                self._stays.clear()
            known = self._stays[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the tokens, joined up the tree."""
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Matches(dict):
    """Tokens of matches, as the bytes of 32-bit ids; emptied when full."""

    def __init__(self, pairs: BytePairs):
        super().__init__()
        self.pairs = pairs

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as bytes."""
        find = self.pairs.pattern.findall
        rows = [find(t) if t else [] for t in texts]
        new = [m for m in set().union(*rows) if m not in self]
        if len(self) + len(new) > CACHED:
            self.clear()
            new = list(set().union(*rows))
        self.update(zip(new, self.pairs.encode_runs([m.encode() for m in new])))
        got = [b"".join(map(self.__getitem__, row)) for row in rows]
        for m in new:
            if len(m) > CACHED_CHARS:
                del self[m]
        return got


_LOADED: dict[tuple[str, str], _Matches] = {}


def _loaded(path: str, pattern: str) -> _Matches:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = _Matches(BytePairs.load(path, pattern))
    return _LOADED[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) and ``ids``, the token ids of ``text``; also ``decoded``, the bytes of these ids, if named.

    Decoding in the same pass saves a second Python worker for each task.

    ``path`` names a file of ranks that every executor can read (it comes with an
    installed package). A null text counts as empty and has no tokens; a column
    named like ``ids`` is replaced. Rows stay as they are, repeated ones included.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        rows = _loaded(path, pattern).encode(texts.to_pylist())
        ends = np.cumsum([0, *map(len, rows)]) // 4
        columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))]
        if decoded:
            back = _loaded(path, pattern).pairs.decode
            columns.append(pa.array([back(np.frombuffer(row, np.int32).tolist()) for row in rows], pa.binary()))
        return columns

    fields = [StructField(ids, ArrayType(IntegerType())), *([StructField(decoded, BinaryType())] if decoded else [])]
    return add_columns(df, text, StructType(fields), compute, keep)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the bytes of the tokens in ``ids`` (null ids: no bytes)."""
    keep = other_columns(df, [out])
    schema = StructType([*[df.schema[c] for c in keep], StructField(out, BinaryType())])
    # The ids once more, as the last column, so that no name matters.
    source = df.select(*[quoted(c) for c in keep], quoted(ids).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _loaded(path, pattern).pairs
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = [pairs.decode(x.values.to_pylist()) if x.is_valid else b"" for x in part.columns[-1]]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)
