"""Removal of repeated byte strings by a suffix array over phrases.

A byte is removed if a string of ``length`` bytes that covers it starts anywhere else
too. The work goes from coarse to fine; no step can lose a repetition.

1. Each window of ``length`` bytes has an anchor, the 100 bytes at the smallest short
   hash in it. Equal windows have equal anchors, so only texts with an anchor seen
   twice go on, and of these only the windows whose anchor is one.
2. These texts are cut into phrases where a short hash is the smallest around, so
   equal bytes are cut equally. Phrases are the symbols of the suffix array; it holds
   the suffixes at cuts to which windows of the first step belong.
3. The array is one sort by range of the suffixes, each cut off after the phrases that
   every copy of its windows holds, or after ``DEPTH``.
4. Neighbours in the array are compared with all their windows at once; suffixes alone
   with their phrases drop out.
5. Where surroundings differ in part, blocks of a few windows are compared in the same
   way: a block without an equal in what all its windows hold drops out, one with an
   equal as a whole is removed. The windows of those left are compared one by one.

Places and byte strings are told apart by 64-bit hashes, texts too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.batches import _BASE, _BYTE, _UNBASE, mix, powers, quoted, slices, text_bytes
from shelfspark.llm.graph import BROADCAST_KEYS, stored

#: Bytes of an anchor, of the hash that decides on anchors and cuts, and places of which one is a cut.
GRAM, CUT_GRAM, CUT_WINDOW = 100, 8, 64
#: Phrases that the suffix array orders.
DEPTH = 9
_PLACE_BITS = np.uint64(28)
_PLACE = np.uint64((1 << 28) - 1)
#: Stands for the phrases beyond a stretch's end, below every symbol.
_END = np.int64(-(1 << 63))
#: Rows whose neighbours are looked up in one task, and suffixes of one text in a batch.
_CHUNK = 1 << 16
#: Windows in a block of the last step but one.
_BLOCK = 8
#: Bytes of text whose anchors are looked for at a time.
_SLICE = 1 << 18


class Prefixes:
    """Hashes of all substrings of a text from one running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_BASE, n), out=self.sums[1:])
        self.back = powers(_UNBASE, n + 1)

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        spans = (self.sums[b] - self.sums[a]) * self.back[a]
        return mix(spans + (b - a).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def grams(data: np.ndarray) -> np.ndarray:
    """The ``CUT_GRAM`` (8) bytes at each place as a number."""
    return np.ndarray(max(0, len(data) - CUT_GRAM + 1), np.dtype("<u8"), np.ascontiguousarray(data), strides=(1,)).copy()


def _keyed(hashes: np.ndarray) -> np.ndarray:
    """Hashes that tell their places, so that the leftmost of equal ones is the smallest."""
    return hashes >> _PLACE_BITS << _PLACE_BITS | np.arange(len(hashes), dtype=np.uint64)


def _least(keyed: np.ndarray, window: int) -> np.ndarray:
    """The place of the smallest of ``window`` values in a row, for each such row; none if there are fewer."""
    if len(keyed) < window:
        return np.zeros(0, np.int64)
    size = 1
    while 2 * size <= window:
        keyed = np.minimum(keyed[:-size], keyed[size:])
        size *= 2
    if size < window:
        keyed = np.minimum(keyed[: len(keyed) - (window - size)], keyed[window - size :])
    return (keyed & _PLACE).astype(np.int64)


def _changes(values: np.ndarray) -> np.ndarray:
    """The different values of an ascending array."""
    return values[np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]])]


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the leftmost smallest value of some ``window`` places in a row; none if there are fewer."""
    return _changes(_least(_keyed(hashes), window))


def _rows(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    data, bounds = text_bytes(texts)
    for i in range(len(texts)):
        yield i, data[bounds[i] : bounds[i + 1]]


def place_hash(tid: np.ndarray | int, place: np.ndarray) -> np.ndarray:
    """One value for a place in a text."""
    return mix(mix(np.atleast_1d(np.asarray(tid, np.int64)).view(np.uint64)) + place.astype(np.uint64) * np.uint64(_BASE)).view(np.int64)


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, _SLICE):
            tids = part.column(0).to_numpy(zero_copy_only=False)
            data, bounds = text_bytes(part.column(1))
            values = grams(data)
            low = _least(_keyed(mix(values))[: max(0, len(data) - GRAM + 1)], length - GRAM + 1)
            # Windows within one text.
            steps = np.zeros(len(data) + 1, np.int64)
            np.add.at(steps, bounds[:-1], 1)
            np.add.at(steps, np.maximum(bounds[:-1], bounds[1:] - length + 1), -1)
            at = _changes(low[np.cumsum(steps)[: len(low)] > 0])
            hashes = np.zeros(len(at), np.uint64)
            for k in [*range(0, GRAM - CUT_GRAM, CUT_GRAM), GRAM - CUT_GRAM]:
                hashes = mix(hashes + values[at + k] + np.uint64(_BASE))
            row = np.searchsorted(bounds, at, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(tids[row]), pa.array(at - bounds[row])], names=["hash", "tid", "place"])

    return texts.mapInArrow(run, "hash long, tid long, place long")


def phrases(data: np.ndarray, marks: np.ndarray, length: int) -> tuple[np.ndarray, ...] | None:
    """For each cut near a mark: place, phrase and next two phrases, phrases left in the stretch, prefix hash, windows, surroundings.

    A cut depends on ``CUT_WINDOW`` places on either side, so equal strings have equal
    cuts but for their ends. A window belongs to the first cut certain to be equal in
    all its copies; ``lo`` to ``hi`` are the starts of a cut's windows, from the first to
    the last whose anchor is a mark (``lo`` > ``hi``: none). The prefix hash covers as many
    phrases as every copy of such a window holds, ``DEPTH`` at most.
    The next phrases beyond a stretch's end are ``_END``.
    """
    n, reach = len(data), CUT_WINDOW - 1
    pre, keyed = Prefixes(data), _keyed(mix(grams(data)))
    cuts = _changes(_least(keyed, CUT_WINDOW))
    if not len(cuts):
        return None
    marked = np.zeros(n, bool)
    marked[marks] = True
    asked = np.flatnonzero(marked[_least(keyed[: max(0, n - GRAM + 1)], length - GRAM + 1)])
    ends = np.append(cuts[1:], n)
    symbol = pre.hash(cuts, ends)
    symbol[symbol == np.array(_END).view(np.uint64)] += np.uint64(1)
    padded = np.concatenate([symbol, np.zeros(2, np.uint64)])
    last = np.minimum(np.searchsorted(cuts, cuts + certain(length)), np.minimum(np.arange(len(cuts)) + DEPTH, len(cuts)))
    prefix = pre.hash(cuts, np.append(cuts, n)[last])
    before = np.concatenate([[-(1 << 40)], cuts[:-1]])
    lo, hi = np.maximum(0, before + 1 - reach), np.minimum(cuts - reach, n - length)
    first, final = np.searchsorted(asked, lo), np.searchsorted(asked, hi, "right") - 1
    some = (lo <= hi) & (first <= final)
    lo[some], hi[some] = asked[first[some]], asked[final[some]]
    lo[~some], hi[~some] = 1, 0
    around = np.zeros(len(cuts), np.uint64)
    around[some] = pre.hash(lo[some], hi[some] + length)
    # Stretches around the marks that hold every window with a mark, and what its prefix needs.
    near = np.zeros(len(cuts) + 1, np.int64)
    np.add.at(near, np.searchsorted(cuts, marks - length), 1)
    np.add.at(near, np.searchsorted(cuts, marks + 2 * length), -1)
    kept = np.cumsum(near[:-1]) > 0
    run_end = np.append(np.flatnonzero(kept[:-1] & ~kept[1:]), len(cuts) - 1)
    at = np.flatnonzero(kept)
    left = run_end[np.searchsorted(run_end, at)] - at
    # All sorts must cut a suffix at the same place, the stretch's end, or equal prefixes are no longer neighbours.
    next1, next2 = (np.where(left < k, _END, padded[at + k].view(np.int64)) for k in (1, 2))
    fields = (cuts, symbol.view(np.int64), prefix.view(np.int64), lo, hi, around.view(np.int64))
    place, symbol, *rest = [x[at] for x in fields]
    return place, symbol, next1, next2, *rest, left


def certain(length: int) -> int:
    """Bytes beyond a cut that every window of the cut holds, both uncertain ends left out."""
    return length - 2 * (CUT_WINDOW - 1) - CUT_GRAM - 2 * CUT_WINDOW


def _suffix_rows(texts: DataFrame, length: int) -> DataFrame:
    """The suffixes with windows: key (their phrases, four bytes each), around, tid, place, lo, hi."""
    names = ["key", "around", "tid", "place", "lo", "hi"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def batch(symbols: list[np.ndarray], sizes: list[np.ndarray], out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        key = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(symbols).astype(">u4"))])
        columns = [np.concatenate(x) for x in zip(*out)]
        return pa.RecordBatch.from_arrays([key, *[pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            tids, marks = part.column(0).to_numpy(zero_copy_only=False), part.column(2)
            symbols, sizes, out, step = [], [], [], np.arange(DEPTH)
            for i, data in _rows(part.column(1)):
                got = phrases(data, marks[i].values.to_numpy(zero_copy_only=False), length)
                if got is None:
                    continue
                place, symbol, _, _, _, lo, hi, around, left = got
                high = np.concatenate([(symbol.view(np.uint64) >> np.uint64(32)).astype(np.uint32), np.zeros(DEPTH, np.uint32)])
                asked = np.flatnonzero(lo <= hi)
                # A text of one repeated byte has a cut at every place.
                for at in np.split(asked, range(_CHUNK, len(asked), _CHUNK)):
                    held = np.minimum(np.searchsorted(place, place[at] + certain(length)) - at, np.minimum(left[at] + 1, DEPTH))
                    symbols.append(high[at[:, None] + step][step < held[:, None]])
                    sizes.append(4 * held)
                    out.append((around[at], np.full(len(at), tids[i]), place[at], lo[at], hi[at]))
                    if len(at) == _CHUNK:
                        yield batch(symbols, sizes, out)
                        symbols, sizes, out = [], [], []
            if out:
                yield batch(symbols, sizes, out)

    return texts.mapInArrow(run, "key binary, around long, tid long, place int, lo int, hi int")


def _phrase_keys(symbols: DataFrame) -> DataFrame:
    """Adds ``key``, the symbols of a row and of those that follow in its stretch, ``DEPTH`` at most.

    Rows are handled in chunks of places; a chunk also gets the first rows of the next.
    """
    chunk = F.floor(F.col("at") / _CHUNK)
    overlap = F.array_distinct(F.array(chunk, F.floor((F.col("at") - DEPTH + 1) / _CHUNK)))
    near = Window.partitionBy("_chunk").orderBy("at").rangeBetween(0, DEPTH - 1)
    spread = symbols.withColumn("_chunk", F.explode(overlap)).withColumn("key", F.collect_list("symbol").over(near))
    return spread.where(F.col("_chunk") == chunk).withColumn("key", F.slice("key", 1, F.least(F.col("left") + 1, F.lit(DEPTH)).cast("int"))).drop("_chunk")


def suffix_order(symbols: DataFrame) -> DataFrame:
    """The rows with ``position``, which grows with the suffixes' order (with gaps): the suffix array.

    ``symbols`` has suffixes by their ``key``, or phrases: at (consecutive within a
    stretch), symbol, left (phrases that follow in the stretch). Equal suffixes lie in one
    partition, by ``around`` if there is such a column.
    """
    keyed = symbols if "key" in symbols.columns else _phrase_keys(symbols)
    order = ["key", *[c for c in ("around",) if c in keyed.columns]]
    parts = int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionByRange(parts, "key").sortWithinPartitions(*order).withColumn("position", F.monotonically_increasing_id())


def _compared(rows: DataFrame, key: str, value: str, open: Column) -> DataFrame:
    """Adds ``repeated`` (a neighbour has the value too) and ``asked``.

    Asked is one row of each value where a key has several and an ``open`` row that is not repeated.
    """
    by, all = Window.partitionBy(key).orderBy(value), Window.partitionBy(key)
    rows = rows.withColumn("_same", F.coalesce(F.lag(value).over(by) == F.col(value), F.lit(False)))
    rows = rows.withColumn("repeated", F.col("_same") | F.coalesce(F.lead(value).over(by) == F.col(value), F.lit(False)))
    mixed = (F.min(value).over(all) != F.max(value).over(all)) & F.max(open & ~F.col("repeated")).over(all)
    return rows.withColumn("asked", ~F.col("_same") & mixed).drop("_same")


def _blocks(texts: DataFrame, length: int) -> DataFrame:
    """(held, whole, tid, lo, hi, alone) of the blocks of the asked windows of (tid, text, asked: place, lo, hi, alone).

    A block's windows start at places alike before their cut, so copies have equal blocks. ``held`` is what all
    windows of a full block have, ``whole`` what the asked ones have together.
    """
    names = ["held", "whole", "tid", "lo", "hi", "alone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            tids = part.column(0).to_numpy(zero_copy_only=False)
            out = [(np.zeros(0, np.int64),) * 5 + (np.zeros(0, bool),)]
            for i, (data, asked) in enumerate(_asked(part)):
                pre = Prefixes(data)
                place, low, high, alone = (asked[k] for k in ("place", "lo", "hi", "alone"))
                first, n = (place - high) // _BLOCK, (place - low) // _BLOCK - (place - high) // _BLOCK + 1
                row = np.repeat(np.arange(len(n)), n)
                near = (first[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * _BLOCK
                end = place[row] - near
                lo, hi = np.maximum(low[row], end - _BLOCK + 1), np.minimum(high[row], end)
                held, whole = pre.hash(end, end - _BLOCK + 1 + length), pre.hash(lo, hi + length)
                out.append((held.view(np.int64), whole.view(np.int64), np.full(len(row), tids[i]), lo, hi, alone[row]))
            yield _batch(out, names)

    return texts.mapInArrow(run, "held long, whole long, tid long, lo int, hi int, alone boolean")


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """(window, tid, start, alone) of the asked windows of (tid, text, asked: lo, hi, alone)."""
    names = ["window", "tid", "start", "alone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            tids = part.column(0).to_numpy(zero_copy_only=False)
            out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)]
            for i, (data, asked) in enumerate(_asked(part)):
                n = asked["hi"] - asked["lo"] + 1
                at = np.repeat(asked["lo"] - np.cumsum(n) + n, n) + np.arange(n.sum())
                out.append((Prefixes(data).hash(at, at + length).view(np.int64), np.full(len(at), tids[i]), at, np.repeat(asked["alone"], n)))
            yield _batch(out, names)

    return texts.mapInArrow(run, "window long, tid long, start int, alone boolean")


def _asked(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """(bytes, fields of the asked list) of each row."""
    lists = part.column(2)
    fields = lists.flatten()
    columns = {f.name: c.to_numpy(zero_copy_only=False) for f, c in zip(fields.type, fields.flatten())}
    columns = {k: c if c.dtype == bool else c.astype(np.int64) for k, c in columns.items()}
    ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
    for i, data in _rows(part.column(1)):
        yield data, {k: c[ends[i] : ends[i + 1]] for k, c in columns.items()}


def _batch(out: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    columns = [np.concatenate(x) for x in zip(*out)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if n in ("lo", "hi", "start") else c) for n, c in zip(names, columns)], names=names)


def _joined(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans (a, b) of each row of (tid, spans) as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lists = part.column(1)
            a, b = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
            out = []
            for lo, hi in zip(ends[:-1], ends[1:]):
                order = np.argsort(a[lo:hi], kind="stable")
                first, last = a[lo:hi][order], np.maximum.accumulate(b[lo:hi][order])
                new = np.concatenate([[True], first[1:] > last[:-1]])
                out.append([{"a": x, "b": y} for x, y in zip(first[new].tolist(), last[np.append(new[1:], True)].tolist())])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["tid", "spans"])

    return spans.mapInArrow(run, "tid long, spans array<struct<a:int,b:int>>")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def repeated_spans(rows: DataFrame, length: int = 400) -> DataFrame:
    """(tid, spans) for the texts of ``rows`` (tid, text) with repeated strings, their own copies aside."""
    anchors = stored(_anchors(rows, length), "anchors")
    loc = F.xxhash64("tid", "place")
    twice = anchors.groupBy("hash").agg(F.min(loc).alias("a"), F.max(loc).alias("z")).where("a != z").select("hash")
    marked = stored(
        anchors.join(twice, "hash", "left_semi").select("tid", F.col("place").cast("int")).distinct().groupBy("tid").agg(F.sort_array(F.collect_list("place")).alias("marks")),
        "marks",
    )
    few = marked.count() <= BROADCAST_KEYS
    texts = rows.join(F.broadcast(marked.select("tid")) if few else marked, "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text"))
    texts = stored(texts, "marked-texts")
    suffixes = stored(_suffix_rows(texts.join(marked, "tid").select("tid", "text", "marks"), length), "suffixes")
    alone = (~F.col("repeated")).alias("alone")
    kinds = _compared(suffix_order(suffixes), "key", "around", F.lit(True)).where("repeated or asked")
    kinds = stored(kinds.select("tid", "place", "lo", "hi", "repeated", "asked"), "kinds")
    asked = kinds.where("asked").groupBy("tid").agg(F.collect_list(F.struct("place", "lo", "hi", alone)).alias("asked"))
    blocks = _compared(_blocks(texts.join(asked, "tid").select("tid", "text", "asked"), length), "held", "whole", F.col("alone"))
    # Surroundings seen before are removed and speak once for all of their kind.
    blocks = stored(blocks.where("repeated and alone or asked").select("tid", "lo", "hi", "repeated", "asked", "alone"), "blocks")
    still = (F.col("alone") & ~F.col("repeated")).alias("alone")
    asked = blocks.where("asked").groupBy("tid").agg(F.collect_list(F.struct("lo", "hi", still)).alias("asked"))
    windows = _windows(texts.join(asked, "tid").select("tid", "text", "asked"), length)
    windows = windows.withColumn("n", F.count("*").over(Window.partitionBy("window"))).where("alone and n > 1")
    spans = kinds.where("repeated").select("tid", "lo", "hi").unionByName(blocks.where("repeated and alone").select("tid", "lo", "hi"))
    spans = spans.unionByName(windows.select("tid", F.col("start").alias("lo"), F.col("start").alias("hi")))
    spans = spans.groupBy("tid").agg(F.collect_list(F.struct(F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))).alias("spans"))
    return _joined(spans)


def remove_repeats(docs: DataFrame, length: int = 400, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) for each row of ``docs``.

    Removed are the bytes of all strings of ``length`` bytes that also start elsewhere,
    in the same row or another; ``kept`` holds the others, ``spans`` the maximal removed
    runs. Null texts are empty; texts shorter than ``length`` stay as they are. Repeated
    rows are copies of each other. An empty table gives an empty result; other columns
    don't matter.
    """
    rows = docs.select(quoted(id).cast("long").alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    long = rows.where(F.octet_length("text") >= length)
    copies = long.groupBy("tid").agg(F.count("*").alias("n")).where("n > 1").select("tid", F.lit(True).alias("copied"))
    spans = stored(repeated_spans(long.select("tid", "text"), length).join(copies, "tid", "full"), "spans")
    total = spans.agg(F.count("*") + F.coalesce(F.sum(F.size(F.coalesce("spans", F.array()))), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(spans) if total <= BROADCAST_KEYS else spans, "tid", "left").select("doc_id", "text", "spans", "copied")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            out = []
            for (i, data), spans, copied in zip(_rows(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist()):
                n, whole = len(data), data.tobytes()
                runs = [(0, n)] if copied else _merged([(s["a"], s["b"]) for s in spans or []])
                edges = [0, *[x for run in runs for x in run], n]
                kept = b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((n, n - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in runs], kept))
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

    return joined.mapInArrow(
        run,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary",
    )
