"""Benchmark decontamination by templates: also finds questions with other numbers, names or units.

Words lose their edge punctuation and their letter case. Numbers, names and units
become typed placeholders, so a question and its copy with other values have one
template. Windows of the template are hash-joined with those of the benchmark.
Matches are put together by alignment (place in the document minus place in the
item); an alignment counts as a leak if it covers enough of the item and its slots
are consistent, that is if each value of the item stands for one value of the
document throughout.

A fixed bitmap of the benchmark's window hashes goes to the tasks, so that only
windows that may match leave them. It has the same size for any benchmark; a larger
benchmark only lets more windows through to the exact join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.batches import _BYTE, _SPACE, quoted, run_hashes, slices, span_hashes, text_bytes
from shelfspark.llm.graph import stored

#: Template tokens in a window, and plain words that it must hold.
WINDOW, PLAIN = 8, 4
#: Items with fewer tokens than this have no template windows.
SHORTEST = 5
#: Items that templates can't show are looked for word by word, from so many words on.
SHORTEST_LITERAL = 3
#: Windows of one alignment that make a leak, or this share of a short item's.
LEAK_WINDOWS, LEAK_SHARE = 6, 0.8
#: Share of an alignment's slots that must follow one mapping.
CONSISTENT = 0.8
BITMAP_BITS = 23

# Units that may follow a number.
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t lb oz ml cl dl l gal s sec min h hr hrs day days ms ns hz khz mhz ghz "
    "w kw mw v kv a ma j kj cal kcal pa kpa bar c f k b kb mb gb tb px dpi % percent usd eur gbp dollars euros "
    "seconds minutes hours weeks months years meters metres kilometers kilometres miles feet inches grams "
    "kilograms pounds ounces liters litres degrees"
).split()

_CORE = np.zeros(256, bool)
_CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), ord("%")]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;")] = True
_NUMBER, _NAME, _UNIT = (np.uint64(int(x)) for x in _BYTE[:3])


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin-1 letters of UTF-8 (C3 80 to C3 9E)."""
    out = data.copy()
    out[_UPPER[data]] += 32
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    latin = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[latin] += 32
    return out


def _hashes_of(tokens: list[str]) -> np.ndarray:
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    return span_hashes(np.frombuffer(" ".join(tokens).encode(), np.uint8), np.concatenate([[0], ends[:-1] + 1]), ends)


_UNIT_HASHES = np.sort(_hashes_of(UNITS))


def tokens(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, word's start, word's end, token's start, token's end, hash in lower case) of each token, and the bytes.

    A token is a word without the punctuation at its edges; a word of punctuation alone is none.
    """
    data, bounds = text_bytes(texts)
    none = np.zeros(0, np.int64)
    core = np.flatnonzero(_CORE[data])
    if not len(core):
        return none, none, none, none, none, np.zeros(0, np.uint64), data
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds[:-1]] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | first[1:-1]
    ends[:-1] &= ~word[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    lo, hi = np.searchsorted(core, start), np.searchsorted(core, end) - 1
    some = lo <= hi
    start, end, a, b = start[some], end[some], core[lo[some]], core[hi[some]] + 1
    return np.searchsorted(bounds, start, "right") - 1, start, end, a, b, span_hashes(_lower(data), a, b), data


def templates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, template hash, value hash) of each token, in order; the value is 0 for plain words.

    A number holds a digit and no letter. A unit follows a number. A name begins with
    a capital where no sentence begins; names side by side are one token.
    """
    row, start, end, a, b, value, data = tokens(texts)
    if not len(row):
        return row, value, value
    # Sentences begin at a row's first token, after a stop and after a line break.
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    opens = np.ones(len(row), bool)
    opens[1:] = (row[1:] != row[:-1]) | _STOP[data[end[:-1] - 1]] | (lines[start[1:]] != lines[end[:-1]])
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    letters = np.concatenate([[0], np.cumsum(_CORE[data] & ~_DIGIT[data] & (data != ord("%")))])
    number = (digits[b] > digits[a]) & (letters[b] == letters[a])
    after_number = np.zeros(len(a), bool)
    after_number[1:] = number[:-1] & (row[1:] == row[:-1])
    known = np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)
    unit = after_number & (_UNIT_HASHES[known] == value)
    latin = (data[a] == 0xC3) & (data[np.minimum(a + 1, len(data) - 1)] <= 0x9E)
    name = (_UPPER[data[a]] | latin) & ~opens & ~number & ~unit
    token = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    slot = np.where(number | unit | name, value, np.uint64(0))
    again = np.zeros(len(a), bool)
    again[1:] = name[1:] & name[:-1] & (row[1:] == row[:-1])
    return row[~again], token[~again], slot[~again]


def template_windows(texts: pa.Array, sizes: list[int], bitmap: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(row, place, size, hash, first token, all slots) of the windows with enough plain words (and a set bit)."""
    row, token, slot = templates(texts)
    plain = np.concatenate([[0], np.cumsum(slot == 0)])
    starts = np.searchsorted(row, np.arange(len(texts)))
    out = []
    for size in sizes:
        hashes, at = run_hashes(row, token, size)
        keep = plain[at + size] - plain[at] >= min(PLAIN, size)
        if bitmap is not None:
            bit = (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
            keep &= (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
        hashes, at = hashes[keep], at[keep]
        out.append((row[at], at - starts[row[at]], np.full(len(at), size), hashes, at))
    return *[np.concatenate(x) for x in zip(*out)], slot


def literal_windows(texts: pa.Array, sizes: list[int], bitmap: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """As ``template_windows``, of the words themselves: every window counts, and none has slots."""
    row, *_, value, _ = tokens(texts)
    starts = np.searchsorted(row, np.arange(len(texts)))
    out = []
    for size in sizes:
        hashes, at = run_hashes(row, value, size)
        if bitmap is not None:
            bit = (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
            keep = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
            hashes, at = hashes[keep], at[keep]
        out.append((row[at], at - starts[row[at]], np.full(len(at), size), hashes, at))
    return *[np.concatenate(x) for x in zip(*out)], np.zeros(len(row), np.uint64)


def _windows(df: DataFrame, id: str, text: str, sizes: list[int], bitmap: bytes | None, cut=template_windows) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8) if bitmap is not None else None
        for part in slices(batches, 1):
            row, place, size, hashes, at, slot = cut(part.column(1), sizes, bits)
            values = [slot[a : a + n] for a, n in zip(at, size)]
            values = [v[v != 0] for v in values]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(row)),
                    pa.array(place, pa.int32()),
                    pa.array(size, pa.int32()),
                    pa.array(hashes.view(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(np.cumsum([0, *map(len, values)]), pa.int32()),
                        pa.array(np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)),
                    ),
                ],
                names=["id", "place", "size", "hash", "slots"],
            )

    return df.select(quoted(id).cast("long"), quoted(text)).mapInArrow(
        run, "id long, place int, size int, hash long, slots array<long>"
    )


def _token_counts(df: DataFrame, id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows = templates(part.column(1))[0], tokens(part.column(1))[0]
            counts = [pa.array(np.bincount(row, minlength=part.num_rows).astype(np.int32)) for row in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), *counts], names=["item", "tokens", "words"])

    return df.select(quoted(id).cast("long"), quoted(text)).mapInArrow(run, "item long, tokens int, words int")


def _bitmap(windows: DataFrame) -> bytes:
    """One bit for each value of the leading hash bits; 1 MB for any number of windows."""
    bit = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    rows = (
        windows.select(F.bitmap_bucket_number(bit + 1).alias("n"), F.bitmap_bit_position(bit + 1).alias("p"))
        .groupBy("n")
        .agg(F.bitmap_construct_agg("p").alias("bits"))
        .collect()
    )
    out = bytearray(1 << (BITMAP_BITS - 3))
    for r in rows:
        lo = (r["n"] - 1) * 4096
        out[lo : lo + 4096] = r["bits"]
    return bytes(out)


def leaks(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, windows, coverage, consistency, reparameterised), a row for each leak of an item in a document.

    ``windows`` of the best alignment match, ``coverage`` is their share of the item's.
    ``reparameterised``: at least one slot has another value than in the item. An item with
    few template windows (it is short, or mostly numbers and names) is also found by its
    words, if all of them stand in a document in a row; ``windows`` are then those of words.
    Null and empty texts match nothing, nor do items of one or two words or rows without an id. Rows that repeat an id are one document or item. Empty tables give an empty
    result; other columns don't matter.
    """
    counts = stored(_token_counts(benchmark, item, item_text).where("item is not null"), "item-tokens")
    # At most as many sizes as there are tokens in a window.
    sizes = sorted(r[0] for r in counts.select(F.least("tokens", F.lit(WINDOW)).alias("n")).where(f"n >= {SHORTEST}").distinct().collect())
    if not sizes:
        sizes = [WINDOW]
    short = counts.select("item", F.least("tokens", F.lit(WINDOW)).alias("size")).groupBy("item").agg(F.max("size").alias("size"))
    asked = (
        _windows(benchmark, item, item_text, sizes, None)
        .withColumnRenamed("id", "item")
        .join(short, ["item", "size"])
        # A template that an item repeats counts once.
        .groupBy("item", "hash")
        .agg(F.min(F.struct("place", "slots")).alias("w"))
        .select("item", "hash", F.col("w.place").alias("item_place"), F.col("w.slots").alias("item_slots"))
    )
    asked = stored(asked, "item-windows")
    held = stored(_windows(docs, id, text, sizes, _bitmap(asked)).where("id is not null").drop("size"), "document-windows")
    hits = held.join(asked, "hash").select(
        "id", "item", (F.col("place") - F.col("item_place")).alias("shift"), "hash", F.arrays_zip("item_slots", "slots").alias("pairs")
    )
    aligned = stored(hits, "aligned-windows")
    cover = aligned.groupBy("id", "item", "shift").agg(F.count_distinct("hash").alias("windows"))
    values = aligned.select("id", "item", "shift", F.explode("pairs").alias("p")).select("id", "item", "shift", "p.item_slots", "p.slots")
    # For each value of the item: how often, and how often as its most frequent counterpart.
    counted = values.groupBy("id", "item", "shift", "item_slots", "slots").agg(F.count("*").alias("n"))
    mapped = counted.groupBy("id", "item", "shift", "item_slots").agg(
        F.sum("n").alias("n"), F.max("n").alias("most"), F.max((F.col("slots") != F.col("item_slots")).cast("int")).alias("other")
    )
    slots = mapped.groupBy("id", "item", "shift").agg(
        (F.sum("most") / F.sum("n")).alias("consistency"), (F.max("other") == 1).alias("reparameterised")
    )
    total = asked.groupBy("item").agg(F.count("*").alias("total"))
    need = F.least(F.lit(LEAK_WINDOWS), F.ceil(F.col("total") * LEAK_SHARE))
    found = (
        cover.join(total, "item")
        .where(F.col("windows") >= need)
        .join(slots, ["id", "item", "shift"], "left")
        .withColumn("consistency", F.coalesce("consistency", F.lit(1.0)))
        .where(F.col("consistency") >= CONSISTENT)
    )
    best = found.groupBy("id", "item").agg(
        F.max(F.struct("windows", (-F.col("shift")).alias("shift"), "total", "consistency", "reparameterised")).alias("best")
    )
    by_template = best.select(
        F.col("id").alias("doc_id"),
        F.col("item").alias("item_id"),
        F.col("best.windows").alias("windows"),
        (F.col("best.windows") / F.col("best.total")).alias("coverage"),
        F.col("best.consistency").alias("consistency"),
        F.coalesce("best.reparameterised", F.lit(False)).alias("reparameterised"),
    )
    poor = counts.join(total, "item", "left").where(f"words >= {SHORTEST_LITERAL} and coalesce(total, 0) < {LEAK_WINDOWS}")
    poor = stored(poor.groupBy("item").agg(F.max("words").alias("words")), "poor-items")
    if poor.isEmpty():
        return by_template
    by_template = stored(by_template, "template-leaks")
    by_words = _literal_leaks(docs, benchmark, poor, id, text, item, item_text)
    return by_template.unionByName(by_words.join(by_template.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti"))


def _literal_leaks(docs: DataFrame, benchmark: DataFrame, items: DataFrame, id: str, text: str, item: str, item_text: str) -> DataFrame:
    """Leaks of ``items`` (item, words) by all of their words in a row."""
    length = items.select("item", F.least("words", F.lit(WINDOW)).alias("size"))
    sizes = sorted(r[0] for r in length.select("size").distinct().collect())  # at most as many as a window has tokens
    asked = _windows(benchmark, item, item_text, sizes, None, literal_windows).withColumnRenamed("id", "item").join(length, ["item", "size"])
    asked = stored(asked.select("item", "hash", F.col("place").alias("item_place")).distinct(), "item-word-windows")
    held = stored(_windows(docs, id, text, sizes, _bitmap(asked), literal_windows).where("id is not null"), "document-word-windows")
    hits = held.join(asked, "hash").select("id", "item", (F.col("place") - F.col("item_place")).alias("shift"), "item_place")
    found = hits.groupBy("id", "item", "shift").agg(F.count_distinct("item_place").alias("windows"))
    total = asked.groupBy("item").agg(F.count_distinct("item_place").alias("total"))
    whole = found.join(total, "item").where("windows = total").groupBy("id", "item").agg(F.max("windows").alias("windows"))
    one = F.lit(1.0)
    return whole.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "windows", one.alias("coverage"), one.alias("consistency"), F.lit(False).alias("reparameterised"))
