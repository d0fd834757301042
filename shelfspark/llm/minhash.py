"""Near-duplicates by fast similarity sketches, banding and exact verification.

A sketch has ``t`` coordinates. In round i every shingle falls into one bin, chosen
by the round's hash, with a value that rises with the round; a bin keeps its
smallest value. Rounds go on until no bin is empty; from round t on, round i puts
all shingles into bin i - t, so at most 2t rounds fill every bin. Two sets agree in
a coordinate with a probability equal to their similarity, and the number of agreeing
coordinates is concentrated as for independent hashes. A text of n shingles costs
about max(n, t log t) steps instead of n t.

Sets that share a band of coordinates are candidates. Equal sets are one node. A
bucket never emits its pairs: its members are compared with its smallest and its
largest node only. Sets that stay apart in this way, although candidates connect
them, are compared with the others of their candidate group in blocks of bounded
size, without emitting pairs, so no link is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.batches import _BASE, mix, quoted, run_hashes, slices, words
from shelfspark.llm.graph import components, having, stored

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Near(NamedTuple):
    """Shingle length, similarity in percent, sketch as bands of rows.

    A pair just similar enough (85 of 100) shares none of 36 bands of 6 with a
    probability of 4e-8; at 80 of 100, none of 48 bands of 6 with 4e-7.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 6


#: Sets in one block of the final comparison.
BLOCK = 512


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, by row, then hash. Fewer words than ``size`` are one shingle."""
    w = words(texts, lower=True)
    counts = np.bincount(w.row, minlength=len(texts)) if len(w.row) else np.zeros(len(texts), np.int64)
    hashes, at = run_hashes(w.row, w.hash, size)
    row = w.row[at]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = w.hash[w.row == i]
        total = np.uint64(len(own))
        for h in own:
            total = np.uint64((int(total) * _BASE + int(h)) & 0xFFFFFFFFFFFFFFFF)
        hashes, row = np.append(hashes, mix(np.array([total]))), np.append(row, i)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


def sketches(row: np.ndarray, hashes: np.ndarray, n_rows: int, t: int) -> np.ndarray:
    """``t`` filled coordinates for each row that has a shingle."""
    out = np.full(n_rows * t, _EMPTY, np.uint64)
    open_rows = np.zeros(n_rows, bool)
    open_rows[row] = True
    for i in range(2 * t):
        if not len(row):
            break
        spread = mix(hashes ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        if i < t:
            bins = ((spread >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64)
        else:
            bins = np.full(len(row), i - t)
        # The round above, 40 other bits of the hash below.
        value = np.uint64(i << 40) | (mix(spread) >> np.uint64(24))
        np.minimum.at(out, row * t + bins, value)
        still = np.flatnonzero(open_rows)
        open_rows[still] = (out.reshape(n_rows, t)[still] == _EMPTY).any(axis=1)
        if i % 4 == 3 or not open_rows[row[0]]:
            keep = open_rows[row]
            row, hashes = row[keep], hashes[keep]
    return out.reshape(n_rows, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each sketch."""
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), bands)).copy()
    cells = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    for k in range(rows):
        total = mix(total * np.uint64(_BASE) + cells[:, :, k])
    return total.view(np.int64)


def sketched(docs: DataFrame, near: Near, id: str, text: str) -> DataFrame:
    """(id, set_key, n_shingles, bands) of each row; no shingle: null key, no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            n = part.num_rows
            row, hashes = shingle_sets(part.column(1), near.shingle)
            counts = np.bincount(row, minlength=n)
            ends = np.cumsum([0, *counts])
            keys = [
                hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None
                for a, b in zip(ends, ends[1:])
            ]
            bands = band_keys(sketches(row, hashes, n, near.bands * near.rows), near.bands, near.rows)
            some = counts > 0
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(keys, pa.binary()),
                    pa.array(counts.astype(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(np.cumsum([0, *(some * near.bands)]), pa.int32()), pa.array(bands[some].ravel())
                    ),
                ],
                names=["id", "set_key", "n_shingles", "bands"],
            )

    return docs.select(quoted(id).cast("long"), quoted(text)).mapInArrow(
        run, "id long, set_key binary, n_shingles long, bands array<long>"
    )


def _sets(docs: DataFrame, nodes: DataFrame, near: Near, id: str, text: str) -> DataFrame:
    """(node, shingles): the sorted shingle hashes of the named documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            row, hashes = shingle_sets(part.column(1), near.shingle)
            ends = np.cumsum([0, *np.bincount(row, minlength=part.num_rows)])
            sets = [hashes[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    rows = docs.select(quoted(id).cast("long").alias("node"), quoted(text).alias("text"))
    return having(rows, nodes, "node").mapInArrow(run, "node long, shingles binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    pairs = edges.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x, y = part.column(2), part.column(3)
            keep = [
                similar(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), percent)
                for i in range(part.num_rows)
            ]
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _block_links(percent: int):
    def run(block: pa.Table) -> pa.Table:
        apart = block.column("apart").to_numpy()
        nodes, parts = block.column("node").to_numpy(), block.column("component").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block.column("shingles")]
        inside, outside = np.flatnonzero(~apart), np.flatnonzero(apart)
        out: list[tuple[int, int]] = []
        if len(inside) and len(outside):
            sizes = np.array([len(sets[i]) for i in inside])
            flat, owner = np.concatenate([sets[i] for i in inside]), np.repeat(np.arange(len(inside)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            group, node = parts[inside], nodes[inside]
            for i in outside:
                own = sets[i]
                lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                n = hi - lo
                held = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                both = np.bincount(owner[held], minlength=len(inside))
                good = (100 * both >= percent * (sizes + len(own) - both)) & (group != parts[i])
                # One link to each other component is enough.
                _, first = np.unique(group[good], return_index=True)
                out += [(int(nodes[i]), int(m)) for m in node[good][first]]
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _rest(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components within a candidate group.

    ``groups``: node, grp (candidate group), component. The largest component of a group
    needs no look inside; every node outside it is compared with all of the group, in
    blocks, and only with sets of a size that allows the similarity.
    """
    by = groups.groupBy("grp", "component").agg(F.count("*").alias("n"))
    largest = by.groupBy("grp").agg(
        F.max(F.struct("n", "component"))["component"].alias("main"), F.sum("n").alias("size"), F.count("*").alias("parts")
    )
    # In a group of two, the only pair has been looked at.
    mixed = largest.where("parts > 1 and size > 2").select("grp", "main")
    rows = (
        groups.join(mixed, "grp")
        .join(sets, "node")
        .withColumn("class", F.floor(F.log(F.length("shingles") / 8) / math.log(100 / percent)).cast("int"))
    )
    rows = stored(rows, "near-rest")
    parts = rows.groupBy("grp", "class").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.count_if(F.col("component") != F.col("main")) / BLOCK).cast("int").alias("apart_blocks"),
    )
    outside = rows.where("component != main").select("grp", "node", "component", "shingles", F.col("class").alias("own"))
    # Each outside node goes to all blocks of its own and the two neighbouring size classes.
    outside = outside.withColumn("class", F.explode(F.array(*[F.col("own") + k for k in (-1, 0, 1)])))
    apart = (
        outside.join(parts.select("grp", "class", "blocks"), ["grp", "class"])
        .join(parts.select("grp", F.col("class").alias("own"), "apart_blocks"), ["grp", "own"])
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("other", F.pmod(F.xxhash64("node"), F.col("apart_blocks")).cast("int"))
    )
    # A block of members meets each block of outside nodes.
    asked = apart.select("grp", "class", "block", "own", "other").distinct()
    members = (
        rows.join(parts.select("grp", "class", "blocks"), ["grp", "class"])
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .join(asked, ["grp", "class", "block"])
    )
    keys = ["grp", "class", "block", "own", "other"]
    fields = [*keys, "node", "component", "shingles"]
    both = members.select(*fields, F.lit(False).alias("apart")).unionByName(apart.select(*fields, F.lit(True).alias("apart")))
    return both.groupBy(*keys).applyInArrow(_block_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, near: Near = Near(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Words are runs of other characters than the six ASCII blanks, A-Z in lower case.
    Documents are linked if 100 * common shingles >= percent * all shingles;
    component_id is the smallest id that links lead to, kept tells if it is the row's own.
    A text without words (null, empty) is linked with nothing. Rows that repeat an id
    are one document: they stay or go together. A row without an id links with nothing,
    has no component and is kept. An empty table gives an empty result; other columns
    don't matter.
    """
    drawn = stored(sketched(docs, near, id, text), "sketches")
    usable = drawn.where("id is not null and set_key is not null")
    nodes = usable.groupBy("set_key").agg(F.min("id").alias("node"))
    placed = stored(
        drawn.join(nodes, "set_key", "left").select(
            "id",
            "n_shingles",
            F.when(F.col("id").isNotNull(), F.coalesce("node", "id")).alias("node"),
            F.when(F.col("id") == F.col("node"), F.col("bands")).alias("bands"),
        ),
        "near-nodes",
    )
    keyed = placed.select("node", F.explode("bands").alias("band"))
    ends = keyed.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    near_ends = keyed.join(ends, "band").select(F.explode(F.array(F.struct("node", F.col("low").alias("to")), F.struct("node", F.col("high").alias("to")))).alias("e"))
    edges = near_ends.where("e.node != e.to").select(F.least("e.node", "e.to").alias("a"), F.greatest("e.node", "e.to").alias("b")).distinct()
    edges = stored(edges, "near-candidates")
    asked = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-asked")
    sets = stored(_sets(docs, asked, near, id, text).dropDuplicates(["node", "shingles"]), "near-sets")
    # Rows that repeat an id are one document, whatever their texts.
    several = placed.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("id", "a")
    same = placed.join(several, "id").where("node != a").select("a", F.col("node").alias("b"))
    links = stored(_confirmed(edges, sets, near.percent).distinct(), "near-links")
    groups = (
        components(edges)
        .withColumnRenamed("component", "grp")
        .join(components(links), "node", "left")
        .select("node", "grp", F.coalesce("component", "node").alias("component"))
    )
    found = links.unionByName(_rest(stored(groups, "near-groups"), sets, near.percent)).unionByName(same)
    final = components(found)
    group = F.coalesce("component", "node")
    return placed.join(final, "node", "left").select(
        F.col("id").alias("doc_id"), "n_shingles", group.alias("component_id"), F.coalesce(group == F.col("id"), F.lit(True)).alias("kept")
    )
