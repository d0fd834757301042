"""Hard negatives by an inverted multi-index with certified stops.

Vectors are cut into two halves, and each half has a codebook (k-means on a bounded
sample). A pair of codes is a cell; every vector lies in one. With the cell's radii, a
query q can't score more in a cell than q1.c1 + |q1| r1 + q2.c2 + |q2| r2. The two half
bounds are sorted, and a heap walks their sums from the highest on (a multi-sequence).
A walk stops once the next sum lies under what is still wanted, so its result is exact:

* an anchor's positives: the scores to beat are its best so far,
* the negatives of a positive: the window under the positive's score, or its best so far.

Walks go in rounds of growing size. In a round, each anchor names its next cells, the
cells' vectors meet the anchors that named them in blocks of bounded size, and the few
best of each block are merged. Cells are kept in two layouts, by label for positives and
over all labels for negatives, both cut into blocks, so that a cell or label with a third of all
rows is many blocks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from shelfspark.llm.graph import BROADCAST_KEYS, stored
from shelfspark.llm.vector_blocks import first_of_each, matrix, packed, products, renewed, unpacked, whole_vectors

#: Rows (expected) that the codebooks are fitted on.
SAMPLE_ROWS = 8192
#: Rows wanted in a cell, and most codes of a half.
CELL_ROWS, MOST_CODES = 512, 64
#: Vectors in a block, and anchors that meet it at once.
BLOCK_ROWS, ANCHOR_ROWS = 2048, 512
#: Rows that an anchor walks over in the first round, and the factor from round to round.
FIRST_ROWS, GROWTH = 4096, 8


class Codebooks:
    """Two codebooks for each length of vectors that the sample holds; other lengths have one cell around zero."""

    def __init__(self, sample: list[np.ndarray], codes: int):
        self.halves: dict[int, list[np.ndarray]] = {}
        by_length: dict[int, list[np.ndarray]] = {}
        for v in sample:
            by_length.setdefault(len(v), []).append(v)
        for n, rows in by_length.items():
            x = np.array(rows, np.float64).reshape(len(rows), n)
            self.halves[n] = [self._fitted(h, codes) for h in self.cut(x)]

    @staticmethod
    def cut(x: np.ndarray) -> list[np.ndarray]:
        middle = x.shape[1] // 2
        return [x[:, :middle], x[:, middle:]]

    @staticmethod
    def _fitted(x: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
        start = np.unique(x, axis=0)
        centers = start[np.random.default_rng(7).permutation(len(start))[:codes]]
        for _ in range(rounds):
            nearest = Codebooks._nearest(x, centers)
            sums = np.zeros_like(centers)
            np.add.at(sums, nearest, x)
            n = np.bincount(nearest, minlength=len(centers))[:, None]
            centers = np.where(n > 0, sums / np.maximum(n, 1), centers)
        return centers

    @staticmethod
    def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
        return ((centers**2).sum(axis=1) - 2 * x @ centers.T).argmin(axis=1)

    def centers(self, n: int) -> list[np.ndarray]:
        return self.halves.get(n) or [np.zeros((1, n // 2)), np.zeros((1, n - n // 2))]

    def assign(self, x: np.ndarray) -> list[np.ndarray]:
        """Code and distance of each row in both halves: c1, d1, c2, d2."""
        out = []
        for half, centers in zip(self.cut(x.astype(np.float64)), self.centers(x.shape[1])):
            code = self._nearest(half, centers)
            out += [code, np.sqrt(((half - centers[code]) ** 2).sum(axis=1))]
        return out


def radii(centers: list[np.ndarray], cells: dict[tuple[int, int], tuple]) -> list[np.ndarray]:
    """The largest radius of each code of both halves over its cells."""
    radius = [np.zeros(len(c)) for c in centers]
    for (a, b), (_, r1, r2) in cells.items():
        radius[0][a], radius[1][b] = max(radius[0][a], r1), max(radius[1][b], r2)
    return radius


def walk(
    query: np.ndarray, centers: list[np.ndarray], radius: list[np.ndarray], cells: dict[tuple[int, int], tuple], skip: int, rows: int, need: float, top: float
) -> tuple[list[tuple[int, int]], int]:
    """The next cells of a query's multi-sequence after the first ``skip``, of ``rows`` rows or more; and how many places are behind it then.

    ``cells`` has rows and radii of each cell. The walk ends at a sum of bounds under
    ``need``. Cells that can only hold scores under ``need`` or above ``top`` are passed over.
    """
    half = [query[: len(query) // 2].astype(np.float64), query[len(query) // 2 :].astype(np.float64)]
    norm = [float(np.sqrt(h @ h)) for h in half]
    middle = [c @ h for c, h in zip(centers, half)]
    # Rounding is far below a millionth of the terms; a bound may be too high, never too low.
    slack = 1e-6 * (1 + sum(n * (float(np.abs(c).max(initial=0)) * c.shape[1] ** 0.5 + float(r.max(initial=0))) for n, c, r in zip(norm, centers, radius)))
    order = [np.argsort(-(m + n * r), kind="stable") for m, n, r in zip(middle, norm, radius)]
    bound = [(m + n * r)[o] for m, n, r, o in zip(middle, norm, radius, order)]
    heap, found, behind, total = [(-(bound[0][0] + bound[1][0]), 0, 0)], [], 0, 0
    while heap and total < rows:
        s, i, j = heap[0]
        if -s + slack < need:
            break
        heapq.heappop(heap)
        # Each place is reached from one other: along its row, or down the first column.
        if j + 1 < len(bound[1]):
            heapq.heappush(heap, (-(bound[0][i] + bound[1][j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(bound[0]):
            heapq.heappush(heap, (-(bound[0][i + 1] + bound[1][0]), i + 1, 0))
        behind += 1
        a, b = int(order[0][i]), int(order[1][j])
        cell = cells.get((a, b))
        if behind <= skip or cell is None:
            continue
        center, reach = middle[0][a] + middle[1][b], norm[0] * cell[1] + norm[1] * cell[2] + slack
        if center + reach >= need and center - reach <= top:
            found.append((a, b))
            total += cell[0]
    return found, behind


class Index:
    """Rows (rid, id, label, vec) by cell: a directory of cells and packed blocks, grouped by ``g``."""

    def __init__(self, rows: DataFrame, books: Codebooks, block_rows: int):
        self.books = books
        cells = rows.groupBy("g", "c1", "c2").agg(F.count("*").alias("rows"), F.max("d1").alias("r1"), F.max("d2").alias("r2"))
        self.directory = stored(cells.withColumn("parts", F.ceil(F.col("rows") / block_rows).cast("int")), "cells")
        parts = self.directory.select("g", "c1", "c2", "parts")
        few = parts.count() <= BROADCAST_KEYS
        dealt = rows.join(F.broadcast(parts) if few else parts, ["g", "c1", "c2"])
        dealt = dealt.withColumn("part", F.expr("cast(pmod(xxhash64(rid), parts) as int)"))
        self.blocks = stored(dealt.groupBy("g", "c1", "c2", "part").applyInArrow(_block, BLOCK), "cell-blocks")


BLOCK = "g string, c1 int, c2 int, part int, size int, rids array<long>, ids array<long>, labels array<long>, mat binary"


def _block(key: tuple, table: pa.Table) -> pa.Table:
    """A block's rows in the order of their ids, packed."""
    table = table.sort_by([("id", "ascending"), ("rid", "ascending")])
    one = lambda c: pa.array([table.column(c).to_pylist()], pa.list_(pa.int64()))
    values = {n: pa.array([k.as_py()], t) for n, k, t in zip(("g", "c1", "c2", "part"), key, (pa.string(), pa.int32(), pa.int32(), pa.int32()))}
    return pa.table(
        values
        | {"size": pa.array([table.num_rows], pa.int32()), "rids": one("rid"), "ids": one("id"), "labels": one("label")}
        | {"mat": pa.array([packed(matrix(table.column("vec")))], pa.binary())}
    )


#: Cells named by a block of anchors: the anchors' vectors and labels, and windows (place of the anchor, slot, low, high). Without a cell: how far each anchor is.
PLAN = (
    "g string, ab int, c1 int, c2 int, parts int, aids array<long>, labels array<long>, mat binary, "
    "who array<int>, slot array<int>, low array<long>, high array<long>, behind array<long>"
)
FOUND = "aid long, slot int, score long, id long, rid long"


def _planner(books: Codebooks, rows: int):
    """One round of walks: the cells that each anchor of a block names, gathered by cell."""
    kinds = {"g": pa.string(), "ab": pa.int32(), "c1": pa.int32(), "c2": pa.int32(), "parts": pa.int32(), "mat": pa.binary()}
    kinds |= {c: pa.list_(pa.int64()) for c in ("aids", "labels", "low", "high", "behind")} | {c: pa.list_(pa.int32()) for c in ("who", "slot")}
    names = [f.split()[0] for f in PLAN.split(", ")]
    schema = pa.schema([(c, kinds[c]) for c in names])

    def run(key: tuple, anchors: pa.Table, directory: pa.Table) -> pa.Table:
        if not anchors.num_rows or not directory.num_rows:
            return schema.empty_table()
        vectors, each = matrix(anchors.column("vec")), anchors.drop_columns(["vec"]).to_pylist()
        cells = {(r["c1"], r["c2"]): (r["rows"], r["r1"], r["r2"]) for r in directory.to_pylist()}
        parts = {(r["c1"], r["c2"]): r["parts"] for r in directory.to_pylist()}
        centers = books.centers(vectors.shape[1])
        radius = radii(centers, cells)
        named: dict[tuple[int, int], list[int]] = {}
        behind = {}
        for i, a in enumerate(each):
            need, top = min(w["low"] for w in a["windows"]), max(w["high"] for w in a["windows"])
            found, at = walk(vectors[i], centers, radius, cells, a["behind"], rows, need, top)
            if found:
                behind[i] = at
            for cell in found:
                named.setdefault(cell, []).append(i)
        g, ab = (k.as_py() for k in key)
        out = []
        for cell, who in named.items():
            windows = [(place, w) for place, i in enumerate(who) for w in each[i]["windows"]]
            row = {"g": g, "ab": ab, "c1": cell[0], "c2": cell[1], "parts": parts[cell], "mat": packed(vectors[who])}
            row |= {"aids": [each[i]["aid"] for i in who], "labels": [each[i]["label"] for i in who], "who": [p for p, _ in windows]}
            out.append(row | {c: [w[c] for _, w in windows] for c in ("slot", "low", "high")})
        if behind:
            out.append({"g": g, "ab": ab, "aids": [each[i]["aid"] for i in behind], "behind": list(behind.values())})
        return pa.Table.from_pylist(out, schema)

    return run


def _scanner(same: bool, n: int):
    """The ``n`` best of a block for each window of the anchors that named its cell."""
    schema = pa.schema([("aid", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("rid", pa.int64())])

    def run(key: tuple, blocks: pa.Table, asked: pa.Table) -> pa.Table:
        if not blocks.num_rows or not asked.num_rows:
            return schema.empty_table()
        listed = lambda t, c: t.column(c)[0].values.to_numpy()
        size = blocks.column("size")[0].as_py()
        rids, ids, labels = (listed(blocks, c) for c in ("rids", "ids", "labels"))
        aids, own, who, slot, low, high = (listed(asked, c) for c in ("aids", "labels", "who", "slot", "low", "high"))
        scores = products(unpacked(asked.column("mat")[0].as_py(), len(aids)), unpacked(blocks.column("mat")[0].as_py(), size))
        out = []
        for lo in range(0, len(who), 64):
            w = slice(lo, lo + 64)
            s = scores[who[w]]
            fits = (s >= low[w, None]) & (s <= high[w, None]) & (rids[None, :] != aids[who[w], None])
            fits &= (labels[None, :] == own[who[w], None]) == same
            row, col = np.nonzero(fits)
            score = s[row, col]
            order = np.lexsort((col, -score, row))  # the block is in the order of ids
            row, col, score = row[order], col[order], score[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < n
            row, col = row[first] + lo, col[first]
            out.append(pa.table([pa.array(x, f.type) for x, f in zip((aids[who[row]], slot[row], score[first], ids[col], rids[col]), schema)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def search(index: Index, anchors: DataFrame, windows: DataFrame, same: bool, n: int, first_rows: int = FIRST_ROWS) -> DataFrame:
    """(aid, slot, score, id, rid): the ``n`` best rows for each window (aid, slot, low, high) of ``anchors`` (aid, g, ab, label, vec).

    ``same`` asks for rows of the anchor's label, else of other labels. An anchor itself is never found.
    """
    spark, key = anchors.sparkSession, ["g", "c1", "c2", "part", "ab"]
    windows = stored(windows.select("aid", "slot", "low", "high"), "windows")
    state = anchors.select("aid", F.lit(0).cast("long").alias("behind"))
    best = stored(spark.createDataFrame([], FOUND), "best")
    rows = first_rows
    order = [F.col("score").desc(), F.col("id"), F.col("rid")]
    while True:
        listed = windows.groupBy("aid").agg(F.collect_list(F.struct("slot", "low", "high")).alias("windows"))
        active = renewed(anchors.join(state, "aid").join(listed, "aid"))
        met = renewed(active.select("g", "ab").distinct().join(index.directory, "g"))
        plan = stored(active.groupBy("g", "ab").cogroup(met.groupBy("g", "ab")).applyInArrow(_planner(index.books, rows), PLAN), "walks")
        asked = plan.where("c1 is not null").drop("behind")
        if asked.isEmpty():
            return best
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        meeting = renewed(index.blocks.join(asked.select(*key), key[:4]))
        found = meeting.groupBy(*key).cogroup(renewed(asked).groupBy(*key)).applyInArrow(_scanner(same, n), FOUND)
        best = stored(first_of_each(best.unionByName(found), ["aid", "slot"], order, n), "best")
        reached = best.groupBy("aid", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == n)
        raised = windows.join(reached, ["aid", "slot"], "left").select("aid", "slot", F.greatest("low", "least").alias("low"), "high")
        windows = stored(raised, "windows")
        state = plan.where("c1 is null").select(F.explode(F.arrays_zip("aids", "behind")).alias("s")).select(F.col("s.aids").alias("aid"), F.col("s.behind").alias("behind"))
        rows *= GROWTH


def fitted(rows: DataFrame, sample_rows: int, cell_rows: int) -> Codebooks:
    """Codebooks from about ``sample_rows`` rows, chosen by hash; the number of codes follows the number of rows."""
    total = max(1, rows.count())
    sample = rows.where(F.expr(f"pmod(xxhash64(rid), {total}) < {sample_rows}")).select("vec").toArrow().column("vec")
    codes = min(MOST_CODES, max(1, int(np.ceil((total / cell_rows) ** 0.5))))
    return Codebooks([np.array(v, np.int64) for v in sample.to_pylist()], codes)


def assigned(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` with code and distance in both halves."""
    new = [StructField("c1", IntegerType()), StructField("d1", DoubleType()), StructField("c2", IntegerType()), StructField("d2", DoubleType())]
    schema = StructType([*rows.schema.fields, *new])

    def run(batches):
        for batch in batches:
            size = np.array([len(v) for v in batch.column("vec")], np.int64)
            for n in np.unique(size):
                part = batch.filter(pa.array(size == n))
                x = matrix(part.column("vec")) if n else np.zeros((part.num_rows, 0))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(books.assign(x), (pa.int32(), pa.float64()) * 2))], names=schema.names)

    return rows.mapInArrow(run, schema)


def hard_negatives(
    vectors: DataFrame,
    label: Column,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    scale: int = 256,
    id: str = "vec_id",
    vector: str = "embedding",
    sample_rows: int = SAMPLE_ROWS,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
    first_rows: int = FIRST_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every row where ``anchors`` holds.

    Scores are inner products of floor(``scale`` * x), higher first, ties by smaller id. An
    anchor's positives are its best ``positives`` other rows of the same ``label``; for each, the
    best ``negatives`` rows of other labels that score ``low`` percent to all of the positive's
    score are returned, which are none below a score of zero.

    Rows with a null id, label, vector or component, a component that isn't finite or
    (scaled) beyond 2^27 take no part; vectors of other lengths never meet. Rows of equal id,
    label and vector count once; further rows of an id are rows (and anchors) of their own.
    Other columns don't matter. Empty tables give an empty result. The sample decides
    where cells lie, not what is found: every walk goes on until its bound certifies it.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), whole_vectors(F.col(vector), scale).alias("vec"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.where("id is not null and label is not null and vec is not null").distinct()
    base = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    books = fitted(base, sample_rows, cell_rows)
    placed = stored(assigned(base, books), "placed")
    length = F.size("vec").cast("string")
    of_label = placed.withColumn("g", F.concat_ws("|", length, "label"))
    of_all = placed.withColumn("g", length)
    starts = placed.where("anchor")
    blocks = max(1, -(-starts.count() // ANCHOR_ROWS))

    def starting(df: DataFrame) -> DataFrame:
        return stored(df.where("anchor").select(F.col("rid").alias("aid"), "id", "g", F.expr(f"cast(pmod(xxhash64(rid), {blocks}) as int)").alias("ab"), "label", "vec"), "anchors")

    far = 1 << 62
    by_label = starting(of_label)
    everything = by_label.select("aid", F.lit(0).alias("slot"), F.lit(-far).alias("low"), F.lit(far).alias("high"))
    best = search(Index(of_label, books, block_rows), by_label.drop("id"), everything, True, positives, first_rows)
    listed = best.groupBy("aid").agg(F.expr("array_sort(collect_list(struct(-score as s, id, rid)))").alias("p"))
    chosen = listed.select("aid", F.posexplode("p").alias("slot", "p")).select("aid", "slot", F.col("p.id").alias("positive_id"), (-F.col("p.s")).alias("positive_score"))
    chosen = stored(chosen.where("positive_score >= 0"), "positives")
    least = F.expr(f"(positive_score * {low} + 99) div 100")
    windows = chosen.select("aid", "slot", least.alias("low"), F.col("positive_score").alias("high"))
    overall = starting(of_all)
    found = search(Index(of_all, books, block_rows), overall.drop("id"), windows, False, negatives, first_rows)
    ranked = found.groupBy("aid", "slot").agg(F.expr("array_sort(collect_list(struct(-score as s, id, rid)))").alias("f"))
    out = ranked.select("aid", "slot", F.posexplode("f").alias("place", "f")).join(chosen, ["aid", "slot"]).join(overall.select("aid", F.col("id").alias("anchor_id")), "aid")
    return out.select(
        "anchor_id",
        "positive_id",
        (F.col("place") + 1).alias("rank"),
        F.col("f.id").alias("negative_id"),
        "positive_score",
        (-F.col("f.s")).alias("negative_score"),
    )
