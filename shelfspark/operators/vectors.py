"""Cosine nearest neighbors for a table of query vectors.

Few queries: they travel to the executors once and every partition of vectors is
scanned in place, emitting its own top k. Many queries: vectors and queries meet
on an equi-join by cell (nearest of a bounded number of pivots). Cells are cut
into blocks of bounded size on both sides, and only the cells that can still
hold a better hit are joined, so the result stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.rows import SCORE_DECIMALS, topk
from shelfspark.session import at_most

#: Bytes of query vectors that may be sent to every executor.
BROADCAST_BYTES = 64 << 20
#: Bytes of vectors one task holds at a time when blocks are joined.
BLOCK_BYTES = 64 << 20

#: Queries scored together, and bytes of their scores against a block.
SCORED_QUERIES, SCORE_BYTES = 256, 32 << 20

_UNIT = 10**SCORE_DECIMALS
_HITS = "query_id bigint, id bigint, similarity double"
_HIT_SCHEMA = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])


def usable(df: DataFrame, dims: int) -> DataFrame:
    """Rows with a complete, finite, non-zero vector; no other can be compared."""
    return df.where(misfit(dims).isNull())


def misfit(dims: int) -> Column:
    """Why a row's vector can't be compared, null if it can."""
    v = F.col("embedding")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (
        F.when(v.isNull() | (F.size(v) != dims), F.lit("length"))
        .when(F.exists(v, odd), F.lit("not finite"))
        .when(~F.exists(v, lambda x: x != 0), F.lit("zero"))
    )


def split_misfits(df: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """Rows that can be compared, and the others with an ``error``."""
    return usable(df, dims), df.withColumn("error", misfit(dims)).where("error is not null")


def dims_of(vectors: DataFrame) -> int | None:
    """The most frequent length of the stored vectors (the larger of equals): the same for any order of rows."""
    lengths = vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("n")).count()
    row = lengths.orderBy(F.desc("count"), F.desc("n")).first()
    return row["n"] if row else None


def _unit_rows(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the ``k`` best integer scores, ties by id. ``ids`` has the shape of ``scores``."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _score_block(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Top ``k`` of one block. ``ids`` must ascend: score and position form one exact sort key."""
    n = len(ids)
    scores = np.rint((1.0 + queries @ vectors.T) * (0.5 * _UNIT)).astype(np.int64)
    key = scores * n + (n - 1 - np.arange(n))
    if n > k:
        key = np.partition(key, n - k, axis=1)[:, n - k :]
    return key // n, ids[n - 1 - key % n]


def _score_rows(queries: int) -> int:
    """Vectors whose scores against so many queries stay within bounds."""
    return max(1, SCORE_BYTES // (8 * queries))


def _hit_batch(query_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    columns = [np.repeat(query_ids, ids.shape[1]), ids.ravel(), scores.ravel() / _UNIT]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_HIT_SCHEMA)


def _scan(query_ids: np.ndarray, queries: np.ndarray, k: int):
    """Running top k of every query over the batches of one partition. Vectors have the right length; others that can't be compared are left out."""
    step = SCORED_QUERIES

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray] | None] = [None] * (-(-len(query_ids) // step))
        for batch in batches:
            numbers = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, queries.shape[1])
            fine = np.isfinite(numbers).all(axis=1) & numbers.any(axis=1)
            batch = batch if fine.all() else batch.filter(pa.array(fine))
            if batch.num_rows == 0:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            vectors = _unit_rows(batch.column(1), queries.shape[1])[order]
            for i in range(len(parts)):
                asked = queries[i * step : (i + 1) * step]
                for lo in range(0, len(ids), _score_rows(len(asked))):
                    hi = lo + _score_rows(len(asked))
                    new = _score_block(asked, vectors[lo:hi], ids[order][lo:hi], k)
                    old = parts[i]
                    parts[i] = _best(*new, k) if old is None else _best(*[np.concatenate(p, axis=1) for p in zip(old, new)], k)
        for i, part in enumerate(parts):
            if part is not None:
                yield _hit_batch(query_ids[i * step : (i + 1) * step], *part)

    return scan


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return topk(hits, k, ["query_id"], [F.col("similarity").desc(), F.col("id")])


def semantic_search(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    broadcast_bytes: int = BROADCAST_BYTES,
    n_cells: int = 256,
    dims: int | None = None,
) -> DataFrame:
    """`query_id, id, similarity, rank`: exact top ``k`` by `(1 + cosine) / 2`.

    ``queries`` holds `query_id, embedding`, ``vectors`` holds `id, embedding`. ``dims`` is the
    length of a vector, by default the stored vectors' most frequent one. Rows with another
    vector take no part; ``split_misfits`` tells which and why.
    """
    dims = dims or dims_of(vectors)
    if dims is None:
        return _ranked(queries.sparkSession.createDataFrame([], _HITS), k)
    queries = usable(queries, dims)
    if at_most(queries, max(broadcast_bytes // (8 * dims), 0)):
        return vector_scan(queries, vectors, k, dims)
    cells = Cells.build(usable(vectors, dims), dims, n_cells)
    near = cells.probe(queries, k)
    kth = near.groupBy("query_id").agg(
        F.when(F.count("*") < k, F.lit(-1.0)).otherwise(F.min("similarity")).alias("kth")
    )
    rest = cells.probe(queries.join(kth, "query_id", "left").fillna(-1.0, ["kth"]), k)
    return _ranked(near.select("query_id", "id", "similarity").unionByName(rest.select("query_id", "id", "similarity")), k)


def vector_scan(queries: DataFrame, vectors: DataFrame, k: int, dims: int) -> DataFrame:
    """All vectors against a query table whose size has been checked. No vector is shuffled.

    Only the length of a vector is looked at by Spark, as its numbers are read much faster in the scan.
    """
    table = queries.select(F.col("query_id").cast("bigint"), "embedding").toArrow()
    query_ids = table.column(0).to_numpy()
    if not len(query_ids):
        return _ranked(vectors.sparkSession.createDataFrame([], _HITS), k)
    scan = _scan(query_ids, _unit_rows(table.column(1), dims), k)
    hits = vectors.where(F.size("embedding") == dims).select(F.col("id").cast("bigint"), "embedding").mapInArrow(scan, _HITS)
    return _ranked(hits, k)


def semantic_search_ann(
    queries: DataFrame, vectors: DataFrame, k: int = 5, n_cells: int = 64, n_probe: int = 8, dims: int | None = None
) -> DataFrame:
    """Approximate top ``k``: the ``n_probe`` cells nearest to each query are scored, more if they hold fewer than ``k``."""
    dims = dims or dims_of(vectors)
    if dims is None:
        return _ranked(queries.sparkSession.createDataFrame([], _HITS), k)
    cells = Cells.build(usable(vectors, dims), dims, n_cells)
    return cells.probe(usable(queries, dims), k, n_probe=n_probe)


class Cells:
    """Vectors by nearest pivot, with the size and radius of every cell."""

    def __init__(self, vectors: DataFrame, pivots: np.ndarray, stats: dict[int, tuple[int, float, float]], dims: int):
        self.vectors, self.pivots, self.stats, self.dims = vectors, pivots, stats, dims
        self.block_rows = max(1000, BLOCK_BYTES // (8 * dims))

    @staticmethod
    def build(vectors: DataFrame, dims: int, n_cells: int) -> Cells:
        """``n_cells`` bounds what reaches the driver: that many pivots and as many statistics."""
        vectors = vectors.select(F.col("id").cast("bigint").alias("id"), "embedding")
        picked = vectors.orderBy(F.md5(F.col("id").cast("string")), "id").limit(n_cells).select("embedding").toArrow()
        pivots = _unit_rows(picked.column(0), dims) if picked.num_rows else np.zeros((0, dims))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = _unit_rows(batch.column(1), dims) @ pivots.T
                    cell = near.argmax(axis=1)
                    gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * near[np.arange(len(cell)), cell]))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(gap)],
                        names=["id", "embedding", "cell", "gap"],
                    )

        element = vectors.schema["embedding"].dataType.simpleString()
        placed = vectors.mapInArrow(assign, f"id bigint, embedding {element}, cell int, gap double")
        stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("gap").alias("lo"), F.max("gap").alias("hi"))
        rows = stats.collect()  # one row per cell
        return Cells(placed, pivots, {r["cell"]: (r["n"], r["lo"], r["hi"]) for r in rows}, dims)

    def _choose(self, k: int, n_probe: int | None, second: bool):
        """Picks cells per query: the nearest ones, or in a second pass those that may still beat ``kth``."""
        pivots, dims = self.pivots, self.dims
        filled = np.array(sorted(self.stats), dtype=np.int64)
        sizes = np.array([self.stats[c][0] for c in filled])
        lo = np.array([self.stats[c][1] for c in filled])
        hi = np.array([self.stats[c][2] for c in filled])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(filled):
                    continue
                q = _unit_rows(batch.column(1), dims)
                gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (q @ pivots[filled].T)))
                order = np.argsort(gap, axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                first = before < k
                if n_probe is not None:
                    first = first | (np.arange(len(filled)) < n_probe)
                taken = np.zeros(order.shape, dtype=bool)
                np.put_along_axis(taken, order, first, axis=1)
                if second:
                    kth = batch.column(2).to_numpy(zero_copy_only=False)
                    nearest = np.maximum(0.0, np.maximum(gap - hi, lo - gap))
                    hope = 1.0 - nearest**2 / 4.0 + 2.0 / _UNIT
                    taken = ~taken & (hope >= kth[:, None])
                row, col = np.nonzero(taken)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(filled[col].astype(np.int32))],
                    names=["query_id", "embedding", "cell"],
                )

        return choose

    def probe(self, queries: DataFrame, k: int, n_probe: int | None = None) -> DataFrame:
        """Top ``k`` per query over its chosen cells."""
        second = "kth" in queries.columns
        element = queries.schema["embedding"].dataType.simpleString()
        asked = queries.select(
            F.col("query_id").cast("bigint").alias("query_id"), "embedding", *(["kth"] if second else [])
        ).mapInArrow(self._choose(k, n_probe, second), f"query_id bigint, embedding {element}, cell int")

        # Blocks per cell on both sides; one row per cell, so the broadcast is bounded.
        load = asked.groupBy("cell").agg(F.ceil(F.count("*") / self.block_rows).cast("int").alias("q_blocks"))
        sizes = queries.sparkSession.createDataFrame(
            [(int(c), -(-s[0] // self.block_rows)) for c, s in self.stats.items()], "cell int, v_blocks int"
        )
        blocks = F.broadcast(sizes.join(load, "cell"))
        left = (
            self.vectors.select("id", "embedding", "cell")
            .join(blocks, "cell")
            .withColumn("v", F.pmod(F.xxhash64("id"), F.col("v_blocks")).cast("int"))
            .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
            .drop("v_blocks", "q_blocks")
        )
        right = (
            asked.join(blocks, "cell")
            .withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("q_blocks")).cast("int"))
            .withColumn("v", F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1)))
            .drop("v_blocks", "q_blocks")
        )
        dims = self.dims

        def score(vectors: pa.Table, asking: pa.Table) -> pa.Table:
            if not vectors.num_rows or not asking.num_rows:
                return _HIT_SCHEMA.empty_table()
            vectors = vectors.sort_by("id")
            ids = vectors.column("id").to_numpy()
            v = _unit_rows(vectors.column("embedding"), dims)
            q = _unit_rows(asking.column("embedding"), dims)
            query_ids = asking.column("query_id").to_numpy()
            step = max(1, min(SCORED_QUERIES, SCORE_BYTES // (8 * len(ids))))
            return pa.Table.from_batches(
                [
                    _hit_batch(query_ids[i : i + step], *_score_block(q[i : i + step], v, ids, k))
                    for i in range(0, len(query_ids), step)
                ]
            )

        keys = ["cell", "v", "q"]
        hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, _HITS)
        return _ranked(hits, k)
