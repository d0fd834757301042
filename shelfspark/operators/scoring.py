"""Scores of all documents against the clauses of a query table that is small enough to travel.

Each document's postings of the terms asked are sorted together, and a task meets them with
all queries at once. Work and shuffles follow the postings of these terms, whatever part of
the documents is a candidate.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Clauses (by field) of a query table that may be sent to every task.
FEW_CLAUSES = 200_000
#: Cells of (row, query) and pairs of (posting, clause) that a task holds at a time.
CELLS, PAIRS = 1 << 18, 1 << 21


@dataclass(frozen=True)
class FewQueries:
    """Clauses by number of their field and term: clauses of number t are entries ``start[t]`` to ``start[t + 1]``."""

    terms: DataFrame
    query_ids: pa.Array
    kind: str
    needed: np.ndarray
    start: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    times: np.ndarray


def few_queries(weighted: DataFrame, limit: int | None = None) -> FewQueries | None:
    """The clauses of ``weighted`` (see ``lexical._weights``); nothing if they are too many, or if a query id stands for several queries."""
    size = weighted.agg(F.sum(F.size("clauses")).alias("n"), F.count_if(F.size("clauses") != F.col("n")).alias("odd")).first()
    if not size["n"] or size["n"] > (FEW_CLAUSES if limit is None else limit) or size["odd"]:
        return None
    clauses = F.transform("clauses", lambda c: F.struct(c["term"].alias("term"), c["weight"].alias("weight")))
    rows = weighted.where("query_id is not null").select("query_id", "field", "m", clauses.alias("clauses"))
    table = rows.toArrow()  # at most as many clauses as counted
    numbers, found = {}, {}
    for q, (field, clauses) in enumerate(zip(table.column("field").to_pylist(), table.column("clauses").to_pylist())):
        for c in clauses:
            key = numbers.setdefault((field, c["term"]), len(numbers)), q
            weight, times = found.get(key, (0.0, 0))
            found[key] = weight + c["weight"], times + 1
    keys = sorted(found)
    at = np.array([t for t, _ in keys], np.int64)
    return FewQueries(
        weighted.sparkSession.createDataFrame([(*k, n) for k, n in numbers.items()], "field string, term string, tno int"),
        table.column("query_id").combine_chunks(),
        weighted.schema["query_id"].dataType.simpleString(),
        table.column("m").to_numpy().astype(np.int64),
        np.searchsorted(at, np.arange(len(numbers) + 1)),
        np.array([q for _, q in keys], np.int64),
        np.array([found[k][0] for k in keys], np.float64),
        np.array([found[k][1] for k in keys], np.float64),
    )


def score_all(parts: DataFrame, keys: list[str], few: FewQueries) -> DataFrame:
    """`query_id, field, *keys, matched, score` of each row of ``keys`` that holds enough of a query's clauses.

    ``parts`` holds `field, term, *keys, part`: what a term adds to the score of a row, without the query's weight.
    """
    numbered = parts.join(F.broadcast(few.terms), ["field", "term"])  # as many rows as clauses at most
    # Sorted, not collected: a row's postings follow each other, and the next batch may go on with them.
    rows = numbered.select("field", *keys, "tno", "part").repartition("field", *keys).sortWithinPartitions(*keys, "field", "tno", "part")
    names = ["field", *keys]
    query_ids, needed, start, query, weight, times = few.query_ids, few.needed, few.start, few.query, few.weight, few.times
    n_queries = len(query_ids)

    def whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Batches that hold all postings of their rows, and where each row begins."""
        held: list[pa.RecordBatch] = []  # of the row that may go on
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                parts, held = held, []
            elif not batch.num_rows:
                continue
            else:
                parts = [*held, batch]
            if not parts:
                continue
            rows = pa.concat_batches(parts)
            differ = np.zeros(rows.num_rows - 1, bool)
            for c in names:
                column = rows.column(c)
                differ |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.flatnonzero(differ) + 1])
            if batch is not None:
                held = [rows.slice(first[-1])]
                rows, first = rows.slice(0, first[-1]), first[:-1]
            if len(first):
                yield rows, first

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for postings, begin in whole_rows(batches):
            first = np.append(begin, postings.num_rows)
            sizes, n_rows = np.diff(first), len(begin)
            tno, part = (postings.column(c).to_numpy(zero_copy_only=False) for c in ("tno", "part"))
            clauses = start[tno + 1] - start[tno]
            pairs = np.concatenate([[0], np.cumsum(clauses)])[first]
            lo = 0
            while lo < n_rows:
                full = int(np.searchsorted(pairs, pairs[lo] + PAIRS, "right")) - 1
                hi = max(lo + 1, min(n_rows, lo + CELLS // n_queries, full))
                mine = slice(first[lo], first[hi])
                n = clauses[mine]
                of = np.repeat(np.arange(len(n)), n)
                entry = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[tno[mine]], n)
                cell = np.repeat(np.arange(hi - lo), sizes[lo:hi])[of] * n_queries + query[entry]
                matched = np.bincount(cell, times[entry], (hi - lo) * n_queries).reshape(-1, n_queries).astype(np.int32)
                total = np.bincount(cell, weight[entry] * part[mine][of], (hi - lo) * n_queries).reshape(-1, n_queries)
                row, q = np.nonzero(matched >= needed)
                at = pa.array(begin[row + lo])
                yield pa.RecordBatch.from_arrays(
                    [query_ids.take(pa.array(q)), *[postings.column(c).take(at) for c in names], pa.array(matched[row, q]), pa.array(total[row, q])],
                    names=["query_id", *names, "matched", "score"],
                )
                lo = hi

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    columns = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return rows.mapInArrow(score, f"query_id {few.kind}, {columns}, matched int, score double")
