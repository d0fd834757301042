"""Exact top-k inner products by a uniform threshold in three phases.

The components of all vectors are dealt to a few *lists*; a list holds one slice of
every vector, in chunks of bounded size, and knows only the part of a score that its
slice gives. A query's whole score is the sum over the lists.

1. Each chunk of a list gathers, for each query, its k best parts. The vectors in the
   k best of a whole list are scored exactly, and the k-th best of these scores is the
   query's cutoff: no vector below it can be among the k best.
2. The cutoff goes to all lists. With m lists, each returns the entries of at least a
   m-th of it. A vector that no list returns has a sum below the cutoff. Where a part is
   missing, it is below the m-th; entries whose bound lies under the cutoff fall out.
3. The missing parts of the entries left are asked of their lists, for these entries only.

Equal vectors are one class with its k + 1 smallest ids (no more of a class can be
among the k best and the query's own row), and equal queries are answered once, so a
vector that a third of all rows share costs no more than another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.graph import stored
from shelfspark.llm.vector_blocks import first_of_each, large, matrix, packed, products, renewed, small, unpacked, whole_vectors

#: Vectors in a chunk, and queries in a block.
CHUNK_ROWS, QUERY_ROWS = 4096, 1024
#: Slices of a vector.
LISTS = 2
#: Queries multiplied with a chunk at a time.
_STRIP = 128
#: Cutoff of a query with fewer candidates than wanted.
_NONE = -(1 << 62)

#: The entries of a query block and a chunk in one row; numbers take as few bytes as they can, so a row stays a small object.
ENTRIES = "qb long, chunk long, list int, qi array<int>, idx binary, part binary, cutoff binary, at binary"


def _placed(df: DataFrame, block: str, place: str, rows: int, total: int) -> DataFrame:
    """Deals distinct vectors to blocks of about ``rows``, by length and hash, with a place in the block."""
    blocks = max(1, -(-total // rows))
    dealt = df.withColumn("n", F.size("vec").cast("long")).withColumn(block, F.expr(f"n * 4294967296 + pmod(xxhash64(vec), {blocks})"))
    return dealt.withColumn(place, F.row_number().over(Window.partitionBy(block).orderBy("vec")).cast("int") - 1)


def _packed(df: DataFrame, block: str, place: str, lists: int) -> DataFrame:
    """(block, n, list, size, mat): each block's rows in order, one packed row for each list."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(place)
        rows, n = matrix(table.column("vec")), key[1].as_py()
        bounds = [n * j // lists for j in range(lists + 1)]
        mats = [packed(rows[:, lo:hi]) for lo, hi in zip(bounds, bounds[1:])]
        return pa.table(
            {
                block: pa.array([key[0].as_py()] * lists, pa.int64()),
                "n": pa.array([n] * lists, pa.int64()),
                "list": pa.array(range(lists), pa.int32()),
                "size": pa.array([table.num_rows] * lists, pa.int32()),
                "mat": pa.array(mats, pa.binary()),
            }
        )

    return df.select(block, "n", place, "vec").groupBy(block, "n").applyInArrow(run, f"{block} long, n long, list int, size int, mat binary")


def _strips(left: pa.Table, right: pa.Table):
    """First query and products of each strip of a query block with a chunk."""
    if not left.num_rows or not right.num_rows:
        return
    size, queries = left.column("size")[0].as_py(), right.column("size")[0].as_py()
    x, q = unpacked(left.column("mat")[0].as_py(), size), unpacked(right.column("mat")[0].as_py(), queries)
    for lo in range(0, queries, _STRIP):
        yield lo, products(q[lo : lo + _STRIP], x)


def _entries(qb: int, chunk: int, which: int, qi, idx, part, cutoff, at=()) -> dict:
    ids = {"qb": pa.array([qb], pa.int64()), "chunk": pa.array([chunk], pa.int64()), "list": pa.array([which], pa.int32())}
    numbers = {"idx": idx, "part": part, "cutoff": cutoff, "at": at}
    return ids | {"qi": pa.array([qi], pa.list_(pa.int32()))} | {c: pa.array([small(x)], pa.binary()) for c, x in numbers.items()}


_ARROW = pa.table(_entries(0, 0, 0, [], [], [], [])).schema


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts]).astype(kind)


def _local_lists(k: int):
    """Phase 1 in a chunk of a list: the k best parts of each query."""
    schema = pa.schema([("qb", pa.int64()), ("qi", pa.int32()), ("list", pa.int32()), ("chunk", pa.int64()), ("idx", pa.int32()), ("part", pa.int64())])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for lo, s in _strips(left, right):
            best = np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)
            qi = np.repeat(np.arange(lo, lo + len(s)), best.shape[1])
            n = len(qi)
            ids = [np.full(n, key[0].as_py()), qi, np.full(n, key[1].as_py()), np.full(n, key[2].as_py()), best.ravel(), np.take_along_axis(s, best, 1).ravel()]
            out.append(pa.table([pa.array(x, f.type) for x, f in zip(ids, schema)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run, "qb long, qi int, list int, chunk long, idx int, part long"


def _sufficient(lists: int):
    """Phase 2 in a chunk of a list: the entries of at least an equal share of the cutoff."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _ARROW.empty_table()
        cutoff = right.column("cutoff").combine_chunks().flatten().to_numpy()
        qi, idx, part = [], [], []
        for lo, s in _strips(left, right):
            # Compared by division, as the cutoff's place-holder has no multiple.
            least = -(-cutoff[lo : lo + len(s)] // lists)
            row, col = np.nonzero(s >= least[:, None])
            qi.append(row + lo)
            idx.append(col)
            part.append(s[row, col])
        found = [_joined(qi, np.int32), _joined(idx, np.int32), _joined(part, np.int64)]
        return pa.table(_entries(key[0].as_py(), key[2].as_py(), key[1].as_py(), *found, cutoff), schema=_ARROW)

    return run


def _unresolved(lists: int):
    """Between phases 2 and 3, for a query block and a chunk: what can still reach the cutoff, and which parts it lacks."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        qb, chunk = (x.as_py() for x in key)
        cutoff = large(table.column("cutoff")[0].as_py())
        each = {c: [large(x) for x in table.column(c).to_pylist()] for c in ("idx", "part")}
        each["qi"] = [x.values.to_numpy().astype(np.int64) for x in table.column("qi")]
        flat = lambda c: np.concatenate(each[c])
        counts = np.array([len(x) for x in each["qi"]])
        codes, at = np.unique(flat("qi") << 32 | flat("idx"), return_inverse=True)
        part = np.zeros((lists, len(codes)), np.int64)
        known = np.zeros((lists, len(codes)), bool)
        which = np.repeat(table.column("list").to_numpy(), counts)
        part[which, at], known[which, at] = flat("part"), True
        qi, idx = (codes >> 32).astype(np.int32), (codes & 0xFFFFFFFF).astype(np.int32)
        below = -(-cutoff // lists) - 1  # the most that a part not returned can be
        bound = part.sum(axis=0) + (~known).sum(axis=0) * below[qi]
        left = bound >= cutoff[qi]
        qi, idx, part, known = qi[left], idx[left], part[:, left], known[:, left]
        rows = [_entries(qb, chunk, -1, qi, idx, part.sum(axis=0), cutoff)]
        for j in range(lists):
            ask = np.flatnonzero(~known[j])
            if len(ask):
                rows.append(_entries(qb, chunk, j, qi[ask], idx[ask], [], [], ask))
        return pa.concat_tables([pa.table(r, schema=_ARROW) for r in rows])

    return run


def _answers(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Phase 3 in a chunk of a list: the parts asked for."""
    if not left.num_rows or not right.num_rows:
        return _ARROW.empty_table()
    qi, idx, at = right.column("qi")[0].values.to_numpy(), *(large(right.column(c)[0].as_py()) for c in ("idx", "at"))
    part = np.zeros(len(qi), np.int64)
    order = np.argsort(qi, kind="stable")
    for lo, s in _strips(left, right):
        mine = order[np.searchsorted(qi[order], lo) : np.searchsorted(qi[order], lo + len(s))]
        part[mine] = s[qi[mine] - lo, idx[mine]]
    return pa.table(_entries(key[0].as_py(), key[2].as_py(), key[1].as_py(), [], [], part, [], at), schema=_ARROW)


def _resolved(k: int):
    """Whole scores of a query block and a chunk, the k best of each query that reach the cutoff."""
    schema = pa.schema([("qb", pa.int64()), ("qi", pa.int32()), ("chunk", pa.int64()), ("idx", pa.int32()), ("score", pa.int64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_batches()
        got = {"qi": None}
        more = []
        for row in (r.slice(i, 1) for r in rows for i in range(r.num_rows)):
            value = lambda c: row.column(c)[0].values.to_numpy() if c == "qi" else large(row.column(c)[0].as_py())  # noqa: B023, E731
            if row.column("list")[0].as_py() == -1:
                got = {c: value(c) for c in ("qi", "idx", "part", "cutoff")}
            else:
                more.append((value("at"), value("part")))
        score = got["part"].copy()
        for at, part in more:
            score[at] += part
        left = np.flatnonzero(score >= got["cutoff"][got["qi"]])
        left = left[np.lexsort((-score[left], got["qi"][left]))]
        qi = got["qi"][left]
        first = np.searchsorted(qi, qi)
        kth = np.minimum(first + k, np.searchsorted(qi, qi, "right")) - 1
        left = left[score[left] >= score[left[kth]]]  # with ties, as the smaller id isn't known here
        n = len(left)
        columns = [np.full(n, key[0].as_py()), got["qi"][left], np.full(n, key[1].as_py()), got["idx"][left], score[left]]
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    return run, "qb long, qi int, chunk long, idx int, score long"


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    scale: int = 64,
    id: str = "vec_id",
    vector: str = "embedding",
    lists: int = LISTS,
    chunk_rows: int = CHUNK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest inner products, ties to the smaller id.

    ``queries`` and ``vectors`` have columns ``id`` (long) and ``vector``; components become
    floor(scale * x). A query's own row, of its id and vector, is no candidate. Rows
    with a null id, vector or component, a component that isn't finite or (scaled) beyond 2^27
    take no part; vectors of another length aren't candidates. Rows of equal id and vector
    count once; further rows of an id are rows of their own, and as queries they have
    ranks of their own. Other columns don't matter. Empty tables give an empty result.
    """
    wanted = k + 1

    def whole(df: DataFrame) -> DataFrame:
        return df.select(F.col(id).cast("long").alias("id"), whole_vectors(F.col(vector), scale).alias("vec")).where("id is not null and vec is not null").distinct()

    rows, asked = whole(vectors), stored(whole(queries), "topk-queries")
    ids = first_of_each(rows, ["vec"], [F.col("id")], wanted).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = stored(_placed(ids, "chunk", "idx", chunk_rows, vectors.count()), "topk-classes")
    total = asked.count()
    query_classes = stored(_placed(asked.select("vec").distinct(), "qb", "qi", query_rows, total), "topk-query-classes")
    x, q = stored(_packed(classes, "chunk", "idx", lists), "topk-chunks"), stored(_packed(query_classes, "qb", "qi", lists), "topk-blocks")
    pairs = x.select("chunk", "n").distinct().join(q.select("qb", "n").distinct(), "n").select("qb", "chunk")
    nodes = ["qb", "list", "chunk"]
    chunks = renewed(x.join(pairs, "chunk").select(*nodes, "size", "mat")).groupBy(*nodes)
    blocks = q.join(pairs, "qb").select(*nodes, "size", "mat")

    # Phase 1.
    gathered = chunks.cogroup(blocks.groupBy(*nodes)).applyInArrow(*_local_lists(wanted))
    seen = first_of_each(gathered, ["qb", "qi", "list"], [F.col("part").desc(), F.col("chunk"), F.col("idx")], wanted).select("qb", "qi", "chunk", "idx").distinct()
    dot = F.aggregate(F.zip_with("vec", "query", lambda a, b: a.cast("long") * b.cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    scored = (
        seen.join(classes.select("chunk", "idx", "vec", "ids"), ["chunk", "idx"])
        .join(query_classes.select("qb", "qi", F.col("vec").alias("query")), ["qb", "qi"])
        .select("qb", "qi", dot.alias("score"), F.explode("ids"))
    )
    reached = first_of_each(scored, ["qb", "qi"], [F.col("score").desc()], wanted).groupBy("qb", "qi")
    cutoffs = reached.agg(F.when(F.count("*") == wanted, F.min("score")).otherwise(_NONE).alias("c"))
    cutoffs = stored(cutoffs.groupBy("qb").agg(F.expr("transform(array_sort(collect_list(struct(qi, c))), e -> e.c)").alias("cutoff")), "topk-cutoffs")

    # Phase 2.
    informed = q.join(cutoffs, "qb").join(pairs, "qb").select(*nodes, "size", "mat", "cutoff")
    returned = chunks.cogroup(informed.groupBy(*nodes)).applyInArrow(_sufficient(lists), ENTRIES)
    left = stored(returned.groupBy("qb", "chunk").applyInArrow(_unresolved(lists), ENTRIES), "topk-entries")

    # Phase 3.
    requests = q.join(left.where("list >= 0").drop("part", "cutoff"), ["qb", "list"])
    answers = chunks.cogroup(requests.groupBy(*nodes)).applyInArrow(_answers, ENTRIES)
    exact = left.where("list < 0").unionByName(answers).groupBy("qb", "chunk").applyInArrow(*_resolved(wanted))

    # Each class has an id at least, so what comes after the best classes and their ties can't be wanted; their vectors aren't looked up.
    place = F.rank().over(Window.partitionBy("qb", "qi").orderBy(F.col("score").desc()))
    exact = exact.withColumn("_place", place).where(F.col("_place") <= wanted).drop("_place")
    named = exact.join(classes.select("chunk", "idx", "ids", "vec"), ["chunk", "idx"]).join(query_classes.select("qb", "qi", F.col("vec").alias("query")), ["qb", "qi"])
    each = named.select("qb", "qi", "score", (F.col("vec") == F.col("query")).alias("own"), F.explode("ids").alias("id"))
    best = first_of_each(each, ["qb", "qi"], [F.col("score").desc(), F.col("id")], wanted)
    hits = best.groupBy("qb", "qi").agg(F.expr("array_sort(collect_list(struct(-score as s, id, own)))").alias("hits"))
    out = asked.join(query_classes.select("vec", "qb", "qi"), "vec").join(hits, ["qb", "qi"])
    others = F.slice(F.filter("hits", lambda h: ~(h["own"] & (h["id"] == F.col("id")))), 1, k)
    ranked = out.select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "hit"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
