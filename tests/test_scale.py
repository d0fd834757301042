"""Plans and work that must not grow faster than the tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.operators import lexical, postings, scoring, vectors
from shelfspark.operators.postings import BLOCK_DOCS, TextIndex, build_postings, document_frequency, impact
from shelfspark.plans.crawl import extracted
from shelfspark.session import scratch_path


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_answers_are_not_broadcast(spark):
    """Spark takes a text column for 20 bytes, so many long answers look small enough for the driver."""
    pages = spark.range(10).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("<title>t</title>").alias("html"))
    answers = spark.range(1000).select(F.col("id").alias("page_id"), F.repeat(F.lit("x"), 1000).alias("answer"))
    for part in extracted(pages, answers):
        assert "BroadcastExchange" not in plan_of(part)


def test_a_term_that_many_queries_ask_is_looked_up_once(spark, monkeypatch):
    """queries that share a term would otherwise meet all its documents each."""
    asked = []
    join = lexical.postings_join
    monkeypatch.setattr(lexical, "postings_join", lambda p, c, *how: asked.append(c.count()) or join(p, c, *how))
    docs = [(1, "the ring the"), (2, "the bolt"), (3, None)]
    postings = build_postings(spark.createDataFrame(docs, "id long, description string"), ["description"])
    queries = [(i, "the the ring") for i in range(50)] + [(7, "bolt"), (None, "the"), (60, "absent"), (61, None)]
    clauses = lexical.query_clauses(spark.createDataFrame(queries, "query_id long, query string")).withColumn("field", F.lit("description"))
    got = Counter(tuple(r) for r in lexical.held_counts(postings, clauses, document_frequency(postings)).collect())
    want = [(i, *row) for i in range(50) for row in (("the", 4, 6), ("ring", 1, 1))]
    assert got == Counter([*want, (7, "bolt", 1, 1), (None, "the", 2, 3)]) and asked == [4]


@pytest.mark.parametrize("blocks", [1, 5])
def test_few_queries_score_as_many_do(spark, monkeypatch, blocks):
    """F5, F6, F8, F9, F11 to F13: few queries travel to the documents; the hits are those found by candidates."""
    rng = random.Random(blocks)
    text = lambda n: " ".join(rng.choice(["red", "blue", "ring", "bolt", "the", "old"]) for _ in range(rng.randint(0, n)))
    rows = [(i, text(3), text(4), text(9)) for i in range(80)] + [(None, "red", "red", "red"), (5, "ring", "the ring", "the old"), (6, None, None, None)]
    docs = spark.createDataFrame(rows, "id long, product_resume string, title string, description string")
    asked = [(i, text(5)) for i in range(12)] + [(None, "red ring"), (20, "absent"), (21, "the the ring the"), (22, None)]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    index = lexical.SEARCH.store(docs, scratch_path(spark, "index"), block_docs=-(-len(rows) // blocks))

    def both():
        by_field = lexical.match_scores(queries, index, lexical.SEARCH)
        return [Counter(tuple(r) for r in df.collect()) for df in (by_field, lexical.top_scores(queries, index, lexical.SEARCH, 4))]

    joins, join = [], lexical.postings_join
    monkeypatch.setattr(lexical, "postings_join", lambda *how: joins.append(1) or join(*how))
    monkeypatch.setattr(scoring, "CELLS", 40)
    monkeypatch.setattr(scoring, "PAIRS", 16)
    travelled = both()
    assert not joins and sum(travelled[0].values()) > 50
    monkeypatch.setattr(scoring, "FEW_CLAUSES", 1)
    assert both() == travelled and joins


@pytest.mark.parametrize(("block_docs", "part_docs"), [(BLOCK_DOCS, 2000), (9, 2000), (40, 10)])
def test_a_stored_index_moves_texts_and_no_postings(spark, monkeypatch, block_docs, part_docs):
    """postings were shuffled twice and the impacts once. Null and repeated ids, and parts of a few tokens, give the same rows."""
    monkeypatch.setattr(postings, "PART_DOCS", part_docs)
    monkeypatch.setattr(postings, "PART_TOKENS", 7)
    rng = random.Random(block_docs)
    text = lambda: " ".join(rng.choice(["red", "blue", "ring", "bolt", "the", "old"]) for _ in range(rng.randint(0, 9)))
    rows = [(i, text(), "x") for i in range(60)] + [(None, "red", None), (None, "red", "red"), (5, "ring", ""), (5, "bolt ring", "the ring"), (6, None, None)] * 4
    docs, path = spark.createDataFrame(rows, "id long, description string, title string"), scratch_path(spark, "index")
    store = postings.store_index(docs, ["description", "title"], path, block_docs=block_docs)
    for index in (store, TextIndex.load(spark, path)):
        want = postings._in_blocks(build_postings(docs, ["description", "title"]), -(-len(rows) // block_docs))
        got = index.postings.select(*want.columns)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
        assert Counter(map(tuple, index.terms.collect())) == Counter(map(tuple, document_frequency(want).collect()))
        if block_docs == BLOCK_DOCS:
            assert index.impacts is None
            continue
        tops = want.join(index.stats, "field").groupBy("field", "term", "block").agg(F.max(impact(F.col("tf"), F.col("dl"), F.col("avg_dl"))).alias("top"))
        assert sorted(map(tuple, index.impacts.collect())) == sorted(map(tuple, tops.collect()))
    written = spark.read.parquet(f"{path}/postings")
    per_term = written.groupBy("field", "term", "block").count()
    assert block_docs != 9 or per_term.agg(F.max("count")).first()[0] == 1


def test_a_vector_search_moves_hits_and_no_candidates(spark, monkeypatch):
    """candidates, twenty a hit and cell, were shuffled and joined with their vectors. Cells in parts, repeated and null ids."""
    from shelfspark.operators import vector_index

    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 8))
    base[:120] = base[0] + rng.normal(scale=0.01, size=(120, 8))  # a hot cell
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    stored = spark.createDataFrame([*rows, (None, rows[0][1]), (900, None)], "id long, embedding array<float>")
    asked = spark.createDataFrame([*rows[:200:9], (None, rows[0][1]), (901, [0.0] * 8)], "query_id long, embedding array<float>")
    index = vector_index.VectorIndex.build(stored, scratch_path(spark, "vectors"), n_cells=6)
    monkeypatch.setattr(vector_index, "GROUP_BYTES", 2500)  # some 60 vectors
    placed, n = index._groups({r["cell"]: r["count"] for r in index.rows(spark).groupBy("cell").count().collect()})
    assert max(parts for _, parts in placed.values()) > 1 and n > 3
    unit = base.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    hits = index.search(asked, 4, n_probe=6).collect()
    assert len(hits) == 4 * len(rows[:200:9])
    got = {}
    for r in sorted(hits, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["id"], r["similarity"]))
    for i, found in got.items():
        scores = np.round((1 + unit @ unit[i]) / 2, 6)
        assert np.allclose([s for _, s in found], np.sort(scores)[::-1][:4], atol=2e-6) and all(abs(scores[j] - s) < 2e-6 for j, s in found)
    moved = []
    looked_up = vector_index.VectorIndex._looked_up
    monkeypatch.setattr(vector_index.VectorIndex, "_looked_up", lambda self, k, wanted: moved.append((k, wanted)) or looked_up(self, k, wanted))
    twice = index.search(asked.where("query_id < 20").unionByName(asked.where("query_id < 20")), 4, n_probe=6)
    assert Counter(r["query_id"] for r in twice.collect()) == Counter({0: 4, 9: 4, 18: 4}) and moved == [(4, 80)]


def test_postings_and_vectors_are_not_collected_or_looked_through_by_row(spark, monkeypatch):
    """postings were collected by document and each vector's numbers read by Spark. A document's postings may come in several batches."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["red", "blue", "ring", "bolt", "the", "old"]) for _ in range(rng.randint(0, n)))
    rows = [(i, text(3), text(4), text(9)) for i in range(40)] + [(5, "ring", "the ring", "the old"), (5, "ring", "the ring", "the old")]
    docs = spark.createDataFrame(rows, "id long, product_resume string, title string, description string")
    queries = spark.createDataFrame([(i, text(5)) for i in range(12)], "query_id long, query string")
    index = lexical.SEARCH.store(docs, scratch_path(spark, "index"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        scores = lexical.match_scores(queries, index, lexical.SEARCH)
        few = Counter(map(tuple, scores.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    monkeypatch.setattr(scoring, "FEW_CLAUSES", 1)
    assert few == Counter(map(tuple, lexical.match_scores(queries, index, lexical.SEARCH).collect())) and len(few) > 20
    assert "collect_list" not in plan_of(scores)
    odd = [None, [1.0], [None, 1.0], [float("nan"), 1.0], [0.0, 0.0], [float("inf"), 1.0]]
    held = spark.createDataFrame([(i, v) for i, v in enumerate([*odd, [1.0, 0.0], [0.0, 2.0]])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, embedding array<double>")
    near = vectors.semantic_search(asked, held, 5)
    assert [(r["id"], r["similarity"]) for r in near.orderBy("rank").collect()] == [(6, 1.0), (7, 0.5)] and "exists(" not in plan_of(near)
