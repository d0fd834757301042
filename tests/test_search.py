import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.functions import strings
from shelfspark.operators import dedup, lexical, postings, skew, vectors
from shelfspark.operators.hybrid import search_and_rerank
from shelfspark.operators.models import TextEncoder
from shelfspark.operators.postings import store_index
from shelfspark.operators.vector_index import VectorIndex
from shelfspark.session import scratch_path

WORDS = ["red", "blue", "ring", "bolt", "the", "the", "the", "old", "new", "gear"]


def some_docs(n, seed):
    rng = random.Random(seed)

    def text(k):
        return " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, k)))

    return [(i, text(3), text(4), text(9)) for i in range(n)]


def bm25(docs, query, boosts, share, size):
    """Straight from the formula."""
    clauses = query.split()
    best = {}
    for field, boost in boosts.items():
        col = {"product_resume": 1, "title": 2, "description": 3}[field]
        toks = {d[0]: d[col].split() for d in docs if d[col].split()}
        if not toks:
            continue
        avg = sum(map(len, toks.values())) / len(toks)
        df = Counter(t for words in toks.values() for t in set(words))
        for i, words in toks.items():
            tf = Counter(words)
            matched = [c for c in clauses if c in tf]
            if not clauses or len(matched) < max(1, math.floor(share * len(clauses) + 1e-9)):
                continue
            norm = 1.2 * (0.25 + 0.75 * len(words) / avg)
            score = sum(boost * 2.2 * math.log(1 + (len(toks) - df[c] + 0.5) / (df[c] + 0.5)) * tf[c] / (tf[c] + norm) for c in matched)
            best[i] = max(best.get(i, -1), round(score, 6))
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:size]


@pytest.mark.parametrize("seed", [1, 2])
def test_search_follows_the_formula(spark, seed):
    docs = some_docs(60, seed)
    asked = [(1, "the ring"), (2, "red"), (3, "old red gear bolt the"), (4, "the the ring missing"), (5, ""), (6, "nothing here")]
    ddf = spark.createDataFrame(docs, "id long, product_resume string, title string, description string")
    qdf = spark.createDataFrame(asked, "query_id long, query string")
    index = store_index(ddf, list(lexical.SEARCH_BOOSTS), scratch_path(spark, "index"))
    for hits in (lexical.search_bm25(qdf, ddf, 5), lexical.search_bm25(qdf, ddf, 5, index=index)):
        got = {}
        for r in hits.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        for query_id, query in asked:
            want = bm25(docs, query, lexical.SEARCH_BOOSTS, 0.7, 5)
            assert [i for i, _ in got.get(query_id, [])] == [i for i, _ in want]
            assert np.allclose([s for _, s in got.get(query_id, [])], [s for _, s in want], atol=2e-6)


def test_autocomplete(spark):
    docs = spark.createDataFrame([(1, "Red Ring"), (2, "Ringed red bolt"), (3, "blue ring 25")], "id long, product_resume string")
    asked = spark.createDataFrame([(1, "RING red"), (2, "rin re"), (3, "ring 25")], "query_id long, query string")

    def hits(df):
        return sorted((r["query_id"], r["id"]) for r in df.collect())

    assert hits(lexical.match_all_terms(asked, docs)) == [(1, 1), (3, 3)]
    # Query digits are dropped on the prefix side.
    assert hits(lexical.match_prefix(asked, docs)) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3)]


def test_hot_keys_are_split_without_losing_rows(spark):
    big = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i}", i) for i in range(300)], "k string, id long")
    small = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k1", "c")], "k string, v string")
    sizes = big.groupBy("k").agg(F.count("*").alias("df"))
    want = big.join(small, "k")
    for how in ({"per_split": 10}, {"small_per_split": 1}, {"pairs_per_split": 7}, {"per_split": 30, "small_per_split": 1, "pairs_per_split": 20}):
        got = skew.spread_join(big, small, ["k"], sizes, "id", "v", **how)
        assert sorted(map(tuple, got.select("k", "id", "v").collect())) == sorted(map(tuple, want.select("k", "id", "v").collect()))


def test_a_term_asked_by_many_queries_spreads_over_tasks(spark):
    postings = spark.range(400).selectExpr("'f' AS field", "'hot' AS term", "id")
    asked = spark.range(100_000).selectExpr("id AS query_id", "'f' AS field", "'hot' AS term")
    sizes = postings.groupBy("field", "term").agg(F.count("*").alias("df"))
    splits = skew.key_splits(asked, ["field", "term"], sizes, 1000, 10_000, 1_000_000).first()
    assert splits["_a"] * splits["_b"] >= 40
    joined = skew.spread_join(postings, asked, ["field", "term"], sizes, "id", "query_id", 1000, 10_000, 1_000_000)
    tasks = joined.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 40_000_000
    assert max(r["count"] for r in tasks) < 0.4 * 40_000_000 and len(tasks) >= 6


def test_equal_queries_are_answered_alike(spark):
    docs = spark.createDataFrame([(i, f"green kettle {i}") for i in range(30)], "id long, product_resume string")
    asked = spark.createDataFrame([(9, "kettle"), (4, "kettle"), (5, "green kettle 7"), (6, None)], "query_id long, query string")
    hits = {}
    for r in lexical.match_all_terms(asked, docs, 5).collect():
        hits.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    assert sorted(hits) == [4, 5, 9] and sorted(hits[4]) == sorted(hits[9]) and len(hits[4]) == 5 and len(hits[5]) == 1


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_blocks_are_left_out_without_changing_hits(spark, size):
    words = [f"w{i}" for i in range(60)]
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(words, p=np.arange(60, 0, -1) / 1830, size=rng.integers(3, 30))), "x " + words[i % 60]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "id long, description string, title string").withColumn("product_resume", F.lit("common word"))
    asked = spark.createDataFrame([(0, "w1 w50 w51"), (1, "w59"), (2, "common"), (3, "w0 w0 w58 w57"), (4, "absent"), (5, "")], "query_id long, query string")
    plain = lexical.SEARCH.store(docs, scratch_path(spark, "plain"))
    blocked = lexical.SEARCH.store(docs, scratch_path(spark, "blocked"), block_docs=30)
    assert plain.impacts is None and blocked.impacts is not None
    got, want = (sorted(map(tuple, lexical.top_scores(asked, index, lexical.SEARCH, size).collect())) for index in (blocked, plain))
    assert got == want and len(want) > 3
    if size == 1:
        clauses = lexical.query_clauses(asked)
        weighted = lexical._weights(clauses, blocked, lexical.SEARCH)
        bounds = lexical.block_bounds(weighted, blocked)
        first = lexical.topk(bounds, lexical.FIRST_BLOCKS, ["query_id"], [F.col("bound").desc(), F.col("block"), F.col("field")])
        again = lexical.open_blocks(bounds, first, lexical._field_scores(weighted, blocked, first), size)
        counts = [{r["query_id"]: r["count"] for r in x.groupBy("query_id").count().collect()} for x in (bounds, again)]
        # All titles are of one length, so blocks that tie with the cutoff have to be read too.
        assert counts[0][1] > 50 and counts[1].get(1, 0) < 0.7 * counts[0][1]


def test_prefixes_are_ranges_of_whole_terms(spark):
    words = ["a", "ab", "abc", "abd", "b", "é", "日本", "zeta9", "z" * 25, "ab\U0010ffffx"]
    docs = spark.createDataFrame([(i, f"{w} {words[i - 1]} {w}") for i, w in enumerate(words)], "id long, product_resume string")
    index = lexical.PREFIX.store(docs, scratch_path(spark, "prefix"))
    terms = index.terms.select("term").distinct()
    assert index.postings.count() <= 2 * len(words) + 2  # whole terms, not their prefixes
    prefixes = ["a", "ab", "abc", "z", "é", "日", "q", "zet"]
    asked = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    all_terms = [r["term"] for r in terms.collect()]
    for ranges in (1, 3, 50):
        got = sorted(map(tuple, postings.terms_of_prefixes(terms, asked, ranges).collect()))
        assert got == sorted((p, t) for p in prefixes for t in all_terms if t.startswith(p))
    by_ngrams = lexical.MatchRule({"product_resume": 1.0}, 1.0, strings.edge_ngrams, strings.letter_tokens)
    queries = spark.createDataFrame([(i, p) for i, p in enumerate([*prefixes, "z" * 25, "a z", "ab a"])], "query_id long, query string")
    got, want = (sorted(map(tuple, lexical.top_scores(queries, docs, rule, 10).collect())) for rule in (lexical.PREFIX, by_ngrams))
    assert got == want and want


@pytest.mark.parametrize("seed", [0, 1])
def test_nearest_neighbors_are_exact_both_ways(spark, monkeypatch, seed):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 1)  # blocks of 1000 rows
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(4000, 8))
    base[:1500] = base[0] + rng.normal(scale=0.01, size=(1500, 8))  # a third in one place
    base[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(9001, None), (9002, [1.0])]
    vecs = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, base[i].tolist()) for i in (0, 3, 7, 2000, 3999)], "query_id long, embedding array<double>")
    unit = base / np.where((n := np.linalg.norm(base, axis=1)) == 0, 1, n)[:, None]
    want = {}
    for i in (0, 3, 2000, 3999):
        sim = np.rint((1 + unit @ unit[i]) / 2 * 1e6)
        sim[7] = -1
        want[i] = np.lexsort((np.arange(len(sim)), -sim))[:6].tolist()
    for kwargs in ({}, {"broadcast_bytes": 0, "n_cells": 9}):
        got = {}
        for r in vectors.semantic_search(asked, vecs, 6, **kwargs).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == want


def test_misfit_vectors_change_nothing(spark):
    good = [(i, [float(i), 1.0, 2.0]) for i in range(1, 30)]
    odd = [(100, [1.0]), (101, [float("inf"), 1.0, 1.0]), (102, [float("nan"), 1.0, 1.0]), (103, [0.0] * 3), (104, None), (105, [1.0, None, 2.0])]
    schema = "id long, embedding array<double>"
    vecs = spark.createDataFrame(odd + good, schema)
    asked = spark.createDataFrame([(100, [1.0]), *good[:2]], schema).withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, vectors.semantic_search(asked.where("query_id < 100"), spark.createDataFrame(good, schema), 4).collect()))
    for kwargs in ({}, {"broadcast_bytes": 0, "n_cells": 4}, {"dims": 3}):
        assert sorted(map(tuple, vectors.semantic_search(asked, vecs, 4, **kwargs).collect())) == want
    fits, misfits = vectors.split_misfits(vecs, 3)
    assert fits.count() == len(good) and sorted(r["id"] for r in misfits.collect()) == [100, 101, 102, 103, 104, 105]
    found = vectors.semantic_search_ann(asked, vecs, 20, n_cells=8, n_probe=1).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in found} == {1: 20, 2: 20}


def test_ann_recall(spark):
    vecs = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = vecs.withColumnRenamed("id", "query_id")
    exact = {(r["query_id"], r["id"]) for r in vectors.semantic_search(asked, vecs, 10).collect()}

    def recall(n_probe):
        found = {(r["query_id"], r["id"]) for r in vectors.semantic_search_ann(asked, vecs, 10, 16, n_probe).collect()}
        return len(found & exact) / len(exact)

    assert 0.5 < recall(6) <= recall(16) == 1.0


def test_rerank_ranks_are_dense_and_bounded(spark):
    docs = some_docs(40, 5)
    ddf = spark.createDataFrame([(*d, 1.0) for d in docs], "id long, product_resume string, title string, description string, price double")
    asked = spark.createDataFrame([(1, "old ring"), (2, "zzz")], "query_id long, query string")
    encoder = TextEncoder.fit(ddf, "description", dims=64)
    vecs = encoder.encode(ddf, "description", element="double").select("id", "embedding")
    out = search_and_rerank(asked, ddf, vecs, encoder, 10, 7).orderBy("query_id", "rank").collect()
    first = [r for r in out if r["query_id"] == 1]
    assert [r["rank"] for r in first] == list(range(1, 8))
    assert all(a["score"] >= b["score"] for a, b in zip(first, first[1:]))

    def by_length():
        return lambda pairs: [str(len(p)) for p in pairs]

    scored = search_and_rerank(asked, ddf, vecs, encoder, 10, 3, model=by_length).where("query_id = 1").collect()
    assert len(scored) == 3 and all(r["score"] > 0 for r in scored)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        last = 0
        for j, other in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if ch == other else max(row[j], row[j - 1])
    return row[-1]


def test_ratio(spark):
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert dedup.lcs_length(a, b) == plain_lcs(a, b)
    assert (dedup.ratio("a", "a"), dedup.ratio("", ""), dedup.ratio(None, "a"), dedup.ratio("ab", "cd")) == (100, 100, 0, 0)


def variants(n, seed):
    rng = random.Random(seed)
    bases = ["red steel ring for old doors", "blue bolt with a very long name indeed", "xy"]
    out = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice("abcde 12")
        out.append((i, "".join(text)))
    return out


def greedy(rows, threshold):
    kept = []
    for o, t in rows:
        if not any(dedup.ratio(t, k) >= threshold for _, k in kept):
            kept.append((o, t))
    return kept


@pytest.mark.parametrize("threshold, group_rows", [(95, 1000), (90, 20), (80, 30)])
def test_catalog_dedup_is_the_greedy_loop(spark, monkeypatch, threshold, group_rows):
    monkeypatch.setattr(dedup, "GROUP_ROWS", group_rows)
    rows = variants(250, threshold)
    df = spark.createDataFrame([*rows, (900, None), (901, None)], "ord long, text string")
    got = sorted((r["ord"], r["text"]) for r in dedup.dedup_catalog(df, threshold).where("text IS NOT NULL").collect())
    assert got == greedy(rows, threshold)
    assert dedup.dedup_catalog(df, threshold).where("text IS NULL").count() == 2
    first = {}
    for o, t in rows:
        first.setdefault(t, o)
    items = sorted((o, t) for t, o in first.items())
    want = {(b, a) for i, (b, tb) in enumerate(items) for a, ta in items[:i] if dedup.ratio(ta, tb) >= threshold}
    assert {(r["ord"], r["other"]) for r in dedup.similar_pairs(df, threshold).collect()} == want


def test_list_dedup_and_scopes(spark):
    rows = [(q, o, t) for q in (1, 2) for o, t in variants(15, q)]
    df = spark.createDataFrame(rows, "query_id long, rank long, text string")
    want = sorted((q, o, t) for q in (1, 2) for o, t in greedy(variants(15, q), 95))
    assert sorted(map(tuple, dedup.dedup_results(df).collect())) == want
    scoped = dedup.dedup_catalog(df, 95, order="rank", scope="query_id").select("query_id", "rank", "text")
    assert sorted(map(tuple, scoped.collect())) == want


def test_thresholds_beyond_the_scale_are_refused(spark):
    for threshold in (-1, 101):
        with pytest.raises(ValueError):
            dedup.dedup_catalog(spark.createDataFrame([(1, "a")], "ord long, text string"), threshold)


def test_stored_vector_index_has_recall_and_takes_appends(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 32))
    base = centers[rng.integers(0, 40, 4000)] + rng.normal(scale=0.35, size=(4000, 32))
    base[:1300] = base[0] + rng.normal(scale=1e-3, size=(1300, 32))  # a third in one place
    def frame(rows):
        return spark.createDataFrame([(int(i), base[i].tolist()) for i in rows], "id long, embedding array<double>")

    path = scratch_path(spark, "vector-index")
    VectorIndex.build(frame(range(3000)), path, n_cells=40)
    index = VectorIndex.load(spark, path)
    model = sorted(f.name for f in (Path(path) / "model").glob("part-*"))
    written = {f for f in (Path(path) / "cells").rglob("part-*")}
    odd = spark.createDataFrame([(9000, None), (9001, [0.0] * 32), (9002, [1.0])], "id long, embedding array<double>")
    index.append(frame(range(3000, 4000)).unionByName(odd))
    assert written <= {f for f in (Path(path) / "cells").rglob("part-*")}  # nothing was rebuilt
    assert model == sorted(f.name for f in (Path(path) / "model").glob("part-*"))
    assert index.rows(spark).count() == 4000
    ids = [*range(1500, 4000, 50)]
    asked = frame(ids).withColumnRenamed("id", "query_id")
    unit = (base / np.linalg.norm(base, axis=1)[:, None]).astype(np.float64)
    got = {}
    for r in index.search(asked, 10, n_probe=12).collect():
        got.setdefault(r["query_id"], {})[r["id"]] = r["similarity"]
    found = 0
    for q in ids:
        want = np.argsort(-(unit @ unit[q]), kind="stable")[:10]
        found += len(set(want.tolist()) & set(got[q]))
        assert len(got[q]) == 10
        assert all(abs(s - (1 + unit[i] @ unit[q]) / 2) < 1e-4 for i, s in got[q].items())
    assert found >= 0.95 * 10 * len(ids)


def test_vector_index_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, embedding array<double>")
    index = VectorIndex.build(empty, scratch_path(spark, "empty-index"), dims=3)
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    assert index.search(asked, 5).collect() == []
    index.append(spark.createDataFrame([(5, [0.0, 2.0, 0.0])], "id long, embedding array<double>"))
    assert [(r["id"], r["similarity"]) for r in index.search(asked, 5).collect()] == [(5, 0.5)]


@pytest.mark.parametrize("threshold", [0, 35, 60, 68, 75, 79, 80, 90, 100])
def test_pairs_at_any_threshold_equal_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(dedup, "GROUP_ROWS", 20)
    rng = random.Random(threshold)
    texts = {"", "a", "ab", "ba", "abcdefghij", "abcdefghi"}
    while len(texts) < 70:
        base = rng.choice(sorted(texts))
        texts.add("".join(rng.choice("abc") for _ in range(rng.randint(1, 24))) if rng.random() < 0.4 else base[: rng.randint(0, 20)] + rng.choice("abcd") + base[rng.randint(0, 20) :])
    rows = list(enumerate(sorted(texts, key=lambda t: (len(t) * 7919 % 31, t))))
    df = spark.createDataFrame(rows, "ord long, text string")
    want = {(i, j, v) for i, a in rows for j, b in rows[:i] if (v := dedup.ratio(a, b)) >= threshold}
    assert {(r["ord"], r["other"], r["ratio"]) for r in dedup.similar_pairs(df, threshold).collect()} == want
    if threshold in (35, 79):
        kept = []
        for i, t in rows:
            if not any(dedup.ratio(t, rows[j][1]) >= threshold for j in kept):
                kept.append(i)
        assert sorted(r["ord"] for r in dedup.dedup_catalog(df, threshold).collect()) == kept


def test_fitting_and_encoding_analyse_a_text_once(spark):
    """Once per row, counted in the tasks; vectors and encoder are those of two passes. Repeated and null ids and texts stay."""
    rows = [(1, "red apple"), (1, "red apple"), (2, None), (None, "green pear pear"), (3, "")]
    docs = spark.createDataFrame(rows, "id long, description string")
    read = spark.sparkContext.accumulator(0)

    def count(text):
        read.add(1)
        return text

    encoder, encoded = TextEncoder.fit_encode(docs.withColumn("description", F.udf(count)("description")), "description", element="double")
    found = sorted(encoded.select("id", "embedding").collect(), key=str)
    once = TextEncoder.fit(docs, "description")
    assert read.value == len(rows) and list(encoder.idf.idf) == list(once.idf.idf)
    assert found == sorted(once.encode(docs, "description", element="double").select("id", "embedding").collect(), key=str)


def test_texts_of_one_row_group_are_indexed_by_all_cores(spark):
    """The term of a document is the number of the task that cut it into words."""
    docs = spark.range(200).selectExpr("id", "'word' AS description").coalesce(1)
    terms = [(f"p{i}",) for i in range(1000)]
    index = postings.index_for(
        spark.createDataFrame(terms, "term string"), docs, ["description"],
        lambda c: F.array(F.concat(F.lit("p"), F.spark_partition_id().cast("string"))),
    )
    found = index.terms.collect()
    assert sum(r["df"] for r in found) == 200 and len(found) >= spark.sparkContext.defaultParallelism


def test_folding_of_narrow_and_wide_texts(spark):
    texts = ["", None, "plain ascii", "\x7f\x80", "æther", "crème brûlée", "日本 go", "a·b", "𠀀x", "ﬁ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(strings.beyond_ascii(F.col("t")), strings.analyze(F.col("t")), "t").collect()
    assert [r[0] for r in rows] == [None if t is None else not t.isascii() for t in texts]
    assert rows[4][1] == ["aether"] and rows[5][1] == ["creme", "brulee"] and rows[6][1] == ["日", "本", "go"] and rows[1][1] == []
