"""Lexical, vector and hybrid search, dedup and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.strings import analyze
from shelfspark.operators import dedup, hybrid, lexical, postings, rows, vectors
from shelfspark.operators.models import TextEncoder
from shelfspark.operators.vector_index import VectorIndex
from shelfspark.suite import derive as d
from shelfspark.suite import sqltext as q
from shelfspark.suite.registry import query

FIELDS = list(lexical.SEARCH_BOOSTS)


def docs(spark, sf):
    return d.derive(spark, sf, d.DOC_PRODUCTS)


def queries(spark, sf):
    return d.derive(spark, sf, d.QUERIES)


def catalog(spark, sf):
    return d.derive(spark, sf, d.CATALOG)


def catalog_queries(spark, sf):
    return d.derive(spark, sf, d.CATALOG_QUERIES)


def search_index(spark, sf):
    return d.once_stored(spark, sf, "search-index", lambda p: lexical.SEARCH.store(docs(spark, sf), p))


def catalog_index(spark, sf, rule, name):
    return d.once_stored(spark, sf, name, lambda p: rule.store(catalog(spark, sf), p))


def big_rank(df):
    return df.withColumn("rank", F.col("rank").cast("bigint"))


DOCS = f"WITH docs AS MATERIALIZED ({d.DOC_PRODUCTS}), queries AS ({d.QUERIES})"
BM25 = DOCS + "," + q.bm25("docs", "queries", q.SEARCH, 0.7, 10)
CATALOG = f"WITH cat AS MATERIALIZED ({d.CATALOG}), asked_for AS ({d.CATALOG_QUERIES})"


@query("build_postings", BM25 + " SELECT field, term, id, tf, dl FROM tf")
def _(spark, sf):
    return postings.build_postings(docs(spark, sf), FIELDS).withColumn("dl", F.col("dl").cast("bigint"))


@query(
    "corpus_stats",
    BM25 + " SELECT field, term, df, n_docs, round(avg_dl, 6) AS avg_dl FROM df JOIN stats USING (field)",
)
def _(spark, sf):
    return postings.corpus_stats(docs(spark, sf), FIELDS).withColumn("avg_dl", F.round("avg_dl", 6))


@query(
    "postings_join",
    BM25 + """ SELECT DISTINCT c.query_id, t.field, t.term, t.id, t.tf FROM clauses c JOIN tf t USING (term)
    WHERE t.field = 'description'""",
)
def _(spark, sf):
    asked = lexical.query_clauses(queries(spark, sf)).select("query_id", "term", F.lit("description").alias("field")).distinct()
    index = postings.index_for(asked.select("term").distinct(), docs(spark, sf), ["description"], analyze)
    return lexical.postings_join(index.postings, asked, index.terms).select("query_id", "field", "term", "id", "tf")


@query("clause_match_score", BM25 + " SELECT query_id, field, id, matched, score FROM field_scores")
def _(spark, sf):
    scores = lexical.match_scores(queries(spark, sf), search_index(spark, sf), lexical.SEARCH)
    return scores.withColumn("matched", F.col("matched").cast("bigint"))


@query("best_field", BM25 + " SELECT query_id, id, score FROM best")
def _(spark, sf):
    return lexical.best_field(lexical.match_scores(queries(spark, sf), docs(spark, sf), lexical.SEARCH))


#: One word of each document is a query; some words are asked by many.
WORDS_ASKED = "SELECT doc_id AS query_id, split_part(split_part(text, chr(10), 1), ' ', 3) AS query FROM documents WHERE text IS NOT NULL"


@query(
    "hot_postings_join",
    BM25.replace(f"queries AS ({d.QUERIES})", f"queries AS ({WORDS_ASKED})")
    + " SELECT query_id, term, count(*) AS held, CAST(sum(tf) AS BIGINT) AS times FROM clauses JOIN tf USING (term) WHERE field = 'description' GROUP BY ALL",
)
def _(spark, sf):
    asked = lexical.query_clauses(d.derive(spark, sf, WORDS_ASKED)).withColumn("field", F.lit("description"))
    index = search_index(spark, sf)
    return lexical.held_counts(index.postings, asked.select("query_id", "field", "term"), index.terms)


@query(
    "search_bm25",
    BM25 + " SELECT query_id, id, score, rank, title, product_resume AS resumen, price, description FROM ranked JOIN docs USING (id)",
)
def _(spark, sf):
    return big_rank(lexical.search_bm25(queries(spark, sf), docs(spark, sf), index=search_index(spark, sf)))


@query(
    "search_bm25_blocks",
    BM25 + " SELECT query_id, id, score, rank, title, product_resume AS resumen, price, description FROM ranked JOIN docs USING (id)",
)
def _(spark, sf):
    """The same hits from an index of small blocks, most of which are left out by their bounds."""
    index = d.once_stored(spark, sf, "block-index", lambda p: lexical.SEARCH.store(docs(spark, sf), p, block_docs=50))
    return big_rank(lexical.search_bm25(queries(spark, sf), docs(spark, sf), index=index))


@query("search_bm25_unindexed", BM25 + " SELECT query_id, id, score, rank FROM ranked")
def _(spark, sf):
    return big_rank(lexical.search_bm25(queries(spark, sf), docs(spark, sf))).select("query_id", "id", "score", "rank")


AUTO = CATALOG + "," + q.bm25("cat", "asked_for", q.RESUME, 1.0, 20)


@query("match_all_terms", AUTO + " SELECT query_id, id, score, rank, product_resume FROM ranked JOIN cat USING (id)")
def _(spark, sf):
    return big_rank(lexical.match_all_terms(catalog_queries(spark, sf), catalog(spark, sf), 20, index=catalog_index(spark, sf, lexical.ALL_TERMS, "catalog-index")))


@query(
    "match_prefix",
    CATALOG + "," + q.bm25("cat", "asked_for", q.RESUME, 1.0, 10, q.prefixes, q.letters)
    + " SELECT query_id, id, score, rank, product_resume FROM ranked JOIN cat USING (id)",
)
def _(spark, sf):
    return big_rank(lexical.match_prefix(catalog_queries(spark, sf), catalog(spark, sf), 10, index=catalog_index(spark, sf, lexical.PREFIX, "prefix-index")))


# --- Vectors ------------------------------------------------------------------------

NEAREST = """
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
scored AS (SELECT a.id AS query_id, b.id, round((1 + list_cosine_similarity(a.e, b.e)) / 2, 6) AS similarity FROM v a, v b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM scored)
SELECT query_id, id, similarity, rank FROM ranked WHERE rank <= 10
"""


def stored_vectors(spark, sf):
    vecs = d.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vecs.withColumnRenamed("id", "query_id"), vecs


@query("semantic_search", NEAREST)
def _(spark, sf):
    return big_rank(vectors.semantic_search(*stored_vectors(spark, sf), k=10))


@query("vector_join", NEAREST)
def _(spark, sf):
    """The same answer by cells, the way that serves query tables too large to send around."""
    return big_rank(vectors.semantic_search(*stored_vectors(spark, sf), k=10, broadcast_bytes=0, n_cells=16))


PROBED = """
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pivots AS (SELECT row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS cell, e FROM v QUALIFY cell < 32),
near AS (SELECT v.id, p.cell, list_cosine_similarity(v.e, p.e) AS s FROM v, pivots p),
placed AS (SELECT id, cell FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, cell) = 1),
sizes AS (SELECT cell, count(*) AS n FROM placed GROUP BY cell),
probes AS (SELECT near.id AS query_id, cell, row_number() OVER w AS r, sum(n) OVER w - n AS before
  FROM near JOIN sizes USING (cell) WINDOW w AS (PARTITION BY near.id ORDER BY s DESC, cell)),
taken AS (SELECT query_id, cell FROM probes WHERE r <= 8 OR before < 10),
scored AS (SELECT query_id, placed.id, round((1 + list_cosine_similarity(a.e, b.e)) / 2, 6) AS similarity
  FROM taken JOIN placed USING (cell) JOIN v a ON a.id = query_id JOIN v b ON b.id = placed.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM scored)
SELECT query_id, id, similarity, rank FROM ranked WHERE rank <= 10
"""


@query("semantic_search_ann", PROBED)
def _(spark, sf):
    """Over a stored index, which the first query of a session builds."""
    asked, vecs = stored_vectors(spark, sf)
    index = d.once_stored(spark, sf, "vector-index", lambda p: VectorIndex.build(vecs, p, n_cells=32))
    return big_rank(index.search(asked, k=10, n_probe=8))


@query("semantic_search_cells", PROBED)
def _(spark, sf):
    """The same without an index: cells are made for this call."""
    return big_rank(vectors.semantic_search_ann(*stored_vectors(spark, sf), k=10, n_cells=32, n_probe=8))


EMBED = f"""
hashed AS MATERIALIZED (SELECT id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 1536 AS bucket, count(*) AS tf
  FROM (SELECT id, unnest({q.tokens('description')}) AS term FROM docs) x GROUP BY ALL),
bdf AS (SELECT bucket, count(*) AS df FROM hashed GROUP BY bucket),
dn AS (SELECT count(*) AS n FROM docs WHERE description IS NOT NULL),
weighted AS (SELECT id, bucket, tf * ln((n + 1.0) / (df + 1)) AS w FROM hashed JOIN bdf USING (bucket) CROSS JOIN dn),
dnorm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY id),
qhashed AS (SELECT query_id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 1536 AS bucket, count(*) AS tf
  FROM (SELECT query_id, unnest({q.tokens('query')}) AS term FROM queries) x GROUP BY ALL),
qweighted AS (SELECT query_id, qhashed.bucket, tf * ln((n + 1.0) / (coalesce(df, 0) + 1)) AS w
  FROM qhashed LEFT JOIN bdf ON bdf.bucket = qhashed.bucket CROSS JOIN dn),
qnorm AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qweighted GROUP BY query_id),
dots AS (SELECT query_id, id, sum(a.w * b.w) AS dot FROM qweighted a JOIN weighted b USING (bucket) GROUP BY query_id, id),
near AS (SELECT qn.query_id, dn.id, round((1 + coalesce(dot, 0) / (qn.norm * dn.norm)) / 2, 6) AS score
  FROM qnorm qn JOIN dnorm dn ON qn.norm > 0 AND dn.norm > 0 LEFT JOIN dots ON dots.query_id = qn.query_id AND dots.id = dn.id),
vranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near) r WHERE rank <= 10),
combined AS (
  SELECT query_id, id, title, description, price, CAST(NULL AS VARCHAR) AS url, product_resume AS resumen, 'elastic' AS source,
    score AS original_score, rank AS source_rank FROM ranked JOIN docs USING (id)
  UNION ALL
  SELECT query_id, id, title, description, price, NULL, NULL, 'neo4j', score, rank FROM vranked JOIN docs USING (id))
"""


def with_vectors(spark, sf):
    """Documents, their stored vectors, and the stored encoder that made these."""
    found = docs(spark, sf)

    def write(path):
        encoder, encoded = TextEncoder.fit_encode(found.select("id", "description"), "description", element="double")
        encoder.save(f"{path}/encoder")
        encoded.select("id", "embedding").write.parquet(f"{path}/vectors")
        return spark.read.parquet(f"{path}/vectors"), TextEncoder.load(f"{path}/encoder")

    return found, *d.once_stored(spark, sf, "doc-vectors", write)


@query("hybrid_search", BM25 + "," + EMBED + "SELECT * FROM combined")
def _(spark, sf):
    hits = hybrid.hybrid_search(queries(spark, sf), *with_vectors(spark, sf), index=search_index(spark, sf))
    return hits.withColumn("source_rank", F.col("source_rank").cast("bigint"))


@query(
    "search_and_rerank",
    BM25 + "," + EMBED + f""",
qt AS (SELECT query_id, unnest(list_distinct({q.tokens('query')})) AS term FROM queries),
w AS (SELECT query_id, term, ln(1 + (n_docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf
  FROM qt LEFT JOIN (SELECT term, df FROM df WHERE field = 'description') USING (term)
  CROSS JOIN (SELECT n_docs FROM stats WHERE field = 'description')),
texts AS MATERIALIZED (SELECT *, {q.tokens("('Title: ' || title || chr(10) || 'Description: ' || description || chr(10) || 'Summary: ' || coalesce(resumen, ''))")} AS toks
  FROM combined),
rescored AS (SELECT t.query_id, t.id, t.source, round(sum(CASE WHEN list_contains(toks, term) THEN idf ELSE 0 END) / sum(idf), 6) AS score
  FROM texts t JOIN w ON w.query_id = t.query_id GROUP BY t.query_id, t.id, t.source),
final AS (SELECT c.query_id, c.id, c.title, c.description, c.price, c.url, c.resumen, c.source, r.score, c.original_score,
  row_number() OVER (PARTITION BY c.query_id ORDER BY r.score DESC, c.source, c.source_rank) AS rank
  FROM combined c JOIN rescored r ON r.query_id = c.query_id AND r.id = c.id AND r.source = c.source)
SELECT * FROM final WHERE rank <= 10""",
)
def _(spark, sf):
    return big_rank(hybrid.search_and_rerank(queries(spark, sf), *with_vectors(spark, sf), index=search_index(spark, sf)).drop("source_rank"))


MERGED = BM25 + "," + EMBED + """
SELECT query_id, id, min(title) AS title, min(description) AS description, min(price) AS price, 'doc:' || id AS url,
  min(resumen) AS resumen, string_agg(DISTINCT source, '+' ORDER BY source) AS source, max(original_score) AS original_score,
  min(source_rank) AS source_rank FROM combined GROUP BY query_id, id"""


def with_url(found):
    return found.withColumn("url", F.concat(F.lit("doc:"), F.col("id")))


@query("hybrid_merged", MERGED)
def _(spark, sf):
    found, encoded, encoder = with_vectors(spark, sf)
    hits = hybrid.hybrid_search(queries(spark, sf), with_url(found), encoded, encoder, merge=True, index=search_index(spark, sf))
    return hits.withColumn("source_rank", F.col("source_rank").cast("bigint"))


@query(
    "semantic_search_text",
    BM25 + "," + EMBED + """SELECT query_id, id, title, 'doc:' || id AS url, description, v.score AS similarity_score
    FROM vranked v JOIN docs USING (id)""",
)
def _(spark, sf):
    found, encoded, encoder = with_vectors(spark, sf)
    return hybrid.semantic_search_text(queries(spark, sf), with_url(found), encoded, encoder, 10)[0]


@query("search_limits", BM25 + " SELECT query_id, id, score, rank FROM ranked WHERE rank <= 1 + query_id % 7")
def _(spark, sf):
    asked = queries(spark, sf).withColumn("limit", (1 + F.col("query_id") % 7).cast("int"))
    hits = lexical.search_bm25(asked.select("query_id", "query"), docs(spark, sf), index=search_index(spark, sf))
    return big_rank(rows.limit_per_query(hits, asked)).select("query_id", "id", "score", "rank")


# --- Dedup --------------------------------------------------------------------------

#: Similarity ratio of (a, b) rows by the textbook recurrence, one row of the table per step.
LCS = """
lcs(a, b, i, row) AS (
  SELECT a, b, 0, list_transform(generate_series(0, length(b)), lambda x: 0) FROM pair_texts
  UNION ALL
  SELECT a, b, i + 1, list_prepend(0, list_transform(generate_series(1, length(b)), lambda j: list_max(
    list_transform(generate_series(1, j), lambda k: greatest(row[k + 1], row[k] + CASE WHEN substr(a, i + 1, 1) = substr(b, k, 1) THEN 1 ELSE 0 END)))))
  FROM lcs WHERE i < length(a)),
ratios AS MATERIALIZED (
  SELECT a, b, CAST(round_even(100.0 * (2.0 * row[-1] / (length(a) + length(b))), 0) AS INTEGER) AS ratio
  FROM lcs WHERE i = length(a))
"""

RECOMMENDED = AUTO.replace("WITH cat", "WITH RECURSIVE cat") + """,
hits AS MATERIALIZED (SELECT query_id, rank, product_resume AS text FROM ranked JOIN cat USING (id)),
pair_texts AS (SELECT DISTINCT x.text AS a, y.text AS b FROM hits x JOIN hits y
  ON x.query_id = y.query_id AND y.rank < x.rank AND x.text <> y.text
  AND abs(length(x.text) - length(y.text)) < 0.055 * (length(x.text) + length(y.text))),
""" + LCS + """,
near AS MATERIALIZED (SELECT x.query_id, x.rank, y.rank AS earlier FROM hits x JOIN hits y ON x.query_id = y.query_id AND y.rank < x.rank
  LEFT JOIN ratios r ON r.a = x.text AND r.b = y.text WHERE x.text = y.text OR r.ratio >= 95),
lists AS (SELECT h.query_id, h.rank, coalesce(list(n.earlier) FILTER (WHERE n.earlier IS NOT NULL), []) AS earlier
  FROM hits h LEFT JOIN near n ON n.query_id = h.query_id AND n.rank = h.rank GROUP BY h.query_id, h.rank),
walk(query_id, step, kept) AS (
  SELECT DISTINCT query_id, 0::BIGINT, CAST([] AS BIGINT[]) FROM hits
  UNION ALL
  SELECT w.query_id, w.step + 1, CASE WHEN list_has_any(l.earlier, w.kept) THEN w.kept ELSE list_append(w.kept, w.step + 1) END
  FROM walk w JOIN lists l ON l.query_id = w.query_id AND l.rank = w.step + 1),
final AS (SELECT query_id, kept FROM walk QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY step DESC) = 1),
kept_rows AS (SELECT query_id, unnest(kept) AS rank FROM final)
SELECT h.query_id, h.rank, h.text FROM hits h JOIN kept_rows USING (query_id, rank)
"""


@query("dedup_results", RECOMMENDED)
def _(spark, sf):
    hits = lexical.match_all_terms(catalog_queries(spark, sf), catalog(spark, sf), 20)
    ranked = hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), F.col("product_resume").alias("text"))
    return dedup.dedup_results(ranked, 95)


@query("recommendations", RECOMMENDED)
def _(spark, sf):
    found = dedup.recommendations(catalog_queries(spark, sf), catalog(spark, sf), size=20, threshold=95)
    return big_rank(found)


LABELS = "SELECT p_partkey AS ord, p_type || ' ' || p_name || ' ' || p_brand AS text FROM part"


#: Pairs of different texts whose lengths and letter counts allow a ratio of 95 (both exact bounds), then their ratio.
SIMILAR = f"""
WITH RECURSIVE labels AS ({LABELS}),
texts AS MATERIALIZED (SELECT text, min(ord) AS ord FROM labels GROUP BY text),
alphabet AS (SELECT list(DISTINCT ch) AS chars FROM (SELECT unnest(string_split(text, '')) AS ch FROM texts) x),
counted AS MATERIALIZED (SELECT text, ord, length(text) AS n,
  list_transform(chars, lambda ch: length(text) - length(replace(text, ch, ''))) AS letters FROM texts, alphabet),
pair_texts AS MATERIALIZED (SELECT x.text AS a, y.text AS b FROM counted x JOIN counted y ON y.ord < x.ord
  AND abs(x.n - y.n) < 0.055 * (x.n + y.n)
  AND list_sum(list_transform(range(1, len(x.letters) + 1), lambda i: abs(x.letters[i] - y.letters[i]))) < 0.055 * (x.n + y.n)),
{LCS},
similar_pairs AS MATERIALIZED (SELECT x.ord, y.ord AS other, CAST(r.ratio AS BIGINT) AS ratio FROM ratios r
  JOIN texts x ON x.text = r.a JOIN texts y ON y.text = r.b WHERE r.ratio >= 95)
"""

DEDUPED = SIMILAR.rstrip() + """,
ranked AS MATERIALIZED (SELECT ord, text, row_number() OVER (ORDER BY ord) AS step FROM texts),
lists AS MATERIALIZED (SELECT k.step, coalesce(list(s.other) FILTER (WHERE s.other IS NOT NULL), []) AS earlier
  FROM ranked k LEFT JOIN similar_pairs s ON s.ord = k.ord GROUP BY k.step),
walk(step, kept) AS (
  SELECT 0::BIGINT, CAST([] AS BIGINT[])
  UNION ALL
  SELECT l.step, CASE WHEN list_has_any(l.earlier, w.kept) THEN w.kept ELSE list_append(w.kept, k.ord) END
  FROM walk w JOIN lists l ON l.step = w.step + 1 JOIN ranked k ON k.step = l.step)
SELECT ord, text FROM ranked WHERE ord IN (SELECT unnest(kept) FROM (SELECT kept FROM walk ORDER BY step DESC LIMIT 1) x)
"""


@query("similar_pair_join", SIMILAR + "SELECT ord, other, ratio FROM similar_pairs")
def _(spark, sf):
    found = dedup.similar_pairs(d.derive(spark, sf, LABELS), 95)
    return found.select("ord", "other", F.col("ratio").cast("bigint").alias("ratio"))


@query("dedup_catalog", DEDUPED)
def _(spark, sf):
    return dedup.dedup_catalog(d.derive(spark, sf, LABELS), 95)
