"""Lexical and vector hits in one list, and their reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.strings import analyze
from shelfspark.functions.templates import rerank_text
from shelfspark.operators.lexical import SEARCH_BOOSTS, query_clauses, search_bm25
from shelfspark.operators.models import TextEncoder, apply_text_model, rerank_score, term_weights
from shelfspark.operators.postings import TextIndex, index_for
from shelfspark.operators.rows import attach, format_hits, merge_products, standardize_hits, topk, union_hits
from shelfspark.operators.vectors import semantic_search
from shelfspark.session import at_most, kept


def batch_index(queries: DataFrame, docs: DataFrame) -> TextIndex:
    """An index of just the terms this batch of queries uses."""
    vocabulary = query_clauses(queries).select("term").distinct()
    return index_for(vocabulary, docs, list(SEARCH_BOOSTS), analyze)


def encoded_queries(queries: DataFrame, encoder: TextEncoder) -> DataFrame:
    """`query_id, embedding`, encoded once: the search counts them and reads them."""
    return kept(encoder.encode(queries, "query", element="double").select("query_id", "embedding"), "query-vectors")


def hybrid_search(
    queries: DataFrame,
    docs: DataFrame,
    vectors: DataFrame,
    encoder: TextEncoder,
    size_per_source: int = 10,
    index: TextIndex | None = None,
    merge: bool = False,
) -> DataFrame:
    """Up to ``size_per_source`` hits of either kind per query, in one shape.

    A product found both ways stays two hits, unless ``merge`` asks for one row that names
    both sources and carries its url. ``docs`` holds `id` and the searchable text columns, ``vectors`` holds
    `id, embedding` made by the same ``encoder``.
    """
    lexical = search_bm25(queries, docs, size_per_source, index=index)
    asked = encoded_queries(queries, encoder)
    near = semantic_search(asked, vectors.select("id", "embedding"), size_per_source, dims=getattr(encoder, "dims", None))
    bound = 10_000 * size_per_source if at_most(queries, 10_000) else None
    stored = [c for c in ["title", "description", "price", "url"] if c in docs.columns]
    found = union_hits(
        standardize_hits(lexical, "elastic", "score"),
        standardize_hits(attach(near, docs, stored, bound), "neo4j", "similarity"),
    )
    if not merge:
        return found
    merged = merge_products(found)
    return attach(merged.drop("url"), docs, ["url"], bound) if "url" in docs.columns else merged


def semantic_search_text(
    queries: DataFrame, docs: DataFrame, vectors: DataFrame, encoder: TextEncoder, size: int = 100
) -> tuple[DataFrame, DataFrame]:
    """Text queries to ranked answers: encoded, compared, given their title, url and description.

    Returns the answers, and hits that lack one of these texts with the reason.
    """
    asked = encoded_queries(queries, encoder)
    near = semantic_search(asked, vectors.select("id", "embedding"), size, dims=getattr(encoder, "dims", None))
    bound = 10_000 * size if at_most(queries, 10_000) else None
    return format_hits(attach(near, docs, ["title", "url", "description"], bound))


def rerank_sort(hits: DataFrame, final_size: int = 10) -> DataFrame:
    """Best score first; equal scores keep their order, lexical hits before vector hits."""
    lexical_first = F.when(F.col("source") == "elastic", 0).otherwise(1)
    return topk(hits, final_size, ["query_id"], [F.col("score").desc(), lexical_first, F.col("source_rank")])


def search_and_rerank(
    queries: DataFrame,
    docs: DataFrame,
    vectors: DataFrame,
    encoder: TextEncoder,
    size_per_source: int = 10,
    final_size: int = 10,
    batch_size: int = 32,
    model=None,
    index: TextIndex | None = None,
) -> DataFrame:
    """Hybrid hits in the order of a relevance score for (query, text).

    ``model`` is a factory for :func:`apply_text_model` that reads
    ``query \\x1f text`` and answers a number; without one the built-in
    idf-weighted term share is used.
    """
    index = index or batch_index(queries, docs)
    hits = hybrid_search(queries, docs, vectors, encoder, size_per_source, index)
    text = rerank_text(F.col("title"), F.col("description"), F.col("resumen"))
    if model is None:
        weights = term_weights(queries, index)
        scored = hits.join(weights, "query_id", "left").withColumn("score", rerank_score(F.col("weights"), text)).drop("weights")
    else:
        pairs = hits.join(queries.select("query_id", "query"), "query_id").withColumn(
            "_pair", F.concat_ws("\x1f", F.col("query"), text)
        )
        scored = apply_text_model(pairs, "_pair", "_answer", model, batch_size)
        scored = scored.withColumn("score", F.col("_answer").cast("double")).drop("_pair", "_answer", "_answer_error", "query")
    return rerank_sort(scored, final_size)
