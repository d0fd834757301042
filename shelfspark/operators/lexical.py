"""BM25 matching of a table of queries: fielded search, all-terms and prefix autocomplete.

A document matches in a field if it holds at least ``m`` of the query's ``n``
clauses. Any such document must hold one of any ``n - m + 1`` clauses, so only
the ``n - m + 1`` rarest clauses are looked up in the postings. Frequent words,
whose posting lists make up most of a corpus, are then only read for documents
that are candidates already.

If only the best hits are wanted, blocks of documents are left out by their bounds:
the largest impact that each term has in a block says what a document there can score
at most. The few blocks with the highest bounds are searched first; they fix a
score that a query's last hit reaches, and of the other blocks only those
that can reach it too are searched. Neither changes a result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.strings import LONGEST_PREFIX, analyze, letter_digit_tokens, letter_tokens, prefix_count
from shelfspark.operators.postings import K1, Analyzer, B, TextIndex, impact, index_for, prefix_index, store_index
from shelfspark.operators.rows import SCORE_DECIMALS, attach, topk, topk_by_score
from shelfspark.operators.scoring import FewQueries, few_queries, score_all
from shelfspark.operators.skew import spread_join
from shelfspark.session import kept, scratch_path, with_computed

#: Field settings of the product index.
SEARCH_BOOSTS = {"product_resume": 4.0, "title": 2.0, "description": 1.0}
MIN_MATCH_SHARE = 0.7

#: Blocks of a query that are searched before the cutoff is known.
FIRST_BLOCKS = 4


@dataclass(frozen=True)
class MatchRule:
    """Which fields are matched, how they are analyzed and how many clauses must hit.

    With ``prefix``, a clause hits every term that begins with it.
    """

    boosts: dict[str, float]
    min_share: float = MIN_MATCH_SHARE
    index_analyzer: Analyzer = analyze
    query_analyzer: Analyzer = analyze
    length: Analyzer = F.size
    prefix: bool = False

    def needed(self, n: Column) -> Column:
        """Clauses that must match out of ``n``."""
        return F.greatest(F.lit(1), F.floor(n * F.lit(self.min_share) + F.lit(1e-9))).cast("int")

    def store(self, docs: DataFrame, path: str, id_col: str = "id", **how) -> TextIndex:
        """The stored index that this rule searches."""
        return store_index(docs, list(self.boosts), path, self.index_analyzer, id_col, self.length, **how)


SEARCH = MatchRule(SEARCH_BOOSTS)
ALL_TERMS = MatchRule({"product_resume": 1.0}, min_share=1.0)
PREFIX = MatchRule({"product_resume": 1.0}, 1.0, letter_digit_tokens, letter_tokens, prefix_count, prefix=True)


def query_clauses(queries: DataFrame, analyzer: Analyzer = analyze) -> DataFrame:
    """`query_id, n, pos, term`: one row per query token; repeated tokens are clauses of their own."""
    tokens = queries.select("query_id", analyzer(F.col("query")).alias("t"))
    return tokens.select("query_id", F.size("t").alias("n"), F.posexplode("t").alias("pos", "term"))


def postings_join(postings: DataFrame, clauses: DataFrame, sizes: DataFrame, keys: tuple[str, ...] = ("field", "term")) -> DataFrame:
    """Query terms against indexed terms; hot terms are split by documents and by queries."""
    return spread_join(postings, clauses, list(keys), sizes, "id", "query_id")


def held_counts(postings: DataFrame, clauses: DataFrame, sizes: DataFrame) -> DataFrame:
    """`query_id, term, held, times`: in how many documents each query's terms occur, and how often, over its clauses.

    A clause that many queries share is looked up once, so the work follows the postings
    of the terms asked and not the pairs of queries and documents.
    """
    # A term repeated in a query is a clause of its own, and counts again.
    asked = clauses.groupBy("field", "term").agg(F.min("query_id").alias("query_id"))
    found = postings_join(postings, asked, sizes)
    counted = found.groupBy("field", "term").agg(F.count("*").alias("held"), F.sum("tf").alias("times"))
    repeats = clauses.groupBy("query_id", "field", "term").agg(F.count("*").alias("_clauses"))
    every = repeats.join(counted, ["field", "term"])
    return every.groupBy("query_id", "term").agg(*[F.sum(F.col(c) * F.col("_clauses")).alias(c) for c in ("held", "times")])


def _idf(df: Column, n_docs: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def _searchable(clauses: DataFrame, docs: DataFrame | TextIndex, rule: MatchRule, id_col: str) -> TextIndex:
    """The index of the rule's fields; from plain documents, one for these clauses."""
    fields = list(rule.boosts)
    vocabulary = clauses.select("term").distinct()
    stored = isinstance(docs, TextIndex)
    if rule.prefix:
        index = docs if stored else rule.store(docs, scratch_path(docs.sparkSession, "terms"), id_col)
        prefixes = vocabulary.where(F.length("term") <= LONGEST_PREFIX).select(F.col("term").alias("prefix"))
        index = prefix_index(index, prefixes)
    else:
        index = docs if stored else index_for(vocabulary, docs, fields, rule.index_analyzer, id_col)
    parts = (p if p is None else p.where(F.col("field").isin(fields)) for p in (index.postings, index.terms, index.stats, index.impacts))
    postings, terms, stats, impacts = parts
    if stored and not rule.prefix:
        postings = postings.join(vocabulary, "term", "left_semi")
        impacts = impacts if impacts is None else impacts.join(vocabulary, "term", "left_semi")
    return TextIndex(postings, terms, stats, impacts)


def _weights(clauses: DataFrame, index: TextIndex, rule: MatchRule) -> DataFrame:
    """Per query and field: clauses with their weight, rarest first. As small as the query table, and kept."""
    boost = F.create_map(*[F.lit(x) for pair in rule.boosts.items() for x in pair])
    weighted = (
        clauses.withColumn("field", F.explode(F.array(*map(F.lit, rule.boosts))))
        .join(index.terms, ["field", "term"], "left")
        .join(F.broadcast(index.stats), "field")  # as many rows as fields
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .groupBy("query_id", "field", "n", "avg_dl")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "df",
                        "term",
                        "pos",
                        (boost[F.col("field")] * (K1 + 1) * _idf(F.col("df"), F.col("n_docs"))).alias("weight"),
                    )
                )
            ).alias("clauses")
        )
        .withColumn("m", rule.needed(F.col("n")))
        .withColumn("n_distinct", F.size(F.array_distinct(F.transform("clauses", lambda c: c["term"]))))
    )
    return kept(weighted, "weights")


def _rarest(weighted: DataFrame) -> DataFrame:
    """`query_id, field, term`: of these, every match holds one."""
    terms = F.expr("array_distinct(slice(transform(clauses, c -> c.term), 1, n - m + 1))")
    return weighted.select("query_id", "field", F.explode(terms).alias("term"))


def block_bounds(weighted: DataFrame, index: TextIndex, few: FewQueries | None = None) -> DataFrame:
    """`query_id, field, block, bound`: blocks that may hold a match, and what it can score there at most."""
    if few is not None:
        bounds = score_all(index.impacts.withColumnRenamed("top", "part"), ["block"], few)
        return bounds.select("query_id", "field", "block", F.col("score").alias("bound"))
    near = postings_join(index.impacts.select("field", "term", F.col("block").alias("id")), _rarest(weighted), index.terms)
    near = near.select("query_id", "field", F.col("id").alias("block")).distinct()
    clauses = weighted.select("query_id", "field", "m", F.explode("clauses").alias("c")).select("query_id", "field", "m", "c.term", "c.weight")
    tops = near.join(clauses, ["query_id", "field"]).join(index.impacts, ["field", "term", "block"])
    bounds = tops.groupBy("query_id", "field", "block", "m").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"), F.count("*").alias("held"))
    return bounds.where("held >= m").drop("held", "m")


def _few_scores(few: FewQueries, index: TextIndex, blocks: DataFrame | None) -> DataFrame:
    """What :func:`_field_scores` gives, for queries that travel to the documents."""
    found, keys = index.postings.where("id is not null"), ["id", "dl"]
    if blocks is not None:
        keys.append("block")
        found = found.join(blocks.select("field", "block").distinct(), ["field", "block"], "left_semi")
    rated = found.join(F.broadcast(index.stats), "field")  # as many rows as fields
    parts = rated.select("field", "term", *keys, impact(F.col("tf"), F.col("dl"), F.col("avg_dl")).alias("part"))
    scores = score_all(parts, keys, few)
    if blocks is not None:
        scores = scores.join(blocks.select("query_id", "field", "block"), ["query_id", "field", "block"], "left_semi")
    return scores.select("query_id", "field", "id", "matched", F.round("score", SCORE_DECIMALS).alias("score"))


def _field_scores(weighted: DataFrame, index: TextIndex, blocks: DataFrame | None = None, few: FewQueries | None = None) -> DataFrame:
    """`query_id, field, id, matched, score` of every match, or of those in some blocks (`query_id, field, block`).

    Few queries go to the documents; the candidates of many are found by their rarest clauses.
    """
    if few is not None:
        return _few_scores(few, index, blocks)
    probes, keys = _rarest(weighted), ["field", "term"]
    if blocks is not None:
        probes = probes.join(blocks.select("query_id", "field", "block"), ["query_id", "field"])
        keys.append("block")
    found = postings_join(index.postings.select(*keys, "id"), probes, index.terms, tuple(keys))
    # Read twice: by the postings, of which only those of candidates go on, and by the scoring.
    candidates = kept(found.select("query_id", "field", "id").distinct(), "candidates")

    # The query terms each candidate's field holds, one row per field: the list is
    # no longer than the document's own vocabulary.
    asked = candidates.select("field", "id").distinct()
    doc_terms = index.postings.join(asked, ["field", "id"], "left_semi").groupBy("field", "id", "dl").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("tfs")
    )
    joined = candidates.join(doc_terms, ["field", "id"]).join(weighted, ["query_id", "field"])

    # Most candidates hold too few of the terms; a set intersection tells, before
    # anything is looked up. Repeated clauses can only raise the count.
    terms = F.transform("clauses", lambda c: c["term"])
    shared = F.size(F.array_intersect(terms, F.map_keys("tfs")))
    likely = joined.where(shared >= F.col("m") - (F.col("n") - F.col("n_distinct")))

    norm = F.lit(K1) * (1 - B + B * F.col("dl") / F.col("avg_dl"))
    hits = F.filter(
        F.transform("clauses", lambda c: F.struct(c["weight"].alias("w"), F.try_element_at("tfs", c["term"]).alias("tf"))),
        lambda c: c["tf"].isNotNull(),
    )
    scored = with_computed(likely.withColumn("norm", norm), hits=hits).where(F.size("hits") >= F.col("m"))
    score = F.aggregate("hits", F.lit(0.0), lambda acc, h: acc + h["w"] * h["tf"] / (h["tf"] + F.col("norm")))
    return scored.select(
        "query_id", "field", "id", F.size("hits").alias("matched"), F.round(score, SCORE_DECIMALS).alias("score")
    )


def match_scores(queries: DataFrame, docs: DataFrame | TextIndex, rule: MatchRule, id_col: str = "id") -> DataFrame:
    """`query_id, field, id, matched, score`: every field of every document that counts.

    ``docs`` are plain documents, or an index stored beforehand.
    """
    clauses = query_clauses(queries, rule.query_analyzer)
    index = _searchable(clauses, docs, rule, id_col)
    weighted = _weights(clauses, index, rule)
    return _field_scores(weighted, index, few=few_queries(weighted))


def open_blocks(bounds: DataFrame, first: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """The blocks not in ``first`` that can still change a query's best ``size``, given the hits ``found`` in those."""
    reached = topk_by_score(best_field(found), size).groupBy("query_id").agg(
        F.when(F.count("*") >= size, F.min("score")).otherwise(0.0).alias("cutoff")
    )
    rest = bounds.join(first.select("query_id", "field", "block"), ["query_id", "field", "block"], "left_anti")
    # Scores are rounded, so a bound just under the cutoff may still tie with it.
    return rest.join(reached, "query_id", "left").where(F.col("bound") + 10.0**-SCORE_DECIMALS >= F.coalesce("cutoff", F.lit(0.0)))


def top_scores(queries: DataFrame, docs: DataFrame | TextIndex, rule: MatchRule, size: int, id_col: str = "id") -> DataFrame:
    """`query_id, id, score, rank`: the best ``size`` documents of each query."""
    clauses = query_clauses(queries, rule.query_analyzer)
    index = _searchable(clauses, docs, rule, id_col)
    weighted = _weights(clauses, index, rule)
    few = few_queries(weighted)
    if index.impacts is None:
        return topk_by_score(best_field(_field_scores(weighted, index, few=few)), size)
    bounds = kept(block_bounds(weighted, index, few), "bounds")
    first = kept(topk(bounds, FIRST_BLOCKS, ["query_id"], [F.col("bound").desc(), F.col("block"), F.col("field")]).drop("rank"), "first-blocks")
    found = kept(_field_scores(weighted, index, first, few), "first-hits")
    more = _field_scores(weighted, index, kept(open_blocks(bounds, first, found, size), "open-blocks"), few)
    return topk_by_score(best_field(found.unionByName(more)), size)


def best_field(field_scores: DataFrame) -> DataFrame:
    """A document's score is that of its best field."""
    return field_scores.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def _hits(queries, docs, rule: MatchRule, size: int, stored: list[str], id_col: str, index: TextIndex | None) -> DataFrame:
    seen = queries.agg(F.count("*").alias("n"), F.count_distinct("query").alias("texts")).first()
    asked = queries
    if seen["texts"] < seen["n"]:
        # Equal texts are answered once.
        asked = kept(queries.where("query is not null").groupBy("query").agg(F.min("query_id").alias("query_id")), "texts")
    ranked = top_scores(asked, index or docs, rule, size, id_col)
    if asked is not queries:
        same = queries.select(F.col("query_id").alias("_id"), "query").join(asked, "query").select("query_id", "_id")
        ranked = ranked.join(same, "query_id").drop("query_id").withColumnRenamed("_id", "query_id").select(*ranked.columns)
    # Each query has at most ``size`` hits, so few queries mean few hits.
    bound = 10_000 * size if seen["n"] <= 10_000 else None
    return attach(ranked, docs.withColumnRenamed(id_col, "id"), stored, bound)


def search_bm25(
    queries: DataFrame, docs: DataFrame, size: int = 10, id_col: str = "id", index: TextIndex | None = None
) -> DataFrame:
    """Top ``size`` documents per query over the boosted fields, with their stored columns."""
    stored = [c for c in ["title", "product_resume", "price", "description"] if c in docs.columns]
    return _hits(queries, docs, SEARCH, size, stored, id_col, index).withColumnRenamed("product_resume", "resumen")


def match_all_terms(
    queries: DataFrame, docs: DataFrame, size: int = 10, id_col: str = "id", index: TextIndex | None = None
) -> DataFrame:
    """Autocomplete: documents whose summary holds every query term."""
    return _hits(queries, docs, ALL_TERMS, size, ["product_resume"], id_col, index)


def match_prefix(
    queries: DataFrame, docs: DataFrame, size: int = 10, id_col: str = "id", index: TextIndex | None = None
) -> DataFrame:
    """Autocomplete: every query token starts some token of the summary."""
    return _hits(queries, docs, PREFIX, size, ["product_resume"], id_col, index)
