"""Column functions, filters and small projections."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from shelfspark.functions import answers, fields, html, strings, templates, urls
from shelfspark.operators import metrics, models, rows
from shelfspark.session import with_computed
from shelfspark.plans.crawl import extract_links, extracted
from shelfspark.sources.pages import scan_pages, with_content
from shelfspark.suite import derive as d
from shelfspark.suite import sqltext as q
from shelfspark.suite.registry import query

RAW = f"WITH raw AS ({d.PRODUCTS_RAW}) "


def raw(spark, sf):
    return d.derive(spark, sf, d.PRODUCTS_RAW)


def pages(spark, sf):
    return d.table(spark, sf, "pages")


def text_list(c):
    return F.array_join(c, "|")


@query("clean_price", RAW + f"SELECT id, {q.clean_price('price')} AS value FROM raw")
def _(spark, sf):
    return raw(spark, sf).select("id", fields.clean_price(F.col("price")).alias("value"))


@query(
    "price_or_zero",
    RAW + f"SELECT id, CASE WHEN {q.strip('price')} = '' THEN 0 ELSE {q.number('price')} END AS value FROM raw",
)
def _(spark, sf):
    return raw(spark, sf).select("id", fields.price_or_zero(F.col("price")).alias("value"))


@query(
    "price_or_null",
    "SELECT p_partkey AS id, CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS value FROM part",
)
def _(spark, sf):
    price = F.expr("CASE WHEN p_size % 5 = 0 THEN double('NaN') ELSE p_retailprice END")
    return d.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), fields.price_or_null(price).alias("value"))


@query(
    "list_split_raw",
    RAW + f"SELECT id, len(l) AS items, {q.joined('l')} AS value FROM (SELECT id, string_split({q.bare_list('similar_products')}, ',') AS l FROM raw) x",
)
def _(spark, sf):
    items = fields.list_split_raw(F.col("similar_products"))
    return raw(spark, sf).select("id", F.size(items).cast("bigint").alias("items"), text_list(items).alias("value"))


@query(
    "list_parse_clean",
    RAW + f"SELECT id, len(l) AS items, {q.joined('l')} AS value FROM (SELECT id, {q.parsed_list('similar_products')} AS l FROM raw) x",
)
def _(spark, sf):
    items = fields.list_parse_clean(F.col("similar_products"))
    return raw(spark, sf).select("id", F.size(items).cast("bigint").alias("items"), text_list(items).alias("value"))


@query(
    "list_to_json",
    RAW + f"""SELECT id, CASE WHEN len(l) = 0 THEN '[]' ELSE '["' || array_to_string(l, '","') || '"]' END AS value
    FROM (SELECT id, {q.parsed_list('similar_products')} AS l FROM raw) x""",
)
def _(spark, sf):
    return raw(spark, sf).select(
        "id", fields.list_to_json(fields.list_parse_clean(F.col("similar_products"))).alias("value")
    )


@query(
    "product_projection",
    RAW + f"""SELECT id, url, title, description, {q.number('price_without_discount')} AS price_without_discount,
      {q.number('price')} AS price, '' AS similar_purchases, '' AS most_bought, '' AS recommendations, similar_products,
      '' AS other_members_also_purchased, resumen_producto AS product_resume, '' AS product_context FROM raw""",
)
def _(spark, sf):
    return rows.product_projection(with_empty_lists(raw(spark, sf)), keep=["id"])


def with_empty_lists(df):
    for name in ("similar_purchases", "most_bought", "recommendations", "other_members_also_purchased"):
        df = df.withColumn(name, F.lit(""))
    return df


@query("scan_pages", "SELECT page_id, url, html FROM pages")
def _(spark, sf):
    return scan_pages(spark, f"{sf}/pages.parquet")


@query("html_to_text", f"SELECT page_id, {q.visible_text('html')} AS content FROM pages")
def _(spark, sf):
    return with_content(pages(spark, sf)).select("page_id", "content")


@query("html_title", f"SELECT page_id, {q.title('html')} AS title FROM pages")
def _(spark, sf):
    return pages(spark, sf).select("page_id", html.html_title(F.col("html")).alias("title"))


HREFS = r"""regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<a\s+[^>]*href="(/[^"]*)"', 1)"""


@query("extract_links", f"SELECT page_id, url, unnest({HREFS}) AS href FROM pages")
def _(spark, sf):
    return extract_links(pages(spark, sf), inside="/")


#: The pages again with their hrefs unquoted, behind an attribute that holds `>`, and once more inside a script.
OTHER_MARKUP = """
SELECT page_id, url, regexp_replace(html, 'href="(/[^" >]*)"', 'title="a>b" href=$1') || '<script>x = ''<a href="/no">'';</script>' AS html FROM pages
"""


@query("extract_links_any_markup", f"SELECT page_id, url, h AS href FROM (SELECT page_id, url, unnest({HREFS}) AS h FROM pages) x WHERE h NOT LIKE '% %'")
def _(spark, sf):
    return extract_links(d.derive(spark, sf, OTHER_MARKUP), inside="/").where("href not like '% %'")


@query(
    "resolve_link",
    f"""SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || href AS link
    FROM (SELECT page_id, url, unnest({HREFS}) AS href FROM pages) x""",
)
def _(spark, sf):
    return extract_links(pages(spark, sf), "/").select("page_id", urls.resolve_link(F.col("url"), F.col("href")).alias("link"))


@query("site_name", "SELECT page_id, replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), 'www.', '') AS site FROM pages")
def _(spark, sf):
    return pages(spark, sf).select("page_id", urls.site_name(F.col("url")).alias("site"))


ALL_URLS = "SELECT url FROM pages UNION ALL SELECT url FROM raw"


@query(
    "classify_product_url",
    RAW + rf"SELECT url, regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/p/[0-9]+$') AS is_product FROM ({ALL_URLS}) u",
)
def _(spark, sf):
    known = pages(spark, sf).select("url").unionByName(raw(spark, sf).select("url"))
    return known.select("url", urls.is_product_url(F.col("url")).alias("is_product"))


YES_NO = "CASE WHEN toxic = 1 THEN ' SÍ ' || chr(10) WHEN quality = 1 THEN 'si' ELSE 'No, sí' END"


@query("yes_no_answer", "SELECT doc_id, toxic = 1 OR quality = 1 AS yes FROM labels")
def _(spark, sf):
    return d.table(spark, sf, "labels").select("doc_id", urls.is_yes(F.expr(YES_NO)).alias("yes"))


EVENT_ANSWERS = f"WITH a AS ({d.EVENT_ANSWERS}) "


@query("json_block", EVENT_ANSWERS + f"SELECT event_id, {q.json_block('answer')} AS block FROM a")
def _(spark, sf):
    return d.derive(spark, sf, d.EVENT_ANSWERS).select("event_id", answers.json_block(F.col("answer")).alias("block"))


@query(
    "json_repair_parse",
    EVENT_ANSWERS + f"""SELECT event_id, j AS json, CAST(json_extract_string(j, '$.k') AS BIGINT) AS k
    FROM (SELECT event_id, {q.parsed_json('answer')} AS j FROM a) x""",
)
def _(spark, sf):
    parsed = d.derive(spark, sf, d.EVENT_ANSWERS).select("event_id", answers.parse_json(F.col("answer")).alias("json"))
    return parsed.select("event_id", "json", F.from_json("json", "k bigint")["k"].alias("k"))


JSON_LIST = "array_to_string(CAST(json_extract(j, '$.{0}') AS VARCHAR[]), '|')"
KEYS = (
    "['description','price_without_discount','price','similar_purchases','most_bought','recommendations',"
    "'similar_products','other_members_also_purchased']"
)
EXTRACTED = f"""
WITH a AS ({d.ANSWERS}),
parsed AS (
  SELECT p.page_id, p.url, {q.title('p.html')} AS title, a.answer, {q.parsed_json('a.answer')} AS j
  FROM pages p LEFT JOIN a ON a.page_id = p.page_id),
judged AS (
  SELECT *, CASE WHEN answer IS NULL OR {q.json_block('answer')} IS NULL THEN 'no JSON object' WHEN j IS NULL THEN 'unreadable JSON'
    WHEN NOT list_has_all(json_keys(j), {KEYS}) THEN 'missing ' || array_to_string(
      list_filter({KEYS}, lambda k: NOT list_contains(json_keys(j), k)), ',') END AS error
  FROM parsed),
products AS (
  SELECT page_id, url, title, json_extract_string(j, '$.description') AS description,
    {q.clean_price("json_extract_string(j, '$.price_without_discount')")} AS price_without_discount,
    {q.clean_price("json_extract_string(j, '$.price')")} AS price,
    coalesce({JSON_LIST.format('similar_purchases')}, '') AS similar_purchases,
    coalesce({JSON_LIST.format('most_bought')}, '') AS most_bought,
    coalesce({JSON_LIST.format('recommendations')}, '') AS recommendations,
    coalesce({JSON_LIST.format('similar_products')}, '') AS similar_products,
    coalesce({JSON_LIST.format('other_members_also_purchased')}, '') AS other_members_also_purchased
  FROM judged WHERE error IS NULL)
"""


def flat(df):
    """Lists as text, so both engines print them alike."""
    return df.select(
        *[text_list(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema]
    )


@query("extract_product_row", EXTRACTED + "SELECT * FROM products")
def _(spark, sf):
    return flat(extracted(pages(spark, sf), d.derive(spark, sf, d.ANSWERS))[0])


@query("quarantine_bad_rows", EXTRACTED + "SELECT page_id, url, answer, error FROM judged WHERE error IS NOT NULL")
def _(spark, sf):
    return extracted(pages(spark, sf), d.derive(spark, sf, d.ANSWERS))[1]


def tokens_query(name, analyzer, sql):
    @query(name, f"SELECT doc_id, len(l) AS tokens, {q.joined('l')} AS value FROM (SELECT doc_id, {sql('text')} AS l FROM documents) x")
    def _(spark, sf):
        docs = d.table(spark, sf, "documents").select("doc_id", "text")
        toks = with_computed(docs, l=analyzer(F.col("text")))
        return toks.select("doc_id", F.size("l").cast("bigint").alias("tokens"), text_list("l").alias("value"))


tokens_query("analyze", strings.analyze, q.tokens)
tokens_query("edge_ngrams", strings.edge_ngrams, q.prefixes)
tokens_query("letter_tokens", strings.letter_tokens, q.letters)


@query(
    "prompt_column",
    f"SELECT page_id, '{templates.EXTRACT_TEMPLATE.split('{')[0]}' || {q.visible_text('html')} AS prompt FROM pages",
)
def _(spark, sf):
    return pages(spark, sf).select(
        "page_id", templates.fill(templates.EXTRACT_TEMPLATE, content=html.html_to_text(F.col("html"))).alias("prompt")
    )


@query(
    "rerank_text",
    RAW + f"SELECT id, {q.strip('''('Title: ' || title || chr(10) || 'Description: ' || coalesce(description, '') || chr(10) || 'Summary: ' || coalesce(resumen_producto, ''))''')} AS value FROM raw",
)
def _(spark, sf):
    text = templates.rerank_text(F.col("title"), F.col("description"), F.col("resumen_producto"))
    return raw(spark, sf).select("id", text.alias("value"))


@query(
    "standardize_hits",
    """SELECT event_id AS query_id, user_id AS id, event_type AS title, '' AS description, 0.0::DOUBLE AS price,
      CAST(NULL AS VARCHAR) AS url, props AS resumen, 'elastic' AS source, value AS original_score, event_id AS source_rank FROM events""",
)
def _(spark, sf):
    hits = d.table(spark, sf, "events").selectExpr(
        "event_id AS query_id", "user_id AS id", "event_type AS title", "props AS resumen", "value AS score", "event_id AS rank"
    )
    return rows.standardize_hits(hits, "elastic", "score")


HITS = RAW.rstrip() + ", h AS (SELECT id % 10 AS query_id, id, title, url, description, 1 / (1 + id) AS similarity FROM raw) "


@query(
    "format_hits",
    HITS + """SELECT query_id, id, title, url, description, similarity AS similarity_score, CAST(NULL AS VARCHAR) AS error
      FROM h WHERE description IS NOT NULL
    UNION ALL SELECT query_id, id, title, url, description, similarity, 'missing description' FROM h WHERE description IS NULL""",
)
def _(spark, sf):
    hits = raw(spark, sf).selectExpr("id % 10 AS query_id", "id", "title", "url", "description", "1 / (1 + id) AS similarity")
    good, bad = rows.format_hits(hits)
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad)


@query("stamp_updated_at", RAW + "SELECT id, url, '2024-05-01 12:30:00' AS context_updated_at FROM raw")
def _(spark, sf):
    stamped = rows.stamp_updated_at(raw(spark, sf).select("id", "url"), datetime(2024, 5, 1, 12, 30))
    return stamped.withColumn("context_updated_at", F.col("context_updated_at").cast("string"))


FRONTIER = f"WITH f AS ({d.FRONTIER}) "


@query("pending_urls", FRONTIER + "SELECT url, first_seen FROM f WHERE NOT already_scraped ORDER BY first_seen, url LIMIT 100")
def _(spark, sf):
    return rows.pending_urls(d.derive(spark, sf, d.FRONTIER), 100).select("url", "first_seen")


def embeddable(spark, sf):
    """Documents with the vector of the same number, where there is one; every 17th lost its description."""
    vectors = d.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("description_embedding"))
    docs = d.table(spark, sf, "documents").select(
        "doc_id",
        F.expr("CASE WHEN doc_id % 17 <> 0 THEN text END").alias("description"),
        F.expr("CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 <> 0 THEN text END").alias("product_context"),
    )
    return docs.join(vectors, "doc_id", "left")


LACKING = "FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.vec_id IS NULL AND doc_id % 17 <> 0"


@query("needs_embedding", f"SELECT doc_id, text AS description {LACKING}")
def _(spark, sf):
    return rows.needs_embedding(embeddable(spark, sf)).select("doc_id", "description")


@query("nonempty_text", "SELECT doc_id, text AS product_context FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND text <> ''")
def _(spark, sf):
    return rows.nonempty_text(embeddable(spark, sf)).select("doc_id", "product_context")


@query("count_pending_embeddings", f"SELECT count(*) AS pending {LACKING}")
def _(spark, sf):
    return metrics.count_pending_embeddings(embeddable(spark, sf))


@query("scan_all_projected", RAW + "SELECT id, url, title, description FROM raw")
def _(spark, sf):
    return rows.scan_projected(raw(spark, sf), ["id", "url", "title", "description"])


@query(
    "load_metrics",
    RAW + f"""SELECT count(*) AS rows_read, count(*) FILTER (WHERE NOT bad) AS succeeded, count(*) FILTER (WHERE bad) AS failed
    FROM (SELECT ({q.strip('price')} <> '' AND {q.clean_price('price')} IS NULL) AS bad FROM raw) x""",
)
def _(spark, sf):
    price = F.col("price")
    error = F.when((strings.strip(price) != "") & fields.clean_price(price).isNull(), F.lit("bad price"))
    return metrics.load_metrics(raw(spark, sf).withColumn("error", error))


@query("limit_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, sf):
    return rows.limit_n(
        d.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), "o_orderkey"
    )


@query(
    "topk_by_score",
    """SELECT * FROM (SELECT user_id AS query_id, event_id AS id, value AS score,
        row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) r WHERE rank <= 10""",
)
def _(spark, sf):
    scored = d.table(spark, sf, "events").selectExpr("user_id AS query_id", "event_id AS id", "value AS score")
    return rows.topk_by_score(scored, 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "order_by_similarity",
    """SELECT * FROM (SELECT p_brand AS query_id, p_partkey AS id, p_retailprice AS similarity,
        row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) r WHERE rank <= 5""",
)
def _(spark, sf):
    scored = d.table(spark, sf, "part").selectExpr("p_brand AS query_id", "p_partkey AS id", "p_retailprice AS similarity")
    return rows.topk_by_score(scored, 5, score="similarity").withColumn("rank", F.col("rank").cast("bigint"))


TWO_SOURCES = """
SELECT c_nationkey AS query_id, c_custkey AS id, 'elastic' AS source, floor(c_acctbal / 1000) AS score, c_custkey AS source_rank FROM customer
UNION ALL
SELECT s_nationkey, s_suppkey, 'neo4j', floor(s_acctbal / 1000), s_suppkey FROM supplier
"""


@query(
    "rerank_sort",
    f"""SELECT query_id, id, source, CAST(score AS BIGINT) AS score, source_rank, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, source_rank) AS rank FROM ({TWO_SOURCES}) u) r
    WHERE rank <= 10""",
)
def _(spark, sf):
    from shelfspark.operators.hybrid import rerank_sort

    hits = d.derive(spark, sf, TWO_SOURCES).withColumn("score", F.col("score").cast("bigint"))
    return rerank_sort(hits, 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "union_hits",
    """SELECT c_custkey AS id, c_name AS title, CAST(NULL AS VARCHAR) AS url, c_mktsegment AS resumen FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_name, NULL FROM supplier""",
)
def _(spark, sf):
    lexical = d.table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS title", "c_mktsegment AS resumen")
    semantic = d.table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS title", "s_name AS url")
    return rows.union_hits(lexical, semantic)


@query(
    "summarize_title",
    "SELECT p_partkey AS id, p_type || ' ' || p_name AS summary FROM part",
)
def _(spark, sf):
    titles = d.derive(
        spark, sf, "SELECT p_partkey AS id, p_brand || ', ' || p_type || ' ' || p_name || ' size ' || p_size || ' | Shop' AS title FROM part"
    )
    return titles.select("id", models.summarize_title(F.col("title")).alias("summary"))


@query(
    "generate_context",
    RAW + f"""SELECT id, {q.strip("title || chr(10) || coalesce(description, '')")} AS product_context FROM raw""",
)
def _(spark, sf):
    return raw(spark, sf).select("id", models.generate_context(F.col("title"), F.col("description")).alias("product_context"))


@query("apply_text_model", "SELECT doc_id, CAST(length(text) AS VARCHAR) AS n, CAST(NULL AS VARCHAR) AS n_error FROM documents")
def _(spark, sf):
    docs = d.table(spark, sf, "documents").select("doc_id", "text")
    return models.apply_text_model(docs, "text", "n", _length_model).drop("text")


def _length_model():
    return lambda texts: [str(len(t)) for t in texts]


@query(
    "embed_text",
    f"""WITH hashed AS (SELECT doc_id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 1536 AS bucket, count(*) AS tf
      FROM (SELECT doc_id, unnest({q.tokens('text')}) AS term FROM documents) x GROUP BY ALL),
    df AS (SELECT bucket, count(*) AS df FROM hashed GROUP BY bucket),
    n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
    w AS (SELECT doc_id, bucket, tf * ln((n + 1.0) / (df + 1)) AS w FROM hashed JOIN df USING (bucket) CROSS JOIN n)
    SELECT doc_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS value FROM w WHERE w > 0""",
)
def _(spark, sf):
    docs = d.table(spark, sf, "documents").select("doc_id", "text")
    dense = models.TextEncoder.fit(docs, "text").encode(docs, "text", element="double")
    cells = dense.select("doc_id", F.posexplode("embedding").alias("bucket", "value")).where("value <> 0")
    return cells.select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round("value", 6).alias("value"))


@query(
    "rerank_score",
    f"""WITH qt AS (SELECT item_id, unnest(list_distinct({q.tokens('text')})) AS term FROM benchmark),
    toks AS (SELECT doc_id, {q.tokens('text')} AS t FROM documents),
    dt AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(t) AS term FROM toks),
    df AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
    n AS (SELECT count(*) AS n_docs FROM toks WHERE len(t) > 0),
    w AS (SELECT item_id, qt.term, ln(1 + (n_docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf
      FROM qt LEFT JOIN df ON df.term = qt.term CROSS JOIN n),
    pairs AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents)
    SELECT p.doc_id, p.item_id AS query_id, coalesce(round(sum(idf) FILTER (WHERE dt.term IS NOT NULL) / sum(idf), 6), 0) AS score
    FROM pairs p JOIN w ON w.item_id = p.item_id LEFT JOIN dt ON dt.doc_id = p.doc_id AND dt.term = w.term
    GROUP BY p.doc_id, p.item_id""",
)
def _(spark, sf):
    from shelfspark.operators.hybrid import query_clauses
    from shelfspark.operators.postings import index_for

    docs = d.table(spark, sf, "documents").selectExpr("doc_id AS id", "text AS description")
    queries = d.derive(spark, sf, d.QUERIES)
    index = index_for(query_clauses(queries).select("term").distinct(), docs, ["description"], strings.analyze)
    pairs = docs.withColumn("query_id", F.col("id") % queries.count())
    scored = pairs.join(models.term_weights(queries, index), "query_id")
    return scored.select(
        F.col("id").alias("doc_id"), "query_id", models.rerank_score(F.col("weights"), F.col("description")).alias("score")
    )


@query("extract_fields_model", EXTRACTED + "SELECT page_id, j AS json, error FROM judged")
def _(spark, sf):
    known = d.derive(spark, sf, d.ANSWERS)
    asked = pages(spark, sf).join(known, "page_id", "left").select("page_id", "answer")
    replied = models.apply_text_model(asked, "answer", "reply", _echo_model)
    return answers.with_parsed_answer(replied, "reply").select("page_id", "json", "error")


def _echo_model():
    return lambda texts: list(texts)
