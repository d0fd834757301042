"""Batch and streaming jobs."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from shelfspark.operators.models import ModelEncoder, TextEncoder
from shelfspark.plans import catalog as cat
from shelfspark.plans import crawl, leases
from shelfspark.schema import EXTRACTED as EXTRACTED_SCHEMA
from shelfspark.schema import LIST_FIELDS, QUARANTINE
from shelfspark.session import scratch_path
from shelfspark.sources import ledger
from shelfspark.sources.keyed_tables import KeyedTable
from shelfspark.sources.pages import stream_pages
from shelfspark.sources.tables import read_changes, write_changes
from shelfspark.streaming import jobs as st
from shelfspark.suite import derive as d
from shelfspark.suite import sqltext as q
from shelfspark.suite.registry import query
from shelfspark.suite.scalars import EXTRACTED, HREFS, RAW, embeddable, flat, pages, raw, with_empty_lists
from shelfspark.suite.derive import once_stored
from shelfspark.suite.tables import csv_source

LOADABLE = (
    f"coalesce({q.strip('price')} = '' OR {q.number('price')} IS NOT NULL, true) AND "
    f"coalesce({q.strip('price_without_discount')} = '' OR {q.number('price_without_discount')} IS NOT NULL, true)"
)


def loadable_source(spark, sf) -> str:
    """The derived catalog with the price cleaned of its signs, as a file."""
    from shelfspark.sources.catalog_csv import write_catalog_csv
    from shelfspark.suite.tables import CSV_COLUMNS

    path = scratch_path(spark, "catalog-csv")
    plain = raw(spark, sf).withColumn("price", F.regexp_replace("price", "[$,]", ""))
    write_catalog_csv(with_empty_lists(plain).select(*CSV_COLUMNS), path)
    return path


@query(
    "load_catalog",
    RAW.rstrip() + f""", plain AS (SELECT * REPLACE (replace(replace(price, '$', ''), ',', '') AS price) FROM raw),
    judged AS (SELECT *, {LOADABLE} AS good FROM plain)
    SELECT url, title, nullif(description, '') AS description, {q.number('price_without_discount')} AS price_without_discount,
      {q.number('price')} AS price, nullif(similar_products, '') AS similar_products, resumen_producto AS product_resume,
      '' AS product_context, 'created' AS outcome FROM judged WHERE good""",
)
def _(spark, sf):
    loaded = cat.load_catalog(spark, loadable_source(spark, sf))
    both = loaded.documents.join(loaded.outcomes, "id").join(loaded.nodes.select("url"), "url")
    return both.select(
        "url", "title", "description", "price_without_discount", "price", "similar_products", "product_resume", "product_context", "outcome"
    )


@query(
    "summarize_catalog",
    RAW + rf"""SELECT url, title, title AS product_resume,
      {q.number('price_without_discount')} AS price_without_discount FROM raw""",
)
def _(spark, sf):
    source = csv_source(spark, sf)
    plain = scratch_path(spark, "plain-csv")
    from shelfspark.sources.catalog_csv import scan_catalog_csv, write_catalog_csv

    write_catalog_csv(scan_catalog_csv(spark, source).drop("resumen_producto"), plain)
    nodes = cat.summarize_catalog(spark, plain, scratch_path(spark, "summaries"))
    return nodes.select("url", "title", "product_resume", "price_without_discount")


CONTEXT = "'Name: ' || title || chr(10) || coalesce(description, '')"


@query(
    "refresh_context",
    RAW + f"SELECT url, {CONTEXT} AS product_context, '2024-05-01 12:30:00' AS context_updated_at, CAST(NULL AS VARCHAR) AS embedding FROM raw",
)
def _(spark, sf):
    products = raw(spark, sf).select(
        "url",
        "title",
        "description",
        F.lit("").alias("product_context"),
        F.lit(None).cast("timestamp").alias("context_updated_at"),
        F.array(F.lit(1.0)).cast("array<float>").alias("description_embedding"),
    )
    context = F.concat(F.lit("Name: "), "title", F.lit("\n"), F.coalesce("description", F.lit("")))
    out = cat.refresh_context(products, datetime(2024, 5, 1, 12, 30), context, invalidate_embedding=True)
    return out.select(
        "url",
        "product_context",
        F.col("context_updated_at").cast("string").alias("context_updated_at"),
        F.col("description_embedding").cast("string").alias("embedding"),
    )


EMBEDDABLE = """
SELECT d.doc_id, CASE WHEN doc_id % 17 <> 0 THEN text END AS description,
  CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 <> 0 THEN text END AS product_context, e.vec_id IS NOT NULL AS has_vector
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""
BACKFILLED = f"""
WITH p AS ({EMBEDDABLE}),
j AS (SELECT *, NOT has_vector AND description IS NOT NULL AND coalesce(product_context, '') <> '' AS pending FROM p)
SELECT count(*) FILTER (WHERE pending) AS processed_count, count(*) FILTER (WHERE has_vector OR pending) AS with_vector,
  count(*) AS products FROM j"""


def _backfill_input(spark, sf):
    products = embeddable(spark, sf).withColumn("url", F.concat(F.lit("doc:"), F.col("doc_id")))
    return products, TextEncoder.fit(products, "product_context")


@query("backfill_embeddings", BACKFILLED)
def _(spark, sf):
    path = scratch_path(spark, "embedded")
    run = cat.backfill_embeddings(*_backfill_input(spark, sf), path)
    stored = spark.read.parquet(path).agg(
        F.count("description_embedding").alias("with_vector"), F.count("*").alias("products")
    )
    processed = run.first()["processed_count"]
    return stored.select(F.lit(processed).cast("bigint").alias("processed_count"), "with_vector", "products")


def letter_counts():
    """A small model from outside: a text's length and its numbers of three letters."""
    return lambda texts: [[float(len(t)), *(float(t.count(c)) for c in "aei")] for t in texts]


@query(
    "backfill_with_model",
    f"""WITH p AS ({EMBEDDABLE}) SELECT 'doc:' || doc_id AS url, CAST(length(product_context) AS DOUBLE) AS length,
      CAST(length(product_context) - length(replace(product_context, 'e', '')) AS DOUBLE) AS e FROM p
    WHERE NOT has_vector AND description IS NOT NULL AND coalesce(product_context, '') <> ''""",
)
def _(spark, sf):
    """Vectors of a model that lives outside, for the products that lack one."""
    products = embeddable(spark, sf).withColumn("url", F.concat(F.lit("doc:"), F.col("doc_id")))
    path = scratch_path(spark, "embedded-by-model")
    cat.backfill_embeddings(products, ModelEncoder(letter_counts), path)
    made = spark.read.parquet(path).where(F.size("description_embedding") == 4)
    return made.select("url", *[F.col("description_embedding")[i].cast("double").alias(n) for i, n in ((0, "length"), (2, "e"))])


#: No page of the given tables links to `/p/<digits>`, so any rooted link that ends in a letter counts.
LINK_RULE = {"inside": "/", "path_pattern": "[a-z]$"}
DISCOVERED = f"""
WITH f AS ({d.FRONTIER}),
l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || href AS url
  FROM (SELECT page_id, url, unnest({HREFS}) AS href FROM pages) x),
fresh AS (SELECT url, false AS already_scraped, min(page_id) AS first_seen FROM l
  WHERE regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[a-z]$') AND url NOT IN (SELECT url FROM f) GROUP BY url)
"""


@query("discover_urls", DISCOVERED + "SELECT * FROM fresh")
def _(spark, sf):
    found = crawl.discover_urls(pages(spark, sf), d.derive(spark, sf, d.FRONTIER), **LINK_RULE)
    return found.select("url", "already_scraped", "first_seen")


@query(
    "extract_products",
    EXTRACTED + """SELECT * EXCLUDE page_id FROM products
    UNION ALL SELECT replace(url, 'example', 'sample'), 'old', NULL, NULL, NULL, '', '', '', '', '' FROM pages""",
)
def _(spark, sf):
    known = pages(spark, sf).select(
        F.regexp_replace("url", "example", "sample").alias("url"),
        F.lit("old").alias("title"),
        F.lit(None).cast("string").alias("description"),
        *[F.lit(None).cast("double").alias(c) for c in ("price_without_discount", "price")],
        *[F.array().cast("array<string>").alias(c) for c in LIST_FIELDS],
    )
    done = crawl.extract_products(pages(spark, sf), d.derive(spark, sf, d.ANSWERS), known, d.derive(spark, sf, d.FRONTIER))
    return flat(done.products)


def page_reader():
    """A small model from outside: reads the page's text in the prompt and answers with its length, or not at all."""

    def answer(prompt: str) -> str:
        n = len(prompt.split("Page:\n", 1)[1])
        keys = {"description": f"text of {n}", "price_without_discount": "", "price": f"${n}", "most_bought": ["a", "b"]}
        rest = {c: [] for c in LIST_FIELDS if c not in keys}
        return "I can't tell." if n % 5 == 0 else "Here it is: " + json.dumps(keys | rest)

    return lambda prompts: [answer(p) for p in prompts]


#: What the crawl makes of every page: the text's length is the price, and a length of whole fives is no answer.
READ = f"""
WITH f AS ({d.FRONTIER}), t AS (SELECT page_id, url, length({q.visible_text('html')}) AS n, {q.title('html')} AS title FROM pages),
due AS (SELECT t.* FROM t JOIN f USING (url) WHERE NOT f.already_scraped),
best AS (SELECT * FROM due WHERE n % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1)
"""


def crawled(spark, sf):
    """The leased crawl over all pending URLs, in three rounds; run once in a session."""
    return once_stored(spark, sf, "crawl", lambda _: crawl_all(spark, sf))


def crawl_all(spark, sf):
    known = d.derive(spark, sf, d.FRONTIER)
    frontier = leases.open_frontier(known, scratch_path(spark, "leased-frontier"), 8)
    products = KeyedTable.create(spark.createDataFrame([], EXTRACTED_SCHEMA), scratch_path(spark, "crawled-products"), "url", 8)
    quarantine = scratch_path(spark, "crawled-quarantine")
    due = known.where("not already_scraped").count()
    leases.crawl(frontier, pages(spark, sf), page_reader, products, quarantine, batch=due // 3 + 1)
    return frontier.read(spark), products.read(spark), read_changes(spark, quarantine, QUARANTINE)


@query(
    "crawl_pending",
    READ + """SELECT f.url, true AS already_scraped, CAST(CASE WHEN f.already_scraped THEN 0 ELSE 1 END AS BIGINT) AS tries, b.title,
      CASE WHEN b.url IS NOT NULL THEN 'text of ' || b.n END AS description, CAST(b.n AS DOUBLE) AS price
    FROM f LEFT JOIN best b ON b.url = f.url""",
)
def _(spark, sf):
    frontier, products, _ = crawled(spark, sf)
    found = products.select("url", "title", "description", "price")
    return frontier.select("url", "already_scraped", F.col("tries").cast("bigint").alias("tries")).join(found, "url", "left")


@query("crawl_quarantine", READ + "SELECT page_id, url, 'I can''t tell.' AS answer, 'no JSON object' AS error FROM due WHERE n % 5 = 0")
def _(spark, sf):
    return crawled(spark, sf)[2].select("page_id", "url", "answer", "error")


@query(
    "fan_out_ledger",
    RAW + """SELECT run, sink, status, CASE WHEN status = 'done' THEN n - refused ELSE 0 END AS written, refused FROM
      (SELECT count(*) AS n, count(*) FILTER (WHERE description IS NULL) AS missing FROM raw) c,
      (VALUES ('first', 'documents', 'done'), ('first', 'nodes', 'done'), ('first', 'mirror', 'failed'), ('again', 'mirror', 'done')) v(run, sink, status),
      LATERAL (SELECT CASE WHEN sink = 'nodes' THEN missing ELSE 0 END AS refused) r""",
)
def _(spark, sf):
    """Three sinks: one refuses rows without a description, one fails the first time and is resumed."""
    path, ledger_path = scratch_path(spark, "sinks"), scratch_path(spark, "ledger")
    rows = raw(spark, sf).select("id", "url", "title", "description")

    def writer(name, fails=False):
        def write(df):
            if fails:
                raise OSError("out of reach")
            df.write.mode("errorifexists").parquet(f"{path}/{name}")

        return write

    reasons = {"nodes": F.when(F.col("description").isNull(), F.lit("no description"))}
    found = []
    for run, fails in (("first", True), ("again", False)):
        sinks = {"documents": writer("documents"), "nodes": writer("nodes"), "mirror": writer("mirror", fails)}
        before = ledger.outcomes(spark, ledger_path).collect()
        done = ledger.fan_out(rows, sinks, ledger_path, "load", 0, reasons).collect()
        known = {(r["sink"], r["at"]) for r in before}
        found += [(run, r["sink"], r["status"], r["written"], r["refused"]) for r in done if (r["sink"], r["at"]) not in known]
    return spark.createDataFrame(found, "run string, sink string, status string, written long, refused long")


# --- Streams ------------------------------------------------------------------------


def as_stream(spark, df, name: str, files: int = 4) -> str:
    """The rows as several files, so that a stream takes several micro-batches."""
    path = scratch_path(spark, name)
    df.repartition(files, F.xxhash64(df.columns[0])).write.parquet(path)
    return path


@query("stream_frontier", DISCOVERED + "SELECT url, already_scraped FROM fresh UNION ALL SELECT url, already_scraped FROM f")
def _(spark, sf):
    table = scratch_path(spark, "frontier")
    write_changes(d.derive(spark, sf, d.FRONTIER), table, 0)
    stream = stream_pages(spark, as_stream(spark, pages(spark, sf), "pages"), files_per_batch=1)
    st.stream_frontier(stream, table, scratch_path(spark, "frontier-checkpoint"), **LINK_RULE).awaitTermination()
    return st.read_frontier(spark, table).select("url", "already_scraped")


@query(
    "stream_crawl",
    DISCOVERED + """, known AS (SELECT url, already_scraped FROM fresh UNION ALL SELECT url, already_scraped FROM f)
    SELECT url, bool_or(already_scraped) AS already_scraped
    FROM (SELECT * FROM known UNION ALL SELECT url, true FROM pages) k GROUP BY url""",
)
def _(spark, sf):
    """Discovery and extraction over one frontier; both start again with new checkpoints and change nothing."""
    paths = {name: scratch_path(spark, name) for name in ("products", "quarantine", "frontier")}
    write_changes(d.derive(spark, sf, d.FRONTIER), paths["frontier"], 0)
    source, answers = as_stream(spark, pages(spark, sf), "pages"), d.derive(spark, sf, d.ANSWERS)
    for _ in range(2):
        stream = stream_pages(spark, source, files_per_batch=1)
        st.stream_frontier(stream, paths["frontier"], scratch_path(spark, "discover"), **LINK_RULE).awaitTermination()
        stream = stream_pages(spark, source, files_per_batch=1)
        st.stream_upsert_products(stream, answers, paths, scratch_path(spark, "extract")).awaitTermination()
    return st.read_frontier(spark, paths["frontier"]).select("url", "already_scraped")


@query("stream_upsert_products", EXTRACTED + "SELECT * EXCLUDE page_id FROM products")
def _(spark, sf):
    paths = {name: scratch_path(spark, name) for name in ("products", "quarantine", "frontier")}
    stream = stream_pages(spark, as_stream(spark, pages(spark, sf), "pages"), files_per_batch=1)
    st.stream_upsert_products(
        stream, d.derive(spark, sf, d.ANSWERS), paths, scratch_path(spark, "products-checkpoint")
    ).awaitTermination()
    return flat(st.read_products(spark, paths["products"]))


@query("stream_quarantine", EXTRACTED + "SELECT page_id, url, answer, error FROM judged WHERE error IS NOT NULL")
def _(spark, sf):
    paths = {name: scratch_path(spark, name) for name in ("products", "quarantine", "frontier")}
    stream = stream_pages(spark, as_stream(spark, pages(spark, sf), "pages"), files_per_batch=1)
    st.stream_upsert_products(
        stream, d.derive(spark, sf, d.ANSWERS), paths, scratch_path(spark, "products-checkpoint")
    ).awaitTermination()
    return read_changes(spark, paths["quarantine"], st.QUARANTINE).drop("batch_id", "run")


@query(
    "stream_backfill_embeddings",
    f"WITH p AS ({EMBEDDABLE}) SELECT 'doc:' || doc_id AS url, CAST(1536 AS BIGINT) AS dims FROM p "
    "WHERE NOT has_vector AND description IS NOT NULL AND coalesce(product_context, '') <> ''",
)
def _(spark, sf):
    products, encoder = _backfill_input(spark, sf)
    source = as_stream(spark, products, "products")
    stream = spark.readStream.schema(products.schema).option("maxFilesPerTrigger", 1).parquet(source)
    table = scratch_path(spark, "vectors")
    st.stream_backfill_embeddings(stream, encoder, table, scratch_path(spark, "vectors-checkpoint")).awaitTermination()
    return st.read_embeddings(spark, table).select("url", F.size("description_embedding").cast("bigint").alias("dims"))
