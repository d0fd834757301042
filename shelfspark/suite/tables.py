"""Sources, sinks, keyed writes and the joins behind them."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from shelfspark.operators import keyed_writes as kw
from shelfspark.operators import metrics
from shelfspark.operators.models import summarize_title
from shelfspark.operators.rows import stamp_updated_at
from shelfspark.plans.catalog import load_catalog, load_errors
from shelfspark.session import scratch_path
from shelfspark.sources import tables as tb
from shelfspark.sources.keyed_tables import KeyedTable
from shelfspark.sources.catalog_csv import scan_catalog_csv, write_catalog_csv
from shelfspark.sources.pages import scan_pages, with_content
from shelfspark.sources.text_dump import append_text_dump
from shelfspark.suite import derive as d
from shelfspark.suite import sqltext as q
from shelfspark.suite.registry import query
from shelfspark.suite.scalars import RAW, raw, with_empty_lists
from shelfspark.schema import RAW_CATALOG

CSV_COLUMNS = RAW_CATALOG.names


def csv_source(spark, sf) -> str:
    """The derived catalog as a file."""
    path = scratch_path(spark, "catalog-csv")
    write_catalog_csv(with_empty_lists(raw(spark, sf)).select(*CSV_COLUMNS), path)
    return path


CSV_ROWS = (
    "SELECT url, title, nullif(description, '') AS description, nullif(price_without_discount, '') AS price_without_discount, "
    "nullif(price, '') AS price, nullif(similar_products, '') AS similar_products, resumen_producto FROM raw"
)


@query("scan_catalog_csv", RAW + CSV_ROWS)
def _(spark, sf):
    return scan_catalog_csv(spark, csv_source(spark, sf)).select(
        "url", "title", "description", "price_without_discount", "price", "similar_products", "resumen_producto"
    )


#: Lines of a catalog file, some of them with too few or too many cells.
CSV_LINES = """
SELECT p_partkey AS n, 'https://shop.example.com/p/' || CAST(p_partkey AS STRING) || ',' || p_name
  || CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 10 = 1 THEN ',,1,2,,,,,,r,more,cells' ELSE ',,1,2,,,,,,r' END AS value FROM part
"""


def uneven_source(spark, sf) -> str:
    path = scratch_path(spark, "uneven-csv")
    header = spark.createDataFrame([(-1, ",".join(CSV_COLUMNS))], "n long, value string")
    header.unionByName(d.derive(spark, sf, CSV_LINES)).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
    return path


@query("quarantine_csv_rows", f"SELECT value AS malformed_row, 'malformed row' AS error FROM ({CSV_LINES}) x WHERE n % 10 < 2")
def _(spark, sf):
    return load_catalog(spark, uneven_source(spark, sf)).refused.select("malformed_row", "error")


@query(
    "scan_uneven_csv",
    f"SELECT split_part(value, ',', 1) AS url, split_part(value, ',', 2) AS title FROM ({CSV_LINES}) x WHERE n % 10 >= 2",
)
def _(spark, sf):
    return scan_catalog_csv(spark, uneven_source(spark, sf)).select("url", "title")


@query(
    "write_catalog_csv",
    RAW + r"SELECT url, title, title AS resumen_producto FROM raw",
)
def _(spark, sf):
    path = scratch_path(spark, "summaries-csv")
    source = scan_catalog_csv(spark, csv_source(spark, sf))
    write_catalog_csv(source.withColumn("resumen_producto", summarize_title(F.col("title"))), path)
    return scan_catalog_csv(spark, path).select("url", "title", "resumen_producto")


UPDATED = f"""
WITH target AS ({d.USERS}), updates AS ({d.UPDATES}),
newest AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq DESC) AS n FROM updates) u WHERE n = 1)
"""


def users(spark, sf):
    return d.derive(spark, sf, d.USERS)


def updates(spark, sf):
    return d.derive(spark, sf, d.UPDATES)


@query(
    "upsert_by_url",
    UPDATED + "SELECT * FROM newest UNION ALL SELECT * FROM target WHERE url NOT IN (SELECT url FROM newest)",
)
def _(spark, sf):
    return kw.upsert(users(spark, sf), updates(spark, sf), "url", ["seq"])


def users_by_bucket(spark, sf):
    return KeyedTable.create(users(spark, sf), scratch_path(spark, "users"), "url", 16)


@query(
    "merge_by_bucket",
    UPDATED + "SELECT * FROM newest UNION ALL SELECT * FROM target WHERE url NOT IN (SELECT url FROM newest)",
)
def _(spark, sf):
    table = users_by_bucket(spark, sf)
    table.upsert(updates(spark, sf), ["seq"])
    return table.read(spark)


@query(
    "update_by_bucket",
    UPDATED + """SELECT t.url, coalesce(n.title, t.title) AS title, CASE WHEN n.url IS NULL THEN t.price ELSE n.price END AS price, t.seq,
      (SELECT count(*) FROM newest WHERE url NOT IN (SELECT url FROM target)) AS unmatched FROM target t LEFT JOIN newest n ON n.url = t.url""",
)
def _(spark, sf):
    table = users_by_bucket(spark, sf)
    merged = table.update(updates(spark, sf), ["title", "price"], ["seq"])
    return table.read(spark).withColumn("unmatched", F.lit(merged.unmatched.count()).cast("bigint"))


@query(
    "put_by_id",
    UPDATED + "SELECT url, CASE WHEN url IN (SELECT url FROM target) THEN 'updated' ELSE 'created' END AS outcome FROM newest",
)
def _(spark, sf):
    return kw.put_by_id(users(spark, sf), updates(spark, sf), "url", ["seq"])[1]


@query(
    "put_by_id_rows",
    UPDATED + "SELECT * FROM newest UNION ALL SELECT * FROM target WHERE url NOT IN (SELECT url FROM newest)",
)
def _(spark, sf):
    return kw.put_by_id(users(spark, sf), updates(spark, sf), "url", ["seq"])[0]


ARRIVED = f"""
WITH f AS ({d.FRONTIER}), a AS ({d.ARRIVALS}),
fresh AS (SELECT url, false AS already_scraped, min(first_seen) AS first_seen FROM a WHERE url NOT IN (SELECT url FROM f) GROUP BY url)
"""


def frontier(spark, sf):
    return d.derive(spark, sf, d.FRONTIER)


def arrivals(spark, sf):
    return d.derive(spark, sf, d.ARRIVALS).withColumn("already_scraped", F.lit(False))


@query("insert_if_absent", ARRIVED + "SELECT * FROM f UNION ALL SELECT * FROM fresh")
def _(spark, sf):
    return kw.insert_if_absent(arrivals(spark, sf), frontier(spark, sf), "url", ["first_seen"])


@query("frontier_anti_join", ARRIVED + "SELECT * FROM fresh")
def _(spark, sf):
    return kw.absent_rows(arrivals(spark, sf), frontier(spark, sf), "url", ["first_seen"]).select(
        "url", "already_scraped", "first_seen"
    )


@query("url_exists", ARRIVED + "SELECT url, first_seen, url IN (SELECT url FROM f) AS found FROM a")
def _(spark, sf):
    return kw.key_exists(arrivals(spark, sf).select("url", "first_seen"), frontier(spark, sf), "url")


@query(
    "mark_done",
    f"""WITH f AS ({d.FRONTIER}), a AS ({d.ARRIVALS}), done AS (SELECT DISTINCT url FROM a WHERE url LIKE '%.com/%')
    SELECT f.url, f.already_scraped OR done.url IS NOT NULL AS already_scraped, first_seen FROM f LEFT JOIN done ON done.url = f.url""",
)
def _(spark, sf):
    return kw.mark_done(frontier(spark, sf), arrivals(spark, sf).where("url LIKE '%.com/%'"))


@query(
    "update_join",
    UPDATED + """SELECT t.url, CASE WHEN n.url IS NULL THEN t.title ELSE n.title END AS title,
      CASE WHEN n.url IS NULL THEN t.price ELSE n.price END AS price, t.seq FROM target t LEFT JOIN newest n ON n.url = t.url""",
)
def _(spark, sf):
    return kw.partial_update(users(spark, sf), updates(spark, sf), "url", ["title", "price"], ["seq"])[0]


@query(
    "partial_update",
    RAW + """SELECT id, url, CASE WHEN description IS NULL THEN '' ELSE title || ': ' || description END AS product_context,
      CASE WHEN description IS NOT NULL THEN '2024-05-01 12:30:00' END AS context_updated_at FROM raw""",
)
def _(spark, sf):
    products = raw(spark, sf).select(
        "id", "url", F.lit("").alias("product_context"), F.lit(None).cast("timestamp").alias("context_updated_at")
    )
    made = raw(spark, sf).where("description IS NOT NULL").select(
        "url", F.concat("title", F.lit(": "), "description").alias("product_context")
    )
    changes = stamp_updated_at(made, datetime(2024, 5, 1, 12, 30))
    out, _ = kw.partial_update(products, changes, "url", ["product_context", "context_updated_at"], ["context_updated_at"])
    return out.withColumn("context_updated_at", F.col("context_updated_at").cast("string"))


@query(
    "bulk_load",
    RAW + f"""SELECT count(*) AS rows_read, count(*) FILTER (WHERE NOT bad) AS succeeded, count(*) FILTER (WHERE bad) AS failed,
      count(*) FILTER (WHERE NOT bad) AS stored
    FROM (SELECT coalesce({q.strip('price_without_discount')} <> '' AND {q.number('price_without_discount')} IS NULL, false) AS bad FROM raw) x""",
)
def _(spark, sf):
    path = scratch_path(spark, "bulk")
    source = scan_catalog_csv(spark, csv_source(spark, sf)).withColumn("price", F.lit("0"))
    counts = metrics.bulk_load(load_errors(source), path)
    return spark.read.parquet(path).agg(F.count("*").alias("stored")).select(
        *[F.lit(counts[c]).alias(c) for c in ("rows_read", "succeeded", "failed")], "stored"
    )


@query(
    "text_dump_by_site",
    f"""WITH p AS (SELECT replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), 'www.', '') AS site,
      chr(10) || chr(10) || 'URL: ' || url || chr(10) || 'Content:' || chr(10) || {q.visible_text('html')} || chr(10) || repeat('-', 80) AS value FROM pages)
    SELECT site, CAST(sum(length(value) - length(replace(value, chr(10), '')) + 1) AS BIGINT) AS lines,
      CAST(sum(length(replace(value, chr(10), ''))) AS BIGINT) AS chars FROM p GROUP BY site""",
)
def _(spark, sf):
    path = scratch_path(spark, "dump")
    append_text_dump(with_content(scan_pages(spark, f"{sf}/pages.parquet")), path)
    stored = spark.read.text(path, lineSep="\n")
    return stored.groupBy("site").agg(F.count("*").alias("lines"), F.sum(F.length("value")).alias("chars"))


@query(
    "text_dump_lines",
    f"""SELECT replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), 'www.', '') AS site, unnest(string_split(
      chr(10) || chr(10) || 'URL: ' || url || chr(10) || 'Content:' || chr(10) || {q.visible_text('html')} || chr(10) || repeat('-', 80), chr(10))) AS value
    FROM pages""",
)
def _(spark, sf):
    path = scratch_path(spark, "dump")
    append_text_dump(with_content(scan_pages(spark, f"{sf}/pages.parquet")), path)
    return spark.read.text(path, lineSep="\n").select("site", "value")


@query(
    "fan_out_write",
    RAW + """SELECT 'nodes' AS store, id, url, title, description FROM raw
    UNION ALL SELECT 'documents' AS store, id, url, title, description FROM raw""",
)
def _(spark, sf):
    paths = {s: scratch_path(spark, s) for s in ("documents", "nodes")}
    out = raw(spark, sf).select("id", "url", "title", "description")
    tb.fan_out_write(out, paths, {"documents": "json"})
    documents = spark.read.schema(out.schema).json(paths["documents"]).withColumn("store", F.lit("documents"))
    return documents.unionByName(spark.read.parquet(paths["nodes"]).withColumn("store", F.lit("nodes")))


@query(
    "table_lifecycle",
    """SELECT true AS created, false AS created_again, true AS existed, count(*) AS stored, true AS dropped, false AS exists_after
    FROM part""",
)
def _(spark, sf):
    name = f"shelf_{uuid.uuid4().hex}"
    parts = d.table(spark, sf, "part")
    path = scratch_path(spark, "table")
    created = tb.create_table_if_absent(spark, name, parts.schema, path=path)
    created_again = tb.create_table_if_absent(spark, name, parts.schema, path=path)
    existed = tb.table_exists(spark, name)
    parts.write.insertInto(name)
    dropped = tb.drop_table(spark, name)
    flags = {
        "created": created,
        "created_again": created_again,
        "existed": existed,
        "dropped": dropped,
        "exists_after": tb.table_exists(spark, name),
    }
    stored = spark.read.parquet(path).agg(F.count("*").alias("stored"))
    return stored.select("stored", *[F.lit(v).alias(k) for k, v in flags.items()])


