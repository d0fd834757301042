"""Inputs derived from the given tables by SQL that both engines read."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from shelfspark.session import scratch_path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Tables whose rows take much work each.
COSTLY = {"documents", "pages"}

#: One catalog row per part, with the blanks and bad values a raw file has.
PRODUCTS_RAW = """
SELECT p_partkey AS id,
  'https://shop.example.com/cat/' || lower(p_type) || '/p/' || CAST(p_partkey AS STRING) AS url,
  p_name || ' ' || p_brand AS title,
  CASE WHEN p_partkey % 17 = 0 THEN NULL
       ELSE p_type || ' ' || p_name || ' size ' || CAST(p_size AS STRING) END AS description,
  CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN 'n/a'
       ELSE '$' || CAST(CAST(floor(p_retailprice) AS BIGINT) % 1000 AS STRING) || ','
            || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') || '.50' END AS price,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 23 = 0 THEN 'on request'
       ELSE CAST(p_size AS STRING) || '.25' END AS price_without_discount,
  CASE WHEN p_partkey % 5 = 0 THEN '[]' WHEN p_partkey % 7 = 0 THEN ''
       ELSE '["' || p_name || '", "' || p_type || '"]' END AS similar_products,
  p_name AS resumen_producto
FROM part
"""

#: Documents with the three searchable fields: first sentence of the first line,
#: first line, whole text.
DOC_PRODUCTS = """
SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS description,
       split_part(split_part(text, chr(10), 1), '.', 1) AS product_resume,
       CAST(n_chars AS DOUBLE) AS price
FROM documents
"""

#: Every benchmark passage is a query, whole.
QUERIES = "SELECT item_id AS query_id, text AS query FROM benchmark"

#: Catalog searches: every name and every type people may type.
CATALOG_QUERIES = """
SELECT 4 * min(p_partkey) AS query_id, p_name AS query FROM part GROUP BY p_name
UNION ALL SELECT 4 * min(p_partkey) + 1 AS query_id, p_type AS query FROM part GROUP BY p_type
UNION ALL SELECT 4 * min(p_partkey) + 2 AS query_id, p_type || ' ' || p_name AS query FROM part GROUP BY p_type, p_name
"""

#: The searchable catalog: the summary holds type, name and brand.
CATALOG = """
SELECT p_partkey AS id, p_type || ' ' || p_name || ' ' || p_brand AS product_resume FROM part
"""

#: Answers for the pages: plain, wrapped, single-quoted, without key quotes,
#: with a missing key, without an object.
ANSWERS = """
SELECT p_partkey AS page_id,
  CASE WHEN p_partkey % 6 = 0 THEN body
       WHEN p_partkey % 6 = 1 THEN 'Here is the JSON: ' || body || ' done'
       WHEN p_partkey % 6 = 2 THEN replace(body, '"', '''')
       WHEN p_partkey % 6 = 3 THEN replace(replace(body, '{"', '{'), '": ', ': ')
       WHEN p_partkey % 6 = 4 THEN replace(body, '"most_bought"', '"most_seen"')
       ELSE 'no object for ' || p_name END AS answer
FROM (SELECT p_partkey, p_name,
        '{"description": "' || p_type || ' ' || p_name || '", "price_without_discount": "$1,' ||
        lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') || '.00", "price": "' ||
        CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CAST(p_size AS STRING) END ||
        '", "other_members_also_purchased": [], "similar_purchases": ["' || p_name ||
        '"], "most_bought": ["' || p_brand || '", "' || p_type ||
        '"], "recommendations": [], "similar_products": ["' || p_type || '"]}' AS body
      FROM part) b
"""

#: Loose objects in event properties, in five spellings.
EVENT_ANSWERS = """
SELECT event_id,
  CASE WHEN event_id % 5 = 0 THEN props
       WHEN event_id % 5 = 1 THEN 'Here is the JSON: ' || props || ' done'
       WHEN event_id % 5 = 2 THEN replace(props, '"', '''')
       WHEN event_id % 5 = 3 THEN replace(props, '"', '')
       ELSE 'no object' END AS answer
FROM events
"""

#: Known URLs, some of them done.
FRONTIER = """
SELECT url, min(page_id % 3) = 0 AS already_scraped, min(page_id) AS first_seen FROM pages GROUP BY url
"""

#: URLs on their way in: every page again and, under a second host, as news.
ARRIVALS = """
SELECT url, page_id AS first_seen FROM pages
UNION ALL SELECT replace(url, 'example', 'sample') AS url, page_id + 1000000 AS first_seen FROM pages
UNION ALL SELECT replace(url, 'example', 'sample') AS url, page_id + 2000000 AS first_seen FROM pages
"""

#: Many changes per key, the newest by seq wins.
UPDATES = """
SELECT 'https://shop.example.com/u/' || CAST(user_id AS STRING) AS url, event_type AS title,
       value AS price, event_id AS seq
FROM events
"""

#: A table to be updated: one row per customer.
USERS = """
SELECT 'https://shop.example.com/u/' || CAST(c_custkey AS STRING) AS url, c_mktsegment AS title,
       CAST(0 AS DOUBLE) AS price, CAST(-1 AS BIGINT) AS seq
FROM customer
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A local session deals the rows of its small files to all cores; any other reads them as they lie."""
    rows = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    parts = spark.conf.get("spark.shelfspark.scanPartitions", None)
    return rows.repartition(int(parts)) if parts and name in COSTLY else rows


def derive(spark: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
    """Runs the SQL over the given tables (and other frames) without leaving views behind."""
    named = {t: table(spark, sf_dir, t) for t in TABLES if t in sql}
    named.update(frames)
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name, df in named.items():
        sql = _name(sql, name)
    return spark.sql(sql, **named)


def _name(sql: str, name: str) -> str:
    return re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", sql)


_STORED = {}


def once_stored(spark, sf, name, write):
    """What ``write`` stored at a path; the first query of a session that needs it writes it, the others use it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        _STORED[key] = write(scratch_path(spark, name))
    return _STORED[key]
