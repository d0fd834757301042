"""Every registered query against its SQL check at the smallest scale, and the streams' replays."""

import pytest
from check import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfspark.plans.crawl import discover_urls
from shelfspark.session import scratch_path
from shelfspark.sources.pages import stream_pages
from shelfspark.streaming import jobs as st
from shelfspark.suite import derive as d
from shelfspark.suite.jobs import LINK_RULE, as_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, sql) == ""


def test_checks_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_restarted_stream_equals_batch(spark):
    pages = d.table(spark, SF, "pages")
    source, table, checkpoint = as_stream(spark, pages, "pages", 3), scratch_path(spark, "frontier"), scratch_path(spark, "cp")
    for _ in range(2):
        st.stream_frontier(stream_pages(spark, source, 1), table, checkpoint, **LINK_RULE).awaitTermination()
    empty = spark.createDataFrame([], "url string, already_scraped boolean, first_seen long")
    got = st.read_frontier(spark, table).select("url")
    want = discover_urls(pages, empty, **LINK_RULE).select("url")
    assert got.count() == want.count() == got.distinct().count()
    assert got.join(want, "url", "left_anti").isEmpty()
    assert got.where(F.col("url").isNull()).isEmpty()
