import json
import time
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfspark.functions.answers import with_parsed_answer, with_product_columns
from shelfspark.operators import keyed_writes as kw
from shelfspark.operators import metrics
from shelfspark.operators.models import ModelEncoder, TextEncoder, _Patient
from shelfspark.operators.rows import split_bad_rows
from shelfspark.plans import catalog as cat
from shelfspark.plans import leases
from shelfspark.schema import EXTRACTED, FRONTIER, LIST_FIELDS, PRODUCT, QUARANTINE, RAW_CATALOG
from shelfspark.session import scratch_path
from shelfspark.sources import ledger
from shelfspark.sources import tables as tb
from shelfspark.sources.catalog_csv import scan_catalog_csv, write_catalog_csv
from shelfspark.sources.keyed_tables import KeyedTable
from shelfspark.sources.text_dump import append_text_dump
from shelfspark.streaming import jobs as st


def test_upsert_last_wins_and_is_idempotent(spark):
    target = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "url string, v int, seq int")
    hot = [("b", i, i) for i in range(500)] + [("c", 9, 1)]
    once = kw.upsert(target, spark.createDataFrame(hot, target.schema), "url", ["seq"])
    twice = kw.upsert(once, spark.createDataFrame(hot, target.schema), "url", ["seq"])
    want = [("a", 1, 0), ("b", 499, 499), ("c", 9, 1)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))


def test_put_reports_created_and_updated(spark):
    target = spark.createDataFrame([(1, "x")], "id int, v string")
    table, outcome = kw.put_by_id(target, spark.createDataFrame([(1, "y"), (2, "z")], target.schema), "id", ["v"])
    assert sorted(map(tuple, outcome.collect())) == [(1, "updated"), (2, "created")]
    assert sorted(map(tuple, table.collect())) == [(1, "y"), (2, "z")]


def test_frontier_never_repeats_a_url(spark):
    known = spark.createDataFrame([("a", True, 1)], "url string, already_scraped boolean, first_seen long")
    new = spark.createDataFrame([("a", False, 5), ("b", False, 7), ("b", False, 6)], known.schema)
    out = kw.insert_if_absent(new, known, "url", ["first_seen"])
    assert sorted(map(tuple, out.collect())) == [("a", True, 1), ("b", False, 6)]
    assert sorted(map(tuple, kw.mark_done(out, new.select("url")).collect())) == [("a", True, 1), ("b", True, 6)]


def test_partial_update_keeps_other_columns_and_reports_misses(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "url string, n int, c string")
    change = spark.createDataFrame([("a", None), ("q", "new")], "url string, c string")
    out, missed = kw.partial_update(target, change, "url", ["c"], ["c"])
    assert sorted(map(tuple, out.collect())) == [("a", 1, None), ("b", 2, "y")]
    assert [r["url"] for r in missed.collect()] == ["q"]


def test_csv_round_trip_with_line_breaks_and_quotes(spark):
    row = ("u", 'say "hi", ok', "two\nlines", "1", "", "[a, b]", None, "[]", "x", "y", "short")
    df = spark.createDataFrame([row], RAW_CATALOG)
    path = scratch_path(spark, "csv")
    write_catalog_csv(df, path)
    got = tuple(scan_catalog_csv(spark, path).first())
    assert got == tuple(v or None for v in row)


def test_row_ids_do_not_follow_the_packing_of_files(spark):
    path = scratch_path(spark, "files")
    for n, rows in (("a", 3), ("b", 30), ("c", 12)):
        spark.range(rows).selectExpr(f"concat('{n}', id) AS v").coalesce(1).write.mode("append").csv(path)
    found = []
    for size in ("1", "134217728"):
        spark.conf.set("spark.sql.files.openCostInBytes", size)
        spark.conf.set("spark.sql.files.minPartitionNum", "1" if size != "1" else "50")
        found.append({r["v"]: r["n"] for r in cat.with_row_id(spark.read.schema("v string").option("multiLine", True).csv(path), "n").collect()})
    spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.conf.unset("spark.sql.files.minPartitionNum")
    assert found[0] == found[1] and len(set(found[0].values())) == 45


def test_a_failed_backfill_is_recorded(spark):
    products = spark.createDataFrame([("u", "d", "some words", None)], "url string, description string, product_context string, description_embedding array<float>")
    encoder = TextEncoder.fit(products, "product_context", dims=8)
    good = cat.backfill_embeddings(products, encoder, scratch_path(spark, "embedded")).first()
    assert (good["processed_count"], good["error"]) == (1, None)
    broken = products.withColumn("url", F.when(F.raise_error(F.lit("gone")).isNull(), F.col("url")))
    assert "gone" in cat.backfill_embeddings(broken, encoder, scratch_path(spark, "embedded")).first()["error"]


def test_load_catalog_refuses_bad_prices_and_merges_urls(spark):
    def row(url, price):
        return (url, "t", "d", "", price, "", "", "", "", "", "r")

    path = scratch_path(spark, "csv")
    write_catalog_csv(spark.createDataFrame([row("a", "1"), row("a", "2"), row("b", "oops")], RAW_CATALOG).coalesce(1), path)
    loaded = cat.load_catalog(spark, path)
    assert loaded.documents.count() == 2  # both rows of a: documents are keyed by row number
    assert [(r["url"], r["price"]) for r in loaded.nodes.collect()] == [("a", 2.0)]
    assert [r["error"] for r in loaded.refused.collect()] == ["bad price: oops"]
    assert {r["outcome"] for r in loaded.outcomes.collect()} == {"created"}


@pytest.mark.parametrize("multi_line", [True, False])
def test_malformed_rows_are_kept_aside(spark, tmp_path, multi_line):
    header = ",".join(RAW_CATALOG.names)
    good = "u{},t,d,1,2,,,,,,r"
    extra = good.format(2) + ",more,cells"
    (tmp_path / "a.csv").write_text("\n".join([header, good.format(1), "short,row", extra, good.format(3)]) + "\n")
    assert {r["url"] for r in scan_catalog_csv(spark, str(tmp_path), RAW_CATALOG, multi_line).collect()} == {"u1", "u3"}
    refused = {r["malformed_row"] for r in cat.refused_rows(spark, str(tmp_path)).collect()}
    assert refused == {"short,row", extra}
    loaded = cat.load_catalog(spark, str(tmp_path))
    assert {(r["malformed_row"], r["error"]) for r in loaded.refused.collect()} == {("short,row", "malformed row"), (extra, "malformed row")}
    assert {r["url"] for r in loaded.nodes.collect()} == {"u1", "u3"}
    assert "malformed_row" not in loaded.nodes.columns + loaded.documents.columns


def test_backfill_with_nothing_pending(spark):
    empty = spark.createDataFrame([], PRODUCT)
    done = spark.createDataFrame([{"url": "a", "product_context": "some words", "description_embedding": [1.0]}, {"url": "b", "product_context": ""}], PRODUCT)
    encoder = TextEncoder.fit(done, "product_context")
    for products, rows in ((empty, 0), (done, 2)):
        path = scratch_path(spark, "embedded")
        run = cat.backfill_embeddings(products, encoder, path).first()
        assert (run["processed_count"], run["error"]) == (0, None)
        assert spark.read.parquet(path).count() == rows


def bucket_files(path):
    return {str(f.relative_to(path)) for f in Path(path).rglob("part-*.parquet")}


def test_merges_leave_other_buckets_alone(spark):
    path = scratch_path(spark, "keyed")
    rows = [(f"u{i}", i, "old") for i in range(300)]
    schema = "url string, v int, note string"
    table = KeyedTable.create(spark.createDataFrame(rows, schema), path, "url", 16)
    before = bucket_files(path)
    # One key many times, and one new key.
    hot = [("u7", i, "new") for i in range(200)] + [("brand-new", 1, "new")]
    merged = table.upsert(spark.createDataFrame(hot, schema), ["v"])
    after = bucket_files(path)
    assert 1 <= len(merged.buckets) <= 2
    touched = {f"key_bucket={b}" for b in merged.buckets}
    assert {f for f in before ^ after if f.split("/")[0] not in touched} == set() and before - after
    want = {u: (v, n) for u, v, n in rows} | {"u7": (199, "new"), "brand-new": (1, "new")}
    assert {r["url"]: (r["v"], r["note"]) for r in table.read(spark).collect()} == want and table.read(spark).count() == 301

    changed = table.update(spark.createDataFrame([("u9", "x"), ("nobody", "x")], "url string, note string"), ["note"], ["note"])
    assert [r["url"] for r in changed.unmatched.collect()] == ["nobody"] and len(changed.buckets) == 1
    assert {r["url"]: (r["v"], r["note"]) for r in table.read(spark).collect()} == want | {"u9": (9, "x")}
    none = table.update(spark.createDataFrame([("nobody", "x")], "url string, note string"), ["note"], ["note"])
    kept_files = bucket_files(path)
    assert none.buckets == [] and table.upsert(table.read(spark).limit(0), ["v"]).buckets == [] and bucket_files(path) == kept_files


def test_model_encoder_fills_vectors_and_leaves_failures_pending(spark):
    def factory():
        seen = []

        def model(texts):
            seen.append(texts)
            if len(seen) == 1:
                raise OSError("busy")  # the first call of a worker fails and is repeated
            if any("bad" in t for t in texts):
                raise ValueError("unreadable")
            return [[float(len(t)), 1.0] for t in texts]

        return model

    rows = [{"url": f"u{i}", "description": "d", "product_context": "bad text" if i == 3 else "x" * (i + 1)} for i in range(8)] + [{"url": "none"}]
    products = spark.createDataFrame(rows, PRODUCT).coalesce(1)
    path = scratch_path(spark, "by-model")
    run = cat.backfill_embeddings(products, ModelEncoder(factory, batch_size=3, retries=1, wait=0.01), path).first()
    got = {r["url"]: r["description_embedding"] for r in spark.read.parquet(path).collect()}
    assert got == {f"u{i}": None if i == 3 else [i + 1.0, 1.0] for i in range(8)} | {"none": None}
    assert (run["processed_count"], run["error"]) == (7, None)


def test_a_crashed_lease_is_taken_again_and_given_up_in_the_end(spark):
    known = spark.createDataFrame([(f"u{i}", i == 0, i) for i in range(6)], FRONTIER)
    frontier = leases.open_frontier(known, scratch_path(spark, "frontier"), 4)
    first = {r["url"] for r in leases.take(frontier, spark, 2, now=0.0, seconds=10.0).collect()}
    assert first == {"u1", "u2"}  # oldest first; u0 is done
    assert {r["url"] for r in leases.take(frontier, spark, 9, now=5.0, seconds=10.0).collect()} == {"u3", "u4", "u5"}
    assert leases.take(frontier, spark, 9, now=9.0, seconds=10.0).isEmpty()  # all are leased
    leases.settle(frontier, spark.createDataFrame([("u3",), ("u4",), ("u5",)], "url string"))
    again = leases.take(frontier, spark, 9, now=10.0, seconds=10.0).collect()  # the first job died
    assert {(r["url"], r["tries"]) for r in again} == {("u1", 2), ("u2", 2)}
    leases.take(frontier, spark, 9, now=20.0, seconds=10.0)
    assert leases.take(frontier, spark, 9, now=30.0, seconds=10.0).isEmpty()
    assert {r["url"] for r in leases.given_up(frontier, spark, 30.0).collect()} == {"u1", "u2"}


def test_crawl_runs_from_pending_urls_to_products(spark):
    def reader():
        body = json.dumps({c: [] for c in LIST_FIELDS} | {"description": "d", "price": "3", "price_without_discount": ""})
        return lambda prompts: ["nothing" if "EMPTY" in p else body for p in prompts]

    known = spark.createDataFrame([(f"http://s/p/{i}", i == 0, i) for i in range(6)], FRONTIER)
    pages = spark.createDataFrame([(i, f"http://s/p/{i}", f"<title>T{i}</title><p>{'EMPTY' if i == 3 else 'text'}</p>") for i in range(5)], "page_id long, url string, html string")
    frontier = leases.open_frontier(known, scratch_path(spark, "frontier"), 4)
    products = KeyedTable.create(spark.createDataFrame([], EXTRACTED), scratch_path(spark, "products"), "url", 4)
    quarantine = scratch_path(spark, "quarantine")
    assert leases.crawl(frontier, pages, reader, products, quarantine, batch=2) == 3
    assert {(r["url"], r["title"], r["price"]) for r in products.read(spark).collect()} == {(f"http://s/p/{i}", f"T{i}", 3.0) for i in (1, 2, 4)}
    failed = {(r["url"], r["error"]) for r in tb.read_changes(spark, quarantine, QUARANTINE).collect()}
    assert failed == {("http://s/p/3", "no JSON object"), ("http://s/p/5", "no page")}
    assert all(r["already_scraped"] for r in frontier.read(spark).collect())


def test_a_failing_sink_is_resumed(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    path, book = scratch_path(spark, "sinks"), scratch_path(spark, "ledger")
    broken = [True]

    def flaky(df):
        if broken.pop() if broken else False:
            raise OSError("away")
        df.write.parquet(f"{path}/flaky")

    sinks = {"flaky": flaky, "steady": lambda df: df.write.parquet(f"{path}/steady")}
    refuse = {"steady": F.when(F.col("t").isNull(), F.lit("no text"))}
    state = lambda df: {r["sink"]: (r["status"], r["written"], r["refused"]) for r in df.collect()}
    assert state(ledger.fan_out(rows, sinks, book, "r", 1, refuse)) == {"flaky": ("failed", 0, 0), "steady": ("done", 1, 1)}
    # `steady` would raise if it were written again.
    assert state(ledger.fan_out(rows, sinks, book, "r", 1, refuse)) == {"flaky": ("done", 2, 0), "steady": ("done", 1, 1)}
    assert [(r["sink"], json.loads(r["row"]), r["error"]) for r in ledger.refused(spark, book).collect()] == [("steady", {"id": 2}, "no text")]
    assert spark.read.parquet(f"{path}/flaky").count() == 2


def test_streams_leave_run_records(spark):
    source = scratch_path(spark, "source")
    spark.range(10).write.parquet(source)
    runs = ledger.StreamRuns()
    spark.streams.addListener(runs)
    try:
        stream = spark.readStream.schema("id long").parquet(source)
        good = stream.writeStream.queryName("copy").option("checkpointLocation", scratch_path(spark, "c")).foreachBatch(lambda df, i: df.count())
        good.trigger(availableNow=True).start().awaitTermination()

        def fail(df, i):
            raise RuntimeError("sink is gone")

        bad = stream.writeStream.queryName("broken").option("checkpointLocation", scratch_path(spark, "c")).foreachBatch(fail).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="sink is gone"):
            bad.awaitTermination()
        for _ in range(100):
            if len(runs.ended) == 2:
                break
            time.sleep(0.1)
        got = {r["job"]: r for r in runs.records(spark).collect()}
        assert got["copy"]["processed_count"] == 10 and got["copy"]["error"] is None and "sink is gone" in got["broken"]["error"]
    finally:
        spark.streams.removeListener(runs)


def test_texts_a_second_are_held(spark):
    model = _Patient(lambda texts: texts, 0, 0.0, 100.0)
    start = time.monotonic()
    for _ in range(4):
        model(["a"] * 10)
    assert time.monotonic() - start >= 0.28
    with pytest.raises(ValueError):
        _Patient(lambda texts: [], 0, 0.0, None)(["a"])


def test_bulk_load_counts(spark):
    df = spark.createDataFrame([(1, None), (2, "bad"), (3, None)], "id int, error string")
    path = scratch_path(spark, "bulk")
    assert metrics.bulk_load(df, path) == {"rows_read": 3, "succeeded": 2, "failed": 1}
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 3]


def test_change_table_replay_and_compaction(spark):
    path, folded = scratch_path(spark, "changes"), scratch_path(spark, "folded")
    df = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    assert tb.read_current(spark, path, df.schema, "k", []).count() == 0
    tb.write_changes(df, path, 0)
    for _ in range(2):
        tb.write_changes(spark.createDataFrame([("b", 2)], df.schema), path, 1)
    want = [("a", 1), ("b", 2)]
    assert sorted(map(tuple, tb.read_current(spark, path, df.schema, "k", []).collect())) == want
    tb.compact(spark, path, folded, df.schema, "k", [])
    assert sorted(map(tuple, tb.read_changes(spark, folded, df.schema).drop("batch_id", "run").collect())) == want


def test_text_dump_appends_per_site(spark):
    path = scratch_path(spark, "dump")
    for n in (1, 2):
        append_text_dump(spark.createDataFrame([(f"https://www.s.com/{n}", f"body {n}")], "url string, content string"), path)
    text = "".join(sorted(r["value"] for r in spark.read.text(f"{path}/site=s.com", wholetext=True).collect()))
    assert text == "".join(f"\n\nURL: https://www.s.com/{n}\nContent:\nbody {n}\n{'-' * 80}\n" for n in (1, 2))


def test_quarantine_reasons(spark):
    df = spark.createDataFrame([(1, "no"), (2, "{a:::}"), (3, '{"description": "d"}')], "i int, answer string")
    bad = split_bad_rows(with_parsed_answer(df))[1].orderBy("i").collect()
    assert [r["error"].split()[0] for r in bad] == ["no", "unreadable", "missing"]
    keys = ["description", "price_without_discount", "price", "similar_purchases", "most_bought", "recommendations", "similar_products", "other_members_also_purchased"]
    answer = "{" + ", ".join(f"'{k}': " + ("['x']" if i > 2 else "'$1,000'") for i, k in enumerate(keys)) + "}"
    good = with_product_columns(with_parsed_answer(spark.createDataFrame([(answer,)], "answer string"))).first()
    assert (good["price"], good["description"], good["most_bought"]) == (1000.0, "$1,000", ["x"])


def test_refresh_context_and_backfill(spark):
    schema = "url string, title string, description string, product_context string, context_updated_at timestamp, description_embedding array<float>"
    products = spark.createDataFrame([("a", "t", "d", "", None, None), ("b", "t2", None, "", None, None)], schema)
    at = datetime(2024, 1, 2, 3, 4)
    fresh = cat.refresh_context(products, at)
    assert all(r["context_updated_at"] == at and r["title"] in r["product_context"] for r in fresh.collect())
    encoder = TextEncoder.fit(fresh, "product_context", dims=64)
    path, model = scratch_path(spark, "embedded"), scratch_path(spark, "idf")
    encoder.save(model)
    run = cat.backfill_embeddings(fresh, TextEncoder.load(model), path).first()
    assert (run["processed_count"], run["error"]) == (1, None)
    stored = {r["url"]: r["description_embedding"] for r in spark.read.parquet(path).collect()}
    assert len(stored["a"]) == 64 and stored["b"] is None
    again = cat.refresh_context(spark.read.parquet(path), at, invalidate_embedding=True)
    assert again.where(F.col("description_embedding").isNotNull()).count() == 0


def test_a_batch_of_one_file_is_encoded_by_all_cores(spark):
    """Each task that had rows writes a file of vectors; none is lost or made twice."""
    rows = [(f"u{i}", f"text of number {i}", None) for i in range(400)]
    schema = "url string, product_context string, description_embedding array<float>"
    source, table = scratch_path(spark, "one-file"), scratch_path(spark, "vectors")
    products = spark.createDataFrame(rows, schema).withColumn("description", F.col("product_context"))
    # One row group in a file that is cut into several ranges of bytes: one task gets all rows.
    products.coalesce(1).write.option("compression", "none").parquet(source)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    encoder = TextEncoder.fit(products, "product_context", dims=16)
    stream = spark.readStream.schema(products.schema).option("maxFilesPerTrigger", 1).parquet(source)
    try:
        st.stream_backfill_embeddings(stream, encoder, table, scratch_path(spark, "checkpoint")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = spark.read.parquet(table)
    assert sorted(r["url"] for r in found.collect()) == sorted(r[0] for r in rows)
    assert found.select(F.input_file_name()).distinct().count() >= spark.sparkContext.defaultParallelism
