"""Streams against their batch operators."""

import datetime as dt

from pyspark.sql import functions as F

from shiftlens.catalog import views as v
from shiftlens.operators import embedding, usage
from shiftlens.plans.scratch import fresh_path
from shiftlens.sources import logs, store
from shiftlens.streaming import flows


def test_daily_totals_over_several_batches(spark, folder):
    path = fresh_path(spark, "tokens")
    lines = logs.token_rows(v.token_counts(spark, folder)).persist()
    logs.append_tokens(lines.repartition(5), path)
    got = sorted(map(tuple, flows.run_token_daily(spark, path).collect()))
    batch = usage.daily_totals(lines).select("day", "n_turns", "total_tokens", "max_tokens")
    assert got == sorted(map(tuple, batch.collect()))


def test_late_lines_and_deliveries_are_kept(spark):
    """Three micro-batches, the last with rows that are 19 days late."""
    def line(day, n):
        return (f"2025-05-{day:02d} 02:00:00", n, 0, 0, n)

    path, batches = fresh_path(spark, "tokens"), ([line(1, 1)], [line(20, 2)], [line(1, 100), line(20, 5)])
    for rows in batches:
        logs.append_tokens(spark.createDataFrame(rows, logs.TOKEN_SCHEMA).coalesce(1), path)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        got = {r.day: (r.n_turns, r.total_tokens, r.max_tokens) for r in flows.run_token_daily(spark, path, files_per_batch=1).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == {"2025-05-01": (2, 101, 100), "2025-05-20": (2, 7, 5)}

    path = fresh_path(spark, "deliveries")
    for ids, day in ((["q1"], 1), (["q2"], 20), (["q3", "q1", "q3"], 1)):
        rows = [(i, "r", "t", "x", "U", "P", dt.datetime(2025, 5, day), 0) for i in ids]
        spark.createDataFrame(rows, logs.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    assert sorted(r.query_id for r in flows.run_log_dedup(spark, path, files_per_batch=1).collect()) == ["q1", "q2", "q3"]


def test_each_query_id_once(spark, folder):
    path = fresh_path(spark, "deliveries")
    rows = v.query_log(spark, folder).select(*logs.LOG_COLUMNS, F.lit(0).alias("user_bucket"))
    for _ in range(3):
        rows.write.mode("append").parquet(path)
    once = flows.run_log_dedup(spark, path)
    assert once.count() == rows.count() == once.select("query_id").distinct().count()


def test_replayed_rows_add_nothing_to_the_store(spark, folder):
    docs = v.document_chunks(spark, folder).select(
        "table_name", "chunk_id", F.lit("data").alias("kind"), "chunk_text", F.sha2("chunk_text", 256).alias("content_hash")
    )
    source, path = fresh_path(spark, "arriving"), fresh_path(spark, "store")
    docs.write.parquet(source)
    now = dt.datetime(2025, 6, 1)

    def run():
        stream = spark.readStream.schema(docs.schema).parquet(source)
        return flows.run_store_missing(stream, path, lambda d: embedding.embed_hashed(d, dims=8), now)

    distinct = docs.select("table_name", "content_hash").distinct().count()
    assert run().count() == distinct
    docs.write.mode("append").parquet(source)
    assert run().count() == distinct
    held = store.read_store(spark, path)
    assert store.missing_chunks(docs, held).count() == 0
