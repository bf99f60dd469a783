"""The embedding store, JSON exchange and the logs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from shiftlens.operators import embedding, profiling, relationships, retrieval
from shiftlens.plans.scratch import fresh_path
from shiftlens.sources import logs, snapshots, store, tables
from tests.conftest import plan_of

NOW = dt.datetime(2025, 6, 1)


@pytest.fixture()
def chunks(spark):
    rows = [("a", i, "data", f"Data chunk:\nrow {i % 3}\n", f"h{i % 3}") for i in range(6)]
    rows += [("b", 0, "schema", 'quote " tab\t é line\n', "hb")]
    return spark.createDataFrame(rows, "table_name string, chunk_id bigint, kind string, chunk_text string, content_hash string")


@pytest.fixture()
def saved(spark, chunks):
    path = fresh_path(spark, "store")
    store.append_store(store.store_rows(embedding.embed_hashed(chunks, dims=8), NOW), path)
    return path


def test_second_build_adds_nothing(spark, chunks, saved):
    held = store.read_store(spark, saved)
    assert held.count() == 7
    assert store.missing_chunks(chunks, held).count() == 0
    kept = store.without_tables(held, ["a"])
    again = store.missing_chunks(chunks, kept)
    assert again.count() == 6 and {r.table_name for r in again.collect()} == {"a"}


def test_refresh_stores_only_what_changed(spark):
    from shiftlens.operators.chunking import table_chunks

    def chunks(change):
        rows = spark.range(20).select("id", F.when(F.col("id") == 7, change).otherwise(F.col("id")).alias("x"))
        return table_chunks(rows, "t", ["id"])

    calls = []

    def embed(df):
        calls.append(df.count())
        return embedding.embed_hashed(df, dims=8)

    path = fresh_path(spark, "store")
    first = store.refresh_store(chunks(7), path, embed, NOW)
    assert first.count() == 4 + 1 + 2
    assert store.refresh_store(chunks(7), path, embed, NOW).count() == 7
    changed = store.refresh_store(chunks(70), path, embed, NOW)
    assert calls == [7, 0, 2]
    valid = store.without_stale(changed, chunks(70))
    assert valid.count() == 7 and valid.select("record_id").distinct().count() == 7
    assert valid.columns == changed.columns


def test_table_filter_prunes_partitions(spark, saved):
    plan = plan_of(store.read_store(spark, saved).where("table_name = 'a'"))
    assert "PartitionFilters: [isnotnull(table_name" in plan
    plan = plan_of(store.without_tables(store.read_store(spark, saved), ["a"]))
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_json_round_trip(spark, saved):
    held = store.read_store(spark, saved)
    encoded = store.encode_json(held)
    for r in encoded.join(held.select("record_id", "chunk_text"), "record_id").collect():
        assert json.loads(r.chunk_json) == r.chunk_text
        assert len(json.loads(r.embedding_json)) == 8
    back = store.decode_json(encoded).join(held.select("record_id", F.col("chunk_text").alias("t"), F.col("embedding").alias("e")), "record_id")
    assert back.where("chunk_text <> t OR embedding <> e").count() == 0 and back.count() == 7


def test_json_decode_of_missing_values(spark):
    df = spark.createDataFrame([("1", "t", None, None)], "record_id string, table_name string, chunk_json string, embedding_json string")
    row = store.decode_json(df).first()
    assert row.chunk_text == "" and row.embedding == []


def test_pairing_keeps_failures_visible(spark, chunks, saved):
    vectors = store.read_store(spark, saved).where("chunk_id <> 2").select("table_name", "content_hash", "chunk_id", "embedding")
    paired = store.pair_vectors(chunks, vectors)
    assert sorted(r.chunk_id for r in paired.where("table_name = 'a'").collect()) == [0, 1, 3, 4, 5]


def test_stats_and_samples(spark, saved):
    held = store.read_store(spark, saved)
    stats = store.embedding_stats(held).first()
    assert (stats.num_chunks, stats.num_embeddings, stats.dimensions) == (7, 7, 8) and stats.avg_magnitude == 1.0
    assert {r.chunk_kind: r.n_chunks for r in store.chunk_kind_counts(held).collect()} == {"Data chunk:": 6, 'quote " tab\t é line': 1}
    assert [r.chunk_id for r in store.chunk_samples(held, 2, 300).collect()] == [0, 1]
    assert store.vector_samples(held, 1, 5).first().n_more == 3
    estimate = spark.createDataFrame([("t", [0.0] * 1536)] * 214, "table_name string, embedding array<double>")
    assert store.memory_estimate(estimate).first().size_mb == pytest.approx(1.25, abs=0.01)


def test_completeness(spark, saved):
    held = store.read_store(spark, saved)
    assert store.store_complete(store.table_list(spark, ["a", "b"]), held).first().complete
    assert not store.store_complete(store.table_list(spark, ["a", "c"]), held).first().complete


def test_embed_batches_of_fifty_and_failures(spark):
    df = spark.range(230).select("id", F.concat(F.lit("t"), "id").alias("chunk_text")).coalesce(1)

    def embed(texts):
        assert len(texts) <= 50
        if "t60" in texts:
            raise RuntimeError("no service")
        return [[float(len(texts))] for _ in texts][: 10 if "t110" in texts else None]

    embedded = embedding.embed_batches(df, embed)
    rows = embedded.collect()
    assert len(rows) == 230 and [r.id for r in rows if r.embedding is None] == [60]
    assert {r.error: r.n_chunks for r in embedding.embedding_errors(embedded).collect()} == {"RuntimeError: no service": 1}
    chunks = embedded.withColumns({c: F.lit("x") for c in ("table_name", "kind", "content_hash")}).withColumnRenamed("id", "chunk_id")
    assert store.store_rows(chunks, dt.datetime(2025, 1, 1)).count() == 229


def test_bad_answers_stand_alone():
    good = [1.0, 0.0]
    odd = {"none": None, "nan": [float("nan"), 1.0], "short": [1.0], "words": ["a", "b"], "number": 3}

    def embed(texts):
        if "raises" in texts:
            raise ValueError("bad text")
        if "silent" in texts:
            return None
        return [odd.get(t, good) for t in texts]

    texts = [f"t{i}" for i in range(40)] + ["raises", "silent", *odd, "last"]
    found = dict(zip(texts, embedding.embedded_texts(embed, texts), strict=True))
    assert {t: reason for t, (vector, reason) in found.items() if vector is None} == {
        "raises": "ValueError: bad text", "silent": "no answer", "none": "no vector", "nan": "a component is not finite",
        "short": "1 components, not 2", "words": "not a vector of numbers", "number": "not a vector of numbers",
    }
    assert all(found[t] == (good, None) for t in texts if t.startswith("t") or t == "last")
    assert embedding.embedded_texts(lambda x: [[1.0]], ["a"], dims=2) == [(None, "1 components, not 2")]


def test_an_outage_is_not_asked_for_every_text():
    calls = []

    def embed(texts):
        calls.append(len(texts))
        raise ConnectionError("down")

    found = embedding.embedded_texts(embed, ["x"] * 50)
    assert {reason for _, reason in found} == {"ConnectionError: down"} and len(found) == 50 and len(calls) < 20


def test_columns_by_the_names_of_the_result_are_replaced(spark):
    df = spark.createDataFrame([(1, "a", 5, "old"), (2, None, 6, "older")], "id int, chunk_text string, embedding int, error string")
    rows = embedding.embed_batches(df, lambda texts: [[1.0] if t else None for t in texts]).orderBy("id").collect()
    assert [(r.id, r.embedding, r.error) for r in rows] == [(1, [1.0], None), (2, None, "no vector")]


def test_refresh_after_a_change_returns_each_chunk_once(spark):
    path = fresh_path(spark, "store")

    def chunks(texts):
        rows = [("a", i, "data", t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "table_name string, chunk_id bigint, kind string, chunk_text string")
        return df.withColumn("content_hash", F.sha2("chunk_text", 256))

    embed = lambda d: embedding.embed_hashed(d, dims=8)
    store.refresh_store(chunks(["one", "two", "two"]), path, embed, dt.datetime(2025, 1, 1))
    now = store.refresh_store(chunks(["one", "changed", "two"]), path, embed, dt.datetime(2025, 1, 2))
    assert sorted((r.chunk_id, r.chunk_text) for r in now.collect()) == [(0, "one"), (1, "changed"), (2, "two")]
    hits = retrieval.retrieve_topk(embedding.embed_hashed(spark.createDataFrame([(1, "two changed")], "query_id int, t string"), "t", 8), now)
    assert retrieval.with_chunk_text(hits, now).count() == 3


def test_snapshots(spark):
    root = fresh_path(spark, "versions")
    assert snapshots.current_path(spark, root) is None
    snapshots.write_snapshot(spark.range(5), root)
    old = snapshots.read_snapshot(spark, root)
    snapshots.write_snapshot(old.where("id > 2"), root)
    assert old.count() == 5 and snapshots.read_snapshot(spark, root).count() == 2
    snapshots.drop_old_versions(spark, root)
    assert snapshots.read_snapshot(spark, root).count() == 2


def test_sparse_cosine_equals_dense(spark, folder):
    from shiftlens.catalog import views as v
    from shiftlens.functions import vectors as vc

    log = v.query_log(spark, folder)
    a, b = (embedding.sparse_weights(log, ["query_id"], c) for c in ("query_text", "response_text"))
    sparse = {r.query_id: r.score for r in embedding.cosine_sparse(a, b, ["query_id"]).collect()}
    dense = log.select("query_id", vc.cosine(vc.hashed_vector(F.col("query_text")), vc.hashed_vector(F.col("response_text"))).alias("s"))
    for r in dense.collect():
        assert sparse.get(r.query_id, 0.0) == pytest.approx(r.s, abs=1e-6)


LOG_ROWS = [
    ("q1", "r1", "one", "x", "U1", "P1", dt.datetime(2025, 5, 1)),
    ("q2", "r2", "two", "x", "U1", "P2", dt.datetime(2025, 5, 2)),
    ("q3", "r3", "one", "x", "U2", "P1", dt.datetime(2025, 5, 3)),
    ("q4", "r4", "one", "x", None, "P1", dt.datetime(2025, 5, 3)),
    ("q5", "r5", "one", "x", "U1", None, dt.datetime(2025, 5, 3)),
]
LOG_FIELDS = "query_id string, response_id string, query_text string, response_text string, user_code string, plant_code string, created_at timestamp_ntz"


def test_query_log(spark):
    path = fresh_path(spark, "log")
    rows = spark.createDataFrame(LOG_ROWS, LOG_FIELDS)
    logs.append_log(rows.limit(3), path)
    logs.append_log(rows.where("query_id > 'q3'"), path)
    log = logs.read_log(spark, path)
    mine = logs.scan_user(log, "U1")
    assert [r.query_id for r in mine.collect()] == ["q5", "q2", "q1"]
    assert "PartitionFilters: [isnotnull(user_bucket" in plan_of(mine)
    kept = logs.without_user_plant(log, "U1", "P1")
    assert sorted(r.query_id for r in kept.collect()) == ["q2", "q3", "q4", "q5"]


def test_token_log(spark):
    path = fresh_path(spark, "tokens")
    counts = spark.createDataFrame([(dt.datetime(2025, 5, 2, 4, 16, 35), 39, 8, 43)], "created_at timestamp_ntz, nlp_tokens int, table_tokens int, viz_tokens int")
    logs.append_tokens(logs.token_rows(counts), path)
    assert tuple(logs.read_tokens(spark, path).first()) == ("2025-05-02 04:16:35", 39, 8, 43, 90)


def test_json_and_csv_export(spark):
    df = spark.createDataFrame([(2, 'say "hi", ok', 1.5), (1, None, None)], "k int, s string, x double")
    back = tables.from_json_records(tables.json_records(df), df.schema).drop("record")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert tables.csv_preview(df, ["k"], 10).first()[0] == 'k,s,x\n1,,\n2,"say ""hi"", ok",1.5\n'
    assert tables.csv_preview(df.limit(0), ["k"], 10).first()[0] == "k,s,x\n"


def test_scan_sample_is_a_bounded_top_n(spark):
    sample = tables.scan_sample(spark.range(5000).select(F.col("id").alias("k")), ["k"], 1000)
    assert [r.k for r in sample.collect()] == list(range(1000))
    assert "TakeOrderedAndProject" in plan_of(sample)


def test_known_rows_need_no_python_worker(spark):
    """What the driver knows of a store, its tables and their columns is part of the plan."""
    rows = [(1, float("nan"), None, [{"k": "a"}]), (None, float("inf"), "b", []), (-(2**62), -0.0, "", None)]
    schema = "i bigint, d double, s string, l array<struct<k:string>>"
    plain = spark.createDataFrame(rows, schema)
    known = tables.known_rows(spark, rows, schema)
    assert known.schema == plain.schema and [str(x) for x in known.collect()] == [str(x) for x in plain.collect()]
    facts = profiling.numeric_facts(spark.range(5).selectExpr("id", "id / 3 AS third", "CAST(NULL AS int) AS none"))
    declared = {"a": relationships.TableInfo("", (), (relationships.Relationship("b", (("k", "l"),)),))}
    for frame in (
        known, profiling.stats_frame(spark, facts), store.store_or_empty(spark, fresh_path(spark, "none")),
        store.table_list(spark, ["a"]), relationships.relationship_rows(spark, declared),
    ):
        assert "LocalTableScan" in plan_of(frame) and "ExistingRDD" not in plan_of(frame)
