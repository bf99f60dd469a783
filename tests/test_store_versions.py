"""The store by table and hash prefix: look-ups, compaction, time travel."""

import datetime as dt

from pyspark.sql import functions as F

from shiftlens.operators import embedding
from shiftlens.plans.scratch import fresh_path, written
from shiftlens.sources import file_versions as fv
from shiftlens.sources import store_versions as sv
from tests.conftest import plan_of

NOW = dt.datetime(2025, 6, 1)


def _chunks(spark, texts, table="a b=c"):
    rows = [(table if i % 4 else "other", i, "data", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "table_name string, chunk_id bigint, kind string, chunk_text string").withColumn("content_hash", F.sha2("chunk_text", 256))


def _embed(calls):
    def embed(chunks):
        calls.append(chunks.count())
        return embedding.embed_hashed(chunks, dims=8)

    return embed


def test_only_missing_contents_are_embedded(spark):
    root, calls = fresh_path(spark, "store"), []
    texts = [f"text {i % 30}" for i in range(40)]
    first = sv.refresh_version(_chunks(spark, texts), root, _embed(calls), NOW)
    assert first.count() == 40 and calls == [sv.read_store_version(spark, root).count()]
    again = sv.refresh_version(_chunks(spark, texts), root, _embed(calls), NOW)
    assert len(calls) == 1 and sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect())) and fv.versions(spark, root) == [0]
    changed = ["changed"] + texts[1:]
    now = sv.refresh_version(_chunks(spark, changed), root, _embed(calls), NOW)
    assert calls[1:] == [1] and {r.chunk_id: r.chunk_text for r in now.collect()} == dict(enumerate(changed))


def test_compaction_keeps_each_content_once_and_leaves_folders_alone(spark):
    root = fresh_path(spark, "store")
    for n in range(3):
        sv.append_rows(embedding.embed_hashed(_chunks(spark, [f"text {i}" for i in range(n * 20, n * 20 + 50)]), dims=8).withColumns({"record_id": F.lit("r"), "created_at": F.lit(dt.datetime(2025, 1, 1 + n))}), root)
    before = sv.read_store_version(spark, root)
    contents = {tuple(r) for r in before.select("table_name", "content_hash").collect()}
    sv.compact_store(spark, root, 10)
    after = sv.read_store_version(spark, root)
    assert before.count() == 150 and after.count() == len(contents) and {tuple(r) for r in after.select("table_name", "content_hash").collect()} == contents
    files = fv.files_of(spark, root)
    assert len({f.split("/hash=")[1].split("/")[0] for f in files}) > 8 and not any("hash=new" in f for f in files)
    assert after.where(F.col("chunk_text") == "text 45").agg(F.min("created_at")).first()[0] == dt.datetime(2025, 1, 1)
    sv.refresh_version(_chunks(spark, ["one more", "and another"]), root, _embed([]), NOW)
    sv.compact_store(spark, root, 10)
    assert set(files) < set(fv.files_of(spark, root)), "a compaction rewrites the new files only"
    assert sv.read_store_version(spark, root, 2).count() == 150


def test_look_ups_open_their_folders_and_key_columns_only(spark):
    root = fresh_path(spark, "store")
    sv.refresh_version(_chunks(spark, [f"text {i}" for i in range(400)]), root, _embed([]), NOW)
    sv.compact_store(spark, root, 20)
    files = fv.files_of(spark, root)
    asked = written(_chunks(spark, ["nothing", "text 5", "text 6", "new text"]).where("chunk_id > 0"), "asked")
    held = sv.held_contents(asked, root)
    opened = {f.rsplit("/", 1)[1] for f in held.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert len(files) > 25 and len(opened) <= 6
    plan = plan_of(held)
    assert "ReadSchema: struct<content_hash:string>" in plan and "embedding" not in plan.split("ReadSchema")[1].split("\n")[0]
    hit = asked.join(held, ["table_name", "content_hash"], "left_semi")
    assert sorted(r.chunk_text for r in hit.collect()) == ["text 5", "text 6"]


def test_many_new_files_are_compacted_by_a_refresh(spark):
    root = fresh_path(spark, "store")
    for n in range(4):
        sv.refresh_version(_chunks(spark, [f"text {n}-{i}" for i in range(6)]), root, _embed([]), NOW, new_files=5)
    assert any("hash=p" in f for f in fv.files_of(spark, root)) and sv.read_store_version(spark, root).count() == 24


def test_empty_chunks(spark):
    root = fresh_path(spark, "store")
    assert sv.refresh_version(_chunks(spark, []), root, _embed([]), NOW).count() == 0
    assert sv.refresh_version(_chunks(spark, ["x"]), root, _embed([]), NOW).count() == 1
