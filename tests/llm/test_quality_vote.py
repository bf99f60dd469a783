"""Quality votes: held-out accuracy, hidden labels, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shiftlens.llm.fingerprints import words_of
from shiftlens.llm.quality_vote import Model, latent_axes, score_quality, term_counts

SCHEMA = "doc_id bigint, text string, score string"


def test_held_out_accuracy(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_quality(docs, labels).join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    assert len(rows) > 50 and np.mean([r.quality == r.predicted for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_and_other_columns_are_not_inputs(spark):
    rows = [(i, ("good words in a row %d. " % i) * 5 if i % 3 else "BAD!! " * 20, "x") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = [(i, 1 if i % 3 else 0) for i in range(60)]
    out = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(60)]
    changed = [(i, 1 - q if out[i] else q) for i, q in labels]
    schema = "doc_id bigint, quality int"
    one, two = (
        {r.doc_id: (r.held_out, r.score, r.predicted) for r in score_quality(docs, spark.createDataFrame(x, schema)).collect()} for x in (labels, changed)
    )
    assert one == two and [one[i][0] for i in range(60)] == out
    assert all(one[i][2] == (1 if i % 3 else 0) for i in range(60))


def test_nulls_empty_long_and_repeated_rows(spark):
    rows = [(None, "some text", ""), (1, None, ""), (2, "", ""), (3, " \n", ""), (4, "x " * 100_000, ""), (5, "a b", ""), (5, "a b", ""), (6, "A!! B!!", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(5, 1), (5, 1), (6, 0), (None, 1), (4, None), (1, 1), (99, 0)], "doc_id bigint, quality int")
    got = score_quality(docs, labels).collect()
    assert len(got) == 8 and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not (r.text or "").strip()}) == 1
    none = score_quality(docs, labels.where("false")).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert score_quality(docs, spark.createDataFrame([], "doc_id bigint, quality int")).select(F.count("*")).first()[0] == 0


def test_votes_equal_plain_products():
    texts = ["plain words here.", "OTHER!! WORDS!!", "a | b | c", "plain words there.", ""]
    counts = term_counts(words_of(pa.array(texts)))
    weight = np.ones(counts.shape[1], np.float32)
    axes = latent_axes(counts[:4] / np.linalg.norm(counts[:4], axis=1, keepdims=True), 3)
    model = Model(weight, axes, np.zeros((0, 3), np.float32), np.array([1.0, 0, 0, 1]), 0.5)
    model.vectors = model.place(counts[:4])
    got = model.score(counts, neighbours=2)
    for i in range(4):
        near = sorted(((float(model.place(counts)[i] @ v), y) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[:2]
        votes = [max(s, 0) ** 8 for s, _ in near]
        want = (sum(v * y for v, (_, y) in zip(votes, near, strict=True)) + 0.5e-3) / (sum(votes) + 1e-3)
        assert abs(got[i] - want) < 1e-4
    assert got[4] == 0.5
