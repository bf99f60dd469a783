"""Every stage of the pipeline on its own input, against plain code."""

import corpus_pipeline
import pytest

from shiftlens.llm.quality_vote import score_quality
from shiftlens.plans.scratch import written
from tests.llm.test_randomness import base
from tests.llm.test_signature_join import plain as plain_join
from tests.llm.test_winnowing import plain as plain_winnow


@pytest.fixture(scope="module")
def steps(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], folder), "stage"))
    return out


def _texts(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1]) and set(steps[0].columns) < set(steps[-1].columns)


def test_quality(spark, folder, steps):
    scored = score_quality(steps[0], spark.read.parquet(f"{folder}/labels.parquet"))
    assert set(_texts(steps[1])) == {(r.doc_id, r.text) for r in scored.collect() if r.score >= 0.3}
    assert steps[1].count() >= 0.7 * steps[0].count()


def test_near_duplicates(steps):
    rows = _texts(steps[1])
    kept = {i for i, _, component in plain_join(rows) if i == component}
    assert sorted(_texts(steps[2])) == sorted((i, t) for i, t in rows if i in kept)


def test_decontamination(spark, folder, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = _texts(steps[2])
    clean = {r[0] for r in plain_winnow(rows, items) if not r[5]}
    assert sorted(_texts(steps[3])) == sorted((i, t) for i, t in rows if i in clean) and len(clean) < len(rows)


def test_secrets(steps):
    after = dict(_texts(steps[4]))
    before = dict(_texts(steps[3]))
    assert set(after) == set(before)
    assert not any(base(t) for t in after.values()) and any(base(t) for t in before.values())
    assert all(after[i] == t for i, t in before.items() if not base(t) and "[secret]" not in after[i])


def test_mixture(steps):
    known = dict(_texts(steps[4]))
    rows = steps[5].collect()
    assert rows and all(known[r.doc_id] == r.text and 0 < r.probability <= 1 for r in rows)


def test_run_is_the_stages(spark, folder, steps):
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, steps[-1].collect()))


def test_odd_rows(spark, folder, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    rows = [(None, "plain words in a row", None, None, None), (None, item, "en", "s", 1), (1, None, "en", None, None), (2, "", None, "s", 0), (3, "x " * 50_000, "en", "s", 1)]
    rows += [(4, "some plain words here", "en", "s", 1)] * 2
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, folder), "stage")
        assert docs.count() <= len(data)
        assert item not in [r.text for r in docs.collect()]
