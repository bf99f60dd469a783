"""Saved ids by buckets: what a batch opens, merging, replays."""

import os

import pytest
from pyspark.sql import functions as F

from shiftlens.plans.scratch import fresh_path
from shiftlens.sources.logs import LOG_SCHEMA
from shiftlens.streaming import seen_ids
from shiftlens.streaming.flows import log_dedup_batch


def _ids(spark, values):
    return spark.createDataFrame([(x,) for x in values], "query_id string")


def _asked(spark, values, root, batch):
    ids = _ids(spark, values)
    return {r[0] for r in seen_ids.held_ids(ids, root, batch).join(ids, "query_id", "left_semi").collect()}


def test_sets_are_merged_and_found(spark):
    root = fresh_path(spark, "ids")
    for batch in range(20):
        seen_ids.merge_sets(spark, root, batch, "query_id", 3, 40)
        seen_ids.save_ids(_ids(spark, [f"q{batch}-{i}" for i in range(30)]), root, batch, 40)
    sets = seen_ids.live_sets(spark, root)
    assert [(s.tier, s.first, s.last) for s in sets] == [(2, 0, 8), (2, 9, 17), (0, 18, 18), (0, 19, 19)] and sets[0].bits == 3
    assert _asked(spark, ["q0-0", "q7-3", "q19-29", "q19-30", "none", None], root, 99) == {"q0-0", "q7-3", "q19-29"}
    assert _asked(spark, [f"q{b}-5" for b in range(20)] + ["x"], root, 99) == {f"q{b}-5" for b in range(20)}
    assert _asked(spark, ["q19-0", "q18-0"], root, 19) == {"q18-0"}, "its own earlier attempt does not count"


def test_a_batch_opens_its_buckets_only(spark):
    """However many ids are saved, two asked ones open two folders of a set at most."""
    opened = []
    for n in (400, 4000):
        root = fresh_path(spark, "ids")
        seen_ids.save_ids(_ids(spark, [f"q{i}" for i in range(n)]), root, 0, 50)
        files = {f for f in seen_ids.held_ids(_ids(spark, ["q1", "q2"]), root, 1).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
        (kept,) = seen_ids.live_sets(spark, root)
        folders = [f for f in os.listdir(f"{root}/{kept.name}") if f.startswith("bucket=")]
        assert len(files) <= 2 and len(folders) > n / 150
        opened.append(sum(os.path.getsize(f.removeprefix("file://")) for f in files))
    assert opened[1] < 2 * opened[0]


def test_covered_and_unfinished_sets_do_not_count(spark):
    root = fresh_path(spark, "ids")
    for batch in range(3):
        seen_ids.save_ids(_ids(spark, [f"q{batch}"]), root, batch)
    seen_ids._save(_ids(spark, ["q0", "q1"]), root, 1, 0, 1, 10)  # a merge that stopped before the old sets were dropped
    seen_ids._save(_ids(spark, ["never"]), root, 1, 2, 2, 10)
    os.remove(f"{root}/tier1-2-2-bits0/_SUCCESS")
    assert [(s.tier, s.first, s.last) for s in seen_ids.live_sets(spark, root)] == [(1, 0, 1), (0, 2, 2)]


@pytest.mark.parametrize("fan", [2, 8])
def test_log_steps_with_late_and_replayed_batches(spark, fan):
    out = fresh_path(spark, "log")
    step = log_dedup_batch(out, fan, 5)

    def rows(*ids):
        return spark.createDataFrame([(i, f"r-{i}", "q", "a", "U1", "P1", None, 0) for i in ids], LOG_SCHEMA)

    deliveries = [("a", "b", "a"), ("b", "c"), ("d", None), ("a", "e"), ("f",), ("g", "a", "f"), ("h", None)]
    for n, ids in enumerate(deliveries):
        step(rows(*ids), n)
        step(rows(*ids), n)  # the same batch again
    saved = {}
    for r in spark.read.parquet(out).collect():
        saved.setdefault(r.batch, []).append(r.query_id)
    assert {b: sorted(x, key=str) for b, x in saved.items()} == {0: ["a", "b"], 1: ["c"], 2: [None, "d"], 3: ["e"], 4: ["f"], 5: ["g"], 6: [None, "h"]}
