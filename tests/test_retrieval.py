"""Retrieval against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlens.operators import retrieval as r
from shiftlens.plans.grid import plan_grid, plan_streams
from tests.conftest import plan_of

RNG = random.Random(5)
DIMS = 6


def _vector(i):
    if i % 13 == 0:
        return [0.0] * DIMS
    if i % 17 == 0:
        return []
    if i % 19 == 0:
        return None
    return [float(RNG.randrange(-2, 3)) for _ in range(DIMS)]


STORE = [("hot" if i % 3 else f"s{i % 4}", i, _vector(i)) for i in range(400)] + [("tiny", 1000, [1.0] * DIMS)]
QUERIES = [(f"q{i}", _vector(i + 1)) for i in range(40)]


def _unit(v):
    v = np.array(v if v else [0.0] * DIMS)
    n = np.linalg.norm(v)
    return v / n if n else v


def _brute():
    out = {}
    for q, qv in QUERIES:
        for source, chunk, cv in STORE:
            out.setdefault(q, []).append((-(round(float(_unit(qv) @ _unit(cv)), 6) + 0.0), source, chunk))
    return out


@pytest.fixture()
def frames(spark):
    store = spark.createDataFrame(STORE, "table_name string, chunk_id bigint, embedding array<double>").repartition(5)
    queries = spark.createDataFrame(QUERIES, "query_id string, embedding array<double>").repartition(3)
    return queries, store


@pytest.mark.parametrize("bounds", [{}, {"small_bytes": 0}, {"small_bytes": 0, "task_bytes": 8 * DIMS * 60}])
@pytest.mark.parametrize("k", [1, 3, 120])
def test_topk_equals_brute_force(frames, k, bounds):
    got = {}
    for row in r.topk_per_source(*frames, k=k, **bounds).collect():
        got.setdefault((row.query_id, row.source), []).append((row["rank"], row.chunk_id, row.score))
    for q, scored in _brute().items():
        for source in {s for _, s, _ in scored}:
            best = sorted((s, c) for s, src, c in scored if src == source)[:k]
            assert [(c, s) for _, c, s in sorted(got[q, source])] == [(c, pytest.approx(-s, abs=1e-6)) for s, c in best]


def test_overall_equals_brute_force_without_sources(frames):
    got = {}
    for row in r.retrieve_topk(*frames).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.source, row.chunk_id))
    for q, scored in _brute().items():
        assert [(s, c) for _, s, c in sorted(got[q])] == [(s, c) for _, s, c in sorted(scored)[:3]]


def test_small_tiles_give_the_same(frames, monkeypatch):
    whole = sorted(map(tuple, r.topk_per_source(*frames).collect()))
    units = np.array([_unit(v) for _, v in QUERIES])
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict(
        {"source": [s for s, _, _ in STORE], "chunk_id": [c for _, c, _ in STORE],
         "embedding": pa.array([v for _, _, v in STORE], pa.list_(pa.float64()))}
    )
    monkeypatch.setattr(r, "_TILE", 3 * len(units))

    block = pa.array([q for q, _ in QUERIES]), units
    expected = sorted((w[0], w[1], w[2]) for w in whole)
    rows = [x for out in r._top_k_task(3)(*block, [batch]) for x in out.to_pylist()]
    assert sorted((x["query_id"], x["source"], x["chunk_id"]) for x in rows) == expected
    # Passing part results on early only adds rows that lose later.
    monkeypatch.setattr(r, "_HELD", 100)
    early = [x for out in r._top_k_task(3)(*block, [batch]) for x in out.to_pylist()]
    assert len(early) > len(rows) and set(expected) <= {(x["query_id"], x["source"], x["chunk_id"]) for x in early}


def test_score_summary(frames):
    brute = _brute()
    rows = r.score_summary(*frames).collect()
    assert len(rows) == len(QUERIES) * 6
    for row in rows:
        scores = [-s for s, src, _ in brute[row.query_id] if src == row.source]
        assert row.n_pairs == len(scores)
        assert (row.min_score, row.max_score) == (pytest.approx(min(scores)), pytest.approx(max(scores)))
        assert row.mean_score == pytest.approx(np.mean(scores), abs=2e-6)


def test_no_queries(spark, frames):
    none = spark.createDataFrame([], "query_id string, embedding array<double>")
    assert r.retrieve_topk(none, frames[1]).count() == 0
    assert r.score_summary(none, frames[1]).count() == 0


def test_queries_without_any_vector_score_zero(spark, frames):
    empty = spark.createDataFrame([("q", None), ("p", [])], "query_id string, embedding array<double>")
    rows = r.retrieve_topk(empty, frames[1], 2).collect()
    assert sorted((x.query_id, x.source, x.chunk_id, x.score) for x in rows) == [
        (q, "hot", c, 0.0) for q in "pq" for c in (1, 2)
    ]


def test_infinite_components_score_zero(spark, frames):
    odd = frames[1].unionByName(spark.createDataFrame([("inf", 2000, [float("inf")] + [1.0] * 5)], frames[1].schema))
    rows = r.topk_per_source(frames[0], odd, k=1).where("source = 'inf'").collect()
    assert len(rows) == len(QUERIES) and {x.score for x in rows} == {0.0}


def test_queries_of_another_length_score_zero(spark, frames):
    odd = spark.createDataFrame([("q", [1.0, 2.0])], "query_id string, embedding array<double>")
    for bounds in ({}, {"small_bytes": 0}):
        hits = r.topk_per_source(odd.unionByName(frames[0]), frames[1], **bounds).where("query_id = 'q'").collect()
        assert hits and all(h.score == 0 for h in hits)


def test_plan_has_no_pair_join_and_limits_before_the_shuffle(frames):
    for bounds in ({}, {"small_bytes": 0}):
        plan = plan_of(r.topk_per_source(*frames, **bounds))
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan
    assert plan_of(r.retrieve_fallback(frames[1])).count("WindowGroupLimit") >= 2


def test_fallback(frames):
    rows = r.retrieve_fallback(frames[1], 2).collect()
    assert all(x.score is None for x in rows)
    for source in {s for s, _, _ in STORE}:
        assert sorted(x.chunk_id for x in rows if x.source == source) == sorted(c for s, c, _ in STORE if s == source)[:2]


def test_queries_without_vector_fall_back(frames):
    queries, store = frames
    rows = r.retrieve_contexts(queries, store, 2).collect()
    without = {q for q, v in QUERIES if not v}
    scored = {x.query_id for x in rows if x.score is not None}
    assert without and scored == {q for q, _ in QUERIES} - without
    first = {}
    for x in sorted(rows, key=lambda x: x["rank"]):
        if x.query_id in without:
            first.setdefault(x.query_id, []).append((x.source, x.chunk_id))
    expected = [
        (s, c) for s in sorted({s for s, _, _ in STORE}) for c in sorted(c for t, c, _ in STORE if t == s)[:2]
    ]
    assert all(first[q] == expected for q in without)
    plan = plan_of(r.retrieve_contexts(queries, store, 2))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_context_and_routing(spark):
    hits = spark.createDataFrame(
        [("q", "b", 1, 0.5, 2), ("q", "a", 7, 0.9, 1)], "query_id string, source string, chunk_id bigint, score double, rank int"
    )
    store = spark.createDataFrame([("a", 7, "seven"), ("b", 1, "one"), ("b", 7, "no")], "table_name string, chunk_id bigint, chunk_text string")
    assert r.context_text(r.with_chunk_text(hits, store)).first().context == "From a: seven\nFrom b: one"
    best = spark.createDataFrame(
        [("x", "a", 0.9), ("x", "b", 0.1), ("y", "a", 0.2), ("y", "b", 0.1)], "query_id string, source string, score double"
    )
    routed = {(x.query_id, x.source) for x in r.route_tables(best, 0.5).collect()}
    assert routed == {("x", "a"), ("y", "a"), ("y", "b")}


def test_float_vectors_and_integer_ids(spark, folder):
    from shiftlens.catalog import views as v

    hits = r.retrieve_topk(v.vector_queries(spark, folder), v.vector_store(spark, folder)).where(F.col("rank") == 1)
    assert hits.where(F.col("query_id") != F.col("chunk_id")).count() == 0


def test_odd_vectors_score_zero_and_are_listed(spark):
    """One vector of another length, or of huge or tiny numbers, doesn't disturb the others."""
    rows = [("t", 1, [1e200, 0.0]), ("t", 2, [1e-200, 1e-200]), ("t", 3, [1.0, 2.0, 3.0]), ("t", 4, [float("nan"), 1.0]), ("t", 5, None), ("t", 6, []),
            ("t", 7, [0.0, 0.0]), ("t", 8, [-1.0, 0.0]), ("t", 9, [None, 1.0])]
    store = spark.createDataFrame(rows, "table_name string, chunk_id bigint, embedding array<double>")
    queries = spark.createDataFrame([("a", [2e250, 0.0]), ("b", [1.0, 1.0]), ("long", [1.0, 1.0, 1.0])], "query_id string, embedding array<double>")
    for bounds in ({}, {"small_bytes": 0}):
        got = {(x.query_id, x.chunk_id): x.score for x in r.topk_per_source(queries, store, k=20, **bounds).collect()}
        assert got["a", 1] == 1.0 and got["b", 2] == 1.0 and got["a", 8] == -1.0 and got["b", 1] == 0.707107
        assert all(got["b", i] == 0.0 for i in (3, 4, 5, 6, 7, 9)) and all(got["long", i] == 0.0 for i in range(1, 10))
    faults = {x.chunk_id: (x.n_dims, x.fault) for x in r.vector_faults(store, 2, "chunk_id").collect()}
    assert faults == {3: (3, "length"), 4: (2, "not finite"), 5: (None, "missing"), 6: (0, "empty"), 7: (2, "zero"), 9: (2, "not finite")}


def test_grid_shuffles_least():
    """No grid that fits in a task's memory shuffles fewer bytes, and the flat lanes of old shuffle more."""
    for left, right, task in ((10, 10_000, 64), (5_000, 5_000, 64), (1_000_000, 3_000_000, 4_000), (64, 1, 128), (1, 1, 64)):
        grid = plan_grid(left, right, task)
        assert grid.task_bytes <= task
        fitting = [(left * c + right * b) for b in range(1, 1200) for c in [-(-right // max(1e-9, task - left / b))] if task > left / b]
        assert grid.shuffled_bytes <= min(fitting) * 1.01 + 1
    assert plan_grid(1 << 40, 1 << 45).shuffled_bytes < (1 << 40) * ((1 << 45) // (20_000 * 512)) + (1 << 45) * ((1 << 40) >> 25)
    assert plan_grid(100, 100, least_tasks=8).lanes == 8


def test_grid_of_real_sides(frames):
    queries, store = frames
    grid, dims = r.vector_grid(queries, store, task_bytes=8 * DIMS * 30)
    assert dims == DIMS and (grid.left_bytes, grid.right_bytes) == (40 * 8 * DIMS, 401 * 8 * DIMS)
    assert grid.blocks > 1 and grid.shuffled_bytes == grid.left_bytes * grid.lanes + grid.right_bytes * grid.blocks


def test_small_batches_do_not_shuffle_the_store(frames):
    small = plan_of(r.topk_per_source(*frames))
    assert "MapInArrow" in small and "CoGroups" not in small and "CoGroups" in plan_of(r.topk_per_source(*frames, small_bytes=0))


def test_blocks_and_lanes_are_not_merged_by_their_bytes(frames):
    """Few bytes of many pairs are still spread: as many partitions as blocks meet lanes."""
    queries, store = frames
    room = 8 * DIMS * 60
    rows = store.select(F.col("table_name").alias("source"), "chunk_id", "embedding")
    grid = r.vector_grid(queries.select("query_id", "embedding"), rows, room)[0]
    schema = T.StructType.fromDDL("query_id string, source string, chunk_id bigint, score double")
    found = r._per_block(queries, store, r._top_k_task(3), schema, room, 0)
    assert grid.blocks * grid.lanes > 8 and found.rdd.getNumPartitions() == grid.blocks * grid.lanes


def test_a_batch_is_taken_in_slices():
    """A task's memory does not follow the batch: one of 20 MB of vectors is scored in half as much again."""
    import tracemalloc

    import pyarrow as pa

    rng, n, dims = np.random.default_rng(1), 10_000, 256
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(rng.random(n * dims)))
    batch = pa.RecordBatch.from_pydict({"source": ["s"] * n, "chunk_id": np.arange(n), "embedding": vectors})
    units = r.unit_rows(vectors.slice(0, 64), dims)
    tracemalloc.start()
    found = [x for out in r._top_k_task(3)(pa.array(np.arange(64)), units, [batch]) for x in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 192 and peak < 32e6


@pytest.mark.parametrize("dims,decimals", [(3, 0), (64, 3)])
def test_screened_rows_are_those_of_all_scores(dims, decimals):
    """Single precision only screens: many ties, zero vectors and rows out of order of id give what full scores give."""
    rng = np.random.default_rng(dims)
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    rows, units = unit(np.round(rng.normal(size=(3000, dims)), decimals)), unit(np.round(rng.normal(size=(90, dims)), decimals))
    units[7] = 0
    ids, best = rng.permutation(3000), r.BestRows(units, units.astype(np.float32), 4)
    for part in np.array_split(np.arange(3000), 11):
        part = part[np.argsort(ids[part])]
        best.add(ids[part], rows[part])
    order = np.argsort(ids)
    scores, want = r._best(ids[order], rows[order] @ units.T, 4)
    assert (best.scores == scores).all() and (best.ids == want).all()


def test_vectors_are_scaled_a_few_at_a_time():
    """Beside the result, scaling holds copies of a few vectors only, whatever their number."""
    import tracemalloc

    import pyarrow as pa

    n, dims = 2_048, 256
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(np.random.default_rng(2).random(n * dims)))
    tracemalloc.start()
    units = r.unit_rows(vectors, dims)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(np.linalg.norm(units, axis=1), 1) and peak < units.nbytes + 4e6


def test_the_store_is_in_no_shuffle(frames):
    """What lies on disk follows the bytes of both sides, not their product: no exchange has a stored vector."""
    plan = plan_of(r.topk_per_source(*frames, small_bytes=0, task_bytes=8 * DIMS * 60))
    shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)
    assert any("embedding" in columns for columns in shuffled)
    assert not any("chunk_id" in columns and ("embedding" in columns or "unit" in columns) for columns in shuffled)


def test_a_query_has_few_part_results(frames):
    """A block meets the whole store in one task, so its best rows are not passed on once for each part that fits in memory."""
    schema = T.StructType.fromDDL("query_id string, source string, chunk_id bigint, score double")
    for room in (8 * DIMS * 30, 8 * DIMS * 8):
        found = r._per_block(*frames, r._top_k_task(3), schema, room, 0, 3)
        best = r.topk_per_source(*frames, k=3).count()
        assert best <= found.count() <= 2 * best


def test_streams_hold_a_block_and_have_few_lanes():
    for left, right, task, cores in ((1 << 20, 1 << 30, 64 << 20, 24), (250 << 20, 1 << 30, 64 << 20, 24), (3 << 30, 5 << 30, 64 << 20, 36), (1, 1, 64, 8), (1 << 40, 1 << 40, 64 << 20, 8)):
        grid = plan_streams(left, right, task, cores)
        assert left / grid.blocks <= task / 4 and cores <= grid.blocks * grid.lanes < max(2 * cores, grid.blocks + 1)
        assert left * grid.lanes <= max(left, 2 * cores * max(task / 16, left / cores))
    assert plan_streams(3 << 30, 5 << 30, 64 << 20, 36).lanes == 1


@pytest.mark.parametrize("lanes", [1, 3, 7, 50])
def test_lanes_are_ranges_of_the_saved_rows(tmp_path, lanes):
    """Each saved row is in one lane, whatever the files' and row groups' sizes."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    counts, every = [], 0
    for n in (37, 1, 120, 0, 64):
        path, ids = str(tmp_path / f"some part {n}.parquet"), np.arange(every, every + n)
        units = np.stack([ids, -ids], axis=1).astype(float).reshape(n, 2)
        pq.write_table(pa.table([["s"] * n, ids, r._packed(units)], schema=pa.schema([("source", pa.string()), ("chunk_id", pa.int64()), ("unit", pa.binary())])), path, row_group_size=25)
        counts.append(((tmp_path / f"some part {n}.parquet").as_uri(), n))
        every += n
    seen = []
    for lane in range(lanes):
        places = [dict(zip(("path", "low", "high"), p[1:], strict=True)) for p in r._lane_places(counts, lanes) if p[0] == lane]
        got = [b for b in r._stored(pa.Table.from_pylist(places), 2)] if places else []
        ids = [i for b in got for i in b.column("chunk_id").to_pylist()]
        assert abs(len(ids) - every / lanes) <= 1
        for b in got:
            values = b.column("chunk_id").to_numpy()
            assert (r._unpacked(b.column("unit"), 2) == np.stack([values, -values], axis=1)).all()
        seen += ids
    assert seen == list(range(every))


def test_many_sources_pass_part_results_on(spark, monkeypatch):
    """A task that holds too much passes results on before the end, and the ranking is that of all rows."""
    rng = np.random.default_rng(11)
    rows = [(f"s{i % 40}", i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(600)]
    asked = [(f"q{i}", [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(25)]
    store = spark.createDataFrame(rows, "table_name string, chunk_id bigint, embedding array<double>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id string, embedding array<double>")
    whole = sorted(map(tuple, r.topk_per_source(queries, store, 2).collect()))
    monkeypatch.setattr(r, "_HELD", 100)
    assert sorted(map(tuple, r.topk_per_source(queries, store, 2, small_bytes=0).collect())) == whole and len(whole) == 25 * 40 * 2


def test_score_summary_of_blocks(frames):
    few = {(x.query_id, x.source): x for x in r.score_summary(*frames).collect()}
    blocks = r.score_summary(*frames, small_bytes=0, task_bytes=8 * DIMS * 60).collect()
    assert len(blocks) == len(few)
    for x in blocks:
        y = few[x.query_id, x.source]
        assert (x.n_pairs, x.min_score, x.max_score) == (y.n_pairs, y.min_score, y.max_score) and x.mean_score == pytest.approx(y.mean_score, abs=2e-6)


def test_no_stored_rows(spark, frames):
    none = spark.createDataFrame([], frames[1].schema)
    assert r.topk_per_source(frames[0], none, small_bytes=0).count() == 0
    assert r.score_summary(frames[0], none, small_bytes=0).count() == 0


def test_blocks_of_queries_without_any_vector(spark, frames):
    empty = spark.createDataFrame([("q", None), ("p", [])], "query_id string, embedding array<double>")
    rows = r.retrieve_topk(empty, frames[1], 2, small_bytes=0).collect()
    assert sorted((x.query_id, x.source, x.chunk_id, x.score) for x in rows) == [(q, "hot", c, 0.0) for q in "pq" for c in (1, 2)]


def test_missing_ids_rank_the_same_in_any_split(spark):
    rng = np.random.default_rng(13)
    rows = [(f"t{i % 3}", None if i % 9 == 7 else i, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(600)]
    queries = spark.createDataFrame([(f"q{i}", [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(60)], "query_id string, embedding array<double>")
    found = []
    for files, bounds in ((2, {}), (7, {}), (2, {"small_bytes": 0}), (7, {"small_bytes": 0, "task_bytes": 24 * 40})):
        store = spark.createDataFrame(rows, "table_name string, chunk_id bigint, embedding array<double>").repartition(files, "embedding")
        found.append(sorted(map(tuple, r.topk_per_source(queries, store, 2, **bounds).collect())))
    assert all(f == found[0] for f in found) and len(found[0]) == 60 * 3 * 2
