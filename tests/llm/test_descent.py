"""Nearest neighbours: exact on small tables, recall on larger ones, odd vectors."""

import math

import numpy as np
import pytest

from shiftlens.llm import descent as module
from shiftlens.llm.descent import nearest

SCHEMA = "vec_id bigint, embedding array<float>, score string"


def plain(rows, every=50, k=5):
    """Every query against every vector."""
    kept = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            kept[i] = np.array(v, np.float32).astype(np.float64)
    out = []
    for q in sorted(i for i in kept if i % every == 0):
        near = [
            (-float(v @ kept[q]) / math.sqrt(v @ v) / math.sqrt(kept[q] @ kept[q]), i)
            for i, v in kept.items()
            if i != q and len(v) == len(kept[q])
        ]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(near)[:k])]
    return out


def run(spark, rows, **kw):
    got = nearest(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), **kw).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-12)


def vectors(n, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(rng.normal(size=(n, dims)))]


def test_small_tables_are_exact(spark):
    rows = vectors(300)
    same(run(spark, rows), plain(rows))


def test_odd_vectors_ties_and_repeats(spark):
    rows = vectors(40, 4)
    rows += [(50, [1.0, 2.0, 3.0, 4.0])] * 2 + [(51 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)]
    rows += [(None, [1.0, 0.0, 0.0, 0.0]), (200, None), (201, []), (202, [0.0] * 4), (250, [float("nan"), 1.0, 1.0, 1.0]), (300, [float("inf"), 1.0, 1.0, 1.0]), (203, [None, 1.0, 1.0, 1.0])]
    rows += [(400, [1.0, 2.0]), (401, [2.0, 1.0]), (-50, [1e30, 2e30, 0.0, 0.0])]
    same(run(spark, rows), plain(rows))


def test_huge_and_tiny_vectors(spark):
    """Scores of finite vectors are cosines whatever their size."""
    rows = [(0, [1e200, 1e200]), (50, [1e-200, 0.0]), (100, [3.0, 4.0]), (1, [1e-300, 1e-300]), (2, [1e308, 0.0]), (3, [0.0, 5e-324]), (4, [-1e250, 1.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    unit = {i: np.array(v) / max(map(abs, v)) for i, v in rows}
    unit = {i: v / math.sqrt(v @ v) for i, v in unit.items()}
    want = {(q, i): float(unit[q] @ unit[i]) for q in (0, 50, 100) for i in unit if i != q}
    assert len(got) == 15 and all(r.score == pytest.approx(want[r.query_id, r.vec_id], abs=1e-12) for r in got)
    assert {(r.query_id, r.vec_id) for r in got if r["rank"] == 1} == {(0, 1), (50, 2), (100, 0)}


def test_fewer_candidates_and_empty_table(spark):
    rows = vectors(3, 4)
    same(run(spark, rows), plain(rows))
    assert run(spark, rows[:1]) == [] and run(spark, []) == []


def test_walks_end_only_when_nothing_is_open(spark):
    """A chain of 16 links, each node naming the next, is walked to its end."""
    angle = np.arange(17) * 0.1
    unit = np.c_[np.cos(angle), np.sin(angle)].astype(np.float32)
    points = spark.createDataFrame([(i, 2, bytearray(v.tobytes())) for i, v in enumerate(unit)], "node bigint, dims int, vec binary")
    graph = spark.createDataFrame([(i, [i + 1], [0.9]) for i in range(16)], "node bigint, ids array<bigint>, scores array<float>")
    queries = points.where("node in (0, 9)").withColumnRenamed("node", "q")
    got = {r.q: set(r.ids) for r in module._walk(graph, points, queries, 0, 64, None, 0).collect()}
    assert got == {0: set(range(17)), 9: set(range(9, 17))}


def test_every_query_has_k_rows(spark, monkeypatch):
    """A query off the bulk, and one of a rare length, whose cells hold too few others."""
    monkeypatch.setattr(module, "CELL", 16)
    rng = np.random.default_rng(3)
    bulk = rng.normal(size=(900, 8)) * 0.05 + np.eye(8)[0]
    rows = [(i + 1001, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(bulk) if (i + 1001) % 50]
    rows += [(50, [-1.0, 0.1] + [0.0] * 6), (51, [-1.0, 0.0] + [0.0] * 6), (100, [0.0, 0.0, -1.0] + [0.0] * 5)]
    rows += [(10_000 + 10 * i, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(rng.normal(size=(30, 5)))]
    got = run(spark, rows)
    same([g for g in got if g[0] >= 10_000], [p for p in plain(rows) if p[0] >= 10_000])
    assert [g[:2] for g in got] == [p[:2] for p in plain(rows)]
    assert (50, 1, 51) in {g[:3] for g in got}


def test_recall_of_the_graph(spark, monkeypatch):
    monkeypatch.setattr(module, "CELL", 128)
    rows = vectors(1500, 24)
    found = {(q, i) for q, _, i, _ in run(spark, rows, beam=64, walk=5)}
    wanted = {(q, i) for q, _, i, _ in plain(rows)}
    assert len(found & wanted) >= 0.9 * len(wanted)


def test_large_cells_are_cut_by_nearness(spark, monkeypatch):
    """A third of the vectors in one tight cluster: all in one cell at first, and still each cell is of near ones."""
    monkeypatch.setattr(module, "CELL", 32)
    rng = np.random.default_rng(5)
    tight = np.eye(12)[0] + rng.normal(size=(500, 12)) * 0.02
    rows = [(i, v) for i, v in enumerate(np.r_[tight, rng.normal(size=(1000, 12))].astype(np.float32))]
    units = [v / np.float32(np.sqrt(v @ v)) for _, v in rows]
    placed = spark.createDataFrame([(0, 12, 0, i, bytearray(v.tobytes())) for i, v in enumerate(units)], "tree int, dims int, code bigint, node bigint, vec binary")
    cells = {}
    for r in module._parted(placed, 8).collect():
        cells.setdefault(r.code, []).append(r.node)
    assert sorted(n for c in cells.values() for n in c) == list(range(1500))
    assert max(map(len, cells.values())) <= 64


def test_rounds_go_on_until_links_stay(spark, monkeypatch):
    monkeypatch.setattr(module, "CELL", 16)
    rows = vectors(600, 12)
    unit = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows]
    points = spark.createDataFrame([(i, 12, bytearray(v.astype(np.float32).tobytes())) for i, v in unit], "node bigint, dims int, vec binary").cache()

    def recall(rounds):
        graph = {r.node: set(r.ids) for r in module.neighbour_graph(points, k=8, trees=2, rounds=rounds, reverse=6).collect()}
        m = np.stack([v for _, v in unit])
        s = m @ m.T
        np.fill_diagonal(s, -2)
        return np.mean([len(graph[i] & set(np.argsort(-s[i])[:8].tolist())) / 8 for i in range(600)])

    assert recall(None) > recall(1) + 0.05
