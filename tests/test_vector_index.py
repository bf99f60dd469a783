"""The cell index gives what the full search gives, and scores less of clustered stores."""

import numpy as np
import pytest

from shiftlens.operators import vector_index as vi
from shiftlens.operators.retrieval import retrieve_topk
from shiftlens.plans.scratch import fresh_path

STORE = "table_name string, chunk_id bigint, embedding array<double>"
QUERIES = "query_id string, embedding array<double>"


def _both(spark, rows, asked, k=3, cell_rows=20):
    store = spark.createDataFrame(rows, STORE).repartition(4)
    queries = spark.createDataFrame(asked, QUERIES).repartition(2)
    index = vi.build_index(store, fresh_path(spark, "index"), cell_rows)
    hits, report = vi.search_index(index, queries, k)
    order = ["query_id", "source", "rank", "chunk_id", "score"]
    got = sorted(map(tuple, hits.select(*order).collect()))
    want = sorted(map(tuple, retrieve_topk(queries, store, k).select(*order).collect()))
    return got, want, report.first(), index


def _clustered(n, dims=16, centres=30, seed=2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    return [(f"t{i % 5}", i, (middle[i % centres] + 0.1 * rng.normal(size=dims)).tolist()) for i in range(n)]


def test_clusters_are_mostly_not_scored(spark):
    rows = _clustered(3000)
    got, want, report, index = _both(spark, rows, [(f"q{i}", rows[i * 31][2]) for i in range(60)], cell_rows=60)
    assert got == want and len(got) == 180
    assert report.n_queries == 60 and report.n_chunks == 3000 and report.share < 0.25 and len(index.centres) == 50


@pytest.mark.parametrize("k", [1, 3, 40])
def test_ties_zero_and_odd_vectors(spark, k):
    rng = np.random.default_rng(7)
    rows = [(f"t{i % 3}", i, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(500)]
    rows += [("t1", 1000, None), ("t0", 1001, []), ("t2", 1002, [1.0]), ("t9", 1003, [float("nan"), 0.0, 0.0]), ("t9", 1004, [1e200, 1e200, 0.0]), (None, 1005, [1e-200, 0.0, 0.0])]
    asked = [(f"q{i}", [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(30)] + [("none", None), ("empty", []), ("zero", [0.0] * 3), ("nan", [float("nan"), 1.0, 1.0]), ("opposite", [-1.0, -1.0, -1.0])]
    got, want, _, _ = _both(spark, [r for r in rows if r[0] is not None], asked, k)
    assert got == want


def test_only_negative_scores(spark):
    """A zero vector outranks whatever points away."""
    rows = [("t", i, [1.0, 0.01 * i]) for i in range(100)] + [("z", 500, [0.0, 0.0])]
    got, want, _, _ = _both(spark, rows, [("q", [-1.0, -1.0])])
    assert got == want and ("q", "z", 1, 500, 0.0) in got


def test_pieces_blocks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(vi, "PIECE_ROWS", 50)
    monkeypatch.setattr(vi, "BLOCK_QUERIES", 10)
    rows = _clustered(400) + [("hot", 10_000 + i, [1.0] * 16) for i in range(300)]
    got, want, _, _ = _both(spark, rows, [(f"q{i}", rows[i * 7][2]) for i in range(40)] + [("hot", [2.0] * 16)], 5)
    assert got == want


def test_saved_index_is_opened_again(spark):
    rows = _clustered(300)
    path = fresh_path(spark, "index")
    built, opened = vi.build_index(spark.createDataFrame(rows, STORE), path, 30), vi.open_index(spark, path)
    assert (built.centres == opened.centres).all() and (built.radii == opened.radii).all() and built.rows == opened.rows == 300
    queries = spark.createDataFrame([("a", rows[5][2])], QUERIES)
    assert vi.retrieve_indexed(queries, built).collect() == vi.retrieve_indexed(queries, opened).collect()


def test_empty_store_and_no_queries(spark):
    got, want, report, _ = _both(spark, [], [("q", [1.0, 2.0])])
    assert got == want == [] and report.n_scored == 0
    got, want, report, _ = _both(spark, _clustered(50), [])
    assert got == want == [] and report.share is None


def test_no_list_of_queries_and_cells_is_made(spark, monkeypatch):
    """Of random directions nearly all cells are scored; what is saved grows with queries and hits, not with their cells."""
    sizes = []

    def counted(df, label):
        saved = vi_written(df, label)
        sizes.append((label, saved.count()))
        return saved

    vi_written = vi.written
    monkeypatch.setattr(vi, "written", counted)
    rng = np.random.default_rng(9)
    rows = [("t", i, rng.normal(size=16).tolist()) for i in range(400)]
    got, want, report, index = _both(spark, rows, [(f"q{i}", rows[i][2]) for i in range(100)], 3, 8)
    assert got == want and report.share > 0.5 and len(index.centres) == 50
    searched = dict(sizes[1:])
    assert max(searched.values()) <= 100 * 3 * 12 + 12 and "other-cells" not in searched
