"""Window search and hard negatives against plain code, and what the ranges rule out."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftlens.llm import gnat
from shiftlens.llm.gnat import build, eliminated, hard_negatives, index, leaf_of, products, ranges_of, surviving, usable

SCHEMA = "vec_id bigint, embedding array<double>, label int, leaf string, vec int"
MOST = 2**63 - 1


def _plain(rows, every=50):
    whole = {}
    for vec_id, vector, label in sorted((r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[2], r[1])):
        whole.setdefault(vec_id, (label, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in vector]))
    out = []
    for a, (label, v) in whole.items():
        if a % every:
            continue
        scored = sorted((-max(-MOST, min(MOST, sum(x * y for x, y in zip(v, w, strict=True)))), i, other) for i, (other, w) in whole.items() if i != a and len(w) == len(v))
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            inside = [(n, i) for n, i, other in scored if other != label and -50 * p <= -100 * n <= -95 * p]
            out += [(a, positive, rank + 1, i, -p, -n) for rank, (n, i) in enumerate(inside[:3])]
    return sorted(out)


def _got(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(map(tuple, hard_negatives(usable(df), **kw).select(*columns).collect()))


def _clusters(n, dims=6, seed=1, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims)) * 3
    return [(i, (middle[i % centres] + rng.normal(size=dims) * 0.2).tolist(), int(rng.integers(4))) for i in range(n)]


def test_equals_plain_code(spark, monkeypatch):
    monkeypatch.setattr(gnat, "LEAF_ROWS", 40)
    rows = _clusters(700) + [(700 + i, [0.5] * 6, i % 2) for i in range(200)]  # a group of copies
    assert _got(spark, rows) == _plain(rows)


def test_pieces_and_blocks(spark, monkeypatch):
    """Leaves and queries cut into several parts."""
    monkeypatch.setattr(gnat, "PIECE_ROWS", 30)
    monkeypatch.setattr(gnat, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(gnat, "LEAF_ROWS", 100)
    rows = _clusters(400, seed=2)
    assert _got(spark, rows, every=10) == _plain(rows, every=10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 1.5], 1), (2, [0.9, 1.1], 2), (3, None, 1), (4, [1.0, None], 2), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (None, [1.0, 1.0], 2)]
    rows += [(8, [1.0, 1.0], None), (50, [], 1), (51, [], 1), (52, [], 2), (100, [1.0], 1), (101, [1.0], 1), (102, [0.7], 3), (150, [0.0, 0.0], 2), (9, [0.0, 0.0], 2)]
    rows += [(10, [1.0, 0.5], 2), (10, [1.0, 0.5], 2), (10, [0.1, 0.1], 3), (-50, [-1.0, -1.0], 1), (11, [0.8, 0.9], 2), (12, [0.8, 0.9], 3)]
    assert _got(spark, rows) == _plain(rows) != []


def test_large_and_small_numbers(spark):
    rows = [(0, [1e8, 1e8], 1), (1, [1e8, 1.5e8], 1), (2, [8e7, 7e7], 2), (3, [1e8, 0.5e8], 3), (4, [1e300, 1.0], 1), (5, [-1e308, 1e307], 2)]
    rows += [(50, [1e-200, 1e-300], 1), (51, [2e-200, 0.0], 1), (52, [-1e-200, 0.01], 2), (6, [1e9, 1e9], 2), (100, [3e305, 3e305], 2)]
    assert _got(spark, rows) == _plain(rows)


def test_empty_table(spark):
    assert _got(spark, []) == []


@pytest.mark.parametrize("scale", [1, 2**20, 2**40])
def test_products_are_exact(scale):
    rng = np.random.default_rng(3)
    a, b = (rng.integers(-500, 500, (n, 5)) * scale + rng.integers(0, 9, (n, 5)) for n in (7, 9))
    want = [[max(-MOST, min(MOST, sum(int(x) * int(y) for x, y in zip(r, s, strict=True)))) for s in b] for r in a]
    assert products(a.astype(float), b.astype(float)).tolist() == want


def test_no_leaf_with_a_hit_is_left_out(monkeypatch):
    monkeypatch.setattr(gnat, "LEAF_ROWS", 20)
    rng = np.random.default_rng(5)
    for dims, spread in ((2, 1.0), (8, 0.2), (16, 1.0)):
        rows = np.floor(256 * (rng.normal(size=(10, dims))[rng.integers(10, size=800)] + spread * rng.normal(size=(800, dims))))
        tree, found = build(rows[:300], len(rows)), {}
        ranges_of(tree, rows, found)
        tree.ranges = found
        leaves, left = leaf_of(tree, rows), 0
        assert tree.leaves > 10
        for q in rows[:60]:
            scores = np.sort(rows @ q)
            low, high = np.array([scores[-40]]), np.array([scores[-5]])
            hit = (rows @ q >= low) & (rows @ q <= high)
            survivors = surviving(tree, q, low, high)
            assert set(leaves[hit].tolist()) <= set(survivors)
            left += len(survivors)
        assert left < 60 * tree.leaves or dims == 16


def test_most_leaves_of_clusters_are_ruled_out(spark, monkeypatch):
    monkeypatch.setattr(gnat, "LEAF_ROWS", 50)
    rows = usable(spark.createDataFrame([(*r, "", 1) for r in _clusters(3000, centres=40)], SCHEMA))
    tree = index(rows)
    window = F.array(F.struct(F.lit(0).cast("bigint").alias("key"), (F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x) * 65536 * 0.95).cast("bigint").alias("low"), F.lit(MOST).alias("high")))
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", "vec", window.alias("windows"))
    assert tree.tree.leaves > 20 and eliminated(tree, queries) > 0.6
