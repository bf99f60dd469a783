"""Threshold pairs against all dense products, and how few entries are joined."""

import random

import numpy as np
import pyarrow as pa
import pytest

from shiftlens.operators.sparse_pairs import prefix_entries, similar_classes, similar_pairs, weighted
from tests.conftest import plan_of

SIDE = "key string, weights array<struct<bucket:int,weight:double>>"


def _side(rng, n, dims, name, words=6):
    out = []
    for i in range(n):
        v = np.zeros(dims)
        for _ in range(rng.randrange(1, words)):
            v[min(dims - 1, int(rng.expovariate(0.15)))] += 1
        out.append((f"{name}{i}", v / np.linalg.norm(v)))
    return out


def _frame(spark, side):
    rows = [(k, [(int(b), float(v[b])) for b in np.flatnonzero(v)]) for k, v in side]
    return spark.createDataFrame(rows + [("nothing", []), (None, [(0, 1.0)]), ("missing", None)], SIDE).repartition(3)


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
def test_equals_all_products(spark, threshold):
    rng = random.Random(3)
    left, right = _side(rng, 60, 40, "a"), _side(rng, 150, 40, "b")
    got = {(r.left_key, r.right_key): r.score for r in similar_pairs(_frame(spark, left), _frame(spark, right), threshold, 40).collect()}
    want = {(a, b): round(float(x @ y), 6) for a, x in left for b, y in right if round(float(x @ y), 6) >= threshold}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want) and want


def test_copies_are_one_class(spark):
    rng = random.Random(4)
    one = _side(rng, 1, 40, "x")[0][1]
    left, right = [(f"a{i}", one) for i in range(30)], [(f"b{i}", one) for i in range(40)]
    pairs, left_keys, right_keys = similar_classes(_frame(spark, left), _frame(spark, right), 0.9, 40)
    assert pairs.count() == 1 and left_keys.count() == 30 and right_keys.count() == 40
    assert similar_pairs(_frame(spark, left), _frame(spark, right), 0.9, 40).count() == 1200


def test_common_components_have_no_entries():
    """Texts that share one very frequent component each have entries for the rare ones only."""
    dims = 100
    vectors = []
    for i in range(90):
        v = np.zeros(dims)
        v[[0, 1 + i]] = 0.3, 0.9
        vectors.append(v / np.linalg.norm(v))
    counts = np.array([sum(v[b] > 0 for v in vectors) for b in range(dims)])
    rank = np.argsort(np.argsort(counts, kind="stable"), kind="stable")
    rows = pa.array([[{"bucket": int(b), "weight": float(v[b])} for b in np.flatnonzero(v)] for v in vectors], pa.list_(pa.struct([("bucket", pa.int32()), ("weight", pa.float64())])))
    row, bucket, _, left = prefix_entries(rows, rank, np.ones(dims), 0.5)
    assert row.tolist() == list(range(90)) and 0 not in bucket and np.allclose(left, 0.3 / np.sqrt(0.9))


def test_empty_sides_and_bad_threshold(spark):
    empty, some = spark.createDataFrame([], SIDE), _frame(spark, _side(random.Random(1), 5, 40, "a"))
    assert similar_pairs(empty, some, 0.5, 40).count() == similar_pairs(some, empty, 0.5, 40).count() == 0
    with pytest.raises(ValueError, match="above"):
        similar_pairs(some, some, 0.0, 40)


def test_texts(spark):
    texts = spark.createDataFrame([("a", "one two three"), ("b", "three two one"), ("c", "four five"), ("d", None), ("e", " ")], "id string, body string")
    side = weighted(texts, "id", "body")
    got = sorted(map(tuple, similar_pairs(side, side, 0.9).collect()))
    assert got == [("a", "a", 1.0), ("a", "b", 1.0), ("b", "a", 1.0), ("b", "b", 1.0), ("c", "c", 1.0)]


@pytest.mark.parametrize("bounds", [{"row_cost": 0}, {"row_cost": 1e12}, {"row_cost": 1e12, "task_bytes": 8 * 40 * 30}])
@pytest.mark.parametrize("threshold", [0.2, 0.8, 1.0])
def test_index_and_products_give_the_same(spark, threshold, bounds):
    rng = random.Random(6)
    left, right = _side(rng, 60, 40, "a"), _side(rng, 150, 40, "b")
    got = {(r.left_key, r.right_key): r.score for r in similar_pairs(_frame(spark, left), _frame(spark, right), threshold, 40, **bounds).collect()}
    want = {(a, b): round(float(x @ y), 6) for a, x in left for b, y in right if round(float(x @ y), 6) >= threshold}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want) and want


def test_common_components_are_not_joined(spark):
    """Where every component is common, the index would join more rows than there are pairs: blocks are multiplied."""
    rng = np.random.default_rng(8)
    sides = [_frame(spark, [(f"{n}{i}", v / np.linalg.norm(v)) for i, v in enumerate(rng.random((80, 12)) + 0.2)]) for n in "ab"]
    plan = plan_of(similar_pairs(*sides, 0.97, 12))
    assert "CoGroups" in plan and similar_pairs(*sides, 0.97, 12).count() == similar_pairs(*sides, 0.97, 12, row_cost=0).count() > 0
