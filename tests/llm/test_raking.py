"""Raking and calibrated sampling."""

import pytest
from pyspark.sql import functions as F

from shiftlens.llm.raking import TOLERANCE, calibrated, mix, raked

SCHEMA = "doc_id bigint, text string, source string, lang string, kept string, topic string"


def plain_rake(cells, targets, rounds):
    """Fitting by loops over a dictionary."""
    weight = {k: float(v) for k, v in cells.items()}
    for _ in range(rounds):
        for at, target in enumerate(targets):
            sums = {}
            for k, w in weight.items():
                sums[k[at]] = sums.get(k[at], 0) + w
            weight = {k: w * target[k[at]] / sums[k[at]] if sums[k[at]] else 0.0 for k, w in weight.items()}
    return weight


def test_against_loops_and_margins_hold(spark):
    cells = {(f"s{a}", f"l{b}", f"t{c}"): (a + 1) * 100 + 17 * b * c + 5 for a in range(4) for b in range(3) for c in range(2)}
    frame = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens bigint")
    shares = [{"s0": 0.4, "s1": 0.3, "s2": 0.2, "s3": 0.1}, {"l0": 0.5, "l1": 0.3, "l2": 0.2}, {"t0": 0.75, "t1": 0.25}]
    names = ("source", "lang", "topic")
    targets = {n: spark.createDataFrame(list(s.items()), "value string, share double") for n, s in zip(names, shares, strict=True)}
    got = {(r.source, r.lang, r.topic): r.weight for r in raked(frame, names, targets, rounds=9).collect()}
    assert got == pytest.approx(plain_rake(cells, shares, 9), rel=1e-9)
    for at, share in enumerate(shares):
        for value, wanted in share.items():
            assert sum(w for k, w in got.items() if k[at] == value) == pytest.approx(wanted, rel=1e-3)


def test_probabilities_fill_the_budget(spark):
    cells = spark.createDataFrame([(1000, 0.2), (10, 0.5), (500, 0.2), (0, 0.0), (300, 0.1), (40, 0.0)], "tokens bigint, weight double")
    for budget in (0.05, 0.3, 0.8, 1.0):
        rows = calibrated(cells, budget).collect()
        assert all(0 <= r.probability <= 1 for r in rows)
        assert sum(r.tokens * r.probability for r in rows) == pytest.approx(min(1850 * budget, 1810), rel=1e-9)


def _docs(spark, n=4000):
    rows = [(i, "word " * (i % 7 + 1), f"s{i % 3 if i % 2 else 0}", "en" if i % 5 else "de", "k", "t") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_sample_follows_the_targets(spark):
    even = spark.createDataFrame([("s0", 1.0), ("s1", 1.0), ("s2", 1.0)], "v string, s double")
    got = mix(_docs(spark), {"source": even}, budget=0.3).where("kept").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    total = sum(r.n for r in got)
    assert all(abs(r.n / total - 1 / 3) < 0.04 for r in got)
    again = {r.doc_id for r in mix(_docs(spark).repartition(5), {"source": even}, budget=0.3).where("kept").collect()}
    assert again == {r.doc_id for r in mix(_docs(spark), {"source": even}, budget=0.3).where("kept").collect()}


def test_nulls_empty_repeated_and_long_rows(spark):
    rows = [(None, "a b", None, None, "k", "t"), (1, None, "s", "en", "k", "t"), (2, "", "s", None, "k", "t"), (3, "x " * 100_000, "s", "en", "k", "t")]
    rows += [(4, "y z", "s", "en", "k", "t")] * 2
    got = mix(spark.createDataFrame(rows, SCHEMA), budget=1.0).collect()
    assert len(got) == 6 and all(r.probability is not None for r in got)
    assert {r.doc_id: r.n_tokens for r in got} == {None: 2, 1: 0, 2: 0, 3: 100_000, 4: 2}
    assert all(r.kept == (r.n_tokens > 0 or (r.source, r.lang) == ("s", "en")) for r in got)


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0


CELLS = "source string, lang string, topic string, tokens bigint"
NAMES = ("source", "lang", "topic")


def _target(spark, **shares):
    return {name: spark.createDataFrame(list(values.items()), "value string, share double") for name, values in shares.items()}


def test_targets_that_cannot_hold_together_are_an_error(spark):
    cells = spark.createDataFrame([("a", "x", "t", 50), ("b", "x", "t", 30), ("b", "y", "t", 20)], CELLS)
    wanted = _target(spark, source={"a": 0.9, "b": 0.1}, lang={"x": 0.1, "y": 0.9})
    with pytest.raises(ValueError, match="cannot hold together.*(source|lang) = "):
        raked(cells, NAMES, wanted)
    assert raked(cells, NAMES, wanted, rounds=2).count() == 3


def test_slow_fits_go_on_until_the_margins_hold(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10**6), ("a", "y", "t", 1), ("b", "x", "t", 1), ("b", "y", "t", 10**5)], CELLS)
    shares = {"source": {"a": 0.3, "b": 0.7}, "lang": {"x": 0.6, "y": 0.4}}
    got = raked(cells, NAMES, _target(spark, **shares)).collect()
    for name, values in shares.items():
        for value, wanted in values.items():
            assert abs(sum(r.weight for r in got if r[name] == value) - wanted) <= TOLERANCE


def test_own_targets_that_cannot_hold_give_the_last_margin(spark):
    cells = spark.createDataFrame([*[(f"s{i}", "x", "t", 1) for i in range(9)], ("big", "y", "t", 9)], CELLS)
    got = raked(cells, NAMES).collect()
    assert all(r.weight > 0 for r in got) and sum(r.weight for r in got) == pytest.approx(1.0)


def test_many_filled_cells(spark):
    rows = [(100 + i, 2.0 ** (i % 12) * (i + 1)) for i in range(60)]
    total, weights = sum(t for t, _ in rows), sum(w for _, w in rows)
    cells = spark.createDataFrame([(t, w / weights) for t, w in rows], "tokens bigint, weight double")
    for budget in (0.1, 0.5, 0.95, 1.0):
        low, high = 0.0, 1e12
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(t, mid * w / weights) for t, w in rows) < total * budget else (low, mid)
        got = {r.tokens: r.probability for r in calibrated(cells, budget).collect()}
        assert got == pytest.approx({t: min(1.0, high * w / weights / t) for t, w in rows}, rel=1e-6)
