"""Exact quantiles against sorted values, for every numeric type."""

import math
import random
from decimal import Decimal, localcontext
from fractions import Fraction

import pytest

from shiftlens.plans import radix

SHARES = ["0", "0.1", "0.25", "1/3", "0.5", "0.75", "0.99", "1"]


def _plain(values, share):
    values = sorted(v for v in values if v is not None and not (isinstance(v, float) and math.isnan(v)))
    if not values:
        return None
    place = Fraction(share) * (len(values) - 1)
    low, high = values[int(place)], values[-int(-place // 1)]
    part = place - int(place)
    if isinstance(low, float):
        if low == high or part == 0:
            return low
        return low + (high - low) * float(part) if math.isfinite(high - low) else low * float(1 - part) + high * float(part)
    low, high = Fraction(low), Fraction(high)
    exact = low + (high - low) * part
    with localcontext(prec=80):
        return Decimal(exact.numerator) / Decimal(exact.denominator)


def _check(spark, values, kind):
    df = spark.createDataFrame([(v, "clash") for v in values], f"v {kind}, label string").repartition(3)
    got = radix.exact_quantiles(df, SHARES)
    assert set(got) == {"v"}
    for share, found in zip(SHARES, got["v"], strict=True):
        want = _plain(values, share)
        assert found == want or (isinstance(want, float) and math.isnan(want) and math.isnan(found)), (share, found, want)


RNG = random.Random(8)


@pytest.mark.parametrize(
    "kind,values",
    [
        ("bigint", [RNG.randrange(-(2**63), 2**63) for _ in range(700)] + [-(2**63), 2**63 - 1, None]),
        ("bigint", [2**53 + i for i in (0, 1, 1, 2, 3)]),
        ("bigint", [7] * 50 + [None]),
        ("int", [RNG.randrange(-100, 100) for _ in range(301)]),
        ("tinyint", [-128, 127, 0, -1]),
        ("double", [RNG.uniform(-1e300, 1e300) * 10 ** RNG.randrange(-200, 1) for _ in range(500)]),
        ("double", [float("inf"), -float("inf"), float("nan"), 1.5, -0.0, 0.0, 5e-324, -5e-324, None]),
        ("double", [float("inf")] * 3 + [1.0]),
        ("float", [0.5, 1.25, -3.0, None]),
        ("decimal(38,0)", [Decimal(10) ** 37 + i for i in (3, 1, 2)] + [-(Decimal(10) ** 37), Decimal(0), None]),
        ("decimal(38,10)", [Decimal(RNG.randrange(-(10**37), 10**37)).scaleb(-10) for _ in range(200)]),
        ("decimal(38,0)", [Decimal(10**38 - 1 - i) for i in range(5)] + [Decimal(-(10**38) + 1)]),
        ("decimal(9,2)", [Decimal("1.10"), Decimal("1.20"), Decimal("-5.00")]),
        ("bigint", []),
        ("double", [None, float("nan")]),
        ("int", [3]),
    ],
)
def test_equals_sorted_values(spark, kind, values):
    _check(spark, values, kind)


def test_scans_are_few_and_shared_by_all_columns(spark, monkeypatch):
    scans = []
    scan = radix._scan
    monkeypatch.setattr(radix, "_scan", lambda df, searches: (scans.append(len(searches)), scan(df, searches)))
    df = spark.range(3000).selectExpr("id % 1000 AS narrow", "id * 1000003 AS wide", "cast(id AS double) / 7 AS real", "id AS `dotted.name`")
    got = radix.exact_quantiles(df, ["0.5"])
    assert got["dotted.name"] == [Decimal("1499.5")] and got["narrow"] == [Decimal("499.5")] and got["wide"] == [Decimal("1499.5") * 1000003]
    assert len(scans) == 4 and scans[0] <= 8, "as many as the doubles' digits take"


def test_a_narrow_column_takes_one_scan(spark, monkeypatch):
    scans = []
    scan = radix._scan
    monkeypatch.setattr(radix, "_scan", lambda df, searches: (scans.append(1), scan(df, searches)))
    assert radix.exact_quantiles(spark.range(10_000).select("id"), ["0.25", "0.5"]) == {"id": [Decimal("2499.75"), Decimal("4999.5")]}
    assert len(scans) == 1


def test_keys_sort_like_values():
    from pyspark.sql import types as T

    doubles = [-math.inf, -1e300, -1.0, -5e-324, 0.0, 5e-324, 2.5, math.inf]
    keys = [radix.key_of(v, T.DoubleType()) for v in doubles]
    assert keys == sorted(keys) and [radix.value_of(k, T.DoubleType()) for k in keys] == doubles
    assert radix.key_of(-0.0, T.DoubleType()) == radix.key_of(0.0, T.DoubleType())


def test_bad_shares(spark):
    with pytest.raises(ValueError, match="between"):
        radix.exact_quantiles(spark.range(3), [1.5])
