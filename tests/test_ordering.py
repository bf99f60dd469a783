"""Row positions, ranks and medians against a plain sort."""

import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shiftlens.operators.profiling import column_stats
from shiftlens.plans import medians, ordering, radix, scratch
from shiftlens.plans.ordering import with_rank_in_group, with_row_index
from shiftlens.plans.sizing import broadcast_if_small, is_longer_than, spread_small_scan
from tests.conftest import plan_of


def test_row_index_is_the_sorted_position_with_a_hot_key_and_nulls(spark):
    rng = random.Random(1)
    rows = [(None if i % 17 == 0 else (7 if i % 3 else rng.randrange(100)), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(5)
    got = {r.v: r.row_index for r in with_row_index(df, ["k", "v"], partitions=6).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {v: i for i, (_, v) in enumerate(ordered)}


def test_a_hot_leading_key_is_spread(spark, monkeypatch):
    saved = []
    monkeypatch.setattr(ordering, "written", lambda df, label: saved.append(scratch.written(df, label)) or saved[-1])
    df = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), "id")
    assert with_row_index(df, ["k", "id"], partitions=6).agg(F.max("row_index")).first()[0] == 59_999
    sizes = [r[1] for r in saved[0].groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 0.3 * 60_000


def test_a_large_group_of_copies_is_spread(spark, monkeypatch):
    saved = []
    monkeypatch.setattr(ordering, "written", lambda df, label: saved.append(scratch.written(df, label)) or saved[-1])
    df = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"))
    indexed = with_row_index(df, ["k"], partitions=6, spread_copies=True)
    assert indexed.columns == ["k", "row_index"] and indexed.select("row_index").distinct().count() == 60_000
    assert indexed.where("k = 7").agg(F.max("row_index") - F.min("row_index")).first()[0] == 40_000 - 1
    sizes = [r[1] for r in saved[0].groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 0.3 * 60_000


def test_row_index_descending(spark):
    df = spark.range(50).repartition(3)
    got = with_row_index(df, [F.desc("id")]).collect()
    assert all(r.row_index == 49 - r.id for r in got)


def test_row_index_of_nothing(spark):
    assert with_row_index(spark.range(0), ["id"]).count() == 0


def test_row_index_numbers_equal_rows_apart(spark):
    df = spark.createDataFrame([(1,)] * 20, "k int")
    assert sorted(r.row_index for r in with_row_index(df, ["k"]).collect()) == list(range(20))


def test_row_index_sorts_no_data_in_one_task(spark):
    indexed = with_row_index(spark.range(1000), ["id"])
    plan = plan_of(indexed)
    # The only window runs over the partition sizes.
    assert plan.count("Window (") == 1 and "sum(__rows" in plan


def test_rank_in_group_equals_row_number(spark):
    rng = random.Random(2)
    rows = [(None if i % 11 == 0 else ("hot" if i % 2 else f"g{i % 5}"), rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, o int, id int")
    got = {r.id: r.rank for r in with_rank_in_group(df, ["g"], [F.desc("o"), F.col("id")]).collect()}
    groups = {}
    for g, o, i in rows:
        groups.setdefault(g, []).append((-o, i))
    expected = {i: n + 1 for members in groups.values() for n, (_, i) in enumerate(sorted(members))}
    assert got == expected


def test_exact_medians(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 1000, 5001):
        values = [rng.choice([5.0, rng.uniform(-10, 10), float(rng.randrange(4))]) for _ in range(n)]
        spread = [rng.uniform(0, 1) * 10 ** rng.randrange(-300, 300) for _ in range(n)]
        rows = [(x, None, 1, y) for x, y in zip(values, spread)]
        df = spark.createDataFrame(rows, "a double, b double, c int, `d.e` double").repartition(3)
        got = {f.name: f for f in medians.column_facts(df)}
        assert got["a"].median == statistics.median(values) and got["d.e"].median == statistics.median(spread)
        assert got["c"].median == 1 and got["b"].median is None
        assert got["a"].min == min(values) and got["a"].max == max(values)
        assert got["b"].n_values == 0 and got["b"].n_rows == n


def test_statistics_keep_every_digit(spark):
    big = 9007199254740993
    rows = [(big, Decimal("12345678901234567890123456789012345678"), 1e33, float("inf"), -big), (big + 2, Decimal(2), 1.0, 1.0, -big - 2)]
    rows += [(big + 1, None, float("nan"), 2.0, -big - 1)]
    df = spark.createDataFrame(rows, "a bigint, b decimal(38,0), c double, d double, e bigint")
    got = {f.name: f for f in medians.column_facts(df)}
    assert (got["a"].min, got["a"].max, got["a"].median, got["a"].mean) == (big, big + 2, big + 1, big + 1)
    assert got["e"].median == -big - 1 and got["b"].median == Decimal("6172839450617283945061728394506172840")
    assert (got["c"].max, got["d"].max, got["d"].median) == (1e33, float("inf"), 2.0)
    text = {r.column_name: (r.min_text, r.max_text, r.mean_text, r.median_text) for r in column_stats(df).collect()}
    assert text["a"] == (str(big), str(big + 2), f"{big + 1}.000000", f"{big + 1}.000000")
    assert text["c"][1] == "1e+33" and text["d"] == ("1.000000", "Infinity", "Infinity", "2.000000")


def test_statistics_take_a_scan_for_each_digit(spark):
    df = spark.range(0, 20_000, 1, 7).selectExpr("id", "rand(1) AS x", "cast(id % 7 AS int) AS k")
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("statistics", "")
    try:
        medians.column_facts(df)
        jobs = seen.getJobIdsForGroup("statistics")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    scans = {s for j in jobs for s in seen.getJobInfo(j).stageIds if seen.getStageInfo(s) and seen.getStageInfo(s).numCompletedTasks == 7}
    assert len(scans) <= 1 + 64 // radix.BITS


def test_size_checks(spark):
    assert is_longer_than(spark.range(26), 25) and not is_longer_than(spark.range(25), 25)
    big = spark.range(1000)
    assert "BroadcastHashJoin" in plan_of(big.join(broadcast_if_small(spark.range(10), 10), "id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan_of(big.join(broadcast_if_small(spark.range(11), 10), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shared_folder_is_the_clusters(spark):
    assert scratch.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch.fresh_path(spark, "x") != scratch.fresh_path(spark, "x")


def test_scratch_of_an_application_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda _: str(tmp_path))
    other = tmp_path / "shiftlens" / "another-application"
    other.mkdir(parents=True)
    saved = scratch.written(spark.range(5), "x")
    assert saved.count() == 5 and len(list((tmp_path / "shiftlens").iterdir())) == 2
    scratch.drop_scratch(spark)
    assert list((tmp_path / "shiftlens").iterdir()) == [other]


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "yarn"
            getConf = Conf

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Cluster)


def test_small_scans_are_spread(spark, folder):
    scan = spark.read.parquet(f"{folder}/documents.parquet")
    assert spread_small_scan(scan, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 50)
    assert spread_small_scan(wide, "id") is wide
