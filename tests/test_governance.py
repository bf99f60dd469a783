"""Access, masking and SQL over governed views."""

import pytest
from pyspark.errors import AnalysisException, ParseException

from shiftlens.operators import governance as g
from tests.conftest import plan_of


@pytest.fixture()
def fact(spark):
    return spark.createDataFrame(
        [(1, 10, 100, 5.0), (1, 11, 101, 6.0), (2, 12, 102, 7.0), (3, 13, 103, 8.0)],
        "PUID bigint, ID bigint, Shift_Id bigint, VALID double",
    )


@pytest.fixture()
def access(spark):
    return spark.createDataFrame(
        [(1, "U1", "P1", "G1"), (1, "U1", "P1", "G2"), (2, "U1", "P2", "G1"), (3, "U2", "P1", "G1"), (4, "", "P1", "G1")],
        "PUID bigint, user_code string, Plantcode string, groupcode string",
    )


def test_rows_of_own_machines_without_fan_out(fact, access):
    rows = g.accessible_rows(fact, access, "U1", "P1").collect()
    assert sorted(r.ID for r in rows) == [10, 11]


@pytest.mark.parametrize("who", [(None, "P1"), ("U1", None), ("", "P1"), ("U1", "  "), ("U9", "P1"), ("U2", "P2")])
def test_no_identity_or_no_machine_means_no_rows(fact, access, who):
    assert g.governed(fact, access, *who).count() == 0


def test_denied_read_scans_nothing(spark, folder):
    fact = spark.read.parquet(f"{folder}/lineitem.parquet")
    assert "Scan parquet" not in plan_of(g.access_guard(fact, None, "P1"))
    assert "Scan parquet" in plan_of(g.access_guard(fact, "U1", "P1"))


def test_access_is_a_checked_broadcast_semi_join(spark, folder):
    from shiftlens.catalog import views as v

    plan = plan_of(g.governed(v.shift_fact(spark, folder), v.machine_access(spark, folder), "U3", "P3"))
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan


def test_mask_ignores_case_and_keeps_other_names(fact, spark):
    assert g.mask_columns(fact).columns == ["VALID"]
    assert g.mask_columns(spark.createDataFrame([(1, 2, 3)], "puid int, `ID` int, `a.b` int")).columns == ["a.b"]


@pytest.fixture()
def locked(spark, folder):
    from shiftlens.catalog import views as v

    spark.range(3).createOrReplaceTempView("raw_rows")
    spark.range(30).write.mode("overwrite").saveAsTable("saved_rows")
    spark.sql("CREATE OR REPLACE VIEW saved_view AS SELECT * FROM saved_rows")

    def views(session):
        return {"shift_fact": g.governed(v.shift_fact(session, folder), v.machine_access(session, folder), "U3", "P3")}

    locked = g.locked_session(spark, views)
    locked.udf.register("own_function", lambda x: x)
    yield locked
    spark.sql("DROP VIEW saved_view")
    spark.sql("DROP TABLE saved_rows")


@pytest.mark.parametrize(
    "text",
    [
        "SELECT 1 AS one",
        "SELECT round(avg(total_count), 2) AS a, count(DISTINCT VALUES.x) AS n FROM shift_fact CROSS JOIN (VALUES (1), (2)) AS VALUES(x)",
        "WITH a AS (SELECT total_count AS t FROM shift_fact), b AS (SELECT max(t) AS m FROM a) SELECT * FROM a JOIN b ON t = m",
        "SELECT total_count, row_number() OVER (ORDER BY total_count) AS r FROM shift_fact WHERE total_count IN (SELECT id FROM range(100))",
        "SELECT CASE WHEN total_count > 3 THEN upper('a') ELSE concat('b', 'c') END AS k FROM SHIFT_FACT f WHERE EXISTS (SELECT 1 FROM shift_fact g WHERE g.total_count < f.total_count)",
        "SELECT sum(x) AS s FROM (SELECT explode(sequence(1, 4)) AS x)",
        "SELECT date_format(ShiftStartTime, 'yyyy') AS y, extract(MONTH FROM ShiftStartTime) AS m, total_count % 2 = 0 OR total_count BETWEEN 1 AND 3 AS c FROM shift_fact WHERE total_count IS NOT NULL",
    ],
)
def test_governed_sql_allows(locked, text):
    assert g.run_sql(locked, text).count() >= 1


def test_governed_sql_runs_with_parameters(locked):
    n = g.run_sql(locked, "SELECT count(*) AS n FROM shift_fact WHERE total_count >= :least", {"least": 0}).first().n
    assert n > 0
    assert g.run_sql(locked, "WITH a AS (SELECT 1 AS one) SELECT * FROM a -- done").first().one == 1


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM parquet.`/root/testdata/sf0.001/lineitem.parquet`",
        "SELECT * FROM raw_rows",
        "SELECT PUID FROM shift_fact",
        "SELECT ID FROM shift_fact",
        "SET spark.sql.runSQLOnFiles=true",
        "CREATE TEMP VIEW x USING parquet OPTIONS (path '/root/testdata/sf0.001/lineitem.parquet')",
        "DROP VIEW shift_fact",
        "SELECT 1; SELECT 2",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
        "SELECT reflect('java.util.UUID', 'randomUUID')",
        "SELECT try_reflect('java.util.UUID', 'randomUUID')",
        "SELECT VALID FROM shift_fact WHERE VALID > (SELECT java_method('java.lang.Math', 'random'))",
        "WITH a AS (SELECT reflect('java.util.UUID', 'randomUUID') AS x) SELECT * FROM a",
        "SELECT * FROM saved_rows",
        "SELECT * FROM default.saved_rows",
        "SELECT count(*) FROM shift_fact WHERE total_count IN (SELECT id FROM saved_rows)",
        "SELECT (SELECT max(id) FROM saved_rows) AS m FROM shift_fact",
        "SELECT * FROM shift_fact f WHERE EXISTS (SELECT 1 FROM saved_rows s WHERE s.id = f.total_count)",
        "WITH a AS (SELECT id FROM saved_rows) SELECT total_count FROM shift_fact JOIN a ON id = total_count",
        "SELECT total_count FROM shift_fact UNION ALL SELECT id FROM saved_rows",
        "SELECT * FROM saved_view",
        "SELECT transform(array(1), x -> reflect('java.util.UUID', 'randomUUID'))",
        "SELECT input_file_name() FROM shift_fact",
        "SELECT current_user()",
        "SELECT spark_catalog.default.secret(1)",
        "SELECT own_function(1)",
    ],
)
def test_governed_sql_refuses(locked, text):
    with pytest.raises((AnalysisException, ParseException, g.QueryRefused)):
        g.run_sql(locked, text).collect()
    assert g.run_sql_or_none(locked, text) is None
