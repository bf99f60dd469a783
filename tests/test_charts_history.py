"""Chart data, relationships, history, responses."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shiftlens.operators import charts as ch
from shiftlens.operators import history as hi
from shiftlens.operators import relationships as re
from shiftlens.operators import responses as rs
from shiftlens.operators import usage
from tests.conftest import plan_of


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_resolution(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    one = spark.createDataFrame([(1,)], "a int")
    assert ch.axes(df, ch.ChartSpec("bar", "?", "?", "?")) == {"x": "a", "y": "b", "color": None}
    assert ch.axes(df, ch.ChartSpec("bar", "c", "a", "b")) == {"x": "c", "y": "a", "color": "b"}
    assert ch.chart_columns(df, ch.ChartSpec("bar", "a", None)) is None
    assert ch.chart_columns(one, ch.ChartSpec("bar", "a", "?")) is None


@pytest.mark.parametrize("spec", [ch.ChartSpec("none", "a", "b"), ch.ChartSpec("radar", "a", "b"), ch.ChartSpec("heatmap", "a", "b"), ch.ChartSpec("bar")])
def test_no_chart(spark, spec):
    assert ch.chart_data(spark.createDataFrame([(1, 2)], "a int, b int"), spec) is None


def test_no_chart_for_an_empty_result(spark):
    assert ch.chart_data(spark.createDataFrame([], "a int, b int"), ch.ChartSpec("bar", "a", "b")) is None


def test_bar_is_the_same_for_any_number_of_rows(spark):
    rows = [(i % 3 if i else None, float(i), "c" if i % 2 else "d") for i in range(25)] + [(9, None, "c")]
    df = spark.createDataFrame(rows, "x int, y double, c string")
    for n in (25, 26):
        few = spark.createDataFrame(rows[:n], df.schema)
        assert ch.bar(few, "x", "y", "c").count() == n and set(ch.bar(few, "x", "y", "c").columns) == {"x", "y", "c"}
    got = {(r.x, r.c): r.y for r in ch.bar(df, "x", "y", "c", rollup=True).collect()}
    want = {}
    for x, y, c in rows:
        if x is not None:
            want[x, c] = want.get((x, c), 0.0) + (y or 0.0)
    assert got == want


def test_line_sorts_time_only(spark):
    rows = [(dt.datetime(2025, 1, 3), 1), (dt.datetime(2025, 1, 1), 2), (dt.datetime(2025, 1, 2), 3)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, y int")
    assert {r.y: r.position for r in ch.line(df, "t", "y").collect()} == {2: 0, 3: 1, 1: 2}
    assert ch.line(df, "y", "t").columns == ["y", "t"]


def _bars(df, x, **kw):
    return sorted((r.kind, r.label, r.low, r.high, r.n_rows) for r in ch.value_histogram(df, x, **kw).collect())


def test_histogram_of_any_values(spark):
    nan, inf = float("nan"), float("inf")
    numbers = [1.0, 2.0, 2.0, 3.0, 9.0, nan, nan, inf, -inf, None]
    df = spark.createDataFrame([(v, None if v is None else f"t{i % 2}", i % 2 == 0) for i, v in enumerate(numbers)], "v double, t string, b boolean")
    # quartiles 2 and 3, five values: bins 2 / 5 ** (1 / 3) wide, seven of them
    bars = _bars(df, "v")
    assert [b[4] for b in bars if b[0] != "value"] == [1, 1, 2, 1] and [b[0] for b in bars if b[0] != "value"] == ["-infinity", "infinity", "nan", "null"]
    assert [(round(b[2], 4), round(b[3], 4), b[4]) for b in bars if b[0] == "value"] == [(1.0, 2.1429, 3), (2.1429, 3.2857, 1), (7.8571, 9.0, 1)]
    assert [(b[2], b[3], b[4]) for b in _bars(df, "v", bins=2) if b[0] == "value"] == [(1.0, 5.0, 4), (5.0, 9.0, 1)]
    assert {(b[0], b[1]): b[4] for b in _bars(df.na.fill({"t": "none"}), "t")} == {("category", "t0"): 5, ("category", "t1"): 4, ("category", "none"): 1}
    assert {(b[0], b[1]): b[4] for b in _bars(df.select("t"), "t")} == {("category", "t0"): 5, ("category", "t1"): 4, ("null", None): 1}
    assert {(b[1]): b[4] for b in _bars(df, "b")} == {"true": 5, "false": 5}


@pytest.mark.parametrize("values,bars", [([], []), ([4.0] * 3, [(4.0, 4.0, 3)]), ([0.0] * 7 + [8.0], [(0.0, 2.0, 7), (6.0, 8.0, 1)]), ([1e308, -1e308], [(-1e308, 1e308, 2)])])
def test_histogram_of_few_or_equal_values(spark, values, bars):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [(b[2], b[3], b[4]) for b in _bars(df, "v")] == bars


def test_histogram_through_a_chart(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "name string, n int")
    assert sorted((r.label, r.n_rows) for r in ch.chart_data(df, ch.ChartSpec("histogram", "name", "n")).collect()) == [("a", 2), ("b", 1)]
    assert sum(r.n_rows for r in ch.chart_data(df, ch.ChartSpec("histogram", "n", "name")).collect()) == 3


def test_pie_histogram_heatmap(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, None), ("b", 1.0, 15), (None, 4.0, 20)], "x string, y double, v int")
    assert _rows(ch.pie(df, "x", "y")) == _rows(spark.createDataFrame([("a", 3.0, 0.375), ("b", 1.0, 0.125), (None, 4.0, 0.5)], "x string, y double, share double"))
    assert _rows(ch.histogram(df, "v", 5, 20, 3)) == [(1, 1), (3, 1), (4, 1)]
    assert _rows(ch.heatmap_cells(df, "x", "y", "v")) == [(1.0, "a", 5.0), (1.0, "b", 15.0)]
    assert _rows(ch.heatmap(df, "x", "y", "v", ["a", "b"])) == [(1.0, 5.0, 15.0)]
    with pytest.raises(Exception, match="not listed: b"):
        ch.heatmap(df, "x", "y", "v", ["a"]).collect()
    assert sum(r.n_rows for r in ch.chart_data(df, ch.ChartSpec("histogram", "v", "y")).where("kind = 'value'").collect()) == 3
    plan = plan_of(ch.pie(df, "x", "y"))
    assert "NestedLoop" not in plan and "Window" not in plan


META = {
    "Fact": re.TableInfo("f", relationships=(re.Relationship("DIM", (("a", "x"), ("b", "y"))),)),
    "dim": re.TableInfo("d"),
}


def test_relationship_join_and_text(spark):
    fact = spark.createDataFrame([(1, 1, "p"), (1, 2, "q"), (3, 3, "r")], "a int, b int, v string")
    dim = spark.createDataFrame([(1, 1, "one"), (1, 1, "uno"), (3, 4, "no")], "x int, y int, w string")
    both = re.join_by_relationship({"Fact": fact, "dim": dim}, META, "Fact", "dim")
    assert _rows(both) == [(1, 1, "p", "one"), (1, 1, "p", "uno")]
    turned = re.join_by_relationship({"Fact": fact, "dim": dim}, META, "dim", "Fact")
    assert _rows(turned) == [(1, 1, "one", "p"), (1, 1, "uno", "p")]
    lines = re.relationship_lines(re.relationship_rows(spark, META)).collect()
    assert [r.line for r in lines] == ["Relationship: Fact INNER JOIN DIM ON Fact.a = DIM.x AND Fact.b = DIM.y"]
    with pytest.raises(KeyError):
        re.find_relationship(META, "Fact", "nope")
    routed = spark.createDataFrame([("q", "FACT"), ("q", "dim")], "query_id string, source string")
    assert re.relationship_info(routed, re.relationship_rows(spark, META)).first().relationship_info == lines[0].line


def test_declared_join_types(spark):
    fact = spark.createDataFrame([(1, "p"), (2, "q"), (None, "r")], "a int, v string")
    dim = spark.createDataFrame([(1, "one"), (7, "no")], "x int, w string")

    def joined(kind, *names):
        declared = {"Fact": re.TableInfo("f", relationships=(re.Relationship("dim", (("a", "x"),), kind),))}
        return _rows(re.join_by_relationship({"FACT": fact, "dim": dim}, declared, *names))

    left = sorted([(1, "p", "one"), (2, "q", None), (None, "r", None)], key=str)
    assert joined("LEFT JOIN", "fact", "DIM") == left and joined("left  outer join", "Fact", "dim") == left
    assert joined("RIGHT JOIN", "Fact", "dim") == sorted([(1, "p", "one"), (7, None, "no")], key=str)
    assert joined("LEFT JOIN", "dim", "Fact") == sorted([(1, "one", "p"), (2, None, "q"), (None, None, "r")], key=str)
    assert len(joined("FULL OUTER JOIN", "Fact", "dim")) == 4
    with pytest.raises(ValueError, match="CROSS"):
        joined("CROSS JOIN", "Fact", "dim")


def test_history(spark):
    log = spark.createDataFrame(
        [
            ("q1", "one two three four five", dt.datetime(2025, 5, 3, 9), "U1"),
            ("q2", "one two three four five six", dt.datetime(2025, 5, 3, 10), "U1"),
            ("q3", "x", dt.datetime(2025, 5, 2, 1), "U1"),
            ("q4", "x", dt.datetime(2025, 4, 2, 1), "U1"),
        ],
        "query_id string, query_text string, created_at timestamp_ntz, user_code string",
    )
    more = spark.createDataFrame(
        [("q5", "of another", dt.datetime(2025, 5, 3, 11), "U2"), ("q6", "no answer", dt.datetime(2025, 5, 3, 12), "U1")], log.schema
    )
    given = spark.createDataFrame(
        [(f"q{i}", dt.datetime(2025, 5, 4), "r", "x") for i in range(1, 6)],
        "query_id string, created_at timestamp_ntz, response_id string, text_response string",
    )
    rows = hi.history_panel(log.unionByName(more), given, dt.date(2025, 5, 3), 5).collect()
    assert {r.query_id: (r.user_code, r.label, r.preview, r.place) for r in rows} == {
        "q1": ("U1", "Today", "one two three four five", 2),
        "q2": ("U1", "Today", "one two three four five...", 1),
        "q3": ("U1", "Yesterday", "x", 1),
        "q4": ("U1", "2025-04-02", "x", 1),
        "q5": ("U2", "Today", "of another", 1),
    }
    assert [r.date for r in hi.history_dates(log).collect()] == ["2025-05-03", "2025-05-02", "2025-04-02"]
    assert sorted((r.n_queries, r.first_query_id) for r in hi.query_dedup(log).collect()) == [(1, "q1"), (1, "q2"), (2, "q3")]
    responses = spark.createDataFrame(
        [("q1", dt.datetime(2025, 5, 4), "r-late", "late"), ("q1", dt.datetime(2025, 5, 3), "r-first", "first"), ("q9", dt.datetime(2025, 5, 3), "r", "x")],
        "query_id string, created_at timestamp_ntz, response_id string, text_response string",
    )
    assert [(r.query_id, r.response_id) for r in hi.history_with_response(log, responses).collect()] == [("q1", "r-late")]


def test_messages(spark):
    old = spark.createDataFrame([("user", "hi", "q1", "2025")], "role string, content string, id string, created_at string")
    live = spark.createDataFrame([("assistant", "yo", "r1")], "role string, content string, id string")
    both = hi.messages_union(old, live)
    assert both.where("created_at IS NULL").first().id == "r1"
    assert [r.id for r in hi.with_role(both).collect()] == ["q1"]


def test_outcomes(spark):
    df = spark.createDataFrame(
        [("```sql a```", 1, True), ("```sql a", 0, True), ("```sql a", None, True), ("text", 5, True), ("```sql a", 5, False), (None, 0, True)],
        "response string, n_rows int, store_ready boolean",
    )
    got = {r.outcome: r.n_responses for r in rs.response_outcomes(df).collect()}
    assert got == {"sql_rows": 1, "sql_empty": 2, "text": 2, "fallback": 1}
    logged = rs.logged_text(F.col("response"), F.col("n_rows"), F.col("store_ready"), F.lit("sum"))
    assert [r[0] for r in df.select(logged).collect()] == [
        "sum\n\nDetailed results:\n", "No results found.", "No results found.", "text", "```sql a", None
    ]


def test_preview_of_short_and_long_results(spark):
    short = rs.result_preview(spark.range(7), ["id"], 5, 5)
    assert _rows(short) == sorted([("head", i) for i in range(5)] + [("tail", i) for i in (5, 6)], key=str)
    long = rs.result_preview(spark.range(11), ["id"], 5, 5)
    assert _rows(long) == sorted([("head", i) for i in range(5)] + [("tail", i) for i in range(6, 11)], key=str)


def test_daily_totals(spark):
    rows = [("2025-05-02 04:16:35", 39, 8, 43, 90), ("2025-05-02 05:51:49", 32, 8, 57, 97), ("2025-05-03 00:00:00", 1, 1, 1, 3)]
    df = spark.createDataFrame(rows, "timestamp string, nlp_tokens bigint, table_tokens bigint, viz_tokens bigint, total_tokens bigint")
    got = {r.day: (r.n_turns, r.total_tokens, r.mean_tokens, r.max_tokens) for r in usage.daily_totals(df).collect()}
    assert got == {"2025-05-02": (2, 187, 93.5, 97), "2025-05-03": (1, 3, 3.0, 3)}
