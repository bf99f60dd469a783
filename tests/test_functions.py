"""Column expressions against plain Python."""

import datetime as dt
import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shiftlens.catalog.queries import hashed_vectors
from shiftlens.functions import text as tx
from shiftlens.functions import times as tm
from shiftlens.functions import vectors as vc

TEXTS = ["", " ", "one", " a  b\tc\nd e ", "a b c\x1cd", "five words are in here", "six words are in here now", None]


def _values(spark, column, rows, schema="t string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_words_split_like_python(spark):
    got = _values(spark, tx.token_count(F.col("t")), [(t,) for t in TEXTS])
    assert got == [len((t or "").split()) for t in TEXTS]


def test_every_white_space_character_is_pythons(spark):
    codes = [*range(1, 0xD800), *range(0xE000, 0x11000)]
    df = spark.createDataFrame([(c, f"a{chr(c)}b", f"{chr(c)}a{chr(c)}") for c in codes], "c int, t string, s string")
    rows = df.select("c", tx.token_count(F.col("t")).alias("n"), tx.stripped(F.col("s")).alias("s")).collect()
    wrong = [r.c for r in rows if r.n != len(f"a{chr(r.c)}b".split()) or r.s != f"{chr(r.c)}a{chr(r.c)}".strip()]
    assert wrong == []


def test_preview(spark):
    got = _values(spark, tx.text_preview(F.col("t"), 5), [(t,) for t in TEXTS[:-1]])
    assert got == [" ".join(t.split()[:5]) + ("..." if len(t.split()) > 5 else "") for t in TEXTS[:-1]]


RESPONSES = [
    "no fence at all",
    "before ```sql\n\tSELECT 1\n ``` after",
    "open ```sql SELECT 2 ",
    "```sql SELECT 3 ``` and ```sql SELECT 4 ```",
    "```sql SELECT 5 ```sql SELECT 6",
    "```sql```",
    "``` plain ```",
]


def test_sql_extraction(spark):
    got = _values(spark, tx.extract_sql(F.col("t")), [(t,) for t in RESPONSES])
    expected = [t.split("```sql")[1].split("```")[0].strip() if "```sql" in t else None for t in RESPONSES]
    assert got == expected


def test_row_text_shows_missing_cells(spark):
    df = spark.createDataFrame([(1, None, "a|b\nc")], "x int, y string, `z z` string")
    assert df.select(tx.row_text(df.columns)).first()[0] == "x: 1 | y: None | z z: a|b\nc"


def test_first_line_and_truncation(spark):
    long = "x" * 301
    assert _values(spark, tx.first_line(F.col("t")), [("head\nrest",), ("y" * 60,)]) == ["head", "y" * 60]
    assert _values(spark, tx.truncated(F.col("t"), 300), [(long,), ("x" * 300,)]) == ["x" * 300 + "...", "x" * 300]


def test_final_response(spark):
    df = spark.createDataFrame([("done", "SELECT 1")], "s string, q string")
    plain = df.select(tx.final_response(F.col("s"), F.col("q"))).first()[0]
    debug = df.select(tx.final_response(F.col("s"), F.col("q"), True)).first()[0]
    assert plain == "done\n\nDetailed results:\n"
    assert debug == "SQL Query:\n```sql\nSELECT 1\n```\ndone\n\nDetailed results:\n"


def test_ids_repeat_and_differ(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("ab", "")], "x string, y string")
    ids = [r[0] for r in df.select(tx.prefixed_id("q-", F.col("x"), F.col("y"))).collect()]
    assert ids[0] == ids[1] != ids[2] and ids[0].startswith("q-")


def test_relative_dates_and_ranges(spark):
    today = dt.date(2025, 5, 3)
    rows = [(dt.datetime(2025, 5, 3, 0, 0),), (dt.datetime(2025, 5, 2, 23, 59),), (dt.datetime(2025, 4, 30, 1),), (None,)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    labels = [r[0] for r in df.select(tm.relative_date(F.col("ts"), today)).collect()]
    assert labels == ["Today", "Yesterday", "2025-04-30", None]
    assert df.where(tm.on_date(F.col("ts"), dt.date(2025, 5, 2))).count() == 1
    filled = df.select(tm.created_or(F.col("ts"), dt.datetime(2030, 1, 1))).collect()
    assert filled[3][0] == dt.datetime(2030, 1, 1)


def test_parse_time(spark):
    got = _values(spark, tm.parse_time(F.col("t")), [("2025-05-02T04:16:35.000001",), ("2025-05-02 04:16:35",), ("no",)])
    assert got == [dt.datetime(2025, 5, 2, 4, 16, 35, 1), dt.datetime(2025, 5, 2, 4, 16, 35), None]


VECTORS = [([1.0, 2.0], [2.0, 4.0], 1.0), ([1.0, 0.0], [0.0, 3.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([], [], 0.0), (None, [1.0], 0.0)]


def test_cosine_and_norm(spark):
    df = spark.createDataFrame([v[:2] for v in VECTORS], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vc.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([v[2] for v in VECTORS])
    assert df.select(vc.l2_norm(F.col("a"))).first()[0] == pytest.approx(math.sqrt(5))
    assert [r[0] for r in df.select(vc.mean_of(F.col("a"))).collect()][:2] == [1.5, 0.5]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abc é\n ", max_size=40), min_size=1, max_size=20))
def test_hashed_vectors_equal_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for dims in (1, 4, 256):
        got = [r[1] for r in df.select("i", vc.hashed_vector(F.col("t"), dims)).orderBy("i").collect()]
        for g, e in zip(got, hashed_vectors(texts, dims), strict=True):
            assert g == pytest.approx(e)


def test_word_bucket(spark):
    word = "straße"
    expected = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 256
    assert _values(spark, vc.word_bucket(F.col("t")), [(word,)]) == [expected]


def test_hashing_a_long_text_is_not_quadratic(spark):
    text = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([(text,)], "t string")
    weights = df.select(F.inline(vc.hashed_weights(F.col("t")))).collect()
    assert len(weights) == 256 and sum(w.weight**2 for w in weights) == pytest.approx(1.0)


def test_csv_header_is_quoted_like_the_rows(spark):
    import csv
    import io

    from shiftlens.sources.tables import csv_preview

    df = spark.createDataFrame([(1, "x,y", "plain")], 'a int, `b,c` string, `say "d"` string')
    text = csv_preview(df, ["a"], 5).first().csv_text
    assert list(csv.reader(io.StringIO(text))) == [["a", "b,c", 'say "d"'], ["1", "x,y", "plain"]]
