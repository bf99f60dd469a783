"""Main text of pages."""

from pyspark.sql import functions as F

from shiftlens.llm.site_template import blocks_of, extract_main_text

SCHEMA = "page_id bigint, url string, html string, text string"


def _texts(spark, rows, **kw):
    pages = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return {r.page_id: (r.text, r.n_chars) for r in extract_main_text(pages, **kw).collect()}


def _plain(page):
    return [text for text, _, _ in blocks_of(page)]


def test_article_without_its_surroundings(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a>Menu</a></nav>"
        "<header>Site</header><div class='cookie-notice'>We use</div><aside>Side</aside><article><h1>A &amp; B</h1>"
        "<p>one\n two<br>three<p>fo<b>ur</b> &copy;<form><input>send</form><div class=comments><p>nice</p></div></article>"
        "<div class='ad'>Buy</div><footer>F</footer></body></html>"
    )
    assert _texts(spark, [(1, "http://a/x", page)]) == {1: ("A & B one two three four ©", 26)}


def test_recurring_subtrees_go_and_others_stay(spark):
    rows = [(i, "http://h.example/p", f"<body><div><p>Same on all</p></div><div><p>Own {i}</p></div></body>") for i in range(8)]
    rows += [(100, "http://other.example/", "<body><div><p>Same on all</p></div></body>")]
    got = _texts(spark, rows, min_pages=5)
    assert got[3] == ("Own 3", 5) and got[100] == ("Same on all", 11)


def test_article_keeps_what_recurs(spark):
    rows = [(i, "http://h/", f"<article><p>Licence</p><p>{i}</p></article>") for i in range(9)]
    assert _texts(spark, rows, min_pages=3)[4] == ("Licence 4", 9)


def test_recurring_subtrees_go_inside_main_areas_and_articles(spark):
    """Unnamed template in a main area, and lists of links in an article, are told by the count."""
    bar = "<ul><li><a href=/a>Top ten</a><li><a href=/b>Latest news</a></ul>"
    rows = [(i, "http://h/", f"<main><div><p>Call us now</p></div><p>Own {i}</p></main>") for i in range(8)]
    rows += [(10 + i, "http://g/", f"<article><h1>T</h1><p>Text {i}</p>{bar}<p>Licence</p></article>") for i in range(8)]
    rows += [(30, "http://few/", f"<article><p>Text</p>{bar}</article>"), (31, "http://few/", "<main><div><p>Call us now</p></div></main>")]
    got = _texts(spark, rows, min_pages=5)
    assert got[3] == ("Own 3", 5) and got[13] == ("T Text 3 Licence", 16)
    assert got[30][0] == "Text Top ten Latest news" and got[31][0] == "Call us now"


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://h/", "<main><div><p>One text</p></div><p>More</p></main>") for i in range(30)]
    assert set(_texts(spark, rows, min_pages=5).values()) == {("One text More", 13)}


def test_nulls_repeats_and_broken_markup(spark):
    rows = [(None, None, None), (1, None, ""), (2, "no host", "<p>a < b <i>c"), (2, "no host", "<p>a < b <i>c"), (3, "http://x", "<div class='x>")]
    got = extract_main_text(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).collect()
    assert len(got) == 5
    assert {(r.page_id, r.text) for r in got} == {(None, ""), (1, ""), (2, "a < b c"), (3, "")}


def test_blocks():
    assert _plain("<ul><li>a<li>b</ul>x<!-- c --> y<textarea>z</textarea>") == ["a", "b", "x y"]
    assert _plain("<p>" + "long " * 50_000) == [("long " * 50_000).strip()]
    assert _plain("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert _plain("<div hidden>no</div><div style='display: none'>no</div>&#x41;&lt;&amp") == ["A<&"]


def test_empty_table(spark):
    assert extract_main_text(spark.createDataFrame([], SCHEMA)).select(F.count("*")).first()[0] == 0
