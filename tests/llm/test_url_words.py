"""Rules, word cutting and the model behind the URL filter."""

from shiftlens.llm.url_words import RULES, Segmenter, judge_urls, vocabulary_of

SCHEMA = "page_id bigint, url string, rule string"


def _judged(spark, urls):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], SCHEMA)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages).collect()}


def _expected(url):
    """Host, path, rule and its verdict, by plain string handling."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    best = None
    for h, p, v in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, *(best or (None, None))


URLS = [
    "http://www.EXAMPLE.com/en/1", "https://example.com/en/", "http://blog.example.com/en/3?x=/", "http://com/", "http://x.com", "http://x.com?a=/",
    "http://a.b.net/es/1", "http://net/fr/", "http://a.net/en/1#/es/", "http://notnet/es/", "http://xexample.com/en/", "nothing", None, "", "://", "a://b://c.com/",
    "http://É.com:80/ü", "http://user@x.net/es/é?q", "http://x.net/es", "http://www.example.com/en", "http://x.org/" + "a" * 5000,
]


def test_rules_against_plain_code(spark):
    got = _judged(spark, URLS)
    for i, url in enumerate(URLS):
        host, path, rule, verdict = _expected(url)
        assert got[i][:3] == (host, path, rule), url
        assert verdict is None or got[i][3] == verdict, url
    assert got[11] == ("", "", None, "allow") and got[12] == ("", "", None, "allow")


def test_model_blocks_run_together_names(spark):
    good = [f"http://{n}.example.org/en/{i}" for i, n in enumerate(["thegarden", "citybooks", "ththre", "www.tionsh", "m.ther"] * 40)]
    bad = ["http://www.cheappills.example.org/en/1", "http://casinowin.example.org/x", "https://spam-farm.example.org/", "http://freebets.example.org/en/3"]
    got = _judged(spark, good + bad)
    assert {got[i][3] for i in range(len(good))} == {"allow"}
    assert {got[len(good) + i][3] for i in range(len(bad))} == {"block"}


def test_cutting():
    s = Segmenter({"tionsh": 3})
    assert s.cut("cheappills") == ("cheap", "pills") and s.cut("tionsh") == ("tionsh",) and s.cut("onlinecasinowin") == ("online", "casino", "win")


def test_names_do_not_vouch_for_themselves(spark):
    """Three words run together, and one name under many subdomains or endings, are cut all the same."""
    good = [f"http://{n}.example.org/en/{i}" for i, n in enumerate(["thegarden", "citybooks", "ththre", "www.tionsh", "m.ther"] * 40)]
    bad = ["http://onlinecasinowin.org/"] + [f"http://s{i}.cheappills.org/" for i in range(40)] + [f"http://freebets.e{i}.org/" for i in range(20)]
    got = _judged(spark, good + bad)
    assert {got[i][3] for i in range(len(good))} == {"allow"}
    assert {got[len(good) + i][3] for i in range(len(bad))} == {"block"}


def test_words_of_other_names_stay_whole(spark):
    pages = spark.createDataFrame([(f"essex.{c}.org",) for c in "abc"] + [("essex.org",)], "host string")
    assert {r.word: r.n for r in vocabulary_of(pages).collect()} == {"essex": 3}


def test_long_runs_are_cut_and_no_token_is_left_out(spark):
    long = "garden" * 20
    hosts = [f"http://w{''.join(chr(97 + int(d)) for d in str(i))}.org/" for i in range(300)]
    got = judge_urls(spark.createDataFrame([(i, u, "") for i, u in enumerate([*hosts, f"http://{long}casino.org/", f"http://{'coffee' * 20}farm.org/"])], SCHEMA))
    verdict = {r.page_id: (r.verdict, r.score) for r in got.collect()}
    assert verdict[300][0] == "block" and verdict[301][0] == "allow"


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], SCHEMA)).count() == 0
