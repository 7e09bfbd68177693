import pytest

from batchloom.llm.queries import URL_RULES
from batchloom.llm.url_filter import judge_urls, page_links, rules_table

PAGES = [
    (1, "https://blog.example.com/en/1", None),
    (2, "https://www.example.com/en/1", ""),
    (3, "http://WWW.Example.COM/de/1?x#y", None),
    (4, "https://shop.net/es/2", "<p>"),
    (5, "https://a.org/x", '<link rel="canonical" href="https://shop.net/es/2">'),
    (6, "https://b.org/y", "<LINK HREF='//a.org/x#top' REL=canonical>"),
    (7, "https://c.org/dir/z?q=1", '<meta http-equiv="refresh" content="0; url=/w">'),
    (8, "https://c.org/w", '<link rel="canonical" href="http://b.org/y">'),
    (9, "https://d.org/x", '<link rel="canonical" href="https://blog.example.com/en/1">'),
    (10, "https://d.org/y", '<link rel="canonical" href="https://d.org/x">'),
    (11, "https://e.org/dir/x", '<link rel="canonical" href="y?a=1&amp;b=2">'),
    (12, "https://e.org/dir/y?a=1&b=2", '<link rel="canonical" href="https://com/z">'),
    (13, "https://f.org/1", '<link rel="canonical" href="https://net/fr/1"><link rel="canonical" href="https://x.com/1">'),
    (14, None, '<link rel="canonical" href="https://net/fr/1">'),
    (15, "no scheme/net/es/", '<link rel="canonical" href="https://net/fr/1">'),
    (16, "https://net?x", '<link rel="canonical" href="mailto:a@b.c">'),
    (17, "https:///path", None),
    (18, "x://net/fr/", None),
    (19, "https://g.org/only", '<link rel="stylesheet" href="https://net/fr/1">'),
    (20, "https://xnet/fr/1", None),
    (20, "https://xnet/fr/1", None),
    (None, "https://net/fr/1", None),
    (21, "https://h.org", '<link rel="canonical" href="https://h.org/"><link rel=canonical href=next>'),
    (22, "https://h.org/next", '<link rel="canonical" href="https://net/es/">'),
]
EXPECTED = {
    1: ("example.com/en/", "block"),
    2: ("www.example.com/en/", "allow"),
    3: ("com/", "allow"),
    4: ("net/es/", "block"),
    5: (None, "block"),
    6: (None, "block"),
    7: (None, "block"),
    8: (None, "block"),
    9: (None, "block"),
    10: (None, "block"),
    11: (None, "allow"),
    12: (None, "allow"),
    13: (None, "allow"),
    14: (None, "allow"),
    15: (None, "allow"),
    16: (None, "allow"),
    17: (None, "allow"),
    18: ("net/fr/", "block"),
    19: (None, "allow"),
    20: (None, "allow"),
    None: ("net/fr/", "block"),
    21: (None, "block"),
    22: (None, "block"),
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        [(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, node string, verdict string"
    )


def test_rules_and_aliases(pages):
    rows = judge_urls(pages, URL_RULES).collect()
    assert len(rows) == len(PAGES)
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in rows} == EXPECTED
    parts = {r["page_id"]: (r["host"], r["path"]) for r in rows}
    assert parts[3] == ("www.example.com", "/de/1")
    assert parts[14] == parts[15] == ("", "") and parts[16] == ("net", "") and parts[17] == ("", "/path")
    assert {r["node"] for r in rows} == {"clash"}


def test_links(pages):
    found = {(r["source"], r["target"]) for r in page_links(pages).collect()}
    assert ("https://c.org/dir/z?q=1", "x://c.org/w") in found
    assert ("https://e.org/dir/x", "x://e.org/dir/y?a=1&b=2") in found
    assert not any(s == "https://g.org/only" for s, _ in found)


def test_longest_rule_wins_then_the_host(spark):
    df = spark.createDataFrame([("https://x.com/ab/",), ("https://x.com/",)], "url string")
    rules = [("block", "com/ab/"), ("allow", "x.com/a"), ("block", "x.com/ab/"), ("allow", "x.com/ab/")]
    got = {r["url"]: (r["rule"], r["verdict"]) for r in judge_urls(df, rules, html_col=None).collect()}
    assert got == {"https://x.com/ab/": ("x.com/ab/", "allow"), "https://x.com/": (None, "allow")}


def test_redirects_in_a_hub_and_a_chain(spark):
    n = 300
    urls = [(f"https://s{i}.org/",) for i in range(n)] + [(f"https://c{i}.org/",) for i in range(n)]
    hub = [(u, "https://bad.net/es/") for (u,) in urls[:n]]
    chain = [(f"https://c{i}.org/", f"https://c{i + 1}.org/") for i in range(n)]
    links = spark.createDataFrame(hub + chain + [(None, "x"), ("y", None)], "source string, target string")
    pages = spark.createDataFrame(urls, "url string")
    got = judge_urls(pages, URL_RULES, html_col=None, redirects=links).collect()
    assert {r["verdict"] for r in got if r["url"].startswith("https://s")} == {"block"}
    assert {r["verdict"] for r in got if r["url"].startswith("https://c")} == {"allow"}


def test_nothing(spark, pages):
    assert judge_urls(pages.limit(0), URL_RULES).collect() == []
    assert {r["verdict"] for r in judge_urls(pages, []).collect()} == {"allow"}
    assert rules_table(spark, []).collect() == []


def test_no_python_in_the_plan(pages):
    plan = judge_urls(pages, URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
