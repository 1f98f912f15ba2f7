from __future__ import annotations

import pytest

from attestra.llm import urls
from attestra.llm.queries import URL_RULES

CASES = [
    None, "", "no scheme", "http://Example.COM/en/1", "http://a.example.com/en/1?q=/es/", "https://www.example.com/en/x#y",
    "https://b.www.example.com/en/x", "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/es", "http://x.com",
    "http://x.com?/en/", "ftp://a://b/c", "http://X.É.net/fr/é", "http://x.net:80/es/1", "http://com.org/en/", "://com/", "http:///en/",
    "http://spam-farm.example.org/en/1", "http://x.org/" + "a" * 20000, "http://casino-pills.example.org/buy", "http://q.net/es/\n/x",
]


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


@pytest.fixture(scope="module")
def model(spark):
    return urls.fit(urls.labelled_urls(spark))


def test_rules_and_parts(spark, model):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(CASES)], "page_id long, url string, host string, _terms int")
    got = {r.page_id: r for r in urls.judge(pages, model, URL_RULES).collect()}
    assert len(got) == len(CASES)
    for i, url in enumerate(CASES):
        host, path, rule, verdict = brute(url)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= urls.THRESHOLD else "allow"))
    assert urls.judge(pages.limit(0), model, URL_RULES).count() == 0


def test_model_generalises_to_other_urls(spark, model):
    rows = [
        (1, "http://best-casino.example/bonus", 1), (2, "http://www.cheap-pills.example.org/x", 1), (3, "http://porn.example/xxx", 1),
        (4, "http://news.example/2021/05/story.html", 0), (5, "http://library.example/about", 0), (6, "http://history.example/topics/", 0),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, label int")
    got = {r.page_id: r.score > 0.5 for r in urls.judge(pages, model).collect()}
    assert got == {i: bool(label) for i, _, label in rows}


def test_repeated_rows_stay(spark, model):
    pages = spark.createDataFrame([(None, "http://a.com/"), (None, "http://a.com/")], "page_id long, url string")
    assert [r.rule for r in urls.judge(pages, model, URL_RULES).collect()] == ["com/", "com/"]
