import time

import pytest

from telemill.llm import url_filters
from telemill.llm.queries import URL_RULES

URLS = [None, "", "no scheme", "http://a.example.net/en/x", "http://EXAMPLE.NET/en/", "https://example.net/en", "http://net", "http://net/", "http://a.b.net?x=/en/", "http://example.com/de/1#x", "http://aexample.com/de/", "https://w.org/fr/", "https://w.org/en/", "x://y://z.net/", "http://example.net/en/?q", "http:///path", "http://a.net\x00b/x", "http://b.net/\x00/", "http://é.net/é/"]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, default)


@pytest.mark.parametrize("most", [1000, 0])
def test_verdicts_equal_brute_force(spark, most):
    rules = [*URL_RULES, ("example.com", "/de/1", "allow"), ("w.org", "/f", "block"), ("net", "/", "block")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    got = url_filters.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), rules_broadcast=most)
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {(i, *brute(u, rules)) for i, u in enumerate(URLS * 2)}


def test_empty_tables(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filters.judge(pages.limit(0), rules).count() == 0
    assert url_filters.judge(pages, rules.limit(0), default="block").first().verdict == "block"


def test_long_urls_and_many_labels(spark):
    long = ["http://a.net/" + "x/" * 500_000, "http://" + "a." * 300_000 + "net/y", "x" * 1_000_000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(long)], "page_id long, url string")
    rules = spark.createDataFrame([*URL_RULES, ("a.net", "/x/x/", "allow")], "host string, path string, verdict string")
    url_filters.judge(pages.limit(1), rules).collect()
    began = time.perf_counter()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(pages, rules).collect()}
    assert got == {0: ("a.net/x/x/", "allow"), 1: ("net/", "block"), 2: (None, "allow")} and time.perf_counter() - began < 30


def test_rule_host_longer_than_the_urls(spark):
    pages = spark.createDataFrame([(1, "http://net/"), (2, "http://xnet/"), (3, "http://a.b.c.net/fr")], "page_id long, url string")
    rules = spark.createDataFrame([("b.c.net", "/", "block"), ("c.net", "/f", "allow"), (None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string")
    assert {r.page_id: r.rule for r in url_filters.judge(pages, rules).collect()} == {1: None, 2: None, 3: "b.c.net/"}
