import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clausework.llm.url_filter import RULES, filter_urls

URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x?y#z", "https://www.Example.COM/en/", "x://a.www.example.com/en/1", "http://example.com/enx", "http://notexample.com/en/", "http://a.net/es/", "http://net/fr/?q", "http://a.net/it/", "http://a.org?x=/en/", "http://b.com:80/", "http://com/", "http://com", "http://É.com/Ä", "http://a..com/en/", "http://example.com./en/", "http://x.net/es", "a://b.net/es/://c.com/", "http://h.com/" + "p/" * 20_000]


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:end], rest[end:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


@pytest.mark.parametrize("limit", [100_000_000, 0])
def test_urls(spark, limit):
    from clausework.llm import url_filter

    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("h.com", "/p/p/p", "block")], "host string, path string, verdict string")
    df = spark.createDataFrame([(i % 7, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    split = df.select(url_filter.host_of(df.url).alias("host"), url_filter.path_of(df.url).alias("path"))
    judged = {(r.host, r.path): (r.rule, r.verdict) for r in url_filter.judge_urls(split, rules, broadcast_bytes=limit).collect()}
    known = [r for r in RULES] + [("h.com", "/p/p/p", "block")]
    for u in URLS:
        host, path, rule, verdict = plain(u, known)
        assert judged[host, path] == (rule, verdict), u
    got = filter_urls(df, rules)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and got.count() == len(URLS) * 2
    assert filter_urls(df.where("false"), rules).count() == 0
    assert {r.verdict for r in filter_urls(df, rules.where("false")).collect()} == {"allow"}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="aA.com/en?#:é", max_size=24), min_size=1, max_size=30))
def test_any_urls(spark, urls):
    rules = [("com", "/", "allow"), ("a.com", "/e", "block"), ("om", "", "block"), ("a", "/en/n", "allow")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    df = spark.createDataFrame([(i, u) for i, u in enumerate(["http://" + u for u in urls] + urls)], "page_id long, url string")
    for r in filter_urls(df, table).collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, rules)


def test_hot_urls_and_long_hosts(spark, monkeypatch):
    """A URL and nulls in a third of the rows each, hosts of many thousand labels, and columns named like the operator's own."""
    from clausework.llm import url_filter

    monkeypatch.setattr(url_filter, "FREQUENT", 2)
    urls = ["http://www.example.com/en/x"] * 60 + [None] * 60 + [f"http://h{i % 20}.net/{'es' if i % 3 else 'de'}/{i % 9}" for i in range(60)] + ["http://" + "a." * 60_000 + "net/fr/"]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "_key long, url string, _host string, _often int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = filter_urls(df, rules).collect()
    assert sorted(r._key for r in got) == list(range(len(urls)))
    assert all((r.host, r.path, r.rule, r.verdict) == plain(urls[r._key], RULES) and (r._host, r._often) == ("h", 1) for r in got)
