"""Longest match against a plain scan of all rules, and the query against SQL."""

import random
import re

import duckdb
import pytest

import check
from folioscope.llm import queries, url_rules

SF = "/root/testdata/sf0.001"


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return low, re.match(r"[^?#]*", rest[len(host):])[0]


def plain(rules, host, path, default="allow"):
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(h), len(p), v == "block")
            if best is None or rank > best[0]:
                best = (rank, h + p, v)
    return (best[1], best[2]) if best else (None, default)


URLS = [None, "", "no scheme", "http://", "https://a.example.net/en/1", "https://EXAMPLE.NET/en/", "http://example.net/en", "x://example.net",
        "http://example.net?x=/en/", "http://myexample.net/", "http://net/", "http://a.org/fr/x#y", "http://a.org/FR/", "a://b://org/fr/",
        "http://example.com/de/..?q#f", "http://example.com:80/de/", "http://user@org/fr/", "http://.net/", "http://net./", "http://É.ORG/fr/",
        "http://a.b.c.d.e.example.com/de/" + "x/" * 5000, "line\nhttp://org/fr/\nmore"]


def test_odd_urls(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(4, URLS[4], "y")], "page_id long, url string, host string")
    got = url_rules.judge(df, queries.RULES)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path = cut(r["url"])
        assert tuple(r)[2:] == (host, path, *plain(queries.RULES, host, path)), r
    assert url_rules.judge(df.limit(0), queries.RULES).count() == 0
    assert url_rules.judge(df, [], default="block").where("verdict = 'block' AND rule IS NULL").count() == len(rows)


@pytest.mark.parametrize("seed", range(5))
def test_random_rules(seed):
    draw = random.Random(seed)
    host = lambda: ".".join(draw.choice("ab") for _ in range(draw.randrange(1, 4)))
    path = lambda: "".join(draw.choice(["/", "/x", "/xy", "/y/"]) for _ in range(draw.randrange(4)))
    rules = [(host(), path(), draw.choice(["allow", "block"])) for _ in range(30)]
    trie = url_rules.build(rules)
    for _ in range(1000):
        h, p = host(), path()
        assert (url_rules.look_up(trie, h, p) or (None, "allow")) == plain(rules, h, p)


def test_query(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = queries.QUERIES["op6_url_rules"](spark, SF)
    result = db.execute(queries.SQL["op6_url_rules"])
    assert check.rows(got.columns, got.collect()) == check.rows([d[0] for d in result.description], result.fetchall())
    assert {r["verdict"] for r in got.collect()} == {"allow", "block"}


def test_refused():
    with pytest.raises(ValueError):
        url_rules.build([("a", "/", "maybe")])
