from __future__ import annotations

import random

from pyspark.sql import functions as F

from strataspark.llm import urls
from strataspark.llm.suite import URL_RULES


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut], rest[cut:]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fits:
        return host, path, None, default
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"))
    return host, path, best.host + best.path, best.verdict


URLS = [
    None, "", "no scheme", "http://", "http://com/", "https://EXAMPLE.com/en/x", "https://www.example.com/en/", "https://a.www.example.com/en",
    "ftp://x.net/es/y?://z", "x.net/fr/", "a://b.net/fr/#q", "a://b.net?/fr/", "a://b.net/fr", "http://notexample.com/en/a", "a://c.net/fr/../en/://d",
    "http://example.com", "http://example.com//en/", "http://exämple.com/en/", "a://u:p@example.com:80/en/",
]


def judged(spark, rules, listed=URLS, **more):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(listed)], "page_id long, url string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, rules, **more).collect()}


def test_rules_of_the_query(spark):
    got = judged(spark, URL_RULES)
    assert got == {i: brute(u, URL_RULES) for i, u in enumerate(URLS)}


def test_random_rules_by_trie_and_by_join(spark):
    rng = random.Random(2)
    hosts = ["a", "b.a", "c.b.a", "ba", "a.a", "c"]
    paths = ["", "/", "/x", "/x/", "/xy", "/x/y", "/x/yz/"]
    rules = [urls.UrlRule(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(25)]
    listed = [f"s://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'q', '?x', '/'])}" for _ in range(200)] + URLS
    want = {i: brute(u, rules, "block") for i, u in enumerate(listed)}
    assert judged(spark, rules, listed, default="block") == want
    assert judged(spark, rules, listed, default="block", broadcast_limit=10) == want


def test_repeated_rows_empty_tables_and_clashes(spark):
    df = spark.createDataFrame([(1, "a://com/", "h"), (1, "a://com/", "h")], "page_id long, url string, host string")
    for limit in (1 << 20, 0):
        got = urls.judge(df, URL_RULES, broadcast_limit=limit)
        assert got.columns.count("host") == 1
        assert [r.host for r in got.collect()] == ["com", "com"]
        assert urls.judge(df.filter(F.lit(False)), URL_RULES, broadcast_limit=limit).count() == 0
    assert {r.verdict for r in urls.judge(df, []).collect()} == {"allow"}
