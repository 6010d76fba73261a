"""URL rules against a search over all rules."""

import random

from sparkmail.llm.url_filter import judge_urls


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def run(spark, urls, rules, **options):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, table, **options).collect()}


def test_random_nested_rules(spark):
    rng = random.Random(1)
    labels = ["a", "b", "ab", "é", "x-1", "com"]

    def some_host():
        return ".".join(rng.choices(labels, k=rng.randrange(1, 5)))

    def some_path():
        return "/" + "/".join(rng.choices(["", "a", "ab", "é", "1"], k=rng.randrange(0, 4)))

    rules = [(rng.choice(["allow", "block"]), some_host(), some_path()) for _ in range(120)]
    urls = [rng.choice(["http", "https", "", "x://y"]) + "://" + rng.choice([str.upper, str])(some_host()) + some_path()
            + rng.choice(["", "?q=/a", "#/b", "?a#b"]) for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "http://?x", "http://a", "http://.a./", "http://a..b/1", urls[0], urls[0]]
    assert run(spark, urls, rules) == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert run(spark, urls, rules, default="block") == {i: brute(u, rules, "block") for i, u in enumerate(urls)}


def test_empty_tables_and_bad_rules(spark):
    urls = ["http://a.com/x", None, "http://b.org/" + "y" * 100_000]
    assert run(spark, urls, []) == {i: brute(u, []) for i, u in enumerate(urls)}
    rules = [(None, "com", "/"), ("block", None, "/"), ("block", "", "/"), ("block", "com", None), ("block", "org", "/" + "y" * 2000)]
    assert run(spark, urls, rules) == {i: brute(u, rules[-1:]) for i, u in enumerate(urls)}
    assert run(spark, [], rules) == {}
