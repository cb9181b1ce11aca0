import random

from ticktide.llm import url_filter


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def best(host, path, rules):
    fits = [(len(h) + len(p), len(h), not a, h + p) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=None)


def check(spark, urls, rules):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = url_filter.judge(df, spark.createDataFrame(rules, "host string, path string, allow boolean")).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = parse(r.url)
        hit = best(host, path, rules)
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == ((hit[3], "block" if hit[2] else "allow") if hit else (None, "allow")), r


def test_random_rules_match_brute_force(spark):
    rng = random.Random(4)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "xa.com", "org", "a.org", "a-b.com", "A.COM", "", "com.", "..com"]
    paths = ["", "/", "/e", "/en", "/en/", "/en/7", "/en/78/x", "/é", "/z?q=/en", "?x", "#y", "/EN/"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=://b', '#c'])}" for _ in range(400)]
    urls += [None, "", "no scheme/x", "://", "http://", "HTTP://WWW.A.com/en/9", "mailto:x"] + ["http://hot.com/en/" + "x" * 50] * 200
    rules = [(h.lower(), p, rng.random() < 0.5) for h in hosts[:8] for p in ("", "/", "/en/", "/en/7", "/é") if rng.random() < 0.6]
    check(spark, urls, sorted(set(rules)))


def test_clashing_verdicts_block_and_no_rules_allow(spark):
    check(spark, ["http://a.b/c", "http://b/"], [("b", "/", True), ("b", "/", False)])
    pages = spark.createDataFrame([(1, "http://a.b/c", "keep"), (1, "http://a.b/c", "keep"), (None, None, None)], "page_id long, url string, rule_id string")
    out = url_filter.judge(pages, spark.createDataFrame([], "host string, path string, allow boolean"))
    assert [r.verdict for r in out.collect()] == ["allow"] * 3 and "rule_id" in out.columns
    assert url_filter.judge(pages.limit(0), spark.createDataFrame([("b", None, True)], "host string, path string, allow boolean")).count() == 0


def test_hosts_with_very_many_labels(spark):
    check(spark, ["http://" + "x." * 5000 + "com/en/", "http://" + "y" * 100_000 + ".com/p"], [("com", "/en/", False), ("x.com", "/en", True)])
