from kbforge.llm import urls

URLS = [
    None, "", "no scheme", "http://example.net/en/1?x#y", "https://M.Example.NET/en/", "http://example.net/fr/a", "http://net/", "http://net",
    "http://a.b.org/fr/x?q=://z/", "http://org.example.com/de/1", "https://example.com/en/2", "x://b.net:80/a", "http://example.net./en/",
    "http://notexample.net/en/1", "http://" + "l." * 3000 + "net/" + "p" * 5000, "HTTP://É.ORG/fr/\n2", "http:///fr/", "http://example.net/en/1?x#y",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
    tail = rest[k:]
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]


def brute(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def check(spark, rules):
    pages = spark.createDataFrame([(i if i else None, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string").repartition(3)
    got = urls.judge(pages, urls.rule_table(spark, rules)).collect()
    want = [(i or None, *brute(u, rules)) for i, u in enumerate(URLS)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_rules_against_brute_force(spark):
    check(spark, urls.RULES)


def test_deep_nesting(spark):
    nested = [("block", "net", p) for p in ("/", "/e", "/en", "/en/1")] + [("allow", "example.net", "/en/1"), ("allow", "m.example.net", ""), ("block", "com", ""), ("allow", "example.com", "/d")]
    check(spark, nested)


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none).count() == 0
    pages = spark.createDataFrame([(1, "http://a.net/")], none.schema)
    assert urls.judge(pages, urls.rule_table(spark).limit(0)).collect()[0].verdict == "allow"


def test_many_hosts_of_one_domain(spark, monkeypatch):
    rules = [("block", "com", "/"), ("allow", "x7.com", "/a"), ("allow", "com", "/only/some/")]
    hosts = [f"http://x{i % 1500}.com/{'a' if i % 3 else ''}" for i in range(4000)] + ["http://x1.com/"] * 2500
    swept = []
    real = urls.materialize

    def seen(df, name="table"):
        out = real(df, name)
        if name == "url-ranges":
            swept.append(out.count())
        return out

    monkeypatch.setattr(urls, "materialize", seen)
    pages = spark.createDataFrame(list(enumerate(hosts)), "page_id long, url string").repartition(4)
    got = {r.page_id: tuple(r)[1:] for r in urls.judge(pages, urls.rule_table(spark, rules)).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(hosts)}
    # Each host with its path, the domain with each path, the rules.
    assert swept[0] <= len(set(hosts)) + 2 + len(rules)
