from topolark.llm import urlfilter as uf

URLS = [
    "http://a.example.com/en/825?p=1", "https://example.com/en/7x", "HTTP://EXAMPLE.Com/en/70#t", "https://x.example.net/de/8", "https://net/de/9", "https://notnet/de/9", "http://blog.spam-farm.example.org/fr/1",
    "http://spam-farm.example.org", "http://xspam-farm.example.org/", "https://a.org/es/", None, "", "no scheme", "x://", "://h/p", "http://h?q/en/", "http://É.com/en/", "http://" + "a." * 3000 + "com/en/", "http://com/en/", "http://a..com/en/#",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def under(host, domain):
    return host == domain or host.endswith("." + domain)


def expected(url, domains):
    host, path = parts(url)
    fits = [r for r in uf.RULES if under(host, r.host) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.host + r.path), default=None)
    listed = any(under(host, d) for d in domains)
    return host, path, rule and rule.host + rule.path, rule.verdict if rule else "block" if listed else "allow"


def test_verdicts(spark):
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)], "page_id long, url string, host string, rest_ string")
    out = uf.judge(df)
    for r in out.collect():
        assert (r.host, r.path, r.rule, r.verdict) == expected(URLS[r.page_id], uf.DOMAINS)
        assert r.rest_ == "y"


def test_membership_is_exact_for_many_keys_and_shards(spark):
    hosts = [f"h{k}.d{k % 400}.t{k % 7}" for k in range(4000)]
    domains = [f"d{k}.t{t}" for k in range(0, 400, 3) for t in range(7)] + [f"h{k}.d{k % 400}.t{k % 7}" for k in range(0, 4000, 5)]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    for most in (uf.MOST_BYTES, 700):
        found = {r.host: r.listed for r in uf.blocked(df, tuple(domains), most).collect()}
        wanted = set(domains)
        assert found == {h: h in wanted or h.split(".", 1)[1] in wanted for h in hosts}


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert uf.judge(df).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert uf.judge(one, domains=()).first().verdict == "allow"
    assert uf.judge(one, rules=(), domains=("A.b", None, "")).first().verdict == "block"
