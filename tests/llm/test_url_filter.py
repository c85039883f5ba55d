import random

from tessella.llm import url_filter as U

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judge(url, rules):
    host, path = parse(url)
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[4]) if fit else (host, path, None, "allow")


URLS = [
    None, "", "example.com/en/", "http://", "http:///en/", "http://example.com", "http://EXAMPLE.com/en/", "https://www.example.com/en/a?b#c", "http://a.www.example.com/en/x",
    "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/es", "http://x.net?/es/", "http://É.COM/\n/en/", "http://a..com/", "ftp://a.b.c.d.e.f.com/en/en/", "http://com/#://b.net/fr/",
]


def run(spark, urls, rules, **more):
    pages = spark.createDataFrame([(k, u, "r") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    got = U.url_filter(pages, U.rule_table(spark, rules), **more).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == [(k, *judge(u, rules)) for k, u in enumerate(urls)]


def test_contract_rules(spark):
    run(spark, URLS, RULES)


def test_random_rules_with_and_without_broadcast(spark):
    rng = random.Random(4)
    hosts = [".".join(rng.choice(["a", "b", "com"]) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    paths = ["".join(rng.choice(["/", "x", "y", "/x"]) for _ in range(rng.randrange(5))) for _ in range(60)]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in zip(hosts, paths, strict=True)}.values())
    urls = [f"http://{rng.choice(hosts)}.{rng.choice(hosts)}/{rng.choice(paths)}" for _ in range(200)] * 2
    run(spark, urls, rules)
    run(spark, urls, rules, broadcast_rules=0)


def test_empty_tables(spark):
    run(spark, URLS, [("", "/", "block")])
    assert U.url_filter(spark.createDataFrame([], "page_id long, url string"), U.rule_table(spark, RULES)).count() == 0


def test_very_long_urls_and_clashing_columns(spark):
    long = ["http://x.net/es/" + "/" * 20_000, "http://" + "a." * 20_000 + "net/fr/", "http://www.example.com/" + "en/" * 5_000, "://" + "x" * 100_000]
    run(spark, [*long, *URLS], [*RULES, ("net", "/es/" + "/" * 30, "allow"), ("net", "", "block"), ("net", "/es/x", "allow")])
    pages = spark.createDataFrame([(1, "http://a.com/", "h", "p", "r", "v", 5)], "page_id int, url string, host string, path string, rule string, verdict string, prefix int")
    got = U.url_filter(pages, U.rule_table(spark, RULES)).collect()
    assert [tuple(r.asDict().values()) for r in got] == [(1, "http://a.com/", "a.com", "/", 5, "com/", "allow")]
