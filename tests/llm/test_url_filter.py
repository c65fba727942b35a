import random
import re

from sessionlogs.llm import url_filter
from sessionlogs.llm.queries import SITE_RULES

PAGES = "page_id long, url string, fit string, token string"
RULES = [*SITE_RULES, *url_filter.JUNK_HOSTS]


def brute(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if re.search(r.pattern, host + path)]
    best = min(fits, key=lambda r: (-r.rank, r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def judged(spark, urls, rules=RULES):
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], PAGES)
    return [(r.host, r.path, r.fit, r.verdict) for r in url_filter.judge(df, "url", rules).orderBy("page_id").collect()]


CASES = [
    None, "", "no scheme/en/", "://", "http://", "http://example.com", "http://example.com/en/", "HTTPS://WWW.EXAMPLE.COM/en/x?y#z", "http://a.www.example.com/en/",
    "http://notexample.com/en/", "http://example.com/EN/", "http://x.net/es/1", "http://net/es/", "http://x.net/es", "http://x.net?/es/", "http://x.net#/fr/", "x://a://b/en/",
    "http://casino-win.net/", "http://my.casino.org", "http://casinos.net/", "http://free-bets.example.net/de/", "http://free.bets.net/", "http://freebets.net/", "http://m.ads-track.example.com/de/",
    "http://a\nb.net/fr/", "http://user@x.net:80/fr/", "http://" + "a" * 50_000 + ".com/" + "b/" * 20_000,
]


def test_urls(spark):
    assert judged(spark, CASES) == [brute(u, RULES) for u in CASES]


def test_random_urls_and_rules(spark):
    rng = random.Random(3)
    labels, parts = ["a", "b", "example", "com", "net", "www"], ["en", "es", "x1", "deep"]
    rules = [url_filter.site_rule(rng.choice(["allow", "block"]), ".".join(rng.choices(labels, k=rng.randint(1, 3))), rng.choice(["/", "/en/", "/es/x", "/x1/deep/", ""])) for _ in range(40)]
    rules = list({r.name: r for r in rules}.values())
    urls = [f"http://{'.'.join(rng.choices(labels, k=rng.randint(1, 4)))}/{'/'.join(rng.choices(parts, k=rng.randint(0, 3)))}" for _ in range(300)]
    assert judged(spark, urls, rules) == [brute(u, rules) for u in urls]


def test_rules_are_filed_under_their_rarest_token(spark):
    counts = url_filter.token_counts(spark.createDataFrame([(1, "http://a.com/en/"), (2, "http://b.com/en/"), (3, "http://a.com/")], "i long, url string"), "url", ["a", "com", "en", "zz"])
    assert counts == {"a": 2, "com": 3, "en": 2}


def test_empty_table(spark):
    assert judged(spark, []) == []
