import re

from pyspark.sql import functions as F

from footmark.llm.url_filter import PLACE_RULES, compiled, indexed, judge, rule_table

URLS = [
    "https://a.example.org/es/1", "https://EXAMPLE.org/en/1x", "http://example.org/en/2", "http://notexample.org/es/",
    "http://fr.example.com/fr/x?q#f", "http://com/de/", "http://x.com/DE/", "http://x.com", "http://x.com?/de/", "x.com/de/",
    "", None, "://", "http://", "a://b://c.org/d", "http://b.net/p?utm_source=feed", "http://b.net/p?utm_source=feedback",
    "http://ads.b.net/x", "http://b.net/ads.x", "http://b.net/banner/1/img", "http://b.net/cgi-bin/x", "http://b.net/y.exe",
    "http://ads.b.net/robots.txt", "http://example.org:80/es/", "http://ü.org/", "http://b.net/\n/cgi-bin/", "http://" + "a" * 5000 + ".org/",
]


def place(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(url):
    host, path = place(url)
    whole = host + (url or "").split("://", 1)[1][len(host):] if "://" in (url or "") else url or ""
    fits = []
    for rule, action in PLACE_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((-len(rule), rule, action))
    if fits:
        return host, path, min(fits)[1], min(fits)[2]
    sep = r"(?:[^A-Za-z0-9_.%-]|\Z)"
    block = (re.search(r"\A(?:[^/?#]*\.)?(?:ads|tracker)\.[\s\S]*" + sep, whole) or re.search(r"/banner/[\s\S]*/img" + sep, whole)
             or re.search(r"[^A-Za-z0-9_.%-]utm_source=feed" + sep, whole) or "/cgi-bin/" in whole or whole.endswith(".exe"))
    return host, path, None, "block" if block and not whole.endswith("/robots.txt") else "allow"


def test_every_url_equals_brute_force(spark):
    rows = [(i, u, "h", "t") for i, u in enumerate(URLS)] + [(0, URLS[0], "h", "t"), (None, URLS[1], "h", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, tokens string")
    got = judge(pages, rule_table(spark)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *brute(u)) for i, u, *_ in rows), key=key)
    assert judge(pages.where("false"), rule_table(spark)).count() == 0


def test_rules_are_stored_under_their_rarest_whole_token(spark):
    assert compiled("example.org/en/1", "block", True).tokens == ("example", "org", "en")
    assert compiled("/ban*ner/img^", "block").tokens == ("img",)
    assert compiled("1*", "block").tokens == ()
    urls = spark.createDataFrame([(["example", "org", "en"], 1), (["org"], 1), (["example", "org"], 1)], "tokens array<string>, n long")
    rules = rule_table(spark, PLACE_RULES, (("1*", "block"),))
    got = {r.rule: r.token for r in indexed(rules, urls).select("rule", "token").collect()}
    assert got["example.org/en/1"] == "en" and got["org/"] == "org" and got["1*"] == "" and got["com/fr/"] == "com"


def test_a_rule_without_tokens_still_meets_every_url(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x1y"), (2, "http://a.b/x")], "page_id long, url string")
    got = judge(pages, rule_table(spark, (), (("1*", "block"),))).orderBy("page_id").select(F.col("verdict")).collect()
    assert [r[0] for r in got] == ["block", "allow"]
