import random

import pytest

from tallyfold.llm.queries import URL_RULES
from tallyfold.llm import common, urlfilter
from tallyfold.llm.urlfilter import canonical, judge_urls, page_links, rule_table, rules_of


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.index(c) for c in "?#" if c in path] + [len(path)])]


def plain_rule(url, rules=URL_RULES):
    host, path = plain_parts(url)
    fits = []
    for kind, text in rules:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(text), text, kind))
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme.org/", "http://Example.ORG/es/1", "http://a.example.org/en/12?x=1", "http://org/", "https://x.org", "ftp://b.com/fr/",
    "http://com/de/9#y", "http://example.org/en/2", "://weird.org/", "http://notexample.org/es/", "http://ÄB.com/de/", "a://b://c.org/x",
]


def test_own_rules_equal_brute_force(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(URLS)), "page_id int, url string").withColumn("html", F.lit(None).cast("string"))
    got = {r.page_id: r for r in judge_urls(df, rule_table(spark, URL_RULES)).collect()}
    for i, url in enumerate(URLS):
        rule, verdict = plain_rule(url)
        assert (got[i].host, got[i].path, got[i].rule) == (*plain_parts(url), rule)
        if verdict:
            assert got[i].verdict == verdict
    assert got[0].verdict == "allow" and got[0].alias_class is None


def test_spellings(spark):
    same = [
        ["http://www.a.com/p/", "https://a.com/p", "http://m.a.com:80/p/index.html", "https://A.com/p.html#x", "http://a.com/p?utm_source=q&ref=3"],
        ["http://a.com/p?b=2&a=1", "http://a.com/p/?a=1&b=2&fbclid=9"],
        ["http://m.com/"],
        ["no scheme"],
    ]
    flat = [(u, i) for i, group in enumerate(same) for u in group]
    from pyspark.sql import functions as F

    got = spark.createDataFrame(flat, "u string, i int").select("i", canonical(F.col("u")).alias("c")).collect()
    assert {len({r.c for r in got if r.i == i}) for i in range(len(same))} == {1}
    assert len({r.c for r in got}) == len(same)


def test_links_of_a_page(spark):
    from pyspark.sql import functions as F

    html = """<LINK href='/x' rel="canonical"><link rel=stylesheet href=http://no.com/><meta http-equiv="refresh" content="0; URL='https://b.com/y'">
      <link rel="canonical" href="//c.com/z"><a href="http://no.com/">canonical</a><link rel=canonical href="relative">"""
    df = spark.createDataFrame([("http://a.com/1?q", html), ("http://a.com/1", None), (None, html)], "u string, h string")
    got = [r.t for r in df.select(page_links(F.col("h"), F.col("u")).alias("t")).collect()]
    assert sorted(got[0]) == ["http://a.com/x", "http://c.com/z", "https://b.com/y"] and not got[1]


def page(i, url, to=None, meta=False):
    mark = f'<meta http-equiv=refresh content="0;url={to}">' if meta else f'<link rel="canonical" href="{to}">'
    return (i, url, mark if to else "<p>", "1", "2")


def test_decisions_reach_aliases_and_allow_goes_first(spark):
    rows = [
        page(1, "http://n1.net/a", "http://n2.net/b"),  # 1 - 2 - blocked page that only a link names
        page(2, "http://n2.net/b", "http://evil.com/de/1", meta=True),
        page(3, "http://n3.net/a", "http://evil.com/de/2"),  # linked with a blocked and with an allowed page
        page(4, "http://good.org/q", "http://n3.net/a"),
        page(5, "http://n5.net/a"),  # alone
        page(6, "https://www.n1.net/a/#top"),  # another spelling of 1
        page(7, "http://bad.com/de/7", "http://good.org/z"),  # own rule stays
        page(8, None, "http://evil.com/de/1"),
        page(6, "https://www.n1.net/a/#top"),
    ] + [page(100 + i, f"http://hub.net/{i}", "http://evil.com/de/hub") for i in range(50)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, spelling string, src string").repartition(4)
    got = sorted((r.page_id, r.verdict) for r in judge_urls(df, rule_table(spark, URL_RULES)).collect())
    want = {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "allow"}
    assert got[:9] == sorted([*want.items(), (6, "block")])
    assert {v for i, v in got[9:]} == {"block"} and len(got) == 59
    assert judge_urls(df.where("page_id = -1"), rule_table(spark, URL_RULES)).count() == 0
    given = spark.createDataFrame([("http://n5.net/a", "http://evil.com/de/5"), (None, None)], "src string, dst string")
    assert {r.page_id: r.verdict for r in judge_urls(df, rule_table(spark, URL_RULES), given).collect()}[5] == "block"


@pytest.mark.parametrize("small", [True, False])
def test_many_rules_equal_brute_force(spark, monkeypatch, small):
    if not small:  # the way of rule lists that are too long to broadcast, and of hot urls
        monkeypatch.setattr(urlfilter, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(common, "HOT_KEYS", 5)
    rng = random.Random(4)
    labels = ["a", "b", "ab", "x-y", "\u00e4", ""]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(rng.randint(1, n)))
    path = lambda: rng.choice(["", "/", "/a", "/a/", "/a/b", "/ab", "/b/\u00e4"])
    rules = list({(rng.choice(["allow", "block"]), host(3) + path()) for _ in range(1200)})
    plain = [(k, t if "/" in t else t + "/") for k, t in rules]
    urls = [f"http://{host(5)}{path()}{rng.choice(['', '?q', '#f'])}" for _ in range(800)] + ["http://b.a.b/a/b"] * 400 + [None, "a.b/a", "http://" + "a." * 3000 + "b/a"]
    seen = spark.createDataFrame([(*plain_parts(u), "x") for u in urls], "host string, path string, rule string").repartition(5)
    given = rule_table(spark, rules).union(spark.createDataFrame([("allow", None), (None, "a/"), ("other", "a/")], "kind string, rule string"))
    got = {(r.host, r.path): r for r in rules_of(seen, given.union(given)).collect()}
    assert sum(r.times for r in got.values()) == len(urls) and len(got) == len({plain_parts(u) for u in urls})
    for u in urls:
        h, p = plain_parts(u)
        fits = [(len(t), k, t) for (k, t), (_, w) in zip(rules, plain) for rh, _, rp in [w.partition("/")] if (h == rh or h.endswith("." + rh)) and p.startswith("/" + rp)]
        want = max(fits) if fits else (0, None, None)
        assert (got[h, p].own, got[h, p].rule) == want[1:], (u, got[h, p], want)
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id int, url string, html string").repartition(5)
    judged = {r.page_id: r for r in judge_urls(pages, given).collect()}
    assert len(judged) == len(urls)
    for i, u in enumerate(urls):
        r = got[plain_parts(u)]
        assert judged[i].rule == r.rule and judged[i].verdict == (r.own or judged[i].verdict)
    assert rules_of(seen, given.where("false")).where("own is not null or rule is not null").count() == 0
