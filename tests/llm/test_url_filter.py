import math

from gaugewell.llm import common
from gaugewell.llm.catalog import URL_RULES
from gaugewell.llm.url_filter import judge

PAGES = [
    (1, "http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    (2, "https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    (3, "https://a.example.com/fr/", "a.example.com", "/fr/", "com/", "allow"),
    (4, "https://example.com", "example.com", "", None, None),
    (5, "https://example.com?en/", "example.com", "", None, None),
    (6, "ftp://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    (7, "x://b.net/es/1", "b.net", "/es/1", "net/es/", "block"),
    (8, "x://b.net/est", "b.net", "/est", None, None),
    (9, "x://net/fr/", "net", "/fr/", "net/fr/", "block"),
    (10, None, "", "", None, None),
    (11, "no url", "", "", None, None),
    (12, "a://B.NET#/es/", "b.net", "", None, None),
    (13, "a://É.net/x://c.com/", "É.net", "/x://c.com/", None, None),
    (None, "http://x.org/", "x.org", "/", None, None),
    (3, "https://a.example.com/fr/", "a.example.com", "/fr/", "com/", "allow"),
]


def test_rules_and_parts(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u, *_ in PAGES], "page_id long, url string, host string, verdict string")
    outcomes = spark.createDataFrame([], "id long, bad int")
    wanted = sorted(((i, h, p, r, v or "allow") for i, _, h, p, r, v in PAGES), key=repr)
    for hot in (10_000, 2):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        assert sorted(map(tuple, judge(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect()), key=repr) == wanted
    assert judge(pages.filter("false"), outcomes, URL_RULES).collect() == []


def test_reputation_shrinks_to_domain_and_suffix(spark):
    rows, outcomes = [], []
    for host, good, bad in (("bad.spam.org", 0, 40), ("few.spam.org", 0, 1), ("ok.fine.org", 60, 2), ("few.fine.org", 1, 0), ("a.mixed.net", 15, 15), ("b.mixed.net", 30, 0)):
        for k in range(good + bad):
            outcomes.append((len(rows), int(k < bad)))
            rows.append((len(rows), f"http://{host}/{k}"))
    rows += [(900, "http://new.spam.org/"), (901, "http://new.fine.org/"), (902, "http://other.org/"), (903, "http://x.elsewhere.co.uk/")]
    outcomes += [(0, None), (None, 1), (5000, 1), (0, 1)]
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(outcomes, "id long, bad int")
    got = {r["host"]: r for r in judge(pages, labels, ()).collect()}
    r = {h: x["reputation"] for h, x in got.items()}
    assert r["bad.spam.org"] > r["few.spam.org"] > r["new.spam.org"] > r["other.org"] > r["new.fine.org"] > r["ok.fine.org"] * 0.9
    assert got["bad.spam.org"]["verdict"] == "block" and got["ok.fine.org"]["verdict"] == got["x.elsewhere.co.uk"]["verdict"] == "allow"
    assert all(0 <= x["bound"] <= x["reputation"] <= 1 for x in got.values()) and got["new.spam.org"]["bound"] < got["bad.spam.org"]["bound"]
    assert not any(math.isnan(x["bound"]) for x in got.values())
