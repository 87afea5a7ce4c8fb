import re

from gleanery.llm.urlfilter import RULES, judge

URLS = ["http://A.Example.NET/en/x", "https://example.net/de/", "http://www.example.com/de/1?x=1", "http://example.com/en/9", "http://m.b.org/fr/", "http://org/fr/",
        "http://borg/fr/", "http://x.net", "http://x.net?q=/", "ftp://x.net/#://y", "no scheme", "", None, "://x.net/a", "a://", "http://net/en/", "http://notexample.net/en/",
        "http://h.example/" + "p/" * 50_000, "http://Ünï.example.com/de/ü"]


def plain(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' as html", "1 as host", "1 as label", "1 as fold", "1 as verdict")


def learned(n):
    return [f"http://h{i % 13}.{('bad.net', 'good.example.net/en', 'x.example.com/de', 'y.org/fr')[i % 4]}{'/' if i % 4 == 0 else '/'}{i}" for i in range(n)]


def test_parts_and_rules(spark):
    urls = URLS + learned(400)
    got = {r["page_id"]: r for r in judge(pages(spark, urls), trees=3).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path, rule, verdict = plain(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        assert got[i]["verdict"] == (verdict or got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")


def test_trees_learn_from_labels(spark):
    bad = [f"http://cheap-{i}.shop{i % 3}.example/win?id={i}&k={i * 7}&z={i}" for i in range(300)]
    good = [f"http://news{i % 3}.example/story/page-{'abc'[i % 3]}" for i in range(300)]
    labels = spark.createDataFrame([(u, 1) for u in bad[:200]] + [(u, 0) for u in good[:200]] + [(None, 1), ("x", None)], "url string, label int")
    got = judge(pages(spark, bad[200:] + good[200:]), rules=(("block", "never", "/"),), labels=labels, trees=5)
    verdicts = [r["verdict"] for r in got.orderBy("page_id").collect()]
    assert sum(v == "block" for v in verdicts[:100]) > 95 and sum(v == "allow" for v in verdicts[100:]) > 95


def test_no_labels_one_class_no_rows(spark):
    assert {r["verdict"] for r in judge(pages(spark, ["http://a.example/", None])).collect()} == {"allow"}
    assert {r["verdict"] for r in judge(pages(spark, ["http://a.net/", "http://a.example/"])).collect()} == {"block"}
    assert judge(pages(spark, [])).count() == 0
