import hashlib
import random

import pytest

from gleanery.llm.revisits import PERMITTED, canonical_url, resolve_revisits

SCHEMA = "record_id long, record_type string, target_uri string, warc_date long, headers map<string,string>, payload string"


def test_canonical_urls(spark):
    urls = ["http://A.b:80/x/?utm_source=1&q=2#f", "https://a.B/x?q=2", "HTTP://a.b", "a.b/", None, "", "http://a.b/X", "https://a.b:8080//"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(canonical_url("u")).collect()]
    assert got == ["a.b/x?q=2", "a.b/x?q=2", "a.b", "a.b", None, "", "a.b/X", "a.b:8080"]


def plain(rows):
    out = []
    for i, kind, uri, date, headers, _ in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if r[1] == "response" and uri is not None and date is not None and r[2] == uri and r[3] is not None and (r[3], r[0]) < (date, i)]
        last = max(before, key=lambda r: (r[3], r[0]), default=None)
        status, merged, digest = "orphan", headers, None
        if last:
            pairs = [(headers[k].removeprefix("W/"), last[4][k].removeprefix("W/")) for k in ("etag", "last-modified") if headers and k in headers and k in last[4]]
            status = "unchecked" if not pairs else "resolved" if pairs[0][0] == pairs[0][1] else "changed"
            if status != "changed":
                merged = last[4] | {k: v for k, v in headers.items() if k in PERMITTED}
                digest = hashlib.sha256(last[5].encode()).hexdigest()
        out.append((i, last and last[0], status, merged and sorted(merged.items()), digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("slices", [1, 9])
def test_equals_plain(spark, slices):
    r, rows = random.Random(2), []
    for i in range(600):
        kind = r.choice(["response", "revisit", "revisit", "request"])
        uri = r.choice(["hot.example/a"] * 6 + [f"h{j}.example/{j}" for j in range(9)] + [None])
        headers = {k: v for k, v in (("etag", r.choice(["a", "b", "W/a"])), ("last-modified", r.choice("xy")), ("content-length", "9"), ("set-cookie", "c")) if r.random() < 0.6}
        rows.append((i, kind, uri, r.choice([None] + list(range(40)) * 3), headers, f"body {i % 50}"))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as uri", "1 as slice", "1 as status", "1 as digest")
    got = [(x["record_id"], x["response_id"], x["status"], x["headers"] and sorted(x["headers"].items()), x["digest"]) for x in resolve_revisits(df, slices).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_repeats_and_empty(spark):
    rows = [(1, "response", "a", 1, {"etag": "x"}, "p")] * 2 + [(2, "revisit", "a", 2, {"etag": "x"}, None)] * 3 + [(3, "revisit", None, None, None, None)]
    got = resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((x["record_id"], x["status"]) for x in got) == [(2, "resolved")] * 3 + [(3, "orphan")]
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_records_that_share_an_id(spark):
    rows = [(1, "response", "a", 1, {"etag": "x"}, "p"), (1, "response", "b", 1, {"etag": "y"}, "q"), (1, "response", "b", 1, {"etag": "y"}, "r"),
            (2, "revisit", "a", 2, {"etag": "x"}, None), (2, "revisit", "b", 2, {"etag": "z"}, None), (2, "revisit", "b", 3, {}, None),
            (2, "revisit", "b", 3, {"etag": "y"}, None), (2, "revisit", "c", 3, {"etag": "y"}, None), (None, "revisit", "a", 4, {"etag": "x"}, None)]
    got = resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()
    digest = {x: hashlib.sha256(x.encode()).hexdigest() for x in "pqr"}
    either = min(digest["q"], digest["r"])
    assert sorted(((x["record_id"], x["uri"], x["response_id"], x["status"], x["digest"]) for x in got), key=str) == sorted([
        (2, "a", 1, "resolved", digest["p"]), (2, "b", 1, "changed", None), (2, "b", 1, "unchecked", either), (2, "b", 1, "resolved", either),
        (2, "c", None, "orphan", None), (None, "a", 1, "resolved", digest["p"])], key=str)
