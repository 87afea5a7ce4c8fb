import hashlib

from helpers import docs_frame, edited, prose

from gleanery.llm.syncmers import fingerprints, with_entries, with_likeness


def plain_edits(rows):
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for n, (i, text) in enumerate(ordered):
        k, following = len(text) // 2, ordered[(n + 1) % len(ordered)][1]
        out[i] = (len(text), hashlib.sha256((text[:len(text) - k] + following[:k]).encode()).hexdigest())
    return out


def test_edits_and_fingerprints(spark):
    rows = [(i * 7, prose(i, 50 + 3 * i)) for i in range(60)] + [(3, None), (4, ""), (5, "ä😀b"), (6, "one"), (500, prose(1, 40_000)), (501, "y" * 200_000)]
    rows += [(1000, prose(3, 80)), (1001, prose(3, 80)), (-4, prose(8, 30)), (None, "no id here")]
    got = {r["doc_id"]: r for r in fingerprints(docs_frame(spark, rows, True)).collect()}
    assert {i: (r["n_chars"], r["edited_sha256"]) for i, r in got.items()} == plain_edits(rows)
    assert got[1000]["fingerprint"] == got[1001]["fingerprint"] and got[1000]["near_next"] == 1.0
    assert got[3]["fingerprint"] == "" and got[3]["near_next"] == 1.0 and got[4]["near_next"] == 0.0
    long_ones = [r for r in got.values() if r["doc_id"] is not None and 0 < r["doc_id"] < 400 and r["n_chars"] > 600]
    assert sum(r["near_edited"] for r in long_ones) > 0.2 * len(long_ones) and max(r["near_next"] for r in long_ones) < 0.1
    assert all(0 <= r[c] <= 1 for r in got.values() for c in ("near_edited", "near_next"))


def plain_anchors(units):
    """Anchor positions from any hash of the inner runs, here that of the operator."""
    inner = units["inner"]
    return [i for i in range(len(units["units"]) - 4) if min(inner[i], inner[i + 3]) <= min(inner[i + 1], inner[i + 2])]


def test_anchors_are_closed_syncmers(spark):
    from pyspark.sql import functions as F
    text = prose(4, 300)
    units = F.transform(F.split("text", " "), lambda x: F.xxhash64(x))
    row = spark.createDataFrame([(text,)], "text string").select(units.alias("units")).select(
        "units", F.zip_with("units", F.slice("units", 2, 299), lambda x, y: F.xxhash64(x, y)).alias("inner")).first()
    wanted = set(plain_anchors(row))
    found = with_entries(spark.createDataFrame([(text,)], "text string"), "text", "e").first()["e"]
    assert len(found) == 64 and {x & 0xFFFFFF for x in found} <= wanted and found == sorted(found)


def test_likeness(spark):
    text = prose(1, 400)
    pairs = [(text, text), (text, edited(text, 1, 0.05)), (text, prose(2, 400)), ("", ""), ("", "a b"), (text, prose(5, 900) + " " + text)]
    df = spark.createDataFrame(pairs, "x string, y string")
    got = [r["z"] for r in with_likeness(with_entries(with_entries(df, "x", "e"), "y", "f"), "e", "f", "z").collect()]
    assert got[0] == 1 and 0.4 < got[1] < 1 and got[2] == 0 and got[3] == 1 and got[4] == 0 and got[5] == 0


def test_single_and_no_document(spark):
    one = fingerprints(docs_frame(spark, [(1, "abcdef")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one["near_next"] == 1.0
    assert fingerprints(docs_frame(spark, [])).count() == 0
    same = fingerprints(docs_frame(spark, [(1, "abcdef")] * 3)).collect()
    assert len(same) == 3 and {r["edited_sha256"] for r in same} == {one["edited_sha256"]}


def test_a_copy_behind_a_long_header(spark):
    text = prose(1, 2000)
    rows = [(1, text), (2, prose(5, 900) + " " + text), (3, text), (4, prose(2, 400))]
    near = {r["doc_id"]: r["near_next"] for r in fingerprints(docs_frame(spark, rows)).collect()}
    assert 0.4 < near[1] < 0.95 and 0.4 < near[2] < 0.95 and near[3] == 0
