import numpy as np
from helpers import docs_frame, edited, prose

from gleanery.llm import decontaminate
from gleanery.llm.decontaminate import GAP, MATCH, MISMATCH, align, drop_leaks, find_leaks


def plain_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (MATCH if x == y else MISMATCH), h[i][j + 1] + GAP, h[i + 1][j] + GAP)
    return max(map(max, h))


def test_alignment_equals_plain():
    r = np.random.default_rng(2)
    for _ in range(100):
        a, b = r.integers(0, 5, r.integers(1, 20)).astype(np.uint64), r.integers(0, 5, r.integers(1, 30)).astype(np.uint64)
        assert align(a, b)[0] == plain_align(a.tolist(), b.tolist())


def inputs(spark, extra=False):
    items = [(i, prose(1000 + i, 30)) for i in range(8)] + [(90, None), (91, ""), (92, "two words"), (93, prose(1000, 30)), (None, prose(1999, 25))]
    rows = [(i, f"{prose(i, 100)} {items[i][1]} {prose(i + 50, 100)}") for i in range(4)]
    rows += [(10 + i, f"{prose(i + 70, 200)} {edited(items[i + 4][1], i, 0.15)} {prose(i + 80, 20)}") for i in range(4)]
    rows += [(20 + i, prose(i + 300, 150)) for i in range(10)]
    rows += [(30, None), (31, ""), (32, prose(5, 60_000) + " " + items[0][1]), (33, " ".join(items[1][1].split()[:6])), (0, rows[0][1]), (None, rows[1][1])]
    rows += [(40 + i, f"{prose(i + 500, 10)} {items[2][1]}") for i in range(30)]  # an item that many documents hold
    return docs_frame(spark, rows, extra), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as score")


WANTED = sorted([(0, 0), (0, 0), (1, 1), (2, 2), (3, 3), (10, 4), (11, 5), (12, 6), (13, 7), (32, 0), *((40 + i, 2) for i in range(30))])


def test_finds_exact_and_edited_copies(spark):
    docs, items = inputs(spark, True)
    found = find_leaks(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found if r["doc_id"] is not None) == WANTED
    exact = next(r for r in found if r["doc_id"] == 3)
    assert (exact["score"], exact["word_from"], exact["word_to"]) == (1.0, 100, 130)
    left = drop_leaks(docs, items)
    gone = {i for i, _ in WANTED}
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] not in gone and r["doc_id"] is not None)
    assert left.columns == docs.columns


def test_several_volumes_give_the_same(spark, monkeypatch):
    docs, items = inputs(spark)
    monkeypatch.setattr(decontaminate, "VOLUME_WORDS", 60)
    found = find_leaks(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found if r["doc_id"] is not None) == WANTED
    assert drop_leaks(docs, items).filter("doc_id in (0, 1, 13)").count() == 0


def test_empty_tables(spark):
    docs, items = inputs(spark)
    assert find_leaks(docs.limit(0), items).count() == 0
    assert find_leaks(docs, items.limit(0)).count() == 0 and drop_leaks(docs, items.limit(0)).count() == docs.count()
