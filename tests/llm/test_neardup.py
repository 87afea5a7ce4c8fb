import itertools
import random

import numpy as np
import pytest
from helpers import docs_frame, edited, prose, words

from gleanery.llm.components import components
from gleanery.llm.neardup import common_in_order, keep_one, near_groups, similarity
from gleanery.llm.words import grams, word_hashes


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def shingles(text):
    w = words(text)
    return [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def plain_groups(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for (i, s), (j, t) in itertools.combinations(rows, 2):
        a, b = shingles(s), shingles(t)
        c = lcs(a, b) if a and b else 0
        if (s or "") == (t or "") or (a and b and c / (len(a) + len(b) - c) >= 0.8):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i, _ in rows}


def test_banded_alignment_equals_plain():
    r = random.Random(3)
    for _ in range(300):
        a = np.array([r.randrange(6) for _ in range(r.randrange(40))], np.uint64)
        b = np.array([r.randrange(6) for _ in range(r.randrange(40))], np.uint64)
        assert common_in_order(a, b, 60) == lcs(a.tolist(), b.tolist())
        c, n, m = lcs(a.tolist(), b.tolist()), len(a), len(b)
        if n and m:
            exact = c / (n + m - c)
            assert similarity(a, b, 0.6) == pytest.approx(exact if exact >= 0.6 else 0.0)


def test_long_sequences_within_the_band():
    a = np.arange(5000, dtype=np.uint64)
    b = np.delete(a, np.arange(0, 5000, 17))
    assert common_in_order(a, b, 600) == len(b)


def test_word_hashes_follow_words():
    texts = ["A b, c-d", None, "", "straße Ä", "x" * 3_000_000 + " y", "a b c d"]
    found = list(word_hashes(texts))
    assert [len(x) for x in found] == [4, 0, 0, 2, 2, 4]
    assert (found[0] == found[5]).all()
    assert len(grams(found[0], 5)) == 1 and len(grams(found[0], 2)) == 3


def test_groups_equal_plain(spark):
    base, rows = [prose(i, 120) for i in range(12)], []
    for i, text in enumerate(base):
        rows += [(100 * i, text), (100 * i + 1, text), (100 * i + 2, edited(text, i, 0.02)), (100 * i + 3, edited(text, i + 50, 0.3))]
    rows += [(5000 + i, edited(base[0], 900 + i, 0.015)) for i in range(40)]
    rows += [(6000, None), (6001, ""), (6002, "one two"), (6003, "one two"), (6004, "..."), (6005, prose(7, 30_000))]
    got = {r["doc_id"]: r["group_id"] for r in near_groups(docs_frame(spark, rows, True)).collect()}
    assert got == plain_groups(rows[:-1]) | {6005: 6005}
    kept = keep_one(docs_frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_repeated_rows_ties_and_missing_ids(spark):
    text = prose(1, 200)
    rows = [(3, text), (3, text), (3, text + " end"), (None, prose(2, 60)), (None, prose(2, 60)), (None, prose(4, 60))]
    kept = keep_one(docs_frame(spark, rows, True)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "None", "None"]


def test_empty_table(spark):
    assert near_groups(docs_frame(spark, [])).count() == 0 and keep_one(docs_frame(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(60).selectExpr("id as a", "id + 1 as b").union(spark.sql("select 100L a, 99L b"))
    assert {r["node"]: r["root"] for r in components(links).collect()} == {i: 0 for i in range(61)} | {99: 99, 100: 99}
