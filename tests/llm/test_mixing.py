import re

import numpy as np
from helpers import prose
from pyspark.sql import functions as F

from gleanery.llm.mixing import _uniform, hypergeometric, mix, shard_texts, split_quotas, taken_words
from gleanery.operators.storage import settle

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def corpus(spark):
    rows = [(i, prose(i, 20 + i % 90), f"src{i % 7}") for i in range(300)]
    rows += [(400 + i, prose(i, 400), "hot") for i in range(150)]
    rows += [(600, None, "src1"), (601, "", "src2"), (602, "\u00a0x\u2003y", None), (603, prose(9, 300), None), (604, " \t\n", "bare"), (605, prose(3, 20_000), "src3")]
    rows += [(1, rows[1][1], "src1"), (None, prose(5, 50), "src4"), (None, prose(5, 50), "src4"), (610, prose(6, 40), "Ä"), (611, prose(7, 40), "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return rows, df.selectExpr("*", "'x' as size", "1 as hash", "1 as slice", "1 as target", "1 as blocks")


def drawn(docs, **settings):
    mixed = settle(mix(docs, **settings))
    return mixed, shard_texts(docs, mixed)


def test_targets_and_words_taken(spark):
    rows, docs = corpus(spark)
    mixed, pieces = drawn(docs)
    got = taken_words(mixed, pieces).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    target = plain_targets(sizes)
    source_of = {}
    for doc_id, _, source in rows:
        source_of.setdefault(doc_id, source)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(t or "")) for _, t, _ in rows)
    for s, n in sizes.items():
        assert abs(taken[s] - target[s]) <= max(2, 0.005 * n), (s, taken[s], target[s])
    again = taken_words(*drawn(docs.repartition(7))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_hold_disjoint_blocks_of_exact_number(spark):
    rows, docs = corpus(spark)
    mixed, texts = drawn(docs, shards=5)
    got = texts.withColumn("task", F.spark_partition_id()).collect()
    planned = mixed.select("doc_id", "source", "source_no", "at", F.explode("pieces").alias("p")).select("*", "p.*").collect()
    # every planned piece is drawn once with the words of its document, whatever rows repeat or share a doc_id
    words = {}
    for doc_id, text, source in rows:
        words.setdefault((doc_id, source), []).append(WORD.findall(text or ""))
    key = lambda r: (r["source_no"], r["at"], r["turn"], r["block"], r["word_from"])
    wanted = {key(r): r for r in planned}
    assert len(wanted) == len(planned) == len(got) and set(wanted) == set(map(key, got))
    for r in got:
        piece = wanted[key(r)]
        choices = [" ".join(w[r["word_from"]:piece["word_to"]]) for w in words[r["doc_id"], r["source"]]]
        assert r["text"] in choices and r["taken"] == piece["word_to"] - piece["word_from"] == len(WORD.findall(r["text"]))
        assert (r["shard"], r["place"]) == (piece["shard"], piece["place"])
    blocks = {(r["source_no"], r["turn"], r["block"]): r["shard"] for r in planned}
    assert len({(r["source_no"], r["turn"], r["block"], r["shard"]) for r in planned}) == len(blocks)
    per_shard = np.bincount(list(blocks.values()), minlength=5)
    assert per_shard.max() - per_shard.min() <= 1
    # partitions hold their pieces by shard and place, and a block stays together
    for task in {r["task"] for r in got}:
        places = [(r["shard"], r["place"], r["at"]) for r in got if r["task"] == task]
        assert places == sorted(places)
    assert len({(r["source_no"], r["turn"], r["block"], r["task"]) for r in got}) == len(blocks)


def test_rows_that_repeat_give_their_own_words(spark):
    rows = [(1, prose(1, 900), "a"), (1, prose(2, 1200), "a"), (1, prose(1, 900), "a"), (2, prose(3, 700), "b"), (None, prose(4, 60), "b"), (None, prose(4, 60), "b")]
    mixed, pieces = drawn(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    plan = mixed.select("size", F.expr("aggregate(pieces, 0L, (a, p) -> a + p.word_to - p.word_from)").alias("n")).collect()
    got = pieces.collect()
    assert sum(r["n"] for r in plan) == sum(r["taken"] for r in got) == sum(len(WORD.findall(r["text"])) for r in got)
    assert sorted((r["size"], r["n"]) for r in plan) == sorted((r["size"], r["taken"]) for r in taken_words(mixed, pieces).collect())


def test_quotas_add_up_and_look_hypergeometric(spark):
    quotas = spark.createDataFrame([(0, 5000), (1, 0), (2, 300), (3, 77)], "source_no int, drawn long")
    rows = {r["source_no"]: r["starts"] for r in split_quotas(quotas, 6, 3).collect()}
    drawn = {0: 5000, 1: 0, 2: 300, 3: 77}
    leaves = {s: np.diff([*starts, drawn[s]]) for s, starts in rows.items()}
    assert all((x >= 0).all() for x in leaves.values())
    total = sum(leaves.values())
    assert total.sum() == 5377 and total.max() - total.min() <= 1
    many = spark.range(4000).select(hypergeometric(F.lit(200).cast("long"), F.lit(60).cast("long"), F.lit(50).cast("long"), _uniform(F.lit(1), "id")).alias("x"))
    found = np.array([r["x"] for r in many.collect()])
    assert abs(found.mean() - 15) < 0.2 and abs(found.var() - 50 * 0.3 * 0.7 * 150 / 199) < 0.8
    edge = spark.range(1).select(*[hypergeometric(*[F.lit(v).cast("long") for v in x], F.lit(0.5)) for x in ((10, 0, 5), (10, 10, 5), (10, 4, 0), (10, 4, 10))])
    assert tuple(edge.first()) == (0, 5, 0, 4)


def test_empty_and_wordless_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert taken_words(*drawn(none)).count() == 0
    bare = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in taken_words(*drawn(bare)).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
