"""Containment and similarity joins against plain versions over all pairs."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleanery.operators import retrieval as rt
from gleanery.operators import vectors
from gleanery.operators.containment import containment
from gleanery.operators.storage import settle
from gleanery.plans import all_queries


def chunk_frame(spark, texts):
    return spark.createDataFrame([(f"c{i}", f"f{i % 3}", i, t) for i, t in enumerate(texts)], "chunk_id string, file_id string, chunk_index bigint, chunk_text string")


def found_in(texts, phrases):
    return {(q, t, sum(body.startswith(phrase, k) for k in range(len(body)))) for q, phrase in phrases for t, body in texts
            if phrase and phrase in body}


def test_containment_of_long_texts_and_common_openings(spark):
    rng = random.Random(4)
    opening = "the committee of the whole house met again and "
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    long = " ".join(word() for _ in range(750_000))
    assert len(long) > 5_000_000
    texts = [(i, opening + word() + " " + opening * 3 + word()) for i in range(300)] + [(900, long), (901, ""), (902, None), (903, "日本語の文 ① é" * 40)]
    bodies = [(i, b) for i, b in texts if b]
    phrases = [(i, opening + b[len(opening):len(opening) + 5]) for i, b in bodies[:50]] + [
        (100, opening), (101, long[2_000_000:2_000_400]), (102, long[-30:]), (103, long[(1 << 18) - 12:(1 << 18) + 14]), (104, opening + "zzz"),
        (105, "語の文"), (106, "é日"), (107, "e"), (108, ""), (109, None), (110, long[5:4_000_000])]
    got = containment(spark.createDataFrame(texts, "text_id int, body string").repartition(3), spark.createDataFrame(phrases, "phrase_id int, phrase string"))
    assert {(r["phrase_id"], r["text_id"], r["n"]) for r in got.collect()} == found_in(bodies, [(q, p) for q, p in phrases if p])
    plan = got._jdf.queryExecution().toString()
    assert "Generate" not in plan and "regexp_extract_all" not in plan


def test_containment_within_groups_and_in_many_walks(spark):
    rng = random.Random(5)
    texts = [(g, i, "".join(rng.choice("ab") for _ in range(30)), f"x{i}") for g in range(4) for i in range(12)] + [(None, 1, "aaaa", "y")]
    phrases = [(g, i, "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))) for g in range(5) for i in range(15)] + [(None, 1, "a")]
    got = containment(spark.createDataFrame(texts, "g int, text_id int, body string, extra string"),
                      spark.createDataFrame(phrases, "g int, phrase_id int, phrase string"), ["g"], ["extra"], limit=7)
    of = lambda table, g: [(i, x) for h, i, x, *_ in table if h == g]
    want = {(g, f"x{t}", q, t, n) for g in range(4) for q, t, n in found_in(of(texts, g), of(phrases, g))}
    assert {tuple(r) for r in got.collect()} == want
    none = spark.createDataFrame([], "g int, phrase_id int, phrase string")
    assert containment(spark.createDataFrame(texts, "g int, text_id int, body string, extra string"), none, ["g"]).collect() == []


def test_containment_of_many_small_groups_takes_no_walk_and_large_groups_do(spark, monkeypatch):
    from gleanery.operators import containment as module

    rng = random.Random(6)
    odd = ["", None, r"a\Eb\Q", "😀a😀", "aaaa", "(?=b)", "日b日b日"]
    texts = [(g, i, x, f"x{i}") for g in range(40) for i, x in enumerate([*odd, *("".join(rng.choice("ab\\E") for _ in range(20)) for _ in range(3))])]
    phrases = [(g, i, x) for g in range(45) for i, x in enumerate([*odd, r"\E", "aa", "a", "日b日", "ab"])]
    texts += [(50, i, "".join(rng.choice("ab") for _ in range(30)), "y") for i in range(20)]
    phrases += [(50, i, "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))) for i in range(20)]
    of = lambda table, g: [(i, x) for h, i, x, *_ in table if h == g and x]
    want = {(g, q, t, n) for g in [*range(40), 50] for q, t, n in found_in(of(texts, g), of(phrases, g))}
    frames = spark.createDataFrame(texts, "g int, text_id int, body string, extra string"), spark.createDataFrame(phrases, "g int, phrase_id int, phrase string")
    walks, walk = [], module._walked
    monkeypatch.setattr(module, "_walked", lambda t, p, *a: (walks.append(sorted({r["g"] for r in p.collect()})), walk(t, p, *a))[1])
    for few, large in ((256, []), (15, [[50]]), (0, [[*range(40), 50]])):
        walks.clear()
        got = containment(*frames, ["g"], few=few)
        assert {(r["g"], r["phrase_id"], r["text_id"], r["n"]) for r in got.collect()} == want and walks == large


def unit_vectors(rng, n, length):
    """Rows with one bucket in common."""
    out = np.zeros((n, 2048))
    for v in out:
        np.add.at(v, (2047 * rng.random(length) ** 1.5).astype(int) + 1, 1)
        v[0] = rng.integers(1, 3)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def test_similar_vectors_against_all_pairs():
    rng = np.random.default_rng(6)
    stored, queries = unit_vectors(rng, 4000, 40), unit_vectors(rng, 40, 8)
    exact = stored @ queries.T
    flat = lambda m: tuple(x.astype(np.int64) for x in np.nonzero(m)) + (m[np.nonzero(m)],)
    for least, best in ((0.4, None), (0.12, 5), (0.12, None)):
        asked = vectors.QueryPostings(*flat(queries), len(queries), least, best, 2048)
        found = {}
        for at in range(0, len(stored), 500):
            r, q, score = asked.meet(*flat(stored[at:at + 500]), 500)
            found |= {(at + a, b): s for a, b, s in zip(r.tolist(), q.tolist(), score.tolist())}
        if best:
            want = {(i, q) for q in range(40) for i in np.flatnonzero(exact[:, q] >= max(least, np.sort(exact[:, q])[-best] + 1e-12))}
            assert want <= set(found)
        else:
            sure = set(zip(*(x.tolist() for x in np.nonzero(exact >= least + 1e-12))))
            assert sure <= set(found) and all(exact[k] > least - 1e-12 for k in found)
        # every pair shares a bucket
        print(least, best, asked.candidates, len(found), exact.size)
        assert asked.candidates < exact.size / 3 or least == 0.12 and not best
        assert all(abs(exact[k] - s) < 1e-12 for k, s in found.items())


def test_best_vectors_in_many_walks(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: rng.choice("red fox hen cow blue sky sea sun moon star tree leaf root wind rain".split())
    chunks = chunk_frame(spark, [" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(300)])
    queries = spark.createDataFrame([(i, " ".join(word() for _ in range(3))) for i in range(20)] + [(90, ""), (91, None)], "query_id int, query string")
    every = rt.vector_scores(chunks, queries)
    want = {}
    for r in every.join(chunks, "chunk_id").collect():
        want.setdefault(r["query_id"], []).append((-r["vector_score"], r["file_id"], r["chunk_index"]))
    monkeypatch.setattr(vectors, "WALK_POSTINGS", 11)
    got = {}
    for r in rt.vector_retrieve(chunks.repartition(3), queries, 4).collect():
        got.setdefault(r["query_id"], []).append((-r["vector_score"], r["file_id"], r["chunk_index"]))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x)[:4] for q, x in want.items()}


def traced_mb(use):
    tracemalloc.start()
    try:
        return use(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_many_queries_and_long_texts_take_bounded_arrays():
    rows, queries, half = 1000, 3000, 3 ** 0.5 / 2
    asked = vectors.QueryPostings(np.repeat(np.arange(queries), 2), np.tile([0, 3], queries), np.tile([0.5, half], queries), queries, 0.5, None, 2048)
    asked.query[-2:], asked.weight[-2:] = queries - 1, (1.0, 0.0)  # one query is near all rows
    (r, q, score), peak = traced_mb(lambda: asked.meet(np.repeat(np.arange(rows), 2), np.tile([0, 1], rows), np.tile([0.5, half], rows), rows))
    assert asked.candidates == rows * queries and peak < 160
    assert r.tolist() == list(range(rows)) and set(q.tolist()) == {queries - 1} and np.allclose(score, 0.5)

    tokens = pa.array([[f"t{(i * 7 + k) % 900}" for k in range(1000)] for i in range(2000)] + [None, []])
    batch = pa.RecordBatch.from_arrays([pa.array(range(2002)), tokens], names=["id", "tokens"])
    made, peak = traced_mb(lambda: [(b.column("id").to_pylist(), b.column("weights").value_lengths().to_pylist()) for b in vectors._vectors(["id"], 2048)([batch])])
    assert sum((ids for ids, _ in made), []) == list(range(2002)) and made[-1][1][-2:] == [0, 0] and peak < 60


def test_queries_hand_small_batches_to_python(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, held in (("10000", "1000"), ("0", "1000"), ("64", "64")):
            spark.conf.set(name, given)
            all_queries()["hash_embedding"](spark, "/root/testdata/sf0.001")
            assert spark.conf.get(name) == held
    finally:
        spark.conf.set(name, before)


def test_summed_and_reached_pairs_are_the_same(monkeypatch):
    rng = np.random.default_rng(12)
    stored, queries = unit_vectors(rng, 600, 40), unit_vectors(rng, 30, 8)
    flat = lambda m: tuple(x.astype(np.int64) for x in np.nonzero(m)) + (m[np.nonzero(m)],)
    some = np.nonzero(rng.random((600, 30)) < 0.1)
    for best, named in ((None, None), (None, some), (5, None), (5, some)):
        got = []
        for summed in (0, 10 ** 9):
            monkeypatch.setattr(vectors, "_SUMMED", summed)
            asked = vectors.QueryPostings(*flat(queries), 30, 0.12, best, 2048)
            got.append([x.tolist() for x in asked.meet(*flat(stored), 600, named)])
        assert got[0] == got[1] and len(got[0][0]) > 100
        assert named is None or set(zip(*got[0][:2])) <= set(zip(*(x.tolist() for x in named)))
    assert asked.candidates < 30 * 600 / 10


def test_a_scope_names_pairs_before_they_are_scored(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"c{i}", f"f{i % 4}", i, i % 3, " ".join(["red fox hen cow"[:4 + i % 12], "sky"])) for i in range(240)],
                                   "chunk_id string, file_id string, chunk_index int, page_no int, chunk_text string")
    queries = spark.createDataFrame([(i, "red fox sky") for i in range(6)], "query_id int, query string")
    scope = spark.createDataFrame([(q, f"f{q % 4}", q % 3) for q in range(5)] + [(9, "f0", 0)], "query_id bigint, file_id string, page_no int")
    every = {(r["query_id"], r["chunk_id"]): (-r["vector_score"], r["file_id"], r["chunk_index"])
             for r in rt.vector_scores(chunks, queries).join(chunks, "chunk_id").collect() if (r["query_id"], r["file_id"], r["page_no"]) in {(q, f"f{q % 4}", q % 3) for q in range(5)}}
    want = {(q, c) for q in range(5) for c in [c for _, c in sorted((place, c) for (p, c), place in every.items() if p == q)][:4]}
    met = []
    search = rt.similar_vectors
    monkeypatch.setattr(rt, "similar_vectors", lambda *a: (met.append(search(*a)), met[-1])[1])
    for listed, vectors_ in ((10_000, None), (2, None), (10_000, rt.chunk_vectors(chunks))):
        monkeypatch.setattr(rt, "LISTED", listed)
        got = rt.vector_retrieve(chunks, queries, 4, scope, vectors_)
        assert {(r["query_id"], r["chunk_id"]) for r in got.collect()} == want and len(want) == 20
        assert {(r["query_id"], r["chunk_id"]) for r in met[-1].collect()} <= set(every)


def test_texts_are_not_shuffled_to_few_hits(spark):
    chunks = settle(spark.range(3000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("f").alias("file_id"), F.col("id").alias("chunk_index"),
                                             F.concat(F.lit("red fox "), "id", F.lit(" "), *[F.sha2(F.concat("id", F.lit(f"-{i}")), 512) for i in range(4)]).alias("chunk_text")))
    queries = settle(spark.createDataFrame([(i, f"fox {i}") for i in range(6)], "query_id int, query string"))
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "256k")
        plan = rt.hybrid_retrieve(chunks, queries)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
