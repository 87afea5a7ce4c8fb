"""Golden rows and semantic traps on tiny inputs."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as tx
from gleanery.operators import chunks as ch
from gleanery.operators import needs as nd
from gleanery.operators import ranking as rk
from gleanery.operators import retrieval as rt
from gleanery.operators import table as tb
from gleanery.operators.ordering import sorted_positions
from gleanery.operators.windows import repeat_requests
from gleanery.sources import documents as docs
from gleanery.sources import sinks, tables
from gleanery.streaming import trace_stream


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("x")).first()["x"]


def test_nulls_and_blanks_come_last_both_ways(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, " "), (5, "b")], "row_number int, k string")
    for direction, want in (("asc", [3, 1, 5, 2, 4]), ("desc", [1, 5, 3, 2, 4])):
        out = tb.query_table(df, tb.TableQuery(["row_number"], order_by=[tb.Order("k", direction)]))
        assert [r[0] for r in rows(out)] == want


def test_filter_matches_per_operator(spark):
    df = spark.createDataFrame([(1, "x", 3), (2, " ", 5), (3, None, None)], "row_number int, s string, n int")
    count = lambda *f: tb.apply_filters(df, [tb.Filter(*f)]).count()
    assert [count("s", "=", "x"), count("s", "!=", "x"), count("s", "is_null"), count("s", "not_null"), count("n", "!=", 3)] == [1, 0, 2, 1, 1]


@pytest.mark.parametrize("value, column", [(1.5, "n"), (True, "n"), ("x", "n"), ("soon", "d"), ("maybe", "b")])
def test_bad_literals_are_refused(spark, value, column):
    df = spark.createDataFrame([], "n int, d date, b boolean")
    with pytest.raises(tb.ArgumentError) as error:
        tb.apply_filters(df, [tb.Filter(column, ">", value)])
    assert error.value.code == "INVALID_FILTER_VALUE"


def test_plan_time_refusals(spark):
    df = spark.createDataFrame([], "n int, s string")
    for request, code in ((tb.Aggregate("sum", "s"), "NON_NUMERIC_FIELD"), (tb.Aggregate("avg"), "INVALID_AGGREGATE_ARGUMENTS"),
                          (tb.Aggregate("count", "zz"), "FIELD_NOT_FOUND")):
        with pytest.raises(tb.ArgumentError) as error:
            tb.aggregate_table(df, request)
        assert error.value.code == code


def test_aggregate_of_nothing(spark):
    df = spark.createDataFrame([], "n int, g string")
    assert rows(tb.aggregate_table(df, tb.Aggregate("count"))) == [(0,)]
    assert rows(tb.aggregate_table(df, tb.Aggregate("sum", "n"))) == [(None,)]
    assert rows(tb.aggregate_table(df, tb.Aggregate("count", group_by=["g"]))) == []


def test_unicode_space_and_fold(spark):
    assert one(spark, "　Straße ", tx.norm_key) == "strasse"
    assert one(spark, "　", tx.is_blank) is True


def test_search_tokens_with_cjk(spark):
    assert one(spark, "Ab1 中文x字", tx.search_tokens) == ["ab1", "x", "中", "文", "字", "中文", "文字"]


def test_value_key_and_years(spark):
    keys = [one(spark, v, tx.value_key) for v in ("1.50", "100", "abc", " ", "0.0")]
    assert keys == ["number:1.5", "number:100", "text:abc", None, "number:0"]
    assert [one(spark, v, tx.single_year) for v in ("2024年", "2023 or 2024", "120245")] == [2024, None, None]


def test_excerpt_window(spark):
    text = "a" * 100 + " needle " + "b" * 300
    out = spark.createDataFrame([(text, "NEEDLE")], "t string, q string").select(tx.excerpt(F.col("t"), F.col("q"))).first()[0]
    assert out.startswith("…") and out.endswith("…") and "needle" in out and len(out) == 242


def test_chunks_may_end_inside_the_overlap(spark):
    df = spark.createDataFrame([("a", "x" * 1700), ("b", ""), ("c", "y" * 800)], "k string, content string")
    sizes = {(r["k"], r["chunk_index"]): len(r["chunk_text"]) for r in ch.block_chunks(df, ["k"]).collect()}
    assert sizes == {("a", 0): 900, ("a", 1): 900, ("a", 2): 100, ("b", 0): 0, ("c", 0): 800}


def test_candidate_verdicts(spark):
    h = lambda t: F.sha2(F.lit(t), 256)
    good = spark.range(1).select(F.lit("f").alias("file_id"), F.lit("c").alias("chunk_id"), F.lit(0).alias("chunk_index"), F.lit("t").alias("chunk_text"), h("t").alias("text_hash"))
    cases = {"ok": good, "TEXT_HASH_MISMATCH": good.withColumn("text_hash", F.lit("x")), "CHUNK_INDEX_NOT_DENSE": good.withColumn("chunk_index", F.lit(1)),
             "CHUNK_ID_MISSING_OR_REPEATED": good.unionByName(good.withColumn("chunk_index", F.lit(1)))}
    for verdict, df in cases.items():
        assert ch.check_candidate(df).first()["verdict"] == verdict


def test_positions_with_one_hot_group(spark):
    rng = random.Random(5)
    data = [("hot" if i % 3 else f"g{i % 11}", rng.randint(0, 4), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v int, i int")
    got = {r["i"]: r["position"] for r in rk.position_in_group(df, ["g"], "v", "i", descending=True, slices=16).collect()}
    want = {}
    for g in {d[0] for d in data}:
        for n, d in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: (-d[1], d[2])), 1):
            want[d[2]] = n
    assert got == want


def test_running_sum_and_previous(spark):
    data = [("a" if i % 4 else "b", i * 7 % 1009, i % 5) for i in range(1000)]
    df = spark.createDataFrame(data, "g string, o int, v int").dropDuplicates(["g", "o"])
    src = sorted(tuple(r) for r in df.collect())
    sums = {(r["g"], r["o"]): r["s"] for r in rk.running_sum(df, ["g"], "o", "v", "s", slices=8).collect()}
    prev = {(r["g"], r["o"]): r["prev_v"] for r in rk.previous_in_group(df, ["g"], "o", ["v"], slices=8).collect()}
    for g in "ab":
        total, last = 0, None
        for _, o, v in (r for r in src if r[0] == g):
            assert sums[g, o] == total and prev[g, o] == last
            total, last = total + v, v


def test_sorted_positions(spark):
    df = spark.createDataFrame([(i, f"k{i * 37 % 10}") for i in range(200)], "i int, k string")
    got = sorted(rows(sorted_positions(df, [F.col("k").desc(), F.col("i")])), key=lambda r: r[2])
    assert [r[:2] for r in got] == sorted([(i, f"k{i * 37 % 10}") for i in range(200)], key=lambda r: (-int(r[1][1:]), r[0]))
    assert [r[2] for r in got] == list(range(1, 201))


def test_nearest_rank_formula(spark):
    for n in (1, 2, 19, 20, 21, 100):
        df = spark.createDataFrame([(v,) for v in range(1, n + 1)], "v int")
        want = min(max(1, int(n * 0.95 + 0.999999)), n)
        assert rk.nearest_rank(df, [], "v", 0.95, "p").first()["p"] == want


def test_repeat_chain_counts_accepted_only(spark):
    data = [(i, s) for i, s in enumerate((0, 200, 400, 650, 701, 2000))]
    df = spark.createDataFrame(data, "id bigint, s bigint").select("id", F.lit("k").alias("k"), F.timestamp_seconds("s").alias("at"))
    assert sorted((r["id"], r["accepted_id"]) for r in repeat_requests(df, ["k"], "at", "id").collect()) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 5)]


MARKDOWN = """# Top
text [a](http://x) here
more

### Skip ##
- one
+ two
  rest
para `after`
| a | b |
|---|:-:|
| 1 \\| x | 2 |
| 3 |
~~~~ py extra
# no heading [l](u)
~~~
"""


def test_markdown_blocks():
    got = [(b["kind"], b["content"], b["line_number"], b["line_end"], b["warnings"]) for b in docs.scan_markdown(MARKDOWN)]
    assert got == [
        ("heading", "Top", 1, 1, []), ("paragraph", "text [a](http://x) here\nmore", 2, 3, []), ("heading", "Skip", 5, 5, []),
        ("list", "- one\n+ two\n  rest\npara `after`", 6, 9, []),
        ("table", "| a | b |\n|---|:-:|\n| 1 \\| x | 2 |\n| 3 |", 10, 13, ["IRREGULAR_MARKDOWN_TABLE"]),
        ("code", "# no heading [l](u)\n~~~", 14, 16, ["UNCLOSED_MARKDOWN_FENCE"])]
    blocks = list(docs.scan_markdown(MARKDOWN))
    assert blocks[1]["links"] == [{"text": "a", "url": "http://x"}] and blocks[5]["links"] == [] and blocks[5]["language"] == "py"


def test_html_page():
    page = docs.read_page("<html><head><meta property='og:title' content=' Og '><meta name='date' content='2024'><link rel='x canonical' href='/c?q=1#f'>"
                          "<style>p{}</style></head><body><p>One <b>two</b></p><script>no()</script><noscript>no</noscript>three &amp; four</body>", "https://H.example/a")
    assert (page["title"], page["published_at"], page["canonical_url"], page["domain"]) == ("Og", "2024", "https://H.example/c?q=1", "h.example")
    assert page["content"] == "One\ntwo\nthree & four" and page["publisher"] is None


def test_json_leaves_at_any_depth(spark):
    df = spark.createDataFrame([(1, '{"a": [1, {"b c": null}], "d": {}, "e": {"f": {"g": {"h": [true]}}}}'), (2, "not json")], "id int, j string")
    got = {(r["json_path"], r["value"]) for r in docs.json_leaf_rows(df, "id", "j", depth=1).collect()}
    assert got == {("$.a[0]", "1"), ('$.a[1]["b c"]', "null"), ("$.d", "{}"), ("$.e.f.g.h[0]", "true")}


def test_json_levels_are_exploded_in_one_chain(spark):
    texts = ['{"a": [1, {"b": [[2, "["]]}], "c": "{x", "d": null}', '[]', '"{}"', '[[], {}]', "null", None, "{"]
    found = docs.json_leaf_rows(spark.createDataFrame(list(enumerate(texts)), "id int, j string"), "id", "j", depth=3)
    assert {tuple(r) for r in found.collect()} == {
        (0, "$.a[0]", "1"), (0, "$.a[1].b[0][0]", "2"), (0, "$.a[1].b[0][1]", '"["'), (0, "$.c", '"{x"'), (0, "$.d", "null"),
        (1, "$", "[]"), (2, "$", '"{}"'), (3, "$[0]", "[]"), (3, "$[1]", "{}"), (4, "$", "null")}
    # once for the leaves, once for what is deeper
    assert found._jdf.queryExecution().optimizedPlan().toString().count("variant_explode") <= 2 * 3


def test_delimited_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;flag;n\n1;TRUE;1e3\n;;\n2;no;-4\n3;false;2.5\n")
    typed = tables.typed_rows(tables.read_delimited(spark, str(tmp_path), ";"))
    got = [(r["id"]["i"], r["flag"]["kind"], r["n"]["kind"]) for r in typed.collect()]
    assert got == [(1, "boolean", "string"), (2, "string", "integer"), (3, "boolean", "number")]


def test_replace_keeps_other_files(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_files(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "file_id string, v int"), path, buckets=2)
    sinks.replace_files(spark.createDataFrame([("b", 2), ("b", 3)], "file_id string, v int"), path, buckets=2)
    assert sorted((r["file_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2), ("b", 3), ("c", 1)]


def chunk_frame(spark, texts):
    return spark.createDataFrame([(f"c{i}", f"f{i % 3}", i, t) for i, t in enumerate(texts)], "chunk_id string, file_id string, chunk_index bigint, chunk_text string")


def test_phrase_hits_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abAB ") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    queries = [(i, "".join(rng.choice("ab ") for _ in range(n))) for i, n in enumerate((1, 2, 3, 4, 6, 8, 12, 25, 30))] + [(99, texts[1][:40])]
    got = {(r["query_id"], r["chunk_id"], r["tf"]) for r in rt.phrase_hits(chunk_frame(spark, texts), spark.createDataFrame(queries, "query_id int, query string")).collect()}
    want = set()
    for q, phrase in queries:
        for i, t in enumerate(texts):
            n = sum(t.lower().startswith(phrase.lower(), k) for k in range(len(t))) if len(phrase) >= 3 else 0
            if n:
                want.add((q, f"c{i}", n))
    assert got == want


def test_vector_scores_against_dense(spark):
    texts, queries = ["red fox red", "blue 中文字", "", "fox"], [(1, "red fox"), (2, "中文")]
    import hashlib
    import re

    def dense(text):
        v = {}
        low = text.casefold()
        cjk = re.findall("[一-鿿]", low)
        for token in re.findall("[a-z0-9]+", low) + cjk + ["".join(cjk[i:i + 2]) for i in range(len(cjk) - 1)]:
            b = int.from_bytes(hashlib.sha256(token.encode()).digest()[:4], "big") % 2048
            v[b] = v.get(b, 0) + 1
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {b: x / norm for b, x in v.items()}

    want = {}
    for q, text in queries:
        for i, t in enumerate(texts):
            a, b = dense(text), dense(t)
            score = sum(a[k] * b.get(k, 0) for k in a)
            if score >= 0.12:
                want[q, f"c{i}"] = round(score, 8)
    got = {(r["query_id"], r["chunk_id"]): r["vector_score"] for r in rt.vector_scores(
        chunk_frame(spark, texts), spark.createDataFrame(queries, "query_id int, query string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in want)


def test_foreign_ranking_is_checked(spark):
    chunks = chunk_frame(spark, ["red fox", "red hen", "red cow"])
    queries = spark.createDataFrame([("q", "red fox")], "query_id string, query string")
    reverse = lambda c, *_: c.select("query_id", "chunk_id", F.col("fused_position").cast("double").alias("score"))
    broken = lambda c, *_: reverse(c).unionByName(reverse(c).limit(1))
    good = rt.hybrid_retrieve(chunks, queries, 5, ranker=reverse).orderBy("final_position").collect()
    bad = rt.hybrid_retrieve(chunks, queries, 5, ranker=broken).orderBy("final_position").collect()
    assert {r["mode"] for r in good} == {"hybrid"} and good[-1]["chunk_id"] == "c0"
    assert {r["mode"] for r in bad} == {"rerank_fallback"} and bad[0]["chunk_id"] == "c0"


NEED = "task_id string, need_id string, need_no int, query string, name string, required_terms array<string>, minimum_evidence int"


def test_controlled_retrieval_stop_reasons(spark):
    chunks = chunk_frame(spark, ["alpha budget report", "beta budget", "gamma"])
    needs = spark.createDataFrame([
        ("t1", "n1", 1, "alpha budget", "alpha", [], 1), ("t2", "n2", 1, "zulu", "zulu", [], 1),
        ("t3", "n3", 1, "alpha budget", "a", ["never"], 1), ("t3", "n4", 2, "beta budget", "b", [], 1)], NEED)
    tasks, state, _ = nd.controlled_retrieval(needs, chunks, max_rounds=3, max_calls=6)
    got = {r["task_id"]: (r["calls"], r["rounds"], r["stop_reason"], r["answer_status"]) for r in tasks.collect()}
    assert got["t1"] == (1, 1, "sufficient", "confirmed")
    assert got["t2"] == (2, 2, "no_new_evidence", "not_found")
    assert got["t3"][2:] == ("budget", "not_found") and got["t3"][1] == 3
    assert {r["need_id"]: r["status"] for r in state.collect()} == {"n1": "sufficient", "n2": "missing", "n3": "partial", "n4": "sufficient"}


def test_a_failing_search_ends_its_task(spark):
    chunks = chunk_frame(spark, ["alpha budget", "beta budget"])
    rows_ = [(f"t{t}", f"n{t}{i}", i, w, w, [], 1) for t in (1, 2, 3, 4) for i, w in enumerate(("alpha budget", "beta budget", "zulu"), 1)]
    failures = spark.createDataFrame([("n12", "E1", True), ("n21", "E2", False), ("n33", "E3", True), ("n13", "E9", True)], "need_id string, error_code string, called boolean")
    tasks, state, _ = nd.controlled_retrieval(spark.createDataFrame(rows_, NEED), chunks, failures=failures, max_calls=5)
    got = {r["task_id"]: (r["calls"], r["rounds"], r["stop_reason"], r["error_code"]) for r in tasks.collect()}
    assert got == {"t1": (2, 1, "error", "E1"), "t2": (0, 1, "error", "E2"), "t3": (3, 1, "error", "E3"), "t4": (4, 2, "no_new_evidence", None)}
    status = {r["need_id"]: r["status"] for r in state.collect()}
    assert [status[f"n{t}{i}"] for t in (1, 2, 3) for i in (1, 2, 3)] == ["sufficient", "missing", "missing", "missing", "missing", "missing", "sufficient", "sufficient", "missing"]
    # a need behind the budget never has its turn
    late = spark.createDataFrame([("n43", "E4", True)], "need_id string, error_code string, called boolean")
    assert nd.controlled_retrieval(spark.createDataFrame(rows_[9:], NEED), chunks, failures=late, max_calls=2)[0].first()["stop_reason"] == "budget"


def test_required_fields_and_several_urls(spark):
    chunks = spark.createDataFrame([
        ("c0", "http://a/", 0, "alpha", "WEB", None, {"author": "x", "empty": "", "9bad": "y"}), ("c1", "http://b/", 0, "beta", "WEB", "2024-01-01", None),
        ("c2", "http://b/", 1, "beta two", "WEB", "", None)],
        "chunk_id string, file_id string, chunk_index bigint, chunk_text string, source string, published_at string, metadata map<string,string>")
    direct = lambda name, fields, urls, n=1, terms=(): (name, "see these", "DIRECT_URL", list(terms), n, fields, urls)
    asks = spark.createDataFrame([
        direct("first", ["author"], ["http://a/", "http://b/"]), direct("second", ["published_at"], ["http://a/", "http://b/"]),
        direct("none", ["empty"], ["http://a/", "http://b/"]), direct("bad", ["9bad"], ["http://a/"]), direct("many", ["content", "evidence_id"], ["http://a/", "http://b/"], 3),
        direct("loop", ["empty"], ["http://a/", "http://a/"]), direct("lost", [], ["http://x/", "http://y/", "http://b/"]), direct("calls", ["empty"], [f"http://{c}/" for c in "abxyz"]),
        ("search", "beta", "WEB", [], 1, ["author"], None), ("terms", "beta", "WEB", ["beta"], 1, ["published_at"], [])],
        "task_id string, query string, strategy string, required_terms array<string>, minimum_evidence int, required_fields array<string>, urls array<string>")
    got = {r["task_id"]: (r["status"], r["calls"], r["stop_reason"], r["missing"]) for r in nd.cross_source_retrieval(asks, chunks, max_rounds=5, max_calls=2)[0].collect()}
    assert got == {
        "first": ("SUFFICIENT", 1, "SUFFICIENT", ""), "second": ("SUFFICIENT", 2, "SUFFICIENT", ""), "none": ("INSUFFICIENT", 2, "BUDGET_EXHAUSTED", "empty"),
        "bad": ("INSUFFICIENT", 1, "SOURCES_EXHAUSTED", "9bad"), "many": ("SUFFICIENT", 2, "SUFFICIENT", ""), "loop": ("INSUFFICIENT", 1, "LOOP_PREVENTED", "empty"),
        "lost": ("INSUFFICIENT", 2, "NO_NEW_EVIDENCE", "minimum_evidence"), "calls": ("INSUFFICIENT", 2, "BUDGET_EXHAUSTED", "empty"),
        "search": ("INSUFFICIENT", 2, "BUDGET_EXHAUSTED", "author"), "terms": ("SUFFICIENT", 1, "SUFFICIENT", "")}
    asked = spark.createDataFrame([("q", "zz", "WEB", [], 1, ["author"], None)], asks.schema)
    assert nd.cross_source_retrieval(asked, chunks, max_rounds=5, max_calls=9)[0].first()["stop_reason"] == "NO_NEW_EVIDENCE"


def test_call_budget_follows_need_order(spark):
    chunks = chunk_frame(spark, ["alpha", "beta"])
    needs = spark.createDataFrame([("t", f"n{i}", i, w, w, [], 1) for i, w in enumerate(("alpha", "beta", "alpha x"), 1)], NEED)
    tasks, state, _ = nd.controlled_retrieval(needs, chunks, max_calls=2)
    assert rows(tasks.select("calls", "stop_reason", "answer_status")) == [(2, "budget", "not_found")]
    assert {r["need_id"]: r["status"] for r in state.collect()} == {"n1": "sufficient", "n2": "sufficient", "n3": "missing"}


def test_cross_source_rounds(spark):
    chunks = chunk_frame(spark, ["alpha local", "alpha web page", "beta"]).withColumn(
        "source", F.when(F.col("chunk_id") == "c0", "LOCAL").otherwise("WEB")).withColumn("file_id", F.when(F.col("chunk_id") == "c2", "http://x/").otherwise(F.col("file_id")))
    asks = spark.createDataFrame([("a", "alpha", "LOCAL", [], 1), ("b", "alpha", "BOTH", [], 2), ("c", "zulu", "WEB", [], 1),
                                  ("d", "http://x/", "DIRECT_URL", [], 1), ("e", "http://none/", "DIRECT_URL", [], 1)],
                                 "task_id string, query string, strategy string, required_terms array<string>, minimum_evidence int")
    got = {r["task_id"]: (r["status"], r["calls"], r["stop_reason"]) for r in nd.cross_source_retrieval(asks, chunks)[0].collect()}
    assert got == {"a": ("SUFFICIENT", 1, "SUFFICIENT"), "b": ("SUFFICIENT", 2, "SUFFICIENT"), "c": ("INSUFFICIENT", 2, "NO_NEW_EVIDENCE"),
                   "d": ("SUFFICIENT", 1, "SUFFICIENT"), "e": ("INSUFFICIENT", 1, "SOURCES_EXHAUSTED")}


def test_stream_runs_on_after_a_restart(spark, tmp_path):
    schema = "trace_id bigint, session_id int, event_type string, result_status string, duration_ms bigint, metrics_json string, created_at timestamp"
    import datetime as dt
    row = lambda i: (i, i % 2, "tool_execution", "success" if i % 3 else "failed", i, '{"p": "13812345678"}', dt.datetime(2024, 1, 1, 0, i % 60))
    base = str(tmp_path)

    def run(ids):
        spark.createDataFrame([row(i) for i in ids], schema).write.mode("append").parquet(base + "/in")
        trace_stream.clean_log(spark, base + "/in", base + "/log", base + "/cp1", "10 days")
        trace_stream.session_counters(spark, base + "/log", base + "/out", base + "/cp2")
        return {r["session_id"]: (r["calls"], r["failed_calls"], r["total_duration_ms"]) for r in trace_stream.latest_counters(spark, base + "/out").collect()}

    run(range(10))
    got = run(list(range(5, 16)))
    want = {s: (len(x), sum(i % 3 == 0 for i in x), sum(x)) for s in (0, 1) for x in ([i for i in range(16) if i % 2 == s],)}
    assert got == want
    assert {r[0] for r in spark.read.parquet(base + "/log").select("metrics_json").collect()} == {'{"p": "138****5678"}'}


def test_excerpts_in_drafts_of_any_size(spark):
    from gleanery.operators import evidence as ev
    texts = spark.createDataFrame([("a", f"e{i}", f"line{i % 7}of{i}") for i in range(400)] + [("b", "e0", "xyz")], "draft_id string, text_id string, body string")
    phrases = spark.createDataFrame([("a", i, f"line{i}of") for i in range(30)] + [("a", 90, "3"), ("b", 1, "y"), ("b", 2, "q")], "draft_id string, phrase_id int, phrase string")
    direct = texts.join(phrases, "draft_id").filter("contains(body, phrase)").select("draft_id", "phrase_id", "text_id")
    found = set(rows(ev._excerpt_hits(texts, phrases)))
    assert found == set(rows(direct)) and ("a", 90, "e3") in found and ("b", 1, "e0") in found


def test_other_units_and_periods_are_no_conflict(spark):
    from gleanery.operators import evidence as ev
    data = [("d", "l1", "LOCAL", "mass", "5", "r", 2020, "Q1", "kg"), ("d", "w1", "WEB", "mass", "5000", "r", 2020, "Q1", "g"), ("d", "w2", "WEB", "mass", "6", "r", 2020, "Q2", "kg"),
            ("d", "w3", "WEB", "mass", "7", "r", 2020, "Q1", "kg")]
    e = spark.createDataFrame(data, "draft_id string, evidence_id string, source_type string, field string, value string, record_key string, year int, period string, unit string")
    assert sorted(r[1] for r in rows(ev.value_conflicts(e))) == ["l1", "w3"]
    assert ev.value_conflicts(e.drop("period", "unit")).count() == 4


RECORD = ("draft_id string, evidence_id string, position int, source_type string, file_id string, file_name string, chunk_id string, page_no int, `table` string, cell string, "
          "sheet string, field string, record_key string, url string, domain string, retrieved_at string, content string, value string, year int, evidence_version string, conflict boolean")


def web_record(draft, eid, position, content, url="https://h.example/", version="4.0"):
    return (draft, eid, position, "WEB", None, None, None, None, None, None, None, None, None, url, "H.example.", "2024-05-01", content, None, None, version, False)


def test_gate_leaves_no_shuffle_files_and_sends_no_sources(spark):
    from gleanery.operators import evidence as ev

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}

    rng = random.Random(4)
    far = lambda: "https://h.example/" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(2000))
    e = spark.createDataFrame([web_record(f"d{i % 500}", f"e{i}", i, f"fact {i} end", far()) for i in range(2000)], RECORD)
    drafts = spark.createDataFrame([(f"d{i}", f"fact {i} end. Other [e{i}]", "state") for i in range(500)], "draft_id string, draft string, query string")
    claim_map = spark.createDataFrame([("d1", "fact 1 end.", "e1")], "draft_id string, claim string, mapped_id string")
    before = shuffled()
    warnings, links = ev.evidence_gate(drafts, e, claim_map)
    late = time.time() + 10
    while (left := sum(n for name, n in shuffled().items() if name not in before)) and time.time() < late:
        time.sleep(0.1)
    assert left == 0
    assert "hashpartitioning" not in ev.judge_evidence(e, ev.repeated_ids(e))._jdf.queryExecution().executedPlan().toString()
    assert warnings.count() == 0 and links.filter("evidence_id is not null").count() == 1000


def test_only_the_first_place_of_an_id_is_usable(spark):
    from gleanery.operators import evidence as ev
    e = spark.createDataFrame([
        web_record("d", "a", 3, "one fact"), web_record("d", "a", 2, "other"), web_record("d", "b", None, "two facts"), web_record("d", None, 1, "three"),
        web_record("d", "c", 5, "four", version="3.0"), web_record("d", "c", 6, "five"), web_record("gone", "a", 1, " ")], RECORD)
    drafts = spark.createDataFrame([("d", "other; one fact; Six [a]; Seven [c]", "latest")], "draft_id string, draft string, query string")
    none = spark.createDataFrame([], "draft_id string, claim string, mapped_id string")
    warnings, links = ev.evidence_gate(drafts, e, none)
    assert sorted(rows(warnings)) == [("d", "EVIDENCE_INVALID", 5), ("d", "EVIDENCE_MISSING", 2)]
    assert sorted(rows(links.select("claim_no", "evidence_id", "unknown")), key=str) == [(1, "a", False), (2, None, False), (3, "a", False), (4, None, True)]


def test_whole_results_above_the_old_bounds(spark):
    assert rt.candidate_limit(130) == 520
    long_json = '{"a": "' + "x" * 3000 + '"}'
    got = sinks.trace_rows(spark.createDataFrame([(long_json,)], "metrics_json string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))).first()
    assert got["metrics_json"] == long_json
    message = "；".join(f"比较第{i}项并判断" for i in range(9))
    needs = nd.need_decompose(spark.createDataFrame([(1, message)], "request_id int, message string"))
    assert needs.count() == 9
    cells = [(1, r, c, f"name {c}" if r == 70 else str(r * c), r == 70) for r in (70, 71) for c in range(1, 301)]
    from gleanery.operators.windows import header_rows
    head = header_rows(spark.createDataFrame(cells, "sheet int, row int, col bigint, value string, is_text boolean")).first()
    assert (head["header_row"], head["last_column"]) == (70, 300)
    df = spark.range(5).withColumn("row_number", F.col("id"))
    assert tb.query_table(df, tb.TableQuery(["id"], limit=5000)).count() == 5


def test_one_region_per_chunk_and_total_orders(spark):
    from gleanery.operators.regions import region_provenance
    regions = spark.createDataFrame([("f", "r", 1, "b", 2), ("f", "r", 1, "c", 1)], "file_id string, region_id string, page_no int, bbox string, seq int")
    chunks = spark.createDataFrame([("c1", "f", "r", 1, None), ("c2", "f", None, 1, "b")], "chunk_id string, file_id string, region_id string, page_no int, bbox string")
    assert sorted(rows(region_provenance(chunks, regions))) == [("c1", "r"), ("c2", "r")]
    data = [(1, 5, "b", None), (1, 5, "a", 2), (1, 5, "a", 1), (1, 6, "0", 0)]
    for seed in range(4):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, "k int, position int, t string, n int").repartition(3)
        assert rows(rk.first_per_key(df, ["k"], F.col("position"))) == [(1, 5, "a", 1)]


def test_texts_without_a_colon_leave_before_the_join(spark):
    from gleanery.operators import regions as rg
    data = [("f", 1, 5, "r1", "no label\n a : b \nC：d"), ("f", 1, 2, "r2", "no label"), ("f", 1, 3, "r3", ":x"), ("f", 1, 4, "r4", None)]
    df = spark.createDataFrame(data, "file_id string, page_no int, seq int, region_id string, text string").selectExpr(
        "*", "array(0D, 0D, 1D, 1D) as bbox", "0.9D as confidence", "false as review_required", "true as safe_for_high_impact", "string(null) as visual_block_type")
    fields = rg.label_value_fields(rg.visual_blocks(df))
    assert {(r["field_label"], r["value"], r["status"]) for r in fields.collect()} == {("a", "b", "extracted"), ("C", "d", "extracted")}
    plan = fields._jdf.queryExecution().optimizedPlan().toString()
    assert ", [:：])" in plan[plan.index("Join"):]


def test_first_rows_are_held_once(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, None, "c"), (2, 7, None)], "k int, position int, t string")
    first, last = (rk.first_per_key(df, ["k"], F.col("position"), last) for last in (False, True))
    assert sorted(rows(first)) == [(1, 1, "a"), (2, None, "c")] and sorted(rows(last)) == [(1, 2, "b"), (2, 7, None)]
    assert "min_by" not in first._jdf.queryExecution().toString()


def test_large_integers_keep_their_order(spark):
    data = [(1, 2**53 + 1, 1), (1, 2**53, 2), (1, 2**53 + 2, 3), (1, 5, 4)]
    df = spark.createDataFrame(data, "g int, v bigint, t bigint")
    assert {r["t"]: r["position"] for r in rk.position_in_group(df, ["g"], "v", "t").collect()} == {4: 1, 2: 2, 1: 3, 3: 4}
    assert {r["t"]: r["position"] for r in rk.position_in_group(df, ["g"], "v", "t", descending=True).collect()} == {3: 1, 1: 2, 2: 3, 4: 4}


def test_delimited_headers_and_quotes(spark, tmp_path):
    def read(name, text, **options):
        (tmp_path / name).write_text(text)
        return tables.read_delimited(spark, str(tmp_path / name), **options)
    with pytest.raises(ValueError):
        read("a.csv", "id,id,name\n1,2,3\n")
    with pytest.raises(ValueError):
        read("b.csv", "id,,name\n1,2,3\n")
    assert rows(read("c.csv", '_cost,note\n1,"two\nlines, ""quoted"""\n')) == [("1", 'two\nlines, "quoted"')]
    assert read("d.csv", "a|b;c\n1|2;3\n4|5;6\n", delimiter=None).columns in (["a", "b;c"], ["a|b", "c"])
    assert read("e.csv", "a\tb\tc,d\n1\t2\t3\n", delimiter=None).columns == ["a", "b", "c,d"]


def test_broken_json_does_not_end_the_job(spark):
    from gleanery.functions.redact import HIDDEN_KEYS, redact_by_key, strip_hidden_keys
    df = spark.createDataFrame([('{"a": 1',), ('{"%s": 1, "b": 2}' % HIDDEN_KEYS[0],), (None,)], "j string")
    assert [r[0] for r in df.select(strip_hidden_keys("j")).collect()] == [None, '{"b": 2}', None]
    assert [r[0] for r in df.select(redact_by_key("j")).collect()][0] is None


def test_decimal_literals_are_exact(spark):
    df = spark.sql("select cast('12345678901234567.01' as decimal(20,2)) d union all select cast('12345678901234567.02' as decimal(20,2))")
    assert tb.apply_filters(df, [tb.Filter("d", "=", "12345678901234567.01")]).count() == 1
    with pytest.raises(tb.ArgumentError):
        tb.apply_filters(df, [tb.Filter("d", "=", "x")])


def test_markdown_paths_and_cells():
    blocks = list(docs.scan_markdown("# A\n\n## B\ntext\n\n| x | y |\n|---|---|\n| 1 | a\\|b |\n\n### C\n# D\nend\n\n| x | y |\n|---|---|\n| 1 |\n"))
    assert [(b["kind"], b["heading_path"]) for b in blocks] == [
        ("heading", ["A"]), ("heading", ["A", "B"]), ("paragraph", ["A", "B"]), ("table", ["A", "B"]), ("heading", ["A", "B", "C"]),
        ("heading", ["D"]), ("paragraph", ["D"]), ("table", ["D"])]
    assert [(c["row"], c["col"], c["value"]) for c in blocks[3]["cells"]] == [(1, 1, "x"), (1, 2, "y"), (2, 1, "1"), (2, 2, "a|b")]
    assert blocks[7]["cells"] is None and blocks[0]["cells"] is None


def test_scope_is_applied_before_ranking(spark):
    from gleanery.operators.scope import search_scope
    chunks = spark.createDataFrame([(f"c{i}", f"f{i % 2}", i, i % 3, "same words here") for i in range(30)], "chunk_id string, file_id string, chunk_index int, page_no int, chunk_text string")
    queries = spark.createDataFrame([(1, "words here"), (2, "words here")], "query_id int, query string")
    files = spark.createDataFrame([("f0", '{"lang": "en", "document_metadata": {"year": "1"}}'), ("f1", '{"lang": "en"}')], "file_id string, metadata string")
    asked = spark.createDataFrame([(1, "lang", "en"), (1, "year", "1"), (2, "lang", "en")], "query_id int, key string, value string")
    scope = search_scope(asked, files, ["lang", "year"])
    assert sorted(rows(scope)) == [(1, "f0"), (2, "f0"), (2, "f1")]
    paged = scope.withColumn("page_no", F.lit(2))
    for found in (rt.keyword_retrieve(chunks, queries, 4, paged), rt.vector_retrieve(chunks, queries, 4, paged)):
        got = {(r["query_id"], r["chunk_id"]) for r in found.collect()}
        assert {c for q, c in got if q == 1} == {"c2", "c8", "c14", "c20"} and len({c for q, c in got if q == 2}) == 4


def test_pages_keep_their_first_values():
    html = ("<title>A <b>b</b></title><title>c</title><meta name=Description content=' d '><meta property='og:description' content=e><meta name=description content=f>"
            "<link rel='x Canonical' href='/p#q'><link rel=canonical href='/other'><script>no</script></script><p>one<style>no</style> two</p><svg><p>no</p></svg>three<template>x")
    got = docs.read_page(html, "HTTP://h.example/a")
    assert (got["title"], got["description"], got["content"], got["canonical_url"], got["domain"]) == ("A b c", "d", "one\ntwo\nthree", "http://h.example/p", "h.example")
    assert docs.read_page("<link rel=canonical href='ftp://x/'>", "http://h.example/a")["canonical_url"] == "http://h.example/a"
    assert docs.read_page("<link rel=canonical href='http://u:p@x/'>t", "http://h.example/a")["content"] == "t"


def test_metrics_of_results_with_missing_fields(spark):
    from gleanery.operators import traces as tr
    data = "named_struct('mode', 'm', 'evidence_chain', array(named_struct('evidence_id', 'e1'), named_struct('evidence_id', cast(null as string))))"
    df = spark.sql(f"select 1 as id, 'retrieve_web' as tool_name, {data} as data, 'failed' as result_status, -3 as duration_ms union all select 2, 'retrieve_document', {data}, 'success', 5 union all select 3, 'other', null, 'success', 1")
    got = {r["id"]: r.asDict() for r in tr.result_metrics(df, ["id"]).collect()}
    assert set(got) == {1, 2}
    web, doc = got[1], got[2]
    assert (web["result_count"], web["fetch_status"], web["latency_ms"], web["evidence_ids"], web["source_strategy"], web["detected_untrusted_patterns"]) == (2, "failed", 0, ["e1"], "WEB", [])
    assert (doc["result_count"], doc["top_k_count"], doc["fallback_used"], doc["top_score"], doc["evidence_ids"]) == (0, 0, False, None, [])


def test_reports_of_odd_parts(spark):
    reports = spark.createDataFrame([("r1", "t", "a\nb", None, "<x>", "*y*", "p", "l", "PASS"), ("r2", "t", "c", "d", "e", "f", "p", "l", "WARNING")],
                                    "report_id string, task_id string, title string, created_at string, task_description string, summary string, process string, limits string, quality_status string")
    conclusions = spark.createDataFrame([("r1", 1, "second", None), ("r1", 0, "first", ["a_b"])], "report_id string, position int, text string, evidence_refs array<string>")
    evidence = spark.createDataFrame([("r1", 0, None, "LOCAL", None, None, None, 3, 5, {"line_number": 9, "line_end": None})],
                                     "report_id string, position int, evidence_id string, source_type string, file_name string, url string, retrieved_at string, page_no int, line_number int, metadata struct<line_number int, line_end int>")
    warnings = spark.createDataFrame([("r2", 0, "C", None)], "report_id string, position int, code string, message string")
    got = dict(tuple(r) for r in sinks.render_reports(reports, conclusions, evidence, warnings).collect())
    assert got["r1"] == ("# a b\n\n报告 ID：r1\n研究任务：t\n生成时间：None\n\n## 任务说明\n\n&lt;x&gt;\n\n## 摘要\n\n\\*y\\*\n\n## 分析过程\n\np\n\n## 核心结论\n\n- first\n  Evidence：a\\_b\n\n"
                         "- second\n  Evidence：未建立证据关联\n\n## Evidence 来源\n\n### 未标识\n来源类型：本地文档\n来源：None\n定位：\\{\"page\\_no\": 3, \"line\\_number\": 9\\}\n\n"
                         "## 限制说明\n\nl\n\nEvidence Quality：PASS\n- 规则检查未发现警告；不代表事实正确性保证。\n")
    assert got["r2"].endswith("Evidence Quality：WARNING\n- C：None\n") and "### " not in got["r2"]


def region_rows(spark):
    texts = ["奖学金证书", "正文。", "a|b|c", "通知", "x|y|z", None, "a\tb"]
    data = [(i // 3, None if i == 4 else 1, i, f"r{i}", texts[i % 7], "table" if i in (2, 20) else None) for i in range(60)] + [(90, 1, 1, "t1", "a|b|c", None), (90, 2, 2, "t2", "a\tb", None)]
    return spark.createDataFrame(data, "file_id int, page_no int, seq int, region_id string, text string, visual_block_type string"), data


def test_document_class_forms_blocks_for_evidence_only(spark):
    from gleanery.operators.regions import document_class, visual_blocks
    regions, data = region_rows(spark)
    blocks = visual_blocks(regions)
    assert blocks.count() == len(data), "a region without a page is a block too"
    kinds = {r["block_id"]: (r["file_id"], r["region_id"]) for r in blocks.collect()}
    found = document_class(blocks)
    assert len(re.findall(r"\bJoin\b", found._jdf.queryExecution().optimizedPlan().toString())) == 2
    rule = lambda text: 0 if "证书" in (text or "") else 1 if "通知" in (text or "") else None
    table = lambda text, kind: kind == "table" or (kind is None and ("\t" in (text or "") or (text or "").count("|") >= 2))
    want = set()
    for file in {d[0] for d in data}:
        here = [d for d in data if d[0] == file]
        best = min((rule(d[4]) for d in here if rule(d[4]) is not None), default=None)
        tables = all(table(d[4], d[5]) for d in here)
        name = {0: "certificate", 1: "notice", None: "table" if tables else "unknown"}[best]
        shown = [d[3] for d in here if (rule(d[4]) == best if best is not None else tables)]
        want |= {(file, name, r) for r in shown or [None]}
    assert {(r["file_id"], r["document_type"], r["block_id"] and kinds[r["block_id"]][1]) for r in found.collect()} == want
    assert (90, "table", "t1") in want and {n for _, n, _ in want} == {"certificate", "notice", "table", "unknown"}


def test_a_chunk_is_looked_up_by_id_or_by_box(spark):
    from gleanery.operators.regions import region_provenance
    regions = spark.createDataFrame([(1, 1, 2, "b", [0.0, 1.0]), (1, 1, 1, "a", [0.0, 1.0]), (1, 1, 3, "c", None), (1, 1, 3, "c", None)], "file_id int, page_no int, seq int, region_id string, bbox array<double>")
    chunks = spark.createDataFrame([("id", 1, 1, None, "c"), ("box", 1, 1, [0.0, 1.0], None), ("other", 1, 1, [0.0, 1.0], "zz"), ("page", 1, 2, [0.0, 1.0], None),
                                    ("bare", 1, 1, None, None), ("file", None, 1, None, "c")], "chunk_id string, file_id int, page_no int, bbox array<double>, region_id string")
    found = region_provenance(chunks, regions)
    assert dict(map(tuple, found.collect())) == {"id": "c", "box": "a", "other": None, "page": None, "bare": None, "file": None}
    assert found.count() == 6
    # no chunk goes through both lookups
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert plan[0].startswith("Union") and len([line for line in plan if "Join" in line]) == 2


def test_cells_are_dealt_out_by_rows_before_they_are_compared(spark):
    from gleanery.operators import entities as en
    cells = spark.createDataFrame([(1, s, r, n, v) for s, r, n, v in (("a", 1, "name", "X"), ("b", 2, "name", " x "), ("b", 3, "name", "Y"), ("b", 2, "class", "1"), ("a", 1, "class", ""))],
                                  "workspace int, source string, row_number int, canonical_name string, value string")
    links = spark.createDataFrame([(1, "e", "a", 1, "m"), (1, "e", "b", 2, "m"), (1, "f", "b", 3, "m"), (1, "f", "b", 2, "m")], "workspace int, entity_id string, source string, row_number int, method string")
    found = en.consensus_values(links, cells)
    assert sorted(map(tuple, found.collect())) == [(1, "e", "class", "1", "1"), (1, "e", "name", "x", " x "), (1, "f", "class", "1", "1")]
    assert "RepartitionByExpression [workspace" in found._jdf.queryExecution().optimizedPlan().toString()


def test_validation_reads_the_linked_cells_once(spark, monkeypatch):
    from gleanery.operators import entities as en
    data = [("a", 1, "student_id", "S1"), ("a", 1, "phone", "call me"), ("a", 1, "grade", "1"), ("b", 1, "student_id", "S1"), ("b", 1, "date", "2024-01-01"), ("b", 1, "grade", "1"),
            ("b", 2, "student_id", "S1"), ("b", 2, "date", "2024-02-01"), ("b", 2, "grade", "2"), ("a", 2, "student_id", "S2"), ("a", 2, "grade", "1")]
    cells = spark.createDataFrame([(1, *d) for d in data], "workspace int, source string, row_number int, canonical_name string, value string")
    ids = spark.createDataFrame([(1, "S1"), (1, "S2")], "workspace int, entity_id string")
    made, linked = [], en.linked_values
    monkeypatch.setattr(en, "linked_values", lambda *a: (made.append(linked(*a)), monkeypatch.setattr(en, "_with_norm", None), made[-1])[2])
    issues, final = en.validate_entities(ids, cells, en.source_profile(cells))
    assert len(made) == 1
    assert sorted((r["entity_id"], r["issue_type"]) for r in issues.collect()) == [
        ("S1", "cross_file_count_mismatch"), ("S1", "duplicate_record"), ("S1", "invalid_contact_format"), ("S1", "same_field_different_value"),
        ("S1", "same_field_different_value"), ("S1", "time_version_conflict")]
    assert {r["entity_id"]: (r["status"], r["issue_count"]) for r in final.collect()} == {"S1": ("conflict", 6), "S2": ("found", 0)}
