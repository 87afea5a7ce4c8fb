"""The registered corpus queries on the smallest tables, and the pipeline stage by stage."""

import os
from collections import Counter

import pytest
from comparing import compare, connect
from helpers import words
from test_mixing import WORD
from test_packing import check as packed_rows

import __spark_entry__ as entry
import corpus_pipeline
from gleanery.llm import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CONTRACT = {
    "op1_private_spans": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op4_mixed_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op5_toxic_scores": ["doc_id", "held_out", "score", "predicted"],
    "op6_url_verdicts": ["page_id", "host", "path", "rule", "verdict"],
    "op9_repeated_lines": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op10_anchor_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op11_packed_documents": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op12_aligned_tokenizers": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op13_whitened_embeddings": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert set(CONTRACT.get(name, [])) <= set(df.columns)
    if name in queries.SQL:
        assert compare(df, connect(SF_DIR), queries.SQL[name]) is None
    elif name == "op11_packed_documents":
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
        packed_rows(df.collect(), texts, 1024)
    elif "doc_id" in df.columns and name != "op7_benchmark_leaks":
        assert df.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    else:
        assert df.count() > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF_DIR)
        seen[name] = docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name != "mixing":
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    assert seen["line dedup"].count() == seen["toxicity"].count()
    shingles = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) for w in (words(r["text"]) for r in seen["near-dedup"].collect()) if w]
    assert all(n == 1 for n in Counter(r["text"] for r in seen["near-dedup"].collect()).values())
    near = [(a, b) for i, a in enumerate(shingles) for b in shingles[:i] if len(a & b) >= 0.9 * len(a | b)]
    assert near == []
    items = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert not any(item in r["text"] for item in items for r in seen["decontamination"].collect())
    left = {r["doc_id"]: WORD.findall(r["text"] or "") for r in seen["decontamination"].collect()}
    pieces = seen["mixing"].collect()
    for r in pieces:
        assert r["text"].split(" ") == left[r["doc_id"]][r["word_from"]:r["word_from"] + r["taken"]] and r["size"] == len(left[r["doc_id"]])
    for source, target in {(r["source"], r["target"]) for r in pieces}:
        mine = [r for r in pieces if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - target) <= max(2, 0.005 * mine[0]["source_size"])
    key = lambda r: (r["shard"], r["place"], r["at"])
    assert sorted(corpus_pipeline.run(spark, SF_DIR).collect(), key=key) == sorted(pieces, key=key)
