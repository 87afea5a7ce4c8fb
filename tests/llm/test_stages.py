"""Pipeline stages on odd tables: further columns of any name, null and repeated rows, long texts, no rows."""

import os

import pytest
from helpers import prose
from pyspark.sql import functions as F

import corpus_pipeline

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CLASHING = ("part", "n_lines", "n_dropped", "toxic_score", "text_class", "span_id", "class", "root", "kept_id", "place", "features", "carried_columns")


def odd_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(90001, None), (90002, ""), (90003, prose(5, 40)), (90003, prose(5, 40)), (90004, prose(6, 150_000)), (None, prose(7, 30))]
    more = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], docs.schema)
    return docs.unionByName(more)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_further_columns_are_carried(spark, name, stage):
    docs = odd_documents(spark)
    wide = docs.select(*[F.lit(f"own {c}").alias(c) for c in CLASHING[:6]], "*", *[F.lit(f"own {c}").alias(c) for c in CLASHING[6:]])
    plain, got = stage(spark, docs, SF_DIR), stage(spark, wide, SF_DIR)
    assert got.columns == wide.columns and plain.columns == docs.columns
    rows = got.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["text"])
    assert sorted(map(key, rows), key=str) == sorted(map(key, plain.collect()), key=str) and 0 < len(rows)
    ids = [r["doc_id"] for r in rows]
    assert ids.count(90003) == (1 if name == "near-dedup" else 2) and 90004 in ids


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty_tables(spark, name, stage):
    assert stage(spark, spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0), SF_DIR).collect() == []
