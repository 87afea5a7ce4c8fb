"""Corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their
columns; the last returns the mix itself, its pieces of text dealt to shards. ``run`` writes each stage's result as Parquet in the
shared folder and reads it again for the next one.

All stages: an empty table gives an empty one. A null or empty text has no words, n-grams
or shared lines: it is kept unless the toxicity model rejects it, and it is a near copy of
other such texts only. Texts of any length are read whole. Repeated rows are judged alike; of
those with one doc_id and text, near-dedup keeps a single one. Columns beside those of
``documents`` are carried along whatever they are called, since no operator sees their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.llm import decontaminate, linededup, mixing, neardup, toxicity
from gleanery.llm.words import small_batches
from gleanery.operators.storage import settle


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _carrying(stage: Stage) -> Stage:
    """The stage with further columns of the documents folded into one that no operator uses."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        own = [c for c in docs.columns if c in COLUMNS]
        others = [c for c in docs.columns if c not in COLUMNS]
        if not others:
            return stage(spark, docs, sf_dir)
        folded = docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in others]).alias("carried_columns"))
        kept = stage(spark, folded, sf_dir)
        return kept.select(*[F.col(c) if c in own else F.col("carried_columns")[c].alias(c) for c in docs.columns])
    return run


@_carrying
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by a model trained on the labelled ones among them, outside the held-out fold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).filter("toxic_score < 0.5").select(*docs.columns)


@_carrying
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least three of them share; n_chars follows the text. None is left out."""
    kept = linededup.dedup_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast("long"))


@_carrying
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near duplicates."""
    return neardup.keep_one(docs)


@_carrying
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per piece drawn, with its shard, place, text and words taken, beside doc_id, source, size, source_size
    and target. Partitions hold their pieces by shard and place. Documents that the mix takes nothing of are not in it."""
    own = docs.select("doc_id", "text", "source")
    return mixing.shard_texts(own, settle(mixing.mix(own)))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: The stages train, sketch and align, which SQL cannot say; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
