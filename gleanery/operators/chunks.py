"""Blocks to overlapping chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import ids
from gleanery.operators.ranking import running_sum

CHUNK_SIZE, OVERLAP = 900, 100


def chunk_count(content: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """A chunk starts at every step inside the text; an empty block has one empty chunk."""
    return F.greatest(F.ceil(F.length(content) / (size - overlap)), F.lit(1)).cast("int")


def block_chunks(blocks: DataFrame, keep: Sequence[str], size: int = CHUNK_SIZE,
                 overlap: int = OVERLAP) -> DataFrame:
    """Chunks of single-block files: ``chunk_index`` is the offset inside the block."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("chunk size and overlap do not fit")
    step = size - overlap
    starts = F.sequence(F.lit(0), chunk_count(F.col("content"), size, overlap) - 1)
    return (blocks.select(*keep, "content", F.explode(starts).alias("chunk_index"))
            .select(*keep, "chunk_index",
                    F.substring("content", F.col("chunk_index") * step + 1, F.lit(size)).alias("chunk_text")))


def file_chunks(blocks: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Chunks of files with many blocks (file_id, sequence, block_id, content).

    Indexes run on across the blocks of a file; only block lengths are summed, not text.
    """
    counts = blocks.select("file_id", "sequence", chunk_count(F.col("content")).cast("bigint").alias("n"))
    first = running_sum(counts, ["file_id"], "sequence", "n", "first_index").drop("n")
    parts = block_chunks(blocks, ["file_id", "sequence", "block_id", *keep]).withColumnRenamed("chunk_index", "offset")
    hashed = parts.withColumn("text_hash", ids.text_hash(F.col("chunk_text")))
    joined = hashed.join(first, ["file_id", "sequence"])
    return joined.select(
        "file_id", "block_id", *keep,
        ids.chunk_id(F.col("block_id"), F.col("offset"), F.col("text_hash")).alias("chunk_id"),
        (F.col("first_index") + F.col("offset")).cast("bigint").alias("chunk_index"), "chunk_text", "text_hash")


def check_candidate(chunks: DataFrame) -> DataFrame:
    """Verdict per file on a candidate index: ids unique, indexes 0..n-1, hashes right.

    One row per (file, chunk id) is formed first, so the count of distinct ids and
    of repeats comes from two plain aggregates.
    """
    per_id = chunks.groupBy("file_id", "chunk_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"),
        F.bool_and(F.col("text_hash") == ids.text_hash(F.col("chunk_text"))).alias("hashes"))
    per_file = per_id.groupBy("file_id").agg(
        F.sum("n").alias("chunk_count"), F.max("n").alias("most"), F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.bool_and("hashes").alias("hashes"),
        F.bool_or(F.col("chunk_id").isNull() | (F.col("chunk_id") == "")).alias("no_id"))
    n = F.col("chunk_count")
    index_repeats = (chunks.groupBy("file_id", "chunk_index").agg(F.count(F.lit(1)).alias("c"))
                     .filter("c > 1").select("file_id").distinct().withColumn("repeat", F.lit(True)))
    judged = per_file.join(index_repeats, "file_id", "left")
    return judged.select(
        "file_id", F.col("chunk_count").cast("bigint").alias("chunk_count"),
        F.when(F.col("no_id") | (F.col("most") > 1), "CHUNK_ID_MISSING_OR_REPEATED")
        .when(~F.col("hashes"), "TEXT_HASH_MISMATCH")
        .when((F.col("low") != 0) | (F.col("high") != n - 1) | F.coalesce(F.col("repeat"), F.lit(False)),
              "CHUNK_INDEX_NOT_DENSE")
        .otherwise("ok").alias("verdict"))
