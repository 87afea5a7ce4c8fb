"""Batch outcomes over whole tables of targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def below_threshold(profiles: DataFrame, threshold: float, without_facts: bool = False) -> DataFrame:
    """success below the threshold, skipped at or above it, failed without a score."""
    found, average = F.col("score_status") == "found", F.col("average")
    status = F.when(~found, "failed").when(average >= threshold, "skipped")
    if without_facts:
        status = status.when(F.col("fact_status") != "no_record", "skipped")
    return profiles.select(
        F.col("entity_id").alias("target_id"), status.otherwise("success").alias("status"),
        F.when(F.col("score_status") == "no_record", "SCORE_NO_RECORD").when(~found, "INVALID_SCORE_DATA").alias("error_code"))


def group_headcount(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(F.col(group).cast("string").alias("target_id")).agg(
        F.count(F.lit(1)).alias("headcount")).select("target_id", F.lit("success").alias("status"), "headcount")


def quality_items(validated: DataFrame) -> DataFrame:
    """One successful item per entity that says its quality status and issue count."""
    return validated.select("workspace", F.col("entity_id").alias("target_id"), F.lit("success").alias("status"), F.concat(
        F.lit("quality "), "status", F.lit(", issues "), F.col("issue_count").cast("string")).alias("result_summary"))


def status_counters(items: DataFrame, batch: str = "batch_id") -> DataFrame:
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return items.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total"), n("success").alias("success_count"),
        n("failed").alias("failed_count"), n("skipped").alias("skipped_count"))


def final_status(counters: DataFrame) -> DataFrame:
    return counters.withColumn(
        "final_status", F.when(F.col("success_count") > 0, "success")
        .when(F.col("skipped_count") > 0, "skipped").otherwise("failed"))


def batch_report(items: DataFrame, batch: str = "batch_id") -> tuple[DataFrame, DataFrame]:
    """(totals, failure details)."""
    failures = items.filter("status = 'failed'").select(batch, "target_id", "error_code", F.col("result_summary").alias("message"))
    return status_counters(items, batch), failures


def finish_batches(batches: DataFrame, items: DataFrame, outcome: str) -> tuple[DataFrame, DataFrame]:
    """(batches, items) after one outcome for the write of whole pending batches.

    Successful items of a failed or skipped write take that status; batches that
    are not pending stay as they are.
    """
    if outcome not in ("success", "failed", "skipped"):
        raise ValueError(f"unknown outcome {outcome}")
    pending = batches.select("batch_id", (F.col("batch_status") == "pending").alias("pending"))
    marked = items.join(pending, "batch_id", "left")
    rewrite = F.coalesce("pending", F.lit(False)) & (F.col("status") == "success") & F.lit(outcome != "success")
    code = "BATCH_CANCELLED" if outcome == "skipped" else "BATCH_WRITE_FAILED"
    new_items = marked.withColumn("error_code", F.when(rewrite, code).otherwise(F.col("error_code"))).withColumn(
        "status", F.when(rewrite, outcome).otherwise(F.col("status"))).drop("pending")
    counts = status_counters(new_items)
    new_batches = batches.join(counts, "batch_id", "left").withColumn(
        "batch_status", F.when(F.col("batch_status") == "pending", outcome).otherwise(F.col("batch_status")))
    return new_batches, new_items
