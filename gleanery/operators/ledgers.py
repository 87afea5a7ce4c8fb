"""Lists and roll-ups over ledgers of files, tasks, batches, collections and versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_tasks(tasks: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Tasks in a status set, newest first."""
    return tasks.filter(F.col("status").isin(list(statuses))).orderBy(F.col("created_at").desc(), "task_id")


def task_view(tasks: DataFrame, steps: DataFrame, batches: DataFrame) -> DataFrame:
    """Current step, progress percent, duration, failed step and counters per task.

    tasks: task_id, parent_id, status, created_at, completed_at, processed_pages,
    total_pages. steps: task_id, step_id, seq, status, started_at. batches: task_id,
    batch_no, total, success_count, failed_count, skipped_count; the newest counts.
    """
    from gleanery.functions.text import duration_ms

    seq = F.struct("seq", "step_id")
    running = F.col("status").isin("running", "waiting_confirmation")
    open_ = ~F.col("status").isin("success", "cancelled")
    per_task = steps.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.count_if(F.col("status").isin("success", "confirmed", "cancelled")).alias("completed_nodes"),
        F.min(F.when(running, seq)).alias("live"), F.min(F.when(open_, seq)).alias("waiting"),
        F.min(F.when(F.col("status") == "failed", seq)).alias("failed"),
        F.min(F.when(F.col("started_at").isNotNull(), F.struct("seq", "step_id", "started_at"))).alias("first"))
    newest = batches.groupBy("task_id").agg(F.max_by(
        F.struct("total", "success_count", "failed_count", "skipped_count"), F.col("batch_no")).alias("b"))
    top = tasks.filter(F.col("parent_id").isNull())
    j = top.join(per_task, "task_id", "left").join(newest, "task_id", "left")
    handled = F.col("b.success_count") + F.col("b.failed_count") + F.col("b.skipped_count")

    def percent(done, total):
        return F.floor(F.greatest(F.lit(0), F.least(done, total)) * 100 / total)

    return j.select(
        "task_id", F.when(F.col("status").isin("created", "pending"), "queued").when(F.col("status") == "confirmed", "running")
        .otherwise(F.col("status")).alias("display_status"),
        F.coalesce("live.step_id", "waiting.step_id").alias("current_step"),
        F.when(F.col("total_pages") > 0, percent(F.col("processed_pages"), F.col("total_pages")))
        .when(F.col("b.total") > 0, percent(handled, F.col("b.total")))
        .when(F.col("b").isNull() & (F.col("total_nodes") > 0), percent(F.col("completed_nodes"), F.col("total_nodes"))).alias("percent"),
        duration_ms(F.col("first.started_at"), F.col("completed_at")).alias("duration_ms"),
        F.col("failed.step_id").alias("failed_step"),
        *[F.coalesce(F.col(f"b.{c}"), F.lit(0)).alias(c) for c in ("success_count", "failed_count", "skipped_count")])


# Status sets of files.
FAILED_FILES = ("failed", "cleanup_failed")
READY_FILES = ("ready", "queryable")
PROCESSING_FILES = ("processing", "detecting", "parsing", "indexing", "reprocessing", "reindexing",
                    "visual_processing", "ocr_processing", "layout_processing")


def collection_members(collections: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """Collections with each member file and its state; empty collections keep one row."""
    joined = members.join(files, "file_id")
    return collections.join(joined, "collection_id", "left")


def collection_status(collections: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    state = F.lower("lifecycle_status")
    alive = F.col("file_id").isNotNull() & (state != "deleted")
    failed = alive & (state.isin(*FAILED_FILES) | (F.col("index_status") == "failed"))
    ready = state.isin(*READY_FILES) & (F.col("queryable") | (F.col("index_status") == "indexed"))
    grouped = collection_members(collections, members, files).groupBy("collection_id").agg(
        F.count_if(alive).alias("file_count"), F.count_if(failed).alias("bad"), F.count_if(alive & ~ready).alias("unready"),
        F.greatest(F.max("updated_at"), F.max("file_updated_at"), F.max("attached_at")).alias("updated_at"))
    return grouped.select(
        "collection_id", "file_count", "updated_at",
        F.when(F.col("file_count") == 0, "Empty").when(F.col("bad") > 0, "Failed")
        .when(F.col("unready") == 0, "Ready").otherwise("Indexing").alias("status"))


def batches_of_action(batches: DataFrame, items: DataFrame, action_id) -> DataFrame:
    """Batches that have an item with the action; each batch once."""
    return batches.join(items.filter(F.col("action_id") == action_id), "batch_id", "left_semi")


def resource_snapshot(files: DataFrame, collections: DataFrame, tasks: DataFrame, evidence: DataFrame) -> DataFrame:
    """(metric, value) counts over the ledgers."""
    state = F.lower(F.coalesce("canonical_status", "lifecycle_status", F.lit("")))
    f = files.agg(F.count(F.lit(1)).alias("files"), F.count_if(state.isin(*FAILED_FILES)).alias("failed"),
                  F.count_if(state.isin(*PROCESSING_FILES)).alias("processing"),
                  F.count_if(F.col("index_status") == "indexed").alias("indexed"))
    c = collections.agg(F.count(F.lit(1)).alias("collections"))
    k = tasks.filter(F.col("task_type").isin("research", "async_research")).agg(F.count(F.lit(1)).alias("tasks"))
    e = evidence.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("evidence"))
    out = None
    for df in (f, c, k, e):
        part = df.unpivot([], df.columns, "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out


def evidence_source_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("task_id").agg(
        F.count_if(F.col("source_type").isin("LOCAL", "structured", "unstructured")).alias("local_count"),
        F.count_if(F.col("source_type").isin("WEB", "URL")).alias("web_count"))


def latest_versions(versions: DataFrame) -> DataFrame:
    """Newest version per file and its parent, the target of an undo."""
    last = versions.groupBy("file_id").agg(F.max_by(
        F.struct("version_id", "version_number", "parent_version_id"), F.col("version_number")).alias("l")).select("file_id", "l.*")
    parents = versions.select("file_id", F.col("version_id").alias("parent_version_id"), F.col("version_number").alias("undo_number"),
                              F.col("status").alias("undo_status"))
    return last.join(parents, ["file_id", "parent_version_id"], "left").select(
        "file_id", "version_id", "version_number", "parent_version_id",
        F.when(F.col("parent_version_id").isNull(), "NO_UNDO_VERSION").when(F.col("undo_status") == "available", "ok")
        .otherwise("VERSION_NOT_FOUND").alias("undo_status"), "undo_number")


def version_integrity(versions: DataFrame) -> DataFrame:
    """Faults of version chains: content hash, missing parent, numbers that do not run on."""
    from gleanery.functions.ids import text_hash
    from gleanery.operators.ranking import previous_in_group

    known = versions.select("file_id", F.col("version_id").alias("parent_version_id"))
    bad_hash = versions.filter(text_hash(F.col("content")) != F.col("content_hash")).select(
        "file_id", "version_id", F.lit("VERSION_HASH_MISMATCH").alias("fault"))
    orphans = versions.filter("parent_version_id is not null").join(known, ["file_id", "parent_version_id"], "left_anti").select(
        "file_id", "version_id", F.lit("VERSION_PARENT_MISSING").alias("fault"))
    steps = previous_in_group(versions.select("file_id", "version_id", "version_number"), ["file_id"], "version_number", ["version_number"])
    gaps = steps.filter(F.col("version_number") != F.coalesce(F.col("prev_version_number"), F.lit(0)) + 1).select(
        "file_id", "version_id", F.lit("VERSION_NUMBER_GAP").alias("fault"))
    return bad_hash.unionByName(orphans).unionByName(gaps)


def version_diff_preview(requests: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Before and after text of append, undo and rollback, with the hash to expect.

    requests: file_id, operation, content, version_id. documents: file_id, text; a
    missing document is empty and its hash is ABSENT.
    """
    from gleanery.functions.ids import text_hash
    from gleanery.functions.text import strip

    target = requests.join(latest_versions(versions).select("file_id", F.col("parent_version_id").alias("undo_id")), "file_id", "left").withColumn(
        "target_id", F.when(F.col("operation") == "undo", F.col("undo_id")).when(F.col("operation") == "rollback", F.col("version_id")))
    stored = versions.filter("status = 'available'").select(
        "file_id", F.col("version_id").alias("target_id"), F.col("content").alias("stored"), F.col("version_number"))
    j = target.join(documents, "file_id", "left").join(stored, ["file_id", "target_id"], "left")
    append = F.col("operation") == "append"
    before = F.coalesce("text", F.lit(""))
    joined = F.concat_ws("\n", F.when(before != "", before), F.when(strip(F.col("content")) != "", strip(F.col("content"))))
    return j.select(
        "file_id", "operation", before.alias("before"), F.when(append, joined).otherwise(F.col("stored")).alias("after"),
        F.when(F.col("text").isNull(), "ABSENT").otherwise(text_hash(F.col("text"))).alias("expected_hash"),
        F.when(append, "ok").when((F.col("operation") == "undo") & F.col("target_id").isNull(), "NO_UNDO_VERSION")
        .when(F.col("stored").isNull(), "VERSION_NOT_FOUND").otherwise("ok").alias("status"),
        F.when(~append, F.col("version_number")).alias("target_number"))
