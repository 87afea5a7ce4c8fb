"""The trace log as a stream: redact, drop repeats, append, and keep session counters.

Repeats are told by arrival, so no row is refused for being old: what came long after the
rest of its time is in the log and in the counters like any other row, and ``late_rows``
lists it. Counters of sessions that fall quiet leave the state; a session that comes back
starts another run of counters, and the runs of a session are added up on reading.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gleanery.functions.redact import redact_text

COUNTS = "calls long, successful_calls long, total_duration_ms long, max_duration_ms long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def clean_log(spark: SparkSession, source: str, target: str, checkpoint: str, delay: str) -> None:
    """Append each trace once, with the time of its arrival. ``delay`` is how long after it a repeat may arrive."""
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)
    clean = (rows.withColumns({"metrics_json": redact_text(F.col("metrics_json")), "arrived_at": F.current_timestamp()})
             .withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["trace_id"]))
    (clean.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())


def late_rows(log: DataFrame, delay: str) -> DataFrame:
    """Rows older by more than ``delay`` than the newest row of all batches before their own."""
    batches = log.groupBy("arrived_at").agg(F.max("created_at").alias("newest"))
    # one row a batch
    before = F.max("newest").over(W.orderBy("arrived_at").rowsBetween(W.unboundedPreceding, -1))
    limits = batches.select("arrived_at", (before - F.expr(f"interval {delay}")).alias("limit"))
    return log.join(limits, "arrived_at").filter("created_at < limit").select(*log.columns)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of the rows at hand, so that a session with many rows reaches its state as a few."""
    for batch in batches:
        t = pa.table({"session_id": batch.column("session_id"), "calls": pa.array([1] * batch.num_rows, pa.int64()),
                      "ok": batch.column("ok"), "ms": batch.column("ms"), "most": batch.column("ms")})
        g = t.group_by("session_id").aggregate([("calls", "sum"), ("ok", "sum"), ("ms", "sum"), ("most", "max")])
        g = g.select(["session_id", "calls_sum", "ok_sum", "ms_sum", "most_max"]).rename_columns(["session_id", *_names()])
        yield from g.combine_chunks().to_batches()


def _names() -> list[str]:
    return [x.split()[0] for x in COUNTS.split(", ")]


class SessionCounters(StatefulProcessor):
    """Running counters of a session, forgotten once it was quiet for ``quiet_ms``."""

    def __init__(self, quiet_ms: int | None):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", f"since long, {COUNTS}", ttlDurationMs=self.quiet_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # the time of the batch, which a repeated batch has again
        since, calls, good, total, most = self.counters.get() or (timerValues.getCurrentProcessingTimeInMs(), 0, 0, 0, 0)
        for row in rows:
            calls, good, total = calls + row["calls"], good + row["successful_calls"], total + row["total_duration_ms"]
            most = max(most, row["max_duration_ms"])
        self.counters.update((since, calls, good, total, most))
        yield Row(session_id=key[0], since=since, **dict(zip(_names(), (calls, good, total, most))))

    def close(self) -> None:
        pass


@contextmanager
def _stateful(spark: SparkSession):
    """Settings that state with a time to live needs; a batch without data would follow another without end."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def session_counters(spark: SparkSession, source: str, target: str, checkpoint: str, quiet_seconds: int | None = None) -> None:
    """Running counters per session; each batch writes the sessions it changed under its number."""
    schema = spark.read.parquet(source).schema
    tools = spark.readStream.schema(schema).parquet(source).filter("event_type = 'tool_execution'")
    ms = F.greatest(F.lit(0), F.coalesce("duration_ms", F.lit(0))).cast("long")
    good = F.coalesce(F.col("result_status") == "success", F.lit(False)).cast("long")
    kind = schema["session_id"].dataType.simpleString()
    parts = tools.select("session_id", good.alias("ok"), ms.alias("ms")).mapInArrow(_partial_counts, f"session_id {kind}, {COUNTS}")
    counters = parts.groupBy("session_id").transformWithState(
        SessionCounters(quiet_seconds and quiet_seconds * 1000), f"session_id {kind}, since long, {COUNTS}", "Update", "ProcessingTime")

    def write(batch: DataFrame, number: int) -> None:
        # a repeated batch overwrites its own folder, so a retry changes nothing
        batch.write.mode("overwrite").parquet(f"{target}/batches/batch={number}")

    with _stateful(spark):
        (counters.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())


def _folders(spark: SparkSession, path: str) -> tuple[object, list[tuple[int, object]]]:
    """The file system of a path and its numbered folders."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.listStatus(root) if files.exists(root) else []
    return files, [(int(f.getPath().getName().split("=")[1]), f.getPath()) for f in found if "=" in f.getPath().getName()]


def _runs(spark: SparkSession, target: str) -> tuple[DataFrame, int]:
    """Last counters of every run of every session, and the number of the last batch."""
    base = max((n for n, _ in _folders(spark, f"{target}/bases")[1]), default=None)
    batches = [n for n, _ in _folders(spark, f"{target}/batches")[1]]
    paths = [f"{target}/batches/batch={n}" for n in batches if base is None or n > base]
    rows = spark.read.parquet(*paths, *([] if base is None else [f"{target}/bases/upto={base}"])).select("session_id", "since", *_names())
    # counters only grow while a run lasts
    last = rows.groupBy("session_id", "since").agg(*[F.max(c).alias(c) for c in _names()])
    return last, max([*batches, -1 if base is None else base])


def compact_counters(spark: SparkSession, target: str) -> None:
    """Put the batches so far into one table and delete them. Not while batches are being written.

    The new table counts once it is whole; what an interruption leaves behind is passed over
    by readers and deleted by the next call.
    """
    runs, number = _runs(spark, target)
    base = f"{target}/bases/upto={number}"
    files, bases = _folders(spark, f"{target}/bases")
    if number not in {n for n, _ in bases}:
        runs.write.mode("overwrite").parquet(f"{target}/making")
        files.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/bases"))
        files.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/making"), spark._jvm.org.apache.hadoop.fs.Path(base))
    for n, path in [*_folders(spark, f"{target}/batches")[1], *(x for x in bases if x[0] != number)]:
        if n <= number:
            files.delete(path, True)


def latest_counters(spark: SparkSession, target: str) -> DataFrame:
    """Counters of every session over all its runs."""
    runs, _ = _runs(spark, target)
    last = runs.groupBy("session_id").agg(F.sum("calls").alias("calls"), F.sum("successful_calls").alias("successful_calls"),
                                          F.sum("total_duration_ms").alias("total_duration_ms"), F.max("max_duration_ms").alias("max_duration_ms"))
    failed = F.col("calls") - F.col("successful_calls")
    return last.select(
        "session_id", "calls", "successful_calls", failed.alias("failed_calls"),
        F.round(F.col("successful_calls") / F.col("calls"), 6).alias("success_rate"),
        F.round(failed / F.col("calls"), 6).alias("error_rate"), "total_duration_ms",
        F.round(F.col("total_duration_ms") / F.col("calls"), 3).alias("average_duration_ms"), "max_duration_ms")
