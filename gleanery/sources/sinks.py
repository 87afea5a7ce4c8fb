"""Writing tables so that a failed candidate leaves the old rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.ids import json_text
from gleanery.functions.redact import redact_text
from gleanery.operators.chunks import check_candidate
from gleanery.operators.ranking import first_per_key
from gleanery.operators.storage import checkpoint_dir, settle

BUCKETS = 16


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which the cluster shares."""
    return f"{checkpoint_dir(spark).rstrip('/')}/gleanery-{name}-{uuid.uuid4().hex}"


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("file_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def write_files(df: DataFrame, path: str, key: str = "file_id", buckets: int = BUCKETS) -> None:
    """A table laid out by a hash of the file, so files of any number stay few folders."""
    _bucketed(df, key, buckets).write.mode("overwrite").partitionBy("file_bucket").parquet(path)


def replace_files(new: DataFrame, path: str, key: str = "file_id", buckets: int = BUCKETS) -> None:
    """Replace all rows of the files in ``new``; other files keep theirs.

    Only the folders that hold such files are rewritten, by dynamic overwrite.
    """
    spark = new.sparkSession
    fresh = _bucketed(new, key, buckets)
    old = spark.read.parquet(path)
    touched = fresh.select("file_bucket").distinct()
    kept = old.join(touched, "file_bucket", "left_semi").join(new.select(key).distinct(), key, "left_anti")
    # the result is fixed before its own folders are overwritten
    merged = settle(kept.unionByName(fresh.select(*kept.columns)))
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("file_bucket").parquet(path))


def replace_generation(candidate: DataFrame, path: str, files: DataFrame) -> DataFrame:
    """Replace the chunks of files whose candidate is valid and that are being indexed.

    Returns the verdict per file; a failed candidate leaves the old chunks.
    """
    verdicts = settle(check_candidate(candidate).join(files, "file_id", "left").select(
        "file_id", "chunk_count", F.when(F.col("status").isin("INDEXING", "REINDEXING"), F.col("verdict"))
        .otherwise("FILE_NOT_INDEXING").alias("verdict")))
    replace_files(candidate.join(verdicts.filter("verdict = 'ok'"), "file_id", "left_semi"), path)
    return verdicts


def upsert(old: DataFrame, new: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key: the newest of ``new``, else the old row."""
    latest = first_per_key(new, [key], F.col(position), last=True)
    return latest.unionByName(old.join(latest.select(key), key, "left_anti"))


def swap_in(df: DataFrame, name: str) -> str:
    """Write a whole new version of a table beside the old one and return its path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def trace_rows(traces: DataFrame) -> DataFrame:
    """Trace rows with redacted JSON columns, whole so that they parse, and their date."""
    return traces.withColumns({
        c: redact_text(F.col(c)) for c in ("arguments_json", "metrics_json") if c in traces.columns
    }).withColumn("trace_date", F.date_format("created_at", "yyyy-MM-dd"))


def append_traces(traces: DataFrame, path: str) -> None:
    trace_rows(traces).write.mode("append").partitionBy("trace_date").parquet(path)


def report_lines(parts: DataFrame) -> DataFrame:
    """Report text per id from (report_id, section, seq, line), in fixed order.

    A report is one small text file; the list is bounded by the report itself.
    """
    ordered = F.array_sort(F.collect_list(F.struct("section", "seq", "line")))
    return parts.groupBy("report_id").agg(ordered.alias("l")).select(
        "report_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("report"))


def literal(col: Column) -> Column:
    """Source text without HTML or Markdown authority; a missing value reads None."""
    text = F.coalesce(col.cast("string"), F.lit("None"))
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(escaped, r"([\\`*_{}\[\]()#+!|])", r"\\$1")


# Headings and labels of a report, and the keys of a place in a document.
REPORT_ID, TASK_ID, CREATED = "报告 ID：", "研究任务：", "生成时间："
TASK, SUMMARY, PROCESS, CONCLUSIONS, SOURCES, LIMITS = "任务说明", "摘要", "分析过程", "核心结论", "Evidence 来源", "限制说明"
EVIDENCE, NOT_LINKED, UNNAMED = "  Evidence：", "未建立证据关联", "未标识"
KIND, LOCAL_KIND, WEB_KIND, SOURCE, PLACE, RETRIEVED = "来源类型：", "本地文档", "Web 来源", "来源：", "定位：", "检索时间："
QUALITY, NO_WARNING = "Evidence Quality：", "- 规则检查未发现警告；不代表事实正确性保证。"
PLACE_KEYS, NOTED_KEYS = ("page_no", "line_number", "chunk_id", "block_id", "sheet", "cell", "json_path"), ("heading_path", "line_number", "line_end")


def _json_value(value: Column, kind: str) -> Column:
    if kind.startswith("array"):
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda v: json_text(v)), ", "), F.lit("]"))
    return json_text(value) if kind == "string" else value.cast("string")


def place_json(evidence: DataFrame) -> Column:
    """Where a local piece of evidence stands, as JSON: its own keys, then those of its ``metadata`` struct, which win."""
    kinds = dict(evidence.dtypes)
    noted = {f.name: f.dataType.simpleString() for f in evidence.schema["metadata"].dataType.fields} if "metadata" in kinds else {}
    own = {k: F.col(k) for k in PLACE_KEYS if k in kinds}
    later = {k: F.col("metadata")[k] for k in NOTED_KEYS if k in noted}
    parts = []
    for key, value in own.items():
        text = _json_value(value, kinds[key])
        if key in later:
            text = F.coalesce(_json_value(later[key], noted[key]), text)
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f'"{key}": '), text)))
    for key, value in later.items():
        here = value.isNotNull() & (own[key].isNull() if key in own else F.lit(True))
        parts.append(F.when(here, F.concat(F.lit(f'"{key}": '), _json_value(value, noted[key]))))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def render_reports(reports: DataFrame, conclusions: DataFrame, evidence: DataFrame, warnings: DataFrame) -> DataFrame:
    """(report_id, report): whole reports in Markdown, their sections in fixed order.

    reports: report_id, task_id, title, created_at, task_description, summary, process, limits,
    quality_status. conclusions: report_id, position, text, evidence_refs (array). evidence:
    report_id, position, evidence_id, source_type, file_name, url, retrieved_at, keys of its
    place, metadata (struct). warnings: report_id, position, code, message. A conclusion
    without evidence and a report without warnings say so; source text has no markup.
    """
    def lines(df: DataFrame, section: int, seq: Column, *parts: Column) -> DataFrame:
        return df.select("report_id", F.lit(section).alias("section"), seq.cast("bigint").alias("seq"), F.concat_ws("\n", *parts).alias("line"))

    none, at = F.lit(""), F.col("position")
    label = lambda text, value: F.concat(F.lit(text), F.coalesce(value.cast("string"), F.lit("None")))
    head = [label("# ", F.replace(literal(F.col("title")), F.lit("\n"), F.lit(" "))), none, label(REPORT_ID, F.col("report_id").cast("string")),
            label(TASK_ID, F.col("task_id").cast("string")), label(CREATED, F.col("created_at").cast("string")), none,
            F.lit(f"## {TASK}"), none, literal(F.col("task_description")), none, F.lit(f"## {SUMMARY}"), none, literal(F.col("summary")), none,
            F.lit(f"## {PROCESS}"), none, F.col("process"), none, F.lit(f"## {CONCLUSIONS}"), none]
    named = F.transform("evidence_refs", lambda r: literal(r))
    refs = F.when(F.size("evidence_refs") > 0, F.array_join(named, ", ")).otherwise(NOT_LINKED)
    local = F.coalesce(F.col("source_type") == "LOCAL", F.lit(False))
    where = F.when(local, label(PLACE, literal(place_json(evidence)))).otherwise(label(RETRIEVED, literal(F.col("retrieved_at"))))
    rows = [lines(reports, 1, F.lit(0), *head),
            lines(conclusions, 2, at, label("- ", literal(F.col("text"))), label(EVIDENCE, refs), none),
            lines(reports, 3, F.lit(0), F.lit(f"## {SOURCES}"), none),
            lines(evidence, 4, at, label("### ", literal(F.coalesce("evidence_id", F.lit(UNNAMED)))), label(KIND, F.when(local, LOCAL_KIND).otherwise(WEB_KIND)),
                  label(SOURCE, literal(F.when(local, F.col("file_name")).otherwise(F.col("url")))), where, none),
            lines(reports, 5, F.lit(0), F.lit(f"## {LIMITS}"), none, F.col("limits"), none, label(QUALITY, F.col("quality_status"))),
            lines(warnings, 6, at, F.concat(F.lit("- "), literal(F.col("code")), F.lit("："), literal(F.col("message"))))]
    silent = reports.join(warnings.select("report_id").distinct(), "report_id", "left_anti")
    rows.append(lines(silent, 6, F.lit(0), F.lit(NO_WARNING)))
    return report_lines(reduce(DataFrame.unionByName, rows)).withColumn("report", F.concat("report", F.lit("\n")))


def append_versions(versions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows to append for before/after snapshots (file_id, before_hash, after_hash).

    An identical, available latest version is reused as the parent; numbers run on.
    """
    latest = versions.groupBy("file_id").agg(
        F.max_by(F.struct("version_id", "version_number", "content_hash", "status"), F.col("version_number")).alias("l"))
    joined = snapshots.join(latest, "file_id", "left")
    reused = F.coalesce((F.col("l.content_hash") == F.col("before_hash")) & (F.col("l.status") == "available"), F.lit(False))
    last = F.coalesce("l.version_number", F.lit(0)).cast("bigint")

    def row(number, parent, hash_):
        return F.struct(number.alias("version_number"), parent.alias("parent_version_id"), hash_.alias("content_hash"),
                        F.concat_ws(":", "file_id", number.cast("string")).alias("version_id"))

    before = row(last + 1, F.col("l.version_id"), F.col("before_hash"))
    after_new = row(last + 2, F.concat_ws(":", "file_id", (last + 1).cast("string")), F.col("after_hash"))
    after_reused = row(last + 1, F.col("l.version_id"), F.col("after_hash"))
    rows = F.when(reused, F.array(after_reused)).otherwise(F.array(before, after_new))
    return joined.select("file_id", F.explode(rows).alias("r")).select("file_id", "r.*", F.lit("available").alias("status"))
