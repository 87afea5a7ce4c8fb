"""Summaries of trace logs per session.

Traces: trace_id, session_id, event_type, result_status, error_code, duration_ms,
input_tokens, output_tokens, total_tokens, cost_usd, metrics_json, created_at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.operators.ranking import nearest_rank

METRICS = """retrieval_mode string, fallback_used boolean, result_count bigint, top_score double, top_n_count double,
top_k_count double, hybrid_retrieval_duration_ms double, rerank_duration_ms double, stage string, untrusted_content boolean,
retrieval_source string, detected_untrusted_patterns array<string>, source_strategy string,
visual_processing_duration_ms bigint, page_count bigint, image_count bigint, region_count bigint, ocr_success_count bigint,
ocr_failure_count bigint, classification_status string, kie_status string, usage_available boolean,
pricing_configured boolean, retrieval_round bigint, candidate_count bigint, new_evidence_count bigint,
sufficiency_transition string, stop_reason string, ocr_call_count bigint, vision_call_count bigint"""


def with_metrics(traces: DataFrame) -> DataFrame:
    return traces.withColumn("m", F.from_json("metrics_json", METRICS))


def _ms() -> Column:
    return F.greatest(F.lit(0), F.coalesce("duration_ms", F.lit(0)))


def _share(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))


def tool_counters(traces: DataFrame) -> DataFrame:
    """The counters that also run on a stream."""
    good = F.count_if(F.col("result_status") == "success")
    n = F.count(F.lit(1))
    return traces.filter("event_type = 'tool_execution'").groupBy("session_id").agg(
        n.alias("calls"), good.alias("successful_calls"), (n - good).alias("failed_calls"),
        _share(good, n).alias("success_rate"), _share(n - good, n).alias("error_rate"),
        F.sum(_ms()).alias("total_duration_ms"), F.round(F.avg(_ms()), 3).alias("average_duration_ms"),
        F.max(_ms()).alias("max_duration_ms"))


def tool_summary(traces: DataFrame) -> DataFrame:
    tools = traces.filter("event_type = 'tool_execution'").withColumn("ms", _ms())
    return tool_counters(traces).join(nearest_rank(tools, ["session_id"], "ms", 0.95, "p95_duration_ms"), "session_id", "left")


def average_optional(value: Column) -> Column:
    """Mean over numbers only; null when there is none."""
    return F.round(F.avg(value.try_cast("double")), 3)


def retrieval_summary(traces: DataFrame) -> DataFrame:
    rows = with_metrics(traces).filter(F.coalesce("m.retrieval_mode", F.lit("")) != "")
    fallback = F.count_if("m.fallback_used")
    found = F.greatest(F.lit(0), F.coalesce("m.result_count", F.lit(0)))
    n = F.count(F.lit(1))
    return rows.groupBy("session_id").agg(
        n.alias("calls"), fallback.alias("fallback_calls"), _share(fallback, n).alias("fallback_rate"),
        F.count_if(found == 0).alias("empty_result_calls"), F.round(F.avg(found), 3).alias("average_result_count"),
        F.round(F.avg("m.top_score"), 6).alias("average_top_score"),
        average_optional(F.col("m.hybrid_retrieval_duration_ms")).alias("average_hybrid_duration_ms"),
        average_optional(F.col("m.rerank_duration_ms")).alias("average_rerank_duration_ms"),
        average_optional(F.col("m.top_n_count")).alias("average_candidate_count"),
        average_optional(F.col("m.top_k_count")).alias("average_top_k"))


def token_cost_summary(traces: DataFrame) -> DataFrame:
    calls = with_metrics(traces).filter("event_type = 'llm_call'")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    usage = F.coalesce(F.bool_or("m.usage_available"), F.lit(False))
    pricing = F.coalesce(F.bool_or("m.pricing_configured"), F.lit(False))
    return calls.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("llm_calls"), total("input_tokens"), total("output_tokens"), total("total_tokens"),
        F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 10).alias("total_cost"), usage.alias("usage"),
        pricing.alias("pricing_configured")).select(
        "session_id", "llm_calls", "input_tokens", "output_tokens", "total_tokens",
        F.when(F.col("usage"), "available").otherwise("unavailable").alias("token_availability"), "total_cost", "pricing_configured",
        F.when(F.col("usage") & F.col("pricing_configured"), "available").otherwise("unavailable").alias("cost_availability"))


def latency_summary(traces: DataFrame) -> DataFrame:
    rows = traces.filter(F.col("duration_ms").isNotNull()).withColumn("ms", _ms())
    return rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("sample_count"), F.round(F.avg("ms"), 3).alias("average_duration_ms"),
        F.max("ms").alias("max_duration_ms")).join(nearest_rank(rows, ["session_id"], "ms", 0.95, "p95_duration_ms"), "session_id")


def visual_summary(traces: DataFrame) -> DataFrame:
    rows = with_metrics(traces).filter(F.coalesce(
        F.col("m.visual_processing_duration_ms").cast("string"), F.col("m.classification_status"), F.col("m.kie_status")).isNotNull())
    total = lambda c: F.sum(F.coalesce(F.col("m." + c), F.lit(0))).alias(c)
    return rows.groupBy("session_id").agg(
        total("visual_processing_duration_ms"), total("page_count"), total("image_count"), total("region_count"),
        total("ocr_success_count"), total("ocr_failure_count"),
        F.count("m.classification_status").alias("classifications"), F.count("m.kie_status").alias("extractions"))


def agentic_summary(traces: DataFrame) -> DataFrame:
    rows = with_metrics(traces)
    is_round = F.col("m.retrieval_round").isNotNull()
    return rows.groupBy("session_id").agg(
        F.count_if(is_round).alias("rounds"),
        F.coalesce(F.sum(F.when(is_round, F.col("m.candidate_count"))), F.lit(0)).alias("candidate_count"),
        F.coalesce(F.sum(F.when(is_round, F.col("m.new_evidence_count"))), F.lit(0)).alias("new_evidence_count"),
        F.count(F.when(is_round, F.col("m.sufficiency_transition"))).alias("transitions"),
        F.count(F.nullif(F.col("m.stop_reason"), F.lit(""))).alias("stops"))


def web_safety_summary(traces: DataFrame) -> DataFrame:
    rows = with_metrics(traces)
    web = F.coalesce(F.col("m.untrusted_content"), F.lit(False)) | F.coalesce(F.col("m.retrieval_source").isin("WEB", "URL"), F.lit(False))
    return rows.groupBy("session_id").agg(
        F.count_if(web).alias("calls"),
        F.count_if(web & (F.coalesce(F.size("m.detected_untrusted_patterns"), F.lit(0)) > 0)).alias("injection_detected_calls"),
        F.count_if(F.col("error_code") == "WEB_SSRF_BLOCKED").alias("ssrf_blocked_calls"),
        F.count_if(F.col("error_code") == "TOOL_NOT_ALLOWED_FOR_SOURCE").alias("tool_boundary_blocks"))


def metric_codes(traces: DataFrame) -> DataFrame:
    """(session_id, kind, code, count): how often each status, transition, stop reason and source strategy stands in the metrics."""
    rows = with_metrics(traces)
    shown = {"classification_status": None, "kie_status": None, "sufficiency_transition": F.col("m.retrieval_round").isNotNull(),
             "stop_reason": None, "source_strategy": None}
    codes = F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(f"m.{k}") if test is None else F.when(test, F.col(f"m.{k}"))).alias("code"))
                      for k, test in shown.items()])
    return (rows.select("session_id", F.explode(codes).alias("c")).filter("c.code <> ''")
            .groupBy("session_id", "c.kind", "c.code").agg(F.count(F.lit(1)).alias("count")))


def call_counts(traces: DataFrame) -> DataFrame:
    """Calls by kind of each session: all tool calls, searches, web calls, recognitions and vision calls."""
    rows = with_metrics(traces)
    total = lambda c: F.sum(F.coalesce(F.col("m." + c), F.lit(0))).alias(c)
    return rows.groupBy("session_id").agg(
        F.count_if(F.col("event_type") == "tool_execution").alias("tool_calls"),
        F.count_if(F.coalesce("m.retrieval_mode", F.lit("")) != "").alias("retrieval_calls"),
        F.count_if(F.coalesce("m.untrusted_content", F.lit(False))).alias("untrusted_calls"),
        total("ocr_call_count"), total("vision_call_count"))


def pattern_frequency(traces: DataFrame) -> DataFrame:
    """(session_id, pattern, count) over untrusted content."""
    rows = with_metrics(traces).filter("m.untrusted_content")
    return frequency(rows.select("session_id", F.explode("m.detected_untrusted_patterns").alias("pattern")), ["session_id"], "pattern")


def frequency(rows: DataFrame, groups: list[str], code: str) -> DataFrame:
    return rows.filter(F.col(code).isNotNull()).groupBy(*groups, code).agg(F.count(F.lit(1)).alias("count"))


def error_summary(traces: DataFrame) -> DataFrame:
    """(session_id, error_code, count); sums of the counts give the error count."""
    return frequency(traces.filter("error_code <> ''"), ["session_id"], "error_code")


def stage_summary(traces: DataFrame) -> DataFrame:
    """Per stage: calls, durations, p95, and the metrics of its last trace."""
    rows = with_metrics(traces).filter(F.coalesce("m.stage", F.lit("")) != "").select(
        F.col("m.stage").alias("stage"), _ms().alias("ms"), "metrics_json", "created_at", "trace_id")
    base = rows.groupBy("stage").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("ms").alias("total_duration_ms"), F.round(F.avg("ms"), 3).alias("average_duration_ms"),
        F.max_by("metrics_json", F.struct("created_at", "trace_id")).alias("latest_metrics"))
    return base.join(nearest_rank(rows, ["stage"], "ms", 0.95, "p95_duration_ms"), "stage")


def workflow_summary(tasks: DataFrame, steps: DataFrame) -> DataFrame:
    from gleanery.functions.text import duration_ms
    per_task = steps.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("total_steps"), F.count_if(F.col("status") == "success").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.sum(F.coalesce("retry_count", F.lit(0))).alias("retry_count"),
        F.min("started_at").alias("first_started"))
    j = tasks.join(per_task, "task_id", "left")
    n = F.coalesce("total_steps", F.lit(0))
    return j.select(
        "task_id", "task_status", n.alias("total_steps"), F.coalesce("completed", F.lit(0)).alias("completed_steps"),
        F.coalesce("failed", F.lit(0)).alias("failed_steps"), _share(F.coalesce("completed", F.lit(0)), n).alias("completion_rate"),
        F.coalesce("retry_count", F.lit(0)).alias("retry_count"), duration_ms(F.col("created_at"), F.col("first_started")).alias("queue_time_ms"),
        duration_ms(F.col("first_started"), F.col("completed_at")).alias("execution_time_ms"),
        duration_ms(F.col("created_at"), F.col("completed_at")).alias("total_duration_ms"))


def case_rates(cases: DataFrame) -> DataFrame:
    """Pass and fail rates; ``valid`` is false when case ids are blank or repeat."""
    per_id = cases.groupBy(F.trim(F.col("case_id").cast("string")).alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("passed", F.lit(False))).alias("p"))
    total, good = F.sum("n"), F.sum("p")
    return per_id.agg(
        total.alias("total_cases"), good.alias("successful_cases"), (total - good).alias("failed_cases"),
        F.round(good / total, 6).alias("success_rate"), F.round((total - good) / total, 6).alias("error_rate"),
        (F.coalesce(F.max("n") == 1, F.lit(False)) & F.bool_and(F.coalesce(F.col("id") != "", F.lit(False)))).alias("valid"))


def _member(value: Column, kind: T.DataType | None, name: str, cast: str) -> Column:
    """A field of a struct, null where results of this kind have none."""
    has = isinstance(kind, T.StructType) and name in kind.names
    return value[name].cast(cast) if has else F.lit(None).cast(cast)


def _whole_ms(value: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(0), value.cast("double").cast("bigint")))


def _items(results: DataFrame, name: str) -> tuple[Column, T.DataType | None]:
    """The evidence list of a result, never null, and the type of its items."""
    data = results.schema["data"].dataType
    if name not in data.names:
        return F.array(), None
    kind = data[name].dataType
    return F.coalesce(F.col("data")[name], F.array().cast(kind)), kind.elementType


def _texts(items: Column, kind: T.DataType | None, name: str) -> Column:
    values = F.transform(items, lambda x: _member(x, kind, name, "string"))
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def document_metrics(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics row of each ``retrieve_document`` result (keys, tool_name, data): modes, fallbacks, counts, times, ids, top score."""
    rows, kind = results.filter("tool_name = 'retrieve_document'"), results.schema["data"].dataType
    of = lambda name, cast: _member(F.col("data"), kind, name, cast)
    items, item = _items(results, "evidence")
    count = lambda name: F.coalesce(of(name, "bigint"), F.lit(0).cast("bigint"))
    flag = lambda name: F.coalesce(of(name, "boolean"), F.lit(False))
    size = F.size(items).cast("bigint")
    top_k = count("top_k_count")
    return rows.select(
        *keys, "tool_name", of("retrieval_mode", "string").alias("retrieval_mode"), flag("fallback_used").alias("fallback_used"),
        of("fallback_reason", "string").alias("fallback_reason"), flag("rerank_fallback").alias("rerank_fallback"), of("status", "string").alias("retrieval_status"),
        size.alias("result_count"), *[count(c).alias(c) for c in ("keyword_candidate_count", "vector_candidate_count", "top_n_count")],
        F.when(top_k == 0, size).otherwise(top_k).alias("top_k_count"),
        *[_whole_ms(of(c, "double")).alias(c) for c in ("hybrid_retrieval_duration_ms", "rerank_duration_ms")],
        _texts(items, item, "evidence_id").alias("evidence_ids"), F.array_max(F.transform(items, lambda x: _member(x, item, "score", "double"))).alias("top_score"))


def web_metrics(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics row of each ``retrieve_web`` result (keys, tool_name, data, arguments, result_status, duration_ms).

    What the result does not say is completed from the call: query, URL, status and time. An
    item's own patterns count, or where it has none those of its metadata.
    """
    rows, kind = results.filter("tool_name = 'retrieve_web'"), results.schema["data"].dataType
    asked = results.schema["arguments"].dataType if "arguments" in results.columns else None
    of = lambda name, cast: _member(F.col("data"), kind, name, cast)
    arg = lambda name: _member(F.col("arguments"), asked, name, "string") if asked else F.lit(None).cast("string")
    items, item = _items(results, "evidence_chain")
    noted = item["metadata"].dataType if isinstance(item, T.StructType) and "metadata" in item.names else None

    def patterns(x: Column) -> Column:
        own = _member(x, item, "detected_untrusted_patterns", "array<string>")
        other = _member(x["metadata"], noted, "risk_patterns", "array<string>") if noted else F.lit(None).cast("array<string>")
        return F.coalesce(F.when(F.size(own) > 0, own), other, F.array().cast("array<string>"))

    size = F.size(items).cast("bigint")
    empty = F.array().cast("array<array<string>>")
    return rows.select(
        *keys, "tool_name", of("mode", "string").alias("retrieval_mode"), of("status", "string").alias("retrieval_status"), size.alias("result_count"),
        F.coalesce(of("query", "string"), arg("query")).alias("search_query"), F.coalesce(of("url", "string"), arg("url")).alias("url"),
        F.coalesce(of("status", "string"), F.col("result_status")).alias("fetch_status"),
        F.coalesce(_whole_ms(of("latency_ms", "double")), _whole_ms(F.col("duration_ms"))).alias("latency_ms"),
        size.alias("evidence_count"), F.lit(True).alias("untrusted_content"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(items, patterns) if item is not None else empty))).alias("detected_untrusted_patterns"),
        _texts(items, item, "evidence_id").alias("evidence_ids"), F.array_sort(F.array_distinct(_texts(items, item, "source_type"))).alias("evidence_source_types"),
        F.when(F.coalesce(arg("url"), F.lit("")) != "", "DIRECT_URL").otherwise("WEB").alias("source_strategy"))


def result_metrics(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics rows of retrieval results of both kinds; other tools have none."""
    return document_metrics(results, keys).unionByName(web_metrics(results, keys), allowMissingColumns=True)


def stage_timeline(tasks: DataFrame, traces: DataFrame) -> DataFrame:
    """Created row, stage events in time order, and the current state of each task."""
    created = tasks.select("task_id", F.lit(0).alias("part"), F.lit("CREATED").alias("label"), F.col("created_at").alias("at"))
    stages = with_metrics(traces).filter((F.col("event_type") == "research_stage") & F.col("m.stage").isNotNull()).select(
        "task_id", F.lit(1).alias("part"), F.col("m.stage").alias("label"), F.col("created_at").alias("at"))
    now = tasks.select("task_id", F.lit(2).alias("part"), F.concat(F.lit("current "), "status").alias("label"), F.lit(None).cast("timestamp_ntz").alias("at"))
    return created.unionByName(stages).unionByName(now).orderBy("task_id", "part", "at")
