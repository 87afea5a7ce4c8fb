"""Trace and evaluation summaries."""

from pyspark.sql import functions as F

from gleanery.operators import retrieval as rt
from gleanery.operators import traces as tr
from gleanery.operators.ranking import nearest_rank, top_n
from gleanery.operators.storage import settle
from gleanery.plans.registry import Catalog
from gleanery.plans.retrieval import WITH as SEARCH_WITH
from gleanery.plans.retrieval import inputs
from gleanery.sources.sinks import new_path
from gleanery.streaming import trace_stream

CATALOG = Catalog()
query = CATALOG.query

BASE = "select *, cast(regexp_extract(props, '[0-9]+', 0) as int) as k from {events}"
TRACES = f"""
select event_id as trace_id, user_id as session_id, user_id * 10 + k % 10 as task_id,
  case when event_type = 'purchase' then 'llm_call' when event_type = 'signup' then 'research_stage' else 'tool_execution' end as event_type,
  case when event_type = 'error' then 'failed' else 'success' end as result_status,
  case when event_type <> 'error' then null when k % 3 = 0 then 'WEB_SSRF_BLOCKED' when k % 3 = 1 then 'TIMEOUT' else 'TOOL_NOT_ALLOWED_FOR_SOURCE' end as error_code,
  case when k % 29 = 0 then null else cast(floor(value * 10) as bigint) end as duration_ms,
  cast(k * 10 as bigint) as input_tokens, cast(k as bigint) as output_tokens, cast(k * 11 as bigint) as total_tokens, k / 1000.0 as cost_usd,
  case event_type
    when 'click' then concat('{{"retrieval_mode": "hybrid", "fallback_used": ', case when k % 4 = 0 then 'true' else 'false' end, ', "result_count": ', cast(k % 5 as string),
       ', "top_score": 0.', lpad(cast(k as string), 3, '0'), ', "top_n_count": ', cast(k as string), ', "top_k_count": 5, "hybrid_retrieval_duration_ms": ', cast(k * 2 as string), ', "stage": "s', cast(k % 3 as string), '"}}')
    when 'view' then concat('{{"untrusted_content": true, "detected_untrusted_patterns": ', case when k % 2 = 0 then '["A", "B"]' else '[]' end, ', "source_strategy": "WEB", "visual_processing_duration_ms": ', cast(k as string),
       ', "page_count": ', cast(k % 4 as string), ', "image_count": 1, "region_count": ', cast(k % 7 as string), ', "ocr_success_count": ', cast(k % 3 as string), ', "ocr_failure_count": ', cast(k % 2 as string), ', "classification_status": "success", "stage": "v"}}')
    when 'purchase' then concat('{{"usage_available": true, "pricing_configured": ', case when k % 2 = 0 then 'true' else 'false' end, '}}')
    when 'signup' then concat('{{"retrieval_round": ', cast(k % 3 as string), ', "candidate_count": ', cast(k as string), ', "new_evidence_count": ', cast(k % 6 as string), ', "sufficiency_transition": "missing->partial", "stage": "r"',
       case when k % 5 = 0 then ', "stop_reason": "budget"' else '' end, '}}')
    else '{{}}' end as metrics_json, ts as created_at
from ({BASE}) b""".replace("{{", "{").replace("}}", "}")


def traces(t):
    return t.sql(TRACES)


W = f"with tr as ({TRACES}), b as ({BASE}) "
TOOL_COLS = """count(*) as calls, count(case when result_status = 'success' then 1 end) as successful_calls, count(case when result_status <> 'success' then 1 end) as failed_calls,
  round(count(case when result_status = 'success' then 1 end) / count(*), 6) as success_rate, round(count(case when result_status <> 'success' then 1 end) / count(*), 6) as error_rate,
  sum(coalesce(duration_ms, 0))::bigint as total_duration_ms, round(avg(coalesce(duration_ms, 0)), 3) as average_duration_ms, max(coalesce(duration_ms, 0)) as max_duration_ms"""


@query("tool_summary", W + f"select session_id, {TOOL_COLS}, quantile_disc(coalesce(duration_ms, 0), 0.95) as p95_duration_ms from tr where event_type = 'tool_execution' group by session_id")
def tool_summary(t):
    return tr.tool_summary(traces(t))


@query("retrieval_summary", W + """select user_id as session_id, count(*) as calls, count(case when k % 4 = 0 then 1 end) as fallback_calls, round(count(case when k % 4 = 0 then 1 end) / count(*), 6) as fallback_rate,
  count(case when k % 5 = 0 then 1 end) as empty_result_calls, round(avg(k % 5), 3) as average_result_count, round(avg(k / 1000.0), 6) as average_top_score, round(avg(k * 2), 3) as average_hybrid_duration_ms,
  null::double as average_rerank_duration_ms, round(avg(k), 3) as average_candidate_count, 5.0::double as average_top_k from b where event_type = 'click' group by user_id""")
def retrieval_summary(t):
    return tr.retrieval_summary(traces(t))


@query("token_cost_summary", W + """select user_id as session_id, count(*) as llm_calls, sum(k * 10)::bigint as input_tokens, sum(k)::bigint as output_tokens, sum(k * 11)::bigint as total_tokens, 'available' as token_availability,
  round(sum(k) / 1000.0, 10) as total_cost, bool_or(k % 2 = 0) as pricing_configured, case when bool_or(k % 2 = 0) then 'available' else 'unavailable' end as cost_availability from b where event_type = 'purchase' group by user_id""")
def token_cost_summary(t):
    return tr.token_cost_summary(traces(t))


@query("latency_summary", W + "select session_id, count(*) as sample_count, round(avg(duration_ms), 3) as average_duration_ms, max(duration_ms) as max_duration_ms, quantile_disc(duration_ms, 0.95) as p95_duration_ms from tr where duration_ms is not null group by session_id")
def latency_summary(t):
    return tr.latency_summary(traces(t))


@query("visual_summary", W + """select user_id as session_id, sum(k)::bigint as visual_processing_duration_ms, sum(k % 4)::bigint as page_count, count(*) as image_count, sum(k % 7)::bigint as region_count, sum(k % 3)::bigint as ocr_success_count,
  sum(k % 2)::bigint as ocr_failure_count, count(*) as classifications, 0 as extractions from b where event_type = 'view' group by user_id""")
def visual_summary(t):
    return tr.visual_summary(traces(t))


@query("agentic_summary", W + """select user_id as session_id, count(case when event_type = 'signup' then 1 end) as rounds, coalesce(sum(case when event_type = 'signup' then k end), 0)::bigint as candidate_count,
  coalesce(sum(case when event_type = 'signup' then k % 6 end), 0)::bigint as new_evidence_count, count(case when event_type = 'signup' then 1 end) as transitions, count(case when event_type = 'signup' and k % 5 = 0 then 1 end) as stops from b group by user_id""")
def agentic_summary(t):
    return tr.agentic_summary(traces(t))


@query("web_safety_summary", W + """select user_id as session_id, count(case when event_type = 'view' then 1 end) as calls, count(case when event_type = 'view' and k % 2 = 0 then 1 end) as injection_detected_calls,
  count(case when event_type = 'error' and k % 3 = 0 then 1 end) as ssrf_blocked_calls, count(case when event_type = 'error' and k % 3 = 2 then 1 end) as tool_boundary_blocks from b group by user_id""")
def web_safety_summary(t):
    return tr.web_safety_summary(traces(t))


@query("web_pattern_frequency", W + "select user_id as session_id, p.pattern, count(*) as count from b, (values ('A'), ('B')) p(pattern) where event_type = 'view' and k % 2 = 0 group by all")
def web_pattern_frequency(t):
    return tr.pattern_frequency(traces(t))


@query("metric_code_frequency", W + """select session_id, kind, code, count(*) as count from (
  select user_id as session_id, 'classification_status' as kind, 'success' as code from b where event_type = 'view' union all select user_id, 'source_strategy', 'WEB' from b where event_type = 'view'
  union all select user_id, 'sufficiency_transition', 'missing->partial' from b where event_type = 'signup' union all select user_id, 'stop_reason', 'budget' from b where event_type = 'signup' and k % 5 = 0) x group by all""")
def metric_code_frequency(t):
    return tr.metric_codes(traces(t))


@query("call_counts", W + """select user_id as session_id, count(case when event_type not in ('purchase', 'signup') then 1 end) as tool_calls, count(case when event_type = 'click' then 1 end) as retrieval_calls,
  count(case when event_type = 'view' then 1 end) as untrusted_calls, 0::bigint as ocr_call_count, 0::bigint as vision_call_count from b group by user_id""")
def call_counts(t):
    return tr.call_counts(traces(t))


@query("error_summary", W + "select session_id, error_code, count(*) as count from tr where error_code is not null group by all")
def error_summary(t):
    return tr.error_summary(traces(t))


@query("frequency_map", "select event_type, count(*) as count from {events} group by event_type")
def frequency_map(t):
    return tr.frequency(t.events, [], "event_type")


@query("nearest_rank_percentile", "select event_type, quantile_disc(floor(value)::bigint, 0.95) as p95 from {events} group by event_type")
def nearest_rank_percentile(t):
    return nearest_rank(t.events.withColumn("ms", F.floor("value")), ["event_type"], "ms", 0.95, "p95")


@query("average_optional", "select event_type, round(avg(case when k % 3 <> 0 then k end), 3) as average from (" + BASE + ") b group by event_type")
def average_optional(t):
    k = F.get_json_object("props", "$.k")
    return t.events.withColumn("v", F.when(k.cast("int") % 3 == 0, "n/a").otherwise(k)).groupBy("event_type").agg(
        tr.average_optional(F.col("v")).alias("average"))


@query("latest_metrics_per_stage", W + """, s as (select *, case event_type when 'research_stage' then 'r' else regexp_extract(metrics_json, '"stage": "([a-z0-9]+)"', 1) end as stage from tr where contains(metrics_json, '"stage"'))
select stage, count(*) as calls, sum(coalesce(duration_ms, 0))::bigint as total_duration_ms, round(avg(coalesce(duration_ms, 0)), 3) as average_duration_ms,
  quantile_disc(coalesce(duration_ms, 0), 0.95) as p95_duration_ms, arg_max(metrics_json, created_at) as latest_metrics from s group by stage""")
def latest_metrics_per_stage(t):
    return tr.stage_summary(traces(t))


TASKS = """select o_orderkey as task_id, o_custkey as session_id, case o_orderstatus when 'F' then 'failed' when 'P' then 'running' else 'success' end as task_status, o_orderdate as created_at,
  case when o_orderstatus = 'O' then timestamp_ntz'2002-01-01 00:00:00' end as completed_at from {orders}"""
STEPS = """select l_orderkey as task_id, l_partkey * 1000000 + l_suppkey as step_id, l_linenumber as seq, case when l_returnflag = 'R' then 'failed' when l_linestatus = 'F' then 'success' when l_returnflag = 'A' then 'running' else 'pending' end as status,
  l_linenumber % 3 as retry_count, case when l_quantity > 5 then l_shipdate end as started_at from {lineitem}"""
T_SQL = TASKS.replace("timestamp_ntz'", "timestamp '")


@query("workflow_summary", f"""with t as ({T_SQL}), s as ({STEPS}), g as (select task_id, count(*) as n, count(case when status = 'success' then 1 end) as ok, count(case when status = 'failed' then 1 end) as bad, sum(retry_count)::bigint as retries, min(started_at) as first from s group by 1)
select t.task_id, task_status, coalesce(n, 0) as total_steps, coalesce(ok, 0) as completed_steps, coalesce(bad, 0) as failed_steps, case when n > 0 then round(ok / n, 6) else 0 end as completion_rate, coalesce(retries, 0) as retry_count,
  greatest(0, epoch_ms(first) - epoch_ms(created_at)) + case when first is null then null else 0 end as queue_time_ms, case when first is not null and completed_at is not null then greatest(0, epoch_ms(completed_at) - epoch_ms(first)) end as execution_time_ms,
  case when completed_at is not null then greatest(0, epoch_ms(completed_at) - epoch_ms(created_at)) end as total_duration_ms from t left join g using (task_id)""")
def workflow_summary(t):
    return tr.workflow_summary(t.sql(TASKS), t.sql(STEPS))


@query("case_rates", "select count(*) as total_cases, sum(quality)::bigint as successful_cases, (count(*) - sum(quality))::bigint as failed_cases, round(sum(quality) / count(*), 6) as success_rate, round((count(*) - sum(quality)) / count(*), 6) as error_rate, count(*) = count(distinct doc_id) as valid from {labels}")
def case_rates(t):
    return tr.case_rates(t.labels.select(F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("passed")))


@query("trace_metrics_extract", SEARCH_WITH + """, kc as (select query_id, count(*) as n from kw group by 1), vc as (select query_id, count(*) as n from vec group by 1), cc as (select query_id, count(*) as n from cand group by 1),
fc as (select query_id, count(*) as n, round(max(score), 6) as top, string_agg(chunk_id, ',' order by final_position) as ids from final group by 1)
select 'q' || q.query_id as result_id, 'retrieve_document' as tool_name, 'hybrid' as retrieval_mode, coalesce(vc.n, 0) = 0 as fallback_used, case when coalesce(vc.n, 0) = 0 then 'NO_VECTOR_HITS' end as fallback_reason, false as rerank_fallback,
  case when fc.n > 0 then 'found' else 'not_found' end as retrieval_status, coalesce(fc.n, 0) as result_count, coalesce(kc.n, 0) as keyword_candidate_count, coalesce(vc.n, 0) as vector_candidate_count, coalesce(cc.n, 0) as top_n_count,
  coalesce(fc.n, 0) as top_k_count, 12 as hybrid_retrieval_duration_ms, null::bigint as rerank_duration_ms, coalesce(fc.ids, '') as evidence_ids, fc.top as top_score,
  null as search_query, null as url, null as fetch_status, null::bigint as latency_ms, null::bigint as evidence_count, null::boolean as untrusted_content, null as detected_untrusted_patterns, null as evidence_source_types, null as source_strategy
  from queries q left join kc using (query_id) left join vc using (query_id) left join cc using (query_id) left join fc using (query_id)
union all
select 'w' || page_id, 'retrieve_web', 'page', null, null, null, case when page_id % 4 <> 0 then 'found' end, 2, null, null, null, null, null, null, 'e' || page_id, null,
  'find ' || page_id, url, case when page_id % 4 <> 0 then 'found' else 'success' end, case when page_id % 7 = 0 then page_id when page_id % 2 = 0 then 0 else page_id + 1 end, 2, true,
  case when page_id % 2 = 0 then 'A,B' else 'C' end, case when page_id % 5 = 0 then 'URL,WEB' else 'WEB' end, case when page_id % 3 = 0 then 'DIRECT_URL' else 'WEB' end from {pages}""".replace("{pages}", "pages"))
def trace_metrics_extract(t):
    """Results of the hybrid search, with the sizes of its lists, and of one web lookup per page."""
    chunks, queries = inputs(t)
    n = rt.candidate_limit(5)
    keyword, vector = settle(rt.keyword_retrieve(chunks, queries, n)), settle(rt.vector_retrieve(chunks, queries, n))
    candidates = settle(rt.hybrid_order(rt.fuse(keyword, vector), n))
    best = top_n(rt.scored(candidates, chunks, queries), ["query_id"], [F.col("score").desc(), F.col("chunk_id")], 5, "at")
    evidence = best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "chunk_id", "score"))),
                                                        lambda x: F.struct(x["chunk_id"].alias("evidence_id"), x["score"].alias("score"))).alias("evidence"))
    sizes = [(keyword, "keyword_candidate_count"), (vector, "vector_candidate_count"), (candidates, "top_n_count")]
    rows = queries.select("query_id").join(evidence, "query_id", "left")
    for df, name in sizes:
        rows = rows.join(df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name)), "query_id", "left")
    lone = F.coalesce("vector_candidate_count", F.lit(0)) == 0
    data = F.struct(F.lit("hybrid").alias("retrieval_mode"), F.when(F.size("evidence") > 0, "found").otherwise("not_found").alias("status"), "evidence",
                    *[name for _, name in sizes], lone.alias("fallback_used"), F.when(lone, "NO_VECTOR_HITS").alias("fallback_reason"),
                    F.lit(12.9).alias("hybrid_retrieval_duration_ms"))
    found = rows.select(F.concat(F.lit("q"), "query_id").alias("result_id"), F.lit("retrieve_document").alias("tool_name"), data.alias("data"))
    p, none = F.col("page_id"), F.lit(None).cast("string")
    item = lambda i, kind, own, other: F.struct(i.alias("evidence_id"), kind.alias("source_type"), own.alias("detected_untrusted_patterns"), F.struct(other.alias("risk_patterns")).alias("metadata"))
    listed = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    chain = F.array(item(F.concat(F.lit("e"), p), F.lit("WEB"), F.when(p % 2 == 0, listed("B", "A")).otherwise(listed()), listed("C")),
                    item(F.lit(""), F.when(p % 5 == 0, "URL"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")))
    page = F.struct(F.lit("page").alias("mode"), F.when(p % 4 != 0, "found").alias("status"), none.alias("query"), F.when(p % 3 != 0, F.col("url")).alias("url"),
                    F.when(p % 7 == 0, None).when(p % 2 == 0, -5.7).otherwise(p + 1.9).alias("latency_ms"), chain.alias("evidence_chain"))
    call = F.struct(F.concat(F.lit("find "), p).alias("query"), F.when(p % 3 == 0, F.col("url")).alias("url"))
    web = t.pages.select(F.concat(F.lit("w"), p).alias("result_id"), F.lit("retrieve_web").alias("tool_name"), page.alias("data"), call.alias("arguments"),
                         F.lit("success").alias("result_status"), p.alias("duration_ms"))
    both = tr.document_metrics(found, ["result_id"]).unionByName(tr.web_metrics(web, ["result_id"]), allowMissingColumns=True)
    return both.withColumn("top_score", F.round("top_score", 6)).withColumns(
        {c: F.array_join(c, ",") for c in ("evidence_ids", "detected_untrusted_patterns", "evidence_source_types")})


@query("stage_timeline", W + f""", t as (select user_id * 10 + k % 10 as task_id, min(ts) as created_at, case when bool_or(event_type = 'error') then 'FAILED' else 'COMPLETED' end as status from b group by 1)
select task_id, 0 as part, 'CREATED' as label, created_at as at from t union all select task_id, 1, 'r', created_at from tr where event_type = 'research_stage' union all select task_id, 2, 'current ' || status, null from t""")
def stage_timeline(t):
    rows = traces(t)
    tasks = rows.groupBy("task_id").agg(F.min("created_at").alias("created_at"), F.bool_or(F.col("result_status") == "failed").alias("bad")).select(
        "task_id", "created_at", F.when(F.col("bad"), "FAILED").otherwise("COMPLETED").alias("status"))
    return tr.stage_timeline(tasks, rows)


@query("trace_stream_rollup", W + f"select session_id, {TOOL_COLS} from tr where event_type = 'tool_execution' group by session_id")
def trace_stream_rollup(t):
    spark, root = t.spark, new_path(t.spark, "stream")
    rows = traces(t).withColumn("created_at", F.col("created_at").cast("timestamp"))
    repeats = rows.filter("trace_id % 7 = 0")
    rows.unionByName(repeats).write.parquet(f"{root}/in")
    trace_stream.clean_log(spark, f"{root}/in", f"{root}/log", f"{root}/cp1", "400 days")
    trace_stream.session_counters(spark, f"{root}/log", f"{root}/counters", f"{root}/cp2")
    return trace_stream.latest_counters(spark, f"{root}/counters")
