"""Ledgers of tasks, batches, collections, versions and files."""

from pyspark.sql import functions as F

from gleanery.operators import batches as bt
from gleanery.operators import ledgers as lg
from gleanery.plans.registry import Catalog

CATALOG = Catalog()
query = CATALOG.query

STEPS = """select l_orderkey as task_id, l_partkey * 1000000 + l_suppkey as step_id, l_linenumber as seq, case when l_returnflag = 'R' then 'failed' when l_linestatus = 'F' then 'success' when l_returnflag = 'A' then 'running' else 'pending' end as status,
  case when l_quantity > 5 then l_shipdate end as started_at from {lineitem}"""
TASKS = """select o_orderkey as task_id, case when o_orderkey % 10 = 9 then o_orderkey - 1 end as parent_id, case o_orderstatus when 'F' then 'failed' when 'P' then 'pending' else 'success' end as status,
  case when o_orderstatus = 'O' then TS'2002-01-01 00:00:00' end as completed_at, o_orderkey % 5 as processed_pages, case when o_orderkey % 4 = 0 then 4 else 0 end as total_pages from {orders}"""
BATCHES = """select o_orderkey as task_id, n.b as batch_no, o_custkey % 9 as total, o_custkey % 3 as success_count, n.b as failed_count, 1 as skipped_count
  from {orders} cross join (select 1 as b union all select 2) n where o_orderkey % 3 = 0"""


@query("task_view", f"""
with t as ({TASKS.replace("TS'", "timestamp '")}), s as ({STEPS}), b as (select * from ({BATCHES}) x where batch_no = 2),
g as (select task_id, count(*) as n, count(case when status = 'success' then 1 end) as ok, min(case when status = 'running' then (seq, step_id) end) as live, min(case when status <> 'success' then (seq, step_id) end) as waiting,
  min(case when status = 'failed' then (seq, step_id) end) as bad, min(case when started_at is not null then (seq, step_id, started_at) end) as first from s group by 1)
select t.task_id, case when t.status = 'pending' then 'queued' else t.status end as display_status, coalesce(live[2], waiting[2]) as current_step,
  case when total_pages > 0 then floor(least(processed_pages, total_pages) * 100 / total_pages)::bigint when b.total > 0 then floor(least(success_count + failed_count + skipped_count, b.total) * 100 / b.total)::bigint
       when b.task_id is null and n > 0 then floor(ok * 100 / n)::bigint end as percent,
  case when first is not null and completed_at is not null then greatest(0, epoch_ms(completed_at) - epoch_ms(first[3])) end as duration_ms, bad[2] as failed_step,
  coalesce(success_count, 0) as success_count, coalesce(failed_count, 0) as failed_count, coalesce(skipped_count, 0) as skipped_count
from t left join g using (task_id) left join b using (task_id) where parent_id is null""")
def task_view(t):
    return lg.task_view(t.sql(TASKS.replace("TS'", "timestamp_ntz'")), t.sql(STEPS), t.sql(BATCHES))


COLLECTIONS = "select n_nationkey as collection_id, n_name as name, cast('2024-01-01' as string) as updated_at from {nation}"
MEMBERS = "select s_nationkey as collection_id, s_suppkey as file_id, concat('2024-02-', lpad(cast(1 + s_suppkey % 28 as string), 2, '0')) as attached_at from {supplier} where s_nationkey % 9 <> 8"
FILES = """select s_suppkey as file_id, case when s_suppkey % 11 = 0 then 'Deleted' when s_nationkey % 9 < 2 then 'ready' when s_suppkey % 13 = 0 then 'failed' else 'READY' end as lifecycle_status,
  case when s_suppkey % 5 = 0 and s_nationkey % 9 > 3 then 'stale' else 'indexed' end as index_status, s_suppkey % 2 = 0 and s_nationkey % 9 <= 3 as queryable, concat('2024-03-', lpad(cast(1 + s_suppkey % 9 as string), 2, '0')) as file_updated_at from {supplier}"""


@query("collection_members", f"with c as ({COLLECTIONS}), m as ({MEMBERS}), f as ({FILES}) select c.*, file_id, attached_at, lifecycle_status, index_status, queryable, file_updated_at from c left join (select * from m join f using (file_id)) x using (collection_id)")
def collection_members(t):
    return lg.collection_members(t.sql(COLLECTIONS), t.sql(MEMBERS), t.sql(FILES))


@query("collection_status", f"""with c as ({COLLECTIONS}), m as ({MEMBERS}), f as ({FILES}), x as (select c.collection_id, c.updated_at, file_id, attached_at, lower(lifecycle_status) as st, index_status, queryable, file_updated_at,
  file_id is not null and lower(lifecycle_status) <> 'deleted' as alive from c left join (select * from m join f using (file_id)) x using (collection_id))
select collection_id, count(case when alive then 1 end) as file_count, greatest(max(updated_at), max(attached_at), max(file_updated_at)) as updated_at, case when count(case when alive then 1 end) = 0 then 'Empty'
  when bool_or(alive and (st in ('failed', 'cleanup_failed') or index_status = 'failed')) then 'Failed' when bool_and(not alive or (st in ('ready', 'queryable') and (queryable or index_status = 'indexed'))) then 'Ready' else 'Indexing' end as status from x group by 1""")
def collection_status(t):
    return lg.collection_status(t.sql(COLLECTIONS), t.sql(MEMBERS), t.sql(FILES))


ITEMS = """select l_orderkey as batch_id, l_partkey as target_id, case l_returnflag when 'A' then 'success' when 'R' then 'failed' else 'skipped' end as status, concat('act-', cast(l_suppkey as string)) as action_id,
  case when l_returnflag = 'R' then 'SCORE_NO_RECORD' end as error_code, concat('r', cast(l_linenumber as string)) as result_summary from {lineitem}"""
BATCH_LEDGER = "select o_orderkey as batch_id, case when o_orderstatus = 'P' then 'pending' else 'success' end as batch_status from {orders}"


@query("batch_by_action", f"with b as ({BATCH_LEDGER}), i as ({ITEMS}) select * from b where batch_id in (select batch_id from i where action_id = 'act-7')")
def batch_by_action(t):
    return lg.batches_of_action(t.sql(BATCH_LEDGER), t.sql(ITEMS), "act-7")


COUNTS = "count(*) as total, count(case when status = 'success' then 1 end) as success_count, count(case when status = 'failed' then 1 end) as failed_count, count(case when status = 'skipped' then 1 end) as skipped_count"


@query("status_counters", f"with i as ({ITEMS}) select batch_id, {COUNTS} from i group by 1")
def status_counters(t):
    return bt.status_counters(t.sql(ITEMS))


@query("batch_final_status", f"with i as ({ITEMS}) select batch_id, {COUNTS}, case when bool_or(status = 'success') then 'success' when bool_or(status = 'skipped') then 'skipped' else 'failed' end as final_status from i group by 1")
def batch_final_status(t):
    return bt.final_status(bt.status_counters(t.sql(ITEMS)))


@query("batch_report", f"with i as ({ITEMS}), c as (select batch_id, {COUNTS} from i group by 1) select batch_id, total, success_count, target_id, error_code, result_summary as message from c join i using (batch_id) where status = 'failed'")
def batch_report(t):
    totals, failures = bt.batch_report(t.sql(ITEMS))
    return failures.join(totals.select("batch_id", "total", "success_count"), "batch_id")


@query("batch_finish", f"""with b as ({BATCH_LEDGER}), i as (select i.*, b.batch_status from ({ITEMS}) i left join b using (batch_id)),
n as (select batch_id, case when batch_status = 'pending' and status = 'success' then 'skipped' else status end as status from i), c as (select batch_id, {COUNTS} from n group by 1)
select b.batch_id, case when batch_status = 'pending' then 'skipped' else batch_status end as batch_status, total, success_count, failed_count, skipped_count from b left join c using (batch_id)""")
def batch_finish(t):
    return bt.finish_batches(t.sql(BATCH_LEDGER), t.sql(ITEMS), "skipped")[0]


SNAP_FILES = """select doc_id as file_id, case doc_id % 6 when 0 then 'FAILED' when 1 then 'INDEXING' when 2 then null else 'QUERYABLE' end as canonical_status, case when doc_id % 6 = 2 then 'parsing' else 'ready' end as lifecycle_status,
  case when doc_id % 3 = 0 then 'indexed' else 'none' end as index_status from {documents}"""


@query("resource_snapshot", f"""with f as ({SNAP_FILES}) select 'files' as metric, count(*) as value from f union all select 'failed', count(*) from f where canonical_status = 'FAILED'
union all select 'processing', count(*) from f where file_id % 6 in (1, 2) union all select 'indexed', count(*) from f where index_status = 'indexed' union all select 'collections', count(*) from {{nation}}
union all select 'tasks', count(*) from {{orders}} where o_orderstatus = 'F' union all select 'evidence', count(distinct l_partkey) from {{lineitem}}""")
def resource_snapshot(t):
    tasks = t.orders.select(F.when(F.col("o_orderstatus") == "F", "research").otherwise("batch").alias("task_type"))
    return lg.resource_snapshot(t.sql(SNAP_FILES), t.nation, tasks, t.lineitem.select(F.col("l_partkey").alias("evidence_id")))


@query("evidence_source_counts", "select l_orderkey as task_id, count(case when l_returnflag in ('A', 'R') then 1 end) as local_count, count(case when l_returnflag = 'N' then 1 end) as web_count from {lineitem} group by 1")
def evidence_source_counts(t):
    kind = F.when(F.col("l_returnflag") == "A", "LOCAL").when(F.col("l_returnflag") == "R", "structured").otherwise("WEB")
    return lg.evidence_source_counts(t.lineitem.select(F.col("l_orderkey").alias("task_id"), kind.alias("source_type")))


VERSIONS = """select o_custkey as file_id, o_orderkey as version_number, concat('v', cast(o_orderkey as string)) as version_id,
  case when o_orderkey % 8 = 0 then null when o_orderkey % 7 = 0 then 'v-gone' else concat('v', cast(first_key as string)) end as parent_version_id,
  case when o_orderkey % 5 = 0 then 'deleted' else 'available' end as status, o_orderpriority as content from {orders} join (select o_custkey as ck, min(o_orderkey) as first_key from {orders} group by o_custkey) f on ck = o_custkey"""


@query("latest_version", f"""with v as ({VERSIONS}), l as (select * from v qualify row_number() over (partition by file_id order by version_number desc) = 1)
select l.file_id, l.version_id, l.version_number, l.parent_version_id, case when l.parent_version_id is null then 'NO_UNDO_VERSION' when p.status = 'available' then 'ok' else 'VERSION_NOT_FOUND' end as undo_status, p.version_number as undo_number
from l left join v p on p.file_id = l.file_id and p.version_id = l.parent_version_id""")
def latest_version(t):
    return lg.latest_versions(t.sql(VERSIONS))


@query("version_integrity", f"""with v as (select *, case when version_number % 9 = 0 then 'bad' else sha256(content) end as content_hash from ({VERSIONS}) x),
g as (select *, lag(version_number) over (partition by file_id order by version_number) as prev from v)
select file_id, version_id, 'VERSION_HASH_MISMATCH' as fault from v where sha256(content) <> content_hash union all select file_id, version_id, 'VERSION_PARENT_MISSING' from v where parent_version_id is not null and not exists (select 1 from v p where p.file_id = v.file_id and p.version_id = v.parent_version_id)
union all select file_id, version_id, 'VERSION_NUMBER_GAP' from g where version_number <> coalesce(prev, 0) + 1""")
def version_integrity(t):
    v = t.sql(VERSIONS).withColumn("content_hash", F.when(F.col("version_number") % 9 == 0, "bad").otherwise(F.sha2("content", 256)))
    return lg.version_integrity(v)


REQUESTS = """select c_custkey as file_id, case c_custkey % 3 when 0 then 'append' when 1 then 'undo' else 'rollback' end as operation, concat(' added ', c_name, ' ') as content, concat('v', cast(c_custkey * 7 as string)) as version_id from {customer}"""
CURRENT = "select c_custkey as file_id, c_mktsegment as text from {customer} where c_custkey % 4 <> 0"


@query("version_diff_preview", f"""with v as ({VERSIONS}), r as ({REQUESTS}), d as ({CURRENT}), l as (select * from v qualify row_number() over (partition by file_id order by version_number desc) = 1),
x as (select r.*, d.text, case operation when 'undo' then l.parent_version_id when 'rollback' then r.version_id end as target_id from r left join d using (file_id) left join l using (file_id))
select x.file_id, operation, coalesce(text, '') as before, case when operation = 'append' then concat_ws(chr(10), nullif(text, ''), trim(x.content)) else s.content end as after, case when text is null then 'ABSENT' else sha256(text) end as expected_hash,
  case when operation = 'append' then 'ok' when operation = 'undo' and target_id is null then 'NO_UNDO_VERSION' when s.content is null then 'VERSION_NOT_FOUND' else 'ok' end as status, case when operation <> 'append' then s.version_number end as target_number
from x left join v s on s.file_id = x.file_id and s.version_id = x.target_id and s.status = 'available'""")
def version_diff_preview(t):
    return lg.version_diff_preview(t.sql(REQUESTS), t.sql(CURRENT), t.sql(VERSIONS))
