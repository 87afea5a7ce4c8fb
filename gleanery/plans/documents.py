"""Sources, sinks, blocks, chunks and order-dependent operators."""

from pyspark.sql import functions as F

from gleanery.functions import ids
from gleanery.operators import chunks as ch
from gleanery.operators import windows as win
from gleanery.operators.ranking import first_per_key
from gleanery.plans.fixtures import PEOPLE
from gleanery.plans.registry import Catalog
from gleanery.sources import catalog, documents as docs, grids, sinks, tables

CATALOG = Catalog()
query = CATALOG.query

KIND = """case when {0} is null or trim({0}) = '' then 'empty' when lower(trim({0})) in ('true', 'false') then 'boolean'
  when regexp_full_match(trim({0}), '[-+]?\\d+') then 'integer' when regexp_full_match(trim({0}), '[-+]?(?:\\d+\\.\\d*|\\d*\\.\\d+)(?:[Ee][-+]?\\d+)?') then 'number' else 'string' end"""


@query("csv_typed_rows", f"""
with p as ({PEOPLE}) select person_id, {KIND.format('score')} as score_kind, try_cast(case when {KIND.format('score')} = 'integer' then score end as bigint) as score_int,
  {KIND.format('balance::varchar')} as balance_kind, balance as balance_number, nullif(trim(name), '') as name_text, row_number % 2 = 0 as flag from p where row_number % 8 <> 0""")
def csv_typed_rows(t):
    rows = t.sql(PEOPLE)
    live = F.col("row_number") % 8 != 0
    flat = rows.select(*[F.when(live, F.col(c).cast("string")).alias(c) for c in ("person_id", "name", "score", "balance")],
                       F.when(live, F.when(F.col("row_number") % 2 == 0, " TRUE").otherwise("false")).alias("flag"))
    path = sinks.new_path(t.spark, "csv")
    flat.write.csv(path, header=True, emptyValue="")
    typed = tables.typed_rows(tables.read_delimited(t.spark, path))
    return typed.select(F.col("person_id.s").alias("person_id"), F.col("score.kind").alias("score_kind"), F.col("score.i").cast("bigint").alias("score_int"),
                        F.col("balance.kind").alias("balance_kind"), F.coalesce("balance.d", F.col("balance.i").cast("double")).alias("balance_number"),
                        F.col("name.s").alias("name_text"), F.col("flag.b").alias("flag"))


LINES_SQL = """lines as (select doc_id, unnest(range(1, len(parts) + 1)) as line_number, regexp_replace(unnest(parts), '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') as content
  from (select doc_id, str_split(text, chr(10)) as parts from {documents})),
blocks as (select doc_id, line_number, row_number() over (partition by doc_id order by line_number) - 1 as sequence, content from lines where content <> '')"""


@query("text_line_blocks", f"with {LINES_SQL} select doc_id, sequence, line_number, content from blocks")
def text_line_blocks(t):
    b = docs.text_line_blocks(t.documents, ["doc_id"])
    return b.select("doc_id", F.col("sequence").cast("bigint").alias("sequence"), F.col("line_number").cast("bigint").alias("line_number"), "content")


@query("json_leaf_rows", """
with e as (select event_id, event_type, (props->>'$.k') as k from {events})
select event_id, unnest(['$.k', '$.m["a b"]', '$.m.list[0]', '$.m.list[1].x', '$.m.list[2]', '$.m.list[3][0][0].deep', '$.e', '$.kind']) as json_path,
  unnest([k, '1.5', k, 'null', '[]', 'true', '{}', '"' || event_type || '"']) as value from e""")
def json_leaf_rows(t):
    k = F.get_json_object("props", "$.k")
    text = F.format_string('{"k": %s, "m": {"a b": 1.5, "list": [%s, {"x": null}, [], [[{"deep": true}]]]}, "e": {}, "kind": "%s"}', k, k, "event_type")
    return docs.json_leaf_rows(t.events.select("event_id", text.alias("j")), "event_id", "j")


def markdown(t):
    return t.documents.select("doc_id", F.concat(
        F.lit("# Doc "), "doc_id", F.lit("\n\nintro [site](http://x.example/a) text\n\n## Part `x` ##\n- one\n- two\n  more\n\n| a | b |\n|---|:-:|\n| 1 | 2 |\n"),
        F.when(F.col("doc_id") % 3 == 0, "| 3 |\n").otherwise(""), F.lit("\n```python t\n# not a heading [l](u)\n"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise("```\n"), F.lit("#### Deep\n"), "text").alias("text"))


@query("markdown_blocks")
def markdown_blocks(t):
    return docs.markdown_blocks(markdown(t), "doc_id").withColumn("links", F.size("links")).withColumn(
        "warnings", F.array_join("warnings", ","))


@query("html_documents")
def html_documents(t):
    return docs.html_documents(t.pages).withColumn("detected_patterns", F.array_join("detected_patterns", ","))


FILE_LIST = """select doc_id as file_id, concat(case when doc_id % 3 = 0 then 'Report' else 'note' end, '_', cast(doc_id as string), '.txt') as file_name,
  case when doc_id % 4 = 0 then 'pdf' else 'txt' end as file_type, case when doc_id % 5 = 0 then 'Failed' else 'ready' end as lifecycle_status,
  case when doc_id % 7 = 0 then 'FAILED' else 'QUERYABLE' end as canonical_status, n_chars as size, doc_id as created_time from {documents}"""


@query("file_catalog", f"with f as ({FILE_LIST}) select * from f where contains(lower(file_name), 'report') and file_type = 'txt' and (lower(lifecycle_status) = 'failed' or lower(canonical_status) = 'failed')")
def file_catalog(t):
    return catalog.file_catalog(t.sql(FILE_LIST), " REPORT ", "txt", "failed", "size")


@query("grid_cells", """
with g as (select 'g' || c_custkey as table_id, [[c_name, c_mktsegment], case when c_custkey % 9 = 0 then [c_nationkey::varchar] else [c_nationkey::varchar, case when c_custkey % 10 = 1 then 'call delete_file' else 'x' end] end] as rows from {customer}),
c as (select table_id, unnest(range(0, len(rows))) as row_index, unnest(rows) as r from g where len(rows[1]) = len(rows[2])),
d as (select table_id, row_index, unnest(range(0, len(r))) as column_index, unnest(r) as cell_text from c)
select table_id, row_index, column_index, substr(sha256(table_id || ':cell:' || row_index || ':' || column_index), 1, 32) as cell_id, cell_text,
  case when contains(cell_text, 'delete_file') then 'TOOL_NAME_TEXT' else '' end as detected_patterns, 'normal' as status, null as warning from d
union all select table_id, null, null, null, array_to_string(list_transform(rows, lambda r: array_to_string(r, chr(9))), chr(10)), null, 'degraded', 'IRREGULAR_GRID' from g where len(rows[1]) <> len(rows[2])""")
def grid_cells(t):
    n = F.col("c_nationkey").cast("string")
    second = F.when(F.col("c_custkey") % 9 == 0, F.array(n)).otherwise(F.array(n, F.when(F.col("c_custkey") % 10 == 1, "call delete_file").otherwise("x")))
    g = t.customer.select(F.concat(F.lit("g"), "c_custkey").alias("table_id"), F.array(F.array("c_name", "c_mktsegment"), second).alias("rows"))
    return grids.grid_cells(g)


# chunks of documents: one block per document
def doc_chunks(t):
    blocks = t.documents.select(F.concat(F.lit("doc-"), "doc_id").alias("file_id"), F.lit(0).alias("sequence"),
                                F.concat(F.lit("b"), "doc_id").alias("block_id"), F.col("text").alias("content"))
    parts = ch.block_chunks(blocks, ["file_id", "block_id"]).withColumn("text_hash", ids.text_hash(F.col("chunk_text")))
    return parts.withColumn("chunk_id", ids.chunk_id(F.col("block_id"), F.col("chunk_index"), F.col("text_hash"))).withColumn(
        "chunk_index", F.col("chunk_index").cast("bigint"))


CHUNKS_SQL = """raw as (select 'doc-' || doc_id as file_id, 'b' || doc_id as block_id, doc_id, unnest(range(0, greatest(ceil(length(text) / 800.0)::bigint, 1))) as chunk_index, text, lang, source from {documents}),
chunks as (select *, substr(text, chunk_index * 800 + 1, 900) as chunk_text, sha256(substr(text, chunk_index * 800 + 1, 900)) as text_hash,
  substr(sha256(block_id || ':' || chunk_index || ':' || sha256(substr(text, chunk_index * 800 + 1, 900))), 1, 32) as chunk_id from raw)"""


@query("overlapping_chunks", """
with b as (select source as file_id, doc_id, doc_id % 2 = 0 as empty_block, case when doc_id % 50 = 7 then '' else text end as content from {documents}),
n as (select *, greatest(ceil(length(content) / 800.0)::bigint, 1) as n from b), o as (select *, coalesce(sum(n) over (partition by file_id order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as first from n),
c as (select file_id, 'b' || doc_id as block_id, first, unnest(range(0, n)) as i, content from o)
select file_id, block_id, first + i as chunk_index, sha256(substr(content, i * 800 + 1, 900)) as text_hash,
  substr(sha256(block_id || ':' || i || ':' || sha256(substr(content, i * 800 + 1, 900))), 1, 32) as chunk_id from c""")
def overlapping_chunks(t):
    blocks = t.documents.select(F.col("source").alias("file_id"), F.col("doc_id").alias("sequence"), F.concat(F.lit("b"), "doc_id").alias("block_id"),
                                F.when(F.col("doc_id") % 50 == 7, "").otherwise(F.col("text")).alias("content"))
    return ch.file_chunks(blocks).select("file_id", "block_id", "chunk_index", "text_hash", "chunk_id")


@query("replace_generation", "with " + CHUNKS_SQL + """
select file_id, case when doc_id % 10 = 0 or doc_id % 2 = 1 or doc_id % 8 = 2 then 'old' else 'new' end as generation, count(*) as chunk_count,
  case when doc_id % 2 = 1 then null when doc_id % 8 = 2 then 'FILE_NOT_INDEXING' when doc_id % 10 = 0 then 'TEXT_HASH_MISMATCH' else 'ok' end as verdict from chunks group by all""")
def replace_generation(t):
    path = sinks.new_path(t.spark, "chunks")
    chunks = doc_chunks(t)
    number = F.substring("block_id", 2, 20).cast("bigint")
    sinks.write_files(chunks.withColumn("generation", F.lit("old")), path)
    candidate = chunks.filter(number % 2 == 0).withColumn("generation", F.lit("new")).withColumn(
        "text_hash", F.when(number % 10 == 0, F.lit("bad")).otherwise(F.col("text_hash")))
    files = t.documents.select(F.concat(F.lit("doc-"), "doc_id").alias("file_id"), F.when(F.col("doc_id") % 8 == 2, "READY").otherwise("INDEXING").alias("status"))
    verdicts = sinks.replace_generation(candidate, path, files)
    active = t.spark.read.parquet(path).groupBy("file_id", "generation").agg(F.count(F.lit(1)).alias("chunk_count"))
    return active.join(verdicts.select("file_id", "verdict"), "file_id", "left")


@query("evidence_upsert", """
select event_id as evidence_id, case when event_id % 3 = 0 then 'new-1' else 'old' end as locator from {events}
union all select event_id + 100000000, 'new-0' from {events} where event_id % 30 = 0""")
def evidence_upsert(t):
    e = t.events
    old = e.select(F.col("event_id").alias("evidence_id"), F.lit(0).alias("seq"), F.lit("old").alias("locator"))
    new = e.filter("event_id % 3 = 0").select(F.col("event_id").alias("evidence_id"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("seq")).withColumn(
        "locator", F.concat(F.lit("new-"), "seq"))
    extra = e.filter("event_id % 30 = 0").select((F.col("event_id") + 100000000).alias("evidence_id"), F.lit(0).alias("seq"), F.lit("new-0").alias("locator"))
    path = sinks.swap_in(sinks.upsert(old, new.unionByName(extra), "evidence_id", "seq"), "evidence")
    return t.spark.read.parquet(path).select("evidence_id", "locator")


@query("trace_append", """
select event_id, strftime(ts, '%Y-%m-%d') as trace_date, '{"phone": "13' || substr(lpad(event_id::varchar, 9, '0'), 1, 1) || '****' || right(lpad(event_id::varchar, 9, '0'), 4) || '"}' as metrics_json
from {events} union all select event_id + 100000000, strftime(ts, '%Y-%m-%d'), '{}' from {events} where event_type = 'error'""")
def trace_append(t):
    path = sinks.new_path(t.spark, "traces")
    base = t.events.select("event_id", F.col("ts").alias("created_at"), F.format_string('{"phone": "13%09d"}', "event_id").alias("metrics_json"))
    sinks.append_traces(base, path)
    sinks.append_traces(t.events.filter("event_type = 'error'").select((F.col("event_id") + 100000000).alias("event_id"), F.col("ts").alias("created_at"), F.lit("{}").alias("metrics_json")), path)
    return t.spark.read.parquet(path).select("event_id", F.col("trace_date").cast("string").alias("trace_date"), "metrics_json")


def _plain(value):
    """Literal text of a report in DuckDB."""
    return f"regexp_replace(replace(replace(replace({value}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\\\`*_{{{{}}}}\\[\\]()#+!|])', '\\\\\\1', 'g')"


REPORT_SQL = f"""
with b as (select item_id, text, case when item_id % 3 = 0 then 'WEB' else 'LOCAL' end as kind from {{benchmark}})
select item_id as report_id, concat_ws(chr(10),
  '# ' || {_plain("'Report *' || item_id")}, '', '报告 ID：' || item_id, '研究任务：task-' || item_id, '生成时间：2024-01-01', '', '## 任务说明', '', {_plain('text')}, '',
  '## 摘要', '', {_plain("'* ' || text")}, '', '## 分析过程', '', 'as saved', '', '## 核心结论', '',
  '- ' || {_plain('text')}, '  Evidence：' || case when item_id % 2 = 0 then {_plain("'ev-' || item_id")} || ', ' || {_plain("'ev_b'")} else '未建立证据关联' end, '',
  '- ' || {_plain("'<b>second</b>'")}, '  Evidence：未建立证据关联', '', '## Evidence 来源', '',
  '### ' || {_plain("'ev-' || item_id")}, '来源类型：' || case kind when 'LOCAL' then '本地文档' else 'Web 来源' end,
  '来源：' || case kind when 'LOCAL' then {_plain("'f_' || item_id || '.md'")} else {_plain("'http://x/?a=' || item_id")} end,
  case kind when 'LOCAL' then '定位：' || {_plain("""'{"page_no": ' || item_id % 7 || case when item_id % 5 <> 0 then ', "chunk_id": "c' || item_id || '"' else '' end || ', "heading_path": ["A \\"q\\"", "B"], "line_end": ' || item_id % 3 || '}'""")}
    else '检索时间：2024-05-01' end, '',
  '## 限制说明', '', 'links are no proof', '', 'Evidence Quality：' || case when item_id % 4 = 0 then 'WARNING' else 'PASS' end,
  case when item_id % 4 = 0 then '- ' || {_plain("'W_1'")} || '：few sources' else '- 规则检查未发现警告；不代表事实正确性保证。' end) || chr(10) as report from b"""


@query("report_lines", REPORT_SQL)
def report_lines(t):
    i = F.col("item_id")
    b = t.benchmark.withColumn("report_id", i)
    named = lambda prefix: F.concat(F.lit(prefix), i.cast("string"))
    reports = b.select("report_id", named("task-").alias("task_id"), named("Report *").alias("title"), F.lit("2024-01-01").alias("created_at"),
                       F.col("text").alias("task_description"), F.concat(F.lit("* "), "text").alias("summary"), F.lit("as saved").alias("process"),
                       F.lit("links are no proof").alias("limits"), F.when(i % 4 == 0, "WARNING").otherwise("PASS").alias("quality_status"))
    none = F.array().cast("array<string>")
    first = b.select("report_id", F.lit(0).alias("position"), "text", F.when(i % 2 == 0, F.array(named("ev-"), F.lit("ev_b"))).otherwise(none).alias("evidence_refs"))
    second = b.select("report_id", F.lit(1).alias("position"), F.lit("<b>second</b>").alias("text"), none.alias("evidence_refs"))
    noted = F.struct(F.array(F.lit('A "q"'), F.lit("B")).alias("heading_path"), (i % 3).alias("line_end"))
    evidence = b.select("report_id", F.lit(0).alias("position"), named("ev-").alias("evidence_id"), F.when(i % 3 == 0, "WEB").otherwise("LOCAL").alias("source_type"),
                        F.concat(named("f_"), F.lit(".md")).alias("file_name"), named("http://x/?a=").alias("url"), F.lit("2024-05-01").alias("retrieved_at"),
                        (i % 7).alias("page_no"), F.when(i % 5 != 0, named("c")).alias("chunk_id"), noted.alias("metadata"))
    warnings = b.filter(i % 4 == 0).select("report_id", F.lit(0).alias("position"), F.lit("W_1").alias("code"), F.lit("few sources").alias("message"))
    return sinks.render_reports(reports, first.unionByName(second), evidence, warnings)


@query("schema_replace", """
select c_nationkey as file_id, case when c_nationkey % 3 = 0 then 2 else 1 end as generation, count(*) as row_count, count(distinct c_mktsegment) as unique_count from {customer} group by c_nationkey""")
def schema_replace(t):
    fields = t.customer.groupBy(F.col("c_nationkey").alias("file_id")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("c_mktsegment").alias("unique_count"))
    path = sinks.new_path(t.spark, "schemas")
    sinks.write_files(fields.withColumn("generation", F.lit(1)), path)
    sinks.replace_files(fields.filter("file_id % 3 = 0").withColumn("generation", F.lit(2)), path)
    return t.spark.read.parquet(path).select("file_id", "generation", "row_count", "unique_count")


VERSIONS = """select o_custkey as file_id, o_orderkey as version_key, o_orderkey as version_number, concat('v', cast(o_orderkey as string)) as version_id, cast(cast(floor(o_totalprice) as bigint) % 50 as string) as content_hash,
  case when o_orderstatus = 'F' then 'deleted' else 'available' end as status from {orders}"""


@query("version_append", f"""
with v as ({VERSIONS}), l as (select * from v qualify row_number() over (partition by file_id order by version_number desc) = 1),
s as (select c_custkey as file_id, coalesce(l.version_number, 0) as n, l.version_id, case when c_custkey % 2 = 0 then coalesce(content_hash, 'x') else 'other' end as before_hash, content_hash, status from {{customer}} left join l on c_custkey = l.file_id),
r as (select *, coalesce(content_hash = before_hash and status = 'available', false) as reused from s)
select file_id, n + 1 as version_number, version_id as parent_version_id, case when reused then 'after' else before_hash end as content_hash, file_id || ':' || (n + 1) as version_id, 'available' as status from r
union all select file_id, n + 2, file_id || ':' || (n + 1), 'after', file_id || ':' || (n + 2), 'available' from r where not reused""")
def version_append(t):
    versions = t.sql(VERSIONS)
    latest = versions.groupBy("file_id").agg(F.max_by("content_hash", "version_number").alias("h"))
    snaps = t.customer.select(F.col("c_custkey").alias("file_id")).join(latest, "file_id", "left").select(
        "file_id", F.when(F.col("file_id") % 2 == 0, F.coalesce("h", F.lit("x"))).otherwise("other").alias("before_hash"), F.lit("after").alias("after_hash"))
    return sinks.append_versions(versions, snaps)


@query("first_occurrence", "select doc_id, text_key from (select doc_id, sha256(text) as text_key, row_number() over (partition by text order by doc_id) as n from {documents}) where n = 1")
def first_occurrence(t):
    d = t.documents.select(ids.text_hash(F.col("text")).alias("text_key"), "doc_id")
    return first_per_key(d, ["text_key"], F.col("doc_id"))


@query("heading_path", f"""
with {LINES_SQL}, h as (select doc_id, line_number, content, case when length(content) % 9 between 1 and 6 then (length(content) % 9)::int end as lv from blocks),
m as (select *, {', '.join(f"last_value(case when lv = {n} then line_number end ignore nulls) over w as a{n}, last_value(case when lv = {n} then content end ignore nulls) over w as t{n}, last_value(case when lv < {n} then line_number end ignore nulls) over w as r{n}" for n in range(1, 7))}
  from h window w as (partition by doc_id order by line_number))
select doc_id, line_number, concat_ws(' / ', {', '.join(f"case when a{n} > coalesce(r{n}, 0) then t{n} end" for n in range(1, 7))}) as heading_path from m""")
def heading_path(t):
    b = docs.text_line_blocks(t.documents, ["doc_id"])
    level = F.length("content") % 9
    marked = b.withColumn("heading_level", F.when(level.between(1, 6), level))
    return win.heading_path(marked, "doc_id").select("doc_id", F.col("line_number").cast("bigint").alias("line_number"), F.array_join("heading_path", " / ").alias("heading_path"))


SHEETS = """select c_custkey as sheet, g.r as row, g.c as col,
  case when g.r = 1 then case when g.c = 1 then 'Title' end
       when g.r = 2 then case when c_custkey % 7 = 1 and g.c = 2 then 'id' when c_custkey % 7 = 2 and g.c = 2 then null when g.c = 1 then 'id' when g.c = 2 then 'name' else 'amount' end
       when c_custkey % 7 = 3 and g.c > 1 then null
       when g.c = 1 then cast(c_custkey + g.r as string) when g.c = 2 then c_name else cast(c_nationkey as string) end as value,
  g.r <= 2 or g.c = 2 or (c_custkey % 7 = 4) as is_text
from {customer} cross join (select a.r, b.c from (select 1 as r union all select 2 union all select 3 union all select 4) a cross join (select 1 as c union all select 2 union all select 3) b) g"""


@query("header_row_detection", f"""
with s as ({SHEETS}), f as (select * from s where value is not null and trim(value) <> ''),
r as (select sheet, row, count(*) as n, min(col) as first, max(col) as last, count(case when is_text then 1 end) as texts, count(distinct trim(value)) as names from f group by all),
x as (select r.*, r.last - r.first + 1 as width, q.first as nf, q.last as nl, q.n as nn,
  (select count(*) from f where f.sheet = r.sheet and f.row = r.row + 1 and f.col between r.first and r.last) as ins,
  (select count(*) from f where f.sheet = r.sheet and f.row = r.row + 1 and f.col between r.first and r.last and not f.is_text) as nont
  from r left join r q on q.sheet = r.sheet and q.row = r.row + 1 where r.n >= 2),
y as (select *, texts / width as ts, ins / width as cov, n <> width or names <> n as broken, round(0.35 * texts / width + 0.35 + 0.2 * ins / width + case when ins > 0 then 0.1 * nont / ins else 0 end, 4) as score from x),
good as (select * from y where ts >= 0.8 and cov >= 0.5 and not broken and not coalesce(nf < first or nl > last or nn > width, false) and score >= 0.78
   and not (sheet % 11 = 5 and row = 2)),
best as (select * from good qualify row_number() over (partition by sheet order by score desc, last - first desc, row) = 1),
ok as (select b.* from best b where not exists (select 1 from y where y.sheet = b.sheet and y.row = b.row - 1 and y.first = b.first and y.last = b.last and y.broken and y.ts >= 0.8 and y.cov >= 0.5))
select c_custkey as sheet, case when ok.row is null then 'failed' else 'detected' end as detection_status, ok.row as header_row, ok.first as first_column, ok.last as last_column, coalesce(ok.score, 0) as confidence
from {{customer}} left join ok on ok.sheet = c_custkey""")
def header_row_detection(t):
    cells = t.sql(SHEETS)
    merged = t.customer.filter("c_custkey % 11 = 5").select(F.col("c_custkey").alias("sheet"), F.lit(2).alias("row"), F.lit(1).alias("first_col"), F.lit(2).alias("last_col"))
    return win.header_rows(cells, merged)


STATES = """select user_id as file_id, event_id as seq, case event_type when 'click' then 'QUERYABLE' when 'view' then 'REINDEXING' when 'purchase' then 'INDEXING' when 'signup' then 'OCR_PROCESSING' else 'FAILED' end as status from {events}"""


@query("status_transition_audit", f"""
with s as ({STATES}), p as (select *, lag(status) over (partition by file_id order by seq) as prev_status from s)
select * from p where prev_status is not null and not ((prev_status = 'QUERYABLE' and status in ('OCR_PROCESSING', 'INDEXING', 'REINDEXING', 'FAILED'))
  or (prev_status = 'REINDEXING' and status in ('OCR_PROCESSING', 'QUERYABLE')) or (prev_status = 'INDEXING' and status in ('QUERYABLE', 'FAILED'))
  or (prev_status = 'OCR_PROCESSING' and status in ('INDEXING', 'REINDEXING', 'FAILED')))""")
def status_transition_audit(t):
    return win.status_transition_audit(t.sql(STATES))


@query("repeat_request_dedupe", """
with recursive e as (select event_type, user_id % 3 as session, event_id, ts from {events}),
acc as (select event_type, session, min(ts) as ts from e group by all
  union all select a.event_type, a.session, min(e.ts) from acc a join e on e.event_type = a.event_type and e.session = a.session and e.ts > a.ts + interval 30 minute group by a.event_type, a.session),
h as (select acc.event_type, acc.session, acc.ts, min(e.event_id) as id from acc join e using (event_type, session, ts) group by all)
select e.event_type, e.session, e.event_id, e.ts, h.id as accepted_id from e asof join h on e.event_type = h.event_type and e.session = h.session and e.ts >= h.ts""")
def repeat_request_dedupe(t):
    e = t.events.select("event_type", (F.col("user_id") % 3).alias("session"), "event_id", "ts")
    return win.repeat_requests(e, ["event_type", "session"], "ts", "event_id", seconds=1800)
