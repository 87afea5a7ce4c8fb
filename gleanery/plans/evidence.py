"""Evidence records, claims, the delivery gate, and set operations on evidence."""

from pyspark.sql import functions as F

from gleanery.functions import text as tx
from gleanery.operators import evidence as ev
from gleanery.operators import retrieval as rt
from gleanery.plans.documents import CHUNKS_SQL, doc_chunks
from gleanery.plans.registry import Catalog
from gleanery.plans.retrieval import WITH as SEARCH_WITH
from gleanery.plans.retrieval import inputs
from gleanery.plans.scalars import CLAIMS_SQL

CATALOG = Catalog()
query = CATALOG.query

# evidence: line items as records behind the draft of their order
EVIDENCE = """
select l_orderkey as draft_id, concat('ev-', cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string)) as evidence_id,
  l_partkey * 10000000 + l_suppkey as position, case l_returnflag when 'A' then 'LOCAL' when 'N' then 'WEB' else case when l_suppkey % 41 = 0 then 'memory' else 'URL' end end as source_type,
  case when l_suppkey % 17 <> 0 then concat('f', cast(l_suppkey as string)) end as file_id, 'a.pdf' as file_name, case when l_partkey % 3 = 0 then ' ' else 'c1' end as chunk_id,
  case when l_partkey % 2 = 0 then 3 end as page_no, cast(null as string) as table, cast(null as string) as cell, cast(null as string) as sheet,
  concat('q', cast(l_linenumber % 3 as string)) as field, concat('r', cast(l_partkey % 2 as string)) as record_key, concat('https://h', cast(l_suppkey % 5 as string), '.example/p') as url,
  case when l_suppkey % 13 = 0 then 'other.example' else concat('H', cast(l_suppkey % 5 as string), '.example.') end as domain,
  case when l_suppkey % 11 = 0 then null when l_suppkey % 7 = 0 then 'soon' else '2024-05-01T00:00:00Z' end as retrieved_at,
  concat('Order ', cast(l_orderkey as string), '  line ', cast(l_linenumber as string), ' has quantity ', cast(cast(l_quantity as bigint) as string)) as content,
  cast(cast(floor(l_quantity / 20) as bigint) as string) as value, 2020 + l_suppkey % 2 as year, case when l_suppkey % 31 = 0 then '3.0' else '4.0' end as evidence_version, l_partkey % 37 = 0 as conflict
from {lineitem}"""
EV_SQL = EVIDENCE.replace("as table,", 'as "table",')
DRAFTS = """
select o_orderkey as draft_id, case when o_orderkey % 50 = 1 then '## only heading' else concat('Order ', cast(o_orderkey as string), ' line 1 has quantity. ',
  case when o_orderkey % 3 = 0 then concat('Cited [evidence:', coalesce(f.first_id, 'none'), ']. ') when o_orderkey % 3 = 1 then 'Cited [nobody]. ' else '' end, '# head line; Order line 2!') end as draft,
  case when o_orderkey % 5 = 0 then 'what is the latest state' else 'state' end as query, f.first_id
from {orders} left join (select l_orderkey, min(concat('ev-', cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string))) as first_id from {lineitem} group by l_orderkey) f on o_orderkey = f.l_orderkey"""


def evidence(t):
    return t.sql(EVIDENCE.replace("as table,", "as `table`,"))


def claim_map(t):
    d = t.sql(DRAFTS).filter("draft_id % 7 = 0 and first_id is not null")
    return d.select("draft_id", F.lit("Order line 2").alias("claim"), F.col("first_id").alias("mapped_id"))


NORM = "replace(lower(regexp_replace(regexp_replace({0}, '[\\s\\pZ]+', '', 'g'), '^[。.!！?？;；]+|[。.!！?？;；]+$', '', 'g')), 'ß', 'ss')"
CITE = r"\[(?:evidence:)?([A-Za-z0-9_-]{1,128})\]"
GATE_SQL = f"""e as ({EV_SQL}), d as ({DRAFTS}),
ff as (select draft_id, evidence_id, min(position) as fp from e group by all),
j as (select e.*, fp, query like '%latest%' as ts, source_type = 'LOCAL' as loc, source_type in ('WEB', 'URL') as web from e join ff using (draft_id, evidence_id) join d using (draft_id)),
k as (select *, position <> fp or evidence_version <> '4.0' as bad, loc and not (trim(chunk_id) <> '' or coalesce(page_no, 0) > 0) as lost,
  case when loc then file_id is null when web then retrieved_at is null or split_part(url, '/', 3) <> regexp_replace(lower(domain), '\\.+$', '') else true end as incomplete,
  retrieved_at is not null as dated from j),
judged as (select *, not (bad or lost or incomplete) as usable from k),
cl0 as (select draft_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(draft, '\\.[\\s\\pZ]+', '.' || chr(1), 'g'), '[。！？!?；;\\n\\x01]+'), lambda x: trim(x)),
   lambda x: x <> '' and not regexp_full_match(x, '#{{1,6}}\\s+[^\\n]+|[|\\s:\\-]+')) as cs from d),
claims as (select draft_id, unnest(range(1, len(cs) + 1)) as claim_no, unnest(cs) as claim from cl0),
cmap as (select draft_id, 'Order line 2' as claim, first_id as mapped_id from d where draft_id % 7 = 0 and first_id is not null),
mapped as (select c.draft_id, claim_no, mapped_id as evidence_id, 'explicit_mapping' as method from claims c join cmap using (draft_id, claim)),
un as (select * from claims c where not exists (select 1 from mapped m where m.draft_id = c.draft_id and m.claim_no = c.claim_no)),
cited as (select distinct draft_id, claim_no, unnest(regexp_extract_all(claim, '{CITE}', 1)) as evidence_id, 'inline_citation' as method from un),
us as (select distinct draft_id, evidence_id, content from judged where usable),
named as (select n.draft_id, n.claim_no, n.method, us.evidence_id, us.evidence_id is null as unknown from (select * from mapped union all select * from cited) n left join us on us.draft_id = n.draft_id and us.evidence_id = n.evidence_id),
silent as (select * from un u where not exists (select 1 from cited c where c.draft_id = u.draft_id and c.claim_no = u.claim_no)),
ex as (select s.draft_id, s.claim_no, 'exact_excerpt' as method, us.evidence_id, false as unknown from silent s left join us on us.draft_id = s.draft_id and {NORM.format("s.claim")} <> ''
  and contains({NORM.format("us.content")}, {NORM.format("s.claim")})),
links as (select * from named union all select * from ex),
vk as (select *, coalesce(year::varchar, '') as yy from e where source_type in ('LOCAL', 'WEB', 'URL') and value is not null),
vc as (select distinct a.draft_id, a.evidence_id, a.position, a.field, a.record_key from vk a join vk b on a.draft_id = b.draft_id and a.field = b.field and a.record_key = b.record_key and a.yy = b.yy and (a.source_type = 'LOCAL') <> (b.source_type = 'LOCAL') and a.value <> b.value),
w as (select draft_id, 'EVIDENCE_INVALID' as code from judged where bad union all select draft_id, 'LOCATION_MISSING' from judged where lost union all select draft_id, 'SOURCE_INCOMPLETE' from judged where incomplete
  union all select draft_id, 'FRESHNESS_MISSING' from judged where ts and not dated union all select draft_id, 'FRESHNESS_INVALID' from judged where dated and retrieved_at = 'soon' union all select draft_id, 'EVIDENCE_CONFLICT' from judged where conflict
  union all select draft_id, 'EVIDENCE_CONFLICT' from vc union all select draft_id, 'EVIDENCE_MISSING' from (select draft_id, claim_no from links group by all having count(evidence_id) = 0 or bool_or(unknown))
  union all select draft_id, 'ANSWER_DRAFT_MISSING' from d where draft_id not in (select draft_id from claims))
"""


@query("local_web_value_conflict", f"with {GATE_SQL} select draft_id, evidence_id, field, record_key from vc")
def local_web_value_conflict(t):
    return ev.value_conflicts(evidence(t)).select("draft_id", "evidence_id", "field", "record_key")


@query("claim_citation_join", f"with {GATE_SQL} select draft_id, claim_no, method, evidence_id, unknown from links where method <> 'exact_excerpt'")
def claim_citation_join(t):
    return _gate(t)[1].filter("method <> 'exact_excerpt'").withColumn("claim_no", F.col("claim_no").cast("bigint"))


def _gate(t):
    return ev.evidence_gate(t.sql(DRAFTS), evidence(t), claim_map(t))


@query("evidence_gate", f"with {GATE_SQL} select draft_id, code, count(*) as findings from w group by all")
def evidence_gate(t):
    return _gate(t)[0]


@query("claim_coverage", f"with {GATE_SQL} select draft_id, claim_no, method, count(evidence_id) as linked from links group by all")
def claim_coverage(t):
    return _gate(t)[1].groupBy("draft_id", F.col("claim_no").cast("bigint").alias("claim_no"), "method").agg(F.count("evidence_id").alias("linked"))


@query("claim_excerpt_join", f"""with c as (select item_id, {NORM.format('text')} as claim from {{benchmark}}), b as (select doc_id, {NORM.format('text')} as body from {{documents}})
select item_id as phrase_id, doc_id as text_id from c join b on contains(body, claim)""")
def claim_excerpt_join(t):
    phrases = t.benchmark.select(F.col("item_id").alias("phrase_id"), tx.claim_normal(F.col("text")).alias("phrase"))
    texts = t.documents.select(F.col("doc_id").alias("text_id"), tx.claim_normal(F.col("text")).alias("body"))
    return rt.containment(texts, phrases).select("phrase_id", "text_id")


@query("conversation_claims", "with " + CLAIMS_SQL.replace("{{", "{").replace("}}", "}") + " select conv_id, turn, count(*) as claims from claims group by all")
def conversation_claims(t):
    c = ev.claims_of(t.conversations.select(F.struct("conv_id", "turn").alias("draft_id"), F.col("text").alias("draft")))
    return c.groupBy("draft_id").agg(F.count(F.lit(1)).alias("claims")).select("draft_id.conv_id", "draft_id.turn", "claims")


RECORDS = f"""select e.*, case when position % 3 = 0 then 'not_applicable' else 'unknown' end as freshness, case when position % 5 = 0 then null else 'unstructured' end as legacy_source_type,
  case when position % 7 = 0 then 'trusted' else 'untrusted_web_data' end as trust_level, position % 23 = 0 as has_authority from ({EVIDENCE}) e"""


@query("evidence_valid", f"""with r as ({RECORDS.replace('as table,', 'as "table",')}) select evidence_id, position, case when source_type = 'LOCAL' then file_id is not null and legacy_source_type is not null and freshness = 'not_applicable'
  when source_type in ('WEB', 'URL') then retrieved_at is not null and trust_level = 'untrusted_web_data' and not has_authority else false end as valid from r""")
def evidence_valid(t):
    r = t.sql(RECORDS.replace("as table,", "as `table`,"))
    return r.select("evidence_id", "position", ev.evidence_valid(r).alias("valid"))


OLD = """select l_partkey * 10000000 + l_suppkey as evidence_id, case when l_returnflag = 'A' then 'structured' else 'unstructured' end as source_type, cast(null as string) as locator_type,
  case l_partkey % 9 when 0 then 'a.PDF' when 1 then 'b.docx' when 2 then 'c.ppt' when 3 then 'd.txt' when 4 then 'e.json' when 5 then 'f.csv' when 6 then null else 'g.bin' end as file_name, case when l_suppkey % 17 <> 0 then 'f1' end as file_id,
  case when l_partkey % 4 = 0 then 't1' end as table_name, case when l_suppkey % 2 = 0 then 'A1' end as cell, l_suppkey % 5 = 0 as has_box, case when l_linenumber = 3 then 'handwritten' else 'printed' end as recognition_type,
  case when l_linenumber = 2 then 1 end as image_no, case when l_partkey % 7 = 0 then 'rg' end as region_id, 's1' as sheet, 'x' as field, case when l_suppkey % 3 = 0 then 'k' end as record_key, case when l_partkey % 6 = 0 then 'b1' end as block_id,
  case when l_partkey % 10 = 0 then 'c1' end as chunk_id, '' as content, case when l_partkey % 8 = 0 then concat(' ex ', cast(l_partkey as string), ' ') end as text_excerpt, case when l_partkey % 5 <> 0 then '12' end as value_summary,
  l_partkey % 37 = 0 as conflict, l_suppkey % 29 = 0 as review_required, 'supported' as evidence_status from {lineitem}"""


@query("evidence_upgrade", f"""with o as ({OLD}), p as (select *, trim(coalesce(nullif(text_excerpt, ''), value_summary, '')) as body, table_name is not null and cell is not null and has_box as cb from o)
select evidence_id, case when source_type = 'structured' then 'excel' when cb then 'visual_table' when recognition_type = 'handwritten' then 'handwriting' when image_no is not null then 'image' when lower(file_name) like '%.pdf' then case when region_id is not null or has_box then 'visual_pdf' else 'text_pdf' end
   when lower(file_name) like '%.docx' then 'word' when lower(file_name) like '%.ppt' then 'presentation' when lower(file_name) like '%.txt' then 'txt' when lower(file_name) like '%.json' then 'json' when lower(file_name) like '%.csv' then 'csv' end as locator_type,
  case when conflict then 'conflict' when review_required then 'review_required' else evidence_status end as evidence_status, body as content, review_required or conflict as review_required,
  file_id is not null and body <> '' and case when source_type = 'structured' then (table_name is not null and cell is not null) or record_key is not null else block_id is not null or chunk_id is not null or (region_id is not null and has_box) or cb end as valid from p""")
def evidence_upgrade(t):
    return ev.upgrade(t.sql(OLD).withColumnRenamed("table_name", "table"))


@query("evidence_union", """with a as (select doc_id as evidence_id, doc_id as position, 'local' as origin, 0 as l from {documents} where doc_id % 2 = 0 union all select doc_id, doc_id, 'web', 1 from {documents} where doc_id % 3 = 0
  union all select doc_id, doc_id + 100000000, 'late', 1 from {documents} where doc_id % 9 = 0) select evidence_id, origin from (select *, row_number() over (partition by evidence_id order by l, position) as n from a) where n = 1""")
def evidence_union(t):
    d = t.documents.select(F.col("doc_id").alias("evidence_id"))
    part = lambda where, origin, add=0: d.filter(where).select("evidence_id", (F.col("evidence_id") + add).alias("position"), F.lit(origin).alias("origin"))
    second = part("evidence_id % 3 = 0", "web").unionByName(part("evidence_id % 9 = 0", "late", 100000000))
    return ev.evidence_union(part("evidence_id % 2 = 0", "local"), second).select("evidence_id", "origin")


@query("new_evidence", "select doc_id % 7 as need_id, doc_id as evidence_id from {documents} where doc_id % 2 = 0 and doc_id not in (select doc_id from {labels})")
def new_evidence(t):
    need = (F.col("doc_id") % 7).alias("need_id")
    eid = F.col("doc_id").alias("evidence_id")
    return ev.new_evidence(t.documents.filter("doc_id % 2 = 0").select(need, eid), t.labels.select(need, eid))


HITS = """select page_id % 40 as batch_id, page_id as position, case when page_id % 23 = 3 then 'ftp://x.example/' when page_id % 5 = 1 then concat('HTTP://Same.example:80/', cast(page_id % 3 as string), '#f') else url end as url from {pages}"""


@query("url_dedupe", f"""with h as ({HITS}), c as (select *, case when url like 'ftp%' then null when url like 'HTTP:%' then 'http://same.example/' || (position % 3) else regexp_replace(url, '#.*$', '') end as canonical from h),
f as (select batch_id, canonical, min(position) as position from c where canonical is not null group by all), k as (select *, row_number() over (partition by batch_id order by position) as rn from f qualify rn <= 3),
e as (select batch_id, count(*) as n, max(position) as last from k group by 1), b as (select batch_id, min(position) as bad from c where canonical is null group by 1),
r as (select b.batch_id from b left join e using (batch_id) where e.n is null or e.n < 3 or bad < last) select batch_id, canonical as url, position from k where batch_id not in (select batch_id from r)""")
def url_dedupe(t):
    return ev.url_dedupe(t.sql(HITS), 3)


CALLS = """select l_orderkey as answer_id, l_linenumber as call_no, l_partkey * 10000000 + l_suppkey as position, concat('e', cast(l_partkey % 3 as string)) as evidence_id,
  case when l_suppkey % 9 = 0 then 'memory' when l_suppkey % 2 = 0 then 'LOCAL' else 'WEB' end as source_type, (l_orderkey + l_linenumber) % 5 = 0 as declares from {lineitem}"""


@query("answer_evidence_select", f"""with c as ({CALLS}), l as (select answer_id, max(case when declares then call_no end) as last_call from c group by 1), r as (select c.* from c join l using (answer_id) where (last_call is null or call_no = last_call) and source_type <> 'memory')
select answer_id, evidence_id, arg_max(source_type, (call_no, position)) as source_type, min(call_no) as first_call, arg_min(position, (call_no, position)) as first_position from r group by 1, 2""")
def answer_evidence_select(t):
    return ev.answer_evidence(t.sql(CALLS))


LOCATORS = """select event_id as evidence_id, case event_id % 4 when 0 then 'txt' when 1 then 'excel' when 2 then 'word' else 'image' end as locator_type, concat('doc-', cast(event_id % 700 as string)) as file_id,
  case when event_id % 4 = 2 then concat('b', cast(event_id % 700 as string)) end as block_id, case when event_id % 4 = 1 then concat('t', cast(event_id % 50 as string)) end as table_name, case when event_id % 4 = 1 then concat('A', cast(user_id as string)) end as cell,
  case when event_id % 4 = 3 then concat('r', cast(event_id % 2000 as string)) end as region_id from {events}"""


@query("locate_evidence", f"""with {CHUNKS_SQL}, l as ({LOCATORS}), n as (select file_id, count(*) as n from chunks group by 1), f as (select file_id, block_id, chunk_text from chunks where chunk_index = 0)
select l.evidence_id, locator_type, case when coalesce(case when locator_type = 'excel' then s.s_name else coalesce(c.chunk_text, b.chunk_text, p.p_name) end, '') = '' then 'UNAVAILABLE' else 'located' end as status,
  case when locator_type = 'excel' then s.s_name else coalesce(c.chunk_text, b.chunk_text, p.p_name) end as text
from l left join n using (file_id) left join chunks c on locator_type = 'txt' and c.file_id = l.file_id and c.chunk_index = l.evidence_id // 4 % n left join f b on b.file_id = l.file_id and b.block_id = l.block_id
left join {{supplier}} s on table_name = 't' || s_nationkey and cell = 'A' || s_suppkey left join {{part}} p on region_id = 'r' || p_partkey""")
def locate_evidence(t):
    chunks = doc_chunks(t)
    # the evidence of a file is spread over all its chunks
    sizes = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    named = chunks.select("file_id", "chunk_index", F.col("chunk_id").alias("cid"))
    e = (t.sql(LOCATORS).withColumnRenamed("table_name", "table").join(sizes, "file_id", "left")
         .withColumn("chunk_index", F.floor(F.col("evidence_id") / 4) % F.col("n")).join(named, ["file_id", "chunk_index"], "left")
         .withColumn("chunk_id", F.when(F.col("locator_type") == "txt", F.col("cid"))).drop("cid", "n", "chunk_index"))
    cells = t.supplier.select(F.concat(F.lit("t"), "s_nationkey").alias("table"), F.concat(F.lit("A"), "s_suppkey").alias("cell"), F.col("s_name").alias("text"))
    return ev.locate(e, chunks, cells, t.part.select(F.concat(F.lit("r"), "p_partkey").alias("region_id"), F.col("p_name").alias("text")))


@query("document_evidence", SEARCH_WITH + """, m as (select chunk_id, block_id, doc_id, chunk_text from chunks),
q as (select query_id, query, query_id % 10 = 7 as failed, trim(regexp_replace(query, '[\\s\\pZ]+', ' ', 'g')) as qq from queries), r as (select q.*, f.chunk_id, f.file_id, f.score, m.block_id, m.doc_id, trim(regexp_replace(m.chunk_text, '[\\s\\pZ]+', ' ', 'g')) as flat from q left join final f using (query_id) left join m using (chunk_id)),
s as (select *, chunk_id is not null and not failed as hit, greatest(0, strpos(replace(lower(flat), 'ß', 'ss'), replace(lower(trim(query, chr(10) || ' ')), 'ß', 'ss')) - 81) as start from r)
select distinct query_id, case when failed then 'insufficient_evidence' when hit then 'found' else 'not_found' end as status,
  case when hit then substr(sha256('{"block_id": ' || to_json(block_id) || ', "chunk_id": ' || to_json(chunk_id) || ', "query": ' || to_json(query) || '}'), 1, 24) end as evidence_id, case when hit then file_id end as file_id, case when hit then chunk_id end as chunk_id,
  case when hit then 1 + doc_id % 3 end as page_no, case when hit then case when start > 0 then '…' else '' end || substr(flat, start + 1, 240) || case when start + 240 < length(flat) then '…' else '' end end as text_excerpt,
  case when hit then round(score, 6) end as score, case when hit then doc_id % 100 < 80 end as low_confidence, case when hit then doc_id % 13 = 0 end as review_required from s""")
def document_evidence(t):
    chunks, queries = inputs(t)
    number = F.substring("block_id", 2, 20).cast("bigint")
    meta = chunks.withColumns({"page_no": 1 + number % 3, "confidence": (number % 100) / 100, "review_required": number % 13 == 0})
    return ev.document_evidence(rt.hybrid_retrieve(chunks, queries, 5), meta, queries, queries.filter("query_id % 10 = 7"))


WEB_HITS = """select page_id, url, '' as domain, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, case when page_id % 9 = 0 then ' ' else regexp_replace(html, '[^a-zA-Z ]', '') end as content,
  case when page_id % 4 = 0 then 'Pub' end as publisher, case when page_id % 3 = 0 then '2024-01-02' else ' ' end as published_at, case page_id % 3 when 0 then ' Official' when 1 then 'big' end as authority, '2024-06-01T00:00:00Z' as retrieved_at from {pages}"""


@query("web_evidence", f"""with h as ({WEB_HITS.replace("'[^a-zA-Z ]', ''", "'[^a-zA-Z ]', '', 'g'")}), s as (select *, trim(content) as whole from h where trim(content) <> '')
select substr(sha256('{{"content_hash": "' || sha256(whole) || '", "source_type": "WEB", "url": "' || url || '"}}'), 1, 24) as evidence_id, 'WEB' as source_type, url, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as domain, nullif(trim(title), '') as title, whole as content,
  false as content_truncated, publisher, nullif(trim(published_at), '') as published_at, retrieved_at, case when page_id % 3 = 0 then 'official' else 'unknown' end as authority, case when page_id % 3 = 0 then 'published_at_available' else 'retrieval_time_only' end as freshness, 'untrusted_web_data' as trust_level from s""")
def web_evidence(t):
    return ev.web_evidence(t.sql(WEB_HITS), "WEB")
