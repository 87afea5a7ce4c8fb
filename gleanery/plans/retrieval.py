"""Retrieval for tables of queries, and the set operations on its results."""

from pyspark.sql import functions as F

from gleanery.functions import text as tx
from gleanery.operators import retrieval as rt
from gleanery.operators.scope import search_scope
from gleanery.operators.storage import settle
from gleanery.plans.documents import CHUNKS_SQL, doc_chunks
from gleanery.plans.registry import Catalog

CATALOG = Catalog()
query = CATALOG.query
LIMIT = 5
QUERIES = "select item_id as query_id, substr(text, 1 + (item_id % 3) * 10, 20 + (item_id % 4) * 20) as query from {benchmark}"


def inputs(t):
    """The chunk table, stored once as a search finds it, and the queries."""
    return settle(doc_chunks(t).repartition("chunk_id")), t.sql(QUERIES)


TOK = """list_concat(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[a-z0-9]+'), regexp_extract_all({0}, '[一-鿿]'))"""
SEARCH_SQL = CHUNKS_SQL + f""",
queries as ({QUERIES}),
hits as (select query_id, chunk_id, file_id, chunk_index, greatest(length(chunk_text) - 2, 0) as d, (length(lower(chunk_text)) - length(replace(lower(chunk_text), lower(query), ''))) / length(query) as tf0,
   len(list_filter(range(1, length(chunk_text) - length(query) + 2), lambda i: substr(lower(chunk_text), i, length(query)) = lower(query))) as tf
   from queries join chunks on contains(lower(chunk_text), lower(query)) where length(query) >= 3),
stats as (select count(*) as n, avg(greatest(length(chunk_text) - 2, 0)) as mean from chunks),
dfs as (select query_id, count(*) as df from hits group by 1),
ranked as (select h.query_id, h.chunk_id, file_id, chunk_index, -case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end
   * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d / mean)) as rank from hits h join dfs using (query_id), stats),
kw as (select *, row_number() over (partition by query_id order by rank, chunk_index, file_id) as keyword_position from ranked qualify keyword_position <= 20),
ct as (select chunk_id, ('0x' || substr(sha256(tok), 1, 8))::bigint % 2048 as bucket, count(*) as c from (select chunk_id, unnest({TOK.format('chunk_text')}) as tok from chunks) group by all),
cv as (select chunk_id, bucket, c / sqrt(sum(c * c) over (partition by chunk_id)) as w from ct),
qt as (select query_id, ('0x' || substr(sha256(tok), 1, 8))::bigint % 2048 as bucket, count(*) as c from (select query_id, unnest({TOK.format('query')}) as tok from queries) group by all),
qv as (select query_id, bucket, c / sqrt(sum(c * c) over (partition by query_id)) as w from qt),
sims as (select query_id, chunk_id, round(sum(cv.w * qv.w), 8) as vector_score from cv join qv using (bucket) group by all having sum(cv.w * qv.w) >= 0.12),
vec as (select s.*, file_id, chunk_index, row_number() over (partition by query_id order by vector_score desc, file_id, chunk_index) as vector_position from sims s join chunks using (chunk_id) qualify vector_position <= 20),
fused as (select coalesce(k.query_id, v.query_id) as query_id, coalesce(k.chunk_id, v.chunk_id) as chunk_id, coalesce(k.file_id, v.file_id) as file_id, coalesce(k.chunk_index, v.chunk_index) as chunk_index,
  round(coalesce(1.0 / (60 + keyword_position), 0) + coalesce(1.0 / (60 + vector_position), 0), 8)::double as combined_score, round(coalesce(1.0 / keyword_position, 0), 8)::double as keyword_score, coalesce(vector_score, 0) as vector_score,
  concat_ws(',', case when keyword_position is not null then 'keyword' end, case when vector_position is not null then 'vector' end) as sources
  from kw k full join vec v on k.query_id = v.query_id and k.chunk_id = v.chunk_id),
cand as (select *, row_number() over (partition by query_id order by combined_score desc, vector_score desc, file_id, chunk_index) as fused_position from fused qualify fused_position <= 20),
terms as (select query_id, list_distinct(regexp_extract_all(replace(lower(query), 'ß', 'ss'), '[a-z0-9]+|[一-鿿]')) as qterms from queries),
over_ as (select cand.*, max(combined_score) over (partition by query_id) as best, case when len(qterms) > 0 then len(list_intersect(qterms, list_distinct(regexp_extract_all(replace(lower(chunk_text), 'ß', 'ss'), '[a-z0-9]+|[一-鿿]')))) / len(qterms) else 0 end as overlap
  from cand join chunks using (chunk_id) join terms using (query_id)),
rer as (select *, round(least(1.0, 0.6 * combined_score / best + 0.25 * vector_score + 0.15 * overlap), 8) as score from over_),
final as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as final_position from rer qualify final_position <= {LIMIT})
"""
WITH = "with " + SEARCH_SQL


@query("keyword_retrieve", WITH + "select query_id, chunk_id, file_id, chunk_index, round(rank, 8) as rank, keyword_position from kw")
def keyword_retrieve(t):
    return rt.keyword_retrieve(*inputs(t), rt.candidate_limit(LIMIT)).withColumn("rank", F.round("rank", 8)).withColumn(
        "keyword_position", F.col("keyword_position").cast("bigint"))


@query("index_chunk_join", WITH + "select query_id, chunk_id, tf from hits where file_id in (select 'doc-' || doc_id from {documents} where lang = 'en')".replace("{documents}", "documents"))
def index_chunk_join(t):
    chunks, queries = inputs(t)
    wanted = t.documents.filter("lang = 'en'").select(F.concat(F.lit("doc-"), "doc_id").alias("file_id"))
    scoped = chunks.join(wanted, "file_id", "left_semi")
    return rt.phrase_hits(scoped, queries)


@query("vector_retrieve", WITH + "select query_id, chunk_id, file_id, chunk_index, round(vector_score, 6) as vector_score, vector_position from vec")
def vector_retrieve(t):
    return rt.vector_retrieve(*inputs(t), rt.candidate_limit(LIMIT)).withColumn("vector_score", F.round("vector_score", 6)).withColumn(
        "vector_position", F.col("vector_position").cast("bigint"))


SCOPED = """ and d.lang = ['en', 'de', 'fr', 'es'][1 + r.query_id % 4] and 1 + r.chunk_index % 3 = 1 + r.query_id % 3"""


def scope(t):
    """Files of one language per query, by their metadata, and one page of them."""
    files = t.documents.select(F.concat(F.lit("doc-"), "doc_id").alias("file_id"), F.to_json(F.struct("lang")).alias("metadata"))
    langs = F.array(*map(F.lit, ("en", "de", "fr", "es")))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.lit("lang").alias("key"), F.get(langs, (F.col("item_id") % 4).cast("int")).alias("value"))
    return search_scope(asked, files, ["lang"]).withColumn("page_no", 1 + F.col("query_id") % 3)


@query("scoped_keyword_retrieve", WITH + f""", s as (select r.* from ranked r join documents d on r.file_id = 'doc-' || d.doc_id{SCOPED})
select query_id, chunk_id, file_id, chunk_index, round(rank, 8) as rank, row_number() over (partition by query_id order by rank, chunk_index, file_id) as keyword_position from s qualify keyword_position <= 20""")
def scoped_keyword_retrieve(t):
    chunks, queries = inputs(t)
    chunks = chunks.withColumn("page_no", 1 + F.col("chunk_index") % 3)
    return rt.keyword_retrieve(chunks, queries, rt.candidate_limit(LIMIT), scope(t)).withColumn("rank", F.round("rank", 8)).withColumn(
        "keyword_position", F.col("keyword_position").cast("bigint"))


@query("scoped_vector_retrieve", WITH + f""", r as (select s.*, file_id, chunk_index from sims s join chunks using (chunk_id)), s as (select r.* from r join documents d on r.file_id = 'doc-' || d.doc_id{SCOPED})
select query_id, chunk_id, file_id, chunk_index, round(vector_score, 6) as vector_score, row_number() over (partition by query_id order by vector_score desc, file_id, chunk_index) as vector_position from s qualify vector_position <= 20""")
def scoped_vector_retrieve(t):
    chunks, queries = inputs(t)
    chunks = chunks.withColumn("page_no", 1 + F.col("chunk_index") % 3)
    return rt.vector_retrieve(chunks, queries, rt.candidate_limit(LIMIT), scope(t)).withColumn("vector_score", F.round("vector_score", 6)).withColumn(
        "vector_position", F.col("vector_position").cast("bigint"))


@query("result_position", WITH + "select query_id, chunk_id, vector_position as position from vec where vector_position <= 10")
def result_position(t):
    return rt.vector_retrieve(*inputs(t), 10).select("query_id", "chunk_id", F.col("vector_position").cast("bigint").alias("position"))


def _fused(t):
    chunks, queries = inputs(t)
    n = rt.candidate_limit(LIMIT)
    return chunks, queries, rt.fuse(rt.keyword_retrieve(chunks, queries, n), rt.vector_retrieve(chunks, queries, n))


FUSED_COLS = "query_id, chunk_id, file_id, chunk_index, round(combined_score, 6) as combined_score, round(keyword_score, 6) as keyword_score, round(vector_score, 6) as vector_score, sources"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("combined_score", "keyword_score", "vector_score", "retrieval_score") if c in df.columns})


@query("rrf_fuse", WITH + f"select {FUSED_COLS} from fused")
def rrf_fuse(t):
    return _rounded(_fused(t)[2])


@query("rank_fusion_join", WITH + "select sources, count(*) as pairs from fused group by sources")
def rank_fusion_join(t):
    return _fused(t)[2].groupBy("sources").agg(F.count(F.lit(1)).alias("pairs"))


@query("candidate_cut", WITH + "select query_id, chunk_id, fused_position from cand")
def candidate_cut(t):
    return rt.hybrid_order(_fused(t)[2], rt.candidate_limit(LIMIT)).select("query_id", "chunk_id", F.col("fused_position").cast("bigint").alias("fused_position"))


@query("rerank", WITH + "select query_id, chunk_id, round(score, 6) as score from rer")
def rerank(t):
    chunks, queries, fused = _fused(t)
    return rt.rerank(rt.hybrid_order(fused, rt.candidate_limit(LIMIT)), chunks, queries).withColumn("score", F.round("score", 6))


@query("term_overlap", WITH + "select query_id, chunk_id, round(overlap, 6) as overlap from over_")
def term_overlap(t):
    chunks, queries, fused = _fused(t)
    rows = rt.hybrid_order(fused, rt.candidate_limit(LIMIT)).join(chunks.select("chunk_id", "chunk_text"), "chunk_id").join(queries, "query_id")
    return rows.select("query_id", "chunk_id", F.round(tx.term_overlap(tx.term_set(F.col("query")), tx.term_set(F.col("chunk_text"))), 6).alias("overlap"))


@query("rerank_contract_check", WITH + ", n as (select query_id, count(*) as n from cand group by 1) select query_id, query_id % 4 = 0 as valid from n where query_id % 4 <> 2 or n >= 1")
def rerank_contract_check(t):
    candidates = settle(rt.hybrid_order(_fused(t)[2], rt.candidate_limit(LIMIT)))
    q = F.col("query_id") % 4
    ranking = candidates.select("query_id", F.when((q == 1) & (F.col("fused_position") == 1), "unknown").otherwise(F.col("chunk_id")).alias("chunk_id"),
                                F.when((q == 3) & (F.col("fused_position") == 1), F.lit(float("nan"))).otherwise(F.col("vector_score")).alias("score"))
    repeated = ranking.unionByName(ranking.filter("query_id % 4 = 2"))
    return rt.checked_ranking(candidates, repeated)


@query("keyword_fallback", WITH + f"select query_id, chunk_id, file_id, chunk_index, round(1.0 / keyword_position, 6)::double as retrieval_score, 'keyword' as sources from kw where keyword_position <= {LIMIT}")
def keyword_fallback(t):
    return _rounded(rt.keyword_fallback(rt.keyword_retrieve(*inputs(t), rt.candidate_limit(LIMIT)), LIMIT))


FINAL_COLS = "query_id, chunk_id, file_id, chunk_index, round(keyword_score, 6) as keyword_score, round(vector_score, 6) as vector_score, round(combined_score, 6) as combined_score, round(score, 6) as retrieval_score, 'hybrid' as mode, final_position"


@query("hybrid_retrieve", WITH + f"select {FINAL_COLS} from final")
def hybrid_retrieve(t):
    return _rounded(rt.hybrid_retrieve(*inputs(t), LIMIT)).withColumn("final_position", F.col("final_position").cast("bigint"))
