"""Registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.llm import (alignment, chat, decontaminate, linededup, mixing, neardup, packing, privacy, revisits, syncmers, toxicity,
                          urlfilter, whitening)
from gleanery.llm.words import small_batches
from gleanery.operators.storage import settle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.span_report(privacy.find_spans(_table(spark, sf_dir, "documents")))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.near_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "class_id", "group_id", "group_size")


#: WARC records around the pages: a capture and a later not-modified visit of each page, and of each page's host a visit of
#: its front page, which is a full response for every third page. The second half of a visit's validator may be out of date.
RECORDS_SQL = """
select 3 * page_id as record_id, 'response' as record_type, url as target_uri, 10 * page_id as warc_date,
       md5(html) as etag, cast(length(html) as string) as size, html as payload from {pages}
union all
select 3 * page_id + 1, 'revisit', concat(url, '#again'), 10 * page_id + 5 + 7 * (page_id % 11),
       case when page_id % 5 = 0 then 'stale' when page_id % 7 = 0 then null else concat('W/', md5(html)) end, '0', null from {pages}
union all
select 3 * page_id + 2, case when page_id % 3 = 0 then 'response' else 'revisit' end,
       concat(substring_index(url, '/', 3), '/?utm_source=crawl'), 10 * page_id + 3, cast(page_id % 2 as string),
       case when page_id % 3 = 0 then cast(length(url) as string) else '0' end, case when page_id % 3 = 0 then url end from {pages}
"""


def warc_records(pages: DataFrame) -> DataFrame:
    rows = pages.sparkSession.sql(RECORDS_SQL, pages=pages)
    headers = F.map_from_arrays(F.array(*map(F.lit, ("content-length", "date", "etag", "server"))),
                                F.array("size", F.col("warc_date").cast("string"), "etag", F.col("record_type")))
    return rows.select("record_id", "record_type", "target_uri", "warc_date",
                       F.map_filter(headers, lambda _, v: v.isNotNull()).alias("headers"), "payload")


def revisits_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(warc_records(_table(spark, sf_dir, "pages")))
    return found.select("record_id", "uri", "response_id", "status", revisits.header_lines("headers").alias("headers"), "digest")


REVISITS_SQL = r"""
with records as (
  select 3 * page_id as record_id, 'response' as record_type, url as target_uri, 10 * page_id as warc_date,
         md5(html) as etag, cast(length(html) as varchar) as size, html as payload from pages
  union all
  select 3 * page_id + 1, 'revisit', url || '#again', 10 * page_id + 5 + 7 * (page_id % 11),
         case when page_id % 5 = 0 then 'stale' when page_id % 7 = 0 then null else 'W/' || md5(html) end, '0', null from pages
  union all
  select 3 * page_id + 2, case when page_id % 3 = 0 then 'response' else 'revisit' end,
         array_to_string(string_split(url, '/')[1:3], '/') || '/?utm_source=crawl', 10 * page_id + 3, cast(page_id % 2 as varchar),
         case when page_id % 3 = 0 then cast(length(url) as varchar) else '0' end, case when page_id % 3 = 0 then url end from pages),
cut as (select *, regexp_replace(regexp_replace(target_uri, '#(.|\n)*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest from records),
parts as (select *, regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':(80|443)$', '') as host,
                 regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
                 array_to_string(list_filter(string_split(regexp_extract(rest, '\?((.|\n)*)$', 1), '&'),
                                             lambda p: p <> '' and not starts_with(p, 'utm_')), '&') as query from cut),
named as (select *, host || path || case when query <> '' then '?' || query else '' end as uri from parts),
met as (select *, last_value(case when record_type = 'response' then record_id end ignore nulls) over (
          partition by uri order by warc_date, record_id rows between unbounded preceding and 1 preceding) as response_id from named),
judged as (
  select m.record_id, m.uri, m.response_id, m.warc_date, m.etag, m.size, r.size as stored_size, r.etag as stored_etag, r.payload as stored,
         case when m.response_id is null then 'orphan' when m.etag is null or r.etag is null then 'unchecked'
              when regexp_replace(m.etag, '^W/', '') = r.etag then 'resolved' else 'changed' end as status
  from met m left join records r on r.record_id = m.response_id where m.record_type = 'revisit')
select record_id, uri, response_id, status,
       case when status in ('resolved', 'unchecked')
            then 'content-length: ' || stored_size || chr(10) || 'date: ' || warc_date || chr(10) || 'etag: ' || coalesce(etag, stored_etag) || chr(10) || 'server: response'
            else 'content-length: ' || size || chr(10) || 'date: ' || warc_date || chr(10) || coalesce('etag: ' || etag || chr(10), '') || 'server: revisit' end as headers,
       case when status in ('resolved', 'unchecked') then sha256(stored) end as digest
from judged
"""


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = settle(mixing.mix(docs))
    return mixing.taken_words(mixed, mixing.shard_texts(docs, mixed))


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def repaired_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.repair_roles(_table(spark, sf_dir, "conversations"))
    return turns.select("conv_id", "turn", "role", "new_role", "action", "empty_before", "empty_after", F.sha2("rendered", 256).alias("rendered_sha256"))


def anchor_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(_table(spark, sf_dir, "documents"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


REPEATED_LINES_SQL = r"""
with lines as (
  select doc_id, n, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n from documents)),
counted as (select key, max(doc_id) as keeper from lines where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (select doc_id, n, line, keeper is not null and keeper <> doc_id as gone from lines left join counted using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by n) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""

def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def aligned_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_private_spans": private_spans,
    "op2_near_duplicates": near_duplicates,
    "op3_revisits_resolved": revisits_resolved,
    "op4_mixed_sources": mixed_sources,
    "op5_toxic_scores": toxic_scores,
    "op6_url_verdicts": url_verdicts,
    "op7_benchmark_leaks": benchmark_leaks,
    "op8_repaired_chats": repaired_chats,
    "op9_repeated_lines": repeated_lines,
    "op10_anchor_fingerprints": anchor_fingerprints,
    "op11_packed_documents": packed_documents,
    "op12_aligned_tokenizers": aligned_tokenizers,
    "op13_whitened_embeddings": whitened_embeddings,
}
SQL = {"op3_revisits_resolved": REVISITS_SQL, "op9_repeated_lines": REPEATED_LINES_SQL}
