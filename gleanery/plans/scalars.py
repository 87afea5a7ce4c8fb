"""Scalar functions and predicates as projections over the driver tables."""

from pyspark.sql import functions as F

from gleanery.functions import conditions, ids, labels, policy, redact, routes, semantics, text, urls, usage
from gleanery.operators.chunks import block_chunks
from gleanery.operators.scope import metadata_value, scope_violations, scoped_files
from gleanery.plans.fixtures import NOTES, PEOPLE, POLICIES, REQUESTS
from gleanery.plans.registry import TABLES, Catalog

CATALOG = Catalog()
query = CATALOG.query

DOC_FIELDS = ("doc_id", "lang")


@query("norm_key", f"""
with p as ({PEOPLE}) select row_number, lower(coalesce(trim(name), '')) as name_key,
       lower(coalesce(trim(email), '')) as email_key from p""")
def norm_key(t):
    p = t.sql(PEOPLE)
    return p.select("row_number", text.norm_key(F.col("name")).alias("name_key"),
                    text.norm_key(F.col("email")).alias("email_key"))


# column names: real ones of the tables, with aliases planted by position
def _names(t):
    out = None
    for table in TABLES:
        df = getattr(t, table)
        rows = df.groupBy().agg(F.count(F.lit(1)).alias("table_rows")).select(
            F.lit(table).alias("table_name"), "table_rows", F.explode(F.array(*map(F.lit, df.columns))).alias("column_name"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("column_name", F.explode(F.array(
        F.col("column_name"), F.concat(F.lit(" （"), F.col("column_name"), F.lit("_）-"), F.lit("Date")),
        F.concat(F.substring("column_name", 1, 1), F.lit("_Student-ID")),
        F.regexp_replace("column_name", "^[a-z]+_", ""))))


_NAMES_SQL = """
with base as (select table_name, column_name from information_schema.columns
              where table_schema = 'main' and table_name in ({tables})),
rows as ({counts}),
n as (select table_name, unnest([column_name, ' （' || column_name || '_）-Date',
             substr(column_name, 1, 1) || '_Student-ID', regexp_replace(column_name, '^[a-z]+_', '')]) as column_name from base),
k as (select n.table_name, table_rows, column_name,
             lower(regexp_replace(column_name, '[\\s_\\-（）()]+', '', 'g')) as field_key from n join rows using (table_name))
""".format(tables=", ".join(f"'{t}'" for t in TABLES),
           counts=" union all ".join(f"select '{t}' as table_name, count(*) as table_rows from {t}" for t in TABLES))


@query("norm_field_name", _NAMES_SQL + "select table_name, table_rows, column_name, field_key from k")
def norm_field_name(t):
    return _names(t).withColumn("field_key", text.norm_field_name(F.col("column_name")))


@query("field_semantics", _NAMES_SQL + """
, s as (select *, case when field_key in ('编号','代码','类型','备注') then null
  when field_key in ('学号','学生学号','studentid') then 'student_id' when field_key in ('姓名','学生姓名','name') then 'name'
  when field_key in ('学院','所属院系') then 'college' when field_key in ('联系电话','移动电话','手机号','手机') then 'phone'
  when field_key in ('邮箱','email') then 'email' when field_key in ('年级','所在年级') then 'grade'
  when field_key in ('班级','所在班级') then 'class'
  when field_key in ('身份证','身份证号','idcard','nationalid') then 'id_card'
  when field_key in ('地址','家庭地址','住址','address') then 'address' when field_key in ('护照','护照号','passport') then 'passport'
  when field_key in ('银行卡','银行账号','bankaccount') then 'bank_account'
  when regexp_matches(field_key, '日期|时间|date|time') then 'date'
  when regexp_matches(field_key, '成绩|分数|score|平均分') then 'score' end as canonical_name from k)
select table_name, column_name, canonical_name, coalesce(canonical_name, 'unknown') as semantic_type,
  case when canonical_name is null then 0.0 when canonical_name = 'date' then 0.82 when canonical_name = 'score' then 0.84
       when canonical_name in ('id_card','address','passport','bank_account') then 0.96 else 0.99 end::double as mapping_confidence,
  coalesce(canonical_name in ('student_id','name','phone','email','id_card','address','passport','bank_account'), false) as sensitive
from s""")
def field_semantics(t):
    return _names(t).select("table_name", "column_name", *semantics.semantics_columns(F.col("column_name")))


PHONE_SQL = r"regexp_replace(regexp_replace({0}, '(^|[^0-9])(1[3-9][0-9])[0-9]{{4}}([0-9]{{4}})($|[^0-9])', '\1\2****\3\4', 'g'), '(^|[^0-9])(1[3-9][0-9])[0-9]{{4}}([0-9]{{4}})($|[^0-9])', '\1\2****\3\4', 'g')"
_MAIL = r"(^|[^A-Za-z0-9._%+-])([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{0,63}}@([A-Za-z0-9.-]+\.[A-Za-z]{{2,}})([^A-Za-z0-9.-]|$)"
EMAIL_SQL = r"regexp_replace(regexp_replace({0}, '" + _MAIL + r"', '\1\2***@\3\4', 'g'), '" + _MAIL + r"', '\1\2***@\3\4', 'g')"
_IDN = r"(^|[^0-9])([0-9]{{6}})[0-9]{{8}}([0-9]{{3}}[0-9Xx])($|[^0-9])"
ID_SQL = r"regexp_replace(regexp_replace({0}, '" + _IDN + r"', '\1\2********\3\4', 'g'), '" + _IDN + r"', '\1\2********\3\4', 'g')"
ADDRESS_SQL = r"regexp_replace({0}, '([一-鿿]{{2,}}(?:省|市|自治区|自治州|县|区))([一-鿿A-Za-z0-9号弄栋单元室路街道镇乡村]{{4,}})', '\1***', 'g')"


def _redaction(name, fn, sql):
    @query(name, f"with n as ({NOTES}) select doc_id, sha256({sql.format('text')}) as redacted_hash, "
                 f"substr({sql.format('text')}, 1, 120) as redacted_head from n")
    def run(t, fn=fn):
        out = fn(F.col("text"))
        return t.sql(NOTES).select("doc_id", out.alias("r")).select(
            "doc_id", F.sha2("r", 256).alias("redacted_hash"), F.substring("r", 1, 120).alias("redacted_head"))


_redaction("redact_phone", redact.redact_phone, PHONE_SQL)
_redaction("redact_email", redact.redact_email, EMAIL_SQL)
_redaction("redact_id_number", redact.redact_id_number, ID_SQL)
_redaction("redact_address", redact.redact_address, ADDRESS_SQL)

def _event_json(t):
    e = t.events
    return e.select("event_id", F.format_string(
        '{"phone": "13%09d", "email": "none", "k": %d, "inner": {"address": "a", "user_id": %d, '
        '"url": "http://h.example/p?token=abc&q=1#f"}}', "event_id", F.col("event_id") % 7, "user_id").alias("payload"))


@query("redact_by_key", """
select event_id, '{"phone": "13' || substr(lpad(event_id::varchar, 9, '0'), 1, 1) || '****' || right(lpad(event_id::varchar, 9, '0'), 4)
  || '", "email": "***", "k": ' || (event_id % 7) || ', "inner": {"address": "***", "user_id": ' || user_id
  || ', "url": "http://h.example/p?token=%2A%2A%2A&q=1"}}' as safe from {events}""")
def redact_by_key(t):
    return _event_json(t).select("event_id", redact.redact_by_key("payload").alias("safe"))


@query("bounded_json", """
select event_id, substr('{"phone": "13' || substr(lpad(event_id::varchar, 9, '0'), 1, 1) || '****' || right(lpad(event_id::varchar, 9, '0'), 4)
  || '", "email": "none", "k": ' || (event_id % 7) || ', "inner"', 1, 40) as summary from {events}""")
def bounded_json(t):
    return _event_json(t).select("event_id", redact.bounded_json(F.col("payload"), 40).alias("summary"))


@query("strip_hidden_keys", """
select event_id, '{"stage": "' || event_type || '", "m": {"k": ' || (event_id % 7) || '}, "l": [{"v": 1}]}' as metrics from {events}""")
def strip_hidden_keys(t):
    raw = F.format_string('{"stage": "%s", "Reasoning": "x", "m": {"k": %d, "thinking": {"a": 1}}, "l": [{"v": 1, "cot": 2}]}',
                          "event_type", F.col("event_id") % 7)
    return t.events.select("event_id", redact.strip_hidden_keys(raw).alias("metrics"))


LINKS = """
select page_id, case page_id % 7 when 1 then upper(url)
   when 2 then concat('https://Example.COM.:443?p=', cast(page_id as string)) when 3 then 'http://user:pw@example.com/'
   when 4 then 'http://example.com:8080/x' when 5 then 'ftp://example.com/x' when 6 then concat('http://example.com:443/x', cast(page_id as string))
   else url end as url from {pages}
"""


@query("redact_url", """
select page_id, regexp_replace(regexp_replace(url, '#.*$', '') || case when contains(regexp_replace(url, '#.*$', ''), '?') then '&' else '?' end
  || 'Token=abc&mail=a@b.example.com', '(Token=)[^&]*', '\\1%2A%2A%2A') as safe_url_raw,
  regexp_replace(regexp_replace(regexp_replace(url, '#.*$', '') || case when contains(regexp_replace(url, '#.*$', ''), '?') then '&' else '?' end
  || 'Token=abc&mail=a@b.example.com', '(Token=)[^&]*', '\\1%2A%2A%2A'), 'mail=a@b.example.com', 'mail=a%2A%2A%2A%40b.example.com') as safe_url
from {pages}""".replace("page_id, regexp_replace(regexp_replace(url, '#.*$', '') || case when contains(regexp_replace(url, '#.*$', ''), '?') then '&' else '?' end\n  || 'Token=abc&mail=a@b.example.com', '(Token=)[^&]*', '\\1%2A%2A%2A') as safe_url_raw,\n ", "page_id,"))
def redact_url(t):
    bare = F.regexp_replace("url", "#.*$", "")
    raw = F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), F.lit("Token=abc&mail=a@b.example.com#frag"))
    return t.pages.select("page_id", redact.redact_url(raw).alias("safe_url"))


@query("canonical_url", f"""
with l as ({LINKS}), p as (select *, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) as scheme,
  regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) as auth, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1), '^(\\?|$)', '/\\1') as rest from l),
q as (select *, regexp_replace(lower(regexp_extract(auth, '^([^:]*)', 1)), '\\.+$', '') as host, regexp_extract(auth, ':([0-9]+)$', 1) as port from p)
select page_id, case when scheme in ('http','https') and not contains(auth, '@') and port in ('', '80', '443')
  then scheme || '://' || host || case when port <> '' and port <> case scheme when 'https' then '443' else '80' end then ':' || port else '' end || rest end as url
from q""")
def canonical_url(t):
    return t.sql(LINKS).select("page_id", urls.canonical_url(F.col("url")).alias("url"))


@query("stable_evidence_id", """
select n_nationkey, substr(sha256('{"name": "' || n_name || '", "note": null, "region": ' || n_regionkey || '}'), 1, 24) as evidence_id
from {nation}""")
def stable_evidence_id(t):
    return t.nation.select("n_nationkey", ids.evidence_id({
        "region": ids.json_number(F.col("n_regionkey")), "name": ids.json_text(F.col("n_name")),
        "note": ids.json_text(F.lit(None))}).alias("evidence_id"))


BLOCK_SQL = """substr(sha256('{"bbox": null, "block_type": "paragraph", "content": ' || to_json(text)::varchar || ', "file_id": "doc-' || doc_id
  || '", "page_no": null, "parent_id": null, "sequence": 0, "source_parser": "v5-text-parser"}'), 1, 32)"""


@query("stable_block_chunk_ids", f"""
with b as (select doc_id, text, {BLOCK_SQL} as block_id, unnest(range(0, greatest(ceil(length(text) / 800.0)::bigint, 1))) as chunk_index from {{documents}})
select doc_id, block_id, chunk_index, substr(sha256(block_id || ':' || chunk_index || ':' || sha256(substr(text, chunk_index * 800 + 1, 900))), 1, 32) as chunk_id,
       substr(sha256('doc-' || doc_id || ':cell:' || chunk_index || ':2'), 1, 32) as cell_id from b""")
def stable_block_chunk_ids(t):
    """The ids of every chunk of every document."""
    none = F.lit(None)
    d = t.documents.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id")).alias("file_id"), F.col("text").alias("content"))
    d = d.withColumn("block_id", ids.block_id(F.col("file_id"), F.lit(0), F.lit("paragraph"), F.col("content"),
                                              none, none, F.lit("v5-text-parser")))
    parts = block_chunks(d, ["doc_id", "file_id", "block_id"])
    return parts.select("doc_id", "block_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
                        ids.chunk_id(F.col("block_id"), F.col("chunk_index"), ids.text_hash(F.col("chunk_text"))).alias("chunk_id"),
                        ids.cell_id(F.col("file_id"), F.col("chunk_index"), F.lit(2)).alias("cell_id"))


@query("text_hash", "select doc_id, sha256(text) as text_hash from {documents}")
def text_hash(t):
    return t.documents.select("doc_id", ids.text_hash(F.col("text")).alias("text_hash"))


TOKENS_SQL = """
tok as (select doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+') as words,
        regexp_extract_all(text, '[一-鿿]') as cjk from n),
tl as (select doc_id, list_concat(list_concat(words, cjk), case when len(cjk) > 1 then
        list_transform(range(1, len(cjk)), lambda i: cjk[i] || cjk[i + 1]) else [] end) as tokens from tok)"""


@query("search_tokens", f"""
with n as ({NOTES}), {TOKENS_SQL}
select doc_id, len(tokens) as token_count, sha256(array_to_string(tokens, ' ')) as token_hash from tl""")
def search_tokens(t):
    tokens = text.search_tokens(F.col("text"))
    return t.sql(NOTES).select("doc_id", tokens.alias("x")).select(
        "doc_id", F.size("x").cast("bigint").alias("token_count"), F.sha2(F.array_join("x", " "), 256).alias("token_hash"))


@query("term_set", """
select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+|[一-鿿]'))), ' ') as terms
from {documents}""")
def term_set(t):
    return t.documents.select("doc_id", F.array_join(F.array_sort(text.term_set(F.col("text"))), " ").alias("terms"))


@query("hash_embedding", f"""
with n as ({NOTES}), {TOKENS_SQL},
b as (select doc_id, ('0x' || substr(sha256(token), 1, 8))::bigint % 2048 as bucket, count(*) as c
      from (select doc_id, unnest(tokens) as token from tl) group by all)
select doc_id, bucket, round(c / sqrt(sum(c * c) over (partition by doc_id)), 8) as weight from b""")
def hash_embedding(t):
    from gleanery.operators.vectors import hash_vectors
    return hash_vectors(t.sql(NOTES), "doc_id", "text").select(
        "doc_id", "bucket", F.round("weight", 8).alias("weight"))


@query("cosine", """
with e as (select vec_id, embedding::double[] as v from {embeddings})
select a.vec_id, b.vec_id as next_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))
  / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x)))), 8) as cosine
from e a join e b on b.vec_id = a.vec_id + 1""")
def cosine(t):
    from gleanery.operators.retrieval import cosine as cosine_of
    e = t.embeddings
    a = e.select("vec_id", F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", "next_id", F.round(cosine_of(F.col("a"), F.col("b")), 8).alias("cosine"))


@query("excerpt", """
with c as (select doc_id, trim(regexp_replace(text, '[\\s\\pZ]+', ' ', 'g')) as flat, replace(lower(trim(substr(split_part(text, ' ', 30), 1, 20), chr(10) || ' ')), 'ß', 'ss') as q from {documents}),
s as (select *, greatest(0, strpos(replace(lower(flat), 'ß', 'ss'), q) - 1 - 80) as start from c)
select doc_id, case when start > 0 then '…' else '' end || substr(flat, start + 1, 240) || case when start + 240 < length(flat) then '…' else '' end as excerpt
from s""")
def excerpt(t):
    q = F.substring(F.element_at(F.concat(F.split("text", " "), F.array_repeat(F.lit(""), 30)), 30), 1, 20)
    return t.documents.select("doc_id", text.excerpt(F.col("text"), q).alias("excerpt"))


@query("claim_normal", """
select item_id, replace(lower(regexp_replace(regexp_replace(text, '[\\s\\pZ]+', '', 'g'), '^[。.!！?？;；]+|[。.!！?？;；]+$', '', 'g')), 'ß', 'ss') as claim
from {benchmark}""")
def claim_normal(t):
    return t.benchmark.select("item_id", text.claim_normal(F.col("text")).alias("claim"))


CLAIMS_SQL = """
parts as (select conv_id, turn, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\\.[\\s\\pZ]+', '.' || chr(1), 'g'),
   '[。！？!?；;\\n\\x01]+'), lambda x: regexp_replace(x, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')),
   lambda x: x <> '' and not regexp_full_match(x, '#{{1,6}}\\s+[^\\n]+|[|\\s:\\-]+')) as claims from {conversations}),
claims as (select conv_id, turn, unnest(range(1, len(claims) + 1)) as claim_no, unnest(claims) as claim from parts)"""


@query("split_claims", "with " + CLAIMS_SQL.replace("{{", "{").replace("}}", "}") + " select conv_id, turn, claim_no, claim from claims")
def split_claims(t):
    return t.conversations.select("conv_id", "turn", F.posexplode(text.split_claims(F.col("text"))).alias("p", "claim")
                                  ).select("conv_id", "turn", (F.col("p") + 1).cast("bigint").alias("claim_no"), "claim")


VALUES_CASE = """case o_orderkey % 6 when 0 then ' 1.50 ' when 1 then concat(cast(o_custkey as string), '.000')
  when 2 then 'about ten' when 3 then '' when 4 then cast(o_custkey as string) else null end"""


@query("value_key", f"""
with v as (select o_orderkey, {VALUES_CASE} as raw from {{orders}})
select o_orderkey, case when raw is null or trim(raw) = '' then null
  when try_cast(trim(raw) as decimal(38, 18)) is not null then 'number:' || regexp_replace(regexp_replace(trim(raw), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')
  else 'text:' || trim(raw) end as value_key from v""")
def value_key(t):
    return t.sql(f"select o_orderkey, {VALUES_CASE} as raw from {{orders}}").select(
        "o_orderkey", text.value_key(F.col("raw")).alias("value_key"))


STAMP_CASE = """case event_id % 5 when 0 then '2024-01-01' when 1 then '2024-01-01T10:00:00Z' when 2 then 'yesterday'
  when 3 then concat('2024-13-0', cast(event_id % 9 as string)) else '' end"""


@query("is_timestamp", f"select event_id, {STAMP_CASE} as raw, event_id % 5 in (0, 1) as is_timestamp from {{events}}")
def is_timestamp(t):
    return t.sql(f"select event_id, {STAMP_CASE} as raw from {{events}}").withColumn(
        "is_timestamp", text.is_timestamp(F.col("raw")))


@query("duration_ms", """
select l_orderkey, l_partkey, l_suppkey, greatest(0, epoch_ms(l_shipdate) - epoch_ms(timestamp '1998-01-01 00:00:00.5'))::bigint as duration_ms
from {lineitem}""")
def duration_ms(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", text.duration_ms(
        F.lit("1998-01-01 00:00:00.5").cast("timestamp_ntz"), F.col("l_shipdate")).alias("duration_ms"))


def _re(pattern):
    return pattern.replace("'", "''")


@query("injection_labels_web", f"with n as ({NOTES}) select doc_id, concat_ws(',', " + ", ".join(
    f"case when regexp_matches(text, '(?i){_re(p)}') then '{c}' end" for c, p in labels.WEB_PATTERNS) + ") as labels from n")
def injection_labels_web(t):
    return t.sql(NOTES).select("doc_id", F.array_join(labels.injection_labels_web(F.col("text")), ",").alias("labels"))


@query("injection_labels_visual", f"with n as ({NOTES}), l as (select doc_id, concat_ws(',', " + ", ".join(
    f"case when regexp_matches(text, '(?i){_re(p)}') then '{c}' end" for c, p in labels.VISUAL_PATTERNS)
    + ") as labels from n) select doc_id, labels, labels <> '' or doc_id % 11 = 0 or doc_id % 100 < 70 as review from l")
def injection_labels_visual(t):
    body = F.col("text")
    return t.sql(NOTES).select(
        "doc_id", F.array_join(labels.injection_labels_visual(body), ",").alias("labels"),
        labels.visual_review(body, (F.col("doc_id") % 100) / 100, F.col("doc_id") % 11 == 0).alias("review"))


@query("contact_valid", f"""
with p as ({PEOPLE}) select row_number, regexp_full_match(trim(phone), '\\+?\\d[\\d\\s-]{{5,19}}') as phone_ok,
       regexp_full_match(trim(email), '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') as email_ok from p""".replace("{5,19}", "{5,19}"))
def contact_valid(t):
    from gleanery.operators.quality import contact_valid as valid
    return t.sql(PEOPLE).select("row_number", valid("phone", F.col("phone")).alias("phone_ok"),
                                valid("email", F.col("email")).alias("email_ok"))


@query("rule_extract_threshold", f"""
with p as ({POLICIES}), s as (select policy_id, case when contains(text, '一等奖学金') then
   '一等奖学金' || regexp_extract(text, '一等奖学金((?:.|\\n)*?)(?:(?:特|一|二|三)等奖学金|$)', 1) else '' end as section from p),
r as (select policy_id, contains(section, '或') as ambiguous, 'average_score' as field, '>=' as operator,
   unnest(list_concat(regexp_extract_all(section, '(?i)(?:平均成绩|平均分|average(?:_score)?)\\s*(?:不低于|不少于|至少|达到|>=|≥)\\s*(\\d+(?:\\.\\d+)?)', 1),
          regexp_extract_all(section, '(?i)(?:平均成绩|平均分|average(?:_score)?)\\s*(\\d+(?:\\.\\d+)?)\\s*(?:分|项|名)?以上', 1))) as threshold from s
  union all select policy_id, contains(section, '或'), 'rank', '<=', unnest(regexp_extract_all(section, '(?i)(?:专业排名|排名|rank)\\s*(?:不超过|不高于|至多|<=|≤|(?:在|位于)?前)\\s*(\\d+(?:\\.\\d+)?)', 1)) from s
  union all select policy_id, contains(section, '或'), 'papers', '>=', unnest(regexp_extract_all(section, '(?i)(?:论文数|论文数量|papers?)\\s*(?:不低于|不少于|至少|达到|>=|≥)\\s*(\\d+(?:\\.\\d+)?)', 1)) from s
  union all select policy_id, contains(section, '或'), 'research_total', '>=', unnest(regexp_extract_all(section, '(?i)(?:科研成果总数|科研成果|research)\\s*(?:不低于|不少于|至少|达到|>=|≥)\\s*(\\d+(?:\\.\\d+)?)', 1)) from s)
select policy_id, field, operator, threshold::double as threshold, ambiguous from r""")
def rule_extract_threshold(t):
    section = policy.award_section(F.col("text"), F.lit("一等奖学金"))
    return (t.sql(POLICIES).select("policy_id", section.alias("section"))
            .select("policy_id", policy.has_choice(F.col("section")).alias("ambiguous"),
                    F.explode(policy.threshold_rules(F.col("section"))).alias("r"))
            .select("policy_id", "r.field", "r.operator", "r.threshold", "ambiguous"))


@query("rule_extract_budget", f"""
with p as ({POLICIES}), m as (select policy_id, regexp_extract(text, '预算(?:金额)?\\s*(超过|高于|大于|不低于|不少于|至少|达到|不超过|低于|>=|<=|>|<|≥|≤)\\s*(\\d+(?:\\.\\d+)?)\\s*(万元|万|元)?', ['w', 'n', 'u']) as r from p)
select policy_id, case when r.w in ('超过','高于','大于','>') then '>' when r.w in ('不低于','不少于','至少','达到','>=','≥') then '>='
  when r.w in ('不超过','<=','≤') then '<=' else '<' end as operator,
  r.n::double * case when r.u in ('万元','万') then 10000 else 1 end as threshold_yuan from m where r.w <> ''""")
def rule_extract_budget(t):
    return (t.sql(POLICIES).select("policy_id", policy.budget_rule(F.col("text")).alias("r"))
            .filter(F.col("r").isNotNull()).select("policy_id", "r.operator", "r.threshold_yuan"))


def _has(words):
    return "(" + " or ".join(f"contains(m, '{w}')" for w in words) + ")"


def _count(words):
    return "(" + " + ".join(f"contains(m, '{w}')::int" for w in words) + ")"


def _weight(words):
    return "(" + " + ".join(f"contains(m, '{w}')::int * {n}" for w, n in words.items()) + ")"


ROUTE_SQL = f"""
r as ({REQUESTS}), s as (select *, regexp_replace(message, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') as m from r),
u as (select *, regexp_extract_all(m, '{_re(routes.URL)}') as urls,
  regexp_matches(m, '{_re(routes.NETWORK_DENIAL)}') or regexp_matches(m, '{_re(routes.LOCAL_ONLY)}') as offline,
  {_has(routes.LOCAL_SIGNALS)} as l, {_has(routes.WEB_SIGNALS)} as w, {_has(routes.BOTH_SIGNALS)} as b from s),
v as (select *, case when offline then 'LOCAL' when len(urls) > 0 then 'DIRECT_URL' when b or (l and w) then 'BOTH' when w then 'WEB' else 'LOCAL' end as strategy,
  case when offline then 'EXPLICIT_LOCAL_ONLY_RESTRICTION' when len(urls) > 0 then 'EXPLICIT_DIRECT_URL' when b or (l and w) then 'EXPLICIT_LOCAL_AND_WEB_SIGNALS'
       when w then 'EXPLICIT_WEB_OR_FRESH_INFORMATION' when l then 'EXPLICIT_LOCAL_DOCUMENT_SIGNAL' else 'SAFE_LOCAL_DEFAULT' end as reason_code from u)"""


@query("source_route", f"""with {ROUTE_SQL} select request_id, strategy, reason_code,
  case when strategy = 'DIRECT_URL' then array_to_string(urls, ' ') else '' end as urls from v""")
def source_route(t):
    return t.sql(REQUESTS).select("request_id", routes.source_route(F.col("message")).alias("r")).select(
        "request_id", "r.strategy", "r.reason_code", F.array_join("r.urls", " ").alias("urls"))


@query("complexity_route", f"""with {ROUTE_SQL},
c as (select *, regexp_matches(m, '{routes.REPORT}') as report, regexp_matches(m, '{routes.BULK}') as bulk, {_count(routes.OPERATION_WORDS)} as ops from v),
d as (select *, 1 + ops + case when strategy = 'BOTH' then 2 else 0 end + case when bulk then 3 else 0 end as calls from c),
e as (select *, concat_ws(',', case when report then 'EXPLICIT_REPORT' end, case when bulk then 'BULK_INPUT' end, case when strategy = 'BOTH' then 'CROSS_SOURCE' end,
   case when calls >= 4 or (length(m) >= 500 and ops >= 2) then 'MULTI_STEP' end) as codes from d)
select request_id, codes <> '' as async_required, case when codes = '' then 'SIMPLE_REQUEST' else codes end as reason_codes, strategy, calls as predicted_calls from e""")
def complexity_route(t):
    return t.sql(REQUESTS).select("request_id", routes.complexity_route(F.col("message")).alias("r")).select(
        "request_id", "r.async_required", F.array_join("r.reason_codes", ",").alias("reason_codes"), "r.strategy", "r.predicted_calls")


_TT = {k: _count(v) for k, v in routes.TASK_SIGNALS.items()}


@query("domain_route", f"""with {ROUTE_SQL},
p as (select request_id, m, regexp_matches(m, '(?i)(^|[^A-Za-z0-9])S\\d{{2,}}($|[^A-Za-z0-9])') as by_id,
  {_weight(routes.PERSON_TERMS)} as pw, {_weight(routes.GENERAL_TERMS)} as gw, regexp_matches(m, '{routes.PERSON_REQUEST}') as person,
  {', '.join(f'{v} as t_{k}' for k, v in _TT.items())} from v),
q as (select *, pw + case when by_id then 6 else 0 end + case when person then 4 else 0 end as ps,
  t_compare + t_rule_check + t_summarize + t_query + t_write as others, greatest(t_compare, t_rule_check, t_summarize, t_query) as best from p),
d as (select *, case when ps = 0 and gw = 0 then 'unknown' when ps > 0 and gw > 0 and abs(ps - gw) <= 2 then 'unknown' when ps > gw then 'student' else 'general' end as domain from q)
select request_id, domain, case when domain = 'student' then 'student' else 'general' end as effective_domain,
  case when t_write > 0 then 'write' when t_workflow > 0 and others > 0 then 'workflow' when others + t_workflow = 0 then 'query'
       when t_rule_check = best then 'rule_check' when t_compare = best then 'compare' when t_summarize = best then 'summarize' else 'query' end as task_type,
  case when ps = 0 and gw = 0 then 'NO_DOMAIN_SIGNAL_GENERAL_FALLBACK' when domain = 'unknown' then 'AMBIGUOUS_DOMAIN_SIGNALS_GENERAL_FALLBACK'
       when domain = 'student' then case when by_id then 'STUDENT_STRUCTURAL_ID_SIGNAL' else 'STUDENT_SCHEMA_OR_TASK_SIGNAL' end
       else 'GENERAL_SCHEMA_OR_TASK_SIGNAL' end as reason_code from d""")
def domain_route(t):
    return t.sql(REQUESTS).select("request_id", routes.domain_route(F.col("message")).alias("r")).select("request_id", "r.*")


@query("usage_cost", """
select event_id, case when event_id % 3 = 2 then 0 else event_id % 1000 end as input_tokens, case when event_id % 3 = 2 then 0 else 50 end as output_tokens,
  case when event_id % 3 = 2 then 0 when event_id % 3 = 1 then greatest(event_id % 1000 + 50, 400) else event_id % 1000 + 50 end as total_tokens,
  case when event_id % 3 = 2 then 0.0 else round(((event_id % 1000) * 2.5 + 50 * 10.0) / 1000000, 10) end as cost_usd, event_id % 3 <> 2 as usage_available
from {events}""")
def usage_cost(t):
    n = F.col("event_id") % 1000
    raw = (F.when(F.col("event_id") % 3 == 0, F.format_string('{"prompt_tokens": %d, "completion_tokens": 50}', n))
           .when(F.col("event_id") % 3 == 1, F.format_string('{"input_tokens": %d, "output_tokens": 50, "total_tokens": 400}', n))
           .otherwise(F.lit("{}")))
    parsed = F.from_json(raw, usage.USAGE_SCHEMA)
    return t.events.select("event_id", usage.usage_cost(parsed, 2.5, 10.0).alias("u")).select(
        "event_id", "u.input_tokens", "u.output_tokens", "u.total_tokens", "u.cost_usd", "u.usage_available")


META = """
select doc_id, lang, source, concat('{"lang": "', lang, '", "document_metadata": {"source": "', source, '", "year": ',
  cast(2000 + doc_id % 25 as string), '}}') as metadata from {documents}
"""


@query("metadata_filter", f"""with m as ({META}) select doc_id from m
where coalesce(json_extract_string(metadata, '$.lang'), json_extract_string(metadata, '$.document_metadata.lang')) = 'en'
  and coalesce(json_extract_string(metadata, '$.year'), json_extract_string(metadata, '$.document_metadata.year')) = '2007'""")
def metadata_filter(t):
    return t.sql(META).filter((metadata_value(F.col("metadata"), "lang") == "en")
                              & (metadata_value(F.col("metadata"), "year") == "2007")).select("doc_id")


FILES = """
select doc_id as file_id, case when source in ('src0', 'src1', 'src2') then 'pdf' when source in ('src3', 'src4') then 'excel' else 'txt' end as file_type,
  case when doc_id % 17 = 0 then 'failed' else 'ready' end as lifecycle_status, case when doc_id % 19 = 0 then 'stale' else 'indexed' end as index_status,
  doc_id % 23 <> 0 as queryable, n_chars as size, 1 + doc_id % 3 as page_no from {documents}
"""


@query("scope_filter", f"""with f as ({FILES}) select file_id, page_no from f where lifecycle_status = 'ready' and index_status = 'indexed' and queryable
  and file_type = 'txt' and page_no = 2 and file_id in (select doc_id from {{labels}} where quality = 1)""")
def scope_filter(t):
    wanted = t.labels.filter("quality = 1").select(F.col("doc_id").alias("file_id"))
    return scoped_files(t.sql(FILES), wanted, file_type="txt", page_no=2).select("file_id", "page_no")


YEARS = """
select request_id, case request_id % 4 when 0 then concat(message, ' in 2021 and 2021') when 1 then concat('1999 or 2003 ', message)
   when 2 then concat('id 120210 ', message) else concat('2100年 ', message) end as q from ({requests}) r
"""


@query("query_year_constraint", f"""
with y as ({YEARS.replace('{requests}', REQUESTS)}), e as (select request_id, list_distinct(regexp_extract_all(regexp_replace(q, '([^0-9])', '\\1\\1', 'g'), '(?:^|[^0-9])((?:19|20)[0-9]{{2}}|2100)(?:$|[^0-9])', 1)) as years from y)
select request_id, case when len(years) = 1 then years[1]::int end as year from e""")
def query_year_constraint(t):
    return t.sql(YEARS.replace("{requests}", REQUESTS)).select("request_id", text.single_year(F.col("q")).alias("year"))


@query("structured_condition", """
with e as (select event_id, event_type, (props->>'$.k')::int as k from {events})
select event_id, k > 50 as gt, k >= 10 and k <= 20 as between_k, event_type in ('click', 'view') as in_list,
  event_type not in ('click', 'view') as not_in_list, event_id % 3 = 0 as has_note, event_type = 'error' as eq_type, k <> 7 as ne_k, false as missing_eq, k = 5 as item_eq from e""")
def structured_condition(t):
    C = conditions.Condition
    raw = F.concat(F.lit('{"m": '), F.col("props"), F.lit(', "kind": "'), F.col("event_type"), F.lit('", "tags": [{"v": '),
                   F.get_json_object("props", "$.k"), F.lit('}], "note": '),
                   F.when(F.col("event_id") % 3 == 0, F.lit('"n"')).otherwise(F.lit("null")), F.lit("}"))
    v = t.events.select("event_id", F.try_parse_json(raw).alias("v"))

    def test(*parts):
        out = F.lit(True)
        for p in parts:
            out = out & conditions.holds(F.col("v"), C(*p))
        return out

    return v.select(
        "event_id", test(("m.k", "gt", 50)).alias("gt"), test(("m.k", "gte", 10), ("m.k", "lte", 20)).alias("between_k"),
        test(("kind", "in", ["click", "view"])).alias("in_list"), test(("kind", "not_in", ["click", "view"])).alias("not_in_list"),
        test(("note", "exists")).alias("has_note"), test(("kind", "eq", "error")).alias("eq_type"),
        test(("m.k", "ne", 7)).alias("ne_k"), test(("m.absent", "eq", 1)).alias("missing_eq"),
        test(("tags.0.v", "eq", 5)).alias("item_eq"))


@query("like_escaped_search", """
with c as (select doc_id, unnest(range(0, greatest(ceil(length(text) / 800.0)::bigint, 1))) as i, text from {documents})
select doc_id, i as chunk_index from c where contains(lower(substr(text, i * 800 + 1, 900)), 'the on')""")
def like_escaped_search(t):
    from gleanery.operators.retrieval import like_search
    chunks = block_chunks(t.documents.select("doc_id", F.col("text").alias("content")), ["doc_id"])
    return like_search(chunks, "THE on").select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"))


NEEDS = """
select l_orderkey as need_id, l_partkey % 10 as file_no, l_linenumber as line_no, 1998 + l_suppkey % 3 as need_year from {lineitem}
"""


@query("scope_narrowing_check", f"""
with n as ({NEEDS}), o as (select o_orderkey as need_id, o_custkey % 10 as low, 1999 as scope_year from {{orders}})
select distinct need_id, 'file_ids' as scope_key, 'WIDER_THAN_SCOPE' as reason from n join o using (need_id) where file_no < low
union all select distinct need_id, 'year', 'DIFFERS_FROM_SCOPE' from n join o using (need_id) where need_year <> scope_year and line_no = 1""")
def scope_narrowing_check(t):
    needs = t.sql(NEEDS)
    bounds = t.orders.select(F.col("o_orderkey").alias("need_id"), (F.col("o_custkey") % 10).alias("low"))
    ids_asked = needs.select("need_id", F.col("file_no").alias("file_id"))
    ids_allowed = bounds.select("need_id", F.explode(F.sequence(F.col("low"), F.lit(9))).alias("file_id"))
    keys_asked = needs.filter("line_no = 1").select("need_id", F.lit("year").alias("scope_key"), F.col("need_year").cast("string").alias("value"))
    keys_allowed = bounds.select("need_id", F.lit("year").alias("scope_key"), F.lit("1999").alias("value"))
    return scope_violations(ids_asked, ids_allowed, keys_asked, keys_allowed)
