"""Rules over tables, information needs and bounded retrieval."""

from pyspark.sql import functions as F

from gleanery.functions.routes import source_route
from gleanery.operators import needs as nd
from gleanery.operators import rules as rl
from gleanery.operators.storage import settle
from gleanery.plans.documents import doc_chunks
from gleanery.plans.fixtures import POLICIES, REQUESTS
from gleanery.plans.registry import Catalog
from gleanery.plans.scalars import _count

CATALOG = Catalog()
query = CATALOG.query

AWARD = "一等奖学金"
VALUES = """
select o_custkey as entity_id, 'average_score' as field, cast(70 + o_custkey % 30 + case when o_custkey % 19 = 0 then o_orderkey % 2 else 0 end as string) as value from {orders} where o_custkey % 11 <> 0
union all select c_custkey, 'rank', cast(1 + c_custkey % 12 as string) from {customer} where c_custkey % 3 <> 0
union all select c_custkey, 'papers', case when c_custkey % 23 = 0 then 'none' else cast(c_custkey % 3 as string) end from {customer} where c_custkey % 7 <> 0
union all select c_custkey, 'patents', cast(c_custkey % 2 as string) from {customer} where c_custkey % 7 <> 0
union all select c_custkey, 'competitions', cast(c_custkey % 4 as string) from {customer} where c_custkey % 5 <> 0"""


@query("eligibility", f"""
with p as ({POLICIES}), v as ({VALUES}), s as (select policy_id, case when contains(text, '{AWARD}') then '{AWARD}' || regexp_extract(text, '{AWARD}((?:.|\\n)*?)(?:(?:特|一|二|三)等奖学金|$)', 1) else '' end as section from p),
r as (select policy_id, 'average_score' as field, '>=' as op, unnest(list_concat(regexp_extract_all(section, '(?:平均成绩|平均分)\\s*(?:不低于|至少)\\s*(\\d+)', 1), regexp_extract_all(section, '(?:平均成绩|平均分)\\s*(\\d+)\\s*分?以上', 1)))::double as th from s where not contains(section, '或')
  union all select policy_id, 'rank', '<=', unnest(regexp_extract_all(section, '专业排名\\s*前\\s*(\\d+)', 1))::double from s where not contains(section, '或')
  union all select policy_id, 'papers', '>=', unnest(regexp_extract_all(section, '论文数\\s*至少\\s*(\\d+)', 1))::double from s where not contains(section, '或')
  union all select policy_id, 'research_total', '>=', unnest(regexp_extract_all(section, '科研成果总数\\s*不少于\\s*(\\d+)', 1))::double from s where not contains(section, '或')),
b as (select entity_id, field, min(try_cast(value as double)) as lo, max(try_cast(value as double)) as hi from v where try_cast(value as double) is not null group by all),
x as (select entity_id, field, case when lo = hi then lo end as value, lo <> hi as clash from b union all select entity_id, 'research_total', sum(lo), false from b where field in ('papers', 'patents', 'competitions') group by 1 having count(*) = 3),
a as (select c_custkey as entity_id, c_custkey % (select count(*) from {{benchmark}}) as policy_id from {{customer}}),
tst as (select a.entity_id, a.policy_id, count(*) as conditions, count(case when value is null then 1 end) as unknown, count(case when (op = '>=' and value >= th) or (op = '<=' and value <= th) then 1 end) as passed
  from a join r using (policy_id) left join x on x.entity_id = a.entity_id and x.field = r.field group by all),
seen as (select entity_id, bool_or(field in ('average_score', 'rank')) as sc, bool_or(field in ('papers', 'patents', 'competitions')) as re from v group by 1), cl as (select entity_id, bool_or(clash) as clash from x group by 1),
j as (select a.*, conditions, unknown, passed, concat_ws(',', case when not coalesce(sc, false) then 'scores' end, case when not coalesce(re, false) then 'research' end, case when conditions is null then 'rules' end, case when clash then 'conflicting values' end,
  case when contains(section, '或') then 'ambiguous rules' end, case when unknown > 0 then 'field values' end) as missing from a left join tst using (entity_id, policy_id) left join seen using (entity_id) left join cl using (entity_id) left join s using (policy_id))
select entity_id, policy_id, coalesce(conditions, 0) as conditions, coalesce(passed, 0) as passed, case when missing <> '' then 'insufficient_evidence' when passed = conditions then 'eligible' else 'not_eligible' end as conclusion, missing from j""")
def eligibility(t):
    count = t.benchmark.agg(F.count(F.lit(1)).alias("n")).scalar()
    applications = t.customer.select(F.col("c_custkey").alias("entity_id"), count.alias("n")).select("entity_id", (F.col("entity_id") % F.col("n")).alias("policy_id"))
    return rl.eligibility(applications, t.sql(POLICIES), t.sql(VALUES), AWARD)


@query("threshold_approval", f"""with p as ({POLICIES}), f as (select policy_id, text from p where regexp_matches(text, '预算(?:金额)?\\s*(?:超过|不低于)\\s*\\d+') order by policy_id limit 1),
r as (select case when contains(text, '预算金额超过') then '>' else '>=' end as op, regexp_extract(text, '预算(?:金额)?\\s*(?:超过|不低于)\\s*(\\d+)', 1)::double * case when contains(text, '万元') then 10000 else 1 end as th from f)
select o_orderkey as project, o_totalprice as budget, op as operator, th as rule_threshold, case op when '>' then o_totalprice > th else o_totalprice >= th end as requires_special_approval, 'found' as status from {{orders}}, r where o_totalprice > 90000""")
def threshold_approval(t):
    rows = t.orders.select(F.col("o_orderkey").alias("project"), F.col("o_totalprice").alias("budget"))
    return rl.threshold_approval(rows, t.sql(POLICIES), 90000)


@query("need_decompose", f"""with r as ({REQUESTS}), m as (select request_id, regexp_replace(message, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') as m from r), s as (select *, {_count(nd.COMPLEX_SIGNALS)} as signals, regexp_split_to_array(m, '{nd.CLAUSE_MARK}') as raw from m),
c as (select *, list_filter(list_transform(raw, lambda x: regexp_replace(x, '^[ ，。]+|[ ，。]+$', '', 'g')), lambda x: x <> '') as cs, len(list_filter(raw, lambda x: trim(x) <> '')) as spoken from s where signals >= 1),
d as (select *, case when len(cs) = 1 then [m] else cs end as parts, nullif(regexp_extract(m, '(?:^|[^0-9])(20[0-9]{{2}})', 1), '') as year from c where spoken >= 2 or signals >= 2),
e as (select request_id, year, unnest(range(1, len(parts) + 1)) as need_no, unnest(parts) as clause from d)
select request_id, need_no, 'need-' || substr(sha256('general:' || need_no || ':' || clause || ':{{"file_id":null,"file_ids":null,"file_type":null,"page":null,"slide":null,"year":' || coalesce(year, 'null') || ',"student_id":null,"document_metadata":null}}'), 1, 12) as need_id,
  case when regexp_matches(clause, '规则|办法|资格|条件|审批') then 'rule' when regexp_matches(clause, '比较|对比|差异') then 'comparison' else 'general_fact' end as need_type, clause as name, clause as query, year::int as year from e""")
def need_decompose(t):
    return nd.need_decompose(t.sql(REQUESTS)).withColumn("need_no", F.col("need_no").cast("bigint"))


SUFF = """select l_orderkey as need_id, concat('e', cast(l_partkey % 50 as string)) as evidence_id, l_partkey * 10000000 + l_suppkey as position, concat('term', cast(l_linenumber as string), ' text') as text,
  case when l_suppkey % 4 = 0 then null else 0.5 + l_discount * 5 end as confidence, l_suppkey % 29 = 0 as review_required, l_partkey % 41 = 0 as conflict from {lineitem}"""


@query("need_sufficiency", f"""with e as (select * from ({SUFF}) x qualify row_number() over (partition by need_id, evidence_id order by position, text, confidence nulls first, review_required nulls first, conflict nulls first) = 1), l as (select *, review_required or coalesce(confidence < 0.7, false) as low from e),
n as (select o_orderkey as need_id, case when o_orderkey % 3 = 0 then [] else ['term1', 'term' || (1 + o_orderkey % 7)] end as terms, 1 + o_orderkey % 3 as minimum_evidence from {{orders}}),
g as (select need_id, count(*) as n, bool_or(conflict) as conflict, count(case when not low then 1 end) as safe, bool_or(low) as any_low from l group by 1),
sn as (select need_id, list(distinct split_part(text, ' ', 1)) as s from l where not low group by 1), k as (select n.need_id, list_filter(list_distinct(terms), lambda x: not list_contains(coalesce(s, []), x)) as lacking from n left join sn using (need_id)),
j as (select n.need_id, case when g.n is null then 'missing' when conflict then 'conflict' when safe >= minimum_evidence and len(lacking) = 0 then 'sufficient' when any_low then 'low_confidence' else 'partial' end as status, coalesce(g.n, 0) as evidence_count, lacking from n join k using (need_id) left join g using (need_id))
select need_id, status, evidence_count, case when status in ('conflict', 'sufficient') then '' else array_to_string(list_sort(lacking), ',') end as missing_terms from j""")
def need_sufficiency(t):
    terms = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.array(F.lit("term1"), F.concat(F.lit("term"), (1 + F.col("o_orderkey") % 7).cast("string")))))
    needs = t.orders.select(F.col("o_orderkey").alias("need_id"), terms.alias("required_terms"), (1 + F.col("o_orderkey") % 3).alias("minimum_evidence"))
    return nd.need_sufficiency(needs, t.sql(SUFF)).select("need_id", "status", "evidence_count", F.array_join(F.array_sort("missing_terms"), ",").alias("missing_terms"))


@query("query_rewrite", f"""with r as ({REQUESTS}), b as (select request_id, message, substr(message, 1, 20) as name, case when request_id % 2 = 0 then 'alpha beta' else '' end as extra from r),
c as (select *, trim(regexp_replace(message || ' 补充证据 ' || case when extra <> '' then extra else name end, '[\\s\\pZ]+', ' ', 'g')) as q2, trim(regexp_replace(message || ' 交叉核验 ' || message, '[\\s\\pZ]+', ' ', 'g')) as q3,
  regexp_replace(replace(replace(replace(replace(message, '评审办法', ''), '相关规定', ''), '实施办法', ''), '管理办法', ''), '^[ ，。；;：:]+|[ ，。；;：:]+$', '', 'g') as plain from b)
select request_id, q2 as round_2, q3 as round_3, null as round_4, case when plain <> '' and plain <> message then plain else '' end as retry from c""")
def query_rewrite(t):
    extra = F.when(F.col("request_id") % 2 == 0, F.array(F.lit("alpha"), F.lit("beta"))).otherwise(F.array().cast("array<string>"))
    m = F.col("message")
    form = lambda n: nd.rewrite(m, F.substring(m, 1, 20), m, n, extra)
    return t.sql(REQUESTS).select("request_id", form(2).alias("round_2"), form(3).alias("round_3"), form(4).alias("round_4"),
                                  F.array_join(nd.retry_queries(m), "|").alias("retry"))


def _needs(t):
    text = F.col("text")
    return t.benchmark.select(
        F.concat(F.lit("t"), (F.col("item_id") % 20).cast("string")).alias("task_id"), F.concat(F.lit("n"), "item_id").alias("need_id"), F.col("item_id").alias("need_no"),
        text.alias("query"), F.lit("passage").alias("name"), F.when(F.col("item_id") % 4 == 0, F.array(F.lit("zzqx"))).otherwise(F.array(F.substring("text", 5, 6))).alias("required_terms"),
        (1 + F.col("item_id") % 3).alias("minimum_evidence"))


@query("controlled_retrieval")
def controlled_retrieval(t):
    """Whole items are asked; the search of every eleventh fails."""
    failing = t.benchmark.filter("item_id % 11 = 3").select(F.concat(F.lit("n"), "item_id").alias("need_id"), F.lit("INDEX_NOT_READY").alias("error_code"),
                                                            (F.col("item_id") % 2 == 0).alias("called"))
    return nd.controlled_retrieval(settle(_needs(t)), settle(doc_chunks(t)), failures=failing)[0]


@query("cross_source_retrieval")
def cross_source_retrieval(t):
    local = doc_chunks(t).withColumn("source", F.lit("LOCAL")).select("chunk_id", "file_id", "chunk_index", "chunk_text", "source")
    body = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]+>", " ")
    web = t.pages.select(F.concat(F.lit("page-"), "page_id").alias("chunk_id"), F.col("url").alias("file_id"), F.lit(0).cast("bigint").alias("chunk_index"),
                         body.alias("chunk_text"), F.lit("WEB").alias("source"))
    route = F.array(F.lit("LOCAL"), F.lit("WEB"), F.lit("BOTH"))
    asks = t.benchmark.select(
        F.concat(F.lit("x"), "item_id").alias("task_id"), F.col("text").alias("query"), F.get(route, (F.col("item_id") % 3).cast("int")).alias("strategy"),
        F.when(F.col("item_id") % 5 == 0, F.array(F.lit("zzqx"))).otherwise(F.array().cast("array<string>")).alias("required_terms"), (1 + F.col("item_id") % 4).alias("minimum_evidence"))
    direct = t.pages.filter(source_route(F.col("url"))["strategy"] == "DIRECT_URL").select(
        F.concat(F.lit("u"), "page_id").alias("task_id"), F.col("url").alias("query"), F.lit("DIRECT_URL").alias("strategy"), F.array().cast("array<string>").alias("required_terms"), F.lit(1).cast("bigint").alias("minimum_evidence"))
    return nd.cross_source_retrieval(settle(asks.unionByName(direct)), settle(local.unionByName(web)))[0]
