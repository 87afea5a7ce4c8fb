"""Entity linking, conflicts, profiles, lookups and table quality."""

from pyspark.sql import functions as F

from gleanery.operators import entities as en
from gleanery.operators import quality as dq
from gleanery.operators.profile import field_profile, inferred_types, key_candidates, long_cells
from gleanery.operators.ranking import top_n
from gleanery.operators.storage import settle
from gleanery.plans.fixtures import PEOPLE
from gleanery.plans.registry import Catalog

CATALOG = Catalog()
query = CATALOG.query

# wide sources per workspace (nation), with planted disagreement, repeats and gaps
SOURCES = {
    "roster": ("""select c_nationkey as workspace, c_custkey + 2 as row_number, concat('S', cast(c_custkey as string)) as student_id,
        c_name as name, concat('NATION_', cast(c_nationkey as string)) as college, c_mktsegment as grade,
        cast(c_custkey % 3 as string) as class from {customer}""", ["student_id", "name", "college", "grade", "class"]),
    "awards": ("""select c_nationkey as workspace, c_custkey + 2 + 1000000000 * r.n as row_number, concat(' s', cast(c_custkey as string)) as student_id,
        case when c_custkey % 10 = 0 then concat(c_name, ' Jr') else upper(c_name) end as name,
        case when c_custkey % 14 = 0 then 'OTHER' else concat('NATION_', cast(c_nationkey as string)) end as college,
        case when c_custkey % 6 = 0 then 'call me' else concat('13', lpad(cast(c_custkey as string), 9, '0')) end as phone,
        case when c_custkey % 4 = 0 then concat('c', cast(c_custkey as string), '@x.org') else ' ' end as email
        from {customer} cross join (select 0 as n union all select 1) r where c_custkey % 2 = 0 and (r.n = 0 or c_custkey % 20 = 0)""",
               ["student_id", "name", "college", "phone", "email"]),
    "versions": ("""select c_nationkey as workspace, c_custkey * 2 + r.n as row_number, concat('S', cast(c_custkey as string)) as student_id,
        case when r.n = 0 then '2024-01-01' else '2024-02-01' end as date,
        case when r.n = 1 and c_custkey % 3 = 0 then 'MOVED' else c_mktsegment end as grade
        from {customer} cross join (select 0 as n union all select 1) r where c_custkey % 5 = 1""", ["student_id", "date", "grade"]),
    "contacts": ("""select c_nationkey as workspace, c_custkey + 2 as row_number, concat('C', cast(c_custkey as string), '@x.org') as email,
        concat('13', lpad(cast(c_custkey as string), 9, '0')) as phone from {customer} where c_custkey % 3 = 0""", ["email", "phone"]),
    "alumni": ("""select c_nationkey as workspace, c_custkey + 2 + 1000000000 * r.n as row_number, c_name as name,
        concat('NATION_', cast(c_nationkey as string)) as college, c_mktsegment as grade, cast(c_custkey % 3 as string) as class
        from {customer} cross join (select 0 as n union all select 1) r where c_custkey % 5 = 0 and (r.n = 0 or c_custkey % 25 = 0)""",
               ["name", "college", "grade", "class"]),
    "clubs": ("""select c_nationkey as workspace, c_custkey + 2 as row_number, c_name as name,
        concat('NATION_', cast(c_nationkey as string)) as college from {customer} where c_custkey % 7 = 0 and c_nationkey % 5 = 4""",
              ["name", "college"]),
}
IDS = """select c_nationkey as workspace, case when c_custkey % 97 = 0 then concat('zz', cast(c_custkey as string))
    when c_custkey % 9 = 0 then concat(' c', cast(c_custkey as string), '@X.org ') else concat('S', cast(c_custkey as string)) end as entity_id
    from {customer}"""


def model(t):
    cells = None
    for name, (sql, fields) in SOURCES.items():
        part = en.source_cells(t.sql(sql), "workspace", name, {f: f for f in fields})
        cells = part if cells is None else cells.unionByName(part)
    cells = settle(cells)
    return t.sql(IDS), cells, en.source_profile(cells)


MODEL_SQL = "cells as (" + " union all ".join(
    f"select workspace, '{n}' as source, row_number, unnest([{', '.join(repr(f) for f in fs)}]) as cn, unnest([{', '.join(fs)}]) as value from ({sql}) x"
    for n, (sql, fs) in SOURCES.items()) + f"""),
ids as ({IDS}),
nc as (select *, lower(trim(value)) as norm from cells where value is not null and trim(value) <> ''),
prof as (select workspace, source, cn, count(*) as rc, count(case when value is null or trim(value) = '' then 1 end) as nulls,
   count(distinct nullif(trim(value), '')) as uniq from cells group by all),
rel as (select workspace, source, cn from prof where nulls = 0 and uniq = rc and cn in ('id_card', 'passport', 'email')),
prim as (select i.workspace, i.entity_id, n.source, n.row_number, 'student_id' as method from ids i join nc n on n.workspace = i.workspace and n.cn = 'student_id' and n.norm = lower(trim(i.entity_id))),
uni as (select i.workspace, i.entity_id, n.source, n.row_number, n.cn as method from ids i join nc n on n.workspace = i.workspace and n.norm = lower(trim(i.entity_id))
   join rel on rel.workspace = n.workspace and rel.source = n.source and rel.cn = n.cn where not exists (select 1 from prim p where p.workspace = i.workspace and p.entity_id = i.entity_id)),
links as (select * from prim union all select * from uni),
vals as (select l.workspace, l.entity_id, l.source, l.row_number, n.cn, n.norm, n.value from links l join nc n using (workspace, source, row_number)),
anch as (select workspace, entity_id, cn, min(norm) as norm, arg_max(value, source || lpad(row_number::varchar, 20, '0')) as value from vals group by all having count(distinct norm) = 1),
linked as (select distinct workspace, entity_id, source from links),
k1 as (select a.workspace, a.entity_id, n.source, n.row_number, a.cn as method, list_position(['id_card', 'passport', 'email'], a.cn) as r
   from anch a join nc n on n.workspace = a.workspace and n.cn = a.cn and n.norm = a.norm join rel on rel.workspace = n.workspace and rel.source = n.source and rel.cn = n.cn
   where (a.workspace, a.entity_id, n.source) not in (select (workspace, entity_id, source) from linked)),
k2 as (select * from k1 qualify r = min(r) over (partition by workspace, entity_id, source)),
wa as (select workspace, entity_id, max(case when cn = 'name' then norm end) as a, max(case when cn = 'college' then norm end) as b,
   max(case when cn = 'grade' then norm end) as c, max(case when cn = 'class' then norm end) as d from anch group by all),
wr as (select workspace, source, row_number, max(case when cn = 'name' then norm end) as a, max(case when cn = 'college' then norm end) as b,
   max(case when cn = 'grade' then norm end) as c, max(case when cn = 'class' then norm end) as d from nc group by all),
k3 as (select wa.workspace, wa.entity_id, wr.source, wr.row_number, 'name_college_grade_class' as method from wa join wr using (workspace, a, b, c, d)
   where (wa.workspace, wa.entity_id, wr.source) not in (select (workspace, entity_id, source) from linked)
     and (wa.workspace, wa.entity_id, wr.source) not in (select (workspace, entity_id, source) from k2)),
cand as (select *, count(*) over (partition by workspace, entity_id, source) as candidates from
   (select workspace, entity_id, source, row_number, method from k2 union all select * from k3)),
part as (select n.workspace, n.entity_id, p.source from (select workspace, entity_id from anch where cn = 'name') n
   join (select workspace, source from prof where cn in ('name', 'college', 'grade', 'class') group by all having count(*) < 4) p using (workspace)
   where (n.workspace, n.entity_id, p.source) not in (select (workspace, entity_id, source) from linked)
     and (n.workspace, n.entity_id, p.source) not in (select (workspace, entity_id, source) from cand)),
allinks as (select * from links union all select workspace, entity_id, source, row_number, method from cand where candidates = 1),
trouble as (select distinct workspace, entity_id from cand where candidates > 1 union select workspace, entity_id from part),
stat as (select i.workspace, i.entity_id, (select count(*) from allinks l where l.workspace = i.workspace and l.entity_id = i.entity_id) as records,
   (i.workspace, i.entity_id) in (select (workspace, entity_id) from trouble) as amb from ids i),
status as (select workspace, entity_id, records, case when records = 0 then 'not_found' when amb then 'ambiguous' else 'found' end as status from stat),
clear as (select l.* from allinks l join status s using (workspace, entity_id) where s.status = 'found'),
cv as (select l.workspace, l.entity_id, l.source, l.row_number, n.cn, n.norm, n.value from clear l join nc n using (workspace, source, row_number)),
conf as (
  select workspace, entity_id, case cn when 'name' then 'same_id_different_name' when 'college' then 'same_id_different_college' else 'same_field_different_value' end as conflict_type,
    case when cn in ('name', 'college') then 'error' else 'warning' end as severity, cn as field, count(distinct norm) as value_count
  from cv where cn <> 'student_id' group by workspace, entity_id, cn having count(distinct norm) > 1
  union all select workspace, entity_id, 'time_version_conflict', 'warning', 'date', count(distinct snap) from (
    select workspace, entity_id, source, row_number, bool_or(cn = 'date') as dated, string_agg(case when cn <> 'date' then cn || '=' || norm end, ';' order by cn) as snap
    from cv group by all) where dated group by workspace, entity_id having count(*) > 1 and count(distinct snap) > 1
  union all select workspace, entity_id, 'duplicate_record', 'error', source, count(*) from clear group by workspace, entity_id, source having count(*) > 1
  union all select workspace, entity_id, 'single_source_only', 'warning', min(source), 1 from clear group by workspace, entity_id having count(distinct source) = 1),
iss as (
  select workspace, entity_id, conflict_type as issue_type, severity, true as c from conf where conflict_type <> 'single_source_only'
  union all select workspace, entity_id, 'cross_file_count_mismatch', 'warning', false from (select workspace, entity_id, source, count(*) as n from clear group by all) group by workspace, entity_id having min(n) <> max(n)
  union all select workspace, entity_id, 'invalid_contact_format', 'error', false from cv where (cn = 'phone' and not regexp_full_match(trim(value), '\\+?\\d[\\d\\s-]{{5,19}}'))
     or (cn = 'email' and not regexp_full_match(trim(value), '[^\\s@]+@[^\\s@]+\\.[^\\s@]+'))),
final as (select s.workspace, s.entity_id, case when s.status <> 'found' then s.status when i.c then 'conflict' when i.e then 'invalid_data' else 'found' end as status, coalesce(i.n, 0) as issue_count
  from status s left join (select workspace, entity_id, count(*) as n, bool_or(c) as c, bool_or(severity = 'error') as e from iss group by all) i using (workspace, entity_id))
"""
WITH = "with " + MODEL_SQL


@query("entity_match_primary", WITH + "select * from prim")
def entity_match_primary(t):
    ids, cells, _ = model(t)
    return en.primary_links(ids, cells)


@query("entity_match_unique_fallback", WITH + "select * from uni")
def entity_match_unique_fallback(t):
    ids, cells, profile = model(t)
    return en.unique_links(ids, en.primary_links(ids, cells), cells, profile)


def _linked(t):
    ids, cells, profile = model(t)
    primary = en.primary_links(ids, cells)
    links = primary.unionByName(en.unique_links(ids, primary, cells, profile))
    return links, cells, profile


@query("consensus_values", WITH + "select * from anch")
def consensus_values(t):
    links, cells, _ = _linked(t)
    return en.consensus_values(links, cells).withColumnRenamed("canonical_name", "cn")


@query("entity_match_auxiliary", WITH + "select * from cand")
def entity_match_auxiliary(t):
    links, cells, profile = _linked(t)
    links = settle(links)
    return en.auxiliary_links(links, settle(en.consensus_values(links, cells)), cells, profile)


@query("entity_partial_key_issue", WITH + "select workspace, entity_id, source, 'PARTIAL_IDENTITY_KEYS' as reason from part")
def entity_partial_key_issue(t):
    links, cells, profile = _linked(t)
    links = settle(links)
    anchors = settle(en.consensus_values(links, cells))
    return en.partial_key_issues(links, anchors, en.auxiliary_links(links, anchors, cells, profile), profile)


@query("entity_conflicts", WITH + "select * from conf")
def entity_conflicts(t):
    ids, cells, profile = model(t)
    links, statuses = en.resolve_entities(ids, cells, profile)
    clear = statuses.filter("status = 'found'").select("workspace", "entity_id")
    return en.entity_conflicts(links.join(clear, ["workspace", "entity_id"], "left_semi"), cells)


@query("validate_entity", WITH + "select * from final")
def validate_entity(t):
    return en.validate_entities(*model(t))[1]


@query("quality_batch", WITH + """select workspace, entity_id as target_id, 'success' as status, 'quality ' || status || ', issues ' || issue_count as result_summary from final""")
def quality_batch(t):
    from gleanery.operators.batches import quality_items
    return quality_items(en.validate_entities(*model(t))[1])


@query("lookup_with_ambiguity", """
with keys as (select concat(' ', p_name, ' ') as lookup_key from {part} union select cast(p_partkey as varchar) from {part} union select 'none ' || p_type from {part}),
k as (select lookup_key, trim(lookup_key) as k from keys),
a as (select cast(p_partkey as varchar) as k, count(*) as n, min(p_partkey) as h from {part} group by 1), b as (select trim(p_name) as k, count(*) as n, min(p_partkey) as h from {part} group by 1)
select lookup_key, case when coalesce(a.n, b.n, 0) = 0 then 'not_found' when coalesce(a.n, b.n) = 1 then 'found' else 'ambiguous' end as status,
  coalesce(a.n, b.n, 0) as matches, case when coalesce(a.n, b.n) = 1 then coalesce(a.h, b.h) end as entity_id from k left join a using (k) left join b using (k)""")
def lookup_with_ambiguity(t):
    p = t.part
    keys = (p.select(F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("lookup_key"))
            .union(p.select(F.col("p_partkey").cast("string"))).union(p.select(F.concat(F.lit("none "), "p_type"))).distinct())
    return en.lookup(keys, p, "p_partkey", "p_name")


# people with score rows (orders) and fact rows (line items of their orders' keys)
def children(t):
    people = t.customer.select(F.col("c_custkey").alias("entity_id"), "c_name")
    scores = t.orders.filter("o_custkey % 7 <> 0").select(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("position"),
        F.when(F.col("o_custkey") % 31 == 0, "absent").otherwise((F.col("o_orderkey") % 101).cast("string")).alias("math"),
        (F.col("o_orderkey") % 89).cast("string").alias("english"), (F.col("o_orderkey") % 97).cast("string").alias("major_course"))
    facts = t.supplier.select((F.col("s_suppkey") * 3).alias("entity_id"), F.col("s_suppkey").alias("position"),
                              (F.col("s_suppkey") % 5).cast("string").alias("papers"), (F.col("s_suppkey") % 3).cast("string").alias("patents"),
                              (F.col("s_suppkey") % 4).cast("string").alias("competitions"))
    return people, scores, facts


METRICS, FACTS = ["math", "english", "major_course"], ["papers", "patents", "competitions"]


def profiles(t):
    return en.entity_profile(*children(t), METRICS, FACTS)


PROFILE_SQL = """
sc as (select o_custkey as entity_id, min(o_orderkey) as k from {orders} where o_custkey % 7 <> 0 group by 1),
prf as (select c_custkey as entity_id, c_name, case when c_custkey % 31 = 0 then null else (k % 101)::double end as math, (k % 89)::double as english, (k % 97)::double as major_course,
  (s_suppkey % 5)::double as papers, (s_suppkey % 3)::double as patents, (s_suppkey % 4)::double as competitions,
  case when k is null then 'no_record' when c_custkey % 31 = 0 then 'invalid_data' else 'found' end as score_status,
  case when s_suppkey is null then 'no_record' else 'found' end as fact_status,
  case when k is not null and c_custkey % 31 <> 0 then round((k % 101 + k % 89 + k % 97) / 3.0, 2) end as average
  from {customer} left join sc on c_custkey = sc.entity_id left join {supplier} on c_custkey = s_suppkey * 3)"""


@query("entity_profile", "with " + PROFILE_SQL + " select * from prf")
def entity_profile(t):
    return profiles(t)


@query("ranked_children_strict", """
select 'orphans' as part, count(*) as row_count from {orders} where o_custkey not in (select c_custkey from {customer} where c_custkey % 50 <> 1)
union all select 'joined', count(*) from {orders} join {customer} on o_custkey = c_custkey where c_custkey % 50 <> 1""")
def ranked_children_strict(t):
    parents = t.customer.filter("c_custkey % 50 <> 1").select(F.col("c_custkey").alias("entity_id"), "c_name")
    joined, orphans = en.ranked_children(t.orders.select(F.col("o_custkey").alias("entity_id"), "o_orderkey"), parents, "entity_id")
    n = F.count(F.lit(1)).alias("row_count")
    return orphans.agg(n).select(F.lit("orphans").alias("part"), "row_count").unionByName(
        joined.agg(n).select(F.lit("joined").alias("part"), "row_count"))


@query("pairwise_differences", "with " + PROFILE_SQL + """,
r as (select c_nationkey as comparison_id, entity_id, average, papers, row_number() over (partition by c_nationkey order by entity_id) as position
  from prf join {customer} on entity_id = c_custkey qualify position <= 5)
select a.comparison_id, a.entity_id as left_id, b.entity_id as right_id, round(a.average - b.average, 2) as average, round(a.papers - b.papers, 2) as papers
from r a join r b on a.comparison_id = b.comparison_id and a.position < b.position""")
def pairwise_differences(t):
    p = profiles(t).join(t.customer.select(F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").alias("comparison_id")), "entity_id")
    chosen = top_n(p.select("comparison_id", "entity_id", "average", "papers"), ["comparison_id"], [F.col("entity_id")], 5)
    return en.pairwise_differences(chosen, ["average", "papers"])


BATCH_SQL = "with " + PROFILE_SQL + """ select entity_id as target_id, case when score_status <> 'found' then 'failed' when average >= 50 then 'skipped' {0} else 'success' end as status,
  case when score_status = 'no_record' then 'SCORE_NO_RECORD' when score_status <> 'found' then 'INVALID_SCORE_DATA' end as error_code from prf"""


@query("below_threshold", BATCH_SQL.replace("{0}", ""))
def below_threshold(t):
    from gleanery.operators.batches import below_threshold as run
    return run(profiles(t), 50)


@query("below_threshold_without_facts", BATCH_SQL.replace("{0}", "when fact_status <> 'no_record' then 'skipped'"))
def below_threshold_without_facts(t):
    from gleanery.operators.batches import below_threshold as run
    return run(profiles(t), 50, without_facts=True)


@query("group_headcount", "select 'NATION_' || c_nationkey as target_id, 'success' as status, count(*) as headcount from {customer} group by c_nationkey")
def group_headcount(t):
    from gleanery.operators.batches import group_headcount as run
    return run(t.customer.select(F.concat(F.lit("NATION_"), "c_nationkey").alias("college")), "college")


PROFILE_COLS = ["person_id", "name", "college", "grade", "phone", "email", "score", "balance", "remark"]
LONG_SQL = f"p as ({PEOPLE}), long as (select unnest([{', '.join(repr(c) for c in PROFILE_COLS)}]) as source_name, unnest(range(1, {len(PROFILE_COLS) + 1})) as source_index, unnest([{', '.join(f'cast({c} as varchar)' for c in PROFILE_COLS)}]) as value from p)"


@query("field_profile", "with " + LONG_SQL + """
select source_name, source_index, count(*) as row_count, count(*) - count(nullif(trim(value), '')) as null_count,
  round((count(*) - count(nullif(trim(value), ''))) / count(*), 6) as null_ratio, count(*) > count(nullif(trim(value), '')) as nullable,
  count(distinct nullif(trim(value), '')) as unique_count,
  case when count(nullif(trim(value), '')) = 0 then 'empty' when source_name = 'balance' then 'number' else 'string' end as inferred_type
from long group by source_name, source_index""")
def field_profile_query(t):
    return field_profile(t.sql(PEOPLE).drop("row_number"))


KIND_SQL = """case when value is null or trim(value) = '' then 'empty' when lower(trim(value)) in ('true', 'false') then 'boolean'
  when regexp_full_match(trim(value), '[-+]?\\d+') then 'integer' when regexp_full_match(trim(value), '[-+]?(?:\\d+\\.\\d*|\\d*\\.\\d+)(?:[Ee][-+]?\\d+)?') then 'number' else 'string' end"""
TYPE_SQL = f"""types as (select source_name, list_distinct(list(kind) filter (kind <> 'empty')) as kinds from (select source_name, {KIND_SQL} as kind from long) group by 1),
typed as (select source_name, case when kinds is null or len(kinds) = 0 then 'empty' when list_has_all(['integer', 'number'], kinds) then case when list_contains(kinds, 'number') then 'number' else 'integer' end
  when len(kinds) = 1 then kinds[1] else 'mixed' end as inferred_type from types)"""


@query("inferred_type", f"with {LONG_SQL}, {TYPE_SQL} select source_name, inferred_type from typed")
def inferred_type(t):
    return inferred_types(long_cells(t.sql(PEOPLE).drop("row_number")))


@query("key_candidates", "with " + LONG_SQL + """, f as (select source_name, count(*) as n, count(nullif(trim(value), '')) as filled, count(distinct nullif(trim(value), '')) as u from long group by 1)
select source_name, 'possible_unique' as role from f where n >= 2 and filled = n and u = n union all select source_name, 'possible_name' from f where source_name = 'name'
union all select source_name, 'possible_sensitive' from f where source_name in ('name', 'email')""")
def key_candidates_query(t):
    return key_candidates(field_profile(t.sql(PEOPLE).drop("row_number"), semantics=True))


RENAMED = {"person_id": "学号", "college": "学院", "phone": "手机号"}


@query("validate_table", f"with {LONG_SQL}, {TYPE_SQL}," + """
f as (select source_name, count(*) as n, count(*) - count(nullif(trim(value), '')) as nulls,
   count(case when source_name = 'score' and trim(value) <> '' and (try_cast(trim(value) as double) is null or try_cast(trim(value) as double) not between 0 and 100) then 1 end) as bad_range,
   count(case when trim(value) <> '' and ((source_name = 'phone' and not regexp_full_match(trim(value), '\\+?\\d[\\d\\s-]{5,19}')) or (source_name = 'email' and not regexp_full_match(trim(value), '[^\\s@]+@[^\\s@]+\\.[^\\s@]+'))) then 1 end) as bad_contact
   from long group by 1),
d as (select source_name, count(*) as groups from (select source_name, lower(trim(value)) as v, count(*) as c from long where source_name in ('person_id', 'name') and trim(value) <> '' group by all having count(*) > 1) group by 1),
i as (select source_name, 'null_value' as issue_type, 'warning' as severity, nulls::varchar as detail from f where nulls > 0
  union all select source_name, 'high_missing_ratio', 'error', cast(round(nulls / n, 6) as varchar) from f where nulls / n >= 0.5
  union all select source_name, 'type_anomaly', 'warning', inferred_type from typed where inferred_type = 'mixed'
  union all select source_name, 'numeric_range_anomaly', 'error', null from f where bad_range > 0
  union all select source_name, 'invalid_contact_format', 'error', null from f where bad_contact > 0
  union all select source_name, case source_name when 'name' then 'duplicate_name' else 'duplicate_student_id' end, case source_name when 'name' then 'warning' else 'error' end, groups::varchar from d)
select 'people' as sheet, case source_name when 'person_id' then '学号' when 'college' then '学院' when 'phone' then '手机号' else source_name end as field, issue_type, severity, detail from i""")
def validate_table(t):
    df = t.sql(PEOPLE).drop("row_number")
    for old, new in RENAMED.items():
        df = df.withColumnRenamed(old, new)
    return dq.validate_table(df, "people")


@query("duplicate_records", """
select p_name, p_brand, count(*) over (partition by p_name, p_brand) as count, p_partkey as row_number from {part} qualify count > 1""")
def duplicate_records(t):
    return dq.duplicate_records(t.part.select("p_name", "p_brand", F.col("p_partkey").alias("row_number")), ["p_name", "p_brand"])


@query("schema_bound_rows", f"""
with p as ({PEOPLE}), h as (select * from p where row_number % 4 <> 0 union all select row_number, null, ' ', '', null, null, ' ', '', null, null from p where row_number % 4 = 0)
select row_number, person_id, name, score from h where coalesce(trim(person_id), '') <> '' or coalesce(trim(name), '') <> '' or coalesce(trim(score), '') <> ''""")
def schema_bound_rows(t):
    from gleanery.sources.tables import bind_schema
    raw = t.sql(PEOPLE)
    hole = F.col("row_number") % 4 == 0
    raw = raw.select("row_number", *[F.when(~hole, F.col(c)).otherwise(F.lit(" ") if c in ("name", "email") else F.lit(None)).alias(f"_c{i}")
                                     for i, c in enumerate(["person_id", "name", "score"])])
    return bind_schema(raw, {"person_id": 1, "name": 2, "score": 3}, required=["person_id"])[0]
