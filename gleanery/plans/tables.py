"""Table queries: project, filter, order, limit, aggregate."""

from pyspark.sql import functions as F

from gleanery.operators.ranking import position_in_group
from gleanery.operators.table import (
    Aggregate, ArgumentError, Filter, Order, TableQuery, aggregate_lineage, aggregate_status,
    aggregate_table, apply_filters, check_fields, missing_fields, order_keys, query_table,
    query_warnings)
from gleanery.plans.fixtures import PEOPLE
from gleanery.plans.registry import Catalog

CATALOG = Catalog()
query = CATALOG.query


def people(t):
    return t.sql(PEOPLE)


@query("project_fields", """
select o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as o_orderdate
from {orders}""")
def project_fields(t):
    return query_table(t.orders, TableQuery(["o_orderkey", "o_orderpriority", "o_orderdate"]), "o_orderkey")


@query("missing_fields_report", """
select m.field as missing_field, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' as available_fields,
       count(*) as table_rows
from {customer}, (values ('c_phone'), ('c_rank')) m(field) group by m.field""")
def missing_fields_report(t):
    df = t.customer
    asked = ["c_custkey", "c_phone", "c_rank", "c_phone"]
    absent = missing_fields(df, asked)
    try:
        check_fields(df, asked)
    except ArgumentError as error:
        assert error.code == "FIELD_NOT_FOUND"
    return (df.agg(F.count(F.lit(1)).alias("table_rows"))
            .select(F.explode(F.array(*map(F.lit, absent))).alias("missing_field"),
                    F.lit(",".join(df.columns)).alias("available_fields"), "table_rows"))


@query("sensitive_projection_warning", f"""
with p as ({PEOPLE})
select 'SENSITIVE_FIELD' as code, 'name' as detail union all
select 'SENSITIVE_FIELD', 'email' union all
select 'LIMIT_CUT', cast(count(*) as varchar) from p where name is not null and trim(name) <> ''
having count(*) > 50""")
def sensitive_projection_warning(t):
    from gleanery.operators.profile import field_profile

    df = people(t)
    q = TableQuery(["person_id", "name", "email"], [Filter("name", "not_null")], limit=50)
    return query_warnings(apply_filters(df, q.filters), q, field_profile(df.drop("row_number"), semantics=True))


def _filter_query(name, table, op, field, value, keep, where):
    @query(name, f"select {', '.join(keep)} from {{{table}}} where {where}")
    def run(t, table=table, op=op, field=field, value=value, keep=keep):
        return apply_filters(getattr(t, table), [Filter(field, op, value)]).select(*keep)
    return run


ORDER_KEEP = ("o_orderkey", "o_orderpriority", "o_totalprice")
_filter_query("filter_eq", "orders", "=", "o_orderpriority", "2-HIGH", ORDER_KEEP, "o_orderpriority = '2-HIGH'")
_filter_query("filter_ne", "orders", "!=", "o_orderpriority", "2-HIGH", ORDER_KEEP, "o_orderpriority <> '2-HIGH'")
_filter_query("filter_gt", "orders", ">", "o_totalprice", 250000, ORDER_KEEP, "o_totalprice > 250000")
_filter_query("filter_ge", "lineitem", ">=", "l_quantity", "40", ("l_orderkey", "l_partkey", "l_quantity"), "l_quantity >= 40")
_filter_query("filter_lt", "customer", "<", "c_acctbal", 0, ("c_custkey", "c_acctbal"), "c_acctbal < 0")
_filter_query("filter_le", "customer", "<=", "c_nationkey", 7, ("c_custkey", "c_nationkey"), "c_nationkey <= 7")
_filter_query("filter_contains", "orders", "contains", "o_totalprice", "99.", ORDER_KEEP[:2], "contains(cast(o_totalprice as varchar), '99.')")


@query("filter_is_null", f"with p as ({PEOPLE}) select row_number, person_id from p where name is null or trim(name) = ''")
def filter_is_null(t):
    return apply_filters(people(t), [Filter("name", "is_null")]).select("row_number", "person_id")


@query("filter_not_null", f"with p as ({PEOPLE}) select row_number, name from p where name is not null and trim(name) <> ''")
def filter_not_null(t):
    return apply_filters(people(t), [Filter("name", "not_null")]).select("row_number", "name")


@query("filter_and", """
select l_orderkey, l_partkey, l_suppkey, l_shipdate from {lineitem}
where l_returnflag = 'R' and l_quantity > 30 and l_discount <= 0.05 and l_shipdate >= timestamp '1998-01-01'""")
def filter_and(t):
    return apply_filters(t.lineitem, [
        Filter("l_returnflag", "=", "R"), Filter("l_quantity", ">", 30), Filter("l_discount", "<=", 0.05),
        Filter("l_shipdate", ">=", "1998-01-01")]).select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")


@query("filter_literal_coercion", """
select o_orderkey, o_custkey, o_orderdate from {orders}
where o_orderdate >= timestamp '1997-06-01 00:00:00' and o_custkey = 5""")
def filter_literal_coercion(t):
    return apply_filters(t.orders, [Filter("o_orderdate", ">=", "1997-06-01"), Filter("o_custkey", "=", "5")]
                         ).select("o_orderkey", "o_custkey", "o_orderdate")


@query("order_multi", f"""
with p as ({PEOPLE}), k as (
  select *, case when grade is null or trim(grade) = '' then 1 else 0 end as gb,
         case when phone is null or trim(phone) = '' then 1 else 0 end as pb from p)
select row_number, grade, phone,
       row_number() over (order by gb, case when gb = 0 then grade end desc,
                          pb, case when pb = 0 then phone end, row_number) as position
from k""")
def order_multi(t):
    df = people(t)
    keys = order_keys(df, [Order("grade", "desc"), Order("phone", "asc")], "row_number")
    # range-sorted output; positions come from the sorted slices, not from one task
    from gleanery.operators.ordering import sorted_positions
    return sorted_positions(df.select("row_number", "grade", "phone"), keys, "position")


@query("limit_rows", """
with m as (select * from {orders} where o_totalprice > 400000)
select o_orderkey, o_totalprice, (select count(*) from m) as matched_rows
from m order by o_totalprice desc, o_orderkey limit 25""")
def limit_rows(t):
    df = t.orders
    q = TableQuery(["o_orderkey", "o_totalprice"], [Filter("o_totalprice", ">", 400000)],
                   [Order("o_totalprice", "desc")], 25)
    matched = apply_filters(df, q.filters).agg(F.count(F.lit(1)).alias("n")).scalar()
    return query_table(df, q, "o_orderkey").withColumn("matched_rows", matched)


@query("agg_count_rows", "select count(*) as value from {lineitem} where l_returnflag = 'A'")
def agg_count_rows(t):
    return aggregate_table(t.lineitem, Aggregate("count", filters=[Filter("l_returnflag", "=", "A")]))


@query("agg_count_field", f"""
with p as ({PEOPLE}) select college, count(case when trim(phone) <> '' then 1 end) as value from p group by college""")
def agg_count_field(t):
    return aggregate_table(people(t), Aggregate("count", "phone", ["college"]))


@query("agg_sum", """
select l_suppkey, cast(sum(cast(l_quantity as bigint)) as double) as value from {lineitem} group by l_suppkey""")
def agg_sum(t):
    return aggregate_table(t.lineitem, Aggregate("sum", "l_quantity", ["l_suppkey"]))


@query("agg_avg", """
select l_returnflag, round(avg(l_quantity), 6) as value from {lineitem} group by l_returnflag""")
def agg_avg(t):
    return aggregate_table(t.lineitem, Aggregate("avg", "l_quantity", ["l_returnflag"]))


@query("agg_min", "select o_orderpriority, min(o_totalprice) as value from {orders} group by o_orderpriority")
def agg_min(t):
    return aggregate_table(t.orders, Aggregate("min", "o_totalprice", ["o_orderpriority"]))


@query("agg_max", "select o_custkey, max(o_orderdate) as value from {orders} group by o_custkey")
def agg_max(t):
    return aggregate_table(t.orders, Aggregate("max", "o_orderdate", ["o_custkey"]))


@query("agg_group_by", """
select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as bigint)) as double) as value from {lineitem}
where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus""")
def agg_group_by(t):
    return aggregate_table(t.lineitem, Aggregate(
        "sum", "l_quantity", ["l_returnflag", "l_linestatus"], [Filter("l_shipdate", "<=", "1998-09-02")]))


@query("agg_status", f"""
with p as ({PEOPLE})
select 'found' as request, case when count(*) = 0 then 'not_found' when count(case when trim(phone) <> '' then 1 end) = 0
       then 'no_record' else 'found' end as status, count(*) as matched_rows from p
union all
select 'no_record', case when count(*) = 0 then 'not_found' when count(case when trim(remark) <> '' then 1 end) = 0
       then 'no_record' else 'found' end, count(*) from p where college = 'NATION_3'
union all
select 'not_found', case when count(*) = 0 then 'not_found' else 'found' end, count(*) from p where college = 'nowhere'""")
def agg_status(t):
    df = people(t)
    asks = {"found": Aggregate("max", "phone"),
            "no_record": Aggregate("max", "remark", filters=[Filter("college", "=", "NATION_3")]),
            "not_found": Aggregate("count", filters=[Filter("college", "=", "nowhere")])}
    parts = [aggregate_status(df, a).select(F.lit(k).alias("request"), "status", "matched_rows")
             for k, a in asks.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("agg_lineage", """
with c as (
  select s_nationkey, s_suppkey + 2 as rn, 's_nationkey' as field, 'C' as letter,
         cast(s_nationkey as varchar) as v, cast(s_nationkey as varchar) as j from {supplier} where s_suppkey > 0
  union all
  select s_nationkey, s_suppkey + 2, 's_name', 'B', s_name, '"' || s_name || '"' from {supplier} where s_suppkey > 0
  union all
  select s_nationkey, s_suppkey + 2, 's_suppkey', 'A', cast(s_suppkey as varchar), cast(s_suppkey as varchar)
  from {supplier} where s_suppkey > 0)
select cast(s_nationkey as varchar) as group_s_nationkey, rn as row_number, field, letter || rn as cell, v as value_summary,
       substr(sha256('{"cell": "' || letter || rn || '", "field": "' || field || '", "file_id": "f-supplier", "row": ' || rn
              || ', "sheet": "supplier", "table": "supplier", "value": ' || j || '}'), 1, 24) as evidence_id
from c""")
def agg_lineage(t):
    df = t.supplier.withColumn("row_number", F.col("s_suppkey") + 2)
    ask = Aggregate("count", "s_name", ["s_nationkey"], [Filter("s_suppkey", ">", 0)])
    return aggregate_lineage(df, ask, "f-supplier", "supplier", t.supplier.columns)


@query("rank_in_group", """
select c_custkey, c_nationkey,
       row_number() over (partition by c_nationkey order by floor(c_acctbal / 100) desc, c_custkey) as group_rank
from {customer}""")
def rank_in_group(t):
    df = t.customer.select("c_custkey", "c_nationkey", F.floor(F.col("c_acctbal") / 100).alias("average"))
    return position_in_group(df, ["c_nationkey"], "average", "c_custkey", descending=True, name="group_rank").drop("average")


@query("top_three", """
select o_custkey, round(avg(o_totalprice), 2) as average from {orders}
group by o_custkey order by average desc, o_custkey limit 3""")
def top_three(t):
    averages = t.orders.groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 2).alias("average"))
    return averages.orderBy(F.col("average").desc(), "o_custkey").limit(3)


@query("recent_first", """
select user_id, event_id, ts, row_number() over (partition by user_id order by ts desc, event_id desc) as position
from {events} qualify position <= 5""")
def recent_first(t):
    from gleanery.operators.ranking import top_n
    return top_n(t.events.select("user_id", "event_id", "ts"), ["user_id"],
                 [F.col("ts").desc(), F.col("event_id").desc()], 5)


@query("task_filter_list", """
select o_orderkey as task_id, case when o_orderstatus = 'F' then 'failed' else 'pending' end as status,
       o_orderdate as created_at from {orders} where o_orderstatus in ('F', 'P')""")
def task_filter_list(t):
    from gleanery.operators.ledgers import filter_tasks
    tasks = t.orders.select(
        F.col("o_orderkey").alias("task_id"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "pending")
        .otherwise("success").alias("status"), F.col("o_orderdate").alias("created_at"))
    return filter_tasks(tasks, ["failed", "pending"])
