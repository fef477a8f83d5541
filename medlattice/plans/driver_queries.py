"""The operators applied to the driver's tables, each with DuckDB SQL for the same rows.

The tables stand in for clinical ones: customer for patient, orders for encounter, lineitem for result, supplier for provider, nation
for organization, part for a code dictionary, events for a change feed of documents, conversations for form items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import edc, history, measures, order_stats, release, skew, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def day(c: str):
    return F.col(c).cast("date")


def total(c: str):
    """A sum of amounts that doesn't depend on the order of its rows."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@query("""
with o as (select o_custkey, o_orderkey, cast(o_orderdate as date) as d, lag(cast(o_orderdate as date)) over (partition by o_custkey order by cast(o_orderdate as date), o_orderkey) as before from orders),
f as (select strftime(d, '%Y-%m') as month, case when before is not null and date_diff('day', before, d) between 0 and 30 then 1 else 0 end as r from o)
select month, count(*) as n, cast(sum(r) as bigint) as hits, round(cast(sum(r) as double) / nullif(count(*), 0), 6) as rate from f group by month""")
def readmission_rate_monthly(spark, sf):
    o = measures.returns(read(spark, sf, "orders"), "o_custkey", day("o_orderdate"), day("o_orderdate"), "o_orderkey")
    return measures.rate_by(o.withColumn("month", F.date_format("o_orderdate", "yyyy-MM")), ["month"], "is_return")


@query("""
select strftime(o_orderdate, '%Y-%m') as month, coalesce(n_name, 'Unknown') as nation, count(*) as encounters, count(distinct o_custkey) as patients, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total, cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*) as mean
from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey group by 1, 2""")
def encounter_volume_monthly(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.coalesce("n_name", F.lit("Unknown")).alias("nation")).agg(
        F.count("*").alias("encounters"), F.countDistinct("o_custkey").alias("patients"), total("o_totalprice").alias("total"), (total("o_totalprice") / F.count("*")).alias("mean"))


@query("""
select n_name as organization, count(*) as encounters, count(distinct o_custkey) as patients, count(distinct strftime(o_orderdate, '%Y-%m')) as months, round(cast(count(*) filter (o_orderstatus = 'F') as double) / count(*), 6) as finished_share
from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by n_name""")
def org_scorecard(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy(F.col("n_name").alias("organization")).agg(
        F.count("*").alias("encounters"), F.countDistinct("o_custkey").alias("patients"), F.countDistinct(F.date_format("o_orderdate", "yyyy-MM")).alias("months"), C.ratio(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("finished_share"))


@query("""
select o_orderkey as encounter_id, coalesce(c_custkey, -1) as patient_key, coalesce(c_name, 'Unknown') as patient, coalesce(n_name, 'Unknown') as organization, coalesce(r_name, 'Unknown') as region, cast(strftime(o_orderdate, '%Y%m%d') as bigint) as start_date_key
from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey""")
def encounter_flat(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    unknown = lambda c: F.coalesce(c, F.lit("Unknown"))
    return o.select(F.col("o_orderkey").alias("encounter_id"), F.coalesce("c_custkey", F.lit(-1)).alias("patient_key"), unknown("c_name").alias("patient"), unknown("n_name").alias("organization"), unknown("r_name").alias("region"), C.date_key(day("o_orderdate")).cast("long").alias("start_date_key"))


@query("""
select event_type, count(value) as n_values, round(quantile_cont(value, 0.05), 6) as p05, round(quantile_cont(value, 0.95), 6) as p95, min(value) as low, max(value) as high, round(avg(value), 6) as mean
from events where value is not null group by event_type having count(value) >= 30""")
def reference_band(spark, sf):
    return measures.reference_band(read(spark, sf, "events"), ["event_type"], "value")


@query("""
with band as (select event_type, round(quantile_cont(value, 0.05), 6) as p05, round(quantile_cont(value, 0.95), 6) as p95 from events where value is not null group by event_type having count(value) >= 30)
select event_id, event_type, value, case when value < p05 or value > p95 then 1 else 0 end as is_outlier from events join band using (event_type) where value is not null""")
def outlier_flag(spark, sf):
    e = read(spark, sf, "events")
    return measures.outliers(e, measures.reference_band(e, ["event_type"], "value"), ["event_type"], "value").select("event_id", "event_type", "value", "is_outlier")


@query("""
with q as (select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events group by event_type)
select event_id, event_type, value, round(greatest(q1 - 3 * (q3 - q1) - value, value - (q3 + 3 * (q3 - q1))), 6) as beyond from events join q using (event_type)
where value < q1 - 3 * (q3 - q1) or value > q3 + 3 * (q3 - q1)""")
def iqr_fence(spark, sf):
    return measures.iqr_fence(read(spark, sf, "events"), ["event_type"], "value").select("event_id", "event_type", "value", F.round("beyond", 6).alias("beyond"))


@query("""
with seen as (select o_custkey, max(cast(o_orderdate as date)) as last_visit, count(*) as n_visits from orders group by 1), a as (select max(cast(o_orderdate as date)) as as_of from orders)
select c_custkey, last_visit, coalesce(n_visits, 0) as n_visits, case when last_visit > as_of - interval 24 month then 1 else 0 end as is_active from customer left join seen on o_custkey = c_custkey cross join a""")
def patient_panel(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), day("o_orderdate").alias("visit_date"))
    return measures.panel(read(spark, sf, "customer"), o, "c_custkey", "visit_date").select("c_custkey", "last_visit", "n_visits", "is_active")


@query("""
with a as (select distinct c_custkey as k from customer where c_mktsegment = 'BUILDING'), b as (select distinct o_custkey as k from orders where o_orderpriority like '1%'),
c as (select distinct o_custkey as k from orders join lineitem on l_orderkey = o_orderkey where l_quantity > 45)
select cast(1 as bigint) as step, 'segment' as criterion, count(*) as n from a union all select 2, 'urgent order', count(*) from b union all select 3, 'large line', count(*) from c
union all select 4, 'all criteria', count(*) from a where k in (select k from b) and k in (select k from c)""")
def feasibility_funnel(spark, sf):
    o = read(spark, sf, "orders")
    a = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    b = o.where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("k"))
    c = o.join(read(spark, sf, "lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("o_custkey").alias("k"))
    return measures.funnel([("segment", a), ("urgent order", b), ("large line", c)], "k")


_VERSIONS = """
with h as (select user_id, event_type, ts, event_id, lag(event_type) over (partition by user_id order by ts, event_id) as before from events),
v as (select user_id, event_type, ts as valid_from, lead(ts) over (partition by user_id order by ts, event_id) as valid_to, row_number() over (partition by user_id order by ts, event_id) as version_number
  from h where before is null or before != event_type)
"""


def _user_versions(spark, sf):
    return history.versions(read(spark, sf, "events"), "user_id", "ts", ["event_type"], [F.col("event_id")])


@query(_VERSIONS + "select user_id, event_type, valid_from, valid_to, version_number, valid_to is null as is_current from v")
def scd2_build(spark, sf):
    return _user_versions(spark, sf)


@query(_VERSIONS + "select event_id, e.user_id, v.event_type as state, version_number from events e join v on v.user_id = e.user_id and e.ts >= valid_from and (valid_to is null or e.ts < valid_to)")
def pit_join(spark, sf):
    end = F.coalesce(F.col("valid_to") - F.expr("interval 1 microsecond"), F.lit("9999-12-31").cast("timestamp_ntz"))
    v = _user_versions(spark, sf).select("user_id", F.col("event_type").alias("state"), "valid_from", end.alias("valid_until"), "version_number")
    found = history.as_of_join(read(spark, sf, "events").select("event_id", "user_id", "ts"), v, "user_id", F.col("ts"), ["state", "version_number"], "valid_from", "valid_until")
    return found.where("state is not null").drop("ts")


def _customer_history(spark, sf):
    """A first load of all customers, then a second where those of some nations have moved."""
    c = read(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_name")
    dim = history.apply_scd2(history.empty_history(c, "c_custkey", ["c_mktsegment", "c_nationkey"], ["c_name"]), c, "c_custkey", ["c_mktsegment", "c_nationkey"], "2026-08-01", ["c_name"])
    moved = c.withColumn("c_nationkey", F.when(F.col("c_nationkey") % 7 == 0, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey")))
    return history.apply_scd2(dim, moved, "c_custkey", ["c_mktsegment", "c_nationkey"], "2026-08-03", ["c_name"])


@query("""
select c_custkey, c_mktsegment, cast(c_nationkey as bigint) as c_nationkey, date '1900-01-01' as effective_from, case when c_nationkey % 7 = 0 then date '2026-08-02' else date '9999-12-31' end as effective_to, c_nationkey % 7 != 0 as is_current, cast(1 as bigint) as version_number from customer
union all select c_custkey, c_mktsegment, cast(c_nationkey + 100 as bigint), date '2026-08-03', date '9999-12-31', true, 2 from customer where c_nationkey % 7 = 0""")
def scd2_load(spark, sf):
    return _customer_history(spark, sf).select("c_custkey", "c_mktsegment", "c_nationkey", "effective_from", "effective_to", "is_current", F.col("version_number").cast("long").alias("version_number"))


@query("""
select 'not_one_current' as check_name, cast(c_custkey as varchar) as member, '2' as detail from customer where c_custkey % 100 = 3 and c_nationkey % 7 = 0
union all select 'current_not_open', cast(c_custkey as varchar), '2026-08-02' from customer where c_custkey % 100 = 3 and c_nationkey % 7 = 0""")
def scd2_integrity(spark, sf):
    """A sound table would give no rows, so every hundredth member's closed version is marked current."""
    d = _customer_history(spark, sf)
    broken = d.withColumn("is_current", F.when((F.col("c_custkey") % 100 == 3) & (F.col("version_number") == 1), True).otherwise(F.col("is_current")))
    return history.integrity(broken, "c_custkey")


@query("select user_id, event_type, event_id, ts from events qualify row_number() over (partition by user_id, event_type order by ts desc nulls last, cast(event_id as varchar) desc) = 1")
def latest_version(spark, sf):
    return tables.latest_version(read(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "ts")


@query("select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type, cast(ts as date) order by ts, event_id) = 1")
def in_batch_dedupe(spark, sf):
    e = read(spark, sf, "events").withColumn("d", day("ts"))
    return tables.dedupe(e, ["user_id", "event_type", "d"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.none') as none, json_valid(props) as is_json from events")
def json_shred(spark, sf):
    e = read(spark, sf, "events").withColumn("p", F.from_json("props", "k long, none string"))
    return e.select("event_id", F.col("p.k").alias("k"), F.col("p.none").alias("none"), F.try_parse_json("props").isNotNull().alias("is_json"))


@query("""
select system, code, min(display) as display, count(*) as n from (
  select 'part' as system, p_type as code, p_name as display from part union all select 'brand', p_brand, p_name from part union all select 'event', event_type, null from events) group by system, code""")
def code_register(spark, sf):
    p, e = read(spark, sf, "part"), read(spark, sf, "events")
    coding = p.select(F.inline(F.array(F.struct(F.lit("part").alias("system"), F.col("p_type").alias("code"), F.col("p_name").alias("display")), F.struct(F.lit("brand").alias("system"), F.col("p_brand").alias("code"), F.col("p_name").alias("display")))))
    coding = coding.unionByName(e.select(F.lit("event").alias("system"), F.col("event_type").alias("code"), F.lit(None).cast("string").alias("display")))
    return coding.groupBy("system", "code").agg(F.min("display").alias("display"), F.count("*").alias("n"))


@query("select row_number() over (order by p_type) as type_key, p_type from (select distinct p_type from part) union all select -1, 'Unknown'")
def code_dim(spark, sf):
    members = read(spark, sf, "part").select("p_type").distinct().select(F.lit(None).cast("long").alias("type_key"), "p_type")
    return tables.with_unknown(tables.with_keys(members, "type_key", ["p_type"]), "type_key")


@query("""
select c_custkey, case when c_custkey % 3 = 0 then upper(c_name) else c_name end as c_name, round(case when c_custkey % 3 = 0 then c_acctbal + 1 else c_acctbal end, 2) as c_acctbal from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0""")
def upsert_type1(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))
    source = c.where("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.round(F.col("c_acctbal") + 1, 2).alias("c_acctbal"))
    return tables.upsert(c.where("c_custkey % 2 = 0"), source, ["c_custkey"])


@query("""
select c_custkey, case when c_custkey % 2 != 0 then upper(c_name) when c_custkey % 3 = 0 and c_acctbal < 0 then upper(c_name) else c_name end as c_name from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0""")
def upsert_conditional(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    source = c.where("c_custkey % 3 = 0").withColumn("c_name", F.upper("c_name"))
    return tables.upsert(c.where("c_custkey % 2 = 0"), source, ["c_custkey"], "t.c_acctbal < 0").select("c_custkey", "c_name")


@query("""
select c_custkey, c_name, false as is_inferred from customer where c_custkey % 5 != 0
union all select o_custkey, null, true from (select distinct o_custkey from orders where o_custkey % 5 = 0 or o_custkey not in (select c_custkey from customer))""")
def inferred_members(spark, sf):
    dim = read(spark, sf, "customer").where("c_custkey % 5 != 0").select("c_custkey", "c_name", F.lit(False).alias("is_inferred"))
    return tables.inferred(dim, read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""
select o_orderkey as result_id, cast(0 as bigint) as component, o_totalprice as amount from orders
union all select l_orderkey, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax, l_discount, l_shipdate) as bigint), l_extendedprice from lineitem""")
def result_grain_union(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount", "l_shipdate")
    parts = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("result_id"), F.row_number().over(w).cast("long").alias("component"), F.col("l_extendedprice").alias("amount"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("result_id"), F.lit(0).cast("long").alias("component"), F.col("o_totalprice").alias("amount")).unionByName(parts)


@query("""
select l_orderkey, testcd, count(*) as n, round(sum(value), 4) as total from (
  select l_orderkey, 'QTY' as testcd, l_quantity as value from lineitem union all select l_orderkey, 'DISC', l_discount from lineitem union all select l_orderkey, 'TAX', l_tax from lineitem) where value > 0 group by 1, 2""")
def unpivot_vitals(spark, sf):
    l = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("QTY"), F.col("l_discount").alias("DISC"), F.col("l_tax").alias("TAX"))
    return l.unpivot("l_orderkey", ["QTY", "DISC", "TAX"], "testcd", "value").where("value > 0").groupBy("l_orderkey", "testcd").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
with p as (select conv_id, turn, max(text) filter (role = 'user') as u, max(text) filter (role = 'assistant') as a from conversations group by 1, 2)
select conv_id, turn, 'EC-REQ' as check_id, 'user' as item from p where coalesce(trim(u), '') = ''
union all select conv_id, turn, 'EC-REQ', 'assistant' from p where coalesce(trim(a), '') = ''
union all select conv_id, turn, 'EC-RANGE', 'user' from p where coalesce(trim(u), '') != '' and length(u) > 200
union all select conv_id, turn, 'EC-CROSS', 'assistant' from p where u = a""")
def edc_pivot_checks(spark, sf):
    p = read(spark, sf, "conversations").groupBy("conv_id", "turn").pivot("role", ["user", "assistant"]).agg(F.max("text"))
    said = lambda cond, check, item: p.where(cond).select("conv_id", "turn", F.lit(check).alias("check_id"), F.lit(item).alias("item"))
    return (
        said(C.blank(F.col("user")), "EC-REQ", "user").unionByName(said(C.blank(F.col("assistant")), "EC-REQ", "assistant"))
        .unionByName(said(~C.blank(F.col("user")) & (F.length("user") > 200), "EC-RANGE", "user")).unionByName(said(F.col("user") == F.col("assistant"), "EC-CROSS", "assistant"))
    )


_CODED = """
with v as (select p_partkey, regexp_replace(lower(trim(p_name)), '[^a-z0-9 ]', '', 'g') as term from part),
d as (select regexp_replace(lower(trim(p_name)), '[^a-z0-9 ]', '', 'g') as term, min(p_name) as preferred from part where p_partkey % 3 = 0 group by 1),
s as (select regexp_replace(lower(trim(p_name)), '[^a-z0-9 ]', '', 'g') as term, min(p_type) as preferred from part where p_partkey % 5 = 0 group by 1),
c as (select p_partkey, term, case when d.preferred is not null then 'auto' when s.preferred is not null then 'synonym' else 'uncoded' end as status, coalesce(d.preferred, s.preferred, '') as coded from v left join d using (term) left join s using (term))
"""


def _coded(spark, sf):
    from ..operators.coding import code_terms

    p = read(spark, sf, "part")
    preferred = p.where("p_partkey % 3 = 0").groupBy(C.term(F.col("p_name")).alias("term")).agg(F.min("p_name").alias("preferred"))
    synonyms = p.where("p_partkey % 5 = 0").groupBy(C.term(F.col("p_name")).alias("term")).agg(F.min("p_type").alias("preferred"))
    return code_terms(p.select("p_partkey", F.col("p_name").alias("verbatim")), "verbatim", preferred, synonyms, None)


@query(_CODED + "select p_partkey, status, coded from c")
def coding_outcome(spark, sf):
    return _coded(spark, sf).select("p_partkey", "status", "coded")


@query("""
with v as (select p_name as verbatim, p_partkey, regexp_replace(lower(trim(p_name)), '[^a-z0-9 ]', '', 'g') as term from part),
c as (select *, case when term like 'b%' then 'auto' when term like 's%' then 'ambiguous' else 'uncoded' end as status from v),
w as (select 'names' as dictionary, verbatim, status, count(*) as records_blocked, min(p_partkey) as f from c where status <> 'auto' group by all)
select dictionary, verbatim, status, records_blocked, row_number() over (order by records_blocked desc, f, verbatim)::int as place, case status when 'ambiguous' then 'Medical monitor to select term' else 'Query site for clarification' end as suggested_action from w""")
def coding_worklist(spark, sf):
    """Names that no dictionary has, or that may mean two things, by the parts they hold up."""
    from ..operators import coding

    p = read(spark, sf, "part").select(F.col("p_name").alias("verbatim"), "p_partkey", F.lit("names").alias("dictionary"))
    names = p.select(C.term(F.col("verbatim")).alias("term")).distinct()
    some = lambda letter, said: names.where(F.col("term").startswith(letter)).select("term", said.alias("preferred"))
    coded = coding.code_terms(p, "verbatim", some("b", F.col("term")), some("none", F.col("term")), some("s", F.concat("term", F.lit(" | other"))))
    return coding.worklist(coded, "verbatim", "p_partkey")


@query("""
select 'documents.lang' as column_name, count(*) as n, cast(sum(case when lang is null then 1 else 0 end) as bigint) as nulls, round(cast(sum(case when lang is null then 1 else 0 end) as double) / nullif(count(*), 0), 6) as rate from documents
union all select 'labels.toxic', count(*), cast(sum(case when toxic is null then 1 else 0 end) as bigint), round(cast(sum(case when toxic is null then 1 else 0 end) as double) / nullif(count(*), 0), 6) from documents left join labels using (doc_id)""")
def null_rates(spark, sf):
    from ..operators.quality import null_rate

    d = read(spark, sf, "documents")
    return null_rate(d, "lang", "documents.lang").unionByName(null_rate(d.join(read(spark, sf, "labels"), "doc_id", "left"), "toxic", "labels.toxic"))


@query("select l_orderkey, l_linenumber, count(*) as n_rows from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, sf):
    return tables.duplicates(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select o_orderkey, o_custkey from orders where o_custkey is not null and o_custkey not in (select c_custkey from customer where c_custkey % 10 != 0)")
def orphans(spark, sf):
    return tables.orphans(read(spark, sf, "orders"), "o_custkey", read(spark, sf, "customer").where("c_custkey % 10 != 0"), "c_custkey").select("o_orderkey", "o_custkey")


@query("""
select 'orders' as layer, (select count(*) from orders) as source_rows, (select count(*) from orders where o_custkey in (select c_custkey from customer)) as loaded_rows
union all select 'lineitem', (select count(*) from lineitem), (select count(*) from lineitem where l_orderkey in (select o_orderkey from orders))""")
def reconciliation(spark, sf):
    o, l = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    row = lambda name, a, b: a.agg(F.count("*").alias("source_rows")).crossJoin(b.agg(F.count("*").alias("loaded_rows"))).select(F.lit(name).alias("layer"), "source_rows", "loaded_rows")
    loaded = o.join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return row("orders", o, loaded).unionByName(row("lineitem", l, l.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")))


@query("""
select 'COHORT-01' as gate_id, case when (select count(*) from (select distinct o_custkey from orders except select c_custkey from customer)) = 0 then 'PASS' else 'BLOCK' end as status
union all select 'UAT-01', case when (select count(*) from orders where o_orderstatus = 'O') = 0 then 'PASS' else 'REVIEW' end
union all select 'DECISION', case when (select count(*) from (select distinct o_custkey from orders except select c_custkey from customer)) > 0 then 'BLOCKED' when (select count(*) from orders where o_orderstatus = 'O') > 0 then 'REVIEW REQUIRED' else 'READY' end""")
def release_gates(spark, sf):
    from ..operators.release import decision, gate

    o = read(spark, sf, "orders")
    missing = o.select("o_custkey").distinct().subtract(read(spark, sf, "customer").select("c_custkey"))
    gates = gate("COHORT-01", missing, "BLOCK").unionByName(gate("UAT-01", o.where("o_orderstatus = 'O'"), "REVIEW"))
    return gates.unionByName(decision(gates).select(F.lit("DECISION").alias("gate_id"), F.col("decision").alias("status")))


@query("""
select c_mktsegment as cohort, count(distinct c_custkey) as members, upper(substr(sha256(string_agg(distinct cast(c_custkey as varchar), chr(10) order by cast(c_custkey as varchar))), 1, 16)) as member_fingerprint from customer group by 1""")
def cohort_fingerprint(spark, sf):
    from ..operators.release import fingerprint

    return read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("cohort")).agg(F.countDistinct("c_custkey").alias("members"), fingerprint("c_custkey").alias("member_fingerprint"))


@query("""
with o as (select cast(o_orderdate as date) as d, count(*) as n_orders from orders group by 1),
days as (select unnest(generate_series((select min(d) from o), (select max(d) from o), interval 1 day))::date as d),
f as (select d, d - interval 3 month as s, coalesce(n_orders, 0) as n_orders from days left join o using (d))
select cast(strftime(d, '%Y%m%d') as bigint) as date_key, d as full_date, day(d) as day_of_month, dayofweek(d) + 1 as day_of_week, dayname(d) as day_name, dayofyear(d) as day_of_year, weekofyear(d) as week_of_year, month(d) as month_number, monthname(d) as month_name, strftime(d, '%Y-%m') as month_year,
 quarter(d) as quarter_number, strftime(d, '%Y') || '-Q' || quarter(d) as quarter_name, year(d) as year_number, cast(dayofweek(d) in (0, 6) as bigint) as is_weekend, year(s) as fiscal_year, quarter(s) as fiscal_quarter, n_orders from f
union all select -1, date '1899-12-31', 1, 1, 'Unknown', 1, 1, 1, 'Unknown', 'Unknown', 1, 'Unknown', 1900, 0, 1900, 1, 0""")
def calendar(spark, sf):
    """The calendar from the first day of the orders to the last, with the orders of each day, and the Unknown day."""
    n = read(spark, sf, "orders").groupBy(day("o_orderdate").alias("d")).agg(F.count("*").alias("n_orders"))
    ends = n.agg(F.min("d"), F.max("d")).first()
    days = measures.calendar(spark, str(ends[0]), str(ends[1]))
    return days.join(n, F.col("full_date") == F.col("d"), "left").drop("d").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))


@query("""
with t as (select p_type from lineitem join part on p_partkey = l_partkey group by p_type order by count(*) desc, p_type limit 1)
select p_type, strftime(l_shipdate, '%Y-%m') as month, l_returnflag as band, count(*) as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) / count(*) as mean from lineitem join part on p_partkey = l_partkey where p_type = (select p_type from t) group by 1, 2, 3""")
def bench_q1(spark, sf):
    l = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return l.join(measures.top(l, ["p_type"], 1).select("p_type"), "p_type", "left_semi").groupBy("p_type", F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_returnflag").alias("band")).agg(F.count("*").alias("n"), (total("l_quantity") / F.count("*")).alias("mean"))


@query("""
select p_type, year(cast(l_shipdate as date) - interval 3 month) as fiscal_year, quarter(cast(l_shipdate as date) - interval 3 month) as fiscal_quarter, count(*) as n, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / count(*) as mean, min(l_extendedprice) as low, max(l_extendedprice) as high
from lineitem join part on p_partkey = l_partkey group by 1, 2, 3""")
def bench_q2(spark, sf):
    l = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("s", F.add_months(day("l_shipdate"), -3))
    return l.groupBy("p_type", F.year("s").cast("long").alias("fiscal_year"), F.quarter("s").cast("long").alias("fiscal_quarter")).agg(F.count("*").alias("n"), (total("l_extendedprice") / F.count("*")).alias("mean"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("""select count(*) as n_refs, count(*) filter (k is not null) as n_resolved from (select json_extract_string(props, '$.k') as k from events)""")
def bench_q3(spark, sf):
    k = F.from_json("props", "k string")["k"]
    return read(spark, sf, "events").agg(F.count("*").alias("n_refs"), F.count(C.literal_reference(F.concat(F.lit("Patient/"), k))).alias("n_resolved"))


@query("""
select page_id, case when html is null or trim(html) = '' then 'parse' when not starts_with(html, '<!DOCTYPE') then 'schema' end as failure_stage,
  case when html is null or trim(html) = '' then 'document: empty' when not starts_with(html, '<!DOCTYPE') then 'doctype: missing' end as reason from pages""")
def page_gate(spark, sf):
    from ..operators.gate import first_failure

    rules = [("parse", C.blank(F.col("html")), "document: empty"), ("schema", ~F.startswith("html", F.lit("<!DOCTYPE")), "doctype: missing")]
    return read(spark, sf, "pages").select("page_id", *first_failure(rules))


@query("""
with m as (select strftime(o_orderdate, '%Y-%m') as month, o_orderpriority, count(*) as n from orders group by 1, 2)
select month, o_orderpriority, n, cast(sum(n) over (partition by o_orderpriority order by month rows between unbounded preceding and current row) as bigint) as running from m""")
def running_total(spark, sf):
    m = read(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority").agg(F.count("*").alias("n"))
    return measures.running_total(m, ["o_orderpriority"], ["month"], "n")


@query("select p_brand, count(*) as n from part group by 1 order by n desc, p_brand limit 12")
def top_n(spark, sf):
    return measures.top(read(spark, sf, "part"), ["p_brand"], 12)


@query("""
with m as (select date_trunc('month', cast(o_orderdate as date))::date as month, count(*) as n from orders group by 1)
select a.month, a.n, b.n as prior, round(cast(a.n - b.n as double) / nullif(b.n, 0), 6) as growth from m a left join m b on b.month + interval 12 month = a.month""")
def year_over_year(spark, sf):
    m = read(spark, sf, "orders").groupBy(F.trunc(day("o_orderdate"), "MM").alias("month")).agg(F.count("*").alias("n"))
    return measures.year_over_year(m, "month", "n")


@query("""
select o_orderpriority, list_sort(list(o_totalprice))[cast(count(*) // 2 as bigint) + 1] as upper_median, round(median(o_totalprice), 6) as median from orders group by 1""")
def medians(spark, sf):
    o = read(spark, sf, "orders")
    middle = o.groupBy("o_orderpriority").agg(F.round(F.median("o_totalprice"), 6).alias("median"))
    return measures.upper_medians(o, ["o_orderpriority"], "o_totalprice").join(middle, "o_orderpriority")


@query("""
with m as (select l_returnflag, quantile_cont(l_extendedprice, 0.05) as p05, quantile_cont(l_extendedprice, 0.5) as p50, quantile_cont(l_extendedprice, 0.999) as p999, count(*) as n_values, list_sort(list(l_quantity))[(count(*) // 2)::bigint + 1]::double as upper_median, list_sort(list(l_quantity))[1]::double as least from lineitem group by 1)
select l_returnflag, n_values, round(p05, 6) as p05, round(p50, 6) as p50, round(p999, 6) as p999, upper_median, least from m""")
def order_statistics(spark, sf):
    """Quantiles and ranks of large groups found by counting between cuts: here all groups of more than 1,000 values go that way."""
    i = read(spark, sf, "lineitem")
    q = order_stats.quantiles(i, ["l_returnflag"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p999": 0.999}, large=1000)
    r = order_stats.at_ranks(i, ["l_returnflag"], "l_quantity", {"upper_median": F.floor(F.col("n_values") / 2), "least": F.lit(0)}, large=1000)
    q = q.select("l_returnflag", "n_values", *(F.round(c, 6).alias(c) for c in ("p05", "p50", "p999")))
    return q.join(r.select("l_returnflag", F.col("upper_median").cast("double").alias("upper_median"), F.col("least").cast("double").alias("least")), "l_returnflag")


@query("""
with m as (select distinct o_orderpriority as cohort, sha256(o_orderkey::varchar) as h from orders),
n as (select cohort, count(*) as members, case when count(*) <= 64 then 0 when count(*) <= 1024 then 1 when count(*) <= 16384 then 2 when count(*) <= 262144 then 3 end as depth from m group by 1),
b as (select cohort, members, depth, left(h, depth) as p, sha256(string_agg(h, '' order by h)) as v from m join n using (cohort) group by all),
b2 as (select * from b where depth < 3 union all select cohort, members, depth, left(p, 2), sha256(string_agg(right(p, 1) || v, '' order by p)) from b where depth = 3 group by all),
b1 as (select * from b2 where depth < 2 union all select cohort, members, depth, left(p, 1), sha256(string_agg(right(p, 1) || v, '' order by p)) from b2 where depth >= 2 group by all),
b0 as (select * from b1 where depth < 1 union all select cohort, members, depth, '', sha256(string_agg(right(p, 1) || v, '' order by p)) from b1 where depth >= 1 group by all)
select cohort, members, depth, upper(left(v, 16)) as tree_fingerprint from b0""")
def cohort_tree_fingerprint(spark, sf):
    """Fingerprints of cohorts as hash trees, with blocks of 64 members."""
    return release.tree_fingerprint(read(spark, sf, "orders").withColumnRenamed("o_orderpriority", "cohort"), ["cohort"], "o_orderkey", block=64)


@query(_VERSIONS + "select event_id, e.user_id, v.event_type as state, version_number from events e left join v on v.user_id = e.user_id and e.ts >= valid_from and (valid_to is null or e.ts < valid_to)")
def pit_sorted(spark, sf):
    """Events with their user's state at the time, by sorting events and versions together over range partitions."""
    v = _user_versions(spark, sf)
    end = F.coalesce(F.col("valid_to") - F.expr("interval 1 microsecond"), F.lit("9999-12-31").cast("timestamp_ntz"))
    v = v.select("user_id", F.col("event_type").alias("state"), "valid_from", end.alias("valid_until"), "version_number")
    return history.as_of_sorted(read(spark, sf, "events").select("event_id", "user_id", "ts"), v, "user_id", F.col("ts"), ["state", "version_number"], "valid_from", "valid_until").drop("ts")


@query("""
select e.event_id, e.user_id, c_name, c_mktsegment from (select event_id, case when event_id % 3 = 0 then 7 else user_id end as user_id from events) e left join customer on c_custkey = user_id""")
def skewed_lookup(spark, sf):
    """Events with a customer who has a third of them, joined without a broadcast: that customer's rows are spread."""
    e = read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, 7).otherwise(F.col("user_id")).cast("long").alias("user_id"))
    side = read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("user_id"), "c_name", "c_mktsegment")
    return skew.lookup(e, side, ["user_id"], broadcast_rows=0)


@query("""
select b.v as band, b.i as place, count(e.band) as n from (values ('0-9', 0), ('10-99', 1), ('100+', 2), ('none', 3)) b(v, i)
left join (select case when value is null then 'none' when value < 10 then '0-9' when value < 100 then '10-99' else '100+' end as band from events) e on e.band = b.v group by 1, 2""")
def domain_counts(spark, sf):
    band = F.when(F.col("value").isNull(), "none").when(F.col("value") < 10, "0-9").when(F.col("value") < 100, "10-99").otherwise("100+")
    out = measures.over_domain(read(spark, sf, "events").select(band.alias("band")), "band", ["0-9", "10-99", "100+", "none"])
    return out.withColumn("place", F.col("place").cast("int"))


@query("""
select o_orderkey, case when o_custkey % 2 = 0 then -1 else c_custkey end as patient_key from orders left join customer on c_custkey = o_custkey where o_custkey % 2 = 0 or c_custkey is not null""")
def unknown_member(spark, sf):
    c = read(spark, sf, "customer").where("c_custkey % 2 = 1")
    o = read(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.select("o_orderkey", F.coalesce("c_custkey", F.lit(-1)).cast("long").alias("patient_key"))


@query("select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and cast(o_orderdate as date) between date '1996-01-01' and date '1997-12-31' and o_custkey in (select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY'))")
def cohort_filter(spark, sf):
    c = read(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    o = read(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & day("o_orderdate").between("1996-01-01", "1997-12-31"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("""
select 'left' as only_in, k from (select p_partkey as k from part except select o_orderkey from orders where o_orderstatus <> 'F') union all select 'right', k from (select o_orderkey as k from orders where o_orderstatus <> 'F' except select p_partkey from part)""")
def set_equality(spark, sf):
    """Keys that one of two sets lacks."""
    return tables.set_difference(read(spark, sf, "part").select(F.col("p_partkey").alias("k")), read(spark, sf, "orders").where("o_orderstatus != 'F'").select(F.col("o_orderkey").alias("k"))).select("only_in", "k")


@query("""
select min(event_id) as event_id, 1 as n from (select event_id, user_id, event_type, first_value(event_id) over (partition by user_id, event_type order by ts, event_id) as f from events) where event_id = f and (user_id, event_type) not in (select user_id, event_type from events where user_id % 2 = 0) group by user_id, event_type""")
def idempotent_landing(spark, sf):
    e = read(spark, sf, "events")
    fresh, _ = tables.land(e.where("user_id % 2 = 0"), e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    return fresh.select("event_id", F.lit(1).cast("long").alias("n"))


@query("select format('Q{:05d}', row_number() over (order by o_orderdate, o_orderkey)) as query_id, o_orderkey from orders where o_orderstatus = 'P'")
def emission_ids(spark, sf):
    placed = tables.numbered(read(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "n")
    return placed.select(F.format_string("Q%05d", "n").alias("query_id"), "o_orderkey")


@query("""
select c_custkey, case when a < 18 then '00-17' when a < 45 then '18-44' when a < 65 then '45-64' when a < 80 then '65-79' else '80+' end as age_band from (select c_custkey, 2026 - (1930 + c_custkey % 90) as a from customer)""")
def age_bands(spark, sf):
    birth = F.make_date((1930 + F.col("c_custkey") % 90).cast("int"), F.lit(7), F.lit(1))
    return read(spark, sf, "customer").select("c_custkey", C.age_band(birth, F.lit("2026-08-01").cast("date")).alias("age_band"))


@query("""
with r as (select event_id, case event_id % 5 when 0 then 'Patient/' || user_id when 1 then 'https://h.example/fhir/Patient/' || user_id when 2 then 'Practitioner?identifier=sys|' || user_id when 3 then 'urn:uuid:' || user_id else event_type end as ref, user_id, event_id % 5 as k from events)
select event_id, case k when 0 then 'literal' when 1 then 'absolute' when 2 then 'conditional' when 3 then 'urn' else 'unparseable' end as kind, case when k in (0, 1, 3) then cast(user_id as varchar) end as target, case when k = 2 then 'sys' end as id_system, case when k = 2 then cast(user_id as varchar) end as id_value from r""")
def reference_parser(spark, sf):
    u = F.col("user_id").cast("string")
    ref = F.element_at(F.array(F.concat(F.lit("Patient/"), u), F.concat(F.lit("https://h.example/fhir/Patient/"), u), F.concat(F.lit("Practitioner?identifier=sys|"), u), F.concat(F.lit("urn:uuid:"), u), F.col("event_type")), (F.col("event_id") % 5 + 1).cast("int"))
    system, value = C.conditional_reference(F.col("ref"))
    return read(spark, sf, "events").withColumn("ref", ref).select("event_id", C.reference_kind(F.col("ref")).alias("kind"), C.literal_reference(F.col("ref")).alias("target"), system.alias("id_system"), value.alias("id_value"))


@query("""
select o_orderstatus as class_code, o_orderkey % 12 as k, case o_orderkey % 12 when 0 then 'Inpatient' when 1 then 'Inpatient' when 2 then 'Inpatient' when 3 then 'Emergency' when 4 then 'Ambulatory' when 5 then 'Ambulatory' when 6 then 'Ambulatory' when 7 then 'Ambulatory' when 8 then 'Virtual' when 9 then 'Home' when 10 then 'Other' else 'Unknown' end as care_setting, count(*) as n from orders group by 1, 2, 3""")
def care_settings(spark, sf):
    codes = ["IMP", "ACUTE", "NONAC", "EMER", "AMB", "OBSENC", "PRENC", "SS", "VR", "HH", "FLD", "?"]
    o = read(spark, sf, "orders").withColumn("k", F.col("o_orderkey") % 12)
    code = F.element_at(F.array(*(F.lit(c) for c in codes)), (F.col("k") + 1).cast("int"))
    return o.groupBy(F.col("o_orderstatus").alias("class_code"), "k", C.care_setting(code).alias("care_setting")).agg(F.count("*").alias("n"))


@query("""
with s as (select o_orderkey, o_custkey, cast(o_orderdate as date) as d, o_orderkey % 60 as off, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as visit from orders),
b as (select o_custkey, d as baseline from s where visit = 1), w(visit, day, win) as (values (1, 1, 0), (2, 28, 3), (3, 84, 5), (4, 168, 7))
select o_orderkey, s.visit, abs(date_diff('day', baseline + cast(day - 1 as integer), d)) - win as days_outside from s join b using (o_custkey) join w using (visit) where abs(date_diff('day', baseline + cast(day - 1 as integer), d)) > win""")
def visit_windows(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    s = read(spark, sf, "orders").select("o_orderkey", "o_custkey", day("o_orderdate").alias("d"), F.row_number().over(w).alias("visit"))
    base = s.where("visit = 1").select("o_custkey", F.col("d").alias("baseline"))
    plan = spark.createDataFrame([(1, 1, 0), (2, 28, 3), (3, 84, 5), (4, 168, 7)], "visit int, day int, win int")
    v = s.join(base, "o_custkey").join(F.broadcast(plan), "visit").withColumn("off", F.abs(F.datediff("d", F.date_add("baseline", F.col("day") - 1))))
    return v.where("off > win").select("o_orderkey", F.col("visit").cast("long").alias("visit"), (F.col("off") - F.col("win")).cast("long").alias("days_outside"))


@query("""
select c_custkey as subject, cast(row_number() over (partition by c_custkey order by cast(o_orderdate as date), o_orderpriority, o_orderkey) as bigint) as aeseq, o_orderkey from customer join orders on o_custkey = c_custkey where o_orderpriority != ''""")
def event_sequence(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(day("o_orderdate"), "o_orderpriority", "o_orderkey")
    o = read(spark, sf, "orders").where("o_orderpriority != ''").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return o.select(F.col("o_custkey").alias("subject"), F.row_number().over(w).cast("long").alias("aeseq"), "o_orderkey")


@query("""
select 'LANG is required' as rule, count(*) as records from documents where coalesce(trim(lang), '') = '' having count(*) > 0
union all select 'DTC must be ISO 8601', count(*) from (select case when event_id % 100 = 0 then strftime(ts, '%d.%m.%Y') else strftime(ts, '%Y-%m-%d') end as d from events) where not regexp_matches(d, '^.{4}-.{2}-.{2}$') having count(*) > 0
union all select 'SEQ must be unique', cast(sum(n - 1) as bigint) from (select count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1) having sum(n - 1) > 0""")
def conformance(spark, sf):
    rule = lambda name, df, c: df.agg(c.cast("long").alias("records")).where("records > 0").select(F.lit(name).alias("rule"), "records")
    d = F.when(F.col("event_id") % 100 == 0, F.date_format("ts", "dd.MM.yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return (
        rule("LANG is required", read(spark, sf, "documents").where(C.blank(F.col("lang"))), F.count("*"))
        .unionByName(rule("DTC must be ISO 8601", read(spark, sf, "events").where(~d.rlike(r"^.{4}-.{2}-.{2}$")), F.count("*")))
        .unionByName(rule("SEQ must be unique", tables.duplicates(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]), F.sum(F.col("n_rows") - 1)))
    )


@query("""
select 'negative balance' as failure, cast(c_custkey as varchar) as member from customer where c_acctbal < -900
union all select 'future order', cast(o_orderkey as varchar) from orders where cast(o_orderdate as date) > date '2001-07-25'
union all select 'discount over tax', cast(l_orderkey as varchar) from lineitem where l_discount > 0.09 and l_tax < 0.01""")
def plausibility(spark, sf):
    said = lambda df, failure, key: df.select(F.lit(failure).alias("failure"), F.col(key).cast("string").alias("member"))
    return (
        said(read(spark, sf, "customer").where("c_acctbal < -900"), "negative balance", "c_custkey").unionByName(said(read(spark, sf, "orders").where(day("o_orderdate") > "2001-07-25"), "future order", "o_orderkey"))
        .unionByName(said(read(spark, sf, "lineitem").where("l_discount > 0.09 and l_tax < 0.01"), "discount over tax", "l_orderkey"))
    )


@query("""
with l as (select o_custkey % 10 as site, case when o_orderstatus = 'O' then null else o_orderkey % 40 end as days from orders)
select site, count(*) as queries_raised, count(*) filter (days is null) as queries_open, count(days) as queries_closed, round(cast(count(days) as double) / count(*), 4) as close_rate, list_sort(list(days) filter (days is not null))[cast(count(days) // 2 as bigint) + 1] as median_days from l group by site""")
def site_performance(spark, sf):
    days = F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey") % 40)
    log = read(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("site_id"), days.alias("days_to_close"), F.when(days.isNull(), "open").otherwise("closed").alias("status"))
    return edc.site_performance(log).withColumnsRenamed({"site_id": "site", "median_days_to_close": "median_days"})


@query("""
select case when a <= 7 then '0-7 days' when a <= 14 then '8-14 days' when a <= 30 then '15-30 days' when a <= 60 then '31-60 days' else '60+ days' end as age_band, count(*) as n from (select date_diff('day', cast(o_orderdate as date), date '2001-08-01') as a from orders) group by 1""")
def query_ageing(spark, sf):
    from ..operators.edc import age_band

    return read(spark, sf, "orders").groupBy(age_band(F.datediff(F.lit("2001-08-01").cast("date"), day("o_orderdate"))).alias("age_band")).agg(F.count("*").alias("n"))


@query("""
select o_custkey, first_order, first_priority from (select o_custkey, o_orderkey as first_order, o_orderpriority as first_priority, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as p from orders) where p = 1""")
def first_by_group(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("first_order"), F.col("o_orderpriority").alias("first_priority"), "o_orderdate")
    return tables.first_by(o, ["o_custkey"], F.struct("o_orderdate", "first_order"), ["first_order", "first_priority"])


@query("""
select conv_id, role, texts[cast(len(texts) as bigint)] as last_text, len(texts) as n from (select conv_id, role, list(text order by turn, text) as texts from conversations group by 1, 2)""")
def pivot_last_wins(spark, sf):
    return read(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.max_by("text", F.struct("turn", "text")).alias("last_text"), F.count("*").alias("n"))


@query("""
select 'encounters' as measure, cast(count(*) as double) as value from orders union all select 'patients', cast(count(distinct o_custkey) as double) from orders union all select 'finished share', round(cast(count(*) filter (o_orderstatus = 'F') as double) / count(*), 6) from orders
union all select 'median price', round(quantile_cont(o_totalprice, 0.5), 6) from orders""")
def bi_measures(spark, sf):
    o = read(spark, sf, "orders")
    both = o.agg(F.count("*").cast("double").alias("encounters"), F.countDistinct("o_custkey").cast("double").alias("patients"), C.ratio(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("finished share"), F.round(F.expr("percentile_cont(0.5) within group (order by o_totalprice)"), 6).alias("median price"))
    return both.unpivot([], ["encounters", "patients", "finished share", "median price"], "measure", "value")


@query("""
select 'orders' as source, count(*) as n_rows from orders union all select 'customer', count(*) from customer union all select 'events', count(*) from events""")
def source_ledger(spark, sf):
    from ..operators.release import source_ledger as ledger

    return ledger({n: read(spark, sf, n) for n in ("orders", "customer", "events")})


@query("""
select 'event_type' as constraint_name, 'events' as table_name, count(*) as n_rows from events where event_type not in ('click', 'view') having count(*) > 0
union all select 'c_nationkey -> nation', 'customer', count(*) from customer where c_nationkey not in (select n_nationkey from nation where n_nationkey < 20) having count(*) > 0""")
def declared_constraints(spark, sf):
    e = read(spark, sf, "events").where(~F.col("event_type").isin("click", "view"))
    c = tables.orphans(read(spark, sf, "customer"), "c_nationkey", read(spark, sf, "nation").where("n_nationkey < 20"), "n_nationkey")
    row = lambda df, name, table: df.agg(F.count("*").alias("n_rows")).where("n_rows > 0").select(F.lit(name).alias("constraint_name"), F.lit(table).alias("table_name"), "n_rows")
    return row(e, "event_type", "events").unionByName(row(c, "c_nationkey -> nation", "customer"))


@query("""
select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, cast(sum(cast(value as decimal(18,4))) as double) as total from events group by 1, 2""")
def event_windows(spark, sf):
    """The streaming window count, over the table as a batch."""
    from ..streaming.landing import counts_by_window

    return counts_by_window(read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("value", F.col("value").cast("decimal(18,4)"))).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.col("total").cast("double").alias("total"))
