"""Queries of sources and of the reports over cohorts: files made of the driver's tables are written, read back by the library's readers,
and reported on, with SQL over those tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import sql as sql_functions
from ..operators import cohorts, edc, gate
from ..shared import fresh_path
from ..sources import documents, files

QUERIES: dict = {}
SQL: dict[str, str] = {}
BUNDLE = 4


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
select case when s_suppkey % 10 = 9 then null else 'prac-' || s_suppkey end as resource_id, (s_suppkey % 4 + 1)::bigint as line_number,
  case when s_suppkey % 10 = 9 then 'parse' when s_suppkey % 4 = 3 then 'schema' end as failure_stage, case when s_suppkey % 10 = 9 then 'document: not valid JSON' when s_suppkey % 4 = 3 then 'gender: outside the value set' end as reason,
  case when s_suppkey % 10 = 9 then 'bundle entry has no resource' end as detail from supplier
union all select 'org-' || n_nationkey, 1, case when n_nationkey % 10 = 9 then 'constraint' end, case when n_nationkey % 10 = 9 then 'name: org-1 asks for a name' end, null from nation""")
def bundle_documents(spark, sf_dir):
    """Practitioners in Bundles, some without a resource or with an odd gender, and organizations as single documents, one in each file."""
    root = fresh_path(spark, "bundles")
    s = F.col("s_suppkey")
    gender = F.when(s % 4 == 3, "unsaid").when(s % 2 == 0, "female").otherwise("male")
    resource = F.to_json(F.struct(F.lit("Practitioner").alias("resourceType"), F.concat(F.lit("prac-"), s.cast("string")).alias("id"), gender.alias("gender")))
    entry = F.when(s % 10 == 9, "{}").otherwise(F.concat(F.lit('{"resource": '), resource, F.lit("}")))
    bundles = _read(spark, sf_dir, "supplier").groupBy(F.floor(s / BUNDLE).alias("b")).agg(F.array_sort(F.collect_list(F.struct(s.alias("k"), entry.alias("e")))).alias("x"))
    bundles.select(F.concat(F.lit('{"resourceType": "Bundle", "entry": ['), F.array_join("x.e", ", "), F.lit("]}")).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{root}/practitioners")
    n = F.col("n_nationkey")
    organization = F.struct(F.lit("Organization").alias("resourceType"), F.concat(F.lit("org-"), n.cast("string")).alias("id"), F.when(n % 10 != 9, F.col("n_name")).alias("name"))
    _read(spark, sf_dir, "nation").select(F.to_json(organization).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{root}/organizations")
    accepted, rejected = gate.validate(documents.read_bundles(spark, [f"{root}/practitioners", f"{root}/organizations"]))
    none = [F.lit(None).cast("string").alias(c) for c in ("failure_stage", "reason", "detail")]
    return accepted.select("resource_id", "line_number", *none).unionByName(rejected.select("resource_id", "line_number", "failure_stage", "reason", "detail"))


_SUBJECTS = """
with subj as (select c_custkey as n, 'S' || c_custkey as subject_id, 'site-' || c_nationkey as site_id, date '2026-01-01' + (c_custkey % 90)::int as consent, case when c_custkey % 2 = 0 then 'A' else 'B' end as arm, (c_custkey % 3 <> 0)::int::varchar as completed, 20 + c_custkey % 60 as age from customer),
ae as (select 'S' || o_custkey as subject_id, case when o_orderkey % 6 = 0 then 'Y' else 'N' end as serious, o_orderkey from orders)
"""


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that went through a CSV file; the baseline is blank, and some sites' names hold commas and quotes."""
    n = F.col("c_custkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    made = _read(spark, sf_dir, "customer").select(
        text("S", "c_custkey").alias("subject_id"), F.when(F.col("c_nationkey") % 5 == 0, F.concat(text("site-", "c_nationkey"), F.lit(', "main"'))).otherwise(text("site-", "c_nationkey")).alias("site_id"),
        F.date_add(F.lit("2026-01-01").cast("date"), (n % 90).cast("int")).cast("string").alias("consent_date"), F.when(n % 2 == 0, "A").otherwise("B").alias("arm"), F.lit("").alias("baseline_date"), (n % 3 != 0).cast("int").cast("string").alias("completed"),
    )
    at = fresh_path(spark, "subjects")
    made.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(at)
    return files.read_subjects(spark, at)


@query(_SUBJECTS + """
select site_id || case when replace(site_id, 'site-', '')::int % 5 = 0 then ', "main"' else '' end as site_id, count(*) as subjects, count(*) filter (arm = 'A') as arm_a, count(*) filter (arm = 'B') as arm_b, count(*) filter (completed = '1') as completed, min(consent)::varchar as first_consent, max(consent)::varchar as last_consent from subj group by 1""")
def csv_subjects(spark, sf_dir):
    """The table of sites, from a subjects' file."""
    return cohorts.site_table(_subjects(spark, sf_dir).where("baseline_date = ''"))


@query(_SUBJECTS + """
, m as (select site_id || case when replace(site_id, 'site-', '')::int % 5 = 0 then ', "main"' else '' end as site_id, date_trunc('month', consent)::date as month, count(*) as n from subj group by all)
select *, sum(n) over (partition by site_id order by month)::bigint as running from m""")
def enrolment_by_month(spark, sf_dir):
    return cohorts.enrolment(_subjects(spark, sf_dir))


@query(_SUBJECTS + """
select 'median age' as measure, median(age)::double as value from subj union all select 'least age', min(age) from subj union all select 'greatest age', max(age) from subj
union all select 'share completed', round(avg((completed = '1')::int), 6) from subj union all select 'share serious', round(avg((serious = 'Y')::int), 6) from ae""")
def cohort_tiles(spark, sf_dir):
    """What a cohort's tiles show."""
    dm = _read(spark, sf_dir, "customer").select((F.col("c_custkey") % 60 + 20).alias("AGE"))
    ae = _read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 6 == 0, "Y").otherwise("N").alias("AESER"))
    return cohorts.tiles(dm, _subjects(spark, sf_dir), ae).withColumn("value", F.round("value", 6))


@query(_SUBJECTS + """
, e as (select s.arm, serious, count(*) as events, count(distinct a.subject_id) as subjects from ae a left join subj s using (subject_id) group by all)
select arm, serious, 'events' as kind, events as n from e union all select arm, serious, 'subjects', subjects from e""")
def events_by_arm(spark, sf_dir):
    """Events with their subject's one DM row, counted by arm, in the long form of charts."""
    dm = _subjects(spark, sf_dir).select(F.col("subject_id").alias("USUBJID"), "arm")
    ae = _read(spark, sf_dir, "orders").select(F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("USUBJID"), F.when(F.col("o_orderkey") % 6 == 0, "Y").otherwise("N").alias("serious"))
    counts = cohorts.enriched(ae, dm, ["arm"]).groupBy("arm", "serious").agg(F.count("*").alias("events"), F.countDistinct("USUBJID").alias("subjects"))
    return cohorts.long_form(counts, ["arm", "serious"], ["events", "subjects"])


@query("""
select o_orderkey, case when o_orderkey % 3 = 0 then null else 'c-' || o_custkey end as patient, 2026 - year(o_orderdate::date) as years, regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9 ]', '', 'g') as term, date_diff('minute', o_orderdate::timestamp, o_orderdate::timestamp + to_seconds((o_orderkey % 1000)::int)) as minutes from orders""")
def sql_library_functions(spark, sf_dir):
    """The library's rules called as SQL functions, one of them as a table function."""
    sql_functions.register(spark)
    _read(spark, sf_dir, "orders").createOrReplaceTempView("medlattice_orders")
    return spark.sql("""
        select o_orderkey, r.id as patient, age_years(cast(o_orderdate as date), date'2026-08-01') as years, coded_term(o_orderpriority) as term,
          minutes_passed(cast(o_orderdate as timestamp), cast(o_orderdate as timestamp) + make_interval(0, 0, 0, 0, 0, 0, o_orderkey % 1000)) as minutes
        from medlattice_orders, lateral reference_ids(case when o_orderkey % 3 = 0 then concat('Patient?identifier=x|', o_custkey) else concat('Patient/c-', o_custkey) end) r""")


@query("select event_id, round(value / 1000, 6) as parsed from events")
def scientific_notation(spark, sf_dir):
    """Values written with an exponent, read as exact decimals."""
    e = _read(spark, sf_dir, "events")
    return e.select("event_id", F.round(C.exact_decimal(F.concat(F.col("value").cast("string"), F.lit("E-3"))).cast("double"), 6).alias("parsed"))


@query("""
with l as (select 'Q' || o_orderkey as query_id, case when o_orderstatus = 'F' then 'closed' else 'open' end as status, case when o_orderstatus = 'F' then null else o_orderkey % 90 end as age_days from orders)
select query_id, status, age_days, row_number() over (order by status desc, age_days desc nulls last, query_id) as place from l""")
def query_ledger(spark, sf_dir):
    """The ledger of queries: by status, then the oldest first."""
    o = _read(spark, sf_dir, "orders")
    closed = F.col("o_orderstatus") == "F"
    text = lambda c: F.col(c).cast("string")
    log = o.select(F.concat(F.lit("Q"), text("o_orderkey")).alias("query_id"), F.when(closed, "closed").otherwise("open").alias("status"), F.when(~closed, F.col("o_orderkey") % 90).alias("age_days"),
        text("o_custkey").alias("subject_id"), F.lit("site").alias("site_id"), F.lit("EC-REQ").alias("check_id"), F.lit("query").alias("severity"), F.col("o_orderpriority").alias("query_text"))
    return edc.query_ledger(log).select("query_id", "status", "age_days", "place")
