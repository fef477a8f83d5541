"""Queries that run trial records through pivot, edit checks, coding and tabulation, with SQL over the driver's tables.

Customers are subjects with a demographics, a vital signs and a disposition record, orders are their adverse events; some values are
faulty on purpose, by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coding, edc, sdtm

CONSENT, BASELINE = "1998-01-01", "2026-02-01"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("B")
    site, subject = (F.concat(F.lit(p), F.col(c).cast("string")) for p, c in (("site-", "c_nationkey"), ("S", "c_custkey")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(subject.alias("subject_id"), site.alias("site_id"), F.lit(CONSENT).alias("consent_date"), arm.alias("arm"), F.lit(BASELINE).alias("baseline_date"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long items (edc.RECORD, item_oid, value, ord)."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    n, k = F.col("c_custkey"), F.col("o_orderkey")
    text = lambda x: x.cast("string")
    born = F.date_add(F.lit("1930-01-01").cast("date"), (n % 800 * 37).cast("int"))
    records = {
        ("SCR", "DM"): {"BRTHDAT": F.when(n % 15 == 4, "").otherwise(text(born)), "SEX": F.when(n % 20 == 3, "X").when(n % 2 == 0, "F").otherwise("M"), "RFICDAT": F.lit(CONSENT), "ARM": F.when(n % 2 == 0, "A").otherwise("B")},
        ("WK4", "VS"): {"VSDAT": text(F.date_add(F.lit(BASELINE).cast("date"), (n % 9 + 27).cast("int"))), "SYSBP": text(n % 180 + 90), "DIABP": text(n % 60 + 80), "PULSE": F.when(n % 33 == 5, "fast").otherwise("70"), "TEMP": F.lit(""), "WEIGHT": F.lit("70")},
        ("EOS", "DS"): {"DSCOMP": F.when(n % 9 == 2, "N").otherwise("Y"), "DSTERM": F.when(n % 18 == 2, "withdrew").otherwise(""), "DSSTDAT": F.lit("2026-07-18")},
    }
    start = F.to_date("o_orderdate")
    event = {
        "AETERM": F.when(k % 5 == 0, "Head-ache").when(k % 5 == 1, "head ache").when(k % 5 == 2, "BP high").when(k % 5 == 3, "odd feeling").otherwise("NAUSEA "), "AESTDAT": text(start),
        "AEENDAT": F.when(k % 5 == 0, "").when(k % 7 == 0, text(F.date_sub(start, 1))).otherwise(text(F.date_add(start, 3))), "AESEV": F.lit("MILD"), "AESER": F.when(k % 6 == 0, "Y").otherwise("N"), "AEREL": F.lit("RELATED"),
        "AEOUT": F.when(k % 4 == 0, "RECOVERED").otherwise("UNKNOWN"), "AEACN": F.when(k % 12 == 0, "").otherwise("DOSE REDUCED"),
    }

    def long(df: DataFrame, visit: str, form: str, record: Column, base: Column, values: dict[str, Column]) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(i).alias("item_oid"), v.alias("value"), F.lit(at).alias("at")) for at, (i, v) in enumerate(values.items())))
        head = df.select(F.concat(F.lit("site-"), text(F.col("c_nationkey"))).alias("site_id"), F.concat(F.lit("S"), text(n)).alias("subject_id"), F.lit(visit).alias("visit_id"), F.lit(form).alias("form_id"), record.alias("record_num"), base.alias("base"), F.inline(pairs))
        return head.select(*edc.RECORD, "item_oid", "value", (F.col("base") + F.col("at")).alias("ord"))

    out = long(o, "WK4", "AE", text(k), k * 100 + 50, event)
    for place, ((visit, form), values) in enumerate(records.items()):
        out = out.unionByName(long(c, visit, form, F.lit("1"), n * 100 + place * 10, values))
    return out


BASE = f"""
with subj as (select 'S' || c_custkey as subject_id, c_custkey as n, 'site-' || c_nationkey as site_id, (date '1930-01-01' + (c_custkey % 800 * 37)::int)::varchar as born, c_custkey % 180 + 90 as sbp, c_custkey % 60 + 80 as dbp from customer),
ae as (select 'S' || o_custkey as subject_id, o_orderkey::varchar as record_num, o_orderkey as k, ['Head-ache', 'head ache', 'BP high', 'odd feeling', 'NAUSEA '][o_orderkey % 5 + 1] as term, o_orderdate::date::varchar as started,
  case when o_orderkey % 5 = 0 then '' when o_orderkey % 7 = 0 then (o_orderdate::date - 1)::varchar else (o_orderdate::date + 3)::varchar end as ended, case when o_orderkey % 6 = 0 then 'Y' else 'N' end as serious,
  case when o_orderkey % 4 = 0 then 'RECOVERED' else 'UNKNOWN' end as outcome, case when o_orderkey % 12 = 0 then '' else 'DOSE REDUCED' end as action from orders join customer on c_custkey = o_custkey),
codes(term, status, coded) as (values ('Head-ache', 'auto', 'Headache'), ('head ache', 'synonym', 'Headache'), ('BP high', 'ambiguous', 'Hypertension | Blood pressure increased'), ('odd feeling', 'uncoded', ''), ('NAUSEA ', 'auto', 'Nausea')),
universal as (select subject_id, 'DM' as form_id, 'BRTHDAT' as item_oid, 'EC-REQ' as check_id, 'Date of birth is required but was not entered. Please complete this field, or confirm the assessment was not performed and provide the reason.' as query_text from subj where n % 15 = 4
  union all select subject_id, 'DM', 'SEX', 'EC-CODE', 'Sex contains ''X'', which is not a permitted value. Please select one of the permitted values: F, M, U.' from subj where n % 20 = 3
  union all select subject_id, 'VS', 'PULSE', 'EC-CODE', 'Pulse rate contains ''fast'', which is not a permitted value. Please select one of the permitted values: a numeric value.' from subj where n % 33 = 5
  union all select subject_id, 'VS', 'SYSBP', 'EC-RANGE', 'Systolic BP was recorded as ' || sbp || ' mmHg, which is outside the expected range of 60 to 250 mmHg. Please verify against source and correct, or confirm the value is accurate.' from subj where sbp > 250),
crossed as (select subject_id, '1' as record_num, 'SYSBP' as item_oid, 'EC-VS-03' as check_id from subj where sbp <= dbp
  union all select subject_id, record_num, 'AEENDAT', 'EC-AE-01' from ae where ended <> '' and ended < started union all select subject_id, record_num, 'AESTDAT', 'EC-AE-04' from ae where started < '{CONSENT}'
  union all select subject_id, record_num, 'AEACN', 'EC-AE-05' from ae where serious = 'Y' and action = '' union all select subject_id, record_num, 'AEENDAT', 'EC-AE-06' from ae where outcome = 'RECOVERED' and ended = ''
  union all select subject_id, '1', 'DSTERM', 'EC-DS-01' from subj where n % 9 = 2 and n % 18 <> 2),
visit as (select subject_id, 'WK4' as visit_id, 'The Week 4 visit was performed on ' || (date '{BASELINE}' + (n % 9 + 27)::int)::varchar || ', which is ' || (n % 9 - 3) || ' day(s) outside the protocol window of +/-3 days around study day 28. Please confirm the visit date and complete a protocol deviation form.' as query_text from subj where n % 9 > 3)
"""


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = BASE + sql
        return f

    return add


@_query("select subject_id, 'DM' as form_id, born_or_blank as a, case when n % 20 = 3 then 'X' when n % 2 = 0 then 'F' else 'M' end as b from (select *, case when n % 15 = 4 then '' else born end as born_or_blank from subj) union all select subject_id, 'VS', sbp::varchar, dbp::varchar from subj union all select subject_id, 'AE', term, started from ae")
def edc_records(spark, sf_dir):
    """Two items of each record."""
    r = edc.records(items(spark, sf_dir)).where("form_id in ('DM', 'VS', 'AE')")
    of = lambda dm, vs, ae: F.when(F.col("form_id") == "DM", F.col(dm)).when(F.col("form_id") == "VS", F.col(vs)).otherwise(F.col(ae))
    return r.select("subject_id", "form_id", of("BRTHDAT", "SYSBP", "AETERM").alias("a"), of("SEX", "DIABP", "AESTDAT").alias("b"))


@_query("select * from universal")
def edc_universal_checks(spark, sf_dir):
    """EC-REQ, EC-RANGE and EC-CODE, with their texts."""
    return edc.universal_checks(edc.records(items(spark, sf_dir)), edc.metadata(spark)).select("subject_id", "form_id", "item_oid", "check_id", "query_text")


@_query("select * from crossed")
def edc_cross_checks(spark, sf_dir):
    """Checks between items of a record."""
    return edc.cross_checks(edc.records(items(spark, sf_dir)), subjects(spark, sf_dir)).select("subject_id", "record_num", "item_oid", "check_id")


@_query("select * from visit")
def edc_visit_checks(spark, sf_dir):
    """Visits outside their window."""
    return edc.visit_checks(edc.records(items(spark, sf_dir)), subjects(spark, sf_dir), edc.metadata(spark)).select("subject_id", "visit_id", "query_text")


@_query("select check_id, count(*) as n, sum(count(*)) over () as last_id from (select check_id from universal union all select check_id from crossed union all select 'EC-VISIT-01' from visit) group by check_id")
def edc_queries_raised(spark, sf_dir):
    """All queries by check, and the last number given."""
    q = edc.run_checks(items(spark, sf_dir), subjects(spark, sf_dir))
    last = q.agg(F.max(F.substr("query_id", F.lit(2)).cast("long")).alias("last_id"))
    return q.groupBy("check_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(last))


@_query("""select form_id, k as items, k * n as collected from (select 'DM' as form_id, 4 as k, count(*) as n from subj union all select 'VS', 6, count(*) from subj union all select 'DS', 3, count(*) from subj union all select 'AE', 8, count(*) from ae)""")
def edc_form_items(spark, sf_dir):
    """Forms with the items that they have by the metadata, and the values collected for those."""
    own = edc.metadata(spark)["items"].select("form_id", "item_oid")
    kept = items(spark, sf_dir).join(F.broadcast(own), ["form_id", "item_oid"])
    return kept.groupBy("form_id").agg(F.count("*").alias("collected")).join(own.groupBy("form_id").agg(F.count("*").alias("items")), "form_id").select("form_id", "items", "collected")


@_query(f"""select 'STUDY01-' || subject_id as "USUBJID", site_id as "SITEID", case when n % 15 = 4 then '' else born end as "BRTHDTC", case when n % 15 <> 4 then (year(date '{CONSENT}') - year(born::date) - (strftime(date '{CONSENT}', '%m%d') < strftime(born::date, '%m%d'))::int)::int end as "AGE",
  case when n % 20 = 3 then 'X' when n % 2 = 0 then 'F' else 'M' end as "SEX", case when n % 2 = 0 then 'A' else 'B' end as "ARMCD", case when n % 2 = 0 then 'Investigational product' else 'Placebo' end as "ARM" from subj""")
def sdtm_dm(spark, sf_dir):
    return sdtm.dm(edc.records(items(spark, sf_dir)), subjects(spark, sf_dir)).select("USUBJID", "SITEID", "BRTHDTC", "AGE", "SEX", "ARMCD", "ARM")


def _coded(spark: SparkSession, rec: DataFrame) -> DataFrame:
    terms = rec.where("form_id = 'AE' and trim(AETERM) != ''").select(F.col("AETERM").alias("verbatim"), "ord")
    return coding.code_terms(terms, "verbatim", coding.dictionary(spark, coding.REACTIONS, own=True), coding.dictionary(spark, coding.REACTION_SYNONYMS), coding.dictionary(spark, coding.REACTION_AMBIGUOUS))


@_query("""select 'STUDY01-' || subject_id as "USUBJID", row_number() over (partition by subject_id order by started, term, record_num) as "AESEQ", term as "AETERM", coded as "AEDECOD", started as "AESTDTC", ended as "AEENDTC", serious as "AESER", 'Week 4' as "VISIT", 3 as "VISITNUM" from ae join codes using (term)""")
def sdtm_ae(spark, sf_dir):
    """Adverse events numbered within the subject, with their coded terms."""
    rec = edc.records(items(spark, sf_dir))
    return sdtm.ae(rec, _coded(spark, rec)).select("USUBJID", F.col("AESEQ").cast("long").alias("AESEQ"), "AETERM", "AEDECOD", "AESTDTC", "AEENDTC", "AESER", "VISIT", "VISITNUM")


@_query("""select 'STUDY01-' || subject_id as "USUBJID", seq as "VSSEQ", code as "VSTESTCD", case code when 'SYSBP' then sbp::varchar when 'DIABP' then dbp::varchar when 'PULSE' then case when n % 33 = 5 then 'fast' else '70' end else '70' end as "VSORRES", unit as "VSORRESU"
  from subj, (values (1, 'SYSBP', 'mmHg'), (2, 'DIABP', 'mmHg'), (3, 'PULSE', 'beats/min'), (4, 'WEIGHT', 'kg')) as t(seq, code, unit)""")
def sdtm_vs(spark, sf_dir):
    """Vital signs, a row for each result."""
    return sdtm.vs(edc.records(items(spark, sf_dir))).select("USUBJID", F.col("VSSEQ").cast("int").alias("VSSEQ"), "VSTESTCD", "VSORRES", "VSORRESU")


@_query("""select * from (select 'DM' as domain, 'SEX is required' as rule, 'error' as severity, count(*) as records from subj where n % 20 = 3 union all select 'AE', 'AESEQ must be unique within USUBJID', 'error', sum(k - 1)::bigint from (select count(*) as k from ae group by subject_id having count(*) > 1)
  union all select 'AE', 'AESTDTC must be ISO 8601 (YYYY-MM-DD)', 'error', count(*) from ae where k % 10 = 1) where records > 0""")
def sdtm_conformance(spark, sf_dir):
    """Broken rules of DM without some sexes, and of AE with one number for all and some odd dates."""
    rec = edc.records(items(spark, sf_dir))
    dm = sdtm.dm(rec, subjects(spark, sf_dir)).withColumn("SEX", F.when(F.col("SEX") != "X", F.col("SEX")).otherwise(""))
    odd = rec.withColumn("AESTDAT", F.when((F.col("form_id") == "AE") & (F.col("record_num").cast("long") % 10 == 1), "2020/1").otherwise(F.col("AESTDAT")))
    return sdtm.conformance("DM", dm).unionByName(sdtm.conformance("AE", sdtm.ae(odd).withColumn("AESEQ", F.lit(1))))


@_query("select term as verbatim, status, coded, count(*) as n from ae join codes using (term) group by all")
def coding_status(spark, sf_dir):
    """Terms by how they were coded."""
    return _coded(spark, edc.records(items(spark, sf_dir))).groupBy("verbatim", "status", "coded").agg(F.count("*").alias("n"))


@_query("select term as verbatim, status, count(*) as records_blocked, row_number() over (order by count(*) desc, min(k)) as place from ae join codes using (term) where status in ('ambiguous', 'uncoded') group by all")
def coding_open_terms(spark, sf_dir):
    """What coders have to decide, by the records blocked."""
    work = coding.worklist(_coded(spark, edc.records(items(spark, sf_dir))).withColumn("dictionary", F.lit("MedDRA")), "verbatim", "ord")
    return work.select("verbatim", "status", "records_blocked", F.col("place").cast("long").alias("place"))
