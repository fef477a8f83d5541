"""Trial data: form metadata, long items to records, edit checks, query ageing, test cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from .measures import upper_medians
from .tables import numbered

#: The study's code lists, visits, forms and items.
CODELISTS = {
    "NY": ("Y", "N"), "NYU": ("Y", "N", "U"), "SEX": ("F", "M", "U"), "AESEV": ("MILD", "MODERATE", "SEVERE"), "AEREL": ("NOT RELATED", "UNLIKELY", "POSSIBLE", "PROBABLE", "RELATED"),
    "AEOUT": ("RECOVERED", "RECOVERING", "NOT RECOVERED", "RECOVERED WITH SEQUELAE", "FATAL", "UNKNOWN"), "ARM": ("A", "B"),
}
#: (visit, number, label, study day, window in days)
VISITS = [("SCR", 1, "Screening", -14, 7), ("BASE", 2, "Baseline / Day 1", 1, 0), ("WK4", 3, "Week 4", 28, 3), ("WK12", 4, "Week 12", 84, 5), ("EOS", 5, "End of study", 168, 7)]
#: The forms of each visit.
VISIT_FORMS = {"SCR": ("DM", "IE", "VS", "MH"), "BASE": ("VS", "EX", "AE"), "WK4": ("VS", "EX", "AE", "CM"), "WK12": ("VS", "EX", "AE", "CM"), "EOS": ("VS", "AE", "CM", "DS")}
#: form: [(item, label, type, required, code list, low, high, unit)]
FORMS = {
    "DM": [("BRTHDAT", "Date of birth", "date", True, None, None, None, None), ("SEX", "Sex", "code", True, "SEX", None, None, None), ("RFICDAT", "Date of informed consent", "date", True, None, None, None, None), ("ARM", "Randomised arm", "code", True, "ARM", None, None, None)],
    "IE": [("IEYN", "All eligibility criteria met", "code", True, "NY", None, None, None), ("AGEELIG", "Age 18-75 inclusive", "code", True, "NY", None, None, None)],
    "VS": [("VSDAT", "Assessment date", "date", True, None, None, None, None), ("SYSBP", "Systolic BP", "number", True, None, 60, 250, "mmHg"), ("DIABP", "Diastolic BP", "number", True, None, 30, 150, "mmHg"), ("PULSE", "Pulse rate", "number", True, None, 30, 200, "beats/min"), ("TEMP", "Temperature", "number", False, None, 33.0, 43.0, "C"), ("WEIGHT", "Weight", "number", True, None, 30.0, 250.0, "kg")],
    "MH": [("MHTERM", "Reported condition", "text", True, None, None, None, None), ("MHSTDAT", "Start date", "date", False, None, None, None, None), ("MHONGO", "Ongoing", "code", True, "NY", None, None, None)],
    "EX": [("EXSTDAT", "Dose date", "date", True, None, None, None, None), ("EXDOSE", "Dose administered", "number", True, None, 0, 200, "mg"), ("EXADJ", "Dose adjusted", "code", True, "NY", None, None, None)],
    "AE": [("AETERM", "Adverse event (verbatim)", "text", True, None, None, None, None), ("AESTDAT", "Start date", "date", True, None, None, None, None), ("AEENDAT", "End date", "date", False, None, None, None, None), ("AESEV", "Severity", "code", True, "AESEV", None, None, None), ("AESER", "Serious", "code", True, "NY", None, None, None), ("AEREL", "Relationship to study drug", "code", True, "AEREL", None, None, None), ("AEOUT", "Outcome", "code", True, "AEOUT", None, None, None), ("AEACN", "Action taken with study drug", "text", False, None, None, None, None)],
    "CM": [("CMTRT", "Medication (verbatim)", "text", True, None, None, None, None), ("CMINDC", "Indication", "text", False, None, None, None, None), ("CMSTDAT", "Start date", "date", False, None, None, None, None)],
    "DS": [("DSCOMP", "Completed study", "code", True, "NY", None, None, None), ("DSTERM", "Reason for discontinuation", "text", False, None, None, None, None), ("DSSTDAT", "Date of completion / discontinuation", "date", True, None, None, None, None)],
}
#: Check -> (severity, protocol section, text; {x} stands for a value).
CHECKS = {
    "EC-REQ": ("query", "Section 8.1 Data collection", "{label} is required but was not entered. Please complete this field, or confirm the assessment was not performed and provide the reason."),
    "EC-RANGE": ("query", "Section 8.3 Range checks", "{label} was recorded as {value} {unit}, which is outside the expected range of {low} to {high} {unit}. Please verify against source and correct, or confirm the value is accurate."),
    "EC-CODE": ("query", "Section 8.2 Controlled terminology", "{label} contains '{value}', which is not a permitted value. Please select one of the permitted values: {allowed}."),
    "EC-VS-03": ("query", "Section 8.3 Vital signs consistency", "Systolic BP ({sbp} mmHg) is not greater than diastolic BP ({dbp} mmHg). Please verify against source; if the values were transposed, please correct both."),
    "EC-AE-01": ("query", "Section 9.2 Adverse event reporting", "The adverse event end date ({end}) is before the start date ({start}). Please verify both dates against source and correct."),
    "EC-AE-04": ("query", "Section 9.1 Definition of an adverse event", "The adverse event start date ({start}) is before the date of informed consent ({consent}). Please confirm the event start date, or confirm the event should be recorded as medical history instead."),
    "EC-AE-05": ("query", "Section 9.4 Serious adverse events", "This adverse event is recorded as serious, but no action taken with study drug has been entered. Please complete the action taken field."),
    "EC-AE-06": ("warning", "Section 9.2 Adverse event reporting", "The outcome is recorded as recovered/resolved but the event end date is blank. Please enter the date the event resolved."),
    "EC-DS-01": ("query", "Section 7.4 Subject withdrawal", "The subject is recorded as not having completed the study, but no reason for discontinuation was entered. Please provide the primary reason."),
    "EC-VISIT-01": ("warning", "Section 6.1 Schedule of assessments", "The {visit} visit was performed on {actual}, which is {days} day(s) outside the protocol window of +/-{window} days around study day {target}. Please confirm the visit date and complete a protocol deviation form."),
}
RECORD = ["site_id", "subject_id", "visit_id", "form_id", "record_num"]
ITEMS = [i[0] for items in FORMS.values() for i in items]


def metadata(spark: SparkSession) -> dict[str, DataFrame]:
    """Forms, visits and code lists as small tables."""
    items = [(f, n, *i) for f, own in FORMS.items() for n, i in enumerate(own)]
    kind = "form_id string, item_order int, item_oid string, label string, item_type string, required boolean, codelist string, low double, high double, unit string"
    rows = [(*r[:7], *(None if x is None else float(x) for x in r[7:9]), r[9]) for r in items]
    return {
        "items": spark.createDataFrame(rows, kind),
        "visits": spark.createDataFrame(VISITS, "visit_id string, visit_num int, visit string, day int, window int"),
        "codes": spark.createDataFrame([(k, v, i) for k, vs in CODELISTS.items() for i, v in enumerate(vs)], "codelist string, code string, code_order int"),
        "codelists": spark.createDataFrame([(k, ", ".join(v)) for k, v in CODELISTS.items()], "codelist string, allowed string"),
    }


def records(items: DataFrame, order: str = "ord") -> DataFrame:
    """Long items (RECORD, item_oid, value, order) to a row for each record: one column for each item, the last value wins, and the
    record's first place in the input (ord)."""
    values = [F.max_by(F.when(F.col("item_oid") == oid, F.col("value")), F.when(F.col("item_oid") == oid, F.col(order))).alias(oid) for oid in ITEMS]
    return items.groupBy(*RECORD).agg(F.min(order).alias("ord"), *values)


def _text(check: str, **values: Column) -> Column:
    out = F.lit(CHECKS[check][2])
    for name, c in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def _raised(df: DataFrame, check: str, item: Column, place: Column, **values: Column) -> DataFrame:
    severity, section, _ = CHECKS[check]
    return df.select(*RECORD, item.alias("item_oid"), F.lit(check).alias("check_id"), F.lit(severity).alias("severity"), F.lit(section).alias("protocol_ref"), _text(check, **values).alias("query_text"), "ord", place.cast("int").alias("place"))


def _number(c: Column) -> Column:
    """A number as people write it: no trailing zeros."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def universal_checks(rec: DataFrame, meta: dict[str, DataFrame]) -> DataFrame:
    """Required, range and code list checks, from the metadata: records meet their form's items."""
    long = rec.select(*RECORD, "ord", F.explode(F.map_from_arrays(F.array(*(F.lit(i) for i in ITEMS)), F.array(*(F.coalesce(F.col(i), F.lit("")) for i in ITEMS)))).alias("item_oid", "value"))
    v = long.join(F.broadcast(meta["items"]), ["form_id", "item_oid"]).join(F.broadcast(meta["codelists"]), "codelist", "left")  # both of fixed size
    v = v.withColumn("value", F.trim("value")).withColumn("num", F.col("value").try_cast("double"))
    codes = F.broadcast(meta["codes"].select("codelist", F.col("code").alias("value")))
    full = v.where("value != ''")
    odd = full.where("item_type = 'code'").join(codes, ["codelist", "value"], "left_anti")
    item, place = F.col("item_oid"), F.col("item_order")
    return reduce(DataFrame.unionByName, [
        _raised(v.where("required and value = ''"), "EC-REQ", item, place, label=F.col("label")),
        _raised(full.where("item_type = 'number' and num is null"), "EC-CODE", item, place, label=F.col("label"), value=F.col("value"), allowed=F.lit("a numeric value")),
        _raised(full.where("item_type = 'number' and not (num between low and high)"), "EC-RANGE", item, place, label=F.col("label"), value=F.col("value"), unit=F.col("unit"), low=_number(F.col("low")), high=_number(F.col("high"))),
        _raised(odd, "EC-CODE", item, place, label=F.col("label"), value=F.col("value"), allowed=F.col("allowed")),
    ])


def cross_checks(rec: DataFrame, subjects: DataFrame) -> DataFrame:
    """Checks between fields of a record. Values that are no numbers are left to EC-CODE."""
    has = lambda c: ~C.blank(F.col(c))
    vs = rec.where("form_id = 'VS'")
    ae = rec.where("form_id = 'AE'").join(subjects.select("subject_id", "consent_date"), "subject_id", "left")
    ds = rec.where("form_id = 'DS'")
    at = lambda k: F.lit(100 + k)
    start, end = F.col("AESTDAT"), F.col("AEENDAT")
    return reduce(DataFrame.unionByName, [
        _raised(vs.where(F.col("SYSBP").try_cast("double") <= F.col("DIABP").try_cast("double")), "EC-VS-03", F.lit("SYSBP"), at(0), sbp=F.col("SYSBP"), dbp=F.col("DIABP")),
        _raised(ae.where(has("AESTDAT") & has("AEENDAT") & (end < start)), "EC-AE-01", F.lit("AEENDAT"), at(1), start=start, end=end),
        _raised(ae.where(has("AESTDAT") & (start < F.col("consent_date"))), "EC-AE-04", F.lit("AESTDAT"), at(2), start=start, consent=F.col("consent_date")),
        _raised(ae.where((F.col("AESER") == "Y") & C.blank(F.col("AEACN"))), "EC-AE-05", F.lit("AEACN"), at(3)),
        _raised(ae.where((F.col("AEOUT") == "RECOVERED") & C.blank(end)), "EC-AE-06", F.lit("AEENDAT"), at(4)),
        _raised(ds.where((F.col("DSCOMP") == "N") & C.blank(F.col("DSTERM"))), "EC-DS-01", F.lit("DSTERM"), at(5)),
    ])


def visit_checks(rec: DataFrame, subjects: DataFrame, meta: dict[str, DataFrame]) -> DataFrame:
    """Visits outside their window, by the first dated record of each visit. Such a query belongs to the visit: form, record and item
    are empty."""
    dated = rec.withColumn("actual", F.coalesce(*(C.filled(F.col(c)) for c in ("VSDAT", "EXSTDAT", "DSSTDAT")))).where("actual is not null")
    first = dated.groupBy("subject_id", "visit_id").agg(F.min_by(F.struct("site_id", "actual"), "ord").alias("r"), F.min("ord").alias("ord"))
    v = first.select("subject_id", "visit_id", "r.site_id", "r.actual", "ord").join(F.broadcast(meta["visits"]), "visit_id").join(subjects.select("subject_id", "baseline_date"), "subject_id")
    target = F.date_add(C.calendar_date(F.col("baseline_date")), F.col("day") - 1)
    v = v.withColumn("off", F.abs(F.datediff(C.calendar_date(F.col("actual")), target))).where(F.col("off") > F.col("window"))
    v = v.withColumn("form_id", F.lit("")).withColumn("record_num", F.lit(""))
    return _raised(v, "EC-VISIT-01", F.lit(""), F.lit(0), visit=F.col("visit"), actual=F.col("actual"), days=F.col("off") - F.col("window"), window=F.col("window"), target=F.col("day"))


def missing_forms(rec: DataFrame, subjects: DataFrame, expected: DataFrame) -> DataFrame:
    """(subject_id, visit_id, form_id) that the schedule expects and no record has; an extra that EC-REQ can't see."""
    return subjects.select("subject_id").crossJoin(F.broadcast(expected.select("visit_id", "form_id"))).join(rec.select("subject_id", "visit_id", "form_id"), ["subject_id", "visit_id", "form_id"], "left_anti")


def run_checks(items: DataFrame, subjects: DataFrame) -> DataFrame:
    """All queries, numbered Q00001 on: visit checks by subject and visit, then records in input order, items before cross checks."""
    meta = metadata(items.sparkSession)
    rec = records(items)
    visit = visit_checks(rec, subjects, meta).withColumn("phase", F.lit(0))
    form = universal_checks(rec, meta).unionByName(cross_checks(rec, subjects)).withColumn("phase", F.lit(1))
    both = visit.withColumn("ord", F.lit(0).cast("long")).unionByName(form.withColumn("ord", F.col("ord").cast("long")))
    order = [F.col("phase"), F.col("ord"), F.when(F.col("phase") == 0, F.col("subject_id")), F.when(F.col("phase") == 0, F.col("visit_id")), F.col("place"), F.col("check_id")]
    return numbered(both, order, "_n").withColumn("query_id", F.format_string("Q%05d", "_n")).select("query_id", *RECORD, "item_oid", "check_id", "severity", "protocol_ref", "query_text")


def age_band(days: Column) -> Column:
    out = None
    for top, name in ((7, "0-7 days"), (14, "8-14 days"), (30, "15-30 days"), (60, "31-60 days")):
        out = F.when(days <= top, name) if out is None else out.when(days <= top, name)
    return F.when(days.isNull(), None).otherwise(out.otherwise("60+ days"))


def query_log(queries: DataFrame, dates: DataFrame, cut: str = "2026-07-30") -> DataFrame:
    """Queries with their dates (query_id, issued_date, closed_date): status, days to close, age at the data cut and its band."""
    q = queries.join(dates, "query_id")
    q = q.withColumn("status", F.when(F.col("closed_date").isNull(), "open").otherwise("closed")).withColumn("days_to_close", F.datediff("closed_date", "issued_date"))
    q = q.withColumn("age_days", F.when(F.col("closed_date").isNull(), F.datediff(F.lit(cut).cast("date"), F.col("issued_date"))))
    return q.withColumn("age_band", age_band(F.col("age_days")))


def query_ledger(log: DataFrame) -> DataFrame:
    """Queries by status, open before closed, then by age, the oldest first, with their place; those without an age come last."""
    shown = log.select("query_id", "site_id", "subject_id", "check_id", "severity", "status", "age_days", "query_text")
    return numbered(shown, [F.desc("status"), F.desc_nulls_last("age_days"), F.col("query_id")], "place")


def site_performance(log: DataFrame) -> DataFrame:
    """Raised, open, closed, share closed and (upper) median days to close for each site."""
    closed = F.col("status") == "closed"
    median = upper_medians(log.where(closed), ["site_id"], "days_to_close", "median_days_to_close")
    counts = log.groupBy("site_id").agg(
        F.count("*").alias("queries_raised"), F.count_if(~closed).alias("queries_open"), F.count_if(closed).alias("queries_closed"), C.ratio(F.count_if(closed), F.count("*"), 4).alias("close_rate"))
    return counts.join(median, "site_id", "left")


def test_cases(spark: SparkSession) -> DataFrame:
    """The acceptance plan from the metadata: each form, item, code item and visit, two cases for each check (raises, stays silent), and what
    any such system must do. What testers fill in is empty."""
    rows = []
    for form, items in FORMS.items():
        rows.append(("Form rendering", form, f"Form {form} shows its items", f"Open form {form} for a test subject", f"{len(items)} items, labelled and ordered as specified"))
        rows += [("Data entry", f"{form}.{oid}", f"{label} takes a valid value", f"Enter a valid {kind} value in {label}, save, leave the form and come back", "The value is shown as entered") for oid, label, kind, *_ in items]
    for form, items in FORMS.items():
        rows += [("Controlled terminology", f"{form}.{oid}", f"{label} offers its permitted values only", f"Open the list of {label}", f"Exactly: {', '.join(CODELISTS[codes])}") for oid, label, kind, _, codes, *_ in items if kind == "code"]
    for check, (severity, section, _) in CHECKS.items():
        rows.append(("Edit check (positive)", check, f"{check} raises a query", f"Enter data that {check} ({section}) forbids", f"A query of severity {severity} with the specified text"))
        rows.append(("Edit check (negative)", check, f"{check} stays silent", f"Enter valid data in the fields of {check}", "No query"))
    rows += [("Visit structure", visit, f"{label} has its forms", f"Go to {label} for a test subject", f"Exactly: {', '.join(VISIT_FORMS[visit])}") for visit, _, label, *_ in VISITS]
    rows += [
        ("Audit trail", "System", "Changes leave a trail", "Enter a value, save, change it, save; open the trail", "Old and new value, each with user, time and reason"),
        ("Access control", "System", "Roles are kept", "Log in as a monitor who may only read; try to enter data", "The record is shown, entry is refused"),
        ("Query workflow", "System", "Queries go from open to answered to closed", "Answer an open query as the site, close it as data management", "Each step by its role only, and in the trail"),
        ("Extract integrity", "System", "The extract equals what is shown", "Extract the study; compare 20 records with the screens", "All fields of all 20 are equal"),
    ]
    names = "test_id string, category string, object string, objective string, steps string, expected_result string, actual_result string, pass_fail string, tester string, date string"
    return spark.createDataFrame([(f"UAT-{i:03d}", *r, "", "", "", "") for i, r in enumerate(rows, 1)], names)
