"""Scalar rules of the warehouse as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_END, FIRST_DAY = "9999-12-31", "1900-01-01"
#: Encounter classes and what they are called in reports.
INPATIENT = ("IMP", "ACUTE", "NONAC")
CARE_SETTINGS = {
    "Inpatient": INPATIENT,
    "Emergency": ("EMER",),
    "Ambulatory": ("AMB", "OBSENC", "PRENC", "SS"),
    "Virtual": ("VR",),
    "Home": ("HH",),
    "Other": ("FLD",),
}
CLASS_DISPLAY = {
    "AMB": "ambulatory", "EMER": "emergency", "FLD": "field", "HH": "home health", "IMP": "inpatient encounter", "ACUTE": "inpatient acute",
    "NONAC": "inpatient non-acute", "OBSENC": "observation encounter", "PRENC": "pre-admission", "SS": "short stay", "VR": "virtual",
}


def blank(c: Column) -> Column:
    """True for null and for text without a visible character."""
    return F.coalesce(F.trim(c), F.lit("")) == ""


def filled(c: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def joined(*cols: Column) -> Column:
    """Texts one after another, null counting as empty."""
    return F.concat_ws("", *cols)


def literal_reference(ref: Column) -> Column:
    """The id of `Type/id`, an absolute url or `urn:uuid:id`; null for conditional references and for what is none of these."""
    plain = F.when(ref.contains("?"), F.lit(None)).when(ref.startswith("urn:uuid:"), F.substr(ref, F.lit(10))).when(ref.contains("/"), F.substring_index(ref, "/", -1))
    return F.when(plain.rlike(r"^[A-Za-z0-9\-.]{1,64}$"), plain)


def reference_type(ref: Column) -> Column:
    return F.nullif(F.regexp_extract(ref, r"(?:^|/)([A-Z][A-Za-z]+)(?:/[A-Za-z0-9\-.]{1,64}$|\?identifier=)", 1), F.lit(""))


def conditional_reference(ref: Column) -> tuple[Column, Column]:
    """(system, value) of `Type?identifier=system|value`; nulls for other references."""
    part = lambda i: F.nullif(F.regexp_extract(ref, r"^[A-Z][A-Za-z]+\?identifier=([^|]*)\|(.+)$", i), F.lit(""))
    return part(1), part(2)


def reference_kind(ref: Column) -> Column:
    """literal, absolute, conditional, urn or unparseable."""
    return (
        F.when(ref.rlike(r"^[A-Z][A-Za-z]+\?identifier=[^|]*\|.+$"), "conditional")
        .when(ref.rlike(r"^https?://.+/[A-Z][A-Za-z]+/[A-Za-z0-9\-.]{1,64}$"), "absolute")
        .when(ref.rlike(r"^[A-Z][A-Za-z]+/[A-Za-z0-9\-.]{1,64}$"), "literal")
        .when(ref.rlike(r"^urn:uuid:[A-Za-z0-9\-.]{1,64}$"), "urn")
        .otherwise("unparseable")
    )


def instant(text: Column) -> Column:
    """A date-time text with or without offset as a zone-less UTC timestamp cut to milliseconds; null where it can't be read."""
    return F.date_trunc("MILLISECOND", F.try_to_timestamp(text)).cast("timestamp_ntz")


def calendar_date(text: Column) -> Column:
    return text.try_cast("date")


def years_by_boundary(start: Column, end: Column) -> Column:
    return F.year(end) - F.year(start)


def completed_years(start: Column, end: Column) -> Column:
    before = F.struct(F.month(end), F.dayofmonth(end)) < F.struct(F.month(start), F.dayofmonth(start))
    return F.year(end) - F.year(start) - before.cast("int")


def minutes_by_boundary(start: Column, end: Column) -> Column:
    """Minute marks passed between two timestamps."""
    whole = lambda c: F.unix_seconds(F.date_trunc("MINUTE", c.cast("timestamp")))
    return F.expr("bigint(0)") + F.floor((whole(end) - whole(start)) / 60)


def stay_days(start: Column, end: Column) -> Column:
    """Length of stay in days as DECIMAL(10,4); null while an end is missing."""
    seconds = F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))
    return (seconds.cast("double") / 86400).cast("decimal(10,4)")


def age_band(birth: Column, as_of: Column) -> Column:
    """Five bands by the difference of calendar years; a birth date that is null has none."""
    age = years_by_boundary(birth, as_of)
    return F.when(age < 18, "00-17").when(age < 45, "18-44").when(age < 65, "45-64").when(age < 80, "65-79").when(age.isNotNull(), "80+").otherwise("Unknown")


def care_setting(class_code: Column) -> Column:
    out = None
    for name, codes in CARE_SETTINGS.items():
        out = F.when(class_code.isin(*codes), name) if out is None else out.when(class_code.isin(*codes), name)
    return out.otherwise("Unknown")


def class_display(class_code: Column, given: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in CLASS_DISPLAY.items() for x in pair))
    return F.coalesce(filled(given), F.try_element_at(names, class_code))


def exact_decimal(text: Column) -> Column:
    """A number text, scientific notation included, as DECIMAL(18,6)."""
    return text.try_cast("double").cast("decimal(18,6)")


def term(text: Column) -> Column:
    """A verbatim term for lookup: trimmed, lower case, without anything but a-z, 0-9 and spaces. Inner spaces stay."""
    return F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9 ]", "")


def row_hash(*cols: Column) -> Column:
    """SHA-256 over values set apart by a control character; null differs from empty."""
    return F.sha2(F.concat_ws(chr(31), *(F.coalesce(c.cast("string"), F.lit("<null>")) for c in cols)), 256)


def ratio(part: Column, whole: Column, scale: int = 6) -> Column:
    """A share as a rounded double, null where there is nothing to share."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), scale)


def date_key(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "yyyyMMdd").cast("int"), F.lit(-1))
