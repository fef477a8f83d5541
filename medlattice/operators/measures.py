"""Windows, rollups and statistics of the semantic layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import FIRST_DAY, ratio
from . import order_stats


def returns(visits: DataFrame, who: str, start: Column, end: Column, visit_id: str, within: int = 30) -> DataFrame:
    """Marks visits that begin 0 to `within` days after the same person's last one ended (by start, then id)."""
    w = Window.partitionBy(who).orderBy("_start", visit_id)
    v = visits.withColumn("_start", start).withColumn("_end", end)
    gap = F.datediff(F.col("_start"), F.lag("_end").over(w))
    return v.withColumn("days_since", gap).withColumn("is_return", F.coalesce(F.col("days_since").between(0, within), F.lit(False)).cast("int")).drop("_start", "_end")


def rate_by(df: DataFrame, by: Sequence[Column | str], flag: str, count: str = "n", hits: str = "hits", rate: str = "rate") -> DataFrame:
    """Count, hits and their guarded share for each group."""
    return df.groupBy(*by).agg(F.count("*").alias(count), F.sum(F.col(flag).cast("long")).alias(hits)).withColumn(rate, ratio(F.col(hits), F.col(count)))


def reference_band(df: DataFrame, by: Sequence[str], value: str, least: int = 30, large: int = order_stats.LARGE) -> DataFrame:
    """5th and 95th percentile (interpolated), extremes and mean of each group with enough values. Percentiles of groups with more than
    `large` values are found by counting, without a task that holds the group."""
    if order_stats.has_large(df, by, value, large):
        rest = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("n_values"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(F.col(value).cast("double")), 6).alias("mean"))
        q = order_stats.quantiles(df, by, value, {"p05": 0.05, "p95": 0.95}, large).drop("n_values")
        both = rest.alias("a").join(q.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])
        return both.where(F.col("n_values") >= least).select(*(F.col(f"a.{c}") for c in by), "n_values", F.round("p05", 6).alias("p05"), F.round("p95", 6).alias("p95"), "low", "high", "mean")
    p = lambda q: F.round(F.expr(f"percentile_cont({q}) within group (order by `{value}`)"), 6)
    stats = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(value).alias("n_values"), p(0.05).alias("p05"), p(0.95).alias("p95"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(F.col(value).cast("double")), 6).alias("mean"),
    )
    return stats.where(F.col("n_values") >= least)


def outliers(df: DataFrame, band: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Values of banded groups with is_outlier (1 outside the band)."""
    b = band.select(*by, "p05", "p95")
    return df.where(F.col(value).isNotNull()).join(b, list(by)).withColumn("is_outlier", ((F.col(value) < F.col("p05")) | (F.col(value) > F.col("p95"))).cast("int"))


def iqr_fence(df: DataFrame, by: Sequence[str], value: str, times: float = 3.0, large: int = order_stats.LARGE) -> DataFrame:
    """Rows outside the fence of quartiles, with the distance to it; quartiles of groups of more than `large` values as in reference_band."""
    if order_stats.has_large(df, by, value, large):
        q = order_stats.quantiles(df, by, value, {"q1": 0.25, "q3": 0.75}, large).select(*by, F.array("q1", "q3").alias("_q"))
    else:
        q = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    q = q.select(*by, (F.col("_q")[0] - times * (F.col("_q")[1] - F.col("_q")[0])).alias("fence_low"), (F.col("_q")[1] + times * (F.col("_q")[1] - F.col("_q")[0])).alias("fence_high"))
    out = df.join(q, list(by)).where((F.col(value) < F.col("fence_low")) | (F.col(value) > F.col("fence_high")))
    return out.withColumn("beyond", F.greatest(F.col("fence_low") - F.col(value), F.col(value) - F.col("fence_high")))


def upper_medians(df: DataFrame, by: Sequence[str], value: str, name: str = "upper_median", large: int = order_stats.LARGE) -> DataFrame:
    """The middle value of each group, the upper of two; not interpolated. Groups without values have no row."""
    return order_stats.at_ranks(df, by, value, {name: F.floor(F.col("n_values") / 2)}, large).select(*by, name)


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str = "running") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def over_domain(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Counts for each value of a fixed domain, zero where there is none."""
    rows = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(domain)], f"{column} string, place int")
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return rows.join(n, column, "left").select(column, "place", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The n most frequent values, ties in the order of the value."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by).limit(n)


def panel(people: DataFrame, visits: DataFrame, who: str, at: str, months: int = 24) -> DataFrame:
    """People with their visits, and whether the last one is within `months` before the last of all."""
    seen = visits.groupBy(who).agg(F.max(at).alias("last_visit"), F.count("*").alias("n_visits"))
    as_of = visits.agg(F.max(at).alias("as_of"))
    out = people.join(seen, who, "left").crossJoin(F.broadcast(as_of))
    recent = F.coalesce(F.col("last_visit") > F.add_months(F.col("as_of"), -months), F.lit(False))
    return out.withColumn("n_visits", F.coalesce("n_visits", F.lit(0)).cast("long")).withColumn("is_active", recent.cast("int"))


def funnel(criteria: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(step, criterion, n) of each criterion and of all together, counted by distinct key."""
    out, both = None, None
    for i, (name, df) in enumerate(criteria, 1):
        own = df.select(key).where(F.col(key).isNotNull()).distinct()
        both = own if both is None else both.join(own, key, "left_semi")
        row = own.agg(F.count("*").alias("n")).select(F.lit(i).cast("long").alias("step"), F.lit(name).alias("criterion"), "n")
        out = row if out is None else out.unionByName(row)
    last = both.agg(F.count("*").alias("n")).select(F.lit(len(criteria) + 1).cast("long").alias("step"), F.lit("all criteria").alias("criterion"), "n")
    return out.unionByName(last)


def year_over_year(monthly: DataFrame, month: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The value twelve months before and the growth since; null where there is none or it is zero."""
    before = monthly.select(*by, F.add_months(month, 12).alias(month), F.col(value).alias("prior"))
    out = monthly.join(before, [*by, month], "left")
    return out.withColumn("growth", F.round(F.try_divide((F.col(value) - F.col("prior")).cast("double"), F.nullif(F.col("prior"), F.lit(0)).cast("double")), 6))


def calendar(spark, first: str = FIRST_DAY, last: str = "2035-12-31", fiscal_start: int = 4) -> DataFrame:
    """A row for each day, and the Unknown day (-1). The fiscal year is named by the year in which it begins."""
    d = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d"))
    fiscal = F.add_months("d", 1 - fiscal_start)
    long = lambda c: c.cast("long")
    days = d.select(
        long(F.date_format("d", "yyyyMMdd")).alias("date_key"), F.col("d").alias("full_date"), long(F.dayofmonth("d")).alias("day_of_month"), long(F.dayofweek("d")).alias("day_of_week"),
        F.date_format("d", "EEEE").alias("day_name"), long(F.dayofyear("d")).alias("day_of_year"), long(F.weekofyear("d")).alias("week_of_year"), long(F.month("d")).alias("month_number"),
        F.date_format("d", "MMMM").alias("month_name"), F.date_format("d", "yyyy-MM").alias("month_year"), long(F.quarter("d")).alias("quarter_number"),
        F.format_string("%04d-Q%d", F.year("d"), F.quarter("d")).alias("quarter_name"), long(F.year("d")).alias("year_number"), F.dayofweek("d").isin(1, 7).cast("long").alias("is_weekend"),
        long(F.year(fiscal)).alias("fiscal_year"), long(F.quarter(fiscal)).alias("fiscal_quarter"),
    )
    unknown = {"date_key": -1, "full_date": "1899-12-31", "day_name": "Unknown", "month_name": "Unknown", "month_year": "Unknown", "quarter_name": "Unknown", "year_number": 1900, "is_weekend": 0, "fiscal_year": 1900}
    return days.unionByName(spark.range(1).select(*(F.lit(unknown.get(c, 1)).cast(t).alias(c) for c, t in days.dtypes)))
