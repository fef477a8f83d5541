"""Exact order statistics of groups of any size: ranks are found by counting between values, so that no task holds a group.

Groups with more than `large` values are cut at values picked by their hash, about PICKS of them for each group, whatever its size. Counts
between cuts (combined where the rows are) say which stretch holds a wanted rank; only the rows of those stretches are shuffled, counted by
value and numbered. What is picked depends on the values alone, so every part of a plan, and a task that runs again, cuts alike. A value
that repeats is one row with a count. Smaller groups are aggregated by Spark's own functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of a group from which on it is cut, cuts of a group (as expected), and groups whose cuts are broadcast (8 kB each).
LARGE, PICKS, BROADCAST_GROUPS = 1_000_000, 1000, 2000


def _same(a: str, b: str, by: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by), F.lit(True))


def at_ranks(df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Column], large: int = LARGE) -> DataFrame:
    """(by..., n_values, a column for each rank): the group's value at each rank, from 0 in ascending order.

    ranks: by name, a rank as a column of n_values. Null values don't count; a rank outside the group gives null. Groups keep null keys.
    """
    v = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    n = v.groupBy(*by).agg(F.count("*").alias("n_values"))
    many = n.where(F.col("n_values") > large)
    n_large = many.count()
    small = v if not n_large else v.alias("v").join(_small(many, n_large).alias("m"), _same("v", "m", by), "left_anti")
    out = _plain(small, by, ranks)
    return out if not n_large else out.unionByName(_cut(v, by, many, n_large, ranks))


def _small(groups: DataFrame, n: int) -> DataFrame:
    return F.broadcast(groups) if n <= BROADCAST_GROUPS else groups


def _plain(v: DataFrame, by: Sequence[str], ranks: dict[str, Column]) -> DataFrame:
    sorted_values = v.groupBy(*by).agg(F.count("*").alias("n_values"), F.sort_array(F.collect_list("_v")).alias("_all"))
    return sorted_values.select(*by, "n_values", *(F.get("_all", r.cast("int")).alias(name) for name, r in ranks.items()))


def stretches(v: DataFrame, by: Sequence[str], many: DataFrame, n_large: int, ranks: dict[str, Column]) -> DataFrame:
    """(by..., n_values, _s, _before, _v): the rows of the stretches that hold a wanted rank, and how many rows of the group come before."""
    m = _small(many, n_large)
    rows = v.alias("v").join(m.alias("m"), _same("v", "m", by)).select(*(F.col(f"v.{c}") for c in by), "_v", "n_values")
    picked = rows.where(F.pmod(F.xxhash64("_v"), F.greatest(F.lit(1), F.floor(F.col("n_values") / PICKS))) == 0)
    cuts = picked.groupBy(*by).agg(F.sort_array(F.collect_set("_v")).alias("cuts"))  # PICKS or so, however large the group
    cuts = many.alias("m").join(cuts.alias("c"), _same("m", "c", by), "left").select(*(F.col(f"m.{c}") for c in by), "n_values", "cuts")
    # how many cuts are below the value, by halving
    below = F.expr(f"aggregate(array({', '.join(str(1 << k) for k in range(14, -1, -1))}), 0, (k, step) -> k + if(coalesce(get(cuts, k + step - 1) < _v, false), step, 0))")
    placed = v.alias("v").join(_small(cuts, n_large).alias("c"), _same("v", "c", by)).select(*(F.col(f"v.{c}") for c in by), "_v", "n_values", below.alias("_s"))
    sizes = placed.groupBy(*by, "n_values", "_s").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before)
    wanted = F.array(*(r.cast("long") for r in ranks.values()))
    held = sizes.where(F.exists(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_k")))).select(*by, "_s", "_before")
    return placed.alias("p").join(_small(held, n_large * len(ranks)).alias("h"), _same("p", "h", [*by, "_s"])).select(*(F.col(f"p.{c}") for c in by), "n_values", "p._s", "_before", "_v")


def _cut(v: DataFrame, by: Sequence[str], many: DataFrame, n_large: int, ranks: dict[str, Column]) -> DataFrame:
    some = stretches(v, by, many, n_large, ranks)
    counted = some.groupBy(*by, "n_values", "_s", "_before", "_v").agg(F.count("*").alias("_k"))
    found = counted.withColumn("_upto", F.col("_before") + F.sum("_k").over(Window.partitionBy(*by, "_s").orderBy("_v")))
    hit = lambda r: (r.cast("long") < F.col("_upto")) & (r.cast("long") >= F.col("_upto") - F.col("_k"))
    return found.groupBy(*by, "n_values").agg(*(F.max(F.when(hit(r), F.col("_v"))).alias(name) for name, r in ranks.items()))


def has_large(df: DataFrame, by: Sequence[str], value: str, large: int = LARGE) -> bool:
    return not df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > large).isEmpty()


def quantiles(df: DataFrame, by: Sequence[str], value: str, at: dict[str, float], large: int = LARGE) -> DataFrame:
    """(by..., n_values, a double for each share): interpolated between the two nearest values, as percentile_cont does."""
    n = F.col("n_values")
    place = {name: (n - 1) * F.lit(q) for name, q in at.items()}
    ranks = {f"_{side}_{name}": f(p).cast("long") for name, p in place.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    got = at_ranks(df, by, value, ranks, large)
    lo, hi = (lambda name: F.col(f"_lo_{name}").cast("double")), (lambda name: F.col(f"_hi_{name}").cast("double"))
    share = lambda name: place[name] - F.floor(place[name])
    # the form that percentile_cont has, so that both give the same double
    mixed = {name: F.when(share(name) == 0, lo(name)).otherwise((F.ceil(place[name]) - place[name]) * lo(name) + share(name) * hi(name)) for name in at}
    return got.select(*by, "n_values", *(c.alias(name) for name, c in mixed.items()))
