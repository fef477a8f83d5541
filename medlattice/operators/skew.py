"""Joins with a side to look up: broadcast if its size, which is counted, allows it; else by key, with frequent keys spread out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that is broadcast (some 100 bytes each), frequent keys that are looked for, and the parts that each is spread over.
BROADCAST_ROWS, TOP_KEYS, SPREAD = 200_000, 64, 64


def frequent(df: DataFrame, keys: Sequence[str], share: float, top: int = TOP_KEYS) -> DataFrame:
    """(keys..., _hot): the keys that hold at least `share` of the rows, found by a sketch of bounded size (none that holds 1/1000 is missed)."""
    k = F.struct(*keys)
    found = df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in keys))).agg(F.expr(f"approx_top_k(to_json(struct({', '.join(f'`{c}`' for c in keys)})), {top}, {max(1000, 16 * top)})").alias("t"), F.count("*").alias("n"))
    schema = df.select(k.alias("k")).schema["k"].dataType.simpleString()
    rows = found.select("n", F.inline("t")).where(F.col("count") >= F.col("n") * share).select(F.from_json("item", schema).alias("k"))
    return rows.select("k.*", F.lit(True).alias("_hot"))


def lookup(df: DataFrame, side: DataFrame, keys: Sequence[str], share: float = 0.01, broadcast_rows: int = BROADCAST_ROWS, spread: int = SPREAD) -> DataFrame:
    """df left-joined with side, which has one row for each value of keys and otherwise columns of its own.

    A side of at most broadcast_rows rows is broadcast. Else rows whose key holds `share` of all rows or more are spread over `spread`
    parts by their place, and side's rows of those keys (TOP_KEYS at most) are repeated for each part; all others join by their key alone.
    """
    if side.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return df.join(F.broadcast(side), list(keys), "left")
    hot = F.broadcast(frequent(df, keys, share))
    part = F.when(F.coalesce("_hot", F.lit(False)), F.pmod(F.monotonically_increasing_id(), F.lit(spread))).otherwise(0).cast("int")
    left = df.join(hot, list(keys), "left").withColumn("_salt", part).drop("_hot")
    parts = F.when(F.coalesce("_hot", F.lit(False)), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    right = side.join(hot, list(keys), "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")
