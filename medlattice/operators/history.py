"""Type 2 history: versions from changes, the four-branch load, point-in-time lookup, integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import FIRST_DAY, OPEN_END, row_hash
from ..shared import written

HISTORY = ("effective_from", "effective_to", "is_current", "version_number", "row_hash")


def versions(changes: DataFrame, key: str, at: str, tracked: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Versions of each key: a new one begins where a tracked value differs from the one before; ends are open to the next begin.

    Gives key, tracked columns, valid_from, valid_to (null: open), version_number, is_current.
    """
    w = Window.partitionBy(key).orderBy(F.col(at), *order)
    now = row_hash(*(F.col(c) for c in tracked))
    begun = changes.withColumn("_h", now).withColumn("_before", F.lag("_h").over(w)).where("_before is null or _before != _h")
    w = Window.partitionBy(key).orderBy(F.col(at), *order)
    return begun.select(
        key, *tracked, F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_to"),
        F.row_number().over(w).cast("long").alias("version_number"), F.lead(at).over(w).isNull().alias("is_current"),
    )


def apply_scd2(dim: DataFrame, source: DataFrame, key: str, tracked: Sequence[str], effective: str, refresh: Sequence[str] = ()) -> DataFrame:
    """The dimension after a load of source (one row for each key) on the given day.

    Each current row falls in one branch. Unchanged: stays, with its untracked columns (refresh) brought up to date. An inferred
    stub: filled in place. Changed on the day its version began: corrected in place. Changed otherwise: closed the day before, and
    a new version opens. Keys that are new get a version from 1900-01-01, so that facts before the first load find it. Keys that
    the source lacks stay. A second run on the same day changes nothing. Columns: key, tracked, refresh, is_inferred, HISTORY.
    """
    keep = [key, *tracked, *refresh]
    names = [*keep, "is_inferred", *HISTORY]
    s = source.select(*keep).withColumn("_hash", row_hash(*(F.col(c) for c in tracked)))
    s = s.select(*(F.col(c).alias(f"_s_{c}") for c in keep), "_hash")
    current, closed = dim.where("is_current"), dim.where("not is_current")
    day, open_end = F.lit(effective).cast("date"), F.lit(OPEN_END).cast("date")
    both = current.join(s, current[key] == s[f"_s_{key}"], "full_outer")
    old, found = F.col(key).isNotNull(), F.col(f"_s_{key}").isNotNull()
    differs = found & (F.col("row_hash") != F.col("_hash"))
    mine, theirs = {c: F.col(c) for c in names}, {c: F.col(f"_s_{c}") for c in keep}
    stated = mine | theirs | {"is_inferred": F.lit(False), "row_hash": F.col("_hash")}
    opened = stated | {"effective_from": day, "effective_to": open_end, "is_current": F.lit(True), "version_number": (F.col("version_number") + 1).cast("int")}
    first = opened | {"effective_from": F.lit(FIRST_DAY).cast("date"), "version_number": F.lit(1)}
    ended = mine | {"effective_to": F.date_sub(day, 1), "is_current": F.lit(False)}
    same = mine | {c: theirs[c] for c in refresh}
    rows = lambda *versions: F.array(*(F.struct(*(v[c].cast(dim.schema[c].dataType).alias(c) for c in names)) for v in versions))
    made = (
        F.when(~old, rows(first)).when(found & F.col("is_inferred"), rows(stated)).when(differs & (F.col("effective_from") >= day), rows(stated))
        .when(differs, rows(ended, opened)).when(found, rows(same)).otherwise(rows(mine))
    )
    return closed.select(*names).unionByName(both.select(F.inline(made)))


def empty_history(source: DataFrame, key: str, tracked: Sequence[str], refresh: Sequence[str] = ()) -> DataFrame:
    return source.select(
        key, *tracked, *refresh, F.lit(False).alias("is_inferred"), F.lit(None).cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"),
        F.lit(None).cast("boolean").alias("is_current"), F.lit(None).cast("int").alias("version_number"), F.lit(None).cast("string").alias("row_hash"),
    ).where(F.lit(False))


def as_of_join(facts: DataFrame, dim: DataFrame, key: str, at: Column, columns: Sequence[str], start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Facts with the dimension's columns at their date (closed range): an equi-join on the business key with a range residual, so
    the physical join stays a hash or sort-merge join. Facts without a version keep nulls; null dates look at the first day."""
    when = F.coalesce(at, F.lit(FIRST_DAY).cast("date"))
    d = dim.select(F.col(key).alias("_key"), F.col(start).alias("_from"), F.col(end).alias("_to"), *columns)
    return facts.withColumn("_at", when).join(d, (F.col(key) == F.col("_key")) & F.col("_at").between(F.col("_from"), F.col("_to")), "left").drop("_key", "_from", "_to", "_at")


def as_of_sorted(facts: DataFrame, dim: DataFrame, key: str, at: Column, columns: Sequence[str], start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """as_of_join for keys with very many facts or versions: facts and versions are sorted together by key and time, over range partitions,
    and each fact takes the last version before it.

    A key's rows may span partitions. What a partition hands on is the last version of its last key, one row; partitions that begin with
    that key take it up. So no task holds a key, and no fact meets versions of other times. Versions of a key must not overlap. A version
    that begins at a fact's time applies; facts without a key or a version keep nulls, null dates look at the first
    day.
    """
    time = dim.schema[start].dataType
    when = (F.coalesce(at, F.lit(FIRST_DAY).cast(time)) if time.typeName().startswith(("date", "timestamp")) else at).cast(time)
    version = F.struct(F.col(end).alias("_to"), *columns)
    kind = dim.select(version.alias("v")).schema["v"].dataType
    f = facts.select(F.col(key).alias("_k"), when.alias("_at"), F.lit(1).alias("_fact"), F.struct(*facts.columns).alias("_f"), F.lit(None).cast(kind).alias("_v"))
    v = dim.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(start).alias("_at"), F.lit(0).alias("_fact"), F.lit(None).cast(f.schema["_f"].dataType).alias("_f"), version.alias("_v"))
    order = ["_k", "_at", "_fact"]
    placed = written(f.unionByName(v).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_line", F.monotonically_increasing_id()), "as-of").withColumn("_part", F.shiftright("_line", 33))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumn("_own", F.last("_v", ignorenulls=True).over(up_to(Window.partitionBy("_part", "_k").orderBy("_line"))))
    # The last version in each partition of each key that ends there, and the keys that partitions begin with: two rows for a partition.
    edges = placed.groupBy("_part").agg(F.min_by(F.struct("_k"), "_line").alias("first"), F.max_by(F.struct("_k"), "_line").alias("last"))
    last = placed.where("_v is not null").groupBy("_part", F.col("_k").alias("_lk")).agg(F.max_by("_v", "_line").alias("_hand"))
    ends = edges.join(last, (F.col("last._k") == F.col("_lk")) & (edges["_part"] == last["_part"]), "left").select(edges["_part"], F.col("last._k").alias("_k"), "_hand", F.lit(1).alias("_give"))
    begins = edges.select("_part", F.col("first._k").alias("_k"), F.lit(None).cast(kind).alias("_hand"), F.lit(0).alias("_give"))
    taken = ends.unionByName(begins).withColumn("_carried", F.last("_hand", ignorenulls=True).over(up_to(Window.partitionBy("_k").orderBy("_part", "_give"))))
    taken = F.broadcast(taken.where("_give = 0 and _carried is not null").select(F.col("_part").alias("_p"), F.col("_k").alias("_pk"), "_carried"))  # a row for each partition at most
    found = own.where("_fact = 1").join(taken, (F.col("_part") == F.col("_p")) & (F.col("_k") == F.col("_pk")), "left").withColumn("_use", F.coalesce("_own", "_carried"))
    use = F.when(F.col("_at") <= F.col("_use._to"), F.col("_use"))
    return found.select("_f.*", *(use[c].alias(c) for c in columns))


def integrity(dim: DataFrame, key: str) -> DataFrame:
    """Failures of a Type 2 table, (check_name, key, detail); empty if it is sound."""
    w = Window.partitionBy(key).orderBy("effective_from", "version_number")
    d = dim.where(F.col(key).isNotNull()).withColumn("_next", F.lead("effective_from").over(w)).withColumn("_place", F.row_number().over(w)).withColumn("_before", F.lag("row_hash").over(w))
    n = d.groupBy(key).agg(F.count_if("is_current").alias("_n"), F.count("*").alias("_k"), F.countDistinct("version_number").alias("_v"))
    said = lambda df, name, detail: df.select(F.lit(name).alias("check_name"), F.col(key).cast("string").alias("member"), detail.cast("string").alias("detail"))
    out = [
        said(d.where("effective_to < effective_from"), "reversed", F.col("effective_to")),
        said(d.where("_next <= effective_to"), "overlap", F.col("_next")),
        said(d.where(F.col("_next") > F.date_add("effective_to", 1)), "gap", F.col("_next")),
        said(n.where("_n != 1"), "not_one_current", F.col("_n")),
        said(d.where(F.col("is_current") != (F.col("effective_to") == F.lit(OPEN_END).cast("date"))), "current_not_open", F.col("effective_to")),
        said(d.where("version_number != _place"), "version_order", F.col("version_number")),
        said(d.where("row_hash = _before"), "no_change", F.col("version_number")),
        said(n.where("_v != _k"), "version_repeated", F.col("_v")),
    ]
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result
