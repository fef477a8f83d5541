"""What plain Parquet lacks: upsert, surrogate keys, Unknown rows, inferred members, validation of declared constraints."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


class OnDemand(Mapping):
    """Tables by name, each made when it is first asked for, by a function of all of them; keep(name, rows) may write it."""

    def __init__(self, makers: Mapping[str, Callable[[Mapping[str, DataFrame]], DataFrame]], keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df):
        self.makers, self.keep, self.made = dict(makers), keep, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.keep(name, self.makers[name](self))
        return self.made[name]

    def __contains__(self, name: object) -> bool:
        return name in self.makers

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def latest_version(df: DataFrame, keys: Sequence[str], changed: str, version: str) -> DataFrame:
    """One row for each key: the last change first (none last), then the greatest version in text order."""
    return dedupe(df, keys, [F.col(changed).desc_nulls_last(), F.col(version).cast("string").desc()])


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: bool | str | None = True) -> DataFrame:
    """The table after a merge: matched rows get the source's values, new keys are added, nothing is deleted.

    update True always updates, False or None only inserts, a SQL text (over t and s) says when. Columns that the source lacks
    (surrogate keys, say) keep the target's value and are null in new rows; source rows must be unique by key.
    """
    t = target.alias("t").withColumn("_t", F.lit(True)).alias("t")
    s = source.alias("s").withColumn("_s", F.lit(True)).alias("s")
    on = reduce(lambda a, b: a & b, (F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys))
    both = t.join(s, on, "full_outer")
    use = F.col("t._t").isNull() if update in (False, None) else F.col("s._s").isNotNull() if update is True else F.col("t._t").isNull() | F.coalesce(F.expr(update), F.lit(False))
    use = use & F.col("s._s").isNotNull()
    cols = []
    for c in target.columns:
        if c in keys:
            cols.append(F.coalesce(f"t.{c}", f"s.{c}").alias(c))
        elif c in source.columns:
            cols.append(F.when(use, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            cols.append(F.col(f"t.{c}"))
    return both.select(*cols)


def numbered(df: DataFrame, order: Sequence[Column | str], name: str, start: int | Column = 1) -> DataFrame:
    """Rows with their place in an order, from `start`, without a task that sees them all: they are sorted by range and written, so that
    the numbers within partitions and the sizes of those before come from the same rows; the sizes are a row for each partition."""
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    base = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(base), "_part").withColumn(name, F.lit(start) + F.col("_base") + inside).drop("_id", "_part", "_base")


def with_keys(df: DataFrame, key: str, order: Sequence[str], start: int = 1) -> DataFrame:
    """Numbers rows whose key is null after the greatest key there is, in the order of a business key (see numbered)."""
    old, new = df.where(F.col(key).isNotNull()), df.where(F.col(key).isNull())
    top = df.agg(F.greatest(F.coalesce(F.max(key), F.lit(0)), F.lit(start - 1)).alias("_top"))
    placed = numbered(new.drop(key), order, "_n").crossJoin(F.broadcast(top)).withColumn(key, (F.col("_top") + F.col("_n")).cast(df.schema[key].dataType))
    return old.unionByName(placed.select(*df.columns))


def with_unknown(df: DataFrame, key: str, **values) -> DataFrame:
    """Adds the Unknown member (key -1); text columns say Unknown unless given."""
    row = [F.lit(values.get(c, -1 if c == key else "Unknown" if t == "string" else None)).cast(t).alias(c) for c, t in df.dtypes]
    return df.unionByName(df.sparkSession.range(1).select(*row))


def inferred(dim: DataFrame, referenced: DataFrame, business_key: str, **values) -> DataFrame:
    """Adds a stub for each referenced business key that the dimension lacks; stubs are marked is_inferred."""
    missing = referenced.select(business_key).where(F.col(business_key).isNotNull()).distinct().join(dim, business_key, "left_anti")
    cols = [F.col(c) if c == business_key else F.lit(True if c == "is_inferred" else values.get(c)).cast(t).alias(c) for c, t in dim.dtypes]
    return dim.unionByName(missing.select(*cols))


def first_by(df: DataFrame, group: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """The columns of each group's row that is first by order; combined map-side, without a window."""
    return df.groupBy(*group).agg(F.min_by(F.struct(*columns), order).alias("_r")).select(*group, *(F.col(f"_r.{c}").alias(c) for c in columns))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose reference finds no parent; null references are none."""
    p = parent.select(F.col(key).alias("_key")).distinct()
    return child.where(F.col(column).isNotNull()).join(p, F.col(column) == F.col("_key"), "left_anti")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side lacks, with the side that has them; empty for equal sets."""
    return a.subtract(b).withColumn("only_in", F.lit("left")).unionByName(b.subtract(a).withColumn("only_in", F.lit("right")))


def land(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, duplicates): the batch is deduplicated by key, keys that the target has are left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    placed = batch.withColumn("_place", F.row_number().over(w))
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
    marked = placed.join(known, list(keys), "left")
    fresh = (F.col("_place") == 1) & F.col("_known").isNull()
    return marked.where(fresh).select(*batch.columns), marked.where(~fresh).select(*batch.columns)
