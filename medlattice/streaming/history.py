"""A Type 2 table kept from a stream of changes, exactly once and in any order of arrival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import versions
from ..sources.snapshots import Load, Store
from .landing import drained

#: Parts of a table by the hash of its key: a load rewrites those that its changes touch.
PARTS = 16


def apply_changes(store: Store, table: str, changes: DataFrame, key: str, at: str, tracked: Sequence[str], order: str, stream: str, number: int, parts: int = PARTS) -> bool:
    """One batch of changes to the Type 2 table; False if the stream's batch has been applied before.

    changes: key, at, tracked columns, and order, which says what counts of several changes at one instant (the greatest). All changes are
    kept in `<table>.changes`, by parts; the versions of the keys in the batch are made anew from all of theirs, so that changes may come
    late and in any order. The table, its changes and the number of the batch become visible in one manifest: a batch that comes again
    after a failure, whether its load was committed or not, counts once.
    """
    log = f"{table}.changes"

    def work(load: Load) -> bool:
        if load.base.streams.get(stream, -1) >= number:
            drained(changes)
            return False
        part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")
        new = load.append(log, changes.select(key, at, *tracked, order, part), "part")
        touched = [r.part for r in new.select("part").distinct().collect()]  # `parts` rows at most
        keys = new.select(key, "part").distinct()
        here = F.col("part").isin(touched)
        of_keys = load.read(log).where(here).join(keys, [key, "part"], "left_semi")
        one = of_keys.groupBy(key, at).agg(F.max_by(F.struct(*tracked), order).alias("t")).select(key, at, "t.*")
        made = versions(one, key, at, tracked).withColumn("part", part)
        if table in load:
            made = load.read(table, parts=touched).join(keys, [key, "part"], "left_anti").select(*made.columns).unionByName(made)
        if touched:
            load.replace(table, made, "part", touched)
        load.counts = {"n_read": new.count()}
        load.streams[stream] = number
        return True

    return store.transact("stream", work)


def type2_stream(store: Store, table: str, changes: DataFrame, key: str, at: str, tracked: Sequence[str], order: str, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Applies a stream's changes in micro-batches, and ends with what there is (availableNow). One stream name for each checkpoint."""
    run = lambda df, number: apply_changes(store, table, df, key, at, tracked, order, checkpoint, number, parts)
    return changes.writeStream.foreachBatch(lambda df, number: run(df, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
