"""What the corpus operators share: the shared folder, written intermediate tables, row-batch helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass works on, few enough for caches; a longer single row is one pass of its own.
PASS_BYTES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset (local sessions)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            at = current.get()
        elif spark.sparkContext.master.startswith("local"):
            at = f"file://{tempfile.mkdtemp(prefix='medlattice-')}"
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, at: str = "") -> DataFrame:
    """The rows of df as a table in the shared folder: cuts lineage, and survives lost executors."""
    at = at or fresh_path(df.sparkSession, tag)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def discard(spark: SparkSession, at: str) -> None:
    """Deletes a table that written() made and that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_slices(batch: pa.RecordBatch, text: str = "text", most: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most `most` bytes of text each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
    ends = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def by_slices(work: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], text: str = "text"):
    """A mapInArrow function from one that takes a run of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, text):
                got = work(part)
                yield from [got] if isinstance(got, pa.RecordBatch) else got
        pa.default_memory_pool().release_unused()  # the worker lives on, beside others

    return run


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys from batches sorted by the keys; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[i] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


#: Bits of the fixed-size filter that thins a scan before a join; when full it only passes more rows on.
FILTER_BITS = 1 << 23


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers from 0 to FILTER_BITS - 1 for each key: the low and the high half of its mix."""
    k = mix(keys.astype(np.int64).view(np.uint64))
    return (k % np.uint64(FILTER_BITS)).astype(np.int64), ((k >> np.uint64(32)) % np.uint64(FILTER_BITS)).astype(np.int64)


def key_filter(df: DataFrame, key: str) -> bytes:
    """A membership filter of FILTER_BITS bits (1 MB, whatever the size of df) over a long column.

    Slots are found where the rows are; words of 64 slots are grouped with a bit_or that starts before the shuffle, so no more than
    FILTER_BITS / 64 rows leave a task or reach the driver.
    """

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(_slots(b.column(0).to_numpy(zero_copy_only=False))))
            first = np.flatnonzero(np.concatenate([[True], at[1:] >> 6 != at[:-1] >> 6])) if len(at) else at
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(at[first] >> 6), pa.array(bits.view(np.int64))], names=["word", "bits"])

    some = df.select(F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull()).mapInArrow(slots, "word long, bits long")
    out = np.zeros(FILTER_BITS // 64, np.int64)
    found = some.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return np.packbits(np.unpackbits(out.view(np.uint8), bitorder="little")).tobytes()


class KeyFilter:
    def __init__(self, raw: bytes):
        self.bits = np.unpackbits(np.frombuffer(raw, np.uint8)).view(bool)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        a, b = _slots(keys)
        return self.bits[a] & self.bits[b]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def held_out(doc_id) -> F.Column:
    """True where crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
