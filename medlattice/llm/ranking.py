"""Ranked lexical search: compressed postings by shard of documents, merged document at a time, and one merge of all shards' best.

An index row is one shard: some 8 MB of text in the order of the table, its documents sorted by doc_id, and for each term (a 64-bit hash)
the documents that hold it as gaps and the occurrences, both as variable-length bytes. Documents never leave the task that reads them.
Queries come in blocks of bounded size; each block is sent to every shard (a stated query set against all rows). In a shard, a query's
posting lists are merged by a heap of their next documents; a bounded heap keeps the best, keyed by score, then doc_id. Lists that can't
lift a document into that heap by themselves are not merged but probed for the documents that the others give, so results are the same as
by merging all. A task carries its heaps from shard to shard; their rows are ranked by parts, then all together.

Defined results: null and empty texts and those without a term are in no shard and count nowhere; rows that repeat a doc_id are documents
of their own; a null doc_id comes before all others in ties. Rows of the queries' table that are alike in id and text count once; with one
id but different texts each is ranked by itself. A query without terms, or whose terms no document holds, gives no rows. Any length of
text: long ones are read in parts that end between terms. Terms count as equal by their hash: among 10**9 terms of a corpus, one meets a
given set of 10**4 other query terms with a probability of 10**-6.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KeyFilter, key_filter, row_slices, table, written
from .tokens import NO_ID
from .words import LOWER, hash_spans, spans, text_bytes

#: What a term is made of (digits, letters, all beyond ASCII).
IN_TERM = np.zeros(256, bool)
IN_TERM[48:58] = IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Text bytes of a shard, and of a text that are read together.
SHARD_BYTES, PART_BYTES = 8_000_000, 4_000_000
#: Terms of the queries that are sent to the shards together.
BLOCK_TERMS = 200_000
K1, K1_B = 100, 75  # saturation and length weight, in hundredths
_INDEX = "n_docs int, n_terms long, ids binary, lengths binary, terms array<long>, dfs array<int>, gap_ends array<int>, tf_ends array<int>, gaps binary, tfs binary"


def packed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Seven bits a byte, low ones first, the eighth bit where more follow; and where each value ends."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    rest = v >> np.uint64(7)
    while rest.any():
        size += rest > 0
        rest >>= np.uint64(7)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        out[ends[live] - size[live] + k] = ((v[live] >> np.uint64(7 * k)) & np.uint64(127)) | (np.uint64(128) * (size[live] > k + 1))
    return out.tobytes(), ends


def unpacked(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(b < 128) + 1
    starts = np.concatenate([[0], ends[:-1]])
    shift = np.arange(len(b)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((b & 127).astype(np.uint64) << (np.uint64(7) * shift.astype(np.uint64)), starts)


def term_hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of terms, and the row of each, part by part."""
    data, at = text_bytes(column)
    lo = 0
    while lo < len(data):
        hi = min(lo + PART_BYTES, len(data))
        while hi < len(data) and IN_TERM[data[hi]] and hi not in at:
            hi += 1
        part = data[lo:hi]
        row = at[(at > lo) & (at < hi)] - lo
        start, end, _ = spans(~IN_TERM[part], np.concatenate([[0], row, [len(part)]]))
        yield hash_spans(LOWER[part], start, end).view(np.int64), np.searchsorted(at, start + lo, "right") - 1
        lo = hi


class Shard:
    """Counts of some documents' terms."""

    def __init__(self):
        self.bytes, self.rows, self.ids, self.n, self.found = 0, 0, [], [], []

    def add(self, batch: pa.RecordBatch, wanted: KeyFilter | None) -> None:
        n = np.zeros(batch.num_rows, np.int64)
        for h, row in term_hashes(batch.column(1)):
            n += np.bincount(row, minlength=batch.num_rows)
            if wanted is not None:
                keep = wanted(h)
                h, row = h[keep], row[keep]
            order = np.argsort(h, kind="stable")
            self.found.append(_runs(h[order], row[order] + self.rows, np.ones(len(h), np.int64)))
        self.ids.append(batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy())
        self.n.append(n)
        self.rows += batch.num_rows
        self.bytes += batch.column(1).nbytes

    def row(self) -> pa.RecordBatch | None:
        ids, n = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (self.ids, self.n))
        order = np.argsort(ids, kind="stable")
        order = order[n[order] > 0]
        if not len(order):
            return None
        place = np.zeros(len(ids), np.int64)
        place[order] = np.arange(len(order))
        h, row, tf = (np.concatenate(x) for x in zip(*self.found, strict=True))
        by = np.lexsort((place[row], h))
        h, row, tf = _runs(h[by], place[row][by], tf[by])
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        gap = np.diff(row, prepend=0)
        gap[first] = row[first]
        gaps, gap_ends = packed(gap)
        tfs, tf_ends = packed(tf)
        last = np.concatenate([first[1:], [len(h)]])[: len(first)] - 1
        ids = ids[order]
        with np.errstate(over="ignore"):
            steps = np.diff(ids.view(np.uint64), prepend=np.uint64(0))
        return pa.RecordBatch.from_pydict({
            "n_docs": pa.array([len(order)], pa.int32()), "n_terms": pa.array([int(n.sum())], pa.int64()), "ids": [packed(steps)[0]], "lengths": [packed(n[order])[0]],
            "terms": pa.array([h[first]], pa.list_(pa.int64())), "dfs": pa.array([np.diff(last, prepend=-1).astype(np.int32)], pa.list_(pa.int32())),
            "gap_ends": pa.array([gap_ends[last].astype(np.int32)], pa.list_(pa.int32())), "tf_ends": pa.array([tf_ends[last].astype(np.int32)], pa.list_(pa.int32())), "gaps": [gaps], "tfs": [tfs],
        })


def _runs(h: np.ndarray, row: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences summed over runs of equal term and row."""
    if not len(h):
        return h, row, tf
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
    return h[at], row[at], np.add.reduceat(tf, at)


def index(docs: DataFrame, wanted: bytes | None = None) -> DataFrame:
    """One row for each shard of (doc_id, text), written: all terms, or those that a filter of term hashes passes."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = KeyFilter(wanted) if wanted is not None else None
        shard = Shard()
        for batch in batches:
            for part in row_slices(batch):
                shard.add(part, keep)
                if shard.bytes >= SHARD_BYTES:
                    row, shard = shard.row(), Shard()
                    if row is not None:
                        yield row
        row = shard.row()
        if row is not None:
            yield row

    return written(docs.select("doc_id", "text").mapInArrow(shards, _INDEX), "postings")


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(item, part, term, times): the terms of each distinct query; part tells apart texts of one key."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, text="text"):
                for h, row in term_hashes(part.column(2)):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(h)], names=["item", "part", "term"])

    distinct = queries.select(F.col(key).cast("long").alias("item"), F.xxhash64(text).alias("part"), F.col(text).alias("text")).distinct()
    return distinct.mapInArrow(terms, "item long, part long, term long").groupBy("item", "part", "term").agg(F.count("*").alias("times"))


class Postings:
    """A shard's lists, decoded when first asked for: documents, contributions with the weight given, and the largest of them."""

    def __init__(self, row: dict, corpus: tuple[int, int]):
        self.row = row
        self.terms = np.asarray(row["terms"], np.int64)
        n_docs, n_terms = corpus
        with np.errstate(over="ignore"):
            self.ids = np.cumsum(unpacked(row["ids"])).view(np.int64)
        n = unpacked(row["lengths"]).astype(np.int64)
        self.m = K1 - K1_B + K1_B * n * n_docs // n_terms
        self.lists: dict[int, tuple[list[int], list[int], int] | None] = {}

    def get(self, term: int, weight: int) -> tuple[list[int], list[int], int] | None:
        if term not in self.lists:
            k = int(np.searchsorted(self.terms, term))
            out = None
            if k < len(self.terms) and self.terms[k] == term:
                ends, tf_ends = self.row["gap_ends"], self.row["tf_ends"]
                docs = np.cumsum(unpacked(self.row["gaps"][ends[k - 1] if k else 0 : ends[k]])).astype(np.int64)
                tf = unpacked(self.row["tfs"][tf_ends[k - 1] if k else 0 : tf_ends[k]]).astype(np.int64)
                gain = weight * (1_000_000_000 * tf // (1000 * tf + 8 * self.m[docs]))
                out = (docs.tolist(), gain.tolist(), int(gain.max()))
            self.lists[term] = out
        return self.lists[term]


def search_shard(shard: Postings, terms: list[tuple[int, int, int]], best: list[tuple[int, int]], k: int) -> None:
    """Merges a shard's postings of one query into `best`, the heap of (score, -doc_id) of at most k documents, the worst on top."""
    lists = []
    for term, weight, times in terms:
        got = shard.get(term, weight)
        if got is not None and got[2] > 0:
            lists.append((got[2] * times, times, got[0], got[1]))
    if not lists:
        return
    lists.sort(key=lambda x: x[0])
    most = [0]  # what the lists up to here can add
    for x in lists:
        most.append(most[-1] + x[0])
    ids = shard.ids
    probed, heap, at = 0, [], [0] * len(lists)
    bits = len(lists).bit_length()
    mask = (1 << bits) - 1

    def heads() -> list[int]:
        """The next document of each list that is still merged, with the list's number in the low bits."""
        out = [lists[i][2][at[i]] << bits | i for i in range(probed, len(lists)) if at[i] < len(lists[i][2])]
        heapq.heapify(out)
        return out

    floor = best[0][0] if len(best) == k else 0
    while probed < len(lists) and most[probed + 1] < floor:
        probed += 1
    heap = heads()
    replace, pop = heapq.heapreplace, heapq.heappop
    while heap:
        doc = heap[0] >> bits
        score = 0
        while heap and heap[0] >> bits == doc:
            i = heap[0] & mask
            _, times, docs, gain = lists[i]
            p = at[i]
            score += times * gain[p]
            p += 1
            at[i] = p
            if p < len(docs):
                replace(heap, docs[p] << bits | i)
            else:
                pop(heap)
        i = probed
        while i and score + most[i] >= floor:
            i -= 1
            _, times, docs, gain = lists[i]
            p = bisect_left(docs, doc, at[i])
            at[i] = p
            if p < len(docs) and docs[p] == doc:
                score += times * gain[p]
        if i or score < floor or not score:
            continue
        entry = (score, -int(ids[doc]))
        if len(best) < k:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)
        else:
            continue
        if len(best) == k and best[0][0] > floor:
            floor, before = best[0][0], probed
            while probed < len(lists) and most[probed + 1] < floor:
                probed += 1
            if probed != before:
                heap = heads()


def search(postings: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(item, part, rank, doc_id, score): the k best documents of each query; terms as query_terms() gives them."""
    spark = postings.sparkSession
    n_docs, n_terms = postings.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = postings.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    weighed = written(terms.join(df, "term").select("item", "part", "term", weight.alias("weight"), "times"), "query-terms")
    blocks = max(1, -(-weighed.count() // BLOCK_TERMS))
    schema = "item long, part long, doc_id long, score long, task int"
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        block: dict = {}
        for r in weighed.where(F.pmod(F.xxhash64("item", "part"), F.lit(blocks)) == b).toArrow().to_pylist():  # BLOCK_TERMS rows or so
            block.setdefault((r["item"], r["part"]), []).append((r["term"], r["weight"], r["times"]))
        if block:
            found = found.union(postings.mapInArrow(_searcher(block, (n_docs, n_terms), k), schema))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part", F.col("task") % 64).orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k).select("item", "part", "rank", "doc_id", "score")


def _searcher(block: dict, corpus: tuple[int, int], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {key: [] for key in block}
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Postings({c: batch.column(j)[i].values.to_numpy() if pa.types.is_list(batch.column(j).type) else batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}, corpus)
                for key, terms in block.items():
                    search_shard(shard, terms, best[key], k)
        rows = [(*key, None if doc == NO_ID else doc, score) for key, heap in best.items() for score, doc in ((s, -d) for s, d in heap)]
        if rows:
            item, part, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, part, doc, score)] + [pa.array([TaskContext.get().partitionId()] * len(rows), pa.int32())], names=["item", "part", "doc_id", "score", "task"])

    return run


def ranked(docs: DataFrame, queries: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Indexes the documents' occurrences of the queries' terms, all of them, and searches them."""
    terms = written(query_terms(queries, key, text), "query-terms")
    return search(index(docs, key_filter(terms, "term")), terms, k)


def op13_ranked_search(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    found = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "item_id", "text", k)
    return found.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def _terms_sql(text: str) -> str:
    return f"unnest(regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}'))"


OP13_SQL = f"""
with docs as (select row_number() over () as d, doc_id, text from documents),
terms as (select d, doc_id, {_terms_sql("text")} as term from docs),
tf as (select d, doc_id, term, count(*) as tf from terms group by all),
lengths as (select d, count(*) as n from terms group by d),
corpus as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from lengths),
weights as (select term, floor(1000 * ln((2.0::double * n_docs + 2) / (2.0::double * count(*) + 1)))::bigint as w from tf, corpus group by term, n_docs),
items as (select item_id, {_terms_sql("text")} as term from (select distinct item_id, text from benchmark)),
asked as (select item_id, term, count(*) as times from items group by all),
scores as (
  select item_id, d, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::bigint as score
  from asked join tf using (term) join weights using (term) join lengths using (d), corpus group by all),
best as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls first) as rank from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from best where rank <= 10
"""
