"""Nearest neighbours as a block matrix join: int8 tiles with error bounds, float64 for what survives, heaps to merge."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import groups, table, written

#: Rows of a candidate and of a query block.
CANDIDATE_ROWS, QUERY_ROWS = 8192, 1024
_SLICE = 128
_BLOCK = "dim int, block string, ids binary, vectors binary"
_HIT = "query_id long, vec_id long, score double"


def usable(vector) -> F.Column:
    """True for a vector without null or non-finite components that isn't empty, null or all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _blocks(rows: DataFrame, most: int, n: int) -> DataFrame:
    """Packs (dim, vec_id, v) rows, n at most, into blocks of equal dimension of about `most` rows, however they are partitioned."""
    stripes = max(1, -(-n // most))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        key, size, made = None, 0, 0

        def out() -> pa.RecordBatch:
            nonlocal size, made
            ids, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            size, made = 0, made + 1
            return pa.RecordBatch.from_pydict({"dim": pa.array([key[0]], pa.int32()), "block": [f"{int(ids[0])}-{made}-{len(ids)}"], "ids": [ids.tobytes()], "vectors": [vectors.tobytes()]})

        for b in batches:
            dims, part = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ids = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero((dims[1:] != dims[:-1]) | (part[1:] != part[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if i == j:
                    continue
                if held and key != (int(dims[i]), int(part[i])):
                    yield out()
                key = int(dims[i]), int(part[i])
                flat = b.column(3).slice(i, j - i).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, key[0])
                for k in range(0, j - i, most):
                    held.append((ids[i + k : min(j, i + k + most)], flat[k : k + most]))
                    size += len(held[-1][0])
                    if size >= 2 * most:
                        yield out()
        if held:
            yield out()

    dealt = rows.select("dim", F.pmod(F.xxhash64("vec_id", "v"), F.lit(stripes)).cast("int").alias("part"), "vec_id", "v")
    return dealt.repartition("dim", "part").sortWithinPartitions("dim", "part").mapInArrow(pack, _BLOCK)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, a scale for each row, the norm of scale*codes and the norm of what they leave of x."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.sqrt((near**2).sum(axis=1)), np.sqrt(((x - near) ** 2).sum(axis=1))


def exact_scores(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of q[i] and c[j], summed from the first dimension on in double precision."""
    out = np.zeros(len(i))
    for d in range(q.shape[1]):
        out += q[i, d] * c[j, d]
    return out


def best_in_tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query within the tile (all, if fewer), never the query's own id."""
    qc, qs, qn, qe = quantised(q)
    cc, cs, cn, ce = quantised(c)
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # whole numbers stay exact
    right = cc.astype(kind).T.copy()
    found = []
    for at in range(0, len(q), _SLICE):
        to = slice(at, at + _SLICE)
        near = (qc[to].astype(kind) @ right).astype(np.float64) * qs[to, None] * cs[None, :]
        off = qn[to, None] * ce[None, :] + qe[to, None] * (cn + ce)[None, :]
        off += 1e-9 * (qn[to] + qe[to])[:, None] * (cn + ce)[None, :]  # rounding of the bound itself
        own = qid[to, None] == cid[None, :]
        low = np.where(own, -np.inf, near - off)
        least = np.partition(low, max(0, low.shape[1] - k), axis=1)[:, max(0, low.shape[1] - k)]
        i, j = np.nonzero(~(near + off < least[:, None]) & ~own)
        score = exact_scores(q[to], c, i, j)
        order = np.lexsort((cid[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < k
        found.append((qid[to][i[keep]], cid[j[keep]], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k rows with the largest inner product.

    Both tables hold vec_id long and embedding array; vectors that are null, empty, zero or hold null or non-finite components,
    and rows without vec_id, take no part; a query is compared with vectors of its own dimension. Ties go to the smaller vec_id;
    rows that repeat both id and vector count once; queries that repeat an id with other vectors get the best of any. Fewer than
    k candidates give fewer rows, empty tables none. Only the two columns are read.

    Plan: both sides are dealt by hash and packed into blocks, so that what leaves a tile follows the number of rows and not that of
    partitions; each pair of a query block and a candidate block is one row of an equi-join on a
    stripe number and one tile of int8 products. The quantisation error bound leaves few pairs of a tile to compute in double.
    """
    ready = lambda df: df.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).dropDuplicates(["vec_id", "embedding"]).select(F.size("embedding").alias("dim"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    blocks = written(_blocks(ready(rows), CANDIDATE_ROWS, rows.count()), "vectors")
    asked = written(_blocks(ready(queries), QUERY_ROWS, queries.count()), "queries")
    stripes = max(1, min(blocks.count(), 4096))
    left = asked.select("dim", F.col("ids").alias("qids"), F.col("vectors").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))
    right = blocks.select("dim", F.col("ids").alias("cids"), F.col("vectors").alias("c"), F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int").alias("stripe"))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                d = row["dim"]
                ids = [np.frombuffer(row[x], np.int64) for x in ("qids", "cids")]
                vectors = [np.frombuffer(row[x], np.float64).reshape(-1, d) for x in ("q", "c")]
                got = best_in_tile(ids[0], vectors[0], ids[1], vectors[1], k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["query_id", "vec_id", "score"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["query_id"]):
            rows = zip((-g.column("score").to_numpy()).tolist(), g.column("vec_id").to_pylist(), strict=True)
            best = heapq.nsmallest(k, set(rows))
            yield pa.RecordBatch.from_pydict({
                "query_id": pa.array([g.column("query_id")[0].as_py()] * len(best), pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()),
                "vec_id": pa.array([x[1] for x in best], pa.int64()), "score": pa.array([-x[0] for x in best], pa.float64()),
            })

    hits = left.join(right, ["dim", "stripe"]).select("dim", "qids", "q", "cids", "c").mapInArrow(tiles, _HIT)
    return hits.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merged, "query_id long, rank int, vec_id long, score double")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"))


OP5_SQL = """
with v as (
  select distinct vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x != 0)) > 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score
  from v q join v c on len(q.e) = len(c.e) and q.vec_id != c.vec_id where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from pairs qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""
