"""Packing of documents into sequences of a fixed size, in order, by dynamic programming over cuts.

The documents' ids are written as token files in ascending doc_id order (tokens.py). In each shard the cuts between sequences are chosen
among the ends of documents, the ends of sentences, and places within long sentences. A sequence pays its padding (none if its size is a
power of two), a small constant, and a penalty for a cut that splits a sentence or a document. With T the ids before a cut and f the least
cost up to it, f(j) = penalty(j) + size - T(j) + min(f(i) + T(i)) over the cuts i at most `size` ids back: the minimum of a sliding
window, kept by a queue whose values ascend. Sequences whose size is a power of two are looked up apart, at most log2(size) for a cut.
The order of ids is kept, so a sequence is a slice of a shard's token file.

Defined results: null and empty texts are their end id alone; rows whose doc_id is null come first, rows that repeat one are ordered by
their text; each shard's last sequence may be short; an empty table has no pieces. Costs that tie take the cut found first: the window's
earliest, then smaller powers of two.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .tokens import NO_ID, mapped, write_tokens

SIZE = 2048
#: In ids of padding: what a sequence costs besides its padding, and cuts at the end of a sentence and within one.
EACH, SENTENCE, WITHIN = 128, 4, 64
#: One end of a sentence in each stretch of so many ids is a place to cut; in sentences of more than LONG ids there is one each LONG / 2.
STRETCH, LONG = 8, 128
#: Ids looked at together.
PASS = 2_000_000
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence int, offset long, shard int, place long"


def sentence_marks(tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """By id: closes a sentence; is a digit (a point before one doesn't close)."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(tokenizer).get_vocab()
    closes, digit = np.zeros(max(vocab.values()) + 1, bool), np.zeros(max(vocab.values()) + 1, bool)
    for piece, i in vocab.items():
        text = piece.removesuffix("</w>")
        closes[i] = bool(text) and text[0] in ".!?…。！？" and all(c in ".!?…。！？\"')]" for c in text)
        digit[i] = text[:1].isdigit()
    return closes, digit


def places(tokens: np.ndarray, ends: np.ndarray, closes: np.ndarray, digit: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Where a shard may be cut, ascending from 0, and the penalty of each. ends: where its documents end."""
    found = []
    for at in range(0, len(tokens), PASS):
        part = tokens[at : at + PASS + 1]
        stop = np.flatnonzero(closes[part[:PASS]] & ~digit[np.concatenate([part[1:], part[:1]])[: min(PASS, len(part))]]) + at + 1
        found.append(stop[np.flatnonzero(np.diff(stop // STRETCH, prepend=-1))])
    stops = np.union1d(np.concatenate([[0], *found]), ends).astype(np.int64)
    stops = stops[stops <= len(tokens)]
    gap = np.diff(stops)
    long = np.flatnonzero(gap > LONG)
    step = LONG // 2
    many = (gap[long] - 1) // step
    inner = np.repeat(stops[long], many) + step * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1)
    last = np.arange(max(0, len(tokens) - 2 * size), len(tokens) + 1)  # what is left at the end may take any cut
    cuts = np.union1d(np.union1d(stops, inner), last).astype(np.int64)
    penalty = np.full(len(cuts), WITHIN, np.int64)
    penalty[np.isin(cuts, stops, assume_unique=True)] = SENTENCE
    penalty[np.isin(cuts, ends)] = 0
    penalty[0] = 0
    return cuts, penalty


def cheapest(cuts: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, int]:
    """The cuts of least total cost, from the first to the last, and that cost. Neighbours must be at most `size` apart."""
    powers = [1 << k for k in range(size.bit_length()) if 1 << k < size]
    cost, back = array("q", [0]), array("q", [-1])
    queue: deque[tuple[int, int, int]] = deque([(int(cuts[0]), 0, int(cuts[0]))])
    for lo in range(1, len(cuts), 50_000):
        here = cuts[lo : lo + 50_000]
        hit_j, hit_i = [], []
        for p in powers:
            i = np.searchsorted(cuts, here - p)
            ok = np.flatnonzero(cuts[i] == here - p)
            hit_j.append(ok)
            hit_i.append(i[ok])
        hit_j, hit_i = np.concatenate(hit_j), np.concatenate(hit_i)
        order = np.argsort(hit_j, kind="stable")
        exact = hit_i[order].tolist()
        upto = np.searchsorted(hit_j[order], np.arange(len(here)), "right").tolist()
        begin = 0
        for k, (t, own) in enumerate(zip(here.tolist(), penalty[lo : lo + 50_000].tolist(), strict=True)):
            while queue[0][2] < t - size:
                queue.popleft()
            value, best, _ = queue[0]
            least = value + size - t
            for i in exact[begin : upto[k]]:
                if cost[i] < least:
                    least, best = cost[i], i
            begin = upto[k]
            least += own + EACH
            cost.append(least)
            back.append(best)
            value = least + t
            while queue and queue[-1][0] > value:
                queue.pop()
            queue.append((value, lo + k, t))
    at, chosen = len(cuts) - 1, []
    while at >= 0:
        chosen.append(at)
        at = back[at]
    return cuts[np.array(chosen[::-1])], cost[-1]


def _pieces(tokens: np.ndarray, ends: np.ndarray, ids: np.ndarray, shard: int, size: int, closes: np.ndarray, digit: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A shard's pieces, in order. ends: the end of each document; ids: its doc_id."""
    cuts, _ = cheapest(*places(tokens, ends, closes, digit, size), size)
    edge = np.union1d(cuts, ends)
    begin, stop = edge[:-1], edge[1:]
    doc = np.searchsorted(ends, begin, "right")
    sequence = np.searchsorted(cuts, begin, "right") - 1
    first = np.concatenate([[0], ends[:-1]])
    for i in range(0, len(begin), 10_000):
        b, e, d, s = begin[i : i + 10_000], stop[i : i + 10_000], doc[i : i + 10_000], sequence[i : i + 10_000]
        crc = [zlib.crc32(tokens[x:y].astype("<u4").data) for x, y in zip(b.tolist(), e.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([
            pa.array(ids[d], pa.int64(), mask=ids[d] == NO_ID), pa.array(b - first[d], pa.int64()), pa.array(e - b, pa.int64()), pa.array(crc, pa.int64()), pa.array(ends[d] - first[d], pa.int64()),
            pa.array(s, pa.int32()), pa.array(b - cuts[s], pa.int64()), pa.array(np.full(len(b), shard), pa.int32()), pa.array(b, pa.int64()),
        ], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset", "shard", "place"])


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, words_apart: bool = False) -> tuple[DataFrame, DataFrame]:
    """The token files' manifest, and the pieces that the sequences are made of: one row for each piece of a document.

    A piece's ids are `length` ids of its shard's token file from `place` on. Sequences are numbered from 0 over all shards, in order.
    """
    manifest = write_tokens(docs, tokenizer, end_id, words_apart)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sentence_marks(tokenizer)
        for b in batches:
            for row in b.to_pylist():
                ids, at = mapped(f"{row['path']}.ids", "<i8"), mapped(f"{row['path']}.index", "<i8")
                yield from _pieces(mapped(f"{row['path']}.tokens", f"<u{row['width']}"), np.asarray(at[1:]), np.asarray(ids), row["shard"], size, *marks)

    pieces = written(manifest.select("shard", "path", "width").repartition(F.col("shard")).mapInArrow(cut, _PIECE), "pieces")
    # One row for each shard: no more than there are partitions.
    counts = pieces.groupBy("shard").agg((F.max("sequence") + 1).alias("many"))
    before = F.coalesce(F.sum("many").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = F.broadcast(counts.select("shard", before.alias("before")))
    return manifest, pieces.join(base, "shard").withColumn("sequence_id", F.col("before") + F.col("sequence")).drop("before", "sequence")


def sequences(manifest: DataFrame, pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_docs, n_tokens, ids): every sequence's ids as little-endian integers of its shard's width, without padding."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, np.ndarray] = {}
        for b in batches:
            rows = b.to_pylist()
            for path, width in {(r["path"], r["width"]) for r in rows} - {(p, f.itemsize) for p, f in files.items()}:
                files = {path: mapped(f"{path}.tokens", f"<u{width}"), **dict(list(files.items())[:3])}
            out = []
            for r in rows:
                tokens = files.get(r["path"])
                out.append((mapped(f"{r['path']}.tokens", f"<u{r['width']}") if tokens is None else tokens)[r["place"] : r["place"] + r["n_tokens"]].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], names=["sequence_id", "n_docs", "n_tokens", "ids"])

    whole = pieces.groupBy("sequence_id", "shard").agg(F.count("*").alias("n_docs"), F.sum("length").alias("n_tokens"), F.min("place").alias("place"))
    at = whole.join(manifest.select("shard", "path", "width"), "shard").select("sequence_id", "n_docs", "n_tokens", "place", "path", "width")
    return at.repartition("path").sortWithinPartitions("path", "place").mapInArrow(read, "sequence_id long, n_docs long, n_tokens long, ids binary")


def op12_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    at = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    _, pieces = pack(table(spark, sf_dir, "documents"), at, end_id=1, words_apart=True)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "shard", "place")
