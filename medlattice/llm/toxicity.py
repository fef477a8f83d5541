"""Toxic spans by a linear-chain conditional random field, trained here, and document scores from its marginals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, row_slices, table, written
from .words import LOWER, hash_spans, spans, text_bytes

#: Labelled documents of each class that the model is fitted on, at most.
TRAIN_ROWS = 4000
#: Hashed word features.
WIDTH = 1 << 18
#: Words of a training window, windows per document, windows of each class at most.
WINDOW, PER_DOC, WINDOWS = 48, 4, 1500
#: A word of a toxic document counts as toxic if it is in at least this share of the toxic and if, of the documents that hold it, at
#: least this share is toxic (classes weighted alike).
SUPPORT, PRECISION = 0.02, 0.9
#: Share of the clean training documents that may score 0.5 or more.
FALSE_ALARMS = 1 / 64
_SLICE = 4_000_000
#: What can't be part of a word: ASCII but letters and digits.
_BLANK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature number, begin and end byte of each word, and how many words come before each row."""
    data, at = text_bytes(column)
    start, end, first = spans(_BLANK[data], at)
    return (hash_spans(LOWER[data], start, end) % np.uint64(WIDTH)).astype(np.int64), start, end, first


@dataclass
class Tagger:
    """Weights of label 1 against label 0 (own, previous and next word, bias), transitions [from, to], and the calibration."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    move: np.ndarray
    fit: np.ndarray

    def potentials(self, f: np.ndarray, first: np.ndarray) -> np.ndarray:
        e = self.own[f] + np.float32(self.bias)
        n = len(f)
        if n > 1:
            starts = np.zeros(n + 1, bool)
            starts[first] = True
            inner = ~starts[1:n]
            e[1:] += np.where(inner, self.before[f[:-1]], 0)
            e[:-1] += np.where(inner, self.after[f[1:]], 0)
        return e


def marginals(e: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """P(label 1) of each token by forward-backward over all rows at once; first: how many tokens come before each row.

    With two labels a message is one log ratio; a step works on all rows that are long enough, longest first.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], first[:-1][order]
    live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # rows longer than t
    ahead, back = np.zeros(len(e)), np.zeros(len(e))
    (a00, a01), (a10, a11) = np.exp(move)
    r = np.zeros(len(size))
    for t, k in enumerate(live.tolist()):
        at = begin[:k] + t
        if t:
            x = np.exp(np.clip(r[:k], -40, 40))
            r[:k] = np.log((a01 + a11 * x) / (a00 + a10 * x)) + e[at]
        else:
            r[:k] = e[at]
        ahead[at] = r[:k]
    r[:] = 0
    last = begin + size - 1
    for t, k in enumerate(live.tolist()):
        at = last[:k] - t
        back[at] = r[:k]
        x = np.exp(np.clip(r[:k] + e[at], -40, 40))
        r[:k] = np.log((a10 + a11 * x) / (a00 + a01 * x))
    return 1 / (1 + np.exp(-np.clip(ahead + back, -40, 40)))


def _pooled(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row: logit of the largest marginal, and log of 1 plus the expected number of toxic words."""
    n = len(first) - 1
    out = np.zeros((n, 2))
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        top = np.maximum.reduceat(p, first[:-1][full])
        top = np.clip(top, 1e-6, 1 - 1e-6)
        out[full, 0] = np.log(top / (1 - top))
        out[full, 1] = np.log1p(np.add.reduceat(p, first[:-1][full]))
    none = np.diff(first) == 0
    out[none, 0] = np.log(1e-6)
    return out


def _class_counts(sample: DataFrame) -> np.ndarray:
    """[2, WIDTH]: in how many documents of each class a feature occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, WIDTH), np.int32)
        for b in batches:
            for part in row_slices(b):
                f, _, _, first = tokens(part.column(part.schema.get_field_index("text")))
                label = part.column(part.schema.get_field_index("label")).to_pylist()
                for y, i, j in zip(label, first[:-1].tolist(), first[1:].tolist(), strict=True):
                    total[y, np.unique(f[i:j])] += 1
        yield pa.RecordBatch.from_pydict({"counts": [total.tobytes()]})

    rows = sample.repartition(4).mapInArrow(count, "counts binary").collect()
    return sum((np.frombuffer(r[0], np.int32).reshape(2, WIDTH) for r in rows), np.zeros((2, WIDTH), np.int32))


def _train_windows(sample: DataFrame, toxic_word: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, word labels) of windows of the sampled documents, at most WINDOWS of each class."""
    marks = np.packbits(toxic_word).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic = np.unpackbits(np.frombuffer(marks, np.uint8)).astype(bool)
        for b in batches:
            for part in row_slices(b):
                f, _, _, first = tokens(part.column(part.schema.get_field_index("text")))
                label = part.column(part.schema.get_field_index("label")).to_pylist()
                rows = {"label": [], "features": [], "labels": []}
                for y, i, j in zip(label, first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = f[i:j]
                    found = np.flatnonzero(toxic[own]) if y else np.zeros(0, int)
                    middles = found[:PER_DOC] if len(found) else np.linspace(0, max(0, j - i - 1), 2).astype(int)
                    for m in middles.tolist():
                        x = own[max(0, m - WINDOW // 2) : m + WINDOW // 2]
                        if len(x) and bool(y) == bool(len(found)):
                            rows["label"].append(y)
                            rows["features"].append(x.tobytes())
                            rows["labels"].append((toxic[x] & bool(y)).tobytes())
                yield pa.RecordBatch.from_pydict({"label": pa.array(rows["label"], pa.int32()), "features": pa.array(rows["features"], pa.binary()), "labels": pa.array(rows["labels"], pa.binary())})

    made = sample.mapInArrow(cut, "label int, features binary, labels binary")
    rows = [r for y in (0, 1) for r in made.where(F.col("label") == y).orderBy(F.xxhash64("features"), "features").limit(WINDOWS).collect()]
    return [(np.frombuffer(r["features"], np.int64), np.frombuffer(r["labels"], bool)) for r in rows]


def _fit_chain(data: list[tuple[np.ndarray, np.ndarray]], epochs: int = 40, rate: float = 0.3, decay: float = 1e-3) -> tuple:
    """Maximum likelihood by full-batch gradient steps (Adam); expectations come from forward-backward."""
    first = np.concatenate([[0], np.cumsum([len(x) for x, _ in data])])
    f = np.concatenate([x for x, _ in data])
    y = np.concatenate([v for _, v in data]).astype(np.float64)
    inner = np.ones(len(f), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    names, slot = np.unique(f, return_inverse=True)
    weights = [np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names)), np.zeros(1), np.zeros((2, 2))]
    m1, m2 = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    gold = np.zeros((2, 2))
    np.add.at(gold, (y[at - 1].astype(int), y[at].astype(int)), 1)
    for step in range(1, epochs + 1):
        own, before, after, bias, move = weights
        e = own[slot] + bias[0]
        e[at] += before[slot[at - 1]]
        e[at - 1] += after[slot[at]]
        p = marginals(e, first, move)
        # P(y[t-1]=1, y[t]=1): from the log ratios of both sides of the pair
        full = pair_expectation(e, first, move, at)
        off = p - y
        grad = [np.bincount(slot, off, len(names)), np.bincount(slot[at - 1], off[at], len(names)), np.bincount(slot[at], off[at - 1], len(names)), np.array([off.sum()]), full - gold]
        for i, g in enumerate(grad):
            g = g / len(data) + decay * weights[i]
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.99 * m2[i] + 0.01 * g * g
            weights[i] = weights[i] - rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-8)
    return names, *weights


def pair_expectation(e: np.ndarray, first: np.ndarray, move: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Expected number of transitions [from, to] over all pairs (t-1, t) for t in at."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], first[:-1][order]
    live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    a = np.exp(move)
    ahead, back = np.zeros(len(e)), np.zeros(len(e))
    r = np.zeros(len(size))
    for t, k in enumerate(live.tolist()):
        i = begin[:k] + t
        x = np.exp(np.clip(r[:k], -40, 40))
        r[:k] = (np.log((a[0, 1] + a[1, 1] * x) / (a[0, 0] + a[1, 0] * x)) if t else 0) + e[i]
        ahead[i] = r[:k]
    r[:] = 0
    last = begin + size - 1
    for t, k in enumerate(live.tolist()):
        i = last[:k] - t
        back[i] = r[:k]
        x = np.exp(np.clip(r[:k] + e[i], -40, 40))
        r[:k] = np.log((a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x))
    left = np.clip(ahead[at - 1], -40, 40)
    right = np.clip(e[at] + back[at], -40, 40)
    joint = np.array([[np.zeros(len(at)), right], [left, left + right]]) + move[:, :, None]
    joint = np.exp(joint - joint.max(axis=(0, 1)))
    return (joint / joint.sum(axis=(0, 1))).sum(axis=2)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights [bias, ...] of a logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def fit_tagger(docs: DataFrame, labels: DataFrame) -> Tagger | float:
    """A tagger from labelled documents whose crc32(doc_id) mod 5 is not 0; the toxic share if there is only one class or none.

    Fitted on at most TRAIN_ROWS rows of each class, those with the least hash of doc_id and text. Null labels don't count; a doc_id
    that is labelled twice is toxic if any label says so. If no text of one of the classes is there, the share of toxic labels too.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return float(1 in totals)
    some = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS) for y in (0, 1)]
    chosen = written(some[0].unionByName(some[1]), "toxic-rows")  # 2 * TRAIN_ROWS rows at most
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # a doc_id may repeat
    least = [rows.where(F.col("label") == y).orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(TRAIN_ROWS) for y in (0, 1)]
    sample = written(least[0].unionByName(least[1]), "toxic-sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return totals[1] / sum(totals.values())
    counts = _class_counts(sample)
    share = counts / np.array([[max(1, sizes.get(0, 0))], [max(1, sizes.get(1, 0))]])
    enough = counts[1] >= max(3, SUPPORT * sizes.get(1, 0))
    toxic_word = enough & (share[1] / np.maximum(share.sum(axis=0), 1e-12) >= PRECISION)
    data = _train_windows(sample, toxic_word)
    if not any(y.any() for _, y in data):
        return totals[1] / sum(totals.values())
    names, own, before, after, bias, move = _fit_chain(data)
    spread = [np.zeros(WIDTH, np.float32) for _ in range(3)]
    for to, w in zip(spread, (own, before, after), strict=True):
        to[names] = w
    tagger = Tagger(*spread, float(bias[0]), move, np.zeros(3))
    rows = _scan(sample.select("doc_id", "text", "label"), tagger, "label").select("label", "features").collect()
    y = np.array([r["label"] for r in rows], float)
    weight = np.where(y == 1, 1 / max(1, sizes[1]), 1 / max(1, sizes[0]))  # classes weighted alike, however rare one is
    features = np.array([r["features"] for r in rows])
    tagger.fit = _logistic(features, y, weight / weight.mean())
    clean = np.sort(tagger.fit[0] + features[y == 0] @ tagger.fit[1:])
    tagger.fit[0] -= max(0.0, clean[-1 - int(FALSE_ALARMS * len(clean))] + 1e-6)
    return tagger


def _scan(docs: DataFrame, tagger: Tagger, extra: str = "") -> DataFrame:
    """doc_id, features, score and spans (begin, end in characters, probability) of each row."""
    model = docs.sparkSession.sparkContext.broadcast(tagger)
    kinds = "doc_id long, features array<double>, score double, spans array<struct<begin:long,end:long,probability:double>>"
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = model.value
        for batch in batches:
            for part in row_slices(batch, most=_SLICE):
                column = part.column(1)
                f, start, end, first = tokens(column)
                p = marginals(t.potentials(f, first), first, t.move)
                features = _pooled(p, first)
                score = 1 / (1 + np.exp(-np.clip(t.fit[0] + features @ t.fit[1:], -30, 30)))
                found: list[list] = [[] for _ in range(part.num_rows)]
                hot = np.flatnonzero(p >= 0.5)
                row = np.searchsorted(first, hot, "right") - 1
                data, at = text_bytes(column) if len(hot) else (None, None)
                for r in np.unique(row).tolist():
                    own = hot[row == r]
                    for run_of in np.split(own, np.flatnonzero(np.diff(own) != 1) + 1):
                        b, e = int(start[run_of[0]]), int(end[run_of[-1]])
                        begin = len(data[at[r] : b].tobytes().decode())
                        found[r].append({"begin": begin, "end": begin + len(data[b:e].tobytes().decode()), "probability": float(p[run_of].max())})
                cols = [part.column(0).cast(pa.int64()), pa.array(list(features), pa.list_(pa.float64())), pa.array(score), pa.array(found, span)]
                yield pa.RecordBatch.from_arrays(cols + ([part.column(2)] if extra else []), names=["doc_id", "features", "score", "spans", *([extra] if extra else [])])

    return docs.mapInArrow(run, kinds + (f", {extra} int" if extra else ""))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score (0 to 1), predicted (score >= 0.5), spans.

    The chain's features are the word itself and its neighbours; labels, lang, source and doc_id are never inputs. Null and empty
    texts and texts without words get the score of a text without any sign. Repeated rows are scored alike; further columns don't matter. Without labels of both
    classes every text gets the share of toxic labels (0 if there are none) and no spans.
    """
    tagger = fit_tagger(docs, labels)
    if isinstance(tagger, float):
        none = F.lit(None).cast("array<struct<begin:long,end:long,probability:double>>")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(tagger).alias("score"), F.coalesce(none, F.array()).alias("spans"))
    else:
        rows = _scan(docs.select("doc_id", "text"), tagger)
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose score is below 0.5; scored in place, so no text is shuffled."""
    tagger = fit_tagger(docs, labels)
    if isinstance(tagger, float):
        return docs.where(F.lit(tagger < 0.5))
    model = docs.sparkSession.sparkContext.broadcast(tagger)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = model.value
        for batch in batches:
            for part in row_slices(batch, most=_SLICE):
                f, _, _, first = tokens(part.column(place))
                z = t.fit[0] + _pooled(marginals(t.potentials(f, first), first, t.move), first) @ t.fit[1:]
                yield part.filter(pa.array(z < 0))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
