"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, row_slices, table, written
from .words import LOWER, text_bytes

#: Units of each direction, and bytes of a window: the network reads a text as windows, each from a state of zeros.
UNITS, WINDOW = 8, 64
#: Rows of each language that training uses, rows of all together (but one of each language at least), windows of each, at most.
TRAIN_DOCS, TRAIN_ALL, DOC_WINDOWS = 400, 25_600, 8
#: Windows that one pass of the network takes.
_AT_ONCE = 4096
_LETTER = np.array([chr(c).isalpha() if c < 128 else True for c in range(256)])


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the two-byte capitals of Latin-1 in lower case."""
    out = LOWER[data]
    if len(data) > 1:
        accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][accented] += 0x20
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 30, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Direction:
    """Input table [3H, 256] (update, reset, candidate), recurrent weights [2H, H] and [H, H]."""

    table: np.ndarray
    gates: np.ndarray
    state: np.ndarray

    def run(self, x: np.ndarray, keep: bool = False):
        """States [T, H, n] for bytes x [T, n]; with keep also what the backward pass needs."""
        t_all, n = x.shape
        k = self.state.shape[0]
        h = np.zeros((k, n), np.float32)
        out = np.empty((t_all, k, n), np.float32)
        held = []
        for t in range(t_all):
            given = self.table.take(x[t], axis=1)
            zr = given[: 2 * k]
            zr += self.gates @ h
            zr = _sigmoid(zr)
            z, r = zr[:k], zr[k:]
            rh = r * h
            c = given[2 * k :]
            c += self.state @ rh
            c = np.tanh(c, out=c)
            new = np.subtract(c, h, out=out[t])
            new *= z
            new += h
            if keep:
                held.append((h, z, r, rh, c))
            h = new
        return (out, held) if keep else out

    def back(self, x: np.ndarray, d_out: np.ndarray, held: list) -> list[np.ndarray]:
        """Gradients of table, gates and state by backpropagation through time."""
        d_table, d_gates, d_state = np.zeros_like(self.table), np.zeros_like(self.gates), np.zeros_like(self.state)
        d_h = np.zeros(d_out.shape[1:], np.float32)
        for t in range(len(held) - 1, -1, -1):
            h, z, r, rh, c = held[t]
            d_h = d_h + d_out[t]
            d_c = d_h * z * (1 - c * c)
            d_rh = self.state.T @ d_c
            d_zr = np.concatenate([d_h * (c - h) * z * (1 - z), d_rh * h * r * (1 - r)])
            hot = np.zeros((256, x.shape[1]), np.float32)
            hot[x[t], np.arange(x.shape[1])] = 1
            d_table += np.concatenate([d_zr, d_c]) @ hot.T
            d_gates += d_zr @ h.T
            d_state += d_c @ rh.T
            d_h = d_h * (1 - z) + d_rh * r + self.gates.T @ d_zr
        return [d_table, d_gates, d_state]


@dataclass
class Network:
    languages: list[str]
    forth: Direction
    back: Direction
    out: np.ndarray
    bias: np.ndarray

    def positions(self, x: np.ndarray) -> np.ndarray:
        """P(language) of each position: [T, L, n] for bytes [T, n]."""
        k = UNITS
        logits = self.out[:, :k] @ self.forth.run(x)
        logits += (self.out[:, k:] @ self.back.run(x[::-1]))[::-1]
        logits += self.bias[:, None]
        return _softmax(logits)


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 256, rate: float = 0.02) -> Network:
    """A network from windows x [n, WINDOW] of bytes and their languages y: each letter's label is its text's language."""
    rng = np.random.default_rng(7)
    k, n_lang = UNITS, len(languages)
    new = lambda *s: (rng.standard_normal(s) / np.sqrt(s[1] if s[1] < 256 else 4)).astype(np.float32)
    net = Network(languages, *(Direction(new(3 * k, 256), new(2 * k, k), new(k, k)) for _ in range(2)), new(n_lang, 2 * k), np.zeros(n_lang, np.float32))
    params = [p for d in (net.forth, net.back) for p in (d.table, d.gates, d.state)] + [net.out, net.bias]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, most = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            bytes_, label = x[own].T.astype(np.int64), y[own]
            forth, held_f = net.forth.run(bytes_, True)
            back, held_b = net.back.run(bytes_[::-1], True)
            both = np.concatenate([forth, back[::-1]], axis=1)
            p = _softmax(net.out @ both + net.bias[:, None])
            p[:, label, np.arange(len(own))] -= 1
            p *= (_LETTER[bytes_] / max(1, int(_LETTER[bytes_].sum())))[:, None, :].astype(np.float32)
            d_both = net.out.T @ p
            grads = net.forth.back(bytes_, d_both[:, :k], held_f) + net.back.back(bytes_[::-1], d_both[::-1, k:], held_b)
            grads += [np.tensordot(p, both, axes=([0, 2], [0, 2])), p.sum(axis=(0, 2))]
            step += 1
            pace = rate * (1 - 0.9 * step / most)
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for q, g, a, b in zip(params, grads, m1, m2, strict=True):
                g *= min(1.0, 1.0 / (size + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                q -= pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return net


def windows_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes [n, WINDOW] of all rows, each row padded with zeros to whole windows, and the row of each window."""
    size = np.diff(at)
    count = -(-size // WINDOW)
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()) * WINDOW, np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    out[first[row] * WINDOW + np.arange(len(data)) - at[:-1][row]] = data
    return out.reshape(-1, WINDOW), np.repeat(np.arange(len(size)), count)


def fit_language(docs: DataFrame) -> Network | None:
    """A network from the text and lang of documents whose crc32(doc_id) mod 5 is not 0; None where none has a lang and letters.

    Fitted on at most TRAIN_DOCS rows of each language (those with the least hash of doc_id and text), or fewer of each where there
    are so many languages that they would be more than TRAIN_ALL, and DOC_WINDOWS windows of each row, spread evenly over the text.
    """
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.withColumn("hash", F.xxhash64("doc_id", "text"))
    sizes = written(known.groupBy("lang").agg(F.count("*").alias("size"), F.min("hash").alias("least")), "lang-sizes")
    each = max(1, min(TRAIN_DOCS, TRAIN_ALL // max(1, sizes.count())))
    # A share of the hashes that leaves about three times as many rows of each language as are used, and its least hash in any case: rows
    # that are alike in id and text share one, and a language of few different rows must not be left out.
    share = ((F.col("hash") / F.lit(2.0**64) + 0.5) * F.col("size") < 3 * each) | (F.col("hash") == F.col("least"))
    chosen = known.join(sizes, "lang").where(share)
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    chosen = chosen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)
    chosen = written(chosen.select("text", F.col("lang").alias("label")), "lang-rows")  # TRAIN_ALL rows at most, one of each language at least

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in row_slices(b):
                x, row = windows_of(*_folded(part.column(0)))
                label = part.column(1).to_pylist()
                keep = [i for r in np.unique(row).tolist() for i in np.unique(np.linspace(*_ends(row, r), DOC_WINDOWS).astype(int)).tolist()]
                yield pa.RecordBatch.from_pydict({"label": pa.array([label[row[i]] for i in keep], pa.string()), "window": pa.array([x[i].tobytes() for i in keep], pa.binary())})

    text = chosen.where("text is not null")
    rows = sorted((r["label"], bytes(r["window"])) for r in text.mapInArrow(cut, "label string, window binary").collect())
    rows = [r for r in rows if _LETTER[np.frombuffer(r[1].rstrip(b"\0"), np.uint8)].any()]
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    x = np.array([np.frombuffer(r[1], np.uint8) for r in rows])
    y = np.array([languages.index(r[0]) for r in rows])
    most = np.bincount(y).max()  # rare languages are repeated
    own = np.concatenate([np.resize(np.flatnonzero(y == i), min(most, 8 * int((y == i).sum()))) for i in range(len(languages))])
    return train(x[own], y[own], languages, epochs=max(6, -(-12_000 // len(own))))


def _ends(row: np.ndarray, r: int) -> tuple[int, int]:
    return int(np.searchsorted(row, r, "left")), int(np.searchsorted(row, r, "right")) - 1


def _folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = text_bytes(column)
    return folded(data), at


def languages(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of docs (doc_id, text): every position of the text is labelled and the probabilities
    of its letters are averaged; score is the largest average. `und` with score 0 for null texts and texts without letters."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = model.value
        for batch in batches:
            for part in row_slices(batch):
                data, at = _folded(part.column(1))
                letter = _LETTER[data]
                count = np.add.reduceat(np.append(letter, False).astype(np.int64), at[:-1]) * (np.diff(at) > 0) if part.num_rows else np.zeros(0, int)
                plain = np.add.reduceat(np.append(letter & (data < 128), False).astype(np.int64), at[:-1]) * (np.diff(at) > 0)
                for i in np.flatnonzero((count > 0) & (plain == 0)).tolist():  # other scripts, or no letters at all
                    if not any(map(str.isalpha, part.column(1)[i].as_py())):
                        count[i] = 0
                total = np.zeros((part.num_rows, len(n.languages) if n else 1))
                if n:
                    x, row = windows_of(data, at)
                    for i in range(0, len(x), _AT_ONCE):
                        own = np.ascontiguousarray(x[i : i + _AT_ONCE].T).astype(np.intp)
                        p = n.positions(own)
                        p *= (_LETTER[own] & (own > 0))[:, None, :]
                        np.add.at(total, row[i : i + _AT_ONCE], p.sum(axis=0).T)
                known = (count > 0) & (total.sum(axis=1) > 0)
                best = total.argmax(axis=1)
                score = np.where(known, total[np.arange(len(best)), best] / np.maximum(total.sum(axis=1), 1e-12), 0.0)
                said = [n.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(said, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learned from text and non-null lang of rows that aren't held out; lang, source and doc_id are no inputs of a prediction. Null
    texts and texts without letters are `und` with score 0, as is every text where nothing can be learned. Repeated rows get the
    same prediction; very long texts are read whole, window by window. Only doc_id, text and lang are read.
    """
    rows = languages(docs, fit_language(docs))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
