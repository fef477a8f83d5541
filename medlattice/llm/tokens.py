"""Token ids as flat binary files with 64-bit document offsets, memory-mapped when read.

A shard is three files of little-endian values: `.tokens` (uint16 where the vocabulary fits, else uint32), `.index` (int64 begin of
each document within the shard, and the end) and `.ids` (int64 doc_id; the least int64 stands for null). Shards follow each other
in ascending doc_id order; the manifest (a table beside them) gives each shard's number, path and sizes, and its base, the number
of ids in all shards before it, as a prefix sum.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, row_slices, table, written

NO_ID = -(1 << 63)
#: Words kept with their ids in a worker; the cache is emptied when full.
CACHE_WORDS = 900_000
#: Text bytes whose distinct words are looked up together.
WORD_BYTES = 8_000_000
#: What may close a word: no white space, letter, digit, apostrophe or mark that joins the character before.
POINTS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
_MANIFEST = "shard int, path string, n_docs long, n_tokens long, width int"
_WORKER: dict = {}


class WordEncoder:
    """The tokenizer's ids of whole texts.

    With words_apart (for tokenizers that lower-case, drop white space, never merge across it, and set letters apart from other
    characters) each distinct word is encoded once per worker, capitals and closing points apart; words are sent to the
    library many at a time, set apart by a special token.
    """

    def __init__(self, path: str, words_apart: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized and not t.lstrip and not t.rstrip]
        self.apart = words_apart and bool(special)
        self.mark, self.between = special[0] if special else (None, None)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(1 << 16 if self.dtype.itemsize == 2 else self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True
        self.lettered = bool(self.ends.any())
        self.known: dict[str, bytes] = {"": b""}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        odd = [w for w in words if "<|" in w]
        self.known.update(zip(odd, self._raw(odd), strict=True))
        letters = [w for w in words if w.isalpha()] if self.lettered else []  # one end of word in each
        rest = [w for w in words if "<|" not in w and not (self.lettered and w.isalpha())]
        for part, between in [(letters[i : i + 500], " ") for i in range(0, len(letters), 500)] + [(rest[i : i + 500], self.between) for i in range(0, len(rest), 500)]:
            ids = np.array(self.tokenizer.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, self.dtype)
            if between == " ":
                end = np.flatnonzero(self.ends[ids]) + 1
                begin = np.concatenate([[0], end[:-1]])
            else:
                cut = np.flatnonzero(ids == self.mark)
                begin, end = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(ids)]])
            if len(begin) != len(part):
                self.known.update(zip(part, self._raw(part), strict=True))
                continue
            raw, size = ids.tobytes(), self.dtype.itemsize
            self.known.update(zip(part, [raw[b * size : e * size] for b, e in zip(begin.tolist(), end.tolist(), strict=True)], strict=True))

    def _learn_forms(self, words: list[str]) -> None:
        """Learns words by their lower-case form, with the points after a closing letter apart."""
        known = self.known
        forms = []
        for w in words:
            base = w.rstrip(POINTS)
            if len(base) < len(w) and (not base[-1:].isalpha() or base[-1] > "\u0180" or base[-1] == "\u0130" or "<|" in w):
                base = w  # a letter that normalises to a letter and a mark would leave the mark with the points
            tail = w[len(base) :]
            if base.isascii() or (max(base) < "\u0180" and "\u0130" not in base):  # beyond, lower case may depend on the library
                base = base.lower()
            forms.append((w, base, tail))
        self._learn(list({x for _, base, tail in forms for x in (base, tail) if x not in known}))
        for w, base, tail in forms:
            known[w] = known[base] + known[tail]

    def __call__(self, texts: pa.Array) -> pa.LargeBinaryArray:
        """The ids of each text of a column without nulls.

        The distinct words of the column are looked up once each; the ids of all words are then one take, and those of a text
        are a slice of it.
        """
        if not self.apart:
            return pa.array(self._raw(texts.to_pylist()), pa.large_binary())
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        fresh = [w for w in words if w not in known]
        if len(known) + len(fresh) > CACHE_WORDS:
            known.clear()
            known[""] = b""
            fresh = words
        self._learn_forms(fresh)
        flat = pa.array([known[w] for w in words], pa.large_binary()).take(coded.indices)
        at = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1)[np.asarray(split.offsets)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at), flat.buffers()[2]])


def _encoder(path: str, words_apart: bool) -> WordEncoder:
    if (key := (path, words_apart)) not in _WORKER:
        _WORKER[key] = WordEncoder(path, words_apart)
    return _WORKER[key]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, words_apart: bool = False) -> DataFrame:
    """Encodes (doc_id, text) into shards in the shared folder; returns the manifest with bases.

    Documents are dealt out by ranges of doc_id, so that shards follow each other in that order; rows that repeat a doc_id are
    ordered by their text, null ids come first, null and empty texts give the end id alone. Each task streams its rows into files
    of its own name, and the manifest row that it returns names them: only files of tasks that counted are ever read.
    """
    spark = docs.sparkSession
    root = fresh_path(spark, "tokens")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _encoder(tokenizer, words_apart)
        fs, top = pafs.FileSystem.from_uri(root)
        fs.create_dir(top, recursive=True)
        shard = TaskContext.get().partitionId()
        path = f"{top}/{shard:06d}-{uuid.uuid4().hex}"
        end = np.array([end_id], of.dtype).tobytes()
        begin, ids, at = [], [], 0
        with fs.open_output_stream(f"{path}.tokens") as out:
            for batch in batches:
                for part in row_slices(batch, most=WORD_BYTES):
                    coded = of(part.column(1).fill_null("")).to_pylist()
                    ids.append(part.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy())
                    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // of.dtype.itemsize + 1
                    begin.append(at + np.cumsum(sizes) - sizes)
                    at += int(sizes.sum())
                    out.write(end.join([*coded, b""]))
        n = sum(map(len, ids))
        if n:
            with fs.open_output_stream(f"{path}.index") as f:
                f.write(np.concatenate([*begin, [at]]).astype("<i8").tobytes())
            with fs.open_output_stream(f"{path}.ids") as f:
                f.write(np.concatenate(ids).astype("<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{root}/{path.rpartition('/')[2]}"], "n_docs": pa.array([n], pa.int64()), "n_tokens": pa.array([at], pa.int64()), "width": pa.array([of.dtype.itemsize], pa.int32())})
        else:
            fs.delete_file(f"{path}.tokens")

    placed = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(placed.mapInArrow(encode, _MANIFEST), "manifest")
    # One row per shard, so a window over all of them stays small.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def mapped(uri: str, dtype: str) -> np.ndarray:
    """A file's values: memory-mapped on a mounted file system, read at once from any other."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if not fs.get_file_info(path).size:
        return np.zeros(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = mapped(f"{row['path']}.ids", "<i8")
                at = mapped(f"{row['path']}.index", "<i8")
                tokens = mapped(f"{row['path']}.tokens", f"<u{row['width']}")
                for i in range(0, len(ids), 10_000):
                    part, cut = ids[i : i + 10_000], at[i : i + 10_001]
                    crc = [zlib.crc32(tokens[x:y].astype("<u4").data) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(part, pa.int64(), mask=part == NO_ID), pa.array(cut[:-1] + row["base"], pa.int64()), pa.array(np.diff(cut), pa.int64()),
                        pa.array(crc, pa.int64()), pa.array(np.full(len(part), row["shard"]), pa.int32()),
                    ], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    spread = manifest.select("shard", "path", "width", "base").repartition(F.col("shard"))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def op1_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    at = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), at, end_id=2, words_apart=True))
