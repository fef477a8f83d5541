"""SentencePiece encoding as a max-plus search, with giant documents cut into chunks that are solved apart.

A segmentation is a path through the positions of the normalised text; its weight is the sum of its pieces' scores (the unigram
model of SentencePiece; a character without a piece costs the least score less 10 and becomes its UTF-8 bytes). For a chunk, entry
state s says that a piece of the chunk before reaches s characters into it, and exit state t that its own last piece reaches t
characters into the next. The best weights from each s to each t are a matrix; matrices of neighbours combine by the max-plus
product, which is associative, so runs of chunks are combined anywhere; once each chunk's entry and exit are known, each is traced
back by itself.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import groups, row_slices, table, written

#: Characters of a chunk; documents of at most so many are solved at once. Chunks that one task combines.
CHUNK, RUN = 16_384, 256
#: Bytes of segments kept with their ids in a worker, and what an entry takes beside its own.
CACHE, ENTRY = 48_000_000, 200
#: Text bytes whose distinct segments are looked up together.
SEGMENT_BYTES = 3_000_000
#: The digest's modulus.
PRIME = (1 << 31) - 1
#: Characters of segments that are solved many at once, and how many.
SHORT, AT_ONCE = 64, 1 << 15
_NONE = -np.inf
_WORKER: dict = {}


def model_pieces(raw: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a model file: field 1 of the message, each with fields 1, 2 and 3."""

    def fields(data: bytes):
        i = 0
        while i < len(data):
            key, i = _varint(data, i)
            if key & 7 == 0:
                value, i = _varint(data, i)
            elif key & 7 == 2:
                n, i = _varint(data, i)
                value, i = data[i : i + n], i + n
            else:
                n = 4 if key & 7 == 5 else 8
                value, i = data[i : i + n], i + n
            yield key >> 3, value

    out = []
    for number, value in fields(raw):
        if number == 1:
            own = dict(fields(value))
            out.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, 1)))
    return out


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[i] & 127) << shift
        shift += 7
        i += 1
        if not data[i - 1] & 128:
            return value, i


class Pieces:
    """A model's pieces, and best paths over them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            found = model_pieces(f.read())
        self.names = [p for p, _, _ in found]
        self.ids = {p: i for i, (p, _, kind) in enumerate(found) if kind in (1, 4)}  # normal and user-defined
        self.scores = {p: float(found[i][1]) for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(found) if kind == 6}
        self.unknown = next(i for i, (_, _, kind) in enumerate(found) if kind == 2)
        self.odd = min(self.scores.values()) - 10
        self.longest = max(map(len, self.ids))
        # Every beginning of a piece, with the score of those that are pieces.
        self.begins: dict[str, float | None] = {p[:i]: None for p in self.ids for i in range(1, len(p))} | self.scores
        self.inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        if "\n" in inner or any("▁" in p.lstrip("▁") for p in self.ids):
            raise ValueError("pieces must not reach over a new line or into a word from before")
        # What an id weighs: the first byte of a character without a piece stands for it, further bytes weigh nothing.
        self.by_id = np.zeros(len(self.names))
        for p, i in self.ids.items():
            self.by_id[i] = self.scores[p]
        for b, i in self.bytes.items():
            self.by_id[i] = 0.0 if 0x80 <= b < 0xC0 else self.odd
        self.by_id[self.unknown] = self.odd
        # The beginnings as numbered states: steps holds state * n_chars + character in order, step_to where that leads.
        chars = sorted({c for p in self.ids for c in p})
        self.n_chars = len(chars) + 1
        self.char_no = np.full(max(map(ord, chars)) + 2, len(chars))
        self.char_no[[ord(c) for c in chars]] = np.arange(len(chars))
        self.pairs = np.array(sorted(int(self.char_no[ord(a)]) * self.n_chars + int(self.char_no[ord(b)]) for a, b in self.inner))
        number = {"": 0} | {p: i for i, p in enumerate(self.begins, 1)}
        steps = np.array([number[p[:-1]] * self.n_chars + self.char_no[ord(p[-1])] for p in self.begins])
        order = np.argsort(steps)
        self.steps, self.step_to = steps[order], order + 1
        self.state_id = np.array([-1, *(self.ids.get(p, -1) for p in self.begins)])
        byte = {i: bytes([b]) for b, i in self.bytes.items()}
        self.spelled = [byte.get(i, p.encode()) for i, p in enumerate(self.names)]
        self.known: dict[str, bytes] = {}
        self.solved: dict[str, bytes] = {}
        self.held = {"known": 0, "solved": 0}
        self.spellings = pa.array(self.spelled, pa.large_binary())

    def best(self, text: str, begin: int, end: int, last: int | None = None) -> tuple[float, list[int]]:
        """Weight and cut positions of the best path from begin to end; with last, its last piece begins before last. Of equal
        paths the one whose last piece, then the one before it, is longest."""
        n = end - begin
        top = [_NONE] * (n + 1)
        back = [0] * (n + 1)
        top[0] = 0.0
        begins, scores, odd = self.begins, self.scores, self.odd
        for i in range(n):
            have = top[i]
            if have == _NONE:
                continue
            at = begin + i
            if last is not None and at >= last:
                break
            if scores.get(text[at]) is None and have + odd > top[i + 1]:
                top[i + 1], back[i + 1] = have + odd, i
            for j in range(i + 1, n + 1):
                score = begins.get(text[at : begin + j], _NONE)
                if score is None:
                    continue
                if score == _NONE:
                    break
                if have + score > top[j]:
                    top[j], back[j] = have + score, i
        if top[n] == _NONE:
            return _NONE, []
        cuts = [n]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        return top[n], [begin + c for c in reversed(cuts)]

    def _chars(self, text: str) -> np.ndarray:
        """The number of each character; those of no piece have the last one."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        return self.char_no[np.minimum(code, len(self.char_no) - 1)]

    def best_of_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text's best path as best() finds it, for all texts (none is empty) at once: every piece is found by walks
        through the beginnings from all characters, then all texts are solved from left to right, one position at a time."""
        size = np.array([len(t) for t in texts], np.int64)
        at = np.cumsum(size) - size
        char = self._chars("".join(texts))
        owner = np.repeat(np.arange(len(texts)), size)
        place = np.arange(len(char)) - at[owner]
        room = size[owner] - place
        start, state, found = np.arange(len(char)), np.zeros(len(char), np.int64), []
        for n in range(1, self.longest + 1):
            start, state = start[room[start] >= n], state[room[start] >= n]
            key = state * self.n_chars + char[start + n - 1]
            where = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            met = self.steps[where] == key
            start, state = start[met], self.step_to[where[met]]
            whole = self.state_id[state] >= 0
            found.append((start[whole], np.full(int(whole.sum()), n), self.state_id[state[whole]]))
            if n == 1:
                alone = np.ones(len(char), bool)
                alone[start[whole]] = False
                odd = np.flatnonzero(alone)
                found.append((odd, np.ones(len(odd), np.int64), np.full(len(odd), -1)))
        start, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(place[start], kind="stable")
        start, length, piece = start[order], length[order], piece[order]
        cuts = np.searchsorted(place[start], np.arange(int(size.max()) + 1))
        score = np.where(piece < 0, self.odd, self.by_id[piece])
        slot = start + owner[start]  # a text of n characters has n + 1 slots
        top, back, last = (np.full(len(char) + len(texts), x) for x in (_NONE, 0, -1))
        top[at + np.arange(len(texts))] = 0.0
        for b, e in zip(cuts, cuts[1:], strict=False):
            to = slot[b:e] + length[b:e]
            weight = top[slot[b:e]] + score[b:e]
            more = weight > top[to]
            to = to[more]
            top[to], back[to], last[to] = weight[more], length[b:e][more], piece[b:e][more]
        text, now, taken = np.arange(len(texts)), at + np.arange(len(texts)) + size, []
        while len(text):
            taken.append((text, now, last[now]))
            now = now - back[now]
            left = now > at[text] + text
            text, now = text[left], now[left]
        text, now, ids = (np.concatenate(x) for x in zip(*taken, strict=True))
        order = np.argsort(now)
        text, now, ids = text[order], now[order], ids[order].astype("<i4")
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        odd = set(text[ids < 0].tolist())
        raw, ends = ids.tobytes(), ends.tolist()
        out = [raw[4 * b : 4 * e] for b, e in zip(ends, ends[1:], strict=False)]
        for k in odd:
            begin = int(at[k]) + k
            out[k] = np.array(self.spell(texts[k], [0, *(now[ends[k] : ends[k + 1]] - begin).tolist()]), "<i4").tobytes()
        return out

    def spell(self, text: str, cuts: list[int]) -> list[int]:
        out: list[int] = []
        for b, e in zip(cuts, cuts[1:], strict=False):
            if (i := self.ids.get(text[b:e])) is not None:
                out.append(i)
            else:
                out.extend(self.bytes[x] for x in text[b:e].encode()) if self.bytes else out.append(self.unknown)
        return out

    def _learn(self, keys: list[str]) -> None:
        """A key is a word after a space, or a new line and what follows it. It is cut where no piece holds the two characters on
        either side (a word from the point behind it, say), and each part is solved once."""
        if not keys:
            return
        solved = self.solved
        segments = [key if key[:1] == "\n" else "▁" + key for key in keys]
        text, stop = "".join(segments), np.cumsum([len(x) for x in segments])
        char = self._chars(text)
        two = np.append(char[:-1] * self.n_chars + char[1:], -1)
        ends = self.pairs[np.minimum(np.searchsorted(self.pairs, two), len(self.pairs) - 1)] != two
        ends[stop - 1] = True
        ends = np.flatnonzero(ends) + 1
        at = ends.tolist()
        parts = [text[b:e] for b, e in zip([0, *at], at, strict=False)]
        until = np.searchsorted(ends, stop, "right").tolist()
        new = [p for p in dict.fromkeys(parts) if p not in solved]
        short = [p for p in new if len(p) <= SHORT]
        for b in range(0, len(short), AT_ONCE):
            solved.update(zip(short[b : b + AT_ONCE], self.best_of_all(short[b : b + AT_ONCE]), strict=True))
        for p in new:
            if len(p) > SHORT:
                solved[p] = np.array(self.spell(p, self.best(p, 0, len(p))[1]), "<i4").tobytes()
            self.held["solved"] += len(p) + len(solved[p]) + ENTRY
        for key, b, e in zip(keys, [0, *until], until, strict=False):
            ids = self.known[key] = solved[parts[b]] if e == b + 1 else b"".join(map(solved.__getitem__, parts[b:e]))
            self.held["known"] += len(key) + len(ids) + ENTRY

    def _know(self, keys: list[str]) -> None:
        """Makes all keys (each given once) known; a cache that is full is emptied first."""
        for name, cache in (("known", self.known), ("solved", self.solved)):
            if self.held[name] > CACHE:
                cache.clear()
                self.held[name] = 0
        self._learn([k for k in keys if k not in self.known])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids (int32, little-endian) of each text of a column without nulls. No piece reaches over a new line or from a word over
        the space behind it, so a text falls into segments: the distinct ones of the column are looked up once each and solved
        once for each worker."""
        texts = texts.cast(pa.large_string())
        odd = pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " "))
        for x in ("  ", "▁", " \n"):
            odd = pc.or_(odd, pc.match_substring(texts, x))
        odd = pc.or_(odd, pc.equal(pc.binary_length(texts), 0))
        split = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n"), " ")
        coded = split.values.dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        apart = [_segments(normal(t)) for t in texts.filter(odd).to_pylist()]
        self._know(list({*keys, *(k for own in apart for k in own)}))
        known = self.known
        flat = pa.array([known[k] for k in keys], pa.large_binary()).take(coded.indices)
        at = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1)[np.asarray(split.offsets)].tolist()
        raw = flat.buffers()[2].to_pybytes() if len(flat) else b""
        plain = (raw[b:e] for b, e in zip(at, at[1:], strict=False))
        hard = (b"".join(map(known.__getitem__, own)) for own in apart)
        return [next(hard) if o else next(plain) for o in odd.to_pylist()]

    def intact(self, flat: np.ndarray, at: np.ndarray, texts: pa.Array) -> pa.Array:
        """Whether the ids flat[at[i]:at[i + 1]], decoded to bytes, are the normalised text i; all texts are decoded at once."""
        got = self.spellings.take(pa.array(flat))
        ends = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1)[at] if len(got) else np.zeros(len(at), np.int64)
        spelled = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends.tobytes()), (len(got) and got.buffers()[2]) or pa.py_buffer(b"")])
        texts = texts.cast(pa.large_string())
        marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar("▁", pa.large_string())), " ", "▁")
        return pc.equal(spelled, pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), marked).cast(pa.large_binary()))

    def _ids(self, keys: list[str]) -> np.ndarray:
        self._know(list(dict.fromkeys(keys)))
        return np.frombuffer(b"".join(self.known[k] for k in keys), "<i4")

    def matrix(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Best weights [entry, exit] of a chunk of n characters, and the ids between its outer cuts (None: it has none), which are on every
        path; text goes on beyond it by what a piece can reach."""
        k = self.longest
        out = np.full((k, k), _NONE)
        more = min(k - 1, len(text) - n)
        first, final = outer_cuts(text[: n + 1], k - 1)
        if first is None:
            for s in range(min(k, n + 1)):
                for t in range(more + 1):
                    out[s, t] = self.best(text, s, n + t, n)[0] if s < n else (0.0 if t == 0 else _NONE)
            return out, None
        enter = np.array([self.best(text, s, first)[0] for s in range(k)])
        ids = self._ids(_segments(text[first:final]))
        through = float(self.by_id[ids].sum())
        leave = np.full(k, _NONE)
        for t in range(more + 1):
            leave[t] = self.best(text, final, n + t, n)[0] if final < n else (0.0 if t == 0 else _NONE)
        return enter[:, None] + through + leave[None, :], ids

    def ends(self, text: str, n: int, enter: int, leave: int) -> tuple[list[int], list[int]]:
        """The ids of a chunk whose entry and exit are known, before and behind those that matrix() has (all before, if it has none)."""
        first, final = outer_cuts(text[: n + 1], self.longest - 1)
        if first is None or enter >= n:
            return self.spell(text, self.best(text, enter, n + leave, n)[1]) if enter < n else [], []
        return self.spell(text, self.best(text, enter, first)[1]), self.spell(text, self.best(text, final, n + leave, n)[1]) if final < n else []

    def decode(self, ids: list[int]) -> str:
        """The text of some ids: bytes join to characters, each mark is a space."""
        return b"".join(map(self.spelled.__getitem__, ids)).decode(errors="replace").replace("▁", " ")


def normal(text: str) -> str:
    """The text as pieces see it: spaces are marks, and one comes first."""
    return "▁" + text.replace(" ", "▁") if text else ""


def cut_places(text: str) -> list[int]:
    """Positions that no piece reaches over: before new lines, and before a mark that no mark precedes."""
    out = []
    i = text.find("▁", 1)
    while i > 0:
        if text[i - 1] != "▁":
            out.append(i)
        i = text.find("▁", i + 1)
    i = text.find("\n")
    while i >= 0:
        out.append(i)
        i = text.find("\n", i + 1)
    return sorted({x for x in out if 0 < x < len(text)})


def outer_cuts(text: str, least: int) -> tuple[int, int] | tuple[None, None]:
    """The first and the last of the text's cut places from least on."""

    def mark(find, *span: int) -> int:
        i = find("▁", *span)
        while i > 0 and text[i - 1] == "▁":
            i = find("▁", i + 1) if find == text.find else find("▁", 0, i)
        return i

    n = len(text)
    ahead = [i for i in (mark(text.find, max(least, 1)), text.find("\n", max(least, 1))) if 0 < i < n]
    back = [i for i in (mark(text.rfind, 0, n), text.rfind("\n", 0, n)) if max(least, 1) <= i < n]
    return (min(ahead), max(back)) if ahead and back else (None, None)


def _segments(text: str) -> list[str]:
    """Keys of the segments between cut places of a normalised text; a key leaves out its first mark, or begins with a new line."""
    if "▁▁" not in text and "▁\n" not in text and text[-1:] != "▁":
        return text.replace("\n", "▁\n").removeprefix("▁").split("▁") if text else []
    at = [0, *cut_places(text), len(text)]
    parts = [text[b:e] for b, e in zip(at, at[1:], strict=False)]
    return [p if p[0] == "\n" else p[1:] for p in parts]


def _model(path: str) -> Pieces:
    if path not in _WORKER:
        _WORKER[path] = Pieces(path)
    return _WORKER[path]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def through(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """The states between neighbours (entry first, exit last) of the best path; of equal ones, the least state from the back on."""
    ahead = [np.where(np.arange(len(matrices[0])) == enter, 0.0, _NONE)]
    for m in matrices:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    states = [leave]
    for v, m in zip(reversed(ahead[:-1]), reversed(matrices), strict=True):
        states.append(int(np.argmax(v + m[:, states[-1]])))
    return states[::-1]


_CHUNK = "rid long, doc_id long, chunk long, n_chunks long, n int, text string"
#: What lies between a chunk's outer cuts is encoded once, with its matrix: number and sums of its ids, whether they spell it, and the ids if asked for.
_WITHIN = "inner_n long, inner_s1 long, inner_s2 long, inner_intact boolean, inner_ids binary"
_OUT = "rid long, doc_id long, chunk long, n_chunks long, n long, s1 long, s2 long, weight double, intact boolean"


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """(rid, doc_id, chunk, n_chunks, n, s1, s2, weight, intact, ids): the ids of each row of docs, in one row or, if it is longer than CHUNK
    characters, one for each chunk (rid tells rows of docs apart, weight is then that of the whole text in chunk 0 and 0 in the
    others). n is their number, s1 and s2 the sums of id + 1, and of that times its position from 1, modulo PRIME. intact
    says that the ids spell what they stand for. Null and empty texts have no ids (and are intact)."""
    short, long = _encoded(docs, model, with_ids=True)
    return short.unionByName(long)


def _encoded(docs: DataFrame, model: str, with_ids: bool) -> tuple[DataFrame, DataFrame]:
    """encoded() of the documents of one chunk, and of the others; without with_ids the ids themselves are left out."""
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    small = F.length(F.coalesce("text", F.lit(""))) < CHUNK
    schema = _OUT + (", ids array<int>" if with_ids else "")
    names, within = ([c.split(" ")[0] for c in x.split(", ")] for x in (schema, _WITHIN))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _model(model)
        for batch in batches:
            for part in row_slices(batch, most=SEGMENT_BYTES):
                texts = part.column(2).fill_null("")
                got = of.encode(texts)
                flat = np.frombuffer(b"".join(got), "<i4")
                at = np.cumsum([0, *(len(x) // 4 for x in got)])
                n = part.num_rows
                cols = [part.column(0), part.column(1), pa.array(np.zeros(n, np.int64)), pa.array(np.ones(n, np.int64)), *_sums(flat, at, of.by_id), of.intact(flat, at, texts)]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(cols, names=names)
        pa.default_memory_pool().release_unused()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = _model(model).longest - 1
        for batch in batches:
            for rid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = normal(text)
                begins = range(0, len(text), CHUNK)
                for k, i in enumerate(begins):
                    yield pa.RecordBatch.from_pydict({
                        "rid": pa.array([rid], pa.int64()), "doc_id": pa.array([doc], pa.int64()), "chunk": pa.array([k], pa.int64()), "n_chunks": pa.array([len(begins)], pa.int64()),
                        "n": pa.array([min(CHUNK, len(text) - i)], pa.int32()), "text": pa.array([text[i : i + CHUNK + more]]),
                    })

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _model(model)
        for batch in batches:
            made, flat, intact = [], [np.zeros(0, np.int32)], []
            for t, n in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                m, ids = of.matrix(t, n)
                first, final = outer_cuts(t[: n + 1], of.longest - 1)
                made.append(m.tobytes())
                flat.append(np.zeros(0, np.int32) if ids is None else ids)
                intact.append(ids is None or of.decode(ids.tolist()) == t[first:final].replace("▁", " "))
            at = np.cumsum([0, *(len(x) for x in flat[1:])])
            n, s1, s2, _ = _sums(np.concatenate(flat), at, of.by_id)
            kept = [x.tobytes() if with_ids else None for x in flat[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary()), n, s1, s2, pa.array(intact, pa.bool_()), pa.array(kept, pa.binary())], names=["rid", "chunk", "matrix", *within])

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["rid", "run"]):
            total = None
            for m in _matrices(g):
                total = m if total is None else times(total, m)
            yield pa.RecordBatch.from_pydict({"rid": g.column("rid")[:1].combine_chunks(), "run": g.column("run")[:1].combine_chunks(), "matrix": [total.tobytes()]})

    def states(keys: list[str], last: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in groups(batches, keys):
                ends = [g.column(c)[0].as_py() for c in last] if last else [0, 0]
                ms = _matrices(g)
                found = through(ms, *ends)
                weight = times_vector(ms, *ends) if not last else 0.0
                n = g.num_rows
                yield pa.RecordBatch.from_arrays([
                    g.column("rid").combine_chunks(), g.column("run" if not last else "chunk").combine_chunks(), pa.array(found[:-1], pa.int32()), pa.array(found[1:], pa.int32()), pa.array(np.full(n, weight)),
                ], names=["rid", "run" if not last else "chunk", "enter", "leave", "total"])

        return run

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _model(model)
        for batch in batches:
            for r in batch.to_pylist():
                text, stop = r["text"], r["n"] + r["leave"]
                before, behind = of.ends(text, r["n"], r["enter"], r["leave"])
                first, final = outer_cuts(text[: r["n"] + 1], of.longest - 1)
                spans = (text[r["enter"] : stop], "") if first is None else (text[r["enter"] : first], text[final:stop])
                n, s1, s2, _ = (x.to_pylist() for x in _sums(np.array([*before, *behind], np.int64), np.array([0, len(before), len(before) + len(behind)]), of.by_id))
                place = n[0] + r["inner_n"]
                s2 = (s2[0] + r["inner_s2"] + n[0] * r["inner_s1"] + s2[1] + place * s1[1]) % PRIME
                cols = [pa.array([r[c]], pa.int64()) for c in ("rid", "doc_id", "chunk", "n_chunks")]
                cols += [pa.array([x], pa.int64()) for x in (place + n[1], (s1[0] + r["inner_s1"] + s1[1]) % PRIME, s2)]
                cols += [pa.array([r["total"] if r["chunk"] == 0 else 0.0]), pa.array([r["inner_intact"] and all(of.decode(x) == y.replace("▁", " ") for x, y in zip((before, behind), spans, strict=True))])]
                ids = [*before, *np.frombuffer(r["inner_ids"], "<i4").tolist(), *behind] if with_ids else None
                yield pa.RecordBatch.from_arrays(cols + ([pa.array([ids], pa.list_(pa.int32()))] if with_ids else []), names=names)

    short = docs.where(small).mapInArrow(whole, schema)
    chunks = written(docs.where(~small).mapInArrow(cut, _CHUNK), "chunks")  # rows are numbered once
    spread = chunks.select("rid", "chunk", "n", "text").repartition("rid", "chunk")
    matrices = written(spread.mapInArrow(weigh, "rid long, chunk long, matrix binary, " + _WITHIN).withColumn("run", F.expr(f"chunk div {RUN}")), "matrices")
    sums = matrices.select("rid", "chunk", *within)
    matrices = matrices.select("rid", "chunk", "matrix", "run")
    runs = matrices.repartition("rid", "run").sortWithinPartitions("rid", "run", "chunk").mapInArrow(product, "rid long, run long, matrix binary")
    of_run = runs.repartition("rid").sortWithinPartitions("rid", "run").mapInArrow(states(["rid"], []), "rid long, run long, enter int, leave int, total double")
    of_run = of_run.withColumnsRenamed({"enter": "run_enter", "leave": "run_leave"})
    inner = matrices.join(of_run, ["rid", "run"]).repartition("rid", "run").sortWithinPartitions("rid", "run", "chunk")
    of_chunk = inner.mapInArrow(states(["rid", "run"], ["run_enter", "run_leave"]), "rid long, chunk long, enter int, leave int, total double").drop("total")
    totals = of_run.select("rid", "total").distinct()
    long = chunks.join(of_chunk, ["rid", "chunk"]).join(sums, ["rid", "chunk"]).join(totals, "rid").mapInArrow(trace, schema)
    return short, long


def _matrices(g: pa.Table) -> list[np.ndarray]:
    raw = [np.frombuffer(x, np.float64) for x in g.column("matrix").to_pylist()]
    return [m.reshape(int(len(m) ** 0.5), -1) for m in raw]


def times_vector(matrices: list[np.ndarray], enter: int, leave: int) -> float:
    v = np.where(np.arange(len(matrices[0])) == enter, 0.0, _NONE)
    for m in matrices:
        v = (v[:, None] + m).max(axis=0)
    return float(v[leave])


def _sums(flat: np.ndarray, at: np.ndarray, by_id: np.ndarray) -> list[pa.Array]:
    """Number of ids, the two sums modulo PRIME and the weight of each run flat[at[i]:at[i + 1]]."""
    size = np.diff(at)
    place = np.arange(len(flat)) - np.repeat(at[:-1], size) + 1
    term = flat.astype(np.int64) + 1
    full = np.flatnonzero(size > 0)
    out = [np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), np.zeros(len(size))]
    if len(full):
        cut = at[:-1][full]
        for k, v in enumerate((term, term * (place % PRIME) % PRIME, by_id[flat])):
            out[k][full] = np.add.reduceat(v, cut)
    return [pa.array(size.astype(np.int64)), pa.array(out[0] % PRIME), pa.array(out[1] % PRIME), pa.array(out[2])]


def piece_digest(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens, ids_digest, weight, decodes.

    ids_digest is the sum of (id + 1) * position (from 1) modulo PRIME; decodes says that decoding the ids gives the text back.
    Null and empty texts: no tokens, digest 0, weight 0, decodes true. Repeated rows are encoded alike, each for itself.
    """
    short, long = _encoded(docs, model, with_ids=False)
    whole = short.select("doc_id", F.col("n").alias("n_tokens"), F.col("s2").alias("ids_digest"), "weight", F.col("intact").alias("decodes"))
    parts = F.array_sort(F.collect_list(F.struct("chunk", "n", "s1", "s2")))
    doc = long.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sum("weight").alias("weight"), F.bool_and("intact").alias("decodes"), parts.alias("parts"))
    total = F.expr(f"aggregate(parts, named_struct('at', 0L, 's', 0L), (a, x) -> named_struct('at', a.at + x.n, 's', (a.s + x.s2 + (a.at % {PRIME}L) * x.s1) % {PRIME}L), a -> a.s)")
    return whole.unionByName(doc.select("doc_id", "n_tokens", total.alias("ids_digest"), "weight", "decodes"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    import public_tokenizers

    return piece_digest(table(spark, sf_dir, "documents"), model or public_tokenizers.path("piece_bpe_32k.model"))
