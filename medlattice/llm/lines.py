"""Fuzzy line deduplication: SimHash, pigeonhole blocks and min-hash blocks, edit similarity, one occurrence for each connected group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyFilter, by_slices, groups, key_filter, mix, table, written
from .components import components
from .words import LOWER, hash_spans, spans, text_bytes

#: Of lines of fewer words only exact repeats go; SimHash leaves words of fewer bytes out, where enough longer ones are left.
LEAST_WORDS, LEAST_BYTES = 5, 4
#: SimHashes that differ in at most so many of 64 bits are candidates; lines are alike if edits are at most this share of the longer.
MOST_BITS, MOST_EDITS = 3, 0.2
#: Wanted rows of a pigeonhole block on average, from which the width of its key follows; blocks beyond BRUTE rows are cut up.
BLOCK_ROWS, BRUTE = 64, 512
#: Min-hash blocks: keys of a line, min-hashes in a key, and bytes of a gram for lines of less than GRAM_SHORT[1] characters and for those of
#: GRAM_SHORT[0] or more (those in between have both; the two lines of a pair differ in length by a fifth at most).
BANDS, BAND_ROWS, GRAMS, GRAM_SHORT = 12, 3, (4, 7), (40, 50)
#: Min-hashes of a line. One bit of each is its sketch: lines may be alike if AGREE of those bits are equal, which holds of half of
#: them and half of the share of common grams.
BINS, AGREE = 256, 180
_EMPTY = np.uint32(0xFFFFFFFF)
#: Lines of a block whose pairs are taken together with those of other blocks; pairs that are told apart at once, and of a larger block
#: at first; lines that are compared with all others of a larger block at once have so many pairs.
FEW, PAIRS, FIRST, SQUARE = 64, 1 << 14, 256, 1 << 20
#: Rows of numbers that are dealt at once, and that come together in one deal on average.
DEAL = 1 << 18
#: Characters up to which edit distances of many pairs are computed at once, characters of such pairs, and letters of their alphabets; edits
#: that are looked for first. Words of 64 bits that make a step of many pairs worth its calls, and that fit in caches; steps between two
#: looks at which pairs are still open.
LONG, AT_ONCE, ALPHABETS, NARROW = 4000, 1 << 21, 1 << 22, 32
WAVE, STEPS = (2048, 16384), 256
_BLANK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_TO_BLANK = bytes(c if not (c < 128 and not chr(c).isalnum()) else 32 for c in range(256))
_BLANKED = np.frombuffer(_TO_BLANK, np.uint8)


def line_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each line of all rows, the row it is in, and its number there. A row of n newlines has n + 1 lines."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    row = np.sort(np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, breaks, "right") - 1]), kind="stable")
    first = np.searchsorted(row, np.arange(len(at) - 1))
    number = np.arange(len(row)) - first[row]
    end = np.append(start[1:], len(data)) - 1
    last = np.append(row[1:] != row[:-1], True)
    end = np.where(last, at[1:][row], end)
    return start, end, row, number


def bit_counts(values: np.ndarray, cut: np.ndarray, most: int) -> np.ndarray:
    """[run, bit]: in how many of the 64-bit values of each run (they begin at cut, most is the longest) a bit is set."""
    if most >= 1 << 16:
        return np.add.reduceat(np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), cut, axis=0, dtype=np.int32)
    out = np.empty((len(cut), 4, 16), np.uint16)  # four counters of 16 bits are summed at once
    for i in range(16):
        out[:, :, i] = np.add.reduceat(values >> np.uint64(i) & np.uint64(0x0001000100010001), cut).view(np.uint16).reshape(-1, 4)
    return out.reshape(-1, 64).astype(np.int32)


def line_hashes(column: pa.Array, sims: bool = True, least: int = LEAST_WORDS):
    """Of each line with so many words at least: row, number, two hashes of its words in order, SimHash (without sims, zeros in place
    of the last two); and begin, end, bytes, and the number of words."""
    data, at = text_bytes(column)
    start, end, row, number = line_spans(data, at)
    low = LOWER[data]
    w_start, w_end, _ = spans(_BLANK[data], np.unique(np.concatenate([start, [len(data)]])))
    h = hash_spans(low, w_start, w_end)
    first = np.searchsorted(w_start, start)
    n = np.searchsorted(w_start, end) - first
    keep = np.flatnonzero(n >= least)
    if not len(keep):
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64), none, none, low, none
    first, n = first[keep], n[keep]
    owner = np.repeat(np.arange(len(keep)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    own = h[np.repeat(first, n) + place]
    cut = np.cumsum(n) - n
    spot = mix(place.astype(np.uint64) + np.uint64(1))
    h1 = np.add.reduceat(mix(own ^ spot), cut)
    if not sims:
        none = np.zeros(len(keep), np.uint64)
        return row[keep], number[keep], h1, none, none, start[keep], end[keep], low, n
    h2 = np.add.reduceat(mix(own + spot * np.uint64(0x9E3779B97F4A7C15)), cut)
    long = (w_end - w_start)[np.repeat(first, n) + place] >= LEAST_BYTES
    enough = np.add.reduceat(long.astype(np.int64), cut) >= LEAST_WORDS
    used = long | ~enough[owner]
    count = np.add.reduceat(used.astype(np.int64), cut)
    ones = bit_counts(own[used], np.cumsum(count) - count, int(count.max()))
    sim = np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)
    return row[keep], number[keep], h1, h2, sim, start[keep], end[keep], low, n


def block_masks(n: int) -> list[int]:
    """Bits of the keys of the pigeonhole blocks: two values within MOST_BITS bits agree in one key at least, for any choice of width.

    64 bits are cut into MOST_BITS + c fields; each choice of c fields is a key. c follows from the number n of values, so that
    a block of evenly spread values has BLOCK_ROWS rows or fewer; the pairs found are the same for each c.
    """
    c = 1
    while c < 4 and n / 2 ** (64 * c // (MOST_BITS + c)) > BLOCK_ROWS:
        c += 1
    edges = np.linspace(0, 64, MOST_BITS + c + 1).astype(int).tolist()
    fields = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(f) for f in combinations(fields, c)]


def block_keys(sims: np.ndarray, masks: list[int]) -> np.ndarray:
    """[mask, value]: the keys of SimHashes."""
    turn = np.arange(len(masks), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix((sims & np.array(masks, np.uint64)[:, None]) ^ turn[:, None]).view(np.int64)


def met_first(x: np.ndarray, y: np.ndarray, part: np.ndarray, masks: list[int]) -> np.ndarray:
    """Whether part is the first of the keys that x and y agree in, so that a pair counts in one of its blocks."""
    first = np.full(len(x), -1)
    for k in range(len(masks) - 1, -1, -1):
        first[(x ^ y) & np.uint64(masks[k]) == 0] = k
    return first == part


def close_pairs(sims: np.ndarray) -> np.ndarray:
    """Index pairs of distinct 64-bit values within MOST_BITS bits; large inputs are cut up by the pigeonhole principle again."""
    if len(sims) <= BRUTE:
        i, j = np.triu_indices(len(sims), 1)
        near = np.bitwise_count(sims[i] ^ sims[j]) <= MOST_BITS
        return np.stack([i[near], j[near]], axis=1)
    fixed = np.bitwise_and.reduce(sims) | ~np.bitwise_or.reduce(sims)
    free = [b for b in range(64) if not int(fixed) >> b & 1]
    out = [np.zeros((0, 2), np.int64)]
    if len(free) <= MOST_BITS:
        return np.concatenate([np.stack([np.full(len(sims) - i - 1, i), np.arange(i + 1, len(sims))], axis=1) for i in range(len(sims) - 1)])
    for k in range(MOST_BITS + 1):
        mask = np.uint64(sum(1 << b for b in free[k :: MOST_BITS + 1]))
        order = np.argsort(sims & mask, kind="stable")
        field = (sims & mask)[order]
        for run in np.split(order, np.flatnonzero(field[1:] != field[:-1]) + 1):
            if len(run) > 1:
                out.append(run[close_pairs(sims[run])].reshape(-1, 2))
    return np.unique(np.sort(np.concatenate(out), axis=1), axis=0)


def _sim_blocks(lines: DataFrame) -> DataFrame:
    """(key, h1, sim): the lines whose SimHash is within MOST_BITS bits of another one in the block, and those of one SimHash. A line has one row for each of its keys at most, however many it is near to."""
    lines = lines.where("keys is not null").select("h1", "sim")
    sims = written(lines.groupBy("sim").agg((F.min("h1") != F.max("h1")).alias("several")), "sims")
    n = sims.count()
    masks = block_masks(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, own, part), begin, count in _dealt_runs(batches, 3):
            sim = own.view(np.uint64)
            stays = np.zeros(len(sim), bool)

            def near(i: np.ndarray, j: np.ndarray) -> None:
                ok = np.bitwise_count(sim[i] ^ sim[j]) <= MOST_BITS
                i, j = i[ok], j[ok]
                ok = met_first(sim[i], sim[j], part[i], masks)
                stays[i[ok]] = stays[j[ok]] = True

            for i, j in _pairs_at_once(count):
                near(i, j)
            for at, n in zip(begin[count > FEW].tolist(), count[count > FEW].tolist(), strict=True):
                found = close_pairs(sim[at : at + n]) + at
                near(found[:, 0], found[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(x[stays]) for x in (key, own, part)], names=["key", "sim", "part"])

    def keyed(batch: pa.RecordBatch) -> np.ndarray:
        sim = _values(batch.column(0))
        return np.stack([block_keys(sim.view(np.uint64), masks), *np.broadcast_arrays(sim, np.arange(len(masks))[:, None])], axis=2).reshape(-1, 3)

    near = _dealt(sims.select("sim"), keyed, n * len(masks)).mapInArrow(run, "key long, sim long, part long")
    same = sims.where("several").select(F.xxhash64(F.lit(-1), "sim").alias("key"), "sim", F.lit(-1).cast("long").alias("part"))
    return near.unionByName(same).join(lines, "sim").select("key", "h1", "sim").distinct()


def grams_of(data: np.ndarray, size: int, where: np.ndarray) -> np.ndarray:
    """For each marked byte a hash of it and the size - 1 bytes behind it (size is 4 to 8)."""
    eight = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    g = eight[where]
    g &= np.uint64((1 << 8 * size) - 1)
    g *= np.uint64(0x9E3779B97F4A7C15)
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    return g


def band_keys(data: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys [line, band] and sketches [line, BINS / 64] of the lines that begin and end at these bytes, in order: two lines share a key with
    the share of common grams to the power of BAND_ROWS. The lowest bit of a key tells the gram sizes apart.

    One permutation gives all min-hashes: a gram falls in one of BINS bins, and the least of a bin stands for it; an empty bin takes
    what the next full one before it holds, the first ones what the last one holds.
    """
    n = np.maximum(end - begin - size + 1, 1)
    turns = np.diff(np.stack([begin, begin + n], axis=1).ravel(), prepend=0, append=len(data))
    gram = grams_of(data, size, np.repeat(np.arange(len(turns)) % 2 == 1, turns))
    slot = np.repeat(np.arange(len(n)) * BINS, n)
    slot += (gram >> np.uint64(56)).view(np.int64)
    gram >>= np.uint64(20)
    low = gram.astype(np.uint32)
    low &= ~np.uint32(1)
    least = np.full(len(n) * BINS, _EMPTY, np.uint32)
    np.minimum.at(least, slot, low)
    least = least.reshape(-1, BINS)
    full = np.maximum.accumulate(np.where(least != _EMPTY, np.arange(BINS, dtype=np.int16), np.int16(-1)), axis=1)
    least = np.take_along_axis(least, np.where(full < 0, full[:, -1:], full).astype(np.int64), axis=1)
    key = np.full((len(n), BANDS), size, np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(64)
    for i in range(BAND_ROWS):
        key = mix(key + least[:, (np.arange(BANDS) * (BINS // BAND_ROWS // BANDS) + i * BINS // BAND_ROWS) % BINS])
    sketch = np.packbits((least >> np.uint32(1) & np.uint32(1)).astype(bool), axis=1).view(np.uint64)
    return key & ~np.uint64(1) | np.uint64(size == GRAMS[1]), sketch


_LINE = "doc_id long, text_key long, line long, h1 long, h2 long, sim long, size int, keys binary, short_sketch binary, long_sketch binary"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line, h1, h2, sim, size, keys, short_sketch, long_sketch) of all lines with words, size in characters once
    normalised. sim is null for those that only exact repeats are sought of; the columns behind it are so too, and for lines that
    the task has seen before."""
    names = [c.split(" ")[0] for c in _LINE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            row, number, h1, h2, sim, start, end, low, n = line_hashes(part.column(2), least=1)
            fresh = np.zeros(len(h1), bool)
            fresh[np.unique(h1, return_index=True)[1]] = True
            fresh &= n >= LEAST_WORDS
            at = np.flatnonzero(fresh)
            at = at[[int(x) not in seen for x in h1[at]]] if len(at) else at
            seen.update(h1[at].tolist())
            size, keys, sketches = _signed(low, start[at], end[at])
            offsets, flat = keys.offsets.to_numpy() * 8, keys.values
            keys = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), flat.buffers()[1]])
            place = np.full(len(h1), -1)
            place[at] = np.arange(len(at))
            where = pa.array(place, mask=place < 0)
            i = pa.array(row)
            cols = [part.column(0).cast(pa.int64()).take(i), part.column(1).take(i), pa.array(number, pa.int64()), *(pa.array(x.view(np.int64)) for x in (h1, h2)), pa.array(sim.view(np.int64), mask=n < LEAST_WORDS)]
            return pa.RecordBatch.from_arrays(cols + [x.take(where) for x in (size, keys, *sketches)], names=names)

        yield from by_slices(one)(batches)

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").where("text is not null").mapInArrow(run, _LINE)


def _signed(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[pa.Array, pa.Array, list[pa.Array]]:
    """Size, keys and the sketches of both gram sizes of the lines low[start:end]."""
    blank = _BLANK[low]
    drop = np.flatnonzero(blank[1:] & blank[:-1]) + 1  # of the blanks behind a word, one stays
    if len(low) and blank[0]:
        drop = np.append(0, drop)
    keep = np.ones(len(low), bool)
    keep[drop] = False
    data = _BLANKED[low[keep]]
    inner = np.flatnonzero((data & 0xC0) == 0x80)  # bytes that begin no character
    begin, stop = start - np.searchsorted(drop, start), end - np.searchsorted(drop, end)
    if len(start):
        begin += data[np.minimum(begin, len(data) - 1)] == 32
        stop -= data[stop - 1] == 32
    length = stop - begin - np.searchsorted(inner, stop) + np.searchsorted(inner, begin)
    keys, owner, sketches = [np.zeros((0, BANDS), np.uint64)], [np.zeros(0, np.int64)], []
    for size, some in ((GRAMS[0], length < GRAM_SHORT[1]), (GRAMS[1], length >= GRAM_SHORT[0])):
        some = np.flatnonzero(some)
        place = np.full(len(length), -1)
        place[some] = np.arange(len(some))
        found = np.zeros((0, BINS // 64), np.uint64)
        if len(some):
            lo, hi = begin[some], stop[some]
            own, found = band_keys(data, lo, hi, size)
            keys.append(own)
            owner.append(some)
        raw = pa.Array.from_buffers(pa.binary(BINS // 8), len(found), [None, pa.py_buffer(found.tobytes())]).cast(pa.binary())
        sketches.append(raw.take(pa.array(place, mask=place < 0)))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    flat = np.concatenate(keys)[order].reshape(-1).view(np.int64)
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(length)) * BANDS)])
    return pa.array(length, pa.int32()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)), sketches


def _values(col: pa.Array) -> np.ndarray:
    """A column in numpy; sketches are rows of 64-bit words."""
    if not pa.types.is_binary(col.type):
        return col.to_numpy(zero_copy_only=False)
    at = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4)
    return np.frombuffer(col.buffers()[2], np.uint64, (at[-1] - at[0]) // 8, at[0]).reshape(len(col), -1)


def _several(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
    count = np.diff(np.append(begin, len(cols[0])))
    keep = np.repeat(count > 1, count)
    count = count[count > 1]
    return [c[keep] for c in cols], np.cumsum(count) - count, count


def _told(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns sorted by the first one, without what _runs leaves out; begin and length of each run."""
    cols, _, _ = _several(cols)
    order = np.lexsort((cols[1], cols[0]))
    cols = [c[order] for c in cols]
    new = np.ones(len(order), bool)
    new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
    return _several([c[new] for c in cols]) if len(order) else (cols, order, order)


def _dealt(rows: DataFrame, keyed: Callable[[pa.RecordBatch], np.ndarray], n: int) -> DataFrame:
    """(deal, numbers): the n rows of 64-bit numbers that keyed makes of batches, key first, many to a Spark row: rows of one key
    have one deal. _dealt_runs reads them."""
    deals = max(1, -(-n // DEAL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: np.ndarray) -> pa.RecordBatch:
            deal = (mix(found[:, 0].view(np.uint64)) % np.uint64(deals)).astype(np.min_scalar_type(deals))
            found = found[np.argsort(deal, kind="stable")]
            count = np.bincount(deal, minlength=deals)
            at = np.concatenate([[0], np.cumsum(count)]).astype(np.int32) * np.int32(8 * found.shape[1])
            full = np.flatnonzero(count)
            numbers = pa.Array.from_buffers(pa.binary(), deals, [None, pa.py_buffer(at), pa.py_buffer(found)])
            return pa.RecordBatch.from_arrays([pa.array(full), numbers.take(pa.array(full))], names=["deal", "numbers"])

        held: list[np.ndarray] = []
        for b in batches:
            if b.num_rows:
                held.append(keyed(b))
            if sum(map(len, held)) >= DEAL:
                yield out(np.concatenate(held))
                held = []
        if held:
            yield out(np.concatenate(held))

    return rows.mapInArrow(run, "deal long, numbers binary").repartition("deal").sortWithinPartitions("deal")


def _dealt_runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """_runs() of rows from _dealt, of so many numbers each."""
    for deal in groups(batches, ["deal"]):
        found = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, columns) for x in deal.column("numbers").to_pylist()])
        found = found[np.argsort(found[:, 0])]
        yield _told(list(found.T))


def _runs(batches: Iterator[pa.RecordBatch], order: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of batches sorted by key in pieces that never cut a run of equal keys, by (key, h1), and where the runs begin and
    how long they are; runs of one row and repeated (key, h1) rows are left out. Spark sorts one column of numbers by radix."""
    held: list[np.ndarray] | None = None

    for b in batches:
        if b.num_rows:
            cols = [_values(b.column(b.schema.get_field_index(c))) for c in order]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            held = [c[cut:] for c in cols]
            if cut:
                yield _told([c[:cut] for c in cols])
    if held is not None:
        yield _told(held)


def may_be_alike(size: np.ndarray, sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether lengths and sketches allow that the lines i and j are alike."""
    larger = np.maximum(size[i], size[j])
    ok = larger - np.minimum(size[i], size[j]) <= MOST_EDITS * larger
    at = np.flatnonzero(ok)
    ok[at] = np.bitwise_count(sketch[i[at]] ^ sketch[j[at]]).sum(axis=1, dtype=np.int64) <= BINS - AGREE
    return ok


def _pairs_at_once(count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bundles of the pairs (i, j), i before j, within runs of up to FEW rows."""
    small = count <= FEW
    run = np.repeat(np.where(small, np.arange(len(count)), -1), count)
    for step in range(1, int(count[small].max(initial=0))):
        i = np.flatnonzero((run[step:] == run[:-step]) & (run[step:] >= 0))
        yield i, i + step


def _blocks(lines: DataFrame) -> DataFrame:
    """(key, h1, size, sketch, lead, near): the lines that share a min-hash key with another that they may be like, the first of
    them, and whether it is one that they may be like. In a block of more than FEW lines all stay."""

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, h1), _, _ in _dealt_runs(batches, 2):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(h1)], names=["key", "h1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, h1, size, sketch), begin, count in _runs(batches, ["key", "h1", "size", "sketch"]):
            if not len(key):
                continue
            stays = np.repeat(count > FEW, count)
            for i, j in _pairs_at_once(count):
                ok = may_be_alike(size, sketch, i, j)
                stays[i[ok]] = stays[j[ok]] = True
            first = np.repeat(begin, count)
            near = (first != np.arange(len(h1))) & may_be_alike(size, sketch, first, np.arange(len(h1)))
            raw = pa.Array.from_buffers(pa.binary(BINS // 8), len(h1), [None, pa.py_buffer(sketch.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(stays)) for x in (pa.array(key), pa.array(h1), pa.array(size), raw, pa.array(h1[first]), pa.array(near))], names=["key", "h1", "size", "sketch", "lead", "near"])

    def keyed(batch: pa.RecordBatch) -> np.ndarray:
        n = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False) // 8
        at = batch.column(0)
        first = np.frombuffer(at.buffers()[1], np.int32, len(at) + 1, at.offset * 4)
        flat = np.frombuffer(at.buffers()[2], np.int64, int(n.sum()), int(first[0]))
        return np.stack([flat, np.repeat(_values(batch.column(1)), n)], axis=1)

    signed = lines.where("keys is not null")
    met = _dealt(signed.select("keys", "h1"), keyed, signed.count() * BANDS).mapInArrow(several, "key long, h1 long")
    rows = met.join(signed.select("h1", "size", "short_sketch", "long_sketch"), "h1").select("key", "h1", "size", F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, F.col("long_sketch")).otherwise(F.col("short_sketch")).alias("sketch"))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, h1 long, size int, sketch binary, lead long, near boolean")


def edits(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance: common ends are cut off, the rest is done with bit vectors (Myers), one step for each character. It stops
    with some number above most where the distance must be larger than that."""
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    j = 0
    while j < len(a) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        eq = where.get(c, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(x | plus) & full
        down = plus & x
        score += bool(up & top) - bool(down & top)
        if most is not None and score - left > most:  # each further step takes one away at most
            return score - left
        up = up << 1 | 1
        plus = (down << 1 | ~(x | up)) & full
        minus = up & x & full
    return score


def by_words(a: str, b: str, most: int) -> bool:
    """Whether replacing whole words between the common ends is enough: then the distance needs no other look."""
    p, q = a.split(" "), b.split(" ")
    n, i, j = min(len(p), len(q)), 0, 0
    while i < n and p[i] == q[i]:
        i += 1
    while j < n - i and p[-1 - j] == q[-1 - j]:
        j += 1
    p, q = p[i : len(p) - j], q[i : len(q) - j]
    if len(p) == len(q):
        return sum(max(len(x), len(y)) for x, y in zip(p, q, strict=True) if x != y) <= most
    return max(sum(map(len, p)) + len(p), sum(map(len, q)) + len(q)) <= most


def alike(a: str, b: str) -> bool:
    most = int(MOST_EDITS * max(len(a), len(b)))
    return abs(len(a) - len(b)) <= most and (by_words(a, b, most) or edits(a, b, most) <= most)


class Codes:
    """Texts as small numbers for their characters, from 2 on, and which of them are alike."""

    def __init__(self, texts: np.ndarray):
        self.texts, self.often = texts, True  # whether most pairs were alike lately: then few edits are looked for first
        self.size = np.array([len(t) for t in texts], np.int64)
        self.at = np.cumsum(self.size) - self.size
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        seen = np.zeros(int(flat.max(initial=0)) + 1, bool)
        seen[flat] = True
        rank = np.cumsum(seen) + 1
        self.letters = int(rank[-1])
        self.flat = rank[flat].astype(np.min_scalar_type(self.letters))

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """alike() of the texts i and j."""
        swap = self.size[i] > self.size[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        longer = self.size[j]
        most = (MOST_EDITS * longer).astype(np.int64)
        out = longer - self.size[i] <= most
        for k in np.flatnonzero(out & (longer > LONG)).tolist():
            out[k] = alike(self.texts[i[k]], self.texts[j[k]])
        left = np.flatnonzero(out & (longer <= LONG))
        left = left[np.argsort(-longer[left], kind="stable")]
        while len(left):
            some, left = np.split(left, [self._at_once(int(longer[left[0]]))])
            out[some] = self._few_edits(i[some], j[some], most[some])
        return out

    def _taken(self, first: np.ndarray, size: np.ndarray, width: int, step: int, blank: int) -> np.ndarray:
        """[row, k]: the character at first + k * step, blank from size on."""
        k = np.arange(width, dtype=np.int32)
        where = first.astype(np.int32)[:, None] + k * np.int32(step)
        np.clip(where, 0, len(self.flat) - 1, out=where)
        got = self.flat[where]
        got[k >= size[:, None]] = blank
        return got

    def _few_edits(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        a, b, m, n = self.at[i], self.at[j], self.size[i], self.size[j]
        width = int(n.max()) + 1
        same = self._taken(a, m, width, 1, 0) == self._taken(b, n, width, 1, 1)
        out = (m == n) & (n - same.sum(axis=1) <= most)
        head = same.argmin(axis=1)
        tail = np.minimum((self._taken(a + m - 1, m, width, -1, 0) == self._taken(b + n - 1, n, width, -1, 1)).argmin(axis=1), m - head)
        m, n = m - head - tail, n - head - tail
        out |= n <= most
        left = np.flatnonzero(~out)
        left = asked = left[np.argsort(-n[left], kind="stable")]
        for narrow in (True, False):
            if len(left) and (not narrow or (self.often and m[left].max() > 128)):
                for some in self._of_a_length(left, n[left], NARROW if narrow else None, most[left]):
                    band = NARROW if narrow else int(most[some].max())
                    out[some] = self._distances(a[some] + head[some], b[some] + head[some], m[some], n[some], band, most[some]) <= most[some]
                left = left[~out[left]]
        self.often = 2 * out[asked].sum() >= len(asked)
        return out

    def _of_a_length(self, rows: np.ndarray, n: np.ndarray, band: int | None, most: np.ndarray) -> Iterator[np.ndarray]:
        """The rows, the largest n first, in runs of about one length and of WAVE words of 64 bits in the band, if there are so many."""
        at = 0
        while at < len(rows):
            words = min(int(n[at]), 2 * (band or int(most[at])) + 64) // 64 + 1
            alike = int(np.searchsorted(-n, -0.8 * n[at], "right"))
            end = min(max(alike, at + WAVE[0] // words), at + max(1, WAVE[1] // words))
            yield rows[at:end]
            at = end

    def _at_once(self, longer: int) -> int:
        """Pairs of up to so many characters that are taken together: their characters and their alphabets fit in memory."""
        return max(1, min(AT_ONCE // max(1, longer), ALPHABETS // (self.letters + 1)))

    def _matches(self, pattern: np.ndarray, text: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """[word, slot]: where in 64 characters of a pattern the character of a slot stands; and the slots of the texts' characters,
        [place, pair]. Each pair has slots for the characters of its own pattern, and one for all others."""
        pairs = np.arange(len(pattern))[:, None]
        there = np.zeros((len(pattern), self.letters + 1), bool)
        there[pairs, pattern] = True
        there[:, 0] = False  # blank
        local = np.cumsum(there, axis=1, dtype=np.int16)
        slots = int(local[:, -1].max(initial=0)) + 1
        local[~there] = 0
        place = np.arange(pattern.shape[1])
        own = local[pairs, pattern]
        found = np.zeros((words, len(pattern) * slots), np.uint64)
        solid = own > 0
        where = (place >> 6) * found.shape[1] + (pairs * slots + own)
        np.add.at(found.reshape(-1), where[solid], np.broadcast_to(np.uint64(1) << (place & 63).astype(np.uint64), own.shape)[solid])
        return found, np.ascontiguousarray((pairs * slots + local[pairs, text]).T)

    def _distances(self, a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, band: int, most: np.ndarray) -> np.ndarray:
        """Levenshtein distances of m characters at a and n at b (no less), the largest n first: the bit vectors of edits() in words of
        64 bits, for all pairs at once. Words further than band from the diagonal are left out: distances up to it are exact, larger
        ones may come out larger, never smaller. Pairs that must come out above most are dropped on the way, with most + 1.

        Shorter pairs get an equal end, which changes no distance, so that all texts are of one length. A word is one place of the text
        behind the word before it, whose carries it needs: so all words of the band take their steps at once."""
        length = int(n[0])
        rest, m, n = m, m + length - n, np.full(len(n), length)
        words = max(1, -(-int(m.max()) // 64))
        pattern, place = self._taken(a, rest, words * 64, 1, 0), np.arange(words * 64)
        pattern[(place >= rest[:, None]) & (place < m[:, None])] = 1
        match, text = self._matches(pattern, self._taken(b, length - (m - rest), length, 1, 1), words)
        out, live = most + 1, np.arange(len(m))
        plus = np.full((words, len(m)), ~np.uint64(0))
        minus = np.zeros_like(plus)
        one, top = np.uint64(1), np.uint64(63)
        word = np.arange(words)
        begin, stop = 64 * word - band, 64 * (word + 1) + band  # places of the text that a word is near to
        for first in range(0, length, STEPS):
            last = min(length, first + STEPS)
            starts, ends = np.maximum(first, begin) + word, np.minimum(last, stop) + word
            used = np.flatnonzero(starts < ends)
            if not len(used):
                continue
            base, starts, ends = int(used[0]), starts[used], ends[used]
            up_in, down_in = np.ones((len(used) + 1, len(live)), np.uint64), np.zeros((len(used) + 1, len(live)), np.uint64)
            times = np.arange(starts[0], ends[-1])
            lows, highs = np.searchsorted(ends, times, "right").tolist(), np.searchsorted(starts, times, "right").tolist()
            row = (used * match.shape[1])[:, None]
            for t, low, high in zip(times.tolist(), lows, highs, strict=True):
                p, q = plus[base + low : base + high], minus[base + low : base + high]
                place = t - base - low  # of the first word, the others are behind it
                slot = text[place - (high - low) + 1 : place + 1][::-1] + row[low:high]
                eq = match.take(slot)
                x = eq | q
                eq |= down_in[low:high]
                h = eq & p
                h += p
                h ^= p
                h |= eq
                up = h | p
                np.invert(up, out=up)
                up |= q
                h &= p
                up_out, down_out = up >> top, h >> top
                up <<= one
                up |= up_in[low:high]
                h <<= one
                h |= down_in[low:high]
                np.bitwise_and(up, x, out=q)
                x |= up
                np.invert(x, out=x)
                np.bitwise_or(x, h, out=p)
                up_in[low + 1 : high + 1], down_in[low + 1 : high + 1] = up_out, down_out
                up_in[low], down_in[low] = 1, 0
            if last < length and words > 1:
                low, high = max(0, (last - 1 - band) // 64), min(words - 1, (last - 1 + band) // 64)
                if low > high:
                    continue
                stays = self._least_to_come(plus, minus, m[live], n[live], last, low, high) <= most[live]
                if 4 * stays.sum() < 3 * len(stays):
                    live, plus, minus, text = live[stays], plus[:, stays], minus[:, stays], text[:, stays]
                    if not len(live):
                        return out
        own = np.clip(m[live] - 64 * np.arange(words)[:, None], 0, 64).astype(np.uint64)
        mask = np.where(own == 64, ~np.uint64(0), (one << np.minimum(own, top)) - one)
        out[live] = n[live] + np.bitwise_count(plus & mask).sum(axis=0, dtype=np.int64) - np.bitwise_count(minus & mask).sum(axis=0, dtype=np.int64)
        return out

    def _least_to_come(self, plus: np.ndarray, minus: np.ndarray, m: np.ndarray, n: np.ndarray, at: int, low: int, high: int) -> np.ndarray:
        """What each pair's distance is at least, as its text is read up to at: neighbours in a column differ by one, so that its values at
        the borders of words bound those between them; and as many edits must follow as the rests differ in length."""
        edge = np.zeros((len(plus) + 1, len(m)), np.int64)
        np.cumsum(np.bitwise_count(plus).astype(np.int64) - np.bitwise_count(minus), axis=0, out=edge[1:])
        edge = edge[low : high + 2] + at
        gap = (m - n + at) - 64 * np.arange(low, high + 2)[:, None]
        between = np.where((gap[1:] > 0) == (gap[:-1] > 0), np.minimum(abs(gap[1:]), abs(gap[:-1])), 0)
        return ((edge[1:] + edge[:-1] - 64) // 2 + between).min(axis=0)


class _Keys:
    """The keys of some rows, to count each pair in one block only. Keys that differ in the bits of kinds are not of one kind."""

    def __init__(self, key: np.ndarray, h1: np.ndarray, keys: np.ndarray, kinds: int):
        self.key, self.h1 = key, h1
        size = np.array([len(x) for x in keys], np.int64)
        self.of = np.zeros((len(size), int(size.max(initial=0))), np.int64)
        self.full = np.arange(self.of.shape[1]) < size[:, None]
        self.of[self.full] = np.concatenate(keys)
        self.full &= (self.of ^ key[:, None]) & kinds == 0

    def chosen(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the rows i and j count in the block that they are in: of the keys that both have, each is chosen for some pairs, so that
        the pairs of rows with the same keys are spread over their blocks."""
        out = np.ones(len(i), bool)
        for b in range(0, len(i), PAIRS):
            p, q = i[b : b + PAIRS], j[b : b + PAIRS]
            turn = mix((self.h1[p] ^ self.h1[q]).view(np.uint64)).view(np.int64)
            for k in range(self.of.shape[1]):
                before = np.flatnonzero(self.full[p, k] & (self.of[p, k] ^ turn < self.key[p] ^ turn))
                both = ((self.of[q[before]] == self.of[p[before], k][:, None]) & self.full[q[before]]).any(axis=1)
                out[b + before[both]] = False
        return out


class _Joined:
    """Components of some rows' lines as links come in; lines of one root are joined."""

    def __init__(self, h1: np.ndarray, root: np.ndarray):
        found, self.place = np.unique(root, return_inverse=True)
        self.of, self.up = h1, np.arange(len(found))

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.up[self.place[i]] != self.up[self.place[j]]

    def link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Joins the lines of these rows; [link, end]: those links that joined two components."""
        up, out = self.up, []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            p, q = self.place[a], self.place[b]
            while up[p] != p:
                p = up[p]
            while up[q] != q:
                q = up[q]
            if p != q:
                up[max(p, q)] = min(p, q)
                out.append((a, b))
        while (up != up[up]).any():
            up[:] = up[up]
        return self.of[np.array(out, np.int64).reshape(-1, 2)]


def _block_links(rows: DataFrame, columns: list[str], may: Callable[..., np.ndarray], roots: DataFrame, texts: DataFrame, kinds: int = 0) -> DataFrame:
    """(a, b): links that join the lines of each block as all its links do, but for those that roots (h1, root) joins already. rows has key,
    h1 and the columns; may(columns, i, j) tells which pairs of rows are candidates. A pair of candidates is told apart if the links found
    so far don't join it, in one of the blocks that it is in (may says the same in all of them whose keys agree in the bits of kinds): each block's pairs stay in its task, and no more links leave than it has lines."""
    rows = rows.join(roots, "h1", "left").withColumn("root", F.coalesce("root", "h1"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one != other").select("key")
    rows = written(rows.join(mixed, "key"), "mixed-blocks")
    keys = rows.groupBy("h1").agg(F.collect_set("key").alias("keys"))
    rows = rows.join(keys, "h1").join(texts, "h1").select("key", "h1", "root", *columns, "line_text", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, h1, root, *own, texts, keys), begin, count in _runs(batches, ["key", "h1", "root", *columns, "line_text", "keys"]):
            if not len(h1):
                continue
            joined, codes, keys, found = _Joined(h1, root), Codes(texts), _Keys(key, h1, keys, kinds), [np.zeros((0, 2), np.int64)]

            def candidates(i: np.ndarray, j: np.ndarray, joined=joined, own=own, keys=keys) -> tuple[np.ndarray, np.ndarray]:
                for holds in (joined.apart, lambda i, j: may(own, i, j), keys.chosen):
                    ok = holds(i, j)
                    i, j = i[ok], j[ok]
                return i, j

            def tell(i: np.ndarray, j: np.ndarray, joined=joined, codes=codes, found=found) -> None:
                ok = joined.apart(i, j)
                i, j = i[ok], j[ok]
                ok = codes.alike(i, j)
                found.append(joined.link(i[ok], j[ok]))

            held: list[np.ndarray] = []
            for k, (i, j) in enumerate(_pairs_at_once(count)):
                held.append(np.stack(candidates(i, j)))
                if not k or sum(x.shape[1] for x in held) > PAIRS:
                    tell(*np.concatenate(held, axis=1))
                    held.clear()
            if held:
                tell(*np.concatenate(held, axis=1))
            for at, n in zip(begin[count > FEW].tolist(), count[count > FEW].tolist(), strict=True):
                rows_at_once, size, waits = max(1, SQUARE // n), FIRST, np.zeros((2, 0), np.int64)
                for b in range(0, n, rows_at_once):
                    i, j = (x.ravel() for x in np.meshgrid(np.arange(b, min(n, b + rows_at_once)), np.arange(b, n), indexing="ij"))
                    waits = np.concatenate([waits, candidates(i[i < j] + at, j[i < j] + at)], axis=1)
                    while waits.shape[1] >= size or (waits.shape[1] and b + rows_at_once >= n):
                        tell(*waits[:, :size])
                        waits, size = waits[:, size:], min(2 * size, PAIRS)
            links = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, wanted: bytes) -> DataFrame:
    """(h1, line_text) of the lines whose hash the filter lets pass, normalised."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = KeyFilter(shared.value)
        seen: set[int] = set()

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            _, _, h1, _, _, start, end, low, _ = line_hashes(part.column(1), sims=False)
            found: dict[int, str] = {}
            h1 = h1.view(np.int64)
            for i in np.flatnonzero(passes(h1)).tolist() if len(h1) else []:
                if (key := int(h1[i])) not in seen:
                    seen.add(key)
                    found[key] = b" ".join(low[start[i] : end[i]].tobytes().translate(_TO_BLANK).split()).decode()
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.string())], names=["h1", "line_text"])

        return by_slices(one)(batches)

    return docs.select("doc_id", "text").where("text is not null").mapInArrow(run, "h1 long, line_text string").groupBy("h1").agg(F.min("line_text").alias("line_text"))


def _lead_links(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """(h1, lead): the lines that are alike to the least of their blocks' first lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if n := b.num_rows:
                ok = Codes(np.concatenate([_values(b.column(2)), _values(b.column(3))])).alike(np.arange(n), np.arange(n, 2 * n))
                yield b.select(["h1", "lead"]).filter(pa.array(ok))

    pairs = blocks.where("near").groupBy("h1").agg(F.min("lead").alias("lead")).join(texts, "h1")
    both = pairs.join(texts.select(F.col("h1").alias("lead"), F.col("line_text").alias("lead_text")), "lead").select("h1", "lead", "line_text", "lead_text")
    return both.mapInArrow(run, "h1 long, lead long")


def line_removals(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, removed): for each text with lines to remove, their numbers from 0 on.

    A line is compared as its words (runs of letters and digits, A-Z lower-cased). Lines of the same words are one distinct line.
    Distinct lines are compared where their SimHashes differ in at most MOST_BITS bits, or where they share one of BANDS min-hash keys and
    their sketches don't tell that they can't be alike, unless links join them already (whatever the block's size). Links are the pairs
    whose edit similarity holds (README: how many of all such pairs are compared). Of each connected
    group the first occurrence stays (least doc_id, then line, then text_key). Lines of fewer than LEAST_WORDS words are compared
    with their exact copies only; lines without words, null and empty texts are left alone. Rows that repeat doc_id and text are one
    document, and keep or lose the same lines; rows that repeat a doc_id with another text are documents of their own; null doc_ids
    come first. Further columns don't matter, whatever their names.
    """
    lines = written(_lines(docs), "lines")
    place = F.struct("doc_id", "line", "text_key")
    sims, blocks = written(_sim_blocks(lines), "sim-blocks"), written(_blocks(lines), "line-blocks")
    texts = written(_texts(docs, key_filter(sims.select("h1").unionByName(blocks.select("h1")), "h1")), "line-texts")

    def near(own: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(own[0][i] ^ own[0][j]) <= MOST_BITS

    # One link for each line joins most groups; blocks that it leaves in several parts compare all pairs of different ones.
    leads = written(_lead_links(blocks, texts), "lead-links")
    further = leads.select(F.col("h1").alias("lead"), F.col("lead").alias("before"))
    roots = leads.join(further, "lead", "left").select("h1", F.coalesce("before", "lead").alias("root"))
    links = leads.select(F.col("h1").alias("a"), F.col("lead").alias("b"))
    links = links.unionByName(_block_links(sims, ["sim"], near, roots, texts))
    links = links.unionByName(_block_links(blocks, ["size", "sketch"], lambda own, i, j: may_be_alike(*own, i, j), roots, texts, kinds=1))
    # Most lines neither repeat nor have links: the others are picked before anything is sorted.
    again = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", F.lit(None).cast("long").alias("component"))
    asked = again.unionByName(components(links).withColumnRenamed("node", "h1")).groupBy("h1").agg(F.max("component").alias("component"))
    rows = written(lines.select("doc_id", "text_key", "line", "h1", "h2").join(asked, "h1"), "asked-lines")
    distinct = written(rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max("component").alias("component")), "distinct-lines")
    named = distinct.where("component is not null")
    stays = named.groupBy("component").agg(F.min("first").alias("stays"))
    linked = named.join(stays, "component").select("h1", "h2", "stays")
    single = distinct.where("component is null").select("h1", "h2", F.col("first").alias("stays"))
    out = rows.join(linked.unionByName(single), ["h1", "h2"]).where(~place.eqNullSafe(F.col("stays")))
    return out.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def _joined(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """rows (row, doc_id, text_key) with the numbers of the lines to remove, null where there are none."""
    right = removed.select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"), "removed")
    return rows.join(right, rows["doc_id"].eqNullSafe(right["of"]) & (rows["text_key"] == right["of_key"]), "left").drop("of", "of_key")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The rows of docs, their columns in order, without the lines that line_removals names; n_chars follows the text. A row that
    loses all its words goes."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    rows = _joined(rows, line_removals(docs))
    every = F.split("row.text", "\n", -1)
    kept = F.array_join(F.filter(every, lambda x, i: ~F.array_contains("removed", i.cast("long"))), "\n")
    rows = rows.select("row", F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(kept).alias("kept"), "removed").where(F.col("removed").isNull() | F.col("kept").rlike(r"\S"))
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("removed").isNull(), F.col("row.n_chars")).otherwise(F.length("kept")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def line_digest(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_kept, removed (numbers of the removed lines, empty if none)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pc.if_else(pc.greater(pc.binary_length(b.column(2)), 0), pc.add(pc.count_substring(b.column(2), "\n"), 1), 0)
            yield pa.RecordBatch.from_arrays([n.cast(pa.int64()).fill_null(0), b.column(0), b.column(1)], names=["n_lines", "doc_id", "text_key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(counted, "n_lines long, doc_id long, text_key long")
    gone = F.coalesce("removed", F.array().cast("array<long>"))
    return _joined(rows, line_removals(docs)).select("doc_id", "n_lines", (F.col("n_lines") - F.size(gone)).cast("long").alias("n_kept"), gone.alias("removed"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"))
