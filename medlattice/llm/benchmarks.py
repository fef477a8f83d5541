"""Benchmark decontamination by template windows: placeholders for numbers, names and units, hash join, slot consistency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyFilter, by_slices, groups, key_filter, table, written
from .words import LOWER, hash_spans, spans, text_bytes, windows

#: Words of a template window; items of fewer words are one window, below LEAST_ITEM words they are left out.
WINDOW_WORDS, LEAST_ITEM = 8, 5
#: A document holds an item if consistent windows cover so many consecutive words of it, or so large a share of its words.
LEAST_RUN, LEAST_SHARE = 13, 0.5
#: Benchmark windows up to this number are broadcast; more are joined by a salted shuffle.
BROADCAST_WINDOWS = 200_000
SALTS = 32
#: Words that count as units.
UNITS = (
    "mm cm dm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes oz ounce ounces lb lbs pound pounds "
    "ml cl dl l litre litres liter liters gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "hz khz mhz ghz w kw mw v kv j kj cal kcal n pa kpa bar c f k celsius fahrenheit kelvin mol mmol percent cent cents dollar dollars euro euros usd eur gbp mph kph"
).split()
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_BLANK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?:;\n\r", np.uint8))
_POINT = np.isin(np.arange(256), np.frombuffer(b".,", np.uint8))
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x6E756D, 0x6E616D65, 0x756E6974))


def _unit_hashes() -> np.ndarray:
    data, at = text_bytes(pa.array(UNITS))
    return np.sort(hash_spans(data, at[:-1], at[1:]))


_UNIT_HASHES = _unit_hashes()


def template(column: pa.Array, openings: bool = False):
    """Token hashes with placeholders, plain token hashes, which tokens are placeholders, begin and end byte, tokens before each row,
    the bytes.

    A token is a run of letters and digits (a point or comma between digits belongs to it). One with a digit is a number; one of
    UNITS a unit; a capital followed by a small letter makes a name: within a sentence, with openings also where one opens. Names
    that follow each other are one. All else is itself in lower case.
    """
    data, at = text_bytes(column)
    blank = _BLANK[data]
    if len(data) > 2:
        digit = _DIGIT[data]
        inner = _POINT[data[1:-1]] & digit[:-2] & digit[2:]
        blank[1:-1] &= ~inner
    start, end, first = spans(blank, at)
    low = LOWER[data]
    h = hash_spans(low, start, end)
    if len(start):
        count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        digits = count(_DIGIT[data])
        number = digits[end] > digits[start]
        stops = count(_STOP[data])
        opens = np.ones(len(start), bool)
        opens[1:] = stops[start[1:]] > stops[end[:-1]]
        opens[first[:-1][np.diff(first) > 0]] = True
        second = data[np.minimum(start + 1, len(data) - 1)]
        name = (data[start] >= 65) & (data[start] <= 90) & (end - start > 1) & (second >= 97) & (~opens | openings) & ~number
        unit = ~number & ~name & np.isin(h, _UNIT_HASHES)
        plain = h
        h = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, h)))
        slot = number | name | unit
        keep = np.ones(len(h), bool)
        keep[1:] = ~(name[1:] & name[:-1] & ~opens[1:])
        last = np.append(np.flatnonzero(keep)[1:], len(h)) - 1
        first = np.concatenate([[0], np.cumsum(keep)])[first]
        h, plain, slot, start, end = h[keep], plain[keep], slot[keep], start[keep], end[last]
    else:
        plain, slot = h, np.zeros(0, bool)
    return h, plain, slot, start, end, first, low


def _hashes(h: np.ndarray, plain: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n tokens; one of placeholders only is hashed by what stands in them."""
    wide = windows(h, n)
    slots = np.concatenate([[0], np.cumsum(slot)])
    bare = np.flatnonzero(slots[n:] - slots[:-n] == n) if len(wide) else np.zeros(0, int)
    if len(bare):
        wide[bare] = windows(plain, n)[bare]
    return wide.view(np.int64)


def _rows(column: pa.Array, reading: int, wanted=None):
    """For each row: a list of (position, window hash, slot positions within the window, slot values), wanted hashes only. Reading 1
    takes capitals that open a sentence for names, reading 0 doesn't."""
    h, plain, slot, start, end, first, low = template(column, bool(reading))
    wide = _hashes(h, plain, slot, WINDOW_WORDS)
    seen = wanted(wide) if wanted is not None and len(wide) else np.ones(len(wide), bool)
    out = []
    for b, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = WINDOW_WORDS
        if e - b >= n:
            at = b + np.flatnonzero(seen[b : e - n + 1])
            hashes = wide[at].tolist()
        else:
            at, hashes, n = np.zeros(0, int), [], e - b
            if e - b >= LEAST_ITEM and wanted is None:
                at, hashes = np.array([b]), _hashes(h[b:e], plain[b:e], slot[b:e], n).tolist()
        made = []
        for i, x in zip(at.tolist(), hashes, strict=True):
            places = np.flatnonzero(slot[i : i + n]).tolist()
            made.append({"reading": reading, "at": i - b, "h": x, "places": places, "values": [low[start[i + p] : end[i + p]].tobytes().decode() for p in places]})
        out.append((e - b, made))
    return out


def _short_rows(column: pa.Array, reading: int, sizes: list[int], wanted) -> list[list[dict]]:
    """Windows of other lengths, for items shorter than a window."""
    h, plain, slot, start, end, first, low = template(column, bool(reading))
    found: list[list[dict]] = [[] for _ in range(len(first) - 1)]
    for n in sizes:
        wide = _hashes(h, plain, slot, n)
        for i in np.flatnonzero(wanted(wide)).tolist() if len(wide) else []:
            row = int(np.searchsorted(first, i, "right")) - 1
            if i + n <= first[row + 1]:
                places = np.flatnonzero(slot[i : i + n]).tolist()
                found[row].append({"reading": reading, "at": i - int(first[row]), "h": int(wide[i]), "places": places, "values": [low[start[i + p] : end[i + p]].tobytes().decode() for p in places]})
    return found


_HIT = pa.list_(pa.struct([("reading", pa.int32()), ("at", pa.int32()), ("h", pa.int64()), ("places", pa.list_(pa.int32())), ("values", pa.list_(pa.string()))]))
_HIT_SQL = "array<struct<reading:int,at:int,h:long,places:array<int>,values:array<string>>>"


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_key, reading, n_words, b_at, h, b_places, b_values) of all template windows of all items; item_key is a hash of
    the text, so that texts of one item_id are told apart."""

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for reading in (0, 1):
            rows = _rows(part.column(2), reading)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([n for n, _ in rows], pa.int32()), pa.array([w for _, w in rows], _HIT)], names=["item_id", "item_key", "n_words", "hits"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_key"), "text").where("item_id is not null and text is not null")
    rows = items.mapInArrow(by_slices(run), f"item_id long, item_key long, n_words int, hits {_HIT_SQL}").select("item_id", "item_key", "n_words", F.inline("hits"))
    return rows.select("item_id", "item_key", "reading", "n_words", F.col("at").alias("b_at"), "h", F.col("places").alias("b_places"), F.col("values").alias("b_values")).distinct()


def _consistent(rows: list[dict], n_words: int) -> dict | None:
    """The best consistent run of one item in one document: windows of one alignment whose slots map one to one."""
    best = None
    by_shift: dict[int, list[dict]] = {}
    for r in rows:
        by_shift.setdefault(r["at"] - r["b_at"], []).append(r)
    for shift in sorted(by_shift):
        to: dict = {}
        back: dict = {}
        words: set[int] = set()
        used = 0
        for r in sorted(by_shift[shift], key=lambda r: r["b_at"]):
            pairs = list(zip(r["b_values"], r["values"], strict=False))
            if r["places"] != r["b_places"] or any(to.get(x, y) != y or back.get(y, x) != x for x, y in pairs) or len({x for x, _ in pairs}) != len({y for _, y in pairs}):
                continue
            to.update(pairs)
            back.update((y, x) for x, y in pairs)
            words.update(range(r["b_at"], r["b_at"] + min(WINDOW_WORDS, n_words)))
            used += 1
        run = longest = 0
        for i in range(n_words):
            run = run + 1 if i in words else 0
            longest = max(longest, run)
        if longest >= LEAST_RUN or len(words) >= LEAST_SHARE * n_words:
            got = {"windows": used, "covered": len(words), "begin": min(words) + shift, "changed": sorted(f"{x} -> {y}" for x, y in to.items() if x != y)}
            if best is None or (got["covered"], -got["begin"]) > (best["covered"], -best["begin"]):
                best = got
    return best


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, n_windows, n_covered, n_words, first_word, reparameterised,
    changed (`old -> new` slot values), text_key.

    Template windows of the item and of the document are joined by hash; windows of one alignment count if every slot value of the
    item stands for one value in the document and the other way round. Null or empty texts hold nothing; items of fewer than
    LEAST_ITEM words and null item ids are left out; rows that repeat a doc_id are told apart by text_key (a hash of the text), and
    texts of one item_id are items of their own; an item that is there several times in a document gives one row. Item and document
    are read twice, with and without names that open a sentence. Empty tables give no rows; further columns don't matter.
    """
    spark = docs.sparkSession
    theirs = written(benchmark_windows(benchmark), "benchmark-windows")
    sizes = [r["n_words"] for r in theirs.where(F.col("n_words") < WINDOW_WORDS).select("n_words").distinct().collect()]  # LEAST_ITEM .. WINDOW_WORDS - 1
    shared = spark.sparkContext.broadcast(key_filter(theirs, "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = KeyFilter(shared.value)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            hits: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for reading in (0, 1):
                for own, (_, more) in zip(hits, _rows(part.column(2), reading, wanted), strict=True):
                    own += more
                for own, more in zip(hits, _short_rows(part.column(2), reading, sizes, wanted), strict=True):
                    own += more
            some = pa.array([bool(x) for x in hits])
            return pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()).filter(some), part.column(1).filter(some), pa.array([x for x in hits if x], _HIT)], names=["doc_id", "text_key", "hits"])

        return by_slices(one)(batches)

    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, f"doc_id long, text_key long, hits {_HIT_SQL}")
    ours = rows.select("doc_id", "text_key", F.inline("hits"))
    if theirs.count() <= BROADCAST_WINDOWS:
        pairs = ours.join(F.broadcast(theirs), ["h", "reading"])
    else:  # a passage that very many documents hold is spread over SALTS tasks
        salted = ours.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int"))
        pairs = salted.join(theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h", "reading", "salt"])
    pairs = pairs.select(F.coalesce("doc_id", F.lit(-(1 << 62))).alias("key"), "doc_id", "text_key", "item_id", "item_key", "reading", "n_words", "at", "b_at", "places", "b_places", "values", "b_values")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "n_windows", "n_covered", "n_words", "first_word", "reparameterised", "changed", "text_key", "item_key"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.int64(), pa.int64()]
        for g in groups(batches, keys):
            rows = list({(r["at"], r["b_at"]): r for r in g.to_pylist()}.values())
            n = rows[0]["n_words"]
            if got := _consistent(rows, n):
                values = [rows[0]["doc_id"], rows[0]["item_id"], got["windows"], got["covered"], n, got["begin"], bool(got["changed"]), got["changed"], rows[0]["text_key"], rows[0]["item_key"]]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    schema = "doc_id long, item_id long, n_windows int, n_covered int, n_words int, first_word int, reparameterised boolean, changed array<string>, text_key long"
    keys = ["key", "text_key", "item_id", "item_key", "reading"]
    found = pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(judge, schema + ", item_key long")
    names = [c.split(" ")[0] for c in schema.split(", ")]
    # Of the two readings the one that covers a larger share.
    best = found.groupBy("doc_id", "text_key", "item_id", "item_key").agg(F.max_by(F.struct(*names), F.struct(F.col("n_covered") / F.col("n_words"), ~F.col("reparameterised"), "n_covered")).alias("best"))
    return best.select("best.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item of the benchmark."""
    found = leaks(docs, benchmark).select("doc_id", "text_key").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    return rows.join(found, rows["id"].eqNullSafe(found["doc_id"]) & (rows["key"] == found["text_key"]), "left_anti").select(*(F.col(f"row.`{c}`") for c in docs.columns))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
