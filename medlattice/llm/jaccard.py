"""Exact Jaccard join of documents on word shingles by T-occurrence search (DivideSkip).

Sets are hashed shingles; documents of equal sets are one node. Two sets that link differ in at most (|x| + |y|) / 9 shingles (for a
similarity of 0.8). If shingles are dealt into more parts than that by their hash, the sets hold the very same shingles in all but
so many parts, and so agree in one at least of that many and one more parts, in any order that all sets share. The order here puts
parts with a rare shingle first, by a count over the whole corpus (a sketch of fixed size), so that what remains isn't shared by
texts that merely have passages in common. Sets that agree in such a part form blocks. Within a block, T-occurrence search finds each query's partners: the T-1 longest inverted lists are set aside,
the short ones are merged, and what they suggest is probed in the long ones by binary search.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyFilter, by_slices, groups, key_filter, mix, table, written
from .components import components
from .words import windows, words

SHINGLE_WORDS = 5
#: Similarity as a fraction: links need LEAST[1] * intersection >= LEAST[0] * union.
LEAST = (80, 100)
#: Parts for each shingle in which linked sets may differ: more leave more common parts out, and have fewer shingles each.
SPREAD = 1.6
#: Counters of the corpus-wide count, one byte each.
SKETCH = 1 << 24
#: Sets that one task searches at a time; larger blocks are cut up, and the parts are searched against each other.
BLOCK_SETS = 2048


def needed(size, least=LEAST):
    """The smallest size of another set, and of the overlap with it, that can reach the similarity."""
    return (size * least[0] + least[1] - 1) // least[1]


def shingle_sets(column: pa.Array, n: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: n-word windows, the whole sequence if it is shorter, none without words."""
    h, first = words(column)
    wide = windows(h, n)
    out = []
    for b, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if e - b >= n:
            out.append(np.unique(wide[b : e - n + 1]))
        else:
            out.append(windows(h[b:e], e - b) if e > b else h[:0])
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    if not len(s):
        return 0, 0
    both = (int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(0x14057B7EF767814F)))))
    return tuple(x - (1 << 64) if x >> 63 else x for x in both)


def _scan(docs: DataFrame) -> DataFrame:
    """A row (doc_id, n, sig, sig2) for each document, and for each task one with its counts of shingles."""
    names = ["doc_id", "n", "sig", "sig2", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(SKETCH, np.uint8)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(part.column(1))
            for s in sets:
                at = slots(s)
                count[at] += count[at] < 255
            sig = np.array([signature(s) for s in sets], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(sig[:, 0]), pa.array(sig[:, 1]), pa.nulls(len(sets), pa.binary())], names=names)

        yield from by_slices(one)(batches)
        if count.any():
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([zlib.compress(count, 1)])], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig long, sig2 long, counts binary")


def slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(40)).astype(np.int64) % SKETCH


def _counts(scan: DataFrame) -> bytes:
    """The tasks' counts added up (up to 255), by 32 tasks and then one; SKETCH bytes reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.uint8)
        for b in batches:
            for x in b.column(0):
                more = np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
                total += np.minimum(more, 255 - total)
        if not total.any():
            return
        yield pa.RecordBatch.from_pydict({"counts": [zlib.compress(total, 1)]})

    rows = scan.where("counts is not null").select("counts").repartition(32).mapInArrow(add, "counts binary").repartition(1).mapInArrow(add, "counts binary").collect()
    return zlib.decompress(rows[0][0]) if rows else bytes(SKETCH)


def size_classes(most: int) -> np.ndarray:
    """Where each class of sizes begins: sets that link are of one class or of two that follow each other."""
    begins = [1]
    while begins[-1] <= most:
        begins.append(begins[-1] * LEAST[1] // LEAST[0] + 1)
    return np.array(begins, np.int64)


_CLASSES = size_classes(1 << 40)


def part_keys(s: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Hashes of what a set holds in its rarest parts, in the part numbering of its own size class and of the next larger.

    h is the most shingles in which two linked sets of such a class differ: they agree in all but h parts, so of the h + 1 first
    parts in a common order both have one. A part's place in that order is the count of its rarest shingle (often, by slot), then
    its hash; a part without shingles comes last.
    """
    own = int(np.searchsorted(_CLASSES, len(s), "right")) - 1
    count = often[slots(s)]
    out = []
    for c in (own, own + 1):
        top = int(_CLASSES[c + 1]) - 1
        differ = 2 * top * (LEAST[1] - LEAST[0]) // (LEAST[1] + LEAST[0])
        parts = int(differ * SPREAD) + 2
        h = mix(s + np.uint64(c + 1))
        part = (h % np.uint64(parts)).astype(np.int64)
        rarest = np.full(parts, 256, np.int64)
        np.minimum.at(rarest, part, count)
        total = np.zeros(parts, np.uint64)
        np.add.at(total, part, mix(h))
        keys = mix(total ^ mix(np.arange(parts, dtype=np.uint64) + np.uint64((c + 1) << 40)))
        out.append(keys[np.lexsort((keys, rarest))[: differ + 1]])
    return np.concatenate(out)


def _part_rows(docs: DataFrame, counts: bytes) -> DataFrame:
    """(key, sig): the part keys of each distinct set."""
    coarse = bytes((np.log2(np.arange(256) + 1.0) * 4).astype(np.uint8))  # near counts: one rank
    shared = docs.sparkSession.sparkContext.broadcast(counts.translate(coarse))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        often = np.frombuffer(shared.value, np.uint8)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            keys, sigs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for s in shingle_sets(part.column(1)):
                if len(s) and (sig := signature(s)) not in seen:
                    seen.add(sig)
                    keys.append(part_keys(s, often))
                    sigs.append(np.full(len(keys[-1]), sig[0]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sigs))], names=["key", "sig"])

        return by_slices(one)(batches)

    return docs.select("doc_id", "text").mapInArrow(run, "key long, sig long")


def _block_edges(rows: DataFrame) -> DataFrame:
    """(a, b): the least set of those that share a key, and each other of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lead = None, None
        for b in batches:
            if not b.num_rows:
                continue
            key, sig = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])
            run_of = np.cumsum(new)
            leads = np.concatenate([[lead if lead is not None else 0], sig[new]])
            to = leads[run_of]
            last, lead = key[-1], to[-1]
            other = to != sig
            pairs = np.unique(np.stack([to[other], sig[other]], axis=1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", "sig").mapInArrow(run, "a long, b long").distinct()


class Finder:
    """An inverted index over some sets, and T-occurrence search in it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.tokens, self.begin = np.unique(flat[order], return_index=True)
        self.end = np.append(self.begin[1:], len(flat))

    def partners(self, x: np.ndarray, skip: np.ndarray | None = None) -> np.ndarray:
        """The sets that link with x; those where skip is true are left out.

        DivideSkip: with T the least overlap, the T-1 longest of x's lists can't by themselves carry a set over T, so only sets
        in a short list are candidates. Short lists are merged by a heap (by counting, where they hold many entries); each
        candidate is then looked up in the long lists, by binary search of its own sorted shingles.
        """
        at = np.searchsorted(self.tokens, x)
        at = at[at < len(self.tokens)]
        hit = at[np.isin(self.tokens[at], x)] if len(at) else at
        least = int(needed(len(x)))
        if len(hit) < least:
            return np.zeros(0, np.int64)
        length = self.end[hit] - self.begin[hit]
        order = np.argsort(length, kind="stable")
        n_long = least - 1
        short, long = hit[order[: len(hit) - n_long]], hit[order[len(hit) - n_long :]]
        lists = [self.owner[self.begin[i] : self.end[i]] for i in short.tolist()]
        total = sum(map(len, lists))
        if total <= 64:
            found: dict[int, int] = {}
            for d in heapq.merge(*[one.tolist() for one in lists]):
                found[d] = found.get(d, 0) + 1
            cand = np.fromiter(found.keys(), np.int64, len(found))
            count = np.fromiter(found.values(), np.int64, len(found))
        else:
            counts = np.bincount(np.concatenate(lists), minlength=len(self.sets))
            cand = np.flatnonzero(counts)
            count = counts[cand]
        # intersection needed with a set of this size: i / (|x| + |y| - i) >= a/b
        need = -(-LEAST[0] * (len(x) + self.size[cand]) // (LEAST[0] + LEAST[1]))
        keep = (count + n_long >= need) & (self.size[cand] >= least) & (needed(self.size[cand]) <= len(x))
        if skip is not None:
            keep &= ~skip[cand]
        cand, count, need = cand[keep], count[keep], need[keep]
        probe = self.tokens[long]
        out = []
        for c, have, want in zip(cand.tolist(), count.tolist(), need.tolist(), strict=True):
            own = self.sets[c]
            if len(probe):
                i = np.searchsorted(own, probe)
                have += int((own[np.minimum(i, len(own) - 1)] == probe).sum())
            if have >= want:
                out.append(c)
        return np.array(out, np.int64)


def joined(sets: list[np.ndarray], queries: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that span the same components as all links among the sets, or between the queries and all sets.

    A pair that links already connect isn't searched again: it can't change a component.
    """
    parent = np.arange(len(sets))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    edges: list[tuple[int, int]] = []
    finder = Finder(sets)
    label = parent.copy()
    for q in range(len(sets)) if queries is None else queries:
        own = label == label[q]
        if own.all():
            continue
        for c in finder.partners(sets[q], own).tolist():
            a, b = root(q), root(c)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((q, c))
                label[label == max(a, b)] = min(a, b)
    return edges


def _search(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b) links among the rows (doc, tokens, asks) of each group; where some rows ask, only theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, keys):
            if g.num_rows < 2:
                continue
            docs = g.column("doc").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in g.column("tokens").to_pylist()]
            asks = g.column("asks").to_pylist()
            edges = joined(sets, [i for i, x in enumerate(asks) if x] if any(asks) else None)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([docs[i] for i, _ in edges], pa.int64()), pa.array([docs[j] for _, j in edges], pa.int64())], names=["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "doc").mapInArrow(run, "a long, b long")


def _token_rows(docs: DataFrame, wanted: bytes) -> DataFrame:
    """(doc, tokens) of the documents that the filter lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = KeyFilter(shared.value)

        def some(batches):
            for b in batches:
                ids = b.column(0).cast(pa.int64()).fill_null(0).to_numpy()
                yield b.filter(pa.array(passes(ids)))

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(part.column(1))
            sig = pa.array([signature(s)[0] for s in sets], pa.int64())
            return pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), sig, pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "sig", "tokens"])

        return by_slices(one)(some(batches))

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "doc long, sig long, tokens binary")


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets (doc_id, n, sig, sig2; every row of docs) and the links (a, b) between documents that stand for different sets.

    The links span the same components as all pairs of linked sets do.
    """
    scan = written(_scan(docs), "sets")
    sets = scan.where("counts is null").select("doc_id", "n", "sig", "sig2")
    blocks = components(_block_edges(_part_rows(docs, _counts(scan)))).select(F.col("node").alias("sig"), F.col("component").alias("block"))
    stands = sets.where("n > 0 and doc_id is not null").groupBy("sig", "sig2", "n").agg(F.min("doc_id").alias("doc"))
    members = stands.join(blocks, "sig").select("doc", "sig", "block")
    sizes = members.groupBy("block").agg(F.count("*").alias("size"))
    members = written(members.join(sizes, "block").where("size > 1"), "blocks")
    tokens = _token_rows(docs, key_filter(members, "doc")).dropDuplicates(["doc", "sig"])
    parts = F.ceil(F.col("size") / BLOCK_SETS).cast("int")
    full = members.join(tokens, ["doc", "sig"]).select("doc", "block", "tokens", parts.alias("parts"), F.lit(False).alias("asks"))
    full = full.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    large = members.where(F.col("size") > BLOCK_SETS).limit(1).count() > 0
    if large:
        full = written(full, "tokens")
    links = written(_search(full, ["block", "part"]), "links")
    if large:
        links = links.unionByName(_across(full.where("parts > 1"), links))
    return sets, links


def _across(large: DataFrame, links: DataFrame) -> DataFrame:
    """Links between the parts of blocks that were cut up.

    First each part's main component is tied to the block's by one search; then every set outside its block's main component is
    searched against all parts. A pair within the main component needs no search, so no link that could join components is lost.
    """
    found = components(links)
    label = large.join(found.select(F.col("node").alias("doc"), F.col("component").alias("root")), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    count = label.groupBy("block", "part", "root").agg(F.count("*").alias("k"))
    main = count.groupBy("block", "part").agg(F.max_by("root", F.struct("k", F.lit(0) - F.col("root"))).alias("doc")).select("doc", "block")
    heads = large.join(main, ["doc", "block"]).select("doc", "block", "tokens", "asks")
    first = heads.groupBy("block").agg(F.min("doc").alias("doc")).withColumn("asks", F.lit(True))
    tied = written(_search(heads.drop("asks").join(first, ["block", "doc"], "left").withColumn("asks", F.coalesce("asks", F.lit(False))), ["block"]), "heads")
    both = components(links.unionByName(tied)).select(F.col("node").alias("doc"), F.col("component").alias("root"))
    label = large.join(both, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    count = label.groupBy("block", "root").agg(F.count("*").alias("k"))
    main = count.groupBy("block").agg(F.max_by("root", F.struct("k", F.lit(0) - F.col("root"))).alias("main"))
    label = label.join(main, "block")
    asking = label.where("root != main").select("doc", "block", "tokens", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), F.col("part").alias("own"))
    asked = label.select("doc", "block", "tokens", "part", F.lit(False).alias("asks"))
    rows = asked.join(asking.where("part = own").select("doc", "block", "part"), ["doc", "block", "part"], "left_anti").unionByName(asking.drop("own"))
    return tied.unionByName(_search(rows, ["block", "part"]))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, n_links.

    component_id is the least doc_id that links reach, itself included; n_links counts the spanning links to other sets at the
    document that stands for its set. Words are runs of anything but 0x20 and 0x09-0x0D, A-Z lower-cased; a text of fewer than
    five words is one shingle; null or empty texts and texts without words have none and link with nothing. Equal sets are one
    node of the join (recognised by 128 bits of hash and the size), so copies are never paired with each other. Rows that repeat
    a doc_id with other texts each count as a set of their own but share the id in results; a null doc_id has a null component.
    """
    sets, links = jaccard_links(docs)
    links = written(links.where("a != b").distinct(), "jaccard-links")
    group = components(links).select(F.col("node").alias("doc"), F.col("component").alias("root"))
    ends = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("n_links"))
    stands = sets.where("n > 0 and doc_id is not null").groupBy("sig", "sig2", "n").agg(F.min("doc_id").alias("doc"))
    named = stands.join(group, "doc", "left").join(ends.withColumnRenamed("a", "doc"), "doc", "left")
    named = named.select("sig", "sig2", "n", F.coalesce("root", "doc").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    out = sets.where("n > 0").join(named, ["sig", "sig2", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return out.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their component (the least doc_id); all rows without shingles stay. Of rows that repeat
    doc_id and text one stays; rows without a doc_id are left alone."""
    found = written(jaccard_components(docs), "jaccard-components")
    keep = found.where("component_id = doc_id or doc_id is null").select("doc_id").distinct()
    kept = docs.join(keep, docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi")
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not again.limit(1).count():
        return kept
    repeated = kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(repeated)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
