"""Merkle manifest, packing and ranked search against plain versions, with odd rows, repeats, ties and empty tables."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from medlattice.llm import manifest, packing, ranking

LONG = " ".join(f"word{i % 977} und{i % 31}." for i in range(60_000))
ROWS = [
    (1, "a\nb", "en", "s1", 3), (2, None, None, None, None), (2, "x", "en", None, 1), (None, "no id\n", "de", "s1", 6), (4, "", "en", "s2", 0), (4, "", "en", "s2", 0), (7, "é 漢字\n\n", "fr", "s1", 6),
    (8, LONG, "en", "s3", len(LONG)), (9, "The cat. The cat sat; the CAT sat on 3 mats!", "en", "s3", 9), (10, "the cat", "en", "S3", 7), (11, "The cat", "en", "", 7), (-3, "cat", "en", "s3", 3),
] + [(100 + i, f"line {i}\nof many {i % 7}", "en", "hot", 20) for i in range(95)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, term string, hash string, pos long, path string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", "clash", 5, "clash") for r in ROWS], COLUMNS).repartition(5)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = (row[0], row[3], row[2], row[4], text)
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at // 3 * 3
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])))
        at //= 3
    return out


def plain_manifest(rows):
    by = {}
    for r in rows:
        crc = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        text = r[1].replace("\n", "") if crc and r[1] is not None else r[1]
        by.setdefault(r[3], []).append((-math.inf if r[0] is None else r[0], leaf(r, r[1]), leaf(r, text), r[0]))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[1] for x in sorted(by[s])]) for s in sources}
    top = climb([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (_, own, claimed, doc) in enumerate(sorted(by[s])):
            path = siblings(trees[s], i) + siblings(top, k)
            now = claimed
            for left, right in path:
                now = sha(left, now, right)
            out.append((doc, own, trees[s][-1][0], top[-1][0], sha(*(x + y for x, y in path)), now, now == top[-1][0]))
    return sorted(out, key=repr)


def digests(found):
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    rows = manifest.manifest(manifest.leaves(found[0], even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))), found[1])
    back = manifest.folded(F.coalesce("claimed", "leaf"), F.col("path"))
    return sorted(map(tuple, rows.select("doc_id", "leaf", "subroot", "root", manifest.path_digest(F.col("path")), back, back == F.col("root")).collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_plain_trees(docs, levels):
    want = plain_manifest(ROWS)
    assert digests((docs, levels)) == want
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_little(spark, docs):
    assert digests((docs.where("false"), 2)) == []
    one = docs.where("doc_id = 10")
    own = leaf(ROWS[9], "the cat")
    assert digests((one, 2)) == [(10, own, own, own, sha(), own, True)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27])
def test_traversal_equals_tree(n):
    nodes = [sha(str(i)) for i in range(n)]
    levels = climb(nodes)
    assert list(manifest.traversal(nodes, len(levels) - 1)) == [siblings(levels, i) for i in range(n)]


def test_cheapest_cuts_equal_all_cuts():
    rng = np.random.default_rng(4)
    for _ in range(60):
        size = int(rng.choice([8, 16, 64]))
        cuts = np.cumsum(np.concatenate([[0], rng.integers(1, size + 1, rng.integers(1, 40))]))
        penalty = rng.integers(0, 30, len(cuts))
        least = [0]
        for j in range(1, len(cuts)):
            sizes = [(i, int(cuts[j] - cuts[i])) for i in range(j) if cuts[j] - cuts[i] <= size]
            least.append(min(least[i] + (0 if n & (n - 1) == 0 else size - n) for i, n in sizes) + int(penalty[j]) + packing.EACH)
        chosen, cost = packing.cheapest(cuts, penalty, size)
        n = np.diff(chosen)
        at = np.searchsorted(cuts, chosen)
        assert cost == least[-1] == int(np.where(n & (n - 1), size - n, 0).sum() + penalty[at[1:]].sum() + packing.EACH * len(n))


def test_packing_holds_every_id_once(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    files, pieces = packing.pack(docs, path, 1, words_apart=True)
    got = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    t = Tokenizer.from_file(path)
    known = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [[*t.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in known]
    at, k = 0, 0
    for r in got:  # pieces follow each other in the order of the documents
        own = ids[k]
        assert (r.doc_id, r.start, r.doc_tokens) == (known[k][0], at, len(own))
        assert r.ids_crc32 == zlib.crc32(np.array(own[at : at + r.length], "<u4").tobytes())
        at += r.length
        if at == len(own):
            at, k = 0, k + 1
    assert k == len(ids) and at == 0
    filled = {}
    for r in got:
        assert r.offset == filled.get(r.sequence_id, 0) and r.length > 0
        filled[r.sequence_id] = r.offset + r.length
    assert sorted(filled) == list(range(len(filled))) and max(filled.values()) <= 2048
    assert sum(2048 - n for n in filled.values() if n & (n - 1)) <= 0.02 * sum(filled.values())
    whole = {r.sequence_id: r for r in packing.sequences(files, pieces).collect()}
    flat = [i for own in ids for i in own]
    assert np.concatenate([np.frombuffer(whole[s].ids, "<u2") for s in sorted(whole)]).tolist() == flat
    assert {s: r.n_tokens for s, r in whole.items()} == filled
    assert packing.pack(docs.where("false"), path, 1)[1].count() == 0


def plain_ranking(rows, items, k=10):
    def terms(text):
        return re.findall(ranking.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    bags = [(r[0], terms(r[1])) for r in rows if terms(r[1])]
    n_docs, n_terms = len(bags), sum(len(b) for _, b in bags)
    counts = []
    for doc, bag in bags:
        tf = {}
        for x in bag:
            tf[x] = tf.get(x, 0) + 1
        counts.append((doc, len(bag), tf))
    df = {}
    for _, _, tf in counts:
        for x in tf:
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for doc, n, tf in counts:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in terms(text) if x in tf)
            if score > 0:
                scored.append((-score, -math.inf if doc is None else doc, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "the cat sat"), (1, "the cat sat"), (2, "line 4 of many many"), (3, None), (4, ""), (5, "!?"), (6, "nowhere"), (7, "LINE line é 漢字 word3 und7 cat"), (None, "cat 3 mats"), (1, "many"), (8, LONG[:9000])]


@pytest.mark.parametrize("shard_bytes", [300, 8_000_000])
def test_ranking_equals_all_scores(spark, docs, shard_bytes, monkeypatch):
    monkeypatch.setattr(ranking, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 200 if shard_bytes == 300 else 200_000)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = ranking.ranked(docs, items, "item_id", "text", 10).select("item", "rank", "doc_id", "score")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_ranking(ROWS, ITEMS)
    assert ranking.ranked(docs.where("false"), items, "item_id", "text", 10).count() == 0
    assert ranking.ranked(docs, items.where("false"), "item_id", "text", 10).count() == 0


def test_index_of_all_terms_gives_the_same(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = ranking.search(ranking.index(docs), ranking.query_terms(items, "item_id", "text"), 3).select("item", "rank", "doc_id", "score")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_ranking(ROWS, ITEMS, 3)


def test_packed_numbers():
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.integers(0, 1 << int(b), 50, dtype=np.uint64) for b in range(1, 64)] + [np.array([0, 2**64 - 1], np.uint64)])
    raw, ends = ranking.packed(v)
    assert (ranking.unpacked(raw) == v).all() and ends[-1] == len(raw)


def test_a_language_of_one_id_is_learned(spark):
    from medlattice.llm import language

    words = {"en": "the house is green and the river is cold", "zz": "zuzu kwazi mwezu kazi wzu mkazu zawi"}
    rows = [(i, "en", f"{words['en']} {i % 7}") for i in range(60)] + [(25, "zz", f"{words['zz']} {i % 3}") for i in range(3000)]
    made = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(6)
    assert language.fit_language(made).languages == ["en", "zz"]
