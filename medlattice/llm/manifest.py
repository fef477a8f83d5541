"""Merkle manifest of a dataset: a ternary hash tree for each source, one over the sources' roots, and every row's authentication path.

Leaves get their place in their source's tree from a range sort and prefix sums. Trees are cut into aligned blocks of 3**levels nodes: a
block is one row of a table, its root is one node of the level above, which is cut in the same way until each tree is one block. Within a
block, Merkle traversal walks the leaves in order: the siblings of the present leaf are held, a stack of each height hashes one leaf a
step towards the siblings that are due next, and the node just left is known from the walk. What is held grows with the square of the
block's height, not with its leaves. The paths above a block are computed once and shared by its leaves.

Defined results: rows whose doc_id is null come first in their source, rows that repeat a doc_id are ordered by their leaf; a null source
is a source of its own, the first; an empty table has no rows and no root. A row that is alone in the dataset has an empty path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Children of a node, and levels of an aligned block.
RUN, LEVELS = 3, 6
#: What a row's leaf covers, in order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")
_SIBLINGS = "array<struct<left: string, right: string>>"


def framed(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, tampered: Column | None = None, text: Column | None = None) -> DataFrame:
    """(source, doc_id, leaf, claimed): claimed is the leaf with another text, where `tampered` holds and the text differs, else null."""
    own = [framed(F.col(c)) for c in COVERED]
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered & ~text.eqNullSafe(F.col("text")), digest(*own[:-1], framed(text)))
    return docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), digest(*own).alias("leaf"), changed.alias("claimed"))


def placed(rows: DataFrame, tree: str, order: list[str], tag: str) -> DataFrame:
    """rows with pos (place in the tree, from 0, in the order given) and n (nodes of the tree).

    Rows are sorted by range, so that a large tree spans many partitions; what is summed has one row for each partition and tree in it.
    """
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    sorted_rows = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("line", F.monotonically_increasing_id()), tag)
    part = F.shiftright("line", 33)
    cuts = sorted_rows.groupBy(F.col(tree).alias("t"), part.alias("p")).agg(F.min("line").alias("first"), F.count("*").alias("many"))
    own = Window.partitionBy("t")
    before = F.coalesce(F.sum("many").over(own.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = cuts.select("t", "p", (before - F.col("first")).alias("shift"), F.sum("many").over(own).alias("n"))
    return sorted_rows.join(cuts, F.col(tree).eqNullSafe(F.col("t")) & (part == F.col("p"))).select(*rows.columns, (F.col("line") + F.col("shift")).alias("pos"), "n")


def _levels(n: Column, most: int) -> Column:
    """Levels from a block's nodes to its root: all where the tree goes on above, else as many as leave one node."""
    return sum((n > RUN**k).cast("int") for k in range(most))


def _root(nodes: Column, levels: Column) -> Column:
    def up(now: Column, _: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(now) - 1) / RUN).cast("int")), lambda i: F.sha2(F.array_join(F.slice(now, i * RUN + 1, RUN), ""), 256))

    return F.element_at(F.when(levels == 0, nodes).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), nodes, up)), 1)


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """One row for each aligned block: (tree, block, n, nodes in order, root). nodes: tree, pos, n, node struct<hash, ...>."""
    grouped = nodes.groupBy("tree", F.floor(F.col("pos") / RUN**levels).cast("long").alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("found"))
    out = grouped.select("tree", "block", "n", F.col("found.node").alias("nodes"))
    return written(out.withColumn("root", _root(F.col("nodes.hash"), _levels(F.col("n"), levels))), "merkle-blocks")


def _feed(stack: list[str], node: str, height: int) -> str:
    """The node of that height, if this one completes it, else nothing."""
    for j in range(height):
        stack[j] += node
        if len(stack[j]) < 64 * RUN:
            return ""
        node, stack[j] = hashlib.sha256(stack[j].encode()).hexdigest(), ""
    return node


def _close(stack: list[str], height: int) -> str:
    """The last node of that height, whose runs are shorter; nothing if none is begun."""
    node = ""
    for j in range(height):
        node, stack[j] = stack[j] + node, ""
        node = node and hashlib.sha256(node.encode()).hexdigest()
    return node


class Coming:
    """The siblings that a height needs next: the nodes after the first of a group, hashed one leaf a step."""

    def __init__(self, group: int, height: int, end: int):
        self.height, self.last = height, end
        self.at, self.end = ((RUN * group + k) * RUN**height for k in (1, RUN))
        self.stack, self.ready = [""] * height, []

    def step(self, leaf) -> None:
        if self.at < min(self.end, self.last):
            node = _feed(self.stack, leaf[self.at], self.height)
            self.at += 1
            node = node or (_close(self.stack, self.height) if self.at == self.last else "")
            if node:
                self.ready.append(node)

    def group(self) -> list[str]:
        return ["", *self.ready, *[""] * (RUN - 1 - len(self.ready))]


def traversal(leaf: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf of a block, in order, its siblings to the left and to the right on each level."""
    power = [RUN**h for h in range(levels + 1)]
    now, coming = [], []
    for h in range(levels):  # siblings of the first leaf
        first = Coming(0, h, len(leaf))
        while first.at < min(first.end, first.last):
            first.step(leaf)
        now.append(first.group())
        coming.append(Coming(1, h, len(leaf)))
    for i, own in enumerate(leaf):
        out = []
        for h in range(levels):
            c = i // power[h] % RUN
            out.append(("".join(now[h][:c]), "".join(now[h][c + 1 :])))
        yield out
        for c in coming:
            c.step(leaf)
        node = own
        for h in range(levels):
            now[h][i // power[h] % RUN] = node
            if (i + 1) % power[h + 1]:
                break
            node = hashlib.sha256("".join(now[h]).encode()).hexdigest()
            now[h] = coming[h].group()
            coming[h] = Coming((i + 1) // power[h + 1] + 1, h, len(leaf))


def _walked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Adds to each block `below`, the paths of its nodes within it."""
    for batch in batches:
        below = []
        for nodes, n in zip(batch.column(batch.schema.get_field_index("nodes")), batch.column(batch.schema.get_field_index("n")).to_pylist(), strict=True):
            leaf = nodes.values.field("hash").to_pylist()
            levels = sum(n > RUN**k for k in range(most))
            left, right = [], []
            for path in traversal(leaf, levels):
                for x, y in path:
                    left.append(x)
                    right.append(y)
            pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
            below.append(pa.ListArray.from_arrays(pa.array(np.arange(len(leaf) + 1, dtype=np.int32) * levels), pairs))
        at = np.cumsum([0, *map(len, below)]).astype(np.int32)
        paths = pa.ListArray.from_arrays(pa.array(at), pa.concat_arrays(below)) if below else pa.array([], pa.list_(pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))))
        yield pa.RecordBatch.from_arrays([*batch.columns, paths], names=[*batch.schema.names, "below"])


def _paths(blocks: DataFrame, levels: int) -> DataFrame:
    """The blocks' nodes with path, from the node to the block's root and on through `above`."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)
    walked = blocks.mapInArrow(lambda batches: _walked(batches, levels), f"{ddl}, below array<{_SIBLINGS}>")
    rows = walked.select("tree", "block", "above", "top", F.posexplode(F.arrays_zip("nodes", "below")).alias("i", "x"))
    return rows.select("tree", (F.col("block") * RUN**levels + F.col("i")).alias("pos"), "top", F.col("x.nodes").alias("node"), F.concat("x.below", "above").alias("path"))


def trees(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, pos, node, path, top) from (tree, pos, n, node): every node's path to its tree's root, and that root."""
    blocks = _blocks(nodes, levels)
    none = F.array().cast(_SIBLINGS)
    if blocks.where(F.col("n") > RUN**levels).isEmpty():
        return _paths(blocks.withColumns({"above": none, "top": F.col("root")}).drop("root"), levels)
    upper = trees(blocks.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / RUN**levels).alias("n"), F.struct(F.col("root").alias("hash")).alias("node")), levels)
    upper = upper.select(F.col("tree").alias("t"), F.col("pos").alias("p"), F.col("path").alias("above"), "top")
    return _paths(blocks.drop("root").join(upper, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("p"))).drop("t", "p"), levels)


def manifest(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(source, doc_id, leaf, claimed, subroot, root, path) of leaves(): path has the siblings from the leaf up to the root over all sources."""
    node = F.struct(F.col("leaf").alias("hash"), "doc_id", "claimed")
    at = placed(rows, "source", ["doc_id", "leaf"], "merkle-leaves").select(F.col("source").alias("tree"), "pos", "n", node.alias("node"))
    blocks = _blocks(at, levels)
    up = blocks.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / RUN**levels).alias("n"), F.struct(F.col("root").alias("hash")).alias("node"))
    within = written(trees(up, levels).select("tree", "pos", F.col("path").alias("within"), F.col("top").alias("subroot")), "merkle-within")
    roots = within.where("pos = 0").select(F.lit(0).alias("all"), F.col("tree").alias("source"), "subroot")
    over = placed(roots, "all", ["source"], "merkle-roots").select(F.col("all").alias("tree"), "pos", "n", F.struct(F.col("subroot").alias("hash"), "source").alias("node"))
    over = trees(over, levels).select(F.col("node.source").alias("s"), F.col("path").alias("over"), F.col("top").alias("root_of_all"))
    above = within.join(over, F.col("tree").eqNullSafe(F.col("s"))).select(F.col("tree").alias("t"), F.col("pos").alias("p"), F.concat("within", "over").alias("above"), F.struct("subroot", F.col("root_of_all").alias("root")).alias("top"))
    full = blocks.drop("root").join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("p"))).drop("t", "p")
    return _paths(full, levels).select(F.col("tree").alias("source"), "node.doc_id", F.col("node.hash").alias("leaf"), "node.claimed", "top.subroot", "top.root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda now, x: F.sha2(F.concat(x["left"], now, x["right"]), 256))


def path_digest(path: Column) -> Column:
    """H of the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = leaves(docs, F.coalesce(even, F.lit(False)), F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    back = folded(F.coalesce("claimed", "leaf"), F.col("path"))
    out = manifest(rows).select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, key: str, start: str) -> str:
    return f"""{name} as (
  {start}
  union all
  select {key}, h + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], ''))) from {name} where len(nodes) > 1)"""


def _walk_sql(name: str, tree: str, match: str, start: str) -> str:
    left, right = "array_to_string(nodes[place // 3 * 3 + 1 : place], '')", "array_to_string(nodes[place + 2 : place // 3 * 3 + 3], '')"
    return f"""{name} as (
  {start}
  union all
  select w.doc_id, w.source, leaf, place // 3, w.h + 1, sha256({left} || folded || {right}), proof || {left} || {right}
  from {name} w join {tree} t on {match} t.h = w.h where len(nodes) > 1)"""


_CRC = "list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda c, b: list_reduce(range(0, 8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295::bigint)"
_FRAMED = " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in COVERED[:-1])

OP11_SQL = f"""
with recursive raw as (
  select doc_id, source, {_FRAMED} as fields, text, case when xor({_CRC}, 4294967295) % 2 = 0 then replace(text, chr(10), '') else text end as altered from documents),
hashed as (
  select doc_id, source, sha256(fields || coalesce(strlen(text) || ':' || text, '-')) as leaf, sha256(fields || coalesce(strlen(altered) || ':' || altered, '-')) as claimed from raw),
leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from hashed),
{_tree_sql("own", "source", "select source, 0 as h, list(leaf order by pos) as nodes from leaves group by source")},
subroots as (
  select source, nodes[1] as subroot, row_number() over (order by source nulls first) - 1 as pos from own where len(nodes) = 1),
{_tree_sql("everything", "source", "select null::varchar as source, 0 as h, list(subroot order by pos) as nodes from subroots")},
{_walk_sql("up", "own", "t.source is not distinct from w.source and", "select doc_id, source, leaf, pos as place, 0 as h, claimed as folded, '' as proof from leaves")},
{_walk_sql("over", "everything", "", "select u.doc_id, u.source, u.leaf, s.pos as place, 0 as h, u.folded, u.proof from up u join own t on t.source is not distinct from u.source and t.h = u.h and len(t.nodes) = 1 join subroots s on s.source is not distinct from u.source")}
select o.doc_id, o.leaf, s.subroot, t.nodes[1] as root, sha256(o.proof) as proof_sha256, o.folded as folded_root, o.folded = t.nodes[1] as verified
from over o join everything t on t.h = o.h and len(t.nodes) = 1 join subroots s on s.source is not distinct from o.source
"""
