"""Merkle dataset manifest: a digest of every row, one tree a group, one tree over the groups, and a proof for every row.

Leaves are numbered in order within their group and cut into aligned blocks of ``BLOCK`` leaves.  A block
is a whole subtree, so one task walks it: stacks of half-built subtrees (treehash) advance the
authentication path from leaf to leaf, and hold a number of inner nodes that grows with the block's height
only.  The roots of the blocks are the leaves of the next round, and so on to one root; the path above a
block is the same for all of its leaves and is appended by a join.

The hash H is SHA-256 over concatenated hexadecimal digests.  Two consecutive nodes become their H; a
last node without a neighbour becomes the H of itself; a single node is its own root.
"""

from __future__ import annotations

from binascii import hexlify, unhexlify
from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from pipetally.llm.shared import few, reach_workers, written

HEIGHT = 8
BLOCK = 1 << HEIGHT
#: Upper paths and counts of partitions are broadcast up to so many rows (a few hundred bytes each); beyond, joins shuffle.
BROADCAST_ROWS = 100_000

Node = bytes | None


def parent(left: Node, right: Node) -> Node:
    """The node over two neighbours; None stands for nodes past the end."""
    return None if left is None else hexlify(sha256(left + (right or b"")).digest())


class _TreeHash:
    """One node, (height, first leaf), built one leaf or one merge at a time; it holds a node a height at most."""

    __slots__ = ("height", "next", "nodes", "ready")

    def __init__(self, height: int, node: Node):
        self.height, self.next, self.nodes, self.ready = height, 0, [(height, node)], True

    def start(self, first: int) -> None:
        self.next, self.nodes, self.ready = first, [], False

    def low(self) -> int:
        """The height of its lowest node, which says how urgent it is."""
        return 1 << 30 if self.ready else self.nodes[-1][0] if self.nodes else self.height

    def step(self, leaves: Sequence[bytes]) -> None:
        nodes = self.nodes
        if len(nodes) > 1 and nodes[-1][0] == nodes[-2][0]:
            (h, right), (_, left) = nodes.pop(), nodes.pop()
            nodes.append((h + 1, parent(left, right)))
        else:
            nodes.append((0, leaves[self.next] if self.next < len(leaves) else None))
            self.next += 1
        self.ready = nodes[0][0] == self.height


def block_paths(leaves: Sequence[bytes], height: int) -> tuple[Node, list[list[Node]]]:
    """The root over ``leaves`` (2 ** ``height`` at most) and each leaf's siblings from below, None where it has none.

    Besides the leaves and the paths given out, 3 nodes a height are held: the path, and two in each stack
    on average.  Each leaf costs 2 * ``height`` - 1 steps.
    """
    first: list[list[Node]] = [[None, None] for _ in range(height + 1)]  # the first two nodes of each height
    stack: list[tuple[int, Node]] = []
    for i in range(1 << height):
        stack.append((0, leaves[i] if i < len(leaves) else None))
        h, at = 0, i
        while True:
            if at < 2:
                first[h][at] = stack[-1][1]
            if len(stack) < 2 or stack[-2][0] != stack[-1][0]:
                break
            (h, right), (_, left) = stack.pop(), stack.pop()
            h, at = h + 1, at >> 1
            stack.append((h, parent(left, right)))
    root = stack[0][1]
    path = [pair[1] for pair in first[:height]]
    stacks = [_TreeHash(h, first[h][0]) for h in range(height)]
    out = []
    for leaf in range(len(leaves)):
        out.append(list(path))
        after = leaf + 1
        for h, s in enumerate(stacks):
            if after & ((1 << h) - 1):
                break
            while not s.ready:  # the schedule below has it ready in time
                s.step(leaves)
            path[h] = s.nodes[0][1]
            start = (after + (1 << h)) ^ (1 << h)
            if start < len(leaves):
                s.start(start)
            else:
                s.nodes = [(h, None)]
        for _ in range(2 * height - 1):
            s = min(stacks, key=_TreeHash.low)
            if s.ready:
                break
            s.step(leaves)
    return root, out


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of the columns' values: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, from 0 within their group ``g``, and ``n``, the group's rows; groups may be of any size."""
    dealt = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()), "merkle-ordered")  # the partition, then the place in it
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    spans = dealt.groupBy("g", "part").agg(F.min("at").alias("least"), F.count("*").alias("c"))  # one row a partition, and one more a group
    group = W.partitionBy("g")
    before = F.coalesce(F.sum("c").over(group.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("g", "part", (before - F.col("least")).alias("shift"), F.sum("c").over(group).alias("n"))
    return dealt.join(few(spans, BROADCAST_ROWS), ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _climbed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (g, pos, n, node and more) with ``path``, the siblings from below, and ``root``, both of their group's tree."""
    n = F.col("n")
    lone = F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1)))
    rows = nodes.withColumns({"block": F.floor(F.col("pos") / BLOCK), "height": F.when(n <= BLOCK, lone).otherwise(HEIGHT).cast("int")})
    kinds = T.StructType([*rows.schema.fields, T.StructField("path", T.ArrayType(T.BinaryType())), T.StructField("top", T.BinaryType())])

    def walk(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos").combine_chunks()
        top, paths = block_paths([hexlify(x) for x in group["node"].to_pylist()], group["height"][0].as_py())
        short = [[None if s is None else unhexlify(s) for s in p] for p in paths]
        group = group.append_column("path", pa.array(short, pa.list_(pa.binary())))
        return group.append_column("top", pa.array([unhexlify(top)] + [None] * (len(paths) - 1), pa.binary()))

    blocks = written(rows.groupBy("g", "block").applyInArrow(walk, kinds), "merkle-blocks")
    tops = blocks.filter("top is not null").select("g", F.col("block").alias("pos"), F.ceil(n / BLOCK).alias("n"), F.col("top").alias("node"))
    if tops.filter("n > 1").isEmpty():
        above = tops.select("g", F.col("pos").alias("block"), F.col("node").alias("root"), F.array().cast("array<binary>").alias("up"))
    else:
        above = _climbed(tops).select("g", F.col("pos").alias("block"), "root", F.col("path").alias("up"))
    held = blocks.join(few(above, BROADCAST_ROWS), ["g", "block"])
    return held.withColumn("path", F.concat("path", "up")).drop("block", "height", "top", "up")


def _sides(path: Column, pos: Column) -> Column:
    """A path as (sibling, is_left): hexadecimal digests, null where a node has no neighbour."""
    return F.transform(path, lambda s, i: F.struct(F.lower(F.hex(s)).alias("sibling"), (F.call_function("shiftright", pos, i) % 2 == 1).alias("is_left")))


def merkle_manifest(rows: DataFrame, leaf: Column, group: str, order: str, also: dict[str, Column] | None = None) -> DataFrame:
    """(group, order, pos, leaf, subroot, root, proof, and ``also``) of every row, with ``leaf`` a hexadecimal SHA-256.

    One tree for each value of ``group`` (a text) over its rows by ``order``, nulls first, equal ones by
    their leaf (so that repeated rows give the same trees in any order); one tree over the trees' roots, by
    group, null first, then bytewise.  ``proof`` is an array of (sibling, is_left) from the leaf to the
    root, with a null sibling where a node has no neighbour.  Only the columns named are looked at; an
    empty table gives an empty result.
    """
    reach_workers(rows.sparkSession)
    extra = [c.alias(n) for n, c in (also or {}).items()]
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # never null, sorts as the group does
    leaves = written(rows.select(named.alias("g"), F.col(order).alias("o"), F.unhex(leaf).alias("node"), *extra), "merkle-leaves")
    below = _climbed(_numbered(leaves, ["o", "node"]))
    trees = written(below.filter("pos = 0").select(F.lit("").alias("g"), F.col("g").alias("o"), F.col("root").alias("node")), "merkle-trees")
    over = _climbed(_numbered(trees, ["o"])).select(F.col("o").alias("g"), F.col("pos").alias("tree"), F.col("path").alias("up"), F.col("root").alias("whole"))
    shown = lambda c: F.lower(F.hex(c))
    return below.join(few(over, BROADCAST_ROWS), "g").select(
        F.when(F.col("g") != "", F.substr("g", F.lit(2))).alias(group), F.col("o").alias(order), "pos", shown("node").alias("leaf"), shown("root").alias("subroot"),
        shown("whole").alias("root"), F.concat(_sides(F.col("path"), F.col("pos")), _sides(F.col("up"), F.col("tree"))).alias("proof"), *(also or {}),
    )


def proof_digest(proof: Column) -> Column:
    """H of the siblings of a proof, from below; of no bytes where there are none."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: p["sibling"]), ""), 256)  # array_join leaves nulls out


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and a proof."""
    return F.aggregate(proof, leaf, lambda acc, p: F.sha2(F.when(p["is_left"], F.concat(F.coalesce(p["sibling"], F.lit("")), acc)).otherwise(F.concat(acc, F.coalesce(p["sibling"], F.lit("")))), 256))


def op11_merkle_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof; where 7 divides the CRC-32 of the id, the proof is tried on a row with one character more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols = lambda more: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + more, F.col("text")]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    m = merkle_manifest(docs, leaf_digest(cols(0)), "lang", "doc_id", {"tampered": F.when(changed, F.unhex(leaf_digest(cols(1))))})
    found = folded(F.coalesce(F.lower(F.hex("tampered")), F.col("leaf")), F.col("proof"))
    m = m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), found.alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op11_merkle_dataset_manifest": op11_merkle_dataset_manifest}

_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars + {more} as varchar)", "text")) + ")"

ORACLES = {
    # the trees level by level, every sibling looked up, every leaf folded; CRC-32 by its polynomial
    "op11_merkle_dataset_manifest": f"""
with recursive d as (
  select doc_id, lang, {_LEAF.format(more=0)} leaf, {_LEAF.format(more=1)} other,
    xor(list_reduce(list_prepend(cast(4294967295 as ubigint), [cast(ascii(c) as ubigint) for c in string_split(cast(doc_id as varchar), '')]),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), cast(4294967295 as ubigint)) crc
  from documents),
l as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by lang) n from d),
t(lvl, lang, pos, h, n) as (
  select 0, lang, pos, leaf, n from l
  union all select lvl + 1, lang, pos // 2, sha256(string_agg(h, '' order by pos)), (any_value(n) + 1) // 2 from t where n > 1 group by lvl, lang, pos // 2),
top as (select lang, h subroot, lvl high, row_number() over (order by lang nulls first) - 1 pos, count(*) over () n from t where n = 1),
u(lvl, pos, h, n) as (
  select 0, pos, subroot, n from top
  union all select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (any_value(n) + 1) // 2 from u where n > 1 group by lvl, pos // 2),
root as (select h root, lvl high from u where n = 1),
steps as (
  select doc_id, l.leaf, l.lang, l.pos, t.lvl k, (l.pos >> t.lvl) & 1 side, s.h sibling from l join t on t.lang is not distinct from l.lang and t.pos = l.pos >> t.lvl and t.n > 1
    left join t s on s.lang is not distinct from l.lang and s.lvl = t.lvl and s.pos = xor(l.pos >> t.lvl, 1)
  union all
  select doc_id, l.leaf, l.lang, l.pos, top.high + u.lvl, (top.pos >> u.lvl) & 1, s.h from l join top on top.lang is not distinct from l.lang
    join u on u.pos = top.pos >> u.lvl and u.n > 1 left join u s on s.lvl = u.lvl and s.pos = xor(top.pos >> u.lvl, 1)),
fold(doc_id, lang, pos, k, h) as (
  select doc_id, lang, pos, 0, case when crc % 7 = 0 then other else leaf end from l
  union all
  select f.doc_id, f.lang, f.pos, f.k + 1, sha256(case when s.side = 1 then coalesce(sibling, '') || h else h || coalesce(sibling, '') end)
  from fold f join steps s on s.lang is not distinct from f.lang and s.pos = f.pos and s.k = f.k),
proof as (select lang, pos, sha256(coalesce(string_agg(sibling, '' order by k), '')) proof_sha256 from steps group by 1, 2)
select l.doc_id, l.leaf, top.subroot, root.root, coalesce(p.proof_sha256, sha256('')) proof_sha256, f.h folded_root, f.h = root.root verified
from l join top on top.lang is not distinct from l.lang cross join root
join fold f on f.lang is not distinct from l.lang and f.pos = l.pos and f.k = top.high + root.high
left join proof p on p.lang is not distinct from l.lang and p.pos = l.pos
"""
}
