"""Operator 12, Merkle dataset manifest by cogrouped subtree exchange.

Leaves are hashed by JVM expressions, so texts are never shuffled. They are ranked within their
source by a range sort with two-level counts, and cut into superblocks of ARITY ** LEVELS consecutive
ones. Going up, each superblock is reduced to one node, and those nodes are superblocks'
leaves again, until a source is one node; sources' nodes are the leaves of the tree above them.
Going down, the leaves of each superblock are cogrouped with the outer nodes that it needs (the
siblings on the way from its top to the root): one function finishes the reduction inside, joins the
proofs and folds them. Small trees share a group, and no group holds more than a few superblocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memloom.llm.common import cut, remainder, table

#: Nodes of a run, and levels of a superblock (6561 leaves) unless a call says otherwise (`high`).
ARITY, LEVELS = 3, 8
#: Columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The way from a node to the root: the siblings left and right of it, a level each, as joined hex digests.
PATH = "path array<struct<left: string, right: string>>"
NODE = "tree string, total long, rank long, node string"


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part_of(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(part_of(columns[c]) for c in COLUMNS)).cast("binary"), 256)


def ranked(rows: DataFrame, tree: str, *order: Column) -> DataFrame:
    """rows with rank (from 0, by order) and total (rows) within `tree`, which order begins with. rows must be a written table; order
    must tell all rows apart, so that a range of any key has many tasks."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()), "merkle-order")
    placed = placed.withColumn("range", F.shiftright("pos", 33))
    per = placed.groupBy("range", tree).agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    own = W.partitionBy(tree)
    before = F.coalesce(F.sum("n").over(own.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col("range").alias("r2"), F.col(tree).alias("t2"), (before - F.col("first")).alias("shift"), F.sum("n").over(own).alias("total"))
    out = placed.join(per, (F.col("range") == F.col("r2")) & (F.col(tree) == F.col("t2")))
    return out.withColumn("rank", F.col("pos") + F.col("shift")).drop("pos", "range", "r2", "t2", "shift")


def grouped(nodes: DataFrame, shares: int, high: int) -> DataFrame:
    """nodes with block (the superblock) and share: one for each superblock of a large tree, a common one for small trees."""
    size = F.lit(ARITY**high)
    block = F.floor(F.col("rank") / size)
    share = F.when(F.col("total") > size, F.xxhash64("tree", block)).otherwise(F.pmod(F.xxhash64("tree"), F.lit(shares)))
    return nodes.withColumn("block", block).withColumn("share", share)


def reduced(nodes: list[str], total: int, high: int) -> list[list[str]]:
    """The levels of a superblock, its leaves first: `high` runs if its tree goes on above it, else until one node is left."""
    levels = [nodes]
    while len(levels) <= high if total > ARITY**high else len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[k : k + ARITY]) for k in range(0, len(last), ARITY)])
    return levels


def ways(levels: list[list[str]], outer: list) -> list[list[tuple[str, str]]]:
    """The way of each leaf of a superblock to the root: through its levels, then along the outer nodes."""
    above = [[(o["left"], o["right"]) for o in outer]]
    for level in reversed(levels[:-1]):
        own = []
        for k in range(len(level)):
            run, at = level[k - k % ARITY : k - k % ARITY + ARITY], k % ARITY
            own.append([("".join(run[:at]), "".join(run[at + 1 :])), *above[k // ARITY]])
        above = own
    return above


def parts(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, part in pdf.sort_values("rank").groupby(["tree", "block"], sort=False):
        yield part


def lifted(nodes: DataFrame, shares: int, high: int) -> DataFrame:
    """The next level: one node for each superblock."""

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part in parts(pdf):
            total = int(part["total"].iloc[0])
            top = reduced(part["node"].tolist(), total, high)[-1]
            out.append((part["tree"].iloc[0], -(-total // ARITY**high), int(part["block"].iloc[0]), top[0]))
        return pd.DataFrame(out, columns=["tree", "total", "rank", "node"])

    return cut(grouped(nodes, shares, high).select("share", "block", "tree", "total", "rank", "node").groupBy("share").applyInPandas(up, NODE), "merkle-nodes")


def climbed(nodes: DataFrame, shares: int, high: int) -> list[DataFrame]:
    """nodes and all levels of superblocks above them; the last has one node a tree."""
    levels = [nodes]
    while levels[-1].filter("total > 1").limit(1).count() or len(levels) == 1:
        levels.append(lifted(levels[-1], shares, high))
    return levels


def outward(outer: DataFrame, shares: int) -> DataFrame:
    """The tops of superblocks with their ways, dealt as `grouped` deals what is below them."""
    share = F.when(F.col("total") > 1, F.xxhash64("tree", "rank")).otherwise(F.pmod(F.xxhash64("tree"), F.lit(shares)))
    return outer.select(share.alias("share"), "tree", F.col("rank").alias("block"), "subroot", "root", "path")


def lowered(nodes: DataFrame, outer: DataFrame, shares: int, high: int) -> DataFrame:
    """(tree, total, rank, subroot, root, path) of each node, from those of the superblocks' tops."""

    def down(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        tops = {(r.tree, r.block): r for r in above.itertuples(index=False)}
        out = []
        for part in parts(inner):
            tree, total, block = part["tree"].iloc[0], int(part["total"].iloc[0]), part["block"].iloc[0]
            top = tops[tree, block]
            found = ways(reduced(part["node"].tolist(), total, high), top.path)
            out += [(tree, total, rank, top.subroot, top.root, [{"left": a, "right": b} for a, b in way]) for rank, way in zip(part["rank"].tolist(), found, strict=True)]
        return pd.DataFrame(out, columns=["tree", "total", "rank", "subroot", "root", "path"])

    own = grouped(nodes, shares, high).select("share", "block", "tree", "total", "rank", "node").groupBy("share")
    return cut(own.cogroup(outward(outer, shares).groupBy("share")).applyInPandas(down, f"tree string, total long, rank long, subroot string, root string, {PATH}"), "merkle-ways")


def prover(high: int) -> Callable:
    """The last exchange: leaves of some superblocks with the outer nodes that these need."""

    def proven(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        tops = {(r.tree, r.block): r for r in above.itertuples(index=False)}
        out = []
        for part in parts(inner):
            top = tops[part["tree"].iloc[0], part["block"].iloc[0]]
            found = ways(reduced(part["node"].tolist(), int(part["total"].iloc[0]), high), top.path)
            for key, leaf, forged, way in zip(part["key"], part["node"], part["forged"], found, strict=True):
                node = leaf if forged is None else forged
                for left, right in way:
                    node = H(left, node, right)
                out.append((key, leaf, top.subroot, top.root, H(*(x for pair in way for x in pair)), node, node == top.root))
        return pd.DataFrame(out, columns=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return proven


def manifest(docs: DataFrame, high: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of docs, which has COLUMNS and perhaps others.

    Documents for which crc32 of doc_id is even are tampered with before they are folded: the line feeds of their texts are gone.
    A null id stands first in its source, and its row is not tampered with; rows of equal id stand by their leaves, and equal rows
    have equal leaves, each with a proof of its own. A null source is a tree of its own, before all others; a source
    of one row is its leaf. Empty and very long texts are hashed like others, in the JVM. An empty table gives an empty
    result.
    """
    text = F.col("text")
    hit = (remainder(F.col("doc_id"), 2) == 0) & F.contains(text, F.lit("\n"))
    columns = {c: F.col(c) for c in COLUMNS}
    forged = F.when(hit, leaf_of(columns | {"text": F.replace(text, F.lit("\n"), F.lit(""))}))
    leaves = docs.select(part_of(F.col("source")).alias("tree"), "doc_id", leaf_of(columns).alias("node"), forged.alias("forged"), F.monotonically_increasing_id().alias("row"))
    leaves = cut(leaves, "merkle-leaves")
    shares = -(-leaves.count() // ARITY**high) or 1
    leaves = cut(ranked(leaves, "tree", F.col("tree"), F.col("doc_id").asc_nulls_first(), F.col("node"), F.col("row")), "merkle-ranked")
    levels = climbed(leaves, shares, high)
    source = F.when(F.col("tree") != "-", F.expr("substring(tree, instr(tree, ':') + 1)"))
    subroots = levels[-1].select(F.col("tree").alias("its"), source.alias("source"), "node", F.lit("").alias("tree"))
    subroots = cut(ranked(subroots, "tree", F.col("tree"), F.col("source").asc_nulls_first()), "merkle-subroots")
    tops = climbed(subroots, shares, high)
    outer = tops[-1].select("tree", "total", "rank", F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"), F.array().cast(PATH.removeprefix("path ")).alias("path"))
    for nodes in reversed(tops[:-1]):
        outer = lowered(nodes, outer, shares, high)
    outer = subroots.select("its", F.col("node").alias("subroot"), F.col("rank").alias("r")).join(outer.drop("subroot"), F.col("r") == F.col("rank"))
    outer = outer.select(F.col("its").alias("tree"), F.lit(1).cast("long").alias("total"), F.lit(0).cast("long").alias("rank"), "subroot", "root", "path")
    for nodes in reversed(levels[1:-1]):
        outer = lowered(nodes, outer, shares, high)
    own = grouped(leaves, shares, high).select("share", "block", "tree", "total", "rank", "node", "forged", F.col("doc_id").cast("string").alias("key")).groupBy("share")
    shape = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out = own.cogroup(outward(outer, shares).groupBy("share")).applyInPandas(prover(high), shape)
    return out.withColumn("key", F.col("key").cast(docs.schema["doc_id"].dataType)).withColumnRenamed("key", "doc_id")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, folded after tampering."""
    return manifest(table(spark, sf_dir, "documents").select(*COLUMNS))
