"""Operator 7, embedding near-dedup by a random-projection tree forest.

Trees are fitted on a bounded sample: a node splits at the median of its vectors'
projections on a random direction. Below the sample's leaves further random
directions split at the leaf's centroid, as deep as the number of vectors asks.
Every vector goes down every tree, to both sides where it is close to a border
(spill). Vectors that share a leaf are compared; each linked pair is counted in the
first leaf that it shares only, and leaves emit counts and stars, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.common import cut, salted_join, small_batches, table
from memloom.llm.links import components

COSINE = 0.9
#: Trees up to depth SHALLOW (one more for each level below), vectors of the sample, wanted vectors in a leaf, distance to a border
#: that goes both ways. Of 300 random pairs at cosine 0.9 in 64 dimensions 8 trees join 1.00 at depth 7, 0.97 at 14 (10^7
#: vectors), 0.93 at 17 and 0.89 at 20 (6 * 10^8); a tree misses a pair with a chance of 0.65, 0.72 and 0.76 there, so
#: one more tree a level keeps the recall at 0.98.
TREES, SHALLOW, SAMPLE, LEAF, SPILL = 8, 13, 8192, 600, 0.015
#: Lengths of vectors that get trees, the most frequent ones (others are compared block by block, exactly), and numbers in all samples.
LENGTHS, NUMBERS = 64, 1 << 22
#: Sample vectors at which a fitted node stops; rows that one task compares at once.
LEAST_SAMPLE, BLOCK = 16, 2000


def valid(vector: Column) -> Column:
    """Neither null nor empty nor zero, all components finite and not null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def direction(dim: int, *seed: int) -> np.ndarray:
    w = np.random.default_rng([20_240_501, *seed]).standard_normal(dim)
    return w / np.linalg.norm(w)


def fit_tree(x: np.ndarray, tree: int, depth: int) -> dict:
    """Nested nodes over sample rows: {level, at, low, high}, or {level, centre, id} at the sample's end."""
    count = 0

    def grow(rows: np.ndarray, level: int, path: int) -> dict:
        nonlocal count
        if level < depth and len(rows) >= 2 * LEAST_SAMPLE:
            along = x[rows] @ direction(x.shape[1], tree, level, path)
            at = float(np.median(along))
            low, high = rows[along <= at], rows[along > at]
            if len(low) and len(high):
                return {"seed": (tree, level, path), "at": at, "low": grow(low, level + 1, 2 * path), "high": grow(high, level + 1, 2 * path + 1)}
        count += 1
        return {"centre": x[rows].mean(axis=0) if len(rows) else np.zeros(x.shape[1]), "id": count, "level": level}

    return grow(np.arange(len(x)), 0, 1)


def route(x: np.ndarray, trees: list[dict], depth: int) -> list[list[int]]:
    """Leaf ids (tree in the high bits) of each row of unit vectors."""
    out: list[list[int]] = [[] for _ in range(len(x))]
    dim = x.shape[1]

    def sides(rows: np.ndarray, w: np.ndarray, at: float) -> tuple[np.ndarray, np.ndarray]:
        along = x[rows] @ w - at
        return rows[along <= SPILL], rows[along > -SPILL]

    for t, root in enumerate(trees):
        todo = [(root, np.arange(len(x)), 0, 0)]
        while todo:
            node, rows, level, path = todo.pop()
            if not len(rows):
                continue
            if "seed" in node:
                low, high = sides(rows, direction(dim, *node["seed"]), node["at"])
                todo += [(node["low"], low, level + 1, 0), (node["high"], high, level + 1, 0)]
            elif level < depth:
                w = direction(dim, t, level, 0)
                low, high = sides(rows, w, float(node["centre"] @ w))
                todo += [(node, low, level + 1, 2 * path), (node, high, level + 1, 2 * path + 1)]
            else:
                leaf = (t << 56) | (node["id"] << 36) | path
                for r in rows.tolist():
                    out[r].append(leaf)
    return out


def compare(a: pd.DataFrame, b: pd.DataFrame | None, leaf: int, least: float) -> tuple[np.ndarray, list, list]:
    """Linked rows of a with b (None: a itself): (pairs, counts of a, counts of b), each pair counted
    only if this is the smallest leaf that both have."""
    right = a if b is None else b
    hits = unit(a["v"]) @ unit(right["v"]).T >= least
    if b is None:
        hits = np.triu(hits, 1)
    pairs = np.argwhere(hits)
    n_a, n_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(right), dtype=np.int64)
    width = max(max(map(len, a["codes"])), max(map(len, right["codes"])))
    padded = lambda codes, fill: np.array([[*c, *[fill] * (width - len(c))] for c in codes], dtype=np.int64)
    ca, cb = padded(a["codes"], -1), padded(right["codes"], -2)
    wa, wb = a["n"].to_numpy(), right["n"].to_numpy()
    for k in range(0, len(pairs), 20_000):
        i, j = pairs[k : k + 20_000].T
        shared = (ca[i][:, :, None] == cb[j][:, None, :]).any(axis=2)
        first = np.where(shared, ca[i], np.iinfo(np.int64).max).min(axis=1) == leaf
        np.add.at(n_a, i[first], wb[j[first]])
        np.add.at(n_b, j[first], wa[i[first]])
    return pairs, n_a, n_b


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) of each row.

    Invalid vectors (see `valid`) link with nothing and are their own component; vectors of
    different length do not link. Equal vectors are one node with its number of rows, so copies
    are not paired. Repeated ids give a row each, null ones too; component_id is the smallest id reachable. An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("key"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("twin", F.when(valid(F.col("v")), F.struct(F.xxhash64("v").alias("p"), F.xxhash64(F.lit(7), "v").alias("q"), F.size("v").alias("dim"))))
    rows = cut(rows, "vectors")
    nodes = rows.filter("twin is not null").groupBy("twin").agg(F.min("row").alias("node"), F.min("key").alias("least_key"), F.count("*").alias("n"), F.first("v").alias("v"))
    nodes = cut(nodes, "vector-nodes")
    spark = vectors.sparkSession
    forests = {}
    lengths = nodes.groupBy("twin.dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()
    for dim, total in lengths:
        most = min(SAMPLE, max(64, NUMBERS // (dim * len(lengths))))
        sample = [r.v for r in nodes.filter(F.col("twin.dim") == dim).orderBy(F.col("twin.p"), F.col("twin.q")).select("v").limit(most).collect()]
        depth = max(0, math.ceil(math.log2(total / LEAF)))
        x = unit(sample)
        forests[dim] = ([fit_tree(x, t, depth) for t in range(TREES + max(0, depth - SHALLOW))], depth)
    shared = spark.sparkContext.broadcast(forests)

    def routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, part in pdf.groupby("dim"):
                trees, depth = shared.value.get(dim, ([], 0))
                codes = route(unit(part["v"]), trees, depth) if trees else [[0] for _ in range(len(part))]
                yield part.assign(codes=codes)[["node", "n", "dim", "v", "codes"]]

    shape = f"node long, n long, dim int, v {nodes.schema['v'].dataType.simpleString()}, codes array<long>"
    placed = cut(nodes.select("node", "n", "twin.dim", "v").mapInPandas(routed, shape), "leaves")
    leaf_rows = placed.select("node", "n", "dim", "v", "codes", F.explode("codes").alias("leaf"))
    sizes = leaf_rows.groupBy("dim", "leaf").agg(F.count("*").alias("m")).filter("m > 1")
    sizes = sizes.select(F.struct("dim", "leaf").alias("of"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    member = salted_join(leaf_rows.withColumn("at", F.struct("dim", "leaf")), sizes, "at", "of", F.col("node"), "inner")
    # a leaf above BLOCK rows is compared block by block: row of block i meets block j in task (i, j)
    member = member.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        i, j, leaf = int(pdf["i"][0]), int(pdf["j"][0]), int(pdf["leaf"][0])
        if i == j:
            pairs, n_a, _n = compare(pdf, None, leaf, least)
            left = right = pdf["node"].to_numpy()
            counts = pd.concat([pd.Series(n_a + _n, index=left)])
        else:
            a, b = pdf[pdf["block"] == i], pdf[pdf["block"] == j]
            if not len(a) or not len(b):
                return pd.DataFrame({"a": [], "b": [], "links": []}, dtype="int64")
            pairs, n_a, n_b = compare(a, b, leaf, least)
            left, right = a["node"].to_numpy(), b["node"].to_numpy()
            counts = pd.concat([pd.Series(n_a, index=left), pd.Series(n_b, index=right)])
        # labels inside the leaf: each linked node with the smallest that the leaf's links reach
        label = {n: n for n in counts.index}
        u, w = left[pairs[:, 0]], right[pairs[:, 1]]
        known = np.array(sorted(label))
        lab, iu, iw = known.copy(), np.searchsorted(known, u), np.searchsorted(known, w)
        while True:
            new = lab.copy()
            np.minimum.at(new, iu, lab[iw])
            np.minimum.at(new, iw, lab[iu])
            new = new[np.searchsorted(known, new)]
            if (new == lab).all():
                break
            lab = new
        out = pd.DataFrame({"a": counts.index, "links": counts.to_numpy()})
        out["b"] = lab[np.searchsorted(known, out["a"])]
        return out[(out["links"] > 0) | (out["a"] != out["b"])][["a", "b", "links"]]

    found = cut(member.select("node", "n", "v", "codes", "leaf", "dim", "block", "i", "j").groupBy("dim", "leaf", "i", "j").applyInPandas(compared, "a long, b long, links long"), "leaf-links")
    parts = components(found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    whole = nodes.join(links, F.col("node") == F.col("a"), "left").drop("a").join(parts.withColumnRenamed("node", "p"), F.col("node") == F.col("p"), "left")
    whole = whole.select("twin", "least_key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("part"))
    smallest = whole.groupBy("part").agg(F.min("least_key").alias("component_id")).withColumnRenamed("part", "of")
    named = salted_join(whole, smallest, "part", "of", F.col("twin")).select(F.col("twin").alias("its"), "n_links", "component_id")
    out = salted_join(rows.select("row", "key", "twin"), named, "twin", "its", F.col("row"))
    out = out.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")).withColumn("component_id", F.when(F.col("twin").isNull(), F.col("key")).otherwise(F.col("component_id")))
    return out.select(F.col("key").alias(id_col), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors at a cosine of 0.9 or more, and their components."""
    small_batches(spark, 4096)
    return near_duplicates(table(spark, sf_dir, "embeddings"))
