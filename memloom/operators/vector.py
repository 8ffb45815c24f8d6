"""Vector retrieval (V1-V6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.operators.ingest import first_by

#: Queries, and vectors, in one block; queries, and numbers in all of them, up to which they are one matrix on every task (32 MB).
QUERY_BLOCK, VECTOR_BLOCK, QUERIES, MATRIX = 512, 4096, 4096, 1 << 22
#: Shares of the vectors' blocks when queries are a table: so many copies of that table are shuffled, however many partitions the session has.
SHARES = 64
#: Vectors from which the cells of the approximate search are learned, passes over them, most cells.
SAMPLE, PASSES, CELLS = 8192, 8, 4096


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 if a norm is 0."""
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    d = lambda x: x.cast("array<double>")
    dot = add(F.zip_with(d(a), d(b), lambda x, y: x * y))
    norm = F.sqrt(add(F.transform(d(a), lambda x: x * x)) * add(F.transform(d(b), lambda x: x * x)))
    return F.when(norm == 0, 0.0).otherwise(dot / norm)


def matrix(rows: list, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit rows) of the vectors of one length that are not null and not zero; dim None: the first one's length."""
    at = [i for i, r in enumerate(rows) if r is not None and len(r) and (dim is None or len(r) == dim)]
    if dim is None and at:
        return matrix(rows, len(rows[at[0]]))
    if not at:
        return np.zeros(0, dtype=np.int64), np.zeros((0, dim or 0))
    x = np.array([rows[i] for i in at], dtype=np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    good = np.isfinite(norm) & (norm > 0)
    return np.array(at, dtype=np.int64)[good], x[good] / norm[good, None]


def nearest(x: np.ndarray, q: np.ndarray, k: int, threshold: float, owner: np.ndarray | None = None, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of q, score) of the k best rows of x for each row of q, and whatever ties with the last of them. owner: numbers of
    what rows of x belong to; then only an owner's best row counts. allowed: of which rows of x and q the pairs count."""
    near = x @ q.T
    if allowed is not None:
        near = np.where(allowed, near, -np.inf)
    if owner is not None:  # rows that are not the best of their owner lie below all others
        order = np.argsort(owner, kind="stable")
        first = np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1]])
        top = np.maximum.reduceat(near[order], first)
        best = np.empty_like(near)
        best[order] = np.repeat(top, np.diff(np.r_[first, len(order)]), axis=0)
        near = np.where(near >= best - 1e-9, near, -np.inf)
        last = np.partition(top, len(top) - k, axis=0)[len(top) - k] if len(top) > k else np.full(len(q), -np.inf)
    else:
        last = np.partition(near, len(x) - k, axis=0)[len(x) - k] if len(x) > k else np.full(len(q), -np.inf)
    i, j = np.nonzero(near >= np.maximum(last, threshold) - 1e-9)
    score = np.einsum("ij,ij->i", x[i], q[j])  # each pair by itself: equal vectors have equal scores
    keep = score >= threshold
    return i[keep], j[keep], score[keep]


def ranked(scored: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def numbered(ids: list) -> np.ndarray:
    """A number for each different id."""
    known: dict = {}
    return np.array([known.setdefault(i, len(known)) for i in ids], dtype=np.int64)


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, threshold: float = 0.2, each_once: bool = False) -> DataFrame:
    """V1. (query_id, id, score, rank): the k nearest by cosine at or above threshold; ties by id. queries (query_id, qv)
    are compared with every vector (id, v) by matrix products; each batch of vectors keeps its best k for each query
    before the shuffle. Vectors of another dimension, null ones and zero norms do not match. each_once: ids have several vectors, and an
    id's best one counts. Up to QUERIES queries of MATRIX numbers are broadcast to the tasks as one matrix, once their number and
    lengths are known; more are a table of blocks, which goes to every share of the vectors' blocks."""
    asked = queries.select("query_id", "qv")
    shape = T.StructType([asked.schema["query_id"], corpus.schema["id"]]).add("score", "double")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("qv")), F.lit(0)).alias("numbers")).first()

    def once(scored: DataFrame) -> DataFrame:
        if each_once:
            scored = scored.groupBy("query_id", "id").agg(F.max("score").alias("score"))
        return ranked(scored, k)

    if size.n <= QUERIES and size.numbers <= MATRIX:
        few = asked.toArrow()
        ids, qv = few.column("query_id").combine_chunks(), few.column("qv").to_pylist()
        known = queries.sparkSession.sparkContext.broadcast([(dim, *matrix(qv, dim)) for dim in sorted({len(v) for v in qv if v})])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = b.column(1).to_pylist()
                owner = numbered(b.column(0).to_pylist()) if each_once else None
                for dim, at, q in known.value:
                    place, x = matrix(rows, dim)
                    for s in range(0, len(q) if len(x) else 0, QUERY_BLOCK):  # scores of a part of the queries at a time
                        i, j, score = nearest(x, q[s : s + QUERY_BLOCK], k, threshold, owner[place] if each_once else None)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[s + j])), b.column(0).take(pa.array(place[i])), pa.array(score)], shape.names)

        return once(corpus.select("id", "v").mapInArrow(best, shape))
    block = F.floor(F.monotonically_increasing_id() % (1 << 33) / QUERY_BLOCK).alias("block")
    own = asked.filter(F.size("qv") > 0).select(F.spark_partition_id().alias("part"), block, F.size("qv").alias("dim"), "query_id", "qv")
    blocks = own.groupBy("part", "block", "dim").agg(F.collect_list(F.struct("query_id", "qv")).alias("qs"))  # QUERY_BLOCK at most
    place = F.floor(F.monotonically_increasing_id() % (1 << 33) / VECTOR_BLOCK).alias("block")
    vectors = corpus.filter(F.size("v") > 0).select(F.spark_partition_id().alias("part"), place, F.size("v").alias("dim"), "id", "v")
    vectors = vectors.groupBy("part", "block", "dim").agg(F.collect_list(F.struct("id", "v")).alias("vs"))  # VECTOR_BLOCK at most
    vectors = vectors.withColumn("share", F.pmod(F.xxhash64("part", "block"), F.lit(SHARES)).cast("int"))
    blocks = blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).select("dim", "share", "qs")
    met = vectors.select("dim", "share", "vs").join(blocks.hint("merge"), ["dim", "share"]).select("vs", "qs")  # all copies are no broadcast

    def blockwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for vs, qs in zip(b.column(0), b.column(1), strict=True):
                (place, x), (at, q) = matrix(vs.values.field("v").to_pylist()), matrix(qs.values.field("qv").to_pylist())
                if len(x) and len(q):
                    owner = numbered(vs.values.field("id").to_pylist())[place] if each_once else None
                    i, j, score = nearest(x, q, k, threshold, owner)
                    yield pa.RecordBatch.from_arrays([qs.values.field("query_id").take(pa.array(at[j])), vs.values.field("id").take(pa.array(place[i])), pa.array(score)], shape.names)

    return once(met.mapInArrow(blockwise, shape))


def cells_of(corpus: DataFrame, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centres of cells, from a bounded sample by a hash of the id: a few passes of k-means by cosine."""
    rows = corpus.filter(F.size("v") > 0).orderBy(F.xxhash64("id", F.lit(seed))).limit(SAMPLE).toArrow().column("v").to_pylist()
    _, x = matrix(rows)
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(cells, len(x)), replace=False)] if len(x) else x
    for _ in range(PASSES):
        own = np.argmax(x @ centre.T, axis=1) if len(x) else np.zeros(0, dtype=int)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.maximum(norm, 1e-12), centre)
    return centre


def vector_topk_ann(queries: DataFrame, corpus: DataFrame, k: int, threshold: float = 0.2, cells: int = 64, probes: int = 24) -> DataFrame:
    """V2. Approximate V1: every vector lies in the cell of its nearest centre, a query asks the nearest `probes` cells, and
    what it meets there is ranked exactly. The centres are learned from SAMPLE vectors at most, all vectors are indexed.
    Vectors of another length than the sample's first, null and zero ones do not match. A cell's vectors and queries meet as
    blocks by matrix products, each block with its best k only; blocks are dealt (salted), so a crowded cell is no single task."""
    centre = cells_of(corpus, min(cells, CELLS))
    dim = centre.shape[1] if len(centre) else 0

    def routed(most: int, key: str, column: str, df: DataFrame) -> DataFrame:
        shape = T.StructType([df.schema[key]]).add("u", T.ArrayType(T.DoubleType())).add("cell", T.IntegerType())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, x = matrix(b.column(1).to_pylist(), dim)
                if len(x):
                    cell = np.argsort(-(x @ centre.T), axis=1, kind="stable")[:, :most]
                    row = np.repeat(np.arange(len(x)), cell.shape[1])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[row])), pa.array(list(x[row]), pa.list_(pa.float64())), pa.array(cell.ravel().astype(np.int32))], shape.names)

        return df.select(key, column).mapInArrow(run, shape)

    def blocks(df: DataFrame, size: int, key: str, name: str) -> DataFrame:
        block = F.floor(F.monotonically_increasing_id() % (1 << 33) / size).alias("block")
        return df.select(F.spark_partition_id().alias("part"), block, "cell", key, "u").groupBy("part", "block", "cell").agg(F.collect_list(F.struct(key, "u")).alias(name))

    right = blocks(routed(1, "id", "v", corpus), 8 * VECTOR_BLOCK, "id", "vs").withColumn("deal", F.pmod(F.xxhash64("part", "block"), F.lit(8)).cast("int"))
    left = blocks(routed(probes, "query_id", "qv", queries), 8 * QUERY_BLOCK, "query_id", "qs").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(7))))
    shape = T.StructType([queries.schema["query_id"], corpus.schema["id"]]).add("score", "double")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for vs, qs in zip(b.column(0), b.column(1), strict=True):
                x, q = (r.values.field("u").flatten().to_numpy().reshape(-1, dim) for r in (vs, qs))
                i, j, score = nearest(x, q, k, threshold)
                yield pa.RecordBatch.from_arrays([qs.values.field("query_id").take(pa.array(j)), vs.values.field("id").take(pa.array(i)), pa.array(score)], shape.names)

    pairs = right.select("cell", "deal", "vs").join(left.select("cell", "deal", "qs").hint("merge"), ["cell", "deal"]).select("vs", "qs")
    return ranked(pairs.mapInArrow(met, shape), k)


def drop_incident(vectors: DataFrame, names: DataFrame) -> DataFrame:
    """V3. Relation vectors (src, tgt, ...) that touch none of the names."""
    out = vectors.join(names.select(F.col("name").alias("src")), "src", "left_anti")
    return out.join(names.select(F.col("name").alias("tgt")), "tgt", "left_anti")


def vectors_by_ids(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """V4."""
    return vectors.join(ids.select("id"), "id", "left_semi")


def pick_by_vector(queries: DataFrame, candidates: DataFrame, vectors: DataFrame, most: int) -> DataFrame:
    """V5. (query_id, chunk_id, rank): unique candidate chunks (query_id, owner, chunk_id) by cosine to the query;
    as many as half of most times the owners; a query with a candidate without vector gets none."""
    size = candidates.groupBy("query_id").agg(F.floor(F.lit(most) * F.count_distinct("owner") / 2).alias("quota"))
    met = candidates.select("query_id", "chunk_id").distinct().join(vectors.select(F.col("id").alias("chunk_id"), "v"), "chunk_id", "left").join(queries, "query_id")
    lost = met.filter("v is null").select("query_id").distinct()
    met = met.join(lost, "query_id", "left_anti").withColumn("score", cosine(F.col("qv"), F.col("v")))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return met.withColumn("rank", F.row_number().over(w)).join(size, "query_id").filter(F.col("rank") <= F.col("quota")).select("query_id", "chunk_id", "rank")


def pick_by_weight(pool: DataFrame, most: int, least: int = 1) -> DataFrame:
    """V6. (query_id, owner, chunk_id, turn): quota falls linearly from most to least by the owner's place (banker's
    rounding); what earlier owners leave unused goes to later chunks, earliest owners first. pool: (query_id, owner, place, pos, chunk_id), place and pos from 0."""
    own = W.partitionBy("query_id")
    owners = F.max("place").over(own) + 1
    ratio = F.col("place") / F.greatest(owners - 1, F.lit(1))
    quota = F.when(owners == 1, F.lit(most)).otherwise(F.bround(F.lit(float(most)) - ratio * (most - least)).cast("int"))
    rows = pool.withColumn("quota", F.greatest(quota, F.lit(0)))
    rows = rows.withColumn("first", F.col("pos") < F.col("quota"))
    size = F.count("*").over(W.partitionBy("query_id", "owner"))
    rows = rows.withColumn("short", F.when(F.col("pos") == 0, F.greatest(F.col("quota") - size, F.lit(0))).otherwise(0))
    spare = F.sum("short").over(own)
    rows = rows.withColumn("spare", spare).withColumn("extra", F.sum((~F.col("first")).cast("int")).over(own.orderBy("place", "pos").rowsBetween(W.unboundedPreceding, 0)))
    keep = rows.filter((F.lit(most) > 0) & (F.col("first") | (F.col("extra") <= F.col("spare"))))
    w = own.orderBy(F.desc("first"), "place", "pos")
    return keep.withColumn("turn", F.row_number().over(w)).select("query_id", "owner", "chunk_id", "turn")


def best_per_owner(scored: DataFrame) -> DataFrame:
    """The best row of each (query_id, owner)."""
    return first_by(scored.withColumn("_s", -F.col("score")), ["query_id", "owner"], ["_s", "id"]).drop("_s")
