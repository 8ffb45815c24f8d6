"""Operator 11, exact top-k search by distributed histogram selection.

Vectors become integers, and queries and candidates are packed into blocks. Every block of
queries meets every block of candidates of its length as one matrix product. In each round the
scores inside a query's open interval are counted in BINS bins, the counts are added over all
blocks, and the bin that holds the k-th score is the next interval, until it is one
value wide or no more than k scores lie at or above its lower end. A last pass keeps the scores from there up;
ties at the k-th value go to the smaller ids.

A task sends the counts from the highest bin down to where its own scores reach k: the global k-th
score is never below a task's own, so lower bins cannot hold it. Scores are made anew in
each round and never stored; what is shuffled is counts (k bins a query and task), then k rows a query and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memloom.llm.common import cut, salted_join, small_batches, table

#: Best scores of a query; steps of a component's unit; ids that are divisible by it are queries.
K, SCALE, EVERY = 10, 1024, 100
#: Bins of a round; queries and candidates in one block (of BLOCK_MB megabytes at most); blocks of queries that a task counts for at once.
BINS, ASKED, BLOCK, BLOCK_MB, HELD = 1024, 512, 4096, 4, 8
#: Megabytes of queries up to which their blocks are broadcast (candidates then stay where they are); lengths of vectors up to which a
#: count of each is; tasks that more are dealt over at most.
SENT_MB, LENGTHS, TASKS = 32, 10_000, 4096
#: Scores are held within this bound; integer products below EXACT are exact in doubles; the id that stands for none.
LARGEST, EXACT, NO_ID = (1 << 62) - 1, float(1 << 53), (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Not null, all components finite and not null."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def integers(vectors: list, dim: int) -> np.ndarray:
    """floor(SCALE * x) of all components, as doubles."""
    x = np.array(vectors, dtype=np.float64).reshape(len(vectors), dim)
    return np.floor(np.clip(x, -1e300, 1e300) * SCALE)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows: in doubles where every sum stays exact, else in Python's integers, held within LARGEST."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    exact = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object)
    return np.clip(exact(a) @ exact(b).T, -LARGEST, LARGEST).astype(np.int64)


def longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64)


def blocks_of(rows: DataFrame, most: int) -> DataFrame:
    """(block, dim, n, rows, ids, vectors, norm) from (row, key, v): up to `most` vectors of one length in a block, as bytes of
    longs and doubles; norm is the longest one's, null ids are NO_ID. Written, so that blocks keep their numbers."""

    def pack(dim: int, part: pd.DataFrame) -> dict:
        x = integers(part["v"].tolist(), dim)
        unit = max(1.0, float(np.abs(x).max(initial=0.0)))
        norm = unit * float(np.sqrt(np.square(x / unit).sum(axis=1).max(initial=0.0)))
        return {"dim": dim, "n": len(part), "rows": part["row"].to_numpy(np.int64).tobytes(), "ids": part["key"].to_numpy(np.int64).tobytes(), "vectors": x.tobytes(), "norm": norm}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, part in pdf.groupby("dim"):
                step = max(1, min(most, (BLOCK_MB << 20) // (8 * max(1, int(dim)))))
                yield pd.DataFrame([pack(int(dim), part[k : k + step]) for k in range(0, len(part), step)])

    flat = rows.select("row", F.coalesce("key", F.lit(NO_ID)).alias("key"), F.size("v").alias("dim"), "v")
    out = flat.mapInPandas(run, "dim int, n long, rows binary, ids binary, vectors binary, norm double")
    return cut(out.withColumn("block", F.monotonically_increasing_id()), "topk-blocks")


def met(asks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each block of queries with each block of candidates of its length: the queries' columns begin with q_."""
    per = asks.groupBy(F.col("q_dim").alias("of")).agg(F.count("*").alias("asks"))
    few = per.limit(LENGTHS + 1).count() <= LENGTHS
    blocks = blocks.join(F.broadcast(per), F.col("dim") == F.col("of")).drop("of") if few else salted_join(blocks, per, "dim", "of", F.col("block"), "inner")
    blocks = blocks.withColumn("at", F.explode(F.transform(F.sequence(F.lit(1), F.col("asks").cast("int")), lambda i: F.struct(F.col("dim").alias("dim"), i.alias("no")))))
    asks = asks.withColumn("q_at", F.struct(F.col("q_dim").alias("dim"), F.col("q_no").alias("no")))
    held = asks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("q_vectors")), F.lit(0)).alias("bytes")).first()
    if held.bytes <= SENT_MB << 20:
        return blocks.join(F.broadcast(asks), F.col("at") == F.col("q_at"))
    salts = max(1, min(blocks.select("block").distinct().count() // 4, TASKS // held.n))
    return salted_join(blocks, asks, "at", "q_at", F.col("block"), "inner", salts)


def counter(k: int) -> Callable:
    """Counts of the bins of each open query of a block, summed over the candidates that a task meets. A bin is sent if fewer than k
    of the task's own scores lie above it."""

    def told(held: dict) -> Iterator[pd.DataFrame]:
        for ask, total in held.items():
            down = total[:, ::-1]
            place, turn = np.nonzero((down > 0) & (np.cumsum(down, axis=1) - down < k))
            yield pd.DataFrame({"ask": ask, "place": place, "bin": BINS - 1 - turn, "n": down[place, turn]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for r in (r for frame in frames for r in frame.itertuples(index=False)):
            if r.q_block not in held:
                if len(held) == HELD:
                    yield from told(held)
                    held = {}
                held[r.q_block] = np.zeros((r.q_n, BINS), dtype=np.int64)
            open_ = np.flatnonzero(np.asarray(r.q_width) > 0)
            lo, width = (np.asarray(v)[open_][:, None] for v in (r.q_lo, r.q_width))
            q, c = (np.frombuffer(v, dtype=np.float64).reshape(n, r.dim) for v, n in ((r.q_vectors, r.q_n), (r.vectors, r.n)))
            s = scores(q[open_], c)
            own = longs(r.q_rows)[open_][:, None] == longs(r.rows)[None, :]
            i, j = np.nonzero((s >= lo) & (s - lo < width) & ~own)
            bins = (s[i, j] - lo[i, 0]) // ((width[i, 0] - 1) // BINS + 1)
            held[r.q_block][open_] += np.bincount(i * BINS + bins, minlength=len(open_) * BINS).reshape(len(open_), BINS)
        yield from told(held)

    return run


def keeper(k: int) -> Callable:
    """Scores at or above each query's lower end, of a task's candidates the k best by score and smaller id."""

    def best(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        order = np.lexsort((x["id"], -x["score"], x["q_row"]))
        x = {n: v[order] for n, v in x.items()}
        first = np.flatnonzero(np.r_[True, x["q_row"][1:] != x["q_row"][:-1]]) if len(order) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        return {n: v[place < k] for n, v in x.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, dict] = {}
        for r in (r for frame in frames for r in frame.itertuples(index=False)):
            q, c = (np.frombuffer(v, dtype=np.float64).reshape(n, r.dim) for v, n in ((r.q_vectors, r.q_n), (r.vectors, r.n)))
            s = scores(q, c)
            rows, ids = longs(r.q_rows), longs(r.ids)
            i, j = np.nonzero((s >= np.asarray(r.q_lo)[:, None]) & (rows[:, None] != longs(r.rows)[None, :]))
            new = best({"q_row": rows[i], "query": longs(r.q_ids)[i], "score": s[i, j], "id": ids[j]})
            if r.q_block in held:
                new = best({n: np.concatenate([held[r.q_block][n], v]) for n, v in new.items()})
            elif len(held) == HELD:
                yield from (pd.DataFrame(x) for x in held.values())
                held = {}
            held[r.q_block] = new
        yield from (pd.DataFrame(x) for x in held.values())

    return run


def narrowed(state: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """The next interval of each open query: the bin in which the counts from above reach k. An interval closes (width 0) once it is
    one value, or if exactly k scores lie at or above its lower end, or if there are fewer than k in all."""
    counts = counts.groupBy("ask", "place", "bin").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("cum", F.sum("n").over(W.partitionBy("ask", "place").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)))
    joined = state.filter("width > 0").join(counts, ["ask", "place"], "left")
    reached = F.col("above") + F.col("cum") >= k
    found = joined.groupBy("ask", "place", "lo", "width", "above").agg(F.max(F.when(reached, F.struct("bin", "n", "cum"))).alias("b"))
    step = F.expr(f"(width - 1) div {BINS} + 1")
    lo = F.col("lo") + F.col("b.bin") * step
    width = F.least(step, F.col("lo") + F.col("width") - lo)
    closed = F.col("b").isNull() | (width == 1) | (F.col("above") + F.col("b.cum") == k)
    new = found.select("ask", "place", F.coalesce(lo, F.col("lo")).alias("lo"), F.when(closed, 0).otherwise(width).cast("long").alias("width"), (F.col("above") + F.coalesce(F.col("b.cum") - F.col("b.n"), F.lit(0))).alias("above"))
    return cut(state.filter("width = 0").unionByName(new), "topk-state")


def search(vectors: DataFrame, asked: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k highest integer inner products of each row that is `asked`, over all rows but itself.

    Ties go to the smaller id, null ids last. Null vectors and those with null or non-finite components take no part;
    vectors meet those of their own length only (empty ones score 0). A query with fewer than k others gets all of them. Repeated
    ids are rows of their own: each is asked, and meets the others. asked reads the columns `key` and `v`; a null answer is no.
    An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    small_batches(vectors.sparkSession, BLOCK)
    rows = vectors.select(F.col(id_col).cast("long").alias("key"), F.col(vector_col).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "key", "v", F.coalesce(asked, F.lit(False)).alias("asked")), "topk-vectors")
    blocks = blocks_of(rows.drop("asked"), BLOCK)
    queries = rows.filter("asked")
    asks = blocks_of(queries.repartition(-(-max(1, queries.count()) // ASKED), "row"), ASKED)
    asks = asks.select(*(F.col(c).alias(f"q_{c}") for c in asks.columns), F.row_number().over(W.partitionBy("dim").orderBy("block")).alias("q_no"))
    longest = blocks.agg(F.coalesce(F.max("norm"), F.lit(0.0))).first()[0]
    most = F.col("q_norm") * longest * (1 + 1e-9)
    bound = F.when(most < 1e18, most.cast("long") + 1).otherwise(LARGEST)
    state = asks.select(F.col("q_block").alias("ask"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_n") - 1)).alias("place"), bound.alias("bound"))
    state = cut(state.select("ask", "place", (-F.col("bound")).alias("lo"), (2 * F.col("bound") + 1).alias("width"), F.lit(0).cast("long").alias("above")), "topk-state")

    def asking() -> DataFrame:
        """The pairs of blocks, with the interval of each query."""
        now = state.groupBy(F.col("ask").alias("of")).agg(F.sort_array(F.collect_list(F.struct("place", "lo", "width"))).alias("s"))  # ASKED at most
        now = now.select("of", F.col("s.lo").alias("q_lo"), F.col("s.width").alias("q_width"))
        return met(asks.join(now, F.col("q_block") == F.col("of")).drop("of"), blocks)

    columns = ["dim", "n", "rows", "ids", "vectors", "q_block", "q_n", "q_rows", "q_ids", "q_vectors", "q_lo", "q_width"]
    small_batches(vectors.sparkSession, 8)  # a row is a pair of blocks from here on
    while state.filter("width > 0").limit(1).count():
        state = narrowed(state, asking().select(*columns).mapInPandas(counter(k), "ask long, place long, bin long, n long"), k)
    found = asking().select(*columns).mapInPandas(keeper(k), "q_row long, query long, score long, id long")
    found = found.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id")))
    rank = F.row_number().over(W.partitionBy("q_row").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of each hundredth vector, among all others."""
    return search(table(spark, sf_dir, "embeddings"), F.col("key") % EVERY == 0)
