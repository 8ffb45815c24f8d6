"""A stored index of vectors (V2): cells in two levels that grow with the rows, inverted lists on disk, additions and deletions.

Each of the commonest lengths has `top` cells, whose centres are learned from a bounded sample, and inside each of them cells whose centres
are learned from a bounded sample of its own vectors, cell by cell over the cluster. Every vector is in the list of its cell. A query
asks the cells that are nearest to it, as many as a calibration against exact search found to be needed for the wanted recall.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.operators.merge import top_ranked
from memloom.operators.vector import QUERY_BLOCK, matrix, nearest, ranked, vector_topk
from memloom.sources.tables import write_through

#: Vectors that a cell should hold; most top cells of a length, and lengths with cells (the commonest; a rarer length is one cell).
CELL, TOPS, LENGTHS = 32, 512, 64
#: Vectors that centres are learned from, of a length and of a top cell; rows that are compared with a cell's centres in one group.
SAMPLE, INNER, GROUP = 8192, 16_384, 50_000
#: Queries that the calibration asks, and passes of k-means.
ASKED, PASSES = 64, 8


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centres by cosine."""
    rng = np.random.default_rng(11)
    centre = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(PASSES if len(centre) > 1 else 1):
        own = np.argmax(x @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.maximum(norm, 1e-12), centre)
    return centre


def units(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, dim, u): rows that are not null, not zero and finite, as unit vectors."""
    shape = T.StructType([rows.schema[key]]).add("dim", "integer").add("u", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(1).to_pylist()
            for dim in sorted({len(v) for v in vectors if v}):
                at, x = matrix(vectors, dim)
                if len(x):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.full(len(x), dim, dtype=np.int32)), pa.array(list(x), pa.list_(pa.float64()))], shape.names)

    return rows.select(key, vector).mapInArrow(run, shape)


class VectorIndex:
    """An index in a folder of the shared store: `centres` (dim, top, cell, centre), `lists` (id, u, dim, cell, batch, top), `gone` (id,
    batch), and the plan of lengths and probes. Batches are numbered by the caller: one that comes again replaces its own rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = {r.name: r.value for r in spark.read.parquet(f"{path}/plan").collect()}
        self.plan = {int(d): p for d, p in json.loads(rows["lengths"]).items()}  # length: (top cells, cells in each)
        self.probes = {int(d): p for d, p in json.loads(rows["probes"]).items()}
        tops = spark.read.parquet(f"{path}/tops").collect()  # LENGTHS * TOPS at most
        self.tops = {d: np.array([r.centre for r in sorted((r for r in tops if r.dim == d), key=lambda r: r.top)]) for d in self.plan}

    @classmethod
    def build(cls, corpus: DataFrame, path: str, k: int = 10, recall: float = 0.95, cell_rows: int = CELL) -> VectorIndex:
        """An index of corpus (id, v). Null, zero and non-finite vectors are left out. `recall` is that of the k nearest at calibration."""
        spark = corpus.sparkSession
        rows = write_through(units(corpus, "id", "v"), "index-units")
        counts = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()
        plan = {}
        for dim, n in ((r["dim"], r["count"]) for r in counts):
            cells = max(1, n // cell_rows)
            top = min(TOPS, cells if cells <= 64 else math.ceil(math.sqrt(cells)))
            plan[dim] = (top, math.ceil(cells / top))
        spread = F.xxhash64("id", F.lit(7))
        some = top_ranked(rows.filter(F.col("dim").isin(list(plan))), "dim", [spread, F.col("id")], SAMPLE, "id")

        def learned(pdf: pd.DataFrame) -> pd.DataFrame:
            dim = int(pdf["dim"].iloc[0])
            centre = k_means(np.stack(pdf["u"]), plan[dim][0])
            return pd.DataFrame({"dim": dim, "top": range(len(centre)), "centre": list(centre)})

        tops = some.select("dim", "u").groupBy("dim").applyInPandas(learned, "dim int, top int, centre array<double>")
        tops.write.mode("overwrite").parquet(f"{path}/tops")
        spark.createDataFrame([("lengths", json.dumps(plan)), ("probes", "{}")], "name string, value string").write.mode("overwrite").parquet(f"{path}/plan")
        index = cls(spark, path)
        placed = write_through(index._tops(rows, "id", 1), "index-tops")
        deep = [d for d in plan if plan[d][1] > 1]
        some = top_ranked(placed.filter(F.col("dim").isin(deep)).withColumn("of", F.struct("dim", "top")), "of", [spread, F.col("id")], INNER, "id")

        def inner(pdf: pd.DataFrame) -> pd.DataFrame:
            centre = k_means(np.stack(pdf["u"]), plan[int(pdf["dim"].iloc[0])][1])
            return pd.DataFrame({"dim": pdf["dim"].iloc[0], "top": pdf["top"].iloc[0], "cell": range(len(centre)), "centre": list(centre)})

        shape = "dim int, top int, cell int, centre array<double>"
        below = some.select("dim", "top", "u").groupBy("dim", "top").applyInPandas(inner, shape)
        own = spark.read.parquet(f"{path}/tops").filter(~F.col("dim").isin(deep)).select("dim", "top", F.lit(0).alias("cell"), "centre")
        below.unionByName(own).write.mode("overwrite").parquet(f"{path}/centres")
        index._put(placed, 0)
        index._calibrate(rows, k, recall)
        return cls(spark, path)

    def _tops(self, rows: DataFrame, key: str, most: int) -> DataFrame:
        """rows (key, dim, u) with the `most` nearest top cells, a row each, and the cosine to each; a length without cells has one, -1."""
        shape = T.StructType([rows.schema[key], rows.schema["dim"], rows.schema["u"]]).add("top", "integer").add("near", "double")
        tops = self.spark.sparkContext.broadcast(self.tops)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for dim, part in pdf.groupby("dim"):
                    centre = tops.value.get(dim)
                    if centre is None or not len(centre):
                        yield part.assign(top=-1, near=1.0)
                        continue
                    near = np.stack(part["u"]) @ centre.T
                    order = np.argsort(-near, axis=1, kind="stable")[:, :most]
                    at = np.repeat(np.arange(len(part)), order.shape[1])
                    yield part.iloc[at].assign(top=order.ravel(), near=near[at, order.ravel()])

        return rows.select(key, "dim", "u").mapInPandas(run, shape)

    def _cells(self, placed: DataFrame, key: str, all_cells: bool, packed: bool = False) -> DataFrame:
        """placed (key, dim, u, top, near) with the nearest cell of its top cell (or all of them, a row each) and the cosine to it. Rows meet
        the centres of their top cell in groups of GROUP at most, however many there are. packed: (key, dim, top, cosines), the cosines to all
        cells of the top cell in one row, without the vector."""
        flat = [d for d, (_, inner) in self.plan.items() if inner == 1]
        one = placed.filter((F.col("top") == -1) | F.col("dim").isin(flat)).withColumn("cell", F.lit(0))
        rest = placed.filter((F.col("top") != -1) & ~F.col("dim").isin(flat))
        shape = T.StructType(list(placed.schema)).add("cell", "integer")
        if packed:
            one = one.select(key, "dim", "top", F.array("near").alias("cosines"))
            shape = T.StructType([placed.schema[key], placed.schema["dim"], placed.schema["top"]]).add("cosines", T.ArrayType(T.DoubleType()))
        if not any(inner > 1 for _, inner in self.plan.values()):
            return one.select(*shape.names)
        size = rest.groupBy("dim", "top").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("deals"))
        centres = self.spark.read.parquet(f"{self.path}/centres").join(size.select("dim", "top", F.col("deals").alias("times")), ["dim", "top"])
        centres = centres.select("dim", "top", "cell", "centre", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("deal"))
        rest = rest.join(size, ["dim", "top"]).withColumn("deal", F.pmod(F.xxhash64(key), F.col("deals")).cast("int")).select(key, "dim", "u", "top", "near", "deal")

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({n: [] for n in shape.names})
            right = right.sort_values("cell")
            near = np.stack(left["u"]) @ np.stack(right["centre"]).T
            cells = right["cell"].to_numpy()
            if packed:
                return pd.DataFrame({key: left[key].to_numpy(), "dim": left["dim"].to_numpy(), "top": left["top"].to_numpy(), "cosines": list(near)})
            if not all_cells:
                best = np.argmax(near, axis=1)
                return left.assign(cell=cells[best], near=near[np.arange(len(left)), best])[shape.names]
            at = np.repeat(np.arange(len(left)), len(cells))
            return left.iloc[at].assign(cell=np.tile(cells, len(left)), near=near.ravel())[shape.names]

        met = rest.groupBy("dim", "top", "deal").cogroup(centres.groupBy("dim", "top", "deal")).applyInPandas(run, shape)
        return one.select(*shape.names).unionByName(met)

    def _put(self, placed: DataFrame, batch: int) -> None:
        lists = self._cells(placed, "id", all_cells=False).select("id", "u", "dim", "cell", "top")
        lists.repartition("dim", "top", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("dim", "top", "cell").write.mode("overwrite").partitionBy("top").parquet(f"{self.path}/lists/batch={batch}")

    def add(self, corpus: DataFrame, batch: int) -> None:
        """Puts more vectors (id, v) into the lists of their cells; batch: a number from 1, larger than those before. An id that is
        there already counts as the new one."""
        self._put(self._tops(write_through(units(corpus, "id", "v"), "index-units"), "id", 1), batch)

    def delete(self, ids: DataFrame, batch: int) -> None:
        """Takes ids (id) out, up to this batch."""
        ids.select("id").write.mode("overwrite").parquet(f"{self.path}/gone/batch={batch}")

    def lists(self) -> DataFrame:
        """(id, u, dim, top, cell): the latest vector of each id that is not deleted."""
        rows = self.spark.read.parquet(f"{self.path}/lists")
        more = self.spark.read.parquet(f"{self.path}/lists").filter("batch > 0").groupBy("id").agg(F.max("batch").alias("_latest"))
        rows = rows.join(more, "id", "left").filter(F.col("_latest").isNull() | (F.col("batch") == F.col("_latest"))).drop("_latest")
        try:
            gone = self.spark.read.parquet(f"{self.path}/gone").groupBy("id").agg(F.max("batch").alias("_gone"))
        except Exception as e:  # nothing was deleted yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return rows
        return rows.join(gone, "id", "left").filter(F.col("_gone").isNull() | (F.col("batch") > F.col("_gone"))).drop("_gone")

    def _considered(self, rows: DataFrame, probes: dict[int, int]) -> DataFrame:
        """Queries (query_id, dim, u) with the top cells that are considered for them, a row each."""
        most = max([1, *(min(t, math.ceil(4 * probes.get(d, t * i) / i)) for d, (t, i) in self.plan.items())])
        return self._tops(rows, "query_id", most)

    def asked(self, queries: DataFrame, probes: dict[int, int]) -> DataFrame:
        """(query_id, u, dim, top, cell, rank): the cells that each query (query_id, qv) asks, nearest first. Of a length with cells in
        cells, those of the nearest top cells are considered, four times as many as the probes fill."""
        near = self._cells(self._considered(units(queries, "query_id", "qv"), probes), "query_id", all_cells=True)
        found = top_ranked(near.withColumn("of", F.struct("query_id", "dim")), "of", [F.desc("near"), F.col("top"), F.col("cell")], 1 << 30, "cell")
        limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for d, p in probes.items() for x in (d, p))), F.col("dim")), F.lit(1 << 30)) if probes else F.lit(1 << 30)
        return found.filter(F.col("n") <= limit).select("query_id", "u", "dim", "top", "cell", F.col("n").alias("rank"))

    def _chosen(self, rows: DataFrame) -> DataFrame:
        """(query_id, dim, top, cells): the cells that queries (query_id, dim, u) ask, in the order of `asked`, a row for each top cell of a
        query: what is shuffled are packed numbers, not a row with its vector for each cell."""
        near = self._cells(self._considered(rows, self.probes), "query_id", all_cells=True, packed=True)
        shape = T.StructType([rows.schema["query_id"], rows.schema["dim"]]).add("top", "integer").add("cells", T.ArrayType(T.IntegerType()))
        probes = self.probes

        def choose(frame: pd.DataFrame) -> pd.DataFrame:
            tops, cosines = frame["top"].to_numpy(), frame["cosines"].tolist()
            size = [len(c) for c in cosines]
            top, cell, cosine = np.repeat(tops, size), np.concatenate([np.arange(n) for n in size]), np.concatenate(cosines)
            first = np.lexsort((cell, top, -cosine))[: probes.get(int(frame["dim"].iloc[0]), 1 << 30)]
            top, cell = top[first], cell[first]
            each = np.unique(top)
            return pd.DataFrame({"query_id": [frame["query_id"].iloc[0]] * len(each), "dim": frame["dim"].iloc[0], "top": each, "cells": [cell[top == t].astype(np.int32) for t in each]})

        return near.groupBy("query_id", "dim").applyInPandas(choose, shape)

    def _met(self, queries: DataFrame, work: Callable[[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray], Iterator[dict]], shape: T.StructType) -> DataFrame:
        """What `work` makes of the vectors of a top cell, the queries that ask it as a matrix, and which of the pairs lie in cells that
        are asked. Vectors and queries meet in groups of GROUP at most, of which QUERY_BLOCK queries are a matrix."""
        rows = write_through(units(queries, "query_id", "qv"), "index-queries")
        lists = self.lists()
        size = lists.groupBy("dim", "top").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("deals"))
        turns = max(1, math.ceil(rows.count() / GROUP))
        lists = lists.join(size, ["dim", "top"]).withColumn("deal", F.pmod(F.xxhash64("id"), F.col("deals")).cast("int"))
        lists = lists.select("id", "u", "dim", "top", "cell", "deal", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
        asked = self._chosen(rows).join(rows.hint("merge"), ["query_id", "dim"]).join(size, ["dim", "top"])
        asked = asked.withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int")).select("query_id", "u", "cells", "dim", "top", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), "turn")

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(left) and len(right):
                cell = left["cell"].to_numpy()
                x = np.stack(left["u"])
                for s in range(0, len(right), QUERY_BLOCK):
                    part = right.iloc[s : s + QUERY_BLOCK]
                    asks = np.zeros((int(cell.max()) + 1, len(part)), dtype=bool)
                    for j, cells in enumerate(part["cells"]):
                        cells = np.asarray(cells)
                        asks[cells[cells < len(asks)], j] = True
                    out += [pd.DataFrame(r) for r in work(left, x, part, asks[cell])]
            return pd.concat(out) if out else pd.DataFrame({n: [] for n in shape.names})

        key = ["dim", "top", "deal", "turn"]
        return lists.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(run, shape)

    def search(self, queries: DataFrame, k: int, threshold: float = 0.2) -> DataFrame:
        """(query_id, id, score, rank): the k best by cosine among what a query's cells hold; ties by id. Each group of vectors sends
        its k best of a query."""

        def best(left: pd.DataFrame, x: np.ndarray, part: pd.DataFrame, allowed: np.ndarray) -> Iterator[dict]:
            i, j, score = nearest(x, np.stack(part["u"]), k, threshold, allowed=allowed)
            yield {"query_id": part["query_id"].to_numpy()[j], "id": left["id"].to_numpy()[i], "score": score}

        lists = self.spark.read.parquet(f"{self.path}/lists").schema
        return ranked(self._met(queries, best, T.StructType([queries.schema["query_id"], lists["id"]]).add("score", "double")), k)

    def rows_met(self, queries: DataFrame) -> DataFrame:
        """(query_id, n): the vectors that each query is compared with."""

        def count(left: pd.DataFrame, x: np.ndarray, part: pd.DataFrame, allowed: np.ndarray) -> Iterator[dict]:
            yield {"query_id": part["query_id"].to_numpy(), "n": allowed.sum(axis=0)}

        met = self._met(queries, count, T.StructType([queries.schema["query_id"]]).add("n", "long"))
        return met.groupBy("query_id").agg(F.sum("n").alias("n")).filter("n > 0")

    def _calibrate(self, rows: DataFrame, k: int, recall: float) -> None:
        """The number of nearest cells that hold this share of the k nearest of ASKED vectors of each length, found by exact search."""
        some = top_ranked(rows.filter(F.col("dim").isin(list(self.plan))), "dim", [F.xxhash64("id", F.lit(23)), F.col("id")], ASKED, "id")
        some = write_through(some.select(F.struct("dim", "id").alias("query_id"), F.col("u").alias("qv")), "index-asked")
        truth = vector_topk(some, rows.select("id", F.col("u").alias("v")), k + 1, -1.0).filter(F.col("query_id.id") != F.col("id")).select("query_id", "id")
        cell = self.spark.read.parquet(f"{self.path}/lists").select("id", "dim", "top", "cell")
        rank = self.asked(some, {}).select("query_id", "dim", "top", "cell", "rank")
        met = truth.join(cell, "id").join(rank, ["query_id", "dim", "top", "cell"])
        found = {r.dim: int(r.p) for r in met.groupBy("dim").agg(F.expr(f"percentile_disc({recall}) WITHIN GROUP (ORDER BY rank)").alias("p")).collect()}
        plan = [("lengths", json.dumps(self.plan)), ("probes", json.dumps(found))]
        self.spark.createDataFrame(plan, "name string, value string").write.mode("overwrite").parquet(f"{self.path}/plan")
