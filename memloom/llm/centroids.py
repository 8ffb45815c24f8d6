"""Operator 13, centroid clustering in JVM-native expressions.

Vectors become arrays of integers. A round compares each vector with literal centroid
arrays (`zip_with` subtracts, `aggregate` adds the squares), `array_min` of
(distance, number) structs chooses, and one aggregate of a sum a component gives the next
centroids. Only the centroids (as many as `clusters`, of `dim` numbers) pass through the
driver between rounds; rows are read where they lie, and shuffled in no round.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.common import table

#: Clusters, components of a vector, steps of a component's unit, rounds that move centroids.
CLUSTERS, DIM, SCALE, ROUNDS = 16, 64, 64, 3
#: Integers are held within this bound, so that a squared distance of DIM components stays within a long.
LARGEST = 1 << 27


def steps(vector: Column, dim: int = DIM, scale: int = SCALE) -> Column:
    """The vector in integers, floor(scale * x), x as double; null if it is null, has another length, or holds a null or
    non-finite component. Integers beyond LARGEST count as LARGEST."""
    good = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.lit(float(scale)) * x.cast("double")))).cast("long")
    return F.when(F.coalesce(good, F.lit(False)), F.transform(vector, whole))


def squared(vector: Column, centroid: list[int]) -> Column:
    """Squared Euclidean distance to a literal centroid."""
    literal = F.array(*(F.lit(c).cast("long") for c in centroid))
    return F.aggregate(F.zip_with(vector, literal, lambda a, b: a - b), F.lit(0).cast("long"), lambda s, d: s + d * d)


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid; ties go to the smaller number."""
    return F.array_min(F.array(*(F.struct(squared(vector, c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids))))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS) -> list[list[int]]:
    """The vectors of the smallest sha256 of `1:<id>`; equal ids go by their vectors, null ids come last."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("key").cast("string")).cast("binary"), 256)
    return [list(r.v) for r in kept.orderBy(order.asc_nulls_last(), "v").select("v").limit(clusters).collect()]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector.

    Vectors that are null, of another length than dim, or hold a null or non-finite component are left out (`steps`). Repeated
    ids and vectors are rows like others; a null id is kept, but starts a centroid only if fewer than `clusters` rows have
    ids. Fewer vectors than clusters make as many clusters as vectors. An empty centroid stays where it is. An empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    kept = vectors.select(F.col(id_col).alias("key"), steps(F.col(vector_col), dim, scale).alias("v")).filter("v is not null")
    centroids = first_centroids(kept, clusters)
    if not centroids:
        centroids = [[0] * dim]  # no row to assign
    for _ in range(rounds):
        near = kept.select(nearest(F.col("v"), centroids)["cluster"].alias("cluster"), "v")
        sums = near.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.get("v", F.lit(i))).alias(f"c{i}") for i in range(dim)))
        for r in sums.collect():
            centroids[r.cluster] = [r[f"c{i}"] // r.n for i in range(dim)]
    near = kept.select("key", nearest(F.col("v"), centroids).alias("at"))
    inertia = {r.cluster: r.d for r in near.groupBy("at.cluster").agg(F.sum("at.distance").alias("d")).collect()}
    per = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("at.cluster") + 1)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = per([inertia.get(k, 0) for k in range(len(centroids))]).cast("long")
    return near.select(F.col("key").alias(id_col), "at.cluster", "at.distance", own.alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), per(sha).alias("centroid_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of 64 finite components."""
    return cluster(table(spark, sf_dir, "embeddings"))
