"""Reading and writing tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def sound(spark: SparkSession) -> None:
    """Spark 4.1 takes a union to be partitioned as its parts are, though adaptive execution may have coalesced these
    differently: what is grouped by that key afterwards then stays apart (seen here: one key in two rows). Off, unions are
    dealt anew."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sound(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a one-machine session may set a folder of its own."""
    sound(spark)
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        path = "file://" + tempfile.mkdtemp(prefix="memloom-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
    return path


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into all of the session's shuffle partitions. Adaptive execution merges those of a plain group-by, window or join into
    as few as there are cores, however many rows a task then sorts or holds; it leaves these alone."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def write_through(df: DataFrame, label: str, *by: str) -> DataFrame:
    """df as a table in the shared folder (in partitions by columns): lineage ends there, for iterations and for lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S9. Nodes and edges as flat tables in csv, json or parquet."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.format(fmt).mode("overwrite").options(header=True).save(f"{path}/{name}")
