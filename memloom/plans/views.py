"""Bindings of the driver's tables to the shapes that operators take. Each has an equal in catalog.SQL_VIEWS."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memloom.sources.tables import read


def docs(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    return d.select("doc_id", F.concat("source", F.lit("/"), (F.col("doc_id") % 140).cast("string")).alias("file_path"), F.col("text").alias("content"), "text", F.col("doc_id").alias("seq"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    per = read(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").cast("double").alias("weight"))
    return per.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b"), "weight")


def extractions(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("tgt"), F.lit(1.0).alias("weight"), F.col("l_returnflag").alias("keyword"), F.col("l_orderkey").cast("string").alias("source_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("seq"), F.concat("l_returnflag", "l_linestatus").alias("description"))


def atoms(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    hours = lambda n: F.expr(f"ts + interval {n} hours")
    return e.select(F.col("event_id").alias("atom_id"), F.col("user_id").alias("owner_id"), F.concat("event_type", F.lit(":"), F.floor(F.col("value") / 10).cast("string")).alias("content"), F.col("ts").alias("valid_at"), F.lead("ts").over(w).alias("invalid_at"), hours(1).alias("created_at"), F.when(F.col("event_id") % 7 == 0, hours(2)).alias("expired_at"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 100).alias("episode_id"))


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select(F.col("event_id").alias("atom_id"))
    rows = e.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("atom_id") % 3)))
    return rows.select("atom_id", ((F.col("atom_id") + F.col("k")) % 50).alias("episode_id"), (F.col("atom_id") * 10 + F.col("k")).alias("evidence_id"))


def evolution(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").filter("event_id % 11 = 0 and event_id > 0")
    kind = F.when(F.col("event_id") % 2 == 0, "CONTRADICTION").otherwise("REFINEMENT")
    return e.select(F.col("event_id").alias("source_atom_id"), (F.col("event_id") - 1).alias("target_atom_id"), kind.alias("relation_type"), F.when(F.col("event_id") % 4 == 0, '{"resolved_at": "x"}').otherwise("{}").alias("metadata"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label", F.concat(F.lit("src"), (F.col("vec_id") % 7).cast("string")).alias("file_path"), (F.col("vec_id") % 50 + 1).alias("tokens"))


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id 20 divides asks."""
    return read(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


def names(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_name").alias("alias"))
    sup = read(spark, sf, "supplier").select(F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.col("s_name").alias("alias"))
    return part.unionByName(sup)


def pools(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, owner, place, pos, chunk_id): a nation's customers as owners, their orders as chunks."""
    c = read(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("query_id"), F.col("c_custkey").alias("owner"))
    c = c.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("owner")) - 1)
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("chunk_id"))
    return c.join(o, "owner").withColumn("pos", F.row_number().over(W.partitionBy("query_id", "owner").orderBy("chunk_id")) - 1).select("query_id", "owner", "place", "pos", "chunk_id")
