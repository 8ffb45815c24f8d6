"""Admission, deduplication, upserts and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memloom.functions.ids import hash_id


def first_by(df: DataFrame, keys: list, order: list, desc: bool = False) -> DataFrame:
    """The first row (desc: last) of each key."""
    w = W.partitionBy(*keys).orderBy(*(F.col(o).desc() if desc else F.col(o) for o in order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def admit_documents(docs: DataFrame) -> DataFrame:
    """S1. doc_id: the given one, else by file path, else by content; the first by seq wins.
    docs: (given_id, file_path, content, seq)."""
    key = F.coalesce(F.col("given_id"), F.when(F.trim("file_path") != "", hash_id("doc-", F.trim("file_path"))), hash_id("doc-", F.col("content")))
    return first_by(docs.withColumn("doc_id", key), ["doc_id"], ["seq"])


def split_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S2. (kept, duplicates): first by file name, then by content hash among what is left. docs: (doc_id, file_path, content, seq)."""
    name = F.element_at(F.split("file_path", "/"), -1)
    by_name = W.partitionBy("_name").orderBy("seq")
    named = docs.withColumn("_name", name).withColumn("_first", F.first("doc_id").over(by_name)).withColumn("_n", F.row_number().over(by_name))
    one = named.filter("_n > 1").withColumn("kind", F.lit("filename"))
    by_hash = W.partitionBy("_hash").orderBy("seq")
    hashed = named.filter("_n = 1").withColumn("_hash", F.md5("content")).withColumn("_first", F.first("doc_id").over(by_hash)).withColumn("_n", F.row_number().over(by_hash))
    two = hashed.filter("_n > 1").withColumn("kind", F.lit("content_hash"))
    shape = [*docs.columns, "kind", F.col("_first").alias("original_id")]
    return hashed.filter("_n = 1").select(*docs.columns), one.select(*shape).unionByName(two.select(*shape))


def find_existing_by_hash(docs: DataFrame, status: DataFrame) -> DataFrame:
    """S3. (doc_id, existing_id): the oldest other row of equal hash that does not itself point to this document.
    status: (doc_id, content_hash, created_at, original_id)."""
    old = status.select(F.col("doc_id").alias("existing_id"), "content_hash", "created_at", "original_id")
    met = docs.join(old, "content_hash").filter((F.col("existing_id") != F.col("doc_id")) & ~F.coalesce(F.col("original_id") == F.col("doc_id"), F.lit(False)))
    return first_by(met, ["doc_id"], ["created_at", "existing_id"]).select("doc_id", "existing_id")


def missing_keys(keys: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """S4. Keys that the store lacks."""
    return keys.join(store.select(key), key, "left_anti")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], version: str) -> DataFrame:
    """S5. The last version of each key; the batch wins ties."""
    both = target.withColumn("_b", F.lit(0)).unionByName(batch.withColumn("_b", F.lit(1)))
    return first_by(both, keys, [version, "_b"], desc=True).drop("_b")


def import_custom_kg(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S6. (nodes, edges): the last declaration per entity and unordered pair; unknown sources read UNKNOWN; missing
    endpoints become nodes, with the source of their first edge. chunks: (source_id, chunk_id); entities: (name, type, description, source_id, seq);
    relations: (src, tgt, description, weight, source_id, seq)."""
    known = lambda df: df.join(chunks, "source_id", "left").withColumn("source_id", F.coalesce("chunk_id", F.lit("UNKNOWN"))).drop("chunk_id")
    nodes = known(first_by(entities, ["name"], ["seq"], desc=True)).drop("seq")
    pairs = relations.withColumn("a", F.least("src", "tgt")).withColumn("b", F.greatest("src", "tgt"))
    edges = known(first_by(pairs, ["a", "b"], ["seq"], desc=True)).drop("seq", "src", "tgt")
    ends = first_by(edges.select(F.explode(F.array("a", "b")).alias("name"), "source_id", "description", "a", "b"), ["name"], ["a", "b"]).drop("a", "b")
    extra = ends.join(nodes, "name", "left_anti").select("name", F.lit("UNKNOWN").alias("type"), "description", "source_id")
    return nodes.unionByName(extra), edges


def import_chunks(chunks: DataFrame) -> DataFrame:
    """S7. Caller's chunks (doc_id, chunks array) as rows with ids of their document and content."""
    rows = chunks.select("doc_id", F.posexplode("chunks").alias("chunk_order_index", "content")).filter(F.trim("content") != "")
    return rows.withColumn("chunk_id", hash_id("chunk-", F.concat_ws("\x1f", "doc_id", F.col("chunk_order_index").cast("string"), "content")))


def import_extracted(payload: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S8. (entities, relations, errors) from (episode_id, entities array<struct<name,aliases>>, relations
    array<struct<source,target,keywords>>): endpoints without an entity are added; duplicates and self-relations are errors."""
    ents = payload.select("episode_id", F.posexplode("entities").alias("pos", "e")).select("episode_id", "pos", "e.*")
    key = F.lower(F.trim("name"))
    ranked = ents.withColumn("_n", F.row_number().over(W.partitionBy("episode_id", key).orderBy("pos")))
    rels = payload.select("episode_id", F.posexplode("relations").alias("pos", "r")).select("episode_id", "pos", "r.*")
    same = F.lower(F.trim("source")) == F.lower(F.trim("target"))
    errors = ranked.filter("_n > 1").select("episode_id", F.col("name").alias("item"), F.lit("duplicate entity").alias("reason"))
    errors = errors.unionByName(rels.filter(same).select("episode_id", F.col("source").alias("item"), F.lit("self-relation").alias("reason")))
    good, kept = rels.filter(~same), ranked.filter("_n = 1").drop("_n", "pos")
    ends = good.select("episode_id", F.explode(F.array("source", "target")).alias("name")).distinct()
    extra = ends.join(kept, ["episode_id", "name"], "left_anti").withColumn("aliases", F.array().cast("array<string>"))
    return kept.select("episode_id", "name", "aliases").unionByName(extra.select("episode_id", "name", "aliases")), good.drop("pos"), errors


def build_chunk_rows(chunks: DataFrame) -> DataFrame:
    """S10. Key doc-chunk-NNN; a given id is prefixed by its document; collisions get a content hash; empty content goes.
    chunks: (doc_id, given_id, chunk_order_index, content)."""
    rows = chunks.filter(F.trim("content") != "")
    default = F.format_string("%s-chunk-%03d", F.col("doc_id").cast("string"), F.col("chunk_order_index").cast("long"))
    rows = rows.withColumn("key", F.when(F.col("given_id").isNotNull(), F.concat_ws("-", "doc_id", "given_id")).otherwise(default))
    n = F.row_number().over(W.partitionBy("doc_id", "key").orderBy("chunk_order_index"))
    return rows.withColumn("_n", n).withColumn("chunk_id", F.when(F.col("_n") > 1, hash_id("chunk-", F.concat_ws("\x1f", "key", F.col("chunk_order_index").cast("string"), "content"))).otherwise(F.col("key"))).drop("_n", "key")
