"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.sources.tables import read, write_through

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, sf_dir, name)


def cut(df: DataFrame, label: str, *by: str) -> DataFrame:
    """df as a table in the shared folder (in partitions by columns): the lineage ends there, and a lost executor costs no
    recomputation of what came before."""
    return write_through(df, label, *by)


def places(docs: DataFrame) -> tuple[Column, Column, Column] | None:
    """(hash of the file, number of the part, place in it) of each row of a table read straight from Parquet; None of others."""
    if "_metadata" in docs.columns or not hasattr(docs, "_jdf") or docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return None
    part = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).try_cast("long")
    out = F.xxhash64(F.col("_metadata.file_path")), F.coalesce(part, F.lit(0)).cast("long"), F.col("_metadata.row_index")
    try:
        docs.select(*out)
    except AnalysisException:  # files of a kind that do not number their rows
        return None
    return out


def ordinal(docs: DataFrame) -> Column:
    """A number that rises with the rows of a sorted table, by its parts and the places in them."""
    found = places(docs)
    return F.shiftleft(found[1], 40) + found[2] if found else F.monotonically_increasing_id()


def keyed(docs: DataFrame, *names: str) -> DataFrame:
    """(own, row, columns by `names`): own holds all columns of a row, so that no other name can clash with theirs; row is
    a key of each row, a hash of its columns, then its place. Only equal rows are ordered by place, so what is chosen by row
    does not depend on the files. Tables that are read straight from Parquet have places already; anything else is written once."""
    own, columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("c")
    found = places(docs)
    if found:
        return docs.select(own, F.struct(columns, found[0].alias("f"), found[2].alias("i")).alias("row"), *names)
    place = F.lit(0).cast("long").alias("f"), F.monotonically_increasing_id().alias("i")
    return cut(docs.select(own, F.struct(columns, *place).alias("row")), "keyed").select("own", "row", *(F.col(f"own.{n}").alias(n) for n in names))


def remainder(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo mod. A null key gives null."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(mod)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Fewer rows in an Arrow batch: whole texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def salted_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, spread: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """Equi-join for a left side with hot keys and a right side with one row per key: the right
    side is repeated for each salt and the left side dealt by `spread`, so one key has many tasks.
    Keys of the left side that are null join nothing."""
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = left.withColumn("_deal", F.pmod(F.xxhash64(spread, F.lit("salt")), F.lit(salts)).cast("int"))
    return left.join(right, (left[left_key] == right[right_key]) & (left["_deal"] == right["_salt"]), how).drop("_salt", "_deal", right_key)


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    """The place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
