"""The corpus pipeline: quality, near duplicates, secrets, mixing, pieces.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and
returns a DataFrame; all but the last return the columns of documents. Stages are
written as Parquet and read again between each other. Within a stage rows are joined
by a key of their own: ids may be null or repeated. A row's columns travel in one struct,
so columns that documents have besides their own may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import mixing, piece_codec, quality, secrets, simhash
from memloom.llm.common import cut, keyed, ordinal, small_batches, table, tokenizer_file

#: Words, and units, that a worker remembers for the pieces: fewer than by default, since workers serve the other stages too.
MEMO = 100_000


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """(own, columns by `names`): own holds all columns of a row."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), *names)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among docs, does not reject.

    Null and empty texts are scored like any other (mostly rejected); null ids teach nothing and are scored; repeated rows
    stay repeated; without labels of both kinds nothing is rejected. An empty table gives an empty one."""
    small_batches(spark)
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(packed(docs, "doc_id", "text"), model, keep=("own",))
    return scored.filter(F.col("score") >= quality.THRESHOLD).select("own.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one of smallest id (null ids last), of each group of near duplicates.

    Null and wordless texts are one group; ids may be null or repeated; of equal rows one stays."""
    small_batches(spark)
    rows = keyed(docs, "doc_id", "text")
    kept = simhash.one_of_similar(rows.select("row", "doc_id", "text"), "row")
    return rows.select("own", "row").join(kept, "row").select("own.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced; n_chars follows.

    Null texts stay null; ids may be null or repeated, every row keeps its own text."""
    rows = keyed(docs, "doc_id", "text", "source")
    found = secrets.scan(rows.select("row", "text", "source"), id_col="row")
    clean = secrets.redact(rows.select("own", "row", "text"), found, id_col="row")
    out = F.col("own").withField("text", F.col("text")).withField("n_chars", F.length("text").cast("long"))
    return clean.select(out.alias("own")).select("own.*").select(*(F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, in training order.

    Null and wordless texts take nothing and go; a null source is a source of its own; ids may be null or repeated; ties between
    rows of one id and text go by the other columns, so equal rows alone share a place. The result does not depend on the files."""
    rows = keyed(docs, "doc_id", "text", "source")
    plan = mixing.mix(rows.select("row", "doc_id", "text", "source", F.col("row.c").alias("same")), row_col="row", same_col="same")
    return mixing.repeated(rows.select("own", "row", "doc_id"), plan, row_col="row").select("own.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, whether they decode to it, and the text's place: rows by position are in training order.

    Null and empty texts have no ids; repeated rows, as the mix has them, give a row each."""
    small_batches(spark)
    rows = docs.select("doc_id", "source", "text", ordinal(docs).alias("position"))
    out = piece_codec.encode(rows, tokenizer_file(), keep=("source", "position"), verify=True, memo=MEMO)
    return out.select("doc_id", "source", "position", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]
#: SQL cannot express the classifier, the fingerprints or the pieces; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
