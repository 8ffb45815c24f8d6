"""The stages of ingestion as one call, each of which a caller may replace (UDF points of the engine)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators import chunk, ingest

#: (doc_id, text) to (doc_id, chunk_order_index, content).
Chunker = Callable[[DataFrame], DataFrame]


def ingest_documents(docs: DataFrame, chunker: Chunker = chunk.chunk_fixed, admit: Callable[[DataFrame], DataFrame] = ingest.admit_documents, most_tokens: int | None = None, tokenizer: chunk.Tokenizer = chunk.PLAIN) -> tuple[DataFrame, DataFrame]:
    """(chunks, duplicates) of documents (given_id, file_path, content, seq): S1, S2, a chunker, S10, and C7 if most_tokens is given.

    chunker, admit and tokenizer are what a caller replaces; a chunker must give (doc_id, chunk_order_index, content) and may give more
    columns, which are left out. chunks: (doc_id, chunk_id, chunk_order_index, content)."""
    kept, double = ingest.split_duplicates(admit(docs))
    made = chunker(kept.select("doc_id", F.col("content").alias("text")))
    rows = ingest.build_chunk_rows(made.select("doc_id", F.lit(None).cast("string").alias("given_id"), "chunk_order_index", "content"))
    if most_tokens:
        rows = chunk.enforce_token_limit(rows, most_tokens, tokenizer)
    return rows.select("doc_id", "chunk_id", "chunk_order_index", "content"), double
