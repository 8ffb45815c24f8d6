"""Operator 2, token counts: a finite-state tokenizer.

The model's pieces are compiled to a deterministic automaton; reading a character
moves it to one next node, whose ending pieces decide the last piece of the text
so far. The transition emits the change in the number of ids. Its registers (the
last pieces and counts of the latest positions) are empty again at each
synchronising position, so what a whole word emits is memoised as one transition.

Giant texts are cut into chunks at any character. A chunk's state map says, for each boundary state that it
can be entered in (last piece, characters pending after it), in which states it can be left and how many ids that
emits: the max-plus matrix of operator 1, whose weights are minus those counts. Maps compose associatively, in
blocks of chunks and then over blocks, whatever the text: also one without spaces is never put together.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import bpe
from memloom.llm.common import cut, small_batches, table, tokenizer_file
from memloom.llm.piece_codec import CONTEXT, matrices_of, product, rows_of, transfer

#: Characters from which a text is cut, and of a chunk.
GIANT_CHARS, CHUNK_CHARS = 65_536, 16_384
BLOCK_CHUNKS = 64


class Transducer:
    """Counts of one model, with bounded memos of units and words."""

    def __init__(self, path: str):
        self.model = bpe.model(path)
        self.words = bpe.Words(self.model, self.count, sum)

    def count(self, unit: str) -> int:
        """Ids of a text that starts and ends at a synchronising position."""
        return self.model.forward(unit)[1][-1]


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row's whole text.

    One row out for each row in, repeated and null ids included; a null text counts
    as empty (0 bytes, 0 tokens); other columns are ignored. Texts below GIANT_CHARS
    are counted where they are read, without a shuffle; chunks of longer ones are
    dealt over the cluster, and only their state maps meet, never their texts.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema[id_col].dataType.simpleString()

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_path)
        for b in batches:
            counts = [machine.words.of(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["key", "n_bytes", "n_tokens"])

    def maps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = bpe.model(model_path)
        for pdf in frames:
            out = [x for r in pdf.itertuples() for x in rows_of((r.row, r.block, r.at), transfer(m, r.context, r.chunk, r.begins))]
            yield pd.DataFrame(out, columns=["row", "block", "at", "p", "d", "q", "e", "w"])

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        at, steps = matrices_of(pdf)
        return pd.DataFrame(rows_of((pdf["row"].iloc[0], pdf["block"].iloc[0], at[0]), functools.reduce(product, steps)), columns=pdf.columns)

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        """The count of a whole text: what its map emits from the text's beginning to an end with nothing pending."""
        _, steps = matrices_of(pdf)
        ends = functools.reduce(product, steps, {(bpe.START, 0): {(bpe.START, 0): 0}})[(bpe.START, 0)]
        return pd.DataFrame({"row": [pdf["row"].iloc[0]], "n_tokens": [-max(w for (_, pending), w in ends.items() if not pending)]})

    small = rows.filter(F.length("text") < GIANT_CHARS).select(F.col(id_col).alias("key"), "n_bytes", "text").mapInArrow(plain, f"key {kind}, n_bytes long, n_tokens long")

    # in normal form a text has one more character, the dummy prefix
    giants = rows.filter(F.length("text") >= GIANT_CHARS).select(F.monotonically_increasing_id().alias("row"), F.struct(F.col(id_col).alias("key"), "n_bytes").alias("own"), F.translate(F.concat(F.lit(" "), "text"), " ", bpe.SPACE).alias("text"))
    cuts = giants.select("row", "own", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(CHUNK_CHARS))).alias("at"))
    columns = ["row", "at", F.floor(F.col("at") / (CHUNK_CHARS * BLOCK_CHUNKS)).alias("block"), F.when(F.col("at") == 0, F.col("own")).alias("own")]
    columns += [F.expr(f"substring(text, greatest(at - {CONTEXT}, 0) + 1, least(at, {CONTEXT}))").alias("context"), F.expr(f"substring(text, at + 1, {CHUNK_CHARS})").alias("chunk"), (F.col("at") <= CONTEXT).alias("begins")]
    chunks = cut(cuts.select(*columns).repartition("row", "at"), "count-chunks")
    entry = "row long, block long, at int, p int, d int, q int, e int, w long"
    found = chunks.select("row", "block", "at", "context", "chunk", "begins").mapInPandas(maps, entry)
    blocks = found.groupBy("row", "block").applyInPandas(composed, entry)
    wholes = blocks.groupBy("row").applyInPandas(counted, "row long, n_tokens long")
    large = chunks.filter("at = 0").select("row", "own").join(wholes, "row").select("own.key", "own.n_bytes", "n_tokens")
    return small.unionByName(large).withColumnRenamed("key", id_col)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, and whether there are more than 4096."""
    small_batches(spark)
    counts = count_tokens(table(spark, sf_dir, "documents"), tokenizer_file())
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)
