"""Operator 1, SentencePiece encoding and decoding by a max-plus parallel scan.

A path through a text is a chain of compatible pieces (see `bpe`); its weight is
minus its number of ids, and an incompatible step weighs minus infinity. BPE's
segmentation is the one path of finite weight. Giant texts are cut into chunks at
any character. A boundary state (piece, pending) says that `piece` was the last to
end before the border, `pending` characters before it, and the next piece spans it.
A chunk yields the max-plus transfer matrix between the states of its two borders;
matrices combine associatively, in blocks of chunks and then over blocks; the states
between blocks give those inside each block, and each chunk is traced back on its own
between its two.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm import bpe
from memloom.llm.common import cut, small_batches, table, tokenizer_file

#: Characters from which a text is cut, of a chunk, and of what a chunk sees to its left.
GIANT_CHARS, CHUNK_CHARS, CONTEXT = 65_536, 16_384, 48
#: Chunks whose matrices are combined in one group.
BLOCK_CHUNKS = 64
#: In place of a state's piece: whatever came before (a border that always holds).
ANY = -3
State = tuple[int, int]
Matrix = dict[State, dict[State, int]]


@functools.lru_cache(maxsize=2)
def words(path: str, most: int) -> bpe.Words:
    """The ids of whole texts, as bytes."""
    m = bpe.model(path)
    return bpe.Words(m, lambda unit: np.array(m.segmented(unit), dtype=np.int32).tobytes(), b"".join, most)


def walk(m: bpe.PieceModel, text: str, before: int, skip: int) -> tuple[list[int | None], list[int]]:
    """Last pieces and counts by position, after `before`, if no piece ends in the first `skip` characters. None: no path."""
    at, lasts, counts = 0, [before], [0]
    for i, char in enumerate(text, 1):
        at = m.move(at, char)
        last, n = None, 0
        if i > skip:
            for length, piece, _ in m.ends[at]:
                prev = lasts[i - length]
                if prev is not None and m.compatible(prev, piece):
                    last, n = piece, counts[i - length] + 1
                    break
            if last is None and char not in m.ids and lasts[i - 1] is not None:
                last, n = bpe.RAW, counts[i - 1] + len(char.encode())
        lasts.append(last)
        counts.append(n)
    return lasts, counts


def alive(m: bpe.PieceModel, pending: str) -> bool:
    """Whether some piece begins so (and goes on)."""
    at = 0
    for char in pending:
        at = m.trie_moves[at].get(char)
        if at is None:
            return False
    return bool(m.trie_moves[at])


def border(m: bpe.PieceModel, text: str, at: int) -> bool:
    """Whether a border always holds before position at of text (inside it)."""
    return 0 < at < len(text) and m.sync(text[at - 1], text[at])


def entries(m: bpe.PieceModel, context: str, text: str, begins: bool) -> list[State]:
    """The boundary states that a chunk can be entered in; context: the characters before it, from the text's
    beginning if begins."""
    if not context:
        return [(bpe.START, 0)]
    if m.sync(context[-1], text[0]):
        return [(ANY, 0)]
    out: list[State] = []
    for pending in range(min(m.max_len, len(context) + 1)):
        at = len(context) - pending
        if pending and not alive(m, context[at:]):
            continue
        if at == 0:
            out += [(bpe.START, pending)] * begins
        elif border(m, context, at):
            out.append((ANY, pending))
        else:
            out += [(m.ids[context[at - k : at]], pending) for k in range(1, min(at, m.max_len) + 1) if context[at - k : at] in m.ids]
            out += [(bpe.RAW, pending)] * (context[at - 1] not in m.ids)
        if pending and at and border(m, context, at):
            break  # nothing spans a border
    return out


def exits(m: bpe.PieceModel, text: str, lasts: list, counts: list, base: int, start: int) -> dict[State, int]:
    """Boundary states at the end of text, reached from its position start, with weights."""
    out: dict[State, int] = {}
    for pending in range(min(m.max_len, len(text) - start + 1)):
        at = len(text) - pending
        last = lasts[at - start]
        if last is not None and (not pending or alive(m, text[at:])):
            state = (ANY if border(m, text, at) else last, pending)
            out[state] = max(out.get(state, -(1 << 60)), base - counts[at - start])
    return out


def transfer(m: bpe.PieceModel, context: str, text: str, begins: bool) -> Matrix:
    """The chunk's max-plus matrix: weight by entry and exit state (absent: minus infinity)."""
    starts = [x.start() for x in m.units.finditer(text)]
    if starts and context and not m.starts_unit(context[-1], text[0]):
        starts = starts[1:]
    out: Matrix = {}
    tail: dict[State, int] = {}
    if starts:
        inner = sum(m.forward(u)[1][-1] for u in m.units.findall(text[starts[0] : starts[-1]]))
        lasts, counts = m.forward(text[starts[-1] :])
        tail = exits(m, context + text, lasts, counts, -inner, len(context) + starts[-1])
    for prev, pending in entries(m, context, text, begins):
        head = context[len(context) - pending :] + (text[: starts[0]] if starts else text)
        before = bpe.RAW if prev == ANY else prev
        lasts, counts = walk(m, head, before, pending)
        if not starts:
            whole = exits(m, context + text, lasts, counts, 0, len(context) - pending)
            row = {s: w for s, w in whole.items() if s[1] < len(text) or s == (prev, pending + len(text))}
            if alive(m, head):  # the spanning piece may go on through the whole chunk
                row[(prev, len(head))] = 0
        elif lasts[-1] is None:
            row = {}
        else:
            row = {s: w - counts[-1] for s, w in tail.items()}
        if row:
            out[(prev, pending)] = row
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product; an entry (ANY, 0) of b takes every state without pending characters."""
    out: Matrix = {}
    for start, row in a.items():
        best: dict[State, int] = {}
        for middle, w in row.items():
            onward = b.get(middle)
            if onward is None and middle[1] == 0:
                onward = b.get((ANY, 0))
            for end, v in (onward or {}).items():
                best[end] = max(best.get(end, -(1 << 60)), w + v)
        if best:
            out[start] = best
    return out


def trace(m: bpe.PieceModel, context: str, text: str, entry: State, leave: State) -> list[int]:
    """The ids of the pieces that end in the chunk, between its boundary states."""
    prev, pending = entry
    body = context[len(context) - pending :] + text
    body = body[: len(body) - leave[1]]
    lasts, _ = walk(m, body, bpe.RAW if prev == ANY else prev, pending)
    return m.backward(body, lasts)


def path_of(matrices: list[Matrix], start: State = (bpe.START, 0), leave: State | None = None) -> list[tuple[State, State]]:
    """(entry, exit) of each matrix on the best path from start to leave (None: the best end of a text): prefix
    products forward, then back."""
    reach: list[Matrix] = [{start: {start: 0}}]
    for x in matrices:
        reach.append(product(reach[-1], x))
    if leave is None:
        ends = {s: w for s, w in reach[-1][start].items() if s[1] == 0}
        leave = max(ends, key=lambda s: ends[s])
    out = []
    for k in range(len(matrices) - 1, -1, -1):
        goal = reach[k + 1][start][leave]
        for state, w in reach[k][start].items():
            entry = state if state in matrices[k] or state[1] else (ANY, 0)
            if matrices[k].get(entry, {}).get(leave, 1 << 60) + w == goal:
                out.append((entry, leave))
                leave = state
                break
    return out[::-1]


def rows_of(found: list[tuple], x: Matrix) -> list[tuple]:
    """found before each entry of a matrix: (..., piece and pending characters of entry and exit, weight)."""
    return [(*found, p, d, q, e, w) for (p, d), row in x.items() for (q, e), w in row.items()]


def matrices_of(pdf: pd.DataFrame) -> tuple[list[int], list[Matrix]]:
    """Places and matrices of rows_of's rows, in order."""
    order: dict[int, Matrix] = {}
    for at, p, d, q, e, w in pdf[["at", "p", "d", "q", "e", "w"]].sort_values("at", kind="stable").itertuples(index=False):
        order.setdefault(at, {}).setdefault((p, d), {})[(q, e)] = w
    return list(order), list(order.values())


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), verify: bool = False, memo: int = bpe.UNIT_LIMIT) -> DataFrame:
    """(id, columns of keep, ids array<int>) of each row's whole text: what the library gives, without special ids; with
    verify also round_trip, whether decoding the ids gives the text back. memo bounds what a worker remembers (words and units).

    Null and empty texts have no ids (an empty array); repeated rows and null ids give a row each; an empty table gives
    an empty result. Columns that are not named are ignored, whatever their names; keep must not name `ids` or `round_trip`.
    Texts below GIANT_CHARS are encoded where they are read; chunks of longer ones are dealt over the cluster, and their
    matrices are combined in blocks, then over blocks.
    """
    rows = docs.select(F.struct(F.col(id_col).alias(id_col), *keep).alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shape = T.StructType([rows.schema["own"]]).add("ids", T.ArrayType(T.IntegerType()))
    if verify:
        shape = shape.add("round_trip", "boolean")

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(model_path, memo)
        for b in batches:
            texts = b.column(1).to_pylist()
            parts = [known.of(t) for t in texts]
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))
            same = [pa.array([known.model.decode(np.frombuffer(p, dtype=np.int32).tolist()) == t for p, t in zip(parts, texts, strict=True)], pa.bool_())] if verify else []
            yield pa.RecordBatch.from_arrays([b.column(0), ids, *same], shape.names)

    small = rows.filter(F.length("text") < GIANT_CHARS).mapInArrow(plain, shape)

    # in normal form a giant text has one more character, the dummy prefix, so chunk borders are those of the normal form
    normal = rows.filter(F.length("text") >= GIANT_CHARS).select(F.monotonically_increasing_id().alias("row"), F.struct("own", F.xxhash64("text").alias("was")).alias("own"), F.translate(F.concat(F.lit(" "), "text"), " ", bpe.SPACE).alias("text"))
    offset = F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(CHUNK_CHARS))).alias("at")
    cuts = normal.select("row", "own", "text", offset)
    columns = ["row", "at", F.floor(F.col("at") / (CHUNK_CHARS * BLOCK_CHUNKS)).alias("block"), F.when(F.col("at") == 0, F.col("own")).alias("own")]
    columns += [F.expr(f"substring(text, greatest(at - {CONTEXT}, 0) + 1, least(at, {CONTEXT}))").alias("context"), F.expr(f"substring(text, at + 1, {CHUNK_CHARS})").alias("chunk"), (F.col("at") <= CONTEXT).alias("begins")]
    chunks = cut(cuts.select(*columns).repartition("row", "at"), "piece-chunks")

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = bpe.model(model_path)
        for pdf in frames:
            out = [x for r in pdf.itertuples() for x in rows_of((r.row, r.block, r.at), transfer(m, r.context, r.chunk, r.begins))]
            yield pd.DataFrame(out, columns=["row", "block", "at", "p", "d", "q", "e", "w"])

    entry = "row long, block long, at int, p int, d int, q int, e int, w long"
    found = chunks.select("row", "block", "at", "context", "chunk", "begins").mapInPandas(matrices, entry)

    def combined(pdf: pd.DataFrame) -> pd.DataFrame:
        at, steps = matrices_of(pdf)
        return pd.DataFrame(rows_of((pdf["row"].iloc[0], pdf["block"].iloc[0], at[0]), functools.reduce(product, steps)), columns=pdf.columns)

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        """The states between a text's blocks."""
        at, steps = matrices_of(pdf)
        block = dict(zip(pdf["at"], pdf["block"], strict=True))
        return pd.DataFrame([(pdf["row"].iloc[0], block[a], *s, *e) for a, (s, e) in zip(at, path_of(steps), strict=True)], columns=["row", "block", "p", "d", "q", "e"])

    def inside(pdf: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        """The states between a block's chunks."""
        at, steps = matrices_of(pdf)
        first, last = tuple(ends[["p", "d"]].iloc[0]), tuple(ends[["q", "e"]].iloc[0])
        return pd.DataFrame([(pdf["row"].iloc[0], a, *s, *e) for a, (s, e) in zip(at, path_of(steps, first, last), strict=True)], columns=["row", "at", "p", "d", "q", "e"])

    found = cut(found, "piece-matrices")
    between = found.groupBy("row", "block").applyInPandas(combined, entry).groupBy("row").applyInPandas(across, "row long, block long, p int, d int, q int, e int")
    states = found.groupBy("row", "block").cogroup(between.groupBy("row", "block")).applyInPandas(inside, "row long, at int, p int, d int, q int, e int")

    def traced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = bpe.model(model_path)
        for pdf in frames:
            ids = [trace(m, r.context, r.chunk, (r.p, r.d), (r.q, r.e)) for r in pdf.itertuples()]
            yield pd.DataFrame({"row": pdf["row"], "at": pdf["at"], "part": pd.Series(ids, dtype=object)})

    parts = chunks.join(states, ["row", "at"]).select("row", "at", "context", "chunk", "p", "d", "q", "e").mapInPandas(traced, "row long, at int, part array<int>")
    wholes = parts.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("ids"))
    large = chunks.filter("at = 0").select("row", "own").join(wholes, "row").select("own.own", "own.was", "ids")
    if verify:
        large = decode(large, model_path).select("own", "ids", (F.xxhash64("decoded") == F.col("was")).alias("round_trip"))
    return small.unionByName(large.select(*shape.names)).select("own.*", *shape.names[1:])


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the texts of its ids; null ids give null. Invalid byte runs read U+FFFD."""
    shape = T.StructType(list(encoded.schema)).add(out_col, "string")
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe.model(model_path)
        for b in batches:
            ids = b.column(at)
            flat, ends = ids.values.to_numpy(zero_copy_only=False).tolist(), ids.offsets.to_pylist()
            texts = [m.decode(flat[i:j]) if ok else None for i, j, ok in zip(ends[:-1], ends[1:], ids.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out_col])

    return encoded.mapInArrow(run, shape)


def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back."""
    small_batches(spark)
    out = encode(table(spark, sf_dir, "documents"), tokenizer_file(), verify=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")
