"""Operator 5, LM scoring: a Katz backoff bigram model in partitioned tables.

p(w | h) = disc(c(h w)) / c(h) if the pair was seen in training, else alpha(h) p(w);
p(w) = disc(c(w)) / N, and one unknown word has the mass that this leaves. disc is
Good-Turing's count for counts up to K, in Katz' form, and the count less DELTA
above. alpha(h) = (mass that h's pairs leave) / (1 - sum of p over the words seen
after h), so each context's probabilities sum to one.

Documents are coded in blocks of a bounded number of tokens, training and held-out
ones apart. A block asks for the counts of its distinct words and pairs, and brings its
own training counts along, once for each of them: that is the combination before the
shuffle, and no word or pair, however frequent, has more rows than there are blocks.
The asked are dealt by the leading bits of their hashes; each part adds up a table of
n-grams and answers the blocks in the order in which they asked. Then every token is
evaluated where its block is. Contexts that held-out texts have get their sums from the
blocks that saw them, each pair by its share of the pair's count, and held-out blocks
are answered once more, with the backoff weights.

Words and pairs stand for themselves by 64-bit hashes: of n different ones about
n^2 / 2^65 pairs of them are taken for one (10^12 pairs: 3 in 10^8).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.common import cut, remainder, small_batches, table

#: Tokens from which a block is closed (a longer text is a block of its own), and tokens of the corpus for each part of a table.
BLOCK, PART = 1 << 21, 1 << 19
#: Codes of a text's beginning (a context only) and end (a token only); words have greater ones.
BEGIN, END = 0, 1
#: Counts up to K get Good-Turing's discount; DELTA is taken from larger ones.
K, DELTA = 5, 0.01
HELD_OUT_MOD, HELD_OUT = 7, 2
WORDS, PAIRS = 1, 2


def words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased."""
    return (text or "").encode().lower().split()


def code(word: bytes) -> int:
    return max(xxhash.xxh64_intdigest(word, 5), 2)


def pair_codes(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64 bits for each pair of word codes."""
    with np.errstate(over="ignore"):
        x = h * np.uint64(0x9E3779B97F4A7C15) + w * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x165667B19E3779F9)
        return x ^ (x >> np.uint64(29))


def planes(numbers: np.ndarray) -> bytes:
    """Unsigned numbers by significance of their bytes: bytes that are zero everywhere go, others pack well."""
    raw = np.ascontiguousarray(numbers, dtype="<u8")
    width = max(1, (int(raw.max()).bit_length() + 7) // 8) if len(raw) else 1
    return bytes([width]) + raw.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.zeros(((len(data) - 1) // width, 8), dtype=np.uint8)
    raw[:, :width] = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(width, -1).T
    return raw.view("<u8").ravel()


def rising(codes: np.ndarray, least: np.uint64) -> bytes:
    """Rising codes, as their differences from `least` on."""
    return planes(np.diff(codes, prepend=least))


def unrising(data: bytes, least: np.uint64) -> np.ndarray:
    return np.cumsum(unplanes(data), dtype=np.uint64) + least


def cuts(codes: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(part, begin, end) of the parts, by leading bits, that rising codes fall into."""
    if not len(codes):
        return []
    part = (codes >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.diff(part, prepend=-1))
    return list(zip(part[at].tolist(), at.tolist(), [*at[1:].tolist(), len(codes)], strict=True))


def least_of(part: int, bits: int) -> np.uint64:
    return np.uint64((part & ((1 << bits) - 1)) << (64 - bits))


def log10(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


@dataclass
class Discount:
    """Discounted counts from numbers of counts n_1 ... n_{K+1}."""

    values: np.ndarray  # of counts 1 ... K

    @classmethod
    def of(cls, n: np.ndarray) -> Discount:
        r = np.arange(1, K + 1)
        with np.errstate(all="ignore"):
            common = (K + 1) * n[K] / n[0]
            d = ((r + 1) * n[1:] / n[:K] / r - common) / (1 - common)
        good = np.isfinite(d) & (d > 0) & (d < 1)
        return cls(np.where(good, np.where(good, d, 0) * r, r - 0.5))

    def __call__(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > K, count - DELTA, np.concatenate([[0.0], self.values])[np.minimum(count, K)])


@dataclass
class Model:
    """What training gives: the discounts and the figures of all words, and the tables of n-grams and of backoff weights.

    counts: (kind, part, codes, counts), one row for each part; backoff: (part, codes, back), log10 of the mass that a
    context leaves, times its count, over what its words leave of the word model; for contexts that were asked for.
    """

    total: int
    vocabulary: int
    words: Discount
    pairs: Discount
    unknown: float
    counts: DataFrame
    backoff: DataFrame | None = None

    def word(self, count: np.ndarray) -> np.ndarray:
        """Probability of words by their counts."""
        return np.where(count > 0, self.words(count) / max(self.total, 1), self.unknown)


class Local(dict):
    """A block's words, numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Coder:
    """Texts of one kind (training or held out) on their way into blocks."""

    def __init__(self) -> None:
        self.local, self.parts, self.keys, self.tokens = Local({b" ": 0}), [], [], 0  # no word is a space: it stands for END

    def add(self, text: str | None) -> None:
        own = [*map(self.local.__getitem__, words(text)), 0]
        self.parts.append(np.array(own, dtype=np.int32))
        self.tokens += len(own)

    def block(self) -> tuple:
        """(keys, codes by number, stream of numbers); frequent words have small numbers."""
        stream = np.concatenate(self.parts)
        codes = np.array([END, *map(code, list(self.local)[1:])], dtype=np.uint64)
        order = np.argsort(-np.bincount(stream, minlength=len(codes)), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        out = pa.concat_arrays(self.keys), codes[order].tobytes(), planes(rank[stream])
        self.__init__()
        return out


def blocks(docs: DataFrame, training: Column, id_col: str, text_col: str) -> DataFrame:
    """A table of (block, held, n, keys, codes, stream): whole texts of at least BLOCK tokens, or what a task has left."""
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(training, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coders, n = {True: Coder(), False: Coder()}, TaskContext.get().partitionId() << 32

        def close(train: bool) -> pa.RecordBatch:
            nonlocal n
            n += 1
            tokens = coders[train].tokens
            keys, codes, stream = coders[train].block()
            return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([not train]), pa.array([tokens]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([codes]), pa.array([stream])], ["block", "held", "n", "keys", "codes", "stream"])

        for b in batches:
            trains = b.column(1).to_pylist()
            for train, coder in coders.items():
                at = [i for i, x in enumerate(trains) if x == train]
                texts = b.column(2).take(pa.array(at, pa.int64())).to_pylist()
                begin = 0
                for k, text in enumerate(texts):
                    coder.add(text)
                    if coder.tokens >= BLOCK or k == len(texts) - 1:
                        coder.keys.append(b.column(0).take(pa.array(at[begin : k + 1], pa.int64())))
                        begin = k + 1
                    if coder.tokens >= BLOCK:
                        yield close(train)
        for train in coders:
            if coders[train].parts:
                yield close(train)

    return cut(rows.mapInArrow(coded, f"block long, held boolean, n long, keys array<{kind}>, codes binary, stream binary"), "katz-blocks")


class Block:
    """A block read again: its tokens with their contexts, and its distinct words and pairs in the order in which it asks."""

    def __init__(self, codes: bytes, stream: bytes):
        self.codes = np.append(np.frombuffer(codes, dtype=np.uint64), np.uint64(BEGIN))
        size, begin = len(self.codes), len(self.codes) - 1
        self.w = unplanes(stream).astype(np.int64)
        ends = self.w == np.flatnonzero(self.codes == END)[0]
        self.doc = np.cumsum(ends) - ends
        self.docs = int(ends.sum())
        h = np.concatenate([[begin], np.where(ends, begin, self.w)[:-1]])
        pair = h * size + self.w
        self.pairs, self.pair_count = np.unique(pair, return_counts=True)
        self.token_pair = np.searchsorted(self.pairs, pair)
        self.h, self.to = self.pairs // size, self.pairs % size
        self.word_count = np.bincount(self.w, minlength=size)
        self.word_count[begin] = self.docs
        self.word_order = np.argsort(self.codes)
        mixed = pair_codes(self.codes[self.h], self.codes[self.to])
        self.pair_order = np.argsort(mixed)
        self.asked = {WORDS: (self.codes[self.word_order], self.word_count[self.word_order]), PAIRS: (mixed[self.pair_order], self.pair_count[self.pair_order])}

    def answered(self, replies: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of words, whether held-out texts have them, and counts of pairs, from (part, counts) in any order."""
        of = {kind: [unplanes(r["counts"]) for r in sorted(replies, key=lambda r: r["part"]) if r["kind"] == kind] for kind in (WORDS, PAIRS)}
        word, pair = np.empty(len(self.codes), dtype=np.int64), np.empty(len(self.pairs), dtype=np.int64)
        word[self.word_order], pair[self.pair_order] = np.concatenate(of[WORDS]), np.concatenate(of[PAIRS])
        return word >> 1, word & 1 == 1, pair >> 1


def ask(coded: DataFrame, bits: int) -> DataFrame:
    """(kind, part, block, held, codes, counts): what each block asks of each part, with its own training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, held, codes, stream in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                rows = []
                for kind, (asked, count) in Block(codes, stream).asked.items():
                    own = np.zeros_like(count) if held else count
                    rows += [(kind, part, no, held, rising(asked[i:j], least_of(part, bits)), planes(own[i:j])) for part, i, j in cuts(asked, bits)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["kind", "part", "block", "held", "codes", "counts"])

    return coded.select("block", "held", "codes", "stream").mapInArrow(run, "kind long, part long, block long, held boolean, codes binary, counts binary")


def added_up(bits: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of one part: the table's row (block null), with figures of its counts, and the answers, twice the count and 1 if a
    held-out block asked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, part = int(pdf["kind"].iloc[0]), int(pdf["part"].iloc[0])
        asked = [unrising(c, least_of(part, bits)) for c in pdf["codes"]]
        codes, at = np.unique(np.concatenate(asked), return_inverse=True)
        sizes = [len(a) for a in asked]
        total = np.bincount(at, weights=np.concatenate([unplanes(c) for c in pdf["counts"]]), minlength=len(codes)).astype(np.int64)
        wanted = np.bincount(at, weights=np.repeat(pdf["held"].to_numpy(dtype=np.int64), sizes), minlength=len(codes)) > 0
        answers = np.split((2 * total + wanted)[at], np.cumsum(sizes)[:-1])
        real = (total > 0) & ~((kind == WORDS) & (codes == BEGIN))
        counts, known = total[real], total > 0
        figures = [counts.sum(), len(counts), (counts > K).sum(), counts[counts > K].sum(), *((counts == r).sum() for r in range(1, K + 2))]
        own = pd.DataFrame({"kind": [kind], "part": [part], "block": [None], "codes": [rising(codes[known], least_of(part, bits))], "counts": [planes(total[known])], "figures": [np.array(figures, dtype=np.float64)]})
        out = pd.DataFrame({"kind": kind, "part": part, "block": pdf["block"], "codes": None, "counts": [planes(a) for a in answers], "figures": None})
        return pd.concat([own.astype({"block": "Int64"}), out.astype({"block": "Int64"})])

    return run


def model_of(counts: DataFrame) -> Model:
    """The model's figures, from the tables' few figures a part."""
    mine = counts.filter("block is null")
    names = range(4 + K + 1)
    got = {r["kind"]: np.array(r[1:], dtype=float) for r in mine.groupBy("kind").agg(*(F.sum(F.get("figures", F.lit(i))).alias(f"f{i}") for i in names)).collect()}
    one, two = (got.get(k, np.zeros(4 + K + 1)) for k in (WORDS, PAIRS))
    word = Discount.of(one[4:])
    mass = one[3] - DELTA * one[2] + (word.values * one[4 : 4 + K]).sum()
    return Model(int(one[0]), int(one[1]), word, Discount.of(two[4:]), 1 - mass / one[0] if one[0] else 1.0, mine.drop("block", "figures"))


def evaluated(coded: DataFrame, replies: DataFrame, model: Model, bits: int) -> DataFrame:
    """A table of blocks (block, held, keys, n_tokens, n_known, base, score, gaps, parts): the tokens' sums by document.

    A held-out block's score lacks the backoff weights of known contexts: gaps holds (document, context, times), and parts
    the contexts' codes. A training block's parts bring the sums of contexts that held-out texts have.
    """
    facts = model.total, model.vocabulary, model.words, model.pairs, model.unknown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*facts, None)
        for batch in batches:
            for i in range(batch.num_rows):
                no, held, keys, codes, stream, answers = (batch.column(c).slice(i, 1) for c in range(6))
                b = Block(codes[0].as_py(), stream[0].as_py())
                word, wanted, pair = b.answered(answers[0].as_py())
                seen, context = pair > 0, word[b.h]
                value = np.where(seen, log10(m.pairs(pair)), log10(m.word(word[b.to]))) - np.where(context > 0, log10(context), 0)
                n = np.bincount(b.doc, minlength=b.docs)
                base = np.bincount(b.doc, weights=log10(word[b.w] + 1.0), minlength=b.docs) - n * np.log10(m.total + m.vocabulary + 1)
                sums = n, np.bincount(b.doc, weights=word[b.w] > 0, minlength=b.docs).astype(np.int64), base, np.bincount(b.doc, weights=value[b.token_pair], minlength=b.docs)
                gaps, use = {"doc": b"", "word": b"", "n": b""}, np.zeros(len(b.codes), dtype=bool)
                free = after = np.zeros(len(b.codes))
                if held[0].as_py():
                    open_ = (~seen & (context > 0))[b.token_pair]
                    key, times = np.unique(b.doc[open_] * len(b.codes) + b.h[b.token_pair][open_], return_counts=True)
                    doc, h = key // len(b.codes), key % len(b.codes)
                    use[h] = True
                else:
                    share = b.pair_count / pair
                    free = np.bincount(b.h, weights=share * (pair - m.pairs(pair)), minlength=len(b.codes))
                    after = np.bincount(b.h, weights=share * m.word(word[b.to]), minlength=len(b.codes))
                    use = wanted & (free > 0)
                order = b.word_order[use[b.word_order]]
                if held[0].as_py():
                    place = np.zeros(len(b.codes), dtype=np.int64)
                    place[order] = np.arange(len(order))
                    gaps = {"doc": planes(doc), "word": planes(place[h]), "n": planes(times)}
                mine = b.codes[order]
                parts = [{"part": p, "codes": rising(mine[i:j], least_of(p, bits)), "free": free[order[i:j]].tobytes(), "after": after[order[i:j]].tobytes()} for p, i, j in cuts(mine, bits)]
                whole = pa.ListArray.from_arrays(pa.array([0, b.docs], pa.int32()), pa.array(sums[0]))
                lists = [pa.ListArray.from_arrays(whole.offsets, pa.array(x)) for x in sums]
                yield pa.RecordBatch.from_arrays([no, held, keys, *lists, pa.array([gaps], gap_type), pa.array([parts], part_type)], ["block", "held", "keys", "n_tokens", "n_known", "base", "score", "gaps", "parts"])

    gap_type = pa.struct([("doc", pa.binary()), ("word", pa.binary()), ("n", pa.binary())])
    part_type = pa.list_(pa.struct([("part", pa.int64()), ("codes", pa.binary()), ("free", pa.binary()), ("after", pa.binary())]))
    own = replies.groupBy("block").agg(F.collect_list(F.struct("kind", "part", "counts")).alias("answers"))  # one for each part at most
    met = coded.select("block", "held", "keys", "codes", "stream").join(own, "block")
    shape = f"block long, held boolean, keys {coded.schema['keys'].dataType.simpleString()}, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>, gaps struct<doc:binary,word:binary,n:binary>, parts array<struct<part:long,codes:binary,free:binary,after:binary>>"
    return cut(met.mapInArrow(run, shape), "katz-evaluated")


def weights(bits: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of one part: the backoff weights of its contexts (block null), and the answers to held-out blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        asked = [unrising(c, least_of(part, bits)) for c in pdf["codes"]]
        held = pdf["held"].to_numpy(dtype=bool)
        brought = [i for i in range(len(pdf)) if not held[i]]
        none = [np.zeros(0, dtype=np.uint64)]
        codes, at = np.unique(np.concatenate([asked[i] for i in brought] or none), return_inverse=True)
        added = [np.bincount(at, weights=np.concatenate([np.frombuffer(pdf[c].iloc[i]) for i in brought] or [np.zeros(0)]), minlength=len(codes)) for c in ("free", "after")]
        back = log10(added[0]) - log10(1 - added[1])
        answers = [back[np.searchsorted(codes, asked[i])].tobytes() for i in range(len(pdf)) if held[i]]
        own = pd.DataFrame({"part": [part], "block": [None], "codes": [rising(codes, least_of(part, bits))], "back": [back.tobytes()]})
        out = pd.DataFrame({"part": part, "block": pdf["block"][held], "codes": None, "back": answers})
        return pd.concat([own.astype({"block": "Int64"}), out.astype({"block": "Int64"})])

    return run


def backed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Held-out blocks with the backoff weights added to their scores."""
    for batch in batches:
        for i in range(batch.num_rows):
            *rest, scores, gaps, answers = (batch.column(c).slice(i, 1) for c in range(batch.num_columns))
            back = [np.frombuffer(r["back"]) for r in sorted(answers[0].as_py() or [], key=lambda r: r["part"])]
            score = np.array(scores[0].as_py(), dtype=np.float64)
            if back:
                doc, word, n = (unplanes(gaps[0].as_py()[c]).astype(np.int64) for c in ("doc", "word", "n"))
                score += np.bincount(doc, weights=n * np.concatenate(back)[word], minlength=len(score))
            yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array([0, len(score)], pa.int32()), pa.array(score))], names=["keys", "n_tokens", "n_known", "base", "score"])


def fitted(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """(scores, model): see `score`; the model's tables are those that gave the scores."""
    coded = blocks(docs, training, id_col, text_col)
    tokens = coded.agg(F.sum("n")).first()[0] or 0
    bits = max(3, (int(tokens) // PART).bit_length())
    counts = cut(ask(coded, bits).groupBy("kind", "part").applyInPandas(added_up(bits), "kind long, part long, block long, codes binary, counts binary, figures array<double>"), "katz-counts", "kind")
    model = model_of(counts)
    done = evaluated(coded, counts.filter("block is not null"), model, bits)
    parts = done.select("block", "held", F.explode("parts").alias("p")).select("p.part", "block", "held", "p.codes", "p.free", "p.after")
    back = cut(parts.groupBy("part").applyInPandas(weights(bits), "part long, block long, codes binary, back binary"), "katz-backoff")
    model.backoff = back.filter("block is null").drop("block")
    own = back.filter("block is not null").groupBy("block").agg(F.collect_list(F.struct("part", "back")).alias("answers"))
    sums = ["keys", "n_tokens", "n_known", "base", "score"]
    held = done.filter("held").join(own, "block", "left").select(*sums, "gaps", "answers").mapInArrow(backed, done.select(*sums).schema)
    rows = done.filter(~F.col("held")).select(*sums).unionByName(held)
    rows = rows.select(F.explode(F.arrays_zip(*sums)).alias("x"))
    out = rows.select(F.col("x.keys").alias(id_col), F.col("x.n_tokens").alias("n_tokens"), F.col("x.n_known").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), F.col("x.base").alias("base_score"), F.col("x.score").alias("score"))
    return out, model


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row; it learns from rows where training holds.

    A null text is empty: one token, the end. A null condition means held out. Repeated rows and ids
    give a row each, null ids too, in whatever order the rows come. Without training rows every token is the unknown
    word, of probability 1; an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    return fitted(docs, training, id_col, text_col)[0]


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents, learned from those that are not held out by their ids."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), HELD_OUT_MOD) == HELD_OUT
    out = score(docs, ~held)
    return out.select("doc_id", (remainder(F.col("doc_id"), HELD_OUT_MOD) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
