"""Operator 3, quality classifier: random-indexing word vectors and a two-layer network.

A word and its shape ("A!!" for "TRE!!") each fall into a hashed bucket. A bucket
has a sparse random index vector; its word vector adds the index vectors of the
buckets around it in the training texts. A document pools the vectors of its words
and of its shapes. A small numpy network scores the pooled vector; a temperature,
fitted on training documents that the network has not seen, calibrates it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.common import remainder, small_batches, table

#: Labelled documents that are learned from, at most: the bound of what the driver and each task hold.
TRAIN_DOCS = 20_000
BUCKETS, DIM, NONZERO, NEAR = 1 << 15, 64, 4, 2
#: Buckets whose sums are added up in one group.
RANGE = 1 << 11
HIDDEN, EPOCHS, RATE, DECAY, SEED = 32, 30, 3e-3, 1e-4, 11
HELD_OUT_MOD, THRESHOLD = 5, 0.3
WORD_LIMIT = 100_000

_LETTERS, _SMALL, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"a+"), re.compile(r"\d+")


class Buckets(dict):
    """Memo of (word bucket, shape bucket) by word, bounded."""

    def __missing__(self, word: str) -> tuple[int, int]:
        shape = _DIGITS.sub("0", _LETTERS.sub(lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a", word))[:16]
        pair = zlib.crc32(word.lower().encode()) % BUCKETS, zlib.crc32(b"shape " + shape.encode()) % BUCKETS
        if len(self) >= WORD_LIMIT:
            self.clear()
        self[word] = pair
        return pair


_memo = Buckets()


def buckets(text: str | None) -> np.ndarray:
    """(words, 2) buckets of a text."""
    return np.array(list(map(_memo.__getitem__, (text or "").split())), dtype=np.int64).reshape(-1, 2)


def index_vectors() -> np.ndarray:
    """The sparse random vector of each bucket."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    np.put_along_axis(out, rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice(np.array([-1, 1], dtype=np.float32), (BUCKETS, NONZERO)), axis=1)
    return out


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector, mean shape vector, and four plain figures; zeros for a text without words."""
    at = buckets(text)
    n = len(at)
    if not n:
        return np.zeros(2 * DIM + 4, dtype=np.float32)
    total = np.zeros((2, DIM), dtype=np.float64)
    for k in range(0, n, 50_000):
        for side in (0, 1):
            total[side] += vectors[at[k : k + 50_000, side]].sum(axis=0)
    plain = [np.log1p(n) / 10, len(np.unique(at[:, 0])) / n, len(text) / n / 10, text.count("\n") / n]
    return np.concatenate([total.ravel() / n, plain]).astype(np.float32)


class Network:
    """Two layers: tanh, then one logit."""

    def __init__(self, width: int):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale, self.temperature = np.zeros(width), np.ones(width), 1.0
        self.p = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam on log loss over four fifths, then the temperature on the rest."""
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(x))
        held, own = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x[own].mean(axis=0, dtype=np.float64), x[own].std(axis=0, dtype=np.float64) + 1e-3
        z = np.clip((x - self.mean.astype(np.float32)) / self.scale.astype(np.float32), -8, 8)
        m, v, t = [np.zeros_like(q) for q in self.p], [np.zeros_like(q) for q in self.p], 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
                a = np.tanh(z[part] @ self.p[0] + self.p[1])
                d = (1 / (1 + np.exp(-np.clip(a @ self.p[2] + self.p[3][0], -30, 30))) - y[part]) / len(part)
                back = np.outer(d, self.p[2]) * (1 - a * a)
                t += 1
                for k, g in enumerate((z[part].T @ back, back.sum(axis=0), a.T @ d, np.array([d.sum()]))):
                    g = g + DECAY * self.p[k]
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        if len(held):
            raw, sign, tries = self.logits(x[held]), 2 * y[held] - 1, np.geomspace(0.25, 8, 61)
            loss = [np.logaddexp(0, -sign * raw / t).mean() for t in tries]
            self.temperature = float(tries[int(np.argmin(loss))])


def training_ids(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(id, quality) to learn from: not held out, at most `most`, by a hash of the id."""
    per = labels.filter(F.col("quality").isNotNull() & (remainder(F.col("doc_id"), HELD_OUT_MOD) != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return per.orderBy(F.xxhash64("doc_id", F.lit("train")), "doc_id").limit(most).withColumnRenamed("doc_id", "id")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, Network | None]:
    """Word vectors and the network. Without labels of both kinds, as in empty tables, there is no network. Null texts teach as
    empty ones, null ids and null labels nothing; of labels of one id the highest counts, of its rows one."""
    spark = docs.sparkSession
    chosen = F.broadcast(training_ids(docs, labels))  # TRAIN_DOCS rows at most
    rows = docs.select(F.col(id_col).alias("its"), F.col(text_col).alias("text"))
    met = rows.join(chosen, F.col("its") == F.col("id")).select("its", "text", F.col("quality").cast("double").alias("quality"))
    # of rows with one id the one of least hash: TRAIN_DOCS rows at most
    texts = met.groupBy("its", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "quality")
    index = index_vectors()

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, seen = index_vectors(), np.zeros((BUCKETS, DIM), dtype=np.float32), np.zeros(BUCKETS, dtype=bool)
        for b in batches:
            for text in b.column(0).to_pylist():
                at = buckets(text)
                for side in (0, 1):
                    for gap in range(1, NEAR + 1):
                        x, y = at[:-gap, side], at[gap:, side]
                        np.add.at(total, x, own[y])
                        np.add.at(total, y, own[x])
                    seen[at[:, side]] = True
        rows = np.flatnonzero(seen)
        for k in np.unique(rows // RANGE):
            part = rows[rows // RANGE == k]
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part.astype(np.int32).tobytes()]), pa.array([total[part].tobytes()])], ["range", "at", "v"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        """The sum of what the tasks have of one range of buckets; whole numbers, so the order of tasks does not matter."""
        total = np.zeros((RANGE, DIM), dtype=np.float32)
        for at, v in zip(pdf["at"], pdf["v"], strict=True):
            total[np.frombuffer(at, dtype=np.int32) % RANGE] += np.frombuffer(v, dtype=np.float32).reshape(-1, DIM)
        return pd.DataFrame({"range": pdf["range"].iloc[:1], "v": [total.tobytes()]})

    sums = texts.select("text").mapInArrow(around, "range long, at binary, v binary").groupBy("range").applyInPandas(added, "range long, v binary")
    vectors = index.copy()
    for k, v in zip(*sums.toArrow().to_pydict().values(), strict=True):  # BUCKETS / RANGE rows at most
        v = np.frombuffer(v, dtype=np.float32).reshape(-1, DIM)
        vectors[k * RANGE : (k + 1) * RANGE] += v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6) * np.sqrt(NONZERO)
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [pooled(t, shared.value).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column(1)], ["x", "y"])

    x, y = texts.mapInArrow(features, "x binary, y double").toArrow().to_pydict().values()  # TRAIN_DOCS rows at most
    rows = sorted(zip(x, y, strict=True))  # the tasks' order must not matter
    if len({v for _, v in rows}) < 2:
        return vectors, None
    x, y = np.frombuffer(b"".join(v for v, _ in rows), dtype=np.float32).reshape(len(rows), -1), np.array([v for _, v in rows])
    net = Network(x.shape[1])
    net.fit(x, y)
    return vectors, net


def score(docs: DataFrame, model: tuple[np.ndarray, Network | None], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, columns of keep) of each row's whole text. Null and empty texts pool to zeros and are
    scored as such; without a network every score is 0.5. Repeated rows and null ids give a row each; an empty table gives an
    empty result; columns that are not named are ignored, keep must not name `score`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(F.col(id_col), *(F.col(f"`{c}`") for c in keep)).alias("own"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            s = np.full(len(texts), 0.5) if net is None or not texts else net.score(np.stack([pooled(t, vectors) for t in texts]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["own", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["own"]]).add("score", "double")).select("own.*", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labels that are not held out."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder(F.col("doc_id"), HELD_OUT_MOD) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
