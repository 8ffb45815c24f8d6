"""Operators 1, 3, 5, 6 and 7 against the library, held-out labels or plain Python."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from memloom.llm import embedding_dups, katz, piece_codec, quality, simhash
from memloom.llm.common import remainder, table, tokenizer_file
from memloom.llm.registry import QUERIES
from pyspark.sql import functions as F

from . import brute
from .test_native import ODD, odd

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").collect()


def lib():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())


def test_codec_equals_library(spark, docs, monkeypatch):
    got = {r.doc_id: r for r in QUERIES["op1_piece_codec"](spark, SF).collect()}
    sp = lib()
    assert len(got) == len(docs) and all(got[d.doc_id].ids == sp.encode(d.text or "") and got[d.doc_id].round_trip for d in docs)
    assert sorted(map(str, (r.ids for r in piece_codec.encode(odd(spark), tokenizer_file()).collect()))) == sorted(str(sp.encode(r[1] or "")) for r in ODD)
    monkeypatch.setattr(piece_codec, "GIANT_CHARS", 1)
    monkeypatch.setattr(piece_codec, "CHUNK_CHARS", 37)
    df = table(spark, SF, "documents").limit(12)
    texts = {r.doc_id: r.text for r in df.collect()}
    encoded = piece_codec.decode(piece_codec.encode(df, tokenizer_file()), tokenizer_file())
    for r in encoded.collect():
        assert r.ids == sp.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id]


def test_transfer_matrices_combine():
    import random

    m, sp, rng = piece_codec.bpe.model(tokenizer_file()), lib(), random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "th", "the", "in", "tion", " ", "  ", "\n", "é", "😀", "er"]) for _ in range(rng.randint(1, 40)))
        n, c = piece_codec.bpe.escaped(text), rng.randint(1, 9)
        left = lambda i: n[max(0, i - 48) : i]  # noqa: B023, E731
        steps = [piece_codec.transfer(m, left(i), n[i : i + c], i <= 48) for i in range(0, len(n), c)]
        taken = piece_codec.path_of(steps)
        ids = [x for i, (a, b) in zip(range(0, len(n), c), taken, strict=True) for x in piece_codec.trace(m, left(i), n[i : i + c], a, b)]
        assert ids == sp.encode(text)


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    rows = [r for r in QUERIES["op3_quality"](spark, sf).collect() if r.doc_id in labels]
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (brute.remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    good = [r.score for r in held if labels[r.doc_id] == 1]
    bad = [r.score for r in held if labels[r.doc_id] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.97
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.score(odd(spark), quality.learn(odd(spark), empty)).collect()] == [0.5] * len(ODD)


def katz_plain(docs):
    """Base and Katz scores by the definition, over (id, text)."""
    tokens = {i: [*(w.decode() for w in katz.words(t)), None] for i, t in docs}
    train = [i for i, _ in docs if brute.remainder(i, 7) != 2]
    uni, big = Counter(), defaultdict(Counter)
    for i in train:
        for h, w in zip(["<s>", *tokens[i][:-1]], tokens[i], strict=True):
            uni[w] += 1
            big[h][w] += 1
    total, vocabulary, k = sum(uni.values()), len(uni), katz.K
    def discount(counts):
        n = Counter(counts)
        d = katz.Discount.of(np.array([n[r] for r in range(1, k + 2)], dtype=float)).values
        return lambda c: c - katz.DELTA if c > k else d[c - 1]
    du, db = discount(uni.values()), discount(c for row in big.values() for c in row.values())
    unknown = 1 - sum(map(du, uni.values())) / total
    p = lambda w: du(uni[w]) / total if w in uni else unknown
    def cond(h, w):
        if h not in big:
            return p(w)
        n = sum(big[h].values())
        if w in big[h]:
            return db(big[h][w]) / n
        return (n - sum(map(db, big[h].values()))) / n / (1 - sum(map(p, big[h]))) * p(w)
    for h in list(big)[:20]:
        assert abs(sum(cond(h, w) for w in uni) + cond(h, "\0never") - 1) < 1e-9
    out = {}
    for i, own in tokens.items():
        base = sum(math.log10((uni[w] + 1) / (total + vocabulary + 1)) for w in own)
        out[i] = len(own), sum(w in uni for w in own), total, base, sum(math.log10(cond(h, w)) for h, w in zip(["<s>", *own[:-1]], own, strict=True))
    return out


def test_katz(spark, docs, monkeypatch):
    want = katz_plain([(d.doc_id, d.text) for d in docs])
    for r in QUERIES["op5_katz"](spark, SF).collect():
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, brute.remainder(r.doc_id, 7) == 2)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    assert katz.score(odd(spark), remainder(F.col("doc_id"), 7) != 2).count() == len(ODD)
    assert katz.score(odd(spark).limit(0), F.lit(True)).count() == 0


def test_simhash(spark, docs, monkeypatch):
    import xxhash

    def plain(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    sf = "/root/testdata/sf0.01"
    some = table(spark, sf, "documents").collect()
    prints = {d.doc_id: plain(d.text) for d in some}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = brute.golden_components(list(prints), near)
    got = QUERIES["op6_simhash"](spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert simhash.near_duplicates(odd(spark)).count() == len(ODD) and simhash.near_duplicates(odd(spark).limit(0)).count() == 0


def test_golay_keys_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.int64).astype(np.uint64)
    prints = {int(c) for c in centres}
    for c in centres.tolist():
        for _ in range(25):
            x = c
            for b in rng.integers(0, 64, 3):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    near = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 2]
    want = brute.golden_components(prints, near)
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    for crowd in (2, 16, 10_000):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        edges = [(int(np.int64(r.a).astype(np.uint64)), int(np.int64(r.b).astype(np.uint64))) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in edges)
        assert brute.golden_components(prints, edges) == want


def test_similar_documents(spark, monkeypatch):
    """Near copies of some texts, with words changed here and there; whatever the size from which a key is crowded."""
    rng = np.random.default_rng(6)
    rows = []
    for base in range(6):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(25):
            own = list(words)
            for at in rng.integers(0, 120, rng.integers(0, 4)):
                own[at] = f"x{rng.integers(0, 1000)}"
            rows.append((len(rows), " ".join(own)))
    grams = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    near = [(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    want = brute.golden_components(list(grams), near)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == want
    monkeypatch.setattr(simhash, "PAIRED", 4)  # nearly every key is crowded
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == want
    assert simhash.similar_documents(odd(spark)).count() == len(ODD) and simhash.similar_documents(odd(spark).limit(0)).count() == 0


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dups, "LEAF", 60)
    monkeypatch.setattr(embedding_dups, "BLOCK", 50)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 24))
    x[100:200] = x[:100] + 0.12 * rng.standard_normal((100, 24))
    x[200:260] = x[0] + 0.1 * rng.standard_normal((60, 24))
    x[260:290] = x[5]
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [1.0, None]), (904, [1.0, 2.0]), (905, [])]
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    want = brute.golden_components([r[0] for r in rows], [(int(a), int(b)) for a, b in np.argwhere(s)])
    got = {r.vec_id: r for r in embedding_dups.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == len(rows)
    found = sum(got[i].n_links for i in range(400))
    assert all(got[i].n_links <= s[i].sum() for i in range(400)) and found >= 0.97 * s.sum()
    assert np.mean([got[i].component_id == want[i] for i in range(400)]) > 0.97
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 906))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
