"""Classifier, mined URL rules and the mix against plain Python over the whole of small tables."""

import struct
from collections import defaultdict

import numpy as np
import xxhash
from memloom.llm import embedding_dups, katz, line_rules, mixing, piece_codec, quality, secrets, simhash, token_count, url_rules
from memloom.llm.common import remainder, table, tokenizer_file
from memloom.llm.registry import QUERIES
from pyspark.sql import functions as F

from . import brute

SF = "/root/testdata/sf0.001"


def test_classifier_equals_plain_loops(spark):
    """Word vectors are sums over the training texts; scores are the network's on pooled texts, whatever the tasks."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    vectors, net = quality.learn(docs.repartition(5), labels)
    train = {r.doc_id for r in labels.collect() if brute.remainder(r.doc_id, 5) != 0 and r.quality is not None}
    own = quality.index_vectors()
    total = np.zeros_like(own)
    rows = docs.collect()
    for r in rows:
        if r.doc_id in train:
            at = quality.buckets(r.text)
            for side in (0, 1):
                for i in range(len(at)):
                    for j in range(max(0, i - quality.NEAR), min(len(at), i + quality.NEAR + 1)):
                        if i != j:
                            total[at[i, side]] += own[at[j, side]]
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    assert np.allclose(vectors, own + total / np.maximum(norm, 1e-6) * np.sqrt(quality.NONZERO), atol=1e-4)
    want = {r.doc_id: float(net.score(quality.pooled(r.text, vectors)[None])[0]) for r in rows}
    got = {r.doc_id: r.score for r in quality.score(docs, (vectors, net)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    again = {r.doc_id: r.score for r in QUERIES["op3_quality"](spark, SF).collect()}
    assert all(abs(again[i] - want[i]) < 1e-6 for i in want)


def test_classifier_learns_from_one_row_of_an_id(spark):
    """Repeated rows and ids do not multiply what is learned from."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    one, net = quality.learn(docs, labels)
    many, again = quality.learn(docs.unionByName(docs).unionByName(docs), labels)
    assert np.array_equal(one, many) and all(np.array_equal(p, q) for p, q in zip(net.p, again.p, strict=True))


def test_mined_verdicts_equal_all_itemsets(spark):
    """Every set of a page's tokens is tried as a rule."""
    pages, labels = table(spark, SF, "pages"), table(spark, SF, "labels")
    labelled = url_rules.labelled_urls(pages, labels)
    url = F.col("url")
    host, path = url_rules.host(url), url_rules.path(url)
    toks = lambda df: df.withColumn("tokens", F.when((host != "") & url.isNotNull(), url_rules.tokens(url, host, path)).otherwise(F.array().cast("array<string>")))
    learn = [(frozenset(r.tokens), r.low) for r in toks(labelled).collect() if r.low is not None]
    where, low = defaultdict(int), 0
    for i, (t, bad) in enumerate(learn):
        low |= bad << i
        for x in t:
            where[x] |= 1 << i
    least = url_rules.MIN_SUPPORT * len(learn)
    speaks = {}
    for x, rows in sorted(where.items()):
        if rows.bit_count() >= least:
            speaks.setdefault(rows, x)  # the first of tokens in the very same rows
    speaks = {x: rows for rows, x in speaks.items()}
    want = {}
    for r in toks(pages).collect():
        hits = []
        sets = [(1 << len(learn)) - 1]
        for x in (x for x in set(r.tokens) if x in speaks):
            more = list({s & speaks[x] for s in sets})
            hits += more
            sets = list({*sets, *more})
        block = any((s & low).bit_count() >= max(least, 1) and (s & low).bit_count() >= url_rules.MIN_CONFIDENCE * s.bit_count() for s in hits)
        want[r.page_id] = brute.url_rule(r.url)[3] or ("block" if block else "allow")
    got = {r.page_id: r.verdict for r in QUERIES["op8_url_rules"](spark, SF).collect()}
    assert got == want and len(learn) > 20 and {"block", "allow"} <= set(got.values())


def test_mix_equals_plain_order(spark):
    """taken and positions, from the same hashed order walked one document at a time."""
    docs = table(spark, SF, "documents").collect()
    sizes = defaultdict(int)
    words = {d.doc_id: len(brute.WORD.findall(d.text or "")) for d in docs}
    for d in docs:
        sizes[d.source] += words[d.doc_id]
    target = brute.mix_targets(sizes)
    tilt = {s: mixing.TILTS[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    def place(d):
        h = xxhash.xxh64_intdigest(struct.pack("<q", d.doc_id), 42)
        h = h if d.text is None else xxhash.xxh64_intdigest(d.text.encode(), h)
        return xxhash.xxh64_intdigest(b"order", h)

    start, want = defaultdict(int), {}
    for d in sorted(docs, key=lambda d: (place(d), d.doc_id)):
        s, n, c = d.source, words[d.doc_id], start[d.source]
        start[s] += n
        whole = int(target[s] // sizes[s])
        passes = 0 if n == 0 else whole + (c + n / 2 <= target[s] - whole * sizes[s])
        want[d.doc_id] = passes * n, [(k * sizes[s] + c) / target[s] for k in range(passes)], tilt[s]
    got = {r.doc_id: r for r in QUERIES["op9_mixing"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, (taken, shares, a) in want.items():
        assert got[i].taken == taken and len(got[i].positions) == len(shares)
        for t, u in zip(got[i].positions, shares, strict=True):
            assert abs(t + a * (t * t - t) - min(u, 1)) < 1e-9


def test_katz_keeps_texts_with_their_rows(spark):
    """Scores do not depend on the order, the partitions or the source of the rows."""
    docs = table(spark, SF, "documents").select("doc_id", "text")
    held = remainder(F.col("doc_id"), 7) != 2
    want = {r.doc_id: (r.n_tokens, r.base_score, r.score) for r in katz.score(docs, held).collect()}
    mixed = docs.repartition(7, F.rand(3)).groupBy("doc_id").agg(F.first("text").alias("text")).withColumns({"row": F.lit(1), "block": F.lit("x"), "held": F.lit(None)})
    got = {r.doc_id: (r.n_tokens, r.base_score, r.score) for r in katz.score(mixed, held).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and np.allclose(got[i][1:], want[i][1:], rtol=1e-9) for i in want)


def test_katz_blocks_of_any_size(spark, monkeypatch):
    """Small blocks and many parts give the scores of one block."""
    docs = table(spark, SF, "documents").select("doc_id", "text")
    held = remainder(F.col("doc_id"), 7) != 2
    want = {r.doc_id: r.score for r in katz.score(docs, held).collect()}
    monkeypatch.setattr(katz, "BLOCK", 3000)
    monkeypatch.setattr(katz, "PART", 2000)
    frame, model = katz.fitted(docs, held)
    got = {r.doc_id: r.score for r in frame.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-8 * abs(want[i]) for i in want)
    assert model.counts.groupBy("kind").count().count() == 2 and model.backoff.count() > 1


def test_vectors_of_many_lengths(spark):
    """More lengths than get trees: every pair of equal length and direction links, none across lengths."""
    rng = np.random.default_rng(2)
    rows = []
    for d in range(2, 75):
        v = rng.standard_normal(d)
        rows += [(10 * d, v.tolist()), (10 * d + 1, (2.5 * v + 1e-3).tolist()), (10 * d + 2, (-v).tolist())]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dups.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {10 * d + k: ((1, 10 * d), (1, 10 * d), (0, 10 * d + 2))[k] for d in range(2, 75) for k in range(3)}


def test_empty_tables(spark):
    """Every operator gives an empty result of its columns, also beside columns of any name."""
    docs = spark.createDataFrame([], "doc_id long, text string, source string, score double, ids int, own int, row int, n_tokens int, block int, node int, fp int, page_id long, url string, key int")
    none = spark.createDataFrame([], "url string, low boolean")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, node int, twin int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {
        "ids": piece_codec.encode(docs, tokenizer_file(), verify=True), "n_tokens": token_count.count_tokens(docs, tokenizer_file()),
        "score": quality.score(docs, quality.learn(docs, labels)), "kept": line_rules.judge(docs), "base_score": katz.score(docs, F.lit(True)),
        "fp": simhash.near_duplicates(docs), "n_links": embedding_dups.near_duplicates(vectors), "verdict": url_rules.judge(docs, none),
        "taken": mixing.mix(docs), "all_spans": secrets.scan(docs),
    }
    for column, df in out.items():
        assert column in df.columns and df.count() == 0
