"""Operators 11, 12 and 13 against plain Python, on odd rows too (their SQL is in test_oracles)."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from memloom.llm import centroids, merkle, topk
from memloom.llm.common import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def best(rows, every, k):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if sound(v)]
    out = []
    for n, (q, v) in enumerate(kept):
        if q is not None and q % every == 0:
            scored = [(-sum(map(int.__mul__, v, w)), i is None, i or 0, i) for m, (i, w) in enumerate(kept) if m != n and len(w) == len(v)]
            out += [(q, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, rank int, score string")


@pytest.mark.parametrize("sent", [32, 0])
def test_topk_equals_brute_force(spark, monkeypatch, sent):
    """Ties, copies of a third of all rows, repeated and null ids, other lengths, bad vectors, few others; both ways to meet."""
    monkeypatch.setattr(topk, "SENT_MB", sent)
    monkeypatch.setattr(topk, "ASKED", 7)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-4, 5, 6) / 4]) for i in range(120)] + [(200 + i, [0.5, 0.25, -1.0, 0.75, 0.0, 1.0]) for i in range(60)]
    rows += [(10, rows[10][1]), (None, rows[20][1]), (None, None), (400, []), (401, []), (30, [1.0, 2.0]), (31, [3.0, -1.0]), (500, [1.0] * 5 + [None]), (510, [NAN] * 6), (520, [INF] * 6), (530, [0.0] * 6)]
    got = topk.search(vectors(spark, rows).repartition(5), F.col("key") % 10 == 0, 4).collect()
    assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got), key=str) == best(rows, 10, 4)
    assert topk.search(vectors(spark, rows).limit(0), F.col("key") % 10 == 0, 4).count() == 0
    assert topk.search(vectors(spark, rows), F.col("key") < 0, 4).count() == 0


def test_topk_of_large_numbers(spark):
    """Products beyond what doubles hold exactly, one value in a crowd of large ones."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(int(x)) for x in rng.integers(-(2**18), 2**18, 8)]) for i in range(60)] + [(100, [1e-3] * 8), (110, [float(2**18)] * 8)]
    got = topk.search(vectors(spark, rows), F.col("key") % 10 == 0).collect()
    assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got), key=str) == best(rows, 10, 10)
    huge = topk.search(vectors(spark, [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0])]), F.col("key") == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(huge, key=lambda r: r["rank"])] == [(1, topk.LARGEST), (2, -topk.LARGEST)]


def clusters(rows, k, rounds, dim, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if sound(v) and len(v) == dim]
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    centre = [list(v) for _, v in sorted(kept, key=lambda r: (*name(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centre))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for n, vs in own.items():
            centre[n] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = defaultdict(int)
    for _, n, d in found:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for i, n, d in found), key=str)


def test_clusters_equal_plain_python(spark):
    """Ties, equal vectors (centroids that stay empty), repeated and null ids, lengths, bad vectors, fewer vectors than clusters."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 2]) for i in range(80)] + [(100 + i, [0.5, 0.5, -0.5, 1.0]) for i in range(40)]
    rows += [(7, rows[9][1]), (None, rows[3][1]), (200, None), (201, []), (202, [1.0]), (203, [1.0, None, 1.0, 1.0]), (204, [NAN] * 4), (205, [INF] * 4), (206, [1e-9, -1e-9, 0.0, 0.26])]
    columns = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    for given, k in ((rows, 6), (rows[:3], 6), (rows[80:120], 3)):
        df = vectors(spark, given).withColumnRenamed("score", "cluster").withColumnRenamed("rank", "v")
        got = centroids.cluster(df, clusters=k, rounds=3, dim=4).collect()
        assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == clusters(given, k, 3, 4, 64)
    assert centroids.cluster(vectors(spark, rows).limit(0)).count() == 0
    far = centroids.cluster(vectors(spark, [(1, [1e300] * 4), (2, [-1e300] * 4)]), clusters=1, rounds=1, dim=4).collect()
    assert {r.distance for r in far} == {4 * centroids.LARGEST**2}


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, k):
    out = []
    for level in levels[:-1]:
        run = level[k - k % 3 : k - k % 3 + 3]
        out.append((run[: k % 3], run[k % 3 + 1 :]))
        k //= 3
    return out


def manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {s: tree([leaf(r, r[4]) for r in by[s]]) for s in order}
    top, out = tree([trees[s][-1][0] for s in order]), []
    for n, s in enumerate(order):
        for k, r in enumerate(by[s]):
            steps, node = way(trees[s], k) + way(top, n), leaf(r, r[4])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                node = leaf(r, r[4].replace("\n", ""))
            for a, b in steps:
                node = sha(*a, node, *b)
            out.append((r[0], leaf(r, r[4]), trees[s][-1][0], top[-1][0], sha(*(x for a, b in steps for x in a + b)), node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("high", [1, 2, 8])
def test_manifest_equals_plain_python(spark, high):
    """Sources of 1 to 82 rows, more sources than a superblock holds, nulls anywhere, equal rows, empty and long texts."""
    rows = [(i, f"s{i % 3}", "en", i, f"line {i}\nnext\n") for i in range(60)] + [(1000 + i, "hot", "en", i, f"a\n{i}") for i in range(82)]
    rows += [(2000 + i, f"only-é{i}", None, None, None) for i in range(11)] + [(5, "s2", "en", 1, "again\n"), *[(3000, "", "en", 1, "x\ny")] * 9]
    rows += [(None, None, "en", 1, "null\n"), (None, None, None, None, None), (None, "s1", "de", 2, ""), (4000, "s1", "en", 3, "ä\n" * 40_000), (-7, "s1", "en", 3, "\n"), (4001, "-", "en", 0, "")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, rank int")
    got = merkle.manifest(docs.repartition(4), high).collect()
    assert sorted((tuple(r) for r in got), key=str) == manifest(rows)


def test_manifest_of_small_tables(spark):
    docs = table(spark, SF, "documents")
    assert merkle.manifest(docs.limit(0)).count() == 0
    one = merkle.manifest(docs.limit(1)).collect()[0]
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")
