"""The stored vector index: recall on the given table, all lengths, additions, deletions, and batches that come again."""

import numpy as np
from memloom.operators import vector
from memloom.operators.vector_index import VectorIndex
from memloom.plans import views


def found(index, queries, k=10):
    return {(r.query_id, r.id) for r in index.search(queries, k).collect()}


def test_recall_on_the_given_table(spark, tmp_path):
    sf = "/root/testdata/sf0.1"
    corpus, queries = views.vectors(spark, sf).select("id", "v"), views.queries(spark, sf)
    index = VectorIndex.build(corpus, f"file://{tmp_path}/index")
    want = {(r.query_id, r.id) for r in vector.vector_topk(queries, corpus, 10).collect()}
    assert len(found(index, queries) & want) >= 0.9 * len(want)
    met = [r.n for r in index.rows_met(queries).collect()]  # the table's vectors lie at random, so much is met
    assert len(met) == queries.count() and np.mean(met) < 0.75 * corpus.count()


def test_lists_over_time(spark, tmp_path):
    """Groups of one length in two levels of cells, another length with few vectors, null and zero ones; then batches."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    x = [(i, (centres[i % 40] + 0.2 * rng.standard_normal(16)).tolist()) for i in range(1600)]
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [1.0, 2.0]), (9004, [2.0, 1.0]), (9005, [float("nan")] * 16)]
    make = lambda rows: spark.createDataFrame(rows, "id long, v array<double>")
    ask = lambda rows: spark.createDataFrame(rows, "query_id long, qv array<double>")
    index = VectorIndex.build(make([*x, *odd]), f"file://{tmp_path}/index", cell_rows=8)
    queries = ask([*x[::40], (9003, [1.0, 2.0]), (7, None)])
    exact = lambda rows: {(r.query_id, r.id) for r in vector.vector_topk(queries, make(rows), 10).collect()}
    want = exact([*x, *odd])
    assert index.plan[16][1] > 1 and len(found(index, queries) & want) >= 0.9 * len(want)
    assert {(9003, 9003), (9003, 9004)} <= found(index, queries)
    assert np.mean([r.n for r in index.rows_met(queries).collect()]) < 400

    more = [(5000 + i, v) for i, v in x[:40]]
    index.add(make(more), 1)
    index.delete(make(more[:5] + x[:5]).select("id"), 2)
    index.add(make([(5001, x[7][1]), (1, x[1][1])]), 3)
    index.add(make([(5001, x[7][1]), (1, x[1][1])]), 3)  # comes again
    now = dict([*x, *odd, *more])
    for i in [r[0] for r in more[:5] + x[:5]]:
        now.pop(i)
    now |= {5001: x[7][1], 1: x[1][1]}
    assert sorted(r.id for r in index.lists().select("id").collect()) == sorted(i for i, v in now.items() if v and np.isfinite(v).all() and np.any(v))
    want = exact(list(now.items()))
    assert len(found(index, queries) & want) >= 0.9 * len(want)


def test_search_meets_blocks_of_the_cells_that_are_asked(spark, tmp_path):
    """Vectors and queries meet as matrices, no row for each pair or cell; what is met are the cells that `asked` names."""
    sf = "/root/testdata/sf0.01"
    corpus, queries = views.vectors(spark, sf).select("id", "v"), views.queries(spark, sf)
    index = VectorIndex.build(corpus, f"file://{tmp_path}/index", cell_rows=2)
    assert "zip_with" not in index.search(queries, 5)._jdf.queryExecution().executedPlan().toString()
    pairs = index.asked(queries, index.probes).select("query_id", "dim", "top", "cell").join(index.lists().select("id", "dim", "top", "cell"), ["dim", "top", "cell"])
    met = {(r.query_id, r.id) for r in pairs.select("query_id", "id").collect()}
    exact = vector.vector_topk(queries, corpus, 1000).collect()
    want = {}
    for r in sorted((r for r in exact if (r.query_id, r.id) in met), key=lambda r: (-round(r.score, 9), r.id)):
        want.setdefault(r.query_id, []).append(r.id)
    got = {}
    for r in sorted(index.search(queries, 5).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {q: ids[:5] for q, ids in want.items()}
    assert {r.query_id: r.n for r in index.rows_met(queries).collect()} == {q: sum(p[0] == q for p in met) for q in {p[0] for p in met}}
