"""Operators that SQL cannot express, against plain Python on small made cases; and odd rows."""

import json
from collections import defaultdict

import numpy as np
import pytest
from memloom.functions import text
from memloom.operators import chunk, community, graph, merge, vector
from memloom.operators import retrieve as r
from memloom.sources import tables
from pyspark.sql import functions as F


def pairs(df, *cols):
    return sorted(tuple(x[c] for c in cols) for x in df.collect())


def test_communities_find_planted_groups(spark):
    """Four groups, dense inside: as good as the planted partition, and each community connected."""
    rng = np.random.default_rng(3)
    group = {i: i // 12 for i in range(48)}
    edges = [(i, j) for i in range(48) for j in range(i + 1, 48) if rng.random() < (0.6 if group[i] == group[j] else 0.03)]
    df = spark.createDataFrame(edges, "a long, b long")
    part = community.communities(df)
    found = {x.node: x.community for x in part.collect()}
    planted = spark.createDataFrame([(i, g) for i, g in group.items()], "node long, community int")
    q, best = community.modularity(df, part).first()[0], community.modularity(df, planted).first()[0]
    assert q >= best - 0.02
    near = defaultdict(set)
    for a, b in edges:
        if found[a] == found[b]:
            near[a].add(b)
            near[b].add(a)
    for c in set(found.values()):
        members = {n for n in found if found[n] == c}
        seen, todo = set(), [min(members)]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += near[n]
        assert seen == members


def test_provisional_counts_shortest_paths(spark):
    edges = [("x", "p"), ("x", "q"), ("p", "m1"), ("q", "m1"), ("q", "m2"), ("p", "q"), ("y", "x"), ("z", "z1")]
    members = [("m1", "c1"), ("m2", "c2")]
    got = community.assign_provisional(spark.createDataFrame([("x",), ("y",), ("z",)], "node string"), spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame(members, "node string, community_id string"))
    assert pairs(got, "node", "community_id", "distance", "paths") == [("x", "c1", 2, 2), ("y", "c1", 3, 2)]


def test_pick_by_weight(spark):
    """Three owners, quotas 4, 2 and 1; the second one's unused place goes to the first one's next chunk."""
    rows = [(1, o, o, k, f"{o}-{k}") for o, n in ((0, 6), (1, 1), (2, 3)) for k in range(n)] + [(2, 0, 0, k, f"s{k}") for k in range(9)]
    got = vector.pick_by_weight(spark.createDataFrame(rows, "query_id int, owner int, place int, pos int, chunk_id string"), 4)
    per = defaultdict(list)
    for x in sorted(got.collect(), key=lambda x: (x.query_id, x.turn)):
        per[x.query_id].append(x.chunk_id)
    assert per == {1: ["0-0", "0-1", "0-2", "0-3", "1-0", "2-0", "0-4"], 2: ["s0", "s1", "s2", "s3"]}


def test_vector_search(spark):
    """Exact search as one matrix and as blocks, with null, zero and short vectors; the approximate one finds at least nine in ten."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16))
    x = [(i, (centres[i % 12] + 0.5 * rng.standard_normal(16)).tolist()) for i in range(600)]
    rows = [*x, (9001, None), (9002, [0.0] * 16), (9003, [1.0, 2.0])]
    corpus = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    asked = spark.createDataFrame([*x[::30], (9003, [1.0, 2.0]), (9001, None)], "query_id long, qv array<double>")
    m = np.array([v for _, v in x])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = {i: sorted(((-float(m[i] @ m[j]), j) for j in range(600) if m[i] @ m[j] >= 0.2))[:10] for i, _ in x[::30]}
    exact = {(i, j) for i, own in want.items() for _, j in own} | {(9003, 9003)}
    assert set(pairs(vector.vector_topk(asked, corpus, 10), "query_id", "id")) == exact
    kept, vector.MATRIX = vector.MATRIX, 32
    try:
        assert set(pairs(vector.vector_topk(asked, corpus, 10), "query_id", "id")) == exact
    finally:
        vector.MATRIX = kept
    near = set(pairs(vector.vector_topk_ann(asked, corpus, 10, cells=12, probes=4), "query_id", "id"))
    assert len(near & exact) >= 0.9 * len(exact)
    assert vector.vector_topk(asked, corpus.limit(0), 10).count() == 0 == vector.vector_topk(asked.limit(0), corpus, 10).count()


def test_recursive_split(spark):
    long = "para one. it goes on\n\npara two " + "x" * 90 + " and some more words here. " * 8
    docs = spark.createDataFrame([(1, long), (2, ""), (3, None), (4, "short")], "doc_id long, text string")
    got = chunk.chunk_recursive(docs, 40, 0).orderBy("doc_id", "chunk_order_index").collect()
    assert all(len(x.content) <= 40 for x in got) and {x.doc_id for x in got} == {1, 4}
    assert "".join("".join(x.content.split()) for x in got if x.doc_id == 1) == "".join(long.split())
    for overlap in (40, 41):
        with pytest.raises(ValueError, match="overlap"):
            chunk.chunk_recursive(docs, 40, overlap)


def test_semantic_split(spark):
    d = [0.1, 0.1, 0.9, 0.1, 0.1, 0.8, 0.1, None]
    rows = spark.createDataFrame([(1, i, f"s{i}", x) for i, x in enumerate(d)], "doc_id long, pos int, sentence string, distance double")
    want = ["s0 s1 s2", "s3 s4 s5", "s6 s7"]
    content = lambda **k: [x.content for x in chunk.chunk_semantic(rows, **k).orderBy("chunk_order_index").collect()]
    assert content(kind="percentile", amount=0.7) == want
    assert content(kind="standard_deviation", amount=1.0) == want
    assert content(kind="interquartile", amount=0.5) == want
    assert content(kind="percentile", amount=0.7, least=100) == ["s0 s1 s2 s3 s4 s5 s6 s7"]
    assert content(kind="gradient", amount=0.7)[0] in ("s0 s1", "s0 s1 s2")
    with pytest.raises(ValueError, match="kind"):
        chunk.chunk_semantic(rows, kind="other")


def test_token_limit(spark):
    words = " ".join(f"w{i}" for i in range(25))
    rows = [(1, "a", 0, "One two three. Four five six. Seven."), (1, "b", 1, "short"), (1, "c", 2, words)]
    got = [(x.chunk_id, x.chunk_order_index, x.content) for x in chunk.enforce_token_limit(spark.createDataFrame(rows, "doc_id long, chunk_id string, chunk_order_index int, content string"), 5).orderBy("chunk_order_index").collect()]
    assert got[:3] == [("a-s01", 0, "One two three."), ("a-s02", 1, "Four five six. Seven."), ("b", 2, "short")]
    assert [c for _, _, c in got[3:]] == [" ".join(f"w{j}" for j in range(i, i + 5)) for i in range(0, 25, 5)]


def test_blocks_and_headings(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\ntext a\n## B\n\ntext b\n# C\n### D\ntext d"), (2, "")], "doc_id long, text string")
    got = chunk.heading_paths(chunk.to_blocks(docs)).orderBy("doc_id", "block").collect()
    assert [(x.doc_id, x.level, x.heading, x.path, x.content) for x in got] == [
        (1, 0, "", "", "intro"), (1, 1, "A", "A", "text a"), (1, 2, "B", "A → B", "text b"), (1, 1, "C", "C", ""), (1, 3, "D", "C → D", "text d"), (2, 0, "", "", ""),
    ]


def test_heading_budget(spark):
    """Arrows, invisible characters and long levels; the middle goes first, then the end."""
    rows = [(1, 0, 1, "Top \u2192 one\u200b"), (1, 1, 2, "Middle part of it"), (1, 2, 3, "L" * 30)]
    blocks = spark.createDataFrame([(*r, "") for r in rows], "doc_id long, block int, level int, heading string, content string")
    path = lambda budget: chunk.heading_paths(blocks, 12, budget).orderBy("block").collect()[2].path
    whole = "Top one → Middle part… → " + "L" * 11 + "…"
    assert path(None) == path(7) == whole
    assert path(6) == "Top one → … → " + "L" * 11 + "…"
    assert path(3) == "Top one…" and path(1) == "…"


def test_block_split_and_merge(spark):
    """Long blocks in parts, headings alone glued to what follows, small neighbours of one parent merged, references dropped, tables by rows."""
    long = "\n".join(f"paragraph {i} has five words" for i in range(8))
    table = "<table><tr><th>h</th></tr>" + "".join(f"<tr><td>row {i} of it</td></tr>" for i in range(12)) + "</table>"
    rows = [(1, 0, 1, "Top", ""), (1, 1, 2, "Long", long), (1, 2, 2, "S1", "tiny one"), (1, 3, 2, "S2", "tiny two"), (1, 4, 1, "Data", table), (1, 5, 1, "References", "[1] someone"), (2, 0, 1, "References", "only this")]
    blocks = spark.createDataFrame(rows, "doc_id long, block int, level int, heading string, content string")
    got = chunk.chunk_blocks(blocks, 20, drop_references=True).orderBy("doc_id", "chunk_order_index").collect()
    one = [x for x in got if x.doc_id == 1]
    assert all(x.tokens <= 20 for x in one if "<table>" not in x.content) and not any("someone" in x.content for x in one)
    parts = [x for x in one if "Long" in x.heading]
    assert len(parts) == 3 and parts[0].heading.startswith("Top") and all(f"[part {i}]" in x.heading for i, x in enumerate(parts, 1))
    assert any("tiny one" in x.content and "tiny two" in x.content for x in one)
    tables = [x.content for x in one if "<table>" in x.content]
    assert len(tables) > 1 and all("<th>h</th>" in t for t in tables) and sum(t.count("<td>") for t in tables) == 12
    assert [x.content for x in got if x.doc_id == 2] == ["only this"]
    assert chunk.chunk_blocks(blocks.limit(0), 20).count() == 0


def test_surrounding_context(spark):
    blocks = spark.createDataFrame([(1, 0, "before words one two three <item id='a'/> after words four five six"), (1, 1, "no item")], "doc_id long, block int, content string")
    items = spark.createDataFrame([(1, 0, "a", "<item id='a'/>"), (1, 1, "b", "<item id='b'/>")], "doc_id long, block int, item_id string, mark string")
    got = {x.item_id: (x.leading, x.trailing) for x in chunk.surrounding(items, blocks, 3, 2).collect()}
    assert got == {"a": ("one two three", "after words"), "b": ("", "")}


def test_delimiter_repairs(spark):
    """Prose between spaces stays; every damaged form becomes whole."""
    damaged = ["<|##|>", "<|#||#|>", "<|#|||#|>", "<|\\#|>", "<|>", "<||>", "<X|#|>", "<|#|Y>", "<||#||>", "<#>", "<#|>", "<|#>", "<X#|>", "<|#X>", "<|#|", "<|#||", "<|#:", "<||#>", "|#|>", "||#||"]
    rows = [(f"entity{d}Name", "entity<|#|>Name") for d in damaged] + [("a <|> b", "a <|> b"), ("if (x <|| y) then", "if (x <|| y) then"), ("name<||type", "name<|#|>type")]
    df = spark.createDataFrame(rows, "raw string, want string").withColumn("got", text.repair_delimiters(F.col("raw")))
    assert [(x.raw, x.got) for x in df.collect() if x.got != x.want] == []


def test_stop_words():
    assert set("into its their what which".split()) - set(text.STOP_WORDS) == {"which"} and len(text.STOP_WORDS) == 25


def test_subgraph_is_cut_where_it_grows(spark):
    edges = spark.createDataFrame([("s", f"n{i}", 1.0) for i in range(9)] + [(f"n{i}", f"m{i}", 1.0) for i in range(9)] + [("n3", "m4", 1.0)], "a string, b string, weight double")
    nodes, inner = graph.subgraph(edges, spark.createDataFrame([(1, "s"), (2, "alone")], "query_id long, node string"), 3, 4)
    got = [(x.query_id, x.node, x.level, x.rank, x.is_truncated) for x in nodes.orderBy("query_id", "rank").collect()]
    assert got == [(1, "s", 0, 1, True), (1, "n3", 1, 2, True), (1, "n0", 1, 3, True), (1, "n1", 1, 4, True), (2, "alone", 0, 1, False)]
    assert inner.count() == 3


def test_empty_tables_and_nulls(spark):
    """Merges of nothing, of null sources and keywords, and interleaving of lists that share keys."""
    stored = spark.createDataFrame([("a", "b", 2.0, ["k"], ["s1"])], "a string, b string, weight double, keywords array<string>, source_ids array<string>")
    new = spark.createDataFrame([("b", "a", 1.0, "j", "s1", 1), ("a", "b", 1.0, None, None, 2), ("a", "b", 3.0, "k", "s2", 3), ("a", "b", 9.0, "k", "s2", 4), ("c", "a", 1.0, None, "", 5)], "src string, tgt string, weight double, keyword string, source_id string, seq long")
    got = {(x.a, x.b): (x.weight, x.keywords, x.source_ids) for x in merge.merge_relations(stored, new).collect()}
    assert got == {("a", "b"): (14.0, ["j", "k"], ["s1", "s2"]), ("a", "c"): (0.0, [], [])}
    assert [(x.a, x.weight) for x in merge.merge_relations(stored, new.limit(0)).collect()] == [("a", 2.0)]
    one = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, id string, pos int")
    assert [(x.id, x.pos) for x in r.interleave([one, one.filter("id = 'y'").withColumn("pos", F.lit(1))], "id").orderBy("pos").collect()] == [("x", 1), ("y", 2)]


def test_snapshots_are_published_and_rolled_back(spark, tmp_path):
    """Readers see the snapshot whose publication has the highest seq, staged ones not at all."""
    path = str(tmp_path)
    members = lambda c: spark.createDataFrame([("n1", c), ("n2", c)], "node string, community_id string")
    community.stage_snapshot(members("c1"), path, "s1")
    community.publish_snapshot(members("c1"), path, "s1", 1)
    community.stage_snapshot(members("c2"), path, "s2")
    seen = lambda: {x.community_id for x in community.published(spark, path).collect()}
    assert seen() == {"c1"}
    community.publish_snapshot(members("c2"), path, "s2", 2)
    assert seen() == {"c2"}
    community.publish_snapshot(members("c1"), path, "s1", 3)
    assert seen() == {"c1"}


def test_graph_export(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a", "x, \"y\"")], "node string, description string"), spark.createDataFrame([("a", "b", 1.5)], "a string, b string, weight double")
    for fmt in ("parquet", "json", "csv"):
        tables.export_graph(nodes, edges, str(tmp_path / fmt), fmt)
        back = spark.read.format(fmt).option("header", True).option("inferSchema", True).load(str(tmp_path / fmt / "edges")).collect()
        assert [(x.a, x.b, float(x.weight)) for x in back] == [("a", "b", 1.5)]
        assert spark.read.format(fmt).option("header", True).option("escape", "\\").load(str(tmp_path / fmt / "nodes")).count() == 1


def test_spans_meet_by_bins(spark):
    """The interval join against all pairs: empty spans, spans over many bins, borders on bins; blocks of one long document."""
    rng = np.random.default_rng(9)
    made = lambda n, k: [(int(d), k + i, int(a), int(a + w)) for i, (d, a, w) in enumerate(zip(rng.integers(0, 3, n), rng.integers(0, 400, n), rng.choice([0, 1, 7, 16, 90], n), strict=True))]
    left, right = made(80, 0), made(80, 1000)
    got = chunk.overlaps(spark.createDataFrame(left, "doc_id int, x int, s int, e int"), spark.createDataFrame(right, "doc_id int, y int, b0 int, b1 int"), "doc_id", ("s", "e"), ("b0", "b1"), 16)
    assert pairs(got, "x", "y") == sorted((i, j) for d, i, s, e in left for g, j, a, b in right if d == g and s < b and a < e)
    blocks = [(1, k, "x" * (k % 5)) for k in range(400)]
    starts = np.cumsum([0] + [len(c) + 1 for _, _, c in blocks]).tolist()
    parts = [(1, f"c{k}", k * 30, k * 30 + 40) for k in range(40)]
    found = {r.chunk_id: r.refs for r in chunk.attribute_blocks(spark.createDataFrame(parts, "doc_id int, chunk_id string, start int, end int"), spark.createDataFrame(blocks, "doc_id int, block int, content string")).collect()}
    for _, c, s, e in parts:
        assert found.get(c, []) == [k for k in range(400) if s < starts[k] + len(blocks[k][2]) and starts[k] < e]


def test_numbers_beyond_their_pads(spark):
    """Chunk 1000 beside chunk 100, part 100 beside part 10; owners without sources; rows without status."""
    from memloom.operators import ingest, maintain

    rows = [("d", None, k, "x") for k in (7, 100, 1000)]
    got = ingest.build_chunk_rows(spark.createDataFrame(rows, "doc_id string, given_id string, chunk_order_index int, content string"))
    assert {r.chunk_id for r in got.collect()} == {"d-chunk-007", "d-chunk-100", "d-chunk-1000"}
    parts = chunk.enforce_token_limit(spark.createDataFrame([("d", "c", 0, " ".join("w" for _ in range(240)))], "doc_id string, chunk_id string, chunk_order_index int, content string"), 2)
    ids = [r.chunk_id for r in parts.collect()]
    assert len(ids) == len(set(ids)) == 120 and {"c-s09", "c-s99", "c-s100", "c-s120"} <= set(ids)
    plan = maintain.plan_purge(spark.createDataFrame([("a", ["s1"]), ("b", []), ("c", None), ("d", ["s1", "s2"])], "owner string, source_ids array<string>"), spark.createDataFrame([("s1",)], "source_id string"))
    assert pairs(plan, "owner", "action") == [("a", "delete"), ("b", "delete"), ("c", "delete"), ("d", "rebuild")]
    counts = maintain.status_counts(spark.createDataFrame([("x",), (None,), (None,)], "status string"))
    assert sorted(((r.status, r.n) for r in counts.collect()), key=str) == [("all", 3), ("x", 1), (None, 2)]


def test_reference_headings_end_with_the_word(spark):
    rows = [(1, k, h, "text") for k, h in enumerate(["Intro", "Referenced work", "References", "BIBLIOGRAPHY: all", "参考文献列表"])]
    kept = chunk.drop_reference_blocks(spark.createDataFrame(rows, "doc_id int, block int, heading string, content string"))
    assert sorted(r.heading for r in kept.collect()) == ["Intro", "Referenced work"]


def test_damaged_json(spark):
    """What models write around and into an object; a list at the top is none; sound rows are read as before."""
    from memloom.functions.repair import recovered

    good = {
        '{"a": 1}': {"a": 1}, '```json\n{"a": 1}\n```': {"a": 1}, 'Result #1: {"a":1}': {"a": 1}, "Here's the note: {\"a\":1}": {"a": 1}, '{"f":["x"]} trailing {brace}': {"f": ["x"]},
        '{"a":1,}': {"a": 1}, "{'a':1}": {"a": 1}, "{a:1}": {"a": 1}, '{"a":1': {"a": 1}, '{"a":1,} [1]': {"a": 1}, '{"a": 1 "b": 2}': {"a": 1, "b": 2}, "{b: it's fine, c: O'Reilly}": {"b": "it's fine", "c": "O'Reilly"},
        '{"a": [1, {"b": "x': {"a": [1, {"b": "x"}]}, "{'a': 'x } y', 'b': [\"q\" \"r\"]}": {"a": "x } y", "b": ["q", "r"]}, '{"a": tru': {"a": "tru"}, '{"a": "x\ny"}': {"a": "x\ny"}, "{}": {},
    }
    assert {t: json.loads(recovered(t)) for t in good} == good
    assert not any(recovered(t) for t in ('[{"a":1},{"b":2}]', 'Here it is: [{"a":1}]', "['note', {\"a\":1}]", '[}{"a":1}]', '"oops [}{"a":1}]', '{note} [{"a":1}]', 'analysis: [draft] {"a":1}', "", None, "none"))
    e = '{"name": "A", "type": "t", "description": "d"}'
    texts = ['{"entities": [' + e + ']}', '{"entities": [' + e + ', {"name": "B", "ty', "{'entities': [{'name': 'A', 'type': 't', 'description': 'd'},]} and {more}", '[{"entities": [' + e + "]}]", "{entities: [{name: A type: t}]}", None]
    ents, _, errors = merge.parse_extractions_json(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, result string"))
    assert pairs(ents, "chunk_id", "name", "description") == [("0", "A", "d"), ("1", "A", "d"), ("2", "A", "d"), ("4", "A type", "t")] or pairs(ents, "chunk_id", "name") == [("0", "A"), ("1", "A"), ("2", "A"), ("4", "A type")]
    assert pairs(errors, "chunk_id") == [("3",), ("5",)]


def test_groups_of_one_owner_in_many_tasks(spark):
    """Running sums of an owner with most of all parts against a plain loop; null owners, owners of one part."""
    rng = np.random.default_rng(4)
    rows = [("hot", k, " ".join(["w"] * int(rng.integers(1, 9)))) for k in range(900)] + [(f"o{k % 9}", k, "one two") for k in range(40)] + [(None, 5, "x"), (None, 6, "y z")]
    got = merge.plan_summaries(spark.createDataFrame(rows, "owner string, pos long, description string").repartition(6), 8, 1200, 50)
    want = defaultdict(list)
    for owner in {r[0] for r in rows}:
        own = sorted((p, d) for o, p, d in rows if o == owner)
        plain, at = len(own) < 8 and sum(len(d.split()) for _, d in own) < 1200, 0
        for _, d in own:
            want[owner, "join" if plain else "summarize", 0 if plain else at // 50].append(d)
            at += len(d.split())
    assert {(r.owner, r.mode, r.group): r.descriptions for r in got.collect()} == want


def test_entities_by_their_best_row(spark):
    """R5 against all pairs: entities of one row and of many, equal rows; as one matrix and as blocks."""
    from memloom.operators import resolve

    rng = np.random.default_rng(6)
    centres = rng.standard_normal((20, 8))
    rows = [(f"e{i % 20}", (centres[i % 20] + 0.3 * rng.standard_normal(8)).tolist()) for i in range(300)] + [("e3", centres[5].tolist())] * 3
    names = [(f"n{i}", (centres[i] + 0.1 * rng.standard_normal(8)).tolist()) for i in range(12)]
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = set()
    for n, q in names:
        best = defaultdict(lambda: -1.0)
        for e, v in rows:
            best[e] = max(best[e], float(unit(v) @ unit(q)))
        want |= {(n, e, k + 1) for k, (_, e) in enumerate(sorted((-s, e) for e, s in best.items() if s >= 0.3)[:4])}
    df, asked = spark.createDataFrame(rows, "entity_id string, v array<double>").repartition(3), spark.createDataFrame(names, "name string, qv array<double>")
    assert set(pairs(resolve.candidates_vector(asked, df, 4, 0.3), "name", "entity_id", "rank")) == want
    kept, vector.MATRIX = vector.MATRIX, 8
    try:
        assert set(pairs(resolve.candidates_vector(asked, df, 4, 0.3), "name", "entity_id", "rank")) == want
    finally:
        vector.MATRIX = kept


def test_nested_and_json_tables(spark):
    """A table in a cell stays in its row, rows without an end, wrappers come again, JSON rows; plain tables as before."""
    inner = "<table><tr><td>in a</td></tr><tr><td>in b</td></tr></table>"
    body = "".join(f"<tr><td>row {k} {inner if k == 1 else 'x y z'}</td></tr>" for k in range(6))
    nested = f"before <table class='t'><thead><tr><td>head of it</td></tr></thead><tbody>{body}</tbody></table> after"
    listed = '<table id="j" format="json">' + json.dumps([[f"cell {k} one", f"two {k} é"] for k in range(7)], ensure_ascii=False) + "</table>"
    loose = "<table><tr><th>a b c<tr><td>1 2 3 4<tr><td>5 6 7 8<tr><td>9 10 11 12</table>"
    plain = "<table>" + "".join(f"<tr><td>p {k} q r</td></tr>" for k in range(4)) + "</table>"
    rows = [(1, k, None, t) for k, t in enumerate([nested, listed, loose, plain, "no table", "<table>[broken</table>", "open <table><tr><td>a b c d e f g h i</td></tr><tr><td>j</td></tr>"])]
    parts = defaultdict(list)
    for r in sorted(chunk.split_tables(spark.createDataFrame(rows, "doc_id int, block int, heading string, content string"), 8).collect(), key=lambda r: (r.block, r.part)):
        assert r.doc_id == 1 and r.heading is None
        parts[r.block].append(r.content)
    first, *tables_, last = parts[0]
    assert (first.strip(), last.strip()) == ("before", "after") and len(tables_) > 2
    assert all(t.startswith("<table class='t'><thead><tr><td>head of it</td></tr></thead><tbody><tr>") and t.endswith("</tbody></table>") for t in tables_)
    assert sum(inner in t for t in tables_) == 1 and "".join(t.split("<tbody>")[1].removesuffix("</tbody></table>") for t in tables_) == body
    got = [json.loads(t.removeprefix('<table id="j" format="json">').removesuffix("</table>")) for t in parts[1]]
    assert len(got) > 1 and sum(got, []) == [[f"cell {k} one", f"two {k} é"] for k in range(7)]
    assert len(parts[2]) > 1 and all(t.startswith("<table><tr><th>a b c</tr><tr><td>") for t in parts[2]) and len(parts[3]) > 1
    assert parts[4] == ["no table"] and parts[5] == ["<table>[broken</table>"] and len(parts[6]) == 3


def test_random_refinement(spark):
    """Leiden with theta on planted groups: not below plain moving, communities connected, the same on a rerun."""
    rng = np.random.default_rng(12)
    group = {i: i // 10 for i in range(50)}
    edges = [(i, j) for i in range(50) for j in range(i + 1, 50) if rng.random() < (0.6 if group[i] == group[j] else 0.03)]
    df = spark.createDataFrame(edges, "a long, b long")
    part = community.communities(df, theta=0.01)
    q = community.modularity(df, part).first()[0]
    assert q >= community.modularity(df, community.communities(df)).first()[0] - 0.005
    found = {x.node: x.community for x in part.collect()}
    assert found == {x.node: x.community for x in community.communities(df, theta=0.01).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if found[a] == found[b]:
            near[a].add(b)
            near[b].add(a)
    for c in set(found.values()):
        members = {n for n in found if found[n] == c}
        seen, todo = set(), [min(members)]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += near[n]
        assert seen == members


def test_long_blocks_are_cut_at_short_lines(spark):
    """Parts of nearly equal size that begin with a short line and are headed by it; a part without one is packed."""
    body = lambda n: " ".join(f"word{n}x{i}" for i in range(30))
    lines = ["start of it", body(0), body(1), "Method", body(2), body(3), "Results", body(4), body(5), "Outlook", body(6)]
    dense = "\n".join(body(k) for k in range(10, 16))
    rows = [(1, 0, 2, "Long", "\n".join(lines)), (1, 1, 2, "Dense", dense), (1, 2, 2, "", "A\n" + " ".join(["w"] * 300))]
    got = chunk.chunk_blocks(spark.createDataFrame(rows, "doc_id long, block int, level int, heading string, content string"), 100).orderBy("chunk_order_index").collect()
    one = [x for x in got if x.blocks == [0]]
    assert [x.heading for x in one] == ["Long [part 1]", "Long → Method [part 2]", "Long → Results [part 3]"] and [x.content.split("\n")[0] for x in one] == ["start of it", "Method", "Results"]
    assert "\n".join(x.content for x in one) == "\n".join(lines)
    assert all(x.tokens <= 100 for x in got) and "\n".join(x.content for x in got if x.blocks == [1]) == dense
    assert sum(x.tokens for x in got if x.blocks == [2]) == 301
