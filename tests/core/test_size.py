"""What keeps work and memory in proportion to the input: plans and counts of rows on small made cases."""

import random

from pyspark.sql import functions as F

from memloom.operators import resolve


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lexical_candidates_broadcast_no_texts(spark, tmp_path):
    """Tables that weigh little as files may hold many texts: their parts are not sent to the driver."""
    texts = [(f"e{i}", f"supplier #{i:04}") for i in range(40)]
    spark.createDataFrame(texts, "entity_id string, normalized_alias string").write.parquet(f"{tmp_path}/a")
    aliases = spark.read.parquet(f"{tmp_path}/a")
    names = aliases.select(F.col("normalized_alias").alias("name"))
    assert "Broadcast" not in plan(resolve.candidates_lexical(names, aliases))
    assert "Broadcast" not in plan(resolve.candidates_lexical(names, aliases, most=2))


def test_lexical_candidates_of_texts_that_begin_alike(spark):
    """Texts of many lengths, longer than the longest run too, with equal beginnings, repeated parts and code points beyond the BMP."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab\U0001f600") for _ in range(rng.choice((1, 2, 3, 5, 9))))
    al = [(f"e{i % 70}", ("aaaaaaaaaaaaaaaaaaaa" if i % 9 == 0 else "") + word()) for i in range(160)] + [("e1", ""), ("e2", None), (None, "ab")]
    q = sorted({a for _, a in al[::3] if a} | {word() for _ in range(40)} | {"a" * 17, "a" * 21, "x" + "a" * 20 + "bb"})
    got = resolve.candidates_lexical(spark.createDataFrame([(x,) for x in q], "name string"), spark.createDataFrame(al, "entity_id string, normalized_alias string"))
    want = {(n, e, 1.0 if n == a else 0.8, a) for n in q for e, a in al if a and (a in n or n in a)}
    rows = [tuple(r) for r in got.select("name", "entity_id", "score", "normalized_alias").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    got = resolve.candidates_lexical(spark.createDataFrame([(x,) for x in q], "name string"), spark.createDataFrame(al, "entity_id string, normalized_alias string"), most=3)
    first = {r for n in q for r in sorted((w for w in want if w[0] == n), key=lambda w: (-w[2], len(w[3]), w[3].encode(), w[1] is not None, w[1] or ""))[:3]}
    rows = [tuple(r) for r in got.select("name", "entity_id", "score", "normalized_alias").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == first


def test_history_candidates_meet_few_scores(spark, monkeypatch):
    """A07's query scores a few atoms of an owner for each new one, not every pair of them."""
    from memloom.operators import atoms
    from memloom.plans import catalog

    seen = []
    plain = atoms.history_candidates
    monkeypatch.setattr(atoms, "history_candidates", lambda new, old, score, at: seen.append((new.count(), score.count())) or plain(new, old, score, at))
    catalog.QUERIES["a07_history_candidates"](spark, "/root/testdata/sf0.01")
    new, scores = seen[0]
    assert new > 50 and scores <= atoms.TOP * new


def test_copies_of_query_blocks_are_no_broadcast(spark, monkeypatch):
    """Queries that are a table of blocks go to every share of the vectors by a shuffle; results are those of one matrix."""
    from memloom.operators import vector
    from memloom.plans import views as v

    sf = "/root/testdata/sf0.001"
    rows = lambda df: sorted((r.query_id, r.id, r.rank, round(r.score, 9)) for r in df.collect())
    whole = rows(vector.vector_topk(v.queries(spark, sf), v.vectors(spark, sf), 5))
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    assert rows(vector.vector_topk(v.queries(spark, sf), v.vectors(spark, sf), 5)) == whole
    monkeypatch.setattr(vector, "QUERIES", 0)
    got = vector.vector_topk(v.queries(spark, sf), v.vectors(spark, sf), 5)
    assert "Broadcast" not in plan(got)
    assert rows(got) == whole


def test_approximate_search_multiplies_blocks(spark):
    """Vectors of a cell and the queries that ask it meet as blocks, not as a row for each pair."""
    from memloom.operators import vector
    from memloom.plans import views as v

    sf = "/root/testdata/sf0.001"
    got = vector.vector_topk_ann(v.queries(spark, sf), v.vectors(spark, sf), 5, cells=4, probes=4)
    assert "vs" in plan(got) and "qs" in plan(got) and "zip_with" not in plan(got)
    rows = lambda df: sorted((r.query_id, r.id, r.rank, round(r.score, 9)) for r in df.collect())
    assert rows(got) == rows(vector.vector_topk(v.queries(spark, sf), v.vectors(spark, sf), 5))  # all cells are asked


def test_parsed_records_are_made_once(spark):
    """X1 and X2 read and parse their input once, not once for each kind of record."""
    from memloom.plans import catalog

    for name in ("x01_parse_extractions", "x02_parse_json"):
        assert plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")).count("FileScan parquet") == 1, name


def test_quick_ways_of_names_and_separators_equal_the_patterns(spark):
    """Texts without marks, of ASCII only, or without damage take a short way with the same results."""
    import functools

    from memloom.functions import text

    rng = random.Random(3)
    made = ["".join(rng.choice(("<|#|>", "<", ">", "|", "#", "\\", "a", " ", "<|COMPLETE|>", "<X|#|>")) for _ in range(rng.randrange(1, 9))) for _ in range(600)]
    df = spark.createDataFrame([(x,) for x in made], "x string")
    plain = functools.reduce(lambda c, d: F.regexp_replace(c, d.replace("#", "\\Q#\\E"), "<|#|>"), text.DAMAGED, F.col("x"))
    assert not df.select(text.repair_delimiters(F.col("x")).alias("got"), plain.alias("want"), "x").filter("got <> want").collect()
    names = {'"a b"': "a b", "'x'\n": "x", '"\'y\'"': "y", ' "z" ': '"z"', "12": None, "1.5": None, "1.5000": "1.5000", "<p>ab</p> ": "ab", "\u3000中 文": "中文", "\x1cq": "\x1cq", "": ""}
    got = spark.createDataFrame([(x,) for x in names], "x string").select("x", text.normalize_extracted(F.col("x"), inner_quotes=True).alias("n"))
    assert {r.x: r.n for r in got.collect()} == names


def test_visited_relations_are_those_of_the_edges(spark, monkeypatch):
    """G10's queries tell each nation of its own suppliers' relations: as many rows as edges at most, not nations times edges."""
    from memloom.operators import explore, graph
    from memloom.plans import catalog

    seen = []
    names, expand = explore.expand_names, graph.expand
    monkeypatch.setattr(explore, "expand_names", lambda f, n, edges, sn, told, *more: seen.append((told.count(), edges.count())) or names(f, n, edges, sn, told, *more))
    monkeypatch.setattr(graph, "expand", lambda f, edges, sn, told, cap: seen.append((told.count(), edges.count())) or expand(f, edges, sn, told, cap))
    for name in ("g10_names", "g10_candidates", "g10_expand"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(seen) == 3 and all(0 < told <= edges for told, edges in seen)


def test_rebuild_order_shuffles_its_relations_once(spark):
    """M2's query makes its distinct relations once, not once for each step that reads them."""
    from memloom.plans import catalog

    assert plan(catalog.QUERIES["m02_rebuild_order"](spark, "/root/testdata/sf0.001")).count("lineitem.parquet") == 0


def test_wanted_candidates_are_those_of_all(spark):
    """A5 and A7 asked for some pairs give those of them that are candidates, and make no other pairs."""
    from memloom.operators import atoms

    rng = random.Random(7)
    rows = [(f"a{i}", i % 3, "o" if i < 45 else f"o{i % 5}", i, "c", None, None, None) for i in range(70)]
    shape = "atom_id string, episode_id long, owner_id string, seq long, content string, valid_at timestamp, invalid_at timestamp, expired_at timestamp"
    df = spark.createDataFrame(rows, shape)
    ids = [r[0] for r in rows]
    pairs = lambda n: spark.createDataFrame(sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(n)}), "atom_id string, candidate_id string")
    similar, wanted = pairs(900).withColumn("score", F.lit(0.9)), pairs(1500)
    asked = {tuple(r) for r in wanted.collect()}
    new, old = df.filter("seq % 2 = 0"), df.filter("seq % 2 = 1")
    for run in (lambda w: atoms.in_batch_candidates(df, similar, w), lambda w: atoms.history_candidates(new, old, similar, F.lit("2024-01-01").cast("timestamp"), w)):
        some = [tuple(r) for r in run(wanted).collect()]
        assert len(some) == len(set(some)) and set(some) == {tuple(r) for r in run(None).collect()} & asked and some
    assert "explode" not in plan(atoms.in_batch_candidates(df, similar, wanted))


def test_searches_run_once_for_all_that_read_them(spark):
    """Q6, Q7 and Q14 read their hits several times: the search is not repeated for each."""
    from memloom.plans import catalog

    for name in ("q06_interleave", "q07_modes", "q14_structured"):
        assert "MapInArrow" not in plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_texts_are_cut_into_words_once(spark):
    """C7 and Q17 cut a text once: the pattern stands in the plan's own step, not in what is done for each window or piece."""
    from memloom.operators import chunk, retrieve

    df = spark.createDataFrame([(1, 2, "a b  c d e.  f g")], "query_id long, doc long, content string")
    got = retrieve.rerank_split(df, 3, 1)
    assert [r.content for r in got.orderBy("window").collect()] == ["a b c", "c d e.", "e. f g", "g"]
    assert plan(got).count("split(content") == 1
    c = df.select(F.col("doc").alias("doc_id"), F.lit("c").alias("chunk_id"), F.lit(0).alias("chunk_order_index"), "content")
    assert [r.content for r in chunk.enforce_token_limit(c, 5).orderBy("chunk_order_index").collect()] == ["a b c d e.", "f g"]
    assert plan(chunk.enforce_token_limit(c, 5)).count("split(") < 5
    assert not chunk.enforce_token_limit(c.withColumn("content", F.lit(None).cast("string")), 5).count()


def test_owner_chunks_sort_rows_once_a_shuffle(spark):
    """Q8's query deals and sorts the rows by chunk and by owner only, in partitions that adaptive execution does not merge; chunks
    that stand twice, and two owners of one chunk, are as in arrays of sources."""
    from memloom.operators import retrieve
    from memloom.plans import catalog

    text = plan(catalog.QUERIES["q08_owner_chunks"](spark, "/root/testdata/sf0.001"))
    assert text.count("Exchange hashpartitioning") == text.count("REPARTITION_BY_NUM") == 2 and text.count("Sort [") == 2
    rng = random.Random(3)
    sources = {(q, o): [rng.randrange(9) for _ in range(rng.randrange(1, 12))] for q in range(3) for o in range(4)}
    got = retrieve.owner_chunks(spark.createDataFrame([(q, o, o, s) for (q, o), s in sources.items()], "query_id long, owner long, place long, source_ids array<long>"))
    want = set()
    for q in range(3):
        rows = [(o, i, c) for o in range(4) for i, c in enumerate(sources[q, o])]
        n = {c: sum(x == c for _, _, x in rows) for _, _, c in rows}
        first = {c: min((o, i) for o, i, x in rows if x == c) for c in n}
        for o in range(4):
            own = sorted((-n[c], i, c) for c, (at, i) in first.items() if at == o)
            want |= {(q, o, c, -f, p) for p, (f, _, c) in enumerate(own)}
    assert {(r.query_id, r.owner, r.chunk_id, r.frequency, r.pos) for r in got.collect()} == want


def test_metrics_keep_their_partitions(spark):
    """E4's query deals its pairs into all shuffle partitions: no task gets more because of how many cores there are."""
    from memloom.plans import catalog

    text = plan(catalog.QUERIES["e04_metrics"](spark, "/root/testdata/sf0.001"))
    assert text.count("REPARTITION_BY_NUM") == 2


def test_communities_broadcast_no_nodes(spark, monkeypatch):
    """D1's rounds send no table of nodes through the driver, however little it weighs as a file."""
    from memloom.operators import community

    seen, plain = [], community.write_through
    monkeypatch.setattr(community, "write_through", lambda df, label, *by: seen.append(plan(df)) or plain(df, label, *by))
    edges = spark.createDataFrame([(g * 10 + i, g * 10 + j) for g in range(2) for i in range(4) for j in range(i)] + [(0, 10)], "a long, b long")
    out = community.communities(edges, levels=1)
    assert len({r.community for r in out.collect() if r.node < 10}) == len({r.community for r in out.collect() if r.node >= 10}) == 1
    assert sum("Join" in p for p in seen) >= 3 and not any("Broadcast" in p for p in [*seen, plan(out)])


def test_chunks_of_blocks_make_no_frame_for_each_document(spark):
    """C5 takes batches of documents; one data frame for each of them costs more than its chunks."""
    from memloom.operators import chunk

    blocks = spark.createDataFrame([(d, 0, 1, f"h{d}", f"text {d}") for d in range(5)] + [(1, 1, 2, "sub", "more")], "doc_id long, block int, level int, heading string, content string")
    out = chunk.chunk_blocks(blocks, 50)
    assert "FlatMapGroups" not in plan(out) and "MapInArrow" in plan(out)
    assert [(r.doc_id, r.content, r.blocks) for r in sorted(out.collect())][:2] == [(0, "text 0", [0]), (1, "text 1\nmore", [0, 1])]


def test_tables_are_split_in_one_pass(spark):
    """C6 makes its blocks once, for the patterns and for the scanner of tags; both kinds of block keep their parts in order."""
    from memloom.operators import chunk

    row = lambda i: f"<TR><td>a{i} b c d</td></tr>"
    plain = f"before <table><tr><TH>h</th></tr>{''.join(map(row, range(4)))}</table> after"
    docs = [(1, 0, plain), (2, 0, plain.replace("</tr>", "")), (3, 0, None), (4, 0, "no table"), (5, 0, "")]
    out = chunk.split_tables(spark.createDataFrame(docs, "doc_id long, block int, content string").repartition(2), 9)
    text = plan(out)
    assert "Union" not in text and text.count("ArrowEvalPython") == 1
    got = {d: [r.content for r in sorted(out.filter(F.col("doc_id") == d).collect(), key=lambda r: r.part)] for d in range(1, 6)}
    head = "<table><tr><TH>h</th></tr>"
    assert got[1] == ["before ", f"{head}{row(0)}{row(1)}</table>", f"{head}{row(2)}{row(3)}</table>", " after"]
    assert len(got[2]) == 4 and got[2][0] == "before " and got[2][3] == " after" and got[3] == got[5] == [] and got[4] == ["no table"]
