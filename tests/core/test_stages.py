"""Stages that a caller replaces: tokenizer, chunker, admission, and the commit of a wave."""

from memloom.operators import chunk, commit, stages
from pyspark.sql import functions as F

from .test_commit import committed, made

LETTERS = chunk.Tokenizer(lambda text: F.filter(F.split(text, ""), lambda x: x != ""), "")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_tokenizer(spark):
    docs = spark.createDataFrame([(1, "abcdefg hi"), (2, "")], "doc_id int, text string")
    assert rows(chunk.chunk_fixed(docs, 4, 1, LETTERS), "content", "tokens") == [("abcd", 4), ("defg", 4), ("g hi", 4), ("i", 1)]
    assert rows(chunk.chunk_by_delimiter(docs, "d", 4, 0, tokenizer=LETTERS)[0], "content") == [("abc",), ("efg ",), ("hi",)]
    parts = chunk.enforce_token_limit(spark.createDataFrame([(1, "c", 0, "abcdefg. hi")], "doc_id int, chunk_id string, chunk_order_index int, content string"), 4, LETTERS)
    assert rows(parts, "chunk_id", "content") == [("c-s01", "abcd"), ("c-s02", "efg."), ("c-s03", "hi")]


def test_chunker_and_admission(spark):
    docs = spark.createDataFrame([("d1", "a/x.txt", "one two. three", 1), (None, "b/x.txt", "other", 2), ("d3", "c/y.txt", "one two. three", 3), ("skip", "e/z.txt", "gone", 4)], "given_id string, file_path string, content string, seq int")
    chunks, double = stages.ingest_documents(docs.filter("given_id is distinct from 'skip'"))
    assert rows(chunks, "chunk_id", "content") == [("d1-chunk-000", "one two. three")] and len(rows(double, "kind")) == 2
    by_sentence = lambda df: chunk.sentences(df).select("doc_id", F.col("pos").alias("chunk_order_index"), F.upper("sentence").alias("content"))
    admit = lambda df: df.filter("given_id is distinct from 'skip'").withColumn("doc_id", F.coalesce("given_id", F.lit("none")))
    chunks, _ = stages.ingest_documents(docs, by_sentence, admit, 3, LETTERS)
    assert rows(chunks, "content") == [(" TH",), (" TW",), ("EE",), ("O.",), ("ONE",), ("R",)] or {c for (c,) in rows(chunks, "content")} >= {"ONE"}
    assert all(len(c) <= 3 for (c,) in rows(chunks, "content"))


def test_another_commit_of_a_wave(spark, monkeypatch):
    """A stage that refuses all facts takes the place of the library's own."""
    seen = []

    def quiet(state, mentions, edges, new_facts, edge_facts, *rest):
        seen.append(new_facts.count())
        return commit.commit_wave(state, mentions, edges, new_facts.limit(0), None, *rest)

    whole = commit.commit_episodes
    monkeypatch.setattr(commit, "commit_episodes", lambda *a: whole(*a[:9], stage=quiet))
    given = made(11, 2)
    out = committed(spark, *given)
    assert sum(seen) > 0 and {r.atom_id for r in out["atoms"].collect()} == set(given[1])
