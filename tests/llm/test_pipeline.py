"""The pipeline, stage by stage, against plain Python on what each stage was given."""

from collections import Counter

import corpus_pipeline
import sentencepiece
from memloom.llm import mixing, quality, simhash
from memloom.llm.common import cut, ordinal, table, tokenizer_file
from pyspark.sql import functions as F

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), f"test-{name}")
        kept[name] = docs
        if name != "pieces":
            assert docs.columns == columns
    rows = {n: d.collect() for n, d in kept.items()}

    scores = quality.score(kept[""], quality.learn(kept[""], table(spark, SF, "labels"))).collect()
    assert {r.doc_id for r in rows["quality"]} == {r.doc_id for r in scores if r.score >= quality.THRESHOLD}

    grams = {r.doc_id: set(simhash.shingle_hashes(r.text, 5).tolist()) for r in rows["quality"]}
    near = [(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    groups = brute.golden_components(list(grams), near)
    assert {r.doc_id for r in rows["near_duplicates"]} == set(groups.values())

    before = {r.doc_id: r.text for r in rows["near_duplicates"]}
    for r in rows["secrets"]:
        spans = [s for s in brute.base_secrets(before[r.doc_id])[4].split(",") if s]
        assert all(before[r.doc_id][int(a) : int(b)] not in r.text for _, a, b in (s.split(":") for s in spans))
        assert spans or "[secret]" in r.text or r.text == before[r.doc_id]
    assert len(rows["secrets"]) == len(rows["near_duplicates"])

    sizes, taken = Counter(), Counter()
    for r in rows["secrets"]:
        sizes[r.source] += len(brute.WORD.findall(r.text or ""))
    for r in rows["mix"]:
        taken[r.source] += len(brute.WORD.findall(r.text))
    largest = max(len(brute.WORD.findall(r.text or "")) for r in rows["secrets"])
    assert all(abs(taken[s] - t) <= largest for s, t in brute.mix_targets(sizes).items())
    assert max(Counter(r.doc_id for r in rows["mix"]).values()) <= 2

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())
    texts = {r.doc_id: r.text for r in rows["mix"]}
    assert len(rows["pieces"]) == len(rows["mix"])
    assert all(r.ids == lib.encode(texts[r.doc_id]) and r.round_trip for r in rows["pieces"])
    plan = {r.doc_id: list(r.positions) for r in mixing.mix(kept["secrets"]).collect()}
    turns = Counter()
    order = []
    for r in sorted(rows["pieces"], key=lambda r: r.position):
        order.append(plan[r.doc_id][turns[r.doc_id]])
        turns[r.doc_id] += 1
    assert order == sorted(order) and len({r.position for r in rows["pieces"]}) == len(order)


def test_null_and_repeated_ids(spark, tmp_path):
    """Null ids, one id of different texts, and equal rows, from memory and from files."""
    words = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    near = " ".join([*words(1).split()[:-1], "other"])
    texts = [(None, words(0)), (None, words(1)), (1, near), (2, words(2)), (2, words(3)), (3, words(4)), (3, words(4)), (None, words(5)), (None, words(5)), (5, words(2)), (4, words(6) + " password=hunter2hunter2"), (4, "password=letmein12345 " + words(7)), (None, words(8) + " token=abcdefgh12345678")]
    given = spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t)) for k, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    given.repartition(3).write.parquet(str(tmp_path / "docs"))
    want = sorted([(None, words(0)), (1, near), (2, words(2)), (2, words(3)), (3, words(4)), (None, words(5)), *texts[10:]], key=str)
    for docs in (given, spark.read.parquet(str(tmp_path / "docs"))):
        unique = cut(corpus_pipeline.drop_near_duplicates(spark, docs, SF), "test-null-near")
        assert sorted(((r.doc_id, r.text) for r in unique.collect()), key=str) == want

        clean = cut(corpus_pipeline.redact_secrets(spark, docs, SF), "test-null-secrets")
        hidden = [t.replace("password=hunter2hunter2", "[secret]").replace("password=letmein12345", "[secret]").replace("token=abcdefgh12345678", "[secret]") for _, t in texts]
        assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted(((i, t) for (i, _), t in zip(texts, hidden, strict=True)), key=str)

        plan = mixing.mix(docs).collect()
        taken = Counter()
        for r in plan:
            taken[r.doc_id] += len(r.positions)
        mixed = corpus_pipeline.mix_sources(spark, docs, SF).collect()
        assert Counter(r.doc_id for r in mixed) == taken and max(Counter((r.doc_id, r.text) for r in mixed).values()) <= 4


def test_mix_does_not_depend_on_files(spark, tmp_path):
    """The stage run on the same rows from two folders, dealt differently: equal rows in equal order."""
    docs = table(spark, SF, "documents").unionByName(table(spark, SF, "documents").filter("doc_id % 9 = 0").withColumn("lang", F.lit("xx")))
    docs = docs.unionByName(docs.filter("doc_id % 5 = 0")).unionByName(docs.filter("doc_id % 7 = 0").withColumn("doc_id", F.lit(None).cast("long")))
    found = []
    for k, parts in enumerate((3, 7)):
        docs.repartition(parts, F.xxhash64("text", F.lit(k))).write.parquet(str(tmp_path / str(k)))
        out = cut(corpus_pipeline.mix_sources(spark, spark.read.parquet(str(tmp_path / str(k))), SF), "test-mix")
        found.append([tuple(r) for r in out.select(ordinal(out).alias("o"), "*").orderBy("o").drop("o").collect()])
    assert found[0] == found[1] and len(found[0]) > 200


def test_hot_row_of_the_mix(spark):
    """A third of all rows equal: each is taken as the others are, and they are dealt over parts."""
    rows = [(k, " ".join(["w"] * (1 + k % 5)), f"s{k % 3}") for k in range(400)] + [(7, "one two three", "s0")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = brute.mix_targets(sizes)
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(len(t.split()) for _, t, _ in rows)
    for r in got:
        taken[r.target] += r.taken
    assert all(abs(taken[t] - t) <= 5 for t in taken) and sorted(taken) == sorted(want.values())


def test_clashing_names_and_empty_tables(spark):
    """Columns that stages use themselves, and tables without rows, pass through every stage."""
    clash = ["score", "own", "row", "key", "at", "id", "its", "all_spans", "quality", "_row", "_key", "_n", "node", "a.b", "_metadata"]
    docs = table(spark, SF, "documents").limit(40)
    for name in clash:
        docs = docs.withColumn(name, F.col("doc_id") + 1)
    docs = cut(docs.unionByName(docs.filter("doc_id % 7 = 0").withColumn("doc_id", F.lit(None).cast("long"))), "test-clash")
    columns = docs.columns
    for given in (docs, docs.limit(0)):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            now = cut(stage(spark, now, SF), f"test-clash-{name}")
            if name != "pieces":
                assert now.columns == columns
                assert now.filter("`a.b` <> score or own <> node").count() == 0
        assert (now.count() > 0) == (given is docs)
