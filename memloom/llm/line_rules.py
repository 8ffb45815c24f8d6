"""Operator 4, quality rules: cross-document line frequency (native).

Normalised lines are hashed and their distinct documents counted per host. Lines
above the limit are removed; documents that lose most of their words, or keep too
few, are rejected, beside documents that fail rules on their own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.common import WORD, cut, salted_join, table

#: Fixed values of the query's contract.
SYMBOLS, WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = "#*$%&|<>", 5, 10, 20
#: A line is frequent if more than LEAST_DOCS distinct documents of its host hold it, and more than that share of them.
LEAST_DOCS, DOC_SHARE = 10, 0.01
#: A document is depleted if it keeps less than this share of its words, or fewer than MIN_WORDS.
MIN_LEFT = 0.5
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, though body reads it for each element of an array."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words that stand in a window of five words found twice or more, each counted once; words: an array."""
    last = F.size(words) - WINDOW
    hashes = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(words[i + k] for k in range(WINDOW)))))

    def positions(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda p, x, i: (F.get(p, i)["h"] == x["h"])
        return let(pairs, lambda p: F.sort_array(F.transform(F.filter(p, lambda x, i: F.coalesce(same(p, x, i - 1), F.lit(False)) | F.coalesce(same(p, x, i + 1), F.lit(False))), lambda x: x["i"])))

    covered = lambda at: F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return F.coalesce(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(positions(h), covered)).otherwise(0)), F.lit(0)).cast("long")


def normal_line(line: Column) -> Column:
    """Lower case, digits read 0, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), r"[\x20\x09-\x0D]+", " "))


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Per row: its own figures, its host's key, its text's hash, and (hash, length, words) of its lines; a table."""
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("key"), F.xxhash64(F.col(host_col).isNull(), F.col(host_col)).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gone = lambda chars: F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    figures = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    hashed = F.transform(lines, lambda x: let(normal_line(x), lambda n: F.struct(F.xxhash64(n).alias("line"), F.length(n).alias("chars"), (F.regexp_count(x, F.lit(WORD))).alias("words"))))
    out = rows.select("row", "key", "host", F.xxhash64("text").alias("text_hash"), figures.alias("f"), gone(SPACES).cast("long").alias("word_chars"), (F.length("text") - gone(SYMBOLS)).cast("long").alias("n_symbols"), let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"), hashed.alias("lines"))
    out = out.select("row", "key", "host", "text_hash", "f.n_words", "word_chars", "n_symbols", "n_dup_lines", "f.n_repeat_words", "lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return cut(out.withColumn("base_failed", failed), "line-figures")


def frequent_lines(rows: DataFrame) -> DataFrame:
    """(known, n_docs) of lines above the limit. Equal texts count as one document: copies of one text (which deduplication
    removes) say nothing about its lines, and would else condemn each other. Two levels of
    grouping: a line in a third of all rows is counted by many tasks."""
    each = rows.select("host", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: F.struct(x["line"], x["chars"])))).alias("l"))
    each = each.select("host", "text_hash", F.xxhash64("host", "l.line", "l.chars").alias("known"))
    seen = each.groupBy("known", "host", "text_hash").agg(F.lit(1).alias("x"))
    counts = seen.groupBy("known", "host").agg(F.count("x").alias("n_docs")).filter(F.col("n_docs") > LEAST_DOCS)
    hosts = rows.groupBy("host", "text_hash").agg(F.lit(1).alias("x")).groupBy(F.col("host").alias("its_host")).agg(F.count("x").alias("host_docs"))
    return salted_join(counts, hosts, "host", "its_host", F.col("known"), "inner").filter(F.col("n_docs") > DOC_SHARE * F.col("host_docs")).select("known", "n_docs")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: its figures, base_failed, n_removed_words, removed_lines (hashes) and kept.

    A null text is empty and fails (no words). A null host is a host of its own. Repeated rows
    and ids give a row each, null ids too. Lines without a word count for nothing. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    rows = measured(docs, id_col, text_col, host_col)
    lines = rows.select("row", "host", F.explode("lines").alias("l")).select("row", F.col("l.line").alias("line"), F.col("l.words").alias("words"), F.xxhash64("host", "l.line", "l.chars").alias("line_key"))
    removed = salted_join(lines, frequent_lines(rows), "line_key", "known", F.col("row"), "inner")
    per = removed.groupBy(F.col("row").alias("its_row")).agg(F.sum("words").alias("gone"), F.collect_set("line").alias("removed_lines"))
    out = rows.drop("lines").join(per, F.col("row") == F.col("its_row"), "left").withColumn("n_removed_words", F.coalesce("gone", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < MIN_WORDS) | (left < MIN_LEFT * F.col("n_words"))
    out = out.withColumn("kept", ~F.col("base_failed") & ~depleted)
    return out.select(F.col("key").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words", "removed_lines")


def clean(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept, without their frequent lines; ids must be unique."""
    plan = judged.filter("kept").select(F.col(id_col).alias("key"), "removed_lines")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col(id_col).alias("its"), F.col(text_col).alias("text"))
    stays = lambda x: ~F.coalesce(F.array_contains("removed_lines", F.xxhash64(normal_line(x))), F.lit(False)) | ~x.rlike(WORD)
    text = F.array_join(F.filter(F.split("text", "\n"), stays), "\n")
    met = rows.join(plan, F.col("its") == F.col("key"))
    return met.select(F.when(F.col("removed_lines").isNull(), F.col("own")).otherwise(F.col("own").withField(f"`{text_col}`", text)).alias("own")).select("own.*")


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of all documents, and whether the rules keep them."""
    return judge(table(spark, sf_dir, "documents")).drop("removed_lines")
