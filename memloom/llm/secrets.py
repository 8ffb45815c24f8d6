"""Operator 10, secret scans: ownership frequency over the whole corpus (native).

Patterns find candidates in each text. Candidate hashes are counted by distinct
owners and repositories: what many owners hold is a copied example, what one or
two hold looks live. Base spans always stay; generic random-looking strings become
spans ("live") only if they are owner-specific.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memloom.llm.common import cut, salted_join, table

#: Kind, pattern, group of the secret, least characters of that group. Fixed values of the query's contract,
#: and last the method's own kind: a long run of letters of both cases that looks random (`looks_random`).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", ASSIGN, 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("live", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+(?![A-Za-z0-9+/_-])", 0, 24),
)
#: What is held by at most so many owners, in at most so many repositories (where these are known), is owner-specific.
MAX_OWNERS, MAX_REPOS = 2, 8
ALPHABET = string.ascii_letters + string.digits + "+/_-"
#: Least runs of one class (small, capital, digit) per letter or digit, greatest share of characters in words and numbers, and
#: least entropy of characters (1: all as different as they can be) of a run with fewer than ENOUGH_DIGITS digits.
ENOUGH_DIGITS, LEAST_RUNS, MOST_WORDY, LEAST_ENTROPY = 4, 0.35, 0.7, 0.75


def looks_random(value: Column) -> Column:
    """Whether the whole of a run is like a key rather than names or paths, whatever its length: letters of both
    cases, and either some digits or many changes of class, few words and a high entropy. Of random letters and
    digits 24 long about 1 in 100 is missed if it has few digits, of 40 long 1 in 1000."""
    plain = F.regexp_replace(value, "[^A-Za-z0-9]", "")
    n, most = F.length(value), F.length(plain)
    runs = F.regexp_count(plain, F.lit("[a-z]+|[A-Z]+|[0-9]+")) >= LEAST_RUNS * most
    wordy = n - F.length(F.regexp_replace(value, "[A-Z]?[a-z]{3,}|[A-Z]{4,}|[0-9]{4,}", "")) <= MOST_WORDY * most
    counts = F.transform(F.array(*map(F.lit, ALPHABET)), lambda c: n - F.length(F.replace(value, c, F.lit(""))))
    bits = F.aggregate(F.filter(counts, lambda k: k > 0), F.lit(0.0), lambda acc, k: acc - k / n * F.log2(k / n))
    varied = F.when(runs & wordy, bits >= LEAST_ENTROPY * F.log2(F.least(n, F.lit(len(ALPHABET))))).otherwise(False)
    cased = value.rlike("[a-z]") & value.rlike("[A-Z]")
    return F.when(cased, F.when(F.regexp_count(value, F.lit("[0-9]")) >= ENOUGH_DIGITS, True).otherwise(varied)).otherwise(False)


def _of_kind(text: Column, no: int) -> Column:
    """array of (kind, at, gap, width, value, good) of one kind; gap: characters since its last match."""
    _, pattern, group, least = KINDS[no]
    # runs of hex digits are everywhere; only runs of the least length count, and a run is one match either way
    pattern = r"[0-9a-f]{32,}" if no == 2 else pattern
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    widths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def good(value: Column) -> Column:
        return (F.length(value) >= least) & (looks_random(value) if no == 3 else F.lit(True))

    def row(m: Column, at: Column) -> Column:
        return F.struct(F.lit(no).alias("kind"), at.alias("at"), m["gap"].alias("gap"), m["width"].alias("width"), m["value"].alias("value"), good(m["value"]).alias("good"))

    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(widths)).alias("gap"), widths.alias("width"), values.alias("value"))
    return F.when(text.rlike(pattern), F.transform(zipped, row)).otherwise(F.array().cast("array<struct<kind:int,at:int,gap:int,width:int,value:string,good:boolean>>"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """A table of (row, key, owner, repo, kind, start, end, hash, good), one row per match and one with
    null kind for each row without any. row numbers the input rows. Without repo_col an owner has one repository:
    documents are no repositories, since copies of one owner's text are still that owner's."""
    repo = F.col(repo_col) if repo_col else F.lit(None)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("key"), F.col(owner_col).cast("string").alias("owner"), repo.cast("string").alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.select("row", "key", "owner", "repo", F.explode_outer(F.concat(*(_of_kind(F.col("text"), no) for no in range(len(KINDS))))).alias("m"))
    found = found.select("row", "key", "owner", "repo", "m.*").withColumn("hash", F.sha2("value", 256)).drop("value")
    seen = W.partitionBy("row", "kind").orderBy("at")
    start = F.sum("gap").over(seen) + F.coalesce(F.sum("width").over(seen.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = found.withColumn("start", F.when(F.col("kind").isNotNull(), start))
    return cut(found.select("row", "key", "owner", "repo", "kind", "start", (F.col("start") + F.col("width")).alias("end"), "hash", "good"), "secret-candidates")


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """(hash, n_owners, n_repos, specific) of candidate hashes. Distinct triples first, so that a
    value in a third of all rows is counted by many tasks. A null owner or repository is one of its own."""
    each = found.filter("good").groupBy("hash", "owner", "repo").agg(F.lit(1).alias("x"))
    per_owner = each.groupBy("hash", "owner").agg(F.count("x").alias("repos"))
    per = per_owner.groupBy("hash").agg(F.count("repos").alias("n_owners"), F.sum("repos").alias("n_repos"))
    return per.withColumn("specific", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).withColumnRenamed("hash", "known")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """(id, all_spans, n_copied, n_specific) of each row. all_spans: array of (start, kind_no, end, kind, specific)
    by start, then kind; base kinds all, "live" only where owner-specific and clear of base spans. Positions are code
    points, end exclusive. A null or empty text has none; repeated rows and ids give a row each, null ids too; an empty table
    gives an empty result; other columns are ignored, whatever their names."""
    found = candidates(docs, id_col, text_col, owner_col, repo_col)
    judged = salted_join(found, ownership(found), "hash", "known", F.col("row"))
    base = F.col("good") & (F.col("kind") < 3)
    own = W.partitionBy("row").orderBy("start", "kind")
    # a run is clear of base spans if all that begin before it end before it, and the next one begins behind it
    ended = F.max(F.when(base, F.col("end"))).over(own.rowsBetween(W.unboundedPreceding, -1))
    begins = F.min(F.when(base, F.col("start"))).over(own.rowsBetween(1, W.unboundedFollowing))
    judged = judged.withColumn("ended", ended).withColumn("begins", begins)
    clear = (F.coalesce("ended", F.lit(-1)) <= F.col("start")) & (F.col("begins").isNull() | (F.col("begins") >= F.col("end")))
    keep = F.col("good") & ((F.col("kind") < 3) | (F.coalesce("specific", F.lit(False)) & clear))
    name = F.element_at(F.array(*(F.lit(k[0]) for k in KINDS)), F.col("kind") + 1)
    span = F.struct("start", F.col("kind").alias("kind_no"), "end", name.alias("kind"), F.coalesce("specific", F.lit(False)).alias("specific"))
    per = judged.groupBy("row").agg(F.first("key").alias("key"), F.array_sort(F.collect_list(F.when(keep, span))).alias("all_spans"))
    out = per.select(F.col("key").alias(id_col), "all_spans")
    return out.withColumns({"n_specific": F.size(F.filter("all_spans", lambda x: x["specific"])).cast("long"), "n_copied": F.size(F.filter("all_spans", lambda x: ~x["specific"])).cast("long")})


def redact(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span of scanned replaced in the text; ids must be unique and not null (id_col may be
    a key of rows that both were given). Overlapping spans are replaced as one. Rows and columns stay as they are otherwise."""
    marked = scanned.filter(F.size("all_spans") > 0).select(F.col(id_col).alias("key"), "all_spans")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col(id_col).alias("its"), F.col(text_col).alias("text"))
    text = F.col("text")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).cast("long").alias("at"), F.concat(acc["out"], F.when(fresh, piece).otherwise("")).alias("out"))

    clean = F.aggregate("all_spans", state, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    joined = rows.join(marked, F.col("its") == F.col("key"), "left")
    return joined.select(F.when(F.col("all_spans").isNotNull(), F.col("own").withField(f"`{text_col}`", clean)).otherwise(F.col("own")).alias("own")).select("own.*")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets of all documents, and how many of them are held by their owners only."""
    out = scan(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda no: F.size(F.filter("all_spans", lambda x: x["kind_no"] == no)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.filter("all_spans", lambda x: x["kind_no"] < 3)), 256).alias("base_sha256"), listed(F.col("all_spans")).alias("spans"), "n_specific", "n_copied")
