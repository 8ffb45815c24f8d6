"""Operator 8, URL filters: listed rules and mined association rules (native).

Tokens of labelled URLs are mined with FP-growth; rules "tokens -> low quality" above
a support and a confidence remain. A rule is kept in an inverted index under its
rarest token; a URL's tokens meet the index, and a rule fits if the URL has all its
tokens. A URL that a rule fits, and that no listed rule decides, is blocked.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.common import cut, salted_join, table

#: (host and path prefix, verdict): fixed values of the query's contract.
LISTED = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Pruning of mined rules: share of labelled URLs with the tokens and the label; share of the label among those with the tokens.
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
LOW, GOOD = "label=low", "label=good"


def host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the host's end up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, listed: tuple = LISTED) -> Column:
    """struct(rule, verdict) of the longest listed rule that fits, or null. A rule fits its host
    and all subdomains if the path starts with the rule's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(listed, key=lambda x: len(x[0])):  # longer ones replace shorter ones
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """All tokens of a URL: scheme, host, registered domain, each label of the host (the last one as `top`), each segment of the
    path, file ending, closing slash, each name and each value of the query, fragment. Digits of all but hosts read 0."""
    labels = F.split(host, r"\.")
    named = lambda name, value: F.when(value != "", F.concat(F.lit(name + "="), value))
    digits = lambda c: F.regexp_replace(c, r"[0-9]+", "0")
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    each = lambda name, values: F.transform(values, lambda x: named(name, x))
    single = F.array(
        named("scheme", F.regexp_extract(url, r"(?s)^(.*?)://", 1)),
        named("top", F.element_at(labels, -1)),
        named("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")),
        named("host", host),
        named("ending", F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)),
        named("slash", F.when(path.endswith("/"), "1").otherwise("")),
        named("fragment", digits(F.regexp_extract(url, r"#(.*)$", 1))),
    )
    many = (each("label", F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))), each("dir", F.transform(F.split(path, "/"), digits)), each("name", F.transform(query, lambda x: digits(F.substring_index(x, "=", 1)))), each("value", F.transform(query, lambda x: digits(F.regexp_extract(x, "=(.*)$", 1)))))
    return F.coalesce(F.array_distinct(F.array_compact(F.concat(single, *many))), F.array().cast("array<string>"))


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    url = F.col(url_col)
    out = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host(url).alias("host"), path(url).alias("path"))
    return out.withColumn("tokens", F.when((F.col("host") != "") & F.col("url").isNotNull(), tokens(F.col("url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>")))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (key, rule_id, rule_tokens, confidence, support) for low pages, from (tokens, low) rows; key is
    the rule's rarest token. low null is no label and teaches nothing; no labels give no rules.

    Before mining, two things that lose no rule: tokens below the support go, and of tokens that stand in the very same
    labelled URLs (equal counts and equal sums of the URLs' hashes) the first one speaks for all, since rules with any of them
    have the same support and confidence. That keeps the itemsets of long URLs from multiplying."""
    rows = labelled.filter(F.col("low").isNotNull()).withColumn("url_id", F.xxhash64("tokens", "low", F.lit("url")))
    n = rows.agg(F.count("*").alias("n"))  # one row
    each = rows.select("url_id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("freq"), F.sum(F.xxhash64("url_id").cast("decimal(38,0)")).alias("where"))
    often = each.crossJoin(F.broadcast(n)).filter(F.col("freq") >= min_support * F.col("n"))
    speaks = cut(often.groupBy("freq", "where").agg(F.min("token").alias("token")).select("token", "freq"), "url-tokens")
    kept = rows.withColumn("i", F.monotonically_increasing_id()).select("i", "low", F.explode_outer("tokens").alias("token")).join(speaks.select("token", F.lit(True).alias("often")), "token", "left")
    items = kept.groupBy("i").agg(F.first("low").alias("low"), F.collect_list(F.when(F.col("often"), F.col("token"))).alias("tokens"))
    items = cut(items.select(F.array_append("tokens", F.when(F.col("low"), LOW).otherwise(GOOD)).alias("items")), "url-items")
    fitted = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = fitted.associationRules.filter(F.col("consequent")[0] == LOW).filter(~F.array_contains("antecedent", GOOD))
    rules = rules.select(F.xxhash64(F.array_sort("antecedent")).alias("rule_id"), F.array_sort("antecedent").alias("rule_tokens"), "confidence", "support")
    spread = rules.select("rule_id", F.explode("rule_tokens").alias("token")).join(speaks, "token")
    rarest = spread.groupBy("rule_id").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))
    return rules.join(rarest, "rule_id")


def judge(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", listed: tuple = LISTED) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence, rule_tokens) of every row.

    A listed rule decides alone. Else the most confident mined rule that fits (then the
    higher support, then the smaller id) blocks; none: allow. A null url, or one without
    "://", has empty host and path, no tokens and is allowed. Each row in gives one row out,
    repeated and null ids included; an empty table gives an empty result; other columns are ignored, whatever their names.
    labelled: (url, low boolean; null teaches nothing).

    Equal token sets are judged once. A set meets the rules under the tokens that are the rarest of some rule (the inverted
    index), by a join that is dealt by set for frequent tokens.
    """
    url = F.col("url")
    learn = labelled.select(tokens(url, host(url), path(url)).alias("tokens"), "low")
    rules = cut(mine(learn), "url-rules")
    rows = parsed(pages, id_col, url_col).withColumn("set", F.xxhash64(F.array_sort("tokens")))
    sets = rows.groupBy("set").agg(F.first("tokens").alias("tokens"))
    index = rules.groupBy("key").agg(F.collect_list(F.struct("rule_id", "rule_tokens", "confidence", "support")).alias("rules")).withColumnRenamed("key", "of")
    met = salted_join(sets.withColumn("key", F.explode("tokens")), index, "key", "of", F.col("set"), "inner").withColumn("r", F.explode("rules")).select("set", "tokens", "r.*")
    fits = met.filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = fits.groupBy("set").agg(F.max(F.struct("confidence", "support", (-F.col("rule_id")).alias("neg"), "rule_tokens")).alias("best")).withColumnRenamed("set", "known")
    out = salted_join(rows, best, "set", "known", F.struct("page_id", "url"))
    rule = listed_rule(F.col("host"), F.col("path"), listed)
    out = out.withColumn("listed", rule)
    verdict = F.coalesce(F.col("listed.verdict"), F.when(F.col("best").isNotNull(), "block"), F.lit("allow"))
    return out.select(F.col("page_id").alias(id_col), "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"), F.col("best.confidence").alias("confidence"), F.col("best.rule_tokens").alias("rule_tokens"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, low): a page's label is that of the document whose id its path holds; low if any of its rows says so."""
    per = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 0).alias("low"))
    rows = pages.select("url", F.regexp_extract(path(F.col("url")), r"/([0-9]{1,18})", 1).try_cast("long").alias("doc"))
    return rows.join(per, rows["doc"] == per["doc_id"]).select("url", "low")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' urls, by the listed rules and by those mined from the labels of documents."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, labelled_urls(pages, table(spark, sf_dir, "labels")))
