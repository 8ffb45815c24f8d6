"""Extraction rows to graph rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.functions.repair import OBJECT_FIRST, recovered
from memloom.functions.text import cap_ids, clean_type, normalize_extracted, repair_delimiters, sanitize, token_count
from memloom.operators.prefix import before, ranges

FIELD, DONE = "<|#|>", "<|COMPLETE|>"


def once(**made: Column) -> Column:
    """A generator of one row: what is made there is computed once, however often filters and columns above ask for it."""
    return F.inline(F.array(F.struct(*(c.alias(name) for name, c in made.items()))))


def extraction_records(results: DataFrame) -> DataFrame:
    """X1, X3. (chunk_id, pos, kind, a, b, type, keywords, description, reason) from (chunk_id, result): one record a line, fields split
    at the separator. kind is entity, relation or error: an entity has its name in a and a type, a relation its ends in a and b, an
    error the reason."""
    text = repair_delimiters(sanitize(F.col("result")))
    rows = results.select("chunk_id", F.posexplode(F.split(text, r"\n|<\|COMPLETE\|>")).alias("pos", "record")).filter(F.trim("record") != "")
    rows = rows.select("chunk_id", "pos", once(f=F.transform(F.split("record", r"<\|#\|>"), lambda x: F.trim(x))))
    kind, n = F.lower(F.get("f", F.lit(0))), F.size("f")
    ent, rel = (kind == "entity") & (n == 4), kind.isin("relation", "relationship") & (n == 5)
    rows = rows.select("chunk_id", "pos", once(f=F.col("f"), kind=F.when(ent, "entity").when(rel, "relation"), x=F.when(ent | rel, F.transform(F.slice("f", 2, 4), lambda x: normalize_extracted(x, inner_quotes=True)))))
    ent, field = F.col("kind") == "entity", lambda i: F.get("x", F.lit(i - 1))
    kind_of = F.when(ent, clean_type(F.get("f", F.lit(2))))
    rows = rows.select("chunk_id", "pos", "kind", once(a=field(1), b=F.when(~ent, field(2)), type=kind_of, keywords=F.when(~ent, field(3)), description=F.when(ent, field(3)).otherwise(field(4))))
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    good = F.when(ent, given("a") & F.col("type").isNotNull() & given("description")).otherwise(given("a") & given("b") & (F.col("a") != F.col("b")))
    reason = F.when(F.col("kind").isNull(), "fields").when(~F.coalesce(good, F.lit(False)), F.col("kind"))
    rows = rows.withColumn("reason", reason)
    return rows.withColumn("kind", F.when(F.col("reason").isNull(), F.col("kind")).otherwise("error"))


def parse_extractions(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """X1, X3. (entities, relations, errors) of `extraction_records`; who wants all of them in one pass takes those."""
    rows = extraction_records(results)
    ents = rows.filter("kind = 'entity'").select("chunk_id", "pos", F.col("a").alias("name"), "type", "description")
    rels = rows.filter("kind = 'relation'").select("chunk_id", "pos", F.col("a").alias("src"), F.col("b").alias("tgt"), "keywords", "description")
    return ents, rels, rows.filter("kind = 'error'").select("chunk_id", "pos", "reason")


@F.pandas_udf(T.StringType())
def _recovered(texts: pd.Series) -> pd.Series:
    return texts.map(recovered, na_action="ignore")


def json_records(results: DataFrame, most: int = 1000) -> DataFrame:
    """X2. As `extraction_records` from JSON, fenced or inside prose; of JSON that was cut off the whole records before the cut; at most `most`
    records of each kind. What the native parser refuses (quotes of the other kind, keys without quotes, commas too many or too few, text
    behind with braces) is read by a small repair, in Python, those rows only. The first opening bracket must be a brace: a list at the
    top, and what has no object, is an error."""
    shape = "entities array<struct<name:string,type:string,description:string>>, relations array<struct<source:string,target:string,keywords:string,description:string>>"
    whole = lambda c: F.when(F.json_object_keys(c).isNotNull(), F.from_json(c, shape))
    rows = results.select("chunk_id", "result", once(opens=F.coalesce(F.col("result").rlike(OBJECT_FIRST), F.lit(False))))
    rows = rows.select("chunk_id", "result", "opens", once(body=F.when(F.col("opens"), F.regexp_extract("result", r"(?s)(\{.*\})", 1))))
    rows = rows.select("chunk_id", "result", "opens", once(j=F.coalesce(whole(F.col("body")), whole(F.concat("body", F.lit("]}"))))))
    # rows that are sound, and those without an object, send a null
    mended = _recovered(F.when(F.col("opens") & F.col("j").isNull(), F.col("result")))
    rows = rows.select("chunk_id", "j", mended.alias("mended")).select("chunk_id", once(j=F.coalesce("j", whole(F.col("mended")))))
    bad = F.col("j").isNull() | (F.col("j.entities").isNull() & F.col("j.relations").isNull())
    none = F.lit(None).cast("string")

    def record(kind: str, pos: Column, a: Column = none, b: Column = none, type: Column = none, keywords: Column = none, description: Column = none, reason: Column = none) -> Column:
        values = {"pos": pos, "kind": F.lit(kind), "a": a, "b": b, "type": type, "keywords": keywords, "description": description, "reason": reason}
        return F.struct(*(c.alias(name) for name, c in values.items()))

    ents = F.transform(F.slice("j.entities", 1, most), lambda x, i: record("entity", i, x["name"], type=x["type"], description=x["description"]))
    rels = F.transform(F.slice("j.relations", 1, most), lambda x, i: record("relation", i, x["source"], x["target"], keywords=x["keywords"], description=x["description"]))
    made = F.when(bad, F.array(record("error", F.lit(0), reason=F.lit("json")))).otherwise(F.flatten(F.filter(F.array(ents, rels), lambda x: x.isNotNull())))
    kept = (F.col("kind") == "error") | ((F.col("kind") == "entity") & (F.trim("a") != "")) | ((F.col("kind") == "relation") & (F.col("a") != F.col("b")))
    return rows.select("chunk_id", F.inline(made)).filter(kept)


def parse_extractions_json(results: DataFrame, most: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """X2. (entities, relations, errors) of `json_records`; who wants all of them in one pass takes those."""
    rows = json_records(results, most)
    ents = rows.filter("kind = 'entity'").select("chunk_id", "pos", F.col("a").alias("name"), "type", "description")
    rels = rows.filter("kind = 'relation'").select("chunk_id", "pos", F.col("a").alias("src"), F.col("b").alias("tgt"), "keywords", "description")
    return ents, rels, rows.filter("kind = 'error'").select("chunk_id", "pos", "reason")


def merge_passes(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """X8. The second pass replaces a key only if its description is longer; new keys are added."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    w = W.partitionBy(*keys).orderBy(F.desc(F.length("description")), "_p")
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_p")


def parse_keywords(results: DataFrame) -> DataFrame:
    """X9. (query_id, high, low) from (query_id, result)."""
    j = F.from_json(F.regexp_extract("result", r"(?s)(\{.*\})", 1), "high_level_keywords array<string>, low_level_keywords array<string>")
    tidy = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return results.select("query_id", j.alias("j")).select("query_id", tidy(F.col("j.high_level_keywords")).alias("high"), tidy(F.col("j.low_level_keywords")).alias("low"))


def top_ranked(rows: DataFrame, key: str, order: list, most: int, spread: str, parts: int = 32) -> DataFrame:
    """The first `most` rows of each key, with their rank n: ranked inside parts of a key by a hash of `spread` first, so that no
    task orders more than parts * most rows of a frequent key."""
    part = F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")
    rows = rows.withColumn("_part", part)
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy(key, "_part").orderBy(*order))).filter(F.col("n") <= most)
    return rows.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("n") <= most).drop("_part")


def merge_entities(rows: DataFrame, cap: int = 300) -> DataFrame:
    """X10. One row per name: the most frequent type (ties: first seen), descriptions once each by time, then longer first,
    sources once each in order, capped. rows: (name, type, description, source_id, ts, seq); stored rows come first by seq.
    Equal descriptions and sources meet before a name's are listed, and sources are ranked and cut before that."""
    votes = rows.groupBy("name", "type").agg(F.count("*").alias("n"), F.min("seq").alias("s"))
    typed = votes.groupBy("name").agg(F.min_by("type", F.struct(-F.col("n"), F.col("s"))).alias("type"))
    texts = rows.groupBy("name", "description").agg(F.min(F.struct("ts", (-F.length("description")).alias("l"), "seq")).alias("o"))
    texts = texts.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("o", "description"))).alias("d"))
    first = top_ranked(rows.groupBy("name", "source_id").agg(F.min("seq").alias("seq")), "name", [F.col("seq"), F.col("source_id")], cap, "source_id")
    ids = first.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "source_id"))).alias("s"))
    listed = lambda c, f: F.transform(c, lambda x: x[f]).alias
    out = texts.join(ids, "name").join(typed, "name")
    return out.select("name", listed("d", "description")("descriptions"), listed("s", "source_id")("source_ids"), "type")


def merge_relations(stored: DataFrame, new: DataFrame, most: int = 300) -> DataFrame:
    """X11. One row per unordered pair: stored weight and the weights of all new rows whose source is set and not stored yet; keywords once each, sorted; descriptions once each, in order; sources in order,
    at most `most`. stored: (a, b, weight, keywords array, source_ids array); new: (src, tgt, weight, keyword, source_id,
    seq, and, if there is one, description). Rows of one source meet first, stored sources are an anti join: nothing is as
    long as a pair's history but the one row that holds it."""
    described = "description" in new.columns
    rows = new.select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b"), "weight", "keyword", F.coalesce("source_id", F.lit("")).alias("source_id"), "seq", *(["description"] if described else []))
    words = F.collect_set(F.col("keyword"))
    told = [F.min(F.struct("seq", "description")).alias("d")] if described else []
    per_source = rows.groupBy("a", "b", "source_id").agg(F.sum("weight").alias("weight"), F.min("seq").alias("seq"), words.alias("k"), *told)
    known = stored.select("a", "b", F.explode("source_ids").alias("source_id")).distinct().withColumn("_s", F.lit(True))
    fresh = (F.col("source_id") != "") & F.col("_s").isNull()
    met = per_source.join(known, ["a", "b", "source_id"], "left").select("a", "b", "k", *(["d"] if described else []), F.when(fresh, F.col("weight")).otherwise(0.0).alias("w"), F.when(fresh, F.struct("seq", "source_id")).alias("s"))
    heard = [F.collect_list("d").alias("d")] if described else []
    per = met.groupBy("a", "b").agg(F.sum("w").alias("w"), F.array_distinct(F.flatten(F.collect_set("k"))).alias("k"), F.collect_list("s").alias("s"), *heard)
    out = per.join(stored.withColumnsRenamed({"weight": "w0", "keywords": "k0", "source_ids": "s0"}), ["a", "b"], "full")
    empty = F.array().cast("array<string>")
    ordered = lambda c, kind, field: F.transform(F.array_sort(F.coalesce(c, F.array().cast(f"array<struct<seq:bigint,{kind}:string>>"))), lambda x: x[field])
    ids = cap_ids(F.array_distinct(F.concat(F.coalesce("s0", empty), ordered(F.col("s"), "source_id", "source_id"))), most)
    told = [F.array_distinct(ordered(F.col("d"), "description", "description")).alias("descriptions")] if described else []
    return out.select("a", "b", (F.coalesce("w0", F.lit(0.0)) + F.coalesce("w", F.lit(0.0))).alias("weight"), F.array_sort(F.array_union(F.coalesce("k0", empty), F.coalesce("k", empty))).alias("keywords"), ids.alias("source_ids"), *told)


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """X12. Names that edges have and nodes lack."""
    return edges.select(F.explode(F.array("a", "b")).alias("name")).distinct().join(nodes, "name", "left_anti")


def plan_summaries(parts: DataFrame, fewest: int = 8, limit: int = 1200, context: int = 4000) -> DataFrame:
    """X16. (owner, mode, group, descriptions): join when few and small, else groups that fit the context. parts: (owner, pos, description),
    pos telling an owner's parts apart. Sums run over ranges of an owner's parts, then over its ranges, so an owner of many parts has many
    tasks; a row holds one group's parts."""
    placed = ranges(parts.select("owner", "pos", "description", token_count(F.col("description")).cast("long").alias("t")), ["owner"], ["pos"])
    rows = before(placed, ["owner"], ["pos"], F.col("t"), "before", "all")
    rows = rows.join(parts.groupBy(F.col("owner").alias("_o")).agg(F.count("*").alias("n")), F.col("owner").eqNullSafe(F.col("_o")))
    plain = (F.col("n") < fewest) & (F.col("all") < limit)
    group = F.floor(F.coalesce("before", F.lit(0)) / context)
    rows = rows.withColumn("mode", F.when(plain, "join").otherwise("summarize")).withColumn("group", F.when(plain, 0).otherwise(group).cast("long"))
    return rows.groupBy("owner", "mode", "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "description"))), lambda x: x["description"]).alias("descriptions"))


def touched(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """X17. (names, pairs) that a batch touches; pairs are unordered."""
    names = entities.select("name").union(relations.select(F.explode(F.array("src", "tgt")))).distinct()
    return names, relations.select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).distinct()


def cap_sources(rows: DataFrame, most: int, newest: bool = False) -> tuple[DataFrame, DataFrame]:
    """X13. (owners with capped source_ids, kept fragments) of fragments (owner, source_id, seq, is_new): the oldest `most`
    sources of an owner stay (newest: the latest); without newest, new fragments of sources that were cut go too."""
    first = rows.groupBy("owner", "source_id").agg(F.min("seq").alias("s"))
    order = F.desc("s") if newest else F.asc("s")
    kept = top_ranked(first, "owner", [order, F.col("source_id")], most, "source_id")
    owners = kept.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("s", "source_id"))).alias("x")).select("owner", F.transform("x", lambda x: x["source_id"]).alias("source_ids"))
    if newest:
        return owners, rows
    old = rows.join(kept.select("owner", "source_id", F.lit(True).alias("_k")), ["owner", "source_id"], "left")
    return owners, old.filter(F.col("_k") | ~F.col("is_new")).select(*rows.columns)
