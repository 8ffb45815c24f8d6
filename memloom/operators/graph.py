"""Graph operators over undirected edges (a, b, weight), a < b."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memloom.sources.tables import write_through


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, ...) once from each end."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), *rest).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), *rest))


def degrees(edges: DataFrame) -> DataFrame:
    """G1. (node, degree)."""
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def edge_degrees(edges: DataFrame) -> DataFrame:
    """G2. (a, b, rank = degree of a + degree of b)."""
    d = degrees(edges)
    out = edges.select("a", "b").join(d.withColumnsRenamed({"node": "a", "degree": "da"}), "a").join(d.withColumnsRenamed({"node": "b", "degree": "db"}), "b")
    return out.select("a", "b", (F.col("da") + F.col("db")).alias("rank"))


def lookup_edges(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """G3. wanted (src, tgt) in either direction, with `found` and the edge's columns."""
    ask = wanted.withColumn("a", F.least("src", "tgt")).withColumn("b", F.greatest("src", "tgt"))
    return ask.join(edges.withColumn("found", F.lit(True)), ["a", "b"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def lookup_nodes(nodes: DataFrame, wanted: DataFrame, key: str = "node") -> DataFrame:
    """G3. wanted nodes with `found` and their columns."""
    return wanted.join(nodes.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def incident_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """G4. (node, other, ...) of each wanted node's edges."""
    return both_ways(edges).join(nodes.select("node").distinct(), "node")


def popular_labels(edges: DataFrame, n: int = 300) -> DataFrame:
    """G5. The n nodes of highest degree; ties by name."""
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(n)


def all_labels(nodes: DataFrame, key: str = "node") -> DataFrame:
    """G7. Every label once, sorted."""
    return nodes.select(key).distinct().orderBy(key)


def search_labels(queries: DataFrame, labels: DataFrame, n: int = 50) -> DataFrame:
    """G6. (query_id, label, score, rank): exact 1000, prefix 500, contained 100 - length, 50 more at a word's start.
    queries: (query_id, q). A label meets the queries whose first three characters it holds (shorter queries: whose whole
    text is one of its runs of that length), then is compared; empty queries find nothing."""
    low, q = F.lower("label"), F.lower("q")
    size = F.least(F.length("_q"), F.lit(3))
    asked = queries.withColumn("_q", q).filter("_q <> ''").withColumn("_g", F.expr("substring(_q, 1, least(length(_q), 3))"))
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_l") - k + 1, F.lit(1))), lambda i: F.substring(F.col("_l"), i, F.lit(k)))
    rows = labels.select("label", low.alias("_l")).distinct().withColumn("_g", F.explode(F.array_distinct(F.concat(runs(1), runs(2), runs(3)))))
    met = rows.join(asked.withColumn("_s", size), "_g").filter(F.contains("_l", F.col("_q")))
    inner = F.lit(100) - F.length("label") + F.when(F.contains("_l", F.concat(F.lit(" "), "_q")) | F.contains("_l", F.concat(F.lit("_"), "_q")), 50).otherwise(0)
    met = met.withColumn("score", F.when(F.col("_l") == F.col("_q"), 1000).when(F.startswith("_l", F.col("_q")), 500).otherwise(inner))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "label")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("query_id", "label", "score", "rank")


def subgraph(edges: DataFrame, starts: DataFrame, depth: int = 3, n: int = 1000) -> tuple[DataFrame, DataFrame]:
    """G8. (nodes, edges) around starts (query_id, node): breadth first, at most n nodes, inside a level the higher
    degree first, then name. nodes: (query_id, node, level, rank, is_truncated); edges: induced ones. Edges are read once;
    a level that reaches beyond n nodes is cut there, and that query goes no further."""
    edges = write_through(edges, "subgraph-edges")
    ways = both_ways(edges.select("a", "b"))
    deg = write_through(degrees(edges), "subgraph-degrees")
    of = W.partitionBy("query_id")
    seen = starts.select("query_id", "node").distinct().withColumn("level", F.lit(0)).join(deg, "node", "left").na.fill(0, ["degree"])
    seen = write_through(seen.withColumn("rank", F.row_number().over(of.orderBy(F.desc("degree"), "node"))).filter(F.col("rank") <= n + 1).select("query_id", "node", "level", "rank"), "subgraph-seen")
    front = seen
    for level in range(1, depth + 1):
        held = seen.groupBy("query_id").agg(F.max("rank").alias("_had"))
        front = front.join(held.filter(F.col("_had") <= n), "query_id")
        reached = front.join(ways, "node").select("query_id", F.col("other").alias("node"), "_had").distinct()
        fresh = reached.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti").join(deg, "node")
        place = F.row_number().over(of.orderBy(F.desc("degree"), "node")) + F.col("_had")
        fresh = fresh.withColumn("rank", place).filter(F.col("rank") <= n + 1)  # one more tells that there was more
        front = write_through(fresh.select("query_id", "node", F.lit(level).alias("level"), "rank"), "subgraph-front")
        seen = seen.unionByName(front)
    ranked = seen.withColumn("is_truncated", F.max("rank").over(of) > n).filter(F.col("rank") <= n)
    own = ranked.select("query_id", "node")
    inner = edges.join(own.withColumnRenamed("node", "a"), "a").join(own.withColumnRenamed("node", "b"), ["query_id", "b"])
    return ranked.select("query_id", "node", "level", "rank", "is_truncated"), inner


def whole_view(edges: DataFrame, n: int = 1000) -> DataFrame:
    """G9. Edges among the n nodes of highest degree."""
    top = popular_labels(edges, n).select("node")
    return edges.join(top.withColumnRenamed("node", "a"), "a", "left_semi").join(top.withColumnRenamed("node", "b"), "b", "left_semi")


def expand(frontier: DataFrame, edges: DataFrame, seen_nodes: DataFrame, seen_edges: DataFrame, cap: int) -> DataFrame:
    """G10. (query_id, node, other, state): neighbours of (query_id, node), hidden only if both the neighbour and the
    relation were visited; at most cap for each; state: not_found, exhausted, truncated or complete."""
    met = frontier.join(both_ways(edges), "node", "left")
    met = met.withColumn("a", F.least("node", "other")).withColumn("b", F.greatest("node", "other"))
    met = met.join(seen_nodes.select("query_id", F.col("node").alias("other")).withColumn("_n", F.lit(True)), ["query_id", "other"], "left")
    met = met.join(seen_edges.select("query_id", "a", "b").withColumn("_e", F.lit(True)), ["query_id", "a", "b"], "left")
    fresh = F.col("other").isNotNull() & ~(F.coalesce("_n", F.lit(False)) & F.coalesce("_e", F.lit(False)))
    own = W.partitionBy("query_id", "node")
    met = met.withColumn("_any", F.max(F.col("other").isNotNull()).over(own)).withColumn("_fresh", F.sum(fresh.cast("int")).over(own))
    met = met.withColumn("_r", F.row_number().over(own.orderBy(F.when(fresh, 0).otherwise(1), "other")))
    state = F.when(~F.col("_any"), "not_found").when(F.col("_fresh") == 0, "exhausted").when(F.col("_fresh") > cap, "truncated").otherwise("complete")
    keep = (fresh & (F.col("_r") <= cap)) | ((F.col("_fresh") == 0) & (F.col("_r") == 1))
    return met.filter(keep).select("query_id", "node", F.when(F.col("_fresh") > 0, F.col("other")).alias("other"), state.alias("state"))


def describe_owners(owners: DataFrame, atoms: DataFrame, aliases: DataFrame, most: int = 8) -> DataFrame:
    """G11. (owner_id, canonical_name, entity_type, n_atoms, atoms, aliases) of the asked owners: the latest `most` atoms by
    seq as (atom_id, content), sorted aliases. owners: (owner_id, canonical_name, entity_type); aliases: (entity_id, alias)."""
    mine = atoms.join(owners.select("owner_id"), "owner_id", "left_semi")
    last = mine.withColumn("n", F.row_number().over(W.partitionBy("owner_id").orderBy(F.desc("seq")))).filter(F.col("n") <= most)
    last = last.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("seq", "atom_id", "content"))).alias("x")).select("owner_id", F.transform("x", lambda x: F.struct(x["atom_id"].alias("atom_id"), x["content"].alias("content"))).alias("atoms"))
    count = mine.groupBy("owner_id").agg(F.count("*").alias("n_atoms"))
    named = aliases.join(owners.select(F.col("owner_id").alias("entity_id")), "entity_id", "left_semi").groupBy(F.col("entity_id").alias("owner_id")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    out = owners.join(count, "owner_id", "left").join(last, "owner_id", "left").join(named, "owner_id", "left")
    return out.na.fill(0, ["n_atoms"])


def owner_evidence(owners: DataFrame, atoms: DataFrame, evidence: DataFrame, most: int = 20) -> DataFrame:
    """G12. (owner_id, atom_id, episode_id, evidence_id, rank): the asked owners' evidence, newest first, at most `most` each."""
    met = atoms.select("owner_id", "atom_id").join(owners.select("owner_id").distinct(), "owner_id", "left_semi").join(evidence, "atom_id")
    w = W.partitionBy("owner_id").orderBy(F.desc("evidence_id"))
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("owner_id", "atom_id", "episode_id", "evidence_id", "rank")


def merge_findings(findings: DataFrame, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """G13. (findings, relations): the first finding (explorer, seq) for each query and normal name; the first relation for
    each query and unordered pair of normal names, without loops. pairs: (query_id, src, tgt, explorer, seq)."""
    name = lambda c: F.lower(F.trim(c))

    def first(df: DataFrame, *keys) -> DataFrame:  # noqa: ANN002
        w = W.partitionBy("query_id", *keys).orderBy("explorer", "seq")
        return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

    if pairs is None:
        return first(findings, name("name")), None
    ends = pairs.withColumn("a", F.least(name("src"), name("tgt"))).withColumn("b", F.greatest(name("src"), name("tgt"))).filter("a <> b")
    return first(findings, name("name")), first(ends, F.col("a"), F.col("b"))
