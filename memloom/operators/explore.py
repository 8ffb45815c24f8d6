"""Reading a graph from names, for whole batches of queries (G10-G12): names are resolved, what is not known is listed as missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.ids import normalize_name
from memloom.operators.atoms import evolution_view, with_status
from memloom.operators.graph import both_ways
from memloom.operators.merge import top_ranked
from memloom.sources.tables import write_through


def known_names(nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(key, node): the node of each normal name: one of that name, else one of that alias; of several the first by name.
    nodes: (node); aliases: (node, alias)."""
    names = nodes.select(normalize_name(F.col("node")).alias("key"), F.struct(F.lit(0).alias("by"), "node").alias("x"))
    if aliases is not None:
        names = names.unionByName(aliases.select(normalize_name(F.col("alias")).alias("key"), F.struct(F.lit(1).alias("by"), "node").alias("x")))
    return names.groupBy("key").agg(F.min("x").alias("x")).select("key", F.col("x.node").alias("node"))


def resolved(asked: DataFrame, names: DataFrame, column: str = "name", to: str = "node") -> DataFrame:
    """asked with the node of the name in `column`, null if there is none."""
    known = names.select(F.col("key").alias("_key"), F.col("node").alias(to))
    return asked.withColumn("_own", normalize_name(F.col(column))).join(known, F.col("_own") == F.col("_key"), "left").drop("_own", "_key")


def expand_names(frontier: DataFrame, nodes: DataFrame, edges: DataFrame, seen_nodes: DataFrame, seen_edges: DataFrame, cap: int, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """G10. (results, candidates, queries) of one step from the names (query_id, name) of a frontier.

    results: (query_id, name, node, state, complete, truncated, available_count, returned_count), a row for each normal name, state
    not_found or expanded; candidates: (query_id, name, rank, neighbour, entity_type, a, b, keywords), the neighbours by name, `cap` at
    most; one is hidden only if both it (seen_nodes: query_id, name) and the relation (seen_edges: query_id, src, tgt) were visited;
    queries: (query_id, status, exhausted, truncated, missing, available_count, returned_count), status complete, truncated or partial (names
    are missing). nodes: (node, entity_type); edges: (a, b, keywords)."""
    names = write_through(known_names(nodes, aliases), "known-names")  # read four times
    front = frontier.select("query_id", "name").withColumn("_key", normalize_name(F.col("name"))).groupBy("query_id", "_key").agg(F.min("name").alias("name"))
    front = resolved(front.drop("_key"), names)
    ways = both_ways(edges.withColumn("_k", F.col("keywords")))
    met = front.filter("node is not null").join(ways.select("node", "other", F.col("_k").alias("keywords")).filter("node <> other"), "node")
    met = met.groupBy("query_id", "name", "node", "other").agg(F.min("keywords").alias("keywords"))
    ends = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    been = resolved(seen_nodes, names).select("query_id", F.col("node").alias("other"), F.lit(True).alias("_n")).distinct()
    told = resolved(resolved(seen_edges, names, "src", "x"), names, "tgt", "y").select("query_id", *ends(F.col("x"), F.col("y")), F.lit(True).alias("_e")).distinct()
    met = met.withColumns({"a": F.least("node", "other"), "b": F.greatest("node", "other")})
    fresh = met.join(been, ["query_id", "other"], "left").join(told, ["query_id", "a", "b"], "left").filter("not (coalesce(_n, false) and coalesce(_e, false))")
    fresh = fresh.withColumn("of", F.struct("query_id", "name"))
    counts = fresh.groupBy("query_id", "name").agg(F.count("*").alias("available_count"))
    out = front.join(counts, ["query_id", "name"], "left").na.fill(0, ["available_count"]).withColumn("returned_count", F.least("available_count", F.lit(cap).cast("long")))
    truncated = F.col("available_count") > cap
    out = out.select("query_id", "name", "node", F.when(F.col("node").isNull(), "not_found").otherwise("expanded").alias("state"), (F.col("node").isNotNull() & ~truncated).alias("complete"), truncated.alias("truncated"), "available_count", "returned_count")
    kept = top_ranked(fresh, "of", [F.col("other")], cap, "other").join(nodes.select(F.col("node").alias("other"), "entity_type"), "other", "left")
    kept = kept.select("query_id", "name", F.col("n").alias("rank"), F.col("other").alias("neighbour"), F.coalesce("entity_type", F.lit("UNKNOWN")).alias("entity_type"), "a", "b", "keywords")
    missing = F.array_sort(F.collect_list(F.when(F.col("node").isNull(), F.col("name"))))
    per = out.groupBy("query_id").agg(missing.alias("missing"), F.max("truncated").alias("truncated"), F.sum("available_count").alias("available_count"), F.sum("returned_count").alias("returned_count"))
    status = F.when(F.size("missing") > 0, "partial").when(F.col("truncated"), "truncated").otherwise("complete")
    done = (F.size("missing") == 0) & ~F.col("truncated") & (F.col("available_count") == 0)
    return out, kept, per.select("query_id", status.alias("status"), done.alias("exhausted"), "truncated", "missing", "available_count", "returned_count")


def asked_owners(entities: DataFrame, relations: DataFrame, nodes: DataFrame, edges: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(query_id, kind, asked, a, b, found): entities (query_id, name) and relations (query_id, src, tgt) that are asked for, resolved: a is
    an entity's node, a and b a relation's; asked is what was given, the ends of a relation in order; found says whether it is there."""
    names = known_names(nodes, aliases)
    one = resolved(entities, names).select("query_id", F.lit("entity").alias("kind"), F.col("name").alias("asked"), F.col("node").alias("a"), F.lit(None).cast("string").alias("b"))
    two = resolved(resolved(relations, names, "src", "x"), names, "tgt", "y")
    two = two.select("query_id", F.lit("relation").alias("kind"), F.concat_ws(" | ", F.least("src", "tgt"), F.greatest("src", "tgt")).alias("asked"), F.when(F.col("y").isNotNull(), F.least("x", "y")).alias("a"), F.when(F.col("x").isNotNull(), F.greatest("x", "y")).alias("b"))
    there = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("_there")).distinct()
    two = two.join(there, ["a", "b"], "left").select("query_id", "kind", "asked", "a", "b", F.coalesce("_there", F.lit(False)).alias("found"))
    return one.withColumn("found", F.col("a").isNotNull()).unionByName(two)


def describe_names(owners: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G11. (found, missing): (query_id, kind, a, b, entity_type, keywords, description), and (query_id, kind, asked). owners: as `asked_owners`
    gives them; nodes: (node, entity_type, description); edges: (a, b, keywords, description), a pair once."""
    there = owners.filter("found")
    of = nodes.select(F.col("node").alias("a"), F.coalesce("entity_type", F.lit("UNKNOWN")).alias("entity_type"), F.lit(None).cast("string").alias("keywords"), F.coalesce("description", F.lit("")).alias("description"))
    pair = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(None).cast("string").alias("entity_type"), F.coalesce("keywords", F.lit("")).alias("keywords"), F.coalesce("description", F.lit("")).alias("description"))
    columns = ["query_id", "kind", "a", "b", "entity_type", "keywords", "description"]
    found = there.filter("kind = 'entity'").join(of, "a").select(*columns).unionByName(there.filter("kind = 'relation'").join(pair, ["a", "b"]).select(*columns))
    return found, owners.filter("not found").select("query_id", "kind", "asked")


def evidence_of_names(owners: DataFrame, ids: DataFrame, atoms: DataFrame, evidence: DataFrame, evolution: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """G12. (found, missing): a row for each atom of the owners that are there (query_id, kind, a, b, owner_id, atom_id, content, status,
    evidence, evolutions), all of them; and (query_id, kind, asked). evidence is (evidence_id, episode_id) in order; evolutions are
    (relation_type, direction, related_id, related_content, related_status), from both ends. owners: of `asked_owners`; ids: (a, b,
    owner_id), b null for entities. An owner of many atoms is many rows."""
    named = ids.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "owner_id")
    mine = owners.filter("found").join(named, (F.col("a") == F.col("_a")) & F.col("b").eqNullSafe(F.col("_b"))).select("query_id", "kind", "a", "b", "owner_id")
    state = with_status(atoms, at)
    wanted = state.join(mine.select("owner_id").distinct(), "owner_id", "left_semi").select("owner_id", "atom_id", "content", "status")
    heard = evidence.join(wanted.select("atom_id"), "atom_id", "left_semi").groupBy("atom_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "episode_id"))).alias("evidence"))
    told = evolution_view(atoms, evolution, at).join(wanted.select("atom_id"), "atom_id", "left_semi").join(atoms.select(F.col("atom_id").alias("related_id"), F.col("content").alias("related_content")), "related_id")
    told = told.groupBy("atom_id").agg(F.array_sort(F.collect_list(F.struct("relation_type", "direction", "related_id", "related_content", "related_status"))).alias("evolutions"))
    out = mine.join(wanted, "owner_id").join(heard, "atom_id", "left").join(told, "atom_id", "left")
    return out.select("query_id", "kind", "a", "b", "owner_id", "atom_id", "content", "status", "evidence", "evolutions"), owners.filter("not found").select("query_id", "kind", "asked")
