"""Entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memloom.functions.ids import normalize_name, pair_id
from memloom.operators.community import connected
from memloom.operators.ingest import first_by, upsert
from memloom.operators.merge import top_ranked
from memloom.operators.vector import vector_topk
from memloom.sources.tables import write_through

#: Longest run of characters that places one text in another.
HEAD = 16


def coalesce_aliases(mentions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R1. (map, edges): names of an episode that share a normal alias form one container, named by the first by seq; edges
    follow, self-loops go. mentions: (episode_id, name, seq, aliases); edges: (episode_id, src, tgt)."""
    key = lambda kind, c: F.concat_ws("\x1f", "episode_id", F.lit(kind), c)
    alias = mentions.select("episode_id", "name", "seq", F.explode(F.array_union("aliases", F.array("name"))).alias("alias"))
    parts = connected(alias.select(key("n", F.col("name")).alias("a"), key("z", normalize_name(F.col("alias"))).alias("b")))
    named = mentions.select("episode_id", "name", "seq", key("n", F.col("name")).alias("node")).join(parts, "node")
    w = W.partitionBy("component").orderBy("seq", "name")
    out = named.withColumn("container", F.first("name").over(w)).select("episode_id", "name", "container").distinct()
    move = lambda df, c: df.join(out.withColumnsRenamed({"name": c, "container": f"_{c}"}), ["episode_id", c], "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out, move(move(edges, "src"), "tgt").filter("src <> tgt").distinct()


def candidates_exact(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """R2. (name, entity_id, score 1.0). aliases: (entity_id, normalized_alias)."""
    return names.withColumn("normalized_alias", normalize_name(F.col("name"))).join(aliases, "normalized_alias").select("name", "entity_id", F.lit(1.0).alias("score"), "normalized_alias").distinct()


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """(s, t): texts t of `long` that contain the text s of `short`, from distinct (s) and (t) that are not empty. Runs of 1, 2, 4, 8 or HEAD
    characters of t look up which lengths of s begin so, and t's part of that place and length is then joined with s whole: rows
    follow the texts and what is found, not the pairs that begin alike. Texts are no small tables whatever their files weigh,
    so none of these joins is a broadcast."""
    sizes = [1 << i for i in range(HEAD.bit_length())]
    head = F.coalesce(*(F.when(F.length("s") >= k, F.substring("s", 1, k)) for k in reversed(sizes)))
    heads = short.select(head.alias("g"), F.length("s").alias("n")).distinct().groupBy("g").agg(F.collect_list("n").alias("ns"))  # lengths
    placed = long.select("t", F.explode(F.array(*map(F.lit, sizes))).alias("k")).filter(F.col("k") <= F.length("t"))
    placed = placed.select("t", "k", F.explode(F.sequence(F.lit(1), F.length("t") - F.col("k") + 1)).alias("i")).select("t", "i", F.substring(F.col("t"), F.col("i"), F.col("k")).alias("g"))
    met = placed.join(heads.hint("merge"), "g").select("t", "i", F.explode("ns").alias("n")).filter(F.col("i") + F.col("n") - 1 <= F.length("t"))
    return met.select("t", F.substring(F.col("t"), F.col("i"), F.col("n")).alias("s")).distinct().join(short.hint("merge"), "s").select("s", "t")


def candidates_lexical(names: DataFrame, aliases: DataFrame, most: int | None = None) -> DataFrame:
    """R3. One contains the other, score 0.8, equal ones 1.0. Distinct names meet distinct aliases (`contained`), then those who bear
    them. With `most`, a name keeps that many rows: equal ones first, then shorter aliases; no alias then brings more of its entities."""
    n = names.select("name", normalize_name(F.col("name")).alias("q")).filter("q <> ''").distinct()
    a = aliases.select("entity_id", F.col("normalized_alias").alias("al")).filter("al <> ''").distinct()
    qs, als = n.select("q").distinct(), a.select("al").distinct()
    one = contained(als.withColumnRenamed("al", "s"), qs.withColumnRenamed("q", "t")).select(F.col("t").alias("q"), F.col("s").alias("al"))
    two = contained(qs.withColumnRenamed("q", "s"), als.withColumnRenamed("al", "t")).select(F.col("s").alias("q"), F.col("t").alias("al"))
    both = one.union(two).distinct().withColumn("score", F.when(F.col("q") == F.col("al"), 1.0).otherwise(0.8))
    if most is None:
        met = both.join(a.hint("merge"), "al")
    else:
        best = [F.desc("score"), F.length("al"), "al"]
        both = write_through(top_ranked(both, "q", best, most, "al").select("q", "al", "score"), "lexical-pairs")
        borne = a.join(both.select("al").distinct().hint("merge"), "al", "left_semi")
        few = top_ranked(borne, "al", ["entity_id"], most, "entity_id").select("entity_id", "al")
        met = top_ranked(both.join(few.hint("merge"), "al"), "q", [*best, "entity_id"], most, "entity_id")
    out = met.join(n.hint("merge"), "q")
    return out.select("name", "entity_id", "score", F.col("al").alias("normalized_alias"))


def candidates_fulltext(names: DataFrame, aliases: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """R4. Aliases that hold all of a name's terms, score 0.7, with their BM25."""
    terms = lambda c: F.array_distinct(F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    docs = aliases.select("entity_id", "normalized_alias", F.explode(F.split("normalized_alias", r"[^\p{L}\p{N}]+")).alias("t")).filter("t <> ''")
    tf = docs.groupBy("entity_id", "normalized_alias", "t").agg(F.count("*").alias("tf")).withColumn("len", F.sum("tf").over(W.partitionBy("entity_id", "normalized_alias")))
    stats = aliases.agg(F.count("*").alias("n_docs")).crossJoin(docs.agg(F.count("*").alias("n_terms")))  # one row
    df = tf.groupBy("t").agg(F.count("*").alias("df"))
    q = names.select("name", terms(normalize_name(F.col("name"))).alias("ts")).withColumn("need", F.size("ts")).select("name", "need", F.explode("ts").alias("t"))
    met = q.join(tf, "t").join(df, "t").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") * F.col("n_docs") / F.col("n_terms")))
    per = met.groupBy("name", "entity_id", "normalized_alias", "need").agg(F.count("*").alias("n"), F.sum(part).alias("bm25"))
    return per.filter("n = need").select("name", "entity_id", F.lit(0.7).alias("score"), "normalized_alias", "bm25")


def candidates_vector(names: DataFrame, embeddings: DataFrame, k: int = 8, threshold: float = 0.72) -> DataFrame:
    """R5. (name, entity_id, score, rank): each entity's best row by cosine at or above threshold, the k best entities of a
    name. names: (name, qv); embeddings: (entity_id, v), several rows an entity. Each batch of vectors sends an entity's best row, and its
    k best entities, for each name; not every row above the threshold."""
    rows = embeddings.select(F.col("entity_id").alias("id"), "v")
    best = vector_topk(names.select(F.col("name").alias("query_id"), "qv"), rows, k, threshold, each_once=True)
    return best.select(F.col("query_id").alias("name"), F.col("id").alias("entity_id"), "score", "rank")


def candidate_union(parts: list[DataFrame], most: int = 8) -> DataFrame:
    """R6. (name, entity_id, score, rank): each entity's best score, top `most`."""
    union = parts[0].select("name", "entity_id", "score")
    for p in parts[1:]:
        union = union.unionByName(p.select("name", "entity_id", "score"))
    w = W.partitionBy("name").orderBy(F.desc("score"), "entity_id")
    return union.repartition("name", "entity_id").groupBy("name", "entity_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def describe_candidates(candidates: DataFrame, entities: DataFrame, atoms: DataFrame, last: int = 8) -> DataFrame:
    """R6. candidates with canonical_name and text: the name and the contents of the entity's last atoms, a line each.
    entities: (entity_id, canonical_name); atoms: (owner_id, content, seq)."""
    mine = atoms.join(candidates.select(F.col("entity_id").alias("owner_id")).distinct(), "owner_id", "left_semi")
    ranked = mine.withColumn("_n", F.row_number().over(W.partitionBy("owner_id").orderBy(F.desc("seq")))).filter(F.col("_n") <= last)
    per = ranked.groupBy(F.col("owner_id").alias("entity_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("c"))
    out = candidates.join(entities.select("entity_id", "canonical_name"), "entity_id").join(per, "entity_id", "left")
    text = F.concat_ws("\n", "canonical_name", F.array_join(F.transform("c", lambda x: x["content"]), "\n"))
    return out.withColumn("text", text).drop("c")


def apply_entity_decisions(requests: DataFrame, decisions: DataFrame, candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """R7. (name, entity_id, is_new, canonical_name, new_aliases). A decision outside the candidates, or none, makes a new
    entity, its id from the name's hash, so requests of one normal name share it, and the name of the first; a new name that equals a candidate's gets its type and a hash behind it. Known
    entities get the request's aliases that they lack. requests: (name, entity_type, aliases); decisions: (name,
    entity_id); candidates: (name, entity_id, canonical_name); aliases: (entity_id, normalized_alias)."""
    ok = candidates.select("name", "entity_id", F.col("canonical_name").alias("_known")).distinct()
    met = requests.join(decisions.select("name", "entity_id"), "name", "left").join(ok, ["name", "entity_id"], "left")
    taken = candidates.groupBy("name").agg(F.collect_set(normalize_name(F.col("canonical_name"))).alias("_taken"))  # a name's few candidates
    met = met.join(taken, "name", "left").withColumn("is_new", F.col("_known").isNull())
    digest = F.sha2(normalize_name(F.col("name")), 256)
    clash = F.coalesce(F.array_contains("_taken", normalize_name(F.col("name"))), F.lit(False))
    named = F.when(clash, F.concat("name", F.lit(" ("), F.coalesce("entity_type", F.lit("entity")), F.lit(":"), F.substring(digest, 1, 8), F.lit(")"))).otherwise(F.col("name"))
    met = met.withColumn("entity_id", F.when(F.col("is_new"), F.concat(F.lit("entity-"), F.substring(digest, 1, 32))).otherwise(F.col("entity_id")))
    met = met.withColumn("canonical_name", F.when(F.col("is_new"), named).otherwise(F.col("_known")))
    one = F.first("canonical_name").over(W.partitionBy("entity_id").orderBy("name"))  # requests of one normal name are one new entity
    met = met.withColumn("canonical_name", F.when(F.col("is_new"), one).otherwise(F.col("canonical_name")))
    each = met.select("name", "entity_id", F.posexplode("aliases").alias("pos", "alias")).withColumn("normalized_alias", normalize_name(F.col("alias")))
    fresh = each.join(aliases.select("entity_id", "normalized_alias").distinct(), ["entity_id", "normalized_alias"], "left_anti")
    fresh = fresh.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", "alias"))).alias("x"))
    out = met.join(fresh, "name", "left")
    return out.select("name", "entity_id", "is_new", "canonical_name", F.coalesce(F.transform("x", lambda x: x["alias"]), F.array().cast("array<string>")).alias("new_aliases"))


def resolve_relations(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """R8. (relation_id, a, b, keywords) of (src, tgt, keywords array) by (name, entity_id)."""
    ids = resolved.select("name", "entity_id")
    met = edges.join(ids.withColumnsRenamed({"name": "src", "entity_id": "x"}), "src").join(ids.withColumnsRenamed({"name": "tgt", "entity_id": "y"}), "tgt").filter("x <> y")
    met = met.withColumn("a", F.least("x", "y")).withColumn("b", F.greatest("x", "y"))
    per = met.groupBy("a", "b").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("keywords"))
    return per.withColumn("relation_id", pair_id(F.col("a"), F.col("b"), "relation-"))


def upsert_entities(registry: DataFrame, new: DataFrame) -> DataFrame:
    """R9. Latest revision of each entity, aliases of all in order."""
    latest = upsert(registry, new, ["entity_id"], "revision").drop("aliases")
    both = registry.select("entity_id", "revision", "aliases").unionByName(new.select("entity_id", "revision", "aliases"))
    rows = F.array_sort(F.collect_list(F.struct("revision", "aliases")))
    per = both.groupBy("entity_id").agg(rows.alias("r")).select("entity_id", F.array_distinct(F.flatten(F.transform("r", lambda x: x["aliases"]))).alias("aliases"))
    return latest.join(per, "entity_id")


def ambiguous_aliases(aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R10. (normalized_alias, n_entities) of aliases with several live entities; (entity_id, n_ambiguous). aliases: (entity_id, normalized_alias, expired)."""
    live = aliases.filter(~F.coalesce("expired", F.lit(False)))
    many = live.groupBy("normalized_alias").agg(F.count_distinct("entity_id").alias("n_entities")).filter("n_entities > 1")
    per = live.join(many, "normalized_alias").groupBy("entity_id").agg(F.count_distinct("normalized_alias").alias("n_ambiguous"))
    return many, per


def resolve_alias(aliases: DataFrame, winners: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R11. (aliases, merged): aliases (entity_id, normalized_alias) without rivals' claims on those that have a winner
    (normalized_alias, winner); rivals whose own name is the alias are duplicates of the winner: merged (duplicate, winner)
    goes to `merge_duplicate_entities`. entities: (entity_id, canonical_name)."""
    met = aliases.join(winners, "normalized_alias", "left")
    kept = met.filter(F.col("winner").isNull() | (F.col("winner") == F.col("entity_id"))).select(*aliases.columns)
    lost = met.filter("winner <> entity_id").join(entities.select("entity_id", normalize_name(F.col("canonical_name")).alias("_own")), "entity_id")
    return kept, lost.filter("_own = normalized_alias").groupBy(F.col("entity_id").alias("duplicate")).agg(F.min("winner").alias("winner"))


def moved(df: DataFrame, merged: DataFrame, *columns: str) -> DataFrame:
    """df with duplicates' ids in these columns replaced by their winners'."""
    for c in columns:
        df = df.join(merged.select(F.col("duplicate").alias(c), F.col("winner").alias("_w")), c, "left").withColumn(c, F.coalesce("_w", c)).drop("_w").select(*df.columns)
    return df


def merge_duplicate_entities(tables: dict[str, DataFrame], merged: DataFrame, now: Column | None = None) -> dict[str, DataFrame]:
    """R12. Tables after duplicates went to their winners, merged (duplicate, winner): atoms (owner_id, and subject_entity_id and
    object_entity_id if there are), embeddings (owner_id), memberships and aliases (entity_id, each row once), relations
    (a, b, keywords) regrouped without loops; checkpoints (owner_id) of duplicates go; entities (entity_id, expired_at)
    of duplicates expire. Tables that are not given are left out."""
    out = dict(tables)
    if "atoms" in out:
        out["atoms"] = moved(out["atoms"], merged, *(c for c in ("owner_id", "subject_entity_id", "object_entity_id") if c in out["atoms"].columns))
    if "relations" in out:
        rel = moved(out["relations"], merged, "a", "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.explode_outer("keywords").alias("k"))
        out["relations"] = rel.groupBy("a", "b").agg(F.array_sort(F.collect_set("k")).alias("keywords"))
    for name, column in (("embeddings", "owner_id"), ("memberships", "entity_id"), ("aliases", "entity_id")):
        if name in out:
            rows = moved(out[name], merged, column)
            out[name] = rows if name == "embeddings" else rows.distinct()
    if "checkpoints" in out:
        out["checkpoints"] = out["checkpoints"].join(merged.select(F.col("duplicate").alias("owner_id")), "owner_id", "left_anti")
    if "entities" in out:
        e = out["entities"]
        gone = merged.select(F.col("duplicate").alias("entity_id"), F.lit(True).alias("_d"))
        out["entities"] = e.join(gone, "entity_id", "left").withColumn("expired_at", F.coalesce("expired_at", F.when(F.col("_d"), F.current_timestamp() if now is None else now))).select(*e.columns)
    return out


def merge_graph_entities(nodes: DataFrame, edges: DataFrame, merged: DataFrame, strategies: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """R13. Nodes (node, seq, ...) merged many to one by column strategies: concatenate, keep_first, keep_last, join_unique, max;
    edges redirected, loops dropped, parallel edges summed."""
    to = F.coalesce("winner", "node")
    rows = nodes.join(merged.withColumnRenamed("duplicate", "node"), "node", "left").withColumn("node", to).drop("winner")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", c)))), lambda x: x[c])
    how = {
        "concatenate": lambda c: F.array_join(ordered(c), "\n"),
        "keep_first": lambda c: F.min_by(c, "seq"),
        "keep_last": lambda c: F.max_by(c, "seq"),
        "join_unique": lambda c: F.array_join(F.array_distinct(ordered(c)), "<SEP>"),
        "join_unique_comma": lambda c: F.array_join(F.array_distinct(ordered(c)), ","),
        "max": lambda c: F.max(c),
    }
    out = rows.groupBy("node").agg(*(how[s](c).alias(c) for c, s in strategies.items()))
    e = moved(edges, merged, "a", "b").filter("a <> b")
    return out, e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))


def apply_graph_edits(nodes: DataFrame, edges: DataFrame, edits: DataFrame, edge_edits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """R14. edits (node, action, new_name, description, seq): delete cascades to edges, rename rewrites them, update and create
    set the description; the last edit of a node counts. edge_edits (src, tgt, action, weight, seq), by the names that hold after
    the renames: delete, update and create of unordered pairs; created ones need both nodes."""
    last = first_by(edits, ["node"], ["seq"], desc=True)
    met = nodes.join(last.select("node", "action", "new_name", F.col("description").alias("_d")), "node", "full")
    out = met.filter(F.coalesce("action", F.lit("")) != "delete").select(F.coalesce("new_name", "node").alias("node"), F.coalesce("_d", "description").alias("description"))
    gone = last.filter("action = 'delete'").select("node")
    names = last.filter("new_name is not null").select(F.col("node").alias("duplicate"), F.col("new_name").alias("winner"))
    e = edges
    for c in ("a", "b"):
        e = e.join(gone.withColumnRenamed("node", c), c, "left_anti")
    e = moved(e, names, "a", "b").select(*edges.columns)
    if edge_edits is None:
        return out, e
    pair = edge_edits.select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b"), "action", F.col("weight").alias("_weight"), "seq")
    pair = first_by(pair, ["a", "b"], ["seq"], desc=True).drop("seq")
    for c in ("a", "b"):
        pair = pair.join(out.select(F.col("node").alias(c)), c, "left_semi")
    e = e.withColumn("x", F.least("a", "b")).withColumn("b", F.greatest("a", "b")).withColumn("a", F.col("x")).drop("x")
    met = e.withColumn("_old", F.lit(True)).join(pair, ["a", "b"], "full").filter("coalesce(action, '') <> 'delete' and (_old or action = 'create')")
    return out, met.withColumn("weight", F.coalesce("_weight", "weight")).select(*edges.columns)
