"""Maintenance and change feed (M1-M13), reports (W1-W11), evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memloom.functions.text import eval_tokens, subtract_ids
from memloom.operators.ingest import first_by
from memloom.sources.tables import write_through


def plan_purge(owners: DataFrame, gone: DataFrame) -> DataFrame:
    """M1. (owner, action, remaining): delete if no source remains (nor ever was), rebuild if some went, else untouched. owners: (owner, source_ids); gone: (source_id)."""
    rows = owners.select("owner", F.posexplode_outer("source_ids").alias("pos", "source_id")).join(gone.select("source_id").distinct().withColumn("_g", F.lit(True)), "source_id", "left")
    left = F.transform(F.array_sort(F.collect_list(F.when(F.col("_g").isNull() & F.col("pos").isNotNull(), F.struct("pos", "source_id")))), lambda x: x["source_id"])
    per = rows.groupBy("owner").agg(left.alias("remaining"), F.max(F.coalesce("_g", F.lit(False))).alias("hit"))
    return per.select("owner", F.when(F.size("remaining") == 0, "delete").when(F.col("hit"), "rebuild").otherwise("untouched").alias("action"), "remaining")


def surviving(extractions: DataFrame, plan: DataFrame, gone: DataFrame, owner: str = "name") -> DataFrame:
    """M2. Extraction rows from which owners under rebuild are merged again."""
    rows = extractions.join(plan.filter("action = 'rebuild'").select(F.col("owner").alias(owner)), owner, "left_semi")
    return rows.join(gone.select("source_id"), "source_id", "left_anti")


def delete_episodes(atoms: DataFrame, evidence: DataFrame, relations: DataFrame, entities: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """M3. Tables after deletion: evidence, then atoms without any, recounted; relations without atoms; entities without atoms and relations."""
    ev = evidence.join(gone.select("episode_id"), "episode_id", "left_anti")
    count = ev.groupBy("atom_id").agg(F.count_distinct("episode_id").alias("support_count"))
    live = atoms.drop("support_count").join(count, "atom_id")
    rel = relations.join(live.select(F.col("owner_id").alias("relation_id")).distinct(), "relation_id", "left_semi")
    used = live.select(F.col("owner_id").alias("entity_id")).union(rel.select(F.explode(F.array("a", "b")))).distinct()
    return {"evidence": ev, "atoms": live, "relations": rel, "entities": entities.join(used, "entity_id", "left_semi")}


def backup_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """M4. What a deletion removed."""
    return before.join(after.select(key), key, "left_anti")


def restore_rows(current: DataFrame, backup: DataFrame, key: str) -> DataFrame:
    """M4. Backed-up rows that are absent come back."""
    return current.unionByName(backup.join(current.select(key), key, "left_anti").select(*current.columns))


def prune_orphans(owners: DataFrame, atoms: DataFrame, relations: DataFrame) -> DataFrame:
    """M5. Owners with atoms or relations."""
    used = atoms.select("owner_id").union(relations.select(F.explode(F.array("a", "b")))).distinct()
    return owners.join(used, "owner_id", "left_semi")


def coalesce_outbox(changes: DataFrame) -> DataFrame:
    """M6. (owner_id, target_revision, status, owner_snapshot): one pending row an owner, a revision per change, the latest richest snapshot."""
    rich = F.struct(F.col("owner_snapshot").isNotNull(), "seq")
    return changes.groupBy("owner_id").agg(F.count("*").alias("target_revision"), F.lit("pending").alias("status"), F.max_by("owner_snapshot", rich).alias("owner_snapshot"))


def project_owners(owners: DataFrame, bodies: DataFrame, provenance: DataFrame) -> DataFrame:
    """M7. Rows for graph and vectors: owners with body and provenance; vanished ones are tombstones."""
    out = owners.join(bodies, "owner_id", "left").join(provenance, "owner_id", "left")
    return out.withColumn("tombstone", F.col("body").isNull())


def audit_anchors(rows: DataFrame, anchors: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M8. (missing, orphans): contributions (owner, source_id) whose document lacks the owner as anchor; those whose chunk is unknown."""
    met = rows.join(chunks.select(F.col("chunk_id").alias("source_id"), "doc_id"), "source_id", "left")
    missing = met.filter("doc_id is not null").select("doc_id", "owner").distinct().join(anchors, ["doc_id", "owner"], "left_anti")
    return missing, met.filter("doc_id is null").select("owner", "source_id")


def audit_vectors(graph: DataFrame, vectors: DataFrame, ids: list[str]) -> DataFrame:
    """M9. Graph rows of which no id (any of these columns) has a vector."""
    out = graph
    for c in ids:
        out = out.join(vectors.select(F.col("id").alias(c)), c, "left_anti")
    return out.select(*graph.columns)


def vector_rows(graph: DataFrame, key: str, text: list[str]) -> DataFrame:
    """M10. (id, content) to embed."""
    return graph.select(F.col(key).alias("id"), F.concat_ws("\n", *text).alias("content"))


def source_conflicts(docs: DataFrame) -> DataFrame:
    """M11. (file_path, n, sample, fingerprint) of files that several primary documents claim."""
    main = docs.filter(~F.coalesce("is_duplicate", F.lit(False)))
    ids = F.array_sort(F.collect_set("doc_id"))
    per = main.groupBy("file_path").agg(ids.alias("ids")).filter(F.size("ids") > 1)
    return per.select("file_path", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("sample"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("fingerprint"))


def repair_conflicts(docs: DataFrame, choices: DataFrame) -> DataFrame:
    """M12. Chosen primaries stay, rivals point to them, if count and fingerprint are still those of the choice (file_path, primary_id, n, fingerprint)."""
    ok = choices.join(source_conflicts(docs), ["file_path", "n", "fingerprint"], "left_semi").select("file_path", "primary_id")
    met = docs.join(ok, "file_path", "left")
    lost = F.col("primary_id").isNotNull() & (F.col("doc_id") != F.col("primary_id"))
    return met.withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)) | lost).withColumn("original_doc_id", F.when(lost, F.col("primary_id"))).drop("primary_id")


def cache_stats(cache: DataFrame) -> DataFrame:
    """M13. (mode, cache_type, n) of keys mode:type:hash."""
    return cache.groupBy(F.split_part("key", F.lit(":"), F.lit(1)).alias("mode"), F.split_part("key", F.lit(":"), F.lit(2)).alias("cache_type")).agg(F.count("*").alias("n"))


def rebuild_order(plan: DataFrame, edges: DataFrame) -> DataFrame:
    """M2. (step, owner) of a purge: relations of vanishing entities go first, then the entities, then rebuilds. plan: (owner,
    action); edges: (owner, a, b), relations by their own id."""
    gone = plan.filter("action = 'delete'").select("owner")
    ends = edges.select("owner", F.explode(F.array("a", "b")).alias("end")).join(gone.withColumnRenamed("owner", "end"), "end", "left_semi").select("owner")
    own = edges.select("owner").join(gone, "owner", "left_semi")
    first = ends.union(own).distinct().select(F.lit(1).alias("step"), "owner")
    second = gone.join(edges.select("owner"), "owner", "left_anti").select(F.lit(2).alias("step"), "owner")
    third = plan.filter("action = 'rebuild'").join(first.select("owner"), "owner", "left_anti").select(F.lit(3).alias("step"), "owner")
    return first.unionByName(second).unionByName(third)


def restored(atoms: DataFrame, evidence: DataFrame, backup_atoms: DataFrame, backup_evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M4. (atoms, evidence) after what a deletion took came back; support is counted again from all evidence."""
    ev = restore_rows(evidence, backup_evidence, "evidence_id")
    count = ev.groupBy("atom_id").agg(F.count_distinct("episode_id").alias("support_count"))
    all_atoms = restore_rows(atoms, backup_atoms, "atom_id").drop("support_count")
    return all_atoms.join(count, "atom_id", "left").na.fill(0, ["support_count"]), ev


def clean_cache(cache: DataFrame, modes: list[str] | None = None, cache_types: list[str] | None = None) -> DataFrame:
    """M13. The cache without keys mode:type:hash of these modes (None: of any) and types (None: of any)."""
    mode, kind = F.split_part("key", F.lit(":"), F.lit(1)), F.split_part("key", F.lit(":"), F.lit(2))
    hit = (mode.isin(*modes) if modes is not None else F.lit(True)) & (kind.isin(*cache_types) if cache_types is not None else F.lit(True))
    return cache.filter(~hit)


def workspace_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """W1. (name, n): rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def list_atoms(atoms: DataFrame, owners: DataFrame, counts: DataFrame, status: str | None = None, search: str = "", owner_kind: str | None = None) -> DataFrame:
    """W4. Atoms with status, their owner's name and kind, and their counts, by owner, then seq: of one status, of one
    kind of owner, or with a text (whatever its case) in content or name. owners: (owner_id, owner_name, owner_kind)."""
    rows = atoms.join(owners, "owner_id").join(counts, "atom_id", "left")
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if owner_kind is not None:
        rows = rows.filter(F.col("owner_kind") == owner_kind)
    if search:
        rows = rows.filter(F.contains(F.lower("content"), F.lit(search.lower())) | F.contains(F.lower("owner_name"), F.lit(search.lower())))
    return rows.orderBy("owner_id", "seq")


def _within(columns: tuple[str, ...], start: Column | None, end: Column | None) -> Column:
    """Whether one of the instants lies in the range; open ends where none is given."""
    hits = [F.col(c).isNotNull() & (F.col(c) >= start if start is not None else F.lit(True)) & (F.col(c) <= end if end is not None else F.lit(True)) for c in columns]
    return F.coalesce(reduce(lambda x, y: x | y, hits), F.lit(False))


def _holds(search: str, *columns: str) -> Column:
    """Whether one of the columns holds the text, whatever its case."""
    hits = [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(search.lower())), F.lit(False)) for c in columns]
    return reduce(lambda x, y: x | y, hits)


def filter_atoms(atoms: DataFrame, evidence: DataFrame, evolution: DataFrame, owner_kind: str | None = None, status: str | None = None, search: str = "", episode_id: object = None, evolution_type: str | None = None, valid: tuple = (None, None), system: tuple = (None, None)) -> DataFrame:
    """W4. Atoms with status that pass all filters that are given: kind of owner (the start of its id), status, a text in id, content or
    owner, evidence of an episode, an evolution of a type at either end (`any`: of some type), an end of the validity in a range, an end of
    the record in a range (Columns, None: open)."""
    rows = atoms.filter(F.startswith("owner_id", F.lit(f"{owner_kind}-"))) if owner_kind else atoms
    if status:
        rows = rows.filter(F.col("status") == status)
    if search:
        rows = rows.filter(_holds(search, "atom_id", "content", "owner_id"))
    if any(x is not None for x in valid):
        rows = rows.filter(_within(("valid_at", "invalid_at"), *valid))
    if any(x is not None for x in system):
        rows = rows.filter(_within(("created_at", "expired_at"), *system))
    if episode_id is not None:
        rows = rows.join(evidence.filter(F.col("episode_id") == F.lit(episode_id)).select("atom_id"), "atom_id", "left_semi")
    if evolution_type:
        links = evolution if evolution_type == "any" else evolution.filter(F.col("relation_type") == evolution_type)
        rows = rows.join(links.select(F.explode(F.array("source_atom_id", "target_atom_id")).alias("atom_id")), "atom_id", "left_semi")
    return rows


def filter_episodes(episodes: DataFrame, status: str | None = None, kind: str | None = None, search: str = "", reference: tuple = (None, None)) -> DataFrame:
    """W2. Episodes (episode_id, status, kind, content, source_uri, reference_at) that pass all filters that are given: status, kind, a text
    in id, content or source, the reference time in a range."""
    rows = episodes.filter(F.col("status") == status) if status else episodes
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    if search:
        rows = rows.filter(_holds(search, "episode_id", "content", "source_uri"))
    return rows.filter(_within(("reference_at",), *reference)) if any(x is not None for x in reference) else rows


def overview(atoms: DataFrame) -> DataFrame:
    """W1. (status, n, first, last) of atoms with status, and all of them."""
    out = atoms.rollup("status").agg(F.count("*").alias("n"), F.min("valid_at").alias("first_valid"), F.max("created_at").alias("last_created"), F.grouping("status").alias("_all"))
    return out.withColumn("status", F.when(F.col("_all") == 1, "all").otherwise(F.col("status"))).drop("_all")


def list_episodes(episodes: DataFrame, evidence: DataFrame, kind: str | None = None, search: str = "") -> DataFrame:
    """W2. Episodes with distinct atoms and evidence rows; of one kind, or with a text (whatever its case) in their content."""
    if kind is not None:
        episodes = episodes.filter(F.col("kind") == kind)
    if search:
        episodes = episodes.filter(F.contains(F.lower("content"), F.lit(search.lower())))
    per = evidence.groupBy("episode_id").agg(F.count_distinct("atom_id").alias("n_atoms"), F.count("*").alias("n_evidence"))
    return episodes.join(per, "episode_id", "left").na.fill(0, ["n_atoms", "n_evidence"])


def list_owners(owners: DataFrame, atoms: DataFrame, aliases: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """W3. Owners (owner_id, name) with n_aliases, n_atoms and n_ambiguous and their place: ambiguous ones first, then by atoms,
    then by name. aliases: (owner_id, alias); ambiguous: (entity_id, n_ambiguous)."""
    n = atoms.groupBy("owner_id").agg(F.count("*").alias("n_atoms"))
    known = aliases.groupBy("owner_id").agg(F.count_distinct("alias").alias("n_aliases"))
    out = owners.join(n, "owner_id", "left").join(known, "owner_id", "left").join(ambiguous.withColumnRenamed("entity_id", "owner_id"), "owner_id", "left")
    return out.na.fill(0, ["n_atoms", "n_aliases", "n_ambiguous"]).orderBy(F.desc(F.col("n_ambiguous") > 0), F.desc("n_atoms"), "name", "owner_id")


def nested_view(parents: DataFrame, children: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """W5. Parents with their children as a sorted array of structs."""
    rows = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in children.columns if c not in (key, order))))).alias(name))
    return parents.join(rows, key, "left")


#: Columns that a page of documents can be sorted by.
SORTS = ("created_at", "updated_at", "doc_id", "file_path")


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """W6. Page `number` (from 1) of clamped size."""
    size = min(max(size, 10), 200)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_total(df: DataFrame, size: int) -> DataFrame:
    """W6. One row (total, pages)."""
    size = min(max(size, 10), 200)
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def document_page(df: DataFrame, number: int, size: int, sort: str = "updated_at", descending: bool = True, status: str | None = None) -> DataFrame:
    """W7. A page of documents by one of SORTS, ties by id, of one status if given."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}")
    rows = df.filter(F.col("status") == status) if status is not None else df
    return page(rows, [F.desc_nulls_last(sort) if descending else F.asc_nulls_first(sort), F.col("doc_id")], number, size)


def keyset_page(df: DataFrame, statuses: list[str], after: tuple | None, n: int) -> DataFrame:
    """W8. The next n rows by (created_at, nulls first, doc_id) after a row's key."""
    rows = df.filter(F.col("status").isin(*statuses)) if statuses else df
    if after:
        at, key = after
        same = F.col("created_at").isNull() if at is None else F.col("created_at") == F.lit(at)
        more = F.col("created_at").isNotNull() if at is None else F.col("created_at") > F.lit(at)
        rows = rows.filter(more | (same & (F.col("doc_id") > F.lit(key))))
    return rows.orderBy(F.col("created_at").asc_nulls_first(), "doc_id").limit(n)


def status_counts(df: DataFrame) -> DataFrame:
    """W9. Counts by status, and all; rows without status count under null."""
    out = df.rollup("status").agg(F.count("*").alias("n"), F.grouping("status").alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("status")).alias("status"), "n")


def docs_by(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """W10."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def recent_episodes(episodes: DataFrame, n: int = 4) -> DataFrame:
    """W11. The last n episodes of each workspace."""
    w = W.partitionBy("ws").orderBy(F.desc("reference_at"), "episode_id")
    return episodes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def idf(docs: DataFrame) -> DataFrame:
    """E2. (token, df, idf) over (name, tokens)."""
    n = docs.agg(F.count("*").alias("n"))  # one row
    per = docs.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return per.crossJoin(F.broadcast(n)).select("token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


#: Different tokens of all queries up to which they are sent to the documents.
WANTED = 200_000


def tfidf_rank(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """E1-E3. (query_id, name, score, rank): sum over the query's tokens, repeated ones too, of (1 + ln tf) idf. docs: (name, text);
    queries: (query_id, text). Texts are read once: the table of (token, name, tf) gives the frequencies too; only tokens that
    are asked for go on, and a token of most documents is dealt by document."""
    asked = write_through(queries.select("query_id", F.explode(eval_tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times")), "asked-tokens")
    wanted = asked.select("token").distinct()
    tokens = docs.select("name", F.explode(eval_tokens(F.col("text"))).alias("token"))
    few = wanted.count() <= WANTED
    if few:  # tokens that are not asked for go where they are read
        tokens = tokens.join(F.broadcast(wanted), "token", "left_semi")
    tf = tokens.groupBy("name", "token").agg(F.count("*").alias("tf"))
    tf = write_through(tf if few else tf.join(wanted, "token", "left_semi"), "term-frequencies")
    n = docs.agg(F.count("*").alias("n"))  # one row
    known = tf.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    known = asked.join(known, "token").select("query_id", "token", (F.col("times") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("w"))
    salt = F.pmod(F.xxhash64("name"), F.lit(8)).cast("int")
    met = tf.withColumn("salt", salt).join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7)))), ["token", "salt"])
    per = met.groupBy("query_id", "name").agg(F.sum(F.col("w") * (1 + F.log("tf"))).alias("score")).filter("score > 0")
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "name")
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """E4. One row: mean recall at k, mean reciprocal rank, queries with full and with no recall. truth: (query_id, name)."""
    met = truth.join(ranked.filter(F.col("rank") <= k).select("query_id", "name", "rank"), ["query_id", "name"], "left")
    per = met.groupBy("query_id").agg((F.count("rank") / F.count("*")).alias("recall"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"))
    return per.agg(F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.sum((F.col("recall") == 1).cast("long")).alias("full_recall"), F.sum((F.col("recall") == 0).cast("long")).alias("no_hit"))


def score_summary(scores: DataFrame, cols: list[str]) -> DataFrame:
    """E5. (metric, n, success_rate, mean, low, high): NaN and null left out of all but the rate, the share of rows that have a score."""
    long = scores.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in cols))).alias("x")).select("x.*")
    good = F.when(F.col("v").isNotNull() & ~F.isnan("v"), F.col("v"))
    return long.groupBy("metric").agg(F.count(good).alias("n"), F.avg(good).alias("mean"), F.min(good).alias("low"), F.max(good).alias("high"), (F.count(good) / F.count("*")).alias("success_rate"))


def purge_sources(ids: Column, gone: Column) -> Column:
    """X14 as M1 uses it."""
    return subtract_ids(ids, gone)


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    return first_by(df, keys, [version], desc=True)
