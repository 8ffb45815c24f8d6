"""The commit of episodes (A12): extracted names, relations and facts become entities, relations and atoms of the registry.

Episodes that may see each other's entities are committed one after the other, in order of their time; all others together.
`conflict_waves` numbers them, and each wave is one batch of Spark jobs that sees the registry which the wave before left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memloom.functions.ids import normalize_name, pair_id
from memloom.operators import atoms as facts
from memloom.operators import prefix, resolve
from memloom.operators.ingest import first_by
from memloom.operators.maintain import coalesce_outbox
from memloom.sources.tables import write_through


def atom_id(episode: Column, owner: Column, content: Column, seq: Column) -> Column:
    """A stable id of a fact."""
    return F.concat(F.lit("atom-"), F.substring(F.sha2(F.concat_ws("\x1f", episode.cast("string"), owner, content, seq.cast("string")), 256), 1, 32))


def conflict_keys(mentions: DataFrame, decisions: DataFrame) -> DataFrame:
    """(episode_id, key): what an episode may read or write. Its names and aliases in normal form, other names of the batch that contain
    one of them or lie in one (such an entity would be a candidate), and the entities that were chosen for its names."""
    alias = mentions.select("episode_id", "name", F.explode(F.array_union(F.array("name"), "aliases")).alias("alias"))
    alias = alias.select("episode_id", "name", normalize_name(F.col("alias")).alias("key")).distinct()
    known = alias.select(F.col("key").alias("entity_id"), F.col("key").alias("normalized_alias")).distinct()
    near = resolve.candidates_lexical(alias.select(F.col("key").alias("name")).distinct(), known).filter("name <> entity_id")
    more = alias.join(near.select(F.col("name").alias("key"), F.col("entity_id").alias("other")), "key").select("episode_id", F.col("other").alias("key"))
    chosen = alias.select("episode_id", "name").join(decisions.select("name", F.concat(F.lit("\x1f"), F.col("entity_id").cast("string")).alias("key")), "name").select("episode_id", "key")
    return alias.select("episode_id", "key").union(more).union(chosen).distinct()


def conflict_waves(episodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(episode_id, wave): from 1, the length of the longest chain of episodes in order of (created_at, episode_id), each sharing a key with
    the next. A round takes every chain along one key at once (a running maximum), so there are as many rounds as the longest
    chain changes keys. A key of a third of all episodes has many tasks, but its episodes are as many waves."""
    order = ["created_at", "episode_id"]
    placed = prefix.ranges(keys.select("episode_id", "key").distinct().join(episodes.select(*order), "episode_id"), ["key"], order)
    placed = write_through(prefix.before(placed, ["key"], order, F.lit(1).cast("long"), "place").withColumn("place", F.coalesce("place", F.lit(0).cast("long"))), "wave-places")
    wave = write_through(placed.groupBy("episode_id").agg((F.max("place") + 1).alias("wave")), "waves")
    while True:
        met = prefix.before(placed.join(wave, "episode_id"), ["key"], order, F.col("wave") - F.col("place"), "least", how="max")
        new = met.groupBy("episode_id", "wave").agg(F.max(F.col("least") + F.col("place")).alias("asked"))
        new = write_through(new.select("episode_id", F.greatest("wave", "asked").alias("wave"), (F.col("asked") > F.col("wave")).alias("moved")), "waves")
        wave = new.select("episode_id", "wave")
        if not new.filter("moved").limit(1).count():
            return episodes.select("episode_id").join(wave, "episode_id", "left").withColumn("wave", F.coalesce("wave", F.lit(1).cast("long")))


def resolve_names(registry: dict[str, DataFrame], mentions: DataFrame, edges: DataFrame, decisions: DataFrame, candidates: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions with entity_id, edges between containers, resolved names): R1, then R2 and R3 as candidates (with those of R5, if they
    are given), R6, R7. decisions: (name, entity_id), what was chosen among the candidates; names without one become entities of
    their own."""
    containers, edges = resolve.coalesce_aliases(mentions, edges)
    met = mentions.join(containers, ["episode_id", "name"])
    each = met.select("container", "entity_type", "seq", F.explode(F.array_union(F.array("name"), "aliases")).alias("alias"))
    asked = each.groupBy(F.col("container").alias("name")).agg(F.min_by("entity_type", "seq").alias("entity_type"), F.array_sort(F.collect_set("alias")).alias("aliases"))
    asked = write_through(asked, "commit-requests")
    found = [resolve.candidates_exact(asked.select("name"), registry["aliases"]), resolve.candidates_lexical(asked.select("name"), registry["aliases"], most=8)]
    found = resolve.candidate_union(found + ([candidates.join(asked.select("name"), "name", "left_semi")] if candidates is not None else []))
    found = write_through(resolve.describe_candidates(found, registry["entities"], registry["atoms"].select("owner_id", "content", "seq")), "commit-candidates")
    resolved = write_through(resolve.apply_entity_decisions(asked, decisions, found, registry["aliases"]), "commit-resolved")
    return met.join(resolved.select(F.col("name").alias("container"), "entity_id"), "container"), edges, resolved


def commit_wave(registry: dict[str, DataFrame], mentions: DataFrame, edges: DataFrame, new_facts: DataFrame, edge_facts: DataFrame | None, entity_decisions: DataFrame, atom_decisions: DataFrame, similarity: DataFrame, now: Column, candidates: DataFrame | None = None) -> dict[str, DataFrame]:
    """One wave of `commit_episodes`: episodes that do not see each other. The registry's tables after it, with `changes` (owner_id)."""
    named, links, resolved = resolve_names(registry, mentions, edges.select("episode_id", "src", "tgt"), entity_decisions, candidates)
    named = write_through(named, "commit-named")
    own = named.select("episode_id", "name", "entity_id").distinct()
    fresh = resolved.filter("is_new").select("entity_id", "canonical_name").distinct().join(named.groupBy("entity_id").agg(F.min_by("entity_type", "seq").alias("entity_type")), "entity_id")
    entities = registry["entities"].unionByName(fresh.join(registry["entities"].select("entity_id"), "entity_id", "left_anti"))
    told = resolved.select("entity_id", F.explode("new_aliases").alias("alias")).select("entity_id", normalize_name(F.col("alias")).alias("normalized_alias"))
    aliases = registry["aliases"].unionByName(told).distinct()

    def ended(df: DataFrame) -> DataFrame:
        """Rows of (episode_id, src, tgt) between two entities, with both and the relation's id."""
        ends = lambda c, to: own.select("episode_id", F.col("name").alias(c), F.col("entity_id").alias(to))
        met = df.join(ends("src", "x"), ["episode_id", "src"]).join(ends("tgt", "y"), ["episode_id", "tgt"]).filter("x <> y")
        return met.withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")}).withColumn("relation_id", pair_id(F.col("a"), F.col("b"), "relation-"))

    both = registry["relations"].select("a", "b", "keywords").unionByName(ended(edges.select("episode_id", "src", "tgt", "keywords")).select("a", "b", "keywords"))
    relations = both.select("a", "b", F.explode_outer("keywords").alias("k")).groupBy("a", "b").agg(F.array_sort(F.collect_set("k")).alias("keywords"))
    relations = relations.withColumn("relation_id", pair_id(F.col("a"), F.col("b"), "relation-"))

    told = ["episode_id", "owner_id", "seq", "content", "valid_at", "invalid_at", "subject_entity_id", "object_entity_id"]
    none = F.lit(None).cast("string")
    rows = new_facts.join(own, ["episode_id", "name"]).withColumnRenamed("entity_id", "owner_id").withColumns({"subject_entity_id": none, "object_entity_id": none}).select(*told)
    if edge_facts is not None:
        rows = rows.unionByName(ended(edge_facts).withColumnsRenamed({"relation_id": "owner_id", "x": "subject_entity_id", "y": "object_entity_id"}).select(*told))
    rows = write_through(rows.withColumn("atom_id", atom_id(F.col("episode_id"), F.col("owner_id"), F.col("content"), F.col("seq"))), "commit-facts")
    kept, folded = facts.fold_exact(rows)
    kept = write_through(kept, "commit-kept")
    asked = write_through(atom_decisions.join(kept.select("atom_id"), "atom_id", "left_semi"), "commit-asked")
    wanted = asked.filter("target_id is not null").select("atom_id", F.col("target_id").alias("candidate_id")).distinct()  # no other pair is decided on

    def decided(pairs: DataFrame) -> DataFrame:
        """The decisions on these candidates, one an atom."""
        pairs = write_through(pairs, "commit-pairs")
        ok = asked.join(pairs.select("atom_id", F.col("candidate_id").alias("target_id")), ["atom_id", "target_id"], "left_semi")
        return write_through(facts.validate_decisions(first_by(ok, ["atom_id"], ["target_id"]), pairs), "commit-decisions")

    # within the episode first: what is a duplicate there is asked no more
    inside = decided(facts.in_batch_candidates(kept, similarity, wanted))
    doubles = facts.collapse_duplicates(inside.filter("decision = 'DUPLICATE'").select("atom_id", F.col("target_id").alias("duplicate_of")))
    leaders = write_through(kept.join(doubles.select("atom_id"), "atom_id", "left_anti"), "commit-leaders")
    same = write_through(facts.match_history_exact(leaders, registry["atoms"], now), "commit-same")
    rest = write_through(leaders.join(same.select("atom_id"), "atom_id", "left_anti"), "commit-rest")
    history = decided(facts.history_candidates(rest, registry["atoms"], similarity, now, wanted))
    known = same.select("atom_id", F.col("duplicate_of").alias("stored_id")).unionByName(history.filter("decision = 'DUPLICATE'").select("atom_id", F.col("target_id").alias("stored_id")))
    # where each of the wave's facts is stored: through its episode's double to the history's atom
    place = kept.select("atom_id").join(doubles, "atom_id", "left").select("atom_id", F.coalesce("root_id", "atom_id").alias("lead"))
    place = place.join(known.withColumnRenamed("atom_id", "lead"), "lead", "left").select("atom_id", "lead", F.coalesce("stored_id", "lead").alias("stored_id"))
    place = write_through(place, "commit-places")

    last = registry["atoms"].join(rest.select("owner_id").distinct(), "owner_id", "left_semi").groupBy("owner_id").agg(F.max("seq").alias("_last"))
    added = rest.join(known.select("atom_id"), "atom_id", "left_anti").join(last, "owner_id", "left")
    turn = F.row_number().over(W.partitionBy("owner_id").orderBy("seq", "atom_id"))
    stamped = added.withColumn("seq", F.coalesce(F.col("_last") + 1, F.lit(0)) + turn - 1).withColumns({"created_at": now, "expired_at": F.lit(None).cast("timestamp")})
    atoms = registry["atoms"].unionByName(stamped.select(*(c for c in registry["atoms"].columns if c in stamped.columns)), allowMissingColumns=True)
    atoms = write_through(atoms, "commit-added")
    # decisions on the history act first, then those within the episode, both in order of the facts
    order = rows.select("atom_id", F.col("seq").alias("_seq"))
    stored = place.select(F.col("atom_id").alias("target_id"), F.col("stored_id").alias("_to"))
    source = place.filter("atom_id = lead").select("atom_id", F.col("stored_id").alias("_from"))
    within = inside.filter("decision <> 'DUPLICATE'").join(source, "atom_id").join(stored, "target_id", "left").select(F.col("_from").alias("by"), "atom_id", "decision", F.col("_to").alias("to"), "target_invalid_at", "supersedes", F.lit(1).alias("stage"))
    acts = history.filter("decision <> 'DUPLICATE'").select(F.col("atom_id").alias("by"), "atom_id", "decision", F.col("target_id").alias("to"), "target_invalid_at", "supersedes", F.lit(0).alias("stage")).unionByName(within)
    acts = acts.join(order, "atom_id").select(F.col("by").alias("atom_id"), "decision", F.col("to").alias("target_id"), "target_invalid_at", "supersedes", F.struct("stage", "_seq").alias("turn"))
    atoms, evolved = facts.apply_evolution(atoms, write_through(acts, "commit-acts"), now)

    heard = folded.join(rows.select("atom_id", "episode_id", "owner_id"), "atom_id").join(place.select(F.col("atom_id").alias("kept_id"), "stored_id"), "kept_id")
    evidence = heard.select(F.concat_ws("-", F.lit("evidence"), "atom_id").alias("evidence_id"), F.col("stored_id").alias("atom_id"), "episode_id")
    return {
        "entities": entities, "aliases": aliases, "relations": relations, "atoms": atoms, "evidence": registry["evidence"].unionByName(evidence).dropDuplicates(["evidence_id"]),
        "evolution": registry["evolution"].unionByName(evolved), "resolved": resolved, "links": links, "changes": heard.select("owner_id").distinct(),
    }


TABLES = ("entities", "aliases", "relations", "atoms", "evidence", "evolution")


def commit_episodes(registry: dict[str, DataFrame], mentions: DataFrame, edges: DataFrame, new_facts: DataFrame, entity_decisions: DataFrame, atom_decisions: DataFrame, similarity: DataFrame, now: Column, episodes: DataFrame | None = None, edge_facts: DataFrame | None = None, candidates: DataFrame | None = None, stage: Callable[..., dict[str, DataFrame]] = commit_wave) -> dict[str, DataFrame]:
    """A12. The registry's tables after a batch of episodes, and the outbox of what changed.

    registry: entities (entity_id, canonical_name, entity_type), aliases (entity_id, normalized_alias), relations (a, b,
    keywords), atoms (atom_id, owner_id, content, valid_at, invalid_at, created_at, expired_at, seq, and, if wanted, subject_entity_id and
    object_entity_id), evidence (evidence_id, atom_id, episode_id), evolution (source_atom_id, target_atom_id, relation_type,
    created_at), and perhaps outbox (owner_id, target_revision).
    mentions: (episode_id, name, seq, aliases, entity_type); edges: (episode_id, src, tgt, keywords); new_facts:
    (episode_id, name, seq, content, valid_at, invalid_at), edge_facts the same with src and tgt; atom_decisions: (atom_id, decision,
    target_id, target_invalid_at, supersedes), one on the episode's own atoms and one on the history at most; similarity: (atom_id,
    candidate_id, score); candidates: more of a name's candidates (name, entity_id, score), as R5 finds them;
    episodes: (episode_id, created_at), by default all at one time, in order of their ids.

    Episodes that share a name, an alias, a chosen entity or a name that contains another are committed in waves, by time. In each,
    names are resolved (R1-R7) and written (R9), relations follow (R8), facts of one episode fold (A4), are compared with those
    before them (A5), those that the history holds give evidence (A6), the others are compared with it (A7); decisions are validated (A8)
    and applied (A10); evidence of duplicates goes to their roots (A9, A11). New atoms' seq goes on from their owner's last.
    Facts of unknown names and edges without both ends are left out. stage commits one wave; a caller may give another that returns
    the same tables. The outbox counts a revision for each wave that touched an owner.
    """
    if episodes is None:
        episodes = mentions.select("episode_id").distinct().withColumn("created_at", F.lit(0))
    episodes, mentions = write_through(episodes, "commit-episodes"), write_through(mentions, "commit-asking")
    waves = write_through(conflict_waves(episodes, conflict_keys(mentions, entity_decisions)), "commit-waves")
    given = {"mentions": mentions, "edges": edges, "new_facts": new_facts} | ({"edge_facts": edge_facts} if edge_facts is not None else {})
    given = {name: write_through(df.join(waves, "episode_id"), f"commit-{name}") for name, df in given.items()}
    changes, resolved, links = [], [], []
    # a wave reads these several times
    state = {name: write_through(registry[name], f"commit-{name}") for name in TABLES}
    atom_decisions, similarity, entity_decisions = (write_through(df, "commit-told") for df in (atom_decisions, similarity, entity_decisions))
    for wave in range(1, (waves.agg(F.max("wave")).first()[0] or 0) + 1):
        part = {name: df.filter(F.col("wave") == wave).drop("wave") for name, df in given.items()}
        out = stage(state, part["mentions"], part["edges"], part["new_facts"], part.get("edge_facts"), entity_decisions, atom_decisions, similarity, now, candidates)
        state = {name: write_through(out[name], f"commit-{name}") for name in TABLES}
        changes.append(out["changes"].select("owner_id", F.lit(wave).cast("long").alias("seq"), F.lit(None).cast("string").alias("owner_snapshot")))
        resolved.append(out["resolved"])
        links.append(out["links"])
    if not changes:
        none = entity_decisions.sparkSession.createDataFrame
        outbox = coalesce_outbox(none([], "owner_id string, seq long, owner_snapshot string"))
        return {**state, "atoms": facts.add_evidence(state["atoms"], state["evidence"]), "outbox": outbox}
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    outbox = coalesce_outbox(union(changes))
    if "outbox" in registry:
        was = registry["outbox"].select("owner_id", F.col("target_revision").alias("_was"))
        outbox = outbox.join(was, "owner_id", "left").withColumn("target_revision", F.col("target_revision") + F.coalesce("_was", F.lit(0))).drop("_was")
    return {**state, "atoms": facts.add_evidence(state["atoms"], state["evidence"]), "outbox": outbox, "resolved": union(resolved), "links": union(links)}
