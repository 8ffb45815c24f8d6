"""Bitemporal facts ("atoms"): status, slices, folding, decisions, evolution, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memloom.functions.ids import normalize_atom_text
from memloom.operators.ingest import first_by
from memloom.operators.merge import top_ranked
from memloom.sources.tables import write_through

#: Owners with at most ALL atoms are compared whole; else the TOP nearest and the LAST latest.
ALL, TOP, LAST, NEAR = 16, 8, 4, 0.45
DECISIONS = ("DUPLICATE", "REFINEMENT", "TEMPORAL_SUCCESSOR", "CONTRADICTION", "INDEPENDENT")


def status_at(at: Column) -> Column:
    """A1."""
    return F.when(F.col("expired_at").isNotNull(), "expired").when(at < F.col("valid_at"), "pending").when(at >= F.col("invalid_at"), "invalid").otherwise("active")


def with_status(atoms: DataFrame, at: Column) -> DataFrame:
    return atoms.withColumn("status", status_at(at))


def as_of(atoms: DataFrame, valid_at: Column | None = None, system_at: Column | None = None) -> DataFrame:
    """A2. What is valid in the world at one instant, and what was recorded at another; null ends are open."""
    if valid_at is not None:
        atoms = atoms.filter((F.col("valid_at").isNull() | (F.col("valid_at") <= valid_at)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > valid_at)))
    if system_at is not None:
        atoms = atoms.filter((F.col("created_at") <= system_at) & (F.col("expired_at").isNull() | (F.col("expired_at") > system_at)))
    return atoms


def filter_time_range(atoms: DataFrame, start: Column, end: Column) -> DataFrame:
    """A3. Either end of the validity lies inside."""
    return atoms.filter(F.col("valid_at").between(start, end) | F.col("invalid_at").between(start, end))


def fold_exact(atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4. (kept, map): equal owner, normal text and end in one episode fold to the first by seq; map (atom_id, kept_id)."""
    w = W.partitionBy("episode_id", "owner_id", normalize_atom_text(F.col("content")), "invalid_at").orderBy("seq")
    rows = atoms.withColumn("kept_id", F.first("atom_id").over(w))
    return rows.filter("atom_id = kept_id").drop("kept_id"), rows.select("atom_id", "kept_id")


def in_batch_candidates(atoms: DataFrame, similarity: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """A5. (atom_id, candidate_id): earlier atoms of the same owner and episode; all if they are few, else the nearest and the last.
    similarity: (atom_id, candidate_id, score). Atoms meet those that they ask for by place, never all of their owner. wanted: distinct
    (atom_id, candidate_id); then only those of them that are candidates, and no other pairs are made."""
    own = ["episode_id", "owner_id"]
    rows = atoms.select(*own, "atom_id", F.row_number().over(W.partitionBy(*own).orderBy("seq", "atom_id")).alias("pos"))
    first = F.when(F.col("pos") - 1 <= ALL, 1).otherwise(F.col("pos") - LAST)
    ends = rows.select(*own, F.col("atom_id").alias("candidate_id"), F.col("pos").alias("old"))
    if wanted is None:
        asked = rows.filter("pos > 1").withColumn("old", F.explode(F.sequence(first, F.col("pos") - 1)))
        met = asked.join(ends, [*own, "old"]).select("atom_id", "candidate_id")
    else:
        met = rows.join(wanted, "atom_id").join(ends, [*own, "candidate_id"]).filter(F.col("old").between(first, F.col("pos") - 1)).select("atom_id", "candidate_id")
    near = similarity.filter(F.col("score") >= NEAR).join(rows.filter(F.col("pos") - 1 > ALL), "atom_id").join(ends, [*own, "candidate_id"]).filter("old < pos")
    return among(met.union(nearest(near, "atom_id")).distinct(), wanted)


def among(pairs: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """Those of the pairs (atom_id, candidate_id) that are wanted; all, if nothing is said."""
    return pairs if wanted is None else pairs.join(wanted, ["atom_id", "candidate_id"], "left_semi")


def history_candidates(new: DataFrame, atoms: DataFrame, similarity: DataFrame, at: Column, wanted: DataFrame | None = None) -> DataFrame:
    """A7. (atom_id, candidate_id): the owner's history if it is short, whatever the atoms' status, else its nearest atoms and the last that
    are active at `at`. Histories are cut to that before they are joined, so an owner of many atoms sends a few rows. wanted: as in
    `in_batch_candidates`."""
    mine = atoms.join(new.select("owner_id").distinct(), "owner_id", "left_semi").select("owner_id", F.col("atom_id").alias("candidate_id"), "seq", status_at(at).alias("status"))
    size = mine.groupBy("owner_id").agg(F.count("*").alias("n"))
    short = mine.join(size.filter(F.col("n") <= ALL), "owner_id").select("owner_id", "candidate_id")
    long = size.filter(F.col("n") > ALL).select("owner_id")
    last = top_ranked(mine.filter("status = 'active'").join(long, "owner_id", "left_semi"), "owner_id", [F.desc("seq"), F.desc("candidate_id")], LAST, "candidate_id")
    asked = new.select("owner_id", "atom_id")
    few = short.unionByName(last.select("owner_id", "candidate_id"))
    met = (asked.join(few, "owner_id") if wanted is None else asked.join(wanted, "atom_id").join(few, ["owner_id", "candidate_id"])).select("atom_id", "candidate_id")
    near = similarity.filter(F.col("score") >= NEAR).join(asked, "atom_id").join(mine.select("owner_id", "candidate_id"), ["owner_id", "candidate_id"]).join(long, "owner_id", "left_semi")
    return among(met.union(nearest(near, "atom_id")).distinct(), wanted)


def nearest(scored: DataFrame, *key: str) -> DataFrame:
    """(key, candidate_id): the TOP nearest by score, ties by id; the key is an atom, or a group of atoms with equal scores."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), "candidate_id"))
    return scored.withColumn("_n", rank).filter(F.col("_n") <= TOP).select(*key, "candidate_id")


def match_history_exact(new: DataFrame, atoms: DataFrame, at: Column) -> DataFrame:
    """A6. (atom_id, duplicate_of): the first active atom of equal owner, normal text and end; the start does not matter."""
    text = normalize_atom_text(F.col("content"))
    old = with_status(atoms, at).filter("status = 'active'").select(F.col("owner_id").alias("o"), text.alias("t"), F.col("invalid_at").alias("i"), F.col("atom_id").alias("duplicate_of"), F.col("seq").alias("s"))
    met = new.withColumn("_t", text).join(old, (F.col("owner_id") == F.col("o")) & (F.col("_t") == F.col("t")) & F.col("invalid_at").eqNullSafe(F.col("i")))
    return first_by(met, ["atom_id"], ["s"]).select("atom_id", "duplicate_of")


def validate_decisions(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """A8. Unknown labels and targets outside the candidates read INDEPENDENT, without target; an end only for successor
    and contradiction; superseding only for contradiction. decisions: (atom_id, decision, target_id, target_invalid_at, supersedes)."""
    met = decisions.join(candidates.select("atom_id", F.col("candidate_id").alias("target_id")).distinct().withColumn("_ok", F.lit(True)), ["atom_id", "target_id"], "left")
    d = F.when(F.col("decision").isin(*DECISIONS) & F.coalesce("_ok", F.lit(False)), F.col("decision")).otherwise("INDEPENDENT")
    out = met.withColumn("decision", d)
    return out.select("atom_id", "decision", F.when(F.col("decision") != "INDEPENDENT", F.col("target_id")).alias("target_id"), F.when(F.col("decision").isin("TEMPORAL_SUCCESSOR", "CONTRADICTION"), F.col("target_invalid_at")).alias("target_invalid_at"), ((F.col("decision") == "CONTRADICTION") & F.coalesce("supersedes", F.lit(False))).alias("supersedes"))


def collapse_duplicates(links: DataFrame) -> DataFrame:
    """A9. (atom_id, root_id) of (atom_id, duplicate_of): pointers jump, each round twice as far, until none moves."""
    root = write_through(links.select("atom_id", F.col("duplicate_of").alias("root_id")), "roots")
    while True:
        step = root.select(F.col("atom_id").alias("root_id"), F.col("root_id").alias("_next"))
        met = root.join(step, "root_id", "left")
        new = write_through(met.select("atom_id", F.coalesce("_next", "root_id").alias("root_id"), F.col("_next").isNotNull().alias("moved")), "roots")
        root = new.select("atom_id", "root_id")
        if not new.filter("moved").limit(1).count():
            return root


def apply_evolution(atoms: DataFrame, decisions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """A10. (atoms, evolution): refinements expire their target; successors end it at the given end, else at their own start, and expire it;
    contradictions that supersede end it at the given end only, and expire it. An end before the target's start is passed over, each by
    itself; of several ends the last decision's holds, in order of `turn` if decisions have one, else of their atoms' seq. An edge
    new -> old is always recorded."""
    links = decisions.filter("target_id is not null and target_id <> atom_id and decision not in ('DUPLICATE', 'INDEPENDENT')")
    source = atoms.select(F.col("atom_id").alias("_src"), F.col("valid_at").alias("_start"), F.col("seq").alias("_seq"))
    acts = links.filter("decision in ('REFINEMENT', 'TEMPORAL_SUCCESSOR') or supersedes").join(source, links["atom_id"] == F.col("_src"), "left")
    end = F.when(F.col("decision") == "TEMPORAL_SUCCESSOR", F.coalesce("target_invalid_at", "_start")).when(F.col("decision") == "CONTRADICTION", F.col("target_invalid_at"))
    turn = F.struct(F.col("turn") if "turn" in decisions.columns else F.col("_seq"), F.col("_src"))
    acts = acts.select("target_id", end.alias("_end"), turn.alias("_turn"))
    target = atoms.select(F.col("atom_id").alias("target_id"), F.col("valid_at").alias("_since"))
    counts = F.col("_end").isNotNull() & (F.col("_since").isNull() | (F.col("_end") >= F.col("_since")))
    per = acts.join(target, "target_id").groupBy(F.col("target_id").alias("_t")).agg(F.max_by("_end", F.when(counts, F.col("_turn"))).alias("_end"))
    out = atoms.join(per, atoms["atom_id"] == F.col("_t"), "left").withColumn("invalid_at", F.coalesce("_end", "invalid_at"))
    out = out.withColumn("expired_at", F.coalesce("expired_at", F.when(F.col("_t").isNotNull(), now)))
    edges = links.select(F.col("atom_id").alias("source_atom_id"), F.col("target_id").alias("target_atom_id"), F.col("decision").alias("relation_type"), now.alias("created_at"))
    return out.select(*atoms.columns), edges


def add_evidence(atoms: DataFrame, evidence: DataFrame) -> DataFrame:
    """A11. atoms with support_count: distinct episodes of their evidence; a repeated evidence_id counts once."""
    per = evidence.dropDuplicates(["evidence_id"]).groupBy("atom_id").agg(F.count_distinct("episode_id").alias("support_count"))
    return atoms.drop("support_count").join(per, "atom_id", "left").withColumn("support_count", F.coalesce("support_count", F.lit(0)))


def presentation(content: Column, start: Column, end: Column) -> Column:
    """A13."""
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("..."))
    return F.when(start.isNull() & end.isNull(), content).otherwise(F.concat(content, F.lit(" ["), day(start), F.lit(" - "), day(end), F.lit("]")))


def owner_provenance(atoms: DataFrame, evidence: DataFrame, episodes: DataFrame) -> DataFrame:
    """A14. (owner_id, chunk_ids, paths), each once, in order of the evidence."""
    met = atoms.select("atom_id", "owner_id").join(evidence, "atom_id").join(episodes, "episode_id")
    rows = F.array_sort(F.collect_list(F.struct("created_at", "evidence_id", "episode_id", "source_uri")))
    return met.groupBy("owner_id").agg(rows.alias("r")).select("owner_id", F.array_distinct(F.transform("r", lambda x: x["episode_id"])).alias("chunk_ids"), F.array_distinct(F.transform("r", lambda x: x["source_uri"])).alias("paths"))


def materialize_owners(atoms: DataFrame, checkpoints: DataFrame, at: Column) -> DataFrame:
    """A15. (owner_id, body): the checkpoint's summary and the atoms that it does not cover, or all live atoms."""
    live = with_status(atoms, at).filter("status = 'active'")
    rows = live.join(checkpoints, "owner_id", "left").filter(~F.coalesce(F.array_contains("covered_atom_ids", F.col("atom_id")), F.lit(False)))
    text = presentation(F.col("content"), F.col("valid_at"), F.col("invalid_at"))
    per = rows.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("seq", text.alias("text")))).alias("r"))
    out = per.join(checkpoints.select("owner_id", "checkpoint_summary"), "owner_id", "full")
    return out.select("owner_id", F.concat_ws("<SEP>", "checkpoint_summary", F.array_join(F.transform(F.coalesce("r", F.array().cast("array<struct<seq:bigint,text:string>>")), lambda x: x["text"]), "<SEP>")).alias("body"))


def plan_compaction(owners: DataFrame) -> DataFrame:
    """A16. (owner_id, mode). owners: (owner_id, has_checkpoint, same_identity, lost_atoms, pending_atoms, pending_tokens, whole_tokens, compactions)."""
    rebuild = ~F.col("has_checkpoint") | ~F.col("same_identity") | (F.col("lost_atoms") > 0)
    due = (F.col("pending_atoms") >= 8) | (F.col("pending_tokens") >= 1200) | (F.col("whole_tokens") >= 12000)
    mode = F.when(rebuild, "rebuild").when(due & ((F.col("compactions") + 1) % 8 == 0), "rebuild").when(due, "compact").otherwise("keep")
    return owners.select("owner_id", mode.alias("mode"))


def resolve_conflicts(atoms: DataFrame, evolution: DataFrame, winners: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """A17. (atoms, evolution): atoms that lose a contradiction expire once, and its edges, in both directions, say when it was
    resolved and for whom. Contradictions that are resolved already are left as they are, winners outside their pair are ignored.
    winners: (a, b, winner) of unordered pairs; evolution's metadata is JSON."""
    open_ = (F.col("relation_type") == "CONTRADICTION") & F.get_json_object("metadata", "$.resolved_at").isNull()
    ends = [F.least("source_atom_id", "target_atom_id").alias("a"), F.greatest("source_atom_id", "target_atom_id").alias("b")]
    one = winners.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "winner").filter("winner = a or winner = b")
    one = first_by(one, ["a", "b"], ["winner"]).withColumnRenamed("winner", "_winner")
    met = evolution.withColumn("_open", F.coalesce(open_, F.lit(False))).select("*", *ends).join(one, ["a", "b"], "left")
    done = F.col("_open") & F.col("_winner").isNotNull()
    lost = met.filter(done).select(F.when(F.col("_winner") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("atom_id")).distinct().withColumn("_l", F.lit(True))
    out = atoms.join(lost, "atom_id", "left").withColumn("expired_at", F.coalesce("expired_at", F.when(F.col("_l"), now))).select(*atoms.columns)
    audit = F.to_json(F.struct(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("resolved_at"), F.col("_winner").cast("string").alias("winner")))
    return out, met.withColumn("metadata", F.when(done, audit).otherwise(F.col("metadata"))).select(*evolution.columns)


def evolution_view(atoms: DataFrame, evolution: DataFrame, at: Column) -> DataFrame:
    """A18. (atom_id, direction, relation_type, related_id, related_status) from both ends."""
    ways = evolution.select(F.col("source_atom_id").alias("atom_id"), F.lit("outgoing").alias("direction"), "relation_type", F.col("target_atom_id").alias("related_id"))
    ways = ways.unionByName(evolution.select(F.col("target_atom_id").alias("atom_id"), F.lit("incoming").alias("direction"), "relation_type", F.col("source_atom_id").alias("related_id")))
    return ways.join(with_status(atoms, at).select(F.col("atom_id").alias("related_id"), F.col("status").alias("related_status")), "related_id")


def atom_counts(atoms: DataFrame, evidence: DataFrame, evolution: DataFrame) -> DataFrame:
    """A19. (atom_id, n_evidence, n_evolution, n_unresolved)."""
    ends = evolution.select(F.explode(F.array("source_atom_id", "target_atom_id")).alias("atom_id"), "relation_type", "metadata")
    open_ = (F.col("relation_type") == "CONTRADICTION") & F.get_json_object("metadata", "$.resolved_at").isNull()
    evo = ends.groupBy("atom_id").agg(F.count("*").alias("n_evolution"), F.sum(F.coalesce(open_, F.lit(False)).cast("long")).alias("n_unresolved"))
    ev = evidence.groupBy("atom_id").agg(F.count_distinct("evidence_id").alias("n_evidence"))
    return atoms.select("atom_id").join(ev, "atom_id", "left").join(evo, "atom_id", "left").na.fill(0, ["n_evidence", "n_evolution", "n_unresolved"])
