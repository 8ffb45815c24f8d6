"""Communities (D1-D9) and connected groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memloom.functions.ids import community_id
from memloom.operators.graph import both_ways
from memloom.sources.tables import write_through


def shuffled(df: DataFrame) -> DataFrame:
    """df as the right side of a join that is dealt by its keys: a table of nodes weighs little as a file and much in the driver, which would
    send it out anew in every round."""
    return df.hint("merge")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) by falling labels, cut each round; component is the smallest node reachable."""
    ways = write_through(both_ways(edges.select("a", "b").filter("a <> b")).distinct(), "ways")
    labels = ways.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label"))
    while True:
        near = ways.join(shuffled(labels.withColumnRenamed("node", "other")), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(shuffled(near), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = write_through(lower.join(shuffled(jump), "label").select("node", "was", F.least("label", "jump").alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.filter("label <> was").limit(1).count():
            return labels.withColumnRenamed("label", "component")


def _moved(ways: DataFrame, part: DataFrame, m2: float, gamma: float, seed: int, inside: str | None = None) -> DataFrame:
    """(node, community) after local moves until no node gains. ways: (node, other, weight), from both ends; part: (node, community, k,
    and, if inside is named, that column): nodes then only move within one value of it. Each round a seeded share may move, half
    at first and fewer later on, so that neighbours do not go on swapping; a node leaves only for more modularity, so the
    rounds end: when no node of any share would move."""
    bound = [inside] if inside else []
    r = 0
    while True:
        shares = 2 + r // 8
        sized = part.join(shuffled(part.groupBy("community").agg(F.sum("k").alias("total"))), "community")
        to = sized.select(F.col("node").alias("other"), F.col("community").alias("target"), F.col("total").alias("of_target"), *(F.col(c).alias(f"_{c}") for c in bound))
        inner = ways.filter("node <> other").join(shuffled(to), "other").groupBy("node", "target", "of_target", *(f"_{c}" for c in bound)).agg(F.sum("weight").alias("k_in"))
        met = sized.join(shuffled(inner), "node", "left")
        if inside:
            met = met.filter(F.col("target").isNull() | (F.col(inside) == F.col(f"_{inside}")) | (F.col("target") == F.col("community")))
        mine = F.col("target") == F.col("community")
        others = F.col("of_target") - F.when(mine, F.col("k")).otherwise(0.0)
        gain = F.col("k_in") - gamma * F.col("k") * others / m2
        alone = -gamma * F.col("k") * (F.col("total") - F.col("k")) / m2
        best = met.groupBy("node").agg(F.max(F.struct(gain.alias("gain"), "target")).alias("best"), F.max(F.when(mine, gain)).alias("stay"), F.first(alone).alias("alone"))
        turn = F.pmod(F.xxhash64("node", F.lit(seed + shares)) + r, F.lit(shares)) == 0
        would = F.coalesce(F.col("best.gain") > F.coalesce("stay", "alone") + 1e-9, F.lit(False))
        new = part.join(shuffled(best), "node", "left")
        new = new.select("node", F.when(would & turn, F.col("best.target")).otherwise(F.col("community")).alias("community"), "k", *bound, would.alias("would"))
        new = write_through(new, "partition")
        if not new.filter("would").limit(1).count():
            return part
        part, r = new.drop("would"), r + 1


#: Rounds of the random refinement: in each about half of the nodes that are still alone may join a group.
REFINE_ROUNDS = 8


def _refined(ways: DataFrame, alone: DataFrame, m2: float, gamma: float, theta: float, seed: int) -> DataFrame:
    """(node, community, k, home) after Leiden's random refinement. alone: (node, community, k, home), every node a community of its own. A
    node that is alone and well connected to its home joins a well-connected group of it with a probability that grows with
    exp(gain / theta), among those that gain (drawn by hashes, so reruns agree); groups of several nodes stay. In a round, nodes whose turn
    it is move, and only to groups that do not."""
    part = alone
    for r in range(REFINE_ROUNDS):
        turn = F.pmod(F.xxhash64("node", F.lit(seed + r)), F.lit(2)) == 0
        sized = part.join(shuffled(part.groupBy("community").agg(F.sum("k").alias("total"), F.count("*").alias("n"))), "community").withColumn("moves", turn & (F.col("n") == 1))
        near = sized.select(F.col("node").alias("other"), F.col("community").alias("target"), F.col("home").alias("_home"), F.col("total").alias("of_target"), F.col("moves").alias("_moves"))
        met = ways.filter("node <> other").join(shuffled(sized), "node").join(shuffled(near), "other").filter("home = _home and community <> target")
        whole = part.groupBy("home").agg(F.sum("k").alias("all"))
        out = met.groupBy("community", "home", "total").agg(F.sum("weight").alias("e")).join(shuffled(whole), "home")
        well = write_through(out.filter(F.col("e") >= gamma * F.col("total") * (F.col("all") - F.col("total")) / m2).select("community"), "well-connected")
        asked = met.filter("moves and not _moves").join(shuffled(well), "community", "left_semi").join(shuffled(well.select(F.col("community").alias("target"))), "target", "left_semi")
        gains = asked.groupBy("node", "k", "target", "of_target").agg(F.sum("weight").alias("k_in"))
        gains = gains.withColumn("gain", F.col("k_in") - gamma * F.col("k") * F.col("of_target") / m2).filter("gain > 0")
        u = (F.shiftrightunsigned(F.xxhash64("node", "target", F.lit(seed + r)), 11) + 0.5) / float(1 << 53)
        drawn = F.col("gain") / theta - F.log(-F.log(u))  # the largest of these is a draw by exp(gain / theta)
        best = gains.groupBy("node").agg(F.max_by("target", F.struct(drawn, "target")).alias("to"))
        new = write_through(part.join(shuffled(best), "node", "left").select("node", F.coalesce("to", "community").alias("community"), "k", "home", F.col("to").isNotNull().alias("moved")), "refined-round")
        part = new.drop("moved")
        if not new.filter("moved").limit(1).count() and r % 2:  # both halves have had their turn
            break
    return part


def communities(edges: DataFrame, gamma: float = 1.0, levels: int = 10, least_gain: float = 1e-3, seed: int = 19, theta: float | None = None) -> DataFrame:
    """D1. (node, community) by modularity in Leiden's manner: local moves until no node gains; refinement, where every node starts
    alone again and moves within its community (with theta: at random, see `_refined`); the refined groups become the nodes of the next level's graph and start in
    the communities found; up to `levels` times, or until modularity gains less than least_gain. Last, each community is split into
    its connected parts. Undirected, unweighted, parallel edges and loops left out; the name of a community is one of its nodes."""
    pairs = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ways = write_through(both_ways(pairs).select("node", "other", F.lit(1.0).alias("weight")), "ways")
    degree = write_through(ways.groupBy("node").agg(F.sum("weight").alias("k")), "degree")
    m2 = max(degree.agg(F.sum("k")).first()[0] or 0.0, 1.0)
    of = degree.select("node", F.col("node").alias("at"))  # the node of the present level that each first one is in
    part = degree.select("node", F.col("node").alias("community"), "k")
    was, done = -1.0, None
    for level in range(levels):
        part = _moved(ways, part, m2, gamma, seed + 100 * level)
        done = write_through(of.join(shuffled(part.select(F.col("node").alias("at"), "community")), "at").select("node", "community"), "communities")
        now = modularity(pairs, done).first()[0] or 0.0
        if now - was < least_gain:
            break
        was = now
        alone = part.select("node", F.col("node").alias("community"), "k", F.col("community").alias("home"))
        if theta is None:
            fine = _moved(ways, alone, m2, gamma, seed + 100 * level + 50, "home")
        else:
            fine = _refined(ways, alone, m2, gamma, theta, seed + 100 * level + 50)
        name = write_through(fine.select("node", F.col("community").alias("group"), "home", "k"), "refined")
        of = write_through(of.join(shuffled(name.select(F.col("node").alias("at"), "group")), "at").select("node", F.col("group").alias("at")), "of-level")
        here = name.select("node", F.col("group").alias("x"))
        ways = write_through(ways.join(shuffled(here), "node").join(shuffled(here.withColumnsRenamed({"node": "other", "x": "y"})), "other").groupBy(F.col("x").alias("node"), F.col("y").alias("other")).agg(F.sum("weight").alias("weight")), "ways")
        home = name.groupBy("home").agg(F.min("group").alias("community"))
        part = write_through(name.groupBy(F.col("group").alias("node"), "home").agg(F.sum("k").alias("k")).join(shuffled(home), "home").select("node", "community", "k"), "partition")
    inside = pairs.join(shuffled(done.withColumnsRenamed({"node": "a", "community": "ca"})), "a").join(shuffled(done.withColumnsRenamed({"node": "b", "community": "cb"})), "b").filter("ca = cb")
    whole = connected(inside.select("a", "b"))
    return done.join(shuffled(whole), "node", "left").select("node", F.coalesce("component", "node").alias("community"))


def modularity(edges: DataFrame, part: DataFrame) -> DataFrame:
    """One row: modularity of a partition."""
    pairs = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = pairs.join(shuffled(part.withColumnsRenamed({"node": "a", "community": "ca"})), "a").join(shuffled(part.withColumnsRenamed({"node": "b", "community": "cb"})), "b")
    ends = met.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count("*").alias("k"))
    inner = met.filter("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.count("*").alias("e"))
    m = met.agg(F.count("*").alias("m"))
    per = ends.join(shuffled(inner), "c", "left").na.fill(0).crossJoin(F.broadcast(m))  # m is one row
    return per.agg(F.sum(F.col("e") / F.col("m") - F.pow(F.col("k") / (2 * F.col("m")), 2)).alias("modularity"))


def check_partition(nodes: DataFrame, part: DataFrame) -> DataFrame:
    """D2. Nodes that have no community or several."""
    n = part.groupBy("node").agg(F.count_distinct("community").alias("n"))
    return nodes.select("node").join(n, "node", "left").filter(F.coalesce("n", F.lit(0)) != 1)


def canonicalize(part: DataFrame) -> DataFrame:
    """D3. (community_id, members): singletons go; the id depends on the members only. A community's row is as long as
    the community: its id is a hash of them all."""
    per = part.distinct().groupBy("community").agg(F.array_sort(F.collect_list("node")).alias("members")).filter(F.size("members") > 1)
    return per.select(community_id(F.col("members")).alias("community_id"), "members")


def community_context(members: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """D4. (community_id, n_members, n_relations, members, relations): counts, and the first `most` of each in order: ranked
    inside parts by hash first, so that no task sorts a whole community. members: (node, community_id)."""

    def top(df: DataFrame, item: str, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64("item"), F.lit(32)).cast("int")
        rows = df.select("community_id", F.expr(item).alias("item")).withColumn("part", part)
        first = rows.withColumn("n", F.row_number().over(W.partitionBy("community_id", "part").orderBy("item"))).filter(F.col("n") <= most)
        first = first.withColumn("n", F.row_number().over(W.partitionBy("community_id").orderBy("item"))).filter(F.col("n") <= most)
        return df.groupBy("community_id").agg(F.count("*").alias(f"n_{name}")).join(first.groupBy("community_id").agg(F.array_sort(F.collect_list("item")).alias(name)), "community_id")

    inner = edges.join(members.withColumnRenamed("node", "a"), "a").join(members.withColumnsRenamed({"node": "b", "community_id": "cb"}), "b").filter("community_id = cb")
    out = top(members, "node", "members").join(top(inner, "concat_ws('|', a, b)", "relations"), "community_id", "left")
    return out.na.fill(0, ["n_relations"]).withColumn("relations", F.coalesce("relations", F.array().cast("array<string>")))


def report_usage(reports: DataFrame) -> DataFrame:
    """D5. (run_id, tokens, source): the one source of a run's reports, or mixed."""
    return reports.groupBy("run_id").agg(F.sum("tokens").alias("tokens"), F.when(F.count_distinct("source") == 1, F.min("source")).otherwise("mixed").alias("source"))


#: States of a run, in the order in which they may follow each other. Fixed values.
RUN_STATES = ("running", "staged", "published", "failed")


def run_states(events: DataFrame) -> DataFrame:
    """D6. (run_id, workspace, state, snapshot_id) of each run, from its events (run_id, workspace, state, snapshot_id, seq): the last
    one counts, and nothing follows published or failed. Of several runs of a workspace that are neither, the first one is active
    and the others are refused."""
    final = F.col("state").isin("published", "failed")
    own = W.partitionBy("run_id").orderBy("seq")
    rows = events.withColumn("_done", F.max(final.cast("int")).over(own.rowsBetween(W.unboundedPreceding, -1))).filter(F.coalesce("_done", F.lit(0)) == 0)
    last = rows.groupBy("run_id").agg(F.max_by("workspace", "seq").alias("workspace"), F.max_by("state", "seq").alias("state"), F.max_by("snapshot_id", "seq").alias("snapshot_id"), F.min("seq").alias("began"))
    live = F.when(~F.col("state").isin("published", "failed"), F.row_number().over(W.partitionBy("workspace", F.col("state").isin("published", "failed")).orderBy("began")))
    return last.withColumn("_n", live).withColumn("state", F.when(F.col("_n") > 1, "refused").otherwise(F.col("state"))).drop("_n", "began")


def stage_snapshot(members: DataFrame, path: str, snapshot_id: str) -> None:
    """D6. A snapshot's partition; readers do not see it before it is published."""
    members.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite").parquet(f"{path}/staged/snapshot_id={snapshot_id}")


def publish_snapshot(members: DataFrame, path: str, snapshot_id: str, seq: int) -> None:
    """D6. The pointer to the latest published snapshot moves; the highest seq counts, so rolling back publishes again."""
    members.sparkSession.createDataFrame([(snapshot_id, seq)], "snapshot_id string, seq long").write.mode("append").parquet(f"{path}/published")


def published(spark, path: str) -> DataFrame:  # noqa: ANN001
    """D6. The members of the snapshot that counts."""
    last = spark.read.parquet(f"{path}/published").orderBy(F.desc("seq")).limit(1).select(F.col("snapshot_id").alias("_s"))
    rows = spark.read.parquet(f"{path}/staged")
    return rows.join(F.broadcast(last), rows["snapshot_id"] == F.col("_s")).drop("_s")


def assign_provisional(nodes: DataFrame, edges: DataFrame, members: DataFrame, hops: int = 3) -> DataFrame:
    """D7. (node, community_id, distance, paths) of new nodes: nearest community, then most shortest paths, then id. Only the
    number of ways to each node reached is carried: up to the nearest community no way turns back, so ways are paths; a node that
    has met one goes no further."""
    ways = write_through(both_ways(edges.select("a", "b")).distinct(), "provisional-ways")
    front = nodes.select("node", F.col("node").alias("at"), F.lit(1).cast("long").alias("ways")).distinct()
    found = None
    for d in range(1, hops + 1):
        step = front.join(ways.withColumnsRenamed({"node": "at", "other": "next"}), "at").groupBy("node", F.col("next").alias("at")).agg(F.sum("ways").alias("ways"))
        front = write_through(step, "provisional-front")
        hit = front.join(members.withColumnRenamed("node", "at"), "at").groupBy("node", "community_id").agg(F.sum("ways").alias("paths")).withColumn("distance", F.lit(d))
        hit = write_through(hit, "provisional-hits")
        found = hit if found is None else found.unionByName(hit)
        front = front.join(hit.select("node").distinct(), "node", "left_anti")
    w = W.partitionBy("node").orderBy("distance", F.desc("paths"), "community_id")
    return found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("node", "community_id", "distance", "paths")


def list_communities(members: DataFrame, search: str = "") -> DataFrame:
    """D8. (community_id, n_members)."""
    rows = members.filter(F.lower("node").contains(search.lower())).select("community_id").distinct() if search else members.select("community_id").distinct()
    return members.join(rows, "community_id", "left_semi").groupBy("community_id").agg(F.count("*").alias("n_members"))


def community_view(members: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """D9. Members with their entity, by id, then name, then alias."""
    by_id = entities.select(F.col("entity_id").alias("node"), F.col("entity_id").alias("e1"))
    by_name = entities.groupBy(F.col("canonical_name").alias("node")).agg(F.min("entity_id").alias("e2"))
    by_alias = aliases.groupBy(F.col("alias").alias("node")).agg(F.min("entity_id").alias("e3"))
    out = members.join(by_id, "node", "left").join(by_name, "node", "left").join(by_alias, "node", "left")
    return out.select("community_id", "node", F.coalesce("e1", "e2", "e3").alias("entity_id"))
