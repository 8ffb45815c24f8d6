"""Queries of communities, maintenance, reports and evaluation (D, M, W, E) over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import atoms, community, maintain
from memloom.plans import views as v
from memloom.plans.registry import at, query
from memloom.sources.tables import dealt, read, write_through


def _named(mark: str, c: Column) -> Column:
    return F.concat(F.lit(mark), c.cast("string"))


@query("d02_completeness", "SELECT c_custkey AS node FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0")
def d02(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("community"))
    part = c.filter("node % 7 <> 0").unionByName(c.filter("node % 7 <> 0 and node % 11 = 0").withColumn("community", F.lit(-1)))
    return community.check_partition(c, part).select("node")


@query("d05_report_usage", "SELECT c_nationkey AS run_id, sum(c_custkey)::BIGINT AS tokens, CASE WHEN count(DISTINCT CASE WHEN c_nationkey % 3 = 0 THEN c_custkey % 2 ELSE 0 END) = 1 THEN 'model-' || min(CASE WHEN c_nationkey % 3 = 0 THEN c_custkey % 2 ELSE 0 END) ELSE 'mixed' END AS source FROM customer GROUP BY 1")
def d05(spark: SparkSession, sf: str) -> DataFrame:
    source = F.when(F.col("c_nationkey") % 3 == 0, F.col("c_custkey") % 2).otherwise(0)
    return community.report_usage(read(spark, sf, "customer").select(F.col("c_nationkey").alias("run_id"), F.col("c_custkey").alias("tokens"), _named("model-", source).alias("source")))


@query(
    "d06_run_states",
    """
WITH e AS (SELECT event_id // 3 AS run, event_id AS seq, user_id, ['running', 'staged', 'failed', 'published'][event_id % 4 + 1] AS state FROM events),
f AS (SELECT run, min(seq) FILTER (state IN ('failed', 'published')) AS ended FROM e GROUP BY 1),
l AS (SELECT run, arg_max(state, seq) AS state, min(seq) AS began FROM e JOIN f USING (run) WHERE ended IS NULL OR seq <= ended GROUP BY 1)
SELECT run AS run_id, CASE WHEN state IN ('running', 'staged') AND row_number() OVER (PARTITION BY run % 20, state IN ('running', 'staged') ORDER BY began) > 1 THEN 'refused' ELSE state END AS state FROM l""",
)
def d06(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ("running", "staged", "failed", "published"))), (k % 4 + 1).cast("int"))
    run = F.floor(k / 3)
    events = read(spark, sf, "events").select(run.alias("run_id"), (run % 20).alias("workspace"), state.alias("state"), _named("snap-", run).alias("snapshot_id"), k.alias("seq"))
    return community.run_states(events).select("run_id", "state")


@query("d08_search", "SELECT c_nationkey::VARCHAR AS community_id, count(*) AS n_members FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE contains(lower(c_name), '7')) GROUP BY 1")
def d08(spark: SparkSession, sf: str) -> DataFrame:
    return community.list_communities(read(spark, sf, "customer").select(F.col("c_name").alias("node"), F.col("c_nationkey").cast("string").alias("community_id")), "7")


@query("d09_community_view", "SELECT k % 5 AS community_id, node, CASE WHEN k % 3 = 0 THEN 'sup-' || k WHEN k % 3 = 1 THEN 'sup-' || k WHEN k % 3 = 2 AND k % 2 = 0 THEN 'sup-' || k END AS entity_id FROM (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'sup-' || s_suppkey WHEN 1 THEN s_name ELSE 'alias ' || s_suppkey END AS node FROM supplier)")
def d09(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier")
    k, own = F.col("s_suppkey"), _named("sup-", F.col("s_suppkey"))
    node = F.when(k % 3 == 0, own).when(k % 3 == 1, F.col("s_name")).otherwise(_named("alias ", k))
    members = s.select((k % 5).alias("community_id"), node.alias("node"))
    entities = s.select(own.alias("entity_id"), F.col("s_name").alias("canonical_name"))
    aliases = s.filter("s_suppkey % 2 = 0").select(own.alias("entity_id"), _named("alias ", k).alias("alias"))
    return community.community_view(members, entities, aliases)


@query("m02_surviving", "SELECT src AS name, count(*) AS n FROM extractions WHERE source_id::BIGINT % 10 <> 0 AND src IN (SELECT src FROM extractions GROUP BY 1 HAVING count(*) FILTER (source_id::BIGINT % 10 = 0) > 0 AND count(*) FILTER (source_id::BIGINT % 10 <> 0) > 0) GROUP BY 1", ("extractions",))
def m02(spark: SparkSession, sf: str) -> DataFrame:
    x = v.extractions(spark, sf)
    gone = x.filter(F.col("source_id").cast("long") % 10 == 0).select("source_id").distinct()
    plan = maintain.plan_purge(x.groupBy(F.col("src").alias("owner")).agg(F.collect_list("source_id").alias("source_ids")), gone)
    return maintain.surviving(x.withColumnRenamed("src", "name"), plan, gone).groupBy("name").agg(F.count("*").alias("n"))


@query("m02_rebuild_order", "WITH r AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) SELECT 1 AS step, 'p' || p || '-s' || s AS owner FROM r WHERE s % 10 = 0 OR (p + s) % 13 = 0 UNION ALL SELECT 2, 's' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 0 UNION ALL SELECT 3, 's' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 1")
def m02b(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier").select(_named("s", F.col("s_suppkey")).alias("owner"), F.when(F.col("s_suppkey") % 10 == 0, "delete").when(F.col("s_suppkey") % 10 == 1, "rebuild").otherwise("untouched").alias("action"))
    p, q = F.col("l_partkey"), F.col("l_suppkey")
    own = write_through(read(spark, sf, "lineitem").select(p, q).distinct(), "pairs")  # read four times
    edges = own.select(F.concat(_named("p", p), F.lit("-"), _named("s", q)).alias("owner"), _named("p", p).alias("a"), _named("s", q).alias("b"))
    lost = own.filter("(l_partkey + l_suppkey) % 13 = 0").select(F.concat(_named("p", p), F.lit("-"), _named("s", q)).alias("owner"), F.lit("delete").alias("action"))
    return maintain.rebuild_order(s.unionByName(lost), edges)


@query("m03_deleted_tables", "WITH ev AS (SELECT * FROM evidence WHERE episode_id % 4 <> 0), live AS (SELECT atom_id FROM ev GROUP BY 1) SELECT 'evidence' AS name, count(*) AS n FROM ev UNION ALL SELECT 'atoms', count(*) FROM live UNION ALL SELECT 'entities', count(DISTINCT user_id) FROM events JOIN live ON atom_id = event_id WHERE user_id % 2 = 0 UNION ALL SELECT 'relations', count(DISTINCT user_id) FROM events JOIN live ON atom_id = event_id WHERE user_id % 2 = 1", ("evidence",))
def m03(spark: SparkSession, sf: str) -> DataFrame:
    """Even users are entities, odd ones relations of themselves, so that each table loses rows of its own."""
    e = read(spark, sf, "events")
    owner = F.when(F.col("user_id") % 2 == 0, _named("e", F.col("user_id"))).otherwise(_named("r", F.col("user_id")))
    a = e.select(F.col("event_id").alias("atom_id"), owner.alias("owner_id"))
    ents = a.filter(F.startswith("owner_id", F.lit("e"))).select(F.col("owner_id").alias("entity_id")).distinct()
    rels = a.filter(F.startswith("owner_id", F.lit("r"))).select(F.col("owner_id").alias("relation_id"), F.col("owner_id").alias("a"), F.concat("owner_id", F.lit("x")).alias("b")).distinct()
    ev = v.evidence(spark, sf)
    return maintain.workspace_counts(maintain.delete_episodes(a, ev, rels, ents, ev.filter("episode_id % 4 = 0").select("episode_id").distinct()))


@query("m04_recount", "SELECT a.atom_id, count(DISTINCT e.episode_id) AS support_count FROM atoms a LEFT JOIN evidence e USING (atom_id) GROUP BY 1", ("atoms", "evidence"))
def m04(spark: SparkSession, sf: str) -> DataFrame:
    a, ev = v.atoms(spark, sf).select("atom_id", F.lit(0).cast("long").alias("support_count")), v.evidence(spark, sf)
    return maintain.restored(a.filter("atom_id % 3 <> 0"), ev.filter("episode_id % 4 <> 0"), a, ev)[0].select("atom_id", "support_count")


@query("m07_project", "SELECT c_custkey AS owner_id, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS body, CASE WHEN c_custkey % 3 = 0 THEN 'n' || c_nationkey END AS paths, c_custkey % 4 = 0 AS tombstone FROM customer")
def m07(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").withColumnRenamed("c_custkey", "owner_id")
    return maintain.project_owners(c.select("owner_id"), c.filter("owner_id % 4 <> 0").select("owner_id", F.col("c_name").alias("body")), c.filter("owner_id % 3 = 0").select("owner_id", _named("n", F.col("c_nationkey")).alias("paths")))


@query("m08_orphans", "SELECT DISTINCT 'p' || l_partkey AS owner, l_orderkey::VARCHAR AS source_id FROM lineitem WHERE l_orderkey % 6 = 0")
def m08(spark: SparkSession, sf: str) -> DataFrame:
    x = v.extractions(spark, sf).select(F.col("src").alias("owner"), "source_id").distinct()
    chunks = x.filter(F.col("source_id").cast("long") % 6 != 0).select(F.col("source_id").alias("chunk_id"), F.lit("d").alias("doc_id")).distinct()
    return maintain.audit_anchors(x, x.select(F.lit("d").alias("doc_id"), "owner").distinct(), chunks)[1]


@query("m10_vector_rows", "SELECT 's' || s_suppkey AS id, s_name || chr(10) || 'nation ' || s_nationkey AS content FROM supplier")
def m10(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier").select(_named("s", F.col("s_suppkey")).alias("node"), F.col("s_name").alias("name"), _named("nation ", F.col("s_nationkey")).alias("text"))
    return maintain.vector_rows(s, "node", ["name", "text"])


@query("m12_repair", "WITH c AS (SELECT file_path, count(*) AS n, min(doc_id) AS first FROM docs WHERE doc_id % 6 <> 0 GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, doc_id % 6 = 0 OR (first IS NOT NULL AND n % 2 = 0 AND doc_id <> first) AS is_duplicate, CASE WHEN n % 2 = 0 AND doc_id <> first THEN first::VARCHAR END AS original_doc_id FROM docs LEFT JOIN c USING (file_path)", ("docs",))
def m12(spark: SparkSession, sf: str) -> DataFrame:
    """Conflicts of an even number of documents are repaired; the other choices carry a stale fingerprint."""
    d = v.docs(spark, sf).select("doc_id", "file_path", (F.col("doc_id") % 6 == 0).alias("is_duplicate"))
    found = maintain.source_conflicts(d)
    choices = found.select("file_path", F.col("sample").alias("primary_id"), "n", F.when(F.col("n") % 2 == 0, F.col("fingerprint")).otherwise("stale").alias("fingerprint"))
    return maintain.repair_conflicts(d, choices).select("doc_id", "is_duplicate", F.col("original_doc_id").cast("string").alias("original_doc_id"))


@query("m13_clean_cache", "SELECT event_id AS id FROM events WHERE NOT (event_type IN ('click', 'view') AND user_id % 3 IN (0, 1))")
def m13(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat_ws(":", "event_type", _named("k", F.col("user_id") % 3), F.md5("props")).alias("key"))
    return maintain.clean_cache(e, ["click", "view"], ["k0", "k1"]).select("id")


@query("w01_counts", "SELECT 'entities' AS name, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'relations', count(*) FROM edges UNION ALL SELECT 'atoms', count(*) FROM events UNION ALL SELECT 'evidence', count(*) FROM evidence UNION ALL SELECT 'communities', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'outbox', count(DISTINCT user_id) FROM events", ("edges", "evidence"))
def w01(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    changes = e.select(F.col("user_id").alias("owner_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("owner_snapshot"))
    members = read(spark, sf, "customer").select(F.col("c_name").alias("node"), F.col("c_nationkey").alias("community_id"))
    tables = {"entities": e.select("user_id").distinct(), "relations": v.edges(spark, sf), "atoms": v.atoms(spark, sf), "evidence": v.evidence(spark, sf), "communities": community.list_communities(members), "outbox": maintain.coalesce_outbox(changes)}
    return maintain.workspace_counts(tables)


@query(
    "w04_all_filters",
    """WITH s AS (SELECT * REPLACE (CASE WHEN owner_id % 2 = 0 THEN 'entity-' ELSE 'relation-' END || owner_id AS owner_id) FROM status)
SELECT 1 AS filter, atom_id FROM s WHERE owner_id LIKE 'entity-%' AND status = 'active' AND (contains(atom_id::VARCHAR, 'click') OR contains(content, 'click') OR contains(owner_id, 'click'))
UNION ALL SELECT 2, atom_id FROM s WHERE atom_id IN (SELECT source_atom_id FROM evolution WHERE relation_type = 'CONTRADICTION' UNION SELECT target_atom_id FROM evolution WHERE relation_type = 'CONTRADICTION') AND (valid_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' OR invalid_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20')
UNION ALL SELECT 3, atom_id FROM s WHERE atom_id IN (SELECT atom_id FROM evidence WHERE episode_id = 7) AND (created_at >= TIMESTAMP '2024-01-10' OR expired_at >= TIMESTAMP '2024-01-10')
UNION ALL SELECT 4, atom_id FROM s WHERE owner_id LIKE 'relation-%' AND atom_id IN (SELECT source_atom_id FROM evolution UNION SELECT target_atom_id FROM evolution)""",
    ("status", "evidence", "evolution"),
)
def w04_all(spark: SparkSession, sf: str) -> DataFrame:
    owner = F.concat(F.when(F.col("owner_id") % 2 == 0, "entity-").otherwise("relation-"), F.col("owner_id").cast("string"))
    a = atoms.with_status(v.atoms(spark, sf), at()).withColumn("owner_id", owner)
    day = lambda d: F.to_timestamp_ntz(F.lit(f"2024-01-{d:02d} 00:00:00")).cast("timestamp")
    told, evo = v.evidence(spark, sf), v.evolution(spark, sf)
    asked = [{"owner_kind": "entity", "status": "active", "search": "CLICK"}, {"evolution_type": "CONTRADICTION", "valid": (day(5), day(20))}, {"episode_id": 7, "system": (day(10), None)}, {"owner_kind": "relation", "evolution_type": "any"}]
    parts = [maintain.filter_atoms(a, told, evo, **x).select(F.lit(k).alias("filter"), "atom_id") for k, x in enumerate(asked, 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("w02_all_filters", "SELECT o_orderkey AS episode_id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND (contains(o_orderkey::VARCHAR, '9') OR contains(lower(o_orderpriority), '9') OR contains('u' || o_custkey, '9')) AND o_orderdate BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1996-12-31'")
def w02_all(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    source = F.concat(F.lit("u"), F.col("o_custkey").cast("string"))
    rows = o.select(F.col("o_orderkey").alias("episode_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind"), F.col("o_orderpriority").alias("content"), source.alias("source_uri"), F.col("o_orderdate").alias("reference_at"))
    day = lambda d: F.to_timestamp_ntz(F.lit(f"{d} 00:00:00")).cast(o.schema["o_orderdate"].dataType)
    return maintain.filter_episodes(rows, "F", "1-URGENT", "9", (day("1993-01-01"), day("1996-12-31"))).select("episode_id")


@query("w02_filtered", "SELECT conv_id || '-' || turn AS episode_id, CASE WHEN n IS NULL THEN 0 ELSE n END AS n_evidence FROM conversations LEFT JOIN (SELECT episode_id, count(*) AS n FROM evidence GROUP BY 1) e ON e.episode_id || '-0' = conv_id || '-' || turn WHERE role = 'user' AND contains(lower(text), 'e')", ("evidence",))
def w02(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws("-", "conv_id", "turn")
    episodes = read(spark, sf, "conversations").select(key.alias("episode_id"), F.col("role").alias("kind"), F.col("text").alias("content"))
    ev = v.evidence(spark, sf).withColumn("episode_id", F.concat(F.col("episode_id").cast("string"), F.lit("-0")))
    return maintain.list_episodes(episodes, ev, "user", "E").select("episode_id", "n_evidence")


@query("w03_owners", "SELECT user_id AS owner_id, n AS n_atoms, 1 + user_id % 3 AS n_aliases, CASE WHEN user_id % 5 = 0 THEN 2 ELSE 0 END AS n_ambiguous, row_number() OVER (ORDER BY user_id % 5 = 0 DESC, n DESC, 'user ' || user_id, user_id) AS place FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def w03(spark: SparkSession, sf: str) -> DataFrame:
    a = v.atoms(spark, sf)
    owners = a.select("owner_id", _named("user ", F.col("owner_id")).alias("name")).distinct()
    aliases = owners.select("owner_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("owner_id") % 3)).alias("alias"))
    ambiguous = owners.filter("owner_id % 5 = 0").select(F.col("owner_id").alias("entity_id"), F.lit(2).cast("long").alias("n_ambiguous"))
    out = maintain.list_owners(owners, a, aliases, ambiguous)
    from pyspark.sql import Window as W

    place = F.row_number().over(W.orderBy(F.desc(F.col("n_ambiguous") > 0), F.desc("n_atoms"), "name", "owner_id"))  # owners of one page's report
    return out.select("owner_id", "n_atoms", "n_aliases", "n_ambiguous", place.alias("place"))


@query("w04_atoms", "SELECT s.atom_id, s.owner_id, 'user ' || s.owner_id AS owner_name, coalesce(n, 0) AS n_evidence FROM status s LEFT JOIN (SELECT atom_id, count(*) AS n FROM evidence GROUP BY 1) e USING (atom_id) WHERE status = 'active' AND s.owner_id % 2 = 0 AND contains(lower(content), 'c')", ("status", "evidence"))
def w04(spark: SparkSession, sf: str) -> DataFrame:
    a = atoms.with_status(v.atoms(spark, sf), at())
    owners = a.select("owner_id", _named("user ", F.col("owner_id")).alias("owner_name"), F.when(F.col("owner_id") % 2 == 0, "entity").otherwise("relation").alias("owner_kind")).distinct()
    counts = atoms.atom_counts(a, v.evidence(spark, sf), v.evolution(spark, sf))
    return maintain.list_atoms(a, owners, counts, "active", "C", "entity").select("atom_id", "owner_id", "owner_name", "n_evidence")


@query("w05_owner_view", "SELECT user_id AS owner_id, count(*) AS n, string_agg(event_type || '@' || event_id, ',' ORDER BY event_id) AS atoms FROM events WHERE user_id % 4 = 0 GROUP BY 1")
def w05(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").filter("user_id % 4 = 0")
    owners = e.select(F.col("user_id").alias("owner_id")).distinct()
    children = e.select(F.col("user_id").alias("owner_id"), F.col("event_id").alias("seq"), F.concat_ws("@", "event_type", "event_id").alias("body"))
    out = maintain.nested_view(owners, children, "owner_id", "seq", "atoms")
    return out.select("owner_id", F.size("atoms").cast("long").alias("n"), F.array_join(F.transform("atoms", lambda x: x["body"]), ",").alias("atoms"))


@query("w06_totals", "SELECT count(*) AS total, ceil(count(*) / 50.0)::BIGINT AS pages FROM orders")
def w06(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.page_total(read(spark, sf, "orders"), 50)


@query("w07_document_page", "SELECT doc_id FROM (SELECT doc_id, source || '/' || (doc_id % 140) AS file_path FROM documents WHERE lang = 'en') ORDER BY file_path DESC, doc_id LIMIT 40 OFFSET 40")
def w07(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id") % 140).alias("file_path"), F.col("lang").alias("status"))
    return maintain.document_page(d, 2, 40, "file_path", True, "en").select("doc_id")


@query("e04_metrics", "WITH t AS (SELECT l_orderkey AS query_id, l_partkey AS name, min(l_linenumber) AS x FROM lineitem GROUP BY 1, 2), r AS (SELECT query_id, name, (name * 7 + query_id) % 15 + 1 AS rank FROM t WHERE (name + query_id) % 3 <> 0), p AS (SELECT t.query_id, count(r.rank) / count(*) AS recall, coalesce(1 / min(r.rank), 0.0) AS rr FROM t LEFT JOIN (SELECT * FROM r WHERE rank <= 10) r USING (query_id, name) GROUP BY 1) SELECT round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, count(*) FILTER (recall = 1) AS full_recall, count(*) FILTER (recall = 0) AS no_hit FROM p")
def e04(spark: SparkSession, sf: str) -> DataFrame:
    truth = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("name"))
    truth = dealt(truth, "query_id", "name").distinct()  # the join of both tables is dealt as these are
    ranked = truth.filter("(name + query_id) % 3 <> 0").withColumn("rank", (F.col("name") * 7 + F.col("query_id")) % 15 + 1)
    out = maintain.retrieval_metrics(ranked, truth)
    return out.select(F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), "full_recall", "no_hit")


@query("e05_success", "SELECT 'half' AS metric, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 <> 0) AS n, round(count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 <> 0) / count(*), 6) AS success_rate, round(avg(quality) FILTER (doc_id % 2 = 0 AND doc_id % 3 <> 0), 6) AS mean FROM labels")
def e05(spark: SparkSession, sf: str) -> DataFrame:
    half = F.when(F.col("doc_id") % 2 == 0, F.when(F.col("doc_id") % 3 == 0, float("nan")).otherwise(F.col("quality")))
    out = maintain.score_summary(read(spark, sf, "labels").select(half.alias("half")), ["half"])
    return out.select("metric", "n", F.round("success_rate", 6).alias("success_rate"), F.round("mean", 6).alias("mean"))
