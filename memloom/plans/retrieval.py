"""Queries of retrieval and the graph (V, Q, G) over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memloom.operators import explore, graph, retrieve, vector
from memloom.plans import views as v
from memloom.plans.registry import at, query
from memloom.sources.tables import read, write_through


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _named(mark: str, c: Column) -> Column:
    return F.concat(F.lit(mark), c.cast("string"))


def _hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return vector.vector_topk(v.queries(spark, sf), v.vectors(spark, sf), k)


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "supplier").filter("s_suppkey % 9 <> 0").select(_named("s", F.col("s_suppkey")).alias("node"), F.col("s_name").alias("description"))


@query("v03_drop_incident", "SELECT l_orderkey AS id FROM (SELECT l_orderkey, min(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY 1) WHERE p % 5 <> 0 AND s % 4 <> 0")
def v03(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(_named("p", F.min("l_partkey")).alias("src"), _named("s", F.max("l_suppkey")).alias("tgt"))
    names = read(spark, sf, "part").filter("p_partkey % 5 = 0").select(_named("p", F.col("p_partkey")).alias("name"))
    return vector.drop_incident(rows, names.unionByName(read(spark, sf, "supplier").filter("s_suppkey % 4 = 0").select(_named("s", F.col("s_suppkey")).alias("name")))).select("id")


@query("v04_by_ids", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def v04(spark: SparkSession, sf: str) -> DataFrame:
    return vector.vectors_by_ids(v.vectors(spark, sf), read(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))).select("id", "label")


@query(
    "v05_pick_by_vector",
    """
WITH c AS (SELECT q.query_id, k AS owner, (q.query_id * 3 + k * 11 + j * 7) % (SELECT count(*) FROM embeddings) + CASE WHEN q.query_id % 100 = 0 AND k = 0 AND j = 0 THEN 100000000 ELSE 0 END AS chunk_id FROM queries q, (SELECT unnest(range(0, 3)) AS k), (SELECT unnest(range(0, 5)) AS j)),
u AS (SELECT DISTINCT query_id, chunk_id FROM c),
s AS (SELECT u.query_id, chunk_id, CASE WHEN v IS NOT NULL THEN list_dot_product(qv, v) / sqrt(list_dot_product(qv, qv) * list_dot_product(v, v)) END AS score FROM u JOIN queries USING (query_id) LEFT JOIN vectors ON id = chunk_id)
SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE query_id NOT IN (SELECT query_id FROM s WHERE score IS NULL)) WHERE rank <= 6""",
    ("queries", "vectors"),
)
def v05(spark: SparkSession, sf: str) -> DataFrame:
    total = read(spark, sf, "embeddings").agg(F.count("*").alias("total"))  # one row
    c = v.queries(spark, sf).select("query_id").withColumn("owner", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4)))).crossJoin(F.broadcast(total))
    lost = F.when((F.col("query_id") % 100 == 0) & (F.col("owner") == 0) & (F.col("j") == 0), 100000000).otherwise(0)
    c = c.select("query_id", "owner", ((F.col("query_id") * 3 + F.col("owner") * 11 + F.col("j") * 7) % F.col("total") + lost).alias("chunk_id"))
    return vector.pick_by_vector(v.queries(spark, sf), c, v.vectors(spark, sf), 4)


@query("q02_local_entities", "SELECT query_id, node, rank, s_name AS description, coalesce(degree, 0) AS degree FROM (SELECT query_id, id % 100 AS k, 's' || (id % 100) AS node, rank FROM hits WHERE rank <= 5) h JOIN supplier ON s_suppkey = k LEFT JOIN deg USING (node) WHERE s_suppkey % 9 <> 0", ("hits", "deg"))
def q02(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf, 5).select("query_id", _named("s", F.col("id") % 100).alias("node"), "rank")
    return retrieve.local_entities(hits, _nodes(spark, sf), v.edges(spark, sf)).select("query_id", "node", "rank", "description", "degree")


_RELATIONS = "SELECT query_id, 'p' || (id % 50) AS a, 's' || (rank * 7 % 100) AS b, rank FROM hits WHERE rank <= 6"


def _relation_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, 6).select("query_id", _named("p", F.col("id") % 50).alias("a"), _named("s", F.col("rank") * 7 % 100).alias("b"), "rank")


@query("q04_global_relations", f"SELECT query_id, a, b, rank, weight FROM ({_RELATIONS}) JOIN edges USING (a, b)", ("hits", "edges"))
def q04(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.global_relations(_relation_hits(spark, sf), v.edges(spark, sf)).select("query_id", "a", "b", "rank", "weight")


_MODES = "['local', 'global', 'hybrid', 'mix', 'naive'][query_id // 20 % 5 + 1]"


@query(
    "q07_modes",
    f"""
WITH m AS (SELECT query_id, {_MODES} AS mode FROM queries),
le AS (SELECT h.query_id, h.node, h.rank FROM (SELECT query_id, id % 100 AS k, 's' || (id % 100) AS node, rank FROM hits WHERE rank <= 3) h JOIN supplier ON s_suppkey = k JOIN m USING (query_id) WHERE s_suppkey % 9 <> 0 AND mode IN ('local', 'hybrid', 'mix')),
gr AS (SELECT r.*, weight FROM ({_RELATIONS}) r JOIN edges USING (a, b) JOIN m USING (query_id) WHERE mode IN ('global', 'hybrid', 'mix')),
ge AS (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY o, node) AS pos FROM (SELECT query_id, node, min(rank * 2 + side) AS o FROM (SELECT query_id, rank, 0 AS side, a AS node FROM gr UNION ALL SELECT query_id, rank, 1, b FROM gr) GROUP BY ALL)),
lr AS (SELECT query_id, a, b, row_number() OVER (PARTITION BY query_id ORDER BY x.degree + y.degree DESC, weight DESC, a, b) AS pos FROM (SELECT DISTINCT le.query_id, e.a, e.b, e.weight FROM le JOIN edges e ON e.b = le.node OR e.a = le.node) p JOIN deg x ON x.node = p.a JOIN deg y ON y.node = p.b),
ents AS (SELECT query_id, node, min(k) AS k FROM (SELECT query_id, node, rank * 2 AS k FROM le UNION ALL SELECT query_id, node, pos * 2 + 1 FROM ge) GROUP BY ALL),
rels AS (SELECT query_id, a || chr(31) || b AS pair, min(k) AS k FROM (SELECT query_id, a, b, pos * 2 AS k FROM lr UNION ALL SELECT query_id, a, b, rank * 2 + 1 FROM gr) GROUP BY ALL)
SELECT 'entity' AS part, query_id, node AS item, row_number() OVER (PARTITION BY query_id ORDER BY k, node) AS pos FROM ents
UNION ALL SELECT 'relation', query_id, pair, row_number() OVER (PARTITION BY query_id ORDER BY k, pair) FROM rels
UNION ALL SELECT 'chunk', query_id, id::VARCHAR, rank FROM hits JOIN m USING (query_id) WHERE rank <= 4 AND mode IN ('naive', 'mix')""",
    ("hits", "deg"),
)
def q07(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth query in each mode: local, global, hybrid, mix and naive."""
    modes = F.element_at(F.array(*map(F.lit, ("local", "global", "hybrid", "mix", "naive"))), (F.floor(F.col("query_id") / 20) % 5 + 1).cast("int"))
    asked = v.queries(spark, sf).select("query_id", modes.alias("mode"))
    hits = write_through(_hits(spark, sf, 6), "hits")  # the search runs once
    own = hits.filter("rank <= 3").select("query_id", _named("s", F.col("id") % 100).alias("node"), "rank")
    wide = hits.select("query_id", _named("p", F.col("id") % 50).alias("a"), _named("s", F.col("rank") * 7 % 100).alias("b"), "rank")
    ents, rels, chunks = retrieve.retrieve(asked, own, wide, hits.filter("rank <= 4"), _nodes(spark, sf), write_through(v.edges(spark, sf), "edges"))
    row = lambda df, part, item, pos: df.select(F.lit(part).alias("part"), "query_id", F.col(item).cast("string").alias("item"), F.col(pos).cast("long").alias("pos"))
    return row(ents, "entity", "node", "pos").unionByName(row(rels, "relation", "pair", "pos")).unionByName(row(chunks, "chunk", "id", "rank"))


_OWNED = "SELECT l_suppkey % 10 AS query_id, l_suppkey AS owner, l_orderkey AS chunk_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS place FROM lineitem"


@query("q09_relation_chunks", f"SELECT query_id, owner, chunk_id, frequency, row_number() OVER (PARTITION BY query_id, owner ORDER BY frequency DESC, place) - 1 AS pos FROM (SELECT *, count(*) OVER (PARTITION BY query_id, chunk_id) AS frequency, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY owner, place) AS n FROM ({_OWNED})) WHERE n = 1 QUALIFY chunk_id % 3 <> 0")
def q09(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    owners = li.groupBy((F.col("l_suppkey") % 10).alias("query_id"), F.col("l_suppkey").alias("owner")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))), lambda x: x["l_orderkey"]).alias("source_ids")).withColumn("place", F.col("owner"))
    chosen = li.filter("l_orderkey % 3 = 0").select((F.col("l_suppkey") % 10).alias("query_id"), F.col("l_orderkey").alias("chunk_id")).distinct()
    return retrieve.relation_chunks(owners, chosen).select("query_id", "owner", "chunk_id", "frequency", "pos")


@query("q11_finalize", "SELECT query_id, chunk_id, 'DC' || rank AS id FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS t FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, pos) AS rank FROM (SELECT o_custkey AS query_id, o_orderkey AS chunk_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_orderkey % 50 + 1 AS tokens, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 97) / 97.0 END AS score FROM orders) WHERE coalesce(score, 1.0) >= 0.3) WHERE rank <= 6) WHERE t <= 100")
def q11(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    pos = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    chunks = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), pos.alias("pos"), (F.col("o_orderkey") % 50 + 1).alias("tokens"))
    scores = o.filter("o_orderkey % 4 <> 0").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), (F.col("o_orderkey") % 97 / 97).alias("score"))
    return retrieve.finalize_chunks(chunks, scores, 6, 0.3, 100).select("query_id", "chunk_id", "id")


@query("q12_chunk_budget", "SELECT c_custkey AS query_id, greatest(3000 - c_custkey % 1000 - c_nationkey * 100 - 50 - 200, 0)::BIGINT AS budget FROM customer")
def q12(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("query_id"), retrieve.chunk_budget(3000, F.col("c_custkey") % 1000, F.col("c_nationkey") * 100, F.lit(50)).cast("long").alias("budget"))


@query("q14_structured", "SELECT query_id, count(*) FILTER (rank <= 3) AS n_entities, count(*) FILTER (rank <= 2) AS n_relations, count(*) FILTER (rank <= 4) AS n_chunks, count(DISTINCT id % 7) FILTER (rank <= 4) AS n_references, count(*) FILTER (rank <= 8) AS n_entities_found, max(id) FILTER (rank = 1) AS first_entity FROM hits GROUP BY 1", ("hits",))
def q14(spark: SparkSession, sf: str) -> DataFrame:
    hits = write_through(_hits(spark, sf, 8), "hits").withColumn("pos", F.col("rank")).withColumn("file_path", (F.col("id") % 7).cast("string"))
    ents = hits.filter("rank <= 3").select("query_id", "pos", "id")
    chunks = hits.filter("rank <= 4").select("query_id", "rank", "id", "file_path")
    out = retrieve.structured(ents, hits.filter("rank <= 2").select("query_id", "pos", "id"), chunks, retrieve.reference_list(chunks), {"entities": hits})
    return out.select("query_id", "n_entities", "n_relations", "n_chunks", "n_references", "n_entities_found", F.col("entities")[0]["id"].alias("first_entity"))


@query("q15_chunk_sources", "SELECT query_id, chunk_id, source, row_number() OVER (PARTITION BY query_id ORDER BY k, chunk_id) AS pos FROM (SELECT query_id, chunk_id, arg_min(source, k) AS source, min(k) AS k FROM (SELECT l_suppkey AS query_id, l_orderkey AS chunk_id, 'C' AS source, l_linenumber * 3 AS k FROM lineitem WHERE l_orderkey % 3 = 0 UNION ALL SELECT l_suppkey, l_orderkey % 50, 'E', l_linenumber * 3 + 1 FROM lineitem UNION ALL SELECT l_suppkey, l_orderkey % 90, 'R', l_linenumber * 3 + 2 FROM lineitem) GROUP BY 1, 2)")
def q15(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    part = lambda df, c: df.select(F.col("l_suppkey").alias("query_id"), c.alias("chunk_id"), F.col("l_linenumber").alias("pos"))
    return retrieve.chunk_sources(part(li.filter("l_orderkey % 3 = 0"), F.col("l_orderkey")), part(li, F.col("l_orderkey") % 50), part(li, F.col("l_orderkey") % 90))


@query("q16_headings", "SELECT query_id, id AS chunk_id, CASE WHEN id % 2 = 0 THEN 'Part ' || label END AS path FROM hits JOIN vectors USING (id) WHERE rank <= 5", ("hits",))
def q16(spark: SparkSession, sf: str) -> DataFrame:
    paths = v.vectors(spark, sf).filter("id % 2 = 0").select(F.col("id").alias("chunk_id"), _named("Part ", F.col("label")).alias("path"))
    return retrieve.attach_headings(_hits(spark, sf, 5).select("query_id", F.col("id").alias("chunk_id")), paths).select("query_id", "chunk_id", "path")


@query("q17_rerank_windows", "SELECT query_id, doc, i::INTEGER AS window, md5(array_to_string(t[i * 48 + 1:i * 48 + 60], ' ')) AS content_hash FROM (SELECT *, unnest(range(0, (len(t) - 1) // 48 + 1)) AS i FROM (SELECT doc_id % 40 AS query_id, doc_id AS doc, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM documents) WHERE len(t) > 0)")
def q17(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("doc"), F.col("text").alias("content"))
    return retrieve.rerank_split(d, 60, 12).select("query_id", "doc", "window", F.md5("content").alias("content_hash"))


@query("g03_lookup_nodes", "SELECT p_partkey AS node, s_name IS NOT NULL AS found, s_name AS description FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def g03(spark: SparkSession, sf: str) -> DataFrame:
    nodes = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("description"))
    return graph.lookup_nodes(nodes, read(spark, sf, "part").select(F.col("p_partkey").alias("node")))


@query("g07_all_labels", "SELECT DISTINCT node FROM deg", ("deg",))
def g07(spark: SparkSession, sf: str) -> DataFrame:
    return graph.all_labels(graph.both_ways(v.edges(spark, sf)))


@query(
    "g10_expand",
    """
WITH f AS (SELECT 's' || s_suppkey AS node, s_nationkey AS query_id FROM supplier WHERE s_nationkey < 5 UNION ALL SELECT 'nobody', 99),
m AS (SELECT f.query_id, f.node, w.other, coalesce(substr(w.other, 2)::BIGINT % 2 = 0, false) AS seen FROM f LEFT JOIN ways w ON w.node = f.node),
c AS (SELECT *, count(*) FILTER (other IS NOT NULL AND NOT seen) OVER (PARTITION BY query_id, node) AS fresh, count(other) OVER (PARTITION BY query_id, node) AS n, row_number() OVER (PARTITION BY query_id, node ORDER BY seen, other) AS r FROM m)
SELECT query_id, node, CASE WHEN fresh > 0 THEN other END AS other, CASE WHEN n = 0 THEN 'not_found' WHEN fresh = 0 THEN 'exhausted' WHEN fresh > 7 THEN 'truncated' ELSE 'complete' END AS state FROM c WHERE (other IS NOT NULL AND NOT seen AND r <= 7) OR (fresh = 0 AND r = 1)""",
    ("edges", "ways"),
)
def g10(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier").filter("s_nationkey < 5").select(F.col("s_nationkey").cast("long").alias("query_id"), _named("s", F.col("s_suppkey")).alias("node"))
    front = s.unionByName(spark.createDataFrame([(99, "nobody")], "query_id long, node string"))
    edges = write_through(v.edges(spark, sf), "edges")
    nodes = s.select("query_id").distinct().join(edges.filter("substring(a, 2) % 2 = 0").select(F.col("a").alias("node")).distinct())
    # each nation has visited the relations of its own suppliers
    pairs = s.join(edges.select("a", F.col("b").alias("node")), "node").select("query_id", "a", F.col("node").alias("b"))
    return graph.expand(front, edges, nodes, pairs, 7)


@query("g11_describe_owners", "WITH o AS (SELECT DISTINCT owner_id FROM atoms WHERE owner_id % 3 = 0), a AS (SELECT owner_id, atom_id, content, row_number() OVER (PARTITION BY owner_id ORDER BY seq DESC) AS n FROM atoms) SELECT o.owner_id, 'user ' || o.owner_id AS canonical_name, c.n AS n_atoms, t.t AS atoms, 'u' || o.owner_id || ',user ' || o.owner_id AS aliases FROM o JOIN (SELECT owner_id, count(*) AS n FROM atoms GROUP BY 1) c USING (owner_id) JOIN (SELECT owner_id, string_agg(atom_id || '=' || content, ',' ORDER BY n DESC) AS t FROM a WHERE n <= 8 GROUP BY 1) t USING (owner_id)", ("atoms",))
def g11(spark: SparkSession, sf: str) -> DataFrame:
    a = v.atoms(spark, sf)
    owners = a.filter("owner_id % 3 = 0").select("owner_id", _named("user ", F.col("owner_id")).alias("canonical_name"), F.lit("user").alias("entity_type")).distinct()
    aliases = a.select(F.col("owner_id").alias("entity_id"), F.explode(F.array(_named("u", F.col("owner_id")), _named("user ", F.col("owner_id")))).alias("alias")).distinct()
    out = graph.describe_owners(owners, a, aliases)
    return out.select("owner_id", "canonical_name", "n_atoms", F.array_join(F.transform("atoms", lambda x: F.concat_ws("=", x["atom_id"].cast("string"), x["content"])), ",").alias("atoms"), F.array_join("aliases", ",").alias("aliases"))


@query("g12_owner_evidence", "SELECT owner_id, atom_id, episode_id, evidence_id, rank FROM (SELECT a.owner_id, e.*, row_number() OVER (PARTITION BY owner_id ORDER BY evidence_id DESC) AS rank FROM atoms a JOIN evidence e USING (atom_id) WHERE owner_id % 3 = 0) WHERE rank <= 5", ("atoms", "evidence"))
def g12(spark: SparkSession, sf: str) -> DataFrame:
    a = v.atoms(spark, sf)
    return graph.owner_evidence(a.filter("owner_id % 3 = 0").select("owner_id"), a, v.evidence(spark, sf), 5)


_FRONT = """n AS (SELECT DISTINCT a AS node FROM edges UNION SELECT DISTINCT b FROM edges),
k AS (SELECT lower(node) AS key, min(node) AS node FROM (SELECT node FROM n UNION ALL SELECT node FROM (SELECT s_name, 's' || s_suppkey AS node FROM supplier)) GROUP BY 1
  UNION ALL SELECT lower(s_name), 's' || s_suppkey FROM supplier),
q AS (SELECT s_nationkey AS query_id, s_name AS name FROM supplier UNION ALL SELECT DISTINCT s_nationkey, 'Nobody ' || s_nationkey FROM supplier WHERE s_nationkey % 4 = 0),
f AS (SELECT query_id, name, k.node FROM q LEFT JOIN k ON k.key = lower(name)),
c AS (SELECT f.*, w.other, row_number() OVER (PARTITION BY query_id, name ORDER BY w.other) AS r FROM f JOIN ways w USING (node) WHERE substr(w.other, 2)::BIGINT % 2 = 1 OR query_id % 3 = 0)"""


def _asked(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    """Suppliers by their names, which are aliases of nodes, and a name that nobody has, in every fourth nation; even parts were visited,
    and in two of three nations their relations with the nation's own suppliers too."""
    s = read(spark, sf, "supplier").withColumn("query_id", F.col("s_nationkey").cast("long"))
    front = s.select("query_id", F.col("s_name").alias("name"))
    front = front.unionByName(s.filter("query_id % 4 = 0").select("query_id", F.concat(F.lit("Nobody "), F.col("query_id").cast("string")).alias("name")).distinct())
    edges = write_through(v.edges(spark, sf).select("a", "b"), "edges").withColumn("keywords", F.lit("sells"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("entity_type", F.when(F.startswith("node", F.lit("p")), "part").otherwise("supplier"))
    own = s.select(_named("s", F.col("s_suppkey")).alias("node"), "query_id")
    nodes = nodes.unionByName(own.select("node", F.lit("supplier").alias("entity_type"))).distinct()
    aliases = s.select(_named("s", F.col("s_suppkey")).alias("node"), F.col("s_name").alias("alias"))
    even = edges.filter(F.substring("a", 2, 20).cast("long") % 2 == 0)
    seen = even.select("a").distinct().select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("query_id"), F.col("a").alias("name"))
    told = even.join(own.filter("query_id % 3 > 0").withColumnRenamed("node", "b"), "b").select("query_id", F.col("a").alias("src"), F.upper("b").alias("tgt"))
    return front, nodes, edges, seen, told, aliases


@query("g10_names", f"WITH {_FRONT} SELECT query_id, CASE WHEN missing > 0 THEN 'partial' WHEN truncated THEN 'truncated' ELSE 'complete' END AS status, missing = 0 AND NOT truncated AND available = 0 AS exhausted, missing, available::BIGINT AS available_count, returned::BIGINT AS returned_count FROM (SELECT query_id, count(*) FILTER (node IS NULL) AS missing, max(coalesce(n, 0)) > 20 AS truncated, sum(coalesce(n, 0)) AS available, sum(least(coalesce(n, 0), 20)) AS returned FROM f LEFT JOIN (SELECT query_id, name, count(*) AS n FROM c GROUP BY 1, 2) USING (query_id, name) GROUP BY 1)", ("edges", "ways"))
def g10_names(spark: SparkSession, sf: str) -> DataFrame:
    front, nodes, edges, seen, told, aliases = _asked(spark, sf)
    return explore.expand_names(front, nodes, edges, seen, told, 20, aliases)[2].select("query_id", "status", "exhausted", F.size("missing").cast("long").alias("missing"), "available_count", "returned_count")


@query("g10_candidates", f"WITH {_FRONT} SELECT query_id, name, r AS rank, other AS neighbour, 'part' AS entity_type FROM c WHERE r <= 20", ("edges", "ways"))
def g10_candidates(spark: SparkSession, sf: str) -> DataFrame:
    front, nodes, edges, seen, told, aliases = _asked(spark, sf)
    return explore.expand_names(front, nodes, edges, seen, told, 20, aliases)[1].select("query_id", "name", "rank", "neighbour", "entity_type")


def _owners(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each customer asks for its nation as an entity, unknown if its key is a multiple of 7, and for a relation of its nation with
    the next number, which is there from even to odd ones."""
    c = read(spark, sf, "customer")
    name = lambda k: F.concat(F.lit("nation "), k.cast("string"))
    far = F.when(F.col("c_custkey") % 7 == 0, F.lit("nowhere")).otherwise(F.upper(name(F.col("c_nationkey"))))
    entities = c.select(F.col("c_custkey").alias("query_id"), far.alias("name"))
    relations = c.select(F.col("c_custkey").alias("query_id"), name(F.col("c_nationkey") + 1).alias("src"), name(F.col("c_nationkey")).alias("tgt"))
    nation = read(spark, sf, "nation")
    nodes = nation.select(name(F.col("n_nationkey")).alias("node"), F.lit("nation").alias("entity_type"), F.col("n_name").alias("description"))
    edges = nation.filter("n_nationkey % 2 = 0 and n_nationkey < 24").select(name(F.col("n_nationkey")).alias("a"), name(F.col("n_nationkey") + 1).alias("b"), F.lit("next").alias("keywords"), F.lit("beside").alias("description"))
    return explore.asked_owners(entities, relations, nodes, edges), nodes, edges


@query("g11_names", "SELECT c_custkey AS query_id, 'entity' AS kind, CASE WHEN c_custkey % 7 > 0 THEN 'nation ' || c_nationkey END AS a, CASE WHEN c_custkey % 7 > 0 THEN n_name END AS description, CASE WHEN c_custkey % 7 = 0 THEN 'nowhere' END AS missing FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey, 'relation', CASE WHEN c_nationkey % 2 = 0 AND c_nationkey < 24 THEN least('nation ' || c_nationkey, 'nation ' || c_nationkey + 1) END, CASE WHEN c_nationkey % 2 = 0 AND c_nationkey < 24 THEN 'next beside' END, CASE WHEN NOT (c_nationkey % 2 = 0 AND c_nationkey < 24) THEN least('nation ' || c_nationkey, 'nation ' || c_nationkey + 1) || ' | ' || greatest('nation ' || c_nationkey, 'nation ' || c_nationkey + 1) END FROM customer")
def g11_names(spark: SparkSession, sf: str) -> DataFrame:
    found, missing = explore.describe_names(*_owners(spark, sf))
    none = F.lit(None).cast("string")
    found = found.select("query_id", "kind", "a", F.concat_ws(" ", "keywords", "description").alias("description"), none.alias("missing"))
    return found.unionByName(missing.select("query_id", "kind", none.alias("a"), none.alias("description"), F.col("asked").alias("missing")))


@query(
    "g12_names",
    """WITH e AS (
  SELECT source_atom_id AS atom_id, relation_type || ':outgoing:' || target_atom_id AS x, target_atom_id AS other FROM evolution
  UNION ALL SELECT target_atom_id, relation_type || ':incoming:' || source_atom_id, source_atom_id FROM evolution)
SELECT a.owner_id % 50 AS query_id, a.owner_id, a.atom_id, a.status, (SELECT string_agg(evidence_id::VARCHAR, ',' ORDER BY evidence_id) FROM evidence v WHERE v.atom_id = a.atom_id) AS evidence,
  (SELECT string_agg(x || ':' || s.status, ',' ORDER BY x) FROM e JOIN status s ON s.atom_id = e.other WHERE e.atom_id = a.atom_id) AS evolutions
FROM status a""",
    ("evidence", "evolution", "status"),
)
def g12_names(spark: SparkSession, sf: str) -> DataFrame:
    a = v.atoms(spark, sf)
    node = _named("user ", F.col("owner_id"))
    nodes = a.select(node.alias("node"), F.lit("user").alias("entity_type")).distinct()
    asked = a.select((F.col("owner_id") % 50).alias("query_id"), F.upper(node).alias("name")).distinct()
    none = spark.createDataFrame([], "query_id long, src string, tgt string")
    owners = explore.asked_owners(asked, none, nodes, spark.createDataFrame([], "a string, b string"))
    ids = a.select(node.alias("a"), F.lit(None).cast("string").alias("b"), "owner_id").distinct()
    out = explore.evidence_of_names(owners, ids, a, v.evidence(spark, sf), v.evolution(spark, sf), at())[0]
    named = lambda x: F.concat_ws(":", x["relation_type"], x["direction"], x["related_id"].cast("string"), x["related_status"])
    # as text the ids sort as text does
    return out.select("query_id", "owner_id", "atom_id", "status", F.array_join(F.transform("evidence", lambda x: x["evidence_id"].cast("string")), ",").alias("evidence"), F.array_join(F.array_sort(F.transform("evolutions", named)), ",").alias("evolutions"))


@query("g13_findings", "SELECT 'name' AS kind, query_id, nm AS item, min(o) AS o FROM (SELECT l_suppkey AS query_id, 'part ' || l_partkey % 9 AS nm, (l_linenumber * 100000000 + l_orderkey)::BIGINT AS o FROM lineitem) GROUP BY ALL UNION ALL SELECT 'pair', query_id, least(x, y) || '-' || greatest(x, y), min(o) FROM (SELECT l_suppkey AS query_id, 'n' || l_partkey % 4 AS x, 'n' || l_orderkey % 4 AS y, (l_linenumber * 100000000 + l_orderkey)::BIGINT AS o FROM lineitem) WHERE x <> y GROUP BY ALL")
def g13(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_linenumber").alias("explorer"), F.col("l_orderkey").alias("seq"), "l_partkey", "l_orderkey")
    found = li.withColumn("name", F.concat(F.when(F.col("seq") % 2 == 0, F.lit(" PART ")).otherwise("part "), (F.col("l_partkey") % 9).cast("string")))
    pairs = li.select("query_id", "explorer", "seq", _named("N", F.col("l_partkey") % 4).alias("src"), _named("n", F.col("l_orderkey") % 4).alias("tgt"))
    one, two = graph.merge_findings(found, pairs)
    o = (F.col("explorer") * 100000000 + F.col("seq")).cast("long").alias("o")
    return one.select(F.lit("name").alias("kind"), "query_id", F.lower(F.trim("name")).alias("item"), o).unionByName(two.select(F.lit("pair").alias("kind"), "query_id", F.concat_ws("-", "a", "b").alias("item"), o))
