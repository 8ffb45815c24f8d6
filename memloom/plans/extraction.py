"""Queries of ingestion, chunks and extraction rows (S, C, X) over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import text
from memloom.operators import chunk, ingest, merge
from memloom.plans import views as v
from memloom.plans.registry import query
from memloom.sources.tables import read

#: A chunk's id, a part's and a supplier's name, as SQL and as Columns.
_ROW = "l_orderkey * 10 + l_linenumber"


def _row() -> Column:
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _kind(n: int) -> Column:
    return F.pmod(_row(), F.lit(n))


@query(
    "s06_import_edges",
    """
WITH k AS (SELECT *, CASE WHEN source_id::BIGINT % 2 = 0 THEN 'chunk-' || source_id ELSE 'UNKNOWN' END AS source FROM extractions),
x AS (SELECT src AS a, tgt AS b, arg_max(source, seq) AS source, arg_max(description, seq) AS description FROM k GROUP BY 1, 2)
SELECT 'edge' AS kind, a, b, source, description FROM x
UNION ALL SELECT 'node', src, 'part', arg_max(source, seq), arg_max(description, seq) FROM k GROUP BY src
UNION ALL SELECT 'node', b, 'UNKNOWN', arg_min(source, a), arg_min(description, a) FROM x GROUP BY b""",
    ("extractions",),
)
def s06(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of odd orders are unknown, and relations' targets are declared nowhere."""
    x = v.extractions(spark, sf)
    ents = x.select(F.col("src").alias("name"), F.lit("part").alias("type"), "description", "source_id", "seq")
    chunks = x.filter(F.col("source_id").cast("long") % 2 == 0).select("source_id", F.concat(F.lit("chunk-"), "source_id").alias("chunk_id")).distinct()
    nodes, edges = ingest.import_custom_kg(chunks, ents, x.select("src", "tgt", "description", "weight", "source_id", "seq"))
    out = edges.select(F.lit("edge").alias("kind"), "a", "b", F.col("source_id").alias("source"), "description")
    return out.unionByName(nodes.select(F.lit("node").alias("kind"), F.col("name").alias("a"), F.col("type").alias("b"), F.col("source_id").alias("source"), "description"))


@query("s07_import_chunks", "SELECT conv_id::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS chunk_order_index, 'chunk-' || md5(conv_id || chr(31) || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || chr(31) || text) AS chunk_id FROM conversations WHERE trim(text) <> ''")
def s07(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations").filter(F.trim("text") != "").groupBy(_text("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"))
    return ingest.import_chunks(rows.select("doc_id", F.transform("c", lambda x: x["text"]).alias("chunks"))).select("doc_id", "chunk_order_index", "chunk_id")


@query(
    "s08_import_extracted",
    """
WITH e AS (SELECT l_orderkey AS episode_id, l_linenumber AS pos, 'Part ' || (l_partkey % 7) AS name FROM lineitem),
r AS (SELECT l_orderkey AS episode_id, 'Part ' || (l_partkey % 7) AS source, 'Part ' || (l_suppkey % 9) AS target FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY episode_id, name ORDER BY pos) AS k FROM e)
SELECT episode_id, 'duplicate entity' AS what, name AS item, count(*) AS n FROM n WHERE k > 1 GROUP BY ALL
UNION ALL SELECT episode_id, 'self-relation', source, count(*) FROM r WHERE source = target GROUP BY ALL
UNION ALL SELECT episode_id, 'entity', name, 1 FROM (SELECT DISTINCT episode_id, name FROM e UNION SELECT episode_id, target FROM r WHERE source <> target)
UNION ALL SELECT episode_id, 'relation', source || '>' || target, count(*) FROM r WHERE source <> target GROUP BY ALL""",
)
def s08(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    part = F.concat(F.lit("Part "), (F.col("l_partkey") % 7).cast("string"))
    other = F.concat(F.lit("Part "), (F.col("l_suppkey") % 9).cast("string"))
    listed = lambda c, shape: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", c.alias("x")))), shape)
    ents = listed(part, lambda x: F.struct(x["x"].alias("name"), F.array().cast("array<string>").alias("aliases")))
    rels = listed(F.struct(part.alias("s"), other.alias("t")), lambda x: F.struct(x["x"]["s"].alias("source"), x["x"]["t"].alias("target"), F.array().cast("array<string>").alias("keywords")))
    payload = li.groupBy(F.col("l_orderkey").alias("episode_id")).agg(ents.alias("entities"), rels.alias("relations"))
    entities, relations, errors = ingest.import_extracted(payload)
    out = errors.groupBy("episode_id", F.col("reason").alias("what"), "item").agg(F.count("*").alias("n"))
    out = out.unionByName(entities.select("episode_id", F.lit("entity").alias("what"), F.col("name").alias("item"), F.lit(1).cast("long").alias("n")))
    return out.unionByName(relations.groupBy("episode_id", F.lit("relation").alias("what"), F.concat_ws(">", "source", "target").alias("item")).agg(F.count("*").alias("n")))


@query(
    "x01_parse_extractions",
    f"""
SELECT {_ROW} AS chunk_id, 'entity' AS kind, 'Part ' || l_partkey AS a, 'part' AS b, 'about ' || l_returnflag AS c FROM lineitem WHERE ({_ROW}) % 8 < 4
UNION ALL SELECT {_ROW}, 'relation', 'Part ' || l_partkey, 'Supplier ' || l_suppkey, 'sold by ' || l_linestatus FROM lineitem WHERE ({_ROW}) % 8 = 4
UNION ALL SELECT {_ROW}, 'error', 'fields', NULL, NULL FROM lineitem WHERE ({_ROW}) % 8 = 5
UNION ALL SELECT {_ROW}, 'error', 'entity', NULL, NULL FROM lineitem WHERE ({_ROW}) % 8 = 6
UNION ALL SELECT {_ROW}, 'error', 'relation', NULL, NULL FROM lineitem WHERE ({_ROW}) % 8 = 7""",
)
def x01(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    part, sup = F.concat(F.lit("Part "), _text("l_partkey")), F.concat(F.lit("Supplier "), _text("l_suppkey"))
    about, sold = F.concat(F.lit("about "), "l_returnflag"), F.concat(F.lit("sold by "), "l_linestatus")
    m, line = _kind(8), None
    for k, mark in enumerate(("<|#|>", "<|##|>", "<#|>", "<|>")):  # whole, and damaged in three ways
        made = F.concat_ws(mark, F.lit("entity"), part, F.lit("Part"), about)
        line = F.when(m == k, made) if line is None else line.when(m == k, made)
    join = lambda *c: F.concat_ws("<|#|>", *c)
    line = line.when(m == 4, join(F.lit("relation"), part, sup, F.lit("trade"), sold)).when(m == 5, join(F.lit("entity"), part)).when(m == 6, join(F.lit("entity"), part, F.lit("pa/rt"), about)).otherwise(join(F.lit("relation"), part, part, F.lit("self"), sold))
    out = merge.extraction_records(li.select(_row().alias("chunk_id"), F.concat(line, F.lit("<|COMPLETE|>")).alias("result")))
    b = F.when(F.col("kind") == "entity", F.col("type")).when(F.col("kind") == "relation", F.col("b"))
    good = F.col("kind") != "error"
    return out.select("chunk_id", "kind", F.when(good, F.col("a")).otherwise(F.col("reason")).alias("a"), b.alias("b"), F.when(good, F.col("description")).alias("c"))


@query(
    "x02_parse_json",
    f"""
SELECT {_ROW} AS chunk_id, 'entity' AS kind, 'Part ' || l_partkey AS a, 'about ' || l_returnflag AS b FROM lineitem WHERE ({_ROW}) % 5 <> 4
UNION ALL SELECT {_ROW}, 'relation', 'Part ' || l_partkey, 'Supplier ' || l_suppkey FROM lineitem WHERE ({_ROW}) % 5 IN (0, 1, 2)
UNION ALL SELECT {_ROW}, 'error', 'json', NULL FROM lineitem WHERE ({_ROW}) % 5 = 4""",
)
def x02(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    ent = F.concat(F.lit('{"entities": [{"name": "Part '), _text("l_partkey"), F.lit('", "type": "part", "description": "about '), "l_returnflag", F.lit('"}]'))
    rel = F.concat(F.lit(', "relations": [{"source": "Part '), _text("l_partkey"), F.lit('", "target": "Supplier '), _text("l_suppkey"), F.lit('", "keywords": "k", "description": "d"}]}'))
    m, whole = _kind(5), F.concat(ent, rel)
    # plain, fenced, inside prose, cut off in the middle of its relations, and no JSON at all
    result = F.when(m == 0, whole).when(m == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(m == 2, F.concat(F.lit("Here it is: "), whole, F.lit(" as asked."))).when(m == 3, F.concat(ent, F.lit(', "relations": [{"source": "Pa'))).otherwise("none found")
    out = merge.json_records(li.select(_row().alias("chunk_id"), result.alias("result")))
    b = F.when(F.col("kind") == "entity", F.col("description")).when(F.col("kind") == "relation", F.col("b"))
    return out.select("chunk_id", "kind", F.when(F.col("kind") == "error", F.col("reason")).otherwise(F.col("a")).alias("a"), b.alias("b"))


@query("x03_repair_delimiters", f"SELECT {_ROW} AS id, CASE WHEN ({_ROW}) % 17 < 13 THEN 'entity<|#|>Part ' || l_partkey ELSE 'a <|> b' || l_partkey END AS fixed FROM lineitem")
def x03(spark: SparkSession, sf: str) -> DataFrame:
    damaged = ("<|#|>", "<|##|>", "<|#||#|>", "<|>", "<||>", "<X|#|>", "<|#|Y>", "<||#||>", "<#>", "<#|>", "<|#>", "<X#|>", "||#||")
    m, part = _kind(17), _text("l_partkey")
    mark = F.element_at(F.array(*map(F.lit, damaged)), (m + 1).cast("int"))
    raw = F.when(m < 13, F.concat(F.lit("entity"), F.when(m < 13, mark), F.lit("Part "), part)).otherwise(F.concat(F.lit("a <|> b"), part))
    return read(spark, sf, "lineitem").select(_row().alias("id"), text.repair_delimiters(raw).alias("fixed"))


@query("x04_normalize", f"SELECT {_ROW} AS id, CASE ({_ROW}) % 6 WHEN 0 THEN 'Part ' || l_partkey WHEN 1 THEN 'Part(' || l_partkey || ')' WHEN 2 THEN '中文' || l_partkey WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'say \"' || l_partkey || '\" or \"no\"' END AS name FROM lineitem")
def x04(spark: SparkSession, sf: str) -> DataFrame:
    m, part = _kind(6), _text("l_partkey")
    raw = F.when(m == 0, F.concat(F.lit('"Ｐart '), part, F.lit('"<br>'))).when(m == 1, F.concat(F.lit("<p>Part（"), part, F.lit("）</p>"))).when(m == 2, F.concat(F.lit(" 中 文  "), part)).when(m == 3, F.lit("12")).when(m == 4, F.lit("1.25")).otherwise(F.concat(F.lit('say "'), part, F.lit('" or "no"')))
    return read(spark, sf, "lineitem").select(_row().alias("id"), text.normalize_extracted(raw).alias("name"))


@query("x05_sanitize", f"SELECT {_ROW} AS id, 'a<' || l_partkey || chr(9) || '&' AS clean FROM lineitem")
def x05(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(_row().alias("id"), text.sanitize(F.concat(F.lit(" \u0001a&lt;"), _text("l_partkey"), F.lit("\u0007\t&amp;\n"))).alias("clean"))


@query("x06_clean_type", f"SELECT {_ROW} AS id, CASE ({_ROW}) % 3 WHEN 0 THEN 'modelpart' WHEN 1 THEN NULL ELSE lower(l_returnflag) END AS type FROM lineitem")
def x06(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(_kind(3) == 0, " , Model Part,x").when(_kind(3) == 1, "a, b|c").otherwise(F.col("l_returnflag"))
    return read(spark, sf, "lineitem").select(_row().alias("id"), text.clean_type(raw).alias("type"))


@query("x07_truncate_identifier", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN left(text, 40) ELSE repeat('é', 30) END AS name FROM documents WHERE doc_id % 2 = 1 OR strlen(left(text, 40)) <= 60")
def x07(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").filter((F.col("doc_id") % 2 == 1) | (F.octet_length(F.substring("text", 1, 40)) <= 60))
    raw = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.repeat(F.lit("é"), F.lit(50)))
    return d.select("doc_id", text.truncate_identifier(raw, 40, 60).alias("name"))


@query("x08_merge_passes", "SELECT l_orderkey AS chunk_id, l_partkey AS name, CASE WHEN max(l_linenumber) FILTER (l_linenumber > 3) > coalesce(max(l_linenumber) FILTER (l_linenumber <= 3), 0) THEN 2 ELSE 1 END AS pass FROM lineitem GROUP BY 1, 2")
def x08(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    per = lambda df, no: df.groupBy(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("name")).agg(F.max("l_linenumber").alias("n")).select("chunk_id", "name", F.lit(no).alias("pass"), F.expr("repeat('x', n)").alias("description"))
    return merge.merge_passes(per(li.filter("l_linenumber <= 3"), 1), per(li.filter("l_linenumber > 3"), 2), ["chunk_id", "name"]).select("chunk_id", "name", "pass")


@query("x09_parse_keywords", "SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE o_orderpriority || '|open' END AS high, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE o_orderstatus END AS low FROM orders")
def x09(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit('{"high_level_keywords": ["'), "o_orderpriority", F.lit('", " open ", ""], "low_level_keywords": ["'), "o_orderstatus", F.lit('"]}'))
    m = F.col("o_orderkey") % 3
    result = F.when(m == 0, body).when(m == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise("nothing")
    out = merge.parse_keywords(read(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), result.alias("result")))
    return out.select("query_id", F.array_join("high", "|").alias("high"), F.array_join("low", "|").alias("low"))


@query("x12_missing_endpoints", "SELECT DISTINCT name FROM (SELECT a AS name FROM edges UNION ALL SELECT b FROM edges) WHERE name NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_partkey % 3 = 0)", ("edges",))
def x12(spark: SparkSession, sf: str) -> DataFrame:
    nodes = read(spark, sf, "part").filter("p_partkey % 3 = 0").select(F.concat(F.lit("p"), _text("p_partkey")).alias("name"))
    return merge.missing_endpoints(v.edges(spark, sf), nodes)


_CAPPED = "SELECT owner, source_id, row_number() OVER (PARTITION BY owner ORDER BY s, source_id) AS n, row_number() OVER (PARTITION BY owner ORDER BY s DESC, source_id) AS m FROM (SELECT tgt AS owner, source_id, min(seq) AS s FROM extractions GROUP BY 1, 2)"


@query("x13_cap_sources", f"SELECT e.tgt AS owner, count(*) AS fragments, count(DISTINCT c.source_id) AS sources FROM extractions e LEFT JOIN (SELECT owner, source_id FROM ({_CAPPED}) WHERE n <= 5) c ON c.owner = e.tgt AND c.source_id = e.source_id WHERE c.source_id IS NOT NULL OR seq % 2 = 0 GROUP BY 1", ("extractions",))
def x13(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.extractions(spark, sf).select(F.col("tgt").alias("owner"), "source_id", "seq", (F.col("seq") % 2 == 1).alias("is_new"))
    owners, kept = merge.cap_sources(rows, 5)
    return kept.groupBy("owner").agg(F.count("*").alias("fragments")).join(owners.select("owner", F.size("source_ids").cast("long").alias("sources")), "owner")


@query("x13_newest_sources", f"SELECT owner, string_agg(source_id, ',' ORDER BY m DESC) AS sources FROM ({_CAPPED}) WHERE m <= 5 GROUP BY 1", ("extractions",))
def x13b(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.extractions(spark, sf).select(F.col("tgt").alias("owner"), "source_id", "seq", F.lit(True).alias("is_new"))
    return merge.cap_sources(rows, 5, newest=True)[0].select("owner", F.array_join("source_ids", ",").alias("sources"))


@query(
    "x14_id_sets",
    """
WITH l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS a, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey AS id, (SELECT string_agg(x, ',' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(list_concat(a, b)) AS x, generate_subscripts(list_concat(a, b), 1) AS i) GROUP BY x)) AS merged,
  array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS rest FROM l""",
)
def x14(spark: SparkSession, sf: str) -> DataFrame:
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", c))), lambda x: x[c])
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(listed("l_partkey").alias("a"), listed("l_suppkey").alias("b"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("id", joined(text.merge_ids(F.col("a"), F.col("b"))).alias("merged"), joined(text.subtract_ids(F.col("a"), F.col("b"))).alias("rest"))


@query("x15_cap_paths", "SELECT l_suppkey AS owner, least(count(*), 21) AS n, CASE WHEN count(*) > 20 THEN '...truncated...(KEEP Old)' ELSE max_by('f' || l_orderkey, k) END AS last FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem WHERE l_orderkey < 3000) GROUP BY 1")
def x15(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem").filter("l_orderkey < 3000").groupBy(F.col("l_suppkey").alias("owner")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))), lambda x: F.concat(F.lit("f"), x["l_orderkey"].cast("string"))).alias("paths"))
    out = li.withColumn("p", text.cap_paths(F.col("paths"), 20))
    return out.select("owner", F.size("p").cast("long").alias("n"), F.element_at("p", -1).alias("last"))


@query("x17_touched", "SELECT 'name' AS kind, src AS a, NULL AS b FROM extractions UNION SELECT 'name', tgt, NULL FROM extractions UNION SELECT 'pair', least(src, tgt), greatest(src, tgt) FROM extractions", ("extractions",))
def x17(spark: SparkSession, sf: str) -> DataFrame:
    x = v.extractions(spark, sf)
    names, pairs = merge.touched(x.select(F.col("src").alias("name")), x)
    return names.select(F.lit("name").alias("kind"), F.col("name").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(pairs.select(F.lit("pair").alias("kind"), "a", "b"))


_TOK = "list_filter(regexp_split_to_array(p, '\\s+'), lambda x: x <> '')"


@query("c02_strict", f"SELECT doc_id, sum((n <= 12)::INT)::BIGINT AS chunks, sum((n > 12)::INT)::BIGINT AS errors FROM (SELECT doc_id, len({_TOK}) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) WHERE trim(p) <> '') WHERE n > 0 GROUP BY 1")
def c02(spark: SparkSession, sf: str) -> DataFrame:
    good, errors = chunk.chunk_by_delimiter(v.docs(spark, sf), "\n", 12, 0, only=True)
    both = good.select("doc_id", F.lit(1).alias("g"), F.lit(0).alias("e")).unionByName(errors.select("doc_id", F.lit(0).alias("g"), F.lit(1).alias("e")))
    return both.groupBy("doc_id").agg(F.sum("g").alias("chunks"), F.sum("e").alias("errors"))


@query("c08_attribute_blocks", "SELECT doc_id, k AS chunk_id, min(block) AS block_id, count(*) AS refs FROM (SELECT doc_id, k, k * 100 AS s, k * 100 + 100 AS e, total FROM (SELECT doc_id, length(text) AS total, unnest(range(0, least(length(text) // 100, 20) + 1)) AS k FROM documents)) c JOIN (SELECT doc_id, i - 1 AS block, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b0, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(l) AS b1 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) b USING (doc_id) WHERE s < b1 AND b0 < e GROUP BY 1, 2")
def c08(spark: SparkSession, sf: str) -> DataFrame:
    d = v.docs(spark, sf).select("doc_id", "text")
    blocks = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "content"))
    chunks = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.least(F.floor(F.length("text") / 100), F.lit(20)).cast("int"))).alias("chunk_id"))
    chunks = chunks.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), (F.col("chunk_id") * 100).alias("start"), (F.col("chunk_id") * 100 + 100).alias("end"))
    return chunk.attribute_blocks(chunks, blocks).select("doc_id", "chunk_id", F.col("block_id").cast("long").alias("block_id"), F.size("refs").cast("long").alias("refs"))


@query("c10_strip_markup", "SELECT doc_id, 'see ' || left(text, 20) || ' end' AS clean FROM documents WHERE left(text, 20) NOT LIKE '%<%'")
def c10(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").filter(~F.contains(F.substring("text", 1, 20), F.lit("<")))
    raw = F.concat(F.lit('<drawing id="d1"/>see <cite refid="c2">'), F.substring("text", 1, 20), F.lit("</cite> end"))
    return d.select("doc_id", text.strip_markup(raw).alias("clean"))


@query("c05_chunk_blocks")
def c05(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as heading blocks, split, glued and merged; tests/core/test_brute.py has the cases."""
    marks = F.regexp_replace(F.regexp_replace("html", r"(?i)<h([1-6])[^>]*>", "\n## "), r"(?i)<(?!/?(table|tr|th|td)\b)[^>]+>", "\n")
    pages = read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), marks.alias("text"))
    return chunk.chunk_blocks(chunk.to_blocks(pages), 120, drop_references=True)


_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"


@query("c06_split_tables", "SELECT l_orderkey AS doc_id, sum(n)::BIGINT AS n_rows, max(parts) AS parts FROM (SELECT l_orderkey, count(*) AS n, ceil(count(*) / ceil(count(*) / greatest(ceil((1 + count(*) * 4) / 9.0), 1)))::BIGINT AS parts FROM lineitem GROUP BY 1) GROUP BY 1")
def c06(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of one header and a row for each line of an order, four words each, split above nine words."""
    cell = F.concat(F.lit("<tr><td>"), F.concat_ws(" ", "l_partkey", "l_suppkey", "l_returnflag"), F.lit(" x</td></tr>"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", cell.alias("c")))), lambda x: x["c"])
    made = F.concat(F.lit("<table><tr><th>order</th></tr> "), F.array_join(rows, " "), F.lit("</table>"))
    blocks = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(made.alias("content"))
    out = chunk.split_tables(blocks, 9).withColumn("n", F.size(F.regexp_extract_all("content", F.lit("<td>"), F.lit(0))))
    return out.groupBy("doc_id").agg(F.sum("n").cast("long").alias("n_rows"), F.count("*").alias("parts"))


@query("c11_surrounding", f"SELECT doc_id, doc_id AS item_id, array_to_string(t[greatest(len(t) // 2 - 9, 1):len(t) // 2], ' ') AS leading, array_to_string(t[len(t) // 2 + 1:len(t) // 2 + 5], ' ') AS trailing FROM (SELECT doc_id, {_WORDS} AS t FROM documents WHERE NOT contains(text, '<') AND NOT contains(text, '>')) WHERE len(t) >= 2")
def c11(spark: SparkSession, sf: str) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    d = read(spark, sf, "documents").filter(~F.contains("text", F.lit("<")) & ~F.contains("text", F.lit(">"))).select("doc_id", words.alias("w")).filter(F.size("w") >= 2)
    half = F.floor(F.size("w") / 2).cast("int")
    content = F.concat(F.array_join(F.slice("w", F.lit(1), half), " "), F.lit(" <item/> "), F.array_join(F.slice("w", half + 1, F.size("w")), " "))
    blocks = d.select("doc_id", F.lit(0).alias("block"), content.alias("content"))
    items = d.select("doc_id", F.lit(0).alias("block"), F.col("doc_id").alias("item_id"), F.lit("<item/>").alias("mark"))
    return chunk.surrounding(items, blocks, 10, 5)
