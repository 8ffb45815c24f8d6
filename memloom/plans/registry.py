"""Registered queries, and the SQL equals of the views that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SQL equals of views.
SQL_VIEWS = {
    "docs": "SELECT doc_id, source || '/' || (doc_id % 140) AS file_path, text AS content, text, doc_id AS seq FROM documents",
    "edges": "SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b, count(*)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2",
    "extractions": "SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS tgt, 1.0::DOUBLE AS weight, l_returnflag AS keyword, l_orderkey::VARCHAR AS source_id, (l_orderkey * 10 + l_linenumber)::BIGINT AS seq, l_returnflag || l_linestatus AS description FROM lineitem",
    "atoms": "SELECT event_id AS atom_id, user_id AS owner_id, event_type || ':' || floor(value / 10)::BIGINT AS content, ts AS valid_at, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS invalid_at, ts + INTERVAL 1 HOUR AS created_at, CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 2 HOUR END AS expired_at, event_id AS seq, event_id // 100 AS episode_id FROM events",
    "evidence": "SELECT event_id AS atom_id, (event_id + k) % 50 AS episode_id, event_id * 10 + k AS evidence_id FROM events, LATERAL (SELECT unnest(range(0, event_id % 3 + 1)) AS k)",
    "evolution": "SELECT event_id AS source_atom_id, event_id - 1 AS target_atom_id, CASE WHEN event_id % 2 = 0 THEN 'CONTRADICTION' ELSE 'REFINEMENT' END AS relation_type, event_id % 4 = 0 AS resolved FROM events WHERE event_id % 11 = 0 AND event_id > 0",
    "vectors": "SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, 'src' || (vec_id % 7) AS file_path, vec_id % 50 + 1 AS tokens FROM embeddings",
    "queries": "SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0",
    "names": "SELECT 'part-' || p_partkey AS entity_id, p_name AS alias FROM part UNION ALL SELECT 'sup-' || s_suppkey, s_name FROM supplier",
    "pools": "SELECT c.query_id, c.owner, c.place, row_number() OVER (PARTITION BY c.query_id, c.owner ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS chunk_id FROM (SELECT c_nationkey::BIGINT AS query_id, c_custkey AS owner, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place FROM customer) c JOIN orders ON o_custkey = c.owner",
    "deg": "SELECT node, count(*) AS degree FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY 1",
    "ways": "SELECT a AS node, b AS other, weight FROM edges UNION ALL SELECT b, a, weight FROM edges",
    "hits": "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, list_dot_product(qv, v) / sqrt(list_dot_product(qv, qv) * list_dot_product(v, v)) AS score FROM queries, vectors) WHERE score >= 0.2",
    "status": "SELECT *, CASE WHEN expired_at IS NOT NULL THEN 'expired' WHEN TIMESTAMP '2024-01-15' < valid_at THEN 'pending' WHEN TIMESTAMP '2024-01-15' >= invalid_at THEN 'invalid' ELSE 'active' END AS status FROM atoms",
}
#: What views read from others.
NEEDS = {"deg": ("edges",), "ways": ("edges",), "hits": ("queries", "vectors"), "status": ("atoms",)}

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def at() -> Column:
    return F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")).cast("timestamp")


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()) -> Callable:
    """Register a query; its SQL gets the views that it uses as common table expressions."""

    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            order: list[str] = []
            for u in uses:
                order += [x for x in (*NEEDS.get(u, ()), u) if x not in order]
            views, body = ", ".join(f"{x} AS ({SQL_VIEWS[x]})" for x in order), sql.strip()
            own = body.startswith("WITH ")  # a query's own tables follow the views
            ORACLE_SQL[name] = f"WITH {views}{', ' + body[5:] if own else ' ' + body}" if order else body
        return f

    return put
