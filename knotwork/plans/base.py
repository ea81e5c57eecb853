"""Registry of named queries, each beside the SQL that another engine checks it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The graph views of ``sources.views`` in SQL.
_VIEWS = {
    "entities": """entities AS (
SELECT k + kind * 10000000000 AS id, name, entity_type, aliases, description,
  TIMESTAMP '2024-01-01' + to_days(CAST(k % 300 AS INT)) AS created_at,
  TIMESTAMP '2024-01-01' + to_days(CAST(k % 300 AS INT)) + to_days(CAST(k % 37 AS INT)) AS updated_at
FROM (SELECT r_regionkey::BIGINT AS k, 1 AS kind, r_name AS name, 'Project' AS entity_type, NULL::VARCHAR AS aliases, NULL::VARCHAR AS description FROM region
UNION ALL SELECT n_nationkey, 2, n_name, 'Framework', NULL, NULL FROM nation
UNION ALL SELECT c_custkey, 3, c_name, 'User', c_mktsegment, NULL FROM customer
UNION ALL SELECT s_suppkey, 4, s_name, 'Service', NULL, NULL FROM supplier
UNION ALL SELECT p_partkey, 5, p_name || ' #' || p_partkey, 'Component', p_brand || ',' || p_type, 'size ' || p_size FROM part
UNION ALL SELECT o_orderkey, 6, 'Order#' || o_orderkey, 'Task', o_orderpriority, NULL FROM orders
UNION ALL SELECT item_id, 7, 'Benchmark#' || item_id, 'Issue', NULL, NULL FROM benchmark))""",
    "relations": """relations AS (
SELECT n_nationkey::BIGINT + 1000000000000 AS id, n_nationkey::BIGINT + 20000000000 AS from_entity_id, n_regionkey::BIGINT + 10000000000 AS to_entity_id, 'part_of' AS relation_type FROM nation
UNION ALL SELECT c_custkey + 2000000000000, c_custkey + 30000000000, c_nationkey + 20000000000, 'part_of' FROM customer
UNION ALL SELECT s_suppkey + 3000000000000, s_suppkey + 40000000000, s_nationkey + 20000000000, 'part_of' FROM supplier
UNION ALL SELECT o_orderkey + 4000000000000, o_orderkey + 60000000000, o_custkey + 30000000000, 'part_of' FROM orders
UNION ALL SELECT DISTINCT l_orderkey * 100000 + l_partkey + 5000000000000, l_orderkey + 60000000000, l_partkey + 50000000000, 'depends_on' FROM lineitem
UNION ALL SELECT DISTINCT l_partkey * 100000 + l_suppkey + 6000000000000, l_partkey + 50000000000, l_suppkey + 40000000000, 'relates_to' FROM lineitem WHERE l_returnflag = 'N'
UNION ALL SELECT DISTINCT l_partkey * 100000 + l_suppkey + 7000000000000, l_suppkey + 40000000000, l_partkey + 50000000000, 'relates_to' FROM lineitem WHERE l_returnflag = 'R')""",
    "raw_relations": """raw_relations AS (
SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber + 8000000000000 AS id, l_orderkey + 60000000000 AS from_entity_id, l_partkey + 50000000000 AS to_entity_id, 'depends_on' AS relation_type FROM lineitem
UNION ALL SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber + 9000000000000, l_partkey + 50000000000, l_suppkey + 40000000000, 'part_of' FROM lineitem)""",
    "observations": """observations AS (
SELECT *, CASE WHEN status <> 'active' OR id % 97 = 0 THEN TIMESTAMP '2024-03-01' END AS obsoleted_at,
  CASE WHEN status = 'superseded' AND id % 3 <> 0 THEN CASE WHEN id % 2 = 0 THEN id + 200 ELSE id + 1 END END AS superseded_by_id
FROM (SELECT doc_id AS id, doc_id % 200 + 50000000000 AS memory_entity_id, text AS content, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 10) / 10.0::DOUBLE END AS confidence,
  CASE WHEN doc_id % 4 = 0 THEN 'official docs' WHEN doc_id % 4 = 1 THEN 'hearsay' ELSE source END AS source,
  CASE WHEN doc_id % 11 = 0 THEN 'obsolete' WHEN doc_id % 13 = 0 THEN 'superseded' ELSE 'active' END AS status,
  CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2025-01-01' END AS valid_from, CASE WHEN doc_id % 19 = 0 THEN TIMESTAMP '2023-01-01' END AS valid_until,
  TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 300 AS INT)) AS created_at, lang AS tag, embedding
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id))""",
    "degree": "degree AS (SELECT id, count(*) AS degree FROM (SELECT from_entity_id AS id FROM relations UNION ALL SELECT to_entity_id FROM relations) GROUP BY id)",
    "audit": """audit AS (SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS action,
  CASE event_id % 3 WHEN 0 THEN 'MemoryEntity' WHEN 1 THEN 'MemoryObservation' ELSE 'MemoryRelation' END AS auditable_type, user_id AS actor, value, props AS changed_fields, ts AS created_at FROM events)""",
}


def views(*names: str, then: str = "", recursive: bool = False) -> str:
    parts = [_VIEWS[n] for n in names]
    return "WITH " + ("RECURSIVE " if recursive else "") + ", ".join([*parts, *([then] if then else [])]) + " "


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return put
