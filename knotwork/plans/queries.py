"""Named queries over the graph views: scans, joins, aggregates, windows, search, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.functions import types as Y
from knotwork.functions import vectors as V
from knotwork.operators import graph as G
from knotwork.operators import quality as Q
from knotwork.operators import ranking as R
from knotwork.operators import scan, search, stats
from knotwork.plans.base import query, views
from knotwork.sources import views as S
from knotwork.sources.exchange import appended, dot_lines

_E, _R, _O = views("entities"), views("relations"), views("observations")
_ER = views("entities", "relations")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0):
    """One stored vector as a literal: the query side of a search is a parameter."""
    row = S.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return V.literal(row.embedding)


@query("graph_totals", views("entities", "relations", "observations", "audit") + "SELECT 'entities' AS metric, count(*) AS n FROM entities UNION ALL SELECT 'observations', count(*) FROM observations UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'audit_logs', count(*) FROM audit")
def _(spark, d):
    return stats.totals(S.graph(spark, d), S.audit_logs(spark, d))


@query("entity_type_distribution", _E + "SELECT entity_type, count(*) AS n FROM entities GROUP BY 1")
def _(spark, d):
    return stats.type_distribution(S.entities(spark, d))


@query("most_connected", views("entities", "relations", "degree") + "SELECT id, degree, name, entity_type FROM degree JOIN entities USING (id) ORDER BY degree DESC, id LIMIT 10")
def _(spark, d):
    return stats.most_connected(S.entities(spark, d), S.relations(spark, d))


@query("node_degrees", views("relations", "degree") + "SELECT id, degree FROM degree")
def _(spark, d):
    return search.degree(S.relations(spark, d))


@query("recently_updated", _E + "SELECT id, name, updated_at FROM entities ORDER BY updated_at DESC, id LIMIT 10")
def _(spark, d):
    return stats.recently_updated(S.entities(spark, d))


@query("entity_lookup", _E + "SELECT id, name, entity_type FROM entities WHERE id = 50000000007")
def _(spark, d):
    return S.entity(spark, d, 50_000_000_007).select("id", "name", "entity_type")


@query("list_entities_page", _E + "SELECT id, name, entity_type FROM entities ORDER BY id LIMIT 20 OFFSET 40")
def _(spark, d):
    return scan.paged(S.entities(spark, d), page=3).select("id", "name", "entity_type")


@query("list_entities_totals", _E + "SELECT count(*) AS total, CAST(greatest(ceil(count(*) / 20.0), 1) AS BIGINT) AS total_pages FROM entities")
def _(spark, d):
    return scan.page_totals(S.entities(spark, d))


@query("sorted_page", _E + "SELECT id, name FROM entities WHERE entity_type = 'Component' ORDER BY name DESC, id LIMIT 50")
def _(spark, d):
    return scan.paged(S.entities(spark, d).where("entity_type = 'Component'"), per_page=50, sort_by="name", direction="desc").select("id", "name")


@query("filtered_entities", _E + "SELECT id, name FROM entities WHERE entity_type IN ('Component', 'Service') AND lower(coalesce(name, '')) LIKE '%1%' AND lower(coalesce(aliases, '')) LIKE '%brand%' AND created_at >= TIMESTAMP '2024-02-01' AND created_at <= TIMESTAMP '2024-06-01'")
def _(spark, d):
    return scan.entity_scan(S.entities(spark, d), ["Component", "Service"], "1", "brand", since="2024-02-01", until="2024-06-01").select("id", "name")


@query("or_filter_scan", _E + "SELECT id, name FROM entities WHERE entity_type = 'Project' OR lower(name) LIKE '%supplier%' OR id = 50000000003 OR lower(coalesce(aliases, '')) LIKE '%urgent%'")
def _(spark, d):
    return scan.entity_scan(S.entities(spark, d), any_of=[{"entity_type": "Project", "name": "supplier"}, {"id": 50_000_000_003}, {"aliases": "urgent"}]).select("id", "name")


@query("or_filter_empty", _E + "SELECT id FROM entities WHERE 1 = 2")
def _(spark, d):
    return scan.entity_scan(S.entities(spark, d), any_of=[]).select("id")


@query("observation_scan", _O + "SELECT id, memory_entity_id, status FROM observations WHERE memory_entity_id = 50000000005 AND created_at >= TIMESTAMP '2024-01-05' AND status = 'active'")
def _(spark, d):
    return scan.observation_scan(S.observations(spark, d), 50_000_000_005, since="2024-01-05").select("id", "memory_entity_id", "status")


@query("relation_scan", _ER + "SELECT r.id, a.name AS from_name, b.name AS to_name, relation_type FROM relations r LEFT JOIN entities a ON a.id = from_entity_id LEFT JOIN entities b ON b.id = to_entity_id WHERE relation_type = 'part_of' AND to_entity_id = 20000000003")
def _(spark, d):
    return scan.relation_scan(S.relations(spark, d), S.entities(spark, d), to_id=20_000_000_003, relation_type="child_of").select("id", "from_name", "to_name", "relation_type")


@query("negated_filter", _E + "SELECT id FROM entities WHERE entity_type <> 'Task' AND aliases <> 'BUILDING'")
def _(spark, d):
    return S.entities(spark, d).where((F.col("entity_type") != "Task") & (F.col("aliases") != "BUILDING")).select("id")


@query("picker", _E + "SELECT id, name FROM entities WHERE lower(coalesce(name, '')) LIKE '%gizmo%' OR lower(coalesce(aliases, '')) LIKE '%gizmo%' ORDER BY name, id LIMIT 20")
def _(spark, d):
    return scan.picker(S.entities(spark, d), "gizmo").select("id", "name")


@query("find_relations_typed", _R + "SELECT id, from_entity_id, to_entity_id FROM relations WHERE from_entity_id = 60000000010 AND relation_type = 'depends_on'")
def _(spark, d):
    return G.find_relations(S.relations(spark, d), from_id=60_000_000_010, relation_type=" Requires ").select("id", "from_entity_id", "to_entity_id")


_VARIANTS = "variants(variant, canonical) AS (VALUES " + ", ".join(f"('{v}', '{c}')" for v, c in Y.variants(Y.ENTITY_TYPES).items()) + ")"


@query("canonicalize_types", f"WITH {_VARIANTS}, raw AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN ' Bugs ' WHEN 1 THEN 'REPO' WHEN 2 THEN 'api_endpoint' WHEN 3 THEN event_type ELSE 'Fix' END AS raw FROM events) SELECT id, coalesce(canonical, raw) AS entity_type FROM raw LEFT JOIN variants ON lower(trim(raw)) = variant")
def _(spark, d):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, " Bugs ").when(k == 1, "REPO").when(k == 2, "api_endpoint").when(k == 3, F.col("event_type")).otherwise("Fix")
    return S.table(spark, d, "events").select(F.col("event_id").alias("id"), Y.canonical(raw, Y.ENTITY_TYPES).alias("entity_type"))


@query("canonicalize_by_table", "SELECT o_orderkey AS id, upper(trim(o_orderpriority)) AS kind FROM orders")
def _(spark, d):
    orders = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"))
    mapping = orders.select(F.lower(F.trim("kind")).alias("variant"), F.upper(F.trim("kind")).alias("canonical_type")).distinct()
    return Y.canonical_by_table(orders, "kind", mapping)


@query("induced_subgraph", _R + "SELECT id FROM relations WHERE from_entity_id % 7 = 0 AND to_entity_id % 7 = 0")
def _(spark, d):
    ids = S.entities(spark, d).select("id").where("id % 7 = 0")
    return G.induced_edges(S.relations(spark, d), ids).select("id")


@query("ego_network", _ER + ", n AS (SELECT to_entity_id AS id FROM relations WHERE from_entity_id = 50000000003 UNION SELECT from_entity_id FROM relations WHERE to_entity_id = 50000000003 UNION SELECT 50000000003) SELECT id, name, entity_type FROM n JOIN entities USING (id)")
def _(spark, d):
    return G.ego_network(S.relations(spark, d), 50_000_000_003).join(S.entities(spark, d).select("id", "name", "entity_type"), "id")


@query("scoped_graph", _R + "SELECT from_entity_id AS id FROM relations WHERE relation_type = 'part_of' AND to_entity_id = 10000000001 UNION SELECT 10000000001")
def _(spark, d):
    child = S.relations(spark, d).where("relation_type = 'part_of' AND to_entity_id = 10000000001").select(F.col("from_entity_id").alias("id"))
    return child.unionAll(spark.range(1).select(F.lit(10_000_000_001).cast("long").alias("id"))).distinct()


@query("root_only_graph", _E + "SELECT id, name FROM entities WHERE entity_type = 'Project' OR entity_type IS NULL")
def _(spark, d):
    return S.entities(spark, d).where("entity_type = 'Project' OR entity_type IS NULL").select("id", "name")


@query("entities_with_observations", _E[:-1] + ", " + _O[5:] + "SELECT e.id, count(o.id) AS n, string_agg(CAST(o.id AS VARCHAR), ',' ORDER BY o.id) AS ids FROM entities e JOIN observations o ON o.memory_entity_id = e.id AND o.status = 'active' GROUP BY e.id")
def _(spark, d):
    facts = S.observations(spark, d).where("status = 'active'").groupBy(F.col("memory_entity_id").alias("id")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))
    return S.entities(spark, d).select("id").join(facts, "id")


@query("name_resolution", _E + ", wanted(name) AS (VALUES ('Order#5'), ('Benchmark#3'), ('nobody')) SELECT name, coalesce(id, -1) AS id FROM wanted LEFT JOIN entities USING (name)")
def _(spark, d):
    wanted = spark.createDataFrame([("Order#5",), ("Benchmark#3",), ("nobody",)], "name string")
    return scan.resolve_names(wanted, S.entities(spark, d)).fillna(-1)


@query("page_child_counts", _ER + ", p AS (SELECT id FROM entities WHERE entity_type IN ('Framework', 'Project')) SELECT to_entity_id AS id, count(*) AS children FROM relations WHERE relation_type = 'part_of' AND to_entity_id IN (SELECT id FROM p) GROUP BY 1")
def _(spark, d):
    return stats.child_counts(S.relations(spark, d), S.entities(spark, d).where("entity_type IN ('Framework', 'Project')").select("id"))


@query("without_observations", views("entities", "observations") + "SELECT id FROM entities WHERE id NOT IN (SELECT memory_entity_id FROM observations)")
def _(spark, d):
    return S.entities(spark, d).join(S.observations(spark, d).select(F.col("memory_entity_id").alias("id")), "id", "left_anti").select("id")


@query("hier_orphans", _ER + "SELECT id, name FROM entities WHERE entity_type <> 'Project' AND id NOT IN (SELECT from_entity_id FROM relations WHERE relation_type = 'part_of')")
def _(spark, d):
    return G.hierarchy_orphans(S.entities(spark, d), S.relations(spark, d)).select("id", "name")


@query("gc_orphans", views("entities", "relations", "observations") + "SELECT id, name FROM entities WHERE id NOT IN (SELECT from_entity_id FROM relations) AND id NOT IN (SELECT to_entity_id FROM relations) AND id NOT IN (SELECT memory_entity_id FROM observations)")
def _(spark, d):
    g = S.graph(spark, d)
    return G.isolated(g.entities, g.observations, g.relations).select("id", "name")


@query("root_nodes", _ER + ", r AS (SELECT id, name, 0 AS part FROM entities WHERE entity_type = 'Project' UNION ALL SELECT id, name, 1 FROM entities WHERE entity_type <> 'Project' AND id NOT IN (SELECT from_entity_id FROM relations WHERE relation_type = 'part_of')) SELECT *, row_number() OVER (ORDER BY part, name, id) AS position FROM r")
def _(spark, d):
    return G.root_nodes(S.entities(spark, d), S.relations(spark, d))


@query("duplicate_observations", _O + "SELECT memory_entity_id, min(id) AS keep_id, count(*) AS n FROM observations WHERE status = 'active' GROUP BY memory_entity_id, content HAVING count(*) > 1")
def _(spark, d):
    rows = S.observations(spark, d)
    return Q.duplicate_observations(rows)


_ONE = ", folded AS (SELECT * REPLACE (50000000000 + id % 3 AS memory_entity_id) FROM observations) "


@query("duplicate_observations_few_subjects", _O + _ONE + "SELECT memory_entity_id, min(id) AS keep_id, count(*) AS n FROM folded WHERE status = 'active' GROUP BY memory_entity_id, content HAVING count(*) > 1")
def _(spark, d):
    return Q.duplicate_observations(S.observations(spark, d).withColumn("memory_entity_id", F.lit(5 * S.KIND) + F.col("id") % 3))


@query("redundant_observations", _O + _ONE + "SELECT id, memory_entity_id FROM (SELECT *, row_number() OVER (PARTITION BY memory_entity_id, content ORDER BY id) AS n FROM folded WHERE status = 'active') WHERE n > 1")
def _(spark, d):
    return Q.redundant_observations(S.observations(spark, d).withColumn("memory_entity_id", F.lit(5 * S.KIND) + F.col("id") % 3))


@query("redundant_observations_oldest", _O + _ONE + "SELECT id, memory_entity_id FROM (SELECT *, row_number() OVER (PARTITION BY memory_entity_id, content ORDER BY created_at, id) AS n FROM folded WHERE status = 'active') WHERE n > 1")
def _(spark, d):
    return Q.redundant_observations(S.observations(spark, d).withColumn("memory_entity_id", F.lit(5 * S.KIND) + F.col("id") % 3), oldest=True)


_RAW = views("raw_relations")


@query("duplicate_relations", _RAW + "SELECT from_entity_id, to_entity_id, relation_type, min(id) AS keep_id, array_to_string(list_sort(list(id))[2:], '-') AS delete_ids FROM raw_relations GROUP BY 1, 2, 3 HAVING count(*) > 1")
def _(spark, d):
    return Q.duplicate_relations(S.raw_relations(spark, d))


@query("reverse_pairs", _R + "SELECT least(up, down) AS keep_id, greatest(up, down) AS delete_id, relation_type FROM (SELECT relation_type, min(CASE WHEN from_entity_id < to_entity_id THEN id END) AS up, min(CASE WHEN from_entity_id > to_entity_id THEN id END) AS down FROM relations GROUP BY least(from_entity_id, to_entity_id), greatest(from_entity_id, to_entity_id), relation_type) WHERE up IS NOT NULL AND down IS NOT NULL")
def _(spark, d):
    return Q.reverse_pairs(S.relations(spark, d))


@query("multi_parent", _RAW + "SELECT from_entity_id, count(DISTINCT to_entity_id) AS parents, min(id) AS keep_id FROM raw_relations WHERE relation_type = 'part_of' GROUP BY 1 HAVING count(DISTINCT to_entity_id) > 1")
def _(spark, d):
    return Q.multi_parent(S.raw_relations(spark, d))


@query("merge_collisions", _RAW + ", p AS (SELECT *, first_value(id) OVER w AS keep_id, min(to_entity_id) OVER (PARTITION BY from_entity_id) AS lo, max(to_entity_id) OVER (PARTITION BY from_entity_id) AS hi FROM raw_relations WHERE relation_type = 'part_of' WINDOW w AS (PARTITION BY from_entity_id ORDER BY id)) SELECT from_entity_id, relation_type, keep_id, id AS delete_id FROM p WHERE lo <> hi AND id <> keep_id")
def _(spark, d):
    return Q.merge_collisions(S.raw_relations(spark, d))


@query("dangling_relations", _ER + "SELECT id FROM relations WHERE from_entity_id NOT IN (SELECT id FROM entities WHERE id % 10 <> 0) OR to_entity_id NOT IN (SELECT id FROM entities WHERE id % 10 <> 0)")
def _(spark, d):
    return Q.dangling(S.entities(spark, d).where("id % 10 <> 0"), S.relations(spark, d))


@query("lifecycle_issues", _O + "SELECT id, 'active_with_obsoleted_at' AS issue FROM observations WHERE status = 'active' AND obsoleted_at IS NOT NULL UNION ALL SELECT id, 'superseded_without_reference' FROM observations WHERE status = 'superseded' AND superseded_by_id IS NULL UNION ALL SELECT a.id, 'superseded_by_other_entity' FROM observations a JOIN observations b ON a.superseded_by_id = b.id WHERE a.memory_entity_id <> b.memory_entity_id")
def _(spark, d):
    return Q.lifecycle_issues(S.observations(spark, d))


@query("constraint_violations", _O + """, b AS (SELECT id, CASE WHEN id % 23 = 0 THEN '  ' ELSE content END AS content, CASE WHEN id % 29 = 0 THEN 1.5 WHEN id % 31 = 0 THEN -0.1 ELSE confidence END AS confidence, CASE WHEN id % 37 = 0 THEN 'odd' ELSE status END AS status, CASE WHEN id % 41 = 0 THEN id ELSE superseded_by_id END AS superseded_by_id, obsoleted_at, CASE WHEN id % 43 = 0 THEN TIMESTAMP '2026-01-01' ELSE valid_from END AS valid_from, CASE WHEN id % 43 = 0 THEN TIMESTAMP '2025-01-01' ELSE valid_until END AS valid_until FROM observations)
SELECT id, 'active_obsoleted' AS rule FROM b WHERE status = 'active' AND obsoleted_at IS NOT NULL UNION ALL SELECT id, 'superseded_without_reference' FROM b WHERE status = 'superseded' AND superseded_by_id IS NULL UNION ALL SELECT id, 'validity_order' FROM b WHERE valid_until < valid_from
UNION ALL SELECT id, 'content_blank' FROM b WHERE content IS NULL OR trim(content) = '' UNION ALL SELECT id, 'confidence_range' FROM b WHERE confidence < 0 OR confidence > 1 UNION ALL SELECT id, 'status_unknown' FROM b WHERE status NOT IN ('active', 'obsolete', 'superseded') UNION ALL SELECT id, 'self_reference' FROM b WHERE superseded_by_id = id""")
def _(spark, d):
    k, t = F.col("id"), lambda x: F.lit(x).cast("timestamp")
    dirty = S.observations(spark, d).withColumns({
        "content": F.when(k % 23 == 0, "  ").otherwise(F.col("content")), "confidence": F.when(k % 29 == 0, 1.5).when(k % 31 == 0, -0.1).otherwise(F.col("confidence")),
        "status": F.when(k % 37 == 0, "odd").otherwise(F.col("status")), "superseded_by_id": F.when(k % 41 == 0, k).otherwise(F.col("superseded_by_id")),
        "valid_from": F.when(k % 43 == 0, t("2026-01-01")).otherwise(F.col("valid_from")), "valid_until": F.when(k % 43 == 0, t("2025-01-01")).otherwise(F.col("valid_until")),
    })
    return scan.violations(dirty)


@query("counter_drift", views("entities", "observations") + ", c AS (SELECT e.id, e.id % 6 AS stored, count(o.id) AS counted FROM entities e LEFT JOIN observations o ON o.memory_entity_id = e.id WHERE entity_type = 'Component' GROUP BY e.id) SELECT * FROM c WHERE stored <> counted")
def _(spark, d):
    e = S.entities(spark, d).where("entity_type = 'Component'").withColumn("memory_observations_count", F.col("id") % 6)
    return Q.counter_drift(e, S.observations(spark, d))


@query("stale_embeddings", _O + "SELECT id FROM observations WHERE embedding IS NULL")
def _(spark, d):
    return Q.stale_embeddings(S.observations(spark, d, with_vectors=True))


@query("embedding_coverage", _O + "SELECT count(*) AS total, count(*) - count(embedding) AS missing, round(100.0 * count(embedding) / count(*))::DOUBLE AS percent FROM observations")
def _(spark, d):
    return stats.embedding_coverage(S.observations(spark, d, with_vectors=True))


@query("graph_health", views("entities", "relations", "observations") + """SELECT 'entities' AS metric, count(*) AS n FROM entities UNION ALL SELECT 'active_observations', count(*) FROM observations WHERE status = 'active' UNION ALL SELECT 'relations', count(*) FROM relations
UNION ALL SELECT 'orphans', count(*) FROM entities WHERE entity_type <> 'Project' AND id NOT IN (SELECT from_entity_id FROM relations WHERE relation_type = 'part_of')
UNION ALL SELECT 'duplicate_groups', count(*) FROM (SELECT 1 FROM observations WHERE status = 'active' GROUP BY memory_entity_id, content HAVING count(*) > 1)
UNION ALL SELECT 'dangling', count(*) FROM relations WHERE from_entity_id NOT IN (SELECT id FROM entities) OR to_entity_id NOT IN (SELECT id FROM entities)""")
def _(spark, d):
    return stats.health(S.graph(spark, d))


_A = views("audit")


@query("audit_recent", _A + "SELECT id, action, actor FROM audit WHERE created_at >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY AND action = 'delete' ORDER BY created_at DESC, id DESC LIMIT 50")
def _(spark, d):
    return scan.audit_scan(S.audit_logs(spark, d), "2024-01-30", action="delete").limit(50).select("id", "action", "actor")


@query("audit_expired", _A + "SELECT id FROM audit WHERE created_at < TIMESTAMP '2024-04-15' - INTERVAL 90 DAY")
def _(spark, d):
    return scan.audit_expired(S.audit_logs(spark, d), "2024-04-15").select("id")


@query("audit_summary", _A + "SELECT count(*) AS total, count(*) FILTER (created_at >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY) AS filtered, count(*) FILTER (created_at < TIMESTAMP '2024-01-30' - INTERVAL 90 DAY) AS expired FROM audit")
def _(spark, d):
    return stats.audit_summary(S.audit_logs(spark, d), "2024-01-30")


@query("audit_json_fields", _A + "SELECT id, CAST(json_extract(changed_fields, '$.k') AS BIGINT) AS k FROM audit")
def _(spark, d):
    return S.audit_logs(spark, d).select("id", F.get_json_object("changed_fields", "$.k").cast("long").alias("k"))


@query("latest_per_type", _A + "SELECT auditable_type, arg_max(id, (created_at, id)) AS id FROM audit GROUP BY 1")
def _(spark, d):
    return stats.latest_per(S.audit_logs(spark, d), "auditable_type", F.desc("created_at"), F.desc("id")).select("auditable_type", "id")


@query("retention_overflow", _A + "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY auditable_type, action ORDER BY created_at DESC, id DESC) AS n FROM audit) WHERE n > 30")
def _(spark, d):
    rows = S.audit_logs(spark, d).withColumn("k", F.concat_ws("|", "auditable_type", "action"))
    return stats.beyond_retention(rows, "k", 30, F.desc("created_at"), F.desc("id")).select("id")


@query("monotone_progress", _A + "SELECT id, actor, max(value) OVER (PARTITION BY actor ORDER BY created_at, value ROWS UNBOUNDED PRECEDING) AS progress FROM audit")
def _(spark, d):
    return stats.running_progress(S.audit_logs(spark, d), "actor", "created_at", "value").select("id", "actor", "progress")


@query("client_activity", _A + ", seen AS (SELECT actor, max(created_at) AS seen_at FROM audit GROUP BY actor), b AS (SELECT CASE WHEN seen_at IS NULL THEN 'unknown' WHEN epoch(TIMESTAMP '2024-01-30') - epoch(seen_at) <= 300 THEN 'active' WHEN epoch(TIMESTAMP '2024-01-30') - epoch(seen_at) <= 3600 THEN 'idle' ELSE 'stale' END AS bucket FROM seen) SELECT bucket, count(*) AS n FROM b GROUP BY 1")
def _(spark, d):
    seen = S.audit_logs(spark, d).groupBy("actor").agg(F.max("created_at").alias("at"))
    return stats.activity(seen, "at", "2024-01-30")


@query("byte_budget", "WITH t AS (SELECT page_id, strlen(html) AS size FROM pages), s AS (SELECT page_id, size, sum(size) OVER (ORDER BY page_id) AS total, row_number() OVER (ORDER BY page_id) AS n FROM t WHERE size <= 50000) SELECT page_id, size::BIGINT AS size FROM s WHERE total <= 200000 AND n <= 50")
def _(spark, d):
    rows = S.table(spark, d, "pages").select("page_id", F.octet_length("html").cast("long").alias("size"))
    return scan.within_budget(rows, "page_id", "size", 50_000, 200_000, 50).select("page_id", "size")


_SCORE = " + ".join(f"CASE WHEN contains(lower(coalesce({f}, '')), '{t}') THEN {p} + CASE WHEN list_contains(string_split_regex(lower(coalesce({f}, '')), '[\\s,|]+'), '{t}') THEN {w} ELSE 0 END ELSE 0 END" for t in ("red", "brand#3", "component") for f, p, w in search.FIELDS)
_HITS = " + ".join("CAST(" + " OR ".join(f"contains(lower(coalesce({f}, '')), '{t}')" for f, _, _ in search.FIELDS) + " AS INT)" for t in ("red", "brand#3", "component"))
_MATCHED = "concat_ws(',', " + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(coalesce({f}, '')), '{t}')" for t in ("red", "brand#3", "component")) + f" THEN '{f}' END" for f, _, _ in search.FIELDS) + ")"
_TEXT = f"scored AS (SELECT id, name, entity_type, ({_SCORE} + CASE WHEN {_HITS} > 1 THEN 3.0 * ({_HITS} - 1) ELSE 0 END)::DOUBLE AS score, {_MATCHED} AS matched_fields FROM entities)"


@query("entity_text_search", _E[:-1] + f", {_TEXT} SELECT * FROM scored WHERE score >= 1 ORDER BY score DESC, lower(entity_type), lower(name), id LIMIT 50")
def _(spark, d):
    return search.text_search(S.entities(spark, d), "red brand#3 Component")


@query("entity_text_search_all", _E[:-1] + f", {_TEXT} SELECT id, score FROM scored WHERE score >= 1")
def _(spark, d):
    return search.text_search(S.entities(spark, d), "red brand#3 Component", None).select("id", "score")


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


@query("vector_topk", f"SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS distance FROM embeddings WHERE 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}) < 0.85 ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}), vec_id LIMIT 20")
def _(spark, d):
    near = search.vector_search(S.vectors(spark, d), query_vector(spark, d))
    return near.select("id", F.round("distance", 6).alias("distance"))


@query("vector_topk_typed", f"SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS distance FROM embeddings WHERE label = 1 AND 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}) < 0.95 ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}), vec_id LIMIT 1")
def _(spark, d):
    near = search.vector_search(S.vectors(spark, d), query_vector(spark, d), 1, "1", 0.95)
    return near.select("id", F.round("distance", 6).alias("distance"))


@query("observation_vector_min", _O + f"SELECT memory_entity_id, round(min(1 - list_cosine_similarity(embedding::DOUBLE[], {_Q})), 6) AS distance FROM observations WHERE status = 'active' AND embedding IS NOT NULL GROUP BY 1 ORDER BY min(1 - list_cosine_similarity(embedding::DOUBLE[], {_Q})), 1 LIMIT 50")
def _(spark, d):
    near = search.observation_search(S.observations(spark, d, with_vectors=True), query_vector(spark, d))
    return near.select("memory_entity_id", F.round("distance", 6).alias("distance"))


_BOOST = "CASE WHEN lower(e.name) = '{q}' THEN 0.10 WHEN starts_with(lower(e.name), '{q}') OR starts_with('{q}', lower(e.name)) THEN 0.04 ELSE 0 END"
_WEIGHT = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in search.TYPE_WEIGHTS.items()) + " ELSE 1.0 END"
_HYBRID = f"""{_TEXT},
tl AS (SELECT * FROM scored WHERE score >= 1 ORDER BY score DESC, lower(entity_type), lower(name), id LIMIT 40),
tr AS (SELECT id, (1 + score / greatest(max(score) OVER (), 1)) / (60 + row_number() OVER (ORDER BY score DESC, lower(entity_type), lower(name), id)) AS part, 'text' AS source FROM tl),
o AS (SELECT memory_entity_id AS id, min(1 - list_cosine_similarity(embedding::DOUBLE[], {_Q})) AS distance FROM observations WHERE status = 'active' AND embedding IS NOT NULL GROUP BY 1 ORDER BY 2, 1 LIMIT 40),
orr AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY distance, id)) AS part, 'observation' AS source FROM o),
f AS (SELECT id, sum(part) AS score, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT * FROM tr UNION ALL SELECT * FROM orr) GROUP BY id)
SELECT f.id, e.name, e.entity_type, round((f.score + {_BOOST.format(q="red brand#3 component")}) * {_WEIGHT} + CASE WHEN degree > 0 THEN log2(1 + degree) * 0.003 ELSE 0 END, 4) AS score, sources
FROM f JOIN entities e USING (id) LEFT JOIN degree USING (id) ORDER BY 4 DESC, 1 LIMIT 20"""


@query("hybrid_rrf", views("entities", "relations", "degree", "observations")[:-1] + ", " + _HYBRID)
def hybrid(spark: SparkSession, d: str) -> DataFrame:
    g = S.graph(spark, d, with_vectors=True)
    return search.hybrid_search(g.entities, g.observations, g.relations, "red brand#3 Component", query_vector(spark, d), limit=20)


@query("rank_ids_boosted", views("entities", "relations", "degree")[:-1] + f" SELECT e.id, round(greatest({_BOOST.format(q='order#1')}, 0.01) * {_WEIGHT} + CASE WHEN degree > 0 THEN log2(1 + degree) * 0.003 ELSE 0 END + CASE WHEN e.id = 10000000001 THEN 0.04 WHEN e.id < 20000000010 THEN 0.02 ELSE 0 END, 6) AS score FROM entities e LEFT JOIN degree USING (id)")
def _(spark, d):
    e, r = S.entities(spark, d), S.relations(spark, d)
    scope = e.where("id < 20000000010").select("id")
    return search.rank_entity_ids(e.select("id"), e, r, "order#1", scope, 10_000_000_001)


@query("subgraph_candidates", views("entities", "observations") + "SELECT id FROM entities WHERE lower(coalesce(name, '')) LIKE '%gizmo%' OR lower(coalesce(entity_type, '')) LIKE '%gizmo%' OR lower(coalesce(aliases, '')) LIKE '%gizmo%' UNION SELECT memory_entity_id FROM observations WHERE status = 'active' AND lower(content) LIKE '%gizmo%'")
def _(spark, d):
    return search.subgraph_candidates(S.entities(spark, d), S.observations(spark, d), "gizmo")


@query("subgraph_search_page", views("entities", "relations", "degree", "observations")[:-1] + f""" , c AS (SELECT id FROM entities WHERE lower(coalesce(name, '')) LIKE '%brand#1%' OR lower(coalesce(aliases, '')) LIKE '%brand#1%' OR lower(entity_type) LIKE '%brand#1%' UNION SELECT memory_entity_id FROM observations WHERE status = 'active' AND lower(content) LIKE '%brand#1%'),
s AS (SELECT e.id, round(greatest({_BOOST.format(q='brand#1')}, 0.01) * {_WEIGHT} + CASE WHEN degree > 0 THEN log2(1 + degree) * 0.003 ELSE 0 END, 6) AS score FROM c JOIN entities e USING (id) LEFT JOIN degree USING (id))
SELECT id, score FROM s ORDER BY score DESC, id LIMIT 25 OFFSET 25""")
def _(spark, d):
    g = S.graph(spark, d)
    ids = search.subgraph_candidates(g.entities, g.observations, "brand#1")
    return search.page(search.rank_entity_ids(ids, g.entities, g.relations, "brand#1"), 2, 25, F.desc("score"), F.asc("id"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_TOK = "list_filter(list_distinct(list_filter(string_split_regex(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{Nd}}\\s]+', ' ', 'g'), '\\s+'), lambda w: length(w) >= 2)), lambda w: NOT list_contains(" + _STOP + ", w))"


@query("token_overlap", _O + f", t AS (SELECT id, {_TOK.format(c='content')} AS c, {_TOK.format(c=repr('The red house of la que der'))} AS q FROM observations) SELECT id, len(c)::BIGINT AS n_tokens, CASE WHEN len(c) = 0 THEN 0.0 ELSE round(len(list_intersect(q, c)) / len(q)::DOUBLE, 6) END AS overlap FROM t")
def _(spark, d):
    q, c = T.tokens(F.lit("The red house of la que der")), T.tokens(F.col("content"))
    return S.observations(spark, d).select("id", F.size(c).cast("long").alias("n_tokens"), F.round(T.overlap(q, c), 6).alias("overlap"))


_any = lambda ms: " OR ".join(f"contains(lower(coalesce(source, '')), '{m}')" for m in ms)
_TRUST = f"""trust AS (SELECT o.*, greatest(0.0, least(1.0, round(coalesce(confidence, 0.5) * CASE WHEN status = 'active' THEN 1.0 ELSE 0.0 END
 * CASE WHEN TIMESTAMP '2024-06-01' < valid_from THEN 0.5 WHEN TIMESTAMP '2024-06-01' > valid_until THEN 0.0 ELSE 1.0 END
 * CASE WHEN {_any(T.HIGH_TRUST)} THEN 1.15 WHEN {_any(T.LOW_TRUST)} THEN 0.85 ELSE 1.0 END + least(log2(1 + coalesce(degree, 0)) * 0.05, 0.2), 4))) AS trust_score
 FROM observations o LEFT JOIN degree d ON d.id = o.memory_entity_id)"""


@query("trust_scores", views("relations", "degree", "observations")[:-1] + f", {_TRUST} SELECT id, trust_score FROM trust")
def _(spark, d):
    return R.trust_scores(S.observations(spark, d), S.relations(spark, d), S.NOW).select("id", "trust_score")


@query("rank_observations", views("relations", "degree", "observations")[:-1] + f", {_TRUST} SELECT id, trust_score FROM trust ORDER BY trust_score DESC, coalesce(confidence, 0) DESC, id LIMIT 30")
def _(spark, d):
    return R.rank_observations(S.observations(spark, d), S.relations(spark, d), S.NOW, limit=30).select("id", "trust_score")


@query("rank_observations_by_query", views("relations", "degree", "observations")[:-1] + f""", {_TRUST}, t AS (SELECT *, {_TOK.format(c='content')} AS c, {_TOK.format(c=repr('la que der house'))} AS q, 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}) AS dist FROM trust),
 r AS (SELECT id, trust_score, confidence, CASE WHEN len(c) = 0 THEN 0.0 ELSE len(list_intersect(q, c)) / len(q)::DOUBLE END AS share, dist FROM t)
 SELECT id, round(CASE WHEN dist IS NULL THEN share ELSE 0.6 * share + 0.4 * greatest(1 - dist, 0.0) END, 6) AS relevance FROM r ORDER BY CASE WHEN dist IS NULL THEN share ELSE 0.6 * share + 0.4 * greatest(1 - dist, 0.0) END DESC, trust_score DESC, coalesce(confidence, 0) DESC, id LIMIT 40""")
def _(spark, d):
    rows = R.rank_observations(S.observations(spark, d, with_vectors=True), S.relations(spark, d), S.NOW, "la que der house", query_vector(spark, d), 40)
    return rows.select("id", F.round("relevance", 6).alias("relevance"))


@query("grouped_evidence", views("entities", "observations") + "SELECT memory_entity_id, e.name || ' (' || e.entity_type || ')' || chr(10) || string_agg('- ' || content, chr(10) ORDER BY o.id) AS evidence FROM observations o JOIN entities e ON e.id = o.memory_entity_id WHERE status = 'active' GROUP BY memory_entity_id, e.name, e.entity_type")
def _(spark, d):
    return stats.grouped_evidence(S.observations(spark, d), S.entities(spark, d))


@query("append_upsert", _E + "SELECT name, entity_type FROM entities UNION ALL SELECT 'event ' || event_id, event_type FROM events WHERE event_id % 2 = 1")
def _(spark, d):
    old = S.entities(spark, d).select("name", "entity_type")
    e = S.table(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Order#"), (F.col("event_id") % 1000).cast("string"))).otherwise(F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("name"), F.col("event_type").alias("entity_type"))
    new = e.where("name IS NOT NULL")
    return appended(old, new, ["name"])


@query("dot_export", _ER + """, q AS (SELECT id, entity_type, replace(name, '"', '''') AS name FROM entities) SELECT 1 AS part, id AS key, '  subgraph cluster_' || entity_type || ' { n' || id || ' [label="' || name || '"]; }' AS line FROM q UNION ALL SELECT 2, id, '  n' || from_entity_id || ' -> n' || to_entity_id || ' [label="' || relation_type || '"];' FROM relations""")
def _(spark, d):
    return dot_lines(S.entities(spark, d), S.relations(spark, d))


@query("embedding_text", _E + "SELECT id, entity_type || ': ' || name || CASE WHEN aliases IS NULL THEN '' ELSE '. Aliases: ' || aliases END || CASE WHEN description IS NULL THEN '' ELSE '. ' || description END AS text FROM entities")
def _(spark, d):
    c = F.col
    return S.entities(spark, d).select("id", T.compose_entity_text(c("entity_type"), c("name"), c("aliases"), c("description")).alias("text"))


@query("preview_contents", _O + "SELECT id, CASE WHEN length(content) > 100 THEN substring(content, 1, 97) || '...' ELSE content END AS preview, len(list_filter(list_transform(string_split_regex(coalesce(source, ''), '[,|;]'), lambda a: trim(a)), lambda a: a <> ''))::BIGINT AS parts FROM observations")
def _(spark, d):
    return S.observations(spark, d).select("id", T.truncated(F.col("content")).alias("preview"), F.size(T.alias_list(F.col("source"))).cast("long").alias("parts"))


@query("entity_scan_by_updates", _E + ", o AS (SELECT id, name, updated_at, id % 6 AS n FROM entities) SELECT id, name FROM o WHERE updated_at >= TIMESTAMP '2024-03-01' AND updated_at <= TIMESTAMP '2024-04-01' AND n >= 3")
def _(spark, d):
    e = S.entities(spark, d).withColumn("memory_observations_count", F.col("id") % 6)
    return scan.entity_scan(e, min_observations=3, updated_since="2024-03-01", updated_until="2024-04-01").select("id", "name")


@query("observation_scan_page", _O + "SELECT id, status FROM observations WHERE lower(coalesce(content, '')) LIKE '%an%' AND created_at >= TIMESTAMP '2024-02-01' AND created_at <= TIMESTAMP '2024-08-01' ORDER BY id LIMIT 20 OFFSET 20")
def _(spark, d):
    return scan.observation_scan(S.observations(spark, d), content="AN", since="2024-02-01", until="2024-08-01", include_obsolete=True, page=2).select("id", "status")


@query("relation_scan_page", _ER + ", r AS (SELECT * FROM relations WHERE relation_type = 'part_of' AND id % 300 BETWEEN 31 AND 90 ORDER BY id LIMIT 20 OFFSET 40) SELECT r.id, a.name AS from_name, b.name AS to_name FROM r LEFT JOIN entities a ON a.id = from_entity_id LEFT JOIN entities b ON b.id = to_entity_id")
def _(spark, d):
    r = S.relations(spark, d).withColumn("created_at", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(F.col("id") % 300).cast("int")))
    return scan.relation_scan(r, S.entities(spark, d), relation_type="part_of", since="2024-02-01", until="2024-03-31", page=3).select("id", "from_name", "to_name")


@query("client_summary", _A + ", seen AS (SELECT actor, max(created_at) AS seen_at FROM audit GROUP BY actor) SELECT count(*) AS total, count(*) FILTER (epoch(TIMESTAMP '2024-01-30') - epoch(seen_at) <= 300) AS recent_count, count(*) FILTER (actor % 3 = 0) AS with_context_count FROM seen")
def _(spark, d):
    seen = S.audit_logs(spark, d).groupBy("actor").agg(F.max("created_at").alias("at")).withColumn("project_id", F.when(F.col("actor") % 3 == 0, F.col("actor")))
    return stats.activity_summary(seen, "at", "project_id", "2024-01-30")


@query("trust_rescored", views("relations", "degree", "observations")[:-1] + f", {_TRUST}, c AS (SELECT l_partkey + 50000000000 AS id FROM lineitem WHERE l_orderkey % 100 = 7) SELECT id, CASE WHEN memory_entity_id IN (SELECT id FROM c) THEN trust_score ELSE -1 END AS trust_score FROM trust")
def _(spark, d):
    r = S.relations(spark, d)
    changed = r.where("relation_type = 'depends_on' AND (from_entity_id - 60000000000) % 100 = 7")
    return R.rescored(S.observations(spark, d).withColumn("trust_score", F.lit(-1.0)), r, changed, S.NOW).select("id", "trust_score")
