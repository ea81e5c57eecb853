"""Named queries for work in batches: cursors and compaction runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from knotwork.operators import applying, compaction, quality, review
from knotwork.operators import graph as G
from knotwork.plans.base import query, views
from knotwork.plans.queries import _TOK
from knotwork.plans.resolution import _PAIRS
from knotwork.sources import exchange
from knotwork.sources import views as S
from knotwork.sources.shared import shared_dir
from knotwork.streaming import audit
from knotwork.streaming.cursor import BatchLog, run_stream


def _folder(spark, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _pausing(*after: int):
    """Asks for a pause after the given numbers of questions."""
    asked = iter(range(1, 1 << 30))
    return lambda: next(asked) in after


@query("cursor_totals", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS value, max(event_id) AS last_id FROM events GROUP BY user_id")
def _(spark, d):
    """The change log in batches of one file, stopped after the second one and taken up again."""
    at = _folder(spark, "cursor")
    S.table(spark, d, "events").repartitionByRange(6, "event_id").write.parquet(f"{at}/source")
    log = BatchLog(spark, f"{at}/log", "user_id long, n long, value double, last_id long")
    totals = lambda batch, _: batch.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.max("event_id").alias("last_id"))
    paused = _pausing(2)
    while not run_stream(audit.read_events(spark, f"{at}/source", 1, "*.parquet"), log, totals, f"{at}/checkpoint", paused):
        pass
    return log.rows().groupBy("user_id").agg(F.sum("n").alias("n"), F.round(F.sum("value"), 4).alias("value"), F.max("last_id").alias("last_id"))


# A graph to be compacted: nations as projects, embedded entities that bear a nation's name or their own, every fourth below one


def _untidy(spark, d):
    n = S.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    v = S.table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("entity_type"), "embedding")
    none = F.lit(None).cast("string")
    named = v.join(n, F.col("id") % 40 == F.col("k"), "left").select("id", F.coalesce("n_name", F.concat(F.lit("v"), (F.col("id") % 50).cast("string"))).alias("name"), "entity_type", none.alias("aliases"), none.alias("description"))
    entities = n.select((F.col("k") + S.KIND).alias("id"), F.col("n_name").alias("name"), F.lit("Project").alias("entity_type"), none.alias("aliases"), none.alias("description")).unionByName(named)
    count = F.broadcast(v.agg(F.count("*").alias("c")))  # one row
    facts = S.table(spark, d, "documents").crossJoin(count).select(F.col("doc_id").alias("id"), (F.col("doc_id") % F.col("c")).alias("memory_entity_id"), F.concat(F.lit("a certain fact "), (F.floor(F.col("doc_id") / 7) % 2).cast("string")).alias("content"), F.lit("active").alias("status"))
    edges = v.where("id % 4 = 0").select((F.col("id") + S.EDGE).alias("id"), F.col("id").alias("from_entity_id"), (F.col("id") % 25 + S.KIND).alias("to_entity_id"), F.lit("part_of").alias("relation_type"))
    return S.Graph(entities, facts, edges), v


_UNTIDY = f"""WITH RECURSIVE {_PAIRS}, p AS (SELECT n_nationkey + 10000000000 AS id, n_name AS name FROM nation),
e AS (SELECT vec_id AS id, coalesce(n_name, 'v' || vec_id % 50) AS name, label FROM embeddings LEFT JOIN nation ON n_nationkey = vec_id % 40),
f AS (SELECT doc_id AS id, doc_id % (SELECT count(*) FROM embeddings) AS m, 'a certain fact ' || (doc_id // 7) % 2 AS content FROM documents),
w0 AS (SELECT id, unnest({_TOK.format(c='name')}) AS t FROM e WHERE id % 4 <> 0), pt AS (SELECT id AS project_id, lower(name) AS pn, {_TOK.format(c='name')} AS ts FROM p),
s AS (SELECT w0.id, project_id, sum(CASE WHEN list_contains(ts, t) THEN 10 ELSE 5 END) AS score FROM w0 JOIN pt ON contains(pn, t) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, project_id) AS n, lead(score) OVER (PARTITION BY id ORDER BY score DESC, project_id) AS next FROM s),
o AS (SELECT e.id, project_id, score, coalesce(score >= 10 AND (next IS NULL OR score - next >= 3), false) AS auto FROM e LEFT JOIN (SELECT * FROM r WHERE n = 1) r USING (id) WHERE e.id % 4 <> 0),
up AS (SELECT id, id % 25 + 10000000000 AS parent FROM e WHERE id % 4 = 0 UNION ALL SELECT id, project_id FROM o WHERE auto),
w AS (SELECT e.id, (SELECT count(*) FROM f WHERE m = e.id) * 10 + (SELECT count(*) FROM up WHERE up.id = e.id) AS w, e.id NOT IN (SELECT id FROM up) AS part FROM e),
near AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS n FROM pairs WHERE distance < 0.75),
sc AS (SELECT a, b, distance, CASE WHEN distance < 0.65 THEN 8 ELSE 4 END + CASE WHEN x.name = y.name THEN 8 ELSE 0 END + least(2 * (SELECT count(*) FROM (SELECT content FROM f WHERE m = a INTERSECT SELECT content FROM f WHERE m = b)), 6) AS score FROM near JOIN e x ON x.id = a JOIN e y ON y.id = b WHERE n <= 9),
bst AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, distance, b) AS n FROM sc WHERE score >= 4),
dec AS (SELECT a, b, score, distance < 0.65 AND score >= 10 AS merge, wa.w > wb.w AS a_stays, wa.part AS part FROM bst JOIN w wa ON wa.id = a JOIN w wb ON wb.id = b WHERE n = 1),
mg AS (SELECT CASE WHEN a_stays THEN b ELSE a END AS source, CASE WHEN a_stays THEN a ELSE b END AS target, score, row_number() OVER (PARTITION BY CASE WHEN a_stays THEN b ELSE a END ORDER BY part, a) AS n FROM dec WHERE merge),
m1 AS (SELECT * FROM mg WHERE n = 1), ch(source, pos) AS (SELECT source, target FROM m1 UNION SELECT ch.source, m1.target FROM ch JOIN m1 ON m1.source = pos),
fin AS (SELECT source, pos FROM ch WHERE pos NOT IN (SELECT source FROM m1)),
ow AS (SELECT f.id, coalesce(pos, m) AS m, content FROM f LEFT JOIN fin ON source = m), du AS (SELECT *, row_number() OVER (PARTITION BY m, content ORDER BY id) AS n FROM ow)
SELECT CASE WHEN auto THEN 'parent' ELSE 'review_parent' END AS kind, id AS a, project_id AS b, score::DOUBLE AS score FROM o
UNION ALL SELECT 'merge', source, target, score FROM m1 UNION ALL SELECT 'review_merge', a, b, score FROM dec WHERE NOT merge
UNION ALL SELECT 'delete_observation', id, m, NULL FROM du WHERE n > 1"""


@query("compaction_run", _UNTIDY)
def _(spark, d):
    """A run in four slices, paused twice and taken up again; its changes but the proposals."""
    g, v = _untidy(spark, d)
    at, settings, paused = _folder(spark, "compaction"), compaction.Settings(review_distance=0.75, merge_distance=0.65), _pausing(2, 5)
    done = None
    while done is None:
        done = compaction.compact(g, v, at, 4, settings, 2 * S.EDGE, paused)
    changes = done[1]
    rows = changes["orphans"].unionByName(changes["merges"]).unionByName(changes["observations"])
    return rows.select("kind", "a", "b", "score")


@query("tree_in_order", views("entities", "relations", then="""ed AS (SELECT CASE WHEN relation_type IN ('part_of', 'depends_on') THEN to_entity_id ELSE from_entity_id END AS a, CASE WHEN relation_type IN ('part_of', 'depends_on') THEN from_entity_id ELSE to_entity_id END AS b,
  id AS edge, CASE WHEN relation_type IN ('part_of', 'depends_on') THEN 'incoming' ELSE 'outgoing' END AS direction, CASE WHEN relation_type IN ('part_of', 'depends_on') THEN 0 ELSE 100000000000000 END + id AS place FROM relations),
w(id, path, places, depth, relation_id, direction) AS (SELECT id, [id], [id], 0, NULL::BIGINT, NULL::VARCHAR FROM entities WHERE entity_type = 'Project' UNION ALL SELECT b, list_append(path, b), list_append(places, place), depth + 1, edge, ed.direction FROM w JOIN ed ON a = w.id WHERE depth < 3 AND NOT list_contains(path, b) AND (depth = 0 OR w.id >= 20000000000))""", recursive=True) + "SELECT row_number() OVER (ORDER BY places) AS position, id, depth, coalesce(relation_id, -1) AS relation_id, coalesce(direction, '') AS direction FROM w")
def _(spark, d):
    e = S.entities(spark, d)
    rows = G.ordered_tree(e, S.relations(spark, d), e.where("entity_type = 'Project'"), 3)
    return rows.select("position", "id", "depth", "relation_id", "direction").fillna({"relation_id": -1, "direction": ""})


# Lines: orders as entities below their customers, some known, repeated or of another type


@query("lines_upserted", views("entities", "relations") + """, l AS (SELECT o_orderkey AS k, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Order#' || o_orderkey ELSE 'Note#' || o_orderkey // 2 END AS name, o_orderkey % 3 <> 0 AS fresh FROM orders),
nw AS (SELECT name, min(k) AS f FROM l WHERE fresh GROUP BY name), ni AS (SELECT name, f, 8000000000000 + row_number() OVER (ORDER BY f) - 1 AS id FROM nw),
t AS (SELECT l.*, CASE WHEN fresh THEN ni.id ELSE k + 60000000000 END AS id, f FROM l LEFT JOIN ni USING (name)),
o1 AS (SELECT id, 'placed ' || k % 5 AS content FROM t UNION ALL SELECT id, 'placed ' || k % 5 FROM t WHERE k = f UNION ALL SELECT id, 'seen' FROM t),
o2 AS (SELECT id, content, count(*) FILTER (content LIKE 'placed%') AS n FROM o1 GROUP BY 1, 2),
fo AS (SELECT id, 'placed ' || f % 5 AS content FROM t WHERE k = f),
e AS (SELECT id, arg_min(o_custkey, k) + 30000000000 AS parent FROM t WHERE fresh GROUP BY id)
SELECT 'entity' AS part, id, NULL::BIGINT AS ref_id, name AS label, 1::BIGINT AS n FROM ni
UNION ALL SELECT 'observation', o2.id, NULL, o2.content, CASE WHEN fo.id IS NULL THEN 1 ELSE 2 END FROM o2 LEFT JOIN fo ON fo.id = o2.id AND fo.content = o2.content
UNION ALL SELECT 'relation', id, parent, 'part_of', 1 FROM e UNION ALL SELECT 'relation', from_entity_id, to_entity_id, relation_type, 1 FROM relations WHERE relation_type = 'part_of'""")
def _(spark, d):
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Order#"), k.cast("string"))).otherwise(F.concat(F.lit("Note#"), F.floor(k / 2).cast("string")))
    c = S.table(spark, d, "customer").select("c_custkey", "c_name")
    orders = S.table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    fact = F.concat(F.lit("placed "), (k % 5).cast("string"))
    entity = F.to_json(F.struct(F.lit("entity").alias("type"), name.alias("name"), F.when(k % 3 == 0, "todo").otherwise("gems").alias("entityType"), F.array(fact, fact, F.lit("seen"), F.lit(" ")).alias("observations")))
    edge = F.to_json(F.struct(F.lit("relation").alias("type"), name.alias("from"), F.col("c_name").alias("to"), F.lit("child_of").alias("relationType")))
    lines = orders.select((k * 4).alias("position"), entity.alias("value")).unionAll(orders.select(k * 4 + 1, edge)).unionAll(orders.where(k % 7 == 0).select(k * 4 + 2, F.concat(F.lit('{"type": "entity", "name": "'), "c_name", F.lit('", "entityType": "Tool", "observations": ["x"]}'))))
    lines = lines.unionAll(orders.where(k % 11 == 0).select(k * 4 + 3, F.lit("{no json")))
    g = S.graph(spark, d)
    out = exchange.upserted(g, lines, 8 * S.EDGE)
    new = out.entities.where(F.col("id") >= 8 * S.EDGE).select(F.lit("entity").alias("part"), "id", F.lit(None).cast("long").alias("ref_id"), F.col("name").alias("label"), F.lit(1).cast("long").alias("n"))
    facts = out.observations.where(F.col("id") >= 8 * S.EDGE).groupBy("memory_entity_id", "content").agg(F.count("*").alias("n")).select(F.lit("observation"), "memory_entity_id", F.lit(None).cast("long"), "content", "n")
    edges = out.relations.where("relation_type = 'part_of'").select(F.lit("relation"), "from_entity_id", "to_entity_id", "relation_type", F.lit(1).cast("long"))
    return new.unionAll(facts).unionAll(edges)


@query("integrity_sweep", views("entities", "raw_relations", "observations")[:-1] + """, e AS (SELECT id, id % 5 AS stored FROM entities WHERE entity_type IN ('Component', 'Task') AND id % 9 <> 0),
o AS (SELECT id, memory_entity_id, 'fact ' || (id // 200) % 3 AS content, status, obsoleted_at, superseded_by_id FROM observations),
s1 AS (SELECT *, min(id) OVER (PARTITION BY from_entity_id, to_entity_id, relation_type) AS keep FROM raw_relations), r AS (SELECT * FROM s1 WHERE id = keep),
mp AS (SELECT from_entity_id, min(id) AS keep FROM raw_relations WHERE relation_type = 'part_of' GROUP BY 1 HAVING count(DISTINCT to_entity_id) > 1),
s2 AS (SELECT *, min(id) OVER (PARTITION BY memory_entity_id, content) AS keep FROM o WHERE status = 'active'), q AS (SELECT * FROM o WHERE id NOT IN (SELECT id FROM s2 WHERE id <> keep)),
c AS (SELECT e.id, stored, count(q.id) AS n FROM e LEFT JOIN q ON memory_entity_id = e.id GROUP BY 1, 2)
SELECT 1 AS step, 'same_direction' AS kind, id, keep AS ref_id FROM s1 WHERE id <> keep
UNION ALL SELECT 1, 'second_parent', id, keep FROM raw_relations JOIN mp USING (from_entity_id) WHERE relation_type = 'part_of' AND id <> keep
UNION ALL SELECT 2, 'orphan', id, NULL FROM e WHERE id NOT IN (SELECT memory_entity_id FROM o) AND id NOT IN (SELECT from_entity_id FROM r) AND id NOT IN (SELECT to_entity_id FROM r)
UNION ALL SELECT 2, 'repeated_observation', id, keep FROM s2 WHERE id <> keep UNION ALL SELECT 3, 'counter', id, n FROM c WHERE n <> stored
UNION ALL SELECT DISTINCT 4, 'dangling', id, NULL FROM r WHERE from_entity_id NOT IN (SELECT id FROM e) OR to_entity_id NOT IN (SELECT id FROM e)
UNION ALL SELECT 6, 'active_with_obsoleted_at', id, NULL FROM q WHERE status = 'active' AND obsoleted_at IS NOT NULL
UNION ALL SELECT 6, 'superseded_without_reference', id, NULL FROM q WHERE status = 'superseded' AND superseded_by_id IS NULL
UNION ALL SELECT 6, 'superseded_by_other_entity', q.id, NULL FROM q JOIN q p ON p.id = q.superseded_by_id WHERE p.memory_entity_id <> q.memory_entity_id""")
def _(spark, d):
    e = S.entities(spark, d).where("entity_type IN ('Component', 'Task') AND id % 9 <> 0").withColumn("memory_observations_count", (F.col("id") % 5).cast("int"))
    o = S.observations(spark, d).withColumn("content", F.concat(F.lit("fact "), (F.floor(F.col("id") / 200) % 3).cast("string")))
    return quality.sweep(S.Graph(e, o, S.raw_relations(spark, d)))[1]


# Review rows about customers: moved once or twice, cut off, deleted, moved once more


@query("review_applied", """WITH k AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer),
r AS (SELECT k * 10 AS id, true AS done FROM k WHERE k % 3 = 0 UNION ALL SELECT k * 10 + 1, true FROM k WHERE k % 6 = 0 UNION ALL SELECT k * 10 + 2, k % 3 <> 0 FROM k WHERE k % 5 = 0
  UNION ALL SELECT k * 10 + 3, true FROM k WHERE k % 11 = 0 UNION ALL SELECT k * 10 + 4, false FROM k WHERE k % 22 = 0)
SELECT 'row' AS part, id, NULL::BIGINT AS ref_id, done FROM r
UNION ALL SELECT 'parent', k + 30000000000, 20000000000 + CASE WHEN k % 6 = 0 THEN (n + 2) % 25 WHEN k % 3 = 0 THEN (n + 1) % 25 ELSE n END, NULL FROM k WHERE k % 11 <> 0 AND (k % 3 = 0 OR k % 5 <> 0)""")
def _(spark, d):
    c, k = S.table(spark, d, "customer"), F.col("c_custkey").cast("long")
    field = lambda **f: F.to_json(F.struct(*[v.alias(n) for n, v in f.items()]))
    move = lambda by: field(entity_id=k + 3 * S.KIND, parent_id=(F.col("c_nationkey") + by) % 25 + 2 * S.KIND)
    part = lambda at, kind, payload, every: c.where(k % every == 0).select((k * 10 + at).alias("id"), (k * 10 + at).alias("position"), F.lit(kind).alias("kind"), payload.alias("payload"), F.lit(None).cast("string").alias("edited"))
    # the second move is the first one's payload with an edited parent
    again = part(1, "reparent_entity", move(1), 6).drop("edited").join(c.where(k % 6 == 0).select((k * 10 + 1).alias("id"), field(parent_id=(F.col("c_nationkey") + 2) % 25 + 2 * S.KIND).alias("edited")), "id")
    rows = part(0, "reparent_entity", move(1), 3).unionByName(again).unionByName(part(2, "delete_relation", field(relation_id=k + 2 * S.EDGE), 5))
    rows = rows.unionByName(part(3, "delete_entity", field(entity_id=k + 3 * S.KIND), 11)).unionByName(part(4, "orphan_parent", move(3), 22))
    g = S.graph(spark, d)
    after, told = applying.apply_rows(g, applying.read(rows), 8 * S.EDGE, S.NOW)
    parents = after.relations.where(F.col("from_entity_id").between(3 * S.KIND, 4 * S.KIND - 1) & (F.col("relation_type") == "part_of"))
    return told.select(F.lit("row").alias("part"), "id", F.lit(None).cast("long").alias("ref_id"), "done").unionAll(parents.select(F.lit("parent"), "from_entity_id", "to_entity_id", F.lit(None).cast("boolean")))


# A document for each nation: its customers, with their orders below them


@query("document_nodes", """SELECT n_nationkey AS doc_id, '0' AS node_path, NULL AS parent_path, 0 AS depth, n_name AS name, 'Framework' AS entity_type, 0 AS n_observations, NULL AS relation_type FROM nation
UNION ALL SELECT c_nationkey, '0.children.' || (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1), '0', 1, c_name, 'User', 2, 'part_of' FROM customer
UNION ALL SELECT c_nationkey, '0.children.' || c || '.children.' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1), '0.children.' || c, 2, 'Order#' || o_orderkey, 'Task', 1, NULL FROM orders JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS c FROM customer) ON c_custkey = o_custkey""")
def _(spark, d):
    listed = lambda key, *fields: F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("_k"), F.struct(*fields).alias("s")))), lambda x: x["s"])
    text = lambda x: F.struct(x.alias("content"))
    o = S.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(listed("o_orderkey", F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")).alias("name"), F.lit("Task").alias("entity_type"), F.array(F.col("o_orderpriority")).alias("observations")).alias("children"))
    c = S.table(spark, d, "customer").join(o, "c_custkey", "left")
    c = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(listed("c_custkey", F.col("c_name").alias("name"), F.lit("User").alias("entity_type"), F.lit("part_of").alias("relation_type"), F.array(text(F.col("c_mktsegment")), text(F.col("c_name"))).alias("observations"), "children").alias("children"))
    root = F.struct(F.col("n_name").alias("name"), F.lit("Framework").alias("entity_type"), "children")
    docs = S.table(spark, d, "nation").join(c, "n_nationkey", "left").select(F.col("n_nationkey").alias("doc_id"), F.to_json(F.struct(F.array(root).alias("root_nodes"))).alias("text"))
    rows = exchange.flatten_documents(docs)
    return rows.select("doc_id", "node_path", "parent_path", "depth", "name", "entity_type", F.size("observations").alias("n_observations"), "relation_type")


@query("scope_truncated", views("relations", then="w(id, depth) AS (SELECT 10000000002::BIGINT, 0 UNION SELECT from_entity_id, depth + 1 FROM w JOIN relations ON to_entity_id = w.id AND relation_type = 'part_of')", recursive=True) + ", t AS (SELECT id, min(depth) AS depth FROM w GROUP BY id) SELECT id, depth, truncated FROM (SELECT *, row_number() OVER (ORDER BY depth, id) AS n, count(*) OVER () > 50 AS truncated FROM t) WHERE n <= 50")
def _(spark, d):
    return G.scope(S.relations(spark, d), spark.createDataFrame([(10_000_000_002,)], "id long"), 50)


@query("review_page", "SELECT event_id, event_type = 'error' AS root, value AS score FROM events ORDER BY (event_type = 'error') DESC, value DESC NULLS LAST, event_id LIMIT 20 OFFSET 40")
def _(spark, d):
    rows = S.table(spark, d, "events").select("event_id", (F.col("event_type") == "error").alias("root"), F.col("value").alias("score"), F.col("event_id").alias("position"))
    return review.review_page(rows, 3).select("event_id", "root", "score")


@query("lines_read_back", views("entities", "relations", "observations") + """SELECT 'entity' AS part, name, entity_type AS kind, NULL AS other FROM entities
UNION ALL SELECT DISTINCT 'relation', a.name, relation_type, b.name FROM relations JOIN entities a ON a.id = from_entity_id JOIN entities b ON b.id = to_entity_id
UNION ALL SELECT DISTINCT 'observation', name, NULL, md5(content) FROM observations o JOIN entities e ON e.id = memory_entity_id WHERE content IS NOT NULL""")
def _(spark, d):
    """The whole graph written as JSON Lines and read again."""
    g, at = S.graph(spark, d), _folder(spark, "lines")
    exchange.write_lines(g.entities, g.observations, g.relations, at)
    e, o, r = exchange.read_lines(spark, at)
    none = F.lit(None).cast("string")
    rows = e.select(F.lit("entity").alias("part"), "name", F.col("entity_type").alias("kind"), none.alias("other"))
    return rows.unionAll(r.select(F.lit("relation"), "from_name", "relation_type", "to_name")).unionAll(o.where("content IS NOT NULL").select(F.lit("observation"), "name", none, F.md5("content")))
