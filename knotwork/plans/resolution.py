"""Named queries for traversal, entity resolution, mutation and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.functions import text as T

from knotwork.operators import graph as G
from knotwork.operators import mutate, resolve, review, stats
from knotwork.plans.base import query, views
from knotwork.sources import views as S
from knotwork.streaming.audit import action_counts

_ER = views("entities", "relations")
_R = views("relations")


def ids(spark, *values: int):
    return spark.createDataFrame([(v,) for v in values], "id long")


@query("bfs_expand", views("relations", then="e AS (SELECT from_entity_id AS a, to_entity_id AS b FROM relations UNION ALL SELECT to_entity_id, from_entity_id FROM relations), w(id, depth) AS (SELECT 10000000001::BIGINT, 0 UNION SELECT b, depth + 1 FROM w JOIN e ON a = id WHERE depth < 3)", recursive=True) + "SELECT id, min(depth) AS depth FROM w GROUP BY id")
def _(spark, d):
    return G.expand(S.relations(spark, d), ids(spark, 10_000_000_001), 3, cap=None).select("id", "depth")


@query("bfs_outgoing_typed", views("relations", then="e AS (SELECT from_entity_id AS a, to_entity_id AS b FROM relations WHERE relation_type IN ('part_of', 'depends_on')), w(id, depth) AS (SELECT 60000000007::BIGINT, 0 UNION SELECT b, depth + 1 FROM w JOIN e ON a = id WHERE depth < 5)", recursive=True) + "SELECT id, min(depth) AS depth FROM w GROUP BY id")
def _(spark, d):
    return G.expand(S.relations(spark, d), ids(spark, 60_000_000_007), 5, "outgoing", ["part_of", "depends_on"], cap=None).select("id", "depth")


@query("bfs_capped", views("relations") + ", e AS (SELECT id AS rid, from_entity_id AS a, to_entity_id AS b FROM relations UNION ALL SELECT id, to_entity_id, from_entity_id FROM relations), n AS (SELECT b AS id, min(rid) AS rid FROM e WHERE a = 10000000001 GROUP BY b ORDER BY 2, 1 LIMIT 3) SELECT id, 1 AS depth FROM n UNION ALL SELECT 10000000001, 0")
def _(spark, d):
    return G.expand(S.relations(spark, d), ids(spark, 10_000_000_001), 1, cap=4).select("id", "depth")


@query("bfs_scanned_relations", views("relations") + "SELECT id AS relation_id FROM relations WHERE from_entity_id = 10000000001 OR to_entity_id = 10000000001")
def _(spark, d):
    r = S.relations(spark, d)
    return G.scanned_relations(r, G.expand(r, ids(spark, 10_000_000_001), 1, cap=None), 1)


@query("shortest_path", _R + "SELECT * FROM (SELECT 0 AS position, 60000000007::BIGINT AS id, -1::BIGINT AS relation_id UNION ALL SELECT 1, to_entity_id, id FROM relations WHERE from_entity_id = 60000000007 AND relation_type = 'part_of' UNION ALL SELECT 2, b.to_entity_id, b.id FROM relations a JOIN relations b ON a.to_entity_id = b.from_entity_id AND b.relation_type = 'part_of' WHERE a.from_entity_id = 60000000007 AND a.relation_type = 'part_of')")
def _(spark, d):
    r = S.relations(spark, d)
    up = r.where("relation_type = 'part_of'").select("from_entity_id", "to_entity_id")
    middle = up.where("from_entity_id = 60000000007").select(F.col("to_entity_id").alias("from_entity_id"))
    target = up.join(middle, "from_entity_id").select("to_entity_id").first().to_entity_id
    return G.shortest_path(r, 60_000_000_007, target, 5, "outgoing", ["part_of"]).fillna(-1)


@query("project_subtree", views("relations", then="w(id, depth) AS (SELECT 10000000002::BIGINT, 0 UNION SELECT from_entity_id, depth + 1 FROM w JOIN relations ON to_entity_id = w.id AND relation_type = 'part_of')", recursive=True) + "SELECT id, min(depth) AS depth FROM w GROUP BY id")
def _(spark, d):
    return G.project_subtree(S.relations(spark, d), ids(spark, 10_000_000_002), cap=None)


@query("ancestor_projects", views("entities", "relations", then="p AS (SELECT from_entity_id AS id, min(to_entity_id) AS parent FROM relations WHERE relation_type = 'part_of' GROUP BY 1), w(id, pos) AS (SELECT id, id FROM entities UNION SELECT w.id, p.parent FROM w JOIN p ON p.id = w.pos WHERE w.pos >= 20000000000)", recursive=True) + "SELECT w.id, pos AS project_id FROM w JOIN entities e ON e.id = pos WHERE e.entity_type = 'Project'")
def _(spark, d):
    return G.ancestor_projects(S.entities(spark, d), S.relations(spark, d))


@query("types_around_projects", views("entities", "relations", then="p AS (SELECT from_entity_id AS id, min(to_entity_id) AS parent FROM relations WHERE relation_type = 'part_of' GROUP BY 1), w(id, pos) AS (SELECT id, id FROM entities UNION SELECT w.id, p.parent FROM w JOIN p ON p.id = w.pos WHERE w.pos >= 20000000000)", recursive=True) + "SELECT pos AS project_id, e.entity_type, count(*) AS n FROM w JOIN entities e ON e.id = w.id WHERE pos < 20000000000 AND w.id <> pos GROUP BY 1, 2")
def _(spark, d):
    return stats.types_around_projects(S.entities(spark, d), S.relations(spark, d))


@query("walk_order", views("entities", "relations", then="w(id, depth) AS (SELECT id, 0 FROM entities WHERE entity_type = 'Project' UNION SELECT from_entity_id, depth + 1 FROM w JOIN relations ON to_entity_id = w.id AND relation_type = 'part_of')", recursive=True) + ", t AS (SELECT id, min(depth) AS depth FROM w GROUP BY id) SELECT *, row_number() OVER (ORDER BY part, depth, id) AS position FROM (SELECT id, 0 AS part, depth FROM t UNION ALL SELECT id, 1, 0 FROM entities WHERE entity_type <> 'Project' AND id NOT IN (SELECT id FROM t))")
def _(spark, d):
    return G.walk_order(S.entities(spark, d), S.relations(spark, d))


@query("export_tree_paths", views("entities", "relations", then="edges AS (SELECT DISTINCT to_entity_id AS a, from_entity_id AS b, 'incoming' AS direction FROM relations WHERE relation_type IN ('part_of', 'depends_on') UNION SELECT DISTINCT from_entity_id, to_entity_id, 'outgoing' FROM relations WHERE relation_type NOT IN ('part_of', 'depends_on')), w(id, path, depth, direction) AS (SELECT 10000000003::BIGINT, [10000000003::BIGINT], 0, NULL::VARCHAR UNION ALL SELECT b, list_append(path, b), depth + 1, e.direction FROM w JOIN edges e ON a = w.id WHERE depth < 2 AND NOT list_contains(path, b) AND w.id NOT IN (10000000000, 10000000001, 10000000002, 10000000004))", recursive=True) + "SELECT id, array_to_string(path, '/') AS path, depth, direction FROM w")
def _(spark, d):
    rows = G.export_paths(S.entities(spark, d), S.relations(spark, d), ids(spark, 10_000_000_003), 2)
    return rows.select("id", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "depth", "direction")


_PAIRS = """v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
pairs AS (SELECT a.id AS a, b.id AS b, 1 - list_cosine_similarity(a.v, b.v) AS distance FROM v a JOIN v b ON a.label = b.label AND a.id < b.id)"""


@query("suggest_merges", f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS n FROM pairs WHERE distance < 0.75) SELECT a, b, round(distance, 6) AS distance, distance < 0.6 AS high_confidence FROM r WHERE n <= 3 AND NOT ((b - a) % 5 = 0 AND b - a <= 50) ORDER BY a, r.distance, b LIMIT 50")
def _(spark, d):
    v = S.vectors(spark, d)
    steps = F.explode(F.sequence(F.lit(5), F.lit(50), F.lit(5)))  # decided pairs: ids that differ by multiples of 5 up to 50
    suppressed = v.select(F.col("id").alias("a"), steps.alias("step")).select("a", (F.col("a") + F.col("step")).alias("b"))
    return resolve.suggest_merges(v, 0.75, 50, suppressed, 0.6).select("a", "b", F.round("distance", 6).alias("distance"), "high_confidence")


@query("top_neighbours", f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS n FROM pairs WHERE distance < 0.85) SELECT a, b, round(distance, 6) AS distance FROM r WHERE n <= 3")
def _(spark, d):
    return resolve.suggest_merges(S.vectors(spark, d), 0.85, None).select("a", "b", F.round("distance", 6).alias("distance"))


@query("merge_evidence", f"""WITH {_PAIRS}, e AS (SELECT vec_id AS id, 'v' || vec_id % 50 AS name, 'v' || vec_id % 20 || ', x' AS aliases FROM embeddings),
n9 AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS n FROM pairs WHERE distance < 0.85),
facts AS (SELECT DISTINCT doc_id AS id, text FROM documents),
s AS (SELECT p.a, p.b, distance, (CASE WHEN distance < 0.7 THEN 8 ELSE 4 END + CASE WHEN x.name = y.name THEN 8 WHEN true THEN 5 ELSE 0 END + least(2 * CASE WHEN fa.text = fb.text THEN 1 ELSE 0 END, 6)) AS score
 FROM n9 p JOIN e x ON x.id = a JOIN e y ON y.id = b LEFT JOIN facts fa ON fa.id = a LEFT JOIN facts fb ON fb.id = b WHERE n <= 9),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, distance, b) AS n FROM s WHERE score >= 4)
SELECT a, b, round(distance, 6) AS distance, score::INT AS score, CASE WHEN 10 * greatest(a % 7, 1) * (SELECT count(*) FROM facts WHERE id = a) + (SELECT count(*) FROM events WHERE user_id = a) > 10 * greatest(b % 7, 1) * (SELECT count(*) FROM facts WHERE id = b) + (SELECT count(*) FROM events WHERE user_id = b) THEN a ELSE b END AS survivor, CASE WHEN distance < 0.7 AND score >= 10 THEN 'merge' ELSE 'review' END AS decision FROM r WHERE n <= 3""")
def _(spark, d):
    v = S.vectors(spark, d).withColumn("aliases", F.concat(F.lit("v"), (F.col("id") % 20).cast("string"), F.lit(", x")))
    # each vector's entity has its document and so many older facts that all differ by weight
    copies = F.explode(F.expr("CASE WHEN doc_id % 7 = 0 THEN array(-1) ELSE sequence(0, CAST(doc_id % 7 AS INT) - 1) END"))
    facts = S.table(spark, d, "documents").select(F.col("doc_id").alias("memory_entity_id"), F.col("text"), copies.alias("k"))
    o = facts.select(F.col("memory_entity_id").alias("id"), "memory_entity_id", F.when(F.col("k") <= 0, F.col("text")).otherwise(F.concat(F.lit("fact "), (F.col("memory_entity_id") * 10 + F.col("k")).cast("string"))).alias("content"), F.lit("active").alias("status"))
    edges = S.table(spark, d, "events").select(F.col("user_id").alias("from_entity_id"), F.lit(-1).cast("long").alias("to_entity_id"))
    rows = resolve.merge_evidence(v, o, edges, 0.85, 3, 0.7)
    return rows.withColumn("distance", F.round("distance", 6))


_NEG = " OR ".join(f"list_contains(w, '{m}')" for m in T.NEGATIVE)


@query("contradictions", views("observations", "relations") + f""", g AS (SELECT from_entity_id AS e, to_entity_id AS m FROM relations UNION SELECT to_entity_id, from_entity_id FROM relations UNION SELECT memory_entity_id, memory_entity_id FROM observations),
o AS (SELECT id, memory_entity_id AS m, embedding::DOUBLE[] AS v, string_split_regex(lower(content), '[^a-z0-9_'']+') AS w FROM observations WHERE status = 'active' AND embedding IS NOT NULL),
n AS (SELECT e, id, v, ({_NEG}) AS neg FROM g JOIN o USING (m)),
p AS (SELECT x.e, x.id AS a, y.id AS b, 1 - list_cosine_similarity(x.v, y.v) AS distance, x.neg AS na, y.neg AS nb FROM n x JOIN n y ON x.e = y.e AND x.id <> y.id),
r AS (SELECT *, row_number() OVER (PARTITION BY e, a ORDER BY distance, b) AS n FROM p WHERE distance < 0.9),
k AS (SELECT e AS entity_id, least(a, b) AS observation_id_1, greatest(a, b) AS observation_id_2, min(distance) AS distance FROM r WHERE n <= 20 AND na <> nb GROUP BY 1, 2, 3),
c AS (SELECT *, round(least((1 - k.distance) * 1.1, 0.99), 4) AS confidence FROM k)
SELECT entity_id, observation_id_1, observation_id_2, round(distance, 6) AS distance, confidence FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, observation_id_1, observation_id_2) AS n FROM c) WHERE n <= 20""")
def _(spark, d):
    """For all entities; contents are judged before they meet their vectors, so that no text is shuffled."""
    o = S.observations(spark, d).select("id", "memory_entity_id", "status", T.negative(F.col("content")).alias("negative"))
    v = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return resolve.contradictions(o.join(v, "id"), S.relations(spark, d), None, 0.9, 20)


_PLAIN = "regexp_replace(lower({c}), '[^\\p{{L}}\\p{{Nd}}\\s]+', ' ', 'g')"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_TOK = "list_filter(list_distinct(list_filter(string_split_regex(" + _PLAIN + ", '\\s+'), lambda w: length(w) >= 2)), lambda w: NOT list_contains(" + _STOP + ", w))"


@query("orphan_project_match", views("entities", "observations") + f""", f AS (SELECT memory_entity_id AS id, string_agg(content, ' ' ORDER BY id) AS facts FROM (SELECT *, row_number() OVER (PARTITION BY memory_entity_id ORDER BY id) AS n FROM observations WHERE status = 'active') x(id, memory_entity_id, content, confidence, source, status, valid_from, valid_until, created_at, tag, embedding, obsoleted_at, superseded_by_id, n) WHERE n <= 5 GROUP BY 1),
o AS (SELECT e.id, {_TOK.format(c="concat_ws(' ', name, entity_type, description, facts)")} AS ts FROM entities e LEFT JOIN f USING (id) WHERE entity_type = 'Component'),
t AS (SELECT id, unnest(ts) AS t FROM o), u AS (SELECT DISTINCT t FROM t),
p AS (SELECT id AS project_id, lower(name) AS pn, {_TOK.format(c='name')} AS pt, lower(coalesce(aliases, '')) AS pa, {_TOK.format(c="coalesce(aliases, '')")} AS pat FROM entities WHERE entity_type = 'User'),
q AS (SELECT t, project_id, CASE WHEN list_contains(pt, t) THEN 10 WHEN contains(pn, t) THEN 5 WHEN list_contains(pat, t) THEN 8 ELSE 3 END AS points FROM u JOIN p ON contains(pn, t) OR contains(pa, t)),
s AS (SELECT t.id, project_id, sum(points) AS score FROM t JOIN q USING (t) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, project_id) AS n, lead(score) OVER (PARTITION BY id ORDER BY score DESC, project_id) AS next FROM s)
SELECT id, project_id, score::BIGINT AS score, score >= 10 AND (next IS NULL OR score - next >= 3) AS auto FROM r WHERE n = 1""")
def _(spark, d):
    e = S.entities(spark, d)
    orphans, projects = e.where("entity_type = 'Component'"), e.where("entity_type = 'User'")
    return resolve.auto_parents(resolve.best_matches(orphans, projects, S.observations(spark, d)))


@query("shared_observation_links", views("observations", "entities") + ", f AS (SELECT DISTINCT memory_entity_id AS id, content FROM observations WHERE status = 'active' AND length(content) >= 15 AND memory_entity_id IN (SELECT id FROM entities WHERE entity_type <> 'Project')), p AS (SELECT DISTINCT a.id AS from_id, b.id AS to_id FROM f a JOIN f b ON a.content = b.content AND a.id < b.id), r AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY to_id) AS n FROM p) SELECT from_id, to_id FROM r WHERE n <= 3")
def _(spark, d):
    return resolve.shared_observation_links(S.observations(spark, d), S.entities(spark, d))


def _marks(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + ")"


@query("issue_solution_links", views("observations") + f""", n AS (SELECT id, content || CASE WHEN id % 3 = 0 THEN ' fix' ELSE ' issue' END AS content FROM observations),
a AS (SELECT id AS solution_id, unnest({_TOK.format(c='content')}) AS t FROM n WHERE id % 3 = 0 AND {_marks(T.SOLUTION)}), b AS (SELECT id AS issue_id, unnest({_TOK.format(c='content')}) AS t FROM n WHERE id % 3 <> 0 AND {_marks(T.ISSUE)}),
p AS (SELECT solution_id, issue_id, count(*) AS shared FROM a JOIN b USING (t) GROUP BY 1, 2 HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY solution_id ORDER BY shared DESC, issue_id) AS n FROM p)
SELECT solution_id, issue_id, shared * 3 + 5 AS score, shared * 3 + 5 >= 14 AS high FROM r WHERE n <= 3""")
def _(spark, d):
    o = S.observations(spark, d).select("id", F.concat("content", F.when(F.col("id") % 3 == 0, " fix").otherwise(" issue")).alias("content"))
    return resolve.issue_solution_links(o.where("id % 3 <> 0"), o.where("id % 3 = 0"))


@query("dependency_links", views("entities") + """, n AS (SELECT id AS to_id, unnest(list_distinct(list_filter(list_concat(list_transform(string_split_regex(name, '[,|;]'), lambda x: trim(x)), list_transform(string_split_regex(coalesce(aliases, ''), '[,|;]'), lambda x: trim(x))), lambda x: length(x) >= 3))) AS n FROM entities WHERE entity_type NOT IN ('Project', 'Task', 'User')),
c AS (SELECT DISTINCT o_orderkey % 500 + 60000000000 AS from_id, lower(o_orderpriority || ' depends on ' || n_name || ' and Brand#' || o_orderkey % 30) AS c FROM orders JOIN nation ON n_nationkey = o_orderkey % 25),
k AS (SELECT DISTINCT c FROM c), m AS (SELECT DISTINCT lower(n) AS n FROM n), x AS (SELECT c, n FROM k JOIN m ON contains(c, n))
SELECT DISTINCT from_id, to_id FROM c JOIN x USING (c) JOIN n ON lower(n.n) = x.n""")
def _(spark, d):
    n = S.table(spark, d, "nation").select("n_nationkey", "n_name")
    o = S.table(spark, d, "orders").withColumn("n_nationkey", (F.col("o_orderkey") % 25).cast("int")).join(n, "n_nationkey")
    content = F.concat("o_orderpriority", F.lit(" depends on "), "n_name", F.lit(" and Brand#"), (F.col("o_orderkey") % 30).cast("string"))
    facts = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 500 + 6 * S.KIND).alias("memory_entity_id"), content.alias("content"), F.lit("active").alias("status"))
    return resolve.dependency_links(facts, S.entities(spark, d).where("entity_type NOT IN ('Task', 'User')"))


@query("top_proposals", _R + ", p AS (SELECT l_partkey + 50000000000 AS from_id, l_suppkey + 40000000000 AS to_id, 'relates_to' AS relation_type, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2), f AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.from_entity_id = p.from_id AND r.to_entity_id = p.to_id AND r.relation_type = p.relation_type)), r AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY score DESC, to_id) AS n FROM f WHERE (from_id + to_id) % 7 <> 0) SELECT from_id, to_id, relation_type, score FROM r WHERE n <= 3")
def _(spark, d):
    p = S.table(spark, d, "lineitem").select((F.col("l_partkey") + 5 * S.KIND).alias("from_id"), (F.col("l_suppkey") + 4 * S.KIND).alias("to_id"), F.lit("relates_to").alias("relation_type"), F.col("l_quantity").alias("score"))
    return resolve.top_proposals(p, S.relations(spark, d), p.where("(from_id + to_id) % 7 = 0"))


@query("evidence_diverse_topk", views("observations") + ", r AS (SELECT id, memory_entity_id, row_number() OVER (ORDER BY coalesce(confidence, 0) DESC, id) AS position FROM observations), k AS (SELECT *, row_number() OVER (PARTITION BY memory_entity_id % 6 ORDER BY position) AS n FROM r) SELECT id, memory_entity_id % 6 AS memory_entity_id FROM k WHERE n <= 3 ORDER BY position LIMIT 20")
def _(spark, d):
    o = S.observations(spark, d).select("id", (F.col("memory_entity_id") % 6).alias("memory_entity_id"), F.coalesce("confidence", F.lit(0.0)).alias("c"))
    return resolve.diverse_evidence(o, F.desc("c"), F.asc("id")).select("id", "memory_entity_id")


@query("import_fresh_contents", views("observations") + "SELECT doc_id % 200 + 50000000000 AS memory_entity_id, text AS content FROM documents d WHERE NOT EXISTS (SELECT 1 FROM observations o WHERE o.status = 'active' AND o.memory_entity_id = d.doc_id % 200 + 50000000000 AND o.content = d.text)")
def _(spark, d):
    new = S.table(spark, d, "documents").select((F.col("doc_id") % S.SUBJECTS + 5 * S.KIND).alias("memory_entity_id"), F.col("text").alias("content"))
    return resolve.fresh_contents(new, S.observations(spark, d))


_MERGE = """pairs AS (SELECT l_partkey AS k FROM (SELECT DISTINCT p_partkey AS l_partkey FROM part) WHERE l_partkey % 10 = 1),
m AS (SELECT id, from_entity_id AS f0, to_entity_id AS t0, relation_type, CASE WHEN from_entity_id BETWEEN 50000000000 AND 59999999999 AND from_entity_id % 10 = 1 THEN from_entity_id - 1 ELSE from_entity_id END AS f, CASE WHEN to_entity_id BETWEEN 50000000000 AND 59999999999 AND to_entity_id % 10 = 1 THEN to_entity_id - 1 ELSE to_entity_id END AS t FROM relations),
r AS (SELECT *, row_number() OVER (PARTITION BY f, t, relation_type ORDER BY (f <> f0 OR t <> t0), id) AS n FROM m WHERE f <> t)"""


def _merged(spark, d):
    pairs = S.table(spark, d, "part").where("p_partkey % 10 = 1").select((F.col("p_partkey") + 5 * S.KIND).alias("source"), (F.col("p_partkey") - 1 + 5 * S.KIND).alias("target"))
    return mutate.merge(S.graph(spark, d), pairs)


@query("merge_remap", _R[:-1] + f", {_MERGE} SELECT id, f AS from_entity_id, t AS to_entity_id FROM r WHERE n = 1")
def _(spark, d):
    return _merged(spark, d).relations.select("id", "from_entity_id", "to_entity_id")


@query("merge_aliases", views("entities") + """, s AS (SELECT id - 1 AS id, aliases AS a2, name AS n2 FROM entities WHERE entity_type = 'Component' AND id % 10 = 1)
SELECT e.id, CASE WHEN s.id IS NULL THEN aliases ELSE array_to_string(list_distinct_ordered, ', ') END AS aliases FROM (SELECT e.*, CASE WHEN s.id IS NOT NULL THEN list_filter(list_concat(string_split(e.aliases, ','), list_filter(list_concat(string_split(a2, ','), [n2]), lambda x: NOT list_contains(string_split(e.aliases, ','), x))), lambda x: lower(x) <> lower(e.name)) END AS list_distinct_ordered FROM entities e LEFT JOIN s USING (id)) e LEFT JOIN s USING (id) WHERE NOT (entity_type = 'Component' AND e.id % 10 = 1)""")
def _(spark, d):
    return _merged(spark, d).entities.select("id", "aliases")


@query("delete_cascade", views("relations", "entities", then="w(id) AS (SELECT 20000000003::BIGINT UNION SELECT from_entity_id FROM w JOIN relations ON to_entity_id = w.id AND relation_type = 'part_of')", recursive=True) + "SELECT id FROM relations WHERE from_entity_id NOT IN (SELECT id FROM w) AND to_entity_id NOT IN (SELECT id FROM w)")
def _(spark, d):
    return mutate.delete_nodes(S.graph(spark, d), ids(spark, 20_000_000_003), cascade=True).relations.select("id")


@query("move_to_parent", _R + "SELECT id, from_entity_id, to_entity_id FROM relations WHERE NOT (from_entity_id = 30000000001 AND relation_type = 'part_of') UNION ALL SELECT 99, 30000000001, 20000000009")
def _(spark, d):
    return mutate.move_to_parent(S.graph(spark, d), 30_000_000_001, 20_000_000_009, 99).relations.select("id", "from_entity_id", "to_entity_id")


@query("mark_obsolete", views("observations") + "SELECT id, CASE WHEN status = 'active' AND id % 9 = 0 THEN 'obsolete' ELSE status END AS status FROM observations")
def _(spark, d):
    o = S.observations(spark, d)
    return mutate.mark_obsolete(o, o.where("id % 9 = 0").select("id"), S.NOW, "old").select("id", "status")


@query("supersede", views("observations") + "SELECT id, CASE WHEN status = 'active' AND id % 9 = 0 THEN 'superseded' ELSE status END AS status, CASE WHEN status = 'active' AND id % 9 = 0 THEN id + 1000000 ELSE coalesce(superseded_by_id, -1) END AS superseded_by_id FROM observations UNION ALL SELECT id + 1000000, 'active', -1 FROM observations WHERE status = 'active' AND id % 9 = 0")
def _(spark, d):
    o = S.observations(spark, d)
    new = o.where("id % 9 = 0").select(F.col("id").alias("old_id"), (F.col("id") + 1_000_000).alias("id"), F.lit("new").alias("content"))
    return mutate.supersede(o, new, S.NOW).select("id", "status", "superseded_by_id").fillna(-1)


_KINDS = "entity_merge relationship_proposal entity_error orphan_parent embedding_backfill_failed lifecycle_corruption relation_integrity delete_relation delete_observation delete_entity dismiss_compaction_review move_observation reparent_entity".split()


@query("review_signatures", f"""WITH e AS (SELECT event_id AS i, user_id AS u, event_type AS t, [{', '.join(repr(k) for k in _KINDS)}][event_id % 13 + 1] AS kind FROM events WHERE event_id <> user_id)
SELECT i AS id, CASE kind WHEN 'entity_merge' THEN kind || '|' || least(i, u) || '-' || greatest(i, u) WHEN 'relationship_proposal' THEN kind || '|' || i || '|' || u || '|' || t WHEN 'entity_error' THEN kind || '|' || i || '|' || t
WHEN 'relation_integrity' THEN CASE WHEN i % 5 <> 0 THEN kind || '|' || t || '|' || i || '|' || u END WHEN 'move_observation' THEN kind || '|' || i || '|' || u WHEN 'reparent_entity' THEN kind || '|' || i || '|' || u ELSE kind || '|' || i END AS signature FROM e""")
def _(spark, d):
    c, k = F.col, F.col("event_id") % 13
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k + 1).cast("int"))
    i, u, t = c("event_id"), c("user_id"), c("event_type")
    inner = F.struct(F.when(i % 5 != 0, t).alias("kind"), i.alias("keep_id"), u.alias("delete_id"), i.alias("relation_id"), i.alias("review_item_id"))
    payload = F.to_json(F.struct(i.alias("source_id"), u.alias("target_id"), i.alias("entity_id"), i.alias("from_id"), u.alias("to_id"), t.alias("relation_type"), t.alias("phase"), i.alias("observation_id"), u.alias("parent_id"), inner.alias("payload")))
    return S.table(spark, d, "events").where("event_id <> user_id").select(i.alias("id"), review.signature(kind, payload).alias("signature"))


@query("review_seed", "WITH i AS (SELECT user_id, min(event_id) AS position FROM events GROUP BY 1) SELECT position, 'orphan_parent|' || user_id AS signature FROM i WHERE user_id % 5 <> 0 AND user_id % 7 <> 0")
def _(spark, d):
    e = S.table(spark, d, "events")
    items = e.select(F.col("event_id").alias("position"), F.lit("orphan_parent").alias("kind"), F.to_json(F.struct(F.col("user_id").alias("entity_id"))).alias("payload"))
    sig = lambda m: e.where(f"user_id % {m} = 0").select(F.concat(F.lit("orphan_parent|"), F.col("user_id").cast("string")).alias("signature")).distinct()
    return review.seeded(items, sig(5), sig(7).withColumn("status", F.lit("active"))).select("position", "signature")


@query("review_order", "SELECT event_id FROM events ORDER BY (event_type = 'error') DESC, value DESC NULLS LAST, event_id LIMIT 50")
def _(spark, d):
    rows = S.table(spark, d, "events").select("event_id", (F.col("event_type") == "error").alias("root"), F.col("value").alias("score"), F.col("event_id").alias("position"))
    return review.in_review_order(rows).limit(50).select("event_id")


@query("review_status_counts", "SELECT CASE event_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'active' ELSE 'ignored' END AS status, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    k = F.col("event_id") % 3
    rows = S.table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(k == 2, "ignored").otherwise("active").alias("status"))
    return review.status_counts(review.moved(rows, rows.where("id % 3 = 0"), "apply"))


@query("review_edited_payload", "SELECT event_id AS id, CAST(CASE WHEN event_id % 2 = 0 THEN event_id ELSE json_extract(props, '$.k') END AS VARCHAR) AS k, CASE WHEN event_id % 2 = 0 THEN 'y' END AS x FROM events")
def _(spark, d):
    edited = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("event_id").cast("string").alias("k"), F.lit("y").alias("x"))))
    m = review.effective_payload(F.col("props"), edited)
    return S.table(spark, d, "events").select(F.col("event_id").alias("id"), F.try_element_at(m, F.lit("k")).alias("k"), F.try_element_at(m, F.lit("x")).alias("x"))


@query("review_retention", "SELECT event_id AS id FROM events WHERE event_id % 2 = 0 AND ts < TIMESTAMP '2024-01-30' - INTERVAL 10 DAY")
def _(spark, d):
    rows = S.table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "approved").otherwise("active").alias("status"), F.col("ts").alias("updated_at"))
    return review.resolved_before(rows, "2024-01-30", 10).select("id")


@query("action_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def _(spark, d):
    return action_counts(S.table(spark, d, "events"))


@query("entity_card", views("entities", "relations", "degree", "observations") + ", o AS (SELECT memory_entity_id AS id, count(*) AS n_observations, count(*) FILTER (status = 'active') AS n_active FROM observations GROUP BY 1), i AS (SELECT to_entity_id AS id, count(*) AS n_in FROM relations GROUP BY 1), u AS (SELECT from_entity_id AS id, count(*) AS n_out FROM relations GROUP BY 1) SELECT e.id, e.name, coalesce(n_observations, 0) AS n_observations, coalesce(n_active, 0) AS n_active, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM entities e LEFT JOIN o USING (id) LEFT JOIN i USING (id) LEFT JOIN u USING (id) WHERE entity_type = 'Component'")
def _(spark, d):
    g = S.graph(spark, d)
    o = g.observations.groupBy(F.col("memory_entity_id").alias("id")).agg(F.count("*").alias("n_observations"), F.count_if(F.col("status") == "active").alias("n_active"))
    i = g.relations.groupBy(F.col("to_entity_id").alias("id")).agg(F.count("*").alias("n_in"))
    u = g.relations.groupBy(F.col("from_entity_id").alias("id")).agg(F.count("*").alias("n_out"))
    rows = g.entities.where("entity_type = 'Component'").select("id", "name")
    for part in (o, i, u):
        rows = rows.join(part, "id", "left")
    return rows.fillna(0)


@query("review_counts_of_kind", "SELECT CASE event_id % 3 WHEN 0 THEN 'approved' ELSE 'active' END AS status, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def _(spark, d):
    rows = S.table(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, "approved").otherwise("active").alias("status"), F.col("event_type").alias("kind"))
    return review.status_counts(rows, kind="error")


@query("nested_paths", views("relations", then="n AS (SELECT 10000000003::BIGINT AS id UNION SELECT from_entity_id FROM relations WHERE to_entity_id = 10000000003), m AS (SELECT id FROM n UNION SELECT to_entity_id FROM relations WHERE from_entity_id IN (SELECT id FROM n) UNION SELECT from_entity_id FROM relations WHERE to_entity_id IN (SELECT id FROM n)), i AS (SELECT * FROM relations WHERE from_entity_id IN (SELECT id FROM m) AND to_entity_id IN (SELECT id FROM m)), e AS (SELECT id, from_entity_id AS a, to_entity_id AS b, 'outgoing' AS d FROM i UNION ALL SELECT id, to_entity_id, from_entity_id, 'incoming' FROM i), w(root, path, id, relation_id, direction, depth) AS (SELECT 10000000003::BIGINT, [10000000003::BIGINT], 10000000003::BIGINT, NULL::BIGINT, NULL::VARCHAR, 0 UNION ALL SELECT root, list_append(path, b), b, e.id, d, depth + 1 FROM w JOIN e ON a = w.id WHERE depth < 2 AND NOT list_contains(path, b))", recursive=True) + "SELECT root, array_to_string(path, '/') AS path, id, coalesce(relation_id, -1) AS relation_id, coalesce(direction, '') AS direction, depth FROM w")
def _(spark, d):
    rows = G.nested_paths(S.relations(spark, d), ids(spark, 10_000_000_003), 2, cap=None)
    return rows.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/")).fillna({"relation_id": -1, "direction": ""})


@query("remapped", _R + "SELECT id, CASE WHEN from_entity_id BETWEEN 50000000000 AND 59999999999 AND from_entity_id % 10 = 1 THEN from_entity_id - 1 ELSE from_entity_id END AS from_entity_id, CASE WHEN to_entity_id BETWEEN 50000000000 AND 59999999999 AND to_entity_id % 10 = 1 THEN to_entity_id - 1 ELSE to_entity_id END AS to_entity_id FROM relations")
def _(spark, d):
    pairs = S.table(spark, d, "part").where("p_partkey % 10 = 1").select((F.col("p_partkey") + 5 * S.KIND).alias("source"), (F.col("p_partkey") - 1 + 5 * S.KIND).alias("target"))
    return mutate.remapped(S.graph(spark, d), pairs).relations.select("id", "from_entity_id", "to_entity_id")


@query("similar_before_creation", "WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.id, b.id AS similar_id, 1 - list_cosine_similarity(a.v, b.v) AS distance FROM v a JOIN v b ON a.label = b.label AND a.id % 10 = 3 AND b.id % 10 <> 3), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, similar_id) AS n FROM p WHERE distance < 0.75) SELECT id, similar_id, round(distance, 6) AS distance FROM r WHERE n = 1")
def _(spark, d):
    v = S.vectors(spark, d)
    return resolve.similar_before_creation(v.where("id % 10 = 3"), v.where("id % 10 <> 3"), 0.75).withColumn("distance", F.round("distance", 6))
