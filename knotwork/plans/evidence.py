"""Named queries for pages of entities, evidence, imports and project checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.operators import evidence, imports, projects, quality, scan, search, stats
from knotwork.plans.base import query, views
from knotwork.plans.queries import _BOOST, _Q, _TEXT, _TOK, _TRUST, _WEIGHT, query_vector
from knotwork.plans.resolution import _NEG, ids
from knotwork.sources import views as S
from knotwork.sources.shared import kept

_ALL = views("entities", "relations", "degree", "observations")[:-1]


def _page(wanted: str, limit: str, edges: str) -> str:
    """Rows of the entities, of their active observations by trust, and of some edges."""
    return f"""SELECT id AS entity_id, 'entity' AS part, 0 AS position, id AS ref_id, entity_type AS kind, name AS label FROM entities WHERE id IN ({wanted})
UNION ALL SELECT memory_entity_id, 'observation', n, id, status, content FROM rk WHERE n <= {limit}
UNION ALL {edges}"""


_RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY memory_entity_id ORDER BY trust_score DESC, coalesce(confidence, 0) DESC, id) AS n, count(*) OVER (PARTITION BY memory_entity_id) AS n_all FROM trust WHERE status = 'active' AND memory_entity_id IN ({wanted}))"


@query("entity_details", _ALL + f", {_TRUST}, {_RANKED.format(wanted='50000000005, 50000000007')} " + _page("50000000005, 50000000007", "2", """SELECT memory_entity_id, 'truncated', 0, n_all, NULL, NULL FROM rk WHERE n = 1 AND n_all > 2
UNION ALL SELECT from_entity_id, 'relation_from', 0, r.id, relation_type, e.name FROM relations r LEFT JOIN entities e ON e.id = to_entity_id WHERE from_entity_id IN (50000000005, 50000000007)
UNION ALL SELECT to_entity_id, 'relation_to', 0, r.id, relation_type, e.name FROM relations r LEFT JOIN entities e ON e.id = from_entity_id WHERE to_entity_id IN (50000000005, 50000000007)"""))
def _(spark, d):
    g = S.graph(spark, d)
    return evidence.entity_details(ids(spark, 50_000_000_005, 50_000_000_007), g.entities, g.observations, g.relations, S.NOW, limit=2)


_SOME = "50000000003, 50000000005, 40000000001, 60000000010, 30000000002, 20000000003, 99"
_INSIDE = "SELECT from_entity_id, 'relation', 0, id, relation_type, CAST(to_entity_id AS VARCHAR) FROM relations WHERE from_entity_id IN ({wanted}) AND to_entity_id IN ({wanted})"


@query("subgraph_by_ids", _ALL + f", {_TRUST}, {_RANKED.format(wanted=_SOME)} " + _page(_SOME, "2", _INSIDE.format(wanted=_SOME) + f" UNION ALL SELECT id, 'missing', 0, id, NULL, NULL FROM (SELECT unnest([{_SOME}]) AS id) WHERE id NOT IN (SELECT id FROM entities)"))
def _(spark, d):
    g = S.graph(spark, d)
    some = ids(spark, *[int(x) for x in _SOME.split(", ")], 99)
    return evidence.subgraph(some, g.entities, g.observations, g.relations, S.NOW, limit=2)


@query("subgraph_page_contents", _ALL + f""", {_TRUST}, near AS (SELECT vec_id + 50000000000 AS id FROM embeddings WHERE 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}) < 0.85 ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}), vec_id LIMIT 20),
c AS (SELECT id FROM entities WHERE lower(coalesce(name, '')) LIKE '%mint%' OR lower(coalesce(aliases, '')) LIKE '%mint%' OR lower(entity_type) LIKE '%mint%' UNION SELECT memory_entity_id FROM observations WHERE status = 'active' AND lower(content) LIKE '%mint%' UNION SELECT id FROM near),
s AS (SELECT e.id, round(greatest({_BOOST.format(q='mint')}, 0.01) * {_WEIGHT} + CASE WHEN degree > 0 THEN log2(1 + degree) * 0.003 ELSE 0 END, 6) AS score FROM c JOIN entities e USING (id) LEFT JOIN degree USING (id)),
p AS (SELECT id FROM s ORDER BY score DESC, id LIMIT 10), {_RANKED.format(wanted='SELECT id FROM p')} """ + _page("SELECT id FROM p", "1000000", _INSIDE.format(wanted="SELECT id FROM p")))
def _(spark, d):
    g = S.graph(spark, d)
    near = search.vector_search(S.vectors(spark, d), query_vector(spark, d), 20).select((F.col("id") + 5 * S.KIND).alias("id"))
    found = search.subgraph_candidates(g.entities, g.observations, "mint").unionAll(near).distinct()
    page = search.page(search.rank_entity_ids(found, g.entities, g.relations, "mint"), 1, 10, F.desc("score"), F.asc("id"))
    return evidence.subgraph(kept(page.select("id")), g.entities, g.observations, g.relations, S.NOW)


_LISTS = f"""{_TEXT},
tl AS (SELECT * FROM scored WHERE score >= 1 ORDER BY score DESC, lower(entity_type), lower(name), id LIMIT {{n}}),
tr AS (SELECT id, (1 + score / greatest(max(score) OVER (), 1)) / (60 + row_number() OVER (ORDER BY score DESC, lower(entity_type), lower(name), id)) AS part, 'text' AS source FROM tl),
o AS (SELECT memory_entity_id AS id, min(1 - list_cosine_similarity(embedding::DOUBLE[], {_Q})) AS distance FROM observations WHERE status = 'active' AND embedding IS NOT NULL GROUP BY 1 ORDER BY 2, 1 LIMIT {{n}}),
orr AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY distance, id)) AS part, 'observation' AS source FROM o),
v AS (SELECT vec_id + 50000000000 AS id, 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}) AS distance FROM embeddings),
vl AS (SELECT * FROM v WHERE distance < 0.85 ORDER BY distance, id LIMIT {{n}}),
vr AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY distance, id)) AS part, 'vector' AS source FROM vl),
f AS (SELECT id, sum(part) AS score, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT * FROM tr UNION ALL SELECT * FROM orr UNION ALL SELECT * FROM vr) GROUP BY id)"""
_FUSED = f"(f.score + {_BOOST.format(q='red brand#3 component')}) * {_WEIGHT} + CASE WHEN degree > 0 THEN log2(1 + degree) * 0.003 ELSE 0 END"


def _entity_vectors(spark, d):
    return S.vectors(spark, d).withColumn("id", F.col("id") + 5 * S.KIND)


@query("hybrid_scoped", _ALL + f""", {_LISTS.format(n=40)} SELECT f.id, e.name, e.entity_type, round({_FUSED} + CASE WHEN f.id = 50000000004 THEN 0.04 ELSE 0.02 END, 4) AS score, sources
FROM f JOIN entities e USING (id) LEFT JOIN degree USING (id) WHERE f.id % 2 = 0 ORDER BY 4 DESC, 1 LIMIT 20""")
def _(spark, d):
    g = S.graph(spark, d, with_vectors=True)
    scope = g.entities.where("id % 2 = 0").select("id")
    return search.hybrid_search(g.entities, g.observations, g.relations, "red brand#3 Component", query_vector(spark, d), _entity_vectors(spark, d), 20, scope, 50_000_000_004, restrict=True)


@query("evidence_summary", _ALL + f""", {_LISTS.format(n=10)}, {_TRUST},
h AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS start FROM (SELECT f.id, round({_FUSED} + 0.02, 4) AS score FROM f JOIN entities e USING (id) LEFT JOIN degree USING (id) WHERE f.id BETWEEN 50000000000 AND 50000000199 ORDER BY 2 DESC, 1 LIMIT 5)),
e2 AS (SELECT id AS edge, from_entity_id AS a, to_entity_id AS b FROM relations UNION ALL SELECT id, to_entity_id, from_entity_id FROM relations),
m AS (SELECT start, b AS id, min(edge) AS edge FROM h JOIN e2 ON a = h.id WHERE b <> h.id GROUP BY 1, 2),
x AS (SELECT id, min(start) AS start FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY edge, id) AS n FROM m) WHERE n <= 4 AND id NOT IN (SELECT id FROM h) GROUP BY id),
es AS (SELECT id, score FROM h UNION ALL SELECT x.id, h.score * 0.8 FROM x JOIN h USING (start)),
t AS (SELECT tr.*, es.score AS er, {_TOK.format(c='content')} AS c, {_TOK.format(c=repr('red brand#3 Component'))} AS q, 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}) AS dist FROM trust tr JOIN es ON es.id = memory_entity_id WHERE status = 'active'),
r AS (SELECT *, round(CASE WHEN dist IS NULL THEN share ELSE 0.6 * share + 0.4 * greatest(1 - dist, 0.0) END, 4) AS qr FROM (SELECT *, CASE WHEN len(c) = 0 THEN 0.0 ELSE len(list_intersect(q, c)) / len(q)::DOUBLE END AS share FROM t)),
k AS (SELECT *, row_number() OVER (PARTITION BY memory_entity_id ORDER BY qr DESC, er DESC, trust_score DESC, coalesce(confidence, 0) DESC, id) AS n FROM r),
b AS (SELECT *, row_number() OVER (ORDER BY qr DESC, er DESC, trust_score DESC, coalesce(confidence, 0) DESC, id) AS position FROM k WHERE n <= 3),
s AS (SELECT *, string_split_regex(lower(content), '[^a-z0-9_'']+') AS w FROM b WHERE position <= 20),
z AS (SELECT *, ({_NEG}) AS neg FROM s)
SELECT position, z.id, memory_entity_id, e.name AS entity_name, round(er, 4) AS entity_relevance, qr AS query_relevance, trust_score,
 EXISTS (SELECT 1 FROM z y WHERE y.id <> z.id AND y.neg <> z.neg AND 1 - list_cosine_similarity(y.embedding::DOUBLE[], z.embedding::DOUBLE[]) < 0.95) AS has_contradiction, content
FROM z LEFT JOIN entities e ON e.id = memory_entity_id""")
def _(spark, d):
    g, v = S.graph(spark, d, with_vectors=True), query_vector(spark, d)
    scope = spark.range(5 * S.KIND, 5 * S.KIND + S.SUBJECTS)  # entities that have observations
    found = search.hybrid_search(g.entities, g.observations, g.relations, "red brand#3 Component", v, _entity_vectors(spark, d), 5, scope, restrict=True)
    scored = evidence.expanded(found.select("id", "score"), g.relations, 1, 5)
    return evidence.evidence(scored, g.entities, g.observations, g.relations, S.NOW, "red brand#3 Component", v, conflict=0.95)


@query("vector_page", views("observations") + f""", v AS (SELECT vec_id + 50000000000 AS id, 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}) AS distance FROM embeddings),
a AS (SELECT id, 0 AS l, row_number() OVER (ORDER BY distance, id) AS r FROM v WHERE distance < 0.85 ORDER BY distance, id LIMIT 30),
o AS (SELECT memory_entity_id AS id, min(1 - list_cosine_similarity(embedding::DOUBLE[], {_Q})) AS distance FROM observations WHERE status = 'active' AND embedding IS NOT NULL GROUP BY 1),
b AS (SELECT id, 1 AS l, row_number() OVER (ORDER BY distance, id) AS r FROM o ORDER BY distance, id LIMIT 30), f AS (SELECT id, min((l, r)) AS p FROM (FROM a UNION ALL FROM b) GROUP BY id)
SELECT id, row_number() OVER (ORDER BY p) AS position FROM f""")
def _(spark, d):
    return search.vector_page(_entity_vectors(spark, d), S.observations(spark, d, with_vectors=True), query_vector(spark, d), 30)


@query("in_scope_first", views("entities")[:-1] + f", {_TEXT}, t AS (SELECT id, score FROM scored WHERE score >= 1 ORDER BY score DESC, lower(entity_type), lower(name), id LIMIT 50) SELECT id, score, id % 3 = 0 AS in_scope FROM t ORDER BY id % 3 = 0 DESC, score DESC, id LIMIT 20")
def _(spark, d):
    e = S.entities(spark, d)
    found = search.text_search(e, "red brand#3 Component").select("id", "score")
    return search.in_scope_first(found, e.where("id % 3 = 0"), F.desc("score"), F.asc("id")).limit(20)


@query("rows_in_order", views("entities") + "SELECT id, name, position FROM entities JOIN (VALUES (50000000003, 0), (10000000001, 1), (60000000009, 2)) v(id, position) USING (id)")
def _(spark, d):
    return scan.in_order(S.entities(spark, d), [50_000_000_003, 10_000_000_001, 60_000_000_009]).select("id", "name", "position")


# Imports: a tree of customers below their nations, some of them moved, renamed or of another type


def _children(spark, d):
    c, n = S.table(spark, d, "customer"), S.table(spark, d, "nation").select(F.col("n_nationkey").alias("_n"), "n_name")
    k = F.col("c_custkey")
    wrong = F.when(k % 3 == 0, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey"))
    rows = c.join(n, wrong == F.col("_n"))
    return rows.select(
        F.concat(F.lit("0.children."), k.cast("string")).alias("node_path"), F.upper("n_name").alias("parent_name"), F.when(k % 5 == 0, F.concat("c_name", F.lit(" jr"))).otherwise(F.col("c_name")).alias("name"),
        F.when(k % 2 == 0, "person").when(k % 7 == 0, "Tool").otherwise("User").alias("entity_type"), F.when(k % 11 == 0, "belongs_to").when(k % 13 == 0, "requires").alias("relation_type"), (k % 17 == 0).alias("parent_to_child"),
    )


_CHILDREN = """SELECT '0.children.' || c_custkey AS node_path, CASE WHEN c_custkey % 5 = 0 OR (c_custkey % 2 <> 0 AND c_custkey % 7 = 0) THEN 'new' WHEN c_custkey % 3 = 0 OR c_custkey % 17 = 0 OR (c_custkey % 11 <> 0 AND c_custkey % 13 = 0) THEN 'add_relation' ELSE 'skip' END AS status,
CASE WHEN c_custkey % 5 = 0 OR (c_custkey % 2 <> 0 AND c_custkey % 7 = 0) THEN NULL ELSE c_custkey + 30000000000 END AS match_id FROM customer"""


@query("import_children", _CHILDREN)
def _(spark, d):
    return imports.match_children(_children(spark, d), S.entities(spark, d), S.relations(spark, d))


@query("import_stats", f"WITH m AS ({_CHILDREN}) SELECT count(*) AS total, 0::BIGINT AS root_nodes, 0::BIGINT AS high_confidence, 0::BIGINT AS low_confidence, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'skip') AS skip, count(*) FILTER (status = 'add_relation') AS add_relation FROM m")
def _(spark, d):
    return imports.import_stats(imports.match_children(_children(spark, d), S.entities(spark, d), S.relations(spark, d)))


_LOW = "[lower(coalesce(entity_type, '')), lower(coalesce(name, '')), lower(coalesce(aliases, ''))]"
_POINTS = " + ".join(f"CASE WHEN contains(l[{k + 1}], t) THEN {part} + CASE WHEN list_contains(string_split_regex(l[{k + 1}], '[\\s,|]+'), t) THEN {whole} ELSE 0 END ELSE 0 END" for k, (_, part, whole) in enumerate(search.FIELDS))


@query("import_roots", views("entities") + f""", q AS (SELECT n_nationkey::VARCHAR AS key, n_name || ' ' || CASE n_nationkey % 3 WHEN 0 THEN 'Framework' WHEN 1 THEN 'Project' ELSE 'Gizmo' END AS query, CASE n_nationkey % 3 WHEN 0 THEN 'Framework' WHEN 1 THEN 'Project' ELSE 'Gizmo' END AS want FROM nation),
t AS (SELECT key, want, unnest(list_distinct(string_split_regex(lower(query), '\\s+'))) AS t FROM q), x AS (SELECT *, {_LOW} AS l FROM entities),
p AS (SELECT key, want, id, name, entity_type, t, l, {_POINTS} AS points FROM t JOIN x ON contains(l[1], t) OR contains(l[2], t) OR contains(l[3], t)),
s AS (SELECT key, want, id, name, entity_type, sum(points) + CASE WHEN count(*) > 1 THEN 3.0 * (count(*) - 1) ELSE 0 END AS score, bool_or(contains(l[1], t)) AS ht, bool_or(contains(l[2], t) OR contains(l[3], t)) AS hn FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, lower(entity_type), lower(name), id) AS n FROM s),
b AS (SELECT *, count(*) OVER (PARTITION BY key) AS n_all FROM r WHERE n <= 10), w AS (SELECT *, CASE WHEN score >= 20 AND ht AND hn AND lower(entity_type) = lower(want) THEN 'high_confidence' WHEN score >= 10 AND ht THEN 'low_confidence' ELSE 'new' END AS status FROM b WHERE n = 1)
SELECT q.key AS node_path, coalesce(status, 'new') AS status, CASE WHEN status = 'high_confidence' THEN id END AS match_id, score::DOUBLE AS score, coalesce(n_all, 0) AS n_matches FROM q LEFT JOIN w USING (key)""")
def _(spark, d):
    k = F.col("n_nationkey")
    nodes = S.table(spark, d, "nation").select(k.cast("string").alias("node_path"), F.col("n_name").alias("name"), F.when(k % 3 == 0, "library").when(k % 3 == 1, "repo").otherwise("Gizmo").alias("entity_type"))
    return imports.match_roots(nodes, S.entities(spark, d))


@query("import_duplicates", f"""WITH o AS (SELECT doc_id AS id, doc_id % 200 AS m, text, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 11 <> 0),
i AS (SELECT doc_id AS key, doc_id % 200 AS m, CASE WHEN doc_id % 4 = 0 THEN ' ' WHEN doc_id % 4 = 1 THEN text ELSE 'new ' || doc_id END AS content, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON vec_id = (doc_id * 7 + 1) % (SELECT count(*) FROM embeddings)),
x AS (SELECT key, min(o.id) AS same FROM i JOIN o ON i.m = o.m AND i.content = o.text WHERE trim(content) <> '' GROUP BY key),
n AS (SELECT key, arg_min(o.id, (1 - list_cosine_similarity(i.v, o.v), o.id)) AS id, min(1 - list_cosine_similarity(i.v, o.v)) AS distance FROM i JOIN o USING (m) WHERE trim(content) <> '' AND key NOT IN (SELECT key FROM x) GROUP BY key)
SELECT key, same IS NOT NULL OR coalesce(distance <= 0.9, false) AS duplicate, coalesce(same, n.id) AS observation_id, CASE WHEN same IS NOT NULL THEN 0.0 ELSE round(distance, 6) END AS distance, same IS NOT NULL AS exact FROM i LEFT JOIN x USING (key) LEFT JOIN n USING (key)""")
def _(spark, d):
    docs, v = S.table(spark, d, "documents"), S.table(spark, d, "embeddings").select(F.col("vec_id"), "embedding")
    k = F.col("doc_id")
    o = docs.join(v, k == F.col("vec_id")).select(k.alias("id"), (k % 200).alias("memory_entity_id"), F.col("text").alias("content"), F.when(k % 11 == 0, "obsolete").otherwise("active").alias("status"), "embedding")
    content = F.when(k % 4 == 0, " ").when(k % 4 == 1, F.col("text")).otherwise(F.concat(F.lit("new "), k.cast("string")))
    n = v.agg(F.count("*").alias("n"))  # one row
    new = docs.crossJoin(F.broadcast(n)).join(v, (k * 7 + 1) % F.col("n") == F.col("vec_id")).select(k.alias("key"), (k % 200).alias("memory_entity_id"), content.alias("content"), "embedding")
    return imports.duplicate_contents(new, o, 0.9).withColumn("distance", F.round("distance", 6))


# A tree of customers below their nations: some moved, some new, every nineteenth below two nations
_TREE = """c AS (SELECT c_custkey AS k, c_nationkey AS home, c_name || CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN ' jr' ELSE '' END AS name, CASE WHEN c_custkey % 7 = 0 THEN 'Tool' ELSE 'User' END AS kind,
  CASE WHEN c_custkey % 13 = 0 THEN 'depends_on' ELSE 'part_of' END AS t, c_custkey % 13 = 0 AND c_custkey % 17 = 0 AS down, c_custkey % 5 = 0 OR c_custkey % 7 = 0 AS fresh FROM customer),
n AS (SELECT *, CASE WHEN k % 3 = 0 THEN (home + 1) % 25 ELSE home END AS n, k AS pos FROM c UNION ALL SELECT *, (home + 2) % 25, 100000000 + k FROM c WHERE k % 19 = 0),
i AS (SELECT k, 9000000000000 + row_number() OVER (ORDER BY pos) - 1 AS id FROM (SELECT k, min(n * 10000000000 + pos) AS pos FROM n WHERE fresh GROUP BY k)),
m AS (SELECT n.*, CASE WHEN fresh THEN i.id ELSE n.k + 30000000000 END AS id, NOT fresh AND t = 'part_of' AND n.n = home AS skipped FROM n LEFT JOIN i USING (k)),
last AS (SELECT id, arg_max(n, n * 10000000000 + pos) + 20000000000 AS parent FROM m WHERE t = 'part_of' AND NOT skipped GROUP BY id)"""


def _import_tree(spark, d):
    c, k = S.table(spark, d, "customer"), F.col("c_custkey").cast("long")
    fresh = (k % 5 == 0) | (k % 7 == 0)
    rows = c.select(
        k.alias("k"), F.col("c_nationkey").alias("home"), F.when(fresh, F.concat("c_name", F.lit(" jr"))).otherwise(F.col("c_name")).alias("name"), F.when(k % 7 == 0, "gem tool").otherwise("person").alias("_kind"), F.when(k % 7 == 0, "tools").otherwise("person").alias("entity_type"),
        F.when(k % 13 == 0, "requires").otherwise("belongs_to").alias("relation_type"), ((k % 13 == 0) & (k % 17 == 0)).alias("parent_to_child"),
        F.concat(F.lit("a"), (k % 3).cast("string"), F.lit(";x")).alias("aliases"), F.array(F.concat(F.lit("fact "), (k % 4).cast("string")), F.lit("seen"), F.lit(" "), F.lit("seen")).alias("observations"),
    ).drop("_kind")
    first = rows.withColumn("n", F.when(F.col("k") % 3 == 0, (F.col("home") + 1) % 25).otherwise(F.col("home"))).withColumn("at", F.col("k"))
    again = rows.where("k % 19 = 0").withColumn("n", (F.col("home") + 2) % 25).withColumn("at", F.col("k") + 100_000_000)
    both = first.unionByName(again)
    nations = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("parent_name"))
    path = F.concat_ws(".children.", F.col("n").cast("string"), F.col("at").cast("string"))
    children = both.join(nations, "n").select(path.alias("node_path"), F.col("n").cast("string").alias("parent_path"), "parent_name", "name", "entity_type", "relation_type", "parent_to_child", "aliases", "observations")
    return children, nations.select(F.col("n").cast("string").alias("node_path"), F.col("parent_name").alias("name"), F.lit("lib").alias("entity_type"), F.lit("skip").alias("status"))


@query("import_executed", views("entities", "relations") + f""", {_TREE},
e AS (SELECT DISTINCT CASE WHEN down THEN n + 20000000000 ELSE id END AS f, CASE WHEN down THEN id ELSE n + 20000000000 END AS t2 FROM m WHERE t = 'depends_on')
SELECT 'relation' AS part, from_entity_id AS id, to_entity_id AS ref_id, relation_type AS label, NULL AS aliases FROM relations WHERE NOT (relation_type = 'part_of' AND from_entity_id IN (SELECT id FROM last))
UNION ALL SELECT 'relation', id, parent, 'part_of', NULL FROM last UNION ALL SELECT 'relation', f, t2, 'depends_on', NULL FROM e
UNION ALL SELECT DISTINCT 'observation', id, NULL::BIGINT, unnest(['fact ' || k % 4, 'seen']), NULL FROM m
UNION ALL SELECT 'entity', id, NULL, name, aliases FROM entities UNION ALL SELECT 'entity', id, NULL, arg_min(name, n * 10000000000 + pos), CASE WHEN count(*) > 1 THEN 'a' || any_value(k) % 3 || ',x' ELSE 'a' || any_value(k) % 3 || ';x' END FROM m WHERE fresh GROUP BY id""")
def _(spark, d):
    g = S.graph(spark, d)
    children, nations = _import_tree(spark, d)
    decided = children.join(imports.match_children(children, g.entities, g.relations), "node_path").unionByName(nations, allowMissingColumns=True)
    out = imports.executed(g, decided, 9 * S.EDGE).graph
    none = F.lit(None)
    parts = out.relations.select(F.lit("relation").alias("part"), F.col("from_entity_id").alias("id"), F.col("to_entity_id").alias("ref_id"), F.col("relation_type").alias("label"), none.cast("string").alias("aliases"))
    new = out.observations.where(F.col("id") >= 9 * S.EDGE).select(F.lit("observation"), "memory_entity_id", none.cast("long"), "content", none.cast("string"))
    return parts.unionAll(new).unionAll(out.entities.select(F.lit("entity"), "id", none.cast("long"), "name", "aliases"))


# Project checks: notes of orders that mention nations and brands

_NOTES = "notes AS (SELECT o_orderkey AS id, o_orderkey % 200 + 50000000000 AS memory_entity_id, CASE o_orderkey % 4 WHEN 0 THEN 'ships to ' || n_name || ', fast' WHEN 1 THEN 'x' || n_name || ' and Brand#' || o_orderkey % 30 WHEN 2 THEN n_name || ' or (' || upper(n_name) || ') or AMERICA' ELSE 'nothing' END AS content, o_orderkey % 5 = 0 AS scanned FROM orders JOIN nation ON n_nationkey = o_orderkey % 25)"


def _notes(spark, d):
    n = S.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("_n"), "n_name")
    k = F.col("o_orderkey")
    o = S.table(spark, d, "orders").join(n, k % 25 == F.col("_n"))
    text = F.when(k % 4 == 0, F.concat(F.lit("ships to "), "n_name", F.lit(", fast"))).when(k % 4 == 1, F.concat(F.lit("x"), "n_name", F.lit(" and Brand#"), (k % 30).cast("string")))
    text = text.when(k % 4 == 2, F.concat("n_name", F.lit(" or ("), F.upper("n_name"), F.lit(") or AMERICA"))).otherwise("nothing")
    return o.select(k.alias("id"), (k % 200 + 5 * S.KIND).alias("memory_entity_id"), text.alias("content"), (k % 5 == 0).alias("scanned"), F.lit("active").alias("status"))


_TERMS = "terms AS (SELECT DISTINCT id, lower(t) AS term FROM (SELECT id, unnest(list_concat([trim(name)], list_filter(list_transform(string_split_regex(coalesce(aliases, ''), '[,|;]'), lambda x: trim(x)), lambda x: x <> ''))) AS t FROM entities WHERE entity_type IN ('Project', 'Framework', 'Component')) WHERE length(t) >= 3)"
_MET = "met AS (SELECT DISTINCT content, term FROM (SELECT DISTINCT content FROM notes) JOIN (SELECT DISTINCT term FROM terms) ON regexp_matches(content, '(?i)(?:^|\\W)' || regexp_replace(regexp_replace(term, '([^A-Za-z0-9_\\s])', '\\\\\\1', 'g'), '\\s+', '\\\\W+', 'g') || '(?:$|\\W)'))"


@query("phrase_mentions", views("entities")[:-1] + f", {_NOTES}, {_TERMS}, {_MET} SELECT id AS text_id, term FROM notes JOIN met USING (content)")
def _(spark, d):
    e = S.entities(spark, d).where("entity_type IN ('Project', 'Framework', 'Component')")
    return projects.mentions(_notes(spark, d).select(F.col("id").alias("text_id"), F.col("content").alias("text")), projects.terms(e).select("term"))


@query("scan_validation", views("entities")[:-1] + f""", {_NOTES}, {_TERMS}, {_MET}, f AS (SELECT DISTINCT n.id, n.memory_entity_id, t.id AS e FROM notes n JOIN met USING (content) JOIN terms t USING (term)),
p AS (SELECT id, bool_or(e = memory_entity_id OR e = 10000000001) AS owned, count(*) AS n, min(e) AS target FROM f GROUP BY id),
r AS (SELECT n.id, scanned, coalesce(owned, false) AS owned, CASE WHEN owned THEN 0 ELSE coalesce(n, 0) END AS n, target FROM notes n LEFT JOIN p USING (id))
SELECT id, CASE WHEN owned THEN 'keep' WHEN n > 1 THEN 'review_move' WHEN n = 1 THEN CASE WHEN scanned THEN 'move' ELSE 'review_move' END WHEN scanned THEN 'obsolete' ELSE 'review_delete' END AS action, CASE WHEN n > 0 THEN target END AS target_id, n AS n_candidates FROM r""")
def _(spark, d):
    e = S.entities(spark, d).where("entity_type IN ('Project', 'Framework', 'Component')")
    return projects.validated(_notes(spark, d), e, 10_000_000_001, F.col("scanned"))


@query("wrong_roots", views("relations") + "SELECT id FROM relations WHERE relation_type = 'part_of' AND to_entity_id BETWEEN 10000000000 AND 10000000099 AND to_entity_id <> 10000000001")
def _(spark, d):
    return projects.wrong_roots(S.relations(spark, d), S.entities(spark, d), 10_000_000_001)


@query("scan_reconciled", views("entities")[:-1] + f", {_NOTES}, m AS (SELECT id FROM entities WHERE entity_type = 'Component' AND id % 3 <> 0), o AS (SELECT n.id, memory_entity_id, scanned FROM notes n JOIN m ON m.id = memory_entity_id) SELECT 'obsolete' AS action, id FROM o WHERE scanned UNION ALL SELECT 'delete', id FROM m WHERE id NOT IN (SELECT memory_entity_id FROM o WHERE NOT scanned)")
def _(spark, d):
    parts = S.entities(spark, d).where("entity_type = 'Component'").select("id")
    obsolete, deleted = projects.reconciled(parts, parts.where("id % 3 = 0"), _notes(spark, d), F.col("scanned"))
    return obsolete.select(F.lit("obsolete").alias("action"), "id").unionAll(deleted.select(F.lit("delete").alias("action"), "id"))


@query("orphan_report", views("entities", "relations", "observations") + f""", h AS (SELECT from_entity_id, to_entity_id FROM relations WHERE relation_type IN ('part_of', 'depends_on')), oe AS (SELECT * FROM entities WHERE entity_type <> 'Project' AND id NOT IN (SELECT from_entity_id FROM h)),
f AS (SELECT memory_entity_id AS id, string_agg(content, ' ' ORDER BY id) AS facts FROM (SELECT id, memory_entity_id, content, row_number() OVER (PARTITION BY memory_entity_id ORDER BY id) AS n FROM observations WHERE status = 'active') WHERE n <= 5 GROUP BY 1),
o AS (SELECT e.id, {_TOK.format(c="concat_ws(' ', name, entity_type, description, facts)")} AS ts FROM oe e LEFT JOIN f USING (id)),
t AS (SELECT id, unnest(ts) AS t FROM o), u AS (SELECT DISTINCT t FROM t), p AS (SELECT id AS project_id, lower(name) AS pn, {_TOK.format(c='name')} AS pt FROM entities WHERE entity_type IN ('Project', 'Framework')),
q AS (SELECT t, project_id, CASE WHEN list_contains(pt, t) THEN 10 ELSE 5 END AS points FROM u JOIN p ON contains(pn, t)), s AS (SELECT t.id, project_id, sum(points) AS score FROM t JOIN q USING (t) GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, project_id) AS n, count(*) OVER (PARTITION BY id) AS n_matches FROM s)
SELECT oe.id, name, entity_type, coalesce(c.n, 0) AS n_observations, coalesce(k.n, 0) AS n_children, coalesce(n_matches, 0) AS n_matches, project_id, score::BIGINT AS score
FROM oe LEFT JOIN (SELECT memory_entity_id AS id, count(*) AS n FROM observations GROUP BY 1) c USING (id) LEFT JOIN (SELECT to_entity_id AS id, count(*) AS n FROM h GROUP BY 1) k USING (id) LEFT JOIN (SELECT * FROM b WHERE n = 1) b USING (id)""")
def _(spark, d):
    g = S.graph(spark, d)
    return projects.orphan_report(g.entities, g.observations, g.relations, g.entities.where("entity_type IN ('Project', 'Framework')"))


@query("dashboard_snapshot", views("entities", "relations", "observations", "audit") + """SELECT 'totals' AS section, 'entities' AS name, count(*)::DOUBLE AS value FROM entities UNION ALL SELECT 'totals', 'observations', count(*) FROM observations UNION ALL SELECT 'totals', 'relations', count(*) FROM relations UNION ALL SELECT 'totals', 'audit_logs', count(*) FROM audit
UNION ALL SELECT 'graph', 'isolated', count(*) FROM entities WHERE id NOT IN (SELECT from_entity_id FROM relations) AND id NOT IN (SELECT to_entity_id FROM relations) AND id NOT IN (SELECT memory_entity_id FROM observations)
UNION ALL SELECT 'embeddings', 'missing', count(*) - count(embedding) FROM observations UNION ALL SELECT 'embeddings', 'percent', round(100.0 * count(embedding) / count(*)) FROM observations UNION ALL SELECT 'latest', auditable_type, arg_max(id, (created_at, id)) FROM audit GROUP BY auditable_type""")
def _(spark, d):
    return stats.snapshot(S.graph(spark, d, with_vectors=True), S.audit_logs(spark, d))


@query("first_of_each_project", views("entities", "relations", then="p AS (SELECT from_entity_id AS id, min(to_entity_id) AS parent FROM relations WHERE relation_type = 'part_of' GROUP BY 1), w(id, pos) AS (SELECT id, id FROM entities UNION SELECT w.id, p.parent FROM w JOIN p ON p.id = w.pos WHERE w.pos >= 20000000000)", recursive=True) + "SELECT project_id, id, name, position FROM (SELECT pos AS project_id, e.id, name, row_number() OVER (PARTITION BY pos ORDER BY name, e.id) AS position FROM w JOIN entities e ON e.id = w.id WHERE pos < 20000000000 AND entity_type = 'User') WHERE position <= 10")
def _(spark, d):
    from knotwork.operators.graph import ancestor_projects

    e = S.entities(spark, d)
    rows = ancestor_projects(e, S.relations(spark, d)).join(e.where("entity_type = 'User'").select("id", "name"), "id")
    return stats.first_of_each(rows, "project_id", 10, "name", "id").select("project_id", "id", "name", "position")


@query("path_counts", views("entities", "relations", then="edges AS (SELECT DISTINCT to_entity_id AS a, from_entity_id AS b, 'i' AS d FROM relations WHERE relation_type IN ('part_of', 'depends_on') UNION SELECT DISTINCT from_entity_id, to_entity_id, 'o' FROM relations WHERE relation_type NOT IN ('part_of', 'depends_on')), w(root, id, path, depth) AS (SELECT id, id, [id], 0 FROM entities WHERE entity_type = 'Project' UNION ALL SELECT root, b, list_append(path, b), depth + 1 FROM w JOIN edges e ON a = w.id WHERE depth < 3 AND NOT list_contains(path, b) AND (depth = 0 OR w.id >= 20000000000))", recursive=True) + "SELECT root, count(*) AS n FROM w GROUP BY root")
def _(spark, d):
    e = S.entities(spark, d)
    return stats.path_counts(e, S.relations(spark, d), e.where("entity_type = 'Project'").select("id"), 3)


@query("counters_repaired", views("entities", "observations") + "SELECT e.id, count(o.id) AS memory_observations_count FROM entities e LEFT JOIN observations o ON o.memory_entity_id = e.id WHERE entity_type = 'Component' GROUP BY e.id")
def _(spark, d):
    e = S.entities(spark, d).where("entity_type = 'Component'").withColumn("memory_observations_count", F.col("id") % 6)
    return quality.counters_repaired(e, S.observations(spark, d)).select("id", "memory_observations_count")


@query("page_paths", "SELECT page_id, lower(regexp_extract(url, '[^/]\\.([^./]+)$', 1)) AS ext, nullif(regexp_extract('# ' || url || chr(10) || 'x', '(?m)^(?:#|##)\\s+(.+)$', 1), '') AS heading FROM pages")
def _(spark, d):
    return S.table(spark, d, "pages").select("page_id", projects.extension(F.col("url")).alias("ext"), projects.first_headings(F.concat(F.lit("# "), "url", F.lit("\nx"))).alias("heading"))
