"""Named queries for reports, drawn graphs, JSON rows, constraints and changes of the tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.functions import vectors as V
from knotwork.operators import graph as G
from knotwork.operators import mutate, projects, reports, scan
from knotwork.plans.base import query, views
from knotwork.plans.evidence import _LOW, _MET, _NOTES, _POINTS, _notes
from knotwork.sources import views as S

_CUT = "CASE WHEN length({c}) > {n} THEN {c}[1:{n} - 3] || '...' ELSE {c} END"


@query("project_report", views("entities", "relations") + f""", r AS (SELECT * FROM relations UNION ALL SELECT item_id + 10000000000000, item_id + 70000000000, item_id % 4 + 10000000000, 'relates_to' FROM benchmark UNION ALL SELECT item_id + 11000000000000, item_id % 3 + 10000000000, item_id + 70000000000, 'relates_to' FROM benchmark),
o AS (SELECT doc_id AS id, doc_id % 5 + 10000000000 AS p, text AS content, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 300 AS INT)) AS created_at FROM documents),
near AS (SELECT from_entity_id AS p, to_entity_id AS i, id FROM r UNION ALL SELECT to_entity_id, from_entity_id, id FROM r), e1 AS (SELECT p, i, min(near.id) AS edge FROM near JOIN entities e ON e.id = i AND e.entity_type = 'Issue' WHERE p < 20000000000 GROUP BY 1, 2),
e2 AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY edge, i) AS position FROM e1), o2 AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY created_at DESC, id DESC) AS position FROM o)
SELECT id AS project_id, 'project' AS section, 1 AS position, id AS ref_id, '## Project: ' || name AS line FROM entities WHERE entity_type = 'Project'
UNION ALL SELECT p, 'issues', position, i, '- ID ' || i || ': ' || {_CUT.format(c='name', n=50)} FROM e2 JOIN entities e ON e.id = i WHERE position <= 10
UNION ALL SELECT p, 'recent', position, id, '- `' || strftime(created_at, '%Y-%m-%d') || '`: ' || {_CUT.format(c="coalesce(content, '')", n=150)} FROM o2 WHERE position <= 5""")
def _(spark, d):
    """Issues hang on regions, many on the first ones; every document is a project's observation."""
    g, b = S.graph(spark, d), S.table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("i"))
    edge = lambda base, a, z: b.select((F.col("i") + base).alias("id"), a.alias("from_entity_id"), z.alias("to_entity_id"), F.lit("relates_to").alias("relation_type"))
    issue, region = F.col("i") + 7 * S.KIND, lambda n: F.col("i") % n + S.KIND
    more = edge(10 * S.EDGE, issue, region(4)).unionByName(edge(11 * S.EDGE, region(3), issue))
    facts = g.observations.withColumn("memory_entity_id", F.col("id") % 5 + S.KIND)
    return reports.project_sections(S.Graph(g.entities, facts, g.relations.select(*more.columns).unionByName(more)))


_ELEMENTS = """SELECT 'nodes' AS "group", e.id::VARCHAR AS id, name AS label, entity_type AS type, aliases, coalesce(n, 0) AS n_observations, e.id = 20000000003 AS is_focus, NULL AS source, NULL AS target, NULL AS from_name, NULL AS to_name FROM e LEFT JOIN (SELECT memory_entity_id, count(*) AS n FROM observations WHERE status = 'active' GROUP BY 1) c ON memory_entity_id = e.id
UNION ALL SELECT 'edges', 'r' || r.id, relation_type, NULL, NULL, NULL, NULL, from_entity_id::VARCHAR, to_entity_id::VARCHAR, a.name, b.name FROM relations r JOIN e a ON a.id = from_entity_id JOIN e b ON b.id = to_entity_id"""


@query("graph_elements", views("entities", "relations", "observations") + ", e AS (SELECT * FROM entities) " + _ELEMENTS.replace("e.id = 20000000003", "false"))
def _(spark, d):
    return reports.elements(S.graph(spark, d))


@query("graph_elements_near", views("entities", "relations", "observations") + ", e AS (SELECT * FROM entities WHERE id = 20000000003 OR id IN (SELECT from_entity_id FROM relations WHERE to_entity_id = 20000000003) OR id IN (SELECT to_entity_id FROM relations WHERE from_entity_id = 20000000003)) " + _ELEMENTS)
def _(spark, d):
    g = S.graph(spark, d)
    return reports.elements(g, G.ego_network(g.relations, 2 * S.KIND + 3), 2 * S.KIND + 3)


_ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


@query("rows_as_json", views("entities", "relations", "observations") + f"""SELECT 'entity' AS part, id, to_json({{'entity_id': id, 'name': name, 'entity_type': entity_type, 'aliases': aliases, 'description': description, 'created_at': {_ISO.format(c='created_at')}, 'updated_at': {_ISO.format(c='updated_at')}}})::VARCHAR AS json FROM entities
UNION ALL SELECT 'relation', id, to_json({{'relation_id': id, 'from_entity_id': from_entity_id, 'to_entity_id': to_entity_id, 'relation_type': relation_type}})::VARCHAR FROM relations
UNION ALL SELECT 'observation', id, to_json({{'observation_id': id, 'content': content, 'confidence': confidence, 'source': source, 'valid_from': {_ISO.format(c='valid_from')}, 'valid_until': {_ISO.format(c='valid_until')}, 'status': status, 'obsoleted_at': {_ISO.format(c='obsoleted_at')}, 'superseded_by_id': superseded_by_id, 'created_at': {_ISO.format(c='created_at')}}})::VARCHAR FROM observations""")
def _(spark, d):
    g = S.graph(spark, d)
    relations = g.relations.select("id", "from_entity_id", "to_entity_id", "relation_type")
    facts = g.observations.select("id", "content", "confidence", "source", "valid_from", "valid_until", "status", "obsoleted_at", "superseded_by_id", "created_at")
    part = lambda df, name, text: df.select(F.lit(name).alias("part"), "id", text.alias("json"))
    return part(g.entities, "entity", reports.entity_json(g.entities)).unionAll(part(relations, "relation", reports.relation_json(relations))).unionAll(part(facts, "observation", reports.observation_json(facts)))


@query("relation_violations", """WITH r AS (SELECT event_id AS id, user_id AS f, user_id + event_id % 3 AS t, CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'part_of' END AS k, CASE WHEN event_id % 7 = 0 THEN -value ELSE value END AS w, value / 10 AS c, CASE event_id % 4 WHEN 0 THEN '[1]' WHEN 1 THEN '{no' WHEN 2 THEN NULL ELSE props END AS p FROM events)
SELECT id, 'type_blank' AS rule FROM r WHERE k IS NULL OR trim(k) = '' UNION ALL SELECT id, 'self_reference' FROM r WHERE f = t UNION ALL SELECT id, 'weight_negative' FROM r WHERE w < 0 UNION ALL SELECT id, 'confidence_range' FROM r WHERE c < 0 OR c > 1
UNION ALL SELECT id, 'properties_no_object' FROM r WHERE p IS NULL OR NOT json_valid(p) OR json_type(CASE WHEN json_valid(p) THEN p END) <> 'OBJECT'""")
def _(spark, d):
    k, v = F.col("event_id"), F.col("value")
    rows = S.table(spark, d, "events").select(
        k.alias("id"), F.col("user_id").alias("from_entity_id"), (F.col("user_id") + k % 3).alias("to_entity_id"), F.when(k % 5 == 0, " ").when(k % 5 != 1, "part_of").alias("relation_type"),
        F.when(k % 7 == 0, -v).otherwise(v).alias("weight"), (v / 10).alias("confidence"), F.when(k % 4 == 0, "[1]").when(k % 4 == 1, "{no").when(k % 4 == 3, F.col("props")).alias("properties"),
    )
    return scan.relation_violations(rows)


@query("tag_violations", "SELECT event_id AS id, 'tags_no_strings' AS rule FROM events WHERE event_id % 8 NOT IN (0, 1)")
def _(spark, d):
    k = F.col("event_id")
    tags = F.when(k % 8 == 0, F.concat(F.lit('["a", "'), "event_type", F.lit('"]'))).when(k % 8 == 1, "[]").when(k % 8 == 2, "[1]").when(k % 8 == 3, '["a", null]').when(k % 8 == 4, F.col("props")).when(k % 8 == 5, "[no").when(k % 8 == 6, '["a", 2]')
    return scan.tag_violations(S.table(spark, d, "events").select(k.alias("id"), tags.alias("tags")))


@query("names_in_cases", "SELECT p_partkey AS id, lower(p_brand || '_' || replace(p_type, ' ', '_')) AS snake, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), '') AS camel FROM part")
def _(spark, d):
    part = S.table(spark, d, "part")
    snake = F.concat("p_brand", F.lit("_"), F.replace("p_type", F.lit(" "), F.lit("_")))
    return part.select(F.col("p_partkey").alias("id"), T.snake_case(snake).alias("snake"), T.camelize(F.replace(F.lower("p_name"), F.lit(" "), F.lit("_"))).alias("camel"))


@query("vectors_from_text", "SELECT vec_id AS id, vec_id % 4 <> 0 AS fits, round(CASE WHEN vec_id % 4 <> 0 THEN list_sum(embedding::DOUBLE[]) ELSE 0 END, 4) AS total FROM embeddings")
def _(spark, d):
    """Vectors as texts read back; every fourth lacks a component and counts as zero."""
    v = S.table(spark, d, "embeddings")
    dim = v.select(F.size("embedding")).first()[0] if not v.isEmpty() else 0
    short = F.when(F.col("vec_id") % 4 == 0, F.slice("embedding", 1, dim - 1)).otherwise(F.col("embedding"))
    read = v.select(F.col("vec_id").alias("id"), V.parsed(F.to_json(short)).alias("v"))
    fits = V.has_dim(F.col("v"), dim)
    usable = V.or_zero(F.when(fits, F.col("v")), dim)
    return read.select("id", fits.alias("fits"), F.round(F.aggregate(usable, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("entities_updated", views("entities") + """, c AS (SELECT id, CASE WHEN k % 3 = 0 THEN 'renamed ' || k % 50 WHEN k % 3 = 1 THEN ' ' END AS n, CASE WHEN k % 4 = 0 THEN 'Gem' END AS t, CASE WHEN k % 5 = 0 THEN '' END AS a FROM (SELECT id, id - 30000000000 AS k FROM entities WHERE entity_type = 'User')),
j AS (SELECT *, CASE WHEN (n IS NULL OR n = ' ') AND t IS NULL AND a IS NULL THEN 'nothing to change' WHEN trim(n) <> '' AND row_number() OVER (PARTITION BY n ORDER BY id) > 1 THEN 'the name is taken' END AS error FROM c)
SELECT e.id, CASE WHEN error IS NULL AND trim(n) <> '' THEN n ELSE name END AS name, CASE WHEN error IS NULL AND t IS NOT NULL THEN t ELSE entity_type END AS entity_type, CASE WHEN error IS NULL AND a IS NOT NULL THEN a ELSE aliases END AS aliases, error FROM entities e LEFT JOIN j USING (id)""")
def _(spark, d):
    """Users are renamed, some to one name, typed or lose their aliases."""
    e = S.entities(spark, d)
    k = F.col("id") - 3 * S.KIND
    changes = e.where("entity_type = 'User'").select("id", F.when(k % 3 == 0, F.concat(F.lit("renamed "), (k % 50).cast("string"))).when(k % 3 == 1, " ").alias("name"), F.when(k % 4 == 0, "gems").alias("entity_type"), F.when(k % 5 == 0, "").alias("aliases"), F.lit(None).cast("string").alias("description"))
    out, errors = mutate.update_entities(e, changes)
    return out.select("id", "name", "entity_type", "aliases").join(errors, "id", "left")


@query("relations_created", views("entities", "relations") + """, n AS (SELECT c_custkey AS k, c_custkey + 30000000000 AS f, CASE c_custkey % 4 WHEN 0 THEN c_custkey + 30000000000 WHEN 1 THEN 99 WHEN 2 THEN c_nationkey + 20000000000 ELSE c_nationkey % 5 + 10000000000 END AS t, CASE WHEN c_custkey % 8 > 3 THEN 'part_of' ELSE 'uses' END AS r FROM customer)
SELECT from_entity_id, to_entity_id, relation_type FROM relations UNION ALL SELECT f, t, r FROM n WHERE k % 4 IN (2, 3) AND r = 'uses'""")
def _(spark, d):
    """Of new edges of all customers those to themselves, to nothing and to second parents don't come in."""
    g, k = S.graph(spark, d), F.col("c_custkey")
    to = F.when(k % 4 == 0, k + 3 * S.KIND).when(k % 4 == 1, 99).when(k % 4 == 2, F.col("c_nationkey") + 2 * S.KIND).otherwise(F.col("c_nationkey") % 5 + S.KIND)
    new = S.table(spark, d, "customer").select((k + 8 * S.EDGE).alias("id"), (k + 3 * S.KIND).cast("long").alias("from_entity_id"), to.cast("long").alias("to_entity_id"), F.when(k % 8 > 3, "part_of").otherwise("uses").alias("relation_type"))
    g = replace(g, relations=g.relations.select(*new.columns))
    return mutate.with_relations(g, new).relations.drop("id")


@query("bulk_accepted", views("entities", "relations", "observations") + """SELECT 'entity' AS part, id, name AS label FROM entities UNION ALL SELECT 'entity', r_regionkey + 9000000000000, 'bulk ' || r_name FROM region
UNION ALL SELECT 'observation', id, md5(content) FROM observations UNION ALL SELECT 'observation', r_regionkey + 9000000000000, md5('seen ' || r_name) FROM region UNION ALL SELECT 'relation', id, relation_type FROM relations UNION ALL SELECT 'relation', r_regionkey + 9000000000000, 'part_of' FROM region""")
def _(spark, d):
    """An entity, an observation and an edge for each region, after a batch that one taken name rejects whole."""
    g, r = S.graph(spark, d), S.table(spark, d, "region")
    g = replace(g, relations=g.relations.select("id", "from_entity_id", "to_entity_id", "relation_type"))
    i = (F.col("r_regionkey") + 9 * S.EDGE).cast("long")
    entities = r.select(i.alias("id"), F.concat(F.lit("bulk "), "r_name").alias("name"), F.lit("Task").alias("entity_type"))
    facts = r.select(i.alias("id"), i.alias("memory_entity_id"), F.concat(F.lit("seen "), "r_name").alias("content"), F.lit("active").alias("status"))
    edges = r.select(i.alias("id"), i.alias("from_entity_id"), (F.col("r_regionkey") + S.KIND).cast("long").alias("to_entity_id"), F.lit("part_of").alias("relation_type"))
    try:
        g = mutate.bulk(g, entities.withColumn("name", F.col("name").substr(6, 100)), facts, edges)
    except ValueError:
        g = mutate.bulk(g, entities, facts, edges)
    part = lambda df, name, label: df.select(F.lit(name).alias("part"), "id", label.alias("label"))
    return part(g.entities, "entity", F.col("name")).unionAll(part(g.observations, "observation", F.md5("content"))).unionAll(part(g.relations, "relation", F.col("relation_type")))


_KNOWN = "entity_type IN ('Project', 'Framework', 'Component')"


@query("scan_validation_ranked", views("entities")[:-1] + f""", {_NOTES}, names AS (SELECT id, list_concat([trim(name)], list_filter(list_transform(string_split_regex(coalesce(aliases, ''), '[,|;]'), lambda x: trim(x)), lambda x: x <> '')) AS ts FROM entities WHERE {_KNOWN}),
terms AS (SELECT id, lower(t) AS term, min(pos) AS pos FROM (SELECT id, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM names) WHERE length(t) >= 3 GROUP BY ALL), {_MET}, c AS (SELECT DISTINCT content FROM notes),
x AS (SELECT *, {_LOW} AS l FROM entities WHERE {_KNOWN}), q AS (SELECT content, unnest(list_distinct(list_filter(string_split_regex(lower(content), '\\s+'), lambda w: w <> ''))) AS t FROM c),
pt AS (SELECT t, id, {_POINTS} AS points FROM (SELECT DISTINCT t FROM q) JOIN x ON contains(l[1], t) OR contains(l[2], t) OR contains(l[3], t)),
sc AS (SELECT content, id, sum(points) + CASE WHEN count(*) > 1 THEN 3.0 * (count(*) - 1) ELSE 0 END AS score FROM q JOIN pt USING (t) GROUP BY ALL),
rk AS (SELECT content, id AS e, score, row_number() OVER (PARTITION BY content ORDER BY score DESC, lower(entity_type), lower(name), id) AS place FROM sc JOIN x USING (id) QUALIFY place <= 50),
f AS (SELECT content, t.id AS e, arg_min(length(term), pos) AS long FROM met JOIN terms t USING (term) GROUP BY ALL),
k AS (SELECT f.*, e < 20000000000 AS root, score, place, e < 20000000000 OR place IS NOT NULL AS counts FROM f LEFT JOIN rk USING (content, e)),
p AS (SELECT n.id, bool_or(e = memory_entity_id OR e = 10000000001) AS owned, count(*) FILTER (counts) AS n, arg_min(e, (root, -long, -coalesce(score, 0), coalesce(place, 51), e)) FILTER (counts) AS target FROM notes n JOIN k USING (content) GROUP BY 1),
r AS (SELECT n.id, scanned, coalesce(owned, false) AS owned, CASE WHEN owned THEN 0 ELSE coalesce(n, 0) END AS n, target FROM notes n LEFT JOIN p USING (id))
SELECT id, CASE WHEN owned THEN 'keep' WHEN n > 1 THEN 'review_move' WHEN n = 1 THEN CASE WHEN scanned THEN 'move' ELSE 'review_move' END WHEN scanned THEN 'obsolete' ELSE 'review_delete' END AS action, CASE WHEN n > 0 THEN target END AS target_id, n AS n_candidates FROM r""")
def _(spark, d):
    e = S.entities(spark, d).where(_KNOWN)
    return projects.validated(_notes(spark, d), e, S.KIND + 1, F.col("scanned"), ranked=50)


@query("scan_absent_targets", views("entities", "relations")[:-1] + f""", {_NOTES}, terms AS (SELECT DISTINCT id, lower(t) AS term FROM (SELECT id, unnest(list_concat([trim(name)], list_filter(list_transform(string_split_regex(coalesce(aliases, ''), '[,|;]'), lambda x: trim(x)), lambda x: x <> ''))) AS t FROM entities WHERE entity_type = 'Component') WHERE length(t) >= 3), {_MET}
SELECT id FROM relations WHERE relation_type = 'depends_on' AND to_entity_id IN (SELECT id FROM entities) AND to_entity_id NOT IN (SELECT terms.id FROM terms JOIN met USING (term))""")
def _(spark, d):
    """Orders depend on parts whose brand no note mentions."""
    return projects.absent_targets(S.relations(spark, d), S.entities(spark, d), _notes(spark, d).select(F.col("id").alias("text_id"), F.col("content").alias("text")))
