"""Changes of the tables, reports and spelling against plain loops."""

from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.operators import mutate, projects, scan
from knotwork.sources.views import Graph

CHANGES = "id long, name string, entity_type string, aliases string, description string"


def test_update_entities(spark):
    rows = [(1, "a", "Task", "x", "d"), (2, "b", "Task", None, None), (3, "c", "Tool", "y", None)]
    e = spark.createDataFrame(rows, CHANGES)
    changes = [(1, "b", None, None, None), (2, "new", " ", "", None), (3, "new", None, None, ""), (4, "z", None, None, None)]
    out, errors = mutate.update_entities(e, spark.createDataFrame(changes, CHANGES))
    assert sorted(map(tuple, out.collect())) == [(1, "a", "Task", "x", "d"), (2, "new", "Task", "", None), (3, "c", "Tool", "y", None)]
    assert dict(map(tuple, errors.collect())) == {1: "the name is taken", 3: "the name is taken", 4: "the entity is missing"}
    out, errors = mutate.update_entities(e, spark.createDataFrame([(1, "a", None, None, ""), (2, " ", None, None, None)], CHANGES))
    assert out.where("id = 1").first().description == "" and errors.collect() == [(2, "nothing to change")]
    out, errors = mutate.update_entities(e.limit(0), spark.createDataFrame([], CHANGES))
    assert out.count() == errors.count() == 0


def test_new_relations_close_no_loop(spark):
    edges = "id long, from_entity_id long, to_entity_id long, relation_type string"
    e = spark.createDataFrame([(i, str(i)) for i in range(1, 8)], "id long, name string")
    g = Graph(e, None, spark.createDataFrame([(1, 1, 2, "part_of"), (2, 2, 3, "part_of")], edges))
    new = [(10, 3, 1, "part_of"), (11, 3, 4, "uses"), (12, 4, 1, "part_of"), (13, 5, 6, "part_of"), (14, 6, 5, "part_of"), (15, 7, 7, "uses"), (16, 7, 99, "uses"), (17, 1, 7, "part_of")]
    got = mutate.with_relations(g, spark.createDataFrame(new, edges)).relations
    assert sorted(r.id for r in got.collect()) == [1, 2, 11, 12]


def test_spelling(spark):
    names = {"user_profile": "UserProfile", "api/user_page": "Api::UserPage", "HTMLPage": "HTMLPage", "_a_b": "AB", "a_BC-dE": "ABc-dE", "": "", "élan_vital": "élanVital", "x": "X", "a//b": "A::::B"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.camelize(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == names
    assert spark.range(1).select(T.snake_case(F.lit("Api::UserPage"))).first()[0] == "api/user_page"


def test_constraints_of_nulls(spark):
    r = spark.createDataFrame([(1, 1, 2, None), (2, 1, 1, "uses"), (3, None, 2, "uses")], "id long, from_entity_id long, to_entity_id long, relation_type string")
    assert sorted(map(tuple, scan.relation_violations(r).collect())) == [(1, "type_blank"), (2, "self_reference")]
    t = spark.createDataFrame([(1, None), (2, "[]"), (3, '["a"]'), (4, '["a", [null]]'), (5, "[null]"), (6, "")], "id long, tags string")
    assert sorted(r.id for r in scan.tag_violations(t).collect()) == [1, 4, 5, 6]


def test_absent_targets(spark):
    e = spark.createDataFrame([(1, "Redis Cache", None, "Tool"), (2, "Kafka", "event bus|kq", "Tool"), (3, "ab", None, "Tool")], "id long, name string, aliases string, entity_type string")
    r = spark.createDataFrame([(i, 9, t, k) for i, (t, k) in enumerate([(1, "depends_on"), (2, "requires"), (3, "extends"), (1, "part_of"), (7, "requires")])], "id long, from_entity_id long, to_entity_id long, relation_type string")
    texts = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "text_id long, text string")
    ids = lambda *t: sorted(x.id for x in projects.absent_targets(r, e, texts(*t)).collect())
    assert ids("uses redis  cache", None) == [1, 2] and ids("an Event-Bus!") == [0, 2] and ids("", None) == [] and ids() == []
