"""Cursors that are stopped anywhere, and compaction runs in slices."""

import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from knotwork.operators import compaction, graph, quality
from knotwork.sources import exchange
from knotwork.sources.views import Graph
from knotwork.streaming import cursor

LOG = "k long, n long"


class Lost(Exception):
    pass


def source(spark, at, files=5):
    spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("k")).repartitionByRange(files, "id").write.parquet(at)
    return lambda: spark.readStream.schema("id long, k long").option("maxFilesPerTrigger", 1).parquet(at)


@pytest.mark.parametrize("when", ["before", "written", "marked"])
def test_a_killed_stream_is_taken_up_again(spark, tmp_path, when):
    """Lost before a batch is written, after its rows but before its mark, and after its mark but before Spark's own checkpoint."""
    stream, lost = source(spark, str(tmp_path / "in")), []

    class Fragile(cursor.BatchLog):
        def put(self, batch, rows):
            if batch == 2 and not lost:
                lost.append(batch)
                if when == "written":
                    rows.limit(1).write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
                elif when == "marked":
                    super().put(batch, rows)
                raise Lost
            super().put(batch, rows)

    count = lambda batch, _: batch.groupBy("k").agg(F.count("*").alias("n"))
    log = Fragile(spark, str(tmp_path / "log"), LOG)
    with pytest.raises(StreamingQueryException):
        cursor.run_stream(stream(), log, count, str(tmp_path / "mark"))
    assert log.last() == (2 if when == "marked" else 1)
    assert log.rows().agg(F.sum("n")).first()[0] == (60 if when == "marked" else 40)  # readers see whole batches only
    again = Fragile(spark, str(tmp_path / "log"), LOG)
    assert cursor.run_stream(stream(), again, count, str(tmp_path / "mark"))
    once = cursor.BatchLog(spark, str(tmp_path / "once"), LOG)
    assert cursor.run_stream(stream(), once, count, str(tmp_path / "mark2"))
    total = lambda log: sorted(map(tuple, log.rows().groupBy("k").agg(F.sum("n")).collect()))
    assert total(again) == total(once) and again.last() == once.last() == 4
    assert cursor.run_stream(stream(), again, count, str(tmp_path / "mark")) and total(again) == total(once)  # nothing is left to do


def test_a_paused_stream_and_earlier_rows(spark, tmp_path):
    """Each batch sees what the ones before it left, whatever stopped between them."""
    stream = source(spark, str(tmp_path / "in"))
    log = cursor.BatchLog(spark, str(tmp_path / "log"), LOG)
    seen = lambda batch, earlier: batch.join(earlier.select("k").distinct(), "k", "left_anti").groupBy("k").agg(F.lit(0).alias("n"))
    runs = 0
    while not cursor.run_stream(stream(), log, seen, str(tmp_path / "mark"), paused=lambda: True):
        runs += 1
    assert sorted(r.k for r in log.rows().collect()) == list(range(7)) and runs == 4


def test_backfill_touches_what_is_missing(spark):
    rows = spark.createDataFrame([(1, None), (2, 5.0)], "id long, v double")
    assert [tuple(r) for r in cursor.backfilled(rows, "v", F.col("id") * 2.0).collect()] == [(1, 2.0)]


def untidy(spark, seed=1):
    """Entities in tight groups of vectors, some of one name; equal contents; parents for a part of them."""
    rng = random.Random(seed)
    entities = [(1000 + k, f"project{k}", "Project", None, None) for k in range(3)]
    vectors, facts, edges = [], [], []
    for i in range(60):
        group = rng.randint(0, 14)
        entities.append((i, rng.choice([f"thing{group}", f"own{i}", f"project{i % 3} part"]), f"T{group % 2}", rng.choice([None, f"thing{group}"]), None))
        vectors.append((i, [float(group % 4), float(group // 4), 1.0, 0.01 * rng.random()]))
        facts += [(len(facts) + k, i, rng.choice(["a shared long statement", f"depends on own{rng.randint(0, 59)} surely", "short"]), "active", None) for k in range(rng.randint(0, 5))]
        if rng.random() < 0.4:
            edges.append((i, i, 1000 + i % 3, "part_of"))
    rng.shuffle(entities)
    g = Graph(spark.createDataFrame(entities, "id long, name string, entity_type string, aliases string, description string"), spark.createDataFrame(facts, "id long, memory_entity_id long, content string, status string, created_at timestamp"), spark.createDataFrame(edges, "id long, from_entity_id long, to_entity_id long, relation_type string"))
    return g, spark.createDataFrame(vectors, "id long, embedding array<double>")


def outcome(done):
    g, changes = done
    return {
        "entities": sorted((r.id, r.name, r.aliases or "") for r in g.entities.collect()), "observations": sorted((r.id, r.memory_entity_id) for r in g.observations.collect()),
        "relations": sorted((r.from_entity_id, r.to_entity_id, r.relation_type) for r in g.relations.collect()),
        **{p: sorted(map(str, c.collect())) for p, c in changes.items()}, "review": sorted(map(str, compaction.for_review(changes).collect())),
    }


def test_slices_and_pauses_change_nothing(spark, tmp_path):
    g, v = untidy(spark)
    whole = outcome(compaction.compact(g, v, str(tmp_path / "whole"), first_id=10_000))
    assert {"merge", "review_merge"} <= {r.split("kind='")[1].split("'")[0] for r in whole["merges"]} and whole["observations"] and whole["relationships"] and whole["review"]
    assert any("kind='parent'" in r for r in whole["orphans"])
    stops, done = 0, None
    while done is None:
        done = compaction.compact(g, v, str(tmp_path / "parts"), 2, first_id=10_000, paused=lambda: True)
        stops += done is None
    assert outcome(done) == whole and stops == 4


def test_merges_have_an_end(spark, tmp_path):
    """Every merged entity's facts stand at an entity that is left, and no entity of another type took them."""
    g, v = untidy(spark, 2)
    after, changes = compaction.compact(g, v, str(tmp_path / "run"), 2, first_id=10_000)
    left = {r.id for r in after.entities.collect()}
    gone = {r.a for r in changes["merges"].where("kind = 'merge'").collect()}
    assert gone and gone.isdisjoint(left) and {r.memory_entity_id for r in after.observations.collect()} <= left
    kind = {r.id: r.entity_type for r in g.entities.collect()}
    assert all(kind[r.a] == kind[r.b] for r in changes["merges"].collect())


def test_compaction_of_nothing(spark, tmp_path):
    g, v = untidy(spark)
    none = Graph(g.entities.limit(0), g.observations.limit(0), g.relations.limit(0))
    after, changes = compaction.compact(none, v.limit(0), str(tmp_path / "run"), 2)
    assert after.entities.count() == 0 and all(c.count() == 0 for c in changes.values())


def test_trees_in_document_order(spark):
    """Positions and the written document against a recursive walk."""
    rng = random.Random(5)
    kinds = ["Project", "Task", "Task", "Tool"]
    entities = [(i, f'n"{i}\\', kinds[i % 4], None) for i in range(14)]
    edges = [(k, rng.randint(0, 13), rng.randint(0, 13), rng.choice(["part_of", "depends_on", "relates_to"])) for k in range(40)]
    facts = [(k, rng.randint(0, 13), f"o{k}", "active") for k in range(10)]

    def node(i, edge, depth, path):
        own = {"name": entities[i][1], "entity_type": kinds[i % 4], "observations": [{"content": c} for _, m, c, _ in facts if m == i]}
        if edge:
            own |= {"relation_type": edge[3], "relation_direction": "child_to_parent" if edge[3] != "relates_to" else "parent_to_child"}
        down = [] if depth == 3 or (edge and kinds[i % 4] == "Project") else [(e, e[1]) for e in edges if e[2] == i and e[3] != "relates_to"] + [(e, e[2]) for e in edges if e[1] == i and e[3] == "relates_to"]
        return own | {"children": [node(j, e, depth + 1, [*path, j]) for e, j in down if j not in path]}

    want = {"root_nodes": [node(i, None, 0, [i]) for i in (0, 4, 5)]}
    e, r = spark.createDataFrame(entities, "id long, name string, entity_type string, aliases string"), spark.createDataFrame(edges, "id long, from_entity_id long, to_entity_id long, relation_type string")
    o = spark.createDataFrame(facts, "id long, memory_entity_id long, content string, status string")
    roots = spark.createDataFrame([(5,), (0,), (4,), (4,), (99,)], "id long")
    tree = graph.ordered_tree(e, r, roots, 3)
    assert sorted(x.position for x in tree.collect()) == list(range(1, tree.count() + 1))
    text = "".join(x.line for x in exchange.document_lines(tree, e, o, r).orderBy("position").collect())
    assert json.loads(text) == want
    none = graph.ordered_tree(e, r, roots.limit(0), 3)
    assert none.count() == 0


def test_lines_are_upserted_as_one_by_one(spark):
    rng = random.Random(6)
    entities, facts, edges = [(1, "a", "Task"), (2, "b", "Tool"), (3, "p", "Project")], [(1, 1, "x", "active"), (2, 2, "y", "obsolete")], [(1, 1, 3, "part_of")]
    lines = []
    for _ in range(80):
        if rng.random() < 0.6:
            lines.append({"type": "entity", "name": rng.choice("abcdefg"), "entityType": rng.choice(["Task", "Task", "Tool"]), "observations": rng.choices(["x", "y", "z", " "], k=rng.randint(0, 3))})
        else:
            lines.append({"type": "relation", "from": rng.choice("abcdefgh"), "to": rng.choice("abcdefghp"), "relationType": rng.choice(["part_of", "relates_to"])})
    kind, known, content, joined = {n: t for _, n, t in entities}, {n for _, n, _ in entities}, {("a", "x"): 1, ("b", "y"): 1}, {("a", "p", "part_of")}
    for line in lines:
        if line["type"] == "entity" and kind.setdefault(line["name"], line["entityType"]) == line["entityType"]:
            fresh = line["name"] not in known
            known.add(line["name"])
            for c in line["observations"]:
                if c.strip() and (fresh or (line["name"], c) not in content):
                    content[line["name"], c] = content.get((line["name"], c), 0) + 1
    for line in lines:
        if line["type"] == "relation":
            edge = line["from"], line["to"], line["relationType"]
            if {edge[0], edge[1]} <= known and edge[0] != edge[1] and edge not in joined and not (edge[2] == "part_of" and any(j[0] == edge[0] and j[2] == "part_of" for j in joined)):
                joined.add(edge)
    g = Graph(spark.createDataFrame(entities, "id long, name string, entity_type string"), spark.createDataFrame(facts, "id long, memory_entity_id long, content string, status string"), spark.createDataFrame(edges, "id long, from_entity_id long, to_entity_id long, relation_type string"))
    rows = [(k, json.dumps(x)) for k, x in enumerate(lines)] + [(900, "{bad"), (901, ""), (902, '{"type": "other"}'), (903, '{"type": "entity", "name": "q"}')]
    out = exchange.upserted(g, spark.createDataFrame(rows, "position long, value string").repartition(3), 100)
    name = {r.id: r.name for r in out.entities.collect()}
    assert sorted(name.values()) == sorted(known) and {r.name: r.entity_type for r in out.entities.collect()} == {n: kind[n] for n in known}
    assert sorted((name[r.memory_entity_id], r.content) for r in out.observations.collect()) == sorted(k for k, n in content.items() for _ in range(n))
    assert sorted((name[r.from_entity_id], name[r.to_entity_id], r.relation_type) for r in out.relations.collect()) == sorted(joined)
    again = exchange.upserted(out, spark.createDataFrame(rows, "position long, value string"), 1000)  # nothing is left to add
    assert (again.entities.count(), again.observations.count(), again.relations.count()) == (out.entities.count(), out.observations.count(), out.relations.count())


def test_a_second_sweep_looks_at_what_was_touched(spark):
    e = spark.createDataFrame([(1, 3, None), (2, 5, [1.0])], "id long, memory_observations_count int, embedding array<double>")
    o = spark.createDataFrame([(1, 1, "x", "active", None, None), (2, 1, "x", "active", None, None), (3, 2, "y", "superseded", None, None)], "id long, memory_entity_id long, content string, status string, obsoleted_at timestamp, superseded_by_id long")
    r = spark.createDataFrame([(1, 1, 2, "part_of"), (2, 1, 2, "part_of"), (3, 2, 9, "part_of"), (4, 2, 1, "part_of")], "id long, from_entity_id long, to_entity_id long, relation_type string")
    after, found = quality.sweep(Graph(e, o, r))
    assert sorted(tuple(x) for x in found.select("kind", "id").collect()) == [("counter", 1), ("counter", 2), ("dangling", 3), ("entity_without_vector", 1), ("repeated_observation", 2), ("reverse_pair", 4), ("same_direction", 2), ("second_parent", 4), ("superseded_without_reference", 3)]
    assert sorted((x.id, x.memory_observations_count) for x in after.entities.collect()) == [(1, 1), (2, 1)] and sorted(x.id for x in after.relations.collect()) == [1, 4]
    some, told = quality.sweep(Graph(e, o, r), touched=spark.createDataFrame([], "id long"))
    assert "superseded_without_reference" not in {x.kind for x in told.collect()} and sorted((x.id, x.memory_observations_count) for x in some.entities.collect()) == [(1, 1), (2, 5)]


def test_many_documents_and_deep_trees(spark):
    deep = {"name": "n0", "children": []}
    at = deep
    for k in range(1, 25):
        at["children"] = [{"name": f"n{k}", "relation_direction": "parent_to_child", "observations": ["a", {"content": "b"}, 3]}]
        at = at["children"][0]
    docs = [(1, json.dumps({"root_nodes": [deep, {"name": "second", "aliases": "x"}]})), (2, "no json"), (3, None), (4, "{}"), (5, '{"root_nodes": {"name": "no list"}}'), (6, '{"root_nodes": [{"name": null, "children": null}]}')]
    rows = exchange.flatten_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    by = {(r.doc_id, r.node_path): r for r in rows}
    assert len(rows) == 27 and by[1, "0" + ".children.0" * 24].name == "n24" and by[1, "0" + ".children.0" * 24].parent_path == "0" + ".children.0" * 23
    assert by[1, "0.children.0"].observations == ["a", "b", "3"] and by[1, "0.children.0"].parent_to_child and by[1, "1"].aliases == "x" and by[6, "0"].name is None


def test_dangling_relations_are_told_one_by_one_though_ids_repeat(spark):
    entities = spark.createDataFrame([(1,), (2,)], "id long")
    edges = spark.createDataFrame([(7, 1, 9), (7, 9, 2), (7, 9, 9), (8, 1, 2)], "id long, from_entity_id long, to_entity_id long")
    assert [r.id for r in quality.dangling(entities, edges).collect()] == [7, 7, 7]
