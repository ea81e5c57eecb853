"""Carrying out an import against meeting its nodes one by one."""

import random

import pytest

from knotwork.operators import blocks, imports
from knotwork.sources.views import Graph

NODES = "node_path string, parent_path string, name string, entity_type string, relation_type string, parent_to_child boolean, status string, match_id long, parent_id long, aliases string, observations array<string>"
EDGES = "id long, from_entity_id long, to_entity_id long, relation_type string"
FACTS = "id long, memory_entity_id long, content string, status string"


def graph(spark, entities, facts, edges):
    return Graph(spark.createDataFrame(entities, "id long, name string, entity_type string, aliases string, memory_observations_count int"), spark.createDataFrame(facts, FACTS), spark.createDataFrame(edges, EDGES))


def names(text):
    return [a.strip() for a in (text or "").replace("|", ",").replace(";", ",").split(",") if a.strip()]


def one_by_one(entities, facts, edges, nodes):
    """(entities, contents, edges, errors), by a plain loop over the tree."""
    by_id = {i: {"name": n, "type": t, "aliases": a} for i, n, t, a, _ in entities}
    edges = {(a, b, r) for _, a, b, r in edges}
    contents, met, errors, fresh = {(m, c) for _, m, c, s in facts if s == "active"}, {}, [], 1000
    order = sorted(nodes, key=lambda r: [int(p) for p in r[0].split(".") if p != "children"])
    for path, parent_path, name, kind, relation, down, status, match, parent_id, aliases, observations in order:
        same = [i for i, e in by_id.items() if (e["name"], e["type"]) == (name, kind)]
        if status == "merge":
            if match not in by_id:
                errors.append(path)
                continue
            i, joins = match, True
        elif same:
            i, joins = min(same), status == "new"
        elif not (name or "").strip() or any(e["name"] == name for e in by_id.values()):
            errors.append(path)
            continue
        else:
            i, joins, fresh = fresh, False, fresh + 1
            by_id[i] = {"name": name, "type": kind, "aliases": aliases}
        if joins and (aliases or "").strip():
            by_id[i]["aliases"] = ",".join(dict.fromkeys(names(by_id[i]["aliases"]) + names(aliases)))
        contents |= {(i, c) for c in observations if c.strip()}
        met[path] = i
        parent = parent_id or met.get(parent_path)
        if status == "skip" or parent is None or parent == i:
            continue
        a, b = (parent, i) if down else (i, parent)
        if (a, b, relation) not in edges:
            if relation == "part_of":
                edges = {e for e in edges if not (e[0] == a and e[2] == "part_of")}
            edges.add((a, b, relation))
    return by_id, contents, edges, errors


@pytest.mark.parametrize("seed", range(4))
def test_import_against_one_by_one(spark, seed):
    rng = random.Random(seed)
    entities = [(i, f"n{i}", rng.choice(["Task", "Tool"]), rng.choice([None, "a", "a; b|c"]), 0) for i in range(1, 13)]
    facts = [(i, rng.randint(1, 12), f"o{rng.randint(0, 5)}", rng.choice(["active", "obsolete"])) for i in range(1, 25)]
    edges = sorted({(rng.randint(7, 12), rng.randint(1, 6), rng.choice(["part_of", "relates_to"])) for _ in range(20)})
    edges = [(k, *e) for k, e in enumerate(edges, 1)]
    nodes, paths = [], []

    def put(path, parent):
        # parents are of lower ids than their children, so no loop can close
        k = rng.randint(1, 6) if parent is None else rng.randint(7, 16)
        kind = entities[k - 1][2] if k <= 12 else "Task"
        status = rng.choice(["skip", "add_relation", "new", "new"]) if k > 12 or rng.random() < 0.7 else "merge"
        nodes.append((path, parent, f"n{k}", kind, rng.choice(["part_of", "part_of", "relates_to"]), False, status, k if status == "merge" else None, None, rng.choice([None, "c,d", "d|e", " "]), rng.choices(["o1", "o2", "p1", "p1", " ", "p2"], k=rng.randint(0, 4))))
        paths.append(path)

    for r in range(4):
        put(str(r), None)
        for c in range(rng.randint(1, 12)):
            put(f"{r}.children.{c}", str(r))
    by_id, contents, want, errors = one_by_one(entities, facts, edges, nodes)
    assert not errors
    rng.shuffle(nodes)
    g = graph(spark, entities, facts, edges)
    out = imports.executed(g, spark.createDataFrame(nodes, NODES), 1000)
    assert out.errors.count() == 0
    assert {(r.id, r.name, r.entity_type, r.aliases) for r in out.graph.entities.collect()} == {(i, e["name"], e["type"], e["aliases"]) for i, e in by_id.items()}
    got = [(r.memory_entity_id, r.content) for r in out.graph.observations.collect() if r.status == "active" and r.id >= 1000]
    assert len(got) == len(set(got)) and set(got) == contents - {(m, c) for _, m, c, s in facts if s == "active"}
    found = [(r.from_entity_id, r.to_entity_id, r.relation_type) for r in out.graph.relations.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert len({r.id for r in out.graph.relations.collect()}) == len(found)


def test_of_two_new_parents_the_later_stays(spark):
    g = graph(spark, [(1, "A", "Project", None, 0), (2, "B", "Project", None, 0)], [], [])
    rows = [("0", None, "A", "Project", None, None, "skip", None, None, None, []), ("0.children.0", "0", "N", "Task", None, None, "new", None, None, "x", ["f"]), ("1", None, "B", "Project", None, None, "skip", None, None, None, []), ("1.children.0", "1", "N", "Task", None, None, "new", None, None, "y;x", ["f", "g"])]
    out = imports.executed(g, spark.createDataFrame(rows, NODES), 10)
    assert [(r.id, r.from_entity_id, r.to_entity_id, r.relation_type) for r in out.graph.relations.collect()] == [(10, 10, 2, "part_of")]
    assert [(r.name, r.aliases, r.memory_observations_count) for r in out.graph.entities.where("id = 10").collect()] == [("N", "x,y", 2)]


def test_errors_leave_the_graph_alone(spark):
    g = graph(spark, [(1, "A", "Project", None, 0), (2, "B", "Task", None, 0), (3, "C", "Task", None, 0)], [], [(1, 2, 1, "part_of"), (2, 3, 2, "part_of")])
    fields = lambda *r: (*r[:4], None, r[4], r[5], r[6], r[7], None, [])
    rows = [
        fields("0", None, "B", "Project", None, "new", None, None),  # the name is a Task's
        fields("1", None, " ", "Task", None, "new", None, None),
        fields("2", None, "x", "Task", None, "merge", 99, None),
        fields("3", None, "B", "Task", None, "add_relation", None, 3),  # below its own child
        fields("4", None, "new", "Task", None, "new", None, None), fields("5", None, "new", "Tool", None, "new", None, None),
    ]
    out = imports.executed(g, spark.createDataFrame(rows, NODES), 10)
    assert sorted((r.node_path, r.error) for r in out.errors.collect()) == [("0", "the name is taken by another type"), ("1", "no name"), ("2", "the match is missing"), ("3", "a loop of parents"), ("5", "the name is taken by another type")]
    assert out.graph is g


def test_empty_import(spark):
    g = graph(spark, [(1, "A", "Project", None, 0)], [], [])
    out = imports.executed(g, spark.createDataFrame([], NODES), 10)
    assert (out.graph.entities.count(), out.graph.relations.count(), out.errors.count()) == (1, 0, 0)


def test_unusable_vectors_meet_none(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 2)
    nan, inf = float("nan"), float("inf")
    rows = [("k", 1, [1.0, 0.0]), ("k", 2, [1.0, 0.1]), ("k", 3, [1.0, 0.2]), ("k", 4, [nan, 1.0]), ("k", 5, [None, 1.0]), ("k", 6, [inf, 1.0]), ("k", 7, [0.0, 0.0]), ("k", 8, None), (None, 9, [1.0, 0.0]), (None, 10, [1.0, 0.0])]
    got = blocks.nearest_pairs(spark.createDataFrame(rows, "key string, id long, v array<double>"), 0.5, 5)
    assert sorted((r.key or "", r.a, r.b) for r in got.collect()) == [("", 9, 10), ("k", 1, 2), ("k", 1, 3), ("k", 2, 3)]
