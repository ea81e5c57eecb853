"""Review rows carried out together against one by one."""

import random

import pytest

from knotwork.operators import applying
from knotwork.sources.views import Graph

FACTS = "id long, memory_entity_id long, content string, status string, obsoleted_at timestamp, source string, confidence double"
EDGES = "id long, from_entity_id long, to_entity_id long, relation_type string"


def graph(spark, kinds, owners, edges):
    entities = spark.createDataFrame([(i, f"n{i}", t, None) for i, t in kinds.items()], "id long, name string, entity_type string, aliases string")
    facts = spark.createDataFrame([(i, m, f"o{i}", "active", None, None, None) for i, m in owners.items()], FACTS)
    return Graph(entities, facts, spark.createDataFrame([(i, *e) for i, e in edges.items()], EDGES))


def one_by_one(kinds, owners, edges, rows, first):
    """State and outcomes of a plain loop; edges: id -> (from, to, type)."""
    kinds, edges = dict(kinds), dict(edges)
    facts = {i: (m, "active", None) for i, m in owners.items()}
    done = {}

    def below(node):
        seen, new = {node}, {node}
        while new:
            new = {f for f, t, r in edges.values() if r == "part_of" and t in new} - seen
            seen |= new
        return seen

    for i, position, kind, a, b, label in sorted(rows, key=lambda r: r[1]):
        ok = False
        if kind == "entity_merge" and a in kinds and b in kinds and a != b and kinds[a] == kinds[b] != "Project":
            ok = True
            moved = {k: (b if f == a else f, b if t == a else t, r) for k, (f, t, r) in edges.items()}
            kept = {}
            for k in sorted(moved, key=lambda k: (moved[k] != edges[k], k)):
                f, t, r = moved[k]
                if f != t and moved[k] not in kept.values():
                    kept[k] = moved[k]
            edges = kept
            facts = {k: (b if m == a else m, *x) for k, (m, *x) in facts.items()}
            del kinds[a]
        elif kind in applying.MOVES and a in kinds and b in kinds and a != b and b not in below(a):
            ok = True
            edges = {k: e for k, e in edges.items() if not (e[0] == a and e[2] == "part_of")} | {first + position: (a, b, "part_of")}
        elif kind == "relationship_proposal" and a in kinds and b in kinds and a != b and (a, b, label) not in edges.values():
            if label != "part_of" or (not any(e[0] == a and e[2] == "part_of" for e in edges.values()) and b not in below(a)):
                ok = True
                edges[first + position] = (a, b, label)
        elif kind in ("delete_relation", "relation_integrity"):
            ok = edges.pop(a, None) is not None
        elif kind == "delete_entity" and kinds.get(a, "Project") != "Project":
            ok = True
            del kinds[a]
            edges = {k: e for k, e in edges.items() if a not in e[:2]}
            facts = {k: x for k, x in facts.items() if x[0] != a}
        elif kind == "delete_observation" and a in facts:
            ok = True
            facts[a] = (facts[a][0], "obsolete", facts[a][2])
        elif kind == "move_observation" and a in facts and b in kinds:
            ok = True
            if facts[a][0] != b:
                facts[first + position] = (b, "active", f"moved from {a}")
                facts[a] = (facts[a][0], "obsolete", facts[a][2])
        done[i] = done.get(i, False) or ok
    return kinds, facts, edges, done


@pytest.mark.parametrize("seed", range(2))
def test_rows_against_one_by_one(spark, seed):
    rng = random.Random(seed)
    kinds = {i: rng.choice(["Project", "Task", "Task", "Task", "Tool"]) for i in range(24)}
    owners = {i: rng.randrange(24) for i in range(100, 130)}
    edges, used = {}, set()
    for k in range(200, 230):
        a, b = rng.sample(range(24), 2)
        e = (max(a, b), min(a, b), rng.choice(["part_of", "part_of", "relates_to"]))
        if e not in used:
            used.add(e)
            edges[k] = e
    rows = []
    for p in range(30):
        kind = rng.choice(["entity_merge", "relationship_proposal", "orphan_parent", "reparent_entity", "delete_relation", "relation_integrity", "delete_entity", "delete_observation", "move_observation"])
        a, b, label = rng.randrange(26), rng.randrange(26), None
        if kind in ("delete_observation", "move_observation"):
            a = rng.randrange(99, 131)
        elif kind in ("delete_relation", "relation_integrity"):
            a = rng.randrange(199, 231)
        elif kind == "relationship_proposal":
            label = rng.choice(["part_of", "relates_to"])
        rows.append((p if kind != "relation_integrity" else p - p % 2, p, kind, a, b, label))
    want = one_by_one(kinds, owners, edges, rows, 1000)
    rng.shuffle(rows)
    g, told = applying.apply_rows(graph(spark, kinds, owners, edges), spark.createDataFrame(rows, applying.ROWS), 1000, "2024-06-01")
    assert {r.id: r.entity_type for r in g.entities.collect()} == want[0]
    assert {r.id: (r.memory_entity_id, r.status, r.source) for r in g.observations.collect()} == want[1]
    assert {r.id: (r.from_entity_id, r.to_entity_id, r.relation_type) for r in g.relations.collect()} == want[2]
    assert {r.id: r.done for r in told.collect()} == want[3]


def test_reading_rows(spark):
    rows = [
        (1, 1, "entity_merge", '{"entity_a": {"entity_id": 5}, "entity_b": {"entity_id": 6}}', '{"target_id": "7"}'),
        (2, 2, "relation_integrity", '{"payload": {"keep_id": 3, "delete_ids": [3, 4, 5]}}', None), (3, 3, "relation_integrity", '{"delete_id": 9}', None),
        (4, 4, "move_observation", '{"payload": {"observation_id": 8, "target_entity_id": 2}}', None), (5, 5, "relationship_proposal", '{"from_id": 1, "to_id": 2, "relation_type": "requires"}', None), (6, 6, "other", "{", None),
    ]
    got = applying.read(spark.createDataFrame(rows, "id long, position long, kind string, payload string, edited string")).collect()
    assert sorted(((r.id, r.a, r.b, r.label) for r in got), key=str) == [(1, 5, 7, None), (2, 4, None, None), (2, 5, None, None), (3, 9, None, None), (4, 8, 2, None), (5, 1, 2, "depends_on"), (6, None, None, None)]


def test_no_rows(spark):
    g = graph(spark, {1: "Task"}, {5: 1}, {9: (1, 1, "relates_to")})
    after, told = applying.apply_rows(g, spark.createDataFrame([], applying.ROWS), 1, "2024-06-01")
    assert after.entities.count() == 1 and told.count() == 0


def test_what_rows_do_not_touch_is_not_written_in_rounds(spark, monkeypatch):
    """each round wrote the whole graph; far repeats and loops still go where entities are merged."""
    far = {1000 + k: (500 + k, 900, "relates_to") for k in range(300)} | {2000: (500, 900, "relates_to"), 2001: (501, 501, "relates_to")}
    kinds = {1: "Task", 2: "Task", 3: "Task", 900: "Tool"} | {500 + k: "Tool" for k in range(300)}
    owners = {100: 1} | {5000 + k: 500 + k for k in range(300)}
    edges = {1: (1, 2, "part_of"), 2: (900, 1, "relates_to")} | far
    rows = [(1, 1, "reparent_entity", 1, 3, None), (2, 2, "entity_merge", 1, 2, None), (3, 3, "delete_observation", 100, None, None)]
    most, write = [], applying.kept
    monkeypatch.setattr(applying, "kept", lambda df: most.append((out := write(df)).count()) or out)
    g, told = applying.apply_rows(graph(spark, kinds, owners, edges), spark.createDataFrame(rows, applying.ROWS), 9000, "2024-06-01")
    assert max(most) < 20
    left, facts, now, done = one_by_one(kinds, owners, edges, rows, 9000)
    assert {r.id for r in g.entities.collect()} == set(left)
    assert {r.id: (r.from_entity_id, r.to_entity_id, r.relation_type) for r in g.relations.collect()} == now
    assert {r.id: (r.memory_entity_id, r.status) for r in g.observations.collect()} == {k: v[:2] for k, v in facts.items()}
    assert {r.id: r.done for r in told.collect()} == done and 2000 not in now and 2001 not in now
