"""Search for many queries at once against scoring each entity by a plain loop."""

import random
import re

import pytest

from knotwork.operators import blocks, projects
from knotwork.operators.postings import search_each
from knotwork.operators.search import FIELDS


def one_by_one(entities, query, limit):
    found = []
    needles = list(dict.fromkeys(query.lower().split()))
    for i, kind, name, aliases in entities:
        low, score, hits, fields = [(x or "").lower() for x in (kind, name, aliases)], 0.0, 0, set()
        for t in needles:
            here = [k for k in range(3) if t in low[k]]
            hits += bool(here)
            for k in here:
                fields.add(FIELDS[k][0])
                score += FIELDS[k][1] + (FIELDS[k][2] if t in re.split(r"[\s,|]+", low[k]) else 0)
        if hits:
            found.append((-(score + (3.0 * (hits - 1) if hits > 1 else 0)), low[0], low[1], i, fields))
    return [(i, -s, f) for s, _, _, i, f in sorted(found, key=lambda r: r[:4])[:limit]]


@pytest.mark.parametrize("common", [0, 3, 20, 1000])
def test_search_each(spark, common):
    random.seed(common)
    kinds, parts = ["Task", "Tool", "Task list", "User"], ["ab", "Abc", "task", "x9", "tool", "é", "u", "zz"]
    pick = lambda n: " ".join(random.choices(parts, k=n))
    entities = [(i, random.choice(kinds), pick(random.randint(1, 3)), random.choice([None, pick(1), pick(2).replace(" ", ",")])) for i in range(150)]
    entities += [(900, "Tool", "only one", None), (901, "User", "", "one|two")]
    queries = [(k, " ".join(random.choices([*parts, "task", "one", "absent", "Bc"], k=random.randint(1, 4)))) for k in range(40)] + [(50, ""), (51, "  "), (52, "task task"), (53, "absent"), (54, "task only")]
    e = spark.createDataFrame(entities, "id long, entity_type string, name string, aliases string")
    got = {}
    for r in search_each(spark.createDataFrame(queries, "key long, query string"), e, 5, common).collect():
        got.setdefault(r.key, []).append((r.place, r.id, r.score, set(r.matched)))
    for key, query in queries:
        assert [r[1:] for r in sorted(got.get(key, []), key=lambda r: r[0])] == one_by_one(entities, query, 5), query


def test_search_each_of_nothing(spark):
    e = spark.createDataFrame([(1, "Task", "a", None)], "id long, entity_type string, name string, aliases string")
    q = spark.createDataFrame([(1, "task")], "key long, query string")
    assert search_each(q.limit(0), e).count() == 0
    assert search_each(q, e.limit(0)).count() == 0


@pytest.mark.parametrize("few", [1, 20_000])
def test_rarest_units(spark, monkeypatch, few):
    monkeypatch.setattr(blocks, "FEW_UNITS", few)
    texts = [(1, "red green blue"), (2, "green"), (3, None), (4, ""), (5, "a redgreen b"), (6, "Blue  GREEN")]
    needles = ["green", "red green", "ed", "blue", "absent", " ", "green b"]
    t = spark.createDataFrame(texts, "text_id long, text string")
    got = {(r.needle, r.text_id) for r in blocks.containing(t, spark.createDataFrame([(n,) for n in needles], "needle string")).collect()}
    assert got == {(n, i) for n in needles for i, x in texts if n.strip() and x and n in x}
    met = projects.mentions(t, spark.createDataFrame([("green",), ("blue green",), ("absent",), ("#",)], "term string"))
    assert {(r.term, r.text_id) for r in met.collect()} == {("green", 1), ("green", 2), ("green", 6), ("blue green", 6)}


def test_mentioned_entities_are_counted_once_a_text(spark):
    met = [("brand#1", "x"), ("steel", "x"), ("brand#1", "y"), ("iron", "z")]
    names = [(1, "brand#1"), (1, "steel"), (2, "brand#1"), (3, "steel"), (4, "iron"), (5, "lead")]
    out = projects.mentioned(spark.createDataFrame(met, "term string, text_id string"), spark.createDataFrame(names, "id long, term string"))
    assert sorted(map(tuple, out.collect())) == [("x", 3, 1), ("y", 2, 1), ("z", 1, 4)]


def test_search_each_sends_no_entities_to_all_tasks(spark):
    e = spark.createDataFrame([(k, "Task", f"item {k}", "red|blue" if k % 2 else "green") for k in range(40)], "id long, entity_type string, name string, aliases string")
    rows = search_each(spark.createDataFrame([(1, "item red 7"), (2, "green 12")], "key long, query string"), e, 3, common=10)
    assert [(r.key, r.id) for r in rows.orderBy("key", "place").collect()][:4:3] == [(1, 7), (2, 12)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    keys = {re.sub(r"#\d+L?", "", x) for x in re.findall(r"BroadcastHashJoin \[(.*?)\]", plan)}
    assert "SortMergeJoin" in plan and not keys & {"tie", "held"}
