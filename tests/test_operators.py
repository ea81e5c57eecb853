"""Small named fixtures: search, traversal, ranking, mutation, exchange and edge cases."""

import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.functions import vectors as V
from knotwork.operators import blocks, graph, imports, mutate, order, projects, quality, ranking, resolve, scan, search
from knotwork.sources import exchange
from knotwork.sources.views import Graph
from knotwork.streaming import audit

NOW = "2024-06-01 00:00:00"
EDGES = "id long, from_entity_id long, to_entity_id long, relation_type string"
A, B, C, D, E, G6 = 1, 2, 3, 4, 5, 6


@pytest.fixture
def cyclic(spark):
    rows = [(1, A, B, "part_of"), (2, B, C, "depends_on"), (3, C, D, "depends_on"), (4, D, B, "part_of"), (5, A, E, "relates_to")]
    return spark.createDataFrame(rows, EDGES)


@pytest.fixture
def dishes(spark):
    rows = [
        ("Apple Pie", "Dessert", "apple dessert, fruit pie"), ("Banana Bread", "Baked Good", "banana cake, quick bread"), ("Apple Juice", "Beverage", "fruit juice, apple drink"),
        ("Carrot Cake", "Dessert", "vegetable cake, spiced cake"), ("Green Apple", "Fruit", "granny smith, tart apple"), ("Cocktail Mixer", "Beverage Equipment", "drink mixer, bar tool"),
    ]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows, 1)], "id long, name string, entity_type string, aliases string")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def test_text_search(dishes):
    found = search.text_search(dishes, "apple").collect()
    assert [r.name for r in found] == ["Apple Juice", "Apple Pie", "Green Apple"]
    assert len({r.score for r in found}) == 1
    assert search.text_search(dishes, "").collect() == []
    assert search.text_search(dishes.limit(0), "apple").collect() == []


def test_expand_walks_a_cycle_once(spark, cyclic):
    start = ids(spark, A)
    reached = lambda **k: [r.id for r in graph.expand(cyclic, start, **k).orderBy("depth", "first_edge", "id").collect()]
    assert reached(depth=1, direction="outgoing") == [A, B, E]
    assert reached(depth=9) == [A, B, E, C, D]
    assert len(reached(depth=5, cap=3)) == 3
    assert reached(depth=2, types=["relates_to"]) == [A, E]


def test_shortest_path(cyclic):
    path = lambda *a, **k: [r.id for r in graph.shortest_path(cyclic, *a, **k).collect()]
    assert path(A, D, 3, "outgoing") == [A, B, C, D]
    assert path(A, D, 2, "outgoing") == []
    assert path(A, D) == [A, B, D]
    assert path(A, A) == [A]
    assert path(A, G6) == []


def test_subtree_and_loops(spark, cyclic):
    tree = spark.createDataFrame([(1, 2, 1, "part_of"), (2, 3, 2, "part_of"), (3, 4, 2, "part_of"), (4, 1, 4, "part_of")], EDGES)
    assert sorted(r.id for r in graph.project_subtree(tree, ids(spark, 1)).collect()) == [1, 2, 3, 4]
    assert [r.id for r in graph.project_subtree(tree, ids(spark, 1), cap=3).orderBy("depth", "id").collect()] == [1, 2, 3]
    assert graph.would_cycle(tree, 2, 3) and not graph.would_cycle(tree, 3, 2)


def test_walks_have_no_silent_depth(spark):
    chain = spark.createDataFrame([(k, k + 1, k, "part_of") for k in range(1, 71)], EDGES)
    entities = spark.createDataFrame([(k, f"n{k}", "Project" if k == 1 else "Task") for k in range(1, 72)], "id long, name string, entity_type string")
    assert graph.project_subtree(chain, ids(spark, 1), cap=None).agg({"depth": "max"}).first()[0] == 70
    assert graph.would_cycle(chain, 1, 71) and not graph.would_cycle(chain, 71, 1)
    up = graph.ancestor_projects(entities, chain)
    assert up.count() == 71 and {r.project_id for r in up.collect()} == {1}
    facts = observations(spark, [(1, 71, "x", None, None, "active", None, None), (2, 1, "x", None, None, "active", None, None)])
    left = mutate.delete_nodes(Graph(entities, facts, chain), ids(spark, 2), cascade=True)
    assert [r.id for r in left.entities.collect()] == [1] and [r.id for r in left.observations.collect()] == [2] and left.relations.count() == 0
    assert [(r.id, r.position) for r in graph.walk_order(entities, chain).orderBy("position").collect()] == [(k, k) for k in range(1, 72)]


def test_ancestors_of_loops_and_roots(spark):
    edges = spark.createDataFrame([(1, 2, 3, "part_of"), (2, 3, 2, "part_of"), (3, 4, 5, "part_of"), (4, 6, 1, "part_of"), (5, 7, 6, "part_of"), (6, 8, 8, "part_of"), (7, 9, 99, "part_of")], EDGES)
    entities = spark.createDataFrame([(k, "Project" if k == 1 else "Task") for k in range(1, 10)], "id long, entity_type string")
    assert sorted((r.id, r.project_id) for r in graph.ancestor_projects(entities, edges).collect()) == [(1, 1), (6, 1), (7, 1)]


def test_truncated_walks_are_told(spark, cyclic):
    reached = graph.expand(cyclic, ids(spark, A), 5, cap=3)
    assert graph.truncated(cyclic, reached, 5)
    assert not graph.truncated(cyclic, graph.expand(cyclic, ids(spark, A), 5), 5)


def observations(spark, rows):
    kinds = "id long, memory_entity_id long, content string, confidence double, source string, status string, valid_from timestamp, valid_until timestamp"
    return spark.createDataFrame(rows, kinds)


def test_trust(spark, cyclic):
    day = lambda s: __import__("datetime").datetime.fromisoformat(s)
    rows = [
        (1, 9, "x", 0.2, None, "active", None, None), (2, 9, "x", 0.9, None, "active", None, None), (3, 9, "x", None, "official docs", "active", None, None),
        (4, 9, "x", None, "some_blog", "active", None, None), (5, 9, "x", 0.9, None, "active", None, day("2020-01-01")), (6, 9, "x", 0.8, None, "active", day("2030-01-01"), None),
        (7, A, "x", 0.5, None, "active", None, None), (8, 9, "x", 0.5, None, "active", None, None), (9, 9, "x", 1.0, None, "obsolete", None, None),
    ]
    score = {r.id: r.trust_score for r in ranking.trust_scores(observations(spark, rows), cyclic, NOW).collect()}
    assert score[2] > score[1] and score[3] > score[4] and score[5] == 0 and score[6] == 0.4 and score[7] > score[8] == 0.5 and score[9] == 0
    assert [r.id for r in ranking.rank_observations(observations(spark, rows), cyclic, NOW, limit=1).collect()] == [2]


def test_tokens_polarity_and_aliases(spark):
    row = spark.range(1).select(
        T.tokens(F.lit("Night-Bus: the timetable of a city")).alias("t"), T.negative(F.lit("The lift is not in service")).alias("n"), T.negative(F.lit("The lift is in service")).alias("p"),
        T.alias_list(F.lit(" Brand#20|LARGE0; 0 ,,")).alias("a"), T.alias_list(F.lit(None).cast("string")).alias("none"),
    ).first()
    assert row.t == ["night", "bus", "timetable", "city"] and row.n and not row.p
    assert row.a == ["Brand#20", "LARGE0", "0"] and row.none == []


def test_vector_distance(spark):
    d = lambda a, b: spark.range(1).select(V.cosine_distance(V.literal(a), V.literal(b)).alias("d")).first().d
    assert d([1.0, 0.0], [1.0, 0.0]) == pytest.approx(0) and d([0.0, 1.0, 0.0], [0.0, 0.8, 0.6]) == pytest.approx(0.2)
    assert d([0.0, 0.0], [1.0, 0.0]) is None


def test_merge_moves_everything(spark, cyclic):
    entities = spark.createDataFrame([(k, n, "Task", a) for k, n, a in ((A, "a", "x,y0"), (B, "b", "y0|z"), (C, "c", None), (D, "d", None), (E, "e", None))], "id long, name string, entity_type string, aliases string")
    facts = observations(spark, [(1, B, "fact", None, None, "active", None, None)])
    out = mutate.merge(Graph(entities, facts, cyclic), spark.createDataFrame([(B, A)], "source long, target long"))
    assert {r.id: r.aliases for r in out.entities.collect()} == {A: "x, y0, z, b", C: None, D: None, E: None}
    assert [r.memory_entity_id for r in out.observations.collect()] == [A]
    assert sorted((r.id, r.from_entity_id, r.to_entity_id) for r in out.relations.collect()) == [(2, A, C), (3, C, D), (4, D, A), (5, A, E)]


def test_refused_mutations(spark, cyclic):
    entities = spark.createDataFrame([(A, "a", "Task"), (B, "b", "Project")], "id long, name string, entity_type string")
    g = Graph(entities, observations(spark, []), cyclic)
    with pytest.raises(ValueError):
        mutate.bulk(g)
    with pytest.raises(ValueError):
        mutate.bulk(g, entities=spark.createDataFrame([(7, "a", "Task")], "id long, name string, entity_type string"))
    with pytest.raises(ValueError):
        mutate.move_to_parent(g, B, A, 99)


def test_integrity_of_empty_and_dirty_edges(spark):
    none = spark.createDataFrame([], EDGES)
    assert quality.duplicate_relations(none).collect() == [] and quality.reverse_pairs(none).collect() == [] and quality.multi_parent(none).collect() == []
    dirty = spark.createDataFrame([(1, A, B, "part_of"), (2, A, B, "part_of"), (3, A, C, "part_of"), (4, None, B, "part_of")], EDGES)
    assert quality.duplicate_relations(dirty).count() == 1 and quality.multi_parent(dirty).count() == 1


def test_lines_round_trip(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    lines = [
        json.dumps({"type": "entity", "name": "one", "entityType": "Task", "observations": ["x", "y"]}), json.dumps({"type": "entity", "name": "two", "entityType": "Task", "observations": []}),
        json.dumps({"type": "relation", "from": "one", "to": "two", "relationType": "part_of"}), json.dumps({"type": "relation", "from": "one", "to": "gone", "relationType": "part_of"}), "not json", json.dumps({"type": "other"}),
    ]
    source.write_text("\n".join(lines))
    entities, facts, edges = exchange.read_lines(spark, str(source))
    assert (entities.count(), facts.count(), edges.count()) == (2, 2, 1)


def test_pages(spark):
    rows = spark.range(1, 46)
    assert [r.id for r in scan.paged(rows, 3, 20).collect()] == [41, 42, 43, 44, 45]
    assert scan.page_totals(rows, 20).first().total_pages == 3 and scan.page_totals(rows.limit(0), 20).first().total_pages == 1


def test_nearest_pairs_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = [(k % 2 if k % 11 else None, k, rng.normal(size=3 if k % 13 else 4).tolist()) for k in range(80)]
    rows += [(0, 200 + k, [1.0, 2.0, 3.0]) for k in range(5)]
    for later in (True, False):
        got = {}
        for r in sorted(blocks.nearest_pairs(spark.createDataFrame(rows, "key int, id long, v array<double>"), 0.9, 3, later).collect(), key=lambda r: (r.a, round(r.distance, 9), r.b)):
            got.setdefault((r.key, r.a), []).append(r.b)
        want = {}
        for k, i, v in rows:
            x, near = np.array(v), []
            for l, j, w in rows:
                if l == k and len(w) == len(v) and (j > i if later else j != i):
                    d = 1 - x @ np.array(w) / np.linalg.norm(x) / np.linalg.norm(w)
                    near += [(round(d, 9), j)] if d < 0.9 else []
            if near:
                want[k, i] = [j for _, j in sorted(near)[:3]]
        assert got == want
    assert blocks.nearest_pairs(spark.createDataFrame([], "key int, id long, v array<double>"), 1.0, 3).count() == 0


def test_shared_words_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "WORD_BLOCK", 6)
    monkeypatch.setattr(blocks, "COLUMNS", 8)
    rng = random.Random(4)
    made = lambda n: [(rng.randrange(n), rng.sample([f"w{k}" for k in range(40)], rng.randrange(12))) for _ in range(n)]
    left, right = made(20), made(25)
    frame = lambda rows: spark.createDataFrame(rows, "id long, words array<string>")
    got = {}
    for r in sorted(blocks.shared_words(frame(left), frame(right), 2, 3).collect(), key=lambda r: (r.left_id, -r.shared, r.right_id)):
        got.setdefault(r.left_id, []).append((r.right_id, r.shared))
    want = {}
    for i in {i for i, _ in left}:
        best = {}
        for k, x in left:
            for j, y in right:
                if k == i and len(set(x) & set(y)) >= 2:
                    best[j] = max(best.get(j, 0), len(set(x) & set(y)))
        if best:
            want[i] = sorted(best.items(), key=lambda b: (-b[1], b[0]))[:3]
    assert got == want
    assert blocks.shared_words(frame([]), frame(right), 2, 3).count() == 0


def test_grams_are_found_by_slots(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK", 30)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abéß𝄞\u2028", k=rng.randrange(1, 9)))
    texts = [(k, rng.choice([" ", "\t ", "\n"]).join(word() for _ in range(rng.randrange(9)))) for k in range(80)] + [(90, None), (91, ""), (92, " \n")]
    units = sorted({word()[: rng.choice([1, 2, 3, 8])] for _ in range(60)})
    got = blocks._grams_held(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame([(u,) for u in units], "unit string"), [1, 2, 3, 4, 5, 6, 7, 8])
    assert sorted((r.text_id, r.unit) for r in got.collect() if r.unit in units) == sorted((k, u) for k, t in texts if t for u in units if u in t)


def shuffled(spark):
    """Rows that all stages so far have shuffled."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_equal_texts_are_looked_up_once(spark):
    o = spark.range(20_000).selectExpr("id", "id % 3 AS memory_entity_id", "'It depends on Ab and cd.' AS content", "'active' AS status")
    e = spark.createDataFrame([(1, "AB", "cd|x", "Tool"), (2, "Cd.", None, "Tool"), (7, "abc", "n", "Tool"), (8, "and", "ab and", "Project"), (9, "depends", "on Ab,on", "Tool")], "id long, name string, aliases string, entity_type string")
    before = shuffled(spark)
    got = sorted(map(tuple, resolve.dependency_links(o, e, 2).collect()))
    assert got == [(f, t) for f in range(3) for t in (1, 2, 9) if f != t]
    assert shuffled(spark) - before < 5_000


def test_hierarchy_orphans_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(order, "PART_ROWS", 100)
    e = spark.range(1000).selectExpr("id", "concat('n', id) AS name", "IF(id < 5, 'Project', 'Task') AS entity_type")
    r = spark.range(0, 1000, 2).selectExpr("id + 5000 AS id", "id AS from_entity_id", "1L AS to_entity_id", "'part_of' AS relation_type")
    got = graph.hierarchy_orphans(e, r)
    assert sorted(x.id for x in got.collect()) == list(range(5, 1000, 2))
    assert got.rdd.getNumPartitions() >= 14


def test_usage_targets_meet_entities_once(spark):
    e = spark.createDataFrame([(k, f"name{k}", None, "Tool") for k in range(3)], "id long, name string, aliases string, entity_type string")
    r = spark.range(20_000).selectExpr("id", "id + 10 AS from_entity_id", "id % 3 AS to_entity_id", "'depends_on' AS relation_type")
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = projects.absent_targets(r, e, spark.createDataFrame([(1, "has name1")], "text_id long, text string")).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sum(k % 3 != 1 for k in range(20_000))
    assert shuffled(spark) - before < 30_000


def test_codes_are_packed():
    rows = [[], [0], [127, 128, 200], [5, 16_388, 3_000_000, 400_000_000], [], [0, 1, 2, 3]]
    batch = pa.record_batch([pa.array([0] * 6), pa.array(range(6)), pa.array(range(6)), pa.array(rows, pa.list_(pa.int32()))], names=["side", "row", "id", "codes"])
    out = next(blocks._packed(iter([batch.slice(1)])))
    codes, starts = blocks._unpacked(out.column("codes").slice(1))
    assert [codes[a:b].tolist() for a, b in zip(starts, starts[1:])] == rows[2:]
    assert out.column("n").to_pylist() == [len(r) for r in rows[1:]] and len(out.column("codes")[4].as_py()) == 4


def test_left_blocks_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_CODES", 1_000)
    monkeypatch.setattr(blocks, "WORD_BLOCK", 100)
    rows = spark.range(1500).selectExpr("id", "transform(sequence(1, 8), k -> concat('w', pmod(xxhash64(id, k), 50))) AS words")
    best = blocks.shared_words(rows, rows.limit(500).select((F.col("id") + 5000).alias("id"), "words"), 2, 3)
    assert "j#" in (plan := best._jdf.queryExecution().executedPlan().toString())
    assert re.search(r"hashpartitioning\(i#\d+L?, j#\d+L?, (\d+)\)", plan)[1] == "25"  # left blocks are five at most
    assert best.count() == 4500


def test_shared_words_travel_to_few_blocks(spark):
    rows = spark.range(1500).selectExpr("id", "transform(sequence(1, 8), k -> concat('w', pmod(xxhash64(id, k), 50))) AS words")
    blocks.WORD_BLOCK, held = 10, blocks.WORD_BLOCK
    try:
        before = shuffled(spark)
        assert blocks.shared_words(rows, rows.select((F.col("id") + 5000).alias("id"), "words"), 2, 3).count() == 4500
        assert shuffled(spark) - before < 150_000
    finally:
        blocks.WORD_BLOCK = held


def test_containing_against_all_pairs(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    texts = [(k, text(rng.randrange(30))) for k in range(60)] + [(60, None), (61, "")]
    for least in (1, 2, 4):
        needles = [(text(rng.randrange(least, least + 3)),) for _ in range(40)]
        got = sorted(map(tuple, blocks.containing(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(needles, "needle string")).collect()))
        assert got == sorted((n, k) for n in {n for (n,) in needles if n.strip()} for k, t in texts if t and n in t)


def test_numbered_over_many_partitions(spark):
    rows = spark.createDataFrame([(k * 37 % 101, k % 5) for k in range(101)], "id long, g int").repartition(7)
    got = [(r.position, r.g, r.id) for r in order.numbered(rows, F.desc("g"), F.asc("id")).orderBy("position").collect()]
    assert [p for p, _, _ in got] == list(range(1, 102)) and [(-g, i) for _, g, i in got] == sorted((-g, i) for _, g, i in got)
    assert order.numbered(rows.limit(0), F.asc("id")).count() == 0


def test_integrity_sweep(spark):
    entities = spark.createDataFrame([(A,), (B,)], "id long")
    edges = spark.createDataFrame([(1, A, B, "part_of"), (2, A, B, "part_of"), (3, A, C, "part_of"), (4, B, A, "part_of")], EDGES)
    facts = observations(spark, [(1, A, "x", None, None, "active", None, None), (2, A, "x", None, None, "active", None, None), (3, A, "x", None, None, "obsolete", None, None)])
    _, kept_facts, kept_edges = quality.repaired(entities, facts, edges)
    assert sorted(r.id for r in kept_facts.collect()) == [1, 3] and sorted(r.id for r in kept_edges.collect()) == [1, 4]
    assert [(r.keep_id, r.delete_id) for r in quality.reverse_pairs(edges).collect()] == [(1, 4)]
    assert [(r.from_entity_id, r.keep_id, r.delete_id) for r in quality.merge_collisions(edges).orderBy("delete_id").collect()] == [(A, 1, 2), (A, 1, 3)]


def test_lines_written_are_read_back(spark, tmp_path):
    entities = spark.createDataFrame([(1, "one", "Task"), (2, "two", "Tool")], "id long, name string, entity_type string")
    facts = observations(spark, [(1, 1, "x", None, None, "active", None, None), (2, 1, "y", None, None, "active", None, None)])
    edges = spark.createDataFrame([(1, 1, 2, "part_of")], EDGES)
    exchange.write_lines(entities, facts, edges, str(tmp_path / "out"))
    e, o, r = exchange.read_lines(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, e.collect())) == [("one", "Task"), ("two", "Tool")]
    assert sorted(map(tuple, o.collect())) == [("one", "x"), ("one", "y")] and [(x.from_name, x.to_name, x.relation_type) for x in r.collect()] == [("one", "two", "part_of")]


def test_contents_of_names_on_one_line_are_not_shuffled(spark, tmp_path):
    """F8: lines were written plain, and every content was made distinct by a shuffle."""
    entities = spark.createDataFrame([(1, "one", "Task"), (2, "two", "Tool")], "id long, name string, entity_type string")
    facts = observations(spark, [(k, 1, c, None, None, "active", None, None) for k, c in enumerate("xxyz")])
    exchange.write_lines(entities, facts, spark.createDataFrame([(1, 1, 2, "part_of"), (2, 1, 2, "part_of")], EDGES), str(tmp_path / "out"))
    assert list((tmp_path / "out").glob("*.gz")) and not list((tmp_path / "out").glob("part-*.txt"))
    _, o, r = exchange.read_lines(spark, str(tmp_path / "out"))
    assert "Exchange" not in o._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, o.collect())) == [("one", "x"), ("one", "y"), ("one", "z")] and r.count() == 1
    line = lambda name, *contents: json.dumps({"type": "entity", "name": name, "entityType": "Task", "observations": contents})
    (tmp_path / "in.jsonl").write_text("\n".join([line("one", "x", "x", "y"), line("two", "x", "x"), line("one", "y", "z")]))
    _, o, _ = exchange.read_lines(spark, str(tmp_path / "in.jsonl"))
    assert sorted(map(tuple, o.collect())) == [("one", "x"), ("one", "y"), ("one", "z"), ("two", "x")]


def test_order_lines_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """partitions joined by bytes gave one task millions of small keys to hold."""
    from knotwork.sources import views

    monkeypatch.setattr(views, "LINES_EACH", 500)
    lines = [r for r in views.relations(spark, "/root/testdata/sf0.001").where("relation_type = 'depends_on'").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if r]
    assert len(lines) > 4 and max(lines) < 1500


def test_boosts_of_many_ids_are_those_of_few(spark, monkeypatch):
    """ends of edges met many scored ids row by row, in partitions joined by bytes."""
    entities = spark.createDataFrame([(k, f"n{k}", "Task") for k in range(40)], "id long, name string, entity_type string")
    edges = spark.createDataFrame([(k, k % 7, k % 11 + 60 * (k % 2), "uses") for k in range(60)], EDGES)
    ids = entities.where("id < 30").select("id")
    few = search.rank_entity_ids(ids, entities, edges, "n1").collect()
    monkeypatch.setattr(search, "MANY_IDS", 5)
    monkeypatch.setattr(search, "IDS_EACH", 3)
    many = search.boosted(ids.withColumn("score", F.lit(0.0)), entities, edges, "n1", floor=0.01)
    assert "REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    assert search.rank_entity_ids(ids, entities, edges, "n1").collect() == few and len(few) == 30


def test_trees_files_and_snapshots(spark, tmp_path):
    tree = {"root_nodes": [{"name": "p", "entity_type": "Project", "observations": ["o", {"content": "q"}], "children": [{"name": "c", "relation_type": "part_of", "children": [{"name": "d"}]}]}]}
    rows = exchange.flatten_tree(spark, json.dumps(tree)).orderBy("node_path").collect()
    assert [(r.node_path, r.parent_path, r.depth, r.name) for r in rows] == [("0", None, 0, "p"), ("0.children.0", "0", 1, "c"), ("0.children.0.children.0", "0.children.0", 2, "d")]
    assert rows[0].observations == ["o", "q"]
    for name, data in (("a.txt", b"hello"), ("b.txt", b"\0bin"), ("c.txt", b"x" * 20), ("d.txt", b"yy")):
        (tmp_path / name).write_bytes(data)
    files = exchange.read_files(spark, str(tmp_path), "*.txt", most_each=10, most_all=7, most_files=5).collect()
    assert sorted(f.content for f in files) == ["hello", "yy"]
    shots = spark.createDataFrame([(f"s{k}", k) for k in range(5)], "path string, created_at int")
    assert sorted(r.path for r in exchange.newest_kept(shots, 2).where("keep").collect()) == ["s3", "s4"]


def test_change_stream(spark, tmp_path):
    source, log = str(tmp_path / "source"), str(tmp_path / "log")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(source)
    events = audit.read_events(spark, source).where("true")
    assert events.isStreaming
    events = spark.readStream.schema(audit.EVENTS).parquet(source)
    audit.append_changes(events, log, str(tmp_path / "mark")).awaitTermination()
    audit.append_changes(events, log, str(tmp_path / "mark")).awaitTermination()  # nothing twice
    assert spark.read.parquet(log).count() == spark.read.parquet(source).count()
    counted = audit.action_counts(spark.readStream.schema(audit.EVENTS).parquet(source))
    query = counted.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "mark2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, audit.action_counts(spark.read.parquet(source)).collect()))


def test_small_text_and_vector_helpers(spark):
    row = spark.range(1).select(
        T.squish(F.lit("  a \n b ")).alias("squish"), T.snake_case(F.lit("HTMLPageView2Go")).alias("snake"), F.rlike(F.lit("see the Night, C++ bus!"), T.phrase_pattern(F.lit("night c++ bus"))).alias("hit"),
        F.rlike(F.lit("nightbus"), T.phrase_pattern(F.lit("night bus"))).alias("miss"), T.compose_observation_text(F.lit("x"), F.lit("blog"), F.lit(None).cast("string")).alias("text"),
        V.parsed(F.lit("[0.5, 2]")).alias("v"), V.or_zero(F.lit(None).cast("array<float>"), 2).alias("zero"), V.has_dim(V.literal([1.0, 2.0]), 2).alias("dim"),
    ).first()
    assert (row.squish, row.snake, row.hit, row.miss, row.text) == ("a b", "html_page_view2_go", True, False, "x\nSource: blog")
    assert row.v == [0.5, 2.0] and row.zero == [0.0, 0.0] and row.dim
    assert [r.id for r in scan.in_order(spark.range(9), [5, 2, 7]).collect()] == [5, 2, 7]


def test_merge_chains_go_to_their_end(spark):
    pairs = lambda *rows: spark.createDataFrame(rows, "source long, target long")
    got = mutate.last_targets(pairs(*[(k, k + 1) for k in range(1, 40)], (90, 40), (91, 92))).collect()
    assert sorted(map(tuple, got)) == [*[(k, 40) for k in range(1, 40)], (90, 40), (91, 92)]
    for bad in (pairs((1, 2), (2, 3), (3, 1)), pairs((1, 2), (1, 3))):
        with pytest.raises(ValueError):
            mutate.last_targets(bad)


def test_one_new_parent_of_a_child(spark, cyclic):
    entities = spark.createDataFrame([(k, f"n{k}", "Task") for k in range(1, 7)], "id long, name string, entity_type string")
    g = Graph(entities, observations(spark, []), cyclic)
    new = spark.createDataFrame([(11, C, E, "part_of"), (10, C, G6, "part_of"), (12, C, G6, "relates_to"), (13, C, E, "relates_to"), (14, C, 99, "relates_to"), (15, A, G6, "part_of")], EDGES)
    assert sorted(r.id for r in mutate.with_relations(g, new).relations.collect()) == [1, 2, 3, 4, 5, 10, 12, 13]


def test_import_is_carried_out(spark):
    entities = spark.createDataFrame([(1, "p", "Project"), (2, "c", "Task"), (3, "q", "Project")], "id long, name string, entity_type string")
    edges = spark.createDataFrame([(1, 2, 3, "part_of")], EDGES)
    kinds = "node_path string, parent_path string, name string, entity_type string, relation_type string, parent_to_child boolean, status string, match_id long"
    rows = [("0", None, "p", "Project", None, None, "skip", 1), ("0.children.0", "0", "c", "todo", "child_of", None, "add_relation", 2), ("0.children.1", "0", "new", "bug", None, None, "new", None), ("0.children.1.children.0", "0.children.1", "deep", "Tool", "requires", True, "new", None), ("0.children.2", "0", "new", "bug", None, None, "new", None)]
    out = imports.executed(Graph(entities, observations(spark, []), edges), spark.createDataFrame(rows, kinds), 100).graph
    assert sorted((r.id, r.name, r.entity_type) for r in out.entities.collect())[3:] == [(100, "new", "Issue"), (101, "deep", "Tool")]
    assert sorted((r.from_entity_id, r.to_entity_id, r.relation_type) for r in out.relations.collect()) == [(2, 1, "part_of"), (100, 1, "part_of"), (100, 101, "depends_on")]


def test_duplicates_need_vectors(spark):
    old = spark.createDataFrame([(1, 5, "a", "active", [1.0, 0.0]), (2, 5, "b", "active", None), (3, 6, "c", "active", [1.0, 0.0])], "id long, memory_entity_id long, content string, status string, embedding array<double>")
    new = lambda *rows: spark.createDataFrame(rows, "key long, memory_entity_id long, content string, embedding array<double>")
    got = imports.duplicate_contents(new((1, 5, "a", None), (2, 5, " ", None), (3, 6, "x", [0.9, 0.1]), (4, 6, "y", [0.0, 1.0]), (5, 7, "z", [0.0, 1.0])), old).orderBy("key").collect()
    assert [(r.duplicate, r.observation_id, r.exact) for r in got] == [(True, 1, True), (False, None, False), (True, 3, False), (False, 3, False), (False, None, False)]
    with pytest.raises(ValueError):
        imports.duplicate_contents(new((6, 5, "n", [1.0, 0.0])), old)


def test_bulk_adds_all(spark, cyclic):
    entities = spark.createDataFrame([(k, f"n{k}", "Task") for k in range(1, 7)], "id long, name string, entity_type string")
    g = Graph(entities, observations(spark, [(1, A, "x", None, None, "active", None, None)]), cyclic)
    out = mutate.bulk(g, spark.createDataFrame([(7, "new", "Task")], "id long, name string, entity_type string"), observations(spark, [(2, 7, "y", None, None, "active", None, None)]), spark.createDataFrame([(9, 7, A, "part_of")], EDGES))
    assert (out.entities.count(), out.observations.count(), out.relations.count()) == (7, 2, 6)
    with pytest.raises(ValueError):  # one bad row rejects the batch
        mutate.bulk(g, spark.createDataFrame([(7, "new", "Task")], "id long, name string, entity_type string"), observations(spark, [(2, 99, "y", None, None, "active", None, None)]))


def test_best_matches_are_the_first_of_all_matches(spark):
    orphans = [(k, f"part #{k * 7 % 60}", "Component", None, f"size {k % 12}") for k in range(90)]
    projects = [(k, f"Customer#{k:05d}", "size" if k % 3 else None) for k in range(80)]
    o = spark.createDataFrame(orphans, "id long, name string, entity_type string, aliases string, description string")
    p = spark.createDataFrame(projects, "id long, name string, aliases string")
    facts = spark.createDataFrame([], "id long, memory_entity_id long, content string, status string")
    want = {}
    for r in resolve.orphan_matches(o, p, facts).collect():
        want.setdefault(r.id, []).append((-r.score, r.project_id))
    got = {}
    for r in resolve.best_matches(o, p, facts).collect():
        got.setdefault(r.id, []).append((-r.score, r.project_id))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:2] for k, v in want.items()}


def broadcast_keys(df) -> set[str]:
    """Keys of the joins of a plan that send a side to the driver and every task."""
    lines = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x]
    return {re.sub(r"#\d+L?", "", re.search(r"BroadcastHashJoin \[(.*?)\]", x)[1]) for x in lines}


@pytest.mark.parametrize("deal", [5, 1000])
def test_best_matches_send_no_growing_side_to_all_tasks(spark, monkeypatch, deal):
    monkeypatch.setattr(resolve, "DEAL", deal)
    monkeypatch.setattr(resolve, "SCORED_EACH", 100, raising=False)
    orphans = [(k, f"part #{k * 7 % 60}", "Component", None, f"size {k % 12}") for k in range(90)]
    # names that repeat, in either case, with aliases that are null or blank
    projects = [(k, (None, f"Customer#{k % 20:05d}", f"customer#{k % 20:05d}")[k % 3 if k % 7 else 0], ("size", None, "")[k % 3]) for k in range(120)]
    o = spark.createDataFrame(orphans, "id long, name string, entity_type string, aliases string, description string")
    p = spark.createDataFrame(projects, "id long, name string, aliases string")
    facts = spark.createDataFrame([(1, 3, "rings of size 11", "active"), (2, 3, "omer 00", "active")], "id long, memory_entity_id long, content string, status string")
    want, got = {}, {}
    for r in resolve.orphan_matches(o, p, facts).collect():
        want.setdefault(r.id, []).append((-r.score, r.project_id))
    best = resolve.best_matches(o, p, facts)
    for r in best.collect():
        got.setdefault(r.id, []).append((-r.score, r.project_id))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:2] for k, v in want.items()}
    assert broadcast_keys(best) <= {"t"}  # words that very many projects hold
    texts, needles = p.selectExpr("id AS text_id", "lower(name) AS text"), o.selectExpr("lower(name) AS needle").unionAll(o.selectExpr("'omer'"))
    assert broadcast_keys(blocks.containing(texts, needles)) <= {"unit"}  # few units


@pytest.mark.parametrize("block", [7, 1000])
def test_contradictions_of_alike_entities_are_searched_once(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "ASK_BLOCK", block, raising=False)
    rng = np.random.default_rng(block)
    # few values, so that vectors repeat and distances tie
    facts = [(k, k % 3, "it is not so" if rng.random() < 0.4 else "it is so", "active", [float(x) for x in rng.integers(-1, 2, 3)]) for k in range(60)]
    facts += [(90, 0, "not", "old", [1.0, 1.0, 1.0]), (91, 1, "not", "active", None), (92, 2, "never", "active", [1.0, 0.0])]
    o = spark.createDataFrame(facts, "id long, memory_entity_id long, content string, status string, embedding array<float>")
    edges = [(1, 10, 0), (2, 1, 10), (3, 11, 1), (4, 0, 11), (5, 12, 2), (6, 12, 12), (7, 0, 2)] + [(20 + k, 100 + k, 2) for k in range(30)]
    r = spark.createDataFrame(edges, "id long, from_entity_id long, to_entity_id long")
    held = {}
    for _, x, y in edges:
        held.setdefault(x, {x}).add(y)
        held.setdefault(y, {y}).add(x)
    want = set()
    for e, near in held.items():
        rows = [(i, "not" in c or "never" in c, np.array(v)) for i, m, c, s, v in facts if m in near and s == "active" and v and any(v)]
        found = {}
        for i, n, v in rows:
            others = [(round(1 - float(v @ w) / float(np.sqrt((v @ v) * (w @ w))), 12), j, m) for j, m, w in rows if j != i and len(v) == len(w)]
            for d, j, m in sorted(x for x in others if x[0] < 0.9)[:4]:
                if n != m:
                    found[min(i, j), max(i, j)] = d
        best = sorted((-round(min((1 - d) * 1.1, 0.99), 4), *ij, round(d, 6)) for ij, d in found.items())[:4]
        want |= {(e, a, b, d, -c) for c, a, b, d in best}
    got = [tuple(x) for x in resolve.contradictions(o, r, None, 0.9, 4).collect()]
    near = lambda rows: sorted((e, a, b, round(d, 5), round(c, 4)) for e, a, b, d, c in rows)
    assert near(got) == near(want) and len(want) > 100
    some = [tuple(x) for x in resolve.contradictions(o, r, spark.createDataFrame([(0,), (105,), (999,)], "id long"), 0.9, 4).collect()]
    assert near(some) == near(x for x in want if x[0] in (0, 105))


def test_contradictions_let_the_best_pairs_only_leave_a_task(spark):
    v = np.random.default_rng(5).normal(size=(300, 4))
    rows = spark.createDataFrame([(1, 4, 2, k, [float(x) for x in v[k]], k % 2 == 0) for k in range(300)], "key long, dim int, n int, id long, v array<double>, neg boolean")
    assert 6 <= blocks.opposed_pairs(rows, 0.9, 20, 6).count() <= 12  # two blocks


def test_export_paths_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGES_EACH", 20)
    monkeypatch.setattr(graph, "FEW_PATHS", 2)
    e = spark.createDataFrame([(k, "Project" if k == 1 else "Task") for k in [*range(1, 402), 500]], "id long, entity_type string")
    r = spark.createDataFrame([(k, k, 1, "part_of") for k in range(2, 402)] + [(2000 + k, 500, k, "part_of") for k in range(2, 402)] + [(1000, 3, 1, "depends_on"), (1001, 4, 1, "part_of"), (1002, 2, 5, "relates_to")], "id long, from_entity_id long, to_entity_id long, relation_type string")
    rows = graph.export_paths(e, r, e.where("id = 1").select("id"), 2)
    want = {(1,): None} | {(1, k): "part_of" for k in range(2, 402)} | {(1, 2, 5): "relates_to"} | {(1, k, 500): "part_of" for k in range(2, 402)}
    got = [(tuple(x.path), x.relation_type) for x in rows.collect()]
    assert dict(got) == want and len(got) == len(want)
    assert len(rows.inputFiles()) > 10  # one task wrote a level before


def test_details_of_few_entities_filter_the_tables_first(spark, monkeypatch):
    from knotwork.operators import evidence

    e = spark.createDataFrame([(k, f"n{k}", "Task") for k in range(1, 6)], "id long, name string, entity_type string")
    r = spark.createDataFrame([(10, 1, 2, "part_of"), (10, 1, 2, "part_of"), (11, 3, 1, "relates_to"), (12, 4, 5, "part_of"), (13, 1, 99, "part_of"), (14, 1, 1, "part_of")], EDGES).distinct()
    o = spark.createDataFrame([(k, k % 5 + 1, f"t{k}", 0.5, "hearsay", "active") for k in range(20)], "id long, memory_entity_id long, content string, confidence double, source string, status string")
    o = o.withColumns({"obsoleted_at": F.lit(None).cast("timestamp"), "valid_from": F.lit(None).cast("timestamp"), "valid_until": F.lit(None).cast("timestamp"), "created_at": F.lit(NOW).cast("timestamp")})
    some = ids(spark, 1, 3, 99)
    shown = lambda: sorted(map(tuple, evidence.entity_details(some, e, o, r, NOW, limit=2).collect()), key=repr)
    few = shown()
    assert [x for x in few if x[1] == "relation_from"] == [(1, "relation_from", 0, 10, "part_of", "n2"), (1, "relation_from", 0, 13, "part_of", None), (1, "relation_from", 0, 14, "part_of", "n1"), (3, "relation_from", 0, 11, "relates_to", "n1")]
    plan = evidence._about(some, o, r)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter")  # the filter stands below what makes edges distinct
    monkeypatch.setattr(evidence, "FEW_IDS", 1)
    assert shown() == few


def test_top_proposals_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(resolve, "PROPOSALS_EACH", 10)
    rows = [(k % 40, k % 7, k) for k in range(280)]
    p = spark.createDataFrame(rows, "from_id long, to_id long, score long").withColumn("relation_type", F.lit("relates_to"))
    there = spark.createDataFrame([(k, k, (k + 1) % 7, "relates_to" if k % 2 else "part_of") for k in range(40)], EDGES)
    out = resolve.top_proposals(p, there, p.where("(from_id + to_id) % 5 = 0"))
    best = {}
    for a, b, n in rows:
        if a != b and (a + b) % 5 and not (a % 2 and b == (a + 1) % 7):
            best[a, b] = max(n, best.get((a, b), n))
    want = {(a, b, n) for (a, b), n in best.items() if sum(x > n for (c, _), x in best.items() if c == a) < 3}
    assert {(r.from_id, r.to_id, r.score) for r in out.collect()} == want
    dealt = [line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]
    assert dealt and all(", 28)" in line for line in dealt)
