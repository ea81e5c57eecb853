"""Approved review rows carried out on the graph, as if one by one, but many at once.

Each row reads and writes some things: an entity, an observation, a relation, or the
chain of parents above a new parent. A row is ready when no earlier row that is still
open writes what it reads or writes, or reads what it writes. All ready rows are carried
out together; then what the others touch is looked up anew, since entities may have been
merged or moved. The number of rounds is the length of the longest chain of rows that
wait for each other, not the number of rows: moves below one project wait for each other
only where one's node stands above the other's new parent.

Rounds work on the rows' surroundings only: what they name, what stands above it and what
hangs on entities that are merged or deleted. The rest of the graph is neither rewritten
nor looked at again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.types import RELATION_TYPES, canonical
from knotwork.operators import mutate
from knotwork.sources.shared import kept
from knotwork.sources.views import Graph

ROWS = "id long, position long, kind string, a long, b long, label string"
MOVES = ("orphan_parent", "reparent_entity")


def read(rows: DataFrame) -> DataFrame:
    """(id, position, kind, a, b, label) of review rows (id, position, kind, payload, edited); edits win, field by field.

    ``a`` and ``b`` are source and target, lower and upper end, node and parent, observation
    and new owner, or what is deleted. One row of several relations becomes several.
    """
    def value(*paths: str) -> Column:
        found = [F.get_json_object(c, f"$.{p}") for c in ("edited", "payload") for p in paths]
        return F.coalesce(*[F.when(F.trim(v) != "", v) for v in found])

    number = lambda *paths: value(*paths).try_cast("long")
    kind = F.col("kind")
    ids = F.from_json(value("payload.delete_ids", "delete_ids"), "array<long>")
    many = F.array_distinct(F.filter(F.coalesce(ids, F.array(number("payload.delete_id", "delete_id"))), lambda x: x.isNotNull() & ~x.eqNullSafe(number("payload.keep_id", "keep_id"))))
    a = (
        F.when(kind == "entity_merge", number("source_id", "entity_a.entity_id")).when(kind == "relationship_proposal", number("from_id", "from_entity_id")).when(kind.isin(*MOVES), number("node_id", "entity_id", "payload.entity_id"))
        .when(kind.isin("move_observation", "delete_observation"), number("observation_id", "payload.observation_id")).when(kind == "delete_relation", number("relation_id", "payload.relation_id")).when(kind == "delete_entity", number("entity_id", "payload.entity_id"))
    )
    b = F.when(kind == "entity_merge", number("target_id", "entity_b.entity_id")).when(kind == "relationship_proposal", number("to_id", "to_entity_id")).when(kind.isin(*MOVES), number("parent_id", "payload.parent_id")).when(kind == "move_observation", number("target_entity_id", "target_id", "payload.target_entity_id"))
    each = F.explode_outer(F.when((kind == "relation_integrity") & (F.size(many) > 0), many).otherwise(F.array(a))).alias("a")
    return rows.select("id", "position", kind, each, b.alias("b"), canonical(value("relation_type"), RELATION_TYPES).alias("label"))


def _above(relations: DataFrame, starts: DataFrame) -> DataFrame:
    """(position, at): the start nodes of rows and all nodes above them."""
    up = kept(relations.where("relation_type = 'part_of'").select(F.col("from_entity_id").alias("at"), F.col("to_entity_id").alias("then")).distinct())
    now = kept(starts.select("position", "at").distinct())
    seen = now
    while True:
        now = kept(now.join(up, "at").select("position", F.col("then").alias("at")).distinct().join(seen, ["position", "at"], "left_anti"))
        if now.isEmpty():
            return kept(seen)
        seen = seen.unionByName(now)


def _accesses(g: Graph, rows: DataFrame, above: DataFrame) -> DataFrame:
    """(position, what, write) of open rows."""
    e = lambda c: F.concat(F.lit("e"), c.cast("string"))
    use = lambda what, write: F.struct(what.alias("what"), F.lit(write).alias("write"))
    a, b, kind = e(F.col("a")), e(F.col("b")), F.col("kind")
    edge = F.concat_ws("-", F.lit("x"), F.col("a").cast("string"), F.col("b").cast("string"), "label")
    up = F.col("label") == "part_of"
    own = F.when(kind == "entity_merge", F.array(use(a, True), use(b, True))).when(kind == "relationship_proposal", F.when(up, F.array(use(a, True), use(b, False), use(edge, True))).otherwise(F.array(use(a, False), use(b, False), use(edge, True))))
    own = own.when(kind.isin(*MOVES), F.array(use(a, True), use(b, False))).when(kind == "delete_entity", F.array(use(a, True))).when(kind == "move_observation", F.array(use(b, False))).otherwise(F.expr("array()").cast("array<struct<what:string,write:boolean>>"))
    direct = rows.select("position", F.explode(own).alias("u")).select("position", "u.what", "u.write")
    on_facts = rows.where(kind.isin("move_observation", "delete_observation")).join(g.observations.select(F.col("id").alias("a"), "memory_entity_id"), "a", "left")
    facts = on_facts.select("position", F.explode(F.array(use(F.concat(F.lit("o"), F.col("a").cast("string")), True), use(e(F.col("memory_entity_id")), False))).alias("u")).select("position", "u.what", "u.write")
    on_edges = rows.where(kind.isin("relation_integrity", "delete_relation")).join(g.relations.select(F.col("id").alias("a"), "from_entity_id", "to_entity_id", "relation_type"), "a", "left")
    parent = F.struct(e(F.col("from_entity_id")).alias("what"), (F.col("relation_type") == "part_of").alias("write"))
    edges = on_edges.select("position", F.explode(F.array(use(F.concat(F.lit("r"), F.col("a").cast("string")), True), parent, use(e(F.col("to_entity_id")), False))).alias("u")).select("position", "u.what", "u.write")
    chains = above.select("position", e(F.col("at")).alias("what"), F.lit(False).alias("write"))
    return reduce(DataFrame.unionByName, [direct, facts, edges, chains]).where("what IS NOT NULL")


def _surroundings(g: Graph, rows: DataFrame) -> tuple[Graph, Graph]:
    """(what the rows can read or change, the rest); edges of equal ends and type stand together."""
    kind = F.col("kind")
    named = lambda c, *kinds: rows.where(kind.isin(*kinds)).select(F.col(c).alias("id")).where("id IS NOT NULL")
    both = ("entity_merge", "relationship_proposal", *MOVES)
    own = kept(named("a", *both, "delete_entity").unionAll(named("b", *both, "move_observation")).distinct())
    # all that hangs on these moves or goes with them
    whole = kept(named("a", "entity_merge", "delete_entity").unionAll(named("b", "entity_merge")).distinct())
    starts = named("a", *MOVES, "relationship_proposal").unionAll(named("b", *MOVES, "relationship_proposal")).unionAll(whole).distinct()
    above = _above(g.relations, starts.select(F.lit(0).cast("long").alias("position"), F.col("id").alias("at"))).select(F.col("at").alias("id"))
    lower = own.unionAll(above)
    edges = kept(named("a", "relation_integrity", "delete_relation"))
    if not edges.isEmpty():
        lower = lower.unionAll(g.relations.join(edges, "id", "left_semi").select(F.col("from_entity_id").alias("id")))
    lower = kept(lower.distinct()).withColumnRenamed("id", "from_entity_id")
    upper = whole.withColumnRenamed("id", "to_entity_id")
    other = g.relations.join(lower, "from_entity_id", "left_anti")
    relations = g.relations.join(lower, "from_entity_id", "left_semi")
    if not whole.isEmpty():
        relations = relations.unionByName(other.join(upper, "to_entity_id", "left_semi"))
        other = other.join(upper, "to_entity_id", "left_anti")
    facts = kept(named("a", "move_observation", "delete_observation"))
    owned = g.observations.select("id", F.col("memory_entity_id").alias("_m")).join(whole.withColumnRenamed("id", "_m"), "_m", "left_semi").select("id")
    facts = kept(facts.unionAll(owned).distinct())  # ids only: texts of the rest aren't shuffled where these are few
    some = Graph(kept(g.entities.join(own, "id", "left_semi").select(*g.entities.columns)), kept(g.observations.join(facts, "id", "left_semi").select(*g.observations.columns)), kept(relations.select(*g.relations.columns)))
    rest = Graph(g.entities.join(own, "id", "left_anti").select(*g.entities.columns), g.observations.join(facts, "id", "left_anti").select(*g.observations.columns), other.select(*g.relations.columns))
    return some, rest


def apply_rows(g: Graph, rows: DataFrame, first_id: int, now: str, most: int = 1000) -> tuple[Graph, DataFrame]:
    """Carry out rows (see ``read``) in the order of their positions: (graph, outcomes (id, position, done)).

    - a merge asks for two entities of one type, no Projects;
    - a proposal for two different entities, a type, no such edge yet and, as ``part_of``, no
      other parent and no loop;
    - a move puts a node under a parent that isn't below it, in place of all its parents;
    - a moved observation is made anew at its owner-to-be (trusted, with its origin as
      source) and is obsolete where it was; one that is there already stays;
    - a deleted observation is obsolete, a deleted entity goes with all that hangs on it
      unless it is a Project; a deleted relation goes; what isn't there can't be deleted.

    New rows have ids ``first_id`` plus position. A review row of several relations is done
    if one of them was there. More than ``most`` rounds raise.
    """
    open_rows, done = kept(rows.select(*[f.split()[0] for f in ROWS.split(", ")])), []
    if open_rows.isEmpty():
        return g, rows.select("id", "position", F.lit(True).alias("done")).limit(0)
    edge = ["from_entity_id", "to_entity_id", "relation_type"]
    g, rest = _surroundings(g, open_rows)
    united = False
    for _ in range(most):
        if open_rows.isEmpty():
            break
        up = open_rows.where(F.col("kind").isin(*MOVES) | ((F.col("kind") == "relationship_proposal") & (F.col("label") == "part_of")))
        above = _above(g.relations, up.select("position", F.col("b").alias("at")))
        uses = kept(_accesses(g, open_rows, above))
        first = uses.groupBy("what").agg(F.min("position").alias("any"), F.min(F.when(F.col("write"), F.col("position"))).alias("writer"))
        waits = uses.join(first, "what").where((F.col("writer") < F.col("position")) | (F.col("write") & (F.col("any") < F.col("position")))).select("position").distinct()
        ready = kept(open_rows.join(waits, "position", "left_anti"))
        kind = F.col("kind")
        ends = g.entities.select("id", "entity_type")
        known = ready.join(ends.withColumnsRenamed({"id": "a", "entity_type": "_ta"}), "a", "left").join(ends.withColumnsRenamed({"id": "b", "entity_type": "_tb"}), "b", "left")
        loops = above.withColumnRenamed("at", "a").withColumn("_loop", F.lit(True))
        known = kept(known.join(loops, ["position", "a"], "left"))
        both = F.col("_ta").isNotNull() & F.col("_tb").isNotNull() & (F.col("a") != F.col("b"))
        merges = known.where((kind == "entity_merge") & both & (F.col("_ta") == F.col("_tb")) & (F.col("_ta") != "Project"))
        moves = known.where(kind.isin(*MOVES) & both & F.col("_loop").isNull())
        there = g.relations.select(F.col("from_entity_id").alias("a"), F.col("to_entity_id").alias("b"), F.col("relation_type").alias("label")).distinct()
        parents = g.relations.where("relation_type = 'part_of'").select(F.col("from_entity_id").alias("a"), F.col("relation_type").alias("label")).distinct()
        made = known.where((kind == "relationship_proposal") & both & F.col("label").isNotNull() & F.col("_loop").isNull()).join(there, ["a", "b", "label"], "left_anti").join(parents, ["a", "label"], "left_anti")
        relation = known.where(kind.isin("relation_integrity", "delete_relation")).join(g.relations.select(F.col("id").alias("a")), "a", "left_semi")
        entity = known.where((kind == "delete_entity") & (F.col("_ta") != "Project"))
        fact = known.where(kind == "delete_observation").join(g.observations.select(F.col("id").alias("a")), "a", "left_semi")
        owner = g.observations.select(F.col("id").alias("a"), F.col("memory_entity_id").alias("_owner"), F.col("content").alias("_content"))
        moved = known.where((kind == "move_observation") & F.col("_tb").isNotNull()).join(owner, "a")
        hit = [kept(x.select("id", "position", "kind", "a", "b", "label", *more)) for x, more in ((merges, ()), (moves, ()), (made, ()), (relation, ()), (entity, ()), (fact, ()), (moved, ("_owner", "_content")))]
        merges, moves, made, relation, entity, fact, moved = hit
        new = moves.select((F.col("position") + first_id).alias("id"), F.col("a").alias(edge[0]), F.col("b").alias(edge[1]), F.lit("part_of").alias(edge[2])).unionAll(made.select(F.col("position") + first_id, "a", "b", "label"))
        relations = g.relations.join(relation.select(F.col("a").alias("id")), "id", "left_anti").join(moves.select(F.col("a").alias(edge[0]), F.lit("part_of").alias(edge[2])), [edge[0], edge[2]], "left_anti")
        relations = relations.select(*g.relations.columns).unionByName(new, allowMissingColumns=True)
        truly = moved.where("_owner <> b")
        observations = mutate.mark_obsolete(g.observations, fact.select(F.col("a").alias("id")).unionAll(truly.select("a")), now, "review")
        copies = truly.select((F.col("position") + first_id).alias("id"), F.col("b").alias("memory_entity_id"), F.col("_content").alias("content"), F.lit("active").alias("status"), F.concat(F.lit("moved from "), F.col("a").cast("string")).alias("source"), F.lit(1.0).alias("confidence"))
        observations = observations.unionByName(copies.select(*[c for c in copies.columns if c in observations.columns]), allowMissingColumns=True)
        g = Graph(g.entities, observations.select(*g.observations.columns), relations)
        if not merges.isEmpty():
            united = True
            g = mutate.merge(g, merges.select(F.col("a").alias("source"), F.col("b").alias("target")))
        if not entity.isEmpty():
            g = mutate.delete_nodes(g, entity.select(F.col("a").alias("id")))
        g = Graph(kept(g.entities), kept(g.observations), kept(g.relations))
        good = reduce(DataFrame.unionByName, [x.select("id", "position") for x in hit]).distinct().withColumn("_ok", F.lit(True))
        done.append(kept(ready.select("id", "position").join(good, ["id", "position"], "left").select("id", "position", F.coalesce("_ok", F.lit(False)).alias("done"))))
        open_rows = kept(open_rows.join(ready.select("position").distinct(), "position", "left_anti"))
    else:
        raise RuntimeError(f"rows still wait after {most} rounds")
    if united:  # a merge leaves no loops and no repeated edges anywhere
        rest.relations = mutate.without_repeats(rest.relations.where("from_entity_id <> to_entity_id"))
    g = Graph(rest.entities.unionByName(g.entities), rest.observations.unionByName(g.observations), rest.relations.unionByName(g.relations))
    return g, reduce(DataFrame.unionByName, done).groupBy("id", "position").agg(F.max("done").alias("done"))
