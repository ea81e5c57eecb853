"""Matching a flattened import tree with the graph, and carrying decisions out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.functions import text as T
from knotwork.functions.types import ENTITY_TYPES, RELATION_TYPES, canonical
from knotwork.operators import graph as G
from knotwork.operators.blocks import nearest_pairs
from knotwork.operators.order import numbered
from knotwork.operators.postings import search_each
from knotwork.sources.shared import kept
from knotwork.sources.views import Graph

#: Scores of a root's best match that make it certain, or doubtful.
HIGH, LOW = 20.0, 10.0


def match_roots(nodes: DataFrame, entities: DataFrame, limit: int = 10) -> DataFrame:
    """(node_path, status, match_id, score, n_matches) of root nodes (node_path, name, entity_type): high_confidence, low_confidence or new."""
    typed = nodes.select("node_path", "name", canonical(F.col("entity_type"), ENTITY_TYPES).alias("want"))
    found = search_each(typed.select(F.col("node_path").alias("key"), F.concat_ws(" ", "name", "want").alias("query")), entities, limit)
    best = found.groupBy("key").agg(F.min_by(F.struct("id", "entity_type", "score", "matched"), "place").alias("m"), F.count("*").alias("n_matches")).withColumnRenamed("key", "node_path")
    rows = typed.join(best, "node_path", "left")
    has = lambda f: F.array_contains("m.matched", f)
    sure = (F.col("m.score") >= HIGH) & (has("name") | has("aliases")) & has("entity_type") & (F.lower("m.entity_type") == F.lower("want"))
    status = F.when(sure, "high_confidence").when((F.col("m.score") >= LOW) & has("entity_type"), "low_confidence").otherwise("new")
    return rows.select("node_path", status.alias("status"), F.when(status == "high_confidence", F.col("m.id")).alias("match_id"), F.col("m.score").alias("score"), F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"))


def match_children(nodes: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(node_path, status, match_id) of child nodes (node_path, parent_name, name, entity_type, relation_type, parent_to_child): skip, add_relation or new.

    A child is the lowest entity of exactly its name and canonical type; it is
    skipped if an edge of the type already joins it to an entity of the parent's name.
    """
    typed = nodes.select("node_path", F.lower("parent_name").alias("_parent"), "name", canonical(F.col("entity_type"), ENTITY_TYPES).alias("entity_type"), canonical(F.coalesce("relation_type", F.lit("part_of")), RELATION_TYPES).alias("relation_type"), F.coalesce("parent_to_child", F.lit(False)).alias("down"))
    exact = entities.groupBy("name", "entity_type").agg(F.min("id").alias("match_id"))
    met = kept(typed.join(exact, ["name", "entity_type"], "left"))
    ends = relations.select("relation_type", F.col("from_entity_id").alias("match_id"), F.col("to_entity_id").alias("other"), F.lit(False).alias("down")).unionByName(relations.select("relation_type", F.col("to_entity_id").alias("match_id"), F.col("from_entity_id").alias("other"), F.lit(True).alias("down")))
    parent = entities.select(F.col("id").alias("other"), F.lower("name").alias("_parent"))
    joined = met.where("match_id IS NOT NULL").join(ends, ["match_id", "relation_type", "down"]).join(parent, ["other", "_parent"]).select("node_path", F.lit(True).alias("there")).distinct()
    status = F.when(F.col("match_id").isNull(), "new").when(F.col("there"), "skip").otherwise("add_relation")
    return met.join(joined, "node_path", "left").select("node_path", status.alias("status"), "match_id")


def import_stats(matches: DataFrame) -> DataFrame:
    """One row of counts of (node_path, status): total, root_nodes and each status."""
    count = lambda test: F.count_if(test)
    each = [count(F.col("status") == s).alias(s) for s in ("high_confidence", "low_confidence", "new", "skip", "add_relation")]
    return matches.agg(F.count("*").alias("total"), count(~F.contains("node_path", F.lit("."))).alias("root_nodes"), *each)


def duplicate_contents(incoming: DataFrame, observations: DataFrame, most: float = 0.35) -> DataFrame:
    """(key, duplicate, observation_id, distance, exact) for incoming (key, memory_entity_id, content, embedding).

    An equal active content of the entity is a duplicate at distance 0; else the
    nearest embedded one within ``most`` is. Blank contents are none. Raises where a
    content has to be compared with an entity that has observations without vectors.
    Entities with many of both are compared in blocks.
    """
    active = observations.where("status = 'active'").select("memory_entity_id", F.col("id").alias("observation_id"), F.col("content").alias("_content"), F.col("embedding").alias("_v"))
    rows = kept(incoming.select("key", "memory_entity_id", "content", "embedding"))
    asked = rows.where(F.trim("content") != "")
    exact = asked.join(active, (asked["memory_entity_id"] == active["memory_entity_id"]) & (F.col("content") == F.col("_content"))).groupBy("key").agg(F.min("observation_id").alias("same"))
    left = kept(asked.join(exact, "key", "left_anti"))
    met = active.join(left.select("memory_entity_id"), "memory_entity_id", "left_semi")
    if not met.where("_v IS NULL").isEmpty():
        raise ValueError("observations without vectors")
    # both sides' ids stand side by side: incoming ones are odd
    both = met.select(F.col("memory_entity_id").alias("key"), (F.col("observation_id") * 2).alias("id"), F.col("_v").alias("v"), F.lit(False).alias("asked")).unionByName(
        left.select(F.col("memory_entity_id").alias("key"), (F.col("key") * 2 + 1).alias("id"), F.col("embedding").alias("v"), F.lit(True).alias("asked")))
    near = nearest_pairs(both, 3.0, 1, later_only=False)  # no distance is so large
    best = near.select(F.shiftright("a", 1).alias("key"), F.struct("distance", F.shiftright("b", 1).alias("observation_id")).alias("m"))
    out = rows.select("key").join(exact, "key", "left").join(best, "key", "left")
    duplicate = F.col("same").isNotNull() | F.coalesce(F.col("m.distance") <= most, F.lit(False))
    return out.select("key", duplicate.alias("duplicate"), F.coalesce("same", "m.observation_id").alias("observation_id"), F.when(F.col("same").isNotNull(), 0.0).otherwise(F.col("m.distance")).alias("distance"), F.col("same").isNotNull().alias("exact"))


@dataclass
class Imported:
    """What an import came to: with errors (node_path, error) the graph stays as it was; ``placed`` tells each node's entity."""

    graph: Graph
    errors: DataFrame
    placed: DataFrame


#: What a match or decision asks for; all else creates.
ACTIONS = {"skip": "skip", "add_relation": "add_relation", "merge": "merge", "high_confidence": "merge"}


def pre_order(path: Column) -> Column:
    """A node path as numbers; paths compare as their nodes are met in the tree."""
    return F.transform(F.filter(F.split(path, r"\."), lambda p: p != "children"), lambda p: p.try_cast("long"))


def executed(g: Graph, decided: DataFrame, first_id: int, leave_out: DataFrame | None = None) -> Imported:
    """Carry out decisions (node_path, parent_path, name, entity_type, relation_type, parent_to_child, status, match_id).

    Optional columns: ``parent_id`` (an entity a root is put under), ``aliases`` and
    ``observations`` (array of strings). The outcome is that of meeting the nodes in
    tree order one by one:

    - a node is an entity of its name and type, its match (``merge``), or a new one; a
      name that another type has taken, a blank name or a missing match is an error;
    - merged nodes' aliases follow the entity's own, each once;
    - contents that are blank or that the entity has (active) are left out, as are those
      of ``leave_out`` (memory_entity_id, content), which ``duplicate_contents`` finds;
    - a node that isn't skipped gets an edge to its parent's entity; an edge that is there
      stays; a new ``part_of`` takes the place of all others of its lower end, so of
      several the last in tree order stays; a loop of them is an error.

    New rows get ids from ``first_id`` in tree order. A stored observation counter is
    brought up to date. No sequence is walked: each rule is a window or an aggregate
    over the order of paths.
    """
    columns = decided.columns
    optional = lambda c, t: F.col(c).cast(t) if c in columns else F.lit(None).cast(t)
    action = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), F.col("status")), F.lit("create"))
    nodes = decided.select(
        "node_path", "parent_path", F.struct(pre_order(F.col("node_path")).alias("numbers"), F.col("node_path").alias("path")).alias("place"), "name",
        canonical(F.col("entity_type"), ENTITY_TYPES).alias("entity_type"), canonical(F.coalesce("relation_type", F.lit("part_of")), RELATION_TYPES).alias("relation_type"),
        F.coalesce("parent_to_child", F.lit(False)).alias("down"), action.alias("action"), F.col("match_id").cast("long").alias("match_id"),
        optional("parent_id", "long").alias("parent_id"), optional("aliases", "string").alias("aliases"), optional("observations", "array<string>").alias("observations"),
    )
    own = g.entities.groupBy("name", "entity_type").agg(F.min("id").alias("_own"))
    there = g.entities.select(F.col("id").alias("match_id"), F.lit(True).alias("_there"))
    found = kept(nodes.join(own, ["name", "entity_type"], "left").join(there, "match_id", "left"))
    merge = F.col("action") == "merge"
    old_id = F.when(merge, F.col("match_id")).otherwise(F.col("_own"))
    fresh = found.where(~merge & F.col("_own").isNull()).groupBy("name", "entity_type").agg(F.min_by(F.struct("place", "aliases"), "place").alias("n"))
    taken = g.entities.select("name").distinct().withColumn("_taken", F.lit(True))
    first = F.row_number().over(W.partitionBy("name").orderBy("n.place"))
    judged = kept(fresh.join(taken, "name", "left").withColumn("error", F.when(T.blank(F.col("name")), "no name").when(F.col("_taken") | (first > 1), "the name is taken by another type")))
    made = numbered(judged.where("error IS NULL").select("name", "entity_type", "n.place", "n.aliases"), F.asc("place"))
    made = kept(made.select("name", "entity_type", "place", F.col("aliases").alias("_raw"), (F.col("position") + first_id - 1).alias("_new")))
    placed = kept(found.join(made.select("name", "entity_type", "_new", F.col("place").alias("_made")), ["name", "entity_type"], "left").withColumn("entity_id", F.coalesce(old_id, F.when(~merge, F.col("_new")))))

    up = placed.select(F.col("node_path").alias("parent_path"), F.col("entity_id").alias("_tree"))
    asked = placed.where("action <> 'skip'").join(up, "parent_path", "left").withColumn("parent", F.coalesce("parent_id", "_tree")).where("parent IS NOT NULL AND entity_id IS NOT NULL AND parent <> entity_id")
    asked = kept(asked.select("place", F.when(F.col("down"), F.col("parent")).otherwise(F.col("entity_id")).alias("from_entity_id"), F.when(F.col("down"), F.col("entity_id")).otherwise(F.col("parent")).alias("to_entity_id"), "relation_type"))
    replaced, new = _new_edges(g.relations, asked)
    edges = numbered(new, F.asc("place"), F.asc("relation_type")).withColumn("id", F.col("position") + first_id - 1).drop("position", "place")
    stay = g.relations.join(replaced.select("from_entity_id", F.lit("part_of").alias("relation_type")), ["from_entity_id", "relation_type"], "left_anti")
    relations = stay.select(*g.relations.columns).unionByName(edges, allowMissingColumns=True)
    loops = G.on_loops(relations, new.where("relation_type = 'part_of'").select("from_entity_id", "to_entity_id", "place"))

    errors = placed.where(merge & F.col("_there").isNull()).select("node_path", F.lit("the match is missing").alias("error")).unionByName(
        judged.where("error IS NOT NULL").select(F.col("n.place.path").alias("node_path"), "error")
    ).unionByName(loops.select(F.col("place.path").alias("node_path"), F.lit("a loop of parents").alias("error")))
    errors = kept(errors)
    if not errors.isEmpty():
        return Imported(g, errors, placed.select("node_path", "entity_id"))

    facts = _new_contents(g.observations, placed, leave_out)
    observations = numbered(facts, F.asc("place"), F.asc("at")).select((F.col("position") + first_id - 1).alias("id"), "memory_entity_id", "content", F.lit("active").alias("status"))
    if "tags" in g.observations.columns:
        observations = observations.withColumn("tags", F.expr("array()").cast(g.observations.schema["tags"].dataType))
    created = made.select(F.col("_new").alias("id"), "name", "entity_type", F.col("_raw").alias("aliases"))
    entities = _with_aliases(g.entities.unionByName(created.select(*[c for c in created.columns if c in g.entities.columns]), allowMissingColumns=True), placed)
    counter = "memory_observations_count"
    if counter in entities.columns:
        more = observations.groupBy(F.col("memory_entity_id").alias("id")).agg(F.count("*").alias("_more"))
        entities = entities.join(more, "id", "left").withColumn(counter, (F.coalesce(counter, F.lit(0)) + F.coalesce("_more", F.lit(0))).cast(entities.schema[counter].dataType)).select(*g.entities.columns)
    return Imported(Graph(entities, g.observations.unionByName(observations, allowMissingColumns=True), relations), errors, placed.select("node_path", "entity_id"))


def _new_edges(relations: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lower ends whose ``part_of`` edges go, edges to be made with the place of the node that makes them)."""
    ends = ["from_entity_id", "to_entity_id", "relation_type"]
    there = relations.select(*ends).distinct().withColumn("_old", F.lit(True))
    told = kept(asked.join(there, ends, "left"))
    up = told.where("relation_type = 'part_of'")
    # edges that are there change nothing unless another one came before; then the last one asked for is made anew
    last = up.groupBy("from_entity_id").agg(F.max_by("to_entity_id", "place").alias("_last"), F.count_if(F.col("_old").isNull()).alias("_n")).where("_n > 0").drop("_n")
    runs = up.join(last, "from_entity_id").withColumn("_other", F.max(F.when(F.col("to_entity_id") != F.col("_last"), F.col("place"))).over(W.partitionBy("from_entity_id")))
    parents = runs.where((F.col("to_entity_id") == F.col("_last")) & (F.col("_other").isNull() | (F.col("place") > F.col("_other")))).groupBy(*ends).agg(F.min("place").alias("place"))
    others = told.where("relation_type <> 'part_of' AND _old IS NULL").groupBy(*ends).agg(F.min("place").alias("place"))
    return kept(last), kept(parents.unionByName(others))


def _new_contents(observations: DataFrame, placed: DataFrame, leave_out: DataFrame | None) -> DataFrame:
    """(memory_entity_id, content, place, at) of the contents to be added, each once for its entity."""
    rows = placed.select(F.col("entity_id").alias("memory_entity_id"), "place", F.posexplode("observations").alias("at", "content")).where(~T.blank(F.col("content")))
    first = rows.groupBy("memory_entity_id", "content").agg(F.min(F.struct("place", "at")).alias("p")).select("memory_entity_id", "content", "p.place", "p.at")
    for known in (observations.where("status = 'active'"), leave_out):
        if known is not None:
            first = first.join(known.select("memory_entity_id", "content"), ["memory_entity_id", "content"], "left_anti")
    return first


def _with_aliases(entities: DataFrame, placed: DataFrame) -> DataFrame:
    """Aliases of merged nodes after the entity's own, in tree order, each once; also those of nodes that met an entity made before them."""
    if "aliases" not in entities.columns:
        return entities
    merges = placed.where("action = 'merge' OR (action = 'create' AND (_own IS NOT NULL OR place > _made))")
    each = merges.select(F.col("entity_id").alias("id"), "place", F.posexplode(T.alias_list(F.col("aliases"))).alias("at", "alias"))
    first = each.groupBy("id", "alias").agg(F.min(F.struct("place", "at")).alias("p"))
    more = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "alias"))), lambda x: x["alias"]).alias("_more"))  # distinct aliases of one entity
    united = F.array_join(F.array_distinct(F.concat(T.alias_list(F.col("aliases")), F.col("_more"))), ",")
    return entities.join(more, "id", "left").withColumn("aliases", F.when(F.col("_more").isNotNull(), united).otherwise(F.col("aliases"))).select(*entities.columns)
