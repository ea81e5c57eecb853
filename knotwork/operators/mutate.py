"""Mutations as set-based table rewrites: every function returns new tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.functions import text as T
from knotwork.functions.types import ENTITY_TYPES, canonical
from knotwork.operators import graph as G
from knotwork.sources.shared import kept
from knotwork.sources.views import Graph


def last_targets(pairs: DataFrame) -> DataFrame:
    """(source, target) with chains followed to their end, steps doubling; a source has one target, and loops raise."""
    if not pairs.groupBy("source").count().where("count > 1").isEmpty():
        raise ValueError("a source has several targets")
    now = kept(pairs.select("source", "target"))
    for _ in range(now.count().bit_length() + 1):
        step = now.select(F.col("source").alias("target"), F.col("target").alias("then"))
        moved = now.join(step, "target", "left")
        if moved.where("then IS NOT NULL").isEmpty():
            return now
        now = kept(moved.select("source", F.coalesce("then", "target").alias("target")))
    raise ValueError("pairs run in a loop")


def remapped(g: Graph, pairs: DataFrame) -> Graph:
    """Endpoints of edges and owners of observations moved from source to target, sources deleted; nothing else is united or dropped."""
    remap = lambda df, c: df.join(pairs.select(F.col("source").alias(c), F.col("target").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return Graph(
        g.entities.join(pairs.select(F.col("source").alias("id")), "id", "left_anti"),
        remap(g.observations, "memory_entity_id").select(*g.observations.columns),
        remap(remap(g.relations, "from_entity_id"), "to_entity_id").select(*g.relations.columns),
    )


def without_repeats(relations: DataFrame, *first: Column) -> DataFrame:
    """Of edges with the same ends and type one: the first by ``first``, then the lowest id."""
    w = W.partitionBy("from_entity_id", "to_entity_id", "relation_type").orderBy(*first, "id")
    return relations.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge(g: Graph, pairs: DataFrame) -> Graph:
    """Merge (source, target) pairs of equal type, no Projects; chains go to their last target.

    Observations move; edges are repointed, loops dropped, and of repeated edges
    the one that stood at its ends already stays, then the lowest id; aliases are united with the name.
    """
    kind = g.entities.select("id", "entity_type")
    ok = last_targets(pairs).join(kind.withColumnsRenamed({"id": "source", "entity_type": "ts"}), "source").join(kind.withColumnsRenamed({"id": "target", "entity_type": "tt"}), "target").where("ts = tt AND ts <> 'Project' AND source <> target").select("source", "target")
    remap = lambda df, c: df.join(ok.withColumnRenamed("source", c), c, "left").withColumn(c, F.coalesce("target", c)).drop("target")
    moved = remap(g.observations, "memory_entity_id").select(*g.observations.columns)
    edges = g.relations.withColumn("_was", F.struct("from_entity_id", "to_entity_id"))
    edges = remap(remap(edges, "from_entity_id"), "to_entity_id").where("from_entity_id <> to_entity_id")
    moved_flag = F.col("_was") != F.struct("from_entity_id", "to_entity_id")
    edges = without_repeats(edges, moved_flag).select(*g.relations.columns)
    gone = g.entities.join(ok.withColumnRenamed("source", "id"), "id").select(F.col("target").alias("id"), F.array_union(T.alias_list(F.col("aliases")), F.array("name")).alias("more"))
    more = gone.groupBy("id").agg(F.array_distinct(F.flatten(F.array_sort(F.collect_list("more")))).alias("more"))
    kept = g.entities.join(ok.withColumnRenamed("source", "id"), "id", "left_anti").join(more, "id", "left")
    united = F.array_join(F.filter(F.array_union(T.alias_list(F.col("aliases")), F.col("more")), lambda a: F.lower(a) != F.lower(F.col("name"))), ", ")
    kept = kept.withColumn("aliases", F.when(F.col("more").isNotNull(), united).otherwise(F.col("aliases"))).select(*g.entities.columns)
    return Graph(kept, moved, edges)


def move_to_parent(g: Graph, node: int, parent: int, edge_id: int) -> Graph:
    """Replace a node's parents by one; raises if that would close a loop."""
    if G.would_cycle(g.relations, node, parent):
        raise ValueError("the parent is the node or below it")
    rest = g.relations.where(~((F.col("from_entity_id") == node) & (F.col("relation_type") == "part_of")))
    new = g.relations.sparkSession.createDataFrame([(edge_id, node, parent, "part_of")], "id long, from_entity_id long, to_entity_id long, relation_type string")
    return replace(g, relations=rest.unionByName(new, allowMissingColumns=True))


def delete_nodes(g: Graph, roots: DataFrame, cascade: bool = False) -> Graph:
    """Remove entities with their observations and edges; ``cascade`` takes what is below, unless a Project is among it."""
    gone = roots.select("id")
    if cascade:
        gone = G.project_subtree(g.relations, roots, cap=None).select("id")
        if not g.entities.where("entity_type = 'Project'").join(gone, "id", "left_semi").isEmpty():
            raise ValueError("a Project stands below")
    return Graph(
        g.entities.join(gone, "id", "left_anti"),
        g.observations.join(gone.withColumnRenamed("id", "memory_entity_id"), "memory_entity_id", "left_anti").select(*g.observations.columns),
        g.relations.join(gone.withColumnRenamed("id", "from_entity_id"), "from_entity_id", "left_anti").join(gone.withColumnRenamed("id", "to_entity_id"), "to_entity_id", "left_anti").select(*g.relations.columns),
    )


def mark_obsolete(observations: DataFrame, ids: DataFrame, now: str, reason: str) -> DataFrame:
    hit = observations.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    change = F.col("_hit") & (F.col("status") == "active")
    out = hit.withColumn("obsoleted_at", F.when(change, F.lit(now).cast("timestamp")).otherwise(F.col("obsoleted_at")))
    if "obsolescence_reason" in observations.columns:
        out = out.withColumn("obsolescence_reason", F.when(change, F.lit(reason)).otherwise(F.col("obsolescence_reason")))
    return out.withColumn("status", F.when(change, "obsolete").otherwise(F.col("status"))).select(*observations.columns)


def supersede(observations: DataFrame, replacements: DataFrame, now: str) -> DataFrame:
    """``replacements``: (old_id, id, content); old rows point at new active rows of their entity."""
    pairs = replacements.select("old_id", F.col("id").alias("_new"), F.col("content").alias("_content"))
    joined = observations.join(pairs, observations["id"] == pairs["old_id"], "left")
    hit = F.col("_new").isNotNull() & (F.col("status") == "active")
    old = joined.withColumn("superseded_by_id", F.when(hit, F.col("_new")).otherwise(F.col("superseded_by_id"))).withColumn("obsoleted_at", F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("obsoleted_at"))).withColumn("status", F.when(hit, "superseded").otherwise(F.col("status"))).select(*observations.columns)
    new = joined.where(hit).withColumn("id", F.col("_new")).withColumn("content", F.col("_content")).withColumn("created_at", F.lit(now).cast("timestamp")).withColumn("obsoleted_at", F.lit(None).cast("timestamp")).withColumn("superseded_by_id", F.lit(None).cast("long")).select(*observations.columns)
    return old.unionByName(new)


def with_relations(g: Graph, new: DataFrame) -> Graph:
    """Add relations that pass: both ends exist and differ, not there yet, no second parent, no ``part_of`` on a loop of parents."""
    ids = g.entities.select("id")
    good = new.where("from_entity_id <> to_entity_id").join(ids.withColumnRenamed("id", "from_entity_id"), "from_entity_id", "left_semi").join(ids.withColumnRenamed("id", "to_entity_id"), "to_entity_id", "left_semi")
    good = good.join(g.relations.select("from_entity_id", "to_entity_id", "relation_type"), ["from_entity_id", "to_entity_id", "relation_type"], "left_anti")
    parents = g.relations.where("relation_type = 'part_of'").select("from_entity_id", "relation_type")
    good = good.join(parents, ["from_entity_id", "relation_type"], "left_anti")
    # of several new parents of one child the first stays
    place = F.row_number().over(W.partitionBy("from_entity_id", "relation_type", F.when(F.col("relation_type") != "part_of", F.col("to_entity_id"))).orderBy("id"))
    good = good.withColumn("_n", place).where("_n = 1").drop("_n")
    up = F.col("relation_type") == "part_of"
    if not new.where(up).isEmpty():
        good = kept(good)
        edges = good.where(up).select("id", "from_entity_id", "to_entity_id", "relation_type")
        loops = G.on_loops(g.relations.select(*edges.columns).unionAll(edges), edges)
        good = good.join(loops.select("id"), "id", "left_anti")
    return replace(g, relations=g.relations.unionByName(good.select(*g.relations.columns)))


def update_entities(entities: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities after the changes, refused changes (id, error)); changes are (id, name, entity_type, aliases, description), one for an id.

    Blank names and types and null aliases and descriptions leave what is there; an empty
    text clears aliases or a description. A change is refused if it tells nothing, its
    entity is missing, or its name is another entity's or that of a change with a
    smaller id. Columns that the table lacks are passed over.
    """
    given = lambda c: F.when(~T.blank(F.col(c)), F.col(c))
    asked = changes.select("id", given("name").alias("_name"), canonical(given("entity_type"), ENTITY_TYPES).alias("_type"), F.col("aliases").alias("_aliases"), F.col("description").alias("_description"))
    told = F.coalesce("_name", "_type", "_aliases", "_description").isNotNull()
    asked = asked.withColumn("_key", F.coalesce("_name", F.concat(F.lit("\0"), F.col("id").cast("string"))))  # changes without a name don't meet
    there = entities.select("id", F.col("name").alias("_was"))
    owner = entities.groupBy(F.col("name").alias("_key")).agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    first = F.row_number().over(W.partitionBy("_key").orderBy("id"))
    rows = asked.join(there, "id", "left").join(owner, "_key", "left")
    taken = F.col("_name").isNotNull() & (((F.col("_low") != F.col("id")) | (F.col("_high") != F.col("id"))) | (first > 1))
    judged = kept(rows.withColumn("error", F.when(~told, "nothing to change").when(F.col("_was").isNull(), "the entity is missing").when(taken, "the name is taken")))
    good = judged.where("error IS NULL").drop("_was", "_key", "_low", "_high", "error")
    put = {"name": "_name", "entity_type": "_type", "aliases": "_aliases", "description": "_description"}
    out = entities.join(good, "id", "left").withColumns({c: F.coalesce(n, c) for c, n in put.items() if c in entities.columns})
    return out.select(*entities.columns), judged.where("error IS NOT NULL").select("id", "error")


def bulk(g: Graph, entities: DataFrame | None = None, observations: DataFrame | None = None, relations: DataFrame | None = None, most: int = 50) -> Graph:
    """All rows or none: any name that is taken, blank content or missing end rejects the whole batch of 1 to ``most`` operations."""
    n = sum(df.count() for df in (entities, observations, relations) if df is not None)
    if not 1 <= n <= most:
        raise ValueError(f"1 to {most} operations, not {n}")
    out = g
    if entities is not None:
        if not entities.join(g.entities.select("name"), "name", "left_semi").isEmpty() or entities.select("name").distinct().count() < entities.count():
            raise ValueError("a name is taken")
        out = replace(out, entities=out.entities.unionByName(entities, allowMissingColumns=True))
    if observations is not None:
        known = out.entities.select(F.col("id").alias("memory_entity_id"))
        if not observations.where(T.blank(F.col("content"))).isEmpty() or not observations.join(known, "memory_entity_id", "left_anti").isEmpty():
            raise ValueError("an observation is blank or has no entity")
        out = replace(out, observations=out.observations.unionByName(observations, allowMissingColumns=True))
    if relations is not None:
        added = with_relations(out, relations)
        if added.relations.count() - out.relations.count() != relations.count():
            raise ValueError("a relation is not allowed")
        out = added
    return out
