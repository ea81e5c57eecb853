"""A compaction run: phases over slices of the walk order, resumable after each slice.

Phases, in order:

- ``orphans``: parentless entities get the project that clearly matches them best, the
  others a row for review;
- ``merges``: an entity's best merge candidate is followed where it is near and scored
  high, else put up for review;
- ``observations``: of an entity's equal active contents all but the first go;
- ``relationships``: proposals of new relations are put up for review.

A phase sees the graph that the phases before it left. What it needs to know of all
entities (nearest pairs, matches) is computed once at its start and written; slices then
decide for their entities only, and what earlier slices of the phase decided is taken
into account. Decisions rest on the evidence at the phase's start, so how the order is
cut has no influence: a run in many slices, or one that was stopped and taken up again,
decides what one run over all at once decides. (Entities taken one by one would be
looked at again after each merge.) Survivors of merges are richer, or later where
equally rich, so chains of merges have an end; of several survivors of one entity the
first in walk order stays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.operators import graph as G
from knotwork.operators import mutate, quality, resolve
from knotwork.sources.shared import kept
from knotwork.sources.views import Graph
from knotwork.streaming.cursor import BatchLog, run_batches

PHASES = ("orphans", "merges", "observations", "relationships")
#: ``position`` is the entity's place in the walk order; a and b are what ``kind`` is about.
CHANGES = "position long, kind string, a long, b long, label string, score double"


@dataclass
class Settings:
    """Distances and points at which a phase acts by itself, or asks for review."""

    review_distance: float = 0.30
    merge_distance: float = 0.10
    orphan_score: int = 10
    orphan_margin: int = 3
    shared_length: int = 15
    shared_score: float = 10.0
    depends_score: float = 8.0
    proposals: int = 3


def _evidence(phase: str, g: Graph, vectors: DataFrame, s: Settings) -> DataFrame:
    """(id, kind, a, b, label, score): what each entity would decide."""
    none = F.lit(None)
    if phase == "orphans":
        orphans = G.hierarchy_orphans(g.entities, g.relations)
        best = resolve.auto_parents(resolve.orphan_matches(orphans, g.entities.where("entity_type = 'Project'"), g.observations), s.orphan_score, s.orphan_margin)
        rows = orphans.select("id").join(best, "id", "left")
        return rows.select("id", F.when(F.col("auto"), "parent").otherwise("review_parent").alias("kind"), F.col("id").alias("a"), F.col("project_id").alias("b"), none.cast("string").alias("label"), F.col("score").cast("double").alias("score"))
    if phase == "merges":
        info = g.entities.join(vectors.select("id", "embedding"), "id")
        pairs = resolve.merge_evidence(info, g.observations, g.relations, s.review_distance, 1, s.merge_distance)
        gone = F.col("a") + F.col("b") - F.col("survivor")
        merge = F.col("decision") == "merge"
        return pairs.select(F.col("a").alias("id"), F.when(merge, "merge").otherwise("review_merge").alias("kind"), F.when(merge, gone).otherwise(F.col("a")).alias("a"), F.when(merge, F.col("survivor")).otherwise(F.col("b")).alias("b"), none.cast("string").alias("label"), F.col("score").cast("double").alias("score"))
    if phase == "observations":
        rows = quality.redundant_observations(g.observations)
        return rows.select(F.col("memory_entity_id").alias("id"), F.lit("delete_observation").alias("kind"), F.col("id").alias("a"), F.col("memory_entity_id").alias("b"), none.cast("string").alias("label"), none.cast("double").alias("score"))
    shared = resolve.shared_observation_links(g.observations, g.entities, s.shared_length, s.proposals).select("from_id", "to_id", F.lit("relates_to").alias("relation_type"), F.lit(s.shared_score).alias("score"))
    needs = resolve.dependency_links(g.observations, g.entities).select("from_id", "to_id", F.lit("depends_on").alias("relation_type"), F.lit(s.depends_score).alias("score"))
    best = resolve.top_proposals(shared.unionByName(needs), g.relations, limit=s.proposals)
    return best.select(F.col("from_id").alias("id"), F.lit("propose").alias("kind"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.col("relation_type").alias("label"), "score")


def _decide(phase: str, evidence: DataFrame, order: DataFrame, earlier: DataFrame) -> DataFrame:
    """Changes of a slice's entities (id, position), given the phase's earlier ones."""
    rows = evidence.join(order.select("id", "position"), "id").drop("id")
    if phase != "merges":
        return rows
    merges, reviews = rows.where("kind = 'merge'"), rows.where("kind <> 'merge'")
    first = merges.withColumn("_n", F.row_number().over(W.partitionBy("a").orderBy("position"))).where("_n = 1").drop("_n")
    return first.join(earlier.where("kind = 'merge'").select("a"), "a", "left_anti").unionByName(reviews)


def applied(g: Graph, phase: str, changes: DataFrame, first_id: int) -> Graph:
    """The graph after a phase's changes; rows for review change nothing."""
    if phase == "orphans":
        new = changes.where("kind = 'parent'").select(F.col("a").alias("from_entity_id"), F.col("b").alias("to_entity_id"), F.lit("part_of").alias("relation_type"), (F.col("position") + first_id).alias("id"))
        return Graph(g.entities, g.observations, g.relations.unionByName(new, allowMissingColumns=True))
    if phase == "merges":
        return mutate.merge(g, changes.where("kind = 'merge'").select(F.col("a").alias("source"), F.col("b").alias("target")))
    if phase == "observations":
        return Graph(g.entities, g.observations.join(changes.where("kind = 'delete_observation'").select(F.col("a").alias("id")), "id", "left_anti").select(*g.observations.columns), g.relations)
    return g


def for_review(changes: dict[str, DataFrame]) -> DataFrame:
    """(kind, a, b, label, score) of what a run leaves for review; nothing about entities that it merged away."""
    gone = changes["merges"].where("kind = 'merge'").select("a")
    parts = [changes[p].where(F.col("kind").isin("review_parent", "review_merge", "propose")) for p in PHASES]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[3]).select("kind", "a", "b", "label", "score")
    return rows.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti").select("kind", "a", "b", "label", "score")


def compact(g: Graph, vectors: DataFrame, folder: str, slices: int = 1, settings: Settings | None = None, first_id: int = 1, paused: Callable[[], bool] = lambda: False) -> tuple[Graph, dict[str, DataFrame]] | None:
    """Run, or take up, a compaction in a shared folder; None if it was paused.

    Returns the graph after it and each phase's changes. The graph must be the one the
    run began with; what is there of the run is read from the folder.
    """
    s, spark = settings or Settings(), g.entities.sparkSession
    changes: dict[str, DataFrame] = {}
    for phase in PHASES:
        at = f"{folder.rstrip('/')}/{phase}"
        log = BatchLog(spark, f"{at}/changes", CHANGES)
        if log.last() + 1 < slices:
            ready = BatchLog(spark, f"{at}/evidence", "id long, kind string, a long, b long, label string, score double")
            if ready.last() < 0:
                ready.put(0, _evidence(phase, g, vectors, s))
            walk = BatchLog(spark, f"{at}/order", "id long, position long")
            if walk.last() < 0:
                walk.put(0, G.walk_order(g.entities, g.relations).select("id", "position"))
            evidence, order = ready.rows().drop("batch"), walk.rows().drop("batch")
            width = -(-max(1, order.count()) // slices)

            def decide(number: int, earlier: DataFrame, phase=phase, evidence=evidence, order=order, width=width) -> DataFrame:
                here = order.where((F.col("position") > number * width) & (F.col("position") <= (number + 1) * width))
                return _decide(phase, evidence, here, earlier)

            if not run_batches(slices, log, decide, paused):
                return None
        changes[phase] = log.rows().drop("batch")
        g = applied(g, phase, changes[phase], first_id)
        g = Graph(kept(g.entities), kept(g.observations), kept(g.relations)) if phase in ("merges", "observations") else g
    return g, changes
