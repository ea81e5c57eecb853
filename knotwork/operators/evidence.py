"""What is shown of entities: their observations and edges as rows, and evidence for a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.functions import text as T
from knotwork.operators.blocks import nearest_pairs
from knotwork.operators.graph import induced_edges
from knotwork.operators.ranking import relevance, trust_scores
from knotwork.operators.resolve import diverse_evidence
from knotwork.sources.shared import kept

#: Columns of the rows that make up a page: which entity, what kind of row, its place, what it refers to.
ROWS = ["entity_id", "part", "position", "ref_id", "kind", "label"]
#: Up to so many ids filter the tables before anything is joined or made distinct.
FEW_IDS = 1000


def _about(ids: DataFrame, observations: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The observations and edges of the ids if these are few, else all."""
    few = [r.id for r in ids.select("id").distinct().limit(FEW_IDS + 1).collect()]
    if len(few) > FEW_IDS:
        return observations, relations
    return observations.where(F.col("memory_entity_id").isin(few)), relations.where(F.col("from_entity_id").isin(few) | F.col("to_entity_id").isin(few))


def _ranked(ids: DataFrame, observations: DataFrame, relations: DataFrame, now: str, query: str | None, vector: Column | None, limit: int, include_obsolete: bool) -> DataFrame:
    """Observations of the ids with their rank in their entity and how many there are."""
    own = observations.join(ids.select(F.col("id").alias("memory_entity_id")).distinct(), "memory_entity_id", "left_semi")
    own = own if include_obsolete else own.where("status = 'active'")
    edges = relations.join(ids.select(F.col("id").alias("from_entity_id")), "from_entity_id", "left_semi").unionByName(relations.join(ids.select(F.col("id").alias("to_entity_id")), "to_entity_id", "left_semi")).distinct()
    scored = trust_scores(own, edges, now)
    order = [F.desc("trust_score"), F.desc(F.coalesce("confidence", F.lit(0.0))), F.asc("id")]
    if query:
        scored, order = relevance(scored, query, vector), [F.desc("relevance"), *order]
    counted = scored.withColumn("_all", F.count("*").over(W.partitionBy("memory_entity_id"))).withColumn("position", F.row_number().over(W.partitionBy("memory_entity_id").orderBy(*order)))
    return counted if limit <= 0 else counted.where(F.col("position") <= limit)


def _entities(ids: DataFrame, entities: DataFrame) -> DataFrame:
    return entities.join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("entity_id"), F.lit("entity").alias("part"), F.lit(0).alias("position"), F.col("id").alias("ref_id"), F.col("entity_type").alias("kind"), F.col("name").alias("label"))


def _observations(ranked: DataFrame) -> DataFrame:
    return ranked.select(F.col("memory_entity_id").alias("entity_id"), F.lit("observation").alias("part"), "position", F.col("id").alias("ref_id"), "status", "content").toDF(*ROWS)


def entity_details(ids: DataFrame, entities: DataFrame, observations: DataFrame, relations: DataFrame, now: str, query: str | None = None, vector: Column | None = None, limit: int = 0, include_obsolete: bool = False) -> DataFrame:
    """Rows of entities: themselves, their ranked observations (``limit`` each; a row ``truncated`` tells of more), edges out and in with the other end's name.

    Rows, not nested lists: a hub's edges stay many rows.
    """
    observations, relations = _about(ids, observations, relations)
    relations = kept(relations)
    ranked = kept(_ranked(ids, observations, relations, now, query, vector, limit, include_obsolete))
    cut = ranked.where("position = 1 AND _all > %d" % limit) if limit > 0 else ranked.where("false")
    truncated = cut.select(F.col("memory_entity_id").alias("entity_id"), F.lit("truncated").alias("part"), F.lit(0).alias("position"), F.col("_all").alias("ref_id"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("label"))
    names = entities.select("id", "name")

    def edges(own: str, other: str, part: str) -> DataFrame:
        mine = kept(relations.join(ids.select(F.col("id").alias(own)).distinct(), own, "left_semi").select(F.col(own).alias("entity_id"), F.col("id").alias("ref_id"), F.col("relation_type").alias("kind"), F.col(other).alias("_other")))
        asked = names.join(mine.select(F.col("_other").alias("id")), "id", "left_semi")  # few edges go to the names, not all names to them
        named = mine.join(asked.withColumnsRenamed({"id": "_other", "name": "label"}), "_other", "left")
        return named.select("entity_id", F.lit(part).alias("part"), F.lit(0).alias("position"), "ref_id", "kind", "label")

    parts = [_entities(ids, entities), _observations(ranked), truncated, edges("from_entity_id", "to_entity_id", "relation_from"), edges("to_entity_id", "from_entity_id", "relation_to")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def subgraph(ids: DataFrame, entities: DataFrame, observations: DataFrame, relations: DataFrame, now: str, query: str | None = None, vector: Column | None = None, limit: int = 0) -> DataFrame:
    """Rows of the entities among ``ids``, their ranked active observations, the edges between them, and the ids that aren't there (``missing``)."""
    observations, relations = _about(ids, observations, relations)
    none = F.lit(None).cast("string")
    inside = induced_edges(relations, ids).select(F.col("from_entity_id").alias("entity_id"), F.lit("relation").alias("part"), F.lit(0).alias("position"), F.col("id").alias("ref_id"), F.col("relation_type").alias("kind"), F.col("to_entity_id").cast("string").alias("label"))
    missing = ids.select("id").distinct().join(entities.select("id"), "id", "left_anti").select(F.col("id").alias("entity_id"), F.lit("missing").alias("part"), F.lit(0).alias("position"), F.col("id").alias("ref_id"), none.alias("kind"), none.alias("label"))
    ranked = _ranked(ids, observations, relations, now, query, vector, limit, False)
    return _entities(ids, entities).unionByName(_observations(ranked)).unionByName(inside).unionByName(missing)


def expanded(scored: DataFrame, relations: DataFrame, depth: int, most: int) -> DataFrame:
    """(id, score): the scored entities and what each reaches within ``depth`` (``most`` of them, itself included, by lowest edge), at 0.8 of its score.

    What several reach, or is scored itself, keeps the score of the first in rank.
    """
    ranked = kept(scored.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id"))))  # a result list: its limit bounds it
    ends = relations.select("id", F.col("from_entity_id").alias("a"), F.col("to_entity_id").alias("b"))
    edges = kept(ends.unionByName(ends.select("id", F.col("b").alias("a"), F.col("a").alias("b"))))
    seen = kept(ranked.select(F.col("rank").alias("start"), "id", F.lit(0).alias("level"), F.lit(-1).cast("long").alias("edge")))
    frontier = seen
    for level in range(1, depth + 1):
        met = frontier.select("start", F.col("id").alias("a")).join(edges.withColumnRenamed("id", "edge"), "a").groupBy("start", F.col("b").alias("id")).agg(F.min("edge").alias("edge"))
        new = met.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("level", F.lit(level))
        place = F.row_number().over(W.partitionBy("start").orderBy("level", "edge", "id"))
        frontier = kept(new)
        seen = kept(seen.unionByName(frontier).withColumn("_n", place).where(F.col("_n") <= most).drop("_n"))
        frontier = frontier.join(seen.select("start", "id"), ["start", "id"], "left_semi")
    first = seen.join(ranked.select("id"), "id", "left_anti").groupBy("id").agg(F.min("start").alias("rank"))
    added = first.join(ranked.select("rank", "score"), "rank").select("id", (F.col("score") * 0.8).alias("score"))
    return ranked.select("id", "score").unionByName(added)


def evidence(scored: DataFrame, entities: DataFrame, observations: DataFrame, relations: DataFrame, now: str, query: str, vector: Column | None = None, each: int = 3, most: int = 20, conflict: float = 0.35) -> DataFrame:
    """The best active observations of the scored entities (id, score): by query relevance, entity score, trust, confidence and id.

    At most ``each`` an entity and ``most`` in all; ``has_contradiction`` marks one that
    lies close to another of them but has the opposite polarity.
    """
    own = observations.where("status = 'active'").join(scored.select(F.col("id").alias("memory_entity_id"), F.col("score").alias("entity_relevance")), "memory_entity_id")
    rows = relevance(trust_scores(own, relations, now), query, vector).withColumn("query_relevance", F.round("relevance", 4))
    order = [F.desc("query_relevance"), F.desc("entity_relevance"), F.desc("trust_score"), F.desc(F.coalesce("confidence", F.lit(0.0))), F.asc("id")]
    best = kept(diverse_evidence(rows, *order, each=each, all_=most).withColumn("neg", T.negative(F.col("content"))))
    placed = best.withColumn("position", F.row_number().over(W.orderBy(*order)))  # ``most`` rows
    if "embedding" in best.columns:
        near = nearest_pairs(best.where("embedding IS NOT NULL").select(F.lit("").alias("key"), "id", F.col("embedding").alias("v")), conflict, most, later_only=False)
        neg = best.select("id", "neg")
        met = near.join(neg.withColumnsRenamed({"id": "a", "neg": "_x"}), "a").join(neg.withColumnsRenamed({"id": "b", "neg": "_y"}), "b").where("_x <> _y").select(F.col("a").alias("id"), F.lit(True).alias("has_contradiction")).distinct()
        placed = placed.join(met, "id", "left")
    else:
        placed = placed.withColumn("has_contradiction", F.lit(False))
    named = placed.join(entities.select(F.col("id").alias("memory_entity_id"), F.col("name").alias("entity_name")), "memory_entity_id", "left")
    return named.select("position", "id", "memory_entity_id", "entity_name", F.round("entity_relevance", 4).alias("entity_relevance"), "query_relevance", "trust_score", F.coalesce("has_contradiction", F.lit(False)).alias("has_contradiction"), "content").orderBy("position")
