"""Trust and relevance of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.functions import vectors as V
from knotwork.operators.search import degree


def validity(now: Column) -> Column:
    return F.when(now < F.col("valid_from"), 0.5).when(now > F.col("valid_until"), 0.0).otherwise(1.0)


def source_weight() -> Column:
    return F.when(T.mentions_any(F.col("source"), T.HIGH_TRUST), 1.15).when(T.mentions_any(F.col("source"), T.LOW_TRUST), 0.85).otherwise(1.0)


def trust_scores(observations: DataFrame, relations: DataFrame, now: str) -> DataFrame:
    """Observations with ``trust_score``: confidence x status x validity x source, plus a boost for connected entities.

    The boost also reaches obsolete and expired observations.
    """
    at = F.lit(now).cast("timestamp")
    base = F.coalesce(F.col("confidence"), F.lit(0.5)) * F.when(F.col("status") == "active", 1.0).otherwise(0.0) * validity(at) * source_weight()
    boost = F.least(F.log2(1 + F.coalesce(F.col("degree"), F.lit(0))) * 0.05, F.lit(0.2))
    rows = observations.join(degree(relations).withColumnRenamed("id", "memory_entity_id"), "memory_entity_id", "left")
    return rows.withColumn("trust_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(base + boost, 4)))).drop("degree")


def rescored(observations: DataFrame, relations: DataFrame, changed: DataFrame, now: str) -> DataFrame:
    """Observations (with ``trust_score``) after edges changed: those of the ends of ``changed`` are scored again, the others stand."""
    ends = changed.select(F.explode(F.array("from_entity_id", "to_entity_id")).alias("memory_entity_id")).distinct()
    near = relations.where("from_entity_id IS NOT NULL AND to_entity_id IS NOT NULL")
    again = trust_scores(observations.join(ends, "memory_entity_id", "left_semi").drop("trust_score"), near, now)
    return observations.join(ends, "memory_entity_id", "left_anti").unionByName(again.select(*observations.columns))


def relevance(observations: DataFrame, query: str, vector: Column | None = None) -> DataFrame:
    """Observations with ``relevance``: 0.6 token overlap + 0.4 (1 - distance); overlap alone without a vector."""
    q = F.expr("array()").cast("array<string>") if not query.strip() else T.tokens(F.lit(query))
    share = T.overlap(q, T.tokens(F.col("content")))
    if vector is None:
        return observations.withColumn("relevance", share)
    distance = V.cosine_distance(F.col("embedding"), vector)
    return observations.withColumn("relevance", F.when(distance.isNull(), share).otherwise(0.6 * share + 0.4 * F.greatest(1 - distance, F.lit(0.0))))


def rank_observations(observations: DataFrame, relations: DataFrame, now: str, query: str | None = None, vector: Column | None = None, limit: int = 0) -> DataFrame:
    """Best observations first: by relevance if there is a query, else by trust; a limit of 0 keeps all."""
    rows = trust_scores(observations, relations, now)
    order = [F.desc("trust_score"), F.desc(F.coalesce("confidence", F.lit(0.0))), F.asc("id")]
    if query:
        rows = relevance(rows, query, vector)
        order = [F.desc("relevance"), *order]
    rows = rows.orderBy(*order)
    return rows.limit(limit) if limit > 0 else rows
