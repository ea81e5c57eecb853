"""Counts, distributions, coverage and health of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.operators import graph as G
from knotwork.operators.search import degree
from knotwork.sources.views import Graph


def totals(g: Graph, audit: DataFrame) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n") for name, df in (("entities", g.entities), ("observations", g.observations), ("relations", g.relations), ("audit_logs", audit))]
    return reduce(DataFrame.unionAll, parts)


def type_distribution(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_type")


def most_connected(entities: DataFrame, relations: DataFrame, limit: int = 10) -> DataFrame:
    """The top degrees are found before names are joined."""
    top = degree(relations).orderBy(F.desc("degree"), "id").limit(limit)
    return top.join(entities.select("id", "name", "entity_type"), "id").orderBy(F.desc("degree"), "id")


def recently_updated(entities: DataFrame, limit: int = 10) -> DataFrame:
    return entities.select("id", "name", "updated_at").orderBy(F.desc("updated_at"), "id").limit(limit)


def embedding_coverage(df: DataFrame) -> DataFrame:
    """total, missing, percent (100 for an empty table)."""
    total, have = F.count("*"), F.count("embedding")
    return df.agg(total.alias("total"), (total - have).alias("missing"), F.when(total == 0, 100.0).otherwise(F.round(100.0 * have / F.greatest(total, F.lit(1)))).alias("percent"))


def activity(df: DataFrame, at: str, now: str) -> DataFrame:
    """Clients by how long ago they were seen: active (5 minutes), idle (an hour), stale, unknown."""
    age = F.lit(now).cast("timestamp").cast("double") - F.col(at).cast("timestamp").cast("double")
    bucket = F.when(F.col(at).isNull(), "unknown").when(age <= 300, "active").when(age <= 3600, "idle").otherwise("stale")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def activity_summary(df: DataFrame, at: str, context: str, now: str) -> DataFrame:
    """One row: clients in all, seen in the last 5 minutes, and with a project context."""
    age = F.lit(now).cast("timestamp").cast("double") - F.col(at).cast("timestamp").cast("double")
    return df.agg(F.count("*").alias("total"), F.count_if(age <= 300).alias("recent_count"), F.count(context).alias("with_context_count"))


def latest_per(df: DataFrame, key: str, *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def beyond_retention(df: DataFrame, key: str, keep: int, *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_n") > keep).drop("_n")


def health(g: Graph) -> DataFrame:
    """Six metrics to compare before and after maintenance."""
    from knotwork.operators import quality as Q

    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
    parts = [
        one(g.entities, "entities"), one(g.observations.where("status = 'active'"), "active_observations"), one(g.relations, "relations"),
        one(G.hierarchy_orphans(g.entities, g.relations), "orphans"), one(Q.duplicate_observations(g.observations), "duplicate_groups"), one(Q.dangling(g.entities, g.relations), "dangling"),
    ]
    return reduce(DataFrame.unionAll, parts)


def types_around_projects(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities per type below each Project."""
    up = G.ancestor_projects(entities, relations)
    return up.where(F.col("id") != F.col("project_id")).join(entities.select("id", "entity_type"), "id").groupBy("project_id", "entity_type").agg(F.count("*").alias("n"))


def grouped_evidence(observations: DataFrame, entities: DataFrame) -> DataFrame:
    """One text per entity: its active observations in id order."""
    rows = observations.where("status = 'active'").groupBy("memory_entity_id").agg(F.array_sort(F.collect_list(F.struct("id", "content"))).alias("o"))
    lines = F.array_join(F.transform("o", lambda x: F.concat(F.lit("- "), x["content"])), "\n")
    return rows.join(entities.select(F.col("id").alias("memory_entity_id"), "name", "entity_type"), "memory_entity_id").select("memory_entity_id", F.concat(F.col("name"), F.lit(" ("), F.col("entity_type"), F.lit(")\n"), lines).alias("evidence"))


def audit_summary(audit: DataFrame, now: str, days: int = 7, keep_days: int = 90) -> DataFrame:
    at = F.lit(now).cast("timestamp")
    return audit.agg(F.count("*").alias("total"), F.count_if(F.col("created_at") >= at - F.make_dt_interval(days=F.lit(days))).alias("filtered"), F.count_if(F.col("created_at") < at - F.make_dt_interval(days=F.lit(keep_days))).alias("expired"))


def child_counts(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """part_of children of each id of a page."""
    rows = relations.where("relation_type = 'part_of'").join(ids.select(F.col("id").alias("to_entity_id")), "to_entity_id", "left_semi")
    return rows.groupBy(F.col("to_entity_id").alias("id")).agg(F.count("*").alias("children"))


def running_progress(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Progress that never falls back."""
    return df.withColumn("progress", F.max(value).over(W.partitionBy(key).orderBy(order, value).rowsBetween(W.unboundedPreceding, 0)))


def snapshot(g: Graph, audit: DataFrame) -> DataFrame:
    """(section, name, value): totals, isolated entities, embedding coverage, the latest change of each kind."""
    parts = [totals(g, audit).select(F.lit("totals").alias("section"), F.col("metric").alias("name"), F.col("n").cast("double").alias("value"))]
    parts.append(G.isolated(g.entities, g.observations, g.relations).agg(F.count("*").cast("double").alias("value")).select(F.lit("graph").alias("section"), F.lit("isolated").alias("name"), "value"))
    if "embedding" in g.observations.columns:
        covered = embedding_coverage(g.observations)
        parts += [covered.select(F.lit("embeddings").alias("section"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in ("missing", "percent")]
    latest = latest_per(audit, "auditable_type", F.desc("created_at"), F.desc("id"))
    parts.append(latest.select(F.lit("latest").alias("section"), F.col("auditable_type").alias("name"), F.col("id").cast("double").alias("value")))
    return reduce(DataFrame.unionAll, parts)


def first_of_each(rows: DataFrame, key: str, most: int, *order) -> DataFrame:
    """The first ``most`` rows of each key with their position."""
    return rows.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("position") <= most)


def path_counts(entities: DataFrame, relations: DataFrame, roots: DataFrame, depth: int = 4) -> DataFrame:
    """(root, n): nodes of each root's export tree, counted once a path."""
    return G.export_paths(entities, relations, roots, depth).groupBy("root").agg(F.count("*").alias("n"))
