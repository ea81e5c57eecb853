"""Duplicates, integrity and lifecycle checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.operators.graph import isolated
from knotwork.sources.shared import kept
from knotwork.sources.views import Graph


def duplicate_observations(observations: DataFrame, case_insensitive: bool = False) -> DataFrame:
    """(memory_entity_id, keep_id, n) of repeated active contents; long contents are grouped by their digest."""
    content = F.lower(F.rtrim("content")) if case_insensitive else F.col("content")
    rows = observations.where("status = 'active'").withColumn("_h", F.md5(content))
    return rows.groupBy("memory_entity_id", "_h").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1").drop("_h")


def redundant_observations(observations: DataFrame, oldest: bool = False) -> DataFrame:
    """Ids to delete: all but the first of equal active contents by id, or by creation."""
    order = ["created_at", "id"] if oldest else ["id"]
    w = W.partitionBy("memory_entity_id", F.md5("content")).orderBy(*order)
    return observations.where("status = 'active'").withColumn("_n", F.row_number().over(w)).where("_n > 1").select("id", "memory_entity_id")


def duplicate_relations(relations: DataFrame) -> DataFrame:
    """(from, to, type, keep_id, delete_ids) of repeated edges."""
    ids = F.array_sort(F.collect_list("id"))
    rows = relations.groupBy("from_entity_id", "to_entity_id", "relation_type").agg(F.count("*").alias("n"), ids.alias("ids")).where("n > 1")
    return rows.select("from_entity_id", "to_entity_id", "relation_type", F.col("ids")[0].alias("keep_id"), F.array_join(F.slice("ids", 2, 1_000_000_000).cast("array<string>"), "-").alias("delete_ids"))


def reverse_pairs(relations: DataFrame) -> DataFrame:
    """(keep_id, delete_id, relation_type): the first edge each way between two ends, by one type; the lower id stays. One aggregation."""
    up = F.col("from_entity_id") < F.col("to_entity_id")
    ends = [F.least("from_entity_id", "to_entity_id").alias("low"), F.greatest("from_entity_id", "to_entity_id").alias("high"), "relation_type"]
    rows = relations.where(F.col("from_entity_id") != F.col("to_entity_id")).select(*ends, F.when(up, F.col("id")).alias("up"), F.when(~up, F.col("id")).alias("down"))
    both = rows.groupBy("low", "high", "relation_type").agg(F.min("up").alias("up"), F.min("down").alias("down")).where("up IS NOT NULL AND down IS NOT NULL")
    return both.select(F.least("up", "down").alias("keep_id"), F.greatest("up", "down").alias("delete_id"), "relation_type")


def merge_collisions(relations: DataFrame, single_parent: tuple[str, ...] = ("part_of",)) -> DataFrame:
    """(from_entity_id, relation_type, keep_id, delete_id): of a child's several parents the one with the lowest edge id stays."""
    rows = relations.where(F.col("relation_type").isin(*single_parent))
    first = rows.groupBy("from_entity_id", "relation_type").agg(F.min("id").alias("keep_id"), F.min("to_entity_id").alias("_low"), F.max("to_entity_id").alias("_high")).where("_low <> _high").drop("_low", "_high")
    return rows.join(first, ["from_entity_id", "relation_type"]).where("id <> keep_id").select("from_entity_id", "relation_type", "keep_id", F.col("id").alias("delete_id"))


def multi_parent(relations: DataFrame) -> DataFrame:
    """(from_entity_id, keep_id, parents) of children with several parents."""
    rows = relations.where("relation_type = 'part_of'").groupBy("from_entity_id").agg(F.count_distinct("to_entity_id").alias("parents"), F.min("id").alias("keep_id"))
    return rows.where("parents > 1")


def dangling(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Ids of relations with an end that is no entity, one row a relation; ids may repeat."""
    ids = entities.select("id")
    froms, tos = ids.withColumnRenamed("id", "from_entity_id"), ids.withColumnRenamed("id", "to_entity_id")
    a = relations.join(froms, "from_entity_id", "left_anti").select("id")
    b = relations.join(froms, "from_entity_id", "left_semi").join(tos, "to_entity_id", "left_anti").select("id")
    return a.unionAll(b)


def lifecycle_issues(observations: DataFrame) -> DataFrame:
    """(id, issue): active with obsoleted_at; superseded without a reference; superseded by another entity's."""
    a = observations.where((F.col("status") == "active") & F.col("obsoleted_at").isNotNull()).select("id", F.lit("active_with_obsoleted_at").alias("issue"))
    b = observations.where((F.col("status") == "superseded") & F.col("superseded_by_id").isNull()).select("id", F.lit("superseded_without_reference").alias("issue"))
    other = observations.select(F.col("id").alias("superseded_by_id"), F.col("memory_entity_id").alias("_e"))
    c = observations.join(other, "superseded_by_id").where(F.col("_e") != F.col("memory_entity_id")).select("id", F.lit("superseded_by_other_entity").alias("issue"))
    return a.unionAll(b).unionAll(c)


def counter_drift(entities: DataFrame, observations: DataFrame, column: str = "memory_observations_count") -> DataFrame:
    """(id, stored, counted) where the stored counter differs; all statuses count."""
    counted = observations.groupBy(F.col("memory_entity_id").alias("id")).agg(F.count("*").alias("counted"))
    rows = entities.select("id", F.col(column).alias("stored")).join(counted, "id", "left").withColumn("counted", F.coalesce("counted", F.lit(0).cast("long")))
    return rows.where(F.col("stored") != F.col("counted"))


def counters_repaired(entities: DataFrame, observations: DataFrame, column: str = "memory_observations_count") -> DataFrame:
    """Entities with the stored counter set to what is there."""
    counted = observations.groupBy(F.col("memory_entity_id").alias("id")).agg(F.count("*").alias("_counted"))
    return entities.join(counted, "id", "left").withColumn(column, F.coalesce("_counted", F.lit(0).cast("long"))).select(*entities.columns)


def stale_embeddings(df: DataFrame) -> DataFrame:
    return df.where(F.col("embedding").isNull()).select("id")


def sweep(g: Graph, touched: DataFrame | None = None, counter: str = "memory_observations_count") -> tuple[Graph, DataFrame]:
    """The integrity sweep: (the graph after it, findings (step, kind, id, ref_id)).

    1. repeated edges go, the first stays; edges both ways and second parents are told;
    2. entities without anything are told; repeated active contents go, the first stays;
    3. stored counters are set to what is there;
    4. edges with a missing end go;
    5. rows without a vector are told;
    6. faults in the life of observations are told.

    Each step reads what the ones before left. With ``touched`` (ids), as after an earlier
    sweep, counters and lives are looked at for those entities only, and for those whose
    observations this sweep deleted.
    """
    row = lambda df, step, kind, i, ref: df.select(F.lit(step).alias("step"), F.lit(kind).alias("kind"), F.col(i).cast("long").alias("id"), (F.lit(None) if ref is None else F.col(ref)).cast("long").alias("ref_id"))
    w = W.partitionBy("from_entity_id", "to_entity_id", "relation_type")
    marked = kept(g.relations.withColumn("_keep", F.min("id").over(w)))
    again = marked.where("id <> _keep")
    found = [row(again, 1, "same_direction", "id", "_keep"), row(reverse_pairs(g.relations), 1, "reverse_pair", "delete_id", "keep_id"), row(merge_collisions(g.relations), 1, "second_parent", "delete_id", "keep_id")]
    relations = marked.where("id = _keep").select(*g.relations.columns)
    keep = F.min("id").over(W.partitionBy("memory_entity_id", F.md5("content")))
    repeats = kept(g.observations.where("status = 'active'").withColumn("_keep", keep).where("id <> _keep").select("id", "memory_entity_id", "_keep"))
    found += [row(isolated(g.entities, g.observations, relations), 2, "orphan", "id", None), row(repeats, 2, "repeated_observation", "id", "_keep")]
    observations = g.observations.join(repeats.select("id"), "id", "left_anti").select(*g.observations.columns)
    entities, looked, lives = g.entities, g.entities, observations
    if touched is not None:
        some = kept(touched.select("id").unionAll(repeats.select(F.col("memory_entity_id").alias("id"))).distinct())
        looked = entities.join(some, "id", "left_semi")
        lives = observations.join(some.withColumnRenamed("id", "memory_entity_id"), "memory_entity_id", "left_semi").select(*observations.columns)
    if counter in entities.columns:
        drift = kept(counter_drift(looked, lives, counter))
        found.append(row(drift, 3, "counter", "id", "counted"))
        entities = entities.join(drift.select("id", "counted"), "id", "left").withColumn(counter, F.coalesce("counted", counter).cast(entities.schema[counter].dataType)).select(*g.entities.columns)
    lost = kept(dangling(entities, relations).distinct())
    found.append(row(lost, 4, "dangling", "id", None))
    relations = relations.join(lost, "id", "left_anti").select(*g.relations.columns)
    found += [row(stale_embeddings(df), 5, f"{what}_without_vector", "id", None) for what, df in (("entity", entities), ("observation", observations)) if "embedding" in df.columns]
    faults = lifecycle_issues(observations) if touched is None else lifecycle_issues(observations).join(lives.select("id"), "id", "left_semi")
    found.append(faults.select(F.lit(6).alias("step"), F.col("issue").alias("kind"), F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("ref_id")))
    return Graph(entities, observations, relations), reduce(DataFrame.unionByName, found)


def repaired(entities: DataFrame, observations: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Integrity sweep as table rewrites: repeated edges, repeated observations, dangling edges, in that order."""
    first = relations.withColumn("_n", F.row_number().over(W.partitionBy("from_entity_id", "to_entity_id", "relation_type").orderBy("id"))).where("_n = 1").drop("_n")
    kept_observations = observations.join(redundant_observations(observations).select("id"), "id", "left_anti")
    kept_relations = first.join(dangling(entities, first), "id", "left_anti")
    return entities, kept_observations, kept_relations
