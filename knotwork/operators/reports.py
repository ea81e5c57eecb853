"""What is handed on of a graph: project reports, elements to be drawn, rows as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.functions import text as T
from knotwork.operators import graph as G
from knotwork.sources.views import Graph

ISSUES, RECENT = 10, 5


def project_sections(g: Graph, issues: int = ISSUES, recent: int = RECENT) -> DataFrame:
    """(project_id, section, position, ref_id, line) of every Project: its title, first related issues and newest observations.

    Issues stand by the first edge that joins them to the project, either way, each
    once; observations, of any status, by creation, the newest and larger id first. Names are cut at
    50 characters, contents at 150. A project's first rows are found before the
    shuffle, so one with very many is no larger task.
    """
    projects = g.entities.where("entity_type = 'Project'").select(F.col("id").alias("project_id"), F.col("name").alias("title"))
    ids = projects.select("project_id")
    ends = lambda a, b: g.relations.select(F.col(a).alias("project_id"), F.col(b).alias("ref_id"), "id")
    wanted = g.entities.where("entity_type = 'Issue'").select(F.col("id").alias("ref_id"), "name")
    near = ends("from_entity_id", "to_entity_id").unionAll(ends("to_entity_id", "from_entity_id")).join(ids, "project_id").where("ref_id <> project_id")
    met = near.join(wanted.select("ref_id"), "ref_id", "left_semi").groupBy("project_id", "ref_id").agg(F.min("id").alias("edge"))
    first = lambda df, n, *order: df.withColumn("position", F.row_number().over(W.partitionBy("project_id").orderBy(*order))).where(F.col("position") <= n)
    top = first(met, issues, "edge", "ref_id").join(wanted, "ref_id")
    label = T.truncated(F.regexp_replace("name", r"[%\r\n]", " "), 50)
    facts = g.observations.select(F.col("memory_entity_id").alias("project_id"), F.col("id").alias("ref_id"), "content", "created_at").join(ids, "project_id", "left_semi")
    newest = first(facts, recent, F.desc("created_at"), F.desc("ref_id"))
    part = lambda df, section, line: df.select("project_id", F.lit(section).alias("section"), "position", "ref_id", line.alias("line"))
    return part(projects.withColumn("position", F.lit(1)).withColumn("ref_id", F.col("project_id")), "project", F.concat(F.lit("## Project: "), "title")).unionByName(
        part(top, "issues", F.concat(F.lit("- ID "), F.col("ref_id").cast("string"), F.lit(": "), label))
    ).unionByName(part(newest, "recent", F.concat(F.lit("- `"), F.date_format("created_at", "yyyy-MM-dd"), F.lit("`: "), T.truncated(F.coalesce("content", F.lit("")), 150))))


def elements(g: Graph, ids: DataFrame | None = None, focus: int | None = None) -> DataFrame:
    """(group, id, label, type, aliases, n_observations, is_focus, source, target, from_name, to_name): nodes and edges to be drawn.

    With ``ids`` only those entities and the edges among them. ``n_observations`` counts active ones.
    """
    nodes, edges = g.entities, g.relations
    if ids is not None:
        nodes, edges = nodes.join(ids.select("id").distinct(), "id", "left_semi"), G.induced_edges(edges, ids)
    counts = g.observations.where("status = 'active'").groupBy(F.col("memory_entity_id").alias("id")).agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    name = nodes.select("id", "name")
    drawn = nodes.join(counts, "id", "left").select(
        F.lit("nodes").alias("group"), F.col("id").cast("string").alias("id"), F.col("name").alias("label"), F.col("entity_type").alias("type"), "aliases", F.coalesce("n", F.lit(0)).cast("long").alias("n_observations"),
        (F.col("id") == F.lit(focus)).alias("is_focus") if focus is not None else F.lit(False).alias("is_focus"), none.alias("source"), none.alias("target"), none.alias("from_name"), none.alias("to_name"),
    )
    named = edges.join(name.withColumnsRenamed({"id": "from_entity_id", "name": "from_name"}), "from_entity_id", "left").join(name.withColumnsRenamed({"id": "to_entity_id", "name": "to_name"}), "to_entity_id", "left")
    lines = named.select(
        F.lit("edges").alias("group"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), F.col("relation_type").alias("label"), none.alias("type"), none.alias("aliases"), F.lit(None).cast("long").alias("n_observations"),
        F.lit(None).cast("boolean").alias("is_focus"), F.col("from_entity_id").cast("string").alias("source"), F.col("to_entity_id").cast("string").alias("target"), "from_name", "to_name",
    )
    return drawn.unionByName(lines)


def iso8601(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _as_json(df: DataFrame, key: str, fields: list[str]) -> Column:
    """One JSON text of a row: its id under ``key``, then the fields that the table has; times in ISO form, nulls kept."""
    kinds = dict(df.dtypes)
    shown = [(iso8601(F.col(f)) if kinds[f].startswith("timestamp") else F.col(f)).alias(f) for f in fields if f in kinds]
    return F.to_json(F.struct(F.col("id").alias(key), *shown), {"ignoreNullFields": "false"})


def observation_json(df: DataFrame) -> Column:
    return _as_json(df, "observation_id", ["content", "confidence", "trust_score", "source", "valid_from", "valid_until", "tags", "status", "obsoleted_at", "obsolescence_reason", "superseded_by_id", "created_at", "updated_at"])


def relation_json(df: DataFrame) -> Column:
    return _as_json(df, "relation_id", ["from_entity_id", "to_entity_id", "relation_type", "weight", "confidence", "properties", "created_at", "updated_at"])


def entity_json(df: DataFrame) -> Column:
    return _as_json(df, "entity_id", ["name", "entity_type", "aliases", "description", "created_at", "updated_at"])
