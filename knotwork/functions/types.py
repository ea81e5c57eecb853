"""Canonical names of entity and relation types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Canonical entity types and the variants that map to them.
ENTITY_TYPES = {
    "Project": "project projects workspace workspaces context repo repository codebase",
    "Framework": "framework frameworks lib library",
    "ApplicationStack": "applicationstack application_stack app_stack stack techstack tech_stack",
    "Workflow": "workflow workflows process",
    "BestPractice": "bestpractice best_practice practice guideline convention pattern",
    "Task": "task tasks todo",
    "Step": "step steps substep sub_step",
    "Issue": "issue issues bug problem",
    "Error": "error errors exception",
    "PossibleSolution": "possiblesolution possible_solution solution workaround fix",
    "Model": "model models activerecord_model",
    "DatabaseTable": "databasetable database_table table db_table",
    "DatabaseSchema": "databaseschema database_schema schema db_schema",
    "Class": "class classes module",
    "APIEndpoint": "apiendpoint api_endpoint endpoint api",
    "Route": "route routes",
    "Component": "component components widget",
    "Service": "service services",
    "Configuration": "configuration config setting settings",
    "Migration": "migration migrations db_migration",
    "TestCase": "testcase test_case test spec",
    "Permission": "permission permissions role",
    "User": "user users person",
    "Preference": "preference preferences pref",
    "Constant": "constant constants const",
    "ProjectPlan": "projectplan project_plan plan",
    "Feature": "feature features",
    "Gem": "gem gems rubygem",
    "Tool": "tool tools",
    "Resource": "resource resources",
    "Documentation": "documentation docs doc readme",
}
# Canonical relation types and their variants.
RELATION_TYPES = {
    "part_of": "partof belongs_to child_of contained_in",
    "depends_on": "dependson requires prerequisite_of",
    "relates_to": "related_to relatedto associated_with connected_to connects_to",
    "implements": "implementation_of provides",
    "solves": "resolves fixes solution_for",
}


def variants(table: dict[str, str]) -> dict[str, str]:
    """Lower-case variant (the canonical name is one) to canonical name."""
    out = {v: c for c, vs in table.items() for v in vs.split()}
    return out | {c.lower(): c for c in table}


def canonical(raw: Column, table: dict[str, str]) -> Column:
    """The canonical type of a raw one, else the raw one as it stands. A literal map: no join for a fixed dictionary."""
    pairs = [F.lit(x) for kv in variants(table).items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.trim(raw))), raw)


def canonical_by_table(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Same through a mapping table (variant, canonical_type), for dictionaries kept as data."""
    m = mapping.groupBy(F.lower("variant").alias("_v")).agg(F.min("canonical_type").alias("_c"))
    return df.join(m, F.lower(F.trim(F.col(column))) == F.col("_v"), "left").withColumn(column, F.coalesce("_c", column)).drop("_v", "_c")


def canonical_one(raw: str, table: dict[str, str]) -> str:
    return variants(table).get(raw.strip().lower(), raw)
