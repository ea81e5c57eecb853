"""Graph tables as views over the star-schema parquet tables.

Identifiers are arithmetic on the source keys (kind * 10^10 + key), so no global
sort or counter is needed. A filter on a computed id reaches no file; where the id
is known, ``entity`` reads its one source by its key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators.order import parts as dealt

KIND = 10_000_000_000
EDGE = 1_000_000_000_000
#: "Now" is a parameter everywhere; the queries of the driver contract use this one.
NOW = "2024-06-01 00:00:00"
#: Parts that observations are attached to; all scales have so many.
SUBJECTS = 200
#: Order lines made distinct by one task: whatever is aggregated right after them is held by as many rows.
LINES_EACH = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(spark: SparkSession, sf_dir: str, entity_id: int) -> DataFrame:
    """One entity, found by its source's key; the filter reaches the files."""
    return entities(spark, sf_dir, entity_id)


def entities(spark: SparkSession, sf_dir: str, only: int | None = None) -> DataFrame:
    """id, name, entity_type, aliases, description, created_at, updated_at."""

    def part(table_name: str, kind: int, entity_type: str, key: str, name, aliases, description=None) -> DataFrame:
        k = F.col(key).cast("long")
        born = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(k % 300).cast("int"))
        rows = table(spark, sf_dir, table_name)
        if only is not None:
            rows = rows.where(F.col(key) == only - kind * KIND if only // KIND == kind else F.lit(False))
        return rows.select(
            (k + kind * KIND).alias("id"), name.alias("name"), F.lit(entity_type).alias("entity_type"), aliases.alias("aliases"),
            (F.lit(None) if description is None else description).cast("string").alias("description"),
            born.alias("created_at"), (born + F.make_dt_interval(days=(k % 37).cast("int"))).alias("updated_at"),
        )

    c, none = F.col, F.lit(None).cast("string")
    parts = [
        part("region", 1, "Project", "r_regionkey", c("r_name"), none),
        part("nation", 2, "Framework", "n_nationkey", c("n_name"), none),
        part("customer", 3, "User", "c_custkey", c("c_name"), c("c_mktsegment")),
        part("supplier", 4, "Service", "s_suppkey", c("s_name"), none),
        part("part", 5, "Component", "p_partkey", F.concat("p_name", F.lit(" #"), c("p_partkey").cast("string")), F.concat("p_brand", F.lit(","), "p_type"), F.concat(F.lit("size "), c("p_size").cast("string"))),
        part("orders", 6, "Task", "o_orderkey", F.concat(F.lit("Order#"), c("o_orderkey").cast("string")), c("o_orderpriority")),
        part("benchmark", 7, "Issue", "item_id", F.concat(F.lit("Benchmark#"), c("item_id").cast("string")), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, from_entity_id, to_entity_id, relation_type."""

    def edge(df: DataFrame, rel_id, a, b, kind: str) -> DataFrame:
        return df.select(rel_id.alias("id"), a.alias("from_entity_id"), b.alias("to_entity_id"), F.lit(kind).alias("relation_type"))

    k = lambda name: F.col(name).cast("long")
    t = lambda name: table(spark, sf_dir, name)
    line = t("lineitem")
    n = dealt(line, rows_each=LINES_EACH)  # counted from the files' footers; by bytes, a task would get millions of small keys
    pairs_of = lambda df, *keys: df.select(*keys).repartition(n, *keys).distinct()
    wide = F.lit(100_000).cast("long")
    parts = [
        edge(t("nation"), k("n_nationkey") + 1 * EDGE, k("n_nationkey") + 2 * KIND, k("n_regionkey") + 1 * KIND, "part_of"),
        edge(t("customer"), k("c_custkey") + 2 * EDGE, k("c_custkey") + 3 * KIND, k("c_nationkey") + 2 * KIND, "part_of"),
        edge(t("supplier"), k("s_suppkey") + 3 * EDGE, k("s_suppkey") + 4 * KIND, k("s_nationkey") + 2 * KIND, "part_of"),
        edge(t("orders"), k("o_orderkey") + 4 * EDGE, k("o_orderkey") + 6 * KIND, k("o_custkey") + 3 * KIND, "part_of"),
        edge(pairs_of(line, "l_orderkey", "l_partkey"), k("l_orderkey") * wide + k("l_partkey") + 5 * EDGE, k("l_orderkey") + 6 * KIND, k("l_partkey") + 5 * KIND, "depends_on"),
    ]
    for flag, base, swap in (("N", 6, False), ("R", 7, True)):
        pairs = pairs_of(line.where(F.col("l_returnflag") == flag), "l_partkey", "l_suppkey")
        a, b = k("l_partkey") + 5 * KIND, k("l_suppkey") + 4 * KIND
        parts.append(edge(pairs, k("l_partkey") * wide + k("l_suppkey") + base * EDGE, *((b, a) if swap else (a, b)), "relates_to"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def raw_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dirty edge list: order lines as they stand (repeated edges) and parts with many suppliers as parents."""
    line = table(spark, sf_dir, "lineitem")
    k = lambda name: F.col(name).cast("long")
    row = k("l_orderkey") * 1_000_000 + k("l_partkey") * 10 + k("l_linenumber")
    return line.select((row + 8 * EDGE).alias("id"), (k("l_orderkey") + 6 * KIND).alias("from_entity_id"), (k("l_partkey") + 5 * KIND).alias("to_entity_id"), F.lit("depends_on").alias("relation_type")).unionByName(
        line.select((row + 9 * EDGE).alias("id"), (k("l_partkey") + 5 * KIND).alias("from_entity_id"), (k("l_suppkey") + 4 * KIND).alias("to_entity_id"), F.lit("part_of").alias("relation_type"))
    )


def observations(spark: SparkSession, sf_dir: str, with_vectors: bool = False) -> DataFrame:
    """Documents as versioned facts about parts; state is arithmetic on doc_id."""
    d = F.col("doc_id")
    t = lambda x: F.lit(x).cast("timestamp")
    status = F.when(d % 11 == 0, "obsolete").when(d % 13 == 0, "superseded").otherwise("active")
    born = t("2024-01-01") + F.make_dt_interval(days=(d % 300).cast("int"))
    rows = table(spark, sf_dir, "documents").select(
        d.alias("id"), (d % SUBJECTS + 5 * KIND).alias("memory_entity_id"), F.col("text").alias("content"),
        F.when(d % 5 != 0, (d % 10) / 10).alias("confidence"),
        F.when(d % 4 == 0, "official docs").when(d % 4 == 1, "hearsay").otherwise(F.col("source")).alias("source"),
        status.alias("status"), F.when((status != "active") | (d % 97 == 0), t("2024-03-01")).alias("obsoleted_at"),
        F.when((status == "superseded") & (d % 3 != 0), F.when(d % 2 == 0, d + SUBJECTS).otherwise(d + 1)).alias("superseded_by_id"),
        F.when(d % 17 == 0, t("2025-01-01")).alias("valid_from"), F.when(d % 19 == 0, t("2023-01-01")).alias("valid_until"),
        born.alias("created_at"), F.col("lang").alias("tag"),
    )
    if with_vectors:
        v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
        rows = rows.join(v, "id", "left")
    return rows


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded entities: id, entity_type (the label), name, embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("entity_type"), F.concat(F.lit("v"), (F.col("vec_id") % 50).cast("string")).alias("name"), "embedding")


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("update").alias("action"),
        F.when(F.col("event_id") % 3 == 0, "MemoryEntity").when(F.col("event_id") % 3 == 1, "MemoryObservation").otherwise("MemoryRelation").alias("auditable_type"),
        F.col("user_id").alias("actor"), "value", F.col("props").alias("changed_fields"), F.col("ts").alias("created_at"),
    )


@dataclass
class Graph:
    """The three core tables; observations may carry vectors."""

    entities: DataFrame
    observations: DataFrame
    relations: DataFrame


def graph(spark: SparkSession, sf_dir: str, with_vectors: bool = False) -> Graph:
    return Graph(entities(spark, sf_dir), observations(spark, sf_dir, with_vectors), relations(spark, sf_dir))
