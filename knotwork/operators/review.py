"""Review queue: signatures, seeding with suppression, ordering, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def signature(kind: Column, payload: Column) -> Column:
    """Identity of a review item from its JSON payload; null if a part is missing."""
    get = lambda path: F.get_json_object(payload, f"$.{path}")
    first = lambda *paths: F.coalesce(*map(get, paths))

    def joined(*parts: Column) -> Column:
        whole = F.concat_ws("|", kind, *parts)
        present = F.lit(True)
        for p in parts:
            present = present & p.isNotNull() & (F.trim(p) != "")
        return F.when(present, whole)

    pair = F.array_sort(F.array_distinct(F.filter(F.array(*[x.try_cast("long") for x in (get("entity_a.entity_id"), get("entity_b.entity_id"), get("source_id"), get("target_id"))]), lambda x: x.isNotNull())))
    entity, observation = get("entity_id"), first("observation_id", "payload.observation_id")
    return (
        F.when(kind == "entity_merge", F.when(F.size(pair) >= 2, F.concat(F.lit("entity_merge|"), F.array_join(pair.cast("array<string>"), "-"))))
        .when(kind == "relationship_proposal", joined(first("from_entity_id", "from_id"), first("to_entity_id", "to_id"), get("relation_type")))
        .when(kind == "entity_error", F.when(entity.isNotNull(), F.concat_ws("|", kind, entity, get("phase"))))
        .when(kind.isin("orphan_parent", "embedding_backfill_failed"), joined(entity))
        .when(kind == "lifecycle_corruption", joined(get("observation_id")))
        .when(kind == "relation_integrity", joined(first("issue_kind", "payload.kind"), first("payload.keep_id", "keep_id"), first("payload.delete_id", "delete_id")))
        .when(kind == "delete_relation", joined(first("relation_id", "payload.relation_id")))
        .when(kind == "delete_observation", joined(observation))
        .when(kind == "delete_entity", joined(first("entity_id", "payload.entity_id")))
        .when(kind == "dismiss_compaction_review", joined(first("review_item_id", "payload.review_item_id")))
        .when(kind == "move_observation", joined(observation, first("target_entity_id", "target_id", "payload.target_entity_id")))
        .when(kind == "reparent_entity", joined(first("entity_id", "node_id", "payload.entity_id"), first("parent_id", "payload.parent_id")))
    )


def seeded(items: DataFrame, suppressed: DataFrame, pending: DataFrame) -> DataFrame:
    """Items (position, kind, payload) that get a row: a signature, once, neither suppressed nor pending."""
    rows = items.withColumn("signature", signature(F.col("kind"), F.col("payload"))).where(F.col("signature").isNotNull())
    rows = rows.join(suppressed.select("signature"), "signature", "left_anti").join(pending.where(F.col("status").isin("active", "ignored")).select("signature"), "signature", "left_anti")
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("signature").orderBy("position"))).where("_n = 1").drop("_n")


def in_review_order(items: DataFrame) -> DataFrame:
    """Root items first, then by score, then by position."""
    return items.orderBy(F.desc("root"), F.desc_nulls_last("score"), "position")


def review_page(items: DataFrame, number: int, size: int = 20) -> DataFrame:
    """One page of the review order, from 1."""
    return in_review_order(items).offset((number - 1) * size).limit(size)


def status_counts(rows: DataFrame, status: str | None = None, kind: str | None = None) -> DataFrame:
    """Rows of each status, of one status or kind if asked."""
    for column, value in (("status", status), ("kind", kind)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def effective_payload(payload: Column, edited: Column) -> Column:
    """Edits win, key by key."""
    base, over = F.from_json(payload, "map<string,string>"), F.coalesce(F.from_json(edited, "map<string,string>"), F.expr("map()").cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(over), k)), over)


#: Moves of a review row's state.
MOVES = {"apply": ("active", "approved"), "dismiss": ("active", "dismissed"), "ignore": ("active", "ignored"), "restore": ("ignored", "active")}


def moved(rows: DataFrame, ids: DataFrame, action: str) -> DataFrame:
    """Rows after an action on those of ``ids`` whose state allows it."""
    before, after = MOVES[action]
    hit = rows.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("status", F.when(F.col("_hit") & (F.col("status") == before), after).otherwise(F.col("status"))).drop("_hit")


def resolved_before(rows: DataFrame, now: str, days: int) -> DataFrame:
    return rows.where(F.col("status").isin("approved", "dismissed") & (F.col("updated_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days))))
