"""Text, vector and hybrid search over entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.functions import vectors as V
from knotwork.operators.order import parts
from knotwork.sources.shared import kept

#: From so many scored ids on, ends of edges are counted before they are looked up; then a task has so many of the ids.
MANY_IDS, IDS_EACH = 100_000, 500_000
#: Rank constant of reciprocal rank fusion, and the distance a vector match must stay under.
RRF_K, MAX_DISTANCE = 60, 0.85
# Multipliers of entity types.
TYPE_WEIGHTS = {"Project": 1.6, "ApplicationStack": 1.3, "Framework": 1.3, "BestPractice": 1.3, "Workflow": 1.3, "Feature": 1.15, "Service": 1.15, "Component": 1.15, "Configuration": 1.15}
# Field, points for a substring, points more for a whole word.
FIELDS = [("entity_type", 15.0, 7.5), ("name", 10.0, 5.0), ("aliases", 5.0, 2.5)]


def text_search(entities: DataFrame, query: str, limit: int | None = 50) -> DataFrame:
    """id, name, entity_type, score, matched_fields, best first (score, lower type, lower name, id).

    Rows without a hit go before anything is split; the lower-cased fields and
    their words are made once a row.
    """
    found = list(dict.fromkeys(query.lower().split()))
    if not found:
        found, entities = [""], entities.limit(0)
    low = {f: F.lower(F.coalesce(F.col(f), F.lit(""))) for f, _, _ in FIELDS}
    whole = F.concat_ws("\n", *low.values())
    rows = entities.where(reduce(Column.__or__, [F.contains(whole, F.lit(t)) for t in found]))
    rows = rows.select("id", "name", "entity_type", *[c.alias(f"_{f}") for f, c in low.items()])
    rows = rows.select("*", *[F.split(f"_{f}", r"[\s,|]+").alias(f"_w_{f}") for f in low])
    # (contains, is a word) of each token in each field
    hit = {(f, t): F.contains(F.col(f"_{f}"), F.lit(t)) for f in low for t in found}
    total = reduce(Column.__add__, [F.when(hit[f, t], part + F.when(F.array_contains(f"_w_{f}", t), more).otherwise(0.0)).otherwise(0.0) for f, part, more in FIELDS for t in found])
    hits = reduce(Column.__add__, [reduce(Column.__or__, [hit[f, t] for f in low]).cast("int") for t in found])
    bonus = F.when((F.lit(len(query.split())) > 1) & (hits > 1), 3.0 * (hits - 1)).otherwise(0.0)
    fields = F.concat_ws(",", *[F.when(reduce(Column.__or__, [hit[f, t] for t in found]), F.lit(f)) for f in low])
    out = rows.select("id", "name", "entity_type", (total + bonus).alias("score"), fields.alias("matched_fields"))
    ordered = out.orderBy(F.desc("score"), F.lower("entity_type"), F.lower("name"), "id")
    return ordered if limit is None else ordered.limit(limit)


def vector_search(entities: DataFrame, query: Column, limit: int = 20, entity_type: str | None = None, most: float = MAX_DISTANCE) -> DataFrame:
    """id, distance of the nearest embedded entities under ``most``."""
    rows = entities.where(V.embedded(F.col("embedding")))
    if entity_type is not None:
        rows = rows.where(F.col("entity_type") == entity_type)
    near = rows.select("id", V.cosine_distance(F.col("embedding"), query).alias("distance"))
    return near.where(F.col("distance") < most).orderBy("distance", "id").limit(limit)


def observation_search(observations: DataFrame, query: Column, limit: int = 50) -> DataFrame:
    """memory_entity_id, distance: least distance of each entity's active embedded observations."""
    rows = observations.where((F.col("status") == "active") & V.embedded(F.col("embedding")))
    near = rows.groupBy("memory_entity_id").agg(F.min(V.cosine_distance(F.col("embedding"), query)).alias("distance"))
    return near.orderBy("distance", "memory_entity_id").limit(limit)


def degree(relations: DataFrame) -> DataFrame:
    """id, degree (in and out)."""
    ends = relations.select(F.col("from_entity_id").alias("id")).unionAll(relations.select(F.col("to_entity_id").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def name_boost(query: str) -> Column:
    q, name = query.lower(), F.lower("name")
    prefix = name.startswith(q) | F.startswith(F.lit(q), name)
    return F.when(name == q, 0.10).when(prefix, 0.04).otherwise(0.0)


def type_weight() -> Column:
    pairs = [F.lit(x) for kv in TYPE_WEIGHTS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("entity_type")), F.lit(1.0))


def structural_boost() -> Column:
    n = F.coalesce(F.col("degree"), F.lit(0))
    return F.when(n > 0, F.log2(1 + n) * 0.003).otherwise(0.0)


def boosted(scored: DataFrame, entities: DataFrame, relations: DataFrame, query: str, scope: DataFrame | None = None, root_id: int | None = None, floor: float | None = None, few: bool = False) -> DataFrame:
    """Apply name, type, structure and context boosts, in that order, to (id, score).

    The scored ids are written once and dealt by their number. Both ends of an edge are
    looked up among them in one pass over the relations; where they are many, ends are
    counted first and then looked up. ``few``: a result list, whose limit bounds it; its
    ids filter entities and relations before anything is joined or made distinct.
    """
    scored = kept(scored)
    many = not few and scored.count() > MANY_IDS
    if few:
        ids = [r.id for r in scored.select("id").collect()]
        entities, relations = entities.where(F.col("id").isin(ids)), relations.where(F.col("from_entity_id").isin(ids) | F.col("to_entity_id").isin(ids))
    ends = relations.select(F.explode(F.array("from_entity_id", "to_entity_id")).alias("id"))
    if many:
        scored = scored.repartition(parts(scored, rows_each=IDS_EACH), "id")
    else:
        ends = ends.join(scored.select("id"), "id", "left_semi")
    counts = ends.groupBy("id").agg(F.count("*").alias("degree"))
    rows = scored.join(entities.select("id", "name", "entity_type"), "id").join(counts, "id", "left")
    base = F.col("score") + name_boost(query)
    if floor is not None:
        base = F.greatest(base, F.lit(floor))
    value = base * type_weight() + structural_boost()
    if scope is not None:
        rows = rows.join(scope.select("id").distinct().withColumn("in_scope", F.lit(True)), "id", "left")
        value = value + F.when(F.col("id") == root_id, 0.04).when(F.col("in_scope"), 0.02).otherwise(0.0)
    return rows.withColumn("score", value)


def fuse(lists: dict[str, DataFrame]) -> DataFrame:
    """Weighted reciprocal rank fusion of lists (id, rank from 0, weight); the sources that found an id are joined by name."""
    parts = [df.select("id", (F.col("weight") / (RRF_K + F.col("rank") + 1)).alias("part"), F.lit(source).alias("source")) for source, df in lists.items()]
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("id").agg(F.sum("part").alias("score"), F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Rank from 0 of a list that is already limited."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(*order)) - 1)


def hybrid_search(entities: DataFrame, observations: DataFrame, relations: DataFrame, query: str, vector: Column | None, entity_vectors: DataFrame | None = None, limit: int = 50, scope: DataFrame | None = None, root_id: int | None = None, restrict: bool = False) -> DataFrame:
    """Text, entity-vector and observation-vector lists of 2 * limit each, fused and boosted; best first."""
    text = text_search(entities, query, limit * 2).select("id", "score", "entity_type", "name")
    text = ranked(text, F.desc("score"), F.lower("entity_type"), F.lower("name"), F.col("id"))
    top = F.max("score").over(W.partitionBy())
    lists = {"text": text.withColumn("weight", 1 + F.col("score") / F.greatest(top, F.lit(1.0))).select("id", "rank", "weight")}
    if vector is not None:
        if entity_vectors is not None:
            lists["vector"] = ranked(vector_search(entity_vectors, vector, limit * 2), F.col("distance"), F.col("id")).withColumn("weight", F.lit(1.0))
        seen = observation_search(observations, vector, limit * 2).withColumnRenamed("memory_entity_id", "id")
        lists["observation"] = ranked(seen, F.col("distance"), F.col("id")).withColumn("weight", F.lit(1.0))
    fused = fuse(lists)
    if restrict and scope is not None:
        fused = fused.join(scope.select("id"), "id", "left_semi")
    out = boosted(fused, entities, relations, query, scope, root_id, few=True)
    return out.select("id", "name", "entity_type", F.round("score", 4).alias("score"), "sources").orderBy(F.desc("score"), "id").limit(limit)


def rank_entity_ids(ids: DataFrame, entities: DataFrame, relations: DataFrame, query: str, scope: DataFrame | None = None, root_id: int | None = None) -> DataFrame:
    """Order ids by the boosts alone, from 0."""
    out = boosted(ids.select("id").withColumn("score", F.lit(0.0)), entities, relations, query, scope, root_id, floor=0.01)
    return out.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id")


def subgraph_candidates(entities: DataFrame, observations: DataFrame, query: str, name: bool = True, kind: bool = True, aliases: bool = True, content: bool = True) -> DataFrame:
    """Ids whose chosen fields, or active observations, hold the whole query (LIKE wildcards in it stay wildcards)."""
    like = f"%{query.lower()}%"
    tests = [F.lower(F.coalesce(F.col(c), F.lit(""))).like(like) for c, on in (("name", name), ("entity_type", kind), ("aliases", aliases)) if on]
    parts = [entities.where(reduce(Column.__or__, tests)).select("id")] if tests else []
    if content:
        parts.append(observations.where((F.col("status") == "active") & F.lower("content").like(like)).select(F.col("memory_entity_id").alias("id")))
    return reduce(DataFrame.unionAll, parts).distinct()


def page(ordered: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    return ordered.orderBy(*order).offset((number - 1) * size).limit(size)


def vector_page(vectors: DataFrame, observations: DataFrame, query: Column, limit: int = 100, most: float = MAX_DISTANCE) -> DataFrame:
    """(id, position): the nearest entities by their own vectors, then those by their observations' that aren't among them."""
    own = ranked(vector_search(vectors, query, limit, most=most), F.col("distance"), F.col("id")).select("id", F.lit(0).alias("list"), "rank")
    seen = observation_search(observations, query, limit).withColumnRenamed("memory_entity_id", "id")
    seen = ranked(seen, F.col("distance"), F.col("id")).select("id", F.lit(1).alias("list"), "rank")
    first = own.unionByName(seen).groupBy("id").agg(F.min(F.struct("list", "rank")).alias("place"))
    return first.select("id", F.row_number().over(W.orderBy("place")).alias("position"))  # 2 x limit rows


def in_scope_first(results: DataFrame, scope: DataFrame, *order: Column) -> DataFrame:
    """(…, in_scope) of an ordered result list: what stands in the scope before the rest."""
    rows = results.join(scope.select("id").distinct().withColumn("in_scope", F.lit(True)), "id", "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))
    return rows.orderBy(F.desc("in_scope"), *order)
