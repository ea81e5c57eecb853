"""Filtered, sorted, paged scans of the core tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SORTABLE = {"id", "name", "entity_type", "created_at", "updated_at"}


def paged(df: DataFrame, page: int = 1, per_page: int = 20, sort_by: str = "id", direction: str = "asc", sortable: set[str] = SORTABLE) -> DataFrame:
    """A page by a whitelisted column (else id ascending), id breaking ties."""
    per_page = max(1, min(per_page, 100))
    by = sort_by if sort_by in sortable else "id"
    order = F.desc(by) if direction == "desc" and sort_by in sortable else F.asc(by)
    return df.orderBy(order, "id").offset((max(1, page) - 1) * per_page).limit(per_page)


def page_totals(df: DataFrame, per_page: int = 20) -> DataFrame:
    n = F.count("*")
    return df.agg(n.alias("total"), F.greatest(F.ceil(n / per_page), F.lit(1)).cast("long").alias("total_pages"))


def contains(column: str, text: str) -> Column:
    return F.lower(F.coalesce(F.col(column), F.lit(""))).contains(text.lower())


def between(df: DataFrame, column: str, since: str | None, until: str | None) -> DataFrame:
    """Rows of a span of time, both ends included."""
    if since is not None:
        df = df.where(F.col(column) >= F.lit(since).cast("timestamp"))
    return df if until is None else df.where(F.col(column) <= F.lit(until).cast("timestamp"))


def entity_scan(entities: DataFrame, entity_type: str | list[str] | None = None, name: str | None = None, aliases: str | None = None, ids: list[int] | None = None, since: str | None = None, until: str | None = None, min_observations: int | None = None, any_of: list[dict] | None = None, updated_since: str | None = None, updated_until: str | None = None) -> DataFrame:
    """Filters and-ed; ``any_of``: every field of every object or-ed, and an empty list matches nothing."""
    out = entities
    if entity_type is not None:
        out = out.where(F.col("entity_type").isin([entity_type] if isinstance(entity_type, str) else entity_type))
    for column, value in (("name", name), ("aliases", aliases)):
        if value is not None:
            out = out.where(contains(column, value))
    if ids is not None:
        out = out.where(F.col("id").isin(ids))
    out = between(between(out, "created_at", since, until), "updated_at", updated_since, updated_until)
    if min_observations is not None:
        out = out.where(F.col("memory_observations_count") >= min_observations)
    if any_of is not None:
        tests = []
        for item in any_of:
            for k, v in item.items():
                if k in ("entity_type", "id"):
                    tests.append(F.col(k) == v)
                elif k in ("name", "aliases"):
                    tests.append(contains(k, v))
        out = out.where(reduce(Column.__or__, tests) if tests else F.lit(False))
    return out


def observation_scan(observations: DataFrame, entity_id: int | None = None, content: str | None = None, since: str | None = None, include_obsolete: bool = False, until: str | None = None, page: int | None = None, per_page: int = 20) -> DataFrame:
    """Observations by filters; with ``page`` one page of them by id."""
    out = observations
    if entity_id is not None:
        out = out.where(F.col("memory_entity_id") == entity_id)
    if content is not None:
        out = out.where(contains("content", content))
    out = between(out, "created_at", since, until)
    out = out if include_obsolete else out.where(F.col("status") == "active")
    return out if page is None else paged(out, page, per_page)


def relation_scan(relations: DataFrame, entities: DataFrame, from_id: int | None = None, to_id: int | None = None, relation_type: str | None = None, since: str | None = None, until: str | None = None, page: int | None = None, per_page: int = 20) -> DataFrame:
    """Relations with their ends' names; with ``page`` one page of them by id, cut before names are joined."""
    from knotwork.operators.graph import find_relations

    rows = between(find_relations(relations, from_id, to_id, relation_type), "created_at", since, until)
    if page is not None:
        rows = paged(rows, page, per_page)
    name = entities.select("id", "name")
    a = name.withColumnsRenamed({"id": "from_entity_id", "name": "from_name"})
    b = name.withColumnsRenamed({"id": "to_entity_id", "name": "to_name"})
    return rows.join(a, "from_entity_id", "left").join(b, "to_entity_id", "left")


def audit_scan(audit: DataFrame, now: str, days: int | None = 7, action: str | None = None, kind: str | None = None, actor: int | None = None) -> DataFrame:
    """Newest first."""
    out = audit
    if days is not None:
        out = out.where(F.col("created_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))
    for column, value in (("action", action), ("auditable_type", kind), ("actor", actor)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.orderBy(F.desc("created_at"), F.desc("id"))


def audit_expired(audit: DataFrame, now: str, days: int = 90) -> DataFrame:
    return audit.where(F.col("created_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))


def resolve_names(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, id); a null id is a name that isn't there."""
    return names.join(entities.select("name", "id"), "name", "left")


def picker(entities: DataFrame, text: str, limit: int = 20) -> DataFrame:
    return entities.where(contains("name", text) | contains("aliases", text)).orderBy("name", "id").limit(limit)


def within_budget(files: DataFrame, order: str, size: str, most_each: int, most_all: int, most_files: int) -> DataFrame:
    """The first ``most_files`` files in order, as long as their sizes add up within a budget."""
    rows = files.where(F.col(size) <= most_each).orderBy(order).limit(most_files)
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)  # ``most_files`` rows
    return rows.withColumn("total", F.sum(size).over(w)).where(F.col("total") <= most_all)


def in_order(df: DataFrame, ids: list[int]) -> DataFrame:
    """Rows in the order of a given id list."""
    place = df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(ids)], "id long, position int")
    return df.join(F.broadcast(place), "id").orderBy("position")


def violations(observations: DataFrame) -> DataFrame:
    """(id, rule) for each broken constraint of an observation."""
    active, over = F.col("status") == "active", F.col("status") == "superseded"
    rules = {
        "content_blank": F.col("content").isNull() | (F.trim("content") == ""),
        "confidence_range": (F.col("confidence") < 0) | (F.col("confidence") > 1),
        "validity_order": F.col("valid_until") < F.col("valid_from"),
        "status_unknown": ~F.col("status").isin("active", "obsolete", "superseded"),
        "active_obsoleted": active & F.col("obsoleted_at").isNotNull(),
        "superseded_without_reference": over & F.col("superseded_by_id").isNull(),
        "self_reference": F.col("superseded_by_id") == F.col("id"),
    }
    return _told(observations, rules)


def relation_violations(relations: DataFrame) -> DataFrame:
    """(id, rule) for each broken constraint of a relation; ``properties`` is JSON text, and rules of columns that aren't there don't apply."""
    has = lambda c: c in relations.columns
    rules = {"type_blank": F.col("relation_type").isNull() | (F.trim("relation_type") == ""), "self_reference": F.col("from_entity_id") == F.col("to_entity_id")}
    if has("weight"):
        rules["weight_negative"] = F.col("weight") < 0
    if has("confidence"):
        rules["confidence_range"] = (F.col("confidence") < 0) | (F.col("confidence") > 1)
    if has("properties"):
        rules["properties_no_object"] = ~_kind_of("properties").startswith("OBJECT")
    return _told(relations, rules)


def tag_violations(observations: DataFrame) -> DataFrame:
    """(id, rule) of observations whose ``tags`` (JSON text) are no array of strings; nulls aren't either."""
    return _told(observations, {"tags_no_strings": ~_kind_of("tags").isin("ARRAY<STRING>", "ARRAY<VOID>") | _holds_null("tags")})


def _kind_of(c: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)), F.lit("VOID"))


def _holds_null(c: str) -> Column:
    """A null in an array doesn't change the array's type."""
    values = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    return F.coalesce(F.exists(values, lambda v: v.isNull() | F.is_variant_null(v)), F.lit(False))


def _told(df: DataFrame, rules: dict) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))
    return df.select("id", F.explode(found).alias("rule"))
