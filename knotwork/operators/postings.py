"""Text search for many queries at once, in which no query meets a common word's entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.operators.blocks import containing
from knotwork.operators.order import dealt_join
from knotwork.operators.search import FIELDS
from knotwork.sources.shared import kept

#: Tokens that more entities hold than this are common.
COMMON = 256


def _points(postings: DataFrame) -> DataFrame:
    """(needle, tie, points, bits) of (needle, tie, low): what a token is worth for an entity and in which fields it stands."""
    there = [F.contains(F.col("low")[k], F.col("needle")) for k in range(len(FIELDS))]
    word = [F.array_contains(F.split(F.col("low")[k], r"[\s,|]+"), F.col("needle")) for k in range(len(FIELDS))]
    points = reduce(Column.__add__, [F.when(t, part + F.when(w, whole).otherwise(0.0)).otherwise(0.0) for (_, part, whole), t, w in zip(FIELDS, there, word, strict=True)])
    bits = reduce(Column.__add__, [F.when(t, 1 << k).otherwise(0) for k, t in enumerate(there)])
    return postings.select("needle", "tie", points.alias("points"), bits.alias("bits"))


def _bonus(hits: Column) -> Column:
    return F.when(hits > 1, 3.0 * (hits - 1)).otherwise(0.0)


def _first(rows: DataFrame, key: str, limit: int, *order: Column | str) -> DataFrame:
    """The first ``limit`` rows of each key; all but those of a task go before the shuffle."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("place") <= limit)


def search_each(queries: DataFrame, entities: DataFrame, limit: int = 10, common: int = COMMON) -> DataFrame:
    """(key, id, entity_type, score, matched, place): the ``limit`` best entities for every (key, query), best first.

    Scores and order are those of ``search.text_search``. Distinct tokens are looked
    up once. A query is scored with the entities of its rare tokens, at most
    ``common`` each. All other entities have points from its common tokens only:
    among them no more than the ``limit`` best for that set of tokens can be in its
    result, as what else an entity may hold adds to its score. Sets are few, and
    are scored with kinds of entities (those that hold the same common tokens in the
    same way), of which ``limit`` members each are known. So rows number rare tokens
    times ``common``, queries times ``limit``, and sets times kinds, and the
    result is exact.
    """
    words = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != "")
    each = kept(queries.select("key", F.explode(F.array_distinct(words)).alias("needle")))
    low = F.array(*[F.lower(F.coalesce(F.col(f), F.lit(""))) for f, _, _ in FIELDS])
    # in order of this: ties go to the lower type, name and id
    tie = F.struct(F.lower("entity_type").alias("t"), F.lower("name").alias("n"), "id", "entity_type")
    texts = entities.select(F.col("id").alias("text_id"), low.alias("low"), tie.alias("tie"))
    met = containing(texts.select("text_id", F.concat_ws("\n", "low").alias("text")), each.select("needle"))
    postings = kept(_points(dealt_join(met, texts, "text_id")))
    frequent = kept(postings.groupBy("needle").agg(F.count("*").alias("_n")).where(F.col("_n") > common).select("needle", F.lit(True).alias("frequent")))
    told = each.join(frequent, "needle", "left")
    sets = kept(told.groupBy("key").agg(F.sort_array(F.collect_list(F.when(F.col("frequent"), F.col("needle")))).alias("common")))
    # what each entity holds of common tokens, in order: equal lists are one kind
    marks = kept(postings.join(frequent, "needle").groupBy("tie").agg(F.sort_array(F.collect_list(F.struct("needle", "points", "bits"))).alias("held")))

    members = kept(_first(marks, "held", limit, "tie").select("held", "tie"))
    kinds = members.groupBy("held").agg(F.min("tie").alias("lead"))
    asked = sets.select("common").where(F.size("common") > 0).distinct().select("common", F.explode("common").alias("needle"))
    parts = asked.join(kinds.select("held", "lead", F.inline("held")), "needle")
    scored = parts.groupBy("common", "held").agg(F.sum("points").alias("points"), F.count("*").alias("hits"), F.bit_or("bits").alias("bits"), F.min("lead").alias("lead"))
    scored = scored.withColumn("score", F.col("points") + _bonus(F.col("hits")))
    # the best entities stand in as many kinds at most, the kinds ordered by their first members
    best = dealt_join(_first(scored, "common", limit, F.desc("score"), "lead").drop("place"), members, "held")
    by_set = _first(best, "common", limit, F.desc("score"), "tie").select("common", "tie", "score", "bits")
    far = sets.where(F.size("common") > 0).join(by_set, "common").select("key", "tie", "score", "bits")

    rare = dealt_join(told.where("frequent IS NULL"), postings.join(frequent, "needle", "left_anti"), "needle").groupBy("key", "tie").agg(F.sum("points").alias("points"), F.count("*").alias("hits"), F.bit_or("bits").alias("bits"))
    more = F.filter(F.coalesce("held", F.expr("array()").cast(marks.schema["held"].dataType)), lambda x: F.array_contains("common", x["needle"]))
    near = dealt_join(dealt_join(rare, sets, "key"), marks, "tie", "left").withColumn("more", more)
    points = F.aggregate("more", F.col("points"), lambda s, x: s + x["points"])
    bits = F.aggregate("more", F.col("bits"), lambda s, x: s.bitwiseOR(x["bits"]))
    near = near.select("key", "tie", (points + _bonus(F.col("hits") + F.size("more"))).alias("score"), bits.alias("bits"))

    # an entity that comes both ways has more points with its rare tokens
    both = near.unionAll(far).groupBy("key", "tie").agg(F.max(F.struct("score", "bits")).alias("s"))
    rows = _first(both.select("key", "tie", "s.score", "s.bits"), "key", limit, F.desc("score"), "tie")
    matched = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(1 << k) != 0, F.lit(f)) for k, (f, _, _) in enumerate(FIELDS)]))
    return rows.select("key", "tie.id", "tie.entity_type", "score", matched.alias("matched"), "place")
