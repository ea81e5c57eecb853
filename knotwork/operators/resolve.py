"""Entity resolution: merge suggestions, contradictions, relation proposals, orphan matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.functions import text as T
from knotwork.functions import vectors as V
from knotwork.operators import blocks
from knotwork.operators.blocks import containing, nearest_pairs, opposed_pairs, shared_words
from knotwork.operators.order import dealt_join, parts
from knotwork.sources.shared import kept

#: Proposals that one task sorts.
PROPOSALS_EACH = 500_000
#: Projects that hold one word and are scored in one task; words that more orphans hold are looked up apart.
DEAL = 16_384
#: Projects that one task scores, about.
SCORED_EACH = 1_000_000


def close_pairs(rows: DataFrame, most: float, each: int, same_type: bool = True) -> DataFrame:
    """(a, b, distance) with a < b: the ``each`` nearest later entities of each, of its type, under ``most``."""
    key = F.col("entity_type") if same_type else F.lit("")
    base = rows.where(V.embedded(F.col("embedding"))).select(key.alias("key"), "id", F.col("embedding").alias("v"))
    return nearest_pairs(base, most, each).drop("key")


def suggest_merges(rows: DataFrame, threshold: float = 0.3, limit: int | None = 20, suppressed: DataFrame | None = None, high: float = 0.15, same_type: bool = True) -> DataFrame:
    """Up to three nearest later entities of each, then suppression (rows of a, b), then the limit in (a, distance, b) order."""
    near = close_pairs(rows, threshold, 3, same_type)
    if suppressed is not None:
        near = near.join(suppressed.select("a", "b"), ["a", "b"], "left_anti")
    out = near.withColumn("high_confidence", F.col("distance") < high)
    return out if limit is None else out.orderBy("a", "distance", "b").limit(limit)


def similar_before_creation(new: DataFrame, entities: DataFrame, most: float = 0.25) -> DataFrame:
    """(id, similar_id, distance): the nearest embedded entity of its type for each new one that lies under ``most``; such a one should not be created. Ids of both are distinct."""
    rows = lambda df, asked: df.where(V.embedded(F.col("embedding"))).select(F.col("entity_type").alias("key"), "id", F.col("embedding").alias("v"), F.lit(asked).alias("asked"))
    near = nearest_pairs(rows(new, True).unionByName(rows(entities, False)), most, 1, later_only=False)
    return near.select(F.col("a").alias("id"), F.col("b").alias("similar_id"), "distance")


def merge_evidence(rows: DataFrame, observations: DataFrame, relations: DataFrame, threshold: float = 0.30, limit: int = 3, close: float = 0.10) -> DataFrame:
    """Scored merge candidates with a survivor and a decision (merge or review)."""
    near = close_pairs(rows.where(F.col("entity_type") != "Project"), threshold, 9)
    info = rows.select("id", F.lower("name").alias("name"), F.transform(T.alias_list(F.col("aliases")), F.lower).alias("aliases"))
    a = info.withColumnsRenamed({"id": "a", "name": "name_a", "aliases": "aliases_a"})
    b = info.withColumnsRenamed({"id": "b", "name": "name_b", "aliases": "aliases_b"})
    facts = observations.where("status = 'active'").select("memory_entity_id", F.md5("content").alias("h")).distinct()
    shared = near.join(facts.withColumnsRenamed({"memory_entity_id": "a"}), "a").join(facts.withColumnsRenamed({"memory_entity_id": "b"}), ["b", "h"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    scored = near.join(a, "a").join(b, "b").join(shared, ["a", "b"], "left")
    alias_hit = F.array_contains("aliases_a", F.col("name_b")) | F.array_contains("aliases_b", F.col("name_a")) | F.arrays_overlap("aliases_a", "aliases_b")
    score = F.when(F.col("distance") < close, 8).otherwise(4) + F.when(F.col("name_a") == F.col("name_b"), 8).when(alias_hit, 5).otherwise(0) + F.least(2 * F.coalesce("shared", F.lit(0)), F.lit(6))
    best = scored.withColumn("score", score.cast("int")).where("score >= 4").withColumn("_n", F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "distance", "b"))).where(F.col("_n") <= limit)
    weight = observations.groupBy(F.col("memory_entity_id").alias("id")).agg((F.count("*") * 10).alias("w")).unionAll(
        relations.select(F.col("from_entity_id").alias("id")).unionAll(relations.select(F.col("to_entity_id").alias("id"))).groupBy("id").agg(F.count("*").alias("w"))
    ).groupBy("id").agg(F.sum("w").alias("w"))
    wa, wb = weight.withColumnsRenamed({"id": "a", "w": "wa"}), weight.withColumnsRenamed({"id": "b", "w": "wb"})
    out = best.join(wa, "a", "left").join(wb, "b", "left")
    survivor = F.when(F.coalesce("wa", F.lit(0)) > F.coalesce("wb", F.lit(0)), F.col("a")).otherwise(F.col("b"))  # a tie leaves the later one
    return out.select("a", "b", "distance", "score", survivor.alias("survivor"), F.when((F.col("distance") < close) & (F.col("score") >= 10), "merge").otherwise("review").alias("decision"))


def contradictions(observations: DataFrame, relations: DataFrame, ids: DataFrame | None = None, most: float = 0.35, limit: int = 20) -> DataFrame:
    """(entity_id, observation_id_1, observation_id_2, distance, confidence) for each entity of ``ids``, or for all.

    Active embedded observations of the entity and its neighbours, close to each
    other but of opposite polarity. Each observation meets its ``limit`` nearest
    first; polarity is tested after that; each entity keeps its ``limit`` best pairs.
    Observations bring their content, or its polarity as ``negative``. Entities with the
    same neighbours that hold observations have the same pairs, so one of them is searched.
    """
    neg = F.col("negative") if "negative" in observations.columns else T.negative(F.col("content"))
    rows = kept(observations.where((F.col("status") == "active") & V.embedded(F.col("embedding"))).select("memory_entity_id", "id", F.col("embedding").alias("v"), F.size("embedding").alias("dim"), neg.alias("neg")))
    holders = kept(rows.select("memory_entity_id").distinct())  # only edges to them matter
    a, b = F.col("from_entity_id"), F.col("to_entity_id")
    ends = F.array(F.struct(a.alias("key"), b.alias("memory_entity_id")), F.struct(b.alias("key"), a.alias("memory_entity_id")))
    near = relations.select(F.inline(ends)).join(holders, "memory_entity_id", "left_semi").select("key", "memory_entity_id")
    near = near.unionAll(holders.select(F.col("memory_entity_id").alias("key"), "memory_entity_id"))
    if ids is not None:
        near = near.join(ids.select(F.col("id").alias("key")).distinct(), "key", "left_semi")
    near = kept(near.distinct())
    m = F.col("memory_entity_id")
    told = kept(near.groupBy("key").agg(F.struct(F.count("*"), F.min(m), F.max(m), F.bit_xor(F.xxhash64(m)), F.bit_xor(F.xxhash64(m, F.lit(7)))).alias("_set")))
    kinds = kept(told.join(told.groupBy("_set").agg(F.min("key").alias("lead")), "_set").select("key", "lead"))
    sizes = rows.groupBy("memory_entity_id", "dim").agg(F.count("*").alias("rows"))
    sized = kept(near.join(kinds.where("key = lead").select("key"), "key", "left_semi").join(sizes, "memory_entity_id"))
    asking = sized.groupBy("key", "dim").agg(F.ceil(F.sum("rows") / blocks.ASK_BLOCK).cast("int").alias("n"))
    asked = sized.join(asking, ["key", "dim"]).select("key", "memory_entity_id", "dim", "n")
    pairs = opposed_pairs(asked.join(rows, ["memory_entity_id", "dim"]), most, limit, limit)
    scored = pairs.withColumn("confidence", F.round(F.least((1 - F.col("distance")) * 1.1, F.lit(0.99)), 4))
    best = F.row_number().over(W.partitionBy("key").orderBy(F.desc("confidence"), "a", "b"))
    first = scored.withColumn("_n", best).where(F.col("_n") <= limit).withColumnRenamed("key", "lead")
    return kinds.join(first, "lead").select(F.col("key").alias("entity_id"), F.col("a").alias("observation_id_1"), F.col("b").alias("observation_id_2"), F.round("distance", 6).alias("distance"), "confidence")


def _orphan_words(orphans: DataFrame, projects: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, t) of orphans, the projects' names and aliases in lower case and as words, and (t, project_id): which of them hold a word."""
    first = observations.where("status = 'active'").withColumn("_n", F.row_number().over(W.partitionBy("memory_entity_id").orderBy("id"))).where("_n <= 5")
    facts = first.groupBy(F.col("memory_entity_id").alias("id")).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("id", "content"))), lambda x: x["content"])).alias("facts"))
    words = T.tokens(F.concat_ws(" ", "name", "entity_type", "description", "facts"))
    own = kept(dealt_join(orphans, facts, "id", "left").select("id", F.explode(words).alias("t")))
    known = projects.select(F.col("id").alias("project_id"), F.lower("name").alias("pn"), T.tokens(F.col("name")).alias("pt"), F.lower(F.coalesce("aliases", F.lit(""))).alias("pa"), T.tokens(F.col("aliases")).alias("at"))
    needles = own.select(F.col("t").alias("needle")).distinct()
    texts = known.select(F.col("project_id").alias("text_id"), F.concat_ws("\n", "pn", "pa").alias("text"))
    return own, known, containing(texts, needles).select(F.col("needle").alias("t"), F.col("text_id").alias("project_id"))


def _worth(t: Column) -> Column:
    """Points of a word in a project's name or aliases."""
    return F.when(F.array_contains("pt", t), 10).when(F.col("pn").contains(t), 5).when(F.array_contains("at", t), 8).when(F.col("pa").contains(t), 3).otherwise(0).cast("long")


def orphan_matches(orphans: DataFrame, projects: DataFrame, observations: DataFrame, current: int | None = None) -> DataFrame:
    """(id, project_id, score): points of an orphan's words in a project's name or aliases.

    The words are those of its name, type, description and first five active
    observations. Each distinct word is looked up among the projects once. There is a
    row for every project that holds any word; ``best_matches`` has the best ones only.
    """
    own, known, met = _orphan_words(orphans, projects, observations)
    worth = dealt_join(met, known, "project_id").select("t", "project_id", _worth(F.col("t")).alias("points")).where("points > 0")
    scored = dealt_join(own, worth, "t").groupBy("id", "project_id").agg(F.sum("points").alias("score"))
    if current is not None:
        bonus = orphans.select("id", F.lit(current).cast("long").alias("project_id"), F.lit(2).cast("long").alias("score"))
        scored = scored.unionByName(bonus).groupBy("id", "project_id").agg(F.sum("score").alias("score"))
    return scored


def best_matches(orphans: DataFrame, projects: DataFrame, observations: DataFrame, each: int = 2) -> DataFrame:
    """The ``each`` best rows of ``orphan_matches`` for each orphan, by score, then project; exact.

    An orphan's words are put in order, the most common among projects first. A
    project of its result is among the ``each`` best of those that hold the last word
    they share, scored with the words up to that one: what stands before it makes a
    node, which orphans share, and a node meets the projects of its last word only. So
    no orphan meets all projects that hold a common word of it. Of projects that share
    name and aliases only the first ``each`` can be in a result.
    """
    alike = W.partitionBy(F.lower("name"), F.lower(F.coalesce("aliases", F.lit("")))).orderBy("id")
    projects = kept(projects.select("id", "name", "aliases", F.row_number().over(alike).alias("_n")).where(F.col("_n") <= each).drop("_n"))
    own, known, met = _orphan_words(orphans, projects, observations)
    # words that don't count, as they stand across name and aliases, are left out
    worth = kept(dealt_join(met, known, "project_id").where(_worth(F.col("t")) > 0).select("t", "project_id", "pn", "pt", "pa", "at"))
    counts = kept(worth.groupBy("t").agg(F.count("*").alias("n")))
    # words of very many orphans or projects are few, and go to every task
    hot = kept(own.groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") > DEAL).select("t"))
    deals = kept(counts.where(F.col("n") > DEAL).select("t", F.ceil(F.col("n") / DEAL).cast("int").alias("deals")))
    often = own.join(F.broadcast(hot), "t", "left_semi").join(F.broadcast(counts.join(F.broadcast(hot), "t", "left_semi")), "t")
    told = often.unionByName(dealt_join(own.join(F.broadcast(hot), "t", "left_anti"), counts, "t"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "t"))), lambda x: x["t"])
    sets_of = kept(told.groupBy("id").agg(ordered.alias("ts")))
    sets = kept(sets_of.select("ts").distinct().withColumn("set", F.monotonically_increasing_id()))
    prefixes = sets.select("set", F.explode(F.transform(F.sequence(F.lit(1), F.size("ts")), lambda k: F.slice("ts", F.lit(1), k))).alias("head"))
    nodes = kept(prefixes.select("head").distinct().withColumn("node", F.monotonically_increasing_id()))
    # the projects of a common word are dealt over tasks
    of = lambda df: df.join(F.broadcast(deals), "t", "left").withColumn("deals", F.coalesce("deals", F.lit(1)))
    asked = of(nodes.withColumn("t", F.element_at("head", -1))).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
    there = of(worth).withColumn("deal", F.pmod(F.xxhash64("project_id"), "deals").cast("int")).drop("deals")
    score = F.aggregate("head", F.lit(0).cast("long"), lambda s, t: s + _worth(t)).alias("score")
    top = lambda df, key: df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "project_id"))).where(F.col("_n") <= each).drop("_n")
    met_by = nodes.groupBy(F.element_at("head", -1).alias("t")).agg(F.count("*").alias("heads"))
    scored = dealt_join(met_by, counts, "t").agg(F.sum(F.col("heads") * F.col("n")).alias("n")).first().n or 0
    n = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-scored // SCORED_EACH))
    best = top(dealt_join(asked.repartition(n, "t", "deal"), there.repartition(n, "t", "deal"), ["t", "deal"]).select("node", "project_id", score), "node")
    one = dealt_join(dealt_join(prefixes, nodes, "head").select("set", "node"), best, "node").groupBy("set", "project_id").agg(F.max("score").alias("score"))
    return dealt_join(dealt_join(sets_of, sets, "ts"), top(one, "set"), "set").select("id", "project_id", "score")


def auto_parents(matches: DataFrame, least: int = 10, margin: int = 3) -> DataFrame:
    """Best match of each orphan and whether it is clear enough to apply."""
    w = W.partitionBy("id").orderBy(F.desc("score"), "project_id")
    rows = matches.withColumn("_n", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("_n = 1")
    return rows.select("id", "project_id", "score", ((F.col("score") >= least) & (F.col("next").isNull() | (F.col("score") - F.col("next") >= margin))).alias("auto"))


def shared_observation_links(observations: DataFrame, entities: DataFrame, least: int = 15, each: int = 3) -> DataFrame:
    """(from_id, to_id): for each entity, no Project, the ``each`` next entities by id that share an active content with it.

    All such links score alike, so these are the ones an entity's proposals can
    keep. Within a content an entity links to its next ones only: a content that n
    entities hold gives ``each`` x n rows, not all pairs.
    """
    facts = observations.where((F.col("status") == "active") & (F.length("content") >= least)).select(F.col("memory_entity_id").alias("id"), F.sha2("content", 256).alias("h")).distinct()
    facts = facts.join(entities.where("entity_type <> 'Project'").select("id"), "id", "left_semi")
    w = W.partitionBy("h").orderBy("id")
    later = facts.select(F.col("id").alias("from_id"), F.array(*[F.lead("id", k).over(w) for k in range(1, each + 1)]).alias("later"))
    links = later.select("from_id", F.explode("later").alias("to_id")).where("to_id IS NOT NULL").distinct()
    return links.withColumn("_n", F.row_number().over(W.partitionBy("from_id").orderBy("to_id"))).where(F.col("_n") <= each).drop("_n")


def issue_solution_links(issues: DataFrame, solutions: DataFrame, least: int = 2, each: int = 3) -> DataFrame:
    """(solution_id, issue_id, score, high): the ``each`` issues that share most words with each solution. Both: (id, content)."""
    mine = lambda df, test: df.where(T.mentions_any(F.col("content"), test)).select("id", T.tokens(F.col("content")).alias("words"))
    best = shared_words(mine(solutions, T.SOLUTION), mine(issues, T.ISSUE), least, each)
    score = F.col("shared") * 3 + 5
    return best.select(F.col("left_id").alias("solution_id"), F.col("right_id").alias("issue_id"), score.alias("score"), (score >= 14).alias("high"))


def dependency_links(observations: DataFrame, entities: DataFrame, least: int = 3) -> DataFrame:
    """(from_id, to_id): observations with a dependency word that mention another entity's name or one of its aliases."""
    rows = observations.where((F.col("status") == "active") & T.mentions_any(F.col("content"), T.DEPENDENCY)).select(F.col("memory_entity_id").alias("from_id"), F.lower("content").alias("text"))
    each = F.array_distinct(F.concat(T.alias_list(F.col("name")), T.alias_list(F.col("aliases"))))
    names = entities.where(F.col("entity_type") != "Project").select(F.col("id").alias("to_id"), F.explode(each).alias("n")).select("to_id", F.lower("n").alias("needle")).where(F.length("needle") >= least)
    # a text is looked up once, however many observations hold it
    facts = kept(rows.select(F.sha2("text", 256).alias("text_id"), "from_id", "text").distinct())
    texts = kept(facts.groupBy("text_id").agg(F.first("text").alias("text")))
    met = kept(containing(texts, names.select("needle")))
    # entities with the same mentioned names are one kind: sets meet kinds, and no link is made twice
    held = kept(names.join(met.select("needle").distinct(), "needle", "left_semi").groupBy("to_id").agg(F.array_sort(F.collect_set("needle")).alias("kind")))
    kinds = held.select("kind").distinct().select("kind", F.explode("kind").alias("needle"))
    asked = kept(kinds.join(met, "needle").join(facts.select("text_id", "from_id"), "text_id").select("from_id", "kind").distinct())
    return asked.join(held, "kind").where("from_id <> to_id").select("from_id", "to_id")


def top_proposals(proposals: DataFrame, relations: DataFrame, suppressed: DataFrame | None = None, limit: int = 3) -> DataFrame:
    """Proposals (from_id, to_id, relation_type, score) without self-links, existing relations and suppressed ones, one a pair and type, best three an entity.

    Proposals are dealt by their number. They and what is suppressed are written before they are joined, as
    Spark else leaves a type that is one constant out of the keys and deals anew by bytes.
    """
    keys = ["from_id", "to_id", "relation_type"]
    n = parts(proposals, rows_each=PROPOSALS_EACH)
    there = relations.select(F.col("from_entity_id").alias("from_id"), F.col("to_entity_id").alias("to_id"), "relation_type")
    one = kept(proposals.where("from_id <> to_id").repartition(n, "from_id", "to_id").groupBy(*keys).agg(F.max("score").alias("score")))
    fresh = one.repartition(n, *keys).join(there.repartition(n, *keys), keys, "left_anti")
    if suppressed is not None:
        fresh = fresh.join(kept(suppressed.select(*keys)).repartition(n, *keys), keys, "left_anti")
    w = W.partitionBy("from_id").orderBy(F.desc("score"), "to_id", "relation_type")
    one = fresh.select(*keys, "score").repartition(n, "from_id")
    return one.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def diverse_evidence(rows: DataFrame, *order: Column, each: int = 3, all_: int = 20) -> DataFrame:
    """Rows (memory_entity_id, ...) in an order without ties: at most ``each`` an entity, ``all_`` in all."""
    w = W.partitionBy("memory_entity_id").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each).drop("_n").orderBy(*order).limit(all_)


def fresh_contents(incoming: DataFrame, observations: DataFrame) -> DataFrame:
    """Incoming (memory_entity_id, content) that no active observation holds."""
    there = observations.where("status = 'active'").select("memory_entity_id", "content")
    return incoming.join(there, ["memory_entity_id", "content"], "left_anti")
