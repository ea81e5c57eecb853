"""Checks of a project against what was scanned, and orphans with their likely parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.functions import text as T
from knotwork.operators.blocks import by_rarest
from knotwork.operators.order import dealt_join
from knotwork.operators.postings import search_each
from knotwork.operators.resolve import orphan_matches
from knotwork.sources.shared import kept


def terms(entities: DataFrame) -> DataFrame:
    """(id, at, term): names and aliases of three characters and more, in lower case, each once, by place."""
    each = F.concat(F.array(F.trim("name")), T.alias_list(F.col("aliases")))
    return entities.select("id", F.posexplode(F.array_distinct(F.transform(each, F.lower))).alias("at", "term")).where(F.length("term") >= 3)


def mentions(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, text_id): which of (term) stand in which of (text_id, text) at word bounds, in any case.

    A term meets only the texts that hold its rarest word; the pattern is tested
    there. Terms without a letter, digit or underscore are not looked for.
    """
    runs = lambda c: F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != "")
    asked = wanted.select(F.col("term").alias("needle")).distinct().select("needle", F.explode(runs(F.col("needle"))).alias("unit"))
    met = dealt_join(by_rarest(texts, runs(F.col("text")), asked).withColumnRenamed("needle", "term"), texts, "text_id")
    return met.where(F.rlike("text", T.phrase_pattern(F.col("term")))).select("term", "text_id")


def mentioned(met: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, n, target) of (term, text_id) and (id, term): how many entities a text mentions, and the lowest id.

    Texts that mention the same terms are one set and entities that share the same
    mentioned terms one kind, so sets meet kinds, not texts entities.
    """
    of_texts = kept(met.groupBy("text_id").agg(F.array_sort(F.collect_set("term")).alias("terms")))
    held = names.join(met.select("term").distinct(), "term", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("held"))
    kinds = kept(held.groupBy("held").agg(F.count("*").alias("n"), F.min("id").alias("target")))
    asked = of_texts.select("terms").distinct().select("terms", F.explode("terms").alias("term"))
    pairs = asked.join(kinds.select("held", "n", "target", F.explode("held").alias("term")), "term").drop("term").distinct()
    counts = pairs.groupBy("terms").agg(F.sum("n").alias("n"), F.min("target").alias("target"))
    return of_texts.join(counts, "terms").select("text_id", "n", "target")


def validated(observations: DataFrame, entities: DataFrame, project_id: int, scanned: Column, ranked: int | None = None) -> DataFrame:
    """(id, action, target_id, n_candidates) of active observations: keep, move, review_move, obsolete or review_delete.

    An observation that mentions its entity or the project is kept. Otherwise, if it
    mentions one other entity only, it moves there (from a scan) or is reviewed; if
    several, it is reviewed; if none, it is obsolete (from a scan) or reviewed for deletion.
    The target is the lowest id. With ``ranked`` only Projects and entities among the first
    so many of a text search for the content are candidates; the target then is no
    Project if any other is there, and has the longest name (or alias) mentioned, the
    higher score, the better place and the lower id.
    """
    rows = kept(observations.where("status = 'active'").where(F.trim("content") != "").select("id", "memory_entity_id", "content", F.sha2("content", 256).alias("text_id"), scanned.alias("scanned")))
    # what a content mentions is looked up once, however many observations hold it
    texts = kept(rows.groupBy("text_id").agg(F.first("content").alias("text")))
    names = kept(terms(entities))
    met = kept(mentions(texts, names.select("term")))
    # pairs of a text and its entity are looked up, so that no text meets all entities of a common term
    pairs = rows.select("text_id", "memory_entity_id").distinct()
    is_own = dealt_join(dealt_join(pairs, met, "text_id"), names.select("term", F.col("id").alias("memory_entity_id")), ["term", "memory_entity_id"], "left_semi").select("text_id", "memory_entity_id")
    project = names.where(F.col("id") == project_id).select("term")
    own = rows.join(is_own.distinct(), ["text_id", "memory_entity_id"], "left_semi").select("id").unionAll(rows.join(met.join(project, "term", "left_semi"), "text_id", "left_semi").select("id")).distinct()
    out = rows.join(own.withColumn("owned", F.lit(True)), "id", "left").withColumn("owned", F.coalesce("owned", F.lit(False)))
    if ranked is None:
        per = mentioned(met, names)
    else:
        out = kept(out)
        # only what mentions others and not its own is searched for
        open_ = out.where("NOT owned").select("text_id").join(met, "text_id", "left_semi").distinct()
        best = search_each(dealt_join(texts, open_, "text_id").select(F.col("text_id").alias("key"), F.col("text").alias("query")), entities, ranked)
        best = best.select(F.col("key").alias("text_id"), "id", "score", "place")
        roots = entities.where("entity_type = 'Project'").select("id")
        of_roots = met.join(open_, "text_id", "left_semi").join(names.join(roots, "id", "left_semi"), "term").select("text_id", "id")
        candidates = best.select("text_id", "id").unionAll(of_roots).distinct().join(roots.withColumn("root", F.lit(True)), "id", "left")
        candidates = dealt_join(candidates, best, ["text_id", "id"], "left")
        found = dealt_join(dealt_join(candidates, names, "id"), met, ["text_id", "term"]).groupBy("text_id", "id").agg(F.length(F.min_by("term", "at")).alias("long"), F.first("root").alias("root"), F.first("score").alias("score"), F.first("place").alias("place"))
        order = F.struct(F.coalesce("root", F.lit(False)), -F.col("long"), -F.coalesce("score", F.lit(0.0)), F.coalesce("place", F.lit(ranked + 1)), "id")
        per = found.groupBy("text_id").agg(F.count("*").alias("n"), F.min_by("id", order).alias("target"))
    out = out.join(per, "text_id", "left").withColumn("n", F.when(F.col("owned"), F.lit(0)).otherwise(F.coalesce("n", F.lit(0))))
    action = F.when(F.col("owned"), "keep").when(F.col("n") > 1, "review_move").when(F.col("n") == 1, F.when(F.col("scanned"), "move").otherwise("review_move")).otherwise(F.when(F.col("scanned"), "obsolete").otherwise("review_delete"))
    return out.select("id", action.alias("action"), F.when(F.col("n") > 0, F.col("target")).alias("target_id"), F.col("n").cast("long").alias("n_candidates"))


# Relation types that tell that one entity uses another.
USAGE_TYPES = "depends_on requires used_by configured_by implements extends integrates_with".split()


def absent_targets(relations: DataFrame, entities: DataFrame, context: DataFrame) -> DataFrame:
    """Ids of usage edges to an entity none of whose names stands in the scan's texts (text_id, text); none if there are no texts.

    Edges to what is no entity are left to other checks. A name is found within one text.
    """
    usage = relations.where(F.col("relation_type").isin(*USAGE_TYPES)).select("id", "to_entity_id")
    targets = entities.join(usage.select(F.col("to_entity_id").alias("id")).distinct(), "id", "left_semi").select("id", "name", "aliases")
    names = terms(targets)
    told = mentions(context, names.select("term")).select("term").distinct()
    absent = targets.select("id").join(names.join(told, "term", "left_semi").select("id"), "id", "left_anti")
    there = context.where(~T.blank(F.col("text"))).limit(1).select(F.lit(True).alias("_there"))
    return usage.join(absent.withColumnRenamed("id", "to_entity_id"), "to_entity_id", "left_semi").join(F.broadcast(there)).select("id")  # one row


def wrong_roots(relations: DataFrame, entities: DataFrame, project_id: int) -> DataFrame:
    """Ids of ``part_of`` edges to a Project other than the scanned one."""
    others = entities.where((F.col("entity_type") == "Project") & (F.col("id") != project_id)).select(F.col("id").alias("to_entity_id"))
    return relations.where("relation_type = 'part_of'").join(others, "to_entity_id", "left_semi").select("id")


def reconciled(subtree: DataFrame, scanned: DataFrame, observations: DataFrame, prior: Column) -> tuple[DataFrame, DataFrame]:
    """(ids of observations from earlier scans that go, ids of entities to delete): what stands below a project but was not met by its scan.

    An entity that was not met loses its earlier scans' active observations, and is
    to be deleted if no other active one is left.
    """
    missing = subtree.select("id").join(scanned.select("id"), "id", "left_anti")
    own = observations.where("status = 'active'").join(missing.select(F.col("id").alias("memory_entity_id")), "memory_entity_id", "left_semi").withColumn("_prior", F.coalesce(prior, F.lit(False)))
    other = own.where(~F.col("_prior")).select(F.col("memory_entity_id").alias("id"))
    return own.where("_prior").select("id"), missing.join(other, "id", "left_anti")


def orphan_report(entities: DataFrame, observations: DataFrame, relations: DataFrame, projects: DataFrame) -> DataFrame:
    """Entities, no Projects, without a ``part_of`` or ``depends_on`` edge of their own: how much hangs on them, and their best parent by shared words."""
    child = relations.where(F.col("relation_type").isin("part_of", "depends_on"))
    orphans = kept(entities.where("entity_type <> 'Project'").join(child.select(F.col("from_entity_id").alias("id")), "id", "left_anti"))
    facts = observations.groupBy(F.col("memory_entity_id").alias("id")).agg(F.count("*").alias("n_observations"))
    below = child.groupBy(F.col("to_entity_id").alias("id")).agg(F.count("*").alias("n_children"))
    matches = orphan_matches(orphans, projects, observations)
    best = matches.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "project_id"))).withColumn("n_matches", F.count("*").over(W.partitionBy("id"))).where("_n = 1")
    zero = F.lit(0).cast("long")
    rows = orphans.select("id", "name", "entity_type").join(facts, "id", "left").join(below, "id", "left").join(best.select("id", "project_id", "score", "n_matches"), "id", "left")
    return rows.select("id", "name", "entity_type", *[F.coalesce(c, zero).alias(c) for c in ("n_observations", "n_children", "n_matches")], "project_id", "score")


def first_headings(text: Column) -> Column:
    """The first heading of one or two marks in a Markdown text."""
    return F.nullif(F.regexp_extract(text, r"(?m)^(?:#|##)\s+(.+)$", 1), F.lit(""))


def extension(path: Column) -> Column:
    """What stands after the last dot of a path's last part, in lower case."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
