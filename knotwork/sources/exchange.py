"""JSON Lines, nested export trees and DOT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.functions.types import ENTITY_TYPES, RELATION_TYPES, canonical
from knotwork.operators.mutate import with_relations
from knotwork.operators.order import numbered
from knotwork.sources.shared import kept
from knotwork.sources.views import Graph

LINES = "type string, name string, entityType string, observations array<string>, `from` string, `to` string, relationType string, _corrupt_record string"


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, observations and relations (by name) of a JSON Lines file; bad and unknown lines are skipped, the first of a name stays."""
    rows = spark.read.schema(LINES).option("mode", "PERMISSIVE").json(path)
    good = rows.where(F.col("_corrupt_record").isNull())
    named = good.where((F.col("type") == "entity") & F.col("name").isNotNull())
    counted = kept(named.groupBy("name").agg(F.min("entityType").alias("entity_type"), F.count("*").alias("_lines")))
    entities = counted.select("name", "entity_type")
    # only names on several lines can repeat a content on another line; all other contents stay where they are
    again = counted.where("_lines > 1").select("name", F.lit(True).alias("_again"))
    each = lambda df: df.select("name", F.explode(F.array_distinct("observations")).alias("content"))
    if again.isEmpty():
        observations = each(named)
    else:
        again = kept(again)
        observations = each(named.join(again, "name", "left_anti")).unionAll(each(named.join(again, "name", "left_semi")).distinct())
    edges = good.where(F.col("type") == "relation").select(F.col("from").alias("from_name"), F.col("to").alias("to_name"), F.col("relationType").alias("relation_type"))
    known = entities.select("name")
    # rows that stand together by their lower end are made distinct there
    relations = edges.join(known.withColumnRenamed("name", "from_name"), "from_name", "left_semi").distinct().join(known.withColumnRenamed("name", "to_name"), "to_name", "left_semi")
    return entities, observations, relations


def appended(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and the new ones whose keys aren't there."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def write_lines(entities: DataFrame, observations: DataFrame, relations: DataFrame, path: str) -> None:
    """Lines of all entities and relations below a folder, compressed by gzip."""
    facts = observations.groupBy(F.col("memory_entity_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "content"))), lambda x: x["content"]).alias("observations"))
    a = entities.join(facts, "id", "left").select(F.to_json(F.struct(F.lit("entity").alias("type"), "name", F.col("entity_type").alias("entityType"), F.coalesce("observations", F.expr("array()").cast("array<string>")).alias("observations"))).alias("value"))
    name = entities.select("id", "name")
    b = relations.join(name.withColumnsRenamed({"id": "from_entity_id", "name": "from"}), "from_entity_id").join(name.withColumnsRenamed({"id": "to_entity_id", "name": "to"}), "to_entity_id").select(F.to_json(F.struct(F.lit("relation").alias("type"), "from", "to", F.col("relation_type").alias("relationType"))).alias("value"))
    a.unionAll(b).write.mode("overwrite").option("compression", "gzip").text(path)


def document_lines(tree: DataFrame, entities: DataFrame, observations: DataFrame, relations: DataFrame) -> DataFrame:
    """(position, line): an export document of ordered rows (``graph.ordered_tree``); the lines, in order, are its JSON text.

    Each node is one line: what closes the nodes before it follows from its depth and
    the next one's, so no line waits for another and no tree is held anywhere. Position
    0 opens the document; the last line closes it.
    """
    facts = observations.groupBy(F.col("memory_entity_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "content"))), lambda x: F.struct(x["content"].alias("content"))).alias("observations"))
    info = entities.select("id", "name", "entity_type", *(["aliases"] if "aliases" in entities.columns else []))
    kind = relations.select(F.col("id").alias("relation_id"), "relation_type").dropDuplicates(["relation_id"])
    follows = tree.select((F.col("position") - 1).alias("position"), F.col("depth").alias("next"))
    rows = tree.join(info, "id").join(facts, "id", "left").join(kind, "relation_id", "left").join(follows, "position", "left")
    own = F.struct("name", "entity_type", *(["aliases"] if "aliases" in entities.columns else []), F.coalesce("observations", F.array().cast("array<struct<content:string>>")).alias("observations"), "relation_type", F.when(F.col("direction") == "incoming", "child_to_parent").when(F.col("direction") == "outgoing", "parent_to_child").alias("relation_direction"))
    text = F.to_json(own)
    opened = F.concat(F.expr("substring(j, 1, length(j) - 1)"), F.lit(',"children":['))
    closers = F.when(F.col("next").isNull(), F.concat(F.repeat(F.lit("]}"), F.col("depth") + 1), F.lit("]}"))).when(F.col("next") > F.col("depth"), "").otherwise(F.concat(F.repeat(F.lit("]}"), F.col("depth") - F.col("next") + 1), F.lit(",")))
    lines = rows.withColumn("j", text).select("position", F.concat(opened, closers).alias("line"))
    head = tree.sparkSession.range(1).select(F.lit(0).cast("long").alias("position"), F.lit('{"root_nodes":[').alias("line"))
    return head.unionByName(lines)


def upserted(g: Graph, lines: DataFrame, first_id: int) -> Graph:
    """Add what a table of lines (position, value: JSON text) has and the graph lacks.

    - An entity is known by name and canonical type; of a name's lines with several types
      the first one's counts, unless the graph has the name, whose type then counts;
      lines of other types, without a name or a type are left out.
    - A new entity gets all observations of its first line, and those of later lines that
      it hasn't by then; one that was there those it hasn't, of any state; each once.
    - A relation is added where both names are known afterwards, it isn't there, joins two
      entities and, as ``part_of``, is the lower one's first parent; of several new parents
      the first line's stays.
    - Blank contents and lines that are no JSON or of another kind are left out.

    New rows get ids from ``first_id`` in the order of lines.
    """
    rows = kept(lines.select("position", F.from_json("value", LINES.replace(", _corrupt_record string", "")).alias("r")).select("position", "r.*"))
    named = rows.where((F.col("type") == "entity") & ~T.blank(F.col("name")) & F.col("entityType").isNotNull()).select("position", "name", canonical(F.col("entityType"), ENTITY_TYPES).alias("entity_type"), "observations")
    old = g.entities.groupBy("name").agg(F.min_by(F.struct("id", "entity_type"), "id").alias("o")).select("name", F.col("o.id").alias("_old"), F.col("o.entity_type").alias("_kind"))
    first = named.groupBy("name").agg(F.min_by(F.struct("position", "entity_type"), "position").alias("f"))
    known = first.join(old, "name", "left").select("name", "_old", F.coalesce("_kind", "f.entity_type").alias("entity_type"), F.col("f.position").alias("_first"))
    made = numbered(known.where("_old IS NULL").select("name", "entity_type", "_first"), F.asc("_first")).select("name", "entity_type", "_first", (F.col("position") + first_id - 1).alias("id"))
    made = kept(made)
    ids = known.where("_old IS NOT NULL").select("name", "entity_type", F.col("_old").alias("id"), F.lit(None).cast("long").alias("_first")).unionByName(made.select("name", "entity_type", "id", F.col("_first").cast("long").alias("_first")))
    each = kept(named.join(ids, ["name", "entity_type"]).select("position", F.col("id").alias("memory_entity_id"), (F.col("position") == F.col("_first")).alias("_new"), F.posexplode("observations").alias("at", "content")).where(~T.blank(F.col("content"))))
    whole = each.where("_new").select("memory_entity_id", "content", "position", "at")  # as it stands, repeats included
    later = each.where("_new IS NULL OR NOT _new").groupBy("memory_entity_id", "content").agg(F.min(F.struct("position", "at")).alias("p")).select("memory_entity_id", "content", "p.position", "p.at")
    there = g.observations.select("memory_entity_id", "content").unionAll(whole.select("memory_entity_id", "content"))
    facts = whole.unionByName(later.join(there, ["memory_entity_id", "content"], "left_anti")).withColumnRenamed("position", "line")
    facts = numbered(facts, F.asc("line"), F.asc("at")).select((F.col("position") + first_id - 1).alias("id"), "memory_entity_id", "content", F.lit("active").alias("status"))
    entities = g.entities.unionByName(made.select("id", "name", "entity_type"), allowMissingColumns=True)
    name = entities.groupBy("name").agg(F.min("id").alias("id"))
    edges = rows.where(F.col("type") == "relation").select("position", F.col("from").alias("_f"), F.col("to").alias("_t"), canonical(F.col("relationType"), RELATION_TYPES).alias("relation_type")).where("relation_type IS NOT NULL")
    edges = edges.join(name.withColumnsRenamed({"name": "_f", "id": "from_entity_id"}), "_f").join(name.withColumnsRenamed({"name": "_t", "id": "to_entity_id"}), "_t")
    edges = edges.groupBy("from_entity_id", "to_entity_id", "relation_type").agg((F.min("position") + first_id - 1).alias("id"))
    relations = with_relations(Graph(entities, g.observations, g.relations), _all_columns(edges, g.relations)).relations
    return Graph(entities, g.observations.unionByName(facts, allowMissingColumns=True), relations)


def _all_columns(rows: DataFrame, like: DataFrame) -> DataFrame:
    return like.limit(0).unionByName(rows, allowMissingColumns=True)


def flatten_documents(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, node_path, parent_path, depth, name, entity_type, aliases, observations, relation_type, parent_to_child) of many export documents (doc_id, text).

    Texts are parsed to variants and opened level by level on the executors, so neither
    the number of documents nor the size of one meets the driver; a level's subtrees are
    written once for each level above them. A text that is no JSON, has no ``root_nodes`` or
    is nested more than a thousand times gives no rows; observations are strings or hold
    their ``content``.
    """
    get = lambda v, path, kind: F.try_variant_get(v, f"$.{path}", kind)
    v = F.col("v")
    roots = get(F.try_parse_json("text"), "root_nodes", "array<variant>")
    now = documents.select("doc_id", F.posexplode(roots).alias("at", "v")).select("doc_id", F.col("at").cast("string").alias("node_path"), F.lit(None).cast("string").alias("parent_path"), F.lit(0).alias("depth"), "v")
    content = lambda o: F.coalesce(F.try_variant_get(o, "$.content", "string"), F.try_variant_get(o, "$", "string"))
    fields = ["doc_id", "node_path", "parent_path", "depth", *[get(v, f, "string").alias(f) for f in ("name", "entity_type", "aliases")]]
    fields += [F.coalesce(F.transform(get(v, "observations", "array<variant>"), content), F.array().cast("array<string>")).alias("observations"), get(v, "relation_type", "string").alias("relation_type"), F.coalesce(get(v, "relation_direction", "string") == "parent_to_child", F.lit(False)).alias("parent_to_child")]
    out = None
    while True:
        now = kept(now)
        rows = now.select(*fields)
        out = rows if out is None else out.unionByName(rows)
        below = now.select("doc_id", F.col("node_path").alias("parent_path"), (F.col("depth") + 1).alias("depth"), F.posexplode(get(v, "children", "array<variant>")).alias("at", "v"))
        now = below.select("doc_id", F.concat_ws(".children.", "parent_path", F.col("at").cast("string")).alias("node_path"), "parent_path", "depth", "v")
        if now.isEmpty():
            return out


def flatten_tree(spark: SparkSession, text: str) -> DataFrame:
    """The rows of one export document."""
    return flatten_documents(spark.createDataFrame([(0, text)], "doc_id long, text string")).drop("doc_id", "parent_to_child")


def dot_lines(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Lines (part, key, line) of a DOT graph: a node a line with its cluster, then an edge a line."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '"', "'"), F.lit('"'))
    nodes = entities.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.concat(F.lit("  subgraph cluster_"), F.coalesce("entity_type", F.lit("none")), F.lit(" { n"), F.col("id").cast("string"), F.lit(" [label="), quoted(F.col("name")), F.lit("]; }")).alias("line"))
    edges = relations.select(F.lit(2).alias("part"), F.col("id").alias("key"), F.concat(F.lit("  n"), F.col("from_entity_id").cast("string"), F.lit(" -> n"), F.col("to_entity_id").cast("string"), F.lit(" [label="), quoted(F.col("relation_type")), F.lit("];")).alias("line"))
    return nodes.unionAll(edges)


def read_files(spark: SparkSession, path: str, pattern: str = "*", most_each: int = 50_000, most_all: int = 200_000, most_files: int = 50) -> DataFrame:
    """Text files within a size budget; files with a NUL in their first 4 kB are binary and are skipped."""
    from knotwork.operators.scan import within_budget

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    text = files.where(~F.contains(F.substring("content", 1, 4096), F.lit(b"\x00")))
    return within_budget(text, "path", "length", most_each, most_all, most_files).select("path", "length", F.decode("content", "UTF-8").alias("content"))


def newest_kept(snapshots: DataFrame, keep: int = 10) -> DataFrame:
    """Which snapshots (path, created_at) stay when all but the newest are pruned."""
    newest = snapshots.orderBy(F.desc("created_at"), "path").limit(keep).select("path", F.lit(True).alias("_kept"))
    return snapshots.join(F.broadcast(newest), "path", "left").withColumn("keep", F.coalesce("_kept", F.lit(False))).drop("_kept")
