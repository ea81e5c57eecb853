"""Graph traversal as frontier joins.

A walk writes the edges it may take once to the shared folder. A level joins the
frontier with them, keeps what wasn't seen (anti join) and brings nothing to the
driver but counts. Levels are written, too, so the lineage of a deep walk stays
short. Walks without a depth of their own end when nothing new is reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.order import numbered, parts, summed_before
from knotwork.sources.shared import kept

MAX_DEPTH, MAX_NODES, MAX_SCOPE = 5, 1000, 1000
#: Edges that one task sorts; paths for each such task that go to the edges as Spark sees fit.
EDGES_EACH, FEW_PATHS = 500_000, 1000


def directed(relations: DataFrame, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """relation_id, a, b: edges as they are walked from a to b."""
    rows = relations if types is None else relations.where(F.col("relation_type").isin(types))
    out = rows.select(F.col("id").alias("relation_id"), F.col("from_entity_id").alias("a"), F.col("to_entity_id").alias("b"))
    back = rows.select(F.col("id").alias("relation_id"), F.col("to_entity_id").alias("a"), F.col("from_entity_id").alias("b"))
    return {"outgoing": out, "incoming": back, "both": out.unionAll(back)}[direction]


def expand(relations: DataFrame, start: DataFrame, depth: int = 2, direction: str = "both", types: list[str] | None = None, cap: int | None = 100) -> DataFrame:
    """(id, depth, position) of what is reached from ``start`` (ids), first seen first.

    A node's place in its level is that of its lowest edge id, and the cap cuts
    a level there. ``cap=None`` walks without a bound.
    """
    depth = min(depth, MAX_DEPTH) if cap is not None else depth
    edges = directed(kept(relations.select("id", "from_entity_id", "to_entity_id", "relation_type")), direction, types)
    seen = start.select("id").distinct().withColumn("depth", F.lit(0)).withColumn("first_edge", F.lit(-1).cast("long"))
    frontier = seen.select("id")
    count = seen.count() if cap is not None else 0
    for level in range(1, depth + 1):
        met = edges.join(frontier.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("relation_id").alias("first_edge"))
        new = met.join(seen.select("id"), "id", "left_anti")
        if cap is not None:
            new = new.orderBy("first_edge", "id").limit(max(0, min(cap, MAX_NODES) - count))
        new = kept(new.select("id", F.lit(level).alias("depth"), "first_edge"))
        n = new.count()
        if not n:
            break
        count += n
        seen = seen.unionAll(new)
        frontier = new.select("id")
    return seen


def truncated(relations: DataFrame, reached: DataFrame, depth: int, direction: str = "both", types: list[str] | None = None) -> bool:
    """Whether a node one edge beyond an expanded level was left out."""
    inner = reached.where(F.col("depth") < depth).select(F.col("id").alias("a"))
    return not directed(relations, direction, types).join(inner, "a", "left_semi").join(reached.select(F.col("id").alias("b")), "b", "left_anti").isEmpty()


def scanned_relations(relations: DataFrame, reached: DataFrame, depth: int, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """Edge ids walked from expanded levels whose far end was reached."""
    inner = reached.where(F.col("depth") < depth).select(F.col("id").alias("a"))
    walked = directed(relations, direction, types).join(inner, "a", "left_semi").join(reached.select(F.col("id").alias("b")), "b", "left_semi")
    return walked.select("relation_id").distinct()


def shortest_path(relations: DataFrame, source: int, target: int, depth: int = MAX_DEPTH, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """(position, id, relation_id) of the path on which each node was first reached by its lowest edge; empty if there is none."""
    spark = relations.sparkSession
    edges = kept(directed(relations, direction, types))
    levels = [spark.createDataFrame([(source, None, None)], "id long, parent long, relation_id long")]
    seen = levels[0].select("id")
    found = source == target
    while not found and len(levels) <= min(depth, MAX_DEPTH):
        met = edges.join(levels[-1].select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min(F.struct("relation_id", "a")).alias("m"))
        new = kept(met.join(seen, "id", "left_anti").select("id", F.col("m.a").alias("parent"), F.col("m.relation_id").alias("relation_id")))
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.unionAll(new.select("id"))
        found = not new.where(F.col("id") == target).isEmpty()
    if not found:
        return spark.createDataFrame([], "position int, id long, relation_id long")
    path, at = [], target
    for k in range(len(levels) - 1, -1, -1):  # one row a level, at most MAX_DEPTH
        row = levels[k].where(F.col("id") == at).first()
        path.append((k, row.id, row.relation_id))
        at = row.parent
    return spark.createDataFrame(path, "position int, id long, relation_id long").orderBy("position")


def project_subtree(relations: DataFrame, root: DataFrame, cap: int | None = MAX_SCOPE) -> DataFrame:
    """(id, depth) below ``root`` down ``part_of``, the root included, however deep; children come by id and the cap cuts there."""
    seen = root.select("id").distinct().withColumn("depth", F.lit(0))
    frontier, count, level = seen.select("id"), seen.count() if cap is not None else 0, 0
    tree = kept(relations.where(F.col("relation_type") == "part_of").select(F.col("to_entity_id").alias("parent"), F.col("from_entity_id").alias("id")))
    while True:
        level += 1
        new = tree.join(frontier.withColumnRenamed("id", "parent"), "parent").select("id").distinct().join(seen.select("id"), "id", "left_anti")
        if cap is not None:
            new = new.orderBy("id").limit(max(0, cap - count))
        new = kept(new.withColumn("depth", F.lit(level)))
        n = new.count()
        if not n:
            return seen
        count += n
        seen, frontier = seen.unionAll(new), new.select("id")
        if level % 16 == 0:  # a deep tree's union of levels stays short
            seen = kept(seen)


def scope(relations: DataFrame, root: DataFrame, cap: int = MAX_SCOPE) -> DataFrame:
    """(id, depth, truncated): a bounded subtree, and whether the bound left a child of it out."""
    rows = kept(project_subtree(relations, root, cap))
    up = relations.where(F.col("relation_type") == "part_of").select(F.col("to_entity_id").alias("parent"), F.col("from_entity_id").alias("id"))
    more = not up.join(rows.select(F.col("id").alias("parent")), "parent", "left_semi").join(rows.select("id"), "id", "left_anti").isEmpty()
    return rows.withColumn("truncated", F.lit(more))


def first_parents(relations: DataFrame) -> DataFrame:
    """(id, parent): the parent with the lowest id."""
    return relations.where(F.col("relation_type") == "part_of").groupBy(F.col("from_entity_id").alias("id")).agg(F.min("to_entity_id").alias("parent"))


def ancestor_projects(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, project_id) of each entity that reaches a Project by first parents; a Project is its own.

    Steps double: a round joins where each node has got to with where that node has
    got to, so a chain of n parents takes about log2(n) rounds. Loops never end at
    a Project; the number of rounds that the longest chain could take ends them.
    """
    projects = entities.where(F.col("entity_type") == "Project").select("id")
    up = first_parents(relations).join(projects, "id", "left_anti").join(entities.select("id"), "id", "left_semi")
    own = projects.withColumnRenamed("id", "at").withColumn("done", F.lit(True))
    now = kept(up.withColumnRenamed("parent", "at").where(F.col("id") != F.col("at")).join(own, "at", "left").select("id", "at", F.coalesce("done", F.lit(False)).alias("done")))
    for _ in range(now.count().bit_length() + 1):
        left = now.where(~F.col("done"))
        if left.isEmpty():
            break
        step = now.select(F.col("id").alias("at"), F.col("at").alias("then"), F.col("done").alias("arrived"))
        now = kept(now.where("done").unionAll(left.select("id", "at").join(step, "at").select("id", "then", "arrived")))
    return projects.select("id", F.col("id").alias("project_id")).unionAll(now.where("done").select("id", F.col("at").alias("project_id")))


def descendants(relations: DataFrame, roots: DataFrame) -> DataFrame:
    return project_subtree(relations, roots, cap=None).where(F.col("depth") > 0)


def would_cycle(relations: DataFrame, child: int, parent: int) -> bool:
    """Whether ``child part_of parent`` would close a loop: the parent is the child or below it."""
    spark = relations.sparkSession
    below = project_subtree(relations, spark.createDataFrame([(child,)], "id long"), cap=None)
    return not below.where(F.col("id") == parent).isEmpty()


def on_loops(relations: DataFrame, edges: DataFrame) -> DataFrame:
    """Of ``part_of`` edges (from_entity_id, to_entity_id, …) that stand among the relations, those from whose upper end parents lead back to the lower one.

    All edges are followed up at once, a level a round; a node is visited once for each edge.
    """
    up = kept(relations.where(F.col("relation_type") == "part_of").select(F.col("from_entity_id").alias("at"), F.col("to_entity_id").alias("then")).distinct())
    now = kept(edges.select(F.col("from_entity_id").alias("low"), F.col("to_entity_id").alias("high")).distinct().withColumn("at", F.col("high")))
    seen, level = now, 0
    while True:
        level += 1
        new = kept(now.where(F.col("at") != F.col("low")).join(up, "at").select("low", "high", F.col("then").alias("at")).distinct().join(seen, ["low", "high", "at"], "left_anti"))
        if new.isEmpty():
            break
        seen, now = seen.unionByName(new), new
        if level % 16 == 0:
            seen = kept(seen)
    hit = seen.where(F.col("at") == F.col("low")).select(F.col("low").alias("from_entity_id"), F.col("high").alias("to_entity_id")).distinct()
    return edges.join(hit, ["from_entity_id", "to_entity_id"], "left_semi")


def induced_edges(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids``."""
    own = ids.select("id").distinct()
    return relations.join(own.withColumnRenamed("id", "from_entity_id"), "from_entity_id", "left_semi").join(own.withColumnRenamed("id", "to_entity_id"), "to_entity_id", "left_semi")


def ego_network(relations: DataFrame, entity_id: int) -> DataFrame:
    """Ids within one edge of an entity, itself included."""
    near = relations.where(F.col("from_entity_id") == entity_id).select(F.col("to_entity_id").alias("id")).unionAll(relations.where(F.col("to_entity_id") == entity_id).select(F.col("from_entity_id").alias("id")))
    return near.unionAll(relations.sparkSession.range(1).select(F.lit(entity_id).cast("long").alias("id"))).distinct()


def hierarchy_orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities other than Projects without a parent."""
    child = relations.where(F.col("relation_type") == "part_of").select(F.col("from_entity_id").alias("id"))
    others = entities.where(F.col("entity_type") != "Project")
    n = parts(others, child)
    return others.repartition(n, "id").join(child.repartition(n, "id"), "id", "left_anti")


def isolated(entities: DataFrame, observations: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities with no observation of any status and no edge."""
    used = relations.select(F.col("from_entity_id").alias("id")).unionAll(relations.select(F.col("to_entity_id").alias("id"))).unionAll(observations.select(F.col("memory_entity_id").alias("id")))
    return entities.join(used, "id", "left_anti")


def find_relations(relations: DataFrame, from_id: int | None = None, to_id: int | None = None, relation_type: str | None = None) -> DataFrame:
    from knotwork.functions.types import RELATION_TYPES, canonical_one

    out = relations
    if from_id is not None:
        out = out.where(F.col("from_entity_id") == from_id)
    if to_id is not None:
        out = out.where(F.col("to_entity_id") == to_id)
    if relation_type is not None:
        out = out.where(F.col("relation_type") == canonical_one(relation_type, RELATION_TYPES))
    return out


def export_paths(entities: DataFrame, relations: DataFrame, roots: DataFrame, depth: int = 4) -> DataFrame:
    """(root, path, id, depth, relation_type, direction): the export tree as rows.

    Children come by ``part_of`` and ``depends_on`` backwards, then by other edges
    forwards; a path never meets a node twice; a nested Project is a leaf. Edges and paths
    are dealt by their number.
    """
    down = relations.where(F.col("relation_type").isin("part_of", "depends_on")).select(F.col("to_entity_id").alias("a"), F.col("from_entity_id").alias("b"), "relation_type", F.lit("incoming").alias("direction"), F.col("id").alias("_edge"))
    side = relations.where(~F.col("relation_type").isin("part_of", "depends_on")).select(F.col("from_entity_id").alias("a"), F.col("to_entity_id").alias("b"), "relation_type", F.lit("outgoing").alias("direction"), F.col("id").alias("_edge"))
    both = kept(down.unionAll(side))
    kind = entities.select(F.col("id").alias("b"), (F.col("entity_type") == "Project").alias("leaf"))
    n = parts(both, rows_each=EDGES_EACH)
    edges = both.repartition(n, "b").groupBy("a", "b", "direction").agg(F.min_by("relation_type", "_edge").alias("relation_type"))
    edges = kept(edges.join(kind.repartition(n, "b"), "b"))
    now = roots.select(F.col("id").alias("root"), F.array("id").alias("path"), "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("relation_type"), F.lit(None).cast("string").alias("direction"))
    out, open_paths = now, now
    for level in range(1, depth + 1):
        far = open_paths.select("root", "path", F.col("id").alias("a"))
        step = far.join(edges, "a") if far.count() < n * FEW_PATHS else far.repartition(n, "a").join(edges.repartition(n, "a"), "a")
        step = step.where(~F.array_contains("path", F.col("b")))
        step = kept(step.select("root", F.concat("path", F.array("b")).alias("path"), F.col("b").alias("id"), F.lit(level).alias("depth"), "relation_type", "direction", "leaf"))
        out = out.unionByName(step.drop("leaf"))
        open_paths = step.where(~F.col("leaf")).drop("leaf")
        if open_paths.isEmpty():
            break
    return out


def ordered_tree(entities: DataFrame, relations: DataFrame, roots: DataFrame, depth: int = 4) -> DataFrame:
    """(position, key, id, depth, relation_id, direction): export trees in document order, from 1.

    Children come in the order of their edges: ``part_of`` and ``depends_on`` backwards,
    then other edges forwards; two edges to one child give it twice. A path never meets a
    node twice, and a nested Project is a leaf. Roots come by id, each once.

    Subtree sizes are added from the deepest level up; a node's place is its parent's
    plus the sizes of what stands between, which is a difference of two sums over the
    level in (parent, edge) order. So a parent of any number of children is spread over
    range partitions, and each level costs some shuffles of that level only.
    """
    up = F.col("relation_type").isin("part_of", "depends_on")
    edge = F.struct(F.when(up, 0).otherwise(1).alias("group"), F.col("id").alias("relation_id"))
    edges = kept(relations.select(F.when(up, F.col("to_entity_id")).otherwise(F.col("from_entity_id")).alias("a"), F.when(up, F.col("from_entity_id")).otherwise(F.col("to_entity_id")).alias("b"), edge.alias("edge"), F.when(up, "incoming").otherwise("outgoing").alias("direction")))
    kind = entities.select(F.col("id").alias("b"), (F.col("entity_type") == "Project").alias("leaf"))
    none = F.lit(None)
    first = roots.select("id").distinct().join(entities.select("id"), "id", "left_semi")
    levels = [kept(first.select(F.col("id").cast("string").alias("key"), none.cast("string").alias("parent"), F.struct(F.lit(0).alias("group"), F.col("id").alias("relation_id")).alias("edge"), "id", F.array("id").alias("path"), none.cast("string").alias("direction"), F.lit(False).alias("leaf")))]
    for _ in range(depth):
        step = levels[-1].where(~F.col("leaf")).select(F.col("key").alias("parent"), "path", F.col("id").alias("a")).join(edges, "a").where(~F.array_contains("path", F.col("b"))).join(kind, "b")
        step = kept(step.select(F.concat_ws("/", "parent", F.col("edge.relation_id").cast("string")).alias("key"), "parent", "edge", F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"), "direction", "leaf"))
        if step.isEmpty():
            break
        levels.append(step)
    sized, below = [], None
    for level in reversed(levels):
        size = level if below is None else level.join(below.groupBy(F.col("parent").alias("key")).agg(F.sum("size").alias("below")), "key", "left")
        below = kept(size.withColumn("size", F.lit(1).cast("long") if below is None else 1 + F.coalesce("below", F.lit(0))).select("key", "parent", "edge", "id", "direction", "size"))
        sized.insert(0, below)
    out, above = None, None
    for k, level in enumerate(sized):
        before = summed_before(level, F.col("size"), F.asc("parent"), F.asc("edge"))
        if above is not None:
            own = before.groupBy("parent").agg(F.min("before").alias("_first"))
            before = before.join(own, "parent").join(above, "parent").withColumn("before", F.col("_above") + 1 + F.col("before") - F.col("_first"))
        placed = kept(before.select((F.col("before") + 1).alias("position"), "key", "id", F.lit(k).alias("depth"), F.when(F.lit(k > 0), F.col("edge.relation_id")).alias("relation_id"), "direction"))
        above = placed.select(F.col("key").alias("parent"), (F.col("position") - 1).alias("_above"))
        out = placed if out is None else out.unionByName(placed)
    return out


def nested_paths(relations: DataFrame, roots: DataFrame, depth: int = 3, cap: int | None = MAX_NODES) -> DataFrame:
    """(root, path, id, relation_id, direction, depth): a nested view of what is around each root, both ways.

    Only edges between nodes that a walk of ``depth`` (1 to 3) reaches take part; a
    branch never meets a node twice.
    """
    depth = max(1, min(depth, 3))
    near = kept(expand(relations, roots, depth, cap=cap).select("id"))
    inside = induced_edges(relations, near).select("id", "from_entity_id", "to_entity_id")
    out = inside.select(F.col("from_entity_id").alias("a"), F.col("to_entity_id").alias("b"), F.col("id").alias("relation_id"), F.lit("outgoing").alias("direction"))
    edges = kept(out.unionByName(inside.select(F.col("to_entity_id").alias("a"), F.col("from_entity_id").alias("b"), F.col("id").alias("relation_id"), F.lit("incoming").alias("direction"))))
    now = roots.select(F.col("id").alias("root"), F.array("id").alias("path"), "id", F.lit(None).cast("long").alias("relation_id"), F.lit(None).cast("string").alias("direction"), F.lit(0).alias("depth"))
    rows = now
    for level in range(1, depth + 1):
        step = now.select("root", "path", F.col("id").alias("a")).join(edges, "a").where(~F.array_contains("path", F.col("b")))
        now = kept(step.select("root", F.concat("path", F.array("b")).alias("path"), F.col("b").alias("id"), "relation_id", "direction", F.lit(level).alias("depth")))
        rows = rows.unionByName(now)
    return rows


def walk_order(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, part, depth, position): breadth first from Projects, ids in order within a level, then what no Project reaches (part 1)."""
    tree = project_subtree(relations, entities.where(F.col("entity_type") == "Project"), cap=None)
    rest = entities.where(F.col("entity_type") != "Project").join(tree, "id", "left_anti")
    both = tree.select("id", F.lit(0).alias("part"), "depth").unionAll(rest.select("id", F.lit(1).alias("part"), F.lit(0).alias("depth")))
    return numbered(both, F.asc("part"), F.asc("depth"), F.asc("id"))


def root_nodes(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, name, part, position): Projects by name (also nested ones), then other parentless nodes by name."""
    others = hierarchy_orphans(entities, relations)
    both = entities.where(F.col("entity_type") == "Project").select("id", "name", F.lit(0).alias("part")).unionAll(others.select("id", "name", F.lit(1).alias("part")))
    return numbered(both, F.asc("part"), F.asc("name"), F.asc("id"))
