"""Readings of answers: what is derived from subgraphs after a question was answered, for any number of roots at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curralis.operators.closure import bfs, partonomy, reversed_edges
from curralis.operators.components import longest_path_steps
from curralis.plans.lineage import counted, settled
from curralis.schema import CLASSES, LEVELS, Graph

#: Order in which a node's connections are listed.
CONNECTION_ORDER = ("PART_OF", "HAS_PREREQUISITE", "SPECIALIZES", "TEACHES_CONCEPT", "REQUIRES_CONCEPT", "IS_ABOUT", "HAS_RESOURCE_TYPE")
CLUSTER, FAR_NODES = 14, 10
#: Wholes that a chain names at most; concepts that a tree shows, and units without parts that it names; fixed values.
MAX_CHAIN, TREE_CONCEPTS, BARE_UNITS = 7, 24, 4


def documents_of_edges(graph: Graph) -> DataFrame:
    """(type, source, target, document): an edge's provenance, or else the first resource its source derives from."""
    derived = graph.links("WAS_DERIVED_FROM").groupBy("source").agg(F.min("target").alias("first"))
    return graph.edges.filter("type <> 'WAS_DERIVED_FROM'").join(derived, "source", "left").select("type", "source", "target", F.coalesce("provenance", "first").alias("document"))


def connections(graph: Graph) -> DataFrame:
    """(key, type, direction, other, name, place): each node's connections in the fixed order of types, by Spanish collation of names."""
    edges = graph.edges.filter("type <> 'WAS_DERIVED_FROM'")
    both = edges.select(F.col("source").alias("key"), "type", F.lit("out").alias("direction"), F.col("target").alias("other")).unionByName(edges.select(F.col("target").alias("key"), "type", F.lit("in").alias("direction"), F.col("source").alias("other")))
    place = F.create_map(*[F.lit(x) for n, t in enumerate(CONNECTION_ORDER) for x in (t, n)])
    named = both.join(graph.nodes.select(F.col("key").alias("other"), F.col("name_es").alias("name")), "other")
    order = F.row_number().over(Window.partitionBy("key").orderBy(place[F.col("type")], F.desc("direction"), F.expr("name COLLATE es"), "other"))
    return named.select("key", "type", "direction", "other", "name", order.alias("place"))


def location_chains(graph: Graph, starts: DataFrame | None = None) -> DataFrame:
    """(root, chain): every chain of wholes from the outermost one down to the element's own parent, joined by ' > '; cut at MAX_CHAIN wholes, so that a cycle ends."""
    part_of = graph.links("PART_OF").select("source", "target")
    level = part_of.select(F.col("source").alias("root"), F.col("target").alias("top"), F.array("target").alias("chain"))
    if starts is not None:
        level = level.join(starts.select("root"), "root", "left_semi")
    out = None
    for wholes in range(1, MAX_CHAIN + 1):
        ends = level if wholes == MAX_CHAIN else level.join(part_of.select(F.col("source").alias("top")), "top", "left_anti")
        out = ends.select("root", "chain") if out is None else out.unionByName(ends.select("root", "chain"))
        if wholes < MAX_CHAIN:
            level = level.join(part_of, level.top == part_of.source).select("root", F.col("target").alias("top"), F.concat(F.array("target"), "chain").alias("chain"))
    return out.select("root", F.array_join("chain", " > ").alias("chain"))


def learning_order(graph: Graph, starts: DataFrame) -> DataFrame:
    """(root, key, step): contained concepts in layers, each after all of its prerequisites inside the root; 1 for those without one."""
    concepts = graph.of("Concept").select(F.col("key").alias("node"))
    inside = partonomy(starts.select("root", F.col("root").alias("node")), reversed_edges(graph.links("PART_OF"))).filter("depth > 0").join(concepts, "node", "left_semi").select("root", "node")
    needs = graph.links("HAS_PREREQUISITE").select("source", "target")
    edges = inside.join(needs, inside.node == needs.source).select("root", "source", "target").join(inside.select("root", F.col("node").alias("target")), ["root", "target"], "left_semi")
    steps = longest_path_steps(inside.select(F.col("root").alias("group"), "node"), edges.select(F.col("root").alias("group"), "source", "target"))
    return steps.select(F.col("group").alias("root"), F.col("node").alias("key"), "step")


def prerequisites_by_depth(graph: Graph, found: DataFrame) -> DataFrame:
    """(root, key, depth, via): prerequisites (root, key, depth) with the node one step nearer that needs them; the root itself is preferred."""
    needs = graph.links("HAS_PREREQUISITE").select("source", "target")
    rows = found.filter("depth > 0").join(needs, F.col("key") == F.col("target")).select("root", "key", "depth", "source")
    nearer = found.select("root", F.col("key").alias("source"), F.col("depth").alias("from"))
    rows = rows.join(nearer, ["root", "source"]).filter("from = depth - 1")
    return rows.groupBy("root", "key", "depth").agg(F.min(F.struct((F.col("source") != F.col("root")).alias("far"), "source"))["source"].alias("via"))


def resources_of(graph: Graph, resources: DataFrame) -> DataFrame:
    """(root, key, kind, parts): resources of an answer (root, key, role) with their type and the shown elements that they are about."""
    shown = resources.filter(F.col("role").isin("element", "covered")).select("root", F.col("key").alias("target"))
    about = resources.filter("role = 'resource'").join(graph.links("IS_ABOUT").select("source", "target"), F.col("key") == F.col("source")).select("root", "key", "target")
    parts = about.join(shown, ["root", "target"], "left_semi").groupBy("root", "key").agg(F.array_sort(F.collect_set("target")).alias("parts"))
    kinds = graph.links("HAS_RESOURCE_TYPE").groupBy(F.col("source").alias("key")).agg(F.min("target").alias("kind"))
    return parts.join(kinds, "key", "left").select("root", "key", "kind", "parts")


def path_stops(graph: Graph, path: DataFrame, label: str) -> DataFrame:
    """(root, key, depth, place): what of a learning path (root, key, depth) is of the grain's class, farthest first."""
    stops = path.filter("depth > 0").join(graph.of(label).select("key", "name_es"), "key")
    place = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("depth"), F.col("name_es").asc_nulls_last(), "key"))
    return stops.select("root", "key", "depth", place.alias("place"))


def contains_target(graph: Graph, stops: DataFrame) -> DataFrame:
    """stops (root, key) with contains: whether the stop is a whole of the root."""
    up = partonomy(stops.select("root", F.col("root").alias("node")).distinct(), graph.links("PART_OF")).filter("depth > 0").select("root", F.col("node").alias("key"), F.lit(True).alias("contains"))
    return stops.join(up, ["root", "key"], "left").withColumn("contains", F.coalesce("contains", F.lit(False)))


#: Nodes with more neighbours than HUB are hubs, of which the MAX_HUBS largest are told apart; any choice gives the same answers.
HUB, MAX_HUBS = 100, 64


def _over_hubs(both: DataFrame, hubs: DataFrame, last: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (root, stop) with bound: steps of the shortest chain through some hub (key), null without one. Hubs are few, so that this is linear in the graph."""
    reach = settled(bfs(hubs.select(F.col("key").alias("root"), F.col("key").alias("node")), both, 1 << 30).withColumnRenamed("root", "hub"))
    steps = lambda rows, by, name: rows.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("hub", "depth"))).alias(name))
    there = steps(reach.join(wanted.select(F.col("root").alias("node")).distinct(), "node", "left_semi").withColumnRenamed("node", "root"), "root", "there")
    ends = reach.join(last.hint("merge"), "node").groupBy("stop", "hub").agg((F.min("depth") + 1).alias("depth"))
    rows = wanted.join(there.hint("merge"), "root", "left").join(steps(ends, "stop", "onward").hint("merge"), "stop", "left")
    return rows.select("root", "stop", F.array_min(F.transform(F.map_keys("there"), lambda h: F.col("there")[h] + F.col("onward")[h])).alias("bound"))


def justification(graph: Graph, stops: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, stop, hops): steps of the shortest chain over PART_OF, TEACHES_CONCEPT and HAS_PREREQUISITE, in either direction, from root to stop, the last one a prerequisite.

    Without max_depth a root is followed until all its stops are justified or nothing new is reached. A chain goes through some hub, a
    node of many neighbours, or through none: the former are got from the steps between each hub and each node, so that no root is followed
    into a hub's neighbours; the latter step by step, as long as they can be shorter.
    """
    edges = graph.links("PART_OF", "TEACHES_CONCEPT", "HAS_PREREQUISITE").select("source", "target")
    both = settled(edges.union(reversed_edges(edges).select("source", "target")).distinct())
    last = settled(graph.links("HAS_PREREQUISITE").select(F.col("source").alias("node"), F.col("target").alias("stop")).distinct())
    wanted = settled(stops.select("root", F.col("key").alias("stop")).distinct())
    hubs, n = counted(both.groupBy(F.col("source").alias("key")).count().filter(F.col("count") > HUB).orderBy(F.desc("count"), "key").limit(MAX_HUBS).select("key"))
    wanted = settled(_over_hubs(both, hubs, last, wanted)) if n else wanted.withColumn("bound", F.lit(None).cast("int"))
    free = lambda rows, *ends: reduce(lambda r, c: r.join(F.broadcast(hubs.select(F.col("key").alias(c))), c, "left_anti"), ends, rows).select(*rows.columns)
    both, last = (settled(free(both, "source", "target")), settled(free(last, "node"))) if n else (both, last)
    level = settled(free(wanted.select("root", F.col("root").alias("node")).distinct(), "node"))
    seen, out, depth = level, None, 0
    while True:
        depth += 1
        found = level.join(last, "node").select("root", "stop").distinct().join(wanted, ["root", "stop"], "left_semi").select("root", "stop", F.lit(depth).alias("hops"))
        over = wanted.filter(F.col("bound") <= depth).select("root", "stop", F.col("bound").alias("hops"))
        hops = settled(found.unionByName(over).groupBy("root", "stop").agg(F.min("hops").alias("hops")))
        out = hops if out is None else out.unionByName(hops)
        if depth == max_depth:
            return out
        wanted, left = counted(wanted.join(hops, ["root", "stop"], "left_anti"))
        # a root with nothing left that could be reached sooner without a hub isn't followed
        open_ = wanted.filter(F.coalesce(F.col("bound") > depth + 1, F.lit(True))).select("root").distinct()
        ahead = level.join(open_, "root", "left_semi").join(both, F.col("node") == both.source).select("root", F.col("target").alias("node")).distinct()
        level, more = counted(ahead.join(seen, ["root", "node"], "left_anti"))
        if not left or not more:
            return out.unionByName(wanted.filter("bound IS NOT NULL").select("root", "stop", F.col("bound").alias("hops"))) if max_depth is None else out.unionByName(wanted.filter(F.col("bound") <= max_depth).select("root", "stop", F.col("bound").alias("hops")))
        seen = seen.unionByName(level)


def previous_courses(graph: Graph, starts: DataFrame | None = None) -> DataFrame:
    """(root, course, evidence): courses that teach what the root requires, with those concepts."""
    requires, teaches = graph.links("REQUIRES_CONCEPT"), graph.links("TEACHES_CONCEPT")
    rows = requires.select(F.col("source").alias("root"), F.col("target").alias("concept")).join(teaches.select(F.col("source").alias("course"), F.col("target").alias("concept")), "concept").filter("course <> root")
    if starts is not None:
        rows = rows.join(starts.select("root"), "root", "left_semi")
    return rows.groupBy("root", "course").agg(F.array_join(F.array_sort(F.collect_set("concept")), ",").alias("evidence"))


def count_by_class(graph: Graph, found: DataFrame) -> DataFrame:
    """(root, label, n) of found nodes (root, key)."""
    return found.select("root", "key").distinct().join(graph.nodes.select("key", "label"), "key").groupBy("root", "label").agg(F.count("*").alias("n"))


def concepts_under(graph: Graph) -> DataFrame:
    """(key, label, children, concepts): number of direct parts and of concepts beneath each element; zeros kept."""
    part_of = graph.links("PART_OF")
    children = part_of.groupBy(F.col("target").alias("key")).agg(F.count_distinct("source").alias("children"))
    seeds = graph.of("Concept").select(F.col("key").alias("root"), F.col("key").alias("node"))
    above = partonomy(seeds, part_of).filter("depth > 0").groupBy(F.col("node").alias("key")).agg(F.count_distinct("root").alias("concepts"))
    rows = graph.of("KnowledgeArea", "KnowledgeUnit", "Topic").select("key", "label").join(children, "key", "left").join(above, "key", "left")
    return rows.select("key", "label", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("concepts", F.lit(0)).alias("concepts"))


def tree_counts(graph: Graph) -> DataFrame:
    """(key, units, topics, concepts, with_concepts, bare, summarized) of each area, unit and topic drawn as a tree.

    with_concepts: there are some, and few enough to be shown. bare: an area's units without parts, and topics straight in it without
    any; above BARE_UNITS they are told by their number (summarized) instead of by name.
    """
    part_of = graph.links("PART_OF").select("source", "target").distinct()
    seeds = graph.of("KnowledgeArea", "KnowledgeUnit", "Topic").select(F.col("key").alias("root"), F.col("key").alias("node"), "label")
    parts = partonomy(seeds, reversed_edges(part_of)).filter("depth > 0").join(graph.nodes.select(F.col("key").alias("node"), F.col("label").alias("kind")), "node")
    n = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    counts = parts.groupBy("root").agg(n("KnowledgeUnit", "units"), n("Topic", "topics"), n("Concept", "concepts"))
    shown = seeds.select("root", "label").join(counts, "root", "left").na.fill(0, ["units", "topics", "concepts"])
    shown = shown.withColumn("with_concepts", F.col("concepts").between(1, TREE_CONCEPTS))
    inner = part_of.select(F.col("target").alias("node")).distinct()
    empty = parts.filter("depth = 1").join(inner, "node", "left_anti").select("root", "kind")
    bare = empty.join(shown.filter("label = 'KnowledgeArea'").select("root", "with_concepts"), "root").filter("kind <> 'Concept' OR with_concepts").groupBy("root").agg(F.count("*").alias("bare"))
    out = shown.join(bare, "root", "left").na.fill(0, ["bare"])
    return out.select(F.col("root").alias("key"), "units", "topics", "concepts", "with_concepts", "bare", F.when(F.col("bare") > BARE_UNITS, F.col("bare")).otherwise(0).alias("summarized"))


def overview_ring(overview: DataFrame) -> DataFrame:
    """(key, part, place, filled, told) of an overview (part, place, key, topics, concepts): areas stand on a ring, those with topics filled and told by their
    numbers; courses stand in a grid, by row."""
    filled = F.coalesce(F.col("topics") > 0, F.lit(False))
    some = lambda c, one: F.concat(F.col(c).cast("string"), F.lit(" " + one), F.when(F.col(c) == 1, "").otherwise("s"))
    return overview.select("key", "part", "place", filled.alias("filled"), F.when(filled, F.concat_ws(" · ", some("topics", "tema"), some("concepts", "concepto"))).alias("told"))


def clusters(graph: Graph) -> DataFrame:
    """(key, type, direction, n, clustered): a node's neighbours by type and direction; drawn as one cluster above CLUSTER."""
    edges = graph.edges.filter("type <> 'WAS_DERIVED_FROM'")
    both = edges.select(F.col("source").alias("key"), "type", F.lit("out").alias("direction")).union(edges.select(F.col("target").alias("key"), "type", F.lit("in").alias("direction")))
    return both.groupBy("key", "type", "direction").agg(F.count("*").alias("n")).withColumn("clustered", F.col("n") > CLUSTER)


def far_nodes(second: DataFrame, most: int = FAR_NODES) -> DataFrame:
    """(root, via, key): at most so many far nodes (root, via, key) of a root, one queue per near node, taken round by round."""
    one = second.groupBy("root", "key").agg(F.min("via").alias("via"))
    queued = one.withColumn("round", F.row_number().over(Window.partitionBy("root", "via").orderBy("key")))
    n = F.row_number().over(Window.partitionBy("root").orderBy("round", "via"))
    return queued.withColumn("n", n).filter(F.col("n") <= most).select("root", "via", "key")


def kinds_of(graph: Graph) -> DataFrame:
    """(root, role, key, place): what each concept is directly a kind of (general) and which kinds it has (kind), the latter by name."""
    links = graph.links("SPECIALIZES").select("source", "target")
    rows = links.select(F.col("source").alias("root"), F.lit("general").alias("role"), F.col("target").alias("key")).union(links.select(F.col("target").alias("root"), F.lit("kind").alias("role"), F.col("source").alias("key")))
    rows = rows.join(graph.nodes.select("key", "name_es"), "key")
    place = F.row_number().over(Window.partitionBy("root", "role").orderBy(F.col("name_es").asc_nulls_last(), "key"))
    return rows.select("root", "role", "key", place.alias("place"))


def kinds_levels(graph: Graph, starts: DataFrame) -> DataFrame:
    """(root, key, level): levels of generalisations above (negative) and of kinds below the starts (root), each to the first empty one."""
    from curralis.operators.closure import bfs

    seeds = starts.select("root", F.col("root").alias("node"))
    links, far = graph.links("SPECIALIZES").select("source", "target"), 1 << 30
    up = bfs(seeds, links, far).select("root", F.col("node").alias("key"), (-F.col("depth")).alias("level"))
    down = bfs(seeds, reversed_edges(links), far).filter("depth > 0").select("root", F.col("node").alias("key"), F.col("depth").alias("level"))
    return up.unionByName(down)


#: Which questions apply to which classes; fixed values of the data model. A null applies to every class.
LENSES = {
    "neighborhood": None,
    "prerequisites": ("Concept",),
    "path": (*LEVELS, "Course"),
    "courses": ("Course",),
    "location": ("KnowledgeUnit", "Topic", "Concept"),
    "contents": ("KnowledgeArea", "KnowledgeUnit", "Topic"),
    "resources": (*LEVELS, "Course"),
    "kinds": ("Concept",),
}


def lenses(graph: Graph) -> DataFrame:
    """(key, lens): the questions that apply to each node."""
    rows = [(lens, c) for lens, classes in LENSES.items() for c in classes or CLASSES]
    return graph.nodes.select("key", "label").join(F.broadcast(graph.spark.createDataFrame(rows, "lens string, label string")), "label").select("key", "lens")
