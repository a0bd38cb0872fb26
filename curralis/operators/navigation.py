"""The navigation questions over a Graph, for any number of starting nodes at once.

starts is a DataFrame (root); roots that aren't nodes of the right class give no rows. Each function returns the found nodes
(root, key, ...); subgraph() adds the edges between them as stored, their derivations and sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curralis.functions.text import fold, tokens
from curralis.operators.closure import bfs, partonomy, reversed_edges
from curralis.plans.lineage import counted, settled
from curralis.schema import LEVELS, MAX_NEIGHBORS, MAX_RESULTS, MAX_SECOND, TOP_LEVEL, Graph

DERIVED_FROM = "WAS_DERIVED_FROM"


def roots(graph: Graph, starts: DataFrame | None, *labels: str) -> DataFrame:
    """(root, node): the starts that are nodes of these classes; all such nodes without starts."""
    found = graph.of(*labels).select(F.col("key").alias("root"))
    if starts is not None:
        found = found.join(starts.select("root").distinct(), "root", "left_semi")
    return found.withColumn("node", F.col("root"))


def _closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    return bfs(seeds, edges).select("root", F.col("node").alias("key"), "depth")


def merged(found: DataFrame) -> DataFrame:
    """One row per node of a root: the least depth of those it was reached with (null if none has one)."""
    return found.groupBy("root", "key").agg(F.min("depth").alias("depth"))


def concept_prerequisites(graph: Graph, starts: DataFrame | None = None) -> DataFrame:
    """The concept at depth 0 and what it needs, transitively."""
    return _closure(roots(graph, starts, "Concept"), graph.links("HAS_PREREQUISITE"))


def concept_specializations(graph: Graph, starts: DataFrame | None = None) -> DataFrame:
    """The concept, what it specializes and what specializes it, each with its number of steps."""
    seeds, edges = roots(graph, starts, "Concept"), graph.links("SPECIALIZES")
    return merged(_closure(seeds, edges).unionByName(_closure(seeds, reversed_edges(edges))))


def course_prerequisites(graph: Graph, starts: DataFrame | None = None) -> DataFrame:
    """(root, key): the course, the concepts it teaches and requires, and the other courses that teach a required one."""
    seeds = roots(graph, starts, "Course").select("root")
    teaches, requires = graph.links("TEACHES_CONCEPT"), graph.links("REQUIRES_CONCEPT")
    taught = teaches.select(F.col("source").alias("root"), F.col("target").alias("key"))
    required = requires.select(F.col("source").alias("root"), F.col("target").alias("key"))
    others = required.join(teaches, required.key == teaches.target).filter("source <> root").select("root", F.col("source").alias("key"))
    found = taught.unionByName(required).unionByName(others).join(seeds, "root", "left_semi")
    return found.unionByName(seeds.withColumn("key", F.col("root"))).distinct()


def element_location(graph: Graph, starts: DataFrame | None = None, labels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(root, key, depth, direction): the element, what it is part of (up) and what is part of it (down)."""
    seeds, edges = roots(graph, starts, *labels), graph.links("PART_OF")
    side = lambda e, name: partonomy(seeds, e).select("root", F.col("node").alias("key"), "depth", F.lit(name).alias("direction"))
    up, down = side(edges, "up"), side(reversed_edges(edges), "down")
    return up.unionByName(down.filter("depth > 0")).withColumn("direction", F.when(F.col("depth") > 0, F.col("direction")).otherwise("self"))


def element_resources(graph: Graph, starts: DataFrame | None = None) -> DataFrame:
    """(root, key, role): the element, its covered parts and what lies between, the resources about them and their types."""
    seeds = roots(graph, starts, *LEVELS, "Course")
    part_of, about = graph.links("PART_OF"), graph.links("IS_ABOUT")
    parts = settled(partonomy(seeds, reversed_edges(part_of)).filter("depth > 0").select("root", "node"))
    covered = parts.join(about.select(F.col("target").alias("node")), "node", "left_semi")
    above = partonomy(covered.select(F.struct("root", "node").alias("root"), "node"), part_of).filter("depth > 0")
    between = above.select("root.root", "node").distinct().join(parts, ["root", "node"], "left_semi").join(covered, ["root", "node"], "left_anti")
    subjects = seeds.select("root", "node").union(covered.select("root", "node")).distinct()
    resources = subjects.join(about, subjects.node == about.target).select("root", F.col("source").alias("node")).distinct()
    kinds = graph.links("HAS_RESOURCE_TYPE")
    types = resources.join(kinds, resources.node == kinds.source).select("root", F.col("target").alias("node")).distinct()
    out = None
    for role, rows in (("element", seeds), ("covered", covered), ("between", between), ("resource", resources), ("type", types)):
        rows = rows.select("root", F.col("node").alias("key"), F.lit(role).alias("role"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def learning_path(graph: Graph, grain: str, starts: DataFrame | None = None, labels: tuple[str, ...] = (*LEVELS, "Course")) -> DataFrame:
    """(root, key, depth): what has to be learnt before the target, lifted to a grain (topic, area or course).

    Depth 0: the target, the concepts in it that have a prerequisite outside, and the parts of the target above those.
    Prerequisites outside the target have the least number of steps from any concept inside; what they are lifted to
    has the least of theirs. For the grain area the elements on the way up are found too, without a depth.
    """
    seeds, part_of, needs, teaches = roots(graph, starts, *labels), graph.links("PART_OF"), graph.links("HAS_PREREQUISITE"), graph.links("TEACHES_CONCEPT")
    concepts = graph.of("Concept").select(F.col("key").alias("node"))
    contained = settled(partonomy(seeds, reversed_edges(part_of)).select("root", "node"))  # the target itself too, which counts if it is a concept
    taught = seeds.select("root").join(teaches, F.col("root") == F.col("source")).select("root", F.col("target").alias("node"))
    inside = settled(contained.join(concepts, "node", "left_semi").select("root", "node").union(taught).distinct())
    outside = settled(bfs(inside, needs).filter("depth > 0").join(inside, ["root", "node"], "left_anti").select("root", "node", "depth"))
    if grain == "topic":
        topics = part_of.join(graph.of("Topic").select(F.col("key").alias("target")), "target", "left_semi")
        lifted = outside.join(topics, F.col("node") == F.col("source")).select("root", F.col("target").alias("key"), "depth")
    elif grain == "area":
        up = partonomy(outside.select(F.struct("root", "depth").alias("root"), "node"), part_of).toDF("from", "key", "steps").filter("steps > 0")
        areas = graph.of("KnowledgeArea").select("key", F.lit(True).alias("area"))
        lifted = up.join(areas, "key", "left").select("from.root", "key", F.when(F.col("area"), F.col("from.depth")).alias("depth"))
    elif grain == "course":
        lifted = outside.join(teaches, F.col("node") == F.col("target")).select("root", F.col("source").alias("key"), "depth")
    else:
        raise ValueError(f"no grain {grain!r}")
    direct = inside.join(needs, F.col("node") == F.col("source")).select("root", F.col("node").alias("inner"), F.col("target").alias("node"))
    frontier = direct.join(outside, ["root", "node"], "left_semi").select("root", F.col("inner").alias("node")).distinct()
    above = partonomy(frontier.select(F.struct("root", "node").alias("root"), "node"), part_of).filter("depth > 0").select("root.root", "node")
    within = above.distinct().join(contained, ["root", "node"], "left_semi")
    still = seeds.select("root", "node").union(frontier).union(within.select("root", "node")).select("root", F.col("node").alias("key"), F.lit(0).alias("depth"))
    return merged(still.unionByName(outside.withColumnRenamed("node", "key")).unionByName(lifted))


def _sides(graph: Graph) -> DataFrame:
    """(node, other, direction, type): every edge but derivations, from both of its ends; 0: outgoing."""
    edges = graph.edges.filter(F.col("type") != DERIVED_FROM).filter("source <> target")
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), F.lit(0).alias("direction"), "type")
    return out.unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), F.lit(1).alias("direction"), "type"))


def _first(graph: Graph, rows: DataFrame, limit: int) -> DataFrame:
    """(node, other, direction, type, rank): the first neighbours of each node in rows of _sides(), outgoing first, then by type, name and key."""
    each = rows.groupBy("node", "other").agg(F.min("direction").alias("direction"), F.min("type").alias("type"))
    named = each.join(graph.nodes.select(F.col("key").alias("other"), "name_es").hint("merge"), "other")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("direction", "type", F.col("name_es").asc_nulls_last(), "other"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= limit).select("node", "other", "direction", "type", "rank")


def node_neighbours(graph: Graph, starts: DataFrame | None = None) -> DataFrame:
    """(root, key, direction, type, rank): the direct neighbours that node_detail shows."""
    rows = roots(graph, starts, *LEVELS, *TOP_LEVEL[1:]).select("node").join(_sides(graph), "node")
    return _first(graph, rows, MAX_NEIGHBORS).select(F.col("node").alias("root"), F.col("other").alias("key"), "direction", "type", "rank")


def second_ring(graph: Graph, direct: DataFrame) -> DataFrame:
    """(root, via, key): for each direct neighbour (direct is of node_neighbours, so at most MAX_NEIGHBORS of a root) its first neighbours that are neither the root nor direct.

    A node's neighbours stand in one order for all roots, and at most the root and its direct ones are passed over, so that
    the first MAX_SECOND + 1 + MAX_NEIGHBORS of each node are enough: a node with many neighbours isn't met by each of them with all others.
    """
    d = settled(direct.select("root", F.col("key").alias("node")))
    first = _first(graph, _sides(graph).join(d.select("node").distinct().hint("merge"), "node", "left_semi"), MAX_SECOND + 1 + MAX_NEIGHBORS)
    queues = settled(first.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "other"))).alias("queue")))
    passed = d.groupBy("root").agg(F.collect_list("node").alias("passed"))
    rows = d.join(queues.hint("merge"), "node").join(passed.hint("merge"), "root")
    kept = F.filter("queue", lambda q: (q["other"] != F.col("root")) & ~F.array_contains("passed", q["other"]))
    return rows.select("root", F.col("node").alias("via"), F.explode(F.slice(kept, 1, MAX_SECOND)).alias("q")).select("root", "via", F.col("q.other").alias("key"))


def node_detail(graph: Graph, starts: DataFrame | None = None) -> DataFrame:
    """(root, key, more_neighbors, description): the node, its neighbours and theirs; whether each has others that are not shown.

    A root shows at most 1 + MAX_NEIGHBORS * (1 + MAX_SECOND) nodes: a node with as many neighbours has one that isn't shown, so only
    the neighbours of nodes with fewer are looked at.
    """
    direct = settled(node_neighbours(graph, starts))
    second = second_ring(graph, direct)
    seeds = roots(graph, starts, *LEVELS, *TOP_LEVEL[1:]).select("root", F.col("root").alias("key"))
    shown = settled(seeds.union(direct.select("root", "key")).union(second.select("root", "key")).distinct())
    most = 1 + MAX_NEIGHBORS * (1 + MAX_SECOND)
    sides = _sides(graph).select(F.col("node").alias("key"), "other").distinct()
    if starts is not None:
        sides = sides.join(shown.select("key").distinct(), "key", "left_semi")
    many = sides.groupBy("key").agg(F.count("*").alias("n")).withColumn("many", F.col("n") >= most)
    some = sides.join(many.filter("not many").select("key").hint("merge"), "key", "left_semi").groupBy("key").agg(F.collect_list("other").alias("others"))
    around = settled(many.select("key", "many").join(some.hint("merge"), "key", "left"))
    each = shown.join(around.hint("merge"), "key", "left").groupBy("root").agg(F.collect_list(F.struct("key", "many", "others")).alias("all"))
    each = each.withColumn("keys", F.col("all")["key"])
    beyond = lambda x: F.coalesce(x["many"] | (F.size(F.array_except(x["others"], F.col("keys"))) > 0), F.lit(False))
    out = each.select("root", F.explode(F.transform("all", lambda x: F.struct(x["key"].alias("key"), beyond(x).alias("more")))).alias("x")).select("root", "x.key", "x.more")
    texts = graph.nodes.filter("description IS NOT NULL").select(F.col("key").alias("root"), "description")
    out = out.join(texts, "root", "left").join(graph.nodes.select("key"), "key", "left_semi")
    return out.select("root", "key", F.col("more").alias("more_neighbors"), F.when(F.col("root") == F.col("key"), F.col("description")).alias("description"))


def overview(graph: Graph) -> DataFrame:
    """(place, key, name_es, units, topics, concepts): areas with the numbers of their distinct parts by name, then courses by code."""
    areas = graph.of("KnowledgeArea")
    parts = partonomy(areas.select(F.col("key").alias("root"), F.col("key").alias("node")), reversed_edges(graph.links("PART_OF"))).filter("depth > 0")
    labels = graph.nodes.select(F.col("key").alias("node"), "label")
    n = lambda label: F.count(F.when(F.col("label") == label, 1)).alias
    counts = parts.join(labels, "node").groupBy(F.col("root").alias("key")).agg(n("KnowledgeUnit")("units"), n("Topic")("topics"), n("Concept")("concepts"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    first = areas.join(counts, "key", "left").select(F.lit(0).alias("part"), F.col("name_es").alias("by"), "key", "name_es", zero("units"), zero("topics"), zero("concepts"))
    none = F.lit(None).cast("long")
    rest = graph.of("Course").select(F.lit(1).alias("part"), F.col("course_code").alias("by"), "key", "name_es", none.alias("units"), none.alias("topics"), none.alias("concepts"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("by").asc_nulls_last(), "key"))  # areas and courses are few and ordered for display
    return first.unionByName(rest).select("part", place.alias("place"), "key", "name_es", "units", "topics", "concepts")


#: Words that the search index leaves out; optional in a query.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


#: Characters by which words of a search meet those of the index.
HEAD = 4
#: Up to so many (query, word) pairs, a counted size, the queries' words are sent to where the index is.
FEW_WORDS = 10_000


def search_index(graph: Graph) -> DataFrame:
    """(key, field, token): the folded words of the names and codes of elements and courses, without stop words."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("name_es", "name_en", "course_code")])
    rows = graph.of(*LEVELS, "Course").select("key", F.explode(fields).alias("f"))
    return rows.select("key", "f.field", F.explode(tokens(fold(F.col("f.text")))).alias("token")).filter(~F.col("token").isin(*STOP_WORDS)).distinct()


def search(graph: Graph, queries: DataFrame, limit: int = MAX_RESULTS) -> DataFrame:
    """(query, key, score, rank): nodes where every word of a query (query) that isn't a stop word begins some word; stop words only add to the score.

    The score is the number of (word, field) pairs that match. Words meet index words by their first HEAD characters: an
    index word stands under each of its first HEAD beginnings, so that this is a join on equality.
    """
    terms = queries.select("query", F.explode(F.array_distinct(tokens(fold(F.col("query"))))).alias("word"))
    terms, n = counted(terms.withColumn("optional", F.col("word").isin(*STOP_WORDS)))
    # the index is many times the nodes' files, by whose size it would be sent to the driver and every executor
    terms = F.broadcast(terms) if n <= FEW_WORDS else terms.hint("merge")
    needed = terms.filter("not optional").groupBy("query").agg(F.count("*").alias("needed"))
    index = search_index(graph)
    heads = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(HEAD)), lambda n: F.substring("token", F.lit(1), n)))
    hits = terms.withColumn("head", F.substring("word", 1, HEAD)).join(index.withColumn("head", F.explode(heads)), "head").filter(F.col("token").startswith(F.col("word")))
    pairs = hits.select("query", "key", "word", "field", "optional").distinct()
    scored = pairs.groupBy("query", "key").agg(F.count("*").cast("double").alias("score"), F.count_distinct(F.when(~F.col("optional"), F.col("word"))).alias("met"))
    kept = scored.join(needed, "query", "left").filter(F.col("met") == F.coalesce("needed", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query", "key", "score", "rank")


def element_counts(graph: Graph) -> DataFrame:
    """(kind, name, n): nodes per label, a knowledge element under both of its labels, and edges per type."""
    both = F.when(F.col("label").isin(*LEVELS), F.array("label", F.lit(TOP_LEVEL[0]))).otherwise(F.array("label"))
    labels = graph.nodes.select(F.explode(both).alias("name")).groupBy("name").count().select(F.lit("label").alias("kind"), "name", F.col("count").alias("n"))
    return labels.unionByName(graph.edges.groupBy(F.col("type").alias("name")).count().select(F.lit("type").alias("kind"), "name", F.col("count").alias("n")))


def tail_edges(graph: Graph, found: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(root, type, source, target, provenance): edges of the types between found nodes (root, key), and the derivations of found nodes."""
    keys = found.select("root", "key").distinct()
    edges = graph.links(*types, DERIVED_FROM)
    out = keys.join(edges, keys.key == edges.source).select("root", "type", "source", "target", "provenance")
    inner = out.filter(F.col("type") != DERIVED_FROM).join(keys.select("root", F.col("key").alias("target")), ["root", "target"], "left_semi")
    return inner.select(*out.columns).unionByName(out.filter(F.col("type") == DERIVED_FROM)).distinct()


def sources(graph: Graph, edges: DataFrame) -> DataFrame:
    """(root, key): the resources that the edges of subgraphs derive from or cite as provenance."""
    resources = graph.of("LearningResource").select("key")
    cited = edges.select("root", F.explode(F.array("provenance", F.when(F.col("type") == DERIVED_FROM, F.col("target")))).alias("key"))
    return cited.filter("key IS NOT NULL").distinct().join(resources, "key", "left_semi").select("root", "key")


#: The edge types that each question keeps between the nodes that it finds.
KEPT = {
    "concept_prerequisites": ("HAS_PREREQUISITE",),
    "course_prerequisites": ("TEACHES_CONCEPT", "REQUIRES_CONCEPT"),
    "element_location": ("PART_OF", "HAS_PREREQUISITE"),
    "element_resources": ("IS_ABOUT", "PART_OF", "HAS_RESOURCE_TYPE"),
    "learning_path": ("HAS_PREREQUISITE", "PART_OF", "TEACHES_CONCEPT"),
    "concept_specializations": ("SPECIALIZES",),
}


def subgraph(graph: Graph, found: DataFrame, types: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Nodes (the found ones with their properties, then sources that weren't found) and edges of a question's answer."""
    edges = tail_edges(graph, found, types)
    extra = sources(graph, edges).join(found.select("root", "key"), ["root", "key"], "left_anti")
    nodes = found.unionByName(extra, allowMissingColumns=True).join(graph.nodes, "key")
    return nodes, edges


def resource_exists(graph: Graph, key: str) -> bool:
    return not graph.of("LearningResource").filter((F.col("layer") == "institutional") & (F.col("key") == key)).isEmpty()
