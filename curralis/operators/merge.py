"""Insert-only merging of a batch into a graph version, with derivations and counters, and atomic publication.

Existing nodes and edges keep everything they have; only what is new is appended. The new version is written beside the
old one and takes effect when its name is put into the pointer table, so a failed write changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curralis.plans.lineage import dealt
from curralis.schema import CLASSES, DERIVED, EDGES, LAYERS, LEVELS, NODES, OWN_PROPERTIES, SAMPLE, Graph


class SnapshotError(Exception):
    """The graph holds something that a snapshot can't tell."""


class WriteMismatch(Exception):
    """What would be written isn't what the batch asks for; nothing is."""


def new_nodes(graph: Graph, nodes: DataFrame, layer: str) -> DataFrame:
    """The batch's nodes that the graph has no key of, in the write's layer."""
    return nodes.dropDuplicates(["key"]).join(graph.nodes.select("key"), "key", "left_anti").withColumn("layer", F.lit(layer)).select(*graph.nodes.columns)


def derivations(fresh: DataFrame, provenance: str | None) -> DataFrame:
    """WAS_DERIVED_FROM edges of the new nodes that need one, to the resource the batch comes from."""
    rows = fresh.filter(F.col("label").isin(*DERIVED))
    return rows.select(F.lit("WAS_DERIVED_FROM").alias("type"), F.col("key").alias("source"), F.lit(provenance).cast("string").alias("target"))


def new_edges(graph: Graph, fresh: DataFrame, edges: DataFrame, layer: str, provenance: str | None) -> DataFrame:
    """The batch's edges that the graph lacks, between nodes that exist, from a source of the write's layer."""
    nodes = graph.nodes.select("key", "layer").union(fresh.select("key", "layer"))
    wanted = edges.select("type", "source", "target").distinct()
    sources = nodes.filter(F.col("layer") == layer).select(F.col("key").alias("source"))
    rows = wanted.join(sources, "source", "left_semi").join(nodes.select(F.col("key").alias("target")), "target", "left_semi")
    rows = rows.join(graph.edges.select("type", "source", "target"), ["type", "source", "target"], "left_anti")
    return rows.select("type", "source", "target", F.lit(provenance).cast("string").alias("provenance"))


def merge(graph: Graph, nodes: DataFrame, edges: DataFrame, layer: str, provenance: str | None = None) -> tuple[Graph, DataFrame, DataFrame]:
    """The graph with the batch merged in, and the new nodes and edges. provenance is given exactly for institutional writes."""
    if (layer == "institutional") != (provenance is not None):
        raise ValueError("an institutional write names its provenance, a reference write has none")
    fresh = new_nodes(graph, nodes, layer)
    asked = edges.select("type", "source", "target")
    if provenance is not None:
        asked = asked.union(derivations(fresh, provenance))
    added = new_edges(graph, fresh, asked, layer, provenance)
    return Graph(graph.nodes.unionByName(fresh), graph.edges.unionByName(added)), fresh, added


def missing(graph: Graph, fresh: DataFrame, edges: DataFrame, added: DataFrame) -> DataFrame:
    """Edges of the batch that are neither in the graph nor added: the write would not do what it was asked."""
    key = ["type", "source", "target"]
    return edges.select(*key).distinct().join(graph.edges.select(*key), key, "left_anti").join(added.select(*key), key, "left_anti")


def snapshot_nodes(graph: Graph) -> DataFrame:
    """(key, label, layer, name_es, name_en, area): what validation and linking read; area for units, which have one at most."""
    areas = graph.links("PART_OF").join(graph.of("KnowledgeArea").select(F.col("key").alias("target")), "target", "left_semi").groupBy("source").agg(F.min("target").alias("area"))
    rows = graph.nodes.join(areas, graph.nodes.key == areas.source, "left")
    return rows.select("key", "label", "layer", "name_es", "name_en", F.when(F.col("label") == "KnowledgeUnit", F.col("area")).alias("area"))


def snapshot_problems(graph: Graph) -> DataFrame:
    """(key, problem) of nodes that no snapshot may hold: without a key, of several classes, of an unknown layer, units of several areas."""
    of = graph.nodes.groupBy("key").agg(F.sort_array(F.collect_set("label")).alias("labels"), F.sort_array(F.collect_set(F.coalesce("layer", F.lit("<none>")))).alias("layers"))
    several = of.filter("size(labels) <> 1").select("key", F.concat(F.lit("classes "), F.array_join("labels", " ")).alias("problem"))
    layer = of.filter(F.exists("layers", lambda x: ~x.isin(*LAYERS))).select("key", F.concat(F.lit("layer "), F.array_join("layers", " ")).alias("problem"))
    unknown = graph.nodes.filter(F.col("key").isNotNull() & ~F.coalesce(F.col("label").isin(*CLASSES), F.lit(False))).select("key", F.concat(F.lit("class "), F.coalesce("label", F.lit("<none>"))).alias("problem"))
    none = graph.nodes.filter("key IS NULL").select("key", F.lit("no key").alias("problem"))
    areas = graph.links("PART_OF").join(graph.of("KnowledgeUnit").select(F.col("key").alias("source")), "source", "left_semi").join(graph.of("KnowledgeArea").select(F.col("key").alias("target")), "target", "left_semi")
    wide = areas.groupBy(F.col("source").alias("key")).agg(F.sort_array(F.collect_set("target")).alias("areas")).filter("size(areas) > 1").select("key", F.concat(F.lit("areas "), F.array_join("areas", " ")).alias("problem"))
    return several.unionByName(layer).unionByName(unknown).unionByName(none).unionByName(wide).distinct()


def snapshot(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that a run starts from; raises SnapshotError where the graph isn't one that a snapshot can tell."""
    if found := [f"{r.key}: {r.problem}" for r in snapshot_problems(graph).orderBy("key", "problem").limit(SAMPLE).collect()]:
        raise SnapshotError("; ".join(found))
    return snapshot_nodes(graph), snapshot_edges(graph)


def snapshot_edges(graph: Graph) -> DataFrame:
    """The edges that must stay acyclic, and the partonomy of topics and concepts."""
    inner = graph.of("Topic", "Concept").select(F.col("key").alias("source"))
    return graph.links("HAS_PREREQUISITE", "SPECIALIZES").select("type", "source", "target").unionByName(graph.links("PART_OF").join(inner, "source", "left_semi").select("type", "source", "target"))


def only_reference(graph: Graph) -> Graph:
    nodes = graph.nodes.filter("layer = 'reference'")
    keys = nodes.select("key")
    edges = graph.edges.join(keys.toDF("source"), "source", "left_semi").join(keys.toDF("target"), "target", "left_semi")
    return Graph(nodes, edges.select(*graph.edges.columns))


def before(graph: Graph, earlier: tuple[DataFrame, DataFrame], later: tuple[DataFrame, DataFrame]) -> Graph:
    """graph without what only later batches brought: their (key) and (type, source, target) that no earlier batch has too."""
    key = ["type", "source", "target"]
    nodes = later[0].select("key").distinct().join(earlier[0].select("key"), "key", "left_anti")
    edges = later[1].select(*key).distinct().join(earlier[1].select(*key), key, "left_anti")
    kept = graph.nodes.join(nodes, "key", "left_anti")
    rest = graph.edges.join(edges, key, "left_anti").join(nodes.toDF("source"), "source", "left_anti").join(nodes.toDF("target"), "target", "left_anti")
    return Graph(kept, rest.select(*graph.edges.columns))


def undeclared(nodes: DataFrame) -> DataFrame:
    """(key, property) of the batch's nodes that carry a property which their class doesn't declare."""
    own = {"course_code": "courseCode", "locator": "resourceLocator"}
    rows = None
    for column, name in own.items():
        if column in nodes.columns:
            classes = [c for c, names in OWN_PROPERTIES.items() if name in names]
            found = nodes.filter(F.col(column).isNotNull() & ~F.col("label").isin(*classes)).select("key", F.lit(name).alias("property"))
            rows = found if rows is None else rows.unionByName(found)
    return rows if rows is not None else nodes.select("key", F.lit("").alias("property")).limit(0)


class GraphStore:
    """Versions of a graph as Parquet in a folder; the newest row of the pointer table names the one in effect."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def reset(self) -> Graph:
        return self.publish(Graph(self.spark.createDataFrame([], NODES), self.spark.createDataFrame([], EDGES)))

    def publish(self, graph: Graph) -> Graph:
        name = uuid.uuid4().hex
        dealt(graph.nodes, "label", "key").write.partitionBy("label").parquet(f"{self.path}/{name}/nodes")
        dealt(graph.edges, "type", "source").write.partitionBy("type").parquet(f"{self.path}/{name}/edges")
        number = self._last()[0] + 1
        self.spark.createDataFrame([(number, name)], "number long, name string").coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")
        return self.current()

    def _last(self) -> tuple[int, str | None]:
        try:
            return tuple(self.spark.read.schema("number long, name string").parquet(f"{self.path}/pointer").orderBy(F.desc("number")).first() or (0, None))
        except Exception as e:  # the first publication finds no pointer
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0, None

    def current(self) -> Graph:
        name = self._last()[1]
        read = lambda part, schema: self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{part}").select(*[c.split()[0] for c in schema.split(", ")])
        return Graph(read("nodes", NODES), read("edges", EDGES))

    def write_batch(self, nodes: DataFrame, edges: DataFrame, layer: str, provenance: str | None = None) -> tuple[int, int]:
        """Merges and publishes; returns the numbers of new nodes and edges. WriteMismatch leaves the version in effect as it was."""
        graph = self.current()
        whole, fresh, added = merge(graph, nodes, edges, layer, provenance)
        asked = nodes.select("key").distinct().join(graph.nodes.select("key"), "key", "left_anti").count()
        if fresh.count() != asked:
            raise WriteMismatch(f"expected {asked} new nodes, created {fresh.count()}")
        extra = undeclared(nodes)
        if not extra.isEmpty():
            raise ValueError(f"undeclared properties: {[tuple(r) for r in extra.limit(5).collect()]}")
        lost = missing(graph, fresh, edges, added)
        if not lost.isEmpty():
            raise WriteMismatch(f"edges that can't be written: {[tuple(r) for r in lost.limit(5).collect()]}")
        numbers = fresh.count(), added.count()
        self.publish(whole)
        return numbers


def label_array(label):
    """All labels that a node of this class carries."""
    return F.when(label.isin(*LEVELS), F.array(F.lit("KnowledgeElement"), label)).otherwise(F.array(label))
