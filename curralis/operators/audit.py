"""The audit: fifteen integrity rules over the raw tier, each a frame of the elements that break it.

The raw tier can hold violations: nodes (id, labels, props) and edges (id, type, src, dst, props), where props maps a
name to a value's kind and text. Nodes are identified by id, as keys may be missing or repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curralis.functions.text import locator_ok
from curralis.operators.components import strongly_connected
from curralis.plans.lineage import settled
from curralis.schema import ACYCLIC, DERIVED, EDGE_TYPES, KNOWLEDGE_ELEMENT, LABELS, LAYERS, LEVELS, NODE_PROPERTIES, OWN_PROPERTIES, REQUIRED_PARENT, SAMPLE, TOP_LEVEL, admitted_pairs

RAW_NODES = "id string, labels array<string>, props map<string, struct<kind: string, text: string>>"
RAW_EDGES = "id string, type string, src string, dst string, props map<string, struct<kind: string, text: string>>"


def _text(props: Column, name: str) -> Column:
    """A property as text, null where it is missing or isn't a scalar."""
    value = props[name]
    return F.when(value["kind"] != "other", value["text"])


def _joined(items: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(items, " "))


class RawGraph:
    """Raw nodes and edges, with what several rules read of them."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        key, layer = _text(F.col("props"), "key"), F.col("props")["layer"]
        self.nodes = nodes.select("id", "labels", "props", F.coalesce(key, "id").alias("name"), layer["text"].alias("layer"), layer["kind"].alias("layer_kind"))
        end = lambda p: self.nodes.select(F.col("id").alias(p), F.col("name").alias(f"{p}_name"), F.col("labels").alias(f"{p}_labels"), F.col("layer").alias(f"{p}_layer"), F.col("layer_kind").alias(f"{p}_kind"))
        # nodes pack so well in files that they would be sent to the driver and every executor, props and all: both sides are dealt out
        self.edges = edges.join(end("src").hint("merge"), "src").join(end("dst").hint("merge"), "dst")

    def settled(self) -> RawGraph:
        """The same graph, computed once for all rules that read it: one state, and the joins with both ends only once."""
        out = RawGraph.__new__(RawGraph)
        out.nodes, out.edges = settled(self.nodes), settled(self.edges)
        return out

    def labelled(self, label: str) -> DataFrame:
        return self.nodes.filter(F.array_contains("labels", label))


def _edge() -> Column:
    return F.concat(F.lit("("), "src_name", F.lit(")-[:"), "type", F.lit("]->("), "dst_name", F.lit(")"))
_levels = lambda: F.array(*[F.lit(x) for x in LEVELS])


def _elements(rows: DataFrame, *parts: Column | str) -> DataFrame:
    return rows.select(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("element"))


def ri_01(g: RawGraph) -> DataFrame:
    value = F.col("props")["key"]
    none = _elements(g.nodes.filter(value.isNull()), F.col("id"), " has no key")
    copies = g.nodes.filter(value.isNotNull()).groupBy(value.alias("key")).agg(F.count("*").alias("n")).filter("n > 1")
    return none.union(_elements(copies, F.when(F.col("key.kind") == "other", "<non-scalar key>").otherwise(F.col("key.text")), " is the key of ", F.col("n").cast("string"), " nodes"))


def ri_02(g: RawGraph) -> DataFrame:
    known = F.array(*[F.lit(x) for x in LABELS])
    bad = ~F.arrays_overlap("labels", known) | (F.size(F.array_except("labels", known)) > 0) | (F.arrays_overlap("labels", _levels()) & ~F.array_contains("labels", KNOWLEDGE_ELEMENT))
    return _elements(g.nodes.filter(bad), F.col("name"), " has labels", _joined(F.col("labels")))


def ri_03(g: RawGraph) -> DataFrame:
    top = F.size(F.array_intersect("labels", F.array(*[F.lit(x) for x in TOP_LEVEL])))
    bad = (top != 1) | (F.array_contains("labels", KNOWLEDGE_ELEMENT) & (F.size(F.array_intersect("labels", _levels())) != 1))
    return _elements(g.nodes.filter(bad), F.col("name"), " has labels", _joined(F.col("labels")))


def ri_04(g: RawGraph) -> DataFrame:
    return _elements(g.edges.filter(~F.col("type").isin(*EDGE_TYPES)), _edge())


def ri_05(g: RawGraph) -> DataFrame:
    edges = g.edges.filter(F.col("type").isin(*EDGE_TYPES))
    ends = edges.select("id", "type", F.explode("src_labels").alias("source_label"), "dst_labels").select("id", "type", "source_label", F.explode("dst_labels").alias("target_label"))
    fine = ends.join(F.broadcast(admitted_pairs(edges.sparkSession)), ["type", "source_label", "target_label"], "left_semi").select("id").distinct()
    return _elements(edges.join(fine, "id", "left_anti"), _edge(), " joins", _joined(F.col("src_labels")), " to", _joined(F.col("dst_labels")))


def ri_06(g: RawGraph) -> DataFrame:
    copies = g.edges.groupBy("src", "dst", "type", "src_name", "dst_name").agg(F.count("*").alias("n")).filter("n > 1")
    return _elements(copies, _edge(), " appears ", F.col("n").cast("string"), " times")


def ri_07(g: RawGraph) -> DataFrame:
    inside = g.edges.filter((F.col("type") == "PART_OF") & F.array_contains("src_labels", "KnowledgeUnit") & F.array_contains("dst_labels", "KnowledgeArea"))
    many = inside.groupBy("src", "src_name").agg(F.count_distinct("dst").alias("n")).filter("n > 1")
    return _elements(many, F.col("src_name"), " is part of ", F.col("n").cast("string"), " areas")


def ri_08(g: RawGraph) -> DataFrame:
    out = None
    for child, parent in REQUIRED_PARENT.items():
        held = g.edges.filter((F.col("type") == "PART_OF") & F.array_contains("dst_labels", parent)).select(F.col("src").alias("id")).distinct()
        rows = _elements(g.labelled(child).join(held, "id", "left_anti"), F.col("name"), f" ({child}) is not part of any {parent}")
        out = rows if out is None else out.union(rows)
    return out


def ri_09(g: RawGraph) -> DataFrame:
    every, own = F.array(*[F.lit(x) for x in NODE_PROPERTIES]), F.array().cast("array<string>")
    declared = F.when(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in LABELS])), every).otherwise(own)
    for label, names in OWN_PROPERTIES.items():
        declared = F.concat(declared, F.when(F.array_contains("labels", label), F.array(*[F.lit(x) for x in names])).otherwise(own))
    nodes = g.nodes.withColumn("more", F.array_sort(F.array_except(F.map_keys("props"), declared))).filter(F.size("more") > 0)
    by_layer = F.when((F.col("src_layer") == "institutional") & (F.col("src_kind") == "string"), F.array(F.lit("provenance"))).otherwise(own)
    edges = g.edges.withColumn("more", F.array_sort(F.array_except(F.map_keys("props"), by_layer))).filter(F.size("more") > 0)
    return _elements(nodes, F.col("name"), " has undeclared properties", _joined(F.col("more"))).union(_elements(edges, _edge(), " has undeclared properties", _joined(F.col("more"))))


def ri_10(g: RawGraph) -> DataFrame:
    value = F.col("props")["resourceLocator"]
    bad = value.isNotNull() & ~F.coalesce((value["kind"] == "string") & locator_ok(value["text"]), F.lit(False))
    return _elements(g.labelled("LearningResource").filter(bad), F.col("name"), " has locator ", F.when(value["kind"] == "other", "<non-scalar>").otherwise(value["text"]))


def rm_01(g: RawGraph) -> DataFrame:
    fine = F.coalesce((F.col("layer_kind") == "string") & F.col("layer").isin(*LAYERS), F.lit(False))
    return _elements(g.nodes.filter(~fine), F.col("name"), " has layer ", F.coalesce(F.when(F.col("layer_kind") != "other", F.col("layer")), F.lit("<none>")))


def rm_02(g: RawGraph) -> DataFrame:
    return _elements(g.edges.filter("src_layer = 'reference' AND dst_layer = 'institutional'"), _edge())


def rm_03(g: RawGraph) -> DataFrame:
    own = g.nodes.filter((F.col("layer") == "institutional") & F.arrays_overlap("labels", F.array(*[F.lit(x) for x in DERIVED])))
    derived = g.edges.filter((F.col("type") == "WAS_DERIVED_FROM") & F.array_contains("dst_labels", "LearningResource")).select(F.col("src").alias("id")).distinct()
    nodes = _elements(own.join(derived, "id", "left_anti"), F.col("name"), " does not derive from any LearningResource")
    return nodes.union(_elements(g.edges.filter((F.col("src_layer") == "institutional") & F.col("props")["provenance"].isNull()), _edge(), " has no provenance"))


def rm_04(g: RawGraph) -> DataFrame:
    out = None
    for kind in ACYCLIC:
        cyclic = strongly_connected(g.edges.filter(F.col("type") == kind).select(F.col("src").alias("source"), F.col("dst").alias("target"))).select(F.col("node").alias("id"))
        rows = _elements(g.nodes.join(cyclic, "id", "left_semi"), F.col("name"), f" is on a {kind} cycle")
        out = rows if out is None else out.union(rows)
    return out


def rm_05(g: RawGraph) -> DataFrame:
    return _elements(g.labelled("LearningResource").filter(F.col("props")["resourceLocator"].isNull()), F.col("name"), " has no locator")


RULES: dict[str, Callable[[RawGraph], DataFrame]] = {
    "RI-01": ri_01, "RI-02": ri_02, "RI-03": ri_03, "RI-04": ri_04, "RI-05": ri_05, "RI-06": ri_06, "RI-07": ri_07, "RI-08": ri_08, "RI-09": ri_09, "RI-10": ri_10,
    "RM-01": rm_01, "RM-02": rm_02, "RM-03": rm_03, "RM-04": rm_04, "RM-05": rm_05,
}


def report(g: RawGraph, rules: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """(rule, violations, sample): one row per rule, sample the first SAMPLE elements in order. Only what can be in a sample is gathered."""
    from pyspark.sql import Window

    g, found = g.settled(), None
    for rule in rules:
        rows = RULES[rule](g).withColumn("rule", F.lit(rule))
        found = rows if found is None else found.unionByName(rows)
    found = settled(found)
    counts = found.groupBy("rule").agg(F.count("*").alias("violations"))
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("rule").orderBy("element"))).filter(F.col("n") <= SAMPLE)
    samples = first.groupBy("rule").agg(F.array_sort(F.collect_list("element")).alias("sample"))
    every = g.nodes.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    out = every.join(counts, "rule", "left").join(samples, "rule", "left")
    return out.select("rule", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("sample", F.array().cast("array<string>")).alias("sample"))


def is_clean(audit_report: DataFrame) -> bool:
    return not audit_report.agg(F.sum("violations")).first()[0]


def raw_of(nodes: DataFrame, edges: DataFrame) -> RawGraph:
    """The raw tier of clean nodes and edges: the analogue of reading the stored graph for the audit."""
    level = F.when(F.col("label").isin(*LEVELS), F.array(F.lit(KNOWLEDGE_ELEMENT), F.col("label"))).otherwise(F.array("label"))
    raw = nodes.select(F.col("key").alias("id"), level.alias("labels"), props({"key": "key", "layer": "layer", "prefLabelEs": "name_es", "prefLabelEn": "name_en", "description": "description", "resourceLocator": "locator", "courseCode": "course_code"}))
    return RawGraph(raw, edges.select(F.concat_ws("|", "type", "source", "target").alias("id"), "type", F.col("source").alias("src"), F.col("target").alias("dst"), props({"provenance": "provenance"})))


def props(columns: dict[str, str], kinds: dict[str, str] | None = None) -> Column:
    """The column props from plain columns: property name to column; a null is a missing property. kinds: columns that hold kinds."""
    entries = [F.struct(F.lit(name).alias("key"), F.struct((F.col(kinds[name]) if kinds and name in kinds else F.lit("string")).alias("kind"), F.col(c).cast("string").alias("text")).alias("value")) for name, c in columns.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"]["text"].isNotNull())).alias("props")
