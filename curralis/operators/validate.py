"""Checks a batch of proposed facts against a snapshot, before anything is written. All violations are reported.

batch nodes (key, label, layer, name_es, name_en, course_code, locator, description), batch edges (type, source,
target); the snapshot is a Graph. Results: (ordinal, rule, fact, message), ordinal following the order of the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curralis.functions.text import locator_ok
from curralis.operators.components import strongly_connected
from curralis.schema import ACYCLIC, EDGE_TYPES, LAYERS, REQUIRED_PARENT, Graph, admitted_pairs

LOAD_RULES = ("RI-05", "RI-10", "RM-02", "RM-04", "RM-05")
INGESTION_RULES = ("RI-05", "RI-08", "RI-10", "RM-02", "RM-04", "RM-05")
def _fact() -> Column:
    return F.concat(F.lit("("), "source", F.lit(")-[:"), "type", F.lit("]->("), "target", F.lit(")"))


def repeated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fact) of keys and edges that a batch names twice; such a batch is refused before the rules."""
    keys = nodes.groupBy("key").count().filter("count > 1").select(F.col("key").alias("fact"))
    return keys.union(edges.groupBy("type", "source", "target").count().filter("count > 1").select(_fact().alias("fact")))


def _rows(df: DataFrame, rule: str, fact: Column, message: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), fact.alias("fact"), message.alias("message"))


def _resolved(snapshot: Graph, nodes: DataFrame, column: str, other: Column) -> DataFrame:
    """(key, column): the snapshot's value where it has the node, else the batch's."""
    old = snapshot.nodes.select("key", F.col(column).alias("old"))
    new = nodes.select("key", other.alias("new"))
    return old.join(new, "key", "full").select("key", F.coalesce("old", "new").alias(column))


def admitted(snapshot: Graph, nodes: DataFrame, edges: DataFrame, layer: str) -> DataFrame:
    labels = _resolved(snapshot, nodes, "label", F.col("label"))
    rows = edges.join(labels.toDF("source", "source_label"), "source", "left").join(labels.toDF("target", "target_label"), "target", "left")
    pairs = F.broadcast(admitted_pairs(snapshot.spark).withColumn("fine", F.lit(True)))
    rows = rows.join(pairs, ["type", "source_label", "target_label"], "left")
    declared = F.col("type").isin(*EDGE_TYPES)
    s, t = F.col("source_label"), F.col("target_label")
    messages = F.filter(
        F.array(
            F.when(~declared, F.concat("type", F.lit(" is not a declared edge type"))),
            F.when(declared & s.isNull(), F.lit("the source node does not exist")),
            F.when(declared & t.isNull(), F.lit("the target node does not exist")),
            F.when(declared & s.isNotNull() & t.isNotNull() & F.col("fine").isNull(), F.concat(s, F.lit(" -> "), t, F.lit(" is not admitted for "), "type")),
        ),
        lambda m: m.isNotNull(),
    )
    return _rows(rows.withColumn("message", F.explode(messages)), "RI-05", _fact(), F.col("message"))


def anchoring(snapshot: Graph, nodes: DataFrame, edges: DataFrame, layer: str) -> DataFrame:
    labels = _resolved(snapshot, nodes, "label", F.col("label"))
    parents = edges.filter("type = 'PART_OF'").join(labels.toDF("target", "parent"), "target").select(F.col("source").alias("key"), "parent").distinct()
    needed = F.create_map(*[F.lit(x) for pair in REQUIRED_PARENT.items() for x in pair])
    new = nodes.join(snapshot.nodes.select("key"), "key", "left_anti").withColumn("parent", needed[F.col("label")]).filter("parent IS NOT NULL")
    return _rows(new.join(parents, ["key", "parent"], "left_anti"), "RI-08", F.col("key"), F.concat(F.lit("new "), "label", F.lit(" has no PART_OF edge to a "), "parent"))


def locator_form(snapshot: Graph, nodes: DataFrame, edges: DataFrame, layer: str) -> DataFrame:
    bad = nodes.filter(F.col("locator").isNotNull() & ~locator_ok(F.col("locator")))
    return _rows(bad, "RI-10", F.col("key"), F.concat(F.lit("locator '"), "locator", F.lit("' is not an absolute http or https URI")))


def layer_boundary(snapshot: Graph, nodes: DataFrame, edges: DataFrame, layer: str) -> DataFrame:
    layers = _resolved(snapshot, nodes, "layer", F.lit(layer))
    rows = edges.join(layers.toDF("source", "from"), "source").join(layers.toDF("target", "to"), "target")
    return _rows(rows.filter((F.col("from") == "reference") & (F.col("to") == "institutional")), "RM-02", _fact(), F.lit("edge from a reference node to an institutional node"))


def cycles(snapshot: Graph, nodes: DataFrame, edges: DataFrame, layer: str) -> DataFrame:
    out = None
    for kind in ACYCLIC:
        both = snapshot.links(kind).select("source", "target").union(edges.filter(F.col("type") == kind).select("source", "target"))
        found = strongly_connected(both).groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"))
        rows = _rows(found, "RM-04", F.array_join("members", " -> "), F.concat(F.lit(f"{kind} cycle through "), F.size("members").cast("string"), F.lit(" node(s)")))
        out = rows if out is None else out.union(rows)
    return out


def locator_presence(snapshot: Graph, nodes: DataFrame, edges: DataFrame, layer: str) -> DataFrame:
    return _rows(nodes.filter("label = 'LearningResource' AND locator IS NULL"), "RM-05", F.col("key"), F.lit("learning resource without locator"))


CHECKS = {"RI-05": admitted, "RI-08": anchoring, "RI-10": locator_form, "RM-02": layer_boundary, "RM-04": cycles, "RM-05": locator_presence}


def validate(snapshot: Graph, nodes: DataFrame, edges: DataFrame, layer: str, rules: tuple[str, ...] = INGESTION_RULES) -> DataFrame:
    if layer not in LAYERS:
        raise ValueError(f"no layer {layer!r}")
    if unknown := [r for r in rules if r not in CHECKS]:
        raise ValueError(f"no rules {unknown}")
    out = None
    for ordinal, rule in enumerate(r for r in CHECKS if r in rules):
        rows = CHECKS[rule](snapshot, nodes, edges, layer).select(F.lit(ordinal).alias("ordinal"), "rule", "fact", "message")
        out = rows if out is None else out.unionByName(rows)
    return out
