"""From the outputs of many documents to their batches: mentions resolved to nodes, placements, what is taught and required, relations.

Every table has a column doc and holds all documents at once: topics (doc, t, name, existing, unit), concepts (doc, t, c, name,
existing), required (doc, r, name, existing) and relations (doc, kind, n, source, target). A document with any discard gives no facts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curralis.functions.text import normalize_label
from curralis.operators.linking import course_code, locator, names, resolve, uuid5

#: What a reference to the vocabulary looks like, and what parts a heading into the things it names.
REFERENCE = "^[KTC]-[0-9]{3,}$"
SEPARATOR = r"(?i)[,;:]|\s(?:y|e|and)\s"
Mint = Callable[[Column, Column], Column]


def flat(outputs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """topics, concepts, required and relations of parsed outputs (doc, out)."""
    topics = outputs.select("doc", F.posexplode("out.topics").alias("t", "x"))
    concepts = topics.select("doc", "t", F.posexplode("x.concepts").alias("c", "y")).select("doc", "t", "c", "y.name", "y.existing")
    required = outputs.select("doc", F.posexplode("out.required_concepts").alias("r", "y")).select("doc", "r", "y.name", "y.existing")
    relation = lambda field, kind, one, two: outputs.select("doc", F.lit(kind).alias("kind"), F.posexplode(f"out.{field}").alias("n", "y")).select("doc", "kind", "n", F.col(f"y.{one}").alias("source"), F.col(f"y.{two}").alias("target"))
    relations = relation("prerequisites", "HAS_PREREQUISITE", "concept", "prerequisite").unionByName(relation("specializations", "SPECIALIZES", "concept", "generalization"))
    return topics.select("doc", "t", "x.name", "x.existing", F.col("x.knowledge_unit").alias("unit")), concepts, required, relations


@dataclass
class Facts:
    """nodes (doc, key, label, name, minted), edges (doc, type, source, target), taught and required (doc, key), discards (doc, discard, place)."""

    nodes: DataFrame
    edges: DataFrame
    taught: DataFrame
    required: DataFrame
    discards: DataFrame


def _keyed(mentions: DataFrame, label: str, nodes: DataFrame, vocab: DataFrame, mint: Mint) -> DataFrame:
    """mentions (..., name, existing) with norm, key, minted and discard: by reference, else by name, else a new node."""
    rows = resolve(mentions.withColumn("label", F.lit(label)).withColumn("norm", normalize_label(F.col("name"))), vocab).drop("found")
    known = names(nodes).filter(F.col("label") == label).select("norm", F.col("key").alias("named"))
    rows = rows.join(known, "norm", "left")
    new = F.col("existing").isNull() & F.col("named").isNull()
    key = F.when(F.col("existing").isNotNull(), F.when(F.col("discard").isNull(), F.col("key"))).when(new, mint(F.lit(label), F.col("norm"))).otherwise(F.col("named"))
    return rows.withColumn("key", key).withColumn("minted", new).drop("named")


def minted(label: Column, norm: Column) -> Column:
    return uuid5(F.concat_ws("|", label, norm))


def link_outputs(topics: DataFrame, concepts: DataFrame, required: DataFrame, relations: DataFrame, nodes: DataFrame, vocab: DataFrame, mint: Mint = minted) -> Facts:
    topics = _keyed(topics, "Topic", nodes, vocab, mint)
    concepts = _keyed(concepts, "Concept", nodes, vocab, mint)
    required = _keyed(required, "Concept", nodes, vocab, mint)

    # a topic that exists keeps its unit; that of a new one must be a unit of the vocabulary
    units = resolve(topics.filter("minted AND unit IS NOT NULL").select("doc", "name", F.col("key").alias("topic"), F.col("unit").alias("existing"), F.lit("KnowledgeUnit").alias("label")), vocab)
    part_of = lambda df, source, target: df.select("doc", F.lit("PART_OF").alias("type"), F.col(source).alias("source"), F.col(target).alias("target"))
    edges = part_of(units.filter("discard IS NULL"), "topic", "key")
    placed = concepts.join(topics.select("doc", "t", F.col("key").alias("topic")), ["doc", "t"])
    edges = edges.unionByName(part_of(placed, "key", "topic"))
    taught = placed.select("doc", "key")

    # what a heading of the document names, the course teaches, though it was given as required
    segments = topics.select("doc", F.col("key").alias("topic"), F.explode(F.split("name", SEPARATOR)).alias("s")).select("doc", "topic", normalize_label(F.col("s")).alias("norm")).filter("norm <> ''").distinct()
    stored = nodes.select("key", F.explode(F.array("name_es", "name_en")).alias("n")).filter("n IS NOT NULL").select("key", normalize_label(F.col("n")).alias("norm"))
    called = required.select("doc", "key", "norm").union(required.select("doc", "key").join(stored, "key").select("doc", "key", "norm")).distinct()
    hosts = called.join(segments, ["doc", "norm"]).select("doc", "key", "topic").distinct()
    edges = edges.unionByName(part_of(hosts, "key", "topic"))
    taught = taught.union(hosts.select("doc", "key")).distinct()
    needed = required.select("doc", "key").distinct().join(taught, ["doc", "key"], "left_anti")

    # an end is a reference, or a name that the output mentions; the first mention of a name counts
    order = lambda *at: F.struct(*[F.col(c).cast("long") if c else F.lit(0).cast("long") for c in at])
    first = concepts.select("doc", "norm", "key", F.struct(F.lit(0).alias("part"), order("t", "c").alias("at")).alias("o")).union(required.select("doc", "norm", "key", F.struct(F.lit(1).alias("part"), order("r", None).alias("at")).alias("o")))
    first = first.filter("key IS NOT NULL").groupBy("doc", "norm").agg(F.min_by("key", "o").alias("by_name"))

    def ended(rows, side):
        is_ref = F.col(side).rlike(REFERENCE)
        rows = rows.withColumn("existing", F.when(is_ref, F.col(side))).withColumn("norm", F.when(~is_ref, normalize_label(F.col(side)))).withColumn("label", F.lit("Concept"))
        rows = resolve(rows, vocab).join(first, ["doc", "norm"], "left")
        key = F.when(F.col("existing").isNotNull(), F.when(F.col("discard").isNull(), F.col("key"))).otherwise(F.col("by_name"))
        return rows.withColumn(f"{side}_key", key).withColumn(f"{side}_lost", F.col("discard")).drop("existing", "norm", "label", "key", "found", "discard", "by_name")

    sides = ended(ended(relations.select("doc", "kind", "source", "target"), "source"), "target")
    related = sides.select("doc", "kind", F.col("source_key").alias("source"), F.col("target_key").alias("target")).filter("source IS NOT NULL AND target IS NOT NULL AND source <> target")
    edges = edges.unionByName(related.select("doc", F.col("kind").alias("type"), "source", "target")).distinct()

    lost = [topics.select("doc", "discard", F.concat(F.lit("topic "), "name").alias("place")), units.select("doc", "discard", F.concat(F.lit("unit of "), "name").alias("place")), concepts.select("doc", "discard", F.concat(F.lit("concept "), "name").alias("place")),
            required.select("doc", "discard", F.concat(F.lit("required concept "), "name").alias("place")), *[sides.select("doc", F.col(f"{c}_lost").alias("discard"), F.concat(F.lit("relation end "), c).alias("place")) for c in ("source", "target")]]
    discards = lost[0]
    for more in lost[1:]:
        discards = discards.unionByName(more)
    discards = discards.filter("discard IS NOT NULL").distinct()

    every = topics.select("doc", "key", "label", "name", "minted").unionByName(concepts.select("doc", "key", "label", "name", "minted")).unionByName(required.select("doc", "key", "label", "name", "minted")).filter("key IS NOT NULL")
    found = every.groupBy("doc", "key", "label").agg(F.min(F.trim("name")).alias("mention"), F.min("minted").alias("minted"))
    found = found.join(nodes.select("key", "name_es"), "key", "left").select("doc", "key", "label", F.coalesce("name_es", "mention").alias("name"), "minted")
    bad = discards.select("doc").distinct()
    kept = lambda df: df.join(bad, "doc", "left_anti")
    return Facts(kept(found), kept(edges), kept(taught), kept(needed), discards)


def assemble(declared: DataFrame, facts: Facts, base_url: str) -> tuple[DataFrame, DataFrame]:
    """nodes (doc, key, label, name, course_code, locator) and edges (doc, type, source, target) of the batches of declared documents.

    declared: (doc, resource, resource_type, code, course_name); the keys of courses and resource types are derived from their names.
    Repeated edges are merged. Documents that were discarded have no batch.
    """
    d = declared.join(facts.discards.select("doc").distinct(), "doc", "left_anti")
    d = d.withColumn("code", course_code(F.col("code"))).withColumn("course", uuid5(F.concat(F.lit("course/"), F.col("code")))).withColumn("kind", uuid5(F.concat(F.lit("resource-type/"), "resource_type")))
    none = F.lit(None).cast("string")
    node = lambda key, label, name, code=none, at=none: d.select("doc", F.col(key).alias("key"), F.lit(label).alias("label"), name.alias("name"), code.alias("course_code"), at.alias("locator"))
    nodes = node("resource", "LearningResource", F.concat_ws(" ", "resource_type", "code"), at=locator(F.lit(base_url.rstrip("/") + "/resources"), F.col("resource")))
    nodes = nodes.unionByName(node("course", "Course", F.trim("course_name"), F.col("code"))).unionByName(node("kind", "ResourceType", F.col("resource_type")))
    nodes = nodes.unionByName(facts.nodes.select("doc", "key", "label", "name", none.alias("course_code"), none.alias("locator")))
    edge = lambda rows, type_, source, target: rows.select("doc", F.lit(type_).alias("type"), F.col(source).alias("source"), F.col(target).alias("target"))
    edges = edge(d, "HAS_RESOURCE_TYPE", "resource", "kind").unionByName(edge(d, "IS_ABOUT", "resource", "course"))
    edges = edges.unionByName(edge(facts.nodes.filter("label = 'Topic'").join(d.select("doc", "resource"), "doc"), "IS_ABOUT", "resource", "key"))
    edges = edges.unionByName(edge(facts.taught.join(d.select("doc", "course"), "doc"), "TEACHES_CONCEPT", "course", "key")).unionByName(edge(facts.required.join(d.select("doc", "course"), "doc"), "REQUIRES_CONCEPT", "course", "key"))
    return nodes, edges.unionByName(facts.edges.join(d.select("doc"), "doc", "left_semi")).distinct()


def vocabulary_lines(vocab: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): placements and relations among the elements of a vocabulary (ref, key), by reference."""
    verbs = F.create_map(*[F.lit(x) for pair in (("PART_OF", " part of "), ("HAS_PREREQUISITE", " requires "), ("SPECIALIZES", " is a kind of ")) for x in pair])
    rows = edges.withColumn("verb", verbs[F.col("type")]).filter("verb IS NOT NULL")
    ends = lambda c: vocab.select(F.col("key").alias(c), F.col("ref").alias(f"{c}_ref"))
    return rows.join(ends("source"), "source").join(ends("target"), "target").select(F.concat("source_ref", "verb", "target_ref").alias("line")).distinct()
