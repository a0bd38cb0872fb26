"""Entity linking of extracted mentions, and the facts that a document's output becomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curralis.functions.text import normalize_label

#: What a language model returns for a document; read with from_json.
OUTPUT = (
    "topics array<struct<name: string, evidence: string, existing: string, knowledge_unit: string, concepts: array<struct<name: string, evidence: string, existing: string>>>>, "
    "required_concepts array<struct<name: string, existing: string, rationale: string>>, prerequisites array<struct<concept: string, prerequisite: string, rationale: string>>, "
    "specializations array<struct<concept: string, generalization: string, rationale: string>>"
)
REFERENCES = {"KnowledgeUnit": "K", "Topic": "T", "Concept": "C"}


def vocabulary(nodes: DataFrame) -> DataFrame:
    """(ref, key, label, name_es): stable references K-001, T-001, C-001 in the order of name and key within a class."""
    letter = F.create_map(*[F.lit(x) for pair in REFERENCES.items() for x in pair])
    rows = nodes.filter(F.col("label").isin(*REFERENCES))
    n = F.row_number().over(Window.partitionBy("label").orderBy(F.col("name_es").asc_nulls_last(), "key"))
    # at least three digits: numbers beyond 999 keep all of theirs
    number = F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))
    return rows.select(F.concat_ws("-", letter[F.col("label")], number).alias("ref"), "key", "label", "name_es")


def names(nodes: DataFrame) -> DataFrame:
    """(label, norm, key): the key that a normalised name stands for in its class: of several nodes with that name in any language the smallest key."""
    each = F.array(F.struct(F.lit(0).alias("rank"), F.col("name_es").alias("name")), F.struct(F.lit(1).alias("rank"), F.col("name_en").alias("name")))
    rows = nodes.select("label", "key", F.explode(each).alias("n")).filter("n.name IS NOT NULL").select("label", "key", "n.rank", normalize_label(F.col("n.name")).alias("norm")).filter("norm <> ''")
    return rows.groupBy("label", "norm").agg(F.min("key").alias("key"))


def link(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """mentions (label, name) with norm, key and minted: the existing node's key, or one derived from class and normalised name.

    A new name is minted once however often it is mentioned; the key is a name-based UUID, so that replays agree.
    """
    rows = mentions.withColumn("norm", normalize_label(F.col("name"))).join(names(nodes), ["label", "norm"], "left")
    fresh = uuid5(F.concat_ws("|", "label", "norm"))
    return rows.withColumn("minted", F.col("key").isNull()).withColumn("key", F.coalesce("key", fresh))


def uuid5(name: Column, space: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """Name-based UUID, version 5 (SHA-1 of the namespace's bytes and the name), without a UDF."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def resolve(mentions: DataFrame, vocab: DataFrame) -> DataFrame:
    """mentions (label, existing) with key and discard: EX-02 for an unknown reference, EX-03 for one of another class."""
    rows = mentions.join(vocab.select(F.col("ref").alias("existing"), "key", F.col("label").alias("found")), "existing", "left")
    discard = F.when(F.col("existing").isNotNull() & F.col("key").isNull(), "EX-02").when(F.col("found") != F.col("label"), "EX-03")
    return rows.withColumn("discard", discard)


def problems(outputs: DataFrame) -> DataFrame:
    """(doc, discard, fact) EX-01 of parsed outputs (doc, out): new topics without a unit, relation ends that name nothing."""
    topics = outputs.select("doc", F.explode("out.topics").alias("t"))
    unplaced = topics.filter("t.existing IS NULL AND t.knowledge_unit IS NULL").select("doc", F.lit("EX-01").alias("discard"), F.col("t.name").alias("fact"))
    known = topics.select("doc", F.explode("t.concepts").alias("c")).select("doc", F.explode(F.array("c.name", "c.existing")).alias("end"))
    known = known.union(outputs.select("doc", F.explode("out.required_concepts").alias("r")).select("doc", F.explode(F.array("r.name", "r.existing"))))
    pre = outputs.select("doc", F.explode("out.prerequisites").alias("p")).select("doc", F.explode(F.array("p.concept", "p.prerequisite")).alias("end"))
    spec = outputs.select("doc", F.explode("out.specializations").alias("s")).select("doc", F.explode(F.array("s.concept", "s.generalization")).alias("end"))
    ends = pre.union(spec).filter(~F.col("end").rlike("^[KTC]-[0-9]{3,}$"))
    lost = ends.join(known.filter("end IS NOT NULL").distinct(), ["doc", "end"], "left_anti").distinct()
    return unplaced.union(lost.select("doc", F.lit("EX-01").alias("discard"), F.col("end").alias("fact")))


def taught_in_headings(required: DataFrame, headings: DataFrame) -> DataFrame:
    """required (doc, name) with promoted: true where a segment of one of the document's headings (doc, heading) names the concept."""
    parts = headings.select("doc", F.explode(F.split("heading", r"(?i)[,;:]|\s(?:y|e|and)\s")).alias("part")).select("doc", normalize_label(F.col("part")).alias("norm")).distinct()
    rows = required.withColumn("norm", normalize_label(F.col("name")))
    return rows.join(parts.withColumn("promoted", F.lit(True)), ["doc", "norm"], "left").withColumn("promoted", F.coalesce("promoted", F.lit(False)))


def course_code(code: Column) -> Column:
    return F.upper(F.trim(code))


def locator(base: Column, key: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), key)


def prompt_digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)
