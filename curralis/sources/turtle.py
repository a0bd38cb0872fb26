"""Reads the subset of Turtle that ontologies of this kind use, and projects named individuals to the property graph.

The documents are small (an ontology is read by one task); the projection itself is DataFrame operations.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curralis.plans.lineage import settled
from curralis.schema import LEVELS

TRIPLES = "s string, p string, o string, kind string, lang string, datatype string"
RDF, RDFS, OWL, XSD = ("http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#")
#: What an ontology's header may state beside its type.
HEADER = (OWL + "imports", RDFS + "comment")
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\")|(?P<str>"(?:[^"\\\n]|\\.)*")|(?P<dir>@prefix|@base)|(?P<lang>@[A-Za-z][A-Za-z0-9-]*)|(?P<caret>\^\^)"""
    r"""|(?P<num>[+-]?(?:\d+\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<blank>_:[\w-]+)|(?P<name>(?:[\w-]+(?:\.[\w-]+)*)?:(?:[\w%-]+(?:\.[\w%-]+)*)?)|(?P<word>a\b|true\b|false\b)|(?P<mark>[.;,\[\]()])""",
    re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


class TurtleError(ValueError):
    pass


def parse(text: str) -> list[tuple]:
    """Triples (s, p, o, kind, lang, datatype) of a document; kind is iri, blank or literal."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TurtleError(f"can't read {text[at : at + 30]!r}")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup, m.group()))
    out, prefixes, base, made, pos = [], {}, "", 0, 0

    def take(mark=None):
        nonlocal pos
        if pos >= len(tokens) or mark and tokens[pos][1] != mark:
            raise TurtleError(f"expected {mark or 'more'} near token {pos}")
        pos += 1
        return tokens[pos - 1]

    def fresh():
        nonlocal made
        made += 1
        return (f"_:b{made}", "blank", None, None)

    def iri(kind, value):
        if kind == "iri":
            return value[1:-1] if ":" in value else base + value[1:-1]
        prefix, _, local = value.partition(":")
        if prefix not in prefixes:
            raise TurtleError(f"no prefix {prefix!r}")
        return prefixes[prefix] + local

    def term():
        kind, value = take()
        if kind in ("iri", "name"):
            return iri(kind, value), "iri", None, None
        if kind == "blank":
            return value, "blank", None, None
        if kind in ("str", "long"):
            body = value[3:-3] if kind == "long" else value[1:-1]
            body = re.sub(r"\\(?:u([0-9A-Fa-f]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPES.get(m[2], m[2]), body)
            if pos < len(tokens) and tokens[pos][0] == "lang":
                return body, "literal", take()[1][1:].lower(), None
            if pos < len(tokens) and tokens[pos][0] == "caret":
                take()
                return body, "literal", None, iri(*take())
            return body, "literal", None, XSD + "string"
        if kind == "num":
            return value, "literal", None, XSD + ("integer" if re.fullmatch(r"[+-]?\d+", value) else "decimal")
        if value in ("true", "false"):
            return value, "literal", None, XSD + "boolean"
        if value == "[":
            node = fresh()
            if tokens[pos][1] != "]":
                pairs(node[0])
            take("]")
            return node
        if value == "(":
            items = []
            while tokens[pos][1] != ")":
                items.append(term())
            take(")")
            head = (RDF + "nil", "iri", None, None)
            for item in reversed(items):
                cell = fresh()
                out.append((cell[0], RDF + "first", *item))
                out.append((cell[0], RDF + "rest", *head))
                head = cell
            return head
        raise TurtleError(f"no term: {value!r}")

    def pairs(subject):
        while True:
            kind, value = take()
            predicate = RDF + "type" if value == "a" else iri(kind, value)
            while True:
                out.append((subject, predicate, *term()))
                if tokens[pos][1] != ",":
                    break
                take()
            if tokens[pos][1] != ";":
                return
            while tokens[pos][1] == ";":
                take()
            if tokens[pos][1] in (".", "]"):
                return

    while pos < len(tokens):
        if tokens[pos][0] == "dir":
            directive = take()[1]
            if directive == "@base":
                base = take()[1][1:-1]
            else:
                name = take()[1]
                prefixes[name[:-1]] = take()[1][1:-1]
            take(".")
            continue
        subject = term()
        if tokens[pos][1] != ".":
            pairs(subject[0])
        take(".")
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Triples (TRIPLES) of the documents at path, each read whole, through Spark's own readers."""
    return triples_of(spark.read.text(path, wholetext=True))


def triples_of(documents: DataFrame) -> DataFrame:
    """Triples (TRIPLES) of Turtle documents, one in each row's first column; blank nodes are told apart by their document."""

    def task(batches):
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                mark = f"_:{zlib.crc32((text or '').encode()):08x}-"
                own = lambda x: mark + x[2:] if isinstance(x, str) and x.startswith("_:") else x  # noqa: B023, E731
                rows += [(own(t[0]), t[1], own(t[2]) if t[3] == "blank" else t[2], *t[3:]) for t in parse(text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(6)], names=[c.split()[0] for c in TRIPLES.split(", ")])

    return documents.select(F.col(documents.columns[0])).mapInArrow(task, TRIPLES)


def uncovered(triples: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """Triples whose predicate and, for rdf:type, object aren't in the allow-list (predicate, object or '*'); in a fixed order."""
    rows = triples.sparkSession.createDataFrame(allowed, "p string, what string")
    what = F.when(F.col("p") == RDF + "type", F.col("o")).otherwise(F.lit("*"))
    return triples.withColumn("what", what).join(F.broadcast(rows), ["p", "what"], "left_anti").drop("what").orderBy("s", "p", "o")


class ProjectionError(ValueError):
    """Constructs that the projection doesn't know; all of them are named."""


def _list_cells(triples: DataFrame, heads: DataFrame) -> DataFrame:
    """(s) of the list cells that can be reached from heads (s), in steps that double."""
    cells = triples.filter(F.col("p").isin(RDF + "first", RDF + "rest")).select("s").distinct()
    found = heads.join(cells, "s", "left_semi").distinct()
    hop = triples.filter((F.col("p") == RDF + "rest") & (F.col("o") != RDF + "nil")).select("s", "o").distinct()
    for _ in range(cells.count().bit_length()):
        found = settled(found.union(found.join(hop, "s").select(F.col("o").alias("s"))).distinct())
        hop = settled(hop.join(hop.toDF("o", "far"), "o").select("s", F.col("far").alias("o")).distinct())
    return found


def project(triples: DataFrame, classes: dict[str, str], edges: dict[str, str], labels: str, data: dict[str, str], abstract: tuple[str, ...] = (), below: tuple[str, ...] = LEVELS, ignored: tuple[str, ...] = (), layer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (key, label, layer, name_es, name_en, description, locator) and edges (type, source, target) of the named individuals.

    classes: class IRI to label; edges: property IRI to edge type (several may share one); labels: the property whose
    language tags es and en become columns; data: property IRI to column, among them layer; abstract: classes that only those of the labels
    in below may carry beside their own. Headers and AllDifferent axioms with their lists are consumed; whatever else isn't covered,
    inside of them too, raises ProjectionError.
    """
    is_a = lambda *kinds: (F.col("p") == RDF + "type") & F.col("o").isin(*kinds)
    named = triples.filter(is_a(OWL + "NamedIndividual", *classes, *abstract)).select("s").distinct()
    header = triples.filter(is_a(OWL + "Ontology")).select("s").distinct()
    different = triples.filter(is_a(OWL + "AllDifferent")).select("s").distinct()
    cells = _list_cells(triples, triples.join(different, "s", "left_semi").filter(F.col("p") == OWL + "distinctMembers").select(F.col("o").alias("s")))
    # headers and axioms are consumed, and hold nothing else
    lost = triples.join(header, "s", "left_semi").filter(~(is_a(OWL + "Ontology") | F.col("p").isin(*HEADER)))
    lost = lost.union(triples.join(different.union(cells).distinct(), "s", "left_semi").filter(~(is_a(OWL + "AllDifferent") | F.col("p").isin(OWL + "distinctMembers", RDF + "first", RDF + "rest"))))
    own = triples.join(header.union(different).union(cells).distinct(), "s", "left_anti")
    lost = lost.union(own.join(named, "s", "left_anti"))
    own = own.join(named, "s", "left_semi")
    marked = own.filter(is_a(*abstract)).select("s").distinct() if abstract else None
    own = own.filter(~is_a(OWL + "NamedIndividual", *abstract))
    known = [RDF + "type", labels, *edges, *data, *ignored]
    bad = lost.union(own.filter(~F.col("p").isin(*known))).union(own.filter((F.col("p") == RDF + "type") & ~F.col("o").isin(*classes))).union(own.filter((F.col("p") == labels) & ~F.coalesce(F.col("lang").isin("es", "en"), F.lit(False))))
    messages = bad.select(F.concat_ws(" ", "s", "p", "o").alias("m"))
    kinds = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    typed = own.filter(F.col("p") == RDF + "type").groupBy("s").agg(F.array_sort(F.collect_set(kinds[F.col("o")])).alias("labels"))
    several = named.join(typed, "s", "left").filter(F.coalesce(F.size("labels"), F.lit(0)) != 1)
    twice = own.filter(F.col("p").isin(labels, *data)).groupBy("s", "p", "lang").count().filter("count > 1")
    messages = messages.union(several.select(F.concat_ws(" ", "s", F.lit("needs one class, has"), F.array_join(F.coalesce("labels", F.array().cast("array<string>")), " ")))).union(twice.select(F.concat_ws(" ", "s", "p", F.lit("has several values"))))
    if marked is not None:
        wrong = marked.join(typed, "s").filter((F.size("labels") == 1) & ~F.col("labels")[0].isin(*below))
        messages = messages.union(wrong.select(F.concat_ws(" ", "s", F.lit("is no element, but a"), F.col("labels")[0])))
    if layer is not None:
        at = [p for p, c in data.items() if c == "layer"]
        messages = messages.union(own.filter(F.col("p").isin(*at) & (F.col("o") != layer)).select(F.concat_ws(" ", "s", F.lit("is of the layer"), "o")))
    if found := [r[0] for r in messages.orderBy("m").collect()]:  # of one ontology
        raise ProjectionError("\n".join(found))
    pick = lambda test: F.max(F.when(test, F.col("o")))
    columns = [pick((F.col("p") == labels) & (F.col("lang") == "es")).alias("name_es"), pick((F.col("p") == labels) & (F.col("lang") == "en")).alias("name_en")]
    columns += [pick(F.col("p").isin(*[p for p, c in data.items() if c == name])).alias(name) for name in ("layer", "description", "locator")]
    nodes = own.groupBy("s").agg(*columns).join(typed, "s").select(F.col("s").alias("key"), F.col("labels")[0].alias("label"), "layer", "name_es", "name_en", "description", "locator").orderBy("key")
    kind = F.create_map(*[F.lit(x) for pair in edges.items() for x in pair])
    links = own.filter(F.col("p").isin(*edges)).select(kind[F.col("p")].alias("type"), F.col("s").alias("source"), F.col("o").alias("target")).distinct().orderBy("type", "source", "target")
    return nodes, links
