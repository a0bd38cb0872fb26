import pytest
from pyspark.sql import functions as F

from curralis.functions.text import fold, normalize_label, tokens
from curralis.operators.merge import GraphStore
from curralis.schema import EDGES, NODES, Graph
from curralis.sources import facts, turtle
from curralis.streaming import ingest

DOC = """@prefix : <http://x.org/#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix skos: <http://www.w3.org/2004/02/skos/core#> .
<http://x.org/> a owl:Ontology . # header
:a a owl:NamedIndividual , :Area ; skos:prefLabel "Área \\"uno\\""@es , "Area"@en ; :layer "reference" .
:u a owl:NamedIndividual , :Unit ; skos:prefLabel "Unidad"@es ; :layer "reference" ; :unitOf :a ; :partOf :a .
[] a owl:AllDifferent ; owl:distinctMembers ( :a :u ) .
"""
X, SKOS = "http://x.org/#", "http://www.w3.org/2004/02/skos/core#prefLabel"


def projected(spark, text):
    triples = spark.createDataFrame(turtle.parse(text), turtle.TRIPLES)
    return turtle.project(triples, {X + "Area": "KnowledgeArea", X + "Unit": "KnowledgeUnit"}, {X + "unitOf": "PART_OF", X + "partOf": "PART_OF"}, SKOS, {X + "layer": "layer"}, abstract=(X + "Element",), below=("KnowledgeUnit",), layer="reference")


def test_turtle_projection(spark):
    nodes, edges = projected(spark, DOC)
    assert [(r.key, r.label, r.name_es, r.name_en) for r in nodes.collect()] == [(X + "a", "KnowledgeArea", 'Área "uno"', "Area"), (X + "u", "KnowledgeUnit", "Unidad", None)]
    assert [tuple(r) for r in edges.collect()] == [("PART_OF", X + "u", X + "a")]


@pytest.mark.parametrize("more", [":u :other :a .", ':a skos:prefLabel "x"@fr .', ':u :layer "institutional" .', ":u a :Area .", ':a skos:prefLabel "otra"@es .', ":n a owl:NamedIndividual .", '<http://x.org/> :title "t" .', ":x owl:distinctMembers ( :a ) .", ":u a :Element . :t a :Area , :Element ."])
def test_turtle_rejects_what_it_does_not_know(spark, more):
    with pytest.raises(turtle.ProjectionError):
        projected(spark, DOC + more)


def test_text_functions(spark):
    cases = ["Árboles  Binarios", "C++ y C#", "c++11", "C#x", "Redes-de_datos", "HTTPS", "voces", "+a", "naïve’s node.js"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select(normalize_label(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["arbol binario", "c++ y c#", "c++11", "c x", "red de dato", "https", "voc", "a", "naiv nod j"]
    other = spark.createDataFrame([("が Ŵ 각 ﬀ 한글 Ặ Ⅷ ợ",)], "t string").select(fold(F.col("t"))).first()[0]
    import unicodedata

    assert other == "".join(c for c in unicodedata.normalize("NFD", "が ŵ 각 ﬀ 한글 ặ ⅷ ợ") if unicodedata.category(c) != "Mn")
    words = spark.createDataFrame([("O’Reilly's node.js 802.11 _x_ Ñandú",)], "t string").select(tokens(fold(F.col("t")))).first()[0]
    assert words == ["o'reilly's", "node.js", "802.11", "x", "nandu"]


def fact(spark, store, run, key, topic, more=()):
    nodes = spark.createDataFrame([(key, "Concept", {"prefLabelEs": key})], "key string, label string, properties map<string,string>")
    edges = spark.createDataFrame([("PART_OF", key, topic), *more], "type string, source string, target string")
    store.save(run, "institutional", "s", nodes, edges)


def test_facts_stream_and_replay(spark, tmp_path):
    store = facts.FactStore(spark, f"file://{tmp_path}/facts")
    fact(spark, store, 1, "c1", "t")
    fact(spark, store, 2, "c2", "nowhere")
    fact(spark, store, 3, "c3", "t", [("HAS_PREREQUISITE", "c3", "c1")])
    with pytest.raises(Exception, match="(?i)exists"):
        fact(spark, store, 1, "c1", "t")
    assert store.run_ids() == [1, 2, 3]
    row = lambda key, label, layer, locator=None: (key, label, layer, key, None, None, locator, None)
    nodes = [row("a", "KnowledgeArea", "reference"), row("u", "KnowledgeUnit", "reference"), row("t", "Topic", "reference"), row("s", "LearningResource", "institutional", "https://x.org/s")]
    base = Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([("PART_OF", "u", "a", None), ("PART_OF", "t", "u", None)], EDGES))
    graphs, seen = GraphStore(spark, f"file://{tmp_path}/graph"), []
    graphs.publish(base)
    query = ingest.start(spark, f"file://{tmp_path}/facts", f"file://{tmp_path}/offsets", graphs, lambda run, state, why: seen.append((run, state)))
    query.awaitTermination()
    assert sorted(s for s in seen if s[1] != "running") == [(1, "completed"), (2, "rejected"), (3, "completed")]
    assert {r.key for r in graphs.current().of("Concept").collect()} == {"c1", "c3"}
    events = spark.createDataFrame([(1, 1, "completed"), (3, 2, "stopped_by_audit")], "run_id long, ordinal long, state string")
    again = GraphStore(spark, f"file://{tmp_path}/again")
    again.publish(base)
    with pytest.raises(ValueError, match="orphan|without a run"):
        facts.reapply(store, events, again)


def test_gold(spark, tmp_path):
    lines = ["# silabo=x", "\t".join("id tipo nivel etiqueta alias tema_padre seccion evidencia nota".split()), "x-001\ttema\tobligatoria\tÁrboles\tTree| Trees\t\tsumilla\t\"e\t", "x-002\tconcepto\tcualquiera\tHoja\t\tx-009\tsumilla\te\t"]
    (tmp_path / "gold.tsv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    rows = facts.read_gold(spark, f"file://{tmp_path}/gold.tsv")
    assert [(r.id, r.aliases) for r in rows.orderBy("id").collect()] == [("x-001", ["Tree", "Trees"]), ("x-002", [])]
    assert {tuple(r) for r in facts.gold_problems(rows).collect()} == {("x-002", "level"), ("x-002", "parent")}
