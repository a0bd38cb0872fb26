"""Linking of outputs, the operational store, and the comparison of runs, on small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from curralis.operators import assembly, evaluate, judging, linking, navigation, readings, runs
from curralis.operators.store import OperationalStore
from curralis.schema import EDGES, NODES, Graph


@pytest.fixture(scope="module")
def graph(spark):
    row = lambda key, label, es, en=None, layer="institutional": (key, label, layer, es, en, None, None, None)
    nodes = [row("u", "KnowledgeUnit", "Redes"), row("t", "Topic", "Grafos"), row("c1", "Concept", "Hilo", "Thread"), row("c2", "Concept", "Pila"), row("s", "LearningResource", "doc")]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([("PART_OF", "t", "u", "s"), ("PART_OF", "c1", "t", "s"), ("HAS_PREREQUISITE", "c1", "c2", "s")], EDGES))


def outputs(spark, unit="K-001", end="C-001"):
    concept = lambda name, existing=None: {"name": name, "evidence": "", "existing": existing}
    out = {
        "topics": [{"name": "Grafos", "evidence": "", "existing": "T-001", "knowledge_unit": None, "concepts": [concept("Arboles"), concept("Hilos")]},
                   {"name": "Colas y pilas", "evidence": "", "existing": None, "knowledge_unit": unit, "concepts": [concept("Cola"), concept("arbol")]}],
        "required_concepts": [{"name": "Pila", "existing": "C-002", "rationale": ""}, {"name": "Thread", "existing": None, "rationale": ""}, {"name": "Lista", "existing": None, "rationale": ""}],
        "prerequisites": [{"concept": "Cola", "prerequisite": "lista", "rationale": ""}, {"concept": "Hilos", "prerequisite": end, "rationale": ""}, {"concept": "Nada", "prerequisite": "Cola", "rationale": ""}],
        "specializations": [{"concept": "Arboles", "generalization": "C-002", "rationale": ""}],
    }
    return spark.createDataFrame([(1, out)], f"doc int, out struct<{linking.OUTPUT}>")


def test_outputs_become_facts(spark, graph):
    mint = lambda label, norm: F.concat_ws(":", label, norm)
    vocab = linking.vocabulary(graph.nodes)
    facts = assembly.link_outputs(*assembly.flat(outputs(spark)), graph.nodes, vocab, mint)
    edges = {tuple(r)[1:] for r in facts.edges.collect()}
    tree, queue, heap, lists = "Concept:arbol", "Concept:cola", "Topic:cola y pila", "Concept:lista"
    assert edges == {("PART_OF", heap, "u"), ("PART_OF", tree, "t"), ("PART_OF", "c1", "t"), ("PART_OF", queue, heap), ("PART_OF", tree, heap), ("PART_OF", "c2", heap), ("HAS_PREREQUISITE", queue, lists), ("SPECIALIZES", tree, "c2")}
    assert {r.key for r in facts.taught.collect()} == {tree, "c1", queue, "c2"} and {r.key for r in facts.required.collect()} == {lists}
    assert {(r.key, r.name, r.minted) for r in facts.nodes.collect()} == {("t", "Grafos", False), (heap, "Colas y pilas", True), (tree, "Arboles", True), ("c1", "Hilo", False), (queue, "Cola", True), ("c2", "Pila", False), (lists, "Lista", True)}
    declared = spark.createDataFrame([(1, "r1", "syllabus", " inf1 ", " Redes ")], "doc int, resource string, resource_type string, code string, course_name string")
    nodes, links = assembly.assemble(declared, facts, "https://x.org/")
    found = {r.label: r for r in nodes.filter("label IN ('Course', 'LearningResource', 'ResourceType')").collect()}
    assert (found["Course"].course_code, found["Course"].name, found["LearningResource"].locator, found["LearningResource"].name) == ("INF1", "Redes", "https://x.org/resources/r1", "syllabus INF1")
    kinds = {r.type: r.n for r in links.groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"HAS_RESOURCE_TYPE": 1, "IS_ABOUT": 3, "TEACHES_CONCEPT": 4, "REQUIRES_CONCEPT": 1, "PART_OF": 6, "HAS_PREREQUISITE": 1, "SPECIALIZES": 1}


@pytest.mark.parametrize("unit, end, code", [("K-009", "C-001", "EX-02"), ("T-001", "C-001", "EX-03"), ("K-001", "C-077", "EX-02"), ("K-001", "T-001", "EX-03")])
def test_discards_leave_no_facts(spark, graph, unit, end, code):
    facts = assembly.link_outputs(*assembly.flat(outputs(spark, unit, end)), graph.nodes, linking.vocabulary(graph.nodes))
    assert [r.discard for r in facts.discards.collect()] == [code] and facts.edges.isEmpty() and facts.nodes.isEmpty() and facts.taught.isEmpty()


def test_output_checks_headings_and_digests(spark):
    assert {(r.discard, r.fact) for r in linking.problems(outputs(spark, None)).collect()} == {("EX-01", "Colas y pilas"), ("EX-01", "Nada"), ("EX-01", "lista")}
    required = spark.createDataFrame([(1, "Pila"), (1, "Cola"), (1, "Pil")], "doc int, name string")
    promoted = linking.taught_in_headings(required, spark.createDataFrame([(1, "Colas Y pilas")], "doc int, heading string"))
    assert {r.name for r in promoted.filter("promoted").collect()} == {"Pila", "Cola"}
    assert spark.range(1).select(linking.prompt_digest(F.lit("abc"))).first()[0] == "ba7816bf8f01"


def test_store_keeps_runs_and_reports(spark, tmp_path):
    store = OperationalStore(spark, f"file://{tmp_path}/store")
    assert store.take() is None and not store.has_pending()
    pdf = spark.createDataFrame([("b.pdf", bytearray(b"%PDF-1.7")), ("a.PDF", bytearray(b"%PDF-1.4"))], "path string, content binary")
    assert store.submit(pdf, "syllabus", " x1 ", "Redes") == [1, 2] and store.get_run(1).fields == {"file": "a.PDF", "resource_type": "syllabus", "code": "X1", "name": "Redes"}
    for bad in (("book", "x", "y"), ("syllabus", " ", "y")):
        with pytest.raises(ValueError):
            store.submit(pdf, *bad)
    with pytest.raises(ValueError, match="PDF"):
        store.submit(spark.createDataFrame([("a.pdf", bytearray(b"GIF"))], "path string, content binary"), "syllabus", "x", "y")
    assert store.create_run(code="z") == 3 and store.withdraw(3) and [r.run_id for r in store.list_runs().collect()] == [1, 2]
    assert store.take() == 1 and not store.withdraw(1) and store.has_pending()
    store.record_extraction(1, {"topics": []}, model="m", input_tokens=7)
    store.mark_written(1)
    store.finish(1, clean=True)
    assert (store.get_run(1).state, store.get_run(1).fields["model"], store.model_output_of(1), store.model_output_of(2)) == ("completed", "m", {"topics": []}, None)
    assert store.take() == 2
    with pytest.raises(ValueError):
        store.reject(2, [])
    store.reject(2, [("EX-02", "f", "m"), ("EX-03", "g", "n")], batch={"nodes": []}, raw_output="raw")
    assert [tuple(r) for r in store.discards_of(2).collect()] == [("EX-02", "f", "m"), ("EX-03", "g", "n")] and store.rejected_output_of(2) == ({"nodes": []}, "raw")
    with pytest.raises(ValueError):
        store.fail(2, "late")
    with pytest.raises(KeyError):
        store.get_run(9)
    number = store.open_report("ingestion", 1)
    assert runs.gate(store.reports()).first()[0] == "closed: audit not completed"
    report = spark.createDataFrame([("RI-02", 1, ["x"]), ("RI-01", 0, [])], "rule string, violations long, sample array<string>")
    store.complete_report(number, report)
    with pytest.raises(ValueError):
        store.complete_report(number, report)
    assert runs.gate(store.reports()).first()[0] == "closed: violations" and [r.rule for r in store.report().collect()] == ["RI-01", "RI-02"]


def test_runs_that_are_judged(spark):
    table = spark.createDataFrame([(1, "a", "rejected"), (2, "a", "completed"), (3, "b", "failed"), (4, "b", "stopped_by_audit"), (9, "b", "completed")], "run_id long, syllabus string, state string")
    written = spark.createDataFrame([(2,), (4,), (9,)], "run_id long")
    assert sorted(tuple(r) for r in judging.attempts_in(table, written, 1, 5).collect()) == [(1, "a", False), (2, "a", True), (4, "b", True)]
    nodes = spark.createDataFrame([(2, "k"), (4, "k"), (4, "n")], "run_id long, key string")
    assert {tuple(r) for r in judging.created(nodes, spark.createDataFrame([(2, True), (4, True)], "run_id long, accepted boolean")).collect()} == {("k", 2), ("n", 4)}
    gold = spark.createDataFrame([("a", "e1", "G1", "tema", "obligatoria", "x", None), ("a", "e2", "G2", "tema", "obligatoria", "y", None), ("a", "e3", "G3", "tema", "aceptable", "z", None)], "syllabus string, entry_id string, global_id string, kind string, level string, label string, aliases array<string>")
    items = spark.createDataFrame([(2, "a", 0, "x"), (2, "a", 1, "w")], "run_id long, syllabus string, ordinal long, label string")
    false, missed = judging.misses(spark.createDataFrame([(2, "a", 0, "e1")], "run_id long, syllabus string, ordinal long, entry_id string"), items, gold)
    assert [r.label for r in false.collect()] == ["w"] and [(r.global_id, r.entry_id) for r in missed.collect()] == [("G2", "e2")]
    shares = judging.with_related(spark.createDataFrame([(3, 4, 2, 1), (0, 0, 0, 0)], "hits int, proposed int, related int, related_hits int")).collect()
    assert [r.precision_with_related for r in shares] == [4 / 6, None]
    left = runs.cut_before({"t": table}, 3)["t"]
    assert {r.run_id for r in left.collect()} == {1, 2}


def test_likeness_against_the_plain_formula(spark):
    import difflib

    names = ["arbol binario", "arboles", "binario arbol", "grafo", "grafo dirigido", "", "x"]
    pairs = [(a, b) for a in names for b in names if a < b]
    found = {(r.a, r.b): r.likeness for r in evaluate.likeness(spark.createDataFrame(pairs, "a string, b string")).collect()}
    for a, b in pairs:
        x, y = set(a.split()), set(b.split())
        assert found[a, b] == max(difflib.SequenceMatcher(None, a, b).ratio(), 0.9 * len(x & y) / max(1, len(x), len(y)))
    best = evaluate.closest(spark.createDataFrame(pairs, "a string, b string"), k=1).collect()
    assert all(r.likeness >= 0.5 and r.likeness == max(v for (a, _), v in found.items() if a == r.a) for r in best)


def test_small_readings(spark, graph):
    assert navigation.resource_exists(graph, "s") and not navigation.resource_exists(graph, "c1")
    second = spark.createDataFrame([("r", v, f"{v}{i}") for v in "ab" for i in range(9)] + [("r", "b", "a0")], "root string, via string, key string")
    far = readings.far_nodes(second, 5).collect()
    assert len(far) == 5 and sorted(r.via for r in far) == ["a", "a", "a", "b", "b"]
    assert {(r.key, r.lens) for r in readings.lenses(graph).collect()} >= {("c1", "kinds"), ("s", "neighborhood"), ("u", "contents")}
    assert [(r.root, r.role, r.key) for r in readings.kinds_of(Graph(graph.nodes, spark.createDataFrame([("SPECIALIZES", "c1", "c2", None)], EDGES))).orderBy("root").collect()] == [("c1", "general", "c2"), ("c2", "kind", "c1")]
    assert {r.place for r in readings.connections(graph).filter("key = 'c1'").collect()} == {1, 2}
