"""The engine on a small curriculum: every question, rule and write, against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from curralis.operators import audit, components, evaluate, linking, merge, navigation, readings, runs, validate
from curralis.operators.closure import bfs, recursive, unrolled
from curralis.schema import EDGES, NODES, Graph

LABELS = {"area": "KnowledgeArea", "unit1": "KnowledgeUnit", "unit2": "KnowledgeUnit", "topic1": "Topic", "topic2": "Topic", "z": "Course", "x": "Course", "standard": "LearningResource", "syllabus1": "LearningResource", "syllabus2": "LearningResource", "kind": "ResourceType", **{f"c{n}": "Concept" for n in range(1, 7)}}
REFERENCE = {"area", "unit1", "unit2", "standard", "kind"}
LINKS = [
    ("PART_OF", "unit1", "area"), ("PART_OF", "unit2", "area"), ("PART_OF", "topic1", "unit1"), ("PART_OF", "topic2", "unit2"),
    ("PART_OF", "c1", "topic1"), ("PART_OF", "c2", "topic1"), *[("PART_OF", f"c{n}", "topic2") for n in (3, 4, 5, 6)],
    ("HAS_PREREQUISITE", "c2", "c1"), ("HAS_PREREQUISITE", "c1", "c3"), ("HAS_PREREQUISITE", "c3", "c4"), ("HAS_PREREQUISITE", "c2", "c4"),
    ("SPECIALIZES", "c5", "c3"), ("SPECIALIZES", "c6", "c5"), ("TEACHES_CONCEPT", "z", "c1"), ("TEACHES_CONCEPT", "z", "c2"), ("REQUIRES_CONCEPT", "z", "c3"),
    ("TEACHES_CONCEPT", "x", "c3"), ("TEACHES_CONCEPT", "x", "c4"), ("IS_ABOUT", "syllabus1", "z"), ("IS_ABOUT", "syllabus1", "topic1"), ("IS_ABOUT", "syllabus1", "topic2"),
    *[("HAS_RESOURCE_TYPE", r, "kind") for r in ("syllabus1", "syllabus2")],
    *[("WAS_DERIVED_FROM", k, "standard") for k in ("area", "unit1", "unit2")], *[("WAS_DERIVED_FROM", k, "syllabus1") for k in ("topic1", "topic2", "z", "c1", "c2", "c3", "c5", "c6")], ("WAS_DERIVED_FROM", "c4", "syllabus2"), ("WAS_DERIVED_FROM", "x", "syllabus2"),
]


def build(spark, labels=LABELS, links=LINKS):
    nodes = [(k, v, "reference" if k in REFERENCE else "institutional", k, None, k.upper() if v == "Course" else None, f"https://example.org/{k}" if v == "LearningResource" else None, None) for k, v in labels.items()]
    provenance = lambda t, s, d: None if s in REFERENCE else "syllabus2" if (s, d) == ("c2", "c4") else "syllabus1"
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(t, s, d, provenance(t, s, d)) for t, s, d in links], EDGES))


@pytest.fixture(scope="module")
def graph(spark):
    g = build(spark)
    return Graph(g.nodes.cache(), g.edges.cache())


def start(spark, key):
    return spark.createDataFrame([(key,)], "root string")


def depths(df):
    return {r.key: r.depth for r in df.collect()}


def test_closure_strategies_agree(spark, graph):
    seeds, edges = navigation.roots(graph, None, "Concept"), graph.links("HAS_PREREQUISITE", "SPECIALIZES")
    results = [{tuple(r) for r in f(seeds, edges, 4).select("root", "node", "depth").collect()} for f in (bfs, recursive, unrolled)]
    assert results[0] == results[1] == results[2]


def test_closure_stops_at_its_bound_and_survives_cycles(spark):
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(13)] + [("n13", "n00")], "source string, target string")
    found = bfs(spark.createDataFrame([("n00", "n00")], "root string, node string"), chain, 10)
    assert found.agg(F.max("depth")).first()[0] == 10 and found.count() == 11


def test_prerequisites(spark, graph):
    assert depths(navigation.concept_prerequisites(graph, start(spark, "c2"))) == {"c2": 0, "c1": 1, "c4": 1, "c3": 2}
    assert navigation.concept_prerequisites(graph, start(spark, "topic1")).isEmpty()
    assert navigation.concept_prerequisites(graph, start(spark, "nothing")).isEmpty()


def test_courses_location_resources(spark, graph):
    found = navigation.course_prerequisites(graph, start(spark, "z"))
    assert {r.key for r in found.collect()} == {"z", "c1", "c2", "c3", "x"}
    nodes, edges = navigation.subgraph(graph, found, navigation.KEPT["course_prerequisites"])
    assert edges.filter("type <> 'WAS_DERIVED_FROM'").count() == 4
    assert {"syllabus1", "syllabus2"} <= {r.key for r in nodes.collect()}
    assert {r.key for r in navigation.element_location(graph, start(spark, "c1")).collect()} == {"c1", "topic1", "unit1", "area"}
    roles = {(r.key, r.role) for r in navigation.element_resources(graph, start(spark, "area")).collect()}
    assert roles == {("area", "element"), ("topic1", "covered"), ("topic2", "covered"), ("unit1", "between"), ("unit2", "between"), ("syllabus1", "resource"), ("kind", "type")}


@pytest.mark.parametrize(
    "key, grain, expected",
    [
        ("z", "course", {"z": 0, "c1": 0, "c2": 0, "c3": 1, "c4": 1, "x": 1}),
        ("topic1", "topic", {"topic1": 0, "c1": 0, "c2": 0, "c3": 1, "c4": 1, "topic2": 1}),
        ("unit1", "area", {"unit1": 0, "topic1": 0, "c1": 0, "c2": 0, "c3": 1, "c4": 1, "area": 1, "topic2": None, "unit2": None}),
        ("c3", "topic", {"c3": 0, "c4": 1, "topic2": 1}),
        ("area", "area", {"area": 0}),
    ],
)
def test_learning_paths(spark, graph, key, grain, expected):
    assert depths(navigation.learning_path(graph, grain, start(spark, key))) == expected


def test_specializations_overview_detail(spark, graph):
    assert depths(navigation.concept_specializations(graph, start(spark, "c5"))) == {"c5": 0, "c3": 1, "c6": 1}
    assert depths(navigation.concept_specializations(graph, start(spark, "c6"))) == {"c6": 0, "c5": 1, "c3": 2}
    row = navigation.overview(graph).filter("key = 'area'").first()
    assert (row.units, row.topics, row.concepts) == (2, 2, 6)
    crowd = build(spark, LABELS | {f"p{n}": "Concept" for n in range(30)}, LINKS + [("PART_OF", f"p{n}", "topic1") for n in range(30)])
    direct = navigation.node_neighbours(crowd, start(spark, "topic1"))
    assert direct.count() == 25 and direct.orderBy("rank").first().key == "unit1"
    assert navigation.node_detail(crowd, start(spark, "topic1")).filter("key = 'topic1'").first().more_neighbors


def shuffled(spark, frame):
    """Bytes that executors wrote to shuffles while the frame that frame() gives was made and read."""
    import time

    written = lambda: time.sleep(1) or spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    frame().write.format("noop").mode("overwrite").save()
    return written() - before


def star(spark, n):
    return build(spark, {"hub": "Topic"} | {f"p{i:05}": "Concept" for i in range(n)}, [("PART_OF", f"p{i:05}", "hub") for i in range(n)])


def test_neighbours_of_a_hub_are_not_met_by_each_other(spark):
    """The work grows with the edges, not with the square of a hub's; which neighbours are passed over is that of the root."""
    small, large = (star(spark, n) for n in (1000, 4000))
    for f in (lambda g: navigation.second_ring(g, navigation.node_neighbours(g)), navigation.node_detail):
        assert shuffled(spark, lambda: f(large)) < 7 * shuffled(spark, lambda: f(small))
    ring = {(r.via, r.key) for r in navigation.second_ring(small, navigation.node_neighbours(small, start(spark, "p00002"))).collect()}
    assert ring == {("hub", f"p{i:05}") for i in (0, 1, 3, 4, 5)}
    more = {(r.key, r.more_neighbors) for r in navigation.node_detail(small, start(spark, "p00002")).collect()}
    assert more == {("hub", True), *((f"p{i:05}", False) for i in range(6))}


def test_search(spark):
    g = build(spark, {"t1": "Topic", "t2": "Topic"}, [])
    g = Graph(g.nodes.withColumn("name_es", F.when(F.col("key") == "t1", "Árboles y grafos").otherwise("Programación orientada a objetos")), g.edges)
    asked = spark.createDataFrame([("arb",), ("orientada a OBJ",), ("grafos nada",), ("?!",)], "query string")
    assert {(r.query, r.key) for r in navigation.search(g, asked).collect()} == {("arb", "t1"), ("orientada a OBJ", "t2")}


def test_audit_of_a_clean_graph_and_of_injections(spark, graph):
    assert audit.is_clean(audit.report(audit.raw_of(graph.nodes, graph.edges)))
    more = graph.edges.unionByName(spark.createDataFrame([("PART_OF", "topic1", "c1", "s"), ("HAS_PREREQUISITE", "c4", "c2", "s"), ("SPECIALIZES", "c1", "c1", None), ("LIKES", "c1", "c2", "s"), ("PART_OF", "unit1", "standard", None), ("IS_ABOUT", "standard", "z", None)], EDGES))
    found = {r.rule: (r.violations, r.sample) for r in audit.report(audit.raw_of(graph.nodes, more)).collect()}
    assert found["RI-04"] == (1, ["(c1)-[:LIKES]->(c2)"]) and found["RI-05"][0] == 2 and found["RM-02"] == (1, ["(standard)-[:IS_ABOUT]->(z)"])
    assert found["RM-03"] == (1, ["(c1)-[:SPECIALIZES]->(c1) has no provenance"])
    assert found["RM-04"][1] == ["c1 is on a HAS_PREREQUISITE cycle", "c1 is on a SPECIALIZES cycle", "c2 is on a HAS_PREREQUISITE cycle", "c3 is on a HAS_PREREQUISITE cycle", "c4 is on a HAS_PREREQUISITE cycle"]
    assert found["RI-01"][0] == found["RI-07"][0] == 0


@pytest.mark.parametrize("one_task", [500_000, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("f", "f"), ("e", "g")], "source string, target string")
    assert {tuple(r) for r in components.strongly_connected(edges).collect()} == {("a", "b"), ("b", "b"), ("c", "e"), ("d", "e"), ("e", "e"), ("f", "f")}
    both = spark.createDataFrame([(5, 4), (4, 9), (2, 7)], "a long, b long")
    assert {tuple(r) for r in components.connected(both).collect()} == {(5, 4), (4, 4), (9, 4), (2, 2), (7, 2)}


@pytest.mark.parametrize("one_task", [500_000, 0])
def test_a_node_between_cycles_is_on_none(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "z"), ("z", "c"), ("c", "d"), ("d", "c"), ("z", "y"), ("y", "c")], "source string, target string")
    assert {tuple(r) for r in components.strongly_connected(edges).collect()} == {("a", "b"), ("b", "b"), ("c", "d"), ("d", "d")}


def test_validation_reports_everything(spark, graph):
    row = lambda key, label, locator=None: (key, label, "institutional", key, None, None, locator, None)
    nodes = spark.createDataFrame([row("n1", "Concept"), row("n2", "LearningResource"), row("n3", "LearningResource", "ftp://x"), row("n4", "Concept")], NODES)
    edges = spark.createDataFrame([("PART_OF", "n1", "topic1"), ("HAS_PREREQUISITE", "c4", "c2"), ("LIKES", "n1", "c1"), ("TEACHES_CONCEPT", "n1", "gone"), ("IS_ABOUT", "standard", "n1"), ("PART_OF", "n1", "unit1")], "type string, source string, target string")
    found = {(r.rule, r.fact) for r in validate.validate(graph, nodes, edges, "institutional").collect()}
    assert found == {("RI-05", "(n1)-[:LIKES]->(c1)"), ("RI-05", "(n1)-[:TEACHES_CONCEPT]->(gone)"), ("RI-05", "(n1)-[:PART_OF]->(unit1)"), ("RI-08", "n4"), ("RI-10", "n3"), ("RM-02", "(standard)-[:IS_ABOUT]->(n1)"), ("RM-04", "c1 -> c2 -> c3 -> c4"), ("RM-05", "n2")}
    assert {r[0] for r in validate.repeated(nodes.union(nodes.limit(1)), edges).collect()} == {"n1"}
    with pytest.raises(ValueError):
        validate.validate(graph, nodes, edges, "other")


def test_store_merges_once_and_fails_whole(spark, graph, tmp_path):
    store = merge.GraphStore(spark, f"file://{tmp_path}/store")
    store.reset()
    store.publish(graph)
    nodes = spark.createDataFrame([("n1", "Concept", "institutional", "n1", None, None, None, None), ("c1", "Concept", "institutional", "other name", None, None, None, None)], NODES)
    edges = spark.createDataFrame([("PART_OF", "n1", "topic1"), ("HAS_PREREQUISITE", "c2", "c1")], "type string, source string, target string")
    assert store.write_batch(nodes, edges, "institutional", "syllabus2") == (1, 2)
    assert store.write_batch(nodes, edges, "institutional", "syllabus1") == (0, 0)
    now = store.current()
    assert now.nodes.filter("key = 'c1'").first().name_es == "c1"
    assert now.edges.filter("source = 'n1' AND type = 'WAS_DERIVED_FROM'").first().target == "syllabus2"
    with pytest.raises(merge.WriteMismatch):
        store.write_batch(nodes, edges.union(spark.createDataFrame([("PART_OF", "n1", "gone")], edges.schema)), "institutional", "syllabus1")
    assert store.current().edges.count() == now.edges.count()
    with pytest.raises(ValueError):
        merge.merge(now, nodes, edges, "institutional")


def test_linking(spark):
    nodes = spark.createDataFrame([("k1", "Concept", "institutional", "Árboles binarios", None, None, None, None), ("k2", "Topic", "institutional", "Lista", None, None, None, None)], NODES)
    rows = {r.name: r for r in linking.link(spark.createDataFrame([("Concept", "árbol binario"), ("Concept", "Pila"), ("Concept", "pilas"), ("Topic", "Listas")], "label string, name string"), nodes).collect()}
    assert rows["árbol binario"].key == "k1" and rows["Listas"].key == "k2" and rows["Pila"].key == rows["pilas"].key and rows["Pila"].minted
    import uuid

    assert spark.range(1).select(linking.uuid5(F.lit("curso ñ"))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_OID.__class__("6ba7b811-9dad-11d1-80b4-00c04fd430c8"), "curso ñ"))
    vocab = linking.vocabulary(nodes)
    assert {tuple(r) for r in vocab.select("ref", "key").collect()} == {("C-001", "k1"), ("T-001", "k2")}
    got = {r.existing: r.discard for r in linking.resolve(spark.createDataFrame([("Concept", "C-001"), ("Concept", "T-001"), ("Topic", "T-009")], "label string, existing string"), vocab).collect()}
    assert got == {"C-001": None, "T-001": "EX-03", "T-009": "EX-02"}


def test_runs(spark):
    events = spark.createDataFrame([(1, 1, "pending"), (1, 2, "running"), (1, 3, "completed"), (2, 4, "pending"), (3, 5, "running"), (4, 6, "pending"), (4, 7, "completed")], "run_id long, ordinal long, state string")
    assert {(r.run_id, r.state) for r in runs.violations(events).collect()} == {(3, "running"), (4, "completed")}
    assert runs.oldest_pending(events).first()[0] == 2
    report = lambda *rows: runs.gate(spark.createDataFrame(list(rows), "report_id long, completed boolean, violations long")).first()[0]
    assert report() == "closed: no audit" and report((1, True, 0), (2, False, None)) == "closed: audit not completed" and report((1, True, 3)) == "closed: violations" and report((1, True, 0)) == "open"
    plan = runs.replay_plan(spark.createDataFrame([(1,), (9,)], "run_id long"), events)
    assert {tuple(r) for r in plan.collect()} == {(1, "write"), (9, "orphan")}


def test_evaluation(spark):
    gold = spark.createDataFrame([("s", "e1", "g1", "tema", "obligatoria", "Árboles", []), ("s", "e2", "g2", "concepto", "obligatoria", "Grafo", ["Red"]), ("s", "e3", "g3", "concepto", "aceptable", "Red", [])], "syllabus string, entry_id string, global_id string, kind string, level string, label string, aliases array<string>")
    items = spark.createDataFrame([(1, "s", 0, "n0", "árbol", "tema"), (1, "s", 1, "n1", "red", "concepto"), (1, "s", 2, "n2", "Redes", "concepto"), (1, "s", 3, "n3", "otra cosa", "tema")], "run_id long, syllabus string, ordinal long, node string, label string, kind string")
    assert {(r.ordinal, r.entry_id) for r in evaluate.greedy_match(items, gold).collect()} == {(0, "e1"), (1, "e3"), (2, "e2")}
    m = evaluate.measure(items, gold).first()
    assert (m.hits, m.proposed, m.recovered, m.mandatory, m.precision, m.recall) == (3, 4, 2, 2, 0.75, 1.0)
    pairs = spark.createDataFrame([("g", "a", "1"), ("g", "a", "2"), ("g", "b", "1"), ("h", "x", "1")], "group string, left string, right string")
    assert {tuple(r) for r in evaluate.maximum_hits(pairs).collect()} == {("g", 2), ("h", 1)}
    none = evaluate.with_ratios(spark.createDataFrame([(0, 0, 0, 0)], "hits long, proposed long, recovered long, mandatory long")).first()
    assert none.precision is None and none.f1 is None
    ids = evaluate.global_ids(spark.createDataFrame([(1, "Árboles", ["Tree"]), (2, "Pila", []), (3, "trees", ["x"])], "row_no long, label string, aliases array<string>"))
    assert {tuple(r) for r in ids.collect()} == {(1, "G-0001"), (2, "G-0002"), (3, "G-0001")}
    times = spark.createDataFrame([("p", n) for n in range(1, 101)], "pattern string, ms long")
    t = evaluate.latency_summary(times).first()
    assert (t.median_ms, t.p95_ms, t.max_ms, t.passes) == (50.5, 95, 100, True)


def test_greedy_matching_of_a_common_name(spark):
    """Equal to the plain procedure over all pairs, and a name that all share doesn't make every item meet every entry."""
    row = lambda i: ("s", f"e{i * 7 % 1000:04}", f"g{i % 3}", "tema" if i % 4 else "concepto", "obligatoria", ("one", "two", "three")[i % 5 % 3], ["shared"])
    schema = "syllabus string, entry_id string, global_id string, kind string, level string, label string, aliases array<string>"
    entries = [row(i) for i in range(120)]
    asked = [(i // 9, "s", i, "n", ("one", "shared", "two", "none")[i * 5 % 7 % 4], "tema" if i % 2 else "concepto") for i in range(90)]
    items = lambda rows: spark.createDataFrame(rows, "run_id long, syllabus string, ordinal long, node string, label string, kind string")
    called = {g: {n for e in entries if e[2] == g for n in (e[5], *e[6])} for g in ("g0", "g1", "g2")}
    expected, used = set(), set()
    for run, _, ordinal, _, label, kind in asked:
        free = [(e[5] != label, e[3] != kind, e[1]) for e in entries if label in called[e[2]] and (run, e[1]) not in used]
        if free:
            expected.add((run, ordinal, min(free)[2]))
            used.add((run, min(free)[2]))
    assert {(r.run_id, r.ordinal, r.entry_id) for r in evaluate.greedy_match(items(asked), spark.createDataFrame(entries, schema)).collect()} == expected
    many = [(i // 4, "s", i, "n", "shared", "tema") for i in range(3000)]
    gold = [("s", f"e{i:05}", f"g{i}", "tema", "obligatoria", "shared", []) for i in range(3000)]
    size = lambda n: shuffled(spark, lambda: evaluate.greedy_match(items(many[:n]), spark.createDataFrame(gold[:n], schema)))
    assert size(3000) < 7 * size(750)


def test_readings(spark, graph):
    order = {r.key: r.step for r in readings.learning_order(graph, start(spark, "area")).collect()}
    assert order == {"c4": 1, "c5": 1, "c6": 1, "c3": 2, "c1": 3, "c2": 4}
    assert [r.chain for r in readings.location_chains(graph, start(spark, "c1")).collect()] == ["area > unit1 > topic1"]
    assert [tuple(r) for r in readings.previous_courses(graph, start(spark, "z")).collect()] == [("z", "x", "c3")]
    via = {r.key: r.via for r in readings.prerequisites_by_depth(graph, navigation.concept_prerequisites(graph, start(spark, "c2"))).collect()}
    assert via == {"c1": "c2", "c4": "c2", "c3": "c1"}


def test_justified_stops_at_any_distance(spark):
    labels = {"k": "Course", "lone": "Concept", "other": "Concept", **{f"n{i}": "Concept" for i in range(14)}}
    links = [("TEACHES_CONCEPT", "k", "n0"), ("HAS_PREREQUISITE", "n0", "n13"), ("HAS_PREREQUISITE", "lone", "other"), *[("HAS_PREREQUISITE", f"n{i}", f"n{i + 1}") for i in range(12)]]
    near, front, expected = {"k": 0}, ["k"], {}
    while front:
        here = front.pop(0)
        for _, a, b in links:
            for x, y in ((a, b), (b, a)):
                if x == here and y not in near:
                    near[y] = near[here] + 1
                    front.append(y)
    for t, a, b in links:
        if t == "HAS_PREREQUISITE" and a in near:
            expected[b] = min(expected.get(b, 99), near[a] + 1)
    stops = spark.createDataFrame([("k", n) for n in labels if n != "k"], "root string, key string")
    found = {r.stop: r.hops for r in readings.justification(build(spark, labels, links), stops).collect()}
    assert found == expected and found["n12"] == 13 and "other" not in found


def test_justified_stops_through_hubs(spark, monkeypatch):
    """The same steps where the nodes of the chain count as hubs."""
    monkeypatch.setattr(readings, "HUB", 1)
    monkeypatch.setattr(readings, "MAX_HUBS", 4)
    test_justified_stops_at_any_distance(spark)


def test_greedy_matching_takes_every_part(spark, monkeypatch):
    from curralis import catalogue

    monkeypatch.setattr(evaluate, "greedy_match", lambda items, gold: items)
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    assert catalogue.QUERIES["greedy_matching"](spark, "/root/testdata/sf0.001").count() == parts.count()
