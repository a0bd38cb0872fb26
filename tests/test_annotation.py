"""The annotation's consolidation, texts converted once, rehearsal, warnings and measuring, on small cases."""

import pytest
from pyspark.sql import functions as F

from curralis.operators import annotation, evaluate, judging, readings, rehearsal
from curralis.operators.store import OperationalStore
from curralis.plans import measure
from curralis.schema import EDGES, NODES, Graph
from curralis.sources.cache import DigestCache


def column(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]


def test_loose_names_and_singulars(spark):
    assert column(spark, annotation.loose_name, ["Árboles_B (los)", "C#", "C++", "HTTPS", "", "s ss", "Gestión de los datos", None]) == ["arbole b lo", "c", "c", "http", "", "s", "gestion de lo dato", None]
    words = ["raíces", "RAÍCES", "ces", "funciones", "FUNCIONES", "razones", "ones", "árboles", "redes", "datos", "clases", "tesis", "proceso", "class", "bus", "MENÚS"]
    assert column(spark, annotation.singular_word, words) == ["raíz", "RAÍZ", "ces", "función", "FUNCIÓN", "razón", "on", "árbol", "red", "dato", "clase", "tesi", "proceso", "class", "bus", "MENÚ"]
    heads = ["Tipos de datos", "Árboles binarios", "Redes (LANs)", "  Modelos   de redes ", "de tipos", "Clases: tipos", ""]
    assert column(spark, annotation.singular_head, heads) == ["Tipo de datos", "Árbol binario", "Red (LANs)", "Modelo de redes", "de tipos", "Clases: tipos", ""]


def test_notions_under_rulings(spark):
    rows = [(1, "Pila", ["Stack"]), (2, "Pilas y colas", ["Pila", "Cola"]), (3, "Colas", None), (4, "stacks", []), (5, "C", None), (6, "C++", None), (7, "Grafo", None), (8, "Red", None)]
    entries = spark.createDataFrame(rows, "row_no long, label string, aliases array<string>")
    of = lambda *rulings: [r.global_id[-1] for r in annotation.ruled_ids(entries, *rulings).orderBy("row_no").collect()]
    assert of() == ["1", "1", "1", "1", "2", "2", "3", "4"]
    compound = spark.createDataFrame([(2,)], "row_no long")
    assert of(compound) == ["1", "2", "3", "1", "4", "4", "5", "6"]
    apart = spark.createDataFrame([(6, "c"), (6, "other")], "row_no long, name string")
    joined = spark.createDataFrame([(8, 7)], "a long, b long")
    assert of(compound, apart, joined) == ["1", "2", "3", "1", "4", "5", "6", "6"]
    assert annotation.ruled_ids(entries.limit(0)).isEmpty()


def test_numbers_follow_the_first_row_over_many_parts(spark):
    found = spark.range(25000).select(F.col("id").alias("node"), (F.col("id") - F.col("id") % 2).alias("component"))
    got = annotation.numbered(found).selectExpr("row_no", "cast(substr(global_id, 3) as long) AS n")
    assert got.filter("n <> floor(row_no / 2) + 1").isEmpty() and got.count() == 25000


def test_format_of_annotation_lines(spark):
    line = lambda *cells: "\t".join(cells)
    lines = [
        line("1", "tema", "obligatoria", "x", "", "", "sumilla", "e", ""), line("2", "concepto", "aceptable", "x", "", "1", "otra", "e", ""), line("3", "cosa", "nada", "x", "", "9", "y", "e", 'a ""b""'),
        line("4", "concepto", "obligatoria", "x", "", "", "otra", "e", ""), line("5", "tema", "obligatoria", "x", "", "2", "otra", "e", ""), line("6", "tema"), "",
    ]
    found = annotation.format_problems(spark.createDataFrame([("f", x) for x in lines] + [("g", lines[1])], "file string, line string"))
    assert {tuple(r) for r in found.collect()} == {
        ("f", "3", "tipo=cosa"), ("f", "3", "nivel=nada"), ("f", "3", "seccion=y"), ("f", "3", "quoted note"), ("f", "3", "no such parent"), ("f", "4", "concept without parent or note"),
        ("f", "5", "topic with a parent"), ("f", "5", "parent is no topic"), ("f", "6", "fields=2"), ("f", "", "fields=1"), ("g", "2", "no such parent"),
    }
    assert annotation.header_ok("\t".join(annotation.FIELDS) + "\n") and not annotation.header_ok("id\ttipo")


def test_contents_are_converted_once(spark, tmp_path):
    cache, seen = DigestCache(spark, f"file://{tmp_path}/texts"), []

    def convert(new):
        seen.append(new.count())
        return new.select("digest", F.upper(F.col("content").cast("string")).alias("text"))

    docs = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"a")), (3, bytearray(b"b")), (4, None)], "id int, content binary")
    texts = lambda df: {r.id: r.text for r in cache.texts(df, convert).collect()}
    assert texts(docs.filter("id < 3")) == {1: "A", 2: "A"} and texts(docs) == {1: "A", 2: "A", 3: "B", 4: None} and texts(docs)[3] == "B"
    assert seen == [1, 1, 0] and cache.stored().count() == 2


def test_rehearsal_walks_pending_runs_behind_an_open_gate(spark, tmp_path):
    real, trial = OperationalStore(spark, f"file://{tmp_path}/real"), OperationalStore(spark, f"file://{tmp_path}/trial")
    for code in ("a", "b"):
        real.create_run(code=code)
    assert rehearsal.seed(real, trial) and not rehearsal.seed(real, trial)
    assert rehearsal.rehearse(trial) == []
    trial.complete_report(trial.open_report("load"), spark.createDataFrame([("RI-01", 0, [])], "rule string, violations long, sample array<string>"))
    pauses = []
    assert rehearsal.rehearse(trial, lambda: pauses.append(1)) == [1, 2] and len(pauses) == 4
    assert (trial.get_run(1).state, trial.get_run(1).fields["model"]) == ("completed", rehearsal.MODEL) and real.get_run(1).state == "pending"


def test_warnings_and_verdict(spark):
    runs = spark.createDataFrame([(n, "a", False) for n in (1, 2, 3)] + [(4, "a", True), (5, "a", False), (6, "x", True), (7, "x", False), (8, "b", False)], "run_id long, syllabus string, accepted boolean")
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "syllabus string")
    assert {tuple(r) for r in judging.warnings(runs, cases).collect()} == {("attempts", 4, "a"), ("late", 5, "a"), ("no test case", 6, "x"), ("not run", None, "c")}
    scored = spark.createDataFrame([(3, 4), (0, 0)], "hits long, proposed long")
    assert tuple(judging.verdict_of(scored, runs, cases).first()) == (0.75, False, None)
    assert tuple(judging.verdict_of(scored, runs, cases.filter("syllabus <> 'c'")).first()) == (0.75, True, True)
    assert tuple(judging.verdict_of(scored.filter("hits = 0"), runs, cases.filter("syllabus <> 'c'")).first()) == (None, True, None)


@pytest.fixture(scope="module")
def tree(spark):
    row = lambda key, label: (key, label, "reference", key, None, None, None, None)
    nodes = [row("A", "KnowledgeArea"), row("E", "KnowledgeArea"), *[row(f"U{i}", "KnowledgeUnit") for i in range(6)], row("T", "Topic"), row("C", "Concept")]
    edges = [("PART_OF", f"U{i}", "A", None) for i in range(6)] + [("PART_OF", "T", "U0", None), ("PART_OF", "C", "T", None)]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def test_trees_chains_and_rings(spark, tree):
    rows = {r.key: tuple(r)[1:] for r in readings.tree_counts(tree).collect()}
    assert rows["A"] == (6, 1, 1, True, 5, 5) and rows["E"] == (0, 0, 0, False, 0, 0) and rows["U0"] == (0, 1, 1, True, 0, 0) and rows["U1"][4] == 0
    long = Graph(tree.nodes, spark.createDataFrame([("PART_OF", f"n{i}", f"n{i + 1}", None) for i in range(9)] + [("PART_OF", "x", "x", None)], EDGES))
    chains = {r.root: r.chain.split(" > ") for r in readings.location_chains(long).collect()}
    assert chains["n0"] == [f"n{i}" for i in range(7, 0, -1)] and chains["n6"] == ["n9", "n8", "n7"] and chains["x"] == ["x"] * 7
    view = spark.createDataFrame([(0, 1, "A", 1, 2), (0, 2, "E", 0, 0), (1, 1, "K", None, None)], "part int, place int, key string, topics long, concepts long")
    assert {r.key: (r.filled, r.told) for r in readings.overview_ring(view).collect()} == {"A": (True, "1 tema · 2 conceptos"), "E": (False, None), "K": (False, None)}


def test_measuring_single_starts(spark, tree, tmp_path):
    got = measure.times(tree, "location", ["C"], rounds=2)
    assert [(r.key, r["round"]) for r in got.orderBy("round").collect()] == [("C", 0), ("C", 1), ("C", 2)]
    one = measure.summary(got).first()
    assert one.executions == 2 and one.cold_ms > 0 and one.max_ms >= one.median_ms
    path = f"file://{tmp_path}/t"
    spark.range(10).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(path)
    table = spark.read.parquet(path)
    assert measure.plan_facts(table)["full_scans"] and not measure.plan_facts(table.filter("p = 1"))["full_scans"]
    crossed = measure.plan_facts(table.join(table.toDF("a", "b"), F.col("id") < F.col("a")))
    assert crossed["pair_joins"] and "Scan" in crossed["operators"] and evaluate.MAX_ATTEMPTS == 3
