"""Registry of the engine's queries, over whole tables, and of the DuckDB SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curralis.functions.text import fold, normalize_label, tokens
from curralis.operators import annotation, assembly, audit, components, evaluate, judging, linking, merge, navigation, readings, runs, validate
from curralis.operators.closure import bfs, partonomy, reversed_edges
from curralis.plans import dirty
from curralis.plans.oracles import ORACLES  # noqa: F401
from curralis.schema import MAX_RESULTS, Graph  # noqa: F401
from curralis.sources import turtle
from curralis.sources.cache import content_digest
from curralis.sources.star import graph, tables

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nav_course_prerequisites(spark, sf_dir)


def _starts(g, label: str) -> DataFrame:
    return g.of(label).select(F.col("key").alias("root"))


@query
def nav_concept_prerequisites(spark, sf_dir):
    return navigation.concept_prerequisites(graph(spark, sf_dir))


@query
def nav_course_prerequisites(spark, sf_dir):
    return navigation.course_prerequisites(graph(spark, sf_dir))


@query
def nav_location(spark, sf_dir):
    return navigation.element_location(graph(spark, sf_dir))


@query
def nav_resources(spark, sf_dir):
    return navigation.element_resources(graph(spark, sf_dir))


@query
def nav_path_topic(spark, sf_dir):
    g = graph(spark, sf_dir)
    return navigation.learning_path(g, "topic", labels=("Topic",))


@query
def nav_path_area(spark, sf_dir):
    return navigation.learning_path(graph(spark, sf_dir), "area", labels=("KnowledgeUnit",))


@query
def nav_path_course(spark, sf_dir):
    return navigation.learning_path(graph(spark, sf_dir), "course", labels=("Course",))


@query
def nav_specializations(spark, sf_dir):
    return navigation.concept_specializations(graph(spark, sf_dir))


@query
def nav_detail_direct(spark, sf_dir):
    return navigation.node_neighbours(graph(spark, sf_dir))


@query
def nav_detail_second(spark, sf_dir):
    g = graph(spark, sf_dir)
    return navigation.second_ring(g, navigation.node_neighbours(g))


@query
def nav_more_neighbors(spark, sf_dir):
    return navigation.node_detail(graph(spark, sf_dir)).drop("description")


@query
def nav_overview(spark, sf_dir):
    return navigation.overview(graph(spark, sf_dir))


@query
def nav_search(spark, sf_dir):
    g = graph(spark, sf_dir)
    asked = g.of("Concept").select(F.substring(F.substring_index("name_es", " ", 1), 1, 3).alias("query")).distinct().union(spark.createDataFrame([("the Supplier",), ("reg WID",), ("",), ("zz top",)], "query string"))
    return navigation.search(g, asked)


@query
def closure_all_roots(spark, sf_dir):
    g = graph(spark, sf_dir)
    return bfs(navigation.roots(g, None, "Concept"), g.links("HAS_PREREQUISITE")).groupBy("depth").agg(F.count("*").alias("pairs"))


@query
def closure_partonomy(spark, sf_dir):
    g = graph(spark, sf_dir)
    return partonomy(navigation.roots(g, None, "KnowledgeArea"), reversed_edges(g.links("PART_OF")))


@query
def edge_tail(spark, sf_dir):
    g = graph(spark, sf_dir)
    return navigation.tail_edges(g, navigation.course_prerequisites(g), navigation.KEPT["course_prerequisites"])


@query
def tail_sources(spark, sf_dir):
    g = graph(spark, sf_dir)
    return navigation.sources(g, navigation.tail_edges(g, navigation.course_prerequisites(g), navigation.KEPT["course_prerequisites"]))


@query
def element_counts(spark, sf_dir):
    return navigation.element_counts(graph(spark, sf_dir))


def _audit(rule):
    def run(spark, sf_dir):
        return audit.RULES[rule](dirty.raw_graph(spark, sf_dir))

    return run


QUERIES |= {f"audit_{rule.lower().replace('-', '')}": _audit(rule) for rule in audit.RULES}


@query
def audit_report(spark, sf_dir):
    return audit.report(dirty.raw_graph(spark, sf_dir)).select("rule", "violations", F.array_join("sample", "; ").alias("sample"))


@query
def audit_of_projection(spark, sf_dir):
    g = graph(spark, sf_dir)
    return audit.report(audit.raw_of(g.nodes, g.edges)).select("rule", "violations")


def _check(rule):
    def run(spark, sf_dir):
        nodes, edges = dirty.batch(spark, sf_dir)
        return validate.CHECKS[rule](graph(spark, sf_dir), nodes, edges, "institutional").select("fact", "message")

    return run


QUERIES |= {f"validate_{rule.lower().replace('-', '')}": _check(rule) for rule in validate.CHECKS}


@query
def merge_nodes_new(spark, sf_dir):
    nodes, _ = dirty.batch(spark, sf_dir)
    return merge.new_nodes(graph(spark, sf_dir), nodes, "institutional").select("key", "label", "layer", "name_es")


@query
def merge_edges_new(spark, sf_dir):
    nodes, edges = dirty.batch(spark, sf_dir)
    return merge.merge(graph(spark, sf_dir), nodes, edges, "institutional", "R0")[2]


@query
def derive_provenance(spark, sf_dir):
    nodes, _ = dirty.batch(spark, sf_dir)
    return merge.derivations(merge.new_nodes(graph(spark, sf_dir), nodes, "institutional"), "R0")


@query
def merge_missing(spark, sf_dir):
    g, (nodes, edges) = graph(spark, sf_dir), dirty.batch(spark, sf_dir)
    _, fresh, added = merge.merge(g, nodes, edges, "institutional", "R0")
    return merge.missing(g, fresh, edges, added)


@query
def snapshot_nodes(spark, sf_dir):
    return merge.snapshot_nodes(graph(spark, sf_dir))


@query
def snapshot_edges(spark, sf_dir):
    return merge.snapshot_edges(graph(spark, sf_dir))


@query
def snapshot_reference(spark, sf_dir):
    return merge.only_reference(graph(spark, sf_dir)).edges.select("type", "source", "target")


@query
def snapshot_before(spark, sf_dir):
    g, (nodes, edges) = graph(spark, sf_dir), dirty.batch(spark, sf_dir)
    whole = merge.merge(g, nodes, edges, "institutional", "R0")[0]
    return merge.before(whole, (g.nodes, g.edges), (nodes, whole.edges)).nodes.select("key", "label")


@query
def fold_text(spark, sf_dir):
    return tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.md5(fold(F.col("text"))).alias("folded"))


@query
def normalize_labels(spark, sf_dir):
    found = tables(spark, sf_dir, "documents", "part")
    return found["documents"].select("doc_id", F.md5(normalize_label(F.col("text"))).alias("norm")).union(found["part"].select(-F.col("p_partkey") - 1, F.md5(normalize_label(F.col("p_name")))))


@query
def tokenize_words(spark, sf_dir):
    return tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.array_join(tokens(fold(F.col("text"))), " ").alias("t")).select("doc_id", F.md5("t").alias("words"))


@query
def link_mentions(spark, sf_dir):
    g = graph(spark, sf_dir)
    mentions = tables(spark, sf_dir, "part")["part"].select(F.lit("Concept").alias("label"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper("p_name"), F.lit("s"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("new-"), "p_name")).otherwise(F.col("p_name")).alias("name"))
    return linking.link(mentions, g.nodes).select("name", "norm", "minted", "key")


@query
def vocabulary_refs(spark, sf_dir):
    return linking.vocabulary(graph(spark, sf_dir).nodes).select("ref", "key")


_STATES = ("view", "pending"), ("signup", "running"), ("click", "completed"), ("error", "rejected"), ("purchase", "failed")


def _events(spark, sf_dir):
    state = F.create_map(*[F.lit(x) for pair in _STATES for x in pair])
    return tables(spark, sf_dir, "events")["events"].select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ordinal"), state[F.col("event_type")].alias("state"))


@query
def run_latest_state(spark, sf_dir):
    return runs.latest(_events(spark, sf_dir))


@query
def run_transition_violations(spark, sf_dir):
    return runs.violations(_events(spark, sf_dir))


@query
def run_oldest_pending(spark, sf_dir):
    return runs.oldest_pending(_events(spark, sf_dir))


@query
def run_counts(spark, sf_dir):
    return runs.counts_by_state(_events(spark, sf_dir))


@query
def audit_gate(spark, sf_dir):
    reports = tables(spark, sf_dir, "events")["events"].select(F.col("event_id").alias("report_id"), (F.col("event_type") != "error").alias("completed"), F.floor("value").cast("long").alias("violations"))
    return runs.gate(reports)


@query
def replay_plan(spark, sf_dir):
    facts = tables(spark, sf_dir, "customer")["customer"].select(F.col("c_custkey").alias("run_id"))
    return runs.replay_plan(facts, _events(spark, sf_dir).withColumn("state", F.when(F.col("state") == "failed", "stopped_by_audit").otherwise(F.col("state"))))


def _scored(spark, sf_dir):
    found = tables(spark, sf_dir, "documents", "labels")
    rows = found["documents"].join(found["labels"], "doc_id", "left")
    proposed, must = (F.col("n_chars") > 400), F.col("quality") == 1
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("lang").agg(n(proposed & must).alias("hits"), n(proposed & F.col("quality").isNotNull()).alias("proposed"), n(proposed & must).alias("recovered"), n(must).alias("mandatory"))


@query
def eval_precision_recall(spark, sf_dir):
    return evaluate.with_ratios(_scored(spark, sf_dir))


@query
def eval_totals(spark, sf_dir):
    return evaluate.totals(_scored(spark, sf_dir), F.when(F.col("lang") == "en", "tuning").otherwise("held_out"))


@query
def eval_fusion(spark, sf_dir):
    rows = tables(spark, sf_dir, "lineitem")["lineitem"].select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("global_id"))
    return evaluate.fusion(rows)


@query
def eval_attempts(spark, sf_dir):
    rows = tables(spark, sf_dir, "orders")["orders"].select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").cast("string").alias("syllabus"), (F.col("o_orderstatus") == "F").alias("accepted"))
    return evaluate.attempts(rows)


def _gold(spark, sf_dir):
    return tables(spark, sf_dir, "part")["part"].select(F.col("p_brand").alias("syllabus"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("entry_id"), F.concat(F.lit("G"), (F.col("p_partkey") % 500).cast("string")).alias("global_id"), F.when(F.col("p_size") % 4 == 0, "tema").otherwise("concepto").alias("kind"), F.when(F.col("p_size") % 3 == 0, "aceptable").otherwise("obligatoria").alias("level"), F.col("p_name").alias("label"), F.array(F.col("p_type")).alias("aliases"))


@query
def eval_mandatory_notions(spark, sf_dir):
    return evaluate.mandatory_notions(_gold(spark, sf_dir))


@query
def eval_gold_names(spark, sf_dir):
    return evaluate.gold_names(_gold(spark, sf_dir))


@query
def eval_case_numbers(spark, sf_dir):
    return evaluate.case_numbers(tables(spark, sf_dir, "part")["part"].select(F.col("p_partkey").alias("row_no"), F.col("p_brand").alias("syllabus")))


@query
def greedy_matching(spark, sf_dir):
    items = tables(spark, sf_dir, "part")["part"].select(F.floor(F.col("p_partkey") / 200).alias("run_id"), F.col("p_brand").alias("syllabus"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("label"), F.lit("concepto").alias("kind"))
    return evaluate.greedy_match(items, _gold(spark, sf_dir))


@query
def maximum_matching(spark, sf_dir):
    rows = tables(spark, sf_dir, "lineitem")["lineitem"].select((F.col("l_orderkey") % 500).alias("group"), F.col("l_suppkey").alias("left"), (F.col("l_partkey") % 50).alias("right"))
    return evaluate.maximum_hits(rows)


@query
def review_agreement(spark, sf_dir):
    rows = tables(spark, sf_dir, "part")["part"].select(F.col("p_brand").alias("syllabus"), F.col("p_name").alias("name"), "p_size", "p_partkey")
    return evaluate.agreement(rows.filter("p_size % 2 = 0"), rows.filter("p_partkey % 3 = 0"))


@query
def label_likeness(spark, sf_dir):
    p = tables(spark, sf_dir, "part")["part"].select("p_name", "p_brand").distinct()
    pairs = p.select(F.col("p_name").alias("a"), "p_brand").join(p.select(F.col("p_name").alias("b"), "p_brand"), "p_brand").filter("a < b").select("a", "b").distinct()
    return evaluate.closest(pairs)


@query
def connected_notions(spark, sf_dir):
    rows = tables(spark, sf_dir, "part")["part"].select(F.col("p_partkey").alias("row_no"), F.concat("p_name", F.lit(" "), "p_size").alias("label"), F.array(F.concat("p_type", F.lit(" "), "p_brand", F.lit(" "), "p_size")).alias("aliases"))
    return evaluate.global_ids(rows)


@query
def scc_members(spark, sf_dir):
    g = dirty.raw_graph(spark, sf_dir)
    return components.strongly_connected(g.edges.filter("type = 'HAS_PREREQUISITE'").select(F.col("src").alias("source"), F.col("dst").alias("target")))


@query
def nearest_rank_p95(spark, sf_dir):
    return evaluate.latency_summary(tables(spark, sf_dir, "events")["events"].select(F.col("event_type").alias("pattern"), F.floor(F.col("value") * 10).cast("long").alias("ms")))


@query
def learning_order(spark, sf_dir):
    g = graph(spark, sf_dir)
    return readings.learning_order(g, _starts(g, "Topic"))


@query
def location_chains(spark, sf_dir):
    return readings.location_chains(graph(spark, sf_dir))


@query
def prerequisites_by_depth(spark, sf_dir):
    g = graph(spark, sf_dir)
    return readings.prerequisites_by_depth(g, navigation.concept_prerequisites(g))


@query
def previous_courses(spark, sf_dir):
    return readings.previous_courses(graph(spark, sf_dir))


@query
def path_stops(spark, sf_dir):
    g = graph(spark, sf_dir)
    return readings.path_stops(g, navigation.learning_path(g, "topic", labels=("Topic",)), "Topic")


@query
def resources_of(spark, sf_dir):
    g = graph(spark, sf_dir)
    return readings.resources_of(g, navigation.element_resources(g)).withColumn("parts", F.array_join("parts", ","))


@query
def documents_of_edges(spark, sf_dir):
    return readings.documents_of_edges(graph(spark, sf_dir))


@query
def concepts_under(spark, sf_dir):
    return readings.concepts_under(graph(spark, sf_dir))


@query
def neighbour_clusters(spark, sf_dir):
    return readings.clusters(graph(spark, sf_dir))


@query
def count_by_class(spark, sf_dir):
    g = graph(spark, sf_dir)
    return readings.count_by_class(g, navigation.element_location(g))


@query
def contains_target(spark, sf_dir):
    g = graph(spark, sf_dir)
    return readings.contains_target(g, readings.path_stops(g, navigation.learning_path(g, "area", labels=("KnowledgeUnit",)), "KnowledgeArea").select("root", "key"))


@query
def justified_stops(spark, sf_dir):
    g = graph(spark, sf_dir)
    stops = navigation.learning_path(g, "course", labels=("Course",)).filter("depth > 0").join(g.of("Concept").select("key"), "key", "left_semi")
    return readings.justification(g, stops.select("root", "key"))


@query
def turtle_projection(spark, sf_dir):
    """Regions and nations as Turtle documents, parsed and projected."""
    found, x = tables(spark, sf_dir, "region", "nation"), "http://example.org/o#"
    head = f"@prefix : <{x}> . @prefix owl: <{turtle.OWL}> . @prefix skos: <http://www.w3.org/2004/02/skos/core#> . "
    one = lambda key, kind, name, more: F.concat(F.lit(head + ":"), key, F.lit(f' a owl:NamedIndividual , :{kind} , :Element ; :layer "reference" ; skos:prefLabel "'), name, F.lit('"@es , "'), F.lower(name), F.lit('"@en'), more, F.lit(" ."))
    area = lambda c: F.concat(F.lit("A"), F.col(c).cast("string"))
    docs = found["region"].select(one(area("r_regionkey"), "Area", F.col("r_name"), F.lit("")).alias("doc"))
    docs = docs.union(found["nation"].select(one(F.concat(F.lit("U"), F.col("n_nationkey").cast("string")), "Unit", F.col("n_name"), F.concat(F.lit(" ; :unitOf :"), area("n_regionkey"), F.lit(" ; :partOf :"), area("n_regionkey")))))
    docs = docs.union(spark.createDataFrame([(f'<{x[:-1]}> a <{turtle.OWL}Ontology> ; <{turtle.RDFS}comment> "c" . [] a <{turtle.OWL}AllDifferent> ; <{turtle.OWL}distinctMembers> ( <{x}A0> <{x}A1> ) .',)], "doc string"))
    nodes, edges = turtle.project(turtle.triples_of(docs), {x + "Area": "KnowledgeArea", x + "Unit": "KnowledgeUnit"}, {x + "unitOf": "PART_OF", x + "partOf": "PART_OF"}, "http://www.w3.org/2004/02/skos/core#prefLabel", {x + "layer": "layer"}, abstract=(x + "Element",), layer="reference")
    return nodes.select(F.col("label").alias("kind"), "key", F.concat_ws("/", "name_es", "name_en", "layer").alias("value")).union(edges.select("type", "source", "target"))


@query
def snapshot_problems(spark, sf_dir):
    """Of the graph with some keys in two classes, an unknown layer and units in two areas."""
    g = graph(spark, sf_dir)
    more = g.of("Concept").filter("key LIKE '%7'").withColumn("label", F.lit("Topic")).unionByName(g.of("Course").withColumn("layer", F.lit("draft")).withColumn("key", F.concat(F.lit("D"), "key")))
    links = g.links("PART_OF").filter("source LIKE 'U%'").withColumn("target", F.lit("A0"))
    return merge.snapshot_problems(Graph(g.nodes.unionByName(more), g.edges.unionByName(links)))


def _facts(spark, sf_dir):
    g = graph(spark, sf_dir)
    mint = lambda label, norm: F.concat_ws("|", F.lit("new"), label, norm)
    return assembly.link_outputs(*dirty.outputs(spark, sf_dir), g.nodes, linking.vocabulary(g.nodes), mint)


@query
def linked_edges(spark, sf_dir):
    return _facts(spark, sf_dir).edges


@query
def linked_nodes(spark, sf_dir):
    return _facts(spark, sf_dir).nodes.select("doc", "key", "label", "minted")


@query
def linked_taught_and_required(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    return facts.taught.withColumn("how", F.lit("taught")).unionByName(facts.required.withColumn("how", F.lit("required")))


@query
def link_discards(spark, sf_dir):
    return _facts(spark, sf_dir).discards


@query
def assembled_edges(spark, sf_dir):
    """Number of edges of each type in every document's batch."""
    declared = tables(spark, sf_dir, "supplier")["supplier"].select(F.col("s_suppkey").alias("doc"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("resource"), F.lit("syllabus").alias("resource_type"), F.concat(F.lit(" "), F.lower("s_name")).alias("code"), F.col("s_name").alias("course_name"))
    nodes, edges = assembly.assemble(declared, _facts(spark, sf_dir), "https://example.org/")
    courses = nodes.filter("label = 'Course'").select("doc", F.col("course_code").alias("type"), F.lit(1).cast("long").alias("n"))
    return edges.groupBy("doc", "type").agg(F.count("*").alias("n")).unionByName(courses)


@query
def vocabulary_lines(spark, sf_dir):
    g = graph(spark, sf_dir)
    return assembly.vocabulary_lines(linking.vocabulary(g.nodes), g.edges)


def _batches(spark, sf_dir):
    found = tables(spark, sf_dir, "lineitem", "orders", "part", "supplier")
    lines = found["lineitem"].select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("ordinal"), F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("key"), F.concat(F.lit("T"), (F.col("l_suppkey") % 7).cast("string")).alias("topic"))
    nodes = lines.filter("ordinal <= 3").groupBy("run_id", "key").agg(F.min("ordinal").alias("ordinal")).select("run_id", "ordinal", "key", F.lit("Concept").alias("label"), F.concat_ws("@", "key", F.col("run_id").cast("string")).alias("name"))
    edges = lines.select("run_id", "ordinal", F.when(F.col("ordinal") % 2 == 1, "PART_OF").otherwise("HAS_PREREQUISITE").alias("type"), F.col("key").alias("source"), F.when(F.col("ordinal") % 2 == 1, F.col("topic")).otherwise(F.lit("C1")).alias("target"))
    runs_ = found["orders"].select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").cast("string").alias("syllabus"), (F.col("o_orderstatus") == "F").alias("accepted"))
    reference = found["supplier"].select((F.col("s_suppkey") % 6).alias("k")).distinct().select(F.concat(F.lit("T"), F.col("k").cast("string")).alias("key"), F.lit("Topic").alias("label"), F.concat(F.lit("topic "), F.col("k").cast("string")).alias("name"))
    return nodes, edges, runs_, reference


@query
def walk_chain(spark, sf_dir):
    return judging.walk(*_batches(spark, sf_dir))


@query
def walk_isolated(spark, sf_dir):
    return judging.walk(*_batches(spark, sf_dir), isolated=True)


@query
def judged_runs(spark, sf_dir):
    cases = tables(spark, sf_dir, "customer")["customer"].filter("c_nationkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("syllabus"))
    return judging.judged_runs(_batches(spark, sf_dir)[2], cases)


@query
def eval_fusion_counts(spark, sf_dir):
    rows = tables(spark, sf_dir, "lineitem")["lineitem"].select(F.col("l_suppkey").alias("node"), F.when(F.col("l_suppkey") % 2 == 0, "Topic").otherwise("Concept").alias("label"), F.col("l_partkey").alias("global_id"))
    compound = tables(spark, sf_dir, "part")["part"].filter("p_size > 5").select(F.col("p_partkey").alias("global_id"))
    return judging.fusion_counts(rows, compound, tables(spark, sf_dir, "supplier")["supplier"].filter("s_nationkey < 5").select(F.col("s_suppkey").alias("node")))


def _review(spark, sf_dir):
    return tables(spark, sf_dir, "part")["part"].filter("p_size % 2 = 0").select(F.col("p_brand").alias("syllabus"), F.col("p_partkey").alias("row_no"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_type")).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise("no such").alias("name"), F.when(F.col("p_partkey") % 5 < 3, " Tema").otherwise("otro").alias("kind"))


@query
def review_comparison(spark, sf_dir):
    return judging.compare_review(_gold(spark, sf_dir), _review(spark, sf_dir))


@query
def review_pipeline(spark, sf_dir):
    items = tables(spark, sf_dir, "part")["part"].select(F.col("p_brand").alias("syllabus"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    return judging.pipeline_against_review(items, _review(spark, sf_dir), items.filter("key % 11 = 0").select("syllabus", "key"))


@query
def review_total(spark, sf_dir):
    """Totals over the syllabi, where all of them have the figure and where one lacks it."""
    shares = judging.pipeline_against_review(tables(spark, sf_dir, "part")["part"].select(F.col("p_brand").alias("syllabus"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name")), _review(spark, sf_dir))
    lacking = shares.withColumn("registered", F.when(F.col("syllabus") != "Brand#1", F.col("registered")))
    return judging.guarded_total(shares, "registered", "items").withColumn("of", F.lit("all")).unionByName(judging.guarded_total(lacking, "registered", "items").withColumn("of", F.lit("lacking")))


@query
def review_adjudicated(spark, sf_dir):
    p = tables(spark, sf_dir, "part")["part"]
    gaps = p.select(F.col("p_brand").alias("syllabus"), F.when(F.col("p_size") % 2 == 0, "reviewer").otherwise("annotation").alias("side"), F.col("p_name").alias("name")).distinct()
    decided = p.filter("p_partkey % 4 <> 0").select(F.col("p_brand").alias("syllabus"), F.when(F.col("p_size") % 2 == 0, "reviewer").otherwise("annotation").alias("side"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 4 == 1, "").when(F.col("p_partkey") % 4 == 2, "same").otherwise("error").alias("category"))
    return judging.adjudicated(gaps, decided)


@query
def notion_choices(spark, sf_dir):
    return judging.notion_choices(_gold(spark, sf_dir))


@query
def kinds_of(spark, sf_dir):
    return readings.kinds_of(graph(spark, sf_dir))


@query
def kinds_levels(spark, sf_dir):
    g = graph(spark, sf_dir)
    return readings.kinds_levels(g, _starts(g, "Concept"))


@query
def lens_classes(spark, sf_dir):
    return readings.lenses(graph(spark, sf_dir)).groupBy("lens").agg(F.count("*").alias("n"))


@query
def node_connections(spark, sf_dir):
    return readings.connections(graph(spark, sf_dir)).groupBy("key").agg(F.count("*").alias("n"))


def _entries(spark, sf_dir):
    return tables(spark, sf_dir, "part")["part"].select(F.col("p_partkey").alias("row_no"), F.concat("p_name", F.lit(" "), "p_size").alias("label"), F.array(F.concat("p_type", F.lit(" "), "p_brand", F.lit(" "), "p_size")).alias("aliases"), "p_size")


@query
def ruled_notions(spark, sf_dir):
    """Notions under rulings: compound headings, names that don't link an entry, entries joined by hand."""
    rows = _entries(spark, sf_dir)
    apart = rows.filter("p_size % 10 = 1").select("row_no", annotation.loose_name(F.col("label")).alias("name"))
    joined = rows.filter("p_size = 50").select(F.col("row_no").alias("a"), (F.col("row_no") % 7 + 1).alias("b"))
    return annotation.ruled_ids(rows, rows.filter("p_size % 10 = 0"), apart, joined)


@query
def loose_names(spark, sf_dir):
    return tables(spark, sf_dir, "part")["part"].select("p_partkey", annotation.loose_name(F.concat("p_type", F.lit(" "), "p_brand")).alias("name"), annotation.singular_head(F.concat("p_type", F.lit("s (de) "), "p_name")).alias("head"))


@query
def annotation_problems(spark, sf_dir):
    n = F.col("p_partkey")
    kind = F.when(F.col("p_size") % 4 == 0, "tema").when(F.col("p_size") == 7, "otro").otherwise("concepto")
    grade = F.when(F.col("p_size") % 3 == 0, "aceptable").when(F.col("p_size") == 11, "").otherwise("obligatoria")
    parent = F.when(n % 3 == 0, (n - F.col("p_size") % 30).cast("string")).otherwise("")
    note = F.when(F.col("p_size") % 5 == 0, 'a ""b""').when(F.col("p_size") % 5 == 1, "n").otherwise("")
    cells = [n.cast("string"), kind, grade, F.col("p_name"), F.lit(""), parent, F.when(F.col("p_size") == 13, "x").otherwise("sumilla"), F.lit("e")]
    line = F.concat(F.concat_ws("\t", *cells), F.when(F.col("p_size") == 50, "").otherwise(F.concat(F.lit("\t"), note)))
    return annotation.format_problems(tables(spark, sf_dir, "part")["part"].select((F.col("p_size") % 2).alias("file"), line.alias("line"))).withColumn("file", F.col("file").cast("long"))


def _cases(spark, sf_dir):
    return tables(spark, sf_dir, "customer")["customer"].select(F.col("c_custkey").cast("string").alias("syllabus"))


def _runs(spark, sf_dir):
    return tables(spark, sf_dir, "orders")["orders"].select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").cast("string").alias("syllabus"), (F.col("o_orderstatus") == "F").alias("accepted"))


@query
def run_warnings(spark, sf_dir):
    return judging.warnings(_runs(spark, sf_dir), _cases(spark, sf_dir))


@query
def run_verdict(spark, sf_dir):
    """Of the runs' cases, where some have no run, and of those that have one."""
    scored, done = _scored(spark, sf_dir), _runs(spark, sf_dir)
    some = _cases(spark, sf_dir).join(done, "syllabus", "left_semi")
    return judging.verdict_of(scored, done, _cases(spark, sf_dir)).withColumn("of", F.lit("all")).unionByName(judging.verdict_of(scored, done, some).withColumn("of", F.lit("run")))


@query
def tree_counts(spark, sf_dir):
    return readings.tree_counts(graph(spark, sf_dir))


@query
def overview_ring(spark, sf_dir):
    return readings.overview_ring(navigation.overview(graph(spark, sf_dir)))


@query
def content_digests(spark, sf_dir):
    return tables(spark, sf_dir, "documents")["documents"].select("doc_id", content_digest(F.col("text")).alias("digest"))
