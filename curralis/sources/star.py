"""Projects the star schema (region, nation, part, supplier, lineitem, pages) into the property graph.

The projection is plain SQL that both Spark and DuckDB run, one statement per kind of node or edge, so that the graph
that the operators read and the one that their oracles read come from one definition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from curralis.plans.lineage import dealt, shared_folder
from curralis.schema import EDGES, NODES, Graph

TABLES = ("region", "nation", "part", "supplier", "lineitem", "pages")
_NULL = "CAST(NULL AS STRING)"
_N = "(SELECT count(*) FROM {pages})"


def _node(label: str, layer: str, key: str, name: str, source: str, code: str = _NULL, locator: str = _NULL, name_en: str | None = None) -> str:
    return f"SELECT {key} AS key, '{label}' AS label, '{layer}' AS layer, {name} AS name_es, {name_en or name} AS name_en, {code} AS course_code, {locator} AS locator, {_NULL} AS description FROM {source}"


_B = "(SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS b, p_brand FROM {part})"
_NODES = (
    _node("KnowledgeArea", "reference", "'A' || CAST(r_regionkey AS STRING)", "r_name", "{region}"),
    _node("KnowledgeUnit", "reference", "'U' || CAST(n_nationkey AS STRING)", "n_name", "{nation}"),
    _node("Topic", "institutional", "'T' || CAST(b AS STRING)", "p_brand", f"{_B} AS brands"),
    _node("Concept", "institutional", "'C' || CAST(p_partkey AS STRING)", "p_name", "{part}"),
    _node("Course", "institutional", "'K' || CAST(s_suppkey AS STRING)", "s_name", "{supplier}", code="s_name"),
    _node("LearningResource", "institutional", "'R' || CAST(page_id AS STRING)", "url", "{pages}", locator="url"),
    _node("ResourceType", "reference", "'Y' || scheme", "scheme", "(SELECT DISTINCT substr(url, 1, instr(url, ':') - 1) AS scheme FROM {pages}) AS schemes"),
    _node("LearningResource", "reference", "'RREF'", "'standard'", "(SELECT 1 AS one) AS single", locator="'https://example.org/standard'"),
)


def _edge(kind: str, source: str, target: str, provenance: str, rows: str) -> str:
    return f"SELECT '{kind}' AS type, {source} AS source, {target} AS target, {provenance} AS provenance FROM {rows}"


def _key(letter: str, number: str) -> str:
    return f"'{letter}' || CAST({number} AS STRING)"


def _from(number: str) -> str:
    return _key("R", f"CAST({number} % {_N} AS BIGINT)")


_HALVES = "(SELECT DISTINCT k, t FROM (SELECT p_partkey AS k, CAST(floor(p_partkey / 2) AS BIGINT) AS t FROM {part} UNION ALL SELECT p_partkey AS k, CAST(floor(p_partkey / 3) AS BIGINT) AS t FROM {part}) AS both_ WHERE k > 0) AS halves"
_TAUGHT = "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM {lineitem} WHERE l_linenumber = 1 AND l_returnflag = 'A' AND l_partkey % 7 = 0"
_NEEDED = "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM {lineitem} WHERE l_linenumber = 2 AND l_returnflag = 'R' AND l_partkey % 11 = 0"
_EDGES = (
    _edge("PART_OF", _key("U", "n_nationkey"), _key("A", "n_regionkey"), _NULL, "{nation}"),
    _edge("PART_OF", _key("T", "b"), _key("U", "b - 1"), _from("b"), f"{_B} AS brands"),
    _edge("PART_OF", _key("C", "p_partkey"), _key("T", "CAST(substr(p_brand, 7) AS BIGINT)"), _from("p_partkey"), "{part}"),
    _edge("HAS_PREREQUISITE", _key("C", "k"), _key("C", "t"), _from("k"), _HALVES),
    _edge("SPECIALIZES", _key("C", "p_partkey"), _key("C", "p_partkey - 1"), _from("p_partkey"), "{part} WHERE p_partkey % 16 <> 0"),
    _edge("TEACHES_CONCEPT", _key("K", "s"), _key("C", "p"), _from("s"), f"({_TAUGHT}) AS taught"),
    _edge("REQUIRES_CONCEPT", _key("K", "s"), _key("C", "p"), _from("s"), f"({_NEEDED} EXCEPT {_TAUGHT}) AS needed"),
    _edge("IS_ABOUT", _key("R", "page_id"), _key("T", "page_id % 25 + 1"), _key("R", "page_id"), "{pages}"),
    _edge("IS_ABOUT", _key("R", "page_id"), _key("K", "page_id % (SELECT count(*) FROM {supplier})"), _key("R", "page_id"), "{pages} WHERE page_id % 5 = 0"),
    _edge("HAS_RESOURCE_TYPE", _key("R", "page_id"), "'Y' || substr(url, 1, instr(url, ':') - 1)", _key("R", "page_id"), "{pages}"),
    _edge("WAS_DERIVED_FROM", _key("A", "r_regionkey"), "'RREF'", _NULL, "{region}"),
    _edge("WAS_DERIVED_FROM", _key("U", "n_nationkey"), "'RREF'", _NULL, "{nation}"),
    _edge("WAS_DERIVED_FROM", _key("T", "b"), _from("b"), _from("b"), f"{_B} AS brands"),
    _edge("WAS_DERIVED_FROM", _key("C", "p_partkey"), _from("p_partkey"), _from("p_partkey"), "{part}"),
    _edge("WAS_DERIVED_FROM", _key("K", "s_suppkey"), _from("s_suppkey"), _from("s_suppkey"), "{supplier}"),
)
NODES_SQL, EDGES_SQL = " UNION ALL ".join(_NODES), " UNION ALL ".join(_EDGES)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


_published: dict[tuple[str, str], str] = {}


def project(spark: SparkSession, sf_dir: str) -> Graph:
    """The projection as it is computed, lazily."""
    found = tables(spark, sf_dir, *TABLES)
    return Graph(spark.sql(NODES_SQL, **found), spark.sql(EDGES_SQL, **found))


def graph(spark: SparkSession, sf_dir: str, refresh: bool = False) -> Graph:
    """The published version of the projection: written once per session, partitioned by label and by type, so that a
    question scans only the classes and edge types that it names. refresh publishes anew after the tables have changed."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if refresh or key not in _published:
        made, path = project(spark, sf_dir), f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
        dealt(made.nodes, "label", "key").write.partitionBy("label").parquet(f"{path}/nodes")
        dealt(made.edges, "type", "source").write.partitionBy("type").parquet(f"{path}/edges")
        _published[key] = path
    read = lambda part, schema: spark.read.schema(schema).parquet(f"{_published[key]}/{part}").select(*[c.split()[0] for c in schema.split(", ")])
    return Graph(read("nodes", NODES), read("edges", EDGES))


def with_graph(sql: str) -> str:
    """DuckDB SQL that reads the tables nodes and edges of the projection. sql may begin with RECURSIVE or further tables and a comma-less body."""
    names = {n: n for n in TABLES}
    return f"WITH RECURSIVE nodes AS ({NODES_SQL.format(**names)}), edges AS ({EDGES_SQL.format(**names)}){sql}"
