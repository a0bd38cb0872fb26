"""A raw tier with seeded violations of every rule, and a batch of proposed facts: test data from the star schema, as SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curralis.operators.audit import RawGraph, props
from curralis.sources.star import graph, tables

_K = "CAST(substr(key, 2) AS BIGINT)"
_C, _R = "label = 'Concept'", "label = 'LearningResource' AND key <> 'RREF'"
RAW_NODES_SQL = f"""
SELECT 'n:' || key AS id,
       CASE WHEN {_C} AND {_K} % 83 = 1 THEN 'Concept'
            WHEN {_C} AND {_K} % 79 = 2 THEN 'KnowledgeElement Concept Course'
            WHEN {_C} AND {_K} % 71 = 3 THEN 'KnowledgeElement Concept Weird'
            WHEN label IN ('KnowledgeArea', 'KnowledgeUnit', 'Topic', 'Concept') THEN 'KnowledgeElement ' || label ELSE label END AS labels,
       CASE WHEN {_C} AND {_K} % 151 = 5 THEN NULL ELSE key END AS key,
       CASE WHEN {_C} AND {_K} % 67 = 4 THEN NULL WHEN {_C} AND {_K} % 61 = 5 THEN 'draft' ELSE layer END AS layer,
       CASE WHEN {_R} AND {_K} % 53 = 0 THEN 'ftp://' || key WHEN {_R} AND {_K} % 47 = 1 THEN NULL WHEN {_R} AND {_K} % 43 = 2 THEN '42' ELSE locator END AS locator,
       CASE WHEN {_R} AND {_K} % 43 = 2 THEN 'integer' ELSE 'string' END AS locator_kind,
       CASE WHEN {_C} AND {_K} % 59 = 6 THEN 'red' END AS color
FROM (SELECT key, label, layer, locator FROM {{nodes}}) AS n
UNION ALL
SELECT 'd:' || key AS id, 'KnowledgeElement Concept' AS labels, key, layer, locator, 'string' AS locator_kind, CAST(NULL AS STRING) AS color
FROM {{nodes}} WHERE {_C} AND CASE WHEN {_C} THEN {_K} % 97 ELSE 1 END = 0
"""
_S = "CASE WHEN source LIKE 'C%' OR source LIKE 'K%' OR source LIKE 'U%' OR source LIKE 'T%' THEN CAST(substr(source, 2) AS BIGINT) ELSE -1 END"
RAW_EDGES_SQL = f"""
SELECT type || '|' || source || '|' || target AS id,
       CASE WHEN type = 'PART_OF' AND source LIKE 'C%' AND s % 89 = 0 THEN 'RELATED_TO' ELSE type END AS type,
       'n:' || source AS src, 'n:' || target AS dst,
       CASE WHEN type = 'SPECIALIZES' AND s % 113 = 11 THEN NULL WHEN type = 'PART_OF' AND source LIKE 'U%' AND s % 7 = 1 THEN 'R1' ELSE provenance END AS provenance,
       CASE WHEN type = 'HAS_PREREQUISITE' AND s % 107 = 9 THEN '3' END AS weight
FROM (SELECT type, source, target, provenance, {_S} AS s FROM {{edges}}) AS e
WHERE NOT (type = 'PART_OF' AND source LIKE 'C%' AND s % 103 = 8) AND NOT (type = 'WAS_DERIVED_FROM' AND source LIKE 'C%' AND s % 109 = 10)
UNION ALL SELECT 'reversed|' || source, 'PART_OF', 'n:' || target, 'n:' || source, provenance, CAST(NULL AS STRING) FROM {{edges}} WHERE type = 'PART_OF' AND source LIKE 'C%' AND {_S} % 101 = 7
UNION ALL SELECT 'again|' || source || '|' || target, type, 'n:' || source, 'n:' || target, provenance, CAST(NULL AS STRING) FROM {{edges}} WHERE type = 'TEACHES_CONCEPT' AND {_S} % 10 = 3
UNION ALL SELECT 'second|' || source, type, 'n:' || source, 'n:A' || CAST((CAST(substr(target, 2) AS BIGINT) + 1) % 5 AS STRING), provenance, CAST(NULL AS STRING) FROM {{edges}} WHERE type = 'PART_OF' AND source LIKE 'U%' AND {_S} % 10 = 0
UNION ALL SELECT 'about|' || source, 'IS_ABOUT', 'n:RREF', 'n:' || source, CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {{edges}} WHERE type = 'PART_OF' AND source LIKE 'T%' AND {_S} % 9 = 0
UNION ALL SELECT 'back|' || source, type, 'n:' || target, 'n:' || source, provenance, CAST(NULL AS STRING) FROM {{edges}} WHERE type = 'HAS_PREREQUISITE' AND {_S} % 50 = 0 AND CAST(substr(target, 2) AS BIGINT) = CAST(floor(({_S}) / 2) AS BIGINT)
"""
#: A batch: concepts not in the graph yet and some that are, one without a topic, one bad and one missing locator, edges to nowhere and wrong pairs.
BATCH_NODES_SQL = f"""
SELECT 'N' || CAST(p_partkey AS STRING) AS key, 'Concept' AS label, 'institutional' AS layer, 'new ' || p_name AS name_es, CAST(NULL AS STRING) AS name_en, CAST(NULL AS STRING) AS course_code, CAST(NULL AS STRING) AS locator, CAST(NULL AS STRING) AS description FROM {{part}} WHERE p_partkey % 5 = 0
UNION ALL SELECT 'C' || CAST(p_partkey AS STRING), 'Concept', 'institutional', p_name, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {{part}} WHERE p_partkey % 50 = 1
UNION ALL SELECT 'NR' || CAST(page_id AS STRING), 'LearningResource', 'institutional', 'page', CAST(NULL AS STRING), CAST(NULL AS STRING), CASE WHEN page_id % 30 = 0 THEN CAST(NULL AS STRING) WHEN page_id % 30 = 10 THEN 'http://' ELSE url END, CAST(NULL AS STRING) FROM {{pages}} WHERE page_id % 10 = 0
"""
BATCH_EDGES_SQL = """
SELECT 'PART_OF' AS type, 'N' || CAST(p_partkey AS STRING) AS source, 'T' || substr(p_brand, 7) AS target FROM {part} WHERE p_partkey % 5 = 0 AND p_partkey % 35 <> 0
UNION ALL SELECT 'HAS_PREREQUISITE', 'N' || CAST(p_partkey AS STRING), 'C' || CAST(p_partkey AS STRING) FROM {part} WHERE p_partkey % 5 = 0
UNION ALL SELECT 'HAS_PREREQUISITE', 'C' || CAST(p_partkey AS STRING), 'C' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) FROM {part} WHERE p_partkey % 40 = 20
UNION ALL SELECT 'HAS_PREREQUISITE', 'N' || CAST(p_partkey AS STRING), 'C-none' FROM {part} WHERE p_partkey % 65 = 0
UNION ALL SELECT 'TEACHES_CONCEPT', 'N' || CAST(p_partkey AS STRING), 'T1' FROM {part} WHERE p_partkey % 75 = 0
UNION ALL SELECT 'LIKES', 'N' || CAST(p_partkey AS STRING), 'T1' FROM {part} WHERE p_partkey % 85 = 0
UNION ALL SELECT 'IS_ABOUT', 'RREF', 'N' || CAST(p_partkey AS STRING) FROM {part} WHERE p_partkey % 95 = 0
"""

#: What a language model could have said about a document of each supplier: a known and a new topic, known and new concepts, references that are
#: unknown or of another class.
TOPICS_SQL = """
SELECT s_suppkey AS doc, 0 AS t, p_brand AS name, CAST(NULL AS STRING) AS existing, CAST(NULL AS STRING) AS unit FROM {supplier} JOIN {part} ON p_partkey = s_suppkey + 1
UNION ALL SELECT s_suppkey, 1, p_name || ' y ' || s_name, CAST(NULL AS STRING), CASE WHEN s_suppkey % 17 = 3 THEN 'K-999' WHEN s_suppkey % 19 = 4 THEN 'T-001' ELSE 'K-00' || CAST(s_suppkey % 9 + 1 AS STRING) END FROM {supplier} JOIN {part} ON p_partkey = s_suppkey + 2
"""
CONCEPTS_SQL = """
SELECT l_suppkey AS doc, l_linenumber % 2 AS t, l_orderkey AS c, CASE WHEN l_partkey % 3 = 0 THEN 'nuevo ' || p_name ELSE p_name END AS name, CAST(NULL AS STRING) AS existing
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE l_linenumber <= 2
"""
REQUIRED_SQL = """
SELECT l_suppkey AS doc, l_orderkey AS r, p_name AS name, CAST(NULL AS STRING) AS existing FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE l_linenumber >= 4
UNION ALL SELECT s_suppkey, -1, p_name, CAST(NULL AS STRING) FROM {supplier} JOIN {part} ON p_partkey = s_suppkey + 2
"""
RELATIONS_SQL = """
SELECT l_suppkey AS doc, CASE WHEN l_linenumber = 1 THEN 'HAS_PREREQUISITE' ELSE 'SPECIALIZES' END AS kind, l_orderkey AS n, p.p_name AS source,
       CASE WHEN l_orderkey % 4 = 0 THEN 'C-00' || CAST(l_orderkey % 9 + 1 AS STRING) ELSE h.p_name END AS target
FROM {lineitem} JOIN {part} AS p ON p.p_partkey = l_partkey JOIN {part} AS h ON h.p_partkey = l_suppkey + 2 WHERE l_linenumber <= 2 AND l_partkey % 3 <> 0
"""


def outputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """topics, concepts, required and relations of the documents."""
    found = tables(spark, sf_dir, "supplier", "part", "lineitem")
    return tuple(spark.sql(sql, **{n: df for n, df in found.items() if "{" + n + "}" in sql}) for sql in (TOPICS_SQL, CONCEPTS_SQL, REQUIRED_SQL, RELATIONS_SQL))


def raw_graph(spark: SparkSession, sf_dir: str) -> RawGraph:
    clean = graph(spark, sf_dir)
    nodes, edges = spark.sql(RAW_NODES_SQL, nodes=clean.nodes), spark.sql(RAW_EDGES_SQL, edges=clean.edges)
    shown = {"key": "key", "layer": "layer", "resourceLocator": "locator", "color": "color"}
    return RawGraph(nodes.select("id", F.split("labels", " ").alias("labels"), props(shown, {"resourceLocator": "locator_kind"})), edges.select("id", "type", "src", "dst", props({"provenance": "provenance", "weight": "weight"})))


def batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = tables(spark, sf_dir, "part", "pages")
    return spark.sql(BATCH_NODES_SQL, **found), spark.sql(BATCH_EDGES_SQL, part=found["part"])
