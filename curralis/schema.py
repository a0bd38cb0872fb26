"""The typed property graph: classes, edge types, admitted pairs, properties, layers and rules, declared once as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: the names below are the data model's own
KNOWLEDGE_ELEMENT = "KnowledgeElement"
LEVELS = ("KnowledgeArea", "KnowledgeUnit", "Topic", "Concept")
TOP_LEVEL = (KNOWLEDGE_ELEMENT, "Course", "LearningResource", "ResourceType")
CLASSES = LEVELS + TOP_LEVEL[1:]
LABELS = (KNOWLEDGE_ELEMENT, *CLASSES)
EDGE_TYPES = ("PART_OF", "HAS_PREREQUISITE", "SPECIALIZES", "TEACHES_CONCEPT", "REQUIRES_CONCEPT", "IS_ABOUT", "HAS_RESOURCE_TYPE", "WAS_DERIVED_FROM")
ACYCLIC = ("HAS_PREREQUISITE", "SPECIALIZES")
DESCRIBED = (*LEVELS, "Course")
PAIRS = (
    ("PART_OF", "Concept", "Topic"),
    ("PART_OF", "Topic", "KnowledgeUnit"),
    ("PART_OF", "KnowledgeUnit", "KnowledgeArea"),
    ("HAS_PREREQUISITE", "Concept", "Concept"),
    ("SPECIALIZES", "Concept", "Concept"),
    ("TEACHES_CONCEPT", "Course", "Concept"),
    ("REQUIRES_CONCEPT", "Course", "Concept"),
    *(("IS_ABOUT", "LearningResource", label) for label in DESCRIBED),
    ("HAS_RESOURCE_TYPE", "LearningResource", "ResourceType"),
    *(("WAS_DERIVED_FROM", label, "LearningResource") for label in DESCRIBED),
)
LAYERS = ("reference", "institutional")
NODE_PROPERTIES = ("key", "layer", "prefLabelEs", "prefLabelEn", "description")
OWN_PROPERTIES = {"LearningResource": ("resourceLocator",), "Course": ("courseCode",)}
REQUIRED_PARENT = {"Concept": "Topic", "Topic": "KnowledgeUnit", "KnowledgeUnit": "KnowledgeArea"}
DERIVED = ("Topic", "Concept", "Course")
LOCATOR = r"^(?i)https?://[^\s/?#]+(?:[/?#]\S*)?$"
MAX_DEPTH, MAX_NEIGHBORS, MAX_SECOND, MAX_RESULTS, SAMPLE = 10, 25, 5, 20, 20

NODES = "key string, label string, layer string, name_es string, name_en string, course_code string, locator string, description string"
EDGES = "type string, source string, target string, provenance string"


class Graph:
    """A version of the graph: nodes (NODES) and edges (EDGES) as DataFrames. Everything built on it stays lazy."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def of(self, *labels: str) -> DataFrame:
        return self.nodes.filter(self.nodes.label.isin(*labels))

    def links(self, *types: str) -> DataFrame:
        return self.edges.filter(self.edges.type.isin(*types))


def admitted_pairs(spark: SparkSession) -> DataFrame:
    """The 18 admitted triples (type, source_label, target_label): a fixed dimension, small enough to broadcast at any scale."""
    return spark.createDataFrame(list(PAIRS), "type string, source_label string, target_label string")
