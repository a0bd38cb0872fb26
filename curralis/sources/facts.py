"""Stored facts: one write-once JSON document per run, read and replayed in the order of runs; and the gold annotation's TSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curralis.operators.merge import GraphStore
from curralis.operators.runs import replay_plan

FACTS = "format int, run_id long, layer string, provenance string, nodes array<struct<key: string, label: string, properties: map<string, string>>>, edges array<struct<type: string, source: string, target: string>>"
GOLD = "id string, tipo string, nivel string, etiqueta string, alias string, tema_padre string, seccion string, evidencia string, nota string"


class FactStore:
    """A folder with a sub-folder per run, never written twice."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, run_id: int, layer: str, provenance: str | None, nodes: DataFrame, edges: DataFrame) -> None:
        """nodes (key, label, properties) and edges (type, source, target) of one run; fails if the run is stored already."""
        n = nodes.agg(F.array_sort(F.collect_list(F.struct("key", "label", F.to_json("properties").alias("p")))).alias("n"))
        n = n.select(F.transform("n", lambda x: F.struct(x["key"].alias("key"), x["label"].alias("label"), F.from_json(x["p"], "map<string, string>").alias("properties"))).alias("nodes"))
        e = edges.agg(F.array_sort(F.collect_list(F.struct("type", "source", "target"))).alias("edges"))
        row = n.join(e, F.lit(True)).select(F.lit(1).alias("format"), F.lit(run_id).cast("long").alias("run_id"), F.lit(layer).alias("layer"), F.lit(provenance).cast("string").alias("provenance"), "nodes", "edges")
        row.coalesce(1).write.mode("errorifexists").json(f"{self.path}/run-{run_id:06d}")

    def load(self) -> DataFrame:
        return self.spark.read.schema(FACTS).json(f"{self.path}/run-*")

    def run_ids(self) -> list[int]:
        return [r[0] for r in self.load().select("run_id").orderBy("run_id").collect()]


def batch(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node columns and edges of stored facts."""
    get = lambda name: F.col("n.properties")[name]
    nodes = facts.select(F.explode("nodes").alias("n")).select("n.key", "n.label", get("layer").alias("layer"), get("prefLabelEs").alias("name_es"), get("prefLabelEn").alias("name_en"), get("courseCode").alias("course_code"), get("resourceLocator").alias("locator"), get("description").alias("description"))
    return nodes, facts.select(F.explode("edges").alias("e")).select("e.*")


def reapply(facts: FactStore, events: DataFrame, store: GraphStore) -> list[int]:
    """Writes the stored runs again, in order; refuses orphans and a graph that has institutional nodes. Returns the runs written."""
    stored = facts.load()
    plan = replay_plan(stored, events).orderBy("run_id").collect()  # a row per run
    if orphans := [r.run_id for r in plan if r.action == "orphan"]:
        raise ValueError(f"facts without a run: {orphans}")
    if not store.current().nodes.filter("layer = 'institutional'").isEmpty():
        raise ValueError("the graph has institutional nodes already")
    done = []
    for run in plan:
        if run.action == "write":
            rows = stored.filter(F.col("run_id") == run.run_id)
            layer, provenance = rows.select("layer", "provenance").first()
            store.write_batch(*batch(rows), layer, provenance)
            done.append(run.run_id)
    return done


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Entries of annotation files: a comment line, a header, nine tab-separated columns without quotes; aliases as an array."""
    rows = spark.read.schema(GOLD).option("sep", "\t").option("quote", "").option("comment", "#").option("header", True).option("enforceSchema", True).csv(path)
    aliases = F.filter(F.transform(F.split(F.coalesce("alias", F.lit("")), r"\|"), lambda a: F.trim(a)), lambda a: a != "")
    return rows.withColumn("aliases", aliases)


def gold_problems(rows: DataFrame) -> DataFrame:
    """(id, problem) of entries with a wrong kind, level or section, a repeated id, no label, or a parent that isn't a topic."""
    test = lambda bad, text: F.when(bad, F.lit(text))
    found = F.array(
        test(~F.coalesce(F.col("tipo").isin("tema", "concepto"), F.lit(False)), "kind"), test(~F.coalesce(F.col("nivel").isin("obligatoria", "aceptable"), F.lit(False)), "level"),
        test(~F.coalesce(F.col("seccion").isin("sumilla", "contenidos", "otra"), F.lit(False)), "section"), test(F.coalesce(F.trim("etiqueta"), F.lit("")) == "", "label"),
    )
    each = rows.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))
    twice = rows.groupBy("id").count().filter("count > 1").select("id", F.lit("repeated id").alias("problem"))
    topics = rows.filter("tipo = 'tema'").select(F.col("id").alias("tema_padre"))
    orphans = rows.filter("tema_padre IS NOT NULL AND tema_padre <> ''").join(topics, "tema_padre", "left_anti").select("id", F.lit("parent").alias("problem"))
    return each.union(twice).union(orphans)
