"""Measuring the navigation questions from single starting nodes, and what their plans read."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curralis.operators import navigation
from curralis.operators.evaluate import latency_summary
from curralis.schema import LEVELS, Graph

ROUNDS = 3
Ask = Callable[[Graph, DataFrame], DataFrame]
#: Question: classes of its starting nodes, and the question in each of its grains.
PATTERNS: dict[str, tuple[tuple[str, ...], tuple[Ask, ...]]] = {
    "course_prerequisites": (("Course",), (navigation.course_prerequisites,)),
    "location": (("Concept",), (navigation.element_location,)),
    "resources": ((*LEVELS, "Course"), (navigation.element_resources,)),
    "path": ((*LEVELS, "Course"), tuple(lambda g, s, grain=grain: navigation.learning_path(g, grain, s) for grain in ("topic", "area", "course"))),
    "specializations": (("Concept",), (navigation.concept_specializations,)),
}


def _ms(df: Callable[[], DataFrame]) -> int:
    """Milliseconds to plan and run a question, without bringing its rows to the driver."""
    began = time.perf_counter()
    df().write.format("noop").mode("overwrite").save()
    return round(1000 * (time.perf_counter() - began))


def times(graph: Graph, pattern: str, keys: list[str], rounds: int = ROUNDS) -> DataFrame:
    """(pattern, key, grain, round, ms): every starting node once per round, so that two runs of one have all others between them; round 0 warms up."""
    spark: SparkSession = graph.spark
    asks = PATTERNS[pattern][1]
    rows = []
    for n in range(rounds + 1):
        for key in keys:
            start = spark.createDataFrame([(key,)], "root string")
            rows += [(pattern, key, at, n, _ms(lambda ask=ask: ask(graph, start))) for at, ask in enumerate(asks)]
    return spark.createDataFrame(rows, "pattern string, key string, grain int, round int, ms long")


def summary(measured: DataFrame) -> DataFrame:
    """latency_summary of the rounds behind the warm-up, with the first, cold time."""
    cold = measured.filter("round = 0").groupBy("pattern").agg(F.min_by("ms", F.struct("key", "grain")).alias("cold_ms"))
    return latency_summary(measured.filter("round > 0").select("pattern", "ms")).join(cold, "pattern")


def plan_facts(df: DataFrame) -> dict[str, list[str]]:
    """The operators of df's plan; scans of a partitioned table that no partition filter narrows; joins that compare every pair."""
    text = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = re.findall(r"^\(\d+\) ([A-Z]\w+)(.*(?:\n(?!\(\d+\) |\n).*)*)", text, re.M)
    wide = [body.split("\n")[0].strip() or name for name, body in nodes if name == "Scan" and "PartitionFilters" not in body and "InMemoryFileIndex" in body]
    return {"operators": sorted({name for name, _ in nodes}), "full_scans": wide, "pair_joins": sorted({name for name, _ in nodes if name in ("CartesianProduct", "BroadcastNestedLoopJoin")})}
