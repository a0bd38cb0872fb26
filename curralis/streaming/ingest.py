"""Structured Streaming over the fact folder: each micro-batch is validated, merged and audited, one run at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curralis.operators import audit
from curralis.operators.merge import GraphStore, WriteMismatch
from curralis.operators.validate import INGESTION_RULES, repeated, validate
from curralis.sources.facts import FACTS, batch


def process(store: GraphStore, rows: DataFrame, record: Callable[[int, str, list], None]) -> bool:
    """Takes the runs of rows (FACTS) in order. Returns False where the audit must stop the queue.

    A batch with violations is rejected whole and the queue goes on; a write that doesn't match is failed with the graph
    as it was; a graph that the audit finds dirty stops the queue.
    """
    for run_id, layer, provenance in rows.select("run_id", "layer", "provenance").orderBy("run_id").collect():  # a row per run
        nodes, edges = batch(rows.filter(F.col("run_id") == run_id))
        record(run_id, "running", [])
        graph = store.current()
        found = repeated(nodes, edges).collect() or validate(graph, nodes, edges, layer, INGESTION_RULES).collect()
        if found:
            record(run_id, "rejected", [tuple(r) for r in found])
            continue
        try:
            store.write_batch(nodes, edges, layer, provenance)
        except WriteMismatch as e:
            record(run_id, "failed", [str(e)])
            continue
        graph = store.current()
        if not audit.is_clean(audit.report(audit.raw_of(graph.nodes, graph.edges))):
            record(run_id, "stopped_by_audit", [])
            return False
        record(run_id, "completed", [])
    return True


def start(spark: SparkSession, folder: str, checkpoint: str, store: GraphStore, record: Callable[[int, str, list], None]) -> StreamingQuery:
    """The running query over folder/run-*; one file at a time keeps the order of runs. Stops itself when the audit closes the gate."""
    rows = spark.readStream.schema(FACTS).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.json").json(f"{folder}/run-*")

    def each(df: DataFrame, _: int) -> None:
        if not process(store, df, record):
            raise RuntimeError("the audit stopped the queue")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
