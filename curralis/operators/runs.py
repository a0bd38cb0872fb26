"""Run queue and state machine as an append-only table of events, the audit gate, and the plan of a replay.

events (run_id, ordinal, state): the states that runs went through, in the order of ordinal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATES = ("pending", "running", "completed", "rejected", "failed", "written_not_persisted", "stopped_by_audit")
#: What may follow what; a run begins pending, final states have no successor.
NEXT = {"pending": ("running",), "running": ("completed", "rejected", "failed", "written_not_persisted", "stopped_by_audit")}


def latest(events: DataFrame) -> DataFrame:
    """(run_id, state, ordinal): each run's last state. Combined on the map side, no window over a run's whole history."""
    return events.groupBy("run_id").agg(F.max_by("state", "ordinal").alias("state"), F.max("ordinal").alias("ordinal"))


def violations(events: DataFrame) -> DataFrame:
    """(run_id, ordinal, previous, state) of the steps that the state machine doesn't allow."""
    rows = events.withColumn("previous", F.lag("state").over(Window.partitionBy("run_id").orderBy("ordinal")))
    allowed = F.when(F.col("previous").isNull(), F.col("state") == "pending")
    for state, after in NEXT.items():
        allowed = allowed.when(F.col("previous") == state, F.col("state").isin(*after))
    return rows.filter(~allowed.otherwise(F.lit(False))).select("run_id", "ordinal", "previous", "state")


def oldest_pending(events: DataFrame) -> DataFrame:
    """(run_id): the pending run to take next, if any."""
    return latest(events).filter("state = 'pending'").agg(F.min("run_id").alias("run_id")).filter("run_id IS NOT NULL")


def counts_by_state(events: DataFrame) -> DataFrame:
    return latest(events).groupBy("state").agg(F.count("*").alias("n"))


def gate(reports: DataFrame) -> DataFrame:
    """(gate): open or why it is closed, by the last audit report (report_id, completed, violations)."""
    last = reports.agg(F.max_by(F.struct("completed", "violations"), "report_id").alias("r"))
    return last.select(F.when(F.col("r").isNull(), "closed: no audit").when(~F.col("r.completed"), "closed: audit not completed").when(F.col("r.violations") > 0, "closed: violations").otherwise("open").alias("gate"))


def replay_plan(facts: DataFrame, events: DataFrame) -> DataFrame:
    """(run_id, action) of stored facts (run_id): write, skip (stopped by the audit) or orphan (no such run), to be done in the order of run_id."""
    rows = facts.select("run_id").distinct().join(latest(events), "run_id", "left")
    return rows.select("run_id", F.when(F.col("state").isNull(), "orphan").when(F.col("state") == "stopped_by_audit", "skip").otherwise("write").alias("action"))


def cut_before(tables: dict[str, DataFrame], run_id: int) -> dict[str, DataFrame]:
    """The tables (each with run_id) as they were before a run."""
    return {name: df.filter(F.col("run_id") < run_id) for name, df in tables.items()}
