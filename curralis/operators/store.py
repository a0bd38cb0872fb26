"""The operational store: runs, audit reports, discards and model outputs as append-only Parquet events in one folder.

A control plane of a few rows per document: every call appends one small file per table and reads latest states back. Nothing is
updated in place, so a reader sees a state or its successor. One process writes; states go forward as runs.NEXT says.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from curralis.operators import runs

TABLES = {
    "runs": "run_id long, ordinal long, at double, state string, fields string",
    "reports": "report_id long, ordinal long, at double, origin string, run_id long, violations long",
    "rules": "report_id long, rule string, violations long, sample array<string>",
    "discards": "run_id long, ordinal int, rule string, fact string, message string",
    "rejected": "run_id long, batch string, raw_output string",
    "outputs": "run_id long, output string",
}
ORIGINS = ("load", "ingestion", "reapplication")
RESOURCE_TYPES = ("syllabus",)
PDF = b"%PDF-"


class OperationalStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], TABLES[name])

    def _append(self, name: str, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, TABLES[name]).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    # audit reports

    def open_report(self, origin: str, run_id: int | None = None) -> int:
        if origin not in ORIGINS:
            raise ValueError(f"unknown origin {origin!r}")
        number = (self.table("reports").agg(F.max("report_id")).first()[0] or 0) + 1
        self._append("reports", [(number, 0, time.time(), origin, run_id, None)])
        return number

    def complete_report(self, report_id: int, report: DataFrame) -> None:
        """report: (rule, violations, sample). A report is completed once."""
        found = self.table("reports").filter(F.col("report_id") == report_id).agg(F.count("*"), F.max("ordinal"), F.max("origin"), F.max("run_id")).first()
        if not found[0] or found[1]:
            raise ValueError(f"audit report {report_id} is not open")
        rows = report.select("rule", "violations", "sample").collect()  # one per rule
        self._append("rules", [(report_id, r.rule, r.violations, list(r.sample)) for r in rows])
        self._append("reports", [(report_id, 1, time.time(), found[2], found[3], sum(r.violations for r in rows))])

    def reports(self) -> DataFrame:
        """(report_id, completed, violations), the input of runs.gate()."""
        return self.table("reports").groupBy("report_id").agg((F.max("ordinal") == 1).alias("completed"), F.max("violations").alias("violations"))

    def report(self, report_id: int | None = None) -> DataFrame:
        """(rule, violations, sample) of a report, the latest without a number, in the order of the rules."""
        if report_id is None:
            report_id = self.table("reports").agg(F.max("report_id")).first()[0]
        return self.table("rules").filter(F.col("report_id") == F.lit(report_id)).select("rule", "violations", "sample").orderBy("rule")

    # runs

    def submit(self, documents: DataFrame, resource_type: str, code: str, name: str) -> list[int]:
        """A pending run for each document (path, content) as binaryFile reads them; refuses what is no syllabus in PDF."""
        if resource_type not in RESOURCE_TYPES or not code.strip() or not name.strip():
            raise ValueError("a document needs a known type, and the code and name of its course")
        bad = documents.filter(~(F.lower("path").endswith(".pdf") & (F.substring("content", 1, len(PDF)) == F.lit(bytearray(PDF)))))
        if not bad.isEmpty():
            raise ValueError(f"not a PDF file: {bad.first().path}")
        return [self.create_run(file=r.path, resource_type=resource_type, code=code.strip().upper(), name=name.strip()) for r in documents.select("path").orderBy("path").collect()]

    def create_run(self, **declared) -> int:
        number = (self.table("runs").agg(F.max("run_id")).first()[0] or 0) + 1
        self._append("runs", [(number, 0, time.time(), "pending", json.dumps(declared, sort_keys=True))])
        return number

    def list_runs(self) -> DataFrame:
        """(run_id, state, ordinal) of the runs that weren't withdrawn, in their order."""
        return runs.latest(self.table("runs")).filter("state <> 'withdrawn'").orderBy("run_id")

    def get_run(self, run_id: int) -> Row:
        """run_id, state and ordinal, and the fields that were recorded, the newest value of each."""
        last = self.list_runs().filter(F.col("run_id") == run_id).first()
        if last is None:
            raise KeyError(f"run {run_id} does not exist")
        fields: dict = {}
        for r in self.table("runs").filter(F.col("run_id") == run_id).orderBy("ordinal").collect():  # the states of one run
            fields |= json.loads(r.fields or "{}")
        return Row(**last.asDict(), fields=fields)

    def has_pending(self) -> bool:
        return not runs.oldest_pending(self.table("runs")).isEmpty()

    def take(self) -> int | None:
        """The oldest pending run, now running; None without one."""
        found = runs.oldest_pending(self.table("runs")).first()
        return found and self._move(found.run_id, ("pending",), "running")

    def withdraw(self, run_id: int) -> bool:
        """Whether the run was still pending and is now gone."""
        if self.get_run(run_id).state != "pending":
            return False
        self._move(run_id, ("pending",), "withdrawn")
        return True

    def _move(self, run_id: int, expected: tuple[str, ...], state: str | None = None, **fields) -> int:
        last = self.get_run(run_id)
        if last.state not in expected:
            raise ValueError(f"run {run_id} is not {' or '.join(expected)}")
        self._append("runs", [(run_id, last.ordinal + 1, time.time(), state or last.state, json.dumps(fields, sort_keys=True))])
        return run_id

    def record_extraction(self, run_id: int, output: dict | None = None, **fields) -> None:
        """Model, settings, tokens and so on of a running run, and what the model returned."""
        self._move(run_id, ("running",), **fields)
        if output is not None:
            self._append("outputs", [(run_id, json.dumps(output, ensure_ascii=False))])

    def reject(self, run_id: int, discards: list[tuple[str, str, str]], batch: dict | None = None, raw_output: str | None = None) -> None:
        """discards: (rule, fact, message), at least one."""
        if not discards:
            raise ValueError("a rejected run has at least one discard")
        self._move(run_id, ("running",), "rejected")
        self._append("discards", [(run_id, k, *d) for k, d in enumerate(discards)])
        self._append("rejected", [(run_id, json.dumps(batch, ensure_ascii=False) if batch else None, raw_output)])

    def fail(self, run_id: int, error: str) -> None:
        self._move(run_id, ("running",), "failed", error=error)

    def mark_written(self, run_id: int) -> None:
        self._move(run_id, ("running",), "written_not_persisted")

    def finish(self, run_id: int, clean: bool) -> None:
        self._move(run_id, ("written_not_persisted",), "completed" if clean else "stopped_by_audit")

    def discards_of(self, run_id: int) -> DataFrame:
        return self.table("discards").filter(F.col("run_id") == run_id).orderBy("ordinal").select("rule", "fact", "message")

    def rejected_output_of(self, run_id: int) -> tuple[dict | None, str | None]:
        row = self.table("rejected").filter(F.col("run_id") == run_id).first()
        if row is None:
            raise KeyError(f"run {run_id} has no rejected output")
        return (json.loads(row.batch) if row.batch else None), row.raw_output

    def model_output_of(self, run_id: int) -> dict | None:
        row = self.table("outputs").filter(F.col("run_id") == run_id).first()
        return json.loads(row.output) if row else None
