"""Removes multi-line passages that repeat across the corpus, whole: every run of two lines or of LONG words that stands elsewhere too.

A window is a pair of neighbouring lines with text (and the blank lines between them), or one line of LONG words or
more; where it starts and ends depends on its own lines only, so that a passage is cut alike wherever it stands. A run of
lines repeats if and only if all of its windows do: what the repeated windows cover is the repeated runs from their first line
to their last one, with no seed that a run could miss. Windows whose digest repeats anywhere are compared byte by
byte; of equal ones the first by (doc_id, digest of the text, place) stays and all others are removed with their lines.
Every removed line stands once more in the text of an earlier copy, which may itself be split where another
run overlaps it; a window that overlaps its own first copy loses only the lines behind that.

Defined cases: null texts stay null; empty texts and texts without a repeated window stay byte for byte; a text that
is removed whole becomes empty; rows that repeat both doc_id and text are one document, cut alike; other texts under the same
doc_id, or under none, are documents of their own; an empty table stays empty. Columns besides doc_id and text pass through.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curralis.llm.common import lean, written

LONG = 50
#: Ids of texts with candidates are broadcast up to this many, so that only those texts are shuffled; beyond, all are.
SENT = 150_000


def windows(lines: list[str]) -> list[tuple[int, int]]:
    """[start, end) of the windows of a document's lines."""
    held = [k for k, line in enumerate(lines) if line and not line.isspace()]
    return [(a, b + 1) for a, b in zip(held, held[1:])] + [(k, k + 1) for k in held if len(lines[k].split()) >= LONG]


def _digest() -> Column:
    """Tells apart the texts that share a doc_id."""
    return F.unhex(F.substring(F.sha2("text", 256), 1, 32))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, start, end) of the lines of every window to remove."""

    def slim(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                for doc_id, text, digest in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                    lines = (text or "").split("\n")
                    raw = [x.encode("utf-8", "surrogatepass") for x in lines]
                    rows += [(doc_id, digest, a, b, hashlib.sha256(b"\n".join(raw[a:b])).digest()[:16]) for a, b in windows(lines)]
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "digest", "start", "end", "sha"])

    def full(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                rows = []
                for doc_id, digest, text, spans in zip(*(c.to_pylist() for c in batch.slice(at, 100).columns)):
                    lines = [x.encode("utf-8", "surrogatepass") for x in text.split("\n")]
                    rows += [(doc_id, digest, s["start"], s["end"], s["sha"], b"\n".join(lines[s["start"] : s["end"]])) for s in spans]
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "digest", "start", "end", "sha", "body"])

    schema = "doc_id long, digest binary, start int, end int, sha binary"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("digest", _digest())
    every = written(rows.mapInArrow(lean("lines", slim), schema), "windows")
    repeated = every.groupBy("sha").agg(F.count("*").alias("n")).filter("n > 1").select("sha")
    likely = written(every.join(repeated, "sha", "left_semi").select(*every.columns), "repeated-windows")
    spans = written(likely.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "end", "sha")).alias("spans")), "texts-with-windows").toDF("id", "of", "spans")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of"))
    if spans.count() <= SENT:  # ids alone are sent, 24 bytes each; the windows of long texts may be many
        rows = rows.join(F.broadcast(spans.select("id", "of")), same, "left_semi")
    held = rows.join(spans, same).select("doc_id", "digest", "text", "spans")
    # equal bytes are combined on the map side: a frequent window is one row per task
    first = F.min(F.struct("doc_id", "digest", "start", "end")).alias("first")
    groups = held.mapInArrow(lean("lines", full), f"{schema}, body binary").groupBy("body").agg(first, F.count("*").alias("n"), F.min("sha").alias("sha")).filter("n > 1").select("sha", "first")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    start = F.when(own, F.greatest("start", "first.end")).otherwise(F.col("start")).alias("start")
    return likely.join(groups, "sha").select("doc_id", "digest", start, "end").filter("start < end")


def drop_repeated_chunks(docs: DataFrame) -> DataFrame:
    """docs with the repeated passages cut out of the texts, and the number of lines removed (n_removed)."""
    docs = docs.drop("n_removed")
    name = "gone" + "_" * max(map(len, docs.columns))  # a name of its own
    gone = repeated_windows(docs).groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "end")).alias("gone")).toDF("gone_id", "gone_of", name)
    joined = docs.join(gone, docs.doc_id.eqNullSafe(gone["gone_id"]) & (_digest() == gone["gone_of"]), "left").drop(gone["gone_id"], gone["gone_of"])
    at, last = docs.columns.index("text"), len(docs.columns)

    def task(batches):
        for batch in batches:
            texts, removed = [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist()):
                out = 0
                if text and gone:
                    cut = {i for s in gone for i in range(s["start"], s["end"])}
                    text, out = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in cut), len(cut)
                texts.append(text)
                removed.append(out)
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns[:last])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], names=[*batch.schema.names[:last], "n_removed"])

    return joined.mapInArrow(lean("lines", task), docs.withColumn("n_removed", F.lit(0).cast("long")).schema)
