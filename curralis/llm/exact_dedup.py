"""Exact deduplication by counting quotient filters.

Each task of the first pass puts the fingerprints of its rows into counting quotient filters, one per segment of the
fingerprint space; filters of a segment merge without loss by their sorted remainders. Only rows whose fingerprint
counts above one go to the second pass, which groups them by their whole normalised bytes.

Defined cases: a null text counts as empty; equal means identical after lower-casing A-Z only; the row with the largest
doc_id stays (null sorts below all); rows that repeat both doc_id and text are one document listed twice: they count in
group_size and stand or fall together. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curralis.llm.common import ascii_lower, lean, written

#: Bits of a fingerprint (the head of the SHA-256); of these the first SEGMENT_BITS choose the filter's segment.
BITS, SEGMENT_BITS = 62, 10


class CountingQuotientFilter:
    """A multiset of r+q bit fingerprints, kept as remainders in runs by quotient, with a counter in each slot.

    occupied has a bit per quotient, runend a bit per slot; slots of a run are sorted, so that filters merge as sorted
    lists do, and the merged filter holds the exact sums of the counts.
    """

    def __init__(self, q: int, r: int, occupied, runend, used, remainder, count):
        self.q, self.r, self.occupied, self.runend, self.used, self.remainder, self.count = q, r, occupied, runend, used, remainder, count

    @classmethod
    def of(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From sorted distinct fingerprints of so many bits (uint64) and their counts."""
        n = len(values)
        q = min(bits, max(1, int(n * 1.25).bit_length()))
        r = bits - q
        quotient = (values >> np.uint64(r)).astype(np.int64)
        rank = np.arange(n)
        slot = np.maximum.accumulate(quotient - rank) + rank if n else rank
        slots = max(1 << q, int(slot[-1]) + 1 if n else 0)
        occupied, runend, used = np.zeros(1 << q, bool), np.zeros(slots, bool), np.zeros(slots, bool)
        remainder, count = np.zeros(slots, np.uint64), np.zeros(slots, np.int64)
        occupied[quotient] = True
        used[slot] = True
        runend[slot[np.append(quotient[1:] != quotient[:-1], True)] if n else slot] = True
        remainder[slot] = values & np.uint64((1 << r) - 1)
        count[slot] = counts
        return cls(q, r, occupied, runend, used, remainder, count)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted fingerprints and their counts."""
        slot, quotients = np.flatnonzero(self.used), np.flatnonzero(self.occupied).astype(np.uint64)
        ends = self.runend[slot]
        run = np.cumsum(ends) - ends
        return (quotients[run] << np.uint64(self.r)) | self.remainder[slot], self.count[slot]

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter], bits: int) -> CountingQuotientFilter:
        """The filter of all fingerprints together: runs of sorted remainders are merged and equal ones' counts added."""
        parts = [f.items() for f in filters]
        values, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(values, kind="stable")  # merges the sorted runs
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, int)
        return cls.of(values[first], np.add.reduceat(counts, first) if len(first) else counts, bits)

    def pack(self) -> bytes:
        width = 8 if self.r > 32 else 4
        return b"".join((
            np.array([self.q, self.r, len(self.used)], np.int64).tobytes(), np.packbits(self.occupied).tobytes(), np.packbits(self.runend).tobytes(), np.packbits(self.used).tobytes(),
            self.remainder[self.used].astype(f"u{width}").tobytes(), self.count[self.used].tobytes(),
        ))

    @classmethod
    def unpack(cls, data: bytes) -> CountingQuotientFilter:
        q, r, slots = (int(x) for x in np.frombuffer(data, np.int64, 3))
        at, bitmaps = 24, []
        for size in (1 << q, slots, slots):
            bitmaps.append(np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, at))[:size].astype(bool))
            at += (size + 7) // 8
        n, width = int(bitmaps[2].sum()), 8 if r > 32 else 4
        remainder, count = np.zeros(slots, np.uint64), np.zeros(slots, np.int64)
        remainder[bitmaps[2]] = np.frombuffer(data, f"u{width}", n, at)
        count[bitmaps[2]] = np.frombuffer(data, np.int64, n, at + n * width)
        return cls(q, r, *bitmaps, remainder, count)


def _digests(texts: pa.Array) -> list[tuple[bytes, bytes]]:
    """Normalised bytes and SHA-256 of each text. bytes.lower() changes A-Z only."""
    out = []
    for x in texts.cast(pa.binary()).to_pylist():
        low = (x or b"").lower()
        out.append((low, hashlib.sha256(low).digest()))
    return out


def _prints(digests, bits: int) -> np.ndarray:
    return np.array([int.from_bytes(d[:8], "big") >> (64 - bits) for _, d in digests], np.int64)


def repeated_fingerprints(prints: DataFrame, bits: int, segment_bits: int) -> DataFrame:
    """(fp, n) of the fingerprints that count above one in all of prints (fp)."""
    low = bits - segment_bits

    def build(batches):
        values = np.concatenate([np.zeros(0, np.uint64), *(b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) for b in batches)])
        values, counts = np.unique(values, return_counts=True)
        segment = values >> np.uint64(low)
        edges = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(values) else np.zeros(0, int)
        names, packed = [], []
        for a, b in zip(edges, np.append(edges[1:], len(values))):
            names.append(int(segment[a]))
            packed.append(CountingQuotientFilter.of(values[a:b] & np.uint64((1 << low) - 1), counts[a:b], low).pack())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(packed, pa.binary())], names=["segment", "filter"])

    def merge(batches):
        # a task holds a fixed share of the fingerprint space, segment by segment in order
        at, held = None, []

        def flush():
            values, counts = CountingQuotientFilter.merged(held, low).items()
            more = counts > 1
            return pa.RecordBatch.from_arrays([pa.array((values[more] | np.uint64(at << low)).astype(np.int64)), pa.array(counts[more])], names=["fp", "n"])

        for batch in batches:
            for segment, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if segment != at and held:
                    yield flush()
                    held = []
                at = segment
                held.append(CountingQuotientFilter.unpack(data))
        if held:
            yield flush()

    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prints.mapInArrow(build, "segment long, filter binary").repartition(parts, "segment").sortWithinPartitions("segment").mapInArrow(merge, "fp long, n long")


def exact_groups(docs: DataFrame, bits: int = BITS, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs (doc_id, text)."""

    def slim(batches):
        for b in batches:
            digests = _digests(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_prints(digests, bits)), pa.array([d.hex() for _, d in digests])], names=["doc_id", "fp", "text_sha256"])

    def full(batches):
        for b in batches:
            digests = _digests(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_prints(digests, bits)), pa.array([d for _, d in digests], pa.binary()), pa.array([t for t, _ in digests], pa.binary())], names=["doc_id", "fp", "sha", "norm"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prints = written(docs.mapInArrow(lean("exact", slim), "doc_id long, fp long, text_sha256 string"), "exact-prints")
    repeated = repeated_fingerprints(prints.select("fp"), bits, segment_bits)
    # rows of a repeated fingerprint only; a hot fingerprint's side of this join is split by adaptive execution, and
    # the bytes are combined on the map side, so that a group is one row per task
    routed = docs.mapInArrow(lean("exact", full), "doc_id long, fp long, sha binary, norm binary").join(repeated.select("fp"), "fp", "left_semi")
    groups = routed.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.min("sha").alias("sha")).filter("group_size > 1")
    groups = groups.select(F.lower(F.hex("sha")).alias("text_sha256"), "keep_id", "group_size")
    out = prints.join(groups, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame) -> DataFrame:
    """docs without the rows that an equal text of a larger doc_id stands for; columns stay."""
    gone = exact_groups(docs).filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_of")).distinct()
    # by row, not by doc_id alone: other texts under the same doc_id, or under none, are documents of their own
    of = F.sha2(ascii_lower(F.coalesce(docs.text.cast("string"), F.lit(""))), 256)
    return docs.join(gone, docs.doc_id.eqNullSafe(gone["gone_id"]) & (of == gone["gone_of"]), "left_anti")
