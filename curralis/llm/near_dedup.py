"""Near-duplicate detection: MinHash banding, signature verification, exact confirmation, star-contraction components.

1. Every document's distinct word shingles are hashed to 64 bits; documents of equal sets collapse to one class, named
   by the head of its set's digest, so that different texts under one doc_id are different classes.
2. BANDS x ROWS universal hash minima per class; classes that share a band's key meet in its bucket. A pair of
   similarity 0.8 misses all buckets with a probability of 1.3e-7, one of 0.85 with 6e-11.
3. Each bucket first offers its members against its smallest one (linear in its size). What the signature leaves
   possible (SLACK below the threshold: over five standard deviations) is confirmed on the full sets.
4. Components by alternating large-star and small-star, named at the end by their smallest doc_id. Only members of a bucket that are still in different components can matter to
   the result, so those are compared next: small buckets as pairs, large ones block by block
   inside tasks, on signatures and full sets, which return only links that join two components.

Defined cases: a null text or one without words has no set and is linked with nothing; fewer words than a shingle's
count as one shingle; equal texts, ties and repeated rows share a class, as their sets are equal; rows without a
doc_id are passed over (they get a null component and stay), save for those whose set is that of a document with an id: they are
copies of it. Rows are dropped by doc_id and text, so that others with the same doc_id, or with none, stay. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curralis.llm.common import holds, lean, written

BANDS, ROWS, SEED, SLACK = 40, 5, 11, 0.15
#: Buckets up to SMALL members are compared as pairs; larger ones in blocks of BLOCK members by STRAGGLERS.
SMALL, BLOCK, STRAGGLERS = 16, 2048, 512
#: Ids are broadcast up to this many (8 MB as numbers).
SENT = 1_000_000
TABLE = 250_000
#: A bucket's rows meet what is known of their bucket in so many parts, so that a large one is no single task's.
PARTS = 16
_hashes: dict[bytes, int] = holds("near", {})
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each whole text: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+."""
    cut = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]  # bytes: A-Z and ASCII white space only
    need = set().union(*cut)
    if new := need - _hashes.keys():
        if len(_hashes) + len(new) > TABLE:
            _hashes.clear()
            new = need
        digest = xxhash.xxh3_64_intdigest
        _hashes.update((w, digest(w)) for w in new)
    out, get = [], _hashes.__getitem__
    for words in cut:
        h = np.fromiter(map(get, words), np.uint64, len(words))
        w = min(width, len(h))
        if w:
            n = len(h) - w + 1
            total = np.full(n, w, np.uint64)
            for k in range(w):
                total = _mixed(total + h[k : k + n] * _MULTIPLIERS[k % 8])
            h = np.unique(total)
        out.append(h)
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of universal hashes (a x + b mod 2^64, its upper half)."""
    rng = np.random.default_rng(SEED)
    a, b = (rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):  # stays in cache
        least = np.minimum(least, (a * shingles[None, at : at + 512] + b).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    rows = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = _mixed(key + rows[:, :, k] * _MULTIPLIERS[k])
    return key.astype(np.int64)


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (doc, ...) whose doc is in ids (doc). Up to SENT ids are broadcast, so that rows need no shuffle; more are joined."""
    return rows.join(F.broadcast(ids) if ids.count() <= SENT else ids, "doc", "left_semi")


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _digest():
    """Tells apart the texts that share a doc_id."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256), 1, 32))


def classes_of(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig, digest of the text) of every document; set_key and sig are null where there is no set."""

    def task(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = shingle_sets(part.column(1).to_pylist(), width)
                keys = [_key(s) if len(s) else None for s in sets]
                sigs = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), part.column(2)], names=["doc_id", "n_shingles", "set_key", "sig", "digest"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _digest().alias("digest"))
    return rows.mapInArrow(lean("near", task), "doc_id long, n_shingles long, set_key binary, sig binary, digest binary")


def _buckets(reps: DataFrame) -> DataFrame:
    """(bk, doc) of every band of every class (doc, sig)."""

    def task(batches):
        for b in batches:
            sigs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(sigs).ravel()), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["bk", "doc"])

    return reps.select("doc", "sig").mapInArrow(lean("near", task), "bk long, doc long")


def _likely(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Of distinct pairs (a, b), those that their signatures (doc, sig) don't rule out."""

    def task(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for k in (2, 3))
            keep = np.flatnonzero((x == y).mean(axis=1) >= threshold - SLACK)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

    sigs = _only(sigs, _ends(pairs))
    one, two = sigs.select(F.col("doc").alias("a"), F.col("sig").alias("sig_a")), sigs.select(F.col("doc").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(lean("near", task), "a long, b long")


def _of_buckets(rows: DataFrame, few: DataFrame) -> DataFrame:
    """rows (bk, doc, ...) joined with few (bk, ...), a row per bucket of several members, which is sent to each part of its bucket."""
    part = F.pmod(F.xxhash64("doc"), F.lit(PARTS)).cast("int")
    every = few.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("part", part).join(every, ["bk", "part"]).drop("part")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether den * intersection >= num * union of two sorted sets."""
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b), those with den * intersection >= num * union on the full sets (doc, shingles)."""

    def task(batches):
        for batch in batches:
            sets = zip(batch.column(2), batch.column(3))
            keep = [k for k, (x, y) in enumerate(sets) if _linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den)]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], names=["a", "b"])

    one, two = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("set_a")), sets.select(F.col("doc").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(lean("near", task), "a long, b long")


def _sets(docs: DataFrame, reps: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc, shingles) of the classes in ids (doc), from the documents that name them in reps (doc, name)."""

    def task(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [s for s in shingle_sets(part.column(1).to_pylist(), width) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(_key(s)[:8], "big", signed=True) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string"))
    names = _only(reps.select("doc", "name"), ids).select(F.col("name").alias("doc")).distinct()
    # a doc_id may name several texts: those of other classes are left out by the joins that follow
    return _only(rows, names).mapInArrow(lean("near", task), "doc long, shingles binary").dropDuplicates(["doc"])


def components(edges: DataFrame) -> DataFrame:
    """(doc, comp) of the nodes of edges (a, b): comp is the smallest node that can be reached. Alternates large-star and small-star."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = written(small.filter("a <> b").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("doc"), F.col("b").alias("comp"))
        seen = now


def _open_buckets(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows (bk, doc, comp, m, main) of the buckets whose members are in several components; main: the one with most of them."""
    rows = rows.join(comps, "doc", "left").select("bk", "doc", F.coalesce("comp", "doc").alias("comp"))
    each = rows.groupBy("bk", "comp").agg(F.count("*").alias("n"))
    open_ = each.groupBy("bk").agg(F.sum("n").alias("m"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("k")).filter("k > 1").drop("k")
    return _of_buckets(rows, open_)


def _between(rows: DataFrame, held: DataFrame, num: int, den: int) -> DataFrame:
    """Confirmed links (a, b) between different components within large buckets; held: (doc, sig, shingles) of their members.

    Every straggler (a member outside its bucket's main component) meets every other member, in blocks. A pair counts
    in the first band that its documents share. Only links that join two components that were still apart in the block are returned.
    """
    counts = rows.groupBy("bk").agg(F.count_if(F.col("comp") != F.col("main")).alias("r"))
    rows = _of_buckets(rows, counts).join(held, "doc")
    cm, cs = F.ceil(F.col("m") / BLOCK).cast("int"), F.ceil(F.col("r") / STRAGGLERS).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    key = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    members = rows.select("bk", "doc", "comp", "main", "sig", "shingles", key(cm).alias("cm"), every(cs).alias("cs"))
    lone = rows.filter("comp <> main").select("bk", "doc", "comp", "main", "sig", "shingles", key(cs).alias("cs"), every(cm).alias("cm"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    threshold = num / den

    def block(_, x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return out.empty_table()
        sig = lambda t: np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
        sets = lambda t: [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
        sx, sy, hx, hy = sig(x), sig(y), sets(x), sets(y)
        dy, cy = y.column("doc").to_pylist(), y.column("comp").to_numpy()
        in_main, ids = cy == y.column("main").to_numpy(), y.column("doc").to_numpy()
        band = int(np.flatnonzero(band_keys(sx[0])[0] == x.column("bk")[0].as_py())[0])
        parent: dict[int, int] = {}

        def find(c):
            while c in parent:
                c = parent[c]
            return c

        a, b = [], []
        for k, (d, c) in enumerate(zip(x.column("doc").to_pylist(), x.column("comp").to_pylist())):
            other = np.flatnonzero((cy != c) & (in_main | (ids > d)))
            same = sy[other] == sx[k]
            like, first = same.mean(axis=(1, 2)), same.all(axis=2).argmax(axis=1)
            hit = np.flatnonzero((like >= threshold - SLACK) & (first == band))
            for i in other[hit[np.argsort(-like[hit], kind="stable")]].tolist():
                one, two = find(c), find(int(cy[i]))
                if one != two and _linked(hx[k], hy[i], num, den):
                    parent[max(one, two)] = min(one, two)
                    a.append(d)
                    b.append(dy[i])
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

    keys = ("bk", "cs", "cm")
    lone = lone.toDF(*lone.columns)  # columns of its own, as both sides come from rows
    return lone.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(block, "a long, b long")


def _groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """near_groups, and the digest of each row's text."""
    threshold = num / den
    rows = written(classes_of(docs, width), "shingle-classes")
    known = rows.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    reps = written(known.groupBy("set_key").agg(F.min("doc_id").alias("name"), F.first("sig").alias("sig")).withColumn("doc", F.conv(F.hex(F.substring("set_key", 1, 8)), 16, -10).cast("long")), "classes")
    sigs = reps.select("doc", "sig")
    buckets = _buckets(reps)
    heads = buckets.groupBy("bk").agg(F.min("doc").alias("head"), F.count("*").alias("m")).filter("m > 1")
    shared = written(_of_buckets(buckets, heads), "buckets")

    def confirmed(pairs, name):
        likely = written(_likely(written(pairs.distinct(), f"pairs-{name}"), sigs, threshold), f"likely-{name}")
        return written(_confirmed(likely, _sets(docs, reps, _ends(likely), width), num, den), f"links-{name}")

    links = confirmed(shared.filter("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b")), "heads")
    comps = components(links)
    rest = written(_open_buckets(shared.select("bk", "doc"), comps), "open-buckets")
    few, big = rest.filter(F.col("m") <= SMALL), rest.filter(F.col("m") > SMALL)
    x, y = few.select("bk", F.col("doc").alias("a"), F.col("comp").alias("ca")), few.select("bk", F.col("doc").alias("b"), F.col("comp").alias("cb"))
    more = confirmed(x.join(y, "bk").filter("ca <> cb and a < b").select("a", "b"), "small")
    ids = written(big.select("doc").distinct(), "straggler-ids")
    held = _only(sigs, ids).join(_sets(docs, reps, ids, width), "doc")
    more = more.union(written(_between(big, held, num, den), "links-between"))
    if not more.isEmpty():
        comps = components(links.union(more))
    named = reps.select("set_key", "doc", "name").join(comps, "doc", "left").select("set_key", "name", F.coalesce("comp", "doc").alias("comp"))
    named = named.join(named.groupBy("comp").agg(F.min("name").alias("component_id")), "comp").select("set_key", "component_id")
    out = rows.join(named, "set_key", "left")
    comp = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"), "digest")


def near_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs: components of den * |intersection| >= num * |union|."""
    return _groups(docs, width, num, den).drop("digest")


def drop_near(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component, that with the smallest doc_id; columns stay."""
    gone = _groups(docs, width, num, den).filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_of")).distinct()
    return docs.join(gone, docs.doc_id.eqNullSafe(gone["gone_id"]) & (_digest() == gone["gone_of"]), "left_anti")
