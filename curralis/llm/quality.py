"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer numpy network on top.

Every word has a sparse random index vector; a word's vector is the sum of the index vectors met around it in the
training texts. Two vocabularies are indexed so: hashed words, and marks of a word's form (case, symbols, digits, being the word
before it again). A document is the mean word vector beside the mean mark vector of its whole text. The network's
logit is divided by a temperature fitted on rows kept out of its training, so that scores are calibrated.

Training reads at most SAMPLE labelled rows, those with the smallest hash of doc_id: a bound on what is fitted, stated
here; scoring reads every row. Word and mark vectors are of fixed size, so what is broadcast doesn't grow with the data.

Defined cases: a null or empty text is scored too, as the zero vector; texts of any length are scored whole; rows without labels of
0 or 1 don't train; of several texts under one labelled doc_id the greatest trains, of several labels 1; with no or one class of labels to
train on, every score is that class's share (0.5 without any); repeated rows are scored alike; an empty table stays empty; columns
besides doc_id and text pass through, save for one named score, which the result replaces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curralis.llm.common import holds, lean, written

SAMPLE, BUCKETS, MARKS, DIMS, NONZERO, WINDOW, HIDDEN, SEED = 8_000, 1 << 14, 64, 64, 8, 2, 32, 7
#: Most words that a worker's table holds before it starts anew.
TABLE = 250_000
_PUNCTUATION = ".,;:?'\"()[]{}-_/\\|!@#$%^&*+=<>~`"
_table: dict[str, int] = holds("quality", {})


def index_vectors() -> np.ndarray:
    """Sparse ternary index vectors: BUCKETS of words, then MARKS of forms."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS + MARKS, DIMS), np.float32)
    for row in out:
        row[rng.choice(DIMS, NONZERO, replace=False)] = rng.choice((-1.0, 1.0), NONZERO)
    return out


def _code(word: str) -> int:
    """Bucket of the bare word, and bits of its form: upper case, title case, digits, symbols before, inside or behind it, no letters."""
    bare = word.strip(_PUNCTUATION)
    ends = word[word.find(bare) + len(bare) :] if bare else word
    odd = any(c in "!@#$%^&*+=<>~`|_\\" for c in word.replace(bare, "", 1)) if bare else True
    form = (len(bare) > 1 and bare.isupper()) | (bare[:1].isupper() << 1) | (any(c.isdigit() for c in bare) << 2) | (odd << 3) | ((len(ends) > 1) << 4)
    return zlib.crc32(bare.lower().encode()) % BUCKETS << 5 | form


def tokens(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each whole text its words' buckets and marks (the form, and whether it is the word before it again)."""
    cut = [t.split() for t in texts]
    need = set().union(*cut)
    if new := need - _table.keys():
        if len(_table) + len(new) > TABLE:
            _table.clear()
            new = need
        _table.update((w, _code(w)) for w in new)
    out, get = [], _table.__getitem__
    for words in cut:
        codes = np.fromiter(map(get, words), np.int32, len(words))
        word, mark = codes >> 5, codes & 31
        mark[1:] |= (word[1:] == word[:-1]).astype(np.int32) << 5
        out.append((word, mark))
    return out


def _around(vectors: np.ndarray) -> np.ndarray:
    """For each place the sum of the vectors up to WINDOW places before and behind it."""
    out = np.zeros_like(vectors)
    for step in range(1, WINDOW + 1):
        out[step:] += vectors[:-step]
        out[:-step] += vectors[step:]
    return out


def word_vectors(sample: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets and marks, from the contexts in sample (text); summed by blocks of buckets."""
    step = 1024

    def contexts(batches):
        index, total = index_vectors(), np.zeros((BUCKETS + MARKS, DIMS), np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for word, mark in tokens([t or "" for t in batch.column(0).slice(at, 200).to_pylist()]):
                    if len(word):
                        near, forms = _around(index[word]), index[BUCKETS + mark]
                        np.add.at(total, word, near)
                        np.add.at(total, BUCKETS + mark, _around(forms) + forms)
        starts = range(0, len(total), step)
        yield pa.RecordBatch.from_arrays([pa.array(list(starts), pa.int32()), pa.array([total[a : a + step].tobytes() for a in starts], pa.binary())], names=["block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.float32) for x in table.column(1).to_pylist()]
        return pa.table({"block": table.column(0)[:1], "sums": pa.array([np.sum(parts, axis=0, dtype=np.float32).tobytes()], pa.binary())})

    schema = "block int, sums binary"
    blocks = sorted(sample.select("text").mapInArrow(lean("quality", contexts), schema).groupBy("block").applyInArrow(add, schema).collect())  # of fixed size
    out = np.concatenate([np.frombuffer(b[1], np.float32) for b in blocks]).reshape(-1, DIMS) if blocks else np.zeros((BUCKETS + MARKS, DIMS), np.float32)
    out = np.where(np.abs(out).sum(axis=1, keepdims=True) > 0, out, index_vectors())
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), 2 * DIMS), np.float32)
    for k, (word, mark) in enumerate(tokens(texts)):
        if len(word):
            out[k, :DIMS] = vectors[word].mean(axis=0)
            out[k, DIMS:] = np.bincount(mark, minlength=MARKS).astype(np.float32) @ vectors[BUCKETS:] / len(mark)
    return out


class Network:
    """Two layers: tanh, then a logit; inputs standardised, Adam on batches, the temperature fitted on every fifth row."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4):
        self.share = float(y.mean()) if len(y) else 0.5
        self.flat = len(set(y.tolist())) < 2
        self.temperature = 1.0
        if self.flat:
            return
        rng = np.random.default_rng(SEED)
        held = np.arange(len(y)) % 5 == 4
        fit = ~held if 0 < y[~held].mean() < 1 else np.ones(len(y), bool)
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
        self.w1, self.b1 = rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32)
        self.w2, self.b2 = rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32), np.zeros(1, np.float32)
        z, t = (x[fit] - self.mean) / self.scale, y[fit].astype(np.float32)
        params = [self.w1, self.b1, self.w2, self.b2]
        first, second, n = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(t))
            for at in range(0, len(t), 256):
                zi, ti = z[order[at : at + 256]], t[order[at : at + 256]]
                h = np.tanh(zi @ self.w1 + self.b1)
                g = (self._sigmoid(h @ self.w2 + self.b2) - ti) / len(ti)
                back = np.outer(g, self.w2) * (1 - h * h)
                n += 1
                for k, grad in enumerate((zi.T @ back + decay * self.w1, back.sum(axis=0), h.T @ g + decay * self.w2, g.sum(keepdims=True))):
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad * grad
                    params[k] -= rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)
        if held.any():
            logits, target = self.logits(x[held]), y[held]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            loss = [np.logaddexp(0, -(2 * target - 1) * logits / s).mean() for s in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    @staticmethod
    def _sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share) if self.flat else self._sigmoid(self.logits(x).astype(np.float64) / self.temperature)


def held_out(doc_id="doc_id"):
    """Rows that never train: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class QualityModel:
    """fit() on labelled documents, then score() any others."""

    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> QualityModel:
        """From docs (doc_id, text) and labels (doc_id, label), at most sample rows of them."""
        chosen = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
        chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # chosen: at most sample rows
        # one text for each doc_id, so that rows are bounded however often ids repeat
        rows = written(rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label")).select("text", "label"), "quality-sample")
        vectors = word_vectors(rows)
        spark, dims = docs.sparkSession, 2 * DIMS
        shared = spark.sparkContext.broadcast(vectors)

        def pool(batches):
            for b in batches:
                x = pooled([t or "" for t in b.column(0).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

        found = sorted(rows.mapInArrow(lean("quality", pool), "label int, x binary").collect())  # at most sample rows
        x = np.frombuffer(b"".join(r[1] for r in found), np.float32).reshape(-1, dims)
        y = np.array([r[0] for r in found], np.float32)
        order = np.random.default_rng(SEED).permutation(len(y))
        return cls(vectors, Network(x[order], y[order]))

    def score(self, docs: DataFrame, into: str = "score") -> DataFrame:
        """docs with a column (into): the calibrated probability of label 1 for the whole text. Other columns pass through."""
        docs = docs.drop(into)
        shared = docs.sparkSession.sparkContext.broadcast(self)
        at = docs.columns.index("text")

        def task(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 500):
                    part = b.slice(lo, 500)
                    score = shared.value.network.scores(pooled([t or "" for t in part.column(at).to_pylist()], shared.value.vectors))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], names=[*part.schema.names, into])

        return docs.mapInArrow(lean("quality", task), docs.withColumn(into, F.lit(0.0)).schema)
