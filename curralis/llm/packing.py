"""Packing documents into sequences of fixed length: dominance reduction, then best fit.

Documents are tokenised through a table of distinct words, cut only where they are longer than a sequence, and counted
by length. Lengths are integers up to the capacity, so the instance is a histogram of fixed size: it is solved exactly
as its counts say, however many pieces there are. Martello-Toth reduction fixes sets that dominate every other set
with the same item: an exact complement, an item that nothing fits, or the largest partner where no two (or no better two)
others fit. What is left is packed best fit, longest first. The plan is ranges of ranks within a length, and each piece
finds its place by its rank. A tokenizer's merges are computed by tiktoken where that gives the same ids (class _Merges);
all other words go to the tokenizers library itself.

Defined cases: a null or empty text is the closing token alone; equal lengths are told apart by doc_id and piece;
repeated rows are packed each; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curralis.llm.common import holds, lean, trim, written

#: Most words that a worker's table holds before it starts anew.
TABLE = 600_000
#: A length's pieces are ranked in so many parts, so that one length may hold most of the pieces.
SALTS = 256
#: Where ids are kept, so many rows are tokenised at once, and free memory goes back after them: the executor holds their ids too.
PART = 250
_words: dict[str, WordTable] = holds("packing", {})


class _Met:
    """Which words came before, by their hashes in a table of fixed size. A word that comes once in a while needs no room in a worker's table;
    one that passes for another by its hash only takes room."""

    def __init__(self, size: int = 1 << 22):
        self.seen = np.zeros(size, bool)

    def before(self, words: list[str]) -> np.ndarray:
        """Whether each word came before; from now on these have."""
        at = np.fromiter(map(hash, words), np.int64, len(words)) & (len(self.seen) - 1)
        out = self.seen[at]
        self.seen[at] = True
        return out


class _Merges:
    """Token ids of a word of a lower-cased BPE with word ends, computed by tiktoken's merge loop instead of the library's.

    A byte that no text holds stands for the word's end; its pair with each last byte has the lowest rank, as the library joins
    the two before all merges. tiktoken merges any neighbours whose joint bytes are a token, the library the listed pair of it:
    in a trained vocabulary these are the same, as the merges inside a token's span come in the order of its own merges.
    """

    END = b"\xff"
    SUFFIX = "</w>"
    #: What the tokenizer must do before its merges for this to hold.
    NORMALIZERS = ("NFC", "Replace", "Lowercase")
    PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    #: Characters below this are composed already, and every Unicode version knows them alike.
    SURE = "\u0250"
    #: Stands for the place where a word ends.
    NONE = b"\xff\xff\xff\xff"

    def __init__(self, model: dict, limit: int):
        vocab = model["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a token's name
        hidden = [b for b in range(256) if b not in set(shown)]
        chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        byte = {c: b for b, c in chars.items()}
        names = [chars[b] for b in range(256)] + [chars[b] + self.SUFFIX for b in range(256)]
        names += ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        raw = lambda n: bytes(map(byte.__getitem__, n.removesuffix(self.SUFFIX))) + (self.END if n.endswith(self.SUFFIX) else b"")
        ranks = {raw(n): k for k, n in enumerate(names)}
        if len(ranks) != len(names):
            raise ValueError("two merges give the same token")
        self.encode = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.ids, self.limit, self.table = np.array([vocab[n] for n in names], np.uint32), limit, {"\n": self.NONE}
        self.met = _Met()
        known = [chr(c) for c in range(33, ord(self.SURE))]
        letters, numbers = ("".join(re.escape(c) for c in known if unicodedata.category(c)[0] == x) for x in "LN")
        self.split = re.compile(self.PATTERN.replace("\\p{L}", letters).replace("\\p{N}", numbers) + "|\n").findall

    @classmethod
    def of(cls, tokenizer: Tokenizer, limit: int) -> _Merges | None:
        """For tokenizers of this kind, or None."""
        kind = json.loads(tokenizer.to_str())
        model, pre = kind["model"], kind["pre_tokenizer"] or {}
        steps = tuple(n["type"] for n in (kind["normalizer"] or {}).get("normalizers", ()))
        first = next(iter(pre.get("pretokenizers", ())), {})
        fits = model["type"] == "BPE" and model["end_of_word_suffix"] == cls.SUFFIX and model["continuing_subword_prefix"] is None and not (model["dropout"] or model["ignore_merges"])
        if not fits or steps != cls.NORMALIZERS or (first.get("pattern"), first.get("behavior"), first.get("invert")) != ({"Regex": cls.PATTERN}, "Removed", True):
            return None
        if any("<|" not in t["content"] for t in kind["added_tokens"]) or [p["type"] for p in pre["pretokenizers"]] != ["Split", "ByteLevel"]:
            return None
        return cls(model, limit)

    def sure(self, word: str) -> bool:
        """Whether a word (without ASCII white space) may be encoded here: others go to the library."""
        return word.isprintable() and (word.isascii() or (max(word) < self.SURE and "\u0130" not in word)) and "<|" not in word

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of each of these words."""
        pieces = self.split("\n".join([*words, ""]).lower())  # the line break ends a word
        if new := list(set(pieces) - self.table.keys()):
            if len(self.table) + len(new) > self.limit:
                self.table, self.met = {"\n": self.NONE}, _Met()
                new = list(set(pieces) - self.table.keys())
            found = [self.encode(q.encode() + self.END) for q in new]
            self.table.update(zip(new, _cut(self.ids[np.fromiter(chain.from_iterable(found), np.int64)], np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))))
        flat = np.frombuffer(b"".join(map(self.table.__getitem__, pieces)), np.uint32)
        for q in compress(new, ~self.met.before(new)):
            del self.table[q]
        real = flat != 0xFFFFFFFF
        return _cut(flat[real], np.cumsum(real)[~real])


def _cut(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data, stops = ids.tobytes(), (4 * ends).tolist()
    return [data[a:b] for a, b in zip([0, *stops], stops)]


class WordTable:
    """Token ids of whole texts, from those of each distinct word. Holds for tokenizers that drop white space and never join over it."""

    def __init__(self, path: str, limit: int = TABLE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.merges = _Merges.of(self.tokenizer, limit)
        self.table: dict[str, bytes] = {}
        self.met = _Met()

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of each of these words, which the table doesn't hold."""
        if not self.merges:
            return self._by_library(words)
        sure = list(map(self.merges.sure, words))
        if all(sure):
            return self.merges.ids_of(words)
        here, there = iter(self.merges.ids_of(list(compress(words, sure)))), iter(self._by_library([w for w, s in zip(words, sure) if not s]))
        return [next(here if s else there) for s in sure]

    def _by_library(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's begin and the last one's end. Words meet the table once a batch; it
        keeps those that came before or come twice in the batch."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        found = lists.flatten().dictionary_encode()
        words, at = found.dictionary.to_pylist(), found.indices.to_numpy()
        ids = list(map(self.table.get, words))
        if new := [k for k, held in enumerate(ids) if held is None]:
            missing = [words[k] for k in new]
            learnt = self._learn(missing)
            keep = self.met.before(missing) | (np.bincount(at, minlength=len(words))[new] > 1)
            if len(self.table) + int(keep.sum()) > self.limit:
                # begins anew with the words met just now: frequent ones are among them
                self.table, self.met = {w: held for w, held in zip(words, ids) if held is not None}, _Met()
            self.table.update(compress(zip(missing, learnt), keep))
            for k, held in zip(new, learnt):
                ids[k] = held
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        ids, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[at]
        ends = np.append(0, np.cumsum(each))
        out = ids[np.repeat(first[at] - ends[:-1], each) + np.arange(ends[-1])]
        offsets = lists.offsets.to_numpy()
        return out, ends[offsets - offsets[0]]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, ends = self.encode_all(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]


def words_of(path: str) -> WordTable:
    if path not in _words:
        _words[path] = WordTable(path)
    return _words[path]


class Plan:
    """Where pieces go: for ranges of ranks within a length, the first sequence, pieces per sequence and first offset."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.counts, self.taken = capacity, np.array(counts, np.int64), np.zeros(capacity + 1, np.int64)
        self.sequences, self.fixed, self.rows = 0, 0, []
        self._reduce()
        self.fixed = self.sequences
        self._best_fit()
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        self.length, self.first, self.sequence, self.per, self.offset = rows.T
        self.key = (self.length << 40) | self.first

    def _put(self, length: int, n: int, sequence: int, per: int, offset: int) -> None:
        """n pieces of a length, so many to each sequence from one on, at the same offset in each."""
        self.rows.append((length, int(self.taken[length]), sequence, per, offset))
        self.taken[length] += n
        self.counts[length] -= n

    def _fix(self, length: int, partner: int | None, n: int) -> None:
        if partner == length:
            self._put(length, 2 * n, self.sequences, 2, 0)
        else:
            self._put(length, n, self.sequences, 1, 0)
            if partner:
                self._put(partner, n, self.sequences, 1, length)
        self.sequences += n

    def _reduce(self) -> None:
        """Fixes every set that provably dominates all others with its item, till none is found."""
        counts, capacity = self.counts, self.capacity
        for length in range(capacity, 0, -1):  # exact complements dominate whatever else fits
            rest = capacity - length
            if not rest and counts[length]:
                self._fix(length, None, int(counts[length]))
            elif rest and length >= rest and (n := int(min(counts[length], counts[rest]) if length > rest else counts[length] // 2)):
                self._fix(length, rest, n)
        changed = True
        while changed:
            changed = False
            for length in np.flatnonzero(counts)[::-1].tolist():
                while counts[length] and self._dominates(length):
                    changed = True

    def _dominates(self, length: int) -> bool:
        counts, rest = self.counts, self.capacity - length
        counts[length] -= 1  # the item itself is not its own partner
        fit = np.flatnonzero(counts[: rest + 1])
        small = [int(x) for x in fit[:3] for _ in range(int(min(3, counts[x])))][:3]
        best = int(fit[-1]) if len(fit) else 0
        sure = len(small) < 2 or small[0] + small[1] > rest
        if not sure and (len(small) < 3 or sum(small) > rest):  # at most two others fit: is the best one as good as any two?
            pairs = [int(a + b) for k, a in enumerate(fit) for b in fit[k + (counts[a] < 2) :] if a + b <= rest]
            sure = best >= max(pairs, default=0)
        counts[length] += 1
        if sure:
            n = int(counts[length]) if not best else int(counts[length] // 2 if best == length else min(counts[length], counts[best]))
            self._fix(length, best or None, n)
        return sure

    def _best_fit(self) -> None:
        """Longest first, each into the open sequence with the least room that suffices; open sequences are kept as ranges by room."""
        open_: dict[int, list[tuple[int, int]]] = {}
        some = np.zeros(self.capacity + 1, bool)

        def leave(room: int, sequence: int, n: int) -> None:
            if room and n:
                open_.setdefault(room, []).append((sequence, n))
                some[room] = True

        for length in np.flatnonzero(self.counts)[::-1].tolist():
            while left := int(self.counts[length]):
                rooms = some[length:]
                room = length + int(rooms.argmax()) if rooms.any() else self.capacity
                per = room // length
                if some[room]:
                    sequence, n = open_[room].pop()
                    some[room] = bool(open_[room])
                else:
                    sequence, n = self.sequences, -(-left // per)
                    self.sequences += n
                at = self.capacity - room
                if full := min(n, left // per):
                    self._put(length, full * per, sequence, per, at)
                    leave(room - per * length, sequence, full)
                more = left - full * per
                if full < n and more:
                    self._put(length, more, sequence + full, more, at)
                    leave(room - more * length, sequence + full, 1)
                    full += 1
                leave(room, sequence + full, n - full)

    def places(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these lengths and ranks (from 0) within their length."""
        k = np.searchsorted(self.key, (lengths << 40) | ranks, side="right") - 1
        n = ranks - self.first[k]
        return self.sequence[k] + n // self.per[k], self.offset[k] + n % self.per[k] * lengths


def parts(batches):
    """The same rows in batches of at most PART; what one of them took is given back before the next."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            yield batch.slice(at, PART)
            trim()


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, and ids if they are kept) of the tokenised documents, each closed by end_id."""
    end = array("I", [end_id]).tobytes()
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if keep_ids else {})

    def task(batches):
        tool = words_of(path)
        for batch in parts(batches) if keep_ids else batches:
            rows = []
            ids, ends = tool.encode_all(batch.column(1))
            for doc_id, start, stop in zip(batch.column(0).to_pylist(), ends.tolist(), ends[1:].tolist()):
                whole = ids[start:stop].tobytes() + end
                for k, a in enumerate(range(0, len(whole), 4 * capacity)):
                    cut = whole[a : a + 4 * capacity]
                    rows.append((doc_id, k, a // 4, len(cut) // 4, zlib.crc32(cut), *([np.frombuffer(cut, np.int32)] if keep_ids else ())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds.values())], names=list(kinds))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean("packing", task), schema)


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> tuple[DataFrame, Plan]:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if they are kept) of every piece of docs, and the plan."""
    spark = docs.sparkSession
    cut = written(pieces(docs, path, capacity, end_id, keep_ids).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most a row per length
        counts[length] = n
    plan = Plan(counts, capacity)
    shared = spark.sparkContext.broadcast(plan)  # of a size that capacity bounds, not the data
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    kept = ["ids"] * keep_ids
    ranked = cut.withColumn("own", own).join(bases, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own") - 1).alias("rank"), *kept)

    def place(batches):
        plan = shared.value
        for b in batches:
            sequence, offset = plan.places(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset), *b.columns[6:]], names=[*b.schema.names[:5], "sequence_id", "offset", *kept])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    return ranked.mapInArrow(lean("packing", place), schema), plan


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) from packed pieces with their ids: what a training run reads. A sequence is of bounded size."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("x"))
    return rows.select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.doc_id").alias("doc_ids"))
