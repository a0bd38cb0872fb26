"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of such a model holds a whitespace marker behind another character, so a merge never crosses the place where a
run of markers begins: the text falls into chunks (a run of markers and the word behind it), each distinct chunk is
segmented once by the library and the ids are joined back in the order of the text. The table lives in the Python
worker, bounded by TABLE chunks, and is kept from batch to batch. check_model() refuses a model whose pieces or
normalisation don't allow this.

Decoding joins what each chunk's ids decode to: pieces are their own text, byte pieces of a chunk are decoded together by the
library behind an anchor, and as no run of byte pieces crosses the marker that begins the next chunk, the whole is decode(ids).

Defined cases: a null or empty text has no ids and decodes to the empty text; texts of any length are cut whole; repeated rows, ties and
null ids are coded row by row; an empty table gives an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curralis.llm.common import holds, lean

MARK = "▁"
#: Most chunks that a worker's table holds before it starts anew.
TABLE = 700_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_codecs: dict[str, Codec] = holds("sentencepiece", {})


def check_model(model: sentencepiece.SentencePieceProcessor) -> None:
    """Raises ValueError unless segmenting chunk by chunk equals segmenting the whole text."""
    for i in range(model.get_piece_size()):
        if MARK in model.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"piece {i} crosses a whitespace marker")
    probe = " a  b ﬁ① \n c "
    if model.decode(model.encode(probe)) != probe:
        raise ValueError("the model's normalisation changes texts")


class Codec:
    """Encodes and decodes whole texts; for each distinct chunk, ids holds its ids as text and back what they decode to.

    Chunks are named without their first marker, so that most texts fall into them by a plain split at spaces.
    """

    def __init__(self, path: str, limit: int = TABLE):
        self.model, self.limit = sentencepiece.SentencePieceProcessor(model_file=path), limit
        check_model(self.model)
        self.anchor = self.model.encode("a")
        size = range(self.model.get_piece_size())
        self.pieces = [None if self.model.is_byte(i) else self.model.id_to_piece(i).replace(MARK, " ") for i in size]
        self.numbers = [str(i) for i in size]
        self.ids: dict[str, str] = {}
        self.back: dict[str, str] = {}

    def _learn(self, chunks: list[str]) -> None:
        # the library puts a marker before every text that isn't empty
        many = self.model.encode(chunks, num_threads=1)
        pieces, numbers = self.pieces, self.numbers
        for c, found in zip(chunks, many):
            if not c:
                found = [self.model.piece_to_id(MARK)]
            try:
                self.back[c] = "".join([pieces[i] for i in found])
            except TypeError:  # byte pieces: only the library joins them
                self.back[c] = self._decoded(found)
            self.ids[c] = ",".join([numbers[i] for i in found])

    def _decoded(self, ids: list[int]) -> str:
        """What ids decode to inside a text, where the library drops no leading space."""
        return self.model.decode(self.anchor + ids)[len(self.model.decode(self.anchor)) :]

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if text[0] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]

    def encode_many(self, texts: list[str]) -> list[tuple[str, str]]:
        """The ids of each text, comma-joined, and what they decode to."""
        cut = [self.chunks(t) for t in texts]
        need = set().union(*cut)
        if new := need - self.ids.keys():
            if len(self.ids) + len(new) > self.limit:
                # begins anew with the chunks met just now: frequent ones are among them
                self.ids, self.back = ({c: held[c] for c in need - new} for held in (self.ids, self.back))
            self._learn(list(new))
        ids, back = self.ids.__getitem__, self.back.__getitem__
        return [(",".join(map(ids, c)), "".join(map(back, c))[1:]) for c in cut]

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_many([text])[0][0].split(",") if i]

    def decode(self, text: str) -> str:
        """What the ids of the text decode to."""
        return self.encode_many([text])[0][1]


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, ids as comma-joined text, n_tokens, ids_sha256, decoded, decoded_sha256); ids and decoded null unless keep_ids."""
    kinds = {"doc_id": pa.int64(), "ids": pa.string(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}

    def task(batches):
        tool = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for doc_id, (ids, decoded) in zip(part.column(0).to_pylist(), tool.encode_many([t or "" for t in part.column(1).to_pylist()])):
                    rows.append((doc_id, ids if keep_ids else None, ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), decoded if keep_ids else None, hashlib.sha256(decoded.encode()).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds.values())], names=list(kinds))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean("sentencepiece", task), "doc_id long, ids string, n_tokens long, ids_sha256 string, decoded string, decoded_sha256 string")
