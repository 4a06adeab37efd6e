"""SentencePiece encoding and decoding of whole texts.

Each distinct chunk (a word with the spaces before it) is encoded by the score
ordered agenda of `pieces`; what a worker has encoded it keeps, within a bound.
In each Arrow batch the newly encoded chunks are checked against the
sentencepiece library; where they differ, the library's ids hold, and the row's
n_corrected counts such chunks (0 throughout: the agenda's ids are the result).

Null and empty texts have no ids. Rows are handled on their own: repeated rows
give repeated results, an empty table an empty one, and further columns aren't
read. A chunk of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import release, small_batches
from lexmill.llm.pieces import SPACE, PieceModel, chunks, loaded, model_bytes

#: Chunks whose codes a Python worker keeps, and the longest of them.
KEPT_CHUNKS, KEPT_CHARS = 400_000, 64


def decode(model: PieceModel, ids: list[int]) -> str:
    """Text of ids: bytes are joined before decoding, the first model space is dropped."""
    parts: list[str] = []
    run = bytearray()
    for i in [*ids, -1]:
        if i in model.byte_of:
            run.append(model.byte_of[i])
            continue
        if run:
            parts.append(run.decode("utf-8", "replace"))
            run.clear()
        if i >= 0:
            parts.append(model.pieces[i])
    text = "".join(parts)
    return (text[1:] if text.startswith(SPACE) else text).replace(SPACE, " ")


class Codec:
    """Codes of chunks: ids as text, and decoded text where it isn't the chunk again."""

    def __init__(self, model: PieceModel) -> None:
        self.model, self.ids, self.back = model, {}, {}
        #: Chunks whose ids the library corrected.
        self.corrected: set[str] = set()
        #: Chunks met in several groups, and those of the last group among them.
        self.again: set[str] = set()
        self.recent: set[str] = set()
        self.first_other = max(model.byte_of) + 1 if min(model.index.values()) > max(model.byte_of) else model.n

    def learn(self, new: list[str]) -> None:
        model, text, pieces = self.model, self.model.text, self.model.pieces
        own = [model.ids_of(s) for s in model.encode(new)]
        right = model.by_library(new)
        if own != right:
            self.corrected.update(c for c, a, b in zip(new, own, right, strict=True) if a != b)
            own = right
        self.ids.update(zip(new, [",".join([text[i] for i in ids]) for ids in own], strict=True))
        plain = self.first_other
        for chunk, ids in zip(new, own, strict=True):
            if min(ids) < plain or "".join([pieces[i] for i in ids]) != chunk:
                self.back[chunk] = decode(model, [model.index[SPACE], *ids])

    def decoded(self, text: str, parts: list[str]) -> str:
        """Decoded text of a text's chunks."""
        if self.back.keys().isdisjoint(parts):  # each chunk is decoded to itself
            return text.replace(SPACE, " ")
        back = "".join([b if (b := self.back.get(c)) is not None else c.replace(SPACE, " ") for c in parts])
        return back[1:] if back[:1] == " " else back

    def trim(self, most: int = KEPT_CHUNKS) -> None:
        """Beyond `most`, forget the chunks that were met in one group only; if the others are too many, all but the last group's."""
        if len(self.ids) > most:
            if len(self.again) > KEPT_CHUNKS // 2:
                self.again = set(self.recent)
            self.ids = {c: self.ids[c] for c in self.again}
            self.back = {c: b for c, b in self.back.items() if c in self.again}


_codecs: dict[int, Codec] = {}


def encode_batches(batches: Iterator[pa.RecordBatch], proto: bytes, text_col: str, whole: bool) -> Iterator[pa.RecordBatch]:
    model = loaded(proto)
    codec = _codecs.setdefault(id(model), Codec(model))
    for batch in batches:
        col = batch.column(text_col)
        rows = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "n_corrected": []} | ({"ids": [], "decoded": []} if whole else {})
        group, size = [], 0
        texts = iter(col)
        for k in range(len(col)):
            group.append(next(texts).as_py() or "")
            size += len(group[-1])
            if size > 2 << 20 or k == len(col) - 1:
                _encode_group(codec, group, rows)
                group, size = [], 0
        keep = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != text_col]
        names = [n for n in batch.schema.names if n != text_col]
        types = {"n_tokens": pa.int64(), "n_corrected": pa.int64(), "ids": pa.list_(pa.int32())}
        yield pa.RecordBatch.from_arrays(keep + [pa.array(v, types.get(n, pa.string())) for n, v in rows.items()], names + list(rows))
    codec.trim(KEPT_CHUNKS // 4)  # the worker may go on with other work
    release()


def _encode_group(codec: Codec, texts: list[str], rows: dict) -> None:
    codec.trim()
    group = [chunks(t) for t in texts]
    met = set().union(*group)
    new = met.difference(codec.ids)
    codec.recent = {c for c in met - new if len(c) <= KEPT_CHARS}
    codec.again |= codec.recent
    new = list(new)
    codec.learn(new)
    for text, parts in zip(texts, group, strict=True):
        ids = ",".join(map(codec.ids.__getitem__, parts))
        back = codec.decoded(text, parts)
        rows["n_tokens"].append(ids.count(",") + 1 if ids else 0)
        rows["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
        rows["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
        rows["n_corrected"].append(sum(c in codec.corrected for c in parts) if codec.corrected else 0)
        if "ids" in rows:
            rows["ids"].append(np.fromstring(ids, np.int32, sep=","))
            rows["decoded"].append(back)
    for c in new:
        if len(c) > KEPT_CHARS:
            for d in (codec.ids, codec.back):
                d.pop(c, None)


def encode_texts(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, n_corrected[, ids, decoded]) of each row's whole text."""
    small_batches(df.sparkSession)
    proto = model_bytes(model_path)
    src = df.select(F.col(key), F.col(text).cast("string").alias("__text"))
    more = ", ids array<int>, decoded string" if whole else ""
    schema = f"{key} {src.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_corrected long{more}"
    return src.mapInArrow(lambda it: encode_batches(it, proto, "__text", whole), schema)
