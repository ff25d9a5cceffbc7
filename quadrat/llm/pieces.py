"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece has a white-space marker after another character, no merge can reach over the start of a
marked word: the ids of a text are those of its marked words, one after another. Each batch therefore
lists its distinct marked words, segments each once with the library, and joins ids back by position.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: A marked word: white-space markers (or spaces, which become markers) and what follows up to the next.
CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*|[^ {MARK}]+")
#: Chunks that a worker keeps, and the longest of them in characters.
CACHE, CACHED_CHARS = 150_000, 48
#: Texts whose distinct chunks are listed together.
TEXTS = 128


def fields(message: bytes) -> dict[int, list]:
    """The fields of a protocol buffer message by number: integers, or bytes; as the model file's format has them.

    Of the model: 2 is the trainer's message (24: white space as suffix), 3 the normalizer's (2: character map,
    3: a marker in front, 4: extra white space goes, 5: spaces become markers; 3, 4 and 5 hold unless stated).
    """
    out: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = number()
        kind = tag & 7
        if kind == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else number()
            value = message[at : at + size]
            at += size
        out.setdefault(tag >> 3, []).append(value)
    return out


class Codec:
    """One model in one process, with its table of distinct chunks: each process lists those it meets, a bounded number."""

    def __init__(self, model_file: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.table: dict[str, tuple[int, str, str]] = {}
        self.separable = self._separable()

    def _separable(self) -> bool:
        """Whether chunks may be segmented alone, by the model's own settings: texts are taken as they are but for one marker in front and markers for spaces, and no piece has a marker after another character."""
        proto = self.library.serialized_model_proto()
        normalizer, trainer = (fields(b"".join(fields(proto).get(k, []))) for k in (3, 2))
        flag = lambda settings, k, default: settings.get(k, [default])[-1]
        plain = not any(normalizer.get(2, [])) and flag(normalizer, 3, 1) and not flag(normalizer, 4, 1) and flag(normalizer, 5, 1) and not flag(trainer, 24, 0)
        n = self.library.get_piece_size()
        own = (i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i)))
        return bool(plain) and not any(re.search(f"[^{MARK}]{MARK}", self.library.id_to_piece(i)) for i in own)

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Marked words of a text, after the marker that the model puts in front of it."""
        return CHUNK.findall(" " + text) if text else []

    def learn(self, chunks: set[str]) -> dict[str, tuple[int, str, str]]:
        """For each chunk: number of ids, the ids as text, and the decoded chunk with its leading marker as a space."""
        new = list(chunks)
        listed = self.library.encode([c[1:] for c in new], num_threads=1)
        marker = [self.library.piece_to_id(MARK)]
        listed = [ids if len(c) > 1 else marker for c, ids in zip(new, listed)]
        plain = self.library.decode(listed, num_threads=1) if new else []
        return {c: (len(ids), ",".join(map(str, ids)), " " + text) for c, ids, text in zip(new, listed, plain)}

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of ids, the ids as decimal text joined by commas, and the decoded text."""
        for at in range(0, len(texts), TEXTS):
            some = [x or "" for x in texts[at : at + TEXTS]]
            if not self.separable:
                for ids in self.library.encode(some, num_threads=1):
                    yield len(ids), ",".join(map(str, ids)), self.library.decode(ids)
                continue
            words = [self.chunks(x) for x in some]
            distinct = set().union(*words)
            table = self.table
            fresh = self.learn({c for c in distinct if c not in table})
            if len(table) + len(fresh) > CACHE:
                fresh |= {c: table[c] for c in distinct if c in table}
                table.clear()
            table.update((c, row) for c, row in fresh.items() if len(c) <= CACHED_CHARS)
            for chunks in words:
                rows = [table[c] if c in table else fresh[c] for c in chunks]
                yield sum([r[0] for r in rows]), ",".join([r[1] for r in rows]), "".join([r[2] for r in rows])[1:]


_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """This process's codec of a model file."""
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids, decoded, ids_sha256, decoded_sha256) for every row; without ids and decoded if not asked for.

    A null or empty text has no ids. Ids are those of the library's encode() without begin or end ids,
    decoded is its decode(ids). Rows are independent: repeated rows stay, an empty table gives none, and a
    text of any length is taken whole. The model file must be at that path on every worker.
    """
    kinds = {"id": docs.schema[id_col].dataType, "n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType())}
    names = ["id", "n_tokens", *(["ids", "decoded"] if ids else []), "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):  # a few texts' ids at a time
                part = batch.slice(at, TEXTS)
                made = list(own(part.column(1).to_pylist()))
                columns = {"id": part.column(0), "n_tokens": pa.array([m[0] for m in made], pa.int64())}
                if ids:
                    values = [np.array(m[1].split(","), np.int32) for m in made if m[1]]
                    ends = np.cumsum([0, *(m[0] for m in made)]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.empty(0, np.int32)))
                    columns["decoded"] = pa.array([m[2] for m in made], pa.string())
                columns["ids_sha256"] = pa.array([_sha(m[1]) for m in made])
                columns["decoded_sha256"] = pa.array([_sha(m[2]) for m in made])
                yield pa.RecordBatch.from_pydict(columns)

    schema = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): decode(ids) of every row; null ids give a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model_file).library
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "text": [None if x is None else own.decode([int(i) for i in x]) for x in batch["ids"]]})

    schema = T.StructType([T.StructField("id", encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInPandas(run, schema)
