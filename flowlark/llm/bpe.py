"""Byte-level BPE with the ranks of a vocabulary file, run by a sentencepiece model built from them.

The model is not trained: its protocol buffer is written here straight from the
vocabulary. Each byte b is the character U+0100 + b, a token the string of its
bytes' characters, scored by its negative rank; normalisation is identity, so
the merges are those of the ranks, lowest first, leftmost among equals.
"""

from __future__ import annotations

import base64
import struct
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import byte_slices

_SHIFT = {b: 0x100 + b for b in range(256)}
_BPE, _NORMAL, _UNKNOWN = 2, 1, 2


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of lines 'base64 rank'; blank lines count for nothing."""
    with open(path, "rb") as file:
        pairs = (line.split() for line in file)
        return {base64.b64decode(p[0]): int(p[1]) for p in pairs if p}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _blob(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def to_characters(data: bytes) -> str:
    return data.decode("latin-1").translate(_SHIFT)


def to_bytes(piece: str) -> bytes:
    return bytes(ord(c) - 0x100 for c in piece)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The ModelProto of a BPE model: an unknown piece, then one piece for each rank."""
    if not ranks:
        raise ValueError("the vocabulary is empty")
    by_rank = {r: t for t, r in ranks.items()}
    top = max(by_rank)
    pieces = [_blob(1, _blob(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, _UNKNOWN))]
    for rank in range(top + 1):
        name = to_characters(by_rank[rank]) if rank in by_rank else f"<gap {rank}>"
        pieces.append(_blob(1, _blob(1, name.encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, _NORMAL)))
    absent = 2**64 - 1
    trainer = _number(3, _BPE) + _number(4, len(pieces)) + _number(40, 0) + _number(41, absent) + _number(42, absent) + _number(43, absent)
    normaliser = _blob(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _blob(2, trainer) + _blob(3, normaliser)


class ByteBpe:
    """Encoder and decoder of one vocabulary; remembers pre-tokens up to about ``remember`` bytes, and one batch more."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = 1 << 26) -> None:
        self.ranks, self.remember, self.held = ranks, remember, 0
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.known: dict[str, tuple[int, ...]] = {}
        tokens = [b"" if (p := self.model.id_to_piece(k + 1)).startswith("<gap ") else to_bytes(p) for k in range(self.model.get_piece_size() - 1)]
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def learn(self, words: list[str]) -> None:
        """Encode pre-tokens that are not known yet. One that is a token as a whole is that token."""
        merge = []
        for w in words:
            rank = self.ranks.get(w.encode())
            if rank is None:
                merge.append(w)
            else:
                self.known[w] = (rank,)
        if merge:
            for w, ids in zip(merge, self.model.encode([to_characters(w.encode()) for w in merge], num_threads=1)):
                self.known[w] = tuple(k - 1 for k in ids)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        cut = [self.split(t) for t in texts]
        new = set().union(*cut).difference(self.known)
        if new:
            self.learn(list(new))
            self.held += sum(sys.getsizeof(w) + 40 * len(self.known[w]) + 160 for w in new)
        known, out = self.known, []
        for words in cut:
            ids: list[int] = []
            for part in map(known.__getitem__, words):
                ids += part
            out.append(ids)
        if self.held > self.remember:
            self.known.clear()
            self.held = 0
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, by the inverse of the byte mapping."""
        if len(ids) == 0:
            return b""
        if ids.min() < 0 or ids.max() >= len(self.lengths):
            raise ValueError("an id is outside of the vocabulary")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.pool[at].tobytes()


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern)


def _encoder(path: str, pattern: str, decode: bool, most: int = 1 << 19):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            for part in byte_slices(batch, batch.num_columns - 1, most):
                ids = coder.encode_batch([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter((k for x in ids for k in x), dtype=np.int32, count=int(offsets[-1]))
                columns = [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                names = [*batch.schema.names[:-1], "ids"]
                if decode:
                    names.append("decoded")
                    columns.append(pa.array([coder.decode(flat[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _decoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            flat, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            data = [coder.decode(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns)), pa.array(data, pa.binary())], names=[*batch.schema.names, "decoded"])

    return run


def bpe_encode(docs: DataFrame, *, path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), decode: bool = False) -> DataFrame:
    """``keep`` columns and ``ids`` (array of int) of each text; ids are ranks.

    With ``decode`` the same worker turns the ids back to bytes (``decoded``).

    Null and empty texts have no ids. Whole texts are encoded, without special
    tokens. Every row is its own result, so repeated rows repeat; other columns
    are dropped, whatever their names; an empty table gives an empty result.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes[:-1]), "ids array<int>", *["decoded binary"] * decode])
    return rows.mapInArrow(_encoder(path, pattern, decode), schema)


def bpe_decode(encoded: DataFrame, *, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of ``ids``; null ids have none. Ids outside of the vocabulary raise an error."""
    rows = encoded.select(*[c for c in encoded.columns if c != "ids"], F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), "decoded binary"])
    return rows.mapInArrow(_decoder(path, pattern), schema)


def bpe_round_trip(docs: DataFrame, *, path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each text, out of the encoder's ids and the decoder's bytes."""
    both = bpe_encode(docs, path=path, pattern=pattern, text_col=text_col, keep=keep, decode=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(*keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
