"""Byte-level BPE through sentencepiece, with a model serialised straight from a vocabulary of ranks."""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import SegmentCache


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(1)
def byte_letters() -> str:
    """256 letters, one for each byte: printable Latin-1 as it is, the rest from U+0100 on; none is white space."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(spare)) for b in range(256))


def letters_of(data: bytes) -> str:
    return data.decode("latin-1").translate(byte_letters())


@lru_cache(1)
def _letter_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_letters())}


def bytes_of(piece: str) -> bytes:
    return bytes(map(_letter_bytes().__getitem__, piece))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece 0 is <unk>, piece 1 + i has the i-th lowest rank, scored by the negative rank.

    A merge is allowed exactly where the joined piece is in the vocabulary, and the highest score goes first;
    that is what byte-pair encoding by ranks does. Normalisation is the identity: no prefix, no white space rules.
    """
    kind = {"normal": 1, "unknown": 2}
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, kind["unknown"])]
    pieces += [_field(1, letters_of(token).encode()) + _field(2, float(-rank)) + _field(3, kind["normal"]) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0)  # model_type BPE, vocab_size, unk_id
    normaliser = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encodes and decodes by ranks. Pre-tokens are the matches of `pattern`; each is encoded by itself."""

    def __init__(self, path: str, pattern: str):
        import numpy as np
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.np, self.find = np, regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.rank_of = [0, *sorted(ranks.values())]
        self.whole = {letters_of(token): np.array([rank], "<u4").tobytes() for token, rank in ranks.items()}
        self.token_of = [b""] * (max(self.rank_of) + 1)
        for i in range(1, self.model.get_piece_size()):
            self.token_of[self.rank_of[i]] = bytes_of(self.model.id_to_piece(i))
        self.cache = SegmentCache(self._encode_segment)

    def _encode_segment(self, segment: str) -> bytes:
        """A match that is a piece by itself is that piece; the others go to sentencepiece, one by one."""
        return b"".join([self.whole.get(p) or self._encode_match(p) for p in map(letters_of, map(str.encode, self.find(segment)))])

    def _encode_match(self, letters: str) -> bytes:
        rank_of = self.rank_of
        return array("I", [rank_of[i] for i in self.model.encode(letters)]).tobytes()

    def encode(self, texts: list[str]):
        """Yields the ids of each text as little-endian unsigned 32-bit integers."""
        return self.cache.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_of.__getitem__, self.np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec for each Python worker."""
    return ByteBpe(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves.

    Null texts count as empty: no tokens and the digests of no bytes. Repeated rows give repeated rows,
    an empty table an empty result; other columns are ignored. `path` is the vocabulary's file on every executor.
    """

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                coded = list(bpe.encode(part.column(1).to_pylist()))
                columns = [
                    part.column(0), pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()), pa.array([hashlib.sha256(bpe.decode(c)).hexdigest() for c in coded], pa.string()),
                ]
                if ids:
                    columns.append(pa.array([bpe.np.frombuffer(c, "<u4").astype("i4") for c in coded], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def decode_ids(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text from arrays of ids; null counts as no ids, bytes that aren't UTF-8 become U+FFFD."""

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            texts = [bpe.decode(bpe.np.array(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
