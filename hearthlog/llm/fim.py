"""Fill-in-middle by rank and select over packed bits that mark where code points begin."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stand before prefix, suffix and middle. No marker may overlap another one or itself.
MARKERS = ("<P>", "<S>", "<M>")

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class BitVector:
    """Packed bits with a directory of the ones before each block; rank and select work on whole arrays of places."""

    BLOCK = 64  # bytes of bits

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits)
        self.bits = np.pad(packed, (0, -len(packed) % self.BLOCK + self.BLOCK))
        ones = _POPCOUNT[self.bits].reshape(-1, self.BLOCK)
        self.directory = np.concatenate([[0], np.cumsum(ones.sum(axis=1, dtype=np.int64))])
        self.size = len(bits)

    @property
    def total(self) -> int:
        return int(self.directory[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        at = np.asarray(at, np.int64)
        block, byte = at // (8 * self.BLOCK), at // 8
        inside = np.arange(self.BLOCK) < (byte % self.BLOCK)[:, None]
        whole = (_POPCOUNT[self.bits.reshape(-1, self.BLOCK)[block]] * inside).sum(axis=1, dtype=np.int64)
        return self.directory[block] + whole + _POPCOUNT[self.bits[byte] & (0xFF00 >> at % 8).astype(np.uint8)]

    def select(self, k: np.ndarray) -> np.ndarray:
        """Where the k-th one stands, counted from 0; the size where there are no more than k ones."""
        k = np.asarray(k, np.int64)
        there = k < self.total
        k = np.where(there, k, 0)
        block = np.minimum(np.searchsorted(self.directory, k, "right") - 1, len(self.directory) - 2)
        left = k - self.directory[block]
        upto = np.cumsum(_POPCOUNT[self.bits.reshape(-1, self.BLOCK)[block]], axis=1, dtype=np.int64)
        byte = np.minimum((upto <= left[:, None]).sum(axis=1), self.BLOCK - 1)
        left -= np.where(byte > 0, np.take_along_axis(upto, np.maximum(byte - 1, 0)[:, None], 1)[:, 0], 0)
        ones = np.unpackbits(self.bits[block * self.BLOCK + byte][:, None], axis=1)
        bit = np.minimum((np.cumsum(ones, axis=1) <= left[:, None]).sum(axis=1), 7)
        return np.where(there, (block * self.BLOCK + byte) * 8 + bit, self.size)


def _draws(ids: list, seed: int) -> np.ndarray:
    """Four unsigned numbers for each id, from the digest of the seed and the id."""
    digests = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids]
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)


def _rearranged(text: bytes, first: int, second: int, form: str) -> bytes:
    p, s, m = (x.encode() for x in MARKERS)
    if form == "plain":
        return text
    before, middle, after = text[:first], text[first:second], text[second:]
    return b"".join((p, before, s, after, m, middle) if form == "psm" else (s, after, p, before, m, middle))


def transform(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: a row for each row of `docs`.

    Each whole text is cut at two places drawn from the seed and the id (h % (n + 1) code points, n those of the text),
    and is given as psm, or as spm in `spm` of 100 documents. `plain` of 100, empty texts and texts that spell a
    marker stay as they are, with null lengths. The bits of all texts of an Arrow batch share one vector, so code
    points are counted and places found without decoding anything.

    Null texts count as empty, a null id draws like an empty one, equal rows give equal rows, an empty table an empty
    result; other columns are ignored. A text stays in one row and has to fit one task as such.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield _batch(batch.slice(at, 1000), seed, plain, spm)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _batch(part: pa.RecordBatch, seed: int, plain: int, spm: int) -> pa.RecordBatch:
    ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
    ends = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = BitVector((data & 0xC0) != 0x80)
    ranks = starts.rank(ends)
    n = np.diff(ranks)
    h = _draws(ids, seed)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    # A cut behind the last code point of a text is where the next text begins, or the end of all.
    places = np.minimum(starts.select((ranks[:-1, None] + cuts).ravel()).reshape(-1, 2), ends[1:, None]) - ends[:-1, None]
    marks = [x.encode() for x in MARKERS]
    forms, outputs = [], []
    for text, (a, b), draws in zip(texts, places.tolist(), h.tolist()):
        form = "plain" if not text or any(x in text for x in marks) or draws[2] % 100 >= 100 - plain else "spm" if draws[3] % 100 < spm else "psm"
        forms.append(form)
        outputs.append(_rearranged(text, a, b, form))
    cut = np.array([f != "plain" for f in forms], bool)
    lengths = [pa.array(x, pa.int64(), mask=~cut) for x in (cuts[:, 0], cuts[:, 1] - cuts[:, 0])]
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), *lengths, pa.array(outputs, pa.binary()).view(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made. Markers are found in the output itself."""
    p, s, m = MARKERS
    head = F.substring_index(output, m, 1)  # all before the middle
    middle = F.substr(output, F.length(head) + len(m) + 1)
    left = lambda x: F.substring_index(head, x, 1)
    behind = lambda x: F.substring_index(head, x, -1)
    psm = F.concat(F.substr(left(s), F.lit(len(p) + 1)), middle, behind(s))
    spm = F.concat(behind(p), middle, F.substr(left(p), F.lit(len(s) + 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
