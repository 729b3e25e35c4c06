"""Words of whole texts as numpy arrays, and compact blobs of sorted hashes for the shuffle.

A word is a run of bytes outside [\\x20\\x09-\\x0D]; all of these are single bytes in
UTF-8, so texts are cut on bytes. Null texts have no words.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import SparkSession

#: Bytes of text that are worked on at once; one longer text is worked on whole.
SLICE = 4 << 20
STRIDE = 1 << 13
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[IS_SPACE] = 0
STEP = np.uint64(0x9E3779B97F4A7C15)
#: A stand-in for a null id: it sorts last.
NO_ID = np.iinfo(np.int64).max


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def _powers(bits: int) -> np.ndarray:
    p = np.full(1 << bits, STEP, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Bytes:
    """Bytes of some texts, and where each begins."""

    def __init__(self, texts: pa.Array, lower: bool):
        texts = texts.fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        self.n, self.offsets = n, offsets - offsets[0]
        self.data = LOWER[data] if lower else data


class Words(Bytes):
    """Words of some texts: bytes, start and end of each word, its text's index, and words for each text."""

    def __init__(self, texts: pa.Array, lower: bool):
        super().__init__(texts, lower)
        n, data = self.n, self.data
        space = IS_SPACE[data]
        edge = self.offsets[:-1][self.offsets[:-1] < len(data)]
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:] = space[:-1]
        before[edge] = True
        after[:-1] = space[1:]
        after[edge[edge > 0] - 1] = True
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.row = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.row, minlength=n)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        for a in range(0, len(out), STRIDE):  # so many that their arrays stay in a core's cache
            starts = self.starts[a : a + STRIDE]
            first, last = starts[0], self.starts[a + STRIDE] if a + STRIDE < len(out) else len(self.data)
            gaps = np.diff(starts, append=last)
            power = np.arange(first, last) - np.repeat(starts, gaps)
            table = _powers(max(8, int(gaps.max()).bit_length()))
            out[a : a + STRIDE] = np.add.reduceat(BYTE[self.data[first:last]] * table[power], starts - first)
        return mix(out + (self.ends - self.starts).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def windows(h: np.ndarray, row: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words that lie within one text, and the index of each one's first word."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    step = STEP + np.uint64(2 * seed)

    def power(n: int) -> np.uint64:
        return np.uint64(pow(int(step), n, 1 << 64))

    out, have = h, 1
    for bit in bin(k)[3:]:
        out = out[: len(out) - have] + power(have) * out[have:]
        have *= 2
        if bit == "1":
            out = out[: len(h) - have] + power(have) * h[have:]
            have += 1
    at = np.flatnonzero(row[: len(h) - k + 1] == row[k - 1 :])
    return mix(out[at] ^ np.uint64(k)), at


def slices(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, lower: bool, kind: type = Words) -> Iterator[tuple[np.ndarray, Words, pa.RecordBatch]]:
    """Ids and words (or, by kind, just bytes) of a few MB of texts at a time."""
    for batch in batches:
        size = np.asarray(pa.compute.binary_length(batch[text_col]).fill_null(0)).astype(np.int64)
        part = np.cumsum(size) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                some = batch.slice(a, b - a)
                yield some[id_col].cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False), kind(some[text_col], lower), some


def pack(a: np.ndarray) -> bytes:
    """A sorted array of uint64 as differences of as many bytes as the largest needs."""
    if not len(a):
        return b""
    d = np.diff(a)
    width = (int(d.max()).bit_length() + 7) // 8 if len(d) else 0
    return struct.pack("<BQ", width, int(a[0])) + np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes() + struct.pack("<Q", len(a))


def unpack(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    (width, first), (n,) = struct.unpack("<BQ", b[:9]), struct.unpack("<Q", b[-8:])
    out = np.zeros((n, 8), np.uint8)
    if width:
        out[1:, :width] = np.frombuffer(b, np.uint8)[9:-8].reshape(n - 1, width)
    out = out.view(np.uint64).reshape(-1)
    out[0] = first
    return np.cumsum(out, dtype=np.uint64)


def narrow(a: np.ndarray) -> bytes:
    """Non-negative integers as the smallest unsigned type that holds them."""
    top = int(a.max()) if len(a) else 0
    kind = next(k for k in "BHIQ" if top < 1 << (8 * np.dtype(k).itemsize))
    return kind.encode() + a.astype(kind).tobytes()


def widen(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.dtype(b[:1].decode()), offset=1).astype(np.int64)


def bounds(n_parts: int, bits: int) -> np.ndarray:
    """The first value of each part (but the first) when hashes of so many bits are dealt by range."""
    return np.array([-(-(p << bits) // n_parts) for p in range(1, n_parts)], np.uint64)


def labels(spark: SparkSession, n: int) -> list[int]:
    """An int for each of n shuffle partitions that hash partitioning puts there; ranges then fill all partitions evenly."""
    got: dict[int, int] = {}
    top = 32 * n
    while len(got) < n:
        rows = spark.range(top).selectExpr("int(id) AS i", f"pmod(hash(int(id)), {n}) AS p").groupBy("p").agg({"i": "min"}).collect()
        got = {r[0]: r[1] for r in rows}
        top *= 4
    return [got[p] for p in range(n)]


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
