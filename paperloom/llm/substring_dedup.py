"""Substring dedup by fixed-block anchors.

A window is 20 consecutive words of one document. Each document's non-overlapping
blocks of 10 words are the index; every rolling window of 10 words of every document
probes it. Any window of 20 words holds one whole aligned block of its document, so
a repeated window has an anchor: its block is hit by a second probe. Hits are then
extended: the windows of 20 words around anchored blocks are compared by 96 bits of
hashes, the first start (smaller doc_id, then earlier) keeps its words, and the words
that the others cover are removed; runs of such windows are the maximal exact repeats.

On Spark: tasks cut whole texts into words and send sorted hashes, dealt by hash range and
packed to a few bytes each; each range is sorted in one task. What a flush of a task can tell by itself stays there: of one hash it sends
two probes at most, a block that it has met twice is a hit at once, and of the starts of one window only the first goes to
the window's range, as all others in the flush are later ones. So a very frequent passage is a few rows for each flush in its range,
however many documents have it. No pairs are ever formed.

Defined results: null and empty texts have no words and keep the SHA-256 of the empty
string; a document under 20 words loses nothing; doc_id null sorts last; rows repeated with one
doc_id (null included) and text are one document and each get its result; texts that share a doc_id (null included)
are documents of their own, in order of a hash of the text; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.words import NO_ID, Words, bounds, labels, mix, narrow, pack, parts_of, slices, unpack, widen, windows
from paperloom.session import written

WINDOW, BLOCK = 20, 10
#: Windows that a task gathers before it sends their hashes.
FLUSH = 4 << 20
BLOBS = "part int, probes binary, hashes binary, docs binary, at binary, ids binary"


def _dealt(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.searchsorted(h, cuts), [len(h)]))


def _folded(h: np.ndarray) -> np.ndarray:
    """A sorted array with two of each value at most."""
    keep = np.ones(len(h), bool)
    keep[2:] = h[2:] != h[:-2]
    return h[keep]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "probes", "hashes", "docs", "at", "ids"])


def _located(h: np.ndarray, doc: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple:
    """Hashes in order with their documents and places, as blobs; ids: of all documents, doc indexes it."""
    used, doc = np.unique(doc, return_inverse=True)
    return pack(h), narrow(doc), narrow(at), ids[used].astype(np.int64).tobytes()


def probes(part: list[int], bits: int, window: int, block: int, id_col: str, text_col: str) -> Callable:
    shift, cuts = np.uint64(64 - bits), bounds(len(part), bits)

    def flush(held: list) -> pa.RecordBatch:
        every = _folded(np.sort(np.concatenate([x[0] for x in held])))
        h, at = (np.concatenate([x[i] for x in held]) for i in (1, 3))
        base = np.cumsum([0, *(len(x[4]) for x in held)])
        doc = np.concatenate([x[2] + b for x, b in zip(held, base, strict=False)])
        ids = np.concatenate([x[4] for x in held])
        # blocks that two probes of this flush have are hits: only a block's first sight needs its range
        twice = every[1:][every[1:] == every[:-1]]
        sure = np.isin(h, twice)
        rows = [(part[int(ids[0]) % len(part)], None, None, *_located(h[:0], doc[sure], at[sure], ids)[1:])] if sure.any() else []
        h, doc, at = h[~sure], doc[~sure], at[~sure]
        order = np.argsort(h)
        h, doc, at = h[order], doc[order], at[order]
        p, q = _dealt(every, cuts), _dealt(h, cuts)
        return _batch([*rows, *((part[i], pack(every[p[i] : p[i + 1]]), *_located(h[a:b], doc[a:b], at[a:b], ids)) for i in range(len(part)) for a, b in [(q[i], q[i + 1])] if p[i] < p[i + 1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for ids, w, _ in slices(batches, id_col, text_col, False):
            h, at = windows(w.hashes(), w.row, block)
            if not len(h):
                continue
            first = np.cumsum(w.counts) - w.counts
            at_doc = at - first[w.row[at]]
            own = at_doc % block == 0
            h >>= shift
            held.append((h, h[own], w.row[at[own]], at_doc[own] // block, ids))
            n += len(h)
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return run


def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of one hash range that two probes or more have; rows without probes are hits as they come."""

    def located(docs: np.ndarray, at: np.ndarray, ids: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)[docs]), pa.array(at.astype(np.int32))], names=["_id", "block"])

    seen, found = [], []
    for b in batches:
        for probes, *rest in zip(*(b[c].to_pylist() for c in ("probes", "hashes", "docs", "at", "ids")), strict=True):
            if probes is None:
                yield located(widen(rest[1]), widen(rest[2]), rest[3])
            else:
                seen.append(unpack(probes))
                found.append(rest)
    if not seen:
        return
    every = np.sort(np.concatenate(seen))
    many = every[1:][every[1:] == every[:-1]]
    many = many[np.concatenate(([True], many[1:] != many[:-1]))] if len(many) else many
    for hashes, docs, at, ids in found:
        h = unpack(hashes)
        where = np.searchsorted(many, h)
        where[where == len(many)] = 0
        ok = many[where] == h if len(many) else np.zeros(len(h), bool)
        if ok.any():
            yield located(widen(docs)[ok], widen(at)[ok], ids)


def _first(h: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Of sorted windows, the place where each one's equals begin."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (low[1:] != low[:-1])
    return np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))


def _later(doc: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts that aren't those of the first of their equals (repeated rows of one document have one start)."""
    later = (doc != doc[first]) | (at != at[first])
    return doc[later], at[later]


def _by_document(doc: np.ndarray, at: np.ndarray, dest: list[int]) -> list[tuple[int, bytes, bytes]]:
    """Starts dealt by document: destination, documents with counts, places."""
    to = (mix(doc.view(np.uint64)) % np.uint64(len(dest))).astype(np.int64)
    order = np.lexsort((doc, to))
    doc, at, to = doc[order], at[order], to[order]
    cuts = np.searchsorted(to, np.arange(len(dest) + 1))
    return [(dest[i], _counted(doc[a:b]), narrow(at[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]


def candidates(part: list[int], window: int, block: int, id_col: str, text_col: str) -> Callable:
    """Hashes of the windows around hit blocks; one blob for each part and a few MB of texts."""
    cuts = bounds(len(part), 64)

    def flush(held: list) -> pa.RecordBatch:
        h, low, at = (np.concatenate([x[i] for x in held]) for i in (0, 1, 3))
        base = np.cumsum([0, *(len(x[4]) for x in held)])
        doc = np.concatenate([x[2] + b for x, b in zip(held, base, strict=False)])
        ids = np.concatenate([x[4] for x in held])
        order = np.lexsort((at, ids[doc], low, h))
        h, low, doc, at = h[order], low[order], doc[order], at[order]
        first = _first(h, low)
        later = _later(ids[doc], at, first)
        own = first == np.arange(len(h))
        h, low, doc, at = h[own], low[own], doc[own], at[own]
        q = _dealt(h, cuts)
        rows = [(part[i], low[a:b].tobytes(), *_located(h[a:b], doc[a:b], at[a:b], ids)) for i in range(len(part)) for a, b in [(q[i], q[i + 1])] if a < b]
        return _batch([*((to, None, None, d, x, None) for to, d, x in _by_document(*later, part)), *rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for ids, w, some in slices(batches, id_col, text_col, False):
            blocks = some["blocks"].fill_null([])
            size = np.diff(blocks.offsets.to_numpy())
            first = np.cumsum(w.counts) - w.counts
            flags = np.zeros(len(w.starts) + WINDOW, bool)  # of the first word of each hit block
            flags[first[np.repeat(np.arange(w.n), size)] + blocks.flatten().to_numpy().astype(np.int64) * block] = True
            words = w.hashes()
            h, at = windows(words, w.row, window)
            at_doc = at - first[w.row[at]]
            ok = flags[at + (-at_doc) % block]
            if not ok.any():
                continue
            low = windows(mix(words), w.row, window, seed=7)[0][ok]
            # 64 bits of the range and the order, 32 more to tell apart
            held.append((h[ok], (low >> np.uint64(32)).astype(np.uint32), w.row[at[ok]], at_doc[ok], ids))
            n += int(ok.sum())
            if n >= FLUSH // 2:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return run


STARTS = (pa.int32(), pa.binary(), pa.binary())


def repeats(dest: list[int]) -> Callable:
    """The windows of one hash range that start earlier elsewhere, as blobs dealt by document; rows without a range pass."""

    def starts(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), STARTS, strict=True)], names=["part", "docs", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[], [], [], []]
        for b in batches:
            for to, low, hashes, docs, at, ids in zip(*(b[c].to_pylist() for c in ("part", "probes", "hashes", "docs", "at", "ids")), strict=True):
                if low is None:
                    yield starts([(to, docs, at)])
                    continue
                for x, y in zip(got, (unpack(hashes), np.frombuffer(low, np.uint32), np.frombuffer(ids, np.int64)[widen(docs)], widen(at)), strict=True):
                    x.append(y)
        if not got[0]:
            return
        h, low, doc, at = map(np.concatenate, got)
        order = np.lexsort((at, doc, low, h))
        h, low, doc, at = h[order], low[order], doc[order], at[order]
        if rows := _by_document(*_later(doc, at, _first(h, low)), dest):
            yield starts(rows)

    return run


def _counted(doc: np.ndarray) -> bytes:
    """Sorted ids as distinct ids and their counts."""
    at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    n = narrow(np.diff(np.append(at, len(doc))))
    return len(n).to_bytes(8, "little") + n + pack(doc[at].view(np.uint64))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document that loses words: its starts of repeated windows."""
    ids, starts = [], []
    for b in batches:
        for docs, at in zip(b["docs"].to_pylist(), b["at"].to_pylist(), strict=True):
            n = 8 + int.from_bytes(docs[:8], "little")
            ids.append(np.repeat(unpack(docs[n:]).view(np.int64), widen(docs[8:n])))
            starts.append(widen(at).astype(np.uint32))
    if not ids:
        return
    doc, at = np.concatenate(ids), np.concatenate(starts)
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    cuts = np.append(np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))), len(doc))
    for a in range(0, len(cuts) - 1, 1000):
        some = [(int(doc[x]), pack(at[x:y].astype(np.uint64))) for x, y in zip(cuts[a : a + 1000], cuts[a + 1 : a + 1001], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.binary())], names=["_id", "starts"])


def kept(window: int, id_col: str, text_col: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w, some in slices(batches, id_col, text_col, False):
            first = np.cumsum(w.counts) - w.counts
            cover = np.zeros(len(w.starts) + 1, np.int32)
            for i, blob in enumerate(some["starts"].to_pylist()):
                if blob:
                    at = first[i] + unpack(blob).astype(np.int64)
                    cover[at] += 1
                    cover[at + window] -= 1
            stay = np.cumsum(cover)[:-1] == 0
            left = np.bincount(w.row[stay], minlength=w.n)
            texts = _texts(w, stay, left)
            out = {"n_words": pa.array(w.counts.astype(np.int64)), "n_removed": pa.array((w.counts - left).astype(np.int64)), "kept": texts}
            yield pa.RecordBatch.from_arrays([some[id_col].cast(pa.int64()), *out.values()], names=["doc_id", *out])

    return run


def _texts(w: Words, stay: np.ndarray, left: np.ndarray) -> pa.Array:
    """The words that stay, joined by one space, for each text."""
    starts, ends = w.starts[stay], w.ends[stay]
    size = ends - starts + 1  # with one space after each
    total = int(size.sum())
    shift = starts - (np.cumsum(size) - size)
    source = np.arange(total) + np.repeat(shift, size)
    data = w.data[np.minimum(source, len(w.data) - 1)] if total else np.zeros(0, np.uint8)
    last = np.cumsum(size) - 1
    data = data.copy()
    data[last] = 0x20
    by = np.cumsum(left)  # words up to and with each text
    drop = last[by[left > 0] - 1]
    data = np.delete(data, drop)
    length = np.bincount(w.row[stay], weights=size, minlength=w.n).astype(np.int64) - (left > 0)
    offsets = np.concatenate(([0], np.cumsum(length)))
    return pa.StringArray.from_buffers(w.n, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes()))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, _t (text), _id: a key of (doc_id, text) in the order of the ids.

    That is the id where each has one text. Else it numbers the distinct pairs of id and hash of the text, range by range.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    rows = rows.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))))
    pairs = rows.select("_id", F.xxhash64("_t").alias("_row"))
    if pairs.groupBy("_id").agg(F.min("_row").alias("a"), F.max("_row").alias("b")).filter("a <> b").isEmpty():
        return rows
    order = pairs.distinct().repartitionByRange(parts_of(docs.sparkSession), "_id", "_row").sortWithinPartitions("_id", "_row")
    keys = written(order.withColumn("_key", F.monotonically_increasing_id()), "keys")
    return written(rows.withColumn("_row", F.xxhash64("_t")).join(keys, ["_id", "_row"]).select("doc_id", "_t", F.col("_key").alias("_id")), "keyed")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    spark = docs.sparkSession
    block = window // 2
    docs = keyed(docs, id_col, text_col)
    part = labels(spark, n := parts_of(spark))
    # false hits stay rare: as many bits as documents have, and 24
    bits = min(64, max(42, 24 + math.ceil(math.log2(docs.count() + 1))))
    blobs = docs.select("_id", "_t").mapInArrow(probes(part, bits, window, block, "_id", "_t"), BLOBS).repartition(n, "part")
    hits = written(blobs.mapInArrow(hit, "_id long, block int"), "hits")
    by_doc = hits.groupBy("_id").agg(F.collect_list("block").alias("blocks"))
    dealt = docs.repartition("_id")
    found = dealt.join(by_doc, "_id").select("_id", "_t", "blocks").mapInArrow(candidates(part, window, block, "_id", "_t"), BLOBS)
    later = found.repartition(n, "part").mapInArrow(repeats(part), "part int, docs binary, at binary")
    starts = later.repartition(n, "part").mapInArrow(gathered, "_id long, starts binary")
    return dealt.join(starts, "_id", "left").select("doc_id", "_t", "starts").mapInArrow(kept(window, "doc_id", "_t"), "doc_id long, n_words long, n_removed long, kept string")


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
