"""LM scoring by spelled words, and the unigram base. op2 is stream_mixing; it takes from here the counts and lookups of words.

Tokens are the words of the lower-cased text and one end. A word is spelled in bytes, its end
included, each byte in eight bits. Bit predictors with contexts of ORDERS bytes of the word, hashed to
tables of counts, are combined in the logistic domain by weights gated by bit and by how many contexts are known,
learnt online (small batches, each task from the same start, then averaged); an adaptive
map by bit, last byte and mixed probability refines the result. Learning takes each word of the training
documents without its own counts. A token's probability is w * c / N + (1 - w) * p, p the mixed
probability of its spelling and w the Good-Turing share of tokens that were seen before: one
distribution over all words. Each class of training documents (the CLASSES most frequent values of a label
column, and the rest) refines it in the same way by its own counts, and a document is a mixture of the
classes: as it goes on, the classes that fit gain weight, whatever its own label. The
logarithm of that sum is the score; total bits are -score / log10(2).

On Spark: counts of all words of all documents are one grouped aggregation; tables have a fixed size and
are summed from the tasks. Documents send their distinct words, packed and dealt by hash
range, to where the words' values are (as many ranges as hold RANGE_WORDS words each, and no more, which keeps the partial sums in
proportion to the documents), and the partial sums come back to the documents. No text is shuffled.

Defined results: null counts as the empty text, whose one token is the end; a null doc_id is a training document; repeated rows are documents of their
own; without training documents N and V are 0 and base scores 0; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.words import NO_ID, Words, bounds, labels, mix, narrow, pack, parts_of, slices, unpack, widen
from paperloom.session import written

ORDERS = (1, 2, 3, 4, 6)
#: The tables of counts have four slots or more for each training word, within these bounds; they are broadcast, so the upper one is fixed.
LEAST_BITS, MOST_BITS = 14, 19
FOLDS, HELD_OUT = 7, 2
#: Words of a hash range that one task holds at most, and ranges there are at least.
FLUSH, RANGE_WORDS, RANGES = 2 << 20, 1 << 20, 64
GATES, MAP_STEPS, STEP_WORDS, RATE = 64, 33, 512, 0.05
CLASSES = 7
END = b" "  # no word holds a space


# Words and their counts


def _strings(w: Words, at: np.ndarray) -> pa.Array:
    size = w.ends[at] - w.starts[at]
    total = int(size.sum())
    source = np.arange(total) + np.repeat(w.starts[at] - (np.cumsum(size) - size), size)
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(w.data[source].tobytes())])


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of h, and where its distinct values begin."""
    order = np.argsort(h)
    s = h[order]
    return order, np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)


def counted_words(text_col: str, k: int) -> Callable:
    """Words with their counts in the training documents of each of k classes."""
    names = [f"n{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w, some in slices(batches, "_id", text_col, True):
            order, cuts = _distinct(w.hashes())
            cls = np.where(some["_train"].to_numpy(zero_copy_only=False), some["_cls"].to_numpy(), -1)
            own = cls[w.row][order]
            n = [pa.array(np.add.reduceat((own == i).astype(np.int64), cuts) if len(cuts) else np.zeros(0, np.int64)) for i in range(k)]
            yield pa.RecordBatch.from_arrays([_strings(w, order[cuts]), *n], names=["word", *names])
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), *(pa.array([int((cls == i).sum())]) for i in range(k))], names=["word", *names])

    return run


# Bit predictors


class Spelled:
    """Bytes of some words with their ends, the contexts of each, and the slots of each bit in tables of table slots."""

    def __init__(self, words: pa.Array, table: int):
        self.table = table
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        raw = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(0, np.uint8)
        size = np.diff(offsets)
        if len(words) and (ends := np.flatnonzero((size == 1) & (raw[np.minimum(offsets[:-1], max(len(raw) - 1, 0))] == END[0]))).size:
            size = size.copy()
            size[ends] = 0  # the end of a text is spelled as an empty word
        first = np.cumsum(size + 1) - (size + 1)
        self.first, total = first, int((size + 1).sum())
        self.place = np.arange(total) - np.repeat(first, size + 1)
        source = np.repeat(offsets[:-1], size + 1) + self.place
        self.data = np.where(self.place == np.repeat(size, size + 1), END[0], raw[np.minimum(source, max(len(raw) - 1, 0))] if len(raw) else END[0]).astype(np.uint8)
        self.contexts, h, d = [], np.zeros(total, np.uint64), 0
        for order in ORDERS:
            while d < order:
                d += 1
                before = np.zeros(total, np.uint64)
                before[d:] = self.data[:-d]
                before[self.place < d] = 0
                h = (h + before + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            self.contexts.append(mix(h + np.uint64(order)))
        self.last = np.zeros(total, np.int64)
        self.last[1:] = self.data[:-1]
        self.last[self.place == 0] = 0

    def bits(self) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """Bit number, the bits, and their slots in the tables of all orders."""
        for k in range(8):
            node = ((self.data.astype(np.uint64) | np.uint64(256)) >> np.uint64(8 - k)) * np.uint64(0xD6E8FEB86659FD93)
            bit = (self.data >> (7 - k)) & 1
            yield k, bit, [(mix_fast(c + node) >> np.uint64(65 - self.table.bit_length())).astype(np.int64) + i * self.table for i, c in enumerate(self.contexts)]


def mix_fast(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def stretch(n1: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log odds of counts; few counts stay near 0."""
    return np.log((n1 + 0.4) / (n - n1 + 0.4))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t[name]
    return c.chunk(0) if c.num_chunks else pa.array([], c.type)


def tables(table: int, segments: int) -> Callable:
    """Counts of bits and of ones for all slots, in segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, len(ORDERS) * table), np.int32)
        for t in _chunks(batches):
            s = Spelled(_column(t, "word"), table)
            for _, bit, slots in s.bits():
                for i, slot in enumerate(slots):
                    a, b = i * table, (i + 1) * table
                    n[0, a:b] += np.bincount(slot - a, minlength=table)
                    n[1, a:b] += np.bincount(slot[bit == 1] - a, minlength=table)
        if n[0].any():
            step = n.shape[1] // segments
            rows = [(i, zlib.compress(narrow(n[:, i * step : (i + 1) * step].ravel()), 1)) for i in range(segments)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["segment", "counts"])

    return run


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, x in zip(b["segment"].to_pylist(), b["counts"].to_pylist(), strict=True):
            total[i] = total.get(i, 0) + widen(zlib.decompress(x))
    for i, n in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(narrow(n), 1)], pa.binary())], names=["segment", "counts"])


def _inputs(counts: np.ndarray, k: int, slots: list[np.ndarray], bit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of all predictors, and the gate; with bit: without this occurrence."""
    out, gate = [], np.full(len(slots[0]), k * 8)
    for s in slots:
        n, n1 = counts[0][s].astype(np.float32), counts[1][s].astype(np.float32)
        if bit is not None:
            n, n1 = n - 1, n1 - bit
        out.append(stretch(n1, n))
        gate += n > 0
    return np.stack(out, 1), gate


def weights(counts) -> Callable:
    """Gated weights, learnt online over a task's words, with the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, seen = np.full((GATES, len(ORDERS)), 0.3), 0
        for t in _chunks(batches):
            words = _column(t, "word")
            for a in range(0, len(words), STEP_WORDS):
                s = Spelled(words.slice(a, STEP_WORDS), counts.value.shape[1] // len(ORDERS))
                for k, bit, slots in s.bits():
                    x, gate = _inputs(counts.value, k, slots, bit)
                    error = bit - squash((x * w[gate]).sum(1))
                    n = np.maximum(np.bincount(gate, minlength=GATES), 1)
                    for i in range(len(ORDERS)):
                        w[:, i] += RATE * np.bincount(gate, error * x[:, i], GATES) / n
            seen += len(words)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([seen])], names=["w", "n"])

    return run


def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tasks' weights by numbers of words; a few KB from each."""
    rows = sorted((n, w) for b in batches for w, n in zip(b["w"].to_pylist(), b["n"].to_pylist(), strict=True))
    if rows:
        total = sum(n for n, _ in rows)
        yield pa.RecordBatch.from_arrays([pa.array([(sum(np.frombuffer(w) * n for n, w in rows) / total).tobytes()]), pa.array([total])], names=["w", "n"])


def _mixed(model: tuple, s: Spelled, k: int, bit: np.ndarray, slots: list[np.ndarray], own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Mixed log odds of a one, and each bit's place in the adaptive map."""
    counts, w = model[:2]
    x, gate = _inputs(counts, k, slots, bit if own else None)
    x = np.clip((x * w[gate]).sum(1), -12, 12)
    return x, (k * 256 + s.last) * MAP_STEPS + np.rint((x + 12) * ((MAP_STEPS - 1) / 24)).astype(np.int64)


def refinement(model) -> Callable:
    """Counts for the adaptive map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 8 * 256 * MAP_STEPS), np.int64)
        for t in _chunks(batches):
            s = Spelled(_column(t, "word"), model.value[0].shape[1] // len(ORDERS))
            for k, bit, slots in s.bits():
                _, at = _mixed(model.value, s, k, bit, slots, True)
                n[0] += np.bincount(at, minlength=n.shape[1])
                n[1] += np.bincount(at[bit == 1], minlength=n.shape[1])
        if n[0].any():
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([zlib.compress(narrow(n.ravel()), 1)], pa.binary())], names=["segment", "counts"])

    return run


def spelling(model: tuple, words: pa.Array) -> np.ndarray:
    """log10 of each word's probability."""
    s = Spelled(words, model[0].shape[1] // len(ORDERS))
    total = np.zeros(len(s.data))
    for k, bit, slots in s.bits():
        x, at = _mixed(model, s, k, bit, slots, False)
        p = (squash(x) + model[2][at]) / 2
        total += np.log10(np.where(bit == 1, p, 1 - p))
    return np.add.reduceat(total, s.first) if len(words) else np.zeros(0)


def fitted(vocabulary: DataFrame, distinct: int) -> tuple:
    """Counts, weights and map from the words of training documents, of which there are so many; all of bounded size."""
    spark = vocabulary.sparkSession
    words = vocabulary.filter("n > 0").select("word")
    table = 1 << min(MOST_BITS, max(LEAST_BITS, (4 * distinct - 1).bit_length() if distinct else 0))
    segments = 1 << min(LEAST_BITS, max(4, parts_of(spark).bit_length() - 1))  # each is summed by one task, from a part of every task's table
    counts = np.zeros((2, len(ORDERS) * table), np.int32)
    step = counts.shape[1] // segments
    for r in words.mapInArrow(tables(table, segments), "segment int, counts binary").repartition(segments, "segment").mapInArrow(summed, "segment int, counts binary").collect():  # segments rows
        counts[:, r[0] * step : (r[0] + 1) * step] = widen(zlib.decompress(r[1])).reshape(2, step)
    w = np.full((GATES, len(ORDERS)), 0.3)
    for r in words.mapInArrow(weights(spark.sparkContext.broadcast(counts)), "w binary, n long").repartition(1).mapInArrow(averaged, "w binary, n long").collect():  # one row
        w = np.frombuffer(r[0]).reshape(w.shape)
    seen = np.zeros((2, 8 * 256 * MAP_STEPS))
    for r in words.mapInArrow(refinement(spark.sparkContext.broadcast((counts, w))), "segment int, counts binary").repartition(1, "segment").mapInArrow(summed, "segment int, counts binary").collect():
        seen = widen(zlib.decompress(r[1])).reshape(seen.shape)
    start = squash(np.tile(np.linspace(-12, 12, MAP_STEPS), 8 * 256))
    refined = (seen[1] + 8 * start) / (seen[0] + 8)
    return counts, w, refined


# Scores of documents


def values(part: list[int], model, total: int, distinct: int, shares: list[float], sums: list[int]) -> Callable:
    """Base and, by class, score of each word, packed by hash range.

    shares: Good-Turing shares of all tokens and of each class; sums: tokens of each class.
    """
    cuts = bounds(len(part), 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            words, c = _column(t, "word"), t["n"].to_numpy().astype(float)
            base = np.log10((c + 1) / (total + distinct + 1))
            every = shares[0] * c / max(total, 1) + (1 - shares[0]) * 10 ** np.maximum(spelling(model.value, words), -300)
            by = [np.log10(w * t[f"n{i}"].to_numpy() / max(n, 1) + (1 - w) * every) for i, (w, n) in enumerate(zip(shares[1:], sums, strict=True))]
            h = _hashes(words)
            order = np.argsort(h)
            h, table = h[order], np.stack([base, *by, c > 0])[:, order]
            q = np.concatenate(([0], np.searchsorted(h, cuts), [len(h)]))
            yield _rows([(part[i], 0, 0, pack(h[a:b]), table[:, a:b].tobytes(), b"") for i, (a, b) in enumerate(zip(q[:-1], q[1:], strict=True)) if a < b])

    return run


def _hashes(words: pa.Array) -> np.ndarray:
    """The hash of each of some words, as it is within a text; the end has the hash 0."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if words.buffers()[2] else np.zeros(0, np.uint8)
    w = Words.__new__(Words)
    w.data, size = raw, np.diff(offsets)
    w.starts, w.ends = (offsets - offsets[0])[:-1], (offsets - offsets[0])[1:]
    end = (size == 1) & (raw[np.minimum(w.starts, max(len(raw) - 1, 0))] == END[0]) if len(raw) else np.zeros(len(size), bool)
    return np.where(end, np.uint64(0), w.hashes())


SCHEMA = "part int, kind int, flush long, hashes binary, more binary, ids binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "kind", "flush", "hashes", "more", "ids"])


def postings(part: list[int], text_col: str, scored: Callable[[Words], np.ndarray] | None = None) -> Callable:
    """Distinct words of some documents, packed by hash range, with the documents that each occurs in; with scored: ids are followed by its numbers."""
    cuts = bounds(len(part), 64)

    def flush(held: list, name: int) -> pa.RecordBatch:
        h = np.concatenate([x[0] for x in held])
        base = np.cumsum([0, *(len(x[2]) for x in held)])
        doc = np.concatenate([x[1] + b for x, b in zip(held, base, strict=False)])
        ids, n, size_of = (np.concatenate([x[i] for x in held]) for i in (2, 3, 4))
        every = np.arange(len(ids))  # each document has an end
        h, doc = np.concatenate([np.zeros(len(ids), np.uint64), h]), np.concatenate([every, doc])
        order, first = _distinct(h)
        doc, words = doc[order], h[order][first]
        size = np.diff(np.append(first, len(h)))
        first = np.append(first, len(h))
        q = np.concatenate(([0], np.searchsorted(words, cuts), [len(words)]))
        rows = []
        for i, (a, b) in enumerate(zip(q[:-1], q[1:], strict=True)):
            if a < b:
                n_blob, d_blob = narrow(size[a:b]), narrow(doc[first[a] : first[b]])
                rows.append((part[i], 1, name, pack(words[a:b]), len(n_blob).to_bytes(8, "little") + n_blob + d_blob, b""))
        rows.append((part[name % len(part)], 2, name, narrow(size_of), narrow(n), ids.astype(np.int64).tobytes() + b"".join(x[5].tobytes() for x in held)))
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, name = [], 0, TaskContext.get().partitionId() << 32
        for ids, w, _ in slices(batches, "_id", text_col, True):
            held.append((w.hashes(), w.row, ids, w.counts, np.diff(w.offsets), scored(w) if scored else np.zeros(0)))
            n += len(w.starts)
            if n >= FLUSH:
                yield flush(held, name)
                held, n, name = [], 0, name + 1
        if held:
            yield flush(held, name)

    return run


def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums for documents; rows come sorted by kind: first the values of the words of this range."""
    got: list | None = []
    table: tuple = ()
    for b in batches:
        for kind, flush, hashes, more, ids in zip(*(b[c].to_pylist() for c in ("kind", "flush", "hashes", "more", "ids")), strict=True):
            if kind == 0:
                h = unpack(hashes)
                got.append((h, np.frombuffer(more, float).reshape(-1, len(h))))
                continue
            if kind == 2:
                yield pa.RecordBatch.from_arrays([pa.array([flush]), pa.array([len(hashes).to_bytes(8, "little") + hashes + more], pa.binary()), pa.array([ids], pa.binary())], names=["flush", "sums", "ids"])
                continue
            if got is not None:
                h = np.concatenate([x[0] for x in got])
                order = np.argsort(h)
                table, got = (h[order], np.concatenate([x[1] for x in got], 1)[:, order]), None
            at = np.searchsorted(table[0], unpack(hashes))
            n = 8 + int.from_bytes(more[:8], "little")
            at = np.repeat(at, widen(more[8:n]))
            docs, doc = np.unique(widen(more[n:]), return_inverse=True)
            base, *by, known = (np.bincount(doc, x[at], len(docs)) for x in table[1])
            x = pack(docs.astype(np.uint64))
            blob = len(x).to_bytes(8, "little") + x + base.tobytes() + known.astype(np.uint32).tobytes() + b"".join(x.astype(np.float32).tobytes() for x in by)
            yield pa.RecordBatch.from_arrays([pa.array([flush]), pa.array([blob], pa.binary()), pa.array([None], pa.binary())], names=["flush", "sums", "ids"])


def totals(prior: list[float]) -> Callable:
    """The documents of each flush with the sums over all ranges; prior: log10 of each class's share of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        heads: dict[int, tuple] = {}
        for b in batches:
            for flush, sums, ids in zip(*(b[c].to_pylist() for c in ("flush", "sums", "ids")), strict=True):
                if ids is not None:
                    at = 8 + int.from_bytes(sums[:8], "little")
                    heads[flush] = (np.frombuffer(ids, np.int64), widen(sums[at:]), widen(sums[8:at]))
                else:
                    parts.setdefault(flush, []).append(sums)
        for flush, (ids, n, size) in heads.items():
            base, known, by = np.zeros(len(ids)), np.zeros(len(ids), np.int64), np.zeros((len(prior), len(ids)))
            for blob in sorted(parts.pop(flush)):  # one order of summing, whatever order rows came in
                at = 8 + int.from_bytes(blob[:8], "little")
                docs = unpack(blob[8:at]).astype(np.int64)
                base[docs] += np.frombuffer(blob, float, len(docs), at)
                known[docs] += np.frombuffer(blob, np.uint32, len(docs), at + 8 * len(docs))
                by[:, docs] += np.frombuffer(blob, np.float32, offset=at + 12 * len(docs)).reshape(len(prior), -1)
            by += np.array(prior)[:, None]
            best = by.max(0)
            mixed = best + np.log10((10 ** (by - best)).sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n + 1), pa.array(known), pa.array(base), pa.array(mixed), pa.array(size)], names=["_id", "n_tokens", "n_known", "base_score", "score", "n_bytes"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", class_col: str = "lang") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, total_bits, bits_per_byte, bits_per_token."""
    spark = docs.sparkSession

    def held(c: Column) -> Column:
        return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT

    label = F.coalesce(F.col(class_col), F.lit("")) if class_col in docs.columns else F.lit("")
    labelled = docs.filter(~held(F.col(id_col))).groupBy(label.alias("c")).agg(F.count(F.lit(1)).alias("n"))
    counts = labelled.orderBy(F.desc("n"), "c").limit(CLASSES).collect()
    k = len(counts) + 1
    rest = (labelled.agg(F.sum("n")).first()[0] or 0) - sum(r["n"] for r in counts)
    docs_of = [*(r["n"] for r in counts), rest]
    prior = [math.log10((n + 1) / (sum(docs_of) + k)) for n in docs_of]
    cls = F.lit(k - 1)
    for i, r in enumerate(counts):
        cls = F.when(label == r["c"], F.lit(i)).otherwise(cls)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("_id"), F.col(text_col).alias("_t"), (~held(F.col(id_col))).alias("_train"), cls.alias("_cls"))
    names = [f"n{i}" for i in range(k)]
    counted = rows.mapInArrow(counted_words("_t", k), "word binary, " + ", ".join(f"{c} long" for c in names)).groupBy("word").agg(*(F.sum(c).alias(c) for c in names))
    vocabulary = written(counted.withColumn("n", sum((F.col(c) for c in names[1:]), F.col(names[0]))), "words")
    every = ["n", *names]
    got = vocabulary.agg(*(F.sum(c) for c in every), *(F.count(F.when(F.col(c) == 1, 1)) for c in every), F.count(F.when(F.col("n") > 0, 1)), F.count(F.lit(1))).first()
    sums, once, distinct = [x or 0 for x in got[: k + 1]], got[k + 1 : 2 * k + 2], got[2 * k + 2]
    every_word = got[2 * k + 3]
    shares = [1 - max(o, 1) / (n + 1) if n else 0.0 for n, o in zip(sums, once, strict=True)]
    total = sums[0]
    model = spark.sparkContext.broadcast(fitted(vocabulary, distinct))
    part = labels(spark, n := max(min(parts_of(spark), RANGES), -(-every_word // RANGE_WORDS)))
    both = vocabulary.mapInArrow(values(part, model, total, distinct, shares, sums[1:]), SCHEMA).unionByName(rows.select("_id", "_t").mapInArrow(postings(part, "_t"), SCHEMA))
    partial = both.repartition(n, "part").sortWithinPartitions("kind").mapInArrow(looked_up, "flush long, sums binary, ids binary")
    out = partial.repartition("flush").mapInArrow(totals(prior), "_id long, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    known = F.when(F.col("_id") != F.lit(int(NO_ID)), F.col("_id"))
    bits = -F.col("score") / math.log10(2)
    more = [bits.alias("total_bits"), (bits / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"), (bits / F.col("n_tokens")).alias("bits_per_token")]
    return out.select(known.alias("doc_id"), held(known).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", *more)
