"""LM scoring by logistic context mixing over the byte stream of each text, and the unigram base.

A text is the stream of its lower-cased bytes and an end. A byte is a path of bits down a binary code (Huffman's, by the
bytes of the training documents; all 256 bytes have a path). Each bit is predicted from contexts that run on across
words: the last ORDERS bytes, and the bytes since the last white space. A context and the path so far are
hashed to a slot that counts zeros and ones. The log odds of the slots are mixed by weights gated by the path so far; an adaptive map by
path, last byte and mixed log odds refines the result, and the mean of both is the bit's probability. Slots, weights and
map are learnt online: a path's bits pass in the order of the stream, 64 of them at a time and later up to BATCH, and each batch is predicted by what
was learnt before it; what belongs to one path is read by no other, so paths may be worked on one after another. The sum over a text's bits is its total bits, and the score is their log10, from the predictors alone.

On Spark: tasks learn from their training documents, each from the same start; slots and maps are counts, so tasks'
are summed (by segments, dealt by shuffle), weights are averaged by the bits that each was learnt from. The model has a fixed size and is
broadcast; each text is scored in the task that reads it. Counts of words for the base: see context_mixing.

Defined results: null counts as the empty text, whose one symbol is the end; a null doc_id is a training document; repeated rows are documents of their
own; without training documents every bit costs what the start says, N and V are 0 and base scores 0; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.context_mixing import FOLDS, HELD_OUT, RANGE_WORDS, RANGES, SCHEMA, _chunks, _column, _hashes, _rows, counted_words, looked_up, postings, squash, summed
from paperloom.llm.words import IS_SPACE, NO_ID, Bytes, bounds, labels, narrow, pack, parts_of, slices, unpack, widen
from paperloom.session import written

ORDERS = (2, 3, 5)
PREDICTORS = 4  # with the word; four hashes of 32 bits are copied as one value of 128
#: All slots, and a node's at least; the model is broadcast, so its size is fixed.
SLOT_BITS, LEAST_BITS = 21, 8
#: Bytes that are worked on at once, whose contexts are made at once, bytes before them that contexts may reach, bits of a path between updates.
BLOCK, PIECE, REACH, BATCH = 1 << 19, 1 << 15, 32, 8192
#: A slot with so many zeros or ones is halved before it learns more.
FULL = 40000
MAP_STEPS, RATE = 33, 0.2
SEGMENTS = 16
END = 255  # no text in UTF-8 holds this byte


# The binary code of bytes


class Code:
    """Ranks of bytes after each byte, and Huffman's code of ranks as nodes from the root on: which ranks go to the right, and both children (-1: a rank)."""

    def __init__(self, pairs: np.ndarray):
        """pairs: how often each byte follows each."""
        order = np.lexsort((np.arange(256)[None, :].repeat(256, 0), -pairs.sum(0)[None, :].repeat(256, 0), -pairs), axis=1)
        self.ranks = np.argsort(order, axis=1).astype(np.uint8)
        counts = np.take_along_axis(pairs, order, 1).sum(0)
        heap: list = [(int(n) + 1, i, (i,), None) for i, n in enumerate(counts)]
        heapq.heapify(heap)
        made = 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], made, a[2] + b[2], (a, b)))
            made += 1
        self.nodes: list = []
        #: Each node's slots: the first, and the shift that leaves as many bits of a hash as its share of all bits gives it.
        self.slots: list[tuple[int, int]] = []
        todo, begin, whole = [(heap[0], -1, 0)], 0, 0
        for x in (every := [heap[0]]):
            if x[3]:
                whole += x[0]
                every += x[3]
        while todo:
            (n, _, _, pair), parent, side = todo.pop()
            if pair:
                right = np.zeros(256, bool)
                right[list(pair[1][2])] = True
                if parent >= 0:
                    self.nodes[parent][1 + side] = len(self.nodes)
                todo += [(pair[i], len(self.nodes), i) for i in (1, 0)]
                self.nodes.append([right, -1, -1])
                bits = max(LEAST_BITS, ((n << SLOT_BITS) // whole).bit_length() - 1)
                self.slots.append((begin, 32 - bits))
                begin += 1 << bits
        self.size = -(-begin // SEGMENTS) * SEGMENTS

    def paths(self, ranks: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each node that bytes of some ranks pass, with their places, in order, and their bits there."""
        todo = [(0, at, ranks)]
        while todo:
            v, at, ranks = todo.pop()
            right, *children = self.nodes[v]
            bit = right.take(ranks)
            yield v, at, bit
            for side, child in enumerate(children):
                if child >= 0:
                    some = np.flatnonzero(bit if side else ~bit)
                    if len(some):
                        todo.append((child, at.take(some), ranks.take(some)))


def byte_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often bytes follow each other in the training documents' words, with a space before and after each."""
    n = np.zeros(1 << 16)
    for t in _chunks(batches):
        words, of = _column(t, "word"), t["n"].to_numpy()
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        spaced = np.full(len(raw) + len(words) + 1, 0x20, np.int64)
        spaced[np.arange(len(raw)) + np.repeat(np.arange(1, len(words) + 1), np.diff(offsets))] = raw
        n += np.bincount(spaced[:-1] << 8 | spaced[1:], np.repeat(of, np.diff(offsets) + 1), 1 << 16)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["pair", "n"])


# Streams and their contexts


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    step, n = 0x9E3779B1, PIECE + REACH + 1
    out = []
    for p in (step, pow(step, -1, 1 << 32)):
        a = np.full(n, p, np.uint32)
        a[0] = 1
        out.append(np.multiply.accumulate(a, dtype=np.uint32))
    return out[0], out[1]


def stream(w: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of some texts, each with an end, and REACH ends before each, so that no context reaches another text; the places where texts begin in it; whether a byte is one of a text or its end."""
    starts = w.offsets[:-1] + np.arange(1, w.n + 1) * REACH + np.arange(w.n)
    out = np.full(len(w.data) + w.n * (REACH + 1), END, np.uint8)
    coded = np.ones(len(out), bool)
    coded[(starts[:, None] - np.arange(1, REACH + 1)).ravel()] = False
    ends = starts + np.diff(w.offsets)
    coded[ends] = False
    out[coded] = w.data
    coded[ends] = True
    return out, starts, coded


def contexts(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """Hashes of the contexts of the bytes from a to b, as one value for each byte; at least REACH bytes are before a."""
    out = np.empty((b - a, PREDICTORS), np.uint32)
    for k in range(a, b, PIECE):
        _contexts(data[k - REACH : min(k + PIECE, b)], out[k - a : k - a + PIECE])
    return out.view(np.complex128).ravel()


def _contexts(data: np.ndarray, out: np.ndarray) -> None:
    d, n = data.astype(np.uint32), len(out)
    d += np.uint32(1)
    h, k = np.zeros(n, np.uint32), 0
    for i, order in enumerate(ORDERS):
        while k < order:
            k += 1
            h += d[REACH - k : REACH - k + n]
            h *= np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out[:, i] = (h + np.uint32(i)) * np.uint32(0x85EBCA6B)
    power, inverse = _powers()
    total = np.zeros(n + REACH + 1, np.uint32)
    np.cumsum(d * power[: n + REACH], dtype=np.uint32, out=total[1:])
    start = np.zeros(n + REACH, np.int64)
    cuts = np.flatnonzero(BREAKS.take(data[:-1])) + 1
    start[cuts] = cuts
    start = np.maximum(np.maximum.accumulate(start)[REACH:], np.arange(1, n + 1))  # the last REACH - 1 bytes of a longer word
    h = (total[REACH:-1] - total.take(start)) * inverse.take(start)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    out[:, -1] = (h ^ (h >> np.uint32(13))) * np.uint32(0x297A2D39)


BREAKS = IS_SPACE.copy()
BREAKS[END] = True


def blocks(code: Code, data: np.ndarray, coded: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Iterator]]:
    """Blocks of a stream: bounds, contexts, last bytes, and the paths of its bytes."""
    for a in range(REACH, len(data), BLOCK):
        b = min(a + BLOCK, len(data))
        last = data[a - 1 : b - 1]
        at = np.flatnonzero(coded[a:b])
        ranks = code.ranks.ravel().take(last.astype(np.int64) << 8 | data[a:b])
        yield a, b, contexts(data, a, b), last, code.paths(ranks.take(at), at)


def slots(code: Code, node: int, hashes: np.ndarray) -> np.ndarray:
    """The slots of contexts among those of a node, a row for each byte."""
    return (hashes.view(np.uint32).reshape(-1, PREDICTORS) >> np.uint32(code.slots[node][1])).astype(np.int64)


def places(mixed: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where mixed log odds after some last byte fall in a node's adaptive map."""
    step = mixed * np.float32((MAP_STEPS - 1) / 24)
    step += np.float32(MAP_STEPS / 2)
    at = last * np.int64(MAP_STEPS)
    at += step.astype(np.int64)
    return at


def mixture(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted log odds, between -12 and 12."""
    mixed = x @ weights
    np.maximum(mixed, np.float32(-12), out=mixed)
    return np.minimum(mixed, np.float32(12), out=mixed)


def chance(mixed: np.ndarray) -> np.ndarray:
    p = np.negative(mixed)
    np.exp(p, out=p)
    p += np.float32(1)
    return np.reciprocal(p, out=p)


def odds(slot: np.ndarray) -> np.ndarray:
    """Log odds of a one from a slot's counts; few counts stay near 0."""
    ones = (slot & 0xFFFF).astype(np.float32)
    ones += np.float32(0.4)
    zeros = (slot >> 16).astype(np.float32)
    zeros += np.float32(0.4)
    ones /= zeros
    return np.log(ones, out=ones)


# Learning


class Learner:
    """What a task learns: slots (zeros in the upper, ones in the lower half), weights with the bits they were learnt from, map."""

    def __init__(self, code: Code):
        self.code = code
        self.slots = np.zeros(code.size, np.uint32)
        self.weights = np.full((len(code.nodes), PREDICTORS), 0.3, np.float32)
        self.seen = np.zeros(len(code.nodes), np.int64)
        self.map = np.zeros((len(code.nodes), 256 * MAP_STEPS), np.int64)  # bits in the upper, ones in the lower half

    def learn(self, data: np.ndarray, coded: np.ndarray) -> None:
        for _, _, hashes, last, paths in blocks(self.code, data, coded):
            for v, at, bit in paths:
                k = 0
                while k < len(at):
                    n = min(BATCH, 64 + int(self.seen[v]) // 4)  # small ones as long as little is known
                    some = at[k : k + n]
                    self._batch(v, hashes.take(some), last.take(some), bit[k : k + n])
                    k += n

    def _batch(self, v: int, hashes: np.ndarray, last: np.ndarray, bit: np.ndarray) -> None:
        slot, own = slots(self.code, v, hashes), self.slots[self.code.slots[v][0] :]
        n = own.take(slot)
        if n.view(np.uint16).max() >= FULL:
            full = np.flatnonzero(n.view(np.uint16) >= FULL) >> 1
            n.ravel()[full] = own[slot.ravel()[full]] = (n.ravel()[full] >> 1) & 0x7FFF7FFF
        x = odds(n)
        mixed = mixture(x, self.weights[v])
        p = chance(mixed)
        error = bit - p
        self.weights[v] += RATE * (error @ x) / (((p * (1 - p)) @ (x * x)).sum() + 32)  # no step beyond the curvature
        self.seen[v] += len(bit)
        np.add.at(self.map[v], places(mixed, last), bit + (np.int64(1) << 32))
        np.add.at(own, slot.ravel(), np.where(bit, *ADDED).view(np.uint32))


#: What a one and a zero add to a slot of each predictor.
ADDED = [np.full(PREDICTORS, n, np.uint32).view(np.complex128)[0] for n in (1, 1 << 16)]
#: Weights are summed as whole numbers, so that no order of tasks changes them.
WEIGHT_MOST, WEIGHT_UNIT = 32, 1 << 16


def learnt(code: Code, text_col: str) -> Callable:
    """A task's counts of zeros and ones, its map and its weights, in segments of numbers that can be added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(code)
        for _, w, _ in slices(batches, "_id", text_col, True, Bytes):
            data, _, coded = stream(w)
            learner.learn(data, coded)
        if not learner.seen.any():
            return
        n = np.stack([learner.slots >> 16, learner.slots & 0xFFFF])
        blobs = [part.ravel() for part in np.split(n, SEGMENTS, 1)]
        blobs += [np.stack([part >> 32, part & 0xFFFFFFFF]).ravel() for part in np.array_split(learner.map, SEGMENTS)]
        weights = np.clip(learner.weights.astype(float), 1 - WEIGHT_MOST, WEIGHT_MOST - 1) + WEIGHT_MOST
        blobs.append(np.concatenate([learner.seen, np.rint(weights * WEIGHT_UNIT).astype(np.int64).ravel() * learner.seen.repeat(PREDICTORS)]))
        for i, x in enumerate(blobs):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(narrow(x), 1)], pa.binary())], names=["segment", "counts"])

    return run


class Model:
    """What all tasks learnt: the code, log odds of slots in units of 1 / ODDS_UNIT, weights, and chances by the adaptive map."""

    ODDS_UNIT = 2048

    def __init__(self, code: Code, sums: dict[int, np.ndarray]):
        nodes, step = len(code.nodes), code.size // SEGMENTS
        self.code = code
        self.odds = np.zeros(code.size, np.int16)
        self.weights = np.full((nodes, PREDICTORS), 0.3)
        n = np.zeros((2, nodes, 256 * MAP_STEPS))
        for i, part in enumerate(np.array_split(np.arange(nodes), SEGMENTS)):
            if i in sums:
                zeros, ones = sums[i].reshape(2, step) + 0.4
                self.odds[i * step : (i + 1) * step] = np.rint(np.clip(np.log(ones / zeros), -15.9, 15.9) * self.ODDS_UNIT)
            if SEGMENTS + i in sums:
                n[:, part] = sums[SEGMENTS + i].reshape(2, len(part), -1)
        if 2 * SEGMENTS in sums:
            seen, weights = sums[2 * SEGMENTS][:nodes], sums[2 * SEGMENTS][nodes:].reshape(nodes, PREDICTORS)
            some = seen > 0
            self.weights[some] = weights[some] / seen[some, None] / WEIGHT_UNIT - WEIGHT_MOST
        self.weights = (self.weights / self.ODDS_UNIT).astype(np.float32)
        start = squash(np.tile(np.linspace(-12, 12, MAP_STEPS), 256))
        self.map = ((n[1] + 8 * start) / (n[0] + 8)).astype(np.float32)

    def chances(self, v: int, hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The chance of a one at a node."""
        x = self.odds[self.code.slots[v][0] :].take(slots(self.code, v, hashes)).astype(np.float32)
        mixed = mixture(x, self.weights[v])
        p = chance(mixed)
        p += self.map[v].take(places(mixed, last))
        p *= np.float32(0.5)
        return p

    def log10(self, w: Bytes) -> np.ndarray:
        """log10 of each text's probability: the sum over its bits."""
        data, starts, coded = stream(w)
        total = np.zeros(w.n)
        for a, b, hashes, last, paths in blocks(self.code, data, coded):
            texts = slice(max(0, np.searchsorted(starts, a, "right") - 1), np.searchsorted(starts, b))
            edges = np.concatenate((starts[texts] - a, [b - a]))
            edges[0] = 0
            sums = total[texts]
            for v, at, bit in paths:
                for k in range(0, len(at), BATCH):
                    some, ones = at[k : k + BATCH], bit[k : k + BATCH]
                    p = self.chances(v, hashes.take(some), last.take(some))
                    p = np.log(np.where(ones, p, 1 - p))
                    if len(edges) < len(some):
                        run = np.concatenate(([0], np.cumsum(p, dtype=float)))
                        sums += np.diff(run[np.searchsorted(some, edges)])
                    else:
                        np.add.at(sums, np.searchsorted(edges, some, "right") - 1, p)
        return total / math.log(10)


def fitted(rows: DataFrame, vocabulary: DataFrame) -> Model:
    """The model of training documents (_id, _t), and of the counts n of their words for the code of bytes; all of fixed size."""
    pairs = np.zeros(1 << 16, np.int64)
    for r in vocabulary.filter("n > 0").select("word", "n").mapInArrow(byte_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n")).collect():  # 65536 rows at most
        pairs[r[0]] = r[1]
    code = Code(pairs.reshape(256, 256))
    sums = rows.mapInArrow(learnt(code, "_t"), "segment int, counts binary").repartition(2 * SEGMENTS + 1, "segment").mapInArrow(summed, "segment int, counts binary")
    return Model(code, {i: widen(zlib.decompress(x)) for i, x in sums.collect()})  # 2 * SEGMENTS + 1 rows


# Scores of documents


def values(part: list[int], total: int, distinct: int) -> Callable:
    """Base of each word and whether it is known, packed by hash range."""
    cuts = bounds(len(part), 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            h, c = _hashes(_column(t, "word")), t["n"].to_numpy()
            order = np.argsort(h)
            h, c = h[order], c[order]
            table = np.stack([np.log10((c + 1) / (total + distinct + 1)), c > 0])
            q = np.concatenate(([0], np.searchsorted(h, cuts), [len(h)]))
            yield _rows([(part[i], 0, 0, pack(h[a:b]), table[:, a:b].tobytes(), b"") for i, (a, b) in enumerate(zip(q[:-1], q[1:], strict=True)) if a < b])

    return run


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each flush with their scores, and the sums of base and known words over all ranges."""
    parts: dict[int, list] = {}
    heads: dict[int, tuple] = {}
    for b in batches:
        for flush, sums, ids in zip(*(b[c].to_pylist() for c in ("flush", "sums", "ids")), strict=True):
            if ids is not None:
                at, half = 8 + int.from_bytes(sums[:8], "little"), len(ids) // 2
                heads[flush] = (np.frombuffer(ids[:half], np.int64), np.frombuffer(ids[half:], float), widen(sums[at:]), widen(sums[8:at]))
            else:
                parts.setdefault(flush, []).append(sums)
    for flush, (ids, score, n, size) in heads.items():
        base, known = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for blob in sorted(parts.pop(flush)):  # one order of summing, whatever order rows came in
            at = 8 + int.from_bytes(blob[:8], "little")
            docs = unpack(blob[8:at]).astype(np.int64)
            base[docs] += np.frombuffer(blob, float, len(docs), at)
            known[docs] += np.frombuffer(blob, np.uint32, len(docs), at + 8 * len(docs))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n + 1), pa.array(known), pa.array(base), pa.array(score), pa.array(size)], names=["_id", "n_tokens", "n_known", "base_score", "score", "n_bytes"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, total_bits, bits_per_byte, bits_per_token."""
    spark = docs.sparkSession

    def held(c: Column) -> Column:
        return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("_id"), F.col(text_col).alias("_t"), (~held(F.col(id_col))).alias("_train"), F.lit(0).alias("_cls"))
    counted = rows.mapInArrow(counted_words("_t", 1), "word binary, n0 long").groupBy("word").agg(F.sum("n0").alias("n"))
    vocabulary = written(counted, "words")
    total, distinct, every_word = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1)), F.count(F.lit(1))).first()
    model = spark.sparkContext.broadcast(fitted(rows.filter("_train").select("_id", "_t"), vocabulary))
    part = labels(spark, n := max(min(parts_of(spark), RANGES), -(-every_word // RANGE_WORDS)))
    both = vocabulary.mapInArrow(values(part, total, distinct), SCHEMA).unionByName(rows.select("_id", "_t").mapInArrow(postings(part, "_t", lambda w: model.value.log10(w)), SCHEMA))
    partial = both.repartition(n, "part").sortWithinPartitions("kind").mapInArrow(looked_up, "flush long, sums binary, ids binary")
    out = partial.repartition("flush").mapInArrow(totals, "_id long, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    known = F.when(F.col("_id") != F.lit(int(NO_ID)), F.col("_id"))
    bits = -F.col("score") / math.log10(2)
    more = [bits.alias("total_bits"), (bits / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"), (bits / F.col("n_tokens")).alias("bits_per_token")]
    return out.select(known.alias("doc_id"), held(known).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", *more)
