"""Token ids in files, coded by an adaptive context-mixing range coder.

Ids of documents, each with an end id, are cut into blocks of BLOCK ids at most that are coded independently: every block begins
anew and has a CRC-32 of its ids, which reading verifies. A block is LANES interleaved streams at most that are coded in step,
so Python runs once for some thousand ids, and all of them learn from what all have coded so far:

- order 2 and order 1 predict the id that followed the last two ids, or the last one, each with a confidence;
- order 0 is the adaptive frequency of every id, brought up to date as the block goes on;
- whether the prediction of order 2, else of order 1, holds is a mixture of adaptive estimates in the logistic
  domain, by weights that are chosen by the confidences and learnt online (`Mixer`); what is left goes to order 0.

A range coder of 64 bits with carries codes the interval of that mixture. All is in whole numbers, so that every machine decodes alike.

A file row is a group of whole documents (BLOCK ids, or one longer document) with its blocks; the files are
Parquet tables of such rows under Spark's commit protocol, one for each range of doc_id, in ascending order.
Texts are shuffled once, into ranges; starts are running sums within ranges and offsets over ranges.

White space separates words for this vocabulary and normalisation never crosses it, so distinct new words are encoded once: plain
words (Latin letters, then marks) by merging arrays of ranks of many words at once, others by the tokenizers library. Tasks remember
the ids of SLOTS words at most (a speed matter only).

Defined results: null counts as the empty text, whose ids are the end id; doc_id null comes last; rows repeated with one doc_id follow
each other, in an order by text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.bpe import byte_letters
from paperloom.llm.words import NO_ID, Words, narrow, parts_of, widen
from paperloom.session import shared_dir, written

BLOCK, LANES, STEPS, BATCH = 1 << 21, 1 << 14, 128, 4_000_000
#: Words that a task remembers, and ids of words after which it forgets them.
SLOTS, POOL = 1 << 21, 1 << 24
SLOT_SHIFT = np.uint64(43)
END = 1
#: Bits of a share between the three orders, and of one within order 0.
KIND, WIDTH = 12, 18
#: Cells of two confidences of 0 to 7, and whether both predict one id.
GRID = 128


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Coder


U16 = np.uint64(16)


def _squash() -> np.ndarray:
    """12-bit probability of a log odds of 256 units, for -2047 to 2047."""
    return np.clip(np.rint(4096 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 1, 4095).astype(np.int64)


SQUASH = _squash()
STRETCH = np.clip(np.searchsorted(SQUASH, np.arange(4096)) - 2047, -2047, 2047)


class Mixer:
    """Probability that a prediction holds, for each cell of the grid of confidences.

    Three adaptive estimates (of all cells, of the cell's row, of the cell itself) are combined in the logistic domain by
    weights of the cell's row, which are learnt online. Whole numbers only, so that every machine gets the same.
    """

    def __init__(self, row: np.ndarray):
        self.row, self.rows = row, int(row.max()) + 1
        self.hits, self.seen = np.zeros(GRID, np.int64), np.zeros(GRID, np.int64)
        self.w = np.full((3, self.rows), 1 << 15, np.int64)
        self.predict()

    def predict(self) -> None:
        h = np.stack([np.full(GRID, self.hits.sum()), self._by_row(self.hits)[self.row], self.hits])
        n = np.stack([np.full(GRID, self.seen.sum()), self._by_row(self.seen)[self.row], self.seen])
        self.x = STRETCH[(h * 4096 + 1638) // (n + 1) * 4094 // 4096]
        self.p = SQUASH[np.clip((self.w[:, self.row] * self.x).sum(0) >> 16, -2047, 2047) + 2047]

    def _by_row(self, n: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, n, self.rows).astype(np.int64)

    def update(self, hits: np.ndarray, seen: np.ndarray) -> None:
        error = hits * 4096 - seen * self.p
        total = np.maximum(self._by_row(seen), 1)
        for i in range(3):
            self.w[i] += self._by_row(error * self.x[i]) // total >> 7
        np.clip(self.w, 0, 1 << 18, out=self.w)
        self.hits += hits
        self.seen += seen
        old = self.seen > 1 << 16
        self.hits[old] >>= 1
        self.seen[old] >>= 1
        self.predict()


TWO = np.arange(GRID) >> 4
ONE = (np.arange(GRID) >> 1) & 7


class Model:
    """Predictions of orders 0 to 2 of one block, adapted from all its lanes' past."""

    def __init__(self, lanes: int, n_ids: int):
        self.v = 1 << max(8, (n_ids - 1).bit_length())
        self.slots = max(1 << WIDTH, 4 * self.v)
        self.width = self.slots.bit_length() - 1
        self.int = np.int32 if KIND + self.width < 31 else np.int64  # holds a place in an interval
        self.bits = min(17, max(10, (lanes * STEPS).bit_length()))
        self.two, self.one = np.zeros(1 << self.bits, np.int32), np.zeros(self.v, np.int32)
        self.p2, self.p1 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.count = np.zeros(self.v, np.int64)
        self.mix2, self.mix1 = Mixer(TWO), Mixer(ONE)
        self.counted, self.due, self.t = 0, 0, 0
        self.held: list = []
        self.stats = np.zeros(GRID * 3, np.int64)
        self.count_ids()
        self.set_kinds()

    def count_ids(self) -> None:
        """Order 0: shares of the slots by the ids so far; no id is without a slot."""
        if self.held:
            x = np.concatenate(self.held)
            self.count += np.bincount(x, minlength=self.v)
            self.counted += len(x)
            self.held = []
        self.freq = 1 + self.count * (self.slots - self.v) // max(self.counted, 1)
        self.freq[0] += self.slots - int(self.freq.sum())
        self.cum = (np.cumsum(self.freq) - self.freq).astype(self.int)
        self.freq = self.freq.astype(self.int)
        self.slot = None

    def set_kinds(self) -> None:
        two = np.clip(self.mix2.p, 8, 4040)
        one = np.clip((4096 - two) * self.mix1.p >> 12, 8, 4072 - two)
        self.f2, self.both = two.astype(self.int), (two + one).astype(self.int)

    def predict(self) -> None:
        self.i2 = ((self.p2 * 0x9E3779B1 + self.p1 * 0x85EBCA6B) >> 15) & ((1 << self.bits) - 1)
        self.t2, self.t1 = self.two.take(self.i2), self.one.take(self.p1)
        self.q2, self.q1 = self.t2 >> 3, self.t1 >> 3
        self.cell = ((((self.t2 & 7) << 3) | (self.t1 & 7)) << 1) | (self.q1 == self.q2)
        self.two_end, self.both_end = self.f2.take(self.cell), self.both.take(self.cell)

    def update(self, x: np.ndarray, hit2: np.ndarray, same1: np.ndarray, kind: np.ndarray) -> None:
        new = (x << 3) | 1
        cell = self.cell
        for table, i, t, ok in ((self.two, self.i2, self.t2, hit2), (self.one, self.p1, self.t1, same1)):
            c = t & 7
            table[i] = np.where(ok, t + (c < 7), np.where(c > 1, t - ((c + 1) >> 1), new))
        self.p2, self.p1 = self.p1, x.astype(np.int64)
        self.stats += np.bincount(self.cell * 3 + kind, minlength=GRID * 3)
        self.held.append(x)
        self.t += 1
        if not self.t & 15 or not self.t & (self.t - 1):
            k = self.stats.reshape(GRID, 3)
            self.mix2.update(k[:, 0], k.sum(1))
            self.mix1.update(k[:, 1], k[:, 1] + k[:, 2])
            self.set_kinds()
            self.stats[:] = 0
        n = self.t * len(x)
        if n >= self.due:
            self.count_ids()
            self.due = n + min(max(n, 4096), 1 << 16)


TOP = np.uint64(1 << 48)


def encode_block(ids: np.ndarray) -> bytes:
    lanes = min(LANES, max(1, len(ids) // STEPS))
    steps = -(-len(ids) // lanes)
    n_ids = int(ids.max()) + 1
    rows = np.zeros(lanes * steps, np.int32)
    rows[: len(ids)] = ids
    rows = np.ascontiguousarray(rows.reshape(lanes, steps).T)
    m = Model(lanes, n_ids)
    total = np.uint64(KIND + m.width)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    cap = steps * 2 + 8
    out, base = np.zeros(lanes * cap, np.uint16), np.arange(lanes) * cap
    at = base.copy()
    for x in rows:
        m.predict()
        hit2, same1 = x == m.q2, x == m.q1
        w, rest = m.width, 4096 - m.both_end
        two, both = m.two_end << w, m.both_end << w
        begin = np.where(hit2, 0, np.where(same1, two, both + rest * m.cum.take(x)))
        length = np.where(hit2, two, np.where(same1, both - two, rest * m.freq.take(x)))
        kind = np.where(hit2, 0, np.where(same1, 1, 2))
        r = size >> total
        new = low + r * begin.astype(np.uint64)
        over = np.flatnonzero(new < low)
        if len(over):
            to = at[over] - 1
            while len(to):
                out[to] += 1
                to = to[out[to] == 0] - 1
        low, size = new, r * length.astype(np.uint64)
        small = np.flatnonzero(size < TOP)
        while len(small):
            l = low[small]
            out[at[small]] = l >> np.uint64(48)
            at[small] += 1
            low[small] = l << U16
            size[small] = s = size[small] << U16
            small = small[s < TOP]
        m.update(x, hit2, same1, kind)
    for _ in range(4):
        out[at] = low >> np.uint64(48)
        at += 1
        low <<= U16
    used = at - base
    body = out[np.repeat(base - (np.cumsum(used) - used), used) + np.arange(int(used.sum()))]
    return np.array([len(ids), lanes, n_ids], "<u4").tobytes() + used.astype("<u4").tobytes() + body.astype("<u2").tobytes()


def decode_block(b: bytes) -> np.ndarray:
    n, lanes, n_ids = np.frombuffer(b, "<u4", 3).tolist()
    steps = -(-n // lanes)
    used = np.frombuffer(b, "<u4", lanes, 12).astype(np.int64)
    data = np.append(np.frombuffer(b, "<u2", offset=12 + 4 * lanes), np.zeros(1, np.uint16)).astype(np.uint16)
    at = np.cumsum(used) - used
    m = Model(lanes, n_ids)
    total = np.uint64(KIND + m.width)
    last = np.uint64((1 << (KIND + m.width)) - 1)
    code, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    for _ in range(4):
        code = (code << U16) | data[at]
        at += 1
    out = np.empty((steps, lanes), np.int32)
    every = np.arange(m.v, dtype=np.int32)
    for t in range(steps):
        m.predict()
        if m.slot is None:
            m.slot = np.repeat(every, m.freq)
        w, rest = m.width, 4096 - m.both_end
        two, both = m.two_end << w, m.both_end << w
        r = size >> total
        v = np.minimum(code // r, last).astype(m.int)
        hit2, zero = v < two, v >= both
        place = np.where(zero, (v - both) // rest, 0)
        x = np.where(zero, m.slot.take(place), np.where(hit2, m.q2, m.q1))
        begin = np.where(hit2, 0, np.where(zero, both + rest * m.cum.take(x), two))
        length = np.where(hit2, two, np.where(zero, rest * m.freq.take(x), both - two))
        code = code - r * begin.astype(np.uint64)
        size = r * length.astype(np.uint64)
        small = np.flatnonzero(size < TOP)
        while len(small):
            to = at[small]
            code[small] = (code[small] << U16) | data.take(to, mode="clip")  # damaged ones may run over
            at[small] = to + 1
            size[small] = s = size[small] << U16
            small = small[s < TOP]
        m.update(x, hit2, x == m.q1, np.where(hit2, 0, np.where(zero, 2, 1)))
        out[t] = x
    return out.T.ravel()[:n].astype("<u4")


# Words

MULT = np.uint64(0x9E3779B97F4A7C15)
NONE = np.iinfo(np.int32).max


class Merges:
    """Byte-pair merges of many words of one length at once, by contiguous arrays of ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = [c for c, _ in sorted(byte_letters().items(), key=lambda x: x[1])]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.symbols = np.array([vocab[c + e] for e in ("", end) for c in letters], np.int32)  # of bytes, then of last bytes
        keys, ranks = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.uint64), np.arange(len(merges), dtype=np.int32)
        self.levels = []
        while len(keys):  # hashed tables; a pair that finds its place taken goes to the next
            bits = max(6, len(keys).bit_length() + 2)
            at = (keys * MULT >> np.uint64(64 - bits)).view(np.int64)
            first = np.unique(at, return_index=True)[1]
            k, r, more = np.full(1 << bits, (1 << 64) - 1, np.uint64), np.full(1 << bits, NONE, np.int32), np.zeros(1 << bits, bool)
            k[at[first]], r[at[first]] = keys[first], ranks[first]
            keys, ranks = np.delete(keys, first), np.delete(ranks, first)
            more[np.delete(at, first)] = True
            self.levels.append((np.uint64(64 - bits), k, r, more))
        a, b = np.divmod(np.arange(256 * 512), 512)
        self.first = self.rank(self.symbols[a], self.symbols[b])  # of a byte and a byte or last byte

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._found((a.astype(np.int64) << 32 | b).view(np.uint64), 0)

    def _found(self, key: np.ndarray, level: int) -> np.ndarray:
        shift, k, r, more = self.levels[level]
        at = (key * MULT >> shift).view(np.int64)
        out = np.where(k.take(at) == key, r.take(at), NONE)
        if level + 1 < len(self.levels) and len(sub := np.flatnonzero(more.take(at))):
            out[sub] = np.minimum(out[sub], self._found(key[sub], level + 1))
        return out

    def equal(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """raw: a row of bytes for each word. Rows of ids, and how many each word has."""
        raw = raw.astype(np.int64)
        raw[:, -1] += 256
        parts = self.symbols[raw]
        out, size, rows = np.empty(parts.shape, np.int32), np.empty(len(parts), np.int64), np.arange(len(parts))
        ranks = self.first[(raw[:, :-1] << 9) + raw[:, 1:]]
        while len(rows):
            m = parts.shape[1]
            i = np.arange(len(rows))
            at = ranks.argmin(1) if m > 1 else np.zeros(len(rows), np.int64)
            best = ranks[i, at] if m > 1 else np.full(len(rows), NONE)
            live = best != NONE
            if not live.all():
                done = rows[~live]
                out[done, :m], size[done] = parts[~live], m
                rows, parts, ranks, at, best = rows[live], parts[live], ranks[live], at[live], best[live]
                i = i[: len(rows)]
                if not len(rows):
                    break
            parts[i, at] = self.merged[best]
            stay = np.ones(parts.shape, bool)
            stay[i, at + 1] = False  # the boundary goes
            parts = parts[stay].reshape(len(rows), m - 1)
            ranks = ranks[stay[:, 1:]].reshape(len(rows), m - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < m - 2)
            ranks[before, at[before] - 1] = self.rank(parts[before, at[before] - 1], parts[before, at[before]])
            ranks[after, at[after]] = self.rank(parts[after, at[after]], parts[after, at[after] + 1])
        return out, size


LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK[33:127] = ~LETTER[33:127]
MARK[48:58] = False
LONGEST = 40


def spans(off: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at off."""
    return np.repeat(off - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Encoder:
    """Ids of words. A direct-mapped cache of SLOTS words knows where in a pool of ids each word's are."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library, self.merges = Tokenizer.from_file(path), Merges(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.clear()

    def clear(self) -> None:
        self.keys, self.off, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def add(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(len(self.pool), np.int32))
        at, self.used = self.used, self.used + len(ids)
        self.pool[at : self.used] = ids
        return at

    def of_library(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has."""
        got = [e.ids for a in range(0, len(words), 5_000) for e in self.library.encode_batch_fast([w.decode() for w in words[a : a + 5_000]], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), np.int32), np.array([len(x) for x in got], np.int64)

    def learn(self, w: Words, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of ids of the words of w at new. Plain ones are letters of ASCII and Latin-1, then ASCII marks: those are two pieces."""
        length = w.ends[new] - w.starts[new]
        data = np.append(w.data, np.uint8(32))[spans(w.starts[new], length + 1)]  # each with the white space after it, or a next text's byte
        starts = np.cumsum(length + 1) - (length + 1)
        data[starts + length] = 32
        second = np.zeros(len(data), bool)  # of a Latin-1 letter
        second[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter, mark = LETTER[data] | second, MARK[data]
        letter[:-1] |= second[1:]
        back = np.zeros(len(data), bool)  # a letter after a mark
        back[1:] = mark[:-1] & letter[1:]
        letters, marks, backs = (np.add.reduceat(x.astype(np.int32), starts).astype(np.int64) for x in (letter, mark, back))
        plain = (letters + marks == length) & (letters > 0) & (letters <= LONGEST) & letter[starts] & (backs == 0)
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        low[second & (data < 0x9F)] += 32
        # ids of letters, of whole other words, and of marks, one after another; where each begins and how many there are
        flat, n = [], 0
        off, size = np.zeros((2, len(new)), np.int64), np.zeros((2, len(new)), np.int64)

        def take(half: int, which: np.ndarray, ids: np.ndarray, k: np.ndarray) -> None:
            nonlocal n
            flat.append(ids)
            off[half, which], size[half, which] = n + np.cumsum(k) - k, k
            n += len(ids)

        for m in np.unique(letters[plain]).tolist():
            which = np.flatnonzero(plain & (letters == m))
            ids, k = self.merges.equal(low[starts[which][:, None] + np.arange(m)])
            take(0, which, ids[np.arange(m) < k[:, None]], k)
        raw = data.tobytes()
        which = np.flatnonzero(~plain)
        take(0, which, *self.of_library([raw[a : a + k] for a, k in zip(starts[which].tolist(), length[which].tolist(), strict=True)]))
        which = np.flatnonzero(plain & (marks > 0))
        tails = [raw[a:b] for a, b in zip((starts + letters)[which].tolist(), (starts + length)[which].tolist(), strict=True)]
        order = {t: i for i, t in enumerate(dict.fromkeys(tails))}
        ids, k = self.of_library(list(order))
        at = np.array([order[t] for t in tails], np.int64)
        off[1, which], size[1, which] = n + (np.cumsum(k) - k)[at], k[at]
        flat = np.concatenate([*flat, ids])
        both = size.sum(0)
        return self.add(flat[spans(off.T.ravel(), size.T.ravel())]) + np.cumsum(both) - both, both

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, an end id after each, and how many each text has."""
        w = Words(texts, False)
        if self.used > POOL:
            self.clear()
        h = w.hashes()
        slot = (h >> SLOT_SHIFT).view(np.int64)
        off, size = self.off.take(slot).astype(np.int64), self.size.take(slot).astype(np.int64)
        miss = np.flatnonzero(self.keys.take(slot) != h)
        if len(miss):
            _, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            new = miss[first]
            o, k = self.learn(w, new)
            off[miss], size[miss] = o[back], k[back]
            self.keys[slot[new]], self.off[slot[new]], self.size[slot[new]] = h[new], o, k
        last = np.cumsum(w.counts)
        stop = self.add(np.array([end], np.int32))
        off, size = np.insert(off, last, stop), np.insert(size, last, 1)
        n = np.cumsum(size)[last + np.arange(w.n)] if w.n else np.zeros(0, np.int64)
        return self.pool[spans(off, size)], np.diff(n, prepend=0)


_encoders: dict[str, Encoder] = {}


# Files


def encoded(path: str, end: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        shard, number = TaskContext.get().partitionId(), 0
        docs, tokens, n = [], [], 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate(tokens).astype("<u4")
            cut = [ids[a : a + BLOCK] for a in range(0, len(ids), BLOCK)]
            sums = np.array([zlib.crc32(x) for x in cut], np.uint32).tobytes()
            row = (shard, number, np.array(docs, np.int64).tobytes(), narrow(np.array([len(t) for t in tokens])), sums, [encode_block(x) for x in cut])
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["shard", "number", "docs", "sizes", "sums", "blocks"])

        for b in batches:
            part = np.cumsum(np.asarray(pa.compute.binary_length(b["_t"]).fill_null(0)).astype(np.int64)) // BATCH
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                some = b.slice(x, y - x)
                ids, size = _encoders[path].encode(some["_t"], end)
                stops = np.cumsum(size).tolist()
                for i, z, k in zip(some["_id"].to_pylist(), stops, size.tolist(), strict=True):
                    if n and n + k > BLOCK:
                        yield out()
                        docs, tokens, n, number = [], [], 0, number + 1
                    docs.append(i)
                    tokens.append(ids[z - k : z])
                    n += k
        if docs:
            yield out()

    return run


def write(docs: DataFrame, to: str, path: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The ids of docs as files in the folder to."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("_id"), F.col(text_col).alias("_t"))
    # rows of one id go by their texts, equal ones by chance, so that any number of them is dealt over ranges
    rows = rows.withColumn("_tie", F.xxhash64("_t")).withColumn("_salt", F.rand(5))
    ranged = rows.repartitionByRange(parts_of(docs.sparkSession), "_id", "_tie", "_salt").sortWithinPartitions("_id", "_tie").drop("_tie", "_salt")
    ranged.mapInArrow(encoded(path or default_path(), end), "shard int, number int, docs binary, sizes binary, sums binary, blocks array<binary>").write.parquet(to)


PLACE = "shard int, number int, seq int, _id long"


def decoded(whole: bool) -> Callable:
    """shard, number, seq, _id, and of each document its token bytes, or their number and CRC-32; blocks are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, number, docs, sizes, sums, blocks in zip(*(b[c].to_pylist() for c in ("shard", "number", "docs", "sizes", "sums", "blocks")), strict=True):
                own = []
                for x, s in zip(blocks, np.frombuffer(sums, np.uint32), strict=True):
                    own.append(decode_block(x).tobytes())
                    if zlib.crc32(own[-1]) != s:
                        raise ValueError(f"a block of shard {shard}, group {number} is damaged")
                data, n = b"".join(own), widen(sizes)
                ends = (np.cumsum(n) * 4).tolist()
                texts = [data[e - 4 * k : e] for e, k in zip(ends, n.tolist(), strict=True)]
                place = {"shard": pa.array([shard] * len(n), pa.int32()), "number": pa.array([number] * len(n), pa.int32()), "seq": pa.array(range(len(n)), pa.int32()), "_id": pa.array(np.frombuffer(docs, np.int64))}
                more = {"tokens": pa.array(texts, pa.binary())} if whole else {"n_tokens": pa.array(n), "ids_crc32": pa.array([zlib.crc32(t) for t in texts], pa.int64())}
                yield pa.RecordBatch.from_pydict(place | more)

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """shard, number, seq (places in the files), _id, tokens (little-endian unsigned 32-bit ids) of each document."""
    return spark.read.parquet(path).mapInArrow(decoded(True), f"{PLACE}, tokens binary")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    to = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, to, path)
    # files are decoded once; a narrow row for each document is left
    rows = written(spark.read.parquet(to).mapInArrow(decoded(False), f"{PLACE}, n_tokens long, ids_crc32 long"), "read")
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("_n")).collect()  # a row for each shuffle partition
    total, offsets = 0, []
    for r in sorted(sums, key=lambda r: r["shard"]):
        offsets.append((r["shard"], total))
        total += r["_n"]
    order = Window.partitionBy("shard").orderBy("number", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(F.broadcast(spark.createDataFrame(offsets, "shard int, _from long")), "shard")
    return placed.select(F.when(F.col("_id") != F.lit(int(NO_ID)), F.col("_id")).alias("doc_id"), (F.col("_from") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")
