"""N-gram Jaccard join with token-combination prefixes.

A document's set is its distinct 5-word shingles (tokens below); two documents link when
100 * |A and B| >= 75 * |A or B|. Documents with one set are one class; links and
components are found between classes, so copies are never expanded.

1. Frequencies of all tokens over the whole corpus: tasks send sorted hashes packed by
   hash range. The most frequent tokens, FREQUENT at most and of frequency RARE at least, are
   the frequent class; that bound is why they may be broadcast.
2. Prefixes: tokens in one global order, the rare ones first and the frequent ones by
   frequency. A set of n tokens has a prefix of p = n // 4 + 1 tokens; two linked sets
   share a token of their prefixes. Rare tokens of the prefix are indexed singly. Where a
   prefix reaches frequent tokens it is extended by G: linked sets share G + 1 tokens
   of the extended prefixes, so if they share no rare one, two shared frequent tokens fall in
   one of G groups by hash. Pairs of frequent tokens of one group are indexed: some
   5 * p combinations instead of p * p / 2. G is the power of two at or under p; sets of
   the next larger size class also use the smaller G, as sizes of linked sets differ by a third at most.
   Prefixes under 4 tokens index their frequent tokens singly.
3. Candidates: within one key's list, each class is first verified against a hub only (a
   star, linear in the list), linked classes are joined to components, and only classes of
   different components that still share a key are compared, by parity bitmaps of 1024 bits that
   bound the symmetric difference from below. In some rounds each component is verified against its nearest one
   alone, which joins large groups of near copies in linear numbers of pairs; the last round takes all pairs that are left.
4. Verification on the full sets, with DataFrame functions.

Defined results: null, empty and blank texts have no shingles and link with nothing; a text of 1 to 4
words has one shingle, its whole sequence; doc_id null sorts last; repeated rows are equal sets and so one component;
rows are told apart by id and a hash of the text, so null ids and texts that share an id are documents of their own; extra columns are ignored (`distinct_documents` carries them).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.components import components
from paperloom.llm.names import fresh, own
from paperloom.llm.words import NO_ID, Words, bounds, labels, mix, narrow, pack, parts_of, slices, unpack, widen, windows
from paperloom.session import written

SHINGLE = 5
#: Links need PART of PARTS of the union.
PART, PARTS = 75, 100
#: Least frequency of a frequent token, and how many there may be.
RARE, FREQUENT = 3, 1 << 21
FLUSH = 4 << 20
MARK = 1024
#: A star, rounds of nearest pairs, and one of all pairs that are left.
TURNS = 4


def tokens(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, sorted within each text; the text of each; how many each text has."""
    h = w.hashes()
    t, at = windows(h, w.row, k)
    row = w.row[at]
    few = np.flatnonzero(w.counts[w.row] < k)  # words of texts that have fewer than k
    if len(few):
        short = [(x[ok], r[ok]) for n in range(1, k) for x, a in [windows(h[few], w.row[few], n)] for r in [w.row[few][a]] for ok in [w.counts[r] == n]]
        t, row = np.concatenate([t, *(x for x, _ in short)]), np.concatenate([row, *(r for _, r in short)])
        order = np.argsort(row, kind="stable")
        t, row = t[order], row[order]
    cuts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=w.n)))).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 1:
            t[a:b].sort()
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (row[1:] != row[:-1])
    t, row = t[new], row[new]
    return t, row, np.bincount(row, minlength=w.n)


def classes(t: np.ndarray, row: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each text's set."""
    total = np.zeros(len(size), np.uint64)
    np.add.at(total, row, mix(t ^ np.uint64(0xA5A5A5A5)))
    return mix(total + size.astype(np.uint64)).view(np.int64)


def _blobs(part: list[int], cuts: np.ndarray, h: np.ndarray, more: Callable) -> pa.RecordBatch:
    q = np.concatenate(([0], np.searchsorted(h, cuts), [len(h)]))
    rows = [(part[i], pack(h[a:b]), more(a, b)) for i, (a, b) in enumerate(zip(q[:-1], q[1:], strict=True)) if a < b]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "hashes", "more"])


def counted(part: list[int], bits: int, id_col: str, text_col: str) -> Callable:
    """Sorted hashes of all tokens, dealt by range, and a blob of ids, hashes of texts (_row), sizes and classes of the documents.

    Tokens of a set that a flush has met before are left out.
    """
    cuts, shift = bounds(len(part), bits), np.uint64(64 - bits)

    def flush(held: list, seen: list) -> Iterator[pa.RecordBatch]:
        if held:
            yield _blobs(part, cuts, np.sort(np.concatenate(held)), lambda a, b: b"")
        ids, *more = (np.concatenate([x[i] for x in seen]) for i in range(4))
        rows = [np.stack([ids, *more]).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([part[int(ids[0]) % len(part)]], pa.int32()), pa.array([b""], pa.binary()), pa.array(rows, pa.binary())], names=["part", "hashes", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, n, met = [], [], 0, np.zeros(0, np.int64)
        for ids, w, some in slices(batches, id_col, text_col, True):
            t, row, size = tokens(w)
            cls = classes(t, row, size)
            seen.append((ids, some["_row"].to_numpy(), size.astype(np.int64), cls))
            t, _, _, _, met = _unmet(t, row, size, cls, met)
            if len(t):
                held.append(t >> shift)
            n += len(t)
            if n >= FLUSH:
                yield from flush(held, seen)
                held, seen, n, met = [], [], 0, np.zeros(0, np.int64)
        if seen:
            yield from flush(held, seen)

    return run


def _unmet(t: np.ndarray, row: np.ndarray, size: np.ndarray, cls: np.ndarray, met: np.ndarray) -> tuple:
    """Without the sets in met or met before in this slice."""
    _, first = np.unique(cls, return_index=True)
    new = np.zeros(len(cls), bool)
    new[first] = True
    new &= (size > 0) & ~np.isin(cls, met)
    keep = new[row]
    return t[keep], (np.cumsum(new) - 1)[row[keep]], size[new], cls[new], np.concatenate([met, cls[new]])


def frequencies(least: int) -> Callable:
    """Tokens of one hash range with their frequencies from least on; the documents as they come."""
    names = ["token", "df", "_id", "_row", "n", "cls"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            for hashes, more in zip(b["hashes"].to_pylist(), b["more"].to_pylist(), strict=True):
                if more:
                    rows = np.frombuffer(more, np.int64).reshape(4, -1)
                    none = pa.nulls(rows.shape[1], pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, *map(pa.array, rows)], names=names)
                else:
                    got.append(unpack(hashes))
        if not got:
            return
        h = np.sort(np.concatenate(got))
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        n = np.diff(np.append(at, len(h)))
        h, n = h[at][n >= least].view(np.int64), n[n >= least].astype(np.int64)
        none = pa.nulls(len(h), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n), none, none, none, none], names=names)

    return run


def frequent_tokens(spark: SparkSession, table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent tokens, sorted, with frequencies; the threshold rises until FREQUENT at most are left."""
    steps = table.groupBy(F.floor(F.log2("df") * 4).alias("q")).agg(F.count(F.lit(1)).alias("n"), F.min("df").alias("low")).orderBy(F.desc("q")).collect()
    total, least = 0, None
    for s in steps:  # some hundred at most
        total += s["n"]
        if total > FREQUENT:
            break
        least = s["low"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = table.filter(F.col("df") >= least).toArrow()
    h, df = got["token"].to_numpy().view(np.uint64), got["df"].to_numpy()
    order = np.argsort(h)
    return h[order], df[order]


def _combined(f: np.ndarray, groups: int) -> np.ndarray:
    """Keys of the pairs of tokens that fall in one group."""
    g = mix(f) % np.uint64(groups)
    order = np.lexsort((f, g))
    f, g, out, d = f[order], g[order], [], 1
    while d < len(f) and (same := g[d:] == g[:-d]).any():
        out.append(mix(f[:-d][same] * np.uint64(3) + mix(f[d:][same]) + np.uint64(groups)))
        d += 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _frequent_keys(f: np.ndarray, df: np.ndarray, n: int, rare: int) -> np.ndarray:
    """f: a set's frequent tokens with frequencies; rare: how many others it has, less than its prefix."""
    p = n // 4 + 1
    f = f[np.lexsort((f, df))]
    s, out = p.bit_length() - 1, []
    for level in {s, max(s - 1, 0)}:
        if level < 2:
            out.append(mix(f[: p - rare] ^ np.uint64(0x5151)))
        else:
            out.append(_combined(f[: p + (1 << level) - rare], 1 << level))
    return np.concatenate(out)


def postings(part: list[int], bits: int, frequent, id_col: str, text_col: str) -> Callable:
    """Keys of each set, with its class and size."""
    cuts, shift = bounds(len(part), 64), np.uint64(64 - bits)

    def flush(held: list) -> pa.RecordBatch:
        key, cls, n = (np.concatenate([x[i] for x in held]) for i in (0, 2, 3))
        base = np.cumsum([0, *(len(x[2]) for x in held)])
        doc = np.concatenate([x[1] + b for x, b in zip(held, base, strict=False)])
        order = np.argsort(key)
        key, doc = key[order], doc[order]

        def more(a: int, b: int) -> bytes:
            used, at = np.unique(doc[a:b], return_inverse=True)
            blobs = [narrow(at), narrow(n[used]), cls[used].tobytes()]
            return b"".join(len(x).to_bytes(8, "little") + x for x in blobs)

        return _blobs(part, cuts, key, more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, df = frequent.value
        held, total, met = [], 0, np.zeros(0, np.int64)
        for _, w, _ in slices(batches, id_col, text_col, True):
            t, row, size = tokens(w)
            t, row, size, cls, met = _unmet(t, row, size, classes(t, row, size), met)
            if not len(t):
                continue
            at = np.searchsorted(often, t >> shift)
            at[at == len(often)] = 0
            is_often = often[at] == t >> shift if len(often) else np.zeros(len(t), bool)
            p = size // 4 + 1
            first = np.cumsum(size) - size
            rank = np.cumsum(~is_often)
            rank -= (rank[first] - ~is_often[first])[row]
            take = ~is_often & (rank <= p[row])
            keys, rows = [mix(t[take])], [row[take]]
            rare = size - np.bincount(row[is_often], minlength=len(size))
            for i in np.flatnonzero(rare < p):
                own = slice(first[i], first[i] + size[i])
                f = is_often[own]
                k = _frequent_keys(t[own][f], df[at[own][f]], int(size[i]), int(rare[i]))
                keys.append(k)
                rows.append(np.full(len(k), i))
            held.append((np.concatenate(keys) & ~np.uint64((1 << 12) - 1), np.concatenate(rows), cls, size))
            total += len(held[-1][0])
            if total >= FLUSH:
                yield flush(held)
                held, total, met = [], 0, np.zeros(0, np.int64)
        if total:
            yield flush(held)

    return run


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of one key range in which a class has another of a near enough size.

    Linked sets share most of their keys, so most lists repeat: a list's key is replaced by a hash of its members, and equal lists are told once.
    """
    got = [[], [], []]
    for b in batches:
        for hashes, more in zip(b["hashes"].to_pylist(), b["more"].to_pylist(), strict=True):
            blobs, at = [], 0
            while at < len(more):
                n = int.from_bytes(more[at : at + 8], "little")
                blobs.append(more[at + 8 : at + 8 + n])
                at += 8 + n
            doc = widen(blobs[0])
            for x, y in zip(got, (unpack(hashes), np.frombuffer(blobs[2], np.int64)[doc], widen(blobs[1])[doc]), strict=True):
                x.append(y)
    if not got[0]:
        return
    key, cls, n = map(np.concatenate, got)
    order = np.argsort(key)
    key, cls, n = key[order], cls[order], n[order]
    same = key[1:] == key[:-1]
    some = np.zeros(len(key), bool)
    some[1:] |= same
    some[:-1] |= same
    key, cls, n = key[some], cls[some], n[some]
    order = np.lexsort((cls, n, key))
    key, cls, n = key[order], cls[order], n[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    key, cls, n = key[new], cls[new], n[new]
    near = (key[1:] == key[:-1]) & (PARTS * n[:-1] >= PART * n[1:])
    some = np.zeros(len(key), bool)
    some[1:] |= near
    some[:-1] |= near
    key, cls, n = key[some], cls[some], n[some]
    if not len(key):
        return
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(cuts, len(key)))
    name = mix(np.add.reduceat(mix(cls.view(np.uint64)), cuts) + size.astype(np.uint64))
    first = np.zeros(len(cuts), bool)
    first[np.unique(name, return_index=True)[1]] = True
    keep = np.repeat(first, size)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[keep].view(np.int64)), pa.array(cls[keep]), pa.array(n[keep])], names=["key", "cls", "n"])


def full_sets(id_col: str, text_col: str) -> Callable:
    """cls, its tokens, and the parity of the tokens in each of MARK cells; a task tells a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(0, np.int64)
        for _, w, _ in slices(batches, id_col, text_col, True):
            t, row, size = tokens(w)
            t, row, size, cls, met = _unmet(t, row, size, classes(t, row, size), met)
            marks = np.zeros((len(size), MARK), np.uint8)
            np.bitwise_xor.at(marks, (row, (mix(t ^ np.uint64(0x77)) % np.uint64(MARK)).astype(np.int64)), 1)
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(t.view(np.int64)))
            cells = pa.array(np.packbits(marks, axis=1).view(np.int64).ravel())
            mark = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * (MARK // 64), pa.int32()), cells)
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(size.astype(np.int64)), sets, mark], names=["cls", "size", "tokens", "mark"])

    return run


def close(every: bool) -> Callable:
    """Pairs of classes of different components that share a key and whose marks don't rule a link out.

    Without every, each component of a list but the largest tells its nearest such pair only, so what comes out is linear in the lists.
    Rows come sorted by key; a key's list is worked on a class at a time, against STRIP others at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _close(batches, every)

    return run


STRIP = 1 << 14


def _close(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    sent: set[tuple[int, int]] = set()

    def pairs(cls: np.ndarray, comp: np.ndarray, n: np.ndarray, mark: np.ndarray) -> Iterator[tuple[int, int]]:
        order = np.argsort(n, kind="stable")
        cls, comp, n, mark = cls[order], comp[order], n[order], mark[order]
        top = np.searchsorted(n, PARTS * n // PART, "right")
        low = np.searchsorted(n, -(-PART * n // PARTS), "left")
        # a pair has a member outside the largest component, so work is linear in a large group that is joined already
        names, sizes = np.unique(comp, return_counts=True)
        largest = names[sizes.argmax()]
        nearest: dict[int, tuple[float, int, int]] = {}
        for i in np.flatnonzero(comp != largest).tolist():
            for a in range(int(low[i]), int(top[i]), STRIP):
                b = min(int(top[i]), a + STRIP)
                j = a + np.flatnonzero(comp[a:b] != comp[i])
                if every:  # of two members outside, the first tells
                    j = j[(j > i) | (comp[j] == largest)]
                if not len(j):
                    continue
                differ, both = np.bitwise_count(mark[j] ^ mark[i]).sum(1), n[j] + n[i]
                # a link leaves (n + m) / 7 tokens at most outside the intersection
                ok = differ * (PART + PARTS) <= (PARTS - PART) * both
                if every:
                    yield from ((min(int(cls[i]), x), max(int(cls[i]), x)) for x in cls[j[ok]].tolist())
                elif ok.any():
                    share = differ[ok] / both[ok]
                    at = int(share.argmin())
                    found = (float(share[at]), int(cls[i]), int(cls[j[ok][at]]))
                    nearest[comp[i]] = min(nearest.get(comp[i], found), found)
        yield from ((min(p), max(p)) for _, *p in nearest.values())

    def flush(rows: list) -> Iterator[pa.RecordBatch]:
        key, cls, comp, n = (np.concatenate([r[i] for r in rows]) for i in range(4))
        mark = np.concatenate([r[4] for r in rows])
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for p in pairs(cls[a:b], comp[a:b], n[a:b], mark[a:b]):
                if p not in sent:
                    out.append(p)
                    if len(sent) < 1_000_000:
                        sent.add(p)
            if len(out) > 50_000 or b == cuts[-1]:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])
                out = []

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        row = [batch[c].to_numpy() for c in ("key", "cls", "comp", "n")]
        row.append(batch["mark"].flatten().to_numpy().view(np.uint64).reshape(-1, MARK // 64))
        at = int(np.searchsorted(row[0], row[0][-1]))  # the last key may go on
        if at or (held and held[-1][0][-1] != row[0][0]):
            done = [*held, [x[:at] for x in row]] if at else held
            yield from flush(done)
            held = []
        held.append([x[at:] for x in row])
    if held:
        yield from flush(held)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: the marks rule most others out before the sets are read."""

    def side(c: str, *more: str) -> DataFrame:
        return sets.select(F.col("cls").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in more))

    marked = pairs.join(side("a", "size", "mark"), "a").join(side("b", "size", "mark"), "b")
    differ = F.aggregate(F.zip_with("mark_a", "mark_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    # a link leaves 25 / 175 of both sizes at most outside the intersection
    left = written(marked.filter(differ * (PART + PARTS) <= (PARTS - PART) * (F.col("size_a") + F.col("size_b"))).select("a", "b"), "pairs")
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return left.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b").filter(PARTS * both >= PART * (F.size("tokens_a") + F.size("tokens_b") - both)).select("a", "b")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _row (hash of the text), n (size of the set), cls (class of equal sets), comp (smallest id reachable by links), kept (of the component's least _id and _row)."""
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col, F.xxhash64(text_col).alias("_row"))
    part = labels(spark, n_parts := parts_of(spark))
    bits = min(64, max(44, 26 + math.ceil(math.log2(docs.count() + 1))))
    blob = "part int, hashes binary, more binary"
    seen = written(docs.mapInArrow(counted(part, bits, id_col, text_col), blob).repartition(n_parts, "part").mapInArrow(frequencies(RARE), "token long, df long, _id long, _row long, n long, cls long"), "seen")
    rows, often = seen.filter("cls is not null").select("_id", "_row", "n", "cls"), seen.filter("token is not null").select("token", "df")
    frequent = spark.sparkContext.broadcast(frequent_tokens(spark, often))
    keys = docs.mapInArrow(postings(part, bits, frequent, id_col, text_col), blob).repartition(n_parts, "part")
    posts = written(keys.mapInArrow(shared, "key long, cls long, n long").distinct(), "posts")
    frequent.destroy()  # the driver holds it no longer than the scan
    node = rows.groupBy("cls").agg(F.min(F.struct("_id", "_row")).alias("node"))
    some = posts.select("cls").distinct()
    reps = written(node.join(some, "cls").select(F.col("node._id").alias("_rep"), "node._row"), "reps")  # as a table its size is known to the planner
    keyed = docs.withColumn("_rep", F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))))
    # one plan at every size: texts meet the representatives by key, and are hashed against them without a sort
    sets = written(keyed.join(reps.hint("shuffle_hash"), ["_rep", "_row"], "left_semi").mapInArrow(full_sets(id_col, text_col), "cls long, size long, tokens array<long>, mark array<long>"), "sets")
    stars, comp = None, some.withColumn("comp", F.col("cls"))
    marks = sets.select("cls", "mark")
    for turn in range(TURNS):
        apart = posts.join(comp, "cls")
        hub = F.min_by(F.struct("cls", "n", "comp"), F.xxhash64("cls")).alias("hub")
        mixed = apart.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), hub).filter("lo < hi").drop("lo", "hi")
        rest = written(apart.join(mixed, "key"), "rest")  # lists of more than one component
        if turn and rest.isEmpty():
            break
        posts = rest.select("key", "cls", "n")
        if not turn:  # the hub that a class shares most keys with
            near = (F.col("comp") != F.col("hub.comp")) & (PARTS * F.least("n", "hub.n") >= PART * F.greatest("n", "hub.n"))
            best = rest.filter(near).groupBy(F.col("hub.cls").alias("a"), F.col("cls").alias("b")).agg(F.count(F.lit(1)).alias("k"))
            pairs = best.groupBy("b").agg(F.max_by("a", F.struct("k", "a")).alias("a")).select("a", "b")
        else:
            # dealt by a hash of the key: by the key itself, adaptive planning may take the joins' own partitioning for this one, drop it and then read those shuffles locally
            dealt = rest.drop("hub").join(marks, "cls").select("key", "cls", "comp", "n", "mark").repartition(F.xxhash64("key")).sortWithinPartitions("key")
            pairs = dealt.mapInArrow(close(turn == TURNS - 1), "a long, b long").distinct()
        new = written(verified(pairs, sets).select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
        if new.isEmpty():
            continue
        # components so far are stars, so few rounds join the new edges to them
        stars = written(components(new if stars is None else new.unionByName(stars)).select("u", F.col("comp").alias("v")), "stars")
        found = stars.select(F.col("u").alias("cls"), F.col("v").alias("_c"))
        comp = written(some.join(found, "cls", "left").select("cls", F.coalesce("_c", "cls").alias("comp")), "comp")
    reached = comp.join(node, "cls").groupBy("comp").agg(F.min("node").alias("least"))
    least = comp.join(reached, "comp").select("cls", "least")
    whole = node.join(least, "cls", "left").select("cls", F.coalesce("least", "node").alias("first"))
    kept = (F.col("n") == 0) | ((F.col("first._id") == F.col("_id")) & (F.col("first._row") == F.col("_row")))
    return rows.join(whole, "cls").select("_id", "_row", "n", "cls", F.when(F.col("n") > 0, F.col("first._id")).otherwise(F.col("_id")).alias("comp"), kept.alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    known = lambda c: F.when(F.col(c) != F.lit(int(NO_ID)), F.col(c))
    return linked(docs).select(known("_id").alias("doc_id"), F.col("n").alias("n_shingles"), known("comp").alias("component_id"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, the one with the smallest id and then hash of the text; columns as they came."""
    i, row, whole = fresh(docs, "_i", "_r", "_whole")
    rows = linked(docs, id_col, text_col).groupBy(F.col("_id").alias(i), F.col("_row").alias(row)).agg(F.min("kept").alias("kept"), (F.max("n") > 0).alias("some"), F.count(F.lit(1)).alias("m"))
    fate = written(rows.filter("not kept or (some and m > 1)").select(i, row, "kept"), "fate")
    gone, twice = fate.filter("not kept").drop("kept"), fate.filter("kept").drop("kept")
    same = (F.coalesce(docs[id_col].cast("long"), F.lit(int(NO_ID))) == fate[i]) & (F.xxhash64(docs[text_col]) == fate[row])
    if twice.isEmpty():
        return docs.join(gone, same, "left_anti")
    # repeated rows: one of them, chosen before they are shuffled
    one = docs.join(twice, same).groupBy(i, row).agg(F.any_value(F.struct(*own(docs))).alias(whole)).select(f"{whole}.*")
    return docs.join(fate.drop("kept"), same, "left_anti").unionByName(one)
