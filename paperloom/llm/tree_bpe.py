"""Byte-level BPE encoding and decoding with a file of ranks.

The leaves of a segment tree are the byte positions of one word: the leaf at a live part's beginning holds the rank of the pair that
this part makes with the next one, and every node the leftmost least rank below it. A merge reads the root, joins the two parts there,
and updates three leaves (the part's, the one before it, and the one that went), each in as many steps as the tree has levels. So a word of n
bytes takes n log n steps, however long it is. Trees of one width are the rows of one matrix, so that a merge in each of a batch's
new words is a few array operations a level; words over WIDE bytes, which are few, have a tree in a list each.

Tasks keep the codes of at most KEPT distinct words of at most SHORT bytes (a speed matter only). The ranks are a parameter, read once by the
driver and broadcast: their size is fixed.

Defined results: null counts as the empty text, which has no ids and decodes to no bytes; special tokens are ordinary text; a word that is
a token by itself has that one id; rows are independent, so repeated rows and ids give equal rows, and a null id stays null; extra columns,
whatever their names, are ignored; an empty table gives an empty one. Unknown ids raise an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from paperloom.llm.bpe import PATTERN, _groups

KEPT, SHORT, WIDE = 400_000, 256, 64
#: Ranks stand above the position's bits, so that of equal ranks the leftmost is the least.
PLACE = 40
#: Words in one matrix, so that its arrays stay in a core's cache.
MANY = 4096
NONE = 1 << 62


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Tree:
    """Leftmost least value over positions."""

    def __init__(self, leaves: list[int]):
        self.first = 1 << max(0, len(leaves) - 1).bit_length()
        self.nodes = [NONE] * self.first + leaves + [NONE] * (self.first - len(leaves))
        nodes = self.nodes
        for i in range(self.first - 1, 0, -1):
            a, b = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = a if a < b else b

    def least(self) -> int:
        return self.nodes[1]

    def put(self, i: int, value: int) -> None:
        nodes = self.nodes
        i += self.first
        nodes[i] = value
        while i > 1:
            other = nodes[i ^ 1]
            if other < value:
                value = other
            i >>= 1
            if nodes[i] == value:
                return
            nodes[i] = value


class Codec:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {str(i): t for t, i in ranks.items()}
        self.words: dict[str, str] = {}
        self.pattern = regex.compile(PATTERN)
        pairs = sorted((ranks[t[:k]] << 32 | ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.keys, self.joined = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE for none."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.joined[at], NONE)

    def merged_many(self, words: list[bytes], width: int) -> list[list[int]]:
        """Ids of words of 2 to width bytes; width is a power of two."""
        n = np.array([len(w) for w in words])
        place = np.arange(width)
        inside = place < n[:, None]
        parts = np.zeros((len(words), width), np.int64)
        parts[inside] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(place + 1, (len(words), 1))
        before = np.tile(np.arange(-1, width), (len(words), 1))
        tree = np.full((len(words), 2 * width), NONE, np.int64)
        first = place[:-1] + 1 < n[:, None]
        found = self.pair(parts[:, :-1][first], parts[:, 1:][first])
        tree[:, width:-1][first] = np.where(found == NONE, NONE, found << PLACE | np.nonzero(first)[1])
        size = width // 2
        while size:
            tree[:, size : 2 * size] = np.minimum(tree[:, 2 * size : 4 * size : 2], tree[:, 2 * size + 1 : 4 * size : 2])
            size //= 2
        flat = tree.reshape(-1)
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            best = tree[rows, 1]
            new, i = best >> PLACE, best & ((1 << PLACE) - 1)
            j = after[rows, i]
            end = after[rows, j]
            parts[rows, i], after[rows, i], before[rows, end], inside[rows, j] = new, end, i, False
            k = before[rows, i]
            right, left = end < n[rows], k >= 0
            a = np.concatenate([new[right], parts[rows[left], k[left]]])
            b = np.concatenate([parts[rows[right], end[right]], new[left]])
            leaf = np.concatenate([i[right], k[left], i[~right], j])
            rank = self.pair(a, b)
            value = np.full(len(leaf), NONE)
            value[: len(rank)] = np.where(rank == NONE, NONE, rank << PLACE | leaf[: len(rank)])
            base = np.concatenate([rows[right], rows[left], rows[~right], rows]) * (2 * width)
            node = leaf + width
            flat[base + node] = value
            for _ in range(width.bit_length() - 1):
                node >>= 1
                at = base + 2 * node
                flat[base + node] = np.minimum(flat[at], flat[at + 1])
            rows = rows[tree[rows, 1] != NONE]
        ids, stops = parts[inside].tolist(), np.cumsum(inside.sum(1)).tolist()
        return [ids[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def learnt(self, words: set[str]) -> dict[str, str]:
        """Ids of words in decimal, joined by commas."""
        out, by = {}, defaultdict(list)
        for w in words:
            raw = w.encode()
            if raw in self.ranks:
                out[w] = str(self.ranks[raw])
            elif len(raw) > WIDE:
                out[w] = ",".join(map(str, self.merged(raw)))
            else:
                by[1 << (len(raw) - 1).bit_length()].append((w, raw))
        for width, some in by.items():
            for a in range(0, len(some), MANY):
                part = some[a : a + MANY]
                out.update((w, ",".join(map(str, ids))) for (w, _), ids in zip(part, self.merged_many([r for _, r in part], width), strict=True))
        return out

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word."""
        ranks, n = self.ranks, len(word)
        if word in ranks:
            return [ranks[word]]
        get = ranks.get
        ends = [*range(1, n + 1)]  # where the live part at a position ends, and where the live part before it begins
        before = [*range(-1, n - 1)]
        tree = Tree([NONE if (r := get(word[i : i + 2])) is None else r << PLACE | i for i in range(n - 1)])
        while (best := tree.least()) != NONE:
            i = best & ((1 << PLACE) - 1)
            j = ends[i]
            end = ends[i] = ends[j]
            ends[j] = 0
            if end < n:
                before[end] = i
                r = get(word[i : ends[end]])
                tree.put(i, NONE if r is None else r << PLACE | i)
            else:
                tree.put(i, NONE)
            if j < n - 1:
                tree.put(j, NONE)
            k = before[i]
            if k >= 0:
                r = get(word[k:end])
                tree.put(k, NONE if r is None else r << PLACE | k)
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : ends[i]]])
            i = ends[i]
        return out

    def encode(self, texts: list[str]) -> list[str]:
        """Each text's ids in decimal, joined by commas."""
        cut = [self.pattern.findall(t) for t in texts]
        known = self.words
        new = {w for w in chain.from_iterable(cut) if w not in known}
        if len(known) + len(new) > KEPT:
            known.clear()
            new = set(chain.from_iterable(cut))
        fresh = self.learnt(new)
        known.update((w, c) for w, c in fresh.items() if len(w) <= SHORT)
        if len(known) > KEPT:  # one group of texts alone has more
            known.clear()
        all_ = fresh if not known else known if all(len(w) <= SHORT for w in new) else {**known, **fresh}
        return [",".join([all_[w] for w in words]) for words in cut]

    def decode(self, ids: str) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.split(",")]) if ids else b""


_codecs: dict[str, Codec] = {}


class Shared:
    """Broadcast ranks; one codec for each worker and path, so that the words it has learnt serve the next task."""

    def __init__(self, docs: DataFrame, path: str | None):
        self.path = path or default_path()
        self.cast = docs.sparkSession.sparkContext.broadcast(read_ranks(self.path))

    def codec(self) -> Codec:
        if self.path not in _codecs:
            _codecs.clear()
            _codecs[self.path] = Codec(self.cast.value)
        return _codecs[self.path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>."""
    shared = Shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.codec()
        for b in batches:
            texts = [t or "" for t in b[text_col].to_pylist()]
            for x, y in _groups(texts):
                ids = [[int(i) for i in s.split(",")] if s else [] for s in codec.encode(texts[x:y])]
                yield pa.RecordBatch.from_arrays([b[id_col].slice(x, y - x), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: bytes that aren't UTF-8 become the replacement character."""
    shared = Shared(coded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.codec()
        for b in batches:
            texts = [codec.decode(",".join(map(str, ids or []))).decode("utf-8", "replace") for ids in b[ids_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[id_col], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(id_col, ids_col).mapInArrow(run, f"doc_id {coded.schema[id_col].dataType.simpleString()}, text string")


def digest(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode the ids, without keeping either."""
    shared = Shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.codec()
        for b in batches:
            texts = [t or "" for t in b[text_col].to_pylist()]
            for x, y in _groups(texts):
                coded = codec.encode(texts[x:y])
                n = [s.count(",") + 1 if s else 0 for s in coded]
                sha = [hashlib.sha256(s.encode()).hexdigest() for s in coded]
                back = [hashlib.sha256(codec.decode(s)).hexdigest() for s in coded]
                yield pa.RecordBatch.from_arrays([b[id_col].slice(x, y - x), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
