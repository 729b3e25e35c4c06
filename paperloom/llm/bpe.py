"""Byte-pair encoding and decoding with a public vocabulary.

Words are merged by a contiguous rank array: a word's parts and the ranks of all
adjacent pairs lie side by side; the least rank is found by a scan, its boundary is
deleted and the ranks on both sides are looked up again. Words of one length are the
rows of one matrix, so a scan, a deletion and a refresh each are one array operation
for all distinct new words of a batch. Words over LONG bytes, where repeated scans would be
quadratic, take the same merges from a heap.

Tasks keep the codes of at most CACHE distinct words (a speed matter only). The
vocabulary is a parameter, read once by the driver and broadcast: its size is fixed.

Defined results: null counts as the empty text, which has no ids and decodes to the empty
text; special tokens in a text are matched as the vocabulary's file says; rows are independent, so
repeated rows and ids give equal rows, and a null id stays null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

LONG, CACHE, BATCH = 256, 400_000, 1_000_000
#: Fixed value: the White_Space property, as the public pattern means by \s.
BLANK = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the public word pattern of byte-level BPE.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
NONE = np.iinfo(np.int32).max


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary's file: itself, or the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """Arrays and tables of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, letters = spec["model"]["vocab"], byte_letters()
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
    keys = left << 32 | right
    order = np.argsort(keys)
    text = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("special tokens that take in neighbours are not supported")
    text |= {i: t.encode() for t, i in special.items()}
    return {
        "keys": keys[order],
        "ranks": order.astype(np.int32),
        "merged": np.array([vocab[a + b] for a, b in merges], np.int32)[order],
        "bytes": np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32),
        "text": text,
        "special": special,
    }


class Codec:
    def __init__(self, vocabulary: dict):
        self.v = vocabulary
        self.words: dict[str, str] = {}
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary["special"], key=len, reverse=True))) + ")") if vocabulary["special"] else None
        self.text = {str(i): t for i, t in vocabulary["text"].items()}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair's merge, -1 for none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.v["keys"], key)
        at[at == len(self.v["keys"])] = 0
        return np.where(self.v["keys"][at] == key, at, -1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self.look_up(left, right)
        return np.where(at >= 0, self.v["ranks"][at], NONE)

    def merge_equal(self, raw: np.ndarray) -> list[np.ndarray]:
        """Ids of words of one length; raw: a row of bytes for each."""
        parts = self.v["bytes"][raw]
        out: list = [None] * len(parts)
        rows = np.arange(len(parts))
        ranks = self.rank(parts[:, :-1], parts[:, 1:]) if parts.shape[1] > 1 else np.zeros((len(parts), 0), np.int32)
        while len(rows):
            if not ranks.shape[1]:
                for r, p in zip(rows.tolist(), parts, strict=True):
                    out[r] = p
                break
            at = ranks.argmin(1)
            live = ranks[np.arange(len(rows)), at] != NONE
            if not live.all():
                for r, p in zip(rows[~live].tolist(), parts[~live], strict=True):
                    out[r] = p
                rows, parts, ranks, at = rows[live], parts[live], ranks[live], at[live]
                if not len(rows):
                    break
            i, n = np.arange(len(rows)), parts.shape[1]
            parts[i, at] = self.v["merged"][self.look_up(parts[i, at], parts[i, at + 1])]
            stay = np.ones(parts.shape, bool)
            stay[i, at + 1] = False  # the boundary goes
            parts = parts[stay].reshape(len(rows), n - 1)
            stay = np.ones(ranks.shape, bool)
            stay[i, at] = False
            ranks = ranks[stay].reshape(len(rows), n - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < n - 2)
            ranks[before, at[before] - 1] = self.rank(parts[before, at[before] - 1], parts[before, at[before]])
            ranks[after, at[after]] = self.rank(parts[after, at[after]], parts[after, at[after] + 1])
        return out

    def merge_long(self, raw: bytes) -> list[int]:
        """The same merges, least rank and then leftmost first, from a heap."""
        parts = self.v["bytes"][np.frombuffer(raw, np.uint8)].tolist()
        keys, ranks, merged = self.v["keys"], self.v["ranks"], self.v["merged"]
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]

        def found(i: int) -> tuple | None:
            j = after[i]
            if j < 0:
                return None
            key = parts[i] << 32 | parts[j]
            at = int(np.searchsorted(keys, key))
            return (int(ranks[at]), i, parts[i], parts[j], int(merged[at])) if at < len(keys) and keys[at] == key else None

        heap = [x for i in range(n) if (x := found(i))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for k in (before[i], i):
                if k >= 0 and (x := found(k)):
                    heapq.heappush(heap, x)
        return [p for p in parts if p >= 0]

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not known yet."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > CACHE:
            self.words.clear()
            new = list(words)
        raw = [w.encode() for w in new]
        size = np.array([len(x) for x in raw], np.int64)
        for n in np.unique(size).tolist() if len(new) else []:
            which = np.flatnonzero(size == n).tolist()
            if n > LONG:
                ids = [self.merge_long(raw[i]) for i in which]
            else:
                ids = [x.tolist() for x in self.merge_equal(np.frombuffer(b"".join([raw[i] for i in which]), np.uint8).reshape(-1, n))]
            for i, x in zip(which, ids, strict=True):
                self.words[new[i]] = ",".join(map(str, x))

    def pieces(self, text: str) -> list[str]:
        if self.special and any(s in text for s in self.v["special"]):
            return list(chain.from_iterable([p] if p in self.v["special"] else self.pattern.findall(p) for p in self.special.split(text)))
        return self.pattern.findall(text)

    def encode(self, texts: list[str]) -> list[str]:
        """Each text's ids in decimal, joined by commas."""
        cut = [self.pieces(t) for t in texts]
        self.learn(set(chain.from_iterable(cut)) - self.v["special"].keys())
        self.words.update({s: str(i) for s, i in self.v["special"].items()})
        known = self.words
        return [",".join([known[w] for w in words]) for words in cut]

    def decode(self, ids: str) -> str:
        text = self.text
        return b"".join([text[i] for i in ids.split(",")]).decode("utf-8", "replace") if ids else ""


_codecs: dict[int, Codec] = {}


def _codec(vocabulary) -> Codec:
    """One for each worker and vocabulary: the words it has learnt serve the next task."""
    if vocabulary.id not in _codecs:
        _codecs.clear()
        _codecs[vocabulary.id] = Codec(vocabulary.value)
    return _codecs[vocabulary.id]


class _Shared:
    """A broadcast vocabulary under an id that workers can keep things by."""

    def __init__(self, docs: DataFrame, path: str | None):
        self.path = path or default_path()
        self.cast = docs.sparkSession.sparkContext.broadcast(read_vocabulary(self.path))

    def __getattr__(self, name: str):
        if name == "id":
            return self.path
        if name == "value":
            return self.cast.value
        raise AttributeError(name)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of some BATCH characters."""
    cuts, n = [0], 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= BATCH:
            cuts.append(i + 1)
            n = 0
    return pairwise(dict.fromkeys([*cuts, len(texts)]))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>."""
    shared = _Shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            texts = [t or "" for t in b[text_col].to_pylist()]
            for x, y in _groups(texts):
                ids = [[int(i) for i in s.split(",")] if s else [] for s in codec.encode(texts[x:y])]
                yield pa.RecordBatch.from_arrays([b[id_col].slice(x, y - x), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text."""
    shared = _Shared(coded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            texts = [codec.decode(",".join(map(str, ids or []))) for ids in b[ids_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[id_col], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(id_col, ids_col).mapInArrow(run, f"doc_id {coded.schema[id_col].dataType.simpleString()}, text string")


def digest(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode the ids, without keeping either."""
    shared = _Shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            texts = [t or "" for t in b[text_col].to_pylist()]
            for x, y in _groups(texts):
                coded = codec.encode(texts[x:y])
                n = [s.count(",") + 1 if s else 0 for s in coded]
                sha = [hashlib.sha256(s.encode()).hexdigest() for s in coded]
                back = [hashlib.sha256(codec.decode(s).encode()).hexdigest() for s in coded]
                yield pa.RecordBatch.from_arrays([b[id_col].slice(x, y - x), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
