"""Plain scans of small tables, that operators are held against."""

import hashlib
import math
import re
import zlib
from collections import Counter

from paperloom.llm.context_mixing import FOLDS, HELD_OUT
from paperloom.llm.jaccard_join import PART, PARTS, SHINGLE
from paperloom.llm.substring_dedup import WINDOW


def held(i: int | None) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT


def base_scores(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """held_out, n_tokens, n_known, train_tokens and base_score by a plain scan, for tests."""
    cut = {i: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), " "] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in cut}
    seen = Counter(x for i, ws in cut.items() if not held[i] for x in ws)
    n, v = sum(seen.values()), len(seen)
    return {i: (held[i], len(ws), sum(seen[x] > 0 for x in ws), n, sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in ws)) for i, ws in cut.items()}


def substrings(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same by a plain scan, for tests."""
    seen: set[tuple] = set()
    out = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            if key in seen:
                gone[a : a + window] = [True] * window
            seen.add(key)
        left = [x for x, g in zip(words, gone, strict=True) if not g]
        out[i] = (len(words), len(words) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest())
    return out


def similar(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """The same by comparing all documents, for tests."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[a : a + SHINGLE]) for a in range(max(1, len(w) - SHINGLE + 1))} if w else set()
    top = {i: i for i in sets}

    def root(x: int) -> int:
        while top[x] != x:
            x = top[x]
        return x

    index: dict[tuple, list[int]] = {}
    for i in sorted(sets):
        hits: dict[int, int] = {}
        for t in sets[i]:
            for j in index.setdefault(t, []):
                hits[j] = hits.get(j, 0) + 1
            index[t].append(i)
        for j, both in hits.items():
            if PARTS * both >= PART * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}
