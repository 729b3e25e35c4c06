"""Whole results of operators that SQL can't say, held against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from paperloom.llm import fingerprints, language_id, mixing, sharding
from tests.llm import fixtures


def h64(*values) -> int:
    """Spark's xxhash64: each value hashed with the hash of those before as its seed; nulls are passed over."""
    seed = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v.to_bytes(4, "little", signed=True) if isinstance(v, I32) else int(v).to_bytes(8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


class I32(int):
    """An integer of 32 bits."""


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def lanes(text: str) -> tuple[str, list[int]]:
    """Fingerprint and signed lanes of a text."""
    exact, k, bits = [0] * 4, 0, [0] * 64
    for par in text.split("\n"):
        if not par.strip(" "):
            continue
        h, g = h64(par), h64(I32(1), par)
        for i, x in enumerate((h & 0xFFFFFFFF, h >> 32, g & 0xFFFFFFFF, g >> 32)):
            exact[i] = (exact[i] + x) % 2**32
        w = par.split(" ")
        for a, b, c in zip(w, [*w[1:], None], [*w[2:], None, None], strict=False):  # the last two are shorter
            t = h64(signed(h64(a, b)), c)
            k += 1
            for i in range(64):
                bits[i] += t >> i & 1
    order = [bits[j] for i in range(32) for j in (i, i + 32)]
    return "".join(f"{x:08x}" for x in [*exact, k]) + "".join(f"{x % 2**16:04x}" for x in order), [2 * x - k for x in order]


def alike(a: list[int], b: list[int]) -> float:
    size = sum(x * x for x in a) + sum(x * x for x in b)
    return 1.0 if not size else min(1.0, max(0.0, 2 * sum(x * y for x, y in zip(a, b, strict=True)) / size))


def test_fingerprints_and_likeness(spark):
    rows = sorted(((i, t or "") for i, t, *_ in fixtures.rows(40)), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.digest(fixtures.frame(spark, fixtures.rows(40))).collect()}
    assert len(got) == len(rows)
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        (fp, a), (efp, b), (_, c) = lanes(t), lanes(edited), lanes(after)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), fp, efp)
        assert r["near_edited"] == pytest.approx(alike(a, b), abs=1e-9) and r["near_next"] == pytest.approx(alike(a, c), abs=1e-9)


def test_mixed_rows(spark):
    target, repeat, block = 0.8, 3.0, 200
    rows = fixtures.rows(200)
    got = mixing.mix(fixtures.frame(spark, rows), target=target, repeat=repeat, block=block).collect()
    docs = [(i, "=" + s if s is not None else "", len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, s, *_ in rows]
    n, texts = Counter(), {r[0]: r[1] for r in rows}
    for _, s, k in docs:
        n[s] += k
    total, some = sum(n.values()), {s: k for s, k in n.items() if k}

    def weights(t: float) -> dict[str, float]:
        z = sum(k**t for k in some.values())
        return {s: k**t / z for s, k in some.items()}

    def good(t: float) -> bool:
        w = weights(t)
        return -sum(x * math.log(x) for x in w.values()) >= target * math.log(len(w))

    def bounded(t: float) -> bool:
        return max(x * total / some[s] for s, x in weights(t).items()) <= repeat

    def edge(test, low: float, high: float) -> float:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if test(mid) else (low, mid)
        return low

    t = 1.0 if good(1.0) else edge(good, 0.0, 1.0)
    if not bounded(t):
        t = 1.0 if not bounded(1.0) else 1 - edge(lambda x: bounded(1 - x), 0.0, 1.0)
    w = weights(t)
    for r in got:
        assert r["weight"] == pytest.approx(w.get("=" + r["source"] if r["source"] is not None else "", 0.0), abs=1e-5)
    exact = {("=" + r["source"] if r["source"] is not None else ""): r["weight"] for r in got}  # budgets by the weights as they were rounded by bisection
    want = Counter()
    for s, k in n.items():
        budget = exact[s] * total
        whole = math.floor(budget / k + 1e-9) if k else 1
        blocks = math.ceil((k + 1) / block)
        place = {i: signed(h64(I32(mixing.SEED), i, s, signed(h64(*([texts[i]] if texts[i] is not None else []))))) % blocks for i, of, _ in docs if of == s}
        size = Counter()
        for i, of, m in docs:
            if of == s:
                size[place[i]] += m
        before, last = 0, set()
        for _, b in sorted((h64(I32(mixing.SEED), s, I32(whole), b), b) for b in size):
            if before + size[b] / 2 < budget - whole * k:
                last.add(b)
            before += size[b]
        for i, b in place.items():
            want[i] += whole + (b in last)
    assert Counter(r["doc_id"] for r in got) == +want


def plain_best_fit(sizes: list[int], bins: int) -> list[int]:
    """Each item, from the largest on, into the fullest bin that holds it (of equal ones the first), at the least capacity that works."""
    capacity = max(sizes)
    while True:
        free, out = [capacity] * bins, []
        for s in sizes:
            fit = [(f, b) for b, f in enumerate(free) if f >= s]
            if not fit:
                break
            b = min(fit)[1]
            free[b] -= s
            out.append(b)
        else:
            return out
        capacity += 1


def test_packing_of_groups(spark):
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("abcdefgh"), int(k))) for k in r.integers(40, 400, 150)]
    data = [(i, texts[int(k)], "en", "s", 1, "x") for i, k in enumerate(r.integers(0, 150, 200))]
    got = {row["doc_id"]: row["shard"] for row in sharding.digest(fixtures.frame(spark, data)).collect()}
    groups = Counter()
    for _, t, *_ in data:
        groups[t] += len(t) + 1
    numbered = sorted((signed(h64(t)), signed(h64(I32(1), t)), n, t) for t, n in groups.items())
    items = sorted(((i, n, t) for i, (*_, n, t) in enumerate(numbered)), key=lambda x: (-x[1], x[0]))
    assert items[0][1] * 16 <= sum(groups.values())  # none over an even share
    place = {t: b for (_, _, t), b in zip(items, plain_best_fit([n for _, n, _ in items], 16), strict=True)}
    assert got == {i: place[t] for i, t, *_ in data}
    assert [len({got[i] for i, t, *_ in data if t == x}) for x in groups] == [1] * len(groups)


def test_posteriors_of_languages(spark):
    r = np.random.default_rng(5)
    vocab = {"en": "the and with from that this have which would there".split(), "de": "der und nicht für über auch wird können schön größe".split()}
    data = [(i, " ".join(r.choice(vocab["en" if i % 3 else "de"], int(r.integers(1, 12)))), ["en" if i % 3 else "de", None, "fr"][0 if i % 5 else i % 2 + 1], [f"src{i % 2}", "web7", None][i % 3], 1, "x") for i in range(60)] + [(99, "12 !", "en", "src0", 1, "x"), (98, None, None, None, 1, "x")]
    df = fixtures.frame(spark, data)
    got = {x["_id"]: x for x in language_id.of_documents(df).collect()}
    names = sorted({x[2] for x in data if x[2] is not None})
    every = [*names, "und"]

    def cells(text: str | None) -> list[int]:
        b = [c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()]
        b = [32 if c < 128 and not chr(c).isalpha() else c for c in b]
        return [((x << 16 | y << 8 | z) * 2654435761 % 2**32) >> 16 for x, y, z in zip(b, b[1:], b[2:], strict=False) if not (x == 32 and y == 32)]

    n = np.zeros((language_id.CELLS, len(names)))
    for _, t, lang, *_ in data:
        if lang is not None:
            for c in cells(t):
                n[c, names.index(lang)] += 1
    back = (n.sum(1, keepdims=True) + 0.05) / (n.sum() + 0.05 * language_id.CELLS)
    like = np.log(0.9 * (n + 200 * back) / (n.sum(0) + 200) + 0.2 / language_id.CELLS)
    like = np.concatenate([like, np.full((language_id.CELLS, 1), -math.log(language_id.CELLS / 2))], 1).astype(np.float32)
    assert (n.sum(0) < language_id.THIN).all()  # so that a declared language stands in for "und"
    sums, hosts = {}, {}
    for i, t, lang, source, *_ in data:
        c = cells(t)
        x = like[c].astype(float).mean(0) * min(len(c), language_id.TRUST) if c else np.zeros(len(every))
        if lang is not None:
            k = names.index(lang)
            x[k] = max(x[k], x[-1])
            x[-1] = x[k] - language_id.TRUST
        if not any(ch.isalpha() for ch in t or ""):
            x = np.array([-language_id.TRUST] * len(names) + [0.0])
        x[-1] -= math.log(language_id.RARELY)
        if lang is not None:
            x[names.index(lang)] += math.log(language_id.DECLARED)
        sums[i] = x
        hosts[i] = (re.match(r"\D*", source or "")[0], source or "")
    normal = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    count = defaultdict(lambda: np.zeros(len(every)))
    for i, x in sums.items():
        for key in ((), ("",), ("", hosts[i][0]), ("", *hosts[i])):
            count[key] += normal(x)
    prior = {(): (count[()] + 1) / (count[()].sum() + len(every))}
    for key in sorted(count, key=len):
        if key:
            prior[key] = (count[key] + language_id.K * prior[key[:-1]]) / (count[key].sum() + language_id.K)
    for i, x in sums.items():
        want = normal(x + np.log(prior["", *hosts[i]]))
        assert got[i]["_posterior"] == pytest.approx(want.tolist(), rel=1e-5, abs=1e-9)
        assert got[i]["_language"] == every[int(want.argmax())]


def test_sizes_and_sums(spark):
    got = {r["doc_id"]: r for r in sharding.digest(fixtures.frame(spark)).collect()}
    for i, t, *_ in fixtures.rows():
        raw = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
