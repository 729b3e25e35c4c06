import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import queries, stream_mixing
from paperloom.llm.stream_mixing import BREAKS, END, MAP_STEPS, ORDERS, PREDICTORS, RATE, REACH, Code, Learner, Model
from paperloom.llm.words import Words, narrow, widen
from tests.llm import brute, fixtures


def _words(texts):
    return Words(pa.array(texts, pa.string()), True)


def _code(texts):
    pairs = np.zeros((256, 256), np.int64)
    for t in texts:
        b = (t or "").lower().encode()
        np.add.at(pairs, (list(b" " + b), list(b + b" ")), 1)
    return Code(pairs)


def test_base_and_counts_match_brute_force(spark):
    got = {r["doc_id"]: r for r in stream_mixing.score(fixtures.frame(spark)).collect()}
    want = brute.base_scores([r[:2] for r in fixtures.rows()])
    texts = {r[0]: r[1] for r in fixtures.rows()}
    assert set(got) == set(want)
    for i, w in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
        assert r["n_bytes"] == len((texts[i] or "").encode())
        assert r["total_bits"] == pytest.approx(-r["score"] / math.log10(2))
        assert r["bits_per_byte"] == pytest.approx(r["total_bits"] / max(1, r["n_bytes"]))
    assert stream_mixing.score(fixtures.empty(spark)).count() == 0


def test_null_ids_and_texts_repeated_rows_and_no_training_documents(spark):
    data = [(None, "a b", "en", "s", 1, "x"), (1, "a b c", "en", "s", 1, "x"), (1, "a b c", "en", "s", 1, "x"), (2, None, "en", "s", 1, "x"), (3, "", "en", "s", 1, "x")]
    got = stream_mixing.score(fixtures.frame(spark, data)).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 3, 4, 4]
    of = {(r["doc_id"], r["n_bytes"]): r["score"] for r in got}
    assert len(of) == 4 and of[2, 0] == pytest.approx(of[3, 0]) and of[1, 5] < of[2, 0] < 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = stream_mixing.score(fixtures.frame(spark, [(held, "ab", "en", "s", 1, "x")])).collect()
    assert (r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0)
    assert r["total_bits"] == pytest.approx(3 * 8, rel=1e-3)  # two bytes and the end, of 256 equally likely ones


def test_scores_follow_the_order_of_words(spark):
    """Contexts go across words: of two texts of the same words, the one in the learnt order is likelier."""
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    usual, other = " ".join(["abc", "def", "ghi"] * 20), " ".join(["abc", "ghi", "def"] * 20)
    data = [(i, usual, "en", "s", 1, "x") for i in range(400) if i not in held] + [(held[0], usual, "en", "s", 1, "x"), (held[1], other, "en", "s", 1, "x")]
    spark.createDataFrame(data, fixtures.SCHEMA).createOrReplaceTempView("ordered")
    folder = f"{stream_mixing.written(spark.table('ordered'), 'ordered').inputFiles()[0].rsplit('/', 1)[0]}"
    spark.read.parquet(folder).write.mode("overwrite").parquet(f"{folder}/../ordered/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op2_lm_scoring(spark, f"{folder}/../ordered").collect()}
    a, b = got[held[0]], got[held[1]]
    assert a["base_score"] == pytest.approx(b["base_score"]) and a["n_tokens"] == b["n_tokens"]
    assert b["total_bits"] > 3 * a["total_bits"]


def test_contexts_are_those_of_a_plain_scan():
    """Equal hashes just for equal last bytes of the same text, or equal words so far."""
    r = np.random.default_rng(1)
    texts = ["".join(r.choice(list("ab \n"), n)) for n in (0, 1, 2, 50, 300)] + ["ab" * 60, None]
    data, starts, coded = stream_mixing.stream(_words(texts))
    hashes = stream_mixing.contexts(data, REACH, len(data)).view(np.uint32).reshape(-1, PREDICTORS)
    seen = [{} for _ in range(PREDICTORS)]
    for text, start in zip(texts, starts, strict=True):
        b = (text or "").encode()
        for i in range(len(b) + 1):
            assert data[start + i] == (b[i] if i < len(b) else END)
            before = bytes([END]) * REACH + b[:i]
            word = b""
            while len(word) < REACH - 1 and not BREAKS[before[-1 - len(word)]]:
                word = before[-1 - len(word) : len(before) - len(word)] + word
            for k, context in enumerate([*(before[-o:] for o in ORDERS), word]):
                seen[k].setdefault(context, set()).add(int(hashes[start - REACH + i, k]))
    for of in seen:
        assert all(len(h) == 1 for h in of.values())
        assert len({h for hs in of.values() for h in hs}) == len(of)


def test_learning_is_that_of_a_plain_scan_bit_by_bit(monkeypatch):
    """Slots, weights and map after each bit of the stream, in its order, by plain Python; slots' numbers are the module's."""
    monkeypatch.setattr(stream_mixing, "BATCH", 1)
    monkeypatch.setattr(stream_mixing, "FULL", 9)
    texts = ["Abra cadabra abra", None, "cab dab\nabra abracadabra abra", "ä b"]
    code, w = _code(texts), _words(texts)
    learner = Learner(code)
    data, starts, coded = stream_mixing.stream(w)
    learner.learn(data, coded)
    hashes = stream_mixing.contexts(data, REACH, len(data))
    zeros, ones = {}, {}
    weights, seen, refined = {}, {}, {}
    for text, start in zip(texts, starts, strict=True):
        for i in range(start, start + len((text or "").encode()) + 1):
            rank, v = code.ranks[data[i - 1], data[i]], 0
            while v >= 0:
                bit = bool(code.nodes[v][0][rank])
                slot = stream_mixing.slots(code, v, hashes[i - REACH : i - REACH + 1])[0] + code.slots[v][0]
                for s in set(slot):
                    if max(zeros.get(s, 0), ones.get(s, 0)) >= 9:
                        zeros[s], ones[s] = zeros[s] // 2, ones[s] // 2
                x = np.array([math.log((ones.setdefault(s, 0) + 0.4) / (zeros.setdefault(s, 0) + 0.4)) for s in slot])
                wt = weights.setdefault(v, np.full(PREDICTORS, 0.3))
                mixed = float(np.clip(wt @ x, -12, 12))
                p = 1 / (1 + math.exp(-mixed))
                wt += RATE * (bit - p) * x / ((x * x).sum() * p * (1 - p) + 32)
                at = (v, int(data[i - 1]), round((mixed + 12) * (MAP_STEPS - 1) / 24))
                n = refined.setdefault(at, [0, 0])
                n[0], n[1] = n[0] + 1, n[1] + bit
                seen[v] = seen.get(v, 0) + 1
                for s in slot:
                    (ones if bit else zeros)[s] += 1
                v = code.nodes[v][1 + bit]
    assert {v: n for v, n in enumerate(learner.seen) if n} == seen
    for v, wt in weights.items():
        assert learner.weights[v] == pytest.approx(wt, abs=1e-4)
    assert {s: (int(learner.slots[s]) >> 16, int(learner.slots[s]) & 0xFFFF) for s in np.flatnonzero(learner.slots)} == {s: (zeros[s], ones[s]) for s in zeros}
    got = {(v, k // MAP_STEPS, k % MAP_STEPS): [int(learner.map[v, k] >> 32), int(learner.map[v, k] & 0xFFFFFFFF)] for v, k in zip(*np.nonzero(learner.map), strict=True)}
    assert got == refined


def _fitted(texts, tasks=2):
    code, sums = _code(texts), {}
    for k in range(tasks):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts[k::tasks])), pa.int64()), pa.array(texts[k::tasks], pa.string())], names=["_id", "_t"])
        for out in stream_mixing.learnt(code, "_t")(iter([batch])):
            sums[out["segment"][0].as_py()] = sums.get(out["segment"][0].as_py(), 0) + widen(zlib.decompress(out["counts"][0].as_py()))
    return Model(code, sums)


def test_scores_are_sums_over_bits_and_a_distribution():
    r = np.random.default_rng(2)
    texts = ["".join(r.choice(list("ab"), r.integers(0, 3))) for _ in range(600)]
    model = _fitted(texts)
    every = ["", "a", "b", "aa", "ab", "ba", "bb"]
    assert 0.9 < (10 ** model.log10(_words(every))).sum() < 1
    data, starts, coded = stream_mixing.stream(_words(["ab ba"]))
    hashes, bits = stream_mixing.contexts(data, REACH, len(data)), 0.0
    for i in range(starts[0], starts[0] + 6):
        rank, v = model.code.ranks[data[i - 1], data[i]], 0
        while v >= 0:
            bit = int(model.code.nodes[v][0][rank])
            x = model.odds[stream_mixing.slots(model.code, v, hashes[i - REACH : i - REACH + 1])[0] + model.code.slots[v][0]].astype(float)
            mixed = float(np.clip(x @ model.weights[v], -12, 12))
            p = (1 / (1 + math.exp(-mixed)) + model.map[v][int(data[i - 1]) * MAP_STEPS + round((mixed + 12) * (MAP_STEPS - 1) / 24)]) / 2
            bits -= math.log2(p if bit else 1 - p)
            v = model.code.nodes[v][1 + bit]
    assert model.log10(_words(["x", "ab ba", None]))[1] == pytest.approx(-bits * math.log10(2), rel=1e-5)


def test_blocks_pieces_and_batches_change_nothing(monkeypatch):
    """A text is scored alike wherever blocks and batches are cut, and whatever else is in its batch."""
    texts = [r[1] for r in fixtures.rows()]
    model = _fitted(texts, 3)
    want = model.log10(_words(texts))
    assert model.log10(_words(texts[::-1]))[::-1] == pytest.approx(want, rel=1e-5)
    for k, n in (("BATCH", 7), ("PIECE", 100), ("BLOCK", 999)):
        monkeypatch.setattr(stream_mixing, k, n)
    stream_mixing._powers.cache_clear()
    assert model.log10(_words(texts)) == pytest.approx(want, rel=1e-5)
    stream_mixing._powers.cache_clear()


def test_sums_of_weights_are_whole_numbers():
    model = _fitted(["abc abd"] * 40, 1)
    code = model.code
    learner = Learner(code)
    data, _, coded = stream_mixing.stream(_words(["abc abd"] * 40))
    learner.learn(data, coded)
    some = learner.seen > 0
    assert model.weights[some] * Model.ODDS_UNIT == pytest.approx(learner.weights[some], abs=1e-4)
    assert (widen(narrow(learner.seen)) == learner.seen).all()
