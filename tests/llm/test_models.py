import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import bpe, context_mixing, exact_dedup, fingerprints, jaccard_join, language_id, mixing, sharding
from tests.llm import brute, fixtures


def test_lm_counts_and_base_match_brute_force(spark):
    got = {r["doc_id"]: r for r in context_mixing.score(fixtures.frame(spark)).collect()}
    want = brute.base_scores([r[:2] for r in fixtures.rows()])
    assert set(got) == set(want)
    for i, w in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert context_mixing.score(fixtures.empty(spark)).count() == 0


def test_lm_scores_match_a_scan_with_the_same_bit_model(spark, monkeypatch):
    """Words, counts, Good-Turing shares and the mixture over classes by plain Python; the spelling of words by the model that was fitted."""
    kept = {}
    fit = context_mixing.fitted
    monkeypatch.setattr(context_mixing, "fitted", lambda *a: kept.setdefault("model", fit(*a)))
    got = {r["doc_id"]: r for r in context_mixing.score(fixtures.frame(spark)).collect()}
    rows = [(r[0], r[1], r[2] or "") for r in fixtures.rows()]
    cut = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode()), b" "] for i, t, _ in rows}
    train = [(i, c) for i, _, c in rows if not brute.held(i)]
    classes = sorted(Counter(c for _, c in train).items(), key=lambda x: (-x[1], x[0]))[: context_mixing.CLASSES]
    names = {c: k for k, (c, _) in enumerate(classes)}
    docs = [*(n for _, n in classes), len(train) - sum(n for _, n in classes)]
    by = [Counter() for _ in docs]
    for i, c in train:
        by[names.get(c, len(classes))].update(cut[i])
    every = sum(by, Counter())
    words = sorted({w for ws in cut.values() for w in ws})
    spelt = dict(zip(words, 10 ** np.maximum(context_mixing.spelling(kept["model"], pa.array(words, pa.binary())), -300), strict=True))
    share = lambda c: 1 - max(sum(n == 1 for n in c.values()), 1) / (sum(c.values()) + 1) if c else 0.0
    whole = {w: share(every) * every[w] / sum(every.values()) + (1 - share(every)) * spelt[w] for w in words}
    for i, ws in cut.items():
        of = [math.log10((n + 1) / (len(train) + len(docs))) + sum(math.log10(share(c) * c[w] / max(sum(c.values()), 1) + (1 - share(c)) * whole[w]) for w in ws) for c, n in zip(by, docs, strict=True)]
        want = max(of) + math.log10(sum(10 ** (x - max(of)) for x in of))
        assert got[i]["score"] == pytest.approx(want, rel=1e-5)
        assert got[i]["n_bytes"] == len((dict((r[0], r[1]) for r in rows)[i] or "").encode())
        assert got[i]["total_bits"] == pytest.approx(-got[i]["score"] / math.log10(2))
        assert got[i]["bits_per_byte"] == pytest.approx(got[i]["total_bits"] / max(1, got[i]["n_bytes"]))


def test_lm_null_ids_and_repeated_rows(spark):
    data = [(None, "a b", "en", "s", 1, "x"), (1, "a b c", "en", "s", 1, "x"), (1, "a b c", "en", "s", 1, "x")]
    got = context_mixing.score(fixtures.frame(spark, data)).collect()
    assert sorted(r["n_tokens"] for r in got) == [3, 4, 4]
    assert len({(r["doc_id"], r["score"]) for r in got}) == 2


def test_lm_spelling_is_a_distribution():
    """Of all one- and two-letter words over few letters, the probabilities add up to less than 1, and to most of it after learning just these."""
    words = [bytes([a, *b]) for a in b"abcd" for b in ([], *([x] for x in b"abcd"))]
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary())], names=["word"])
    counts = np.zeros((2, len(context_mixing.ORDERS) << 16), np.int32)
    step = counts.shape[1] // 8
    for out in context_mixing.tables(1 << 16, 8)(iter([batch])):
        for i, c in zip(out["segment"].to_pylist(), out["counts"].to_pylist(), strict=True):
            counts[:, i * step : (i + 1) * step] = context_mixing.widen(zlib.decompress(c)).reshape(2, step)
    model = (counts, np.full((context_mixing.GATES, len(context_mixing.ORDERS)), 0.6), context_mixing.squash(np.tile(np.linspace(-12, 12, context_mixing.MAP_STEPS), 8 * 256)))
    total = (10 ** context_mixing.spelling(model, pa.array(words, pa.binary()))).sum()
    assert 0.3 < total < 1


def test_lm_learns(spark):
    """Held-out text of the same kind is likelier than under no model, and than text of another kind."""
    r = np.random.default_rng(0)
    word = lambda: "".join(r.choice(["ba", "do", "ki", "lu"], 4))
    data = [(i, " ".join(word() for _ in range(60)), "en", "s", 1, "x") for i in range(120)]
    odd = [(1000 + i, " ".join("".join(r.choice(list("qxzjvw"), 8)) for _ in range(60)), "en", "s", 1, "x") for i in range(20)]
    got = context_mixing.score(fixtures.frame(spark, data + odd)).filter("held_out").collect()
    usual, other = ([x["bits_per_token"] for x in got if (x["doc_id"] < 1000) == k] for k in (True, False))
    assert max(usual) < min(other)


def test_fingerprints(spark):
    rows = fixtures.rows()
    got = {r["doc_id"]: r for r in fingerprints.digest(fixtures.frame(spark)).collect()}
    order = sorted(rows, reverse=True)
    by = defaultdict(set)
    for k, (i, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        by[text].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    assert len({next(iter(v)) for t, v in by.items() if t.strip()}) == sum(bool(t.strip()) for t in by)
    assert fingerprints.digest(fixtures.empty(spark)).count() == 0


def test_fingerprints_add_and_take_away(spark):
    rows = spark.createDataFrame([("whole", "one two three\nfour five six\nseven"), ("mixed", "seven\n\none two three\nfour five six"), ("part", "one two three\nseven"), ("line", "four five six")], "name string, t string")
    v = fingerprints.vectors(rows, ["name"], "t")
    pick = lambda k: v.filter(f"name = '{k}'").drop("name").selectExpr("1 AS name", "*")
    whole = pick("whole").select(fingerprints.fingerprint()).first()[0]
    assert pick("mixed").select(fingerprints.fingerprint()).first()[0] == whole
    assert fingerprints.combine(pick("part"), pick("line"), ["name"]).select(fingerprints.fingerprint()).first()[0] == whole
    assert fingerprints.combine(pick("whole"), pick("line"), ["name"], -1).select(fingerprints.fingerprint()).first()[0] == pick("part").select(fingerprints.fingerprint()).first()[0]


def test_fingerprints_of_one_document_and_null_ids(spark):
    one = fingerprints.digest(fixtures.frame(spark, [(1, "a b c d", "en", "s", 7, "x")])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest()
    assert fingerprints.digest(fixtures.frame(spark, [(None, "x y", "en", "s", 3, "x"), (2, None, "en", "s", 0, "x"), (2, None, "en", "s", 0, "x")])).count() == 3


def shares(rows):
    n = Counter()
    for _, text, _, source, *_ in rows:
        n[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return n


def test_mixing_meets_its_target_and_budget(spark):
    rows = fixtures.rows(200)
    got = mixing.mix(fixtures.frame(spark, rows), target=0.8, repeat=3.0, block=200).collect()
    n = shares(rows)
    total = sum(n.values())
    weight = {r["source"]: r["weight"] for r in got if r["weight"] > 0}
    assert sum(weight.values()) == pytest.approx(1, abs=1e-6)
    entropy = -sum(w * math.log(w) for w in weight.values())
    assert entropy >= 0.8 * math.log(len(weight)) - 1e-3 or max(weight[s] * total / n[s] for s in weight) == pytest.approx(3.0, rel=1e-2)
    assert max(weight[s] * total / n[s] for s in weight) <= 3.0 + 1e-6
    # the same exponent for all sources
    t = {round(math.log(weight[a] / weight[b]) / math.log(n[a] / n[b]), 6) for a in weight for b in weight if n[a] > n[b]}
    assert len(t) == 1
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["n_tokens"]
    for s in weight:  # to a block, or a document larger than a block
        assert abs(taken[s] - weight[s] * total) <= 200 + max(len((x[1] or "").split()) for x in rows)
    for r in got:
        assert r["epoch"] <= 3


def test_mixed_repeats_rows_and_keeps_columns(spark):
    df = fixtures.frame(spark, fixtures.rows(200))
    out = mixing.mixed(df, target=0.8, repeat=3.0, block=200)
    assert out.columns == df.columns
    each = Counter(r["doc_id"] for r in mixing.mix(df, target=0.8, repeat=3.0, block=200).collect())
    assert Counter(r["doc_id"] for r in out.collect()) == each
    assert mixing.mixed(fixtures.empty(spark)).count() == 0
    blank = fixtures.frame(spark, [(1, None, "en", "s", 0, "x"), (2, " ", "en", None, 1, "x")])
    assert mixing.mixed(blank).count() == 2


def test_languages(spark):
    r = np.random.default_rng(1)
    vocab = {"en": "the and with from that this have which would there".split(), "de": "der und nicht für über auch wird können schön größe".split()}
    text = lambda x, n=40: " ".join(r.choice(vocab[x], n))
    data = [(i, text("en" if i % 2 else "de"), "en" if i % 2 else "de", f"s{i % 3}", 1, "x") for i in range(200)]
    data += [(300, text("de"), "en", "s0", 1, "x"), (301, text("en"), None, "s1", 1, "x"), (302, "12345 !!! 99", "en", "s0", 1, "x"), (303, None, "en", "s0", 0, "x"), (304, "", None, None, 0, "x"), (305, "x", "de", "s0", 1, "x")]
    df = fixtures.frame(spark, data)
    got = {x["doc_id"]: x for x in language_id.digest(df).collect()}
    assert len(got) == len(data)
    right = sum(got[i]["language"] == lang for i, _, lang, *_ in data[:200])
    assert right >= 198
    assert (got[300]["language"], got[301]["language"]) == ("de", "en")
    assert [got[i]["language"] for i in (302, 303, 304)] == ["und"] * 3
    kept = language_id.accepted(df)
    assert kept.columns == df.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(i for i in got if got[i]["kept"])
    assert language_id.digest(fixtures.empty(spark)).count() == 0


def test_languages_of_few_rows_are_known(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 20)
    r = np.random.default_rng(2)
    vocab = {"en": "the and with from that this have which would there".split(), "de": "der und nicht für über auch wird können schön größe".split(), "el": "αυτό είναι ένα κείμενο στα ελληνικά και όχι άλλο τίποτα".split(), "ka": "ეს არის ქართული ტექსტი და სხვა არაფერი".split()}
    langs = ["en", "de"] * 100 + ["el", "el", "el", "ka"]
    data = [(i, " ".join(r.choice(vocab[x], 40)), x, "s", 1, "x") for i, x in enumerate(langs)] + [(None, "the same text", "fr", "s", 1, "x")] * 30
    df = fixtures.frame(spark, data)
    names, some = language_id.sampled(df.select("doc_id", "text", "lang"), "lang")
    assert names == ["de", "el", "en", "fr", "ka"]
    assert Counter(x["lang"] for x in some.collect()) == {"en": 20, "de": 20, "el": 3, "ka": 1, "fr": 20}
    got = {x["doc_id"]: x for x in language_id.digest(df).collect()}
    assert [got[i]["language"] for i in range(200, 204)] == langs[200:]
    assert language_id.accepted(df).count() == len(data)


def test_nothing_is_rejected_without_labels(spark):
    df = fixtures.frame(spark, [(1, "the and with", None, "s", 1, "x"), (2, None, None, None, 1, "x"), (None, "12", None, "s", 1, "x")])
    assert language_id.accepted(df).count() == 3
    assert all(x["kept"] and x["language"] == "und" for x in language_id.digest(df).collect())


def test_page_evidence(spark):
    docs = fixtures.frame(spark, [(i, ("the and with that " if i % 2 else "der und nicht über ") * 10, "en" if i % 2 else "de", "s", 1, "x") for i in range(60)])
    pages = spark.createDataFrame([(0, "https://a.example.com/de/1", "<html lang='de'><p>x y</p></html>"), (1, "https://b.example.de/", "<html><p>und</p></html>"), (2, "https://c.example.com/", "<html lang=en><p>der und nicht über der und nicht über der und nicht</p></html>"), (3, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["language"] for r in language_id.of_pages(pages, docs).collect()}
    assert got == {0: "de", 1: "de", 2: "de", 3: "und"}


def test_sharding(spark):
    rows = fixtures.rows(400)
    got = sharding.digest(fixtures.frame(spark, rows)).collect()
    text = {i: t or "" for i, t, *_ in rows}
    place, sizes, slots = {}, Counter(), defaultdict(list)
    for r in got:
        t = text[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None)
        assert place.setdefault(t, r["shard"]) == r["shard"]
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    groups = Counter()
    for t in text.values():
        groups[t] += len(t.encode()) + 1
    even = sum(groups.values()) / 16
    assert set(sizes) == set(range(16)) and all(v <= max(max(groups.values()), 1.1 * even) for v in sizes.values())
    assert sharding.digest(fixtures.empty(spark)).count() == 0


def test_best_fit_packs_tightly():
    r = np.random.default_rng(0)
    classes = sorted(Counter(r.integers(1, 1000, 300).tolist()).items(), reverse=True)
    bins = Counter()
    for (s, n), own in zip(classes, sharding.best_fit(classes, 7), strict=True):
        assert sum(k for _, k in own) == n
        for b, k in own:
            bins[b] += s * k
    assert max(bins.values()) - sum(bins.values()) / 7 < 5
    assert sharding.best_fit([(900, 1), (10, 20)], 3)[0] == [(0, 1)]
    assert sharding.best_fit([], 3) == []


def test_sizes_with_their_numbers_pack_as_one_by_one():
    r = np.random.default_rng(1)
    for _ in range(200):
        sizes = sorted(r.integers(1, 12, int(r.integers(1, 60))).tolist(), reverse=True)
        bins, capacity = int(r.integers(1, 6)), int(r.integers(11, 90))
        free, want = [(capacity, b) for b in range(bins)], []
        for s in sizes:
            fit = sorted(x for x in free if x[0] >= s)
            if not fit:
                want = None
                break
            free.remove(fit[0])
            free.append((fit[0][0] - s, fit[0][1]))
            want.append(fit[0][1])
        got = sharding.packed(sorted(Counter(sizes).items(), reverse=True), bins, capacity)
        assert (got is None) == (want is None) and (got is None or [b for own in got for b, n in own for _ in range(n)] == want)


def test_pipeline_stages_on_their_own_input(spark, tmp_path):
    df = fixtures.frame(spark).drop("_id")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == before.columns
        ids, was = Counter(r["doc_id"] for r in docs.collect()), Counter(r["doc_id"] for r in before.collect())
        if name == "language_id":
            assert ids == Counter(r["doc_id"] for r in language_id.digest(before).collect() if r["kept"])
            assert not [r for r in docs.collect() if not any(c.isalpha() for c in r["text"] or "")]
        if name == "source_mixing":
            assert ids == Counter(r["doc_id"] for r in mixing.mix(before).collect())
            assert {r["doc_id"]: r for r in docs.collect()} == {r["doc_id"]: r for r in before.collect() if r["doc_id"] in ids}
        if name == "exact_dedup":
            best = {}
            for r in before.collect():
                key = "".join(c for c in r["text"] or "" if c not in " \t\n\v\f\r")
                best[key] = min(best.get(key, (1, 0)), (-len(r["text"] or ""), r["doc_id"]))
            assert ids == Counter(i for _, i in best.values())
        if name == "jaccard_join":
            want = brute.similar([(r["doc_id"], r["text"]) for r in before.collect()])
            assert ids == Counter(i for i, (_, c) in want.items() if i == c)
        if name == "bpe":
            assert ids == was
            assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, bpe.digest(before).collect()))
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ids


def test_pipeline_with_columns_of_clashing_names(spark, tmp_path):
    df = fixtures.frame(spark, fixtures.rows(30))
    df.drop("_id").write.parquet(str(tmp_path / "plain" / "documents.parquet"))
    names = ["_row", "_n", "_t", "_rep", "_sha", "_keep", "_size", "_source", "_tokens", "_block", "_whole", "_i", "_r", "kept", "cls", "comp", "key", "hashes", "_copy", "_language"]
    clashing = df
    for k, n in enumerate(names):  # _id comes with the fixture
        clashing = clashing.withColumn(n, F.lit(k))
    clashing.write.parquet(str(tmp_path / "clash" / "documents.parquet"))
    plain, clash = (sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path / n)).collect())) for n in ("plain", "clash"))
    assert plain == clash and plain


def test_pipeline_of_empty_and_null_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows, want in (("none", [], 0), ("nulls", [(None, None, None, None, None), (None, "the same text of some words", "en", None, None), (None, "the same text of some words", "en", None, None), (7, None, "en", "s", None)], 1)):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == want
