import hashlib
import random
import re

import pytest

from paperloom.llm import components as module
from paperloom.llm import exact_dedup, jaccard_join, queries, substring_dedup
from paperloom.llm.components import components
from tests.llm import brute, fixtures


def _op4(rows):
    groups = {}
    for i, text, *_ in rows:
        t = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(t, []).append((-len(text or ""), i))
    out = set()
    for t, members in groups.items():
        keep = min(members)[1]
        out |= {(i, keep, len(members), i == keep, hashlib.sha256(t.encode()).hexdigest()) for _, i in members}
    return out


def _digest4(spark, monkeypatch, df):
    monkeypatch.setattr(queries, "_documents", lambda s, d: df)
    return [tuple(r) for r in queries.op4_exact_dedup(spark, "").select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]


def test_exact_copies_match_brute_force(spark, monkeypatch):
    assert set(_digest4(spark, monkeypatch, fixtures.frame(spark))) == _op4(fixtures.rows())
    assert _digest4(spark, monkeypatch, fixtures.empty(spark)) == []


def test_exact_copies_of_repeated_rows_and_null_ids(spark, monkeypatch):
    data = [(1, "a b", "en", "s", 3, "x")] * 3 + [(None, "ab ", "en", "s", 3, "x"), (0, "q", "en", "s", 1, "x")]
    got = _digest4(spark, monkeypatch, fixtures.frame(spark, data))
    assert sorted((r[0], r[1], r[2]) for r in got if r[0] is not None) == [(0, 0, 1), (1, 1, 4), (1, 1, 4), (1, 1, 4)]
    assert sum(r[3] for r in got) == 2
    kept = exact_dedup.drop_copies(fixtures.frame(spark, data)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(0, "q"), (1, "a b")]


def test_drop_copies_keeps_one_of_each_text(spark):
    kept = exact_dedup.drop_copies(fixtures.frame(spark))
    assert kept.columns == fixtures.frame(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in _op4(fixtures.rows()) if r[3])


def test_copies_go_by_row_where_ids_are_null_or_shared(spark):
    data = [(1, "a b", "en", "s", 3, "x"), (None, "ab", "en", "s", 2, "x"), (None, "q", "en", "s", 1, "x"), (None, "q", "en", "s", 1, "x"), (3, "a b", "en", "s", 3, "x"), (3, "r", "en", "s", 1, "x"), (4, "q", "en", "s", 1, "x")]
    kept = exact_dedup.drop_copies(fixtures.frame(spark, data)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, "a b"), (3, "r"), (4, "q")]


def test_near_copies_go_by_row_where_ids_are_null_or_shared(spark):
    r = random.Random(4)
    text = {k: " ".join(f"{k}{r.randrange(1000)}" for _ in range(60)) for k in "abcdefg"}
    near = {k: t + " more" for k, t in text.items()}
    data = [
        (1, text["a"]), (None, near["a"]), (None, text["b"]), (None, text["c"]), (None, near["c"]), (None, "  "), (None, None),
        (2, text["d"]), (2, near["a"]), (0, text["e"]), (0, text["f"]), (5, near["e"]), (0, near["f"]), (9, text["g"]), (9, text["g"]),
    ]
    df = fixtures.frame(spark, [(i, t, "en", "s", 1, "x") for i, t in data])
    out = jaccard_join.distinct_documents(df)
    assert out.columns == df.columns
    name = {None: "null", "  ": "blank"} | {t: k for k in text for t in (text[k], near[k])}
    got = sorted((str(x["doc_id"]), name[x["text"]]) for x in out.collect())
    assert got == sorted([("1", "a"), ("None", "b"), ("None", "c"), ("None", "blank"), ("None", "null"), ("2", "d"), ("0", "e"), ("0", "f"), ("9", "g")])


def test_substring_dedup_matches_brute_force(spark):
    got = {r[0]: tuple(r[1:]) for r in substring_dedup.digest(fixtures.frame(spark)).collect()}
    assert got == brute.substrings([r[:2] for r in fixtures.rows()])
    assert substring_dedup.digest(fixtures.empty(spark)).count() == 0


def test_substring_dedup_within_one_document_and_repeated_rows(spark):
    loop = " ".join(f"w{i % 23}" for i in range(200))
    data = [(5, loop, "en", "s", 1, "x"), (5, loop, "en", "s", 1, "x"), (2, "x " + loop[:150], "en", "s", 1, "x")]
    got = {r[0]: tuple(r[1:]) for r in substring_dedup.digest(fixtures.frame(spark, data)).collect()}
    assert got == brute.substrings([(5, loop), (2, "x " + loop[:150])])


def test_substring_dedup_of_null_and_shared_ids(spark):
    r = random.Random(5)
    some = lambda n: " ".join(f"v{r.randrange(10**6)}" for _ in range(n))
    passage = some(40)
    texts = [(None, passage + " " + some(300)), (None, passage + " " + some(3)), (None, some(200) + " " + passage), (7, some(50) + " " + passage), (7, passage), (7, passage), (3, some(30)), (9, None), (None, None)]
    df = fixtures.frame(spark, [(i, t, "en", "s", 1, "x") for i, t in texts])
    order = sorted({tuple(x) for x in df.selectExpr("doc_id is null", "doc_id", "xxhash64(text)", "text").collect()}, key=lambda x: (x[0], x[1] or 0, x[2]))
    want = brute.substrings([(k, x[3]) for k, x in enumerate(order)])
    place = {(x[1], x[3]): want[k] for k, x in enumerate(order)}
    got = sorted(map(str, map(tuple, substring_dedup.digest(df).collect())))
    assert got == sorted(str((i, *place[i, t])) for i, t in texts)


def test_jaccard_components_match_brute_force(spark):
    got = {r[0]: tuple(r[1:]) for r in jaccard_join.digest(fixtures.frame(spark)).collect()}
    assert got == brute.similar([r[:2] for r in fixtures.rows()])
    assert jaccard_join.digest(fixtures.empty(spark)).count() == 0


def test_jaccard_with_frequent_tokens_and_large_near_groups(spark, monkeypatch):
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    base = [r.choice(words) for _ in range(120)]
    shared = " ".join(r.choice(words) for _ in range(60))
    data = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(words)
        text = " ".join(w) if i % 2 else shared + " " + " ".join(r.choice(words) for _ in range(r.randint(5, 60)))
        data.append((i, text, "en", "s", 1, "x"))
    want = brute.similar([d[:2] for d in data])
    for rare in (2, 3, 64):
        monkeypatch.setattr(jaccard_join, "RARE", rare)
        got = {x[0]: tuple(x[1:]) for x in jaccard_join.digest(fixtures.frame(spark, data)).collect()}
        assert got == want
    kept = {x["doc_id"] for x in jaccard_join.distinct_documents(fixtures.frame(spark, data)).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components_of_a_path_and_a_star(spark, monkeypatch, few):
    monkeypatch.setattr(module, "FEW", few)
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 10)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 110), 100)}
    rows = [(1, None), (None, None), (4, 4), (7, 5), (7, 5)]  # a null is no node, a loop no edge
    assert {tuple(r) for r in components(spark.createDataFrame(rows, "u long, v long")).collect()} == {(7, 5), (5, 5)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    r = random.Random(7)
    mixed = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    top = {x: x for e in mixed for x in e if e[0] != e[1]}
    for _ in top:
        for a, b in mixed:
            if a != b:
                top[a] = top[b] = min(top[a], top[b])
    assert {x[0]: x[1] for x in components(spark.createDataFrame(mixed, "u long, v long")).collect()} == top
    if not few:
        with pytest.raises(RuntimeError, match="rounds"):
            components(spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long"), rounds=2)
