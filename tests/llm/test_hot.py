"""Rows that share an id, or have none, are a third of a table and more; bounds are lowered so that ways of large tables are taken."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperloom.llm import exact_dedup, fingerprints, jaccard_join, language_id, mixing, sharding, token_files
from tests.llm import fixtures


def crowded(n=240, seed=2):
    """A third without an id, a third of one id, some rows repeated very often."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 40))) + "." * r.randint(0, 2)
    rows = [((None, 7, i)[i % 3], text(), "en", "a" if i % 2 else None, 0, "x") for i in range(n)]
    return rows + [(7, "the same", "en", "a", 0, "x")] * 40 + [(None, None, None, None, 0, None)] * 40 + [(None, "", "en", "b", 0, "x"), (-5, "low", "en", "b", 0, "x")]


def test_neighbours_of_crowded_ids(spark):
    docs = fixtures.frame(spark, crowded())
    told = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    order = sorted(((r.doc_id is None, -(r.doc_id or 0), r.h, r.t, r.doc_id) for r in told), key=lambda x: x[:3])
    want = Counter()
    for (*_, t, i), (*_, after, _) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()] += 1
    got = Counter(tuple(r) for r in fingerprints.digest(docs).select("doc_id", "n_chars", "edited_sha256").collect())
    assert got == want
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        ranges = fingerprints.beside(docs).filter("not _copy").groupBy("_range").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert max(r["count"] for r in ranges) < 110 and len(ranges) > 8  # neither nulls nor one id are one range


def test_ranges_in_reading_order():
    assert fingerprints.laid_out([]) == ([], [0], [1], 1)
    assert fingerprints.laid_out([3, 8]) == ([3, 8], [2, 1, 0], [1, 1, 1], 3)
    assert fingerprints.laid_out([3, 5, 5, 5, 9]) == ([3, 5, 6, 9], [6, 5, 2, 1, 0], [1, 1, 3, 1, 1], 7)


def test_token_files_of_crowded_ids(spark, tmp_path):
    rows = crowded()
    docs = fixtures.frame(spark, rows)
    got = token_files.digest(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    token_files.write(docs, str(tmp_path / "files"))
    assert spark.read.parquet(str(tmp_path / "files")).select("shard").distinct().count() >= int(spark.conf.get("spark.sql.shuffle.partitions")) - 1


@pytest.mark.parametrize("hot", [1, 64])
def test_copies_that_are_hot(spark, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup, "HOT_LEAST", hot)
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", 100)
    rows = crowded()
    docs = fixtures.frame(spark, rows)
    kept = exact_dedup.drop_copies(docs).collect()
    same = lambda t: "".join(c for c in t or "" if c not in " \t\n\v\f\r")
    assert Counter(same(r.text) for r in kept) == Counter({same(r[1]) for r in rows})
    sizes = Counter(same(r[1]) for r in rows)
    groups = exact_dedup.exact_groups(docs).collect()
    assert len(groups) == len(rows) and Counter(r._size for r in groups) == Counter(sizes[same(r[1])] for r in rows)
    assert sum(r._kept for r in groups) == len(sizes)


def test_hot_groups_are_as_few_as_promised_when_every_row_is_repeated(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_LEAST", 1)
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", 10)
    seen = []
    with_groups = exact_dedup.with_groups
    monkeypatch.setattr(exact_dedup, "with_groups", lambda rows, groups, keys, hot: seen.append(groups.filter(f"_size > {hot}").count()) or with_groups(rows, groups, keys, hot))
    docs = fixtures.frame(spark, [(i, f"text {i}", "en", "a", 0, "x") for i in range(50)] * 20)
    assert exact_dedup.exact_groups(docs).count() == 1000 and seen == [0]  # 20 rows of 1000 are no hot group


def test_repeated_rows_are_one_document_of_their_component(spark):
    rows = crowded()
    kept = jaccard_join.distinct_documents(fixtures.frame(spark, rows)).collect()
    assert sum(r.text == "the same" for r in kept) == 1 and len(kept) < len(rows)
    assert set(kept[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "_id"}


def test_rows_without_ids_are_in_blocks_of_their_own(spark):
    rows = [(None, f"w{i} " * 30, "en", "big" if i % 4 else "small", 0, "x") for i in range(400)]
    docs = fixtures.frame(spark, rows)
    got = mixing.mix(docs, block=200, budget=1.0).collect()
    tokens = Counter()
    for r in got:
        tokens[r.source] += r.n_tokens
    weight = {r.source: r.weight for r in got}
    for s in ("big", "small"):  # budgets hold within a block or two
        assert abs(tokens[s] - weight[s] * 12_000) <= 600
    taken = mixing.mixed(docs, block=200)
    assert taken.count() == len(got)


def test_slots_of_repeated_rows(spark):
    got = sharding.shard(fixtures.frame(spark, crowded()), 4).collect()
    assert len(got) == len(crowded())
    for s in range(4):
        assert sorted(r._slot for r in got if r._shard == s) == list(range(sum(r._shard == s for r in got)))


def test_many_groups_of_one_size_stay_whole(spark):
    rows = [*crowded(), *((1000 + i, f"{i:04d}", "en", "a", 0, "x") for i in range(300)), *((2000 + i, f"{i % 150:04d}", "en", "a", 0, "x") for i in range(300))]
    got = sharding.shard(fixtures.frame(spark, rows), 4).collect()
    even = sum(r.size for r in got) / 4
    assert all(abs(sum(r.size for r in got if r._shard == s) - even) <= 10 for s in range(4))
    shards = {}
    for r in got:
        shards.setdefault((r.text_crc32, r.size), set()).add(r._shard)
    assert len(got) == len(rows) and all(len(s) == 1 for s in shards.values())


def test_many_labels_fold_into_one(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST", 2)
    rows = [(i, "one two three four five", ["en", "de", "fr", "it", "und", None][i % 6], "a", 0, "x") for i in range(30)] + [(99, "uno due", "en", "a", 0, "x")]
    docs = fixtures.frame(spark, rows)
    labels = {r[0]: r[1] for r in docs.select("lang", language_id.folded(docs, "lang")).distinct().collect()}
    assert labels == {"en": "en", "de": "de", "fr": "other", "it": "other", "und": "und", None: None}
    assert language_id.digest(docs).count() == 31 and language_id.accepted(docs).count() == 31
