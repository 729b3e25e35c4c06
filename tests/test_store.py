import json

import pytest
from pyspark.sql import functions as F

from paperloom.sources import papers
from paperloom.sources.store import Conflict, Store


def some(spark, notes):
    """Papers by key with a note's text each."""
    rows = [(k, json.dumps({"annotations": [{"id": "n", "page": 1, "text": t}], "translations": {"k": t}}), None) for k, t in notes]
    return papers.restored(spark.createDataFrame(rows, "key string, main string, backup string"))


def held(frame):
    return sorted((r.key, r.annotations[0].text) for r in frame.collect())


def test_single_papers_are_taken_in(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=4)
    assert store.read().count() == 0 and store.write(some(spark, [])) == 0
    assert store.write(some(spark, [(str(i), "old") for i in range(40)])) == 1
    before = store.manifest()["files"]
    assert store.write(some(spark, [("7", "new"), ("99", "first")])) == 2
    after = store.manifest()["files"]
    assert 1 <= sum(before[b] != after[b] for b in after) <= 2  # only the buckets of the two
    assert held(store.read()) == sorted([(str(i), "new" if i == 7 else "old") for i in range(40)] + [("99", "first")])
    assert held(store.read(1)) == sorted((str(i), "old") for i in range(40))  # the state before is still there
    assert held(store.paper("7")) == [("7", "new")] and store.paper("no").count() == 0
    store.swept(1)
    assert held(store.read()) == sorted([(str(i), "new" if i == 7 else "old") for i in range(40)] + [("99", "first")]) and store.numbers() == [2]


def test_a_failing_task_leaves_the_old_state(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=4)
    store.write(some(spark, [(str(i), "old") for i in range(20)]))
    bad = some(spark, [(str(i), "new") for i in range(20)]).repartition(5, "key").withColumn("translations", F.when(F.col("key") == "13", F.raise_error(F.lit("lost")).cast("map<string,string>")).otherwise(F.col("translations")))
    with pytest.raises(Exception, match="lost"):
        store.write(bad)
    assert held(store.read()) == sorted((str(i), "old") for i in range(20)) and store.numbers() == [1]
    with pytest.raises(Exception, match="without a key"):
        store.write(some(spark, [(None, "x")]))
    assert store.write(some(spark, [("1", "new")])) == 2


def test_of_two_writers_one_comes_second(spark, tmp_path):
    first, second = (Store(spark, f"file://{tmp_path}/s", buckets=2) for _ in range(2))
    first.write(some(spark, [("a", "1")]))
    begun = second.manifest()
    second.manifest = lambda number=None: begun  # it has read the state before
    first.write(some(spark, [("a", "2")]))
    with pytest.raises(Conflict):
        second.write(some(spark, [("a", "3")]))
    assert held(first.read()) == [("a", "2")]
    twice = some(spark, [("b", "x"), ("b", "y")])
    first.write(twice)
    assert [k for k, _ in held(first.read())] == ["a", "b"]
