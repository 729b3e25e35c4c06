import hashlib
import math

import numpy as np
import pytest

from paperloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, _q string"


def plain(rows, k=3, rounds=4, size=4):
    """Lloyd's rounds over every vector, in Python's whole numbers."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    draw = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [q for _, q in sorted(kept, key=draw)[:k]]

    def near(q):
        d = [sum((a - b) ** 2 for a, b in zip(q, c, strict=True)) for c in cents]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        at = [near(q)[0] for _, q in kept]
        cents = [[sum(x) // at.count(j) for x in zip(*(q for (_, q), a in zip(kept, at, strict=True) if a == j), strict=True)] if j in at else c for j, c in enumerate(cents)]
    last = [(i, *near(q), q) for i, q in kept]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, sum(x[2] for x in last if x[1] == c), sum(x[2] for x in last), sha[c], sum(x[3] == q for x in last)) for i, c, d, q in last), key=repr)


def run(spark, rows, **how):
    got = centroids.clusters(spark.createDataFrame(rows, SCHEMA), **{"k": 3, "rounds": 4, "size": 4, **how})
    return sorted((tuple(r) for r in got.collect()), key=repr)


def vectors(n=80):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)], 1, 2, "x") for i in range(n)]
    rows += [(1000 + i, rows[3][1], None, None, None) for i in range(50)]  # copies
    bad = [None, [], [1.0, 2.0, 3.0], [1.0, None, 2.0, 3.0], [1.0, float("nan"), 2.0, 3.0], [float("inf"), 0.0, 0.0, 0.0]]
    return rows + [(2000 + i, v, 0, 0, "x") for i, v in enumerate(bad)] + [(None, [0.5] * 4, 0, 0, "x"), (None, [-0.5] * 4, 0, 0, "x"), (5, [0.1] * 4, 0, 0, "x"), (5, [0.1] * 4, 0, 0, "x")]


def test_clusters_are_those_of_all_vectors(spark):
    assert run(spark, vectors()) == plain(vectors())


def test_few_vectors_ties_and_none(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, 0, 0, "x")]) == []
    few = [(1, [0.0] * 4, 0, 0, "x"), (2, [1.0] * 4, 0, 0, "x")]
    assert run(spark, few) == plain(few)
    same = [(i, [2.0, 2.0, 2.0, 2.0], 0, 0, "x") for i in range(9)]  # all centroids equal: the first has all, the others stay
    assert run(spark, same) == plain(same) and {r[1] for r in run(spark, same)} == {0}


def test_large_components_are_exact_and_larger_ones_refused(spark):
    big = [(i, [float((1 << 17) - i), -50000.0 * i, 7.0 * i, 0.25], 0, 0, "x") for i in range(2, 9)]
    assert run(spark, big[:2], rounds=1) == plain(big[:2], rounds=1)
    with pytest.raises(Exception, match="after scaling"):
        run(spark, [(1, [1e30] * 4, 0, 0, "x")])


def test_whole_numbers_where_doubles_do_not_hold():
    rng = np.random.default_rng(2)
    q, c = rng.integers(-(1 << 26), 1 << 26, (50, 64)), rng.integers(-(1 << 26), 1 << 26, (5, 64))
    at, d = centroids.nearest(q, c)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in q]
    assert [(w.index(min(w)), min(w)) for w in want] == list(zip(at.tolist(), d.tolist(), strict=True))
