"""Connected components by alternating large and small stars, as DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import written


#: As many edges are joined by one task (some 50 MB there), as rounds of joins over so few rows are fixed costs only; the results are the same.
FEW = 1 << 20


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, comp of all nodes of at most FEW edges: every node takes the least label of its neighbours, and of that label's node, until none changes."""
    got = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches if b.num_rows]
    if not got:
        return
    u, v = (np.concatenate([g[i] for g in got]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)  # the labels' own nodes, so that whole trees move
        np.minimum.at(new, label[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["u", "comp"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u, v) -> u, comp for every node of an edge; comp is the component's smallest node.

    Each round lets every node point its larger, then its smaller neighbours at the
    least one it knows; distances halve, so rounds grow with the logarithm of the longest path.
    It ends when a round changes no edge; more than rounds of them raise an error.
    Edges with a null end and loops are no edges, repeated ones are one; no edges give no rows.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    n = now.count()
    if n <= FEW:
        return now.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(settled, "u long, comp long")
    for _ in range(rounds):
        if not n:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(low.withColumnRenamed("m", "v")).filter("u <> v").distinct(), "edges")
        before, n = n, new.count()
        # equal numbers of distinct edges and none of them new: the same edges
        same = n == before and new.join(now, ["u", "v"], "left_anti").isEmpty()
        now = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.groupBy("u").agg(F.min("v").alias("comp"))
    roots = now.select(F.col("v").alias("u")).distinct().join(stars, "u", "left_anti").withColumn("comp", F.col("u"))
    return stars.unionByName(roots)
