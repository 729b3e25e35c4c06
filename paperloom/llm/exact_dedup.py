"""Exact dedup by progressive refinement, with DataFrame functions only.

Documents are compared by length first, then by a hash of a short prefix, then by
a full hash; only groups with two members or more go on to the next level. Each
level is an aggregation of narrow rows, map-side combined, and joined back to those rows: groups that
hold more than one in HOT_GROUPS rows are so few that they are broadcast to where their rows are, so that no
task gathers them; the others meet by key.

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D].

Defined results: null text counts as empty, and all empty texts are one group.
The row with the most code points stays, then the smallest doc_id (null last). Rows
repeated with one doc_id count one by one in the group's size; the first of
them stays. Extra columns are ignored by `exact_groups` and carried by `drop_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.names import fresh, own
from paperloom.session import written

SPACE = r"[\x20\x09-\x0D]+"
#: Code points of the normalised text that the second level hashes.
PREFIX = 64
#: Hot groups are those of more than one in so many rows, and of so many rows at least.
HOT_GROUPS, HOT_LEAST = 10_000, 64
KEYS = ["_len", "_pre"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: bool = True, row: bool = False) -> DataFrame:
    """Narrow rows (_id, _chars, _len, _pre[, _sha][, _row: a hash of the text as it is])."""
    rows = docs.select(F.col(id_col).alias("_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("_chars"), normalised(F.col(text_col)).alias("_norm"), F.xxhash64(text_col).alias("_row"))
    more = [F.sha2("_norm", 256).alias("_sha")] if full else []
    more += ["_row"] if row else []
    return rows.select("_id", "_chars", F.length("_norm").alias("_len"), F.xxhash64(F.substring("_norm", 1, PREFIX)).alias("_pre"), *more)


def hot_from(rows: int) -> int:
    """Groups of more rows than this are hot: at most HOT_GROUPS there can be, so they may be broadcast."""
    return max(HOT_LEAST, rows // HOT_GROUPS)


def survivors(rows: DataFrame, keys: list[str], hot: int, count: Column | None = None) -> DataFrame:
    """The rows whose keys occur at least twice; rows of hot keys stay where they are, the others meet by key."""
    again = rows.groupBy(*keys).agg((F.count(F.lit(1)) if count is None else count).alias("_n")).filter("_n > 1")
    large, small = (again.filter(f"_n {op} {hot}").select(*keys) for op in (">", "<="))
    stay = rows.join(F.broadcast(large), keys, "left_semi")
    rest = rows.join(F.broadcast(large), keys, "left_anti").join(small, keys, "left_semi")
    return stay.unionByName(rest)


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], hot: int) -> DataFrame:
    """rows with their groups' columns (_size, _best), nulls for rows of no group; again without moving rows of hot groups."""
    large, small = (groups.filter(f"_size {op} {hot}") for op in (">", "<="))
    stay = rows.join(F.broadcast(large), keys)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(small, keys, "left")
    return stay.unionByName(rest)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: _id, _keep (id of the row that stays), _size, _kept, _sha.

    The full hash is a result column of every document here, so one scan takes it with the
    length and the prefix hash, as narrow rows; it is compared within groups that survive both levels, and the
    rows of all others are grouped no further. `drop_copies` reads full texts for surviving groups only.
    """
    rows = written(features(docs, id_col, text_col).groupBy("_id", "_chars", *KEYS, "_sha").agg(F.count(F.lit(1)).alias("_m")), "exact")
    hot = hot_from(rows.agg(F.sum("_m")).first()[0] or 0)  # rows with their repeats, as groups are counted
    again = survivors(survivors(rows, ["_len"], hot, F.sum("_m")), KEYS, hot, F.sum("_m"))
    groups = again.groupBy(*KEYS, "_sha").agg(
        F.sum("_m").alias("_size"),
        # the most code points, then the smallest id
        F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"))).alias("_best"),
    )
    joined = with_groups(rows, written(groups.filter("_size > 1"), "groups"), [*KEYS, "_sha"], hot)
    alone = F.col("_size").isNull()
    best = alone | (F.col("_id").eqNullSafe(F.col("_best.i")) & (F.col("_chars") == -F.col("_best.c")))
    once = joined.filter("_m = 1").withColumn("_copy", F.lit(1))
    more = joined.filter("_m > 1").withColumn("_copy", F.explode(F.expr("sequence(1, int(_m))")))
    keep = F.when(alone, F.col("_id")).otherwise(F.col("_best.i"))
    return once.unionByName(more).select("_id", keep.alias("_keep"), F.coalesce("_size", F.lit(1).cast("long")).alias("_size"), (best & (F.col("_copy") == 1)).alias("_kept"), "_sha")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text another kept row has; columns as they came.

    Level 1 and 2 see narrow rows, written once; level 3 hashes the full text of the surviving rows alone. Rows are
    told apart by id and a hash of the text as it is, so a null or shared id doesn't keep or lose other texts. An empty table gives an empty one.
    """
    narrow = written(features(docs, id_col, text_col, full=False, row=True), "narrow")
    hot = hot_from(narrow.count())
    twice = survivors(survivors(narrow, ["_len"], hot), KEYS, hot)
    i, row, kept, whole = fresh(docs, "_i", "_r", "_kept", "_whole")
    some = written(twice.select(F.col("_id").alias(i), F.col("_row").alias(row)).distinct(), "twice")
    same = lambda other: docs[id_col].eqNullSafe(other[i]) & (F.xxhash64(docs[text_col]) == other[row])
    full = docs.join(some, same(some), "left_semi")
    rows = written(features(full, id_col, text_col, row=True).groupBy("_id", "_row", "_chars", *KEYS, "_sha").agg(F.count(F.lit(1)).alias("_m")), "full")
    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_row").alias("r"))).alias("_best")
    groups = rows.groupBy(*KEYS, "_sha").agg(F.sum("_m").alias("_size"), best).filter("_size > 1")
    joined = with_groups(rows, written(groups, "groups"), [*KEYS, "_sha"], hot).filter("_size is not null")
    stays = F.col("_id").eqNullSafe(F.col("_best.i")) & (F.col("_row") == F.col("_best.r"))
    fate = written(joined.select(F.col("_id").alias(i), F.col("_row").alias(row), stays.alias(kept), "_m").filter(f"not {kept} or _m > 1").drop("_m"), "fate")
    left = docs.join(fate, same(fate), "left").filter(f"coalesce({kept}, true)")
    rest = left.filter(f"{kept} is null").select(*own(docs))
    # repeated rows: one of them, chosen before they are shuffled
    one = left.filter(f"{kept} is not null").groupBy(i, row).agg(F.any_value(F.struct(*own(docs))).alias(whole)).select(f"{whole}.*")
    return rest.unionByName(one)
