"""Sharding by best-fit decreasing.

Indivisible groups (equal texts) are put into a fixed number of bins of one capacity: from the
largest on, each enters the bin with the tightest remaining capacity that holds it, found
in a balanced order of the remaining capacities. The capacity is the least, by bisection, with which all fit.
A group over an even share has a bin of its own and the rest is shared out over the others.

On Spark: groups are summed by map-side combined aggregation, and counted by size. Groups of one size are alike to the packing: the tightest bin that holds one of them
stays the tightest while it holds another, so it takes as many at once as it can. The driver therefore packs sizes with their numbers, and not groups; of n bytes there are at
most sqrt(2 n) different sizes. A group's place follows from its rank among those of its size (by hash, in ranges of the hash, so that no task ranks all groups of a frequent size). This
one way holds at any size of input. Slots are running numbers over
(shard, bucket) with the buckets' offsets added; no task sees a whole shard.

Defined results: null counts as the empty text (size 1, crc32 0), one group with empty texts; repeated rows are equal texts
and have slots of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.words import parts_of
from paperloom.session import written

#: Ranges of hashes in which groups of one size are ranked.
RANGES = 256


def packed(classes: list[tuple[int, int]], bins: int, capacity: int) -> list[list[tuple[int, int]]] | None:
    """For each class (size, number; sizes in falling order) the bins that its items enter, in order, as (bin, number); None if they don't fit."""
    free = [(capacity, b) for b in range(bins)]  # sorted by remaining capacity
    out = []
    for size, number in classes:
        own = []
        while number:
            i = bisect_left(free, (size, -1))
            if i == len(free):
                return None
            left, b = free.pop(i)
            some = min(number, left // size)
            insort(free, (left - some * size, b))
            own.append((b, some))
            number -= some
        out.append(own)
    return out


def best_fit(classes: list[tuple[int, int]], bins: int) -> list[list[tuple[int, int]]]:
    """As `packed`, at the least capacity that holds all; classes in falling order of their sizes."""
    left, total, first, out = [[s, n] for s, n in classes], sum(s * n for s, n in classes), 0, [[] for _ in classes]
    at = 0
    while bins - first > 1 and at < len(left) and left[at][0] * (bins - first) > total:  # over an even share
        total -= left[at][0]
        out[at].append((first, 1))
        left[at][1] -= 1
        first += 1
        at += not left[at][1]
    rest = [(s, n) for s, n in left[at:]]
    low = max(-(-total // (bins - first)), rest[0][0] if rest else 0)
    high = low + (rest[0][0] if rest else 0)
    while packed(rest, bins - first, high) is None:
        high += high - low + 1
    while low < high:
        if packed(rest, bins - first, (low + high) // 2) is None:
            low = (low + high) // 2 + 1
        else:
            high = (low + high) // 2
    for own, places in zip(out[at:], packed(rest, bins - first, high) or [], strict=True):
        own += [(first + b, n) for b, n in places]
    return out


def assign(rows: DataFrame, group: list[str], size: Column, shards: int) -> DataFrame:
    """rows with _shard; rows of one group are in one shard. The first column of group is a hash."""
    spark = rows.sparkSession
    part = F.shiftright(group[0], 65 - RANGES.bit_length()).cast("int").alias("_part")  # in the order of the hash
    groups = written(rows.groupBy(*group).agg(F.sum(size).alias("_bytes")).select("*", part), "groups")
    counts = written(groups.groupBy("_bytes", "_part").agg(F.count(F.lit(1)).alias("_n")), "counts")
    classes = sorted((tuple(r) for r in counts.groupBy("_bytes").agg(F.sum("_n")).collect()), reverse=True)
    ranges = []
    for (bytes_, _), own in zip(classes, best_fit(classes, shards), strict=True):
        at = 0
        for b, n in own:
            ranges.append((bytes_, at, at + n, b))
            at += n
    places = spark.createDataFrame(ranges, "_bytes long, _from long, _to long, _shard int")
    before = Window.partitionBy("_bytes").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    starts = counts.select("_bytes", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bytes", "_part").orderBy(*group)) - 1
    ranked = groups.withColumn("_rank", inside).join(starts, ["_bytes", "_part"]).withColumn("_rank", F.col("_start") + F.col("_rank"))
    placed = ranked.join(places, "_bytes").filter("_rank >= _from and _rank < _to").select(*group, "_shard")
    return rows.join(placed, group)


def slotted(rows: DataFrame, order: list[str], times: str = "_times") -> DataFrame:
    """Each row as often as times says, with _slot, gapless from 0 in each _shard. So rows that are repeated very often are numbered as one."""
    n = parts_of(rows.sparkSession)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    counts = rows.groupBy("_shard", "_bucket").agg(F.sum(times).alias("_n"))  # shards times partitions at most
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("_shard", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_at", F.coalesce(F.sum(times).over(inside), F.lit(0))).join(F.broadcast(offsets), ["_shard", "_bucket"])
    each = F.explode(F.expr(f"sequence(0L, {times} - 1)"))
    placed = numbered.filter(f"{times} = 1").withColumn("_copy", F.lit(0).cast("long")).unionByName(numbered.filter(f"{times} > 1").withColumn("_copy", each))
    return placed.withColumn("_slot", F.col("_from") + F.col("_at") + F.col("_copy")).drop("_bucket", "_at", "_from", "_copy", times)


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, size, text_crc32, _shard, _slot; narrow rows only move."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_g"), F.xxhash64(F.lit(1), text).alias("_h"))
    rows = written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_times")), "sizes")
    placed = assign(rows, ["_g", "_h"], F.col("size") * F.col("_times"), shards)
    return slotted(placed, ["_id", "_g"])


def digest(docs: DataFrame) -> DataFrame:
    return shard(docs).select(F.col("_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
