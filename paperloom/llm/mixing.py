"""Mixing sources to target weights by temperature, with DataFrame functions only.

Shares of tokens p are raised to an exponent t between 0 and 1 and normalised: q = p**t / sum(p**t). At t = 1
nothing changes, at 0 all sources weigh the same. The exponent is found by bisection,
STEPS points at a time in one aggregation over the sources: the largest t whose entropy reaches the target (a part of that of
equal weights) but, first of all, with which no source is read more often than `repeat` times.

Weights are realised as block permutations: a source's documents are dealt to blocks by hash of id and text, so that rows without an id, or that share one, are
in blocks of their own; each
epoch orders its blocks by a hash of (seed, epoch, block), whole epochs are taken while
the source's budget of tokens lasts, and of the last one the blocks before the budget ends.
Running sums go over blocks in ranges of their order, so a source of a third of all rows is many tasks.

Defined results: null source is a source of its own; null and blank texts have no tokens and
stay with their block in every whole epoch and as the last one has it; rows repeated with one doc_id are documents of their own; with no tokens
at all every document is taken once; an empty table gives no rows; extra columns are carried by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.names import fresh, own
from paperloom.session import written

TARGET, REPEAT, BLOCK, SEED = 0.97, 4.0, 1 << 16, 7
STEPS, ROUNDS, RANGES = 64, 4, 256
#: As many sources may be broadcast with their weights.
FEW = 1 << 17
WORD = r"[^\x20\x09-\x0D]+"


def token_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """_id, _row (a hash of the text), _source, _tokens: words of each whole text."""
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_row"), F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("_source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("_tokens"))


def exponent(shares: DataFrame, target: float, repeat: float, budget: float) -> float:
    """The largest t in [0, 1] that meets the target, or the least that keeps to the repetition limit.

    shares: _n, tokens of each source; budget: tokens to take, in parts of all tokens.
    """
    known = shares.filter("_n > 0")
    total, count = known.agg(F.sum("_n"), F.count(F.lit(1))).first()
    if not total or count < 2:
        return 1.0

    def bisected(low: float, high: float, holds: str) -> tuple[float, float]:
        """holds is true from low on and false from high on."""
        for _ in range(ROUNDS):
            width = (high - low) / STEPS
            grid = known.select((F.col("_n") / total).alias("p"), F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(low + i * width).alias("t")) for i in range(1, STEPS)))).alias("x"))
            power = F.pow("p", F.col("x.t"))
            # entropy of q, and the most often that a source is read: q * budget / p
            seen = grid.groupBy(F.col("x.i").alias("i")).agg(F.sum(power).alias("z"), F.sum(power * F.ln(power)).alias("e"), F.max(power / F.col("p")).alias("r"))
            seen = seen.select("i", (F.ln("z") - F.col("e") / F.col("z")).alias("h"), (F.col("r") / F.col("z") * budget).alias("times"))
            last = seen.agg(F.max(F.when(F.expr(holds), F.col("i"))).alias("i")).first()["i"] or 0
            low, high = low + last * width, low + (last + 1) * width
        return low, high

    flat, _ = bisected(0.0, 1.0, f"h >= {target} * ln({count})")
    _, bounded = bisected(0.0, 1.0, f"times > {repeat}")
    natural = known.agg(F.sum(-F.col("_n") / total * F.ln(F.col("_n") / total))).first()[0]
    even = known.agg(F.max(F.lit(total) / F.col("_n"))).first()[0] / count * budget
    t = 1.0 if natural >= target * float(_log(count)) else flat
    return t if even <= repeat else max(t, bounded)


def _log(x: float) -> float:
    import math

    return math.log(x)


def weighted(shares: DataFrame, t: float, budget: float) -> DataFrame:
    """_source, _n, _weight, _budget (tokens to take)."""
    total, z = shares.agg(F.sum("_n"), F.sum(F.when(F.col("_n") > 0, F.pow(F.col("_n").cast("double"), F.lit(t))))).first()
    if not total:
        return shares.withColumn("_weight", F.lit(0.0)).withColumn("_budget", F.lit(0.0))
    weight = F.when(F.col("_n") > 0, F.pow(F.col("_n").cast("double"), F.lit(t)) / F.lit(z)).otherwise(0.0)
    return shares.withColumn("_weight", weight).withColumn("_budget", weight * F.lit(float(total) * budget))


def chosen(rows: DataFrame, target: float = TARGET, repeat: float = REPEAT, budget: float = 1.0, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """_id, _row, _source, _tokens, _weight, _block, _whole (epochs taken whole), _last (whether the last epoch has the row's block), _order.

    rows: _id, _row, _source, _tokens. A document is taken _whole times, and once more if _last.
    """
    shares = written(rows.groupBy("_source").agg(F.sum("_tokens").alias("_n")), "shares")
    few = shares.count() <= FEW  # else sources are many and small, and Spark may shuffle by them
    weights = weighted(shares, exponent(shares, target, repeat, budget), budget)
    # a source without tokens is taken once
    times = F.when(F.col("_n") > 0, F.col("_budget") / F.col("_n")).otherwise(1.0)
    weights = weights.withColumn("_whole", F.floor(times + 1e-9).cast("int")).withColumn("_blocks", F.ceil((F.col("_n") + 1) / block))
    placed = rows.join(F.broadcast(weights) if few else weights, "_source").withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), "_id", "_source", "_row"), "_blocks"))
    order: Column = F.xxhash64(F.lit(seed), "_source", "_whole", "_block")
    blocks = placed.groupBy("_source", "_whole", "_block", "_n", "_budget").agg(F.sum("_tokens").alias("_size")).withColumn("_order", order).withColumn("_r", F.shiftrightunsigned("_order", 56))
    ranges = blocks.groupBy("_source", "_r").agg(F.sum("_size").alias("_size"))
    before = Window.partitionBy("_source").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    starts = ranges.select("_source", "_r", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_from"))
    # unsigned order within a range is the signed one, as all share the top byte
    inside = Window.partitionBy("_source", "_r").orderBy("_order", "_block").rowsBetween(Window.unboundedPreceding, -1)
    ran = blocks.withColumn("_sum", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(starts, ["_source", "_r"])
    rest = F.col("_budget") - F.col("_whole") * F.col("_n")
    # a block is taken if at least half of it lies before the budget's end
    taken = ran.select("_source", "_block", "_order", (F.col("_from") + F.col("_sum") + F.col("_size") / 2 < rest).alias("_last"))
    return placed.join(taken, ["_source", "_block"]).select("_id", "_row", "_source", "_tokens", "_weight", F.col("_block").cast("long").alias("_block"), "_whole", "_last", "_order")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row for each time a document is taken: doc_id, source, n_tokens, weight, epoch, block, block_order."""
    rows = chosen(token_rows(docs, id_col, text_col, source_col), **how)
    each = rows.withColumn("_times", F.col("_whole") + F.col("_last").cast("int")).filter("_times > 0")
    once = each.filter("_times = 1").withColumn("epoch", F.lit(0))
    more = each.filter("_times > 1").withColumn("epoch", F.explode(F.expr("sequence(0, _times - 1)")))
    source = F.when(F.col("_source") != "", F.substring("_source", 2, 1 << 30))
    order = F.when(F.col("epoch") < F.col("_whole"), F.xxhash64(F.lit(SEED), "_source", "epoch", F.col("_block"))).otherwise(F.col("_order"))
    return once.unionByName(more).select(F.col("_id").alias("doc_id"), source.alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight"), "epoch", F.col("_block").alias("block"), order.alias("block_order"))


def token_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Narrow rows, written once: shares, blocks and choices all start from them."""
    return written(token_counts(docs, id_col, text_col, source_col), "tokens")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs, each row as often as the mixture takes it; columns as they came."""
    rows = chosen(token_rows(docs, id_col, text_col, source_col), **how)
    i, r, s, n, copy = fresh(docs, "_i", "_r", "_s", "_n", "_copy")
    times = rows.groupBy(F.col("_id").alias(i), F.col("_row").alias(r), F.col("_source").alias(s)).agg(F.max(F.col("_whole") + F.col("_last").cast("int")).alias(n)).filter(f"{n} > 0")
    named = F.coalesce(F.concat(F.lit("="), docs[source_col]), F.lit(""))
    joined = docs.join(times, docs[id_col].eqNullSafe(times[i]) & (F.xxhash64(docs[text_col]) == times[r]) & (named == times[s]))
    once = joined.filter(f"{n} = 1").select(*own(docs))
    more = joined.filter(f"{n} > 1").withColumn(copy, F.explode(F.expr(f"sequence(1, {n})"))).select(*own(docs))
    return once.unionByName(more)
