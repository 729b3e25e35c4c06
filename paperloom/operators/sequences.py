"""Order-dependent operators over rows of a group: islands, order statistics, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T


def paragraphs(lines: DataFrame) -> DataFrame:
    """doc_id, para (from 1), type, n_lines, n_chars of lines (doc_id, line_no, line).

    A line begins a paragraph after a blank line, where the type changes, at headings, captions,
    keywords and references, and after a short line that ends a sentence.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    t = T.trimmed(F.col("line"))
    rows = lines.select(
        "doc_id", "line_no", F.length("line").alias("n"), (t == "").alias("blank"), F.coalesce(T.line_type(F.col("line"), True), F.lit("body")).alias("type"),
        t.rlike(r"^\[[0-9]+\]").alias("cited"), t.rlike("[.!?。！？][\"”’)\\]]?$").alias("ended"), (F.length(t) < 60).alias("short"),
    )
    before = lambda c: F.lag(c).over(order)
    new = before("type").isNull() | before("blank") | (F.col("type") != before("type")) | F.col("type").isin("heading", "caption", "keywords") | F.col("cited") | (before("ended") & before("short"))
    marked = rows.withColumn("b", F.when(new, 1).otherwise(0)).withColumn("para", F.sum("b").over(order))
    return marked.groupBy("doc_id", "para").agg(F.min("type").alias("type"), F.count("*").alias("n_lines"), F.sum("n").alias("n_chars"))


def order_statistics(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and, for each name, the value at floor(share * n) of the sorted values, counted from 0.

    Equal values are counted first and ranks are running sums of counts, so no group's values are gathered in one row.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    up = Window.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumn("_upto", F.sum("_n").over(up)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    at = lambda q: F.least(F.floor(F.col("_all") * q), F.col("_all") - 1)
    return ranked.groupBy(*keys).agg(*(F.min(F.when(F.col("_upto") > at(q), F.col(value))).alias(n) for n, q in shares.items()))


def weighted_mode(rows: DataFrame, keys: list[str], value: Column, weight: Column, first: Column) -> DataFrame:
    """keys, mode (the value with most weight; of equal ones the first), weight."""
    sums = rows.groupBy(*keys, value.alias("mode")).agg(F.sum(weight).alias("weight"), F.min(first).alias("_first"))
    best = F.min_by(F.struct("mode", "weight"), F.struct(-F.col("weight"), "_first"))
    return sums.groupBy(*keys).agg(best.alias("_m")).select(*keys, "_m.mode", "_m.weight")


def ranges(pages: DataFrame, keys: list[str], page: str) -> DataFrame:
    """keys, ranges: runs of consecutive pages as in "1–3, 7"."""
    order = Window.partitionBy(*keys).orderBy(page)
    runs = pages.select(*keys, page).distinct().withColumn("_g", F.col(page) - F.row_number().over(order)).groupBy(*keys, "_g").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    part = F.struct("a", F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("–", "a", "b")).alias("s"))
    return runs.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("_p")).select(*keys, F.array_join(F.transform("_p", lambda x: x["s"]), ", ").alias("ranges"))


def last_rows(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def same_runs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """rows with run: a number that rises where value changes."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return rows.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w)).drop("_c")


def history(turns: DataFrame, keep: int, chars: int) -> DataFrame:
    """conv_id, run, role, text: chat history fit for a model.

    Only user and model turns; leading model turns go; runs of one role are one turn; the
    last keep turns, each cut at chars characters.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.filter(F.col("role").isin("user", "assistant"))
    begun = rows.withColumn("_u", F.max(F.when(F.col("role") == "user", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_u = 1")
    runs = same_runs(begun, ["conv_id"], "turn", "role").groupBy("conv_id", "run", "role").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    texts = runs.select("conv_id", "run", "role", F.left(F.array_join(F.transform("t", lambda x: x["text"]), "\n"), F.lit(chars)).alias("text"))
    return last_rows(texts, ["conv_id"], "run", keep)
