"""Order and continuity of paragraphs: joins over columns and pages, tables without rules, figure blocks, audits, edits by a vision model.

paras: paper, page, seq (reading order within the page), section ("full", "left", "right"), type, text[, x, y, ...].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

#: How many characters of a paragraph's end go with the next page.
TAIL = 240


def unfinished(text: Column) -> Column:
    """No mark of a sentence's end at the end."""
    return ~T.trimmed(text).rlike("[.!?。！？:：][\"”’)\\]]?$")


def goes_on(text: Column) -> Column:
    return T.trimmed(text).rlike("^[a-z]")


def _glued(text: Column, joined: Column) -> Column:
    """A piece as it stands before the next one: a hyphen at a broken word goes, else a space follows."""
    t = T.trimmed(text)
    return F.when(~joined, t).when(t.rlike("[A-Za-z]-$"), F.left(t, F.length(t) - 1)).otherwise(F.concat(t, F.lit(" ")))


def over_columns(paras: DataFrame) -> DataFrame:
    """paper, page, para, n, text: body paragraphs of a page, those joined that break off at the end of the left column and go on in the right one."""
    body = paras.filter("type = 'body'")
    w = Window.partitionBy("paper", "page").orderBy("seq")
    before = lambda c: F.lag(c).over(w)
    on = (before("section") == "left") & (F.col("section") == "right") & unfinished(before("text")) & goes_on(F.col("text"))
    rows = body.withColumn("_on", F.coalesce(on, F.lit(False))).withColumn("para", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w)).withColumn("_next", F.coalesce(F.lead("_on").over(w), F.lit(False)))
    parts = F.array_sort(F.collect_list(F.struct("seq", _glued(F.col("text"), F.col("_next")).alias("s"))))
    return rows.groupBy("paper", "page", "para").agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda x: x["s"]), "").alias("text"))


def over_pages(paras: DataFrame) -> DataFrame:
    """paper, page, head, tail: pages whose first body paragraph (head) goes on with the last one of the page before (tail, at most TAIL characters).

    Not where that page is not the one before, where a heading comes first, or where the last paragraph ends a sentence or is very short.
    """
    ends = paras.filter("type in ('body', 'heading')").groupBy("paper", "page").agg(
        F.min_by(F.struct("type", "text"), "seq").alias("first"), F.max_by("text", F.when(F.col("type") == "body", F.col("seq")).otherwise(-1)).alias("last"), F.max(F.when(F.col("type") == "body", 1).otherwise(0)).alias("some")
    )
    w = Window.partitionBy("paper").orderBy("page")
    rows = ends.withColumn("_tail", F.lag(F.when(F.col("some") == 1, F.col("last"))).over(w)).withColumn("_page", F.lag("page").over(w))
    on = (F.col("page") == F.col("_page") + 1) & (F.col("first.type") == "body") & goes_on(F.col("first.text")) & unfinished(F.col("_tail")) & (F.length(T.trimmed(F.col("_tail"))) >= 3)
    return rows.filter(on).select("paper", "page", F.col("first.text").alias("head"), F.right(T.trimmed(F.col("_tail")), F.lit(TAIL)).alias("tail"))


def tables_without_rules(lines: DataFrame, width: int = 4, least: int = 3) -> DataFrame:
    """lines (paper, page, line_no, x, cells array<string>) of tables: runs of at least so many lines that begin at one x and whose cells are mostly numbers.

    A number in parentheses is an equation's and doesn't count.
    """
    number = lambda c: F.trim(c).rlike(r"^[-+−]?[0-9][0-9.,]*%?$")
    numeric = (F.size("cells") >= 2) & (F.size(F.filter("cells", number)) * 2 >= F.size("cells"))
    rows = lines.withColumn("_c", numeric).withColumn("_x", F.floor(F.col("x") / width))
    w = Window.partitionBy("paper", "page").orderBy("line_no")
    new = F.when(F.col("_c") & F.coalesce(F.lag("_c").over(w) & (F.lag("_x").over(w) == F.col("_x")) & (F.lag("line_no").over(w) == F.col("line_no") - 1), F.lit(False)), 0).otherwise(1)
    runs = rows.withColumn("_n", new).withColumn("_run", F.sum("_n").over(w)).filter("_c")
    size = Window.partitionBy("paper", "page", "_run")
    return runs.withColumn("n", F.count("*").over(size)).filter(F.col("n") >= least).select("paper", "page", "line_no", F.col("_run").alias("run"), "n")


def figure_blocks(blocks: DataFrame, gap: float = 30.0) -> DataFrame:
    """blocks (paper, page, section, seq, y_top, y_bottom) of figures with unit, its number from the top of its column, and place in it: blocks at most gap points apart are one unit."""
    w = Window.partitionBy("paper", "page", "section").orderBy(F.desc("y_top"), "seq")
    low = F.min("y_bottom").over(w.rowsBetween(Window.unboundedPreceding, -1))
    units = blocks.withColumn("_n", F.when(low - F.col("y_top") <= gap, 0).otherwise(1)).withColumn("unit", F.sum("_n").over(w)).drop("_n")
    return units.withColumn("place", F.row_number().over(Window.partitionBy("paper", "page", "section", "unit").orderBy(F.desc("y_top"), "seq")))


def order_audit(paras: DataFrame) -> DataFrame:
    """paper, page and violations of reading order: inverted (left body after right body), scattered (units of figures in several runs), broken (an unfinished body paragraph before one that neither goes on with it nor is of its type)."""
    w = Window.partitionBy("paper", "page").orderBy("seq")
    before = lambda c: F.lag(c).over(w)
    seen = F.max(F.when((F.col("type") == "body") & (F.col("section") == "right"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    inverted = (F.col("type") == "body") & (F.col("section") == "left") & (seen == 1)
    new_run = F.col("unit").isNotNull() & ~F.col("unit").eqNullSafe(before("unit"))
    broken = (before("type") == "body") & unfinished(before("text")) & (F.col("type") != "body") & ~goes_on(F.col("text"))
    rows = paras.select("paper", "page", F.coalesce(inverted, F.lit(False)).alias("inverted"), F.when(new_run, F.col("unit")).alias("run"), F.coalesce(broken, F.lit(False)).alias("broken"))
    return rows.groupBy("paper", "page").agg(F.count_if("inverted").alias("inverted"), (F.count("run") - F.count_distinct("run")).alias("scattered"), F.count_if("broken").alias("broken"))


#: What a vision model may call a segment and ask to do with it.
TYPES = "figure table figure_caption caption body heading formula formula_inline header footer reference page_number noise title abstract keywords metadata footnote significance".split()
ACTIONS = "keep merge_next split drop".split()
SEGMENT = "struct<i:string,index:string,type:string,order:string,group:string,action:string,why:string,latex:string,parts:array<struct<type:string,at:string,latex:string>>,splitAt:array<string>,inline:array<struct<find:string,latex:string>>>"


def vision_segments(replies: DataFrame, reply: str, expected: str) -> DataFrame:
    """replies with a row for each segment of the JSON in reply: index, type, order, group, action, why, latex, parts, split_at, inline.

    Without any index the place in the list counts, if there are as many as expected; else nothing is guessed. Unknown types are body,
    unknown actions keep; groups are positive whole numbers; texts are cut; parts are two at least; inline formulas at most eight.
    """
    body = F.regexp_replace(F.regexp_replace(T.trimmed(F.col(reply)), r"(?i)^```(?:json)?\s*", ""), r"```\s*$", "")
    rows = replies.withColumn("_s", F.try_variant_get(F.try_parse_json(body), "$.segments", f"array<{SEGMENT}>")).filter("size(_s) > 0")
    number = lambda c: F.when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), c.cast("double"))
    explicit = lambda s: number(F.coalesce(s["i"], s["index"]))
    any_index = F.exists("_s", lambda s: explicit(s).isNotNull())
    one = rows.withColumn("_place", ~any_index & (F.size("_s") == F.col(expected))).select(*replies.columns, "_place", F.posexplode("_s").alias("_at", "s"))
    s = F.col("s")
    cut = lambda c, n: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.left(F.trim(c), F.lit(n)))
    known = lambda c, names, other: F.when(F.coalesce(c, F.lit("")).isin(*names), c).otherwise(F.lit(other))
    parts = F.transform(F.filter(s["parts"], lambda p: p.isNotNull()), lambda p: F.struct(known(p["type"], TYPES, "body").alias("type"), cut(p["at"], 200).alias("at"), cut(p["latex"], 600).alias("latex")))
    inline = F.filter(F.transform(s["inline"], lambda p: F.struct(cut(p["find"], 120).alias("find"), cut(p["latex"], 600).alias("latex"))), lambda p: (F.length(p["find"]) >= 2) & p["latex"].isNotNull())
    index = F.coalesce(explicit(s), F.when(F.col("_place"), F.col("_at").cast("double")))
    group = number(s["group"])
    return one.filter(index.isNotNull()).select(
        *replies.columns, index.cast("long").alias("index"), known(s["type"], TYPES, "body").alias("type"), number(s["order"]).alias("order"), F.when((group > 0) & (group == F.floor(group)), group.cast("long")).alias("group"), known(s["action"], ACTIONS, "keep").alias("action"), F.left(s["why"], F.lit(60)).alias("why"),
        cut(s["latex"], 600).alias("latex"), F.when(F.size(parts) >= 2, parts).alias("parts"), F.filter(F.transform(s["splitAt"], lambda t: cut(t, 200)), lambda t: t.isNotNull()).alias("split_at"), F.when(F.size(inline) > 0, F.slice(inline, 1, 8)).alias("inline"),
    )


def edited(segments: DataFrame) -> DataFrame:
    """segments (paper, page, seq, text, type, action, split_at string) after a vision model's edits: paper, page, para, type, text.

    Dropped ones go; one to be merged is joined with the next that stays; one to be split is cut where the text of split_at begins.
    """
    kept = segments.filter("action <> 'drop'")
    w = Window.partitionBy("paper", "page").orderBy("seq")
    merged = kept.withColumn("_on", F.coalesce(F.lag("action").over(w) == "merge_next", F.lit(False))).withColumn("_run", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w)).withColumn("_next", F.coalesce(F.lead("_on").over(w), F.lit(False)))
    parts = F.array_sort(F.collect_list(F.struct("seq", _glued(F.col("text"), F.col("_next")).alias("s"))))
    whole = merged.groupBy("paper", "page", "_run").agg(F.min("seq").alias("seq"), F.min_by("type", "seq").alias("type"), F.max_by(F.when(F.col("action") == "split", F.col("split_at")), "seq").alias("at"), F.array_join(F.transform(parts, lambda x: x["s"]), "").alias("text"))
    cut = F.when(F.coalesce(F.col("at"), F.lit("")) != "", F.instr(F.col("text"), F.col("at"))).otherwise(0)
    pieces = F.when(F.col("_cut") > 1, F.array(F.trim(F.left("text", F.col("_cut") - 1)), F.trim(F.expr("substring(text, _cut)")))).otherwise(F.array("text"))
    rows = whole.withColumn("_cut", cut).select("paper", "page", "seq", "type", F.posexplode(pieces).alias("_p", "text"))
    return rows.withColumn("para", F.row_number().over(Window.partitionBy("paper", "page").orderBy("seq", "_p"))).select("paper", "page", "para", "type", "text")


def regrouped(segments: DataFrame) -> DataFrame:
    """segments (paper, page, seq, order, group) with place, from 1: in a vision model's order (seq where it gives none), those of one group together where the first of them stands."""
    own = F.struct(F.coalesce(F.col("order"), F.col("seq").cast("double")).alias("o"), F.col("seq").alias("s"))
    rows = segments.withColumn("_own", own)
    first = F.min("_own").over(Window.partitionBy("paper", "page", "group"))
    rows = rows.withColumn("_head", F.when(F.col("group").isNull(), F.col("_own")).otherwise(first))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("paper", "page").orderBy("_head", "_own"))).drop("_own", "_head")


def first_sentences(marks: DataFrame, sentences: DataFrame) -> DataFrame:
    """marks (paper, para, id, text) with pos: the first sentence (paper, para, pos, sentence) that lies in the mark's text, or that holds its first 40 characters; null for none."""
    fold = lambda c: T.folded(F.col(c))
    m = marks.withColumn("_t", fold("text"))
    s = sentences.select("paper", "para", "pos", fold("sentence").alias("_s")).filter("_s <> ''")
    # the paragraph is the key, and a paragraph has few sentences
    hits = m.filter("_t <> ''").join(s, ["paper", "para"]).filter(F.contains("_t", "_s") | F.contains("_s", F.left("_t", F.lit(40))))
    best = hits.groupBy("paper", "para", "id").agg(F.min("pos").alias("pos"))
    return m.drop("_t").join(best, ["paper", "para", "id"], "left")


def within(spans: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """spans (keys, start, end) with the outer spans (keys, pos, start, end) that hold them whole."""
    o = outer.select(*keys, "pos", F.col("start").alias("_a"), F.col("end").alias("_b"))
    return spans.filter("end > start").join(o, keys).filter("start >= _a and end <= _b").drop("_a", "_b")
