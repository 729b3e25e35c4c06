"""Joins and record linkage: cache tiers, archives, items, annotations, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import latex as X
from paperloom.functions import text as T


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def filled(c: Column) -> Column:
    """c, null where it is blank."""
    return F.when(~blank(c), c)


def cache_lookup(paras: DataFrame, cache: DataFrame, tag: str) -> DataFrame:
    """paras (page, para, fp, cache_key, translation) with found and tier.

    Own translation first, then the entry of cache_key, of page, engine tag and fingerprint, of page and fingerprint.
    Each tier is an equi join with cache (key, value); Spark broadcasts it only under its size limit.
    """
    out = paras
    keys = {"t2": F.col("cache_key"), "t3": F.concat_ws("_", "page", F.lit(tag), "fp"), "t4": F.concat_ws("_", "page", "fp")}
    for name, key in keys.items():
        # blank keys are never looked up, and are dealt by row so that they don't meet in one task
        probe = F.when((F.col("fp") != "") & (key != ""), key).otherwise(F.concat(F.lit("\u0000"), F.xxhash64("page", "para").cast("string")))
        side = cache.select(F.col("key").alias(f"_k{name}"), filled(F.col("value")).alias(name))
        out = out.withColumn("_p", probe).join(side, F.col("_p") == F.col(f"_k{name}"), "left").drop("_p", f"_k{name}")
    own = filled(F.col("translation"))
    tier = F.when(own.isNotNull(), 1).when(F.col("t2").isNotNull(), 2).when(F.col("t3").isNotNull(), 3).when(F.col("t4").isNotNull(), 4).otherwise(0)
    return out.select(*paras.columns, F.coalesce(own, "t2", "t3", "t4", F.lit("")).alias("found"), tier.alias("tier"))


def first_valid(lists: list[Column], size: Column) -> Column:
    """The first list of the given size without blank items; null if none."""
    good = lambda x: x.isNotNull() & (F.size(x) == size) & ~F.exists(x, lambda s: F.coalesce(F.trim(s), F.lit("")) == "")
    return F.get(F.filter(F.array(*lists), good), F.lit(0))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """new, its blank fields filled from old; rows only of new."""
    side = old.select(*keys, *(F.col(f).alias(f"_{f}") for f in fields))
    joined = new.join(side, keys, "left")
    return joined.select(*keys, *(F.coalesce(filled(F.col(f)), filled(F.col(f"_{f}")), F.col(f)).alias(f) for f in fields))


def item_match(papers: DataFrame, items: DataFrame) -> DataFrame:
    """paper, item, tier ("path", "name", "size"): full path, else the only item of the file name (of several the only one of the size), else the only item of the size.

    papers: paper, path, name, size; items: item, path, name, size.
    """
    def only(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("item").alias(name)).filter("_n = 1").drop("_n")

    by_path = items.groupBy("path").agg(F.min("item").alias("m1"))
    one = papers.join(by_path, "path", "left")
    named = items.groupBy("name").agg(F.count("*").alias("_c"))
    two = one.join(named, "name", "left").join(only(items, ["name"], "m2"), ["name"], "left").join(only(items, ["name", "size"], "m3"), ["name", "size"], "left").join(only(items, ["size"], "m4"), ["size"], "left")
    # several of one name, none of them alone in its size: nothing is guessed from the name, the size may still tell
    item = F.coalesce("m1", "m2", F.when(F.col("_c") > 1, F.col("m3")), "m4")
    tier = F.when(F.col("m1").isNotNull(), "path").when(F.col("m2").isNotNull() | ((F.col("_c") > 1) & F.col("m3").isNotNull()), "name").when(F.col("m4").isNotNull(), "size")
    return two.select("paper", item.alias("item"), tier.alias("tier"))


def coverage(rows: DataFrame) -> DataFrame:
    """paper and counts of pages: highlighted, translated, missing (highlighted, neither translated nor only formulas), bare (neither highlighted nor translated).

    rows: paper, page, and flags highlighted, translated, formula_only; a page has a flag if any of its rows has it. One aggregation, no joins.
    """
    flags = [F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for c, n in (("highlighted", "h"), ("translated", "t"), ("formula_only", "f"))]
    pages = rows.groupBy("paper", "page").agg(*flags)
    return pages.groupBy("paper").agg(F.count_if("h").alias("highlighted"), F.count_if("t").alias("translated"), F.count_if(F.expr("h and not t and not f")).alias("missing"), F.count_if(F.expr("not h and not t")).alias("bare"))


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; tasks send one row for each."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r")).select("_r.*")


def merged_map(old: Column, new: Column) -> Column:
    """Both maps; of a key in both the new value."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def merged_list(old: Column, new: Column, key: str) -> Column:
    """Both lists of structs, the old one first; of equal keys the first."""
    every = F.concat(old, new)
    ids = F.transform(every, lambda x: x[key])
    return F.filter(every, lambda x, i: F.array_position(ids, x[key]) == i + 1)


def identities(rows: DataFrame, name: Column, size: Column, keep: list[str], latest: Column) -> DataFrame:
    """identity_name (lower case), size and the columns keep of the latest row of each; rows of no size match nothing later."""
    return rows.groupBy(F.lower(name).alias("identity_name"), size.alias("size")).agg(F.max_by(F.struct(*keep), latest).alias("_r")).select("identity_name", "size", "_r.*")


def character_gate(latex: Column, text: Column) -> Column:
    """struct(coverage, extra, reason): the share of the text's characters that the formula shows, the share of its own that the text lacks, and why it is refused ("" for accepted).

    Texts of three characters or fewer must be met exactly. Braces and environments must be balanced, and no prose may stand in the formula.
    """
    a = X.counted_characters(latex)
    b = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""), ""), lambda c: c != "")
    count = lambda chars, c: F.size(F.filter(chars, lambda x: x == c))

    def judged(s: Column) -> Column:
        both = F.aggregate(F.array_distinct(s["b"]), F.lit(0), lambda n, c: n + F.least(count(s["a"], c), count(s["b"], c)))
        share = lambda x, n: F.when(n == 0, F.lit(0.0)).otherwise(x / n)
        return F.struct(share(both, F.size(s["b"])).alias("coverage"), share(F.size(s["a"]) - both, F.size(s["a"])).alias("extra"), F.size(s["b"]).alias("n"))

    g = F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), judged), F.lit(0))
    exact = (g["coverage"] == 1) & (g["extra"] == 0)
    reason = T.first(
        (
            (F.trim(F.coalesce(latex, F.lit(""))) == "", F.lit("empty")), (~X.balanced(latex), F.lit("unbalanced-brace")), (~X.environments_balanced(latex), F.lit("unbalanced-env")), (X.prose_within(latex), F.lit("prose-in-math")),
            (g["n"] <= 3, F.when(exact, F.lit("")).otherwise(F.lit("characters"))), (g["coverage"] < 0.7, F.lit("coverage")), (g["extra"] > 0.3, F.lit("extra")),
        ),
        F.lit(""),
    )
    return F.struct(g["coverage"].alias("coverage"), g["extra"].alias("extra"), reason.alias("reason"))


def formulas(vision: DataFrame, local: DataFrame) -> DataFrame:
    """paper, number (by page, then seq), page, kind ("block", "inline"), latex of both sides (paper, page, kind, latex, seq): a page with any of a vision model's has only those.

    Local inline ones have three characters or more; those under two characters and mere numbers and marks go; of equal ones on a page the first stays.
    """
    pages = vision.select("paper", "page").distinct()
    other = local.filter((F.col("kind") == "block") | (F.length("latex") >= 3)).join(pages, ["paper", "page"], "left_anti")
    columns = ["paper", "page", "kind", F.trim("latex").alias("latex"), "seq"]
    every = vision.select(*columns).unionByName(other.select(*columns)).filter((F.length("latex") >= 2) & ~F.col("latex").rlike(r"^[0-9.,;:()\[\]+\-]+$"))
    one = first_rows(every, ["paper", "page", "kind", "latex"], ["seq"])
    return one.withColumn("number", F.row_number().over(Window.partitionBy("paper").orderBy("page", "seq", "kind", "latex")).cast("long"))


def moved(rows: DataFrame, identity: list[str], path: str, key: str) -> DataFrame:
    """rows with other_id: the least key of the same identity under another path; only rows that have one.

    No pairs are formed and no identity is gathered: each tells the first row of its first path, and that of its first other one, and a row takes the one that isn't its own.
    """
    firsts = rows.groupBy(*identity, path).agg(F.min(key).alias("_k"))
    one = firsts.groupBy(*identity).agg(F.min_by(F.struct(path, "_k"), "_k").alias("_a"))
    two = firsts.join(one, identity).filter(F.col(path) != F.col(f"_a.{path}")).groupBy(*identity).agg(F.min_by(F.struct(path, "_k"), "_k").alias("_b"))
    best = one.join(two, identity, "left")
    other = F.when(F.col(f"_a.{path}") != F.col(path), F.col("_a._k")).when(F.col(f"_b.{path}") != F.col(path), F.col("_b._k"))
    return rows.join(best, identity).withColumn("other_id", other).filter("other_id is not null").drop("_a", "_b")


def sentence_lookup(paras: DataFrame, cache: DataFrame, tag: str) -> DataFrame:
    """paras (page, para, fp, cache_key, n, sentences) with found: of its own list and the cache's (key, sentences) by cache_key, by page, tag and fingerprint, and by page and fingerprint, the first of n items none of which is blank; null for none."""
    out = paras
    keys = {"s2": F.col("cache_key"), "s3": F.concat_ws("_", "page", F.lit(tag), "fp"), "s4": F.concat_ws("_", "page", "fp")}
    for name, key in keys.items():
        looked = F.col("cache_key") != "" if name == "s2" else F.col("fp") != ""
        probe = F.when(looked, key).otherwise(F.concat(F.lit("\u0000"), F.xxhash64("page", "para").cast("string")))
        side = cache.select(F.col("key").alias(f"_k{name}"), F.col("sentences").alias(name))
        out = out.withColumn("_p", probe).join(side, F.col("_p") == F.col(f"_k{name}"), "left").drop("_p", f"_k{name}")
    return out.withColumn("found", first_valid([F.col("sentences"), F.col("s2"), F.col("s3"), F.col("s4")], F.col("n"))).drop("s2", "s3", "s4")
