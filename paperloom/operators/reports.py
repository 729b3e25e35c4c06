"""Reports over archived paragraphs: appendix pages, coverage, counts, Markdown, library annotations.

paras: paper, page, id, type, text, translation; notes: paper, page, para, id, colour; questions: paper, page, id, selected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from paperloom.functions import library as L

#: Types of paragraphs that reports leave out.
HIDDEN = ("figure-label", "noise")
SELECTED = 40
#: Characters by which selections are looked up, and how many of a page are still looked for one by one.
HEAD, FEW = 16, 64


def shown(paras: DataFrame) -> DataFrame:
    return paras.filter(~F.col("type").isin(*HIDDEN))


def sound_pages(paras: DataFrame) -> DataFrame:
    """paras without pages on which a long formula holds two equation numbers."""
    bad = paras.filter((F.col("type") == "formula") & (F.length("text") > 250) & F.col("text").rlike(r"(?s)\([0-9]+\).*\([0-9]+\)"))
    return paras.join(bad.select("paper", "page").distinct(), ["paper", "page"], "left_anti")


def _places(texts: list[str], selections: list[str]) -> dict[str, list[int]]:
    """For each selection the numbers of the texts that hold it. Many long ones are looked up by their beginnings at each place of a text; the others are looked for in each."""
    found: dict[str, list[int]] = {s: [] for s in selections}
    long = [s for s in selections if len(s) >= HEAD]
    long = long if len(long) > FEW else []
    heads: dict[str, list[str]] = {}
    for s in long:
        heads.setdefault(s[:HEAD], []).append(s)
    rest = [s for s in selections if s[:HEAD] not in heads]
    for n, t in enumerate(texts):
        if heads:
            for i in range(len(t) - HEAD + 1):
                for s in heads.get(t[i : i + HEAD], ()):
                    if t.startswith(s, i) and found[s][-1:] != [n]:
                        found[s].append(n)
        for s in rest:
            if s in t:
                found[s].append(n)
    return found


def _met(rows: list[tuple], counted: bool) -> Iterator[tuple]:
    """id and para of a page's rows (id, para, text, question); counted: id, number of paragraphs and the first."""
    holders: dict[str, set] = {}
    asks: dict[str, set] = {}
    for one, para, text, question in rows:
        if question:
            asks.setdefault(text, set()).add(one)
        else:
            holders.setdefault(text, set()).add(para)
    paras = list(holders.values())
    places = _places(list(holders), list(asks))
    own: dict = {}
    for s, ids in asks.items():
        for one in ids:
            own.setdefault(one, []).append(s)
    once = sum(map(len, paras)) == len(set().union(*paras))
    first = [min((p for p in ps if p is not None), default=None) for ps in paras]
    for one, selections in own.items():
        at = set().union(*(places[s] for s in selections))
        if not at:
            continue
        if counted:
            n = sum(len(paras[k]) for k in at) if once else len(set().union(*(paras[k] for k in at)))
            yield one, n, min((first[k] for k in at if first[k] is not None), default=None)
        else:
            yield from ((one, p) for p in set().union(*(paras[k] for k in at)))


def _asked(paras: DataFrame, questions: DataFrame, counted: bool) -> DataFrame:
    """Texts and selections meet in the task that holds their page, so nothing but they is shuffled, once; equal texts and equal selections of a page are compared once."""
    kind = {f.name: f.dataType for f in paras.schema} | {"ask": questions.schema["id"].dataType}
    t = paras.select("paper", "page", F.lit(None).cast(kind["ask"]).alias("id"), F.col("id").alias("para"), F.trim("text").alias("text"), F.lit(False).alias("question"))
    q = questions.select("paper", "page", "id", F.lit(None).cast(kind["id"]).alias("para"), F.left("selected", F.lit(SELECTED)).alias("text"), F.lit(True).alias("question"))
    rows = t.unionByName(q).filter("length(text) > 0 and paper is not null and page is not null")
    dealt = rows.withColumn("place", F.row_number().over(Window.partitionBy("paper", "page").orderBy("question")))
    fields = [("paper", kind["paper"]), ("page", kind["page"]), ("id", kind["ask"]), *([("n", S.LongType())] if counted else []), ("para", kind["id"])]
    schema = S.StructType([S.StructField(n, k) for n, k in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out, types = None, [], [], None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for n, c in zip(schema.names, zip(*out, strict=True), strict=True)], names=schema.names)

        for b in batches:
            types = {n: pa.int64() if n == "n" else b.schema.field(n).type for n in schema.names}
            for *page, one, para, text, question in zip(*(b[c].to_pylist() for c in ("paper", "page", "id", "para", "text", "question")), strict=True):
                if page != key:
                    for row in _met(held, counted):
                        out.append((*key, *row))
                        if len(out) >= 10_000:
                            yield batch()
                            out.clear()
                    key, held = page, []
                held.append((one, para, text, question))
        for row in _met(held, counted):
            out.append((*key, *row))
            if len(out) >= 10_000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return dealt.mapInArrow(run, schema)


def asked(paras: DataFrame, questions: DataFrame) -> DataFrame:
    """paper, page, id of questions, para: paragraphs of the page that hold the beginning of the selection. Repeated lines make many pairs; `answers` counts them."""
    return _asked(paras, questions, False)


def answers(paras: DataFrame, questions: DataFrame) -> DataFrame:
    """paper, page, id of questions, n: how many paragraphs of the page hold the beginning of the selection, para: the first; those that some hold."""
    return _asked(paras, questions, True)


def appendix(paras: DataFrame, notes: DataFrame, questions: DataFrame) -> DataFrame:
    """paper, page and counts: entries, translated, noted (entries with notes), orphan_notes, questions, orphan_questions; only pages with any content."""
    entries = shown(paras)
    found = answers(entries, questions).select("paper", "page", "id", F.lit(True).alias("_hit"))
    keys = entries.select("paper", "page", F.col("id").alias("para")).withColumn("_entry", F.lit(True))
    e = entries.groupBy("paper", "page").agg(F.count("*").alias("entries"), F.count_if(F.col("translation") != "").alias("translated"))
    n = notes.join(keys, ["paper", "page", "para"], "left").groupBy("paper", "page").agg(F.count_if(F.col("_entry")).alias("notes"), F.count_if(F.col("_entry").isNull()).alias("orphan_notes"), F.count_distinct(F.when(F.col("_entry"), F.col("para"))).alias("noted"))
    q = questions.join(found, ["paper", "page", "id"], "left").groupBy("paper", "page").agg(F.count_if(F.col("_hit")).alias("questions"), F.count_if(F.col("_hit").isNull()).alias("orphan_questions"))
    pages = paras.select("paper", "page").distinct()
    every = pages.join(e, ["paper", "page"], "left").join(n, ["paper", "page"], "left").join(q, ["paper", "page"], "left").fillna(0)
    return every.filter("translated + notes + orphan_notes + questions + orphan_questions > 0").drop("notes")


def coverage_sheets(paras: DataFrame, notes: DataFrame) -> DataFrame:
    """paper, numbers of pages (all, highlighted, translated, formula_only, missing) and no_sheet: ranges of pages that have neither notes nor translations."""
    flags = paras.select("paper", "page", (~F.col("type").isin(*HIDDEN) & (F.col("translation") != "")).alias("t"), (F.col("type") == "formula").alias("f"), F.lit(False).alias("h"), F.lit(True).alias("p"))
    noted = notes.select("paper", "page", F.lit(False).alias("t"), F.lit(None).cast("boolean").alias("f"), F.lit(True).alias("h"), F.lit(False).alias("p"))
    # one aggregation of flags instead of joins of distinct pages
    pages = flags.unionByName(noted).groupBy("paper", "page").agg(F.bool_or("t").alias("t"), F.bool_and("f").alias("f"), F.bool_or("h").alias("h"), F.bool_or("p").alias("p")).filter("p")
    counts = pages.groupBy("paper").agg(F.count("*").alias("pages"), F.count_if(F.col("h")).alias("highlighted"), F.count_if(F.col("t")).alias("translated"), F.count_if(F.expr("h and f and not t")).alias("formula_only"), F.count_if(F.expr("h and not t and not f")).alias("missing"), F.array_sort(F.collect_list(F.when(F.expr("not h and not t"), F.col("page")))).alias("_none"))
    listed = F.array_join(F.transform("_none", lambda p: p.cast("string")), ", ")
    return counts.select("paper", "pages", "highlighted", "translated", "formula_only", "missing", F.when(F.size("_none") > 0, listed).alias("no_sheet"))


def sheet_counts(paras: DataFrame) -> DataFrame:
    """Translated paragraphs of each page, and formulas that need no translation."""
    return shown(paras).groupBy("paper", "page").agg(F.count_if(F.col("translation") != "").alias("translated"), F.count_if((F.col("translation") == "") & (F.col("type") == "formula")).alias("formula_only"))


def summary(paras: DataFrame) -> DataFrame:
    tokens = F.size(F.regexp_extract_all("text", F.lit("⟦M[0-9]+⟧"), F.lit(0)))
    return paras.groupBy("paper").agg(F.count("*").alias("paragraphs"), F.count_if(F.col("type") == "body").alias("body"), F.count_if(F.col("type") == "formula").alias("formulas"), F.sum(tokens).alias("inline_tokens"))


def averages(calls: DataFrame, key: str, ms: str) -> DataFrame:
    return calls.groupBy(key).agg(F.count(ms).alias("n"), F.avg(ms).alias("mean_ms"))


def markdown(paras: DataFrame, notes: DataFrame) -> DataFrame:
    """paper, markdown: a head, links to the pages, and for each page its paragraphs with translations and notes; formulas as display mathematics."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["s"]), "\n")
    own = notes.groupBy("paper", "page", F.col("para").alias("id")).agg(joined(F.struct("id", F.concat(F.lit("- note ("), "colour", F.lit(")")).alias("s"))).alias("notes"))
    rows = shown(paras).join(own, ["paper", "page", "id"], "left")
    text = F.when(F.col("type") == "heading", F.concat(F.lit("### "), "text")).when(F.col("type") == "formula", F.concat(F.lit("$$\n"), "text", F.lit("\n$$"))).otherwise(F.concat(F.lit("> "), "text"))
    part = F.concat_ws("\n\n", text, F.when(F.col("translation") != "", F.concat(F.lit("> "), "translation")), "notes")
    parts = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["s"]), "\n\n")
    pages = rows.groupBy("paper", "page").agg(parts(F.struct("id", part.alias("s"))).alias("body"))
    page = F.col("page").cast("string")
    link = F.struct("page", F.concat(F.lit("- [page "), page, F.lit("](#page-"), page, F.lit(")")).alias("s"))
    whole = pages.groupBy("paper").agg(F.count("*").alias("k"), joined(link).alias("toc"), parts(F.struct("page", F.concat(F.lit("## page "), page, F.lit("\n\n"), "body").alias("s"))).alias("whole"))
    head = F.concat(F.lit('---\ntitle: "'), F.col("paper").cast("string"), F.lit('"\npages: '), F.col("k").cast("string"), F.lit("\n---"))
    return whole.select("paper", F.concat(F.concat_ws("\n\n", head, "toc", "whole"), F.lit("\n")).alias("markdown"))


def write_markdown(papers: DataFrame, folder: str) -> None:
    """One text file row for each paper (paper, markdown), in folders by paper."""
    papers.select(F.col("paper").cast("string").alias("paper"), F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("paper").text(folder)


def annotation_rows(annotations: DataFrame, labels: DataFrame, heights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """annotations (position in JSON, label, text, comment, kind) with page and boxes (top-down); without those of no page or of no box.

    labels: label_index, label; heights: page, height. by: columns that name the document in all three; without any they are of one document.
    """
    at = annotations.withColumn("_p", F.from_json("position", L.POSITION)).filter("_p.rects is not null").withColumn("label", F.trim("label"))
    paged = at.join(labels, [*by, "label"], "left").withColumn("page", F.coalesce("_p.pageIndex", "label_index") + 1).filter("page >= 1")
    boxed = paged.join(heights.filter("height > 0"), [*by, "page"]).withColumn("boxes", L.annotation_boxes(F.col("_p"), F.col("height"))).filter("size(boxes) > 0")
    return boxed.withColumn("text", L.annotation_text(F.col("text"), F.col("comment"), F.col("kind"))).drop("_p", "label_index", "height")
