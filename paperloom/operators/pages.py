"""One path from text items to paragraphs: glyphs of items, those that count, lines, paragraphs with a map of their characters, segments, tokens, boxes to cut out.

A page's glyphs are made by Column functions (one row for each part of an item), filtered and joined as tables; then pages are dealt to tasks and
solved one after another, as in `layout`. A paragraph's text is put together with its map, in step: every character knows the glyph and the place in it that it comes from,
or that it was put between two glyphs. Segments and tokens are places in that text, so nothing is looked for in it again.

Defined results: items without text, and null ones, make no glyph; a page without glyphs has no rows; ties of places go by item; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import glyphs as G
from paperloom.operators import formula, layout
from paperloom.operators.layout import Item, Line

PLACES = 100_000  # of the parts of an item: a glyph's number is item * PLACES + part

# Glyphs


def page_glyphs(items: DataFrame) -> DataFrame:
    """Glyphs of items (paper_id, page, item_idx, str, font, transform array<double>, width, height, page_w, page_h): decoded parts with their boxes and properties.

    paper, page, seq, item, raw, text, latex, font, role, italic, bold, rotated, math_font, math, large, tall, accent, radical, piece, x, y, w, h, size, top, bottom, body, page_w, page_h.
    """
    at = lambda i: F.coalesce(F.get("transform", F.lit(i)), F.lit(0.0))
    a, b, c, d = map(at, range(4))
    sized = items.filter("str is not null").withColumn("size", F.coalesce(F.nullif(F.hypot(c, d), F.lit(0.0)), F.nullif(F.hypot(a, b), F.lit(0.0)), F.nullif("height", F.lit(0.0)), F.lit(10.0)))
    named = sized.withColumn("name", G.without_subset(F.col("font"))).withColumn("face", G.font(F.col("font")))
    words = named.filter("length(trim(str)) >= 3")
    # a row for each page, which a small file of few columns may make look small enough to be broadcast: it grows with the input, so it is never sent to the driver
    known = named.join(_page_fonts(words).hint("merge"), ["paper_id", "page"], "left").fillna({"body": 10.0, "main": ""})
    whole = F.greatest(F.lit(0.0), F.coalesce(F.nullif("width", F.lit(0.0)), F.length("str") * F.col("size") * 0.48))
    cut = known.select("*", whole.alias("whole"), (F.abs(b) > F.abs(a) * 0.45).alias("r1"), (F.abs(c) > F.abs(d) * 0.45).alias("r2"), G.parts(F.col("str"), F.col("face.role")).alias("_parts"))
    counted = cut.select("*", F.size("_parts").alias("n"), F.exists("_parts", lambda p: p["word"]).alias("named"))
    parts = counted.select("*", F.posexplode("_parts").alias("part", "p")).drop("_parts")
    read = parts.withColumn("g", G.decoded("p.str", "font"))
    big = F.col("g.tall") | F.col("g.large")
    single, word = (F.col("n") > 1) & ~F.col("named"), F.col("p.word")
    size, height = F.col("size"), F.greatest(F.col("size") * 0.85, F.coalesce(F.nullif("height", F.lit(0.0)), F.col("size")))
    up = F.when(F.col("n") == 1, F.when(big, F.greatest(height * 0.85, size * 0.9)).otherwise(height * 0.82)).otherwise(F.when(big & single, size * 0.9).otherwise(size * 0.82))
    down = F.when(F.col("n") == 1, F.when(big, F.greatest(height * 0.55, size * 0.35)).otherwise(height * 0.24)).otherwise(F.when(big & single, size * 0.55).otherwise(size * 0.24))
    flags = G.math_flags(F.col("g.text"), F.col("face"), F.col("font"), F.col("main"))
    y = at(5)
    return read.select(
        F.col("paper_id").alias("paper"), "page", (F.col("item_idx") * PLACES + F.col("part")).alias("seq"), F.col("item_idx").alias("item"), F.col("p.str").alias("raw"), F.col("g.text").alias("text"),
        F.when(word, F.concat(F.lit("\\"), F.lower("p.str"))).otherwise(F.col("g.latex")).alias("latex"), F.col("name").alias("font"), F.col("face.role").alias("role"), F.col("face.italic").alias("italic"), F.col("face.bold").alias("bold"), (F.col("r1") & F.col("r2")).alias("rotated"),
        (flags["font"] | word).alias("math_font"), (flags["token"] | word | F.col("g.mathematical") | big | F.col("g.radical")).alias("math"), *(F.col(f"g.{k}").alias(k) for k in ("large", "tall", "accent", "radical", "piece")),
        (at(4) + F.col("whole") * F.col("p.before")).alias("x"), y.alias("y"), (F.col("whole") * F.col("p.share")).alias("w"), height.alias("h"), "size", (y + up).alias("top"), (y - down).alias("bottom"), "body", "page_w", "page_h",
    )


def _page_fonts(words: DataFrame) -> DataFrame:
    """paper_id, page, body (as `layout.body_sizes`) and main, the font with most characters in items that hold a word; one row of a page's sizes and fonts tells both."""
    n, size = F.length(F.trim("str")), F.col("size")
    worded = F.col("str").rlike("[A-Za-z]{3,}|[一-鿿]{2,}")
    sums = words.groupBy("paper_id", "page", F.when(size.between(6, 18), F.floor(size * 2 + 0.5) / 2).alias("half"), "name").agg(
        F.sum(n).alias("n"), F.min("item_idx").alias("first"), F.sum(F.when(worded, n)).alias("m"), F.min(F.when(worded, F.col("item_idx"))).alias("mfirst")
    )
    rows = sums.groupBy("paper_id", "page").agg(F.collect_list(F.struct("half", "name", "n", "first", "m", "mfirst")).alias("rows"))

    def mode(rows: Column, value: str, weight: str, first: str) -> Column:
        def one(v: Column) -> Column:
            own = F.filter(rows, lambda r: r[value].eqNullSafe(v))
            return F.struct(-F.aggregate(own, F.lit(0).cast("long"), lambda s, r: s + r[weight]), F.array_min(F.transform(own, lambda r: r[first])), v.alias("v"))

        return F.array_min(F.transform(F.array_distinct(F.transform(rows, lambda r: r[value])), one))["v"]

    half = mode(F.filter("rows", lambda r: r["half"].isNotNull()), "half", "n", "first")
    return rows.select("paper_id", "page", F.when(half.isNotNull(), F.greatest(F.lit(7.0), F.least(F.lit(14.0), half))).alias("body"), mode(F.filter("rows", lambda r: r["m"].isNotNull()), "name", "m", "mfirst").alias("main"))


# Texts with maps


@dataclass(slots=True)
class Text:
    """A text and, for each of its characters, the number of its glyph and the place in the glyph's text; -1 for what was put between glyphs."""

    chars: list[str] = field(default_factory=list)
    glyphs: list[int] = field(default_factory=list)
    places: list[int] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.chars)

    def last(self) -> str:
        return self.chars[-1] if self.chars else ""

    def add(self, text: str, glyph: int) -> None:
        self.chars += text
        self.glyphs += [glyph] * len(text)
        self.places += range(len(text))

    def space(self) -> None:
        if self.chars and not self.chars[-1].isspace():
            self.chars.append(" ")
            self.glyphs.append(-1)
            self.places.append(-1)

    def cut(self, n: int) -> None:
        """Without all but the first n characters."""
        del self.chars[n:], self.glyphs[n:], self.places[n:]

    def hyphen_gone(self) -> bool:
        """Without a hyphen at the end that follows a letter."""
        gone = len(self.chars) > 1 and self.chars[-1] in "-‐" and self.chars[-2].isascii() and self.chars[-2].isalpha()
        if gone:
            self.cut(len(self.chars) - 1)
        return gone

    def trimmed(self) -> int:
        """Without white space at both ends; how many characters went from the beginning."""
        n = len(self.chars)
        while n and self.chars[n - 1].isspace():
            n -= 1
        self.cut(n)
        lead = next((i for i, c in enumerate(self.chars) if not c.isspace()), 0)
        del self.chars[:lead], self.glyphs[:lead], self.places[:lead]
        return lead

    def __str__(self) -> str:
        return "".join(self.chars)


@dataclass(slots=True)
class Segment:
    """Characters start to end of a paragraph's text: prose, or mathematics with its LaTeX."""

    math: bool
    start: int
    end: int
    latex: str = ""


# Shares of the body size from which a gap is a space: in prose, before mathematics, within it; and up to which mathematics goes on over a gap.
PROSE_GAP, BEFORE_MATH, IN_MATH, RUN_GAP, SCRIPT_GAP, SIGN_GAP = 0.10, 0.11, 0.22, 0.85, 0.45, 0.65
_CJK = re.compile("[一-鿿　-〿＀-￯]")
_SCRIPT, _SIGNS, _TRIVIAL = re.compile(r"[A-Za-z0-9+\-−(),′']+"), re.compile(r"[0-9(),+\-−=/|]+"), re.compile(r"[,.;:()\[\]0-9+\-]+")
NO_SPACE_BEFORE, NO_SPACE_AFTER, NONE_BEFORE_MATH = frozenset(",.;:!?’”')]"), frozenset("“'(["), frozenset("([“\"'")


def runs(line: Line, body: float) -> Iterator[tuple[bool, list[Item]]]:
    """A line's items as single ones of prose and runs of mathematics; small raised or lowered letters and bare signs close by go with a run."""
    items = sorted(line.items, key=lambda i: (i.x, i.idx))
    level = sum(i.y for i in items) / len(items)
    at = 0
    while at < len(items):
        run = [items[at]]
        at += 1
        while run[0].math and at < len(items):
            i, gap = items[at], items[at].x - run[-1].right
            text = i.text.strip()
            script = gap <= SCRIPT_GAP * body and (abs(i.y - level) >= 0.16 * body or i.h <= 0.86 * body) and _SCRIPT.fullmatch(text)
            if not (gap <= RUN_GAP * body and (i.math or script or (gap <= SIGN_GAP * body and _SIGNS.fullmatch(text)))):
                break
            run.append(i)
            at += 1
        yield run[0].math, run


def spelt(lines: list[Line], bars: list[formula.Bar], body: float) -> tuple[Text, list[Segment]]:
    """A paragraph's text and its segments."""
    text, parts = Text(), []
    for n, line in enumerate(lines):
        before: Item | None = None
        for math, run in runs(line, body):
            first, head = run[0], run[0].text[:1]
            joined = False
            if before is None and n:
                joined = "a" <= head <= "z" and text.hyphen_gone()
                if joined and parts and parts[-1].end > len(text):
                    parts[-1].end = len(text)
                if not joined and not (_CJK.match(text.last()) and _CJK.match(head)):
                    text.space()
            elif before is not None:
                gap, last = first.x - before.right, text.last()
                if math:
                    apart = gap >= BEFORE_MATH * body and last not in NONE_BEFORE_MATH and not _CJK.match(last)
                else:
                    apart = gap >= PROSE_GAP * body and head not in NO_SPACE_BEFORE and last not in NO_SPACE_AFTER and not (_CJK.match(last) and _CJK.match(head))
                if last and apart:
                    text.space()
            start = len(text)
            for k, i in enumerate(run):
                if k and i.x - run[k - 1].right >= IN_MATH * body:
                    text.space()
                text.add(i.text, i.idx)
            if math:
                own = [b for b in bars if b.x1 >= first.x - 2 and b.x2 <= run[-1].right + 2 and line.low - 2 <= b.y <= line.y + line.size]
                parts.append(Segment(True, start, len(text), formula.reconstruct([i.box() for i in run], own, body)[0]))
            elif parts and not parts[-1].math:
                parts[-1].end = len(text)
            else:
                parts.append(Segment(False, start, len(text)))
            before = run[-1]
    lead = text.trimmed()
    for p in parts:
        p.start, p.end = max(0, p.start - lead), min(len(text), p.end - lead)
    return text, [p for p in parts if p.start < p.end]


def tokens(text: str, parts: list[Segment]) -> tuple[str, list[dict]]:
    """The text with placeholders for its formulas, and these with their places; signs and numbers by themselves are no formulas."""
    found: list[tuple[int, int, str]] = []
    for p in parts:
        raw = text[p.start : p.end]
        if p.math and p.latex.strip():
            start, end = p.start + len(raw) - len(raw.lstrip()), p.end - len(raw) + len(raw.rstrip())
            if not (_TRIVIAL.fullmatch(raw.strip()) and p.latex.strip() == raw.strip()):
                found.append((start, end, p.latex.strip()))
        else:
            found += [(p.start + t["start"], p.start + t["end"], t["latex"]) for t in layout.tokenised(raw)[1]]
    out, at, told = [], 0, []
    for n, (start, end, latex) in enumerate(found, 1):
        told.append({"id": f"M{n}", "latex": latex, "raw": text[start:end], "start": start, "end": end})
        out += [text[at:start], f"⟦M{n}⟧"]
        at = end
    return "".join([*out, text[at:]]), told


# Paragraphs

_INT, _STR, _DOUBLE = pa.int32(), pa.string(), pa.float64()
_FIELDS = {
    "paper_id": pa.int64(), "page": _INT, "para": _INT, "section": _STR, "type": _STR, "n_lines": _INT, "body_index": _INT, "text": _STR, "translation": _STR, "latex": _STR, "tag": _STR, "glyphs": pa.list_(pa.int64()), "places": pa.list_(_INT),
    "segments": pa.list_(pa.struct([("kind", _STR), ("latex", _STR), ("start", _INT), ("end", _INT)])), "tokens": pa.list_(pa.struct([("id", _STR), ("latex", _STR), ("raw", _STR), ("start", _INT), ("end", _INT)])),
    "x0": _DOUBLE, "y0": _DOUBLE, "x1": _DOUBLE, "y1": _DOUBLE, "crop": pa.list_(_DOUBLE), "masks": pa.list_(pa.list_(_DOUBLE)),
}
SCHEMA = (
    "paper_id long, page int, para int, section string, type string, n_lines int, body_index int, text string, translation string, latex string, tag string, glyphs array<long>, places array<int>, "
    "segments array<struct<kind:string, latex:string, start:int, end:int>>, tokens array<struct<id:string, latex:string, raw:string, start:int, end:int>>, x0 double, y0 double, x1 double, y1 double, crop array<double>, masks array<array<double>>"
)


class Neighbours:
    """Boxes of a page's other lines by height, so that a formula meets only those near it."""

    def __init__(self, lines: list[Line]):
        self.boxes = sorted((b for ln in lines for b in ln.boxes()), key=lambda b: b.bottom)
        self.bottoms = [b.bottom for b in self.boxes]
        self.tallest = max((b.top - b.bottom for b in self.boxes), default=0.0)

    def between(self, low: float, high: float) -> list[formula.Box]:
        a, b = bisect_left(self.bottoms, low - self.tallest), bisect_left(self.bottoms, high)
        return [x for x in self.boxes[a:b] if x.top > low]


def paragraphs(items: list[Item], bars: list[formula.Bar], body: float, width: float, height: float) -> Iterator[dict]:
    """The paragraphs of a page, all columns but its own keys."""
    groups = layout.grouped(items, bars, body, width)
    others = Neighbours([ln for _, kind, part in groups if kind != "formula" for ln in part])
    numbered = 0
    for section, kind, lines in groups:
        boxes = [b for ln in lines for b in ln.boxes()]
        own = [b for ln in lines for b in ln.bars]
        text, parts = spelt(lines, bars, body)
        clean = str(text)
        row = {"section": section, "type": kind, "n_lines": len(lines), "text": clean, "glyphs": text.glyphs, "places": text.places, "x0": min(b.x for b in boxes), "y0": min(b.bottom for b in boxes), "x1": max(b.right for b in boxes), "y1": max(b.top for b in boxes)}
        if kind == "formula":
            latex, tag = formula.reconstruct(boxes, own, body)
            near = others.between(row["y0"] - 2 * body, row["y1"] + 2 * body)
            *crop, masks = formula.crop(boxes, own, near, width, height, body)
            yield row | {"translation": clean, "latex": latex, "tag": tag, "segments": [{"kind": "math", "latex": latex, "start": 0, "end": len(clean)}], "tokens": [], "crop": crop, "masks": [list(m) for m in masks]}
            continue
        if not clean or re.fullmatch(r"[0-9]{1,4}", clean):
            continue
        numbered += kind == "body"
        translation, told = tokens(clean, parts)
        yield row | {"body_index": numbered if kind == "body" else None, "translation": translation, "segments": [{"kind": "math" if p.math else "body", "latex": p.latex if p.math else None, "start": p.start, "end": p.end} for p in parts], "tokens": told}


COLUMNS = ("paper", "page", "seq", "text", "x", "y", "w", "size", "role", "body", "page_w", "page_h", "math", "latex", "bold", "proper", "mark")


def _of_text(rows: list[tuple]) -> list[tuple]:
    """Rows of glyphs without numbers in the lower band that stand alone, and what lies in regions: `layout.active`, for one page."""
    drawn = [r for r in rows if r[8] == "region"]
    glyphs = [r for r in rows if r[8] not in ("bar", "region")]
    seen = [r for r in glyphs if r[15]]
    if any(r[16] for r in seen):
        others = [r for r in glyphs if r[5] < 7 * 14 and not layout.NUMBER.match(r[3].strip(" "))]
        seen = [r for r in seen if not r[16] or any(o[2] != r[2] and abs(o[5] - r[5]) <= r[9] * 0.45 and abs(o[4] - r[4]) <= r[9] * 2.5 for o in others)]
    if drawn:
        seen = [r for r in seen if not any(d[4] - 4 <= r[4] + r[6] / 2 <= d[6] + 4 and d[5] - 4 <= r[5] <= d[7] + 4 for d in drawn)]
    return seen


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held, out = None, [], []

    def done() -> None:
        items = [Item(r[2], r[3], r[4], r[5], r[6], r[7], r[8], r[12], r[13], r[14]) for r in _of_text(held)]
        if items:
            bars = [formula.Bar(r[4], r[4] + r[6], r[5]) for r in held if r[8] == "bar"]
            body, width, height = (max(r[n] for r in held) for n in (9, 10, 11))
            for n, row in enumerate(paragraphs(items, bars, body, width, height)):
                out.append({"paper_id": key[0], "page": key[1], "para": n} | row)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], t) for c, t in _FIELDS.items()], names=list(_FIELDS))

    for b in batches:
        for row in zip(*(b[c].to_pylist() for c in COLUMNS), strict=True):
            if row[:2] != key:
                done()
                key, held = row[:2], []
            held.append(row)
        if len(out) > 2000:
            yield batch()
            out.clear()
    done()
    if out:
        yield batch()


def solved(glyphs: DataFrame, bars: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """Paragraphs (SCHEMA) of glyphs as `page_glyphs` makes them; bars (paper_id, page, x1, x2, y) are fraction bars and roots, regions (paper, page, x1, x2, min_y, max_y) tables to leave out."""
    proper, mark = layout.in_text(F.col("page_w"), F.col("page_h"))
    beside = (F.col("y") < 7 * 14) & ~F.trim("text").rlike("^[0-9]+$")  # what a number may stand beside
    flagged = glyphs.filter("not piece").withColumns({"proper": F.coalesce(proper, F.lit(False)), "mark": F.coalesce(mark, F.lit(False))})
    rows = flagged.filter(F.col("proper") | beside).select(*COLUMNS)
    none = {"text": F.lit(""), "body": F.lit(0.0), "page_w": F.lit(0.0), "page_h": F.lit(0.0), "math": F.lit(False), "latex": F.lit(""), "bold": F.lit(False), "proper": F.lit(False), "mark": F.lit(False), "seq": F.lit(-1).cast("long"), "x": F.col("x1")}
    if bars is not None:
        rows = rows.unionByName(bars.withColumns(none | {"w": F.col("x2") - F.col("x1"), "size": F.lit(0.0), "role": F.lit("bar"), "paper": F.col("paper_id")}).select(*COLUMNS))
    if regions is not None:
        rows = rows.unionByName(regions.withColumns(none | {"y": F.col("min_y"), "w": F.col("x2"), "size": F.col("max_y"), "role": F.lit("region")}).select(*COLUMNS))
    return layout.dealt(rows, ["paper", "page"], ["seq", "x", "y"]).mapInArrow(_run, SCHEMA)


def crops(paragraphs: DataFrame) -> DataFrame:
    """paper_id, page, para, latex, tag, x0, top, x1, bottom (top-down), masks: the formulas of all pages as boxes to cut out."""
    return paragraphs.filter("type = 'formula'").select("paper_id", "page", "para", "latex", "tag", *(F.get("crop", F.lit(i)).alias(c) for i, c in enumerate(("x0", "top", "x1", "bottom"))), "masks")


def snips(glyphs: DataFrame, regions: DataFrame, bars: DataFrame) -> DataFrame:
    """paper, page, n, text, latex, tag of what lies in a rectangle of each page (regions: paper, page, x1, x2, min_y, max_y): its lines as text, and built as a formula with the bars (paper_id, page, x1, x2, y) in it.

    A rectangle's glyphs are a page's at most; they are one row.
    """
    said = layout.snipped(glyphs, regions)
    r = regions.select("paper", "page", F.col("x1").alias("_x1"), F.col("x2").alias("_x2"), "min_y", "max_y")
    inside = (F.col("x") + F.col("w") / 2).between(F.col("_x1") - 2, F.col("_x2") + 2) & (F.col("y") + (F.col("top") - F.col("bottom")) * 0.25).between(F.col("min_y") - 2, F.col("max_y") + 2)
    one = F.struct("seq", "text", "x", "y", "w", F.col("size").alias("h"), "role", "bold")
    boxes = glyphs.join(r, ["paper", "page"]).filter(inside).groupBy("paper", "page").agg(F.array_sort(F.collect_list(one)).alias("glyphs"), F.min("_x1").alias("col_left"), F.max("_x2").alias("col_right"))
    within = (F.col("x2") >= F.col("_x1")) & (F.col("x1") <= F.col("_x2")) & F.col("y").between(F.col("min_y"), F.col("max_y"))
    lines = bars.withColumnRenamed("paper_id", "paper").join(r, ["paper", "page"]).filter(within).groupBy("paper", "page").agg(F.collect_list(F.struct("x1", "x2", "y")).alias("bars"))
    kinds = {f.name: f.dataType.simpleString() for f in glyphs.schema if f.name in ("paper", "page")}
    built = formula.formulas(boxes.join(lines, ["paper", "page"], "left"), kinds)
    return said.join(built.select("paper", "page", "latex", "tag"), ["paper", "page"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of a paragraph's text that come from one glyph, character after character: its number, the place in it where each begins, and the stretch; and in one row (seq -1) all characters that were put between glyphs."""
    for b in batches:
        texts, kept = b["text"].to_pylist(), {c: b[c].to_pylist() for c in ("paper_id", "page", "same")}
        lengths = b["glyphs"].value_lengths().to_numpy(zero_copy_only=False)
        glyphs, places = (b[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("glyphs", "places"))
        ends = np.cumsum(lengths)
        new = np.ones(len(glyphs), bool)
        new[1:] = (glyphs[1:] != glyphs[:-1]) | (places[1:] != places[:-1] + 1)
        new[(ends - lengths)[lengths > 0]] = True
        at = np.flatnonzero(new)
        first = np.searchsorted(at, np.append(ends - lengths, len(glyphs)))
        at = [*at.tolist(), len(glyphs)]
        para, seq, place, run = [], [], [], []
        for k, t in enumerate(texts):
            base, put = int(ends[k] - lengths[k]), []
            for i in range(first[k], first[k + 1]):
                part = t[at[i] - base : at[i + 1] - base]
                if glyphs[at[i]] < 0:
                    put.append(part)
                else:
                    para.append(k)
                    seq.append(glyphs[at[i]])
                    place.append(places[at[i]])
                    run.append(part)
            para.append(k)
            seq.append(-1)
            place.append(-1)
            run.append("".join(put))
        columns = [pa.array([kept[c][k] for k in para], t) for c, t in (("paper_id", pa.int64()), ("page", pa.int32()), ("same", pa.bool_()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(seq, pa.int64()), pa.array(place, pa.int32()), pa.array(run, pa.string())], names=["paper_id", "page", "same", "seq", "place", "run"])


def untraced(paragraphs: DataFrame, glyphs: DataFrame) -> DataFrame:
    """paper_id, page, chars, mismatches, restored: how many characters paragraphs have that come from glyphs, how many of these aren't the glyph's at that place, and whether all translations become the texts again."""
    from_raw = F.aggregate("tokens", F.col("translation"), lambda t, k: F.replace(t, F.concat(F.lit("⟦"), k["id"], F.lit("⟧")), k["raw"]))
    rows = paragraphs.filter("text <> ''").select("paper_id", "page", "text", (from_raw == F.col("text")).alias("same"), "glyphs", "places").mapInArrow(_stretches, "paper_id long, page int, same boolean, seq long, place int, run string")
    own = glyphs.select(F.col("paper").alias("paper_id"), "page", "seq", F.col("text").alias("whole"))
    met = rows.join(own.hint("merge"), ["paper_id", "page", "seq"], "left")
    n, there = F.length("run"), F.expr("substring(whole, place + 1, length(run))")
    alike = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + F.coalesce((F.substring(there, i, F.lit(1)) == F.substring("run", i, F.lit(1))).cast("int"), F.lit(0)))
    wrong = F.when(F.col("seq") < 0, F.length(F.replace("run", F.lit(" "), F.lit("")))).when(there == F.col("run"), 0).otherwise(n - alike)
    return met.groupBy("paper_id", "page").agg(F.sum(F.when(F.col("seq") >= 0, n).otherwise(0)).alias("chars"), F.sum(wrong).cast("long").alias("mismatches"), F.bool_and("same").alias("restored"))
