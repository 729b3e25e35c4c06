"""Rules, boxes and marks drawn on pages: extraction from drawing operators, classes of rules, tables.

ops: paper, page, seq, op ("save", "restore", "transform", "move", "line", "rect", "path"), args array<double>, subs array<string> (operators
of a path). rules: paper, page, kind ("h", "v", "r"), x1, y1, x2, y2, thickness, seq (a number within the page, in drawing order). Places are bottom-up points.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULE = "paper long, page int, kind string, x1 double, y1 double, x2 double, y2 double, thickness double, seq long"
NAMES = RULE.replace(" long", "").replace(" int", "").replace(" string", "").replace(" double", "").split(", ")
#: How thin a rule is, how long a horizontal and a vertical one, how large a box; the most of each kind on a page.
THIN, THIN_BOX, H_LEAST, V_LEAST, BOX_W, BOX_H = 1.2, 2.6, 2.2, 4.0, 14.0, 12.0
MOST = {"h": 2500, "v": 1800, "r": 600}
ARGUMENTS = {"move": 2, "line": 2, "rect": 4, "curve": 6}
UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def segment(p: tuple, q: tuple) -> tuple | None:
    """kind, x1, y1, x2, y2, thickness of a drawn line."""
    (x1, x2), (y1, y2) = sorted((p[0], q[0])), sorted((p[1], q[1]))
    w, h = x2 - x1, y2 - y1
    if h <= THIN and w >= H_LEAST:
        return "h", x1, (y1 + y2) / 2, x2, (y1 + y2) / 2, max(0.4, h)
    if w <= THIN and h >= V_LEAST:
        return "v", (x1 + x2) / 2, y1, (x1 + x2) / 2, y2, max(0.4, w)
    return None


def box(p: tuple, q: tuple) -> tuple | None:
    """The same of a rectangle: thin ones are rules."""
    (x1, x2), (y1, y2) = sorted((p[0], q[0])), sorted((p[1], q[1]))
    w, h = x2 - x1, y2 - y1
    if w <= 0 or h <= 0:
        return None
    if h <= THIN_BOX and w >= H_LEAST:
        return "h", x1, y1 + h / 2, x2, y1 + h / 2, h
    if w <= THIN_BOX and h >= V_LEAST:
        return "v", x1 + w / 2, y1, x1 + w / 2, y2, w
    return ("r", x1, y1, x2, y2, None) if w >= BOX_W and h >= BOX_H else None


class Pen:
    """The drawing state of one page: matrix, saved matrices, last point."""

    def __init__(self):
        self.matrix, self.saved, self.last = UNIT, [], None

    def point(self, x: float, y: float) -> tuple[float, float]:
        a, b, c, d, e, f = self.matrix
        return a * x + c * y + e, b * x + d * y + f

    def path(self, ops: list[str], args: list[float]) -> Iterator[tuple | None]:
        at = 0
        for op in ops:
            n = ARGUMENTS.get(op, 0)
            v, at = [*args[at : at + n], *[0.0] * n][:n], at + n
            if op in ("move", "line"):
                p = self.point(*v)
                if op == "line" and self.last:
                    yield segment(self.last, p)
                self.last = p
            else:
                if op == "rect":
                    yield box(self.point(v[0], v[1]), self.point(v[0] + v[2], v[1] + v[3]))
                self.last = None

    def draw(self, op: str, args: list[float], subs: list[str]) -> Iterator[tuple | None]:
        if op == "save":
            self.saved.append(self.matrix)
        elif op == "restore":
            self.matrix = self.saved.pop() if self.saved else UNIT
        elif op == "transform" and len(args) >= 6:
            a, b, c, d, e, f = self.matrix
            g, h, i, j, k, m = args[:6]
            self.matrix = (a * g + c * h, b * g + d * h, a * i + c * j, b * i + d * j, a * k + c * m + e, b * k + d * m + f)
        elif op == "path":
            self.last = None
            yield from self.path(subs, args)
        elif op in ARGUMENTS:
            yield from self.path([op], args)


def extracted(ops: DataFrame) -> DataFrame:
    """rules of all pages. Pages are dealt whole to tasks and drawn one after another; the state is one page's pen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pen, at, n = Pen(), None, 0
        for b in batches:
            out = []
            for paper, page, op, args, subs in zip(*(b[c].to_pylist() for c in ("paper", "page", "op", "args", "subs")), strict=True):
                if at != (paper, page):
                    pen, at, n = Pen(), (paper, page), 0
                drawn = [r for r in pen.draw(op, args or [], subs or []) if r]
                out += [(paper, page, *r, n + i) for i, r in enumerate(drawn)]
                n += len(drawn)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.string(), *[pa.float64()] * 5, pa.int64()), strict=True)], names=NAMES)

    dealt = ops.select("paper", "page", "seq", "op", "args", "subs").repartition("paper", "page").sortWithinPartitions("paper", "page", "seq")
    return dealt.mapInArrow(run, RULE)


def _half(c: Column) -> Column:
    return F.floor(c * 2 + 0.5)


def deduplicated(rules: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """rules on the page (8 points over at most), one of those alike within half a point, the first MOST of each kind: horizontal ones from the top, vertical ones from the left, boxes as drawn."""
    on = lambda x, y: x.between(-8, page_w + 8) & y.between(-8, page_h + 8)
    kept = rules.filter((F.col("kind") == "r") | (on(F.col("x1"), F.col("y1")) & on(F.col("x2"), F.col("y2"))))
    h, v = F.col("kind") == "h", F.col("kind") == "v"
    order = [F.when(h, -F.col("y1")).when(v, F.col("x1")).otherwise(F.col("seq")), F.when(h, F.col("x1")).when(v, -F.col("y2")).otherwise(0.0), "seq", "x1", "y1"]
    same = Window.partitionBy("paper", "page", "kind", _half(F.col("x1")), _half(F.col("y1")), _half(F.col("x2")), _half(F.col("y2")), F.when(F.col("kind") == "r", F.col("seq"))).orderBy(*order)
    one = kept.withColumn("_rn", F.row_number().over(same)).filter("_rn = 1").drop("_rn")
    most = F.when(h, MOST["h"]).when(v, MOST["v"]).otherwise(MOST["r"])
    return one.withColumn("_rn", F.row_number().over(Window.partitionBy("paper", "page", "kind").orderBy(*order))).filter(F.col("_rn") <= most).drop("_rn")


def near(rules: DataFrame, glyphs: DataFrame, test: Column, name: str) -> DataFrame:
    """rules with a flag: some glyph of the page passes the test (of r.* and g.*)."""
    keys = ["paper", "page"]
    r, g = rules.alias("r"), glyphs.alias("g")
    hit = r.join(g, [F.col(f"r.{k}") == F.col(f"g.{k}") for k in keys] + [test], "left_semi").select(*keys, "seq").distinct().withColumn(name, F.lit(True))
    return rules.join(hit, [*keys, "seq"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def footnote_rules(rules: DataFrame, glyphs: DataFrame, page_w: float, page_h: float, body: float) -> DataFrame:
    """Horizontal rules at the lower left that part footnotes: not short ones with glyphs close above and close below.

    glyphs: paper, page, x, y, right, top, bottom.
    """
    w = F.col("x2") - F.col("x1")
    low = rules.filter((F.col("kind") == "h") & (F.col("y1") > body * 4.2) & (F.col("y1") < page_h * 0.34) & (F.col("x1") < page_w * 0.24) & w.between(28, min(200.0, page_w * 0.36)))
    over = (F.col("g.x") < F.col("r.x2")) & (F.col("g.right") > F.col("r.x1"))
    above = over & F.col("g.bottom").between(F.col("r.y1") - 1.5, F.col("r.y1") + body * 0.85)
    below = over & F.col("g.top").between(F.col("r.y1") - body * 0.85, F.col("r.y1") + 1.5)
    flagged = near(near(low, glyphs, above, "above"), glyphs, below, "below")
    return flagged.filter(~(F.col("above") & F.col("below") & (w < 90))).drop("above", "below")


def math_bars(rules: DataFrame, glyphs: DataFrame, page_w: float, page_h: float, body: float) -> DataFrame:
    """Bars of fractions and roots: glyphs above and below, or a root sign to the left and glyphs below; not edges of boxes.

    glyphs: paper, page, x, y, right, top, radical.
    """
    w = F.col("x2") - F.col("x1")
    bars = rules.filter((F.col("kind") == "h") & w.between(2.2, min(240.0, page_w * 0.46)) & (F.col("thickness") <= 2.4) & F.col("y1").between(body * 4.5, page_h - body * 4.5))
    sides = rules.filter((F.col("kind") == "v") & (F.col("y2") - F.col("y1") >= 8)).select("paper", "page", F.col("x1").alias("x"), "y1", "y2")
    for end, name in (("x1", "left"), ("x2", "right")):
        meets = (F.abs(F.col("g.x") - F.col(f"r.{end}")) <= 1.8) & F.col("r.y1").between(F.col("g.y1") - 1.8, F.col("g.y2") + 1.8)
        bars = near(bars, sides, meets, name)
    bars = bars.filter("not (left and right)").drop("left", "right")
    high = body * 1.9
    over = F.least(F.col("g.right"), F.col("r.x2") + 1.5) > F.greatest(F.col("g.x"), F.col("r.x1") - 1.5)
    dy = F.col("g.y") - F.col("r.y1")
    root = F.col("g.radical") & (F.abs(F.col("g.right") - F.col("r.x1")) <= body * 0.9) & (F.abs(F.col("g.top") - F.col("r.y1")) <= body * 1.2)
    for test, name in ((over & dy.between(-0.5, high), "above"), (over & (dy < 0.5) & (dy >= -high * 1.15), "below"), (root, "root")):
        bars = near(bars, glyphs, test, name)
    return bars.filter("below and (above or root)").drop("above", "below", "root")


REGION = "paper long, page int, x1 double, x2 double, min_y double, max_y double, n_rules int"


#: How far below the last rule of a box the next one may be.
REACH = 160
KINDS = (pa.int64(), pa.int32(), *[pa.float64()] * 4, pa.int32())
NAMED = [c.split()[0] for c in REGION.split(", ")]


class Cluster:
    """A box of rules from the top down: its last rule, its bounds and its number of heights over 2.5 points apart."""

    def __init__(self, x1: float, x2: float, y: float):
        self.last = (x1, x2)
        self.x1, self.x2, self.y, self.top = x1, x2, y, y
        self.height, self.heights = y, 1

    def takes(self, x1: float, x2: float, y: float, marks: list[tuple]) -> bool:
        a, b = self.last
        if abs(x1 - a) > 16 or abs(x2 - b) > 16 or not 0 <= self.y - y <= REACH:
            return False
        left, right, top = min(a, x1) - 10, max(b, x2) + 10, self.y - 2
        return not any(-m[0] < top and m[1] >= left and m[2] <= right for m in marks)

    def take(self, x1: float, x2: float, y: float) -> None:
        self.last = (x1, x2)
        self.x1, self.x2, self.y = min(self.x1, x1), max(self.x2, x2), y
        if self.height - y > 2.5:
            self.height, self.heights = y, self.heights + 1


def clustered(rules: DataFrame, captions: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Boxes of wide horizontal rules with the same ends, one under the other: each rule joins the first box whose last one fits; boxes of three heights or more.

    captions: paper, page, x, right, y of table captions, which part boxes. First fit depends on the order, so a page's rules and captions go through one task from
    the top down, as a stream. Boxes that ended over REACH points above take nothing more and are told at once; a task holds what is within REACH points, and of a box its bounds.
    """
    least = min(page_w * 0.20, 118.0)
    wide = rules.filter((F.col("kind") == "h") & F.col("y1").between(28.0001, page_h - 28.0001) & (F.col("x2") - F.col("x1") >= least))
    lines = wide.select("paper", "page", (-F.col("y1")).alias("down"), F.lit(1).alias("rule"), "x1", "seq", "x2")
    marks = captions.filter("x is not null and right is not null and y is not null").select("paper", "page", (-F.col("y")).alias("down"), F.lit(0).alias("rule"), F.col("x").cast("double").alias("x1"), F.lit(0).cast("long").alias("seq"), F.col("right").cast("double").alias("x2"))
    keys = marks.join(wide.select("paper", "page").distinct(), ["paper", "page"], "left_semi")
    order = ["down", "rule", "x1", "seq", "x2"]
    dealt = lines.unionByName(keys).withColumn("place", F.row_number().over(Window.partitionBy("paper", "page").orderBy(*order)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, open_, seen, before, out = None, [], [], None, []

        def close(below: float) -> None:
            """Tell and leave out the boxes that end over REACH points above a height."""
            for c in open_:
                if c.y - below > REACH and c.heights >= 3:
                    out.append((*page, c.x1, c.x2, c.y, c.top, c.heights))
            open_[:] = [c for c in open_ if c.y - below <= REACH]

        for b in batches:
            for paper, number, down, rule, x1, x2 in zip(*(b[c].to_pylist() for c in ("paper", "page", "down", "rule", "x1", "x2")), strict=True):
                if (paper, number) != page:
                    close(float("-inf"))
                    page, seen, before = (paper, number), [], None
                if not rule:
                    seen.append((down, x1, x2))
                    continue
                if (x1, x2, down) == before:  # what took the last one takes it too
                    continue
                before, y = (x1, x2, down), -down
                close(y)
                if seen and seen[0][0] < down - REACH:
                    del seen[: bisect_left(seen, (down - REACH,))]
                near = [m for m in seen if m[0] < down - 2]
                for c in open_:
                    if c.takes(x1, x2, y, near):
                        c.take(x1, x2, y)
                        break
                else:
                    open_.append(Cluster(x1, x2, y))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), KINDS, strict=True)], names=NAMED)
                out = []
        close(float("-inf"))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), KINDS, strict=True)], names=NAMED)

    return dealt.mapInArrow(run, REGION)


def table_verdicts(regions: DataFrame, glyphs: DataFrame, body: float) -> DataFrame:
    """regions (with id) and whether they hold a table: rows of glyphs inside, those with wide gaps or numbers, those of prose, and any numbered equation, which rules a table out.

    glyphs: paper, page, seq, text, x, y, right. Glyphs of one row lie within the tolerance of the one above, from the top.
    """
    at = lambda c: F.col(f"r.{c}")
    centre = (F.col("g.x") + F.col("g.right")) / 2
    inside = glyphs.alias("g").join(regions.alias("r"), (F.col("g.paper") == at("paper")) & (F.col("g.page") == at("page")) & centre.between(at("x1") - 4, at("x2") + 4) & F.col("g.y").between(at("min_y") - 4, at("max_y") + 4)).filter(F.trim("g.text") != "")
    rows = inside.select(at("paper").alias("paper"), at("page").alias("page"), at("id").alias("id"), (at("x2") - at("x1")).alias("span"), (at("max_y") - at("min_y")).alias("tall"), F.col("g.seq"), F.col("g.text"), F.col("g.x"), F.col("g.y"), F.col("g.right"))
    keys = ["paper", "page", "id"]
    down = Window.partitionBy(*keys).orderBy(F.desc("y"), "x", "seq")
    step = F.when(F.lag("y").over(down) - F.col("y") > max(2.5, body * 0.32), 1).otherwise(0)
    lined = rows.withColumn("_s", step).withColumn("row", F.sum("_s").over(down))
    across = Window.partitionBy(*keys, "row").orderBy("x", "seq")
    gaps = lined.withColumn("_gap", F.when(F.col("x") - F.lag("right").over(across) >= max(11.0, body * 1.25), 1).otherwise(0))
    line = gaps.groupBy(*keys, "span", "tall", "row").agg(F.count("*").alias("n"), F.sum("_gap").alias("gaps"), (F.max("right") - F.min("x")).alias("w"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "text"))), lambda s: s["text"]), " ").alias("t"))
    numbers = F.regexp_count("t", F.lit(r"(?<![A-Za-z0-9_])[0-9]+(?:\.[0-9]+)?(?![A-Za-z0-9_])"))
    words = F.regexp_count("t", F.lit("[A-Za-z]{2,}"))
    equation = F.col("t").rlike(r"\(\s*[0-9]{1,3}[a-z]?\s*\)\s*$") & F.col("t").rlike("[=+\\-−∑∏∫≤≥≈∈]")
    tabular = (F.col("gaps") >= 2) | ((F.col("gaps") >= 1) & (numbers >= 2)) | (numbers >= 3)
    prose = ~tabular & (words >= 9) & (F.col("gaps") == 0) & (F.col("w") > F.col("span") * 0.65)
    sums = line.groupBy(*keys, "tall").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.count_if(tabular).alias("tabular"), F.count_if(prose).alias("prose"), F.bool_or(equation).alias("equation"))
    verdict = F.col("tall").between(body * 2.5, 520) & (F.col("n") >= 4) & (F.col("rows") >= 2) & ~F.col("equation") & (F.col("prose") < 3) & (F.col("prose") <= F.col("tabular")) & (F.col("tabular") >= F.greatest(F.lit(2), F.floor(F.col("rows") * 0.35)))
    return sums.select(*keys, "rows", "tabular", "prose", verdict.alias("is_table"))
