"""Figures and tables in the reading order: blocks, units with their captions, the column of each unit, and its place there.

Rules (heights from the bottom): parts of a figure at most BLOCK points apart that overlap sideways are a block; captions are blocks of their own. Blocks at most UNIT points apart
that overlap are a unit, unless a caption lies between them: captions stand below what they belong to, so what is below a caption is another figure. A caption
takes what lies above it and has none yet (the halves of a figure, side by side, too), and each unit has one caption at most. A unit over the gutter, or on both sides of it, is full width; others are in the column that most of their blocks are in. A unit in a column is read
where its top is; a full-width one comes first if it lies above all text, else after both columns and before footnotes.

A page has few blocks, and needs only its own: pages are dealt to tasks and solved one after another.

Defined results: pages without figures keep their columns' order; ties of height go by seq; parts without a size are points; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, UNIT, OVER = 30.0, 120.0, 4.0
FIGURES, CAPTION, FOOTNOTE = ("figure-label", "figure", "table", "cross"), "caption", "footnote"
LEFT, RIGHT, FULL = 0, 1, 2


@dataclass(slots=True)
class Part:
    seq: int
    kind: str
    x0: float
    x1: float
    top: float
    bottom: float


class Block:
    """Parts that belong together, and their hull."""

    def __init__(self, parts: list[Part]):
        self.parts = parts
        self.x0, self.x1 = min(p.x0 for p in parts), max(p.x1 for p in parts)
        self.top, self.bottom = max(p.top for p in parts), min(p.bottom for p in parts)
        self.caption = parts[0].kind == CAPTION

    def beside(self, other: Block) -> bool:
        """Overlaps other sideways."""
        return min(self.x1, other.x1) > max(self.x0, other.x0)

    def below(self, other: Block) -> float:
        """How far below other it begins; negative where they overlap in height."""
        return other.bottom - self.top


def groups(things: list[Block], together) -> list[list[Block]]:
    """Things in groups of those that are together, directly or by others."""
    left, out = list(things), []
    while left:
        group, edge = [], [left.pop(0)]
        while edge:
            a = edge.pop()
            group.append(a)
            near = [b for b in left if together(a, b)]
            left = [b for b in left if not any(b is n for n in near)]
            edge += near
        out.append(group)
    return out


def near(a: Block, b: Block, gap: float) -> bool:
    return a.beside(b) and max(a.below(b), b.below(a)) <= gap


def units(parts: list[Part]) -> list[list[Block]]:
    """Units of the figures, tables and captions of a page."""
    content = [Block([p]) for p in parts if p.kind in FIGURES]
    captions = sorted((Block([p]) for p in parts if p.kind == CAPTION), key=lambda c: (-c.top, c.parts[0].seq))
    blocks = [Block([p for b in g for p in b.parts]) for g in groups(content, lambda a, b: near(a, b, BLOCK))]

    def between(a: Block, b: Block) -> bool:
        upper, lower = (a, b) if a.top >= b.top else (b, a)
        return any(c.beside(a) and c.beside(b) and upper.bottom >= c.top and c.bottom >= lower.top for c in captions)

    found = groups(blocks, lambda a, b: near(a, b, UNIT) and not between(a, b))
    done: list[list[Block]] = []
    for c in captions:
        own = [u for u in found if any(b.beside(c) and b.top >= c.top and c.below(b) <= UNIT for b in u)]
        found = [u for u in found if not any(u is o for o in own)]
        done.append([b for u in own for b in u] + [c])
    return found + done


def column(unit: list[Block], gutter: float | None) -> int:
    if gutter is None:
        return LEFT
    sides = [LEFT if (b.x0 + b.x1) / 2 <= gutter else RIGHT for b in unit]
    if any(b.x0 < gutter - OVER and b.x1 > gutter + OVER for b in unit) or len(set(sides)) == 2:
        return FULL
    return sides[0]


def placed(parts: list[Part], gutter: float | None) -> list[tuple[int, int | None]]:
    """(seq, number of the unit or None) of a page's parts in reading order."""
    text = [p for p in parts if p.kind not in (*FIGURES, CAPTION, FOOTNOTE)]
    highest = max((p.top for p in text), default=0.0)
    rows: list[tuple[tuple, list[Part], bool]] = []  # where it comes, its parts, whether it is a unit
    for p in parts:
        if p.kind == FOOTNOTE:
            rows.append(((3, -p.top, p.seq), [p], False))
        elif p.kind not in (*FIGURES, CAPTION):
            side = RIGHT if gutter is not None and p.x0 + p.x1 > 2 * gutter and p.x0 >= gutter - OVER else LEFT
            rows.append(((1, side, -p.top, p.seq), [p], False))
    for unit in units(parts):
        own = sorted((p for b in unit for p in b.parts), key=lambda p: (-p.top, p.seq))
        top, side = own[0].top, column(unit, gutter)
        if side == FULL:
            first = min(b.bottom for b in unit) >= highest
            rows.append(((0 if first else 2, -top, own[0].seq), own, True))
        else:
            rows.append(((1, side, -top, own[0].seq), own, True))
    out, number = [], 0
    for _, own, is_unit in sorted(rows, key=lambda r: r[0]):
        number += is_unit
        out += [(p.seq, number if is_unit else None) for p in own]
    return out


COLUMNS = ("paper", "page", "seq", "type", "x0", "x1", "y_top", "y_bottom", "gutter")


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held, out = None, [], []

    def done() -> None:
        if held:
            parts = [Part(*(v if v is not None else 0.0 for v in r[2:8])) for r in held]
            out.extend((*key, seq, place, unit) for place, (seq, unit) in enumerate(placed(parts, held[0][8])))

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["paper", "page", "seq", "place", "unit"])

    for b in batches:
        for row in zip(*(b[c].to_pylist() for c in COLUMNS), strict=True):
            if row[:2] != key:
                done()
                key, held = row[:2], []
            held.append(row)
        if len(out) > 10_000:
            yield batch()
            out.clear()
    done()
    if out:
        yield batch()


def reading_order(paras: DataFrame) -> DataFrame:
    """paper, page, seq, place (from 0), unit (from 1, null for text) of paras: COLUMNS, heights from the bottom, gutter null on pages of one column."""
    rows = paras.select(F.col("paper").cast("long").alias("paper"), F.col("page").cast("int").alias("page"), F.col("seq").cast("long").alias("seq"), *COLUMNS[3:])
    return rows.repartition("paper", "page").sortWithinPartitions("paper", "page", "seq").mapInArrow(_run, "paper long, page int, seq long, place int, unit int")
