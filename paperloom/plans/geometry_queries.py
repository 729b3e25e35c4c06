"""Queries of glyphs, rules, regions and spans on pages, and their SQL. Numeric tables stand in for places on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import latex as X
from paperloom.functions import text as T
from paperloom.operators import flow, layout, vectors
from paperloom.plans.text_queries import BLANK, sql_count, sql_trim, sql_type
from paperloom.sources import papers
from paperloom.sources.tables import LINES_SQL, lines, table

W, H, BODY = 612.0, 792.0, 10.0
# Inputs that both dialects build alike: glyphs of line items, rules of orders, regions of suppliers and pages.
GLYPHS = [
    "l_suppkey AS paper", "l_linenumber AS page", "row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) AS seq", "cast(l_partkey * 13 % 580 AS double) AS x", "cast(l_orderkey * 7 % 780 AS double) AS y", "4 + floor(l_quantity) AS w",
    "CASE l_orderkey % 13 WHEN 0 THEN '12' WHEN 1 THEN '3 of 9' WHEN 2 THEN '- 4 -' WHEN 3 THEN 'Copyright 2020' WHEN 4 THEN 'arXiv mark' WHEN 5 THEN '∑' WHEN 6 THEN '(3)' WHEN 7 THEN ' ' WHEN 8 THEN '0.75' WHEN 9 THEN '= x' ELSE 'word of text' END AS text",
    "8 + floor(l_tax * 100) AS size", "l_partkey % 11 = 0 AS rotated", "l_partkey % 17 = 0 AS radical", "CASE l_partkey % 4 WHEN 0 THEN 'CMR10' WHEN 1 THEN 'CMMI10' WHEN 2 THEN 'Times' ELSE 'Arial' END AS font",
]
MORE = ["*", "x + w AS right", "y + 7 AS top", "y - 2 AS bottom"]
RULES = [
    "o_custkey % 100 + 1 AS paper", "cast(o_orderkey % 7 + 1 AS int) AS page", "CASE o_orderkey % 5 WHEN 3 THEN 'v' WHEN 4 THEN 'r' ELSE 'h' END AS kind", "cast(o_custkey * 11 % 640 - 20 AS double) AS x1", "cast(o_orderkey * 5 % 830 - 15 AS double) / 4 AS y0",
    "cast(o_orderkey * 3 % 240 AS double) AS len", "0.5 + o_orderkey % 7 * 0.5 AS thickness", "o_orderkey AS seq",
]
PLACED = ["paper", "page", "kind", "x1", "y0 * 4 AS y1", "CASE WHEN kind = 'v' THEN x1 ELSE x1 + len END AS x2", "CASE WHEN kind = 'h' THEN y0 * 4 ELSE y0 * 4 + len END AS y2", "thickness", "seq"]


def _glyphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*GLYPHS).selectExpr(*MORE)


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(*RULES).selectExpr(*PLACED)


def _regions(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.range(1, 8).select(F.col("id").cast("int").alias("page"))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("paper"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("page"))
    return rows.join(F.broadcast(pages), "page").selectExpr("paper", "page", "1 AS id", "cast(paper * 3 % 200 AS double) AS x1", "cast(paper * 3 % 200 + 200 AS double) AS x2", "cast(page * 60 AS double) AS min_y", "cast(page * 60 + 150 AS double) AS max_y")


def drawn_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules and boxes from drawing operators of pages: a matrix, lines, rectangles and paths for each order."""
    op = "CASE o_orderkey % 9 WHEN 0 THEN 'save' WHEN 1 THEN 'transform' WHEN 2 THEN 'move' WHEN 3 THEN 'line' WHEN 4 THEN 'rect' WHEN 5 THEN 'restore' WHEN 6 THEN 'rect' ELSE 'path' END"
    k = "cast(o_custkey % 90 AS double)"
    args = f"""CASE o_orderkey % 9 WHEN 1 THEN array(1.0D, 0.0D, 0.0D, cast(1 + o_custkey % 2 AS double), {k}, 5.0D) WHEN 2 THEN array({k}, 40.0D) WHEN 3 THEN array({k} + 50, 40.0D + o_custkey % 2) WHEN 4 THEN array({k}, 60.0D, cast(o_custkey % 40 AS double), cast(o_custkey % 4 AS double))
 WHEN 6 THEN array({k}, 90.0D, -30.0D, 20.0D) WHEN 7 THEN array({k}, 10.0D, {k} + 20, 10.0D, {k} + 20, 30.0D) WHEN 8 THEN array(1.0D, 2.0D, 3.0D, 4.0D, 5.0D, 6.0D, {k}, 7.0D, {k} + 9, 7.0D, 5.0D, 5.0D, 2.0D, 60.0D) ELSE array() END"""
    subs = "CASE o_orderkey % 9 WHEN 7 THEN array('move', 'line', 'line') WHEN 8 THEN array('curve', 'move', 'line', 'close', 'rect') END"
    ops = table(spark, d, "orders").selectExpr("o_custkey % 100 AS paper", "cast(o_orderkey % 3 AS int) AS page", "o_orderkey AS seq", f"{op} AS op", f"{args} AS args", f"{subs} AS subs")
    return vectors.extracted(ops)


def rule_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return vectors.deduplicated(_rules(spark, d), W, H).groupBy("paper", "page", "kind").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


def footnote_rules(spark: SparkSession, d: str) -> DataFrame:
    return vectors.footnote_rules(_rules(spark, d), _glyphs(spark, d), W, H, BODY).select("paper", "page", "seq")


def math_bars(spark: SparkSession, d: str) -> DataFrame:
    return vectors.math_bars(_rules(spark, d), _glyphs(spark, d), W, H, BODY).select("paper", "page", "seq")


def rule_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of wide rules with the same ends, one under the other."""
    rows = table(spark, d, "orders").selectExpr("o_custkey % 100 AS paper", "cast(o_orderkey % 7 AS int) AS page", "'h' AS kind", "cast(o_custkey % 5 * 12 AS double) AS x1", "cast(o_orderkey * 37 % 760 + 10 AS double) AS y1", "cast(o_custkey % 5 * 12 + 130 + o_orderkey % 3 * 10 AS double) AS x2", "cast(o_orderkey * 37 % 760 + 10 AS double) AS y2", "0.5D AS thickness", "o_orderkey AS seq")
    captions = _glyphs(spark, d).filter("text = '12'").select("paper", F.col("page").cast("int").alias("page"), "x", "right", "y")
    return vectors.clustered(rows, captions, W, H)


def table_verdicts(spark: SparkSession, d: str) -> DataFrame:
    # fewer relations, so that not every region holds an equation
    return vectors.table_verdicts(_regions(spark, d), _glyphs(spark, d).withColumn("text", F.expr("CASE WHEN text = '= x' AND seq % 5 <> 0 THEN 'xy' ELSE text END")), BODY)


def snipped_text(spark: SparkSession, d: str) -> DataFrame:
    """Text of the glyphs whose centres lie in a rectangle, line by line."""
    got = layout.snipped(_glyphs(spark, d), _regions(spark, d))
    return got.select("paper", "page", "n", F.md5("text").alias("text_md5"))


def active_glyphs(spark: SparkSession, d: str) -> DataFrame:
    rows = layout.active(_glyphs(spark, d).withColumn("body", F.lit(BODY)), _regions(spark, d), W, H)
    return rows.groupBy("paper", "page").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


def dominant_fonts(spark: SparkSession, d: str) -> DataFrame:
    return layout.dominant_fonts(_glyphs(spark, d))


TOKENS = ["doc_id", "line_no", "i AS id", "i * 17 AS start", "least(i * 17 + i % 2 * 6, length(raw)) AS end_"]


def sentence_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of lines with the sentence that holds each whole."""
    rows = lines(spark, d)
    parts = rows.select("doc_id", "line_no", F.posexplode(F.split("raw", r"(?<=\.) ")).alias("pos", "s"))
    w = Window.partitionBy("doc_id", "line_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    spans = parts.withColumn("start", F.coalesce(F.sum(F.length("s") + 1).over(w), F.lit(0))).select("doc_id", "line_no", "pos", "start", (F.col("start") + F.length("s")).alias("end"))
    tokens = rows.select("doc_id", "line_no", "raw", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).selectExpr(*TOKENS).withColumnRenamed("end_", "end")
    return flow.within(tokens, spans, ["doc_id", "line_no"]).select("doc_id", "line_no", F.col("id").cast("long").alias("id"), F.col("pos").cast("long").alias("pos"))


def annotation_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentence of each mark on a line."""
    rows = lines(spark, d)
    sentences = rows.select(F.col("doc_id").alias("paper"), F.col("line_no").alias("para"), F.posexplode(F.split("raw", r"(?<=\.) ")).alias("pos", "sentence"))
    marks = rows.select(F.col("doc_id").alias("paper"), F.col("line_no").alias("para"), F.lit(1).alias("id"), F.expr("CASE line_no % 4 WHEN 0 THEN substring(raw, 30, 60) WHEN 1 THEN '  ' || raw WHEN 2 THEN 'nowhere' ELSE right(raw, 25) END").alias("text"))
    return flow.first_sentences(marks, sentences).select("paper", "para", F.col("pos").cast("long").alias("pos"))


def line_checks(spark: SparkSession, d: str) -> DataFrame:
    """Tests and cleaning of lines that hold numbers of equations, LaTeX, images and marks of HTML."""
    cases = "CASE line_no % 12 WHEN 0 THEN ' (12) ' WHEN 1 THEN '(A.1)' WHEN 2 THEN '(iv)' WHEN 3 THEN '$$' || raw || '$$' WHEN 4 THEN '```latex' || chr(10) || 'A t t I D = x' || chr(10) || '```' WHEN 5 THEN 'data:image/jpeg;base64,QUJD REVG' WHEN 6 THEN '$x$ + $y$' WHEN 7 THEN 'a & b < \"c\"' WHEN 8 THEN 'where ' || raw WHEN 9 THEN '{a{b}' WHEN 10 THEN '$ab c$' ELSE line END"
    c = F.col("c")
    rows = lines(spark, d).select("doc_id", "line_no", F.expr(cases).alias("c"))
    return rows.select("doc_id", "line_no", X.equation_tag(c).alias("is_tag"), F.md5(X.unwrapped(c)).alias("unwrapped"), F.md5(X.of_model(c)).alias("cleaned"), F.md5(X.collapsed(c)).alias("collapsed"), X.image(c)["mime"].alias("mime"), F.md5(X.image(c)["base64"]).alias("base64"), F.md5(X.escaped(c)).alias("escaped"), X.balanced(c).alias("balanced"), X.prose_line(c).alias("prose"))


SIZED = "CASE (doc_id + line_no) % 11 WHEN 0 THEN '摘 要：' || raw WHEN 1 THEN '关键词：甲；乙' WHEN 2 THEN '图 3 ' || raw WHEN 3 THEN '三、相关工作' WHEN 4 THEN '参考文献' WHEN 5 THEN 'Results' WHEN 6 THEN '2 引言' ELSE line END"


def special_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of lines by text, size, weight and place on the first page."""
    rows = lines(spark, d).select("doc_id", "line_no", F.expr(SIZED).alias("t"), (8 + F.col("line_no") % 8).alias("size"), (F.col("line_no") % 2 == 0).alias("bold"), (F.col("line_no") % 3 + 1).alias("page"), ((F.col("line_no") * 13 % 100) / 100).alias("top"))
    kind = T.special_type(F.col("t"), F.col("size"), F.col("bold"), F.lit(BODY), F.col("page"), F.col("top"))
    return rows.groupBy("doc_id", F.coalesce(kind, F.lit("body")).alias("type")).agg(F.count("*").alias("n"))


def affine_points(spark: SparkSession, d: str) -> DataFrame:
    """Points through a product of two matrices, and their distance from the origin."""
    m = F.array(F.lit(2.0), F.lit(0.5), F.lit(0.0), F.lit(1.0), F.col("l_quantity"), F.lit(3.0))
    k = T.multiplied(m, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.25), F.lit(-1.0), F.lit(0.0), F.col("l_tax")))
    rows = table(spark, d, "lineitem").select("l_linenumber", T.affine(k, F.col("l_discount"), F.col("l_quantity")).alias("p"))
    return rows.groupBy("l_linenumber").agg(F.round(F.sum("p.x"), 3).alias("x"), F.round(F.sum("p.y"), 3).alias("y"), F.round(F.sum(F.hypot("p.x", "p.y")), 3).alias("far"))


ITEMS = "'[{\"str\": \"a' || doc_id || '\", \"fontName\": \"f1\", \"width\": 5, \"height\": 10, \"transform\": [10, 0, 0, 10, 72, 700]}, {\"str\": \"b\", \"fontName\": \"f2\", \"transform\": [0, 9, -9, 0, 30, ' || (doc_id % 50) || ']}, {\"fontName\": \"f3\"}]'"


def text_item_scan(spark: SparkSession, d: str) -> DataFrame:
    """Text items of pages from JSON, with real names of fonts."""
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.lit(1).alias("page"), F.from_json(F.expr(ITEMS), f"array<{papers.ITEM}>").alias("items"))
    fonts = table(spark, d, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("paper_id"), F.lit("f1").alias("font_key"), F.lit("CMR10").alias("font_name"))
    return papers.placed_items(pages, fonts).select("paper_id", F.col("item_idx").cast("long").alias("item_idx"), "str", "font_name", "x", "y", "width", "height", "rotated")


QUERIES = {f.__name__: f for f in (drawn_rules, rule_dedupe, footnote_rules, math_bars, rule_boxes, table_verdicts, snipped_text, active_glyphs, dominant_fonts, sentence_tokens, annotation_sentences, line_checks, special_types, affine_points, text_item_scan)}

_G = f"g AS (SELECT {', '.join(MORE)} FROM (SELECT {', '.join(GLYPHS)} FROM lineitem))"
_R = f"r AS (SELECT {', '.join(PLACED)} FROM (SELECT {', '.join(RULES)} FROM orders))"
_BOX = "b AS (SELECT s_suppkey AS paper, p::INT AS page, 1 AS id, (s_suppkey * 3 % 200)::DOUBLE AS x1, (s_suppkey * 3 % 200 + 200)::DOUBLE AS x2, (p * 60)::DOUBLE AS min_y, (p * 60 + 150)::DOUBLE AS max_y FROM supplier, range(1, 8) t(p))"
_G2R = "g.paper = r.paper AND g.page = r.page"
_PARTS = r"[x for x in string_split(regexp_replace(raw, '\. ', '.' || chr(1), 'g'), chr(1))]"
_CASES = "CASE line_no % 12 WHEN 0 THEN ' (12) ' WHEN 1 THEN '(A.1)' WHEN 2 THEN '(iv)' WHEN 3 THEN '$$' || raw || '$$' WHEN 4 THEN '```latex' || chr(10) || 'A t t I D = x' || chr(10) || '```' WHEN 5 THEN 'data:image/jpeg;base64,QUJD REVG' WHEN 6 THEN '$x$ + $y$' WHEN 7 THEN 'a & b < \"c\"' WHEN 8 THEN 'where ' || raw WHEN 9 THEN '{a{b}' WHEN 10 THEN '$ab c$' ELSE line END"


def _collapse(x: str) -> str:
    once = r"regexp_replace({0}, '([A-Za-z0-9])\s+([A-Za-z0-9])', '\1\2', 'g')"
    return f"trim({once.format(once.format(x))})"


ORACLES = {
    "rule_dedupe": f"""WITH {_R}, k AS (SELECT * FROM r WHERE kind = 'r' OR (x1 BETWEEN -8 AND 620 AND x2 BETWEEN -8 AND 620 AND y1 BETWEEN -8 AND 800 AND y2 BETWEEN -8 AND 800)), o AS (SELECT *, CASE kind WHEN 'h' THEN -y1 WHEN 'v' THEN x1 ELSE seq END AS o1, CASE kind WHEN 'h' THEN x1 WHEN 'v' THEN -y2 ELSE 0 END AS o2 FROM k),
 u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY paper, page, kind, floor(x1 * 2 + 0.5), floor(y1 * 2 + 0.5), floor(x2 * 2 + 0.5), floor(y2 * 2 + 0.5), CASE WHEN kind = 'r' THEN seq END ORDER BY o1, o2, seq, x1, y1) = 1), c AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY paper, page, kind ORDER BY o1, o2, seq, x1, y1) <= CASE kind WHEN 'h' THEN 2500 WHEN 'v' THEN 1800 ELSE 600 END)
 SELECT paper, page, kind, count(*) AS n, sum(seq)::BIGINT AS seqs FROM c GROUP BY ALL""",
    "footnote_rules": f"""WITH {_R}, {_G}, l AS (SELECT *, x2 - x1 AS w FROM r WHERE kind = 'h' AND y1 > 42 AND y1 < 792 * 0.34 AND x1 < 612 * 0.24 AND x2 - x1 BETWEEN 28 AND 200)
 SELECT paper, page, seq FROM l r WHERE NOT (w < 90 AND EXISTS (SELECT 1 FROM g WHERE {_G2R} AND g.x < r.x2 AND g."right" > r.x1 AND g.bottom BETWEEN r.y1 - 1.5 AND r.y1 + 8.5) AND EXISTS (SELECT 1 FROM g WHERE {_G2R} AND g.x < r.x2 AND g."right" > r.x1 AND g.top BETWEEN r.y1 - 8.5 AND r.y1 + 1.5))""",
    "math_bars": f"""WITH {_R}, {_G}, v AS (SELECT paper, page, x1 AS x, y1, y2 FROM r WHERE kind = 'v' AND y2 - y1 >= 8), b AS (SELECT * FROM r WHERE kind = 'h' AND x2 - x1 BETWEEN 2.2 AND 240 AND thickness <= 2.4 AND y1 BETWEEN 45 AND 747),
 e AS (SELECT * FROM b r WHERE NOT (EXISTS (SELECT 1 FROM v g WHERE {_G2R} AND abs(g.x - r.x1) <= 1.8 AND r.y1 BETWEEN g.y1 - 1.8 AND g.y2 + 1.8) AND EXISTS (SELECT 1 FROM v g WHERE {_G2R} AND abs(g.x - r.x2) <= 1.8 AND r.y1 BETWEEN g.y1 - 1.8 AND g.y2 + 1.8)))
 SELECT paper, page, seq FROM e r WHERE EXISTS (SELECT 1 FROM g WHERE {_G2R} AND least(g."right", r.x2 + 1.5) > greatest(g.x, r.x1 - 1.5) AND g.y - r.y1 < 0.5 AND g.y - r.y1 >= -21.85)
 AND (EXISTS (SELECT 1 FROM g WHERE {_G2R} AND least(g."right", r.x2 + 1.5) > greatest(g.x, r.x1 - 1.5) AND g.y - r.y1 BETWEEN -0.5 AND 19) OR EXISTS (SELECT 1 FROM g WHERE {_G2R} AND g.radical AND abs(g."right" - r.x1) <= 9 AND abs(g.top - r.y1) <= 12))""",
    "table_verdicts": rf"""WITH {_G}, {_BOX}, i AS (SELECT b.paper, b.page, b.id, b.x2 - b.x1 AS span, b.max_y - b.min_y AS tall, g.seq, CASE WHEN g.text = '= x' AND g.seq % 5 <> 0 THEN 'xy' ELSE g.text END AS text, g.x, g.y, g."right" FROM g JOIN b ON g.paper = b.paper AND g.page = b.page AND (g.x + g."right") / 2 BETWEEN b.x1 - 4 AND b.x2 + 4 AND g.y BETWEEN b.min_y - 4 AND b.max_y + 4 WHERE trim(g.text) <> ''),
 s AS (SELECT *, CASE WHEN lag(y) OVER (PARTITION BY paper, page, id ORDER BY y DESC, x, seq) - y > 3.2 THEN 1 ELSE 0 END AS st FROM i), l AS (SELECT *, sum(st) OVER (PARTITION BY paper, page, id ORDER BY y DESC, x, seq) AS line FROM s),
 p AS (SELECT *, CASE WHEN x - lag("right") OVER (PARTITION BY paper, page, id, line ORDER BY x, seq) >= 12.5 THEN 1 ELSE 0 END AS gap FROM l), t AS (SELECT paper, page, id, span, tall, count(*) AS n, sum(gap) AS gaps, max("right") - min(x) AS w, string_agg(text, ' ' ORDER BY x, seq) AS t FROM p GROUP BY paper, page, id, span, tall, line),
 f AS (SELECT *, {sql_count('t', r'\b[0-9]+(?:\.[0-9]+)?\b')} AS nums, {sql_count('t', '[A-Za-z]{2,}')} AS words, regexp_matches(t, '\(\s*[0-9]{{1,3}}[a-z]?\s*\)\s*$') AND regexp_matches(t, '[=+\-−∑∏∫≤≥≈∈]') AS eq FROM t),
 c AS (SELECT *, gaps >= 2 OR (gaps >= 1 AND nums >= 2) OR nums >= 3 AS tab FROM f), z AS (SELECT paper, page, id, tall, sum(n) AS n, count(*) AS rows_, count(*) FILTER (tab) AS tabular, count(*) FILTER (NOT tab AND words >= 9 AND gaps = 0 AND w > span * 0.65) AS prose, bool_or(eq) AS eq FROM c GROUP BY ALL)
 SELECT paper, page, id, rows_ AS rows, tabular, prose, tall BETWEEN 25 AND 520 AND n >= 4 AND rows_ >= 2 AND NOT eq AND prose < 3 AND prose <= tabular AND tabular >= greatest(2, floor(rows_ * 0.35)) AS is_table FROM z""",
    "snipped_text": rf"""WITH {_G}, {_BOX}, i AS (SELECT g.* FROM g JOIN b ON g.paper = b.paper AND g.page = b.page AND g.x + g.w / 2 BETWEEN b.x1 - 2 AND b.x2 + 2 AND g.y + 2.25 BETWEEN b.min_y - 2 AND b.max_y + 2), s AS (SELECT *, CASE WHEN lag(y) OVER (PARTITION BY paper, page ORDER BY y DESC, x, seq) - y > 4 THEN 1 ELSE 0 END AS st FROM i),
 l AS (SELECT *, sum(st) OVER (PARTITION BY paper, page ORDER BY y DESC, x, seq) AS line FROM s) SELECT paper, page, count(*) AS n, md5(trim(regexp_replace(string_agg(text, ' ' ORDER BY line, x, seq), '\s+', ' ', 'g'))) AS text_md5 FROM l GROUP BY paper, page""",
    "active_glyphs": rf"""WITH {_G}, {_BOX}, t AS (SELECT *, trim(text) AS t FROM g WHERE trim(text) <> '' OR radical), a AS (SELECT * FROM t g WHERE y >= 44 AND y <= 752
 AND NOT (y < 62 AND (regexp_matches(t, '(?i)^[0-9]+(\s+of\s+[0-9]+)?$') OR regexp_matches(t, '^[-—–]\s*[0-9]+\s*[-—–]$')) AND NOT EXISTS (SELECT 1 FROM g o WHERE o.paper = g.paper AND o.page = g.page AND o.seq <> g.seq AND abs(o.y - g.y) <= 4.5 AND abs(o.x - g.x) <= 25 AND NOT regexp_matches(trim(o.text), '^[0-9]+$')))
 AND NOT (y < 62 AND regexp_matches(t, '(?i)^(?:Authorized licensed use|Downloaded on|Copyright|All rights reserved|©|978-[0-9])')) AND NOT (y > 736 AND regexp_matches(t, '^[0-9]+$') AND size < 12) AND NOT (rotated AND (x < 48 OR x > 564 OR regexp_matches(t, '(?i)arxiv|doi|copyright|licensed|ieee'))))
 SELECT paper, page, count(*) AS n, sum(seq)::BIGINT AS seqs FROM a g WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.paper = g.paper AND b.page = g.page AND g.x + g.w / 2 BETWEEN b.x1 - 4 AND b.x2 + 4 AND g.y BETWEEN b.min_y - 4 AND b.max_y + 4) GROUP BY paper, page""",
    "dominant_fonts": f"WITH {_G}, f AS (SELECT paper, page, font, sum(length(trim(text)))::BIGINT AS weight, min(seq) AS f FROM g WHERE regexp_matches(text, '[A-Za-z]{{2,}}') GROUP BY ALL) SELECT paper, page, font, weight FROM f QUALIFY row_number() OVER (PARTITION BY paper, page ORDER BY weight DESC, f) = 1",
    "sentence_tokens": f"""WITH {LINES_SQL}, s AS (SELECT doc_id, line_no, unnest({_PARTS}) AS s, unnest(range(len({_PARTS}))) AS pos FROM lines), p AS (SELECT *, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM s),
 t AS (SELECT doc_id, line_no, i AS id, i * 17 AS a, least(i * 17 + i % 2 * 6, length(raw)) AS z FROM lines, range(6) r(i)) SELECT t.doc_id, t.line_no, t.id, p.pos FROM t JOIN p ON p.doc_id = t.doc_id AND p.line_no = t.line_no AND t.z > t.a AND t.a >= p.a AND t.z <= p.a + length(p.s)""",
    "annotation_sentences": f"""WITH {LINES_SQL}, s AS (SELECT doc_id, line_no, unnest({_PARTS}) AS s, unnest(range(len({_PARTS}))) AS pos FROM lines), f AS (SELECT doc_id, line_no, pos, {sql_trim(f"regexp_replace(s, '{BLANK}+', ' ', 'g')")} AS s FROM s),
 m AS (SELECT doc_id, line_no, {sql_trim(f"regexp_replace(CASE line_no % 4 WHEN 0 THEN substring(raw, 30, 60) WHEN 1 THEN '  ' || raw WHEN 2 THEN 'nowhere' ELSE right(raw, 25) END, '{BLANK}+', ' ', 'g')")} AS t FROM lines)
 SELECT m.doc_id AS paper, m.line_no AS para, min(pos) AS pos FROM m LEFT JOIN f ON f.doc_id = m.doc_id AND f.line_no = m.line_no AND t <> '' AND s <> '' AND (contains(t, s) OR contains(s, left(t, 40))) GROUP BY ALL""",
    "line_checks": rf"""WITH {LINES_SQL}, c AS (SELECT doc_id, line_no, {_CASES} AS c, {sql_trim(_CASES)} AS t FROM lines)
 SELECT doc_id, line_no, regexp_matches(t, '(?i)^\(\s*(?:[A-Z]?\s*[0-9]{{1,3}}(?:\.[0-9]{{1,3}})?[a-z]?|[ivx]{{1,4}})\s*\)$') AS is_tag,
 md5(CASE WHEN starts_with(trim(c), '$$') AND ends_with(trim(c), '$$') AND length(trim(c)) > 4 AND NOT contains(trim(c)[3:-3], '$$') THEN trim(trim(c)[3:-3]) WHEN starts_with(trim(c), '$') AND ends_with(trim(c), '$') AND length(trim(c)) > 2 AND NOT contains(trim(c)[2:-2], '$') THEN trim(trim(c)[2:-2]) ELSE trim(c) END) AS unwrapped,
 md5(CASE WHEN line_no % 12 = 4 THEN 'A t t I D = x' WHEN starts_with(t, '$$') AND ends_with(t, '$$') AND length(t) > 4 THEN {sql_trim('t[3:-3]')} WHEN starts_with(t, '$') AND ends_with(t, '$') AND length(t) > 1 AND NOT contains(t[2:-2], '$') THEN {sql_trim('t[2:-2]')} ELSE t END) AS cleaned,
 md5({_collapse('c')}) AS collapsed, CASE WHEN line_no % 12 = 5 THEN 'image/jpeg' ELSE 'image/png' END AS mime, md5(regexp_replace(CASE WHEN line_no % 12 = 5 THEN t[24:] ELSE t END, '\s+', '', 'g')) AS base64, md5(replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped,
 NOT contains(c, '{{') OR line_no % 12 <> 9 AS balanced, contains(c, ' ') AND (regexp_matches(c, '[a-zA-Z]{{3,}}\s+[a-zA-Z]{{3,}}') OR regexp_matches(c, '(?i)^(?:where|with|for|and|as|based|the|in|at)\b') OR regexp_matches(t, '[:.]$')) AS prose FROM c""",
    "special_types": f"""WITH {LINES_SQL}, s AS (SELECT doc_id, line_no, {sql_trim(SIZED)} AS t, 8 + line_no % 8 AS size, line_no % 2 = 0 AS bold, line_no % 3 + 1 AS page, (line_no * 13 % 100) / 100 AS top FROM lines), k AS (SELECT *, {sql_type('size', 'bold', '10', 'page', 'top')} AS k FROM s) SELECT doc_id, coalesce(k, 'body') AS type, count(*) AS n FROM k GROUP BY ALL""",
    "affine_points": """WITH p AS (SELECT l_linenumber, l_discount, l_quantity, l_tax, 2.0::DOUBLE AS a, 0.5::DOUBLE AS b, 0.5::DOUBLE AS c, -0.875::DOUBLE AS d, l_quantity AS e, l_tax + 3 AS f FROM lineitem), q AS (SELECT l_linenumber, a * l_discount + c * l_quantity + e AS x, b * l_discount + d * l_quantity + f AS y FROM p)
 SELECT l_linenumber, round(sum(x), 3) AS x, round(sum(y), 3) AS y, round(sum(sqrt(x * x + y * y)), 3) AS far FROM q GROUP BY 1""",
    "text_item_scan": """SELECT doc_id AS paper_id, i AS item_idx, CASE i WHEN 0 THEN 'a' || doc_id WHEN 1 THEN 'b' ELSE '' END AS str, CASE WHEN i = 0 AND doc_id % 2 = 0 THEN 'CMR10' ELSE 'f' || (i + 1) END AS font_name, (CASE i WHEN 0 THEN 72 WHEN 1 THEN 30 ELSE 0 END)::DOUBLE AS x, (CASE i WHEN 0 THEN 700 WHEN 1 THEN doc_id % 50 ELSE 0 END)::DOUBLE AS y,
 (CASE i WHEN 0 THEN 5 ELSE 0 END)::DOUBLE AS width, (CASE i WHEN 0 THEN 10 WHEN 1 THEN 9 END)::DOUBLE AS height, CASE i WHEN 0 THEN false WHEN 1 THEN true END AS rotated FROM documents, range(3) r(i)""",
}
