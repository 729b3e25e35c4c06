"""Queries of reading order, joins over columns and pages, tables without rules, vision edits and the formula gate, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import flow, linkage
from paperloom.plans.text_queries import sql_trim
from paperloom.sources.tables import LINES_SQL, lines, table

#: Lines as paragraphs of pages in reading order: 8 on a page, the left column first; some broken off, some going on.
PARAS = [
    "doc_id AS paper", "cast(floor(line_no / 8) AS int) + 1 AS page", "line_no AS seq", "CASE WHEN line_no % 8 = 0 AND doc_id % 3 = 0 THEN 'full' WHEN line_no % 8 < 4 THEN 'left' ELSE 'right' END AS section",
    "CASE WHEN doc_id % 5 = 4 AND line_no % 8 = 0 THEN 'heading' WHEN line_no % 16 = 6 THEN 'caption' WHEN line_no % 24 = 13 THEN 'formula' ELSE 'body' END AS type",
    "CASE WHEN line_no % 8 = 3 THEN raw || ' and so the long-' WHEN line_no % 8 = 4 THEN 'lived word ' || raw WHEN line_no % 8 = 7 THEN raw || ' which' WHEN line_no % 8 = 0 AND doc_id % 2 = 0 THEN 'goes on ' || raw ELSE raw END AS text",
    "CASE WHEN line_no % 8 IN (1, 2, 6) THEN cast(1 + line_no % 2 AS int) END AS unit",
]
CELLS = ["l_suppkey AS paper", "l_linenumber AS page", "row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) AS line_no", "cast(floor(l_quantity / 17) * 8 AS double) AS x", "CASE l_orderkey % 9 WHEN 0 THEN 'a b' WHEN 1 THEN 'x|(3)' WHEN 2 THEN 'name|1.5|20%' ELSE 'r|' || l_partkey || '|-' || l_suppkey END AS cells"]


def _paras(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).selectExpr(*PARAS)


def column_joins(spark: SparkSession, d: str) -> DataFrame:
    return flow.over_columns(_paras(spark, d)).select("paper", "page", F.col("para").cast("long").alias("para"), "n", F.md5("text").alias("text_md5"))


def page_joins(spark: SparkSession, d: str) -> DataFrame:
    return flow.over_pages(_paras(spark, d)).select("paper", "page", F.md5("head").alias("head_md5"), F.md5("tail").alias("tail_md5"))


def order_audit(spark: SparkSession, d: str) -> DataFrame:
    mixed = _paras(spark, d).withColumn("section", F.expr("CASE WHEN seq % 8 = 5 AND paper % 2 = 0 THEN 'left' ELSE section END"))
    return flow.order_audit(mixed)


def borderless_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr(*CELLS).withColumn("cells", F.split("cells", r"\|"))
    return flow.tables_without_rules(rows).groupBy("paper", "page").agg(F.count("*").alias("n"), F.count_distinct("run").alias("runs"), F.min("line_no").cast("long").alias("first_line"))


BLOCKS = ["o_custkey % 100 AS paper", "cast(o_orderkey % 7 AS int) AS page", "CASE o_orderkey % 2 WHEN 0 THEN 'left' ELSE 'right' END AS section", "o_orderkey AS seq", "cast(o_orderkey * 37 % 780 AS double) AS y_top", "cast(o_orderkey * 37 % 780 - 20 - o_custkey % 30 AS double) AS y_bottom"]


def figure_order(spark: SparkSession, d: str) -> DataFrame:
    rows = flow.figure_blocks(table(spark, d, "orders").selectExpr(*BLOCKS))
    return rows.select("seq", F.col("unit").cast("long").alias("unit"), F.col("place").cast("long").alias("place"))


SEGMENTS = """CASE doc_id % 7
 WHEN 0 THEN '{"segments": [{"i": 2, "type": "formula", "latex": " x ", "order": 1.5, "group": 3, "action": "drop"}, {"index": "1", "type": "poem", "group": "1a", "why": "because"}]}'
 WHEN 1 THEN '```json' || chr(10) || '{"segments": [{"type": "title"}, {"type": "body", "action": "explode", "group": 0}, {"type": "footnote", "splitAt": ["Here it ' || doc_id || '", " "]}]}' || chr(10) || '```'
 WHEN 2 THEN '{"segments": [{"type": "title"}, {"type": "body"}]}'
 WHEN 3 THEN '{"segments": [{"i": 5, "type": "body", "action": "split", "parts": [{"type": "formula", "latex": "a"}, {"type": "verse", "at": " from here "}]}, {"type": "table"}]}'
 WHEN 4 THEN '{"segments": [{"i": 0, "inline": [{"find": "x", "latex": "y"}, {"find": "ab", "latex": "c"}, {"find": "abc"}]}, {"i": "?", "type": "body"}]}'
 WHEN 5 THEN '{"segments": []}' ELSE 'no json' END"""


def vision_rows(spark: SparkSession, d: str) -> DataFrame:
    """Segments of a vision model's replies."""
    rows = table(spark, d, "documents").select("doc_id", F.expr(SEGMENTS).alias("reply"), F.lit(3).alias("expected"))
    s = flow.vision_segments(rows, "reply", "expected")
    return s.select("doc_id", "index", "type", "order", "group", "action", "why", "latex", F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["type"], p["at"], p["latex"])), ",").alias("parts"), F.array_join("split_at", ",").alias("split_at"), F.array_join(F.transform("inline", lambda p: F.concat_ws("=", p["find"], p["latex"])), ",").alias("inline"))


EDITS = [*PARAS[:3], "CASE line_no % 6 WHEN 0 THEN 'body' WHEN 3 THEN 'formula' ELSE 'caption' END AS type", "raw AS text", "CASE line_no % 7 WHEN 1 THEN 'drop' WHEN 2 THEN 'merge_next' WHEN 5 THEN 'split' ELSE 'keep' END AS action", "CASE WHEN line_no % 2 = 1 THEN substring(raw, 12, 9) ELSE 'not there at all' END AS split_at"]


def vision_edits(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs after merging, splitting and dropping by a vision model."""
    return flow.edited(lines(spark, d).selectExpr(*EDITS)).select("paper", "page", F.col("para").cast("long").alias("para"), "type", F.md5("text").alias("text_md5"))


GROUPS = ("l_orderkey AS paper", "l_linenumber % 2 AS page", "l_linenumber AS seq", "CASE WHEN l_suppkey % 3 <> 0 THEN l_partkey % 5 + 0.5 END AS ord", "CASE WHEN l_suppkey % 4 = 0 THEN l_partkey % 2 + 1 END AS grp")


def vision_groups(spark: SparkSession, d: str) -> DataFrame:
    """Segments in a vision model's order, with figures and their captions side by side."""
    rows = table(spark, d, "lineitem").selectExpr(*GROUPS).select("paper", "page", "seq", F.col("ord").cast("double").alias("order"), F.col("grp").alias("group"))
    return flow.regrouped(rows).select("paper", F.col("page").cast("long").alias("page"), F.col("seq").cast("long").alias("seq"), F.col("place").cast("long").alias("place"))


GATED = """CASE line_no % 8 WHEN 0 THEN '\\\\frac{' || left(raw, 8) || '}{x}' WHEN 1 THEN left(raw, 20) WHEN 2 THEN '{' || left(raw, 9) WHEN 3 THEN '\\\\begin{cases} a' WHEN 4 THEN '\\\\text{where}~x>0' WHEN 5 THEN 'y' WHEN 6 THEN right(raw, 12) ELSE '' END"""
GATED_TEXT = "CASE line_no % 8 WHEN 0 THEN left(raw, 8) || ' x' WHEN 5 THEN 'x' WHEN 4 THEN 'where x>0' ELSE left(raw, 20) END"


def formula_gate(spark: SparkSession, d: str) -> DataFrame:
    """Recognised formulas accepted where their characters are those of the text layer: share found, share added, and why not."""
    rows = lines(spark, d).select("doc_id", "line_no", F.expr(GATED).alias("latex"), F.expr(GATED_TEXT).alias("t"))
    g = linkage.character_gate(F.col("latex"), F.col("t"))
    return rows.select("doc_id", "line_no", F.round(g["coverage"], 6).alias("coverage"), F.round(g["extra"], 6).alias("extra"), g["reason"].alias("reason"))


def formulas_of_papers(spark: SparkSession, d: str) -> DataFrame:
    """Formulas of all pages in order: those of a vision model where a page has any, else local ones; without single signs and numbers."""
    rows = lines(spark, d).selectExpr("doc_id AS paper", "line_no + 1 AS page", "CASE line_no % 6 WHEN 0 THEN 'x_{' || length(raw) || '}' WHEN 1 THEN '12.5' WHEN 2 THEN 'y' WHEN 3 THEN 'ab' WHEN 4 THEN ' \\\\alpha + ' || left(raw, 3) ELSE '' END AS latex", "CASE WHEN line_no % 2 = 0 THEN 'block' ELSE 'inline' END AS kind", "line_no AS seq")
    vision = rows.filter("page % 3 = 0").selectExpr("paper", "page", "kind", "'v' || latex AS latex", "seq", "seq % 5 = 0 AS dropped").filter("not dropped").drop("dropped")
    return linkage.formulas(vision, rows).select("paper", "number", "page", "kind", "latex")


QUERIES = {f.__name__: f for f in (column_joins, page_joins, order_audit, borderless_tables, figure_order, vision_rows, vision_edits, vision_groups, formula_gate, formulas_of_papers)}

_P = f"p AS (SELECT {', '.join(PARAS)} FROM lines)"
_OPEN = r"NOT regexp_matches({0}, '[.!?。！？:：][\"”’)\]]?$')".replace('\\"', '"')
_T = sql_trim("text")
_GLUE = "CASE WHEN NOT nxt THEN {0} WHEN regexp_matches({0}, '[A-Za-z]-$') THEN {0}[:-2] ELSE {0} || ' ' END"
_NUMBER = "regexp_matches(trim(c), '^[-+−]?[0-9][0-9.,]*%?$')"


def _chars(x: str) -> str:
    return rf"[c for c in string_split(regexp_replace({x}, '\\(?:begin|end)\{{[a-z*]+\}}|\\[A-Za-z]+|\\.|[{{}}^_&\s$]', '', 'g'), '') if c <> '']"


ORACLES = {
    "column_joins": f"""WITH {LINES_SQL}, {_P}, b AS (SELECT *, {_T} AS t FROM p WHERE type = 'body'), o AS (SELECT *, coalesce(lag(section) OVER w = 'left' AND section = 'right' AND {_OPEN.format('lag(t) OVER w')} AND regexp_matches(t, '^[a-z]'), false) AS onto FROM b WINDOW w AS (PARTITION BY paper, page ORDER BY seq)),
 n AS (SELECT *, sum(CASE WHEN onto THEN 0 ELSE 1 END) OVER (PARTITION BY paper, page ORDER BY seq) AS para, coalesce(lead(onto) OVER (PARTITION BY paper, page ORDER BY seq), false) AS nxt FROM o)
 SELECT paper, page, para::BIGINT AS para, count(*) AS n, md5(string_agg({_GLUE.format('t')}, '' ORDER BY seq)) AS text_md5 FROM n GROUP BY paper, page, para""",
    "page_joins": f"""WITH {LINES_SQL}, {_P}, b AS (SELECT *, {_T} AS t FROM p WHERE type IN ('body', 'heading')), e AS (SELECT paper, page, arg_min(type, seq) AS ftype, arg_min(text, seq) AS ftext, arg_min(t, seq) AS ft, arg_max(t, seq) FILTER (type = 'body') AS last FROM b GROUP BY ALL),
 l AS (SELECT *, lag(last) OVER (PARTITION BY paper ORDER BY page) AS tail, lag(page) OVER (PARTITION BY paper ORDER BY page) AS pp FROM e) SELECT paper, page, md5(ftext) AS head_md5, md5(right(tail, 240)) AS tail_md5 FROM l WHERE page = pp + 1 AND ftype = 'body' AND regexp_matches(ft, '^[a-z]') AND {_OPEN.format('tail')} AND length(tail) >= 3""",
    "order_audit": f"""WITH {LINES_SQL}, {_P}, m AS (SELECT * REPLACE (CASE WHEN seq % 8 = 5 AND paper % 2 = 0 THEN 'left' ELSE section END AS section), {_T} AS t FROM p), f AS (SELECT paper, page, coalesce(type = 'body' AND section = 'left' AND max(CASE WHEN type = 'body' AND section = 'right' THEN 1 ELSE 0 END) OVER (PARTITION BY paper, page ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS inv,
 CASE WHEN unit IS NOT NULL AND unit IS DISTINCT FROM lag(unit) OVER w THEN unit END AS run, coalesce(lag(type) OVER w = 'body' AND {_OPEN.format('lag(t) OVER w')} AND type <> 'body' AND NOT regexp_matches(t, '^[a-z]'), false) AS broken FROM m WINDOW w AS (PARTITION BY paper, page ORDER BY seq))
 SELECT paper, page, count(*) FILTER (inv) AS inverted, count(run) - count(DISTINCT run) AS scattered, count(*) FILTER (broken) AS broken FROM f GROUP BY ALL""",
    "borderless_tables": f"""WITH s AS (SELECT {', '.join(CELLS)} FROM lineitem), c AS (SELECT paper, page, line_no, floor(x / 4) AS bx, string_split(cells, '|') AS cells FROM s), k AS (SELECT *, len(cells) >= 2 AND len([c for c in cells if {_NUMBER}]) * 2 >= len(cells) AS ok FROM c),
 l AS (SELECT *, lag(ok) OVER (PARTITION BY paper, page ORDER BY line_no) AS lok, lag(bx) OVER (PARTITION BY paper, page ORDER BY line_no) AS lbx FROM k), r AS (SELECT *, sum(CASE WHEN ok AND coalesce(lok AND lbx = bx, false) THEN 0 ELSE 1 END) OVER (PARTITION BY paper, page ORDER BY line_no) AS run FROM l),
 z AS (SELECT *, count(*) OVER (PARTITION BY paper, page, run) AS n FROM r WHERE ok) SELECT paper, page, count(*) AS n, count(DISTINCT run) AS runs, min(line_no) AS first_line FROM z WHERE n >= 3 GROUP BY paper, page""",
    "figure_order": f"""WITH b AS (SELECT {', '.join(BLOCKS)} FROM orders), l AS (SELECT *, min(y_bottom) OVER (PARTITION BY paper, page, section ORDER BY y_top DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM b), u AS (SELECT *, sum(CASE WHEN low - y_top <= 30 THEN 0 ELSE 1 END) OVER (PARTITION BY paper, page, section ORDER BY y_top DESC, seq)::BIGINT AS unit FROM l)
 SELECT seq, unit, row_number() OVER (PARTITION BY paper, page, section, unit ORDER BY y_top DESC, seq) AS place FROM u""",
    "vision_rows": """WITH d AS (SELECT doc_id, doc_id % 7 AS m FROM documents), s(m, "index", type, "order", "group", action, why, latex, parts, split_at, inline) AS (VALUES (0, 2, 'formula', 1.5, 3, 'drop', NULL, 'x', NULL, NULL, NULL), (0, 1, 'body', NULL, NULL, 'keep', 'because', NULL, NULL, NULL, NULL),
 (1, 0, 'title', NULL, NULL, 'keep', NULL, NULL, NULL, NULL, NULL), (1, 1, 'body', NULL, NULL, 'keep', NULL, NULL, NULL, NULL, NULL), (1, 2, 'footnote', NULL, NULL, 'keep', NULL, NULL, NULL, 'Here it ', NULL), (3, 5, 'body', NULL, NULL, 'split', NULL, NULL, 'formula:a,body:from here', NULL, NULL), (4, 0, 'body', NULL, NULL, 'keep', NULL, NULL, NULL, NULL, 'ab=c'))
 SELECT doc_id, "index"::BIGINT AS "index", type, "order"::DOUBLE AS "order", "group"::BIGINT AS "group", action, why, latex, parts, split_at || doc_id AS split_at, inline FROM d JOIN s USING (m)""",
    "vision_groups": f"""WITH s AS (SELECT {', '.join(GROUPS)} FROM lineitem), o AS (SELECT *, coalesce(ord::DOUBLE, seq::DOUBLE) AS o FROM s),
 h AS (SELECT *, CASE WHEN grp IS NULL THEN o ELSE first_value(o) OVER g END AS ho, CASE WHEN grp IS NULL THEN seq ELSE first_value(seq) OVER g END AS hs FROM o WINDOW g AS (PARTITION BY paper, page, grp ORDER BY o, seq))
 SELECT paper, page::BIGINT AS page, seq::BIGINT AS seq, row_number() OVER (PARTITION BY paper, page ORDER BY ho, hs, o, seq) AS place FROM h""",
    "vision_edits": f"""WITH {LINES_SQL}, s AS (SELECT {', '.join(EDITS)} FROM lines), k AS (SELECT *, {_T} AS t FROM s WHERE action <> 'drop'), o AS (SELECT *, coalesce(lag(action) OVER w = 'merge_next', false) AS onto FROM k WINDOW w AS (PARTITION BY paper, page ORDER BY seq)),
 n AS (SELECT *, sum(CASE WHEN onto THEN 0 ELSE 1 END) OVER w AS run, coalesce(lead(onto) OVER w, false) AS nxt FROM o WINDOW w AS (PARTITION BY paper, page ORDER BY seq)), g AS (SELECT paper, page, run, min(seq) AS seq, arg_min(type, seq) AS type, arg_max(split_at, seq) FILTER (action = 'split') AS mark, string_agg({_GLUE.format('t')}, '' ORDER BY seq) AS text FROM n GROUP BY paper, page, run),
 c AS (SELECT *, CASE WHEN coalesce(mark, '') <> '' THEN instr(text, mark) ELSE 0 END AS cut FROM g), x AS (SELECT paper, page, seq, type, unnest(CASE WHEN cut > 1 THEN [trim(text[:cut - 1]), trim(text[cut:])] ELSE [text] END) AS text, unnest(CASE WHEN cut > 1 THEN [0, 1] ELSE [0] END) AS i FROM c)
 SELECT paper, page, row_number() OVER (PARTITION BY paper, page ORDER BY seq, i) AS para, type, md5(text) AS text_md5 FROM x""",
    "formula_gate": rf"""WITH {LINES_SQL}, s AS (SELECT doc_id, line_no, {GATED.replace(chr(92) * 2, chr(92))} AS latex, {GATED_TEXT} AS t FROM lines), c AS (SELECT *, {_chars('latex')} AS a, [c for c in string_split(regexp_replace(t, '\s', '', 'g'), '') if c <> ''] AS b FROM s),
 m AS (SELECT *, coalesce(list_sum([least(len([x for x in a if x = c]), len([x for x in b if x = c])) for c in list_distinct(b)]), 0)::DOUBLE AS k FROM c), g AS (SELECT doc_id, line_no, latex, a, b, k, CASE WHEN len(b) = 0 THEN 0.0 ELSE k / len(b) END AS coverage, CASE WHEN len(a) = 0 THEN 0.0 ELSE (len(a) - k) / len(a) END AS extra FROM m)
 SELECT doc_id, line_no, round(coverage, 6) AS coverage, round(extra, 6) AS extra, CASE WHEN trim(latex) = '' THEN 'empty' WHEN line_no % 8 = 2 THEN 'unbalanced-brace' WHEN line_no % 8 = 3 THEN 'unbalanced-env' WHEN line_no % 8 = 4 THEN 'prose-in-math' WHEN len(b) <= 3 THEN CASE WHEN coverage = 1 AND extra = 0 THEN '' ELSE 'characters' END WHEN coverage < 0.7 THEN 'coverage' WHEN extra > 0.3 THEN 'extra' ELSE '' END AS reason FROM g""",
    "formulas_of_papers": rf"""WITH {LINES_SQL}, r AS (SELECT doc_id AS paper, line_no + 1 AS page, CASE line_no % 6 WHEN 0 THEN 'x_{{' || length(raw) || '}}' WHEN 1 THEN '12.5' WHEN 2 THEN 'y' WHEN 3 THEN 'ab' WHEN 4 THEN ' \alpha + ' || left(raw, 3) ELSE '' END AS latex, CASE WHEN line_no % 2 = 0 THEN 'block' ELSE 'inline' END AS kind, line_no AS seq FROM lines),
 v AS (SELECT paper, page, kind, trim('v' || latex) AS latex, seq FROM r WHERE page % 3 = 0 AND seq % 5 <> 0), u AS (SELECT * FROM v UNION ALL SELECT paper, page, kind, trim(latex), seq FROM r WHERE (paper, page) NOT IN (SELECT (paper, page) FROM v) AND (kind = 'block' OR length(latex) >= 3)),
 k AS (SELECT * FROM u WHERE length(latex) >= 2 AND NOT regexp_matches(latex, '^[0-9.,;:()\[\]+\-]+$') QUALIFY row_number() OVER (PARTITION BY paper, page, kind, latex ORDER BY seq) = 1)
 SELECT paper, row_number() OVER (PARTITION BY paper ORDER BY page, seq, kind, latex) AS number, page, kind, latex FROM k""",
}
