"""Queries of whole pages, from items to paragraphs; SQL with what each page must give."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import calls, figures, formula, pages
from paperloom.plans.page_queries import text_items
from paperloom.session import shared_dir
from paperloom.sources import papers
from paperloom.sources.store import Store
from paperloom.sources.tables import LINES_SQL, table

#: Items of a page for each customer: item number, text, font, x, y, width, height. A numbered heading, prose with an inline formula of four fonts (a raised glyph among them) that is
#: broken at a hyphen, a display formula with a fraction and a number, a line below it at three distances, a number at the foot, and a note within a table.
ITEMS = """cast(array(
 struct(0, (k % 9 + 1) || '. Results', 'Times-Bold', 72D, 700D, 60D, 12D),
 struct(1, 'We project query ', 'Times-Roman', 72D, 600D, 80D, 10D), struct(2, 'Q', 'CMMI10', 154D, 600D, 7D, 10D), struct(3, '2', 'CMSY10', 164D, 600D, 7D, 10D), struct(4, 'R', 'QZLXPR+MSBM10', 174D, 600D, 7D, 10D), struct(5, chr(97 + k % 26), 'CMMI7', 181.5D, 604D, 4D, 7D),
 struct(6, 'and some optimiza-', 'Times-Roman', 192D, 600D, 340D, 10D), struct(7, 'tion of ' || s || ' elements, as is said here', 'Times-Roman', 72D, 586D, 400D, 10D),
 struct(8, 'y', 'CMMI10', 250D, 550D, 6D, 10D), struct(9, '=', 'CMR10', 260D, 550D, 7D, 10D), struct(10, cast(k % 10 AS string), 'CMR10', 273D, 557D, 5D, 8D), struct(11, cast(k % 7 AS string), 'CMR10', 273D, 543D, 5D, 8D), struct(12, '(' || (k % 90 + 1) || ')', 'CMR10', 510D, 550D, 14D, 10D),
 struct(13, 'where the loss of ' || k || ' is what it is and so on.', 'Times-Roman', 72D, CASE k % 3 WHEN 0 THEN 520D WHEN 1 THEN 531D ELSE 536D END, 300D, 10D), struct(14, cast(k AS string), 'Times-Roman', 300D, 30D, 10D, 10D), struct(15, 'a cell', 'Times-Roman', 100D, 300D, 30D, 10D))
 AS array<struct<i: long, t: string, f: string, x: double, y: double, w: double, h: double>>)"""


def paper_pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Glyphs and paragraphs of the customers' pages."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.lower("c_mktsegment").alias("s")).select("k", F.explode(F.expr(ITEMS)).alias("i"))
    zero = F.lit(0.0)
    items = rows.select(
        F.col("k").alias("paper_id"), F.lit(1).alias("page"), F.col("i.i").cast("long").alias("item_idx"), F.col("i.t").alias("str"), F.col("i.f").alias("font"), F.array("i.h", zero, zero, F.col("i.h"), F.col("i.x"), F.col("i.y")).alias("transform"), F.col("i.w").alias("width"), F.col("i.h").alias("height"), F.lit(612.0).alias("page_w"), F.lit(792.0).alias("page_h"),
    )
    keys = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("paper_id"), F.lit(1).alias("page"))
    bars = keys.select("*", F.lit(272.0).alias("x1"), F.lit(279.0).alias("x2"), F.lit(553.5).alias("y"))
    regions = keys.select(F.col("paper_id").alias("paper"), "page", F.lit(90.0).alias("x1"), F.lit(500.0).alias("x2"), F.lit(280.0).alias("min_y"), F.lit(320.0).alias("max_y"))
    made = pages.page_glyphs(items)
    return made, pages.solved(made, bars, regions)


def page_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs with placeholders for inline formulas, and the first one's token with its place."""
    _, rows = paper_pages(spark, d)
    token = F.get("tokens", F.lit(0))
    return rows.select("paper_id", "para", "section", "x0", "y0", "x1", "y1", "type", "n_lines", "body_index", "text", "translation", "latex", "tag", F.size("tokens").alias("n_tokens"), *(token[c].alias(f"token_{c}") for c in ("latex", "raw", "start", "end")))


#: Lines of a page for each customer: a short line that ends a sentence or doesn't, an indented one after a sentence or within one, a step of 14 points or of 34, a hyphen at a line's end.
BREAKS = """cast(array(
 struct(0, 'alpha beta gamma of ' || k, 72D, 700D, 400D), struct(1, 'it ends here' || CASE WHEN k % 2 = 0 THEN '.' ELSE '' END, 72D, 686D, 200D), struct(2, 'delta words in a line', 72D, 672D, 400D), struct(3, 'more words follow' || CASE WHEN k % 3 = 0 THEN '.' ELSE '' END, 72D, 658D, 400D),
 struct(4, 'and here they go', 72D + CASE WHEN k % 3 < 2 THEN 12 ELSE 0 END, 644D, 388D), struct(5, 'over a gap to an opti-', 72D, CASE WHEN k % 5 = 0 THEN 610D ELSE 630D END, 400D), struct(6, 'mum of them all', 72D, CASE WHEN k % 5 = 0 THEN 596D ELSE 616D END, 400D))
 AS array<struct<i: long, t: string, x: double, y: double, w: double>>)"""


def paragraph_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of pages of prose: where lines begin new ones by gaps, indentation and short lines."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k")).select("k", F.explode(F.expr(BREAKS)).alias("i"))
    ten, zero = F.lit(10.0), F.lit(0.0)
    items = rows.select(F.col("k").alias("paper_id"), F.lit(1).alias("page"), F.col("i.i").alias("item_idx"), F.col("i.t").alias("str"), F.lit("Times-Roman").alias("font"), F.array(ten, zero, zero, ten, F.col("i.x"), F.col("i.y")).alias("transform"), F.col("i.w").alias("width"), ten.alias("height"), F.lit(612.0).alias("page_w"), F.lit(792.0).alias("page_h"))
    return pages.solved(pages.page_glyphs(items)).select("paper_id", "para", "type", "n_lines", "body_index", "text", "x0", "x1")


def formula_crops(spark: SparkSession, d: str) -> DataFrame:
    """Boxes around all display formulas, with what of them other lines cover."""
    _, rows = paper_pages(spark, d)
    mask = F.get("masks", F.lit(0))
    return pages.crops(rows).select("paper_id", "para", "latex", "tag", "x0", "top", "x1", "bottom", F.size("masks").alias("n_masks"), *(F.get(mask, F.lit(i)).alias(f"mask_{c}") for i, c in enumerate(("x0", "top", "x1", "bottom"))))


def snipped_formulas(spark: SparkSession, d: str) -> DataFrame:
    """What a rectangle around the display formula of each page holds, as text and as LaTeX."""
    made, _ = paper_pages(spark, d)
    keys = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("paper"), F.lit(1).alias("page"))
    regions = keys.select("*", F.lit(240.0).alias("x1"), F.lit(300.0).alias("x2"), F.lit(538.0).alias("min_y"), F.lit(570.0).alias("max_y"))
    bars = keys.select(F.col("paper").alias("paper_id"), "page", F.lit(272.0).alias("x1"), F.lit(279.0).alias("x2"), F.lit(553.5).alias("y"))
    return pages.snips(made, regions, bars).select("paper", "n", "text", "latex", "tag")


def page_map(spark: SparkSession, d: str) -> DataFrame:
    """Over all pages of all documents: characters of paragraphs that aren't their glyph's at the place that the map says, and whether texts come back from their translations."""
    rows = text_items(spark, d)
    h, zero = F.col("height"), F.lit(0.0)
    made = pages.page_glyphs(rows.withColumn("font", F.lit("Times-Roman")).withColumn("transform", F.array(h, zero, zero, h, F.col("x"), F.col("y"))))
    return pages.untraced(pages.solved(made), made).select("paper_id", "page", "mismatches", "restored", (F.col("chars") > 0).alias("mapped"))


def glyph_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Glyphs of the customers' pages: text, LaTeX, what they count as, and their boxes."""
    made, _ = paper_pages(spark, d)
    return made.select(F.col("paper").alias("paper_id"), "item", "text", "latex", "role", "math", "body", *(F.round(c, 6).alias(c) for c in ("x", "w", "top", "bottom")))


_G = "named_struct('text', {}, 'x', {}D, 'y', {}D, 'w', {}D, 'h', {}D, 'role', '{}', 'bold', false)"


def _glyphs(*rows: tuple) -> str:
    return f"array({', '.join(_G.format(*r) for r in rows)})"


_IT, _RM, _EX = "math-italic", "body-serif", "math-ext"
#: Two rows with a fraction within a fraction and a sum with limits; an operator set in two fragments; a predicate; rows of a matrix beside an index that is a long way down; a clause.
ROWS_GLYPHS = "CASE event_id % 5 WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN {} WHEN 3 THEN {} ELSE {} END".format(
    _glyphs(("'a'", 100, 540, 5, 10, _IT), ("'='", 108, 540, 6, 10, _RM), ("chr(97 + user_id % 26)", 124, 548, 5, 9, _IT), ("cast(user_id % 10 AS string)", 121, 535, 4, 9, _RM), ("'d'", 121, 524, 4, 9, _IT), ("'='", 108, 490, 6, 10, _RM), ("'∑'", 120, 485, 14, 18, _EX), ("'i'", 124, 476, 3, 7, _IT), ("cast(event_id % 7 AS string)", 124, 506, 5, 7, _RM), ("'x'", 138, 490, 5, 10, _IT)),
    _glyphs(("chr(97 + user_id % 26)", 120, 500, 6, 10, _IT), ("'='", 130, 500, 6, 10, _RM), ("'sof'", 140, 500, 14, 10, _RM), ("'tmax'", 155, 500, 20, 10, _RM), ("'('", 176, 500, 3, 10, _RM), ("'x'", 180, 500, 5, 10, _IT), ("')'", 186, 500, 3, 10, _RM)),
    _glyphs(("'⇒'", 90, 500, 8, 10, "math-symbol"), ("chr(97 + user_id % 26)", 101, 500, 5, 10, _IT), ("'is'", 110, 500, 8, 10, _RM), ("'positive'", 121, 500, 30, 10, _RM)),
    _glyphs(("'['", 100, 500, 4, 30, _EX), ("cast(user_id % 10 AS string)", 106, 510, 5, 10, _RM), ("'0'", 130, 510, 5, 10, _RM), ("'0'", 106, 490, 5, 10, _RM), ("cast(event_id % 7 AS string)", 130, 490, 5, 10, _RM), ("']'", 140, 500, 4, 30, _EX)),
    _glyphs(("'it'", 90, 500, 8, 10, _RM), ("'is'", 100, 500, 8, 10, _RM), ("'in'", 110, 500, 8, 10, _RM), ("'='", 120, 500, 6, 10, _RM), ("chr(97 + user_id % 26)", 130, 500, 5, 10, _IT)),
)


def formula_rows(spark: SparkSession, d: str) -> DataFrame:
    """Formulas of several rows, operators set in fragments and predicates: LaTeX and verdicts."""
    bars = "CASE event_id % 5 WHEN 0 THEN array(named_struct('x1', 119D, 'x2', 133D, 'y', 545D), named_struct('x1', 120D, 'x2', 126D, 'y', 532D)) END"
    rows = table(spark, d, "events").select("event_id", F.expr(ROWS_GLYPHS).alias("glyphs"), F.expr(bars).alias("bars"), F.lit(72.0).alias("col_left"), F.lit(540.0).alias("col_right"))
    return formula.formulas(rows, {"event_id": "long"}).select("event_id", "latex", "display", F.round("score", 6).alias("score"))


#: Four kinds of pages as type, x0, x1, y_top, y_bottom, in the order in which text comes before figures: tables over a column of text beside another; a figure and a table in one column, 74 points apart;
#: full-width figures above and below the text; one column, with a caption that has no figure.
FIGURE_PAGES = """cast(CASE k % 4
 WHEN 0 THEN array(struct('body', 72, 290, 460, 100), struct('body', 320, 540, 600, 100), struct('table', 72, 290, 720 - k % 5, 690), struct('caption', 72, 290, 680, 670), struct('table', 80, 280, 600, 560), struct('table', 80, 280, 550, 500), struct('caption', 72, 290, 490, 480), struct('figure', 320, 540, 720, 650), struct('caption', 320, 540, 640, 630), struct('footnote', 72, 290, 80, 70))
 WHEN 1 THEN array(struct('body', 72, 290, 720, 100), struct('body', 320, 540, 720, 640), struct('body', 320, 540, 360, 100), struct('figure', 330, 420, 620, 534), struct('figure', 440, 530, 620, 534 + k % 3), struct('caption', 320, 540, 520, 510), struct('table', 320, 540, 460, 400), struct('caption', 320, 540, 390, 380))
 WHEN 2 THEN array(struct('body', 72, 290, 560, 320), struct('body', 320, 540, 560, 320), struct('figure', 72, 290, 720, 600), struct('figure', 320, 540, 720, 600), struct('caption', 72, 540, 590, 580), struct('figure', 100, 500, 300, 200), struct('caption', 72, 540, 190, 180), struct('footnote', 72, 290, 80, 70))
 ELSE array(struct('body', 72, 540, 720, 600), struct('body', 72, 540, 400, 300), struct('figure', 100, 500, 590, 500), struct('figure', 100, 500, 490, 440), struct('caption', 72, 540, 430, 420), struct('caption', 72, 540, 200, 190 + k % 2), struct('heading', 72, 540, 290, 280)) END
 AS array<struct<type: string, x0: double, x1: double, y_top: double, y_bottom: double>>)"""


def figure_places(spark: SparkSession, d: str) -> DataFrame:
    """Reading order of the customers' pages with figures, and their units."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k")).select("k", F.posexplode(F.expr(FIGURE_PAGES)).alias("seq", "b"))
    gutter = F.when(F.col("k") % 4 != 3, F.lit(305.0))
    return figures.reading_order(rows.select(F.col("k").alias("paper"), F.lit(1).alias("page"), "seq", "b.*", gutter.alias("gutter"))).drop("page")


def call_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Translations of all conversation turns by a service with moods: how each came about after how many calls."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^.!?]+[.!?]"), F.lit(0)).alias("sentences"))
    out = calls.in_rounds(rows, calls.stub)
    return out.select("conv_id", "turn", "mode", "calls", "attempt", "json", "budget", "note", F.coalesce("translation", F.lit("")).alias("translation"), F.coalesce(F.size("parts"), F.lit(-1)).alias("n_parts"))


def _stored(rows: DataFrame, note: str) -> DataFrame:
    """Papers of documents: a note, and a translation by language."""
    main = F.to_json(F.struct(F.array(F.struct(F.lit("n").alias("id"), F.lit(1).alias("page"), F.expr(note).alias("text"))).alias("annotations"), F.create_map(F.coalesce("lang", F.lit("?")), F.coalesce("source", F.lit("?"))).alias("translations")))
    return papers.restored(rows.select(F.col("doc_id").cast("string").alias("key"), main.alias("main"), F.lit(None).cast("string").alias("backup")))


def paper_store(spark: SparkSession, d: str) -> DataFrame:
    """All documents taken into a store, then those with labels once more with another note: what the store holds then."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", 16)
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.left(F.coalesce("text", F.lit("")), F.lit(20)).alias("head"))
    store.write(_stored(docs, "head"))
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    store.write(_stored(docs.join(labels, "doc_id"), "'quality ' || quality"))
    note = F.get("annotations", F.lit(0))
    return store.read().select(F.col("key").cast("long").alias("doc_id"), note["text"].alias("note"), F.array_join(F.map_keys("translations"), ",").alias("languages"))


QUERIES = {f.__name__: f for f in (page_paragraphs, paragraph_breaks, snipped_formulas, formula_crops, page_map, glyph_boxes, formula_rows, figure_places, call_rounds, paper_store)}
_C = "WITH c AS (SELECT c_custkey::BIGINT AS k, lower(c_mktsegment) AS s FROM customer)"
ORACLES = {
    "paper_store": "SELECT doc_id, coalesce('quality ' || q, left(coalesce(text, ''), 20)) AS note, coalesce(lang, '?') AS languages FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id)",
    # the course of a request by the service's mood and its number of sentences
    "call_rounds": r"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(text, '')) % 8 AS m, len(regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]')) AS n FROM conversations),
 o(m, mode, calls, attempt, json, budget, note) AS (VALUES (0, 'sentence-json', 1, 0, true, 8192, ''), (1, 'sentence-json', 2, 0, false, 8192, 'no JSON mode'), (2, 'sentence-json', 2, 1, true, 8192, 'another number of sentences'), (3, 'unaligned', 3, 2, false, 8192, 'another number of sentences'),
  (4, 'paragraph-split', 3, 2, false, 8192, 'another number of sentences'), (5, 'sentence-json', 2, 0, true, 16000, 'budget spent'), (6, 'failed', 1, 0, true, 8192, 'auth'), (7, 'sentence-json', 3, 1, false, 8192, 'no JSON mode'))
 SELECT conv_id, turn, CASE WHEN trim(text, E' \t\n\r') = '' THEN 'empty' WHEN m = 6 THEN 'failed' WHEN n > 1 THEN mode WHEN n = 1 THEN 'sentence-json' ELSE 'unaligned' END AS mode, CASE WHEN trim(text, E' \t\n\r') = '' THEN 0 WHEN n > 1 THEN calls WHEN m = 5 THEN 2 ELSE 1 END AS calls,
  CASE WHEN n > 1 THEN attempt ELSE 0 END AS attempt, n > 1 AND json AS json, CASE WHEN m = 5 THEN 16000 ELSE 8192 END AS budget, CASE WHEN n > 1 OR m IN (5, 6) THEN note ELSE '' END AS note,
  CASE WHEN m = 6 OR trim(text, E' \t\n\r') = '' THEN '' WHEN n > 1 AND m NOT IN (3, 4) THEN '整段译文在此处。' WHEN m = 4 THEN (SELECT string_agg('第' || i || '句译文在此。', '' ORDER BY i) FROM range(1, greatest(n, 1) + 1) r(i)) ELSE '整段译文在此处，只有一句。' END AS translation,
  CASE WHEN m = 6 OR trim(text, E' \t\n\r') = '' THEN -1 WHEN n > 1 AND m = 3 THEN -1 WHEN n > 1 THEN n WHEN n = 1 THEN 1 ELSE -1 END AS n_parts
 FROM t JOIN o USING (m)""",
    "figure_places": """WITH c AS (SELECT c_custkey::BIGINT AS paper, c_custkey % 4 AS m FROM customer),
 o(m, seqs, units) AS (VALUES (0, [2, 3, 4, 5, 6, 0, 7, 8, 1, 9], [1, 1, 2, 2, 2, NULL, 3, 3, NULL, NULL]), (1, [0, 1, 3, 4, 5, 6, 7, 2], [NULL, NULL, 1, 1, 1, 2, 2, NULL]), (2, [2, 3, 4, 0, 1, 5, 6, 7], [1, 1, 1, NULL, NULL, 2, 2, NULL]), (3, [0, 2, 3, 4, 1, 6, 5], [NULL, 1, 1, 1, NULL, NULL, 2]))
 SELECT paper, seqs[i]::BIGINT AS seq, (i - 1)::INT AS place, units[i]::INT AS unit FROM c JOIN o USING (m), range(1, 11) r(i) WHERE i <= len(seqs)""",
    # 2.2 for bars, sums and tall brackets, 1.8 for mostly mathematics (in part 1.4), 1.3 for a sign without words, 1.8 for a sign at the beginning, 0.9 for standing in
    "formula_rows": r"""WITH e AS (SELECT event_id, event_id % 5 AS m, chr((97 + user_id % 26)::INT) AS c, user_id % 10 AS u, event_id % 7 AS k FROM events)
 SELECT event_id, CASE m WHEN 0 THEN '\begin{aligned} a = \frac{' || c || '}{\frac{' || u || '}{d}} \\ = \sum_{i}^{' || k || '} x \end{aligned}' WHEN 1 THEN c || ' = \mathrm{sof} \mathrm{tmax} ( x )' WHEN 2 THEN '\Rightarrow ' || c || ' is \mathrm{positive}' WHEN 3 THEN '\begin{bmatrix} ' || u || ' & 0 \\ 0 & ' || k || ' \end{bmatrix}' ELSE 'it is in = ' || c END AS latex,
 m <> 4 AS display, CASE m WHEN 0 THEN 2.2 + 1.8 + 1.3 + 0.9 WHEN 1 THEN 1.3 + 0.9 WHEN 2 THEN 1.3 + 1.8 + 0.9 WHEN 3 THEN 2.2 + 0.9 ELSE 0 END::DOUBLE AS score FROM e""",
    "page_paragraphs": rf"""{_C},
 p AS (
  SELECT k, 0 AS para, 'heading' AS type, 1 AS n_lines, NULL::INT AS body_index, (k % 9 + 1) || '. Results' AS text, NULL AS raw, NULL AS tl, NULL AS latex, NULL AS tag, 72 AS x0, 700 - 3 AS y0, 132 AS x1, 700 + 9 AS y1 FROM c
  UNION ALL SELECT k, 1, 'body', 2, 1, 'We project query Q ∈ ℝ' || chr((97 + k % 26)::INT) || ' and some optimization of ' || s || ' elements, as is said here', 'Q ∈ ℝ' || chr((97 + k % 26)::INT), 'Q \in \mathbb{{R}}^{{' || chr((97 + k % 26)::INT) || '}}', NULL, NULL, 72, 586 - 2.5, 532, 604 + 0.75 * 7 FROM c
  UNION ALL SELECT k, 2, 'formula', 1, NULL, 'y = ' || k % 10 || k % 7 || ' (' || (k % 90 + 1) || ')', NULL, NULL, 'y = \frac{{' || k % 10 || '}}{{' || k % 7 || '}}', '(' || (k % 90 + 1) || ')', 250, 543 - 2, 524, 557 + 6 FROM c
  UNION ALL SELECT k, 3, 'body', 1, 2, 'where the loss of ' || k || ' is what it is and so on.', NULL, NULL, NULL, NULL, 72, CASE k % 3 WHEN 0 THEN 520 WHEN 1 THEN 531 ELSE 536 END - 2.5, 372, CASE k % 3 WHEN 0 THEN 520 WHEN 1 THEN 531 ELSE 536 END + 7.5 FROM c)
 SELECT k AS paper_id, para, 'full' AS section, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, type, n_lines, body_index, text, CASE WHEN raw IS NULL THEN text ELSE replace(text, raw, '⟦M1⟧') END AS translation, latex, tag, CASE WHEN raw IS NULL THEN 0 ELSE 1 END AS n_tokens, tl AS token_latex, raw AS token_raw, (strpos(text, raw) - 1)::INT AS token_start, (strpos(text, raw) - 1 + length(raw))::INT AS token_end FROM p""",
    "snipped_formulas": rf"""{_C} SELECT k AS paper, 4::BIGINT AS n, k % 10 || ' y = ' || k % 7 AS text, 'y = \frac{{' || k % 10 || '}}{{' || k % 7 || '}}' AS latex, '' AS tag FROM c""",
    "paragraph_breaks": f"""{_C},
 p AS (
  SELECT k, 0 AS i, 'alpha beta gamma of ' || k AS t, true AS b, 72 AS x, 472 AS r FROM c UNION ALL SELECT k, 1, 'it ends here' || CASE WHEN k % 2 = 0 THEN '.' ELSE '' END, false, 72, 272 FROM c UNION ALL SELECT k, 2, 'delta words in a line', k % 2 = 0, 72, 472 FROM c
  UNION ALL SELECT k, 3, 'more words follow' || CASE WHEN k % 3 = 0 THEN '.' ELSE '' END, false, 72, 472 FROM c UNION ALL SELECT k, 4, 'and here they go', k % 3 = 0, CASE WHEN k % 3 < 2 THEN 84 ELSE 72 END, CASE WHEN k % 3 < 2 THEN 472 ELSE 460 END FROM c UNION ALL SELECT k, 5, 'over a gap to an optimum of them all', k % 5 = 0, 72, 472 FROM c),
 n AS (SELECT *, sum(b::INT) OVER (PARTITION BY k ORDER BY i) - 1 AS para FROM p)
 SELECT k AS paper_id, para::INT AS para, 'body' AS type, (count(*) + max((i = 5)::INT))::INT AS n_lines, (para + 1)::INT AS body_index, string_agg(t, ' ' ORDER BY i) AS text, min(x)::DOUBLE AS x0, max(r)::DOUBLE AS x1 FROM n GROUP BY k, para""",
    # 4 points of room; a line 3.5 points nearer takes some of it, one that reaches into the formula's height is masked
    "formula_crops": rf"""{_C} SELECT k AS paper_id, 2 AS para, 'y = \frac{{' || k % 10 || '}}{{' || k % 7 || '}}' AS latex, '(' || (k % 90 + 1) || ')' AS tag, 246.0::DOUBLE AS x0, (792 - (557 + 6 + 4))::DOUBLE AS top, 528.0::DOUBLE AS x1, CASE k % 3 WHEN 1 THEN 792 - 538.5 ELSE 792 - 537 END::DOUBLE AS bottom,
 CASE k % 3 WHEN 2 THEN 1 ELSE 0 END AS n_masks, CASE k % 3 WHEN 2 THEN 246 END::DOUBLE AS mask_x0, CASE k % 3 WHEN 2 THEN 792 - 543.5 END::DOUBLE AS mask_top, CASE k % 3 WHEN 2 THEN 372 END::DOUBLE AS mask_x1, CASE k % 3 WHEN 2 THEN 792 - 537 END::DOUBLE AS mask_bottom FROM c""",
    "page_map": rf"""WITH {LINES_SQL}, p AS (SELECT doc_id, line_no, unnest(range(greatest(0, (length(raw) - 1) // 40) + 1)) AS part, raw FROM lines), i AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part) - 1 AS seq FROM p WHERE trim(substring(raw, part * 40 + 1, 40)) <> '')
 SELECT DISTINCT doc_id AS paper_id, (seq // 40)::INT AS page, 0::BIGINT AS mismatches, true AS restored, true AS mapped FROM i""",
    "glyph_boxes": rf"""{_C},
 g(item, text, latex, role, math, x, y, w, h) AS (
  SELECT * FROM (VALUES (1, 'We project query ', 'We project query', 'body-serif', false, 72.0, 600.0, 80.0, 10.0), (2, 'Q', 'Q', 'math-italic', true, 154.0, 600.0, 7.0, 10.0), (3, '∈', '\in', 'math-symbol', true, 164.0, 600.0, 7.0, 10.0), (4, 'ℝ', '\mathbb{{R}}', 'math-bb', true, 174.0, 600.0, 7.0, 10.0), (6, 'and some optimiza-', 'and some optimiza-', 'body-serif', false, 192.0, 600.0, 340.0, 10.0),
   (8, 'y', 'y', 'math-italic', true, 250.0, 550.0, 6.0, 10.0), (9, '=', '=', 'body-serif', true, 260.0, 550.0, 7.0, 10.0), (15, 'a cell', 'a cell', 'body-serif', false, 100.0, 300.0, 30.0, 10.0))),
 v AS (
  SELECT k, item, text, latex, role, math, x, y, w, h FROM c, g UNION ALL SELECT k, 0, (k % 9 + 1) || '. Results', (k % 9 + 1) || '. Results', 'body-serif', false, 72, 700, 60, 12 FROM c
  UNION ALL SELECT k, 5, chr((97 + k % 26)::INT), chr((97 + k % 26)::INT), 'math-italic', true, 181.5, 604, 4, 7 FROM c UNION ALL SELECT k, 7, 'tion of ' || s || ' elements, as is said here', 'tion of ' || s || ' elements, as is said here', 'body-serif', false, 72, 586, 400, 10 FROM c
  UNION ALL SELECT k, 10, (k % 10)::VARCHAR, (k % 10)::VARCHAR, 'body-serif', false, 273, 557, 5, 8 FROM c UNION ALL SELECT k, 11, (k % 7)::VARCHAR, (k % 7)::VARCHAR, 'body-serif', false, 273, 543, 5, 8 FROM c UNION ALL SELECT k, 12, '(' || (k % 90 + 1) || ')', '(' || (k % 90 + 1) || ')', 'body-serif', false, 510, 550, 14, 10 FROM c
  UNION ALL SELECT k, 13, 'where the loss of ' || k || ' is what it is and so on.', 'where the loss of ' || k || ' is what it is and so on.', 'body-serif', false, 72, CASE k % 3 WHEN 0 THEN 520 WHEN 1 THEN 531 ELSE 536 END, 300, 10 FROM c UNION ALL SELECT k, 14, k::VARCHAR, k::VARCHAR, 'body-serif', false, 300, 30, 10, 10 FROM c)
 SELECT k AS paper_id, item::BIGINT AS item, text, latex, role, math, 10.0::DOUBLE AS body, x::DOUBLE AS x, w::DOUBLE AS w, round(y + 0.82 * h, 6)::DOUBLE AS top, round(y - 0.24 * h, 6)::DOUBLE AS bottom FROM v""",
}
