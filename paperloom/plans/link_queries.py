"""Queries of linkage, caches, order statistics and history, and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.requests import bound
from paperloom.operators import linkage, reports, sequences
from paperloom.plans.text_queries import SQL_UNTRANSLATABLE, sql_count, sql_latex, sql_trim
from paperloom.sources.tables import LINES_SQL, lines, table

TAG = "e1"
#: Paragraphs of an archive: lines with a short fingerprint; some have their own translation, some a key.
PARAS = [
    "doc_id AS page", "line_no AS para", "CASE WHEN trim(line) = '' THEN '' ELSE md5(line) END AS fp", "CASE WHEN (doc_id + line_no) % 5 = 0 THEN 'k' || doc_id || '_' || line_no ELSE '' END AS cache_key",
    "CASE WHEN (doc_id + line_no) % 7 = 0 THEN 'own ' || line_no WHEN line_no % 7 = 1 THEN '  ' ELSE NULL END AS translation", "line",
]
#: Entries of the cache, one of four kinds of key for some of the lines.
CACHE = [
    "CASE (doc_id * 3 + line_no) % 4 WHEN 0 THEN 'k' || doc_id || '_' || line_no WHEN 1 THEN doc_id || '_e1_' || md5(line) WHEN 2 THEN doc_id || '_' || md5(line) ELSE 'x' || doc_id || '_' || line_no END AS key",
    "CASE WHEN line_no % 11 = 3 THEN ' ' ELSE 'cached ' || line_no END AS value",
]


def _paras(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).selectExpr(*PARAS)


def _cache(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).filter("line_no % 2 = 0").selectExpr(*CACHE).groupBy("key").agg(F.max("value").alias("value"))


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = linkage.cache_lookup(_paras(spark, d).drop("line"), _cache(spark, d), TAG)
    return found.select("page", "para", "found", F.col("tier").cast("int").alias("tier"))


def sentence_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Sentence lists of each line: of four candidates the first with as many items as the line has sentences."""
    n = F.size(F.split("raw", r"\. ")).cast("int")
    item = lambda k, s: F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(F.lit(s), i.cast("string")))
    rows = lines(spark, d).withColumn("n", n)
    lists = [F.when(F.col("line_no") % 3 == 0, item(F.col("n"), "a")), F.when(F.col("line_no") % 2 == 0, F.concat(item(F.col("n"), "b"), F.array(F.lit("more")))), F.when(F.col("line_no") % 5 == 1, F.transform(item(F.col("n"), "c"), lambda x: F.when(x == "c2", F.lit(" ")).otherwise(x))), F.when(F.col("line_no") % 4 != 1, item(F.col("n"), "d"))]
    return rows.select("doc_id", "line_no", F.array_join(linkage.first_valid(lists, F.col("n")), "|").alias("sentences"))


def archive_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d)
    old = rows.select("doc_id", "line_no", F.expr("CASE WHEN line_no % 3 = 0 THEN 'old ' || line_no ELSE '' END").alias("translation"), F.expr("CASE WHEN line_no % 2 = 0 THEN 'ok' || doc_id END").alias("cache_key"))
    new = rows.filter("line_no % 4 <> 3").select("doc_id", "line_no", F.expr("CASE WHEN line_no % 5 = 0 THEN 'new ' || line_no ELSE ' ' END").alias("translation"), F.expr("CASE WHEN line_no % 7 = 0 THEN 'nk' || doc_id END").alias("cache_key"))
    return linkage.upsert(old, new, ["doc_id", "line_no"], ["translation", "cache_key"])


def stale_prune(spark: SparkSession, d: str) -> DataFrame:
    """Cache entries of lines that are kept when false translations are pruned."""
    rows = lines(spark, d).select("doc_id", "line_no", T.trimmed(F.col("line")).alias("t"))
    # cheap tests first: only lines that may be clauses of some length are stripped of LaTeX, and that once
    words = lambda plain: F.size(F.regexp_extract_all(plain, F.lit("[A-Za-z]{2,}"), F.lit(0)))
    clause = lambda c: (T.cjk_count(c["plain"]) == 0) & ((c["line_no"] % 9 == 0) | (words(c["plain"]) >= 2))
    long = (F.length("t") > 60) & F.col("t").rlike("[,;:]")
    stale = F.when(long, F.when(T.clause_run(F.col("t")) & ~T.untranslatable(F.col("t")), bound(clause, plain=T.without_latex(F.col("t")), line_no=F.col("line_no"))))
    marked = rows.select("doc_id", "line_no", F.coalesce(stale, F.lit(False)).alias("stale"))
    return marked.groupBy("doc_id").agg(F.count_if(~F.col("stale")).alias("kept"), F.sum(F.when(~F.col("stale"), F.col("line_no"))).alias("check_sum")).filter("kept > 0")


def identity_match(spark: SparkSession, d: str) -> DataFrame:
    """For each document the first one of the same name and size under another path."""
    rows = table(spark, d, "documents").select("doc_id", F.lower(F.concat_ws("-", "source", "lang")).alias("name"), F.col("n_chars").alias("size"), F.expr("doc_id % 3").alias("path"))
    return linkage.moved(rows.filter("size <> 0"), ["name", "size"], "path", "doc_id").select("doc_id", "other_id")


def item_match(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    items = parts.selectExpr("p_partkey AS item", "'/lib/' || p_partkey AS path", "p_name || (p_partkey % 40) AS name", "p_size * 100 + p_partkey % 700 AS size")
    papers = table(spark, d, "lineitem").selectExpr("l_partkey AS k", "l_orderkey * 10 + l_linenumber AS paper").join(parts.selectExpr("p_partkey AS k", "p_name", "p_size"), "k")
    papers = papers.selectExpr("paper", "CASE WHEN paper % 3 = 0 THEN '/lib/' || k ELSE '/tmp/' || k END AS path", "CASE WHEN paper % 5 = 0 THEN p_name || (k % 40) ELSE 'none' || paper END AS name", "p_size * 100 + k % 700 + IF(paper % 2 = 0, 0, 7) AS size")
    return linkage.item_match(papers, items).groupBy("tier").agg(F.count("*").alias("n"), F.sum("item").alias("items"))


def annotation_join(spark: SparkSession, d: str) -> DataFrame:
    """Annotations (events) of each page: on a paragraph, or orphans."""
    notes = table(spark, d, "events").selectExpr("event_id", "user_id AS page", "event_id % 60 AS para")
    paras = lines(spark, d).selectExpr("doc_id AS page", "line_no AS para")
    hit = notes.join(paras, ["page", "para"]).withColumn("kind", F.lit("paragraph"))
    orphan = notes.join(paras, ["page", "para"], "left_anti").withColumn("kind", F.lit("orphan"))
    return hit.unionByName(orphan).groupBy("page", "kind").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def qa_to_paragraph(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose selection's beginning occurs in paragraphs of their page: every line asks, with 40 characters from its eleventh on."""
    rows = lines(spark, d).select(F.col("doc_id").alias("paper"), F.lit(1).alias("page"), F.col("line_no").alias("id"), F.col("raw").alias("text"))
    asked = rows.select("paper", "page", "id", F.substring("text", 11, 40).alias("selected"))
    return reports.answers(rows, asked).select(F.col("paper").alias("page"), F.col("id").alias("asked"), "n", "para")


def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).select(F.col("doc_id").alias("paper"), F.col("line_no").alias("page"), (F.col("line_no") % 2 == 0).alias("highlighted"), (F.col("line_no") % 3 == 0).alias("translated"), T.untranslatable(F.col("line")).alias("formula_only"))
    return linkage.coverage(rows)


def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    pages = lines(spark, d).filter("(doc_id + line_no * line_no) % 5 < 3").selectExpr("doc_id", "line_no + 1 AS page")
    return sequences.ranges(pages, ["doc_id"], "page")


def formula_index(spark: SparkSession, d: str) -> DataFrame:
    """Formulas of pages: recognised ones, and local ones of the other pages; of equal ones the first."""
    rows = lines(spark, d).selectExpr("doc_id", "line_no AS page", "line").withColumn("latex", F.regexp_extract("line", r"\$([^$]*)\$", 1)).filter("length(latex) > 1")
    vision = rows.filter("page % 2 = 0").selectExpr("doc_id", "page", "'v ' || latex AS latex")
    local = rows.join(vision.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti").select("doc_id", "page", "latex")
    return linkage.first_rows(vision.unionByName(local), ["doc_id", "latex"], ["page"])


TURNS = "CASE WHEN (conv_id + turn) % 9 = 4 THEN '[error] ' || text ELSE text END"


def history_window(spark: SparkSession, d: str) -> DataFrame:
    """The last 8 turns of each chat without failed ones, turns of one role in a row as one."""
    turns = table(spark, d, "conversations").withColumn("text", F.expr(TURNS)).filter("not startswith(text, '[error]')")
    return sequences.history(turns, 8, 1 << 30).select("conv_id", "run", "role", F.md5("text").alias("text_md5"))


def history_cut(spark: SparkSession, d: str) -> DataFrame:
    """The last 20 turns of each chat, each cut at 4000 characters."""
    rows = sequences.last_rows(table(spark, d, "conversations"), ["conv_id"], "turn", 20)
    return rows.select("conv_id", "turn", F.md5(F.left("text", F.lit(4000))).alias("text_md5"))


def qa_retention(spark: SparkSession, d: str) -> DataFrame:
    return sequences.last_rows(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 200).groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def merge_role_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences.same_runs(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")
    return rows.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def line_step_median(spark: SparkSession, d: str) -> DataFrame:
    """Upper median of the steps between lines that lie within 0.85 and 2 bodies."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    rows = table(spark, d, "lineitem").select("l_orderkey", F.abs(F.col("l_quantity") - F.lag("l_quantity").over(order)).alias("step")).filter("step between 8.5 and 20")
    return sequences.order_statistics(rows, ["l_orderkey"], "step", {"median_step": 0.5})


def margin_order_stats(spark: SparkSession, d: str) -> DataFrame:
    return sequences.order_statistics(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", {"low": 0.04, "left": 0.25, "right": 0.75, "high": 0.96})


def weighted_mode(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return sequences.weighted_mode(rows, ["l_suppkey"], F.floor(F.col("l_quantity") * 2 + 0.5) / 2, F.col("l_linenumber"), F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def join_suite(spark: SparkSession, d: str) -> DataFrame:
    """Inner, left, semi, anti and theta joins over orders and customers."""
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    on = F.col("o_custkey") == F.col("c_custkey")
    n = {
        "inner": o.join(c, on), "left": c.join(o, on, "left"), "semi": c.join(o, on, "left_semi"), "anti": c.join(o, on, "left_anti"), "full": c.join(o, on & (F.col("o_totalprice") > 1e5), "full"),
        "theta": o.join(c, on & (F.col("o_totalprice") > F.col("c_acctbal") * 20)),
    }
    out = None
    for k, df in n.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def labelled_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"), F.median("n_chars").alias("median_chars"))


QUERIES = {f.__name__: f for f in (cache_lookup, sentence_cache_lookup, archive_upsert, stale_prune, identity_match, item_match, annotation_join, qa_to_paragraph, coverage_report, page_ranges, formula_index, history_window, history_cut, qa_retention, merge_role_runs, line_step_median, margin_order_stats, weighted_mode, join_suite, labelled_quality)}

_ST = sql_latex("t")
_REST = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '⟦[^⟧]*⟧', ' ', 'g'), '(?i)https?://\S+', ' ', 'g'), '\[\s*[0-9]+(?:\s*[,–\-]\s*[0-9]+)*\s*\]', ' ', 'g'), '(?i)\(\s*[a-z0-9]{1,3}\s*\)', ' ', 'g')"
_FILL = "CASE WHEN trim(coalesce({0}, '')) <> '' THEN {0} END"
ORACLES = {
    "cache_lookup": f"""WITH {LINES_SQL}, p AS (SELECT {', '.join(PARAS)} FROM lines), c AS (SELECT key, max(value) AS value FROM (SELECT {', '.join(CACHE)} FROM lines WHERE line_no % 2 = 0) GROUP BY key), v AS (SELECT key, value FROM c WHERE trim(value) <> ''),
 j AS (SELECT page, para, {_FILL.format('translation')} AS t1, a.value AS t2, b.value AS t3, e.value AS t4 FROM p LEFT JOIN v a ON fp <> '' AND a.key = cache_key AND cache_key <> '' LEFT JOIN v b ON fp <> '' AND b.key = page || '_e1_' || fp LEFT JOIN v e ON fp <> '' AND e.key = page || '_' || fp)
 SELECT page, para, coalesce(t1, t2, t3, t4, '') AS found, CASE WHEN t1 IS NOT NULL THEN 1 WHEN t2 IS NOT NULL THEN 2 WHEN t3 IS NOT NULL THEN 3 WHEN t4 IS NOT NULL THEN 4 ELSE 0 END AS tier FROM j""",
    "sentence_cache_lookup": f"""WITH {LINES_SQL}, n AS (SELECT doc_id, line_no, len(string_split(raw, '. ')) AS n FROM lines), i AS (SELECT doc_id, line_no, n, range(1, n + 1) AS r FROM n)
 SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN array_to_string(['a' || x for x in r], '|') WHEN line_no % 5 = 1 AND n < 2 THEN array_to_string(['c' || x for x in r], '|') WHEN line_no % 4 <> 1 THEN array_to_string(['d' || x for x in r], '|') END AS sentences FROM i""",
    "archive_upsert": f"""WITH {LINES_SQL} SELECT doc_id, line_no, CASE WHEN line_no % 5 = 0 THEN 'new ' || line_no WHEN line_no % 3 = 0 THEN 'old ' || line_no ELSE ' ' END AS translation, CASE WHEN line_no % 7 = 0 THEN 'nk' || doc_id WHEN line_no % 2 = 0 THEN 'ok' || doc_id END AS cache_key FROM lines WHERE line_no % 4 <> 3""",
    "stale_prune": rf"""WITH {LINES_SQL}, t AS (SELECT doc_id, line_no, {sql_trim('line')} AS t FROM lines), u AS (SELECT *, {_REST} AS r, {_ST} AS p FROM t)
 SELECT doc_id, count(*) AS kept, sum(line_no)::BIGINT AS check_sum FROM u WHERE NOT (t <> '' AND NOT {SQL_UNTRANSLATABLE} AND length(t) > 60 AND regexp_matches(lower(t), '[,;:]') AND {sql_count('lower(t)', rf'\b(?:{T.FUNCTION_WORDS})\b')} >= 2
 AND {sql_count('p', T.CJK)} = 0 AND (line_no % 9 = 0 OR {sql_count('p', '[A-Za-z]{2,}')} >= 2)) GROUP BY doc_id""",
    "identity_match": "WITH r AS (SELECT doc_id, lower(source || '-' || lang) AS name, n_chars AS size, doc_id % 3 AS path FROM documents WHERE n_chars <> 0) SELECT a.doc_id, min(b.doc_id) AS other_id FROM r a JOIN r b USING (name, size) WHERE a.path <> b.path GROUP BY a.doc_id",
    "item_match": """WITH i AS (SELECT p_partkey AS item, '/lib/' || p_partkey AS path, p_name || (p_partkey % 40) AS name, p_size * 100 + p_partkey % 700 AS size FROM part),
 p AS (SELECT l_orderkey * 10 + l_linenumber AS paper, l_partkey AS k, p_name, p_size FROM lineitem JOIN part ON p_partkey = l_partkey),
 q AS (SELECT paper, CASE WHEN paper % 3 = 0 THEN '/lib/' || k ELSE '/tmp/' || k END AS path, CASE WHEN paper % 5 = 0 THEN p_name || (k % 40) ELSE 'none' || paper END AS name, p_size * 100 + k % 700 + CASE WHEN paper % 2 = 0 THEN 0 ELSE 7 END AS size FROM p),
 n AS (SELECT name, count(*) AS c, min(item) AS m FROM i GROUP BY name), ns AS (SELECT name, size, min(item) AS m FROM i GROUP BY name, size HAVING count(*) = 1), s AS (SELECT size, min(item) AS m FROM i GROUP BY size HAVING count(*) = 1),
 j AS (SELECT (SELECT min(item) FROM i WHERE i.path = q.path) AS m1, CASE WHEN n.c = 1 THEN n.m WHEN n.c > 1 THEN ns.m END AS m2, s.m AS m4 FROM q LEFT JOIN n USING (name) LEFT JOIN ns ON ns.name = q.name AND ns.size = q.size LEFT JOIN s ON s.size = q.size)
 SELECT CASE WHEN m1 IS NOT NULL THEN 'path' WHEN m2 IS NOT NULL THEN 'name' WHEN m4 IS NOT NULL THEN 'size' END AS tier, count(*) AS n, sum(coalesce(m1, m2, m4))::BIGINT AS items FROM j GROUP BY 1""",
    "annotation_join": f"""WITH {LINES_SQL}, e AS (SELECT event_id, user_id AS page, event_id % 60 AS para FROM events), j AS (SELECT e.*, CASE WHEN l.doc_id IS NULL THEN 'orphan' ELSE 'paragraph' END AS kind FROM e LEFT JOIN lines l ON l.doc_id = page AND l.line_no = para)
 SELECT page, kind, count(*) AS n, min(event_id) AS first_id FROM j GROUP BY ALL""",
    "qa_to_paragraph": f"WITH {LINES_SQL}, a AS (SELECT doc_id AS page, line_no AS asked, substring(raw, 11, 40) AS s FROM lines) SELECT page, asked, count(*) AS n, min(line_no) AS para FROM a JOIN lines l ON l.doc_id = page AND length(s) > 0 AND contains(trim(raw), s) GROUP BY page, asked",
    "coverage_report": f"""WITH {LINES_SQL}, t AS (SELECT doc_id, line_no, {sql_trim('line')} AS t FROM lines), u AS (SELECT *, {_REST} AS r FROM t), f AS (SELECT doc_id, line_no % 2 = 0 AS h, line_no % 3 = 0 AS d, {SQL_UNTRANSLATABLE} AS f FROM u)
 SELECT doc_id AS paper, count(*) FILTER (h) AS highlighted, count(*) FILTER (d) AS translated, count(*) FILTER (h AND NOT d AND NOT f) AS missing, count(*) FILTER (NOT h AND NOT d) AS bare FROM f GROUP BY doc_id""",
    "page_ranges": f"""WITH {LINES_SQL}, p AS (SELECT doc_id, line_no + 1 AS page FROM lines WHERE (doc_id + line_no * line_no) % 5 < 3), g AS (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM p), r AS (SELECT doc_id, min(page) AS a, max(page) AS b FROM g GROUP BY doc_id, g)
 SELECT doc_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '–' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY doc_id""",
    "formula_index": rf"""WITH {LINES_SQL}, f AS (SELECT doc_id, line_no AS page, regexp_extract(line, '\$([^$]*)\$', 1) AS latex FROM lines), u AS (SELECT doc_id, page, CASE WHEN page % 2 = 0 THEN 'v ' || latex ELSE latex END AS latex FROM f WHERE length(latex) > 1)
 SELECT doc_id, min(page) AS page, latex FROM u GROUP BY doc_id, latex""",
    "history_window": f"""WITH t0 AS (SELECT conv_id, turn, role, {TURNS} AS text FROM conversations), t AS (SELECT *, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS u FROM t0 WHERE role IN ('user', 'assistant') AND NOT starts_with(text, '[error]')),
 c AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS c FROM t WHERE u = 1 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c),
 m AS (SELECT conv_id, run::BIGINT AS run, role, string_agg(text, chr(10) ORDER BY turn) AS text FROM r GROUP BY conv_id, run, role)
 SELECT conv_id, run, role, md5(text) AS text_md5 FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY run DESC) <= 8""",
    "history_cut": "SELECT conv_id, turn, md5(left(text, 4000)) AS text_md5 FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20",
    "qa_retention": "SELECT user_id, count(*) AS n, min(event_id) AS first_id FROM (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 200) GROUP BY user_id",
    "merge_role_runs": "WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM c) SELECT user_id, run, event_type, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY ALL",
    "line_step_median": "WITH s AS (SELECT l_orderkey, abs(l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice)) AS step FROM lineitem), g AS (SELECT l_orderkey, list_sort(list(step)) AS s FROM s WHERE step BETWEEN 8.5 AND 20 GROUP BY l_orderkey) SELECT l_orderkey, s[len(s) // 2 + 1] AS median_step FROM g",
    "margin_order_stats": "WITH g AS (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS s FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, s[floor(len(s) * 0.04)::INT + 1] AS low, s[floor(len(s) * 0.25)::INT + 1] AS left, s[floor(len(s) * 0.75)::INT + 1] AS right, s[floor(len(s) * 0.96)::INT + 1] AS high FROM g",
    "weighted_mode": "WITH g AS (SELECT l_suppkey, floor(l_quantity * 2 + 0.5) / 2 AS mode, sum(l_linenumber)::BIGINT AS weight, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY ALL) SELECT l_suppkey, mode, weight FROM g QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, f) = 1",
    "join_suite": """SELECT 'inner' AS kind, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS n UNION ALL SELECT 'left', (SELECT count(*) FROM customer LEFT JOIN orders ON o_custkey = c_custkey) UNION ALL SELECT 'semi', (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))
 UNION ALL SELECT 'anti', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) UNION ALL SELECT 'full', (SELECT count(*) FROM customer FULL JOIN orders ON o_custkey = c_custkey AND o_totalprice > 1e5) UNION ALL SELECT 'theta', (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20)""",
    "labelled_quality": "SELECT lang, count(*) AS n, sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic, median(n_chars) AS median_chars FROM documents JOIN labels USING (doc_id) GROUP BY lang",
}
