"""Queries over paragraph text and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import requests as R
from paperloom.functions import text as T
from paperloom.operators import sequences
from paperloom.sources.tables import LINES_SQL, lines, table

BLANK = r"[\s\x{00a0}\x{3000}\x{feff}]"


def sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def sql_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


SQL_FOLD = sql_trim(rf"regexp_replace(coalesce(text, ''), '{BLANK}+', ' ', 'g')")


def sql_fnv(t: str) -> str:
    """Hash and number of UTF-16 units."""
    units = f"flatten([CASE WHEN unicode(c) > 65535 THEN [55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)] ELSE [unicode(c)] END for c in string_split({t}, '') if c <> ''])"
    return f"lower(printf('%x', list_reduce(list_prepend(2166136261::UBIGINT, [u::UBIGINT for u in {units}]), lambda a, c: (xor(a, c) * 16777619) & 4294967295))) || '-' || len({units})"


SQL_FP = f"SELECT doc_id, CASE WHEN t = '' THEN '' ELSE {sql_fnv('t')} END AS fp FROM (SELECT doc_id, {SQL_FOLD} AS t FROM documents)"
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"


def sql_latex(x: str) -> str:
    for p in (r"⟦[^⟧\n]*⟧", r"(?i)(?:【|〖|⟪|\[)\s*M[0-9]{1,3}\s*(?:】|〗|⟫|\])", r"(?s)\$\$.*?\$\$", r"(?s)\\\[.*?\\\]", r"(?s)\\\(.*?\\\)", r"\$[^$\n]*?\$", r"\\[a-zA-Z]+"):
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    return x


def sql_density(x: str) -> str:
    s = sql_count(x, r"[=+\-*/^_{}\[\]()<>≤≥≈≠∈∑∫∂∇×·|\\]") + " + " + sql_count(x, "[0-9]")
    d = f"({s} + {sql_count(x, '[A-Za-z]')} + {sql_count(x, CJK)})"
    return f"CASE WHEN {d} = 0 THEN 0.0 ELSE ({s}) / {d} END"


def sql_similarity(a: str, b: str) -> str:
    return f"""(SELECT CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0 WHEN length(s) < 12 THEN 0.0 WHEN contains(l, s) THEN 1.0
  ELSE len([i for i in range(length(s) // 12) if contains(l, substring(s, i * 12 + 1, 12))])::DOUBLE / (length(s) // 12) END
 FROM (SELECT x, y, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS s, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS l
 FROM (SELECT regexp_replace(lower(coalesce({a}, '')), '[^a-z0-9]', '', 'g') AS x, regexp_replace(lower(coalesce({b}, '')), '[^a-z0-9]', '', 'g') AS y)))"""


SQL_CLAUSE = rf"(regexp_matches(lower(t), '[,;:]') AND {sql_count('lower(t)', rf'\b(?:{T.FUNCTION_WORDS})\b')} >= 2)"
SQL_UNTRANSLATABLE = rf"""(t = '' OR regexp_matches(t, '(?i)^(?:https?://\S+|www\.\S+|doi:\s*10\.[0-9]{{4,}}/\S+|10\.[0-9]{{4,}}/\S+)$')
 OR ({sql_count('r', CJK)} = 0 AND len([w for w in regexp_extract_all(r, '[A-Za-z]{{2,}}') if NOT regexp_full_match(lower(w), '{T.UNITS}')]) = 0))"""
SQL_REST = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '⟦[^⟧]*⟧', ' ', 'g'), '(?i)https?://\S+', ' ', 'g'), '\[\s*[0-9]+(?:\s*[,–\-]\s*[0-9]+)*\s*\]', ' ', 'g'), '(?i)\(\s*[a-z0-9]{1,3}\s*\)', ' ', 'g')"


def sql_type(size: str = "0", bold: str = "true", body: str = "1", page: str = "0", top: str = "1") -> str:
    """Type of the trimmed text t."""
    begins = {k: f"regexp_matches(t, '{p}')" for k, p in T.BEGINNINGS.items()}
    numbered = " OR ".join(f"regexp_matches(t, '{p}')" for p in T.NUMBERED_HEADINGS)
    end = sql_trim(r"regexp_replace(t, '^[0-9]+(?:\.[0-9]+)*\.', '')")
    return rf"""CASE WHEN t = '' THEN NULL WHEN {page} = 1 AND {top} <= 0.36 AND {size} >= {body} * 1.32 AND length(t) BETWEEN 8 AND 240 AND NOT regexp_matches(t, '(?i)^(?:{'|'.join(T.NO_TITLE)})') THEN 'title'
 WHEN {begins['abstract']} THEN CASE WHEN length(t) <= 16 THEN 'heading' ELSE 'abstract' END WHEN {begins['keywords']} THEN 'keywords' WHEN {begins['caption']} THEN 'caption'
 WHEN length(t) <= 115 AND NOT regexp_matches({end}, '[.!?。！？]\s*$') AND NOT regexp_matches(t, '{T.NO_HEADING}') AND ({numbered} OR (regexp_matches(t, '{T.NAMED_HEADING}') AND ({bold} OR {size} >= {body} * 1.05))) THEN 'heading' END"""


SQL_TYPE = sql_type()


def doc_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", R.fingerprint(F.col("text")).alias("fp"))


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = doc_fingerprint(spark, d).groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return groups.filter("n > 1")


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines(spark, d).select("doc_id", "line_no", F.coalesce(F.sum(F.length("raw") + 1).over(order), F.lit(0)).alias("start"), F.length("raw").cast("long").alias("n"), F.md5("raw").alias("line_md5"))


def line_types(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).groupBy("doc_id", F.coalesce(T.line_type(F.col("line"), True), F.lit("body")).alias("type")).agg(F.count("*").alias("n"))


def paragraph_islands(spark: SparkSession, d: str) -> DataFrame:
    return sequences.paragraphs(lines(spark, d)).select("doc_id", "para", "type", "n_lines", "n_chars")


SQL_PARAS = f"""types AS (SELECT doc_id, line_no, length(line) AS n, t = '' AS blank, coalesce({SQL_TYPE}, 'body') AS type,
  regexp_matches(t, '^\\[[0-9]+\\]') AS cited, regexp_matches(t, '[.!?。！？]["”’)\\]]?$') AS ended, length(t) < 60 AS short
  FROM (SELECT *, {sql_trim('line')} AS t FROM lines)),
 breaks AS (SELECT *, CASE WHEN lag(type) OVER w IS NULL OR lag(blank) OVER w OR type <> lag(type) OVER w OR type IN ('heading', 'caption', 'keywords') OR cited
  OR (lag(ended) OVER w AND lag(short) OVER w) THEN 1 ELSE 0 END AS b FROM types WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
 paras AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY line_no) AS para FROM breaks)"""


def body_numbering(spark: SparkSession, d: str) -> DataFrame:
    paras = sequences.paragraphs(lines(spark, d)).filter("type = 'body' and n_chars > 0")
    return paras.select("doc_id", "para", F.row_number().over(Window.partitionBy("doc_id").orderBy("para")).cast("long").alias("body_index"))


def untranslatable_gate(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", "line_no", T.untranslatable(F.col("line")).alias("untranslatable"))


def nonprose_gate(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("line")
    return lines(spark, d).select("doc_id", "line_no", T.nonprose(t).alias("nonprose"), T.clause_run(T.trimmed(t)).alias("clause_run"))


def densities(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("line")
    return lines(spark, d).select("doc_id", "line_no", T.math_density(t).alias("math_density"), T.cjk_count(t).cast("long").alias("cjk_count"), F.length(T.without_latex(t)).cast("long").alias("plain_chars"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with the next one, as a source and its output; some outputs get Chinese text or the source itself."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("after", F.lead("text").over(order))
    output = F.expr("CASE (conv_id + turn) % 5 WHEN 0 THEN text WHEN 1 THEN '这里是译文，' || text || repeat('汉字', 400) WHEN 2 THEN '' WHEN 3 THEN '译文只有中文。' ELSE coalesce(after, '') END")
    return rows.select("conv_id", "turn", "text", output.alias("output"))


SQL_TURNS = "turns AS (SELECT conv_id, turn, text, CASE (conv_id + turn) % 5 WHEN 0 THEN text WHEN 1 THEN '这里是译文，' || text || repeat('汉字', 400) WHEN 2 THEN '' WHEN 3 THEN '译文只有中文。' ELSE coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') END AS output FROM conversations)"


def translation_sanity(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("conv_id", "turn", T.sanity(F.col("text"), F.col("output"), "zh-CN").alias("verdict"))


def text_similarity(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("conv_id", "turn", T.similarity(F.col("text"), F.col("output")).alias("similarity"))


def risky_terms(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("line")
    rows = lines(spark, d).filter(F.size(T.risky_terms(t)) > 0)
    return rows.select("doc_id", "line_no", F.array_join(F.array_sort(T.risky_terms(t)), ",").alias("terms"), F.size(T.missing_terms(t, F.upper("raw"))).cast("long").alias("missing"))


def char_multiset_gate(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of each turn's letters and digits by its output, and the output's extra share."""
    chars = lambda c, n: turns(spark, d).select("conv_id", "turn", F.explode(F.split(F.lower(c), "")).alias("c")).filter("c rlike '^[a-z0-9]$'").groupBy("conv_id", "turn", "c").agg(F.count("*").alias(n))
    both = chars("text", "n").join(chars("output", "m"), ["conv_id", "turn", "c"], "full").fillna(0, ["n", "m"])
    sums = both.groupBy("conv_id", "turn").agg(F.sum(F.least("n", "m")).alias("matched"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    cover, extra = F.col("matched") / F.greatest("n", F.lit(1)), (F.col("m") - F.col("matched")) / F.greatest("m", F.lit(1))
    return sums.select("conv_id", "turn", cover.alias("coverage"), extra.alias("extra"), ((cover >= 0.7) & (extra <= 0.3)).alias("accepted"))


def layout_counters(spark: SparkSession, d: str) -> DataFrame:
    paras = lines(spark, d)
    t = T.trimmed(F.col("line"))
    return paras.groupBy("doc_id").agg(
        F.count_if(F.length("line") > 1200).alias("huge_body"), F.count_if(F.col("line").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")).alias("ctrl_glyph"),
        F.count_if(F.col("line").rlike(r"\\[a-zA-Z]{2,}")).alias("raw_latex"), F.count_if(t.rlike("^[a-z]")).alias("lower_start"),
    )


def symbol_index(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).select("line_no", F.explode(F.regexp_extract_all("line", F.lit(r"[=+∑∈⟦⟧${}]|[A-Za-z]_\{[a-z]\}"), F.lit(0))).alias("symbol"))
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), F.min("line_no").alias("first_page"))


CONTEXT = 60_000


def whole_context(spark: SparkSession, d: str) -> DataFrame:
    """The texts of a conversation in order, cut at CONTEXT characters; turns that begin beyond it are never gathered."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("[p"), F.col("turn").cast("string"), F.lit("] "), "text").alias("s")).withColumn("before", F.coalesce(F.sum(F.length("s") + 2).over(w), F.lit(0)))
    parts = rows.filter(F.col("before") < CONTEXT).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "s"))).alias("t"))
    whole = F.left(F.array_join(F.transform("t", lambda x: x["s"]), "\n\n"), F.lit(CONTEXT))
    return parts.select("conv_id", F.length(whole).cast("long").alias("n"), F.md5(whole).alias("context_md5"))


def year_author_meta(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("2021-10-01 "), F.col("doc_id") + 1500).alias("date"), F.expr("slice(array('Doe Jane', '', 'Lane Rory', 'Planck Max', 'Curie Marie'), 1, int(doc_id % 6))").alias("names"), F.expr("CASE doc_id % 4 WHEN 0 THEN 'Full Text PDF' WHEN 1 THEN 'T' WHEN 2 THEN '' ELSE source END").alias("title"))
    return rows.select("doc_id", T.year(F.substring("date", 11, 8)).alias("year"), T.authors(F.col("names")).alias("authors"), T.placeholder_title(F.col("title")).alias("placeholder"))


def colour_names(spark: SparkSession, d: str) -> DataFrame:
    code = F.expr("CASE l_orderkey % 5 WHEN 0 THEN '#ffd400' WHEN 1 THEN 'F19837' WHEN 2 THEN 'nothing' ELSE lpad(hex(bigint(l_partkey * 7919 % 16777216)), 6, '0') END")
    return table(spark, d, "lineitem").groupBy(T.colour_name(code).alias("colour")).agg(F.count("*").alias("n"))


def rect_flip(spark: SparkSession, d: str) -> DataFrame:
    box = T.flipped(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 500, F.col("l_quantity") + 3, F.lit(792.0))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b"))
    return rows.filter("b.w > 0.5 and b.h > 0.5").groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("b.x"), 2).alias("x"), F.round(F.sum("b.y"), 2).alias("y"), F.round(F.sum("b.w"), 2).alias("w"), F.round(F.sum("b.h"), 2).alias("h"))


CALLS = """CASE event_id % 8 WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 404 WHEN 4 THEN 429 WHEN 5 THEN 429 WHEN 6 THEN 400 ELSE 503 END AS status,
 CASE WHEN event_id % 8 = 4 THEN '{"error": {"status": "RESOURCE_EXHAUSTED", "message": "You exceeded your current quota"}}' WHEN event_id % 56 = 0 THEN '{"error": {"message": "API key not valid"}}' WHEN event_id % 24 = 8 THEN 'model is not found' ELSE props END AS body"""


def error_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr("event_type", *CALLS.split(",\n"))
    return rows.groupBy("event_type", T.error_class(F.col("status"), F.col("body")).alias("kind")).agg(F.count("*").alias("n"))


def json_position(spark: SparkSession, d: str) -> DataFrame:
    """Annotation positions in JSON, some broken: those that parse, by page."""
    position = F.expr("CASE WHEN event_id % 7 = 0 THEN '{broken' ELSE '{\"pageIndex\": ' || (event_id % 9) || ', \"rects\": [[1, 2, ' || (event_id % 5) || ', 9]]}' END")
    parsed = F.from_json(position, "pageIndex int, rects array<array<double>>")
    rows = table(spark, d, "events").select(parsed.alias("p")).filter("p.pageIndex is not null")
    return rows.groupBy((F.col("p.pageIndex") + 1).cast("long").alias("page")).agg(F.count("*").alias("n"), F.sum(F.get(F.get("p.rects", F.lit(0)), F.lit(2))).alias("x2"))


QUERIES = {f.__name__: f for f in (doc_fingerprint, duplicate_groups, doc_lines, line_types, paragraph_islands, body_numbering, untranslatable_gate, nonprose_gate, densities, translation_sanity, text_similarity, risky_terms, char_multiset_gate, layout_counters, symbol_index, whole_context, year_author_meta, colour_names, rect_flip, error_classes, json_position)}

_T = f"(SELECT *, {sql_trim('line')} AS t FROM lines)"
_HUE = "(CASE WHEN hi = r THEN 60 * (g - b) / d WHEN hi = g THEN 60 * ((b - r) / d + 2) ELSE 60 * ((r - g) / d + 4) END)"
ORACLES = {
    "doc_fingerprint": SQL_FP,
    "duplicate_groups": f"SELECT fp, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM ({SQL_FP}) GROUP BY fp HAVING count(*) > 1",
    "doc_lines": f"WITH {LINES_SQL} SELECT doc_id, line_no, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(raw) AS n, md5(raw) AS line_md5 FROM lines",
    "line_types": f"WITH {LINES_SQL} SELECT doc_id, coalesce({SQL_TYPE}, 'body') AS type, count(*) AS n FROM {_T} GROUP BY ALL",
    "paragraph_islands": f"WITH {LINES_SQL}, {SQL_PARAS} SELECT doc_id, para::BIGINT AS para, min(type) AS type, count(*) AS n_lines, sum(n)::BIGINT AS n_chars FROM paras GROUP BY doc_id, para",
    "body_numbering": f"WITH {LINES_SQL}, {SQL_PARAS} SELECT doc_id, para::BIGINT AS para, row_number() OVER (PARTITION BY doc_id ORDER BY para) AS body_index FROM (SELECT doc_id, para FROM paras GROUP BY doc_id, para HAVING min(type) = 'body' AND sum(n) > 0)",
    "untranslatable_gate": f"WITH {LINES_SQL} SELECT doc_id, line_no, {SQL_UNTRANSLATABLE} AS untranslatable FROM (SELECT *, {SQL_REST} AS r FROM {_T})",
    "nonprose_gate": rf"""WITH {LINES_SQL} SELECT doc_id, line_no, CASE WHEN t = '' THEN false WHEN regexp_matches(t, '[.!?。！？]["''”’)\]]?\s*$') THEN false WHEN regexp_matches(t, '^(?:[0-9]+(?:\.[0-9]+)*\.?|[IVXLC]+\.)\s+\S') THEN false
 WHEN length(t) > 60 AND NOT regexp_matches(t, '[.!?。！？]') THEN NOT {SQL_CLAUSE} WHEN length(t) > 200 THEN false WHEN w < 3 THEN true
 WHEN {sql_count('t', r'\b[A-Z][a-z]+\b')} / greatest(1, w) > 0.5 THEN true ELSE length(t) < 60 END AS nonprose, {SQL_CLAUSE} AS clause_run FROM (SELECT *, {sql_count('t', "[A-Za-z][A-Za-z''" + chr(92) + "-]*")} AS w FROM {_T})""",
    "densities": f"WITH {LINES_SQL} SELECT doc_id, line_no, {sql_density('line')} AS math_density, {sql_count('line', CJK)} AS cjk_count, length({sql_latex('line')}) AS plain_chars FROM lines",
    "translation_sanity": f"""WITH {SQL_TURNS}, p AS (SELECT *, {sql_trim('output')} AS o FROM turns), q AS (SELECT *, {sql_latex('o')} AS plain, {sql_density('text')} >= 0.25 AS heavy FROM p),
 c AS (SELECT *, {sql_count('plain', CJK)} AS cjk, {sql_count('plain', '[A-Za-z]')} AS latin FROM q)
 SELECT conv_id, turn, CASE WHEN o = '' THEN 'empty' WHEN {sql_count('text', CJK)} > 0 OR {sql_count(sql_latex('text'), '[A-Za-z]')} < 8 THEN 'ok' WHEN cjk + latin = 0 THEN 'empty'
 WHEN cjk / greatest(cjk + latin, 1) >= CASE WHEN heavy THEN 0.12 ELSE 0.25 END THEN 'ok' WHEN {sql_similarity('c.text', 'c.plain')} > 0.9 THEN CASE WHEN heavy THEN 'ok' ELSE 'copied' END ELSE 'untranslated' END AS verdict FROM c""",
    "text_similarity": f"WITH {SQL_TURNS} SELECT conv_id, turn, {sql_similarity('turns.text', 'turns.output')} AS similarity FROM turns",
    "risky_terms": rf"""WITH {LINES_SQL}, f AS (SELECT doc_id, line_no, raw, list_distinct([regexp_replace(x, '\s+', '', 'g') for x in regexp_extract_all(line, '(?i)[A-Za-z]*-\s*(?:{T.TERM_SUFFIXES})\b')]) AS terms FROM lines)
 SELECT doc_id, line_no, array_to_string(list_sort(terms), ',') AS terms, len([x for x in terms if NOT contains(lower(raw), lower(x))]) AS missing FROM f WHERE len(terms) > 0""",
    "char_multiset_gate": f"""WITH {SQL_TURNS}, o AS (SELECT conv_id, turn, c, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(lower(text), '')) AS c FROM turns) WHERE regexp_matches(c, '^[a-z0-9]$') GROUP BY ALL), e AS (SELECT conv_id, turn, c, count(*) AS m FROM (SELECT conv_id, turn, unnest(string_split(lower(output), '')) AS c FROM turns) WHERE regexp_matches(c, '^[a-z0-9]$') GROUP BY ALL),
 s AS (SELECT conv_id, turn, sum(least(coalesce(n, 0), coalesce(m, 0))) AS k, sum(coalesce(n, 0)) AS n, sum(coalesce(m, 0)) AS m FROM o FULL JOIN e USING (conv_id, turn, c) GROUP BY ALL)
 SELECT conv_id, turn, (k / greatest(n, 1))::DOUBLE AS coverage, ((m - k) / greatest(m, 1))::DOUBLE AS extra, k / greatest(n, 1) >= 0.7 AND (m - k) / greatest(m, 1) <= 0.3 AS accepted FROM s""",
    "layout_counters": rf"""WITH {LINES_SQL} SELECT doc_id, count(*) FILTER (length(line) > 1200) AS huge_body, count(*) FILTER (regexp_matches(line, '[\x00-\x08\x0b\x0c\x0e-\x1f]')) AS ctrl_glyph,
 count(*) FILTER (regexp_matches(line, '\\[a-zA-Z]{{2,}}')) AS raw_latex, count(*) FILTER (regexp_matches(t, '^[a-z]')) AS lower_start FROM {_T} GROUP BY doc_id""",
    "symbol_index": rf"WITH {LINES_SQL} SELECT symbol, count(*) AS n, min(line_no) AS first_page FROM (SELECT line_no, unnest(regexp_extract_all(line, '[=+∑∈⟦⟧${{}}]|[A-Za-z]_\{{[a-z]\}}')) AS symbol FROM lines) GROUP BY symbol",
    "whole_context": "SELECT conv_id, length(c) AS n, md5(c) AS context_md5 FROM (SELECT conv_id, left(string_agg('[p' || turn || '] ' || text, chr(10) || chr(10) ORDER BY turn), 60000) AS c FROM conversations GROUP BY conv_id)",
    "year_author_meta": """SELECT doc_id, regexp_extract(' ' || (doc_id + 1500), '(1[6-9][0-9]{2}|20[0-9]{2})', 1) AS year,
 CASE len(n) WHEN 0 THEN '' WHEN 1 THEN n[1] WHEN 2 THEN n[1] || ' & ' || n[2] ELSE split_part(n[1], ' ', 1) || ' et al.' END AS authors,
 length(trim(title)) <= 1 OR regexp_full_match(lower(trim(title)), 'pdf|full ?text(?: pdf)?|snapshot|attachment|document|untitled') AS placeholder
 FROM (SELECT doc_id, [x for x in (['Doe Jane', '', 'Lane Rory', 'Planck Max', 'Curie Marie'])[1:doc_id % 6] if x <> ''] AS n, CASE doc_id % 4 WHEN 0 THEN 'Full Text PDF' WHEN 1 THEN 'T' WHEN 2 THEN '' ELSE source END AS title FROM documents)""",
    "colour_names": f"""WITH h AS (SELECT CASE l_orderkey % 5 WHEN 0 THEN 'ffd400' WHEN 1 THEN 'f19837' WHEN 2 THEN 'nothing' ELSE printf('%06x', l_partkey * 7919 % 16777216) END AS h FROM lineitem),
 c AS (SELECT h, CASE WHEN h = 'nothing' THEN 0 ELSE ('0x' || h[1:2])::INT / 255 END AS r, CASE WHEN h = 'nothing' THEN 0 ELSE ('0x' || h[3:4])::INT / 255 END AS g, CASE WHEN h = 'nothing' THEN 0 ELSE ('0x' || h[5:6])::INT / 255 END AS b FROM h),
 e AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM c), f AS (SELECT *, CASE WHEN {_HUE} < 0 THEN {_HUE} + 360 ELSE {_HUE} END AS hue FROM e)
 SELECT CASE WHEN h = 'nothing' THEN 'yellow' WHEN h = 'ffd400' THEN 'yellow' WHEN h = 'ff6666' THEN 'red' WHEN h = '5fb236' THEN 'green' WHEN h = '2ea8e5' THEN 'blue' WHEN h IN ('a28ae5', 'e56eee') THEN 'magenta' WHEN h = 'f19837' THEN 'orange' WHEN h IN ('aaaaaa', 'cccccc') THEN 'gray'
 WHEN d < 0.08 THEN 'gray' WHEN hue < 15 THEN 'red' WHEN hue < 45 THEN 'orange' WHEN hue < 70 THEN 'yellow' WHEN hue < 165 THEN 'green' WHEN hue < 255 THEN 'blue' WHEN hue < 290 THEN 'magenta' ELSE 'red' END AS colour, count(*) AS n FROM f GROUP BY 1""",
    "rect_flip": """SELECT l_linenumber, count(*) AS n, round(sum(x), 2) AS x, round(sum(y), 2) AS y, round(sum(w), 2) AS w, round(sum(h), 2) AS h FROM (SELECT l_linenumber, least(l_quantity, l_tax * 500) AS x, 792.0 - greatest(l_discount * 100, l_quantity + 3) AS y, abs(l_tax * 500 - l_quantity) AS w, abs(l_quantity + 3 - l_discount * 100) AS h FROM lineitem) WHERE w > 0.5 AND h > 0.5 GROUP BY 1""",
    "error_classes": rf"""WITH c AS (SELECT event_type, {CALLS} FROM events), s AS (SELECT *, CASE WHEN json_valid(body) THEN coalesce(json_extract_string(body, '$.error.status'), '') || ' ' || coalesce(json_extract_string(body, '$.error.message'), left(body, 300)) ELSE ' ' || left(body, 300) END AS said FROM c)
 SELECT event_type, CASE WHEN status = 401 OR regexp_matches(said, '(?i)UNAUTHENTICATED|API_KEY_INVALID|API key not valid') THEN 'auth' WHEN status = 403 OR regexp_matches(said, '(?i)PERMISSION_DENIED') THEN 'permission'
 WHEN status = 404 OR regexp_matches(said, '(?i)NOT_FOUND|is not found|not supported for|no longer available') THEN 'not-found' WHEN status = 429 OR regexp_matches(said, '(?i)RESOURCE_EXHAUSTED') THEN CASE WHEN regexp_matches(said, '(?i)quota|billing|free_tier') THEN 'quota' ELSE 'rate-limit' END
 WHEN status = 400 OR regexp_matches(said, '(?i)INVALID_ARGUMENT|FAILED_PRECONDITION') THEN 'invalid-request' WHEN status >= 500 THEN 'server' ELSE 'unknown' END AS kind, count(*) AS n FROM s GROUP BY ALL""",
    "json_position": "SELECT event_id % 9 + 1 AS page, count(*) AS n, sum((event_id % 5)::DOUBLE) AS x2 FROM events WHERE event_id % 7 <> 0 GROUP BY 1",
}
