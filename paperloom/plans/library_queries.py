"""Queries over library items, stored papers and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import library as L
from paperloom.functions import text as T
from paperloom.operators import linkage, reports
from paperloom.plans.text_queries import sql_trim
from paperloom.sources import papers
from paperloom.sources.tables import LINES_SQL, lines, table

# Inputs that both dialects build alike.
HREF = "CASE doc_id % 6 WHEN 0 THEN 'file:///C:/Users/X%20Y/lib/storage/KEY' || doc_id || '/A  Paper.PDF' WHEN 1 THEN 'C:' || chr(92) || 'lib' || chr(92) || 'storage' || chr(92) || 'Ab' || doc_id || chr(92) || 'n' || doc_id || '.pdf' WHEN 2 THEN 'file:///home/x/a+b.pdf' WHEN 3 THEN '/tmp/storage' WHEN 4 THEN ' Papers/Sub/' || source || '.pdf ' ELSE '' END"
STATUS = "CASE doc_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 403 WHEN 2 THEN 403 WHEN 3 THEN 0 WHEN 4 THEN 204 ELSE 500 END"
BODY = "CASE doc_id % 6 WHEN 1 THEN 'Local API is Not Enabled' ELSE lang END"
PREFS = "CASE doc_id % 4 WHEN 0 THEN 'user_pref(\"a.b\", true);' || chr(10) || 'user_pref(\"x.local.enabled\", false);' WHEN 1 THEN 'user_pref( ' || chr(39) || 'x.local.enabled' || chr(39) || ' , true )' WHEN 2 THEN 'user_pref(\"x_local.enabled\", true);' ELSE '' END"
UP = "CASE doc_id % 4 WHEN 0 THEN 'http://h/api/users/0/items/P%20' || doc_id || '?v=3' WHEN 1 THEN 'http://h/api/users' ELSE NULL END"
PARENT = "CASE WHEN doc_id % 3 = 0 THEN 'Q' || doc_id WHEN doc_id % 3 = 1 THEN '' ELSE NULL END"
TITLE = "CASE doc_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'Title ' || doc_id ELSE '' END"
ATTACHED = "CASE doc_id % 5 WHEN 0 THEN 'Full Text PDF' WHEN 1 THEN 'T' WHEN 2 THEN 'Snapshot' ELSE 'Attachment ' || doc_id END"
VENUE = "CASE doc_id % 3 WHEN 0 THEN 'Venue ' || source WHEN 1 THEN '' ELSE NULL END"


def library_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.expr(HREF).alias("href"), F.expr(UP).alias("up"), F.expr(PARENT).alias("parent"))
    f = L.file_url(F.col("href"))
    return rows.select("doc_id", f["file_path"].alias("file_path"), f["file_name"].alias("file_name"), f["storage_key"].alias("storage_key"), L.parent_key(F.col("up"), F.col("parent")).alias("parent_key"))


def library_states(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.expr(STATUS).alias("status"), F.expr(BODY).alias("body"), F.expr(PREFS).alias("prefs"))
    return rows.groupBy(L.library_state(F.col("status"), F.col("body")).alias("state"), L.preference(F.col("prefs"), "x.local.enabled").alias("enabled")).agg(F.count("*").alias("n"))


def library_meta(spark: SparkSession, d: str) -> DataFrame:
    """Title, authors, year, venue and their summary of each item."""
    people = F.from_json(F.expr("""CASE doc_id % 5 WHEN 0 THEN '[]' WHEN 1 THEN '[{"lastName": "Doe", "firstName": "Jane"}]' WHEN 2 THEN '[{"name": "The Group"}, {"lastName": " Lane "}]' WHEN 3 THEN '[{"lastName": "Planck", "firstName": "Max"}, {"firstName": "Ada"}, {"name": ""}, {"name": "Z"}]' END"""), L.CREATORS)
    rows = table(spark, d, "documents").select("doc_id", L.creator_names(F.coalesce(people, F.array().cast(L.CREATORS))).alias("names"), F.expr("'10/' || (doc_id + 1500) || ' x'").alias("date"), F.expr(TITLE).alias("own"), F.expr(ATTACHED).alias("attached"), F.expr("'file ' || doc_id || '.PDF'").alias("file"), F.expr(VENUE).alias("v"))
    named = rows.withColumn("authors", T.authors(F.col("names"))).withColumn("year", T.year(F.col("date"))).withColumn("venue", L.filled(F.col("v"), F.lit(None).cast("string")))
    return named.select("doc_id", L.title(F.col("own"), F.col("attached"), F.col("file")).alias("title"), "authors", "year", "venue", L.summary(F.col("authors"), F.col("year"), F.col("venue")).alias("summary"))


def text_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of full texts, and whether there are as many as expected."""
    content = F.concat(F.replace("text", F.lit("\n"), F.lit("\f")), F.expr("CASE WHEN doc_id % 3 = 0 THEN chr(12) || ' ' || chr(12) ELSE '' END"))
    rows = table(spark, d, "documents").select("doc_id", L.pages(content).alias("pages"))
    return rows.select("doc_id", F.posexplode("pages").alias("pos", "page"), F.size("pages").alias("n")).select("doc_id", (F.col("pos") + 1).cast("long").alias("page_no"), F.md5("page").alias("page_md5"), (F.col("n") != F.col("doc_id") % 4 + 1).alias("mismatch"))


LABELS = "i ii iii iv v".split()


def library_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of the library as rows for a page: place and boxes from JSON, pages by index or label, text or what stands for it."""
    position = F.expr("""CASE event_id % 6 WHEN 0 THEN '{broken' WHEN 1 THEN '{"rects": [[1, 2, 9, 30]]}' WHEN 2 THEN '{"pageIndex": -1, "rects": [[1, 2, 9, 30]]}' WHEN 3 THEN '{"pageIndex": 2, "rects": [[5, 5, 5.2, 9], [1, 2, 3]]}' ELSE '{"pageIndex": ' || (event_id % 9) || ', "rects": [[' || (event_id % 50) || ', 700, 90, 712.5], [300, 10, 200, 40]]}' END""")
    rows = table(spark, d, "events").select("event_id", position.alias("position"), F.expr("CASE event_id % 5 WHEN 0 THEN 'iii' WHEN 1 THEN 'xx' END").alias("label"), F.expr("CASE WHEN event_id % 4 = 0 THEN ' ' WHEN event_id % 4 = 1 THEN ' text ' || user_id END").alias("text"), F.expr("CASE WHEN event_id % 8 = 0 THEN ' a note' END").alias("comment"), F.expr("CASE event_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'ink' ELSE 'highlight' END").alias("kind"))
    labels = spark.createDataFrame(list(enumerate(LABELS)), "label_index int, label string")
    heights = spark.createDataFrame([(p, 792.0 if p != 4 else 0.0) for p in range(1, 9)], "page int, height double")
    got = reports.annotation_rows(rows, labels, heights)
    return got.select("event_id", F.col("page").cast("long").alias("page"), "text", F.size("boxes").cast("long").alias("n_boxes"), F.round(F.get("boxes", F.lit(0))["y"], 3).alias("y"), F.round(F.get("boxes", F.lit(0))["h"], 3).alias("h"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Papers as JSON: main and backup."""
    notes = "'[{\"id\": \"a' || doc_id || '\", \"page\": 1, \"text\": \"t\"}, {\"id\": \"b\", \"page\": 2, \"text\": \"u\"}]'"
    main = f"""CASE doc_id % 6 WHEN 0 THEN '{{broken' WHEN 1 THEN '{{"annotations": []}}' WHEN 2 THEN '{{"annotations": ' || {notes} || ', "sentenceTranslations": {{"k": ["x", "y"], "l": ["x", " "], "m": []}}}}' WHEN 3 THEN NULL WHEN 4 THEN '{{"translations": {{"k": "v", "l": "w"}}, "aiQa": [{{"id": "q"}}]}}' ELSE '{{"annotations": null, "aiQa": 5}}' END"""
    backup = f"""CASE doc_id % 4 WHEN 0 THEN '{{"annotations": ' || {notes} || '}}' WHEN 1 THEN 'no' WHEN 2 THEN '{{"annotations": []}}' END"""
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.expr(main).alias("main"), F.expr(backup).alias("backup"))


def stored_papers(spark: SparkSession, d: str) -> DataFrame:
    """Stored papers: what main holds, annotations from the backup where main has none, all from it where main is missing or broken."""
    got = papers.restored(_stored(spark, d))
    return got.select("key", F.size("annotations").cast("long").alias("n_annotations"), F.array_join(F.array_sort(F.map_keys("sentence_translations")), ",").alias("sentence_keys"), F.size("translations").cast("long").alias("n_translations"), F.size("ai_qa").cast("long").alias("n_qa"))


def paper_merge(spark: SparkSession, d: str) -> DataFrame:
    """An older archive's data merged into a paper: new values of maps win, lists are joined, older first, one of each id."""
    ids = lambda a, n: F.expr(f"transform(sequence(0, int({n})), x -> named_struct('id', '{a}' || int(x * doc_id % 7), 'at', x))")
    words = lambda m: F.expr(f"map_from_entries(transform(sequence(0, int(doc_id % {m})), x -> struct('k' || x, '{m}v' || x)))")
    rows = table(spark, d, "documents").select("doc_id", ids("n", "doc_id % 4").alias("old_notes"), ids("n", "doc_id % 5").alias("new_notes"), words(3).alias("old"), words(2).alias("new"))
    got = rows.select("doc_id", linkage.merged_list(F.col("old_notes"), F.col("new_notes"), "id").alias("notes"), linkage.merged_map(F.col("old"), F.col("new")).alias("words"))
    text = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return got.select("doc_id", F.array_join(F.transform("notes", lambda n: n["id"]), ",").alias("notes"), text("words").alias("words"))


def identity_index(spark: SparkSession, d: str) -> DataFrame:
    """For each name (whatever its case) and size the paper that was opened last."""
    rows = table(spark, d, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END || '.pdf'").alias("name"), (F.col("n_chars") % 100).alias("size"), F.expr("doc_id * 7919 % 1000").alias("updated"))
    return linkage.identities(rows, F.col("name"), F.col("size"), ["doc_id"], F.struct("updated", "doc_id")).select("identity_name", "size", "doc_id")


def model_averages(spark: SparkSession, d: str) -> DataFrame:
    """Calls and mean milliseconds of each model."""
    return reports.averages(table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("value").alias("ms")), "model", "ms").select("model", "n", F.round("mean_ms", 6).alias("mean_ms"))


PARA_COLUMNS = ["doc_id AS paper", "(line_no % 5) + 1 AS page", "line_no AS id", "CASE line_no % 9 WHEN 0 THEN 'heading' WHEN 3 THEN 'formula' WHEN 5 THEN 'figure-label' WHEN 7 THEN 'noise' ELSE 'body' END AS type", "CASE WHEN line_no % 18 = 3 THEN raw || ' (1) ' || repeat('x + y = z; ', 30) || '(2)' ELSE line END AS text", "CASE WHEN line_no % 4 = 0 THEN 'T' || line_no ELSE '' END AS translation"]
NOTE_COLUMNS = ["user_id AS paper", "event_id % 5 + 1 AS page", "event_id % 60 AS para", "event_id AS id", "CASE event_id % 4 WHEN 0 THEN 'yellow' WHEN 1 THEN 'blue' WHEN 2 THEN 'green' ELSE 'pink' END AS colour"]


def _paras(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).selectExpr(*PARA_COLUMNS)


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(*NOTE_COLUMNS)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions on selections of every paragraph: some characters of its text, or for some what stands nowhere."""
    return lines(spark, d).selectExpr("doc_id AS paper", "(line_no % 5) + 1 AS page", "line_no AS id", "CASE WHEN line_no % 2 = 0 THEN 'not in any text of it' ELSE substring(raw, 3, 60) END AS selected")


def sound_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of archives without a formula that swallowed two numbered ones."""
    return reports.sound_pages(_paras(spark, d)).groupBy("paper", "page").agg(F.count("*").alias("n"))


def appendix_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the appendix: entries, those translated, with notes and with questions, and what fits none of them."""
    return reports.appendix(_paras(spark, d), _notes(spark, d), _questions(spark, d))


def coverage_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each paper: highlighted, translated, with formulas only, missing a translation, without a sheet, as ranges."""
    return reports.coverage_sheets(_paras(spark, d), _notes(spark, d))


def sheet_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.sheet_counts(_paras(spark, d))


def paper_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.summary(_paras(spark, d))


def markdown_papers(spark: SparkSession, d: str) -> DataFrame:
    """Each paper as Markdown: head, contents, and page by page text, translation and notes."""
    rows = reports.markdown(_paras(spark, d), _notes(spark, d))
    return rows.select("paper", F.length("markdown").cast("long").alias("n"), F.md5("markdown").alias("markdown_md5"))


QUERIES = {f.__name__: f for f in (library_paths, library_states, library_meta, text_pages, library_annotations, stored_papers, paper_merge, identity_index, model_averages, sound_pages, appendix_pages, coverage_sheets, sheet_counts, paper_summary, markdown_papers)}

_P = f"p AS (SELECT {', '.join(PARA_COLUMNS)} FROM lines), a AS (SELECT {', '.join(NOTE_COLUMNS)} FROM events)"
_Q = "q AS (SELECT doc_id AS paper, (line_no % 5) + 1 AS page, line_no AS id, CASE WHEN line_no % 2 = 0 THEN 'not in any text of it' ELSE substring(raw, 3, 60) END AS selected FROM lines)"
_CORRUPT = r"(type = 'formula' AND length(text) > 250 AND regexp_matches(text, '(?s)\([0-9]+\).*\([0-9]+\)'))"
ORACLES = {
    "library_paths": f"""WITH h AS (SELECT doc_id, {HREF} AS href, {UP} AS up, {PARENT} AS parent FROM documents), n AS (SELECT *, lower(regexp_replace(replace(replace(trim(href), '%20', ' '), chr(92), '/'), '\\s+', ' ', 'g')) AS p FROM h),
 f AS (SELECT *, regexp_replace(p, '^file:///?', '') AS file_path FROM n), s AS (SELECT *, [x for x in string_split(file_path, '/') if x <> ''] AS parts, [x for x in string_split(replace(href, chr(92), '/'), '/') if x <> ''] AS rawparts FROM f)
 SELECT doc_id, file_path, coalesce(parts[-1], '') AS file_name, coalesce(CASE WHEN list_contains(rawparts, 'storage') THEN rawparts[list_position(rawparts, 'storage') + 1] END, '') AS storage_key,
 CASE WHEN doc_id % 4 = 0 THEN 'P ' || doc_id WHEN parent <> '' THEN parent END AS parent_key FROM s""",
    "library_states": f"""WITH s AS (SELECT {STATUS} AS status, {BODY} AS body, {PREFS} AS prefs FROM documents), e AS (SELECT *, regexp_extract(prefs, 'user_pref\\(\\s*["'']x\\.local\\.enabled["'']\\s*,\\s*(true|false)\\s*\\)', 1) AS e FROM s)
 SELECT CASE WHEN status BETWEEN 200 AND 299 THEN 'available' WHEN status = 403 AND contains(lower(body), 'not enabled') THEN 'api-disabled' WHEN status = 0 THEN 'not-running' ELSE 'error' END AS state, CASE WHEN e <> '' THEN e = 'true' END AS enabled, count(*) AS n FROM e GROUP BY ALL""",
    "library_meta": f"""WITH m AS (SELECT doc_id, CASE WHEN trim({TITLE}) <> '' THEN trim({TITLE}) WHEN doc_id % 5 > 2 THEN {ATTACHED} ELSE 'file ' || doc_id END AS title, CASE doc_id % 5 WHEN 1 THEN 'Doe Jane' WHEN 2 THEN 'The Group & Lane' WHEN 3 THEN 'Planck et al.' ELSE '' END AS authors, regexp_extract('10/' || (doc_id + 1500) || ' x', '(1[6-9][0-9]{{2}}|20[0-9]{{2}})', 1) AS year, coalesce({VENUE}, '') AS venue FROM documents)
 SELECT *, array_to_string([x for x in [authors, year, venue] if x <> ''], ' · ') AS summary FROM m""",
    "text_pages": f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), l AS (SELECT doc_id, p, greatest(1, coalesce(list_max([i for i in range(1, len(p) + 1) if {sql_trim('p[i]')} <> '']), 1)) AS n FROM s)
 SELECT doc_id, i AS page_no, md5(p[i]) AS page_md5, n <> doc_id % 4 + 1 AS mismatch FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM l)""",
    "library_annotations": """WITH e AS (SELECT event_id, user_id, event_id % 6 AS m, CASE WHEN event_id % 5 = 0 THEN 2 END AS by_label, CASE WHEN event_id % 4 = 1 THEN 'text ' || user_id WHEN event_id % 8 = 0 THEN 'a note' WHEN event_id % 3 = 0 THEN '（图片批注）' WHEN event_id % 3 = 1 THEN '（手写批注）' ELSE '（无文字批注）' END AS text FROM events),
 p AS (SELECT *, CASE WHEN m = 1 THEN by_label WHEN m >= 4 THEN event_id % 9 END AS i FROM e WHERE m IN (1, 4, 5))
 SELECT event_id, i + 1 AS page, text, (CASE WHEN m = 1 THEN 1 ELSE 2 END)::BIGINT AS n_boxes, (CASE WHEN m = 1 THEN 762.0 ELSE 79.5 END)::DOUBLE AS y, (CASE WHEN m = 1 THEN 28.0 ELSE 12.5 END)::DOUBLE AS h FROM p WHERE i IS NOT NULL AND i + 1 <= 8 AND i + 1 <> 4""",
    "stored_papers": """WITH d AS (SELECT doc_id AS key, doc_id % 6 AS m, doc_id % 4 AS b FROM documents), s AS (SELECT *, m IN (0, 3) AS lost FROM d)
 SELECT key, (CASE WHEN m = 2 THEN 2 WHEN b = 0 THEN 2 ELSE 0 END)::BIGINT AS n_annotations, CASE WHEN m = 2 THEN 'k' ELSE '' END AS sentence_keys, (CASE WHEN m = 4 THEN 2 ELSE 0 END)::BIGINT AS n_translations, (CASE WHEN m = 4 THEN 1 ELSE 0 END)::BIGINT AS n_qa FROM s WHERE NOT (lost AND b IN (1, 3))""",
    "paper_merge": """WITH d AS (SELECT doc_id, [('n' || (x * doc_id % 7)::INT) for x in range(doc_id % 4 + 1)] || [('n' || (x * doc_id % 7)::INT) for x in range(doc_id % 5 + 1)] AS a FROM documents)
 SELECT doc_id, array_to_string([a[i] for i in range(1, len(a) + 1) if list_position(a, a[i]) = i], ',') AS notes, array_to_string([('k' || x || '=' || CASE WHEN x <= doc_id % 2 THEN '2' ELSE '3' END || 'v' || x) for x in range(greatest(doc_id % 3, doc_id % 2) + 1)], ',') AS words FROM d""",
    "identity_index": "WITH d AS (SELECT doc_id, lower(source || '.pdf') AS identity_name, n_chars % 100 AS size, doc_id * 7919 % 1000 AS u FROM documents) SELECT identity_name, size, doc_id FROM d QUALIFY row_number() OVER (PARTITION BY identity_name, size ORDER BY u DESC, doc_id DESC) = 1",
    "model_averages": "SELECT event_type AS model, count(*) AS n, round(avg(value), 6) AS mean_ms FROM events GROUP BY event_type",
    "sound_pages": f"WITH {LINES_SQL}, {_P} SELECT paper, page, count(*) AS n FROM p GROUP BY paper, page HAVING count(*) FILTER ({_CORRUPT}) = 0",
    "appendix_pages": f"""WITH {LINES_SQL}, {_P}, {_Q}, e AS (SELECT * FROM p WHERE type NOT IN ('figure-label', 'noise')), n AS (SELECT a.*, e.id IS NOT NULL AS used FROM a LEFT JOIN e ON a.paper = e.paper AND a.page = e.page AND a.para = e.id),
 x AS (SELECT DISTINCT q.paper, q.page, q.id AS qid, e.id FROM q JOIN e ON q.paper = e.paper AND q.page = e.page AND length(q.selected) > 0 AND contains(trim(e.text), left(q.selected, 40))),
 ea AS (SELECT paper, page, count(*) AS entries, count(*) FILTER (translation <> '') AS translated FROM e GROUP BY ALL), na AS (SELECT paper, page, count(*) FILTER (used) AS notes, count(*) FILTER (NOT used) AS orphan_notes, count(DISTINCT para) FILTER (used) AS noted FROM n GROUP BY ALL),
 qa AS (SELECT q.paper, q.page, count(*) FILTER (q.id IN (SELECT qid FROM x WHERE x.paper = q.paper AND x.page = q.page)) AS questions, count(*) AS every FROM q GROUP BY ALL), pages AS (SELECT DISTINCT paper, page FROM p)
 SELECT paper, page, coalesce(entries, 0) AS entries, coalesce(translated, 0) AS translated, coalesce(noted, 0) AS noted, coalesce(orphan_notes, 0) AS orphan_notes, coalesce(questions, 0) AS questions, coalesce(every, 0) - coalesce(questions, 0) AS orphan_questions
 FROM pages LEFT JOIN ea USING (paper, page) LEFT JOIN na USING (paper, page) LEFT JOIN qa USING (paper, page) WHERE coalesce(translated, 0) + coalesce(notes, 0) + coalesce(orphan_notes, 0) + coalesce(every, 0) > 0""",
    "coverage_sheets": f"""WITH {LINES_SQL}, {_P}, c AS (SELECT paper, page, bool_or(translation <> '' AND type NOT IN ('figure-label', 'noise')) AS t, bool_and(type = 'formula') AS f FROM p GROUP BY ALL), h AS (SELECT DISTINCT paper, page FROM a), j AS (SELECT c.*, h.page IS NOT NULL AS h FROM c LEFT JOIN h USING (paper, page))
 SELECT paper, count(*) AS pages, count(*) FILTER (h) AS highlighted, count(*) FILTER (t) AS translated, count(*) FILTER (h AND f AND NOT t) AS formula_only, count(*) FILTER (h AND NOT t AND NOT f) AS missing, string_agg(page::VARCHAR, ', ' ORDER BY page) FILTER (NOT h AND NOT t) AS no_sheet FROM j GROUP BY paper""",
    "sheet_counts": f"WITH {LINES_SQL}, {_P} SELECT paper, page, count(*) FILTER (translation <> '') AS translated, count(*) FILTER (translation = '' AND type = 'formula') AS formula_only FROM p WHERE type NOT IN ('figure-label', 'noise') GROUP BY ALL",
    "paper_summary": rf"WITH {LINES_SQL}, {_P} SELECT paper, count(*) AS paragraphs, count(*) FILTER (type = 'body') AS body, count(*) FILTER (type = 'formula') AS formulas, sum(len(regexp_extract_all(text, '⟦M[0-9]+⟧')))::BIGINT AS inline_tokens FROM p GROUP BY paper",
    "markdown_papers": f"""WITH {LINES_SQL}, {_P}, n AS (SELECT paper, page, para, string_agg('- note (' || colour || ')', chr(10) ORDER BY id) AS notes FROM a GROUP BY ALL), e AS (SELECT * FROM p WHERE type NOT IN ('figure-label', 'noise')),
 b AS (SELECT e.paper, e.page, e.id, CASE type WHEN 'heading' THEN '### ' || text WHEN 'formula' THEN '$$' || chr(10) || text || chr(10) || '$$' ELSE '> ' || text END || CASE WHEN translation <> '' THEN chr(10) || chr(10) || '> ' || translation ELSE '' END || CASE WHEN notes IS NOT NULL THEN chr(10) || chr(10) || notes ELSE '' END AS part FROM e LEFT JOIN n ON n.paper = e.paper AND n.page = e.page AND n.para = e.id),
 g AS (SELECT paper, page, string_agg(part, chr(10) || chr(10) ORDER BY id) AS body FROM b GROUP BY ALL), w AS (SELECT paper, count(*) AS k, string_agg('- [page ' || page || '](#page-' || page || ')', chr(10) ORDER BY page) AS toc, string_agg('## page ' || page || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY page) AS whole FROM g GROUP BY paper),
 m AS (SELECT paper, '---' || chr(10) || 'title: "' || paper || '"' || chr(10) || 'pages: ' || k || chr(10) || '---' || chr(10) || chr(10) || toc || chr(10) || chr(10) || whole || chr(10) AS markdown FROM w) SELECT paper, length(markdown) AS n, md5(markdown) AS markdown_md5 FROM m""",
}
