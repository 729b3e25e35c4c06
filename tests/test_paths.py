"""Rows, maps, tokens, places of figures and calls, held against plain scans and on odd inputs."""

import random

from pyspark.sql import functions as F

from paperloom.operators import calls, figures, formula, layout, pages, translate
from paperloom.operators.layout import Item, Line
from paperloom.plans import catalog, page_queries


def plain_rows(items, body, middle):
    """First fit over all rows in the order in which they began."""
    rows = []
    for i in sorted(items, key=lambda i: (i.h < 0.85 * body, -i.y, i.x, i.idx)):
        for y, row in rows:
            left, right = min(r.x for r in row), max(r.right for r in row)
            if middle is not None and ((i.right < middle - 4 and left > middle + 4) or (i.x > middle + 4 and right < middle - 4)):
                continue
            off = abs(y - i.y)
            if off <= max(3.6, 0.38 * body) or (i.h <= 0.85 * body and off <= 0.58 * body and left - 8 <= i.x and i.right <= right + 8):
                row.append(i)
                break
        else:
            rows.append((i.y, [i]))
    return [[i.idx for i in row] for _, row in rows]


def test_rows_are_first_fit():
    r = random.Random(2)
    for n in range(200):
        items = [Item(k, "x", r.uniform(50, 500), r.choice([700, 690, 680, 650.5, r.uniform(600, 700)]), r.uniform(2, 60), r.choice([10.0, 10.0, 7.0, 8.5, 12.0]), "") for k in range(r.randint(1, 40))]
        middle = None if n % 2 else 300.0
        assert [[i.idx for i in row] for row in layout.baseline_rows(items, 10.0, middle)] == plain_rows(items, 10.0, middle)


def test_texts_and_maps_stay_in_step():
    r = random.Random(3)
    for _ in range(300):
        t = pages.Text()
        for k in range(r.randint(0, 12)):
            r.choice([t.space, t.hyphen_gone, lambda k=k: t.add(r.choice(["ab-", " c ", "d‐", "-", "日本", ""]), k)])()
        before = str(t)
        lead = t.trimmed()
        assert str(t) == before.strip() and (not before.strip() or before[lead:].startswith(str(t)))
        assert len(t.chars) == len(t.glyphs) == len(t.places) and all((g < 0) == (p < 0) for g, p in zip(t.glyphs, t.places, strict=True))


def line(*rows):
    return Line("full", [Item(k, text, x, y, w, h, "", math, latex) for k, (text, x, y, w, h, math, latex) in enumerate(rows)])


def test_words_at_line_ends_and_spaces():
    text, parts = pages.spelt([line(("optimiza-", 0, 100, 50, 10, False, "")), line(("tion", 0, 88, 20, 10, False, ""), (", of", 20.5, 88, 20, 10, False, ""), ("x", 50, 88, 5, 10, True, ""), ("2", 55, 92, 3, 7, False, ""), ("日本", 70, 88, 20, 10, False, "")), line(("語", 0, 76, 10, 10, False, ""))], [], 10.0)
    assert str(text) == "optimization, of x2 日本語" and [(p.math, str(text)[p.start : p.end]) for p in parts] == [(False, "optimization, of"), (True, "x2"), (False, "日本語")]
    assert parts[1].latex == "x^{2}"
    assert pages.tokens(str(text), parts) == ("optimization, of ⟦M1⟧ 日本語", [{"id": "M1", "latex": "x^{2}", "raw": "x2", "start": 17, "end": 19}])


def test_signs_by_themselves_are_no_formulas():
    text = "see (1) and α here"
    told = pages.tokens(text, [pages.Segment(False, 0, 4), pages.Segment(True, 4, 7, "(1)"), pages.Segment(False, 8, len(text))])
    assert told[0] == "see (1) and ⟦M1⟧ here" and told[1][0]["latex"] == r"\alpha" and text[told[1][0]["start"] : told[1][0]["end"]] == "α"
    assert pages.tokens("", []) == ("", [])


def test_neighbours_are_those_of_a_scan():
    r = random.Random(5)
    lines = [line(("w", r.uniform(0, 500), r.uniform(0, 700), 30, r.choice([8.0, 10.0, 24.0]), False, "")) for _ in range(80)]
    near = pages.Neighbours(lines)
    for _ in range(100):
        low = r.uniform(0, 700)
        high = low + r.uniform(0, 80)
        want = {(b.x, b.y) for ln in lines for b in ln.boxes() if b.bottom < high and b.top > low}
        assert {(b.x, b.y) for b in near.between(low, high)} == want
    assert pages.Neighbours([]).between(0, 9) == []


def test_pages_without_glyphs_and_null_texts(spark):
    schema = "paper_id long, page int, item_idx long, str string, font string, transform array<double>, width double, height double, page_w double, page_h double, text string"
    none = pages.page_glyphs(spark.createDataFrame([], schema))
    assert pages.solved(none).count() == 0
    odd = spark.createDataFrame([(1, 1, 0, None, None, None, None, None, 612.0, 792.0, "x"), (1, 1, 1, "word here", None, None, None, None, 612.0, 792.0, "x"), (None, 1, 2, "a b c", "CMR10", [10.0, 0.0, 0.0, 10.0, 72.0, 500.0], None, 10.0, 612.0, 792.0, "x")], schema)
    glyphs = pages.page_glyphs(odd).collect()
    assert sorted((g.text, g.size) for g in glyphs) == [("a b c", 10.0), ("word here", 10.0)]


def test_each_part_of_a_page_has_one_place(spark):
    r = random.Random(6)
    for n in range(150):
        parts = []
        for k in range(r.randint(0, 14)):
            x0, top = r.choice([72.0, 320.0, r.uniform(60, 500)]), r.uniform(60, 740)
            parts.append(figures.Part(k, r.choice(["body", "figure", "table", "caption", "footnote", "heading"]), x0, x0 + r.choice([200.0, 30.0, 460.0]), top, top - r.uniform(0, 200)))
        order = figures.placed(parts, None if n % 3 == 0 else 305.0)
        assert sorted(s for s, _ in order) == [p.seq for p in parts]
        kinds = {p.seq: p.kind for p in parts}
        units = [u for _, u in order if u is not None]
        assert units == sorted(units) and all((u is None) == (kinds[s] not in (*figures.FIGURES, figures.CAPTION)) for s, u in order)
        assert all(sum(kinds[s] == "caption" for s, u in order if u == v) <= 1 for v in set(units))  # a unit has one caption at most
    none = spark.createDataFrame([], "paper long, page int, seq long, type string, x0 double, x1 double, y_top double, y_bottom double, gutter double, place int")
    assert figures.reading_order(none).count() == 0


def test_calls_of_empty_and_odd_requests(spark):
    schema = "id long, text string, sentences array<string>, calls string"
    assert calls.in_rounds(spark.createDataFrame([], schema).drop("calls"), calls.stub).count() == 0
    rows = [(1, None, None, "x"), (2, "  ", ["a", "b"], "x"), (3, "eight ch", None, "x"), (3, "eight ch", None, "x"), (4, "fourteen chars", ["a.", "b."], "x")]
    got = sorted((r.id, r.mode, r.calls, r.note) for r in calls.in_rounds(spark.createDataFrame(rows, schema), calls.stub).collect())
    assert got == [(1, "empty", 0, ""), (2, "empty", 0, ""), (3, "unaligned", 1, ""), (3, "unaligned", 1, ""), (4, "failed", 1, "auth")]
    silent = calls.in_rounds(spark.createDataFrame(rows, schema), lambda r: F.struct(F.lit(None).cast("string").alias("raw"), F.lit("length").alias("finish"), F.lit("").alias("error")))
    assert {(r.mode, r.budget, r.calls) for r in silent.filter("id = 3").collect()} == {("empty", calls.MOST, 2)}


def test_crops_of_nothing():
    assert formula.bands([], [], 10.0) == [] and formula.split_rows([], [], 10.0) == []


def test_texts_of_one_key_have_answers_of_their_own(spark):
    """Two texts of equal length whose 32-bit keys are equal."""
    a, b = "the the steps and reads falls the", "learns many falls a of reads more"
    rows = spark.createDataFrame([("1", a), ("2", b), ("3", a)], "id string, text string")
    none = spark.createDataFrame([], "key string, output string")
    got = {r["id"]: r for r in translate.translated(rows, none, "zh-CN", "m").collect()}
    assert got["1"]["key"] == got["2"]["key"]
    assert [got[i]["output"][3:15] for i in "123"] == [a[:12], b[:12], a[:12]]
    cache = rows.filter("id = '1'").select(F.lit(got["1"]["key"]).alias("key"), "text", F.lit("缓存" * 20).alias("output"))
    assert sorted((r["id"], r["source"]) for r in translate.translated(rows, cache, "zh-CN", "m").collect()) == [("1", "cache"), ("2", "call"), ("3", "cache")]


def test_a_long_line_of_a_column_stays_in_it():
    """Most lines of the left column are short, so the middle is within the long one; a connective ends before a letter with an accent, as in the SQL."""
    rows = [(72.0, n, 15 if n else 40) for n in range(12)] + [(320.0, n, 30) for n in range(12)]
    items = [Item(k, "n" * w, x, 700.0 - 14 * n, 5.0 * w, 10.0, "") for k, (x, n, w) in enumerate(rows)]
    lines = layout.lines_of(items, 10.0, 612.0)
    assert [(ln.section, len(ln.items)) for ln in lines] == [("left", 1)] * 12 + [("right", 1)] * 12
    for word, n in (("forêt dense", 2), ("fort", 1), ("for", 2)):
        pair = [Item(0, word, 72.0, 700.0, 5.0 * len(word), 10.0, ""), Item(1, "other", 320.0, 700.0, 25.0, 10.0, "")]
        assert len(layout.lines_of(pair, 10.0, 612.0)) == n


def test_items_of_documents_are_numbered_with_and_without_shared_ids(spark, tmp_path):
    long = "ab 𝒳" * 50
    for ids in ((1, 2, None), (1, 1, None)):
        folder = str(tmp_path / str(ids[1]))
        spark.createDataFrame([(ids[0], f"{long}\n\n   \nend"), (ids[1], "one\r\ntwo"), (ids[2], None)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
        got = page_queries.text_items(spark, folder).orderBy("paper_id", "item_idx").collect()
        assert sorted(r["str"] for r in got) == sorted([*(long[i : i + 40] for i in range(0, 200, 40)), "end", "one\r", "two"])
        for k in set(ids[:2]):
            own = [r for r in got if r["paper_id"] == k]
            assert [r["item_idx"] for r in own] == list(range(len(own)))


def test_pages_are_solved_without_joins(spark):
    """A page's body size is told where its items are: nothing but the deal by pages is shuffled."""
    items = spark.createDataFrame([(1, 0, 0, "some words", 72.0, 400.0, 50.0, 10.0, 612.0, 792.0), (1, 0, 1, "12", 300.0, 50.0, 9.0, 10.0, 612.0, 792.0)], "paper_id long, page int, item_idx long, str string, x double, y double, width double, height double, page_w double, page_h double")
    got = layout.solve_pages(items)
    assert [r["text"] for r in got.collect()] == ["some words"]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_map_is_traced_by_stretches_of_glyphs(spark):
    """One row meets a glyph, not one for each of its characters; wrong, missing and put-in characters count."""
    n = 400
    glyphs = spark.createDataFrame([(1, 0, 5, "a𝒳" * n), (1, 0, 6, "xyz")], "paper long, page int, seq long, text string")
    text = "a𝒳" * n + " " + "xyZ" + "q" + "-"
    maps = ([5] * 2 * n + [-1] + [6] * 3 + [7, -1], [*range(2 * n), -1, 0, 1, 2, 0, -1])
    paras = spark.createDataFrame([(1, 0, text, text, [], *maps), (1, 0, "", "", [], [], [])], "paper_id long, page int, text string, translation string, tokens array<struct<id: string, raw: string>>, glyphs array<long>, places array<int>")
    assert pages.untraced(paras, glyphs).collect() == [(1, 0, 2 * n + 4, 3, True)]
    rows = paras.withColumn("same", F.lit(True)).mapInArrow(pages._stretches, "paper_id long, page int, same boolean, seq long, place int, run string").orderBy("seq", "run").collect()
    assert [(r["seq"], r["run"]) for r in rows] == [(-1, ""), (-1, " -"), (5, "a𝒳" * n), (6, "xyZ"), (7, "q")]


def test_nothing_of_pages_is_broadcast(spark):
    """Tables of a row for each page grow with the input, however small a file of few columns makes them look."""
    for df in (catalog.QUERIES["paragraph_breaks"](spark, "/root/testdata/sf0.001"), catalog.QUERIES["page_map"](spark, "/root/testdata/sf0.001")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
