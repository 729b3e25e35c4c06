"""Queries that SQL can't say, held against plain Python over the same rows, and sources, sinks and SQL names."""

import json
import random
import re

from paperloom.functions import glyphs, requests, sentences
from paperloom.operators import formula, layout, reports, vectors
from paperloom.plans import catalog, geometry_queries, page_queries
from paperloom.register import register
from paperloom.sources import papers
from paperloom.streaming import events
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_drawn_rules_match_a_scan(spark, monkeypatch):
    seen = {}
    extract = vectors.extracted
    monkeypatch.setattr(vectors, "extracted", lambda ops: extract(seen.setdefault("ops", ops)))
    got = sorted(tuple(r)[:7] for r in geometry_queries.drawn_rules(spark, DATA).collect())
    want = []
    pages = {}
    for r in sorted(seen["ops"].collect(), key=lambda r: r["seq"]):
        pages.setdefault((r["paper"], r["page"]), []).append(r)
    for key, ops in pages.items():
        m, saved, last = [1, 0, 0, 1, 0, 0], [], None
        at = lambda x, y: (m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5])  # noqa: E731, B023

        def shape(kind, p, q):
            x1, x2, y1, y2 = *sorted((p[0], q[0])), *sorted((p[1], q[1]))
            w, h = x2 - x1, y2 - y1
            if kind == "line" and h <= 1.2 and w >= 2.2 or kind == "rect" and w > 0 and 0 < h <= 2.6 and w >= 2.2:
                want.append((*key, "h", x1, (y1 + y2) / 2, x2, (y1 + y2) / 2))  # noqa: B023
            elif kind == "line" and w <= 1.2 and h >= 4 or kind == "rect" and 0 < w <= 2.6 and h >= 4:
                want.append((*key, "v", (x1 + x2) / 2, y1, (x1 + x2) / 2, y2))  # noqa: B023
            elif kind == "rect" and w >= 14 and h >= 12:
                want.append((*key, "r", x1, y1, x2, y2))  # noqa: B023

        for r in ops:
            args = list(r["args"])
            if r["op"] == "save":
                saved.append(list(m))
            elif r["op"] == "restore":
                m = saved.pop() if saved else [1, 0, 0, 1, 0, 0]
            elif r["op"] == "transform":
                b = args
                m = [m[0] * b[0] + m[2] * b[1], m[1] * b[0] + m[3] * b[1], m[0] * b[2] + m[2] * b[3], m[1] * b[2] + m[3] * b[3], m[0] * b[4] + m[2] * b[5] + m[4], m[1] * b[4] + m[3] * b[5] + m[5]]
            else:
                if r["op"] == "path":
                    last = None
                for op in r["subs"] if r["op"] == "path" else [r["op"]]:
                    n = {"move": 2, "line": 2, "rect": 4, "curve": 6}.get(op, 0)
                    v, args = args[:n], args[n:]
                    if op == "move":
                        last = at(*v)
                    elif op == "line":
                        if last:
                            shape("line", last, at(*v))
                        last = at(*v)
                    else:
                        if op == "rect":
                            shape("rect", at(v[0], v[1]), at(v[0] + v[2], v[1] + v[3]))
                        last = None
    near = lambda rows: sorted((*r[:3], *(round(x, 6) for x in r[3:])) for r in rows)
    assert near(got) == near(want)


def test_rule_boxes_keep_captions_and_far_rules_apart(spark):
    rule = lambda y, page=1, x1=60.0, x2=300.0: (1, page, "h", x1, y, x2, y, 0.5, int(y))
    rows = [*map(rule, (700.0, 650.0, 600.0, 400.0, 350.0, 300.0)), rule(500.0, 2), rule(450.0, 2), rule(448.0, 2), rule(720.0, 3), rule(690.0, 3), rule(140.0, 3), rule(110.0, 3), *(rule(y, 4) for y in (500.0, 480.0, 440.0, 420.0)), rule(490.0, 4, 90.0)]
    rules = spark.createDataFrame(rows, vectors.RULE)
    captions = spark.createDataFrame([(1, 4, 70.0, 200.0, 460.0)], "paper long, page int, x double, right double, y double")
    got = sorted((r["page"], r["min_y"], r["max_y"], r["n_rules"]) for r in vectors.clustered(rules, captions, 612.0, 792.0).collect())
    assert got == [(1, 300.0, 400.0, 3), (1, 600.0, 700.0, 3)]
    assert vectors.clustered(rules.limit(0), captions, 612.0, 792.0).count() == 0


def test_sentences_cover_their_lines(spark):
    rows = catalog.QUERIES["sentence_split"](spark, DATA).collect()
    from paperloom.sources.tables import lines

    text = {(r["doc_id"], r["line_no"]): r["line"] for r in lines(spark, DATA).collect()}
    by = {}
    for r in rows:
        assert text[r["doc_id"], r["line_no"]][r["start"] : r["end"]] == r["sentence"] == r["sentence"].strip()
        by.setdefault((r["doc_id"], r["line_no"]), []).append((r["start"], r["sentence"]))
    for key, t in text.items():
        bare = lambda s: re.sub(r"\s", "", s)
        assert "".join(bare(s) for _, s in sorted(by.get(key, []))) == bare(t)
        if re.fullmatch(r"[A-Za-zäöüßéèàçñ ,.]*", t):  # plain prose: a dot, white space, and no small letter or comma after it
            want = re.split(r"(?<=\.)\s+(?![a-z,])", t.strip())
            got = [s for _, s in sorted(by.get(key, []))]
            if not any(sentences.abbreviated(w) or sentences.listed(w) for w in want):
                assert got == [w for w in want if w], t


def test_tokens_keep_their_text(spark):
    for r in catalog.QUERIES["inline_math_tokens"](spark, DATA).limit(300).collect():
        assert r["n_tokens"] == len(re.findall(r"⟦M\d+⟧", r["text"])) - ("⟦M1⟧ = ⟦M2⟧ 3 px" in r["text"]) * 2


def test_solved_pages_keep_all_characters(spark):
    items = page_queries.text_items(spark, DATA).filter("paper_id < 40")
    got = {}
    for r in layout.solve_pages(items).orderBy("paper_id", "page", "para").collect():
        got.setdefault((r["paper_id"], r["page"]), []).append(r["text"])
    want = {}
    for r in items.collect():
        want.setdefault((r["paper_id"], r["page"]), []).append(r["str"])
    bare = lambda parts: sorted(re.sub(r"[\s\-]", "", "".join(parts)))
    assert {k: bare(v) for k, v in got.items()} == {k: bare(v) for k, v in want.items() if any(s.strip() for s in v)}


def test_formulas_on_a_page(spark):
    rows = [("We define the loss of the model as follows here", 72.0, 600.0, 230.0, 10.0, "body-serif"), ("y", 200.0, 560.0, 6.0, 10.0, "math-italic"), ("=", 210.0, 560.0, 7.0, 10.0, "math-symbol"), ("a", 223.0, 567.0, 5.0, 8.0, "math-italic"), ("b", 223.0, 553.0, 5.0, 8.0, "math-italic"), ("(4)", 520.0, 560.0, 14.0, 10.0, "body-serif"), ("where the sum is over all of the items in it.", 72.0, 520.0, 220.0, 10.0, "body-serif")]
    items = spark.createDataFrame([(1, 1, n, *r[:5], 612.0, 792.0, r[5]) for n, r in enumerate(rows)], "paper_id long, page int, item_idx long, str string, x double, y double, width double, height double, page_w double, page_h double, role string")
    bars = spark.createDataFrame([(1, 1, 222.0, 229.0, 563.5)], "paper_id long, page int, x1 double, x2 double, y double")
    got = [(r["type"], r["latex"], r["tag"]) for r in layout.solve_pages(items, bars).orderBy("para").collect()]
    assert got == [("body", None, None), ("formula", r"y = \frac{a}{b}", "(4)"), ("body", None, None)]


def test_first_fit_rows_of_large_items_equal_a_plain_scan():
    # small ones have a second tolerance: test_paths has the whole rule
    import random

    r = random.Random(2)
    for _ in range(30):
        items = [layout.Item(i, "x", r.randrange(500), r.randrange(60) * 2.0, 5, r.choice([10.0, 10.0, 9.0]), "") for i in range(60)]
        rows, ys = [], []
        for i in sorted(items, key=lambda i: (-i.y, i.x, i.idx)):
            at = next((k for k, y in enumerate(ys) if abs(y - i.y) <= 3.8), None)
            if at is None:
                rows.append([])
                ys.append(i.y)
                at = len(rows) - 1
            rows[at].append(i.idx)
        assert [[i.idx for i in row] for row in layout.baseline_rows(items, 10.0)] == rows


def test_characters():
    assert glyphs.decode("\x0b\x0c", "body-serif")[:2] == ("fffi", "fffi")
    assert glyphs.decode("\x10\x31\x36", "math-ext")[:2] == ("()", "()")
    assert glyphs.decode("𝐀𝒞𝔼𝑥", "unknown")[:2] == ("ACEx", r"\mathbf{A} \mathcal{C} \mathbb{E} x")
    for font in ("CMMI10", "CMSY10", "CMEX10", "CMR10", "SymbolMT", "Odd"):  # white space is in no encoding, and no control character stays
        assert glyphs.decode(" \t\n\r ", font)[:2] == ("     ", "")
        assert not any(ord(c) < 32 or 0x7F <= ord(c) <= 0x9F for c in glyphs.decode("".join(map(chr, range(0x100))), font).text)
    assert glyphs.decode("ψx", "Odd").latex == r"\psi x" and glyphs.decode("ϱς", "Odd").latex == r"\varrho \varsigma" and glyphs.decode("\x00\x0bx", "CMMIB10").latex == r"\boldsymbol{\Gamma} \boldsymbol{\alpha} \boldsymbol{x}"
    assert glyphs.decode("\x00", "CMSY10")[:2] == ("−", "-") and glyphs.decode("\x36", "CMEX10").piece and glyphs.decode("", "Odd") == ("", "", *[False] * 6)


def test_hashes_are_fnv_over_utf16():
    texts = ["", "a", "é𝒳", "long " * 50] + [f"t{i}" for i in range(60)]

    def plain(t):
        h, raw = 2166136261, t.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 16777619) % 2**32
        return h

    assert requests.hashes(texts) == [plain(t) for t in texts]
    assert requests.hashes([]) == []


def test_sql_names(spark):
    assert "sentence_rows" in register(spark)
    got = spark.sql("SELECT sentence FROM sentence_rows('It is so. And so it is.')").collect()
    assert [r[0] for r in got] == ["It is so.", "And so it is."]
    assert spark.sql("SELECT text_key('a') AS k, size(sentence_spans('A b. C d.')) AS n").first()[:] == (f"{requests.hashes(['a'])[0]:x}-1", 2)
    assert spark.sql("SELECT font_role('QZLXPR+CMMI10'), font_role(null), text_latex('αx ≤ ψ'), balanced_latex('{a'), decode_glyphs(chr(15), 'CMMIB10').latex").first()[:] == ("math-italic", "unknown", r"\alpha x \leq \psi", "{a}", r"\boldsymbol{\epsilon}")
    glyphs_ = "array(named_struct('text', 'x', 'x', 1D, 'y', 5D, 'w', 5D, 'h', 10D, 'role', 'math-italic', 'bold', false))"
    assert spark.sql(f"SELECT formula_of({glyphs_}, array(named_struct('x1', 0D, 'x2', 1D, 'y', 0D))).latex").first()[0] == "x"


def test_papers_on_disk(spark, tmp_path):
    note = {"id": "a", "page": 1, "text": "t"}
    files = {"paper_1.json": {"annotations": []}, "paper_1.bak.json": {"annotations": [note]}, "paper_2.json": {"annotations": [note], "sentenceTranslations": {"k": ["x"], "l": [" "]}}, "paper_3.bak.json": {"translations": {"k": "v"}}}
    for name, data in files.items():
        (tmp_path / name).write_text(json.dumps(data, indent=1))
    (tmp_path / "paper_4.json").write_text("{broken")
    got = papers.scan(spark, str(tmp_path))
    assert {(r["key"], len(r["annotations"]), tuple(r["sentence_translations"]), tuple(r["translations"])) for r in got.collect()} == {("1", 1, (), ()), ("2", 1, ("k",), ()), ("3", 0, (), ("k",))}
    papers.write(got, str(tmp_path / "out"))
    back = papers.read(spark, str(tmp_path / "out"))
    assert {(r["key"], len(r["annotations"])) for r in back.collect()} == {("1", 1), ("2", 1), ("3", 0)}
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7")
    assert [(r["name"], r["size"]) for r in papers.binaries(spark, str(tmp_path)).select("name", "size").collect()] == [("a.pdf", 8)]
    (tmp_path / "items.json").write_text(json.dumps({"paper_id": 1, "page": 2, "items": [{"str": "x", "fontName": "f", "transform": [9, 0, 0, 9, 1, 2]}]}))
    assert papers.items(spark, str(tmp_path / "items.json")).select("str", "height", "y").first()[:] == ("x", 9.0, 2.0)


def test_micro_batches_are_bounded(spark):
    sizes = events.micro_batches(spark.range(0, 103, 1, 4), 10).groupBy("_micro").agg(F.count("*").alias("n")).collect()
    assert max(r["n"] for r in sizes) <= 10 and sum(r["n"] for r in sizes) == 103


def test_empty_inputs(spark):
    none = spark.createDataFrame([], vectors.RULE)
    marks = spark.createDataFrame([], "paper long, page int, x double, y double, right double, top double, bottom double, radical boolean")
    assert vectors.deduplicated(none, 612.0, 792.0).count() == vectors.math_bars(none, marks, 612.0, 792.0, 10.0).count() == vectors.footnote_rules(none, marks, 612.0, 792.0, 10.0).count() == 0
    assert papers.restored(spark.createDataFrame([], "key string, main string, backup string")).count() == 0
    assert formula.reconstruct([], [], 10.0) == ("", "")


def test_rule_boxes_are_first_fit_and_pages_are_streams(spark):
    """Against a plain scan of all boxes; no page's rules are put into one row."""
    r, rules, captions = random.Random(9), [], []
    for page in range(12):
        rules += [(1, page, "h", 12.0 * r.randrange(4), y := r.randrange(60, 1500) / 2, 150.0 + 10 * r.randrange(4), y, 0.5, n) for n in range(r.choice([5, 40, 300]))]
        captions += [(1, page, x := r.uniform(0, 60), x + r.uniform(5, 90), r.uniform(30, 760)) for _ in range(r.choice([0, 3, 9]))]
    want = []
    for page in range(12):
        found = []
        for *_, x1, y, x2, _, _, _ in sorted((q for q in rules if q[1] == page), key=lambda q: (-q[4], q[3], q[8])):
            if x2 - x1 < 118:
                continue
            for c in found:
                a, b, top = c[-1]
                between = any(y + 2 < m[4] < top - 2 and m[2] >= min(a, x1) - 10 and m[3] <= max(b, x2) + 10 for m in captions if m[1] == page)
                if abs(x1 - a) <= 16 and abs(x2 - b) <= 16 and 0 <= top - y <= 160 and not between:
                    c.append((x1, x2, y))
                    break
            else:
                found.append([(x1, x2, y)])
        for c in found:
            heights = []
            for *_, y in c:
                heights += [y] if all(abs(h - y) > 2.5 for h in heights) else []
            if len(heights) >= 3:
                want.append((1, page, min(x[0] for x in c), max(x[1] for x in c), min(x[2] for x in c), max(x[2] for x in c), len(heights)))
    df = vectors.clustered(spark.createDataFrame(rules, vectors.RULE), spark.createDataFrame(captions, "paper long, page int, x double, right double, y double"), 612.0, 792.0)
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_questions_and_paragraphs_meet_within_their_page(spark):
    """Against all pairs; equal lines aren't told as pairs, and a page with many selections is looked through once."""
    r = random.Random(4)
    words = ["alpha beta gamma", "delta", "epsilon zeta eta theta", "x" * 30]
    paras = [(p, 1, n, f" {' '.join(r.choice(words) for _ in range(r.randint(0, 6)))} ") for p in range(6) for n in range(r.choice([3, 30, 150]))] + [(9, 1, n, "the same line of text in all of a page") for n in range(3000)]
    asks = [(p, g, n, t[r.randint(0, 8) :][: r.choice([2, 20, 60])]) for p, g, n, t in paras if p != 9] + [(9, 1, n, "same line of text in all") for n in range(3000)]
    texts, questions = spark.createDataFrame(paras, "paper long, page int, id long, text string"), spark.createDataFrame(asks, "paper long, page int, id long, selected string")
    want = sorted((p, g, i, k) for p, g, i, s in asks if s[:40] and p != 9 for q, _, k, t in paras if q == p and s[:40] in t.strip(" "))
    assert sorted(map(tuple, reports.asked(texts.filter("paper <> 9"), questions.filter("paper <> 9")).collect())) == want
    got = {tuple(a[:3]): tuple(a[3:]) for a in reports.answers(texts, questions).collect()}
    assert {k: v for k, v in got.items() if k[0] != 9} == {k: (len(v), min(v)) for k in {w[:3] for w in want} for v in [[w[3] for w in want if w[:3] == k]]}
    assert all(got[9, 1, n] == (3000, 0) for n in range(3000))
    assert "Join" not in reports.answers(texts, questions)._jdf.queryExecution().optimizedPlan().toString()
