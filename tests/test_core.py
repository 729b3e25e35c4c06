import duckdb
import pytest

from paperloom.functions import glyphs, sentences
from paperloom.functions import requests as R
from paperloom.functions import text as T
from paperloom.operators import layout, linkage, sequences
from paperloom.plans import catalog
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    want = con.sql(catalog.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted([norm(r[c]) for c in cols] for r in df.collect()) == sorted([norm(r[i]) for i in at] for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def values(spark, texts, f):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_fingerprint_folds_white_space(spark):
    a, b, c, d = values(spark, ["a  b\n c", " a b c ", "a b d", " 　 "], R.fingerprint)
    assert a == b != c and d == ""


def test_untranslatable(spark):
    prose = ["Specifically, the loss is defined as:", "where:", "Abstract", "where ⟦M1⟧ denotes the rate and ⟦M2⟧ is the weight."]
    bare = ["https://example.org/a", "doi: 10.1234/abc", "⟦M1⟧ = ⟦M2⟧ + ⟦M3⟧", "(a) (b) (c) (d)", "∗ † ‡", "", None]
    assert values(spark, prose, T.untranslatable) == [False] * 4
    assert values(spark, bare, T.untranslatable) == [True] * 7


def test_colours(spark):
    got = values(spark, ["#ffd400", "#ff6666", "#f19837", "nothing", None, "#00ff00", "#808080"], T.colour_name)
    assert got == ["yellow", "red", "orange", "yellow", "yellow", "green", "gray"]


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("We use a CNN. It works well.", 2),
        ("This was shown by Smith et al. (2020) in prior work. Our method differs.", 2),
        ("Accuracy is 3.5 percent higher. See Fig. 2 for details.", 2),
        ("Let the set S. Then we define W. Finally Z.", 3),
        ("We propose a model. It has two parts. Experiments confirm it.", 3),
        ("It is so ... and more. End.", 2),
        ("这是第一句话。这是第二句话！还有", 3),
        ("", 0),
        (None, 0),
    ],
)
def test_sentences(text, n):
    got = sentences.split(text)
    assert len(got) == n
    assert all(text[a:b] == s for s, a, b in got)


def test_glyphs(spark):
    roles = values(spark, ["QZLXPR+CMMI10", "CMSY10", "CMEX10", "MSBM10", "SimSun", None], glyphs.font_role)
    assert roles == ["math-italic", "math-symbol", "math-ext", "math-bb", "cjk", "unknown"]
    assert glyphs.decode("\x0f", "math-italic")[:2] == ("ϵ", "\\epsilon")
    assert glyphs.decode("2", "math-symbol")[:2] == ("∈", "\\in")
    assert glyphs.decode("P", "math-ext")[:2] == ("∑", "\\sum")
    assert glyphs.decode("R", "math-bb")[:2] == ("ℝ", "\\mathbb{R}")
    assert glyphs.decode("", "SymbolMT")[0] == "α∈∑"
    assert glyphs.decode("eﬃcient ﬂow", "body-serif")[0] == "efficient flow"


def test_tokens_and_restoring(spark):
    text, tokens = layout.tokenised("We project Q ∈ ℝ^{d} and α into point_supervision.")
    assert text == "We project ⟦M1⟧ and ⟦M2⟧ into point_supervision."
    assert [t["raw"] for t in tokens] == ["Q ∈ ℝ^{d}", "α"]
    df = spark.createDataFrame([("a 【M1】 b ⟦M2⟧ $M2$", tokens)], "t string, k array<struct<id:string,raw:string,latex:string,start:int,end:int>>")
    assert df.select(layout.restored(F.col("t"), F.col("k"))).first()[0] == "a $Q \\in \\mathbb{R}^{d}$ b $\\alpha$ $\\alpha$"


def items(spark, rows):
    full = [(1, 0, n, s, float(x), float(y), 5.0 * len(s), 10.0, 612.0, 792.0) for n, (s, x, y) in enumerate(rows)]
    return spark.createDataFrame(full, "paper_id long, page int, item_idx long, str string, x double, y double, width double, height double, page_w double, page_h double")


def test_two_columns_are_read_one_after_the_other(spark):
    rows = [("A title over the whole width of this page, from left to right, quite long indeed", 72, 720)]
    rows += [(f"left line number {i} with words", 72, 690 - 14 * i) for i in range(6)] + [(f"right line number {i} with word", 330, 690 - 14 * i) for i in range(6)]
    got = layout.solve_lines(items(spark, rows)).orderBy("line_no").collect()
    assert [r["section"] for r in got] == ["full"] + ["left"] * 6 + ["right"] * 6
    assert [r["text"] for r in got][1].startswith("left line number 0")


def test_paragraphs(spark):
    rows = [("1. Introduction", 72, 700), ("The first paragraph runs over two lines and is hyphen-", 72, 680), ("ated at its end.", 72, 666), ("A second one follows here and goes on to fill the line", 72, 652), ("to its end with words.", 72, 638), ("7", 300, 30)]
    got = layout.solve_pages(items(spark, rows)).orderBy("para").collect()
    assert [r["type"] for r in got] == ["heading", "body", "body"]
    assert got[1]["text"].endswith("is hyphenated at its end.")


def test_item_match(spark):
    libs = spark.createDataFrame([("A", "/x/a.pdf", "a.pdf", 10), ("B", "/x/b.pdf", "b.pdf", 20), ("C", "/y/b.pdf", "b.pdf", 30), ("D", "/z/d.pdf", "d.pdf", 30)], "item string, path string, name string, size int")
    papers = spark.createDataFrame([(1, "/x/a.pdf", "q", 0), (2, "/o/a.pdf", "a.pdf", 0), (3, "/o/n.pdf", "n", 10), (4, "/o/b.pdf", "b.pdf", 20), (5, "/o/b.pdf", "b.pdf", 99), (6, "/o/n", "n", 30)], "paper int, path string, name string, size int")
    got = {r[0]: (r[1], r[2]) for r in linkage.item_match(papers, libs).collect()}
    assert got == {1: ("A", "path"), 2: ("A", "name"), 3: ("A", "size"), 4: ("B", "name"), 5: (None, None), 6: (None, None)}


def test_ranges_and_runs(spark):
    pages = spark.createDataFrame([(1, p) for p in (1, 2, 3, 7, 9, 10, 10)], "k int, p int")
    assert sequences.ranges(pages, ["k"], "p").first()["ranges"] == "1–3, 7, 9–10"
    turns = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate([("assistant", "hi"), ("user", "a"), ("user", "b"), ("system", "no"), ("assistant", "c" * 9)])], "conv_id int, turn int, role string, text string")
    got = [(r["role"], r["text"]) for r in sequences.history(turns, 8, 5).orderBy("run").collect()]
    assert got == [("user", "a\nb"), ("assistant", "ccccc")]


def test_empty_tables(spark):
    none = items(spark, [("x", 1, 300)]).limit(0)
    assert layout.solve_pages(none).count() == 0
