"""Queries of pages, sentences, tokens and streams; SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import glyphs
from paperloom.functions.sentences import sentences
from paperloom.operators import formula, layout
from paperloom.session import made, parts_of, shared_dir, written
from paperloom.sources.tables import LINES_SQL, lines, table
from paperloom.streaming import events, timed

#: Lines of a page: 40, in two columns on odd pages.
ROWS = 40
#: Characters of an item.
WIDTH = 40


def text_items(spark: SparkSession, d: str) -> DataFrame:
    """Words of all lines as items on pages, set like a paper: one column on even pages, two on odd ones."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    parts = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda raw: F.filter(F.regexp_extract_all(raw, F.lit(f"(?s).{{1,{WIDTH}}}"), F.lit(0)), lambda s: F.trim(s) != ""))
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():  # a document is one row, in which its items are numbered
        rows = docs.select("doc_id", F.posexplode(F.flatten(parts)).alias("seq", "str"))
    else:
        rows = docs.select("doc_id", F.posexplode(parts).alias("line_no", "p")).select("doc_id", "line_no", F.posexplode("p").alias("part", "str"))
        rows = rows.withColumn("seq", F.expr("row_number() over (partition by doc_id order by line_no, part) - 1"))
    rows = rows.withColumn("seq", F.col("seq").cast("long"))
    page, at = F.floor(F.col("seq") / ROWS).cast("int"), F.col("seq") % ROWS
    two = page % 2 == 1
    right = two & (at >= ROWS // 2)
    return rows.select(
        F.col("doc_id").alias("paper_id"), page.alias("page"), F.col("seq").alias("item_idx"), "str", F.when(right, 320.0).otherwise(72.0).alias("x"),
        (700.0 - 14 * F.when(two, at % (ROWS // 2)).otherwise(at)).alias("y"), (F.length("str") * 5.0).alias("width"), F.lit(10.0).alias("height"), F.lit(612.0).alias("page_w"), F.lit(792.0).alias("page_h"),
    )


def body_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_suppkey AS paper_id", "l_linenumber AS page", "l_orderkey AS item_idx", "repeat('x', int(l_quantity)) AS str", "5 + l_discount * 100 + l_tax * 10 AS height")
    return layout.body_sizes(rows)


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.solve_lines(text_items(spark, d)).select("paper_id", "page", "line_no", "section", F.md5("text").alias("text_md5"))


def page_solver(spark: SparkSession, d: str) -> DataFrame:
    return layout.solve_pages(text_items(spark, d))


FORMULA = """CASE event_id % 5
 WHEN 0 THEN array(named_struct('text', 'y', 'x', 100D, 'y', 500D, 'w', 6D, 'h', 10D, 'role', 'math-italic', 'bold', false), named_struct('text', '=', 'x', 110D, 'y', 500D, 'w', 7D, 'h', 10D, 'role', 'body-serif', 'bold', false),
  named_struct('text', cast(user_id % 10 AS string), 'x', 123D, 'y', 507D, 'w', 5D, 'h', 8D, 'role', 'body-serif', 'bold', false), named_struct('text', cast(event_id % 7 AS string), 'x', 123D, 'y', 493D, 'w', 5D, 'h', 8D, 'role', 'body-serif', 'bold', false))
 WHEN 1 THEN array(named_struct('text', '√', 'x', 150D, 'y', 496D, 'w', 8D, 'h', 12D, 'role', 'math-symbol', 'bold', false), named_struct('text', chr(97 + user_id % 26), 'x', 158D, 'y', 500D, 'w', 6D, 'h', 10D, 'role', 'math-italic', 'bold', event_id % 2 = 0), named_struct('text', 'k', 'x', 164.5D, 'y', 497D, 'w', 4.5D, 'h', 7D, 'role', 'math-italic', 'bold', false))
 WHEN 2 THEN array(named_struct('text', '∑', 'x', 180D, 'y', 495D, 'w', 14D, 'h', 18D, 'role', 'math-ext', 'bold', false), named_struct('text', 'i', 'x', 184D, 'y', 486D, 'w', 3.5D, 'h', 7D, 'role', 'math-italic', 'bold', false), named_struct('text', 'N', 'x', 184D, 'y', 515D, 'w', 6D, 'h', 7D, 'role', 'math-italic', 'bold', false),
  named_struct('text', 'x', 'x', 198D, 'y', 500D, 'w', 6D, 'h', 10D, 'role', 'math-italic', 'bold', false), named_struct('text', '(' || (user_id % 90 + 1) || ')', 'x', 510D, 'y', 500D, 'w', 14D, 'h', 10D, 'role', 'body-serif', 'bold', false))
 WHEN 3 THEN array(named_struct('text', 'X', 'x', 126D, 'y', 500D, 'w', 8D, 'h', 10D, 'role', 'math-italic', 'bold', false), named_struct('text', cast(user_id % 100 AS string), 'x', 134.5D, 'y', 497D, 'w', 6D, 'h', 7D, 'role', 'body-serif', 'bold', false), named_struct('text', 't', 'x', 134.5D, 'y', 505D, 'w', 3.5D, 'h', 7D, 'role', 'math-italic', 'bold', false))
 ELSE array(named_struct('text', 'where', 'x', 72D, 'y', 500D, 'w', 30D, 'h', 10D, 'role', 'body-serif', 'bold', false), named_struct('text', 'the', 'x', 110D, 'y', 500D, 'w', 20D, 'h', 10D, 'role', 'body-serif', 'bold', false), named_struct('text', 'loss', 'x', 140D, 'y', 500D, 'w', 20D, 'h', 10D, 'role', 'body-serif', 'bold', false)) END"""
BARS = "CASE event_id % 5 WHEN 0 THEN array(named_struct('x1', 122D, 'x2', 129D, 'y', 503.5D)) WHEN 1 THEN array(named_struct('x1', 158D, 'x2', 170D, 'y', 509.5D)) END"


def math_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    """LaTeX, numbers and verdicts of formulas from their glyphs' places: fractions, roots, sums with limits, scripts, and prose."""
    rows = table(spark, d, "events").select("event_id", F.expr(FORMULA).alias("glyphs"), F.expr(BARS).alias("bars"), F.lit(72.0).alias("col_left"), F.lit(540.0).alias("col_right"))
    return formula.formulas(rows, {"event_id": "long"}).select("event_id", "latex", "tag", "display")


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return sentences(lines(spark, d), ["doc_id", "line_no"], "line")


def inline_math_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).select("doc_id", "line_no", F.concat("line", F.lit(" with α_1 ∈ ℝ^{d} and x ≤ y")).alias("t")).select("doc_id", "line_no", layout.inline_tokens("t").alias("r"))
    return rows.select("doc_id", "line_no", F.col("r.text").alias("text"), F.size("r.tokens").alias("n_tokens"), F.md5(layout.restored(F.col("r.text"), F.col("r.tokens"))).alias("restored_md5"))


def font_roles(spark: SparkSession, d: str) -> DataFrame:
    names = "element_at(array('CMR10', 'CMMI10', 'QZLXPR+CMSY10', 'CMEX10', 'MSBM10', 'SimSun', 'Times-Roman', 'Arial', 'Courier', 'EUFM10', 'Odd'), int(event_id % 11) + 1)"
    return table(spark, d, "events").select(glyphs.font_role(F.expr(names)).alias("role")).groupBy("role").agg(F.count("*").alias("n"))


#: Fonts with what their names say.
FONTS = {
    "CMR10": ("body-serif", False, False), "QZLXPR+CMMIB10": ("math-italic", True, True), "CMSY10": ("math-symbol", False, False), "CMEX10": ("math-ext", False, False), "MSBM10": ("math-bb", False, False), "RSFS10": ("math-cal", True, False),
    "EUFB10": ("math-frak", False, False), "Times-BoldItalic": ("body-serif", True, True), "Arial-Black": ("body-sans", False, True), "Courier-Oblique": ("mono", True, False), "SimSun": ("cjk", False, False), "XITSMath-Bold": ("math-symbol", False, True),
    "Georgia-It": ("body-serif", True, False), "Odd-B": ("unknown", False, True), "CMTI8": ("body-serif", True, False), "Verdana": ("body-sans", False, False),
}
NAMES = ", ".join(f"'{n}'" for n in FONTS)


def font_families(spark: SparkSession, d: str) -> DataFrame:
    """Role, slant and weight of fonts, and which short italic texts count as mathematics."""
    rows = table(spark, d, "events").select("event_id", F.expr(f"element_at(array({NAMES}), int(event_id % {len(FONTS)}) + 1)").alias("name"), F.expr("CASE event_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN '=' WHEN 2 THEN 'word' ELSE ' y1 ' END").alias("text"))
    face = glyphs.font(F.col("name"))
    m = glyphs.math_flags(F.col("text"), face, F.col("name"), F.lit("CMR10"))
    return rows.select("event_id", face["role"].alias("role"), face["italic"].alias("italic"), face["bold"].alias("bold"), m["font"].alias("math_font"), m["token"].alias("math_token"))


#: Fonts of all encodings and roles, as name: encoding, role, bold.
FACES = {
    "CMMI10": ("oml", "math-italic", False), "QZLXPR+CMMIB10": ("oml", "math-italic", True), "CMSY10": ("oms", "math-symbol", False), "CMEX10": ("omx", "math-ext", False), "CMR10": ("ot1", "body-serif", False), "SymbolMT": ("symbol", "math-symbol", False),
    "MSBM10": ("", "math-bb", False), "RSFS10": ("", "math-cal", False), "Times-Roman": ("", "body-serif", False), "XITSMath": ("", "math-symbol", False), "Odd": ("", "unknown", False),
}
STYLED = "𝐀𝑏𝒞𝔇𝔼𝛼𝟎ﬃ𝒙𝓑𝟙𝚪𝔞𝜖𝞹𝑍𝗔𝛢"


def decoded_glyphs(spark: SparkSession, d: str) -> DataFrame:
    """Text, LaTeX and properties of characters at all slots of fonts of all encodings: alone, before a letter, in the private area; and of styled letters."""
    n = len(FACES)
    code = f"int(event_id div {n} % 255 + 1)"
    raw = f"CASE WHEN event_id % 10 = 9 THEN substring('{STYLED}', int(event_id div 10 % {len(STYLED)}) + 1, 1) WHEN event_id % 4 = 1 THEN chr({code}) || 'x' WHEN event_id % 4 = 2 THEN decode(unhex('F0' || lpad(hex({code}), 2, '0')), 'UTF-16BE') ELSE chr({code}) END"
    rows = table(spark, d, "events").selectExpr("event_id", f"{raw} AS raw", f"element_at(array({', '.join(map(repr, FACES))}), int(event_id % {n}) + 1) AS font")
    return rows.select("event_id", glyphs.decoded("raw", "font").alias("g")).select("event_id", "g.text", "g.latex", "g.large", "g.tall", "g.radical", "g.piece", "g.mathematical")


PARTED = "CASE event_id % 6 WHEN 0 THEN '])|' WHEN 1 THEN '= max x' WHEN 2 THEN ', lim' WHEN 3 THEN 'maximum' WHEN 4 THEN '((' ELSE 'text' END"
PARTED_ROLE = "CASE event_id % 4 WHEN 0 THEN 'math-ext' WHEN 1 THEN 'body-serif' WHEN 2 THEN 'math-symbol' ELSE 'body-sans' END"


def glyph_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of items that are glyphs of their own, with their places."""
    rows = table(spark, d, "events").select("event_id", F.posexplode(glyphs.parts(F.expr(PARTED), F.expr(PARTED_ROLE))).alias("part", "p"))
    return rows.select("event_id", F.col("part").cast("long").alias("part"), "p.str", F.round(100 + 40 * F.col("p.share") * F.col("p.at") / F.length("p.str"), 6).alias("x"), F.round(40 * F.col("p.share"), 6).alias("w"))


PARTS = 4
FOLDER = Callable[[], None]


def staged(spark: SparkSession, rows: DataFrame, order: str) -> tuple[str, list[FOLDER]]:
    """A folder and what fills it, one after another: PARTS stretches of rows by time (ts), each written by many tasks, and a row that closes all windows."""
    folder = made(spark, f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}")
    n = max(PARTS, parts_of(spark))
    ranged = rows.repartitionByRange(n, "ts", order).withColumn("_part", F.floor(F.spark_partition_id() * PARTS / n).cast("int"))
    parts = written(ranged, "parts")
    last = parts.agg(F.max("ts").alias("m")).select((F.col("m") + F.expr("INTERVAL 10 YEAR")).alias("ts"))
    closing = last.select(*(F.col("ts") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes))
    stretches = [parts.filter(F.col("_part") == k).drop("_part") for k in range(PARTS)]
    return folder, [lambda df=df: df.write.mode("append").parquet(folder) for df in (*stretches, closing)]


def _stream(spark: SparkSession, rows: DataFrame, order: str, schema: str = events.SCHEMA) -> tuple[DataFrame, list[FOLDER]]:
    folder, arrivals = staged(spark, rows, order)
    return events.source(spark, folder, schema), arrivals


def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Events that are sent twice, ten minutes apart: one of each."""
    rows = table(spark, d, "events")
    twice = rows.unionByName(rows.withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 MINUTE")))
    stream, arrivals = _stream(spark, twice, "event_id")
    return events.run(events.deduplicated(stream.filter("event_id is not null"), ["event_id"]), arrivals).groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    stream, arrivals = _stream(spark, table(spark, d, "events"), "event_id")
    rows = events.run(events.windows(stream, "1 hour"), arrivals).filter("event_type is not null")
    return rows.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    stream, arrivals = _stream(spark, table(spark, d, "events"), "event_id")
    rows = events.run(events.sessions(stream, "30 minutes"), arrivals).filter("user_id is not null")
    return rows.select("user_id", F.unix_micros("session_window.start").alias("start"), "n")


PIECE = "CASE WHEN event_id % 4 = 0 THEN '' ELSE left(event_type, 3) END"


def stream_replies(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of replies by user until nothing came for an hour: their text, number and first time."""
    stream, arrivals = _stream(spark, table(spark, d, "events"), "event_id")
    rows = stream.withColumn("piece", F.expr(PIECE))
    out = events.run(events.replies(rows, "user_id", "piece", "event_id", "1 hour"), arrivals).filter("user_id is not null")
    return out.select("user_id", F.unix_micros("session_window.start").alias("start"), F.md5("text").alias("text_md5"), "n_pieces", F.unix_micros("first_ts").alias("first"))


HOUR = 3_600_000


def stream_timeouts(spark: SparkSession, d: str) -> DataFrame:
    """Replies by user that end when nothing came for six hours, or a day after they began."""
    stream, arrivals = _stream(spark, table(spark, d, "events"), "event_id")
    rows = stream.withColumn("piece", F.expr(PIECE))
    # filters come after: one before would go below the watermark, and the row that closes all windows with it
    out = events.run(timed.replies(rows, "user_id", "piece", "event_id", 6 * HOUR, 24 * HOUR), arrivals).filter("key is not null")
    return out.select(F.col("key").alias("user_id"), "why", F.md5("text").alias("text_md5"), "n_pieces", "start", "end", "first")


def stream_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The context of each conversation after its last batch; one is forgotten a day after its last turn."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", (F.timestamp_seconds(F.col("turn") * 60 + 86_400)).cast("timestamp_ntz").alias("ts"))
    stream, arrivals = _stream(spark, rows, "conv_id", "conv_id long, turn long, role string, text string, ts timestamp_ntz")
    got = events.run(timed.conversations(stream.filter("conv_id is not null"), 24 * HOUR), arrivals, "update")
    last = got.groupBy("key").agg(F.max_by(F.struct("n_turns", "context"), "batch").alias("s"))
    return last.select(F.col("key").alias("conv_id"), "s.n_turns", F.md5("s.context").alias("context_md5"))


#: The characters and commands by encoding and slot, written out by hand: nothing here comes from the library.
DECODED_SQL = rf"""
WITH runs(enc, start, chars, texs) AS (VALUES
 ('oml', 0, 'Γ Δ Θ Λ Ξ Π Σ Υ Φ Ψ Ω α β γ δ ϵ', '\Gamma \Delta \Theta \Lambda \Xi \Pi \Sigma \Upsilon \Phi \Psi \Omega \alpha \beta \gamma \delta \epsilon'),
 ('oml', 16, 'ζ η θ ι κ λ μ ν ξ π ρ σ τ υ ϕ χ ψ ω ε ϑ ϖ ϱ ς φ', '\zeta \eta \theta \iota \kappa \lambda \mu \nu \xi \pi \rho \sigma \tau \upsilon \phi \chi \psi \omega \varepsilon \vartheta \varpi \varrho \varsigma \varphi'),
 ('oml', 58, '. , < / > ⋆ ∂', '. , < / > \star \partial'), ('oml', 91, '♭ ♮ ♯ ⌣ ⌢ ℓ', '\flat \natural \sharp \smile \frown \ell'), ('oml', 123, 'ı ȷ ℘ ⃗', '\imath \jmath \wp \vec'),
 ('oms', 0, '− ⋅ × ∗ ÷ ⋄ ± ∓ ⊕ ⊖ ⊗ ⊘ ⊙ ◯ ∘ ∙', '- \cdot \times \ast \div \diamond \pm \mp \oplus \ominus \otimes \oslash \odot \bigcirc \circ \bullet'),
 ('oms', 16, '≍ ≡ ⊆ ⊇ ≤ ≥ ≼ ≽ ∼ ≈ ⊂ ⊃ ≪ ≫ ≺ ≻', '\asymp \equiv \subseteq \supseteq \leq \geq \preceq \succeq \sim \approx \subset \supset \ll \gg \prec \succ'),
 ('oms', 32, '← → ↑ ↓ ↔ ↗ ↘ ≃ ⇐ ⇒ ⇑ ⇓ ⇔ ↖ ↙ ∝', '\leftarrow \rightarrow \uparrow \downarrow \leftrightarrow \nearrow \searrow \simeq \Leftarrow \Rightarrow \Uparrow \Downarrow \Leftrightarrow \nwarrow \swarrow \propto'),
 ('oms', 48, '′ ∞ ∈ ∋ △ ▽ ̸', '^\prime \infty \in \ni \triangle \bigtriangledown \not'), ('oms', 56, '∀ ∃ ¬ ∅ ℜ ℑ ⊤ ⊥', '\forall \exists \neg \emptyset \Re \Im \top \perp'),
 ('oms', 91, '∪ ∩ ⊎ ∧ ∨ ⊢ ⊣ ⌊ ⌋ ⌈ ⌉ {{ }} ⟨ ⟩ | ∥', '\cup \cap \uplus \wedge \vee \vdash \dashv \lfloor \rfloor \lceil \rceil \{{ \}} \langle \rangle | \|'),
 ('oms', 110, '\', '\setminus'), ('oms', 112, '√', '\sqrt'), ('oms', 114, '∇ ∫ ⊔ ⊓ ⊑ ⊒ § † ‡', '\nabla \int \sqcup \sqcap \sqsubseteq \sqsupseteq \S \dagger \ddagger'),
 ('omx', 0, '( ) [ ] ⌊ ⌋ ⌈ ⌉ {{ }} ⟨ ⟩ | ∥ / \ ( ) ( ) [ ] ⌊ ⌋ ⌈ ⌉ {{ }} ⟨ ⟩', '( ) [ ] \lfloor \rfloor \lceil \rceil \{{ \}} \langle \rangle | \| / \backslash ( ) ( ) [ ] \lfloor \rfloor \lceil \rceil \{{ \}} \langle \rangle'),
 ('omx', 32, '( ) [ ]', '( ) [ ]'), ('omx', 40, '{{ }} ⟨ ⟩', '\{{ \}} \langle \rangle'), ('omx', 48, '( ) [ ]', '( ) [ ]'), ('omx', 56, '{{ }}', '\{{ \}}'),
 ('omx', 70, '⊔ ⊔ ∮ ∮ ⊙ ⊙ ⊕ ⊕ ⊗ ⊗ ∑ ∏ ∫ ⋃ ⋂ ⊎ ⋀ ⋁', '\bigsqcup \bigsqcup \oint \oint \bigodot \bigodot \bigoplus \bigoplus \bigotimes \bigotimes \sum \prod \int \bigcup \bigcap \biguplus \bigwedge \bigvee'),
 ('omx', 88, '∑ ∏ ∫ ⋃ ⋂ ⊎ ⋀ ⋁ ∐ ∐', '\sum \prod \int \bigcup \bigcap \biguplus \bigwedge \bigvee \coprod \coprod'), ('omx', 98, '̂ ̂ ̂ ̃ ̃ ̃', '\widehat \widehat \widehat \widetilde \widetilde \widetilde'), ('omx', 112, '√ √ √ √ √', '\sqrt \sqrt \sqrt \sqrt \sqrt'),
 ('ot1', 0, 'Γ Δ Θ Λ Ξ Π Σ Υ Φ Ψ Ω ff fi fl ffi ffl ı ȷ ` ´ ˇ ˘ ¯ ˚', '\Gamma \Delta \Theta \Lambda \Xi \Pi \Sigma \Upsilon \Phi \Psi \Omega ff fi fl ffi ffl \imath \jmath ` '' \check \breve \bar \mathring'), ('ot1', 25, 'ß æ œ ø Æ Œ Ø', 'ss ae oe o AE OE O'),
 ('symbol', 34, '∀', '\forall'), ('symbol', 36, '∃', '\exists'), ('symbol', 39, '∋', '\ni'), ('symbol', 42, '∗', '\ast'), ('symbol', 45, '−', '-'), ('symbol', 64, '≅', '\cong'), ('symbol', 94, '⊥', '\perp'), ('symbol', 126, '∼', '\sim'),
 ('symbol', 65, 'Α Β Χ Δ Ε Φ Γ Η Ι ϑ Κ Λ Μ Ν Ο Π Θ Ρ Σ Τ Υ ς Ω Ξ Ψ Ζ', 'A B X \Delta E \Phi \Gamma H I \vartheta K \Lambda M N O \Pi \Theta P \Sigma T \Upsilon \varsigma \Omega \Xi \Psi Z'),
 ('symbol', 97, 'α β χ δ ε φ γ η ι ϕ κ λ μ ν ο π θ ρ σ τ υ ϖ ω ξ ψ ζ', '\alpha \beta \chi \delta \varepsilon \phi \gamma \eta \iota \varphi \kappa \lambda \mu \nu o \pi \theta \rho \sigma \tau \upsilon \varpi \omega \xi \psi \zeta'),
 ('symbol', 162, '′ ≤', '^\prime \leq'), ('symbol', 165, '∞', '\infty'), ('symbol', 171, '↔ ← ↑ → ↓', '\leftrightarrow \leftarrow \uparrow \rightarrow \downarrow'), ('symbol', 177, '± ″ ≥ × ∝ ∂ ∙ ÷ ≠ ≡ ≈', '\pm ^{{\prime\prime}} \geq \times \propto \partial \bullet \div \neq \equiv \approx'),
 ('symbol', 196, '⊗ ⊕ ∅ ∩ ∪ ⊃ ⊇', '\otimes \oplus \emptyset \cap \cup \supset \supseteq'), ('symbol', 204, '⊂ ⊆ ∈ ∉', '\subset \subseteq \in \notin'), ('symbol', 209, '∇', '\nabla'), ('symbol', 213, '∏ √ ⋅ ¬ ∧ ∨ ⇔ ⇐', '\prod \sqrt \cdot \neg \wedge \vee \Leftrightarrow \Leftarrow'),
 ('symbol', 222, '⇒', '\Rightarrow'), ('symbol', 225, '⟨', '\langle'), ('symbol', 229, '∑', '\sum'), ('symbol', 241, '⟩ ∫', '\rangle \int')),
slots AS (SELECT enc, start + i - 1 AS code, string_split(chars, ' ')[i] AS t, string_split(texs, ' ')[i] AS l FROM runs, range(1, 33) r(i) WHERE i <= len(string_split(chars, ' '))),
fonts(f, enc, role, bold) AS (VALUES (0, 'oml', 'italic', false), (1, 'oml', 'italic', true), (2, 'oms', '', false), (3, 'omx', '', false), (4, 'ot1', '', false), (5, 'symbol', '', false), (6, '', 'bb', false), (7, '', 'cal', false), (8, '', '', false), (9, '', '', false), (10, '', '', false)),
styled(i, t, l) AS (VALUES (0, 'A', '\mathbf{{A}}'), (1, 'b', 'b'), (2, 'C', '\mathcal{{C}}'), (3, 'D', '\mathfrak{{D}}'), (4, 'E', '\mathbb{{E}}'), (5, 'α', '\alpha'), (6, '0', '\mathbf{{0}}'), (7, 'ffi', 'ffi'), (8, 'x', '\boldsymbol{{x}}'), (9, 'B', '\mathcal{{B}}'), (10, '1', '\mathbb{{1}}'), (11, 'Γ', '\Gamma'), (12, 'a', '\mathfrak{{a}}'), (13, 'ϵ', '\epsilon'), (14, 'π', '\pi'), (15, 'Z', 'Z'), (16, '𝗔', '𝗔'), (17, '𝛢', '𝛢')),
e AS (SELECT event_id, event_id % 11 AS f, event_id // 11 % 255 + 1 AS code, CASE WHEN event_id % 10 = 9 THEN 3 ELSE CASE event_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END END AS kind, event_id // 10 % 18 AS i FROM events),
j AS (
  SELECT e.*, fonts.enc, role, bold, chr(e.code::INT) AS c, own.t AS ot, own.l AS ol, sym.t AS st, sym.l AS sl, e.code BETWEEN 65 AND 90 AS letter,
         fonts.enc = 'omx' AND (e.code BETWEEN 52 AND 55 OR e.code BETWEEN 58 AND 67 OR e.code IN (117, 118)) OR (fonts.enc = 'symbol' OR (kind = 2 AND fonts.enc IN ('', 'ot1'))) AND (e.code BETWEEN 230 AND 239 OR e.code BETWEEN 243 AND 254) AS part,
         e.code < 32 OR e.code BETWEEN 127 AND 159 AS control
  FROM e JOIN fonts USING (f) LEFT JOIN slots own ON own.enc = fonts.enc AND own.code = e.code AND (own.enc <> 'oml' OR e.code <= 39 OR kind = 2) LEFT JOIN slots sym ON sym.enc = 'symbol' AND sym.code = e.code AND kind = 2 AND fonts.enc IN ('', 'ot1')),
w AS (
  SELECT *, CASE WHEN kind <> 2 AND code IN (9, 10, 13, 32) THEN 'space' WHEN part THEN 'part' WHEN enc = 'oms' AND letter THEN 'cal' WHEN ot IS NOT NULL THEN 'own' WHEN role = 'bb' AND letter THEN 'bb' WHEN st IS NOT NULL THEN 'sym' WHEN role = 'cal' AND letter THEN 'cal'
                 WHEN control AND code IN (9, 10, 13) THEN 'space' WHEN control AND code = 15 THEN 'eps' WHEN control THEN 'gone' WHEN code IN (172, 177, 181, 183, 215, 247) THEN 'known' ELSE 'plain' END AS how FROM j),
o AS (
  SELECT event_id, f, kind, i, enc, code, how, c, bold, ot, st,
         CASE how WHEN 'space' THEN ' ' WHEN 'part' THEN '' WHEN 'gone' THEN '' WHEN 'own' THEN ot WHEN 'sym' THEN st WHEN 'eps' THEN 'ϵ' WHEN 'bb' THEN coalesce((MAP {{'C': 'ℂ', 'H': 'ℍ', 'N': 'ℕ', 'P': 'ℙ', 'Q': 'ℚ', 'R': 'ℝ', 'Z': 'ℤ'}})[c], c) ELSE c END AS t,
         CASE how WHEN 'space' THEN ' ' WHEN 'part' THEN '' WHEN 'gone' THEN '' WHEN 'cal' THEN '\mathcal{{' || c || '}} ' WHEN 'bb' THEN '\mathbb{{' || c || '}} ' WHEN 'eps' THEN CASE WHEN bold THEN '\boldsymbol{{\epsilon}} ' ELSE '\epsilon ' END
           WHEN 'own' THEN CASE WHEN bold AND starts_with(ol, '\') THEN '\boldsymbol{{' || ol || '}} ' WHEN enc = 'oml' OR starts_with(ol, '\') THEN ol || ' ' ELSE ol END WHEN 'sym' THEN CASE WHEN starts_with(sl, '\') THEN sl || ' ' ELSE sl END
           WHEN 'known' THEN CASE code WHEN 172 THEN '\neg ' WHEN 177 THEN '\pm ' WHEN 181 THEN '\mu ' WHEN 183 THEN '\cdot ' WHEN 215 THEN '\times ' ELSE '\div ' END
           ELSE CASE WHEN bold AND regexp_matches(c, '^[A-Za-z]$') THEN '\boldsymbol{{' || c || '}} ' WHEN c IN ('%', '#', '&', '_') THEN '\' || c ELSE c END END AS l,
         CASE WHEN bold THEN '\boldsymbol{{x}}' ELSE 'x' END AS lx
  FROM w),
x AS (
  SELECT o.event_id, o.kind, how, code, enc, CASE WHEN kind = 3 THEN s.t WHEN kind = 1 THEN o.t || CASE WHEN enc = 'oms' THEN '§' WHEN enc = 'symbol' THEN 'ξ' ELSE 'x' END ELSE o.t END AS t,
         CASE WHEN kind = 3 THEN s.l WHEN kind = 1 THEN o.l || CASE WHEN enc = 'oms' THEN '\S' WHEN enc = 'symbol' THEN '\xi' ELSE lx END ELSE o.l END AS l, o.t AS one
  FROM o LEFT JOIN styled s ON s.i = o.i)
SELECT event_id, t AS text, trim(regexp_replace(l, '\s+', ' ', 'g')) AS latex,
       kind <> 3 AND ((how = 'own' AND ((enc = 'omx' AND code BETWEEN 70 AND 97) OR (enc IN ('oms', 'symbol') AND one IN ('∏', '∑', '∫')))) OR (how = 'sym' AND one IN ('∏', '∑', '∫'))) AS large,
       kind <> 3 AND how = 'own' AND enc = 'omx' AND code < 70 AS tall, kind <> 3 AND how IN ('own', 'sym') AND one = '√' AS radical, kind IN (0, 2) AND how IN ('part', 'gone') AS piece,
       CASE WHEN kind = 3 THEN t NOT IN ('ffi', '𝗔', '𝛢') ELSE how IN ('cal', 'bb', 'sym', 'eps', 'known') OR (how = 'own' AND (enc <> 'ot1' OR code <= 10)) OR (kind = 1 AND enc IN ('oms', 'symbol')) END AS mathematical
FROM x
"""

QUERIES = {f.__name__: f for f in (body_sizes, page_lines, page_solver, math_reconstruct, sentence_split, inline_math_tokens, font_roles, font_families, decoded_glyphs, glyph_parts, stream_dedupe, stream_windows, stream_sessions, stream_replies, stream_timeouts, stream_conversations)}
ORACLES = {
    "math_reconstruct": r"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'y = \frac{' || user_id % 10 || '}{' || event_id % 7 || '}' WHEN 1 THEN '\sqrt{' || CASE WHEN event_id % 2 = 0 THEN '\mathbf{' || chr((97 + user_id % 26)::INT) || '}' ELSE chr((97 + user_id % 26)::INT) END || '_{k}}' WHEN 2 THEN '\sum_{i}^{N} x' WHEN 3 THEN 'X_{' || user_id % 100 || '}^{t}' ELSE '\mathrm{where} \mathrm{the} \operatorname{loss}' END AS latex,
 CASE WHEN event_id % 5 = 2 THEN '(' || (user_id % 90 + 1) || ')' ELSE '' END AS tag, event_id % 5 <> 4 AS display FROM events""",
    "page_lines": rf"""WITH {LINES_SQL}, p AS (SELECT doc_id, line_no, unnest(range(greatest(0, (length(raw) - 1) // 40) + 1)) AS part, raw FROM lines), i AS (SELECT doc_id AS paper_id, trim(substring(raw, part * 40 + 1, 40)) AS t, length(substring(raw, part * 40 + 1, 40)) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part) - 1 AS seq FROM p WHERE trim(substring(raw, part * 40 + 1, 40)) <> ''),
 a AS (SELECT *, seq // 40 AS page, seq % 40 AS pos FROM i), b AS (SELECT *, page % 2 = 1 AND pos >= 20 AS right_, CASE WHEN page % 2 = 1 THEN pos % 20 ELSE pos END AS row_ FROM a), r AS (SELECT paper_id, page, row_, max(n) FILTER (NOT right_) AS l, max(n) FILTER (right_) AS k FROM b GROUP BY ALL),
 v AS (SELECT paper_id, page, count(*) FILTER (l >= 15 AND k >= 16) AS dual, count(*) FILTER (k IS NULL AND l >= 15 AND 72 + 5 * l < 0.62 * 612) AS one FROM r GROUP BY ALL), m AS (SELECT *, dual >= 3 OR (dual >= 2 AND one >= 2) AS two FROM v),
 j AS (SELECT b.*, two, r.k IS NOT NULL AS both_, r.l FROM b JOIN m USING (paper_id, page) JOIN r USING (paper_id, page, row_)), lead_ AS (SELECT paper_id, page, row_, bool_or(NOT two AND NOT right_ AND both_ AND regexp_matches(t, '(?i)^(?:where|with|for|and)\b') AND 248 - 5 * l >= 20) AS cut FROM j GROUP BY ALL),
 z AS (SELECT j.paper_id, j.page, j.row_, CASE WHEN two THEN CASE WHEN right_ THEN 'right' ELSE 'left' END ELSE 'full' END AS section, CASE WHEN two OR cut THEN right_::INT ELSE 0 END AS side, string_agg(t, ' ' ORDER BY right_) AS text FROM j JOIN lead_ l ON l.paper_id = j.paper_id AND l.page = j.page AND l.row_ = j.row_ GROUP BY ALL)
 SELECT paper_id, page::INT AS page, (row_number() OVER (PARTITION BY paper_id, page ORDER BY CASE WHEN section = 'full' THEN 0 ELSE side END, row_, side) - 1)::INT AS line_no, section, md5(text) AS text_md5 FROM z""",
    "body_sizes": """WITH s AS (SELECT l_suppkey AS paper_id, l_linenumber AS page, l_orderkey AS i, floor(l_quantity)::BIGINT AS n, 5 + l_discount * 100 + l_tax * 10 AS h FROM lineitem),
 g AS (SELECT paper_id, page, floor(h * 2 + 0.5) / 2 AS mode, sum(n) AS w, min(i) AS f FROM s WHERE n >= 3 AND h BETWEEN 6 AND 18 GROUP BY ALL)
 SELECT paper_id, page, greatest(7.0, least(14.0, mode))::DOUBLE AS body FROM g QUALIFY row_number() OVER (PARTITION BY paper_id, page ORDER BY w DESC, f) = 1""",
    "font_roles": "SELECT (['body-serif', 'math-italic', 'math-symbol', 'math-ext', 'math-bb', 'cjk', 'body-serif', 'body-sans', 'mono', 'math-frak', 'unknown'])[event_id % 11 + 1] AS role, count(*) AS n FROM events GROUP BY 1",
    "stream_dedupe": "SELECT event_type, user_id, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL",
    "stream_windows": "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b)
 SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
    "stream_replies": """WITH b AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN '' ELSE left(event_type, 3) END AS piece, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b)
 SELECT user_id, epoch_us(min(ts)) AS start, md5(coalesce(string_agg(piece, '' ORDER BY event_id) FILTER (piece <> ''), '')) AS text_md5, count(*) FILTER (piece <> '') AS n_pieces, epoch_us(min(ts) FILTER (piece <> '')) AS first FROM s GROUP BY user_id, s""",
    "stream_timeouts": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE left(event_type, 3) END AS piece, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 r AS (SELECT user_id, n, ms, ms AS began FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.ms, CASE WHEN e.ms - r.ms < 21600000 AND e.ms - r.began < 86400000 THEN r.began ELSE e.ms END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
 SELECT user_id, CASE WHEN max(ms) + 21600000 <= began + 86400000 THEN 'idle' ELSE 'total' END AS why, md5(coalesce(string_agg(piece, '' ORDER BY event_id) FILTER (piece <> ''), '')) AS text_md5, count(*) FILTER (piece <> '') AS n_pieces, began AS "start", least(max(ms) + 21600000, began + 86400000) AS "end", min(ms) FILTER (piece <> '') AS "first"
 FROM r JOIN e USING (user_id, n, ms) GROUP BY user_id, began""",
    "stream_conversations": "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) SELECT conv_id, count(*) AS n_turns, md5(string_agg(role || ': ' || left(text, 4000), chr(10) ORDER BY turn) FILTER (r <= 20)) AS context_md5 FROM t GROUP BY conv_id",
    "font_families": f"""WITH f(name, role, italic, bold) AS (VALUES {', '.join(f"('{n}', '{r}', {str(i).lower()}, {str(b).lower()})" for n, (r, i, b) in FONTS.items())}), e AS (SELECT event_id, ([{NAMES}])[event_id % {len(FONTS)} + 1] AS name, event_id % 4 AS m FROM events)
 SELECT event_id, role, italic, bold, starts_with(role, 'math') OR (italic AND m IN (0, 3)) AS math_font, starts_with(role, 'math') OR (italic AND m IN (0, 3)) OR m = 1 AS math_token FROM e JOIN f USING (name)""",
    "glyph_parts": """WITH e AS (SELECT event_id, event_id % 6 AS m, event_id % 4 AS r FROM events), p(m, kind, part, str, pos, n) AS (VALUES (0, 'd', 0, ']', 0, 3), (0, 'd', 1, ')', 1, 3), (0, 'd', 2, '|', 2, 3), (4, 'd', 0, '(', 0, 2), (4, 'd', 1, '(', 1, 2), (1, 'w', 0, '= ', 0, 7), (1, 'w', 1, 'max', 2, 7), (1, 'w', 2, ' x', 5, 7), (2, 'w', 0, ', ', 0, 5), (2, 'w', 1, 'lim', 2, 5)),
 k AS (SELECT *, CASE WHEN r = 0 THEN 'c' WHEN m IN (0, 4) AND r = 2 THEN 'd' WHEN m IN (1, 2) AND r IN (1, 2) THEN 'w' ELSE 'o' END AS kind, CASE m WHEN 0 THEN '])|' WHEN 1 THEN '= max x' WHEN 2 THEN ', lim' WHEN 3 THEN 'maximum' WHEN 4 THEN '((' ELSE 'text' END AS t FROM e),
 x AS (SELECT event_id, part, str, pos, n FROM k JOIN p ON p.m = k.m AND p.kind = k.kind UNION ALL SELECT event_id, 0, t, 0, length(t) FROM k WHERE kind = 'o' UNION ALL SELECT event_id, i, t[i + 1], i, length(t) FROM k, range(7) r(i) WHERE kind = 'c' AND i < length(t))
 SELECT event_id, part::BIGINT AS part, str, round(100 + 40.0::DOUBLE * pos / n, 6) AS x, round(40.0::DOUBLE * length(str) / n, 6) AS w FROM x""",
    "decoded_glyphs": DECODED_SQL,
}
