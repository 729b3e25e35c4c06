"""Column functions over LaTeX and formula text: cleaning of recognisers' output, escaping, tests of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import text as T

#: A formula between one pair of marks that don't occur within it: the four kinds of marks, in the order in which they are tried.
WRAPPED = r"(?s)^(?:\$\$((?:(?!\$\$).)+)\$\$|\\\[((?:(?!\\\[).)+)\\\]|\\\(((?:(?!\\\().)+)\\\)|\$([^$]+)\$)$"
#: What makes a line prose (words side by side, a connective at the beginning, a colon or stop at the end), and signs that are mathematics in any font.
PROSE = (r"[a-zA-Z]{3,}\s+[a-zA-Z]{3,}", r"(?i)^(?:where|with|for|and|as|based|the|in|at)(?![A-Za-z0-9_])", r"[:.]\s*$")
SIGNS = r"^[0-9+\-−=/().,θ\[\]{}|\\_′'~^$]+$"
#: Fixed value: numbers of display formulas.
TAG = r"(?i)^\(\s*(?:[A-Z]?\s*\d{1,3}(?:\.\d{1,3})?[a-z]?|[ivx]{1,4})\s*\)$"


def equation_tag(text: Column) -> Column:
    return T.trimmed(F.coalesce(text, F.lit(""))).rlike(TAG)


def collapsed(latex: Column) -> Column:
    """Spaces between letters and digits go, but not those after a command."""
    return F.trim(F.regexp_replace(F.coalesce(latex, F.lit("")), r"(?<=[A-Za-z0-9])(?<!\\[A-Za-z]{1,60})\s+(?=[A-Za-z0-9])", ""))


def unwrapped(latex: Column) -> Column:
    """Without one pair of marks around the whole, where the inside holds no such mark."""
    s = F.trim(F.coalesce(latex, F.lit("")))
    inner = F.concat(*(F.regexp_extract(s, WRAPPED, i) for i in range(1, 5)))
    return F.when(inner == "", s).otherwise(F.trim(inner))


def of_model(raw: Column) -> Column:
    """LaTeX of a vision model's reply: out of its fence and its marks of display or inline mathematics."""
    t = T.trimmed(F.coalesce(raw, F.lit("")))
    fence = r"(?si)```(?:latex|tex|math)?\s*(.*?)```"
    s = F.when(t.rlike(fence), T.trimmed(F.regexp_extract(t, fence, 1))).otherwise(t)
    cut = lambda n: T.trimmed(F.substring(s, F.lit(n + 1), F.length(s) - 2 * n))
    both = lambda a, b: F.startswith(s, F.lit(a)) & F.endswith(s, F.lit(b))
    return F.when((both("$$", "$$") | both(r"\[", r"\]")) & (F.length(s) > 4), cut(2)).when(both("$", "$") & (F.length(s) > 1) & ~F.contains(F.substring(s, F.lit(2), F.length(s) - 2), F.lit("$")), cut(1)).otherwise(s)


def image(data: Column, default: str = "image/png") -> Column:
    """struct(mime, base64) of a data address, or of bare base64."""
    raw = T.trimmed(F.coalesce(data, F.lit("")))
    url = r"(?s)^data:([^;]+);base64,(.+)$"
    whole = raw.rlike(url)
    return F.struct(F.when(whole, F.regexp_extract(raw, url, 1)).otherwise(F.lit(default)).alias("mime"), F.regexp_replace(F.when(whole, F.regexp_extract(raw, url, 2)).otherwise(raw), r"\s+", "").alias("base64"))


def escaped(text: Column) -> Column:
    """Safe within HTML."""
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def balanced(latex: Column) -> Column:
    """Every brace has its partner; escaped ones don't count."""
    marks = F.split(F.regexp_replace(F.regexp_replace(F.coalesce(latex, F.lit("")), r"\\[{}\\]", ""), "[^{}]", ""), "")
    steps = F.transform(F.filter(marks, lambda c: c != ""), lambda c: F.when(c == "{", 1).otherwise(-1))
    # the least depth on the way, and the last one
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, x: F.struct((a["d"] + x).alias("d"), F.least(a["low"], a["d"] + x).alias("low")))
    return (depth["d"] == 0) & (depth["low"] == 0)


def environments_balanced(latex: Column) -> Column:
    """As many beginnings as ends of each environment."""
    names = lambda w: F.array_sort(F.regexp_extract_all(F.coalesce(latex, F.lit("")), F.lit(rf"\\{w}\{{([a-z*]+)\}}"), F.lit(1)))
    return names("begin") == names("end")


def prose_within(latex: Column) -> Column:
    """A word of prose of three letters or more in upright text."""
    return F.coalesce(latex, F.lit("")).rlike(r"\\(?:text|mathrm|textrm)\{[^}]*[A-Za-z]{3,}[^}]*\}\s*(?:~|\\ |\s|$)") & F.coalesce(latex, F.lit("")).rlike(r"\\text\{")


def prose_line(text: Column) -> Column:
    """Any of PROSE in a line with a space."""
    t = F.coalesce(text, F.lit(""))
    return F.contains(t, F.lit(" ")) & F.exists(F.array(*map(F.lit, PROSE)), lambda p: F.regexp_like(t, p))


def math_only(glyphs: Column, body: Column, words: list[str]) -> Column:
    """All of an array of glyphs (text, size, math) are mathematics: by font, by small size, by their signs, or as one of words (names of operators, abbreviations)."""
    foreign = F.filter(glyphs, lambda g: ~g["math"] & (g["size"] > body * 0.88) & ~F.trim(g["text"]).rlike(SIGNS) & ~F.lower(F.trim(g["text"])).isin(*words))
    return (F.size(glyphs) > 0) & (F.size(foreign) == 0)


def counted_characters(latex: Column) -> Column:
    """The characters that a formula shows: without commands' names, braces and layout marks."""
    plain = F.regexp_replace(F.coalesce(latex, F.lit("")), r"\\(?:begin|end)\{[a-z*]+\}|\\[A-Za-z]+|\\.|[{}^_&\s$]", "")
    return F.filter(F.split(plain, ""), lambda c: c != "")
