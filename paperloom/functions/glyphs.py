"""Fonts and glyphs of text items: roles by font name, decoding of symbols to text and LaTeX."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import encodings as E

# Font families of each role, in the order in which they are tried; ^ marks the beginning of a name.
ROLES = {
    "math-ext": "^(?:CMEX|LMEX|LMMATHEXTENSION|EUEX|MTEX|TXEX|PXEX|STIXSIZE|MATHDESIGN.*EX)",
    "math-bb": "^(?:MSBM|BBOLD|BBM|DSROM|EUSB)",
    "math-cal": "^(?:EUSM|RSFS|CMSY.*CAL)",
    "math-frak": "^(?:EUFM|EUFB)",
    "math-symbol": r"^(?:CMSY|CMBSY|MSAM|LMSY|LMMATHSYMBOLS|MTSYN|TXSY|PXSY|SYMBOL|STANDARD\s*SYMBOLS)|CAMBRIAMATH|STIXMATH|XITSMATH|ASANA-MATH|LATINMODERN-MATH|TEXGYRE.*MATH",
    "math-italic": "^(?:CMMI|LMMI|LMMATHITALIC|MTMI|EURM|EUBM|TXMI|PXMI)",
    "cjk": "SIMSUN|SIMHEI|KAITI|FANGSONG|SONGTI|HEITI|YAHEI|SOURCEHAN|NOTO.*CJK|NOTO.*SC|FANDOL|STSONG|STHEITI|DFKAI|MINGLIU|GOTHIC|MINCHO|^FZ",
    "mono": r"^(?:CMTT|LMTT|ECTT)|COURIER|CONSOLAS|INCONSOLATA|MENLO|MONACO|FIRA\s*CODE|JETBRAINS\s*MONO|MONOSPACE",
    "body-sans": r"^(?:CMSS|LMSS|ECSS)|ARIAL|HELVETICA|CALIBRI|ROBOTO|NIMBUSSAN|UNIVERS|FRUTIGER|GILL\s*SANS|VERDANA|TAHOMA",
    "body-serif": "^(?:CMR|CMTI|CMBX|CMSL|LMR|ECTI|ECRM|ECBX)|TIMES|NIMBUSROM|PALATINO|GARAMOND|GEORGIA|CHARTER|UTOPIA|MINION|CENTURY|BOOKMAN|BASKERVILLE",
}
# Parts of names of bold and of italic fonts, and roles that are upright or italic whatever the name says.
BOLD = "BOLD|CMBX|CMMIB|CMBSY|BX|BD|HEAVY|BLACK|-B(?![A-Z0-9_])"
ITALIC = "ITALIC|OBLIQUE|SLANT|CMMI|CMTI|CMSL|MTMI|EURM|-IT(?![A-Z0-9_])"
UPRIGHT, SLANTED = ("math-ext", "math-bb", "math-frak"), ("math-cal", "math-italic")
MATH_ROLES = ("math-italic", "math-symbol", "math-ext", "math-bb", "math-cal", "math-frak")


# Slots of brackets, parentheses and braces in the extension font that are set narrower or wider than others.
NARROW, MIDDLE, WIDE = ("\x02", "\x03", "\x14", "\x15"), ("\x00", "\x01", "\x12", "\x13"), ("\x08", "\x09", "\x1a", "\x1b")


def without_subset(name: Column) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"^[A-Z]{6}\+", "")


def font_role(name: Column) -> Column:
    up = F.upper(without_subset(name))
    out = None
    for role, pattern in ROLES.items():
        out = F.when(up.rlike(pattern), role) if out is None else out.when(up.rlike(pattern), role)
    return out.otherwise("unknown")


def font(name: Column) -> Column:
    """struct(role, italic, bold) of a font's name."""
    up, role = F.upper(without_subset(name)), font_role(name)
    italic = F.when(role.isin(*UPRIGHT), F.lit(False)).when(role.isin(*SLANTED), F.lit(True)).otherwise(up.rlike(ITALIC))
    return F.struct(role.alias("role"), italic.alias("italic"), up.rlike(BOLD).alias("bold"))


def math_flags(text: Column, face: Column, name: Column, dominant: Column) -> Column:
    """struct(font, token): set in a mathematical font, or as a short italic variable of another font than the page's; and whether it counts as mathematics."""
    short = face["italic"] & (without_subset(name) != dominant) & F.trim(text).rlike("^[A-Za-z](?:[0-9]|'[0-9]?)?$")
    of_font = face["role"].isin(*MATH_ROLES) | short
    return F.struct(of_font.alias("font"), (of_font | F.trim(text).rlike("^[=+\\-−×÷±∓≤≥≠≈≡∼∝∈∉⊂⊃⊆⊇∪∩⊕⊗⊥⊤∥∑∏∫√∂∇]+$")).alias("token"))


def parts(text: Column, role: Column) -> Column:
    """array<struct<str, at, share, before, word>>: the parts of an item that are glyphs of their own, where each begins, its share of the width and that of the parts before it, and whether it is an operator's name.

    Delimiters set in one string, and an operator's name after a sign; anything else is one part.
    """
    t = F.coalesce(text, F.lit(""))
    operator = r"(?i)^([^A-Za-z0-9_]*(?:[=()\[\],;:]\s*|\s+))(max|min|argmin|argmax|sup|inf|lim)(?![A-Za-z0-9_])(.*)$"
    delimiters = (role == "math-ext") | ((role == "math-symbol") & F.trim(t).rlike("^[()\\[\\]|{}⟨⟩⌊⌋⌈⌉]+$"))
    worded = t.rlike(operator) & role.isin("body-serif", "math-symbol", "unknown")
    cut = (
        F.when((F.length(t) > 1) & delimiters, F.filter(F.split(t, ""), lambda c: c != ""))
        .when(worded, F.filter(F.array(*(F.regexp_extract(t, operator, i) for i in (1, 2, 3))), lambda c: c != ""))
        .otherwise(F.array(t))
    )
    single = (F.length(t) > 1) & delimiters
    width = lambda c: F.when(single, F.when(c.isin(*NARROW), 0.528).when(c.isin(*MIDDLE), 0.736).when(c.isin(*WIDE), 0.75).otherwise(0.6)).otherwise(F.length(c).cast("double"))
    added = lambda cs: F.aggregate(cs, F.lit(0.0), lambda n, x: n + width(x))
    whole = F.greatest(added(cut), F.lit(0.1))
    one = lambda c, i: F.struct(c.alias("str"), F.aggregate(F.slice(cut, 1, i), F.lit(0), lambda n, x: n + F.length(x)).alias("at"), (width(c) / whole).alias("share"), (added(F.slice(cut, 1, i)) / whole).alias("before"), (worded & ~single & (i == 1)).alias("word"))
    whole_one = F.array(F.struct(t.alias("str"), F.lit(0).alias("at"), F.when(t == "", 0.0).otherwise(1.0).alias("share"), F.lit(0.0).alias("before"), F.lit(False).alias("word")))
    return F.when(single | worded, F.transform(cut, one)).otherwise(whole_one)  # nearly all items are one part, for which nothing is cut or added up


def _pairs(text: str) -> dict[str, str]:
    words = text.split()
    return {(chr(int(c[2:], 16)) if c.startswith("\\u") else c): latex for c, latex in zip(words[::2], words[1::2], strict=True)}


KNOWN = _pairs(E.COMMANDS)
BOTH = KNOWN | _pairs(E.SLOT_COMMANDS)


class Sign(NamedTuple):
    """What stands at a slot. tall, large, radical, accent, piece: what it is to a formula; mathematical: whether it makes the string so."""

    text: str
    latex: str
    large: bool = False
    tall: bool = False
    accent: bool = False
    radical: bool = False
    piece: bool = False
    mathematical: bool = True


def _slots(runs: dict[int, str]) -> Iterator[tuple[int, str]]:
    return ((first + i, c) for first, run in runs.items() for i, c in enumerate(run) if c != "·")


def _encoding(runs: dict[int, str], own: str = "", pieces: tuple[int, ...] = (), make: Callable[[int, str, str], Sign] = lambda slot, c, latex: Sign(c, latex)) -> dict[int, Sign]:
    latex = BOTH | _pairs(own)
    return {slot: make(slot, c, latex.get(c, c)) for slot, c in _slots(runs)} | dict.fromkeys(pieces, Sign("", "", piece=True, mathematical=False))


ENCODINGS = {
    "oml": _encoding(E.OML),
    "oms": _encoding(E.OMS, E.OMS_COMMANDS, make=lambda slot, c, latex: Sign(c, latex, large=c == "∫", radical=c == "√")) | {n: Sign(chr(n), f"\\mathcal{{{chr(n)}}} ") for n in range(0x41, 0x5B)},
    "omx": _encoding(E.OMX, E.OMX_COMMANDS, E.OMX_PIECES, lambda slot, c, latex: Sign(c, latex, large=0x46 <= slot <= 0x61, tall=slot < 0x46, accent=0x62 <= slot <= 0x67, radical=c == "√")),
    "ot1": _encoding(E.OT1, E.OT1_COMMANDS, make=lambda slot, c, latex: Sign(c, latex, mathematical=slot <= 0x0A)) | {n: Sign(c, c, mathematical=False) for n, c in E.OT1_LIGATURES.items()},
    "symbol": _encoding(E.SYMBOL, E.SYMBOL_COMMANDS, E.SYMBOL_PIECES, lambda slot, c, latex: Sign(c, latex, large=c in "∏∑∫", radical=c == "√")),
}


def command(c: str) -> str:
    """The LaTeX of one character."""
    return KNOWN.get(c, c)


def spaced(latex: str) -> str:
    """A command ends with a space, so that a letter may follow."""
    return latex + " " if latex.startswith("\\") else latex


def latex(text: str) -> str:
    """LaTeX of a text's characters; a command has a space after it where a letter follows."""
    return re.sub(r"(\\[A-Za-z]+)\x00(?=[A-Za-z])", r"\1 ", "".join(command(c) + "\0" * (c in KNOWN) for c in text)).replace("\0", "")


#: Styles of mathematical alphanumerics by their Unicode names, with what they are in LaTeX; Greek letters have none.
STYLES = {"BOLD": "mathbf", "ITALIC": "", "BOLD ITALIC": "boldsymbol", "SCRIPT": "mathcal", "BOLD SCRIPT": "mathcal", "FRAKTUR": "mathfrak", "DOUBLE-STRUCK": "mathbb"}
_STYLED = re.compile("MATHEMATICAL (.*?) (CAPITAL|SMALL|DIGIT|PARTIAL|EPSILON|THETA|KAPPA|PHI|RHO|PI)( .*)?")
CAPITALS_ONLY = ("SCRIPT", "BOLD SCRIPT", "DOUBLE-STRUCK")


def styled(c: str) -> tuple[str, str] | None:
    """Base character and LaTeX of a mathematical alphanumeric, if it is one of those that LaTeX has."""
    m = _STYLED.fullmatch(unicodedata.name(c, "")) if "\U0001d400" <= c <= "\U0001d7ff" else None
    if not m:
        return None
    style, kind, base = m[1], m[2], chr(int(unicodedata.decomposition(c).split()[1], 16))  # one step: further ones make epsilon symbols letters
    if not base.isascii():
        return (base, KNOWN.get(base, base)) if base in KNOWN or kind != "CAPITAL" else None
    if style not in STYLES or (kind == "SMALL" and style in CAPITALS_ONLY) or (kind == "DIGIT" and style not in ("BOLD", "DOUBLE-STRUCK")):
        return None
    return base, f"\\{STYLES[style]}{{{base}}}" if STYLES[style] else base


@lru_cache(4096)
def face(name: str) -> tuple[str, str, bool]:
    """Role, encoding and weight of a font; the name of a role stands for a TeX font of that role."""
    up = re.sub(r"^[A-Z]{6}\+", "", name).strip().upper()
    if name in ROLES:
        return name, {"math-ext": "omx", "math-symbol": "oms", "math-italic": "oml", "body-serif": "ot1"}.get(name, ""), False
    role = next((r for r, p in ROLES.items() if re.search(p, up)), "unknown")
    return role, next((e for e, p in E.FONTS.items() if re.search(p, up)), ""), re.search(BOLD, up) is not None


@lru_cache(1 << 16)
def character(c: str, font: str) -> Sign:
    """What a character in a font is. LaTeX with the space that must follow it."""
    role, encoding, bold = face(font)
    if c in " \t\n\r":  # white space is in no encoding
        return Sign(" ", " ", mathematical=False)
    if c in E.LIGATURES:
        return Sign(E.LIGATURES[c], E.LIGATURES[c], mathematical=False)
    if pair := styled(c):
        return Sign(pair[0], pair[1] + " ")
    private = "\uf000" <= c <= "\uf0ff"
    code = ord(c) - 0xF000 if private else ord(c)
    own = ENCODINGS.get(encoding, {}).get(code)
    if encoding == "oml":
        own = own if code <= 0x27 or private else None
        if own:
            return own._replace(latex=(f"\\boldsymbol{{{own.latex}}}" if bold and own.latex.startswith("\\") else own.latex) + " ")
    if own and not (encoding == "ot1" and code > 0x1F):
        return own._replace(latex=spaced(own.latex))
    letter = chr(code) if 0x41 <= code <= 0x5A else ""
    if letter and role == "math-bb":
        return Sign(E.DOUBLE_STRUCK.get(letter, letter), f"\\mathbb{{{letter}}} ")
    if private and encoding in ("", "ot1") and (sign := ENCODINGS["symbol"].get(code)):
        return sign._replace(latex=spaced(sign.latex))
    if letter and role == "math-cal":
        return Sign(letter, f"\\mathcal{{{letter}}} ")
    if code < 0x20 or 0x7F <= code <= 0x9F:
        if code in (9, 10, 13):
            return Sign(" ", " ", mathematical=False)
        if code == 0x0F:  # the one slot that is worth keeping in fonts without an encoding
            return Sign("ϵ", "\\boldsymbol{\\epsilon} " if bold else "\\epsilon ")
        return Sign("", "", piece=True, mathematical=False)
    c = chr(code)
    about = {"large": c in E.LARGE, "accent": c in E.ACCENTS, "radical": c == "√"}
    if c in KNOWN:
        return Sign(c, spaced(KNOWN[c]), **about)
    latex = f"\\boldsymbol{{{c}}} " if bold and role == "math-italic" and c.isascii() and c.isalpha() else f"\\{c}" if c in "%#&_" else c
    return Sign(c, latex, mathematical=False, **about)


_WHITE = re.compile(r"[\s\ufeff]+")


@lru_cache(4096)
def _plain(font: str) -> set[str]:
    """Characters met in a font that are themselves, also in LaTeX, and have no properties."""
    return set()


def decode(raw: str, font: str) -> Sign:
    """Text, LaTeX and properties of a string in a font; a piece is a string of nothing but pieces of delimiters."""
    plain = _plain(font)
    if new := set(raw) - plain:
        plain |= {c for c in new if (s := character(c, font))[:2] == (c, c) and not any(s[2:])}
    if not new or plain.issuperset(new):
        return Sign(raw, _WHITE.sub(" ", raw).strip(), mathematical=False)
    signs = [character(c, font) for c in raw]
    latex = _WHITE.sub(" ", "".join(s.latex for s in signs)).strip()
    flags = {k: any(getattr(s, k) for s in signs) for k in ("large", "tall", "accent", "radical", "mathematical")}
    return Sign("".join(s.text for s in signs), latex, piece=bool(signs) and all(s.piece for s in signs), **flags)


DECODED = T.StructType().add("text", "string").add("latex", "string")
for _flag in Sign._fields[2:]:
    DECODED.add(_flag, "boolean")


@F.pandas_udf(DECODED)
def decoded(raw: pd.Series, font: pd.Series) -> pd.DataFrame:
    """struct(text, latex, large, tall, accent, radical, piece, mathematical); each distinct pair of a string and a font in a batch is decoded once."""
    pairs = list(zip(raw.fillna(""), font.fillna(""), strict=True))
    known = {p: decode(*p) for p in set(pairs)}
    return pd.DataFrame([known[p] for p in pairs], columns=list(Sign._fields))
