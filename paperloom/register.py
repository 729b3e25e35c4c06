"""SQL names for the library's functions: register(spark), then e.g. SELECT font_role('CMMI10'); SELECT * FROM sentence_rows('A b. C d.')."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import glyphs, requests, sentences
from paperloom.operators import formula, layout


@F.pandas_udf(T.StringType())
def text_key(texts: pd.Series) -> pd.Series:
    """Hash and length of texts as they are."""
    some = [t or "" for t in texts]
    return pd.Series([f"{h:x}-{len(t.encode('utf-16-le', 'surrogatepass')) // 2}" for h, t in zip(requests.hashes(some), some, strict=True)])


def _each(work: Callable[[str], str]) -> Callable:
    """A function over batches: each distinct text is worked on once."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        some = texts.fillna("")
        known = {t: work(t) for t in set(some)}
        return some.map(known)

    return run


@F.pandas_udf(T.StructType().add("latex", "string").add("tag", "string").add("score", "double"))
def formula_of(glyphs_: pd.Series, bars: pd.Series) -> pd.DataFrame:
    """LaTeX, number and display score of an array of glyphs and an array of bars (x1, x2, y)."""
    out = []
    for gs, bs in zip(glyphs_, bars, strict=True):
        boxes = [formula.glyph(g["text"] or "", g["x"], g["y"], g["w"], g["h"], g["role"] or "", bool(g["bold"])) for g in (gs if gs is not None else [])]
        lines = [formula.Bar(b["x1"], b["x2"], b["y"]) for b in (bs if bs is not None else [])]
        left, right = min((b.x for b in boxes), default=0.0), max((b.right for b in boxes), default=0.0)
        out.append((*formula.reconstruct(boxes, lines), formula.display_score(boxes, lines, left, right)[0]))
    return pd.DataFrame(out, columns=["latex", "tag", "score"])


def register(spark: SparkSession) -> list[str]:
    """Functions of texts and glyphs under their names; the names."""
    functions = {"text_key": text_key, "sentence_spans": sentences.sentence_spans, "decode_glyphs": glyphs.decoded, "inline_tokens": layout.inline_tokens, "font_role": _each(lambda n: glyphs.face(n)[0]), "text_latex": _each(glyphs.latex), "balanced_latex": _each(formula.balanced), "formula_of": formula_of}
    for name, f in functions.items():
        spark.udf.register(name, f)
    spark.udtf.register("sentence_rows", sentences.sentence_rows)
    return [*functions, "sentence_rows"]
