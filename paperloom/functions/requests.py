"""Column functions around model calls: keys of requests, their options, and what replies hold."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from paperloom.functions import text as T

# Names of languages as prompts call them, kinds of errors worth another try, heads of failed outputs, words around appended terms.
LANGUAGES = {"zh-CN": "简体中文", "zh-TW": "繁体中文", "en": "英文", "ja": "日语", "ko": "韩语", "de": "德语", "fr": "法语"}
RETRIABLE = ("rate-limit", "server", "network", "timeout", "empty")
FAILED = ("[未能", "[翻译出错")
TERMS_OPEN, TERMS_CLOSE, TERMS_BETWEEN = "\n\n（术语原文：", "）", "、"


def hashes(texts: list[str]) -> list[int]:
    """32-bit FNV-1a over UTF-16 units: a unit of all texts at once while many are that long, the rest text by text."""
    raw = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64) for t in texts]
    order = sorted(range(len(raw)), key=lambda i: -len(raw[i]))
    size = np.array([len(raw[i]) for i in order], np.int64)
    flat = np.concatenate([raw[i] for i in order]) if len(raw) else np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    h = np.full(len(order), 2166136261, np.uint64)
    few = min(24, len(order))
    together = int(size[few]) if few < len(order) else 0  # units that more than few texts have
    for t in range(together):
        n = int(np.searchsorted(-size, -t))
        h[:n] = (h[:n] ^ flat[first[:n] + t]) * np.uint64(16777619) & np.uint64(0xFFFFFFFF)
    out = [0] * len(raw)
    for k, i in enumerate(order):
        x = int(h[k])
        for c in raw[i][together:].tolist():
            x = ((x ^ c) * 16777619) & 0xFFFFFFFF
        out[i] = x
    return out


@F.pandas_udf(S.StringType())
def keyed(texts: pd.Series) -> pd.Series:
    """Hash in hexadecimal and number of UTF-16 units of each text."""
    some = [t or "" for t in texts]
    return pd.Series([f"{h:x}-{len(t.encode('utf-16-le', 'surrogatepass')) // 2}" for h, t in zip(hashes(some), some, strict=True)])


def fingerprint(text: Column) -> Column:
    """Key of the folded text; empty for a blank text."""
    t = T.folded(text)
    return F.when(t == "", F.lit("")).otherwise(keyed(t))


def content_key(text: Column, language: Column, model: Column) -> Column:
    """Key of a request: language, model and the text as it is."""
    return keyed(F.concat(language, F.lit("|"), model, F.lit("|"), text))


def engine_tag(service: Column, model: Column, prompt_version: Column) -> Column:
    return F.substring_index(keyed(F.concat(service, F.lit("|"), model, F.lit("|"), prompt_version)), "-", 1)


def language_name(code: Column) -> Column:
    c = F.trim(F.when(F.coalesce(code, F.lit("")) == "", F.lit("zh-CN")).otherwise(code))
    names = F.create_map(*(F.lit(x) for p in LANGUAGES.items() for x in p))
    return F.coalesce(F.try_element_at(names, c), c)


def usable(text: Column) -> Column:
    """Not blank and not the note of a failure."""
    t = F.coalesce(text, F.lit(""))
    return (T.trimmed(t) != "") & ~F.startswith(t, F.lit(FAILED[0])) & ~F.startswith(t, F.lit(FAILED[1]))


def retriable(kind: Column) -> Column:
    return F.coalesce(kind.isin(*RETRIABLE), F.lit(False))


def without_quotes(raw: Column) -> Column:
    """Quote marks of lines and one pair of quotation marks around the whole go."""
    t = T.trimmed(F.coalesce(raw, F.lit("")))
    t = F.when(F.startswith(t, F.lit(">")), T.trimmed(F.regexp_replace(t, r"(?m)^>\s*", ""))).otherwise(t)
    return F.when(t.rlike(r'(?s)^(?:“.*”|".*")$') & (F.length(t) > 1), T.trimmed(F.regexp_replace(t, r'(?s)^.(.*).$', "$1"))).otherwise(t)


def model_chain(configured: Column, extra: Column, known: list[str]) -> Column:
    """Models to try in turn, each once, blank ones left out."""
    every = F.concat(F.array(configured), F.coalesce(extra, F.array().cast("array<string>")), F.array(*map(F.lit, known)))
    return F.array_distinct(F.filter(F.transform(every, lambda m: F.trim(m)), lambda m: F.coalesce(m, F.lit("")) != ""))


def with_terms(source: Column, output: Column) -> Column:
    """The output, and after it the terms of the source that it lacks."""
    out, missing = F.coalesce(output, F.lit("")), T.missing_terms(source, output)
    return F.when(F.size(missing) > 0, F.concat(out, F.lit(TERMS_OPEN), F.array_join(missing, TERMS_BETWEEN), F.lit(TERMS_CLOSE))).otherwise(out)


def sentences_with_terms(sources: Column, outputs: Column) -> Column:
    """Each output sentence with the terms that its source (the last one, where there are fewer) has and it lacks."""
    source = lambda i: F.coalesce(F.get(sources, F.least(i, F.size(sources) - 1)), F.lit(""))

    def one(x: Column, i: Column) -> Column:
        missing = T.missing_terms(source(i), x)
        return F.when(F.size(missing) > 0, F.concat(F.regexp_replace(x, f"[{T.BLANK}]+$", ""), F.lit("（"), F.array_join(missing, TERMS_BETWEEN), F.lit("）"))).otherwise(x)

    return F.when((F.size(outputs) > 0) & (F.size(sources) > 0), F.transform(outputs, one)).otherwise(outputs)


def chinese_sentences(text: Column) -> Column:
    """Trimmed pieces that end at a Chinese or Latin full stop mark of a sentence."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^。！？!?]+[。！？!?]?"), F.lit(0)), T.trimmed), lambda s: s != "")


def aligned(translation: Column, n: Column) -> Column:
    """The sentences of a translation where there are as many as asked for, at least two, all usable; else null."""
    parts = chinese_sentences(translation)
    return F.when((n >= 2) & (F.size(parts) == n) & F.forall(parts, usable), parts)


def json_reply(raw: Column) -> Column:
    """A reply's JSON as a variant: without a fence around it, else what its outermost braces hold; null for none."""
    fenced = r"(?si)```(?:json)?\s*(.*?)```"
    body = bound(lambda c: F.when(F.contains(c["t"], F.lit("```")) & c["t"].rlike(fenced), T.trimmed(F.regexp_extract(c["t"], fenced, 1))).otherwise(c["t"]), t=T.trimmed(F.coalesce(raw, F.lit(""))))
    return bound(lambda c: F.coalesce(F.try_parse_json(c["b"]), F.try_parse_json(F.regexp_substr(c["b"], F.lit(r"(?s)\{.*\}")))), b=body)


def bound(make: Callable[[Column], Column], **parts: Column) -> Column:
    """make of a struct of parts, each of which is computed once however often make names it."""
    return F.get(F.transform(F.array(F.struct(*(c.alias(n) for n, c in parts.items()))), make), F.lit(0))


def sentence_reply(raw: Column, n: Column) -> Column:
    """struct(reason, translation, sentences) of a reply that should hold n sentences; reason "" where it does."""

    def listed(c: Column) -> Column:
        is_list = F.startswith(c["kind"], F.lit("ARRAY"))
        items = F.when(is_list, F.try_variant_get(c["v"], "$", "array<string>")).otherwise(F.try_variant_get(c["v"], "$.sentences", "array<string>"))
        sentences = F.transform(items, lambda s: T.trimmed(F.coalesce(s, F.lit(""))))
        whole = F.when(is_list, F.lit("")).otherwise(T.trimmed(F.coalesce(F.try_variant_get(c["v"], "$.translation", "string"), F.lit(""))))
        shape = F.when(c["blank"], "empty").when(c["v"].isNull(), "not json").when(~is_list & ~F.startswith(c["kind"], F.lit("OBJECT")), "not an object").otherwise("")
        return bound(judged, shape=shape, sentences=sentences, whole=whole, n=c["n"])

    def judged(c: Column) -> Column:
        s = c["sentences"]
        reason = F.when(c["shape"] != "", c["shape"]).when(s.isNull(), "no sentences").when(F.size(s) != c["n"], "another number of sentences").when(~F.forall(s, usable), "a blank or failed sentence").otherwise("")
        return bound(told, reason=reason, sentences=s, whole=c["whole"])

    def told(c: Column) -> Column:
        good = c["reason"] == ""
        return F.struct(c["reason"].alias("reason"), F.when(good, F.when(c["whole"] != "", c["whole"]).otherwise(F.array_join(c["sentences"], " "))).alias("translation"), F.when(good, c["sentences"]).alias("sentences"))

    return bound(lambda c: bound(listed, v=c["v"], kind=F.schema_of_variant(c["v"]), blank=c["blank"], n=c["n"]), v=json_reply(raw), blank=T.trimmed(F.coalesce(raw, F.lit(""))) == "", n=n)


def delta(line: Column) -> Column:
    """struct(piece, finish, error) of one line of an event stream; nulls for lines that hold none and for broken ones."""
    data = T.trimmed(F.regexp_extract(T.trimmed(F.coalesce(line, F.lit(""))), r"^data:(.*)$", 1))
    v = F.try_parse_json(F.when((data != "") & (data != "[DONE]"), data))
    get = lambda path: F.try_variant_get(v, path, "string")
    piece = F.coalesce(get("$.choices[0].delta.content"), get("$.choices[0].message.content"))
    return F.struct(F.when(piece != "", piece).alias("piece"), get("$.choices[0].finish_reason").alias("finish"), get("$.error.message").alias("error"))
