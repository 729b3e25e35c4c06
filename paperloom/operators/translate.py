"""Translation requests end to end: gate, cache, one call for each distinct text, verdict and terms. The model call is a function that is handed in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import requests as R
from paperloom.functions import text as T

#: How many characters of its source the stub's output begins with.
HEAD = 12


def stub(text: Column) -> Column:
    """A stand-in for a model: an output that depends on nothing but the text; every fifth length fails."""
    return F.when(F.length(text) % 5 == 0, F.lit(R.FAILED[1] + "]")).otherwise(F.concat(F.lit("译文："), F.left(text, F.lit(HEAD)), F.lit("，其余从略，"), F.repeat(F.lit("文字"), F.lit(60)), F.lit("。")))


def translated(requests: DataFrame, cache: DataFrame, language: str, model: str, call: Callable[[Column], Column] = stub) -> DataFrame:
    """requests (id, text) with key, output, source ("as-is", "cache", "call"), verdict.

    Texts without language stay as they are; those in the cache (key, output[, text]) aren't asked for; each other distinct text is asked for once.
    A key has 32 bits and a length, so among millions of texts some share one: texts are told apart as texts, and a cache that holds its entries' texts answers for those alone.
    call is an expression, or a pandas UDF that calls a service; it sees rows of distinct texts only. Outputs that can't be used have the verdict "failed"; the others get missing terms appended.
    """
    bare = T.untranslatable(F.col("text"))
    rows = requests.withColumn("key", R.content_key(F.coalesce("text", F.lit("")), F.lit(language), F.lit(model))).withColumn("_bare", bare)
    by = "text" if "text" in cache.columns else "key"
    known = cache.groupBy(by).agg(F.max("output").alias("_known"))
    asked = rows.filter(~F.col("_bare")).select(*{"text", by}).distinct().join(known, by, "left")
    answered = asked.select("text", "_known", F.when(F.col("_known").isNull(), call(F.col("text"))).alias("_called"))
    out = rows.join(answered, "text", "left")
    text = F.coalesce("text", F.lit(""))
    raw = F.when(F.col("_bare"), text).otherwise(R.without_quotes(F.coalesce("_known", "_called")))
    source = F.when(F.col("_bare"), "as-is").when(F.col("_known").isNotNull(), "cache").otherwise("call")
    found = out.select("id", "text", "key", raw.alias("_raw"), source.alias("source"))
    verdict = F.when(F.col("source") == "as-is", "ok").when(~R.usable(F.col("_raw")), "failed").otherwise(T.sanity(text, F.col("_raw"), language))
    output = F.when(F.col("source") == "as-is", F.col("_raw")).otherwise(R.with_terms(text, F.col("_raw")))
    return found.select("id", "text", "key", "source", verdict.alias("verdict"), output.alias("output"))


def new_entries(translations: DataFrame) -> DataFrame:
    """key, output: what goes to the cache, one for each text that was asked for and came out well."""
    return translations.filter((F.col("source") == "call") & (F.col("verdict") == "ok")).groupBy("key").agg(F.min("output").alias("output"))
