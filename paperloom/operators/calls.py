"""Model calls in rounds: a table of requests with what each has been through; every round asks for those that aren't settled, and settles or changes them.

A request of several sentences is asked for as JSON with one translation for each sentence, twice at most; then for its whole text, whose sentences are used if
there are as many. A service that rejects JSON mode is asked without it from then on; one that spent its budget without a word gets twice as much, once, up to MOST. Any other error
settles the request. So each request moves on in every round and there are ROUNDS at most. A round is one written table: a lost executor repeats nothing but its own calls of that round.

Defined results: null texts are empty, and empty ones settle as "empty" without a call; requests without sentences or with one go for their whole text at once; repeated rows are requests of their own; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import requests as R
from paperloom.functions import text as T
from paperloom.session import written

ATTEMPTS, BUDGET, MOST, ROUNDS = 2, 8192, 16000, 8
REPLY = "struct<raw: string, finish: string, error: string>"
STATE = ("step", "attempt", "json", "budget", "note", "calls")


def asked(requests: DataFrame) -> DataFrame:
    """requests (text, sentences array<string>, ...) at their beginning: step "sentences" or "whole", attempt, json (mode), budget, note (what was wrong), calls so far."""
    text = F.coalesce("text", F.lit(""))
    several = F.coalesce(F.size("sentences"), F.lit(0)) > 1
    return requests.withColumns({"text": text, "sentences": F.coalesce("sentences", F.array().cast("array<string>"))}).withColumns(
        {"step": F.when(several, "sentences").otherwise("whole"), "attempt": F.lit(0), "json": several, "budget": F.lit(BUDGET), "note": F.lit(""), "calls": F.lit(0)}
    )


def moved(replied: DataFrame, language: str) -> DataFrame:
    """The requests after a round, with done, mode, translation and parts (sentences of the translation). replied: with _reply, a struct REPLY."""
    raw, error = T.trimmed(F.coalesce("_reply.raw", F.lit(""))), F.coalesce("_reply.error", F.lit(""))
    n = F.size("sentences")
    got = R.sentence_reply(F.col("_reply.raw"), n)
    rows = replied.withColumn("_got", F.when((F.col("step") == "sentences") & (error == ""), got))
    joined = F.array_join("_got.sentences", " ")
    verdicts = F.filter(F.array(T.sanity(F.col("text"), F.col("_got.translation"), language), T.sanity(F.col("text"), joined, language)), lambda v: v != "ok")
    wrong = F.when(F.col("_got.reason") != "", F.col("_got.reason")).otherwise(F.coalesce(F.get(verdicts, F.lit(0)), F.lit("")))
    whole = R.without_quotes(F.col("_reply.raw"))
    rows = rows.withColumn("_wrong", wrong).withColumn("_whole", whole).withColumn("_parts", R.aligned(whole, n))
    kind = (
        F.when((error == "invalid-request") & F.col("json"), "drop")
        .when(error != "", "fail")
        .when((raw == "") & (F.col("_reply.finish") == "length") & (F.col("budget") < MOST), "double")
        .when((F.col("step") == "sentences") & (F.col("_wrong") == ""), "sentences")
        .when(F.col("step") == "sentences", "again")
        .when(raw == "", "empty")
        .otherwise("whole")
    )
    rows = rows.withColumn("_kind", kind).withColumn("calls", F.col("calls") + 1)
    last = F.col("attempt") + 1 >= ATTEMPTS
    is_ = lambda *kinds: F.col("_kind").isin(*kinds)
    alone = F.when(n == 1, F.array("_whole"))
    after = rows.withColumns(
        {
            "done": is_("fail", "sentences", "empty", "whole"),
            "mode": F.when(is_("fail"), "failed").when(is_("empty"), "empty").when(is_("sentences"), "sentence-json").when(is_("whole") & (n == 1), "sentence-json").when(is_("whole") & F.col("_parts").isNotNull(), "paragraph-split").when(is_("whole"), "unaligned"),
            "translation": F.when(is_("sentences"), F.col("_got.translation")).when(is_("whole"), F.col("_whole")),
            "parts": F.when(is_("sentences"), F.col("_got.sentences")).when(is_("whole"), F.coalesce(alone, "_parts")),
            "note": F.when(is_("fail"), error).when(is_("again"), F.col("_wrong")).when(is_("drop"), "no JSON mode").when(is_("double"), "budget spent").otherwise(F.col("note")),
            "json": F.col("json") & ~is_("drop") & ~(is_("again") & last),
            "budget": F.when(is_("double"), F.least(F.col("budget") * 2, F.lit(MOST))).otherwise(F.col("budget")),
            "step": F.when(is_("again") & last, "whole").otherwise(F.col("step")),
            "attempt": F.when(is_("again"), F.col("attempt") + 1).otherwise(F.col("attempt")),
        }
    )
    return after.drop("_reply", "_got", "_wrong", "_whole", "_parts", "_kind")


def in_rounds(requests: DataFrame, call: Callable[[Column], Column], language: str = "zh-CN") -> DataFrame:
    """requests (text, sentences, ...) with mode, translation, parts, and attempt, json, budget, note, calls as they were at the end.

    call takes a struct (text, sentences and STATE) and gives a struct REPLY: an expression, or a pandas UDF that asks a service. It sees open requests only.
    """
    start = asked(requests)
    out = {"done": F.lit(True), "mode": F.lit("empty"), "translation": F.lit(None).cast("string"), "parts": F.lit(None).cast("array<string>")}
    blank = T.trimmed(F.col("text")) == ""
    settled = [start.filter(blank).withColumns(out)]
    pending = start.filter(~blank)
    for _ in range(ROUNDS):
        reply = call(F.struct("text", "sentences", *STATE)).cast(REPLY)
        after = moved(written(pending.withColumn("_reply", reply), "replies"), language)
        settled.append(after.filter("done"))
        pending = after.filter("not done").drop("done", "mode", "translation", "parts")
        if pending.isEmpty():
            break
    else:
        raise RuntimeError("requests are still open after the last round")
    whole = settled[0]
    for part in settled[1:]:
        whole = whole.unionByName(part)
    return whole.drop("done", "step")


def stub(request: Column) -> Column:
    """A stand-in for a service that knows all its moods: by the text's length it answers well, rejects JSON mode, answers with too few or blank sentences, spends its budget, or refuses."""
    n, mood = F.size(request["sentences"]), F.length(request["text"]) % 8
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("第"), i.cast("string"), F.lit("句译文在此。")))
    said = lambda parts: F.to_json(F.struct(F.lit("整段译文在此处。").alias("translation"), parts.alias("sentences")))
    reply = lambda raw=None, finish="stop", error="": F.struct((F.lit(None).cast("string") if raw is None else raw).alias("raw"), F.lit(finish).alias("finish"), F.lit(error).alias("error"))
    good, few, blank = reply(said(each)), reply(said(F.slice(each, 1, F.greatest(n - 1, F.lit(1))))), reply(said(F.transform(each, lambda s: F.lit(" "))))
    first, in_json = request["attempt"] == 0, request["json"]
    whole = F.when(mood == 4, reply(F.array_join(each, ""))).otherwise(reply(F.lit("整段译文在此处，只有一句。")))
    return (
        F.when(mood == 6, reply(error="auth"))
        .when((mood == 5) & (request["budget"] <= BUDGET), reply(F.lit(""), "length"))
        .when(request["step"] == "whole", whole)
        .when((mood == 1) & in_json, reply(error="invalid-request"))
        .when(((mood == 2) & first) | mood.isin(3, 4), few)
        .when((mood == 7) & first, blank)
        .when((mood == 7) & in_json, reply(error="invalid-request"))
        .otherwise(good)
    )
