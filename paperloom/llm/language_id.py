"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are added as log odds over the known languages and "und" (none of them):
1. text: hashed character trigrams of the whole text under multinomials with a smoothed background; the
   mean over the text counts as TRUST trigrams at most, as neighbouring trigrams aren't independent.
   "und" is the same model over trigrams spread evenly over half of the cells; texts of letters without a trigram are no evidence. It has odds of 1 to RARELY from the start. The languages are those of
   all labelled rows; each is fitted on SAMPLE of its rows (those of least hash) or on all that it has, a documented bound; scored on every text. Beyond the MOST commonest labels
   all labels are one language more, OTHER, so that a dirty column can't make the model grow.
   A model of under THIN trigrams can't tell that a text isn't in its language: where a text of letters declares such a language, "und" gives way to it.
2. the language that the markup or record declares, believed with odds DECLARED;
3. the address: a path part or country suffix that names a language, with odds ADDRESS;
4. a prior for the host, smoothed towards its domain, that towards its suffix, that towards
   all: p(l | host) = (n(l, host) + K * p(l | domain)) / (n(host) + K), and so on. The counts are sums
   over all rows of the posteriors by 1 to 3, by grouped aggregation (map-side combined, so a
   host with a third of all rows is one counter for each task).

A row is rejected when "und" is its best language; where no row is labelled, none is. The model takes CELLS numbers for each language, on the driver and in a broadcast.

Defined results: null and empty texts, and texts without any letter, are "und"; a null or unknown declaration, address or host is no evidence
(hosts that are null share one prior); ties go to the language first in order; repeated rows are scored alike, each counts
in the priors; an empty table gives no rows; extra columns are ignored, `accepted` carries them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.names import fresh
from paperloom.llm.words import LOWER, narrow, widen
from paperloom.session import written

SAMPLE, TRUST, DECLARED, ADDRESS, K, RARELY = 4000, 60.0, 30.0, 6.0, 20.0, 100.0
CELLS = 1 << 16
#: Bytes of text that are worked on at once: a task holds some fifty times as many.
SLICE = 1 << 20
#: Trigrams of a language's sample under which its model is thin; ranges of hashes that are counted to find a sample's end.
THIN, RANGES = 20_000, 1 << 12
NONE = "und"
#: Languages with a model of their own at most, and what all others count as.
MOST, OTHER = 128, "other"


def _cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of the trigram at each byte (spaces and digits as one letter each), and the text of each; trigrams lie within one text."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = FOLD[data].astype(np.uint32)
    h = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
    ok = (row[:-2] == row[2:]) & ~((b[:-2] == 32) & (b[1:-1] == 32))
    return (h[ok] >> np.uint32(16)).astype(np.int64), row[:-2][ok]


FOLD = LOWER.copy()
#: What isn't a letter is a space: only ASCII letters and bytes of other scripts tell languages apart.
FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def _texts(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of some MB of texts, their bytes and the places where each text begins and ends in them; the bytes are the batch's own."""
    for batch in batches:
        size = np.asarray(pc.binary_length(batch[text_col]).fill_null(0)).astype(np.int64)
        part = np.cumsum(size) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                some = batch.slice(a, b - a)
                texts = some[text_col].fill_null("")
                kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
                offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
                raw = texts.buffers()[2]
                data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
                yield some, data, offsets - offsets[0]


def sampled(labelled: DataFrame, label_col: str) -> tuple[list[str], DataFrame]:
    """Languages of all labelled rows, and of each language its SAMPLE rows of least hash, or all.

    Counts by language and range of hashes tell the range that has the last of them, so only rows up to that range are sorted.
    """
    key, at, last, rank = fresh(labelled, "_key", "_at", "_last", "_rank")
    known = labelled.filter(F.col(label_col) != NONE).withColumn(key, F.pmod(F.xxhash64(*labelled.columns), F.lit(1 << 62)))
    known = known.withColumn(at, F.shiftright(key, 50).cast("int"))  # RANGES of them
    counts = known.groupBy(label_col, at).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(label_col).orderBy(at)) - F.col("n")
    ends = counts.withColumn("before", before).filter(F.col("before") < SAMPLE).groupBy(label_col).agg(F.max(at).alias(last)).collect()  # a row for each language
    if not ends:
        return [], labelled.limit(0)
    ends_by = F.broadcast(labelled.sparkSession.createDataFrame([tuple(r) for r in ends], f"`{label_col}` string, {last} int"))
    some = known.join(ends_by, label_col).filter(F.col(at) <= F.col(last))
    first = some.withColumn(rank, F.row_number().over(Window.partitionBy(label_col).orderBy(key))).filter(F.col(rank) <= SAMPLE)
    return sorted(r[0] for r in ends), first.select(*labelled.columns)


def fitted(labelled: DataFrame, text_col: str, label_col: str) -> tuple[list[str], np.ndarray, list[str]]:
    """Languages of all labelled rows, log likelihoods (cells x languages and "und"), and the languages whose models are thin."""
    names, sample = sampled(labelled, label_col)
    if not names:
        return [], np.zeros((CELLS, 1)), []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for some, data, offsets in _texts(batches, text_col):
            cell, row = _cells(data, offsets)
            label = np.array(some[label_col].to_pylist(), object)[row]
            for x in set(label.tolist()):
                total[x] = total.get(x, 0) + np.bincount(cell[label == x], minlength=CELLS)
        for x, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([zlib.compress(narrow(n), 1)])], names=["label", "counts"])

    got: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(count, "label string, counts binary").collect():  # a row for each language and task of the sample
        got[r["label"]] = got.get(r["label"], 0) + widen(zlib.decompress(r["counts"]))
    none = np.zeros(CELLS, np.int64)  # of a language whose texts have no trigram
    n = np.stack([got.get(x, none) for x in names], 1).astype(float)
    back = (n.sum(1, keepdims=True) + 0.05) / (n.sum() + 0.05 * CELLS)
    # a tenth of evenly spread trigrams, so that few unknown ones don't make a short text "und"
    like = np.log(0.9 * (n + 200 * back) / (n.sum(0) + 200) + 0.2 / CELLS)
    return names, np.concatenate([like, np.full((CELLS, 1), -np.log(CELLS / 2))], 1), [x for x, m in zip(names, n.sum(0), strict=True) if m < THIN]


def scored(rows: DataFrame, names: list[str], like: np.ndarray, thin: list[str], keep: list[str]) -> DataFrame:
    """keep and _text: the log evidence of the whole text for each language and "und"; keep has _declared."""
    table = rows.sparkSession.sparkContext.broadcast(like.astype(np.float32))  # CELLS rows, fixed
    k = len(names) + 1
    place = {x: names.index(x) for x in thin}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, data, offsets in _texts(batches, "_t"):
            cell, row = _cells(data, offsets)
            n = np.bincount(row, minlength=some.num_rows)
            total = np.stack([np.bincount(row, weights=table.value[cell, i], minlength=some.num_rows) for i in range(k)], 1)
            mean = total / np.maximum(n, 1)[:, None]
            out = mean * np.minimum(n, TRUST)[:, None]
            said = np.array([place.get(x, -1) for x in some["_declared"].to_pylist()])
            at = np.flatnonzero(said >= 0)
            out[at, said[at]] = np.maximum(out[at, said[at]], out[at, -1])
            out[at, -1] = out[at, said[at]] - TRUST
            letters = np.concatenate(([0], np.cumsum(FOLD[data] != 32)))
            out[letters[offsets[1:]] == letters[offsets[:-1]]] = [*[-TRUST] * (k - 1), 0.0]  # nothing to tell a language from
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * k, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(some[c] for c in keep), lists], names=[*keep, "_text"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "_t").mapInArrow(run, f"{schema}, _text array<double>")


def identify(rows: DataFrame, names: list[str], like: np.ndarray, thin: list[str], id_cols: list[str]) -> DataFrame:
    """id_cols, _language, _confidence, _posterior.

    rows: id_cols, _t (text), _declared, _address (languages or null), _host, _domain, _suffix.
    """
    every = [*names, NONE]
    seen = written(scored(rows, names, like, thin, [*id_cols, "_declared", "_address", "_host", "_domain", "_suffix"]), "evidence")

    def named(c: str, odds: float) -> Column:
        return F.array(*(F.when(F.col(c) == x, F.lit(float(np.log(odds)))).otherwise(0.0) for x in every))

    def plus(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    def normal(a: Column) -> Column:
        e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
        z = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
        return F.transform(e, lambda x: x / z)

    rare = F.array(*(F.lit(0.0) for _ in names), F.lit(-float(np.log(RARELY))))
    sums = seen.withColumn("_sum", plus(plus(plus(F.col("_text"), rare), named("_declared", DECLARED)), named("_address", ADDRESS)))
    first = sums.withColumn("_p", normal(F.col("_sum")))
    known = {c: F.coalesce(c, F.lit("")) for c in ("_host", "_domain", "_suffix")}
    counted = first.groupBy(*(known[c].alias(c) for c in known)).agg(*(F.sum(F.get("_p", F.lit(i))).alias(f"n{i}") for i in range(len(every))))
    counts = [f"n{i}" for i in range(len(every))]

    def level(keys: list[str]) -> DataFrame:
        return counted.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts))

    def smoothed(own: DataFrame, above: DataFrame | None, keys: list[str], up: list[str]) -> DataFrame:
        total = sum((F.col(c) for c in counts[1:]), F.col(counts[0]))
        if above is None:
            return own.select(*keys, F.array(*((F.col(c) + 1) / (total + len(every)) for c in counts)).alias("_prior"))
        both = own.join(above, up) if up else own.crossJoin(F.broadcast(above))  # above: one row
        return both.select(*keys, F.array(*((F.col(c) + K * F.get("_prior", F.lit(i))) / (total + K) for i, c in enumerate(counts))).alias("_prior"))

    everything = counted.agg(*(F.sum(c).alias(c) for c in counts))
    top = smoothed(everything, None, [], [])
    suffix = smoothed(level(["_suffix"]), top, ["_suffix"], [])
    domain = smoothed(level(["_suffix", "_domain"]), suffix, ["_suffix", "_domain"], ["_suffix"])
    host = smoothed(level(["_suffix", "_domain", "_host"]), domain, ["_suffix", "_domain", "_host"], ["_suffix", "_domain"])
    named_hosts = written(host, "priors").select(F.col("_suffix").alias("_s"), F.col("_domain").alias("_d"), F.col("_host").alias("_h"), "_prior")
    joined = sums.join(named_hosts, (known["_suffix"] == F.col("_s")) & (known["_domain"] == F.col("_d")) & (known["_host"] == F.col("_h")))
    last = joined.withColumn("_posterior", normal(plus(F.col("_sum"), F.transform("_prior", lambda x: F.ln(x)))))
    best = F.array_max("_posterior")
    return last.select(*id_cols, F.element_at(F.array(*map(F.lit, every)), F.array_position("_posterior", best).cast("int")).alias("_language"), best.alias("_confidence"), "_posterior")


def folded(docs: DataFrame, lang_col: str) -> Column:
    """The label, where it is one of the MOST commonest (ties by name) or there are no more; all others are one language, OTHER."""
    names = [r[0] for r in docs.filter(F.col(lang_col) != NONE).groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).select(lang_col).limit(MOST + 1).collect()]
    label = F.col(lang_col)
    return label if len(names) <= MOST else F.when(label.isin(*names[:MOST], NONE) | label.isNull(), label).otherwise(OTHER)


def of_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """_id, _row (a hash of the row's text and source), _language, _confidence, _posterior, _rejected; source is the host."""
    label = folded(docs, lang_col)
    names, like, thin = fitted(docs.select(id_col, text_col, label.alias(lang_col)), text_col, lang_col)
    rows = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(text_col, source_col, lang_col).alias("_row"), F.col(text_col).alias("_t"), label.alias("_declared"), F.lit(None).cast("string").alias("_address"),
        F.col(source_col).alias("_host"), F.regexp_extract(F.coalesce(source_col, F.lit("")), r"^(\D*)", 1).alias("_domain"), F.lit("").alias("_suffix"),
    )
    return identify(rows, names, like, thin, ["_id", "_row"]).withColumn("_rejected", (F.col("_language") == NONE) & F.lit(bool(names)))


def of_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, declared, address, host, language, confidence of web pages; the text model is fitted on docs."""
    names, like, thin = fitted(docs.select("doc_id", "text", folded(docs, "lang").alias("lang")), "text", "lang")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\w+://([^/:?#]+)", 1))
    text = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>|&\w+;", " ")
    rows = pages.select(
        "page_id", text.alias("_t"), F.nullif(F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\blang=[\"']?([a-z]{2})", 1)), F.lit("")).alias("_declared"),
        F.nullif(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\w+://(?:[^/]*\.)?([a-z]{2})(?=/|$)|^\w+://[^/]*/([a-z]{2})(?=/|$)", 2)), F.lit("")).alias("_path"),
        F.nullif(F.regexp_extract(host, r"\.([a-z]{2})$", 1), F.lit("")).alias("_country"), host.alias("_host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("_domain"), F.regexp_extract(host, r"([^.]+)$", 1).alias("_suffix"),
    )
    rows = rows.withColumn("_address", F.coalesce("_path", "_country"))
    found = identify(rows, names, like, thin, ["page_id"])
    return found.select("page_id", F.col("_language").alias("language"), F.round("_confidence", 6).alias("confidence"))


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs without those that are in no known language, or all where none is known; columns as they came."""
    i, row = fresh(docs, "_i", "_r")
    gone = of_documents(docs, id_col, text_col, lang_col, source_col).filter("_rejected").select(F.col("_id").alias(i), F.col("_row").alias(row)).distinct()
    own = F.xxhash64(docs[text_col], docs[source_col], docs[lang_col])
    return docs.join(gone, docs[id_col].eqNullSafe(gone[i]) & (own == gone[row]), "left_anti")


def digest(docs: DataFrame) -> DataFrame:
    found = of_documents(docs)
    return found.select(F.col("_id").alias("doc_id"), F.col("_language").alias("language"), F.round("_confidence", 6).alias("confidence"), (~F.col("_rejected")).alias("kept"))
