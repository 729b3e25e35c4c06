"""Document fingerprints by a homomorphic multiset hash, with DataFrame functions only.

A text is a multiset of paragraphs (lines). Each paragraph has a wide vector: four lanes of 32
bits from two 64-bit hashes of the whole paragraph, a count, and 64 lanes that count, for each bit, the word
trigrams of the paragraph whose hash has it set. A fingerprint is the sum of its paragraphs'
vectors, the first lanes modulo 2**32, the others modulo 2**16. So it doesn't depend on the
order of paragraphs, and `combine` adds or takes away paragraphs without the rest of the text.
The first lanes decide equality. The others estimate likeness: read as sums of +1 and -1,
2 * A.B / (A.A + B.B) is expected to be that of the multisets of trigrams (the last two of a paragraph are shorter).

Neighbours by descending doc_id come from one shuffle of the texts into ranges of ids: the first
row of each range is also put, as a copy, at the end of the range before it, so no
task sees more than a range. An id that many rows share has several ranges, by a hash of the text, and so have null ids. Counts are summed within that partitioning, without a further shuffle.

Defined results: null counts as the empty text, which has no paragraphs; blank paragraphs count for nothing; likeness of two texts
without paragraphs is 1, of one without and one with 0; a single document is its own next one; doc_id null
comes last; rows repeated with one doc_id follow each other; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.words import parts_of

#: Bits i and i + 32 of a hash are counted in one long.
PAIR = 0x0000000100000001
LANES = [f"b{i}" for i in range(32)]
EXACT = ["e0", "e1", "e2", "e3"]
SUMS = [*EXACT, "k", *LANES]
LOW = 0xFFFFFFFF


def ranged(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most value, by halving."""

    def halved(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(value >= F.lit(cuts[m]), halved(m + 1, b)).otherwise(halved(a, m))

    return halved(0, len(cuts))


#: Bits of the hash of a text by which rows of one id are dealt over several ranges.
TIES = 20


def laid_out(cuts: list[int]) -> tuple[list[int], list[int], list[int], int]:
    """Cuts of ids, and for each part between them its first range and its number of ranges, in reading order (descending ids); then the first range of nulls.

    cuts: as many quantiles of the ids as there are tasks, less one. A value that is several of them is a part of its own, with as many ranges.
    """
    times = Counter(cuts)
    edges = sorted({e for c, k in times.items() for e in ((c, c + 1) if k > 1 else (c,))})
    parts = [1, *(max(1, times[e]) for e in edges)]
    bases, n = [], 0
    for k in reversed(parts):
        bases.append(n)
        n += k
    return edges, bases[::-1], parts, n


def beside(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_range, _pos (place in it), _id, _text, _next (text of the next document by descending id), _copy.

    Rows are partitioned by _range. The rows with _copy repeat the first one of the following range. Rows without an id, or with one that many
    share, are spread over ranges by a hash of their texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    n = parts_of(spark)
    quantiles, nulls = rows.select(F.percentile_approx("_id", [i / n for i in range(1, n)] or [0.5], 100 * n), F.count_if(F.col("_id").isNull())).first()
    edges, bases, parts, last = laid_out(quantiles or [])
    tie = F.xxhash64("_text")
    piece = lambda k: F.shiftright((F.shiftright(tie, 64 - TIES) + (1 << TIES - 1)) * k, TIES).cast("int")  # noqa: E731  in the order of the hash
    part = ranged(F.col("_id"), edges)
    known = F.get(F.array(*map(F.lit, bases)), part) + (piece(F.get(F.array(*(F.lit(p).cast("long") for p in parts)), part)) if max(parts) > 1 else F.lit(0))
    here = F.when(F.col("_id").isNull(), F.lit(last) + piece(F.lit(n).cast("long"))).otherwise(known) if nulls else known
    placed = rows.withColumn("_range", here)
    # the first row of each range; as many as ranges, so they may be broadcast
    first = F.min(F.struct((-F.col("_id")).alias("d"), tie.alias("t"))).alias("f")
    tops = placed.groupBy("_range").agg(first, F.max("_id").alias("_top")).orderBy("_range").collect()
    firsts = [(r["_top"], r["f"]["t"], r["_range"], tops[i - 1]["_range"]) for i, r in enumerate(tops)]  # after the last the first
    table = F.broadcast(spark.createDataFrame(firsts, "_top long, _tie long, _of int, _to int"))
    same = placed.join(table, (F.col("_range") == F.col("_of")) & F.col("_id").eqNullSafe(F.col("_top")) & (tie == F.col("_tie")))
    copies = same.groupBy("_of", "_to", "_id").agg(F.any_value("_text").alias("_text")).select("_id", "_text", F.col("_to").alias("_range"), F.lit(True).alias("_copy"))
    both = placed.withColumn("_copy", F.lit(False)).unionByName(copies)
    order = Window.partitionBy("_range").orderBy("_copy", F.desc_nulls_last("_id"), tie)
    return both.withColumn("_pos", F.row_number().over(order)).withColumn("_next", F.lead("_text").over(order))


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by the first as many of following."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def vectors(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys and the summed lanes of each text; one row for each of keys, all texts that share them being added."""
    pars = texts.select(*keys, F.explode_outer(F.filter(F.split(text_col, "\n"), lambda p: F.trim(p) != "")).alias("_par"))
    words = pars.select(*keys, "_par", F.split("_par", " ").alias("_w"))
    pairs = F.zip_with("_w", F.slice("_w", F.lit(2), F.greatest(F.size("_w"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    two = words.select(*keys, F.xxhash64("_par").alias("_h"), F.xxhash64(F.lit(1), "_par").alias("_g"), F.col("_par").isNotNull().alias("_is"), "_w", pairs.alias("_p"))
    threes = F.zip_with("_p", F.slice("_w", F.lit(3), F.greatest(F.size("_w"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    units = two.select(*keys, "_h", "_g", "_is", F.posexplode_outer(threes).alias("_at", "_u"))
    head = F.col("_is") & (F.col("_at") == 0)
    once = lambda c: F.sum(F.when(head, c).otherwise(F.lit(0).cast("long")))
    sums = [
        once(F.col("_h").bitwiseAND(LOW)).alias("e0"),
        once(F.shiftrightunsigned("_h", 32)).alias("e1"),
        once(F.col("_g").bitwiseAND(LOW)).alias("e2"),
        once(F.shiftrightunsigned("_g", 32)).alias("e3"),
        F.count("_u").alias("k"),
        *(F.coalesce(F.sum(F.shiftright("_u", i).bitwiseAND(PAIR)), F.lit(0)).alias(c) for i, c in enumerate(LANES)),
    ]
    return units.groupBy(*keys).agg(*sums)


def combine(a: DataFrame, b: DataFrame, keys: list[str], sign: int = 1) -> DataFrame:
    """Vectors of a with those of b added (sign 1) or taken away (-1), by keys."""
    both = a.unionByName(b.select(*keys, *(F.when(F.lit(sign > 0), F.col(c)).otherwise(-F.col(c)).alias(c) for c in SUMS)))
    return both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in SUMS))


def fingerprint() -> Column:
    """The lanes in hexadecimal, from the columns that `vectors` returns."""
    whole = lambda c, bits: F.lpad(F.hex(c.bitwiseAND((1 << bits) - 1)), bits // 4, "0")
    lanes = [x for c in LANES for x in (F.col(c).bitwiseAND(LOW), F.shiftright(c, 32))]
    return F.lower(F.concat(*(whole(F.col(c), 32) for c in [*EXACT, "k"]), *(whole(x, 16) for x in lanes)))


def signs() -> Column:
    """The lanes as sums of +1 and -1."""
    return F.array(*(x for c in LANES for x in (2 * F.col(c).bitwiseAND(LOW) - F.col("k"), 2 * F.shiftright(c, 32) - F.col("k"))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two arrays that `signs` returns."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    size = dot(a, a) + dot(b, b)
    return F.when(size == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * dot(a, b) / size)))


def digest(docs: DataFrame) -> DataFrame:
    rows = beside(docs)
    new = edited(F.col("_text"), F.coalesce("_next", "_text"))
    keys = ["_range", "_pos", "_which", "_id", "_copy", "_chars", "_sha"]
    made = rows.select("_range", "_pos", "_id", "_copy", "_text", F.when(~F.col("_copy"), new).alias("_edited"))
    both = made.select("_range", "_pos", "_id", "_copy", F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col("_text").alias("t"), F.length("_text").alias("n"), F.lit("").alias("s")), F.struct(F.lit(1).alias("w"), F.col("_edited").alias("t"), F.lit(0).alias("n"), F.sha2("_edited", 256).alias("s")))).alias("_x"))
    texts = both.filter("not _copy or _x.w = 0").select("_range", "_pos", "_id", "_copy", F.col("_x.w").alias("_which"), F.col("_x.n").alias("_chars"), F.col("_x.s").alias("_sha"), F.col("_x.t").alias("_t"))
    sums = vectors(texts, keys, "_t").select(*keys, fingerprint().alias("_fp"), signs().alias("_v"))
    order = Window.partitionBy("_range").orderBy("_pos", "_which")
    seen = sums.select("*", F.lead("_fp", 1).over(order).alias("_fp1"), F.lead("_v", 1).over(order).alias("_v1"), F.lead("_v", 2).over(order).alias("_v2"), F.lead("_sha", 1).over(order).alias("_sha1"))
    return seen.filter("_which = 0 and not _copy").select(
        F.col("_id").alias("doc_id"), F.col("_chars").cast("long").alias("n_chars"), F.col("_sha1").alias("edited_sha256"), F.col("_fp").alias("fingerprint"), F.col("_fp1").alias("edited_fingerprint"),
        likeness(F.col("_v"), F.col("_v1")).alias("near_edited"), likeness(F.col("_v"), F.col("_v2")).alias("near_next"),
    )
