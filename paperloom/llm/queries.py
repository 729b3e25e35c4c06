"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, centroids, exact_dedup, fingerprints, jaccard_join, language_id, mixing, sharding, stream_mixing, substring_dedup, token_files, tree_bpe, turn_repair


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_documents(spark, sf_dir))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_mixing.score(_documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(_documents(spark, sf_dir))
    return groups.select(F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(_documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(_documents(spark, sf_dir))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(_documents(spark, sf_dir))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where all four kinds of evidence are at hand."""
    return language_id.of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), _documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(_documents(spark, sf_dir))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.digest(_documents(spark, sf_dir))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.digest(_documents(spark, sf_dir))


OP4_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""

OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM r, range(20) t(j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP10_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

EDITS_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS after, first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS top FROM documents),
h AS (SELECT doc_id, t, length(t) // 2 AS k, coalesce(after, top) AS after FROM t)
SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - k) || left(after, k)) AS edited_sha256 FROM h
"""

SIZES_SQL = "SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size FROM documents"



def _by(state: str, cost: str, letters: str) -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letters}'}} END"


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


#: A conversation is one row with its least cost and audit in each state: 0 nothing yet, 1 after s, 2 after u, 3 after a; i: after inserted turns, s: after an edit.
_KEPT, _NEW = "CASE WHEN NOT must AND r = '{}' THEN {} END", "CASE WHEN NOT must THEN {} END"
_INSERTED = f"s0 AS i0, s1 AS i1, {_least('s2', *(_by(f's{k}', '3', 'I') for k in (0, 1, 3)))} AS i2, {_least('s3', _by('s2', '3', 'I'), _by('s0', '6', 'II'), _by('s1', '6', 'II'))} AS i3"
_USER = [f for k in (0, 1, 3) for f in (_KEPT.format("u", _by(f"i{k}", "late", "K")), _NEW.format(_by(f"i{k}", "late + 3", "R")))]
_EDITED = [
    _by("i0", "4", "D"),
    _least(_by("i1", "4", "D"), _KEPT.format("s", _by("i0", "late", "K"))),
    _least(_by("i2", "4", "D"), *_USER),
    _least(_by("i3", "4", "D"), _KEPT.format("a", _by("i2", "late", "K")), _NEW.format(_by("i2", "late + 3", "R"))),
]
_STATE = "STRUCT(c BIGINT, a VARCHAR)"
OP11_SQL = f"""
WITH RECURSIVE k AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(key, '')]), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS d
  FROM k),
hurt AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM crc, unnest([0, 1]) t(copy) WHERE d <> 0 AND (copy = 0 OR d = 3)),
told AS (
  SELECT *, row_number() OVER o AS n, regexp_full_match(text, '[\x20\x09-\x0D]*') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\\z') AS short, left(role, 1) AS r, lag(left(role, 1)) OVER o AS before
  FROM hurt WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
rows_ AS MATERIALIZED (SELECT conv_id, n, role, text, r, before, turn, blank, again AND NOT blank AS dup, short AND NOT blank AND NOT again AS trunc, blank OR again AS must, CASE WHEN short THEN 3 ELSE 0 END AS late FROM told),
dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, {{'c': 0, 'a': ''}}::{_STATE} AS s0, NULL::{_STATE} AS s1, NULL::{_STATE} AS s2, NULL::{_STATE} AS s3 FROM conversations
  UNION ALL
  SELECT conv_id, n, {", ".join(_EDITED)}
  FROM (SELECT t.*, {_INSERTED}, x.r, x.must, x.late FROM (SELECT conv_id, n + 1 AS n, s0, s1, s2, s3 FROM dp) t JOIN rows_ x ON x.conv_id IS NOT DISTINCT FROM t.conv_id AND x.n = t.n)),
best AS MATERIALIZED (
  SELECT conv_id, {_least("s0", "s3", _by("s2", "3", "I"), _by("s1", "6", "II"))} AS b FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
said AS (
  SELECT conv_id, 0 AS p, 0::BIGINT AS n, '0' AS state, NULL::VARCHAR AS out FROM best
  UNION ALL
  SELECT conv_id, p, n, CASE WHEN l = 'D' THEN state ELSE left(role, 1) END, CASE WHEN l = 'D' THEN out ELSE coalesce(out || chr(10), '') || role || ':' || text END
  FROM (SELECT s.conv_id, s.p, s.n, s.state, s.out, s.l, CASE WHEN l = 'I' THEN '' ELSE x.text END AS text, CASE WHEN l = 'K' THEN x.role WHEN state = 'u' THEN 'assistant' ELSE 'user' END AS role
        FROM (SELECT s.conv_id, p + 1 AS p, n + (b.a[p + 1] <> 'I')::INT AS n, state, out, b.a[p + 1] AS l FROM said s JOIN best ON best.conv_id IS NOT DISTINCT FROM s.conv_id WHERE p < length(b.a)) s
        LEFT JOIN rows_ x ON x.conv_id IS NOT DISTINCT FROM s.conv_id AND x.n = s.n)),
spoken AS (SELECT conv_id, arg_max(struct_pack(o := out), p).o AS out FROM said GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate, count_if(trunc) AS truncated, count_if(before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       b.c AS cost, b.a AS audit, sha256(coalesce(out, '')) AS repaired_sha256
FROM best JOIN spoken ON spoken.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM best.conv_id
"""

#: One round: distances over pairs of vector and centroid, the nearest, then means of those that have vectors.
_NEAREST = "a{r} AS MATERIALIZED (SELECT i, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT i, k, sum((e.v - c.v) * (e.v - c.v)) AS d FROM e JOIN c{r} c USING (j) GROUP BY i, k) GROUP BY i)"
_MOVED = "c{s} AS MATERIALIZED (SELECT c.k, c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT k, j, floor(sum(v) / count(*))::BIGINT AS v FROM a{r} JOIN e USING (i) GROUP BY k, j) m USING (k, j))"
OP12_SQL = f"""
WITH x AS (SELECT vec_id, [floor(256 * y::DOUBLE)::BIGINT for y in embedding] AS q FROM embeddings WHERE len(embedding) = 64 AND len([y for y in embedding if isfinite(y)]) = 64),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS i FROM x),
e AS MATERIALIZED (SELECT i, unnest(q) AS v, unnest(range(64)) AS j FROM n),
c0 AS MATERIALIZED (SELECT i AS k, j, v FROM e WHERE i < 40),
{", ".join(f"{_NEAREST.format(r=r)}, {_MOVED.format(r=r, s=r + 1)}" for r in range(5))},
{_NEAREST.format(r=5)},
h AS (SELECT k, sha256(string_agg(v::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c5 GROUP BY k)
SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256, count(*) OVER (PARTITION BY q) AS copies
FROM n JOIN a5 USING (i) JOIN h USING (k)
"""


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can say."""
    return op6_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can say."""
    return op9_sharding(spark, sf_dir).select("doc_id", "size")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_token_files": op5_token_files,
    "op6_fingerprints": op6_fingerprints,
    "op7_source_mixing": op7_source_mixing,
    "op8_language_id": op8_language_id,
    "op9_sharding": op9_sharding,
    "page_languages": page_languages,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_turn_repair": op11_turn_repair,
    "op12_centroids": op12_centroids,
    "op13_tree_bpe": op13_tree_bpe,
    "fingerprint_edits": fingerprint_edits,
    "shard_sizes": shard_sizes,
}
ORACLES = {"op3_substring_dedup": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op10_jaccard_join": OP10_SQL, "op11_turn_repair": OP11_SQL, "op12_centroids": OP12_SQL, "fingerprint_edits": EDITS_SQL, "shard_sizes": SIZES_SQL}
