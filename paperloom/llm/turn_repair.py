"""Repair of the turn structure of conversations at least cost, with an audit of the edits.

Roles must read (s?(ua)+)? by their initials, a grammar of four states. Equal rows of a turn are one *step* with their number. Then:

1. Steps, without texts, are dealt by range of (conversation, turn, role, hash of the text), so that a conversation of any length spreads over
   tasks; runs are cut into blocks of at most BLOCK steps.
2. Blocks are dealt by hash. A task hands batches of whole blocks to a DuckDB recursive query: each recursion advances one turn for all of
   them, keeping the least (cost, audit) for each state that a block begins in and each that it may end in.
3. Such a table is itself a step, so blocks of one conversation are put together by the same recursion, FAN at a time, until one is left.
   Only conversations of several blocks take part. An audit is one value, as long as its conversation; in these steps some 120 bytes of memory
   for each step of the longest conversation are needed.
4. Texts move once, dealt by conversation and sorted; a task reads them as a stream, applies the audit and hashes. It holds one batch and one audit.
   (A SHA-256 of one conversation can't be shared out, so this last pass over a conversation, and only this, is one task's.)

A prefix of least cost and of least audit stays so whatever follows, since equal costs in one state never make one audit the beginning of another: the recursion may forget the others.
An edit's letter and the state settle the role that it gives.

Defined results: a null id is a conversation of its own, and reads as one space in the key of the damage; null turns come first and read as one space there; null roles and texts
are one space; rows of one turn go by role, then by the hash of the text, so repeated rows are duplicates; an empty role has no initial and is illegal
beside any other; conversations that lose all rows have zeros, an empty audit and the hash of nothing; an empty table gives an empty one; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import written

#: Steps of a block, tables put together at once, and rows and bytes of a batch for one recursive query.
BLOCK, FAN, BATCH, BYTES = 256, 64, 20_000, 1 << 25
#: Tables put together at once where an audit is as long as this.
LONG, FEW = 1 << 14, 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The grammar: state and initial to state. 0 nothing yet, 1 after s, 2 after u, 3 after a; conversations end in 0 or 3.
GRAMMAR = ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2))
STATES, ENDS = (0, 1, 2, 3), (0, 3)
#: Where a new role leads from each state, and which role that is.
NEW = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
STEP = {s: {i: to for frm, i, to in GRAMMAR if frm == s} for s in STATES}
BLANK = r"\A[\x20\x09-\x0D]*\z"
OPEN_END = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"
ITEMS = "conv string, part int, block int, frm int, to int, cost long, audit string, illegal long, head string, tail string"


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """_conv, _turn, _role, _text and _n, how often in a row: dropped, emptied, without ends of sentences, repeated or made a user's by the key's crc32."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    words = F.coalesce(F.col(text), space)
    return rows.select(
        F.col(conv).alias("_conv"),
        F.col(turn).alias("_turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role), space)).alias("_role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(words, "[.!?]", "")).otherwise(words).alias("_text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("_n"),
    )


def name(conv: Column) -> Column:
    """A conversation's id as text that no other has, null included."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def hashed(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def steps(rows: DataFrame) -> DataFrame:
    """conv, _turn, _role, _sha, n, blank, dup (of n rows), open (the last sign isn't an end): equal rows of a turn as one. rows: of damaged()."""
    narrow = rows.filter("_n > 0").select(name(F.col("_conv")).alias("conv"), "_turn", "_role", hashed(F.col("_text")).alias("_sha"), "_n", F.col("_text").rlike(BLANK).alias("blank"), F.col("_text").rlike(OPEN_END).alias("open"))
    same = written(narrow.groupBy("conv", "_turn", "_role", "_sha", "blank", "open").agg(F.sum("_n").alias("n")), "steps")
    first = same.filter("NOT blank").groupBy("conv", "_role", "_sha").agg(F.min(F.struct(F.col("_turn").isNotNull().alias("has"), F.col("_turn").alias("turn"))).alias("first"), F.count("*").alias("turns"))
    # a step has no earlier equal unless its role and text occur in several turns
    again = first.filter("turns > 1").select("conv", "_role", "_sha", "first")
    is_first = F.col("first").isNull() | F.col("first.turn").eqNullSafe(F.col("_turn"))
    return same.join(again, ["conv", "_role", "_sha"], "left").select("conv", "_turn", "_role", "_sha", "n", "blank", F.when(F.col("blank"), 0).when(is_first, F.col("n") - 1).otherwise(F.col("n")).alias("dup"), "open")


def blocked(all_steps: DataFrame) -> DataFrame:
    """Steps in order, with the partition and the block of each run, and whether that is known to begin its conversation."""
    order = ["conv", "_turn", "_role", "_sha"]
    narrow = all_steps.select("conv", "_turn", "_role", "_sha", F.substring("_role", 1, 1).alias("initial"), "n", (F.col("blank") | (F.col("dup") == F.col("n"))).alias("gone"), "open")
    dealt = narrow.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, seq, begins = None, 0, part == 0
        for b in batches:
            at = []
            for c in b["conv"].to_pylist():
                if c != last:
                    begins = begins or last is not None  # it begins here, and not in a partition before
                    last, seq = c, 0
                at.append((seq // BLOCK, seq % BLOCK, begins and seq < BLOCK))
                seq += 1
            block, place, start = (pa.array(x, t) for x, t in zip(zip(*at, strict=True), (pa.int32(), pa.int32(), pa.bool_()), strict=True)) if at else (pa.array([], t) for t in (pa.int32(), pa.int32(), pa.bool_()))
            yield pa.RecordBatch.from_arrays([b["conv"], pa.array([part] * b.num_rows, pa.int32()), block, place, start, b["initial"], b["n"], b["gone"], b["open"]], names=["conv", "part", "block", "seq", "start", "initial", "n", "gone", "open"])

    return written(dealt.mapInArrow(run, "conv string, part int, block int, seq int, start boolean, initial string, n long, gone boolean, open boolean"), "blocks")


# The recursion, in DuckDB within a task

_TABLES = f"""
CREATE TABLE grammar AS SELECT * FROM (VALUES {", ".join(f"({a}, '{i}', {b})" for a, i, b in GRAMMAR)}) t(frm, initial, went);
CREATE TABLE fresh AS SELECT * FROM (VALUES {", ".join(f"({a}, {b})" for a, (b, _) in NEW.items())}) t(frm, went);
CREATE TABLE inserts AS
  SELECT frm, frm AS went, 0 AS cost, '' AS letters FROM fresh
  UNION ALL SELECT frm, went, {INSERT}, 'I' FROM fresh
  UNION ALL SELECT a.frm, b.went, {2 * INSERT}, 'II' FROM fresh a JOIN fresh b ON b.frm = a.went WHERE b.went <> a.frm;
"""
#: Edits of a kind of step, with the inserted turns before it.
_MOVES = f"""
CREATE TABLE kinds AS SELECT DISTINCT initial, gone, open FROM items;
CREATE TABLE edits AS
  SELECT initial, gone, open, s AS frm, s AS went, {DELETE} AS cost, 'D' AS letter FROM kinds, unnest([0, 1, 2, 3]) t(s)
  UNION ALL SELECT initial, gone, open, frm, went, {KEEP} + CASE WHEN open THEN {TRUNCATED} ELSE 0 END, 'K' FROM kinds JOIN grammar USING (initial) WHERE NOT gone
  UNION ALL SELECT initial, gone, open, frm, went, {REROLE} + CASE WHEN open THEN {TRUNCATED} ELSE 0 END, 'R' FROM kinds, fresh WHERE NOT gone;
CREATE TABLE moves AS
  SELECT e.initial, e.gone, e.open, i.frm, e.went, i.cost + e.cost AS cost, i.letters || e.letter AS letters FROM inserts i JOIN edits e ON e.frm = i.went;
"""
#: All rows of a step but the one that is edited are deleted.
_BY_STEP = f"""
WITH RECURSIVE dp AS (
  SELECT g, 0 AS place, s AS frm, s AS went, 0::BIGINT AS cost, '' AS audit FROM groups, unnest([0, 1, 2, 3]) t(s) WHERE s = 0 OR NOT start
  UNION ALL
  SELECT g, place, frm, went, best.cost, best.audit FROM (
    SELECT d.g, d.place + 1 AS place, d.frm, m.went, min({{'cost': d.cost + m.cost + {DELETE} * (i.n - 1), 'audit': d.audit || m.letters || repeat('D', i.n - 1)}}) AS best
    FROM dp d JOIN items i ON i.g = d.g AND i.place = d.place JOIN moves m ON m.frm = d.went AND m.initial = i.initial AND m.gone = i.gone AND m.open = i.open
    GROUP BY d.g, d.place, d.frm, m.went))
SELECT dp.* FROM dp JOIN groups USING (g) WHERE dp.place = groups.size
"""
_BY_TABLE = """
WITH RECURSIVE dp AS (
  SELECT g, 0 AS place, s AS frm, s AS went, 0::BIGINT AS cost, '' AS audit FROM groups, unnest([0, 1, 2, 3]) t(s)
  UNION ALL
  SELECT g, place, frm, went, best.cost, best.audit FROM (
    SELECT d.g, d.place + 1 AS place, d.frm, i.went, min({'cost': d.cost + i.cost, 'audit': d.audit || i.audit}) AS best
    FROM dp d JOIN items i ON i.g = d.g AND i.place = d.place AND i.frm = d.went
    GROUP BY d.g, d.place, d.frm, i.went))
SELECT dp.* FROM dp JOIN groups USING (g) WHERE dp.place = groups.size
"""
_ILLEGAL = "CASE WHEN lag(tail) OVER w || head IN ('su', 'ua', 'au') OR lag(tail) OVER w IS NULL THEN 0 ELSE 1 END"


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches of whole groups from rows sorted by keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and (sum(x.num_rows for x in held) >= BATCH or sum(x.nbytes for x in held) >= BYTES):
            columns = [b[k].to_pylist() for k in keys]
            last = tuple(held[-1][k][-1].as_py() for k in keys)
            cut = next((i for i, row in enumerate(zip(*columns, strict=True)) if row != last), b.num_rows)
            held.append(b.slice(0, cut))
            if cut < b.num_rows:
                yield pa.Table.from_batches(held)
                held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _recursed(keys: list[str], place: str, by_step: bool) -> Callable:
    """A function over sorted batches: one table of least costs and audits for each group of keys."""
    group = ", ".join(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            con.execute(_TABLES)
            for given in _whole(batches, keys):
                con.register("given", given)
                columns = "*" if by_step else '* RENAME ("to" AS went)'
                con.execute(f"CREATE OR REPLACE TABLE items AS SELECT {columns}, dense_rank() OVER (ORDER BY {group}) AS g, dense_rank() OVER (PARTITION BY {group} ORDER BY {place}) - 1 AS place FROM given")
                con.unregister("given")
                if by_step:
                    con.execute("DROP TABLE IF EXISTS moves; DROP TABLE IF EXISTS edits; DROP TABLE IF EXISTS kinds;" + _MOVES)
                    ends = "SELECT DISTINCT g, place, initial AS head, initial AS tail, n - 1 AS illegal FROM items"
                else:
                    ends = "SELECT DISTINCT g, place, head, tail, illegal FROM items"
                start = "bool_or(start)" if by_step else "false"
                con.execute(f"CREATE OR REPLACE TABLE groups AS SELECT g, any_value({keys[0]}) AS conv, {', '.join(f'any_value({k}) AS {k}' for k in keys[1:])}{', ' if keys[1:] else ''}max(place) + 1 AS size, {start} AS start FROM items GROUP BY g")
                con.execute(f"CREATE OR REPLACE TABLE ends AS SELECT g, sum(bad)::BIGINT AS illegal, arg_min(head, place) AS head, arg_max(tail, place) AS tail FROM (SELECT *, illegal + {_ILLEGAL} AS bad FROM ({ends}) WINDOW w AS (PARTITION BY g ORDER BY place)) GROUP BY g")
                part, block = ("groups.part" if "part" in keys else "0"), ("groups.block" if "block" in keys else "0")
                out = con.sql(f"SELECT groups.conv, {part}::INT AS part, {block}::INT AS block, frm::INT AS frm, went::INT AS \"to\", cost, audit, illegal, head, tail FROM ({_BY_STEP if by_step else _BY_TABLE}) d JOIN groups USING (g) JOIN ends USING (g)").to_arrow_table()
                yield from out.to_batches()

    return run


def solved(blocks: DataFrame) -> DataFrame:
    """conv, cost, audit, illegal of each conversation. blocks: of blocked()."""
    keys = ["conv", "part", "block"]
    dealt = blocks.repartition(*keys).sortWithinPartitions(*keys, "seq")
    items = written(dealt.mapInArrow(_recursed(keys, "seq", True), ITEMS), "solved")
    while True:
        by = items.groupBy("conv").agg(F.countDistinct("part", "block").alias("n"), F.max("block").alias("blocks"), F.max(F.length("audit")).alias("long"))
        most, deep, longest = by.agg(F.max("n"), F.max("blocks"), F.max("long")).first()
        if not most or most == 1:
            break
        several = by.filter("n > 1").select("conv")
        level = "block" if deep else "part"
        merged = items.join(several, "conv").withColumn("_at", F.struct("part", "block")).withColumn(level, F.floor(F.col(level) / (FAN if longest < LONG else FEW)).cast("int"))
        keys = ["conv", "part", "block"]
        dealt = merged.withColumns({"at1": F.col("_at.part"), "at2": F.col("_at.block")}).drop("_at").repartition(*keys).sortWithinPartitions(*keys, "at1", "at2")
        joined = dealt.mapInArrow(_recursed(keys, "at1, at2", False), ITEMS)
        items = written(items.join(several, "conv", "left_anti").unionByName(joined), "solved")
    inserts = F.when(F.col("to") == 1, 2).when(F.col("to") == 2, 1).otherwise(0)
    ended = items.filter("frm = 0").withColumn("cost", F.col("cost") + INSERT * inserts).withColumn("audit", F.concat("audit", F.repeat(F.lit("I"), inserts)))
    return ended.groupBy("conv").agg(F.min(F.struct("cost", "audit")).alias("b"), F.first("illegal").alias("illegal")).select("conv", "b.cost", "b.audit", "illegal")


# The repaired conversations


def edited(roles_texts: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """Role and text of the repaired turns; roles_texts: rows in order."""
    state = 0
    rows = iter(roles_texts)
    for letter in audit:
        if letter == "I":
            state, role = NEW[state]
            yield role, ""
            continue
        role, text = next(rows)
        if letter == "D":
            continue
        if letter == "R":
            state, role = NEW[state]
        else:
            state = STEP[state][role[0]]
        yield role, text


def _stream(audits: DataFrame, rows: DataFrame) -> DataFrame:
    """Audits and rows dealt by conversation: a conversation's audit, then its rows in order."""
    told = audits.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("_turn"), F.lit("").alias("_role"), F.col("audit").alias("_text"), F.lit(1).cast("long").alias("_n"), F.lit(None).cast("binary").alias("_sha"))
    rows = rows.filter("_n > 0").select(name(F.col("_conv")).alias("conv"), F.lit(1).alias("kind"), F.col("_turn").cast("long"), "_role", "_text", F.col("_n").cast("long"), hashed(F.col("_text")).alias("_sha"))
    return told.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "kind", "_turn", "_role", "_sha").select("conv", "kind", "_role", "_text", "_n")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, Iterator[tuple[str, str]]]]:
    """Conversation, audit and rows of a sorted stream; the rows must be read before the next one is asked for."""
    lines = (row for b in batches for row in zip(*(b[c].to_pylist() for c in ("conv", "kind", "_role", "_text", "_n")), strict=True))
    ahead = next(lines, None)
    while ahead:
        conv, audit = ahead[0], ahead[3]

        def rows(conv=conv) -> Iterator[tuple[str, str]]:
            nonlocal ahead
            while (ahead := next(lines, None)) and ahead[0] == conv:
                for _ in range(ahead[4]):
                    yield ahead[2], ahead[3]

        some = rows()
        yield conv, audit, some
        for _ in some:  # what hasn't been read
            pass


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[str, str]] = []
    for conv, audit, rows in _conversations(batches):
        sha, between = hashlib.sha256(), b""
        for role, text in edited(rows, audit):
            sha.update(between + f"{role}:{text}".encode())
            between = b"\n"
        out.append((conv, sha.hexdigest()))
        if len(out) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)], names=["conv", "repaired_sha256"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)], names=["conv", "repaired_sha256"])


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for conv, audit, rows in _conversations(batches):
        for n, (role, text) in enumerate(edited(rows, audit)):
            out.append((conv, n, role, text))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv", "turn", "role", "text"])
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv", "turn", "role", "text"])


def audits(rows: DataFrame) -> DataFrame:
    """conv, blank, duplicate, truncated, gaps, illegal, cost, audit. rows: of damaged()."""
    every = written(steps(rows), "steps")
    faulty = F.col("blank")
    counted = every.groupBy("conv").agg(
        F.sum(F.when(faulty, F.col("n")).otherwise(0)).alias("blank"),
        F.sum("dup").alias("duplicate"),
        F.sum(F.when(~faulty & F.col("open"), F.col("n") - F.col("dup")).otherwise(0)).alias("truncated"),
        F.coalesce(F.max("_turn") - F.min("_turn") + 1 - F.countDistinct("_turn"), F.lit(0)).cast("long").alias("gaps"),
    )
    return counted.join(solved(blocked(every)), "conv")


def repaired(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns of conversations as they are given, repaired: conv (as text, "=" before it), turn from 0, role, text."""
    space = F.lit(" ")
    rows = conversations.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(role, space).alias("_role"), F.coalesce(text, space).alias("_text"), F.lit(1).alias("_n"))
    return _stream(audits(rows), rows).mapInArrow(_turns, "conv string, turn long, role string, text string")


def digest(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation, after damage and repair: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = damaged(conversations, conv, turn, role, text)
    told = written(audits(rows), "audits")
    hashes = _stream(told, rows).mapInArrow(_hashes, "conv string, repaired_sha256 string")
    ids = conversations.select(F.col(conv).alias("conv_id")).distinct().withColumn("conv", name(F.col("conv_id")))
    nothing = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return ids.join(told, "conv", "left").join(hashes, "conv", "left").select("conv_id", *(F.coalesce(F.col(c), F.lit(v).cast("long" if v == 0 else "string")).alias(c) for c, v in nothing.items()))
