import hashlib
import itertools
import random
import re
import zlib

import pytest

from paperloom.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, _n string"
NEXT = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}
GRAMMAR = re.compile("(s?(ua)+)?")


def broken(rows):
    """Rows of one conversation after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        t = text.strip(" \t\n\v\f\r")
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, audit), and the repaired turns, by trying all edits and up to two inserted turns in each place."""
    best = None
    gaps = [*itertools.product(range(3), repeat=len(rows) + 1)]
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(found, edits, strict=True)):
            continue
        cost = sum({"K": 0, "R": 3, "D": 4}[e] + (3 if f == "truncated" and e != "D" else 0) for f, e in zip(found, edits, strict=True))
        for gap in gaps:
            state, turns, audit = "0", [], ""
            for i in range(len(rows) + 1):
                for letter in "I" * gap[i] + (edits[i] if i < len(rows) else ""):
                    audit += letter
                    if letter == "D":
                        continue
                    if letter == "K":
                        role, text = rows[i][1:]
                    else:
                        role, text = "assistant" if state == "2" else "user", "" if letter == "I" else rows[i][2]
                    state = NEXT.get((state, role[:1]), "")
                    turns.append((role, text))
            if state and GRAMMAR.fullmatch("".join(r[0] for r, _ in turns)) and (best is None or (cost + 3 * sum(gap), audit) < best[:2]):
                best = (cost + 3 * sum(gap), audit, turns)
    return best


def expected(data):
    out = []
    for conv in dict.fromkeys(r[0] for r in data):
        rows = broken([r[:4] for r in data if r[0] == conv])
        found = faults(rows)
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit, repaired = cheapest(rows, found)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def data(n=60, seed=5, longest=4):
    r = random.Random(seed)
    texts = ["One.", "Two!", "three", "four. ", "\tfive?\n", "", " \n", None, "six ", ".  ", "a\nb", "éü."]
    out = []
    for conv in [*range(n), None]:
        at = 0
        for _ in range(r.randint(1, longest)):
            at += r.choice([0, 1, 1, 1, 2])
            out.append((conv, None if r.random() < 0.1 else at, r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), r.choice(texts), "x", "y"))
    return out


def got(spark, rows):
    return sorted((tuple(r) for r in turn_repair.digest(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def test_repairs_are_the_cheapest(spark):
    rows = data()
    assert got(spark, rows) == expected(rows)


@pytest.mark.parametrize(("block", "fan", "batch", "long"), [(1, 2, 1, 1 << 14), (2, 2, 3, 1 << 14), (3, 64, 20_000, 4)])
def test_long_conversations_in_blocks(spark, monkeypatch, block, fan, batch, long):
    """Blocks put together give what one block gives, wherever range partitions cut."""
    rows = data(3, 9, 5) + [(77, i, ["user", "assistant", "user", "system"][i * i % 4], ["yes.", f"no {i}", f"so {i}!"][i % 3], "x", "y") for i in range(90)]
    want = got(spark, rows)
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    monkeypatch.setattr(turn_repair, "FAN", fan)
    monkeypatch.setattr(turn_repair, "BATCH", batch)
    monkeypatch.setattr(turn_repair, "LONG", long)
    assert got(spark, rows) == want


def test_repeated_rows_and_empty_tables(spark):
    assert got(spark, []) == []
    rows = [(8, 3, "user", "Yes.", "x", "y")] * 3 + [(8, 4, "assistant", "No.", "x", "y"), (8, 4, "assistant", "No.", "x", "y")]
    assert got(spark, rows) == expected(rows)
    many = [(8, 3, "user", "Yes.", "x", "y")] * 5000
    (row,) = got(spark, many)
    assert row[3:5] == (row[3], 0) and row[3] in (4999, 9999) and row[7] == "K" + "D" * row[3] + "I"


def test_repaired_turns_read_as_the_grammar_does(spark):
    rows = data(40, 4)
    by = {}
    for r in turn_repair.repaired(spark.createDataFrame(rows, SCHEMA)).collect():
        by.setdefault(r.conv, []).append((r.turn, r.role))
    assert by and all(GRAMMAR.fullmatch("".join(role[0] for _, role in sorted(turns))) for turns in by.values())
