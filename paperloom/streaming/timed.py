"""Streams with timers: replies that end by silence or by length, and conversations that are forgotten.

State is kept by key; event-time timers fire when the watermark says that nothing earlier can come. Rows wait in list state until then and are read in the order of their
time, so results don't depend on how rows fall into batches, nor on their order within the watermark's delay. A reply's state is gone when it has ended, a conversation's after its time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Timers need a state store that knows them.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def cut(rows: list[tuple], idle: int, total: int) -> list[list[tuple]]:
    """Rows (time in ms, order, piece), sorted, as replies: a row begins a new one after idle ms of silence, or total ms after the beginning of the one before."""
    out: list[list[tuple]] = []
    for r in rows:
        if out and r[0] - out[-1][-1][0] < idle and r[0] - out[-1][0][0] < total:
            out[-1].append(r)
        else:
            out.append([r])
    return out


class Replies(StatefulProcessor):
    """A row for each reply when it has ended: why ("idle" or "total"), its text, pieces, beginning, end of its time and time of its first piece, in ms."""

    def __init__(self, idle: int, total: int):
        self.idle, self.total = idle, total

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, n long, piece string")

    def deadline(self, reply: list[tuple]) -> int:
        return min(reply[-1][0] + self.idle, reply[0][0] + self.total)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        got = [r for b in rows for r in zip(b["at"].tolist(), b["n"].tolist(), b["piece"].fillna("").tolist(), strict=True)]
        self.waiting.appendList([tuple(r) for r in got])
        # when the earliest of these may have ended
        self.handle.registerTimer(min(r[0] for r in got) + min(self.idle, self.total))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        replies = cut(sorted(tuple(r) for r in self.waiting.get()), self.idle, self.total)
        done = []
        # in order, so that a reply is cut off only from what is complete
        while replies and self.deadline(replies[0]) <= now:
            done.append(replies.pop(0))
        rest = [r for reply in replies for r in reply]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(max(now + 1, self.deadline(replies[0])))
        else:
            self.waiting.clear()
        out = []
        for reply in done:
            said = [r for r in reply if r[2]]
            why = "idle" if reply[-1][0] + self.idle <= reply[0][0] + self.total else "total"
            out.append((key[0], why, "".join(r[2] for r in sorted(said, key=lambda r: r[1])), len(said), reply[0][0], self.deadline(reply), said[0][0] if said else None))
        if out:
            yield pd.DataFrame(out, columns=["key", "why", "text", "n_pieces", "start", "end", "first"]).astype({"first": "Int64"})

    def close(self) -> None:
        pass


class Conversations(StatefulProcessor):
    """The context of a conversation after each batch: its last turns; forgotten when no turn came for a time."""

    def __init__(self, keep: int, chars: int, forget: int):
        self.keep, self.chars, self.forget = keep, chars, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn long, said string")
        self.count = handle.getValueState("count", "n long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, last = self.count.get() if self.count.exists() else (0, 0)
        held = [tuple(r) for r in self.turns.get()] if self.turns.exists() else []
        for b in rows:
            n += len(b)
            last = max([last, *b["at"].tolist()])
            held = sorted([*held, *((int(t), f"{r}: {x[: self.chars]}") for t, r, x in zip(b["turn"], b["role"], b["text"].fillna(""), strict=True))])[-self.keep :]
        self.turns.put(held)
        self.count.update((n, last))
        self.handle.registerTimer(last + self.forget)
        yield pd.DataFrame({"key": [key[0]], "n_turns": [n], "context": ["\n".join(x for _, x in held)]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.count.exists() and self.count.get()[1] + self.forget <= timerValues.getCurrentWatermarkInMs():
            self.turns.clear()
            self.count.clear()
        return iter(())

    def close(self) -> None:
        pass


def replies(rows: DataFrame, key: str, piece: str, order: str, idle_ms: int, total_ms: int) -> DataFrame:
    """rows (with ts under a watermark): key, why, text, n_pieces, start, end, first of replies, in ms."""
    rows.sparkSession.conf.set(*STORE)
    narrow = rows.select(F.col(key).cast("long").alias("key"), F.unix_millis("ts").alias("at"), F.col(order).cast("long").alias("n"), F.col(piece).alias("piece"), "ts")
    schema = "key long, why string, text string, n_pieces long, start long, end long, first long"
    return narrow.groupBy("key").transformWithStateInPandas(Replies(idle_ms, total_ms), schema, "Append", "EventTime")


def conversations(turns: DataFrame, forget_ms: int, keep: int = 20, chars: int = 4000) -> DataFrame:
    """turns (conv_id, turn, role, text, and ts under a watermark): key, n_turns, context of each conversation after each batch; it begins anew after forget_ms without a turn."""
    turns.sparkSession.conf.set(*STORE)
    rows = turns.select(F.col("conv_id").alias("key"), "turn", "role", "text", F.unix_millis("ts").alias("at"), "ts")
    return rows.groupBy("key").transformWithStateInPandas(Conversations(keep, chars, forget_ms), "key long, n_turns long, context string", "Update", "EventTime")
