"""What bit predictors over the byte stream of each text would cost: python -m tests.llm.measure_byte_mixing [FOLDER]

Texts are streams that are coded in step, a bit of each at a time, so that every step is a few array operations over all streams. Contexts go across words: hashes of the last one to
four bytes, and of the word so far with the one before. Weights are gated by the place in the byte and updated after every bit, an adaptive map by the last byte refines the result.
It prints nanoseconds for each bit and what they come to for each GB of input; nothing of it is used by the operator (see README on op2).
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

STREAMS, SLOTS, STEPS = 4096, 1 << 22, 400


class Mixer:
    """Predictors, weights and the map that refines, for streams in step."""

    def __init__(self, streams: int, orders: int = 5, slots: int = SLOTS):
        self.n, self.orders, self.slots = streams, orders, slots
        self.tables = np.full((orders, slots), 2048, np.uint16)  # probabilities in 1 / 4096
        self.weights = np.full((256, orders), 0.3, np.float32)
        self.map = np.tile(((np.arange(33) - 16) / 2.0).astype(np.float32), (256, 1))
        self.stretch = np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096))).astype(np.float32)
        self.history = np.zeros((streams, 4), np.uint32)
        self.word, self.before = np.zeros(streams, np.uint32), np.zeros(streams, np.uint32)
        self.bits = 0.0

    def contexts(self) -> np.ndarray:
        h, out = np.zeros(self.n, np.uint32), []
        for k in range(self.orders - 1):
            h = (h + self.history[:, k] + np.uint32(1)) * np.uint32(2654435761)
            out.append(h)
        out.append((self.word * np.uint32(40503) + self.before) * np.uint32(2246822519))
        return np.stack(out)

    def byte(self, values: np.ndarray, live: np.ndarray) -> None:
        """One byte of each stream; live: streams that have one."""
        context, node = self.contexts(), np.ones(self.n, np.uint32)
        rows = np.arange(self.orders)[:, None]
        last = self.history[:, 0]
        for i in range(7, -1, -1):
            bit = (values >> i) & 1
            slot = ((context + node * np.uint32(0x9E3779B1)) >> np.uint32(10)).astype(np.int64)
            p = self.tables[rows, slot]
            s = self.stretch[p]
            w = self.weights[node & 255]
            dot = np.einsum("ks,sk->s", s, w)
            mixed = 1 / (1 + np.exp(-dot))
            at = np.clip((dot + 8) * 2, 0, 31.99).astype(np.int64)
            refined = 1 / (1 + np.exp(-self.map[last & 255, at]))
            q = (mixed + refined) / 2
            self.bits -= float(np.log2(np.where(bit, q, 1 - q))[live].sum())
            error = (bit - mixed).astype(np.float32)
            np.add.at(self.weights, node[live] & 255, (0.002 * error * s).T[live])
            np.add.at(self.map, (last[live] & 255, at[live]), 0.02 * (bit - refined)[live].astype(np.float32))
            new = np.where(bit, p + ((4095 - p) >> 4), p - (p >> 4)).astype(np.uint16)
            self.tables[rows, slot[:, :]] = np.where(live, new, p)
            node = node << np.uint32(1) | bit.astype(np.uint32)
        letter = values > 32
        self.before = np.where(letter, self.before, self.word)
        self.word = np.where(letter, (self.word + values.astype(np.uint32) + 1) * np.uint32(2654435761), 0).astype(np.uint32)
        self.history = np.concatenate([values.astype(np.uint32)[:, None], self.history[:, :3]], 1)


def main(folder: str = "/root/testdata/check_s") -> None:
    path = Path(folder, "documents.parquet")
    texts = [(t or "").encode() for t in pq.read_table(path, columns=["text"])["text"].to_pylist()]
    size = sum(f.stat().st_size for f in ([path] if path.is_file() else path.rglob("*.parquet")))
    whole = sum(map(len, texts))
    some = sorted(texts, key=len, reverse=True)[:STREAMS]
    data = np.zeros((STEPS, STREAMS), np.uint8)
    length = np.array([min(len(t), STEPS) for t in some] + [0] * (STREAMS - len(some)))
    for k, t in enumerate(some):
        data[: length[k], k] = np.frombuffer(t[:STEPS], np.uint8)
    t0 = time.thread_time()
    sum(range(50_000))
    slow = (time.thread_time() - t0) * 1000
    for orders in (1, 2, 3, 5):
        mixer, t0 = Mixer(STREAMS, orders), time.process_time()
        for step in range(STEPS):
            mixer.byte(data[step].astype(np.int64), step < length)
        each = (time.process_time() - t0) / slow / (8 * length.sum())
        passes = 1 + 6 / 7  # learning from six of seven documents, then scoring all
        print(f"{orders} predictors: {each * 1e9:.0f} ns a bit at slowness 1 (here {slow:.2f}), {mixer.bits / length.sum():.2f} bits a byte; {each * 8 * whole * passes / (size / 1e9):.0f} CPU seconds for each GB of input")


if __name__ == "__main__":
    main(*sys.argv[1:])
