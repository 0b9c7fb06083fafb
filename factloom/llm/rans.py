"""Static range asymmetric numeral coding of integer arrays below 65,536.

A segment has one frequency table for all its blocks. A block interleaves ``LANES`` coder states; every ``STRIPE`` rows
of them a checkpoint keeps the states and the place in the words, so each stripe decodes by itself. Here all stripes of
a segment advance together, one row of lanes a step. Each block has a checksum of its words and one of its values.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

LANES, BLOCK, STRIPE = 64, 1 << 14, 128
SCALE = 16
_LOW, _U = np.uint64(1 << 31), np.uint64


class DamagedBlock(ValueError):
    """A block whose checksum doesn't fit."""


@dataclass
class Table:
    symbols: np.ndarray
    freqs: np.ndarray

    def pack(self) -> bytes:
        return np.uint32(len(self.symbols)).tobytes() + self.symbols.astype("<u2").tobytes() + (self.freqs - 1).astype("<u2").tobytes()

    @staticmethod
    def unpack(raw: bytes) -> Table:
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        return Table(np.frombuffer(raw, "<u2", n, 4), np.frombuffer(raw, "<u2", n, 4 + 2 * n).astype(np.uint32) + 1)


def table(values: np.ndarray) -> Table:
    """Frequencies that sum to ``2 ** SCALE``, at least one for each value there is."""
    counts = np.bincount(values)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    freqs = np.maximum(1, counts * (1 << SCALE) // counts.sum()).astype(np.int64)
    over = int(freqs.sum()) - (1 << SCALE)
    order = np.argsort(-freqs, kind="stable")
    while over:  # the largest give or take first
        for i in order:
            step = min(over, int(freqs[i]) // 2) if over > 0 else over
            freqs[i] -= step
            over -= step
            if not over:
                break
    return Table(symbols.astype(np.uint16), freqs.astype(np.uint32))


def encode(values: np.ndarray, t: Table) -> list[dict]:
    """Blocks of ``values``: ``n``, ``rows``, ``states`` and ``offsets`` of the checkpoints, ``words``, ``crc`` of the words and ``value_crc``."""
    n = len(values)
    if not n:
        return []
    blocks = -(-n // BLOCK)
    rows = -(-n // (blocks * LANES))
    size = rows * LANES
    place = np.zeros(1 << 16, dtype=np.int32)
    place[t.symbols] = np.arange(len(t.symbols))
    index = place[values]
    padded = np.full(blocks * size, int(np.argmax(t.freqs)), dtype=np.int32)
    padded[:n] = index
    grid = padded.reshape(blocks, rows, LANES)
    freq, start = t.freqs.astype(_U), (np.cumsum(t.freqs) - t.freqs).astype(_U)
    x = np.full((blocks, LANES), _LOW, dtype=_U)
    marks, words = np.zeros((rows, blocks, LANES), dtype=bool), np.zeros((rows, blocks, LANES), dtype="<u4")
    states = {}
    for r in range(rows - 1, -1, -1):
        f, c = freq[grid[:, r]], start[grid[:, r]]
        full = x >= f << _U(63 - SCALE)
        marks[r], words[r] = full, x.astype(np.uint32)
        x = np.where(full, x >> _U(32), x)
        q = x // f
        x = (q << _U(SCALE)) + (x - q * f) + c
        if r % STRIPE == 0:
            states[r] = x
    out = []
    points = sorted(states)
    for b in range(blocks):
        own, at = words[:, b][marks[:, b]].tobytes(), np.append(0, np.cumsum(marks[:, b].sum(axis=1)))
        part = values[b * size : min(n, (b + 1) * size)]
        out.append({"n": len(part), "rows": rows, "states": np.stack([states[r][b] for r in points]).astype("<u8").tobytes(), "offsets": at[points].astype("<u4").tobytes(), "words": own, "crc": zlib.crc32(own), "value_crc": zlib.crc32(part.astype("<u2").tobytes())})
    return out


def decode(blocks: list[dict], t: Table) -> np.ndarray:
    """The values of ``blocks``, of one table."""
    if not blocks:
        return np.zeros(0, dtype=np.uint16)
    for i, b in enumerate(blocks):
        if zlib.crc32(b["words"]) != b["crc"]:
            raise DamagedBlock(f"words of block {i}")
    freq, start = t.freqs.astype(_U), (np.cumsum(t.freqs) - t.freqs).astype(_U)
    slot = np.repeat(np.arange(len(t.freqs), dtype=np.uint16), t.freqs)
    words = np.frombuffer(b"".join(b["words"] for b in blocks) + bytes(4), dtype="<u4").astype(_U)
    base = np.cumsum([0, *(len(b["words"]) // 4 for b in blocks)])
    x = np.concatenate([np.frombuffer(b["states"], "<u8").reshape(-1, LANES) for b in blocks]).astype(_U)
    at = np.concatenate([np.frombuffer(b["offsets"], "<u4").astype(np.int64) + base[i] for i, b in enumerate(blocks)])
    left = np.concatenate([np.minimum(STRIPE, b["rows"] - STRIPE * np.arange(len(b["offsets"]) // 4)) for b in blocks])
    order = np.argsort(-left, kind="stable")  # stripes that end sooner stand last and drop out
    x, at, sizes = x[order], at[order], left[order]
    got = np.zeros((len(left), STRIPE, LANES), dtype=np.uint16)
    for r in range(int(sizes[0])):
        live = int(np.searchsorted(-sizes, -r))
        y = x[:live]
        low = y & _U((1 << SCALE) - 1)
        s = slot[low]
        got[:live, r] = s
        y = freq[s] * (y >> _U(SCALE)) + low - start[s]
        few = y < _LOW
        place = at[:live, None] + np.cumsum(few, axis=1) - 1
        x[:live] = np.where(few, y << _U(32) | words[np.where(few, place, 0)], y)
        at[:live] += few.sum(axis=1)
    back = np.empty_like(got)
    back[order] = got
    out, first = [], 0
    for i, b in enumerate(blocks):
        stripes = len(b["offsets"]) // 4
        own = t.symbols[back[first : first + stripes].reshape(-1)[: b["n"]]] if b["n"] else np.zeros(0, np.uint16)
        if zlib.crc32(own.astype("<u2").tobytes()) != b["value_crc"]:
            raise DamagedBlock(f"values of block {i}")
        out.append(own)
        first += stripes
    return np.concatenate(out)
