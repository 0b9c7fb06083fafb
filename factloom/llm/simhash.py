"""SimHash near-duplicate groups, compared bit-sliced.

Fingerprints that agree on one of five parts of their bits meet in a bucket (within four differing bits at least one
part of five agrees). In a bucket the fingerprints lie as vertical bit planes, 64 to a word; a query's distances to 64
of them grow at once in carry-save counters, and a word leaves as soon as all its lanes exceed the radius. Buckets
above ``MOST`` fingerprints are dealt again by five parts of the bits not yet fixed, so no task holds an unbounded one.

Defined results: a null or empty text, or one of white space only, has the fingerprint zero and links like any other.
Rows with a null ``doc_id`` link too; a group of such rows only has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import frames
from factloom.llm.components import connected_components

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Distinct fingerprints that one bucket may hold.
MOST = 4096
#: Shingles whose bits are unpacked at once, and pairs of a query and a word compared at once.
PIECE, PAIRS = 1 << 16, 1 << 16

_ALL = (1 << 64) - 1
_U = np.uint64


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if more than half of the shingles' hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(words) - shingle + 1)].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    hashed, n = xxhash.xxh64_digest, len(starts)
    votes = np.zeros(64, dtype=np.int64)
    for first in range(0, n, PIECE):
        raw = b"".join([hashed(joined[a:b], SEED) for a, b in zip(starts[first : first + PIECE], ends[first : first + PIECE], strict=True)])
        votes += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, check, fp)`` for each row: its id, a checksum of its text and its fingerprint as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [signed(simhash(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())], names=["doc_id", "check", "fp"])

    rows = docs.select(F.col(key).alias("doc_id"), frames.crc(text).alias("check"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, check bigint, fp bigint")


def parts(free: int, count: int = RADIUS + 1) -> list[int]:
    """The set bits of ``free`` in ``count`` runs of nearly equal size, as masks."""
    bits = [b for b in range(64) if free >> b & 1]
    cuts = [len(bits) * i // count for i in range(count + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def _planes(fps: np.ndarray, word: np.ndarray, lane: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """``planes[b, w]``: bit b of the 64 fingerprints of word w; and which lanes of each word are taken."""
    lanes = np.zeros((words, 64), dtype=_U)
    lanes[word, lane] = fps
    taken = np.zeros((words, 64), dtype=bool)
    taken[word, lane] = True
    pack = lambda bits: np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return np.stack([pack((lanes >> _U(b) & _U(1)).astype(bool)) for b in range(64)]), pack(taken)


def near_lanes(queries: np.ndarray, planes: np.ndarray, word: np.ndarray, valid: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (query, word) have lanes within the radius, and those lanes as a bit set.

    Two planes at a time go through a full adder into a carry-save counter for each lane. Counters begin so high that one
    more than ``radius`` overflows; a lane that did stays out, and a pair whose valid lanes are all out is abandoned.
    """
    alive, bits = np.arange(len(queries)), (radius + 1).bit_length()
    begin = (1 << bits) - 1 - radius
    c = [np.full(len(queries), _ALL if begin >> i & 1 else 0, dtype=_U) for i in range(bits)]
    out = np.zeros(len(queries), dtype=_U)
    for b in range(0, 64, 2):
        x = planes[b][word] ^ (_U(0) - (queries >> _U(b) & _U(1)))
        y = planes[b + 1][word] ^ (_U(0) - (queries >> _U(b + 1) & _U(1)))
        both = x ^ y
        carry = x & y | c[0] & both
        c[0] = c[0] ^ both
        for i in range(1, bits):
            c[i], carry = c[i] ^ carry, c[i] & carry
        out = out | carry
        if b % 8 == 6:
            go = np.flatnonzero(valid & ~out)
            if len(go) < 0.7 * len(alive):
                alive, queries, word, valid, out, *c = (a[go] for a in (alive, queries, word, valid, out, *c))
    near = valid & ~out
    go = np.flatnonzero(near)
    return alive[go], near[go]


def near_pairs(fps: np.ndarray, starts: np.ndarray, radius: int = RADIUS, pairs: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indices, the lower first, of fingerprints within the radius in buckets that begin at ``starts``; a bounded number at a time."""
    n = len(fps)
    sizes = np.diff(np.append(starts, n))
    pos = np.arange(n) - np.repeat(starts, sizes)
    words = (sizes + 63) // 64
    base = np.cumsum(words) - words
    word, lane = np.repeat(base, sizes) + pos // 64, pos % 64
    planes, taken = _planes(fps, word, lane, int(words.sum()))
    member = np.full((int(words.sum()), 64), -1, dtype=np.int64)
    member[word, lane] = np.arange(n)
    left = np.repeat(words, sizes) - pos // 64  # words from the query's own on
    ends = np.cumsum(left)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + pairs, side="right")))
        own = np.repeat(np.arange(first, last), left[first:last])
        step = np.arange(len(own)) - np.repeat(np.cumsum(left[first:last]) - left[first:last], left[first:last])
        at = word[own] + step
        later = np.where(step == 0, ~_U(0) << lane[own].astype(_U) << _U(1), ~_U(0))
        got, near = near_lanes(fps[own], planes, at, taken[at] & later, radius)
        if len(got):
            bits = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, c = np.nonzero(bits)
            yield own[got[r]], member[at[got[r]], c]
        first = last


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each at most its own index, once each ``a`` and ``b`` are in one group: the least index of a group."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def bucket_links(fps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints in buckets that begin at ``starts``: for each with a near one in its bucket, the least index of its group."""
    label = np.arange(len(fps))
    for a, b in near_pairs(fps, starts):
        label = merged(label, a, b)
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return moved, label[moved]


def _links_in_buckets(rows: DataFrame) -> DataFrame:
    """``rows(mask, part, fp)`` to star edges ``(u, v)`` inside each bucket; each task streams over its sorted buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(cols: list[np.ndarray]) -> pa.RecordBatch:
            mask, part, fps = cols
            new = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])))
            sizes = np.diff(np.append(new, len(fps)))
            many = sizes > 1
            keep = np.repeat(many, sizes)
            fps = fps[keep].view(_U)
            starts = np.cumsum(sizes[many]) - sizes[many]
            u, v = bucket_links(fps, starts) if len(fps) else (np.zeros(0, int), np.zeros(0, int))
            return pa.RecordBatch.from_arrays([pa.array(fps[i].view(np.int64)) for i in (u, v)], names=["u", "v"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            end = int(new[-1]) + 1 if len(new) else 0  # the last bucket may go on
            if end:
                yield settle([c[:end] for c in cols])
            held = [c[end:] for c in cols]
        if held is not None and len(held[0]):
            yield settle(held)

    n = frames.partitions(rows.sparkSession)
    return rows.repartition(n, "mask", "part").sortWithinPartitions("mask", "part").mapInArrow(run, "u bigint, v bigint")


def links(prints: DataFrame, most: int = MOST) -> DataFrame:
    """Edges ``(u, v)`` that connect all fingerprints of ``prints(fp)`` within the radius, as stars inside each bucket.

    ``most``, at least 32, only moves work between buckets; the links are the same for every value.
    """

    def dealt(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
        """Each row once for each further part of the bits that its mask leaves free."""
        if len(masks) == 1:
            (only,) = masks.values()
            new = rows.select(F.explode(F.array(*(F.lit(signed(x)) for x in only))).alias("mask"), "fp")
        else:
            known = rows.sparkSession.createDataFrame([(signed(m), [signed(x) for x in xs]) for m, xs in masks.items()], "mask bigint, next array<bigint>")
            new = rows.join(F.broadcast(known), "mask").select(F.explode("next").alias("mask"), "fp")
        return new.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("part"), "fp")

    rows = prints.select(F.lit(0).cast("bigint").alias("mask"), "fp").distinct()
    masks, found = [0], None
    while True:
        free = {m: [m | p for p in parts(_ALL & ~m)] for m in masks}
        rows = dealt(rows, free)
        counts = frames.cut(rows.groupBy("mask", "part").agg(F.count("*").alias("n")).where(f"n > {most}").select("mask", "part"))
        masks = sorted({x for xs in free.values() for x in xs})
        hot = not counts.isEmpty()  # once as few bits are free as ``most`` has, no bucket can be
        edges = _links_in_buckets(rows.join(counts, ["mask", "part"], "left_anti") if hot else rows)
        found = edges if found is None else found.unionByName(edges)
        if not hot:
            return found
        rows = frames.cut(rows.join(counts, ["mask", "part"], "left_semi").select("mask", "fp"))
        masks = [m if m >= 0 else m + (1 << 64) for m in (r["mask"] for r in rows.select("mask").distinct().collect())]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, check, fp, root, component_id)`` for each row: a group has one root, and the smallest ``doc_id`` reachable over links names it.

    Texts of one fingerprint are one node, so copies are never paired with each other.
    """
    rows = frames.cut(fingerprints(docs, key, text))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = frames.cut(connected_components(links(nodes)))
    inside = frames.cut(groups.join(nodes, groups["node"] == nodes["fp"]).select("fp", "component", "first"))
    least = frames.cut(inside.groupBy("component").agg(F.min("first").alias("least")))
    linked = inside.join(least, "component").select("fp", "least", "component")
    named = nodes.join(linked, "fp", "left").select("fp", F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"), F.coalesce("component", "fp").alias("root"))
    return rows.join(frames.cut(named), "fp").select("doc_id", "check", "fp", "root", "component_id")


def hexadecimal(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
