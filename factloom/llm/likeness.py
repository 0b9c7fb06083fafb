"""SimHash near-dedup at a given likeness: five-word shingles, Jaccard similarity 0.8 or more, exact on every linked pair.

Documents of one shingle set are one node. Nodes that agree on all ``ROWS`` least hashes of one of ``BANDS`` bands meet
in a bucket: at a similarity of 0.8 a pair meets with a probability of 1 - (1 - 0.8^4)^20, all but 3 of 100,000, and
more surely above. In a bucket the nodes' SimHash fingerprints are compared bit-sliced, as in
:mod:`factloom.llm.simhash`; sets of similarity 0.8 differ in 9.7 of 64 bits on average, and pairs that differ in more
than ``RADIUS`` are abandoned. What is left, and not yet connected, is compared on the whole shingle sets.

The sets move to the buckets of the first bands, then to those buckets of the others whose nodes are not all in one group
yet. A bucket whose sets take more than ``BLOCK`` bytes is cut into blocks, and each two of them meet in a task of their own.

Defined results: words are as in SimHash; a text of fewer words is one shingle; texts without words are copies of each
other. Shingles of one 64-bit hash count as equal, and so do sets of one 64-bit hash. Other columns come back as they
are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import frames, simhash
from factloom.llm.components import connected_components

SEED = 42
SHINGLE = 5
#: A pair is linked if its similarity is 4/5 or more.
SHARE, OF = 4, 5
ROWS, BANDS = 4, 20
#: Differing bits of a pair that is still compared exactly: over four deviations from the mean at the least similarity.
RADIUS = 24
#: Bytes of shingle sets in one block of a bucket, and pairs of a query and a word of 64 fingerprints compared at once.
BLOCK, PAIRS = 32 << 20, 1 << 12
#: Bands that are compared first. Of the others only buckets whose nodes these have not yet all connected are left.
FIRST = 5
#: Shingles worked on at once.
PIECE = 1 << 13
#: Bytes of text or of shingle sets taken out of a batch at once.
TEXTS = 1 << 20

_U = np.uint64
_SALT = frames.mixed(np.arange(1, ROWS * BANDS + 1, dtype=_U))
_ODD = frames.mixed(_SALT) | _U(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=_U)
    hashed = xxhash.xxh64_intdigest
    w = np.fromiter((hashed(x, SEED) for x in words), dtype=_U, count=len(words))
    n, size = max(1, len(words) - size + 1), min(size, len(words))
    h = np.full(n, size, dtype=_U)
    for i in range(size):
        h = frames.mixed(h ^ w[i : i + n])
    return np.unique(h)


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def buckets(found: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for each band; a set without shingles has none."""
    if not len(found):
        return found
    least = np.full(len(_SALT), ~_U(0), dtype=_U)
    for i in range(0, len(found), PIECE):
        least = np.minimum(least, ((found[i : i + PIECE] ^ _SALT[:, None]) * _ODD[:, None]).min(axis=1))
    h = np.arange(1, BANDS + 1, dtype=_U)
    for row in least.reshape(BANDS, ROWS).T:
        h = frames.mixed(h ^ row)
    return h


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of ``SHARE / OF`` or more."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or OF * len(small) < SHARE * len(large):
        return False
    at = np.minimum(large.searchsorted(small), len(large) - 1)
    both = int(np.count_nonzero(large[at] == small))
    return OF * both >= SHARE * (len(a) + len(b) - both)


def print_of(found: np.ndarray) -> int:
    """The SimHash of a shingle set: a bit is 1 if set in over half the hashes."""
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(found), PIECE):
        votes += np.unpackbits(found[i : i + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > len(found), bitorder="little").view(_U)[0])


def bucket_links(prints: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each of a bucket that is linked to others: its index and the least of its group. Pairs already connected are not compared."""
    label = np.arange(len(prints))
    for a, b in simhash.near_pairs(prints, np.zeros(1, dtype=np.int64), RADIUS, PAIRS):
        while True:
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
            if not len(a):
                break
            _, first = np.unique(label[a] * len(label) + label[b], return_index=True)  # one pair for each two groups
            hits = [i for i in first.tolist() if alike(sets[a[i]], sets[b[i]])]
            label = simhash.merged(label, a[hits], b[hits])
            a, b = np.delete(a, first), np.delete(b, first)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketches(rows: DataFrame) -> DataFrame:
    """``(doc_key, check, node, size, buckets)`` for each row; ``size``: bytes of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in frames.slices(batch, "text", TEXTS):
                nodes, sizes, bands = [], [], []
                for t in part.column("text").to_pylist():
                    found = shingles(t)
                    nodes.append(node_of(found))
                    sizes.append(found.nbytes)
                    bands.append(_signed(buckets(found)))
                columns = [part.column(0), part.column(1), pa.array(_signed(np.array(nodes, dtype=_U)), pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_key", "check", "node", "size", "buckets"])

    return rows.select("doc_key", "check", F.coalesce("row.text", F.lit("")).alias("text")).mapInArrow(run, "doc_key bigint, check bigint, node bigint, size bigint, buckets array<bigint>")


def _sets(rows: DataFrame) -> DataFrame:
    """``(node, fp, found)`` for each row: the fingerprint of its shingle set, and the whole set, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in frames.slices(batch, "text", TEXTS):
                found = [shingles(t) for t in part.column(0).to_pylist()]
                columns = [pa.array(_signed(np.array([of(x) for x in found], dtype=_U)), pa.int64()) for of in (node_of, print_of)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "fp", "found"])

    return rows.select(F.coalesce("row.text", F.lit("")).alias("text")).mapInArrow(run, "node bigint, fp bigint, found binary")


def _compared(members: DataFrame) -> DataFrame:
    """``members(bucket, part, node, fp, found)`` to edges ``(u, v)``; each task streams over its sorted parts of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, prints, sets = None, [], [], []

        def settle() -> pa.RecordBatch:
            edges = bucket_links(np.array(prints, dtype=np.int64).view(_U), sets)
            return pa.RecordBatch.from_arrays([pa.array(np.array(nodes, dtype=np.int64)[e]) for e in edges], names=["u", "v"])

        for batch in batches:
            for bucket, part, node, fp, found in (row for piece in frames.slices(batch, "found", TEXTS) for row in zip(*(c.to_pylist() for c in piece.columns), strict=True)):
                if (bucket, part) != now:
                    if len(nodes) > 1:
                        yield settle()
                    now, nodes, prints, sets = (bucket, part), [], [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    prints.append(fp)
                    sets.append(np.frombuffer(found, dtype=_U))
        if len(nodes) > 1:
            yield settle()

    n = frames.partitions(members.sparkSession)
    return members.select("bucket", "part", "node", "fp", "found").repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part", "node").mapInArrow(run, "u bigint, v bigint")


def _in_parts(members: DataFrame) -> DataFrame:
    """``(bucket, part, node)``: each node of ``members(bucket, bytes, node)`` once for each part of its bucket that it belongs to.

    A bucket of ``b`` blocks has a part for each two of them: part ``i * b + j`` holds the blocks i and j, i <= j.
    """
    rows = members.withColumn("blocks", F.ceil(F.col("bytes") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int")
    with_others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.least(x, F.col("own")) * F.col("blocks") + F.greatest(x, F.col("own")))
    return rows.withColumn("own", own).select("bucket", F.explode(with_others).alias("part"), "node")


def _connected(keyed: DataFrame, nodes: DataFrame, members: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(node, component)`` over the links in buckets ``members(bucket, bytes, node)``, and over ``known`` components."""
    wanted = frames.cut(nodes.join(members.select("node").distinct(), "node", "left_semi").select("first.doc_key", "first.check"))
    sets = _sets(keyed.join(wanted, ["doc_key", "check"], "left_semi").dropDuplicates(["doc_key", "check"]))
    edges = _compared(_in_parts(members).join(sets, "node"))
    if known is not None:
        edges = edges.unionByName(known.select(F.col("node").alias("u"), F.col("component").alias("v")))
    return connected_components(edges)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each near-duplicate group the one with the smallest ``doc_id``, null last, then the smallest checksum; one of equal rows."""
    id_ = F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(frames.NULL_ID))
    keyed = frames.packed(docs).withColumns({"doc_key": id_, "check": F.xxhash64(F.coalesce("row.text", F.lit("")))})
    rows = frames.cut(_sketches(keyed))
    order = F.struct(F.col("doc_key") == frames.NULL_ID, "doc_key", "check")
    nodes = frames.cut(rows.groupBy("node").agg(F.min(order).alias("first")))
    frames.let_go(docs.sparkSession)
    met = rows.select("node", "size", F.posexplode("buckets").alias("band", "bucket")).distinct()
    # buckets of the same nodes are one
    sizes = met.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")).where("n > 1")
    alone = frames.cut(sizes.groupBy("n", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("b"), F.max("bytes").alias("bytes")).select("b.band", "b.bucket", "bytes"))
    members = frames.cut(met.select("bucket", "node").join(alone, "bucket"))
    groups = _connected(keyed, nodes, members.where(F.col("band") < FIRST))
    frames.let_go(docs.sparkSession)
    later = members.where(F.col("band") >= FIRST).join(groups, "node", "left").withColumn("now", F.coalesce("component", "node"))
    apart = later.groupBy("bucket").agg(F.min("now").alias("a"), F.max("now").alias("z")).where("a <> z").select("bucket")
    more = frames.cut(members.where(F.col("band") >= FIRST).join(frames.cut(apart), "bucket", "left_semi").select("bucket", "bytes", "node"))
    groups = frames.cut(_connected(keyed, nodes, more, groups))
    frames.let_go(docs.sparkSession)
    named = nodes.join(groups, "node", "left").select(F.coalesce("component", "node").alias("root"), "first")
    kept = frames.cut(named.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_key", "first.check"))
    return keyed.join(kept, ["doc_key", "check"], "left_semi").dropDuplicates(["doc_key", "check"]).select("row.*")
