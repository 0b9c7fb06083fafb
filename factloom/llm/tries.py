"""A trie of conversation prefixes: union-find over the common prefixes of sorted neighbours.

A conversation is one key, ``WIDTH`` bytes a turn: a 128-bit hash of its role and text, and the words of the text. Equal
keys meet first, as packed runs of their ids. The distinct keys are dealt by range and sorted, so that whatever shares a
prefix is adjacent, and cut into blocks. In a block, the edge between two neighbours is as deep as their common prefix; the
edges are taken in descending depth, and the components of a union-find merge: each merge creates a branching node at the
depth of its edge, or attaches to the one that is there. The nodes between two branching nodes have the members of the
lower one.

A node is shared by two blocks only if it lies on the common prefix of one block's last key and the next one's first. A
block's forest is contracted to these: sums and counts such that each node, child, leaf and word counts in the first block
that has it. So the shares of a node, from however many blocks, merge by one aggregation; all other nodes are done in
their block. A task holds one block, and one conversation at the least; a digest of a group's ids, which can be made in
one order only, is made as they stream by.

Defined results: a null role or text is empty, a null turn comes first, rows of one turn are ordered by the hash of role
and text, repeated rows are turns of their own. A null conversation id is an id of its own, before all others, with an
empty decimal form and no other conversation's turns. No conversations, no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import frames

#: Bytes of a turn in a key: 16 of hash, 8 of words.
WIDTH = 24
#: Ids of a group of equal keys that are packed together are alike but for so many low bits.
NEAR = 10
#: Keys, and bytes of keys, of a block.
BLOCK, BLOCK_BYTES = 1 << 14, 1 << 22
#: Nodes that leave a task together.
EMITTED = 1 << 14
#: Conversations of a family share their opening turns: up to ``MOST - 1`` of the first of ``FAMILY``.
FAMILY, MOST = 20, 4

NODES = "open boolean, block bigint, hash binary, parent_hash binary, depth bigint, least bigint, parent_least bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
BLOCKS = "pid int, seq bigint, first binary, last binary, left int, right int, keys array<binary>, n array<bigint>, least array<bigint>, ends array<string>"


def turn_hex(role: str = "role", text: str = "text") -> F.Column:
    """``WIDTH`` bytes of a turn, in hexadecimal."""
    role_, text_ = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    words = F.regexp_count(text_, F.lit(r"[^\x20\x09-\x0D]+"))
    whole = F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_)
    return F.concat(F.substring(F.sha2(whole, 256), 1, 32), F.lpad(F.hex(words.cast("bigint")), 16, "0"))


def keys_of(conversations: DataFrame) -> DataFrame:
    """``(family, conv, key)`` of ``conversations(conv_id, turn, role, text)``, dealt by family."""
    conv = F.coalesce(F.col("conv_id").cast("bigint"), F.lit(frames.NULL_ID))
    family = F.when(F.col("conv_id").isNotNull(), conv - conv % FAMILY).otherwise(conv)
    rows = conversations.select(family.alias("family"), conv.alias("conv"), F.struct(F.col("turn").alias("turn"), turn_hex().alias("at")).alias("t")).repartition("family")
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: t["at"])
    return rows.groupBy("family", "conv").agg(F.unhex(F.array_join(turns, "")).alias("key"))


def with_shared_openings(keys: DataFrame) -> DataFrame:
    """``(conv, key)``: the first turns of a conversation, fewer than ``MOST`` by a checksum of its id, are those of its family's first."""
    opening = F.max(F.when(F.col("conv") == F.col("family"), F.expr(f"substring(key, 1, {WIDTH * (MOST - 1)})"))).over(Window.partitionBy("family"))
    decimal = F.when(F.col("conv") == frames.NULL_ID, "").otherwise(F.col("conv").cast("string"))
    rows = keys.select("conv", "key", opening.alias("opening"), (F.crc32(decimal.cast("binary")) % MOST * WIDTH).cast("int").alias("cut"))
    return rows.select("conv", F.concat(F.coalesce(F.expr("substring(opening, 1, cut)"), F.lit(b"")), F.expr("substring(key, cut + 1)")).alias("key"))


def common(a: bytes, b: bytes) -> int:
    """Turns of the longest common prefix of two keys."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of distinct keys from sorted ``(key, bucket, n, least, ids)``. ``left`` and ``right``: turns shared with the
    neighbours of the block in its partition, null at the partition's ends."""
    pid, seq, left = TaskContext.get().partitionId(), 0, None
    held: list[tuple[bytes, int, int, str]] = []
    size = 0

    def block(after: bytes | None) -> pa.RecordBatch:
        keys, n, least, ends = map(list, zip(*held, strict=True))
        row = [pid, seq, keys[0], keys[-1], left, None if after is None else common(keys[-1], after), keys, n, least, ends]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    key, n, least, digest = None, 0, 0, hashlib.sha256()
    for batch in batches:
        for k, m, low, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "least", "ids")), strict=True):
            if k == key:
                digest.update(b"," + ids.encode())
                n += m
                continue
            if key is not None:
                held.append((key, n, least, digest.hexdigest()))
                size += len(key)
                if len(held) == BLOCK or size >= BLOCK_BYTES:
                    yield block(k)
                    seq, left, held, size = seq + 1, common(key, k), [], 0
            key, n, least, digest = k, m, low, hashlib.sha256(ids.encode())
    if key is not None:
        held.append((key, n, least, digest.hexdigest()))
        yield block(None)


def sorted_blocks(keys: DataFrame) -> DataFrame:
    """The distinct keys of ``keys(conv, key)`` in order, a row for each block."""
    ids = F.sort_array(F.collect_list("conv"))
    near = keys.groupBy("key", F.shiftright("conv", NEAR).alias("bucket")).agg(ids.alias("ids"))
    text = F.array_join(F.transform("ids", lambda x: F.when(x == frames.NULL_ID, "").otherwise(x.cast("string"))), ",")
    rows = near.select("key", "bucket", F.size("ids").cast("bigint").alias("n"), F.element_at("ids", 1).alias("least"), text.alias("ids"))
    rows = rows.repartitionByRange(frames.partitions(keys.sparkSession), "key").sortWithinPartitions("key", "bucket")
    return frames.cut(rows.mapInArrow(_blocks, BLOCKS))


def forest(keys: list[bytes]) -> tuple[list[int], list[list[int]], int]:
    """``(depths, children, top)`` of the nodes over sorted distinct keys at which a key ends (node i is that of key i) or
    branches part, by a union of neighbours in descending depth of their common prefixes."""
    depth, kids = [len(k) // WIDTH for k in keys], [[] for _ in keys]
    edges = [common(a, b) for a, b in zip(keys, keys[1:], strict=False)]
    up, top = list(range(len(keys))), list(range(len(keys)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for e in sorted(range(len(edges)), key=lambda i: -edges[i]):
        a, b, d = find(e), find(e + 1), edges[e]
        x, y = top[a], top[b]
        if depth[x] == d == depth[y]:
            kids[x] += kids[y]
        elif depth[x] == d:
            kids[x].append(y)
        elif depth[y] == d:
            kids[y].append(x)
            x = y
        else:
            depth.append(d)
            kids.append([x, y])
            x = len(depth) - 1
        up[b], top[a] = a, x
    return depth, kids, top[find(0)]


def nodes_of(keys: list[bytes], n: list[int], least: list[int], ends: list[str], left: int, right: int) -> Iterator[tuple]:
    """Rows of ``NODES``, without the block, of one that shares ``left`` turns with the keys before it and ``right`` with
    those after it; -1 where nothing stands there."""
    depth, kids, top = forest(keys)
    order, above = [top], {top: -1}
    for x in order:
        above.update((k, x) for k in kids[x])
        order += kids[x]
    high = lambda x: depth[above[x]] if above[x] >= 0 else -1  # noqa: E731  the depth that the nodes over x end below
    words = [np.frombuffer(k, ">u8").reshape(-1, 3)[:, 2].tolist() for k in keys]
    more = len(depth) - len(keys)
    members, smallest, leaves, low, total, children = [*n, *[0] * more], [*least, *[1 << 63] * more], *([0] * len(depth) for _ in range(4))
    first, last = [*range(len(keys)), *[len(keys)] * more], [*range(len(keys)), *[-1] * more]
    early = lambda x, d: first[x] == 0 and d <= left  # noqa: E731  an earlier block has the node too
    late = lambda x, d: last[x] == len(keys) - 1 and d <= right
    said = lambda x, d: words[first[x]][d - 1] if d > 0 else 0
    spared = lambda x, d: (members[x] - (not early(x, d))) * said(x, d)
    for x in reversed(order):  # children before parents
        for k in kids[x]:
            members[x] += members[k]
            leaves[x] += leaves[k]
            low[x] += total[k]
            children[x] += not early(k, depth[x] + 1)
            smallest[x], first[x], last[x] = min(smallest[x], smallest[k]), min(first[x], first[k]), max(last[x], last[k])
        if not kids[x] and not late(x, depth[x]):
            leaves[x] = 1
        low[x] += spared(x, depth[x])
        total[x] = low[x] + sum(spared(x, d) for d in range(high(x) + 1, depth[x]))

    border: dict[int, list[bytes]] = {}  # hashes of the prefixes of the first and the last key that other blocks share
    for key, most in ((0, left), (len(keys) - 1, right)):
        state, known = hashlib.blake2b(digest_size=16), border.setdefault(key, [])
        for d in range(most + 1):
            state.update(keys[key][(d - 1) * WIDTH : d * WIDTH] if d else b"")
            known[d : d + 1] = [state.digest()]
    name = lambda x, d: border[0][d] if early(x, d) else border[len(keys) - 1][d] if late(x, d) else None
    for x in order:
        saved = low[x]
        for d in range(depth[x], high(x), -1):
            if d < depth[x]:
                saved += spared(x, d)
            own = name(x, d)
            parent = x if d - 1 > high(x) else above[x]
            over = None if d == 0 else name(parent, d - 1)
            below = children[x] if d == depth[x] else int(not early(x, d + 1))
            yield own is not None, own, over, d, smallest[x], None if d == 0 or over else smallest[parent], members[x], below, leaves[x], saved, ends[x] if x < len(keys) and d == depth[x] else None


def _node_rows(borders: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in NODES.split(", ")]
        kinds = {"boolean": pa.bool_(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        kinds = [kinds[c.split()[1]] for c in NODES.split(", ")]
        for batch in batches:
            for b in batch.to_pylist():
                left, right = (borders[b["pid"]][i] if b[side] is None else b[side] for i, side in enumerate(("left", "right")))
                block, rows = b["pid"] << 32 | b["seq"], nodes_of(b["keys"], b["n"], b["least"], b["ends"], left, right)
                while own := list(islice(rows, EMITTED)):
                    columns = list(zip(*((r[0], block, *r[1:]) for r in own), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def trie(keys: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of each node over ``keys(conv, key)``.

    ``conv_id`` is a node's smallest member, ``saved_tokens`` the words of a subtree's nodes times their members but one.
    """
    blocks = sorted_blocks(keys)
    edge = blocks.where("left IS NULL OR right IS NULL").select("pid", F.when(F.col("left").isNull(), F.col("first")).alias("first"), F.when(F.col("right").isNull(), F.col("last")).alias("last"))
    edge = sorted(edge.groupBy("pid").agg(F.max("first").alias("first"), F.max("last").alias("last")).collect())  # two keys a partition
    shared = [common(a.last, b.first) for a, b in zip(edge, edge[1:], strict=False)]
    borders = {e.pid: (x, y) for e, x, y in zip(edge, [-1, *shared], [*shared, -1], strict=False)}
    rows = frames.cut(blocks.mapInArrow(_node_rows(borders), NODES))
    open_, done = rows.where("open"), rows.where("NOT open")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = frames.cut(open_.groupBy("hash").agg(F.max("parent_hash").alias("parent_hash"), F.max("depth").alias("depth"), F.min("least").alias("least"), *sums, F.max("ends_sha256").alias("ends_sha256")))
    named = merged.select(F.col("hash").alias("parent_hash"), F.col("least").alias("parent_least"))
    top = merged.join(named, "parent_hash", "left")
    inside = open_.select("block", F.col("hash").alias("parent_hash")).join(named, "parent_hash")  # a block's own few, so that no parent is a hot key
    under = done.where("parent_hash IS NOT NULL").drop("parent_least").join(inside, ["block", "parent_hash"])
    out = [F.nullif(F.col(c), F.lit(frames.NULL_ID)).alias(n) for c, n in (("least", "conv_id"), ("parent_least", "parent_conv_id"))]
    out = [out[0], "depth", out[1], "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")]
    return done.where("parent_hash IS NULL").select(*out).unionByName(under.select(*out)).unionByName(top.select(*out))


def from_conversations(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that open like the first of their family."""
    return trie(with_shared_openings(keys_of(conversations)))


_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda s, c: list_reduce(list_concat([xor(s, c)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda d, z: xor(d >> 1, (d & 1) * 3988292384))), 4294967295::BIGINT)"""

ORACLE = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} AS m FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % {MOST} AS h FROM (SELECT DISTINCT conv_id FROM t)),
a AS (SELECT c.conv_id, 0 AS part, t.i, t.m FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {FAMILY} AND t.i <= c.h
  UNION ALL SELECT c.conv_id, 1, t.i, t.m FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
k AS (SELECT c.conv_id, coalesce(list(a.m ORDER BY part, i) FILTER (WHERE a.m IS NOT NULL), []) AS ms FROM c LEFT JOIN a USING (conv_id) GROUP BY ALL),
p AS (SELECT conv_id, d AS depth, sha256(ms[1:d]::VARCHAR) AS node, CASE WHEN d > 0 THEN sha256(ms[1:d - 1]::VARCHAR) END AS parent, d = len(ms) AS ends,
  CASE WHEN d > 0 THEN len(regexp_extract_all(ms[d].x, '[^ \t-\r]+')) ELSE 0 END AS words FROM (SELECT *, unnest(range(len(ms) + 1)) AS d FROM k)),
n AS (SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY node, depth),
k2 AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
s AS (SELECT p.node, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (WHERE k2.node IS NULL) AS leaves
  FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN k2 ON k2.node = n.node GROUP BY p.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k2.n_children, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (node) LEFT JOIN n up ON up.node = n.parent LEFT JOIN k2 ON k2.node = n.node
"""
