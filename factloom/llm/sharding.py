"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child of the node that it has come to draws an exponential
waiting time from a hash of the key and the child's path, divided by the summed weight of the shards below it, and the child
with the shortest time wins: a row takes as many hashes as its nodes have children, not one for every shard. A child's draw
depends on its own weight alone, so when weights below a node change, keys only move into or out of that node at its
level, and inside it at the next: what lies beside the changed path keeps its keys apart from those that move into or out of
it. A shard that is added opens a region and a rack of its own, so that it takes keys only into itself.

Defined results: rows of one ``doc_id`` go to one shard; a null id is a key of its own. A null text has no bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import frames

SHARDS, RACK, REGION = 40, 5, 10
#: Parts of a shard that are numbered apart.
CHUNKS = 256
OVERHEAD = 16

Leaf = tuple[str, str, int, float]


def tree(shards: int, rack: int = RACK, region: int = REGION) -> list[Leaf]:
    """``(region, rack, shard, weight)`` of equal shards, ``rack`` in a rack and ``region`` in a region."""
    return [(f"region{s // region}", f"rack{s // rack}", s, 1.0) for s in range(shards)]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """``leaves`` with one more shard, in a region of its own."""
    new = max((leaf[2] for leaf in leaves), default=-1) + 1
    return [*leaves, (f"own{new}", f"own{new}", new, weight)]


def _drawn(key: Column, nodes: list[tuple[str, float]]) -> Column:
    """The index of the node ``(path, weight)`` with the shortest waiting time."""

    def wait(node: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, node["path"]), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / node["weight"]).alias("t"), node["at"].alias("at"))

    made = F.array(*(F.struct(F.lit(path).alias("path"), F.lit(float(w)).alias("weight"), F.lit(i).alias("at")) for i, (path, w) in enumerate(nodes)))
    return F.array_min(F.transform(made, wait))["at"]


def shard_of(df: DataFrame, key: Column, leaves: list[Leaf], out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row's ``key``, by one draw a level."""
    below: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in leaves:
        if leaf[3] > 0:
            below.setdefault(leaf[0], {}).setdefault(leaf[1], []).append(leaf)
    if not below or len({leaf[2] for leaf in leaves}) < len(leaves):
        raise ValueError("shards must be there and differ")
    weight = lambda own: sum(leaf[3] for leaf in own)

    def chosen(at: Column, children: list[Column]) -> Column:
        """The column of the child that was drawn; the others are not computed."""
        found = F.when(at == 0, children[0])
        for i, child in enumerate(children[1:], 1):
            found = found.when(at == i, child)
        return found

    def in_rack(path: str, own: list[Leaf]) -> Column:
        drawn = F.array(*(F.lit(leaf[2]) for leaf in own))
        return F.get(drawn, _drawn(key, [(f"{path}/{leaf[2]}", leaf[3]) for leaf in own])) if len(own) > 1 else F.lit(own[0][2])

    df = df.withColumn("s_region", _drawn(key, [(r, sum(map(weight, racks.values()))) for r, racks in below.items()]))
    racks = [_drawn(key, [(f"{r}/{rack}", weight(own)) for rack, own in own_racks.items()]) for r, own_racks in below.items()]
    df = df.withColumn("s_rack", chosen(F.col("s_region"), racks))
    shards = [chosen(F.col("s_rack"), [in_rack(f"{r}/{rack}", own) for rack, own in own_racks.items()]) for r, own_racks in below.items()]
    return df.withColumn(out, chosen(F.col("s_region"), shards)).drop("s_region", "s_rack")


def with_slots(df: DataFrame, shard: str = "shard") -> DataFrame:
    """``df(doc_id, ...)`` with ``slot``, gapless from 0 in each shard.

    Rows are numbered inside each chunk of a shard, by id and text, after the counts of the chunks before it: at most ``CHUNKS`` counts a
    shard, so no task numbers a whole shard.
    """
    others = [c for c in ("doc_id", "text_crc32") if c in df.columns]
    df = df.withColumn("s_chunk", F.pmod(F.xxhash64(F.lit("slot"), *others), F.lit(CHUNKS)).cast("int"))
    counts = df.groupBy(shard, "s_chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(shard).orderBy("s_chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(shard, "s_chunk", F.coalesce(before, F.lit(0)).alias("s_before"))
    inside = Window.partitionBy(shard, "s_chunk").orderBy(*[c for c in df.columns if c not in (shard, "s_chunk")])
    numbered = df.withColumn("s_inside", F.row_number().over(inside) - 1).join(F.broadcast(offsets), [shard, "s_chunk"])
    return numbered.withColumn("slot", (F.col("s_before") + F.col("s_inside")).cast("bigint")).drop("s_chunk", "s_before", "s_inside")


def placed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row of ``docs(doc_id, text)``."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(frames.NULL_ID))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = shard_of(rows, key, tree(shards))
    rows = shard_of(with_slots(rows), key, grown(tree(shards)), "grown_shard")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
