"""Quartile bucket digests: locality-sensitive fingerprints of whole documents.

A digest counts hashed byte triplets in buckets, writes for each bucket the quartile its count falls in, and adds
the length and the skew of the counts. Two digests are compared by a difference score with a fixed upper bound.

Defined results: a null text is an empty text. Equal texts have equal digests. A text of fewer than three bytes has no
triplet: its digest tells its length and its checksum only.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import frames

BUCKETS = 256
#: The two places of a window of five bytes that make a triplet with its first byte.
PLACES = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: Bytes worked on at once, so that very long texts need no more memory.
PIECE = 1 << 18
#: The difference at which two digests count as unrelated; unrelated quartile codes differ by 1.625 a bucket on average.
BOUND = 416

_TABLES = (frames.mixed(np.arange(1, 5 * 256 + 1, dtype=np.uint64)) >> np.uint64(56)).astype(np.uint8).reshape(5, 256)


def bucket_counts(data: bytes) -> np.ndarray:
    """How many byte triplets of ``data`` fall in each bucket."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    whole = np.frombuffer(data, dtype=np.uint8)
    for first in range(0, max(1, len(whole) - 2), PIECE):
        b = whole[first : first + PIECE + 4]
        last = first + PIECE >= len(whole) - 2
        scrambled = [t[b] for t in _TABLES]
        hashed = []
        for kind, (i, j) in enumerate(PLACES):
            n = len(b) - j if last else min(PIECE, len(b) - j)
            if n > 0:
                hashed.append(scrambled[0][:n] ^ scrambled[i][i : i + n] ^ scrambled[j][j : j + n] ^ np.uint8(37 * kind))
        if hashed:
            counts += np.bincount(np.concatenate(hashed), minlength=BUCKETS)
    return counts


def digest(data: bytes) -> str:
    """Checksum, length, quartile ratios and a two-bit code for each bucket, in hexadecimal."""
    counts = bucket_counts(data)
    q1, q2, q3 = (int(x) for x in np.partition(counts, (63, 127, 191))[[63, 127, 191]])
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    body = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    size = 0 if not data else min(255, 1 + round(16 * np.log2(len(data))))
    ratios = [min(15, 16 * q // max(1, q3)) for q in (q1, q2)]
    return f"{zlib.crc32(data) & 255:02x}{size:02x}{ratios[0]:x}{ratios[1]:x}" + body.astype(np.uint8).tobytes().hex()


def difference(a: str, b: str) -> int:
    """0 for equal digests; at most ``6 * BUCKETS + 81``."""
    if a == b:
        return 0
    x, y = (np.frombuffer(bytes.fromhex(s), dtype=np.uint8) for s in (a, b))
    p, q = ((s[3:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8)) & 3 for s in (x, y))
    far = np.abs(p.astype(np.int16) - q)
    score = int(far.sum() + 3 * (far == 3).sum())
    score += min(50, abs(int(x[1]) - int(y[1])))
    score += abs(int(x[2] >> 4) - int(y[2] >> 4)) + abs(int(x[2] & 15) - int(y[2] & 15))
    return score + int(x[0] != y[0])


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 from a difference of ``BOUND`` on."""
    return 1.0 - min(1.0, difference(a, b) / BOUND)


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the digest of each whole text; every other column stays."""

    @F.pandas_udf("string")
    def digests(texts):
        return texts.map(lambda t: digest((t or "").encode()))

    return docs.withColumn(out, digests(F.col(text)))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal ``docs`` in blocks of neighbouring keys, each followed by the first row of the next block.

    The order is by descending key, null last, then by text, and after the last row comes the first. Returns
    ``block, halo, key, text``; where ``halo`` is 1 the row only serves as the neighbour of the row before it. Cuts come
    from quantiles of the keys, so a block holds a bounded share of the rows, and one row for each block travels twice.
    """
    spark = docs.sparkSession
    wanted = 4 * frames.partitions(spark)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.select("key").approxQuantile("key", [i / wanted for i in range(1, wanted)], 0.25 / wanted)
    cuts = sorted(set(found))
    place = cuts and Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="at", outputCol="bucket", handleInvalid="keep")

    def dealt(df: DataFrame) -> DataFrame:
        if not cuts:
            return df.withColumn("block", F.lit(0))
        at = F.coalesce(F.col("key").cast("double"), F.lit(float("-inf")))
        return place.transform(df.withColumn("at", at)).withColumn("block", F.lit(len(cuts)) - F.col("bucket").cast("int")).drop("at", "bucket")

    firsts = sorted((r["block"], r["key"]) for r in dealt(rows.select("key")).groupBy("block").agg(F.max("key").alias("key")).collect())
    halos = [(firsts[(i + 1) % len(firsts)][1], block) for i, (block, _) in enumerate(firsts)]
    halo = spark.createDataFrame(halos, "key bigint, target int").groupBy("key").agg(F.collect_list("target").alias("targets"))
    sent = (
        dealt(rows)
        .join(F.broadcast(halo.withColumnRenamed("key", "first")), F.col("key").eqNullSafe(F.col("first")), "left")
        .withColumn("to", F.concat(F.array(F.struct("block", F.lit(0).alias("halo"))), F.coalesce(F.transform("targets", lambda t: F.struct(t.alias("block"), F.lit(1).alias("halo"))), F.array())))
        .select("key", "text", F.explode("to").alias("to"))
        .select("to.block", "to.halo", "key", "text")
    )
    return sent.repartition(frames.partitions(spark), "block").sortWithinPartitions("block", "halo", F.desc_nulls_last("key"), "text")


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Digest every text and its edited text: the last third replaced by the head of the next document.

    One row for each row of ``docs``. The next document is the one of the next smaller ``doc_id``; rows of one
    ``doc_id`` follow each other by text, a null id comes last, and a single document is its own next one.
    """
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    fields = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            out = []
            for block, halo, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if halo and before is None:  # another row of the same key
                    continue
                print_ = digest(text.encode())
                if before is not None and before[0] == block:
                    _, own, whole, own_print = before
                    third = len(whole) // 3
                    edited = (whole[: len(whole) - third] + text[:third]).encode()
                    edited_print = digest(edited)
                    out.append((own, len(whole), hashlib.sha256(edited).hexdigest(), own_print, edited_print, likeness(own_print, edited_print), likeness(own_print, print_)))
                before = None if halo else (block, key, text, print_)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    return with_next(docs).mapInArrow(run, schema)
