"""Token ids of a public tokenizer in a compact binary table, and back.

The file format is a Parquet table with one row for each segment of about a million ids, in ascending document order:
``shard, segment`` (the order), ``first`` (ids of the shard before it), ``n``, ``docs`` (packed 64-bit document ids),
``nulls`` (packed bits: the id is null), ``sizes`` (packed 32-bit counts), ``freqs`` (the frequency table that all its
blocks share) and ``blocks`` (see :mod:`factloom.llm.rans`). Spark's writer commits it, so lost tasks leave nothing behind,
and any reader may decode any segment, block or stripe alone.

Defined results: a null text is empty and holds the end id only. Rows of one ``doc_id`` follow each other by text; null
ids come first. An added token's string in a text becomes its one id, as by the library's default.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import frames, rans

END = 0
SEGMENT = 1 << 20
#: Distinct parts of texts, and words of them, whose ids one worker keeps at hand.
PARTS, WORDS = 300_000, 500_000
#: Bytes of text worked on at once.
PIECE = 8 << 20

SCHEMA = "shard int, segment int, first bigint, n bigint, docs binary, nulls binary, sizes binary, freqs binary, blocks array<struct<n int, rows int, states binary, offsets binary, words binary, crc bigint, value_crc bigint>>"

_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Where a byte-level tokenizer cuts texts before it merges (fixed values, of its public pattern), and the characters that all
#: versions of Unicode give to the same classes of it.
_WORD = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PLAIN = re.compile("[\n -~\u00c0-\u024f]*")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _sizes(texts: list[str]) -> np.ndarray:
    """Bytes of each of ``texts``."""
    return np.diff(np.frombuffer(pa.array(texts, pa.string()).buffers()[1], np.int32)[: len(texts) + 1]) if texts else np.zeros(0, np.int64)


class Encoder:
    """Ids of whole texts, 16 bits each.

    The tokenizer never joins what stands before a single space between two visible characters with what follows, so
    texts are cut there, and the ids of a part seen before are looked up. A part not seen is cut further at the
    tokenizer's own word borders, and only words not seen go through the tokenizer, many of them in one call. A
    text that may hold an added token goes through it whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.sizes = np.zeros(1 << 16, dtype=np.int64)  # bytes of each token: its name has a character for each
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        self.by_words = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec["normalizer"]
        self.parts: dict[str, bytes] = {}  # what follows a space, without it
        self.words: dict[str, bytes] = {"": b""}  # whatever the tokenizer may be given alone
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.names = [""] if names and self.tokenizer.normalizer else names  # a normalizer could make one out of other characters

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of new ``words``. Those in which white space is at most one space in front share calls: the tokenizer cuts before the space."""
        alone, joint, lines = [], [], []
        for i, w in enumerate(words):
            seen = w[1:] if w[0] == " " else w
            whole = bool(seen) and not (seen[0].isspace() or seen[-1].isspace())
            (joint if whole and w[0] == " " else lines if whole and self.by_words else alone).append(i)
        out: list[bytes] = [b""] * len(words)
        for i, ids in zip(alone, self._ids([words[i] for i in alone]), strict=True):
            out[i] = ids.tobytes()
        for group, mark in ((joint, ""), (lines, "\n")):  # a line feed between two visible characters is a token of its own
            named = [words[i] for i in group]
            runs = range(0, len(group), 256)
            found = self._ids([mark.join(named[k : k + 256]) for k in runs])
            sizes = _sizes(named) + len(mark)
            for k, ids in zip(runs, found, strict=True):
                last = 2 * (np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(sizes[k : k + 256]) - len(mark)) + 1)
                raw, begin = ids.tobytes(), np.append(0, last[:-1] + 2 * len(mark))
                for i, x, y in zip(group[k : k + 256], begin.tolist(), last.tolist(), strict=True):
                    out[i] = raw[x:y]
        room = max(0, WORDS - len(self.words))  # the first to come stay
        self.words.update(zip(words[:room], out, strict=False))
        return out

    def _joined(self, words: list[str]) -> tuple[bytes, np.ndarray]:
        """The ids of all ``words`` one after another, and where each ends, in bytes."""
        kinds = pa.array(words, pa.string()).dictionary_encode()
        names = kinds.dictionary.to_pylist()
        found = list(map(self.words.get, names))
        new = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(new, self._learn([names[i] for i in new]), strict=True):
            found[i] = x
        ids = pa.array(found, pa.binary()).take(kinds.indices)
        return (ids.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), np.frombuffer(ids.buffers()[1], np.int32)[1 : len(words) + 1]

    def _looked_up(self, texts: list[str]) -> list[bytes]:
        """The ids of each of ``texts``, which the tokenizer may be given alone."""
        lists = list(map(self._cut, texts))
        raw, ends = self._joined(list(chain.from_iterable(lists)))
        ends = np.append(0, ends)[np.cumsum([0, *map(len, lists)])].tolist()
        return [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def _spaced(self, parts: list[str]) -> list[bytes]:
        """The ids of each of ``parts`` with a space in front; white space stands at no end of them."""
        line = "".join([" " + p for p in parts])
        if not (self.by_words and _PLAIN.fullmatch(line)):
            return self._looked_up([" " + p for p in parts])
        words = _WORD.findall(line)
        raw, ends = self._joined(words)
        last = np.searchsorted(np.cumsum(_sizes(words)), np.cumsum(_sizes(parts) + 1))
        ends = [0, *ends[last].tolist()]
        return [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def _cut(self, text: str) -> list[str]:
        """Words of a text, or of a part with its space, that the tokenizer may be given alone."""
        if self.by_words and _PLAIN.fullmatch(text):
            return _WORD.findall(text)
        head, *rest = _SPACE.split(text)
        return [head, *[" " + p for p in rest]]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each of ``texts``, a string array without nulls."""
        if not self.names:
            return self._encode(texts)
        holds = np.zeros(len(texts), dtype=bool)
        for name in self.names:
            holds |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        if not holds.any():
            return self._encode(texts)
        self.tokenizer.encode_special_tokens = False
        found = iter(self._ids(texts.filter(pa.array(holds)).to_pylist()))
        self.tokenizer.encode_special_tokens = True
        rest = iter(self._encode(texts.filter(pa.array(~holds))))
        return [next(found).tobytes() if h else next(rest) for h in holds.tolist()]

    def _encode(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        parts = cut.flatten()
        kinds = parts.dictionary_encode()
        which = kinds.indices.to_numpy()
        ids = pa.array(self._parts(kinds.dictionary.to_pylist()), pa.binary())
        joined = ids.take(kinds.indices)
        raw, ends = (joined.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), np.frombuffer(joined.buffers()[1], np.int32)[joined.offset :]
        heads = parts.take(pa.array(bounds[:-1])).to_pylist()
        first = self._looked_up(heads)
        tails = zip(ends[bounds[:-1] + 1].tolist(), ends[bounds[1:]].tolist(), strict=True)
        out = [h + raw[i:j] for h, (i, j) in zip(first, tails, strict=True)]
        odd = np.array([h[-1:].isspace() for h in heads]) & (np.diff(bounds) > 1)
        if ids.null_count:
            at = np.flatnonzero(np.asarray(ids.is_null())[which])
            text = np.searchsorted(bounds, at, side="right") - 1
            odd[text[at > bounds[text]]] = True
        odd = np.flatnonzero(odd).tolist()
        for i, ids_ in zip(odd, self._looked_up([texts[i].as_py() for i in odd]), strict=True):
            out[i] = ids_
        return out

    def _parts(self, parts: list[str]) -> list[bytes | None]:
        """Ids of each part with its space; None where white space stands at an end, so that the text can't be cut there."""
        out = list(map(self.parts.get, parts))
        new = [i for i, x in enumerate(out) if x is None and (p := parts[i]) and not (p[0].isspace() or p[-1].isspace())]
        named = [parts[i] for i in new]
        plain = list(map(_PLAIN.fullmatch, named)) if self.by_words else [None] * len(new)
        for ok in (True, False):
            which = [k for k, m in enumerate(plain) if (m is not None) == ok]
            for k, ids in zip(which, self._spaced([named[k] for k in which]), strict=True):
                out[new[k]] = ids
        room = max(0, PARTS - len(self.parts))
        self.parts.update((parts[i], out[i]) for i in new[:room])
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder, kept from task to task with the pieces it knows."""
    return Encoder(path)


def segments(batches: Iterator[pa.RecordBatch], path: str, shard: int) -> Iterator[pa.RecordBatch]:
    """Rows of the format from sorted ``(doc_id, text)`` batches."""
    encoder, kind = encoder_of(path), _arrow_schema()
    docs: list[int | None] = []
    held: list[bytes] = []
    state = {"segment": 0, "first": 0, "held": 0}

    def flush() -> pa.RecordBatch:
        values = np.frombuffer(b"".join(held), dtype=np.uint16)
        t = rans.table(values)
        row = {
            "shard": shard, "segment": state["segment"], "first": state["first"], "n": len(values),
            "docs": np.array([0 if d is None else d for d in docs], dtype="<i8").tobytes(), "nulls": np.packbits([d is None for d in docs]).tobytes(),
            "sizes": np.array([len(h) // 2 for h in held], dtype="<u4").tobytes(), "freqs": t.pack(), "blocks": rans.encode(values, t),
        }
        state.update(segment=state["segment"] + 1, first=state["first"] + len(values), held=0)
        docs.clear()
        held.clear()
        return pa.RecordBatch.from_pylist([row], schema=kind)

    end = np.uint16(END).tobytes()
    for batch in batches:
        for part in frames.slices(batch, "text", PIECE):
            for doc, raw in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text")), strict=True):
                docs.append(doc)
                held.append(raw + end)
                state["held"] += len(raw) // 2 + 1
                if state["held"] >= SEGMENT:
                    yield flush()
    if docs:
        yield flush()


def _arrow_schema() -> pa.Schema:
    block = pa.struct([("n", pa.int32()), ("rows", pa.int32()), *((k, pa.binary()) for k in ("states", "offsets", "words")), ("crc", pa.int64()), ("value_crc", pa.int64())])
    return pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), *((k, pa.binary()) for k in ("docs", "nulls", "sizes", "freqs")), ("blocks", pa.list_(block))])


def write_ids(docs: DataFrame, out: str, tokenizer: str) -> None:
    """Encode every text of ``docs(doc_id, text)`` into a table at ``out``. ``tokenizer``: a file that every worker can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from segments(batches, tokenizer, TaskContext.get().partitionId())

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(2 * frames.partitions(docs.sparkSession), F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    rows.mapInArrow(run, SCHEMA).write.option("parquet.compression", "uncompressed").option("compression", "uncompressed").parquet(out)


def decoded(row: dict) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document of a segment and its ids."""
    values = rans.decode(row["blocks"], rans.Table.unpack(row["freqs"]))
    sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
    if int(sizes.sum()) != row["n"] or len(values) != row["n"]:
        raise rans.DamagedBlock(f"shard {row['shard']}, segment {row['segment']}: {len(values)} ids, {row['n']} expected")
    none = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(sizes))
    at = 0
    for doc, gone, size in zip(np.frombuffer(row["docs"], "<i8").tolist(), none.tolist(), sizes.tolist(), strict=True):
        yield None if gone else doc, values[at : at + size]
        at += size


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` of a table of :func:`write_ids`."""
    return _read(spark, path, "doc_id bigint, start bigint, ids array<int>", lambda doc, start, ids: (doc, start, ids.astype(np.int32)))


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of a table of :func:`write_ids`, from the decoded ids."""
    return _read(spark, path, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", lambda doc, start, ids: (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))


def _read(spark: SparkSession, path: str, schema: str, made) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                out = [made(doc, row["before"] + row["first"] + at, ids) for (doc, ids), at in _placed(decoded(row))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    table = spark.read.schema(SCHEMA).parquet(path)
    sizes = sorted((r["shard"], r["n"]) for r in table.groupBy("shard").agg(F.sum("n").alias("n")).collect())  # one row for each task that wrote
    before, total = [], 0
    for shard, n in sizes:
        before.append((shard, total))
        total += n
    offsets = spark.createDataFrame(before, "shard int, before bigint")
    return table.join(F.broadcast(offsets), "shard").mapInArrow(run, schema)


def _placed(docs: Iterator[tuple[int | None, np.ndarray]]) -> Iterator[tuple[tuple[int | None, np.ndarray], int]]:
    at = 0
    for doc, ids in docs:
        yield (doc, ids), at
        at += len(ids)
