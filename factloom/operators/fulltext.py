"""A positional inverted index in segments, and boolean patterns over it.

A posting is ``(token, key, tf, doc_len, positions)``; a position holds the number of its column in the bits above
``COLUMN``. Counts and positions are made inside a batch of rows, so only the sort by token moves them. The empty token has
one posting for each row: the length of every row, empty ones too.

An index folder has segments, each with postings in a folder for each bucket of tokens, sorted by token, and the keys it
replaces or deletes; and manifests, the newest of which names the segments in use. A change writes one small segment and a
manifest. A posting counts if no later segment has its key. Segments of like size are merged, the newest first, so their
number grows with the logarithm of the corpus. There is one writer at a time; readers keep the manifest they began with.

Patterns are those of a well-known embedded text index: words, ``"phrases"``, ``a + b``, ``prefix*``, ``^first``, ``NEAR(a b, n)``,
``column : x``, ``{a b} : x``, ``- column : x``, ``AND``, ``OR``, ``NOT``, parentheses, and words side by side, which must all occur.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from factloom.functions import text as t

K1, B = 1.2, 0.75
BUCKETS = 64
COLUMN = 40
#: Tokens that are counted together in a task.
TOGETHER = 1 << 20
#: So many of the newest segments of like size are merged.
FANOUT = 4


# postings


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``TOGETHER`` tokens, or one row."""
    ends = np.cumsum(sum(np.asarray(c.value_lengths()) for c in batch.columns[1:]))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + TOGETHER, side="right")))
        yield batch.slice(first, last - first)
        first = last


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _slices(whole) if whole.num_rows else ():
            row, place, words = [], [], []
            for i, column in enumerate(batch.columns[1:]):
                sizes = np.asarray(column.value_lengths()).astype(np.int64)
                row.append(np.repeat(np.arange(len(sizes)), sizes))
                place.append(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + (i << COLUMN))
                words.append(column.flatten())
            coded = pa.concat_arrays(words).dictionary_encode()
            row, place = np.concatenate(row), np.concatenate(place)
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            length = np.bincount(row, minlength=batch.num_rows).astype(np.int32)
            order = np.lexsort((place, code, row))
            row, code, place = row[order], code[order], place[order]
            begin = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(code) != 0)])) if len(row) else np.zeros(0, np.int64)
            tf = np.diff(np.append(begin, len(row)))
            of = np.concatenate([row[begin], np.arange(batch.num_rows)])
            token = pa.concat_arrays([coded.dictionary.take(pa.array(code[begin])), pa.array([""] * batch.num_rows, pa.string())])
            offsets = np.concatenate([begin, np.full(batch.num_rows + 1, len(row))]).astype(np.int32)
            positions = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place, pa.int64()))
            tf = pa.array(np.concatenate([tf, np.zeros(batch.num_rows, np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), token, pa.array(length[of]), tf, positions], names=["key", "token", "doc_len", "tf", "positions"])


def postings(rows: DataFrame, key: str, *columns: str, cut: Callable[[Column], Column] = t.index_tokens) -> DataFrame:
    """``(key, token, doc_len, tf, positions)`` of all the columns together, and for each row one of the empty token.

    ``cut`` makes the tokens of a text: words, or for searches inside of names :func:`factloom.functions.text.trigrams`.
    """
    tokens = rows.select(F.col(key).alias("key"), *(cut(F.col(c)).alias(f"t{i}") for i, c in enumerate(columns)))
    return tokens.mapInArrow(_counted, StructType([tokens.schema["key"], *StructType.fromDDL("token string, doc_len int, tf bigint, positions array<bigint>")]))


# segments


@dataclass(frozen=True)
class Segment:
    seq: int
    name: str
    docs: int
    """Rows whose newest version it has."""
    tokens: int
    """Of those rows."""
    size: int
    """Rows and deleted keys it was written with."""


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    columns: tuple[str, ...]
    version: int
    segments: tuple[Segment, ...]
    signature: str = ""

    @property
    def n(self) -> int:
        return sum(s.docs for s in self.segments)

    @property
    def mean_len(self) -> float:
        return sum(s.tokens for s in self.segments) / self.n if self.n else 0.0

    def part(self, segment: Segment, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{segment.name}/{name}")

    def postings(self, chosen: Column) -> DataFrame:
        """The postings that ``chosen`` picks and no later segment has replaced: ``(token, key, tf, doc_len, positions)``."""
        parts, *later = (self.part(s, "postings").where(chosen).withColumn("seq", F.lit(s.seq)) for s in self.segments)
        for p in later:
            parts = parts.unionByName(p)
        if later:
            parts = parts.join(self._gone(), (F.col("key") == F.col("gone_key")) & (F.col("gone_seq") > F.col("seq")), "left_anti")
        return parts.drop("seq", "bucket")

    def _gone(self) -> DataFrame:
        first, *later = (self.part(s, "gone").select(F.col("key").alias("gone_key"), F.lit(s.seq).alias("gone_seq")) for s in self.segments[1:])
        for g in later:
            first = first.unionByName(g)
        return first


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _write_segment(spark: SparkSession, path: str, seq: int, made: DataFrame, gone: DataFrame | None) -> Segment:
    name = f"{seq:08d}-{uuid.uuid4().hex[:8]}"
    where = f"{path}/segments/{name}"
    rows = made.withColumn("bucket", bucket(F.col("token"))).repartitionByRange("bucket", "token", "key").sortWithinPartitions("bucket", "token")
    rows.write.partitionBy("bucket").parquet(f"{where}/postings")
    if gone is None:
        gone = made.sparkSession.createDataFrame([], StructType([made.schema["key"]]))
    gone.select("key").distinct().write.parquet(f"{where}/gone")
    n, tokens = spark.read.parquet(f"{where}/postings").where((F.col("bucket") == _bucket_of(spark, [""])[0]) & (F.col("token") == "")).agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
    return Segment(seq, name, n, tokens, n + spark.read.parquet(f"{where}/gone").count())


def _publish(index: Index) -> Index:
    """The manifest comes last: an index is the newest manifest that is whole."""
    new = replace(index, version=index.version + 1)
    rows = [(s.seq, s.name, s.docs, s.tokens, s.size, list(index.columns), index.signature) for s in index.segments]
    index.spark.createDataFrame(rows, "seq int, name string, docs bigint, tokens bigint, size bigint, columns array<string>, signature string").coalesce(1).write.parquet(f"{index.path}/manifests/version={new.version}")
    return new


def write_index(rows: DataFrame, key: str, columns: tuple[str, ...], path: str, signature: str = "", cut: Callable[[Column], Column] = t.index_tokens) -> Index:
    """The index of ``rows`` at ``path``, in place of what is there."""
    spark = rows.sparkSession
    try:
        version = read_index(spark, path).version
    except AnalysisException:
        version = 0
    segment = _write_segment(spark, path, 0, postings(rows, key, *columns, cut=cut), None)
    return _publish(Index(spark, path, tuple(columns), version, (segment,), signature))


def read_index(spark: SparkSession, path: str) -> Index:
    """The index at ``path``; an ``AnalysisException`` if there is none."""
    rows = spark.read.parquet(f"{path}/manifests")
    newest = rows.agg(F.max("version")).first()[0]
    found = rows.where(F.col("version") == newest).orderBy("seq").collect()  # a row for each segment
    return Index(spark, path, tuple(found[0].columns), newest, tuple(Segment(r.seq, r["name"], r.docs, r.tokens, r["size"]) for r in found), found[0].signature)


def refreshed(index: Index, changed: DataFrame, key: str, gone: DataFrame | None = None, cut: Callable[[Column], Column] = t.index_tokens) -> Index:
    """``index`` with the rows ``changed(key, columns...)`` in place of those of the same keys, and without ``gone(key)``.

    Writes the postings of the changed rows only, unless segments are due to be merged.
    """
    made = postings(changed, key, *index.columns, cut=cut)
    keys = changed.select(F.col(key).alias("key"))
    keys = keys.unionByName(gone.select("key")) if gone is not None else keys
    own = _write_segment(index.spark, index.path, index.segments[-1].seq + 1, made, keys)
    new = replace(index, segments=(*index.segments, own))
    lost = new.part(own, "gone")
    empty = _bucket_of(index.spark, [""])[0]
    old = index.postings((F.col("bucket") == empty) & (F.col("token") == ""))  # a row for each live row of the index
    where = _with_segment(index, old).join(lost, "key", "left_semi").groupBy("seq").agg(F.count("*").alias("n"), F.sum("doc_len").alias("tokens")).collect()
    away = {r.seq: (r.n, r.tokens) for r in where}
    new = replace(new, segments=tuple(replace(s, docs=s.docs - away.get(s.seq, (0, 0))[0], tokens=s.tokens - away.get(s.seq, (0, 0))[1]) for s in index.segments) + (own,))
    return _publish(_compacted(new))


def _with_segment(index: Index, live: DataFrame) -> DataFrame:
    """Live rows of the empty token with the segment they are from: the newest that has the key."""
    empty = _bucket_of(index.spark, [""])[0]
    first, *later = (index.part(s, "postings").where((F.col("bucket") == empty) & (F.col("token") == "")).select("key", F.lit(s.seq).alias("seq")) for s in index.segments)
    for p in later:
        first = first.unionByName(p)
    return live.select("key", "doc_len").join(first.groupBy("key").agg(F.max("seq").alias("seq")), "key")


def _tier(segment: Segment) -> int:
    return int(math.log(max(1, segment.size), FANOUT))


def _compacted(index: Index) -> Index:
    """Merges the newest ``FANOUT`` segments while none of them is of a higher tier than the newest."""
    while len(index.segments) > FANOUT - 1 and max(map(_tier, index.segments[-FANOUT:])) <= _tier(index.segments[-1]) and len(index.segments) >= FANOUT:
        kept, due = index.segments[:-FANOUT], index.segments[-FANOUT:]
        part = replace(index, segments=due)
        gone = None
        if kept:
            gone = part.part(due[0], "gone")
            for s in due[1:]:
                gone = gone.unionByName(part.part(s, "gone"))
        merged = _write_segment(index.spark, index.path, due[-1].seq, part.postings(F.lit(True)), gone)
        index = replace(index, segments=(*kept, merged))
    return index


def vacuum(index: Index) -> None:
    """Delete segments and manifests that neither the newest manifest nor the one before it names."""
    spark = index.spark
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(index.path)
    files = root.getFileSystem(conf)
    rows = spark.read.parquet(f"{index.path}/manifests")
    keep = {r["name"] for r in rows.where(F.col("version") >= index.version - 1).select("name").distinct().collect()}
    for s in files.listStatus(jvm.org.apache.hadoop.fs.Path(root, "segments")):
        if s.getPath().getName() not in keep:
            files.delete(s.getPath(), True)
    for s in files.listStatus(jvm.org.apache.hadoop.fs.Path(root, "manifests")):
        if int(s.getPath().getName().partition("=")[2]) < index.version - 1:
            files.delete(s.getPath(), True)


def index_of(table: str, rows: DataFrame, key: str, columns: tuple[str, ...], root: str, cut: Callable[[Column], Column] = t.index_tokens) -> Index:
    """The index of ``rows``, made from the files of ``table``, below ``root``: the stored one as long as these files stay the same.

    Each key, list of columns and plan of ``rows`` has a folder of its own. In-memory rows are told apart by a hash of
    their plan, which is good within a session.
    """
    spark = rows.sparkSession
    one = F.xxhash64(F.col("path"), F.col("length"), F.col("modificationTime"))
    files = spark.read.format("binaryFile").load(table).agg(F.count("*"), F.sum(one.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit("x"), "path", "length", "modificationTime"))).first()
    signature = "/".join(map(str, files))
    path = f"{root.rstrip('/')}/index-{hashlib.sha256(repr((table, key, columns, cut.__name__, _plan(rows))).encode()).hexdigest()[:24]}"
    try:
        index = read_index(spark, path)
    except AnalysisException:  # no such folder yet
        index = None
    if index is None or index.signature != signature:
        index = write_index(rows, key, columns, path, signature, cut)
        vacuum(index)
    return index


def _plan(rows: DataFrame) -> str:
    """What ``rows`` computes, without the numbers that a session gives to columns."""
    name = "spark.sql.debug.maxToStringFields"
    spark, before = rows.sparkSession, rows.sparkSession.conf.get(name)
    spark.conf.set(name, 1 << 30)
    try:
        plan = rows._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set(name, before)
    own = f" {rows.semanticHash()}" if re.search(r"LocalRelation|LogicalRDD|InMemory", plan) else ""
    return re.sub(r"#\d+L?", "#", plan) + rows.schema.simpleString() + own


# patterns


class BadPattern(ValueError):
    """A pattern that is no expression."""


@dataclass(frozen=True)
class Phrase:
    """Tokens in a row, each whole or the start of one."""

    tokens: tuple[tuple[str, bool], ...]
    columns: frozenset[int] | None = None
    first: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    most: int


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Without:
    left: object
    right: object


@dataclass
class _Reader:
    pattern: str
    columns: tuple[str, ...]
    at: int = 0
    parts: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        end = 0
        for m in re.finditer(r'\s*(?:"((?:[^"]|"")*)"|([\w\x1a]+)|([(){}:,+*^-]))', self.pattern):
            if m.start() != end:
                break
            end = m.end()
            kind = "text" if m[1] is not None else "word" if m[2] else "sign"
            self.parts.append((kind, (m[1] or "").replace('""', '"') if kind == "text" else m[2] or m[3]))
        if self.pattern[end:].strip() or not self.parts:
            raise BadPattern(self.pattern)

    def look(self, value: str, ahead: int = 0) -> bool:
        i = self.at + ahead
        return i < len(self.parts) and self.parts[i] == ("word" if value.isalpha() else "sign", value)

    def take(self, value: str) -> bool:
        found = self.look(value)
        self.at += found
        return found

    def need(self, value: str) -> None:
        if not self.take(value):
            raise BadPattern(f"{self.pattern}: {value} expected")

    def text(self) -> str:
        if self.at < len(self.parts) and (self.parts[self.at][0] == "text" or self.parts[self.at][0] == "word" and self.parts[self.at][1] not in ("AND", "OR", "NOT")):
            self.at += 1
            return self.parts[self.at - 1][1]
        raise BadPattern(f"{self.pattern}: a word expected")

    def whole(self) -> object:
        tree = self.either()
        if self.at < len(self.parts):
            raise BadPattern(f"{self.pattern}: {self.parts[self.at][1]} not expected")
        return tree

    def either(self) -> object:
        left = self.both()
        while self.take("OR"):
            left = Either(left, self.both())
        return left

    def both(self) -> object:
        left = self.without()
        while self.take("AND"):
            left = Both(left, self.without())
        return left

    def without(self) -> object:
        left = self.row()
        while self.take("NOT"):
            left = Without(left, self.row())
        return left

    def row(self) -> object:
        """One parenthesis, or terms side by side; a term without tokens is left out beside others."""
        columns = self.column_set()
        if self.take("("):
            return self.enclosed(columns)
        terms = [self.term(columns)]
        while self.at < len(self.parts) and not any(self.look(x) for x in ("AND", "OR", "NOT", ")")):
            columns = self.column_set()
            if self.look("("):
                raise BadPattern(f"{self.pattern}: ( not expected")
            terms.append(self.term(columns))
        said = [x for x in terms if not (isinstance(x, Phrase) and not x.tokens)] or terms[:1]
        tree = said[0]
        for x in said[1:]:
            tree = Both(tree, x)
        return tree

    def enclosed(self, columns: frozenset[int] | None) -> object:
        tree = _limited(self.either(), columns)
        self.need(")")
        return tree

    def column_set(self) -> frozenset[int] | None:
        start = self.at
        other = self.take("-")
        if self.take("{"):
            names = []
            while not self.take("}"):
                names.append(self.text())
        elif self.at + 1 < len(self.parts) and self.parts[self.at][0] != "sign" and self.look(":", 1):
            names = [self.text()]
        else:
            if other:
                raise BadPattern(f"{self.pattern}: a column expected")
            self.at = start
            return None
        self.need(":")
        if unknown := [x for x in names if x not in self.columns]:
            raise BadPattern(f"{self.pattern}: no column {unknown[0]}")
        own = {self.columns.index(x) for x in names}
        return frozenset(range(len(self.columns))) - own if other else frozenset(own)

    def term(self, columns: frozenset[int] | None) -> object:
        if self.look("NEAR") and self.look("(", 1):
            self.at += 2
            phrases, most = [], 10
            while not self.look(")") and not self.look(","):
                phrases.append(self.phrase(columns))
            if self.take(","):
                number = self.text()
                if not number.isdecimal():
                    raise BadPattern(f"{self.pattern}: a number expected")
                most = int(number)
            self.need(")")
            phrases = [p for p in phrases if p.tokens]
            if not phrases:
                raise BadPattern(f"{self.pattern}: a word expected")
            return Near(tuple(phrases), most) if len(phrases) > 1 else phrases[0]
        return self.phrase(columns)

    def phrase(self, columns: frozenset[int] | None) -> Phrase:
        first = self.take("^")
        tokens: list[tuple[str, bool]] = []
        while True:
            own = tokens_of(self.text())
            star = self.take("*")
            tokens += [(w, star and i == len(own) - 1) for i, w in enumerate(own)]
            if not self.take("+"):
                return Phrase(tuple(tokens), columns, first)


def _limited(tree: object, columns: frozenset[int] | None) -> object:
    """``tree`` in these columns only."""
    if columns is None:
        return tree
    if isinstance(tree, Phrase):
        return replace(tree, columns=columns if tree.columns is None else columns & tree.columns)
    if isinstance(tree, Near):
        return replace(tree, phrases=tuple(_limited(p, columns) for p in tree.phrases))
    return replace(tree, left=_limited(tree.left, columns), right=_limited(tree.right, columns))


def tokens_of(text: str) -> list[str]:
    """The tokens of a text, as the index folds and cuts them."""
    folded = text.lower().translate(str.maketrans(t.ACCENTED, t.PLAIN))
    return [w for w in re.split(r"[\W_]+", folded) if w]


def parsed(pattern: str, columns: tuple[str, ...] = ()) -> object:
    """The tree of ``pattern``; ``BadPattern`` if it is none."""
    return _Reader(pattern, tuple(columns)).whole()


# matching


def _bucket_of(spark: SparkSession, tokens: list[str]) -> list[int]:
    """The buckets of a query's tokens, in one expression and without a job."""
    values = ", ".join(f"pmod(xxhash64(:t{i}), {BUCKETS})" for i in range(len(tokens)))
    return [int(x) for x in spark.sql(f"SELECT array({values}) AS b", args={f"t{i}": w for i, w in enumerate(tokens)}).first().b]


def containing(index: Index, part: str) -> DataFrame:
    """``(key)`` of the rows that may hold ``part`` in a column, from an index of trigrams: all that hold it without regard to
    case, and few others. Parts of one or two characters begin the trigrams that are asked for."""
    low = part.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if grams:
        own = index.postings(F.col("token").isin(*grams) & F.col("bucket").isin(*_bucket_of(index.spark, grams)))
        return own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("key")
    chosen = F.col("token").startswith(low) & (F.col("token") != "") if low else F.col("token") == ""
    return index.postings(chosen).select("key").distinct()


def _leaves(tree: object, counts: bool = True) -> Iterator[tuple[Phrase | Near, bool]]:
    """Phrases and groups, and whether they count for the rank: not if they must be absent."""
    if isinstance(tree, Phrase | Near):
        yield tree, counts
    else:
        yield from _leaves(tree.left, counts)
        yield from _leaves(tree.right, counts and not isinstance(tree, Without))


def _back(by: int):
    return lambda place: place - by


@F.pandas_udf(ArrayType(ArrayType(LongType())))
def _clumps(places: pd.Series, sizes: pd.Series, most: pd.Series) -> pd.Series:
    """For each phrase of a group, the places that lie in a clump: one place of each phrase in one column, with at most
    ``most`` tokens between the end of each and the start of the last."""
    out = []
    for own, lengths, gap in zip(places, sizes, most, strict=True):
        own = [np.asarray(p) for p in own]
        ends = np.unique(np.concatenate(own))  # where the last phrase of a clump may start
        low = [ends - gap - n for n in lengths]
        low = [np.maximum(x, ends >> COLUMN << COLUMN) for x in low]
        fits = np.ones(len(ends), dtype=bool)
        for p, x in zip(own, low, strict=True):
            fits &= np.searchsorted(p, x) < np.searchsorted(p, ends, side="right")
        kept = []
        for p, x in zip(own, low, strict=True):
            change = np.zeros(len(p) + 1, dtype=np.int64)
            np.add.at(change, np.searchsorted(p, x)[fits], 1)
            np.add.at(change, np.searchsorted(p, ends, side="right")[fits], -1)
            kept.append(p[np.cumsum(change)[:-1] > 0].tolist())
        out.append(kept)
    return pd.Series(out)


def matched(index: Index, pattern: str | object) -> DataFrame:
    """``(key, rank)`` of the rows that match; the lower the rank, the better.

    The rank is BM25 over phrases: each counts its occurrences, in the columns and groups it is limited to, and is as rare
    as the rows that hold it. What must be absent counts nothing.
    """
    tree = parsed(pattern, index.columns) if isinstance(pattern, str) else pattern
    leaves = list(dict.fromkeys(_leaves(tree)))
    phrases = [p for leaf, _ in leaves for p in (leaf.phrases if isinstance(leaf, Near) else (leaf,))]
    slots = sorted({x for p in phrases for x in p.tokens})
    if not slots:
        key = index.part(index.segments[0], "postings").schema["key"]
        return index.spark.createDataFrame([], StructType([key, *StructType.fromDDL("rank double")]))
    exact, starts = [w for w, star in slots if not star], [w for w, star in slots if star]
    chosen = F.col("token").isin(*exact) & F.col("bucket").isin(*_bucket_of(index.spark, exact)) if exact else F.lit(False)
    for w in starts:
        chosen = chosen | F.col("token").startswith(w)
    own = index.postings(chosen)
    is_ = lambda w, star: F.col("token").startswith(w) if star else F.col("token") == w
    plain = lambda p: len(p.tokens) == 1 and p.columns is None and not p.first  # noqa: E731  its count is all that matters
    alone = {leaf for leaf, _ in leaves if isinstance(leaf, Phrase) and plain(leaf)}
    placed = {x for leaf, _ in leaves if leaf not in alone for p in (leaf.phrases if isinstance(leaf, Near) else (leaf,)) for x in p.tokens}
    sums = [F.sum(F.when(is_(*x), F.col("tf")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(slots)]
    sums += [F.sort_array(F.flatten(F.collect_list(F.when(is_(*x), F.col("positions"))))).alias(f"p{i}") for i, x in enumerate(slots) if x in placed]
    per = own.groupBy("key", "doc_len").agg(*sums)

    def places(p: Phrase) -> Column:
        """Where the phrase begins."""
        if not p.tokens:
            return F.array().cast("array<bigint>")
        found = F.col(f"p{slots.index(p.tokens[0])}")
        for i, x in enumerate(p.tokens[1:], 1):
            found = F.array_intersect(found, F.transform(f"p{slots.index(x)}", _back(i)))
        if p.columns is not None:
            found = F.filter(found, lambda y: F.shiftright(y, COLUMN).isin(*sorted(p.columns)) if p.columns else F.lit(False))
        if p.first:
            found = F.filter(found, lambda y: y.bitwiseAND(F.lit((1 << COLUMN) - 1)) == 0)
        return found

    counts: dict[Phrase | Near, list[Column]] = {}
    for i, (leaf, _) in enumerate(leaves):
        if leaf in alone:
            counts[leaf] = [F.col(f"n{slots.index(leaf.tokens[0])}")]
        elif isinstance(leaf, Phrase):
            per = per.withColumn(f"c{i}", F.size(places(leaf)).cast("bigint"))
            counts[leaf] = [F.col(f"c{i}")]
        else:
            # array_intersect leaves a sorted array sorted
            group = F.array(*(F.sort_array(places(p)) for p in leaf.phrases))
            per = per.withColumn(f"g{i}", _clumps(group, F.array(*(F.lit(len(p.tokens)) for p in leaf.phrases)), F.lit(leaf.most)))
            counts[leaf] = [F.size(F.element_at(f"g{i}", k + 1)).cast("bigint") for k in range(len(leaf.phrases))]

    def holds(node: object) -> Column:
        if isinstance(node, Phrase | Near):
            return F.greatest(*counts[node], F.lit(0)) > 0 if isinstance(node, Phrase) else F.least(*counts[node], F.lit(1 << 62)) > 0
        left, right = holds(node.left), holds(node.right)
        return left & right if isinstance(node, Both) else left | right if isinstance(node, Either) else left & ~right

    ranked = [c for leaf, on in leaves if on for c in counts[leaf]]
    per = per.select("key", "doc_len", holds(tree).alias("found"), *(c.alias(f"f{i}") for i, c in enumerate(ranked)))
    known = per.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"f{i}") for i in range(len(ranked)))).first()  # one row
    rank = F.lit(0.0)
    for i in range(len(ranked)):
        idf = max(math.log((index.n - known[i] + 0.5) / (known[i] + 0.5)), 1e-6)
        tf = F.col(f"f{i}").cast("double")
        rank = rank - F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / F.lit(index.mean_len)))
    return per.where("found").select("key", rank.alias("rank"))
