"""Exact removal of repeated passages: every word of a 20-word window that already stands earlier in the corpus.

Windows are found by Rabin-Karp hashes over word hashes. Two passes over the texts keep the shuffle small:

1. A window's anchor is the least hash of the shorter word runs in it; equal windows have equal anchors. Distinct anchors
   are counted in Spark, and those seen more than once set bits of a filter whose size has a fixed limit.
2. Windows under an anchor that the filter knows go to Spark with a 96-bit hash, the first of each task's equal ones only
   (a later one in the same piece is repeated for certain); where they meet, all but the first of a hash are repeated.

Starts of repeated windows are gathered for each document, merged to maximal intervals and cut out. A filter that is
too full lets more windows through to the second step, and no repeated one is ever lost, so results don't depend on it.

Defined results: a null text has no words. A null ``doc_id`` counts as smaller than any other. Windows of rows with one
``doc_id`` are earlier or later by their start alone; equal rows are the same document and get the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import frames

WINDOW, ANCHOR = 20, 8
#: Bytes of text worked on at once, and bytes hashed at once.
PIECE, RUN = 4 << 20, 1 << 20
#: Bits of the filter: 16 for each repeated anchor, and this many (32 MB) at most.
FILTER_BITS = 1 << 28
PROBES = 4

_U = np.uint64
_BYTES, _WORDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n, by doubling."""
    out = np.ones(max(1, n), dtype=_U)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * _U(pow(base, done, 1 << 64))
        done += more
    return out


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the words; a text's bounds also bound its words."""
    word = ~frames.WHITE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Polynomial hash of ``values[s:e]`` for each span: differences of one running sum, scaled back by the start."""
    total = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return frames.mixed((total[ends] - total[starts]) * down[starts])


class Hasher:
    """Hashes of words, and of the word runs of each length asked for."""

    def __init__(self, which: int) -> None:
        self.bases = [(b, pow(b, -1, 1 << 64)) for b in (_BYTES[which], _WORDS[which])]
        self.tables: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, _U), np.ones(1, _U))] * 2

    def _table(self, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[k][0]) <= n:
            self.tables[k] = tuple(_powers(b, n + n // 2 + 1) for b in self.bases[k])
        return self.tables[k]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), dtype=_U)
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + RUN, side="right")))
            lo, hi = starts[first], ends[last - 1]
            up, down = self._table(0, int(hi - lo))
            s, e = starts[first:last] - lo, ends[first:last] - lo
            out[first:last] = _rolling(data[lo:hi].astype(_U) + _U(1), s, e, self.bases[0][0], up, down) + (e - s).astype(_U)
            first = last
        return out

    def runs(self, words: np.ndarray, size: int) -> np.ndarray:
        n = max(0, len(words) - size + 1)
        up, down = self._table(1, len(words))
        at = np.arange(n)
        return _rolling(words, at, at + size, self.bases[1][0], up, down)


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each ``size`` consecutive values."""
    step, n = 1, len(x) - size + 1
    if n <= 0:
        return x[:0]
    while 2 * step <= size:
        x = np.minimum(x[: len(x) - step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[size - step : size - step + n])


class Piece:
    """Words, windows and anchors of some texts."""

    def __init__(self, batch: pa.RecordBatch, hasher: Hasher) -> None:
        self.data, self.bounds = frames.text_bytes(batch.column("text"))
        self.starts, self.ends = spans(self.data, self.bounds)
        self.first = np.searchsorted(self.starts, self.bounds)  # index of each text's first word
        self.words = hasher.words(self.data, self.starts, self.ends)
        text = np.repeat(np.arange(batch.num_rows), np.diff(self.first))
        n = max(0, len(self.words) - WINDOW + 1)
        self.whole = text[:n] == text[WINDOW - 1 :] if n else np.zeros(0, bool)  # the window ends in the text it begins in
        self.text = text
        short = hasher.runs(self.words, ANCHOR)
        self.short, self.anchors = frames.mixed(short), frames.mixed(_least(short, WINDOW - ANCHOR + 1))  # least values lie low; scrambled they spread

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, and which may stand for two windows already in this piece.

        Neighbouring windows mostly share one place of an anchor, which counts once; where a short run comes again
        within a window's reach, one place can't be told from two, and the anchor counts as repeated.
        """
        at = np.flatnonzero(self.whole)
        value = self.anchors[at]
        new = np.append(True, (value[1:] != value[:-1]) | (np.diff(at) > 1) | (self.text[at][1:] != self.text[at][:-1]))[: len(at)]
        again = [self.short[d:][self.short[d:] == self.short[:-d]] for d in range(1, WINDOW - ANCHOR + 2) if len(self.short) > d]
        once, times = np.unique(value[new], return_counts=True)
        return once, (times > 1) | np.isin(once, np.concatenate(again) if again else once[:0])


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    """Which of ``buckets`` equal ranges of 64-bit values each of ``values`` lies in."""
    return ((values >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int32)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal rows of sorted ``keys``."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], n)[: len(first)]


def _filter_places(values: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    x = frames.mixed(values + _U(0x5851F42D4C957F2D))
    for i in range(PROBES):
        yield (x >> _U(16 * i) ^ x * _U(2 * i + 1)) & _U(bits - 1)


def _anchor_filter(rows: DataFrame, buckets: int) -> list[np.ndarray]:
    """One bit filter for each bucket, of the anchors that stand in the corpus more than once. All together at most ``FILTER_BITS`` bits."""
    n = frames.partitions(rows.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(0)
        for batch in batches:
            for part in frames.slices(batch, "text", PIECE):
                once, twice = Piece(part, hasher).counted()
                bucket = _bucket(once, buckets)
                spans_ = list(zip(*_groups(bucket), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket[i] for i, _ in spans_], pa.int32()), pa.array([once[i:j].tobytes() for i, j in spans_], pa.binary()), pa.array([np.packbits(twice[i:j]).tobytes() for i, j in spans_], pa.binary())],
                    names=["bucket", "anchors", "twice"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(bucket: int, lists: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            values = np.concatenate([np.frombuffer(a, dtype=_U) for a, _ in lists])
            marks = np.concatenate([np.unpackbits(np.frombuffer(t, dtype=np.uint8), count=len(a) // 8) for a, t in lists])
            found, where, times = np.unique(values, return_inverse=True, return_counts=True)
            times[where[marks > 0]] += 1
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([found[times > 1].tobytes()], pa.binary())], names=["bucket", "anchors"])

        for bucket, lists in _by_bucket(batches):
            yield settle(bucket, lists)

    sent = rows.mapInArrow(send, "bucket int, anchors binary, twice binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    met = frames.cut(sent.mapInArrow(meet, "bucket int, anchors binary"))
    total = met.agg(F.coalesce(F.sum(F.length("anchors")), F.lit(0))).first()[0] // 8
    bits = max(64, 1 << max(0, (min(16 * total, FILTER_BITS) // buckets).bit_length() - 1))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchors in batch.column("anchors").to_pylist():
                on = np.zeros(bits, dtype=np.uint8)
                for place in _filter_places(np.frombuffer(anchors, dtype=_U), bits):
                    on[place] = 1
                out.append(np.packbits(on, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(out, pa.binary())], names=["bucket", "bits"])

    found = {r["bucket"]: np.frombuffer(bytes(r["bits"]), dtype=np.uint8) for r in met.mapInArrow(fill, "bucket int, bits binary").toLocalIterator()}
    return [found.get(b, np.zeros(bits // 8, dtype=np.uint8)) for b in range(buckets)]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of sorted batches, gathered for each value of the first column."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != now and rows:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row[1:])
    if rows:
        yield now, rows
    rows = []
    pa.default_memory_pool().release_unused()


_PLACE = (("doc", np.int64), ("mark", np.uint32), ("start", np.uint32))
_FIELDS = (("h1", _U), ("h2", np.uint32), *_PLACE)


def _late(cols: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Windows in order of hash, document and start, and which of them have an earlier one of their hash."""
    order = np.lexsort((cols["start"], cols["doc"], cols["h2"], cols["h1"]))
    cols = {k: v[order] for k, v in cols.items()}
    first, end = _groups(cols["h1"], cols["h2"])
    head = np.repeat(first, end - first)
    return cols, (cols["doc"] != cols["doc"][head]) | (cols["start"] != cols["start"][head])  # equal rows keep their equal starts: none is earlier


def _packed(key: np.ndarray, cols: dict[str, np.ndarray], fields: tuple) -> list[list]:
    """A row for each value of ``key``, its columns packed in document order, in which they compress best."""
    order = np.lexsort((cols["start"], cols["doc"], key))
    key = key[order]
    cols = {k: v[order] for k, v in cols.items()}
    return [[int(key[i]), *(cols[k][i:j].astype(t).tobytes() for k, t in fields)] for i, j in zip(*_groups(key), strict=True)]


def _home(doc: np.ndarray, parts: int) -> np.ndarray:
    """The partition that gathers a document's starts."""
    return _bucket(frames.mixed(doc.view(_U)), parts)


def _batch(rows: list[list], fields: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i + 1] for r in rows], pa.binary()) for i in range(len(fields)))], names=["bucket", *(k for k, _ in fields)])


def _schema(fields: tuple) -> str:
    return "bucket int, " + ", ".join(f"{k} binary" for k, _ in fields)


def _candidates(rows: DataFrame, filters: list[np.ndarray], homes: int) -> DataFrame:
    """Packed windows that may be repeated, by bucket of their hash; and those known to be, in bucket ``-1 - home``."""
    buckets, bits = len(filters), 8 * len(filters[0])
    known = rows.sparkSession.sparkContext.broadcast(np.concatenate(filters))

    def may_repeat(anchors: np.ndarray) -> np.ndarray:
        table = known.value
        base = _bucket(anchors, buckets).astype(_U) * _U(bits)
        yes = np.ones(len(anchors), dtype=bool)
        for place in _filter_places(anchors, bits):
            at = base + place
            yes &= (table[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)
        return yes

    def sent(part: pa.RecordBatch, hasher: Hasher, other: Hasher) -> pa.RecordBatch | None:
        piece = Piece(part, hasher)
        at = np.flatnonzero(piece.whole)
        at = at[may_repeat(piece.anchors[at])]
        if not len(at):
            return None
        text = piece.text[at]
        ids = part.column("doc_id").fill_null(frames.NULL_ID).to_numpy(zero_copy_only=False)
        marks = part.column("mark").to_numpy(zero_copy_only=False).astype(np.uint32)
        h2 = other.runs(other.words(piece.data, piece.starts, piece.ends), WINDOW)[at] >> _U(32)
        cols, late = _late({"h1": hasher.runs(piece.words, WINDOW)[at], "h2": h2.astype(np.uint32), "doc": ids[text], "mark": marks[text], "start": (at - piece.first[text]).astype(np.uint32)})
        kept, gone = ({k: v[which] for k, v in cols.items()} for which in (~late, late))
        return _batch(_packed(_bucket(kept["h1"], buckets), kept, _FIELDS) + [[r[0], b"", b"", *r[1:]] for r in _packed(-1 - _home(gone["doc"], homes), gone, _PLACE)], _FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, other = Hasher(0), Hasher(1)
        for batch in batches:
            for part in frames.slices(batch, "text", PIECE):
                if (got := sent(part, hasher, other)) is not None:
                    yield got

    return rows.mapInArrow(run, _schema(_FIELDS))


def _joined(lists: list[tuple[bytes, ...]], fields: tuple) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(b"".join(row[i] for row in lists), dtype=t) for i, (k, t) in enumerate(fields)}


def _judged(sent: DataFrame, homes: int) -> DataFrame:
    """Where the candidates of a hash meet: places of repeated windows, packed for the home of their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, lists in _by_bucket(batches):
            if bucket < 0:
                yield _batch([[-1 - bucket, *row[2:]] for row in lists], _PLACE)
                continue
            cols, late = _late(_joined(lists, _FIELDS))
            cols = {k: cols[k][late] for k, _ in _PLACE}
            if len(cols["doc"]):
                yield _batch(_packed(_home(cols["doc"], homes), cols, _PLACE), _PLACE)

    n = frames.partitions(sent.sparkSession)
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _schema(_PLACE))


def _at_home(places: DataFrame) -> DataFrame:
    """One row for each text that has repeated windows: ``doc_id, mark, starts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lists in _by_bucket(batches):
            cols = _joined(lists, _PLACE)
            order = np.lexsort((cols["start"], cols["mark"], cols["doc"]))
            doc, mark, start = (cols[k][order] for k, _ in _PLACE)
            first, end = _groups(doc, mark)
            yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(mark[first].astype(np.int64)), pa.array([start[i:j].tobytes() for i, j in zip(first, end, strict=True)], pa.binary())], names=["doc_id", "mark", "starts"])

    n = frames.partitions(places.sparkSession)
    return places.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc_id bigint, mark bigint, starts binary")


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, mark, starts)`` for each text that has repeated windows: packed 32-bit word positions.

    ``mark`` tells texts of one id apart; a null id is ``frames.NULL_ID``.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), frames.crc(text).alias("mark"))
    homes = frames.partitions(docs.sparkSession)
    buckets = 4 * homes
    return _at_home(_judged(_candidates(rows, _anchor_filter(rows.select("text"), buckets), homes), homes))


def covered(n_words: int, starts: bytes) -> np.ndarray:
    """Which words lie in the windows, whose union is a few maximal intervals."""
    edge = np.zeros(n_words + 1, dtype=np.int32)
    at = np.frombuffer(starts, dtype=np.uint32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _with_starts(docs: DataFrame) -> DataFrame:
    """``row`` (a row of ``docs``) and ``starts``, null where nothing is repeated."""
    id_ = F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(frames.NULL_ID))
    keyed = frames.packed(docs).select("row", id_.alias("key"), frames.crc("row.text").alias("mark"))
    found = repeated_windows(docs).select(F.col("doc_id").alias("key"), "mark", "starts")
    return keyed.join(found, ["key", "mark"], "left").select("row", "starts")


def removal(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, sums = [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words = (text or "").encode().split()
                sizes.append(len(words))
                drop = covered(len(words), starts) if starts else None
                gone.append(int(drop.sum()) if starts else 0)
                kept = words if drop is None else compress(words, ~drop)
                sums.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _with_starts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select("row.doc_id", "row.text", "starts")
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def cut_text(text: str, starts: bytes) -> str:
    """``text`` without the words of the windows and the white space after each of them."""
    data = text.encode()
    view = np.frombuffer(data, dtype=np.uint8)
    first, _ = spans(view, np.array([0, len(view)]))
    drop = covered(len(first), starts)
    bounds = np.append(first, len(data))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], drop, [False]]).astype(np.int8)))
    out, at = [], 0
    for i, j in zip(edges[::2], edges[1::2], strict=True):
        out.append(data[at : bounds[i]])
        at = bounds[j]
    out.append(data[at:])
    return b"".join(out).decode()


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and ``n_chars`` (if there) made anew where a text changed. Every row stays."""

    @F.pandas_udf("string")
    def left_over(texts, starts):
        import pandas as pd

        return pd.Series([cut_text(t, s) if t and s is not None else t for t, s in zip(texts, starts, strict=True)], dtype=object)

    rows = _with_starts(docs)
    cut = F.col("starts").isNotNull()
    made = {"text": F.when(cut, left_over("row.text", "starts")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(cut, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
        return rows.select("row", "starts", made["text"].alias("text")).select("row", "text", made["n_chars"].alias("n_chars")).select(F.col("row").withField("text", F.col("text")).withField("n_chars", F.col("n_chars")).alias("row")).select("row.*")
    return rows.select(F.col("row").withField("text", made["text"]).alias("row")).select("row.*")


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS p, words FROM d WHERE len(words) >= 20),
win AS (SELECT doc_id, p, array_to_string(words[p : p + 19], ' ') AS w FROM pos),
late AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS n FROM win) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(range(p, p + 20)) AS q FROM late) GROUP BY doc_id),
kept AS (SELECT doc_id, len(words)::BIGINT AS n_words, len(coalesce(qs, []))::BIGINT AS n_removed,
  CASE WHEN qs IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(qs, i)) END AS k FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
