"""SentencePiece encoding and decoding of merge-type (BPE) models with byte fallback, without the library.

A text is normalised as the model says (a space in front, spaces as the model's own mark) and cut where a mark follows
another character, as no piece of such a model spans that place. Each distinct cut is encoded by backtracking: an
Aho-Corasick automaton gives the longest piece at every character; from left to right the longest is taken that is
compatible with the piece before it, shorter prefixes after it, and a bit field keeps the positions that lead nowhere.
Two neighbours are compatible if merging would not have joined across their border, which is found by taking their last
merges apart again. Characters without a piece become byte pieces.

Defined results: a null or empty text has no ids and decodes to the empty text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import frames

MARK = "▁"
#: Cuts whose ids one worker keeps at hand, their characters at most, and pairs of pieces known to fit; at most some 40 MB in all.
CACHE, KEPT_CHARS, FITS = 150_000, 32, 1 << 16
#: Bytes of text worked on at once.
PIECE = 2 << 20

#: Columns that :func:`with_ids` makes.
MADE = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")

_CUT = re.compile(f"(?<=[^{MARK}])(?={MARK})")


class UnsupportedModel(ValueError):
    """The model needs what this codec doesn't do."""


class Codec:
    def __init__(self, path: str) -> None:
        import sentencepiece.sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal, spec = model.normalizer_spec, model.trainer_spec
        kinds = {i: p.type for i, p in enumerate(model.pieces)}
        self.pieces = {p.piece: i for i, p in enumerate(model.pieces) if kinds[i] == 1}
        if spec.model_type != 2 or not spec.byte_fallback or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or spec.treat_whitespace_as_suffix:
            raise UnsupportedModel("only BPE with byte fallback and no normalisation of characters")
        if not set(kinds.values()) <= {1, 2, 3, 6} or any(_CUT.search(p) for p in self.pieces):
            raise UnsupportedModel("pieces of a kind, or with a mark inside")
        self.prefix = normal.add_dummy_prefix
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if kinds[i] == 6}
        self.rank = {i: model.pieces[i].score for i in self.pieces.values()}  # the higher merges first
        self.text = {i: p for p, i in self.pieces.items()}
        self.out = [p.piece.replace(MARK, " ").encode() if kinds[i] == 1 else b"" for i, p in enumerate(model.pieces)]
        self.raw = {i: bytes([b]) for b, i in self.bytes.items()}
        self.unknown = next(i for i, k in kinds.items() if k == 2)
        for b, i in self.bytes.items():
            self.out[i] = bytes([b])
        self.out[self.unknown] = " ⁇ ".encode()
        self.kind = np.dtype(np.uint16 if len(self.out) <= 1 << 16 else np.uint32)
        self.listed, self.raws = pa.array([b"%d," % i for i in range(len(self.out))], pa.binary()), pa.array(self.out, pa.binary())
        self.spaced = np.array([b[:1] == b" " and i in self.text for i, b in enumerate(self.out)])
        self.split = self._splits()
        self.shorter: dict[int, int | None] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.pieces.items():
            if i in self.split:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}  # by the left id in the upper half, the right one in the lower
        self.front = MARK if self.prefix else ""  # what every cut begins with
        self.known: dict[str, bytes] = {}  # ids of cuts, by what follows the front

    def merged(self, text: str) -> list[str]:
        """Merging by its definition: the highest-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                joined = self.pieces.get(parts[i] + parts[i + 1])
                if joined is not None and (best is None or self.rank[joined] > best):
                    best, where = self.rank[joined], i
            if where < 0:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def _splits(self) -> dict[int, tuple[int, int] | None]:
        """The last merge of every piece that merging can make; None for single characters."""
        out: dict[int, tuple[int, int] | None] = {}
        for p, i in sorted(self.pieces.items(), key=lambda x: len(x[0])):
            if len(p) == 1:
                out[i] = None
                continue
            parts = list(p)
            while len(parts) > 2:
                best, where = None, -1
                for k in range(len(parts) - 1):
                    joined = self.pieces.get(parts[k] + parts[k + 1])
                    if joined is not None and (best is None or self.rank[joined] > best):
                        best, where = self.rank[joined], k
                if where < 0:
                    break
                parts[where : where + 2] = [parts[where] + parts[where + 1]]
            if len(parts) == 2 and all(x in self.pieces for x in parts):
                out[i] = (self.pieces[parts[0]], self.pieces[parts[1]])
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` side by side.

        Both are taken apart, the later merge first, down to the characters at the border; had any pair there a merge
        of a rank before the one that made the smaller part disappear, the border would have been crossed.
        """
        known = self.fits.get(left << 32 | right)
        if known is None:
            known = self.fits[left << 32 | right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # ``bound``: the border pair stood until this merge, which is on the left (ties go to the leftmost) or the right
        bound: tuple[float, bool] | None = None
        while True:
            joined = self.pieces.get(self.text[left] + self.text[right])
            if joined is not None:
                score = self.rank[joined]
                if bound is None or score > bound[0] or score == bound[0] and not bound[1]:
                    return False
            a, b = self.split[left], self.split[right]
            if a is None and b is None:
                return True
            # the side merged later comes apart first: lower score; of equal scores the right one merged later
            if b is None or a is not None and self.rank[left] < self.rank[right]:
                bound, left = (self.rank[left], True), a[1]
            else:
                bound, right = (self.rank[right], False), b[0]

    def _prefix(self, piece: int) -> int | None:
        """The longest other piece that ``piece`` begins with."""
        if piece not in self.shorter:
            p = self.text[piece]
            self.shorter[piece] = next((self.pieces[p[:n]] for n in range(len(p) - 1, 0, -1) if self.pieces.get(p[:n]) in self.split), None)
        return self.shorter[piece]

    def _cut_ids(self, text: str) -> list[int]:
        """Ids of one cut."""
        whole = self.pieces.get(text)
        if whole is not None and whole in self.split:
            return [whole]
        n = len(text)
        longest = [0] * n
        ids = [-1] * n
        for end, (size, i) in self.automaton.iter(text):
            start = end - size + 1
            if size > longest[start]:
                longest[start], ids[start] = size, i
        out: list[int] = []
        first = 0
        while first < n:  # runs between characters without a piece
            if ids[first] < 0:
                out += [self.bytes[b] for b in text[first].encode()]
                first += 1
                continue
            last = first
            while last < n and ids[last] >= 0:
                last += 1
            out += self._backtracked(ids, first, last)
            first = last
        return out

    def _backtracked(self, ids: list[int], pos: int, end: int) -> list[int]:
        dead = bytearray((end - pos) // 8 + 1)  # a bit for each position from which nothing goes on
        out: list[int] = []
        fits, size = self.fits, self.text
        first, piece = pos, ids[pos]
        while pos < end:
            last = out[-1] if out else -1
            at: int | None = piece
            while at is not None:
                to = pos + len(size[at])
                if not dead[(to - first) >> 3] >> (to - first & 7) & 1:
                    ok = last < 0 or fits.get(last << 32 | at)
                    if ok is None:
                        ok = self.compatible(last, at)
                    if ok:
                        break
                at = self._prefix(at)
            if at is not None:
                out.append(at)
                pos = to
                piece = ids[pos] if pos < end else -1
            else:
                dead[(pos - first) >> 3] |= 1 << (pos - first & 7)
                piece = out.pop()
                pos -= len(size[piece])
        return out

    def cuts(self, text: str) -> list[str]:
        if not text:
            return []
        return _CUT.split((MARK if self.prefix else "") + text.replace(" ", MARK))

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        """Ids of the cuts that ``parts`` and the front make; one seen before is looked up."""
        out = list(map(self.known.get, parts))
        code, room = self.kind.char, CACHE - len(self.known)
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = ids = array(code, self._cut_ids(self.front + parts[i])).tobytes()
                if room > 0 and len(parts[i]) < KEPT_CHARS:  # the first to come stay, among them the frequent ones
                    self.known[parts[i]] = ids
                    room -= 1
        if len(self.fits) > FITS:
            self.fits.clear()
        return out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``texts``, a string array without nulls, one after another, and the bounds of each text's.

        The distinct parts between spaces are encoded; each is a cut, but in texts with marks of their own or with more
        than one space at a place, which are cut by themselves.
        """
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        kinds = split.flatten().dictionary_encode()
        parts, which = kinds.dictionary.to_pylist(), kinds.indices.to_numpy()
        odd_part = np.array([not (p and self.prefix) or MARK in p for p in parts], dtype=bool)
        odd = np.add.reduceat(odd_part[which], bounds[:-1]) > 0 if len(which) else np.zeros(0, bool)
        plain = np.repeat(~odd, np.diff(bounds))
        used = np.zeros(len(parts), dtype=bool)
        used[which[plain]] = True
        found: list[bytes | None] = [None] * len(parts)
        at = np.flatnonzero(used).tolist()
        for i, ids in zip(at, self._ids_of([parts[i] for i in at]), strict=True):
            found[i] = ids
        raw, ends = _taken(pa.array(found, pa.binary()), kinds.indices)
        ends = ends[bounds]
        if odd.any():
            own = iter(self._by_cuts(texts.filter(pa.array(odd)).to_pylist()))
            lists = [next(own) if o else raw[i:j] for o, i, j in zip(odd.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            raw, ends = b"".join(lists), np.cumsum([0, *map(len, lists)])
        return np.frombuffer(raw, self.kind), ends // self.kind.itemsize

    def _by_cuts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, cut at its marks."""
        lists = [[c[len(self.front) :] for c in self.cuts(t)] for t in texts]
        parts = list(set().union(*lists))
        ids = dict(zip(parts, self._ids_of(parts), strict=True))
        return [b"".join(map(ids.__getitem__, x)) for x in lists]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        ids, bounds = self.encode_all(pa.array(texts, pa.string()))
        return [ids[i:j].tolist() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def sums(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[list[str], list[str]]:
        """SHA-256 of the decimal ids joined by commas and of the decoded text, for each of the texts that ``bounds`` parts."""
        taken = pa.array(ids)
        line, ends = _taken(self.listed, taken)
        ends = ends[bounds].tolist()
        listed = [hashlib.sha256(line[i : max(i, j - 1)]).hexdigest() for i, j in zip(ends, ends[1:], strict=False)]
        raw, ends = _taken(self.raws, taken)
        first = np.zeros(len(bounds) - 1, dtype=np.int64)
        some = np.diff(bounds) > 0
        if self.prefix:
            first[some] = self.spaced[ids[bounds[:-1][some]]]
        ends = ends[bounds]
        decoded = []
        for k, (i, j) in enumerate(zip((ends[:-1] + first).tolist(), ends[1:].tolist(), strict=True)):
            own = raw[i:j]
            try:
                str(own, "utf-8")
            except UnicodeDecodeError:
                own = self.decode(ids[bounds[k] : bounds[k + 1]].tolist()).encode()
            decoded.append(hashlib.sha256(own).hexdigest())
        return listed, decoded

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: marks are spaces, the space in front goes, broken bytes become U+FFFD one by one."""
        raw = b"".join(map(self.out.__getitem__, ids))
        if self.prefix and ids and ids[0] in self.text and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return re.sub("[\udc80-\udcff]", "�", raw.decode("utf-8", "surrogateescape"))


def _taken(values: pa.Array, which: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of ``values`` at the places ``which``, one after another, and where each begins and the last ends."""
    out = values.take(which)
    ends = np.frombuffer(out.buffers()[1], np.int32)[out.offset : out.offset + len(out) + 1] if len(out) else np.zeros(1, np.int32)
    return memoryview(out.buffers()[2] or b""), ends


@lru_cache(maxsize=1)
def codec_of(path: str) -> Codec:
    """A worker's codec, kept from task to task with the cuts it knows."""
    return Codec(path)


def model_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` of each row of ``docs(doc_id, text)``. ``model``: a file that every worker can read."""
    return _over(docs, model, "doc_id bigint, ids array<int>", lambda codec, ids, bounds: [_lists(ids, bounds)])


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))


def _sums(codec: Codec, ids: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.diff(bounds).astype(np.int64)), *(pa.array(x, pa.string()) for x in codec.sums(ids, bounds))]


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row of ``docs(doc_id, text)``."""
    return _over(docs, model, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", _sums)


def _over(docs: DataFrame, model: str, schema: str, made) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_mapped(model, [f.split()[0] for f in schema.split(", ")][1:], made), schema)


def _mapped(model: str, names: list[str], made):
    """Batches without ``text`` and with the columns that ``made`` makes of the texts' ids and their bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            kept = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            for part in frames.slices(batch, "text", PIECE):
                cols = made(codec, *codec.encode_all(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *cols], names=[*(part.schema.names[i] for i in kept), *names])

    return run


def with_ids(rows: DataFrame, model: str) -> DataFrame:
    """``rows(row, ..., text)`` with the columns ``MADE`` in place of ``text``, which must not be null."""
    fields = [f for f in rows.schema if f.name != "text"]

    def made(codec: Codec, ids: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        n, *sums = _sums(codec, ids, bounds)
        return [n, _lists(ids, bounds), *sums]

    return rows.mapInArrow(_mapped(model, list(MADE), made), frames.schema_of(fields, "n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string"))
