"""URL filters by a bit-parallel wildcard automaton.

All glob rules lie side by side in multiword Shift-And masks, one bit a pattern character. A batch of canonical URLs is
simulated together, a byte column at a time: every pattern of every URL advances with a shift, an and, and an or for the
bits that stand on a wildcard.

Patterns: ``*`` any run without ``/``, ``**`` any run, ``?`` one byte but ``/``; the rest stands for itself. A pattern
must match the whole canonical URL: ``.`` + host + path. A rule ``host/path`` is the pattern ``*.host/path**``, which fits
the host and its subdomains.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no pattern and is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import frames

#: Host and path rules with their verdicts; the longest that fits wins.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: The method's own blocked globs, for URLs that no rule fits.
BLOCKED = ("*.spam*/**", "*spam.*/**", "*casino*/**", "**.exe", "**.zip", "**/??/9*", "**/tracker/**", "**/*.html")
#: URLs simulated together; longer ones are grouped with their like.
TOGETHER = 4096
#: Bytes of paths taken out of a batch at once.
TEXTS = 1 << 22

_U = np.uint64
_SLASH = ord("/")


@dataclass
class Automaton:
    """Masks of all patterns. Bits of a pattern follow each other from its first state; words are 64 bits."""

    bytes_: np.ndarray  # (256, words): the byte moves from the state before this bit's into it
    loops: np.ndarray  # (256, words): a wildcard at this bit's state stays on the byte
    skip: np.ndarray  # bits whose state is entered without a byte from the one before it
    first: np.ndarray  # the states at the start
    last: list[int]  # the accepting bit of each pattern

    @staticmethod
    def of(patterns: list[str]) -> Automaton:
        moves: list[tuple[str, object]] = []  # of each bit: how its state is entered, and what it loops on
        last = []
        for p in patterns:
            moves.append(("start", None))
            raw, i = p.encode(), 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    moves.append(("skip", "any"))
                    i += 2
                elif raw[i : i + 1] == b"*":
                    moves.append(("skip", "step"))
                    i += 1
                else:
                    moves.append(("one", None) if raw[i : i + 1] == b"?" else (raw[i], None))
                    i += 1
            last.append(len(moves) - 1)
        words = max(1, -(-len(moves) // 64))
        bits = np.zeros((256, words * 64), dtype=bool)
        loops, skip, first = bits.copy(), bits[0].copy(), bits[0].copy()
        for at, (enter, loop) in enumerate(moves):
            if enter == "start":
                first[at] = True
            elif enter == "skip":
                skip[at] = True
            elif enter == "one":
                bits[:, at] = True
                bits[_SLASH, at] = False
            else:
                bits[enter, at] = True
            if loop:
                loops[:, at] = True
                loops[_SLASH, at] = loop == "any"
        pack = lambda x: np.packbits(x, axis=-1, bitorder="little").view("<u8").astype(_U)
        return Automaton(pack(bits), pack(loops), pack(skip), pack(first), last)

    def _closed(self, state: np.ndarray) -> np.ndarray:
        """With the states entered without a byte. Two skips in a row need two rounds."""
        while True:
            more = state | _shifted(state) & self.skip
            if np.array_equal(more, state):
                return state
            state = more

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """``(texts, patterns)``: which patterns match which whole text."""
        out = np.zeros((len(texts), len(self.last)), dtype=bool)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        for k in range(0, len(order), TOGETHER):
            own = order[k : k + TOGETHER]
            sizes = np.array([len(texts[i]) for i in own])
            data = np.frombuffer(b"".join(texts[i] for i in own), dtype=np.uint8)
            begin = np.cumsum(sizes) - sizes
            state = np.repeat(self._closed(self.first[None, :]), len(own), axis=0)
            for column in range(int(sizes[-1])):
                live = int(np.searchsorted(sizes, column, side="right"))  # texts before it have ended
                byte = data[begin[live:] + column]
                s = state[live:]
                state[live:] = self._closed(_shifted(s) & self.bytes_[byte] | s & self.loops[byte])
            for p, bit in enumerate(self.last):
                out[own, p] = (state[:, bit // 64] >> _U(bit % 64) & _U(1)).astype(bool)
        return out


def _shifted(state: np.ndarray) -> np.ndarray:
    up = state << _U(1)
    up[:, 1:] |= state[:, :-1] >> _U(63)
    return up


def host_and_path(url: str) -> tuple[Column, Column]:
    """What stands between the first ``://`` and the path, A-Z lower-cased, and the path up to ``?`` or ``#``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    rest = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, blocked: tuple[str, ...] = BLOCKED, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``: the longest fitting rule's verdict, else block if a blocked glob matches, else allow.

    Columns of these names are replaced; all others come back as they are, whatever their names.
    """
    ranked = sorted(rules, key=lambda r: -len(r[0]))
    for rule, _ in rules:
        if any(c in rule for c in "*?") or "/" not in rule:
            raise ValueError(f"not a host and path rule: {rule}")
    patterns = [f"*.{r}**" for r, _ in ranked] + list(blocked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton.of(patterns)
        for batch in (part for whole in batches for part in frames.slices(whole, "path", TEXTS)):
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            hit = automaton.matches([f".{h}{p}".encode() if h or p else b"" for h, p in zip(hosts, paths, strict=True)])
            fits, bad = hit[:, : len(ranked)], hit[:, len(ranked) :].any(axis=1)
            which = np.where(fits.any(axis=1), fits.argmax(axis=1) if ranked else 0, -1)
            rule = [ranked[w][0] if w >= 0 else None for w in which]
            verdict = [ranked[w][1] if w >= 0 else "block" if b else "allow" for w, b in zip(which, bad, strict=True)]
            names = [*batch.schema.names, "rule", "verdict"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=names)

    host, path = host_and_path("url")
    names = pages.columns
    rows = frames.packed(pages, names, url=frames.quoted(url))
    rows = rows.select("row", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    found = rows.mapInArrow(run, frames.row_and(rows, "host string, path string, rule string, verdict string"))
    own = ("host", "path", "rule", "verdict")
    return found.select(*(F.col("row").getField(c).alias(c) for c in names if c not in own), *own)


def _like(glob: str) -> str:
    """The regular expression of a glob, for the oracle."""
    out = glob.replace(".", r"\.").replace("**", "\0").replace("*", "[^/]*").replace("?", "[^/]").replace("\0", "(.|\\n)*")
    return f"^{out}$"


ORACLE = f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
b AS (SELECT page_id, regexp_extract(coalesce(r, ''), '^([^?#]*)', 1) AS r FROM a),
c AS (SELECT page_id, translate(regexp_extract(r, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(r, length(regexp_extract(r, '^([^/]*)', 1)) + 1) AS path FROM b),
d AS (SELECT *, CASE {' '.join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for r, _ in sorted(RULES, key=lambda x: -len(x[0])))} END AS rule FROM c)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES)}
  WHEN host || path <> '' AND ({' OR '.join(f"regexp_matches('.' || host || path, '{_like(g)}')" for g in BLOCKED)}) THEN 'block' ELSE 'allow' END AS verdict FROM d
"""
