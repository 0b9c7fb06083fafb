"""Ignore rules: an ordered decision down the folders of a path.

Every rule is a row of segment patterns, one bit each in one automaton; a name advances all rules by one segment together.
On the way down, the last rule that fits a folder decides it, and an ignored folder ends the walk, so what is below can't
be taken back. The rules are those of the well-known ignore files: ``#`` comments, ``!`` takes back, a slash before the end
ties a rule to the root, one at the end means folders only, ``*``, ``?`` and classes stay inside a name, ``**`` spans folders,
a backslash makes the next character plain. Case does not count, as in the matcher that is re-expressed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

#: Names whose masks are kept.
KNOWN = 1 << 16


@dataclass(frozen=True)
class Rule:
    segments: tuple[str | None, ...]
    """Regular expressions of names; None is any number of folders."""
    back: bool
    folders: bool


def parsed(line: str) -> Rule | None:
    """The rule of a line; None for blank lines, comments and what can fit nothing."""
    line = line.rstrip("\r\n").removeprefix("﻿")
    end = len(line)
    while end and line[end - 1] in " \t" and not (end > 1 and line[end - 2] == "\\"):
        end -= 1
    line = line[:end]
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[back:]
    folders = line.endswith("/")
    line = line.rstrip("/") if folders else line
    if not line:
        return None
    tied = "/" in line
    names = line.removeprefix("/").split("/")
    segments: list[str | None] = [] if tied else [None]
    for name in names:
        if name == "**":
            if not segments or segments[-1] is not None:
                segments.append(None)
        else:
            try:
                re.compile(pattern := _name(name))
            except re.error:
                return None
            segments.append(pattern)
    if segments[-1] is None:  # a trailing ** is all that is inside
        segments.append(".*")
    return Rule(tuple(segments), back, folders)


def _name(glob: str) -> str:
    """The regular expression of one name."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "\\" and i < len(glob):
            out.append(re.escape(glob[i]))
            i += 1
        elif c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (close := re.compile(r"\]?(?:[^\]\\]|\\.)*\]").match(glob, i + (glob[i : i + 1] in ("!", "^")))):
            negated = glob[i : i + 1] in ("!", "^")
            inside = glob[i + negated : close.end() - 1]
            i = close.end()
            # in a regular expression only these mean something there
            plain = re.sub(r"\\(.)|([\[\]^&~|])", lambda m: re.escape(m[1] or m[2]), inside)
            out.append(f"[{'^' * negated}{plain}]")
        else:
            out.append(re.escape(c))
    return "".join(out)


class Matcher:
    """All rules as one automaton over names. A bit stands before each segment of a rule, and one after its last."""

    def __init__(self, lines: Iterable[str]) -> None:
        self.rules = [r for r in map(parsed, lines) if r]
        self.names: list[tuple[int, Callable]] = []
        self.start = self.loops = 0
        self.ends: list[tuple[int, Rule]] = []
        self.skips: list[int] = []
        at = 0
        for rule in self.rules:
            self.start |= 1 << at
            for segment in rule.segments:
                if segment is None:
                    self.loops |= 1 << at
                    self.skips.append(at)
                else:
                    self.names.append((at, re.compile(segment, re.IGNORECASE | re.DOTALL).fullmatch))
                at += 1
            self.ends.append((1 << at, rule))
            at += 1
        self.ends.reverse()  # the last rule that fits decides
        self.start = self._closed(self.start)
        self._masks: dict[str, int] = {}

    def _closed(self, state: int) -> int:
        for at in self.skips:  # in rising order, so runs of them need one round
            if state >> at & 1:
                state |= 1 << at + 1
        return state

    def _mask(self, name: str) -> int:
        if (mask := self._masks.get(name)) is None:
            mask = sum(1 << at for at, fits in self.names if fits(name))
            if len(self._masks) >= KNOWN:
                self._masks.clear()
            self._masks[name] = mask
        return mask

    def step(self, state: int, name: str) -> int:
        """The state after one more name of the path."""
        return self._closed((state & self._mask(name)) << 1 | state & self.loops)

    def decided(self, state: int, folder: bool) -> bool:
        """Whether the last rule that fits the path ignores it."""
        for bit, rule in self.ends:
            if state & bit and (folder or not rule.folders):
                return not rule.back
        return False

    def ignores(self, path: str) -> bool:
        """Whether a file, or a folder if ``path`` ends with a slash, is ignored itself or by a folder above it."""
        names = [n for n in path.split("/") if n]
        state = self.start
        for i, name in enumerate(names):
            state = self.step(state, name)
            if self.decided(state, i < len(names) - 1 or path.endswith("/")):
                return True
        return False
