"""Facts of one TypeScript or JavaScript text: a lexer and a stack of open brackets with what they belong to.

The lexer knows comments, strings, templates with code inside, and regular expressions, so none of their insides is taken
for code; layout doesn't matter. Each bracket on the stack is a block, a class, an object, a type or a list, which tells what
a name in it is. Types written inside expressions and markup inside code are not told apart from code.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from factloom.functions import conventions as c

#: Words that are no names (fixed values of the language).
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
#: After these words an expression follows.
BEFORE_VALUE = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())
MODIFIERS = frozenset("public private protected static readonly abstract override async declare accessor get set".split())

_TOKEN = re.compile(
    r"""(?P<space>[\s﻿]+|//[^\n\r\u2028\u2029]*|/\*.*?(?:\*/|\Z))|(?P<id>[\w$#\\\u200c\u200d][\w$\\\u200c\u200d]*)|(?P<str>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)|(?P<tpl>`)"""
    r"""|(?P<sign>=>|\?\.(?!\d)|\.\.\.|[=!]==?|[<>]=|&&=?|\|\|=?|\?\?=?|\+\+|--|\*\*=?|[-+*%&|^]=|.)""",
    re.DOTALL,
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.DOTALL)
_REGEX = re.compile(r"/(?:[^/\\\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])+/[a-z]*")
_ESCAPE = re.compile(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r\n|.)", re.DOTALL)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}


class Token(NamedTuple):
    kind: str
    """``id``, ``num``, ``str``, ``tpl`` (a whole template or a part of one), ``re`` or ``sign``."""
    text: str
    at: int
    first: bool
    """Whether a line end stands before it."""


def _value(quoted: str) -> str:
    def plain(m: re.Match) -> str:
        code = m[1]
        if code[0] in "ux" and len(code) > 1:
            point = int(code.strip("ux{}"), 16)
            return chr(point) if point < 0x110000 else ""
        return _PLAIN.get(code, code)

    return _ESCAPE.sub(plain, quoted)


def tokens(text: str) -> Iterator[Token]:
    """The tokens of ``text``. A ``/`` begins a regular expression where a value may stand."""
    at, first, last = 0, True, None
    inside: list[int] = []  # of each open template: brackets open in its code
    round_: list[bool] = []  # of each open round bracket: whether a condition is in it, after which a statement follows
    ended = False  # whether the last token closed such a condition
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, found, begin = m.lastgroup, m[0], at
        at = m.end()
        if kind == "space":
            first = first or "\n" in found or "\r" in found
            continue
        if kind == "sign" and found == "/" and (ended or _value_may_stand(last)) and (r := _REGEX.match(text, begin)):
            kind, found, at = "re", r[0], r.end()
        elif kind == "tpl" or kind == "sign" and found == "}" and inside and inside[-1] == 0:
            opened = kind == "tpl"
            if not opened:
                inside.pop()
            m = _TEMPLATE.match(text, at)
            whole = text[m.end() : m.end() + 1] != "$"
            kind, found, at = "tpl" if opened and whole else "part", m[0], m.end() + (1 if whole else 2)
            if not whole:
                inside.append(0)
        elif kind == "sign" and inside and found in "{}":
            inside[-1] += 1 if found == "{" else -1
        elif kind == "id" and found[0].isdigit():
            kind = "num"
        ended = False
        if kind == "sign" and found == "(":
            round_.append(last is not None and last.kind == "id" and last.text in ("if", "while", "for", "with"))
        elif kind == "sign" and found == ")" and round_:
            ended = round_.pop()
        last = Token(kind, _value(found[1:-1] if kind == "str" else found) if kind in ("str", "tpl") else found, begin, first)
        first = False
        yield last


def _value_may_stand(last: Token | None) -> bool:
    if last is None or last.kind == "part":
        return True
    if last.kind == "sign":
        return last.text not in (")", "]", "}", "++", "--")
    return last.kind == "id" and last.text in BEFORE_VALUE


@dataclass
class Bracket:
    kind: str
    """``block``, ``class``, ``object``, ``type``, ``list`` (round or square) or ``params``."""
    owners: int = 0
    """How many owners end with it."""
    fresh: bool = True
    """Whether a member or key may begin."""
    declares: bool = False
    """Inside ``const``, ``let`` or ``var``, between its names."""
    angle: int = -1
    """Open angles of a declared name's type; -1 outside of one."""
    label: bool = False
    suite: bool = False


@dataclass
class Facts:
    symbols: list[tuple[str, str, bool, int]] = field(default_factory=list)
    """``(name, kind, exported, line)`` in order."""
    imports: list[tuple[str, tuple[tuple[str, str], ...], int]] = field(default_factory=list)
    """``(spec, ((local name, name there), ...), line)``."""
    uses: set[tuple[str, str, str]] = field(default_factory=set)
    """``(caller, name, calls or references)`` of all names met, known or not."""
    cases: list[tuple[str, tuple[str, ...], int]] = field(default_factory=list)
    """``(title, suites around it, line)``."""

    def framework(self, text: str) -> str:
        named = [c.FRAMEWORKS[s] for s, _, _ in self.imports if s in c.FRAMEWORKS]
        return named[-1] if named else "jest" if re.search(r"\b(?:describe|it|test)\s*\(", text, re.ASCII) else "unknown"


class _Reader:
    def __init__(self, text: str) -> None:
        self.tokens = [*tokens(text)]
        self.breaks = [m.start() for m in re.finditer(r"\n|\r(?!\n)|\u2028|\u2029", text)]
        self.facts = Facts()
        self.stack: list[Bracket] = [Bracket("block")]
        self.owners: list[str] = []
        self.suites: list[str] = []
        self.waiting: tuple[int, str] | None = None  # a declared body is to open at this depth, of this kind
        self.names: set[int] = set()  # tokens that are declared names
        self.suite: tuple[int, str] | None = None  # a suite's title, and the bracket that holds it
        self.exported = False  # whether the names being declared are
        self.i = 0

    def line(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1

    def text(self, i: int) -> str:
        """The text of a token that is a word or a sign; empty for others."""
        return self.tokens[i].text if 0 <= i < len(self.tokens) and self.tokens[i].kind in ("id", "sign") else ""

    def name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "id" and self.tokens[i].text not in RESERVED and self.tokens[i].text[0] != "#"

    def begins(self, i: int) -> bool:
        """Whether a statement may begin at token ``i``."""
        if i == 0:
            return True
        before = self.tokens[i - 1]
        if before.kind == "sign":
            return before.text in (";", "}", ")") or before.text == "{" and self.stack[-1].kind == "block" or before.text == ":" and self.stack[-1].kind == "block" and not self.stack[-1].declares
        return before.text in ("else", "do") or self.tokens[i].first and not (before.kind == "id" and before.text in BEFORE_VALUE)

    def add(self, i: int, kind: str, exported: bool = False) -> str:
        self.facts.symbols.append((self.tokens[i].text, kind, exported, self.line(self.tokens[i].at)))
        self.names.add(i)
        return self.tokens[i].text

    def own(self, name: str, body: str) -> None:
        """What follows belongs to ``name``, to the end of the body of the kind ``body``."""
        self.owners.append(name)
        self.waiting = (len(self.stack), body)

    def read(self) -> Facts:
        while self.i < len(self.tokens):
            token, top = self.tokens[self.i], self.stack[-1]
            if token.kind == "id":
                self.word(token, top)
            elif token.kind == "sign":
                self.sign(token, top)
            else:
                top.fresh = False
            self.i += 1
        return self.facts

    def word(self, token: Token, top: Bracket) -> None:
        i, text = self.i, token.text
        if top.kind == "class" and (top.fresh or token.first and self._ended(i)) and self.member(i):
            return
        if top.kind == "object" and top.fresh and self.key(i):
            return
        if top.kind == "type" and (top.fresh or token.first and self._ended(i)):
            top.fresh = False
            if self.name(i + (text == "readonly" and self.name(i + 1))) and self.text((at := i + (text == "readonly" and self.name(i + 1))) + 1) in (":", "?") and (self.text(at + 1) == ":" or self.text(at + 2) == ":"):
                self.add(at, "field")
                self.i = at
                self.refer(at)
                return
        top.fresh = False
        if text == "import" and len(self.stack) == 1 and self.text(i + 1) not in ("(", "."):
            return self.imported(i)
        if text in ("case", "default") and top.kind == "block":
            top.label = True
        start = i
        while self.text(start - 1) in ("export", "default", "declare", "abstract", "async") or text == "enum" and self.text(start - 1) == "const":
            start -= 1
        exported = any(self.text(j) in ("export", "default") for j in range(start, i))
        if text in ("function", "class", "interface", "type", "enum", "const", "let", "var") and self.text(i - 1) != ".":
            at = i + 1 + (text == "function" and self.text(i + 1) == "*")
            if self.name(at) and (self.begins(start) or exported):
                if text in ("function", "class"):
                    self.own(self.add(at, text, exported), "block" if text == "function" else "class")
                    self.i = at
                    return
                if text in ("interface", "enum") or text == "type" and self.text(at + 1) in ("=", "<"):
                    self.add(at, text, exported)
                    self.refer(at)
                    if text != "type":
                        self.waiting = (len(self.stack), "type" if text == "interface" else "enum")
                    self.i = at
                    return
            if text in ("const", "let", "var") and self.text(i + 1) != "enum" and (text != "let" or self.name(i + 1) or self.text(i + 1) in ("{", "[")):
                top.declares, top.angle, self.exported = True, -1, exported
                self.declared(i + 1)
                return
            if text in ("class", "function"):  # an expression: its body belongs to what is around it
                self.waiting = (len(self.stack), "class" if text == "class" else "block")
                if self.name(at):
                    self.names.add(at)
        if text not in RESERVED:
            self.refer(i)

    def _ended(self, i: int) -> bool:
        """Whether the token before ``i`` may end a member that has no semicolon."""
        before = self.tokens[i - 1]
        return before.kind != "sign" and not (before.kind == "id" and before.text in BEFORE_VALUE) or before.text in (")", "]", "}", "!", ">")

    def member(self, i: int) -> bool:
        """A member of a class from token ``i`` on, if one is named there."""
        j, words = i, set()
        while self.text(j) in MODIFIERS and self.text(j + 1) not in ("(", "<", ":", "=", ";", "?", "!", "}"):
            words.add(self.text(j))
            j += 1
        if self.text(j) == "*":
            j += 1
        self.stack[-1].fresh = False
        if not self.name(j):
            self.i = max(i, j - 1)  # a computed, quoted or private name is no symbol
            return j > i
        self.i = j
        after = self.text(j + 1)
        after = self.text(j + 2) if after in ("?", "!") and self.text(j + 2) in ("(", "<") else after
        if after in ("(", "<"):
            if words & {"get", "set"} or self.text(j) == "constructor":
                self.names.add(j)
                self.waiting = (len(self.stack), "block")
            else:
                self.own(self.add(j, "method"), "block")
        else:
            self.add(j, "field")
            self.refer(j)
        return True

    def key(self, i: int) -> bool:
        """A method of an object from token ``i`` on, if there is one."""
        j, words = i, set()
        while self.text(j) in ("async", "get", "set") and self.text(j + 1) not in ("(", "<", ":", ",", "}"):
            words.add(self.text(j))
            j += 1
        if self.text(j) == "*":
            j += 1
        self.stack[-1].fresh = False
        if not self.name(j) or self.text(j + 1) not in ("(", "<"):
            return False
        self.i = j
        if words & {"get", "set"}:
            self.names.add(j)
            self.waiting = (len(self.stack), "block")
        else:
            self.own(self.add(j, "method"), "block")
        return True

    def declared(self, i: int) -> None:
        """A name of a ``const``, ``let`` or ``var`` at token ``i``, if one is there."""
        if self.name(i) and (self.text(i + 1) in ("=", ":", ",", ";", "!", "of", "in", ")", "}", "") or i + 1 >= len(self.tokens) or self.tokens[i + 1].first):
            self.add(i, "constant", self.exported)
            self.refer(i)
            self.i = i
            if self.text(i + 1) in (":", "!"):
                self.stack[-1].angle = 0

    def imported(self, i: int) -> None:
        line, j, names, clause = self.line(self.tokens[i].at), i + 1, [], []
        while j < len(self.tokens) and self.tokens[j].kind != "str" and self.tokens[j].text != ";":
            clause.append(j)
            j += 1
        self.i = j
        if j >= len(self.tokens) or self.tokens[j].kind != "str":
            return
        k, braces = 0, False
        if clause and self.text(clause[0]) == "type" and len(clause) > 1 and self.text(clause[1]) not in ("from", ","):
            k = 1
        while k < len(clause):
            word, after = self.text(clause[k]), self.text(clause[k] + 1)
            if word in ("{", "}"):
                braces = word == "{"
            elif word == "*":
                k += 2  # a name for the whole module is none of its symbols
            elif braces and word != ",":
                if word == "type" and after not in (",", "}", "as"):
                    k += 1
                    word, after = self.text(clause[k]), self.text(clause[k] + 1)
                there = word or self.tokens[clause[k]].text
                if after == "as":
                    k += 2
                    word = self.text(clause[k])
                names.append((word, there))
            elif word not in (",", "from", "=", "") and not braces:
                names.append((word, "default"))
            k += 1
        self.facts.imports.append((self.tokens[j].text, tuple(names), line))

    def refer(self, i: int) -> None:
        """The name at token ``i`` is met; it may be called too, or begin a test."""
        text = self.tokens[i].text
        if self.owners:
            self.facts.uses.add((self.owners[-1], text, "references"))
        if i in self.names:
            return
        after = i + 1 + (self.text(i + 1) == "?." and self.text(i + 2) == "(")
        if self.text(after) == "<":
            after = self._past_angles(after)
        if self.text(after) != "(":
            return
        head = i
        while self.text(head - 1) in (".", "?.") and head >= 2 and self.tokens[head - 2].kind == "id":
            head -= 2
        if self.text(head - 1) == "new":
            return
        if self.owners:
            self.facts.uses.add((self.owners[-1], text, "calls"))
        if self.text(head - 1) in (".", "?."):
            return
        called = "".join(self.tokens[j].text for j in range(head, i + 1))
        if after + 1 < len(self.tokens) and self.tokens[after + 1].kind in ("str", "tpl") and self.text(after + 2) in (",", ")"):
            title = self.tokens[after + 1].text
            if called in c.SUITE_CALLS and title:
                self.suite = (after, title)
            elif called in c.CASE_CALLS and title:
                self.facts.cases.append((title, tuple(self.suites), self.line(self.tokens[head].at)))

    def _past_angles(self, i: int) -> int:
        """The token after the angles that open at ``i``, if they hold only what types do; else ``i``."""
        depth, j = 0, i
        while j < len(self.tokens) and j < i + 200:
            text = self.text(j)
            depth += {"<": 1, ">": -1}.get(text, 0)
            if depth == 0:
                return j + 1
            if text in (";", "&&", "||", "(", ")", "}", "=="):
                return i
            j += 1
        return i

    def sign(self, token: Token, top: Bracket) -> None:
        text = token.text
        if text in ("(", "["):
            opened = Bracket("list")
            if self.suite and self.suite[0] == self.i:
                self.suites.append(self.suite[1])
                opened.suite, self.suite = True, None
            elif text == "(" and self.waiting and self.waiting[0] == len(self.stack):
                opened.kind = "params"
            self.stack.append(opened)
        elif text == "{":
            self.stack.append(self.opened(top))
        elif text in (")", "]", "}"):
            if len(self.stack) > 1:
                gone = self.stack.pop()
                if gone.suite:
                    self.suites.pop()
                for _ in range(gone.owners):
                    self.owners.pop()
                if text == "}":
                    self.stack[-1].fresh = self.stack[-1].kind == "class" and gone.kind == "block"
            if self.waiting and self.waiting[0] > len(self.stack):
                self.waiting = None
        elif text in (";", ","):
            if text == ";" and self.waiting and self.waiting[0] == len(self.stack):  # a signature without a body
                if self.waiting[1] in ("block", "class") and self.owners and self._pushed():
                    self.owners.pop()
                self.waiting = None
            if text == ";":
                top.declares, top.angle = False, -1
            elif top.declares and top.angle <= 0:
                top.angle = -1
                self.declared(self.i + 1)
            top.fresh = text == ";" and top.kind in ("class", "type") or top.kind in ("object", "type")
        else:
            if top.angle >= 0:
                top.angle = -1 if text == "=" and top.angle == 0 else max(0, top.angle + {"<": 1, ">": -1}.get(text, 0))
            if text == ":":
                top.label = False
            if text == "*" and top.kind in ("class", "object") and top.fresh:
                (self.member if top.kind == "class" else self.key)(self.i)
            elif text != "@":
                top.fresh = False
            elif top.kind == "class":  # a decorator stands before a member
                self.i += 1
                while self.text(self.i + 1) == "." and self.name(self.i + 2):
                    self.refer(self.i)
                    self.i += 2
                self.refer(self.i)
                top.fresh = True

    def _pushed(self) -> bool:
        """Whether the waiting body has an owner of its own."""
        return len(self.owners) > sum(b.owners for b in self.stack)

    def opened(self, top: Bracket) -> Bracket:
        """What a curly bracket opens, by what stands before it and around it."""
        before = self.tokens[self.i - 1] if self.i else None
        sign = before.text if before is not None and before.kind == "sign" else ""
        typed = sign in (":", "|", "&", "<", "=>") or before is not None and before.kind == "id" and before.text in ("is", "keyof")
        if self.waiting and self.waiting[0] == len(self.stack) and not (typed and sign != "=>" and self.waiting[1] != "enum"):
            _, kind = self.waiting
            self.waiting = None
            owned = int(kind in ("block", "class") and self._pushed())
            return Bracket("list" if kind == "enum" else kind, owners=owned)
        if self.waiting and self.waiting[0] == len(self.stack) or top.kind in ("type", "params") and typed or top.angle >= 0 and typed or top.kind == "class" and sign == ":":
            return Bracket("type")
        if sign == "=" and self._alias(self.i - 1) or sign in ("|", "&") and top.kind == "block" and self._alias(self.i - 1):
            return Bracket("type")
        if sign == "=>" or before is None or sign in (";", "{", "}", ")"):
            return Bracket("block")
        if sign == ":" and top.kind == "block" and top.label is False and not top.declares:
            return Bracket("block")
        if sign or before.kind == "id" and before.text in (BEFORE_VALUE - {"do", "else"}) or before.kind == "part":
            return Bracket("object")
        return Bracket("block")

    def _alias(self, i: int) -> bool:
        """Whether the value at ``i`` belongs to ``type name =``."""
        while i > 0 and self.text(i) not in (";", "{", "}"):
            if self.text(i) == "type" and self.name(i + 1) and self.text(i + 2) in ("=", "<") and (self.begins(i) or self.text(i - 1) in ("export", "declare")):
                return True
            i -= 1
        return False


def facts(text: str) -> Facts:
    return _Reader(text).read()
