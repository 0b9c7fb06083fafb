"""The script reader on layouts that line patterns miss, and on random programs whose facts are known."""

import random

import pytest

from factloom.functions import scripts
from factloom.operators import extract


def symbols(text):
    return {(n, k, e) for n, k, e, _ in scripts.facts(text).symbols}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("class K { m() { return 1 } n() {} }", {("K", "class", False), ("m", "method", False), ("n", "method", False)}),
        ("export default async function\n  f\n  (x) {\n}", {("f", "function", True)}),
        ("const a = 1, b = [2, 3], c = f(4, d)", {("a", "constant", False), ("b", "constant", False), ("c", "constant", False)}),
        ("let x: Map<string, number> = new Map<string, number>(), y", {("x", "constant", False), ("y", "constant", False)}),
        ("const { p, q } = r; for (const i of s) { var t; }", {("i", "constant", False), ("t", "constant", False)}),
        ("export const enum E { A, B }\ndeclare enum F { C }", {("E", "enum", True), ("F", "enum", False)}),
        ("export type T = { a: string; b?: { c: number } } | U", {("T", "type", True), ("a", "field", False), ("b", "field", False), ("c", "field", False)}),
        ("interface I<T extends object> extends J<T> { readonly a: T\n  b?: () => void\n  m(): void }", {("I", "interface", False), ("a", "field", False), ("b", "field", False)}),
        ("class A<T> extends mix({ z: 1 }) implements B { static #p = 1; static s = 2; 'q' = 3; [k] = 4; async *g() {} get h() { return 1 } set h(v) {} constructor() { super() } }", {("A", "class", False), ("s", "field", False), ("g", "method", False)}),
        ("class A {\n a = 1\n b: string\n c\n d = () => { const e = 1 }\n f() {}\n}", {("A", "class", False), ("a", "field", False), ("b", "field", False), ("c", "field", False), ("d", "field", False), ("e", "constant", False), ("f", "method", False)}),
        ("@dec({ x: 1 }) class A { @Input() n: string; @Out({ a: 1 })\n m() {} }", {("A", "class", False), ("n", "field", False), ("m", "method", False)}),
        ("const o = { m() {}, async n() {}, get g() { return 1 }, p: function () {}, q: 1 }", {("o", "constant", False), ("m", "method", False), ("n", "method", False)}),
        ("f(function g() {}); const h = class K2 { m() {} }", {("h", "constant", False), ("m", "method", False)}),
        ("'function a() {}'; \"class B {}\"; `function c() {} ${ (() => { function d() {} })() } class E {}` // function e() {}\n/* const f = 1 */", {("d", "function", False)}),
        ("const a = /function b() {}[/'\"]/g; if (x) /const c = '/.test(y); const d = e / f / g", {("a", "constant", False), ("d", "constant", False)}),
        ("function f(a: string): void;\nfunction f(a: any) { const b = 1 }\nconst c = 2", {("f", "function", False), ("b", "constant", False), ("c", "constant", False)}),
        ("switch (x) { case 1: { function f() {} break } default: { const z = 1 } }", {("f", "function", False), ("z", "constant", False)}),
        ("type = 1; let type2 = interface_; of(let_)", {("type2", "constant", False)}),
        ("", set()),
    ],
)
def test_symbols(text, want):
    assert symbols(text) == want


def test_imports():
    text = "import {\n  a,\n  b as c,\n  type D,\n} from './x.js'\nimport type E, { F } from \"../y\";import * as ns from './z'\nimport './side'\nimport('no'); import.meta.url\nfunction f() {}\n// import { g } from './g'\nconst s = `\nimport { h } from './h'\n`"
    got = scripts.facts(text).imports
    assert [(s, [x for x, _ in names], line) for s, names, line in got] == [("./x.js", ["a", "c", "D"], 1), ("../y", ["E", "F"], 6), ("./z", [], 6), ("./side", [], 7)]
    assert got[0][1][1] == ("c", "b") and got[1][1][0] == ("E", "default")


def test_uses():
    text = "function outer() { inner(1); new Made(); a.b.called<T>(2); opt?.(3); const s = 'text()'; return `${deep()}` }\nclass K { m() { outer() }\n f = there }\ntop()"
    got = scripts.facts(text).uses
    calls = {(c, n) for c, n, t in got if t == "calls"}
    assert calls == {("outer", "inner"), ("outer", "called"), ("outer", "opt"), ("outer", "deep"), ("m", "outer")}
    assert {("K", "there", "references"), ("outer", "Made", "references")} <= got and not any(n in ("text", "top") for _, n, _ in got)


def test_cases():
    text = "import { test } from '@playwright/test'\ndescribe('a', () => { describe(\"b\", function () {\n it(`x`, () => {}) ; it.each([1])('no') })\n test.only('y') })\ntest.describe('c', () => {\n specify('z', f) })\nother.it('no'); it(name); it('top', () => { it('in', f) }) // it('no')\n"
    got = scripts.facts(text)
    assert got.cases == [("x", ("a", "b"), 3), ("y", ("a",), 4), ("z", ("c",), 6), ("top", (), 7), ("in", (), 7)] and got.framework(text) == "playwright"
    assert scripts.facts("x").framework("describe (") == "jest" and scripts.facts("").framework("") == "unknown"


def program(rnd, depth=0):
    """A random program in a random layout, with the symbols and calls it has: ``(text, symbols, calls)``."""
    space = lambda: rnd.choice([" ", "\n", "  ", " /* function no() {} */ ", " // it('no', class No {}\n"])
    name = lambda: rnd.choice("abcdefg") + str(rnd.randrange(1000))
    out, known, calls = [], set(), set()

    def body(owner, level):
        parts = []
        for _ in range(rnd.randrange(3)):
            if rnd.random() < 0.5:
                callee = name()
                parts.append(rnd.choice([f"{callee}(1){space()};", f"this.{callee}({{ k: 'x()' }});", f"const {{ q }} = await {callee}(`${{1}} no()`);"]))
                calls.add((owner, callee))
            elif level < 3:
                parts.append(function(level + 1))
            else:
                n = name()
                known.add((n, "constant"))
                parts.append(f"let{space()}{n}{space()}= /[\"'`{{]/;")
        return "{" + space() + space().join(parts) + space() + "}"

    def function(level):
        n = name()
        known.add((n, "function"))
        return f"{rnd.choice(['', 'async '])}function{space()}{n}{space()}(x: {{ }}, y = ')'){space()}{body(n, level)}"

    def class_():
        n = name()
        known.add((n, "class"))
        members = []
        for _ in range(rnd.randrange(4)):
            m = name()
            if rnd.random() < 0.6:
                known.add((m, "method"))
                members.append(f"{rnd.choice(['', 'static ', 'private async '])}{m}{space()}(z){space()}{body(m, 1)}")
            else:
                known.add((m, "field"))
                members.append(f"{rnd.choice(['', 'readonly '])}{m}{rnd.choice(['', '?', '!'])}: Map<string, {{ }}> = '}}';")
        return f"export{space()}class{space()}{n}{space()}{{{space()}{space().join(members)}{space()}}}"

    for _ in range(rnd.randrange(1, 6)):
        out.append(rnd.choice([lambda: function(0), class_])())
    return "\n".join(out), known, calls


@pytest.mark.parametrize("seed", range(60))
def test_random_programs(seed):
    text, known, calls = program(random.Random(seed))
    got = scripts.facts(text)
    listed = {(n, k) for n, k, _, _ in got.symbols}
    assert listed == known, text
    assert {(c, n) for c, n, t in got.uses if t == "calls"} == calls, text


def test_any_text_ends(spark):
    rnd = random.Random(4)
    for _ in range(300):
        scripts.facts("".join(rnd.choice(["{", "}", "(", ")", "`", "${", "class ", "a", "\n", "'", "/", "*", "function ", "import ", "const ", ":", ";", ",", "<", "=", "\\", "é", "it('"]) for _ in range(60)))
    wide = spark.createDataFrame([("a.ts", None), ("b.ts", ""), (None, "x"), ("c.ts", "const a = 1;" * 20_000), ("c.ts", "const a = 1;")], "path string, content string")
    got = extract.script_facts(wide)
    assert extract.ts_symbols(got).count() == 2 and extract.tests(got).count() == 4
    assert extract.script_facts(wide.limit(0)).count() == 0
