"""The documents as a source tree: a file for each, of one of eight kinds, whose facts are known by construction.

Every file holds the whole text of its document, as comments, prose, a string or log lines, which must yield no facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as t
from factloom.sources.adapters import table

KINDS = ("ts", "lua", "cs", "test", "md", "json", "log", "py")
STEP = len(KINDS)
#: What begins each line of a text in a file of a kind, so that it is all comment or prose. In JSON it is one string.
LINES = {"ts": "// ", "lua": "-- ", "cs": "// ", "test": "// ", "md": "", "log": "svc note ", "py": "# "}
BREAKS = r"\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]"
#: What a text holds that has a line break other than a plain line feed.
ODD_BREAKS = ("\r", "\x0b", "\x0c", "\x85", "\u2028", "\u2029")


def _text(template: str) -> Column:
    """``template`` with ``{i}`` as the document's number, ``{p}`` the one a step before, ``{m}`` the module tested, ``{ai}``, ``{ap}`` and ``{am}`` their areas, and ``{note}``."""
    number = {"i": F.col("doc_id"), "p": F.col("doc_id") - STEP, "m": F.col("doc_id") - 3}
    named = {**number, **{f"a{k}": F.pmod(v, F.lit(3)) for k, v in number.items()}, "note": F.col("note")}
    out, rest = [], template
    while rest:
        at = min(((rest.find("{" + k + "}"), k) for k in named if "{" + k + "}" in rest), default=(len(rest), ""))
        if at[0]:
            out.append(F.lit(rest[: at[0]]))
        if at[1]:
            out.append(named[at[1]].cast("string"))
        rest = rest[at[0] + len(at[1]) + 2 :] if at[1] else ""
    return F.concat(*out)


PATHS = {"ts": "src/pkg{ai}/mod{i}.ts", "lua": "game/area{ai}/m{i}.lua", "cs": "src/cs/C{i}.cs", "test": "src/app/t{i}.test.ts", "md": "docs/d{i}.md", "json": "conf/c{i}.json", "log": "var/log/app{i}.log", "py": "lib/test_p{i}.py"}
BODIES = {
    "ts": (
        "// {note}\n",
        "import { helper{p} } from '../pkg{ap}/mod{p}.js';\n",
        "export function helper{i}(x: number) {\n  return local{i}(x);\n}\nfunction local{i}(x: number) {\n  return x;\n}\nexport class Box{i} {\n  size: number = 0;\n  grow{i}(x: number) {\n    return local{i}(x);\n  }\n}\n",
        "export function both{i}(x: number) {\n  return helper{p}(x);\n}\n",
    ),
    "lua": (
        "-- {note}\n",
        "local dep = require(\"game.area{ap}.m{p}\")\nlocal far = Loader:GetModule(\"m{p}\")\n",
        "local M{i} = {}\nfunction M{i}.run(x)\n  M{i}.step(x)\n  return dep.other(x)\nend\nM{i}.step = function(x)\nend\nreturn M{i}\n",
        "",
    ),
    "cs": ("// {note}\n", "", "public class C{i} {}\n", ""),
    "test": ("// {note}\n", "", "import { it } from 'vitest';\nimport { helper{m} } from '../pkg{am}/mod{m}';\ndescribe('suite {i}', () => {\n  it('works {i}', () => {\n    helper{m}(1);\n  });\n  it.skip('later {i}', () => {});\n});\n", ""),
    "md": ("# Notes {i}\n", "", "{note}\n", ""),
    "json": ("", "", "{\"scripts\": {}, \"note\": \"{note}\"}\n", ""),
    "log": ("", "", "2024-01-01T00:00:00Z ERROR svc {note}\n", ""),
    "py": ("# {note}\n", "", "import unittest\n", ""),
}


def source_tree(spark: SparkSession, sf_dir: str, newer: bool = False) -> DataFrame:
    """``doc_id, lang, path, content``. ``newer``: the tree after a change, without French files and with more code in English ones."""
    kind = F.col("doc_id") % STEP
    plain = F.when(t.holds(F.col("text"), *ODD_BREAKS), F.regexp_replace("text", BREAKS, "\n")).otherwise(F.col("text"))
    note = F.regexp_replace(plain, "[\\x00-\\x1f\"\\\\]", " ")
    for n, k in enumerate(KINDS):
        if k in LINES:
            note = F.when(kind == n, F.replace(plain, F.lit("\n"), F.lit("\n" + LINES[k]))).otherwise(note)
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "lang", note.alias("note"))
    made = {}
    for column, parts in (("path", {k: (v,) for k, v in PATHS.items()}), ("content", BODIES)):
        value = F.lit(None).cast("string")
        for n, k in enumerate(KINDS):
            pieces = [_text(x) if x else F.lit("") for x in parts[k]]
            if column == "content":
                pieces[1] = F.when(F.col("doc_id") >= STEP, pieces[1]).otherwise("")
                pieces[3] = F.when(F.col("doc_id") >= STEP, pieces[3]).otherwise("")
                if newer and k == "ts":
                    pieces.append(F.when(F.col("lang") == "en", _text("export function extra{i}(y: number) {\n  return y;\n}\n")).otherwise(""))
            value = F.when(kind == n, F.concat(*pieces)).otherwise(value)
        made[column] = value
    rows = docs.select("doc_id", "lang", *(v.alias(c) for c, v in made.items()))
    return rows.where("lang IS NULL OR lang <> 'fr'") if newer else rows


def _sql(template: str) -> str:
    number = {"i": "doc_id", "p": f"(doc_id - {STEP})", "m": "(doc_id - 3)"}
    named = {**number, **{f"a{k}": f"((({v}) % 3 + 3) % 3)" for k, v in number.items()}, "note": "note"}
    out = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for k, v in named.items():
        out = out.replace("{" + k + "}", f"' || {v} || '")
    return out


def _body_sql(kind: str) -> str:
    head, linked, body, tail = (_sql(x) for x in BODIES[kind])
    return f"{head} || CASE WHEN doc_id >= {STEP} THEN {linked} ELSE '' END || {body} || CASE WHEN doc_id >= {STEP} THEN {tail} ELSE '' END"


#: ``tree(doc_id, k, lang, path, content)``, the same files in SQL; ``k`` is the kind.
TREE = f"""plain AS (SELECT doc_id, doc_id % {STEP} AS k, lang, regexp_replace(text, '{BREAKS}', chr(10), 'g') AS plain FROM documents WHERE text IS NOT NULL),
noted AS (SELECT doc_id, k, lang, CASE k {' '.join(f"WHEN {n} THEN replace(plain, chr(10), chr(10) || '{LINES[x]}')" for n, x in enumerate(KINDS) if x in LINES)} ELSE regexp_replace(plain, '[\\x00-\\x1f"\\\\]', ' ', 'g') END AS note FROM plain),
tree AS (SELECT doc_id, k, lang, CASE k {' '.join(f'WHEN {n} THEN {_sql(PATHS[x])}' for n, x in enumerate(KINDS))} END AS path, CASE k {' '.join(f'WHEN {n} THEN {_body_sql(x)}' for n, x in enumerate(KINDS))} END AS content FROM noted)"""
