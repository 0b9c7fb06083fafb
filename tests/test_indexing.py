"""What the plans of the source tree and its facts hold, and how their parts behave on odd input."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.functions import conventions as c
from factloom.functions import text as t
from factloom.operators import classify, extract, relational
from factloom.plans import indexing
from factloom.sources import tree

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kept", [classify.indexable, classify.test_extractable])
def test_a_filter_on_kinds_does_not_repeat_the_votes(spark, kept):
    """Below a projection it would hold all signals once for each place where a kind stands."""
    got = plan(kept(classify.classify(tree.source_tree(spark, SF))).select("path"))
    assert got.count("pytest") == 1
    assert got.count(r"yarn\.lock") == 1


ODD_TEXTS = [
    "", "describe (", "DESCRIBE\t\n(", "descri\nbe(", "it(", "xit \r\n(", "i t(", "test", "tes(", "Test(", "latest  (", "xUnit", "NUNIT", "unit", "unİttest", "PyTest", "mstest(", "e(", "İt(", "it (", "i̇t(", "te st(",
    "@Generated", "@generateds", "un@generated x", "Generated by", "generated bye", "auto-generated", "xauto-generated", "İ Do Not Edit\r\n", "do not edits", "do  not edit", "do not\nedit",
    "\n" * 19 + "do not modify", "\n" * 20 + "do not modify", "\r\n" * 19 + "do not modify\r\n", "\r\n" * 19 + "\r\ndo not modify", "\r" * 30 + "do not modify", "automatically generated",
    "WARN", "İnfo", "x" * 509 + "warn", "x" * 508 + "warn", "İ" * 508 + "warn", '"Scripts" :', '"scripts":', "[tool.", "<PROJECT>", "plugins {", "services:", "ApiVersion :", "x" * 790 + "[tool.x", "x" * 796 + "[tool.",
]


def test_signals_are_those_of_the_patterns_alone(spark):
    """What is looked for before a pattern is tried leaves out no text that the pattern finds."""
    rows = spark.createDataFrame([(f"a{i}", x) for i, x in enumerate(ODD_TEXTS)], "path string, content string")
    lines = F.array_join(F.slice(F.split("content", "\r?\n"), 1, 20), "\n")
    patterns = {("test", 0.75): F.col("content").rlike(c.TEST_MARK), ("generated", 0.98): lines.rlike("(?i)" + "|".join(c.BANNERS)), ("log", 0.8): F.substring("content", 1, 512).rlike(c.LEVEL_WORD), ("config", 0.55): F.substring("content", 1, 800).rlike(c.CONFIG_MARK)}
    signals = F.transform(F.filter(F.array(*classify.detectors()), lambda s: s.isNotNull()), lambda s: F.struct("path", s["value"], s["confidence"]))
    got = {tuple(r[0]) for r in rows.select(F.explode(signals)).collect()}
    want = {(r.path, *signal) for signal, found in patterns.items() for r in rows.where(found).collect()}
    assert {x for x in got if x[1:] in patterns} == want
    assert {x[1:] for x in want} == set(patterns)


def test_globs_are_met_as_by_their_patterns(spark):
    globs = c.GENERATED_GLOBS + c.MANIFEST_GLOBS + c.SOURCE_GLOBS + c.EVIDENCE_GLOBS + c.TEST_GLOBS + ("a?b/**", "**", "x*?y")
    paths = [g.replace("**", "x/y").replace("*", "z") for g in globs] + ["b/q", "ab/q", "xy", "xzy", "", "a/node_modules", "node_modules/a", "a/package.json\n", "a/b.designer.cs", "q.test.ts"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    for g in globs:
        differ = rows.where(t.meets(F.col("path"), (g,)) != F.col("path").rlike(t.any_glob((g,)))).collect()
        assert not differ, g


def test_texts_with_odd_line_breaks_are_the_same_files_as_in_sql(spark, tmp_path):
    texts = ["a\r\nb", "a\rb\r\r\nc", "a\x0bb\x0cc", "a\x85b c d", "plain\nlines", "", None, "Â ‘quoted’"]
    rows = [(8 * i + k, x, "en") for i, x in enumerate(texts) for k in range(8)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"WITH {tree.TREE} SELECT path, content FROM tree").fetchall()
    made = tree.source_tree(spark, str(tmp_path))
    assert sorted((r.path, r.content) for r in made.collect()) == sorted(want)
    assert "Filter regexp_replace" not in plan(made) and "isnotnull(CASE" not in plan(made)


def _all_shapes(imports, files, extensions=c.IMPORT_EXTENSIONS):
    """Every shape of every import, tried one by one."""
    base = t.normal_path(F.concat_ws("/", F.nullif(t.dirname(F.col("from_path")), F.lit("")), "spec"))
    bare = F.regexp_replace(base, r"(?i)\.(jsx?|tsx?)$", "")
    shapes = [base, bare, *(F.concat(b, F.lit(f"{mid}{e}")) for mid in (".", "/index.") for b in (base, bare) for e in extensions)]
    tried = imports.where(F.col("spec").startswith(".")).select("import_id", F.posexplode(F.array(*shapes)).alias("pos", "path"))
    return tried.join(files.select("path"), "path").groupBy("import_id").agg(F.min_by("path", "pos").alias("path"))


def test_imports_mean_the_same_files_as_by_every_shape(spark):
    names = ["", "a", "a.js", "a.JS", "a.tsx", "a.d", "a.d.ts", "index", "a/index", "a/index.js", "a.lua", "a.ts\n", "index.ts", ".ts", "a.", "a.js.ts", "a.js/index.ts", "b.jsx", "b.jsx.js", "b"]
    every = [n + m for n in names for m in ("", ".ts", ".tsx", ".js", ".mts", ".cjs", ".TS", "/index.ts", "/index.js", "/index", "/x.ts")]
    imports = spark.createDataFrame([(f"{f}|{x}", f, x) for f in ("src/m.ts", "m.ts", "src/a/m.ts") for n in names for x in ("./" + n, "../" + n, "." + n, n)] + [("null", None, "./a"), ("nospec", "m.ts", None)], "import_id string, from_path string, spec string")
    for keep in (1, 2, 3, 5, 7):
        paths = sorted({d + x for d in ("", "src/", "src/a/") for i, x in enumerate(every) if i % keep == 0 or keep == 7 and i % 5 == 1})
        files = spark.createDataFrame([(x,) for x in [*paths, None]], "path string")
        got, want = ({tuple(r) for r in find(imports, files).collect()} for find in (relational.import_candidates, _all_shapes))
        assert got == want


def test_a_file_path_is_made_once_an_import(spark):
    imports, files = spark.createDataFrame([("1", "src/m.ts", "./a")], "import_id string, from_path string, spec string"), spark.createDataFrame([("src/a.ts",)], "path string")
    assert plan(relational.import_candidates(imports.repartition(2), files)).count("aggregate(") == 1


def test_edges_of_other_types_are_not_made(spark):
    """Degrees ask for imports and tests only; what declares, exports and contains is not made for them."""
    files = spark.createDataFrame([("a.ts", "import { b } from './b';\nexport function a() {}\n"), ("b.ts", "export const b = 1;")], "path string, content string")
    found = indexing.facts(files)["edges"]
    assert {r.type for r in found.collect()} >= {"contains", "declares", "exports", "imports"}
    kept = found.where("type IN ('imports', 'tests')")
    assert {r.type for r in kept.collect()} == {"imports"}
    assert not [x for x in ("contains", "declares", "exports") if x in plan(kept)]


LUA = [
    "local M = {}", "M = setmetatable({}, x)", "A=CreateFromMixins(B)", "N ={ }", "x = 1", "function M.a(x)", "function M:b (y)", "M.c = function(z)", "local function d(q)", "function e ()", "function\tf()", "self:a(1)", "M.c(2)", "d (3)", "e()", "f\t()",
    "end", " end ", "\tend", "endless()", "weekend", "end -- x", "return M", "return x", "  return  M ", "returned", "local dep = require('a.b')", "require \"c\"", "require ( 'd.e' )", "local far = Loader:GetModule('X.Y')", "Loader.GetModule ( \"Z\" )", "-- prose", "", "if x then", "for i in y do", "local z",
]


def test_lua_says_the_same_by_its_telling_lines(spark):
    texts = [LUA, LUA[::-1], LUA[::2] + LUA[1::2], LUA[::3] + LUA[2::3] + LUA[1::3], [x for line in LUA for x in ("function g()", line, "d()", "M.c()", "end", line)], [x for x in LUA if "end" not in x]]
    rows = extract.lines(spark.createDataFrame([(f"{i}.lua", "\r\n".join(x)) for i, x in enumerate(texts)], "path string, content string"))
    few = extract.lua_lines(rows)
    assert few.count() < rows.count()
    found = []
    for some in (rows, few):
        symbols = extract.lua_symbols(some)
        found.append([sorted(map(str, df.collect())) for df in (symbols, extract.lua_imports(some), extract.lua_calls(some, symbols))])
    assert found[0] == found[1] and all(found[0])


def test_texts_of_lua_are_read_once(spark):
    """Symbols, imports and calls go on from a checkpoint of the lines, not each from the texts."""
    files = spark.createDataFrame([("a.lua", "local A = {}\nfunction A.b()\n  c()\nend\nfunction c()\nend\n")], "path string, content string")
    found = indexing.facts(files)
    assert "split(content" not in plan(found["edges"].where("type = 'calls'"))
    assert [r.type for r in found["edges"].collect()].count("calls") == 1


def test_only_texts_that_are_read_are_written(spark, monkeypatch):
    texts = {"a.ts": "export const a = 1;", "b.lua": "local B = {}", "t/c.test.js": "it('x', () => {});", "d.md": "# D", "e.json": "{}", "f.py": "x = 1", "g.cs": "class G {}"}
    written, real = [], indexing.cut
    monkeypatch.setattr(indexing, "cut", lambda df: written.append(real(df)) or written[-1])
    found = indexing.facts(spark.createDataFrame(list(texts.items()), "path string, content string"))
    typed = next(x for x in written if "content" in x.columns)
    assert {r.path: r.content for r in typed.collect()} == {p: x if p.endswith((".ts", ".lua", ".js")) else None for p, x in texts.items()}
    assert {r.path: r.content_hash for r in found["hashes"].collect()} == {p: hashlib.sha256(x.encode()).hexdigest() for p, x in texts.items()}
