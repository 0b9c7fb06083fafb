"""Operators on small inline frames, with the odd cases that the driver's tables lack."""

import json
import os
import random

from pyspark.sql import functions as F

from factloom.functions import text as t
from factloom.operators import classify, graph, incidents, relational, review, rules, search, telemetry
from factloom.plans import tools
from factloom.sources import files, logs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_paths_and_levels(spark):
    lit = F.lit
    assert one(spark, t.normal_path(lit("/a/./b/../c//d"))) == "/a/c/d" and one(spark, t.normal_path(lit("a\\b\\..\\c"))) == "a/c"
    assert [one(spark, t.language(lit(x))) for x in ("a.mts", "a.hpp", "a.ps1", "a.GQL", "a.jsonc")] == ["typescript", "cpp", "powershell", "graphql", "json"]
    assert one(spark, t.extension(lit("a.b/c.TSX"))) == "tsx" and one(spark, t.extension(lit(".env"))) == ""
    assert one(spark, t.language(lit("x/y.lua"))) == "lua" and one(spark, t.language(lit("x.zig"))) == "zig" and one(spark, t.language(lit("x"))) == "unknown"
    assert one(spark, t.reference_key(lit("Game.Core:Spells/Attr.lua"))) == "game/core/spells/attr"
    assert one(spark, t.suffixes(lit("a/b/c"))) == ["a/b/c", "b/c", "c"]
    assert one(spark, t.common_prefix(F.array(lit("a"), lit("b")), F.array(lit("a"), lit("c")))) == 1
    assert one(spark, t.common_prefix(F.array(lit("a")), F.array(lit("a"), lit("c")))) == 1
    assert [one(spark, t.level(lit(x))) for x in ("WARNING", "Fatal", "x")] == ["warn", "fatal", "unknown"]
    assert one(spark, t.redacted(F.create_map(lit("Token"), lit("a"), lit("b"), lit("c")))) == {"Token": "[redacted]", "b": "c"}
    assert t.words("foo(bar) foo  a.b-c") == ["foo", "bar", "a.b-c"]
    assert [bool(__import__("re").match(t.glob_regex(g), p)) for g, p in (("**/x", "a/b/x"), ("*.ts", "a/b.ts"), ("a/*.ts", "a/b.ts"), ("**/{a,b}", "x/a"))] == [True, False, True, False]


def test_log_lines_and_json(spark):
    content = "2024-01-01T00:00:00Z ERROR api boom\n\nplain words here\r\n2024 warning x"
    df = spark.createDataFrame([("src", None, "p.log", "mtime", content)], "source_name string, service string, path string, mtime string, content string")
    got = [tuple(r) for r in logs.parse_lines(logs.lines(df)).orderBy("line_no").select("line_no", "timestamp", "level", "service", "message").collect()]
    assert got == [(1, "2024-01-01T00:00:00Z", "error", "api", "boom"), (2, "mtime", "unknown", "src", "plain words here"), (3, "mtime", "unknown", "src", "2024 warning x")]
    j = spark.createDataFrame([("src", "conf", "p", i, "mtime", x) for i, x in enumerate(['{"time":"T","lvl":"WARNING","serviceName":"l","msg":"m"}', "{broken", '{"level":5,"message":"n","severity":"error","name":"x"}'])], "source_name string, service string, path string, line_no int, mtime string, line string")
    got = [tuple(r) for r in logs.parse_jsonl(j).orderBy("line_no").select("line_no", "timestamp", "level", "service", "message").collect()]
    assert got == [(0, "T", "warn", "l", "m"), (2, "mtime", "unknown", "conf", "n")]


def test_log_sources(spark):
    told = {p: one(spark, logs.inferred_source(F.lit(p))) for p in ("services/api/logs/server.log", "logs/web/x.log", "log/a.jsonl", "var/log/nginx.access.log", "app.log", "a/src/run.out")}
    assert {p: s.service for p, s in told.items()} == {"services/api/logs/server.log": "api", "logs/web/x.log": "web", "log/a.jsonl": "a", "var/log/nginx.access.log": "nginx", "app.log": "app", "a/src/run.out": "src"}
    assert told["services/api/logs/server.log"].name == "auto-services-api-server" and told["app.log"].name == "auto-app-app" and told["log/a.jsonl"].format == "jsonl"
    assert [one(spark, logs.looks_like_log(F.lit(p))) for p in ("var/server.out", "x/access.txt", "x/a.out", "x/trace.txt", "x/logs/y", "blogs/y")] == [True, True, True, False, True, False]
    assert logs.config('sources:\n  - path: "a.log"\n    name: n\n    format: jsonl\n') == [{"name": "n", "path": "a.log", "service": None, "format": "jsonl"}]
    wanted = spark.createDataFrame([("a.log", "a", None, "line"), ("b.jsonl", "b", "s", "jsonl"), ("c.log", "c", None, "line")], "path string, source_name string, service string, format string")
    there = spark.createDataFrame([("a.log", "m", "t ERROR x y\nt ERROR x y"), ("b.jsonl", "m", '{"msg":"z"}')], "path string, mtime string, content string")
    events, warnings = logs.collected(wanted, there)
    assert [r.path for r in warnings.collect()] == ["c.log"] and events.count() == 3 and len({r.id for r in events.collect()}) == 3
    schema = "path string, source_name string, service string, format string"
    both = logs.configured_sources(spark.createDataFrame([("a", "d", "d", "line"), ("b", "d", "d", "line")], schema), spark.createDataFrame([("a", "c", "c", "jsonl")], schema))
    assert {r.path: r.source_name for r in both.collect()} == {"a": "c", "b": "d"}


def test_git(spark):
    s = logs.git_status(spark.createDataFrame([(" M a.ts",), ("R  old.ts -> new.ts",), ("?? n.ts",), ("AM x",)], "line string"))
    assert [tuple(r) for r in s.collect()] == [("a.ts", "modified", None), ("new.ts", "renamed", "old.ts"), ("n.ts", "untracked", None), ("x", "added", None)]
    g = logs.git_log(spark.createDataFrame([("s1\u001fann\u001f2024\u001ffix\u001e\ns2\u001fbob\u001f2023\u001fadd\u001e",)], "raw string"))
    assert [tuple(r) for r in g.collect()] == [("s1", "ann", "2024", "fix"), ("s2", "bob", "2023", "add")]


def test_configurations(spark, tmp_path):
    assert rules.load(spark, str(tmp_path)) is None and logs.load_config(spark, str(tmp_path)) == []
    (tmp_path / "architecture-rules.yml").write_text("rules:\n  - id: late\n")
    (tmp_path / "architecture-rules.json").write_text(json.dumps({"rules": [{"id": "first", "kind": "forbid"}]}))
    (tmp_path / "log-intel.yaml").write_text("sources:\n  - path: a.log\n")
    assert [r.id for r in rules.load(spark, str(tmp_path)).collect()] == ["first"]
    assert logs.load_config(spark, str(tmp_path)) == [{"name": "a.log", "path": "a.log", "service": None, "format": "line"}]


def test_incident_ties_and_ids(spark):
    long = "x" * 130
    rows = [(1, 1, "a", "error", long + "1", "t1"), (2, 2, "a", "fatal", long + "2", "t1"), (3, 3, "a", "info", long, "t9"), (4, 4, "b", "error", "m", "t0")]
    got = {r.service: r for r in incidents.incidents(spark.createDataFrame(rows, "id bigint, seq bigint, service string, level string, message string, timestamp string")).collect()}
    assert got["a"].n == 2 and got["a"].latest_event_id == 2 and got["a"].severity == "fatal" and got["b"].n == 1


def test_graph_chain_cycle_and_diamond(spark):
    e = spark.createDataFrame([("a", "b", "imports"), ("b", "c", "imports"), ("c", "a", "imports"), ("a", "x", "imports"), ("x", "c", "imports"), ("a", "c", "tests"), ("q", "gone", "imports")], "source_id string, target_id string, type string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.depth) for r in graph.dependencies(e, seeds, 2).collect()} == {("b", 1), ("x", 1), ("c", 2)}
    assert {r.id for r in graph.dependents(e, seeds, 1).collect()} == {"c"}
    assert graph.walk(e, seeds, 0).count() == 1
    assert graph.walked_edges(e, graph.walk(e, seeds, 2), 2).count() == 4
    assert [r.id for r in graph.shortest_path(e, "a", "c").orderBy("pos").collect()] == ["a", "b", "c"]
    assert graph.shortest_path(e, "a", "gone").count() == 0
    costs = {r.id: (r.cost, r.path) for r in graph.weighted_paths(e, "a", {"tests": 1}).collect()}
    assert costs["c"] == (1, ["a", "c"]) and costs["a"] == (0, ["a"])


def test_rules(spark):
    yaml = 'rules:\n  - id: r1\n    from: "src/api/**"\n    to: "src/lib/**"\n    severity: error\n    except:\n      - from: "src/api/ok.ts"\n  - id: r2\n    kind: allow\n    from: "src/ui/**"\n    to: "src/model/**"\n    allowGenerated: true\n'
    parsed = rules.parse(yaml)
    assert [r["kind"] for r in parsed] == ["forbid", "allow"] and parsed[0]["except"] == [{"from": "src/api/ok.ts"}]
    assert rules.parse(json.dumps({"rules": [{"id": "j"}]})) == [{"id": "j"}]
    edges = [("1", "src/api/a.ts", "src/lib/m.ts"), ("2", "src/api/ok.ts", "src/lib/m.ts"), ("3", "src/ui/v.ts", "src/db/x.ts"), ("4", "src/ui/v.ts", "src/model/x.ts"), ("5", "src/ui/v.ts", "src/db/x.d.ts"), ("6", "z", "z")]
    got = rules.violations(spark.createDataFrame(edges, "edge_id string, source_path string, target_path string"), rules.table(spark, parsed))
    assert {(r.edge_id, r.rule_id) for r in got.collect()} == {("1", "r1"), ("3", "r2")}


def test_hybrid_fold(spark):
    hits = [("e", 1, 0.5, 0.5, None, 1), ("e", 2, 0.99, 0.45, "w", 1), ("e", 3, 0.1, 0.0, "v", 1), ("f", 1, 0.3, 0.0, "w", 1), ("m", 2, 0.65, 0.18, "w", 3)]
    labels = spark.createDataFrame([(x, x.upper()) for x in "efm"], "id string, label string")
    got = [(r.id, r.tokens, round(r.score, 6)) for r in search.hybrid(spark.createDataFrame(hits, "id string, seq int, score double, bonus double, token string, n bigint"), labels).collect()]
    assert got == [("e", 2, round(1.44 + 0.45 + 0.5, 6)), ("m", 1, round(0.83 + 0.36 + 0.25, 6)), ("f", 1, 0.55)]


def test_resolve_and_candidates(spark):
    cat = spark.createDataFrame([("src/game/Spells/Pipeline.lua", "lua"), ("src/other/Pipeline.ts", "typescript"), ("src/game/core/init.lua", "lua")], "path string, language string")
    refs = spark.createDataFrame([(1, "Pipeline", "src/game/Spells/Use.lua", "lua"), (2, "other.Pipeline", "src/x.ts", "typescript"), (3, "Nothing", "a", "lua")], "ref_id int, reference string, from_path string, language string")
    refs = refs.withColumn("reference", F.regexp_replace("reference", r"\.", "/"))
    assert {r.ref_id: r.path for r in relational.resolve(refs, cat).collect()} == {1: "src/game/Spells/Pipeline.lua", 2: "src/other/Pipeline.ts"}
    folders = spark.createDataFrame([("lib/core/init.lua", "lua"), ("lib/core.py", "python")], "path string, language string")
    assert [(r.path, r.score) for r in relational.resolve(spark.createDataFrame([(1, "lib.core", "x.lua", "lua")], "ref_id int, reference string, from_path string, language string").withColumn("reference", F.lit("lib/core")), folders).collect()] == [("lib/core/init.lua", 30 + 20 + 10 - 2 + 5)]
    fs = spark.createDataFrame([("src/lib/math.ts",), ("src/lib/index.ts",), ("src/lib/math.js",), ("src/api/y.mts",), ("src/api/z",), ("src/api/w.ts",), ("src/api/v/index.cjs",)], "path string")
    imp = spark.createDataFrame([(i, "src/api/a.ts", x) for i, x in enumerate(["../lib/math", "../lib", "./none", "../lib/math.js", "./y", "./z.js", "./w.js", "./v.jsx", "pkg"])], "import_id int, from_path string, spec string")
    assert {r.import_id: r.path for r in relational.import_candidates(imp, fs).collect()} == {0: "src/lib/math.ts", 1: "src/lib/index.ts", 3: "src/lib/math.js", 4: "src/api/y.mts", 5: "src/api/z", 6: "src/api/w.ts", 7: "src/api/v/index.cjs"}


def test_tables(spark):
    old = spark.createDataFrame([(1, "a", "c1"), (2, "b", "c1")], "id int, v string, created_at string")
    new = spark.createDataFrame([(2, None, "c2"), (3, "d", "c2")], "id int, v string, created_at string")
    assert {tuple(r) for r in relational.upsert(old, new, ["id"]).collect()} == {(1, "a", "c1"), (2, None, "c1"), (3, "d", "c2")}
    rep = relational.last_wins(spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b")], "k int, seq int, v string"), ["k"])
    assert [tuple(r) for r in rep.collect()] == [(1, 3, "c")]
    p = spark.createDataFrame([("a/b/c.ts",), ("x.ts",)], "path string")
    r = spark.createDataFrame([("a",), ("a/b",), ("a/bc",)], "root string")
    assert {x.path: x.root for x in relational.longest_prefix(p, "path", r).collect()} == {"a/b/c.ts": "a/b", "x.ts": None}


def test_classify(spark):
    kinds = {
        "src/a.ts": ("export const x = 1", "source"), "src/a.test.ts": ("describe('x', () => {})", "test"), "src/gen/x.generated.ts": ("", "generated"), "docs/a.md": ("# T", "doc"), "x/package.json": ("{}", "manifest"), "logs/a.log": ("", "log"),
        "a.png": ("", "binary"), "b": ("", "unknown"), "c.ts": ("// @generated", "generated"), "p/test_a.py": ("", "test"), "p/a_test.go": ("", "test"), "x/a.min.js": ("", "generated"), "x/a.pb.go": ("", "generated"), "q/vendor/a.js": ("", "generated"),
        "x/pom.xml": ("", "manifest"), "package.json": ("{}", "config"), "p/ATest.java": ("", "source"), "x/a.cs": ("using Xunit;", "test"), "x/b.ts": ("split(1)", "test"), "x/c.ts": ("// warning", "log"), "adr/1": ("", "doc"), "x/Dockerfile": ("", "config"),
        "x/d.ts": ("apiVersion: 1", "config"), "x/e.ts": ("// do not modify", "generated"), "var/server.out": ("", "log"),
    }
    got = {r.path: r.kind for r in classify.classify(spark.createDataFrame([(p, c) for p, (c, _) in kinds.items()], "path string, content string")).collect()}
    assert got == {p: k for p, (_, k) in kinds.items()}
    hinted = classify.classify(spark.createDataFrame([("out2/a.ts", ""), ("Specs/b.ts", ""), ("c.ts", None)], "path string, content string"), generated_dirs=("out2",), test_roots=("specs",))
    assert [(r.kind, r.language, r.generated) for r in hinted.orderBy("path").collect()] == [("test", "typescript", False), ("source", "typescript", False), ("generated", "typescript", True)]


def test_workspace_files(spark, tmp_path):
    for path, text in {"package.json": '{"name":"w","workspaces":["packages/*"]}', "packages/a/package.json": '{"name":"a"}', "src/x.ts": "x", "node_modules/z.ts": "z", "tmpx/skip.ts": "s", "tmpx/keep.ts": "k", "bad/package.json": "{", "x.unknown": "u", ".env.sample": "e", "target/t.ts": "t"}.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(text)
    found = files.discover(spark, str(tmp_path))
    assert {r.rel_path for r in found.collect()} == {"package.json", "packages/a/package.json", "src/x.ts", "tmpx/skip.ts", "tmpx/keep.ts", "bad/package.json"} | {p for p in [".env.sample"] if p in {r.rel_path for r in found.collect()}}
    rulings = ["tmpx/*.ts", "!keep.ts", "# note"]
    assert "tmpx/skip.ts" not in {r.rel_path for r in files.not_ignored(found, rulings).collect()} and files.not_ignored(found, rulings).count() == found.count() - 1
    hints = files.manifest_hints(found)
    assert {(r.root, r.name, tuple(r.source_roots), tuple(r.package_roots)) for r in hints.collect()} == {("", "w", ("src", "app"), ("packages",)), ("packages/a", "a", ("packages/a/src", "packages/a/app"), ("packages/a",))}
    assert ("ignored", "packages/a/dist") in {tuple(r) for r in files.conventions(hints).collect()}
    assert {r.root for r in files.packages(hints, "ws").collect()} == {"", "packages/a"}


def test_telemetry_and_packing(spark):
    calls = spark.createDataFrame([("s", i, "t" if i % 2 else "u", i != 2, 10 * i, "out" * 400) for i in range(6)], "session string, seq int, tool string, success boolean, duration_ms bigint, output string")
    assert [r.seq for r in telemetry.filtered(calls, tool="u", limit=2).orderBy("seq").collect()] == [2, 4]
    s = telemetry.stats(calls).first()
    assert (s.total, s.succeeded, s.failed, s.mean_ms) == (6, 5, 1, 25)
    assert telemetry.report(calls).first().markdown.count("\n") == 5
    chunks = spark.createDataFrame([("g", 1, 1, 6), ("g", 2, 2, 9), ("g", 3, 3, 4)], "grp string, priority int, id bigint, tokens bigint")
    assert {r.id: r.included for r in review.packed(chunks, "grp", 10).collect()} == {1: True, 2: False, 3: True}
    rnd = random.Random(1)
    made = [(rnd.choice("ab"), rnd.randrange(50), i, rnd.randrange(30)) for i in range(400)] + [(None, 1, 1000, 5), ("a", None, 1001, 5), ("a", 3, 1002, 500)]
    want = {}
    for g in ("a", "b", None):
        used = 0
        for _, _, i, n in sorted((r for r in made if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            want[i] = used + n <= 200
            used += n * want[i]
    got = review.packed(spark.createDataFrame(made, "grp string, priority int, id bigint, tokens bigint"), "grp", 200)
    assert {r.id: r.included for r in got.collect()} == want and review.packed(chunks.limit(0), "grp", 10).count() == 0


def test_empty_answer_has_its_confidence(spark):
    df = spark.createDataFrame([("a",)], "id string")
    assert [tuple(r) for r in tools.with_confidence(df, 0.9, 0.2).collect()] == [("a", 0.9)]
    assert [tuple(r) for r in tools.with_confidence(df.limit(0), 0.9, 0.2).collect()] == [(None, 0.2)]


LUA = """local M = {}
local util = require("lib.util")
local P = Core:GetModule("Pipeline")

function M.run(x)
  helper(x)
  return util.go(x)
end
function M:stop()
  self:run()
  util.go(1)
end
local function helper(y)
  print(y)
end
return M
"""
TS = """import { add, type Sum } from '../lib/math';
import fs from 'fs';
export function total(a: number) {
  // add(1)
  return add(a, 'total(') + twice(a);
}
const twice = (x) => x * 2;
export interface Order {
  id: string;
}
export class Cart {
  private items: number = 0;
  public sum(): number {
    return this.total(this.items);
  }
}
"""
LUA_TABLES = """local Mix = CreateFromMixins(Base)
local Meta = setmetatable({}, {})
A.B.go = function(self)
  open()
end
function Mix:act()
  A.go()
end
function open()
end
  return Mix
"""
TEST = """import { it } from 'vitest';
describe('outer', () => {
  describe("inner", () => {
    it('works', () => {});
  });
  test.skip(`later`, () => {});
});
"""


def test_extraction(spark):
    from factloom.operators import extract

    files_ = spark.createDataFrame([("a.lua", LUA)], "path string, content string")
    rows = extract.lines(files_)
    symbols = extract.lua_symbols(rows)
    assert {(r.key, r.kind, r.exported) for r in symbols.collect()} == {("table:M", "constant", True), ("member:M.run", "method", True), ("member:M.stop", "method", True), ("function:helper", "function", False)}
    assert {(r.reference, r.confidence) for r in extract.lua_imports(rows).collect()} == {("lib.util", 0.75), ("Pipeline", 0.72)}
    assert {(r.caller, r.callee, r.confidence) for r in extract.lua_calls(rows, symbols).collect()} == {("member:M.run", "function:helper", 0.65), ("member:M.stop", "member:M.run", 0.72)}
    rows = extract.lines(spark.createDataFrame([("b.lua", LUA_TABLES)], "path string, content string"))
    symbols = extract.lua_symbols(rows)
    assert {(r.key, r.exported) for r in symbols.collect()} == {("table:Mix", True), ("table:Meta", False), ("table:A.B", False), ("member:A.B.go", False), ("member:Mix.act", True), ("function:open", True)}
    assert {(r.caller, r.callee) for r in extract.lua_calls(rows, symbols).collect()} == {("member:A.B.go", "function:open"), ("member:Mix.act", "member:A.B.go")}
    rows = extract.script_facts(spark.createDataFrame([("a.ts", TS)], "path string, content string"))
    symbols, imports = extract.ts_symbols(rows), extract.ts_imports(rows)
    assert {(r.name, r.kind, r.exported) for r in symbols.collect()} == {("total", "function", True), ("twice", "constant", False), ("Order", "interface", True), ("id", "field", False), ("Cart", "class", True), ("items", "field", False), ("sum", "method", False)}
    assert [(r.spec, r.names) for r in imports.collect()] == [("../lib/math", ["add", "Sum"])]
    assert {(r.caller, r.name, r.type, r.confidence) for r in extract.ts_uses(rows).collect()} == {
        ("total", "add", "calls", 0.65), ("total", "add", "references", 0.6), ("total", "twice", "calls", 0.95), ("total", "twice", "references", 0.9), ("Cart", "items", "references", 0.9), ("sum", "total", "calls", 0.95), ("sum", "total", "references", 0.9), ("sum", "items", "references", 0.9),
    }
    one_test = spark.createDataFrame([("x.test.ts", TEST), ("y.test.ts", "nothing here")], "path string, content string")
    got = {(r.path, r.suite, r.title, r.framework) for r in extract.tests(extract.script_facts(one_test)).collect()}
    assert got == {("x.test.ts", "outer > inner", "works", "vitest"), ("x.test.ts", "outer", "later", "vitest"), ("y.test.ts", "", "y.test.ts", "unknown")}
    facts = extract.evidence(spark.createDataFrame([("a.cs", "csharp", "source")], "path string, language string, kind string"))
    assert facts["edges"].first().confidence == 1.0 and facts["modules"].first().summary == "csharp source file indexed as file-level evidence for a.cs."
