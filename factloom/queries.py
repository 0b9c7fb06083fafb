"""Every operator as a query over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import conventions as c
from factloom.functions import text as t
from factloom.operators import classify, extract, fulltext, graph, incidents, relational, review, rules, search, telemetry
from factloom.plans import indexing, tools
from factloom.plans.lineage import shared_dir
from factloom.sources import adapters as a
from factloom.sources import files as files_source
from factloom.sources import logs as log_source
from factloom.sources import tree
from factloom.streaming import logs as log_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ROOT = "(SELECT min(source_id) AS id FROM edges WHERE source_id LIKE 'p%')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def first_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.import_edges(spark, sf_dir).where("source_id LIKE 'p%'").agg(F.min("source_id").alias("id"))


def joined(c: str) -> F.Column:
    return F.array_join(F.array_sort(c), "|")


# sources

_LINES = f"""WITH {a.LOGS}, r AS (SELECT id, timestamp || ' ' || upper(level) || ' ' || service || ' ' || message AS line FROM logs)"""
_RE = r"^(\S+)\s+([A-Z]+)\s+([a-zA-Z0-9._-]+)\s+(.*)$"


@query(f"{_LINES} SELECT regexp_extract(line, '{_RE}', 1) AS timestamp, lower(regexp_extract(line, '{_RE}', 2)) AS level, regexp_extract(line, '{_RE}', 3) AS service, regexp_extract(line, '{_RE}', 4) AS message FROM r")
def src_log_lines(spark, d):
    return log_source.parse_lines(log_source.lines(a.log_files(spark, d))).select("timestamp", "level", "service", "message")


@query("SELECT event_id AS line_no, json_extract_string(props, '$.k') AS k, json_type(props, '$.k') = 'VARCHAR' AS is_string FROM events")
def src_log_jsonl(spark, d):
    e = a.table(spark, d, "events").withColumn("v", F.try_parse_json("props"))
    return e.select(F.col("event_id").alias("line_no"), F.try_variant_get("v", "$.k", "string").alias("k"), (F.schema_of_variant(F.try_variant_get("v", "$.k", "variant")) == "STRING").alias("is_string"))


_JSON_LEVEL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'unknown' WHEN 'view' THEN 'debug' ELSE 'unknown' END"


@query(f"SELECT event_id AS id, {_JSON_LEVEL} AS level, CASE WHEN event_id % 4 = 0 THEN 'configured' WHEN event_id % 4 = 1 THEN 'src' ELSE 'svc' || (user_id % 5) END AS service, CASE WHEN event_type = 'view' THEN 'm' || event_id ELSE props END AS message, CASE WHEN event_type = 'signup' THEN 'mtime' ELSE 't' || event_id END AS timestamp FROM events WHERE event_id % 7 <> 0")
def src_log_jsonl_records(spark, d):
    """Records in both spellings of every field, values that are no strings, and broken lines."""
    e = a.table(spark, d, "events")
    kind, id_ = F.col("event_type"), F.col("event_id")
    level = F.when(kind == "error", F.lit('"level":"ERROR"')).when(kind == "purchase", F.lit('"lvl":"Warning"')).when(kind == "signup", F.lit('"level":5')).when(kind == "view", F.lit('"lvl":"debug"')).otherwise(F.lit('"severity":"error"'))
    time = F.when(kind == "signup", F.lit('"ts":"no"')).when(kind == "view", F.concat(F.lit('"time":"t'), id_, F.lit('"'))).otherwise(F.concat(F.lit('"timestamp":"t'), id_, F.lit('"')))
    service = F.when(id_ % 4 < 2, F.lit('"logger":"no"')).when(id_ % 4 == 2, F.concat(F.lit('"service":"svc'), F.col("user_id") % 5, F.lit('"'))).otherwise(F.concat(F.lit('"serviceName":"svc'), F.col("user_id") % 5, F.lit('"')))
    message = F.when(kind == "view", F.concat(F.lit('"msg":"m'), id_, F.lit('"'))).otherwise(F.concat(F.lit('"message":'), F.to_json(F.struct(F.col("props").alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("props").alias("x")))) - 6)))
    line = F.when(id_ % 7 == 0, F.lit("{broken")).otherwise(F.concat(F.lit("{"), F.concat_ws(",", level, time, service, message), F.lit("}")))
    rows = e.select(F.lit("src").alias("source_name"), F.when(id_ % 4 == 0, "configured").alias("service"), F.lit("p").alias("path"), id_.alias("line_no"), F.lit("mtime").alias("mtime"), line.alias("line"))
    return log_source.parse_jsonl(rows).select(F.col("line_no").alias("id"), "level", "service", "message", "timestamp")


_LOG_PATHS = ("services/svc{}/logs/app.log", "logs/svc{}/x.txt", "apps/svc{}/out/run.out", "svc{}.2024.jsonl", "var/log/svc{}-a.log", "notes/svc{}.txt", ".hidden/svc{}/server.txt", "log/.cfg/svc{}_error.log")
_LOG_NAMES = ("auto-services-svc{0}-app", "auto-svc{0}-x", "auto-svc{0}-out-run", "auto-svc{0}-svc{0}.2024", "auto-svc{0}-svc{0}-a", None, "auto-svc{0}-server", "auto-.cfg-svc{0}_error")
_LOG_SERVICES = ("svc{0}", "svc{0}", "out", "svc{0}", "svc{0}", None, "svc{0}", ".cfg")


@query("SELECT path, name, service, format FROM (SELECT DISTINCT user_id FROM events), (VALUES " + ", ".join(f"('{p}', '{n}', '{v}', '{'jsonl' if p.endswith('jsonl') else 'line'}')" for p, n, v in zip(_LOG_PATHS, _LOG_NAMES, _LOG_SERVICES, strict=True) if n).replace("{0}", "{}") + ") x(p, n, v, format), LATERAL (SELECT replace(p, '{}', user_id::VARCHAR) AS path, replace(n, '{}', user_id::VARCHAR) AS name, replace(v, '{}', user_id::VARCHAR) AS service)")
def src_infer_log_source(spark, d):
    """Which paths are logs, and what is told of them by their folders."""
    users = a.table(spark, d, "events").select("user_id").distinct()
    paths = users.select(F.explode(F.array(*(F.concat(F.lit(x.split("{}")[0]), F.col("user_id"), F.lit(x.split("{}")[1])) for x in _LOG_PATHS))).alias("path"))
    return paths.where(log_source.looks_like_log(F.col("path"))).select("path", log_source.inferred_source(F.col("path")).alias("s")).select("path", "s.*")


@query("SELECT source_name, path, 'could not read log source ' || path AS warning FROM (SELECT DISTINCT 'u' || user_id AS source_name, 'logs/' || user_id || '.log' AS path, user_id FROM events) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id)")
def src_log_collect(spark, d):
    """A log for each customer, a source for each user: the warnings of users without one."""
    users = a.table(spark, d, "events").select("user_id").distinct()
    sources = users.select(F.concat(F.lit("logs/"), "user_id", F.lit(".log")).alias("path"), F.concat(F.lit("u"), "user_id").alias("source_name"), F.lit(None).cast("string").alias("service"), F.lit("line").alias("format"))
    files = a.table(spark, d, "customer").select(F.concat(F.lit("logs/"), "c_custkey", F.lit(".log")).alias("path"), F.lit("m").alias("mtime"), F.col("c_name").alias("content"))
    return log_source.collected(sources, files)[1]


@query("SELECT o_orderkey::VARCHAR AS sha, o_custkey::VARCHAR AS author, CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS authored_at, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS summary FROM orders")
def src_git_log(spark, d):
    """Records with line feeds around them, some cut short."""
    o = a.table(spark, d, "orders")
    short = F.col("o_orderkey") % 9 == 0
    raw = F.concat_ws("\u001f", F.concat(F.lit("\r\n"), F.col("o_orderkey").cast("string")), F.col("o_custkey").cast("string"), F.when(~short, F.date_format("o_orderdate", "yyyy-MM-dd")), F.when(~short, F.concat("o_orderpriority", F.lit("\n"))))
    return log_source.git_log(o.select(F.concat(raw, F.lit("\u001e"), F.lit(" \n")).alias("raw")))


@query("SELECT p_name AS path, CASE WHEN p_size % 5 = 0 THEN 'renamed' WHEN p_size % 5 = 1 THEN 'added' WHEN p_size % 5 = 2 THEN 'untracked' WHEN p_size % 5 = 3 THEN 'deleted' ELSE 'modified' END AS status, CASE WHEN p_size % 5 = 0 THEN p_brand END AS previous_path FROM part")
def src_git_status(spark, d):
    p = a.table(spark, d, "part")
    code = F.element_at(F.array(*map(F.lit, ("R ", "A ", "??", " D", " M"))), F.col("p_size") % 5 + 1)
    return log_source.git_status(p.select(F.concat(code, F.lit(" "), F.when(F.col("p_size") % 5 == 0, F.concat("p_brand", F.lit(" -> "))).otherwise(""), "p_name").alias("line")))


_MANIFESTS = ("package.json", "pyproject.toml", "Cargo.toml", "go.mod", "App.Test.csproj", "package.json", "notes.txt")


@query("""SELECT 'p' || page_id || '/' || m AS path, kind, name, roots, tests, packages FROM (SELECT page_id, page_id % 7 AS k, 'p' || page_id AS r FROM pages) JOIN (VALUES
  (0, 'package.json', 'package_json', '{r}n', '{r}/src|{r}/app', '{r}/test|{r}/tests|{r}/spec', '{r}|{r}/libs|{r}/apps/web'), (1, 'pyproject.toml', 'pyproject', '{r}', '{r}/src', '{r}/tests', '{r}'), (2, 'Cargo.toml', 'cargo', '{r}', '{r}/src', '{r}/tests|{r}/benches', '{r}'),
  (3, 'go.mod', 'go_mod', '{r}', '{r}/cmd|{r}/pkg|{r}/internal', '{r}/pkg|{r}/internal', '{r}'), (4, 'App.Test.csproj', 'csproj', '{r}', '{r}', '{r}', '{r}')) v(k, m, kind, n_, r_, t_, p_) USING (k),
LATERAL (SELECT replace(n_, '{r}', r) AS name, replace(r_, '{r}', r) AS roots, replace(t_, '{r}', r) AS tests, replace(p_, '{r}', r) AS packages)""")
def src_manifest_hints(spark, d):
    """Manifests of five kinds, a broken one, and a file that is none."""
    n = F.col("page_id") % 7
    name = F.element_at(F.array(*map(F.lit, _MANIFESTS)), (n + 1).cast("int"))
    root = F.concat(F.lit("p"), "page_id")
    content = F.when(n == 0, F.concat(F.lit('{"name":"'), root, F.lit('n","workspaces":{"packages":["libs/*","apps/web"]},"dependencies":{}}'))).when(n == 1, "[tool]\nwhere = [\"src\"]\n").when(n == 5, "{broken").otherwise("x")
    files = a.table(spark, d, "pages").select(F.concat_ws("/", root, name).alias("rel_path"), name.alias("basename"), t.extension(name).alias("extension"), content.alias("content"))
    return files_source.manifest_hints(files).select("path", "kind", "name", *(F.array_join(c_, "|").alias(n_) for c_, n_ in (("source_roots", "roots"), ("test_roots", "tests"), ("package_roots", "packages"))))


@query("SELECT 'package_' || substr(sha256('ws::' || 'a' || k), 1, 24) AS id, 'a' || k AS root, min(CASE WHEN json THEN 'n' || page_id END) IS NOT NULL AS named FROM (SELECT page_id, page_id % 50 AS k, page_id % 3 = 0 AS json FROM pages) GROUP BY k UNION ALL SELECT 'package_' || substr(sha256('ws::'), 1, 24), '', false")
def src_packages(spark, d):
    """One package for each root, package.json first, and one for what no manifest covers."""
    json = F.col("page_id") % 3 == 0
    hints = a.table(spark, d, "pages").select(
        F.concat(F.lit("a"), F.col("page_id") % 50, F.lit("/"), "page_id").alias("path"), F.concat(F.lit("a"), F.col("page_id") % 50).alias("root"), F.when(json, "package_json").otherwise("cargo").alias("kind"),
        F.when(json, F.concat(F.lit("n"), "page_id")).otherwise("other").alias("name"), F.lit("x").alias("language"),
    )
    return files_source.packages(hints, "ws").select("id", "root", F.col("name").startswith("n").alias("named"))


#: Ignore lines, and paths of documents with what these lines make of them; the verdicts are set down by hand.
_IGNORE_LINES = ["# notes", "docs/*.md", "build/", "/src/b?.ts", "logs/", "!logs/keep/", "*.tmp", "!keep.tmp", "a/**/z[0-9]*.txt", "**/cache/**", "\\#x*", "out?/", "!out1/", "trail.* "]
_IGNORE_PATHS = [
    ("docs/{i}.md", True), ("x/docs/{i}.md", False), ("docs/x/{i}.md", False), ("build/{i}.o", True), ("a/build/{i}/o", True), ("{i}/build", False), ("src/b1.ts", True), ("src/b{i}x.ts", False), ("{i}/src/b1.ts", False), ("logs/keep/{i}", True),
    ("{i}.TMP", True), ("{i}/keep.tmp", False), ("a/z{i}.txt", True), ("a/b/{i}/z1.txt", True), ("x/a/z{i}.txt", False), ("{i}/cache/x/y", True), ("cache", False), ("#x{i}", True), ("x#{i}", False), ("out1/{i}", False), ("out2/{i}", True), ("{i}/trail.", True), ("_{i}/.hidden", False),
]
_IGNORE_SQL = ", ".join(f"({k}, '{p}', {str(gone).lower()})" for k, (p, gone) in enumerate(_IGNORE_PATHS))


@query(f"SELECT doc_id, replace(path, '{{i}}', doc_id::VARCHAR) AS path FROM documents JOIN (VALUES {_IGNORE_SQL}) v(k, path, gone) ON k = doc_id % {len(_IGNORE_PATHS)} WHERE NOT gone")
def src_gitignore(spark, d):
    """Rules tied to the root or not, for folders only, with classes, escapes and what can't be taken back."""
    made = F.array(*(F.lit(p) for p, _ in _IGNORE_PATHS))
    path = F.replace(F.element_at(made, (F.col("doc_id") % len(_IGNORE_PATHS) + 1).cast("int")), F.lit("{i}"), F.col("doc_id").cast("string"))
    rows = a.table(spark, d, "documents").select("doc_id", path.alias("path"), path.alias("rel_path"))
    return files_source.not_ignored(rows, _IGNORE_LINES).select("doc_id", "path")


@query(f"WITH {tree.TREE} SELECT path FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN 'node_modules/' || path WHEN doc_id % 13 = 0 THEN path || '.bak' ELSE path END AS path FROM tree) WHERE NOT starts_with(path, 'node_modules/') AND NOT ends_with(path, '.bak')")
def src_discover_files(spark, d):
    """Files of known names outside ignored folders."""
    path = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("node_modules/"), "path")).when(F.col("doc_id") % 13 == 0, F.concat("path", F.lit(".bak"))).otherwise(F.col("path"))
    return files_source.candidates(tree.source_tree(spark, d).select(path.alias("rel_path"))).select(F.col("rel_path").alias("path"))


# identity and scalars


@query("SELECT doc_id, 'file_' || substr(sha256(coalesce(source, '') || '::' || doc_id), 1, 24) AS id FROM documents")
def stable_id(spark, d):
    return a.table(spark, d, "documents").select("doc_id", t.stable_id("file", "source", "doc_id").alias("id"))


@query(r"""SELECT page_id, regexp_replace(url, '^.*/', '') AS base, lower(regexp_extract(regexp_replace(url, '^.*/', ''), '[^.]\.([^.]+)$', 1)) AS ext, regexp_replace(url, '/?[^/]*$', '') AS dir, length(url)::BIGINT AS n, ceil(length(html) / 3.5)::BIGINT AS tokens FROM pages""")
def fn_paths(spark, d):
    url = F.col("url")
    return a.table(spark, d, "pages").select("page_id", t.basename(url).alias("base"), t.extension(url).alias("ext"), t.dirname(url).alias("dir"), F.length(url).cast("bigint").alias("n"), t.token_estimate(F.col("html")).alias("tokens"))


_LEVELS = ("TRACE", "Debug", "info", "WARNING", "warn", "Error", "fatal", "notice")


@query("SELECT conv_id, turn, CASE WHEN length(text) > 120 THEN substr(text, 1, 117) || '...' ELSE text END AS title, CASE WHEN conv_id % 8 = 7 THEN 'unknown' WHEN conv_id % 8 = 3 THEN 'warn' ELSE lower((['TRACE', 'Debug', 'info', 'WARNING', 'warn', 'Error', 'fatal'])[conv_id % 8 + 1]) END AS level FROM conversations")
def fn_truncate_level(spark, d):
    given = F.element_at(F.array(*map(F.lit, _LEVELS)), (F.col("conv_id") % 8 + 1).cast("int"))
    return a.table(spark, d, "conversations").select("conv_id", "turn", t.truncated(F.col("text"), 120, "...").alias("title"), t.level(given).alias("level"))


@query(r"""SELECT page_id, 'r/' || rtrim(split_part(url, '://', 2), '/') AS normal, rtrim(split_part(url, '://', 2), '/') AS relative, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(url, '://', 2), '\.[A-Za-z0-9]+$', ''), '[.:]+', '/', 'g'), '/+', '/', 'g'), '^/|/$', '', 'g')) AS key,
  CASE WHEN page_id % 2 = 0 THEN '[redacted]' ELSE url END AS shown, len(string_split(url, '/')) AS shared FROM pages""")
def fn_references(spark, d):
    """Paths with backslashes and dots made normal, look-up keys, hidden secrets and shared folders."""
    rest = F.element_at(F.split("url", "://"), 2)
    messy = F.concat(F.lit("r\\x\\..\\.\\"), rest)
    secret = F.create_map(F.when(F.col("page_id") % 2 == 0, F.lit("API_Key")).otherwise(F.lit("key")), F.col("url"))
    return a.table(spark, d, "pages").select(
        "page_id", t.normal_path(messy).alias("normal"), t.relative(t.normal_path(messy), F.lit("r")).alias("relative"), t.reference_key(rest).alias("key"), F.map_values(t.redacted(secret))[0].alias("shown"),
        t.common_prefix(F.split("url", "/"), F.concat(F.split("url", "/"), F.array(F.lit("more")))).alias("shared"),
    )


# filters


@query(f"WITH {a.LOGS} SELECT * FROM logs WHERE service = 'svc1' AND level = 'error'")
def flt_eq(spark, d):
    return incidents.filtered(a.log_events(spark, d), "svc1", "error")


@query(f"WITH {a.LOGS} SELECT * FROM logs WHERE level = 'warn'")
def flt_optional(spark, d):
    return incidents.filtered(a.log_events(spark, d), None, "warn")


@query(f"WITH {a.LOGS} SELECT id, level FROM logs WHERE level IN ('error', 'fatal')")
def flt_level_error(spark, d):
    return a.log_events(spark, d).where(F.col("level").isin("error", "fatal")).select("id", "level")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (7, 3, 11, 200, 1)")
def flt_in_list(spark, d):
    return a.table(spark, d, "part").where(F.col("p_partkey").isin(7, 3, 11, 200, 1)).select("p_partkey", "p_name")


@query("SELECT pos, p_partkey, p_name FROM (VALUES (0, 7), (1, 3), (2, -5), (3, 11), (4, 3)) v(pos, k) JOIN part ON p_partkey = k")
def flt_in_ordered(spark, d):
    return relational.in_order(a.table(spark, d, "part"), "p_partkey", [7, 3, -5, 11, 3]).select("pos", "p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '_') OR contains(lower(p_name), 'ed wid')")
def flt_symbol_name(spark, d):
    p = a.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") < 10).alias("exported"))
    names = _trigrams(spark, d, "part", p, "name")
    found = relational.symbols_named(p, "_", names).unionByName(relational.symbols_named(p, "eD Wid", names))
    return found.select(F.col("id").alias("p_partkey"), F.col("name").alias("p_name")).distinct()


@query(f"WITH {a.MODULES} SELECT id, canonical_path FROM modules WHERE contains(lower(canonical_path), '-12') ORDER BY CASE WHEN canonical_path = '-12' THEN 0 ELSE 1 END, canonical_path LIMIT 1")
def flt_module_path(spark, d):
    m = a.modules(spark, d)
    return relational.one_module(m, "-12", _trigrams(spark, d, "part", m.select("id", "canonical_path"), "canonical_path")).select("id", "canonical_path")


@query(f"WITH {a.MODULES} SELECT * FROM modules WHERE id = 'p42'")
def flt_by_id(spark, d):
    return a.modules(spark, d).where("id = 'p42'")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https://[^/]*\\.example\\.com/en/.*$') OR regexp_matches(url, '^.*\\.html$')")
def flt_glob(spark, d):
    return relational.globbed(a.table(spark, d, "pages"), "url", ["https://*.example.com/en/**", "**.html"]).select("page_id", "url")


# joins


@query(f"WITH {a.MODULES} SELECT id, canonical_path FROM modules WHERE changed ORDER BY canonical_path")
def join_change_modules(spark, d):
    """The modules that a change group's edges start from; its edges from symbols lead to no module."""
    m = a.modules(spark, d)
    symbols = m.select(F.concat(F.lit("s"), "id").alias("id"), F.col("id").alias("module_id"))
    return relational.change_modules(relational.changed_in("g1", m.where("changed"), symbols), m, "g1").select("id", "canonical_path")


_CAND = f"""WITH {a.MODULES}, {a.TESTS}, hit AS (SELECT source_id AS id, canonical_path FROM tests JOIN modules m ON m.id = target_id WHERE changed)
SELECT id, title, suite_path, modules, score FROM (SELECT id, string_agg(DISTINCT canonical_path, '|' ORDER BY canonical_path) AS modules, count(*) AS score FROM hit GROUP BY id) JOIN cases USING (id)"""


def _candidates(spark, d):
    return relational.test_candidates(a.modules(spark, d).where("changed"), a.test_edges(spark, d), a.test_cases(spark, d)).withColumn("modules", joined("modules"))


@query(_CAND)
def join_test_candidates(spark, d):
    return _candidates(spark, d)


@query(f"SELECT * FROM ({_CAND}) ORDER BY score DESC, suite_path, id LIMIT 10")
def agg_test_candidates(spark, d):
    return _candidates(spark, d).orderBy(F.desc("score"), "suite_path", "id").limit(10)


@query(f"WITH {a.MODULES}, {a.TESTS} SELECT id, count(DISTINCT source_id) AS tests FROM modules LEFT JOIN tests ON target_id = id WHERE changed GROUP BY id")
def agg_coverage(spark, d):
    return relational.coverage(a.modules(spark, d).where("changed"), a.test_edges(spark, d))


@query("SELECT p_partkey FROM part WHERE p_size <= 3 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def join_anti_test_gaps(spark, d):
    li = a.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return a.table(spark, d, "part").where("p_size <= 3").join(li, "p_partkey", "left_anti").select("p_partkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)")
def join_anti_stale_files(spark, d):
    found = a.table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return relational.stale(a.table(spark, d, "supplier"), found, "s_suppkey").select("s_suppkey", "s_name")


@query(f"WITH {a.MODULES}, {a.EDGES} SELECT source_id, target_id FROM edges WHERE source_id IN (SELECT id FROM modules WHERE changed) OR target_id IN (SELECT id FROM modules WHERE changed)")
def join_semi_changed(spark, d):
    e, m = a.import_edges(spark, d).select("source_id", "target_id"), a.modules(spark, d).where("changed").select("id")
    return e.join(m, e["source_id"] == m["id"], "left_semi").unionByName(e.join(m, e["target_id"] == m["id"], "left_semi")).distinct()


@query("SELECT page_id, max(root) AS root FROM (SELECT page_id, url FROM pages) LEFT JOIN (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+', 0) AS root FROM pages) ON url = root OR starts_with(url, root || '/') GROUP BY page_id")
def join_longest_prefix(spark, d):
    p = a.table(spark, d, "pages").select("page_id", "url")
    roots = p.select(F.regexp_extract("url", "^[a-z]+://[^/]+/[a-z]+", 0).alias("root"))
    return relational.longest_prefix(p, "url", roots).select("page_id", "root")


_TS = tree.KINDS.index("ts")


@query(f"WITH {tree.TREE} SELECT x.path AS import_id, y.path FROM tree x JOIN tree y ON x.k IN (0, 3) AND y.k = 0 AND y.doc_id = CASE x.k WHEN 0 THEN x.doc_id - {tree.STEP} ELSE x.doc_id - 3 END")
def join_import_candidates(spark, d):
    files = tree.source_tree(spark, d)
    imports = extract.ts_imports(extract.script_facts(files.where("path LIKE '%.ts'")))
    return relational.import_candidates(imports.select(F.col("path").alias("import_id"), F.col("path").alias("from_path"), "spec"), files)


@query(f"WITH {tree.TREE} SELECT x.path AS id, y.path FROM tree x JOIN tree y ON x.k = 1 AND y.doc_id = x.doc_id - {tree.STEP}")
def join_lua_require(spark, d):
    files = tree.source_tree(spark, d)
    wanted = extract.lua_imports(extract.lines(files.where("path LIKE '%.lua'"))).where("how = 'require'")
    return relational.required(wanted.select(F.col("path").alias("id"), F.col("path").alias("from_path"), F.col("reference").alias("module")), files)


_SCORED = f"WITH {tree.TREE} SELECT x.path AS ref_id, 'm' || y.doc_id AS reference, y.path, 47::BIGINT AS score FROM tree x JOIN tree y ON x.k = 1 AND y.doc_id = x.doc_id - {tree.STEP}"


@query(_SCORED)
def join_suffix_key(spark, d):
    """Modules looked up by the end of their path, the best candidate of each."""
    files = tree.source_tree(spark, d)
    wanted = extract.lua_imports(extract.lines(files.where("path LIKE '%.lua'"))).where("how = 'catalog'")
    catalog = files.select("path", t.language(F.col("path")).alias("language"))
    return relational.resolve(wanted.select(F.col("path").alias("ref_id"), "reference", F.col("path").alias("from_path"), F.lit("lua").alias("language")), catalog)


@query("""SELECT p_partkey AS ref_id, p_type || '/' || p_partkey AS reference, 'lib/' || p_type || '/' || p_partkey || '/init.lua' AS path, (30 + 10 + 4 - 5 + 5)::BIGINT AS score FROM part""")
def rank_reference(spark, d):
    """A folder with an ``init`` file wins over a file of the same name in another language."""
    p = a.table(spark, d, "part")
    base = F.concat(F.lit("lib/"), "p_type", F.lit("/"), "p_partkey")
    catalog = p.select(F.concat(base, F.lit("/init.lua")).alias("path"), F.lit("lua").alias("language")).unionByName(p.select(F.concat(base, F.lit(".py")).alias("path"), F.lit("python").alias("language")))
    wanted = p.select(F.col("p_partkey").alias("ref_id"), F.concat("p_type", F.lit("/"), "p_partkey").alias("reference"), F.lit("lib/a/b/c/x.lua").alias("from_path"), F.lit("lua").alias("language"))
    return relational.resolve(wanted, catalog)


_RULES = [
    {"id": "no-en", "kind": "forbid", "from": "**.example.com/en/**", "to": "**.example.com/en/1**", "severity": "error", "except": [{"from": "https**", "to": "https**"}]},
    {"id": "fr-only-fr", "kind": "allow", "from": "**/fr/**", "to": "**/fr/**", "severity": "warning"},
    {"id": "fr-or-net", "kind": "allow", "from": "**/fr/**", "to": "**.net/**", "severity": "info"},
]


def _page_edges(spark, d):
    """Each page points to the one of the next id but two."""
    p = a.table(spark, d, "pages").select("page_id", "url")
    q = p.select((F.col("page_id") - 3).alias("page_id"), F.col("url").alias("target_path"))
    return p.join(q, "page_id").select(F.col("page_id").cast("string").alias("edge_id"), F.col("url").alias("source_path"), "target_path")


_PAGE_EDGES = "pe AS (SELECT p.page_id::VARCHAR AS edge_id, p.url AS source_path, q.url AS target_path FROM pages p JOIN pages q ON q.page_id = p.page_id + 3)"


def _re(glob: str) -> str:
    return t.glob_regex(glob)


@query(f"WITH {_PAGE_EDGES} SELECT edge_id, 'no-en' AS rule_id, 'error' AS severity FROM pe WHERE regexp_matches(source_path, '{_re('**.example.com/en/**')}') AND regexp_matches(target_path, '{_re('**.example.com/en/1**')}') AND NOT (starts_with(source_path, 'https') AND starts_with(target_path, 'https'))")
def rule_forbid(spark, d):
    return rules.violations(_page_edges(spark, d), rules.table(spark, _RULES)).where("rule_id = 'no-en'").select("edge_id", "rule_id", "severity")


@query(f"WITH {_PAGE_EDGES} SELECT edge_id, 'fr-only-fr' AS rule_id, 'warning' AS severity FROM pe WHERE regexp_matches(source_path, '{_re('**/fr/**')}') AND NOT (regexp_matches(target_path, '{_re('**/fr/**')}') OR regexp_matches(target_path, '{_re('**.net/**')}'))")
def rule_allow(spark, d):
    return rules.violations(_page_edges(spark, d), rules.table(spark, _RULES)).where("rule_id = 'fr-only-fr'").select("edge_id", "rule_id", "severity")


# aggregations


@query(f"WITH {a.EDGES} SELECT source_id, count(*) AS n FROM edges GROUP BY source_id")
def agg_out_degree(spark, d):
    return a.import_edges(spark, d).groupBy("source_id").agg(F.count("*").alias("n"))


@query(f"WITH {a.EDGES} SELECT target_id, count(*) AS n FROM edges GROUP BY target_id")
def agg_in_degree(spark, d):
    return a.import_edges(spark, d).groupBy("target_id").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n, count(DISTINCT text) AS texts FROM documents GROUP BY source")
def agg_count(spark, d):
    return a.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct(F.sha2("text", 256)).alias("texts"))


_INC = f"""WITH {a.LOGS}, e AS (SELECT *, substr(message, 1, 120) AS title FROM logs WHERE level IN ('error', 'fatal'))
SELECT 'incident_' || substr(sha256('ws::' || service || '::' || arg_min(message, seq)), 1, 24) AS id, service, title, count(*) AS n, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
  arg_max(id, (timestamp, seq)) AS latest_event_id, arg_max(level, (timestamp, seq)) AS severity FROM e GROUP BY service, title"""


@query(_INC)
def agg_incidents(spark, d):
    return incidents.incidents(a.log_events(spark, d))


@query("SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS f, max(o_totalprice) AS top FROM orders GROUP BY o_custkey")
def agg_conditional(spark, d):
    return a.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.max("o_totalprice").alias("top"))


@query(f"WITH {a.CALLS} SELECT session, count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, floor(avg(duration_ms) + 0.5)::BIGINT AS mean_ms, min(seq) AS first_seq, max(seq) AS last_seq FROM calls GROUP BY session")
def agg_retrospect_stats(spark, d):
    return telemetry.stats(a.calls(spark, d))


@query(f"WITH {a.CALLS} SELECT session, tool, count(*) AS n FROM calls GROUP BY ALL")
def agg_retrospect_tools(spark, d):
    return telemetry.per_tool(a.calls(spark, d))


_PACK = """WITH RECURSIVE c AS (SELECT source AS grp, doc_id AS id, ceil(length(text) / 3.5)::BIGINT AS tokens, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS r FROM documents),
f AS (SELECT grp, id, r, CASE WHEN tokens <= 8000 THEN tokens ELSE 0 END AS used, tokens <= 8000 AS included FROM c WHERE r = 1
  UNION ALL SELECT c.grp, c.id, c.r, f.used + CASE WHEN f.used + c.tokens <= 8000 THEN c.tokens ELSE 0 END, f.used + c.tokens <= 8000 FROM f JOIN c ON c.grp = f.grp AND c.r = f.r + 1)
SELECT grp, id, included FROM f"""


@query(_PACK)
def agg_greedy_pack(spark, d):
    rows = a.table(spark, d, "documents").select(F.col("source").alias("grp"), F.col("n_chars").alias("priority"), F.col("doc_id").alias("id"), t.token_estimate(F.col("text")).alias("tokens"))
    return review.packed(rows, "grp", 8000)


# windows and top-k


@query(f"WITH {a.COMMITS} SELECT author, max(authored_at) AS authored_at, arg_max(sha, (authored_at, sha)) AS sha FROM commits GROUP BY author")
def win_latest_row(spark, d):
    return relational.latest(a.commits(spark, d).select("author", "authored_at", "sha"), "author", "authored_at")


@query(f"WITH {a.CALLS} SELECT session, seq, tool FROM calls QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq DESC) <= 3")
def win_ring_buffer(spark, d):
    return telemetry.ring(a.calls(spark, d), 3).select("session", "seq", "tool")


_LINES_OF = """l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"""


@query(f"""WITH {_LINES_OF}, b AS (SELECT *, coalesce(sum((ends_with(line, '.'))::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM l)
SELECT doc_id, line_no::BIGINT AS line_no, last_value(CASE WHEN contains(line, ',') THEN substr(line, 1, 20) END IGNORE NULLS) OVER (PARTITION BY doc_id, block ORDER BY line_no) AS scope FROM b""")
def win_locf_scope(spark, d):
    """A scope opened by a line with a comma, carried to the line that ends in a full stop."""
    lines = a.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line_no", (F.col("pos") + 1).cast("bigint"))
    opened = F.when(F.contains("line", F.lit(",")), F.substring("line", 1, 20)).otherwise("")
    return extract.scoped(lines, opened, F.col("line").endswith(".")).select(F.col("path").alias("doc_id"), "line_no", "scope")


@query(f"WITH {a.LOGS} SELECT id, timestamp, service FROM logs ORDER BY timestamp DESC, id DESC LIMIT 20")
def topk_logs(spark, d):
    return incidents.newest(a.log_events(spark, d)).select("id", "timestamp", "service")


@query(f"SELECT * FROM ({_INC}) ORDER BY last_seen DESC, id LIMIT 10")
def topk_incidents(spark, d):
    return incidents.top_incidents(incidents.incidents(a.log_events(spark, d)))


@query(f"WITH {a.COMMITS} SELECT * FROM commits ORDER BY authored_at DESC, sha LIMIT 5")
def topk_commits(spark, d):
    return a.commits(spark, d).orderBy(F.desc("authored_at"), "sha").limit(5)


@query("SELECT p_brand AS v FROM part UNION SELECT p_type FROM part UNION SELECT r_name FROM region")
def set_union_distinct(spark, d):
    p, r = a.table(spark, d, "part"), a.table(spark, d, "region")
    return p.select(F.col("p_brand").alias("v")).union(p.select("p_type")).union(r.select("r_name")).distinct()


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(spark, d):
    return a.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).distinct().join(a.table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), "k", "left_anti")


# graph

_DEPTH = 4


def _walk_sql(frm: str, to: str) -> str:
    return f"""WITH RECURSIVE {a.EDGES}, w AS (SELECT id, 0 AS depth FROM {ROOT} UNION SELECT e.{to}, w.depth + 1 FROM w JOIN edges e ON e.{frm} = w.id WHERE w.depth < {_DEPTH})
SELECT id, min(depth) AS depth FROM w GROUP BY id HAVING min(depth) > 0"""


@query(_walk_sql("source_id", "target_id"))
def graph_dependencies(spark, d):
    return graph.dependencies(a.import_edges(spark, d), first_part(spark, d), _DEPTH)


@query(_walk_sql("target_id", "source_id"))
def graph_reverse(spark, d):
    return graph.dependents(a.import_edges(spark, d), first_part(spark, d), _DEPTH)


@query(f"""WITH RECURSIVE {a.EDGES}, {a.MODULES}, w AS (SELECT id, 0 AS depth FROM modules WHERE changed UNION SELECT e.source_id, w.depth + 1 FROM w JOIN edges e ON e.target_id = w.id WHERE w.depth < 2)
SELECT id, min(depth) AS depth FROM w GROUP BY id""")
def agg_impacted_union(spark, d):
    return graph.walk(graph.turned(a.import_edges(spark, d)), a.modules(spark, d).where("changed").select("id"), 2)


#: The fewest imports from the root to everything, and the first such path.
_HOPS = f"""WITH RECURSIVE {a.EDGES}, w(id, cost, path) USING KEY (id) AS (SELECT id, 0::BIGINT, [id] FROM {ROOT}
  UNION SELECT target_id, min(cost) + 1, min(list_append(path, target_id)) FROM w JOIN edges ON source_id = w.id WHERE NOT EXISTS (SELECT 1 FROM recurring.w r WHERE r.id = target_id) GROUP BY target_id) SELECT * FROM w"""


@query(f"SELECT id, cost, array_to_string(path, '>') AS path FROM ({_HOPS})")
def graph_shortest_path(spark, d):
    found = graph.weighted_paths(a.import_edges(spark, d), first_part(spark, d).first().id, {"imports": 1})
    return found.select("id", "cost", F.array_join("path", ">").alias("path"))


@query(f"""SELECT id, best.cost AS cost, array_to_string(best.path, '>') AS path FROM (WITH RECURSIVE {a.EDGES}, steps AS (SELECT source_id, target_id, CASE WHEN source_id LIKE 'p%' THEN 1 ELSE 2 END AS w FROM edges),
x(id, best) USING KEY (id) AS (SELECT id, {{'cost': 0::BIGINT, 'path': [id]}} FROM {ROOT}
  UNION SELECT target_id, min({{'cost': x.best.cost + steps.w, 'path': list_append(x.best.path, target_id)}}) FROM x JOIN steps ON source_id = x.id LEFT JOIN recurring.x r ON r.id = target_id
  WHERE r.id IS NULL OR {{'cost': x.best.cost + steps.w, 'path': list_append(x.best.path, target_id)}} < r.best GROUP BY target_id) SELECT * FROM x)""")
def graph_weighted_path(spark, d):
    edges = a.import_edges(spark, d).withColumn("type", F.when(F.col("source_id").startswith("p"), "imports").otherwise("tests"))
    return graph.weighted_paths(edges, first_part(spark, d).first().id).select("id", "cost", F.array_join("path", ">").alias("path"))


@query(f"WITH seen AS ({_walk_sql('source_id', 'target_id').replace('HAVING min(depth) > 0', '')}), {a.EDGES} SELECT source_id, target_id FROM edges WHERE source_id IN (SELECT id FROM seen WHERE depth < {_DEPTH})")
def graph_walk(spark, d):
    """The edges that a walk followed."""
    edges = a.import_edges(spark, d)
    return graph.walked_edges(edges, graph.walk(edges, first_part(spark, d), _DEPTH), _DEPTH).select("source_id", "target_id")


@query(f"WITH {a.EDGES} SELECT source_id, target_id FROM edges WHERE source_id = (SELECT id FROM {ROOT}) OR target_id = (SELECT id FROM {ROOT})")
def graph_edges_from(spark, d):
    e, root = a.import_edges(spark, d), first_part(spark, d).first().id
    return e.where((F.col("source_id") == root) | (F.col("target_id") == root)).select("source_id", "target_id")


# maintenance


@query(f"WITH {a.MODULES}, {a.EDGES} SELECT id, (SELECT count(*) FROM edges WHERE source_id = id) AS outbound, (SELECT count(*) FROM edges WHERE target_id = id) AS inbound FROM modules")
def dml_recompute_degrees(spark, d):
    return relational.degrees(a.modules(spark, d), a.import_edges(spark, d))


@query("SELECT coalesce(o.n_nationkey, n.n_nationkey) AS n_nationkey, coalesce(n.n_name, o.n_name) AS n_name, coalesce(o.created_at, n.created_at) AS created_at FROM (SELECT n_nationkey, n_name, 'old' AS created_at FROM nation WHERE n_nationkey < 15) o FULL JOIN (SELECT n_nationkey, upper(n_name) || '!' AS n_name, 'new' AS created_at FROM nation WHERE n_nationkey >= 10) n ON o.n_nationkey = n.n_nationkey")
def dml_upsert(spark, d):
    n = a.table(spark, d, "nation")
    old = n.where("n_nationkey < 15").select("n_nationkey", "n_name", F.lit("old").alias("created_at"))
    return relational.upsert(old, n.where("n_nationkey >= 10").select("n_nationkey", F.concat(F.upper("n_name"), F.lit("!")).alias("n_name"), F.lit("new").alias("created_at")), ["n_nationkey"])


@query("SELECT user_id, max(event_id) AS seq, arg_max(props, event_id) AS message FROM events GROUP BY user_id")
def dml_replace_logs(spark, d):
    return relational.last_wins(a.table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.col("props").alias("message")), ["user_id"])


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey NOT IN (1, 2) UNION ALL SELECT s_suppkey, s_nationkey, 'supplier' FROM supplier WHERE s_nationkey IN (1, 2)")
def dml_replace_scope(spark, d):
    new = a.table(spark, d, "supplier").where("s_nationkey IN (1, 2)").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.lit("supplier").alias("c_mktsegment"))
    scope = new.unionByName(spark.createDataFrame([(None, 1, None), (None, 2, None)], "c_custkey bigint, c_nationkey int, c_mktsegment string"))
    return relational.replace_scope(a.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), scope, "c_nationkey").where("c_custkey IS NOT NULL")


@query(f"""WITH {a.MODULES} SELECT 'edge_' || substr(sha256('changed_in::' || id || '::g1'), 1, 24) AS id, id AS source_id, 1.0::DOUBLE AS confidence FROM modules WHERE changed
UNION ALL SELECT 'edge_' || substr(sha256('changed_in::s' || id || '::g1'), 1, 24), 's' || id, 0.9::DOUBLE FROM modules WHERE changed UNION ALL SELECT 'edge_' || substr(sha256('changed_in::' || id || '::g2'), 1, 24), id, 1.0 FROM modules""")
def dml_replace_change_group(spark, d):
    """The edges of one group are replaced, those of another stay."""
    m = a.modules(spark, d)
    symbols = m.select(F.concat(F.lit("s"), "id").alias("id"), F.col("id").alias("module_id"))
    old = relational.changed_in("g1", m, symbols).unionByName(relational.changed_in("g2", m, symbols.limit(0)))
    return relational.replace_change_group(old, relational.changed_in("g1", m.where("changed"), symbols), "g1").select("id", "source_id", "confidence")


@query("""WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT 'edge' AS what, l_orderkey AS id, l_partkey AS other FROM lineitem WHERE l_orderkey NOT IN (FROM gone) UNION ALL SELECT 'suite', o_orderkey, NULL FROM orders WHERE o_orderkey NOT IN (FROM gone)
UNION ALL SELECT 'case', l_orderkey * 10 + l_linenumber, l_orderkey FROM lineitem WHERE l_orderkey NOT IN (FROM gone) UNION ALL SELECT 'result', l_orderkey * 10 + l_linenumber, NULL FROM lineitem WHERE l_orderkey NOT IN (FROM gone)""")
def dml_delete_file_cascade(spark, d):
    """Files of finished orders go with their edges, suites, cases and results."""
    li, o = a.table(spark, d, "lineitem"), a.table(spark, d, "orders")
    case = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
    tables = {
        "edges": li.select(F.col("l_orderkey").alias("owner_file_path"), "l_partkey"), "suites": o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("file_path")),
        "cases": li.select(case, F.col("l_orderkey").alias("suite_id")), "results": li.select(case.alias("case_id")),
    }
    left = relational.delete_files(tables, o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path")))
    none = F.lit(None).cast("bigint").alias("other")
    legs = [
        left["edges"].select(F.lit("edge").alias("what"), F.col("owner_file_path").alias("id"), F.col("l_partkey").alias("other")), left["suites"].select(F.lit("suite").alias("what"), "id", none),
        left["cases"].select(F.lit("case").alias("what"), "id", F.col("suite_id").alias("other")), left["results"].select(F.lit("result").alias("what"), F.col("case_id").alias("id"), none),
    ]
    return legs[0].unionByName(legs[1]).unionByName(legs[2]).unionByName(legs[3])


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 2 = 0 OR lang = 'en'")
def flt_unchanged_skip(spark, d):
    docs = a.table(spark, d, "documents").select(F.lit("ws").alias("workspace_id"), F.col("doc_id").alias("path"), F.sha2("text", 256).alias("content_hash"), F.lit("e1").alias("extractor_version"), F.lit("p1").alias("parser_version"), "lang")
    stored = docs.withColumn("parser_version", F.when(F.col("lang") == "en", "p0").otherwise("p1")).where("path % 2 = 1").drop("lang")
    return relational.unchanged(docs, stored).select(F.col("path").alias("doc_id"), "content_hash")


# search

_TERMS = ("the", "and")
_TOK = "list_filter(regexp_split_to_array(strip_accents(lower(coalesce({0}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _bm25_sql(terms: tuple[str, ...], table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    tf = [f"len(list_filter(tokens, lambda x: x = '{w}'))" for w in sorted(terms)]
    rank = " ".join(f"- greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg_len))" for i in range(len(tf)))
    return f"""SELECT key, 0 {rank} AS rank FROM (SELECT key, len(tokens) AS len, {', '.join(f'{x} AS tf{i}' for i, x in enumerate(tf))} FROM (SELECT {key} AS key, {_TOK.format(text)} AS tokens FROM {table})),
(SELECT count(*) AS n, avg(len(tokens)) AS avg_len, {', '.join(f'count(*) FILTER ({x} > 0) AS df{i}' for i, x in enumerate(tf))} FROM (SELECT {_TOK.format(text)} AS tokens FROM {table})) WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(tf)))}"""


def _trigrams(spark, d, table: str, rows: DataFrame, *columns: str) -> fulltext.Index:
    """The index of the trigrams of names by ``id``."""
    return fulltext.index_of(f"{d}/{table}.parquet", rows, "id", columns, shared_dir(spark), t.trigrams)


def _index(spark, d, table: str, key: str, *columns: str, rows: DataFrame | None = None) -> fulltext.Index:
    return fulltext.index_of(f"{d}/{table}.parquet", a.table(spark, d, table) if rows is None else rows, key, columns, shared_dir(spark))


@query("SELECT doc_id AS key, token, len(tokens)::INT AS doc_len, count(*) AS tf FROM (SELECT doc_id, tokens, unnest(tokens) AS token FROM (SELECT doc_id, " + _TOK.format("text") + " AS tokens FROM documents)) GROUP BY ALL")
def fts_index(spark, d):
    return fulltext.postings(a.table(spark, d, "documents"), "doc_id", "text").where("token <> ''").drop("positions")


@query(f"SELECT key, round(rank, 6) AS rank FROM ({_bm25_sql(_TERMS)})")
def fts_bm25(spark, d):
    return search.bm25(_index(spark, d, "documents", "doc_id", "text"), list(_TERMS)).select("key", F.round("rank", 6).alias("rank"))


#: The three corpora of a search: symbols from page addresses, modules from documents, files from conversations.
_CORPORA = {"symbol": ("pages", "'s' || page_id", "url"), "module": ("documents", "'m' || doc_id", "text"), "file": ("conversations", "'f' || conv_id || '_' || turn", "text")}


def _indexes(spark, d) -> dict[str, fulltext.Index]:
    key = {"symbol": F.concat(F.lit("s"), "page_id"), "module": F.concat(F.lit("m"), "doc_id"), "file": F.concat(F.lit("f"), "conv_id", F.lit("_"), "turn")}
    return {kind: _index(spark, d, name, "key", text, rows=a.table(spark, d, name).select(key[kind].alias("key"), text)) for kind, (name, _, text) in _CORPORA.items()}


def _search_sql(query: str, limit: int) -> str:
    legs = " UNION ALL ".join(f"SELECT '{kind}' AS kind, key, round(rank, 9) AS rank, greatest(0.01, 1 / (1 + abs(rank))) AS score FROM ({_bm25_sql(tuple(fulltext.tokens_of(query)), *where)})" for kind, where in _CORPORA.items())
    return f"SELECT * FROM ({legs}) ORDER BY rank, kind, key LIMIT {limit}"


@query(f"SELECT kind, key, round(rank, 6) AS rank, round(score, 6) AS score FROM ({_search_sql('que en', 10)})")
def fts_search(spark, d):
    return search.search(_indexes(spark, d), "que en").select("kind", "key", F.round("rank", 6).alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {a.LOGS} SELECT id, timestamp FROM logs WHERE service = 'svc2' AND len(list_intersect(regexp_split_to_array(message, '[^a-z0-9]+'), ['7'])) > 0 ORDER BY timestamp DESC, id DESC LIMIT 50")
def fts_logs(spark, d):
    events = a.log_events(spark, d)
    return incidents.newest(incidents.filtered(search.matching(events, "id", _log_index(spark, d, events), "7"), "svc2"), 50).select("id", "timestamp")


_LOG_COLUMNS = ("service", "level", "message")


def _log_index(spark, d, events: DataFrame) -> fulltext.Index:
    return _index(spark, d, "events", "id", *_LOG_COLUMNS, rows=events)


@query(f"""WITH {a.LOGS}, w AS (SELECT id, timestamp, level, regexp_split_to_array(message, '[^a-z0-9]+') AS m FROM logs)
SELECT id, timestamp FROM w WHERE level IN ('error', 'warn') AND len(list_filter(m, lambda x: starts_with(x, '1'))) > 0 AND NOT list_contains(m, '7') ORDER BY timestamp DESC, id DESC LIMIT 50""")
def fts_logs_pattern(spark, d):
    events = a.log_events(spark, d)
    found = search.matching(events, "id", _log_index(spark, d, events), "((level : error OR level : warn) AND message : 1*) NOT message : 7")
    return incidents.newest(found, 50).select("id", "timestamp")


def _at_sql(words: tuple[str, ...], tokens: str = "tokens") -> str:
    """Where a phrase begins; its last word may be the start of one (``x*``)."""
    one = lambda i, w: f"starts_with({tokens}[i + {i}], '{w[:-1]}')" if w.endswith("*") else f"{tokens}[i + {i}] = '{w}'"
    return f"list_filter(range(1, len({tokens}) - {len(words) - 2}), lambda i: {' AND '.join(one(i, w) for i, w in enumerate(words))})"


def _match_sql(counts: list[str], found: str, extra: str = "") -> str:
    """Rows of ``documents`` for which ``found`` holds of the phrase counts ``f0, f1, ...``, ranked."""
    n = range(len(counts))
    rank = " ".join(f"- greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / avg_len))" for i in n)
    return f"""WITH w AS (SELECT doc_id AS key, {_TOK.format("text")} AS tokens FROM documents), x AS (SELECT *{extra} FROM w), f AS (SELECT key, len(tokens) AS len, {', '.join(f'{c} AS f{i}' for i, c in enumerate(counts))} FROM x),
s AS (SELECT count(*) AS n, avg(len) AS avg_len, {', '.join(f'count(*) FILTER (f{i} > 0) AS d{i}' for i in n)} FROM f) SELECT key, round(0 {rank}, 6) AS rank FROM f, s WHERE {found}"""


def _matched(spark, d, pattern: str) -> DataFrame:
    return fulltext.matched(_index(spark, d, "documents", "doc_id", "text"), pattern).select("key", F.round("rank", 6).alias("rank"))


@query(_match_sql([f"len({_at_sql(('of', 'the'))})"], "f0 > 0"))
def flt_fts_phrase(spark, d):
    return _matched(spark, d, '"of the"')


@query(_match_sql([f"len({_at_sql(('the*',))})", f"len({_at_sql(('and', 'th*'))})"], "f0 > 0 AND f1 > 0"))
def flt_fts_prefix(spark, d):
    return _matched(spark, d, "the* AND and + th*")


@query(_match_sql([f"len({_at_sql((w,))})" for w in ("with", "avec", "the")], "(f0 > 0 OR f1 > 0) AND NOT f2 > 0").replace("greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) * f2 *", "0 *"))
def flt_fts_boolean(spark, d):
    return _matched(spark, d, "(with OR avec) NOT the")


_NEAR_A, _NEAR_B = _at_sql(("with",)), _at_sql(("of", "the"))


@query(_match_sql(["len(list_filter(pa, lambda i: len(list_filter(pb, lambda j: (j <= i AND i - j - 2 <= 4) OR (i < j AND j - i - 1 <= 4))) > 0))", "len(list_filter(pb, lambda j: len(list_filter(pa, lambda i: (j <= i AND i - j - 2 <= 4) OR (i < j AND j - i - 1 <= 4))) > 0))"], "f0 > 0 AND f1 > 0", f", {_NEAR_A} AS pa, {_NEAR_B} AS pb"))
def flt_fts_near(spark, d):
    return _matched(spark, d, 'NEAR(with "of the", 4)')


@query(f"""WITH w AS (SELECT p_partkey AS key, {_TOK.format("p_name")} AS a, {_TOK.format("p_type")} AS b FROM part),
f AS (SELECT key, len(a) + len(b) AS len, len(list_filter(b, lambda x: x = 'economy')) AS f0, (a[1] = 'small')::INT AS f1 FROM w), s AS (SELECT count(*) AS n, avg(len) AS avg_len, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM f)
SELECT key, round(0 {' '.join(f'- greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / avg_len))' for i in (0, 1))}, 6) AS rank FROM f, s WHERE f0 > 0 AND f1 > 0""")
def flt_fts_columns(spark, d):
    index = _index(spark, d, "part", "p_partkey", "p_name", "p_type")
    return fulltext.matched(index, "- p_name : economy AND {p_name} : ^small").select("key", F.round("rank", 6).alias("rank"))


@query(r"SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(text, '[\s(),:{}\[\]]+'), lambda x: x <> '')).list_sort().array_to_string('|') AS words FROM conversations")
def rank_tokenize(spark, d):
    return a.table(spark, d, "conversations").select("conv_id", "turn", joined(t.search_words(F.col("text"))).alias("words"))


_HYBRID = "en fr html"
_WORDS = t.words(_HYBRID)


def _named_sql(i: int, w: str) -> str:
    seq = f"{2 * i + 2} AS seq"
    named = f"SELECT 's' || page_id AS id, 'm' || page_id AS module_id, regexp_replace(url, '^.*/', '') = '{w}' AS exact FROM pages WHERE regexp_replace(url, '^.*/', '') = '{w}' OR contains(lower(url), '{w}')"
    return f"""SELECT id, {seq}, CASE WHEN exact THEN 0.99 ELSE 0.82 END AS score, CASE WHEN exact THEN 0.45 ELSE 0.2 END AS bonus, '{w}' AS token, 1 AS n FROM ({named})
UNION ALL SELECT module_id, {seq}, 0.65, 0.18, '{w}', count(*) FROM ({named}) JOIN documents ON 'm' || doc_id = module_id GROUP BY module_id"""


def _hybrid_sql(limit: int) -> str:
    leg = lambda query, most, seq, bonus, token: f"SELECT key AS id, {seq} AS seq, score, {bonus} AS bonus, {token} AS token, 1 AS n FROM ({_search_sql(query, most)})"
    legs = [leg(_HYBRID, limit, 0, 0.5, "NULL::VARCHAR")]
    for i, w in enumerate(_WORDS):
        legs += [leg(w, max(limit, 10), 2 * i + 1, 0.0, f"'{w}'"), _named_sql(i, w)]
    first = "list_transform(h, lambda x, i: {'seq': x.seq, 'score': x.score, 'bonus': x.bonus, 'n': x.n - (i = 1)::BIGINT})"
    fold = f"list_reduce({first}, lambda s, x: {{'seq': x.seq, 'score': greatest(s.score, x.score + x.bonus) + x.n * x.bonus, 'bonus': 0.0::DOUBLE, 'n': 0::BIGINT}}, {{'seq': 0, 'score': 0.0::DOUBLE, 'bonus': 0.0::DOUBLE, 'n': 0::BIGINT}}).score"
    labels = "SELECT 's' || page_id AS id, url AS label FROM pages UNION ALL SELECT 'm' || doc_id, source || '/' || doc_id FROM documents UNION ALL SELECT 'f' || conv_id || '_' || turn, role || '/' || conv_id || '/' || turn FROM conversations"
    return f"""SELECT id, label, tokens, round({fold} + 0.25 * tokens, 9) AS score FROM (
  SELECT id, list({{'seq': seq::INT, 'score': score::DOUBLE, 'bonus': bonus::DOUBLE, 'n': n::BIGINT}} ORDER BY seq) AS h, count(DISTINCT token) AS tokens FROM ({' UNION ALL '.join(legs)}) GROUP BY id) JOIN ({labels}) USING (id)
ORDER BY tokens DESC, score DESC, label, id LIMIT {limit}"""


def _entities(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, modules and the labels of all three kinds."""
    url = F.col("url")
    symbols = a.table(spark, d, "pages").select(F.concat(F.lit("s"), "page_id").alias("id"), url.alias("label"), t.basename(url).alias("name"), F.concat(F.lit("m"), "page_id").alias("module_id"))
    modules = a.table(spark, d, "documents").select(F.concat(F.lit("m"), "doc_id").alias("id"), F.concat("source", F.lit("/"), "doc_id").alias("label"))
    files = a.table(spark, d, "conversations").select(F.concat(F.lit("f"), "conv_id", F.lit("_"), "turn").alias("id"), F.concat("role", F.lit("/"), "conv_id", F.lit("/"), "turn").alias("label"))
    return symbols, modules, symbols.select("id", "label").unionByName(modules).unionByName(files)


@query(_hybrid_sql(20))
def rank_hybrid(spark, d):
    symbols, modules, labels = _entities(spark, d)
    return search.hybrid(search.hybrid_hits(_indexes(spark, d), symbols, modules, _HYBRID, 20, _trigrams(spark, d, "pages", symbols.select("id", "label", "name"), "label", "name")), labels, 20)


# classification


def _votes_sql(rows: str, path: str = "path", content: str = "content") -> str:
    """``votes(path, o, k, c)`` of ``rows``: every signal for a kind, in the order of the detectors."""
    q = lambda x: x.replace("'", "''")
    any_of = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
    like = lambda column, pattern: f"regexp_matches({column}, '{q(pattern)}')"
    log = " OR ".join([like("name", c.LOG_NAME), like("low", "(" + "|".join(c.LOG_FOLDERS) + ")/"), like("name", r"\.(" + "|".join(c.LOG_EXTENSIONS) + ")$"), like("substr(body, 1, 512)", c.LEVEL_WORD)])
    test = like("low", t.any_glob(c.TEST_GLOBS)) + " OR " + like("low", c.TEST_FOLDER)
    signals = [
        ("'generated'", 0.95, like("path", t.any_glob(c.GENERATED_GLOBS))), ("'manifest'", 0.95, like("path", t.any_glob(c.MANIFEST_GLOBS))), ("'source'", 0.45, like("path", t.any_glob(c.SOURCE_GLOBS))),
        (f"CASE WHEN ext IN {any_of(c.DOCS)} THEN 'doc' ELSE 'config' END", 0.4, like("path", t.any_glob(c.EVIDENCE_GLOBS))),
        ("'generated'", 0.98, like("array_to_string(regexp_split_to_array(body, '\r?\n')[1:20], chr(10))", "(?i)" + "|".join(c.BANNERS))), ("'binary'", 1.0, f"ext IN {any_of(c.BINARY)}"),
        ("'test'", 0.9, test), ("'test'", 0.75, like("body", c.TEST_MARK)), ("'log'", 0.8, log), ("'doc'", 0.7, f"ext IN {any_of(c.DOCS)}"), ("'doc'", 0.75, like("low", c.DOC_FOLDER)), ("'doc'", 0.45, like("substr(body, 1, 500)", r"(?m)^#\s+")),
        ("'config'", 0.65, f"ext IN {any_of(c.CONFIGS)}"), ("'config'", 0.7, f"name IN {any_of(c.CONFIG_NAMES)} OR " + like("name", c.CONFIG_WORD)), ("'config'", 0.55, like("substr(body, 1, 800)", c.CONFIG_MARK)),
    ]
    listed = ", ".join(f"{{'o': {o}, 'k': {k}, 'c': {sure}::DOUBLE, 'yes': {when}}}" for o, (k, sure, when) in enumerate(signals))
    named = f"""named AS (SELECT {path} AS path, lower({path}) AS low, regexp_replace(lower({path}), '^.*/', '') AS name, lower(regexp_extract(regexp_replace({path}, '^.*/', ''), '[^.][.]([^.]+)$', 1)) AS ext, coalesce({content}, '') AS body FROM {rows})"""
    test_role = f"({test}) AS test_role"
    return f"""{named}, votes AS (SELECT path, s.o AS o, s.k AS k, s.c AS c FROM (SELECT path, unnest([{listed}]) AS s FROM named) WHERE s.yes), roles AS (SELECT path, ext, {test_role} FROM named)"""


def _classes_sql(rows: str, path: str = "path", content: str = "content") -> str:
    """``classes(path, kind, language, confidence)`` of ``rows``."""
    languages = ", ".join(f"('{e}', '{name}')" for e, name in c.LANGUAGES.items())
    return f"""{_votes_sql(rows, path, content)}, sums AS (SELECT path, k, sum(c ORDER BY o) AS score, min(o) AS first FROM votes GROUP BY path, k),
best AS (SELECT path, arg_max(k, (score, -first)) AS k, max(score) AS score, bool_or(k = 'generated' AND score >= 0.9) AS generated FROM sums GROUP BY path),
classes AS (SELECT roles.path, CASE WHEN generated THEN 'generated' WHEN best.k IS NOT NULL THEN best.k WHEN language IS NOT NULL AND test_role THEN 'test' WHEN language IS NOT NULL THEN 'source' ELSE 'unknown' END AS kind,
  language, round(greatest(coalesce(score, 0), CASE WHEN language IS NOT NULL THEN 0.5 ELSE 0 END, 0.05), 2) AS confidence FROM roles LEFT JOIN best USING (path) LEFT JOIN (VALUES {languages}) l(ext, language) USING (ext))"""


@query(f"WITH {tree.TREE}, {_classes_sql('tree')} SELECT path, kind, language, confidence::DOUBLE AS confidence FROM classes")
def cls_classify(spark, d):
    return classify.classify(tree.source_tree(spark, d)).select("path", "kind", "language", "confidence")


@query(f"WITH {_classes_sql('(SELECT DISTINCT url, html FROM pages)', 'url', 'html')} SELECT path, kind, count(*) AS n FROM classes GROUP BY ALL")
def cls_pages(spark, d):
    pages = a.table(spark, d, "pages").select(F.col("url").alias("path"), F.col("html").alias("content")).distinct()
    return classify.classify(pages).groupBy("path", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {tree.TREE}, {_classes_sql('tree')} SELECT path FROM classes WHERE kind IN ('source', 'test', 'config', 'manifest', 'doc')")
def flt_indexable(spark, d):
    return classify.indexable(classify.classify(tree.source_tree(spark, d))).select("path")


@query(f"WITH {tree.TREE}, {_classes_sql('tree')} SELECT path FROM classes WHERE kind = 'test' AND language IN ('typescript', 'javascript')")
def flt_test_extractable(spark, d):
    return classify.test_extractable(classify.classify(tree.source_tree(spark, d))).select("path")


# composites

_RISK = f"""WITH {a.MODULES}, {a.EDGES}, {a.TESTS}, m AS (SELECT id FROM modules WHERE changed), fi AS (SELECT target_id AS id, count(*) AS fan_in FROM edges GROUP BY 1),
te AS (SELECT target_id AS id, count(DISTINCT source_id) AS tests FROM tests GROUP BY 1), vi AS (SELECT source_id AS id, count(*) AS violations FROM edges GROUP BY 1)
SELECT id, coalesce(fan_in, 0) AS fan_in, coalesce(tests, 0) AS tests, coalesce(violations, 0) AS violations,
  floor((coalesce(fan_in, 0) + 1) * 1.5::DOUBLE * CASE WHEN coalesce(tests, 0) > 0 THEN 0.5::DOUBLE ELSE 1::DOUBLE END * (1 + 0.3::DOUBLE * coalesce(violations, 0)) * 100 + 0.5) / 100 AS risk
FROM m LEFT JOIN fi USING (id) LEFT JOIN te USING (id) LEFT JOIN vi USING (id)"""


def _risk(spark, d):
    m, e = a.modules(spark, d).where("changed"), a.import_edges(spark, d)
    fan_in = e.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("fan_in"))
    broken = e.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("violations"))
    return review.risk(m, fan_in, relational.coverage(m, a.test_edges(spark, d)), broken, 5)


_BROKEN = "(SELECT edge_id AS id, 'p' || edge_id AS source_id, 'p' || (edge_id::BIGINT + 3) AS target_id FROM pe WHERE regexp_matches(source_path, '/en/') AND regexp_matches(target_path, '/fr/'))"


@query(f"""WITH RECURSIVE {a.MODULES}, {a.EDGES}, {a.TESTS}, {_PAGE_EDGES}, v AS {_BROKEN}, m AS (SELECT id FROM modules WHERE changed), touching AS (SELECT * FROM v WHERE source_id IN (FROM m) OR target_id IN (FROM m)),
w AS (SELECT id, 0 AS depth FROM m UNION SELECT e.source_id, w.depth + 1 FROM w JOIN edges e ON e.target_id = w.id WHERE w.depth < 2),
fi AS (SELECT target_id AS id, count(*) AS fan_in FROM edges GROUP BY 1), te AS (SELECT target_id AS id, count(DISTINCT source_id) AS tests FROM tests GROUP BY 1),
vi AS (SELECT x AS id, count(*) AS violations FROM (SELECT source_id AS x FROM touching UNION ALL SELECT target_id FROM touching) GROUP BY x)
SELECT 'risk' AS kind, id, floor((coalesce(fan_in, 0) + 1) * 1.5::DOUBLE * CASE WHEN coalesce(tests, 0) > 0 THEN 0.5::DOUBLE ELSE 1::DOUBLE END * (1 + 0.3::DOUBLE * coalesce(violations, 0)) * 100 + 0.5) / 100 AS value FROM m LEFT JOIN fi USING (id) LEFT JOIN te USING (id) LEFT JOIN vi USING (id)
UNION ALL SELECT 'impacted', id, min(depth)::DOUBLE FROM w GROUP BY id HAVING min(depth) > 0 UNION ALL SELECT 'gap', id, 0 FROM m WHERE id NOT IN (SELECT id FROM te) UNION ALL SELECT 'violation', id, 1 FROM touching""")
def tool_get_review_context(spark, d):
    broken = _page_edges(spark, d).where("source_path RLIKE '/en/' AND target_path RLIKE '/fr/'")
    broken = broken.select(F.col("edge_id").alias("id"), F.concat(F.lit("p"), "edge_id").alias("source_id"), F.concat(F.lit("p"), F.col("edge_id").cast("bigint") + 3).alias("target_id"))
    return tools.review_context(a.modules(spark, d).where("changed"), a.import_edges(spark, d), a.test_edges(spark, d), broken, 5)


@query(f"SELECT * FROM ({_RISK}) ORDER BY risk DESC, id LIMIT 10")
def topk_risk(spark, d):
    return _risk(spark, d).orderBy(F.desc("risk"), "id").limit(10)


_BRANCH = f"SELECT 'package' AS kind, package_id AS key, count(*)::VARCHAR AS value FROM modules WHERE changed GROUP BY package_id UNION ALL SELECT 'commit', sha::VARCHAR, authored_at FROM (SELECT * FROM commits ORDER BY authored_at DESC, sha LIMIT 5)"


@query(f"""WITH {a.MODULES}, {a.COMMITS}, {a.LOGS} SELECT kind, key, "at" FROM (SELECT 0 AS o, 'branch_' || kind AS kind, key, value AS "at" FROM ({_BRANCH})
UNION ALL SELECT 1, 'test', id, score::VARCHAR FROM (SELECT * FROM ({_CAND}) ORDER BY score DESC, suite_path, id LIMIT 10) UNION ALL SELECT 2, 'incident', id, last_seen FROM (SELECT * FROM ({_INC}) ORDER BY last_seen DESC, id LIMIT 10)
UNION ALL SELECT 3, 'log', id::VARCHAR, timestamp FROM (SELECT * FROM logs ORDER BY timestamp DESC, id DESC LIMIT 60)) ORDER BY o, kind, "at" DESC, key LIMIT 60""")
def tool_build_incident_timeline(spark, d):
    candidates = relational.test_candidates(a.modules(spark, d).where("changed"), a.test_edges(spark, d), a.test_cases(spark, d))
    return tools.incident_timeline(a.log_events(spark, d), a.commits(spark, d), a.modules(spark, d).where("changed"), candidates, 60)


@query(f"WITH {a.LOGS} SELECT 'event' AS kind, id::VARCHAR AS key FROM (SELECT * FROM logs WHERE service = 'svc3' ORDER BY timestamp DESC, id DESC LIMIT 20) UNION ALL SELECT 'incident', id FROM (SELECT * FROM ({_INC}) WHERE service = 'svc3' ORDER BY last_seen DESC, id LIMIT 20)")
def tool_query_logs(spark, d):
    return tools.query_logs(a.log_events(spark, d), service="svc3")


_NODES = "n AS (SELECT id, canonical_path FROM modules UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier WHERE s_acctbal >= 0)"


def _nodes(spark, d):
    """Parts and the suppliers in credit as modules, so that some edges dangle."""
    supplier = a.table(spark, d, "supplier").where("s_acctbal >= 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("canonical_path"))
    return a.modules(spark, d).select("id", "canonical_path").unionByName(supplier)


@query(f"""WITH {a.MODULES}, {a.EDGES}, {_NODES}, root AS {ROOT} SELECT direction, n.id, canonical_path, 0.83::DOUBLE AS confidence FROM (SELECT 'out' AS direction, target_id AS id FROM edges, root WHERE source_id = root.id UNION ALL SELECT 'in', source_id FROM edges, root WHERE target_id = root.id UNION ALL SELECT 'self', id FROM root) JOIN n USING (id)""")
def tool_explain_module(spark, d):
    return tools.explain_module(a.import_edges(spark, d), _nodes(spark, d), first_part(spark, d).first().id)


@query(_walk_sql("target_id", "source_id").replace("SELECT id, min(depth) AS depth", "SELECT id, min(depth) AS depth, 0.88::DOUBLE AS confidence"))
def tool_estimate_blast_radius(spark, d):
    return tools.blast_radius(a.import_edges(spark, d), first_part(spark, d), _DEPTH)


@query(f"WITH {a.MODULES}, {a.COMMITS} {_BRANCH}")
def tool_summarize_branch_changes(spark, d):
    return tools.branch_changes(a.modules(spark, d).where("changed"), a.commits(spark, d))


@query(f"WITH {a.MODULES} SELECT id, canonical_path, symbol, exported, 0.92::DOUBLE AS confidence FROM (SELECT id, canonical_path FROM modules WHERE contains(lower(canonical_path), 'gear-') ORDER BY canonical_path LIMIT 1) LEFT JOIN (SELECT DISTINCT 'p' || l_partkey AS id, 'line' || l_linenumber AS symbol, l_linenumber = 1 AS exported FROM lineitem) USING (id)")
def tool_find_module(spark, d):
    symbols = a.table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("module_id"), F.concat(F.lit("line"), "l_linenumber").alias("name"), (F.col("l_linenumber") == 1).alias("exported")).distinct()
    return tools.find_module(a.modules(spark, d).select("id", "canonical_path"), symbols, "GEAR-")


@query(f"""WITH {a.MODULES}, {a.EDGES} SELECT s.id, p_name AS name, p_size > 25 AS exported, canonical_path, coalesce(array_to_string(list_sort(list_sort(t)[1:10]), '|'), '') AS targets, 0.88::DOUBLE AS confidence FROM (SELECT 'p' || p_partkey AS id, * FROM part WHERE contains(lower(p_name), 'gear')) s
LEFT JOIN modules m ON m.id = CASE WHEN p_size > 40 THEN 'none' ELSE s.id END LEFT JOIN (SELECT source_id, list(target_id) AS t FROM edges GROUP BY 1) e ON e.source_id = s.id""")
def tool_find_symbol(spark, d):
    id_ = F.concat(F.lit("p"), "p_partkey")
    symbols = a.table(spark, d, "part").select(id_.alias("id"), F.col("p_name").alias("name"), (F.col("p_size") > 25).alias("exported"), F.when(F.col("p_size") > 40, "none").otherwise(id_).alias("module_id"))
    return tools.find_symbol(symbols, a.modules(spark, d), a.import_edges(spark, d), "Gear").withColumn("targets", F.array_join("targets", "|"))


@query(f"SELECT id, canonical_path, depth, 0.9::DOUBLE AS confidence FROM ({_walk_sql('source_id', 'target_id')}) JOIN (WITH {a.MODULES} SELECT * FROM modules) USING (id)")
def tool_get_module_dependencies(spark, d):
    return tools.module_dependencies(a.import_edges(spark, d), a.modules(spark, d), first_part(spark, d), _DEPTH)


@query(_walk_sql("target_id", "source_id").replace("SELECT id, min(depth) AS depth", "SELECT id, min(depth) AS depth, 0.84::DOUBLE AS confidence"))
def tool_get_reverse_dependencies(spark, d):
    return tools.reverse_dependencies(a.import_edges(spark, d), first_part(spark, d), _DEPTH)


@query(f"SELECT *, 0.79::DOUBLE AS confidence FROM ({_CAND}) ORDER BY score DESC, suite_path, id LIMIT 10")
def tool_analyze_test_failures(spark, d):
    return tools.analyze_test_failures(a.modules(spark, d).where("changed"), a.test_edges(spark, d), a.test_cases(spark, d)).withColumn("modules", joined("modules"))


@query(f"""WITH {_PAGE_EDGES}, m AS (SELECT url AS canonical_path, min('m' || page_id) AS id FROM pages WHERE NOT contains(url, '?') GROUP BY url) SELECT edge_id, 'fr-only-fr' AS rule_id, x.id AS source_id, y.id AS target_id, 0.9::DOUBLE AS confidence FROM pe LEFT JOIN m x ON x.canonical_path = source_path LEFT JOIN m y ON y.canonical_path = target_path
WHERE regexp_matches(source_path, '{_re('**/fr/**')}') AND NOT (regexp_matches(target_path, '{_re('**/fr/**')}') OR regexp_matches(target_path, '{_re('**.net/**')}'))""")
def tool_check_architecture_violations(spark, d):
    """Violations with the modules of both sides; only pages without a query are known modules."""
    known = a.table(spark, d, "pages").where("NOT contains(url, '?')").select(F.concat(F.lit("m"), "page_id").alias("id"), F.col("url").alias("canonical_path"))
    return tools.architecture_violations(rules.violations(_page_edges(spark, d), rules.table(spark, _RULES)), "warning", known).select("edge_id", "rule_id", "source_id", "target_id", "confidence")


_BUNDLE = f"""WITH RECURSIVE {a.MODULES}, {a.EDGES}, {a.TESTS}, {a.COMMITS}, {_NODES}, root AS {ROOT}, chunks AS (
SELECT 'source' AS kind, id::VARCHAR AS id, 1 AS priority, canonical_path AS text FROM n JOIN root USING (id)
UNION ALL SELECT 'dependency', id, 9 + row_number() OVER (ORDER BY canonical_path, id), canonical_path FROM (SELECT DISTINCT target_id AS id FROM edges JOIN root ON source_id = root.id) JOIN n USING (id)
UNION ALL SELECT 'dependent', id, 49 + row_number() OVER (ORDER BY canonical_path, id), canonical_path FROM (SELECT DISTINCT source_id AS id FROM edges JOIN root ON target_id = root.id) JOIN n USING (id)
UNION ALL SELECT 'test', id, 69 + row_number() OVER (ORDER BY suite_path, id), suite_path || title FROM (SELECT DISTINCT source_id AS id FROM tests JOIN root ON target_id = root.id) JOIN cases USING (id)
UNION ALL SELECT 'change', sha::VARCHAR, 90, authored_at || ' ' || author FROM (SELECT * FROM commits ORDER BY authored_at DESC, sha LIMIT 5)),
c AS (SELECT kind, kind || ':' || id AS id, priority, ceil(length(text) / 3.5)::BIGINT AS tokens, row_number() OVER (ORDER BY priority, kind || ':' || id) AS r FROM chunks),
f AS (SELECT kind, id, priority, r, CASE WHEN tokens <= 120 THEN tokens ELSE 0 END AS used, tokens <= 120 AS included FROM c WHERE r = 1
  UNION ALL SELECT c.kind, c.id, c.priority, c.r, f.used + CASE WHEN f.used + c.tokens <= 120 THEN c.tokens ELSE 0 END, f.used + c.tokens <= 120 FROM f JOIN c ON c.r = f.r + 1)
SELECT kind, id, priority, included FROM f"""


@query(_BUNDLE)
def tool_get_context_bundle(spark, d):
    """The bundle of one module: itself, what it needs, what needs it, its tests and the newest changes."""
    root, edges, n = first_part(spark, d).first().id, a.import_edges(spark, d), _nodes(spark, d)
    placed = lambda ids, order, text: ids.withColumn("pos", F.row_number().over(Window.orderBy(order, "id")) - 1).select("pos", "id", text.alias("text"))  # noqa: E731  the neighbours of one module
    near = lambda here, there: placed(edges.where(F.col(here) == root).select(F.col(there).alias("id")).distinct().join(n, "id"), "canonical_path", F.col("canonical_path"))
    own = n.where(F.col("id") == root).select(F.lit(0).alias("pos"), "id", F.col("canonical_path").alias("text"))
    cases = a.test_edges(spark, d).where(F.col("target_id") == root).select(F.col("source_id").alias("id")).distinct().join(a.test_cases(spark, d), "id")
    changes = a.commits(spark, d).orderBy(F.desc("authored_at"), "sha").limit(5).select(F.lit(0).alias("pos"), F.col("sha").alias("id"), F.concat_ws(" ", "authored_at", "author").alias("text"))
    return tools.context_bundle(own, near("source_id", "target_id"), near("target_id", "source_id"), placed(cases, "suite_path", F.concat("suite_path", "title")), changes, 120)


@query(f"WITH {a.CALLS} SELECT * FROM (SELECT session, seq, tool FROM calls WHERE tool = 'assistant' QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq DESC) <= 2) JOIN (SELECT session, count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed FROM calls GROUP BY session) USING (session)")
def tool_get_retrospect_log(spark, d):
    return tools.retrospect_log(a.calls(spark, d), tool="assistant", limit=2).select("session", "seq", "tool", "total", "succeeded", "failed")


_SHORT = "CASE WHEN length(output) > 800 THEN substr(output, 1, 800) ELSE output END"


@query(f"WITH {a.CALLS} SELECT session, string_agg('- #' || seq || ' ' || tool || ' ' || CASE WHEN success THEN 'ok' ELSE 'failed' END || ' ' || {_SHORT}, chr(10) ORDER BY seq) AS markdown, to_json(list({{'seq': seq, 'tool': tool, 'success': success, 'duration_ms': duration_ms, 'output': {_SHORT}}} ORDER BY seq))::VARCHAR AS json FROM calls GROUP BY session")
def sink_retrospect_export(spark, d):
    """The report of each session as markdown and as JSON."""
    rows = a.calls(spark, d)
    return telemetry.report(rows).join(telemetry.exported(rows), "session")


@query("SELECT o_custkey AS workspace_id, arg_max(status, (o_orderdate, status, o_orderkey)) AS status, coalesce(any_value(hashes), 0) AS hashes, CASE arg_max(status, (o_orderdate, status, o_orderkey)) WHEN 'completed' THEN 0.95 WHEN 'running' THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'queued' END AS status FROM orders) LEFT JOIN (SELECT user_id, count(*) AS hashes FROM events GROUP BY 1) ON user_id = o_custkey GROUP BY 1")
def tool_get_index_status(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("queued")
    jobs = a.table(spark, d, "orders").select(F.col("o_custkey").alias("workspace_id"), F.col("o_orderdate").alias("updated_at"), status.alias("status"), F.col("o_orderkey").alias("id"))
    return tools.index_status(jobs, a.table(spark, d, "events").select(F.col("user_id").alias("workspace_id"))).select("workspace_id", "status", "hashes", "confidence")


@query(f"SELECT p.pos::INT AS pos, p.id, 0.87::DOUBLE AS confidence FROM (SELECT unnest(list_transform(path, lambda x, i: {{'pos': i - 1, 'id': x}})) AS p FROM (SELECT path FROM ({_HOPS}) WHERE cost <= 4 ORDER BY cost DESC, id LIMIT 1))")
def tool_trace_dependency_path(spark, d):
    edges, root = a.import_edges(spark, d), first_part(spark, d).first().id
    far = graph.walk(edges, first_part(spark, d), 4).orderBy(F.desc("depth"), "id").first().id
    return tools.trace_path(edges, root, far)


@query(f"SELECT *, 0.86::DOUBLE AS confidence FROM ({_hybrid_sql(10)})")
def tool_search_code(spark, d):
    return tools.search_code(_indexes(spark, d), *_entities(spark, d), _HYBRID, 10)


# extraction, over the documents as source text


@query("SELECT doc_id::VARCHAR AS path, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS line_no, line FROM (SELECT doc_id, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS pos, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM documents) WHERE trim(line) <> ''")
def ext_lines(spark, d):
    return extract.lines(a.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("SELECT 'module_' || substr(sha256('ws::' || url), 1, 24) AS id, url AS canonical_path FROM (SELECT DISTINCT url FROM pages)")
def ext_evidence(spark, d):
    rows = a.table(spark, d, "pages").select(F.col("url").alias("path"), F.lit("html").alias("language"), F.lit("doc").alias("kind")).distinct()
    return extract.evidence(rows)["modules"].select("id", "canonical_path")


@query(f"""WITH {tree.TREE}, ts AS (SELECT *, doc_id AS i, doc_id - {tree.STEP} AS p, doc_id >= {tree.STEP} AS linked FROM tree WHERE k = 0)
SELECT path, 'symbol' AS what, name || i AS name, kind AS detail, exported::VARCHAR AS more, 0.0::DOUBLE AS confidence FROM ts, (VALUES ('helper', 'function', true), ('local', 'function', false), ('Box', 'class', true), ('grow', 'method', false)) v(name, kind, exported)
UNION ALL SELECT path, 'symbol', 'size', 'field', 'false', 0 FROM ts UNION ALL SELECT path, 'symbol', 'both' || i, 'function', 'true', 0 FROM ts WHERE linked
UNION ALL SELECT path, v.type, v.caller || CASE WHEN v.caller = '' THEN '' ELSE i::VARCHAR END, v.name || CASE WHEN v.name = 'size' THEN '' ELSE i::VARCHAR END, '', v.sure FROM ts, (VALUES ('calls', 'helper', 'local', 0.95), ('references', 'helper', 'local', 0.9), ('references', 'Box', 'size', 0.9), ('calls', 'grow', 'local', 0.95), ('references', 'grow', 'local', 0.9)) v(type, caller, name, sure)
UNION ALL SELECT path, v.type, 'both' || i, 'helper' || p, '../pkg' || (p % 3) || '/mod' || p || '.js', v.sure FROM ts, (VALUES ('calls', 0.65), ('references', 0.6)) v(type, sure) WHERE linked""")
def ext_ts(spark, d):
    """Symbols, calls and references of TypeScript files."""
    facts = extract.script_facts(tree.source_tree(spark, d).where("path LIKE '%/mod%.ts'"))
    symbols = extract.ts_symbols(facts)
    uses = extract.ts_uses(facts).select("path", F.col("type").alias("what"), F.col("caller").alias("name"), F.col("name").alias("detail"), F.coalesce("spec", F.lit("")).alias("more"), "confidence")
    return symbols.select("path", F.lit("symbol").alias("what"), "name", F.col("kind").alias("detail"), F.col("exported").cast("string").alias("more"), F.lit(0.0).alias("confidence")).unionByName(uses)


@query(f"""WITH {tree.TREE}, lua AS (SELECT *, 'M' || doc_id AS m FROM tree WHERE k = 1)
SELECT path, 'symbol' AS what, key AS name, kind AS detail, true AS exported, 0.0::DOUBLE AS confidence FROM lua, LATERAL (SELECT unnest([{{'key': 'table:' || m, 'kind': 'constant'}}, {{'key': 'member:' || m || '.run', 'kind': 'method'}}, {{'key': 'member:' || m || '.step', 'kind': 'method'}}], recursive := true))
UNION ALL SELECT path, 'calls', 'member:' || m || '.run', 'member:' || m || '.step', NULL, 0.72 FROM lua
UNION ALL SELECT path, how, CASE how WHEN 'require' THEN 'game.area' || ((doc_id - {tree.STEP}) % 3) || '.m' ELSE 'm' END || (doc_id - {tree.STEP}), '', NULL, sure FROM lua, (VALUES ('require', 0.75), ('catalog', 0.72)) v(how, sure) WHERE doc_id >= {tree.STEP}""")
def ext_lua(spark, d):
    """Symbols, calls and imports of Lua files."""
    rows = extract.lines(tree.source_tree(spark, d).where("path LIKE '%.lua'"))
    symbols = extract.lua_symbols(rows)
    none = F.lit(None).cast("boolean")
    calls = extract.lua_calls(rows, symbols).select("path", F.lit("calls").alias("what"), F.col("caller").alias("name"), F.col("callee").alias("detail"), none.alias("exported"), "confidence")
    imports = extract.lua_imports(rows).select("path", F.col("how").alias("what"), F.col("reference").alias("name"), F.lit("").alias("detail"), none.alias("exported"), "confidence")
    return symbols.select("path", F.lit("symbol").alias("what"), F.col("key").alias("name"), F.col("kind").alias("detail"), "exported", F.lit(0.0).alias("confidence")).unionByName(calls).unionByName(imports)


@query(f"""WITH {tree.TREE}, cs AS (SELECT path, 'module_' || substr(sha256('ws::' || path), 1, 24) AS module, 'file_' || substr(sha256('ws::' || path), 1, 24) AS file FROM tree WHERE k = 2)
SELECT file AS source_id, module AS target_id, 'contains' AS type, 'csharp source file indexed as file-level evidence for ' || path || '.' AS summary FROM cs UNION ALL SELECT module, 'pkg1', 'belongs_to_package', 'csharp source file indexed as file-level evidence for ' || path || '.' FROM cs""")
def ext_csharp(spark, d):
    """C# files as evidence: a module each, in its file and its package."""
    rows = tree.source_tree(spark, d).where("path LIKE '%.cs'").select("path", F.lit("csharp").alias("language"), F.lit("source").alias("kind"), F.lit("pkg1").alias("package_id"))
    found = extract.evidence(rows)
    owner = found["modules"].select(F.col("canonical_path").alias("owner_file_path"), "summary")
    return found["edges"].join(owner, "owner_file_path").select("source_id", "target_id", "type", "summary")


@query(f"WITH {tree.TREE} SELECT path, len(string_split(split_part(content, mark, 1), chr(10))) AS line_no, 'suite ' || doc_id AS suite, word || ' ' || doc_id AS title, 'vitest' AS framework FROM tree, (VALUES ('works', '  it(''works'), ('later', '  it.skip(''later')) v(word, mark) WHERE k = 3")
def ext_tests(spark, d):
    files = tree.source_tree(spark, d).where(extract.is_test_path(F.col("path")) & F.col("path").endswith(".ts"))
    return extract.tests(extract.script_facts(files)).select("path", "line_no", "suite", "title", "framework")


# indexing

_INDEXED = f"""{tree.TREE}, {_classes_sql('tree')}, own AS (SELECT tree.*, kind, coalesce(language, '') AS language FROM tree JOIN classes USING (path) WHERE kind IN ('source', 'test', 'config', 'manifest', 'doc'))"""
_LINKS = f"""SELECT s.doc_id, s.lang, t.doc_id AS target, s.k FROM own s JOIN tree t ON (s.k IN (0, 1) AND t.doc_id = s.doc_id - {tree.STEP} OR s.k = 3 AND t.doc_id = s.doc_id - 3) WHERE s.kind IN ('source', 'test')"""


def _report_sql(own: str, links: str, extra: str = "0") -> str:
    return f"""SELECT path, kind, language, (CASE WHEN kind NOT IN ('source', 'test') THEN 0 WHEN k = 0 THEN 5 + (doc_id >= {tree.STEP})::INT + {extra} WHEN k = 1 THEN 3 ELSE 0 END)::BIGINT AS symbols, (CASE WHEN kind NOT IN ('source', 'test') THEN 0 WHEN k = 0 THEN 2 + (doc_id >= {tree.STEP})::INT + {extra} WHEN k = 1 THEN 3 ELSE 0 END)::BIGINT AS exports,
(SELECT count(*) FROM ({links}) l WHERE l.doc_id = own.doc_id) + 0 AS outbound, (SELECT count(*) FROM ({links}) l WHERE l.target = own.doc_id) AS inbound, 2 * (SELECT count(*) FROM ({links}) l WHERE l.target = own.doc_id AND l.k = 3) AS tests FROM {own} own"""


@query(f"WITH {_INDEXED}, links AS ({_LINKS}) {_report_sql('own', 'SELECT * FROM links')}")
def tool_index_workspace(spark, d):
    """Every module of a workspace with its symbols, exports, degrees and tests."""
    return indexing.report(indexing.facts(tree.source_tree(spark, d).select("path", "content")))


def _status(spark, d) -> DataFrame:
    """English files are modified, French ones deleted."""
    return tree.source_tree(spark, d).where("lang IN ('en', 'fr')").select("path", F.when(F.col("lang") == "fr", "deleted").otherwise("modified").alias("status"))


def _changed(spark, d) -> indexing.Facts:
    old = tree.source_tree(spark, d).select("path", "content")
    return indexing.changed(indexing.facts(old), tree.source_tree(spark, d, newer=True).select("path", "content"), _status(spark, d))


_AFTER = f"""{_INDEXED}, links AS (SELECT l.* FROM ({_LINKS}) l JOIN tree t ON t.doc_id = l.target WHERE coalesce(l.lang, '') <> 'fr' AND (coalesce(l.lang, '') <> 'en' OR l.k <> 0 OR coalesce(t.lang, '') <> 'fr')), now AS (SELECT * FROM own WHERE coalesce(lang, '') <> 'fr')"""


@query(f"WITH {_AFTER} {_report_sql('now', 'SELECT * FROM links', '(lang = $$en$$)::INT')}".replace("$$", "'"))
def tool_index_changed(spark, d):
    """The same after a change: deleted files are gone, changed ones are read again, the rest keeps its facts."""
    return indexing.report(_changed(spark, d))


@query(f"WITH {_AFTER} SELECT path, 'extra' || doc_id AS name FROM now WHERE k = 0 AND kind IN ('source', 'test') AND lang = 'en'")
def dml_replace_file_fact(spark, d):
    """The symbols that only the changed files have."""
    return _changed(spark, d)["symbols"].where("name LIKE 'extra%'").select(F.col("owner_file_path").alias("path"), "name")


@query(f"WITH {_AFTER} SELECT path, word || ' ' || doc_id AS title FROM now, (VALUES ('works'), ('later')) v(word) WHERE k = 3 AND kind = 'test'")
def dml_replace_test_fact(spark, d):
    """Test cases after the change: those of deleted files are gone with their suites."""
    found = _changed(spark, d)
    return found["cases"].join(found["suites"].select(F.col("id").alias("suite_id")), "suite_id").select(F.col("owner_file_path").alias("path"), "title")


# more of the relational core


@query(f"WITH {a.EDGES}, {a.MODULES}, n AS (SELECT id, canonical_path FROM modules UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier WHERE s_acctbal >= 0) SELECT source_id, target_id, x.canonical_path AS source_path, y.canonical_path AS target_path FROM edges JOIN n x ON x.id = source_id JOIN n y ON y.id = target_id")
def join_edges_modules(spark, d):
    return relational.import_pairs(a.import_edges(spark, d), _nodes(spark, d))


@query(f"SELECT doc_id, source, round(rank, 6) AS rank FROM ({_bm25_sql(('with',))}) JOIN documents ON doc_id = key ORDER BY round(rank, 6), doc_id LIMIT 15")
def join_fts_modules(spark, d):
    found = search.bm25(_index(spark, d, "documents", "doc_id", "text"), ["with"]).withColumn("rank", F.round("rank", 6))
    docs = a.table(spark, d, "documents").select("doc_id", "source")
    return found.join(docs, F.col("key") == F.col("doc_id")).select("doc_id", "source", "rank").orderBy("rank", "doc_id").limit(15)


@query("SELECT l_partkey, l_suppkey, max(l_discount) AS confidence, arg_min(l_returnflag, pos) FILTER (l_returnflag <> 'N') AS metadata FROM (SELECT *, l_orderkey * 100000 + l_linenumber * 10000 + l_quantity * 100 + ascii(l_returnflag) AS pos FROM lineitem) GROUP BY ALL")
def agg_edge_merge_max(spark, d):
    rows = a.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_discount").alias("confidence"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("metadata"), (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_quantity") * 100 + F.ascii("l_returnflag")).alias("pos"))
    return relational.merged_edges(rows, ["l_partkey", "l_suppkey"])


@query("SELECT o_custkey, bool_or(o_orderstatus = 'F') AS exported, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'O') AS container FROM orders GROUP BY o_custkey")
def agg_symbol_merge_or(spark, d):
    rows = a.table(spark, d, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("exported"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("container"), F.col("o_orderkey").alias("pos"))
    return relational.merged_symbols(rows, ["o_custkey"])


@query("SELECT p_brand, arg_max(p_type, (score, -pos)) AS value, max(score) AS score FROM (SELECT p_brand, p_type, sum(p_size)::BIGINT AS score, min(p_partkey) AS pos FROM part GROUP BY ALL) WHERE score > 0 GROUP BY p_brand")
def agg_argmax(spark, d):
    rows = a.table(spark, d, "part").select("p_brand", F.col("p_type").alias("value"), F.col("p_size").alias("confidence"), F.col("p_partkey").alias("pos"))
    return relational.argmax(rows, "p_brand")


@query("SELECT p_brand, p_type, sum(p_size)::BIGINT AS score FROM part GROUP BY ALL")
def agg_signal_votes(spark, d):
    return a.table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.sum("p_size").alias("score"))


@query(f"WITH {a.MODULES} SELECT package_id, array_to_string(list_sort(list_distinct(list(regexp_replace(canonical_path, '^.*/', ''))))[1:8], '|') AS labels FROM modules GROUP BY package_id")
def prj_reference(spark, d):
    return relational.references(a.modules(spark, d), "canonical_path", 8).withColumn("labels", F.array_join("labels", "|"))


@query(f"WITH {a.CALLS} SELECT session, seq FROM calls WHERE tool = 'user' AND success AND seq > 1 QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq DESC) <= 50")
def flt_retrospect(spark, d):
    return telemetry.filtered(a.calls(spark, d), "user", True, 1).select("session", "seq")


@query("SELECT p_partkey, p_brand, 10 + row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS priority FROM part")
def win_priority_rank(spark, d):
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return a.table(spark, d, "part").select("p_partkey", "p_brand", (rank + 10).cast("bigint").alias("priority"))


@query("SELECT 'part' AS kind, p_name AS name FROM part UNION ALL SELECT 'supplier', s_name FROM supplier UNION ALL SELECT 'customer', c_name FROM customer")
def set_union_all(spark, d):
    legs = [a.table(spark, d, n).select(F.lit(n).alias("kind"), F.col(f"{n[0]}_name").alias("name")) for n in ("part", "supplier", "customer")]
    return legs[0].unionByName(legs[1]).unionByName(legs[2])


@query("SELECT DISTINCT p_brand, p_type FROM part WHERE p_size <= 3")
def agg_distinct(spark, d):
    return a.table(spark, d, "part").where("p_size <= 3").select("p_brand", "p_type").distinct()


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def join_subquery_in(spark, d):
    poor = a.table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return a.table(spark, d, "lineitem").join(poor, "l_suppkey", "left_semi").select("l_orderkey", "l_partkey")


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = c_nationkey")
def join_lookup_left(spark, d):
    c = a.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    return a.table(spark, d, "orders").join(c, "o_custkey", "left").join(a.table(spark, d, "nation"), "n_nationkey", "left").select("o_orderkey", "c_name", "n_name")


@query(f"WITH RECURSIVE {a.TESTS}, w AS (SELECT 'p1' AS id, 0 AS depth UNION SELECT source_id, w.depth + 1 FROM w JOIN tests ON target_id = w.id WHERE depth < 2) SELECT id, min(depth) AS depth FROM w GROUP BY id HAVING min(depth) > 0")
def graph_callers(spark, d):
    edges = graph.turned(a.test_edges(spark, d).withColumn("type", F.lit("calls")))
    return graph.walk(edges, spark.createDataFrame([("p1",)], "id string"), 2, ("calls", "references")).where("depth > 0")


@query(f"WITH {a.TESTS}, root AS (SELECT min(source_id) AS id FROM tests), d1 AS (SELECT DISTINCT target_id AS id FROM tests JOIN root ON source_id = root.id) SELECT id, 1 AS depth FROM d1")
def graph_callees(spark, d):
    edges = a.test_edges(spark, d).withColumn("type", F.lit("calls"))
    return graph.walk(edges, edges.agg(F.min("source_id").alias("id")), 2, ("calls", "references")).where("depth > 0")


@query("SELECT p_partkey AS key, token, len(tokens)::INT AS doc_len, count(*) AS tf FROM (SELECT p_partkey, tokens, unnest(tokens) AS token FROM (SELECT p_partkey, " + _TOK.format("p_name || ' ' || p_type") + " AS tokens FROM part)) GROUP BY ALL")
def dml_refresh_fts(spark, d):
    parts = a.table(spark, d, "part")
    old = F.crc32(F.col("p_name").cast("binary")) % 3  # a third had another name before, a third was not there
    before = parts.where(old < 2).withColumn("p_name", F.when(old == 0, F.reverse("p_name")).otherwise(F.col("p_name")))
    lost = spark.createDataFrame([(-1, "gone with the wind", "economy")], "p_partkey bigint, p_name string, p_type string")
    index = fulltext.write_index(before.select("p_partkey", "p_name", "p_type").unionByName(lost), "p_partkey", ("p_name", "p_type"), f"{shared_dir(spark).rstrip('/')}/refresh-{uuid.uuid4().hex}")
    index = fulltext.refreshed(index, parts.where(old != 1), "p_partkey", lost.select(F.col("p_partkey").alias("key")))
    return index.postings(F.col("token") != "").select("key", "token", "doc_len", "tf")


_GENERATED = t.any_glob(c.GENERATED_GLOBS).replace("'", "''")


@query(f"WITH {tree.TREE} SELECT path, regexp_matches(path, '{_GENERATED}') AS generated FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'x/dist/' || path WHEN 1 THEN path || '.min.js' WHEN 2 THEN 'x/' || doc_id || '.pb.go' WHEN 3 THEN 'dist/' || doc_id ELSE path END AS path FROM tree)")
def rule_generated(spark, d):
    n = F.col("doc_id") % 5
    path = F.when(n == 0, F.concat(F.lit("x/dist/"), "path")).when(n == 1, F.concat("path", F.lit(".min.js"))).when(n == 2, F.concat(F.lit("x/"), "doc_id", F.lit(".pb.go"))).when(n == 3, F.concat(F.lit("dist/"), "doc_id")).otherwise(F.col("path"))
    return tree.source_tree(spark, d).select(path.alias("path")).select("path", rules.generated("path").alias("generated"))


@query("SELECT l_orderkey * 10 + l_linenumber AS id, nullif(l_returnflag, 'N') AS name, l_linestatus = 'F' AS exported, l_linenumber AS start_line, l_quantity::BIGINT AS end_column, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_returnflag END AS flag FROM lineitem")
def prj_row_mappers(spark, d):
    """Stored rows as records, their nested fields read back; broken and missing JSON is an empty map."""
    li, n = a.table(spark, d, "lineitem"), F.col("l_linenumber")
    json = F.when(n % 3 != 0, F.concat(F.lit('{"flag":"'), "l_returnflag", F.lit('"}'))).when(n == 3, F.lit("{broken"))
    rows = li.select(
        (F.col("l_orderkey") * 10 + n).alias("id"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("name"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("exported"),
        n.alias("start_line"), F.lit(1).alias("start_column"), n.alias("end_line"), F.col("l_quantity").cast("bigint").alias("end_column"), json.alias("metadata_json"),
    )
    return relational.symbol_records(rows).select("id", "name", "exported", F.col("range.start.line").alias("start_line"), F.col("range.end.column").alias("end_column"), F.try_element_at("metadata", F.lit("flag")).alias("flag"))


@query("SELECT o_custkey AS workspace_id, arg_max(status, (updated_at, id)) AS status FROM (SELECT o_orderkey AS id, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS updated_at, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'running' END AS status FROM orders UNION ALL SELECT o_orderkey, o_custkey, '9999', 'failed' FROM orders WHERE o_orderstatus = 'O') GROUP BY o_custkey")
def dml_index_job(spark, d):
    """Jobs start, and open ones fail later; a job that is done keeps its state."""
    o = a.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("workspace_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"), "o_orderstatus")
    later = o.where("o_orderstatus IN ('O', 'F')").withColumns({"status": F.lit("failed"), "updated_at": F.lit("9999")})
    return relational.latest(relational.job_log(o.drop("o_orderstatus"), later).select("workspace_id", "updated_at", "id", "status"), "workspace_id", "updated_at").select("workspace_id", "status")


@query(f"WITH {a.MODULES}, {tree.TREE} SELECT page_id, content FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'docs/d' || page_id || '.md' ELSE url END AS canonical_path FROM pages) LEFT JOIN tree ON path = canonical_path")
def src_module_source(spark, d):
    """The sources of modules; some have no file."""
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("docs/d"), "page_id", F.lit(".md"))).otherwise(F.col("url"))
    return files_source.module_source(a.table(spark, d, "pages").select("page_id", path.alias("canonical_path")), tree.source_tree(spark, d)).select("page_id", "content")


# streaming


@query(_INC)
def stream_incidents(spark, d):
    e = log_stream.read(spark, d)
    return log_stream.run_once(log_stream.roll_up(a.log_events_of(e)), "complete", shared_dir(spark))


@query("WITH w AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1) SELECT * FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_windows(spark, d):
    return log_stream.run_once(log_stream.windows(log_stream.read(spark, d)), "append", shared_dir(spark))
