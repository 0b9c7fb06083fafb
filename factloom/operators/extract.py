"""Facts from source text: symbols, imports, calls and tests as typed rows and edges.

TypeScript, JavaScript and their tests are read by :mod:`factloom.functions.scripts`, a text at a time. Lua is read by line
patterns with a carried scope.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import conventions as c
from factloom.functions import scripts
from factloom.functions import text as t


def lines(files: DataFrame) -> DataFrame:
    """``(path, line_no, line)`` of ``files(path, content)``; only lines with text count."""
    kept = F.filter(F.split("content", "\r?\n"), lambda x: F.trim(x) != "")
    return files.select("path", F.posexplode(kept).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_no"), "line")


def lua_lines(rows: DataFrame) -> DataFrame:
    """The lines that can say anything in Lua, as every pattern here asks for one of these signs or words."""
    return rows.where(t.holds(F.col("line"), "=", "(", "return") | (F.trim("line") == "end"))


def _found(rows: DataFrame, pattern: str, *names: str) -> DataFrame:
    """Rows on which the pattern matches, its groups as columns."""
    groups = [F.regexp_extract("line", pattern, i + 1).alias(n) for i, n in enumerate(names)]
    return rows.where(F.col("line").rlike(pattern)).select("path", "line_no", *groups)


def _all(rows: DataFrame, pattern: str, name: str, *others: str) -> DataFrame:
    return rows.select("path", "line_no", *others, F.explode(F.regexp_extract_all("line", F.lit(pattern), 1)).alias(name))


def scoped(rows: DataFrame, opens: Column, closes: Column) -> DataFrame:
    """``rows`` with ``scope``: the name last opened, carried until a line that closes it."""
    w = Window.partitionBy("path").orderBy("line_no")
    block = F.sum(F.when(closes, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = rows.withColumn("s_block", F.coalesce(block, F.lit(0))).withColumn("s_name", F.nullif(opens, F.lit("")))
    inner = Window.partitionBy("path", "s_block").orderBy("line_no")
    return grouped.withColumn("scope", F.last("s_name", ignorenulls=True).over(inner)).drop("s_block", "s_name")


def _member(i: int) -> Column:
    """The table (1) or the name (2) of the member that a line declares, in either way of writing; null if it declares none."""
    return F.coalesce(*(F.nullif(F.regexp_extract("line", pattern, i), F.lit("")) for pattern in (c.LUA_MEMBER, c.LUA_ASSIGNED_MEMBER)))


def _members(rows: DataFrame) -> DataFrame:
    """``(path, line_no, owner, name)`` of functions in tables."""
    return rows.select("path", "line_no", "line", _member(1).alias("owner"), _member(2).alias("name")).where(F.col("owner").isNotNull() & ~F.col("line").rlike(c.LUA_FUNCTION)).drop("line")


def _last(path: str) -> Column:
    return F.element_at(F.split(path, r"\."), -1)


def lua_symbols(rows: DataFrame) -> DataFrame:
    """``(path, key, name, kind, container, exported, line_no)``: tables as constants, functions, and methods with their tables.

    A key counts once in a file: exported if any declaration is, the first line and container there is. What a file
    returns is exported, and with a table all its members.
    """
    none = F.lit(None).cast("string")
    tables = _found(rows, c.LUA_TABLE, "local", "name").select("path", "line_no", F.lit(0).alias("o"), F.concat(F.lit("table:"), "name").alias("key"), "name", F.lit("constant").alias("kind"), F.col("name").alias("container"), (F.col("local") == "").alias("exported"))
    plain = _found(rows, c.LUA_FUNCTION, "local", "name").select("path", "line_no", F.lit(0).alias("o"), F.concat(F.lit("function:"), "name").alias("key"), "name", F.lit("function").alias("kind"), none.alias("container"), (F.col("local") == "").alias("exported"))
    members = _members(rows)
    owners = members.select("path", "line_no", F.lit(0).alias("o"), F.concat(F.lit("table:"), "owner").alias("key"), _last("owner").alias("name"), F.lit("constant").alias("kind"), _last("owner").alias("container"), F.lit(False).alias("exported"))
    own = members.select("path", "line_no", F.lit(1).alias("o"), F.concat(F.lit("member:"), "owner", F.lit("."), "name").alias("key"), "name", F.lit("method").alias("kind"), _last("owner").alias("container"), F.lit(False).alias("exported"))
    found = tables.unionByName(plain).unionByName(owners).unionByName(own)
    first = F.struct("line_no", "o")
    per = found.groupBy("path", "key").agg(F.min_by("name", first).alias("name"), F.min_by("kind", first).alias("kind"), F.min_by("container", F.when(F.col("container").isNotNull(), first)).alias("container"), F.bool_or("exported").alias("own"), F.min(first).alias("at"))
    returned = _found(rows, rf"^\s*return\s+({c.LUA_NAME})\s*$", "table").select("path", "table").distinct().groupBy("path").agg(F.collect_set("table").alias("returned"))  # names of one file
    shown = F.coalesce(F.array_contains("returned", F.col("name")) | F.coalesce(F.array_contains("returned", F.col("container")), F.lit(False)), F.lit(False))
    return per.join(returned, "path", "left").select("path", "key", "name", "kind", "container", (F.col("own") | shown).alias("exported"), F.col("at.line_no").alias("line_no"), F.col("at.o").alias("o"))


def lua_imports(rows: DataFrame) -> DataFrame:
    """``(path, reference, confidence, how)``: modules required by name, and looked up in the catalog."""
    required = _all(rows, c.LUA_REQUIRE, "reference").withColumns({"confidence": F.lit(0.75), "how": F.lit("require")})
    looked_up = _all(rows, c.LUA_LOOKED_UP, "reference").withColumns({"confidence": F.lit(0.72), "how": F.lit("catalog")})
    return required.unionByName(looked_up).select("path", "reference", "confidence", "how").distinct()


def lua_calls(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(path, caller, callee, confidence)`` between keys of :func:`lua_symbols`: member calls 0.72, bare ones 0.65.

    The caller is the function opened last, up to a line that is just ``end``. ``self`` is the caller's table; a name that
    is no member of what stands before it is the file's first symbol of that name.
    """
    member = F.concat(F.lit("member:"), _member(1), F.lit("."), _member(2))
    plain = F.concat(F.lit("function:"), F.nullif(F.regexp_extract("line", c.LUA_FUNCTION, 2), F.lit("")))
    inside = scoped(rows, F.coalesce(plain, member, F.lit("")), F.trim("line") == "end").where("scope IS NOT NULL")
    pairs = inside.select("path", "scope", F.explode(F.expr(rf"regexp_extract_all(line, '({c.LUA_NAME}[:.]{c.LUA_NAME})\\s*\\(', 1)")).alias("x")).select("path", "scope", F.split("x", "[:.]")[0].alias("base"), F.split("x", "[:.]")[1].alias("name"), F.lit(0.72).alias("confidence"))
    bare = _all(inside, rf"\b({c.LUA_NAME})\s*\(", "name", "scope").where(~F.col("name").isin(*c.LUA_WORDS)).select("path", "scope", F.lit(None).cast("string").alias("base"), "name", F.lit(0.65).alias("confidence"))
    uses = pairs.unionByName(bare).distinct()
    own = symbols.select("path", F.col("key").alias("scope"), F.col("container").alias("own"))
    uses = uses.join(own, ["path", "scope"]).withColumn("base", F.when((F.col("base") == "self") & F.col("own").isNotNull(), F.col("own")).otherwise(F.col("base")))
    at = F.struct("line_no", "o")
    members = symbols.where("container IS NOT NULL").groupBy("path", F.col("container").alias("base"), "name").agg(F.max_by("key", at).alias("member"))
    firsts = symbols.groupBy("path", "name").agg(F.min_by("key", at).alias("first"))
    met = uses.join(members, ["path", "base", "name"], "left").join(firsts, ["path", "name"], "left").select("path", F.col("scope").alias("caller"), F.coalesce("member", "first").alias("callee"), "confidence")
    return met.where("callee IS NOT NULL AND callee <> caller").groupBy("path", "caller", "callee").agg(F.max("confidence").alias("confidence"))


SCRIPT = "path string, what string, name string, line_no bigint, kind string, exported boolean, caller string, type string, confidence double, spec string, names array<struct<local: string, there: string>>, suite string, framework string"
#: Facts that leave a task together.
EMITTED = 1 << 14


def _script_rows(path: str, text: str) -> Iterator[dict]:
    found = scripts.facts(text)
    known = {}
    for name, kind, exported, line in found.symbols:  # of a name's declarations the last holds
        known[name] = {"what": "symbol", "name": name, "kind": kind, "exported": exported, "line_no": line}
    bound = {}
    for spec, names, line in found.imports:
        local = spec.startswith(".")
        if local:
            bound.update((here, (spec, there)) for here, there in names)
        yield {"path": path, "what": "import", "spec": spec, "line_no": line, "names": [{"local": h, "there": x} for h, x in names]}
    for row in known.values():
        yield {"path": path, **row}
    for caller, name, type_ in sorted(found.uses):
        call = type_ == "calls"
        if name in known and (call or name != caller):
            yield {"path": path, "what": "use", "caller": caller, "name": name, "type": type_, "confidence": 0.95 if call else 0.9}
        elif name in bound and (not call or name not in known):
            yield {"path": path, "what": "use", "caller": caller, "name": bound[name][1], "type": type_, "confidence": 0.65 if call else 0.6, "spec": bound[name][0]}
    framework = found.framework(text)
    for title, suites, line in found.cases or [(path.rpartition("/")[2], (), 1)]:
        yield {"path": path, "what": "case", "name": title, "suite": " > ".join(suites), "line_no": line, "framework": framework}


def script_facts(files: DataFrame) -> DataFrame:
    """Everything that TypeScript and JavaScript texts ``(path, content)`` say, in one pass without a shuffle: rows of
    ``SCRIPT``, ``what`` one of import, symbol, use and case. A text is met whole in a task, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                rows += _script_rows(batch.column("path")[i].as_py(), batch.column("content")[i].as_py() or "")
                if len(rows) >= EMITTED:
                    yield _script_batch(rows)
                    rows = []
        if rows:
            yield _script_batch(rows)

    return files.where("path IS NOT NULL").select("path", "content").mapInArrow(run, SCRIPT)


def _script_batch(rows: list[dict]) -> pa.RecordBatch:
    name = pa.list_(pa.struct([("local", pa.string()), ("there", pa.string())]))
    kinds = {"line_no": pa.int64(), "exported": pa.bool_(), "confidence": pa.float64(), "names": name}
    columns = [f.split()[0] for f in SCRIPT.partition(", names")[0].split(", ")] + ["names", "suite", "framework"]
    return pa.RecordBatch.from_pylist(rows, pa.schema([(c, kinds.get(c, pa.string())) for c in columns]))


def ts_imports(facts: DataFrame) -> DataFrame:
    """Relative imports at the top of files: ``(path, line_no, spec, names)``; ``names``: local names of the default and the named bindings."""
    return facts.where("what = 'import' AND startswith(spec, '.')").select("path", "line_no", "spec", F.array_distinct("names.local").alias("names"))


def ts_symbols(facts: DataFrame) -> DataFrame:
    """``(path, name, line_no, kind, exported)``; of a name's declarations in a file the last holds."""
    return facts.where("what = 'symbol'").select("path", "name", "line_no", "kind", "exported")


def ts_uses(facts: DataFrame) -> DataFrame:
    """``(path, caller, name, type, confidence, spec)``: calls (0.95 local, 0.65 imported) and references (0.9 and 0.6) of known names.

    The caller is the innermost function, method or class around. What is called is referred to as well. ``spec``: where an
    imported name comes from; ``name`` is then what it is called there.
    """
    return facts.where("what = 'use'").select("path", "caller", "name", "type", "confidence", "spec")


def tests(facts: DataFrame) -> DataFrame:
    """``(path, line_no, suite, title, framework)``: test cases with the titles of the suites around them. A test file without a case is one case."""
    return facts.where("what = 'case'").select("path", "line_no", F.col("name").alias("title"), "suite", "framework")


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(tests?|__tests__)/") | path.rlike(r"\.(test|spec)\.[jt]sx?$")


def evidence(files: DataFrame, workspace: str = "ws") -> dict[str, DataFrame]:
    """What every indexable file ``(path, language, kind)`` yields: a file, a module with a summary, and an edge that the one
    contains the other; with a ``package_id`` also one that the module belongs to it."""
    file_id, module_id = t.stable_id("file", F.lit(workspace), "path"), t.stable_id("module", F.lit(workspace), "path")

    def edge(kind: str, source: Column, target: Column) -> Column:
        return F.struct(t.stable_id("edge", F.lit(kind), source, target, "path").alias("id"), source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("type"), F.lit(1.0).alias("confidence"), F.col("path").alias("owner_file_path"))

    edges = [edge("contains", file_id, module_id)]
    if "package_id" in files.columns:
        edges.append(F.when(F.col("package_id").isNotNull(), edge("belongs_to_package", module_id, F.col("package_id"))))
    summary = F.concat(F.coalesce("language", F.lit("unknown")), F.lit(" "), "kind", F.lit(" file indexed as file-level evidence for "), "path", F.lit("."))
    return {
        "files": files.select(file_id.alias("id"), "path", "language"),
        "modules": files.select(module_id.alias("id"), file_id.alias("file_id"), F.col("path").alias("canonical_path"), "language", summary.alias("summary")),
        "edges": files.select(F.explode(F.filter(F.array(*edges), lambda e: e.isNotNull())).alias("e")).select("e.*"),
    }
