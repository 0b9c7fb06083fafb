"""Indexing a workspace: files to facts, whole or only what changed.

Facts are a frame for each table: ``files, modules, symbols, edges, suites, cases, hashes``. Every row has the path of the
file that owns it in ``owner_file_path``, so that a file's facts are replaced by one anti-join for each table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as t
from factloom.operators import classify, extract, relational
from factloom.plans.lineage import cut

Facts = dict[str, DataFrame]
EXTRACTOR, PARSER = "lines-v2", "lines-v2"
#: Languages whose texts are read; of other files only the hash is kept.
READ = ("typescript", "javascript", "lua")


def _edge(kind: str, source: F.Column, target: F.Column, path: str = "path", confidence: float | F.Column = 1.0) -> F.Column:
    sure = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(t.stable_id("edge", F.lit(kind), source, target, F.col(path)).alias("id"), source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("type"), sure.alias("confidence"), F.col(path).alias("owner_file_path"))


def _id(kind: str, ws: str, *parts: F.Column | str) -> F.Column:
    return t.stable_id(kind, F.lit(ws), *parts)


def _edges_of(rows: DataFrame, edge: F.Column) -> DataFrame:
    """An edge a row, its type plain to the optimizer, so that who wants some types has only those made."""
    return rows.select(edge.alias("e")).select("e.*")


def facts(files: DataFrame, known: DataFrame | None = None, ws: str = "ws") -> Facts:
    """The facts of ``files(path, content)``. ``known(path, language)``: all files that an import may mean; by default these."""
    read = F.col("kind").isin("source", "test") & F.col("language").isin(*READ)
    typed = classify.indexable(classify.classify(files)).withColumn("hash", F.sha2("content", 256))
    typed = cut(typed.withColumn("content", F.when(read, F.col("content"))))
    known = cut(files.select("path", t.language(F.col("path")).alias("language")) if known is None else known)
    code = typed.where(F.col("kind").isin("source", "test"))
    module = _id("module", ws, "path")

    ts = code.where(F.col("language").isin("typescript", "javascript"))
    facts = cut(extract.script_facts(ts))
    ts_symbols, imports = extract.ts_symbols(facts), extract.ts_imports(facts)
    resolved = relational.import_candidates(imports.select(F.concat_ws("\u001f", "path", "spec").alias("import_id"), F.col("path").alias("from_path"), "spec").distinct(), known)
    resolved = cut(resolved.select(F.split("import_id", "\u001f")[0].alias("path"), F.split("import_id", "\u001f")[1].alias("spec"), F.col("path").alias("target")))
    ts_ids = ts_symbols.select("path", _id("symbol", ws, "path", "name").alias("id"), "name", "kind", "exported", "line_no")
    uses = extract.ts_uses(facts).join(resolved, ["path", "spec"], "left").where("spec IS NULL OR target IS NOT NULL")
    used = _id("symbol", ws, F.coalesce("target", "path"), "name")
    ts_uses = uses.select("path", _id("symbol", ws, "path", "caller").alias("source"), used.alias("used"), "type", "confidence")

    lua = code.where("language = 'lua'")
    lua_rows = cut(extract.lua_lines(extract.lines(lua)))  # once from the texts, of which it is a small part
    lua_symbols = cut(extract.lua_symbols(lua_rows))
    wanted = extract.lua_imports(lua_rows).withColumn("id", F.concat_ws("\u001f", "path", "reference"))
    by_name = relational.required(wanted.where("how = 'require'").select("id", F.col("path").alias("from_path"), F.col("reference").alias("module")), known)
    by_catalog = relational.resolve(wanted.where("how = 'catalog'").select(F.col("id").alias("ref_id"), "reference", F.col("path").alias("from_path"), F.lit("lua").alias("language")), known)
    lua_targets = by_name.select("id", F.col("path").alias("target"), F.lit("require").alias("how")).unionByName(by_catalog.select(F.col("ref_id").alias("id"), F.col("path").alias("target"), F.lit("catalog").alias("how")))
    lua_imports = wanted.join(lua_targets, ["id", "how"]).groupBy("path", "target").agg(F.max("confidence").alias("confidence"))
    lua_ids = lua_symbols.select("path", _id("symbol", ws, "path", "key").alias("id"), "name", "kind", "exported", "line_no")
    lua_calls = extract.lua_calls(lua_rows, lua_symbols).select("path", _id("symbol", ws, "path", "caller").alias("source"), _id("symbol", ws, "path", "callee").alias("used"), F.lit("calls").alias("type"), "confidence")

    symbols = cut(ts_ids.unionByName(lua_ids))
    imported = resolved.select("path", "target", F.lit(1.0).alias("confidence")).distinct().unionByName(lua_imports)

    tested = classify.test_extractable(typed).where(extract.is_test_path(F.col("path"))).select("path")
    found = extract.tests(facts).join(tested, "path", "left_semi")
    suite = _id("test-suite", ws, "path")
    case = _id("test-case", ws, "path", F.coalesce(F.nullif("suite", F.lit("")), t.basename(F.col("path"))), "title", F.col("line_no").cast("string"))
    cases = found.select(case.alias("id"), suite.alias("suite_id"), "title", "suite", "line_no", F.col("path").alias("owner_file_path"))
    covers = found.select("path", case.alias("case_id")).join(imported.select("path", "target").distinct(), "path")

    kind_edge = lambda df: df.select(t.stable_id("edge", F.col("type"), "source", "used", "path").alias("id"), F.col("source").alias("source_id"), F.col("used").alias("target_id"), "type", "confidence", F.col("path").alias("owner_file_path"))
    target = _id("module", ws, "target")
    edges = (
        _edges_of(typed, _edge("contains", _id("file", ws, "path"), module))
        .unionByName(_edges_of(symbols, _edge("declares", module, F.col("id"))))
        .unionByName(_edges_of(symbols.where("exported"), _edge("exports", module, F.col("id"), confidence=0.95)))
        .unionByName(_edges_of(imported, _edge("imports", module, target, confidence=F.col("confidence"))))
        .unionByName(_edges_of(covers, _edge("tests", F.col("case_id"), target, confidence=0.9)))
        .unionByName(kind_edge(ts_uses)).unionByName(kind_edge(lua_calls))
    )
    return {
        "files": typed.select(_id("file", ws, "path").alias("id"), "path", "language", "kind", F.col("path").alias("owner_file_path")),
        "modules": typed.select(module.alias("id"), _id("file", ws, "path").alias("file_id"), F.col("path").alias("canonical_path"), "language", "kind", F.col("path").alias("owner_file_path")),
        "symbols": symbols.withColumnRenamed("path", "owner_file_path"),
        "edges": edges.groupBy("id", "source_id", "target_id", "type", "owner_file_path").agg(F.max("confidence").alias("confidence")),
        "suites": found.groupBy("path").agg(F.first("framework").alias("framework")).select(suite.alias("id"), t.basename(F.col("path")).alias("name"), "framework", F.col("path").alias("owner_file_path")),
        "cases": cases,
        "hashes": typed.select("path", F.col("hash").alias("content_hash"), F.lit(EXTRACTOR).alias("extractor_version"), F.lit(PARSER).alias("parser_version"), F.col("path").alias("owner_file_path")),
    }


def replaced(old: Facts, new: Facts, paths: DataFrame) -> Facts:
    """Every table without what the files ``paths(path)`` own, and with the ``new`` rows. An edge goes with its owner's file only."""
    gone = paths.select(F.col("path").alias("owner_file_path")).distinct()
    return {name: old[name].join(gone, "owner_file_path", "left_anti").select(*old[name].columns).unionByName(new[name].select(*old[name].columns)) for name in old}


def changed(stored: Facts, files: DataFrame, status: DataFrame, ws: str = "ws") -> Facts:
    """The facts after a change: ``files(path, content)`` is the tree as it is now, ``status(path, status)`` what version control says.

    Deleted files lose their facts. Of the others only those are read again whose hash or reader's version is not the
    stored one; an import may mean any file of the tree.
    """
    gone = status.where("status = 'deleted'").select("path")
    touched = files.join(status.where("status <> 'deleted'").select("path"), "path", "left_semi")
    stamp = {"content_hash": F.sha2("content", 256), "extractor_version": F.lit(EXTRACTOR), "parser_version": F.lit(PARSER), "workspace_id": F.lit(ws)}
    again = cut(relational.unchanged(touched.withColumns(stamp), stored["hashes"].withColumn("workspace_id", F.lit(ws))).select("path", "content"))
    new = facts(again, files.select("path", t.language(F.col("path")).alias("language")), ws)
    return replaced(stored, new, gone.unionByName(again.select("path")))


def report(found: Facts) -> DataFrame:
    """``path, kind, language, symbols, exports, outbound, inbound, tests`` of every module."""
    edges = cut(found["edges"].where("type IN ('imports', 'tests')").select("source_id", "target_id", "type"))
    degrees = relational.degrees(found["modules"], edges)
    own = found["symbols"].groupBy(F.col("owner_file_path").alias("canonical_path")).agg(F.count("*").alias("symbols"), F.count_if("exported").alias("exports"))
    tests = edges.where("type = 'tests'").groupBy(F.col("target_id").alias("id")).agg(F.count_distinct("source_id").alias("tests"))
    rows = found["modules"].join(degrees.select("id", "outbound", "inbound"), "id").join(own, "canonical_path", "left").join(tests, "id", "left")
    return rows.na.fill(0, ["symbols", "exports", "tests"]).select(F.col("canonical_path").alias("path"), "kind", F.coalesce("language", F.lit("")).alias("language"), "symbols", "exports", "outbound", "inbound", "tests")
