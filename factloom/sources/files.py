"""Workspace files: discovery, ignore rules, manifests and packages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import conventions as c
from factloom.functions import text as t
from factloom.functions.ignores import Matcher
from factloom.sources.listing import files_below



def discover(spark: SparkSession, root: str, ignored: tuple[str, ...] = c.IGNORED, rules: tuple[str, ...] = ()) -> DataFrame:
    """Source, evidence and manifest files below ``root``: paths, size, time, and text where there is any.

    Folders of the names ``ignored``, and what the ignore lines ``rules`` exclude, are not listed at all.
    """
    wanted = t.listing_regex(c.SOURCE_GLOBS + c.EVIDENCE_GLOBS + c.MANIFEST_GLOBS)
    rows = files_below(spark, root, (*rules, *(f"{escaped(name)}/" for name in ignored)), wanted)
    ext = t.extension(F.col("rel_path"))
    return rows.select(F.col("path").alias("abs_path"), "rel_path", t.basename(F.col("rel_path")).alias("basename"), ext.alias("extension"), F.col("length").alias("size_bytes"), "modified_at", F.when(~ext.isin(*c.BINARY), F.decode("content", "UTF-8")).alias("content"))


def escaped(name: str) -> str:
    """An ignore line for exactly this name."""
    return re.sub(r"([\\*?\[\]!# ])", r"\\\1", name)


def ignore_lines(spark: SparkSession, root: str, name: str = ".gitignore") -> tuple[str, ...]:
    """The lines of the ignore file in ``root``; none if there is none."""
    return tuple((first_config(spark, root, (name,)) or "").splitlines())


def candidates(files: DataFrame, ignored: tuple[str, ...] = c.IGNORED) -> DataFrame:
    """Those of ``files(rel_path, ...)`` that a source, evidence or manifest glob names, outside ignored folders."""
    folders = F.slice(F.split("rel_path", "/"), F.lit(1), F.size(F.split("rel_path", "/")) - 1)
    return files.where(F.col("rel_path").rlike(t.listing_regex(c.SOURCE_GLOBS + c.EVIDENCE_GLOBS + c.MANIFEST_GLOBS)) & ~F.exists(folders, lambda d: d.isin(*ignored)))


def not_ignored(files: DataFrame, lines: list[str] | tuple[str, ...]) -> DataFrame:
    """``files(rel_path)`` without those that the lines of an ignore file exclude, see :mod:`factloom.functions.ignores`."""
    lines = list(lines)

    @F.pandas_udf("boolean")
    def ignored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(lines)
        for paths in batches:
            yield paths.map(lambda p: matcher.ignores(p or ""))

    return files.where(~ignored("rel_path")) if lines else files


def manifest_hints(files: DataFrame) -> DataFrame:
    """What each manifest of ``files(rel_path, basename, extension, content)`` says.

    ``(path, root, kind, name, language, languages, source_roots, test_roots, package_roots, generated_dirs, ignored_dirs,
    build_systems, workspaces, is_test)``; a ``package.json`` that is no JSON is left out.
    """
    root, name, body = t.dirname(F.col("rel_path")), F.col("basename"), F.coalesce("content", F.lit(""))
    kind = F.when(name == "package.json", "package_json").when(name == "pyproject.toml", "pyproject").when(name == "Cargo.toml", "cargo").when(name == "go.mod", "go_mod").when(F.col("extension") == "csproj", "csproj")
    rows = files.withColumns({"kind": kind, "root": root}).where("kind IS NOT NULL AND (kind <> 'package_json' OR try_parse_json(content) IS NOT NULL)")
    rows = rows.withColumn("json", F.try_parse_json("content"))
    names = lambda path: F.try_variant_get("json", path, "array<string>")
    listed = F.when(F.col("kind") == "package_json", F.coalesce(names("$.workspaces"), names("$.workspaces.packages"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("listed", listed)
    at = lambda *parts: F.filter(F.array(*(F.concat_ws("/", F.nullif("root", F.lit("")), F.nullif(F.lit(x), F.lit(""))) for x in parts)), lambda x: x != "")
    members = F.transform(F.filter(F.transform("listed", lambda w: F.regexp_replace(w, r"[\\/]*\*.*$", "")), lambda w: w != ""), lambda w: F.concat_ws("/", F.nullif("root", F.lit("")), w))
    typed = F.coalesce(F.try_variant_get("json", "$.devDependencies.typescript", "string"), F.try_variant_get("json", "$.dependencies.typescript", "string")).isNotNull()
    tests = name.rlike("(?i)test")
    src_layout = body.rlike(r'''(?m)^\s*packages\s*=|^\s*package-dir\s*=|^\s*where\s*=\s*\["src"\]''')
    backend = F.nullif(F.regexp_extract(body, r'''build-backend\s*=\s*"([^"]+)"''', 1), F.lit(""))
    strings = lambda *xs: F.array(*map(F.lit, xs))

    def by_kind(package_json, pyproject, cargo, go_mod, csproj):
        pairs = zip(("package_json", "pyproject", "cargo", "go_mod", "csproj"), (package_json, pyproject, cargo, go_mod, csproj), strict=True)
        out = F.lit(None)
        for k, v in pairs:
            out = F.when(F.col("kind") == k, v).otherwise(out)
        return out

    return rows.select(
        F.col("rel_path").alias("path"), "root", "kind", F.coalesce(F.when(F.col("kind") == "package_json", F.try_variant_get("json", "$.name", "string")), t.basename(F.col("root"))).alias("name"),
        by_kind(*map(F.lit, ("javascript", "python", "rust", "go", "csharp"))).alias("language"),
        by_kind(F.when(typed, strings("javascript", "typescript")).otherwise(strings("javascript")), strings("python"), strings("rust"), strings("go"), strings("csharp")).alias("languages"),
        by_kind(at("src", "app"), F.when(src_layout, at("src")).otherwise(at("")), at("src"), at("cmd", "pkg", "internal"), at("")).alias("source_roots"),
        by_kind(at("test", "tests", "spec"), at("tests"), at("tests", "benches"), at("pkg", "internal"), F.when(tests, at("")).otherwise(F.array().cast("array<string>"))).alias("test_roots"),
        by_kind(F.concat(at(""), members), at(""), at(""), at(""), at("")).alias("package_roots"),
        by_kind(at("dist", "build", ".next"), at("dist", "build"), at("target"), at("vendor"), at("obj", "bin")).alias("generated_dirs"),
        by_kind(at("node_modules", "dist", "build"), at(".venv", "dist", "build"), at("target"), at("vendor"), at("obj", "bin", "TestResults")).alias("ignored_dirs"),
        by_kind(strings("node"), F.array(F.coalesce(backend, F.lit("python"))), strings("cargo"), strings("go"), strings("dotnet", "msbuild")).alias("build_systems"),
        F.size("listed").alias("workspaces"), F.when(F.col("kind") == "csproj", tests).otherwise(False).alias("is_test"),
    )


def conventions(hints: DataFrame) -> DataFrame:
    """What hints add to the fixed tables: distinct ``(what, value)``, ``what`` one of ``generated``, ``ignored`` and ``test_root``."""
    legs = [hints.select(F.lit(what).alias("what"), F.explode(c_).alias("value")) for what, c_ in (("generated", "generated_dirs"), ("ignored", "ignored_dirs"), ("test_root", "test_roots"))]
    return legs[0].unionByName(legs[1]).unionByName(legs[2]).distinct()


def packages(hints: DataFrame, workspace: str) -> DataFrame:
    """One package for each root; where several manifests share one, package.json comes first. An empty workspace is one package."""
    rank = F.when(F.col("kind") == "package_json", 0).otherwise(1)
    first = hints.withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy(rank, "path"))).where("r = 1").select(t.stable_id("package", F.lit(workspace), "root").alias("id"), "root", "name", "language")
    spark = hints.sparkSession
    fallback = spark.createDataFrame([("", workspace, "unknown")], "root string, name string, language string").join(first.where("root = ''"), "root", "left_anti")
    return first.unionByName(fallback.select(t.stable_id("package", F.lit(workspace), "root").alias("id"), "root", "name", "language"))


def first_config(spark: SparkSession, root: str, names: tuple[str, ...]) -> str | None:
    """The text of the first of the configuration files ``names`` in ``root`` that is there."""
    wanted = "^(" + "|".join(map(re.escape, names)) + ")$"
    found = {r.rel_path: r["text"] for r in files_below(spark, root, ("*/",), wanted).select("rel_path", F.decode("content", "UTF-8").alias("text")).collect()}  # at most one for each name
    return next((found[n] for n in names if n in found), None)


def module_source(modules: DataFrame, files: DataFrame) -> DataFrame:
    """``modules(canonical_path, ...)`` with the ``content`` of their files ``(path, content)``; null where there is none."""
    return modules.join(files.select(F.col("path").alias("canonical_path"), "content"), "canonical_path", "left")
