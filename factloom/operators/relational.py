"""Filters, lookups, joins and table maintenance over the entity tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as t
from factloom.operators import fulltext
from factloom.functions.conventions import IMPORT_EXTENSIONS


def in_order(rows: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows whose ``key`` is listed, in the order of the list; unknown ids are left out."""
    wanted = rows.sparkSession.createDataFrame(list(enumerate(ids)), f"pos int, {key} {rows.schema[key].dataType.simpleString()}")
    return rows.join(F.broadcast(wanted), key).orderBy("pos")


def named(rows: DataFrame, name: str, query: str) -> DataFrame:
    """Rows whose ``name`` is or contains the query, without regard to case; wildcards in the query stand for themselves."""
    return rows.where((F.col(name) == query) | F.contains(F.lower(name), F.lit(query.lower())))


def symbols_named(symbols: DataFrame, query: str, names: fulltext.Index | None = None) -> DataFrame:
    """:func:`named` over ``symbols(id, name, exported, ...)``, exported ones first. ``names``: an index of trigrams of the
    names by id; only the symbols it points to are looked at."""
    if names is not None:
        symbols = symbols.join(fulltext.containing(names, query).withColumnRenamed("key", "id"), "id", "left_semi")
    return named(symbols, "name", query).orderBy(F.desc("exported"), "name")


def one_module(modules: DataFrame, path: str, paths: fulltext.Index | None = None) -> DataFrame:
    """The module at a path: the exact one, else the first that contains it, without regard to case. ``paths``: an index of
    trigrams of the paths by id; only the modules it points to are looked at."""
    if paths is not None:
        modules = modules.join(fulltext.containing(paths, path).withColumnRenamed("key", "id"), "id", "left_semi")
    hit = modules.where((F.col("canonical_path") == path) | F.contains(F.lower("canonical_path"), F.lit(path.lower())))
    return hit.orderBy(F.when(F.col("canonical_path") == path, 0).otherwise(1), "canonical_path").limit(1)


def globbed(rows: DataFrame, column: str, globs: list[str]) -> DataFrame:
    """Rows that a glob matches; none if there is no glob."""
    return rows.where(F.col(column).rlike("|".join(map(t.glob_regex, globs)))) if globs else rows.limit(0)


def degrees(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, outbound, inbound``: import edges that leave and reach each module, 0 where none does."""
    imports = edges.where("type = 'imports'")
    out = imports.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("outbound"))
    into = imports.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("inbound"))
    return modules.select("id").join(out, "id", "left").join(into, "id", "left").na.fill(0, ["outbound", "inbound"])


def test_candidates(changed: DataFrame, edges: DataFrame, cases: DataFrame) -> DataFrame:
    """Test cases that reach a changed module: ``id, title, suite_path, modules, score``, the score being the number of edges."""
    hit = edges.join(changed.select(F.col("id").alias("target_id"), "canonical_path"), "target_id")
    per = hit.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_set("canonical_path")).alias("modules"), F.count("*").alias("score"))
    return per.join(cases, "id").select("id", "title", "suite_path", "modules", "score")


def coverage(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, tests``: distinct test cases of each changed module, 0 where there is a gap."""
    per = edges.groupBy(F.col("target_id").alias("id")).agg(F.count_distinct("source_id").alias("tests"))
    return changed.select("id").join(per, "id", "left").na.fill(0, ["tests"])


def longest_prefix(rows: DataFrame, path: str, roots: DataFrame) -> DataFrame:
    """``rows`` with ``root``: the longest of ``roots(root)`` that is the path or one of its folders; null if none.

    Every folder of a path is looked up by equality, so neither side is broadcast by need.
    """
    keyed = rows.select(F.col(path).alias("lp_path")).distinct().select("lp_path", F.explode(parts_of("lp_path")).alias("root"))
    best = keyed.join(roots.select("root").distinct(), "root").groupBy("lp_path").agg(F.max_by("root", F.length("root")).alias("root"))
    return rows.join(best, rows[path] == best["lp_path"], "left").drop("lp_path")


def parts_of(column: str) -> F.Column:
    """A path's folders and itself, the shortest first."""
    parts = F.split(F.col(column), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def resolve(references: DataFrame, catalog: DataFrame) -> DataFrame:
    """``references(ref_id, reference, from_path, language)`` to the best entry of ``catalog(path, language)``.

    Every path suffix of an entry is a key, and of a folder the one that an ``init`` file in it stands for. Score: 30 for the
    language, 20 for the whole reference, 10 for the base name, as much again for an init file's folder, 4 for each shared
    folder less the distance, 5 for the same extension; ties go to the first path.
    """
    full = t.reference_key(F.col("path"))
    init = F.lower(F.regexp_extract(t.basename(F.col("path")), r"^(.*?)(?:\.[^.]*)?$", 1)) == "init"
    folder = F.when(init, t.reference_key(F.concat(t.dirname(F.col("path")), F.lit("/"))))
    keys = catalog.select("path", F.col("language").alias("c_language"), full.alias("full"), folder.alias("folder"))
    keys = keys.select("*", F.explode(F.array_distinct(F.concat(t.suffixes(F.col("full")), F.coalesce(t.suffixes(F.col("folder")), F.array())))).alias("key")).where("key <> ''")
    hit = references.withColumn("key", t.reference_key(F.col("reference"))).join(keys, "key")
    segments = lambda c: F.filter(F.split(F.lower(t.dirname(F.col(c))), "/"), lambda x: x != "")
    own, other = segments("from_path"), segments("path")
    shared = t.common_prefix(own, other)
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    yes = lambda condition, points: F.when(F.coalesce(condition, F.lit(False)), points).otherwise(0)
    score = (
        yes(F.col("language") == F.col("c_language"), 30) + yes(F.col("full") == F.col("key"), 20) + yes(last("full") == last("key"), 10) + yes(F.col("folder") == F.col("key"), 20) + yes(last("folder") == last("key"), 10)
        + 4 * shared - (F.size(own) + F.size(other) - 2 * shared) + yes(t.extension(F.col("path")) == t.extension(F.col("from_path")), 5)
    )
    best = F.struct((-score).alias("s"), F.col("path").alias("path"))
    per = hit.groupBy("ref_id", "reference").agg(F.min(best).alias("b"))
    return per.select("ref_id", "reference", "b.path", (-F.col("b.s")).cast("bigint").alias("score"))


def import_candidates(imports: DataFrame, files: DataFrame, extensions: tuple[str, ...] = IMPORT_EXTENSIONS) -> DataFrame:
    """``imports(import_id, from_path, spec)`` to the first existing file among the shapes that a relative import may mean.

    In order: the path and the path without its extension, then both with each extension, then an index file in both. Files
    are looked up by what an import may say for them, at most three keys a file, not by every shape of every import.
    """
    base = t.normal_path(F.concat_ws("/", F.nullif(t.dirname(F.col("from_path")), F.lit("")), "spec"))
    bases = imports.where(F.col("spec").startswith(".")).select("import_id", base.alias("base")).withColumn("bare", F.regexp_replace("base", r"(?i)\.(jsx?|tsx?)$", ""))
    tried = bases.select("import_id", F.posexplode(F.array_distinct(F.array("base", "bare"))).alias("b", "key"))
    n = len(extensions)
    stem = F.regexp_extract("path", rf"(?s)^(.*)\.({'|'.join(map(re.escape, extensions))})\z", 1)
    known = files.select("path").withColumn("e", F.array_position(F.array(*map(F.lit, extensions)), F.regexp_extract("path", r"\.([^.]*)\z", 1)) - 1).withColumn("stem", F.when(F.col("e") >= 0, stem))

    def shape(key: Column, first: int, b: int, e: Column) -> Column:
        """What a file is to a base, and its place in the order: ``first``, ``b`` more for the second base, ``e`` for the extension."""
        return F.struct(key.alias("key"), F.lit(first).alias("first"), F.lit(b).alias("more"), e.cast("int").alias("e"))

    index = F.when(F.col("stem").endswith("/index"), F.expr("left(stem, length(stem) - 6)"))
    shapes = F.array(shape(F.col("path"), 0, 1, F.lit(0)), shape(F.col("stem"), 2, n, F.col("e")), shape(index, 2 + 2 * n, n, F.col("e")))
    keys = known.select("path", F.inline(shapes)).where("key IS NOT NULL")
    place = F.col("first") + F.col("b") * F.col("more") + F.col("e")
    return tried.join(keys, "key").groupBy("import_id").agg(F.min_by("path", place).alias("path"))


# table maintenance


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """``new`` over ``old`` by key; columns in ``keep`` stay as they were where the row existed."""
    n = new.select(*key, F.struct(*new.columns).alias("n"))
    o = old.select(*key, F.struct(*old.columns).alias("o"))
    both = o.join(n, key, "full")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*(F.col(c) if c in key else pick(c).alias(c) for c in old.columns))


def last_wins(rows: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """One row for each key: the last one."""
    cols = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(seq, *[c for c in cols if c != seq])).alias("r")).select(*(c if c in key else F.col(f"r.{c}").alias(c) for c in rows.columns))


def replace_scope(old: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """``old`` without the scopes that ``new`` has rows of, and ``new``."""
    return old.join(new.select(scope).distinct(), scope, "left_anti").select(*old.columns).unionByName(new)


def stale(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return known.join(found, key, "left_anti")


def changed_in(group_id: str, changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges from changed modules (confidence 1) and their symbols (0.9) to the group."""
    edge = lambda df, kind, sure: df.select(t.stable_id("edge", F.lit("changed_in"), "id", F.lit(group_id)).alias("id"), F.col("id").alias("source_id"), F.lit(kind).alias("source_type"), F.lit(group_id).alias("target_id"), F.lit("changed_in").alias("type"), F.lit(sure).alias("confidence"))
    own = symbols.join(changed.select(F.col("id").alias("module_id")), "module_id", "left_semi")
    return edge(changed, "module", 1.0).unionByName(edge(own, "symbol", 0.9))


def change_modules(edges: DataFrame, modules: DataFrame, group_id: str) -> DataFrame:
    """The modules that ``changed_in`` edges of a change group start from, by path."""
    own = edges.where((F.col("type") == "changed_in") & (F.col("target_id") == group_id)).select(F.col("source_id").alias("id")).distinct()
    return modules.join(own, "id", "left_semi").orderBy("canonical_path")


def replace_change_group(old: DataFrame, new: DataFrame, group_id: str) -> DataFrame:
    """All edges with those of one change group replaced by ``new``."""
    return old.where(~((F.col("type") == "changed_in") & (F.col("target_id") == group_id))).unionByName(new.select(*old.columns))


def delete_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows that ``paths(path)`` own. An edge goes with its owner's file, never with its target's.

    ``suites(id, file_path)`` go with their files, ``cases(id, suite_id)`` with their suites, ``results(case_id)`` with their cases.
    """
    owner = {"files": "path", "modules": "canonical_path", "symbols": "file_path", "edges": "owner_file_path", "file_hashes": "path", "suites": "file_path"}
    left = {name: df.join(paths.select(F.col("path").alias(owner[name])), owner[name], "left_anti").select(*df.columns) if name in owner else df for name, df in tables.items()}
    for child, key, parent in (("cases", "suite_id", "suites"), ("results", "case_id", "cases")):
        if child in tables and parent in tables:
            gone = tables[parent].select(F.col("id").alias(key)).join(left[parent].select(F.col("id").alias(key)), key, "left_anti")
            left[child] = tables[child].join(gone, key, "left_anti").select(*tables[child].columns)
    return left


def unchanged(candidates: DataFrame, hashes: DataFrame) -> DataFrame:
    """Candidates to be read again: those whose hash or whose reader's version is not the stored one."""
    return candidates.join(hashes, ["workspace_id", "path", "content_hash", "extractor_version", "parser_version"], "left_anti")


def symbol_records(rows: DataFrame) -> DataFrame:
    """Stored symbols ``(id, name, exported, start_line, start_column, end_line, end_column, metadata_json)`` as records: the
    flag as a boolean, the range nested, the metadata a map, and empty texts as null."""
    place = lambda side: F.struct(F.col(f"{side}_line").alias("line"), F.col(f"{side}_column").alias("column"))
    return rows.select(
        "id", F.nullif("name", F.lit("")).alias("name"), (F.col("exported") == 1).alias("exported"), F.struct(place("start").alias("start"), place("end").alias("end")).alias("range"),
        F.coalesce(F.from_json("metadata_json", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def job_log(log: DataFrame, updates: DataFrame) -> DataFrame:
    """The append-only log ``(id, workspace_id, status, updated_at)`` with ``updates``; see :func:`latest` for its state. A job that is done takes no further update."""
    done = log.where("status IN ('completed', 'failed')").select("id").distinct()
    return log.unionByName(updates.join(done, "id", "left_anti").select(*log.columns))


def latest(rows: DataFrame, by: str, when: str) -> DataFrame:
    """The latest row of each ``by``."""
    cols = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.max_by(F.struct(*cols), F.struct(when, *[c for c in cols if c != when])).alias("r")).select(by, *(F.col(f"r.{c}").alias(c) for c in cols))


def import_pairs(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Import edges with both modules' paths; an edge to an unknown module is left out."""
    side = lambda c: modules.select(F.col("id").alias(f"{c}_id"), F.col("canonical_path").alias(f"{c}_path"))
    return edges.join(side("source"), "source_id").join(side("target"), "target_id").select("source_id", "target_id", "source_path", "target_path")


def merged_edges(edges: DataFrame, key: list[str]) -> DataFrame:
    """One edge for each key: the highest confidence, the first metadata there is (by ``pos``)."""
    return edges.groupBy(*key).agg(F.max("confidence").alias("confidence"), F.min_by("metadata", F.when(F.col("metadata").isNotNull(), F.col("pos"))).alias("metadata"))


def merged_symbols(symbols: DataFrame, key: list[str]) -> DataFrame:
    """One symbol for each key: exported if any is, the first container there is (by ``pos``)."""
    return symbols.groupBy(*key).agg(F.bool_or("exported").alias("exported"), F.min_by("container", F.when(F.col("container").isNotNull(), F.col("pos"))).alias("container"))


def argmax(votes: DataFrame, by: str) -> DataFrame:
    """Votes ``(by, value, confidence, pos)`` summed by value; the highest sum above zero wins, the first seen of equals."""
    sums = votes.groupBy(by, "value").agg(F.sum("confidence").alias("score"), F.min("pos").alias("pos"))
    return sums.where("score > 0").groupBy(by).agg(F.max_by(F.struct("value", "score"), F.struct("score", -F.col("pos"))).alias("b")).select(by, "b.value", "b.score")


def references(rows: DataFrame, path: str, limit: int = 10) -> DataFrame:
    """Evidence labels of modules: the base name, and at most ``limit`` of a package's, in order. Each task keeps the first ones of a package only."""
    labels = rows.select("package_id", t.basename(F.col(path)).alias("label")).distinct()
    first = F.row_number().over(Window.partitionBy("package_id").orderBy("label"))  # a top-k per package: ranked in each task before the shuffle
    return labels.withColumn("r", first).where(F.col("r") <= limit).groupBy("package_id").agg(F.array_sort(F.collect_list("label")).alias("labels"))


def required(requires: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """``requires(id, from_path, module)``, dots as folders, to ``base.lua`` or ``base/init.lua`` beside the file, then below the root."""
    bare = F.regexp_replace("module", r"\.", "/")
    near = t.normal_path(F.concat_ws("/", F.nullif(t.dirname(F.col("from_path")), F.lit("")), bare))
    far = t.normal_path(F.concat_ws("/", F.nullif(F.lit(root), F.lit("")), bare))
    shapes = [F.concat(b, F.lit(e)) for b in ("near", "far") for e in (".lua", "/init.lua")]
    tried = requires.select("id", near.alias("near"), far.alias("far")).select("id", F.posexplode(F.array(*shapes)).alias("pos", "path"))
    return tried.join(files.select("path"), "path").groupBy("id").agg(F.min_by("path", "pos").alias("path"))
