"""Log sources: discovery, inference of services, line and JSON-lines parsers, and version-control output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import conventions as c
from factloom.functions import text as t


def lines(files: DataFrame) -> DataFrame:
    """``files(source_name, service, path, mtime, content)`` to non-empty lines ``(…, line_no, line)`` numbered from 1."""
    kept = F.filter(F.split("content", "\r?\n"), lambda x: F.trim(x) != "")
    return files.select(*[x for x in files.columns if x != "content"], F.posexplode(kept).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1).drop("pos")


def parse_lines(rows: DataFrame) -> DataFrame:
    """``timestamp level service message`` of plain lines; what doesn't fit is a message of unknown level at the file's time."""
    part = lambda i: F.nullif(F.regexp_extract("line", c.LOG_LINE, i), F.lit(""))
    configured = F.coalesce("service", part(3), F.col("source_name"))
    return rows.select(
        "source_name", "path", "line_no", F.coalesce(part(1), F.col("mtime")).alias("timestamp"), t.level(F.coalesce(part(2), F.lit(""))).alias("level"),
        configured.alias("service"), F.coalesce(part(4), F.trim("line")).alias("message"),
    )


def _first_string(names: tuple[str, ...]) -> Column:
    """The first of the fields that holds a JSON string."""
    value = lambda n: F.try_variant_get("v", f"$.{n}", "string")
    kind = lambda n: F.schema_of_variant(F.try_variant_get("v", f"$.{n}", "variant"))
    return F.coalesce(*(F.when(kind(n) == "STRING", value(n)) for n in names))


def parse_jsonl(rows: DataFrame) -> DataFrame:
    """JSON lines; a line that is no JSON object is dropped."""
    read = rows.withColumn("v", F.try_parse_json("line")).where("v IS NOT NULL")
    return read.select(
        "source_name", "path", "line_no", F.coalesce(_first_string(c.LOG_FIELDS["timestamp"]), F.col("mtime")).alias("timestamp"), t.level(F.coalesce(_first_string(c.LOG_FIELDS["level"]), F.lit(""))).alias("level"),
        F.coalesce(_first_string(c.LOG_FIELDS["service"]), F.col("service"), F.col("source_name")).alias("service"), F.coalesce(_first_string(c.LOG_FIELDS["message"]), F.col("line")).alias("message"),
    )


def looks_like_log(path: Column) -> Column:
    """By folder, by name or by extension."""
    folder = path.rlike("(?i)(^|/)(" + "|".join(c.LOG_FOLDERS) + ")/")
    return folder | t.basename(path).rlike(c.LOG_NAME) | F.lower(t.basename(path)).rlike(r"\.(" + "|".join(c.LOG_EXTENSIONS) + ")$")


def inferred_source(path: Column) -> Column:
    """``name, service, format`` of a log from where it lies.

    The service is the folder before the log folder, else the one after it, else the last telling folder, else the first
    part of the file's stem. The name has the last two telling folders, else the service, and the stem.
    """
    generic = ("logs", "log", "var")
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    file = F.coalesce(F.get(parts, F.size(parts) - 1), path)
    stem = F.regexp_replace(file, r"(?i)\.(jsonl|ndjson|log|txt|out)$", "")
    at = F.array_position(F.transform(dirs, lambda d: F.lower(d).isin("logs", "log")), True).cast("int")
    telling = F.filter(dirs, lambda d: ~F.lower(d).isin(*generic) & ~d.startswith("."))
    told = lambda i: F.when(~F.lower(F.get(dirs, i)).isin(*generic), F.get(dirs, i))
    service = F.coalesce(F.when(at > 1, told(at - 2)), F.when(at > 0, told(at)), F.get(telling, F.size(telling) - 1), F.get(F.split(stem, "[.-]"), F.lit(0)), F.lit("workspace"))
    context = F.array_join(F.slice(telling, F.greatest(F.size(telling) - 1, F.lit(1)), F.lit(2)), "-")
    return F.struct(
        F.concat_ws("-", F.lit("auto"), F.when(context != "", context).otherwise(service), stem).alias("name"), service.alias("service"),
        F.when(F.lower(file).rlike(r"\.(jsonl|ndjson)$"), "jsonl").otherwise("line").alias("format"),
    )


def collected(sources: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of ``sources(path, source_name, service, format)`` over ``files(path, mtime, content)``, and a warning for each source without a readable file."""
    met = sources.join(files, "path", "left")
    warnings = met.where("content IS NULL").select("source_name", "path", F.concat(F.lit("could not read log source "), "path").alias("warning"))
    rows = lines(met.where("content IS NOT NULL").select("source_name", "service", "path", "mtime", "content", "format"))
    events = parse_lines(rows.where("format = 'line'")).unionByName(parse_jsonl(rows.where("format = 'jsonl'")))
    return events.withColumn("id", t.stable_id("log", F.lit("ws"), "path", F.col("line_no").cast("string"), "timestamp", "message")), warnings


def config(content: str) -> list[dict]:
    """Log sources from JSON, or from YAML of one list of scalars: dictionaries of ``name, path, service, format``."""
    from factloom.operators.rules import parsed_entries

    return [{"name": e.get("name", e["path"]), "path": e["path"], "service": e.get("service"), "format": e.get("format", "line")} for e in parsed_entries(content, "sources") if e.get("path")]


def load_config(spark: SparkSession, root: str) -> list[dict]:
    """The sources that the first log configuration below ``root`` lists; none if there is none."""
    from factloom.sources.files import first_config

    content = first_config(spark, root, c.LOG_FILES)
    return [] if content is None else config(content)


def discover(spark: SparkSession, root: str, ignored: tuple[str, ...] = c.IGNORED) -> DataFrame:
    """Log files below ``root``, outside folders of the names ``ignored``, with what is known of them, contents included."""
    from factloom.sources.files import escaped
    from factloom.sources.listing import files_below

    wanted = f"(?i:(^|/)({'|'.join(c.LOG_FOLDERS)})/|{c.LOG_NAME.removeprefix('(?i)').replace('^', '(^|/)')}|[.]({'|'.join(c.LOG_EXTENSIONS)})$)"  # at least what looks like a log
    files = files_below(spark, root, tuple(f"{escaped(name)}/" for name in ignored), wanted)
    name = inferred_source(F.col("rel_path"))
    return files.where(looks_like_log(F.col("rel_path"))).select(
        name["name"].alias("source_name"), name["service"].alias("service"), name["format"].alias("format"), F.col("rel_path").alias("path"), F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("mtime"), F.decode("content", "UTF-8").alias("content"),
    )


def configured_sources(discovered: DataFrame, configured: DataFrame) -> DataFrame:
    """Both lists ``(path, source_name, service, format)``; of one path the configured entry holds."""
    both = discovered.withColumn("own", F.lit(0)).unionByName(configured.withColumn("own", F.lit(1)))
    return both.groupBy("path").agg(F.max_by(F.struct("source_name", "service", "format"), "own").alias("s")).select("path", "s.*")


def git_status(rows: DataFrame) -> DataFrame:
    """Porcelain lines to ``(path, status, previous_path)``."""
    code, rest = F.substring("line", 1, 2), F.substring(F.col("line"), F.lit(4), F.length("line"))
    moved = F.split(rest, " -> ")
    status = F.when(code.contains("R"), "renamed").when(code.contains("A"), "added").when(code.contains("D"), "deleted").when(code == "??", "untracked").when(code.contains("M"), "modified").otherwise("unknown")
    return rows.where(F.length("line") > 3).select(F.element_at(moved, -1).alias("path"), status.alias("status"), F.when(F.size(moved) > 1, F.element_at(moved, 1)).alias("previous_path"))


def git_log(rows: DataFrame) -> DataFrame:
    """Log output, records parted by U+001E and fields by U+001F, to commits."""
    record = F.explode(F.filter(F.split("raw", "\u001e"), lambda x: x.rlike(r"\S")))
    fields = F.transform(F.split(F.col("record"), "\u001f"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    names = ("sha", "author", "authored_at", "summary")
    return rows.select(record.alias("record")).withColumn("f", fields).select(*(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)))
