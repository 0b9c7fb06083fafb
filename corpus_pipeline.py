"""A corpus pipeline of five stages over ``documents``; each stage's rows are written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import REST, TARGETS, likeness, mixing, pieces, quality, substrings
from factloom.llm.frames import fresh_path, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays; five-word shingles of Jaccard similarity 0.8 or more link two."""
    return likeness.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier in the corpus are cut out of the texts."""
    return substrings.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are laid out in the order of the mix, which the files' names and the rows' places in them keep."""
    return mixing.in_mixed_order(docs, TARGETS, REST)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ``position`` in the mix, gapless from 0, the ``ids`` of its text (null: none), their number
    and the checksums of ids and decoded text. Columns of these names are replaced. ``docs`` must be read from files."""
    rows = mixing.with_positions(docs, text=F.coalesce("text", F.lit("")))
    made = pieces.with_ids(rows, pieces.model_file("piece_bpe_32k.model"))
    kept = [c for c in docs.columns if c not in ("position", *pieces.MADE)]
    return made.select(*(F.col("row").getField(c).alias(c) for c in kept), "position", *pieces.MADE)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("source_mix", source_mix), ("piece_ids", piece_ids)]

#: SQL has no near-duplicate groups of the kind asked for, nor the piece encoding; ``tests/llm`` holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
