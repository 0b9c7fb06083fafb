"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import fingerprints, languages, mixing, periods, pieces, preferences, quality, sharding, simhash, substrings, tokens, tries, urls
from factloom.llm.frames import fresh_path, table

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_neighbours(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


#: Target weights of the mix; sources that are not listed share the last.
TARGETS, REST = {f"src{i}": {0: 4.0, 1: 0.5, 2: 2.0}.get(i, 1.0) for i in range(20)}, 1.0


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents"), TARGETS, REST, keep=["doc_id", "source"])
    return rows.select("row.doc_id", "row.source", rows["source"].alias("target"), "slot", "release", "deadline", "block", "start")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    rows = quality.judged(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("doc_id", *quality.COUNTS, "base_failed", "kept", F.round("js_chars", 6).alias("js_chars"), F.round("js_words", 6).alias("js_words"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    tokens.write_ids(table(spark, sf_dir, "documents"), path, tokens.tokenizer_file(BYTE_BPE))
    return tokens.read_sums(spark, path)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal(table(spark, sf_dir, "documents"))


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.from_conversations(table(spark, sf_dir, "conversations"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"), pieces.model_file(PIECE_BPE))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(table(spark, sf_dir, "documents"))


def op12_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.from_conversations(table(spark, sf_dir, "conversations"))


def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.predicted(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_fingerprints, op2_simhash, op3_mixing, op4_quality, op5_token_ids, op6_substrings, op7_preferences, op8_sharding, op9_urls, op10_pieces, op11_periods, op12_tries, op13_languages, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; the others are tested against brute force in ``tests/llm``."""
    return {"op4_quality": quality.ORACLE, "op6_substrings": substrings.ORACLE, "op7_preferences": preferences.ORACLE, "op9_urls": urls.ORACLE, "op12_tries": tries.ORACLE}


def model_names() -> tuple[str, str]:
    """Names of the two vocabulary files that the queries use."""
    return BYTE_BPE, PIECE_BPE
