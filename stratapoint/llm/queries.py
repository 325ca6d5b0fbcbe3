"""Queries p6_ to p8_ over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratapoint.llm import leaks, sentences, tokens
from stratapoint.session import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_altered(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a window of an item of which at most two places are altered."""
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"), substitutions=2)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_ends(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p6_ids, p7_found, p7_altered, p8_found)}
ORACLES: dict[str, str] = {}
