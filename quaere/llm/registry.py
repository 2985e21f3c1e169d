"""The queries of this subpackage, one for each operator, and the SQL they are held against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, fingerprints, jaccard, licenses, lines, pii, quality, suffixes, toxicity
from .common import documents, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every whole text, as digests."""
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at a Jaccard similarity of 0.8 of five-word shingles."""
    return jaccard.join(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text."""
    return quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every whole text."""
    return licenses.scan(documents(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness."""
    return fingerprints.compare_edited(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text."""
    return toxicity.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they hold."""
    return decontaminate.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without its repeated strings of 200 bytes, as digests."""
    return suffixes.digests(documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    return pii.digests(documents(spark, sf_dir))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the chunks of lines that stand elsewhere before."""
    return lines.dedup(documents(spark, sf_dir))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_jaccard": op2_jaccard,
    "op3_quality": op3_quality,
    "op4_licenses": op4_licenses,
    "op5_fingerprints": op5_fingerprints,
    "op6_toxicity": op6_toxicity,
    "op7_decontaminate": op7_decontaminate,
    "op8_suffixes": op8_suffixes,
    "op9_pii": op9_pii,
    "op10_lines": op10_lines,
}

#: The others can't be put in SQL with the same results, or SQL is too slow on whole tables: see tests/llm.
ORACLE_SQL = {
    "op4_licenses": licenses.oracle_sql(),
    "op10_lines": lines.ORACLE_SQL,
}
