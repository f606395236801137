"""From raw documents to encoded ones, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read again as the next
one's documents. All but the last return the columns of ``documents``, with ``n_chars`` kept true to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, line_dedup, near_dedup, quality_rules, sentencepiece_wfst
from tessera.llm.common import cut, discard, read
from tessera.llm.queries import tokenizer_path

#: Near-duplicates of the pipeline share 0.8 of their word shingles (op7_near_dedup has a contract of its own: 0.85).
NEAR_PERCENT = 80


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents go, but for one holder's."""
    return _recounted(line_dedup.dedup_lines(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.keep_one(docs, rule=near_dedup.Rule(percent=NEAR_PERCENT)).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    return _recounted(decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark")), docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, digested, and whether they decode to its text."""
    return sentencepiece_wfst.round_trips(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near_duplicates), ("decontamination", benchmark), ("sentencepiece", encoding)]

#: Near-duplicates by hashing and SentencePiece are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
