"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Quality rules drop documents, line dedup cuts boilerplate lines from texts, near-duplicate search
keeps one document of each group, decontamination drops documents that overlap the benchmark, and
mixing takes copies of what is left so that sources meet their target weights. All stages but the
last return the columns of documents; the last returns them with `size` (words) and `copies`
(how often the mix takes the document, at least once).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import _tools as tools
from foliant.llm import decontamination, line_templates, mixing, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_templates.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
]

#: SimHash links and pivotal rounding are not to be said in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = tools.stage(step(spark, docs, sf_dir))
    return docs
