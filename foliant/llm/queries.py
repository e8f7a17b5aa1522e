"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import oracles


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from foliant.llm.token_counts import token_counts

    counted = token_counts(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import simhash

    linked = simhash.fingerprint_components(_docs(spark, sf_dir))
    return linked.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import ctw

    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return ctw.score(_docs(spark, sf_dir), held_out=held_out)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import decontamination

    return decontamination.overlaps(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import suffix_dedup

    return suffix_dedup.digests(_docs(spark, sf_dir))


def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import reply_trees as trees

    said = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"SELECT -1L conv_id, 0L turn, 'user' role, '{said}' text UNION ALL SELECT -1L, 1L, 'assistant', '{said}'")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(planted)
    formatted = trees.format_trees(trees.threads(turns))
    kind = formatted.schema["tree"].dataType.simpleString()
    return formatted.mapInArrow(_chat_digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _chat_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of what is read back from formatted conversations."""
    from foliant.llm.reply_trees import read_back, unescape

    for batch in batches:
        rows = []
        for formatted, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
            turns = read_back(formatted)
            loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
            rows.append((len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), _sha(loss), len(formatted)))
        n, turned, chars, lost, total = zip(*rows) if rows else [()] * 5
        arrays = [batch.column("tree"), pa.array(n, pa.int64()), pa.array(turned, pa.string()), pa.array(chars, pa.int64()), pa.array(lost, pa.string()), pa.array(total, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import langid

    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return langid.identify(_docs(spark, sf_dir), held_out=held_out)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import mixing

    mixed = mixing.mix(_docs(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import quality

    return quality.score(_docs(spark, sf_dir)).select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import line_templates

    told = line_templates.report(_docs(spark, sf_dir))
    return told.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import elkan

    return elkan.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=10, seed="3").drop("computed")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import digest_runs

    return digest_runs.exact_dedup(_docs(spark, sf_dir), keep="largest")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm import ranked_search

    return ranked_search.search(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("shards")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_simhash, op3_context_tree, op4_decontamination, op5_suffix_dedup, op6_reply_trees, op7_language_id, op8_mixing, op9_quality_rules, op10_line_templates, op11_centroids, op12_exact_dedup, op13_ranked_search, pipeline)}

ORACLE_SQL: dict[str, str] = dict(oracles.ORACLE_SQL)
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
