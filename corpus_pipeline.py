"""A training corpus from raw documents: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import decontaminate, jaccard_join, pii, quality, source_mix
from loomlog.llm.tables import cut

#: The stages are iterative or learned, which SQL can't express; tests hold each against brute force.
ORACLE_SQL = None


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranker puts above its cut. Null and empty texts are scored like others, repeated rows alike; without
    usable labels all stay."""
    ranker = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, ranker)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least id (null last); of equal rows one. Documents without words link with
    nothing, and stay."""
    return jaccard_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. Null and empty texts hold none; items of any length and without id count."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by the name of its kind. Null texts stay null; a column n_chars, if there is one, is
    counted again; other columns are as they were."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: of null and empty texts none. A null source is a source of its own, rows equal
    in all are documents of their own."""
    return source_mix.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("quality", reject_poor), ("near_copies", drop_near_copies), ("leaks", drop_leaks), ("personal_data", mask_personal_data), ("mix", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
