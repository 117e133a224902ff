"""A corpus pipeline over ``documents``: each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe_tree, decontaminate, line_dedup, near_dedup, toxicity
from gridloom.llm.sparkkit import Table, free_name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon does not reject."""
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, predicted = (free_name(x, docs.columns) for x in ("score", "predicted"))
    return toxicity.score_documents(docs, lexicon, docs.columns, out=(score, predicted)).where(f"{predicted} = 0").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that a smaller document holds; every document stays, n_chars follows its text."""
    lines, dropped, kept = (free_name(x, docs.columns) for x in ("n_lines", "n_dropped", "kept_text"))
    out, changed = line_dedup.dedup_lines(docs, out=(lines, dropped, kept)), F.col(dropped) > 0
    return out.withColumn("text", F.when(changed, F.col(kept)).otherwise(F.col("text"))).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8.

    Decisions are applied by doc_id: where rows share an id and one of them goes,
    all of them go; identical rows with one id all stay.
    """
    gone = near_dedup.near_duplicates(docs, words=5, share=80).where("component_id IS NOT NULL AND NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of ids and of the decoded bytes."""
    return bpe_tree.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Toxicity and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        now = Table(spark, stage(spark, docs, sf_dir), name)
        if before is not None:
            before.drop()
        docs, before = now.df, now
    return docs
