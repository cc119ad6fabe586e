"""A corpus pipeline over the training-data operators.

``run`` applies STAGES to ``documents``. What a stage keeps is written as Parquet into the folder
that the session names for checkpoints and read again by the next one, so a lost executor
costs no earlier stage; what a stage has read is deleted once it is done. SQL can't express the stages; tests hold them against plain versions.

Defined cases, for every stage: null and empty texts are scored as empty and go with the language stage, which finds no
letter in them; null ids are carried; repeated rows are near duplicates of each other; an empty table gives an empty
one of the same columns (``run``: no pieces); further columns are kept by all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import common, language, near_dedup, packing, quality, secrets


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents below the quality threshold."""
    return quality.quality_stage(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is recognised."""
    return language.language_stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return near_dedup.near_dedup_stage(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes secrets out of the texts."""
    return secrets.secret_stage(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of what all stages keep. The last stage's input stays in the checkpoint folder for as long as the result may be read."""
    docs = common.documents(spark, sf_dir)
    folder, before = f"{common.checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            common.delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
