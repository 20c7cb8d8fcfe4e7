"""The corpus pipeline: documents through five stages, each written and read back.

Toxic documents go; one document of each near-duplicate class stays; documents that hold benchmark
windows go; secrets are masked in the texts; what is left is encoded to token ids.

Edge cases of the stages, each on what its predecessor kept; columns of documents that a stage doesn't
know pass through all but the last:

* toxicity: a null or empty text is scored as empty; a null id is in no fold and its label is not used.
* near_dedup: null texts and null ids are in no class and stay; rows that share an id share a class,
  and stay or go together.
* decontamination: a text without words is never contaminated; a null item of the benchmark has none.
* secrets: a null text stays null; spans that overlap are masked as one.
* byte_bpe: a null text is encoded as empty; rows with equal ids are encoded row by row.

An empty table goes through all stages and gives an empty result of the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, near_dup, secrets, toxicity
from tessera.llm.common import discard, shared_dir, table, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels"), fold=toxicity.held_out())


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]

#: Trained models and near-duplicate classes have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after another."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = shared_dir(spark)
        docs = written(stage(spark, docs, sf_dir), path)
        if before:  # what the stage has read is not read again
            discard(spark, before)
        before = path
    return docs
