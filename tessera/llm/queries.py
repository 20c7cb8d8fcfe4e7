"""The queries of the corpus operators, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from tessera.llm import decontaminate as _tests
from tessera.llm import fill_middle as _middle
from tessera.llm import url_filter as _urls
from tessera.llm import vector_dup as _vectors
from tessera.llm.common import table


def op3_secrets(spark, sf_dir):
    from tessera.llm import secrets

    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_language_model(spark, sf_dir):
    from tessera.llm import language_model

    return language_model.score(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark, sf_dir):
    from tessera.llm import decontaminate

    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark, sf_dir):
    from tessera.llm import url_filter

    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_vector_dup(spark, sf_dir):
    from tessera.llm import vector_dup

    return vector_dup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_pii(spark, sf_dir):
    from tessera.llm import pii

    return pii.find(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from tessera.llm import bpe

    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op1_near_dup(spark, sf_dir):
    from tessera.llm import near_dup

    return near_dup.classes(table(spark, sf_dir, "documents"))


def op2_token_files(spark, sf_dir):
    import public_tokenizers

    from tessera.llm import token_files

    return token_files.digest(token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op10_toxicity(spark, sf_dir):
    from pyspark.sql import functions as F

    from tessera.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    out = toxicity.held_out()
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold=out)
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_fill_middle(spark, sf_dir):
    from tessera.llm import fill_middle

    return fill_middle.digest(table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark, sf_dir):
    from tessera.llm import suffix_dedup

    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark, sf_dir):
    from tessera.llm import periodic_runs

    return periodic_runs.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_near_dup": op1_near_dup,
    "op2_token_files": op2_token_files,
    "op3_secrets": op3_secrets,
    "op4_language_model": op4_language_model,
    "op5_decontaminate": op5_decontaminate,
    "op6_url_filter": op6_url_filter,
    "op7_vector_dup": op7_vector_dup,
    "op8_pii": op8_pii,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_fill_middle": op11_fill_middle,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {"op5_decontaminate": _tests.ORACLE, "op6_url_filter": _urls.ORACLE, "op7_vector_dup": _vectors.ORACLE, "op11_fill_middle": _middle.ORACLE}
