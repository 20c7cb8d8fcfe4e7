"""What the findings of round 4 found: pairs of people take no disk before they are written."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import federation
from tessera.queries import QUERIES


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """2000 people of 16 names that share a token: a million pairs."""
    folder = str(tmp_path_factory.mktemp("crowded"))
    name = F.concat(F.lit("bolt n"), (F.floor(F.col("id") / 2) % 16).cast("string")).alias("p_name")
    spark.range(2000).select(F.col("id").alias("p_partkey"), name, (F.col("id") % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{folder}/part.parquet")
    return folder


def shuffled(spark, query, folder):
    found = federation.measure(spark, query, lambda: QUERIES[query](spark, folder))
    return found.rows, found.shuffle_bytes


def test_blocking_shuffles_runs_of_people(spark, crowded):
    """each person was shuffled for each name that theirs meets."""
    rows, size = shuffled(spark, "q36_er_blocking", crowded)
    assert rows == 1_000_000 and size < 30_000


def test_confidence_shuffles_runs_of_people(spark, crowded):
    """so it was with dates, and names of classes were judged from what the checkpoint folder held."""
    rows, size = shuffled(spark, "q37_er_confidence", crowded)
    assert rows == 1_000_000 and size < 100_000
