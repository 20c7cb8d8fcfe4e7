"""How many tasks a shuffle needs, by the rows of the files that it comes from.

Adaptive execution joins small partitions, but never splits those of an aggregate: with a fixed number
of shuffle partitions a task's hash table grows with the tables. And a few MB of a compact file may hold
a million rows, which one task would scan and make distinct before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Input rows for which a shuffle gets a task.
ROWS = 100_000


def tasks(df: DataFrame) -> int:
    """Tasks for the input rows of df, as its Parquet footers tell; 0 where one is enough or df comes from
    no such files."""
    spark = df.sparkSession
    files = [f for f in df.inputFiles() if f.endswith(".parquet")]
    if not files:
        return 0
    jvm = spark.sparkContext._jvm
    # input files are given as URIs
    n = -(-spark.read.parquet(*(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in files)).count() // ROWS)
    return max(n, spark.sparkContext.defaultParallelism) if n > 1 else 0


def dealt(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """df by keys in enough partitions for an aggregate by them, or by more columns; n: tasks(), if known."""
    n = tasks(df) if n is None else n
    return df.repartition(n, *keys) if n else df


def distinct(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """Distinct rows; keys: columns whose values are many, all if none is given."""
    return dealt(df, *(keys or df.columns), n=n).distinct()


#: Partitions that adaptive execution begins with, before it joins small ones.
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def ready(df: DataFrame) -> DataFrame:
    """A table that is read; joins and aggregates of its session begin with as many partitions as its rows
    call for. Adaptive execution joins them again by their bytes, and splits hot ones of joins."""
    spark, n = df.sparkSession, tasks(df)
    if n > max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(INITIAL, None) or 0)):
        spark.conf.set(INITIAL, str(n))
    return df
