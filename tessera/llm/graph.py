"""Connected components and lookups that hot keys don't slow down, all as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, shared_dir, written

#: A key is hot if it holds at least this share of the rows; so at most 1 / HOT keys are.
HOT = 1 / 2000


def lookup(rows: DataFrame, found: DataFrame, key: str, n: str, total: int, hot: float = HOT) -> DataFrame:
    """rows joined (inner) with found on key, where key is unique in found and n counts its rows.

    Keys with a large share of all rows are collected and broadcast (at most 1 / hot of them, whatever
    the data), so no task gets all rows of a hot key; the others are shuffled.
    """
    least = max(2.0, hot * total)
    often = found.where(F.col(n) >= least).collect()
    cold = found.where(F.col(n) < least).hint("merge")
    if not often:
        return rows.join(cold, key)
    keys = [r[key] for r in often]
    few = F.broadcast(rows.sparkSession.createDataFrame(often, found.schema))
    return rows.where(F.col(key).isin(keys)).join(few, key).unionByName(rows.where(~F.col(key).isin(keys)).join(cold, key))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each end of the edges (a, b) the smallest id reachable.

    Minimum labels move along the edges, then each label is replaced by its own label, until none
    changes. Every round is written to the shared folder, which cuts the lineage. Joins with hot
    vertices are plain sort-merge joins, which adaptive execution splits.
    """
    spark = edges.sparkSession
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    path = shared_dir(spark)
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), path)
    if not labels.limit(1).count():
        return labels
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")).hint("merge"), "b")
        best = near.groupBy("a").agg(F.min("c").alias("c")).withColumnRenamed("a", "id")
        moved_path, new_path = shared_dir(spark), shared_dir(spark)
        moved = written(labels.join(best.hint("merge"), "id").select("id", F.col("component").alias("was"), F.least("component", "c").alias("component")), moved_path)
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("jump"))
        new = written(moved.join(jump.hint("merge"), "component").select("id", "was", F.least("component", "jump").alias("component")), new_path)
        changed = new.where("was <> component").limit(1).count()
        discard(spark, path, moved_path)
        labels, path = new.select("id", "component"), new_path
        if not changed:
            return labels
