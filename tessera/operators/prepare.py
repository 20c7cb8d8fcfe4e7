"""Relational preparation: nulls, roles, classes, explosions, differences, coverage reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.terms import clean, encode, is_null


def clean_nulls(df: DataFrame) -> DataFrame:
    """Every cell that spells missing as ''."""
    return df.select(*(clean(F.col(c).cast("string")).alias(c) for c in df.columns))


def null_counts(df: DataFrame) -> DataFrame:
    """column, n: missing cells by column, in one pass."""
    one = df.agg(*(F.count_if(is_null(F.col(c).cast("string"))).alias(c) for c in df.columns))
    return one.unpivot([], df.columns, "column", "n")


def multi_counts(df: DataFrame, separator: str = ",") -> DataFrame:
    """column, n: cells that hold more than one value, by column, in one pass."""
    one = df.agg(*(F.count_if(F.contains(clean(F.col(c).cast("string")), F.lit(separator))).alias(c) for c in df.columns))
    return one.unpivot([], df.columns, "column", "n")


def resolve_roles(rows: DataFrame, lookup: DataFrame, key: str, detail: str, value: str, out: str = "resolved") -> DataFrame:
    """(key, detail) in lookup, else (key, '') as fallback, else ''; an empty found value is a miss."""
    exact = lookup.select(key, detail, F.col(value).alias("_exact"))
    general = lookup.where(F.col(detail) == "").select(key, F.col(value).alias("_general"))
    joined = rows.join(exact, [key, detail], "left").join(general, key, "left")
    return joined.withColumn(out, F.coalesce(F.nullif("_exact", F.lit("")), F.col("_general"), F.lit(""))).drop("_exact", "_general")


def unresolved(rows: DataFrame, key: str, detail: str, out: str = "resolved") -> DataFrame:
    """The (key, detail) pairs without a role, with their counts."""
    return rows.where(F.col(out) == "").groupBy(key, detail).agg(F.count("*").alias("n"))


def structure_class(kind: Column, is_series: Column, is_unit: Column, series_kinds=("4", "7")) -> Column:
    """The structural class of a title."""
    return F.when(is_series, "WorkSeries").when(is_unit, "WorkUnit").when(kind.isin(*series_kinds), "WorkSeries").otherwise("CreativeWork")


def explode_list(df: DataFrame, column: str, separator: str, out: str) -> DataFrame:
    """One row for each trimmed, non-empty piece of a list cell."""
    pieces = F.filter(F.transform(F.split(column, separator), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumn(out, F.explode(pieces))


def characters(rows: DataFrame, base: str) -> DataFrame:
    """Characters of credits: a name list becomes one row for each name, with a minted IRI."""
    named = explode_list(rows.where(~is_null(F.col("role_names").cast("string"))), "role_names", ",", "character_name")
    return named.select("title_id", "talent_id", F.concat_ws("_", "title_id", "talent_id").alias("join_key"), "character_name", F.concat(F.lit(base), "title_id", F.lit("/"), encode(F.col("character_name"))).alias("character_iri"))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a given order (a file's order has no meaning here)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def missing_keys(rows: DataFrame, lookup: DataFrame, key: str, exclude: list[str] | None = None) -> DataFrame:
    """Keys that occur in rows but not in lookup, but for intended exclusions."""
    keys = rows.select(key).where(~is_null(F.col(key).cast("string"))).distinct()
    if exclude:
        keys = keys.where(~F.col(key).isin(exclude))
    return keys.join(lookup.select(key).distinct(), key, "left_anti")


def coverage_report(checks: dict[str, tuple[DataFrame, DataFrame, str, list[str]]]) -> DataFrame:
    """check, missing (count), example: one row for each named (rows, lookup, key, exclusions)."""
    out = None
    for name, (rows, lookup, key, exclude) in checks.items():
        one = missing_keys(rows, lookup, key, exclude).agg(F.lit(name).alias("check"), F.count("*").alias("missing"), F.min(key).alias("example"))
        out = one if out is None else out.unionByName(one)
    return out


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """equal: do two relations hold the same rows, counted?"""
    b = b.select(*a.columns)
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg((F.count("*") == 0).alias("equal"))


def split_graph(triples: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(triples that touch an IRI with the prefix, the others)."""
    touches = F.col("s").startswith(prefix) | ((F.col("o_kind") == "uri") & F.col("o").startswith(prefix))
    return triples.where(touches), triples.where(~touches)


def count_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """method, n: requests in an access log."""
    method = F.regexp_extract(column, r"\[\d+\]\s+(GET|POST) http", 1)
    return lines.select(method.alias("method")).where("method <> ''").groupBy("method").agg(F.count("*").alias("n"))


def kept(rows: DataFrame, column: str = "keep") -> DataFrame:
    """Rows marked yes, whatever the case and blanks."""
    return rows.where(F.lower(F.trim(F.col(column))) == "yes")


def curated(rows: DataFrame, key: str, ids: list[str], confidence: str = "high") -> DataFrame:
    """The rows of chosen ids that carry a confidence."""
    return rows.where((F.col("confidence") == confidence) & F.col(key).isin(ids))


def missing_files(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """The names that the folder does not hold, in their order, on any file system Spark reads."""
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    gone = lambda p: not p.getFileSystem(conf).exists(p)
    return [n for n in names if gone(path(f"{folder.rstrip('/')}/{n}"))]


def require_files(spark: SparkSession, folder: str, names: list[str]) -> None:
    """FileNotFoundError that names the first missing file."""
    for name in missing_files(spark, folder, names):
        raise FileNotFoundError(f"missing file: {folder}/{name}")


def optional_lookup(spark: SparkSession, path: str, key: str, value: str, prefix: str, namespace: str) -> DataFrame:
    """key, value of a CSV dictionary, short names expanded; no rows where there is no file."""
    folder, _, name = path.rpartition("/")
    if missing_files(spark, folder, [name]):
        return spark.createDataFrame([], f"`{key}` string, `{value}` string")
    full = F.when(F.col(value).startswith(prefix), F.concat(F.lit(namespace), F.substring(F.col(value), F.lit(len(prefix) + 1), F.length(value)))).otherwise(F.col(value))
    return spark.read.csv(path, header=True, quote='"', escape='"').select(F.trim(F.col(key)).alias(key), full.alias(value))


def write_metrics(spark: SparkSession, path: str, metrics: dict[str, int | str | DataFrame]) -> dict:
    """Write named figures as one JSON object; a frame gives its first row as an object of its own."""
    plain = {k: (row.asDict() if (row := v.first()) else {}) if isinstance(v, DataFrame) else v for k, v in metrics.items()}
    spark.createDataFrame([(json.dumps(plain, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return plain
