"""Shared plumbing of the corpus operators: reading tables, shared work folders, Python stages."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that one Arrow batch may carry to a Python worker; texts can be long, so it is small.
TEXT_ROWS_PER_BATCH = 500

RECORDS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless they find it on PYTHONPATH anyway.

    Arrow batches of Spark's default size are made smaller, since rows hold whole texts.
    """
    if spark.conf.get(RECORDS, "10000") == "10000":
        spark.conf.set(RECORDS, str(BATCH_ROWS))
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = Path(tempfile.mkdtemp()) / "tessera.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in (root / "tessera").rglob("*.py"):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by whatever path scheme Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below the cluster's shared checkpoint folder.

    The folder is the session's spark.checkpoint.dir. Where none is set, one machine (master local)
    gets a local one; a cluster is an error, as its executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that are no longer read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(conf).delete(hp, True)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that none of the taken ones equals, whatever their case."""
    used = {t.lower() for t in taken}
    while name in used:
        name += "_"
    return name


def release() -> None:
    """Give freed memory back to the machine: workers are used again for other stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, those of fewer than ``rows`` rows joined to about so many."""
    held: list = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held = []
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator], schema: str, rows: int = TEXT_ROWS_PER_BATCH, done: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow over slices of ``rows`` rows at most; fn(batch) returns one batch or None.

    Batches of fewer rows are joined first.

    done() is called when a task ends, to empty what fn keeps in its worker.
    """
    ship(df.sparkSession)

    def over(batches):
        for b in gathered(batches, rows):
            for at in range(0, b.num_rows, rows):
                out = fn(b.slice(at, rows))
                if out is not None:
                    yield out
        if done:
            done()
        release()

    return df.mapInArrow(over, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8, null as empty, without a round trip through str."""
    col = batch.column(name)
    return [t or b"" for t in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def in_fold(n: int, remainder: int, doc_id: str = "doc_id"):
    """Column: crc32 of the id as text, modulo n, is the remainder (null ids: never)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n == remainder, F.lit(False))
