"""One logical query under several physical strategies over named datasets, measured and compared.

Nothing but aggregates reaches the driver: rows are counted and hashed where they are made, and Spark's
own stage metrics tell what a strategy read and shuffled.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Keys up to which a bind join sends its keys as literals; beyond it they are a semi-join.
BIND_KEYS = 100


@dataclass
class Measure:
    strategy: str
    seconds: float = 0.0
    rows: int = 0
    jobs: int = 0
    input_bytes: int = 0
    input_rows: int = 0
    shuffle_bytes: int = 0
    equal: bool | None = None
    error: str = ""
    digest: str = ""


def bind_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """right reduced to left's keys before the join: literals if few, a semi-join if many."""
    keys = left.select(key).distinct()
    few = [r[0] for r in keys.limit(BIND_KEYS + 1).collect()]
    reduced = right.where(F.col(key).isin(few)) if len(few) <= BIND_KEYS else right.join(keys, key, "left_semi")
    return left.join(reduced, key)


def full_scan_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both sides read whole and shuffled, then joined: what a client without pushdown does."""
    return left.join(right.hint("merge"), key)


def strategies(left: DataFrame, right: DataFrame, key: str, single: Callable[[], DataFrame], nested: Callable[[], DataFrame] | None = None, blind: Callable[[], DataFrame] | None = None) -> dict[str, Callable[[], DataFrame]]:
    """The named strategies of one question.

    single: all data in one place, the oracle; naive: both answers whole, then a join; optimised: the
    right side asked for the left's keys alone; nested: one query with the other inside; blind: one
    dataset asked with a part that another would have to answer.
    """
    out = {"single": single, "naive": lambda: full_scan_join(left, right, key), "optimised": lambda: bind_join(left, right, key)}
    return out | ({"nested": nested} if nested else {}) | ({"blind": blind} if blind else {})


def _metrics(spark: SparkSession, group: str) -> dict[str, int]:
    """Jobs of a job group, and what those of their stages read and shuffled that Spark still tells of."""
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    jobs = list(tracker.getJobIdsForGroup(group))
    stages = {s for j in jobs if (info := tracker.getJobInfo(j)) for s in info.stageIds}
    out = {"jobs": len(jobs), "input_bytes": 0, "input_rows": 0, "shuffle_bytes": 0}
    for s in stages:
        try:
            data = store.lastStageAttempt(s)
        except Py4JJavaError:  # never run, as its output was there already, or no longer kept in a long session
            continue
        out["input_bytes"] += data.inputBytes()
        out["input_rows"] += data.inputRecords()
        out["shuffle_bytes"] += data.shuffleWriteBytes()
    return out


def measure(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> Measure:
    """Run a strategy to its end. Its digest is the count and the sum of the hashes of its rows, columns by name."""
    m, began, group = Measure(name), time.time(), f"strategy-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        df = make()
        seen = Observation()
        hashed = F.xxhash64(*sorted(df.columns))
        # two sums of unlike hashes: no order, and repeated rows count
        sums = [F.sum(h.cast("decimal(38,0)")) for h in (hashed, F.xxhash64(F.lit(7), *sorted(df.columns)))]
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *(x.alias(f"sum{k}") for k, x in enumerate(sums))).write.format("noop").mode("overwrite").save()
        got = seen.get
        m.rows, m.digest = got["rows"], f"{got['sum0']}/{got['sum1']}"
    except Exception as e:  # a failing strategy is reported, the others still run
        m.error = str(e).splitlines()[0][:200]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    m.seconds = time.time() - began
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for k, v in _metrics(spark, group).items():
        setattr(m, k, v)
    return m


def run(strategies: dict[str, Callable[[], DataFrame]], oracle: str, spark: SparkSession | None = None) -> list[Measure]:
    """Each strategy's time, rows, jobs and bytes, and whether its rows are the oracle's."""
    spark = spark or SparkSession.getActiveSession()
    out = [measure(spark, name, make) for name, make in strategies.items()]
    truth = next(m for m in out if m.strategy == oracle)
    for m in out:
        m.equal = None if m.error or truth.error else (m.rows, m.digest) == (truth.rows, truth.digest)
    return out


def table(spark: SparkSession, measures: list[Measure]) -> DataFrame:
    """The measurements as a relation, a row for each strategy."""
    return spark.createDataFrame([tuple(asdict(m).values()) for m in measures], "strategy string, seconds double, rows long, jobs int, input_bytes long, input_rows long, shuffle_bytes long, equal boolean, error string, digest string")


def report(measures: list[Measure], path: str | None = None) -> str:
    """A table of measurements; as JSON to path, if given."""
    if path:
        with open(path, "w") as f:
            json.dump([asdict(m) for m in measures], f, default=str)
    head = f"{'strategy':24} {'seconds':>9} {'rows':>10} {'jobs':>5} {'read':>12} {'shuffled':>12} equal"
    return "\n".join([head, *(f"{m.strategy:24} {m.seconds:9.3f} {m.rows:10} {m.jobs:5} {m.input_bytes:12} {m.shuffle_bytes:12} {m.error or m.equal}" for m in measures)])
