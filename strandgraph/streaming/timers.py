"""Keyed state with an end: edges that turn stale as their sessions end, and alarms that are told once.

Staleness needs no sweep over the table: an edge's observations are sessions
with the gap that its type allows.  A session ends by event time, so a drained
backlog turns edges stale as it would have live.  Where a later observation
tells before time does that an edge had been stale, the end of a drain adds it.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import weights
from ..schema import conform, struct

TRANSITION = struct("edgeId string, edgeType string, thresholdMs long, lastObserved timestamp, transitionedAt timestamp")


LATE = "10 minutes"


def _limit(thresholds: dict[str, int] | None, otherwise: int) -> Column:
    return weights.choose(F.col("type"), weights.STALE_AFTER_MS if thresholds is None else thresholds, otherwise).cast("long")


def _turned(last: DataFrame, limit: Column) -> DataFrame:
    """TRANSITION of edges (id, type) that were not seen again for ``limit`` after ``last``."""
    return conform(last.select(F.col("id").alias("edgeId"), F.col("type").alias("edgeType"), limit.alias("thresholdMs"), F.col("last").alias("lastObserved"), F.timestamp_millis(F.unix_millis("last") + limit + 1).alias("transitionedAt")), TRANSITION)


def stale_transitions(observations: DataFrame, late: str = LATE, thresholds: dict[str, int] | None = None, otherwise: int = weights.STALE_AFTER_MS_OTHER) -> DataFrame:
    """TRANSITION of a stream of observations (id, type, ts): one row each time an edge turns stale.

    Observations of an edge that follow each other within its type's threshold
    are one session, and the edge turns stale as the session ends, which is told
    once time is ``late`` behind that end.  Rows later than ``late`` behind the
    newest are dropped unless their session may still be open.  State is one
    small row an open session.
    """
    limit = _limit(thresholds, otherwise)
    # Times are whole milliseconds and gaps end between two: what comes just at the threshold keeps the edge fresh, a millisecond later it is too late.
    timed = observations.select("id", "type", F.timestamp_millis(F.unix_millis("ts")).alias("ts")).withWatermark("ts", late)
    gap = F.concat((limit * 1000 + 500).cast("string"), F.lit(" microseconds"))
    seen = timed.groupBy("id", "type", F.session_window("ts", gap).alias("s")).agg(F.max("ts").alias("last"))
    return _turned(seen, limit)


def told_by_later(observations: DataFrame, until: Column, late: str = LATE, thresholds: dict[str, int] | None = None, otherwise: int = weights.STALE_AFTER_MS_OTHER) -> DataFrame:
    """What ``stale_transitions`` of observations up to ``until`` does not tell yet, though a later observation of the edge does.

    These are sessions that end in the last ``late`` before ``until``: all older
    ones were told by time, so only the newest observations are looked at.
    """
    limit = _limit(thresholds, otherwise)
    open_ = F.unix_millis("last") + limit >= F.unix_millis(until - F.expr(f"interval {late}"))
    seen = observations.select("id", "type", F.timestamp_millis(F.unix_millis("ts")).alias("last")).filter(open_)
    after = F.lead("last").over(Window.partitionBy("id", "type").orderBy("last"))
    return _turned(seen.withColumn("_after", after).filter(F.unix_millis("_after") - F.unix_millis("last") > limit), limit)


def emit_once(alarms: DataFrame, expiry: str = "30 days") -> DataFrame:
    """A stream of alarms (key, ...) with each key told once; a key is forgotten ``expiry`` after it was told.

    Keys are in the state store, so a batch that is replayed, or an alarm that is
    raised again, tells nothing, and no log is read.
    """
    timed = alarms.withColumn("_told", F.current_timestamp()).withWatermark("_told", expiry)
    return timed.dropDuplicatesWithinWatermark(["key"]).drop("_told")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started within keep their state in RocksDB, outside of the heap."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def drain(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what a stream gives to Parquet, exactly once, until its source is empty."""
    with rocksdb(spark):
        run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()


def drain_stale(spark: SparkSession, observations: DataFrame, where: str, slices: int = 3, **options) -> DataFrame:
    """Transitions of observations (id, type, ts) that are landed and streamed in ``slices`` of time, one after the other.

    Once all are there, those are added that a later observation tells and time does not.
    """
    low, high = observations.agg(F.min("ts"), F.max("ts")).first()
    step = (high - low) / slices if low is not None else None
    schema: StructType = observations.select("id", "type", "ts").schema
    for i in range(slices if low is not None else 0):
        upper = F.lit(True) if i == slices - 1 else F.col("ts") < F.lit(low + step * (i + 1))
        observations.filter((F.col("ts") >= F.lit(low + step * i)) & upper).select("id", "type", "ts").write.mode("append").parquet(f"{where}/seen")
        stream = spark.readStream.schema(schema).parquet(f"{where}/seen")
        drain(spark, stale_transitions(stream, **options), f"{where}/stale", f"{where}/stale-progress")
    if low is None:
        return spark.createDataFrame([], TRANSITION)
    later = told_by_later(spark.read.schema(schema).parquet(f"{where}/seen"), F.lit(high), **options)
    return spark.read.schema(TRANSITION).parquet(f"{where}/stale").unionByName(later)


def drain_alarms(spark: SparkSession, source: str, where: str, expiry: str = "30 days") -> DataFrame:
    """Alarms of landed files, each key once."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(source)
    drain(spark, emit_once(stream, expiry), f"{where}/told", f"{where}/told-progress")
    return spark.read.schema(schema).parquet(f"{where}/told")
