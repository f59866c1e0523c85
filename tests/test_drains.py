"""Drains that outlast a window, edges at their threshold, and partitions that are written by several tasks."""

import time
from datetime import UTC, datetime

from pyspark.sql import functions as F

from strandgraph.schema import EDGES, SPANS, table
from strandgraph.streaming import live, pipelines, timers


def test_a_drain_may_outlast_its_window(spark, tmp_path):
    """A child, its parent and the child again, each in a micro-batch that takes longer than spans wait."""
    for i, parent in ((2, "1"), (1, None), (2, "1")):
        table(spark, SPANS, [{"service": f"s{i}", "env": "unknown", "traceId": "t", "spanId": str(i), "parentSpanId": parent, "kind": 2, "attributes": {}}]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []

    def slowly(rows, batch):
        got.extend("pair" if r["pair"] else "span" for r in rows.collect())
        time.sleep(3)

    stream = spark.readStream.schema(SPANS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = pipelines.with_callers(stream, window="1 second", dedupe=True, at=datetime.now(UTC))
    with timers.rocksdb(spark):
        told.writeStream.foreachBatch(slowly).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == ["pair", "span", "span"]


def test_stale_at_the_threshold(spark, tmp_path):
    """As old as the threshold is still fresh, a millisecond more is not, wherever the slices end; no Python runs for each edge."""
    limit = 3_600_000
    seen = [("a", 0), ("a", limit), ("b", 0), ("b", limit + 1), ("c", 0), ("c", 0), ("d", 3 * limit), ("z", 9 * limit)]
    rows = spark.createDataFrame(seen, "id string, ms long").select("id", F.lit("CALLS").alias("type"), F.timestamp_micros((1_700_000_000_000 + F.col("ms")) * 1000 + F.length("id") * 7).alias("ts"))
    for slices in (1, 3):
        got = timers.drain_stale(spark, rows, str(tmp_path / str(slices)), slices=slices)
        ms = sorted((r["edgeId"], r["last"] - 1_700_000_000_000, r["thresholdMs"], r["n"]) for r in got.select("edgeId", "thresholdMs", F.unix_millis("lastObserved").alias("last"), (F.unix_millis("transitionedAt") - F.unix_millis("lastObserved")).alias("n")).collect())
        assert ms == [(e, at, limit, limit + 1) for e, at in (("a", limit), ("b", 0), ("b", limit + 1), ("c", 0), ("d", 3 * limit))]
    rows.write.parquet(str(tmp_path / "seen"))
    plan = timers.stale_transitions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "seen")))._jdf.queryExecution().toString()
    assert "SessionWindow" in plan or "session_window" in plan.lower()
    assert "Pandas" not in plan


def test_a_later_observation_tells_before_time_does(spark, tmp_path):
    """Edges seen again in the last ten minutes, by when time has not told yet that they had been stale."""
    limit = 3_600_000
    end = limit + 300_000
    early = end - 600_000 - limit
    seen = [("again", 0), ("again", end), ("just", end - limit), ("just", end), ("never", 0), ("often", 0), ("often", 0), ("often", limit - 5), ("often", end - 1), ("time", early - 1), ("time", end), ("both", early), ("both", end), ("both", end)]
    rows = spark.createDataFrame(seen, "id string, ms long").select("id", F.lit("CALLS").alias("type"), F.timestamp_millis(1_700_000_000_000 + F.col("ms")).alias("ts"))
    for slices in (1, 3):
        got = timers.drain_stale(spark, rows, str(tmp_path / str(slices)), slices=slices)
        told = sorted((r["edgeId"], r["last"] - 1_700_000_000_000, r["n"]) for r in got.select("edgeId", F.unix_millis("lastObserved").alias("last"), (F.unix_millis("transitionedAt") - F.unix_millis("lastObserved")).alias("n")).collect())
        assert told == [("again", 0, limit + 1), ("both", early, limit + 1), ("time", early - 1, limit + 1)]


def test_edge_events_compare_ids(spark, tmp_path):
    t = live.LiveTable(spark, str(tmp_path / "t"), parts=1)
    edge = lambda i: {"id": f"CALLS:OBSERVED:service:n{i}->service:z", "source": f"service:n{i}", "target": "service:z", "type": "CALLS", "provenance": "OBSERVED", "callCount": 1}
    t.commit(0, {"edges": table(spark, EDGES, [edge(i) for i in range(20)])})
    t.commit(1, {"edges": table(spark, EDGES, [edge(i) for i in range(10, 30)])})
    told = {(r["batch"], r["event"], r["id"], r["fields"]) for r in t.changes().collect()}
    assert told == {(b, "edge-added", edge(i)["id"], None) for b, r in ((0, range(20)), (1, range(20, 30))) for i in r}
    old, new = t.read(), t.read()
    plan = live.LiveTable._events(t.kinds["edges"], old, new)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string>" in plan and "callCount" not in plan
