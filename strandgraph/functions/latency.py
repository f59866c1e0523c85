"""A fixed log-linear latency histogram: mergeable by adding counts of buckets.

Octaves 2**-10 ... 2**22 ms, 16 linear parts each, a bucket for zero and one
for overflow: 530 buckets at most, whatever the number of samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW_OCTAVE, HIGH_OCTAVE, PARTS = -10, 22, 16
OVERFLOW = (HIGH_OCTAVE - LOW_OCTAVE + 1) * PARTS + 1


def bucket(ms: Column) -> Column:
    """Bucket of a duration; 0 for what is not positive or not finite."""
    octave = F.floor(F.log2(ms))
    part = F.floor((ms / F.pow(F.lit(2.0), octave) - 1.0) * PARTS)
    inside = 1 + (octave - LOW_OCTAVE) * PARTS + F.least(F.greatest(part, F.lit(0)), F.lit(PARTS - 1))
    return (
        F.when(ms.isNull() | F.isnan(ms) | (ms <= 0) | (ms == float("inf")), 0)
        .when(octave < LOW_OCTAVE, 1)
        .when(octave > HIGH_OCTAVE, OVERFLOW)
        .otherwise(inside)
        .cast("int")
    )


def midpoint(index: Column) -> Column:
    """The middle of a bucket in ms."""
    octave = F.floor((index - 1) / PARTS) + LOW_OCTAVE
    part = (index - 1) % PARTS
    return F.when(index <= 0, 0.0).when(index >= OVERFLOW, F.lit(float(2 ** (HIGH_OCTAVE + 1)))).otherwise(F.pow(F.lit(2.0), octave) * (1.0 + (part + 0.5) / PARTS))


def histogram(samples: DataFrame, keys: list[str], ms: str) -> DataFrame:
    """keys, bucket, n: partial aggregation keeps at most 530 rows a key and task."""
    return samples.groupBy(*keys, bucket(F.col(ms)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(hist: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    """keys and one column for each point: the midpoint of the bucket that holds the nearest rank, to two places."""
    w = Window.partitionBy(*keys)
    summed = hist.withColumn("_upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("_total", F.sum("n").over(w))
    pick = [F.round(midpoint(F.min(F.when(F.col("_upto") >= F.greatest(F.lit(1.0), F.ceil(F.lit(q) * F.col("_total"))), F.col("bucket")))), 2).alias(name) for name, q in points.items()]
    return summed.groupBy(*keys).agg(F.max("_total").alias("samples"), *pick)


def merge_maps(left: Column, right: Column) -> Column:
    """Two histograms as maps, added."""
    return F.map_zip_with(F.coalesce(left, F.create_map().cast("map<int,bigint>")), F.coalesce(right, F.create_map().cast("map<int,bigint>")), lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
