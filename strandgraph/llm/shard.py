"""Sharding along a Hilbert curve over quantised metadata.

Each row's metadata dimensions are quantised to ``bits`` bits each and give a
cell of the curve; rows in curve order are cut into runs, so the files of a
shard span small boxes in every dimension at once and readers prune by any.
The law is ``rows``: shard sizes differ by one at most.

A global order needs no global sort.  The number of cells is bounded by
``2 ** (bits * dimensions)`` (32,768 here), so the offsets of cells are a
bounded table.  A cell is split by a hash of the row into buckets of about
``bucket_rows`` rows, so a hot cell (one source with a third of all rows) is
ordered by many tasks; a row's rank is its cell's offset, its bucket's offset
and its place in the bucket.  Shard and slot follow from the rank alone.

Categories are numbered in the order of their values, so that neighbours on the
curve are neighbours in value.  Null metadata is a value of its own; a null text has size 8 and crc 0; equal
rows are ordered arbitrarily among themselves, which no output shows; an empty
table gives an empty result; other columns pass through, and a clash with an
output or helper name is refused.  Texts are only measured, whatever their length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sparkops import checkpoint

BITS = 5
#: Buckets whose offsets are summed in one task.
GROUP = 1024
#: Columns that are made and dropped on the way.
HELPERS = ("_count", "_before", "_total", "_buckets", "_bucket", "_place", "_n", "_earlier", "_rank", "_group", "_in_group", "_groups")


def hilbert(coordinates: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points with ``bits`` bits in each dimension."""
    x = [np.asarray(c, np.int64).copy() for c in coordinates]
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the largest cube down
        p = q - 1
        for axis in x:
            inverted = (axis & q) != 0
            swap = np.where(inverted, 0, (x[0] ^ axis) & p)
            x[0] ^= np.where(inverted, p, 0) ^ swap
            axis ^= swap
        q >>= 1
    for i in range(1, len(x)):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            index = (index << 1) | (((axis ^ turn) >> bit) & 1)
    return index


def _value(column: str) -> Column:
    """A category as a string that sorts; null comes first."""
    return F.coalesce(F.concat(F.lit("1"), F.col(column).cast("string")), F.lit("0"))


def category(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """A categorical dimension as a number of ``bits`` bits that follows the order of its values; null comes first.

    Up to ``2 ** bits`` values have codes of their own.  More of them are cut
    into ranges of about equally many rows; at most ``2 ** bits`` limits come
    to the driver, and no task holds more than a range of values.
    """
    most = 1 << bits
    values = checkpoint(df.groupBy(_value(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    if (distinct := values.count()) <= most:
        limits = [(r["_v"], i * most // distinct) for i, r in enumerate(values.orderBy("_v").collect())]
    else:
        ranged = checkpoint(values.repartitionByRange("_v").withColumn("_p", F.spark_partition_id()))
        whole = Window.partitionBy(F.lit(0))
        # A row for each range.
        ranges = ranged.groupBy("_p").agg(F.sum("_n").alias("_n"))
        ranges = ranges.select("_p", F.coalesce(F.sum("_n").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"), F.sum("_n").over(whole).alias("_all"))
        within = Window.partitionBy("_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("_n").over(within), F.lit(0)) + F.col("_first")
        coded = ranged.join(F.broadcast(ranges), "_p").select("_v", F.floor(before * most / F.col("_all")).alias("_code"))
        limits = [(r["_v"], r["_code"]) for r in coded.groupBy("_code").agg(F.min("_v").alias("_v")).orderBy("_code").collect()]
    out = F.lit(0)
    for low, code in limits:
        out = F.when(_value(column) >= low, code).otherwise(out) if code else out
    return out.cast("long")


def magnitude(column: str, bits: int = BITS) -> Column:
    """A size as the number of its half octave, capped."""
    return F.least(F.floor(2 * F.log2(F.coalesce(F.col(column), F.lit(0)).cast("double") + 1)), F.lit((1 << bits) - 1)).cast("long")


def curve(*dimensions: Column, bits: int = BITS) -> Column:
    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert([c.to_numpy() for c in columns], bits))

    return index(*dimensions)


def hilbert_shards(df: DataFrame, cell: Column, shards: int, key: str, bucket_rows: int = 256) -> DataFrame:
    """df (without large columns) with hilbert, shard and slot, by the law ``rows``."""
    if clash := {"hilbert", "shard", "slot", *HELPERS} & {*df.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    rows = checkpoint(df.withColumn("hilbert", cell))
    everything = Window.partitionBy(F.lit(0))
    # At most one row for each cell of the curve: a bounded table.
    cells = rows.groupBy("hilbert").agg(F.count(F.lit(1)).alias("_count"))
    cells = cells.select(
        "hilbert",
        (F.sum("_count").over(everything.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"),
        F.sum("_count").over(everything).alias("_total"),
        F.ceil(F.col("_count") / bucket_rows).cast("long").alias("_buckets"),
    ).fillna(0, ["_before"])
    salted = rows.join(F.broadcast(cells), "hilbert").withColumn("_bucket", F.pmod(F.xxhash64(*rows.columns), F.col("_buckets")))
    bucket = Window.partitionBy("hilbert", "_bucket")
    placed = salted.withColumn("_place", F.row_number().over(bucket.orderBy(key, *(c for c in df.columns if c != key))) - 1)
    # Offsets of buckets within their cell, in two steps, so that no task holds all buckets of a hot cell.
    sizes = salted.groupBy("hilbert", "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_group", F.floor(F.col("_bucket") / GROUP))
    earlier = lambda *of: Window.partitionBy(*of).rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("hilbert", "_group").agg(F.sum("_n").alias("_n"))
    groups = groups.select("hilbert", "_group", F.coalesce(F.sum("_n").over(earlier("hilbert").orderBy("_group")), F.lit(0)).alias("_groups"))
    sizes = sizes.withColumn("_in_group", F.coalesce(F.sum("_n").over(earlier("hilbert", "_group").orderBy("_bucket")), F.lit(0)))
    offsets = sizes.join(groups, ["hilbert", "_group"]).select("hilbert", "_bucket", (F.col("_groups") + F.col("_in_group")).alias("_earlier"))
    rank = F.col("_before") + F.col("_earlier") + F.col("_place")
    out = placed.join(offsets, ["hilbert", "_bucket"]).withColumn("_rank", rank)
    out = out.withColumn("shard", F.expr(f"cast(_rank * {shards} div _total as int)"))
    out = out.withColumn("slot", F.expr(f"_rank - (shard * _total + {shards - 1}) div {shards}"))
    return out.select(*df.columns, "hilbert", "shard", "slot")


def write_shards(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write rows by shard, in curve order within files, for pruning by file statistics."""
    part = F.floor(F.col("slot") / rows_per_file)
    df.withColumn("_part", part).repartition("shard", "_part").sortWithinPartitions("shard", "slot").drop("_part").write.partitionBy("shard").parquet(path)


def op4_hilbert_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert."""
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "lang", "source")
    cell = curve(category(docs, "lang"), category(docs, "source"), magnitude("size"))
    out = hilbert_shards(meta, cell, shards, "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
