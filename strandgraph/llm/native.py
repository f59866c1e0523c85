"""Column expressions shared by the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
_SUMS = "named_struct('at', 0L, 'out', cast(array() as array<bigint>))"


def running_sums(lengths: Column) -> Column:
    """array<bigint> of the sums of all entries before each one.

    Appending to one array is quadratic in its length; here arrays of at most
    ``BLOCK`` entries are appended to, and one with an entry for each block.
    """

    def append(state: Column, value: Column) -> Column:
        return F.struct((state["at"] + value).alias("at"), F.array_append(state["out"], state["at"]).alias("out"))

    def of(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK)))
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x))
        starts = F.aggregate(totals, F.expr(_SUMS), append, lambda s: s["out"])

        def within(block: Column, start: Column) -> Column:
            zero = F.struct(start.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
            return F.aggregate(block, zero, append, lambda s: s["out"])

        return F.flatten(F.zip_with(blocks, starts, within))

    some = F.get(F.transform(F.array(lengths.cast("array<bigint>")), of), 0)
    return F.when(F.size(lengths) > 0, some).otherwise(F.expr("cast(array() as array<bigint>)"))
