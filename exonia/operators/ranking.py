"""Ranks within groups of any size.

A window partitioned by the group alone would put a group that holds a third of all rows into one task. Here each group is
cut into ranges of the sort value, one window counts within a range, and a row for each range brings what lies before it.
These rows are few for each group: of ranges that are still many, ranges are made in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values that one range spans, a power of two. (keys, value) is unique, so a window never sorts more rows than that.
RANGE_WIDTH = 1 << 20


def running_sums(df: DataFrame, keys: list[str], value: str, sums: list[str], width: int = RANGE_WIDTH, bits: int | None = None) -> DataFrame:
    """Adds `_range` and, for each column s of sums, `upto_s`, the sum of s over the group's rows with `value` at most that of the
    row, and `total_s`, that of the whole group. The rows come out partitioned by the keys and `_range`.

    (keys, value) must be unique and value an integer that isn't null; null keys form groups as in groupBy. An empty table
    gives an empty table. df is shuffled once; beside it only a row for each range."""
    bits = bits or (64 if df.schema[value].dataType.typeName() == "long" else 32)
    cut = df.withColumn("_range", F.expr(f"`{value}` div {width}").cast("bigint"))
    ranges = cut.groupBy(*keys, "_range").agg(*(F.sum(s).alias(s) for s in sums))
    left = bits - (width.bit_length() - 1)
    if left > width.bit_length() - 1:
        nested = running_sums(ranges.withColumnRenamed("_range", "_at"), keys, "_at", sums, width, left)
        heads = nested.select(*keys, F.col("_at").alias("_range"), *((F.col(f"upto_{s}") - F.col(s)).alias(s) for s in sums), *(F.col(f"total_{s}").alias(f"_all_{s}") for s in sums))
    else:
        group = Window.partitionBy(*keys)
        before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        heads = ranges.select(*keys, "_range", *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(s) for s in sums), *(F.sum(s).over(group).alias(f"_all_{s}") for s in sums))
    # A head stands before the rows of its range, as its value is null, and adds up what lies before the range.
    rows = cut.withColumns({s: F.col(s).cast("bigint") for s in sums} | {f"_all_{s}": F.lit(None).cast("bigint") for s in sums})
    both = rows.unionByName(heads, allowMissingColumns=True)
    upto = Window.partitionBy(*keys, "_range").orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumns({**{f"upto_{s}": F.sum(s).over(upto) for s in sums}, **{f"total_{s}": F.max(f"_all_{s}").over(upto) for s in sums}})
    return counted.where(F.col(value).isNotNull()).select(*cut.columns, *(f"upto_{s}" for s in sums), *(f"total_{s}" for s in sums))


def running_counts(df: DataFrame, keys: list[str], value: str, weight: str, width: int = RANGE_WIDTH) -> DataFrame:
    """running_sums of one column: adds `upto` and `total`."""
    return running_sums(df, keys, value, [weight], width).select(*df.columns, F.col(f"upto_{weight}").alias("upto"), F.col(f"total_{weight}").alias("total"))
